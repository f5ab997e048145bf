"""Near duplicates by a chosen-path set similarity join.

A text's set is its distinct shingles. Texts of equal sets are one member.
In each of several independent trees a member walks down the branches that
its own minwise values choose: at every node one signature position, and with
the chance 1/threshold - 1 a second one, so that two sets as similar as the
threshold stay together in one child at least as often as the tree branches.
A node of few members is compared exhaustively; a larger one branches again.
What is still large after the last level is compared with leaders, and the
members that no leader accounts for with the whole node, in blocks: exact, no
candidate is dropped.

Pairs are not written out. Every member first meets its likeliest partners;
then, in each node, members that may be similar and are not connected yet are
compared on their full sets in place, a pair in one of its common nodes only,
and the links that connect something leave the node.

Candidates whose signatures disagree in many more places than the threshold
allows are left out: at a similarity of the threshold that happens to fewer
than one pair in 100,000. Together with the trees this sets the recall; each
link is confirmed on full sets. Links that only confirm what is connected
already are not worked out, and each text's component is returned.

Null or empty text has an empty set and is linked with nothing. A row without
an id takes no part. Rows that repeat an id and a text share their component.
An empty table gives an empty result; other columns are not looked at.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quotary.llm.common import as_rows, group_runs, record_batch, settled, slices, take, text_print
from quotary.llm.components import components
from quotary.llm.words import SPACE, mix, scan, windows

_PLACES = 64  # minwise values in a signature
_ROW = pa.schema([("doc_id", pa.int64()), ("print", pa.int64()), ("n_shingles", pa.int64()), ("digest", pa.binary()), ("signature", pa.binary())])
_PAIR = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("alike", pa.int32())])
_PAIR_DDL = "a bigint, b bigint, alike int"
_LINK = pa.schema([("u", pa.int64()), ("v", pa.int64())])


@dataclass(frozen=True)
class Join:
    """Parameters of the join; the threshold is in percent, so that it is compared in whole numbers."""

    shingle: int = 5
    percent: int = 80
    trees: int = 12
    small: int = 2000
    levels: int = 5
    leaders: int = 2
    seed: int = 11

    @property
    def least_alike(self) -> int:
        """Signature places in which a pair must agree: five standard deviations below the threshold."""
        p = self.percent / 100
        return int(_PLACES * p - 5 * (_PLACES * p * (1 - p)) ** 0.5)


def _sets(words, size: int):
    """Sorted distinct shingle hashes of each text; with fewer words the whole sequence is the one shingle."""
    shingles = windows(words.hashes, size)
    for a, b in zip(words.first[:-1], words.first[1:], strict=True):
        if b - a >= size:
            yield np.unique(shingles[a : b - size + 1])
        elif b > a:
            yield mix(np.array([b - a], np.uint64) + windows(words.hashes[a:b], int(b - a), seed=1))
        else:
            yield np.zeros(0, np.uint64)


def _digest(s: np.ndarray) -> bytes:
    return hashlib.blake2b(s.tobytes(), digest_size=16).digest()


def _signatures(join: Join):
    rng = np.random.default_rng(join.seed)
    factors = rng.integers(0, 1 << 63, _PLACES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    shifts = rng.integers(0, 1 << 64, _PLACES, dtype=np.uint64)

    def sign(s: np.ndarray) -> bytes:
        least = np.full(_PLACES, (1 << 32) - 1, np.uint64)
        for i in range(0, s.size, 1024):
            least = np.minimum(least, ((s[i : i + 1024, None] * factors + shifts) >> np.uint64(32)).min(axis=0))
        return least.astype(np.uint32).tobytes()

    def rows(batches):
        for batch in slices(batches):
            words = scan(batch.column("text"), SPACE, lower=True)
            sets = list(_sets(words, join.shingle))
            yield record_batch(_ROW, [batch.column("doc_id"), batch.column("print"), [s.size for s in sets],
                                      [_digest(s) if s.size else None for s in sets],
                                      [sign(s) if s.size else None for s in sets]])

    return rows


def _branches(join: Join, level: int):
    """Children of a node that each member's minwise values choose; the choice depends on the node alone."""
    second = np.uint64(int((100 / join.percent - 1) * (1 << 32)))

    def child(node: np.ndarray, place: np.ndarray, signature: np.ndarray) -> np.ndarray:
        value = signature[np.arange(node.size), place].astype(np.uint64)
        return mix(node + mix(value * np.uint64(_PLACES) + place.astype(np.uint64) + np.uint64(level << 40)))

    schema = pa.schema([("node", pa.int64()), ("member", pa.int64())])

    def rows(batches):
        for batch in batches:
            member = batch.column("member")
            signature = np.frombuffer(b"".join(batch.column("signature").to_pylist()), np.uint32).reshape(-1, _PLACES)
            if level:
                starts = [batch.column("node").to_numpy().view(np.uint64)]
            else:
                starts = [np.full(len(member), 1 + t, np.uint64) for t in range(join.trees)]
            for node in starts:
                dice = mix(node + np.uint64(join.seed))
                place = (dice % np.uint64(_PLACES)).astype(np.int64)
                other = (place + 1 + ((dice >> np.uint64(8)) % np.uint64(_PLACES - 1)).astype(np.int64)) % _PLACES
                yield record_batch(schema, [child(node, place, signature).view(np.int64), member])
                twice = np.flatnonzero((mix(dice) >> np.uint64(32)) < second)
                if twice.size:
                    yield record_batch(schema, [child(node[twice], other[twice], signature[twice]).view(np.int64),
                                                member.take(pa.array(twice))])

    return rows


def _matrix(column: pa.ChunkedArray | pa.Array, kind, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(-1, width)


def _alike(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Places in which signatures agree, for every row of one side and every row of the other."""
    out = np.empty((left.shape[0], right.shape[0]), np.int32)
    for i, row in enumerate(left):
        out[i] = (right == row).sum(axis=1)
    return out


def _jaccard_at_least(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    x, y = (x, y) if x.size < y.size else (y, x)
    if 100 * x.size < percent * y.size:
        return False
    both = np.count_nonzero(y[np.minimum(np.searchsorted(y, x), y.size - 1)] == x)
    return 100 * both >= percent * (x.size + y.size - both)


class _Node:
    """The members of one node, and which pairs of them can be similar enough."""

    def __init__(self, rows: pa.Table, join: Join):
        self.member = rows.column("member").to_numpy()
        signature = _matrix(rows.column("signature"), np.uint32, _PLACES)
        n = rows.column("n_shingles").to_numpy()
        # a row at a time and a byte a pair: a node of 2,000 members holds 4 MB
        self.alike = np.empty((n.size, n.size), np.int8)
        for i, row in enumerate(signature):
            same = (signature == row).sum(axis=1)
            good = (same >= join.least_alike) & (100 * np.minimum(n[i], n) >= join.percent * np.maximum(n[i], n))
            self.alike[i] = np.where(good, same, -1)
        np.fill_diagonal(self.alike, -1)

    def best(self) -> tuple[list, list, list]:
        """Each member's likeliest partner, and its likeliest among the earlier ones."""
        pairs = {}
        for table in (self.alike, np.tril(self.alike + 1, -1) - 1):
            k = table.argmax(axis=1)
            for i in np.flatnonzero(table[np.arange(k.size), k] >= 0).tolist():
                a, b = int(self.member[i]), int(self.member[k[i]])
                pairs[min(a, b), max(a, b)] = int(table[i, k[i]])
        return [a for a, _ in pairs], [b for _, b in pairs], list(pairs.values())

    def open_pairs(self, root: np.ndarray, nodes: list[list[int]], node: int) -> tuple[np.ndarray, np.ndarray]:
        """Possible pairs of different roots that have no earlier node in common, likeliest first."""
        wanted = np.triu((self.alike >= 0) & (root[:, None] != root), 1)
        rows = np.flatnonzero(wanted.any(axis=1) | wanted.any(axis=0))
        earlier = [[x for x in nodes[i] if x < node] for i in rows.tolist()]
        names, at = np.unique(np.array([x for own in earlier for x in own], np.int64), return_inverse=True)
        has = np.zeros((rows.size, names.size), np.float32)
        has[np.repeat(np.arange(rows.size), [len(own) for own in earlier]), at] = 1
        has = has[:, has.sum(axis=0) > 1]
        wanted[np.ix_(rows, rows)] &= has @ has.T == 0
        i, k = (at.astype(np.int32) for at in np.nonzero(wanted))
        order = np.argsort(-self.alike[i, k], kind="stable")
        return i[order], k[order]


def _each_node(batches, key: str = "node"):
    """One table per node of two members or more, from sorted batches."""
    for rows in group_runs(batches, key):
        node = rows.column(key).to_numpy()
        starts = np.flatnonzero(np.concatenate([[True], node[1:] != node[:-1]]))
        for at, n in zip(starts.tolist(), np.diff(np.append(starts, node.size)).tolist(), strict=True):
            if n > 1:
                yield int(node[at]), rows.slice(at, n)


def _partners(join: Join):
    def rows(batches):
        for _, table in _each_node(batches):
            a, b, alike = _Node(table, join).best()
            if a:
                yield record_batch(_PAIR, [a, b, alike])

    return rows


def _open_members(join: Join):
    """(node, member) of the members that a node still has to compare."""
    schema = pa.schema([("node", pa.int64()), ("member", pa.int64())])

    def rows(batches):
        for node, table in _each_node(batches):
            root = table.column("root").to_numpy()
            if (root == root[0]).all():
                continue
            found = _Node(table, join)
            some = np.union1d(*found.open_pairs(root, table.column("nodes").to_pylist(), node))
            if some.size:
                yield record_batch(schema, [np.full(some.size, node), found.member[some]])

    return rows


def _links_inside(join: Join):
    """Links between roots that a node's full sets confirm; one per pair of roots that it connects."""
    def rows(batches):
        for node, table in _each_node(batches):
            root = table.column("root").to_numpy()
            sets = [np.frombuffer(x, np.uint64) for x in table.column("set").to_pylist()]
            up = {int(r): int(r) for r in root}

            def top(r: int) -> int:
                while up[r] != r:
                    up[r] = up[up[r]]
                    r = up[r]
                return r

            links = []
            pairs = _Node(table, join).open_pairs(root, table.column("nodes").to_pylist(), node)
            for start in range(0, pairs[0].size, 1 << 14):  # unpacked by parts, a large node has millions
                for x, y in zip(*(p[start : start + (1 << 14)].tolist() for p in pairs), strict=True):
                    a, b = top(int(root[x])), top(int(root[y]))
                    if a != b and _jaccard_at_least(sets[x], sets[y], join.percent):
                        up[max(a, b)] = min(a, b)
                        links.append((max(a, b), min(a, b)))
            if links:
                yield record_batch(_LINK, [list(c) for c in zip(*links, strict=True)])

    return rows


def _across(join: Join):
    """Pairs between the two blocks of members that a row carries."""
    def rows(batches):
        for batch in batches:
            for x in range(batch.num_rows):
                block, mates = (batch.column(c)[x].as_py() for c in ("block", "mates"))
                asked, others = (np.frombuffer(b"".join(b["signature"] for b in side), np.uint32).reshape(-1, _PLACES) for side in (block, mates))
                alike = _alike(others, asked)
                m, n = (np.array([b["n_shingles"] for b in side]) for side in (mates, block))
                s, r = (np.array([b["root"] for b in side]) for side in (mates, block))
                good = (alike >= join.least_alike) & (100 * np.minimum(m[:, None], n) >= join.percent * np.maximum(m[:, None], n)) & (s[:, None] != r)
                pairs = [(mates[i]["member"], block[k]["member"]) for i, k in zip(*(at.tolist() for at in np.nonzero(good)), strict=True)]
                if pairs:
                    yield record_batch(_PAIR, [[min(p) for p in pairs], [max(p) for p in pairs], alike[good]])

    return rows


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs whose full sets reach the threshold, as edges."""
    def rows(batches):
        for batch in batches:
            keep = [_jaccard_at_least(*(np.frombuffer(batch.column(c)[i].as_buffer(), np.uint64) for c in ("x", "y")), percent)
                    for i in range(batch.num_rows)]
            batch = batch.filter(pa.array(keep, pa.bool_()))
            yield record_batch(_LINK, [batch.column("a"), batch.column("b")])

    left = sets.select(F.col("member").alias("a"), F.col("set").alias("x"))
    right = sets.select(F.col("member").alias("b"), F.col("set").alias("y"))
    return pairs.select("a", "b").join(left, "a").join(right, "b").mapInArrow(rows, "u bigint, v bigint")


def _set_table(docs: DataFrame, members: DataFrame, needed: DataFrame, join: Join, key: str) -> DataFrame:
    """(member, set) of the needed members, from one text of each, which the column ``key`` names."""
    chosen = members.join(needed, "member").select(key, "member", "digest")
    schema = pa.schema([("member", pa.int64()), ("set", pa.binary())])

    def rows(batches):
        for batch in slices(batches):
            sets = _sets(scan(batch.column("text"), SPACE, lower=True), join.shingle)
            columns = (batch.column(c).to_pylist() for c in ("member", "digest"))
            found = [(m, s.tobytes()) for s, m, digest in zip(sets, *columns, strict=True) if _digest(s) == digest]
            yield record_batch(schema, [[m for m, _ in found], [s for _, s in found]])

    # a key that repeats brings other texts along, and equal ones again
    return docs.join(chosen, key).select("member", "digest", "text").mapInArrow(rows, "member bigint, set binary").dropDuplicates(
        ["member"])


def _rooted(rows: DataFrame, roots: DataFrame) -> DataFrame:
    """Rows of members with their roots; a member without links is its own."""
    return rows.join(roots.withColumnRenamed("node", "member"), "member", "left").withColumn("root", F.coalesce("root", "member"))


def _merged(roots: DataFrame, links: DataFrame) -> DataFrame:
    """Roots after links between roots have been added."""
    higher = settled(components(links))
    moved = roots.join(higher.select(F.col("node").alias("root"), F.col("root").alias("_top")), "root", "left").select(
        "node", F.coalesce("_top", "root").alias("root"))
    # roots without links of their own so far
    return settled(moved.unionByName(higher.join(roots.select("node"), "node", "left_anti").select("node", "root")))


def _large_nodes(large: DataFrame, members: DataFrame, sets: DataFrame, join: Join, roots: DataFrame) -> DataFrame:
    """Roots after the nodes that stayed large: leaders first, then what they leave over against the whole node."""
    for turn in range(join.leaders + 1):
        rooted = _rooted(large, roots)
        # the root that most members share, and whoever is not of it
        shares = rooted.groupBy("node", "root").agg(F.count(F.lit(1)).alias("n"))
        top = shares.groupBy("node").agg(F.max(F.struct("n", "root")).alias("top"), F.count(F.lit(1)).alias("roots")).where("roots > 1")
        rest = settled(rooted.join(top, "node").where(F.col("root") != F.col("top.root")).select("node", "member", "root"))
        if rest.isEmpty():
            break
        if turn < join.leaders:
            pool = rooted if turn == 0 else rest
            asked = (pool.join(rest.select("node").distinct(), "node").groupBy("node")
                     .agg(F.min_by(F.struct("member", "root"), F.xxhash64(F.lit(turn), "member")).alias("m")).select("node", "m.*"))
        else:
            asked = rest
        # blocks of about 64 members, as many as the rest needs, against the node in blocks of that size
        side = members.select("member", "n_shingles", "signature")

        def blocks(rows: DataFrame, name: str) -> DataFrame:
            sizes = rows.groupBy("node").agg(F.ceil(F.count(F.lit(1)) / 64).alias("blocks"))
            return (rows.join(sizes, "node").withColumn("part", F.pmod(F.xxhash64("member"), F.col("blocks"))).join(side, "member")
                    .groupBy("node", "part").agg(F.collect_list(F.struct("member", "root", "n_shingles", "signature")).alias(name)).drop("part"))

        whole = rooted.join(asked.select("node").distinct(), "node", "left_semi")
        everyone = blocks(asked, "block").join(blocks(whole, "mates"), "node").select("block", "mates")
        pairs = settled(everyone.mapInArrow(_across(join), _PAIR_DDL).select("a", "b").distinct())
        found = _confirmed(pairs, sets, join.percent)
        for end in ("u", "v"):
            found = _rooted(found.withColumnRenamed(end, "member"), roots).drop("member").withColumnRenamed("root", end)
        roots = _merged(roots, found.select("u", "v"))
    return roots


def _linked(docs: DataFrame, join: Join, by: list[str]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rows, members, roots): rows of doc_id, print, n_shingles and digest, members of a digest each, and the root of
    every member that has links. A member's text is that of the least row by the columns ``by``; a row in which the
    last of them is null takes no part."""
    rows = settled(docs.withColumn("print", text_print()).mapInArrow(
        _signatures(join), "doc_id long, print long, n_shingles long, digest binary, signature binary"))
    members = settled(rows.where(f"digest is not null and {by[-1]} is not null").groupBy("digest").agg(
        F.min(F.struct(*by)).alias("least"), F.first("n_shingles").alias("n_shingles"), F.first("signature").alias("signature"))
        .select("digest", "least.*", "n_shingles", "signature").withColumn("member", F.monotonically_increasing_id()))

    few, large = None, members.select("member")
    for level in range(join.levels):
        at = members.select("member", "signature") if level == 0 else large.join(members.select("member", "signature"), "member")
        nodes = settled(at.mapInArrow(_branches(join, level), "node long, member long"))
        sizes = nodes.groupBy("node").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
        sized = settled(nodes.join(sizes, "node"))
        own = sized.where(F.col("n") <= join.small).select("node", "member")
        few = own if few is None else few.unionByName(own)
        large = sized.where(F.col("n") > join.small).select("node", "member")
        if large.isEmpty():
            break

    lists = few.groupBy("member").agg(F.sort_array(F.collect_list("node")).alias("nodes"))
    cards = settled(lists.join(members.select("member", "n_shingles", "signature"), "member"))

    def by_node(frame: DataFrame) -> DataFrame:
        spread = frame.withColumn("node", F.explode("nodes"))
        return spread.repartition("node").sortWithinPartitions("node", "member")

    # first the likeliest partners of each member
    met = by_node(cards.select("member", "n_shingles", "signature", "nodes")).drop("nodes").mapInArrow(_partners(join), _PAIR_DDL)
    met = settled(met.groupBy("a", "b").agg(F.max("alike").alias("alike")))
    near = met.groupBy("b").agg(F.max_by("a", F.struct("alike", "a")).alias("a"))
    partnered = met.select(F.explode(F.array("a", "b")).alias("member"))
    sets = settled(_set_table(docs if by[-1] == "doc_id" else docs.withColumn(by[-1], text_print()), members, partnered.unionByName(large.select("member")).distinct(), join, by[-1]))
    roots = settled(components(_confirmed(near, sets, join.percent)))
    # then whatever may link members that this leaves apart
    candidates = cards.join(partnered.distinct(), "member", "left_semi")
    rooted = settled(_rooted(candidates, roots))
    opened = settled(by_node(rooted).mapInArrow(_open_members(join), "node bigint, member bigint"))
    if not opened.isEmpty():
        full = opened.join(rooted, "member").join(sets, "member").repartition("node").sortWithinPartitions("node", "member")
        roots = _merged(roots, settled(full.mapInArrow(_links_inside(join), "u bigint, v bigint")))
    if not large.isEmpty():
        roots = _large_nodes(large, members, sets, join, roots)

    return rows, members, roots


def _input(docs: DataFrame, id: str, text: str) -> DataFrame:
    return take(docs, doc_id=id, text=text).withColumn("doc_id", F.col("doc_id").cast("long")).withColumn(
        "text", F.col("text").cast("string"))


def near_duplicates(docs: DataFrame, join: Join | None = None, id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: id, n_shingles, component_id (least id reachable over links) and kept (it is its own)."""
    rows, members, roots = _linked(_input(docs, id, text), join or Join(), ["doc_id"])
    named = roots.withColumnRenamed("node", "member").join(members.select("member", "doc_id"), "member")
    least = named.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    of_member = named.join(least, "root").select("member", "component_id")
    of_digest = members.join(of_member, "member", "left").select("digest", F.coalesce("component_id", "doc_id").alias("component_id"))
    linked = rows.where("digest is not null").select("doc_id", "n_shingles", "digest").join(of_digest, "digest", "left").select(
        "doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"))
    alone = rows.where("digest is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.col("component_id").eqNullSafe(F.col("doc_id")))


def drop_near_duplicates(docs: DataFrame, join: Join | None = None, id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` whose id is the least of a component, with its columns.

    All rows of a kept id stay, and all without one; ``one_row_of_each`` leaves one row of a component.
    """
    kept = near_duplicates(docs, join, id, text).where("kept").select("doc_id").distinct()
    return as_rows(docs, id=F.col(f"`{id}`").cast("long")).join(kept, F.col("id").eqNullSafe(F.col("doc_id")), "left_semi").select("row.*")


def one_row_of_each(docs: DataFrame, join: Join | None = None, id: str = "doc_id", text: str = "text") -> DataFrame:
    """Exactly one row of ``docs`` for each component of near duplicates, with its columns; ids may repeat or be null.

    A row's key is its id and a hash of its text; texts, whatever their ids, are what is linked. The row of the least
    id stays, of one id that of the least hash, one without id where there is no other. Of rows that tie in both, one
    stays. Texts without words are linked with nothing and all stay.
    """
    rows, members, roots = _linked(_input(docs, id, text), join or Join(), ["print"])
    of_digest = members.select("digest", "member").join(roots.withColumnRenamed("node", "member"), "member", "left").select(
        "digest", F.coalesce("root", "member").alias("root"))
    # rows of one key are counted before they meet the root, so that copies travel once
    keys = rows.where("digest is not null").groupBy("digest", "doc_id", "print").agg(F.count(F.lit(1)).alias("n"))
    least = keys.join(of_digest, "digest").groupBy("root").agg(
        F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "print", "n")).alias("least"))
    kept = settled(least.select("least.doc_id", "least.print", "least.n").unionByName(
        rows.where("digest is null").select("doc_id", "print", F.lit(1).cast("long").alias("n")).distinct()))

    keyed = as_rows(docs, id=F.col(f"`{id}`").cast("long"), own=text_print(text))

    def of(some: DataFrame) -> DataFrame:
        return keyed.join(some.select("doc_id", "print"), F.col("id").eqNullSafe(F.col("doc_id")) & (F.col("own") == F.col("print")), "left_semi")

    tied = kept.where("n > 1")
    out = of(kept.where("n = 1"))
    return (out if tied.isEmpty() else out.unionByName(of(tied).dropDuplicates(["id", "own"]))).select("row.*")
