"""Substring deduplication by compaction of a De Bruijn graph of words.

An edge is a window of consecutive words, its nodes are the window without its
last and without its first word. Documents are laid out in blocks by id. A
census over edge hashes, dealt to buckets, finds the edges of more than one
block and tells every block that has one the first place where it stands; what
repeats inside a block the block sees itself. Edges that follow one another
both in a document and at their source make an unbranched path, which becomes
one span. Each distinct path is then checked at its source, on the words.

A block sends an edge once and gets at most one answer for it, so a passage
that a third of all documents share costs one entry per block. What blocks of
a task send to a bucket travels as one row, and so does what buckets of a task
answer to a block: rows are as many as their bytes ask for, not one for each
block and bucket, which would be the square of the input. Keys of edges
are as long as the number of words asks for, so that no two different edges
are likely to share one anywhere in the corpus (a chance of about one in a hundred);
a path that fails its check repeats the whole census with other hashes.

A row loses words to rows of a smaller id only: rows of one id, however often
it repeats, lose nothing to one another, and a row without an id neither loses
words nor takes any. Rows are laid out by id, those without one last, so that
the first place of an edge is one of the smallest id. Null text has no words.
Texts of fewer words than a window lose nothing. An empty table gives an empty
result; other columns are not looked at.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quotary.llm.common import each_row, group_runs, record_batch, settled, slices, take, text_column
from quotary.llm.components import components
from quotary.llm.words import SPACE, Words, scan, window_starts, windows

_BLOCK = pa.schema([("block", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("sizes", pa.list_(pa.int64())),
                    ("size", pa.int64()), ("texts", pa.binary())])
_BLOCK_DDL = "block bigint, doc_ids array<bigint>, sizes array<bigint>, size bigint, texts binary"
_ENTRY = pa.schema([("bucket", pa.int64()), ("heads", pa.binary()), ("sizes", pa.binary()), ("places", pa.binary()), ("edges", pa.binary())])
_ENTRY_DDL = "bucket bigint, heads binary, sizes binary, places binary, edges binary"
_TOGETHER = 1 << 21  # edges that a task holds before it deals them to buckets
_AT_ONCE = 1 << 20  # answers that a task holds before it deals them to blocks
_ANSWER = pa.schema([("block", pa.int64()), ("places", pa.binary()), ("owners", pa.binary()), ("sources", pa.binary()), ("same", pa.binary())])
_ANSWER_DDL = "block bigint, places binary, owners binary, sources binary, same binary"
_OUT = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string()),
                  ("start", pa.int64()), ("owner", pa.int64()), ("source", pa.int64()), ("digest", pa.binary())])
_OUT_DDL = ("doc_id bigint, n_words bigint, n_removed bigint, kept_sha256 string, start bigint, owner bigint, source bigint, "
            "digest binary")


def _blocks(docs: DataFrame) -> DataFrame:
    """Documents in order of id, packed into blocks of about 1 MB of text whose numbers follow that order."""
    def rows(batches):
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 32
        for batch in slices(batches):
            raw = batch.column("text").cast(pa.binary()).to_pylist()
            text = b"".join(raw)
            yield record_batch(_BLOCK, [[number], [batch.column("doc_id").to_pylist()], [[len(x) for x in raw]], [len(text)],
                                        [pa.compress(text, codec="zstd", asbytes=True)]])
            number += 1

    order = F.col("doc_id").asc_nulls_last(), F.xxhash64("text")
    ordered = docs.repartitionByRange(*order).sortWithinPartitions(*order, "text")
    return settled(ordered.mapInArrow(rows, _BLOCK_DDL))


def _words(row: dict, hashes: bool = True) -> Words:
    text = pa.decompress(row["texts"], decompressed_size=row["size"], codec="zstd", asbytes=True) if row["size"] else b""
    ends = np.cumsum(row["sizes"]).tolist()
    return scan([text[b - n : b] for n, b in zip(row["sizes"], ends, strict=True)], SPACE, hashes=hashes)


def _with_list(batches, name: str):
    """Rows one by one without the list ``name``, and the columns of its structs."""
    for batch in batches:
        lists = batch.column(name)
        for at, row in zip(lists, each_row([batch.drop_columns([name])]), strict=True):
            yield row, at.values.flatten() if at.is_valid else None


def _joined(column: pa.Array, kind: type) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind)


def _deal(key: np.ndarray) -> tuple[np.ndarray, list[int], list[int]]:
    """An order by key that keeps what is alike in sequence, and where the run of each key begins and ends in it."""
    order = np.argsort(key, kind="stable")
    cuts = np.flatnonzero(np.diff(key[order])) + 1
    return order, [0, *cuts.tolist()], [*cuts.tolist(), key.size]


def alike(low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which group of equal keys each key is in, and where each group comes first; groups are numbered in that order.

    The upper bits of the low halves are sorted with the places below them. Should keys share those bits only, whole
    keys are sorted.
    """
    def groups(later: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        is_first = np.ones(low.size, bool)
        is_first[later] = False
        number = np.cumsum(is_first) - 1
        number[later] = number[first]
        return number, np.flatnonzero(is_first)

    def repeats(new: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of a sort's entries, those that repeat one before, and the first of their kind."""
        at = np.flatnonzero(~new)
        return at, np.maximum.accumulate(np.where(new, np.arange(new.size), 0))[at]

    bits = np.uint64(low.size.bit_length())
    below = (np.uint64(1) << bits) - np.uint64(1)
    packed = np.sort(low & ~below | np.arange(low.size, dtype=np.uint64))
    upper = packed >> bits
    at, first_at = repeats(np.concatenate([[True], upper[1:] != upper[:-1]])[: low.size])
    later, first = ((packed[x] & below).astype(np.int64) for x in (at, first_at))
    if np.array_equal(low[later], low[first]) and np.array_equal(high[later], high[first]):
        return groups(later, first)
    order = np.lexsort((high, low))  # stable
    l, h = low[order], high[order]
    at, first_at = repeats(np.concatenate([[True], (l[1:] != l[:-1]) | (h[1:] != h[:-1])]))
    return groups(order[at], order[first_at])


def _ids(row: dict) -> tuple[np.ndarray, np.ndarray]:
    """The documents' ids, and which have none; these come last."""
    none = np.array([d is None for d in row["doc_ids"]], bool)
    return np.array([0 if d is None else d for d in row["doc_ids"]], np.int64), none


class _Edges:
    """The edges of a block: where each starts, which are equal, and where equal ones start first."""

    def __init__(self, words: Words, window: int, seed: int):
        self.at = window_starts(words, window)
        self.low, self.high = (windows(words.hashes, window, 2 * seed + i)[self.at] for i in (0, 1))
        self.group, self.first = alike(self.low, self.high)


def key_bytes(n_bytes: int, buckets: int) -> int:
    """Bytes of an edge's key besides its bucket, for texts of ``n_bytes`` in all.

    Two bits per doubling of the words, taken as a quarter of the bytes, and six to spare.
    """
    bits = 2 * max(n_bytes // 4, 1).bit_length() + 6 - (buckets.bit_length() - 1)
    return min(max(-(-bits // 8), 4), 15)


def _census(blocks: DataFrame, window: int, seed: int, buckets: int, width: int) -> DataFrame:
    """For each block, which of its edges stand in an earlier block, where they stand first, and whether that is under the
    id that this block begins with: ids may run over blocks, and a row loses nothing to its own id.

    For that a block has a head: its number, its first and last id, and the word from which on the last one stands.
    """
    def dealt(held):
        heads = np.array([h[0] for h in held], np.int64)
        bucket, key, place = (np.concatenate([h[i] for h in held]) for i in (1, 2, 3))
        of = np.repeat(np.arange(len(held)), [h[1].size for h in held])
        out = []
        order, begin, end = _deal(bucket)
        for a, b in zip(begin, end, strict=True):
            own = order[a:b]
            places = np.diff(place[own], prepend=np.uint32(0))
            out.append((int(bucket[own[0]]), heads.tobytes(), np.bincount(of[own], minlength=len(held)).tobytes(),
                        pa.compress(places.tobytes(), codec="zstd", asbytes=True), key[own].tobytes()))
        return record_batch(_ENTRY, [list(c) for c in zip(*out, strict=True)])

    def entries(batches):
        held, size = [], 0
        for row in each_row(batches):
            words = _words(row)
            edges = _Edges(words, window, seed)
            ids, none = _ids(row)
            some = int(np.count_nonzero(~none))
            # rows without an id are no source and lose nothing
            first = edges.first[edges.at[edges.first] < words.first[some]]
            if not first.size:
                continue
            head = row["block"], int(ids[0]), int(ids[some - 1]), int(words.first[np.searchsorted(ids[:some], ids[some - 1])])
            bucket = (edges.high[first] % np.uint64(buckets)).astype(np.min_scalar_type(buckets))
            key = np.column_stack([edges.low[first], edges.high[first] // np.uint64(buckets)]).astype("<u8")
            key = np.ascontiguousarray(key.view(np.uint8).reshape(-1, 16)[:, :width])
            held.append((head, bucket, key, edges.at[first].astype(np.uint32)))
            size += first.size
            if size >= _TOGETHER:
                yield dealt(held)
                held, size = [], 0
        if held:
            yield dealt(held)

    def met(rows):
        """The answers of one bucket: (block, place, owner, source, same)."""
        heads = _joined(rows.column("heads"), np.int64).reshape(-1, 4)
        sizes = _joined(rows.column("sizes"), np.int64)
        edges = rows.column("edges").to_pylist()
        place = np.concatenate([np.cumsum(np.frombuffer(pa.decompress(
            p, decompressed_size=4 * (len(e) // width), codec="zstd", asbytes=True), np.uint32), dtype=np.uint32)
            for p, e in zip(rows.column("places").to_pylist(), edges, strict=True)])
        edge = np.zeros((place.size, 16), np.uint8)
        edge[:, :width] = np.frombuffer(b"".join(edges), np.uint8).reshape(-1, width)
        head = np.repeat(np.arange(sizes.size), sizes)
        order = np.argsort(heads[head, 0], kind="stable")  # the first of equal edges is that of the first block
        place, head = place[order], head[order]
        low, high = np.ascontiguousarray(edge.view("<u8")[order].T)
        group, first = alike(low, high)
        source = first[group]
        mine = np.flatnonzero(head != head[source])
        source = source[mine]
        block, first_id, last_id, tail = heads.T
        same = (last_id[head[source]] == first_id[head[mine]]) & (place[source] >= tail[head[source]])
        return block[head[mine]], place[mine], block[head[source]], place[source], same

    def told(held):
        block, *told = (np.concatenate(c) for c in zip(*held, strict=True))
        order, begin, end = _deal(block)
        told = [c[order] for c in told]
        return record_batch(_ANSWER, [block[order[begin]], *[[c[a:b].tobytes() for a, b in zip(begin, end, strict=True)] for c in told]])

    def answers(batches):
        held, size = [], 0
        for table in group_runs(batches, "bucket"):
            bucket = table.column("bucket").to_numpy()
            starts = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]]))
            for at, n in zip(starts.tolist(), np.diff(np.append(starts, bucket.size)).tolist(), strict=True):
                found = met(table.slice(at, n))
                if found[0].size:
                    held.append(found)
                    size += found[0].size
                if size >= _AT_ONCE:
                    yield told(held)
                    held, size = [], 0
        if held:
            yield told(held)

    entry = blocks.mapInArrow(entries, _ENTRY_DDL)
    return settled(entry.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(answers, _ANSWER_DDL))


def _resolved(blocks: DataFrame, answers: DataFrame, window: int, seed: int) -> DataFrame:
    """Rows of documents (what is left of each) and rows of spans (a start, and the source of the path)."""
    def rows(batches):
        for row, told in _with_list(batches, "answers"):
            words = _words(row)
            edges = _Edges(words, window, seed)
            home = words.texts
            owner = np.full(edges.first.size, -1)
            source = np.zeros(edges.first.size, np.int64)
            same = np.zeros(edges.first.size, bool)
            ids, none = _ids(row)
            place = edges.at[edges.first]
            if told is not None:
                group = np.searchsorted(place, _joined(told[0], np.uint32))
                owner[group], source[group], same[group] = (_joined(c, t) for c, t in zip(told[1:], (np.int64, np.uint32, bool), strict=True))
            owner, source, same = owner[edges.group], source[edges.group], same[edges.group]
            first, own = place[edges.group], home[edges.at]
            outside = (owner >= 0) & ~(same & (ids[own] == ids[0]))
            inside = (owner < 0) & (ids[home[first]] < ids[own])
            owner[inside], source[inside] = row["block"], first[inside]
            hit = np.flatnonzero((outside | inside) & ~none[own])
            at, owner, source = edges.at[hit], owner[hit], source[hit]

            edge = np.zeros(words.starts.size + window + 1, np.int64)
            edge[at] += 1
            edge[at + window] -= 1
            keep = np.cumsum(edge)[: words.starts.size] == 0
            kept, kept_at = words.joined(keep)
            n_kept = np.concatenate([[0], np.cumsum(keep)])[words.first]
            n_words = np.diff(words.first)
            digests = [hashlib.sha256(kept[kept_at[a] : max(kept_at[b] - 1, kept_at[a])]).hexdigest()
                       for a, b in zip(n_kept[:-1], n_kept[1:], strict=True)]
            yield record_batch(_OUT, [row["doc_ids"], n_words, n_words - np.diff(n_kept), digests, *[pa.nulls(n_words.size, t) for t in _OUT.types[4:]]])

            # paths: edges that follow one another here and at their source
            if at.size:
                cut = np.flatnonzero((np.diff(at) != 1) | (np.diff(owner) != 0) | (np.diff(source) != 1)) + 1
                begin = np.concatenate([[0], cut])
                length = np.diff(np.append(begin, at.size)) + window - 1
                text, text_at = words.joined()
                at, owner, source = at[begin], owner[begin], source[begin]
                local = owner == row["block"]
                here, there = np.where(local, source, 0), np.where(local, source + length, 0)
                bounds = [text_at[x].tolist() for x in (at, at + length, here, there)]
                checks = [b"" if d and text[c:d] == text[a:b] else hashlib.blake2b(text[a:b], digest_size=16).digest()
                          for a, b, c, d in zip(*bounds, strict=True)]
                doc = home[at]
                yield record_batch(_OUT, [ids[doc], length, *[pa.nulls(at.size, t) for t in _OUT.types[2:4]], at - words.first[doc], owner, source, checks])

    per_block = answers.groupBy("block").agg(F.collect_list(F.struct("places", "owners", "sources", "same")).alias("answers"))
    return settled(blocks.join(per_block, "block", "left").mapInArrow(rows, _OUT_DDL))


def _paths(blocks: DataFrame, resolved: DataFrame) -> DataFrame:
    """Each distinct path at its source: document, start, words, how many spans follow it, and whether the words agree.

    Spans of equal source, length and digest are one request, so that what
    copies ask of a source is counted before it is sent.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_words", pa.int64()), ("n_spans", pa.int64()), ("sound", pa.bool_())])

    def rows(batches):
        for row, (source, size, digest, n_spans) in _with_list(batches, "asked"):
            words = _words(row, hashes=False)
            text, at = words.joined()
            source, size = source.to_numpy(), size.to_numpy()
            doc = words.texts[source]
            within = source + size <= words.first[doc + 1]
            bounds = at[source].tolist(), at[np.where(within, source + size, source)].tolist()
            sound = [w and x in (b"", hashlib.blake2b(text[a:b], digest_size=16).digest())
                     for w, x, a, b in zip(within.tolist(), digest.to_pylist(), *bounds, strict=True)]
            yield record_batch(schema, [_ids(row)[0][doc], source - words.first[doc], size, n_spans, sound])

    spans = resolved.where("start is not null")
    asked = spans.groupBy("owner", "source", "n_words", "digest").agg(F.count(F.lit(1)).alias("n_spans"))
    per_block = asked.groupBy(F.col("owner").alias("block")).agg(
        F.collect_list(F.struct("source", "n_words", "digest", "n_spans")).alias("asked"))
    return settled(blocks.join(per_block, "block").mapInArrow(
        rows, "doc_id bigint, start bigint, n_words bigint, n_spans bigint, sound boolean"))


def _sound(blocks: DataFrame, window: int, bucket_bytes: int) -> tuple[DataFrame, DataFrame]:
    """What the blocks resolve to and the paths at their sources, with hashes by which all of them agree with their words."""
    size = blocks.agg(F.sum("size")).collect()[0][0] or 0
    buckets, seed = max(1, -(-size // bucket_bytes)), 0
    width = key_bytes(size, buckets)
    while True:
        resolved = _resolved(blocks, _census(blocks, window, seed, buckets, width), window, seed)
        paths = _paths(blocks, resolved)
        if paths.where("not sound").isEmpty():
            return resolved, paths
        seed += 1


def repeated_spans(docs: DataFrame, window: int = 13, bucket_bytes: int = 2 << 20, id: str = "doc_id",
                   text: str = "text") -> tuple[DataFrame, DataFrame, DataFrame]:
    """What is left of each document (doc_id, n_words, n_removed, kept_sha256), the spans to remove from documents
    (doc_id, start, n_words) and the paths that they repeat (doc_id, start, n_words, n_spans)."""
    docs = take(docs, doc_id=id, text=text)
    blocks = _blocks(docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_column().alias("text")))
    resolved, paths = _sound(blocks, window, bucket_bytes)
    return (resolved.where("start is null").select("doc_id", "n_words", "n_removed", "kept_sha256"),
            resolved.where("start is not null").select("doc_id", "start", "n_words"), paths.drop("sound"))


def deduplicate(docs: DataFrame, window: int = 13, id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: doc_id, n_words, n_removed, kept_sha256."""
    return repeated_spans(docs, window, id=id, text=text)[0]


_NODE = pa.schema([("low", pa.int64()), ("high", pa.int64()), ("block", pa.int64()), ("place", pa.int64()), ("ins", pa.int64()), ("outs", pa.int64())])
_NODE_DDL = "low bigint, high bigint, block bigint, place bigint, ins bigint, outs bigint"
_PIECE = pa.schema([("block", pa.int64()), ("place", pa.int64()), ("end", pa.int64()), ("doc_id", pa.int64()), ("start", pa.int64()), ("n_words", pa.int64())])
_PIECE_DDL = "block bigint, place bigint, end bigint, doc_id bigint, start bigint, n_words bigint"


def _source_runs(words: Words, asked: list[dict], window: int) -> tuple[np.ndarray, np.ndarray]:
    """The runs of repeated edges at their source: first and last place of each, within one text."""
    starts = np.array([r["source"] for r in asked], np.int64)
    edge = np.zeros(words.starts.size + 1, np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + np.array([r["n_words"] for r in asked], np.int64) - window + 1, -1)
    place = np.flatnonzero(np.cumsum(edge[:-1]))
    home = np.searchsorted(words.first, place, side="right")
    cut = np.flatnonzero((np.diff(place) != 1) | (np.diff(home) != 0))
    return place[np.append(0, cut + 1)], place[np.append(cut, place.size - 1)]


def compacted_paths(docs: DataFrame, window: int = 13, bucket_bytes: int = 2 << 20, id: str = "doc_id", text: str = "text") -> DataFrame:
    """The unbranched paths of the De Bruijn graph of repeated windows, as pieces of source texts: doc_id, start, n_words, path.

    Edges are the windows that more than one document has, each at its one
    source. Every block of sources tells the nodes of its edges (the words
    without the last, and without the first); an aggregate by node gives in and
    out degrees. Joined back on the node keys, a node with more than one edge
    in or out cuts the run that leads through it, and a node with one of each
    whose edges have their sources apart joins two runs. Runs joined this way
    are one path, named by the hash of its pieces' least place: pieces of one
    path are components of the links between them. What the pieces say was
    checked at their sources, word by word, before.
    """
    docs = take(docs, doc_id=id, text=text)
    blocks = _blocks(docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_column().alias("text")))
    resolved = _sound(blocks, window, bucket_bytes)[0]
    asked = resolved.where("start is not null").select(F.col("owner").alias("block"), "source", "n_words").distinct()
    sources = settled(blocks.join(asked.groupBy("block").agg(F.collect_list(F.struct("source", "n_words")).alias("asked")), "block"))

    def nodes(batches):
        for row in each_row(batches):
            words = _words(row)
            first, last = _source_runs(words, row["asked"], window)
            low, high = (windows(words.hashes, window - 1, 1000 + i).view(np.int64) for i in (0, 1))
            size = last - first + 2
            run = np.repeat(np.arange(first.size), size)
            place = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + first[run]
            yield record_batch(_NODE, [low[place], high[place], np.full(place.size, row["block"]), place,
                                       (place > first[run]).astype(np.int64), (place <= last[run]).astype(np.int64)])

    def pieces(batches):
        for row in each_row(batches):
            words = _words(row, hashes=False)
            first, last = _source_runs(words, row["asked"], window)
            cuts = np.sort(np.array(row["cuts"] or [], np.int64))
            begin = np.sort(np.concatenate([first, cuts]))
            end = np.sort(np.concatenate([last, cuts - 1]))
            home = np.searchsorted(words.first, begin, side="right") - 1
            yield record_batch(_PIECE, [np.full(begin.size, row["block"]), begin, end + 1, [row["doc_ids"][h] for h in home.tolist()],
                                        begin - words.first[home], end - begin + window])

    node = settled(sources.mapInArrow(nodes, _NODE_DDL))
    degree = node.groupBy("low", "high").agg(F.sum("ins").alias("all_in"), F.sum("outs").alias("all_out"), F.count(F.lit(1)).alias("n")).where("n > 1")
    met = settled(node.join(degree, ["low", "high"]))
    cuts = met.where("(all_in > 1 or all_out > 1) and ins = 1 and outs = 1").groupBy("block").agg(F.collect_list("place").alias("cuts"))
    piece = settled(sources.join(cuts, "block", "left").mapInArrow(pieces, _PIECE_DDL).withColumn("piece", F.xxhash64("block", "place")))
    joints = met.where("all_in = 1 and all_out = 1 and n = 2")
    before = joints.where("ins = 1").join(piece.select("block", F.col("end").alias("place"), F.col("piece").alias("u")), ["block", "place"])
    after = joints.where("outs = 1").join(piece.select("block", "place", F.col("piece").alias("v")), ["block", "place"])
    links = before.select("low", "high", "u").join(after.select("low", "high", "v"), ["low", "high"]).select("u", "v")
    path = components(links).select(F.col("node").alias("piece"), F.col("root").alias("path"))
    return piece.join(path, "piece", "left").select("doc_id", "start", "n_words", F.coalesce("path", "piece").alias("path"))
