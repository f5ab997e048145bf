"""Toxicity by nearest labelled examples: exact TF-IDF cosine over a block-max inverted index, distance-weighted votes.

Terms are words and word beginnings of three to six characters. Those that
labelled toxic texts hold more often than others (a likelihood ratio test)
have a place of their own in a text's vector; one place counts all words, so
that the direction of a vector says how dense the terms are in the whole text.
Weights are the root of the count times the inverse document frequency.

Equal example vectors are one entry with its share of toxic labels. Entries
lie in blocks of neighbours; per block and term the index has the postings and
the largest weight. A search bounds each block's best cosine from these
maxima, opens blocks from the largest bound on, and stops once no bound
reaches the k-th cosine found: the result is that of comparing all entries.

A score is a logistic function of the logit of the weighted votes, fitted on
the examples with each left out of its own vote.

The fit may use a bounded sample of labelled rows, ``examples`` of them (by a
hash of the id; a few more or less); every document is scored from its whole
text. A text without words, a null one too, has no neighbours and the examples'
share of toxic labels as its score. Repeated rows are scored alike, a document
with several labels is toxic if one says so, a row with a null id takes no
label, a null label counts for nothing. Without labels of both classes the
score is the share of label 1, or a half. An empty table gives an empty
result; columns other than id and text are not looked at.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quotary.llm.common import record_batch, settled, slices, take, text_column
from quotary.llm.words import MARKS, hashed, spans

BEGINNINGS = (3, 4, 5, 6)
_BEGINNING = np.uint64(0x5DEECE66D1CE4E5B)


def terms(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash and text of each term (a word or the beginning of a longer one), and the number of words of each text."""
    buf, starts, ends, begins = spans(texts, MARKS, lower=True)
    first = np.searchsorted(starts, begins)
    home = np.repeat(np.arange(len(texts)), np.diff(first))
    chars = np.append(np.flatnonzero((buf & 0xC0) != 0x80), np.full(max(BEGINNINGS), buf.size + 1))
    at = np.searchsorted(chars, starts)
    froms, tos, homes, kinds = [starts], [ends], [home], [np.zeros(starts.size, np.uint64)]
    for n in BEGINNINGS:
        longer = np.flatnonzero(chars[at + n] < ends)
        froms.append(starts[longer])
        tos.append(chars[at[longer] + n])
        homes.append(home[longer])
        kinds.append(np.full(longer.size, _BEGINNING))
    found = hashed(buf, np.concatenate(froms), np.concatenate(tos)) ^ np.concatenate(kinds)
    return found, np.concatenate(homes), np.diff(first)


@dataclass(frozen=True)
class Terms:
    """The chosen terms' hashes, ascending, and the weight of each place; place 0 counts all words."""

    hashes: np.ndarray
    idf: np.ndarray

    def vectors(self, texts: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Places and weights of each text's unit vector; none of a text without words."""
        found, home, n_words = terms(texts)
        near = np.zeros(1 << 16, bool)
        near[(self.hashes & np.uint64(0xFFFF)).astype(np.int64)] = True
        some = np.flatnonzero(near[(found & np.uint64(0xFFFF)).astype(np.int64)])
        found, home = found[some], home[some]
        place = np.searchsorted(self.hashes, found)
        same = np.flatnonzero(self.hashes[np.minimum(place, self.hashes.size - 1)] == found) if self.hashes.size else np.zeros(0, np.int64)
        width = self.idf.size
        keys, counts = np.unique(home[same] * width + place[same] + 1, return_counts=True)
        owner, place = keys // width, keys % width
        weights = np.sqrt(counts) * self.idf[place]
        edges = np.searchsorted(owner, np.arange(len(texts) + 1))
        rest = np.sqrt(n_words) * self.idf[0]
        for i, n in enumerate(n_words.tolist()):
            if not n:
                yield np.zeros(0, np.int64), np.zeros(0)
                continue
            own = slice(edges[i], edges[i + 1])
            w = np.append(rest[i], weights[own])
            yield np.append(0, place[own]), w / math.sqrt((w * w).sum())


@dataclass(frozen=True)
class Index:
    """Example vectors in blocks, as postings by (block, place), with the largest weight of each."""

    width: int
    block: int
    entry: np.ndarray  # of each posting, ordered by block, place and entry
    weight: np.ndarray
    keys: np.ndarray  # block * width + place of the runs of postings
    starts: np.ndarray  # of each run; one entry more than runs
    best: np.ndarray  # [place, block] the largest weight
    n: np.ndarray  # labelled examples of each entry
    toxic: np.ndarray  # of these with label 1
    example: np.ndarray  # the least id among them

    @staticmethod
    def build(vectors: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, ids: np.ndarray, width: int, block: int = 32) -> Index:
        """Equal vectors become one entry; entries with the same places are neighbours, ordered by weight."""
        groups: dict[tuple[bytes, bytes], list[int]] = {}
        for i, (place, w) in enumerate(vectors):
            if place.size:
                groups.setdefault((place.tobytes(), np.round(w, 12).tobytes()), []).append(i)

        def order(members: list[int]) -> tuple:
            place, w = vectors[members[0]]
            return place.size, place.tolist(), (-w).tolist()

        members = sorted(groups.values(), key=order)
        sizes = np.array([vectors[m[0]][0].size for m in members], np.int64)
        entry = np.repeat(np.arange(len(members)), sizes)
        place = np.concatenate([vectors[m[0]][0] for m in members]) if members else np.zeros(0, np.int64)
        weight = np.concatenate([vectors[m[0]][1] for m in members]) if members else np.zeros(0)
        key = entry // block * width + place
        by = np.lexsort((entry, key))
        keys, starts = np.unique(key[by], return_index=True)
        best = np.zeros((width, -(-len(members) // block)))
        np.maximum.at(best, (place, entry // block), weight)
        return Index(width, block, entry[by], weight[by], keys, np.append(starts, entry.size), best,
                     np.array([len(m) for m in members], np.int64), np.array([labels[m].sum() for m in members], np.int64),
                     np.array([ids[m].min() for m in members], np.int64))

    def vector(self, entry: int) -> tuple[np.ndarray, np.ndarray]:
        own = np.flatnonzero(self.entry == entry)
        run = np.searchsorted(self.starts, own, side="right") - 1
        return self.keys[run] % self.width, self.weight[own]

    def _open(self, blocks: np.ndarray, place: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All entries of some blocks and their cosines with a vector, to nine digits."""
        wanted = (blocks[:, None] * self.width + place).ravel()
        run = np.minimum(np.searchsorted(self.keys, wanted), self.keys.size - 1)
        there = np.flatnonzero(self.keys[run] == wanted)
        run = run[there]
        lengths = self.starts[run + 1] - self.starts[run]
        ends = np.cumsum(lengths)
        posting = np.arange(ends[-1]) + np.repeat(self.starts[run] - ends + lengths, lengths)
        slot = self.entry[posting] % self.block + np.repeat(there // place.size * self.block, lengths)
        cosines = np.bincount(slot, self.weight[posting] * np.repeat(weight[there % place.size], lengths), blocks.size * self.block)
        entries = (blocks[:, None] * self.block + np.arange(self.block)).ravel()
        real = entries < self.n.size
        return entries[real], np.round(cosines[real], 9)

    def nearest(self, place: np.ndarray, weight: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """The k entries of the largest cosines (to nine digits, ties by entry) and these cosines.

        The blocks of the largest bounds give a k-th cosine to reach; all others whose bound reaches it are opened too.
        """
        bound = weight @ self.best[place] + 1e-9
        some = min(bound.size, max(2, -(-2 * k // self.block)))
        order = np.argpartition(-bound, some - 1)
        entries, cosines = self._open(order[:some], place, weight)
        reach = np.partition(cosines, -k)[-k] if cosines.size >= k else -1.0
        rest = order[some:][bound[order[some:]] >= reach]
        if rest.size:
            more, near = self._open(rest, place, weight)
            entries, cosines = np.append(entries, more), np.append(cosines, near)
        if cosines.size > k:
            near = cosines >= np.partition(cosines, -k)[-k]
            entries, cosines = entries[near], cosines[near]
        top = np.lexsort((entries, -cosines))[:k]
        return entries[top], cosines[top]


def vote(cosines: np.ndarray, shares: np.ndarray, softness: float = 0.01) -> float:
    """The neighbours' share of toxic labels, each weighted by the inverse of its distance."""
    w = 1 / (softness + np.maximum(1 - cosines, 0))
    return float((w * shares).sum() / w.sum())


def _logit(p):
    p = np.clip(p, 1e-3, 1 - 1e-3)
    return np.log(p / (1 - p))


def calibrated(votes: np.ndarray, toxic: np.ndarray, clean: np.ndarray, rounds: int = 50) -> tuple[float, float]:
    """Slope and shift of the logistic function that fits how many with each vote are toxic; Newton's method.

    Two imagined examples, a clean one with the least vote and a toxic one with
    the largest, keep the slope finite and positive.
    """
    x = np.concatenate([_logit(votes), _logit(np.array([0.0, 1.0]))])
    pos, neg = np.append(toxic, [0, 1]).astype(float), np.append(clean, [1, 0]).astype(float)
    design, theta = np.column_stack([x, np.ones(x.size)]), np.array([1.0, 0.0])

    def loss(t: np.ndarray) -> float:
        z = design @ t
        return float((pos * np.logaddexp(0, -z) + neg * np.logaddexp(0, z)).sum() + 0.005 * (t[0] - 1) ** 2)

    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(design @ theta, -500, 500)))
        slope = design.T @ ((pos + neg) * p - pos) + np.array([0.01 * (theta[0] - 1), 0])
        curve = (design * ((pos + neg) * p * (1 - p))[:, None]).T @ design + np.diag([0.01, 1e-9])
        move, size = np.linalg.solve(curve, slope), 1.0
        while size > 1e-6 and loss(theta - size * move) > loss(theta):
            size /= 2
        theta = theta - size * move
        if np.abs(size * move).max() < 1e-9:
            break
    return float(theta[0]), float(theta[1])


@dataclass(frozen=True)
class Model:
    """``share`` is the share of toxic examples; without terms or index it is every score."""

    share: float
    terms: Terms | None = None
    index: Index | None = None
    k: int = 16
    line: tuple[float, float] = (1.0, 0.0)

    def score(self, place: np.ndarray, weight: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        """The score of a vector, its neighbours and their cosines."""
        if not place.size or self.index is None:
            return self.share, np.zeros(0, np.int64), np.zeros(0)
        entries, cosines = self.index.nearest(place, weight, self.k)
        raw = vote(cosines, self.index.toxic[entries] / self.index.n[entries])
        return float(1 / (1 + np.exp(-(self.line[0] * _logit(raw) + self.line[1])))), entries, cosines

    def left_out(self, entry: int) -> list[tuple[float, int, int]]:
        """Votes on an entry's examples, each without itself: (vote, toxic examples, clean examples)."""
        index, out = self.index, []
        entries, cosines = index.nearest(*index.vector(entry), self.k + 1)
        n, toxic = int(index.n[entry]), int(index.toxic[entry])
        for label, size in ((1, toxic), (0, n - toxic)):
            shares, counts = index.toxic - label * (np.arange(index.n.size) == entry), index.n - (np.arange(index.n.size) == entry)
            own = entries[counts[entries] > 0][:self.k]
            if size and own.size:
                out.append((vote(cosines[counts[entries] > 0][:self.k], shares[own] / counts[own]), size * label, size * (1 - label)))
        return out


def _sample(docs: DataFrame, labels: DataFrame, held_out: Column, examples: int, label: str, id: str, text: str) -> DataFrame:
    """(doc_id, label, text) of the labelled rows that are learnt from, about ``examples`` of them; written once."""
    marks = (take(labels, doc_id=id, label=label).where("doc_id is not null and label is not null")
             .select(F.col("doc_id").cast("long").alias("doc_id"), F.col("label").cast("int").alias("label")).where(~held_out)
             .groupBy("doc_id").agg(F.max("label").alias("label")))
    known = marks.count()
    if known > examples:
        marks = marks.where(F.pmod(F.xxhash64("doc_id", F.lit("example")), F.lit(1 << 30)) < int((1 << 30) * examples / known))
    rows = take(docs, doc_id=id, text=text).select(F.col("doc_id").cast("long").alias("doc_id"), text_column().alias("text"))
    # the bound on the marks is the parameter: some 16 bytes for each of ``examples``
    return settled(rows.join(F.broadcast(marks), "doc_id"))


def _choose(sample: DataFrame, n: dict[int, int], most: int, least_texts: int, least_ratio: float) -> Terms:
    """The terms with the largest likelihood ratios among those more frequent in toxic texts."""
    schema = pa.schema([("term", pa.int64()), ("clean", pa.int64()), ("toxic", pa.int64())])

    def counts(batches):
        total = np.zeros(0, np.uint64), np.zeros((0, 2), np.int64)
        for batch in slices(batches, limit=4 << 20):
            found, home, _ = terms(batch.column("text").cast(pa.binary()).to_pylist())
            label = batch.column("label").to_numpy() == 1
            by = np.lexsort((home, found))
            found, home = found[by], home[by]
            once = np.append(True, (found[1:] != found[:-1]) | (home[1:] != home[:-1]))[:found.size]
            found, toxic = found[once], label[home[once]]
            keys, slot = np.unique(np.concatenate([total[0], found]), return_inverse=True)
            sums = np.zeros((keys.size, 2), np.int64)
            sums[slot[:total[0].size]] = total[1]
            for c, own in enumerate((~toxic, toxic)):
                sums[:, c] += np.bincount(slot[total[0].size:][own], minlength=keys.size)
            total = keys, sums
        yield record_batch(schema, [total[0].view(np.int64), total[1][:, 0], total[1][:, 1]])

    a, b = F.col("toxic").cast("double"), F.col("clean").cast("double")
    whole = float(n[0] + n[1])

    def part(seen: Column, expected: Column) -> Column:
        return F.when(seen > 0, seen * F.log(seen / expected)).otherwise(0.0)

    ratio = 2 * (part(a, (a + b) * n[1] / whole) + part(b, (a + b) * n[0] / whole)
                 + part(n[1] - a, (whole - a - b) * n[1] / whole) + part(n[0] - b, (whole - a - b) * n[0] / whole))
    rows = (sample.mapInArrow(counts, "term bigint, clean bigint, toxic bigint").groupBy("term")
            .agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
            .where((a >= least_texts) & (a * n[0] > b * n[1])).withColumn("ratio", F.round(ratio, 6)).where(F.col("ratio") >= least_ratio)
            .orderBy(F.desc("ratio"), "term").limit(most).collect())
    hashes = np.array([r["term"] for r in rows], np.int64).view(np.uint64)
    seen = np.array([r["toxic"] + r["clean"] for r in rows], float)
    by = np.argsort(hashes)
    return Terms(hashes[by], np.append(1.0, 1 + np.log((1 + whole) / (1 + seen[by]))))


def fit(sample: DataFrame, most_terms: int = 512, least_texts: int = 3, least_ratio: float = 20.0, k: int = 16) -> Model:
    """From rows (doc_id, label, text). The driver holds one sparse vector per example and one vote per entry."""
    n = {0: 0, 1: 0} | {r["one"]: r["n"] for r in sample.groupBy((F.col("label") == 1).cast("int").alias("one"))
                        .agg(F.count(F.lit(1)).alias("n")).collect()}
    share = n[1] / (n[0] + n[1]) if n[0] + n[1] else 0.5
    if not n[0] or not n[1]:
        return Model(share)
    chosen = _choose(sample, n, most_terms, least_texts, least_ratio)

    def vectors(batches):
        schema = pa.schema([("doc_id", pa.int64()), ("label", pa.int32()), ("place", pa.list_(pa.int64())), ("weight", pa.list_(pa.float64()))])
        for batch in slices(batches):
            place, weight = zip(*chosen.vectors(batch.column("text").cast(pa.binary()).to_pylist()), strict=True)
            yield record_batch(schema, [batch.column("doc_id"), batch.column("label"), list(place), list(weight)])

    rows = sample.mapInArrow(vectors, "doc_id bigint, label int, place array<bigint>, weight array<double>").collect()
    rows.sort(key=lambda r: (r["doc_id"], r["label"], r["place"], r["weight"]))
    index = Index.build([(np.array(r["place"], np.int64), np.array(r["weight"])) for r in rows],
                        np.array([r["label"] == 1 for r in rows], np.int64), np.array([r["doc_id"] for r in rows], np.int64), chosen.idf.size)
    if not index.n.size:
        return Model(share)
    model = Model(share, chosen, index, k)

    def votes(batches):
        schema = pa.schema([("vote", pa.float64()), ("toxic", pa.int64()), ("clean", pa.int64())])
        for batch in batches:
            found = [v for e in batch.column("id").to_pylist() for v in model.left_out(e)]
            yield record_batch(schema, [[v[i] for v in found] for i in range(3)])

    spark = sample.sparkSession
    seen = spark.range(0, index.n.size, 1, max(1, index.n.size // 500)).mapInArrow(votes, "vote double, toxic bigint, clean bigint").collect()
    seen.sort()
    line = calibrated(*(np.array([r[i] for r in seen], float) for i in range(3)))
    return Model(share, chosen, index, k, line)


def score_toxicity(docs: DataFrame, labels: DataFrame, held_out: Column | None = None, label: str = "toxic", threshold: float = 0.7,
                   id: str = "doc_id", text: str = "text", examples: int = 20000, evidence: int = 3) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted, neighbours, cosines. Held-out rows are not learnt from.

    ``held_out`` is a condition on doc_id; by default a third by its checksum.
    ``neighbours`` are the ids of the nearest examples (``evidence`` of them,
    the least id of those with equal vectors), ``cosines`` how near they are.
    """
    if held_out is None:
        held_out = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(3)) == 1, F.lit(False))
    model = fit(_sample(docs, labels, held_out, examples, label, id, text))
    schema = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("score", pa.float64()), ("predicted", pa.int32()),
                        ("neighbours", pa.list_(pa.int64())), ("cosines", pa.list_(pa.float64()))])

    def rows(batches):
        known: dict[tuple[bytes, bytes], tuple] = {}  # texts with equal vectors are searched once
        for batch in slices(batches):
            texts = batch.column("text").cast(pa.binary()).to_pylist()
            vectors = model.terms.vectors(texts) if model.terms else [(np.zeros(0, np.int64), np.zeros(0))] * len(texts)
            out = []
            for place, weight in vectors:
                key = place.tobytes(), weight.tobytes()
                if key not in known:
                    if len(known) >= 10000:
                        known.clear()
                    score, entries, cosines = model.score(place, weight)
                    near = model.index.example[entries[:evidence]].tolist() if entries.size else []
                    known[key] = score, near, cosines[:evidence].tolist()
                out.append(known[key])
            score = np.array([x[0] for x in out])
            yield record_batch(schema, [batch.column("doc_id"), batch.column("held_out"), score, (score >= threshold).astype(np.int32),
                                        [x[1] for x in out], [x[2] for x in out]])

    docs = take(docs, doc_id=id, text=text).select(F.col("doc_id").cast("long").alias("doc_id"), text_column().alias("text"))
    return docs.select("doc_id", held_out.alias("held_out"), "text").mapInArrow(
        rows, "doc_id bigint, held_out boolean, score double, predicted int, neighbours array<bigint>, cosines array<double>")
