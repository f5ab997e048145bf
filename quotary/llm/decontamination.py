"""Benchmark decontamination with a positional inverted index.

The index is a table: a row holds the postings of one block of documents, that
is the sorted terms, where each term's list begins and the positions in it,
and which words are whose. A query phrase starts from its rarest term's list in
the block and is intersected with the lists of its other terms, shifted by
their distance, from the next rarest on.

A proximity match is an item of which enough distinct terms stand in one run of
words of a document without making a phrase: a share of them, all of them for a
short item, in a run of twice the item's words or of the item's words and a
stated number more, whichever is less. Terms are ranked by how many documents
of the whole corpus have them; a document with enough terms has some of the
rarest, so only those lists are opened for every item and what they leave is
counted exactly. Which documents share a block does not matter.

The queries are the benchmark, in chunks of bounded size, each against all
blocks; a chunk is all that goes to every task. No document is shuffled.

Null text has no words. Items without words match nothing; repeated items
count as one id. An item without an id has no name to report, but its windows
are hits like any other's. Repeated documents are each judged.
An empty table gives an empty result; other columns are not looked at.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quotary.llm.common import LARGE_ROWS, as_rows, each_row, record_batch, settled, slices, take, text_print
from quotary.llm.words import MARKS, scan

_BLOCK = pa.schema([("doc_ids", pa.list_(pa.int64())), ("prints", pa.list_(pa.int64())), ("first", pa.binary()), ("terms", pa.binary()),
                    ("begins", pa.binary()), ("positions", pa.binary())])
_BLOCK_DDL = "doc_ids array<bigint>, prints array<bigint>, first binary, terms binary, begins binary, positions binary"
_HIT = pa.schema([("doc_id", pa.int64()), ("print", pa.int64()), ("block", pa.int64()), ("place", pa.int32()), ("n_words", pa.int64()),
                  ("starts", pa.list_(pa.int32())), ("lengths", pa.list_(pa.int32())),
                  ("items", pa.list_(pa.string())), ("near", pa.list_(pa.string()))])
_HIT_DDL = ("doc_id bigint, print bigint, block bigint, place int, n_words bigint, starts array<int>, lengths array<int>, "
            "items array<string>, near array<string>")


def build_index(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """The index table, one row per block of about 1 MB of text; a document is in one block as a whole."""
    def rows(batches):
        for batch in slices(batches):
            words = scan(batch.column("text"), MARKS, lower=True)
            order = np.argsort(words.hashes, kind="stable").astype(np.uint32)
            terms, begins = np.unique(words.hashes[order], return_index=True)
            yield record_batch(_BLOCK, [[batch.column("doc_id").to_pylist()], [batch.column("print").to_pylist()],
                                        [words.first.astype(np.uint32).tobytes()],
                                        [terms.tobytes()], [np.append(begins, order.size).astype(np.uint32).tobytes()],
                                        [order.tobytes()]])

    docs = take(docs, doc_id=id, text=text)
    return settled(docs.select(F.col("doc_id").cast("long"), text_print().alias("print"), F.col("text").cast("string"))
                   .mapInArrow(rows, _BLOCK_DDL).withColumn("block", F.monotonically_increasing_id()), **LARGE_ROWS)


@dataclass
class Phrases:
    """Query phrases of one chunk of items: one array of words, and where each phrase begins in it."""

    items: list[str | None]  # of each text; null for an item without an id
    hashes: np.ndarray
    starts: np.ndarray
    lengths: np.ndarray
    text: np.ndarray  # of each phrase
    first: np.ndarray  # first word of each text; one entry more than texts

    def some(self, length: int, most: int = 1 << 17):
        """(numbers, terms) of the phrases of one length, a bounded number of them at a time."""
        own = np.flatnonzero(self.lengths == length)
        for part in np.split(own, range(most, own.size, most)):
            yield part, self.hashes[self.starts[part][:, None] + np.arange(length)]

    def texts(self) -> list[tuple[str | None, np.ndarray, int]]:
        """Item, distinct terms and number of words of each text that has words."""
        spans = zip(self.items, self.first[:-1].tolist(), self.first[1:].tolist(), strict=True)
        return [(item, np.unique(self.hashes[a:b]), b - a) for item, a, b in spans if b > a]


def phrases(items: list[tuple[str | None, str | None]], window: int) -> Phrases:
    """Every window of ``window`` words of each item; an item of fewer words is one phrase."""
    words = scan([(t or "").encode() for _, t in items], MARKS, lower=True)
    size = np.diff(words.first)
    n = np.maximum(size - window + 1, np.minimum(size, 1))
    text = np.repeat(np.arange(size.size), n)
    starts = words.first[:-1][text] + _count_up(n)
    return Phrases([i for i, _ in items], words.hashes, starts, np.minimum(size, window)[text], text, words.first)


class _Block:
    def __init__(self, row: dict):
        self.doc_ids = row["doc_ids"]
        self.first = np.frombuffer(row["first"], np.uint32).astype(np.int64)
        self.terms = np.frombuffer(row["terms"], np.uint64)
        self.begins = np.frombuffer(row["begins"], np.uint32).astype(np.int64)
        self.positions = np.frombuffer(row["positions"], np.uint32).astype(np.int64)
        # one sorted key per posting: list number and position, so that a shifted list is looked up at once
        number = np.repeat(np.arange(self.terms.size), np.diff(self.begins))
        self.keys = number * (1 << 32) + self.positions

    def lists(self, terms: np.ndarray) -> np.ndarray:
        """Number of each term's list, -1 where the block lacks the term."""
        if not self.terms.size:
            return np.full(terms.shape, -1)
        at = np.minimum(np.searchsorted(self.terms, terms), self.terms.size - 1)
        return np.where(self.terms[at] == terms, at, -1)

    def document(self, positions: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.first, positions, side="right") - 1

    def phrases(self, terms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(phrase, start) of every occurrence of phrases of one length, given as rows of terms."""
        lists = self.lists(terms)
        alive = np.flatnonzero((lists >= 0).all(axis=1))
        lists = lists[alive]
        sizes = np.diff(self.begins)[lists]
        order = np.argsort(sizes, axis=1, kind="stable")  # rarest first
        rows = np.arange(alive.size)
        rarest = order[:, 0]
        n = sizes[rows, rarest]
        phrase = np.repeat(rows, n)
        within = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        start = self.positions[self.begins[lists[rows, rarest]][phrase] + within] - rarest[phrase]
        for k in range(1, terms.shape[1]):
            if not start.size:
                break
            term = order[phrase, k]
            wanted = lists[phrase, term] * (1 << 32) + start + term
            at = np.minimum(np.searchsorted(self.keys, wanted), self.keys.size - 1)
            found = (self.keys[at] == wanted) & (start >= 0)
            phrase, start = phrase[found], start[found]
        inside = start >= 0
        phrase, start = phrase[inside], start[inside]
        whole = self.document(start) == self.document(start + terms.shape[1] - 1)
        return alive[phrase[whole]], start[whole]

    def documents_with(self, lists: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(index into ``lists``, document) of every document of each list, once."""
        n = np.where(lists < 0, 0, np.diff(self.begins)[lists]) if self.terms.size else lists * 0
        which = np.repeat(np.arange(lists.size), n)
        home = self.document(self.positions[np.repeat(self.begins[lists], n) + _count_up(n)]) if which.size else which
        pair = np.unique(which * len(self.doc_ids) + home)
        return pair // max(len(self.doc_ids), 1), pair % max(len(self.doc_ids), 1)

    def near(self, asked: Near, most: int = 1 << 21) -> tuple[np.ndarray, np.ndarray]:
        """(text, document) of every proximity match; about ``most`` places are held at a time."""
        lists = self.lists(asked.vocabulary)
        term, home = self.documents_with(np.where(asked.opens[1:] > asked.opens[:-1], lists, -1))
        n = np.diff(asked.opens)[term]
        text = asked.opened[np.repeat(asked.opens[term], n) + _count_up(n)]
        pair, hits = np.unique(text * len(self.doc_ids) + np.repeat(home, n), return_counts=True)
        text, home = pair // max(len(self.doc_ids), 1), pair % max(len(self.doc_ids), 1)
        enough = hits >= asked.first_hits[text]
        text, home = text[enough], home[enough]
        found = [np.zeros((2, 0), np.int64)]
        cuts = np.flatnonzero(np.diff(np.cumsum(np.diff(asked.first)[text]) // most)) + 1
        for text, home in zip(np.split(text, cuts), np.split(home, cuts), strict=True):
            n = np.diff(asked.first)[text]
            pair = np.repeat(np.arange(text.size), n)
            number = lists[asked.terms[np.repeat(asked.first[text], n) + _count_up(n)]]
            low, high = (np.searchsorted(self.keys, number * (1 << 32) + self.first[home[pair] + k]) for k in (0, 1))
            has = (number >= 0) & (high > low)
            good = np.bincount(pair[has], minlength=text.size) >= asked.needed[text]
            has &= good[pair]
            places = np.cumsum(np.bincount(pair[has], (high - low)[has], minlength=text.size)).astype(np.int64)
            last = np.searchsorted(pair[has], np.arange(text.size + 1))
            pair, number, low, high = (x[has] for x in (pair, number, low, high))
            begin = 0
            while begin < text.size:  # whole pairs, so many that their places fit
                done = places[begin - 1] if begin else 0
                end = max(int(np.searchsorted(places, done + most, side="right")), begin + 1)
                rows = slice(last[begin], last[end])
                match = _dense(self.positions, pair[rows], low[rows], high[rows], asked.span[text], asked.needed[text])
                found.append(np.stack([text[match], home[match]]))
                begin = end
        return tuple(np.concatenate(found, axis=1))


def _count_up(n: np.ndarray) -> np.ndarray:
    """0, 1, ... for each of ``n``."""
    return np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)


def _dense(positions: np.ndarray, pair: np.ndarray, low: np.ndarray, high: np.ndarray, span: np.ndarray, needed: np.ndarray) -> np.ndarray:
    """The pairs that have ``needed`` distinct terms in a run of ``span`` words; row i is one term of a pair, with its places."""
    n = high - low
    row = np.repeat(np.arange(n.size), n)
    at = positions[low[row] + _count_up(n)]
    order = np.lexsort((at, pair[row]))
    row, at = row[order], at[order]
    owner = pair[row]
    key = owner * (1 << 32) + at
    # a place counts for every run that starts after the last place of its term and reaches it
    by_term = np.argsort(row, kind="stable")
    before = np.full(row.size, -1)
    same = row[by_term[1:]] == row[by_term[:-1]]
    before[by_term[1:][same]] = by_term[:-1][same]
    begin = np.maximum(before + 1, np.searchsorted(key, np.maximum(key - span[owner] + 1, owner * (1 << 32))))
    edge = np.zeros(row.size + 1, np.int64)
    np.add.at(edge, begin, 1)
    edge[1:] -= 1
    return np.unique(owner[np.cumsum(edge[:-1]) >= needed[owner]])


@dataclass
class Near:
    """The texts of a chunk of items as numbers of terms, rarest in the corpus first, and which of them open each term's list."""

    items: list[str | None]
    vocabulary: np.ndarray
    first: np.ndarray  # where each text's terms begin
    terms: np.ndarray
    needed: np.ndarray  # terms that a run must have
    span: np.ndarray  # words of a run
    first_hits: np.ndarray  # how many of the opening terms a document with enough terms has at least
    opens: np.ndarray  # where the texts of each term begin
    opened: np.ndarray


def document_frequencies(index: DataFrame, vocabulary: np.ndarray) -> np.ndarray:
    """How many documents of the corpus have each term."""
    schema = pa.schema([("term", pa.int32()), ("n", pa.int64())])
    sent = index.sparkSession.sparkContext.broadcast(vocabulary)

    def rows(batches):
        total = np.zeros(sent.value.size, np.int64)
        for row in each_row(batches):
            block = _Block(row)
            total += np.bincount(block.documents_with(block.lists(sent.value))[0], minlength=total.size)
        some = np.flatnonzero(total)
        yield record_batch(schema, [some.astype(np.int32), total[some]])

    out = np.zeros(vocabulary.size, np.int64)
    for r in index.mapInArrow(rows, "term int, n bigint").groupBy("term").agg(F.sum("n").alias("n")).collect():
        out[r["term"]] = r["n"]
    return out


def near_texts(index: DataFrame, texts: list[tuple[str | None, np.ndarray, int]], near_terms: int, reach: int, share: float) -> Near:
    vocabulary = np.unique(np.concatenate([np.zeros(0, np.uint64), *[t for _, t, _ in texts]]))
    rank = np.empty(vocabulary.size, np.int64)
    by_rank = np.lexsort((vocabulary, document_frequencies(index, vocabulary)))
    rank[by_rank] = np.arange(vocabulary.size)
    terms = [by_rank[np.sort(rank[np.searchsorted(vocabulary, t)])] for _, t, _ in texts]
    size = np.array([t.size for t in terms], np.int64)
    words = np.array([n for _, _, n in texts], np.int64)
    needed = np.maximum(np.ceil(share * size - 1e-9).astype(np.int64), np.minimum(size, near_terms))
    first_hits = np.minimum(needed, 3)
    opening = [t[: m - k + h] for t, m, k, h in zip(terms, size, needed, first_hits, strict=True)]
    term = np.concatenate([np.zeros(0, np.int64), *opening])
    text = np.repeat(np.arange(size.size), [t.size for t in opening])
    order = np.argsort(term, kind="stable")
    return Near([item for item, _, _ in texts], vocabulary, np.concatenate([[0], np.cumsum(size)]).astype(np.int64),
                np.concatenate([np.zeros(0, np.int64), *terms]), needed, np.minimum(2 * words, words + reach), first_hits,
                np.searchsorted(term[order], np.arange(vocabulary.size + 1)), text[order])


def search(index: DataFrame, benchmark: DataFrame, window: int = 10, near_terms: int = 6, reach: int = 15,
           chunk_bytes: int = 16 << 20, id: str = "item_id", text: str = "text", share: float = 0.7, near: bool = True) -> DataFrame:
    """One row per document and chunk: the phrase occurrences (starts, lengths, items) and the near items.

    A near item has ``share`` of its distinct terms, ``near_terms`` at least or all of them, in a run of words that is
    twice as long as the item, or ``reach`` words longer. Without ``near`` they are not looked for.

    A benchmark beyond ``chunk_bytes`` of text is asked in several chunks,
    cut by a hash of the row, each read in its turn.
    """
    items = take(benchmark, item_id=id, text=text).select(
        F.col("item_id").cast("string"), F.col("text").cast("string"))
    size = items.agg(F.sum(F.octet_length("text"))).collect()[0][0] or 0
    chunks = -(-size // chunk_bytes) or 1
    context, out = index.sparkSession.sparkContext, None
    for chunk in range(chunks):
        part = items if chunks == 1 else items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(chunks)) == chunk)
        asked = phrases([tuple(r) for r in part.collect()], window)
        close = near_texts(index, asked.texts(), near_terms, reach, share) if near else None
        sent = context.broadcast((vars(asked), close and vars(close)))

        def rows(batches, sent=sent):
            asked, close = Phrases(**sent.value[0]), sent.value[1] and Near(**sent.value[1])
            lengths = np.unique(asked.lengths).tolist()
            for row in each_row(batches):
                block = _Block(row)
                found = [(np.zeros(0, int),) * 3]
                for n in lengths:
                    for numbers, terms in asked.some(n):
                        phrase, start = block.phrases(terms)
                        found.append((numbers[phrase], start, np.full(start.size, n)))
                phrase, start, n = (np.concatenate(x).astype(np.int64) for x in zip(*found, strict=True))
                home = block.document(start)
                beside: dict[int, list[str]] = {}
                for text, d in zip(*(x.tolist() for x in block.near(close)), strict=True) if close else ():
                    if close.items[text] is not None:
                        beside.setdefault(d, []).append(close.items[text])
                out = []
                order = np.argsort(home, kind="stable") if start.size else np.zeros(0, int)
                edges = np.searchsorted(home[order], np.arange(len(block.doc_ids) + 1)) if start.size else np.zeros(len(block.doc_ids) + 1, int)
                for d, doc_id in enumerate(block.doc_ids):
                    mine = order[edges[d]:edges[d + 1]]
                    hit = sorted({asked.items[t] for t in asked.text[phrase[mine]].tolist()} - {None})
                    # phrases that stand in several items occur once
                    place = np.unique(np.stack([start[mine] - block.first[d], n[mine]]), axis=1)
                    out.append((doc_id, row["prints"][d], row["block"], d, block.first[d + 1] - block.first[d],
                                place[0].tolist(), place[1].tolist(), hit, sorted(set(beside.get(d, [])) - set(hit))))
                yield record_batch(_HIT, [list(c) for c in zip(*out, strict=True)])

        found = index.mapInArrow(rows, _HIT_DDL)
        out = found if out is None else out.unionByName(found)
    if chunks == 1:
        return out
    flat = {c: F.flatten(F.collect_list(c)).alias(c) for c in ("starts", "lengths", "items", "near")}
    return out.groupBy("block", "place").agg(
        F.first("doc_id").alias("doc_id"), F.first("print").alias("print"), F.first("n_words").alias("n_words"), *flat.values())


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = 10, id: str = "doc_id", text: str = "text",
                  chunk_bytes: int = 16 << 20, near: bool = True) -> DataFrame:
    """One row per document: id, n_words, n_hit, n_items, items_sha256, contaminated, n_near_items and near_items."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_hit", pa.int64()), ("n_items", pa.int64()),
                        ("items_sha256", pa.string()), ("contaminated", pa.bool_()), ("n_near_items", pa.int64()),
                        ("near_items", pa.list_(pa.string()))])

    def rows(batches):
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                edge = np.zeros(r["n_words"] + 1, np.int64)
                np.add.at(edge, np.array(r["starts"], int), 1)
                np.add.at(edge, np.array(r["starts"], int) + np.array(r["lengths"], int), -1)
                hit = int(np.count_nonzero(np.cumsum(edge[:-1])))
                items = sorted(set(r["items"]))
                beside = sorted(set(r["near"]) - set(items))
                out.append((r["doc_id"], r["n_words"], hit, len(items), hashlib.sha256(",".join(items).encode()).hexdigest(),
                            hit > 0, len(beside), beside))
            yield record_batch(schema, [list(c) for c in zip(*out, strict=True)] if out else [[] for _ in schema])

    hits = search(build_index(docs, id, text), benchmark, window, chunk_bytes=chunk_bytes, near=near)
    return hits.mapInArrow(rows, "doc_id bigint, n_words bigint, n_hit bigint, n_items bigint, items_sha256 string, "
                                 "contaminated boolean, n_near_items bigint, near_items array<string>")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, window: int = 10, id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` without a window of a benchmark item under their id in any row, with its columns.

    One contaminated row takes all rows of its id, or all without one; ``drop_contaminated_rows`` judges each row.
    """
    bad = contamination(docs, benchmark, window, id, text, near=False).where("contaminated").select("doc_id").distinct()
    return as_rows(docs, id=F.col(f"`{id}`").cast("long")).join(bad, F.col("id").eqNullSafe(F.col("doc_id")), "left_anti").select("row.*")


def drop_contaminated_rows(docs: DataFrame, benchmark: DataFrame, window: int = 10, id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` in which no window of a benchmark item occurs, with its columns; ids may repeat or be null.

    A row's key is its id and a hash of its text. Rows of one key have one verdict, so that ties need no number.
    """
    bad = search(build_index(docs, id, text), benchmark, window, near=False).where("size(starts) > 0").select("doc_id", "print").distinct()
    keyed = as_rows(docs, id=F.col(f"`{id}`").cast("long"), own=text_print(text))
    return keyed.join(bad, F.col("id").eqNullSafe(F.col("doc_id")) & (F.col("own") == F.col("print")), "left_anti").select("row.*")
