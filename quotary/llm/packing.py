"""Best-fit packing by minimum bin slack.

Pieces of equal length are interchangeable, so bins are planned over counts by
length, of which there are at most as many as a sequence has tokens. For each
bin the longest available piece is set and a bitset subset-sum over the
available lengths finds the fullest feasible combination with it; that
combination is taken as often as the counts allow and removed. Pieces then
take their places by their rank among those of their length.

Ranks come from counts by (length, salt): no length, however frequent, is
ranked in one task.

Null text counts as an empty one: its document is the end token alone.
Repeated rows are packed each on its own. An empty table gives an empty
result; other columns are not looked at.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quotary.llm.common import record_batch, settled, slices, take, text_column
from quotary.llm.words import SPACE, hashed, spans

_PIECE = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()),
                    ("ids_crc32", pa.int64())])
_PIECE_DDL = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint"


def tokenizer_file(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


_APART, _LETTER, _DIGIT, _OTHER, _ODD = range(5)
_KIND = np.full(256, _ODD, np.uint8)
_KIND[0x21:0x7F] = _OTHER
_KIND[0x30:0x3A] = _DIGIT
_KIND[0x41:0x5B] = _KIND[0x61:0x7B] = _LETTER
_KIND[0x27] = _ODD  # contractions are the tokenizer's own business
_KIND[SPACE] = _APART
#: The character that byte-level models show for each byte: itself where it prints, else the next one from 256 on.
_PRINTS = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
_SHOWN = {b: chr(b) for b in _PRINTS} | {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in _PRINTS)}


@dataclass
class Pieces:
    """What the tokenizer's own rules cut texts into, where these rules are plain, and whole words where they are not."""

    buf: np.ndarray  # lower case, but for odd words
    starts: np.ndarray
    ends: np.ndarray
    odd: np.ndarray
    first: np.ndarray  # index of each text's first piece; one entry more than texts
    hashes: np.ndarray


def cut_pieces(texts: pa.Array) -> Pieces:
    """Runs of letters, single digits and runs of other characters of words in ASCII and Latin-1 letters.

    The tokenizer drops white space, no token reaches across it, and so a
    text's ids are those of its words. Words with other characters, with
    apostrophes or with what may be a special token are odd: they stay whole.
    """
    buf, word_starts, word_ends, begins = spans(texts, SPACE)
    after = np.append(buf[1:], np.uint8(0))
    kind = _KIND[buf]
    lead = (buf == 0xC3) & (after >= 0x80) & (after != 0x97) & (after != 0xB7)
    kind[lead] = _LETTER
    kind[1:][lead[:-1]] = _LETTER
    kind[(buf == 0x3C) & (after == 0x7C)] = _ODD
    low = buf + 0x20 * ((buf >= 0x41) & (buf <= 0x5A)).astype(np.uint8)
    capital = np.flatnonzero(lead & (after <= 0x9E)) + 1
    low[capital] += 0x20
    odd_before = np.concatenate([[0], np.cumsum(kind == _ODD)])
    odd_word = odd_before[word_ends] > odd_before[word_starts]
    edge = np.zeros(buf.size + 1, np.int8)
    edge[word_starts[odd_word]] = 1
    edge[word_ends[odd_word]] = -1
    whole = np.cumsum(edge[:-1], dtype=np.int8).astype(bool)
    kind[whole] = _ODD
    low = np.where(whole, buf, low)
    turn = np.diff(kind, prepend=_APART, append=_APART) != 0
    turn[:-1] |= kind == _DIGIT
    begin = turn[:-1] & (kind != _APART)
    starts = np.flatnonzero(begin)
    ends = np.flatnonzero(turn[1:] & (kind != _APART)) + 1
    odd = kind[starts] == _ODD
    hashes = hashed(low, starts, ends) ^ (odd.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return Pieces(low, starts, ends, odd, np.searchsorted(starts, begins), hashes)


class PieceEncoder:
    """Token ids of pieces, each worked out once and remembered up to a bound."""

    def __init__(self, path: str, most: int = 300_000):
        from tokenizers import Tokenizer

        self.tokenizer, self.most = Tokenizer.from_file(path), most
        self.model = self.tokenizer.model
        self.known: dict[bytes, tuple[int, ...]] = {}
        self.odd: dict[bytes, tuple[int, ...]] = {}

    def encode(self, pieces: list[bytes]) -> list[tuple[int, ...]]:
        if len(self.known) + len(self.odd) > self.most:
            self.known, self.odd = {}, {}
        known, tokenize, out = self.known, self.model.tokenize, []
        for p in pieces:
            ids = known.get(p)
            if ids is None:
                ids = known[p] = tuple([t.id for t in tokenize(p.decode("latin-1").translate(_SHOWN))])
            out.append(ids)
        return out

    def encode_odd(self, words: list[bytes]) -> list[tuple[int, ...]]:
        new = [w for w in words if w not in self.odd]
        got = self.tokenizer.encode_batch_fast([w.decode() for w in new], add_special_tokens=False)
        self.odd |= {w: tuple(e.ids) for w, e in zip(new, got, strict=True)}
        return [self.odd[w] for w in words]


def _ragged(lengths: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Indexes of runs that begin at ``at`` and have ``lengths`` entries, one run after the other."""
    before = np.cumsum(lengths) - lengths
    return np.repeat(at - before, lengths) + np.arange(lengths.sum())


def encode_pieces(docs: DataFrame, capacity: int = 4096, end: int = 1, path: str | None = None, id: str = "doc_id",
                  text: str = "text") -> DataFrame:
    """Pieces of at most ``capacity`` tokens: each document's ids and the end token, cut only where they are more."""
    def rows(batches):
        encoder = PieceEncoder(path or tokenizer_file())
        for batch in slices(batches, limit=2 << 20):
            cut = cut_pieces(batch.column("text"))
            _, where, which = np.unique(cut.hashes, return_index=True, return_inverse=True)
            raw, odd = cut.buf.tobytes(), cut.odd[where]
            place = np.empty(where.size, np.int64)  # plain pieces come first
            place[np.argsort(odd, kind="stable")] = np.arange(where.size)
            which = place[which]
            pieces = [[raw[a:b] for a, b in zip(cut.starts[w].tolist(), cut.ends[w].tolist(), strict=True)] for w in (where[~odd], where[odd])]
            ids = encoder.encode(pieces[0]) + encoder.encode_odd(pieces[1])
            length = np.fromiter(map(len, ids), np.int64, len(ids))
            flat = np.fromiter(chain.from_iterable(ids), np.uint32, length.sum())
            begin = np.cumsum(length) - length
            tokens = flat[_ragged(length[which], begin[which])].astype("<u4")
            after = np.concatenate([[0], np.cumsum(length[which])])
            out = []
            for doc_id, a, b in zip(batch.column("doc_id").to_pylist(), after[cut.first[:-1]], after[cut.first[1:]], strict=True):
                own = np.append(tokens[a:b], np.array([end], "<u4"))
                for k, i in enumerate(range(0, own.size, capacity)):
                    cut = own[i : i + capacity]
                    out.append((doc_id, k, i, cut.size, zlib.crc32(cut.tobytes())))
            yield record_batch(_PIECE, [list(c) for c in zip(*out, strict=True)])

    docs = take(docs, doc_id=id, text=text)
    return docs.select(F.col("doc_id").cast("long"), text_column()).toDF("doc_id", "text").mapInArrow(rows, _PIECE_DDL)


@dataclass(frozen=True)
class Pattern:
    """A combination of lengths and how many bins use it."""

    times: int
    parts: list[tuple[int, int]]  # (length, how many of it), longest first


def fullest(counts: dict[int, int], room: int) -> list[tuple[int, int]]:
    """The available lengths whose sum comes nearest to ``room`` from below: bounded subset sum on the bits of an integer."""
    mask, reach, steps = (1 << (room + 1)) - 1, 1, []
    for length in sorted((x for x in counts if x <= room and counts[x]), reverse=True):
        left, k = min(counts[length], room // length), 1
        while left:
            k = min(k, left)
            steps.append((length, k, reach))
            reach |= (reach << (length * k)) & mask
            left, k = left - k, 2 * k
        if reach >> room:
            break
    at = reach.bit_length() - 1
    chosen: dict[int, int] = {}
    for length, k, before in reversed(steps):
        if not before >> at & 1:  # this sum needs the step
            chosen[length] = chosen.get(length, 0) + k
            at -= length * k
    return sorted(chosen.items(), reverse=True)


def plan_bins(counts: dict[int, int], capacity: int) -> list[Pattern]:
    """Bins for all pieces; each pattern uses up at least one length as far as it can."""
    left, out = {n: c for n, c in counts.items() if c}, []
    while left:
        top = max(left)
        left[top] -= 1
        parts = dict(fullest(left, capacity - top))
        left[top] += 1
        parts[top] = parts.get(top, 0) + 1
        times = min(left[n] // k for n, k in parts.items())
        for n, k in parts.items():
            left[n] -= k * times
            if not left[n]:
                del left[n]
        out.append(Pattern(times, sorted(parts.items(), reverse=True)))
    return out


def _places(patterns: list[Pattern]) -> dict[int, np.ndarray]:
    """By length, rows of (first rank, first sequence, how many per sequence, offset): where the pieces of a length go."""
    used: dict[int, int] = {}
    rows: dict[int, list[tuple[int, int, int, int]]] = {}
    sequence = 0
    for p in patterns:
        offset = 0
        for length, k in p.parts:
            rows.setdefault(length, []).append((used.get(length, 0), sequence, k, offset))
            used[length] = used.get(length, 0) + k * p.times
            offset += length * k
        sequence += p.times
    return {length: np.array(r, np.int64) for length, r in rows.items()}


def pack(pieces: DataFrame, capacity: int = 4096, salt_rows: int = 20_000) -> DataFrame:
    """``pieces`` (a written table with a ``length``) with sequence_id and offset."""
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    places = _places(plan_bins(counts, capacity))
    spark = pieces.sparkSession
    sent = spark.sparkContext.broadcast(places)
    # frequent lengths get more salts; the list is as bounded as the counts
    salts = {n: -(-c // salt_rows) for n, c in counts.items() if c > salt_rows}
    many = F.lit(1)
    if salts:
        many = F.coalesce(F.create_map(*[F.lit(x) for pair in salts.items() for x in pair])[F.col("length")], F.lit(1))
    salted = pieces.withColumn("_salt", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), many))
    sizes = salted.groupBy("length", "_salt").agg(F.count(F.lit(1)).alias("_n"))
    ahead = Window.partitionBy("length").orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("length", "_salt", F.coalesce(F.sum("_n").over(ahead), F.lit(0)).alias("_ahead"))
    inside = Window.partitionBy("length", "_salt").orderBy("doc_id", "piece", "ids_crc32")
    ranked = (salted.join(offsets, ["length", "_salt"])
              .withColumn("_rank", F.row_number().over(inside) - 1 + F.col("_ahead")).drop("_salt", "_ahead"))
    names = [c for c in pieces.columns if c != "length"]

    def rows(batches):
        table = sent.value
        for batch in batches:
            length, rank = batch.column("length").to_numpy(), batch.column("_rank").to_numpy()
            sequence, offset = np.empty(length.size, np.int64), np.empty(length.size, np.int64)
            for n in np.unique(length).tolist():
                own = np.flatnonzero(length == n)
                p = table[n][np.searchsorted(table[n][:, 0], rank[own], side="right") - 1]
                step = rank[own] - p[:, 0]
                sequence[own], offset[own] = p[:, 1] + step // p[:, 2], p[:, 3] + step % p[:, 2] * n
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in [*names, "length"]], pa.array(sequence), pa.array(offset)],
                                             names=[*names, "length", "sequence_id", "offset"])

    kinds = dict(pieces.dtypes)
    ddl = ", ".join(f"`{c}` {kinds[c]}" for c in [*names, "length"]) + ", sequence_id bigint, offset bigint"
    return ranked.select(*names, "length", "_rank").mapInArrow(rows, ddl)


def pack_documents(docs: DataFrame, capacity: int = 4096, end: int = 1, path: str | None = None, id: str = "doc_id",
                   text: str = "text") -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    return pack(settled(encode_pieces(docs, capacity, end, path, id, text)), capacity)
