"""Fill-in-the-middle: a text is cut at unit ends and its parts are put in another order, with marks between.

Units end at one byte (a newline by default) or at the end of the text. The
ends are found with bits in a 64-bit word: the UTF-8 bytes of all texts of a
batch, each padded to whole words, are one array of uint64; arithmetic on
whole words marks the bytes that end a unit, `bitwise_count` counts the marks,
the running count is searched for the word that holds the k-th mark, and the
mark inside the word is reached by clearing lower ones.

Null text counts as an empty one, which stays plain, as do texts that hold a
mark themselves. The cuts depend on the id alone, so repeated rows are cut
alike; a null id counts as the empty string. Texts are cut whole, whatever
their length. An empty table gives an empty result; columns other than id and
text are not looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quotary.llm.common import record_batch, slices, take, text_column

_ONES = np.uint64(0x0101010101010101)
_HIGHS = np.uint64(0x8080808080808080)
_LOWS = np.uint64(0x7F7F7F7F7F7F7F7F)
_ONE = np.uint64(1)
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"


def marked(words: np.ndarray, byte: int) -> np.ndarray:
    """The highest bit of every byte that equals ``byte``; no sum carries from one byte into the next."""
    x = words ^ (_ONES * np.uint64(byte))
    return ~(((x & _LOWS) + _LOWS) | x) & _HIGHS


@dataclass
class Units:
    """The unit ends of many texts, as marks in words of eight bytes."""

    marks: np.ndarray
    before: np.ndarray  # marks before each word; one entry more than words
    tails: np.ndarray  # UTF-8 bytes that continue a code point, as marks
    tails_before: np.ndarray
    first: np.ndarray  # first word of each text; one entry more than texts

    @property
    def counts(self) -> np.ndarray:
        """Units of each text."""
        return np.diff(self.before[self.first])

    def ends(self, k: np.ndarray) -> np.ndarray:
        """Bytes of each text up to the end of its k-th unit; none for k = 0."""
        rank = self.before[self.first[:-1]] + k
        some = np.flatnonzero(k)
        out = np.zeros(k.size, np.int64)
        word = np.searchsorted(self.before, rank[some], side="left") - 1
        left = rank[some] - self.before[word]
        x = self.marks[word]
        for step in range(1, 8):
            x = np.where(left > step, x & (x - _ONE), x)
        lowest = x & (~x + _ONE)
        out[some] = (word - self.first[some]) * 8 + (np.bitwise_count(lowest - _ONE) >> 3) + 1
        return out

    def code_points(self, upto: np.ndarray) -> np.ndarray:
        """Code points in the first ``upto`` bytes of each text."""
        word = self.first[:-1] + upto // 8
        part = np.append(self.tails, np.uint64(0))[word] & ((_ONE << (upto % 8 * 8).astype(np.uint64)) - _ONE)
        return upto - (self.tails_before[word] - self.tails_before[self.first[:-1]]) - np.bitwise_count(part)


def units(texts: Sequence[bytes], end: int = 0x0A) -> Units:
    sizes = np.array([len(t) for t in texts], np.int64)
    first = np.zeros(sizes.size + 1, np.int64)
    np.cumsum((sizes + 7) // 8, out=first[1:])
    words = np.frombuffer(b"".join(t + bytes(-len(t) % 8) for t in texts), "<u8").astype(np.uint64)
    marks = marked(words, end)
    some = np.flatnonzero(sizes)
    last = sizes[some] - 1
    marks[first[some] + last // 8] |= np.uint64(0x80) << (last % 8 * 8).astype(np.uint64)
    tails = words & ~(words << _ONE) & _HIGHS

    def running(bits: np.ndarray) -> np.ndarray:
        out = np.zeros(bits.size + 1, np.int64)
        np.cumsum(np.bitwise_count(bits), out=out[1:])
        return out

    return Units(marks, running(marks), tails, running(tails), first)


def _numbers(seed: int, doc_id: int | None) -> list[int]:
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return [int(digest[i:i + 8], 16) for i in (0, 8, 16, 24)]


def fill_in_middle(docs: DataFrame, id: str = "doc_id", text: str = "text", seed: int = 7, percent: int = 100,
                   spm_percent: int = 50, end: str = "\n") -> DataFrame:
    """One row per document: doc_id, n (units), form, prefix_chars, middle_chars, output.

    Four numbers from a hash of the seed and the id choose the two cuts among
    the units, whether a text is cut at all (``percent``), and which order it
    takes (``spm_percent``): prefix, suffix, middle (psm) or suffix, prefix,
    middle (spm). Lengths are in code points, null where the text stays plain.
    ``end`` is the one-byte character that ends a unit.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("form", pa.string()), ("prefix_chars", pa.int64()),
                        ("middle_chars", pa.int64()), ("output", pa.binary())])
    p, s, m = (x.encode() for x in (PREFIX, SUFFIX, MIDDLE))
    closing = end.encode()
    if len(closing) != 1:
        raise ValueError("a unit ends at one byte")

    def rows(batches):
        for batch in slices(batches):
            texts = [x or b"" for x in batch.column("text").cast(pa.binary()).to_pylist()]
            found = units(texts, closing[0])
            n = found.counts
            h = np.array([_numbers(seed, d) for d in batch.column("doc_id").to_pylist()], np.int64).reshape(-1, 4)
            cuts = np.sort(h[:, :2] % (n + 1)[:, None], axis=1)
            plain = (n == 0) | (h[:, 2] % 100 >= percent) | np.array([p in t or s in t or m in t for t in texts], bool)
            spm = h[:, 3] % 100 < spm_percent
            a, b = found.ends(cuts[:, 0]), found.ends(cuts[:, 1])
            chars = found.code_points(a), found.code_points(b)
            out = [t if whole else b"".join((s, t[j:], p, t[:i], m, t[i:j]) if back else (p, t[:i], s, t[j:], m, t[i:j]))
                   for t, whole, back, i, j in zip(texts, plain.tolist(), spm.tolist(), a.tolist(), b.tolist(), strict=True)]
            form = np.where(plain, "plain", np.where(spm, "spm", "psm"))
            yield record_batch(schema, [batch.column("doc_id"), n, pa.array(form.tolist(), pa.string()),
                                        pa.array(chars[0], pa.int64(), mask=plain), pa.array(chars[1] - chars[0], pa.int64(), mask=plain), out])

    docs = take(docs, doc_id=id, text=text).select(F.col("doc_id").cast("long").alias("doc_id"), text_column().alias("text"))
    made = docs.mapInArrow(rows, "doc_id bigint, n bigint, form string, prefix_chars bigint, middle_chars bigint, output binary")
    return made.withColumn("output", F.col("output").cast("string"))


def restored(output: str = "output", form: str = "form") -> Column:
    """The text that an output was made of. No part holds a mark, so the first of each kind is the right one."""
    def parts(first: str, second: str) -> list[Column]:
        head = F.split(F.col(output), first, 2)
        rest = F.split(head[1], second, 2)
        tail = F.split(rest[1], MIDDLE, 2)
        return [rest[0], tail[0], tail[1]]

    prefix, suffix, middle = parts(PREFIX, SUFFIX)
    suffix_, prefix_, middle_ = parts(SUFFIX, PREFIX)
    return (F.when(F.col(form) == "psm", F.concat(prefix, middle, suffix))
            .when(F.col(form) == "spm", F.concat(prefix_, middle_, suffix_)).otherwise(F.col(output)))


def digests(made: DataFrame) -> DataFrame:
    """The rows of `fill_in_middle` with hashes in place of the output: of it, and of the text rebuilt from it."""
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars",
                       F.sha2(F.col("output").cast("binary"), 256).alias("output_sha256"),
                       F.sha2(restored().cast("binary"), 256).alias("restored_sha256"))


ORACLE_SQL = r"""
WITH docs AS (SELECT doc_id, coalesce(text, '') AS body, regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') AS u,
  sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
hashed AS (SELECT *, len(u) AS n, CAST('0x' || h[1:8] AS BIGINT) AS h1, CAST('0x' || h[9:16] AS BIGINT) AS h2,
  CAST('0x' || h[17:24] AS BIGINT) AS h3, CAST('0x' || h[25:32] AS BIGINT) AS h4 FROM docs),
cuts AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS i, greatest(h1 % (n + 1), h2 % (n + 1)) AS j,
  CASE WHEN body = '' OR contains(body, '<P>') OR contains(body, '<S>') OR contains(body, '<M>') OR h3 % 100 >= 100 THEN 'plain'
       WHEN h4 % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM hashed),
parts AS (SELECT *, array_to_string(u[1:i], '') AS p, array_to_string(u[i + 1:j], '') AS m, array_to_string(u[j + 1:], '') AS s FROM cuts)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
       sha256(CASE form WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m WHEN 'spm' THEN '<S>' || s || '<P>' || p || '<M>' || m
              ELSE body END) AS output_sha256, sha256(body) AS restored_sha256
FROM parts
"""
