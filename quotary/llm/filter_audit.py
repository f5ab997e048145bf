"""Interaction audit of filters: what each removes, in every order, and its Shapley value.

Each text fails some of five filters, A to E. One pass over the documents
counts them by part and by the set of filters that they fail; from those
counts, at most 32 a part, follow the number that any coalition of filters
removes, so no order is ever applied to a document. Step counts are differences
of coalitions. Shapley values are the exact solution of the least squares
problem that defines them: coalition values are fitted by a sum of one number
per filter, weighted by the Shapley kernel, under the constraint that the
numbers add up to what all filters remove. The normal equations are solved in
rationals.

Null text counts as an empty one, a null part as the empty string. Copies are
told by a hash of 256 bits of the whole text; of equal texts those with the
smallest id do not fail E, whatever the number of rows, and rows without an id
neither fail E nor make others fail. Repeated rows count each. A document with
several labels is good (toxic) if one of them says so. An empty table gives an
empty result; columns other than id, text, part and labels are not looked at.
"""

from __future__ import annotations

import hashlib
import re
from fractions import Fraction
from itertools import permutations
from math import comb, factorial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quotary.llm.common import record_batch, settled, slices, take, text_column

FILTERS = "ABCDE"
COPY = FILTERS.index("E")
_CAPITALS = bytes(range(0x41, 0x5B))
_TAILS = bytes(range(0x80, 0xC0))
_SYMBOLS = re.compile(rb"[#$%&*|]")


def failed(raw: bytes) -> int:
    """The filters A to D that a text fails, as bits. bytes.split() parts at the six separators of words."""
    words = raw.split()
    n = len(words)
    capitals = len(raw) - len(raw.translate(None, _CAPITALS))
    points = len(raw.translate(None, _TAILS))
    return ((n < 100) | (100 * len(set(words)) < 80 * n) << 1 | (100 * capitals > 10 * points) << 2
            | (_SYMBOLS.search(raw) is not None) << 3)


def judged(docs: DataFrame, id: str = "doc_id", text: str = "text", part: str = "lang") -> DataFrame:
    """(doc_id, part, print, mask): each document's failures in A to D and the hash of its text."""
    schema = pa.schema([("doc_id", pa.int64()), ("part", pa.string()), ("print", pa.binary()), ("mask", pa.int32())])

    def rows(batches):
        for batch in slices(batches):
            texts = [t or b"" for t in batch.column("text").cast(pa.binary()).to_pylist()]
            yield record_batch(schema, [batch.column("doc_id"), batch.column("part"),
                                        [hashlib.sha256(t).digest() for t in texts], [failed(t) for t in texts]])

    docs = take(docs, doc_id=id, text=text, part=part)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("part").cast("string"), F.lit("")).alias("part"),
                       text_column().alias("text")).mapInArrow(rows, "doc_id bigint, part string, print binary, mask int")


def _flags(labels: DataFrame, id: str, quality: str, toxic: str) -> DataFrame:
    marks = take(labels, doc_id=id, quality=quality, toxic=toxic).where("doc_id is not null")
    flag = lambda c: F.max((F.col(c) == 1).cast("int"))
    return marks.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(flag("quality").alias("good"), flag("toxic").alias("toxic"))


def tabulated(docs: DataFrame, labels: DataFrame, id: str = "doc_id", text: str = "text", part: str = "lang",
              quality: str = "quality", toxic: str = "toxic") -> DataFrame:
    """(part, mask, n, good, toxic): documents by the exact set of filters that they fail.

    No text is shuffled. Equal rows are counted before the labels join, and
    copies are counted by (text, part) with the count at the least id beside
    the sum, so a text that a third of all rows hold is one row per task; what
    meets in one window is a text's parts. Rows without an id skip the labels.
    """
    rows = judged(docs, id, text, part)
    same = settled(rows.groupBy("doc_id", "part", "print", "mask").agg(F.count(F.lit(1)).alias("n")))
    known = same.where("doc_id is not null").join(_flags(labels, id, quality, toxic), "doc_id", "left")
    counted = known.select("doc_id", "part", "print", "mask", "n", *[
        (F.col("n") * F.coalesce(F.col(c), F.lit(0))).alias(c) for c in ("good", "toxic")])
    sums = [F.sum(c).alias(c) for c in ("n", "good", "toxic")]
    texts = counted.groupBy("print", "part", "mask").agg(F.min(F.struct("doc_id", "n", "good", "toxic")).alias("least"), *sums)
    first = F.col("least.doc_id") == F.min("least.doc_id").over(Window.partitionBy("print"))
    own = texts.withColumn("first", first)
    fails = F.lit(1 << COPY)

    def kept(c: str):  # rows of the least id
        return F.when(F.col("first"), F.col(f"least.{c}")).otherwise(0)

    split = own.select("part", F.explode(F.array(
        F.struct(F.col("mask"), *[kept(c).alias(c) for c in ("n", "good", "toxic")]),
        F.struct((F.col("mask") + fails).alias("mask"), *[(F.col(c) - kept(c)).alias(c) for c in ("n", "good", "toxic")]))).alias("s"))
    without = same.where("doc_id is null").select("part", "mask", "n", F.lit(0).cast("long").alias("good"), F.lit(0).cast("long").alias("toxic"))
    return split.select("part", "s.*").unionByName(without).groupBy("part", "mask").agg(*sums)


def coalition_removals(counts: np.ndarray) -> np.ndarray:
    """Documents that fail a filter of each coalition, from the counts by exact set of failures."""
    sets = np.arange(counts.size)
    return np.array([counts[(sets & s) != 0].sum() for s in sets])


def shapley(values: np.ndarray, n: int = len(FILTERS)) -> list[Fraction]:
    """Shapley values from the values of all coalitions (the empty one has none), by constrained least squares.

    With the kernel's weights w(S) = (n - 1) / (C(n, |S|) |S| (n - |S|)) over
    proper coalitions, the numbers f minimise the sum of w(S) (v(S) - sum of f
    over S)^2 where all of f add up to v of the whole. The normal equations
    with the multiplier of the constraint are solved by elimination.
    """
    whole = (1 << n) - 1
    left = [[Fraction(0)] * (n + 1) for _ in range(n + 1)]
    right = [Fraction(0)] * (n + 1)
    for s in range(1, whole):
        members = [i for i in range(n) if s >> i & 1]
        w = Fraction(n - 1, comb(n, len(members)) * len(members) * (n - len(members)))
        for i in members:
            right[i] += w * int(values[s])
            for j in members:
                left[i][j] += w
    for i in range(n):
        left[i][n] = left[n][i] = Fraction(1)
    right[n] = Fraction(int(values[whole]))
    for i in range(n + 1):
        pivot = next(r for r in range(i, n + 1) if left[r][i])
        left[i], left[pivot], right[i], right[pivot] = left[pivot], left[i], right[pivot], right[i]
        for r in range(n + 1):
            if r != i and left[r][i]:
                ratio = left[r][i] / left[i][i]
                left[r] = [x - ratio * y for x, y in zip(left[r], left[i], strict=True)]
                right[r] -= ratio * right[i]
    return [right[i] / left[i][i] for i in range(n)]


_COLUMNS = ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
_SCHEMA = "part string, filter_order string, step int, " + ", ".join(f"{c} bigint" for c in _COLUMNS[3:])


def steps(part: str, counts: np.ndarray) -> list[list]:
    """The rows of one part, for every order of the filters; ``counts`` has one row of (n, good, toxic) per set of failures."""
    n = len(FILTERS)
    total = counts[:, 0].sum()
    all_removed, good, toxic = (coalition_removals(counts[:, c]) for c in range(3))
    fair = [f * factorial(n) for f in shapley(all_removed)]
    whole, rows = (1 << n) - 1, []
    for order in permutations(range(n)):
        name, before = "".join(FILTERS[i] for i in order), 0
        for step, i in enumerate(order, 1):
            after = before | 1 << i
            removed = all_removed[after] - all_removed[before]
            rows.append([part, name, step, total - all_removed[after], removed, all_removed[1 << i] - removed,
                         all_removed[whole] - all_removed[whole ^ 1 << i], good[after] - good[before], toxic[after] - toxic[before],
                         int(fair[i])])
            before = after
    return rows


def audit(docs: DataFrame, labels: DataFrame, **names: str) -> DataFrame:
    """One row per part, order of the filters and step; see `steps`. ``names`` are column names, as for `tabulated`."""
    schema = pa.schema([(c, pa.string() if c in ("part", "filter_order") else pa.int32() if c == "step" else pa.int64()) for c in _COLUMNS])

    def rows(group: pa.Table) -> pa.Table:
        counts = np.zeros((1 << len(FILTERS), 3), np.int64)
        counts[group.column("mask").to_numpy()] = np.column_stack([group.column(c).to_numpy() for c in ("n", "good", "toxic")])
        made = steps(group.column("part")[0].as_py(), counts)
        return pa.Table.from_batches([record_batch(schema, [[x if isinstance(x, str) else int(x) for x in c] for c in zip(*made, strict=True)])])

    return tabulated(docs, labels, **names).groupBy("part").applyInArrow(rows, _SCHEMA)


ORACLE_SQL = r"""
WITH docs AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS body FROM documents),
words AS (SELECT *, regexp_extract_all(body, '[^\x20\x09-\x0D]+') AS ws, min(doc_id) OVER (PARTITION BY body) AS least FROM docs),
failed AS (SELECT doc_id, part, [len(ws) < 100, 100 * len(list_distinct(ws)) < 80 * len(ws),
  100 * (length(body) - length(regexp_replace(body, '[A-Z]', '', 'g'))) > 10 * length(body), regexp_matches(body, '[#$%&*|]'),
  coalesce(least < doc_id, false)] AS f FROM words),
flags AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
sets AS (SELECT part, f, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic
  FROM failed LEFT JOIN flags USING (doc_id) GROUP BY part, f),
letters AS (SELECT * FROM (VALUES (1, 'A'), (2, 'B'), (3, 'C'), (4, 'D'), (5, 'E')) v(i, c)),
orders AS (SELECT [a.i, b.i, c.i, d.i, e.i] AS o, a.c || b.c || c.c || d.c || e.c AS filter_order
  FROM letters a, letters b, letters c, letters d, letters e WHERE len(list_distinct([a.i, b.i, c.i, d.i, e.i])) = 5),
steps AS (SELECT filter_order, o, unnest(range(1, 6)) AS step FROM orders),
marked AS (SELECT part, filter_order, CAST(step AS INTEGER) AS step, o[step] AS i, n, good, toxic, f[o[step]] AS fails,
  list_bool_or([false] || list_transform(o[1:step - 1], lambda x: f[x])) AS gone,
  list_bool_or(list_transform(list_filter([1, 2, 3, 4, 5], lambda x: x <> o[step]), lambda x: f[x])) AS other FROM sets, steps),
counted AS (SELECT part, filter_order, step, i, sum(CASE WHEN NOT gone AND NOT fails THEN n ELSE 0 END) AS kept,
  sum(CASE WHEN NOT gone AND fails THEN n ELSE 0 END) AS removed, sum(CASE WHEN gone AND fails THEN n ELSE 0 END) AS redundant,
  sum(CASE WHEN fails AND NOT other THEN n ELSE 0 END) AS unique_fails, sum(CASE WHEN NOT gone AND fails THEN good ELSE 0 END) AS good_lost,
  sum(CASE WHEN NOT gone AND fails THEN toxic ELSE 0 END) AS toxic_lost FROM marked GROUP BY part, filter_order, step, i)
SELECT part, filter_order, step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant,
  CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost,
  CAST(sum(removed) OVER (PARTITION BY part, i) AS BIGINT) AS shapley FROM counted
"""
