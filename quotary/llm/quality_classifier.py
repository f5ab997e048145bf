"""Quality by regularised quadratic discriminant analysis.

Each document becomes a vector of log-transformed statistics. Per class a mean
and a covariance, shrunk towards the pooled one and towards its diagonal, are
fitted from sums that Spark aggregates over all labelled training rows. The
score is the logistic of the difference of the classes' log densities, that is
of Mahalanobis distances taken through Cholesky factors that are computed once.

Null or empty text has the statistics of no words and is scored like any
other. Repeated rows are scored alike; a document with several labels counts
with each, one with a null label with none. Without labels of both classes the
score is the share of label 1, or a half. An empty table gives an empty
result; columns other than id and text are not looked at.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quotary.llm.common import record_batch, settled, slices, take, text_column
from quotary.llm.words import SPACE, scan

STATISTICS = ("word_bytes", "capitals", "symbols", "bangs", "digits", "punctuation", "bars", "doubled_words", "repeated_lines")
_CLASSES = {"capitals": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", "small": b"abcdefghijklmnopqrstuvwxyz", "digits": b"0123456789",
            "symbols": b"#*$%&<>^~", "bangs": b"!", "bars": b"|", "punctuation": b".,;:?"}


def _log_share(part: np.ndarray, whole: np.ndarray, weight: float, floor: float = 0.01) -> np.ndarray:
    """Log of a share above a floor: none is the same at every length, and a few in a short text are not many."""
    return np.log(part / (whole + weight) + floor)


def statistics(texts: list[bytes]) -> np.ndarray:
    """One row of transformed statistics per text."""
    words = scan(texts, SPACE)
    n_texts, home = len(texts), words.texts
    number = np.zeros(256, np.int64)
    for i, chars in enumerate(_CLASSES.values()):
        number[list(chars)] = i + 1
    sizes = np.array([len(x) + 1 for x in texts])
    text_of = np.repeat(np.arange(n_texts), sizes)[: words.buf.size]
    kinds = len(_CLASSES) + 1
    counts = np.bincount(text_of * kinds + number[words.buf], minlength=n_texts * kinds).reshape(n_texts, kinds)
    of = {name: counts[:, i + 1] for i, name in enumerate(_CLASSES)}
    n = np.diff(words.first)
    word_bytes = np.bincount(home, words.ends - words.starts, n_texts)
    same = (words.hashes[1:] == words.hashes[:-1]) & (home[1:] == home[:-1])
    doubled = np.bincount(home[1:][same], minlength=n_texts)
    lines = [[x for x in t.split(b"\n") if x.strip()] for t in texts]
    n_lines = np.array([len(x) for x in lines])
    letters = of["capitals"] + of["small"]
    return np.column_stack([
        np.log((word_bytes + 60) / (n + 10.0)), _log_share(of["capitals"], letters, 20),
        _log_share(of["symbols"], n, 10), _log_share(of["bangs"], n, 10), _log_share(of["digits"], word_bytes, 50),
        _log_share(of["punctuation"], n, 10), _log_share(of["bars"], n, 10), _log_share(doubled, n, 30),
        _log_share(n_lines - np.array([len(set(x)) for x in lines]), n_lines, 5, 0.2)])


def measured(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, x): the statistics of every whole text."""
    schema = pa.schema([("doc_id", pa.int64()), ("x", pa.list_(pa.float64()))])

    def rows(batches):
        for batch in slices(batches):
            x = statistics(batch.column("text").cast(pa.binary()).to_pylist())
            yield record_batch(schema, [batch.column("doc_id"), list(x)])

    docs = take(docs, doc_id=id, text=text)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_column().alias("text")).mapInArrow(
        rows, "doc_id bigint, x array<double>")


@dataclass(frozen=True)
class Discriminant:
    """Per class the log of its share, mean and Cholesky factor; ``share`` stands in where a class is missing."""

    share: float
    logs: tuple[float, ...] = ()
    means: tuple[np.ndarray, ...] = ()
    factors: tuple[np.ndarray, ...] = ()

    def score(self, x: np.ndarray) -> np.ndarray:
        if not self.factors:
            return np.full(x.shape[0], self.share)
        density = []
        for log, mean, factor in zip(self.logs, self.means, self.factors, strict=True):
            z = np.linalg.solve(factor, (x - mean).T)
            density.append(log - np.log(np.diag(factor)).sum() - 0.5 * (z * z).sum(axis=0))
        return 1 / (1 + np.exp(np.clip(density[0] - density[1], -700, 700)))


def fit(labelled: DataFrame, towards_pooled: float = 0.1, towards_diagonal: float = 0.05) -> Discriminant:
    """From rows (label, x). What reaches the driver is one number per class and matrix entry."""
    schema = pa.schema([("label", pa.int32()), ("entry", pa.int32()), ("value", pa.float64())])

    def sums(batches):
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            x = np.array(batch.column("x").to_pylist(), float)
            label = batch.column("label").to_numpy()
            for c in np.unique(label).tolist():
                own = x[label == c]
                one = np.column_stack([np.ones(own.shape[0]), own])
                total[c] = total.get(c, 0) + one.T @ one
        for c, m in total.items():
            yield record_batch(schema, [np.full(m.size, c, np.int32), np.arange(m.size, dtype=np.int32), m.ravel()])

    rows = (labelled.select(F.col("label").cast("int").alias("label"), "x").mapInArrow(sums, "label int, entry int, value double")
            .groupBy("label", "entry").agg(F.sum("value").alias("value")).collect())
    size = len(STATISTICS) + 1
    moments = {c: np.zeros(size * size) for c in (0, 1)}
    for r in rows:
        if r["label"] in moments:
            moments[r["label"]][r["entry"]] = r["value"]
    moments = {c: m.reshape(size, size) for c, m in moments.items()}
    n = {c: m[0, 0] for c, m in moments.items()}
    total = n[0] + n[1]
    if min(n.values()) < 2:
        return Discriminant(n[1] / total if total else 0.5)
    means = {c: m[0, 1:] / n[c] for c, m in moments.items()}
    spread = {c: m[1:, 1:] / n[c] - np.outer(means[c], means[c]) for c, m in moments.items()}
    pooled = sum(n[c] * spread[c] for c in (0, 1)) / total
    factors = []
    for c in (0, 1):
        s = (1 - towards_pooled) * spread[c] + towards_pooled * pooled
        s = (1 - towards_diagonal) * s + towards_diagonal * np.diag(np.diag(s))
        factors.append(np.linalg.cholesky(s + 1e-6 * np.eye(size - 1)))
    return Discriminant(n[1] / total, tuple(math.log(n[c] / total) for c in (0, 1)), (means[0], means[1]), tuple(factors))


def score_quality(docs: DataFrame, labels: DataFrame, held_out: Column | None = None, label: str = "quality",
                  threshold: float = 0.7, id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted. Held-out rows are not learnt from.

    ``held_out`` is a condition on doc_id; by default a quarter by its checksum.
    """
    if held_out is None:
        held_out = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))
    x = settled(measured(docs, id, text).withColumn("held_out", held_out))
    marks = take(labels, doc_id=id, label=label).where("doc_id is not null and label is not null")
    model = fit(x.where("not held_out").join(marks, "doc_id").select("label", "x"))
    schema = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("score", pa.float64()), ("predicted", pa.int32())])

    def rows(batches):
        for batch in batches:
            values = np.array(batch.column("x").to_pylist(), float).reshape(-1, len(STATISTICS))
            score = model.score(values)
            yield record_batch(schema, [batch.column("doc_id"), batch.column("held_out"), score, (score >= threshold).astype(np.int32)])

    return x.mapInArrow(rows, "doc_id bigint, held_out boolean, score double, predicted int")
