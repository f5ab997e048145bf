"""Quality rules under weak supervision.

Each rule votes good, bad or abstains on a document. Expectation-maximisation
over the counts of vote patterns estimates how often each rule casts each vote
on good and on bad documents; a document's quality is the posterior
probability that these give. DataFrame functions only.

Null text counts as an empty one: no words, below the least length, not kept.
Repeated rows are judged alike, an empty table gives an empty result, columns
other than id and text are not looked at.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quotary.llm.common import settled, take, text_column

SPACES = r"[\x20\x09-\x0D]+"
VOTES = ("good", "bad", "none")

#: Frequent words of running text in English, German, French and Spanish.
FUNCTION_WORDS = ("the", "of", "and", "to", "in", "is", "that", "der", "die", "und", "das", "ist", "nicht", "den", "le",
                  "la", "les", "et", "des", "de", "en", "que", "el", "los", "un", "du", "y", "a")


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once."""
    return F.transform(F.array(value), body)[0]


def _repeat_words(words: Column, size: int = 3) -> Column:
    """Words in windows of ``size`` words that are found twice or more in the text."""
    def covered(runs: Column) -> Column:
        # sorted by hash, windows of equal words are neighbours
        ordered = F.array_sort(F.transform(runs, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        twice = _let(ordered, lambda s: F.filter(
            F.transform(s, lambda e, k: F.when((e.h == F.get(s, k - 1).h) | (e.h == F.get(s, k + 1).h), e.i)),
            lambda i: i.isNotNull()))
        return _let(F.array_sort(twice), lambda p: F.aggregate(
            F.transform(p, lambda i, k: F.least(F.lit(size), F.coalesce(F.get(p, k + 1) - i, F.lit(size)))),
            F.lit(0).cast("long"), lambda total, n: total + n))

    runs = F.transform(F.sequence(F.lit(0), F.size(words) - size),
                       lambda i: F.xxhash64(*[F.get(words, i + k) for k in range(size)]))
    found = _let(runs, lambda r: F.when(F.size(F.array_distinct(r)) < F.size(r), covered(r)).otherwise(F.lit(0).cast("long")))
    return F.when(F.size(words) > size, found).otherwise(F.lit(0).cast("long"))


def measured(docs: DataFrame, text: str = "text") -> DataFrame:
    """The columns of ``docs`` and the statistics that the rules read."""
    d = docs.withColumn("_t", text_column(text))
    d = d.withColumn("_w", F.filter(F.split("_t", SPACES), lambda w: w != "")).withColumn(
        "_l", F.filter(F.split("_t", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")))
    d = d.withColumn("_j", F.array_join("_w", ""))
    return d.withColumns({
        "n_words": F.size("_w").cast("long"),
        "word_chars": F.length("_j").cast("long"),
        "n_symbols": (F.length("_t") - F.length(F.regexp_replace("_t", r"[#*$%&|<>]+", ""))).cast("long"),
        "n_dup_lines": (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long"),
        "n_repeat_words": _repeat_words(F.col("_w")),
        "n_lines": F.size("_l").cast("long"),
        "n_upper": F.length(F.regexp_replace("_j", r"\P{Lu}+", "")).cast("long"),
        "n_letters": F.length(F.regexp_replace("_j", r"\P{L}+", "")).cast("long"),
        "n_bangs": F.length(F.regexp_replace("_j", r"[^!]+", "")).cast("long"),
        "n_function_words": F.size(F.filter("_w", lambda w: F.lower(w).isin(*FUNCTION_WORDS))).cast("long"),
    }).drop("_t", "_w", "_l", "_j")


STATISTICS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_letters",
              "n_bangs", "n_function_words"]


def _share(part: str, whole: str) -> Column:
    return F.col(part) / F.greatest(F.col(whole), F.lit(1))




def rules() -> dict[str, Column]:
    """Each rule's vote as a column over the statistics."""
    def low(value: Column, good: float, bad: float) -> Column:
        return F.when(value >= bad, "bad").when(value <= good, "good").otherwise("none")

    mean_word = _share("word_chars", "n_words")
    some = F.col("n_words") > 0
    votes = {
        "length": F.when(F.col("n_words") < 50, "bad").when(F.col("n_words") >= 80, "good").otherwise("none"),
        "symbols": low(_share("n_symbols", "word_chars"), 0.01, 0.05),
        "repeated_lines": low(_share("n_dup_lines", "n_lines"), 0.1, 0.4),
        "repeated_words": low(_share("n_repeat_words", "n_words"), 0.2, 0.5),
        "capitals": low(_share("n_upper", "n_letters"), 0.15, 0.4),
        "bangs": low(_share("n_bangs", "n_words"), 0.05, 0.3),
        "word_length": F.when((mean_word < 2) | (mean_word > 15), "bad").when(mean_word.between(3, 10), "good").otherwise("none"),
        "function_words": F.when(_share("n_function_words", "n_words") < 0.02, "bad").when(
            _share("n_function_words", "n_words") > 0.08, "good").otherwise("none"),
    }
    return {name: F.when(some, vote).otherwise("bad") for name, vote in votes.items()}


@dataclass(frozen=True)
class LabelModel:
    """Share of good documents, and per rule and vote the chance of the vote on a good and on a bad document."""

    prior: float
    chances: dict[str, dict[str, tuple[float, float]]]

    def posterior(self, votes: dict[str, Column]) -> Column:
        odds = F.lit(math.log(self.prior / (1 - self.prior)))
        for rule, vote in votes.items():
            weight = {v: math.log(g / b) for v, (g, b) in self.chances[rule].items()}
            odds = odds + F.when(vote == "good", weight["good"]).when(vote == "bad", weight["bad"]).otherwise(weight["none"])
        return 1 / (1 + F.exp(-odds))

    def accuracy(self) -> dict[str, float]:
        """Share of a rule's votes that agree with the truth."""
        out = {}
        for rule, c in self.chances.items():
            right = self.prior * c["good"][0] + (1 - self.prior) * c["bad"][1]
            wrong = self.prior * c["bad"][0] + (1 - self.prior) * c["good"][1]
            out[rule] = right / (right + wrong)
        return out


def fit_label_model(stats: DataFrame, votes: dict[str, Column] | None = None, rounds: int = 10,
                    smoothing: float = 1.0) -> LabelModel:
    """Expectation-maximisation over the counts of vote patterns.

    Spark counts the patterns in one aggregate; there are at most 3**rules of
    them, whatever the number of documents, and the rounds run over that table
    on the driver. A bad vote is rare, so the first guess calls a document bad
    if any rule does.
    """
    votes = votes or rules()
    names = list(votes)
    rows = stats.select(*[v.alias(n) for n, v in votes.items()]).groupBy(*names).agg(F.count(F.lit(1)).alias("_n")).collect()
    rows.sort(key=tuple)
    n = np.array([r["_n"] for r in rows], float)
    cast = np.array([[[r[name] == v for v in VOTES] for name in names] for r in rows], float).reshape(len(rows), len(names), len(VOTES))
    good = np.where(cast[:, :, VOTES.index("bad")].any(axis=1), 0.2, 0.95)
    for _ in range(rounds):
        weights = n * good, n * (1 - good)
        totals = [w.sum() for w in weights]
        chance = [(np.einsum("p,prv->rv", w, cast) + smoothing) / (t + len(VOTES) * smoothing) for w, t in zip(weights, totals, strict=True)]
        prior = (totals[0] + smoothing) / (sum(totals) + 2 * smoothing)
        odds = math.log(prior / (1 - prior)) + np.einsum("prv,rv->p", cast, np.log(chance[0] / chance[1]))
        good = 1 / (1 + np.exp(-odds))
    return LabelModel(float(prior), {name: {v: (float(chance[0][i, k]), float(chance[1][i, k])) for k, v in enumerate(VOTES)}
                                     for i, name in enumerate(names)})


def judged(stats: DataFrame, model: LabelModel, threshold: float = 0.5) -> DataFrame:
    """``stats`` with base_failed, the posterior ``quality`` and ``kept``."""
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return (stats.withColumn("base_failed", failed).withColumn("quality", model.posterior(rules()))
            .withColumn("kept", ~F.col("base_failed") & (F.col("quality") >= threshold)))


def score_documents(docs: DataFrame, id: str = "doc_id", text: str = "text", threshold: float = 0.5) -> DataFrame:
    """One row per document: id, statistics, base_failed, quality, kept."""
    stats = settled(measured(take(docs, doc_id=id, text=text)).drop("text"))
    return judged(stats, fit_label_model(stats), threshold).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "quality")


def keep_good(docs: DataFrame, text: str = "text", threshold: float = 0.5) -> DataFrame:
    """The rows of ``docs`` that the rules keep, with its columns.

    The statistics are computed once for the model and once for the filter,
    so that no text is written or shuffled. The row number that the filter
    also reads keeps Spark from moving the filter below the statistics, where
    it would compute each of them many times.
    """
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row")
    stats = measured(docs.select(row, F.col(f"`{text}`").alias("_text")), "_text").drop("_text")
    numbered = stats.withColumn("_number", F.monotonically_increasing_id())
    return judged(numbered, fit_label_model(stats), threshold).where(F.col("kept") & (F.col("_number") >= 0)).select("_row.*")
