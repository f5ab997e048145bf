"""Secret scan by corpus-wide ownership.

Fixed patterns find base spans. Beside them every token that looks like key
material is a candidate; values are counted over the whole corpus by the
distinct documents (repositories) and sources (owners) that have them. A value
that several owners or many repositories carry is a copied example; one that few
of either have is live-looking, and such candidates become spans of kind
``owned``.

Null text is an empty one: no spans. A repository is an id, so that repeated
rows count once; rows without an id are one for each text. Rows without a source
count together as one owner, as nothing tells theirs apart; what is copied among
them shows in its repositories. An empty table gives an empty result;
other columns are not looked at.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quotary.llm.common import as_rows, record_batch, settled, take, text_column

KINDS = ("assign", "access", "hex", "owned")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]{12,}")  # as AKIA[A-Z0-9]+ of 16 characters or more
HEX = re.compile(r"[0-9a-f]{32,}")
OWNED = re.compile(r"[A-Za-z0-9+/_=-]{20,}")

_SPAN = pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("value", pa.binary())])
_ROW = pa.schema([("doc_id", pa.int64()), ("print", pa.int64()), ("owner", pa.string()), ("n_assign", pa.int64()), ("n_access", pa.int64()),
                  ("n_hex", pa.int64()), ("base_sha256", pa.string()), ("found", pa.list_(_SPAN))])
_ROW_DDL = ("doc_id bigint, print bigint, owner string, n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, "
            "found array<struct<kind:string,start:int,end:int,value:binary>>")


def _entropy(token: str) -> float:
    """Bits per character."""
    return -sum(n / len(token) * math.log2(n / len(token)) for n in Counter(token).values())


def base_spans(text: str) -> list[tuple[str, int, int, str]]:
    """(kind, start, end, value) of the fixed patterns, by start and then kind."""
    out = []
    if ":" in text or "=" in text:
        out += [("assign", *m.span(), m[2]) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    if "AKIA" in text:
        out += [("access", *m.span(), m[0]) for m in ACCESS.finditer(text)]
    out += [("hex", *m.span(), m[0]) for m in HEX.finditer(text)]
    return sorted(out, key=lambda s: (s[1], KINDS.index(s[0])))


def candidates(text: str, base: list, entropy: float = 3.0) -> list[tuple[str, int, int, str]]:
    """Tokens outside the base spans that mix letters and digits and are hard to guess."""
    out = []
    for m in OWNED.finditer(text):
        token = m[0]
        if (any(c.isdigit() for c in token) and any(c.isalpha() for c in token) and _entropy(token) >= entropy
                and not any(s < m.end() and m.start() < e for _, s, e, _ in base)):
            out.append(("owned", *m.span(), token))
    return out


def _written(spans) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


def _value(token: str) -> bytes:
    return hashlib.blake2b(token.encode(), digest_size=16).digest()


def find(docs: DataFrame, id: str = "doc_id", text: str = "text", owner: str = "source") -> DataFrame:
    """Base spans and candidates of every document, with hashes in place of the values and a hash (print) of the text."""
    def rows(batches):
        for batch in batches:
            out = []
            columns = [batch.column(c).to_pylist() for c in ("doc_id", "print", "text", "owner")]
            for doc_id, mark, body, who in zip(*columns, strict=True):
                base = base_spans(body)
                n = Counter(s[0] for s in base)
                written = _written(s[:3] for s in base)
                more = candidates(body, base)
                out.append((doc_id, mark, who, n["assign"], n["access"], n["hex"], hashlib.sha256(written.encode()).hexdigest(),
                            [dict(kind=k, start=s, end=e, value=_value(v)) for k, s, e, v in [*base, *more]]))
            yield record_batch(_ROW, [list(c) for c in zip(*out, strict=True)] if out else [[] for _ in _ROW])

    docs = take(docs, doc_id=id, text=text, owner=owner)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text_column()).alias("print"),
                       text_column().alias("text"),
                       F.col("owner").cast("string").alias("owner")).mapInArrow(rows, _ROW_DDL)


def ownership(found: DataFrame) -> DataFrame:
    """(value, repositories, owners): how many documents and how many sources carry a value."""
    repository = F.struct("doc_id", F.when(F.col("doc_id").isNull(), F.col("print")).alias("print"))
    each = found.select(F.struct("owner").alias("owner"), repository.alias("repository"),
                        F.explode(F.array_distinct(F.transform("found", lambda s: s.value))).alias("value"))
    return each.groupBy("value").agg(F.count_distinct("repository").alias("repositories"), F.count_distinct("owner").alias("owners"))


def judged(docs: DataFrame, id: str = "doc_id", text: str = "text", owner: str = "source",
           example_owners: int = 3, example_repositories: int = 20) -> DataFrame:
    """Per document what ``find`` says, and its spans as sorted structs with the number of live values and examples.

    From ``example_owners`` owners or ``example_repositories`` documents on a value is a copied example.
    """
    found = settled(find(docs, id, text, owner).withColumn("_row", F.monotonically_increasing_id()))
    some = found.where(F.size("found") > 0)
    spans = some.select("_row", F.explode("found").alias("s")).select("_row", "s.*").join(ownership(some), "value")
    live = (F.col("owners") < example_owners) & (F.col("repositories") < example_repositories)
    rank = F.array_position(F.array(*[F.lit(k) for k in KINDS]), F.col("kind"))
    per_row = spans.groupBy("_row").agg(
        F.sort_array(F.collect_list(F.when((F.col("kind") != "owned") | live,
                                           F.struct("start", rank.alias("rank"), "end", "kind")))).alias("spans"),
        F.count(F.when(live, 1)).alias("n_live"), F.count(F.when(~live, 1)).alias("n_examples"))
    none = {"spans": F.array().cast(per_row.schema["spans"].dataType), "n_live": F.lit(0).cast("long"), "n_examples": F.lit(0).cast("long")}
    clean = found.where(F.size("found") == 0).withColumns(none)
    return some.join(per_row, "_row").unionByName(clean).drop("_row", "found")


def scan_secrets(docs: DataFrame, id: str = "doc_id", text: str = "text", owner: str = "source",
                 example_owners: int = 3, example_repositories: int = 20) -> DataFrame:
    """One row per document: id, counts by kind, base_sha256, spans (written), n_live and n_examples."""
    written = F.array_join(F.transform("spans", lambda s: F.concat_ws(":", s.kind, s.start, s.end)), ",")
    return judged(docs, id, text, owner, example_owners, example_repositories).select(
        "doc_id", "n_assign", "n_access", "n_hex", "base_sha256", written.alias("spans"), "n_live", "n_examples")


def redact_secrets(docs: DataFrame, id: str = "doc_id", text: str = "text", owner: str = "source", length: str | None = "n_chars",
                   example_owners: int = 3, mark: str = "[SECRET]", example_repositories: int = 20) -> DataFrame:
    """``docs`` with every span, base or live, replaced by ``mark``; ``length`` is the column of the text's length, if any.

    Rows meet their spans by id and a hash of the text, in one join.
    """
    found = judged(docs, id, text, owner, example_owners, example_repositories).where(F.size("spans") > 0).select(
        "doc_id", "print", "spans").dropDuplicates(["doc_id", "print"])
    keyed = as_rows(docs, id=F.col(f"`{id}`").cast("long"), own=F.xxhash64(text_column(text)))
    met = keyed.join(found, F.col("id").eqNullSafe(F.col("doc_id")) & (F.col("own") == F.col("print")), "left")
    body = F.col("row")[text]
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    redacted = F.aggregate(
        "spans", start,
        lambda a, s: F.struct(F.greatest(a.at, s.end).alias("at"), F.when(
            s.start >= a.at, F.concat(a.out, F.substring(body, a.at + 1, s.start - a.at), F.lit(mark))).otherwise(a.out).alias("out")),
        lambda a: F.concat(a.out, F.substring(body, a.at + 1, F.length(body))))
    met = met.select("row", F.when(F.col("spans").isNull(), body).otherwise(redacted).alias("body"), F.col("spans").isNull().alias("clean"))
    new = {text: F.col("body")}
    if length and length in docs.columns:
        new[length] = F.when(F.col("clean"), F.col("row")[length]).otherwise(F.length("body").cast(dict(docs.dtypes)[length]))
    return met.select(*[new.get(c, F.col("row")[c]).alias(c) for c in docs.columns])
