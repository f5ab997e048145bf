"""Sharding by jump consistent hashing.

A stable key and the number of shards alone decide a row's shard; there is no
ring table, and adding one shard moves only the rows that it takes in.

Slots number the rows of a shard without gaps, in the order of a scrambled
key. They come from counts by shard and key range, so that no shard is ordered
in one task.

A null key counts as zero; rows of equal keys share a shard and get slots
each. Null text has no bytes. An empty table gives an empty result; other
columns are not looked at.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quotary.llm.common import settled, take, text_column

_STEP = np.uint64(2862933555777941757)  # of the published algorithm
_SCRAMBLE = np.uint64(0x9E3779B97F4A7C15)


def jump(keys: np.ndarray, shards: int) -> np.ndarray:
    """The shard of each 64-bit key: jump from one candidate to the next until one lies beyond the last shard."""
    key = keys.astype(np.uint64)
    shard, ahead = np.full(key.size, -1, np.int64), np.zeros(key.size, np.int64)
    moving = np.arange(key.size)
    while moving.size:
        shard[moving] = ahead[moving]
        key[moving] = key[moving] * _STEP + np.uint64(1)
        draw = (key[moving] >> np.uint64(33)).astype(np.float64) + 1
        ahead[moving] = ((shard[moving] + 1) * ((1 << 31) / draw)).astype(np.int64)
        moving = moving[ahead[moving] < shards]
    return shard


def jump_column(key: Column, shards: int) -> Column:
    @F.pandas_udf("int")
    def shard(keys: pd.Series) -> pd.Series:
        return pd.Series(jump(keys.to_numpy(np.int64).view(np.uint64), shards).astype(np.int32))

    return shard(key)


def _scrambled(key: Column) -> Column:
    """The key times an odd number modulo 2**64, as an unsigned number moved to the signed range: an order without runs."""
    @F.pandas_udf("long")
    def scramble(keys: pd.Series) -> pd.Series:
        return pd.Series((keys.to_numpy(np.int64).view(np.uint64) * _SCRAMBLE ^ np.uint64(1 << 63)).view(np.int64))

    return scramble(key)


def with_slots(rows: DataFrame, shard: str, order: list[str], by: str, part_rows: int = 50_000) -> DataFrame:
    """``rows`` with ``slot``: the gapless position from 0 within a shard, in the order of column ``by`` (a long that is
    spread evenly over its range) and then ``order``.

    The leading bits of ``by`` cut a shard into parts of about ``part_rows``
    rows; counts of the parts give each part's first slot.
    """
    most = rows.groupBy(shard).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).collect()[0][0] or 0
    bits = max(0, (max(most, 1) - 1) // part_rows).bit_length()
    parted = rows.withColumn("_part", F.shiftright(F.col(by), 64 - bits) if bits else F.lit(0).cast("long"))
    counts = parted.groupBy(shard, "_part").agg(F.count(F.lit(1)).alias("_n"))
    ahead = Window.partitionBy(shard).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    firsts = counts.select(shard, "_part", F.coalesce(F.sum("_n").over(ahead), F.lit(0)).alias("_ahead"))
    inside = Window.partitionBy(shard, "_part").orderBy(by, *order)
    return (parted.join(firsts, [shard, "_part"])
            .withColumn("slot", F.row_number().over(inside) - 1 + F.col("_ahead")).drop("_part", "_ahead"))


def shard_documents(docs: DataFrame, shards: int = 40, id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: doc_id, size, text_crc32, law, shard, slot and grown_shard (with one shard more)."""
    docs = take(docs, doc_id=id, text=text)
    key = F.coalesce(F.col("doc_id").cast("long"), F.lit(0).cast("long"))
    body = F.encode(text_column(), "UTF-8")
    rows = settled(docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text_column()) + 16).cast("long").alias("size"),
        F.crc32(body).alias("text_crc32"), F.lit("key").alias("law"), jump_column(key, shards).alias("shard"),
        jump_column(key, shards + 1).alias("grown_shard"), _scrambled(key).alias("_order")))
    return with_slots(rows, "shard", ["doc_id", "size", "text_crc32"], "_order").select(
        "doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")


#: The same in SQL: the jumps as a recursion over exact wide integers, the checksum as a fold over bytes with a table by its rule.
ORACLE_SQL = """
WITH RECURSIVE keys AS (
  SELECT doc_id, encode(coalesce(text, '')) AS body,
         CASE WHEN doc_id < 0 THEN doc_id::HUGEINT + 18446744073709551616 ELSE coalesce(doc_id, 0)::HUGEINT END AS k
  FROM documents
), steps AS (
  SELECT k, shards, k AS key, -1::BIGINT AS b, 0::BIGINT AS j
  FROM (SELECT DISTINCT k FROM keys), (SELECT unnest([40, 41]) AS shards)
  UNION ALL
  SELECT k, shards, nxt, j, floor((j + 1) * (2147483648.0::DOUBLE / ((nxt // 8589934592)::DOUBLE + 1)))::BIGINT
  FROM (SELECT *, (key * 2862933555777941757 + 1) % 18446744073709551616 AS nxt FROM steps WHERE j < shards)
), placed AS (SELECT k, shards, b FROM steps WHERE j >= shards),
crc AS (SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)),
          lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t),
sums AS (SELECT doc_id, k, octet_length(body)::BIGINT + 16 AS size, xor(list_reduce(list_prepend(4294967295,
          list_transform(regexp_extract_all(hex(body), '..'), lambda x: ('0x' || x)::BIGINT)),
          lambda c, x: xor(c >> 8, crc.t[(xor(c, x) & 255) + 1])), 4294967295) AS text_crc32 FROM keys, crc)
SELECT doc_id, size, text_crc32, 'key' AS law, a.b::INTEGER AS shard,
       row_number() OVER (PARTITION BY a.b ORDER BY (sums.k::UHUGEINT * 11400714819323198485) % 18446744073709551616,
                          doc_id, size, text_crc32) - 1 AS slot, z.b::INTEGER AS grown_shard
FROM sums JOIN placed a ON a.k = sums.k AND a.shards = 40 JOIN placed z ON z.k = sums.k AND z.shards = 41
"""
