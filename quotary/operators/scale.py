"""Building blocks that keep a hot key from ending up in one task.

A window over ``symbol`` alone sends the whole history of a symbol to one
task. The helpers here window over ``(key, time bucket)`` instead and carry a
small per-bucket summary (one row per key and bucket, produced with map-side
combine) across the buckets. Results are the same as those of the plain
window.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def year_of(col) -> Column:
    return F.trunc(col, "year")


def month_of(col) -> Column:
    return F.trunc(col, "month")


def _before(by):
    return Window.partitionBy(*by).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)


def running_last(df: DataFrame, by, bucket: Column, order, value: Column, name: str,
                 inclusive: bool = True) -> DataFrame:
    """Latest non-null ``value`` up to each row of its key, in ``order``.

    ``bucket`` must grow with the first column of ``order``. With
    ``inclusive=False`` the row itself does not count (a ``lag`` that skips
    nulls).
    """
    df = df.withColumn("_b", bucket).withColumn("_v", value)
    totals = df.groupBy(*by, "_b").agg(
        F.max(F.when(F.col("_v").isNotNull(), F.struct(*order, "_v"))).alias("_m"))
    carry = totals.select(*by, "_b", F.last("_m", ignorenulls=True).over(_before(by))["_v"].alias("_c"))
    inside = (Window.partitionBy(*by, "_b").orderBy(*order)
              .rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1))
    return (df.join(carry, [*by, "_b"])
            .withColumn(name, F.coalesce(F.last("_v", ignorenulls=True).over(inside), "_c"))
            .drop("_b", "_v", "_c"))


def running_max_before(df: DataFrame, by, bucket: Column, order, value: Column, name: str) -> DataFrame:
    """Maximum of ``value`` over the rows before each row of its key."""
    df = df.withColumn("_b", bucket).withColumn("_v", value)
    totals = df.groupBy(*by, "_b").agg(F.max("_v").alias("_m"))
    carry = totals.select(*by, "_b", F.max("_m").over(_before(by)).alias("_c"))
    inside = Window.partitionBy(*by, "_b").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return (df.join(carry, [*by, "_b"])
            .withColumn(name, F.greatest(F.max("_v").over(inside), "_c"))
            .drop("_b", "_v", "_c"))


def ranked(df: DataFrame, by, bucket: Column, order, index: str, total: str) -> DataFrame:
    """Zero-based position of each row within its key, and the key's row count."""
    df = df.withColumn("_b", bucket)
    sizes = df.groupBy(*by, "_b").agg(F.count(F.lit(1)).alias("_n"))
    offsets = sizes.select(
        *by, "_b",
        F.coalesce(F.sum("_n").over(_before(by)), F.lit(0)).alias("_o"),
        F.sum("_n").over(Window.partitionBy(*by)).alias(total))
    inside = Window.partitionBy(*by, "_b").orderBy(*order)
    return (df.join(offsets, [*by, "_b"])
            .withColumn(index, F.row_number().over(inside) - 1 + F.col("_o"))
            .drop("_b", "_o"))


def asof_join(left: DataFrame, right: DataFrame, by, left_on: str, right_on: str, values,
              strict: bool = False, bucket=year_of) -> DataFrame:
    """For each left row the latest right row of its key at or before ``left_on``.

    ``strict`` asks for a row strictly before. The right rows' ``values`` are
    added to the left columns; they are null where there is no such row.
    """
    left_cols = left.columns
    is_right = F.col("_row").isNull()
    payload = F.struct(F.col(right_on).alias("_t"), *[F.col(v) for v in values])
    lhs = left.select(*by, F.col(left_on).alias("_t"), F.struct(*left_cols).alias("_row"),
                      F.lit(0 if strict else 1).alias("_side"))
    rhs = right.select(*by, F.col(right_on).alias("_t"), payload.alias("_hit"),
                       F.lit(1 if strict else 0).alias("_side"))
    both = lhs.unionByName(rhs, allowMissingColumns=True).withColumn("_b", bucket(F.col("_t")))
    totals = both.groupBy(*by, "_b").agg(F.max("_hit").alias("_m"))
    carry = totals.select(*by, "_b", F.last("_m", ignorenulls=True).over(_before(by)).alias("_c"))
    inside = (Window.partitionBy(*by, "_b").orderBy("_t", "_side", "_hit")
              .rowsBetween(Window.unboundedPreceding, 0))
    out = (both.join(carry, [*by, "_b"])
           .withColumn("_h", F.coalesce(F.last("_hit", ignorenulls=True).over(inside), "_c"))
           .where(~is_right))
    return out.select("_row.*", *[F.col("_h")[v].alias(v) for v in values])


def top_k(df: DataFrame, by, order, k: int, rank: str) -> DataFrame:
    """The first ``k`` rows of each key. Spark keeps ``k`` rows per key and task before the shuffle, so hot keys are cut there."""
    window = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(window)).where(F.col(rank) <= k)


def _band(v: Column) -> Column:
    """Number of the band a value falls in; never falls as the value grows, since a logarithm never does.

    A band spans about a quarter of a percent. Infinities and NaN have the outermost bands.
    """
    size = F.floor(F.log10(F.abs(v)) * 1000) + 400_000
    band = F.when(v == 0, 0).when(v > 0, size).otherwise(-size)
    inf = F.lit(float("inf"))
    return (F.when(F.isnan(v), 800_001).when(v == inf, 800_000).when(v == -inf, -800_000).otherwise(band)).cast("long")


def order_statistics(df: DataFrame, by, value: str, picks: dict) -> DataFrame:
    """Exact order statistics per key without sorting a key in one task.

    ``picks`` maps an output name to a function from the key's row count to a
    one-based rank; None asks for the row count itself. Values are counted first, then ranked in two levels, the
    upper one over bands of values.
    """
    counted = (df.where(F.col(value).isNotNull())
               .groupBy(*by, F.col(value).alias("_v")).agg(F.count(F.lit(1)).alias("_n"))
               .withColumn("_band", _band(F.col("_v"))))
    bands = counted.groupBy(*by, "_band").agg(F.sum("_n").alias("_bn"))
    before = Window.partitionBy(*by).orderBy("_band").rowsBetween(Window.unboundedPreceding, -1)
    bands = bands.select(*by, "_band",
                         F.coalesce(F.sum("_bn").over(before), F.lit(0)).alias("_o"),
                         F.sum("_bn").over(Window.partitionBy(*by)).alias("_total"))
    inside = Window.partitionBy(*by, "_band").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    ranked_values = (counted.join(bands, [*by, "_band"])
                     .withColumn("_hi", F.sum("_n").over(inside) + F.col("_o"))
                     .withColumn("_lo", F.col("_hi") - F.col("_n")))
    out = []
    for name, rank_of in picks.items():
        if rank_of is None:
            out.append(F.max("_total").alias(name))
            continue
        rank = rank_of(F.col("_total"))
        out.append(F.max(F.when((F.col("_lo") < rank) & (rank <= F.col("_hi")), F.col("_v"))).alias(name))
    return ranked_values.groupBy(*by).agg(*out)


def with_row(df: DataFrame, one_row: DataFrame) -> DataFrame:
    """Attach the columns of a frame that has exactly one row (a global aggregate) to every row.

    The row is a scalar subquery, so no join is planned for it.
    """
    single = one_row.select(F.struct(*one_row.columns).alias("_r")).scalar()
    return df.select("*", single.alias("_r")).select(*df.columns, "_r.*")


def seek(df: DataFrame, order, size: int, after=None) -> DataFrame:
    """The ``size`` rows that follow the key ``after`` in an order, so that a later page costs what the first costs.

    ``order`` lists (column, descending); the last columns must make the key
    unique. ``after`` has the key of the page's predecessor, one value per
    column. Nulls come last ascending and first descending.
    """
    if after is not None:
        later, equal = F.lit(False), F.lit(True)
        for (name, descending), value in zip(order, after, strict=True):
            c, v = F.col(name), F.lit(value).cast(df.schema[name].dataType)
            if value is None:
                beyond = c.isNotNull() if descending else F.lit(False)
            else:
                beyond = F.coalesce(c < v, F.lit(False)) if descending else F.coalesce(c > v, F.lit(True))
            later, equal = later | (equal & beyond), equal & c.eqNullSafe(v)
        df = df.where(later)
    return df.orderBy(*[F.col(c).desc_nulls_first() if d else F.col(c).asc_nulls_last() for c, d in order]).limit(size)


def mirrored(day) -> Column:
    """The day reflected at 2000-01-01, so that later becomes earlier."""
    pivot = F.lit("2000-01-01").cast("date")
    return F.date_sub(pivot, F.datediff(day, pivot))


def next_join(left: DataFrame, right: DataFrame, by, left_on: str, right_on: str, values) -> DataFrame:
    """For each left row the earliest right row of its key strictly after ``left_on``."""
    lhs = left.withColumn("_lm", mirrored(F.col(left_on)))
    rhs = right.withColumn("_rm", mirrored(F.col(right_on)))
    return asof_join(lhs, rhs, by, "_lm", "_rm", values, strict=True).drop("_lm")
