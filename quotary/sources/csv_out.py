"""CSV exports."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quotary.functions.numbers import six_decimals
from quotary.operators.coverage import SORT_FIELDS, coverage_filter

COVERAGE_COLUMNS = ["symbol", "name", "exchange", "currency", "is_active", "data_start", "data_end", "data_days",
                    "row_count", "last_updated", "has_gaps"]


def coverage_export(coverage: DataFrame, sort_by: str = "symbol", order: str = "asc", max_rows: int | None = None,
                    **filters) -> DataFrame:
    """The whole listing as text columns, nulls empty, dates ISO; its first ``max_rows`` rows if asked for."""
    key = F.col(sort_by if sort_by in SORT_FIELDS else "symbol")
    key = key.desc_nulls_first() if order.lower() == "desc" else key.asc_nulls_last()
    rows = coverage_filter(coverage, **filters).orderBy(key, "symbol")
    if max_rows is not None:
        rows = rows.limit(max_rows)
    text = {c: F.col(c).cast("string") for c in COVERAGE_COLUMNS}
    text["last_updated"] = F.date_format("last_updated", "yyyy-MM-dd'T'HH:mm:ss'+00:00'")
    text["is_active"] = F.initcap(F.col("is_active").cast("string"))
    text["has_gaps"] = F.initcap(F.col("has_gaps").cast("string"))
    return rows.select(*[F.coalesce(text[c], F.lit("")).alias(c) for c in COVERAGE_COLUMNS])


def points_export(points: DataFrame) -> DataFrame:
    """Comparison points with six decimals."""
    return points.select("symbol", F.date_format("date", "yyyy-MM-dd").alias("date"), "source",
                         *[six_decimals(c).alias(c) for c in ("open", "close", "adj_close")],
                         F.coalesce(F.col("volume").cast("string"), F.lit("")).alias("volume"), "status")


def summary_export(summary: DataFrame) -> DataFrame:
    """Summary rows as text, nulls empty."""
    return summary.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in summary.columns])


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).option("header", True).option("emptyValue", "").csv(path)
