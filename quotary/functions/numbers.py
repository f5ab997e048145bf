"""Price comparison."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from quotary.schemas import TOLERANCE, TOLERANCE_SLACK


def within_tolerance(a, b, tolerance: float = TOLERANCE) -> Column:
    return F.abs(a - b) <= F.lit(tolerance) + F.lit(TOLERANCE_SLACK)


def deviation_pct(stored, reference) -> Column:
    """Absolute difference in percent of the stored price, 6 decimals half up; 0 if either price is 0."""
    s, r = stored.cast("string").cast("decimal(24,10)"), reference.cast("string").cast("decimal(24,10)")
    pct = F.round(F.abs(s - r) * 100 / s, 6).cast("double")
    return F.when((stored == 0) | (reference == 0), 0.0).otherwise(pct)


def is_significant(pct, noise: float = 0.0001, minimum: float = 0.001) -> Column:
    return (pct >= noise) & (pct >= minimum)


def reported_number(text) -> Column:
    """Vendor number as double; ``""``, ``NA`` and ``N/A`` mean missing."""
    return F.when(~text.isin("", "NA", "N/A"), text.try_cast("double"))


def six_decimals(col) -> Column:
    col = F.col(col) if isinstance(col, str) else col
    return F.when(col.isNull(), "").otherwise(F.format_string("%.6f", col))
