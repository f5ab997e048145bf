"""Business-day arithmetic (B9, D6) without a calendar table."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def previous_business_day(day) -> Column:
    """The last Monday-to-Friday day before ``day``."""
    wd = F.weekday(day)  # Monday = 0
    return F.date_sub(day, F.when(wd == 0, 3).when(wd == 6, 2).otherwise(1))


def next_business_day(day) -> Column:
    wd = F.weekday(day)
    return F.date_add(day, F.when(wd == 4, 3).when(wd == 5, 2).otherwise(1))


def previous_month_last_business_day(day) -> Column:
    return previous_business_day(F.trunc(day, "MM"))


def weekday_ordinal(day) -> Column:
    """Number of weekdays from Monday 1969-12-29 to ``day``, inclusive."""
    n = F.unix_date(day) + 3
    return F.floor(n / 7).cast("int") * 5 + F.least(F.pmod(n, F.lit(7)) + 1, F.lit(5))


def weekday_count(start, end) -> Column:
    """Weekdays in ``[start, end]``; 0 if the range is reversed."""
    count = weekday_ordinal(end) - weekday_ordinal(F.date_sub(start, 1))
    return F.when(start > end, 0).otherwise(count).cast("int")


def shift_months(day, months: int) -> Column:
    """``months`` earlier; the day is clamped to the end of the month."""
    return F.add_months(day, -months)


# --- Months as sets of days: bit i of a mask stands for the day i + 1 ------------------------------

#: Monday to Friday over six weeks that start on a Monday.
_WEEKDAYS = sum(1 << i for i in range(42) if i % 7 < 5)


def day_bit(day) -> Column:
    """The mask of one day within its month."""
    return F.expr(f"shiftleft(1L, day({day}) - 1)")


def upto_bit(n) -> Column:
    """The mask of a month's first ``n`` days."""
    return F.call_function("shiftleft", F.lit(1).cast("long"), n.cast("int")) - 1


def weekday_mask(month) -> Column:
    """The weekdays of the month that starts on ``month``."""
    shifted = F.call_function("shiftright", F.lit(_WEEKDAYS).cast("long"), F.weekday(month))
    return shifted.bitwiseAND(upto_bit(F.dayofmonth(F.last_day(month))))


def range_mask(month, start, end) -> Column:
    """The days of the month that lie in ``[start, end]``."""
    first = F.when(start > month, F.dayofmonth(start) - 1).otherwise(0)
    last = F.dayofmonth(F.least(end, F.last_day(month)))
    return upto_bit(last) - upto_bit(first)


def first_day(month, mask) -> Column:
    """The first day of a mask; null for an empty one."""
    lowest = mask.bitwiseAND(-mask)
    return F.when(mask != 0, F.date_add(month, F.bit_count(lowest - 1)))


def last_day(month, mask) -> Column:
    return F.when(mask != 0, F.date_add(month, F.length(F.bin(mask)) - 1))


def mask_days(month, mask) -> Column:
    """Array of the days of a mask, in order."""
    at = F.filter(F.sequence(F.lit(0), F.lit(30)), lambda i: F.call_function("shiftright", mask, i).bitwiseAND(F.lit(1)) == 1)
    return F.transform(F.when(mask != 0, at).otherwise(F.array().cast("array<int>")), lambda i: F.date_add(month, i))
