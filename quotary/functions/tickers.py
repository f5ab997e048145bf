"""Ticker spelling (B1, B2)."""

from pyspark.sql import Column
from pyspark.sql import functions as F

# Exchange suffixes that stay behind their dot.
EXCHANGE_SUFFIXES = [
    "T", "L", "V", "F",
    "TO", "AX", "DE", "HK", "SW", "MI", "PA", "SA", "SZ", "SS", "TW", "TWO", "BK", "KS", "KQ", "OL", "HE", "ST",
    "VI", "CO", "AS", "BR", "LS", "IS", "MX", "SI", "JK", "NZ", "JO", "MU", "BE",
]

# Indices that the quote vendor lists under a caret.
CARET_INDICES = ["IRX", "FVX", "TNX", "TYX", "VIX", "GSPC", "DJI", "IXIC", "SOX", "RUT"]


def stripped(col) -> Column:
    return F.regexp_replace(col, r"^\s+|\s+$", "")


def normalize_symbol(col) -> Column:
    """Upper-cased ticker in quote-vendor spelling; blank and null become ``""``."""
    s = F.upper(stripped(F.coalesce(col, F.lit(""))))
    head = F.regexp_extract(s, r"^(.*)\.[^.]*$", 1)
    tail = F.regexp_extract(s, r"^.*\.([^.]*)$", 1)
    share_class = tail.rlike(r"^\p{L}$") & ~tail.isin(EXCHANGE_SUFFIXES)
    return F.when(share_class & ~s.startswith("^"), F.concat(head, F.lit("-"), tail)).otherwise(s)


def vendor_symbol(symbol, vendor) -> Column:
    """The name under which ``vendor`` lists ``symbol``."""
    symbol = F.col(symbol) if isinstance(symbol, str) else symbol
    vendor = F.col(vendor) if isinstance(vendor, str) else vendor
    caret = F.concat(F.lit("^"), symbol)
    return (F.when(vendor == "eodhd", F.when(symbol == "VIX", "VIX.INDX").otherwise(F.concat(symbol, F.lit(".US"))))
            .when(vendor == "tiingo", F.when(symbol == "VIX", "^VIX").otherwise(F.lower(symbol)))
            .when(vendor == "yfinance", F.when(symbol.isin(CARET_INDICES), caret).otherwise(symbol))
            .otherwise(symbol))


def vendor_supported(source, symbol) -> Column:
    return ~((symbol == "VIX") & source.isin("alpaca", "tiingo"))
