"""Price and discount expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from listguard.functions.text import is_blank, let, num
from listguard.market import CURRENCIES


def price_text(c: Column) -> Column:
    """Digits and points of a price text as a positive number text, else empty."""
    value = num(F.regexp_replace(c.cast("string"), r"[^0-9.]", ""))
    return F.when(value > 0, number_text(value)).otherwise("")


def number_text(value: Column) -> Column:
    """A double as plain digits with at least one decimal place, never in powers of ten below 1e16."""
    digits = F.rtrim(value.try_cast("decimal(38,12)").cast("string"), F.lit("0"))
    plain = F.when(F.endswith(digits, F.lit(".")), F.concat(digits, F.lit("0"))).otherwise(digits)
    return F.when(F.abs(value) < 1e16, plain).otherwise(value.cast("string"))


def listing_price(sale: Column, regular: Column) -> Column:
    """Sale price when positive, else the regular price; unreadable counts as 0."""
    return let(num(sale), lambda s: F.coalesce(F.when(s > 0, s).otherwise(num(regular)), F.lit(0.0)))


def discount_text(stated: Column, old: Column, sale: Column) -> Column:
    """The stated discount, or the one computed from the prices where it is missing."""
    computed = let(F.struct(num(old).alias("o"), num(sale).alias("s")), lambda p: F.when(
        (p.o > 0) & (p.s < p.o),
        F.concat(F.bround((p.o - p.s) / p.o * 100, 0).try_cast("bigint").cast("string"), F.lit("%"))))
    return F.when(is_blank(stated), F.coalesce(computed, stated, F.lit(""))).otherwise(stated)


def local_price(usd: Column, country: str, rate: float | None = None) -> Column:
    """US dollars as local price text; empty when missing or not positive."""
    _, symbol, fallback, decimals = CURRENCIES.get(country, ("USD", "$", 1.0, 2))
    value = num(usd) * F.lit(fallback if rate is None else rate)
    return F.when(num(usd) > 0, F.concat(F.lit(symbol + " "), F.format_number(value, decimals))
                  ).otherwise("")
