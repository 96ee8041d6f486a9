"""SKU and country from product addresses."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from listguard.functions.text import quote, strip_ws

# Slug parts that are quantities, and endings of stock codes.
UNIT_TOKEN = r"(?i)^[\dA-Z]*(ML|KG|GB|TB|CM|MM|GM|MG|PC|PCS|L)+[\dA-Z]*$"
STOCK_CODE_ENDING = r"(?i)(NAFAMZ|GANAFAMZ|HANAFAMZ|FANAFAMZ)$"


def last_slug(url: Column) -> Column:
    bare = F.regexp_replace(url, r"/+$", "")
    return F.regexp_replace(F.element_at(F.split(bare, "/"), -1), r"\.html.*$", "")


def sku_from_url(url: Column) -> Column:
    """Rightmost slug part of 12 to 30 letters and digits; known endings go first."""
    parts = F.reverse(F.split(last_slug(url), "-"))
    codes = F.filter(parts, lambda p: F.length(p).between(12, 30) & p.rlike("[A-Za-z]")
                     & p.rlike("[0-9]") & ~p.rlike(UNIT_TOKEN))
    known = F.filter(codes, lambda p: p.rlike(STOCK_CODE_ENDING))
    return F.upper(F.coalesce(F.get(known, F.lit(0)), F.get(codes, F.lit(0))))


def country_from_url(url: Column, domains: dict) -> Column:
    """First domain of the table that occurs in the address."""
    found = [F.when(F.contains(url, F.lit(d)), F.lit(code)) for d, code in domains.items()]
    return F.coalesce(*found) if found else F.lit(None).cast("string")


def base_sku(c: Column) -> Column:
    return strip_ws(F.split_part(c, F.lit("-"), F.lit(1)))


def secure_image(url: Column, placeholder: str) -> Column:
    u = F.coalesce(strip_ws(url), F.lit(""))
    https = F.when(u.startswith("http://"), F.regexp_replace(u, "http://", "https://")).otherwise(u)
    return F.when(https.startswith("http"), https).otherwise(F.lit(placeholder))


def official_pattern(tag: str) -> str:
    return "(?i)" + quote(tag)
