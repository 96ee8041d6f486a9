"""Text normalisation as Column expressions; everything stays inside the JVM."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words dropped when a text key is built.
NOISE_WORDS = ["new", "sale", "original", "genuine", "authentic", "official", "premium",
               "quality", "best", "hot", "2024", "2025"]

# Base colour -> spellings.
COLOR_VARIANTS = {
    "red": ["red", "crimson", "scarlet", "maroon", "burgundy", "wine", "ruby"],
    "blue": ["blue", "navy", "royal", "sky", "azure", "cobalt", "sapphire"],
    "green": ["green", "lime", "olive", "emerald", "mint", "forest", "jade"],
    "black": ["black", "onyx", "ebony", "jet", "charcoal", "midnight"],
    "white": ["white", "ivory", "cream", "pearl", "snow", "alabaster"],
    "gray": ["gray", "grey", "silver", "slate", "ash", "graphite"],
    "yellow": ["yellow", "gold", "golden", "amber", "lemon", "mustard"],
    "orange": ["orange", "tangerine", "peach", "coral", "apricot"],
    "pink": ["pink", "rose", "magenta", "fuchsia", "salmon", "blush"],
    "purple": ["purple", "violet", "lavender", "plum", "mauve", "lilac"],
    "brown": ["brown", "tan", "beige", "khaki", "chocolate", "coffee", "bronze"],
    "multicolor": ["multicolor", "multicolour", "multi-color", "rainbow", "mixed"],
}

# Size words, measured tokens and promotion words removed from base names.
SIZE_WORDS = ["xxs", "xs", "small", "medium", "large", "xl", "xxl", "xxxl"]
MEASURE_TOKEN = r'\b\d+\s*(?:gb|tb|inch|inches|"|ram|memory|ddr|pack|piece|pcs)\b'
PROMO_WORDS = ["new", "original", "genuine", "authentic", "official", "premium", "quality",
               "best", "hot", "sale", "promo", "deal"]

# What counts as a size among variant values.
SIZE_VALUE = (r"(?iU)^((EU|UK|US|EU/UK)\s*\d{1,3}(\.\d)?|\d{1,3}(\.\d)?"
              r"|(XS|S|M|L|XL|XXL|XXXL|3XL|4XL|5XL)|(ONE\s*SIZE|FREE\s*SIZE)"
              r"|\d{1,3}\s*(cm|mm|in|inch|inches))$")

# Broken byte sequences and their repair, applied in this order.
MOJIBAKE = [
    ("â€“", "-"), ("â€”", "-"), ("â€™", "'"), ("â€˜", "'"), ("â€œ", '"'), ("â€", '"'),
    ("Ã¬", "i"), ("Ã©", "e"), ("Ã¨", "e"), ("Ã ", "a"), ("Â", ""), ("â„¢", "TM"),
    ("â€¢", "*"), ("â€¦", "..."),
]

# Only these characters occur in a plain number; the cast decides about their order.
NUMBER = r"^[0-9.eE+-]+$"

# Everything that counts as white space at the ends of a text.
BLANKS = (" \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B)))
          + "\u2028\u2029\u202f\u205f\u3000")


def quote(word: str) -> str:
    """``word`` as a literal inside a Java regular expression."""
    return re.sub(r"([\\.\[\]{}()*+?^$|\-#&~])", r"\\\1", word)


def quote_col(c: Column) -> Column:
    return F.regexp_replace(c, r"([\\.\[\]{}()*+?^$|\-#&~])", r"\\$1")


def alternation(words, sort: bool = True) -> str:
    words = sorted(words, key=len, reverse=True) if sort else list(words)
    return "|".join(quote(w) for w in words)


def word_pattern(words) -> str:
    """Longest word first, each held between word boundaries, any case."""
    return "(?iU)(" + "|".join(rf"\b{quote(w)}\b" for w in sorted(words, key=len, reverse=True)) + ")"


def as_text(c: Column) -> Column:
    """A missing value reads as the word ``nan``, as the checks expect."""
    return F.coalesce(c.cast("string"), F.lit("nan"))


def strip_ws(c: Column) -> Column:
    return F.trim(c, F.lit(BLANKS))


def squeeze(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)\s+", " ")


def lower_key(c: Column) -> Column:
    return F.lower(strip_ws(as_text(c)))


def is_blank(c: Column) -> Column:
    """Null, empty, ``nan`` or ``None`` after trimming."""
    return F.coalesce(strip_ws(c.cast("string")), F.lit("")).isin("", "nan", "None", "NaN")


def nullify_blank(c: Column) -> Column:
    return F.when(~is_blank(c), c.cast("string"))


def num(c: Column) -> Column:
    """Number or null; text with trailing letters or thousands commas is not a number."""
    s = strip_ws(c.cast("string"))
    return F.when(s.rlike(NUMBER), s.try_cast("double"))


def clean_code(c: Column) -> Column:
    return F.coalesce(F.split_part(strip_ws(c.cast("string")), F.lit("."), F.lit(1)), F.lit(""))


def normalize_text(c: Column) -> Column:
    lowered = strip_ws(F.lower(c))
    kept = F.regexp_replace(lowered, rf"(?U)\b({'|'.join(NOISE_WORDS)})\b", "")
    return F.coalesce(F.regexp_replace(F.regexp_replace(kept, r"(?U)[^\w\s]", ""), r"(?U)\s+", ""),
                      F.lit(""))


def match_key(brand: Column, name: Column, color: Column) -> Column:
    return F.concat_ws("|", normalize_text(brand), normalize_text(name), normalize_text(color))


def extract_colors(text: Column, explicit: Column | None = None) -> Column:
    """Base colours named in ``text`` as words, or inside ``explicit`` anywhere; sorted."""
    lowered = F.lower(F.coalesce(text, F.lit("")))
    found = []
    for base, variants in COLOR_VARIANTS.items():
        hit = lowered.rlike(rf"(?U)\b({alternation(variants)})\b")
        if explicit is not None:
            hit = hit | F.coalesce(F.lower(explicit).rlike(alternation(variants)), F.lit(False))
        found.append(F.when(hit, F.lit(base)))
    return F.array_sort(F.array_compact(F.array(*found)))


def remove_attributes(c: Column) -> Column:
    every_color = [v for variants in COLOR_VARIANTS.values() for v in variants]
    base = F.lower(F.coalesce(c, F.lit("")))
    for pattern in (rf"(?U)\b({alternation(every_color)})\b",
                    rf"(?U)\b(?:{'|'.join(SIZE_WORDS)})\b",
                    "(?U)" + MEASURE_TOKEN,
                    rf"(?U)\b(?:{'|'.join(PROMO_WORDS)})\b"):
        base = F.regexp_replace(base, pattern, "")
    return strip_ws(squeeze(F.regexp_replace(base, r"(?U)[^\w\s]", " ")))


def product_attributes(name: Column, color: Column, brand: Column) -> Column:
    """Struct of base name, colours and the (always empty) size sets."""
    raw = F.coalesce(strip_ws(name), F.lit(""))
    base = remove_attributes(raw)
    b = F.lower(strip_ws(brand))
    prefixed = F.when(F.coalesce((b != "") & ~F.contains(base, b) & ~b.isin("generic", "fashion"),
                                 F.lit(False)), F.concat_ws(" ", b, base)).otherwise(base)
    empty = F.array().cast("array<string>")
    return F.struct(strip_ws(prefixed).alias("base_name"), extract_colors(raw, color).alias("colors"),
                    empty.alias("sizes"), empty.alias("storage"), empty.alias("memory"),
                    empty.alias("quantities"), raw.alias("raw_name"))


def matcher_text(c: Column) -> Column:
    cleaned = F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), r"[^a-z0-9\s]", " ")
    return strip_ws(F.regexp_replace(cleaned, r"\s+", " "))


def path_segments(path: Column) -> Column:
    """Segments split on ``/`` if present, else on ``>``; lower case, trimmed."""
    sep = F.when(F.contains(path, F.lit("/")), F.lit("/")).otherwise(F.lit(">"))
    return F.transform(F.split(path, sep), lambda s: F.lower(strip_ws(s)))


def path_top(path: Column) -> Column:
    return F.element_at(path_segments(path), 1)


def path_leaf(path: Column) -> Column:
    return F.element_at(path_segments(path), -1)


def title_case(c: Column) -> Column:
    """Every run of letters starts with a capital, also after digits and apostrophes."""
    runs = F.regexp_extract_all(c, F.lit(r"(\p{L}+|[^\p{L}]+)"), F.lit(1))
    return F.array_join(F.transform(runs, lambda r: F.concat(F.upper(F.substring(r, 1, 1)),
                                                            F.lower(F.substr(r, F.lit(2))))), "")


def fix_mojibake(c: Column) -> Column:
    for broken, repaired in MOJIBAKE:
        c = F.replace(c, F.lit(broken), F.lit(repaired))
    return strip_ws(c)


def drop_control(c: Column) -> Column:
    return F.regexp_replace(c, r"[\x00-\x08\x0B\x0C\x0E-\x1F]", "")


def strip_tags(c: Column) -> Column:
    return F.regexp_replace(c, "<[^<]+?>", "")


def variant_tokens(c: Column) -> Column:
    """Variant text cut at ``, | /``, else at spaces, else at camel-case borders."""
    s = strip_ws(c)
    camel = r"([A-Z]{2,}(?=[A-Z][a-z])|[A-Z]?[a-z]+|[A-Z]+|[0-9]+(?:\.[0-9]+)?)"
    parts = (F.when(s.rlike(r"[,|/]"), F.split(s, r"[,|/]"))
             .when(F.contains(s, F.lit(" ")), F.split(s, r"(?U)\s+"))
             .otherwise(F.regexp_extract_all(s, F.lit(camel), F.lit(1))))
    trimmed = F.transform(parts, strip_ws)
    return F.filter(trimmed, lambda p: p != "")


def is_size(c: Column) -> Column:
    return strip_ws(c).rlike(SIZE_VALUE)


def word_tokens(c: Column) -> Column:
    return F.filter(F.split(F.lower(c), r"(?U)[^\w]+"), lambda t: t != "")


def let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once, also where ``body`` loops over an array."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def sequences(tokens: Column, n: int) -> Column:
    """All sequences of ``n`` words of a token array."""
    starts = F.sequence(F.lit(1), F.size(tokens) - (n - 1))
    runs = F.transform(starts, lambda i: F.array_join(F.slice(tokens, i, n), " "))
    return F.when(F.size(tokens) >= n, runs).otherwise(F.array().cast("array<string>"))


def ngrams(tokens: Column, longest: int) -> Column:
    """Distinct 1..``longest``-word sequences of a token array."""
    return let(tokens, lambda t: F.array_distinct(F.concat(t, *[sequences(t, n) for n in range(2, longest + 1)])))
