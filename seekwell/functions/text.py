"""Text analysis as column expressions: folding, tokens, stems, normalised queries, trigrams."""

from __future__ import annotations

import unicodedata
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

TOKEN = r"[\p{L}\p{Nd}]+"


@lru_cache(maxsize=1)
def fold_table() -> tuple[str, str]:
    """Characters of the basic plane whose canonical decomposition is one character and marks, and that character."""
    source, target = [], []
    for code in range(0x80, 0xFFFF):
        c = chr(code)
        if 0xD800 <= code <= 0xDFFF or unicodedata.category(c) == "Mn":
            continue
        base = unicodedata.normalize("NFC", "".join(x for x in unicodedata.normalize("NFD", c) if unicodedata.category(x) != "Mn"))
        if len(base) == 1 and base != c:
            source.append(c)
            target.append(base)
    return "".join(source), "".join(target)


def fold(text: Column) -> Column:
    """Text without diacritics; plain ASCII is left as it is."""
    source, target = fold_table()
    return F.when(text.rlike(r"[^\x00-\x7F]"), F.regexp_replace(F.translate(text, source, target), r"\p{Mn}+", "")).otherwise(text)


def tokenize(text: Column) -> Column:
    """Lower-cased runs of letters and digits, in order, duplicates kept; null gives no tokens."""
    return F.regexp_extract_all(F.lower(fold(F.coalesce(text, F.lit("")))), F.lit(TOKEN), F.lit(0))


def stem(token: Column) -> Column:
    """A final ``s`` off tokens of four letters or more that do not end in ss, us or is and hold no digit."""
    plural = token.endswith("s") & token.rlike(r"^[^\p{Nd}]{3,}s$") & ~token.rlike("(?:ss|us|is)$")  # most tokens need no pattern
    return F.when(plural, F.substring(token, F.lit(1), F.length(token) - 1)).otherwise(token)


def terms(text: Column) -> Column:
    """Stemmed tokens."""
    return F.transform(tokenize(text), stem)


def normalize_query(text: Column) -> Column:
    """Trimmed, white space collapsed, lower-cased, without closing punctuation."""
    flat = F.lower(F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " ")))
    return F.regexp_replace(flat, r"[.!?,; ]+$", "")


def query_key(query: Column, user: Column, generation: Column) -> Column:
    """Key under which the answer to a query is kept: index generation, user and normalised text."""
    return F.concat_ws("|", generation.cast("string"), F.coalesce(user.cast("string"), F.lit("-")), normalize_query(query))


def trigrams(tokens: Column) -> Column:
    """Distinct character trigrams of tokens joined by spaces; none for fewer than three characters.

    One pass of a pattern that looks ahead.  It steps by code units, so texts with characters beyond the basic plane have theirs laid
    beside their successors instead.
    """
    beside = lambda c, k: F.slice(c, F.lit(k), F.greatest(F.size(c) - k + 1, F.lit(0)))
    wide = lambda s: F.transform(F.array(F.split(s, "")), lambda c: F.zip_with(F.zip_with(c, beside(c, 2), lambda a, b: F.concat(a, b)), beside(c, 3), lambda a, b: F.concat(a, b)))[0]
    plain = lambda s: F.regexp_extract_all(s, F.lit("(?s)(?=(...))"), F.lit(1))
    grams = F.transform(F.array(F.array_join(tokens, " ")), lambda s: F.when(s.rlike(r"[\x{10000}-\x{10FFFF}]"), F.filter(wide(s), lambda g: g.isNotNull())).otherwise(plain(s)))[0]
    return F.array_distinct(grams)


def word_count(text: Column) -> Column:
    """Runs of anything but white space."""
    return F.size(F.filter(F.split(F.coalesce(text, F.lit("")), r"\s+"), lambda w: w != ""))


def shorten(text: Column, most: int) -> Column:
    """At most max(10, most) characters, cut at the last space if that lies past the half, with an ellipsis."""
    n = max(10, most)
    head = F.substring(text, 1, n)
    words = F.regexp_extract(head, r"^(.*) [^ ]*$", 1)
    cut = F.when(F.length(words) > n // 2, words).otherwise(head)
    return F.when(F.length(text) <= n, text).otherwise(F.concat(F.regexp_replace(cut, r"[,; \-]+$", ""), F.lit("…")))


def loose_match(a: Column, b: Column) -> Column:
    """Whether one of two titles holds the other, letters and digits only."""
    x, y = (F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), "[^a-z0-9]+", "") for c in (a, b))
    return (x != "") & (y != "") & (x.contains(y) | y.contains(x))


def strip(text: Column) -> Column:
    """The text without white space of any kind at its ends."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def blank(text: Column) -> Column:
    """Null, empty or white space only."""
    return F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " ")) == ""


def distinct_folded(values: Column, most: int | None = None) -> Column:
    """Trimmed non-blank strings, the first of those equal but for case, in order."""
    kept = F.filter(F.transform(F.coalesce(values, F.array().cast("array<string>")), lambda v: F.trim(v)), lambda v: v.isNotNull() & (v != ""))
    first = F.transform(F.array(kept), lambda k: F.transform(F.array(F.transform(k, F.lower)), lambda low: F.filter(k, lambda v, i: F.array_position(low, F.lower(v)) == i + 1))[0])[0]
    return first if most is None else F.slice(first, 1, most)
