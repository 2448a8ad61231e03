"""Mentions of figures, tables, equations and references in a text, as arrays of strings."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# The forms of identifiers, of the blocks after a keyword, and of citations.
ARABIC = r"[A-Za-z]?\d+(?:\.\d+)*[A-Za-z]?"
ROMAN = "XX|XIX|XVIII|XVII|XVI|XV|XIV|XIII|XII|XI|X|IX|VIII|VII|VI|V|IV|III|II|I"
NUMBER = f"(?:{ARABIC}|(?:{ROMAN}))"
FIGURE, TABLE = r"(?i:fig(?:ure)?s?\.?)", r"(?i:table(?:s)?\.?)"
BLOCK = rf"\s*((?:{NUMBER}(?:\([a-zA-Z]\))?[\s,]*(?:(?i:and)\s+)?)+)"
CANDIDATE = rf"(?<![A-Za-z0-9])({NUMBER})(?:\([a-zA-Z]\))?(?![A-Za-z0-9])"
PLACEHOLDER = r"\[EQUATION:(eq_\d+)\]"
EQUATION = r"(?i)(?<![A-Za-z])(?:Equation|Eq\.|Formula)\s*(?:\(\s*(\d+(?:\.\d+)*)\s*\)|(\d+(?:\.\d+)*))(?![A-Za-z])"
BRACKETS = r"\[(.*?)\]"
CITED = r"^\s*(\d+)\s*(?:-\s*(\d+)\s*)?$"
#: Numbers that an array can hold; a wider range can't be one.
ARRAY = 2_147_483_632


def _all(x: Column, pattern: str, group: int) -> Column:
    return F.regexp_extract_all(x, F.lit(pattern), F.lit(group))


def _sorted(items: Column) -> Column:
    return F.array_sort(F.array_distinct(items))


def _where(x: Column, found: Column, *words: str) -> Column:
    """What is found in texts that have one of the words in either case; nothing is looked for in others."""
    low = F.lower(F.coalesce(x, F.lit("")))
    return F.when(reduce(lambda a, b: a | b, [low.contains(w) for w in words]), found).otherwise(F.array().cast("array<string>"))


def numbered(x: Column, keyword: str, prefix: str, word: str) -> Column:
    """Identifiers after a keyword, which holds `word`, as 'prefix identifier', distinct and sorted by code point."""
    blocks = _all(F.coalesce(x, F.lit("")), rf"\b{keyword}{BLOCK}", 1)
    found = F.flatten(F.transform(blocks, lambda b: _all(F.regexp_replace(b, r"(?i:\band\b)|&", ","), CANDIDATE, 1)))
    return _where(x, _sorted(F.transform(found, lambda n: F.concat(F.lit(f"{prefix} "), n))), word)


def figures(x: Column) -> Column:
    return numbered(x, FIGURE, "Fig.", "fig")


def tables(x: Column) -> Column:
    return numbered(x, TABLE, "Table", "table")


def equations(x: Column) -> Column:
    """eq_<n> for placeholders, eqnum::<number> for numbers."""
    x = F.coalesce(x, F.lit(""))
    ids = _all(x, PLACEHOLDER, 1)
    numbers = F.zip_with(_all(x, EQUATION, 1), _all(x, EQUATION, 2), lambda a, b: F.concat(F.lit("eqnum::"), F.when(a != "", a).otherwise(b)))
    return _where(x, _sorted(F.concat(ids, numbers)), "eq", "formula")


def citation_spans(x: Column) -> Column:
    """Bracketed numbers and ascending ranges, as structs (first, last), in the order of the text; numbers beyond 64 bits count nothing."""
    blocks = F.filter(_all(F.coalesce(x, F.lit("")), BRACKETS, 1), lambda b: b.rlike(r"\d"))
    parts = F.flatten(F.transform(blocks, lambda b: F.split(F.translate(b, "–—", "--"), ",")))
    number = lambda p, group: F.regexp_extract(p, CITED, group).try_cast("long")
    ends = F.transform(parts, lambda p: F.struct(number(p, 1).alias("first"), number(p, 2).alias("last"), (F.regexp_extract(p, CITED, 2) != "").alias("range")))
    spans = F.transform(ends, lambda s: F.struct(s["first"].alias("first"), F.when(s["range"], s["last"]).otherwise(s["first"]).alias("last")))
    return F.filter(spans, lambda s: s["last"] >= s["first"])


def citations(x: Column) -> Column:
    """ref_<n> of bracketed numbers and ranges, distinct and sorted; a range that no array can hold gives none (see citation_spans)."""
    held = F.filter(citation_spans(x), lambda s: s["last"] - s["first"] < ARRAY)
    runs = F.transform(held, lambda s: F.sequence(s["first"], s["last"], F.lit(1).cast("long")))
    return _where(x, _sorted(F.transform(F.flatten(runs), lambda n: F.concat(F.lit("ref_"), n.cast("string")))), "[")
