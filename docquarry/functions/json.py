"""Lenient JSON from a model's answer, as Column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def once(x: Column, of: Callable[[Column], Column]) -> Column:
    """`of` an expression that is worked out once for a row, however often it is named there, and before any optimizer rule can copy it."""
    return F.get(F.transform(F.array(x), of), F.lit(0))


def _object(x: Column) -> Column:
    """The string, where it parses as a JSON object."""
    kind = F.schema_of_variant(F.try_parse_json(x))
    return F.when(kind.startswith("OBJECT"), x)


def first_object(x: Column) -> Column:
    """JSON of the object in a text: without code fences, else from the first brace to the last; null if neither parses."""
    bare = F.regexp_replace(F.trim(x), r"(?s)^```(?:json)?\s*|\s*```$", "")
    return F.coalesce(_object(bare), _object(F.nullif(F.regexp_extract(x, r"(?s)\{.*\}", 0), F.lit(""))))


def merged(default: dict, override: dict) -> dict:
    """A default with an override's values; objects are merged, and an explicit null overrides."""
    out = dict(default)
    for k, v in override.items():
        out[k] = merged(out[k], v) if isinstance(v, dict) and isinstance(out.get(k), dict) else v
    return out


def any_key(x: Column, *keys: str) -> Column:
    """The first key's value that is there, as text."""
    return F.coalesce(*[F.get_json_object(x, f"$.{k}") for k in keys])


def citation(title: Column, year: Column, journal: Column) -> Column:
    """Title, year and journal, without blank ones."""
    return F.concat_ws(", ", *[F.nullif(F.trim(c.cast("string")), F.lit("")) for c in (title, year, journal)])
