"""Scalar functions on text and values, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def basename(c: Column) -> Column:
    return F.regexp_extract(c, r"([^/]*)$", 1)


def stem(c: Column) -> Column:
    """Base name without its last extension; a leading dot is part of the name."""
    b = basename(c)
    return F.when(b.rlike(r"^\.*[^.]+\.[^.]*$|^[^.].*\.[^.]*$"), F.regexp_extract(b, r"^(.+)\.[^.]*$", 1)).otherwise(b)


def head(c: Column, sep: str = "/") -> Column:
    """Text before the first sep, empty if there is none."""
    return F.when(F.contains(c, F.lit(sep)), F.substring_index(c, sep, 1)).otherwise("")


def short_name(c: Column) -> Column:
    return F.substring_index(c, "-", 1)


def row_identity(*parts: Column) -> Column:
    """First 24 hex digits of the SHA-256 of the parts, joined by the unit
    separator. NULL if a part is NULL."""
    joined = parts[0].cast("string")
    for p in parts[1:]:
        joined = F.concat(joined, F.lit("\x1f"), p.cast("string"))
    return F.substring(F.sha2(joined, 256), 1, 24)


def safe_path(c: Column) -> Column:
    """Relative, not empty, without a step up."""
    return c.isNotNull() & (c != "") & ~c.startswith("/") & ~F.array_contains(F.split(c, "/"), "..")


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def close(a: Column, b: Column, tolerance: float = 0.01) -> Column:
    return F.abs(a - b) <= tolerance * F.greatest(F.abs(a), F.abs(b), F.lit(1e-9))


def masked(c: Column, pattern: str, by: str = "<x>") -> Column:
    """The first group of pattern stays, what follows it is masked."""
    return F.regexp_replace(c, pattern, "$1" + by)


def finite(v: Column) -> Column:
    return F.forall(v, lambda x: ~F.isnan(x) & (F.abs(x) != float("inf")))


def utc_stamp(c: Column) -> Column:
    """A time as 2026-01-31T08:05:09Z. The session's time zone has to be UTC, as
    session() sets it."""
    return F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def milliseconds(c: Column) -> Column:
    return F.when(c.isNotNull(), F.format_string("%.3f ms", c))


def padded(c: Column, width: int = 3) -> Column:
    """A whole number with zeros in front."""
    return F.when(c.isNotNull(), F.format_string(f"%0{width}d", c))


def without_prefix(c: Column, prefix: str) -> Column:
    return F.when(c.startswith(prefix), F.substring(c, F.lit(len(prefix) + 1), F.length(c))).otherwise(c)


def percent(c: Column, digits: int = 4) -> Column:
    return F.when(c.isNotNull(), F.format_string(f"%.{digits}f%%", 100 * c))


def times(c: Column) -> Column:
    return F.when(c.isNotNull(), F.format_string("%.2fx", c))


def truthy(c: Column, kind: str) -> Column:
    """NULL, empty text and 0 are false."""
    return c.isNotNull() & (c != ("" if kind == "string" else 0))


def parse_json(c: Column) -> Column:
    """The text as VARIANT; NULL unless all of it is one JSON value. (The parser
    alone stops after the first value, so the text is parsed as the only element
    of an array.) A repeated key in an object counts as not valid."""
    items = F.try_parse_json(F.concat(F.lit("["), c, F.lit("]")))
    return F.when(F.try_variant_get(items, "$[1]", "variant").isNull(), F.try_variant_get(items, "$[0]", "variant"))
