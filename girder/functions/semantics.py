"""Scalar rules that differ from Spark's built-ins, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space of every script, for trimming.
UNICODE_SPACE = r"[\s   -     　﻿]+"


def round_half_up(x: Column) -> Column:
    """Nearest whole number, halves towards plus infinity."""
    return F.floor(x + 0.5)


def upper_median_rank(n: Column) -> Column:
    """1-based rank of the upper median of n sorted values."""
    return F.floor(n / 2).cast("long") + 1


def upper_median(values: Column) -> Column:
    """Upper median of an array of bounded length."""
    ordered = F.array_sort(values)
    return F.try_element_at(ordered, upper_median_rank(F.size(values)).cast("int"))


def leading_integer(text: Column) -> Column:
    """The whole number at the start of a text, null if there is none."""
    return F.nullif(F.regexp_extract(text, r"^\s*([+-]?\d+)", 1), F.lit("")).cast("long")


def trim_all(text: Column) -> Column:
    """``text`` without white space of any kind at its ends."""
    return F.regexp_replace(text, f"^{UNICODE_SPACE}|{UNICODE_SPACE}$", "")


def fnv1a(text: Column) -> Column:
    """32-bit FNV-1a over the text's UTF-16 code units, as a long."""
    units = F.transform(F.sequence(F.lit(1), F.length(F.hex(F.encode(text, "UTF-16BE"))), F.lit(4)), lambda i: F.conv(F.substring(F.hex(F.encode(text, "UTF-16BE")), i, F.lit(4)), 16, 10).cast("long"))
    step = lambda h, u: F.pmod(h.bitwiseXOR(u) * F.lit(16777619), F.lit(1 << 32))
    return F.when(F.length(text) == 0, F.lit(2166136261)).otherwise(F.aggregate(units, F.lit(2166136261).cast("long"), step))


def numeric_key(text: Column) -> Column:
    """Sort key by which runs of digits compare as numbers: an array of (number, text) parts."""
    return F.transform(F.regexp_extract_all(text, F.lit(r"\d+|\D+"), F.lit(0)), lambda x: F.struct(x.try_cast("long").alias("number"), x.alias("text")))


def humanise(name: Column, prefix: str = "OST_") -> Column:
    """``OST_CurtainWallPanels`` as ``Curtain Wall Panels``."""
    bare = F.when(name.startswith(prefix), F.substring(name, F.lit(len(prefix) + 1), F.length(name))).otherwise(name)
    return F.regexp_replace(bare, r"(?<=[a-z0-9])(?=[A-Z])", " ")


def base_name(path: Column, suffix: str = "_cat") -> Column:
    """A file's name without folder, extension and suffix, in lower case."""
    name = F.regexp_replace(F.regexp_extract(path, r"([^/\\]*)$", 1), r"\.[^.]*$", "")
    return F.lower(F.regexp_replace(name, f"(?i){suffix}$", ""))


def alphanumeric(text: Column) -> Column:
    """Lower-case letters and digits of a text."""
    return F.regexp_replace(F.lower(text), "[^a-z0-9]", "")


def any_contains(query: str, *fields: Column) -> Column:
    """Whether any field holds the query, in any case; an empty query holds for every row."""
    needle = query.strip().lower()
    if not needle:
        return F.lit(True)
    out = F.lit(False)
    for field in fields:
        out = out | F.coalesce(F.lower(field).contains(needle), F.lit(False))
    return out


def csv_field(text: Column) -> Column:
    """A field quoted where a comma, quote or line feed needs it."""
    return F.when(text.rlike('[,"\r\n]'), F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(text)


def apply_affine(x: Column, y: Column, a: Column, b: Column, e: Column, f: Column) -> tuple[Column, Column]:
    """A similarity (a, b: rotation and scale; e, f: shift) applied to a point."""
    return a * x - b * y + e, b * x + a * y + f


def affine_parts(a: Column, b: Column) -> tuple[Column, Column]:
    """Scale and rotation in degrees of a similarity."""
    return F.hypot(a, b), F.degrees(F.atan2(b, a))


def polygon_area(ring: Column) -> Column:
    """Area of a closed ring, an array of points (x, y) in order; 0 for fewer than three."""
    after = F.concat(F.slice(ring, F.lit(2), F.size(ring)), F.slice(ring, F.lit(1), F.lit(1)))
    cross = F.zip_with(ring, after, lambda a, b: a["x"] * b["y"] - b["x"] * a["y"])
    return F.when(F.size(ring) < 3, 0.0).otherwise(F.abs(F.aggregate(cross, F.lit(0.0), lambda acc, x: acc + x)) / 2)


def polyline_length(points: Column) -> Column:
    """Length of a line through points (x, y) in order."""
    steps = F.zip_with(F.slice(points, F.lit(1), F.greatest(F.size(points) - 1, F.lit(0))), F.slice(points, F.lit(2), F.size(points)), lambda a, b: F.hypot(b["x"] - a["x"], b["y"] - a["y"]))
    return F.aggregate(steps, F.lit(0.0), lambda acc, x: acc + x)
