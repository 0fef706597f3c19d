"""Display texts, instants and frames of coordinates, as column expressions; null where what they are made from is null."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: feet in a metre, as paired exports are read.
FEET_PER_METRE = 3.280839895
#: Milliseconds in a minute, an hour and a day.
MINUTE, HOUR, DAY = 60_000, 3_600_000, 86_400_000


def format_bytes(count: Column) -> Column:
    """``512 B``, ``1.5 KB``, ``230 MB``: one decimal below 100, none from there on, halves up; GB is the largest unit. Computed in whole numbers, so no binary fraction is rounded twice."""

    def of(power: int, name: str) -> Column:
        unit = 1 << power
        whole, tenths = F.shiftright(count + (unit >> 1), power), F.shiftright(count * 10 + (unit >> 1), power)
        fine = F.concat(F.floor(tenths / 10).cast("string"), F.lit("."), (tenths % 10).cast("string"))
        return F.concat(F.when(count >= 100 * unit, whole.cast("string")).otherwise(fine), F.lit(f" {name}"))

    return F.when(count < 1 << 10, F.concat(count.cast("string"), F.lit(" B"))).when(count < 1 << 20, of(10, "KB")).when(count < 1 << 30, of(20, "MB")).otherwise(of(30, "GB"))


def format_number(value: Column) -> Column:
    """Grouped by thousands with one decimal at most, halves away from zero; what rounds to zero from below keeps its sign."""
    near = F.round(value, 1)
    text = F.call_function("format_number", near, F.lit("#,##0.#"))
    return F.when((value < 0) & (near == 0), F.lit("-0")).otherwise(text)


def relative_time(then: Column, now: Column) -> Column:
    """How long before ``now`` (both milliseconds) something was; what lies ahead is ``just now``."""
    elapsed = F.greatest(now - then, F.lit(0).cast("long"))
    elapsed = F.when(then.isNull() | now.isNull(), None).otherwise(elapsed)
    count = lambda unit: F.floor(elapsed / unit).cast("string")
    return (
        F.when(elapsed < MINUTE, "just now")
        .when(elapsed < HOUR, F.concat(count(MINUTE), F.lit(" min ago")))
        .when(elapsed < DAY, F.concat(count(HOUR), F.lit(" h ago")))
        .when(elapsed < 2 * DAY, "yesterday")
        .when(elapsed < 7 * DAY, F.concat(count(DAY), F.lit(" days ago")))
        .when(elapsed < 14 * DAY, "last week")
        .when(elapsed.isNotNull(), F.concat(count(7 * DAY), F.lit(" weeks ago")))
    )


def output_name(source: Column, extension: str, default: str) -> Column:
    """The name of a file made from ``source``: without its extension, signs as single hyphens, none at the ends, ``default`` if nothing is left."""
    bare = F.regexp_replace(F.regexp_replace(source, r"\.[^.]+$", ""), r"(?i)[^a-z0-9_-]+", "-")
    name = F.concat(F.coalesce(F.nullif(F.regexp_replace(bare, "^-|-$", ""), F.lit("")), F.lit(default)), F.lit(f"-recovered.{extension}"))
    return F.when(source.isNotNull(), name)


def extension_label(name: Column) -> Column:
    """The extension in capitals, four letters at most; ``FILE`` without one."""
    last = F.regexp_extract(name, r"([^.]*)$", 1)
    return F.when(name.isNull(), None).when((last == "") | (last == name), "FILE").otherwise(F.substring(F.upper(last), 1, 4))


def instant(text: Column) -> Column:
    """The moment that a date text tells, in any offset; null for what is none."""
    return F.try_to_timestamp(text)


def model_point(x: Column, y: Column, z: Column) -> tuple[Column, Column, Column]:
    """A point of an export (metres, y up) in the model's frame (feet, z up)."""
    return x * FEET_PER_METRE, -z * FEET_PER_METRE, y * FEET_PER_METRE


#: The one release whose duplicated bounds are read, and its decoder.
BOUNDS_RELEASE, BOUNDS_DECODER = 2027, "revit-2027-duplicated-bounds-v1"


def release_plan(version: Column) -> Column:
    """(release, profile_decoder, bounds_decoder, coordinate_scanner) of a release: null for what isn't a whole number; no release has a profile decoder, every one the scanner."""
    release = F.when(F.floor(version) == version, version.cast("int"))
    bounds = F.when(release == BOUNDS_RELEASE, BOUNDS_DECODER)
    return F.struct(release.alias("release"), F.lit(None).cast("string").alias("profile_decoder"), bounds.alias("bounds_decoder"), F.lit(True).alias("coordinate_scanner"))
