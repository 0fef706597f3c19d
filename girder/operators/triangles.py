"""Triangles that an element shows twice."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from girder.operators.keyed import meet
from girder.sources.shared import written

#: Corners are equal where they agree after this scaling and rounding; areas where they differ by no more than this.
CORNER, AREA = 1e6, 1e-12


def corners(scale: float = CORNER) -> Column:
    """The three corners (x0, y0, z0 ... z2) on a grid, sorted: the same whatever the order and direction."""
    at = lambda k: F.struct(*[F.floor(F.col(f"{a}{k}") * scale + 0.5).alias(a) for a in "xyz"])
    return F.array_sort(F.array(at(0), at(1), at(2)))


def triangle_area() -> Column:
    a, b = ([F.col(f"{c}{k}") - F.col(f"{c}0") for c in "xyz"] for k in (1, 2))
    cross = [a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]]
    return F.sqrt(cross[0] * cross[0] + cross[1] * cross[1] + cross[2] * cross[2]) / 2


def duplicates(triangles: DataFrame, preferred: DataFrame, element: str, ordinal: str, material: str) -> DataFrame:
    """(element, ordinal, kept, other_material): triangles with an equal one in their element, the first told from the rest.

    ``triangles`` (element, ordinal: unique, material or null, x0 ... z2) without an
    element are in no group. Of equal ones that of a preferred material (element,
    material) stays, then that whose material covers the larger area of the element, then
    the larger material id (none is the smallest), then the smaller ordinal. Areas that
    differ by no more than AREA count as equal by rounding. ``other_material`` tells of
    one that goes whether its material is another than that of the one that stays.
    """
    rows = written(triangles.filter(F.col(element).isNotNull()).select(element, ordinal, F.coalesce(F.col(material).cast("long"), F.lit(-1)).alias("m_"), corners().alias("c_"), triangle_area().alias("area_")), "triangles")
    support = rows.groupBy(element, "m_").agg(F.sum("area_").alias("support_"), F.count("*").alias("n_"))
    liked = preferred.select(element, F.col(material).cast("long").alias("m_")).distinct().withColumn("liked_", F.lit(1))
    facts = written(support.join(liked, [element, "m_"], "left").select(element, "m_", F.coalesce("liked_", F.lit(0)).alias("liked_"), F.round(F.col("support_") / (2 * AREA)).alias("support_"), "n_"), "triangle-support")
    # an element's equal triangles of one material differ by their ordinals alone
    groups = rows.groupBy(element, "c_", "m_").agg(F.min(ordinal).alias("first_"), F.count("*").alias("k_"))
    ranked = meet(groups, facts.drop("n_").join(groups.groupBy(element, "m_").agg(F.count("*").alias("n_")), [element, "m_"]), [element, "m_"], "n_")
    best = ranked.groupBy(element, "c_").agg(F.max(F.struct("liked_", "support_", "m_", (-F.col("first_")).alias("less_"))).alias("b_"), F.sum("k_").alias("k_")).filter("k_ > 1")
    told = meet(rows, best.select(element, "c_", F.col("b_.m_").alias("won_"), (-F.col("b_.less_")).alias("first_"), "k_"), [element, "c_"], "k_")
    kept = F.col(ordinal) == F.col("first_")
    return told.select(element, ordinal, kept.alias("kept"), (~kept & (F.col("m_") != F.col("won_"))).alias("other_material"))


def without_duplicates(triangles: DataFrame, preferred: DataFrame, element: str, ordinal: str, material: str) -> DataFrame:
    """Triangles without those that an equal one of their element replaces."""
    gone = duplicates(triangles, preferred, element, ordinal, material).filter("not kept").select(ordinal)
    return triangles.join(gone, ordinal, "left_anti").select(*triangles.columns)
