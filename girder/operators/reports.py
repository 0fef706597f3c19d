"""Reports: coverage, censuses and counts over whole models."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def coverage_by_element(products: DataFrame, type_: str, tag: str, sets: Mapping[str, DataFrame], mesh: DataFrame, drawn: str = "drawn", outside: Sequence[str] = ()) -> DataFrame:
    """(type, in_ifc, a count for each set, with_mesh, drawn_of_with_mesh) over the distinct tags of each type, and a row ``total`` without the types ``outside``."""
    out = products.select(F.col(type_).alias("type"), F.col(tag).alias("tag_")).filter("type is not null and tag_ is not null").distinct()
    for name, ids in {**sets, "with_mesh": mesh}.items():
        out = out.join(ids.select(F.col(ids.columns[0]).alias("tag_")).distinct().withColumn(f"{name}_", F.lit(1)), "tag_", "left")
    counts = [F.count("*").alias("in_ifc"), *[F.count(f"{n}_").alias(n) for n in sets], F.count("with_mesh_").alias("with_mesh"), F.count(F.when(F.col("with_mesh_").isNotNull(), F.col(f"{drawn}_"))).alias("drawn_of_with_mesh")]
    rows = out.groupBy("type").agg(*counts)
    sums = [F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in rows.columns[1:]]
    inside = rows.filter(~F.col("type").isin(*outside)) if outside else rows
    return rows.unionByName(inside.agg(*sums).select(F.lit("total").alias("type"), *rows.columns[1:]))


def stream_coverage(streams: DataFrame, depth: str) -> DataFrame:
    """One row (full_streams, partial_streams, undecoded_streams)."""
    return streams.agg(*[F.count_if(F.col(depth) == d).alias(n) for d, n in (("full", "full_streams"), ("partial", "partial_streams"), ("none", "undecoded_streams"))])


def model_tree(relations: Mapping[str, DataFrame], element: str) -> DataFrame:
    """One row: the number of relations of each kind, of all, and of distinct members of any."""
    whole = None
    for name, rows in relations.items():
        one = rows.select(F.col(element).alias("member_"), F.lit(name).alias("kind_"))
        whole = one if whole is None else whole.unionByName(one)
    counted = whole.groupBy("member_").agg(*[F.count_if(F.col("kind_") == n).alias(n) for n in relations])
    sums = [F.coalesce(F.sum(n), F.lit(0)) for n in relations]
    total = sums[0]
    for s in sums[1:]:
        total = total + s
    return counted.agg(*[s.alias(f"{n}_memberships") for s, n in zip(sums, relations, strict=True)], total.alias("memberships"), F.count("*").alias("unique_members"))


def limit_census(rows: DataFrame, limits: Mapping[str, Column]) -> DataFrame:
    """(limit_name, rejections) of the limits that reject some row, by the number of rows; a row counts for every limit that rejects it."""
    hit = F.filter(F.array(*[F.when(c, F.lit(n)) for n, c in limits.items()]), lambda x: x.isNotNull())
    return rows.select(F.explode(hit).alias("limit_name")).groupBy("limit_name").agg(F.count("*").alias("rejections"))


def floor_plate_levels(levels: DataFrame, relations: DataFrame, floors: DataFrame, level: str, element: str) -> DataFrame:
    """Levels on which there are floors, with ``floor_count``, the number of distinct ones."""
    on = relations.select(level, element).join(floors.select(F.col(floors.columns[0]).alias(element)), element, "left_semi").distinct()
    return levels.join(on.groupBy(level).agg(F.count("*").alias("floor_count")), level)


def sampled_markers(pages: DataFrame, page: str, marker: str, count: str, sample: int, support: int = 24, top: int = 12) -> DataFrame:
    """(marker, n): markers summed over about ``sample`` pages (every stride-th by number), of enough support, the most frequent first. Pages are numbered from 0."""
    whole = pages.agg((F.max(page) + 1).alias("pages_"))  # one row
    stride = F.greatest(F.lit(1), F.floor(F.col("pages_") / sample))
    kept = pages.crossJoin(whole).filter(F.col(page) % stride == 0)
    sums = kept.groupBy(marker).agg(F.sum(count).alias("n")).filter(F.col("n") >= support)
    return sums.orderBy(F.desc("n"), marker).limit(top)
