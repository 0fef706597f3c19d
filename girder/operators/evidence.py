"""Evidence about elements: validated identities, tag matches, materials and layers, censuses and labels."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def identity_join(elements: DataFrame, episodes: DataFrame, element: str, references: Sequence[str], episode: str, value: str) -> DataFrame:
    """(element, value) by the first reference, all or nothing: if any reference is unknown, or an element or an episode stands twice, the result is empty."""
    known = episodes.groupBy(episode).agg(F.first(value).alias(value), F.count("*").alias("times_"))
    broken = elements.groupBy(element).agg(F.count("*").alias("times_")).filter("times_ > 1").select(F.lit(1).alias("x"))
    broken = broken.unionByName(known.filter("times_ > 1").select(F.lit(1).alias("x")))
    for r in references:
        broken = broken.unionByName(elements.select(F.col(r).alias(episode)).join(known, episode, "left_anti").select(F.lit(1).alias("x")))
    joined = elements.select(element, F.col(references[0]).alias(episode)).join(known.select(episode, value), episode).select(element, value)
    verdict = broken.agg(F.count("*").alias("broken_"))
    return joined.crossJoin(verdict).filter("broken_ = 0").drop("broken_")  # one row of verdict


def tag_join(rows: DataFrame, tag: str, sets: Mapping[str, DataFrame], both: str = "both", neither: str = "none") -> DataFrame:
    """Rows with ``evidence``: the only set (of two or more) that knows the tag, ``both`` if the first two do, the first that does otherwise."""
    out, names = rows, list(sets)
    for name, ids in sets.items():
        out = out.join(ids.select(F.col(ids.columns[0]).alias(tag)).distinct().withColumn(f"in_{name}_", F.lit(True)), tag, "left")
    has = {n: F.col(f"in_{n}_").isNotNull() for n in names}
    label = F.when(has[names[0]] & has[names[1]], both)
    for n in names:
        label = label.when(has[n], n)
    return out.withColumn("evidence", label.otherwise(neither)).drop(*[f"in_{n}_" for n in names])


def poisoned_map(candidates: DataFrame, key: str, group: str, part: str, value: str) -> DataFrame:
    """(key, part, value) of keys all of whose groups give one and the same map; a conflict poisons the key."""
    maps = candidates.groupBy(key, group).agg(F.array_sort(F.collect_set(F.struct(part, value))).alias("map_"))  # one definition's parts
    agreed = maps.groupBy(key).agg(F.min("map_").alias("map_"), F.max("map_").alias("high_")).filter("map_ = high_")
    return agreed.select(key, F.explode("map_").alias("p")).select(key, f"p.{part}", f"p.{value}")


def layer_definitions(layers: DataFrame, materials: DataFrame, type_: str, layer: str, material: str, known: str) -> DataFrame:
    """Layers of types all of whose materials are known (a null material is no reference)."""
    bad = layers.filter(F.col(material).isNotNull()).join(materials.select(F.col(known).alias(material)), material, "left_anti").select(type_).distinct()
    return layers.join(bad, type_, "left_anti")


def total_width(layers: DataFrame, type_: str, width: str) -> DataFrame:
    return layers.groupBy(type_).agg(F.sum(width).alias("total_width"))


def single_material(assignments: DataFrame, element: str, material: str) -> DataFrame:
    """(element, material) of elements with exactly one material."""
    one = assignments.groupBy(element).agg(F.min(material).alias(material), F.max(material).alias("high_"))
    return one.filter(F.col(material) == F.col("high_")).drop("high_")


def material_palette(materials: DataFrame, assignments: DataFrame, material: str, element: str) -> DataFrame:
    """Materials with the number of distinct elements that bear them."""
    counts = assignments.select(material, element).distinct().groupBy(material).agg(F.count("*").alias("elements"))
    return materials.join(counts, material, "left").fillna({"elements": 0})


def occurrences(rows: DataFrame, name: str, ordinal: str) -> DataFrame:
    """(name, n): names counted in any case, in the first spelling seen."""
    spelled = rows.filter(F.col(name).isNotNull()).groupBy(F.lower(name).alias("key_")).agg(F.min_by(name, ordinal).alias("name"), F.count("*").alias("n"))
    return spelled.select("name", "n")


def counts_by(rows: DataFrame, name: str, missing: str) -> DataFrame:
    """(name, n), nulls under ``missing``."""
    return rows.groupBy(F.coalesce(F.col(name), F.lit(missing)).alias("name")).agg(F.count("*").alias("n"))


def densest_regions(rows: DataFrame, cells: Mapping[str, Column], top: int = 20) -> DataFrame:
    """The ``top`` cells with most rows, on ties by cell."""
    return rows.groupBy(*[c.alias(n) for n, c in cells.items()]).agg(F.count("*").alias("n")).orderBy(F.desc("n"), *cells).limit(top)


def evidence_sets(rows: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """The sorted distinct values of each column for each key; columns hold few distinct values."""
    return rows.groupBy(*keys).agg(*[F.array_sort(F.collect_set(c)).alias(c) for c in columns])


def labelled(value: Column, rules: Sequence[tuple[Column, str]], otherwise: str) -> Column:
    """The label of the first rule that holds."""
    out = F.when(rules[0][0], rules[0][1])
    for condition, label in rules[1:]:
        out = out.when(condition, label)
    return out.otherwise(otherwise)


def suppressed(rows: DataFrame, key: str, *ids: DataFrame) -> DataFrame:
    """Rows whose key is in none of the id sets (each of one column)."""
    for x in ids:
        rows = rows.join(x.select(F.col(x.columns[0]).alias(key)), key, "left_anti")
    return rows


def curtain_helpers(ownership: DataFrame, resolved: DataFrame, element: str, owner: str) -> DataFrame:
    """Elements whose owner owns some resolved element, and that aren't resolved themselves."""
    ids = resolved.select(F.col(resolved.columns[0]).alias(element)).distinct()
    owners = ownership.join(ids, element, "left_semi").select(owner).distinct()
    return ownership.join(owners, owner, "left_semi").join(ids, element, "left_anti").select(element, owner)


def nearest_reading(rows: DataFrame, element: str, errors: Mapping[str, Column]) -> DataFrame:
    """(element, reading, error): the reading with the smallest error, on ties the first named."""
    named = F.array(*[F.struct(e.cast("double").alias("error"), F.lit(k).alias("k"), F.lit(n).alias("reading")) for k, (n, e) in enumerate(errors.items())])
    best = F.array_min(F.filter(named, lambda x: x["error"].isNotNull()))
    return rows.groupBy(element).agg(F.min(best).alias("b")).select(element, "b.reading", "b.error")


def difference_tally(left: DataFrame, right: DataFrame, key: str, value: str, tolerance: float) -> DataFrame:
    """One row (compared, aligned, different): values within the tolerance (strictly) are aligned."""
    joined = left.select(key, F.col(value).alias("a_")).join(right.select(key, F.col(value).alias("b_")), key)
    near = F.abs(F.col("a_") - F.col("b_")) < tolerance
    return joined.agg(F.count("*").alias("compared"), F.count_if(near).alias("aligned"), F.count_if(~near).alias("different"))
