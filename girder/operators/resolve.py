"""Resolving references: votes, consensus, unique targets, conflict-free definitions, hops.

Every operator takes column names, so it runs on any table. First-seen rules
use an explicit ordinal. Aggregations are two-level (partial sums and minima,
then one row for each key), so a hot key costs one row a task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Support and purity that a consensus needs: (members, share).
FLOORS = ((8, 0.70), (4, 0.85), (3, 1.00))


def _best(n: str, first: str, value: str) -> Column:
    """The value with the largest count, on ties the first seen: an aggregate without a window."""
    return F.min_by(value, F.struct((-F.col(n)).alias("n"), first, value))


def majority_vote(votes: DataFrame, owner: str, category: str, ordinal: str) -> DataFrame:
    """(owner, category, n): each owner's most frequent non-null category; on ties the first seen."""
    counts = votes.filter(F.col(category).isNotNull()).groupBy(owner, category).agg(F.count("*").alias("n"), F.min(ordinal).alias("first_"))
    return counts.groupBy(owner).agg(_best("n", "first_", category).alias(category), F.max("n").alias("n"))


def nearest_known(tokens: DataFrame, known: DataFrame, token: str, candidate: str, position: str, known_id: str) -> DataFrame:
    """(token, candidate): the first candidate of each token, by position, that is known."""
    hits = tokens.join(known.select(F.col(known_id).alias(candidate)), candidate, "left_semi")
    return hits.groupBy(token).agg(F.min(F.struct(position, candidate)).alias("best_")).select(token, F.col(f"best_.{candidate}").alias(candidate))


def donation_test(tokens: DataFrame, known: DataFrame, real: DataFrame, token: str, candidate: str, position: str, known_id: str, real_id: str) -> DataFrame:
    """(token, candidate, donated): the nearest known candidate, donated if the nearest real one is another."""
    near = nearest_known(tokens, known, token, candidate, position, known_id)
    true = nearest_known(tokens, real, token, candidate, position, real_id).withColumnRenamed(candidate, "real_")
    return near.join(true, token, "left").select(token, candidate, (~F.col(candidate).eqNullSafe(F.col("real_"))).alias("donated"))


def consensus(members: DataFrame, keys: Sequence[str], category: str, ordinal: str, floors: Sequence[tuple[int, float]] = FLOORS) -> DataFrame:
    """(keys, category, support, purity) of clusters whose best category reaches one of the floors."""
    counts = members.filter(F.col(category).isNotNull()).groupBy(*keys, category).agg(F.count("*").alias("n_"), F.min(ordinal).alias("first_"))
    best = counts.groupBy(*keys).agg(_best("n_", "first_", category).alias(category), F.max("n_").alias("n_"), F.sum("n_").alias("support"))
    good = F.lit(False)
    for support, purity in floors:
        good = good | ((F.col("support") >= support) & (F.col("n_") / F.col("support") >= purity))
    return best.withColumn("purity", F.col("n_") / F.col("support")).filter(good).select(*keys, category, "support", "purity")


def inherit(rows: DataFrame, found: DataFrame, keys: Sequence[str], own: str, category: str, labels: tuple[str, str]) -> DataFrame:
    """Rows with ``category`` (their own, else their cluster's) and ``source`` (which of both); rows with neither go."""
    agreed = found.select(*keys, F.col(category).alias("agreed_"))
    joined = rows.join(agreed, list(keys), "left")
    value = F.coalesce(own, "agreed_")
    return joined.withColumn("source", F.when(F.col(own).isNull(), labels[1]).otherwise(labels[0])).withColumn(category, value).filter(value.isNotNull()).drop("agreed_")


def override_donated(rows: DataFrame, found: DataFrame, keys: Sequence[str], category: str, donated: str) -> DataFrame:
    """Donated categories give way to their cluster's consensus; ``overridden`` marks changed rows."""
    joined = rows.join(found.select(*keys, F.col(category).alias("agreed_")), list(keys), "left")
    over = F.col(donated) & F.col("agreed_").isNotNull() & ~F.col("agreed_").eqNullSafe(F.col(category))
    return joined.withColumn("overridden", over).withColumn(category, F.when(over, F.col("agreed_")).otherwise(F.col(category))).drop("agreed_")


def unique_target(links: DataFrame, element: str, target: str, offset: str, names: tuple[str, str, str] = ("element_id", "target_id", "field_offset")) -> DataFrame:
    """Elements with exactly one distinct target, with the lowest offset; two extremes decide it, no set is kept."""
    one = links.filter(F.col(target).isNotNull()).groupBy(element).agg(F.min(target).alias("low_"), F.max(target).alias("high_"), F.min(offset).alias("offset_"))
    return one.filter("low_ = high_").select(F.col(element).alias(names[0]), F.col("low_").alias(names[1]), F.col("offset_").alias(names[2]))


def primary_or_alternate(links: DataFrame, element: str, target: str, primary: Column, alternate: Column) -> DataFrame:
    """(element_id, target_id): the primary field's target if it has exactly one; if it has none, the alternate's if it has exactly one."""
    def extremes(which: Column, name: str) -> list[Column]:
        return [F.min(F.when(which, F.col(target))).alias(f"{name}_low"), F.max(F.when(which, F.col(target))).alias(f"{name}_high")]

    both = links.groupBy(F.col(element).alias("element_id")).agg(*extremes(primary, "p"), *extremes(alternate, "a"))
    chosen = F.when(F.col("p_low") == F.col("p_high"), F.col("p_low")).when(F.col("p_low").isNull() & (F.col("a_low") == F.col("a_high")), F.col("a_low"))
    return both.select("element_id", chosen.alias("target_id")).filter("target_id is not null")


def conflict_free(definitions: DataFrame, key: str, signature: str, ordinal: str, first: str = "first_def") -> DataFrame:
    """Keys all of whose definitions agree; a conflict removes the key for good."""
    out = definitions.groupBy(key).agg(F.min(signature).alias(signature), F.max(signature).alias("high_"), F.min(ordinal).alias(first))
    return out.filter(F.col(signature) == F.col("high_")).select(key, signature, first)


def two_hops(placements: DataFrame, links: DataFrame, element: str, middle: str, target: str) -> DataFrame:
    """(element, middle, target): elements with one middle only, joined with the middle's distinct targets."""
    one = unique_target(placements, element, middle, middle, (element, middle, "offset_")).drop("offset_")
    return one.join(links.select(middle, target).distinct(), middle).select(element, middle, target)


def priority_overlay(*tables: DataFrame, key: str) -> DataFrame:
    """One row for each key: of the last table that has it."""
    whole = None
    for k, t in enumerate(tables):
        one = t.select(key, F.struct(F.lit(-k).alias("rank_"), *[c for c in t.columns if c != key]).alias("row_"))
        whole = one if whole is None else whole.unionByName(one)
    return whole.groupBy(key).agg(F.min("row_").alias("row_")).select(key, "row_.*").drop("rank_")


def best_record(rows: DataFrame, key: str, rank: Column, ordinal: str, keep: Sequence[str], name: str = "rank_value") -> DataFrame:
    """Each key's row of the highest rank, on ties the first by ordinal."""
    ranked = rows.select(key, F.struct((-rank).alias("down_"), F.col(ordinal).alias("ordinal_"), *[F.col(c).alias(c) for c in keep]).alias("row_"))
    best = ranked.groupBy(key).agg(F.min("row_").alias("row_"))
    return best.select(key, *[F.col(f"row_.{c}").alias(c) for c in keep], (-F.col("row_.down_")).alias(name))


def first_wins(rows: DataFrame, key: str, order: Sequence[str | Column], keep: Sequence[str]) -> DataFrame:
    """Each key's first row by ``order``."""
    order = [F.col(o) if isinstance(o, str) else o for o in order]
    packed = rows.select(key, F.struct(*[o.alias(f"o{k}_") for k, o in enumerate(order)], *[F.col(c) for c in keep]).alias("row_"))
    return packed.groupBy(key).agg(F.min("row_").alias("row_")).select(key, *[F.col(f"row_.{c}").alias(c) for c in keep])


def ownership_counters(rows: DataFrame, element: str, owner: str) -> DataFrame:
    """One row: records, roots, self_owned, dangling (owners that are no element)."""
    ids = rows.select(F.col(element).alias("id_")).distinct()
    joined = rows.join(ids, F.col(owner) == F.col("id_"), "left")
    return joined.agg(F.count("*").alias("records"), F.count_if(F.col(owner).isNull()).alias("roots"), F.count_if(F.col(owner) == F.col(element)).alias("self_owned"), F.count_if(F.col(owner).isNotNull() & (F.col(owner) != F.col(element)) & F.col("id_").isNull()).alias("dangling"))


def offset_self_join(rows: DataFrame, key: str, by: int, columns: Sequence[str], prefix: str = "owner_") -> DataFrame:
    """Rows joined with those whose key is ``by`` larger: an equi-join, no range."""
    other = rows.select((F.col(key) - by).alias(key), *[F.col(c).alias(f"{prefix}{c}") for c in columns])
    return rows.join(other, key)
