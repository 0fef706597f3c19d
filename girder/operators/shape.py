"""Extents, levels, modal bins, samples and fits, exact and without sorting a whole table in one task."""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from girder.functions.semantics import round_half_up, upper_median_rank
from girder.sources.shared import written

#: Values that are sorted at once to find an order statistic.
BRACKET_ROWS = 200_000


def ranked_in_groups(rows: DataFrame, by: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Rows with ``rank`` (from 1) and ``n`` within their group, for any group size.

    The groups are range-partitioned with the order columns, so a hot group
    spreads over tasks; ranks continue over partitions by the partitions'
    counts for each group.
    """
    ordered = rows.repartitionByRange(*by, *order).sortWithinPartitions(*by, *order).withColumn("place_", F.monotonically_increasing_id())
    kept = written(ordered.withColumn("part_", F.shiftright("place_", 33)), "ranked")
    counts = kept.groupBy(*by, "part_").agg(F.count("*").alias("c_"), F.min("place_").alias("start_"))
    # one row for each group and partition that meets it
    w = Window.partitionBy(*by).orderBy("part_")
    counts = counts.withColumn("before_", F.sum("c_").over(w) - F.col("c_")).withColumn("n", F.sum("c_").over(Window.partitionBy(*by)))
    counts = counts.select(*[F.col(b).alias(f"{b}_of_") for b in by], F.col("part_").alias("part_of_"), "before_", "start_", "n")
    match = [F.col(b).eqNullSafe(F.col(f"{b}_of_")) for b in by] + [F.col("part_") == F.col("part_of_")]
    return kept.join(counts, match).select(*rows.columns, (F.col("before_") + F.col("place_") - F.col("start_") + 1).alias("rank"), "n")


def ranked(rows: DataFrame, order: Sequence[str]) -> DataFrame:
    """Rows with ``rank`` (from 1) over the whole table and ``n``, by range partitions and their counts."""
    kept = written(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("place_", F.monotonically_increasing_id()), "ranked")
    kept = kept.withColumn("part_", F.shiftright("place_", 33))
    counts = kept.groupBy("part_").agg(F.count("*").alias("c_"))  # one row for each partition
    before = F.sum("c_").over(Window.orderBy("part_")) - F.col("c_")
    starts = counts.select("part_", before.alias("before_"), F.sum("c_").over(Window.partitionBy(F.lit(1))).alias("n"))
    return kept.join(F.broadcast(starts), "part_").select(*rows.columns, (F.col("before_") + F.col("place_").bitwiseAND(F.lit((1 << 33) - 1)) + 1).alias("rank"), "n")


def as_of(rows: DataFrame, known: DataFrame, keys: Mapping[str, str], at: str, known_at: str, values: Sequence[str]) -> DataFrame:
    """Rows with the values of the last known row of their key (``keys``: their column -> its column) at or before ``at``, null if there is none; known rows have one place each.

    Both tables are range-partitioned together by key and place, so a hot key
    spreads over tasks; what a partition ends with is carried into the next
    ones by a table of one row for each key and partition that meets it.
    """
    names = list(keys)
    mine = rows.select(*[F.col(k).alias(f"k{i}_") for i, k in enumerate(names)], F.col(at).cast("double").alias("at_"), F.lit(1).alias("side_"), F.struct(*rows.columns).alias("row_"), F.lit(None).cast(known.select(F.struct(*values)).schema[0].dataType).alias("v_"))
    theirs = known.select(*[F.col(k).alias(f"k{i}_") for i, k in enumerate(keys.values())], F.col(known_at).cast("double").alias("at_"), F.lit(0).alias("side_"), F.lit(None).cast(mine.schema["row_"].dataType).alias("row_"), F.struct(*values).alias("v_"))
    by = [f"k{i}_" for i in range(len(names))]
    order = [*by, "at_", "side_"]
    both = written(mine.unionByName(theirs).repartitionByRange(*order).sortWithinPartitions(*order).withColumn("part_", F.shiftright(F.monotonically_increasing_id(), 33)), "as-of")
    within = Window.partitionBy("part_", *by).orderBy("at_", "side_").rowsBetween(Window.unboundedPreceding, 0)
    filled = both.withColumn("own_", F.last("v_", ignorenulls=True).over(within))
    ends = both.filter("side_ = 0").groupBy("part_", *by).agg(F.max_by("v_", "at_").alias("end_"))
    spread = both.select("part_", *by).distinct().join(ends, ["part_", *by], "left")
    carried = spread.withColumn("carried_", F.last("end_", ignorenulls=True).over(Window.partitionBy(*by).orderBy("part_").rowsBetween(Window.unboundedPreceding, -1))).select("part_", *by, "carried_")
    out = filled.filter("side_ = 1").alias("f").join(carried.alias("c"), [F.col("f.part_") == F.col("c.part_"), *[F.col(f"f.{k}").eqNullSafe(F.col(f"c.{k}")) for k in by]])
    value = F.coalesce("own_", "carried_")
    return out.select("row_.*", value.alias("v_")).select(*rows.columns, *[F.col(f"v_.{v}").alias(v) for v in values])


def medians(rows: DataFrame, by: str, value: str) -> DataFrame:
    """(by, n, median): the exact upper median of each group's values that aren't null, without sorting groups.

    Approximate percentiles (rank error under n / 10,000) give each group a
    bracket around its middle; values below it are counted, values in it are
    counted by value.
    """
    held = rows.filter(F.col(value).isNotNull()).select(F.col(by).alias("by_"), F.col(value).alias("v_"))
    marks = held.groupBy("by_").agg(F.expr("percentile_approx(v_, array(0.498D, 0.502D), 10000)").alias("m_"), F.count("*").alias("n_"))
    marks = written(marks.select(F.col("by_").alias("g_"), F.col("m_")[0].alias("low_"), F.col("m_")[1].alias("high_"), "n_"), "marks")
    met = held.join(marks, F.col("by_").eqNullSafe(F.col("g_")))
    below = met.groupBy("g_").agg(F.count_if(F.col("v_") < F.col("low_")).alias("below_"))
    inside = met.filter(F.col("v_").between(F.col("low_"), F.col("high_"))).groupBy("g_", "n_", "v_").agg(F.count("*").alias("c_"))
    inside = inside.withColumn("upto_", F.sum("c_").over(Window.partitionBy("g_").orderBy("v_")))  # distinct values of a bracket
    found = inside.alias("i").join(below.alias("b"), F.col("i.g_").eqNullSafe(F.col("b.g_"))).filter(F.col("below_") + F.col("upto_") >= upper_median_rank(F.col("n_")))
    return found.groupBy(F.col("i.g_").alias(by)).agg(F.first("n_").alias("n"), F.min("v_").alias("median"))


def order_statistic(rows: DataFrame, column: str, index: int) -> float | None:
    """The value at 0-based ``index`` of the sorted values that are neither null nor NaN: exact, by narrowing a bracket with approximate percentiles."""
    values = rows.select(F.col(column).cast("double").alias("v")).filter(F.col("v").isNotNull() & ~F.isnan("v"))
    low, high, skip = None, None, 0
    while True:
        inside = values if low is None else values.filter(F.col("v").between(low, high))
        n, least, most = inside.agg(F.count("*"), F.min("v"), F.max("v")).first()
        k = index - skip
        if not n or not 0 <= k < n:
            return None
        if least == most:
            return least
        if n <= BRACKET_ROWS:
            return sorted(r["v"] for r in inside.collect())[k]  # at most BRACKET_ROWS values
        marks = [max(0.0, k / n - 0.001), min(1.0, k / n + 0.001)]
        a, b = inside.agg(F.percentile_approx("v", marks, 10_000)).first()[0]
        below, to = inside.agg(F.count_if(F.col("v") < a), F.count_if(F.col("v") <= b)).first()
        if below <= k < to and (a, b) != (low, high):
            low, high, skip = a, b, skip + below
            continue
        # the approximation missed the place: halve by value
        middle = max(least, -1e308) / 2 + min(most, 1e308) / 2
        to, after = inside.agg(F.count_if(F.col("v") <= middle), F.min(F.when(F.col("v") > middle, F.col("v")))).first()
        low, high, skip = (least, middle, skip) if k < to else (after, most, skip + to)


def order_statistics(rows: DataFrame, column: str, marks: Callable[[int], Sequence[int]]) -> tuple[int, float | None, float | None, list[float | None]]:
    """(n, least, most, the values at the 0-based indices ``marks(n)``) of the values that are neither null nor NaN: one pass for the counts, one for brackets of all indices, one to count below them, one to read them."""
    values = rows.select(F.col(column).cast("double").alias("v")).filter(F.col("v").isNotNull() & ~F.isnan("v"))
    n, least, most = values.agg(F.count("*"), F.min("v"), F.max("v")).first()
    at = list(marks(n))
    if not n or n <= BRACKET_ROWS or any(not 0 <= k < n for k in at):
        held = sorted(r["v"] for r in values.collect()) if n <= BRACKET_ROWS else []  # at most BRACKET_ROWS values
        return n, least, most, [held[k] if 0 <= k < len(held) else order_statistic(rows, column, k) if held == [] else None for k in at]
    ends = values.agg(F.percentile_approx("v", [min(1.0, max(0.0, k / n + d)) for k in at for d in (-0.0005, 0.0005)], 10_000)).first()[0]
    brackets = list(zip(ends[::2], ends[1::2], strict=True))
    counts = values.agg(*[c for a, b in brackets for c in (F.count_if(F.col("v") < a), F.count_if(F.col("v") <= b))]).first()
    inside = F.lit(False)
    for a, b in brackets:
        inside = inside | F.col("v").between(a, b)
    fits = all(counts[2 * j] <= k < counts[2 * j + 1] for j, k in enumerate(at)) and sum(counts[2 * j + 1] - counts[2 * j] for j in range(len(at))) <= BRACKET_ROWS
    if not fits:  # many equal values, or an index that the approximation missed
        return n, least, most, [order_statistic(rows, column, k) for k in at]
    held = sorted(r["v"] for r in values.filter(inside).collect())  # at most BRACKET_ROWS values
    return n, least, most, [held[bisect_left(held, a) + k - counts[2 * j]] for j, ((a, _), k) in enumerate(zip(brackets, at, strict=True))]


def extent(rows: DataFrame, columns: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """min_ and max_ of each column, by group if asked."""
    measures = [f(c).alias(f"{name}_{c}") for c in columns for name, f in (("min", F.min), ("max", F.max))]
    return rows.groupBy(*by).agg(*measures)


def robust_extent(rows: DataFrame, column: str, cut: float = 0.001, least: int = 500) -> DataFrame:
    """One row (mn, mx): the values at indices floor(n cut) and floor(n (1 - cut)); plain extremes for few rows or a degenerate range."""
    n, low, high, (a, b) = order_statistics(rows, column, lambda n: [min(n - 1, max(0, int(n * x))) for x in (cut, 1 - cut)])
    if n >= least and b > a:
        low, high = a, b
    return rows.sparkSession.range(1).select(F.lit(low).cast("double").alias("mn"), F.lit(high).cast("double").alias("mx"))


def trim_outliers(rows: DataFrame, column: str, least: int = 1000, share: float = 0.9, marks: tuple[float, float] = (0.005, 0.985)) -> DataFrame:
    """Rows between the values at floor((n - 1) mark), if there are enough rows and that keeps enough of them; else all."""
    n, _, _, (low, high) = order_statistics(rows, column, lambda n: [int((n - 1) * m) for m in marks])
    if n < least:
        return rows
    kept = rows.filter(F.col(column).between(low, high))
    return kept if kept.count() >= n * share else rows


def sample_evenly(rows: DataFrame, order: Sequence[str], limit: int) -> DataFrame:
    """The rows at places floor(k n / limit) of the ordered table, k from 0 to limit - 1; all rows if there are no more."""
    numbered = ranked(rows, order)
    i, n = F.col("rank") - 1, F.col("n")
    k = F.ceil(i * float(limit) / n)
    return numbered.filter((n <= limit) | ((F.floor(k * n / float(limit)) == i) & (k < limit))).select(*rows.columns)


def level_bands(rows: DataFrame, elevation: Column, top: int | None = 8) -> DataFrame:
    """(elevation, candidates): half-unit buckets, the most populated first; without ``top`` all of them by elevation."""
    bands = rows.groupBy((round_half_up(elevation * 2) / 2).alias("elevation")).agg(F.count("*").alias("candidates"))
    return bands.orderBy(F.desc("candidates"), "elevation").limit(top) if top else bands.orderBy("elevation")


def levels_from_members(rows: DataFrame, level: str, base: str, least: int = 20) -> DataFrame:
    """(level_id, elevation, candidates): the upper median of the members' bases, of levels with enough members."""
    found = medians(rows.withColumnRenamed(level, "level_id"), "level_id", base)
    return found.filter(F.col("n") >= least).select("level_id", F.col("median").alias("elevation"), F.col("n").alias("candidates"))


def modal_bin(rows: DataFrame, category: str, value: str, width: float, least: int = 8, share: float = 0.5) -> DataFrame:
    """(category, mode_value, n): each category's most frequent bin, if the category has enough rows and the bin enough of them."""
    bins = rows.groupBy(F.col(category).alias("category"), round_half_up(F.col(value) / width).alias("bin")).agg(F.count("*").alias("n"))
    best = bins.groupBy("category").agg(F.min(F.struct((-F.col("n")).alias("down"), "bin")).alias("b"), F.sum("n").alias("total"))
    out = best.select("category", (F.col("b.bin") * width).alias("mode_value"), (-F.col("b.down")).alias("n"), "total")
    return out.filter((F.col("total") >= least) & (F.col("n") / F.col("total") >= share)).drop("total")


def dominant(rows: DataFrame, value: str, share: float = 0.5) -> DataFrame:
    """(value, n): the most frequent value, if it has at least that share of all rows."""
    counts = rows.groupBy(value).agg(F.count("*").alias("n"))
    best = counts.agg(F.min(F.struct((-F.col("n")).alias("down"), value)).alias("b"), F.sum("n").alias("total"))
    return best.filter(-F.col("b.down") >= share * F.col("total")).select(F.col(f"b.{value}").alias(value), (-F.col("b.down")).alias("n"))


def similarity_fit(rows: DataFrame, x: Column, y: Column, to_x: Column, to_y: Column) -> DataFrame:
    """One row (a, b, e, f): the least-squares similarity (x, y) -> (a x - b y + e, b x + a y + f); two passes, sums only."""
    points = rows.select(x.alias("x"), y.alias("y"), to_x.alias("u"), to_y.alias("v"))
    centre = points.agg(*[F.avg(c).alias(f"c{c}") for c in "xyuv"])
    d = points.crossJoin(centre).select(*[(F.col(c) - F.col(f"c{c}")).alias(c) for c in "xyuv"])  # one row of centres
    sums = d.agg(F.sum(F.col("x") * F.col("u") + F.col("y") * F.col("v")).alias("dot"), F.sum(F.col("x") * F.col("v") - F.col("y") * F.col("u")).alias("cross"), F.sum(F.col("x") * F.col("x") + F.col("y") * F.col("y")).alias("energy"))
    a, b = F.col("dot") / F.col("energy"), F.col("cross") / F.col("energy")
    return sums.crossJoin(centre).select(a.alias("a"), b.alias("b"), (F.col("cu") - a * F.col("cx") + b * F.col("cy")).alias("e"), (F.col("cv") - b * F.col("cx") - a * F.col("cy")).alias("f"))


def similarity_residuals(rows: DataFrame, fit: DataFrame, x: Column, y: Column, to_x: Column, to_y: Column) -> DataFrame:
    """One row (rms, worst) of a fit's residuals."""
    points = rows.select(x.alias("x"), y.alias("y"), to_x.alias("u"), to_y.alias("v")).crossJoin(fit)
    gap = F.hypot(F.expr("a * x - b * y + e - u"), F.expr("b * x + a * y + f - v"))
    return points.agg(F.sqrt(F.avg(gap * gap)).alias("rms"), F.max(gap).alias("worst"))


def orientation_signature(rows: DataFrame, element: str, tilt: Column, weight: Column, flat: float, steep: float) -> DataFrame:
    """(element_id, horizontal, vertical, sloped, triangles): weights by class of tilt."""
    return rows.groupBy(F.col(element).alias("element_id")).agg(
        F.sum(F.when(tilt <= flat, weight).otherwise(0)).alias("horizontal"), F.sum(F.when(tilt >= steep, weight).otherwise(0)).alias("vertical"), F.sum(F.when((tilt > flat) & (tilt < steep), weight).otherwise(0)).alias("sloped"), F.count("*").alias("triangles")
    )


def elevation_band(rows: DataFrame, storeys: DataFrame, base: str, slack: float = 0.5) -> DataFrame:
    """Rows with the last storey (name, elevation) at or below base + slack, on ties the last name, and the lowest storey if all are above: an as-of join, for any number of storeys."""
    named = storeys.groupBy("elevation").agg(F.max("name").alias("storey"), F.min("name").alias("first_"))
    lowest = named.agg(F.min(F.struct("elevation", "first_")).alias("l_")).select(F.col("l_.first_").alias("lowest_"))
    known = named.select(F.lit(0).alias("one_"), "elevation", "storey")
    out = as_of(rows.withColumn("at_base_", F.col(base) + slack).withColumn("one_", F.lit(0)), known, {"one_": "one_"}, "at_base_", "elevation", ["storey"])
    return out.crossJoin(lowest).withColumn("storey", F.coalesce("storey", "lowest_")).drop("lowest_", "at_base_", "one_")  # one row on the right
