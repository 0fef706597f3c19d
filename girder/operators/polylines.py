"""Lines through points in order, cut to a band of heights.

Cases: points with a null coordinate are left out; a line of one point has no
segment; an element without a band isn't told; an empty table gives no line.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from girder.operators.keyed import meet, running_sums
from girder.operators.shape import ranked_in_groups
from girder.sources.shared import written

XYZ = ("x", "y", "z")


def clipped_to_band(points: DataFrame, bands: DataFrame, element: str, line: str, place: str) -> DataFrame:
    """(element, line, run, at, x, y, z, clipped): the lines (element, line, place, x, y, z) within their element's band (element, z0, z1).

    Where a segment crosses the band's edge its end is interpolated; a line that
    leaves the band and comes back is several runs, numbered from 1; ``at`` orders a
    run's points. ``clipped`` tells whether anything of the element was cut off. An element
    of which nothing lies in the band is a contradiction and stays as it is, one run for each line.
    """
    key = [element, line]
    kept = points.filter(" and ".join(f"{a} is not null" for a in XYZ)).select(*key, place, *XYZ)
    ordered = written(ranked_in_groups(kept, key, [place]).select(*key, "rank", "n", *XYZ), "line-points")
    size = ordered.groupBy(*key).agg(F.count("*").alias("n_"))
    lines = written(size.join(bands.select(element, F.col("z0").alias("low_"), F.col("z1").alias("high_")), element), "line-bands")
    after = ordered.select(*key, (F.col("rank") - 1).alias("rank"), *[F.col(a).alias(f"{a}_") for a in XYZ])
    steps = meet(ordered.filter("rank < n").join(after, [*key, "rank"]), lines, key, "n_")
    rise = F.col("z_") - F.col("z")
    level = F.abs(rise) < 1e-12
    edge = [(F.col(c) - F.col("z")) / F.when(~level, rise) for c in ("low_", "high_")]
    begin = F.when(level, 0.0).otherwise(F.greatest(F.lit(0.0), F.least(*edge)))
    end = F.when(level, 1.0).otherwise(F.least(F.lit(1.0), F.greatest(*edge)))
    held = F.when(level, F.col("z").between(F.col("low_"), F.col("high_"))).otherwise(begin <= end)
    point = lambda t, own: F.struct(*[F.when(F.col(t) == (0.0 if own == "" else 1.0), F.col(f"{a}{own}")).otherwise(F.col(a) + (F.col(f"{a}_") - F.col(a)) * F.col(t)).alias(a) for a in XYZ])
    cut = steps.withColumns({"t0": begin, "t1": end, "held": held}).withColumns({"from": point("t0", ""), "to": point("t1", "_")})
    cut = written(cut.select(*key, "rank", "held", (~F.col("held") | (F.col("t0") != 0) | (F.col("t1") != 1)).alias("cut"), "from", "to"), "line-steps")
    kept = cut.filter("held")
    before = kept.select(*key, (F.col("rank") + 1).alias("rank"), F.col("to").alias("before_"))
    # a run goes on where the step before it ends at the point at which this one begins
    marked = kept.join(before, [*key, "rank"], "left").withColumn("new_", F.when(F.col("before_") == F.col("from"), 0).otherwise(1))
    numbered = running_sums(marked.select(*key, "rank", "from", "to", "new_"), key, "rank", "new_", "run")
    both = F.when(F.col("new_") == 1, F.array(F.struct(F.col("rank").alias("at"), F.col("from").alias("p")), F.struct((F.col("rank") + 1).alias("at"), F.col("to").alias("p")))).otherwise(F.array(F.struct((F.col("rank") + 1).alias("at"), F.col("to").alias("p"))))
    runs = numbered.select(*key, F.col("run").cast("long").alias("run"), F.explode(both).alias("q")).select(*key, "run", "q.at", "q.p.*")
    state = written(cut.groupBy(element).agg(F.max("cut").alias("clipped"), F.max("held").alias("some"), F.count("*").alias("c_")), "line-elements")
    inside = meet(runs, state.filter("some").select(element, "clipped", "c_"), [element], "c_")
    outside = meet(ordered, state.filter("not some").select(element, "clipped", "c_"), [element], "c_").withColumns({"run": F.lit(1).cast("long"), "at": F.col("rank")})
    columns = [*key, "run", "at", *XYZ, "clipped"]
    return inside.select(*columns).unionByName(outside.select(*columns))
