"""Rings from unordered segments, and which ring lies in which.

Owners of few rows are worked off many at a time within a task after one shuffle; rows of
others, however many, are joined and ranked over all tasks. Both give the same rows.

Cases: segments with a null coordinate or shorter than the tolerance are left
out; of segments between the same two ends the one of the smallest number stays;
an empty table gives no ring.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from girder.operators.keyed import meet
from girder.operators.shape import ranked_in_groups
from girder.operators.spatial import box_pairs
from girder.sources.shared import written

AXES = ("x", "y", "z")
#: Owners of at most so many rows are worked off within a task.
FEW = 128


def _parted(rows: DataFrame, owner: str, odd: Column, name: str) -> tuple[DataFrame, DataFrame | None]:
    """Rows of owners that have FEW at most and none that is ``odd``, and the other rows, written (None if there are none)."""
    counts = rows.groupBy(owner).agg(F.count("*").alias("n_"), F.max(odd).alias("odd_"))
    many = written(counts.filter((F.col("n_") > FEW) | F.col("odd_") | F.col(owner).isNull()).select(F.col(owner).alias("many_")), "large-owners")
    if many.isEmpty():
        return rows, None
    same = F.col(owner).eqNullSafe(F.col("many_"))
    return rows.join(many, same, "left_anti"), written(rows.join(many, same, "left_semi"), name)


def _by_owner(rows: DataFrame, owner: str, order: list[str], work: Callable[[pa.Table, np.ndarray], pa.Table], schema: StructType) -> DataFrame:
    """``work`` on tables of whole owners: rows in order, and the places at which owners begin."""
    arrow = to_arrow_schema(schema)

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        left = None

        def done(t: pa.Table, starts: np.ndarray) -> Iterator[pa.RecordBatch]:
            if t.num_rows:
                yield from pa.Table.from_arrays([c.cast(f.type) for c, f in zip(work(t, starts).columns, arrow, strict=True)], schema=arrow).to_batches(10000)

        def starts_of(t: pa.Table) -> np.ndarray:
            c = t.column(owner)
            return np.concatenate([[0], np.flatnonzero(pc.not_equal(c.slice(1), c.slice(0, len(c) - 1)).to_numpy()) + 1])

        for batch in batches:
            t = pa.Table.from_batches([batch])
            t = (pa.concat_tables([left, t]) if left is not None else t).combine_chunks()
            if t.num_rows:
                starts = starts_of(t)
                yield from done(t.slice(0, starts[-1]).combine_chunks(), starts[:-1])
                left = t.slice(starts[-1])
        if left is not None:
            yield from done(left.combine_chunks(), np.zeros(1, np.int64))

    return rows.repartition(owner).sortWithinPartitions(owner, *order).mapInArrow(over, schema)


def _spans(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The numbers starts[k] to starts[k] + counts[k] - 1 of all k, one after the other."""
    return np.repeat(starts - np.cumsum(counts) + counts, counts) + np.arange(counts.sum())


def _sizes(starts: np.ndarray, n: int) -> np.ndarray:
    return np.diff(np.append(starts, n))


def snapped(points: DataFrame, owner: str, tolerance: float) -> DataFrame:
    """(owner, x, y, z, v) of distinct points: v is the smallest point nearer than the tolerance, so ends that differ by rounding have one v.

    A point is looked up in the cells that its neighbourhood touches, nearly
    always one. Points whose ends drift over more than the tolerance aren't one.
    """
    distinct = written(points.select(owner, *AXES).distinct(), "points")
    size = 4 * tolerance
    near, own = distinct, distinct.select(owner, *[F.col(a).alias(f"o_{a}") for a in AXES])
    for a in AXES:
        near = near.withColumn(f"c_{a}", F.explode(F.sequence(F.floor((F.col(a) - tolerance) / size), F.floor((F.col(a) + tolerance) / size))))
        own = own.withColumn(f"c_{a}", F.floor(F.col(f"o_{a}") / size))
    apart = sum(((F.col(a) - F.col(f"o_{a}")) * (F.col(a) - F.col(f"o_{a}")) for a in AXES), F.lit(0.0))
    met = near.join(own, [owner, *[f"c_{a}" for a in AXES]]).filter(apart < tolerance * tolerance)
    return met.groupBy(owner, *AXES).agg(F.min(F.struct(*[F.col(f"o_{a}").alias(a) for a in AXES])).alias("v"))


def edges(segments: DataFrame, owner: str, segment: str, tolerance: float) -> DataFrame:
    """(owner, segment, a, b): the segments' snapped ends, without short and repeated ones."""
    ends = [F.struct(*[F.col(f"{a}{k}").cast("double").alias(a) for a in AXES]) for k in (0, 1)]
    length = sum(((F.col(f"{a}0") - F.col(f"{a}1")) * (F.col(f"{a}0") - F.col(f"{a}1")) for a in AXES), F.lit(0.0))
    halves = segments.filter(length >= tolerance * tolerance).select(owner, segment, F.posexplode(F.array(*ends)).alias("k", "p")).select(owner, segment, "k", "p.*")
    met = halves.join(snapped(halves, owner, tolerance), [owner, *AXES])
    both = met.groupBy(owner, segment).agg(F.max(F.when(F.col("k") == 0, F.col("v"))).alias("a"), F.max(F.when(F.col("k") == 1, F.col("v"))).alias("b"))
    first = both.filter("a != b").groupBy(owner, F.least("a", "b").alias("p"), F.greatest("a", "b").alias("q")).agg(F.min(F.struct(segment, "a", "b")).alias("e"))
    return first.select(owner, "e.*")


def _links(halves: DataFrame, owner: str, segment: str) -> DataFrame:
    """(owner, s1, k1, s2, k2): ends that meet. Where more than two meet, they are paired in the order of their segments; one may be left."""
    end = F.struct(segment, "k")
    degree = halves.groupBy(owner, "v").agg(F.count("*").alias("n"), F.min(end).alias("p"), F.max(end).alias("q"))
    plain = degree.filter("n = 2").select(owner, "p", "q")
    crowded = halves.join(degree.filter("n > 2").select(owner, "v"), [owner, "v"])
    placed = ranked_in_groups(crowded, [owner, "v"], [segment, "k"]).withColumn("pair", F.floor((F.col("rank") - 1) / 2))
    paired = placed.groupBy(owner, "v", "pair").agg(F.count("*").alias("n"), F.min(end).alias("p"), F.max(end).alias("q")).filter("n = 2").select(owner, "p", "q")
    return plain.unionByName(paired)


def _assembly(tolerance: float, least: int, owner: str, segment: str, closed: bool) -> Callable[[pa.Table, np.ndarray], pa.Table]:
    """``assembled`` for whole owners in order of their segments: the sides of rings, or else what is open."""

    def work(t: pa.Table, starts: np.ndarray) -> pa.Table:
        ends = np.stack([[t.column(f"{a}{k}").to_numpy() for a in AXES] for k in (0, 1)]) + 0.0  # end, axis, segment
        of = np.repeat(np.arange(len(starts)), _sizes(starts, t.num_rows))
        long_ = np.flatnonzero(((ends[0] - ends[1]) ** 2).sum(0) >= tolerance * tolerance)
        of, ends = of[long_], ends[:, :, long_]
        m = len(long_)
        # points by owner and coordinates; v: the first of them that is near
        xyz, whose = np.concatenate([ends[0], ends[1]], 1), np.concatenate([of, of])
        order = np.lexsort((xyz[2], xyz[1], xyz[0], whose))
        xyz, whose = xyz[:, order], whose[order]
        fresh = np.ones(2 * m, bool)
        fresh[1:] = (whose[1:] != whose[:-1]) | (xyz[:, 1:] != xyz[:, :-1]).any(0)
        points, whose = xyz[:, fresh], whose[fresh]
        own = np.empty(2 * m, np.int64)
        own[order] = np.cumsum(fresh) - 1
        begin = np.searchsorted(whose, whose)
        count = np.searchsorted(whose, whose, "right") - begin
        one, two = np.repeat(np.arange(len(whose)), count), _spans(begin, count)
        near = ((points[:, one] - points[:, two]) ** 2).sum(0) < tolerance * tolerance
        v = np.arange(len(whose))
        np.minimum.at(v, one[near], two[near])
        a, b = v[own[:m]], v[own[m:]]
        # of segments between the same ends the first
        low, high = np.minimum(a, b), np.maximum(a, b)
        order = np.lexsort((np.arange(m), high, low))
        first = np.ones(m, bool)
        first[1:] = (low[order][1:] != low[order][:-1]) | (high[order][1:] != high[order][:-1])
        known = np.sort(order[first & (low != high)[order]])
        a, b, of, rows = a[known], b[known], of[known], long_[known]
        m = len(known)
        # ends at a point, two by two in the order of their segments; arc 2 s + k leaves end k of segment s
        at = np.stack([a, b], 1).ravel()
        half = np.argsort(at, kind="stable")
        at = at[half]
        begins = np.flatnonzero(np.append(True, at[1:] != at[:-1])) if m else np.zeros(0, np.int64)
        place = np.arange(2 * m) - np.repeat(begins, _sizes(begins, 2 * m))
        p = np.flatnonzero((place[:-1] % 2 == 0) & (at[1:] == at[:-1])) if m else begins
        p, q = half[p], half[p + 1]
        after = np.full(2 * m + 1, 2 * m)  # the last place: nowhere
        after[p ^ 1], after[q ^ 1] = q, p
        lowest, far, step = np.arange(2 * m + 1), np.zeros(2 * m + 1, np.int64), 1
        reach = int(_sizes(starts, t.num_rows).max(initial=0))
        while step <= 2 * reach:
            less = lowest[after] < lowest
            far, lowest = np.where(less, far[after] + step, far), np.where(less, lowest[after], lowest)
            after, step = after[after], 2 * step
        arc = np.flatnonzero(after[:-1] < 2 * m)
        sides = np.bincount(lowest[arc], minlength=2 * m + 1)
        arc = arc[(lowest[arc] % 2 == 0) & (sides[lowest[arc]] >= least)]
        names, numbers = t.column(owner), t.column(segment)
        if not closed:
            held = np.ones(m, bool)
            held[arc // 2] = False
            return pa.table([names.take(pa.array(rows[held])), numbers.take(pa.array(rows[held]))], names=["0", "1"])
        cycle, back = lowest[arc], arc % 2 == 1
        begin, end = np.where(back, b[arc // 2], a[arc // 2]), np.where(back, a[arc // 2], b[arc // 2])
        twice = np.bincount(cycle, points[0, begin] * points[1, end] - points[0, end] * points[1, begin], 2 * m + 1)
        rings = np.unique(cycle)
        area = np.abs(twice[rings]) / 2
        order = np.lexsort((rings, -area, of[rings // 2]))
        sorted_of = of[rings[order] // 2]
        number = np.empty(len(rings), np.int64)
        number[order] = np.arange(len(rings)) - np.searchsorted(sorted_of, sorted_of) + 1
        k = np.searchsorted(rings, cycle)
        where, n = pa.array(rows[arc // 2]), sides[cycle]
        columns = [names.take(where), numbers.take(pa.array(rows[cycle // 2])), number[k], area[k], n, (n - far[arc]) % n, numbers.take(where), back, *points[:, begin]]
        return pa.table([c if isinstance(c, pa.ChunkedArray) else pa.array(c) for c in columns], names=[str(j) for j in range(len(columns))])

    return work


def assembled(segments: DataFrame, owner: str, segment: str, tolerance: float = 1e-4, least: int = 3) -> tuple[DataFrame, DataFrame]:
    """Rings of segments (owner, segment: a number unique for its owner, x0, y0, z0, x1, y1, z1), and what is open.

    The first table has a row for each side of a ring: owner, ring (its smallest
    segment), ring_no (1: the largest plan area), area, sides, place (from 0 at that
    segment, in its direction), segment, reversed, and the point x, y, z at which the
    side begins. The second has (owner, segment) of the sides that are in no closed ring.

    Each segment is two arcs, one for each direction, and each arc knows the next.
    Pointers are doubled, and with them each arc knows the smallest arc on its way and
    how far that is. An arc that meets the same smallest one twice has been
    all around: the distance between is the ring's length, and it is done; within one
    round more so is all its ring. An arc whose pointer leads nowhere is in a chain and goes.
    That takes as many rounds as the longest ring's length has binary digits, each an
    equi-join of distinct pointers of the rings that are left, so no ring is gathered.
    Owners of FEW segments at most are worked off within a task by the same rules.
    """
    length = sum(((F.col(f"{a}0") - F.col(f"{a}1")) * (F.col(f"{a}0") - F.col(f"{a}1")) for a in AXES), F.lit(0.0))
    segments = segments.select(owner, segment, *[F.col(f"{a}{k}").cast("double").alias(f"{a}{k}") for k in (0, 1) for a in AXES])
    segments = written(segments.filter(length >= tolerance * tolerance), "segments")
    few, many = _parted(segments, owner, ~F.coalesce((length < float("inf")) & F.col(segment).isNotNull(), F.lit(False)), "large-segments")
    kinds = dict(segments.dtypes)
    of = lambda columns: segments.sparkSession.createDataFrame([], f"`{owner}` {kinds[owner]}, {columns}").schema
    closed = _by_owner(few, owner, [segment], _assembly(tolerance, least, owner, segment, True), of(f"ring long, ring_no long, area double, sides long, place long, `{segment}` long, reversed boolean, x double, y double, z double"))
    open_ = _by_owner(few, owner, [segment], _assembly(tolerance, least, owner, segment, False), of(f"`{segment}` {kinds[segment]}"))
    if many is None:
        return closed, open_
    closed_, more = _joined_rings(many, owner, segment, tolerance, least)
    return closed.unionByName(closed_), open_.unionByName(more)


def _joined_rings(segments: DataFrame, owner: str, segment: str, tolerance: float, least: int) -> tuple[DataFrame, DataFrame]:
    """``assembled`` by joins, for owners of any size."""
    known = written(edges(segments, owner, segment, tolerance), "edges")
    halves = known.select(owner, segment, F.posexplode(F.array("a", "b")).alias("k", "v"))
    links = _links(halves, owner, segment)
    both = links.select(owner, F.col("p").alias("from"), F.col("q").alias("to")).unionByName(links.select(owner, F.col("q").alias("from"), F.col("p").alias("to")))
    # an arc is named by its segment and the end that it leaves; it arrives at the other one
    follows = both.select(owner, (F.col(f"from.{segment}") * 2 + 1 - F.col("from.k")).alias("arc"), (F.col(f"to.{segment}") * 2 + F.col("to.k")).alias("next"))
    state = written(follows.select(owner, "arc", "next", F.col("arc").alias("low"), F.lit(0).cast("long").alias("far"), F.lit(None).cast("long").alias("sides")), "arcs")
    live, done, step = state, [], 1
    while not live.isEmpty():
        ahead = state.select(owner, F.col("arc").alias("next"), F.col("next").alias("next_"), F.col("low").alias("low_"), F.col("far").alias("far_"))
        lower = F.col("low_") < F.col("low")
        walked = live.join(ahead, [owner, "next"]).select(
            owner, "arc", F.col("next_").alias("next"), F.least("low", "low_").alias("low"), F.when(lower, F.col("far_") + step).otherwise(F.col("far")).alias("far"), F.when(F.col("low") == F.col("low_"), F.col("far_") + step - F.col("far")).alias("sides")
        )
        state = written(walked, "arcs")
        live, step = state.filter("sides is null"), 2 * step
        done.append(state.filter("sides is not null"))
    # of a ring's two directions the one that takes its smallest segment forwards
    chosen = reduce(DataFrame.unionByName, done or [state]).filter("low % 2 = 0").select(owner, "arc", F.col("low").alias("cycle"), "far", "sides").filter(F.col("sides") >= least)
    chosen = chosen.withColumns({segment: F.floor(F.col("arc") / 2).cast("long"), "reversed": F.col("arc") % 2 == 1}).join(known, [owner, segment])
    chosen = written(chosen.select(owner, segment, "cycle", "far", "sides", "reversed", F.when(F.col("reversed"), F.col("b")).otherwise(F.col("a")).alias("p"), F.when(F.col("reversed"), F.col("a")).otherwise(F.col("b")).alias("q")), "sides")
    twice = F.sum(F.col("p.x") * F.col("q.y") - F.col("q.x") * F.col("p.y"))
    rings = chosen.groupBy(owner, "cycle").agg(F.count("*").alias("sides"), (F.abs(twice) / 2).alias("area"))
    rings = ranked_in_groups(rings.withColumn("less_", -F.col("area")), [owner], ["less_", "cycle"]).select(owner, "cycle", "sides", "area", F.col("rank").alias("ring_no"))
    rings = written(rings, "rings")
    out = meet(chosen.drop("sides"), rings, [owner, "cycle"], "sides")
    place = (F.col("sides") - F.col("far")) % F.col("sides")
    closed = out.select(owner, F.floor(F.col("cycle") / 2).cast("long").alias("ring"), "ring_no", "area", "sides", place.alias("place"), segment, "reversed", "p.x", "p.y", "p.z")
    return closed, known.select(owner, segment).join(closed.select(owner, segment), [owner, segment], "left_anti")


def _nesting(owner: str, ring: str) -> Callable[[pa.Table, np.ndarray], pa.Table]:
    """``nested`` for whole owners in order of their rings and places."""

    def work(t: pa.Table, starts: np.ndarray) -> pa.Table:
        x, y = (t.column(c).to_numpy() + 0.0 for c in "xy")
        c = t.column(ring)
        fresh = np.append(True, pc.not_equal(c.slice(1), c.slice(0, len(c) - 1)).to_numpy())
        fresh[starts] = True
        begin = np.flatnonzero(fresh)
        n = _sizes(begin, len(x))
        begin, n = begin[n >= 3], n[n >= 3]
        of = np.searchsorted(starts, begin, "right")
        first, size = np.searchsorted(of, of), np.searchsorted(of, of, "right") - np.searchsorted(of, of)
        # corners of the rings, each with the next one
        at = _spans(begin, n)
        x, y, start = x[at], y[at], np.cumsum(n) - n
        after = np.arange(len(at)) + 1
        after[start + n - 1] = start
        x_, y_ = x[after], y[after]
        if len(n):
            area = np.abs(np.add.reduceat(x * y_ - x_ * y, start)) / 2
            x0, x1, y0, y1 = (f.reduceat(v, start) for v in (x, y) for f in (np.minimum, np.maximum))
        else:
            area = x0 = x1 = y0 = y1 = np.zeros(0)
        inner, outer = np.repeat(np.arange(len(n)), size), _spans(first, size)
        met = (inner != outer) & (np.maximum(x0[inner], x0[outer]) <= np.minimum(x1[inner], x1[outer])) & (np.maximum(y0[inner], y0[outer]) <= np.minimum(y1[inner], y1[outer]))
        inner, outer = inner[met], outer[met]
        # corners of the inner ring in the outer one's height, and its sides to their right
        probe, pair = _spans(start[inner], n[inner]), np.repeat(np.arange(len(inner)), n[inner])
        high = (y[probe] >= y0[outer[pair]]) & (y[probe] <= y1[outer[pair]])
        probe, pair = probe[high], pair[high]
        sides = n[outer[pair]]
        which, side = np.repeat(np.arange(len(probe)), sides), _spans(start[outer[pair]], sides)
        py = y[probe][which]
        crossed = np.flatnonzero((y[side] > py) != (y_[side] > py))
        which, side, py = which[crossed], side[crossed], py[crossed]
        right = x[probe][which] < x[side] + (py - y[side]) / (y_[side] - y[side]) * (x_[side] - x[side])
        odd = np.bincount(which[right], minlength=len(probe)) % 2 == 1
        inside = np.bincount(pair[odd], minlength=len(inner)) * 2 > n[inner]
        inner, outer = inner[inside], outer[inside]
        depth = np.bincount(inner, minlength=len(n))
        shell = depth[outer] % 2 == 0
        inner, outer = inner[shell], outer[shell]
        best = np.full(len(n), -1)
        order = np.lexsort((outer, area[outer], inner))[::-1]  # the smallest is put last
        best[inner[order]] = outer[order]
        rows, held = pa.array(begin), (depth % 2 == 1) & (best >= 0)
        found = pa.array(np.where(held, begin[best] if len(n) else best, 0), mask=~held)
        return pa.table([t.column(owner).take(rows), c.take(rows), pa.array(depth), c.take(found)], names=list("0123"))

    return work


def nested(points: DataFrame, owner: str, ring: str, place: str) -> DataFrame:
    """(owner, ring, depth, outer) of rings given by their corners (place from 0 without gaps, x, y): outer is null for a shell (even depth), else the smallest shell that holds the ring.

    A ring lies in another of its owner if more than half of its corners do, by the
    parity of the other's sides to their right; the rings of an owner meet only where
    their boxes do. Sides and corners meet by bands of height: a ring of n sides has
    about the square root of n of them. Rings of fewer than three corners are left out.
    Owners of FEW corners at most are worked off within a task by the same rules.
    """
    points = points.select(owner, ring, F.col(place).alias("place"), F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"))
    finite = (F.abs("x") < float("inf")) & (F.abs("y") < float("inf")) & F.col(ring).isNotNull() & F.col("place").isNotNull()
    few, many = _parted(points, owner, ~F.coalesce(finite, F.lit(False)), "large-rings")
    kinds = dict(points.dtypes)
    schema = points.sparkSession.createDataFrame([], f"`{owner}` {kinds[owner]}, `{ring}` {kinds[ring]}, depth long, outer {kinds[ring]}").schema
    out = _by_owner(few, owner, [ring, "place"], _nesting(owner, ring), schema)
    return out if many is None else out.unionByName(_joined_nesting(many, owner, ring, "place"))


def _joined_nesting(points: DataFrame, owner: str, ring: str, place: str) -> DataFrame:
    """``nested`` by joins, for owners of any size."""
    box = points.groupBy(owner, ring).agg(F.count("*").alias("n"), *[f(a).alias(f"{a}{k}") for a in "xy" for k, f in ((0, F.min), (1, F.max))]).filter("n >= 3")
    box = written(box, "ring-boxes")
    corners = meet(points.select(owner, ring, F.col(place).alias("place"), "x", "y"), box.select(owner, ring, "n", F.col("y0").alias("low"), ((F.col("y1") - F.col("y0")) / F.ceil(F.sqrt("n"))).alias("band")), [owner, ring], "n")
    corners = written(corners, "corners")
    after = corners.select(owner, ring, F.pmod(F.col("place") - 1, F.col("n")).alias("place"), F.col("x").alias("x_"), F.col("y").alias("y_"))
    sides = written(corners.join(after, [owner, ring, "place"]), "ring-sides")
    area = sides.groupBy(owner, ring).agg((F.abs(F.sum(F.col("x") * F.col("y_") - F.col("x_") * F.col("y"))) / 2).alias("area"))
    pairs = box_pairs(box.select(owner, F.col(ring).alias("inner"), F.col("n").alias("votes_of"), *[F.col(f"{a}{k}").alias(f"i_{a}{k}") for a in "xy" for k in (0, 1)]), box.select(owner, F.col(ring).alias("outer"), "x0", "x1", "y0", "y1", ((F.col("y1") - F.col("y0")) / F.ceil(F.sqrt("n"))).alias("band_")), [("i_x0", "i_x1"), ("i_y0", "i_y1")], [("x0", "x1"), ("y0", "y1")], [owner]).filter("inner != outer")
    pairs = written(pairs.select(owner, "inner", "outer", "votes_of", F.col("y0").alias("low_"), F.col("y1").alias("high_"), "band_"), "ring-pairs")
    in_band = lambda y, low, band: F.when(F.col(band) > 0, F.floor((y - F.col(low)) / F.col(band))).otherwise(0)
    probes = pairs.join(corners.select(owner, F.col(ring).alias("inner"), "place", F.col("x").alias("px"), F.col("y").alias("py")), [owner, "inner"]).filter("py between low_ and high_")
    probes = probes.withColumn("at", in_band(F.col("py"), "low_", "band_"))
    banded = sides.filter("y != y_").select(owner, F.col(ring).alias("outer"), "x", "y", "x_", "y_", F.explode(F.sequence(in_band(F.least("y", "y_"), "low", "band"), in_band(F.greatest("y", "y_"), "low", "band"))).alias("at"))
    right = (F.col("y") > F.col("py")) != (F.col("y_") > F.col("py"))
    crossing = F.col("x") + (F.col("py") - F.col("y")) / (F.col("y_") - F.col("y")) * (F.col("x_") - F.col("x"))
    hits = probes.join(banded, [owner, "outer", "at"]).filter(right & (F.col("px") < crossing))
    inside = hits.groupBy(owner, "inner", "outer", "votes_of", "place").agg(F.count("*").alias("c")).filter("c % 2 = 1").groupBy(owner, "inner", "outer", "votes_of").agg(F.count("*").alias("votes")).filter("votes * 2 > votes_of")
    inside = written(inside.select(owner, F.col("inner").alias(ring), "outer"), "ring-inside")
    depth = box.select(owner, ring).join(inside.groupBy(owner, ring).agg(F.count("*").alias("depth")), [owner, ring], "left").na.fill(0, ["depth"])
    shells = depth.filter("depth % 2 = 0").join(area, [owner, ring]).select(owner, F.col(ring).alias("outer"), "area")
    best = inside.join(shells, [owner, "outer"]).groupBy(owner, ring).agg(F.min(F.struct("area", "outer"))["outer"].alias("outer"))
    return depth.join(best, [owner, ring], "left").select(owner, ring, "depth", F.when(F.col("depth") % 2 == 1, F.col("outer")).alias("outer"))
