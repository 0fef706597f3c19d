"""Floor plates of one storey: areas of overlapping polygons, gaps between them, levels that belong together.

A level's plate is the union of its polygons; a polygon is one or more rings, and a
point is in it where it lies in an odd number of them. Rings have corners (place from 0
without gaps, x, y). Cases: rings of fewer than three corners and corners without
coordinates are left out; a level without area is connected to none; an empty table gives
nothing.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from girder.operators.keyed import meet, running_sums
from girder.operators.shape import ranked_in_groups
from girder.operators.spatial import box_pairs, cell_mates, mates
from girder.sources.shared import written

#: Fixed values of the rule: levels of one storey rise by no more, their edges are no further apart, and no larger share of the smaller plate lies over the other.
RISE, GAP, STACKED = 7.0, 3.0, 0.12
#: Edges nearer than this touch.
TOUCH = 1e-5


def sides(rings: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, x, y, x_, y_): the sides of rings whose corners (place, x, y) have the same keys."""
    ring = list(dict.fromkeys([*keys, "ring"]))
    corners = rings.filter("x is not null and y is not null").select(*ring, "place", "x", "y")
    size = corners.groupBy(*ring).agg(F.count("*").alias("n_")).filter("n_ >= 3")
    counted = written(meet(corners, size, ring, "n_"), "corners")
    after = counted.select(*ring, F.pmod(F.col("place") - 1, F.col("n_")).alias("place"), F.col("x").alias("x_"), F.col("y").alias("y_"))
    return counted.join(after, [*ring, "place"]).select(*keys, "x", "y", "x_", "y_")


def covered_area(edges: DataFrame, keys: Sequence[str], layers: int) -> DataFrame:
    """(keys, covered): the area that every layer (0 to layers - 1) of a group covers with at least one of its polygons.

    ``edges``: keys, layer, polygon, x, y, x_, y_. A group is cut into slabs at the heights
    of all its corners and of all points where two of its edges cross, so within a slab
    edges keep their order and the covered width at half height times the height is
    exact. Edges and slabs meet by bands of height, and in a slab running sums from left to
    right tell what is covered. Slabs are independent of one another.
    """
    keys = list(keys)
    low, high = F.least("y", "y_").alias("low"), F.greatest("y", "y_").alias("high")
    steep = written(edges.filter("y != y_").select(*keys, "layer", "polygon", "x", "y", "x_", "y_", low, high, F.least("x", "x_").alias("left"), F.greatest("x", "x_").alias("right")).withColumn("edge", F.monotonically_increasing_id()), "edges")
    sides_ = [("left", "right"), ("low", "high")]
    other = steep.select(*keys, *[F.col(c).alias(f"o_{c}") for c in ("edge", "x", "y", "x_", "y_", "left", "right", "low", "high")])
    pairs = box_pairs(steep, other, sides_, [(f"o_{a}", f"o_{b}") for a, b in sides_], keys).filter("edge < o_edge")
    dx, dy, ox, oy = F.col("x_") - F.col("x"), F.col("y_") - F.col("y"), F.col("o_x_") - F.col("o_x"), F.col("o_y_") - F.col("o_y")
    turn = dx * oy - dy * ox
    t = ((F.col("o_x") - F.col("x")) * oy - (F.col("o_y") - F.col("y")) * ox) / F.when(turn != 0, turn)
    u = ((F.col("o_x") - F.col("x")) * dy - (F.col("o_y") - F.col("y")) * dx) / F.when(turn != 0, turn)
    crossings = pairs.withColumns({"t": t, "u": u}).filter("t > 0 and t < 1 and u > 0 and u < 1").select(*keys, (F.col("y") + F.col("t") * dy).alias("h"))
    heights = steep.select(*keys, F.explode(F.array("low", "high")).alias("h")).unionByName(crossings).distinct()
    placed = ranked_in_groups(heights, keys, ["h"])
    slabs = placed.join(placed.select(*keys, (F.col("rank") - 1).alias("rank"), F.col("h").alias("h_")), [*keys, "rank"]).filter("h < h_").select(*keys, "rank", "h", "h_", ((F.col("h") + F.col("h_")) / 2).alias("at"))
    slabs = written(slabs, "slabs")
    extent = written(slabs.groupBy(*keys).agg(F.min("h").alias("bottom"), ((F.max("h_") - F.min("h")) / F.ceil(F.sqrt(F.count("*")))).alias("band"), F.count("*").alias("n_")), "slab-bands")
    place = lambda y: F.floor((y - F.col("bottom")) / F.col("band"))
    cut = meet(steep, extent, keys, "n_").withColumn("b_", F.explode(F.sequence(place(F.col("low")), place(F.col("high"))))).select(*keys, "b_", "layer", "polygon", "x", "y", "x_", "y_", "low", "high")
    lines = meet(slabs, extent, keys, "n_").withColumn("b_", place(F.col("at"))).select(*keys, "b_", "rank", "h", "h_", "at")
    met = lines.join(cut, [*keys, "b_"]).filter("low < at and at < high")
    met = met.withColumn("px", F.col("x") + (F.col("at") - F.col("y")) / (F.col("y_") - F.col("y")) * (F.col("x_") - F.col("x")))
    slab = [*keys, "rank"]
    nth = F.row_number().over(Window.partitionBy(*slab, "layer", "polygon").orderBy("px"))
    met = met.withColumn("step", F.when(nth % 2 == 1, 1).otherwise(-1))
    over = Window.partitionBy(*slab).orderBy("px", "layer", "polygon")
    running = over.rowsBetween(Window.unboundedPreceding, 0)
    covers = [F.sum(F.when(F.col("layer") == k, F.col("step")).otherwise(0)).over(running).alias(f"c{k}") for k in range(layers)]
    widths = met.select(*keys, "h", "h_", (F.lead("px").over(over) - F.col("px")).alias("w"), *covers).filter(" and ".join(f"c{k} > 0" for k in range(layers)))
    return widths.groupBy(*keys).agg(F.sum(F.col("w") * (F.col("h_") - F.col("h"))).alias("covered"))


def _upright_pairs(box: DataFrame, sizes: Sequence[float], rule: tuple[float, float, float], digits: int | None) -> DataFrame:
    """Connections of the upright rectangles among ``box`` (model, level, elevation, area, x0, x1, y0, y1, plain); ``sizes``: about how far one reaches on each axis."""
    rise, gap, _ = rule
    # a trifle more than the rule's reach: rounding must not hide a pair that the rule's own comparisons take
    far = gap * (1 + 1e-9)
    plain_ = box.filter("plain").select("model", "level", "elevation", "area", "x0", "x1", "y0", "y1")
    reach = plain_.withColumns({"top": F.col("elevation") + rise * (1 + 1e-9), **{f"{a}{k}_": F.col(f"{a}{k}") + (far if k else -far) for a in "xy" for k in (0, 1)}})
    wide, high, tall = sizes
    met, keys = cell_mates(reach, plain_, [("elevation", "top"), ("x0_", "x1_"), ("y0_", "y1_")], [("elevation", "elevation"), ("x0", "x1"), ("y0", "y1")], ["model"], [2 * tall, wide * 2 / 3, high * 2 / 3], "elevation")
    kinds = dict(box.dtypes)
    names = pa.schema([("model", to_arrow_type(box.schema["model"].dataType)), *[(c, to_arrow_type(box.schema["level"].dataType)) for c in ("lower", "upper")], *[(c, pa.float64()) for c in ("rise", "gap", "ratio")]])
    return met.mapInArrow(_upright(rule, digits, keys, names), f"model {kinds['model']}, lower {kinds['level']}, upper {kinds['level']}, rise double, gap double, ratio double")


def connections(levels: DataFrame, rings: DataFrame, rise: float = RISE, gap: float = GAP, stacked: float = STACKED, digits: int | None = None) -> tuple[DataFrame, DataFrame]:
    """((model, lower, upper, rise, gap, ratio) of levels that belong to one storey, (model, level, elevation, area) of all levels).

    ``digits``: decimals of gap and ratio, rounded where they are made, as a pass over all pairs costs as much as most of their tests.
    """
    upright, odd, plates, _ = _connections(levels, rings, rise, gap, stacked, digits)
    if odd is not None:
        upright = upright.unionByName(odd if digits is None else odd.withColumns({c: F.floor(F.col(c) * 10.0**digits + 0.5) / 10.0**digits for c in ("gap", "ratio")}))
    return upright, plates


#: Pairs of rectangles that are looked at together, and rows of a batch (about).
LOOK, ROWS = 1 << 16, 1 << 16


def _judged(one: Sequence[np.ndarray], two: Sequence[np.ndarray], smaller: Callable[[np.ndarray], np.ndarray], fits: np.ndarray, gap: float, stacked: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(places, gap, ratio) of those pairs of rectangles (x0, x1, y0, y1 of each) that fit, lie near enough and not on one another.

    Rectangles apart on an axis: where they overlap on the other one, a corner lies beside
    the other's side. Rectangles that overlap, be they crossed, shifted or one in the other:
    some corner is as far from a side as the nearest two parallel sides are from each other.
    ``smaller``: the smaller area of the pairs at some places.
    """
    apart = [np.maximum(two[k] - one[k + 1], one[k] - two[k + 1]) for k in (0, 2)]
    over = np.flatnonzero((apart[0] < 0) & (apart[1] < 0))
    apart = [np.maximum(x, 0.0) for x in apart]
    between, ratio = np.sqrt(apart[0] * apart[0] + apart[1] * apart[1]), np.zeros(len(fits))
    if len(over):
        a, b = ([x.take(over) for x in sides] for sides in (one, two))
        ratio[over] = (np.minimum(a[1], b[1]) - np.maximum(a[0], b[0])) * (np.minimum(a[3], b[3]) - np.maximum(a[2], b[2])) / smaller(over)
        between[over] = np.minimum.reduce([np.abs(a[i] - b[k]) for n in (0, 2) for i in (n, n + 1) for k in (n, n + 1)])
    found = np.flatnonzero(fits & (between <= gap) & (ratio <= stacked))
    between = between.take(found)
    return found, np.where(between > TOUCH, between, 0.0), ratio.take(found)


class _Block:
    """Upright rectangles of a cell by elevation; ``ranks`` of their sides among one another, for comparisons of small numbers."""

    def __init__(self, rows: pa.Table | pa.RecordBatch, ranked: bool = False):
        level = rows.column("level")
        self.level = level.combine_chunks() if isinstance(level, pa.ChunkedArray) else level
        self.elevation, self.area = rows.column("elevation").to_numpy(), rows.column("area").to_numpy()
        self.box = np.stack([rows.column(c).to_numpy() for c in ("x0", "x1", "y0", "y1")])
        if ranked:
            self.kind = np.int16 if rows.num_rows < 1 << 15 else np.int64
            self.sorted = np.sort(self.box, 1)
            self.ranks = np.stack([np.searchsorted(s, x).astype(self.kind) for s, x in zip(self.sorted, self.box, strict=True)])

    def bounds(self, box: np.ndarray, gap: float) -> np.ndarray:
        """Of each rectangle, the ranks that sides of others must be below (x0, y0) or not below (x1, y1) to lie within ``gap``."""
        return np.stack([np.searchsorted(self.sorted[k], box[n] + d, w).astype(self.kind) for k, n, d, w in ((0, 1, gap, "right"), (1, 0, -gap, "left"), (2, 3, gap, "right"), (3, 2, -gap, "left"))])


def _upright(rule: tuple[float, float, float], digits: int | None, keys: Sequence[str], names: pa.Schema):
    """Connections of upright rectangles from rows of ``cell_mates`` by elevation; some thousand pairs are looked at together."""
    rise, gap, stacked = rule
    up_to, far = rise * (1 + 1e-9), gap * (1 + 1e-9)  # for a first look; the rule's own comparisons follow

    def pairs(lower: _Block, upper: _Block) -> Iterator[tuple[slice, np.ndarray, np.ndarray]]:
        """Rectangles below, the number of those above that are near to each and may rise by so much, and the places of these."""
        bounds, begins, n = upper.bounds(lower.box, far)[:, :, None], 0, len(lower.elevation)
        lows, highs = np.searchsorted(upper.elevation, lower.elevation, "left"), np.searchsorted(upper.elevation, lower.elevation + up_to, "right")
        while begins < n:
            low = int(lows[begins])
            ends = min(n, begins + max(1, LOOK // max(1, int(highs[begins]) - low)))
            high = int(highs[ends - 1])
            if high > low:
                a, b = bounds[:, begins:ends], upper.ranks[:, low:high]
                near = b[0] < a[0]
                near &= b[1] >= a[1]
                near &= b[2] < a[2]
                near &= b[3] >= a[3]
                at = np.flatnonzero(near)
                each = np.diff(np.searchsorted(at, np.arange(ends - begins + 1) * (high - low)))
                at -= np.repeat(np.arange(ends - begins) * (high - low) - low, each)
                yield slice(begins, ends), each, at
            begins = ends

    def above(batches: Iterator[pa.RecordBatch]) -> Iterator[list[pa.Array | np.ndarray]]:
        block = None
        for rows, part in mates(batches, keys):
            if rows is not block:
                block, upper = rows, _Block(rows, True)
            lower = _Block(part)
            for below, each, k in pairs(lower, upper):
                i, of = np.repeat(np.arange(below.start, below.stop), each), lambda x: np.repeat(x[below], each)  # noqa: B023, E731
                up = upper.elevation.take(k) - of(lower.elevation)
                fits, even = (up >= 0) & (up <= rise), np.flatnonzero(up == 0)
                fits[even] = pc.greater(upper.level.take(pa.array(k[even])), lower.level.take(pa.array(i[even]))).to_numpy(zero_copy_only=False)
                found, between, ratio = _judged([of(x) for x in lower.box], [x.take(k) for x in upper.box], lambda at: np.minimum(lower.area.take(i.take(at)), upper.area.take(k.take(at))), fits, gap, stacked)  # noqa: B023
                if digits is not None:
                    between, ratio = (np.floor(x * 10.0**digits + 0.5) / 10.0**digits for x in (between, ratio))
                if len(found):
                    yield [pa.repeat(part.column("model")[0], len(found)), lower.level.take(pa.array(i.take(found))), upper.level.take(pa.array(k.take(found))), up.take(found), between, ratio]

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = [], 0
        with np.errstate(invalid="ignore", divide="ignore", over="ignore"):
            for found in above(batches):
                held.append(pa.RecordBatch.from_arrays([pa.array(c).cast(f.type) for c, f in zip(found, names, strict=True)], schema=names))
                rows += len(found[-1])
                if rows >= ROWS:
                    yield pa.concat_batches(held)
                    held, rows = [], 0
        if held:
            yield pa.concat_batches(held)

    return over


def _connections(levels: DataFrame, rings: DataFrame, rise: float, gap: float, stacked: float, digits: int | None = None, pairs: bool = True) -> tuple[DataFrame | None, DataFrame | None, DataFrame, DataFrame]:
    """Connections of two upright rectangles (not yet met) and all others (None if every plate is one), the levels, the boxes (model, level, x0, x1, y0, y1, plain) of levels with an area.

    ``levels``: model, level, elevation; ``rings``: model, level, polygon, ring, place, x, y.
    Two levels of a model are connected if they rise by at most ``rise``, some corner of one
    is at most ``gap`` from an edge of the other, and at most the share ``stacked`` of the smaller
    plate lies over the other one. Only levels whose boxes are that near are compared, and
    corners and edges meet on levels of cells. Edges inside a plate count as its edges.
    Pairs of plates that are one upright rectangle each are judged where they are met, by the
    same corners and edges, so nothing of them is written or shuffled; without ``pairs`` they are left out (None).
    """
    level = ["model", "level"]
    edges = written(sides(rings, [*level, "polygon", "ring"]), "plate-edges")
    box = edges.groupBy(*level).agg(*[f(a).alias(f"{a}{k}") for a in "xy" for k, f in ((0, F.min), (1, F.max))], F.count("*").alias("sides_"), ((F.min("polygon") == F.max("polygon")) & (F.min("ring") == F.max("ring"))).alias("one_"), *[F.max(F.when(F.col(f"{a}_") == F.col(a), F.abs(F.col(f"{b}_") - F.col(b)))).alias(f"most_{b}") for a, b in ("xy", "yx")], *[F.min(F.when(F.col(f"{a}_") == F.col(a), F.abs(F.col(f"{b}_") - F.col(b)))).alias(f"least_{b}") for a, b in ("xy", "yx")], F.count_if((F.col("x_") == F.col("x")) & (F.col("y_") != F.col("y"))).alias("upright_"), F.count_if((F.col("y_") == F.col("y")) & (F.col("x_") != F.col("x"))).alias("level_"))
    wide, high = F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")
    plain = (F.col("sides_") == 4) & F.col("one_") & (F.col("upright_") == 2) & (F.col("level_") == 2) & (F.col("least_x") == wide) & (F.col("most_x") == wide) & (F.col("least_y") == high) & (F.col("most_y") == high)
    box = written(box.select(*level, "x0", "x1", "y0", "y1", F.coalesce(plain, F.lit(False)).alias("plain")), "plate-boxes")
    odd = written(edges.drop("ring").join(box.filter("not plain").select(*level), level, "left_semi"), "odd-edges")
    only_plain = odd.isEmpty()
    areas = box.filter("plain").select(*level, (wide * high).alias("covered"))
    if not only_plain:
        areas = areas.unionByName(covered_area(odd.withColumn("layer", F.lit(0)), level, 1))
    plates = written(levels.select(*level, F.col("elevation").cast("double").alias("elevation")).join(areas, level, "left").select(*level, "elevation", F.coalesce("covered", F.lit(0.0)).alias("area")), "plates")
    box = written(plates.filter("area > 0").join(box, level), "plate-levels")
    low = box.select("model", F.col("level").alias("lower"), F.col("plain").alias("plain0"), F.col("elevation").alias("e0"), (F.col("elevation") + rise).alias("e1"), F.col("area").alias("area0"), *[(F.col(f"{a}{k}") + (gap if k else -gap)).alias(f"a_{a}{k}") for a in "xy" for k in (0, 1)], *[F.col(f"{a}{k}").alias(f"o_{a}{k}") for a in "xy" for k in (0, 1)])
    up = box.select("model", F.col("level").alias("upper"), F.col("plain").alias("plain1"), F.col("elevation").alias("e"), F.col("area").alias("area1"), *[F.col(f"{a}{k}").alias(f"b_{a}{k}") for a in "xy" for k in (0, 1)])
    mean = box.agg(F.avg(wide), F.avg(high)).first()
    sizes = [x + 2 * gap if x and math.isfinite(x) else 1.0 for x in mean] + [rise if rise > 0 else 1.0]

    def above(low: DataFrame, up: DataFrame) -> DataFrame:
        met = box_pairs(low, up, [("a_x0", "a_x1"), ("a_y0", "a_y1"), ("e0", "e1")], [("b_x0", "b_x1"), ("b_y0", "b_y1"), ("e", "e")], ["model"], sizes)
        met = met.filter((F.col("e") > F.col("e0")) | (F.col("e") == F.col("e0")) & (F.col("upper") > F.col("lower")))
        return met.withColumns({"rise": F.col("e") - F.col("e0"), "smaller": F.least("area0", "area1")})

    upright = _upright_pairs(box, sizes, (rise, gap, stacked), digits) if pairs else None
    if only_plain:
        return upright, None, plates, box
    edges = edges.drop("ring")
    near = above(low.filter("not plain0"), up).unionByName(above(low.filter("plain0"), up.filter("not plain1"))).select("model", "lower", "upper", "rise", "smaller")
    near = written(near.withColumn("pair", F.monotonically_increasing_id()), "plate-pairs")
    ends = near.select("pair", "model", F.col("lower").alias("level"), F.lit(0).alias("layer")).unionByName(near.select("pair", "model", F.col("upper").alias("level"), F.lit(1).alias("layer")))
    both = written(ends.join(edges, level).select("pair", "layer", "polygon", "x", "y", "x_", "y_"), "pair-edges")
    points = both.select("pair", (1 - F.col("layer")).alias("layer"), F.col("x").alias("px"), F.col("y").alias("py")).distinct()
    reach = both.withColumns({f"{a}_{k}": f(a, f"{a}_") + d for a in "xy" for k, f, d in (("low", F.least, -gap), ("high", F.greatest, gap))})
    met = box_pairs(reach, points, [("x_low", "x_high"), ("y_low", "y_high")], [("px", "px"), ("py", "py")], ["pair", "layer"], [2 * gap] * 2)
    dx, dy = F.col("x_") - F.col("x"), F.col("y_") - F.col("y")
    length = dx * dx + dy * dy
    t = F.when(length > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((F.col("px") - F.col("x")) * dx + (F.col("py") - F.col("y")) * dy) / length))).otherwise(0.0)
    gaps = met.groupBy("pair").agg(F.min(F.hypot(F.col("px") - F.col("x") - t * dx, F.col("py") - F.col("y") - t * dy)).alias("gap")).filter(F.col("gap") <= gap)
    touching = written(near.join(gaps.select("pair", F.when(F.col("gap") > TOUCH, F.col("gap")).otherwise(0.0).alias("gap")), "pair"), "plate-gaps")
    shared = covered_area(both.join(touching.select("pair"), "pair", "left_semi"), ["pair"], 2)
    ratio = F.coalesce("covered", F.lit(0.0)) / F.col("smaller")
    odd_pairs = touching.join(shared, "pair", "left").withColumn("ratio", ratio).filter(F.col("ratio") <= stacked).select("model", "lower", "upper", "rise", "gap", "ratio")
    return upright, odd_pairs, plates, box


def _rectangles(rule: tuple[float, float, float], box: np.ndarray, elevation: np.ndarray, area: np.ndarray, a: int, b: np.ndarray) -> np.ndarray:
    """Those of the rectangles ``b`` (places) that rectangle ``a`` below them is connected to; ``box``: x0, x1, y0, y1 of each place."""
    rise, gap, stacked = rule
    b = b[elevation[b] - elevation[a] <= rise]
    one, two = box[:, [a]], box[:, b]
    apart = [np.maximum(np.maximum(two[k] - one[k + 1], one[k] - two[k + 1]), 0.0) for k in (0, 2)]
    near = (apart[0] <= gap) & (apart[1] <= gap)
    b, two, apart = b[near], two[:, near], [x[near] for x in apart]
    shared = [np.maximum(np.minimum(one[k + 1], two[k + 1]) - np.maximum(one[k], two[k]), 0.0) for k in (0, 2)]
    level = shared[0] * shared[1] / np.minimum(area[a], area[b]) <= stacked
    b, two, apart = b[level], two[:, level], [x[level] for x in apart]
    between = np.hypot(*apart)
    met = np.flatnonzero((apart[0] <= 0) & (apart[1] <= 0))
    if len(met):
        low = np.full(len(met), np.inf)
        for own, other in ((np.repeat(one, len(met), 1), two[:, met]), (two[:, met], np.repeat(one, len(met), 1))):
            for i in (0, 1):
                for k in (2, 3):
                    within = [own[i] - other[0], other[1] - own[i], own[k] - other[2], other[3] - own[k]]
                    least = np.minimum.reduce(within)
                    low = np.minimum(low, np.where(least >= 0, least, np.hypot(np.maximum(np.maximum(-within[0], -within[1]), 0), np.maximum(np.maximum(-within[2], -within[3]), 0))))
        between[met] = low
    return b[between <= gap]


class _Run:
    """The levels of one run in order (a table of ``model``, ``level``, ``elevation``, ``area``, box and ``plain``) and their groups."""

    def __init__(self, rows: pa.Table, span: float, rule: tuple[float, float, float]):
        self.rows, self.span, self.rule = rows, span, rule
        self.elevation, self.area = (rows.column(c).to_numpy().astype(float) for c in ("elevation", "area"))
        self.box = np.stack([rows.column(c).to_numpy().astype(float) for c in ("x0", "x1", "y0", "y1")])
        self.plain = rows.column("plain").to_numpy(zero_copy_only=False).astype(bool)
        self.low, self.high, self.root, self.members = self.elevation.copy(), self.elevation.copy(), np.arange(rows.num_rows), {}
        self.done, self.block, self.began, self.open = 0, (0, 0), self.root, {}

    def compatible(self, p: int, places: np.ndarray) -> np.ndarray:
        """Places whose group isn't ``p`` and may still merge with it. Others never will, since groups only grow."""
        q = self.root[places]
        return places[(q != p) & (np.maximum(self.high[p], self.high[q]) - np.minimum(self.low[p], self.low[q]) <= self.span)]

    def merge(self, a: int, places: np.ndarray) -> None:
        root, low, high = self.root, self.low, self.high
        for n in self.compatible(int(root[a]), places).tolist():
            p, q = int(root[a]), int(root[n])
            if p != q and max(high[p], high[q]) - min(low[p], low[q]) <= self.span:
                one, two = self.members.pop(p, None) or [p], self.members.pop(q, None) or [q]
                if len(one) < len(two):
                    p, q, one, two = q, p, two, one
                one.extend(two)
                root[two], self.members[p] = p, one
                low[p], high[p] = min(low[p], low[q]), max(high[p], high[q])

    def above(self, a: int) -> np.ndarray:
        """Rectangles above rectangle ``a`` that are connected to it and may still merge with its group, in order."""
        if not self.plain[a]:
            return np.zeros(0, np.int64)
        if a >= self.block[1]:  # what can't merge when a block begins never can
            begins, ends = a, min(a + 256, len(self.root))
            upto = int(np.searchsorted(self.elevation, self.elevation[ends - 1] + self.rule[0] + 1e-6, "right"))
            self.block, self.began, self.open = (begins, ends), self.root[begins:ends].copy(), {}
            self.window = begins + np.flatnonzero(self.plain[begins:upto])
        p = int(self.began[a - self.block[0]])
        if p not in self.open:
            self.open[p] = self.compatible(int(self.root[p]), self.window)
        found = self.open[p]
        found = self.compatible(int(self.root[a]), found[np.searchsorted(found, a, "right") :])
        return _rectangles(self.rule, self.box, self.elevation, self.area, a, found) if len(found) else found

    def upto(self, a: int) -> None:
        """Work off the levels before ``a``, which have no pairs but those of rectangles."""
        for k in range(self.done, a):
            self.merge(k, self.above(k))
        self.done = max(self.done, a)

    def pairs(self, a: np.ndarray, b: np.ndarray) -> None:
        """Work off other pairs, in order; all of a level's are told at once."""
        cuts = [0, *(np.flatnonzero(np.diff(a)) + 1).tolist(), len(a)]
        for begins, ends in zip(cuts[:-1], cuts[1:], strict=True):
            if begins < ends:
                k = int(a[begins])
                self.upto(k)
                self.merge(k, np.union1d(b[begins:ends], self.above(k)))
                self.done = k + 1

    def groups(self, names: pa.Schema) -> pa.RecordBatch:
        self.upto(len(self.root))
        n = len(self.root)
        _, of = np.unique(self.root, return_inverse=True)
        first, largest = np.full(of.max() + 1, n), np.empty(of.max() + 1, np.int64)
        np.minimum.at(first, of, np.arange(n))
        order = np.lexsort((-np.arange(n), self.area))  # the last of a group is its largest plate, of equal ones the first
        largest[of[order]] = order
        level = self.rows.column("level").combine_chunks()
        columns = [self.rows.column("model").combine_chunks(), level, level.take(pa.array(first[of])), level.take(pa.array(largest[of]))]
        return pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, names, strict=True)], schema=names)


def _merged(span: float, rule: tuple[float, float, float], names: pa.Schema):
    """Groups of the levels of each run, from rows by run: its levels in order (side 0), then its pairs of places in order (side 1)."""

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, levels, run, left = None, [], None, (np.zeros(0, np.int64), np.zeros(0, np.int64))

        def ended() -> Iterator[pa.RecordBatch]:
            if levels:
                whole = run or _Run(pa.Table.from_batches(levels), span, rule)
                whole.pairs(*left)
                out = whole.groups(names)
                yield from (out.slice(k, 10000) for k in range(0, out.num_rows, 10000))

        for batch in batches:
            models, runs = batch.column("model").to_pylist(), batch.column("run").to_pylist()
            cuts = [0, *[k for k in range(1, len(runs)) if (models[k], runs[k]) != (models[k - 1], runs[k - 1])], len(runs)]
            for begins, ends in zip(cuts[:-1], cuts[1:], strict=True):
                if begins == ends:
                    continue
                if (models[begins], runs[begins]) != now:
                    yield from ended()
                    now, levels, run, left = (models[begins], runs[begins]), [], None, (left[0][:0], left[1][:0])
                part = batch.slice(begins, ends - begins)
                n = int(np.sum(part.column("side").to_numpy() == 0))
                if n:
                    levels.append(part.slice(0, n))
                if n < part.num_rows:
                    run = run or _Run(pa.Table.from_batches(levels), span, rule)
                    a, b = (np.concatenate([left[k], part.slice(n).column(c).to_numpy()]) for k, c in enumerate("ab"))
                    whole = int(np.searchsorted(a, a[-1]))  # the last level's pairs may go on in the next batch
                    run.pairs(a[:whole], b[:whole])
                    left = a[whole:], b[whole:]
        yield from ended()

    return over


def storeys(plates: DataFrame, joined: DataFrame | None, span: float = RISE, rectangles: DataFrame | None = None, rule: tuple[float, float, float] = (RISE, GAP, STACKED)) -> DataFrame:
    """(model, level, group_level, primary_level): levels merged along connections, lowest pair first, unless a group would rise by more than ``span`` in all.

    group_level: the group's first level by elevation, primary_level: that of the largest plate.
    Whether two groups merge depends on every merge before, so each model is worked off in
    order, but apart for each run of levels without a step of more than ``span``: no
    connection leads from one run into another. A run's pairs are read in order as a stream; only
    its levels are held. Pairs of ``rectangles`` (model, level, x0, x1, y0, y1, plain; by ``rule``: rise, gap, stacked)
    aren't among ``joined``: each is judged where its level's turn comes, if its two groups may still merge.
    """
    placed = ranked_in_groups(plates, ["model"], ["elevation", "level"])
    before = placed.select("model", (F.col("rank") + 1).alias("rank"), F.col("elevation").alias("before_"))
    jumps = placed.join(before, ["model", "rank"], "left").withColumn("jump", F.when(F.col("elevation") - F.col("before_") <= span, 0).otherwise(1))
    runs = written(running_sums(jumps, ["model"], "rank", "jump", "run").select("model", "run", "rank", "level", "elevation", "area"), "storey-runs")
    starts = runs.groupBy("model", "run").agg(F.min("rank").alias("start_"))
    at = written(runs.join(starts, ["model", "run"]).withColumn("at", (F.col("rank") - F.col("start_")).cast("long")), "storey-places")
    kinds = dict(plates.dtypes)
    sides_ = ["x0", "x1", "y0", "y1"]
    boxes = at.select("model", "level").join(rectangles.filter("plain").select("model", "level", *sides_, "plain"), ["model", "level"]) if rectangles is not None else at.limit(0).select("model", "level", *[F.lit(0.0).alias(c) for c in sides_], F.lit(True).alias("plain"))
    both = at.join(boxes, ["model", "level"], "left").select("model", "run", F.lit(0).alias("side"), F.col("at").alias("a"), F.lit(0).cast("long").alias("b"), "level", "elevation", "area", *[F.coalesce(c, F.lit(0.0)).alias(c) for c in sides_], F.coalesce("plain", F.lit(False)).alias("plain"))
    if joined is not None:
        pairs = joined.select("model", "lower", "upper").join(at.select("model", F.col("level").alias("lower"), "run", F.col("at").alias("a")), ["model", "lower"]).join(at.select("model", "run", F.col("level").alias("upper"), F.col("at").alias("b")), ["model", "run", "upper"])
        nothing = [F.lit(None).cast(kinds["level"]).alias("level"), *[F.lit(None).cast("double").alias(c) for c in ("elevation", "area", *sides_)], F.lit(None).cast("boolean").alias("plain")]
        both = both.unionByName(pairs.select("model", "run", F.lit(1).alias("side"), "a", "b", *nothing))
    schema = f"model {kinds['model']}, level {kinds['level']}, group_level {kinds['level']}, primary_level {kinds['level']}"
    of = {c: to_arrow_type(plates.schema[c].dataType) for c in ("model", "level")}
    names = pa.schema([("model", of["model"]), *[(c, of["level"]) for c in ("level", "group_level", "primary_level")]])
    return both.repartition("model", "run").sortWithinPartitions("model", "run", "side", "a", "b").mapInArrow(_merged(span, rule, names), schema)


def connected_storeys(levels: DataFrame, rings: DataFrame, rise: float = RISE, gap: float = GAP, stacked: float = STACKED, span: float = RISE) -> DataFrame:
    """``storeys`` of the connections of levels and rings; pairs of upright rectangles, as many as the square of near levels, are neither written nor shuffled."""
    _, odd, plates, boxes = _connections(levels, rings, rise, gap, stacked, pairs=False)
    return storeys(plates, odd, span, boxes, (rise, gap, stacked))
