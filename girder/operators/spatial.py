"""Boxes, cells and neighbourhoods: range joins as equi-joins on grid cells."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Mapping, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from girder.operators.shape import ranked
from girder.sources.shared import written


def cell(x: Column, size: float) -> Column:
    return F.floor(x / size).cast("long")


#: Levels of cells: each has cells twice as wide as the one before.
LEVELS = 1100
#: Combinations of the axes' levels under which a point is listed at most.
SHAPES = 64
#: In ``cell_mates``: cells that a box is wide at most, boxes of a cell that are held at once (about), rows of a task (about).
WIDE, BLOCK, PART = 3, 4096, 1_000_000


def _level(sides: Sequence[tuple[str, str]], sizes: Sequence[float]) -> Column:
    """The level on which a box is at most one cell wide on every axis, so it touches at most two cells of an axis."""
    times = F.greatest(F.lit(1.0), *[(F.col(high) - F.col(low)) / size for (low, high), size in zip(sides, sizes, strict=True)]) if len(sides) else F.lit(1.0)
    return F.least(F.ceil(F.log2(times)).cast("int"), F.lit(LEVELS))


def _levels(boxes: DataFrame, sides: Sequence[tuple[str, str]], sizes: Sequence[float]) -> list[int]:
    """The levels that boxes lie on, at most LEVELS."""
    return sorted(r[0] for r in boxes.select(_level(sides, sizes)).distinct().collect() if r[0] is not None)


def _celled(rows: DataFrame, sides: Sequence[tuple[str, str]], sizes: Sequence[float], levels: Sequence[str] | None = None) -> DataFrame:
    """Rows under each cell (``cell0_`` ...) of their level (``level_``, or a column for each axis) that they touch."""
    for k, ((low, high), size) in enumerate(zip(sides, sizes, strict=True)):
        width = F.lit(float(size)) * F.pow(F.lit(2.0), F.col(levels[k] if levels else "level_"))
        rows = rows.withColumn(f"cell{k}_", F.explode(F.sequence(F.floor(F.col(low) / width), F.floor(F.col(high) / width))) if low != high else F.floor(F.col(low) / width))
    return rows


def spread(rows: DataFrame) -> DataFrame:
    """Rows in as many even parts as a shuffle has: a few bytes may stand for many pairs, and a broadcast join leaves rows in the parts they come in."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def _valid(rows: DataFrame, sides: Sequence[tuple[str, str]]) -> DataFrame:
    for low, high in sides:
        rows = rows.filter(F.col(low) <= F.col(high))
    return rows


def containment_join(boxes: DataFrame, points: DataFrame, axes: Mapping[str, tuple[str, str]], sizes: Sequence[float]) -> DataFrame:
    """Boxes joined with the points they hold (ends included).

    ``axes`` maps a point's column to the box's (low, high) columns. There are
    levels of cells, the finest of ``sizes``; a box is listed under the few cells of the
    levels of its own sides (one for each axis; of its longest side for all, if boxes
    lie on more than SHAPES), a point under its cell of each that has boxes, so the
    join is an equi-join, every pair is met once, and a huge or long box costs no more
    than a small one.
    """
    sides = list(axes.values())
    a = _valid(boxes, sides)
    names = [f"level{k}_" for k in range(len(axes))]
    own = [_level([side], [size]) for side, size in zip(sides, sizes, strict=True)]
    shapes = [tuple(r) for r in a.select(*[x.alias(c) for x, c in zip(own, names, strict=True)]).distinct().limit(SHAPES + 1).collect()] if axes else [()]
    if len(shapes) > SHAPES:
        own = [_level(sides, sizes)] * len(axes)
        shapes = [(k,) * len(axes) for k in _levels(a, sides, sizes)]
    kinds = f"array<struct<{', '.join(f'{c}: int' for c in names)}>>"
    listed = F.array(*[F.struct(*[F.lit(x).cast("int").alias(c) for x, c in zip(shape, names, strict=True)]) for shape in shapes if None not in shape]).cast(kinds)
    a = _celled(spread(a).withColumns(dict(zip(names, own, strict=True))), sides, sizes, names)  # either side may be the one that is broadcast
    b = _celled(spread(points).withColumn("shape_", F.explode(listed)).select("*", "shape_.*").drop("shape_"), [(p, p) for p in axes], sizes, names)
    keys = [*names, *[f"cell{k}_" for k in range(len(axes))]]
    joined = a.join(b, keys)
    for p, (low, high) in axes.items():
        joined = joined.filter(F.col(p).between(F.col(low), F.col(high)))
    return joined.drop(*keys)


def box_pairs(a: DataFrame, b: DataFrame, a_sides: Sequence[tuple[str, str]], b_sides: Sequence[tuple[str, str]], by: Sequence[str] = (), sizes: Sequence[float] | None = None) -> DataFrame:
    """Pairs of boxes (of the same ``by``) that share a point, ends included; other columns' names must differ.

    Each box is listed on the level of its own size and, to meet larger ones, on
    the levels above it; a pair is told in the cell that holds the lower corner of what
    they share, so once.
    """
    sizes = sizes or [1.0] * len(a_sides)
    a, b = _valid(a, a_sides), _valid(b, b_sides)
    levels = sorted({*_levels(a, a_sides, sizes), *_levels(b, b_sides, sizes)})
    every = F.array(*[F.lit(k) for k in levels]).cast("array<int>")
    keys = [*by, "level_", *[f"cell{k}_" for k in range(len(sizes))]]

    def listed(rows: DataFrame, sides: Sequence[tuple[str, str]], above: int | None) -> DataFrame:
        own = _level(sides, sizes)
        if above is None:
            return _celled(rows.withColumn("level_", own), sides, sizes)
        return _celled(rows.withColumn("level_", F.explode(F.filter(every, lambda x: x >= own + above))), sides, sizes)

    a, b = spread(a), spread(b)  # either may be the one that is broadcast
    met = listed(a, a_sides, 0).join(listed(b, b_sides, None), keys).unionByName(listed(a, a_sides, None).join(listed(b, b_sides, 1), keys))
    for k, ((al, ah), (bl, bh), size) in enumerate(zip(a_sides, b_sides, sizes, strict=True)):
        corner = F.greatest(al, bl)
        met = met.filter((corner <= F.least(ah, bh)) & (F.floor(corner / (F.lit(float(size)) * F.pow(F.lit(2.0), F.col("level_")))) == F.col(f"cell{k}_")))
    return met.drop(*[k for k in keys if k not in by])


def cell_mates(a: DataFrame, b: DataFrame, a_sides: Sequence[tuple[str, str]], b_sides: Sequence[tuple[str, str]], by: Sequence[str], sizes: Sequence[float], order: str) -> tuple[DataFrame, list[str]]:
    """Boxes by cell for ``mates``, and their keys: those of ``b`` (``side_`` 0) before those of ``a`` (1), by ``order``; with the columns that both have.

    For tables whose boxes meet many others, where ``box_pairs`` does too much for each
    pair. A box of ``b`` is listed under one cell, that of its lower corner, and a box
    of ``a`` under each cell that may hold the corner of a box it meets, so a pair is met once, on
    the level of the larger box (``sizes``: cells of level 0), and most that are met share a point. A
    cell of more boxes of ``b`` than BLOCK is cut into blocks, which spread over tasks.
    """
    a, b = (_valid(rows, sides).dropna(subset=list(by)) for rows, sides in ((a, a_sides), (b, b_sides)))
    wide = [WIDE * size for size in sizes]
    ends = b.agg(*[x for k, (low, high) in enumerate(b_sides) for x in (F.min(low).alias(f"first{k}"), F.max(low).alias(f"last{k}"), F.max(F.col(high) - F.col(low)).alias(f"widest{k}"))]).first()
    levels = sorted({*_levels(a, a_sides, wide), *_levels(b, b_sides, wide)}) or [0]
    every = F.array(*[F.lit(k) for k in levels]).cast("array<int>")
    cells = [*by, "level_", *[f"cell{k}_" for k in range(len(sizes))]]
    kept = [c for c in a.columns if c in b.columns and c not in by]
    side = [F.lit(float(size)) * F.pow(F.lit(2.0), F.col("level_")) for size in sizes]

    def levelled(rows: DataFrame, sides: Sequence[tuple[str, str]], above: int | None) -> DataFrame:
        own = _level(sides, wide)
        return rows.withColumn("level_", own if above is None else F.explode(F.filter(every, lambda x: x >= own + above)))

    def window(k: int) -> tuple[Column, Column]:
        """The first and last cell where a box of ``b`` that a box of ``a`` meets may begin."""
        low, high = a_sides[k]
        reach = F.least(WIDE * side[k], F.lit(ends[f"widest{k}"])) * (1 + 1e-9)  # rounding must not hide a box that is just as wide
        first, last = (F.floor(F.lit(ends[f"{end}{k}"]) / side[k]) for end in ("first", "last"))
        return F.greatest(F.floor((F.col(low) - reach) / side[k]), first), F.least(F.floor(F.col(high) / side[k]), last)

    def listed(above_a: int | None, above_b: int | None) -> DataFrame:
        many, few = levelled(spread(a), a_sides, above_a), levelled(b, b_sides, above_b)
        for k, (low, _) in enumerate(b_sides):
            first, last = window(k)
            few = few.withColumn(f"cell{k}_", F.floor(F.col(low) / side[k]))
            many = many.withColumn(f"cell{k}_", F.explode(F.when(first <= last, F.sequence(first, last))))
        crowded = written(few.groupBy(*cells).agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks_")).filter("blocks_ > 1"), "crowded-cells")
        block = F.coalesce("blocks_", F.lit(1))
        few = few.join(F.broadcast(crowded), cells, "left").withColumn("block_", F.pmod(F.xxhash64(*b.columns), block).cast("int"))
        many = many.join(F.broadcast(crowded), cells, "left").withColumn("block_", F.explode(F.sequence(F.lit(0), block - 1)))
        return few.select(*cells, "block_", F.lit(0).alias("side_"), *kept).unionByName(many.select(*cells, "block_", F.lit(1).alias("side_"), *kept))

    rows = listed(None, None) if len(levels) == 1 else listed(0, None).unionByName(listed(None, 1).withColumn("block_", -1 - F.col("block_")))
    parts = max(int(a.sparkSession.conf.get("spark.sql.shuffle.partitions")), math.ceil(rows.count() / PART))
    keys = [*cells, "block_"]
    return rows.repartition(parts, *keys).sortWithinPartitions(*keys, "side_", order), keys


def mates(batches: Iterator[pa.RecordBatch], keys: Sequence[str]) -> Iterator[tuple[pa.Table, pa.RecordBatch]]:
    """(boxes of b, boxes of a) that meet in a cell, from rows of ``cell_mates``; those of a in parts."""
    last, held, whole = None, [], None
    for batch in batches:
        if not batch.num_rows:
            continue
        n = batch.num_rows
        differs = lambda c: pc.not_equal(batch.column(c).slice(1), batch.column(c).slice(0, n - 1)).to_numpy(zero_copy_only=False)  # noqa: B023, E731
        fresh = reduce(np.logical_or, [differs(c) for c in keys])
        cuts = [0, *(np.flatnonzero(fresh | differs("side_")) + 1).tolist(), n]
        side = batch.column("side_").to_numpy()
        if [batch.column(c)[0] for c in keys] != last:
            held, whole = [], None
        for begins, ends in zip(cuts[:-1], cuts[1:], strict=True):
            if begins and fresh[begins - 1]:
                held, whole = [], None
            part = batch.slice(begins, ends - begins)
            if side[begins] == 0:
                held.append(part)
            elif held:
                whole = whole or pa.Table.from_batches(held)
                yield whole, part
        last = [batch.column(c)[n - 1] for c in keys]


def some_partner(rows: DataFrame, row: str, partners: DataFrame, columns: Sequence[str], cells: Sequence[Sequence[Column]], near: Callable[[DataFrame, DataFrame], DataFrame], fits: Callable[[Callable[[str], Column]], Column], may: Callable[[Callable[[str], Column], Callable[[str], Column]], Column], first: Column, by: Sequence[str] = ()) -> DataFrame:
    """(row) of rows for which some partner fits, without a look at most pairs in dense tables.

    Equal partners are one. They are grouped under cells, coarse to fine (``cells``: the
    columns of each step), each group with the bounds of its ``columns`` (``low_``,
    ``high_``) and one member (``one_``, that of the largest ``first``). ``near`` joins rows
    with the coarsest groups. A row whose test of the member (``fits(column)``) holds is
    done and leaves; a group that its bounds exclude (``may(low, high)``, true wherever
    ``fits`` is for some value between them) goes; what is left meets the groups of the next
    step, at last each partner. So rows with many partners cost what the coarse groups
    cost, and only rows close to the rule's limit meet single partners.
    """
    tree = partners.select(*by, *columns).distinct()
    for k, cell_ in enumerate(cells):
        tree = tree.withColumn(f"node{k}_", F.xxhash64(*([f"node{k - 1}_"] if k else by), *cell_))
    tree = written(tree.withColumn("first_", first), "partners")
    found, open_, last = [], None, len(cells)
    for k in range(last + 1):
        if k < last:
            bounds = [f(c).alias(f"{name}_{c}") for c in columns for name, f in (("low", F.min), ("high", F.max))]
            group = [*by, *([f"node{k - 1}_"] if k else []), f"node{k}_"]
            nodes = tree.groupBy(*group).agg(*bounds, F.max(F.struct("first_", *columns)).alias("o_")).select("*", *[F.col(f"o_.{c}").alias(f"one_{c}") for c in columns]).drop("o_")
        else:
            nodes = tree.select(*by, f"node{k - 1}_", *[F.col(c).alias(f"{name}_{c}") for c in columns for name in ("low", "high", "one")])
        met = near(rows, nodes) if k == 0 else spread(open_).join(spread(nodes), [*by, f"node{k - 1}_"])
        met = met.filter(may(lambda c: F.col(f"low_{c}"), lambda c: F.col(f"high_{c}"))).withColumn("fits_", fits(lambda c: F.col(f"one_{c}")))
        met = written(met.select(*rows.columns, *([f"node{k}_"] if k < last else []), "fits_"), "partner-groups")
        done = written(met.filter("fits_").select(row).distinct(), "partnered")
        found.append(done)
        open_ = written(met.drop("fits_").join(done, row, "left_anti"), "partner-open")
        if k == last or open_.isEmpty():
            return reduce(DataFrame.unionByName, found)


def occupants(boxes: DataFrame, points: DataFrame, box: str, own: str, axes: Mapping[str, tuple[str, str]], sizes: Sequence[float], least: int = 5) -> DataFrame:
    """(box, occupants): points of others inside each box, of boxes with enough of them."""
    return containment_join(boxes, points, axes, sizes).filter(F.col(box) != F.col(own)).groupBy(box).agg(F.count("*").alias("occupants")).filter(F.col("occupants") >= least)


def smallest_container(boxes: DataFrame, points: DataFrame, point: str, box: str, volume: Column, axes: Mapping[str, tuple[str, str]], sizes: Sequence[float]) -> DataFrame:
    """(point, box): the box of the smallest volume that holds a point, on ties the smaller id.

    Boxes are numbered in that order, so the smallest number of a point's boxes is
    kept by hash, and no task sorts what its points meet.
    """
    placed = written(ranked(boxes.withColumn("volume_", volume), ["volume_", box]).withColumn("rank", F.col("rank").cast("long")), "containers")
    met = containment_join(placed.drop(box, "volume_", "n"), points, axes, sizes)
    best = met.groupBy(point).agg(F.min("rank").alias("rank"))
    return best.join(placed.select("rank", box), "rank").select(point, box)


def overlap_share(a: Sequence[Column], b: Sequence[Column]) -> Column:
    """Share of box a (low and high of each axis in turn) that box b covers."""
    covered, whole = F.lit(1.0), F.lit(1.0)
    for k in range(0, len(a), 2):
        covered = covered * F.greatest(F.least(a[k + 1], b[k + 1]) - F.greatest(a[k], b[k]), F.lit(0.0))
        whole = whole * (a[k + 1] - a[k])
    return F.when(whole > 0, covered / whole).otherwise(0.0)


def neighbour_offsets(axes: int) -> list[tuple[int, ...]]:
    out: list[tuple[int, ...]] = [()]
    for _ in range(axes):
        out = [(*o, d) for o in out for d in (-1, 0, 1)]
    return out


def voxel_diff(cells: DataFrame, side: str, axes: Sequence[str]) -> DataFrame:
    """(side, cells, only_here): distinct cells of each side, and those without a cell of another side among themselves and their neighbours."""
    own = cells.select(side, *axes).distinct()
    offsets = F.array(*[F.struct(*[F.lit(v).alias(a) for a, v in zip(axes, o, strict=True)]) for o in neighbour_offsets(len(axes))])
    wide = own.select(F.col(side).alias("other_"), *axes, F.explode(offsets).alias("o_")).select("other_", *[(F.col(a) + F.col(f"o_.{a}")).cast("int").alias(a) for a in axes])
    met = wide.groupBy(*axes).agg(F.min("other_").alias("low_"), F.max("other_").alias("high_"))
    joined = own.join(met, list(axes), "left")
    other = F.coalesce((F.col("low_") != F.col(side)) | (F.col("high_") != F.col(side)), F.lit(False))
    return joined.groupBy(side).agg(F.count("*").alias("cells"), F.count_if(~other).alias("only_here"))


def components(cells: DataFrame, axes: Sequence[str], corners: bool = True) -> DataFrame:
    """Cells with ``component``: the smallest cell (as a struct) that is reached over neighbours.

    Labels spread to neighbours and jump to their label's own label until
    nothing changes; each round is written, so its lineage is cut.
    """
    me = F.struct(*axes)
    state = written(cells.select(*axes).distinct().withColumn("component", me), "cells")
    offsets = [o for o in neighbour_offsets(len(axes)) if corners or sum(map(abs, o)) <= 1]
    moves = F.array(*[F.struct(*[F.lit(v).alias(a) for a, v in zip(axes, o, strict=True)]) for o in offsets])
    while True:
        spread = state.select("component", F.explode(moves).alias("o_"), *axes).select(*[(F.col(a) + F.col(f"o_.{a}")).cast(dict(state.dtypes)[a]).alias(a) for a in axes], "component")
        low = spread.groupBy(*axes).agg(F.min("component").alias("low_"))
        step = state.join(low, list(axes)).select(*axes, F.col("component").alias("was_"), F.least("component", "low_").alias("low_"))
        jump = state.select(me.alias("low_"), F.col("component").alias("jump_"))
        step = written(step.join(jump, "low_").select(*axes, "was_", F.least("low_", "jump_").alias("component")), "cells")
        state = step.drop("was_")
        if step.filter(F.col("was_") != F.col("component")).limit(1).count() == 0:
            return state


def dense_component(rows: DataFrame, axes: Mapping[str, Column], share: float = 0.002, floor: int = 4) -> DataFrame:
    """Cells of the component that holds the densest cell; cells need at least max(floor, floor of share of the densest) rows."""
    names = list(axes)
    counted = written(rows.groupBy(*[c.cast("int").alias(a) for a, c in axes.items()]).agg(F.count("*").alias("n")), "counts")
    first = counted.orderBy(F.desc("n"), *names).first()
    if first is None:
        return counted.select(*names)
    dense = counted.filter(F.col("n") >= max(floor, int(first["n"] * share)))
    if first["n"] < max(floor, int(first["n"] * share)):
        return counted.filter(F.lit(False)).select(*names)
    found = components(dense, names)
    seed = found.filter(" and ".join(f"{a} = {first[a]}" for a in names)).select("component")
    return found.join(seed, "component", "left_semi").select(*names)


def focused(rows: DataFrame, axes: Mapping[str, Column], least: int = 250, enough: int = 100, share: float = 0.1) -> DataFrame:
    """Rows in the dense component that holds the densest cell; all rows if there are fewer than ``least``, or if fewer than ``enough`` and than that share of them would be left."""
    n = rows.count()
    if n < least:
        return rows
    cells = dense_component(rows, axes)
    kept = written(rows.withColumns({f"{a}_at_": c.cast("int") for a, c in axes.items()}).join(cells.select(*[F.col(a).alias(f"{a}_at_") for a in axes]), [f"{a}_at_" for a in axes], "left_semi").select(*rows.columns), "focused")
    return kept if kept.count() >= min(enough, n * share) else rows


def undirected_segments(rows: DataFrame, ordinal: str, grid: float = 0.05) -> DataFrame:
    """The first of the segments (x0, y0, x1, y1) whose ends fall on the same two grid points, in either direction."""
    end = lambda k: F.struct(*[F.floor(F.col(f"{a}{k}") / grid + 0.5).alias(a) for a in "xy"])
    rest = [c for c in rows.columns if c != ordinal]
    packed = rows.select(F.least(end(0), end(1)).alias("a_"), F.greatest(end(0), end(1)).alias("b_"), F.struct(ordinal, *rest).alias("row_"))
    return packed.groupBy("a_", "b_").agg(F.min("row_").alias("row_")).select("row_.*").select(*rows.columns)


def undirected_pairs(rows: DataFrame, a: str, b: str, ordinal: str) -> DataFrame:
    """(a, b, first_seen) of distinct undirected pairs."""
    return rows.groupBy(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).agg(F.min(ordinal).alias("first_seen"))


def nearest_segment(points: DataFrame, segments: DataFrame, point: str, segment: str, reach: float) -> DataFrame:
    """(point, segment, distance): the nearest segment (x0, y0, x1, y1) within ``reach`` of a point (x, y); ties to the smaller id.

    Points on one place are one. They look for segments within a reach that starts at
    what holds about one of them and doubles up to ``reach``; a point that has found one leaves.
    """
    dx, dy = F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")
    length = dx * dx + dy * dy
    t = F.when(length > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((F.col("x") - F.col("x0")) * dx + (F.col("y") - F.col("y0")) * dy) / length))).otherwise(0.0)
    gap = F.hypot(F.col("x") - F.col("x0") - t * dx, F.col("y") - F.col("y0") - t * dy)
    n, *ends = segments.agg(F.count("*"), *[f(f"{a}0") for a in "xy" for f in (F.min, F.max)]).first()
    sides = [float(b) - float(a) for a, b in zip(ends[::2], ends[1::2], strict=True)] if n and None not in ends else [0.0]
    one = math.sqrt(math.prod(sides) / n) if n and all(math.isfinite(x) and x > 0 for x in sides) else reach
    halvings = max(0, min(20, math.floor(math.log2(reach / one)))) if reach > 0 < one else 0
    left, found = written(points.select("x", "y").distinct(), "places"), []
    for k in range(halvings, -1, -1):
        within = reach / 2**k
        wide = within * (1 + 1e-9) if k else within  # rounding must not hide a segment that a later round would see
        s = segments.withColumns({f"{a}_{side}_": f(f"{a}0", f"{a}1") + shift for a in "xy" for side, f, shift in (("low", F.least, -wide), ("high", F.greatest, wide))})
        met = containment_join(s, left, {"x": ("x_low_", "x_high_"), "y": ("y_low_", "y_high_")}, [2 * within] * 2).withColumn("distance", gap).filter(F.col("distance") <= within)
        found.append(written(met.groupBy("x", "y").agg(F.min(F.struct("distance", segment)).alias("b_")), "nearest"))
        if k:
            left = written(left.join(found[-1], ["x", "y"], "left_anti"), "places")
            if left.isEmpty():
                break
    best = points.join(reduce(DataFrame.unionByName, found), ["x", "y"]).groupBy(point).agg(F.min("b_").alias("b_"))
    return best.select(point, F.col(f"b_.{segment}").alias(segment), F.col("b_.distance").alias("distance"))
