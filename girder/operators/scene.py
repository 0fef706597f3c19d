"""What a scene shows: boxes (x0, x1, y0, y1, z0, z1) that repeat, enclose, escape or pile up.

Boxes are met on grid cells (equi-joins). Facts about the whole scene (extent,
counts, the largest footprints) are one row each.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from girder.operators.spatial import box_pairs, cell, overlap_share, some_partner, spread
from girder.sources.shared import written

AXES = ("x", "y", "z")
#: Steps in which covers are told apart: cells of a cover's own size, of half of it and so on.
COVER_STEPS = 5


def spans() -> list[Column]:
    return [F.col(f"{a}1") - F.col(f"{a}0") for a in AXES]


def solid(least: float = 0.01) -> Column:
    """Whether a box has a volume: all three spans above ``least``."""
    dx, dy, dz = spans()
    return (dx > least) & (dy > least) & (dz > least)


def covered_boxes(boxes: DataFrame, covers: DataFrame, key: str, size: float, share: float = 0.95) -> DataFrame:
    """(key) of boxes of some volume of which a cover holds at least that share (above 0) of the volume.

    Equal boxes are one. Covers are grouped by their spans' powers of two and by their
    corners on cells of these, halved from step to step (``some_partner``); boxes and the
    coarsest groups meet on levels of plan cells (``box_pairs``), the finest of ``size``.
    """
    columns = [f"{a}{k}" for a in AXES for k in (0, 1)]
    whole = lambda df: df.filter("x0 <= x1 and y0 <= y1 and z0 <= z1")
    dx, dy, dz = spans()
    kept = written(whole(boxes.filter(dx * dy * dz > 0)).select(key, *columns), "boxes")
    rows = written(kept.select(*columns).distinct().withColumn("row_", F.monotonically_increasing_id()), "box-kinds")
    power = lambda a: F.greatest(F.lit(-1000), F.least(F.lit(1000), F.ceil(F.log2(F.col(f"{a}1") - F.col(f"{a}0"))))).cast("int")
    corner = lambda a, k, step: F.floor(F.col(f"{a}{k}") / F.pow(F.lit(2.0), power(a) - step))
    cells = [[c for a in AXES for c in (power(a), corner(a, 0, step), corner(a, 1, step))] for step in range(COVER_STEPS)]
    sides = lambda of: [of(c) for c in columns]
    own = [F.col(c) for c in columns]
    fits = lambda one: overlap_share(own, sides(one)) >= share
    may = lambda low, high: overlap_share(own, [(low if c.endswith("0") else high)(c) for c in columns]) >= share
    plan = [(f"{a}0", f"{a}1") for a in "xy"]
    near = lambda r, groups: box_pairs(r, groups, plan, [(f"low_{a}0", f"high_{a}1") for a in "xy"], (), [size, size])
    solid_ = whole(covers).select(*columns).filter((dx > 0) & (dy > 0) & (dz > 0))
    done = some_partner(rows, "row_", solid_, columns, cells, near, fits, may, dx * dy * dz)
    return kept.join(rows.join(done, "row_", "left_semi"), columns, "left_semi").select(key).distinct()


def same_plan(boxes: DataFrame, others: DataFrame, key: str, by: str, tolerance: float) -> DataFrame:
    """(key) of boxes for which some other (of the same ``by``) has the same plan: all four sides within the tolerance (above 0).

    Equal plans are one; others are grouped on cells of half the tolerance (``some_partner``).
    """
    columns = [f"{a}{k}" for a in "xy" for k in (0, 1)]
    kept = written(boxes.select(key, by, *columns), "plans")
    rows = written(kept.select(by, *columns).distinct().withColumn("row_", F.monotonically_increasing_id()), "plan-kinds")
    good = lambda low, high: reduce(lambda x, y: x & y, [c for n in columns for c in (low(n) - F.col(n) <= tolerance, F.col(n) - high(n) <= tolerance)])

    def near(r: DataFrame, groups: DataFrame) -> DataFrame:
        # a group's low corners lie on one cell of half the tolerance, so on one of the tolerance
        r, groups = spread(r), spread(groups)
        for a in "xy":
            own = cell(F.col(f"{a}0"), tolerance)
            r = r.withColumn(f"cell_{a}", F.explode(F.array(own - 1, own, own + 1)))
            groups = groups.withColumn(f"cell_{a}", cell(F.col(f"low_{a}0"), tolerance))
        return r.join(groups, [by, "cell_x", "cell_y"])

    # cells of the tolerance first, so that a group's bounds lie in one of them
    cells = [[c for n in columns for c in (cell(F.col(n), tolerance), cell(F.col(n), tolerance / 2))]]
    done = some_partner(rows, "row_", others, columns, cells, near, lambda one: good(one, one), good, F.lit(0), [by])
    return kept.join(rows.join(done, "row_", "left_semi"), [by, *columns], "left_semi").select(key).distinct()


def without_dominant(boxes: DataFrame, key: str, side: float = 500.0, times: float = 2.5) -> DataFrame:
    """Boxes without the one of the largest footprint, if its side is above ``side`` and its footprint above ``times`` the next one's; with fewer than two boxes all stay."""
    dx, dy, _ = spans()
    top = boxes.select(F.col(key).alias("k_"), (dx * dy).alias("footprint"), F.greatest(dx, dy).alias("longest")).orderBy(F.desc("footprint"), "k_").limit(2)
    both = top.agg(F.count("*").alias("n"), F.max(F.struct("footprint", "longest", "k_")).alias("first"), F.min("footprint").alias("next"))
    gone = both.filter((F.col("n") == 2) & (F.col("first.longest") > side) & (F.col("first.footprint") > F.col("next") * times)).select(F.col("first.k_").alias(key))
    return boxes.join(F.broadcast(gone), key, "left_anti").select(*boxes.columns)  # one row at most


def datum_pile(boxes: DataFrame, key: str, radius: float, least_boxes: int = 500, least_span: float = 50.0, least_pile: int = 1, *kept: DataFrame, where: Column | None = None) -> DataFrame:
    """(key) of boxes whose plan centre lies within ``radius`` of the datum on both axes.

    Only if there are more than ``least_boxes``, they span more than
    ``least_span`` on a plan axis, and the pile has at least ``least_pile``
    boxes. Ids in ``kept`` and boxes for which ``where`` doesn't hold are no part of it.
    """
    centre = lambda a: F.abs((F.col(f"{a}0") + F.col(f"{a}1")) / 2) <= radius
    pile = boxes.filter(centre("x") & centre("y") & (F.lit(True) if where is None else where))
    for ids in kept:
        pile = pile.join(ids.select(F.col(ids.columns[0]).alias(key)), key, "left_anti")
    spread = boxes.agg(F.count("*").alias("n"), F.greatest(F.max("x1") - F.min("x0"), F.max("y1") - F.min("y0")).alias("span"))
    size = pile.agg(F.count("*").alias("piled"))
    verdict = spread.crossJoin(size).filter((F.col("n") > least_boxes) & (F.col("span") > least_span) & (F.col("piled") >= least_pile))  # one row each
    return pile.select(key).crossJoin(verdict.select("n")).select(key)


def overhangs(boxes: DataFrame, key: str, hulls: DataFrame, slack: float, by: str | None = None) -> DataFrame:
    """(key, overhang) of boxes that reach further than ``slack`` out of their hull on some axis: one hull (a row) for all, or, with ``by``, one for each key."""
    h = hulls.select(*([F.col(by).alias(key)] if by else []), *[F.col(f"{a}{k}").alias(f"h_{a}{k}") for a in AXES for k in (0, 1)])
    joined = boxes.join(h, key) if by else boxes.crossJoin(h)
    out = F.greatest(F.lit(0.0), *[F.col(f"h_{a}0") - F.col(f"{a}0") for a in AXES], *[F.col(f"{a}1") - F.col(f"h_{a}1") for a in AXES])
    return joined.withColumn("overhang", out).filter(F.col("overhang") > slack).select(key, "overhang")


def proxy_replacements(native: DataFrame, proxies: DataFrame, key: str, overfill: float, centre: float, vertical: float) -> DataFrame:
    """(key) of elements whose own box is at least ``overfill`` wider in plan than the proxy's, while centres differ by less than ``centre`` and heights by less than ``vertical``."""
    p = proxies.select(key, *[F.col(f"{a}{k}").alias(f"p_{a}{k}") for a in AXES for k in (0, 1)])
    span = lambda mark, a: F.col(f"{mark}{a}1") - F.col(f"{mark}{a}0")
    apart = lambda a: F.abs((F.col(f"{a}0") + F.col(f"{a}1")) / 2 - (F.col(f"p_{a}0") + F.col(f"p_{a}1")) / 2)
    wide = F.greatest(*[span("", a) - span("p_", a) for a in "xy"])
    good = (wide >= overfill) & (F.greatest(*map(apart, AXES)) < centre) & (F.abs(span("", "z") - span("p_", "z")) < vertical)
    return native.join(p, key).filter(good).select(key)


def drawing_helpers(boxes: DataFrame, key: str, companion: Column, residue: Column) -> DataFrame:
    """(key) of companions whose element of the id below exists, and of flat residue."""
    below = boxes.select((F.col(key) + 1).alias(key))
    flat = F.abs(F.col("z1") - F.col("z0")) <= 1e-6
    companions = boxes.filter(companion).join(below, key, "left_semi").select(key)
    return companions.unionByName(boxes.filter(residue & flat).select(key)).distinct()


def definitions(rows: DataFrame, key: str, category: str, placed: DataFrame, marked: DataFrame) -> DataFrame:
    """(key) of rows without a category and a placement that bear a definition's marker."""
    return rows.filter(F.col(category).isNull()).select(key).join(placed.select(F.col(placed.columns[0]).alias(key)), key, "left_anti").join(marked.select(F.col(marked.columns[0]).alias(key)), key, "left_semi")


def role_map(rows: DataFrame, key: str, role: Column, ordinal: str, dropped: Sequence[str] = ("unknown", "wrapper")) -> DataFrame:
    """(key, role): the last role of each element, of those that aren't dropped."""
    named = rows.select(key, ordinal, role.alias("role")).filter(~F.col("role").isin(*dropped))
    return named.groupBy(key).agg(F.max(F.struct(ordinal, "role")).alias("r_")).select(key, "r_.role")


def completed_thickness(boxes: DataFrame, modes: DataFrame, category: str, synthetic: Column, least: float) -> DataFrame:
    """Boxes of which the flat synthetic ones get their category's modal thickness (modes: category, mode_value) below their upper side."""
    m = modes.select(F.col("category").alias("c_"), F.col("mode_value").alias("thick_"))
    joined = boxes.join(m, F.col(category) == F.col("c_"), "left")
    flat = F.coalesce(synthetic & (F.col("z1") - F.col("z0") <= least) & F.col("thick_").isNotNull(), F.lit(False))
    return joined.withColumn("completed", flat).withColumn("z0", F.when(flat, F.col("z1") - F.col("thick_")).otherwise(F.col("z0"))).select(*boxes.columns, "completed")


def registration(source: DataFrame, reference: DataFrame) -> DataFrame:
    """One row (scale, and the centres sx, sy, sz, rx, ry, rz): the upper median of the ratios of spans of two scenes' extents, axes without a span left out."""
    def extent(df: DataFrame, mark: str) -> DataFrame:
        return df.agg(*[f(f"{a}{k}").alias(f"{mark}{a}{k}") for a in AXES for k, f in ((0, F.min), (1, F.max))])

    both = extent(source, "s_").crossJoin(extent(reference, "r_"))  # one row each
    span = lambda mark, a: F.col(f"{mark}{a}1") - F.col(f"{mark}{a}0")
    ratios = F.array_sort(F.filter(F.array(*[F.when((span("s_", a) > 1e-6) & (span("r_", a) > 1e-6), span("r_", a) / span("s_", a)) for a in AXES]), lambda x: x.isNotNull()))
    centres = [((F.col(f"{m}_{a}0") + F.col(f"{m}_{a}1")) / 2).alias(f"{m}{a}") for m in "sr" for a in AXES]
    return both.select(F.try_element_at(ratios, (F.floor(F.size(ratios) / 2) + 1).cast("int")).alias("scale"), *centres)


def moved(rows: DataFrame, placements: DataFrame, key: str) -> DataFrame:
    """Local boxes joined with the placements (key, a, b, e, f, dz) of their geometry: the plan box of the four turned corners, raised by dz."""
    joined = rows.join(placements, key)
    corner = lambda x, y: (F.col("a") * F.col(x) - F.col("b") * F.col(y) + F.col("e"), F.col("b") * F.col(x) + F.col("a") * F.col(y) + F.col("f"))
    corners = [corner(x, y) for x in ("x0", "x1") for y in ("y0", "y1")]
    new = {"x0": F.least(*[c[0] for c in corners]), "x1": F.greatest(*[c[0] for c in corners]), "y0": F.least(*[c[1] for c in corners]), "y1": F.greatest(*[c[1] for c in corners]), "z0": F.col("z0") + F.col("dz"), "z1": F.col("z1") + F.col("dz")}
    return joined.withColumns(new).drop("a", "b", "e", "f", "dz")


# Entities by category, in lower case, with the predefined type where there is one.
ENTITIES = {
    "walls": ("IFCWALL", None), "floors": ("IFCSLAB", ".FLOOR."), "roofs": ("IFCROOF", None), "ceilings": ("IFCCOVERING", ".CEILING."), "coverings": ("IFCCOVERING", ".CEILING."),
    "doors": ("IFCDOOR", ".DOOR."), "windows": ("IFCWINDOW", ".WINDOW."), "columns": ("IFCCOLUMN", None), "structural columns": ("IFCCOLUMN", None), "beams": ("IFCBEAM", None),
    "members": ("IFCMEMBER", None), "structural framing": ("IFCMEMBER", None), "curtain wall mullions": ("IFCMEMBER", None), "plates": ("IFCPLATE", None), "curtain wall panels": ("IFCPLATE", None),
    "stairs": ("IFCSTAIR", None), "stairs runs": ("IFCSTAIRFLIGHT", None), "railings": ("IFCRAILING", None), "stairs railing": ("IFCRAILING", None), "stairs landings": ("IFCSLAB", ".LANDING."),
    "railing top rail": ("IFCMEMBER", None), "stairs railing baluster": ("IFCMEMBER", None), "stairs stringer carriage": ("IFCMEMBER", None), "furniture": ("IFCFURNITURE", None), "furniture systems": ("IFCFURNITURE", None),
    "foundations": ("IFCFOOTING", None), "structural foundations": ("IFCFOOTING", None), "ramps": ("IFCRAMP", None),
}


def entity_of(category: Column) -> Column:
    """(entity, type_entity, predefined) of a category's name; a proxy for others."""
    entity, kind = F.lit("IFCBUILDINGELEMENTPROXY"), F.lit(".NOTDEFINED.")
    name = F.lower(F.trim(category))
    for key, (e, k) in ENTITIES.items():
        entity = F.when(name == key, e).otherwise(entity)
        kind = F.when(name == key, k).otherwise(kind) if k else kind
    return F.struct(entity.alias("entity"), F.concat(entity, F.lit("TYPE")).alias("type_entity"), kind.alias("predefined"))
