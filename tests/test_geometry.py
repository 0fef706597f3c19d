"""Rings, nesting and joins on grid levels against brute force on small inputs."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from girder.operators import hulls, keyed, plates, polylines, rings, spatial, triangles

SEGMENTS = "owner long, segment long, x0 double, y0 double, z0 double, x1 double, y1 double, z1 double"


def walk(segments):
    """Rings of one owner's segments by walking from end to end: lists of (segment, reversed)."""
    left = {s: (a, b) for s, a, b in segments}
    out = []
    while left:
        first = min(left)
        start, at = left.pop(first)
        chain = [(first, False)]
        while at != start:
            step = next(((s, ends[1] == at) for s, ends in sorted(left.items()) if at in ends), None)
            if step is None:
                break
            ends = left.pop(step[0])
            at = ends[0] if step[1] else ends[1]
            chain.append(step)
        if at == start and len(chain) > 2:
            out.append(chain)
    return out


def assemble(spark, rows):
    closed, open_ = rings.assembled(spark.createDataFrame(rows, SEGMENTS), "owner", "segment")
    found = {}
    for r in closed.orderBy("owner", "ring", "place").collect():
        found.setdefault((r["owner"], r["ring"]), []).append((r["segment"], r["reversed"]))
    return closed, found, sorted(tuple(r) for r in open_.collect())


def test_rings_equal_a_walk(spark):
    r = random.Random(5)
    rows, wanted, lost = [], {}, []
    for owner in range(30):
        number, mine = 0, []
        for ring in range(r.randrange(1, 4)):
            n = r.choice([2, 3, 4, 9, 40])
            points = [(ring * 1000.0 + k, float(r.randrange(0, 500)), 0.0) for k in range(n)]
            sides = [(points[k], points[(k + 1) % n]) for k in range(n)]
            if r.random() < 0.3:
                sides.pop()
            r.shuffle(sides)
            for a, b in sides:
                a, b = (a, b) if r.random() < 0.5 else (b, a)
                if (owner, frozenset((a, b))) not in {(owner, frozenset((p, q))) for _, p, q in mine}:
                    mine.append((number, a, b))
                rows.append((owner, number, *a, *b))
                number += 1
        chains = walk(mine)
        wanted |= {(owner, c[0][0]): c for c in chains}
        lost += [(owner, s) for s, _, _ in mine if not any(s == t for c in chains for t, _ in c)]
    r.shuffle(rows)
    closed, found, open_ = assemble(spark, rows)
    assert found == wanted and open_ == sorted(lost)
    sizes = {}
    for row in closed.select("owner", "ring_no", "area").distinct().collect():
        sizes.setdefault(row["owner"], []).append((row["ring_no"], -row["area"]))
    assert all(sorted(v) == [(k + 1, a) for k, a in enumerate(sorted(a for _, a in v))] for v in sizes.values())


def test_a_long_ring_in_any_order(spark):
    n = 100_000
    ids = spark.range(n).withColumn("segment", F.pmod(F.col("id") * 7919 + 13, F.lit(n)))  # a shuffled numbering
    at = lambda k: [F.cos(k * (6.283185307179586 / n)) * 1e5, F.sin(k * (6.283185307179586 / n)) * 1e5, F.lit(0.0)]
    a, b = at(F.col("id")), at((F.col("id") + 1) % n)
    flip = F.col("id") % 3 == 0
    ends = [F.when(flip, q).otherwise(p).alias(f"{c}0") for c, p, q in zip("xyz", a, b, strict=True)] + [F.when(flip, p).otherwise(q).alias(f"{c}1") for c, p, q in zip("xyz", a, b, strict=True)]
    closed, open_ = rings.assembled(ids.select(F.lit(1).alias("owner"), "segment", *ends), "owner", "segment")
    assert open_.count() == 0
    start = next(i for i in range(n) if (i * 7919 + 13) % n == 0)
    way = -1 if start % 3 == 0 else 1
    order = [r["segment"] for r in closed.orderBy("place").select("segment").collect()]
    assert order == [((start + way * k) % n * 7919 + 13) % n for k in range(n)]


def test_ring_cases(spark):
    side = lambda s, a, b: (1, s, *a, *b)
    p, q, t, u = (0.0, 0.0, 0.0), (1.0, 0.0, 0.0), (1.0, 1.0, 0.0), (5.0, 5.0, 0.0)
    near = (1.0 + 4e-5, 1.0, 0.0)
    rows = [side(5, p, q), side(6, near, q), side(7, t, p), side(8, t, u), side(9, u, (5.0, 5.0, 1e-5)), (1, 10, None, 0.0, 0.0, 1.0, 1.0, 1.0), side(11, q, p)]
    _, found, open_ = assemble(spark, rows)
    assert found == {(1, 5): [(5, False), (6, True), (7, False)]} and open_ == [(1, 8)]  # three sides meet at t: 6 goes on with 7, 8 is left
    closed, _ = rings.assembled(spark.createDataFrame([], SEGMENTS), "owner", "segment")
    assert closed.count() == 0


def test_nesting(spark):
    square = lambda ring, x, y, h: [(1, ring, k, x + h * sx, y + h * sy) for k, (sx, sy) in enumerate([(-1, -1), (1, -1), (1, 1), (-1, 1)])]
    rows = square(1, 0.0, 0.0, 50.0) + square(2, 0.0, 0.0, 40.0) + square(3, 10.0, 10.0, 20.0) + square(4, 12.0, 12.0, 5.0) + square(5, 200.0, 0.0, 10.0) + square(6, 60.0, 0.0, 10.0)
    rows += [(1, 7, 0, 0.0, 0.0), (1, 7, 1, 1.0, 1.0)]  # two corners are no ring
    rows += [(2, 1, k, x, y) for k, (x, y) in enumerate([(0.0, 0.0), (4.0, 0.0), (4.0, 4.0), (0.0, 4.0)])] + [(2, 2, k, x, y) for k, (x, y) in enumerate([(0.0, 0.0), (2.0, 1.0), (2.0, 2.0), (1.0, 2.0)])]  # share a corner
    found = sorted(tuple(r) for r in rings.nested(spark.createDataFrame(rows, "owner long, ring long, place long, x double, y double"), "owner", "ring", "place").collect())
    assert found == [(1, 1, 0, None), (1, 2, 1, 1), (1, 3, 2, None), (1, 4, 3, 3), (1, 5, 0, None), (1, 6, 0, None), (2, 1, 0, None), (2, 2, 1, 1)]


@pytest.mark.parametrize("seed", [1, 2])
def test_box_pairs_and_containment(spark, seed):
    r = random.Random(seed)
    box = lambda k: (k, (x := r.uniform(-50, 50)), x + r.choice([0.0, 0.5, 4.0, 30.0, 1e6]), (y := r.uniform(-50, 50)), y + r.choice([0.0, 1.0, 8.0, 3e4]))
    a, b = [box(k) for k in range(80)], [box(k) for k in range(80)]
    a += [(90, 0.0, 4.0, 0.0, 4.0), (91, None, 1.0, 0.0, 1.0), (92, 5.0, 4.0, 0.0, 1.0)]
    b += [(90, 4.0, 8.0, 4.0, 8.0)]
    da, db = spark.createDataFrame(a, "i long, ax0 double, ax1 double, ay0 double, ay1 double"), spark.createDataFrame(b, "j long, bx0 double, bx1 double, by0 double, by1 double")
    got = sorted((x["i"], x["j"]) for x in spatial.box_pairs(da, db, [("ax0", "ax1"), ("ay0", "ay1")], [("bx0", "bx1"), ("by0", "by1")]).select("i", "j").collect())
    ok = lambda p, q: None not in p and p[1] <= p[2] and max(p[1], q[1]) <= min(p[2], q[2]) and max(p[3], q[3]) <= min(p[4], q[4])
    assert got == sorted((p[0], q[0]) for p in a for q in b if ok(p, q))
    points = [(k, r.uniform(-60, 60), r.uniform(-60, 60)) for k in range(200)]
    dp = spark.createDataFrame(points, "k long, x double, y double")
    held = sorted((x["i"], x["k"]) for x in spatial.containment_join(da, dp, {"x": ("ax0", "ax1"), "y": ("ay0", "ay1")}, [4.0, 4.0]).select("i", "k").collect())
    assert held == sorted((p[0], k) for p in a if None not in p for k, x, y in points if p[1] <= x <= p[2] and p[3] <= y <= p[4])


def test_one_huge_box_costs_few_rows(spark):
    huge = spark.createDataFrame([(1, 0.0, 1e7, 0.0, 1e7)], "i long, x0 double, x1 double, y0 double, y1 double")
    points = spark.range(1000).selectExpr("id * 1.0 AS x", "id * 2.0 AS y")
    assert spatial._celled(huge.withColumn("level_", spatial._level([("x0", "x1"), ("y0", "y1")], [4.0, 4.0])), [("x0", "x1"), ("y0", "y1")], [4.0, 4.0]).count() <= 4
    assert spatial.containment_join(huge, points, {"x": ("x0", "x1"), "y": ("y0", "y1")}, [4.0, 4.0]).count() == 1000


def test_meet_and_running_sums(spark):
    rows = spark.range(3000).select(F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 700).cast("long").alias("g"), F.col("id").alias("rank"), (F.col("id") % 7).alias("v"))
    few = rows.groupBy("g").agg(F.count("*").alias("c"))
    assert keyed.meet(rows, few, ["g"], "c").count() == 3000
    got = {(r["g"], r["rank"]): r["s"] for r in keyed.running_sums(rows, ["g"], "rank", "v", "s", 16).collect()}
    sums = {}
    for r in rows.orderBy("rank").collect():
        sums[r["g"]] = sums.get(r["g"], 0) + r["v"]
        assert got[(r["g"], r["rank"])] == sums[r["g"]]


def brute_hull(points):
    points = sorted(set(points))
    out = []
    for p in points:
        for q in points:
            if p == q:
                continue
            side = [(q[0] - p[0]) * (r[1] - p[1]) - (q[1] - p[1]) * (r[0] - p[0]) for r in points]
            on = [r for r, s in zip(points, side, strict=True) if s == 0]
            if min(side) >= 0 and all(min(p[0], q[0]) <= r[0] <= max(p[0], q[0]) and min(p[1], q[1]) <= r[1] <= max(p[1], q[1]) for r in on):
                out += [p, q]
    return set(out) if out else set(points)


def test_hulls(spark, monkeypatch):
    r = random.Random(2)
    rows = [(k, float(r.randrange(0, 30)), float(r.randrange(0, 30))) for k in range(20) for _ in range(r.choice([1, 2, 3, 8, 40]))]
    rows += [(50, float(k), 2.0 * k) for k in range(9)] + [(51, 1.0, 1.0)] * 5 + [(None, 1.0, 2.0), (52, None, 1.0), (52, float("nan"), 1.0), (52, float("inf"), 1.0)]
    found = {x["k"]: x for x in hulls.convex_hulls(spark.createDataFrame(rows, "k long, x double, y double").repartition(7), "k", "x", "y").collect()}
    groups = {}
    for k, x, y in rows[:-4]:
        groups.setdefault(k, []).append((x, y))
    assert set(found) == set(groups)
    for k, points in groups.items():
        assert {(p["x"], p["y"]) for p in found[k]["hull"]} == brute_hull(points), k
        assert found[k]["n"] == len(points)
        ring = hulls.hull(np.array(points))
        best = min((width(ring, math.atan2(*(ring[(i + 1) % len(ring)] - ring[i])[::-1])) for i in range(len(ring))), default=0) if len(ring) > 2 else 0
        assert found[k]["rectangle_area"] == pytest.approx(best)
    turned = [(x * 0.6 - y * 0.8, x * 0.8 + y * 0.6) for x, y in ((0, 0), (7, 0), (7, 3), (0, 3), (2, 1))]
    one = hulls.convex_hulls(spark.createDataFrame([(1, *p) for p in turned], "k long, x double, y double"), "k", "x", "y").first()
    assert one["rectangle_fill"] == pytest.approx(1) and one["rectangle_area"] == pytest.approx(21)


def width(ring, angle):
    u, v = (ring @ np.array(a) for a in ((math.cos(angle), math.sin(angle)), (-math.sin(angle), math.cos(angle))))
    return (u.max() - u.min()) * (v.max() - v.min())


def test_a_hot_group_is_reduced_in_the_tasks(spark):
    points = spark.range(300_000).select(F.lit(1).alias("k"), (F.pmod(F.xxhash64("id"), F.lit(1000)) / 10).alias("x"), (F.pmod(F.xxhash64("id", F.lit(1)), F.lit(1000)) / 10).alias("y"))
    found = hulls.convex_hulls(points, "k", "x", "y").first()
    listed = np.array([tuple(p) for p in points.select("x", "y").collect()])
    assert found["n"] == 300_000 and {tuple(p) for p in found["hull"]} == {tuple(p) for p in hulls.hull(listed).tolist()}
    edges = np.roll(hulls.hull(listed), -1, axis=0) - hulls.hull(listed)
    for p, e in zip(hulls.hull(listed), edges, strict=True):
        assert (e[0] * (listed[:, 1] - p[1]) - e[1] * (listed[:, 0] - p[0]) >= -1e-9).all()


def clip(line, low, high):
    """Runs of one line by going along it."""
    runs, cut = [], False
    for a, b in zip(line, line[1:], strict=False):
        rise = b[2] - a[2]
        t0, t1 = (0.0, 1.0) if abs(rise) < 1e-12 else (max(0.0, min((low - a[2]) / rise, (high - a[2]) / rise)), min(1.0, max((low - a[2]) / rise, (high - a[2]) / rise)))
        if t0 > t1 or abs(rise) < 1e-12 and not low <= a[2] <= high:
            cut = True
            runs.append(None)
            continue
        cut |= t0 != 0 or t1 != 1
        p, q = (a if t0 == 0 else tuple(x + (y - x) * t0 for x, y in zip(a, b, strict=True))), (b if t1 == 1 else tuple(x + (y - x) * t1 for x, y in zip(a, b, strict=True)))
        if runs and runs[-1] and runs[-1][-1] == p:
            runs[-1].append(q)
        else:
            runs.append([p, q])
    return [x for x in runs if x], cut


def test_lines_are_clipped(spark):
    r = random.Random(4)
    lines = {(e, k): [(float(i), float(r.randrange(9)), float(r.randrange(-6, 7))) for i in range(r.choice([1, 2, 3, 12]))] for e in range(25) for k in range(r.choice([1, 2]))}
    lines[(30, 0)] = [(0.0, 0.0, 3.0), (1.0, 0.0, 3.0), (2.0, 0.0, 9.0), (3.0, 0.0, 3.0)]  # along the edge and back to it
    lines[(31, 0)] = [(0.0, 0.0, -3.0), (0.0, 0.0, 8.0)]  # upright
    lines[(32, 0)] = [(0.0, 0.0, 50.0), (1.0, 0.0, 60.0)]  # nothing inside
    rows = [(e, k, i * 5, *p) for (e, k), line in lines.items() for i, p in enumerate(line)] + [(31, 0, 1, None, 0.0, 0.0)]
    r.shuffle(rows)
    bands = spark.createDataFrame([(e, -2.0, 3.0) for e in {k[0] for k in lines}], "element long, z0 double, z1 double")
    out = polylines.clipped_to_band(spark.createDataFrame(rows, "element long, line long, place long, x double, y double, z double"), bands, "element", "line", "place").collect()
    for e in {k[0] for k in lines}:
        mine = {k: clip(line, -2.0, 3.0) for k, line in lines.items() if k[0] == e and len(line) > 1}
        whole = mine and not any(runs for runs, _ in mine.values())
        for k in mine:
            got = {}
            for x in sorted((x for x in out if (x["element"], x["line"]) == k), key=lambda x: (x["run"], x["at"])):
                got.setdefault(x["run"], []).append((x["x"], x["y"], x["z"]))
                assert x["clipped"] == any(c for _, c in mine.values())
            assert list(got.values()) == ([lines[k]] if whole else mine[k][0]), k


def test_duplicate_triangles(spark):
    base = (0.0, 0.0, 0.0, 2.0, 0.0, 0.0, 0.0, 2.0, 0.0)
    turned = (0.0, 2.0, 0.0, 0.0, 0.0, 1e-9, 2.0, 0.0, 0.0)
    big = (0.0, 0.0, 5.0, 9.0, 0.0, 5.0, 0.0, 9.0, 5.0)
    rows = [(1, 1, 7, *base), (1, 2, 8, *turned), (1, 3, 7, *big), (2, 4, 7, *base), (2, 5, 8, *turned), (3, 6, None, *base), (3, 7, None, *turned), (3, 8, 1, *base), (None, 9, 1, *base), (None, 10, 1, *base), (4, 11, 1, *base), (5, 12, 2, *base), (5, 13, 3, *base)]
    df = spark.createDataFrame(rows, "element long, ordinal long, material long, " + ", ".join(f"{a}{k} double" for k in range(3) for a in "xyz"))
    liked = spark.createDataFrame([(5, 2), (5, 2)], "element long, material long")
    found = sorted(tuple(r) for r in triangles.duplicates(df, liked, "element", "ordinal", "material").collect())
    # 1: 7 covers more; 2: equal areas, so the larger id; 3: none covers twice as much as 1; 5: preferred
    assert found == [(1, 1, True, False), (1, 2, False, True), (2, 4, False, True), (2, 5, True, False), (3, 6, True, False), (3, 7, False, False), (3, 8, False, True), (5, 12, True, False), (5, 13, False, True)]
    left = triangles.without_duplicates(df, liked, "element", "ordinal", "material")
    assert sorted(r["ordinal"] for r in left.collect()) == [1, 3, 5, 6, 9, 10, 11, 12] and left.columns == df.columns


RINGS = "model long, level long, polygon long, ring long, place long, x double, y double"


def test_covered_areas_equal_counted_cells(spark):
    r = random.Random(8)
    rows, cells = [], {}
    for level in range(12):
        cells[level] = set()
        for polygon in range(r.randrange(1, 4)):
            x, y, w, h = r.randrange(12), r.randrange(12), r.randrange(3, 9), r.randrange(3, 9)
            rows += [(1, level, polygon, 0, k, float(a), float(b)) for k, (a, b) in enumerate([(x, y), (x + w, y), (x + w, y + h), (x, y + h)])]
            inside = {(a, b) for a in range(x, x + w) for b in range(y, y + h)}
            if polygon != 1:  # a hole
                rows += [(1, level, polygon, 1, k, float(a), float(b)) for k, (a, b) in enumerate([(x + 1, y + 1), (x + 1, y + 2), (x + 2, y + 2), (x + 2, y + 1)])]
                inside -= {(x + 1, y + 1)}
            cells[level] |= inside
    edges = plates.sides(spark.createDataFrame(rows, RINGS), ["model", "level", "polygon"])
    found = {x["level"]: x["covered"] for x in plates.covered_area(edges.withColumn("layer", F.lit(0)), ["model", "level"], 1).collect()}
    assert found == {k: pytest.approx(len(v)) for k, v in cells.items()}
    pair = [(a, b) for a in range(12) for b in range(a)]
    named = spark.createDataFrame([(a * 100 + b, n, k) for a, b in pair for n, k in ((0, a), (1, b))], "pair long, layer int, level long").join(edges, "level")
    shared = {x["pair"]: x["covered"] for x in plates.covered_area(named, ["pair"], 2).collect()}
    assert shared == {a * 100 + b: pytest.approx(len(cells[a] & cells[b])) for a, b in pair if cells[a] & cells[b]}
    slanted = [(1, k, 0, 0, p, x, y) for k, ring in enumerate([[(0.0, 0.0), (4.0, 0.0), (0.0, 4.0)], [(4.0, 4.0), (0.0, 4.0), (4.0, 0.0)], [(1.0, -1.0), (3.0, -1.0), (3.0, 5.0), (1.0, 5.0)]]) for p, (x, y) in enumerate(ring)]
    edges = plates.sides(spark.createDataFrame(slanted, RINGS), ["level", "polygon"]).withColumn("layer", F.when(F.col("level") == 2, 1).otherwise(0)).withColumn("pair", F.lit(1)).drop("polygon").withColumnRenamed("level", "polygon")
    assert plates.covered_area(edges, ["pair"], 2).first()["covered"] == pytest.approx(8)
    assert plates.covered_area(edges.filter("polygon != 1"), ["pair"], 2).first()["covered"] == pytest.approx(4)


def test_storeys_equal_a_union_find(spark):
    square = lambda level, x: [(1, level, 0, 0, k, x + a, b) for k, (a, b) in enumerate([(0.0, 0.0), (9.0, 0.0), (9.0, 9.0 + level), (0.0, 9.0 + level)])]
    rises = [(1, 0.0), (2, 4.0), (3, 8.0), (4, 9.0), (5, 30.0), (6, 31.0), (7, 31.0)]
    levels = spark.createDataFrame([(1, k, z) for k, z in rises], "model long, level long, elevation double")
    rings_ = [c for k, x in ((1, 0.0), (2, 10.0), (3, 20.0), (4, 30.0), (5, 0.0), (6, 1.0), (7, 50.0)) for c in square(k, x)]
    joined, found = plates.connections(levels, spark.createDataFrame(rings_, RINGS))
    assert sorted((r["lower"], r["upper"], r["gap"]) for r in joined.collect()) == [(1, 2, 1.0), (2, 3, 1.0), (3, 4, 1.0)]
    got = sorted((r["level"], r["group_level"], r["primary_level"]) for r in plates.storeys(found, joined).collect())
    assert got == [(1, 1, 2), (2, 1, 2), (3, 3, 4), (4, 3, 4), (5, 5, 5), (6, 6, 6), (7, 7, 7)]  # 1 to 3 rise by 8 in all
