"""Joins on dense tables: as much work as there are groups, and the results of brute force."""

import math
import random
import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from girder.operators import hulls, plates, rings, scene, spatial
from girder.operators.postings import Postings, values_of
from girder.sources import binary

BOX = "id long, x0 double, x1 double, y0 double, y1 double, z0 double, z1 double"


def box(r, k, wide=3.0):
    low = [r.uniform(0, 4) for _ in range(3)]
    return (k, *[v for a in low for v in (a, a + r.uniform(0.3, wide))])


def share(b, c):
    covered = whole = 1.0
    for k in (1, 3, 5):
        covered *= max(0.0, min(b[k + 1], c[k + 1]) - max(b[k], c[k]))
        whole *= b[k + 1] - b[k]
    return covered / whole if whole > 0 else 0.0


def test_covered_boxes_meet_groups_of_covers(spark, monkeypatch):
    r = random.Random(1)
    near = [(k, *[v + r.uniform(0, 0.01) for v in (1.0, 3.0, 1.0, 2.5, 1.0, 3.5)]) for k in range(1500)]
    covers = near + [box(r, k) for k in range(1500, 1600)] + [(1700, 1.0, 1.0, 1.0, 2.0, 1.0, 2.0), (1701, None, 1.0, 1.0, 2.0, 1.0, 2.0)]
    rows = [box(r, k) for k in range(150)] + [(500, 2.0, 2.0, 1.0, 2.0, 1.0, 2.0), (501, 1.2, 2.8, 1.2, 2.3, 1.2, 3.0), (502, 1.2, 2.8, 1.2, 2.3, 1.2, 3.0)]
    met, plain = [], scene.box_pairs
    monkeypatch.setattr(scene, "box_pairs", lambda a, b, *rest: met.append(b.count()) or plain(a, b, *rest))
    got = sorted(x["id"] for x in scene.covered_boxes(spark.createDataFrame(rows, BOX), spark.createDataFrame(covers, BOX), "id", 4.0, 0.6).collect())
    assert got == [b[0] for b in rows if any(None not in c and share(b, c) >= 0.6 for c in covers)]
    assert met[0] < 200  # groups of covers, not 1602 covers


def test_nearest_segment_looks_once_for_points_on_one_place(spark, monkeypatch):
    r = random.Random(4)
    places = [(r.uniform(0, 40), r.uniform(0, 40)) for _ in range(30)] + [(300.0, 300.0)]
    points = [(k, *places[k % len(places)]) for k in range(600)]
    segments = [(k, (x := r.uniform(0, 40)), (y := r.uniform(0, 40)), x + r.uniform(-3, 3), y + r.choice([1, 30]) * r.uniform(-1, 1)) for k in range(300)] + [(900, 300.0, 305.0, 300.0, 309.0), (899, 300.0, 305.0, 300.0, 305.0)]
    met, plain = [], spatial.containment_join
    monkeypatch.setattr(spatial, "containment_join", lambda a, b, *rest: met.append(b.count()) or plain(a, b, *rest))
    found = spatial.nearest_segment(spark.createDataFrame(points, "p long, x double, y double"), spark.createDataFrame(segments, "s long, x0 double, y0 double, x1 double, y1 double"), "p", "s", 6.0)
    got = {x["p"]: (x["s"], x["distance"]) for x in found.collect()}

    def gap(x, y, x0, y0, x1, y1):
        n = (x1 - x0) ** 2 + (y1 - y0) ** 2
        t = max(0.0, min(1.0, ((x - x0) * (x1 - x0) + (y - y0) * (y1 - y0)) / n)) if n else 0.0
        return ((x - x0 - t * (x1 - x0)) ** 2 + (y - y0 - t * (y1 - y0)) ** 2) ** 0.5

    for p, x, y in points:
        d, s = min((gap(x, y, *g[1:]), g[0]) for g in segments)
        assert (got[p][0] == s and abs(got[p][1] - d) < 1e-9) if d <= 6 else p not in got
    assert got[len(places) - 1][0] == 899
    assert max(met) <= len(places)


def test_same_plan_looks_at_few_pairs(spark, monkeypatch):
    r = random.Random(5)
    plan = lambda k, by, spread: (k, by, *[v + r.uniform(0, spread) for v in (0.0, 3.0, 0.0, 2.0)])
    boxes = [plan(k, r.choice("ab"), 4.0) for k in range(400)] + [(400, "c", 0.0, 1.0, 0.0, 1.0), (401, "a", None, 1.0, 0.0, 1.0), (402, None, 0.0, 1.0, 0.0, 1.0), (403, "d", 0.0, 1.0, 0.0, 1.0)]
    others = [plan(k, "a", 0.2) for k in range(400)] + [plan(k, "b", 4.0) for k in range(60)] + [(1, None, 0.0, 1.0, 0.0, 1.0), (2, "d", 1.5, 2.5, -1.5, 1.0), (3, "c", 1.5000001, 1.0, 0.0, 1.0)]
    looked, plain = [], spatial.written
    monkeypatch.setattr(spatial, "written", lambda df, name: looked.append((name, (out := plain(df, name)).count())) or out)
    schema = "id long, by string, x0 double, x1 double, y0 double, y1 double"
    got = sorted(x["id"] for x in scene.same_plan(spark.createDataFrame(boxes, schema), spark.createDataFrame(others, schema), "id", "by", 1.5).collect())
    good = lambda b, o: b[1] is not None and b[1] == o[1] and None not in b and all(abs(p - q) <= 1.5 for p, q in zip(b[2:], o[2:], strict=True))
    assert got == [b[0] for b in boxes if any(good(b, o) for o in others)]
    pairs = [n for name, n in looked if name == "partner-groups"]
    assert pairs and sum(pairs) < 12000  # of 100,000 with one key


def test_smallest_container_sorts_nothing_by_point(spark):
    boxes = spark.createDataFrame([("b", 0.0, 4.0), ("a", 1.0, 5.0), ("c", 0.0, 9.0)], "id string, x0 double, x1 double")
    points = spark.createDataFrame([(k, float(k)) for k in range(12)], "p long, x double")
    found = spatial.smallest_container(boxes, points, "p", "id", boxes["x1"] - boxes["x0"], {"x": ("x0", "x1")}, [2.0])
    assert {r["p"]: r["id"] for r in found.collect()} == {0: "b", 1: "a", 2: "a", 3: "a", 4: "a", 5: "a", 6: "c", 7: "c", 8: "c", 9: "c"}
    assert "SortAggregate" not in found._jdf.queryExecution().executedPlan().toString()


def test_records_of_many_pages_are_found_at_once(spark):
    r = random.Random(8)
    row = lambda owner, element: struct.pack("<QIQIIIQ", owner, 0, element, 1, 1, 1, element)
    pages = {}
    for k in range(60):
        parts = [row(r.randrange(9), r.randrange(9)) if r.random() < 0.6 else bytes(r.randrange(256) for _ in range(r.randrange(50))) for _ in range(r.randrange(4))]
        pages[f"p{k}"] = b"".join(parts)
    whole = row(3, 4)
    pages |= {"cut": whole[:25], "rest": whole[25:], "long": b"\x01" * binary.SCANNED + whole, "after": whole}
    wanted = sorted((p, int(at), *[int(v[k].astype(np.int64)) for v in values]) for p, x in pages.items() for at, values in [binary.find(x, binary.OWNERSHIP_ROW)] for k, at in enumerate(at))
    rows = spark.createDataFrame([*pages.items(), ("none", None)], "path string, content binary").coalesce(1)
    found = binary.scan_records(rows, binary.OWNERSHIP_ROW)
    assert sorted(tuple(x) for x in found.collect()) == wanted and ("after", 0) in {x[:2] for x in wanted}
    batches = found.mapInArrow(lambda it: (pa.record_batch([pa.array([b.num_rows])], ["n"]) for b in it), "n long").collect()
    assert len(batches) < 10  # not one for each page


def test_pages_of_one_small_file_are_read_in_many_tasks(spark, tmp_path):
    from girder.plans import source_catalogue

    spark.range(40).selectExpr("id AS p_partkey", "'a' AS p_name", "'b' AS p_brand", "'c' AS p_type", "CAST(id % 9 AS INT) AS p_size", "1D AS p_retailprice").coalesce(1).write.parquet(str(tmp_path / "part.parquet"))
    for name in ("page_payloads", "ownership_records", "bounds_records", "category_records"):
        found = getattr(source_catalogue, name)(spark, str(tmp_path))
        assert found.rdd.getNumPartitions() > 1, name


def test_upright_rectangles_are_judged_where_they_meet(spark, monkeypatch):
    r = random.Random(3)
    boxes = {k: (r.uniform(0, 30), r.uniform(0, 30), r.uniform(2, 9), r.uniform(2, 9), r.randrange(40) / 4) for k in range(60)}
    levels = spark.createDataFrame([(1, k, b[4]) for k, b in boxes.items()], "model long, level long, elevation double")
    ring = lambda k, x, y, w, h, _: [(1, k, 0, 0, i, *c) for i, c in enumerate([(x, y), (x + w, y), (x + w, y + h), (x, y + h)])]
    rings = spark.createDataFrame([c for k, b in boxes.items() for c in ring(k, *b)], "model long, level long, polygon long, ring long, place long, x double, y double")
    names, plain = [], plates.written
    monkeypatch.setattr(plates, "written", lambda df, name: names.append(name) or plain(df, name))
    joined, found = plates.connections(levels, rings)

    def gap(a, b):
        out = []
        for (x, y, w, h, _), (u, v, s, t, _) in ((a, b), (b, a)):
            for p in (x, x + w):
                for q in (y, y + h):
                    inside = min(p - u, u + s - p, q - v, v + t - q)
                    out.append(inside if inside >= 0 else (max(u - p, p - u - s, 0) ** 2 + max(v - q, q - v - t, 0) ** 2) ** 0.5)
        return min(out)

    wanted = {}
    for j, a in boxes.items():
        for k, b in boxes.items():
            if (a[4], j) < (b[4], k) and b[4] - a[4] <= plates.RISE and gap(a, b) <= plates.GAP:
                over = max(0.0, min(a[0] + a[2], b[0] + b[2]) - max(a[0], b[0])) * max(0.0, min(a[1] + a[3], b[1] + b[3]) - max(a[1], b[1]))
                if over / min(a[2] * a[3], b[2] * b[3]) <= plates.STACKED:
                    wanted[j, k] = gap(a, b)
    got = {(x["lower"], x["upper"]): x["gap"] for x in joined.collect()}
    assert got.keys() == wanted.keys() and len(got) > 50 and all(abs(got[k] - wanted[k]) < 1e-4 for k in got)
    assert "pair-edges" not in names

    monkeypatch.setattr(plates, "written", plain)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)  # runs and pairs over many batches
    try:
        merged = {x["level"]: (x["group_level"], x["primary_level"]) for x in plates.storeys(found, joined).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    order = sorted(boxes, key=lambda k: (boxes[k][4], k))
    group = {k: [k] for k in order}
    for a, b in sorted(wanted, key=lambda p: (order.index(p[0]), order.index(p[1]))):
        both = group[a] + group[b]
        if group[a] is not group[b] and max(boxes[k][4] for k in both) - min(boxes[k][4] for k in both) <= plates.RISE:
            for k in both:
                group[k] = both
    first = lambda g: min(g, key=order.index)
    assert merged == {k: (first(group[k]), max(group[k], key=lambda m: (boxes[m][2] * boxes[m][3], -order.index(m)))) for k in boxes}


def test_dense_rectangles_meet_in_few_cells(spark, monkeypatch):
    """Each pair is looked at once, most looked at are near, and crowded cells and other sizes lose none."""
    r = random.Random(12)
    boxes = {k: (r.randrange(90) / 2, r.randrange(90) / 2, r.choice([2.0, 5.0, 8.0]), r.choice([3.0, 6.0]), r.randrange(80) / 4) for k in range(500)}
    boxes |= {1000 + k: (0.0, 0.0, w, w, 3.0 + k) for k, w in enumerate([60.0, 400.0, 400.0])}
    corners = lambda k, x, y, w, h, _: [(1, k, 0, 0, i, *c) for i, c in enumerate([(x, y), (x + w, y), (x + w, y + h), (x, y + h)])]

    def wanted(a, b):
        apart = [max(b[k] - a[k] - a[k + 2], a[k] - b[k] - b[k + 2]) for k in (0, 1)]
        over = [min(a[k] + a[k + 2], b[k] + b[k + 2]) - max(a[k], b[k]) for k in (0, 1)]
        if min(over) > 0 and over[0] * over[1] / min(a[2] * a[3], b[2] * b[3]) > plates.STACKED:
            return None
        out = []
        for (x, y, w, h, _), (u, v, s, t, _) in ((a, b), (b, a)):
            for p in (x, x + w):
                for q in (y, y + h):
                    inside = min(p - u, u + s - p, q - v, v + t - q)
                    out.append(inside if inside >= 0 else (max(u - p, p - u - s, 0) ** 2 + max(v - q, q - v - t, 0) ** 2) ** 0.5)
        return (max(apart[0], 0) ** 2 + max(apart[1], 0) ** 2) ** 0.5 if max(apart) > 0 else min(out)

    for kept, block, look in ((boxes, 7, 50), ({k: b for k, b in boxes.items() if k < 1000}, 4096, 1 << 16)):
        levels = spark.createDataFrame([(1, k, b[4]) for k, b in kept.items()], "model int, level long, elevation double")
        rings_ = spark.createDataFrame([c for k, b in kept.items() for c in corners(k, *b)], "model int, level long, polygon long, ring long, place long, x double, y double")
        near = {(j, k): g for j, a in kept.items() for k, b in kept.items() if (a[4], j) < (b[4], k) and b[4] - a[4] <= plates.RISE and (g := wanted(a, b)) is not None and g <= plates.GAP}
        monkeypatch.setattr(spatial, "BLOCK", block)
        monkeypatch.setattr(plates, "LOOK", look)
        joined, _ = plates.connections(levels, rings_)
        plan = joined._jdf.queryExecution().executedPlan().toString()
        assert "Join" not in plan.split("Exchange")[0]  # no row for each pair that is looked at
        got = [(x["lower"], x["upper"], x["gap"]) for x in joined.collect()]
        assert len(got) == len(near) > 3000 and all(abs(near[j, k] - g) < 1e-4 for j, k, g in got)

    few = spark.createDataFrame([(1, k, *b) for k, b in boxes.items() if k < 1000], "model int, id long, x double, y double, w double, h double, z double").selectExpr("*", "x + w as x_", "y + h as y_", "x - 3 as lx", "x + w + 3 as hx", "y - 3 as ly", "y + h + 3 as hy")
    monkeypatch.setattr(spatial, "BLOCK", 4096)
    rows, keys = spatial.cell_mates(few, few.drop("lx", "hx", "ly", "hy"), [("lx", "hx"), ("ly", "hy")], [("x", "x_"), ("y", "y_")], ["model"], [7.0, 7.0], "z")
    looked = rows.groupBy(*keys).agg((F.count_if(F.col("side_") == 0) * F.count_if(F.col("side_") == 1)).alias("n")).agg(F.sum("n")).first()[0]
    shared = sum(abs(2 * a[0] + a[2] - 2 * b[0] - b[2]) <= a[2] + b[2] + 6 and abs(2 * a[1] + a[3] - 2 * b[1] - b[3]) <= a[3] + b[3] + 6 for a in [boxes[k] for k in range(500)] for b in [boxes[k] for k in range(500)])
    assert shared <= looked < 5 * shared and rows.filter("side_ = 0").count() == 500


def test_pairs_of_rectangles_are_judged_at_their_turn(spark):
    r = random.Random(9)
    boxes = {(m, k): (r.uniform(0, wide), r.uniform(0, wide), r.uniform(2, 9), r.uniform(2, 9), r.randrange(60) / 4) for m, wide, n in ((1, 14, 150), (2, 60, 80), (3, 1, 1)) for k in range(n)}
    boxes |= {(2, 900 + k): (0.0, 8.0 * k, 4.0, 5.0, 40.0) for k in range(5)}  # a run of its own
    levels = spark.createDataFrame([(m, k, b[4]) for (m, k), b in boxes.items()] + [(1, 5000, None), (1, 5001, 3.0)], "model long, level long, elevation double")

    def corners(m, k, x, y, w, h, _):
        cut = [(x, y), (x + w, y), (x + w, y + h / 2), (x + w / 2, y + h), (x, y + h)] if k % 5 == 0 else [(x, y), (x + w, y), (x + w, y + h), (x, y + h)]
        return [(m, k, 0, 0, i, *c) for i, c in enumerate(cut)]

    rows = [c for (m, k), b in boxes.items() for c in corners(m, k, *b)]
    schema = "model long, level long, polygon long, ring long, place long, x double, y double"
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)  # runs and pairs over many batches
    try:
        for kept in (rows, [c for c in rows if c[1] % 5]):
            rings = spark.createDataFrame(kept, schema)
            joined, found = plates.connections(levels, rings)
            wanted = sorted(map(tuple, plates.storeys(found, joined).collect()))
            out = plates.connected_storeys(levels, rings)
            assert sorted(map(tuple, out.collect())) == wanted
            assert len({(m, g) for m, _, g, _ in wanted}) < len(wanted)
        assert "lower" not in out._jdf.queryExecution().analyzed().toString()  # no pairs were made
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_small_groups_make_no_partial_hull(monkeypatch):
    calls, plain = [], hulls.hull
    monkeypatch.setattr(hulls, "hull", lambda points: calls.append(len(points)) or plain(points))
    r = np.random.default_rng(2)
    key, xy = r.integers(0, 500, 1500), r.integers(0, 9, (1500, 2)).astype(float)
    key, xy = np.concatenate([key, np.full(4000, 500)]), np.concatenate([xy, r.normal(size=(4000, 2))])
    kept, points = hulls._reduced(list(range(501)), key, xy)
    assert len(calls) == 1 and (np.diff(kept) >= 0).all() and len(hulls._reduced([], key[:0], xy[:0])[0]) == 0
    for k in range(501):
        assert plain(xy[key == k]).tolist() == plain(points[kept == k]).tolist()


def test_owners_of_few_rows_need_no_joins(spark, monkeypatch):
    r = random.Random(12)
    segments, corners = [], []
    for owner in range(60):
        for ring in range(r.randrange(1, 5)):
            n, cx, cy = r.choice([2, 3, 4, 9]), 40.0 * ring, r.uniform(0, 9)
            points = [(cx + (5 + r.random()) * math.cos(6.28 * k / n), cy + 5 * math.sin(6.28 * k / n), 0.0) for k in range(n)]
            for k in range(n if r.random() < 0.7 else n - 1):
                a, b = points[k], (points[(k + 1) % n][0] + r.choice([0.0, 3e-5]), *points[(k + 1) % n][1:])
                segments += [(owner, r.randrange(1 << 40), *p, *q) for p, q in ((a, b), (b, a))[: r.choice([1, 1, 2])]]
            h = r.choice([1.0, 3.0, 3.0, 8.0, 20.0])
            shape = [(-h, -h), (h, -h), (h, h), (-h, h)] if r.random() < 0.6 else [(-h, 0.0), (0.0, -h), (h, 0.0), (0.0, h), (-h / 2, h / 3)]
            corners += [(owner, ring, k, u + r.randrange(4), w + r.randrange(2) * 0.0) for k, (u, w) in enumerate(shape)]
    segments += [(0, 1 << 41, 0.0, 0.0, 0.0, 0.0, 9.0, 0.0), (0, (1 << 41) + 1, 0.0, 0.0, 0.0, 9.0, 9.0, 0.0), (70, 1, None, 0.0, 0.0, 1.0, 1.0, 1.0), (71, 1, 0.0, 0.0, 0.0, 1e-5, 0.0, 0.0)]
    corners += [(80, 1, 0, 0.0, 0.0), (80, 1, 1, 1.0, 1.0)]
    a = spark.createDataFrame(segments, "owner long, segment long, x0 double, y0 double, z0 double, x1 double, y1 double, z1 double")
    b = spark.createDataFrame(corners, "owner long, ring int, place int, x double, y double")

    def told():
        closed, open_ = rings.assembled(a, "owner", "segment")
        flat = lambda row: tuple(round(v, 6) if isinstance(v, float) else v for v in row)
        return [sorted(map(repr, map(flat, df.collect()))) for df in (closed, open_, rings.nested(b, "owner", "ring", "place"))]

    names, plain = [], rings.written
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)  # owners over many batches
    try:
        monkeypatch.setattr(rings, "written", lambda df, name: names.append(name) or plain(df, name))
        small = told()
        assert not {"arcs", "ring-sides"} & set(names) and all(len(rows) > 20 for rows in small)
        monkeypatch.setattr(rings, "FEW", 0)
        assert told() == small
        monkeypatch.setattr(rings, "FEW", 8)
        assert told() == small
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_postings_hold_each_value_once(spark):
    rows = spark.createDataFrame([(k, ["Big Red", "small", f"n{k % 3}xy"]) for k in range(300)], "id long, words array<string>")
    index = Postings(rows, "id", values_of(F.col("words")))
    assert index.table.count() == 5 + 3 + 3 * 2 and index.values.count() == 5
    assert [x["id"] for x in index.search("N2X", ["id"], 1000).collect()] == list(range(2, 300, 3))
    assert index.search("g r", ["id"], 1000).count() == 300


def test_lines_of_a_written_file_are_read_apart(spark, tmp_path, monkeypatch):
    from girder.plans import exchange_catalogue

    spark.range(60).selectExpr("id AS p_partkey", "concat('ä', chr(10), id) AS p_name", "CAST(id % 50 AS INT) AS p_size").write.parquet(str(tmp_path / "part.parquet"))
    plans, plain = {}, exchange_catalogue.written
    monkeypatch.setattr(exchange_catalogue, "written", lambda df, name: plans.update({name: df._jdf.queryExecution().executedPlan().toString()}) or plain(df, name))
    out = {x["name"]: x for x in exchange_catalogue.ifc_round_trip(spark, str(tmp_path)).collect()}
    assert "Python" not in plans["entities"] and "binaryFile" not in plans["entities"]
    name = lambda k: f"ä\n{k} – '{k}°"
    assert len(out) == 60 and all(out[name(k)]["storey"] == f"Level é {k % 25}" and out[name(k)]["host"] == (name(k + 1) if k % 10 == 0 else None) for k in range(60))


def test_lines_of_orders_are_gathered_in_bounded_parts(spark, tmp_path, monkeypatch):
    from girder.plans import scene_catalogue

    spark.range(600).selectExpr("id % 200 AS l_orderkey", "CAST(id DIV 200 + 1 AS INT) AS l_linenumber", "id % 3 % 2 + 1 AS l_suppkey").write.parquet(str(tmp_path / "lineitem.parquet"))
    spark.range(200).selectExpr("id AS o_orderkey", "id % 20 AS o_custkey").write.parquet(str(tmp_path / "orders.parquet"))
    spark.range(1, 3).selectExpr("id AS s_suppkey", "CAST(2 - id AS DOUBLE) AS s_acctbal").write.parquet(str(tmp_path / "supplier.parquet"))
    spark.range(20).selectExpr("id AS c_custkey", "CAST(id AS DOUBLE) AS c_acctbal").write.parquet(str(tmp_path / "customer.parquet"))
    monkeypatch.setattr(scene_catalogue, "LINES_A_PART", 50)
    out = scene_catalogue.unique_symbol_target(spark, str(tmp_path))
    assert "REPARTITION_BY_NUM" in (plan := out._jdf.queryExecution().executedPlan().toString()) and "hashpartitioning(l_orderkey" in plan and ", 13)" in plan
    lines = {(k % 200, k // 200 + 1): k % 3 % 2 + 1 for k in range(600)}
    wanted = {}
    for o in range(199, -1, -1):
        offsets = [n for n in (1, 2, 3) if lines[o, n] == 1]
        if offsets and o % 20 > 0:
            wanted[o % 20] = (1, min(offsets))
    assert {x["o_custkey"]: (x["family_id"], x["field_offset"]) for x in out.collect()} == wanted
