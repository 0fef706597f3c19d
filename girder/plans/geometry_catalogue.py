"""Queries of plan geometry: rings, nesting, hulls, clipped lines, triangles, levels that belong together; each with the SQL it must agree with."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from girder.operators import hulls as U
from girder.operators import plates as L
from girder.operators import polylines as N
from girder.operators import rings as G
from girder.operators import triangles as D
from girder.operators.spatial import nearest_segment
from girder.plans.catalogue import query, rounded, table

#: One row for each line number of an order.
LINES = "(SELECT l_orderkey, l_linenumber, min(l_quantity) AS l_quantity, min(l_partkey) AS l_partkey FROM lineitem GROUP BY l_orderkey, l_linenumber)"
#: Closed walks in words that Spark and DuckDB read alike: the lines of each order, and all customers (owner -1).
WALKS = f"""
SELECT l_orderkey AS owner, l_linenumber AS segment, l_quantity * 1e0 AS x, l_linenumber * 10 + l_partkey % 7 * 1e0 AS y, l_partkey % 2 = 1 AS swapped FROM {LINES}
UNION ALL SELECT -1 AS owner, c_custkey AS segment, c_custkey * 1e0 AS x, c_custkey * 7919 % 1000 * 1e0 AS y, c_custkey % 2 = 1 AS swapped FROM customer
"""
STEPS = """
SELECT w.*, row_number() OVER (PARTITION BY owner ORDER BY segment) - 1 AS i, count(*) OVER (PARTITION BY owner) AS k,
  coalesce(lead(x) OVER (PARTITION BY owner ORDER BY segment), first_value(x) OVER (PARTITION BY owner ORDER BY segment)) AS nx,
  coalesce(lead(y) OVER (PARTITION BY owner ORDER BY segment), first_value(y) OVER (PARTITION BY owner ORDER BY segment)) AS ny FROM w
"""


def unordered_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sides of the walks as segments, every other one backwards, some twice; a fifth of the owners lack their last one."""
    for t in ("lineitem", "customer"):
        table(spark, sf_dir, t).createOrReplaceTempView(f"girder_{t}")
    walks = WALKS.replace("FROM lineitem", "FROM girder_lineitem").replace("FROM customer", "FROM girder_customer")
    steps = spark.sql(f"WITH w AS ({walks}) {STEPS}").filter("NOT (owner > 0 AND owner % 5 = 0 AND i = k - 1)")
    drift = F.when(F.col("segment") % 2 == 0, 3e-5).otherwise(0.0)
    ends = [F.when(F.col("swapped"), F.col(b)).otherwise(F.col(a)).alias(c) for a, b, c in (("x", "nx", "x0"), ("y", "ny", "y0"), ("nx", "x", "x1"), ("ny", "y", "y1"))]
    once = steps.select("owner", F.col("segment").cast("long").alias("segment"), *ends, drift.alias("z0"), drift.alias("z1"))
    again = once.filter("owner > 0 AND owner % 3 = 0").selectExpr("owner", "segment + 100 AS segment", "x1 AS x0", "y1 AS y0", "x0 AS x1", "y0 AS y1", "z0", "z1")
    return once.unionByName(again)


@query(f"""
WITH w AS ({WALKS}), s AS ({STEPS}),
r AS (SELECT *, bool_or(swapped AND i = 0) OVER (PARTITION BY owner) AS back, abs(sum(x * ny - nx * y) OVER (PARTITION BY owner)) / 2 AS area, min(segment) OVER (PARTITION BY owner) AS ring FROM s WHERE k >= 3 AND NOT (owner > 0 AND owner % 5 = 0))
SELECT CAST(owner AS BIGINT) AS owner, CAST(ring AS BIGINT) AS ring, CAST(1 AS BIGINT) AS ring_no, round(area, 6) AS area, k AS sides, CAST(CASE WHEN back THEN (k - i) % k ELSE i END AS BIGINT) AS place, CAST(segment AS BIGINT) AS segment,
  swapped <> back AS reversed, CASE WHEN back THEN nx ELSE x END AS x, CASE WHEN back THEN ny ELSE y END AS y FROM r
""")
def ring_assembly(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(G.assembled(unordered_segments(spark, sf_dir), "owner", "segment")[0].drop("z"), "area")


@query(f"""
WITH w AS ({WALKS}), s AS ({STEPS})
SELECT CAST(owner AS BIGINT) AS owner, CAST(segment AS BIGINT) AS segment FROM s WHERE NOT (owner > 0 AND owner % 5 = 0 AND i = k - 1) AND (k = 2 AND i = 0 OR k >= 2 AND owner > 0 AND owner % 5 = 0)
""")
def open_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.assembled(unordered_segments(spark, sf_dir), "owner", "segment")[1]


#: Squares and diamonds around a few centres, one for each line of an order.
CORNERS = f"""
SELECT l_orderkey AS owner, l_linenumber AS ring, k AS place, l_partkey % 3 * 25e0 + CASE WHEN l_partkey % 2 = 0 THEN CASE WHEN k IN (0, 3) THEN -1 ELSE 1 END * l_quantity ELSE CASE k WHEN 0 THEN -1.5e0 WHEN 2 THEN 1.5e0 ELSE 0e0 END * l_quantity END AS x,
  CASE WHEN l_partkey % 2 = 0 THEN CASE WHEN k < 2 THEN -1e0 ELSE 1e0 END * l_quantity ELSE CASE k WHEN 1 THEN -1.5e0 WHEN 3 THEN 1.5e0 ELSE 0e0 END * l_quantity END AS y
FROM {LINES}, (SELECT unnest(range(4)) AS k)
"""


@query(f"""
WITH c AS ({CORNERS}),
e AS (SELECT a.owner, a.ring, a.x, a.y, b.x AS x2, b.y AS y2 FROM c a JOIN c b ON a.owner = b.owner AND a.ring = b.ring AND b.place = (a.place + 1) % 4),
a AS (SELECT owner, ring, abs(sum(x * y2 - x2 * y)) / 2 AS area FROM e GROUP BY ALL),
h AS (SELECT c.owner, c.ring, e.ring AS outer_ring, c.place FROM c JOIN e ON c.owner = e.owner AND c.ring <> e.ring WHERE (e.y > c.y) <> (e.y2 > c.y) AND c.x < e.x + (c.y - e.y) / (e.y2 - e.y) * (e.x2 - e.x) GROUP BY ALL HAVING count(*) % 2 = 1),
v AS (SELECT owner, ring, outer_ring FROM h GROUP BY ALL HAVING count(*) > 2),
d AS (SELECT a.*, (SELECT count(*) FROM v WHERE v.owner = a.owner AND v.ring = a.ring) AS depth FROM a),
s AS (SELECT v.owner, v.ring, min({{'area': d.area, 'ring': d.ring}}).ring AS outer_ring FROM v JOIN d ON d.owner = v.owner AND d.ring = v.outer_ring WHERE d.depth % 2 = 0 GROUP BY ALL)
SELECT d.owner, d.ring, d.depth, CASE WHEN d.depth % 2 = 1 THEN s.outer_ring END AS outer_ring FROM d LEFT JOIN s USING (owner, ring)
""")
def ring_nesting(spark: SparkSession, sf_dir: str) -> DataFrame:
    table(spark, sf_dir, "lineitem").createOrReplaceTempView("girder_lineitem")
    corners = spark.sql(CORNERS.replace("FROM lineitem", "FROM girder_lineitem").replace("unnest(range(4))", "explode(sequence(0, 3))"))
    return G.nested(corners, "owner", "ring", "place").withColumnRenamed("outer", "outer_ring")


#: Points of a supplier's lines on whole numbers, and of all lines (supplier 0).
SPOTS = "SELECT l_suppkey AS k, CAST(l_quantity AS INTEGER) AS x, CAST(l_partkey % 97 AS INTEGER) AS y FROM lineitem WHERE l_linenumber <= 4 UNION ALL SELECT 0 AS k, CAST(l_quantity AS INTEGER) AS x, CAST(l_partkey % 97 AS INTEGER) AS y FROM lineitem"


@query(f"""
WITH p AS ({SPOTS}), n AS (SELECT k, count(*) AS n, CAST((max(x) - min(x)) * (max(y) - min(y)) AS DOUBLE) AS box_area FROM p GROUP BY k),
d AS (SELECT DISTINCT k, x, y FROM p),
c AS (SELECT k, x, min(y) AS y FROM d GROUP BY ALL UNION SELECT k, x, max(y) FROM d GROUP BY ALL),
e AS (SELECT a.k, a.x AS ax, a.y AS ay, b.x AS bx, b.y AS bq FROM c a JOIN c b ON a.k = b.k AND (a.x <> b.x OR a.y <> b.y)),
h AS (SELECT * FROM e WHERE NOT EXISTS (SELECT 1 FROM c r WHERE r.k = e.k AND ((bx - ax) * (r.y - ay) - (bq - ay) * (r.x - ax) < 0
  OR (bx - ax) * (r.y - ay) - (bq - ay) * (r.x - ax) = 0 AND ((r.x - ax) * (bx - ax) + (r.y - ay) * (bq - ay) < 0 OR (r.x - ax) * (bx - ax) + (r.y - ay) * (bq - ay) > (bx - ax) * (bx - ax) + (bq - ay) * (bq - ay))))),
a AS (SELECT k, count(*) AS corners, sum(ax * bq - bx * ay) / 2e0 AS area FROM h GROUP BY k),
w AS (SELECT h.k, ax, ay, bx, bq, (max((bx - ax) * c.x + (bq - ay) * c.y) - min((bx - ax) * c.x + (bq - ay) * c.y)) * (max((bx - ax) * c.y - (bq - ay) * c.x) - min((bx - ax) * c.y - (bq - ay) * c.x)) / (((bx - ax) * (bx - ax) + (bq - ay) * (bq - ay)) * 1e0) AS area FROM h JOIN c ON c.k = h.k GROUP BY h.k, ax, ay, bx, bq),
r AS (SELECT k, min(area) AS rectangle_area FROM w GROUP BY k)
SELECT CAST(k AS BIGINT) AS k, n, corners, area, box_area, round(rectangle_area, 6) AS rectangle_area, round(area / box_area, 6) AS fill, round(area / rectangle_area, 6) AS rectangle_fill FROM n JOIN a USING (k) JOIN r USING (k)
""")
def footprint_hulls(spark: SparkSession, sf_dir: str) -> DataFrame:
    table(spark, sf_dir, "lineitem").createOrReplaceTempView("girder_lineitem")
    spots = spark.sql(SPOTS.replace("FROM lineitem", "FROM girder_lineitem"))
    found = U.convex_hulls(spots.withColumn("k", F.col("k").cast("long")), "k", "x", "y").filter("size(hull) > 2")
    return rounded(found.select("k", "n", F.size("hull").cast("long").alias("corners"), "area", "box_area", "rectangle_area", "fill", "rectangle_fill"), "rectangle_area", "fill", "rectangle_fill")


#: Lines of an order: those of odd and of even numbers, each a path.
PATHS = f"SELECT l_orderkey AS element, l_linenumber % 2 AS line, l_linenumber AS place, l_quantity * 1e0 AS x, l_linenumber * 2e0 AS y, l_partkey % 40 * 1e0 AS z FROM {LINES}"
BANDS = "SELECT o_orderkey AS element, o_custkey % 25 * 1e0 AS z0, o_custkey % 25 + 16e0 AS z1 FROM orders"


@query(f"""
WITH p AS ({PATHS}), b AS ({BANDS}),
s AS (SELECT p.*, row_number() OVER w AS rank, lead(x) OVER w AS x_, lead(y) OVER w AS y_, lead(z) OVER w AS z_, z0, z1 FROM p JOIN b USING (element) WINDOW w AS (PARTITION BY element, line ORDER BY place)),
t AS (SELECT *, CASE WHEN z_ = z THEN 0e0 ELSE greatest(0e0, least((z0 - z) / (z_ - z), (z1 - z) / (z_ - z))) END AS t0, CASE WHEN z_ = z THEN 1e0 ELSE least(1e0, greatest((z0 - z) / (z_ - z), (z1 - z) / (z_ - z))) END AS t1 FROM s WHERE z_ IS NOT NULL),
c AS (SELECT *, CASE WHEN z_ = z THEN z BETWEEN z0 AND z1 ELSE t0 <= t1 END AS held,
  CASE WHEN t0 = 0 THEN {{'x': x, 'y': y, 'z': z}} ELSE {{'x': x + (x_ - x) * t0, 'y': y + (y_ - y) * t0, 'z': z + (z_ - z) * t0}} END AS a, CASE WHEN t1 = 1 THEN {{'x': x_, 'y': y_, 'z': z_}} ELSE {{'x': x + (x_ - x) * t1, 'y': y + (y_ - y) * t1, 'z': z + (z_ - z) * t1}} END AS e FROM t),
f AS (SELECT element, bool_or(NOT held OR t0 <> 0 OR t1 <> 1) AS clipped, bool_or(held) AS met FROM c GROUP BY element),
m AS (SELECT *, CASE WHEN lag(e) OVER w = a AND lag(rank) OVER w = rank - 1 THEN 0 ELSE 1 END AS fresh FROM c WHERE held WINDOW w AS (PARTITION BY element, line ORDER BY rank)),
r AS (SELECT *, sum(fresh) OVER (PARTITION BY element, line ORDER BY rank) AS run FROM m),
o AS (SELECT element, line, run, rank AS step, a AS q FROM r WHERE fresh = 1 UNION ALL SELECT element, line, run, rank + 1, e FROM r UNION ALL SELECT element, line, 1, rank, {{'x': x, 'y': y, 'z': z}} FROM s WHERE element IN (SELECT element FROM f WHERE NOT met))
SELECT element, line, CAST(run AS BIGINT) AS run, step, round(q.x, 6) AS x, round(q.y, 6) AS y, round(q.z, 6) AS z, clipped FROM o JOIN f USING (element)
""")
def clipped_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    for t in ("lineitem", "orders"):
        table(spark, sf_dir, t).createOrReplaceTempView(f"girder_{t}")
    points, bands = spark.sql(PATHS.replace("FROM lineitem", "FROM girder_lineitem")), spark.sql(BANDS.replace("FROM orders", "FROM girder_orders"))
    return rounded(N.clipped_to_band(points, bands, "element", "line", "place").withColumnRenamed("at", "step"), "x", "y", "z")


#: Triangles of customers on a coarse grid, so that many are equal but for order and rounding.
FACES = """
SELECT o_custkey AS element, o_orderkey AS ordinal, CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_orderkey % 5 END AS material,
  CASE o_orderkey % 3 WHEN 0 THEN 0e0 WHEN 1 THEN 4e0 ELSE 1e0 END AS x0, CASE o_orderkey % 3 WHEN 0 THEN 0e0 WHEN 1 THEN 0e0 ELSE 3e0 END AS y0, o_orderkey % 2 * 1e0 + 1e-9 AS z0,
  CASE o_orderkey % 3 WHEN 0 THEN 4e0 WHEN 1 THEN 1e0 ELSE 0e0 END AS x1, CASE o_orderkey % 3 WHEN 0 THEN 0e0 WHEN 1 THEN 3e0 ELSE 0e0 END AS y1, o_orderkey % 2 * 1e0 AS z1,
  CASE o_orderkey % 3 WHEN 0 THEN 1e0 WHEN 1 THEN 0e0 ELSE 4e0 END AS x2, CASE o_orderkey % 3 WHEN 0 THEN 3e0 WHEN 1 THEN 0e0 ELSE 0e0 END AS y2, o_orderkey % 2 * 1e0 AS z2 FROM orders
"""


@query(f"""
WITH f AS ({FACES}),
k AS (SELECT element, ordinal, coalesce(material, -1) AS m, list_sort([[round(x0 * 1e6), round(y0 * 1e6), round(z0 * 1e6)], [round(x1 * 1e6), round(y1 * 1e6), round(z1 * 1e6)], [round(x2 * 1e6), round(y2 * 1e6), round(z2 * 1e6)]]) AS c,
  sqrt(pow((y1 - y0) * (z2 - z0) - (z1 - z0) * (y2 - y0), 2) + pow((z1 - z0) * (x2 - x0) - (x1 - x0) * (z2 - z0), 2) + pow((x1 - x0) * (y2 - y0) - (y1 - y0) * (x2 - x0), 2)) / 2 AS area FROM f),
s AS (SELECT *, round(sum(area) OVER (PARTITION BY element, m) / 2e-12) AS support, CASE WHEN element % 2 = 0 AND m = 3 THEN 1 ELSE 0 END AS liked FROM k),
r AS (SELECT *, row_number() OVER w AS rn, first_value(m) OVER w AS won, count(*) OVER (PARTITION BY element, c) AS n FROM s WINDOW w AS (PARTITION BY element, c ORDER BY liked DESC, support DESC, m DESC, ordinal))
SELECT element, ordinal, rn = 1 AS kept, rn > 1 AND m <> won AS other_material FROM r WHERE n > 1
""")
def duplicate_triangles(spark: SparkSession, sf_dir: str) -> DataFrame:
    table(spark, sf_dir, "orders").createOrReplaceTempView("girder_orders")
    liked = table(spark, sf_dir, "customer").filter("c_custkey % 2 = 0").select(F.col("c_custkey").alias("element"), F.lit(3).alias("material"))
    return D.duplicates(spark.sql(FACES.replace("FROM orders", "FROM girder_orders")), liked, "element", "ordinal", "material")


#: A plate for each customer, a model for each nation.
PLATES = "SELECT c_nationkey AS model, c_custkey AS level, c_custkey * 37 % 97 / 4e0 AS elevation, c_custkey * 31 % 83 * 1e0 AS x0, c_custkey * 17 % 71 * 1e0 AS y0, 5e0 + c_custkey % 11 AS w, 4e0 + c_custkey % 7 AS h FROM customer"
CONNECTED = f"""
WITH p AS ({PLATES}),
q AS (SELECT a.model, a.level AS lower, b.level AS upper, b.elevation - a.elevation AS rise, a.x0 AS ax, a.y0 AS ay, a.x0 + a.w AS az, a.y0 + a.h AS aw, b.x0 AS bx, b.y0 AS bq, b.x0 + b.w AS bz, b.y0 + b.h AS bw, least(a.w * a.h, b.w * b.h) AS smaller
  FROM p a JOIN p b ON a.model = b.model AND (b.elevation > a.elevation OR b.elevation = a.elevation AND b.level > a.level) AND b.elevation - a.elevation <= 7),
d AS (SELECT *, greatest(0, least(az, bz) - greatest(ax, bx)) * greatest(0, least(aw, bw) - greatest(ay, bq)) / smaller AS ratio,
  list_transform([[ax, ay], [az, ay], [az, aw], [ax, aw]], lambda c: list_concat(c, [bx, bq, bz, bw])) AS one, list_transform([[bx, bq], [bz, bq], [bz, bw], [bx, bw]], lambda c: list_concat(c, [ax, ay, az, aw])) AS two FROM q),
g AS (SELECT model, lower, upper, rise, ratio, list_min(list_transform(list_concat(one, two), lambda c: CASE WHEN c[1] BETWEEN c[3] AND c[5] AND c[2] BETWEEN c[4] AND c[6] THEN least(c[1] - c[3], c[5] - c[1], c[2] - c[4], c[6] - c[2])
  ELSE sqrt(pow(greatest(c[3] - c[1], 0, c[1] - c[5]), 2) + pow(greatest(c[4] - c[2], 0, c[2] - c[6]), 2)) END)) AS gap FROM d),
n AS (SELECT * FROM g WHERE gap <= 3 AND ratio <= 0.12)
"""


def plates(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Levels and the rings of their plates."""
    table(spark, sf_dir, "customer").createOrReplaceTempView("girder_customer")
    boxes = spark.sql(PLATES.replace("FROM customer", "FROM girder_customer"))
    corner = lambda k, x, y: F.struct(F.lit(k).alias("place"), x.alias("x"), y.alias("y"))
    x, y, x_, y_ = F.col("x0"), F.col("y0"), F.col("x0") + F.col("w"), F.col("y0") + F.col("h")
    rings = boxes.select("model", "level", F.explode(F.array(corner(0, x, y), corner(1, x_, y), corner(2, x_, y_), corner(3, x, y_))).alias("c")).select("model", "level", F.lit(0).alias("polygon"), F.lit(0).alias("ring"), "c.*")
    return boxes.select("model", "level", "elevation"), rings


@query(CONNECTED + "SELECT model, lower, upper, rise, round(gap, 6) AS gap, round(ratio, 6) AS ratio FROM n")
def level_connections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.connections(*plates(spark, sf_dir), digits=6)[0]


@query(CONNECTED.replace("WITH p", "WITH RECURSIVE p", 1) + """,
i AS (SELECT *, row_number() OVER (PARTITION BY model ORDER BY elevation, level) AS k FROM p),
s AS (SELECT n.model, a.k AS a, b.k AS b, row_number() OVER (PARTITION BY n.model ORDER BY a.k, b.k) AS step FROM n JOIN i a ON a.model = n.model AND a.level = n.lower JOIN i b ON b.model = n.model AND b.level = n.upper),
e AS (SELECT model, list(elevation ORDER BY k) AS es, list(w * h ORDER BY k) AS areas, list(level ORDER BY k) AS levels, range(1, count(*) + 1) AS own FROM i GROUP BY model),
u AS (SELECT model, CAST(0 AS BIGINT) AS step, own AS root FROM e UNION ALL
  SELECT u.model, s.step, CASE WHEN list_max(list_transform(own, lambda k: CASE WHEN root[k] IN (root[a], root[b]) THEN es[k] END)) - list_min(list_transform(own, lambda k: CASE WHEN root[k] IN (root[a], root[b]) THEN es[k] END)) <= 7
    THEN list_transform(root, lambda r: CASE WHEN r = root[b] THEN root[a] ELSE r END) ELSE root END FROM u JOIN s ON s.model = u.model AND s.step = u.step + 1 JOIN e ON e.model = u.model),
f AS (SELECT model, max_by(root, step) AS root FROM u GROUP BY model),
r AS (SELECT f.model, unnest(own) AS k, unnest(root) AS root, unnest(levels) AS level, unnest(areas) AS area FROM f JOIN e USING (model))
SELECT model, level, first_value(level) OVER (PARTITION BY model, root ORDER BY k) AS group_level, first_value(level) OVER (PARTITION BY model, root ORDER BY area DESC, k) AS primary_level FROM r
""")
def connected_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.connected_storeys(*plates(spark, sf_dir))


@query("""
WITH p AS (SELECT c_custkey, c_custkey * 31 % 499 + 0.37e0 AS x, c_custkey * 17 % 487 + 0.11e0 AS y FROM customer),
s AS (SELECT p_partkey, p_partkey * 7 % 503 * 1e0 AS x0, p_partkey * 11 % 491 * 1e0 AS y0, p_partkey * 7 % 503 + p_partkey % 13 - 6e0 AS x1, p_partkey * 11 % 491 + p_partkey % 9 * CASE WHEN p_partkey % 50 = 0 THEN 40 ELSE 1 END - 4e0 AS y1 FROM part),
l AS (SELECT *, pow(x1 - x0, 2) + pow(y1 - y0, 2) AS len FROM s),
t AS (SELECT c_custkey, x, y, l.*, CASE WHEN len > 0 THEN greatest(0e0, least(1e0, ((x - x0) * (x1 - x0) + (y - y0) * (y1 - y0)) / len)) ELSE 0e0 END AS t FROM p JOIN l ON x BETWEEN least(x0, x1) - 6 AND greatest(x0, x1) + 6 AND y BETWEEN least(y0, y1) - 6 AND greatest(y0, y1) + 6),
d AS (SELECT c_custkey, p_partkey, sqrt(pow(x - x0 - t * (x1 - x0), 2) + pow(y - y0 - t * (y1 - y0), 2)) AS distance FROM t)
SELECT c_custkey, min({'d': distance, 'p': p_partkey}).p AS p_partkey, round(min(distance), 6) AS distance FROM d WHERE distance <= 6 GROUP BY c_custkey
""")
def nearest_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = table(spark, sf_dir, "customer").selectExpr("c_custkey", "c_custkey * 31 % 499 + 0.37D AS x", "c_custkey * 17 % 487 + 0.11D AS y")
    segments = table(spark, sf_dir, "part").selectExpr("p_partkey", "p_partkey * 7 % 503 * 1D AS x0", "p_partkey * 11 % 491 * 1D AS y0", "p_partkey * 7 % 503 + p_partkey % 13 - 6D AS x1", "p_partkey * 11 % 491 + p_partkey % 9 * CASE WHEN p_partkey % 50 = 0 THEN 40 ELSE 1 END - 4D AS y1")
    return rounded(nearest_segment(points, segments, "c_custkey", "p_partkey", 6.0), "distance")
