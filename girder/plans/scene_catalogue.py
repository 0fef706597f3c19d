"""Queries of relations, scenes and reports, each over whole driver tables, with the SQL it must agree with."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from girder.functions import semantics as X
from girder.operators import quality as Q
from girder.operators import relations as L
from girder.operators import reports as V
from girder.operators import resolve as R
from girder.operators import scene as C
from girder.operators import search as S
from girder.operators import shape as H
from girder.operators import spatial as P
from girder.plans.catalogue import query, rounded, table

#: Boxes made of parts, in words that Spark and DuckDB read alike.
BOX = (
    "p_partkey AS id, CASE WHEN p_partkey % 3 = 0 THEN NULL ELSE p_brand END AS category, p_size * 1e0 AS x0, p_size + (p_partkey % 7) * 0.5e0 + 0.5e0 AS x1, "
    "p_retailprice / 50 AS y0, p_retailprice / 50 + (p_partkey % 5) * 0.5e0 + 0.5e0 AS y1, (p_partkey % 10) * 1e0 AS z0, (p_partkey % 10) * 1e0 + (p_partkey % 3) + 0.5e0 AS z1"
)


def boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").selectExpr(*[x.strip() for x in BOX.split(", ")])


@query("""
WITH a AS (SELECT event_id AS id, user_id AS author, event_id * 7 % 100 AS updated FROM events WHERE event_id % 3 <> 0),
b AS (SELECT event_id AS id, user_id + 1000000 AS author, event_id * 11 % 100 AS updated FROM events WHERE event_id % 2 = 0)
SELECT coalesce(a.id, b.id) AS id, CASE WHEN a.id IS NULL OR b.updated >= a.updated THEN b.author ELSE a.author END AS author, CASE WHEN a.id IS NULL OR b.updated >= a.updated THEN b.updated ELSE a.updated END AS updated
FROM a FULL OUTER JOIN b ON a.id = b.id
""")
def comment_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    current = events.filter("event_id % 3 <> 0").selectExpr("event_id AS id", "user_id AS author", "event_id * 7 % 100 AS updated")
    imported = events.filter("event_id % 2 = 0").selectExpr("event_id AS id", "user_id + 1000000 AS author", "event_id * 11 % 100 AS updated")
    return L.comment_merge(current, imported, "id", "updated")


@query("""
SELECT event_id AS id, event_type AS stroke FROM events WHERE event_id % 3 <> 0 UNION ALL SELECT event_id, upper(event_type) FROM events WHERE event_id % 2 = 0 AND event_id % 3 = 0
""")
def markup_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    return L.markup_merge(events.filter("event_id % 3 <> 0").selectExpr("event_id AS id", "event_type AS stroke"), events.filter("event_id % 2 = 0").selectExpr("event_id AS id", "upper(event_type) AS stroke"), "id")


@query("""
SELECT event_id, guid FROM (SELECT event_id, CASE WHEN event_id % 2 = 0 THEN upper(event_type) ELSE event_type END || '-' || CAST(user_id AS VARCHAR) AS guid,
  row_number() OVER (PARTITION BY lower(event_type), user_id ORDER BY event_id) AS rn FROM events WHERE event_type IS NOT NULL) t WHERE rn = 1
""")
def dedupe_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").filter("event_type is not null").selectExpr("event_id", "CASE WHEN event_id % 2 = 0 THEN upper(event_type) ELSE event_type END || '-' || CAST(user_id AS STRING) AS guid")
    return L.deduplicated(rows, F.lower("guid"), "event_id")


@query("""
SELECT p_partkey, CASE WHEN p_partkey % 4 = 0 AND p_size + 1 IN (SELECT p_size FROM part WHERE p_brand <> 'Brand#11') THEN p_size + 1 ELSE p_size END AS p_size FROM part
""")
def regrouped(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part").select("p_partkey", "p_size", "p_brand")
    moves = part.filter("p_partkey % 4 = 0").select("p_partkey", (F.col("p_size") + 1).cast("int").alias("p_size"))
    return L.regrouped(part.select("p_partkey", "p_size"), moves, part.filter("p_brand <> 'Brand#11'").select("p_size"), "p_partkey", "p_size")


@query("""
SELECT l_partkey, l_suppkey FROM (SELECT l_partkey, l_suppkey, row_number() OVER (PARTITION BY l_partkey ORDER BY l_orderkey, l_linenumber, l_suppkey) AS rn FROM lineitem
 WHERE l_suppkey IN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 0) AND l_partkey IN (SELECT p_partkey FROM part WHERE p_size > 10)) t WHERE rn = 1
""")
def family_symbol_relation(spark: SparkSession, sf_dir: str) -> DataFrame:
    families, symbols = table(spark, sf_dir, "supplier").filter("s_acctbal > 0").select("s_suppkey"), table(spark, sf_dir, "part").filter("p_size > 10").select("p_partkey")
    return L.family_symbols(table(spark, sf_dir, "lineitem"), families, symbols, "l_partkey", "l_suppkey", ["l_orderkey", "l_linenumber"])


#: Lines of orders that one task gathers.
LINES_A_PART = 1_000_000


@query("""
WITH known AS (SELECT s_suppkey FROM supplier WHERE s_acctbal > 0),
l AS (SELECT o_custkey, l_orderkey, l_suppkey, l_linenumber FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0) AND l_suppkey IN (SELECT s_suppkey FROM known)),
g AS (SELECT o_custkey, l_orderkey, min(l_suppkey) AS family_id, min(l_linenumber) AS field_offset FROM l GROUP BY 1, 2 HAVING count(DISTINCT l_suppkey) = 1)
SELECT o_custkey, family_id, field_offset FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY l_orderkey) AS rn FROM g) t WHERE rn = 1
""")
def unique_symbol_target(spark: SparkSession, sf_dir: str) -> DataFrame:
    pair = F.struct(F.col("l_linenumber").cast("long").alias("at"), F.col("l_suppkey").cast("long").alias("family"))
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey")
    # as many parts as a million lines each, so that a task's memory doesn't grow with the table
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), lines.count() // LINES_A_PART + 1)
    listed = lines.repartition(parts, "l_orderkey").groupBy("l_orderkey").agg(F.flatten(F.transform(F.array_sort(F.collect_list(pair)), lambda p: F.array(p["family"], p["at"]))).alias("pairs"))  # one order's lines
    sets = listed.join(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey"), "l_orderkey")
    families, symbols = table(spark, sf_dir, "supplier").filter("s_acctbal > 0").select("s_suppkey"), table(spark, sf_dir, "customer").filter("c_acctbal > 0").select("c_custkey")
    return L.unique_symbol_targets(sets, families, symbols, "o_custkey", "l_orderkey", "pairs")


@query("""
WITH p AS (SELECT l_orderkey AS element_id, min(l_partkey) AS symbol_id FROM lineitem WHERE l_orderkey > 0 AND l_partkey > 0 GROUP BY 1 HAVING count(DISTINCT l_partkey) = 1),
e AS (SELECT l_partkey AS symbol_id, l_suppkey AS material_id, list_sort(list(l_linenumber)) AS tags FROM lineitem WHERE l_discount > 0.05 GROUP BY 1, 2)
SELECT p.element_id, p.symbol_id, e.material_id, array_to_string(e.tags, ',') AS tags FROM p JOIN e ON p.symbol_id = e.symbol_id
""")
def symbol_material_assignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem")
    placements = lines.select(F.col("l_orderkey").alias("element_id"), F.when(F.col("l_linenumber") % 2 == 0, F.col("l_partkey")).alias("symbol_id"), F.col("l_partkey").alias("geometry_id"))
    entries = lines.filter("l_discount > 0.05").select(F.col("l_partkey").alias("symbol_id"), F.col("l_linenumber").alias("geometry_tag"), F.col("l_suppkey").alias("material_id"))
    return L.symbol_materials(placements, entries).select("element_id", "symbol_id", "material_id", F.array_join("geometry_tags", ",").alias("tags"))


@query("""
SELECT DISTINCT l_partkey FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'O')
""")
def shared_geometry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.shared_geometry(table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders").filter("o_orderstatus = 'O'").select("o_orderkey"), "l_orderkey", "l_partkey")


@query("""
SELECT o_orderkey, o_custkey, c_name FROM orders LEFT JOIN (SELECT * FROM customer WHERE c_acctbal > 0) ON o_custkey = c_custkey
""")
def unique_id_enrichment(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = table(spark, sf_dir, "customer").filter("c_acctbal > 0").select(F.col("c_custkey").alias("o_custkey"), "c_name")
    return L.enriched(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), known, "o_custkey", "c_name").select("o_orderkey", "o_custkey", "c_name")


@query("""
SELECT o_orderkey, n_name FROM orders LEFT JOIN customer ON o_custkey = c_custkey AND c_custkey % 5 <> 0 LEFT JOIN nation ON c_nationkey = n_nationkey AND n_regionkey <> 2
""")
def family_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    symbols = table(spark, sf_dir, "customer").filter("c_custkey % 5 <> 0").select(F.col("c_custkey").alias("o_custkey"), "c_nationkey")
    names = table(spark, sf_dir, "nation").filter("n_regionkey <> 2").select(F.col("n_nationkey").alias("c_nationkey"), "n_name")
    return L.family_names(table(spark, sf_dir, "orders"), symbols, names, "o_orderkey", "o_custkey", "c_nationkey", "n_name")


@query("""
SELECT DISTINCT l_suppkey, l_partkey FROM lineitem WHERE l_partkey IN (SELECT p_partkey FROM part WHERE p_size < 20) AND l_suppkey IN (SELECT s_suppkey FROM supplier WHERE s_nationkey < 15)
""")
def hosted_openings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.hosted_openings(table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "part").filter("p_size < 20").select("p_partkey"), table(spark, sf_dir, "supplier").filter("s_nationkey < 15").select("s_suppkey"), "l_partkey", "l_suppkey")


@query("""
WITH c AS (SELECT 'ref-' || CAST(p_partkey // 3 AS VARCHAR) AS name, p_partkey % 50 * 700 AS word, p_partkey AS ordinal FROM part), d AS (SELECT 'ref-' || CAST(p_partkey // 3 AS VARCHAR) AS name, p_partkey % 50 * 700 AS tag FROM part WHERE p_size > 25)
SELECT name, word AS tag_reference, ordinal FROM (SELECT *, row_number() OVER (PARTITION BY name ORDER BY ordinal, word) AS rn FROM c WHERE word < 32768 AND name NOT IN (SELECT name FROM d) AND word IN (SELECT tag FROM d)) t WHERE rn = 1
""")
def schema_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "part").selectExpr("'ref-' || CAST(p_partkey div 3 AS STRING) AS name", "p_partkey % 50 * 700 AS word", "p_partkey AS ordinal", "p_size")
    extra = rows.select("name", "word", "ordinal")
    return L.schema_references(extra, rows.filter("p_size > 25").select("name", F.col("word").alias("tag")), "name", "word", "tag", "ordinal")


@query("""
SELECT DISTINCT l_suppkey FROM lineitem WHERE l_partkey IN (SELECT p_partkey FROM part WHERE p_size = 1 UNION SELECT p_partkey FROM part WHERE p_brand = (SELECT min(p_brand) FROM part))
""")
def assemblies_with_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    brand = part.join(F.broadcast(part.agg(F.min("p_brand").alias("p_brand"))), "p_brand")  # one row
    return L.assemblies_with_runs(table(spark, sf_dir, "lineitem"), "l_partkey", "l_suppkey", part.filter("p_size = 1").select("p_partkey"), brand.select("p_partkey"))


@query("""
SELECT s_suppkey, n_name FROM supplier LEFT JOIN (SELECT DISTINCT n_nationkey % 7 AS k, n_name FROM nation) ON s_nationkey = k
""")
def multi_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = table(spark, sf_dir, "nation").select((F.col("n_nationkey") % 7).alias("s_nationkey"), "n_name")
    return L.multi_lookup(table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey"), "s_nationkey", names, "n_name").select("s_suppkey", "n_name")


@query("""
SELECT 'rules' AS name, min(url) AS url FROM pages WHERE length(html) > 0 AND regexp_matches(url, '[02468]$') HAVING min(url) IS NOT NULL UNION ALL SELECT 'any', min(url) FROM pages WHERE length(html) > 0
""")
def stream_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.first_by_pattern(table(spark, sf_dir, "pages").select("url", F.length("html").alias("size")), "url", "size", {"rules": "[02468]$", "any": "."})


@query(f"""
WITH b AS (SELECT {BOX} FROM part)
SELECT id FROM b WHERE category IS NULL AND (x1 - x0) * (y1 - y0) * (z1 - z0) > 0 AND EXISTS (SELECT 1 FROM b w WHERE w.category IS NOT NULL AND
 greatest(0e0, least(b.x1, w.x1) - greatest(b.x0, w.x0)) * greatest(0e0, least(b.y1, w.y1) - greatest(b.y0, w.y0)) * greatest(0e0, least(b.z1, w.z1) - greatest(b.z0, w.z0)) / ((b.x1 - b.x0) * (b.y1 - b.y0) * (b.z1 - b.z0)) >= 0.6e0)
""")
def overlap_volume_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = boxes(spark, sf_dir)
    return C.covered_boxes(b.filter("category is null"), b.filter("category is not null"), "id", 4.0, 0.6)


@query(f"""
WITH b AS (SELECT {BOX} FROM part)
SELECT id FROM b WHERE id % 2 = 1 AND EXISTS (SELECT 1 FROM b o WHERE o.id % 2 = 0 AND o.category = b.category AND abs(o.x0 - b.x0) <= 1.5e0 AND abs(o.x1 - b.x1) <= 1.5e0 AND abs(o.y0 - b.y0) <= 1.5e0 AND abs(o.y1 - b.y1) <= 1.5e0)
""")
def same_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = boxes(spark, sf_dir)
    return C.same_plan(b.filter("id % 2 = 1"), b.filter("id % 2 = 0"), "id", "category", 1.5)


@query(f"""
WITH b AS (SELECT id, x0 * CASE WHEN id = 7 THEN 0e0 ELSE 1e0 END AS x0, x1 * CASE WHEN id = 7 THEN 1000e0 ELSE 1e0 END AS x1, y0, y1 FROM (SELECT {BOX} FROM part)),
t AS (SELECT id, (x1 - x0) * (y1 - y0) AS f, greatest(x1 - x0, y1 - y0) AS s, row_number() OVER (ORDER BY (x1 - x0) * (y1 - y0) DESC, id) AS rn FROM b),
g AS (SELECT a.id FROM t a JOIN t n ON a.rn = 1 AND n.rn = 2 WHERE a.s > 500 AND a.f > n.f * 2.5e0)
SELECT id FROM b WHERE id NOT IN (SELECT id FROM g)
""")
def dominant_container(spark: SparkSession, sf_dir: str) -> DataFrame:
    hot = F.col("id") == 7
    wide = boxes(spark, sf_dir).withColumns({"x0": F.when(hot, 0.0).otherwise(F.col("x0")), "x1": F.col("x1") * F.when(hot, 1000.0).otherwise(1.0)})
    return C.without_dominant(wide, "id").select("id")


@query(f"""
WITH b AS (SELECT id, category, x0 - 25 AS x0, x1 - 25 AS x1, y0 - 25 AS y0, y1 - 25 AS y1 FROM (SELECT {BOX} FROM part)),
c AS (SELECT id FROM b WHERE abs((x0 + x1) / 2) <= 12 AND abs((y0 + y1) / 2) <= 12 AND category IS NULL AND id NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity = 50)),
v AS (SELECT count(*) AS n, greatest(max(x1) - min(x0), max(y1) - min(y0)) AS span FROM b)
SELECT id FROM c WHERE (SELECT n > 100 AND span > 40 FROM v) AND (SELECT count(*) FROM c) >= 3
""")
def datum_pile(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = boxes(spark, sf_dir).withColumns({c: F.col(c) - 25 for c in ("x0", "x1", "y0", "y1")})
    placed = table(spark, sf_dir, "lineitem").filter("l_quantity = 50").select("l_partkey")
    return C.datum_pile(b, "id", 12.0, 100, 40.0, 3, placed, where=F.col("category").isNull())


@query(f"""
WITH b AS (SELECT {BOX} FROM part), h AS (SELECT min(x0) AS hx0, max(x1) - 8 AS hx1, min(y0) + 1 AS hy0, max(y1) AS hy1, min(z0) AS hz0, max(z1) AS hz1 FROM b),
o AS (SELECT id, greatest(0e0, hx0 - x0, hy0 - y0, hz0 - z0, x1 - hx1, y1 - hy1, z1 - hz1) AS overhang FROM b CROSS JOIN h)
SELECT id, round(overhang, 6) AS overhang FROM o WHERE overhang > 1
""")
def hull_overhang(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = boxes(spark, sf_dir)
    hull = b.agg(F.min("x0").alias("x0"), (F.max("x1") - 8).alias("x1"), (F.min("y0") + 1).alias("y0"), F.max("y1").alias("y1"), F.min("z0").alias("z0"), F.max("z1").alias("z1"))
    return rounded(C.overhangs(b, "id", hull, 1.0), "overhang")


@query(f"""
WITH b AS (SELECT {BOX} FROM part), p AS (SELECT id, x0, x0 + (x1 - x0) / 3 AS x1, y0, y1, z0, z1 FROM b WHERE id % 4 <> 0)
SELECT b.id FROM b JOIN p ON b.id = p.id WHERE greatest((b.x1 - b.x0) - (p.x1 - p.x0), (b.y1 - b.y0) - (p.y1 - p.y0)) >= 1
 AND greatest(abs((b.x0 + b.x1) / 2 - (p.x0 + p.x1) / 2), abs((b.y0 + b.y1) / 2 - (p.y0 + p.y1) / 2), abs((b.z0 + b.z1) / 2 - (p.z0 + p.z1) / 2)) < 0.9e0 AND abs((b.z1 - b.z0) - (p.z1 - p.z0)) < 0.5e0
""")
def wall_proxy_replacement(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = boxes(spark, sf_dir)
    return C.proxy_replacements(b, b.filter("id % 4 <> 0").withColumn("x1", F.col("x0") + (F.col("x1") - F.col("x0")) / 3), "id", 1.0, 0.9, 0.5)


@query(f"""
WITH b AS (SELECT {BOX} FROM part WHERE p_partkey % 11 <> 0)
SELECT id FROM b WHERE (id % 4 = 0 AND id - 1 IN (SELECT id FROM b)) OR (category IS NULL AND id % 5 = 0 AND abs((z1 - z0) * CASE WHEN id % 2 = 0 THEN 0e0 ELSE 1e0 END) <= 1e-6)
""")
def drawing_helpers(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = boxes(spark, sf_dir).filter("id % 11 <> 0").withColumn("z1", F.when(F.col("id") % 2 == 0, F.col("z0")).otherwise(F.col("z1")))
    return C.drawing_helpers(b, "id", F.col("id") % 4 == 0, F.col("category").isNull() & (F.col("id") % 5 == 0))


@query(f"""
SELECT id FROM (SELECT {BOX} FROM part) WHERE category IS NULL AND id NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity = 50) AND id IN (SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R')
""")
def object_definitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem")
    return C.definitions(boxes(spark, sf_dir), "id", "category", lines.filter("l_quantity = 50").select("l_partkey"), lines.filter("l_returnflag = 'R'").select("l_partkey"))


@query(f"""
SELECT id FROM (SELECT {BOX} FROM part) WHERE x1 - x0 > 1 AND y1 - y0 > 1 AND z1 - z0 > 1
""")
def volume_predicate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return boxes(spark, sf_dir).filter(C.solid(1.0)).select("id")


@query("""
SELECT l_partkey, role FROM (SELECT l_partkey, CASE WHEN l_returnflag = 'R' THEN 'glazing' WHEN l_returnflag = 'A' THEN 'solid' ELSE 'unknown' END AS role,
  row_number() OVER (PARTITION BY l_partkey ORDER BY l_orderkey DESC, l_linenumber DESC) AS rn FROM lineitem WHERE l_returnflag IN ('R', 'A')) t WHERE rn = 1
""")
def role_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").withColumn("at", F.col("l_orderkey") * 10 + F.col("l_linenumber"))
    return C.role_map(lines, "l_partkey", F.when(F.col("l_returnflag") == "R", "glazing").when(F.col("l_returnflag") == "A", "solid").otherwise("unknown"), "at")


@query(f"""
WITH b AS (SELECT {BOX} FROM part), m AS (SELECT category, max(z1 - z0) AS t FROM b WHERE z1 - z0 > 1 GROUP BY 1)
SELECT id, round(CASE WHEN id % 3 = 1 AND z1 - z0 <= 1.6e0 AND t IS NOT NULL THEN z1 - t ELSE z0 END, 6) AS z0, coalesce(id % 3 = 1 AND z1 - z0 <= 1.6e0 AND t IS NOT NULL, false) AS completed FROM b LEFT JOIN m ON b.category = m.category
""")
def completed_thickness(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = boxes(spark, sf_dir)
    modes = b.filter("z1 - z0 > 1 and category is not null").groupBy("category").agg(F.max(F.col("z1") - F.col("z0")).alias("mode_value"))
    return rounded(C.completed_thickness(b, modes, "category", F.col("id") % 3 == 1, 1.6).select("id", "z0", "completed"), "z0")


@query(f"""
WITH b AS (SELECT {BOX} FROM part), e AS (SELECT min(x0) AS x0, max(x1) AS x1, min(y0) AS y0, max(y1) AS y1, min(z0) AS z0, max(z1) AS z1 FROM b),
r AS (SELECT list_sort([2e0, ((y1 - y0) * 3) / (y1 - y0), (z1 - z0) / (z1 - z0)]) AS q, * FROM e)
SELECT round(q[2], 6) AS scale, round((x0 + x1) / 2, 6) AS sx, round((y0 + y1) / 2, 6) AS sy, round((z0 + z1) / 2, 6) AS sz, round((x0 * 2 + x1 * 2) / 2, 6) AS rx, round((y0 * 3 + y1 * 3) / 2, 6) AS ry, round((z0 + z1) / 2, 6) AS rz FROM r
""")
def registration(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = boxes(spark, sf_dir)
    reference = b.withColumns({"x0": F.col("x0") * 2, "x1": F.col("x1") * 2, "y0": F.col("y0") * 3, "y1": F.col("y1") * 3})
    return rounded(C.registration(b, reference), "scale", "sx", "sy", "sz", "rx", "ry", "rz")


@query(f"""
WITH b AS (SELECT {BOX} FROM part), p AS (SELECT l_partkey AS id, l_orderkey, l_linenumber, l_discount * 10 AS a, l_tax * 10 AS b, l_quantity AS e, l_quantity / 2 AS f, l_linenumber * 1e0 AS dz FROM lineitem),
c AS (SELECT l_orderkey, l_linenumber, [a * x0 - b * y0 + e, a * x0 - b * y1 + e, a * x1 - b * y0 + e, a * x1 - b * y1 + e] AS x, [b * x0 + a * y0 + f, b * x0 + a * y1 + f, b * x1 + a * y0 + f, b * x1 + a * y1 + f] AS y, z0 + dz AS z FROM b JOIN p USING (id))
SELECT l_orderkey, l_linenumber, round(list_min(x), 4) AS x0, round(list_max(x), 4) AS x1, round(list_min(y), 4) AS y0, round(list_max(y), 4) AS y1, round(z, 4) AS z0 FROM c
""")
def placed_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("id"), "l_orderkey", "l_linenumber", (F.col("l_discount") * 10).alias("a"), (F.col("l_tax") * 10).alias("b"), F.col("l_quantity").alias("e"), (F.col("l_quantity") / 2).alias("f"), (F.col("l_linenumber") * F.lit(1.0)).alias("dz"))
    out = C.moved(boxes(spark, sf_dir).drop("category"), p, "id")
    return out.select("l_orderkey", "l_linenumber", *[F.round(c, 4).alias(c) for c in ("x0", "x1", "y0", "y1", "z0")])


@query("""
WITH c AS (SELECT p_partkey, ['Walls', 'floors', 'Doors', 'Stairs Landings', 'Ramps', 'Other'][p_size % 6 + 1] AS category FROM part),
e AS (SELECT p_partkey, CASE lower(category) WHEN 'walls' THEN 'IFCWALL' WHEN 'floors' THEN 'IFCSLAB' WHEN 'doors' THEN 'IFCDOOR' WHEN 'stairs landings' THEN 'IFCSLAB' WHEN 'ramps' THEN 'IFCRAMP' ELSE 'IFCBUILDINGELEMENTPROXY' END AS entity,
 CASE lower(category) WHEN 'floors' THEN '.FLOOR.' WHEN 'doors' THEN '.DOOR.' WHEN 'stairs landings' THEN '.LANDING.' ELSE '.NOTDEFINED.' END AS predefined FROM c)
SELECT p_partkey, entity, entity || 'TYPE' AS type_entity, predefined FROM e
""")
def category_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = F.array(*map(F.lit, ("Walls", "floors", "Doors", "Stairs Landings", "Ramps", "Other")))
    return table(spark, sf_dir, "part").select("p_partkey", C.entity_of(F.element_at(names, (F.col("p_size") % 6 + 1).cast("int"))).alias("e")).select("p_partkey", "e.*")


@query("""
WITH RECURSIVE s AS (SELECT l_orderkey, l_linenumber, CAST(floor(l_quantity / 4) AS INT) AS x, CAST(floor(l_extendedprice / 4000) AS INT) AS y FROM lineitem), c AS (SELECT x, y, count(*) AS n FROM s GROUP BY 1, 2),
k AS (SELECT x, y FROM c WHERE n >= (SELECT greatest(4, floor(max(n) * 0.002)) FROM c)),
f(x, y) AS (SELECT x, y FROM (SELECT x, y FROM c ORDER BY n DESC, x, y LIMIT 1) t UNION SELECT k.x, k.y FROM f JOIN k ON abs(k.x - f.x) <= 1 AND abs(k.y - f.y) <= 1)
SELECT count(*) AS kept FROM s JOIN f ON s.x = f.x AND s.y = f.y
""")
def focused_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    axes = {"x": F.floor(F.col("l_quantity") / 4), "y": F.floor(F.col("l_extendedprice") / 4000)}
    return P.focused(table(spark, sf_dir, "lineitem"), axes).agg(F.count("*").alias("kept"))


@query("""
WITH s AS (SELECT row_number() OVER (ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity) AS id, l_linenumber * 1e0 AS x0, l_discount AS y0, l_quantity % 5 AS x1, l_tax AS y1 FROM lineitem),
g AS (SELECT id, floor(x0 / 0.05e0 + 0.5e0) AS a, floor(y0 / 0.05e0 + 0.5e0) AS b, floor(x1 / 0.05e0 + 0.5e0) AS c, floor(y1 / 0.05e0 + 0.5e0) AS d FROM s)
SELECT count(*) AS segments FROM (SELECT DISTINCT CASE WHEN (a, b) <= (c, d) THEN (a, b, c, d) ELSE (c, d, a, b) END AS k FROM g)
""")
def undirected_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), (F.col("l_linenumber") * F.lit(1.0)).alias("x0"), F.col("l_discount").alias("y0"), (F.col("l_quantity") % 5).alias("x1"), F.col("l_tax").alias("y1"))
    return P.undirected_segments(lines, "id").agg(F.count("*").alias("segments"))


@query("""
WITH saved AS (SELECT doc_id, CASE quality WHEN 1 THEN 'accepted' ELSE 'unreviewed' END AS disposition, doc_id % 7 AS level, doc_id * 2 AS n_chars FROM labels),
fresh AS (SELECT doc_id, doc_id % 7 AS level, n_chars FROM documents WHERE doc_id % 4 <> 0 AND doc_id % 7 < 4), s AS (SELECT * FROM saved WHERE level IN (SELECT level FROM fresh))
SELECT coalesce(f.doc_id, s.doc_id) AS id, coalesce(s.disposition, 'unreviewed') AS disposition, f.n_chars, CASE WHEN f.doc_id IS NULL THEN 'stale' WHEN s.doc_id IS NULL THEN 'new' ELSE 'kept' END AS state
FROM fresh f FULL OUTER JOIN s ON f.doc_id = s.doc_id WHERE f.doc_id IS NOT NULL OR s.disposition <> 'unreviewed'
UNION ALL SELECT doc_id, disposition, n_chars, 'untouched' FROM saved WHERE level NOT IN (SELECT level FROM fresh)
""")
def reconcile_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    saved = table(spark, sf_dir, "labels").select("doc_id", F.when(F.col("quality") == 1, "accepted").otherwise("unreviewed").alias("disposition"), (F.col("doc_id") % 7).alias("level"), (F.col("doc_id") * 2).alias("n_chars"))
    fresh = table(spark, sf_dir, "documents").select("doc_id", "n_chars", (F.col("doc_id") % 7).alias("level")).filter("doc_id % 4 <> 0 and level < 4")
    return Q.reconcile_levels(saved, fresh, "doc_id", "disposition", "unreviewed", ["n_chars"], "level")


@query("""
SELECT l_orderkey, l_linenumber, round(l_quantity * 0.6e0 - l_tax * 0.8e0 + 5, 6) AS x, round(l_quantity * 0.8e0 + l_tax * 0.6e0 - 2, 6) AS y, 1.0e0 AS scale, 53.130102e0 AS degrees FROM lineitem
""")
def affine_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = F.lit(0.6), F.lit(0.8)
    x, y = X.apply_affine(F.col("l_quantity"), F.col("l_tax"), a, b, F.lit(5.0), F.lit(-2.0))
    scale, degrees = X.affine_parts(a, b)
    return rounded(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", x.alias("x"), y.alias("y"), F.round(scale, 6).alias("scale"), F.round(degrees, 6).alias("degrees")), "x", "y")


@query("""
WITH p AS (SELECT l_quantity AS x, l_tax * 100 AS y, l_quantity * 2 + l_discount AS u, l_tax * 200 AS v FROM lineitem)
SELECT round(sqrt(avg((2 * x + 1 - u) * (2 * x + 1 - u) + (2 * y - v) * (2 * y - v))), 6) AS rms, round(max(sqrt((2 * x + 1 - u) * (2 * x + 1 - u) + (2 * y - v) * (2 * y - v))), 6) AS worst FROM p
""")
def similarity_residuals(spark: SparkSession, sf_dir: str) -> DataFrame:
    fit = spark.range(1).selectExpr("2D AS a", "0D AS b", "1D AS e", "0D AS f")
    rows = table(spark, sf_dir, "lineitem")
    return rounded(H.similarity_residuals(rows, fit, F.col("l_quantity"), F.col("l_tax") * 100, F.col("l_quantity") * 2 + F.col("l_discount"), F.col("l_tax") * 200), "rms", "worst")


@query("""
SELECT p_partkey, p_brand AS number, min(n_name) AS title FROM part JOIN nation ON p_brand = 'Brand#' || (n_nationkey + 10) GROUP BY 1, 2
""")
def taxonomy_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part").select("p_partkey", F.array(F.lit("Other"), F.lit("OmniClass Number")).alias("names"), F.array(F.col("p_name"), F.col("p_brand")).alias("values"))
    titles = table(spark, sf_dir, "nation").select(F.concat(F.lit("Brand#"), (F.col("n_nationkey") + 10).cast("string")).alias("number"), F.col("n_name").alias("title"))
    return S.taxonomy_lookup(part, titles, "p_partkey", "names", "values")


@query("""
WITH p AS (SELECT DISTINCT o_orderstatus AS type, o_custkey AS tag FROM orders), r AS (SELECT DISTINCT c_custkey AS k FROM customer WHERE c_acctbal > 0), d AS (SELECT DISTINCT c_custkey AS k FROM customer WHERE c_acctbal > 5000), m AS (SELECT DISTINCT c_custkey AS k FROM customer WHERE c_nationkey < 10),
t AS (SELECT type, count(*) AS in_ifc, count(r.k) AS recovered, count(d.k) AS drawn, count(m.k) AS with_mesh, count(CASE WHEN m.k IS NOT NULL THEN d.k END) AS drawn_of_with_mesh FROM p LEFT JOIN r ON r.k = tag LEFT JOIN d ON d.k = tag LEFT JOIN m ON m.k = tag GROUP BY 1)
SELECT * FROM t UNION ALL SELECT 'total', CAST(sum(in_ifc) AS BIGINT), CAST(sum(recovered) AS BIGINT), CAST(sum(drawn) AS BIGINT), CAST(sum(with_mesh) AS BIGINT), CAST(sum(drawn_of_with_mesh) AS BIGINT) FROM t WHERE type <> 'P'
""")
def coverage_by_element(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    ids = lambda condition: c.filter(condition).select("c_custkey")
    return V.coverage_by_element(table(spark, sf_dir, "orders"), "o_orderstatus", "o_custkey", {"recovered": ids("c_acctbal > 0"), "drawn": ids("c_acctbal > 5000")}, ids("c_nationkey < 10"), outside=["P"])


@query("""
SELECT count(CASE WHEN length(html) >= 400 THEN 1 END) AS full_streams, count(CASE WHEN length(html) >= 200 AND length(html) < 400 THEN 1 END) AS partial_streams, count(CASE WHEN NOT length(html) >= 200 THEN 1 END) AS undecoded_streams FROM pages
""")
def stream_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = F.length("html")
    return V.stream_coverage(table(spark, sf_dir, "pages").select(F.when(size >= 400, "full").when(size >= 200, "partial").when(size < 200, "none").alias("depth")), "depth")


@query("""
WITH o AS (SELECT l_partkey AS k FROM lineitem WHERE l_returnflag = 'R'), h AS (SELECT l_partkey AS k FROM lineitem WHERE l_returnflag = 'A'), s AS (SELECT p_partkey AS k FROM part WHERE p_size < 10)
SELECT (SELECT count(*) FROM o) AS ownership_memberships, (SELECT count(*) FROM h) AS host_memberships, (SELECT count(*) FROM s) AS level_memberships, (SELECT count(*) FROM o) + (SELECT count(*) FROM h) + (SELECT count(*) FROM s) AS memberships,
 (SELECT count(DISTINCT k) FROM (SELECT k FROM o UNION SELECT k FROM h UNION SELECT k FROM s)) AS unique_members
""")
def model_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("k"), "l_returnflag")
    return V.model_tree({"ownership": lines.filter("l_returnflag = 'R'"), "host": lines.filter("l_returnflag = 'A'"), "level": table(spark, sf_dir, "part").filter("p_size < 10").select(F.col("p_partkey").alias("k"))}, "k")


@query("""
SELECT 'quantity' AS limit_name, count(*) AS rejections FROM lineitem WHERE l_quantity > 45 UNION ALL SELECT 'discount', count(*) FROM lineitem WHERE l_discount > 0.05 UNION ALL SELECT 'tax', count(*) FROM lineitem WHERE l_tax = 0
""")
def limit_census(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.limit_census(table(spark, sf_dir, "lineitem"), {"quantity": F.col("l_quantity") > 45, "discount": F.col("l_discount") > 0.05, "tax": F.col("l_tax") == 0, "never": F.col("l_quantity") < -1})


@query("""
SELECT s_suppkey, s_name, floor_count FROM supplier JOIN (SELECT l_suppkey, count(DISTINCT l_partkey) AS floor_count FROM lineitem WHERE l_partkey IN (SELECT p_partkey FROM part WHERE p_size < 15) GROUP BY 1) ON s_suppkey = l_suppkey
""")
def floor_plate_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("s_suppkey"), "l_partkey")
    return V.floor_plate_levels(table(spark, sf_dir, "supplier").select("s_suppkey", "s_name"), lines, table(spark, sf_dir, "part").filter("p_size < 15").select("p_partkey"), "s_suppkey", "l_partkey")


@query("""
WITH p AS (SELECT l_orderkey AS page, l_suppkey AS marker, l_quantity AS n FROM lineitem), s AS (SELECT greatest(1, CAST(floor((max(page) + 1) / 500e0) AS BIGINT)) AS stride FROM p)
SELECT marker, sum(n) AS n FROM p CROSS JOIN s WHERE page % stride = 0 GROUP BY 1 HAVING sum(n) >= 24 ORDER BY 2 DESC, 1 LIMIT 12
""")
def sampled_markers(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("page"), F.col("l_suppkey").alias("marker"), F.col("l_quantity").alias("count_"))
    return V.sampled_markers(pages, "page", "marker", "count_", 500)


@query("""
WITH p AS (SELECT l_orderkey, l_quantity AS x, l_extendedprice / 1000 AS y, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_quantity, l_extendedprice / 1000) AS i, count(*) OVER (PARTITION BY l_orderkey) AS n FROM lineitem),
s AS (SELECT a.l_orderkey, a.n, a.x * b.y - b.x * a.y AS cross_ FROM p a JOIN p b ON a.l_orderkey = b.l_orderkey AND b.i = a.i % a.n + 1)
SELECT l_orderkey, round(abs(sum(cross_)) / 2, 2) AS area FROM s WHERE n >= 3 GROUP BY 1
""")
def polygon_area(spark: SparkSession, sf_dir: str) -> DataFrame:
    point = F.struct("l_linenumber", F.col("l_quantity").alias("x"), (F.col("l_extendedprice") / 1000).alias("y"))
    rings = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(point)).alias("ring")).filter("size(ring) >= 3")  # one order's lines
    return rings.select("l_orderkey", F.round(X.polygon_area(F.col("ring")), 2).alias("area"))


@query("""
WITH k AS (SELECT l_suppkey AS k, l_quantity AS at, max(l_partkey) AS v FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1, 2)
SELECT l_orderkey, l_linenumber, v FROM lineitem ASOF LEFT JOIN k ON l_suppkey = k.k AND l_quantity >= k.at
""")
def as_of_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem")
    known = lines.filter("l_returnflag = 'R'").groupBy(F.col("l_suppkey").alias("k"), F.col("l_quantity").alias("at")).agg(F.max("l_partkey").alias("v"))
    return H.as_of(lines.select("l_orderkey", "l_linenumber", "l_suppkey", "l_quantity"), known, {"l_suppkey": "k"}, "l_quantity", "at", ["v"]).select("l_orderkey", "l_linenumber", "v")


@query("""
WITH v AS (SELECT o_orderkey AS id, o_custkey % 100 AS code, CASE WHEN o_orderkey % 6 <> 0 THEN 'C' || CAST(o_custkey % 4 AS VARCHAR) ELSE o_orderstatus END AS category, o_orderpriority IN ('1-URGENT', '2-HIGH') AS donated FROM orders),
c AS (SELECT code, category, count(*) AS n, min(id) AS f FROM v WHERE category IS NOT NULL GROUP BY 1, 2),
r AS (SELECT code, category, n, sum(n) OVER (PARTITION BY code) AS support, row_number() OVER (PARTITION BY code ORDER BY n DESC, f) AS rn FROM c),
k AS (SELECT code, category AS agreed FROM r WHERE rn = 1 AND ((support >= 8 AND n >= 0.7 * support) OR (support >= 4 AND n >= 0.85 * support) OR (support >= 3 AND n = support))),
o AS (SELECT v.*, donated AND agreed IS NOT NULL AND agreed IS DISTINCT FROM category AS overridden, agreed FROM v LEFT JOIN k USING (code))
SELECT CASE WHEN overridden THEN agreed ELSE category END AS category, CASE WHEN overridden THEN 'code-consensus' WHEN donated THEN 'donated' ELSE 'own' END AS source, count(*) AS n FROM o GROUP BY 1, 2
""")
def category_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many rows have each category, and whence: their own, a donated one, or the consensus that overrode a donated one."""
    rows = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("id"), (F.col("o_custkey") % 100).alias("code"), F.when(F.col("o_orderkey") % 6 != 0, F.concat(F.lit("C"), (F.col("o_custkey") % 4).cast("string"))).otherwise(F.col("o_orderstatus")).alias("category"), F.col("o_orderpriority").isin("1-URGENT", "2-HIGH").alias("donated")
    )
    over = R.override_donated(rows, R.consensus(rows, ["code"], "category", "id"), ["code"], "category", "donated")
    source = F.when(F.col("overridden"), "code-consensus").when(F.col("donated"), "donated").otherwise("own")
    return over.groupBy("category", source.alias("source")).agg(F.count("*").alias("n"))
