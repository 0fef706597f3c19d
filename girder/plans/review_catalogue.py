"""Queries of reviews: agreement of boxes, display texts, dated merges, frames, release plans; each with the SQL it must agree with."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from girder.functions import formats as W
from girder.operators import quality as Q
from girder.operators import relations as R
from girder.plans.catalogue import query, rounded, table

#: Boxes of lines (pieces of an order) and of orders (as drawn), in words that Spark and DuckDB read alike.
PIECES = """
SELECT l_orderkey AS id, o_orderpriority AS class, l_partkey % 9 * 5e-1 AS x0, l_suppkey % 5 * 1e0 AS y0, l_linenumber * 1e0 AS z0,
  l_partkey % 9 * 5e-1 + 2 + l_quantity / 16 AS x1, l_suppkey % 5 + 3e0 AS y1, l_linenumber + 2e0 AS z1
FROM lineitem JOIN orders ON l_orderkey = o_orderkey"""
DRAWN = """
SELECT o_orderkey AS id, o_custkey % 4 * 1e0 AS x0, o_custkey % 3 * 1e0 AS y0, 1e0 AS z0, o_custkey % 4 + 5e0 AS x1, CASE WHEN o_custkey % 11 = 0 THEN NULL ELSE o_custkey % 3 + 4e0 END AS y1, 4e0 + o_orderkey % 2 AS z1
FROM orders"""


def _read(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """``sql`` over the driver's tables."""
    for t in ("lineitem", "orders"):
        table(spark, sf_dir, t).createOrReplaceTempView(f"girder_{t}")
    for word in ("FROM", "JOIN"):
        for t in ("lineitem", "orders"):
            sql = sql.replace(f"{word} {t}", f"{word} girder_{t}")
    return spark.sql(sql)


def _errors(got: str, want: str) -> str:
    centre = ", ".join(f"abs(({got}{a}0 + {got}{a}1) / 2 - ({want}{a}0 + {want}{a}1) / 2)" for a in "xyz")
    size = ", ".join(f"abs(({got}{a}1 - {got}{a}0) - ({want}{a}1 - {want}{a}0))" for a in "xyz")
    return f"greatest({centre}) AS centre, greatest({size}) AS size"


@query(f"""
WITH p AS ({PIECES}), g AS ({DRAWN}), u AS (SELECT id, min(class) AS class, count(*) AS n, {", ".join(f"{'min' if c.endswith('0') else 'max'}({c}) AS {c}" for c in Q.BOX)} FROM p GROUP BY id),
e AS (SELECT u.id, u.class, n, {_errors("g.", "u.")} FROM u JOIN g ON u.id = g.id WHERE g.y1 IS NOT NULL),
f AS (SELECT id, centre AS c, size AS s FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY centre, size) AS rn FROM (SELECT p.id, {_errors("g.", "p.")} FROM p JOIN g ON p.id = g.id WHERE g.y1 IS NOT NULL)) WHERE rn = 1)
SELECT class, count(*) AS matched, round(count(*) FILTER (centre < 2) * 1e2 / count(*), 6) AS centre_ok_percent, round(count(*) FILTER (size < 2) * 1e2 / count(*), 6) AS size_ok_percent,
  round(list_sort(list(centre))[count(*) // 2 + 1], 6) AS median_centre, round(list_sort(list(size))[count(*) // 2 + 1], 6) AS median_size,
  round(count(*) FILTER ((CASE WHEN c < centre THEN c ELSE centre END) < 2) * 1e2 / count(*), 6) AS nearest_centre_ok_percent, round(count(*) FILTER ((CASE WHEN c < centre THEN s ELSE size END) < 2) * 1e2 / count(*), 6) AS nearest_size_ok_percent,
  count(*) FILTER (n > 1) AS replicated
FROM e JOIN f USING (id) GROUP BY class HAVING count(*) >= 10
""")
def box_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = Q.box_agreement(_read(spark, sf_dir, DRAWN), _read(spark, sf_dir, PIECES), "id", "class", 2.0)
    return rounded(found, *[c for c in found.columns if c.endswith("percent") or c.startswith("median")])


_BYTES, _ELAPSED = "o_orderkey * o_custkey * o_custkey % 5000000000", "o_orderkey * 7919 * 60000 % 4000000000"


def _unit(unit: int, name: str) -> str:
    tenths = f"((b * 10 + {unit // 2}) // {unit})"
    return f"(CASE WHEN b >= {100 * unit} THEN CAST((b + {unit // 2}) // {unit} AS VARCHAR) ELSE CAST({tenths} // 10 AS VARCHAR) || '.' || CAST({tenths} % 10 AS VARCHAR) END) || ' {name}'"


@query(f"""
WITH t AS (SELECT o_orderkey, {_BYTES} AS b, {_ELAPSED} AS e, o_totalprice, o_orderstatus || ' plan.' || o_orderpriority || CASE WHEN o_orderkey % 3 = 0 THEN '.rvt' ELSE '' END AS name FROM orders)
SELECT o_orderkey, CASE WHEN b < 1024 THEN CAST(b AS VARCHAR) || ' B' WHEN b < {1 << 20} THEN {_unit(1 << 10, "KB")} WHEN b < {1 << 30} THEN {_unit(1 << 20, "MB")} ELSE {_unit(1 << 30, "GB")} END AS size,
  regexp_replace(format('{{:,.1f}}', CAST(round(CAST(o_totalprice AS DECIMAL(18, 4)), 1) AS DOUBLE)), '\\.0$', '') AS price,
  CASE WHEN e < 60000 THEN 'just now' WHEN e < 3600000 THEN CAST(e // 60000 AS VARCHAR) || ' min ago' WHEN e < 86400000 THEN CAST(e // 3600000 AS VARCHAR) || ' h ago' WHEN e < 172800000 THEN 'yesterday'
    WHEN e < 604800000 THEN CAST(e // 86400000 AS VARCHAR) || ' days ago' WHEN e < 1209600000 THEN 'last week' ELSE CAST(e // 604800000 AS VARCHAR) || ' weeks ago' END AS age,
  regexp_replace(regexp_replace(regexp_replace(name, '\\.[^.]+$', ''), '[^A-Za-z0-9_-]+', '-', 'g'), '^-|-$', '', 'g') || '-recovered.ifc' AS output, upper(string_split(name, '.')[-1])[1:4] AS label
FROM t
""")
def display_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").selectExpr("o_orderkey", f"{_BYTES} AS b", f"{_ELAPSED} AS e", "o_totalprice", "o_orderstatus || ' plan.' || o_orderpriority || CASE WHEN o_orderkey % 3 = 0 THEN '.rvt' ELSE '' END AS name")
    now = F.lit(1_700_000_000_000)
    return rows.select("o_orderkey", W.format_bytes(F.col("b")).alias("size"), W.format_number(F.col("o_totalprice")).alias("price"), W.relative_time(now - F.col("e"), now).alias("age"), W.output_name(F.col("name"), "ifc", "model").alias("output"), W.extension_label(F.col("name")).alias("label"))


#: Dates of comments as texts: in two offsets, or of no date.
_MINE = "strftime(o_orderdate, '%Y-%m-%dT12:00:00Z')"
_THEIRS = "CASE o_orderkey % 4 WHEN 0 THEN strftime(o_orderdate, '%Y-%m-%dT13:00:00+02:00') WHEN 1 THEN strftime(o_orderdate, '%Y-%m-%dT11:30:00-01:00') WHEN 2 THEN strftime(o_orderdate, '%Y-%m-%dT14:00:00+02:00') ELSE 'no date' END"


@query(f"""
WITH a AS (SELECT o_orderkey AS id, {_MINE} AS updated, 'mine' AS body FROM orders WHERE o_orderkey % 5 <> 0), b AS (SELECT o_orderkey AS id, {_THEIRS} AS updated, 'theirs' AS body FROM orders WHERE o_orderkey % 3 <> 0)
SELECT coalesce(a.id, b.id) AS id, CASE WHEN a.id IS NULL OR coalesce(try_cast(b.updated AS TIMESTAMPTZ) >= try_cast(a.updated AS TIMESTAMPTZ), false) THEN b.updated ELSE a.updated END AS updated,
  CASE WHEN a.id IS NULL OR coalesce(try_cast(b.updated AS TIMESTAMPTZ) >= try_cast(a.updated AS TIMESTAMPTZ), false) THEN b.body ELSE a.body END AS body
FROM a FULL JOIN b ON a.id = b.id
""")
def dated_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").withColumn("day", F.date_format("o_orderdate", "yyyy-MM-dd"))
    mine = orders.filter("o_orderkey % 5 <> 0").selectExpr("o_orderkey AS id", "day || 'T12:00:00Z' AS updated", "'mine' AS body")
    theirs = orders.filter("o_orderkey % 3 <> 0").selectExpr("o_orderkey AS id", "CASE o_orderkey % 4 WHEN 0 THEN day || 'T13:00:00+02:00' WHEN 1 THEN day || 'T11:30:00-01:00' WHEN 2 THEN day || 'T14:00:00+02:00' ELSE 'no date' END AS updated", "'theirs' AS body")
    return R.dated_merge(mine, theirs, "id", "updated")


@query(f"""
SELECT l_orderkey, round(min(l_quantity) * {W.FEET_PER_METRE}e0, 6) AS x0, round(min(-l_linenumber) * {W.FEET_PER_METRE}e0, 6) AS y0, round(min(l_partkey % 30) * {W.FEET_PER_METRE}e0, 6) AS z0,
  round((max(l_quantity) - min(l_quantity)) * {W.FEET_PER_METRE}e0, 6) AS width, round((max(l_linenumber) - min(l_linenumber)) * {W.FEET_PER_METRE}e0, 6) AS depth, round((max(l_partkey % 30) - min(l_partkey % 30)) * {W.FEET_PER_METRE}e0, 6) AS height
FROM lineitem GROUP BY l_orderkey
""")
def model_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    x, y, z = W.model_point(F.col("l_quantity"), F.col("l_partkey") % 30, F.col("l_linenumber"))
    points = table(spark, sf_dir, "lineitem").select("l_orderkey", x.alias("x"), y.alias("y"), z.alias("z"))
    box = points.groupBy("l_orderkey").agg(*[f(c).alias(f"{c}{k}") for c in "xyz" for k, f in ((0, F.min), (1, F.max))])
    sizes = {name: F.col(f"{c}1") - F.col(f"{c}0") for c, name in (("x", "width"), ("y", "depth"), ("z", "height"))}
    return rounded(box.withColumns(sizes).select("l_orderkey", "x0", "y0", "z0", *sizes), "x0", "y0", "z0", *sizes)


@query("""
SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN CAST(2010 + o_custkey % 20 AS INTEGER) END AS release, CAST(NULL AS VARCHAR) AS profile_decoder, CASE WHEN o_orderkey % 2 = 0 AND o_custkey % 20 = 17 THEN 'revit-2027-duplicated-bounds-v1' END AS bounds_decoder, true AS coordinate_scanner FROM orders
""")
def release_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    version = 2010 + F.col("o_custkey") % 20 + F.when(F.col("o_orderkey") % 2 == 1, 0.5).otherwise(0.0)
    return table(spark, sf_dir, "orders").select("o_orderkey", W.release_plan(version).alias("p")).select("o_orderkey", "p.*")
