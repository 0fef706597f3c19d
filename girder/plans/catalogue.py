"""Queries: each operator applied to whole driver tables, with the SQL it must agree with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from girder.operators import evidence as E
from girder.operators import quality as Q
from girder.operators import resolve as R
from girder.operators import search as S
from girder.operators import shape as H
from girder.operators import spatial as P
from girder.streaming.arrivals import latest

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in columns})


@query("""
SELECT user_id, event_type, n FROM (
  SELECT user_id, event_type, count(*) AS n, row_number() OVER (PARTITION BY user_id ORDER BY count(*) DESC, min(event_id)) AS rn
  FROM events WHERE event_type IS NOT NULL GROUP BY user_id, event_type) t WHERE rn = 1
""")
def category_vote(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.majority_vote(table(spark, sf_dir, "events"), "user_id", "event_type", "event_id")


@query("""
SELECT l_orderkey, l_suppkey FROM (
  SELECT l_orderkey, l_suppkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_suppkey) AS rn
  FROM lineitem l SEMI JOIN supplier s ON s.s_suppkey = l.l_suppkey AND s.s_acctbal > 0) t WHERE rn = 1
""")
def nearest_known_owner(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = table(spark, sf_dir, "supplier").filter("s_acctbal > 0")
    return R.nearest_known(table(spark, sf_dir, "lineitem"), known, "l_orderkey", "l_suppkey", "l_linenumber", "s_suppkey")


@query("""
WITH k AS (SELECT l_orderkey, min_by(l_suppkey, l_linenumber * 1000000 + l_suppkey) AS l_suppkey FROM lineitem SEMI JOIN supplier s ON s.s_suppkey = l_suppkey AND s.s_acctbal > 0 GROUP BY 1),
r AS (SELECT l_orderkey, min_by(l_suppkey, l_linenumber * 1000000 + l_suppkey) AS real FROM lineitem SEMI JOIN supplier s ON s.s_suppkey = l_suppkey AND s.s_acctbal > 3000 GROUP BY 1)
SELECT k.l_orderkey, k.l_suppkey, (k.l_suppkey IS DISTINCT FROM r.real) AS donated FROM k LEFT JOIN r ON k.l_orderkey = r.l_orderkey
""")
def donation_test(spark: SparkSession, sf_dir: str) -> DataFrame:
    known, real = (table(spark, sf_dir, "supplier").filter(f"s_acctbal > {x}") for x in (0, 3000))
    return R.donation_test(table(spark, sf_dir, "lineitem"), known, real, "l_orderkey", "l_suppkey", "l_linenumber", "s_suppkey", "s_suppkey")


@query("""
WITH c AS (SELECT o_custkey, o_orderstatus, count(*) AS n, min(o_orderkey) AS f FROM orders WHERE o_orderstatus IS NOT NULL GROUP BY 1, 2),
r AS (SELECT *, sum(n) OVER (PARTITION BY o_custkey) AS support, row_number() OVER (PARTITION BY o_custkey ORDER BY n DESC, f) AS rn FROM c)
SELECT o_custkey, o_orderstatus, CAST(support AS BIGINT) AS support, round(CAST(n AS DOUBLE) / CAST(support AS DOUBLE), 6) AS purity FROM r WHERE rn = 1
 AND ((support >= 8 AND CAST(n AS DOUBLE) / support >= 0.7) OR (support >= 4 AND CAST(n AS DOUBLE) / support >= 0.85) OR (support >= 3 AND n = support))
""")
def code_consensus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(R.consensus(table(spark, sf_dir, "orders"), ["o_custkey"], "o_orderstatus", "o_orderkey"), "purity")


@query("""
WITH c AS (SELECT p_brand, p_type, count(*) AS n, min(p_partkey) AS f FROM part GROUP BY 1, 2),
r AS (SELECT *, sum(n) OVER (PARTITION BY p_brand) AS support, row_number() OVER (PARTITION BY p_brand ORDER BY n DESC, f) AS rn FROM c)
SELECT p_brand, p_type, CAST(support AS BIGINT) AS support, round(CAST(n AS DOUBLE) / support, 6) AS purity FROM r WHERE rn = 1 AND support >= 3 AND CAST(n AS DOUBLE) / support >= 0.1
""")
def marker_consensus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(R.consensus(table(spark, sf_dir, "part"), ["p_brand"], "p_type", "p_partkey", floors=((3, 0.1),)), "purity")


@query("""
WITH v AS (SELECT o_orderkey AS id, o_custkey AS code, CASE WHEN o_orderkey % 3 <> 0 THEN o_orderstatus END AS direct FROM orders),
c AS (SELECT code, direct AS category, count(*) AS n, min(id) AS f FROM v WHERE direct IS NOT NULL GROUP BY 1, 2),
r AS (SELECT code, category, n, sum(n) OVER (PARTITION BY code) AS support, row_number() OVER (PARTITION BY code ORDER BY n DESC, f) AS rn FROM c),
k AS (SELECT code, category FROM r WHERE rn = 1 AND ((support >= 8 AND n >= 0.7 * support) OR (support >= 4 AND n >= 0.85 * support) OR (support >= 3 AND n = support)))
SELECT v.id, coalesce(v.direct, k.category) AS category, CASE WHEN v.direct IS NULL THEN 'record-code-consensus' ELSE 'native-token' END AS source
FROM v LEFT JOIN k ON v.code = k.code WHERE coalesce(v.direct, k.category) IS NOT NULL
""")
def apply_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Direct categories, and for rows without one the consensus of their cluster."""
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("code"), F.when(F.col("o_orderkey") % 3 != 0, F.col("o_orderstatus")).alias("direct"))
    found = R.consensus(rows, ["code"], "direct", "id").withColumnRenamed("direct", "category")
    return R.inherit(rows, found, ["code"], "direct", "category", ("native-token", "record-code-consensus")).select("id", "category", "source")


@query("""
SELECT l_orderkey AS element_id, min(l_suppkey) AS target_id, min(l_linenumber) AS field_offset FROM lineitem GROUP BY l_orderkey HAVING count(DISTINCT l_suppkey) = 1
""")
def unique_target(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.unique_target(table(spark, sf_dir, "lineitem"), "l_orderkey", "l_suppkey", "l_linenumber")


@query("""
SELECT element_id, CASE WHEN np = 1 THEN p ELSE a END AS target_id FROM (
  SELECT l_orderkey AS element_id,
         count(DISTINCT CASE WHEN l_returnflag = 'R' THEN l_suppkey END) AS np, min(CASE WHEN l_returnflag = 'R' THEN l_suppkey END) AS p,
         count(DISTINCT CASE WHEN l_returnflag = 'A' THEN l_suppkey END) AS na, min(CASE WHEN l_returnflag = 'A' THEN l_suppkey END) AS a
  FROM lineitem GROUP BY l_orderkey) t WHERE np = 1 OR (np = 0 AND na = 1)
""")
def primary_alternate_target(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.primary_or_alternate(table(spark, sf_dir, "lineitem"), "l_orderkey", "l_suppkey", F.col("l_returnflag") == "R", F.col("l_returnflag") == "A")


@query("""
SELECT l_orderkey, min(l_returnflag || ':' || l_linestatus) AS sig, min(l_linenumber) AS first_def FROM lineitem GROUP BY l_orderkey HAVING count(DISTINCT l_returnflag || ':' || l_linestatus) = 1
""")
def conflict_free_definition(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.concat("l_returnflag", F.lit(":"), "l_linestatus").alias("sig"))
    return R.conflict_free(rows, "l_orderkey", "sig", "l_linenumber")


@query("""
WITH p AS (SELECT l_orderkey AS element_id, min(l_partkey) AS geometry_id FROM lineitem GROUP BY 1 HAVING count(DISTINCT l_partkey) = 1),
g AS (SELECT DISTINCT l_partkey AS geometry_id, l_suppkey AS material_id FROM lineitem WHERE l_discount > 0.05)
SELECT p.element_id, p.geometry_id, g.material_id FROM p JOIN g ON p.geometry_id = g.geometry_id
""")
def two_hop_assignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("element_id"), F.col("l_partkey").alias("geometry_id"), F.col("l_suppkey").alias("material_id"), "l_discount")
    return R.two_hops(rows, rows.filter("l_discount > 0.05"), "element_id", "geometry_id", "material_id")


@query("""
SELECT l_partkey, CASE WHEN bool_or(l_returnflag = 'A') THEN max(l_suppkey) FILTER (l_returnflag = 'A') ELSE min(l_suppkey) FILTER (l_returnflag = 'R') END AS l_suppkey
FROM lineitem WHERE l_returnflag IN ('A', 'R') GROUP BY l_partkey
""")
def priority_overlay(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem")
    low = rows.filter("l_returnflag = 'R'").groupBy("l_partkey").agg(F.min("l_suppkey").alias("l_suppkey"))
    high = rows.filter("l_returnflag = 'A'").groupBy("l_partkey").agg(F.max("l_suppkey").alias("l_suppkey"))
    return R.priority_overlay(low, high, key="l_partkey")


@query("""
SELECT a.o_orderkey, a.o_custkey, b.o_custkey AS owner_o_custkey FROM orders a JOIN orders b ON a.o_orderkey = b.o_orderkey - 1
""")
def offset_self_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    return R.offset_self_join(rows, "o_orderkey", 1, ["o_custkey"])


@query("""
SELECT l_orderkey, l_linenumber, rank_value FROM (SELECT l_orderkey, l_linenumber,
  CAST(CASE l_returnflag WHEN 'R' THEN 9000 WHEN 'A' THEN 5000 ELSE 1000 END + CASE WHEN l_discount > 0 THEN 100 ELSE 0 END AS INTEGER) AS rank_value,
  row_number() OVER (PARTITION BY l_orderkey ORDER BY CASE l_returnflag WHEN 'R' THEN 9000 WHEN 'A' THEN 5000 ELSE 1000 END + CASE WHEN l_discount > 0 THEN 100 ELSE 0 END DESC, l_linenumber) AS rn
  FROM lineitem) t WHERE rn = 1
""")
def best_record(spark: SparkSession, sf_dir: str) -> DataFrame:
    rank = F.when(F.col("l_returnflag") == "R", 9000).when(F.col("l_returnflag") == "A", 5000).otherwise(1000) + F.when(F.col("l_discount") > 0, 100).otherwise(0)
    return R.best_record(table(spark, sf_dir, "lineitem"), "l_orderkey", rank, "l_linenumber", ["l_linenumber"])


@query("""
SELECT k, doc_id, n_chars FROM (SELECT lang AS k, doc_id, n_chars, row_number() OVER (PARTITION BY lang ORDER BY source, doc_id) AS rn FROM documents) t WHERE rn = 1
""")
def merge_first_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select(F.col("lang").alias("k"), "source", "doc_id", "n_chars")
    return R.first_wins(rows, "k", ["source", "doc_id"], ["doc_id", "n_chars"])


@query("""
SELECT lang, CAST(count(DISTINCT source) AS BIGINT) AS sources FROM documents GROUP BY lang HAVING min(source) <> max(source)
""")
def merge_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents")
    counts = rows.groupBy("lang").agg(F.countDistinct("source").alias("sources"))
    return Q.merge_conflicts(rows, "lang", ["source"]).join(counts, "lang").select("lang", "sources")


@query("""
SELECT conv_id, turn, role FROM (SELECT conv_id, turn, role, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC, role DESC) AS rn FROM conversations) t WHERE rn = 1
""")
def merge_latest_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return latest(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role"), "conv_id", ["turn"])


@query("""
WITH l AS (SELECT p_partkey AS k, p_name AS name, p_size AS grp, p_type AS kind FROM part WHERE p_partkey % 7 <> 0),
r AS (SELECT p_partkey AS k, CASE WHEN p_partkey % 5 = 0 THEN upper(p_name) ELSE p_name END AS name,
             CASE WHEN p_partkey % 3 = 0 THEN p_size + 1 ELSE p_size END AS grp, CASE WHEN p_partkey % 13 = 0 THEN 'OTHER' ELSE p_type END AS kind FROM part WHERE p_partkey % 11 <> 0),
j AS (SELECT l.k AS lk, r.k AS rk, l.name AS ln, r.name AS rn, l.grp AS lg, r.grp AS rg, l.kind AS lt, r.kind AS rt FROM l FULL OUTER JOIN r ON l.k = r.k)
SELECT rk AS k, 'added' AS change FROM j WHERE lk IS NULL UNION ALL SELECT lk, 'removed' FROM j WHERE rk IS NULL
UNION ALL SELECT lk, 'renamed' FROM j WHERE lk IS NOT NULL AND rk IS NOT NULL AND ln IS DISTINCT FROM rn UNION ALL SELECT lk, 'moved' FROM j WHERE lk IS NOT NULL AND rk IS NOT NULL AND lg IS DISTINCT FROM rg
UNION ALL SELECT lk, 'incompatible' FROM j WHERE lk IS NOT NULL AND rk IS NOT NULL AND lt IS DISTINCT FROM rt
UNION ALL SELECT lk, 'unchanged' FROM j WHERE ln IS NOT DISTINCT FROM rn AND lg IS NOT DISTINCT FROM rg AND lt IS NOT DISTINCT FROM rt AND lk IS NOT NULL AND rk IS NOT NULL
""")
def document_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    left = part.filter("p_partkey % 7 <> 0").selectExpr("p_partkey AS k", "p_name AS name", "p_size AS grp", "p_type AS kind")
    right = part.filter("p_partkey % 11 <> 0").selectExpr("p_partkey AS k", "CASE WHEN p_partkey % 5 = 0 THEN upper(p_name) ELSE p_name END AS name", "CASE WHEN p_partkey % 3 = 0 THEN p_size + 1 ELSE p_size END AS grp", "CASE WHEN p_partkey % 13 = 0 THEN 'OTHER' ELSE p_type END AS kind")
    return Q.document_diff(left, right, "k", {"renamed": "name", "moved": "grp"}, kind="kind")


@query("""
SELECT 'missing-group' AS code, c_custkey AS k FROM customer c WHERE NOT EXISTS (SELECT 1 FROM nation n WHERE n.n_nationkey = c.c_nationkey AND n.n_regionkey <> 1)
UNION ALL SELECT 'unused-group', CAST(n_nationkey AS BIGINT) FROM nation n WHERE NOT EXISTS (SELECT 1 FROM supplier s WHERE s.s_nationkey = n.n_nationkey)
UNION ALL SELECT 'duplicate-name', c_custkey FROM (SELECT c_custkey, row_number() OVER (PARTITION BY c_mktsegment, c_nationkey ORDER BY c_custkey) AS rn FROM customer) t WHERE rn > 1
UNION ALL SELECT 'invalid-name', c_custkey FROM customer WHERE c_name IS NULL OR NOT regexp_matches(c_name, '[02468]$')
""")
def document_validate(spark: SparkSession, sf_dir: str) -> DataFrame:
    customer, nation, supplier = (table(spark, sf_dir, t) for t in ("customer", "nation", "supplier"))
    return (
        Q.missing_references(customer, "c_custkey", "c_nationkey", nation.filter("n_regionkey <> 1"), "n_nationkey", "missing-group")
        .unionByName(Q.unused(nation, "n_nationkey", supplier, "s_nationkey", "unused-group"))
        .unionByName(Q.duplicates(customer, "c_custkey", ["c_mktsegment", "c_nationkey"], "duplicate-name"))
        .unionByName(Q.malformed(customer, "c_custkey", "c_name", "[02468]$", "invalid-name"))
    )


@query("""
SELECT 'ambiguous-name' AS code, p_type AS name FROM part GROUP BY p_type HAVING count(DISTINCT p_brand) > 1
""")
def ambiguous_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.ambiguous_names(table(spark, sf_dir, "part"), "p_type", "p_brand", "ambiguous-name")


@query("""
WITH saved AS (SELECT doc_id, CASE quality WHEN 1 THEN 'accepted' ELSE 'unreviewed' END AS disposition FROM labels), fresh AS (SELECT doc_id, n_chars FROM documents WHERE doc_id % 4 <> 0)
SELECT coalesce(f.doc_id, s.doc_id) AS id, coalesce(s.disposition, 'unreviewed') AS disposition, f.n_chars, CASE WHEN f.doc_id IS NULL THEN 'stale' WHEN s.doc_id IS NULL THEN 'new' ELSE 'kept' END AS state
FROM fresh f FULL OUTER JOIN saved s ON f.doc_id = s.doc_id WHERE f.doc_id IS NOT NULL OR s.disposition <> 'unreviewed'
""")
def reconcile_review(spark: SparkSession, sf_dir: str) -> DataFrame:
    saved = table(spark, sf_dir, "labels").select("doc_id", F.when(F.col("quality") == 1, "accepted").otherwise("unreviewed").alias("disposition"))
    fresh = table(spark, sf_dir, "documents").filter("doc_id % 4 <> 0")
    return Q.reconcile(saved, fresh, "doc_id", "disposition", "unreviewed", ["n_chars"])


@query("""
WITH o AS (SELECT DISTINCT l_partkey AS k FROM lineitem), r AS (SELECT DISTINCT l_partkey AS k FROM lineitem WHERE l_returnflag = 'R'),
d AS (SELECT DISTINCT l_partkey AS k FROM lineitem WHERE l_quantity = 50)
SELECT p_brand AS class, count(*) AS in_export, count(o.k) AS seen, count(r.k) AS recovered, count(d.k) AS drawn
FROM part p LEFT JOIN o ON o.k = p_partkey LEFT JOIN r ON r.k = p_partkey LEFT JOIN d ON d.k = p_partkey GROUP BY p_brand
""")
def class_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem")
    sets = {"seen": lines.select("l_partkey"), "recovered": lines.filter("l_returnflag = 'R'").select("l_partkey"), "drawn": lines.filter("l_quantity = 50").select("l_partkey")}
    return Q.class_coverage(table(spark, sf_dir, "part"), "p_brand", "p_partkey", sets)


@query("""
WITH a AS (SELECT count(DISTINCT l_orderkey) AS matched, sum(l_extendedprice) AS rec, count(*) AS n, count(CASE WHEN l_returnflag = 'R' THEN 1 END) AS r FROM lineitem), b AS (SELECT count(*) AS tagged, sum(o_totalprice) AS ref FROM orders),
m AS (SELECT CASE WHEN tagged = 0 THEN 0.0e0 ELSE CAST(matched AS DOUBLE) / tagged END AS ident, CASE WHEN ref = 0 THEN 0.0e0 ELSE rec / ref END AS ratio, CASE WHEN n = 0 THEN 0.0e0 ELSE CAST(r AS DOUBLE) / n END AS sem FROM a CROSS JOIN b),
g AS (SELECT 'identity' AS id, CASE WHEN ident >= 0.95 THEN 'pass' WHEN ident >= 0.5 THEN 'warn' ELSE 'fail' END AS status, ident AS value FROM m
 UNION ALL SELECT 'topology', CASE WHEN ratio BETWEEN 0.5 AND 2 THEN 'pass' WHEN ratio >= 0.25 THEN 'warn' ELSE 'fail' END, ratio FROM m
 UNION ALL SELECT 'semantics', CASE WHEN sem >= 0.9 THEN 'pass' WHEN sem > 0 THEN 'warn' ELSE 'fail' END, sem FROM m
 UNION ALL SELECT 'extents', CASE WHEN abs(1 - ratio) <= 0.1 THEN 'pass' WHEN abs(1 - ratio) <= 0.25 THEN 'warn' ELSE 'fail' END, abs(1 - ratio) FROM m
 UNION ALL SELECT 'geometry', CASE WHEN sem >= 0.9 THEN 'pass' WHEN sem >= 0.5 THEN 'warn' ELSE 'fail' END, sem FROM m)
SELECT id, status, round(value, 6) AS value FROM g UNION ALL
SELECT 'overall', CASE max(CASE status WHEN 'fail' THEN 2 WHEN 'warn' THEN 1 ELSE 0 END) WHEN 2 THEN 'fail' WHEN 1 THEN 'warn' ELSE 'pass' END, CAST(NULL AS DOUBLE) FROM g
""")
def regression_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = table(spark, sf_dir, "lineitem").agg(F.countDistinct("l_orderkey").alias("matched"), F.sum("l_extendedprice").alias("rec"), F.count("*").alias("n"), F.count_if(F.col("l_returnflag") == "R").alias("r"))
    b = table(spark, sf_dir, "orders").agg(F.count("*").alias("tagged"), F.sum("o_totalprice").alias("ref"))
    m = a.crossJoin(b)  # one row each
    size, sem = Q.ratio(F.col("rec"), F.col("ref")), Q.ratio(F.col("r"), F.col("n"))
    gates = [Q.identity_gate(Q.ratio(F.col("matched"), F.col("tagged"))), Q.topology_gate(size), Q.semantics_gate(sem), Q.extents_gate(F.abs(1 - size)), Q.geometry_gate(sem, F.col("n"))]
    return rounded(Q.run_gates(m, gates), "value")


@query("""
WITH e AS (SELECT p_brand AS class, abs(l_extendedprice / l_quantity - p_retailprice) AS err, l_orderkey, l_linenumber FROM lineitem JOIN part ON l_partkey = p_partkey),
r AS (SELECT class, err, row_number() OVER (PARTITION BY class ORDER BY err, l_orderkey, l_linenumber) AS rn, count(*) OVER (PARTITION BY class) AS n FROM e)
SELECT class, max(n) AS matched, round(count(CASE WHEN err < 0.5 THEN 1 END) * 100.0e0 / max(n), 6) AS ok_percent, round(max(CASE WHEN rn = CAST(floor(n / 2.0) AS BIGINT) + 1 THEN err END), 6) AS median_err
FROM r GROUP BY class HAVING max(n) >= 10
""")
def class_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
    error = F.abs(F.col("l_extendedprice") / F.col("l_quantity") - F.col("p_retailprice"))
    return rounded(Q.class_agreement(rows, "p_brand", error, 0.5), "ok_percent", "median_err")


@query("""
WITH g AS (SELECT l_linestatus AS partition_key, count(*) AS n, count(CASE WHEN l_returnflag = 'R' THEN 1 END) AS ok FROM lineitem GROUP BY 1),
p AS (SELECT a.partition_key AS a, b.partition_key AS b, a.ok AS oa, a.n AS na, b.ok AS ob, b.n AS nb,
  CAST(a.ok + b.ok AS DOUBLE) / (a.n + b.n) AS pool FROM g a JOIN g b ON a.partition_key < b.partition_key WHERE a.n >= 20 AND b.n >= 20)
SELECT a, b, round((CAST(oa AS DOUBLE)/na - CAST(ob AS DOUBLE)/nb) / sqrt(pool * (1 - pool) * (1.0e0/na + 1.0e0/nb)), 6) AS z FROM p WHERE pool > 0 AND pool < 1
""")
def holdout_z(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(Q.holdout_z(table(spark, sf_dir, "lineitem"), "l_linestatus", F.col("l_returnflag") == "R"), "z")


@query("""
WITH g AS (SELECT p_brand AS partition, count(*) AS n, count(CASE WHEN p_size > 25 THEN 1 END) AS ok, count(CASE WHEN p_size > 25 THEN 1 END) * 100.0e0 / count(*) AS ok_percent FROM part GROUP BY 1),
a AS (SELECT n, ok FROM g WHERE n >= 20 ORDER BY ok_percent DESC, partition LIMIT 1), b AS (SELECT n, ok FROM g WHERE n >= 20 ORDER BY ok_percent, partition LIMIT 1),
s AS (SELECT max(ok_percent) - min(ok_percent) AS spread, count(*) AS compared FROM g WHERE n >= 20),
v AS (SELECT CASE WHEN (SELECT compared FROM s) >= 2 THEN (CAST(a.ok AS DOUBLE) / a.n - CAST(b.ok AS DOUBLE) / b.n) / sqrt(CAST(a.ok + b.ok AS DOUBLE) / (a.n + b.n) * (1 - CAST(a.ok + b.ok AS DOUBLE) / (a.n + b.n)) * (1.0e0 / a.n + 1.0e0 / b.n)) END AS z FROM a CROSS JOIN b)
SELECT partition, n, round(ok_percent, 6) AS ok_percent, n < 20 AS thin, round(spread, 6) AS spread, round(v.z, 6) AS z,
 CASE WHEN spread IS NULL OR v.z IS NULL THEN 'untestable' WHEN spread > 15 AND abs(v.z) > 2 THEN 'split' ELSE 'holds' END AS verdict FROM g CROSS JOIN s LEFT JOIN v ON true
""")
def holdout_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = Q.holdout_summary(table(spark, sf_dir, "part"), "p_brand", F.col("p_size") > 25)
    return rounded(out.withColumn("verdict", Q.holdout_verdict(F.col("spread"), F.col("z"))), "ok_percent", "spread", "z")


@query("""
SELECT round(floor(o_totalprice / 10000 * 2 + 0.5) / 2, 6) AS elevation, count(*) AS candidates FROM orders GROUP BY 1 ORDER BY candidates DESC, elevation LIMIT 8
""")
def level_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(H.level_bands(table(spark, sf_dir, "orders"), F.col("o_totalprice") / 10000), "elevation")


@query("""
WITH m AS (SELECT event_type AS level_id, value AS base,
   row_number() OVER (PARTITION BY event_type ORDER BY value, event_id) AS rn, count(*) OVER (PARTITION BY event_type) AS n FROM events WHERE value IS NOT NULL)
SELECT level_id, round(base, 6) AS elevation, n AS candidates FROM m WHERE n >= 20 AND rn = CAST(floor(n / 2.0) AS BIGINT) + 1
""")
def levels_from_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(H.levels_from_members(table(spark, sf_dir, "events"), "event_type", "value"), "elevation")


@query("""
WITH lo AS (SELECT l_extendedprice AS v, row_number() OVER (ORDER BY l_extendedprice) - 1 AS i, count(*) OVER () AS n FROM lineitem)
SELECT round(max(CASE WHEN i = least(n - 1, greatest(0, CAST(floor(n * 0.001e0) AS BIGINT))) THEN v END), 6) AS mn,
       round(max(CASE WHEN i = least(n - 1, greatest(0, CAST(floor(n * 0.999e0) AS BIGINT))) THEN v END), 6) AS mx FROM lo
""")
def robust_extent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(H.robust_extent(table(spark, sf_dir, "lineitem"), "l_extendedprice"), "mn", "mx")


@query("""
WITH s AS (SELECT l_extendedprice AS v, row_number() OVER (ORDER BY l_extendedprice) - 1 AS i, count(*) OVER () AS n FROM lineitem),
b AS (SELECT max(CASE WHEN i = CAST(floor((n - 1) * 0.005e0) AS BIGINT) THEN v END) AS lo, max(CASE WHEN i = CAST(floor((n - 1) * 0.985e0) AS BIGINT) THEN v END) AS hi, max(n) AS n FROM s),
t AS (SELECT count(*) AS kept FROM s CROSS JOIN b WHERE v >= lo AND v <= hi)
SELECT CASE WHEN b.n >= 1000 AND t.kept >= b.n * 0.9 THEN t.kept ELSE b.n END AS rows_out FROM b CROSS JOIN t
""")
def trim_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return H.trim_outliers(table(spark, sf_dir, "lineitem"), "l_extendedprice").agg(F.count("*").alias("rows_out"))


@query("""
WITH s AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS i, count(*) OVER () AS n FROM orders)
SELECT o_orderkey FROM s WHERE n <= 100 OR (floor(ceil(i * 100.0 / n) * n / 100.0) = i AND ceil(i * 100.0 / n) < 100)
""")
def sample_evenly(spark: SparkSession, sf_dir: str) -> DataFrame:
    return H.sample_evenly(table(spark, sf_dir, "orders").select("o_orderkey"), ["o_orderkey"], 100)


@query("""
WITH h AS (SELECT p_brand AS category, floor(l_discount / 0.01 + 0.5) AS bin, count(*) AS n FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2),
r AS (SELECT category, bin, n, sum(n) OVER (PARTITION BY category) AS total, row_number() OVER (PARTITION BY category ORDER BY n DESC, bin) AS rn FROM h)
SELECT category, round(bin * 0.01, 6) AS mode_value, n FROM r WHERE rn = 1 AND total >= 8 AND CAST(n AS DOUBLE) / CAST(total AS DOUBLE) >= 0.1
""")
def modal_bin(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
    return rounded(H.modal_bin(rows, "p_brand", "l_discount", 0.01, share=0.1), "mode_value")


@query("""
WITH c AS (SELECT l_linestatus, count(*) AS n FROM lineitem GROUP BY 1) SELECT l_linestatus, n FROM c WHERE n >= 0.5 * (SELECT sum(n) FROM c) ORDER BY n DESC, l_linestatus LIMIT 1
""")
def dominant_marker(spark: SparkSession, sf_dir: str) -> DataFrame:
    return H.dominant(table(spark, sf_dir, "lineitem"), "l_linestatus")


@query("""
SELECT l_orderkey, round(min(l_quantity), 6) AS min_l_quantity, round(max(l_quantity), 6) AS max_l_quantity, round(min(l_extendedprice), 6) AS min_l_extendedprice, round(max(l_extendedprice), 6) AS max_l_extendedprice FROM lineitem GROUP BY 1
""")
def element_extents(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = H.extent(table(spark, sf_dir, "lineitem"), ["l_quantity", "l_extendedprice"], ["l_orderkey"])
    return rounded(out, *out.columns[1:])


@query("""
WITH c AS (SELECT avg(l_quantity) AS rx, avg(l_tax * 100) AS ry, avg(l_extendedprice / 1000) AS tx, avg(l_discount * 100) AS ty FROM lineitem),
s AS (SELECT sum((l_quantity - rx) * (l_extendedprice / 1000 - tx) + (l_tax * 100 - ry) * (l_discount * 100 - ty)) AS dot,
  sum((l_quantity - rx) * (l_discount * 100 - ty) - (l_tax * 100 - ry) * (l_extendedprice / 1000 - tx)) AS crs,
  sum((l_quantity - rx) * (l_quantity - rx) + (l_tax * 100 - ry) * (l_tax * 100 - ry)) AS en FROM lineitem CROSS JOIN c)
SELECT round(dot / en, 6) AS a, round(crs / en, 6) AS b, round(tx - dot / en * rx + crs / en * ry, 6) AS e, round(ty - crs / en * rx - dot / en * ry, 6) AS f FROM s CROSS JOIN c
""")
def similarity_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    fit = H.similarity_fit(table(spark, sf_dir, "lineitem"), F.col("l_quantity"), F.col("l_tax") * 100, F.col("l_extendedprice") / 1000, F.col("l_discount") * 100)
    return rounded(fit, "a", "b", "e", "f")


@query("""
SELECT l_suppkey AS element_id, sum(CASE WHEN l_tax <= 0.02 THEN l_quantity ELSE 0 END) AS horizontal, sum(CASE WHEN l_tax >= 0.06 THEN l_quantity ELSE 0 END) AS vertical,
 sum(CASE WHEN l_tax > 0.02 AND l_tax < 0.06 THEN l_quantity ELSE 0 END) AS sloped, count(*) AS triangles FROM lineitem GROUP BY 1
""")
def orientation_signature(spark: SparkSession, sf_dir: str) -> DataFrame:
    return H.orientation_signature(table(spark, sf_dir, "lineitem"), "l_suppkey", F.col("l_tax"), F.col("l_quantity"), 0.02, 0.06)


@query("""
WITH s AS (SELECT p_brand AS name, min(p_retailprice) AS elevation FROM part GROUP BY 1), f AS (SELECT name FROM s ORDER BY elevation, name LIMIT 1)
SELECT p_partkey, coalesce((SELECT max_by(name, (elevation, name)) FROM s WHERE s.elevation <= p_size * 40 + 0.5), (SELECT name FROM f)) AS storey FROM part
""")
def elevation_band(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    storeys = part.groupBy(F.col("p_brand").alias("name")).agg(F.min("p_retailprice").alias("elevation"))
    return H.elevation_band(part.withColumn("base", F.col("p_size") * 40), storeys, "base").select("p_partkey", "storey")


def _brand_boxes(spark: SparkSession, sf_dir: str, *bounds: str) -> DataFrame:
    return table(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("id")).agg(*[F.expr(b) for b in bounds])


AXES = {"p_size": ("x0", "x1"), "p_retailprice": ("y0", "y1")}


@query("""
WITH box AS (SELECT p_brand AS id, min(p_size) - 0.5 AS x0, max(p_size) / 2.0 + 0.5 AS x1, min(p_retailprice) - 0.5 AS y0, avg(p_retailprice) + 0.5 AS y1 FROM part GROUP BY p_brand)
SELECT b.id, count(*) AS occupants FROM box b JOIN part p ON p.p_size BETWEEN b.x0 AND b.x1 AND p.p_retailprice BETWEEN b.y0 AND b.y1 AND p.p_brand <> b.id GROUP BY b.id HAVING count(*) >= 5
""")
def containment_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    boxes = _brand_boxes(spark, sf_dir, "min(p_size) - 0.5D AS x0", "max(p_size) / 2.0D + 0.5D AS x1", "min(p_retailprice) - 0.5D AS y0", "avg(p_retailprice) + 0.5D AS y1")
    return P.occupants(boxes, table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_size", "p_retailprice"), "id", "p_brand", AXES, (10.0, 200.0))


@query("""
WITH box AS (SELECT p_brand AS id, min(p_size) AS x0, max(p_size) AS x1, min(p_retailprice) AS y0, max(p_retailprice) AS y1 FROM part GROUP BY p_brand)
SELECT p_partkey, id FROM (SELECT p.p_partkey, b.id, row_number() OVER (PARTITION BY p.p_partkey ORDER BY (b.x1 - b.x0) * (b.y1 - b.y0), b.id) AS rn
 FROM part p JOIN box b ON p.p_size BETWEEN b.x0 AND b.x1 AND p.p_retailprice BETWEEN b.y0 AND b.y1) t WHERE rn = 1
""")
def smallest_container(spark: SparkSession, sf_dir: str) -> DataFrame:
    boxes = _brand_boxes(spark, sf_dir, "min(p_size) AS x0", "max(p_size) AS x1", "min(p_retailprice) AS y0", "max(p_retailprice) AS y1")
    volume = (F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0"))
    return P.smallest_container(boxes, table(spark, sf_dir, "part").select("p_partkey", "p_size", "p_retailprice"), "p_partkey", "id", volume, AXES, (10.0, 200.0))


@query("""
WITH v AS (SELECT DISTINCT l_returnflag AS side, CAST(floor(l_quantity / 5) AS INT) AS x, CAST(floor(l_extendedprice / 5000) AS INT) AS y
  FROM lineitem WHERE l_returnflag IN ('R', 'A')),
d AS (SELECT -1 AS o UNION ALL SELECT 0 UNION ALL SELECT 1),
dil AS (SELECT DISTINCT v.side, v.x + a.o AS x, v.y + b.o AS y FROM v CROSS JOIN d a CROSS JOIN d b)
SELECT v.side, count(*) AS cells, count(CASE WHEN dil.x IS NULL THEN 1 END) AS only_here
FROM v LEFT JOIN dil ON dil.side <> v.side AND dil.x = v.x AND dil.y = v.y GROUP BY v.side
""")
def voxel_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = table(spark, sf_dir, "lineitem").filter("l_returnflag in ('R', 'A')").select(F.col("l_returnflag").alias("side"), F.floor(F.col("l_quantity") / 5).cast("int").alias("x"), F.floor(F.col("l_extendedprice") / 5000).cast("int").alias("y"))
    return P.voxel_diff(cells, "side", ["x", "y"])


@query("""
WITH RECURSIVE c AS (SELECT CAST(floor(l_quantity / 2) AS INT) AS x, CAST(floor(l_extendedprice / 2000) AS INT) AS y, count(*) AS n FROM lineitem GROUP BY 1, 2),
k AS (SELECT x, y FROM c WHERE n >= (SELECT greatest(4, floor(max(n) * 0.002)) FROM c)),
f(x, y) AS (SELECT x, y FROM (SELECT x, y FROM c ORDER BY n DESC, x, y LIMIT 1) s
  UNION SELECT k.x, k.y FROM f JOIN k ON abs(k.x - f.x) <= 1 AND abs(k.y - f.y) <= 1)
SELECT x, y FROM f
""")
def dense_component(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.dense_component(table(spark, sf_dir, "lineitem"), {"x": F.floor(F.col("l_quantity") / 2), "y": F.floor(F.col("l_extendedprice") / 2000)})


@query("""
SELECT least(c_nationkey, s_nationkey) AS a, greatest(c_nationkey, s_nationkey) AS b, min(l_orderkey) AS first_seen
FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1, 2
""")
def undirected_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines, orders, customer, supplier = (table(spark, sf_dir, t) for t in ("lineitem", "orders", "customer", "supplier"))
    rows = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).join(customer, F.col("o_custkey") == F.col("c_custkey")).join(supplier, F.col("l_suppkey") == F.col("s_suppkey"))
    return P.undirected_pairs(rows, "c_nationkey", "s_nationkey", "l_orderkey")


@query("""
WITH e AS (SELECT n_nationkey AS id, CASE WHEN n_nationkey % 6 = 0 THEN NULL ELSE n_nationkey - n_regionkey END AS owner FROM nation)
SELECT count(*) AS records, count(CASE WHEN e.owner IS NULL THEN 1 END) AS roots, count(CASE WHEN e.owner = e.id THEN 1 END) AS self_owned,
 count(CASE WHEN e.owner IS NOT NULL AND e.owner <> e.id AND p.id IS NULL THEN 1 END) AS dangling FROM e LEFT JOIN e p ON p.id = e.owner
""")
def ownership_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "nation").selectExpr("n_nationkey AS id", "CASE WHEN n_nationkey % 6 = 0 THEN NULL ELSE n_nationkey - n_regionkey END AS owner")
    return R.ownership_counters(rows, "id", "owner")


@query("""
SELECT p_partkey, p_name FROM part WHERE contains(lower(coalesce(p_name, '')), '1') OR contains(lower(coalesce(p_brand, '')), '1') OR contains(lower(coalesce(p_type, '')), '1') ORDER BY p_partkey LIMIT 60
""")
def multi_field_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.multi_field_search(table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand", "p_type"), "1", ["p_name", "p_brand", "p_type"], ["p_partkey"]).select("p_partkey", "p_name")


@query("""
SELECT p_partkey, p_size FROM part WHERE p_size = 7 ORDER BY p_partkey LIMIT 50
""")
def enum_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.enum_search(table(spark, sf_dir, "part").select("p_partkey", "p_size", "p_name"), "7", "p_size", ["p_name"], ["p_partkey"]).select("p_partkey", "p_size")


@query("""
SELECT DISTINCT p_partkey FROM part WHERE p_brand IN (SELECT min(p_brand) FROM part) OR p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 5)
""")
def hidden_elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part").select("p_partkey", "p_brand")
    level = table(spark, sf_dir, "lineitem").filter("l_quantity > 5").select("l_partkey")
    return S.hidden_elements(part, "p_partkey", "p_brand", part.agg(F.min("p_brand").alias("p_brand")), level).select("p_partkey")


@query("""
SELECT event_id, '{"x":{"n":' || event_id || '},"list":[{},' || user_id || '],"type":"' || event_type || '","ok":true}' AS kept FROM events WHERE event_type IS NOT NULL AND user_id IS NOT NULL
""")
def redact_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events")
    json = F.concat(F.lit('{"x":{"k":"'), "event_type", F.lit('","n":'), "event_id", F.lit('},"list":[{"K":[1,{"a":2}]},'), "user_id", F.lit('],"type":"'), "event_type", F.lit('","ok":true}'))
    return rows.select("event_id", Q.redact_json(json, ["k"]).alias("kept")).filter("kept is not null")


@query("""
SELECT o_orderkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey
WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey NOT IN (SELECT c_custkey FROM customer))
""")
def identity_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.identity_join(table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer"), "o_orderkey", ["o_custkey"], "c_custkey", "c_name")


@query("""
WITH a AS (SELECT DISTINCT l_orderkey AS k FROM lineitem WHERE l_returnflag = 'R'), b AS (SELECT DISTINCT l_orderkey AS k FROM lineitem WHERE l_returnflag = 'A'), c AS (SELECT DISTINCT l_orderkey AS k FROM lineitem WHERE l_quantity > 40)
SELECT o_orderkey, CASE WHEN a.k IS NOT NULL AND b.k IS NOT NULL THEN 'both' WHEN a.k IS NOT NULL THEN 'table' WHEN b.k IS NOT NULL THEN 'partition' WHEN c.k IS NOT NULL THEN 'recovered' ELSE 'none' END AS evidence
FROM orders LEFT JOIN a ON a.k = o_orderkey LEFT JOIN b ON b.k = o_orderkey LEFT JOIN c ON c.k = o_orderkey
""")
def tag_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem")
    sets = {"table": lines.filter("l_returnflag = 'R'"), "partition": lines.filter("l_returnflag = 'A'"), "recovered": lines.filter("l_quantity > 40")}
    return E.tag_join(table(spark, sf_dir, "orders").select("o_orderkey"), "o_orderkey", {n: x.select("l_orderkey") for n, x in sets.items()})


@query("""
WITH m AS (SELECT l_orderkey, l_linenumber % 2 AS half, array_to_string(list_sort(list(DISTINCT l_returnflag || ':' || l_linestatus)), ',') AS sig FROM lineitem GROUP BY 1, 2),
g AS (SELECT l_orderkey, min(sig) AS sig FROM m GROUP BY 1 HAVING count(DISTINCT sig) = 1)
SELECT l_orderkey, split_part(x, ':', 1) AS l_returnflag, split_part(x, ':', 2) AS l_linestatus FROM (SELECT l_orderkey, unnest(string_split(sig, ',')) AS x FROM g)
""")
def poisoned_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.poisoned_map(table(spark, sf_dir, "lineitem").withColumn("half", F.col("l_linenumber") % 2), "l_orderkey", "half", "l_returnflag", "l_linestatus")


@query("""
WITH bad AS (SELECT DISTINCT l_orderkey FROM lineitem WHERE l_suppkey NOT IN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 1000))
SELECT l_orderkey, round(sum(l_quantity), 6) AS total_width FROM lineitem WHERE l_orderkey NOT IN (SELECT l_orderkey FROM bad) GROUP BY 1
""")
def layer_widths(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = table(spark, sf_dir, "supplier").filter("s_acctbal > 1000")
    layers = E.layer_definitions(table(spark, sf_dir, "lineitem"), known, "l_orderkey", "l_linenumber", "l_suppkey", "s_suppkey")
    return rounded(E.total_width(layers, "l_orderkey", "l_quantity"), "total_width")


@query("""
SELECT l_orderkey, min(l_returnflag) AS l_returnflag FROM lineitem GROUP BY 1 HAVING count(DISTINCT l_returnflag) = 1
""")
def single_material(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.single_material(table(spark, sf_dir, "lineitem"), "l_orderkey", "l_returnflag")


@query("""
SELECT s_suppkey, CAST(coalesce(n, 0) AS BIGINT) AS elements FROM supplier LEFT JOIN (SELECT l_suppkey, count(DISTINCT l_orderkey) AS n FROM lineitem GROUP BY 1) ON l_suppkey = s_suppkey
""")
def material_palette(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").withColumnRenamed("l_suppkey", "s_suppkey")
    return E.material_palette(table(spark, sf_dir, "supplier").select("s_suppkey"), lines, "s_suppkey", "l_orderkey")


@query("""
SELECT min_by(x, event_id) AS name, count(*) AS n FROM (SELECT event_id, CASE WHEN event_id % 2 = 0 THEN upper(event_type) ELSE event_type END AS x FROM events) GROUP BY lower(x)
""")
def name_occurrences(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").withColumn("x", F.when(F.col("event_id") % 2 == 0, F.upper("event_type")).otherwise(F.col("event_type")))
    return E.occurrences(rows, "x", "event_id")


@query("""
SELECT CASE WHEN p_size > 10 THEN p_type ELSE 'Uncategorised' END AS name, count(*) AS n FROM part GROUP BY 1
""")
def category_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.counts_by(table(spark, sf_dir, "part").withColumn("c", F.when(F.col("p_size") > 10, F.col("p_type"))), "c", "Uncategorised")


@query("""
SELECT CAST(floor(l_quantity / 10) AS BIGINT) AS x, CAST(floor(l_extendedprice / 10000) AS BIGINT) AS y, count(*) AS n FROM lineitem GROUP BY 1, 2 ORDER BY n DESC, x, y LIMIT 20
""")
def densest_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.densest_regions(table(spark, sf_dir, "lineitem"), {"x": F.floor(F.col("l_quantity") / 10), "y": F.floor(F.col("l_extendedprice") / 10000)})


@query("""
SELECT l_orderkey, array_to_string(list_sort(list(DISTINCT l_returnflag)), ',') AS flags, array_to_string(list_sort(list(DISTINCT l_linestatus)), ',') AS states FROM lineitem GROUP BY 1
""")
def evidence_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = E.evidence_sets(table(spark, sf_dir, "lineitem"), ["l_orderkey"], ["l_returnflag", "l_linestatus"])
    return found.select("l_orderkey", F.array_join("l_returnflag", ",").alias("flags"), F.array_join("l_linestatus", ",").alias("states"))


@query("""
SELECT p_partkey, CASE WHEN p_size > 40 THEN 'large' WHEN p_retailprice > 1500 THEN 'costly' WHEN p_size < 5 THEN 'small' ELSE 'other' END AS role FROM part
""")
def display_role(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = [(F.col("p_size") > 40, "large"), (F.col("p_retailprice") > 1500, "costly"), (F.col("p_size") < 5, "small")]
    return table(spark, sf_dir, "part").select("p_partkey", E.labelled(F.col("p_size"), rules, "other").alias("role"))


@query("""
SELECT p_partkey FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity = 50) AND p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_discount = 0.1 AND l_quantity > 45)
""")
def suppressed_elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem")
    return E.suppressed(table(spark, sf_dir, "part").select("p_partkey"), "p_partkey", lines.filter("l_quantity = 50").select("l_partkey"), lines.filter("l_discount = 0.1 and l_quantity > 45").select("l_partkey"))


@query("""
WITH r AS (SELECT DISTINCT l_orderkey FROM lineitem WHERE l_returnflag = 'R'), w AS (SELECT DISTINCT o_custkey FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM r))
SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IN (SELECT o_custkey FROM w) AND o_orderkey NOT IN (SELECT l_orderkey FROM r)
""")
def curtain_helpers(spark: SparkSession, sf_dir: str) -> DataFrame:
    resolved = table(spark, sf_dir, "lineitem").filter("l_returnflag = 'R'").select("l_orderkey")
    return E.curtain_helpers(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), resolved, "o_orderkey", "o_custkey")


@query("""
WITH e AS (SELECT l_partkey, unnest([{'e': abs(l_extendedprice / l_quantity - 1000), 'k': 0, 'r': 'thousand'}, {'e': abs(l_extendedprice / l_quantity - 1500), 'k': 1, 'r': 'fifteen hundred'}]) AS x FROM lineitem)
SELECT l_partkey, min(x).r AS reading, round(min(x).e, 6) AS error FROM e GROUP BY 1
""")
def nearest_reading(spark: SparkSession, sf_dir: str) -> DataFrame:
    price = F.col("l_extendedprice") / F.col("l_quantity")
    return rounded(E.nearest_reading(table(spark, sf_dir, "lineitem"), "l_partkey", {"thousand": F.abs(price - 1000), "fifteen hundred": F.abs(price - 1500)}), "error")


@query("""
WITH a AS (SELECT l_orderkey AS k, sum(l_extendedprice) AS v FROM lineitem GROUP BY 1), b AS (SELECT o_orderkey AS k, o_totalprice AS v FROM orders)
SELECT count(*) AS compared, count(CASE WHEN abs(a.v - b.v) < 100000 THEN 1 END) AS aligned, count(CASE WHEN NOT abs(a.v - b.v) < 100000 THEN 1 END) AS different FROM a JOIN b ON a.k = b.k
""")
def difference_tally(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("k")).agg(F.sum("l_extendedprice").alias("v"))
    right = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_totalprice").alias("v"))
    return E.difference_tally(left, right, "k", "v", 100000)
