from pyspark.sql import functions as F

from girder.functions import semantics as X
from girder.operators import quality as Q
from girder.operators import resolve as R
from girder.operators import search as S
from girder.operators import shape as H
from girder.operators import spatial as P


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_semantics(spark):
    assert one(spark, X.round_half_up(F.lit(-2.5))) == -2
    assert one(spark, X.upper_median(F.array(*map(F.lit, (4, 1, 3, 2))))) == 3
    assert one(spark, X.leading_integer(F.lit(" 12abc"))) == 12
    assert one(spark, X.leading_integer(F.lit("abc"))) is None
    assert one(spark, X.trim_all(F.lit("  a b　"))) == "a b"
    assert one(spark, X.fnv1a(F.lit("a"))) == 0xE40C292C
    assert one(spark, X.fnv1a(F.lit(""))) == 2166136261
    assert one(spark, X.humanise(F.lit("OST_CurtainWallPanels"))) == "Curtain Wall Panels"
    assert one(spark, X.base_name(F.lit("a/B_cat.txt"))) == "b"
    assert one(spark, X.csv_field(F.lit('a,"b'))) == '"a,""b"'
    numbers = spark.createDataFrame([("9.10",), ("9.9",), ("10",)], "n string").orderBy(X.numeric_key(F.col("n"))).collect()
    assert [r["n"] for r in numbers] == ["9.9", "9.10", "10"]


def test_vote_ties_go_to_the_first_seen(spark):
    rows = spark.createDataFrame([(1, 3, 10), (1, 1, 11), (1, 3, 12), (1, 1, 13), (2, None, 1)], "o int, c int, k int")
    assert [tuple(r) for r in R.majority_vote(rows, "o", "c", "k").collect()] == [(1, 3, 2)]


def test_consensus_and_overrides(spark):
    rows = [(k, 54, "wall" if k else "floor") for k in range(12)] + [(99, 7, "plate")]
    members = spark.createDataFrame(rows, "id int, code int, c string")
    found = R.consensus(members, ["code"], "c", "id").collect()
    assert [(r["code"], r["c"], r["support"], round(r["purity"], 4)) for r in found] == [(54, "wall", 12, 0.9167)]
    donated = members.withColumn("donated", F.col("id") == 0)
    over = R.override_donated(donated, R.consensus(members, ["code"], "c", "id"), ["code"], "c", "donated").filter("overridden").collect()
    assert [(r["id"], r["c"]) for r in over] == [(0, "wall")]


def test_targets_with_hot_and_null_keys(spark):
    rows = spark.createDataFrame([(1, 5, 0), (1, 5, 1), (2, 5, 0), (2, 6, 1), (3, None, 0)], "e int, t int, o int")
    assert [tuple(r) for r in R.unique_target(rows, "e", "t", "o").collect()] == [(1, 5, 0)]
    links = spark.createDataFrame([(1, 5, "p"), (2, 6, "a"), (3, 5, "p"), (3, 6, "p"), (3, 7, "a")], "e int, t int, f string")
    found = R.primary_or_alternate(links, "e", "t", F.col("f") == "p", F.col("f") == "a")
    assert sorted(map(tuple, found.collect())) == [(1, 5), (2, 6)]


def test_ranks_over_a_hot_group(spark):
    rows = spark.range(2000).select((F.col("id") % 10 > 8).alias("g"), (F.col("id") * 7 % 2000).alias("v"))
    got = H.ranked_in_groups(rows, ["g"], ["v"]).collect()
    wanted = {}
    for g in (False, True):
        for k, v in enumerate(sorted(r["v"] for r in got if r["g"] == g)):
            wanted[g, v] = k + 1
    assert len(got) == 2000 and all(wanted[r["g"], r["v"]] == r["rank"] for r in got)


def test_order_statistic_narrows(spark, monkeypatch):
    monkeypatch.setattr(H, "BRACKET_ROWS", 50)
    rows = spark.range(5000).select((F.col("id") % 1000).cast("double").alias("v"))
    ordered = sorted(k % 1000 for k in range(5000))
    for k in (0, 1, 7, 2499, 4998, 4999):
        assert H.order_statistic(rows, "v", k) == ordered[k]
    assert H.order_statistic(rows, "v", 5000) is None


def test_empty_tables(spark):
    empty = spark.createDataFrame([], "a int, b int, c int")
    assert H.sample_evenly(empty, ["a"], 10).count() == 0
    assert H.robust_extent(empty, "a").first()["mn"] is None
    assert P.dense_component(empty, {"x": F.col("a"), "y": F.col("b")}).count() == 0
    assert R.majority_vote(empty, "a", "b", "c").count() == 0


def test_components(spark):
    cells = spark.createDataFrame([(0, 0), (1, 1), (5, 5), (5, 6), (9, 0)], "x int, y int")
    found = P.components(cells, ["x", "y"])
    assert found.select("component").distinct().count() == 3
    assert P.components(cells, ["x", "y"], corners=False).select("component").distinct().count() == 4


def test_nearest_segment(spark):
    points = spark.createDataFrame([(1, 0.0, 1.0), (2, 50.0, 50.0)], "p int, x double, y double")
    segments = spark.createDataFrame([(7, -5.0, 0.0, 5.0, 0.0), (8, 0.0, 3.5, 1.0, 3.5)], "s int, x0 double, y0 double, x1 double, y1 double")
    assert [tuple(r) for r in P.nearest_segment(points, segments, "p", "s", 3.0).collect()] == [(1, 7, 1.0)]


def test_reconcile_and_gates(spark):
    measures = spark.createDataFrame([(0, 0)], "part int, whole int")
    gates = Q.run_gates(measures, [Q.identity_gate(Q.ratio(F.col("part"), F.col("whole"))), Q.geometry_gate(F.lit(1.0), F.lit(0))])
    assert {r["id"]: r["status"] for r in gates.collect()} == {"identity": "fail", "geometry": "fail", "overall": "fail"}


def test_search(spark):
    rows = spark.createDataFrame([(1, "Wall", None), (2, "Door", "wALLed")], "k int, a string, b string")
    assert S.multi_field_search(rows, "wall", ["a", "b"], ["k"]).count() == 2
    assert S.multi_field_search(rows, "", ["a", "b"], ["k"]).count() == 2
    assert S.taxonomy_search(rows, " ", ["a", "b"], ["k"]).count() == 0
    assert S.enum_search(rows, "2", "k", ["a"], ["k"]).first()["a"] == "Door"


def test_holdout_summary_and_verdict(spark):
    def rows(**parts):
        return spark.createDataFrame([(p, k < ok, float(k)) for p, (n, ok) in parts.items() for k in range(n)], "p string, ok boolean, v double")

    def judged(df, **more):
        out = Q.holdout_summary(df, "p", F.col("ok"), **more)
        pooled = {c: F.col(c) for c in ("pooled_spread", "pooled_z") if c in out.columns}
        return {r["partition"]: r for r in out.withColumn("verdict", Q.holdout_verdict(F.col("spread"), F.col("z"), **pooled)).collect()}

    noise = judged(rows(a=(21, 10), b=(5000, 3250)), value=F.col("v"))
    assert noise["a"]["spread"] > 15 and abs(noise["a"]["z"]) < 2 and noise["a"]["verdict"] == "holds"
    assert (noise["a"]["median"], noise["a"]["worst"]) == (10.0, 20.0) and noise["b"]["median"] == 2500.0
    assert judged(rows(a=(210, 100), b=(5000, 3250)))["a"]["verdict"] == "split"
    thin = rows(a=(12, 12), b=(12, 12), c=(12, 0), d=(12, 0))
    assert judged(thin)["a"]["verdict"] == "untestable"
    pooled = judged(thin, order=["a", "b", "c", "d"])["a"]
    assert pooled["pooled_spread"] == 100 and pooled["verdict"] == "split"
    assert [r["partition"] for r in Q.silent_partitions(thin, rows(a=(1, 1), z=(1, 1)), "p").collect()] == ["z"]
    assert one(spark, Q.holdout_verdict(F.lit(1.0), F.lit(1.0), silent=F.lit(True))) == "silent"


def test_order_statistic_with_nan_and_infinity(spark, monkeypatch):
    monkeypatch.setattr(H, "BRACKET_ROWS", 50)
    rows = spark.range(2000).select(F.when(F.col("id") % 2 == 0, float("nan")).otherwise(F.col("id").cast("double")).alias("v"))
    assert H.order_statistic(rows, "v", 999) == 1999.0 and H.order_statistic(rows, "v", 1000) is None
    wide = spark.range(1000).select(F.when(F.col("id") < 300, float("-inf")).when(F.col("id") > 700, float("inf")).otherwise(F.col("id").cast("double")).alias("v"))
    assert [H.order_statistic(wide, "v", k) for k in (0, 350, 999)] == [float("-inf"), 350.0, float("inf")]


def test_several_order_statistics_at_once(spark, monkeypatch):
    rows = spark.range(5000).select((F.col("id") * 7 % 1000).cast("double").alias("v"))
    ordered, wanted = sorted(k * 7 % 1000 for k in range(5000)), [0, 25, 2500, 4999]
    for most in (10_000, 200, 10):  # all values read, brackets read, brackets too wide
        monkeypatch.setattr(H, "BRACKET_ROWS", most)
        assert H.order_statistics(rows, "v", lambda n: wanted) == (5000, 0.0, 999.0, [ordered[k] for k in wanted])
    assert H.order_statistics(rows.limit(0), "v", lambda n: [0, -1]) == (0, None, None, [None, None])


def test_medians(spark):
    rows = spark.range(3000).select((F.col("id") % 3).alias("g"), F.when(F.col("id") % 3 == 2, 7).otherwise(F.col("id") * 7 % 1000).alias("v")).unionByName(spark.createDataFrame([(9, 1), (9, 2), (8, 5), (7, None), (None, 4)], "g long, v long"))
    got = {r["g"]: (r["n"], r["median"]) for r in H.medians(rows, "g", "v").collect()}
    for g in (0, 1):
        assert got[g] == (1000, sorted(k * 7 % 1000 for k in range(3000) if k % 3 == g)[500])
    assert got[2] == (1000, 7) and got[9] == (2, 2) and got[8] == (1, 5) and got[None] == (1, 4) and 7 not in got


def test_as_of_over_hot_and_missing_keys(spark):
    rows = spark.range(3000).select(F.when(F.col("id") % 5 == 0, 2).otherwise(1).alias("k"), (F.col("id") / 10).alias("at"), "id")
    known = spark.createDataFrame([(1, 5.0, "a"), (1, 250.0, "b"), (3, 0.0, "c")], "k int, at double, v string")
    got = {r["id"]: r["v"] for r in H.as_of(rows, known, {"k": "k"}, "at", "at", ["v"]).collect()}
    assert len(got) == 3000 and all(got[i] == (None if i % 5 == 0 or i < 50 else "a" if i < 2500 else "b") for i in range(3000))


def test_redaction_at_every_depth(spark):
    cases = {'{"x":{"k":"secret","y":[{"K_":1},2]},"n":3,"f":1.5,"b":true,"z":null}': '{"x":{"y":[{},2]},"n":3,"f":1.5,"b":true,"z":null}', "[1]": None, "bad": None}
    rows = spark.createDataFrame([(k,) for k in cases], "j string").select("j", Q.redact_json(F.col("j"), ["k"]).alias("r")).collect()
    assert {r["j"]: r["r"] for r in rows} == cases
    assert one(spark, Q.redact_json(F.lit('{"User Name":1,"Path":2,"Size":3}'))) == '{"Size":3}'


def test_redaction_keeps_numbers_as_written(spark):
    deep = "[" * 100_000 + "]" * 100_000
    cases = {
        '{"a":1.10,"b":[1e5,-0,12345678901234567890.5,{"k":2.50,"c":1E+2}]}': '{"a":1.10,"b":[1e5,-0,12345678901234567890.5,{"c":1E+2}]}',
        '{ "t" : "1.10 \\u00e9 \\" x" , "e" : { } , "l" : [ ] }': '{"t":"1.10 é \\" x","e":{},"l":[]}',
        '{"n":' + "9" * 6000 + "}": '{"n":' + "9" * 6000 + "}",
        '{"x":' + deep + "}": None,
        "1.10": None,
        "": None,
    }
    rows = spark.createDataFrame([(k,) for k in [*cases, None]], "j string").select("j", Q.redact_json(F.col("j"), ["k"]).alias("r")).collect()
    assert {r["j"]: r["r"] for r in rows} == {**cases, None: None}


def test_rings_and_lines(spark):
    ring = F.array(*[F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y")) for x, y in ((0, 0), (3, 0), (3, 4))])
    assert one(spark, X.polygon_area(ring)) == 6.0 and one(spark, X.polyline_length(ring)) == 7.0


def test_all_pairs_of_many_partitions(spark, monkeypatch):
    monkeypatch.setattr(Q, "BLOCK", 7)
    rows = spark.range(40 * 25).selectExpr("id % 40 AS p", "id % 3 = 0 OR id % 40 > 30 AS ok").unionByName(spark.createDataFrame([(None, True)] * 30, "p long, ok boolean"))
    counts = {r["p"]: (r["n"], r["k"]) for r in rows.groupBy("p").agg(F.count("*").alias("n"), F.count_if("ok").alias("k")).filter("p is not null").collect()}
    wanted = sum(0 < counts[a][1] + counts[b][1] < counts[a][0] + counts[b][0] for a in counts for b in counts if a < b)
    found = Q.holdout_z(rows, "p", F.col("ok")).collect()
    assert len(found) == wanted == len({(r["a"], r["b"]) for r in found}) and all(r["a"] < r["b"] for r in found)
