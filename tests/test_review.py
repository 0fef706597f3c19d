"""Display texts, instants, dated merges, agreement by pieces: edge cases."""

import pytest
from pyspark.sql import functions as F

from girder.functions import formats as W
from girder.operators import quality as Q
from girder.operators import relations as R


def one(spark, kind, values, f):
    rows = spark.createDataFrame([(k, v) for k, v in enumerate(values)], f"k int, v {kind}")
    return [r["out"] for r in rows.select("k", f(F.col("v")).alias("out")).orderBy("k").collect()]


def test_bytes(spark):
    values = {0: "0 B", 1023: "1023 B", 1024: "1.0 KB", 1280: "1.3 KB", 102_399: "100.0 KB", 102_400: "100 KB", 1_048_575: "1024 KB", 1 << 20: "1.0 MB", 70 << 20: "70.0 MB", 3 << 30: "3.0 GB", 5 << 40: "5120 GB", None: None}
    assert one(spark, "long", values, W.format_bytes) == list(values.values())


def test_numbers(spark):
    values = {0.0: "0", 1234.25: "1,234.3", -1234.25: "-1,234.3", 1e6: "1,000,000", 0.05: "0.1", -0.04: "-0", None: None}
    assert one(spark, "double", values, W.format_number) == list(values.values())


def test_relative_times(spark):
    now = 10 * W.DAY * 10
    values = {-5: "just now", 59_999: "just now", W.MINUTE: "1 min ago", W.HOUR: "1 h ago", W.DAY: "yesterday", 2 * W.DAY: "2 days ago", 7 * W.DAY: "last week", 14 * W.DAY: "2 weeks ago", None: None}
    assert one(spark, "long", values, lambda v: W.relative_time(now - v, F.lit(now))) == list(values.values())


def test_names(spark):
    values = {"a b.rvt": "a-b-recovered.ifc", "..": "model-recovered.ifc", "-x-.y.z": "x--y-recovered.ifc", "": "model-recovered.ifc", None: None}
    assert one(spark, "string", values, lambda v: W.output_name(v, "ifc", "model")) == list(values.values())
    labels = {"a.rvt": "RVT", "a": "FILE", "a.": "FILE", "a.b.thumbs": "THUM", "": "FILE", None: None}
    assert one(spark, "string", labels, W.extension_label) == list(labels.values())


def test_release_plans(spark):
    got = one(spark, "double", [2027.0, 2023.0, 2027.5, None], W.release_plan)
    assert [(r["release"], r["bounds_decoder"]) for r in got] == [(2027, W.BOUNDS_DECODER), (2023, None), (None, None), (None, None)]
    assert all(r["coordinate_scanner"] and r["profile_decoder"] is None for r in got)


def test_dated_merge(spark):
    mine = spark.createDataFrame([(1, "2024-01-01T12:00:00Z", "a"), (2, "2024-01-01T12:00:00Z", "a"), (3, "none", "a"), (4, None, "a")], "id int, at string, body string")
    theirs = spark.createDataFrame([(1, "2024-01-01T13:00:00+02:00", "b"), (2, "2024-01-01T11:00:00-01:00", "b"), (3, "2024-01-01", "b"), (5, "never", "b")], "id int, at string, body string")
    got = {r["id"]: (r["body"], r["at"]) for r in R.dated_merge(mine, theirs, "id", "at").collect()}
    assert got == {1: ("a", "2024-01-01T12:00:00Z"), 2: ("b", "2024-01-01T11:00:00-01:00"), 3: ("a", "none"), 4: ("a", None), 5: ("b", "never")}


BOXES = "id int, class string, x0 double, y0 double, z0 double, x1 double, y1 double, z1 double"


def agreement(spark, drawn, parts, **parameters):
    got = Q.box_agreement(spark.createDataFrame([(r[0], "extra", *r[1:]) for r in drawn], BOXES), spark.createDataFrame(parts, BOXES), "id", "class", 1.0, **parameters)
    return {r["class"]: r.asDict() for r in got.collect()}


def test_agreement_by_nearest_piece(spark):
    """An element exported once for each storey is right by its own storey, wrong by the stack."""
    drawn = [(k, 0.0, 0.0, 0.0, 2.0, 2.0, 3.0) for k in (1, 2, 4)] + [(3, 0.0, 0.0, 0.0, None, 2.0, 3.0), (None, 0.0, 0.0, 0.0, 1.0, 1.0, 1.0)]
    stack = [(1, "wall", 0.0, 0.0, 3.0 * k, 2.0, 2.0, 3.0 * k + 3) for k in range(3)]
    parts = stack + stack[:1] + [(2, "wall", 0.0, 0.0, 0.0, 2.0, 2.0, 3.0), (3, "wall", 0.0, 0.0, 0.0, 1.0, 1.0, 1.0), (9, "door", 0.0, 0.0, 0.0, 1.0, 1.0, 1.0), (None, "door", 0.0, 0.0, 0.0, 1.0, 1.0, 1.0)]
    tie = [(4, "roof", 0.0, 0.0, -4.0, 2.0, 2.0, -1.0), (4, "roof", 0.0, 0.0, 4.0, 2.0, 2.0, 7.0)]  # the union lies nearer than both
    got = agreement(spark, drawn, parts + tie, least=1)
    assert set(got) == {"wall", "roof"}
    wall, roof = got["wall"], got["roof"]
    assert (wall["matched"], wall["replicated"], wall["centre_ok_percent"], wall["size_ok_percent"]) == (2, 1, 50.0, 50.0)
    assert (wall["nearest_centre_ok_percent"], wall["nearest_size_ok_percent"], wall["median_centre"], wall["median_size"]) == (100.0, 100.0, 3.0, 6.0)
    assert (roof["nearest_centre_ok_percent"], roof["nearest_size_ok_percent"], roof["median_size"]) == (100.0, 0.0, 8.0)


@pytest.mark.parametrize("least", [1, 10])
def test_agreement_of_few_or_none(spark, least):
    assert agreement(spark, [], [], least=least) == {}
    got = agreement(spark, [(1, 0.0, 0.0, 0.0, 1.0, 1.0, 1.0)], [(1, "wall", 0.0, 0.0, 0.0, 1.0, 1.0, 1.0)], least=least)
    assert len(got) == (least == 1)
