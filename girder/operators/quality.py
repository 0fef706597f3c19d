"""Comparing, validating, merging and reconciling tables; coverage, gates and hold-out statistics."""

from __future__ import annotations

import json
import re
from collections.abc import Mapping, Sequence
from functools import reduce
from operator import and_, or_

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from girder.operators.shape import medians
from girder.sources.shared import written


def document_diff(left: DataFrame, right: DataFrame, key: str, changes: Mapping[str, str], kind: str | None = None) -> DataFrame:
    """(key, change): added, removed, a label for each changed column (``changes``: label -> column), incompatible (``kind`` differs), unchanged.

    A row may have several changes.
    """
    columns = [*changes.values(), *([kind] if kind else [])]
    a = left.select(F.col(key).alias("a_"), *[F.col(c).alias(f"a_{c}") for c in columns])
    b = right.select(F.col(key).alias("b_"), *[F.col(c).alias(f"b_{c}") for c in columns])
    both = F.col("a_").isNotNull() & F.col("b_").isNotNull()
    differs = {label: ~F.col(f"a_{c}").eqNullSafe(F.col(f"b_{c}")) for label, c in [*changes.items(), *([("incompatible", kind)] if kind else [])]}
    any_change = F.lit(False)
    for d in differs.values():
        any_change = any_change | d
    labels = [F.when(F.col("a_").isNull(), "added"), F.when(F.col("b_").isNull(), "removed"), *[F.when(both & d, label) for label, d in differs.items()], F.when(both & ~any_change, "unchanged")]
    joined = a.join(b, F.col("a_") == F.col("b_"), "full_outer")
    return joined.select(F.coalesce("a_", "b_").alias("k"), F.explode(F.filter(F.array(*labels), lambda x: x.isNotNull())).alias("change"))


def missing_references(rows: DataFrame, key: str, reference: str, known: DataFrame, known_key: str, code: str) -> DataFrame:
    """(code, k) of rows whose reference is unknown."""
    ids = known.select(F.col(known_key).alias(reference))
    return rows.join(ids, reference, "left_anti").select(F.lit(code).alias("code"), F.col(key).cast("long").alias("k"))


def unused(known: DataFrame, key: str, rows: DataFrame, reference: str, code: str) -> DataFrame:
    """(code, k) of known rows to which nothing refers."""
    return known.join(rows.select(F.col(reference).alias(key)), key, "left_anti").select(F.lit(code).alias("code"), F.col(key).cast("long").alias("k"))


def duplicates(rows: DataFrame, key: str, columns: Sequence[str], code: str) -> DataFrame:
    """(code, k) of rows that repeat an earlier row's columns: all but the smallest key of each group."""
    first = rows.groupBy(*columns).agg(F.min(key).alias("first_"))
    same = [rows[c].eqNullSafe(first[c]) for c in columns]
    return rows.join(first, same).filter(F.col(key) > F.col("first_")).select(F.lit(code).alias("code"), F.col(key).cast("long").alias("k"))


def malformed(rows: DataFrame, key: str, column: str, pattern: str, code: str) -> DataFrame:
    """(code, k) of rows whose column is null or doesn't look as it should."""
    return rows.filter(~F.coalesce(F.col(column).rlike(pattern), F.lit(False))).select(F.lit(code).alias("code"), F.col(key).cast("long").alias("k"))


def ambiguous_names(rows: DataFrame, name: str, identity: str, code: str) -> DataFrame:
    """(code, name) of names that several identities bear."""
    found = rows.groupBy(name).agg(F.min(identity).alias("low_"), F.max(identity).alias("high_")).filter("low_ <> high_")
    return found.select(F.lit(code).alias("code"), F.col(name).alias("name"))


def merge_conflicts(rows: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """(key, column) where documents disagree."""
    tests = [F.when(F.min(c) != F.max(c), F.lit(c)) for c in columns]
    found = rows.groupBy(key).agg(F.array(*tests).alias("found_"))
    return found.select(key, F.explode(F.filter("found_", lambda x: x.isNotNull())).alias("column"))


def reconcile_levels(saved: DataFrame, fresh: DataFrame, key: str, disposition: str, unreviewed: str, keep: Sequence[str], level: str) -> DataFrame:
    """Like ``reconcile`` for the levels of which there are fresh rows; saved rows of other levels stay as they are, state ``untouched``."""
    levels = fresh.select(level).distinct()
    inside = reconcile(saved.join(levels, level, "left_semi"), fresh, key, disposition, unreviewed, keep)
    other = saved.join(levels, level, "left_anti").select(F.col(key).alias("id"), disposition, *keep, F.lit("untouched").alias("state"))
    return inside.unionByName(other)


def reconcile(saved: DataFrame, fresh: DataFrame, key: str, disposition: str, unreviewed: str, keep: Sequence[str]) -> DataFrame:
    """(id, disposition, kept columns of the fresh row, state): decisions are kept, measures refreshed; saved rows that are gone stay only if they were reviewed."""
    s = saved.select(F.col(key).alias("s_"), F.col(disposition).alias("d_"))
    f = fresh.select(F.col(key).alias("f_"), *keep)
    joined = s.join(f, F.col("s_") == F.col("f_"), "full_outer").filter(F.col("f_").isNotNull() | (F.col("d_") != unreviewed))
    state = F.when(F.col("f_").isNull(), "stale").when(F.col("s_").isNull(), "new").otherwise("kept")
    return joined.select(F.coalesce("f_", "s_").alias("id"), F.coalesce("d_", F.lit(unreviewed)).alias(disposition), *keep, state.alias("state"))


def class_coverage(rows: DataFrame, class_: str, key: str, sets: Mapping[str, DataFrame | None]) -> DataFrame:
    """(class, in_export, a count for each set): how many of a class's rows are in each set of ids (DataFrames of one column); null for a set that isn't there. Rows without a key are no part of it."""
    out, counts = rows.select(F.col(class_).alias("class"), F.col(key).alias("key_")).filter("key_ is not null"), []
    for name, ids in sets.items():
        if ids is None:
            counts.append(F.lit(None).cast("long").alias(name))
            continue
        known = ids.select(F.col(ids.columns[0]).alias("key_")).distinct().withColumn(f"{name}_", F.lit(True))
        out = out.join(known, "key_", "left")
        counts.append(F.count(f"{name}_").alias(name))
    return out.groupBy("class").agg(F.count("*").alias("in_export"), *counts)


def gate(name: str, value: Column, passes: Column, warns: Column) -> Column:
    """A gate as a struct (id, status, value)."""
    return F.struct(F.lit(name).alias("id"), F.when(passes, "pass").when(warns, "warn").otherwise("fail").alias("status"), value.cast("double").alias("value"))


def ratio(part: Column, whole: Column) -> Column:
    """part / whole; 0 for a zero whole."""
    return F.when(whole == 0, 0.0).otherwise(part / whole)


def run_gates(measures: DataFrame, gates: Sequence[Column]) -> DataFrame:
    """(id, status, value) of all gates of a one-row table of measures, and the overall status: the worst of them."""
    rank = lambda g: F.when(g["status"] == "fail", 2).when(g["status"] == "warn", 1).otherwise(0)
    worst = F.array_max(F.transform(F.array(*gates), rank))
    overall = F.struct(F.lit("overall").alias("id"), F.when(worst == 2, "fail").when(worst == 1, "warn").otherwise("pass").alias("status"), F.lit(None).cast("double").alias("value"))
    return measures.select(F.explode(F.concat(F.array(*gates), F.array(overall))).alias("g")).select("g.*")


def identity_gate(share: Column) -> Column:
    return gate("identity", share, share >= 0.95, share >= 0.5)


def topology_gate(share: Column) -> Column:
    return gate("topology", share, share.between(0.5, 2), share >= 0.25)


def semantics_gate(share: Column) -> Column:
    return gate("semantics", share, share >= 0.9, share > 0)


def extents_gate(worst_error: Column) -> Column:
    return gate("extents", worst_error, worst_error <= 0.1, worst_error <= 0.25)


def geometry_gate(share: Column, compared: Column) -> Column:
    return gate("geometry", F.when(compared > 0, share).otherwise(0.0), (compared > 0) & (share >= 0.9), (compared > 0) & (share >= 0.5))


def class_agreement(rows: DataFrame, class_: str, error: Column, tolerance: float, least: int = 10) -> DataFrame:
    """(class, matched, ok_percent, median_err): share of errors strictly below the tolerance, and the upper median, of classes with enough rows."""
    measured = rows.select(F.col(class_).alias("class"), error.alias("err"))
    median = medians(measured, "class", "err").select("class", F.col("median").alias("median_err"))
    counts = measured.groupBy("class").agg(F.count("*").alias("matched"), F.count_if(F.col("err") < tolerance).alias("ok_")).filter(F.col("matched") >= least)
    return counts.join(median, "class").select("class", "matched", (F.col("ok_") * 100.0 / F.col("matched")).alias("ok_percent"), "median_err")


#: Corners of a box, lower ones first.
BOX = ("x0", "y0", "z0", "x1", "y1", "z1")


def _box_errors(got: Mapping[str, Column], want: Mapping[str, Column]) -> tuple[Column, Column]:
    """The largest errors of centre and of size of any axis."""
    centre = [F.abs((got[f"{a}0"] + got[f"{a}1"]) / 2 - (want[f"{a}0"] + want[f"{a}1"]) / 2) for a in "xyz"]
    size = [F.abs((got[f"{a}1"] - got[f"{a}0"]) - (want[f"{a}1"] - want[f"{a}0"])) for a in "xyz"]
    return F.greatest(*centre), F.greatest(*size)


def box_agreement(drawn: DataFrame, parts: DataFrame, id_: str, class_: str, tolerance: float, least: int = 10) -> DataFrame:
    """(class, matched, centre_ok_percent, size_ok_percent, median_centre, median_size, nearest_centre_ok_percent, nearest_size_ok_percent, replicated) of classes with ``least`` elements.

    ``drawn`` has one box (BOX) an element, ``parts`` the boxes of the pieces that
    an element was exported as; their union is what it is judged by, and a second
    time by the nearest piece, where one's centre is strictly nearer than the
    union's (of pieces equally near the one with the smaller error of size).
    ``replicated`` counts elements of several pieces. An element's class is the
    smallest of its pieces'. Null ids, null corners and elements of one side only
    take no part. Pieces meet boxes in one join, and one aggregate makes unions
    and nearest pieces; errors strictly below the tolerance are right.
    """
    whole = reduce(and_, (F.col(c).isNotNull() for c in BOX))
    a = drawn.filter(whole).select(F.col(id_).alias("id"), *[F.col(c).alias(f"got_{c}") for c in BOX])
    b = parts.filter(whole).select(F.col(id_).alias("id"), F.col(class_).alias("class"), *BOX)
    got = {c: F.col(f"got_{c}") for c in BOX}
    centre, size = _box_errors(got, {c: F.col(c) for c in BOX})
    union = [(F.min if c.endswith("0") else F.max)(c).alias(c) for c in BOX]
    of = b.join(a, "id").groupBy("id").agg(F.min("class").alias("class"), F.count("*").alias("n"), F.min(F.struct(centre.alias("c"), size.alias("s"))).alias("near"), *union, *[F.min(f"got_{c}").alias(f"got_{c}") for c in BOX])
    centre, size = _box_errors(got, {c: F.col(c) for c in BOX})
    rows = written(of.select("class", "n", "near", centre.alias("centre"), size.alias("size")), "agreement")
    nearer = F.col("near.c") < F.col("centre")
    share = lambda x: F.count_if(x < tolerance) * 100.0 / F.count("*")
    counts = rows.groupBy("class").agg(
        F.count("*").alias("matched"), share(F.col("centre")).alias("centre_ok_percent"), share(F.col("size")).alias("size_ok_percent"),
        share(F.when(nearer, F.col("near.c")).otherwise(F.col("centre"))).alias("nearest_centre_ok_percent"), share(F.when(nearer, F.col("near.s")).otherwise(F.col("size"))).alias("nearest_size_ok_percent"),
        F.count_if(F.col("n") > 1).alias("replicated"),
    ).filter(F.col("matched") >= least)
    middle = [medians(rows, "class", c).select("class", F.col("median").alias(f"median_{c}")) for c in ("centre", "size")]
    return counts.join(middle[0], "class").join(middle[1], "class")


#: Partitions of a block.
BLOCK = 1000


def holdout_z(rows: DataFrame, partition: str, ok: Column, least: int = 20) -> DataFrame:
    """(a, b, z): two-proportion z of every pair of partitions with enough rows (one row for each partition is paired, not the rows).

    Partitions are dealt to blocks of about BLOCK and blocks meet blocks by an
    equi-join, so no task holds all of them, however many there are.
    """
    g = written(rows.groupBy(F.col(partition).alias("p")).agg(F.count("*").alias("n"), F.count_if(ok).alias("ok")).filter((F.col("n") >= least) & F.col("p").isNotNull()), "partitions")
    blocks = -(-g.count() // BLOCK) or 1
    every = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    mine = g.select(F.struct("p", "n", "ok").alias("r"), F.pmod(F.xxhash64("p"), F.lit(blocks)).cast("int").alias("block"))
    pairs = mine.select(F.col("r").alias("x"), F.col("block").alias("i"), every.alias("j")).join(mine.select(F.col("r").alias("y"), F.col("block").alias("j"), every.alias("i")), ["i", "j"]).filter("x.p < y.p")
    pool = (F.col("x.ok") + F.col("y.ok")) / (F.col("x.n") + F.col("y.n"))
    z = (F.col("x.ok") / F.col("x.n") - F.col("y.ok") / F.col("y.n")) / F.sqrt(pool * (1 - pool) * (F.lit(1.0) / F.col("x.n") + F.lit(1.0) / F.col("y.n")))
    return pairs.filter((pool > 0) & (pool < 1)).select(F.col("x.p").alias("a"), F.col("y.p").alias("b"), z.alias("z"))


def two_proportion_z(ok_a: Column, n_a: Column, ok_b: Column, n_b: Column) -> Column:
    """Pooled two-proportion z; 0 without variance."""
    pool = (ok_a + ok_b) / (n_a + n_b)
    variance = pool * (1 - pool) * (F.lit(1.0) / n_a + F.lit(1.0) / n_b)
    return F.when(variance <= 0, 0.0).otherwise((ok_a / n_a - ok_b / n_b) / F.sqrt(variance))


def holdout_summary(rows: DataFrame, partition: str, ok: Column, thin: int = 20, value: Column | None = None, order: Sequence[str] = ()) -> DataFrame:
    """(partition, n, ok_percent, thin) of every partition, and over all the spread between the best and the worst that aren't thin and its z (null if fewer than two aren't).

    With ``value`` also its upper ``median`` and ``worst`` (largest) by
    partition. With an ``order`` of more than two partitions also
    ``pooled_spread`` and ``pooled_z`` of its lower against its upper half,
    null if one of them is thin; partitions that it lacks count as upper.
    """
    measured = rows.select(F.col(partition).alias("partition"), F.coalesce(ok, F.lit(False)).alias("ok"), (F.lit(None).cast("double") if value is None else value).alias("value"))
    g = measured.groupBy("partition").agg(F.count("*").alias("n"), (F.count_if("ok") * 100.0 / F.count("*")).alias("ok_percent"), F.count_if("ok").alias("ok"), F.max("value").alias("worst"))
    g = g.withColumn("thin", F.col("n") < thin)
    first = lambda percent: F.min(F.struct(percent.alias("percent"), "partition", "n", "ok"))  # noqa: E731  of equals the first
    of = g.filter(~F.col("thin")).agg((F.max("ok_percent") - F.min("ok_percent")).alias("spread"), F.count("*").alias("compared"), first(-F.col("ok_percent")).alias("a"), first(F.col("ok_percent")).alias("b"))
    spread = of.select("spread", F.when(F.col("compared") >= 2, two_proportion_z(F.col("a.ok"), F.col("a.n"), F.col("b.ok"), F.col("b.n"))).alias("z"))
    out = g.select("partition", "n", "ok_percent", "thin", *(["worst"] if value is not None else [])).crossJoin(spread)  # one row on the right
    if value is not None:
        median = medians(measured, "partition", "value").select(F.col("partition").alias("of_"), "median")
        out = out.join(median, F.col("partition").eqNullSafe(F.col("of_")), "left").drop("of_")
    if len(order) > 2:
        lower = F.coalesce(F.col("partition").isin(*order[: (len(order) + 1) // 2]), F.lit(False))
        part = lambda name, inside: F.coalesce(F.sum(F.when(inside, F.col(name))), F.lit(0))
        halves = g.agg(*[part(name, inside).alias(f"{name}_{k}") for name in ("n", "ok") for k, inside in (("lower", lower), ("upper", ~lower))])
        both = (F.col("n_lower") >= thin) & (F.col("n_upper") >= thin)
        apart = F.abs(F.col("ok_lower") / F.col("n_lower") - F.col("ok_upper") / F.col("n_upper")) * 100
        z = two_proportion_z(F.col("ok_lower"), F.col("n_lower"), F.col("ok_upper"), F.col("n_upper"))
        out = out.crossJoin(halves.select(F.when(both, apart).alias("pooled_spread"), F.when(both, z).alias("pooled_z")))
    return out


def silent_partitions(rows: DataFrame, eligible: DataFrame, partition: str) -> DataFrame:
    """(partition): partitions with eligible rows in which no row was measured."""
    name = F.col(partition).alias("partition")
    theirs, ours = eligible.select(name).distinct(), rows.select(F.col(partition).alias("of_")).distinct()
    return theirs.join(ours, F.col("partition").eqNullSafe(F.col("of_")), "left_anti")


def holdout_verdict(spread: Column, z: Column, points: float = 15.0, least_z: float = 2.0, pooled_spread: Column | None = None, pooled_z: Column | None = None, silent: Column | None = None) -> Column:
    """silent, untestable, split or holds, by whether a partition is silent and the spread in points and z of each comparison."""
    none = F.lit(None).cast("double")
    found = [(spread, z), (none if pooled_spread is None else pooled_spread, none if pooled_z is None else pooled_z)]
    untestable = reduce(and_, [a.isNull() | b.isNull() for a, b in found])
    split = reduce(or_, [F.coalesce((a > points) & (F.abs(b) > least_z), F.lit(False)) for a, b in found])
    quiet = F.lit(False) if silent is None else F.coalesce(silent, F.lit(False))
    return F.when(quiet, "silent").when(untestable, "untestable").when(split, "split").otherwise("holds")


#: Keys that are never told, as letters in lower case.
SENSITIVE = ("path", "content", "username", "centralmodelpath", "lastsavepath", "centralmodelidentity", "modelidentity", "author")


def redacted(value, sensitive: frozenset[str]):
    """A JSON value without the sensitive keys of its objects, at any depth."""
    if isinstance(value, dict):
        return {k: redacted(v, sensitive) for k, v in value.items() if re.sub("[^a-z]", "", k, flags=re.IGNORECASE).lower() not in sensitive}
    return [redacted(v, sensitive) for v in value] if isinstance(value, list) else value


class NumberText(str):
    """A JSON number as it was written."""


def json_text(value) -> str:
    """A JSON value without white space; numbers as they were written."""
    if isinstance(value, dict):
        return "{" + ",".join(f"{json.dumps(k, ensure_ascii=False)}:{json_text(v)}" for k, v in value.items()) + "}"
    if isinstance(value, list):
        return "[" + ",".join(map(json_text, value)) + "]"
    return value if isinstance(value, NumberText) else json.dumps(value, ensure_ascii=False)


def redact_json(json_: Column, sensitive: Sequence[str] = SENSITIVE) -> Column:
    """A JSON object without the keys whose letters, in lower case, are sensitive, at any depth; other values stay as they are, numbers as written. Null if it is no object, or nested deeper than Python recurses."""
    names = frozenset(sensitive)

    @F.pandas_udf("string")
    def redact(texts: pd.Series) -> pd.Series:
        def one(text):
            try:
                value = json.loads(text, parse_float=NumberText, parse_int=NumberText, parse_constant=NumberText) if text is not None else None
                return json_text(redacted(value, names)) if isinstance(value, dict) else None
            except (ValueError, RecursionError):
                return None

        return texts.map(one)

    return redact(json_)
