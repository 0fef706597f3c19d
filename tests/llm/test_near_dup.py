import random
from collections import Counter

import numpy as np
import pytest

from pyspark.sql import functions as F

from girder.llm import near_dup as N
from girder.llm import spread as S


def shingles(text):
    w = (text or "").lower().split()
    return Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else Counter([tuple(w)] if w else [])


def brute(rows):
    sets = [shingles(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and sets[b] and (sets[a] & sets[b]).total() >= 0.8 * (sets[a] | sets[b]).total() - 1e-9:
                parent[max(find(a), find(b))] = min(find(a), find(b))
    return [find(k) for k in range(len(rows))]


def corpus(n=120, seed=3):
    r = random.Random(seed)
    words = ["".join(r.choice("abcdefghij") for _ in range(r.randint(1, 7))) for _ in range(400)]
    base = [[r.choice(words) for _ in range(r.randint(1, 120))] for _ in range(12)]
    rows = []
    for k in range(n):
        doc = list(r.choice(base))
        if k % 7 == 0:  # repeated passages weigh as often as they stand
            doc += doc[:20] * r.randint(1, 4)
        for _ in range(r.choice((0, 0, 1, 2, 5))):
            doc[r.randrange(len(doc))] = r.choice(words)
        rows.append((k, " ".join(doc)))
    return rows


SCHEMA = "doc_id long, text string"


def classes(spark, rows, schema=SCHEMA):
    return N.near_duplicate_classes(spark.createDataFrame(rows, schema)).collect()


def test_classes_match_brute_force(spark):
    rows = corpus()
    wanted = brute(rows)
    got = {r["doc_id"]: r for r in classes(spark, rows)}
    assert [got[k]["class_id"] for k in range(len(rows))] == wanted
    assert all(got[k]["class_size"] == wanted.count(wanted[k]) for k in got)
    assert sorted(k for k in got if got[k]["representative"]) == sorted(set(wanted))


def test_a_chain_that_leaders_miss(spark):
    """Every text is similar to the next only; one class results, and unlike texts of shared buckets stay apart."""
    words = [f"w{k}" for k in range(160)]
    rows = [(k, " ".join(words[4 * k : 4 * k + 60])) for k in range(20)]
    assert brute(rows) == [0] * 20
    assert {r["class_id"] for r in classes(spark, rows)} == {0}


def test_hot_buckets_and_elements(spark, monkeypatch):
    """A third of the rows near copies of one text, and a passage in all of them; salted joins change nothing."""
    monkeypatch.setattr(N, "HOT", 1e-6)
    monkeypatch.setattr(S, "SALTS", 3)
    r = random.Random(9)
    base, passage = [f"b{k}" for k in range(60)], " ".join(f"p{k}" for k in range(40))
    rows = []
    for k in range(120):
        doc = list(base) if k % 3 == 0 else [f"w{k}x{j}" for j in range(r.randint(4, 14))]
        if k % 3 == 0:
            doc[r.randrange(60)] = f"n{k}"
        rows.append((k, passage + " " + " ".join(doc)))
    got = {r["doc_id"]: r["class_id"] for r in classes(spark, rows)}
    assert [got[k] for k in range(120)] == brute(rows)


def test_salted_join(spark):
    many = spark.createDataFrame([(1, k) for k in range(2000)] + [(2, 0), (3, 0), (None, 1)], "k int, v int")
    few = spark.createDataFrame([(1, "a"), (2, "b"), (4, "c")], "k int, w string")
    hot = S.heavy_keys(many, ["k"])
    assert [r["k"] for r in hot.collect()] == [1]
    assert S.salted_join(many, few, ["k"], hot, ["v"]).count() == 2001 and S.salted_join(many, few, ["k"], hot, ["v"], "left").count() == 2003
    bits = S.bit_table(few, "w")
    assert S.sifted(few, "w", bits).count() == 3 and S.sifted(few, "w", bits, within=False).count() == 0
    assert S.sifted(many.withColumn("w", F.lit("zz")), "w", bits, within=False).count() == 2003


def test_a_full_bit_table_changes_no_result(spark, monkeypatch):
    """Far more keys than bits: everything may be in the table, the join that follows still tells."""
    monkeypatch.setattr(S, "BITS", 6)
    rows = spark.range(3000).selectExpr("id AS k", "id AS doc")
    gone = spark.range(0, 3000, 2).selectExpr("id AS g")
    assert S.bit_table(gone, "g").count() == 1
    assert sorted(r["doc"] for r in S.without(rows, F.col("k"), gone, "g").collect()) == list(range(1, 3000, 2))
    assert S.without(rows, F.col("k"), gone.limit(0), "g").count() == 3000 and S.without(rows.limit(0), F.col("k"), gone, "g").count() == 0


def test_hot_keys_follow_the_partitions(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        assert S.hot_share(spark, S.HOT) == S.HOT and S.salts(spark) == S.SALTS
        spark.conf.set("spark.sql.shuffle.partitions", "8000")
        assert S.hot_share(spark, S.HOT) == 1 / 8000 and S.salts(spark) == 500
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_edge_cases(spark):
    long = "very long " * 50_000
    rows = [(1, None, 9), (2, "", 9), (3, " \n ", 9), (4, "one", 9), (5, "One", 9), (None, "one", 9), (6, long, 9), (7, long, 9), (8, "a b c d e f", 9), (8, "a b c d e f", 9)]
    got = sorted(((r["doc_id"] is None, r["doc_id"] or 0, r["class_id"], r["class_size"]) for r in N.near_duplicate_classes(spark.createDataFrame(rows, "doc_id long, text string, class_id int")).collect()))
    assert got == [(False, 1, 1, 1), (False, 2, 2, 1), (False, 3, 3, 1), (False, 4, 4, 3), (False, 5, 4, 3), (False, 6, 6, 2), (False, 7, 6, 2), (False, 8, 8, 2), (False, 8, 8, 2), (True, 0, 4, 3)]
    kept = N.keep_representatives(spark.createDataFrame(rows, "doc_id long, text string, class_id int"))
    assert kept.columns == ["doc_id", "text", "class_id"]
    assert sorted(r["doc_id"] for r in kept.collect()) == [1, 2, 3, 4, 6, 8]
    assert classes(spark, []) == []
    few = spark.createDataFrame([(1, "a b c d e f"), (2, "A b c d e f"), (3, "x"), (None, None)], "doc_id long, text string")
    assert sorted(str(r["doc_id"]) for r in N.keep_representatives(few).collect()) == ["1", "3", "None"]
    assert N.keep_representatives(few.limit(0)).count() == 0


@pytest.mark.parametrize("weighted", [False, True])
def test_darts_estimate_similarity(weighted):
    k, r = 2000, np.random.default_rng(5)
    a, b = np.arange(0, 60, dtype=np.uint64), np.arange(20, 80, dtype=np.uint64)
    wa, wb = (r.uniform(0.2, 3, 80), r.uniform(0.2, 3, 80)) if weighted else (np.ones(80), np.ones(80))
    x = np.where(np.arange(80) < 60, wa, 0)
    y = np.where(np.arange(80) >= 20, wb, 0)
    s = N.dart_minhash(np.concatenate([a, b]) * np.uint64(0x9E3779B97F4A7C15), np.repeat([0, 1], 60), 2, k, np.concatenate([x[:60], y[20:]]) if weighted else None)
    assert abs((s[0] == s[1]).mean() - np.minimum(x, y).sum() / np.maximum(x, y).sum()) < 0.04
    assert (s != N.EMPTY).all()
