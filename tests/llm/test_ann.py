import math

import numpy as np
import pytest

from girder.llm import ann as A


def brute(rows, every=100, k=10):
    ok = {i: np.array(v, float) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)}
    out = {}
    for i, v in ok.items():
        if i % every == 0:
            found = sorted((float(np.sqrt(((v - w) ** 2).sum())), j) for j, w in ok.items() if j != i)[:k]
            out[i] = found
    return out


def got(spark, rows, **parameters):
    out = {}
    for r in A.nearest(spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<float>, v int"), **parameters).orderBy("query_id", "rank").collect():
        out.setdefault(r["query_id"], []).append((r["score"], r["vec_id"]))
    return out


def test_recall_against_brute_force(spark):
    r = np.random.default_rng(4)
    centres = r.normal(size=(20, 32))
    rows = [(k, np.float32(centres[k % 20] + 0.3 * r.normal(size=32)).tolist()) for k in range(3000)]
    found, wanted = got(spark, rows, leaf_rows=100), brute(rows)
    assert set(found) == set(wanted)
    hits = sum(len({j for _, j in found[q]} & {j for _, j in wanted[q]}) for q in wanted)
    assert hits >= 0.95 * 10 * len(wanted)


def test_edge_cases(spark):
    inf, nan = float("inf"), float("nan")
    rows = [(0, [1.0, 0.0]), (100, [1.0, 0.0]), (5, [2.0, 0.0]), (6, [2.0, 0.0]), (7, None), (8, [0.0, 0.0]), (9, [None, 1.0]), (10, [inf, 1.0]), (11, [nan, 1.0]), (None, [1.0, 1.0]), (200, []), (5, [2.0, 0.0])]
    found = got(spark, rows)
    assert found == {0: [(0.0, 100), (1.0, 5), (1.0, 6)], 100: [(0.0, 0), (1.0, 5), (1.0, 6)]}
    assert got(spark, []) == {}
    assert got(spark, [(100, [1.0, 2.0])]) == {}


def test_many_equal_vectors(spark):
    rows = [(k, [1.0, 2.0, 3.0]) for k in range(1000)] + [(1000 + k, [float(k), 1.0, 1.0]) for k in range(50)]
    found = got(spark, rows)
    assert all([d for d, _ in found[q]] == [0.0] * 10 for q in range(0, 1000, 100))
    assert [j for _, j in found[500]] == list(range(10))


def test_chi_square():
    assert A.chi_square(A.stop_ratio(0.9)) == pytest.approx(0.9)
    r = np.random.default_rng(0)
    x = (r.standard_normal((200_000, A.M)) ** 2).sum(axis=1)
    assert (x <= A.stop_ratio(0.9)).mean() == pytest.approx(0.9, abs=0.005)


def test_reach_shrinks_and_groups_are_bounded(spark):
    """Clusters end the search early; groups of two queries find what larger ones find."""
    r = np.random.default_rng(5)
    centres = 4 * r.normal(size=(40, 24))
    rows = [(k, np.float32(centres[k % 40] + 0.3 * r.normal(size=24)).tolist()) for k in range(4000)]
    seen = []
    found, wanted = got(spark, rows, every=50, leaf_rows=64, visited=seen), brute(rows, every=50)
    assert sum(n for n, _, _ in seen) < 0.3 * seen[0][1] * seen[0][2] and len(seen) > 1
    hits = sum(len({j for _, j in found[q]} & {j for _, j in wanted[q]}) for q in wanted)
    assert hits >= 0.95 * 10 * len(wanted)
    assert got(spark, rows, every=50, leaf_rows=64, queries=2) == found
