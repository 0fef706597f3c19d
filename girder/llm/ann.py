"""Nearest neighbours by low-dimensional stable projections in a kd-tree.

Vectors are projected to M dimensions by independent normal (2-stable)
directions, so a squared projected distance over the squared distance follows
a chi-square law with M degrees of freedom. Projections are indexed in one
kd-tree: its upper levels, learned from a bounded sample (SAMPLE_ROWS vectors,
chosen by a hash), deal all vectors to leaves; each leaf's vectors have a
kd-tree of their own. A query visits leaves by their least projected distance,
in rounds of 1, GROWTH, GROWTH^2, ... leaves. After each round the distance of
the farthest neighbour found is its reach, and the search ends at the first
leaf whose box is met only after the chi-square test stops with probability
SURE, so what a round finds keeps the next ones short. In a leaf, parts are
visited in the same order and verified by true distance until the test holds.

A round moves the vectors of the leaves that some query visits, and a query to
its leaves of the round. Leaves hold about LEAF_ROWS vectors; larger ones (far
more rows than the sample's leaves allow for, or many equal projections) are
cut by a hash, and a leaf's queries are dealt to groups of about QUERIES, so
the size of a group doesn't grow with the tables. Of equal vectors the k + 1
with the smallest ids can be neighbours, so only they are indexed, and equal
queries are searched once.

How many leaves are visited depends on the data alone: clusters end the search
early, but where the nearest neighbours are hardly nearer than any vector (as
in noise of many dimensions) no projection tells leaves apart, and all are met.

Cases: null or zero vectors, and vectors with null or non-finite components
or with another length than most, take no part (as queries or candidates);
repeated rows of a vec_id count once (the row with the smallest hash);
with fewer candidates than k all are returned; null ids take no part; ties go
to the smaller vec_id; an empty table gives an empty result; other columns
are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .spread import heavy_keys, salted_join
from .storage import forget, materialize, small_batches

M, PART, SURE, LEAF_ROWS = 8, 64, 0.99, 8192
#: Vectors from which the upper levels of the tree are learned, and the most leaves that they have: both bound what goes through the driver.
SAMPLE_ROWS, MOST_LEAVES = 1 << 18, 1 << 15
#: Queries of a group, about; by how much a round has more leaves than the one before.
QUERIES, GROWTH = 4096, 8


def chi_square(x: np.ndarray | float, m: int = M):
    """Distribution function for an even number of degrees of freedom."""
    half = np.asarray(x, float) / 2
    term, total = np.ones_like(half), np.zeros_like(half)
    for k in range(m // 2):
        total += term
        term = term * half / (k + 1)
    return 1 - np.exp(-half) * total


def stop_ratio(sure: float, m: int = M) -> float:
    """The ratio of squared projected to squared true distance beyond which the test holds."""
    low, high = 0.0, 1e3
    for _ in range(100):
        middle = (low + high) / 2
        low, high = (middle, high) if chi_square(middle, m) < sure else (low, middle)
    return high


def projection(dimensions: int, m: int = M, seed: int = 7) -> np.ndarray:
    return np.random.default_rng(seed).standard_normal((dimensions, m))


class Tree:
    """A kd-tree over projected points: ``order`` holds the points by leaf, ``edges`` their places there, ``low`` and ``high`` the leaves' boxes; ``cuts`` are (axis, value) of the inner nodes from the root on."""

    def __init__(self, points: np.ndarray, leaf: int = PART):
        self.points, self.order = points, np.arange(len(points))
        spans, self.cuts = [(0, len(points))], []
        while spans and max(b - a for a, b in spans) > leaf:  # one level after the other, all leaves at the same depth
            after = []
            for a, b in spans:
                mine = points[self.order[a:b]]
                wide = mine.max(axis=0) - mine.min(axis=0) if b > a else np.zeros(points.shape[1])
                axis, half = int(wide.argmax()), (b - a) // 2
                if b - a > 1:
                    self.order[a:b] = self.order[a:b][np.argpartition(mine[:, axis], half)]
                self.cuts.append((axis, float(points[self.order[a + half], axis]) if b > a else 0.0))
                after += [(a, a + half), (a + half, b)]
            spans = after
        spans = [(a, b) for a, b in spans if b > a]
        self.edges = np.array([0] + [b for _, b in spans])
        self.low = np.array([points[self.order[a:b]].min(axis=0) for a, b in spans]).reshape(len(spans), -1)
        self.high = np.array([points[self.order[a:b]].max(axis=0) for a, b in spans]).reshape(len(spans), -1)


def routed(cuts: list[tuple[int, float]], points: np.ndarray) -> np.ndarray:
    """The leaf of each point under the cuts of a tree."""
    at, depth = np.zeros(len(points), np.int64), (len(cuts) + 1).bit_length() - 1
    axis, value = np.array([c[0] for c in cuts], int), np.array([c[1] for c in cuts])
    for _ in range(depth):
        at = 2 * at + 1 + (points[np.arange(len(points)), axis[at]] >= value[at])
    return at - len(cuts)


def least(low: np.ndarray, high: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Least squared distances of points (or one point) to boxes."""
    gap = np.maximum(np.maximum(low - q, q - high), 0)
    return (gap * gap).sum(axis=-1)


def search(tree: Tree, vectors: np.ndarray, ids: np.ndarray, q: np.ndarray, q_projected: np.ndarray, k: int, ratio: float, reach: float = np.inf) -> tuple[np.ndarray, np.ndarray]:
    """(ids, squared distances) of the k nearest met before the stopping test holds; ``vectors`` and ``ids`` stand in the tree's order, ``reach`` is a squared distance within which k neighbours are known."""
    best_d, best_id = np.zeros(0), np.zeros(0, np.int64)
    near = least(tree.low, tree.high, q_projected)
    visit, at, size = np.argsort(near, kind="stable"), 0, 4
    while at < len(visit):
        worst = min(reach, best_d[-1] if len(best_d) == k else np.inf)
        group = visit[at : at + size]
        group = group[near[group] <= ratio * worst]
        if not len(group):
            break
        rows = np.concatenate([np.arange(tree.edges[g], tree.edges[g + 1]) for g in group])
        true = vectors[rows] - q
        best_d, best_id = np.concatenate([best_d, (true * true).sum(axis=1)]), np.concatenate([best_id, ids[rows]])
        first = np.lexsort([best_id, best_d])[:k]
        best_d, best_id = best_d[first], best_id[first]
        at, size = at + size, min(2 * size, 64)
    good = best_d <= reach
    return best_id[good], best_d[good]


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def _in_leaf(k: int, sure: float):
    def over(_: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        """Left: queries with their reach; right: vectors of a leaf."""
        out_q, out_id, out_d = [], [], []
        if left.num_rows and right.num_rows:
            vectors, queries = _matrix(right.column("v")), _matrix(left.column("v"))
            directions = projection(vectors.shape[1])
            tree, ratio = Tree(vectors @ directions), stop_ratio(sure)
            vectors, ids = vectors[tree.order], right.column("vec_id").to_numpy()[tree.order]
            for own, q, p, reach in zip(left.column("query_id").to_pylist(), queries, queries @ directions, left.column("reach").to_pylist(), strict=True):
                found, d = search(tree, vectors, ids, q, p, k, ratio, np.inf if reach is None else reach)
                out_q.append(np.full(len(found), own)), out_id.append(found), out_d.append(d)
        one = lambda x, kind: np.concatenate(x) if x else np.zeros(0, kind)
        return pa.table({"query_id": one(out_q, np.int64), "vec_id": one(out_id, np.int64), "d": one(out_d, np.float64)})

    return over


def _placed(cuts: list[tuple[int, float]]):
    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Vectors with their leaf and projections."""
        for batch in batches:
            if batch.num_rows:
                v = _matrix(batch.column("v"))
                p = v @ projection(v.shape[1])
                yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("v"), pa.array(routed(cuts, p)), *(pa.array(np.ascontiguousarray(p[:, j])) for j in range(M))], ["vec_id", "v", "leaf", *(f"p{j}" for j in range(M))])

    return over


def _visits(leaves: np.ndarray, low: np.ndarray, high: np.ndarray, sure: float, begin: int, end: int, cuts: dict[int, tuple[int, int]] | None):
    """Places ``begin`` to ``end`` of the leaves by their least distance from each query, within its reach: (leaf, n) by batch, or with ``cuts`` (parts and groups of each leaf) the queries that go there."""

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ratio = stop_ratio(sure)
        for whole in batches:
            for k in range(0, whole.num_rows, 64):
                batch = whole.slice(k, 64)
                v = _matrix(batch.column("v"))
                reach = np.nan_to_num(batch.column("reach").to_numpy(zero_copy_only=False).astype(float), nan=np.inf)
                row, leaf = [], []
                for j, q in enumerate(v @ projection(v.shape[1])):
                    near = least(low, high, q)
                    mine = np.argsort(near, kind="stable")[begin:end]
                    mine = mine[near[mine] <= ratio * reach[j]]
                    row.append(np.full(len(mine), j)), leaf.append(mine)
                row, leaf = np.concatenate(row), leaves[np.concatenate(leaf)]
                if cuts is None:
                    each, n = np.unique(leaf, return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(each), pa.array(n)], ["leaf", "n"])
                    continue
                parts, groups = np.array([cuts[x] for x in leaf.tolist()], np.int64).reshape(-1, 2).T
                of = np.repeat(np.arange(len(row)), parts)
                part = np.arange(len(of)) - np.repeat(np.cumsum(parts) - parts, parts)
                take = pa.array(row[of])
                own = batch.column("query_id").to_numpy()[row[of]].astype(np.uint64)
                group = (own * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(32)).astype(np.int64) % groups[of]
                columns = [batch.column(c).take(take) for c in ("query_id", "v", "reach")] + [pa.array(x) for x in (leaf[of], part, group)]
                yield pa.RecordBatch.from_arrays(columns, ["query_id", "v", "reach", "leaf", "part", "group"])

    return over


def usable(vectors: DataFrame, column: str = "embedding") -> DataFrame:
    """(vec_id, v) of vectors that take part."""
    v = F.col(column).cast("array<double>")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    good = vectors.filter(F.col("vec_id").isNotNull() & v.isNotNull() & fine).select("vec_id", v.alias("v"))
    return good.groupBy("vec_id").agg(F.min_by("v", F.xxhash64("v")).alias("v"))


def nearest(vectors: DataFrame, every: int = 100, k: int = 10, sure: float = SURE, leaf_rows: int = LEAF_ROWS, queries: int = QUERIES, visited: list[tuple[int, int, int]] | None = None) -> DataFrame:
    """query_id, rank, vec_id, score of the k nearest other vectors of each query (vec_id divisible by ``every``). ``visited`` gets (leaves that queries visited, distinct queries, leaves) of each round."""
    spark = vectors.sparkSession
    small_batches(spark)
    good = materialize(usable(vectors).withColumn("width", F.size("v")), "vectors")
    widths = good.groupBy("width").count().orderBy(F.desc("count"), "width").limit(1).collect()
    if not widths:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    good = good.filter(F.col("width") == widths[0]["width"]).select("vec_id", "v")
    equal = Window.partitionBy("v").orderBy("vec_id")  # limited in each task before the shuffle, so a vector that many rows share stays small
    held = materialize(good.withColumn("copy", F.row_number().over(equal)).filter(F.col("copy") <= k + 1).drop("copy"), "distinct")

    rows = held.count()
    share = min(1 << 30, (SAMPLE_ROWS << 30) // max(1, rows))
    names = [f"p{j}" for j in range(M)]
    schema = "vec_id long, v array<double>, leaf long, " + ", ".join(f"{n} double" for n in names)
    sample = held.filter(F.pmod(F.xxhash64("vec_id", F.lit(11)), F.lit(1 << 30)) < share).mapInArrow(_placed([]), schema)
    points = np.column_stack([c.to_numpy() for c in sample.select(*names).toArrow().columns])  # about SAMPLE_ROWS x M numbers
    depth = 0
    while (leaf_rows << depth) < rows and (1 << depth) < min(MOST_LEAVES, len(points) // 8):
        depth += 1
    cuts = Tree(points, -(-len(points) >> depth)).cuts[: (1 << depth) - 1] if depth else []
    placed = materialize(held.mapInArrow(_placed(cuts), schema), "placed")
    boxes = placed.groupBy("leaf").agg(F.count("*").alias("n"), *[f(n) for f in (F.min, F.max) for n in names]).orderBy("leaf").toPandas()  # MOST_LEAVES rows at most
    leaves, parts = boxes["leaf"].to_numpy(np.int64), -(-boxes["n"].to_numpy(np.int64) // (4 * leaf_rows))
    low, high = (boxes.iloc[:, 2 + j * M : 2 + (j + 1) * M].to_numpy(float) for j in (0, 1))

    # equal queries are searched once, under their smallest id
    asked = good.filter(F.col("vec_id") % every == 0)
    named = materialize(asked.groupBy("v").agg(F.min("vec_id").alias("query_id")), "queries")
    order = Window.partitionBy("query_id").orderBy("d", "vec_id")
    found, begin, end = None, 0, 1
    while begin < len(leaves):
        asking = named.select("query_id", "v", F.lit(None).cast("double").alias("reach"))
        if found is not None:
            reach = found.groupBy("query_id").agg(F.when(F.count("*") == k + 1, F.max("d")).alias("reach"))
            asking = materialize(named.join(reach, "query_id", "left").select("query_id", "v", "reach"), "asking")
        going = asking.mapInArrow(_visits(leaves, low, high, sure, begin, end, None), "leaf long, n long").groupBy("leaf").agg(F.sum("n").alias("n")).toPandas()  # MOST_LEAVES rows at most
        if visited is not None:
            visited.append((int(going["n"].sum()), named.count(), len(leaves)))
        if going.empty:
            break
        cuts_ = {int(x): (int(parts[np.searchsorted(leaves, x)]), -(-int(n) // queries)) for x, n in zip(going["leaf"], going["n"], strict=True)}
        cut = F.broadcast(spark.createDataFrame([(x, *c) for x, c in cuts_.items()], "leaf long, parts long, groups long"))  # MOST_LEAVES rows at most
        dealt = placed.join(cut, "leaf").select("vec_id", "v", "leaf", F.pmod(F.xxhash64("vec_id"), F.col("parts")).alias("part"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("groups") - 1)).alias("group"))
        sent = asking.mapInArrow(_visits(leaves, low, high, sure, begin, end, cuts_), "query_id long, v array<double>, reach double, leaf long, part long, group long")
        met = sent.groupBy("leaf", "part", "group").cogroup(dealt.groupBy("leaf", "part", "group")).applyInArrow(_in_leaf(k + 1, sure), "query_id long, vec_id long, d double")
        before, both = found, met if found is None else found.unionByName(met)
        found = materialize(both.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k + 1).drop("rank"), "found")
        forget(*[t for t in (before, asking) if t is not None])
        begin, end = end, end + GROWTH * (end - begin)
    forget(held, placed)
    found = spark.createDataFrame([], "query_id long, vec_id long, d double") if found is None else found
    found = found.withColumnRenamed("query_id", "named")
    # each query has the results of its vector, without itself
    mine = asked.join(named.withColumnRenamed("query_id", "named"), "v").select(F.col("vec_id").alias("query_id"), "named")
    mine = materialize(mine, "asked")
    out = salted_join(mine, found, ["named"], heavy_keys(mine, ["named"]), ["query_id"]).filter("vec_id <> query_id")
    order = Window.partitionBy("query_id").orderBy("d", "vec_id")
    return out.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", F.sqrt("d").alias("score"))
