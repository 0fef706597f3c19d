"""Convex hulls and smallest rectangles of groups of points, merged from partial hulls.

Cases: points with a null or non-finite coordinate and groups without a key are
left out; repeated points count once for the hull; a group on one point or line has a
hull of its ends, no area and fills of 1; an empty table gives no group.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

#: Points that a task keeps before it reduces them to hulls.
BUFFER = 1 << 16
#: Points of a group that aren't worth a hull of their own before the last one.
FEW = 32
#: Parts in which a group's partial hulls are merged before the last merge.
PARTS = 64


def hull(points: np.ndarray) -> np.ndarray:
    """Corners of the convex hull (n x 2), counter-clockwise from the lowest x, without points on its sides; by monotone chains."""
    points = np.unique(points, axis=0)  # sorted by x, then y
    if len(points) < 3:
        return points

    def chain(order: list[list[float]]) -> list[list[float]]:
        out: list[list[float]] = []
        for p in order:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (p[1] - out[-2][1]) <= (out[-1][1] - out[-2][1]) * (p[0] - out[-2][0]):
                out.pop()
            out.append(p)
        return out[:-1]

    # at one x only the lowest and the highest point can be corners
    x = points[:, 0]
    first, last = np.searchsorted(x, np.unique(x), "left"), np.searchsorted(x, np.unique(x), "right") - 1
    points = points[np.unique(np.concatenate([first, last]))]
    listed = points.tolist()
    return np.array(chain(listed) + chain(listed[::-1]))


def area(ring: np.ndarray) -> float:
    """Area of a ring of corners."""
    x, y = ring[:, 0] - ring[0, 0], ring[:, 1] - ring[0, 1]
    return abs(float(np.sum(x * np.roll(y, -1) - np.roll(x, -1) * y))) / 2


def smallest_rectangle(ring: np.ndarray) -> float:
    """Area of the smallest rectangle, at any angle, around a hull: one side of it lies on a side of the hull, and its other three touch corners that only move onwards from side to side."""
    n = len(ring)
    if n < 3:
        return 0.0
    along = np.roll(ring, -1, axis=0) - ring
    along = along / np.hypot(along[:, 0], along[:, 1])[:, None]
    at = lambda v, i: v[0] * ring[i % n, 0] + v[1] * ring[i % n, 1]
    best, right, top, left = np.inf, 1, 1, 1
    for i in range(n):
        u, v = along[i], (-along[i, 1], along[i, 0])
        right = max(right, i + 1)
        while at(u, right + 1) > at(u, right):
            right += 1
        top = max(top, right)
        while at(v, top + 1) > at(v, top):
            top += 1
        left = max(left, top)
        while at(u, left + 1) < at(u, left):
            left += 1
        best = min(best, (at(u, right) - at(u, left)) * (at(v, top) - at(v, i)))
    return float(best)


def _reduced(keys: list, key: np.ndarray, xy: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys and points, in the order of keys, that hold the hull of each key; keys of more than FEW points are reduced to it."""
    # at one x of a key only its lowest and highest point can be corners
    order = np.lexsort((xy[:, 1], xy[:, 0], key))
    key, xy = key[order], xy[order]
    fresh = np.ones(len(key), bool)
    fresh[1:] = (key[1:] != key[:-1]) | (xy[1:, 0] != xy[:-1, 0])
    ends = fresh | np.append(fresh[1:], True)[: len(key)]
    key, xy = key[ends], xy[ends]
    cuts = np.flatnonzero(np.diff(key, prepend=-1))
    if not len(cuts):
        return key, xy
    size = np.diff(np.append(cuts, len(key)))
    if not (size > FEW).any():
        return key, xy
    made = [hull(part) if len(part) > FEW else part for part in np.split(xy, cuts[1:])]
    return np.repeat(key[cuts], [len(m) for m in made]), np.concatenate(made)


def _partial(key_type: pa.DataType):
    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes: dict = {}
        key, xy, n = np.zeros(0, np.int64), np.zeros((0, 2)), np.zeros(0, np.int64)

        def out() -> pa.RecordBatch:
            names = list(codes)
            counts = np.zeros(len(key), np.int64)
            first = np.flatnonzero(np.diff(key, prepend=-1))
            counts[first] = n[key[first]]  # a key's count stands at its first point
            return pa.RecordBatch.from_arrays([pa.array([names[k] for k in key.tolist()], key_type), pa.array(xy[:, 0]), pa.array(xy[:, 1]), pa.array(counts)], ["k", "x", "y", "n"])

        for batch in batches:
            fresh = np.array([codes.setdefault(v, len(codes)) for v in batch.column("k").to_pylist()], np.int64)
            n = np.concatenate([n, np.zeros(len(codes) - len(n), np.int64)])
            np.add.at(n, fresh, batch.column("n").to_numpy())
            key = np.concatenate([key, fresh])
            xy = np.concatenate([xy, np.stack([batch.column("x").to_numpy(), batch.column("y").to_numpy()], axis=1)])
            if len(key) > BUFFER:
                key, xy = _reduced(list(codes), key, xy)
                if len(key) > BUFFER // 2:  # many groups: hand on what there is
                    yield out()
                    codes, key, xy, n = {}, np.zeros(0, np.int64), np.zeros((0, 2)), np.zeros(0, np.int64)
        key, xy = _reduced(list(codes), key, xy)
        if len(key):
            yield out()

    return over


def _last(key: tuple, rows: pa.Table) -> pa.Table:
    ring = hull(np.stack([rows.column("x").to_numpy(), rows.column("y").to_numpy()], axis=1))
    size = ring.max(axis=0) - ring.min(axis=0)
    box, own = float(size[0] * size[1]), area(ring) if len(ring) > 2 else 0.0
    rectangle = smallest_rectangle(ring)
    flat = len(ring) < 3 or box <= 0
    values = [pa.array([key[0].as_py()], rows.schema.field("k").type), [int(np.sum(rows.column("n").to_numpy()))], [[{"x": x, "y": y} for x, y in ring.tolist()]], [own], [box], [rectangle], [1.0 if flat else own / box], [1.0 if flat or rectangle <= 0 else own / rectangle]]
    return pa.table(values, ["k", "n", "hull", "area", "box_area", "rectangle_area", "fill", "rectangle_fill"])


def convex_hulls(points: DataFrame, by: str, x: str, y: str) -> DataFrame:
    """(by, n, hull, area, box_area, rectangle_area, fill, rectangle_fill) of each group of points.

    hull: its corners as an array of (x, y), counter-clockwise; fill: the hull's share of the box around it;
    rectangle: the smallest one at any angle. Each task reduces the points it reads to a
    hull for each group, the partial hulls of a group are merged in PARTS tasks and
    at last in one, which thus sees at most PARTS hulls of a group.
    """
    kind = dict(points.dtypes)[by]
    schema = f"k {kind}, x double, y double, n long"
    finite = [F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf")) for c in ("x", "y")]
    rows = points.select(F.col(by).alias("k"), F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"), F.lit(1).cast("long").alias("n")).filter(F.col("k").isNotNull() & finite[0] & finite[1])
    partial = _partial(to_arrow_type(points.schema[by].dataType))
    tasks = rows.mapInArrow(partial, schema).withColumn("part", F.pmod(F.spark_partition_id(), F.lit(PARTS)))
    merged = tasks.repartition("k", "part").drop("part").mapInArrow(partial, schema)
    out = merged.groupBy("k").applyInArrow(_last, f"k {kind}, n long, hull array<struct<x: double, y: double>>, area double, box_area double, rectangle_area double, fill double, rectangle_fill double")
    return out.withColumnRenamed("k", by)
