"""Near-duplicate classes of documents: DartMinHash signatures, banded candidates, exact verification.

Each text is the weighted set of its runs of five lower-case words (words end
at ASCII white space); a run's weight is how often it stands in the text. A
signature keeps, for each coordinate, the earliest dart that falls into the
region of one of the set's elements; a dart's chance to be shared is the
weighted Jaccard similarity, the sum of the smaller weights over the sum of the
larger. Bands of coordinates make candidates, and every link is verified by
the exact weighted similarity: with the k-th standing of a run as an element
of its own (``layered``), weighted sets become plain ones. Classes are the
connected components of verified pairs.

Texts aren't shuffled, but for those that share a band with another (a bit
table of fixed size keeps the others back), and once. Keys that many rows share
(bands, leaders, elements, labels) are salted.

Cases: a null or blank text is a class of its own; texts of one to four words
have one shingle; rows with equal words are one class whatever their doc_id;
a null doc_id is kept as it is and its class is named by the smallest non-null
doc_id in it (null if there is none); an empty table gives an empty result;
columns besides doc_id and text are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import texts as T
from .spread import HOT, SALTS, bit_table, heavy_keys, hot_share, salted_join, sifted, without
from .storage import forget, materialize, small_batches

WIDTH, THRESHOLD = 5, 0.8
#: A pair at the threshold shares a band with probability 1 - (1 - 0.8^6)^28 = 0.9998.
BANDS, ROWS = 28, 6
#: Rows that are signed at once: each takes some thousand darts, however short it is.
SIGNED_ROWS = 256
EMPTY = np.uint64(2**64 - 1)


def _cell(k: int) -> tuple[float, float]:
    """Rank cells: 0 to 1/8, then each as wide as all before it."""
    return (0.0, 0.125) if k == 0 else (0.125 * 2 ** (k - 1), 0.125 * 2**k)


def _poisson_steps(area: float) -> np.ndarray:
    """The Poisson distribution's steps on the scale of 64-bit integers: the number of steps at or below a hash is a count."""
    out, p, total, k = [], math.exp(-area), 0.0, 0
    while (total < 1 - 1e-15 or k < area) and k < area + 60 + 12 * math.sqrt(area):
        total += p
        out.append(min(total, 1 - 2**-53))
        k += 1
        p *= area / k
    return (np.array(out) * 2**64).astype(np.uint64)


def layered(element: np.ndarray, row: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A weighted element as one element for each unit of weight, with the height of what is left of the last unit."""
    layers = np.maximum(np.ceil(weight), 0).astype(np.int64)
    layer = np.arange(layers.sum()) - np.repeat(np.cumsum(layers) - layers, layers)
    return T.mix(np.repeat(element, layers) + T.mix(layer.astype(np.uint64))), np.repeat(row, layers), np.repeat(weight, layers) - layer


def dart_minhash(element: np.ndarray, row: np.ndarray, rows: int, k: int, weight: np.ndarray | None = None, seed: int = 1) -> np.ndarray:
    """Signatures (rows x k) of weighted sets by hashed darts.

    Over each element's half-plane of weight and rank lies a Poisson process of
    darts with unit density that depends on the element's hash alone; each dart
    belongs to one of k coordinates. A dart counts for a set if its weight
    coordinate is below the element's weight; the signature's coordinate is the
    rank of the earliest such dart. Ranks are visited in growing cells until
    k ln k + 2k darts are expected, then further for sets with an empty
    coordinate. Weights default to 1; sets without elements keep EMPTY.
    """
    if weight is not None:  # one layer of the half-plane for each unit of weight
        element, row, top = layered(element, row, weight)
    else:
        top = None
    total = np.bincount(row, minlength=rows).astype(float) if top is None else np.bincount(row, np.minimum(top, 1), minlength=rows)
    signature = np.full(rows * k, EMPTY)
    with np.errstate(divide="ignore"):
        reach = (k * math.log(k) + 2 * k) / total
    open_rows, c = total > 0, 0
    while open_rows.any():
        low, high = _cell(c)
        take = open_rows[row]
        e, r = T.mix(element[take] + np.uint64((2 * c + 1) * int(T.BASE) + seed & 2**64 - 1)), row[take]
        count = np.searchsorted(_poisson_steps(high - low), e, "right")
        some = count > 0
        e, r, count = e[some], r[some], count[some]
        dart = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        e, r = T.mix(np.repeat(e, count) + (dart.astype(np.uint64) + np.uint64(1)) * T.BASE_INVERSE), np.repeat(r, count)
        if top is not None:
            height = (T.mix(e ^ np.uint64(0x5851F42D4C957F2D)) >> np.uint64(11)).astype(float) * 2.0**-53
            under = height < np.repeat(top[take][some], count)
            e, r = e[under], r[under]
        rank = np.uint64(int(low * 2**40)) + ((e >> np.uint64(24)).astype(float) * (high - low)).astype(np.uint64)
        coordinate = (T.mix(e) % np.uint64(k)).astype(np.int64)
        np.minimum.at(signature, r * k + coordinate, rank)
        c += 1
        if high >= reach[open_rows].min():
            full = (signature.reshape(rows, k) != EMPTY).all(axis=1)
            open_rows &= ~(full & (reach <= high))
    return signature.reshape(rows, k)


def band_keys(signature: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """One hash for each band of a signature, the band's number included."""
    parts = signature[:, : bands * rows].reshape(len(signature), bands, rows)
    key = np.broadcast_to(T.mix(np.arange(1, bands + 1, dtype=np.uint64)), parts.shape[:2]).copy()
    for j in range(rows):
        key = T.mix(key * T.BASE + parts[:, :, j])
    return key.view(np.int64)


def _weighted(value: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles of each row, and how often each stands there."""
    _, at, n = np.unique(T.mix(value ^ T.mix(row.astype(np.uint64) + np.uint64(1))), return_index=True, return_counts=True)
    return value[at], row[at], n


def _signatures(bands: int, rows: int, width: int):
    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, texts in T.blocks(T.plain(batch.column("text")), rows=SIGNED_ROWS):
                value, row, words = T.shingles_of(texts, width)
                n_words = np.bincount(words.row, minlength=len(texts))
                place = np.arange(len(words.hash)) - np.repeat(np.cumsum(n_words) - n_words, n_words)
                prints = []
                for salt in (1, 2):
                    h = T.mix(words.hash + (place.astype(np.uint64) + np.uint64(1)) * T.BASE + np.uint64(salt))
                    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(h)])
                    ends = np.cumsum(n_words)
                    prints.append((total[ends] - total[ends - n_words]).view(np.int64))
                n = np.bincount(row, minlength=len(texts))
                value, row, weight = _weighted(value, row)
                keys = band_keys(dart_minhash(value, row, len(texts), bands * rows, weight), bands, rows)
                some = n > 0
                offsets = np.concatenate([[0], np.cumsum(some * bands)]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(keys[some].ravel()))
                cut = batch.slice(at, len(texts))
                yield pa.RecordBatch.from_arrays([cut.column("doc_id"), cut.column("th"), cut.column("rk"), *map(pa.array, prints), pa.array(n.astype(np.int64)), lists], ["doc_id", "th", "rk", "fp1", "fp2", "n", "bands"])

    return over


#: Bits of a text's parity map, as longs.
PARITY = 8
MAPS = [f"p{k}" for k in range(PARITY)]


def _element_lists(width: int):
    """Elements of each text, and their parity map: each element flips one of 64 * PARITY bits."""

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, texts in T.blocks(T.plain(batch.column("text"))):
                value, row, _ = layered(*_weighted(*T.shingles_of(texts, width)[:2]))
                order = np.argsort(row, kind="stable")
                offsets = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=len(texts)))]).astype(np.int32)
                bit = (T.mix(value) % np.uint64(64 * PARITY)).astype(np.int64)
                odd = np.bincount(row * 64 * PARITY + bit, minlength=len(texts) * 64 * PARITY) % 2
                maps = np.packbits(odd.astype(np.uint8)).view(np.int64).reshape(len(texts), PARITY)
                cut = batch.slice(at, len(texts))
                yield pa.RecordBatch.from_arrays([cut.column("uid"), cut.column("n"), *(pa.array(np.ascontiguousarray(maps[:, k])) for k in range(PARITY)), pa.ListArray.from_arrays(pa.array(offsets), pa.array(value[order].view(np.int64)))], ["uid", "n", *MAPS, "elements"])

    return over


def components(edges: DataFrame) -> DataFrame:
    """(uid, label) of every node of the edges (a, b): label is the smallest uid that can be reached.

    Each round takes every node's smallest neighbour (or itself) as its parent,
    jumps twice to parents' parents, and puts parents in the place of nodes;
    edges within one parent go, the others stay once each, so they soon are
    few. At last the rounds' parents are followed from the last to the first.
    Hot nodes are salted.
    """
    left, rounds, heavies = materialize(edges.select("a", "b").distinct(), "edges"), [], []
    while True:
        both = left.unionByName(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
        near = materialize(both.groupBy(F.col("a").alias("uid")).agg(F.least(F.col("uid"), F.min("b")).alias("parent")), "near")
        hot = materialize(heavy_keys(near.withColumnRenamed("parent", "up"), ["up"]), "heavy")
        up = near.select(F.col("uid").alias("up"), "parent")
        jumped = salted_join(near.withColumnRenamed("parent", "up"), up, ["up"], hot, ["uid"])
        parents = materialize(salted_join(jumped.select("uid", F.col("parent").alias("up")), up, ["up"], hot, ["uid"]).select("uid", "parent"), "parents")
        rounds.append(parents)
        hot_a, hot_b = (materialize(heavy_keys(left, [x]), "heavy") for x in "ab")
        moved = salted_join(left, parents.toDF("a", "pa"), ["a"], hot_a, ["b"])
        moved = salted_join(moved, parents.toDF("b", "pb"), ["b"], hot_b, ["a"]).filter("pa <> pb")
        after = materialize(moved.select(F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b")).distinct(), "edges")
        forget(left, near, hot, hot_a, hot_b)
        left = after
        if left.limit(1).count() == 0:
            break
    labels = rounds[-1].toDF("uid", "label")
    for parents in reversed(rounds[:-1]):  # a round's parent may have a parent of later rounds
        heavies.append(materialize(heavy_keys(parents, ["parent"]), "heavy"))
        found = salted_join(parents, labels.withColumnRenamed("uid", "parent"), ["parent"], heavies[-1], ["uid"], "left")
        labels = found.select("uid", F.coalesce("label", "parent").alias("label"))
    out = materialize(labels, "labels")
    forget(left, *rounds, *heavies)
    return out


def _sized(a: Column, b: Column, threshold: float) -> Column:
    """A pair whose sizes differ too much can't reach the threshold."""
    return F.least(a, b) >= F.greatest(a, b) * (threshold - 1e-9)


def _alike(threshold: float) -> Column:
    """Sets of na and nb elements differ in at least as many as their parity maps (p, o) in bits; similar ones in (1 - threshold) / (1 + threshold) of both sizes at most."""
    differ = F.lit(0)
    for p in MAPS:
        differ = differ + F.bit_count(F.col(p).bitwiseXOR(F.col(f"o{p}")))
    return differ <= (F.col("na") + F.col("nb")) * ((1 - threshold) / (1 + threshold)) + 1e-6


def near_duplicate_classes(docs: DataFrame, bands: int = BANDS, rows: int = ROWS, width: int = WIDTH, threshold: float = THRESHOLD) -> DataFrame:
    """One row for each row of ``docs``: doc_id, th (xxhash64 of the text), class_id, class_size, representative (boolean).

    A bucket never emits all its pairs: it links its members to two leaders.
    Members of buckets that still hold several classes then meet across
    classes by an exact prefix filter (``_across``), so no link is lost that
    the bands find.
    """
    small_batches(docs.sparkSession)
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("th"), F.xxhash64(F.col("doc_id").cast("long"), "text").alias("rk"))
    members = materialize(keyed.mapInArrow(_signatures(bands, rows, width), "doc_id long, th long, rk long, fp1 long, fp2 long, n long, bands array<long>"), "signatures")
    # equal texts become one node; the witness tells which row has the text
    nodes = members.filter("n > 0").groupBy("fp1", "fp2").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "th", "rk")).alias("w"), F.first("n").alias("n"), F.count("*").alias("copies"), F.first("bands").alias("bands"))
    nodes = materialize(nodes.select(F.monotonically_increasing_id().alias("uid"), "fp1", "fp2", "w.doc_id", "w.th", "w.rk", "n", "copies", "bands"), "nodes")
    buckets = nodes.select("uid", F.explode("bands").alias("key"))
    leaders = materialize(buckets.groupBy("key").agg(F.min("uid").alias("lo"), F.max("uid").alias("hi"), F.count("*").alias("c")).filter("lo <> hi"), "leaders")
    share = hot_share(docs.sparkSession, HOT)
    hot = materialize(leaders.filter(F.col("c") > max(1000, int(nodes.count() * share))).select("key"), "heavy")  # at most bands / share keys
    met = sifted(buckets, "key", bit_table(leaders, "key"))
    shared = materialize(salted_join(met, leaders.select("key", "lo", "hi"), ["key"], hot, ["uid"]), "buckets")
    lists = materialize(_lists(keyed, nodes, shared, width), "elements")

    star = shared.select("uid", F.explode(F.array("lo", "hi")).alias("x")).filter("uid <> x")
    pairs = materialize(star.select(F.least("uid", "x").alias("a"), F.greatest("uid", "x").alias("b")).distinct(), "pairs")
    edges = materialize(_verified(lists, pairs, threshold), "links")
    labels = components(edges)

    named = shared.select("key", "uid").join(labels, "uid", "left").withColumn("label", F.coalesce("label", "uid"))
    named = materialize(named, "named")
    mixed = named.groupBy("key").agg(F.min("label").alias("least"), F.max("label").alias("most")).filter("least <> most").select("key")
    mixed = materialize(salted_join(named, mixed, ["key"], hot, ["uid"]).select("uid", "label").distinct(), "mixed")
    more = materialize(_across(lists, mixed, threshold), "links")
    if more.limit(1).count():
        labels = components(edges.unionByName(more))
    forget(leaders, shared, hot, lists, pairs, edges, named, mixed, more)

    nodes = nodes.join(labels, "uid", "left").withColumn("label", F.coalesce("label", "uid"))
    classes = nodes.groupBy("label").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "th")).alias("w"), F.sum("copies").alias("class_size"))
    heavy = nodes.filter(F.col("copies") > F.lit(share) * members.count()).select("fp1", "fp2")
    nodes = nodes.select("label", "fp1", "fp2").join(classes, "label")
    found = salted_join(members.select("doc_id", "th", "fp1", "fp2"), nodes, ["fp1", "fp2"], heavy, ["doc_id"], "left")
    alone = F.col("w").isNull()
    return found.select(
        "doc_id", "th",
        F.when(alone, F.col("doc_id")).otherwise(F.col("w.doc_id")).alias("class_id"),
        F.coalesce("class_size", F.lit(1)).cast("long").alias("class_size"),
        (alone | (F.col("doc_id").eqNullSafe(F.col("w.doc_id")) & (F.col("th") == F.col("w.th")))).alias("representative"),
    )


def _lists(keyed: DataFrame, nodes: DataFrame, shared: DataFrame, width: int) -> DataFrame:
    """(uid, n, parity map, elements) of the nodes that share a bucket; only their texts are moved."""
    of = materialize(nodes.join(shared.select("uid").distinct(), "uid", "left_semi").select("uid", "rk", "n"), "wanted")
    texts = sifted(keyed.select("rk", "text"), "rk", bit_table(of, "rk")).groupBy("rk").agg(F.first("text").alias("text"))
    return texts.join(of, "rk").select("uid", "n", "text").mapInArrow(_element_lists(width), "uid long, n long, " + ", ".join(f"{p} long" for p in MAPS) + ", elements array<long>")


def _verified(lists: DataFrame, pairs: DataFrame, threshold: float) -> DataFrame:
    """Pairs (a, b) of nodes that are similar enough: sizes and parity maps first, then the elements of what is left."""
    side = lambda to, n, mark, *more: lists.select(F.col("uid").alias(to), F.col("n").alias(n), *[F.col(p).alias(f"{mark}{p}") for p in MAPS])
    hot = materialize(heavy_keys(pairs, ["a"]), "heavy")
    close = pairs.join(side("b", "nb", "o"), "b")
    close = salted_join(close, side("a", "na", ""), ["a"], hot, ["b"]).filter(_sized(F.col("na"), F.col("nb"), threshold) & _alike(threshold)).select("a", "b", "na", "nb")
    close = materialize(close, "close")
    both = close.join(lists.select(F.col("uid").alias("b"), F.col("elements").alias("eb")), "b")
    both = salted_join(both, lists.select(F.col("uid").alias("a"), F.col("elements").alias("ea")), ["a"], hot, ["b"])
    common = F.size(F.array_intersect("ea", "eb"))
    return both.filter(common >= threshold * (F.col("na") + F.col("nb") - common) - 1e-9).select("a", "b")


#: Classes of size in which texts meet: each holds sizes up to this ratio.
SIZE_STEP = 1.1


def _across(lists: DataFrame, mixed: DataFrame, threshold: float) -> DataFrame:
    """Similar pairs (a, b) of texts of different classes (``mixed``: uid, label), found by exact filters.

    Elements that one text alone has meet nothing: with ``known`` others of its
    n elements a text can be similar only to texts of a size from threshold n
    to (1 + threshold) / threshold known - n, and needs known >= threshold n.
    Prefix: two similar sets share an element among the n - ceil(threshold n) + 1
    rarest ones of each. Elements are met by class of size, so those that very
    many texts share meet only what can be as similar; of an element's texts
    those of all classes but the largest meet the others, and texts of one
    class never do. Place: beyond the first element that a pair shares both
    must have enough left.
    """
    own = materialize(lists.join(mixed, "uid"), "own")
    rows = own.select("uid", F.explode("elements").alias("element"))
    common = materialize(rows.groupBy("element").agg(F.count("*").alias("c")).filter("c > 1"), "common")
    whole, share = own.agg(F.sum("n")).first()[0] or 0, hot_share(lists.sparkSession, HOT)
    hot = materialize(common.filter(F.col("c") > max(1000, int(whole * share))).select("element"), "heavy")
    by_text = Window.partitionBy("uid")  # one text's elements
    kept = salted_join(rows, common, ["element"], hot, ["uid"]).withColumn("known", F.count("*").over(by_text)).withColumn("place", F.row_number().over(by_text.orderBy("c", "element")))
    room = F.col("n") - F.ceil(F.col("n") * threshold - 1e-9) + 1 - (F.col("n") - F.col("known"))
    prefix = kept.join(own.drop("elements"), "uid").filter((F.col("known") >= F.col("n") * threshold - 1e-9) & (F.col("place") <= room))
    prefix = materialize(prefix.drop("c"), "prefixes")
    sizes = prefix.groupBy("element", "label").agg(F.count("*").alias("size"))
    largest = materialize(sizes.groupBy("element").agg(F.max(F.struct("size", "label")).alias("top"), F.count("*").alias("labels"), F.sum("size").alias("rows_")).filter("labels > 1"), "largest")
    hot = materialize(largest.filter(F.col("rows_") > max(1000, int(prefix.count() * share))).select("element"), "heavy")
    step = lambda x: F.floor(F.log(x) / math.log(SIZE_STEP)).cast("int")
    targets = prefix.select("element", step(F.col("n").cast("double")).alias("size"), F.col("uid").alias("b"), F.col("n").alias("nb"), F.col("known").alias("kb"), F.col("place").alias("lb"), F.col("label").alias("of_b"), *[F.col(p).alias(f"o{p}") for p in MAPS])
    few = salted_join(prefix, largest.select("element", "top"), ["element"], hot, ["uid"]).filter(F.col("label") != F.col("top.label"))
    low, high = F.col("na") * (threshold - 1e-9), F.least(F.col("na") / (threshold - 1e-9), F.col("ka") * ((1 + threshold) / threshold) - F.col("na") + 1e-6)
    few = few.select("element", F.col("uid").alias("a"), F.col("n").alias("na"), F.col("known").alias("ka"), F.col("place").alias("la"), F.col("label").alias("of_a"), *MAPS).withColumn("reach", high)
    few = few.filter(F.col("reach") >= low).withColumn("size", F.explode(F.sequence(step(F.greatest(low, F.lit(1.0))), step(F.greatest(F.col("reach"), F.lit(1.0))))))
    need = (F.col("na") + F.col("nb")) * (threshold / (1 + threshold)) - 1e-6
    left = 1 + F.least(F.col("ka") - F.col("la"), F.col("kb") - F.col("lb"))
    met = salted_join(few, targets, ["element", "size"], hot, ["a"], parts=SALTS).filter((F.col("of_a") != F.col("of_b")) & (F.col("nb") <= F.col("reach")) & _sized(F.col("na"), F.col("nb"), threshold) & (left >= need) & _alike(threshold))
    pairs = materialize(met.select(F.least("a", "b").alias("x"), F.greatest("a", "b").alias("y")).distinct().toDF("a", "b"), "pairs")
    return _verified(lists, pairs, threshold)


def keep_representatives(docs: DataFrame, **parameters) -> DataFrame:
    """``docs`` with one row of each class; blank texts stay. Of equal rows of one doc_id one stays.

    Rows that surely stay aren't moved: a bit table of the others' keys tells.
    """
    classes = near_duplicate_classes(docs, **parameters)
    known = classes.groupBy("doc_id", "th").agg(F.max("representative").alias("stays"), F.count("*").alias("times")).filter("not stays or times > 1")
    known = materialize(known.select(F.xxhash64("doc_id", "th").alias("k"), "stays"), "decided")
    key = F.xxhash64(F.col("doc_id").cast("long"), F.xxhash64("text"))
    if known.filter("stays").limit(1).count() == 0:
        return without(docs, key, known, "k")
    # rows that stand several times with one doc_id: one of them stays
    packed = docs.select(F.struct(*docs.columns).alias("row"), key.alias("girder_key"))
    bits = bit_table(known, "k")
    doubted = sifted(packed, "girder_key", bits).join(known.groupBy(F.col("k").alias("girder_key")).agg(F.max("stays").alias("stays")), "girder_key", "left").filter("coalesce(stays, true)")
    once, many = doubted.filter("stays is null"), doubted.filter("stays").dropDuplicates(["girder_key"])
    return sifted(packed, "girder_key", bits, within=False).select("row.*").unionByName(once.select("row.*")).unionByName(many.select("row.*"))
