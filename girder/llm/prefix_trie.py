"""The trie of conversations' prefixes by MSD radix partitioning over dictionary-encoded turns.

Turns (role, text) are encoded by a dictionary, so from then on a turn is a number and
no text is moved. Equal conversations are one sequence with a weight. All sequences start
in one bucket, the root; a bucket is a node of the trie with the sequences below it. A
bucket of more than LOCAL turns is split by the next turn with DataFrame operations: the
turns that all its sequences share are walked at once, then each turn that follows is a
bucket of its own. A bucket of at most LOCAL turns is local: buckets are dealt to bins of about
BIN turns, and in a bin multikey quicksort takes each bucket apart, turn by turn, and
writes a node for each run of equal turns. What a node sums over its subtree is added up
within a bucket where it is finished, and then bucket by bucket towards the root.

No group grows with the table: places in conversations come from range partitions and
the few rows where a conversation crosses into the next one; rows of a conversation meet
what belongs to it block by block (BLOCK turns); turns and buckets that hold more than
1/4096 of all rows meet their partners by a broadcast of fewer than 4096 rows; ids of
a node's members are joined in blocks of 65,536 ids and hashed as a stream. Rounds
are as many as there are branchings on the way to the deepest local bucket.

Cases: rows without a conv_id belong to no conversation; null role and text are empty;
messages of one turn stand in the order of their SHA-256, a null turn comes first; repeated
rows are turns of their own; a conversation without turns ends at the root; an empty
table has no node; other columns are ignored; texts of any length are read once, for
their digest and number of words.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .spread import joined, large_keys
from .storage import forget, materialize, small_batches

#: Turns of a bucket that one task finishes, of a bin of such buckets, and of a block of a conversation.
LOCAL, BIN, BLOCK = 4096, 1 << 14, 1024
#: Ids of members that are joined in one string: those that agree but for this many low bits.
ID_BITS = 16
#: First turns that a conversation may take from the first one of its twenty.
HEADS = 3
FAMILY = 20
NOTHING = hashlib.sha256(b"").hexdigest()
WORD = r"[^\x20\x09-\x0D]+"


def _number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Place of each row among the rows of its conversation in a sorted partition."""
    last, seen = None, 0
    for batch in batches:
        conv = batch.column("conv_id").to_numpy()
        if not len(conv):
            continue
        new = np.flatnonzero(np.concatenate([[conv[0] != last], conv[1:] != conv[:-1]]))
        at = np.arange(len(conv))
        run = np.searchsorted(new, at, "right") - 1
        place = np.where(run < 0, at + seen, at - new[np.maximum(run, 0)])
        last, seen = conv[-1], int(place[-1]) + 1
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("conv_id", "digest", "words")), pa.array(place.astype(np.int64))], ["conv_id", "digest", "words", "at"])


def encode(messages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Turns (conv_id, pos from 1, turn_id, words), and the dictionary (turn_id, digest, words, c: how often)."""
    small_batches(messages.sparkSession)
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    digest = F.unhex(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256))
    rows = messages.filter("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), "turn", digest.alias("digest"), F.regexp_count(text, F.lit(WORD)).cast("long").alias("words"))
    order = ["conv_id", "turn", "digest"]
    placed = rows.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(_number, "conv_id long, digest binary, words long, at long")
    placed = materialize(placed.withColumn("part", F.spark_partition_id()), "trie-placed")
    # a conversation goes on in a partition only as the first one there, so these are at most as many rows as partitions
    pieces = placed.groupBy("conv_id", "part").agg(F.count("*").alias("c"))
    before = F.sum("c").over(Window.partitionBy("conv_id").orderBy("part")) - F.col("c")
    crossing = pieces.select("conv_id", "part", before.alias("before")).filter("before > 0")
    counts = placed.groupBy("digest").agg(F.max("words").alias("words"), F.count("*").alias("c"))
    dictionary = materialize(counts.withColumn("turn_id", F.monotonically_increasing_id() + 1), "trie-dictionary")
    whole = placed.drop("words").join(F.broadcast(crossing), ["conv_id", "part"], "left").withColumn("pos", F.col("at") + 1 + F.coalesce("before", F.lit(0)))
    turns = joined(whole, dictionary.select("digest", "turn_id", "words"), ["digest"], large_keys(dictionary, ["digest"], "c"))
    turns = materialize(turns.select("conv_id", "pos", "turn_id", "words"), "trie-turns")
    forget(placed)
    return turns, dictionary


def _block(pos: Column, block: int) -> Column:
    return F.floor(pos / block).cast("long")


def _blocks(low: Column, high: Column, block: int) -> Column:
    """All blocks of the places from low to high."""
    return F.explode(F.sequence(_block(low, block), _block(high, block)))


def conversations(turns: DataFrame) -> DataFrame:
    """(conv_id, len) of each conversation."""
    return turns.groupBy("conv_id").agg(F.max("pos").alias("len"))


def graft(turns: DataFrame, block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """Turns and conversations (conv_id, len) with the heads of their families: the first h turns are those of conversation c - c % 20, the own first h are left out; h = crc32(c) % 4."""
    c = F.col("conv_id")
    convs = conversations(turns).select("conv_id", F.col("len").alias("own"), (F.crc32(c.cast("string")) % (HEADS + 1)).alias("h"), (c - c % FAMILY).alias("base"))
    heads = turns.filter((F.col("pos") <= HEADS) & (c % FAMILY == 0)).select(c.alias("base"), "pos", "turn_id", "words")
    has = heads.groupBy("base").agg(F.max("pos").alias("has"))
    taken = F.least(F.col("h"), F.coalesce("has", F.lit(0)))
    convs = convs.join(has, "base", "left").withColumn("taken", taken).withColumn("len", F.col("taken") + F.greatest(F.col("own") - F.col("h"), F.lit(0)))
    convs = materialize(convs.drop("has"), "trie-convs")
    lent = convs.filter("taken > 0").join(heads, "base").filter("pos <= taken")  # at most 3 turns and 39 conversations of a base
    met = convs.select("conv_id", "h", "taken", _blocks(F.lit(0), F.col("own"), block).alias("block"))
    own = turns.withColumn("block", _block(F.col("pos"), block)).join(met, ["conv_id", "block"]).filter("pos > h").withColumn("pos", F.col("pos") - F.col("h") + F.col("taken"))
    columns = ["conv_id", "pos", "turn_id", "words"]
    return materialize(lent.select(*columns).unionByName(own.select(*columns)), "trie-grafted"), convs.select("conv_id", "len")


def _hash_streams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 over the blocks of ids of each sequence, which come in order; only one digest is held."""
    seq, state = None, None
    for batch in batches:
        done = []
        for s, ids in zip(batch.column("seq").to_pylist(), batch.column("ids").to_pylist(), strict=True):
            if s == seq:
                state.update(b"," + ids.encode())
                continue
            if state is not None:
                done.append((seq, state.hexdigest()))
            seq, state = s, hashlib.sha256(ids.encode())
        yield pa.RecordBatch.from_arrays([pa.array([d[0] for d in done], pa.int64()), pa.array([d[1] for d in done], pa.string())], ["seq", "ends"])
    if state is not None:
        yield pa.RecordBatch.from_arrays([pa.array([seq], pa.int64()), pa.array([state.hexdigest()], pa.string())], ["seq", "ends"])


def sequences(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """Distinct conversations: seq (the smallest conv_id), n, len, ends (SHA-256 of all conv_ids, ascending, joined by commas). Equal means: of one length and two 64-bit sums over turns and places."""
    prints = turns.groupBy("conv_id").agg(F.bit_xor(F.xxhash64("turn_id", "pos")).alias("f1"), F.bit_xor(F.xxhash64("pos", "turn_id", F.lit(1))).alias("f2"))
    known = convs.join(prints, "conv_id", "left").na.fill(0, ["f1", "f2"])
    by = ["f1", "f2", "len"]
    blocks = known.groupBy(*by, F.shiftright("conv_id", ID_BITS).alias("high")).agg(F.sort_array(F.collect_list("conv_id")).alias("all"))  # at most 2^ID_BITS ids
    blocks = blocks.select(*by, "high", F.array_join(F.col("all").cast("array<string>"), ",").alias("ids"), F.col("all")[0].alias("low"), F.size("all").cast("long").alias("c"))
    blocks = materialize(blocks.withColumn("sha", F.sha2("ids", 256)), "trie-ids")
    classes = blocks.groupBy(*by).agg(F.min("low").alias("seq"), F.sum("c").alias("n"), F.count("*").alias("parts"), F.max("sha").alias("ends"))
    classes = materialize(classes, "trie-classes")
    wide = blocks.join(classes.filter("parts > 1").select(*by, "seq"), by).select("seq", "high", "ids")
    streamed = wide.repartition("seq").sortWithinPartitions("seq", "high").select("seq", "ids").mapInArrow(_hash_streams, "seq long, ends string")
    several = classes.filter("parts > 1").drop("ends").join(streamed, "seq")
    columns = ["seq", "n", "len", "ends"]
    out = materialize(classes.filter("parts = 1").select(*columns).unionByName(several.select(*columns)), "trie-sequences")
    forget(blocks, classes)
    return out


def quicksort_nodes(turn: list[int], word: list[int], first: list[int], size: list[int], conv: list[int], n: list[int], depth: int) -> dict[str, list]:
    """Nodes of the trie of a bucket's sequences by multikey quicksort, a parent before its children.

    Sequence s has the turns ``turn[first[s] : first[s] + size[s]]``; all share the
    first. Each step parts a group by one turn into less, equal and greater; the
    equal ones are a node and go on with the next turn.
    """
    out = {c: [] for c in ("parent", "conv", "depth", "n", "children", "leaves", "saved", "seq", "turn")}
    parent, convs, depths, ns, children, leaves, saved, seqs, turns = out.values()
    stack = [(list(range(len(first))), 0, -1)]
    while stack:
        group, k, above = stack.pop()
        keys = [turn[first[s] + k] for s in group]
        pivot = sorted((keys[0], keys[len(keys) // 2], keys[-1]))[1]
        less, equal, greater = [], [], []
        for s, key in zip(group, keys, strict=True):
            (less if key < pivot else greater if key > pivot else equal).append(s)
        for part in (less, greater):
            if part:
                stack.append((part, k, above))
        node, members = len(convs), sum(n[s] for s in equal)
        parent.append(above), convs.append(min(conv[s] for s in equal)), depths.append(depth + k), ns.append(members), turns.append(pivot)
        children.append(0), leaves.append(0), saved.append((members - 1) * word[first[equal[0]] + k])
        on = [s for s in equal if size[s] > k + 1]
        seqs.append(next((conv[s] for s in equal if size[s] == k + 1), None) if len(on) < len(equal) else None)
        if on:
            stack.append((on, k + 1, node))
    for node in range(len(convs) - 1, -1, -1):
        leaves[node] = leaves[node] or 1
        if parent[node] >= 0:
            children[parent[node]] += 1
            leaves[parent[node]] += leaves[node]
            saved[parent[node]] += saved[node]
    return out


_LOCAL = "round int, up long, top boolean, conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, seq long, turn_id long"


def _finish(bin_: pa.Table) -> pa.Table:
    """All nodes of the buckets of a bin."""
    bin_ = bin_.sort_by([(c, "ascending") for c in ("round", "bucket", "seq", "pos")])
    col = {c: bin_.column(c).to_numpy(zero_copy_only=False) for c in ("round", "bucket", "seq", "pos", "turn_id", "words", "n", "d", "up")}
    above = bin_.column("above").to_pylist()
    total = len(col["seq"])
    edge = np.ones(total, bool)
    edge[1:] = (col["bucket"][1:] != col["bucket"][:-1]) | (col["round"][1:] != col["round"][:-1])
    begins = edge.copy()
    begins[1:] |= col["seq"][1:] != col["seq"][:-1]
    names = [x.split()[0] for x in _LOCAL.split(", ")]
    rows = {c: [] for c in names}
    bounds = np.append(np.flatnonzero(edge), total)
    for lo, hi in zip(bounds[:-1], bounds[1:], strict=True):
        first = np.flatnonzero(begins[lo:hi])
        size = np.diff(np.append(first, hi - lo))
        at = first + lo
        made = quicksort_nodes(col["turn_id"][lo:hi].tolist(), col["words"][lo:hi].tolist(), first.tolist(), size.tolist(), col["seq"][at].tolist(), col["n"][at].tolist(), int(col["d"][lo]))
        k = len(made["conv"])
        rows["round"] += [int(col["round"][lo])] * k
        rows["up"] += [int(col["up"][lo])] * k
        rows["top"] += [p < 0 for p in made["parent"]]
        rows["parent_conv_id"] += [above[lo] if p < 0 else made["conv"][p] for p in made["parent"]]
        for name, key in (("conv_id", "conv"), ("depth", "depth"), ("n_convs", "n"), ("n_children", "children"), ("n_leaves", "leaves"), ("saved_tokens", "saved"), ("seq", "seq"), ("turn_id", "turn")):
            rows[name] += made[key]
    kinds = {"round": pa.int32(), "top": pa.bool_()}
    return pa.table([pa.array(rows[c], kinds.get(c, pa.int64())) for c in names], names)


NODE = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "seq", "turn_id"]
ROW = ["bucket", "up", "above", "size", "d", "seq", "n", "len", "pos", "turn_id", "words"]


def trie(turns: DataFrame, convs: DataFrame, local: int = LOCAL, bin_rows: int = BIN, block: int = BLOCK) -> DataFrame:
    """A row for each distinct prefix of the conversations: conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256, turn_id (the prefix's last turn, 0 at the root)."""
    seqs = sequences(turns, convs)
    total, least = seqs.agg(F.sum(F.col("len") + 1), F.min("seq")).first()
    total = total or 0
    met = seqs.select(F.col("seq").alias("conv_id"), "n", "len", _blocks(F.lit(0), F.col("len"), block).alias("block"))
    mine = turns.withColumn("block", _block(F.col("pos"), block)).join(met, ["conv_id", "block"]).withColumnRenamed("conv_id", "seq")
    roots = seqs.select("seq", "n", "len", *(F.lit(0).cast("long").alias(c) for c in ("pos", "turn_id", "words")))
    columns = roots.columns
    zero, nothing = F.lit(0).cast("long"), F.lit(None).cast("long")
    rows = mine.select(*columns).unionByName(roots).select(zero.alias("bucket"), zero.alias("up"), nothing.alias("above"), F.lit(total).cast("long").alias("size"), zero.alias("d"), *columns)
    rows = materialize(rows.select(*ROW), "trie-rows")
    members = seqs.agg(F.sum("n")).first()[0] or 0
    buckets = turns.sparkSession.createDataFrame([(0, 0, None, total, 0, least, members)] if total else [], "bucket long, up long, above long, size long, d long, conv long, n long")  # the root
    small, rounds = [], []
    while True:
        small.append(rows.filter(F.col("size") <= local).withColumn("round", F.lit(len(rounds))))
        big = buckets.filter(F.col("size") > local)
        large = large_keys(big, ["bucket"], "size")
        if big.isEmpty():
            break
        held = rows.filter(F.col("size") > local)
        levels = held.groupBy("bucket", "pos").agg(F.min("turn_id").alias("turn_id"), F.max("turn_id").alias("other"), F.max("words").alias("words"), F.min("len").alias("least"), F.max(F.when(F.col("len") == F.col("pos"), F.col("seq"))).alias("seq"))
        levels = materialize(levels, "trie-levels")
        # the turns that all sequences of the bucket share: up to the end of the shortest, or to the first difference
        reach = levels.groupBy("bucket").agg(F.least(F.min("least"), F.min(F.when(F.col("turn_id") != F.col("other"), F.col("pos") - 1))).alias("shared"))
        reach = materialize(reach.join(big.select("bucket", "up", "above", "d", "conv", "n"), "bucket"), "trie-reach")
        next_ = joined(held.select("bucket", "seq", "len", "pos", "turn_id", F.col("n").alias("weight")), reach.select("bucket", "shared", F.col("conv").alias("above")), ["bucket"], large).filter(F.col("pos") == F.col("shared") + 1)
        next_ = materialize(next_.select("bucket", "above", "seq", "len", "turn_id", "weight", "shared"), "trie-next")
        children = next_.groupBy("bucket", "turn_id").agg(F.min("seq").alias("conv"), F.sum("weight").alias("n"), F.sum(F.col("len") - F.col("shared")).alias("size"), F.count("*").alias("c"), F.first("above").alias("above"), F.first("shared").alias("shared"))
        children = materialize(children.withColumn("child", F.monotonically_increasing_id()), "trie-children")
        where = joined(next_.select("bucket", "turn_id", "seq", "len"), children.select("bucket", "turn_id", "child", "above", "shared", "size"), ["bucket", "turn_id"], large_keys(children, ["bucket", "turn_id"], "c"))
        where = where.select("seq", F.col("child").alias("bucket"), F.col("bucket").alias("up"), "above", "size", (F.col("shared") + 1).alias("d"), _blocks(F.col("shared") + 1, F.col("len"), block).alias("block"))
        on = held.select("seq", "n", "len", "pos", "turn_id", "words", _block(F.col("pos"), block).alias("block")).join(where, ["seq", "block"]).filter(F.col("pos") >= F.col("d"))
        rows = materialize(on.select(*ROW), "trie-rows")
        buckets = children.select(F.col("child").alias("bucket"), F.col("bucket").alias("up"), "above", "size", (F.col("shared") + 1).alias("d"), "conv", "n")
        rounds.append((levels, reach))
    every = reduce(DataFrame.unionByName, small)
    bins = max(1, -(-total // bin_rows))
    dealt = every.withColumn("bin", F.pmod(F.xxhash64("round", "bucket"), F.lit(bins)))
    nodes = materialize(dealt.select("bin", "round", "bucket", "up", "above", "d", "seq", "n", "pos", "turn_id", "words").groupBy("bin").applyInArrow(_finish, _LOCAL), "trie-local")
    parts, tops = [nodes.select(*NODE)], nodes.filter("top").select("round", "up", "n_leaves", "saved_tokens")
    below = None
    for r in range(len(rounds) - 1, -1, -1):
        levels, reach = rounds[r]
        under = tops.filter(F.col("round") == r + 1).drop("round")
        under = under if below is None else under.unionByName(below)
        sums = under.groupBy("up").agg(F.count("*").alias("c"), F.sum("n_leaves").alias("leaves"), F.sum("saved_tokens").alias("below"))
        facts = reach.join(sums.withColumnRenamed("up", "bucket"), "bucket", "left").withColumnRenamed("conv", "conv_id").na.fill({"c": 0, "leaves": 1, "below": 0})
        met = facts.withColumn("block", _blocks(F.col("d"), F.col("shared"), block))
        inside = levels.withColumn("block", _block(F.col("pos"), block)).join(met, ["bucket", "block"]).filter("pos <= shared")
        # words from a turn to the last shared one: within its block and in the blocks after it
        after = inside.groupBy("bucket", "block").agg(F.sum("words").alias("w"))
        after = after.select("bucket", "block", (F.sum("w").over(Window.partitionBy("bucket").orderBy(F.desc("block"))) - F.col("w")).alias("after"))
        rest = F.sum("words").over(Window.partitionBy("bucket", "block").orderBy(F.desc("pos")))
        last, start = F.col("pos") == F.col("shared"), F.col("pos") == F.col("d")
        chain = inside.withColumn("rest", rest).join(after, ["bucket", "block"])
        chain = chain.select(
            "conv_id", F.col("pos").alias("depth"), F.when(start, F.col("above")).otherwise(F.col("conv_id")).alias("parent_conv_id"), F.col("n").alias("n_convs"), F.when(last, F.col("c")).otherwise(1).cast("long").alias("n_children"),
            F.col("leaves").alias("n_leaves"), ((F.col("n") - 1) * (F.col("rest") + F.col("after")) + F.col("below")).alias("saved_tokens"), F.when(last, F.col("seq")).alias("seq"), "turn_id", "up", start.alias("start"),
        )
        chain = materialize(chain, "trie-upper")
        parts.append(chain.select(*NODE))
        below = chain.filter("start").select("up", "n_leaves", "saved_tokens")
    found = reduce(DataFrame.unionByName, parts)
    out = [c for c in NODE if c != "seq"]
    ending = found.filter("seq is not null").join(seqs.select("seq", F.col("ends").alias("ends_sha256")), "seq")
    return ending.select(*out, "ends_sha256").unionByName(found.filter("seq is null").select(*out, F.lit(NOTHING).alias("ends_sha256")))
