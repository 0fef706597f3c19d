"""Language identification by prediction by partial matching (PPM).

For each language a context tree over bytes holds, for every context of up to
ORDER bytes, how often each byte followed. A text's code length under a
language is the sum over its bytes of -log2 p(byte | longest known context);
an unseen byte escapes to the next shorter context with probability
distinct / (total + distinct) and at last to a uniform 1/256. Statistics are
frozen before scoring, so the cost of a byte is a fixed function of its
context and itself: the trees are compiled into tables, and a text is scored by
look-ups alone. Only bytes that some language has seen behind a context have a
row of costs there; other bytes point to the next shorter context's row, with
the escapes on the way. So the tables grow with what was seen, not with all
bytes of all contexts for all languages; contexts are kept, the most frequent
first, as long as they fit in MODEL_BYTES.

The trees are learned from a bounded sample: about SAMPLE_DOCS distinct texts of
each language, chosen by a hash of the text; copies of a text count once.

Cases: a null text, and one without a letter, is ``und`` with score 0; equal
code lengths go to the language that sorts first; rows without a language
teach nothing; with no training rows all texts are ``und``; other columns are
ignored.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import texts as T
from .storage import materialize, small_batches

ORDER = 3
SAMPLE_DOCS = 300
#: Bytes of the compiled tables at most.
MODEL_BYTES = 128 << 20
UND = "und"
#: Bytes that are scored at once; sums are carried over within a text.
CHUNK = 1 << 17


def _count_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of (language, byte string of 1 to ORDER + 1 bytes), summed over each block."""
    for batch in batches:
        for at, texts in T.blocks(T.plain(batch.column("text"))):
            lang = np.array(batch.column("lang").slice(at, len(texts)).to_pylist(), object)
            data, offsets = T.string_buffers(texts)
            row = np.repeat(np.arange(len(texts)), np.diff(offsets))
            place = np.arange(len(data)) - np.repeat(offsets[:-1], np.diff(offsets))
            for one in sorted(set(lang)):
                mine = lang[row] == one
                gram = np.zeros(mine.sum(), np.int64)
                wide, where = data.astype(np.int64), np.flatnonzero(mine)
                for k in range(ORDER + 1):
                    gram = gram | (wide[where - k] << (8 * k))
                    keys, n = np.unique(gram[place[where] >= k], return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array([one] * len(keys)), pa.array(np.full(len(keys), k + 1, np.int32)), pa.array(keys), pa.array(n.astype(np.int64))], ["lang", "size", "gram", "n"])


def placed(hash_: Column) -> Column:
    """A hash's place between 0 and 1: its upper 53 bits, as many as a double holds."""
    return F.shiftrightunsigned(hash_, 11).cast("double") / float(1 << 53)


def share_of(texts: Column, most: int) -> Column:
    """The share of hashes that leaves about ``most`` of so many texts; it isn't rounded, so it is 0 for no number of texts."""
    return F.least(F.lit(1.0), F.lit(float(most)) / texts)


def bounded_sample(docs: DataFrame, by: str, most: int) -> DataFrame:
    """Distinct texts with the smallest hashes: about ``most`` of each value of ``by``, all if there are fewer."""
    hash_ = F.xxhash64("text", F.lit(17))
    rates = docs.groupBy(F.col(by).alias("of_")).agg(F.approx_count_distinct(hash_).alias("texts_"))
    # written first, so its size is known and texts aren't shuffled to meet a few values
    rates = materialize(rates.select("of_", share_of(F.col("texts_"), most).alias("share_")), "rates")
    few = docs.join(rates, docs[by] == F.col("of_")).filter(placed(hash_) < F.col("share_"))
    return few.withColumn("hash_", hash_).dropDuplicates([by, "hash_"]).select(*docs.columns)


class Model:
    """The compiled trees.

    ``contexts`` are the states (shorter ones first). ``row`` and ``depth`` tell
    for each state and byte the row of ``cost`` and how many escapes lead to it;
    ``escape`` sums the first escapes of each state by language; ``kind`` maps
    bytes to the kinds that stand in contexts (0: none).
    """

    def __init__(self, languages: list[str], contexts: list[tuple[int, int]], row: np.ndarray, depth: np.ndarray, cost: np.ndarray, escape: np.ndarray):
        self.languages, self.contexts, self.row, self.depth, self.cost, self.escape = languages, contexts, row, depth, cost, escape
        seen = sorted({gram >> 8 * j & 255 for size, gram in contexts for j in range(size)})
        self.kind = np.zeros(256, np.int32)
        self.kind[seen] = np.arange(1, len(seen) + 1)

    def table(self) -> np.ndarray:
        """The state of every three kinds of bytes: that of their longest suffix which any tree has as a context."""
        by_size: list[dict[int, int]] = [{} for _ in range(ORDER + 1)]
        n = int(self.kind.max()) + 1
        for state, (size, gram) in enumerate(self.contexts):
            by_size[size][sum(int(self.kind[gram >> 8 * j & 255]) * n**j for j in range(size))] = state
        table = np.full(1, by_size[0][0], np.int32)
        for size in range(1, ORDER + 1):
            table = np.tile(table, n)
            grams = np.fromiter(by_size[size].keys(), np.int64, len(by_size[size]))
            table[grams] = np.fromiter(by_size[size].values(), np.int32, len(by_size[size]))
        return table


def fit(docs: DataFrame, sample_docs: int = SAMPLE_DOCS) -> Model | None:
    """Learn the trees from (text, lang). The sample bounds what comes to the driver: the sample's distinct byte strings."""
    sample = bounded_sample(docs.filter("lang is not null and text is not null").select("text", "lang"), "lang", sample_docs)
    counts = sample.mapInArrow(_count_grams, "lang string, size int, gram long, n long").groupBy("lang", "size", "gram").agg(F.sum("n").alias("n")).toPandas()
    languages = sorted(counts["lang"].unique())
    if not languages:
        return None
    return compile_trees(languages, {x: list(zip(g["size"], g["gram"], g["n"], strict=True)) for x, g in counts.groupby("lang")})


def compile_trees(languages: list[str], grams: dict[str, list[tuple[int, int, int]]], most_bytes: int = MODEL_BYTES) -> Model:
    """Tables of all languages over the contexts that any of them has, as many as fit."""
    trees: list[dict[tuple[int, int], list[tuple[int, int]]]] = []
    weight: dict[tuple[int, int], int] = defaultdict(int)
    for x in languages:
        tree = defaultdict(list)
        for size, gram, n in grams[x]:
            c = int(size) - 1, int(gram) >> 8
            tree[c].append((int(gram) & 255, int(n)))
            weight[c] += int(n)
        trees.append(tree)
    # a context takes a row number and a depth for each byte, and costs for the bytes seen
    taken, kept = 0, {(0, 0)}
    for c in sorted(weight, key=lambda c: (c[0], -weight[c], c[1])):
        seen = len({b for tree in trees for b, _ in tree.get(c, ())})
        taken += 256 * 5 + 4 * len(languages) * (seen + ORDER + 2)
        if taken > most_bytes and c[0]:
            break
        kept.add(c)
    contexts = sorted(kept)
    state = {c: i for i, c in enumerate(contexts)}
    n_lang = len(languages)
    row, depth = np.zeros((len(contexts), 256), np.int32), np.zeros((len(contexts), 256), np.uint8)
    escape = np.zeros((len(contexts), ORDER + 2, n_lang), np.float32)
    cost: list[np.ndarray] = [np.full(n_lang, 8.0)]  # row 0: what no context has seen
    for c in contexts:  # shorter contexts come first
        size, gram = c
        i = state[c]
        parent = None if size == 0 else state[size - 1, gram & ((1 << 8 * (size - 1)) - 1)]
        own = np.zeros(n_lang)
        seen: dict[int, np.ndarray] = {}
        for k, tree in enumerate(trees):
            if c in tree:
                whole = sum(n for _, n in tree[c]) + len(tree[c])
                own[k] = -np.log2(len(tree[c]) / whole)
        # escapes from here: none, this context's, and those of the parents
        for d in range(1, ORDER + 2):
            escape[i, d] = own + (escape[parent, d - 1] if parent is not None else 0)
        row[i], depth[i] = (0, 1) if parent is None else (row[parent], depth[parent] + 1)
        for k, tree in enumerate(trees):
            if c in tree:
                whole = sum(n for _, n in tree[c]) + len(tree[c])
                for b, n in tree[c]:
                    if b not in seen:
                        up = cost[0] if parent is None else cost[row[parent, b]] + escape[parent, depth[parent, b]]
                        seen[b] = up + own
                    seen[b][k] = -np.log2(n / whole)
        for b, bits in seen.items():
            row[i, b], depth[i, b] = len(cost), 0
            cost.append(bits)
    return Model(languages, contexts, row, depth, np.array(cost, np.float32), escape)


def code_lengths(texts: pa.Array, model: Model, table: np.ndarray) -> np.ndarray:
    """Bits of each text (no nulls) under each language."""
    data, offsets = T.string_buffers(texts)
    n_lang, kinds = len(model.languages), int(model.kind.max()) + 1
    out = np.zeros((len(texts), n_lang))
    row_of = np.repeat(np.arange(len(texts), dtype=np.int32), np.diff(offsets))
    start = offsets[:-1][np.diff(offsets) > 0]
    row, depth, escape = model.row.reshape(-1), model.depth.reshape(-1), model.escape.reshape(-1, n_lang)
    for low in range(0, len(data), CHUNK):
        high = min(low + CHUNK, len(data))
        head = max(0, low - ORDER)
        part = model.kind[data[head:high]]
        before = np.zeros((ORDER, high - low), np.int32)
        for k in range(1, ORDER + 1):
            lead = max(0, k - (low - head))
            before[k - 1, lead:] = part[low - head + lead - k : high - head - k]
        # the first bytes of a text have contexts of fewer bytes: kind 0 stands for what isn't there
        for j in range(ORDER):
            at = start + j
            at = at[(at >= low) & (at < high)]
            before[j:, at - low] = 0
        state = table[sum(before[k] * kinds**k for k in range(ORDER))]
        at = state * 256 + data[low:high]
        bits = model.cost[row[at]] + escape[state * (ORDER + 2) + depth[at]]
        edges = np.flatnonzero(np.diff(row_of[low:high], prepend=-1))
        rows = row_of[low:high][edges]
        out[rows] += np.add.reduceat(bits, edges, axis=0, dtype=np.float64)
    return out


def _score(model):
    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        table, names = m.table(), np.array([*m.languages, UND], object)
        for batch in batches:
            for at, texts in T.blocks(T.plain(batch.column("text"))):
                cut = batch.slice(at, len(texts))
                bits = code_lengths(texts, m, table)
                best = bits.argmin(axis=1)
                share = 1 / np.exp2(np.clip(bits.min(axis=1, keepdims=True) - bits, -1000, 0)).sum(axis=1)
                known = cut.column("letter").to_numpy(zero_copy_only=False)
                columns = [cut.column("doc_id"), cut.column("held_out"), pa.array(names[np.where(known, best, len(m.languages))].tolist(), pa.string()), pa.array(np.where(known, share, 0.0)), pa.array(np.where(known, bits.min(axis=1), np.nan), from_pandas=True)]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "held_out", "lang_pred", "score", "bits"])

    return over


def has_letter(text: Column) -> Column:
    return F.coalesce(text.rlike(r"\p{L}"), F.lit(False))


def predict(docs: DataFrame, model: Model | None) -> DataFrame:
    """doc_id, held_out (both as given), lang_pred, score (the language's posterior share) and bits (its code length)."""
    rows = docs.select("doc_id", "held_out", "text", has_letter(F.col("text")).alias("letter"))
    if model is None:
        return rows.select("doc_id", "held_out", F.lit(UND).alias("lang_pred"), F.lit(0.0).alias("score"), F.lit(None).cast("double").alias("bits"))
    frozen = docs.sparkSession.sparkContext.broadcast(model)
    return rows.mapInArrow(_score(frozen), "doc_id long, held_out boolean, lang_pred string, score double, bits double")


def identify(docs: DataFrame, sample_docs: int = SAMPLE_DOCS) -> DataFrame:
    """Learn from the documents that aren't held out (crc32 of the doc_id's text mod 3 is not 1), predict all of them."""
    small_batches(docs.sparkSession)
    marked = docs.withColumn("held_out", F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False)))
    return predict(marked, fit(marked.filter(~F.col("held_out")), sample_docs))
