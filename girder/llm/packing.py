"""Packing documents into training sequences under several limits at once.

A document's token ids (and a final separator id) are cut into pieces; pieces
are placed in sequences by vector bin packing: each sequence takes, among the
pieces that fit under every limit (tokens, segments, loss-bearing tokens), the
piece with the largest dot product of its demand and the sequence's remaining
capacity, both as shares of the limits.

Documents bear loss on all their tokens. Instruction data do not: of
conversations only the assistant's turns do (``pack_conversations``), so the
three limits bind apart from each other. A conversation is cut where either its
tokens or its loss-bearing tokens reach their limit, so no piece is over one.

Cases: a null text is an empty one and gives the separator alone; rows with
the same doc_id are packed as separate documents with equal pieces; an empty
table gives no piece; a null doc_id (conv_id) is kept; messages of one turn
stand in the order of their text's hash; other columns are ignored.
"""

from __future__ import annotations

import base64
import heapq
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .storage import materialize, small_batches

TOKENS, SEGMENTS, SEPARATOR = 2048, 64, 1
#: Pieces that are packed together in one task; groups are dealt by a hash of the piece.
GROUP_PIECES = 4096
#: Characters on which the two tokenizer libraries surely agree; texts with others take the slower one.
_PLAIN = re.compile("[\n\r\t -~¡-ɏ‐-‧€]*")
_SPECIAL = "<|endoftext|>"


class Encoder:
    """Ids as the tokenizers library gives them, through the faster tiktoken where both surely agree."""

    def __init__(self, path: str, ranks: str | None = None):
        import tiktoken
        from public_tokenizers import PATTERN
        from tokenizers import Tokenizer

        self.exact = Tokenizer.from_file(path)
        self.fast = None
        if ranks:
            table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(ranks, "rb"))}
            self.fast = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=table, special_tokens={})

    def ids(self, text: str) -> np.ndarray:
        if self.fast is not None and _SPECIAL not in text and _PLAIN.fullmatch(text):
            return np.frombuffer(self.fast.encode_to_numpy(text, disallowed_special=()), np.uint32)
        return np.array(self.exact.encode(text, add_special_tokens=False).ids, np.uint32)


@lru_cache(maxsize=2)
def encoder(path: str, ranks: str | None = None) -> Encoder:
    return Encoder(path, ranks)


def _cut(path: str, ranks: str | None, limit: int):
    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path, ranks).ids
        for batch in batches:
            source, start, length, crc, total = [], [], [], [], []
            for i, text in enumerate(batch.column("text").to_pylist()):
                ids = np.append(encode(text or ""), np.uint32(SEPARATOR)).astype("<u4")
                raw, n = ids.tobytes(), len(ids)
                for s in range(0, n, limit):
                    e = min(s + limit, n)
                    source.append(i), start.append(s), length.append(e - s), crc.append(zlib.crc32(raw[4 * s : 4 * e])), total.append(n)
            columns = [batch.column("doc_id").take(pa.array(source, pa.int64())), *(pa.array(x, pa.int64()) for x in (start, length, crc, total))]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    return over


def pack_vectors(demand: np.ndarray, limits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bin, order within the bin) of each demand vector by the dot-product heuristic.

    Demands with equal vectors are alike, so each step scores the distinct
    vectors that remain; a bin is closed when nothing fits. A demand over a
    limit has a bin of its own.
    """
    kinds, of = np.unique(demand, axis=0, return_inverse=True)
    of = of.ravel()
    order = np.argsort(of, kind="stable")
    left = np.bincount(of, minlength=len(kinds))
    at = np.concatenate([[0], np.cumsum(left)[:-1]])
    share = kinds / limits
    box, place = np.empty(len(demand), np.int64), np.empty(len(demand), np.int64)
    bins = 0
    for k in np.flatnonzero((kinds > limits).any(axis=1)):
        mine = order[at[k] : at[k] + left[k]]
        box[mine], place[mine] = bins + np.arange(left[k]), 0
        bins, left[k] = bins + left[k], 0
    room, used = limits.astype(np.int64).copy(), 0
    alive = np.flatnonzero(left)
    while len(alive):
        fits = alive[(kinds[alive] <= room).all(axis=1)]
        if not len(fits):
            bins, used, room = bins + 1, 0, limits.astype(np.int64).copy()
            continue
        k = fits[np.argmax(share[fits] @ (room / limits))]
        i = order[at[k]]
        box[i], place[i] = bins, used
        at[k], left[k], used, room = at[k] + 1, left[k] - 1, used + 1, room - kinds[k]
        if not left[k]:
            alive = alive[alive != k]
    return box, place


def _pack(limits: tuple[int, int, int]):
    limit = np.array(limits)

    def over(key: tuple, pieces: pa.Table) -> pa.Table:
        pieces = pieces.sort_by("piece_id")
        length, loss = (pieces.column(c).to_numpy() for c in ("length", "loss"))
        box, place = pack_vectors(np.stack([length, np.ones_like(length), loss], axis=1), limit)
        order = np.lexsort([place, box])
        before = np.cumsum(length[order]) - length[order]
        first = np.flatnonzero(np.diff(box[order], prepend=-1))
        offset = np.empty_like(length)
        offset[order] = before - np.repeat(before[first], np.diff(np.append(first, len(order))))
        return pa.table({"piece_id": pieces.column("piece_id"), "length": length, "sequence_id": (int(key[0].as_py()) << 32) + box, "offset": offset})

    return over


def pack_pieces(pieces: DataFrame, tokens: int = TOKENS, segments: int = SEGMENTS, loss_tokens: int | None = None) -> DataFrame:
    """(piece_id, length, sequence_id, offset) of pieces (piece_id unique, length, loss: its loss-bearing tokens).

    Pieces are packed in groups of about GROUP_PIECES, dealt by a hash of
    piece_id, so no group grows with the table. A piece that fills a sequence
    is one by itself.
    """
    full = pieces.filter(F.col("length") >= tokens).select("piece_id", "length", (F.col("piece_id") + F.lit(1 << 62)).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    rest = pieces.filter(F.col("length") < tokens).select("piece_id", "length", "loss")
    groups = max(1, -(-rest.count() // GROUP_PIECES))
    dealt = rest.withColumn("g", F.pmod(F.xxhash64("piece_id"), F.lit(groups))).groupBy("g")
    packed = dealt.applyInArrow(_pack((tokens, segments, loss_tokens or tokens)), "piece_id long, length long, sequence_id long, offset long")
    return packed.unionByName(full)


def pack_documents(docs: DataFrame, tokenizer: str, ranks: str | None = None, tokens: int = TOKENS, segments: int = SEGMENTS, loss_tokens: int | None = None) -> DataFrame:
    """A row for each piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    ``tokenizer`` is a file of the tokenizers library, ``ranks`` the same
    vocabulary for tiktoken (optional, for speed). All ids of a document bear
    loss. A document longer than a sequence is cut into full pieces and a rest.
    """
    small_batches(docs.sparkSession)
    cut = docs.select("doc_id", "text").mapInArrow(_cut(tokenizer, ranks, tokens), "doc_id long, start long, length long, ids_crc32 long, doc_tokens long")
    pieces = materialize(cut.withColumn("piece_id", F.monotonically_increasing_id()), "pieces")
    placed = pack_pieces(pieces.withColumn("loss", F.col("length")), tokens, segments, loss_tokens).drop("length")
    return pieces.join(placed, "piece_id").drop("piece_id")


#: Turns of a conversation over which one window counts.
TURNS = 1024


def _count(path: str, ranks: str | None):
    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path, ranks).ids
        for batch in batches:
            n = [len(encode(text or "")) + 1 for text in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in ("conv_id", "turn", "th", "bears")] + [pa.array(n, pa.int64())], ["conv_id", "turn", "th", "bears", "n"])

    return over


def pack_conversations(messages: DataFrame, tokenizer: str, ranks: str | None = None, tokens: int = TOKENS, segments: int = SEGMENTS, loss_tokens: int = TOKENS // 2, bearing: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """A row for each part of a message: conv_id, turn, start (of the message's ids), length, loss, sequence_id, offset.

    A message's ids end with the separator's; those of the roles ``bearing``
    bear loss. A conversation's messages stand in the order of their turns; it is
    one segment, or as many as it must be cut into. No sequence has more than
    ``tokens`` ids, ``segments`` segments or ``loss_tokens`` ids that bear loss.
    Places within a conversation come from sums over blocks of TURNS turns, so a
    conversation of any length stays distributed.
    """
    small_batches(messages.sparkSession)
    turn = F.coalesce(F.col("turn"), F.lit(0)).cast("long")
    rows = messages.select(F.col("conv_id").cast("long").alias("conv_id"), turn.alias("turn"), F.xxhash64("role", "text").alias("th"), F.coalesce(F.col("role").isin(*bearing), F.lit(False)).alias("bears"), "text")
    counted = rows.mapInArrow(_count(tokenizer, ranks), "conv_id long, turn long, th long, bears boolean, n long")
    counted = materialize(counted.withColumns({"message": F.monotonically_increasing_id(), "block": F.floor(F.col("turn") / TURNS), "loss": F.when(F.col("bears"), F.col("n")).otherwise(0)}), "messages")
    order = Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = counted.groupBy("conv_id", "block").agg(F.sum("n").alias("n"), F.sum("loss").alias("loss"))
    before = [F.coalesce(F.sum(c).over(order), F.lit(0)).alias(f"{c}_before") for c in ("n", "loss")]
    blocks = blocks.select(F.col("conv_id").alias("c_"), F.col("block").alias("b_"), *before)
    within = Window.partitionBy("conv_id", "block").orderBy("turn", "th", "message").rowsBetween(Window.unboundedPreceding, -1)
    placed = counted.withColumns({f"{c}_in": F.coalesce(F.sum(c).over(within), F.lit(0)) for c in ("n", "loss")})
    placed = placed.join(blocks, F.col("conv_id").eqNullSafe(F.col("c_")) & (F.col("block") == F.col("b_")))
    placed = placed.withColumns({"s": F.col("n_before") + F.col("n_in"), "ls": F.col("loss_before") + F.col("loss_in")})
    # a message is cut at multiples of the limits
    multiples = lambda low, high, limit: F.filter(F.transform(F.sequence(F.floor(low / limit), F.floor(high / limit)), lambda k: k * limit), lambda x: (x > low) & (x < high))
    end = F.col("s") + F.col("n")
    by_loss = F.when(F.col("bears"), F.transform(multiples(F.col("ls"), F.col("ls") + F.col("n"), loss_tokens), lambda x: x - F.col("ls") + F.col("s"))).otherwise(F.array().cast("array<long>"))
    cuts = F.array_sort(F.array_distinct(F.concat(F.array(F.col("s"), end), multiples(F.col("s"), end, tokens), by_loss)))
    parts = placed.withColumn("cuts", cuts).select("conv_id", "turn", "message", "s", "ls", "bears", F.explode(F.arrays_zip(F.slice("cuts", F.lit(1), F.size("cuts") - 1).alias("a"), F.slice("cuts", F.lit(2), F.size("cuts") - 1).alias("b"))).alias("cut"))
    a, length = F.col("cut.a"), F.col("cut.b") - F.col("cut.a")
    loss_at = F.col("ls") + F.when(F.col("bears"), a - F.col("s")).otherwise(0)
    parts = materialize(parts.select("conv_id", "turn", (a - F.col("s")).alias("start"), a.alias("at"), length.alias("length"), F.when(F.col("bears"), length).otherwise(0).cast("long").alias("loss"), F.floor(a / tokens).alias("g1"), F.floor(loss_at / loss_tokens).alias("g2")), "parts")
    pieces = parts.groupBy("conv_id", "g1", "g2").agg(F.sum("length").alias("length"), F.sum("loss").alias("loss"), F.min("at").alias("first"))
    pieces = materialize(pieces.withColumn("piece_id", F.monotonically_increasing_id()), "pieces")
    packed = pack_pieces(pieces.select("piece_id", "length", "loss"), tokens, segments, loss_tokens).drop("length")
    where = pieces.select(F.col("conv_id").alias("c_"), F.col("g1").alias("g1_"), F.col("g2").alias("g2_"), "piece_id", "first").join(packed, "piece_id")
    joined = parts.join(where, F.col("conv_id").eqNullSafe(F.col("c_")) & (F.col("g1") == F.col("g1_")) & (F.col("g2") == F.col("g2_")))
    return joined.select("conv_id", "turn", "start", "length", "loss", "sequence_id", (F.col("offset") + F.col("at") - F.col("first")).alias("offset"))
