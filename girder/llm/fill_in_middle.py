"""Fill-in-the-middle forms of documents by big-integer bit-parallelism.

A text's bytes become class masks: ``bytes.translate`` writes a digit for each
byte and the digits are read as one integer, bit i for byte i. Shifts and boolean
operations on masks mark where units start, ``bit_count`` counts them, and
recursive halving selects the start of the unit of a given rank, so no byte or
unit is looked at by itself.

A document of n units is cut after j and after k units, j <= k: prefix, middle,
suffix. j, k, whether it is transformed and in which order its parts stand come
from the SHA-256 of ``seed:doc_id``, so a document has one form whatever the
partitions are.

Cases: a null text is an empty one, and an empty text stays plain with n = 0; a
null doc_id is hashed as an empty string; rows with the same doc_id draw the same
numbers; a text that holds one of the marks stays plain, so a form can always be
taken apart; bytes that aren't UTF-8 are kept (a character is counted for each
byte that doesn't continue one); other columns are ignored; an empty table gives an
empty result. A text of any length is one integer of an eighth of its bytes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .storage import small_batches

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
SEED = 7
#: Percent of documents that are transformed, and of those in the order suffix, prefix, middle.
RATE, SPM = 100, 50


def _table(members: bytes) -> bytes:
    """A translation of bytes to the digits 1 (in the class) and 0."""
    return bytes(49 if b in members else 48 for b in range(256))


_FEED = _table(b"\n")
_WORD = _table(bytes(b for b in range(256) if b not in b" \t\n\v\f\r"))
_CHAR = _table(bytes(b for b in range(256) if b & 0xC0 != 0x80))
UNITS = ("line", "word", "char")


def mask(data: bytes, digits: bytes) -> int:
    """An integer whose bit i tells whether byte i is in the class."""
    return int(data.translate(digits)[::-1], 2) if data else 0


def unit_starts(data: bytes, unit: str) -> int:
    """A bit for the first byte of each unit: lines with their line feed, words with the white space after them, characters."""
    if not data:
        return 0
    if unit == "line":
        return (mask(data, _FEED) << 1 | 1) & ((1 << len(data)) - 1)
    if unit == "word":
        inside = mask(data, _WORD)
        return inside & ~(inside << 1) | 1
    return mask(data, _CHAR) | 1


def select(bits: int, rank: int, width: int) -> int:
    """The place of the set bit of ``rank`` (from 0): the half that holds it is kept until one bit is left."""
    at = 0
    while width > 1:
        half = width >> 1
        low = bits & ((1 << half) - 1)
        n = low.bit_count()
        if rank < n:
            bits, width = low, half
        else:
            bits, rank, at, width = bits >> half, rank - n, at + half, width - half
    return at


def draws(doc_id: object, seed: int) -> tuple[int, int, int, int]:
    """Four 32-bit numbers of a document."""
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return tuple(int(digest[k : k + 8], 16) for k in (0, 8, 16, 24))


def transform(data: bytes, doc_id: object, unit: str = "line", seed: int = SEED, rate: int = RATE, spm: int = SPM) -> tuple[int, str, int | None, int | None, bytes]:
    """(units, form, characters of the prefix and of the middle, output) of one text."""
    p, s, m = (x.encode() for x in (PREFIX, SUFFIX, MIDDLE))
    starts = unit_starts(data, unit)
    n = starts.bit_count()
    h1, h2, h3, h4 = draws(doc_id, seed)
    if not data or p in data or s in data or m in data or h3 % 100 >= rate:
        return n, "plain", None, None, data
    a, b = (0 if k == 0 else len(data) if k == n else select(starts, k, len(data)) for k in sorted((h1 % (n + 1), h2 % (n + 1))))
    chars = mask(data, _CHAR)
    before, upto = ((chars & ((1 << k) - 1)).bit_count() for k in (a, b))
    prefix, middle, suffix = data[:a], data[a:b], data[b:]
    if h4 % 100 < spm:
        return n, "spm", before, upto - before, b"".join((s, suffix, p, prefix, m, middle))
    return n, "psm", before, upto - before, b"".join((p, prefix, s, suffix, m, middle))


def _over(unit: str, seed: int, rate: int, spm: int):
    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column("doc_id"), batch.column("data")
            made = [transform(texts[i].as_py() or b"", ids[i].as_py(), unit, seed, rate, spm) for i in range(len(texts))]
            n, form, prefix, middle, output = zip(*made, strict=True) if made else ([],) * 5
            columns = [pa.array(n, pa.int64()), pa.array(form, pa.string()), pa.array(prefix, pa.int64()), pa.array(middle, pa.int64()), pa.array(output, pa.binary())]
            yield pa.RecordBatch.from_arrays([ids, *columns], ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"])

    return over


def fill_in_middle(docs: DataFrame, unit: str = "line", seed: int = SEED, rate: int = RATE, spm: int = SPM) -> DataFrame:
    """A row for each document: doc_id, n (units), form (plain, psm, spm), prefix_chars, middle_chars (null if plain), output (text)."""
    if unit not in UNITS:
        raise ValueError(f"unit must be one of {UNITS}")
    small_batches(docs.sparkSession)
    kind = dict(docs.dtypes)["doc_id"]
    rows = docs.select("doc_id", F.col("text").cast("binary").alias("data"))
    made = rows.mapInArrow(_over(unit, seed, rate, spm), f"doc_id {kind}, n long, form string, prefix_chars long, middle_chars long, output binary")
    return made.withColumn("output", F.col("output").cast("string"))


def restored(form: Column, output: Column) -> Column:
    """The text from which a form was made: a transformed text holds no marks of its own, so its marks cut it into its parts."""
    parts = F.split(output, f"{PREFIX}|{SUFFIX}|{MIDDLE}")  # what stands before the first mark is empty
    return F.when(form == "psm", F.concat(parts[1], parts[3], parts[2])).when(form == "spm", F.concat(parts[2], parts[3], parts[1])).otherwise(output)
