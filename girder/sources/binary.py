"""Fixed-layout records in binary streams, and the deflate chunks that hold them.

A layout says what stands where; one vectorised scan serves all record kinds.
Streams come as (path, content) rows of bounded pages.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field
from functools import reduce
from operator import and_, mul

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KINDS = {"u16": ("<u2", 2), "u32": ("<u4", 4), "i64": ("<i8", 8), "u64": ("<u8", 8), "f64": ("<f8", 8)}


@dataclass(frozen=True)
class Tail:
    """What stands behind a list of ``unit`` bytes an entry: the number of entries (``least`` to ``most``) is the u32 at ``count``, the list begins at ``begin``, and ``fields`` are told from its end on, ``size`` bytes in all."""

    count: int
    least: int
    most: int
    begin: int
    unit: int
    size: int
    fields: Sequence[tuple[str, str, int]]


@dataclass(frozen=True)
class Layout:
    """``signature`` bytes stand at ``at`` of a record of ``size`` bytes; ``fields`` are (name, kind, offset); ``equal`` are (kind, offset, value) and ``same`` (kind, offset, offset) checks."""

    size: int
    signature: bytes
    at: int
    fields: Sequence[tuple[str, str, int]]
    equal: Sequence[tuple[str, int, int]] = field(default=())
    same: Sequence[tuple[str, int, int]] = field(default=())
    tail: Tail | None = None

    @property
    def columns(self) -> list[tuple[str, str, int]]:
        return [*self.fields, *(self.tail.fields if self.tail else ())]


# Layouts of two record kinds (all little-endian).
CATEGORY_TOKEN = Layout(18, b"\x04\x00", 0, (("discriminator", "u32", 2), ("category_low", "u32", 6)), (("u32", 10, 0xFFFFFFFF), ("u32", 14, 0xFFFFFFFF)))
BOUNDS_HEAD = Layout(46, b"\xc6\x08", 16, (("element_id", "u32", 0), ("record_code", "u32", 18), ("record_count", "u32", 38)), (("u32", 4, 0), ("u32", 30, 0), ("u32", 34, 0x00088004), ("u32", 42, 3)), (("u32", 0, 26),))
#: The same with its two copies of six corners (a, b) behind the list of entries, and the bits of these (p, q).
BOUNDS = Layout(46, BOUNDS_HEAD.signature, 16, (*BOUNDS_HEAD.fields, ("reserved", "u32", 22)), BOUNDS_HEAD.equal, BOUNDS_HEAD.same, Tail(38, 1, 10_000, 42, 6, 96, [(f"{name}{k}", kind, 8 * (k + j)) for kind, pair in (("f64", "ab"), ("i64", "pq")) for j, name in zip((0, 6), pair, strict=True) for k in range(6)]))
#: The farthest corner, the widest span, the rounding of a span, and the span (in feet) from which an axis counts as solid.
FARTHEST, WIDEST, SLACK, SOLID = 50_000.0, 5_000.0, 1e-8, 1e-3
OWNERSHIP_ROW = Layout(40, b"\x00\x00\x00\x00", 8, (("owner_id", "u64", 0), ("element_id", "u64", 12), ("creation", "u32", 20), ("modification", "u32", 24), ("user", "u32", 28), ("original_id", "u64", 32)))


def _read(data: np.ndarray, at: np.ndarray, kind: str) -> np.ndarray:
    code, width = KINDS[kind]
    return np.ascontiguousarray(data[at[:, None] + np.arange(width)]).view(code)[:, 0] if len(at) else np.zeros(0, code)


def _found(data: np.ndarray, ends: np.ndarray, layout: Layout) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Contents (by number), offsets and fields of all records that pass the layout's checks, in contents that lie one behind another and end at ``ends``."""
    made = len(data) - layout.size + 1
    if made <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), [np.zeros(0, np.int64) for _ in layout.columns]
    good = np.ones(made, bool)
    for k, b in enumerate(layout.signature):
        good &= data[layout.at + k : layout.at + k + made] == b
    at = np.flatnonzero(good)
    row = np.searchsorted(ends, at, "right")
    whole = at + layout.size <= ends[row]
    at, row = at[whole], row[whole]
    for test in [lambda at, kind=kind, offset=offset, value=value: _read(data, at + offset, kind) == value for kind, offset, value in layout.equal] + [lambda at, kind=kind, a=a, b=b: _read(data, at + a, kind) == _read(data, at + b, kind) for kind, a, b in layout.same]:
        held = test(at)
        at, row = at[held], row[held]
    behind = []
    if layout.tail is not None:
        t = layout.tail
        entries = _read(data, at + t.count, "u32").astype(np.int64)
        end = at + t.begin + t.unit * entries
        fits = (entries >= t.least) & (entries <= t.most) & (end + t.size <= ends[row])
        at, row, end = at[fits], row[fits], end[fits]
        behind = [_read(data, end + offset, kind) for _, kind, offset in t.fields]
    return row, at - np.concatenate([[0], ends])[row], [_read(data, at + offset, kind) for _, kind, offset in layout.fields] + behind


def find(content: bytes, layout: Layout) -> tuple[np.ndarray, list[np.ndarray]]:
    """Offsets and fields of all records of a layout that pass its checks."""
    data = np.frombuffer(content, np.uint8)
    return _found(data, np.array([len(data)]), layout)[1:]


#: Bytes of contents that are scanned at once; a longer content is scanned whole.
SCANNED = 4 << 20


def scan_records(pages: DataFrame, layout: Layout) -> DataFrame:
    """(path, offset, fields...) of a layout's records in each page; whole numbers as long. Short pages are scanned together."""
    names = [n for n, _, _ in layout.columns]
    kinds = ["double" if k == "f64" else "long" for _, k, _ in layout.columns]

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            contents = [x or b"" for x in batch.column("content").to_pylist()]
            ends = np.cumsum([len(x) for x in contents])
            first = 0
            while first < len(contents):
                last = max(first + 1, int(np.searchsorted(ends, (ends[first - 1] if first else 0) + SCANNED, "right")))
                data = np.frombuffer(b"".join(contents[first:last]), np.uint8)
                row, at, values = _found(data, ends[first:last] - (ends[first - 1] if first else 0), layout)
                columns = [pa.array(v.astype(np.float64 if k == "double" else np.int64)) for v, k in zip(values, kinds, strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column("path").take(pa.array(row + first)).cast(pa.string()), pa.array(at.astype(np.int64)), *columns], ["path", "offset", *names])
                first = last

    schema = ", ".join(["path string", "offset long", *(f"`{n}` {k}" for n, k in zip(names, kinds, strict=True))])
    return pages.select("path", "content").mapInArrow(over, schema)


def duplicated_bounds(pages: DataFrame) -> DataFrame:
    """(path, offset, element_id, record_code, record_count, duplicated, x0, y0, z0, x1, y1, z1): bounds records, each with the copy that encloses less.

    Ids 0 and all ones are none; a reserved word that isn't 0 is a broken
    record, unless the code is all ones. A copy counts if all corners are finite
    and near, no span is negative or too wide and two axes are solid; of two that
    count the one of less volume (a thin axis as thick as SOLID) is taken, the
    second of equal ones, and a record without any is left out. ``duplicated``
    tells whether the copies are the same bytes. Null and short pages have none.
    """
    ones = 0xFFFFFFFF
    rows = scan_records(pages, BOUNDS).filter((F.col("element_id") != 0) & (F.col("element_id") != ones) & ((F.col("reserved") == 0) | (F.col("record_code") == ones)))
    spans = {c: [F.col(f"{c}{k + 3}") - F.col(f"{c}{k}") for k in range(3)] for c in "ab"}
    all_of = lambda tests: reduce(and_, tests)

    def counts(c: str) -> Column:
        near = all_of(F.abs(F.col(f"{c}{k}")) <= FARTHEST for k in range(6))  # NaN is larger than all
        sound = all_of((x >= -SLACK) & (x <= WIDEST) for x in spans[c])
        return near & sound & (sum((F.when(x > SOLID, 1).otherwise(0) for x in spans[c]), F.lit(0)) >= 2)

    volume = {c: reduce(mul, (F.greatest(x, F.lit(SOLID)) for x in spans[c])) for c in "ab"}
    second = counts("b") & (~counts("a") | (volume["b"] <= volume["a"]))
    same = all_of(F.col(f"p{k}") == F.col(f"q{k}") for k in range(6))
    corners = [F.when(second, F.col(f"b{k}")).otherwise(F.col(f"a{k}")).alias(n) for k, n in enumerate(("x0", "y0", "z0", "x1", "y1", "z1"))]
    return rows.filter(counts("a") | counts("b")).select("path", "offset", "element_id", "record_code", "record_count", same.alias("duplicated"), *corners)


#: Bytes that are inflated at once, fed at once, and kept of a chunk as the next one's dictionary.
PIECE, FEED, MEMORY = 8 << 20, 1 << 16, 1 << 15


def header_end(content: bytes, at: int) -> int | None:
    """Where the deflated data of a gzip member begin; None if no member begins at ``at``."""
    if content[at : at + 3] != b"\x1f\x8b\x08" or len(content) < at + 18 or content[at + 3] & 0xE0:
        return None
    flags, end = content[at + 3], at + 10
    if flags & 4:
        end += 2 + int.from_bytes(content[end : end + 2], "little")
    for bit in (8, 16):  # name, comment
        if flags & bit:
            end = content.find(0, end) + 1
            if not end:
                return None
    end += 2 * bool(flags & 2)
    return end if end < len(content) else None


def _pieces(engine, content: bytes, at: int, ends: list[int]) -> Iterator[bytes]:
    """What an inflating engine makes of the bytes from ``at``, in pieces, and at last where they end; stops before damage."""
    for k in range(at, len(content), FEED):
        waiting = content[k : k + FEED]
        while waiting and not engine.eof:
            try:
                piece = engine.decompress(waiting, PIECE)
            except zlib.error:
                return
            waiting = engine.unconsumed_tail
            if piece:
                yield piece
        if engine.eof:
            ends.append(min(k + FEED, len(content)) - len(engine.unused_data))
            return


def inflate(pages: DataFrame) -> DataFrame:
    """(path, chunk, piece, offset, content, complete): each gzip member of a stream inflated to its end, in pieces of PIECE bytes at most, so nothing is lost or held whole.

    A member that breaks at its first bytes is tried once more with the last
    bytes of the member before it as a dictionary; what can't be read whole is
    kept as far as it goes. ``complete`` is told by a member's last piece.
    """

    def members(content: bytes) -> Iterator[tuple[int, int, int, bytes, bool]]:
        at, chunk, memory = content.find(b"\x1f\x8b\x08"), 0, b""
        while at >= 0:
            begin, used = header_end(content, at), 3
            if begin is not None:
                for dictionary in (b"", memory):
                    engine = zlib.decompressobj(-15, zdict=dictionary) if dictionary else zlib.decompressobj(-15)
                    held, n, tail, ends = None, 0, b"", []
                    for piece in _pieces(engine, content, begin, ends):
                        if held is not None:
                            yield chunk, n - 1, at, held, False
                        held, n, tail = piece, n + 1, (tail + piece)[-MEMORY:]
                    if held is not None or engine.eof or not memory:
                        break
                yield chunk, max(0, n - 1), at, held or b"", engine.eof
                memory = tail or memory
                used, chunk = (ends[0] - at if ends else 3), chunk + 1
            at = content.find(b"\x1f\x8b\x08", at + used)

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True):
                for chunk, piece, at, out, whole in members(content or b""):
                    yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([chunk], pa.int64()), pa.array([piece], pa.int64()), pa.array([at], pa.int64()), pa.array([out], pa.binary()), pa.array([whole])], ["path", "chunk", "piece", "offset", "content", "complete"])

    return pages.select("path", "content").mapInArrow(over, "path string, chunk long, piece long, offset long, content binary, complete boolean")


#: Payload bytes of a stored page, and the bytes of its checksum behind them.
PAYLOAD, CHECKSUM = 64_896, 353
# Streams that are stored in pages with checksums.
PAGED = r"(?i)^(?:Root Entry/)?(?:Partitions/[^/]+|Formats/Latest|Global/(?:ContentDocuments|DocumentIncrementTable|ElemTable|History|Latest|PartitionTable))$"


def checksum_paged(path: Column) -> Column:
    """Whether a stream is stored in pages with checksums."""
    return F.coalesce(path.rlike(PAGED), F.lit(False))


def stored_offset(offset: Column) -> Column:
    """Where a byte of the payload stands in the stored stream; 0 for what isn't above 0."""
    whole = F.floor(offset)
    return F.when(offset > 0, F.floor(whole / PAYLOAD) * (PAYLOAD + CHECKSUM) + whole % PAYLOAD).otherwise(0).cast("long")


def strip_page_checksums(content: bytes) -> bytes:
    """A page-stored stream without the checksums of its whole pages; a last page that isn't whole stays as it is."""
    step = PAYLOAD + CHECKSUM
    whole = len(content) // step * step
    return b"".join(content[k : k + PAYLOAD] for k in range(0, whole, step)) + content[whole:]


def payloads(pages: DataFrame) -> DataFrame:
    """(path, content) of streams, those in pages without their checksums."""

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            content = [strip_page_checksums(x) if paged and x is not None else x for x, paged in zip(batch.column("content").to_pylist(), batch.column("paged").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("path"), pa.array(content, pa.binary())], ["path", "content"])

    return pages.select("path", "content", checksum_paged(F.col("path")).alias("paged")).mapInArrow(over, "path string, content binary")


def drawing_names(pages: DataFrame) -> DataFrame:
    """(path, name) of the drawing files that UTF-16 text in a stream names, each once in any case, in the spelling that comes first."""
    text = F.decode("content", "UTF-16LE")
    found = pages.select("path", F.posexplode(F.regexp_extract_all(text, F.lit(r"(?i)[^\x00-\x1f<>:\"/\\|?*]{1,200}\.dwg"), F.lit(0))).alias("place", "name"))
    named = found.withColumn("name", F.trim("name")).filter(F.length("name") > 4)
    return named.groupBy("path", F.lower("name").alias("key")).agg(F.min_by("name", "place").alias("name")).select("path", "name")
