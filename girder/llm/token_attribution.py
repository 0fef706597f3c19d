"""Token counts of sections by offset-mapped attribution.

A document is encoded once as a whole; each token's span in the text is joined
with the spans of the document's sections, and counts are attributed to
sections. Rule for a token that crosses a boundary: it belongs to the section
that holds most of its bytes, on ties to the earliest.

Sections of a document are its lines (each with its line feed); sections of a
row with several text fields are the fields, joined in order.

Cases: a null or empty text is one section without tokens; an empty line is a
section of one character, its line feed; rows with the same doc_id are counted
each by itself; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .packing import encoder
from .storage import small_batches

SCHEMA = "doc_id long, section int, start long, end long, n_tokens long, n_crossing long"


@lru_cache(maxsize=2)
def token_bytes(path: str) -> np.ndarray:
    """Bytes that each id of a byte-level vocabulary stands for."""
    from tokenizers import Tokenizer

    vocabulary = Tokenizer.from_file(path).get_vocab(with_added_tokens=True)
    out = np.zeros(max(vocabulary.values()) + 1, np.int64)
    for token, i in vocabulary.items():
        out[i] = len(token)  # byte-level vocabularies write each byte as one character
    return out


def attribute(ends: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Tokens and crossing tokens of each section: an interval join of token spans (by their ends) with section spans (by their ends)."""
    starts = np.concatenate([[0], ends])[: len(ends)]
    first = np.searchsorted(bounds, starts, "right")
    last = np.searchsorted(bounds, ends, "left")
    owner = first.copy()
    crossing = np.flatnonzero(last > first)
    lows = np.concatenate([[0], bounds[:-1]])
    for t in crossing:
        over = np.arange(first[t], last[t] + 1)
        held = np.minimum(bounds[over], ends[t]) - np.maximum(lows[over], starts[t])
        owner[t] = over[np.argmax(held)]
    return np.bincount(owner, minlength=len(bounds)), np.bincount(owner[crossing], minlength=len(bounds))


def line_bounds(data: np.ndarray) -> np.ndarray:
    """Ends of lines, each with its line feed; at least one section."""
    ends = np.flatnonzero(data == 10) + 1
    return ends if len(ends) and ends[-1] == len(data) else np.append(ends, len(data))


def _count(path: str, ranks: str | None):
    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, lengths = encoder(path, ranks).ids, token_bytes(path)
        for batch in batches:
            columns = [[] for _ in range(6)]
            for i, fields in enumerate(batch.column("fields").to_pylist()):
                text = "".join(x or "" for x in fields)
                data = np.frombuffer(text.encode(), np.uint8)
                bounds = line_bounds(data) if len(fields) == 1 else np.cumsum([len((x or "").encode()) for x in fields])
                n, crossing = attribute(np.cumsum(lengths[encode(text)]), bounds)
                chars = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])[bounds]
                for to, x in zip(columns, (np.full(len(bounds), i), np.arange(len(bounds)), np.concatenate([[0], chars[:-1]]), chars, n, crossing), strict=True):
                    to.append(x)
            row, *rest = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in columns)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(row, pa.int64())), pa.array(rest[0].astype(np.int32)), *(pa.array(x.astype(np.int64)) for x in rest[1:])], [x.split()[0] for x in SCHEMA.split(", ")])

    return over


def count_by_section(docs: DataFrame, tokenizer: str, ranks: str | None = None, fields: tuple[str, ...] = ("text",)) -> DataFrame:
    """doc_id, section, start, end (code points, end exclusive), n_tokens, n_crossing (of these, tokens that cross a boundary).

    With one field its lines are the sections, with several the fields are.
    """
    small_batches(docs.sparkSession)
    rows = docs.select("doc_id", F.array(*fields).alias("fields"))
    return rows.mapInArrow(_count(tokenizer, ranks), SCHEMA)
