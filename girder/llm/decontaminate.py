"""Benchmark decontamination by template canonicalisation.

Texts are cut into words at white space and symbols; numbers ('1 200' and
'1,200' are one, and so are runs of number words), runs of names (capitalised
words within a sentence) and units (unit words after a number) become one typed
placeholder each, other words stay in lower case. Windows of WINDOW template words of documents and benchmark
items are hash-joined. Hits of a document and an item are counted on one
alignment and on bands of neighbouring alignments (words added or removed shift
what follows; a band holds any shift up to 1/SHIFT of the item's windows, 2 at
least); of several hits of one window of the item the one with the fewest
changes counts. The item is leaked if its windows are covered to a share of
COVERAGE, and the slots that the placeholders stand for are consistent: each
value of the item always became one value in the document. Then the copy is
``template`` (a question with new parameters) if a slot changed, else ``exact``
if it is whole (coverage 1), else ``partial``.

A window that many items and documents share makes no product of both: a leak
covers COVERAGE of an item's windows, so it hits at least one of the item's
rarest ones (by the items that have them; all but COVERAGE of them, and one
more). Those alone make candidates of a document and an item; the other windows
are joined on document and window for candidates only.

Documents' windows first pass a bit table of the benchmark's window hashes,
whose size is fixed (BITS) whatever the benchmark's, so only windows with a
likely partner are shuffled; the join then is exact on the hash.

A window takes part if at least PLAIN of its words are plain ones, so rows of
numbers or names alone match nothing. Windows with names are also hashed with
the names as words, so a copy in capitals or small letters is caught, and
windows with a capitalised word that opens a sentence also with that word as a
name; an item is judged without and with hits of the latter.

Cases: null and empty texts have no window; an item without a window that
takes part (under WINDOW words, or placeholders only) can't leak; repeated rows
of one doc_id count once; other columns are ignored; empty tables give an
empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import texts as T
from .spread import without
from .storage import materialize, small_batches

WINDOW, COVERAGE = 5, 0.5
#: Plain words that a window needs.
PLAIN = 2
#: Bits of the table that documents' windows pass first: 4 MB.
BITS = 25
#: Shifts of up to this part of an item's windows stay on one band of alignments.
SHIFT = 4
# Unit words that are typed placeholders after a number.
UNITS = "% mm cm m km in inch inches ft feet foot yd yards mi mile miles mg g kg lb lbs oz ton tons ml l litre litres liter liters s sec second seconds min minute minutes h hr hour hours day days week weeks month months year years hz khz mhz ghz w kw mw v kv a ma c f k pa kpa bar j kj cal kcal b kb mb gb tb usd eur gbp dollar dollars euro euros cent cents pound pounds percent degree degrees mph kmh kph rpm"
# Number words.
NUMBERS = "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million billion dozen"
NUMBER, NAME, UNIT = (np.uint64(x) for x in (0xA11CE5, 0xB0B51E, 0xC0FFEE))

_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
_CAPITAL = np.zeros(256, bool)
_CAPITAL[65:91] = True
_STOP = np.zeros(256, bool)
_STOP[[10, 13, ord("."), ord("!"), ord("?"), ord(":"), ord(";"), ord('"')]] = True


@lru_cache(maxsize=2)
def _hashes(words: str) -> np.ndarray:
    return np.unique(T.words_of(pa.array([words]), T.BY_SYMBOL).hash)


def _capitals(data: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Whether words begin with a capital of the Latin, Latin-1, Greek or Cyrillic alphabet, by their first two bytes of UTF-8."""
    a, b = data[start].astype(int), data[np.minimum(start + 1, max(0, len(data) - 1))].astype(int)
    return _CAPITAL[a] | ((a == 0xC3) & (b >= 0x80) & (b <= 0x9E) & (b != 0x97)) | ((a == 0xCE) & (b >= 0x91) & (b <= 0xA9)) | ((a == 0xD0) & (b >= 0x80) & (b <= 0xAF))


class Form:
    """A text's words in one reading: ``token`` (hash or placeholder), ``slot`` (hash of what stood there, 0 for a plain word), ``row``, ``place`` (its first word), ``step`` (the base reading's place there), ``plain`` and ``marked`` words."""

    def __init__(self, lead: np.ndarray, token: np.ndarray, value: np.ndarray, typed: np.ndarray, marked: np.ndarray, row: np.ndarray, place: np.ndarray, step: np.ndarray):
        n = len(token)
        group = np.cumsum(lead) - 1
        at = np.flatnonzero(lead)
        mixed = value[at]
        if len(at) < n:
            sums = np.zeros(len(at), np.uint64)
            np.add.at(sums, group, T.mix(value + np.uint64(7) * (np.arange(n) - at[group]).astype(np.uint64)))
            several = np.bincount(group) > 1
            mixed[several] = sums[several]
        self.token, self.row, self.place, self.step, self.plain = token[at], row[at], place[at], step[at], ~typed[at]
        self.slot = np.where(typed[at], mixed, np.uint64(0))
        self.marked = np.bincount(group[marked], minlength=len(at)) > 0

    def windows(self, size: int, only_marked: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """Hash and first token of each window of ``size`` tokens within a text that has enough plain words, and a marked one if so asked."""
        made = max(0, len(self.token) - size + 1)
        total, plain, marked = np.zeros(made, np.uint64), np.zeros(made, np.int64), np.zeros(made, bool)
        for k in range(size):
            total += self.token[k : k + made] * np.uint64(pow(int(T.BASE), k + 1, 2**64))
            plain += self.plain[k : k + made]
            marked |= self.marked[k : k + made]
        good = np.flatnonzero((self.row[:made] == self.row[size - 1 :]) & (plain >= PLAIN) & (marked | (not only_marked))) if made else np.zeros(0, np.int64)
        return T.mix(total[good]), good


class Template:
    """Readings of a block of texts: ``base``, ``spelt`` (names as the plain words that they are), ``opened`` (capitalised words that open a sentence are names too)."""

    def __init__(self, texts: pa.Array):
        lower = pc.utf8_lower(texts)
        words = T.words_of(lower, T.BY_SYMBOL)
        own = T.words_of(texts, T.BY_SYMBOL)  # white space and symbols stand at the same words in either case
        n = len(words.hash)
        first = np.empty(n, bool)
        first[:1], first[1:] = True, words.row[1:] != words.row[:-1]
        data, start, end = own.data, own.start, own.end
        spelt_number = np.isin(words.hash, _hashes(NUMBERS))
        number = (_DIGIT[data[start]] & _DIGIT[data[end - 1]]) | spelt_number if n else np.zeros(0, bool)
        glued = np.zeros(n, bool)  # 3.14, 1,000 and 1 000 are one number
        grouped = np.zeros(n, bool)
        if n > 1:
            digits = np.concatenate([[0], np.cumsum(_DIGIT[data])])
            whole = digits[end] - digits[start] == end - start
            beside = (start[1:] - end[:-1] == 1) & number[1:] & number[:-1] & ~first[1:]
            between = data[np.minimum(end[:-1], len(data) - 1)]
            grouped[1:] = beside & whole[1:] & whole[:-1] & (end[1:] - start[1:] == 3) & (end[:-1] - start[:-1] <= 3) & np.isin(between, [32, 44])
            glued[1:] = beside & np.isin(between, [46, 44])
            glued |= grouped
            glued[1:] |= beside & spelt_number[1:] & spelt_number[:-1] & np.isin(between, [32, 45])  # twenty five, two-hundred
        stops = np.concatenate([[0], np.cumsum(_STOP[data])])
        opens = first.copy()
        if n > 1:
            opens[1:] |= stops[start[1:]] > stops[end[:-1]]
        capital = _capitals(data, start) & ~number if n else np.zeros(0, bool)
        unit = np.zeros(n, bool)
        if n > 1:
            unit[1:] = np.isin(words.hash[1:], _hashes(UNITS)) & number[:-1] & ~first[1:]
        value = words.hash.copy()
        lead = np.flatnonzero(~glued)
        if glued.any():
            last = np.append(lead[1:], n) - 1
            several = last > lead
            kept = np.ones(len(data), bool)
            kept[end[np.flatnonzero(grouped) - 1]] = False  # the space or comma before a group of three digits
            to = np.concatenate([[0], np.cumsum(kept)])
            value[lead[several]] = T.hash_spans(data[kept], to[start[lead[several]]], to[end[last[several]]])
        row, value, spelt = words.row[lead], value[lead], words.hash[lead]
        number, unit, capital, opens = number[lead], unit[lead], capital[lead], opens[lead]
        count = np.bincount(row, minlength=len(texts))
        place = np.arange(len(lead)) - np.repeat(np.cumsum(count) - count, count)

        def leads(name: np.ndarray) -> np.ndarray:
            out = np.ones(len(lead), bool)
            out[1:] = ~(name[1:] & name[:-1] & ~opens[1:])
            return out

        def form(name: np.ndarray, marked: np.ndarray) -> Form:
            token = np.where(number, NUMBER, np.where(unit, UNIT, np.where(name, NAME, spelt)))
            return Form(leads(name), token, value, number | unit | name, marked, row, place, step)

        name, opener = capital & ~opens & ~unit, capital & opens & ~unit
        order = np.cumsum(leads(name))
        step = order - order[np.arange(len(lead)) - place]
        self.base = form(name, name)
        self.spelt = form(np.zeros(len(lead), bool), name)
        self.opened = form(name | opener, opener)


WINDOWS = "id long, text_key long, hash long, place int, step int, windows int, opened boolean, slots array<long>, spots array<int>"


def _windows(size: int, passing):
    """Rows of WINDOWS, of those that pass the bit table if one is given; ``windows`` counts the base windows of the whole text.

    A window with names stands twice: with placeholders, and with the names as
    words (no slots), which meets copies in other letter case; one with a word
    that opens a sentence also with that as a name (``opened``). Of items, the
    further readings only stand where a base window begins.
    """

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, texts in T.blocks(T.plain(batch.column("text"))):
                t, cut = Template(texts), batch.slice(at, len(texts))
                parts, begins, count = [], None, None
                for form in (t.base, t.spelt, t.opened):
                    h, first = form.windows(size, form is not t.base)
                    if form is t.base:
                        count = np.bincount(form.row[first], minlength=len(texts))
                        begins = form.row[first].astype(np.int64) << 32 | form.place[first]
                    elif passing is None:
                        some = np.isin(form.row[first].astype(np.int64) << 32 | form.place[first], begins)
                        h, first = h[some], first[some]
                    if passing is not None:
                        good = _bit(passing.value, h)
                        h, first = h[good], first[good]
                    within = first[:, None] + np.arange(size)
                    parts.append((h, form.row[first], form.place[first], form.step[first], np.full(len(h), form is t.opened), form.slot[within].ravel(), form.place[within].ravel()))
                h, row, place, step, opened, slots, spots = (np.concatenate(x) for x in zip(*parts, strict=True))
                ends = pa.array(np.arange(len(h) + 1, dtype=np.int32) * size)
                lists = [pa.ListArray.from_arrays(ends, pa.array(slots.view(np.int64))), pa.ListArray.from_arrays(ends, pa.array(spots.astype(np.int32)))]
                rows = pa.array(row)
                columns = [cut.column("id").take(rows), cut.column("text_key").take(rows), pa.array(h.view(np.int64)), pa.array(place.astype(np.int32)), pa.array(step.astype(np.int32)), pa.array(count[row].astype(np.int32)), pa.array(opened), *lists]
                yield pa.RecordBatch.from_arrays(columns, [x.split()[0] for x in WINDOWS.split(", ")])

    return over


def _bit(table: np.ndarray, h: np.ndarray) -> np.ndarray:
    at = h >> np.uint64(64 - BITS)
    return (table[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1


def _bit_table(windows: DataFrame) -> np.ndarray:
    """Bits of all window hashes, or-ed from the byte positions that partitions report; at most 2^BITS / 8 of them."""
    rows = windows.selectExpr(f"shiftrightunsigned(hash, {64 - BITS}) AS at").selectExpr("CAST(shiftright(at, 3) AS int) AS byte", "shiftleft(1, CAST(at & 7 AS int)) AS bit").groupBy("byte").agg(F.bit_or("bit").alias("bits"))
    found = rows.toPandas()
    table = np.zeros(1 << (BITS - 3), np.uint8)
    table[found["byte"].to_numpy(np.int64)] = found["bits"].to_numpy(np.int64).astype(np.uint8)
    return table


def _leaks(docs: DataFrame, items: DataFrame, window: int, coverage: float) -> DataFrame:
    """(doc_id, text_key, item_id, best): the best copy of each leaked item in each text."""
    spark: SparkSession = docs.sparkSession
    small_batches(spark)
    keyed_items = items.select(F.col("item_id").alias("id"), F.xxhash64("text").alias("text_key"), "text")
    theirs = materialize(keyed_items.mapInArrow(_windows(window, None), WINDOWS).distinct(), "item-windows")
    passing = spark.sparkContext.broadcast(_bit_table(theirs))
    keyed = docs.select(F.col("doc_id").alias("id"), F.xxhash64("text").alias("text_key"), "text")
    ours = materialize(keyed.mapInArrow(_windows(window, passing), WINDOWS).distinct(), "windows")
    d = ours.select(F.col("id").alias("doc_id"), "text_key", "hash", F.col("place").alias("here"), F.col("step").alias("here_step"), F.col("slots").alias("new"), F.col("opened").alias("by_doc"))
    b = theirs.select(F.col("id").alias("item_id"), F.col("text_key").alias("item_key"), "hash", F.col("place").alias("there"), F.col("step").alias("there_step"), "windows", F.col("slots").alias("old"), "spots", F.col("opened").alias("by_item"))
    # an item's windows by how many items have them; a leak hits one of the rarest
    common = theirs.groupBy("hash").agg(F.count("*").alias("c"))
    ranked = theirs.join(common, "hash")
    rank = F.row_number().over(Window.partitionBy("id", "text_key").orderBy("c", "hash", "place"))  # one item's windows
    rare = ranked.select("id", "text_key", "hash", "windows", "opened", rank.alias("rank"), F.count("*").over(Window.partitionBy("id", "text_key")).alias("readings"))
    rare = rare.filter(F.col("rank") <= F.col("readings") - F.ceil(F.col("windows") * coverage) + 1).select("id", "text_key", "hash").distinct()
    pairs = ours.select("id", "text_key", "hash").distinct().join(rare.select(F.col("id").alias("item_id"), F.col("text_key").alias("item_key"), "hash"), "hash")
    pairs = materialize(pairs.select(F.col("id").alias("doc_id"), "text_key", "item_id", "item_key").distinct(), "candidates")
    of = pairs.select("doc_id", "text_key", F.col("item_id").alias("i_"), F.col("item_key").alias("k_"))
    whole = of.join(b, F.col("i_").eqNullSafe(F.col("item_id")) & (F.col("k_") == F.col("item_key"))).drop("i_", "k_")
    same = d["doc_id"].eqNullSafe(whole["doc_id"]) & (d["text_key"] == whole["text_key"]) & (d["hash"] == whole["hash"])
    hits = d.join(whole, same).drop(whole["doc_id"]).drop(whole["text_key"]).drop(whole["hash"]).withColumn("at", F.col("here") - F.col("there")).withColumn("at_step", F.col("here_step") - F.col("there_step"))
    # slot pairs by place in the item, so overlapping windows count once
    pairs = F.filter(F.transform("old", lambda x, i: F.struct(F.element_at("spots", i + 1).alias("place"), x.alias("old"), F.element_at("new", i + 1).alias("new"))), lambda p: p["old"] != 0)
    changed = F.size(F.filter("pairs", lambda p: p["old"] != p["new"]))
    hits = hits.withColumn("pairs", pairs).withColumn("hit", F.struct(changed.alias("changed"), (-F.size("pairs")).alias("few"), "at", "pairs")).withColumn("open", F.col("by_doc") | F.col("by_item"))
    # wide bands begin at even and at odd multiples of the shift, so any two alignments a shift apart share one
    # alignments are those of words and those of the base reading, where a run of names is one
    shift = F.greatest(F.lit(2), F.floor(F.col("windows") / SHIFT)).cast("int")

    def band(wide: int, step: int) -> Column:
        at = F.col("at_step" if step else "at")
        return F.struct(F.lit(wide).alias("wide"), F.lit(step).alias("step"), (at if wide == 0 else F.floor((at + (wide - 1) * shift) / (2 * shift)).cast("int")).alias("band"))

    bands = F.array(*[band(wide, step) for step in (0, 1) for wide in (0, 1, 2)])
    by = ["doc_id", "text_key", "item_id", "item_key", "windows", "wide", "step", "band"]
    banded = hits.select("doc_id", "text_key", "item_id", "item_key", "windows", "there", "open", "hit", F.inline(bands))
    best_hit = banded.groupBy(*by, "there").agg(F.min(F.when(~F.col("open"), F.col("hit"))).alias("closed"), F.min("hit").alias("all"))

    def judged(x: str) -> Column:
        return F.struct(F.count(x).alias("n"), F.min(F.when(F.col(x).isNotNull(), F.struct("there", F.col(f"{x}.at").alias("at")))).alias("begin"), F.array_distinct(F.flatten(F.collect_list(f"{x}.pairs"))).alias("pairs"))

    both = best_hit.groupBy(*by).agg(judged("closed").alias("closed"), judged("all").alias("all"))
    lined = both.select(*by, F.inline(F.array("closed", "all"))).withColumn("coverage", F.col("n") / F.col("windows")).filter(F.col("coverage") >= coverage)
    olds = F.size(F.array_distinct(F.transform("pairs", lambda p: p["old"])))
    turned = F.size(F.array_distinct(F.transform("pairs", lambda p: F.struct(p["old"], p["new"]))))
    good = lined.withColumn("changed", changed).filter(olds == turned)
    return good.groupBy("doc_id", "text_key", "item_id").agg(F.max(F.struct("coverage", (-F.col("changed")).alias("same"), (F.col("wide") == 0).alias("narrow"), (-F.col("begin.at")).alias("early"))).alias("best"))


def find_leaks(docs: DataFrame, items: DataFrame, window: int = WINDOW, coverage: float = COVERAGE) -> DataFrame:
    """(doc_id, item_id, kind, coverage, at, changed): leaked items by document; ``at`` is the word where the item begins, ``changed`` the number of slots with new values.

    ``docs`` has doc_id and text, ``items`` item_id and text. Of several
    copies of an item in one document the best is reported.
    """
    best = _leaks(docs, items, window, coverage).groupBy("doc_id", "item_id").agg(F.max("best").alias("best"))
    return best.select("doc_id", "item_id", F.when(F.col("best.same") != 0, "template").when(F.col("best.coverage") >= 1 - 1e-9, "exact").otherwise("partial").alias("kind"), F.col("best.coverage").alias("coverage"), (-F.col("best.early")).cast("long").alias("at"), (-F.col("best.same")).cast("long").alias("changed"))


def remove_leaking(docs: DataFrame, items: DataFrame, window: int = WINDOW, coverage: float = COVERAGE) -> DataFrame:
    """``docs`` without the rows in whose text an item leaks; rows that share a doc_id, null too, are judged each by its own text."""
    leaks = materialize(_leaks(docs, items, window, coverage).select(F.xxhash64("doc_id", "text_key").alias("k")).distinct(), "leaks")
    return without(docs, F.xxhash64("doc_id", F.xxhash64("text")), leaks, "k")
