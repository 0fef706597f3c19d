"""Secret scans with built-in SQL functions only: key patterns, and sliding-window entropy of candidate strings.

Four kinds of spans are found in whole texts, at code points, ends exclusive:

* ``assign``: a password, secret, token or key name, ``:`` or ``=``, and a value of 6 or more characters;
* ``access``: ``AKIA`` and 16 or more capital letters and digits;
* ``hex``: 24 or more lower-case hexadecimal digits;
* ``entropy``: a run of 20 or more token characters of which some window of
  WINDOW characters has a Shannon entropy at or above its class's threshold.
  Classes are hexadecimal, capital base 32, letters and digits, and base 64;
  letters alone are no candidate. Window counts are kept incrementally: each
  step takes out one character and puts in one. Candidates that an allow-list
  pattern matches are suppressed.

The entropy method only adds spans: an entropy candidate inside a span of the
other kinds is not reported again.

Cases: a null text is an empty one and has no span; rows with the same doc_id
are scanned each by itself; other columns are ignored; an empty table gives an
empty result.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KINDS = ("assign", "access", "hex", "entropy")
WINDOW = 20
# The base patterns.
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
#: Runs that can be secrets by their entropy.
CANDIDATE = r"[A-Za-z0-9+/_-]{20,}={0,2}"
#: Class, what a whole candidate of it looks like, bits that a window must reach (of at most log2 20 = 4.32).
CLASSES = (
    ("hexadecimal", r"^[0-9a-fA-F]+=*$", 3.0),
    ("base32", r"^[A-Z2-7]+=*$", 3.6),
    ("alphanumeric", r"^[A-Za-z0-9]+=*$", 3.7),
    ("base64", r"^[A-Za-z0-9+/_-]+=*$", 3.8),
)
#: Candidates that are no secrets: words joined by - _ or /, placeholders, numbers with separators. No group is repeated: Java's engine would recurse.
ALLOWED = (r"^[A-Za-z/_-]+$", r"(?i)example|placeholder|changeme|dummy|xxxx|your[-_]", r"^[0-9][0-9_/-]*$")
#: A candidate is no secret either if all its pieces between separators look like this: words and short numbers.
PIECE = r"^(?:[A-Za-z]+|[0-9]{1,4})$"


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), body), F.lit(1))


def _blocks(items: Column) -> Column:
    """An array as blocks of about the square root of its size."""

    def cut(x: Column) -> Column:
        size = F.greatest(F.ceil(F.sqrt(F.size(x))), F.lit(1)).cast("int")
        last = F.floor((F.size(x) - 1) / size).cast("int")
        return F.when(F.size(x) == 0, F.slice(F.array(x), F.lit(1), F.lit(0))).otherwise(F.transform(F.sequence(F.lit(0), last), lambda b: F.slice(x, b * size + 1, size)))

    return _let(items, cut)


def _scanned(items: Column, state: Column, emitted: str, step: Callable[[Column, Column], tuple[Column, Column]]) -> Column:
    """What ``step`` (state, item) -> (state, array of ``emitted``) emits over an array, in blocks: appending to one long array would copy it at each item."""
    none = F.array().cast(f"array<{emitted}>")

    def inner(acc: Column, x: Column) -> Column:
        after, out = step(acc["state"], x)
        return F.struct(after.alias("state"), F.concat(acc["out"], out).alias("out"))

    def outer(acc: Column, block: Column) -> Column:
        done = F.aggregate(block, F.struct(acc["state"].alias("state"), none.alias("out")), inner)
        return _let(done, lambda r: F.struct(r["state"].alias("state"), F.concat(acc["outs"], F.array(r["out"])).alias("outs")))

    return F.aggregate(_blocks(items), F.struct(state.alias("state"), F.array().cast(f"array<array<{emitted}>>").alias("outs")), outer, lambda acc: F.flatten(acc["outs"]))


SPAN = "struct<start:int,kind:int,end:int,value:string>"


def _span(start: Column, kind: Column, end: Column, value: Column) -> Column:
    return F.struct(start.cast("int").alias("start"), kind.cast("int").alias("kind"), end.cast("int").alias("end"), value.cast("string").alias("value"))


def _spans(text: Column, kind: str, pattern: str, group: bool = False) -> Column:
    """Array of (start, kind, end, value) of a pattern's leftmost matches that don't overlap.

    The pieces between matches give the places: a match starts after all
    pieces and matches before it.
    """
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    steps = _let(hits, lambda h: F.arrays_zip(F.slice(F.split(text, pattern, -1), F.lit(1), F.size(h)).alias("gap"), h.alias("hit")))

    def step(at: Column, x: Column) -> tuple[Column, Column]:
        begin = at + F.length(x["gap"])
        end = begin + F.length(x["hit"])
        value = F.regexp_extract(x["hit"], pattern, 1) if group else x["hit"]
        return end, F.array(_span(begin, F.lit(KINDS.index(kind)), end, value))

    return F.when(text.rlike(pattern), _scanned(steps, F.lit(0), SPAN, step)).otherwise(F.array().cast(f"array<{SPAN}>"))


def window_entropy(value: Column, window: int = WINDOW, enough: Column | None = None) -> Column:
    """The largest Shannon entropy (bits a character) of a window of ``value``, by counts that each step changes by one character in and one out; windows after one that has ``enough`` are not looked at.

    With counts c of the characters, H = log2 w - sum(c log2 c) / w, so a step
    needs the two changed counts alone.
    """
    return _let(F.split(value, ""), lambda chars: _window_entropy(chars, window, enough))


def _window_entropy(chars: Column, window: int, enough: Column | None) -> Column:
    def bits(c: Column) -> Column:
        return F.when(c > 0, c * F.log2(c.cast("double"))).otherwise(F.lit(0.0))

    def of(counts: Column, c: Column) -> Column:
        return F.coalesce(F.try_element_at(counts, c), F.lit(0))

    def put(counts: Column, c: Column, n: Column) -> Column:
        return F.map_concat(F.map_filter(counts, lambda k, _: k != c), F.create_map(c, n))

    begin = F.struct(F.create_map().cast("map<string,int>").alias("counts"), F.lit(0.0).alias("total"), F.lit(0.0).alias("best"))

    def step(acc: Column, i: Column) -> Column:
        new = F.element_at(chars, i)
        old = F.when(i > window, F.element_at(chars, F.greatest(i - window, F.lit(1))))
        had = of(acc["counts"], new)
        added = put(acc["counts"], new, had + 1)
        total = acc["total"] + bits(had + 1) - bits(had)
        lost = of(added, old)
        counts = F.when(old.isNull(), added).otherwise(put(added, old, lost - 1))
        total = F.when(old.isNull(), total).otherwise(total + bits(lost - 1) - bits(lost))
        best = F.when(i >= window, F.greatest(acc["best"], F.log2(F.lit(float(window))) - total / window)).otherwise(acc["best"])
        after = F.struct(counts.alias("counts"), total.alias("total"), best.alias("best"))
        return after if enough is None else F.when(acc["best"] >= enough, acc).otherwise(after)

    return F.aggregate(F.sequence(F.lit(1), F.size(chars)), begin, step, lambda acc: acc["best"])


def _secretive(value: Column) -> Column:
    allowed = F.forall(F.split(value, "[-_/]"), lambda x: x.rlike(PIECE))
    for pattern in ALLOWED:
        allowed = value.rlike(pattern) | allowed
    least = F.lit(None).cast("double")
    for _, pattern, bits in reversed(CLASSES):
        least = F.when(value.rlike(pattern), F.lit(bits)).otherwise(least)
    return F.when(allowed, F.lit(False)).otherwise(_let(least, lambda x: window_entropy(value, enough=x) >= x))


def _apart(base: Column, more: Column) -> Column:
    """Spans of ``more`` that no span of ``base`` overlaps, by one merge of both in order; spans of ``more`` don't overlap each other."""
    last = _span(F.lit(2**31 - 1), F.lit(-1), F.lit(2**31 - 1), F.lit(None))
    none = F.array().cast(f"array<{SPAN}>")
    start = F.struct(F.lit(-1).alias("reach"), F.lit(None).cast(SPAN).alias("held"))

    def step(state: Column, x: Column) -> tuple[Column, Column]:
        is_base = (x["kind"] >= 0) & (x["kind"] < KINDS.index("entropy"))
        clash = is_base & (x["start"] < state["held"]["end"])  # the held one starts before x
        out = F.when(state["held"].isNull() | clash, none).otherwise(F.array(state["held"]))
        free = ~is_base & (x["kind"] > 0) & (x["start"] >= state["reach"])
        return F.struct(F.when(is_base, F.greatest(state["reach"], x["end"])).otherwise(state["reach"]).alias("reach"), F.when(free, x).alias("held")), out

    return F.when(F.size(more) == 0, none).otherwise(_scanned(F.concat(F.array_sort(F.concat(base, more)), F.array(last)), start, SPAN, step))


def scan(docs: DataFrame) -> DataFrame:
    """``docs`` with two columns more: ``secrets_``, an array of (start, kind, end, value) in that order; ``base_``, those of the three patterns."""
    text = F.coalesce(F.col("text"), F.lit(""))
    base = F.concat(
        F.filter(_spans(text, "assign", ASSIGN, True), lambda x: F.length(x["value"]) >= 6),
        _spans(text, "access", ACCESS),
        _spans(text, "hex", HEX),
    )
    found = docs.withColumn("base_", F.array_sort(base)).withColumn("more_", _spans(text, "entropy", CANDIDATE))
    more = F.filter(_apart(F.col("base_"), F.col("more_")), lambda x: F.coalesce(_secretive(x["value"]), F.lit(False)))
    return found.withColumn("secrets_", F.array_sort(F.concat(F.col("base_"), more))).drop("more_")


def listed(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.element_at(names, x["kind"] + 1), x["start"].cast("string"), x["end"].cast("string"))), ",")


def digests(docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_entropy of each document."""
    found = scan(docs.select("doc_id", "text"))

    def count(kind: str) -> Column:
        return F.size(F.filter("secrets_", lambda x: x["kind"] == KINDS.index(kind))).cast("long").alias(f"n_{kind}")

    return found.select("doc_id", count("assign"), count("access"), count("hex"), F.sha2(listed(F.col("base_")), 256).alias("base_sha256"), listed(F.col("secrets_")).alias("spans"), count("entropy"))


def redact(docs: DataFrame, mark: str = "[REDACTED]") -> DataFrame:
    """``docs`` with every span of ``text`` replaced by ``mark``; spans that overlap are replaced together. Texts without a span stay as they are."""
    found = scan(docs.select(F.struct(*docs.columns).alias("row_"), "text"))
    start = F.struct(F.lit(0).alias("from"), F.lit(-1).alias("begin"), F.lit(0).alias("at"))
    last = _span(F.lit(2**31 - 1), F.lit(-1), F.lit(2**31 - 1), F.lit(None))

    def step(state: Column, x: Column) -> tuple[Column, Column]:
        """The open span runs from begin to at, after text from ``from``; it closes where x starts at its end or later."""
        opened, closes = state["begin"] >= 0, x["start"] >= state["at"]
        one = F.struct(state["from"].alias("from"), state["begin"].alias("start"), state["at"].alias("end"))
        out = F.when(opened & closes, F.array(one)).otherwise(F.array().cast("array<struct<from:int,start:int,end:int>>"))
        after = F.struct(F.when(closes, state["at"]).otherwise(state["from"]).alias("from"), F.when(closes, x["start"]).otherwise(state["begin"]).alias("begin"), F.greatest(state["at"], x["end"]).alias("at"))
        return after, out

    merged = _scanned(F.concat("secrets_", F.array(last)), start, "struct<from:int,start:int,end:int>", step)
    found = found.withColumn("merged_", F.when(F.size("secrets_") > 0, merged))

    def rebuilt(block: Column) -> Column:
        """A block's text up to its last span, with the marks; only the block's own text is cut for each span."""
        begin = block[0]["from"]
        own = F.substring(F.col("text"), begin + 1, F.element_at(block, F.lit(-1))["start"] - begin)
        return _let(own, lambda t: F.array_join(F.transform(block, lambda x: F.concat(F.substring(t, x["from"] - begin + 1, x["start"] - x["from"]), F.lit(mark))), ""))

    tail = F.substring(F.col("text"), F.element_at("merged_", F.lit(-1))["end"] + 1, F.length("text"))
    whole = F.concat(F.array_join(F.transform(_blocks(F.col("merged_")), rebuilt), ""), tail)
    text = F.when(F.col("merged_").isNotNull(), whole).otherwise(F.col("text"))
    return found.select(*[text.alias(c) if c == "text" else F.col(f"row_.{c}").alias(c) for c in docs.columns])
