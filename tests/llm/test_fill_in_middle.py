"""Fill-in-the-middle forms against a scan over code points, and exact round trips."""

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from girder.llm import queries
from girder.llm.fill_in_middle import draws, fill_in_middle, restored, select, transform, unit_starts

PATTERNS = {"line": r"[^\n]*\n|[^\n]+", "word": r"[^ \t\n\v\f\r]+[ \t\n\v\f\r]*|[ \t\n\v\f\r]+", "char": r"(?s)."}


def brute(text, doc_id, unit="line", rate=100, spm=50):
    units = re.findall(PATTERNS[unit], text)
    n = len(units)
    h = hashlib.sha256(f"7:{doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * k : 8 * k + 8], 16) for k in range(4))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= rate:
        return n, "plain", None, None, text
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = ("".join(x) for x in (units[:a], units[a:b], units[b:]))
    form, out = ("spm", f"<S>{s}<P>{p}<M>{m}") if h4 % 100 < spm else ("psm", f"<P>{p}<S>{s}<M>{m}")
    return n, form, len(p), len(m), out


def texts(n):
    r = random.Random(3)
    return ["".join(r.choice(["a", "é", "\n", " ", "\r", "漢", "🙂", "<P", ">", "<S>", " "][: 9 if i % 9 else 11]) for _ in range(r.randrange(0, 60))) for i in range(n)]


@pytest.mark.parametrize("unit", PATTERNS)
def test_against_code_points(unit):
    for i, text in enumerate(texts(600)):
        n, form, p, m, out = transform(text.encode(), i, unit)
        assert (n, form, p, m, out.decode()) == brute(text, i, unit)
    assert [transform(t.encode(), i, unit, rate=40, spm=10)[1] for i, t in enumerate(texts(200))] == [brute(t, i, unit, 40, 10)[1] for i, t in enumerate(texts(200))]


def test_select():
    r = random.Random(1)
    for _ in range(200):
        width = r.randrange(1, 300)
        bits = r.getrandbits(width)
        places = [i for i in range(width) if bits >> i & 1]
        assert [select(bits, k, width) for k in range(len(places))] == places
    assert unit_starts(b"a\n\nb", "line") == 0b1101


def test_rows(spark):
    long = "x" * 3_000_000 + "\n" + "é\n" * 500_000
    rows = [(1, "a\nb\nc", 0), (1, "a\nb\nc", 0), (2, None, 0), (3, "", 0), (None, "a\nb\n", 0), (4, "<M>\n", 0), (5, long, 0), (6, "\n\n\n", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n long")
    out = fill_in_middle(docs).withColumn("back", restored(F.col("form"), F.col("output"))).collect()
    assert len(out) == len(rows)
    for (i, text, _), r in zip(sorted(rows, key=repr), sorted(out, key=lambda r: repr((r["doc_id"], r["back"]))), strict=True):
        text = text or ""
        assert r["back"] == text
        if i is not None:
            assert (r["n"], r["form"], r["prefix_chars"], r["middle_chars"], r["output"]) == brute(text, i)
    assert draws(None, 7) == tuple(int(hashlib.sha256(b"7:").hexdigest()[8 * k : 8 * k + 8], 16) for k in range(4))
    assert fill_in_middle(docs.filter("doc_id > 9")).count() == 0
    with pytest.raises(ValueError):
        fill_in_middle(docs, "page")


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    got = {r["doc_id"]: r for r in queries.QUERIES["op13_bit_parallel_fim"](spark, sf).collect()}
    for d in queries.table(spark, sf, "documents").collect():
        n, form, p, m, out = brute(d["text"] or "", d["doc_id"])
        sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
        r = got[d["doc_id"]]
        assert (r["n"], r["form"], r["prefix_chars"], r["middle_chars"], r["output_sha256"], r["restored_sha256"]) == (n, form, p, m, sha(out), sha(d["text"] or ""))
