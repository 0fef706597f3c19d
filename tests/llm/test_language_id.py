import math
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from girder.llm import language_id as L

TEXTS = {"en": ["the cat and the dog sat on the mat", "then there was the other thing"], "fr": ["le chat et le chien sont sur la table", "été où déjà"]}


def trained(texts):
    return L.compile_trees(sorted(texts), {x: grams(t) for x, t in texts.items()})


def grams(texts):
    n = Counter()
    for t in texts:
        b = t.encode()
        for i in range(len(b)):
            for k in range(min(i, L.ORDER) + 1):
                n[k + 1, sum(b[i - j] << 8 * j for j in range(k + 1))] += 1
    return [(s, g, c) for (s, g), c in n.items()]


def brute_bits(texts, text):
    seen = defaultdict(Counter)
    for t in texts:
        b = t.encode()
        for i in range(len(b)):
            for k in range(min(i, L.ORDER) + 1):
                seen[b[i - k : i]][b[i]] += 1
    all_contexts = {c for t in TEXTS.values() for x in t for i in range(len(x.encode())) for k in range(min(i, L.ORDER) + 1) for c in [x.encode()[i - k : i]]}
    total, b = 0.0, text.encode()
    for i in range(len(b)):
        context = b[max(0, i - L.ORDER) : i]
        while context and context not in all_contexts:
            context = context[1:]
        while True:
            n = seen.get(context)
            if n and b[i] in n:
                total -= math.log2(n[b[i]] / (sum(n.values()) + len(n)))
                break
            if n:
                total -= math.log2(len(n) / (sum(n.values()) + len(n)))
            if not context:
                total += 8
                break
            context = context[1:]
    return total


def test_code_lengths_match_brute_force(monkeypatch):
    model = trained(TEXTS)
    cases = ["the chat", "", "é", "zzz the", "a" * 50, "été et the dog \x00"]
    for chunk in (1 << 19, 7):
        monkeypatch.setattr(L, "CHUNK", chunk)
        got = L.code_lengths(pa.array(cases, pa.large_string()), model, model.table())
        wanted = np.array([[brute_bits(TEXTS[x], t) for x in model.languages] for t in cases])
        assert np.allclose(got, wanted, rtol=1e-5)


def test_tables_keep_their_bound():
    whole = trained(TEXTS)
    bound = len(whole.contexts) * 1000
    model = L.compile_trees(sorted(TEXTS), {x: grams(t) for x, t in TEXTS.items()}, bound)
    assert 0 < len(model.contexts) < len(whole.contexts)
    assert model.row.nbytes + model.depth.nbytes + model.cost.nbytes + model.escape.nbytes <= bound + 2000
    assert np.isfinite(L.code_lengths(pa.array(["the chat"], pa.large_string()), model, model.table())).all()


def test_copies_count_once(spark):
    rows = [("same text", "en")] * 5000 + [(f"text {k}", "en") for k in range(50)] + [("un texte", "fr")]
    got = L.bounded_sample(spark.createDataFrame(rows, "text string, lang string"), "lang", 30).collect()
    assert sum(r["text"] == "same text" for r in got) <= 1 and 10 <= sum(r["lang"] == "en" for r in got) <= 50 and sum(r["lang"] == "fr" for r in got) == 1


def test_a_language_of_any_size_is_sampled(spark):
    sizes = [10, 300, 3 * 10**8, 4 * 10**8, 10**12]
    shares = [r[0] for r in spark.createDataFrame([(n,) for n in sizes], "n long").select(L.share_of(F.col("n"), 300)).collect()]
    assert all(abs(share * n - min(300, n)) < 1e-3 for share, n in zip(shares, sizes, strict=True))
    places = spark.range(100_000).select(L.placed(F.xxhash64("id")).alias("p"))
    assert abs(places.filter("p < 0.03").count() - 3000) < 300 and places.filter("p < 0 or p >= 1").count() == 0


def test_pipeline_and_edge_cases(spark):
    rows = [(k, TEXTS["en" if k % 2 else "fr"][k % 4 // 2] + f" {k}", "en" if k % 2 else "fr", "x") for k in range(60)] + [(100, None, "en", "x"), (101, "123 ...", "en", "x"), (102, "the dog " * 20_000, None, "x"), (None, "le chat et la table", "fr", "x"), (5, "the mat", "en", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, score string")
    got = L.identify(docs).collect()
    assert len(got) == len(rows)
    by = {r["doc_id"]: r for r in got if r["doc_id"] not in (5, None)}
    assert all(by[k]["lang_pred"] == ("en" if k % 2 else "fr") for k in by if k < 60)
    assert by[100]["lang_pred"] == by[101]["lang_pred"] == "und" and by[100]["score"] == 0
    assert by[102]["lang_pred"] == "en" and 0 <= by[102]["score"] <= 1
    import zlib

    assert all(r["held_out"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in got)
    assert L.identify(docs.limit(0)).count() == 0
    assert {r["lang_pred"] for r in L.identify(docs.filter("doc_id = 102")).collect()} == {"und"}


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = L.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").filter("held_out").collect()
    assert len(got) > 200 and sum(r["lang"] == r["lang_pred"] for r in got) >= 0.98 * len(got)
