import zlib

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from girder.llm import packing as K
from girder.llm import token_attribution as A

PATH, RANKS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")
TEXTS = [None, "", "plain words here", "line one\n\n\n  line two\r\nthree ", "日本語 text é\n中文", "<|endoftext|> as text", "x" * 5000, "tabs\t\t \x0bodd\x1c\x85 spaces ", "many words " * 4000]


TOKENIZER = Tokenizer.from_file(PATH)


def exact(text):
    return TOKENIZER.encode(text or "", add_special_tokens=False)


def test_both_encoders_agree():
    e = K.Encoder(PATH, RANKS)
    for t in TEXTS:
        assert e.ids(t or "").tolist() == exact(t).ids


def test_attribution_matches_brute_force(spark):
    docs = spark.createDataFrame([(k, t, 7) for k, t in enumerate(TEXTS)] + [(None, "a\nb", 7)], "doc_id long, text string, section int")
    got = {}
    for r in A.count_by_section(docs, PATH, RANKS).orderBy("section").collect():
        got.setdefault(r["doc_id"], []).append(r)
    for k, t in enumerate(TEXTS):
        t, e, at, spans = t or "", exact(t), 0, []
        for line in t.split("\n"):
            spans.append((at, min(at + len(line) + 1, len(t))))
            at += len(line) + 1
        if len(spans) > 1 and spans[-1][0] >= len(t):
            spans.pop()
        rows = got[k]
        assert [(r["start"], r["end"]) for r in rows] == spans
        assert sum(r["n_tokens"] for r in rows) == len(e.ids)
        # byte spans of tokens, from the vocabulary's own spelling of bytes, and of lines
        wanted, place, lines = [0] * len(spans), 0, [(len(t[:a].encode()), len(t[:b].encode())) for a, b in spans]
        for token in e.tokens:
            a, b = place, place + len(token)
            place = b
            held = [max(0, min(b, y) - max(a, x)) for x, y in lines]
            wanted[held.index(max(held))] += 1
        assert place == len(t.encode())
        assert [r["n_tokens"] for r in rows] == wanted
    assert [r["n_tokens"] for r in got[None]] == [2, 1]


def test_boundary_rule():
    owned, crossing = A.attribute(np.array([2, 6, 8]), np.array([4, 5, 8]))
    assert owned.tolist() == [2, 0, 1] and crossing.tolist() == [1, 0, 0]


def test_fields_are_sections(spark):
    docs = spark.createDataFrame([(1, "hello wor", "ld", None)], "doc_id long, a string, b string, c string")
    got = A.count_by_section(docs, PATH, RANKS, ("a", "b", "c")).orderBy("section").collect()
    assert [(r["start"], r["end"]) for r in got] == [(0, 9), (9, 11), (11, 11)]
    assert [r["n_tokens"] for r in got] == [2, 0, 0] and got[0]["n_crossing"] == 1


def test_packing_round_trip(spark):
    rows = [(k, t, 1) for k, t in enumerate(TEXTS)] + [(50, "twice", 1), (50, "twice", 1), (None, "no id", 1)]
    got = K.pack_documents(spark.createDataFrame(rows, "doc_id long, text string, length int"), PATH, RANKS).collect()
    for k, t in enumerate(TEXTS):
        ids = np.array(exact(t).ids + [1], "<u4")
        pieces = sorted((r for r in got if r["doc_id"] == k), key=lambda r: r["start"])
        assert sum(r["length"] for r in pieces) == len(ids) == pieces[0]["doc_tokens"]
        at = 0
        for r in pieces:
            assert r["start"] == at and r["ids_crc32"] == zlib.crc32(ids[at : at + r["length"]].tobytes())
            at += r["length"]
    assert sum(r["doc_id"] == 50 for r in got) == 2
    sequences = {}
    for r in got:
        sequences.setdefault(r["sequence_id"], []).append(r)
    for s in sequences.values():
        at = 0
        for r in sorted(s, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= K.TOKENS
    assert K.pack_documents(spark.createDataFrame([], "doc_id long, text string"), PATH, RANKS).count() == 0


def test_conversations_under_three_limits(spark):
    r, words = np.random.default_rng(3), "the quick brown fox jumps over a lazy dog and then some".split()
    rows = [(c if c else None, k, "assistant" if k % 2 else "user", " ".join(r.choice(words, r.integers(0, 90)))) for c in range(40) for k in range(r.integers(1, 9))]
    rows += [(50, 0, "user", "long " * 900), (50, 1, "assistant", "answer " * 700), (52, 0, None, None), (52, 0, "assistant", "x"), (52, 0, "assistant", "x")]
    rows += [(60, k, "assistant" if k % 3 == 0 else "user", "a hot one") for k in range(3000)]
    limits = {"tokens": 400, "segments": 3, "loss_tokens": 150}
    got = K.pack_conversations(spark.createDataFrame([(*x, 1) for x in rows], "conv_id long, turn long, role string, text string, length int"), PATH, RANKS, **limits).collect()
    count = {}
    for c, k, role, text in rows:
        n = len(exact(text).ids) + 1
        count.setdefault((c, k), []).append((n, n if role == "assistant" else 0))
    for key, wanted in count.items():
        parts = [x for x in got if (x["conv_id"], x["turn"]) == key]
        assert sum(x["length"] for x in parts) == sum(n for n, _ in wanted) and sum(x["loss"] for x in parts) == sum(m for _, m in wanted)
    sequences = {}
    for x in got:
        sequences.setdefault(x["sequence_id"], []).append(x)
    reached = set()
    for s in sequences.values():
        at, s = 0, sorted(s, key=lambda x: x["offset"])
        for x in s:
            assert x["offset"] == at
            at += x["length"]
        loss, convs = sum(x["loss"] for x in s), {x["conv_id"] for x in s}
        assert at <= 400 and loss <= 150 and len(convs) <= 3
        reached |= {n for n, full in (("tokens", at > 380), ("segments", len(convs) == 3), ("loss", loss > 140)) if full}
    assert reached == {"tokens", "segments", "loss"}
    assert K.pack_conversations(spark.createDataFrame([], "conv_id long, turn long, role string, text string"), PATH, RANKS).count() == 0


def test_vector_limits():
    r = np.random.default_rng(1)
    tokens = r.integers(1, 900, 400)
    demand = np.stack([tokens, np.ones_like(tokens), tokens // r.integers(1, 4, 400)], axis=1)
    box, place = K.pack_vectors(demand, np.array([1000, 3, 600]))
    for b in range(box.max() + 1):
        mine = demand[box == b]
        assert len(mine) == 1 or (mine.sum(axis=0) <= [1000, 3, 600]).all()
        assert sorted(place[box == b]) == list(range(len(mine)))
    big, _ = K.pack_vectors(np.array([[5000, 1, 5000], [1, 1, 1]]), np.array([1000, 3, 600]))
    assert len(set(big)) == 2
