"""The trie against a walk over nested dictionaries."""

import hashlib
import random
import re
import zlib

import pytest

from girder.llm import prefix_trie, queries

SCHEMA = "conv_id long, turn int, role string, text string, depth int"


def brute(rows, grafted=True):
    own = {}
    for conv, turn, role, text, *_ in rows:
        if conv is not None:
            pair = (role or "", text or "")
            own.setdefault(conv, []).append((turn is not None, turn or 0, hashlib.sha256(f"{len(pair[0])}:{pair[0]}{pair[1]}".encode()).digest(), pair))
    own = {c: [x[3] for x in sorted(v)] for c, v in own.items()}
    made = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 4 if grafted else 0
        family = c - (c % 20 if c >= 0 else -(-c % 20))
        made[c] = tuple(own.get(family, [])[:h] + turns[h:])
    members = {}
    for c, turns in made.items():
        for d in range(len(turns) + 1):
            members.setdefault(turns[:d], []).append(c)
    children = {}
    for p in members:
        if p:
            children.setdefault(p[:-1], []).append(p)
    leaves, saved = {}, {}
    for p in sorted(members, key=len, reverse=True):
        below = children.get(p, [])
        leaves[p] = sum(leaves[q] for q in below) or 1
        own_saved = (len(members[p]) - 1) * len(re.findall(r"[^\x20\x09-\x0D]+", p[-1][1])) if p else 0
        saved[p] = own_saved + sum(saved[q] for q in below)
    out = []
    for p, m in members.items():
        ends = ",".join(str(c) for c in sorted(c for c in m if made[c] == p))
        out.append((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), len(children.get(p, [])), leaves[p], saved[p], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=repr)


COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def found(df):
    return sorted((tuple(r) for r in df.select(*COLUMNS).collect()), key=repr)


def rows(n, seed, words, longest):
    r = random.Random(seed)
    out = []
    for c in range(n):
        if r.random() < 0.1:
            continue
        k = r.choice([1, 2, 3, longest])
        out += [(c, t, r.choice(["user", "assistant"]), " ".join(r.choices(words, k=r.randrange(0, 3))), 5) for t in range(k)]
    r.shuffle(out)
    return out


@pytest.mark.parametrize("local", [1, 7, 4096])
def test_against_nested_dictionaries(spark, local):
    # a third of the rows are one long conversation, its copies and one that leaves it late
    data = rows(150, 1, ["a", "b"], 6)
    for c in (400, 401, 480, 481):
        data += [(c, t, "user", f"w{t} x", 5) for t in range(40)]
    data += [(440, t, "user", f"w{t} x" if t < 33 else "other word y", 5) for t in range(40)]
    data += [(-5, 0, "user", "a b", 5), (-25, 0, "user", "a b", 5), (-20, 0, "assistant", "", 5)]
    turns, _ = prefix_trie.encode(spark.createDataFrame(data, SCHEMA))
    grafted, convs = prefix_trie.graft(turns, block=4)
    assert found(prefix_trie.trie(grafted, convs, local=local, bin_rows=50, block=4)) == brute(data)


def test_cases(spark):
    data = [(1, None, None, None, 0), (1, 0, "user", "a", 0), (2, None, "", "", 0), (2, 0, "user", "a", 0), (2, 0, "user", "a", 0), (None, 0, "user", "lost", 0), (3, 5, "user", "x" * 2_000_000, 0), (4, 1, "user", "b", 0), (4, 1, "user", "c", 0)]
    df = spark.createDataFrame(data, SCHEMA)
    turns, dictionary = prefix_trie.encode(df)
    assert dictionary.count() == 5
    assert found(prefix_trie.trie(turns, prefix_trie.conversations(turns))) == brute(data, grafted=False)
    grafted, convs = prefix_trie.graft(turns)
    assert found(prefix_trie.trie(grafted, convs)) == brute(data)
    turns, _ = prefix_trie.encode(df.filter("conv_id > 99"))
    assert found(prefix_trie.trie(*prefix_trie.graft(turns))) == []


def test_many_members_are_hashed_as_a_stream(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "ID_BITS", 2)
    data = [(c, t, "user", f"{t} {c % 2}", 0) for c in range(0, 200, 3) for t in range(3)]
    turns, _ = prefix_trie.encode(spark.createDataFrame(data, SCHEMA))
    assert found(prefix_trie.trie(turns, prefix_trie.conversations(turns), local=20)) == brute(data, grafted=False)


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    data = [tuple(r) for r in queries.table(spark, sf, "conversations").select("conv_id", "turn", "role", "text").collect()]
    assert found(queries.QUERIES["op11_prefix_trie"](spark, sf)) == brute(data)
