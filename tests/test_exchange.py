"""Exchange files, identifiers, libraries, recent files and postings on small inputs."""

import random
import re
import uuid

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from girder.functions import identifiers as I
from girder.operators.postings import Postings, values_of
from girder.sources import step, text
from girder.sources.library import read_library
from girder.sources.sinks import step_text
from girder.streaming import recents


def test_identifiers(spark):
    r = random.Random(1)
    ids = [(uuid.UUID(int=r.getrandbits(128)), r.choice([0, 7, 1 << 31, (1 << 32) - 1, 1 << 40])) for _ in range(50)]
    rows = spark.createDataFrame([(str(u), u.bytes_le, e) for u, e in ids], "guid string, raw binary, element long")
    unique = I.unique_id(F.col("guid"), F.col("element"))
    guid, element = I.unique_id_parts(unique)
    out = rows.select("guid", "raw", "element", I.guid_text(F.col("raw")).alias("text"), I.guid_bytes(F.upper("guid")).alias("back"), unique.alias("unique"), guid.alias("g"), element.alias("e"), I.exchange_guid(unique).alias("x"), I.compact(F.col("guid")).alias("c"), I.expanded(I.compact(F.col("guid"))).alias("d")).collect()
    for row in out:
        u = uuid.UUID(row["guid"])
        digits, n = "", u.int
        for _ in range(22):
            digits, n = I.COMPACT[n % 64] + digits, n // 64
        assert (row["text"], bytes(row["back"]), row["g"], row["e"], row["c"], row["d"]) == (str(u), u.bytes_le, str(u), row["element"], digits, str(u))
        assert row["unique"] == f"{u}-{row['element']:08x}" and uuid.UUID(row["x"]).int == u.int ^ (row["element"] & 0xFFFFFFFF)
    bad = spark.createDataFrame([(None, None), ("x", b"short"), ("00000000-0000-0000-0000-00000000000g", b"")], "t string, b binary")
    assert all(v is None for r in bad.select(I.guid_text(F.col("b")), I.guid_bytes(F.col("t")), I.compact(F.col("t")), I.expanded(F.col("t")), *I.unique_id_parts(F.col("t")), I.exchange_guid(F.col("t"))).collect() for v in r)


def test_step_texts(spark):
    plain = ["Türe é", "it's \\ and \\X2\\ so", "漢字 🙂 x", "", "a\\\\b"]
    rows = spark.createDataFrame([(p,) for p in plain], "t string")
    quoted = step_text(F.col("t"))
    back = text.step_decoded(F.replace(F.substring(quoted, F.lit(2), F.length(quoted) - 2), F.lit("''"), F.lit("'")))
    assert [r[0] for r in rows.select(back).collect()] == plain
    odd = {r"\X\E9t\X\E9": "été", r"\S\i": "é", r"caf\X2\00E9\X0\s": "cafés", r"\X4\0001F642\X0\!": "🙂!", r"a\\b": "a\b".replace("\b", "\\b"), "plain": "plain", r"\X2\00E900E8\X0\x\X2\00E9\X0\y": "éèxéy"}
    got = spark.createDataFrame([(k,) for k in odd], "t string").select("t", text.step_decoded(F.col("t")).alias("d")).collect()
    assert {r["t"]: r["d"] for r in got} == odd


ELEMENT = "element long, ifc_class string, guid string, name string, level long, material long, host long, x0 double, x1 double, y0 double, y1 double, z0 double, z1 double"


def test_whole_files(spark, tmp_path):
    box = (0.0, 1.5, 0.0, 2.0, 0.0, 1e-7)
    rows = [(k, "IfcWall" if k % 2 else "IfcDoor", f"g{k}", None if k == 3 else f"Tür {k}", k % 4 if k != 5 else None, k % 3 if k != 6 else 77, k + 1 if k % 5 == 0 else None, *(box if k % 3 else (None,) * 6)) for k in range(40)]
    levels = spark.createDataFrame([(k, f"Étage {k}", 3.0 * k) for k in range(4)], "level long, name string, elevation double")
    materials = spark.createDataFrame([(k, f"Béton {k}") for k in range(3)], "material long, name string")
    for name, data in (("model", rows), ("it's empty", [])):
        step.write_ifc(str(tmp_path / name), name, levels, materials, spark.createDataFrame(data, ELEMENT))
        whole = "\n".join(p.read_text().rstrip("\n") for p in sorted((tmp_path / name).glob("part-*")))
        assert whole.startswith("ISO-10303-21;\nHEADER;") and whole.endswith("ENDSEC;\nEND-ISO-10303-21;")
        lines = re.findall(r"^#(\d+)=(.*);$", whole, re.M)
        numbers = [int(n) for n, _ in lines]
        assert numbers == list(range(1, len(numbers) + 1))
        assert {int(n) for _, body in lines for n in re.findall(r"#(\d+)", re.sub(r"'(?:[^']|'')*'", "", body))} <= set(numbers)
        for _, body in lines:
            assert body.count("(") == body.count(")")
        entities = text.step_entities(spark.createDataFrame([("x", whole)], "path string, text string"))
        assert entities.count() == len(lines)
        found = sorted((r["guid"], r["name"]) for r in text.products(entities, ["IfcWall", "IfcDoor"]).withColumn("name", F.coalesce("name", F.lit("-"))).collect())
        # an owner history stands between guid and name, as in every product
        assert found == sorted((r[2], r[3] or "-") for r in data)
        kinds = [body.split("(")[0] for _, body in lines]
        assert kinds.count("IFCRELVOIDSELEMENT") == kinds.count("IFCRELFILLSELEMENT") == kinds.count("IFCOPENINGELEMENT") == sum(r[6] is not None and r[6] < 40 for r in data)
        assert kinds.count("IFCEXTRUDEDAREASOLID") == sum(r[7] is not None for r in data)


def test_relations_list_runs(spark, monkeypatch):
    monkeypatch.setattr(step, "LISTED", 10)
    rows = [(k, "IfcWall", f"g{k}", "w", 1, None, None, *(None,) * 6) for k in range(95)]
    levels = spark.createDataFrame([(1, "L", 0.0)], "level long, name string, elevation double")
    out = step.ifc_lines("m", levels, spark.createDataFrame([], "material long, name string"), spark.createDataFrame(rows, ELEMENT).repartition(1)).filter("line like '%IFCRELCONTAINED%'").collect()
    listed = [re.findall(r"#(\d+)", r["line"].split("(", 1)[1])[1:-1] for r in out]
    assert len(listed) >= 10 and max(map(len, listed)) <= 10 and len({n for x in listed for n in x}) == 95


def test_malformed_atom_texts(spark):
    good = '<?xml version="1.0" encoding="UTF-8"?><A:entry xmlns:A="u"><A:title>T é</A:title><A:id>7</A:id><A:category><A:term>Doors</A:term></A:category></A:entry>'
    rows = [("good", good), ("open", "<feed><entry></feed>"), ("amp", "<a>R & B</a>"), ("none", None), ("empty", "  "), ("text", "no xml"), ("cut", good[:60])]
    out = {r["path"]: r for r in text.atom_entries(spark.createDataFrame(rows, "path string, text string")).collect()}
    assert (out["good"]["title"], out["good"]["id"], out["good"]["categories"], out["good"]["error"]) == ("T é", "7", ["Doors"], None)
    assert {k: (r["error"] or "").split(":")[0] for k, r in out.items() if k != "good"} == {"open": "malformed", "amp": "malformed", "none": "empty", "empty": "empty", "text": "malformed", "cut": "malformed"}


def test_library_source(spark, tmp_path):
    atom = "<e><title>Door</title><category><term>Doors</term></category></e>"
    files = {"a.xml": atom.encode(), "deep/b.xml": atom.encode("utf-16"), "c.xml": b"", "d.xml": atom[:30].encode(), "e_cat.txt": b",Width##LENGTH##MM,Note##OTHER##\nSmall,1,x\nLarge,2,\"y, z\"\n", "f_cat.txt": b"no header\n1,2\n", "g_cat.txt": b",W##L##\nA,1,2\n", "h_cat.txt": b',W##L##\n"A,1\n', ".hidden": b"x", "i.xml": b"<e>\xff\xfe</e>"}
    for name, data in files.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(data)
    (tmp_path / "gone.xml").symlink_to(tmp_path / "nowhere.xml")
    out = {r["path"].split("/")[-1]: r for r in read_library(spark, str(tmp_path)).collect()}
    assert (out["a.xml"]["title"], out["b.xml"]["title"], out["b.xml"]["categories"], out["a.xml"]["bytes"]) == ("Door", "Door", ["Doors"], len(atom))
    assert (out["e_cat.txt"]["types"], out["e_cat.txt"]["columns"], out["e_cat.txt"]["error"]) == (["Small", "Large"], ["Width", "Note"], None)
    errors = {k: r["error"] for k, r in out.items() if r["error"]}
    assert errors["c.xml"] == "empty" and errors["d.xml"].startswith("malformed: ") and errors["f_cat.txt"] == "malformed: no header of columns"
    assert errors["g_cat.txt"] == "malformed: row 2 has more cells than the header" and errors["h_cat.txt"].startswith("malformed")
    assert set(errors) <= {"c.xml", "d.xml", "f_cat.txt", "g_cat.txt", "h_cat.txt", "gone.xml"} and ".hidden" not in out
    (tmp_path / "none").mkdir()
    assert read_library(spark, str(tmp_path / "none")).count() == 0


def newest(events, cap, expiry):
    """Lists by going through events without removals in any order."""
    out = {}
    for owner, name, size, modified, at, _ in events:
        mine = out.setdefault(owner, {})
        mine[name, size, modified] = max(at, mine.get((name, size, modified), at))
    lists = {}
    for owner, mine in out.items():
        top = max(mine.values())
        lists[owner] = [(k[0], k[1], k[2], at) for k, at in sorted(mine.items(), key=lambda e: (-e[1], e[0][0], e[0][1])) if at >= top - expiry][:cap]
    return lists


def test_a_list_by_events():
    e = lambda name, at, gone=False, modified=1: (name, 1, modified, at, gone)
    run = lambda *events: [x[0] for x in __import__("functools").reduce(lambda acc, v: recents.merged(acc, v, 3, 100), events, []) if not x[4]]
    assert run(e("a", 1), e("b", 2), e("a", 3)) == ["a", "b"]
    assert run(e("a", 1), e("a", 5, True), e("a", 3)) == []  # opened before it was removed, told late
    assert run(e("a", 5), e("a", 3, True)) == ["a"]
    assert run(e("a", 5), e("a", 5, True)) == [] == run(e("a", 5, True), e("a", 5))
    assert run(e("a", 1), e("b", 2), e("c", 3), e("d", 4)) == ["d", "c", "b"]
    assert run(e("a", 1), e("b", 102)) == ["b"] == run(e("b", 102), e("a", 1))
    assert run(e("a", 1, modified=None), e("a", 2, modified=7)) == ["a"]


def test_recents_survive_a_restart(spark, tmp_path):
    r = random.Random(6)
    events = [(o, f"f{r.randrange(9)}", r.randrange(2), r.randrange(2), at, False) for at, o in enumerate(r.choices([1, 2, 3, 4], [6, 2, 1, 1], k=240))]
    r.shuffle(events)  # rows come late
    schema = "owner long, name string, size long, modified long, opened_at long, removed boolean"
    source, out, check = (str(tmp_path / x) for x in ("in", "out", "check"))
    for k in range(3):
        spark.createDataFrame(events[80 * k : 80 * k + 80], schema).repartition(2).write.mode("append").parquet(source)
        recents.keep_recents(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source), out, check, 4, 150).awaitTermination()
    lists = spark.read.parquet(out)
    assert lists.select("batch").distinct().count() >= 6
    got = {}
    for x in recents.current_recents(lists).orderBy("owner", "place").collect():
        got.setdefault(x["owner"], []).append((x["name"], x["size"], x["modified"], x["opened_at"]))
    assert got == newest(events, 4, 150)
    spark.createDataFrame([(4, n, s, m, 10_000, True) for n, s, m, _ in got[4]] + [(None, "x", 1, 1, 1, False), (5, None, 1, 1, 1, False)], schema).write.mode("append").parquet(source)
    recents.keep_recents(spark.readStream.schema(schema).parquet(source), out, check, 4, 10**6).awaitTermination()
    left = {x["owner"] for x in recents.current_recents(spark.read.parquet(out)).collect()}
    assert left == {1, 2, 3}


def test_recents_merge_only_what_may_stay(monkeypatch):
    class Kept:
        held, puts = [], 0

        def get(self):
            return iter(self.held)

        def put(self, entries):
            self.held, self.puts = entries, self.puts + 1

        def clear(self):
            self.put([])

    r = random.Random(8)
    row = Row("owner", "name", "size", "modified", "opened_at", "removed")
    events = [(7, f"f{r.randrange(9)}", r.randrange(2), r.randrange(2), at, False) for at in range(10_000)]
    r.shuffle(events)
    met, plain = [], recents.merged
    monkeypatch.setattr(recents, "merged", lambda *a: met.append(a) or plain(*a))
    lists = recents.Recents(4, 150)
    lists.entries = Kept()
    told = lambda some: [tuple(x[c] for c in ("place", "name", "size", "modified", "opened_at")) for x in lists.handleInputRows((7,), iter([row(*e) for e in some]), None)]
    wanted = [(k, *e) for k, e in enumerate(newest(events, 4, 150)[7], 1)]
    assert told(events) == wanted
    assert len(met) < 500  # of 10,000
    # what changes nothing is told again, but not written
    assert told(events[:50] + [(7, None, 1, 1, 99_999, False), (7, "x", None, 1, 99_999, False), (7, "x", 1, 1, None, True)]) == wanted and lists.entries.puts == 1
    assert told([(7, n, s, m, 10_000, True) for _, n, s, m, _ in wanted]) == [(0, None, None, None, None)]
    lists.entries = Kept()
    assert told([(7, "a", 1, None, 5, True)]) == [(0, None, None, None, None)] and len(lists.entries.held) == 1


def test_postings_find_what_a_scan_finds(spark):
    r = random.Random(7)
    word = lambda: "".join(r.choice("abcÉ ") for _ in range(r.randrange(0, 9)))
    data = [(k, word() if k % 5 else None, [word() for _ in range(r.randrange(4))] if k % 7 else None) for k in range(300)]
    rows = spark.createDataFrame(data, "id long, name string, types array<string>")
    index = Postings(rows, "id", values_of(F.array("name"), F.coalesce("types", F.array().cast("array<string>"))))
    for query in ("abc", "a", "", "cab a", "éa", "abca", "zzz", " AB ", "cccc"):
        needle = query.strip().lower()
        wanted = [k for k, n, t in data if not needle or any(needle in v.lower() for v in [n, *(t or [])] if v is not None)]
        assert [x["id"] for x in index.search(query, ["id"], 1000).collect()] == wanted, query
    assert len(index.search("", ["id"]).collect()) == 100
    plan = index.candidates("abca")._jdf.queryExecution().toString()
    assert "PushedFilters: [In(gram" in plan
    assert index.candidates("abca").count() < 300 and index.candidates("ab") is None
    assert Postings(rows.limit(0), "id", values_of(F.array("name"))).search("abc", ["id"]).count() == 0


@pytest.mark.parametrize("n", [0, 1, 500])
def test_numbers_are_dense(spark, n):
    rows = spark.range(n).withColumn("k", F.col("id") % 3).repartition(3)
    out, after = step.numbered(rows, ["id"], F.col("k") + 1, 10)
    got = [(r["number"], r["k"]) for r in out.orderBy("id").collect()]
    at = 10
    for number, k in got:
        assert number == at
        at += k + 1
    assert after == at and len(got) == n
