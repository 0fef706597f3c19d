import gzip
import struct
import zlib

from pyspark.sql import functions as F

from girder.sources import binary as B
from girder.sources import sinks as K
from girder.sources import text as T
from girder.streaming import arrivals as A

SHARED = "﻿# comment\n*META\tVERSION\tMINVERSION\nMETA\t2\t1\n*GROUP\tID\tNAME\nGROUP\t1\tWalls\nGROUP\t2\tUnused\n*PARAM\tGUID\tNAME\tDATATYPE\tDATACATEGORY\tGROUP\tVISIBLE\nPARAM\t7D4C1903-c65e-4bcd-9bce-dd06532af03c\tWidth\tLENGTH\t\t1\t1\nPARAM\t64901a31-62e5-4332-b148-9c4ffb93ae51\tWidth\tTEXT\t\t9\t0\nPARAM\tbad\tX\tTEXT\t\t1\t1\nODD\t1\n"


def texts(spark, *rows):
    return spark.createDataFrame(rows, "path string, text string")


def test_encodings(spark):
    cases = [
        ("utf-8", "a é", "high"), ("utf-16le", "abcdefgh", "high"), ("utf-16be", "abcdefgh", "high"), ("windows-1251", "Ширина стены помещения", "medium"), ("windows-1252", "Türhöhe über alles, naïve façade", "medium"),
        ("utf-16le", "Ширина width and the height of it Высота", "high"), ("utf-16be", "Ши: width and height", "high"), ("windows-1251", "# comment in plain letters\nGROUP\t1\tСтены and more plain words", "medium"), ("windows-1252", "\x81 Tür", "medium"),
    ]
    rows = [(str(k), bytearray(v.encode(e.replace("windows-", "cp")) if "\x81" not in v else b"\x81 T\xfcr")) for k, (e, v, _) in enumerate(cases)] + [("bom", bytearray(b"\xef\xbb\xbfx")), ("none", None), ("empty", bytearray(b""))]
    got = {r["path"]: r for r in T.decoded(spark.createDataFrame(rows, "path string, content binary")).collect()}
    for k, (encoding, text, confidence) in enumerate(cases):
        r = got[str(k)]
        assert (r["encoding"], r["text"], r["confidence"], r["had_bom"]) == (encoding, text, confidence, False)
    assert got["bom"]["had_bom"] and got["bom"]["text"] == "x" and got["none"]["text"] is None and got["empty"]["text"] == ""


def test_long_cells_and_arguments_do_not_recurse(spark):
    cell, long = '"' + "x" * 1_000_000 + '"', ",".join(f"#{k}" for k in range(1, 200_001))
    got = T.type_catalog(texts(spark, ("c", f",Width##LENGTH##MM\nA,{cell}\n" + "B," + "y" * 1_000_000 + "\n"))).orderBy("row_no").collect()
    assert [len(r["value"]) for r in got] == [1_000_000, 1_000_000]
    step = T.step_entities(texts(spark, ("s", f"#1=IFCPOLYLINE(({long}));\n#2=IFCLABEL('{'it''s ' * 200_000}');\n")))
    assert sorted((r["entity_id"], r["type"]) for r in step.collect()) == [(1, "IFCPOLYLINE"), (2, "IFCLABEL")]
    assert T.step_references(step).count() == 200_000


def test_products_transmission_and_sidecars(spark):
    step = T.step_entities(texts(spark, ("s", "#1=IFCWALL('g1',#2,'it''s; a (wall)',$);\n#2=IFCDOOR('g2',$,$,$);\n#3=IFCLABEL('x');")))
    assert [tuple(r) for r in T.products(step, ["IfcWall", "IfcDoor"]).orderBy("entity_id").collect()] == [("s", 1, "IFCWALL", "g1", "it's; a (wall)"), ("s", 2, "IFCDOOR", "g2", None)]
    xml = "<T><ExternalFileReference><ExternalFileReferenceType>Link</ExternalFileReferenceType><LastSavedPath>C:\\a\\b.rvt</LastSavedPath><LastSavedLoadedStatus>NotFound</LastSavedLoadedStatus></ExternalFileReference></T>"
    r = T.transmission(texts(spark, ("t", xml))).first()
    assert (r["name"], r["kind"], r["loaded"], r["missing"]) == ("b.rvt", "Link", False, True)
    sidecar = '{"version":1,"fingerprint":"f","kind":"comments","items":[{"id":"1","updatedAt":"2026-01-01","text":"a"}]}'
    good, bad = T.sidecar_items(texts(spark, ("a", sidecar), ("b", sidecar.replace('"f"', '"g"')), ("c", "none")), "f")
    assert [(r["path"], r["id"]) for r in good.collect()] == [("a", "1")] and sorted((r["path"], r["error"]) for r in bad.collect()) == [("b", "another model"), ("c", "no sidecar")]


def test_shared_parameters(spark):
    shared = T.SharedParameters(texts(spark, ("a", SHARED.lstrip("﻿"))))
    rows = {r["guid"]: r for r in shared.parameters.collect()}
    assert len(rows) == 3 and rows["64901a31-62e5-4332-b148-9c4ffb93ae51"]["visible"] is False and all(r["user_modifiable"] for r in rows.values())
    assert sorted(r["code"] for r in shared.issues().collect()) == ["duplicate-name", "invalid-guid", "missing-group", "unused-group"]
    assert [r["warning"] for r in shared.warnings.collect()] == ["unknown record type ODD"]
    other = T.SharedParameters(texts(spark, ("a", SHARED.lstrip("﻿")), ("b", SHARED.replace("Width\tLENGTH", "Breadth\tAREA").lstrip("﻿"))))
    changes = {(r["guid"][:4], r["change"]) for r in other.compared("a", "b").collect()}
    assert changes == {("7d4c", "renamed"), ("7d4c", "incompatible"), ("6490", "unchanged"), ("bad", "unchanged")}
    merged = {r["guid"][:4]: r for r in other.merged(F.col("path")).collect()}
    assert merged["7d4c"]["name"] == "Width" and merged["7d4c"]["conflict"] and not merged["6490"]["conflict"]


def test_type_catalog_and_taxonomy(spark):
    got = T.type_catalog(texts(spark, ("c", ',Width##LENGTH##MILLIMETERS,Note##OTHER##\nA,10,"x, ""y""\nz"\n,,\nB,20\n'))).orderBy("row_no", "column").collect()
    assert [(r["type_name"], r["column"], r["value"]) for r in got] == [("A", "Note", 'x, "y"\nz'), ("A", "Width", "10"), ("B", "Note", ""), ("B", "Width", "20")]
    assert got[1]["unit"] == "MILLIMETERS"
    rows = T.taxonomy(texts(spark, ("o", "23.10\tDoors\t2\t-2000023\n23.20\tGates\t2\n\nbad")))
    assert T.merged_taxonomies(rows, rows).count() == 2


def test_step_and_atom(spark):
    step = T.step_entities(texts(spark, ("s", "DATA;\n#1=IFCWALL('a;#9',#2,$);\n#2= IFCDOOR('it''s',#1);\n")))
    assert sorted((r["entity_id"], r["type"]) for r in step.collect()) == [(1, "IFCWALL"), (2, "IFCDOOR")]
    assert sorted((r["entity_id"], r["target"]) for r in T.step_references(step).collect()) == [(1, 2), (2, 1)]
    atom = T.atom_entries(texts(spark, ("x", '<?xml version="1.0"?><A:entry xmlns:A="u"><A:title>T</A:title><A:category><A:term>Doors</A:term></A:category></A:entry>'), ("y", "no xml"))).orderBy("path").collect()
    assert (atom[0]["title"], atom[0]["categories"], atom[1]["title"]) == ("T", ["Doors"], None)


def test_binary_records_and_chunks(spark):
    token = b"\x04\x00" + struct.pack("<II", 5, 0xFFE17B00) + b"\xff" * 8
    page = b"\x01" * 7 + token + b"\x04\x00" + b"\x00" * 30 + token
    rows = B.scan_records(spark.createDataFrame([("p", bytearray(page)), ("q", bytearray(b""))], "path string, content binary"), B.CATEGORY_TOKEN).collect()
    assert [(r["offset"], r["discriminator"]) for r in rows] == [(7, 5), (57, 5)]
    whole = gzip.compress(b"abc" * 5000) + b"junk" + gzip.compress(b"xyz")
    got = B.inflate(spark.createDataFrame([("s", bytearray(whole))], "path string, content binary")).orderBy("chunk").collect()
    assert [(bytes(r["content"]), r["complete"]) for r in got] == [(b"abc" * 5000, True), (b"xyz", True)]
    big = bytes(range(256)) * 80_000
    stream = gzip.compress(big) + gzip.compress(b"after")
    got = B.inflate(spark.createDataFrame([("s", bytearray(stream)), ("cut", bytearray(stream[: len(stream) // 2])), ("none", None)], "path string, content binary")).orderBy("path", "chunk", "piece").collect()
    whole = [r for r in got if r["path"] == "s"]
    assert b"".join(bytes(r["content"]) for r in whole if r["chunk"] == 0) == big and max(len(r["content"]) for r in whole) <= B.PIECE
    assert bytes(whole[-1]["content"]) == b"after" and whole[-1]["complete"] and whole[-2]["complete"]
    cut = [r for r in got if r["path"] == "cut"]
    assert big.startswith(b"".join(bytes(r["content"]) for r in cut)) and not cut[-1]["complete"]
    deflate = zlib.compressobj(wbits=-15, zdict=(b"abc" * 5000)[-32768:])
    linked = gzip.compress(b"abc" * 5000) + b"\x1f\x8b\x08\0\0\0\0\0\0\x03" + deflate.compress(b"abc" * 100 + b"!") + deflate.flush() + b"\0" * 8
    got = B.inflate(spark.createDataFrame([("d", bytearray(linked))], "path string, content binary")).orderBy("chunk").collect()
    assert bytes(got[1]["content"]) == b"abc" * 100 + b"!"
    assert B.strip_page_checksums(b"a" * 64_896 + b"b" * 353 + b"c") == b"a" * 64_896 + b"c"
    assert B.strip_page_checksums(b"a" * 65_000) == b"a" * 65_000, "a page that isn't whole stays"


def test_sinks(spark, tmp_path):
    rows = spark.createDataFrame([(2, "it's é", 'a,"b'), (1, "x", None)], "k int, name string, note string")
    K.write_lines(K.delimited(rows, ["k", "note"], ","), str(tmp_path / "csv"), ["k"])
    lines = "".join(p.read_text() for p in sorted((tmp_path / "csv").glob("part-*"))).splitlines()
    assert lines == ["1,", '2,"a,""b"']
    step = K.step_products(rows.withColumn("c", F.lit("IfcDoor")), "k", "c", "name", "note").orderBy("k").collect()
    assert step[1]["line"].startswith("#2=IFCDOOR('it''s \\X2\\00E9\\X0\\',$,")
    triangle = spark.createDataFrame([(1, 0, *map(float, range(9)))], "e int, o int, x0 double, y0 double, z0 double, x1 double, y1 double, z1 double, x2 double, y2 double, z2 double")
    assert [r["line"] for r in K.obj_lines(triangle, "e", "o").orderBy("part").collect()][3] == "f -3 -2 -1"


def test_arrivals(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text(SHARED)

    def run():
        decode = lambda files: T.SharedParameters(T.decoded(files)).parameters
        A.merge_arrivals(A.arriving_files(spark, str(tmp_path / "in")), decode, str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination()

    run()
    (tmp_path / "in" / "b.txt").write_text(SHARED.replace("Width", "Breadth"))
    run()
    got = A.latest(spark.read.parquet(str(tmp_path / "out")), "guid", ["batch"]).collect()
    assert len(got) == 3 and {r["name"] for r in got} == {"Breadth", "X"}


def test_bounds_take_the_smaller_copy(spark):
    import struct

    def record(element, first, second, code=5, reserved=0, entries=1):
        head = struct.pack("<IIQ2sIIIIII", element, 0, 9, b"\xc6\x08", code, reserved, element, 0, 0x00088004, entries) + struct.pack("<I", 3)
        return head + b"\0" * (6 * entries - 4) + struct.pack("<12d", *first, *second)

    box = lambda x, y=1.0, z=1.0: (0.0, 0.0, 0.0, x, y, z)
    inf = float("inf")
    cases = {
        "second": (record(1, box(5.0), box(4.0)), 4.0), "first": (record(1, box(3.0), box(4.0)), 3.0), "equal": (record(1, box(3.0), box(3.0)), 3.0),
        "broken": (record(1, box(inf), box(9.0)), 9.0), "none": (record(1, box(inf), box(-1.0)), None), "thin": (record(1, box(2.0, 0.0, 0.0), box(7.0)), 7.0),
        "reserved": (record(1, box(3.0), box(3.0), reserved=1), None), "no code": (record(1, box(3.0), box(3.0), code=0xFFFFFFFF, reserved=1), 3.0),
        "zero": (record(0, box(3.0), box(3.0)), None), "no entries": (record(1, box(3.0), box(3.0), entries=0), None), "many": (record(1, box(3.0), box(3.0), entries=300), 3.0), "cut": (record(1, box(3.0), box(3.0))[:-1], None), "empty": (b"", None), "null": (None, None),
    }
    rows = spark.createDataFrame([(k, v if v is None else bytearray(v)) for k, (v, _) in cases.items()], "path string, content binary")
    got = {r["path"]: (r["x1"], r["duplicated"]) for r in B.duplicated_bounds(rows).collect()}
    assert {k: x for k, (x, _) in got.items()} == {k: x for k, (_, x) in cases.items() if x is not None}
    assert got["equal"][1] and not got["second"][1]
