"""Text libraries as DataFrames: shared parameters, type catalogs, taxonomies, Atom entries, STEP files.

Files come as (path, content) from Spark's ``binaryFile`` source; a record
keeps its file and line, so first-wins rules have an order. A library file is
small; the number of files is what grows.
"""

from __future__ import annotations

import codecs
import re
from xml.etree import ElementTree

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as Y

from girder.functions.semantics import leading_integer, trim_all


def read_files(spark: SparkSession, path: str, pattern: str = "*.txt") -> DataFrame:
    """(path, content) of all files below a folder."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(path).select("path", "content")


#: Bytes that are looked at for the zero bytes of UTF-16, the share of pairs that have one on one side, and at most on the other.
SAMPLE_BYTES, ZEROS, STRAY = 4096, 0.35, 0.1
_MARKS = ((codecs.BOM_UTF8, "utf-8"), (codecs.BOM_UTF16_LE, "utf-16le"), (codecs.BOM_UTF16_BE, "utf-16be"))
_CYRILLIC, _WORD_OF_THREE, _MOJIBAKE = re.compile("[\u0400-\u04ff]"), re.compile("[\u0400-\u04ff]{3}"), re.compile("[\u00c3\u00c2][\u0080-\u00ff]")
# bytes that a Windows code page leaves out stand for the control characters of their number
codecs.register_error("girder-control", lambda e: ("".join(map(chr, e.object[e.start : e.end])), e.end))


def encoding_of(content: bytes) -> tuple[str, str, int]:
    """(encoding, confidence, length of the byte-order mark) of a text's bytes."""
    for mark, name in _MARKS:
        if content.startswith(mark):
            return name, "high", len(mark)
    zero = np.frombuffer(content[:SAMPLE_BYTES], np.uint8) == 0
    pairs = max(1, len(zero) // 2)
    first, second = (zero[k : 2 * (len(zero) // 2) : 2].sum() / pairs for k in (0, 1))
    for name, many, few in (("utf-16le", second, first), ("utf-16be", first, second)):
        if many > ZEROS and few < STRAY:
            return name, "high", 0
    try:
        content.decode("utf-8")
        return "utf-8", "high", 0
    except UnicodeDecodeError:
        letters = content.decode("cp1251", "girder-control")
        cyrillic = _WORD_OF_THREE.search(letters) and len(_CYRILLIC.findall(letters)) >= 3
        return "windows-1251" if cyrillic and not _MOJIBAKE.search(content.decode("cp1252", "girder-control")) else "windows-1252", "medium", 0


@F.pandas_udf(Y.StructType([*(Y.StructField(n, Y.StringType()) for n in ("text", "encoding", "confidence")), Y.StructField("had_bom", Y.BooleanType())]))
def _decoded(content: pd.Series) -> pd.DataFrame:
    rows = []
    for b in content:
        if b is None:
            rows.append((None, None, None, None))
            continue
        name, confidence, mark = encoding_of(bytes(b))
        how = {"windows-1251": ("cp1251", "girder-control"), "windows-1252": ("cp1252", "girder-control")}.get(name, (name, "replace"))
        rows.append((bytes(b)[mark:].decode(*how).removeprefix("\ufeff"), name, confidence, mark > 0))
    return pd.DataFrame(rows, columns=["text", "encoding", "confidence", "had_bom"])


def decoded(files: DataFrame) -> DataFrame:
    """(path, text, encoding, confidence, had_bom): a byte-order mark decides, then zero bytes on one side of pairs (UTF-16), valid UTF-8, and at last Cyrillic or Western single bytes. Null content has nulls."""
    return files.select("path", _decoded("content").alias("d")).select("path", "d.*")


def lines_of(texts: DataFrame) -> DataFrame:
    """(path, line_no, line) of each text."""
    return texts.select("path", F.posexplode(F.split("text", r"\r\n|\n|\r", -1)).alias("line_no", "line"))


class SharedParameters:
    """The tables of shared-parameter files: ``meta``, ``groups``, ``parameters`` and ``warnings``, each with path and line_no."""

    def __init__(self, texts: DataFrame):
        rows = lines_of(texts).withColumn("line", F.rtrim("line")).filter("line <> '' and not startswith(line, '#')")
        cells = F.split("line", "\t", -1)
        rows = rows.select("path", "line_no", F.upper(cells[0]).alias("tag"), F.slice(cells, F.lit(2), F.size(cells)).alias("cells"))
        rows = rows.withColumn("kind", F.ltrim(F.col("tag"), F.lit("*")))
        before = Window.partitionBy("path", "kind").orderBy("line_no").rowsBetween(Window.unboundedPreceding, -1)  # one file's records
        header = F.last(F.when(F.col("tag").startswith("*"), F.transform("cells", lambda c: F.upper(c))), ignorenulls=True).over(before)
        rows = rows.withColumn("header", header).filter("not startswith(tag, '*')")
        padded = F.transform("header", lambda c, i: F.struct(c.alias("key"), F.coalesce(F.get("cells", i), F.lit("")).alias("value")))
        fields = F.coalesce(F.map_from_entries(padded), F.create_map().cast("map<string,string>"))
        rows = rows.withColumn("fields", fields)
        field = lambda name: F.try_element_at("fields", F.lit(name))
        own = lambda kind: rows.filter(F.col("kind") == kind)
        self.meta = own("META").select("path", "line_no", F.coalesce(leading_integer(field("VERSION")), F.lit(2)).alias("version"), F.coalesce(leading_integer(field("MINVERSION")), F.lit(1)).alias("minimum_version"))
        groups = own("GROUP").select("path", "line_no", leading_integer(field("ID")).alias("group_id"), trim_all(field("NAME")).alias("name"))
        parameters = own("PARAM").select(
            "path", "line_no", F.lower(trim_all(field("GUID"))).alias("guid"), trim_all(field("NAME")).alias("name"), F.coalesce(trim_all(field("DATATYPE")), F.lit("")).alias("data_type"), F.nullif(trim_all(field("DATACATEGORY")), F.lit("")).alias("data_category"),
            leading_integer(field("GROUP")).alias("group_id"), F.coalesce(field("VISIBLE") != "0", F.lit(True)).alias("visible"), F.nullif(trim_all(field("DESCRIPTION")), F.lit("")).alias("description"), F.coalesce(field("USERMODIFIABLE") != "0", F.lit(True)).alias("user_modifiable"),
        )
        fine_group = F.col("group_id").isNotNull() & (F.coalesce("name", F.lit("")) != "")
        fine = fine_group & (F.coalesce("guid", F.lit("")) != "")
        self.groups, self.parameters = groups.filter(fine_group), parameters.filter(fine)
        self.warnings = (
            groups.filter(~fine_group).select("path", "line_no", F.lit("malformed GROUP").alias("warning"))
            .unionByName(parameters.filter(~fine).select("path", "line_no", F.lit("malformed PARAM").alias("warning")))
            .unionByName(rows.filter("kind not in ('META', 'GROUP', 'PARAM')").select("path", "line_no", F.concat(F.lit("unknown record type "), "kind").alias("warning")))
        )

    def issues(self) -> DataFrame:
        """(path, severity, code, guid, group_id) of what is wrong with each file."""
        # Fixed value: what a GUID looks like.
        guid = r"^[0-9a-f]{8}-[0-9a-f]{4}-[1-5][0-9a-f]{3}-[89ab][0-9a-f]{3}-[0-9a-f]{12}$"
        g, p = self.groups, self.parameters
        none_g, none_i = F.lit(None).cast("string").alias("guid"), F.lit(None).cast("long").alias("group_id")

        def issue(rows: DataFrame, severity: str, code: str, guid_: Column, group: Column) -> DataFrame:
            return rows.select("path", F.lit(severity).alias("severity"), F.lit(code).alias("code"), guid_, group)

        def repeats(rows: DataFrame, *by: str) -> DataFrame:
            first = rows.groupBy("path", *by).agg(F.min("line_no").alias("first_"))
            return rows.join(first, ["path", *by]).filter("line_no > first_")

        # the last META of a file counts
        meta = self.meta.groupBy("path").agg(F.max(F.struct("line_no", "version", "minimum_version")).alias("m")).select("path", "m.version", "m.minimum_version")
        named = p.withColumn("plain", F.lower("name"))
        earlier = F.lag("guid").over(Window.partitionBy("path", "plain").orderBy("line_no"))  # one name in one file
        parts = [
            issue(meta.filter("version < 1 or minimum_version < 1 or minimum_version > version"), "error", "invalid-meta", none_g, none_i),
            issue(repeats(g, "group_id"), "error", "duplicate-group", none_g, F.col("group_id")),
            issue(p.filter(~F.col("guid").rlike(guid)), "error", "invalid-guid", F.col("guid"), none_i),
            issue(repeats(p, "guid"), "error", "duplicate-guid", F.col("guid"), none_i),
            issue(named.withColumn("earlier", earlier).filter("earlier <> guid"), "warning", "duplicate-name", F.col("guid"), none_i),
            issue(p.join(g, ["path", "group_id"], "left_anti"), "error", "missing-group", F.col("guid"), F.col("group_id")),
            issue(g.dropDuplicates(["path", "group_id"]).join(p, ["path", "group_id"], "left_anti"), "warning", "unused-group", none_g, F.col("group_id")),
        ]
        out = parts[0]
        for part in parts[1:]:
            out = out.unionByName(part)
        return out

    def compared(self, left: str, right: str) -> DataFrame:
        """(guid, change) between two files of the set: a parameter may have several changes."""
        from girder.operators.quality import document_diff

        group = self.groups.groupBy("path", "group_id").agg(F.min_by("name", "line_no").alias("group_name"))
        one = self.parameters.groupBy("path", "guid").agg(F.min_by(F.struct("name", "data_type", "group_id"), "line_no").alias("p")).select("path", "guid", "p.*").join(group, ["path", "group_id"], "left")
        a, b = (one.filter(F.col("path").endswith(x)) for x in (left, right))
        return document_diff(a, b, "guid", {"renamed": "name", "moved": "group_name"}, kind="data_type").withColumnRenamed("k", "guid")

    def merged(self, order: Column) -> DataFrame:
        """One row for each guid: of the first file by ``order`` (an expression over path), then the first line; ``conflict`` if files differ in name or type."""
        rows = self.parameters.withColumn("order_", order)
        first = F.min(F.struct("order_", "line_no", *[c for c in self.parameters.columns if c not in ("line_no", "guid")])).alias("r")
        differ = (F.min("name") != F.max("name")) | (F.min("data_type") != F.max("data_type"))
        return rows.groupBy("guid").agg(first, differ.alias("conflict")).select("guid", "r.*", "conflict").drop("order_", "line_no")


#: A CSV record (line feeds may stand in quotes) and a field of it, after its comma. Possessive, so Java's engine loops over cells of any length and doesn't recurse.
RECORD, FIELD = r'(?:"[^"]*+"|[^"\r\n]++)++', r',((?:"[^"]*+"|[^,"]++|")*+)'


def csv_cells(record: Column) -> Column:
    bare = lambda x: F.when(x.startswith('"'), F.replace(F.regexp_replace(x, '^"|"$', ""), F.lit('""'), F.lit('"'))).otherwise(x)
    return F.transform(F.regexp_extract_all(F.concat(F.lit(","), record), F.lit(FIELD), F.lit(1)), bare)


def type_catalog(texts: DataFrame) -> DataFrame:
    """(path, row_no, type_name, column, data_type, unit, value) of each cell; the header names columns as name##type##unit."""
    records = texts.select("path", F.posexplode(F.regexp_extract_all("text", F.lit(RECORD), F.lit(0))).alias("row_no", "record")).filter("record rlike '[^,]'")
    cells = records.select("path", "row_no", csv_cells(F.col("record")).alias("cells"))
    first = cells.groupBy("path").agg(F.min_by("cells", "row_no").alias("header"), F.min("row_no").alias("header_no"))
    body = cells.join(first, "path").filter("row_no > header_no")
    one = body.select("path", "row_no", F.trim(F.col("cells")[0]).alias("type_name"), "cells", F.posexplode("header").alias("k", "name")).filter("k > 0 and trim(name) <> ''")
    part = F.split("name", "##", -1)
    return one.select("path", "row_no", "type_name", part[0].alias("column"), F.coalesce(F.get(part, F.lit(1)), F.lit("")).alias("data_type"), F.coalesce(F.get(part, F.lit(2)), F.lit("")).alias("unit"), F.coalesce(F.get("cells", F.col("k")), F.lit("")).alias("value"))


def taxonomy(texts: DataFrame) -> DataFrame:
    """(number, title, level, category_id) of tab-separated taxonomies; category_id may be missing."""
    cells = F.split("line", "\t", -1)
    rows = lines_of(texts).select(trim_all(cells[0]).alias("number"), trim_all(F.get(cells, F.lit(1))).alias("title"), leading_integer(F.get(cells, F.lit(2))).alias("level"), leading_integer(F.get(cells, F.lit(3))).alias("category_id"))
    return rows.filter("number <> '' and title <> '' and level is not null")


def merged_taxonomies(*editions: DataFrame) -> DataFrame:
    """Distinct rows of all editions, null category ids alike."""
    out = editions[0]
    for e in editions[1:]:
        out = out.unionByName(e)
    return out.dropDuplicates(["number", "title", "level", "category_id"])


_ATOM = Y.StructType([*(Y.StructField(n, Y.StringType()) for n in ("title", "id", "updated")), Y.StructField("categories", Y.ArrayType(Y.StringType())), Y.StructField("error", Y.StringType())])


def _local(tag: str) -> str:
    """An XML name without its namespace."""
    return tag.rsplit("}", 1)[-1]


def _atom(text: str | None) -> tuple:
    """(title, id, updated, categories, error) of one Atom text."""
    if text is None or not text.strip():
        return None, None, None, None, "empty"
    try:
        root = ElementTree.fromstring(text.encode())
    except ElementTree.ParseError as e:
        return None, None, None, None, f"malformed: {e}"
    found: dict[str, str] = {}
    for child in root:
        if _local(child.tag) in ("title", "id", "updated") and child.text:
            found.setdefault(_local(child.tag), child.text)
    terms = [t.text or "" for c in root.iter() if _local(c.tag) == "category" for t in c if _local(t.tag) == "term"]
    return found.get("title"), found.get("id"), found.get("updated"), terms, None


@F.pandas_udf(_ATOM)
def _atom_rows(text: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([_atom(t) for t in text], columns=["title", "id", "updated", "categories", "error"])


def atom_entries(texts: DataFrame) -> DataFrame:
    """(path, title, id, updated, categories, error) of Atom entries, whatever their namespace prefixes; a text that is empty or no well-formed XML has nulls and an error that names the cause and its place."""
    return texts.select("path", _atom_rows("text").alias("a")).select("path", "a.*")


def step_entities(texts: DataFrame) -> DataFrame:
    """(path, entity_id, type, arguments) of a STEP file's instances; semicolons in quotes don't end one."""
    statements = texts.select("path", F.explode(F.regexp_extract_all("text", F.lit(r"#\d++\s*+=\s*+[A-Za-z0-9_]++\s*+\((?:'[^']*+'|[^';]++)*+;"), F.lit(0))).alias("s"))
    part = lambda k: F.regexp_extract("s", r"(?s)^#(\d+)\s*=\s*(\w+)\s*\((.*)\)\s*;$", k)
    return statements.filter(F.col("s").rlike(r"\)\s*;$")).select("path", part(1).cast("long").alias("entity_id"), F.upper(part(2)).alias("type"), part(3).alias("arguments"))


def step_references(entities: DataFrame) -> DataFrame:
    """(path, entity_id, place, target) of the references in arguments, outside quotes."""
    bare = F.regexp_replace("arguments", "'[^']*+'", "")
    return entities.select("path", "entity_id", F.posexplode(F.regexp_extract_all(bare, F.lit(r"#(\d+)"), F.lit(1))).alias("place", "t")).select("path", "entity_id", "place", F.col("t").cast("long").alias("target"))


def file_properties(texts: DataFrame) -> DataFrame:
    """(path, key, value) of ``Key: value`` lines, and the release (a year from 2000 on) as key ``release``."""
    pairs = lines_of(texts).select("path", trim_all(F.regexp_extract("line", r"^([^:]{1,80}):\s*(.*)$", 1)).alias("key"), trim_all(F.regexp_extract("line", r"^([^:]{1,80}):\s*(.*)$", 2)).alias("value")).filter("key <> ''")
    release = texts.select("path", F.lit("release").alias("key"), F.regexp_extract("text", r"(?i)(?:format|build|revit)\D{0,40}(20\d\d)", 1).alias("value")).filter("value <> ''")
    return pairs.unionByName(release)


def step_decoded(text: Column) -> Column:
    """The text that a STEP string's escapes stand for: \\X2\\ and \\X4\\ runs of hexadecimal numbers, \\X\\ and \\S\\ for one character, doubled backslashes."""
    tokens = F.regexp_extract_all(text, F.lit(r"\\X[24]\\[0-9A-Fa-f]*+\\X0\\|\\X\\[0-9A-Fa-f]{2}|\\S\\[ -~]|\\\\|[^\\]++|\\"), F.lit(0))
    digits = lambda p: F.unhex(F.substring(p, F.lit(5), F.length(p) - 8))

    def meant(p: Column) -> Column:
        latin = F.when(p.startswith("\\X\\"), F.unhex(F.substring(p, 4, 2))).when(p.startswith("\\S\\") & (F.length(p) == 4), F.unhex(F.hex(F.ascii(F.substring(p, 4, 1)) + 128)))
        escaped = F.when(p.rlike(r"^\\X2."), F.decode(digits(p), "UTF-16BE")).when(p.rlike(r"^\\X4."), F.decode(digits(p), "UTF-32")).when(p == "\\\\", "\\")
        return F.coalesce(escaped, F.decode(latin, "ISO-8859-1"), p)

    return F.array_join(F.transform(tokens, meant), "")


def products(entities: DataFrame, types: list[str]) -> DataFrame:
    """(path, entity_id, type, guid, name) of the products of the types asked for; guid and name are the first and the third of their arguments, null where they are no text."""
    value = r"\s*+((?:'[^']*+')++|[^,']*+)"
    part = lambda k: F.regexp_extract("arguments", f"^{value},{value},{value}", k)
    wanted = entities.filter(F.col("type").isin(*[t.upper() for t in types])).withColumns({"a_": part(1), "b_": part(3)})
    bare = lambda c: F.when(F.col(c).startswith("'"), step_decoded(F.replace(F.substring(F.col(c), F.lit(2), F.length(c) - 2), F.lit("''"), F.lit("'"))))
    return wanted.select("path", "entity_id", "type", bare("a_").alias("guid"), bare("b_").alias("name"))


def transmission(texts: DataFrame) -> DataFrame:
    """(path, name, kind, loaded, missing) of the external references of transmission XML: names without folders, absolute places are not told."""
    reference = F.explode(F.regexp_extract_all("text", F.lit(r"(?s)<ExternalFileReference\b.*?</ExternalFileReference>"), F.lit(0))).alias("r")
    field = lambda name: F.nullif(F.regexp_extract("r", f"(?s)<{name}[^>]*>([^<]*)</{name}>", 1), F.lit(""))
    state = field("LastSavedLoadedStatus")
    rows = texts.select("path", reference)
    return rows.select("path", F.regexp_extract(field("LastSavedPath"), r"([^/\\]*)$", 1).alias("name"), field("ExternalFileReferenceType").alias("kind"), (state == "Loaded").alias("loaded"), F.coalesce(state == "NotFound", F.lit(False)).alias("missing"))


SIDECAR = "version int, fingerprint string, kind string, items array<struct<id: string, updatedAt: string, text: string>>"


def sidecar_items(texts: DataFrame, fingerprint: str | None = None) -> tuple[DataFrame, DataFrame]:
    """((path, kind, id, updated_at, text) of review sidecars, (path, error) of texts that are none or belong to a model of another fingerprint)."""
    read = texts.select("path", F.from_json("text", SIDECAR).alias("s"))
    wrong = F.when(F.col("s.version").isNull() | F.col("s.kind").isNull(), "no sidecar").when(F.lit(fingerprint is not None) & ~F.col("s.fingerprint").eqNullSafe(F.lit(fingerprint)), "another model")
    good = read.filter(wrong.isNull()).select("path", "s.kind", F.explode("s.items").alias("i"))
    return good.select("path", "kind", "i.id", F.col("i.updatedAt").alias("updated_at"), "i.text"), read.filter(wrong.isNotNull()).select("path", wrong.alias("error"))
