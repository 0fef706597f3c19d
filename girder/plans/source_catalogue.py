"""Queries of sources, sinks and streams: files are written to the shared folder from whole driver tables, read back, and compared with SQL over the tables."""

from __future__ import annotations

import struct
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from girder.functions import semantics as X
from girder.operators.spatial import spread
from girder.plans.catalogue import query, table
from girder.sources import binary as B
from girder.sources import sinks as K
from girder.sources import text as T
from girder.sources.shared import shared_dir
from girder.streaming import arrivals as A


def place(spark: SparkSession, name: str) -> str:
    """A new folder in the shared one."""
    return f"{shared_dir(spark)}/girder/{name}-{uuid.uuid4().hex}"


def as_files(rows: DataFrame, by: str, line: Column, order: str, head: str) -> str:
    """Write one text file for each value of ``by`` (few rows each), its lines in order behind the head; the folder."""
    spark = rows.sparkSession
    lines = F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), line.alias("line")))), lambda x: x["line"])
    texts = rows.groupBy(F.col(by).alias("k")).agg(F.concat(F.lit(head), F.array_join(lines, "\n")).alias("value"))
    path = place(spark, "files")
    texts.write.partitionBy("k").text(path)
    return path


def texts_at(spark: SparkSession, path: str) -> DataFrame:
    return T.decoded(T.read_files(spark, path))


GUID = "concat('00000000-0000-4000-8000-', lpad(CAST(p_partkey AS STRING), 12, '0'))"
PARAMETERS = "*META\tVERSION\tMINVERSION\nMETA\t2\t1\n*GROUP\tID\tNAME\nGROUP\t7\tSeven\n*PARAM\tGUID\tNAME\tDATATYPE\tDATACATEGORY\tGROUP\tVISIBLE\n"


def parameter_files(spark: SparkSession, sf_dir: str) -> str:
    part = table(spark, sf_dir, "part").withColumn("guid", F.upper(F.expr(GUID)))
    line = F.concat_ws("\t", F.lit("PARAM"), "guid", "p_name", F.lit("TEXT"), F.lit(""), F.lit("7"), F.when(F.col("p_size") > 25, "1").otherwise("0"))
    return as_files(part, "p_brand", line, "p_partkey", PARAMETERS)


@query("""
SELECT concat('00000000-0000-4000-8000-', lpad(CAST(p_partkey AS VARCHAR), 12, '0')) AS guid, p_name AS name, 'TEXT' AS data_type, CAST(7 AS BIGINT) AS group_id, p_size > 25 AS visible FROM part
""")
def shared_parameters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.SharedParameters(texts_at(spark, parameter_files(spark, sf_dir))).parameters.select("guid", "name", "data_type", "group_id", "visible")


@query("""
SELECT concat('00000000-0000-4000-8000-', lpad(CAST(p_partkey AS VARCHAR), 12, '0')) AS guid, p_name AS name FROM part
""")
def file_arrivals(spark: SparkSession, sf_dir: str) -> DataFrame:
    source, out, check = parameter_files(spark, sf_dir), place(spark, "arrived"), place(spark, "stream")
    A.merge_arrivals(A.arriving_files(spark, source), lambda files: T.SharedParameters(T.decoded(files)).parameters.select("guid", "name"), out, check).awaitTermination()
    return A.latest(spark.read.parquet(out).select("guid", "name", "batch"), "guid", ["batch"]).select("guid", "name")


@query("""
SELECT CAST(p_partkey AS VARCHAR) AS type_name, 'Size' AS column_name, 'LENGTH' AS data_type, 'MM' AS unit, CAST(p_size AS VARCHAR) AS value FROM part
UNION ALL SELECT CAST(p_partkey AS VARCHAR), 'Note', 'OTHER', '', p_name || ', "' || p_type || '"' FROM part
""")
def type_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    note = F.concat("p_name", F.lit(', "'), "p_type", F.lit('"'))
    line = F.concat_ws(",", F.col("p_partkey").cast("string"), F.col("p_size").cast("string"), X.csv_field(note))
    path = as_files(table(spark, sf_dir, "part"), "p_brand", line, "p_partkey", ",Size##LENGTH##MM,Note##OTHER##\n")
    return T.type_catalog(texts_at(spark, path)).select("type_name", F.col("column").alias("column_name"), "data_type", "unit", "value")


@query("""
SELECT CAST(p_partkey AS VARCHAR) AS number, p_name AS title, CAST(p_size AS BIGINT) AS level, CASE WHEN p_partkey % 3 = 0 THEN NULL ELSE CAST(-p_partkey AS BIGINT) END AS category_id FROM part
""")
def taxonomy(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = F.concat_ws("\t", F.col("p_partkey").cast("string"), "p_name", F.col("p_size").cast("string"), F.when(F.col("p_partkey") % 3 == 0, "").otherwise((-F.col("p_partkey")).cast("string")))
    rows = T.taxonomy(texts_at(spark, as_files(table(spark, sf_dir, "part"), "p_brand", line, "p_partkey", "no row\n")))
    return T.merged_taxonomies(rows, rows)


@query("""
SELECT CAST(p_partkey AS BIGINT) AS entity_id, CASE WHEN p_size > 25 THEN 'IFCWALL' ELSE 'IFCDOOR' END AS type, p_name || '''s' AS guid, p_type AS name FROM part
""")
def step_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part").withColumns({"entity": F.when(F.col("p_size") > 25, "IfcWall").otherwise("IfcDoor"), "guid": F.concat("p_name", F.lit("'s"))})
    path = place(spark, "step")
    K.write_lines(K.step_products(part, "p_partkey", "entity", "guid", "p_type"), path, ["p_partkey"])
    return T.products(T.step_entities(texts_at(spark, path)), ["IfcWall", "IfcDoor"]).select("entity_id", "type", "guid", "name")


@query("""
SELECT p_partkey, 'a, "' || p_name || '"' AS note, p_retailprice FROM part
""")
def csv_sink(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part").withColumn("note", F.concat(F.lit('a, "'), "p_name", F.lit('"')))
    path = place(spark, "csv")
    K.write_lines(K.delimited(part, ["p_partkey", "note", "p_retailprice"], ","), path, ["p_partkey"])
    return spark.read.option("escape", '"').schema("p_partkey long, note string, p_retailprice double").csv(path)


@query("""
SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN p_name END AS p_name, p_size FROM part
""")
def json_sink(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part").withColumn("p_name", F.when(F.col("p_partkey") % 2 == 0, F.col("p_name")))
    path = place(spark, "json")
    K.write_lines(K.json_lines(part, ["p_partkey", "p_name", "p_size"]), path, ["p_partkey"])
    return spark.read.schema(part.select("p_partkey", "p_name", "p_size").schema).json(path)


@query("""
SELECT p_partkey, '<line data-id="' || p_partkey || '" x1="' || p_size || '" y1="' || (-p_partkey % 100) || '" x2="' || (p_size + 1) || '" y2="' || (-(p_partkey % 7)) || '"/>' AS line FROM part
""")
def svg_sink(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part").select("p_partkey", F.col("p_size").cast("double").alias("x0"), (F.col("p_partkey") % 100).cast("double").alias("y0"), (F.col("p_size") + 1).cast("double").alias("x1"), (F.col("p_partkey") % 7).cast("double").alias("y1"))
    return K.svg_lines(part, "p_partkey").select("p_partkey", "line")


@query("""
SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN 'utf-16le' WHEN 1 THEN 'utf-16be' ELSE 'utf-8' END AS encoding, p_name || ' é' AS text FROM part
""")
def text_encodings(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.concat("p_name", F.lit(" é"))
    content = F.when(F.col("p_partkey") % 3 == 0, F.encode(text, "UTF-16LE")).when(F.col("p_partkey") % 3 == 1, F.encode(text, "UTF-16BE")).otherwise(F.encode(text, "UTF-8"))
    files = spread(table(spark, sf_dir, "part")).select(F.col("p_partkey").cast("string").alias("path"), content.alias("content"))
    return T.decoded(files).select(F.col("path").cast("long").alias("p_partkey"), "encoding", "text")


def little_endian(x: Column) -> Column:
    """Four bytes of a number, the lowest first, in hexadecimal."""
    whole = F.lpad(F.hex(F.pmod(x.cast("long"), F.lit(1 << 32))), 8, "0")
    return F.concat(*[F.substring(whole, k, 2) for k in (7, 5, 3, 1)])


@query("""
SELECT CAST(p_partkey AS BIGINT) AS p_partkey, CAST(7 + p_partkey % 5 AS BIGINT) AS record_offset, CAST(p_size AS BIGINT) AS discriminator, CAST(4294967296 - p_partkey - 1 AS BIGINT) AS category_low FROM part
""")
def category_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    hex_ = F.concat(F.repeat(F.lit("01"), (F.col("p_partkey") % 5 + 7).cast("int")), F.lit("0400"), little_endian(F.col("p_size")), little_endian(-F.col("p_partkey") - 1), F.repeat(F.lit("FF"), 8), F.lit("0400AA"))
    pages = spread(table(spark, sf_dir, "part")).select(F.col("p_partkey").cast("string").alias("path"), F.unhex(hex_).alias("content"))
    return B.scan_records(pages, B.CATEGORY_TOKEN).select(F.col("path").cast("long").alias("p_partkey"), F.col("offset").alias("record_offset"), "discriminator", "category_low")


@query("""
WITH t AS (SELECT p_partkey, CASE WHEN p_partkey % 11 <> 0 THEN p_size END AS a, CASE WHEN p_partkey % 13 <> 0 THEN p_partkey % 40 + 1 END AS b FROM part WHERE p_partkey > 0 AND (p_partkey % 7 <> 0 OR p_partkey % 2 = 0))
SELECT p_partkey, CAST(p_partkey % 3 AS BIGINT) AS record_offset, CASE WHEN p_partkey % 2 = 0 THEN 4294967295 ELSE 131072 END AS record_code, CAST(1 + p_partkey % 4 AS BIGINT) AS record_count, coalesce(a = b, false) AS duplicated, 0e0 AS x0, CAST(CASE WHEN a IS NULL OR b <= a THEN b ELSE a END AS DOUBLE) AS x1, 3e0 AS z1
FROM t WHERE a IS NOT NULL OR b IS NOT NULL
""")
def bounds_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of which some lack a sound copy, or have a reserved word that isn't 0."""
    key, zero = F.col("p_partkey"), F.lit("00000000")
    doubles = F.array(*[F.lit(struct.pack("<d", k).hex()) for k in range(64)])
    nan = F.lit(struct.pack("<d", float("nan")).hex())
    of = lambda n: F.element_at(doubles, n.cast("int") + 1)
    copy = lambda n, broken: F.concat(*[of(F.lit(0))] * 3, F.when(broken, nan).otherwise(of(n)), of(F.lit(2)), of(F.lit(3)))
    code = F.when(key % 2 == 0, "FFFFFFFF").otherwise("00000200")
    entries = F.concat(F.lit("03000000"), F.repeat(F.lit("00"), (2 + 6 * (key % 4)).cast("int")))
    row = F.concat(little_endian(key), zero, F.repeat(F.lit("AB"), 8), F.lit("C608"), code, F.when(key % 7 == 0, "FFFFFFFF").otherwise("00000000"), little_endian(key), zero, F.lit("04800800"), little_endian(1 + key % 4), entries)
    pages = spread(table(spark, sf_dir, "part")).select(key.cast("string").alias("path"), F.unhex(F.concat(F.repeat(F.lit("01"), (key % 3).cast("int")), row, copy(F.col("p_size"), key % 11 == 0), copy(key % 40 + 1, key % 13 == 0))).alias("content"))
    return B.duplicated_bounds(pages).select(F.col("path").cast("long").alias("p_partkey"), F.col("offset").alias("record_offset"), "record_code", "record_count", "duplicated", "x0", "x1", "z1")


@query("""
SELECT CAST(p_partkey AS BIGINT) AS p_partkey, CAST(p_size AS BIGINT) AS owner_id, CAST(p_partkey AS BIGINT) AS element_id FROM part
""")
def ownership_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    zero = F.lit("00000000")
    row = F.concat(little_endian(F.col("p_size")), zero, zero, little_endian(F.col("p_partkey")), zero, F.repeat(F.lit("01000000"), 3), little_endian(F.col("p_partkey")), zero)
    pages = spread(table(spark, sf_dir, "part")).select(F.col("p_partkey").cast("string").alias("path"), F.unhex(row).alias("content"))
    return B.scan_records(pages, B.OWNERSHIP_ROW).select(F.col("path").cast("long").alias("p_partkey"), "owner_id", "element_id")


@query("""
SELECT p_partkey, 'Size' AS key, CAST(p_size AS VARCHAR) AS value FROM part UNION ALL SELECT p_partkey, 'Name', p_name FROM part UNION ALL SELECT p_partkey, 'Format', '2027' FROM part UNION ALL SELECT p_partkey, 'release', '2027' FROM part
""")
def file_properties(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.concat(F.lit("Size: "), F.col("p_size").cast("string"), F.lit("\nName:\t"), "p_name", F.lit("\r\nFormat: 2027\nno key"))
    texts = spread(table(spark, sf_dir, "part")).select(F.col("p_partkey").cast("string").alias("path"), text.alias("text"))
    return T.file_properties(texts).select(F.col("path").cast("long").alias("p_partkey"), "key", "value")


@query("""
SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN true WHEN 1 THEN true ELSE false END AS paged, CAST(CASE WHEN p_partkey > 0 THEN (p_partkey * 1000 // 64896) * 65249 + p_partkey * 1000 % 64896 ELSE 0 END AS BIGINT) AS stored FROM part
""")
def page_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.when(F.col("p_partkey") % 3 == 0, F.lit("Root Entry/Partitions/7")).when(F.col("p_partkey") % 3 == 1, F.lit("global/elemtable")).otherwise(F.lit("Partitions/7/x"))
    return table(spark, sf_dir, "part").select("p_partkey", B.checksum_paged(path).alias("paged"), B.stored_offset(F.col("p_partkey") * 1000).alias("stored"))


@query("""
SELECT CAST(p_partkey AS BIGINT) AS p_partkey, CAST(64896 + p_partkey % 100 AS BIGINT) AS bytes FROM part
""")
def page_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    content = F.concat(F.repeat(F.lit("a"), B.PAYLOAD), F.repeat(F.lit("c"), B.CHECKSUM), F.repeat(F.lit("b"), (F.col("p_partkey") % 100).cast("int"))).cast("binary")
    pages = spread(table(spark, sf_dir, "part")).select(F.concat(F.lit("Partitions/"), F.col("p_partkey").cast("string")).alias("path"), content.alias("content"))
    out = B.payloads(pages)
    return out.select(F.regexp_extract("path", r"(\d+)$", 1).cast("long").alias("p_partkey"), F.length(F.replace(F.col("content").cast("string"), F.lit("c"), F.lit(""))).cast("long").alias("bytes"))


@query("""
SELECT CAST(p_partkey AS BIGINT) AS p_partkey, p_name || '.dwg' AS name FROM part UNION ALL SELECT CAST(p_partkey AS BIGINT), 'Shared.DWG' FROM part
""")
def drawing_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.concat(F.lit("\u0001"), "p_name", F.lit(".dwg\u0000/"), F.lit("Shared.DWG\u0000shared.dwg\u0000no drawing"))
    return B.drawing_names(spread(table(spark, sf_dir, "part")).select(F.col("p_partkey").cast("string").alias("path"), F.encode(text, "UTF-16LE").alias("content"))).select(F.col("path").cast("long").alias("p_partkey"), "name")
