"""Queries of exchange files, identifiers, libraries and recent files; each with the SQL it must agree with."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from girder.functions import identifiers as I
from girder.operators.postings import Postings, values_of
from girder.plans.catalogue import query, table
from girder.plans.source_catalogue import place
from girder.sources import step as Z
from girder.sources import text as T
from girder.sources.library import read_library
from girder.sources.shared import written
from girder.streaming import recents as S


@query("""
SELECT CAST(p_partkey AS BIGINT) AS element, md5(CAST(p_partkey AS VARCHAR)) AS digits, m[1:8] || '-' || m[9:12] || '-' || m[13:16] || '-' || m[17:20] || '-' || m[21:32] AS guid,
  lower(m[1:8] || '-' || m[9:12] || '-' || m[13:16] || '-' || m[17:20] || '-' || m[21:32] || '-' || printf('%08x', p_partkey)) AS unique_id,
  m[1:8] || '-' || m[9:12] || '-' || m[13:16] || '-' || m[17:20] || '-' || m[21:24] || printf('%08x', xor(CAST('0x' || m[25:32] AS BIGINT), p_partkey)) AS exchange_guid,
  array_to_string(list_transform(range(22), lambda k: substr('0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz_$',
    CAST(CASE WHEN k < 2 THEN (CAST('0x' || m[1:2] AS BIGINT) >> (6 - 6 * k)) & 63 ELSE (CAST('0x' || m[3 + 6 * ((k - 2) // 4):8 + 6 * ((k - 2) // 4)] AS BIGINT) >> (18 - 6 * ((k - 2) % 4))) & 63 END AS BIGINT) + 1, 1)), '') AS compact
FROM (SELECT p_partkey, substr(h, 7, 2) || substr(h, 5, 2) || substr(h, 3, 2) || substr(h, 1, 2) || substr(h, 11, 2) || substr(h, 9, 2) || substr(h, 15, 2) || substr(h, 13, 2) || substr(h, 17, 16) AS m FROM (SELECT p_partkey, md5(CAST(p_partkey AS VARCHAR)) AS h FROM part))
""")
def identifiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of 16 bytes as texts, element ids, exchange identifiers and their compact form, read back from each form."""
    digits = F.md5(F.col("p_partkey").cast("string"))
    made = table(spark, sf_dir, "part").select(F.col("p_partkey").cast("long").alias("element"), I.guid_text(F.unhex(digits)).alias("guid"))
    made = made.withColumn("unique_id", I.unique_id(F.col("guid"), F.col("element")))
    guid, element = I.unique_id_parts(F.col("unique_id"))
    back = I.expanded(I.compact(guid))
    return made.select(element.alias("element"), F.lower(F.hex(I.guid_bytes(back))).alias("digits"), back.alias("guid"), "unique_id", I.exchange_guid(F.col("unique_id")).alias("exchange_guid"), I.compact(F.col("guid")).alias("compact"))


@query("""
SELECT CASE WHEN p_size > 25 THEN 'IFCWALL' ELSE 'IFCDOOR' END AS type, p.name, 'Level é ' || CAST(p_partkey % 25 AS VARCHAR) AS storey, CASE WHEN p_partkey % 4 <> 0 THEN 'Béton ' || CAST(p_partkey % 10 AS VARCHAR) END AS material, h.name AS host
FROM (SELECT *, p_name || ' – ''' || CAST(p_partkey AS VARCHAR) || '°' AS name FROM part) p LEFT JOIN (SELECT p_partkey AS k, p_name || ' – ''' || CAST(p_partkey AS VARCHAR) || '°' AS name FROM part) h ON p.p_partkey % 10 = 0 AND h.k = p.p_partkey + 1
""")
def ifc_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A whole file is written, and what it says of each product is read back along its references."""
    part = table(spark, sf_dir, "part")
    number = lambda c: F.when(F.col("p_size") % 3 != 0, c.cast("double"))
    box = [number(c).alias(a) for a, c in (("x0", F.col("p_size")), ("x1", F.col("p_size") + 1), ("y0", F.lit(0)), ("y1", F.lit(2)), ("z0", F.col("p_partkey") % 25 * 3), ("z1", F.col("p_partkey") % 25 * 3 + 2.5))]
    elements = part.select(
        F.col("p_partkey").alias("element"), F.when(F.col("p_size") > 25, "IfcWall").otherwise("IfcDoor").alias("ifc_class"), Z.derived_guid("element", F.col("p_partkey")).alias("guid"), F.concat("p_name", F.lit(" – '"), F.col("p_partkey").cast("string"), F.lit("°")).alias("name"),
        (F.col("p_partkey") % 25).alias("level"), F.when(F.col("p_partkey") % 4 != 0, F.col("p_partkey") % 10).alias("material"), F.when(F.col("p_partkey") % 10 == 0, F.col("p_partkey") + 1).alias("host"), *box,
    )
    titled = lambda key, word: elements.select(key).filter(F.col(key).isNotNull()).distinct().withColumn("name", F.concat(F.lit(word), F.col(key).cast("string")))
    path = place(spark, "ifc")
    Z.write_ifc(path, "modèle", titled("level", "Level é ").withColumn("elevation", F.col("level") * 3.0), titled("material", "Béton "), elements)
    # part files in order are the file; an instance is a line of ASCII, so lines are read apart and no file is held whole
    entities = written(T.step_entities(spark.read.text(path).select(F.lit("").alias("path"), F.col("value").alias("text"))).select(F.lit("").alias("path"), "entity_id", "type", "arguments"), "entities")
    named = T.products(entities, ["IfcWall", "IfcDoor", "IfcBuildingStorey"]).select("entity_id", "type", "name")
    materials = entities.filter("type = 'IFCMATERIAL'").select("entity_id", T.step_decoded(F.regexp_extract("arguments", "^'([^']*)'", 1)).alias("name"))
    refs = T.step_references(entities.filter("type like 'IFCREL%'")).join(entities.select("entity_id", "type"), "entity_id")
    last = refs.groupBy("entity_id").agg(F.max_by("target", "place").alias("owner"), F.max("place").alias("n"))

    def related(kind: str) -> DataFrame:
        return refs.filter(F.col("type") == kind).join(last, "entity_id").filter("place > 0 and place < n").select(F.col("target").alias("entity_id"), "owner")

    said = lambda rel, of, name: related(rel).join(of.select(F.col("entity_id").alias("owner"), F.col("name").alias(name)), "owner").select("entity_id", name)
    voids = related("IFCRELVOIDSELEMENT").select(F.col("entity_id").alias("host_id"), F.col("owner").alias("opening"))
    fills = related("IFCRELFILLSELEMENT").select(F.col("entity_id").alias("opening"), F.col("owner").alias("entity_id"))
    host = fills.join(voids, "opening").join(named.select(F.col("entity_id").alias("host_id"), F.col("name").alias("host")), "host_id").select("entity_id", "host")
    out = named.filter("type != 'IFCBUILDINGSTOREY'").join(said("IFCRELCONTAINEDINSPATIALSTRUCTURE", named, "storey"), "entity_id", "left").join(said("IFCRELASSOCIATESMATERIAL", materials, "material"), "entity_id", "left").join(host, "entity_id", "left")
    return out.select("type", "name", "storey", "material", "host")


RECENT = "user_id AS owner, event_type || '-' || CAST(event_id % 6 AS {text}) AS name, event_id % 3 AS size, event_id % 2 AS modified, event_id * 7919 % 1000003 AS opened_at"


@query(f"""
WITH e AS (SELECT {RECENT.format(text='VARCHAR')} FROM events WHERE user_id IS NOT NULL AND event_type IS NOT NULL),
l AS (SELECT owner, name, size, modified, max(opened_at) AS opened_at FROM e GROUP BY ALL),
n AS (SELECT *, row_number() OVER (PARTITION BY owner ORDER BY opened_at DESC, name, size) AS place, max(opened_at) OVER (PARTITION BY owner) AS newest FROM l)
SELECT owner, CAST(place AS INTEGER) AS place, name, size, modified, opened_at FROM n WHERE place <= 5 AND opened_at >= newest - 60000
""")
def recent_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events come in no order, in several batches, and the stream is stopped and started again in between."""
    events = table(spark, sf_dir, "events").filter("event_type is not null").selectExpr(*[x.strip() for x in RECENT.format(text="STRING").split(", ")], "false AS removed", "event_id")
    source, out, check = place(spark, "opened"), place(spark, "recents"), place(spark, "recents-state")
    for part in (0, 1):
        events.filter(F.pmod(F.xxhash64("event_id"), F.lit(2)) == part).repartition(2).write.mode("append").parquet(source)
        stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(source)
        S.keep_recents(stream, out, check, 5, 60000).awaitTermination()
    return S.current_recents(spark.read.parquet(out))


@query("""
SELECT CASE WHEN right(p_brand, 1) NOT IN ('4', '5') THEN p_brand END AS title, CASE WHEN right(p_brand, 1) NOT IN ('4', '5') THEN CAST(count(*) AS INTEGER) END AS n_categories, CASE right(p_brand, 1) WHEN '4' THEN 'empty' WHEN '5' THEN 'malformed' END AS problem FROM part GROUP BY p_brand
""")
def library_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One description for each brand; some are empty, some cut off."""
    term = F.concat(F.lit("<a:category><a:term>"), F.replace("p_name", F.lit("&"), F.lit("&amp;")), F.lit("</a:term></a:category>"))
    texts = table(spark, sf_dir, "part").groupBy("p_brand").agg(F.concat_ws("", F.sort_array(F.collect_list(term))).alias("terms"))
    whole = F.concat(F.lit('<a:entry xmlns:a="http://www.w3.org/2005/Atom"><a:title>'), F.col("p_brand"), F.lit("</a:title>"), F.col("terms"))
    last = F.substring("p_brand", -1, 1)
    path = place(spark, "library")
    texts.select(F.col("p_brand").alias("k"), F.when(last == "4", "").when(last == "5", whole).otherwise(F.concat(whole, F.lit("</a:entry>"))).alias("value")).write.partitionBy("k").text(path)
    return read_library(spark, path).select("title", F.when(F.col("error").isNull(), F.size("categories")).alias("n_categories"), F.split_part("error", F.lit(":"), F.lit(1)).alias("problem"))


@query("""
WITH t AS (SELECT l_orderkey, lower(p_name || ' ' || p_type) AS v FROM lineitem JOIN part ON p_partkey = l_partkey)
SELECT o_orderkey FROM orders WHERE contains(lower(o_orderpriority), '1-urg') OR o_orderkey IN (SELECT l_orderkey FROM t WHERE contains(v, '1-urg'))
UNION ALL (SELECT o_orderkey + 1000000000 FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM t WHERE contains(v, lower((SELECT min(p_name) FROM part)))) ORDER BY o_orderkey LIMIT 100)
""")
def nested_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as entries with nested types, searched for a text of the entry itself and for one of its types."""
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), F.concat_ws(" ", "p_name", "p_type").alias("type"), "p_name")
    nested = table(spark, sf_dir, "lineitem").join(part, "l_partkey").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.collect_list("type").alias("types"))  # one order's lines
    entries = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority").join(nested, "o_orderkey", "left")
    index = Postings(entries, "o_orderkey", values_of(F.array("o_orderpriority"), F.coalesce("types", F.array().cast("array<string>"))))
    name = part.agg(F.min("p_name")).first()[0]
    n = entries.count()
    return index.search("1-URG", ["o_orderkey"], n).select("o_orderkey").unionByName(index.search(name, ["o_orderkey"]).select((F.col("o_orderkey") + 1000000000).alias("o_orderkey")))
