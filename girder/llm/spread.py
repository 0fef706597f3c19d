"""Joins that move little and split hot keys: fixed-size bit tables before a shuffle, salted equi-joins."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bits of a table of hashes: 2^BITS / 64 rows of two longs at most (4 MB), however many hashes there are.
BITS = 24
#: A key is hot from this share of all rows on, or from that of a mean shuffle partition if that is less.
HOT = 1 / 256
#: Parts into which a hot key's rows are dealt, or a sixteenth of the shuffle partitions if that is more.
SALTS = 16


def hot_share(spark: SparkSession, most: float) -> float:
    """The share of all rows from which on a key is hot: ``most``, less where a shuffle has more partitions; there are 1 / share hot keys at most."""
    return min(most, 1 / int(spark.conf.get("spark.sql.shuffle.partitions")))


def salts(spark: SparkSession) -> int:
    """Parts of a hot key, by the shuffle's partitions."""
    return max(SALTS, int(spark.conf.get("spark.sql.shuffle.partitions")) // 16)


def _at(column: Column) -> Column:
    return F.shiftrightunsigned(F.xxhash64(column), 64 - BITS)


def bit_table(keys: DataFrame, column: str) -> DataFrame:
    """(word_, bits_): a bit for the hash of each value; its size is bounded by BITS alone. Of k values it lets a share of 1 - exp(-k / 2^BITS) of other ones through, which the join that follows then tells apart."""
    return keys.select(_at(F.col(column)).alias("at_")).groupBy(F.shiftright("at_", 6).alias("word_")).agg(F.bit_or(F.expr("shiftleft(1L, CAST(at_ % 64 AS INT))")).alias("bits_"))


def sifted(rows: DataFrame, column: str, bits: DataFrame, within: bool = True) -> DataFrame:
    """Rows whose value may be in the bit table (``within``), or rows whose value surely isn't; no shuffle."""
    placed = rows.withColumn("at_", _at(F.col(column))).withColumn("word_", F.shiftright("at_", 6))
    joined = placed.join(F.broadcast(bits), "word_", "inner" if within else "left")  # 2^BITS / 64 rows at most
    hit = F.expr("shiftrightunsigned(bits_, CAST(at_ % 64 AS INT)) & 1 = 1")
    return joined.filter(hit if within else ~F.coalesce(hit, F.lit(False))).select(*rows.columns)


def without(rows: DataFrame, key: Column, gone: DataFrame, gone_key: str) -> DataFrame:
    """``rows`` but for those whose key is in ``gone``; rows that surely stay aren't moved."""
    packed = rows.select(F.struct(*rows.columns).alias("row"), key.alias("girder_key"))
    bits = bit_table(gone, gone_key)
    doubted = sifted(packed, "girder_key", bits).join(gone.select(F.col(gone_key).alias("girder_key")), "girder_key", "left_anti")
    return sifted(packed, "girder_key", bits, within=False).unionByName(doubted).select("row.*")


def heavy_keys(rows: DataFrame, by: Sequence[str], share: float = HOT) -> DataFrame:
    """The hot keys of ``rows``: those with more than ``hot_share`` of them."""
    counts = rows.groupBy(*by).agg(F.count("*").alias("heavy_c_"))
    return counts.filter(F.col("heavy_c_") > max(1000, int(rows.count() * hot_share(rows.sparkSession, share)))).select(*by)


def salted_join(many: DataFrame, few: DataFrame, by: Sequence[str], heavy: DataFrame, deal: Sequence[str], how: str = "inner", parts: int | None = None) -> DataFrame:
    """``many`` joined with ``few`` on ``by`` (inner or left): the rows of ``heavy`` keys (a bounded number, each once; of ``by`` or some of it) are dealt to ``parts`` (else ``salts``) parts by the columns ``deal``, and their partners stand in each part."""
    parts = parts or salts(many.sparkSession)
    hot = F.broadcast(heavy.withColumn("hot_", F.lit(True)))  # at most 1 / hot_share keys
    a = many.join(hot, heavy.columns, "left").withColumn("salt_", F.when(F.col("hot_"), F.pmod(F.xxhash64(*deal), F.lit(parts)).cast("int")).otherwise(0)).drop("hot_")
    every = F.when(F.col("hot_"), F.sequence(F.lit(0), F.lit(parts - 1))).otherwise(F.array(F.lit(0)))
    b = few.join(hot, heavy.columns, "left").withColumn("salt_", F.explode(every)).drop("hot_")
    return a.join(b, [*by, "salt_"], how).drop("salt_")


#: A key is held as hot where it has more than 1 / LARGE of all rows, so there are fewer than LARGE such keys.
LARGE = 4096


def large_keys(counts: DataFrame, by: Sequence[str], count: str) -> DataFrame:
    """The keys of ``counts`` (one row for each key and its ``count``) that hold more than 1 / LARGE of all rows: fewer than LARGE."""
    total = counts.agg(F.sum(count)).first()[0] or 0
    return counts.filter(F.col(count) * LARGE > total).select(*by)


def joined(many: DataFrame, few: DataFrame, by: Sequence[str], large: DataFrame) -> DataFrame:
    """``many`` joined with ``few``, which has one row for each key: large keys meet their row by a broadcast (fewer than LARGE rows), so none of their rows are moved; the others, each a small share, by a shuffle."""
    by = list(by)
    large = large.select(*by)
    held = many.join(F.broadcast(few.join(F.broadcast(large), by, "left_semi")), by)
    return held.unionByName(many.join(F.broadcast(large), by, "left_anti").join(few, by))
