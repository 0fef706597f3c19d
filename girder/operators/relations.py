"""Relations between elements, families, symbols and materials; what people exchange about them.

First-seen rules use an explicit ordinal and aggregate structs, so no key is
gathered; id sets are DataFrames of one column.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from girder.functions.formats import instant


def _ids(ids: DataFrame, name: str) -> DataFrame:
    return ids.select(F.col(ids.columns[0]).alias(name))


def comment_merge(current: DataFrame, imported: DataFrame, key: str, updated: str) -> DataFrame:
    """Current rows, of which an imported one with the same key takes the place if it is as new or newer, and the imported rows that are new; a null date is older than none. Keys are unique in each."""
    a = current.select(F.col(key).alias("ka_"), F.struct(*current.columns).alias("a_"))
    b = imported.select(F.col(key).alias("kb_"), F.struct(*current.columns).alias("b_"))
    newer = F.coalesce(F.col(f"b_.{updated}") >= F.col(f"a_.{updated}"), F.lit(False))
    row = F.when(F.col("ka_").isNull() | newer, F.col("b_")).otherwise(F.col("a_"))
    return a.join(b, F.col("ka_") == F.col("kb_"), "full_outer").select(row.alias("row_")).select("row_.*")


def dated_merge(current: DataFrame, imported: DataFrame, key: str, updated: str) -> DataFrame:
    """``comment_merge`` by the moments that the texts ``updated`` tell, in whatever offset they are written; texts that tell none are older than none. Texts stay as they are."""
    dated = lambda df: df.select(*current.columns, instant(F.col(updated)).alias("instant_"))
    return comment_merge(dated(current), dated(imported), key, "instant_").drop("instant_")


def markup_merge(current: DataFrame, imported: DataFrame, key: str) -> DataFrame:
    """Current rows and the imported ones whose key is new."""
    return current.unionByName(imported.select(*current.columns).join(current.select(key), key, "left_anti").select(*current.columns))


def deduplicated(rows: DataFrame, key: Column, ordinal: str) -> DataFrame:
    """The first row of each key by the ordinal; a null key is a key."""
    rest = [c for c in rows.columns if c != ordinal]
    packed = rows.select(key.alias("key_"), F.struct(ordinal, *rest).alias("row_"))
    return packed.groupBy("key_").agg(F.min("row_").alias("row_")).select("row_.*").select(*rows.columns)


def regrouped(rows: DataFrame, moves: DataFrame, groups: DataFrame, key: str, group: str) -> DataFrame:
    """Rows with the group that ``moves`` (key, group; one for each key) gives them, if that group is known."""
    known = moves.select(F.col(key), F.col(group).alias("to_")).join(_ids(groups, "to_").distinct(), "to_", "left_semi")
    return rows.join(known, key, "left").withColumn(group, F.coalesce("to_", group)).select(*rows.columns)


def family_symbols(candidates: DataFrame, families: DataFrame, symbols: DataFrame, symbol: str, family: str, order: Sequence[str]) -> DataFrame:
    """(symbol, family): of each referenced symbol the first candidate whose family is known."""
    good = candidates.join(_ids(families, family), family, "left_semi").join(_ids(symbols, symbol), symbol, "left_semi")
    return good.groupBy(symbol).agg(F.min(F.struct(*order, family)).alias("first_")).select(symbol, F.col(f"first_.{family}").alias(family))


def unique_symbol_targets(sets: DataFrame, families: DataFrame, symbols: DataFrame, symbol: str, ordinal: str, pairs: str) -> DataFrame:
    """(symbol, family_id, field_offset): of each referenced symbol the first reference set whose pairs name exactly one known family, with that family's first offset.

    ``pairs`` is an array of whole numbers, target and offset in turn; sets of
    odd length are invalid.
    """
    even = sets.filter(F.size(pairs) % 2 == 0).join(_ids(symbols, symbol), symbol, "left_semi")
    at = even.select(symbol, ordinal, pairs, F.explode(F.when(F.size(pairs) > 0, F.sequence(F.lit(1), F.size(pairs), F.lit(2)))).alias("i_"))
    named = at.select(symbol, ordinal, "i_", F.element_at(pairs, F.col("i_")).alias("family_id"), F.element_at(pairs, F.col("i_") + 1).alias("field_offset"))
    known = named.join(_ids(families, "family_id"), "family_id", "left_semi")
    one = known.groupBy(symbol, ordinal).agg(F.min("family_id").alias("family_id"), F.max("family_id").alias("high_"), F.min(F.struct("i_", "field_offset")).alias("at_"))
    good = one.filter("family_id = high_").select(symbol, F.struct(ordinal, "family_id", F.col("at_.field_offset").alias("field_offset")).alias("r_"))
    return good.groupBy(symbol).agg(F.min("r_").alias("r_")).select(symbol, "r_.family_id", "r_.field_offset")


def symbol_materials(placements: DataFrame, entries: DataFrame) -> DataFrame:
    """(element_id, symbol_id, material_id, geometry_tags): elements (element_id, symbol_id, geometry_id) with one symbol only (geometry where there is none; ids above 0), joined with the entries (symbol_id, geometry_tag, material_id) of its map; the tags of a material in order."""
    symbol = F.coalesce("symbol_id", "geometry_id")
    valid = placements.select("element_id", symbol.alias("symbol_id")).filter("element_id > 0 and symbol_id > 0")
    one = valid.groupBy("element_id").agg(F.min("symbol_id").alias("symbol_id"), F.max("symbol_id").alias("high_")).filter("symbol_id = high_").drop("high_")
    tags = entries.groupBy("symbol_id", "material_id").agg(F.array_sort(F.collect_list("geometry_tag")).alias("geometry_tags"))  # one symbol's parts
    return one.join(tags, "symbol_id").select("element_id", "symbol_id", "material_id", "geometry_tags")


def shared_geometry(placements: DataFrame, excluded: DataFrame, element: str, geometry: str) -> DataFrame:
    """(geometry): distinct geometries of placements whose element isn't excluded."""
    return placements.join(_ids(excluded, element), element, "left_anti").select(geometry).distinct()


def enriched(rows: DataFrame, identities: DataFrame, key: str, value: str) -> DataFrame:
    """Rows with the identity's value, null where it has none; of several identities of a key the smallest value."""
    return rows.join(identities.groupBy(key).agg(F.min(value).alias(value)), key, "left")


def family_names(placements: DataFrame, symbols: DataFrame, families: DataFrame, element: str, symbol: str, family: str, name: str) -> DataFrame:
    """(element, name) over symbol and family; null where a step is missing."""
    return placements.select(element, symbol).join(symbols.select(symbol, family).dropDuplicates([symbol]), symbol, "left").join(families.select(family, name).dropDuplicates([family]), family, "left").select(element, name)


def hosted_openings(relations: DataFrame, openings: DataFrame, hosts: DataFrame, opening: str, host: str) -> DataFrame:
    """(host, opening) of relations between an opening and a host of the categories asked for (ids of one column each)."""
    return relations.select(host, opening).join(_ids(openings, opening), opening, "left_semi").join(_ids(hosts, host), host, "left_semi").select(host, opening).distinct()


def schema_references(candidates: DataFrame, defined: DataFrame, name: str, word: str, tag: str, ordinal: str) -> DataFrame:
    """(name, tag_reference, ordinal) of names that aren't defined themselves but whose word (below 0x8000) is a defined tag; the first of each name."""
    plain = candidates.filter(F.col(word) < 0x8000).join(defined.select(name), name, "left_anti").join(_ids(defined.select(tag), word), word, "left_semi")
    return plain.groupBy(name).agg(F.min(F.struct(ordinal, word)).alias("f_")).select(name, F.col(f"f_.{word}").alias("tag_reference"), F.col(f"f_.{ordinal}").alias(ordinal))


def assemblies_with_runs(runs: DataFrame, run: str, assembly: str, *recovered: DataFrame) -> DataFrame:
    """(assembly): those of which some run is in one of the id sets."""
    ids = _ids(recovered[0], run)
    for more in recovered[1:]:
        ids = ids.unionByName(_ids(more, run))
    return runs.join(ids, run, "left_semi").select(assembly).distinct()


def multi_lookup(rows: DataFrame, key: str, names: DataFrame, value: str) -> DataFrame:
    """Rows with every name of their value, one row each; rows without a name keep null. ``names`` is (key, value), values may repeat."""
    return rows.join(names.select(key, value).distinct(), key, "left")


def first_by_pattern(rows: DataFrame, path: str, size: str, patterns: Mapping[str, str]) -> DataFrame:
    """(name, path): the first path in order, of a size above 0, that each pattern finds."""
    tests = [F.when(F.col(path).rlike(p), F.lit(n)) for n, p in patterns.items()]
    found = rows.filter(F.col(size) > 0).select(path, F.explode(F.filter(F.array(*tests), lambda x: x.isNotNull())).alias("name"))
    return found.groupBy("name").agg(F.min(path).alias(path))
