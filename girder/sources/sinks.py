"""Text sinks: lines with an order, written as sorted part files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from girder.functions.semantics import csv_field


def write_lines(lines: DataFrame, path: str, order: list[str]) -> None:
    """Write column ``line`` in order: part files sort as the lines do, so their concatenation is the file."""
    lines.repartitionByRange(*order).sortWithinPartitions(*order).select("line").write.mode("overwrite").text(path)


def delimited(rows: DataFrame, columns: list[str], separator: str = "\t") -> DataFrame:
    """Rows with ``line``: the columns joined; commas need quoting, tabs and line feeds in a cell become spaces."""
    cell = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    cells = [csv_field(cell(c)) if separator == "," else F.regexp_replace(cell(c), r"[\t\r\n]+", " ") for c in columns]
    return rows.withColumn("line", F.concat_ws(separator, *cells))


def json_lines(rows: DataFrame, columns: list[str]) -> DataFrame:
    return rows.withColumn("line", F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}))


def step_text(text: Column) -> Column:
    """A STEP string: quotes doubled, characters beyond ASCII as \\X2\\ escapes."""
    chars = F.split(F.replace(text, F.lit("'"), F.lit("''")), "")
    escaped = F.transform(chars, lambda c: F.when(c.rlike(r"^[\x20-\x5b\x5d-\x7e]$") | (c == ""), c).otherwise(F.concat(F.lit("\\X2\\"), F.hex(F.encode(c, "UTF-16BE")), F.lit("\\X0\\"))))
    return F.concat(F.lit("'"), F.array_join(escaped, ""), F.lit("'"))


def step_products(elements: DataFrame, element: str, ifc_class: str, guid: str, name: str) -> DataFrame:
    """Rows with ``line``: a STEP instance for each element, numbered by the element's id."""
    return elements.withColumn("line", F.concat(F.lit("#"), F.col(element).cast("string"), F.lit("="), F.upper(ifc_class), F.lit("("), step_text(F.col(guid)), F.lit(",$,"), F.coalesce(step_text(F.col(name)), F.lit("$")), F.lit(",$,$,$,$,$);")))


def obj_lines(triangles: DataFrame, element: str, ordinal: str) -> DataFrame:
    """(element, ordinal, part, line): an OBJ text with three own vertices for each triangle (x0, y0, z0 ... z2), so faces need no running number."""
    vertex = lambda k: F.concat_ws(" ", F.lit("v"), *[F.col(f"{a}{k}").cast("string") for a in "xyz"])
    lines = F.array(vertex(0), vertex(1), vertex(2), F.lit("f -3 -2 -1"))
    return triangles.select(element, ordinal, F.posexplode(lines).alias("part", "line"))


def svg_lines(segments: DataFrame, element: str) -> DataFrame:
    """Rows with ``line``: an SVG line for each segment (x0, y0, x1, y1), y upwards."""
    number = lambda c: F.call_function("format_number", c, F.lit("0.###"))
    return segments.withColumn("line", F.concat(F.lit('<line data-id="'), F.col(element).cast("string"), F.lit('" x1="'), number(F.col("x0")), F.lit('" y1="'), number(F.lit(0.0) - F.col("y0")), F.lit('" x2="'), number(F.col("x1")), F.lit('" y2="'), number(F.lit(0.0) - F.col("y1")), F.lit('"/>')))
