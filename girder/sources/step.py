"""Whole IFC4 exchange files: products with placements, boxes, storeys, materials and openings.

Rows of tables become bundles of instances that refer to one another by number. A
bundle's first number is a running sum of bundle sizes over range partitions, so no task
sees the whole file, and rows meet the numbers they refer to by equi-joins.

Cases: an element without a box has no shape; one without a level, material or host has no
such relation, and neither has one whose level, material or host isn't there; a null name is
written as $; an empty model is a valid file without products.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from girder.functions.identifiers import compact, guid_of_hex
from girder.operators.keyed import meet
from girder.sources.shared import written
from girder.sources.sinks import step_text, write_lines

#: Rows of the file that one relation may list: those of one run of this many elements.
LISTED = 4096

#: Instances that every file begins with, and the numbers by which others refer to them.
_FIXED = (
    "IFCPERSON($,$,'girder',$,$,$,$,$)",
    "IFCORGANIZATION($,'girder',$,$,$)",
    "IFCPERSONANDORGANIZATION(#1,#2,$)",
    "IFCAPPLICATION(#2,'1','girder','girder')",
    "IFCOWNERHISTORY(#3,#4,$,.ADDED.,0,#3,#4,0)",
    "IFCSIUNIT(*,.LENGTHUNIT.,$,.METRE.)",
    "IFCUNITASSIGNMENT((#6))",
    "IFCCARTESIANPOINT((0.,0.,0.))",
    "IFCAXIS2PLACEMENT3D(#8,$,$)",
    "IFCGEOMETRICREPRESENTATIONCONTEXT($,'Model',3,1.E-5,#9,$)",
    "IFCGEOMETRICREPRESENTATIONSUBCONTEXT('Body','Model',*,*,*,*,#10,$,.MODEL_VIEW.,$)",
    "IFCDIRECTION((0.,0.,1.))",
    "IFCLOCALPLACEMENT($,#9)",
)
_OWNER, _AXIS, _BODY, _UP, _ORIGIN = 5, 9, 11, 12, 13


def numbered(rows: DataFrame, order: list[str], size: Column | int, start: int) -> tuple[DataFrame, int]:
    """(rows with ``number``, the next free number): each row takes ``size`` numbers, in order; ``index`` counts rows within partitions of the file."""
    kept = rows.withColumn("size_", (F.lit(size) if isinstance(size, int) else size).cast("long"))
    kept = written(kept.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("at_", F.monotonically_increasing_id()).withColumn("part_", F.spark_partition_id()), "numbered")
    sums = kept.groupBy("part_").agg(F.sum("size_").alias("s_"))  # one row for each partition
    before = F.sum("s_").over(Window.orderBy("part_")) - F.col("s_")
    inside = F.sum("size_").over(Window.partitionBy("part_").orderBy("at_")) - F.col("size_")
    out = kept.withColumn("inside_", inside).join(F.broadcast(sums.select("part_", before.alias("before_"))), "part_")
    total = sums.agg(F.sum("s_")).first()[0] or 0
    return out.select(*rows.columns, (F.col("inside_") + F.col("before_") + start).alias("number"), F.col("at_").alias("index")), start + total


def real(x: Column) -> Column:
    return x.cast("double").cast("string")


def ref(number: Column | int) -> Column:
    return F.concat(F.lit("#"), (F.lit(number) if isinstance(number, int) else number).cast("string"))


def derived_guid(kind: str, *keys: Column) -> Column:
    """A compact identifier that the same kind and keys always give."""
    return compact(guid_of_hex(F.md5(F.concat_ws(":", F.lit(kind), *[k.cast("string") for k in keys]))))


def _quoted(text: Column) -> Column:
    return F.coalesce(step_text(text), F.lit("$"))


def _bundle(*texts: Column) -> Column:
    """(offset, text) of a bundle's instances."""
    return F.array(*[F.struct(F.lit(k).alias("k"), t.alias("text")) for k, t in enumerate(texts)])


def _instances(rows: DataFrame, bundle: Column) -> DataFrame:
    return rows.select("number", F.explode(bundle).alias("b")).select((F.col("number") + F.col("b.k")).alias("number"), F.concat(ref(F.col("number") + F.col("b.k")), F.lit("="), F.col("b.text"), F.lit(";")).alias("line"))


def _call(name: str, *arguments: Column | str) -> Column:
    return F.concat(F.lit(f"{name}("), F.concat_ws(",", *[F.lit(a) if isinstance(a, str) else a for a in arguments]), F.lit(")"))


def ifc_lines(name: str, levels: DataFrame, materials: DataFrame, elements: DataFrame) -> DataFrame:
    """(number, line) of an IFC4 file.

    ``levels``: level, name, elevation; ``materials``: material, name; ``elements``: element,
    ifc_class, guid (compact), name, level, material, host (an element whose opening this
    one fills), x0, x1, y0, y1, z0, z1 (a box in metres, or nulls); ids are unique.
    """
    spark = elements.sparkSession
    q = "'" + name.replace("'", "''") + "'"
    n = len(_FIXED)
    guid = lambda kind: derived_guid(kind, F.lit(name))
    one = spark.range(1).select(F.lit(n + 1).cast("long").alias("number"))
    aggregates = lambda kind, whole, part: _call("IFCRELAGGREGATES", step_text(guid(kind)), f"#{_OWNER}", "$", "$", f"#{whole}", f"(#{part})")
    project, site, building = n + 1, n + 2, n + 3
    head = _bundle(
        _call("IFCPROJECT", step_text(guid("project")), f"#{_OWNER}", q, "$,$,$,$", "(#10)", "#7"),
        _call("IFCSITE", step_text(guid("site")), f"#{_OWNER}", "'Site',$,$", f"#{_ORIGIN}", "$,$,.ELEMENT.,$,$,$,$,$"),
        _call("IFCBUILDING", step_text(guid("building")), f"#{_OWNER}", "'Building',$,$", f"#{_ORIGIN}", "$,$,.ELEMENT.,$,$,$"),
        aggregates("sites", project, site),
        aggregates("buildings", site, building),
    )
    fixed = spark.createDataFrame([(k + 1, f"#{k + 1}={text};") for k, text in enumerate(_FIXED)], "number long, line string")
    start = n + 6

    placed, start = numbered(levels, ["elevation", "level"], 4, start)
    at = lambda k: ref(F.col("number") + k)
    storeys = _instances(placed, _bundle(
        _call("IFCCARTESIANPOINT", F.concat(F.lit("(0.,0.,"), real(F.col("elevation")), F.lit(")"))),
        _call("IFCAXIS2PLACEMENT3D", at(0), "$,$"),
        _call("IFCLOCALPLACEMENT", f"#{_ORIGIN}", at(1)),
        _call("IFCBUILDINGSTOREY", step_text(derived_guid("storey", F.lit(name), F.col("level"))), f"#{_OWNER}", _quoted(F.col("name")), "$,$", at(2), "$,$,.ELEMENT.", real(F.col("elevation"))),
    ))
    storey_at = placed.select("level", (F.col("number") + 3).alias("storey"))
    known, start = numbered(materials, ["material"], 1, start)
    lines = _instances(known, _bundle(_call("IFCMATERIAL", _quoted(F.col("name")), "$,$")))
    material_at = known.select("material", F.col("number").alias("material_at"))

    has_box = F.lit(True)
    for a in "xyz":
        has_box = has_box & F.coalesce(F.col(f"{a}0") <= F.col(f"{a}1"), F.lit(False))
    things, start = numbered(elements.withColumn("box", has_box), ["element"], F.when(F.col("box"), 10).otherwise(4), start)
    things = written(things, "ifc-elements")
    product = F.col("number") + F.when(F.col("box"), 9).otherwise(3)
    corner = F.when(F.col("box"), F.concat_ws(",", *[real(F.col(f"{a}0")) for a in "xyz"])).otherwise(F.lit("0.,0.,0."))
    place = [_call("IFCCARTESIANPOINT", F.concat(F.lit("("), corner, F.lit(")"))), _call("IFCAXIS2PLACEMENT3D", at(0), "$,$"), _call("IFCLOCALPLACEMENT", f"#{_ORIGIN}", at(1))]
    side = lambda a: F.col(f"{a}1") - F.col(f"{a}0")
    shape = [
        _call("IFCCARTESIANPOINT", F.concat(F.lit("("), real(side("x") / 2), F.lit(","), real(side("y") / 2), F.lit(")"))),
        _call("IFCAXIS2PLACEMENT2D", at(3), "$"),
        _call("IFCRECTANGLEPROFILEDEF", ".AREA.,$", at(4), real(side("x")), real(side("y"))),
        _call("IFCEXTRUDEDAREASOLID", at(5), f"#{_AXIS}", f"#{_UP}", real(side("z"))),
        _call("IFCSHAPEREPRESENTATION", f"#{_BODY}", "'Body','SweptSolid'", F.concat(F.lit("("), at(6), F.lit(")"))),
        _call("IFCPRODUCTDEFINITIONSHAPE", "$,$", F.concat(F.lit("("), at(7), F.lit(")"))),
    ]
    own = lambda body: F.concat(F.upper("ifc_class"), F.lit("("), F.concat_ws(",", step_text(F.col("guid")), F.lit(f"#{_OWNER}"), _quoted(F.col("name")), F.lit("$,$"), at(2), body, F.lit("$,$")), F.lit(")"))
    bodies = _instances(things.filter("box"), _bundle(*place, *shape, own(at(8)))).unionByName(_instances(things.filter("not box"), _bundle(*place, own(F.lit("$")))))
    targets = things.select("element", product.alias("product"), (F.col("number") + 2).alias("placement"), "level", "material", "host", F.floor(F.col("index") / LISTED).alias("block"), F.shiftright("index", 33).alias("part"))

    def listed(key: str, owners: DataFrame, owner: str, kind: str, call: str) -> DataFrame:
        """A relation for each owner and run of LISTED elements."""
        counts = targets.filter(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("c_"))
        met = meet(targets.select(key, "product", "block", "part"), counts.join(owners, key), [key], "c_")
        return met.groupBy(owner, "part", "block").agg(F.array_join(F.transform(F.sort_array(F.collect_list("product")), ref), ",").alias("all")).select(
            F.concat(F.lit(f"{call}("), step_text(derived_guid(kind, F.lit(name), F.col(owner), F.col("part"), F.col("block"))), F.lit(f",#{_OWNER},$,$,("), F.col("all"), F.lit("),"), ref(F.col(owner)), F.lit(")")).alias("text"), F.lit(kind).alias("kind"), F.concat_ws(":", owner, "part", "block").alias("key")
        )

    storeys_of = placed.agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.col("number") + 3)), ref), ",").alias("all"))  # the file's levels
    whole = storeys_of.filter("all != ''").select(F.concat(F.lit("IFCRELAGGREGATES("), step_text(guid("storeys")), F.lit(f",#{_OWNER},$,$,#{building},("), F.col("all"), F.lit("))")).alias("text"), F.lit("aggregate").alias("kind"), F.lit("").alias("key"))
    relations = whole.unionByName(listed("level", storey_at, "storey", "contained", "IFCRELCONTAINEDINSPATIALSTRUCTURE")).unionByName(listed("material", material_at, "material_at", "material", "IFCRELASSOCIATESMATERIAL"))
    related, start = numbered(relations, ["kind", "key"], 1, start)
    hosts = targets.select(F.col("element").alias("host"), F.col("product").alias("host_product"))
    fills = targets.filter("host is not null").select("element", "host", F.col("product").alias("filling"), "placement")
    wanted = fills.groupBy("host").agg(F.count("*").alias("c_")).join(hosts, "host")
    openings, start = numbered(meet(fills, wanted, ["host"], "c_").select("element", "filling", "placement", "host_product"), ["element"], 3, start)
    cut = _instances(openings, _bundle(
        _call("IFCOPENINGELEMENT", step_text(derived_guid("opening", F.lit(name), F.col("element"))), f"#{_OWNER}", "$,$,$", ref(F.col("placement")), "$,$,.OPENING."),
        _call("IFCRELVOIDSELEMENT", step_text(derived_guid("voids", F.lit(name), F.col("element"))), f"#{_OWNER}", "$,$", ref(F.col("host_product")), at(0)),
        _call("IFCRELFILLSELEMENT", step_text(derived_guid("fills", F.lit(name), F.col("element"))), f"#{_OWNER}", "$,$", at(0), ref(F.col("filling"))),
    ))
    header = ["ISO-10303-21;", "HEADER;", "FILE_DESCRIPTION(('ViewDefinition [ReferenceView_V1.2]'),'2;1');", f"FILE_NAME({q},'',(''),(''),'girder','girder','');", "FILE_SCHEMA(('IFC4'));", "ENDSEC;", "DATA;"]
    ends = spark.createDataFrame([(0, "\n".join(header)), (start, "ENDSEC;\nEND-ISO-10303-21;")], "number long, line string")
    out = ends
    for more in (fixed, _instances(one, head), storeys, lines, bodies, _instances(related, F.array(F.struct(F.lit(0).alias("k"), F.col("text").alias("text")))), cut):
        out = out.unionByName(more)
    return out


def write_ifc(path: str, name: str, levels: DataFrame, materials: DataFrame, elements: DataFrame) -> None:
    """An IFC4 file as part files whose concatenation it is."""
    write_lines(ifc_lines(name, levels, materials, elements), path, ["number"])
