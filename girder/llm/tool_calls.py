"""Tool-call linking of conversations with built-in functions only.

Calls stand in messages as ``<tool_call>{...}</tool_call>`` or in a JSON
message's ``tool_calls``; results in messages of the role ``tool`` as JSON with
``tool_call_id``, or as ``<tool_response>{...}</tool_response>``; schemas in
system messages as ``<tools>[...]</tools>``. Calls and results are hash-joined
by conversation and identifier, each result is ordered after its call,
arguments are checked against the tool's schema, and every message becomes
canonical JSON: keys in order, no white space.

Topological order: a message that answers a call stands behind the message
that makes it. ``order_turn`` and ``order_step`` are the greatest of (own turn,
0) and (place of the call's message, one step further), so a message whose call
was moved moves behind it in turn. Only messages behind some late call are
looked at, in rounds of hash joins: as many as the longest chain of them has.
Messages on a cycle (each answers a call of the other), or behind one, keep
their turn and have the problem ``cycle``. Rows are not gathered by
conversation, so a conversation of any length stays distributed.

Schemas: ``type`` (a name or a list), ``enum``, ``const``, ``minimum``,
``maximum``, ``required``, ``properties``, ``additionalProperties`` (false or a
schema) and ``items`` are checked at every depth, one level of all calls at a
time; other words of JSON Schema are ignored. A problem names what is wrong and
where: ``type:a.b[0]``.

Cases: null texts are empty content; a call without an identifier or that is
no JSON object is ``invalid``; of several calls (results) with one identifier
the first by turn and place is linked, the others are ``duplicate``; a call
without a result is ``unanswered``, a result without a call ``orphan``; rows of
one conv_id and turn are kept each by itself; null conv_ids link with nothing;
an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .storage import materialize

#: Tags around a call's, a result's and the tools' JSON.
CALL, RESPONSE, TOOLS = "tool_call", "tool_response", "tools"
#: White space around it.
SPACE = " \t\n\v\f\r"

# JSON schema types and the names that Spark gives to such values.
TYPES = {"string": "^STRING$", "integer": "^BIGINT$", "number": "^(BIGINT|DOUBLE|FLOAT|DECIMAL.*)$", "boolean": "^BOOLEAN$", "array": "^ARRAY", "object": "^OBJECT", "null": "^VOID$"}


def _none() -> Column:
    return F.array().cast("array<string>")


def tagged(text: Column, tag: str) -> Column:
    """What stands between a tag and its next closing tag, each time, without the white space around it: the text is split at the closing tags and a part counts from its first opening one, so a text is read once whatever it holds."""
    opening = f"<{tag}>"
    parts = F.split(text, f"</{tag}>", -1)
    closed = F.slice(parts, F.lit(1), F.size(parts) - 1)  # no closing tag follows the last part
    inner = lambda p: F.substring(p, F.call_function("locate", F.lit(opening), p) + len(opening), F.length(p))
    return F.transform(F.filter(closed, lambda p: p.contains(opening)), lambda p: F.btrim(inner(p), F.lit(SPACE)))


def untagged(text: Column, tag: str) -> Column:
    """The text without what ``tagged`` finds in it, tags included."""
    opening, closing = f"<{tag}>", f"</{tag}>"
    parts = F.split(text, closing, -1)
    closed = F.slice(parts, F.lit(1), F.size(parts) - 1)
    kept = F.transform(closed, lambda p: F.when(p.contains(opening), F.substring_index(p, opening, 1)).otherwise(F.concat(p, F.lit(closing))))
    return F.concat(F.array_join(kept, ""), F.element_at(parts, -1))


def canonical(json: Column) -> Column:
    """Canonical JSON: an object's keys are held in order by the variant type."""
    return F.to_json(F.try_parse_json(json))


def _get(json: Column, path: str, kind: str) -> Column:
    return F.try_variant_get(F.try_parse_json(json), path, kind)


def _parts(text: Column, role: Column) -> tuple[Column, Column]:
    """JSON texts of a message's calls and of its results."""
    whole = F.when(F.ltrim(text).startswith("{"), text)
    listed = F.transform(F.try_variant_get(F.try_parse_json(whole), "$.tool_calls", "array<variant>"), lambda x: F.to_json(x))
    calls = F.concat(tagged(text, CALL), F.coalesce(listed, _none()))
    own = F.when((role == "tool") & whole.isNotNull(), F.array(text)).otherwise(_none())
    results = F.concat(tagged(text, RESPONSE), own)
    return calls, results


def _call_fields(json: Column) -> list[Column]:
    arguments = F.coalesce(_get(json, "$.function.arguments", "variant"), _get(json, "$.arguments", "variant"))
    inner = F.when(F.schema_of_variant(arguments) == "STRING", F.to_json(F.try_parse_json(arguments.cast("string")))).otherwise(F.to_json(arguments))
    return [_get(json, "$.id", "string").alias("id"), F.coalesce(_get(json, "$.function.name", "string"), _get(json, "$.name", "string")).alias("name"), inner.alias("arguments")]


def schemas(messages: DataFrame) -> DataFrame:
    """(conv_id, name, schema) of the tools that system messages declare; of several with one name the first text counts."""
    listed = messages.filter("role = 'system' and text like '%<tools>%'").select("conv_id", F.explode(tagged(F.col("text"), TOOLS)).alias("tools"))
    tool = listed.select("conv_id", F.explode(F.try_variant_get(F.try_parse_json("tools"), "$", "array<variant>")).alias("tool")).select("conv_id", F.to_json("tool").alias("tool"))
    part = lambda path, kind: F.coalesce(_get(F.col("tool"), f"$.function.{path}", kind), _get(F.col("tool"), f"$.{path}", kind))
    named = tool.select("conv_id", part("name", "string").alias("name"), F.to_json(part("parameters", "variant")).alias("schema"))
    return named.filter("name is not null and schema is not null").groupBy("conv_id", "name").agg(F.min("schema").alias("schema"))


def _is(value: Column, name: Column) -> Column:
    """Whether a JSON value is of a schema's type; a whole number is an integer however it is written."""
    found, kind = F.schema_of_variant(F.try_parse_json(value)), F.lit(None).cast("string")
    for type_, regex in TYPES.items():
        kind = F.when(name == type_, F.lit(regex)).otherwise(kind)
    number = F.when(F.regexp(found, F.lit(TYPES["number"])), value.try_cast("double"))
    whole = (name == "integer") & F.coalesce(number == F.floor(number), F.lit(False))
    return F.coalesce(F.regexp(found, kind), F.lit(True)) | whole  # an unknown type says nothing


def _level_errors(schema: Column, value: Column, path: Column) -> Column:
    """Errors of one JSON value under its schema, not looking into its parts."""
    named = F.coalesce(_get(schema, "$.type", "array<string>"), F.when(_get(schema, "$.type", "string").isNotNull(), F.array(_get(schema, "$.type", "string"))))
    as_json = lambda xs: F.transform(xs, lambda x: F.to_json(x))
    given = _get(value, "$", "map<string,variant>")
    keys = F.coalesce(F.map_keys(given), _none())
    wanted = F.coalesce(_get(schema, "$.required", "array<string>"), _none())
    known = F.coalesce(F.map_keys(_get(schema, "$.properties", "map<string,variant>")), _none())
    number = F.when(F.regexp(F.schema_of_variant(F.try_parse_json(value)), F.lit(TYPES["number"])), value.try_cast("double"))
    one = lambda kind, bad: F.when(F.coalesce(bad, F.lit(False)), F.array(F.concat(F.lit(f"{kind}:"), path))).otherwise(_none())
    below = lambda kind, names: F.transform(names, lambda k: F.concat(F.lit(f"{kind}:"), _under(path, k)))
    return F.concat(
        one("type", named.isNotNull() & ~F.exists(F.coalesce(named, _none()), lambda t: _is(value, t))),
        one("enum", ~F.array_contains(as_json(_get(schema, "$.enum", "array<variant>")), value)),
        one("const", F.to_json(_get(schema, "$.const", "variant")) != value),
        one("range", (number < _get(schema, "$.minimum", "double")) | (number > _get(schema, "$.maximum", "double"))),
        F.when(given.isNotNull(), below("missing", F.array_except(wanted, keys))).otherwise(_none()),
        F.when(given.isNotNull() & (_get(schema, "$.additionalProperties", "boolean") == F.lit(False)), below("extra", F.array_except(keys, known))).otherwise(_none()),
    )


def _under(path: Column, key: Column) -> Column:
    return F.when(path == "$", key).otherwise(F.concat(path, F.lit("."), key))


def argument_errors(calls: DataFrame, by: list[str]) -> DataFrame:
    """(by, error) of calls (by, arguments, schema: JSON texts): one level of the arguments after the other until none has parts with a schema."""
    level, errors = calls.select(*by, F.col("schema"), F.col("arguments").alias("value"), F.lit("$").alias("path")), None
    while True:
        level = materialize(level.filter("schema is not null and value is not null"), "arguments")
        if level.limit(1).count() == 0 and errors is not None:
            return errors
        found = level.select(*by, F.explode(_level_errors(F.col("schema"), F.col("value"), F.col("path"))).alias("error"))
        errors = found if errors is None else errors.unionByName(found)
        schema, value, path = F.col("schema"), F.col("value"), F.col("path")
        fields = F.map_entries(_get(value, "$", "map<string,variant>"))
        rest = F.to_json(_get(schema, "$.additionalProperties", "variant"))
        of_key = lambda k: F.coalesce(F.to_json(F.try_element_at(_get(schema, "$.properties", "map<string,variant>"), k)), F.when(F.ltrim(rest).startswith("{"), rest))
        parts = F.transform(fields, lambda e: F.struct(of_key(e["key"]).alias("schema"), F.to_json(e["value"]).alias("value"), _under(path, e["key"]).alias("path")))
        items = F.to_json(_get(schema, "$.items", "variant"))
        listed = F.transform(_get(value, "$", "array<variant>"), lambda x, i: F.struct(items.alias("schema"), F.to_json(x).alias("value"), F.concat(path, F.lit("["), i.cast("string"), F.lit("]")).alias("path")))
        level = level.select(*by, F.explode(F.coalesce(parts, listed)).alias("p")).select(*by, "p.schema", "p.value", "p.path")


ME, BEFORE = ["conv_id", "turn", "key"], ["conv_id", "dep_turn", "dep_key"]


def order(answers: DataFrame) -> DataFrame | None:
    """(conv_id, turn, key, order_turn, order_step, cycle) of the messages that may not stay at their turn, from links (conv_id, turn, key, dep_turn, dep_key) to the messages that they answer; None if all stay."""
    links = answers.filter("turn is not null and dep_turn is not null and not (turn = dep_turn and key = dep_key)").distinct()
    links = materialize(links, "answers")
    front = materialize(links.filter("dep_turn >= turn").select(*ME).distinct(), "late")
    if front.limit(1).count() == 0:
        return None
    behind = front
    while True:  # all that answer, over any number of calls, a late message
        step = links.join(front.toDF(*BEFORE), BEFORE, "left_semi").select(*ME).distinct().join(behind, ME, "left_anti")
        front = materialize(step, "late")
        if front.limit(1).count() == 0:
            break
        behind = materialize(behind.unionByName(front), "behind")
    within = materialize(links.join(behind, ME, "left_semi").join(behind.toDF(*BEFORE).withColumn("waits", F.lit(True)), BEFORE, "left"), "within")
    done, waiting = None, behind
    while True:
        placed = behind.limit(0).withColumns({"order_turn": F.col("turn"), "order_step": F.lit(0)}) if done is None else done
        of = placed.toDF(*BEFORE, "p_turn", "p_step")
        mine = within.join(waiting, ME, "left_semi").join(of, BEFORE, "left")
        place = F.when(F.col("waits").isNull(), F.struct(F.col("dep_turn").alias("t"), F.lit(1).alias("s"))).when(F.col("p_turn").isNotNull(), F.struct(F.col("p_turn").alias("t"), (F.col("p_step") + 1).alias("s")))
        ready = mine.groupBy(*ME).agg(F.max(F.coalesce(F.col("waits"), F.lit(False)) & F.col("p_turn").isNull()).alias("open"), F.max(place).alias("p")).filter("not open")
        at = F.greatest(F.struct(F.col("turn").alias("t"), F.lit(0).alias("s")), F.col("p"))
        ready = materialize(ready.select(*ME, at["t"].alias("order_turn"), at["s"].alias("order_step")), "ready")
        if ready.limit(1).count() == 0:
            stuck = waiting.select(*ME, F.col("turn").alias("order_turn"), F.lit(0).alias("order_step"), F.lit(True).alias("cycle"))
            return placed.withColumn("cycle", F.lit(False)).unionByName(stuck)
        done = ready if done is None else materialize(done.unionByName(ready), "placed")
        waiting = materialize(waiting.join(ready.select(*ME), ME, "left_anti"), "waiting")


def link(messages: DataFrame) -> DataFrame:
    """A row for each message: conv_id, turn, role, order_turn, order_step, n_calls, n_results, n_linked, problems, canonical.

    ``problems`` lists what is wrong with the message's calls and results;
    ``order_step`` is above 0 for a message that was moved behind its calls.
    """
    rows = messages.select("conv_id", "turn", "role", "text", F.xxhash64("role", "text").alias("key"))
    tools = materialize(schemas(rows), "schemas")
    text = F.coalesce(F.col("text"), F.lit(""))
    calls, results = _parts(text, F.coalesce("role", F.lit("")))
    marked = F.coalesce(F.col("text").contains("<tool_") | F.col("text").contains("tool_call"), F.lit(False))
    plain = rows.filter(~marked).select(
        "conv_id", "turn", "role", F.col("turn").alias("order_turn"), F.lit(0).alias("order_step"), F.lit(0).alias("n_calls"), F.lit(0).alias("n_results"), F.lit(0).alias("n_linked"), F.lit("").alias("problems"),
        F.to_json(F.struct(text.alias("content"), F.col("role").alias("role")), {"ignoreNullFields": "false"}).alias("canonical"),
    )
    held = materialize(rows.filter(marked).withColumn("calls", calls).withColumn("results", results), "marked")  # what follows reads the marked rows alone
    at = ["conv_id", "turn", "key"]
    call = held.select(*at, F.posexplode("calls").alias("place", "json")).select(*at, "place", *_call_fields(F.col("json"))).distinct()
    result = held.select(*at, F.posexplode("results").alias("place", "json")).select(*at, "place", _get(F.col("json"), "$.tool_call_id", "string").alias("id")).distinct()
    # the first of each identifier, by partial minima
    first_call = call.filter("id is not null").groupBy("conv_id", "id").agg(F.min(F.struct("turn", "key", "place")).alias("c"))
    first_result = result.filter("id is not null").groupBy("conv_id", "id").agg(F.min(F.struct("turn", "key", "place")).alias("r"))
    pair = first_call.join(first_result, ["conv_id", "id"], "full_outer")

    me = F.struct("turn", "key", "place")
    errors_of = argument_errors(call.join(tools, ["conv_id", "name"]).filter("id is not null"), [*at, "place"]).groupBy(*at, "place").agg(F.array_sort(F.collect_set("error")).alias("errors"))  # one call's
    errors_of = errors_of.select(*[F.col(c).alias(f"e_{c}") for c in [*at, "place"]], "errors")
    same_call = [F.col(c).eqNullSafe(F.col(f"e_{c}")) for c in [*at, "place"]]
    judged_calls = call.join(pair, ["conv_id", "id"], "left").join(errors_of, same_call, "left")
    state = F.when(F.col("id").isNull() | F.col("name").isNull() | F.col("arguments").isNull(), "invalid").when(F.col("c") != me, "duplicate").when(F.col("r").isNull(), "unanswered")
    notes = F.concat(F.when(state.isNotNull(), F.array(state)).otherwise(_none()), F.coalesce("errors", _none()))
    one = F.struct("place", "arguments", "id", "name", F.transform(notes, lambda x: F.concat_ws(" ", F.coalesce("id", F.lit("?")), x)).alias("notes"), (state.isNull() & F.col("r").isNotNull()).alias("linked"))
    by_call = judged_calls.groupBy(*at).agg(F.array_sort(F.collect_set(one)).alias("made"))  # one message's calls
    judged_results = result.join(pair, ["conv_id", "id"], "left")
    state = F.when(F.col("id").isNull(), "invalid").when(F.col("c").isNull(), "orphan").when(F.col("r") != me, "duplicate")
    one = F.struct("place", "id", F.when(state.isNotNull(), F.concat_ws(" ", F.coalesce("id", F.lit("?")), state)).alias("note"), state.isNull().alias("linked"))
    by_result = judged_results.groupBy(*at).agg(F.array_sort(F.collect_set(one)).alias("answered"))

    def same(other: DataFrame, name: str) -> Column:
        return F.col("h.conv_id").eqNullSafe(F.col(f"{name}.conv_id")) & F.col("h.turn").eqNullSafe(F.col(f"{name}.turn")) & (F.col("h.key") == F.col(f"{name}.key"))

    joined = held.alias("h").join(by_call.alias("a"), same(by_call, "a"), "left").join(by_result.alias("b"), same(by_result, "b"), "left")
    made = F.coalesce("made", F.array().cast("array<struct<place:int,arguments:string,id:string,name:string,notes:array<string>,linked:boolean>>"))
    answered = F.coalesce("answered", F.array().cast("array<struct<place:int,id:string,note:string,linked:boolean>>"))
    joined = joined.select("h.conv_id", "h.turn", "h.key", "h.role", "h.text", made.alias("made"), answered.alias("answered"))
    moved = order(judged_results.filter("c is not null").select(*at, F.col("c.turn").alias("dep_turn"), F.col("c.key").alias("dep_key")))
    if moved is None:
        joined = joined.withColumns({"order_turn": F.col("turn"), "order_step": F.lit(0), "cycle": F.lit(False)})
    else:
        joined = joined.join(moved, at, "left").withColumns({"order_turn": F.coalesce("order_turn", "turn"), "order_step": F.coalesce("order_step", F.lit(0)), "cycle": F.coalesce("cycle", F.lit(False))})
    problems = F.concat(F.when(F.col("cycle"), F.array(F.lit("cycle"))).otherwise(_none()), F.flatten(F.transform("made", lambda x: x["notes"])), F.filter(F.transform("answered", lambda x: x["note"]), lambda x: x.isNotNull()))
    quoted = lambda x: F.coalesce(F.to_json(F.array(x)), F.lit("[null]"))  # noqa: E731  a string in JSON, in brackets
    bare = lambda x: F.substring(quoted(x), F.lit(2), F.length(quoted(x)) - 2)
    made_json = F.array_join(F.transform("made", lambda x: F.concat(F.lit('{"arguments":'), F.coalesce(x["arguments"], F.lit("null")), F.lit(',"id":'), bare(x["id"]), F.lit(',"name":'), bare(x["name"]), F.lit("}"))), ",")
    answered_json = F.array_join(F.transform("answered", lambda x: bare(x["id"])), ",")
    content = F.trim(untagged(untagged(text, CALL), RESPONSE))
    body = F.concat(F.lit('{"content":'), bare(F.coalesce(canonical(F.when(F.ltrim(text).startswith("{"), text)), content)), F.lit(',"role":'), bare(F.col("role")), F.lit(',"tool_call_ids":['), answered_json, F.lit('],"tool_calls":['), made_json, F.lit("]}"))
    linked = F.size(F.filter("made", lambda x: x["linked"])) + F.size(F.filter("answered", lambda x: x["linked"]))
    return plain.unionByName(
        joined.select(
            "conv_id", "turn", "role", "order_turn", F.col("order_step").cast("int").alias("order_step"), F.size("made").alias("n_calls"), F.size("answered").alias("n_results"),
            linked.alias("n_linked"), F.array_join(F.array_sort(problems), "; ").alias("problems"), body.alias("canonical"),
        )
    )
