import json
import random

from pyspark.sql import functions as F

from girder.llm import tool_calls as C

TOOLS = '<tools>[{"name":"add","parameters":{"type":"object","properties":{"a":{"type":"integer"},"b":{"type":"number"},"c":{"type":"array"}},"required":["a","b"]}}]</tools>'
ROWS = [
    (1, 0, "system", TOOLS),
    (1, 1, "tool", '{"tool_call_id":"x1","content":"3"}'),
    (1, 2, "assistant", 'hi <tool_call>{"name":"add","id":"x1","arguments":{"b":2, "a":1}}</tool_call><tool_call>{"id":"x2","name":"add","arguments":"{\\"a\\":\\"q\\",\\"c\\":[1]}"}</tool_call>'),
    (1, 3, "tool", '{"tool_call_id":"zz","content":1}'),
    (1, 4, "tool", '{"tool_call_id":"x1","content":1}'),
    (1, 5, "assistant", '{"content":null,"tool_calls":[{"id":"y","type":"function","function":{"name":"add","arguments":"{\\"b\\": 1.5, \\"a\\": 1}"}}]}'),
    (1, 6, "user", '<tool_response>{"tool_call_id":"y"}</tool_response>'),
    (2, 0, "assistant", "<tool_call>bad</tool_call>"),
    (2, 1, "assistant", '<tool_call>{"id":"x1","name":"other","arguments":{}}</tool_call>'),
    (3, 0, None, None), (3, 1, "user", ""), (3, 1, "user", ""), (3, 2, "user", "say \"hi\"\n" * 3), (None, 1, "assistant", '<tool_call>{"id":"n","name":"f","arguments":{}}</tool_call>'),
]


def linked(spark, rows):
    return C.link(spark.createDataFrame([(*r, 1) for r in rows], "conv_id long, turn long, role string, text string, key int")).collect()


def test_links_order_and_problems(spark):
    got = linked(spark, ROWS)
    assert len(got) == len(ROWS)
    by = {(r["conv_id"], r["turn"]): r for r in got}
    assert (by[1, 1]["order_turn"], by[1, 1]["order_step"], by[1, 1]["n_linked"]) == (2, 1, 1)
    assert by[1, 2]["problems"] == "x2 missing:b; x2 type:a; x2 unanswered" and by[1, 2]["n_linked"] == 1
    assert by[1, 3]["problems"] == "zz orphan" and by[1, 4]["problems"] == "x1 duplicate"
    assert by[1, 5]["problems"] == "" and by[1, 5]["n_linked"] == 1 and by[1, 6]["n_linked"] == 1
    assert by[2, 0]["problems"] == "? invalid" and by[2, 1]["problems"] == "x1 unanswered", "identifiers belong to their conversation"
    order = sorted((r for r in got if r["conv_id"] == 1), key=lambda r: (r["order_turn"], r["order_step"], r["turn"]))
    assert [r["turn"] for r in order] == [0, 2, 1, 3, 4, 5, 6]


def test_canonical_json(spark):
    for r in linked(spark, ROWS):
        value = json.loads(r["canonical"])
        assert list(value) == sorted(value)
        assert json.dumps(value, separators=(",", ":"), ensure_ascii=False) == r["canonical"]
    by = {(r["conv_id"], r["turn"]): json.loads(r["canonical"]) for r in linked(spark, ROWS)}
    assert by[1, 2]["tool_calls"] == [{"arguments": {"a": 1, "b": 2}, "id": "x1", "name": "add"}, {"arguments": {"a": "q", "c": [1]}, "id": "x2", "name": "add"}]
    assert by[3, 2]["content"] == 'say "hi"\n' * 3


def test_long_conversations_and_empty_tables(spark):
    rows = [(7, k, "assistant" if k % 2 == 0 else "tool", f'<tool_call>{{"id":"c{k}","name":"f","arguments":{{}}}}</tool_call>' if k % 2 == 0 else f'{{"tool_call_id":"c{k - 1}"}}') for k in range(2000)]
    got = linked(spark, rows)
    assert len(got) == 2000 and all(r["n_linked"] == 1 and r["problems"] == "" for r in got)
    assert C.link(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


SCHEMA = {
    "type": "object",
    "properties": {
        "a": {"type": ["integer", "null"]}, "b": {"enum": ["x", 2, None, {"k": [1]}]}, "c": {"type": "array", "items": {"type": "object", "properties": {"d": {"type": "number", "minimum": 0}, "e": {"type": "string"}}, "required": ["d"], "additionalProperties": False}},
        "f": {"type": "object", "additionalProperties": {"type": "boolean"}, "required": ["g"]}, "h": {"const": 7},
    },
    "required": ["a"], "additionalProperties": False,
}


def is_type(v, t):
    number = isinstance(v, int | float) and not isinstance(v, bool)
    return {"string": isinstance(v, str), "integer": number and v == int(v), "number": number, "boolean": isinstance(v, bool), "array": isinstance(v, list), "object": isinstance(v, dict), "null": v is None}[t]


def brute_errors(schema, v, path="$"):
    under = lambda k: k if path == "$" else f"{path}.{k}"
    same = lambda x, y: json.dumps(x, sort_keys=True) == json.dumps(y, sort_keys=True)
    types = schema.get("type", [])
    types = [types] if isinstance(types, str) else types
    out = [f"type:{path}"] if types and not any(is_type(v, t) for t in types) else []
    out += [f"enum:{path}"] if "enum" in schema and not any(same(v, x) for x in schema["enum"]) else []
    out += [f"const:{path}"] if "const" in schema and not same(v, schema["const"]) else []
    out += [f"range:{path}"] if "minimum" in schema and is_type(v, "number") and v < schema["minimum"] else []
    if isinstance(v, dict):
        known, rest = schema.get("properties", {}), schema.get("additionalProperties")
        out += [f"missing:{under(k)}" for k in schema.get("required", []) if k not in v]
        out += [f"extra:{under(k)}" for k in v if rest is False and k not in known]
        for k, x in v.items():
            part = known.get(k, rest if isinstance(rest, dict) else None)
            out += brute_errors(part, x, under(k)) if part else []
    if isinstance(v, list) and "items" in schema:
        for i, x in enumerate(v):
            out += brute_errors(schema["items"], x, f"{path}[{i}]")
    return out


def any_value(r, depth=0):
    kind = r.choice(["int", "float", "str", "bool", "null"] + ["list", "dict"] * (depth < 2))
    return {"int": lambda: r.choice([0, 2, 7, -3]), "float": lambda: r.choice([1.0, 2.5, -0.5]), "str": lambda: r.choice(["x", "y"]), "bool": lambda: r.random() < 0.5, "null": lambda: None, "list": lambda: [any_value(r, depth + 1) for _ in range(r.randint(0, 3))], "dict": lambda: {k: any_value(r, depth + 1) for k in r.sample("degk", r.randint(0, 3))}}[kind]()


def test_schemas_match_brute_force(spark):
    r = random.Random(3)
    given = [{k: any_value(r) for k in r.sample("abcfhz", r.randint(0, 5))} for _ in range(150)]
    given += [{"a": 1, "c": [{"d": 1}, {"d": -1, "e": 2, "q": 0}, 5], "f": {"g": True, "x": 1}, "h": 7, "b": {"k": [1]}}]
    rows = [(k, 0, "system", f'<tools>[{json.dumps({"name": "f", "parameters": SCHEMA})}]</tools>') for k in range(len(given))]
    rows += [(k, 1, "assistant", f'<tool_call>{json.dumps({"id": "i", "name": "f", "arguments": v})}</tool_call>') for k, v in enumerate(given)]
    for x in linked(spark, rows):
        if x["turn"]:
            wanted = sorted(set(brute_errors(SCHEMA, given[x["conv_id"]])))
            assert sorted(x["problems"].split("; ")) == sorted(["i unanswered", *(f"i {e}" for e in wanted)]), given[x["conv_id"]]


def brute_order(calls, answers):
    """Place of each turn and whether it hangs on a cycle; calls: identifier -> turn, answers: (turn, identifier)."""
    deps, turns = {}, {t for t, _ in answers} | set(calls.values())
    for t, i in answers:
        if i in calls and calls[i] != t:
            deps.setdefault(t, set()).add(calls[i])
    place, left = {}, set(turns)
    while ready := [t for t in left if not deps.get(t, set()) & left]:
        for t in ready:
            place[t] = max([(t, 0), *((place[d][0], place[d][1] + 1) for d in deps.get(t, ()))])
        left -= set(ready)
    return place, left


def test_order_matches_brute_force(spark):
    r, rows, wanted = random.Random(8), [], {}
    for conv in range(40):
        calls, answers = {}, []
        for turn in range(12):
            made, said = [f"c{turn}"] if r.random() < 0.6 else [], []
            if r.random() < 0.6:
                said = [f"c{r.randrange(4) if conv % 3 == 0 else r.randrange(12)}" if r.random() < 0.5 + 0.5 * (conv % 2) else f"c{max(0, turn - 1)}"]
            if conv < 5 and turn in (3, 7):  # each answers a call of the other
                made, said = [f"c{turn}"], [f"c{10 - turn}"]
            calls |= {i: turn for i in made}
            answers += [(turn, i) for i in said]
            rows.append((conv, turn, "assistant", "".join(f'<tool_response>{{"tool_call_id":"{i}"}}</tool_response>' for i in said) + "".join(f'<tool_call>{{"id":"{i}","name":"f","arguments":{{}}}}</tool_call>' for i in made)))
        wanted[conv] = brute_order(calls, answers)
    seen = 0
    for x in linked(spark, rows):
        place, stuck = wanted[x["conv_id"]]
        if x["turn"] in stuck:
            seen += 1
            assert "cycle" in x["problems"].split("; ") and (x["order_turn"], x["order_step"]) == (x["turn"], 0)
        else:
            assert (x["order_turn"], x["order_step"]) == place.get(x["turn"], (x["turn"], 0))
    assert seen


def test_chains_follow_what_moved(spark):
    rows = [(1, 5, "assistant", '<tool_call>{"id":"x","name":"f","arguments":{}}</tool_call>'), (1, 2, "assistant", '<tool_response>{"tool_call_id":"x"}</tool_response><tool_call>{"id":"y","name":"f","arguments":{}}</tool_call>'), (1, 3, "tool", '{"tool_call_id":"y"}')]
    assert {r["turn"]: (r["order_turn"], r["order_step"]) for r in linked(spark, rows)} == {5: (5, 0), 2: (5, 1), 3: (5, 2)}


def test_no_python_in_the_plan(spark):
    plan = C.link(spark.createDataFrame(ROWS, "conv_id long, turn long, role string, text string"))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_tags_are_read_as_the_patterns_say(spark):
    import random
    import re

    r = random.Random(9)
    texts = ["".join(r.choice(["<tool_call>", "</tool_call>", "<tool_response>", "</tool_response>", " ", "\n", "{x}", "é"]) for _ in range(r.randrange(0, 14))) for _ in range(400)]
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    out = rows.select("t", C.tagged(F.col("t"), C.CALL).alias("a"), C.untagged(F.col("t"), C.CALL).alias("b")).collect()
    for x in out:
        assert x["a"] == [m.strip(" \t\n\v\f\r") for m in re.findall(r"(?s)<tool_call>(.*?)</tool_call>", x["t"])]
        assert x["b"] == re.sub(r"(?s)<tool_call>.*?</tool_call>", "", x["t"])


def test_no_message_takes_long(spark):
    import time

    texts = ["<tool_call>" + " " * 100_000, "<tool_call>" * 100_000, "<tool_call> {}" * 20_000 + " " * 100_000 + "x</tool_call>", "</tool_response>" * 100_000, "<tools>" + " " * 100_000]
    rows = spark.createDataFrame([(k, 0, "system" if k == 4 else "assistant", t) for k, t in enumerate(texts)], "conv_id long, turn int, role string, text string")
    C.link(rows.limit(1)).collect()
    began = time.perf_counter()
    assert C.link(rows).count() == len(texts)
    assert time.perf_counter() - began < 120  # many small jobs; patterns that look back took hours on such texts
