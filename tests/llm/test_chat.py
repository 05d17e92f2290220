import json
import random

from tallywright.llm import chat, registry

SCHEMA = "conv_id long, turn long, role string, text string"
call = lambda i, name, args: {"id": i, "name": name, "arguments": args}
assistant = lambda *calls: json.dumps({"tool_calls": list(calls), "content": "let me see"})
tool = lambda i, text: json.dumps({"content": text, "tool_call_id": i})

ROWS = [
    (1, 0, "user", 'say "hi"\nü /'),
    (1, 1, "assistant", assistant(call("a", "search", {"query": "q", "limit": 3}), call("b", "weather", {"longitude": 1, "latitude": 2.5}))),
    (1, 3, "tool", tool("a", "found")), (1, 0, "tool", tool("b", "too early")), (1, 4, "tool", tool("zz", "orphan")),
    (1, 5, "assistant", assistant(call("a", "search", {"query": 5}), call("c", "nope", {}), call("d", "send", [1]), call(None, "send", {"to": ["x"], "options": {"silent": True, "priority": 2}}))),
    (2, 0, "user", None), (2, 1, "assistant", "{broken"), (2, 2, "tool", "plain"), (2, 3, "tool", tool("a", "other conversation")),
    (None, None, None, ""), (1, 0, "user", 'say "hi"\nü /'), (3, 0, "user", '{"tool_calls": []}'),
]


def test_linking_order_validation_and_json(spark):
    df = spark.createDataFrame(ROWS, SCHEMA).selectExpr("*", "1 v", "2 calls", "3 name", "4 kind", "5 TURN")
    got = chat.link_tool_calls(df).collect()
    assert ", ".join(chat.link_tool_calls(df).columns) == chat.ITEM
    calls = {(r.turn, r.order_index): r for r in got if r.kind == "call"}
    assert [(calls[1, 0].linked, calls[1, 0].valid), (calls[1, 1].linked, calls[1, 1].valid)] == [(True, True)] * 2
    assert [calls[5, k].problem for k in range(4)] == ["arguments do not fit the schema", "unknown tool", "arguments are no object", None]
    assert calls[5, 3].json == '{"arguments":{"options":{"priority":2,"silent":true},"to":["x"]},"name":"send"}'
    results = {(r.conv_id, r.call_id): r for r in got if r.kind == "result"}
    assert results[1, "b"].linked and not results[1, "zz"].linked and not results[2, "a"].linked
    order = sorted((r for r in got if r.conv_id == 1), key=lambda r: r.position)
    assert [r.position for r in order] == list(range(1, len(order) + 1))
    keys = [(r.order_turn, r.order_stage, r.order_index) for r in order]
    assert keys == sorted(keys)
    place = {(r.kind, r.call_id, r.turn): i for i, r in enumerate(order)}
    assert place["result", "b", 0] > place["call", "b", 1] > place["message", None, 1]
    texts = [r.json for r in got if r.kind == "message"]
    assert texts.count('{"content":"say \\"hi\\"\\nü /","role":"user"}') == 2 and '{"content":"{broken","role":"assistant"}' in texts
    assert '{"content":"{\\"tool_calls\\": []}","role":"user"}' in texts and '{"content":"plain","role":"tool"}' in texts
    assert chat.link_tool_calls(df.limit(0)).count() == 0


def test_given_conversations(spark):
    sf = "/root/testdata/sf0.001"
    turns = spark.read.parquet(f"{sf}/conversations.parquet").collect()
    got = registry.op4_chat_formatting(spark, sf).collect()
    for conv in {r.conv_id for r in turns}:
        place = sorted((r.position, r.turn) for r in got if r.conv_id == conv)
        assert [p for p, _ in place] == list(range(1, len(place) + 1)) and [t for _, t in place] == sorted(t for _, t in place)
    want = [(r.conv_id, r.turn, json.dumps({"content": r.text, "role": r.role}, ensure_ascii=False, separators=(",", ":"))) for r in turns]
    assert sorted((r.conv_id, r.turn, r.json) for r in got) == sorted(want)


NUMBERS = {
    "100": "100", "1e2": "100", "100.0": "100", "1E+2": "100", "1.50": "1.5", "0": "0", "-0": "0", "-0.0e5": "0", "0.001": "0.001", "1e-3": "0.001", "1e-9": "1e-9",
    "-12.5e1": "-125", "123456789012345678901234567890123456789012345678901": "1.23456789012345678901234567890123456789012345678901e+50",
    "1e21": "1e+21", "1e20": "100000000000000000000", "0.1e1": "1", "12345.6789e2": "1234567.89", "1.25e-8": "1.25e-8", "1e400": "1e+400",
}


def test_numbers_have_one_form(spark):
    rows = [(i, 0, "assistant", f'{{"tool_calls": [{{"id": "i", "name": "x", "arguments": {{"b": [{n}, "{n}"], "a": "\\\\ \\" {n}"}}}}]}}') for i, n in enumerate(NUMBERS)]
    got = {r.conv_id: r.json for r in chat.link_tool_calls(spark.createDataFrame(rows, SCHEMA)).where("kind = 'call'").collect()}
    for i, (n, want) in enumerate(NUMBERS.items()):
        assert got[i] == f'{{"arguments":{{"a":"\\\\ \\" {n}","b":[{want},"{n}"]}},"id":"i","name":"x"}}'


def _value(rng, depth=0):
    kinds = [lambda: rng.choice([0, 1, 2, 3, 5, 100, -7, 10**30]), lambda: rng.choice([0.5, 2.0, 1e3, -1.25]), lambda: rng.choice(["", "metric", "imperial", "a\"b\\c", "7"]),
             lambda: rng.choice([True, False, None])]
    if depth < 2:
        kinds += [lambda: [_value(rng, depth + 1) for _ in range(rng.randint(0, 3))]]
        kinds += [lambda: {k: _value(rng, depth + 1) for k in rng.sample(["priority", "silent", "x"], rng.randint(0, 2))}]
    return rng.choice(kinds)()


def _fits(v, schema):
    kind = ("null" if v is None else "boolean" if isinstance(v, bool) else "string" if isinstance(v, str) else "array" if isinstance(v, list)
            else "object" if isinstance(v, dict) else "integer" if v == int(v) else "number")
    want = schema.get("type", "object" if "properties" in schema else kind)
    if kind != want and (kind, want) != ("integer", "number") or "enum" in schema and v not in schema["enum"]:
        return False
    if "properties" in schema and not (set(schema.get("required", ())) <= set(v) <= set(schema["properties"]) and all(_fits(x, schema["properties"][k]) for k, x in v.items())):
        return False
    return "items" not in schema or all(_fits(x, schema["items"]) for x in v)


def test_random_conversations_match_brute_force(spark):
    rng = random.Random(8)
    rows = []
    for conv in range(60):
        for turn in range(rng.randint(1, 9)):
            kind = rng.randint(0, 3)
            ids = [rng.choice(["a", "b", "c", None]) for _ in range(rng.randint(0, 3))]
            if kind == 0:
                calls = []
                for i in ids:
                    name = rng.choice([*chat.SCHEMAS, "nope"])
                    names = list(chat.SCHEMAS.get(name, {"properties": {"q": 0}})["properties"]) + ["other"]
                    plain = {"query": "q", "expression": "1+1", "path": "/", "latitude": 1.5, "longitude": 2, "to": ["x"], "units": "metric", "limit": 3}
                    args = {k: plain.get(k) if rng.random() < 0.7 and k in plain else _value(rng) for k in names if rng.random() < (0.1 if k == "other" else 0.8)}
                    calls.append(call(i, name, args if rng.random() < 0.9 else _value(rng)))
                rows.append((conv, turn, "assistant", assistant(*calls)))
            elif kind == 1:
                rows.append((conv, turn, "tool", tool(rng.choice("abcd"), "found " + str(turn))))
            else:
                rows.append((conv, turn, rng.choice(["user", "assistant", "tool"]), rng.choice(["hello", "{", '{"x": 1}', ""])))
    dump = lambda x: json.dumps(x, ensure_ascii=False, separators=(",", ":"), sort_keys=True)
    want, first, results = [], {}, {}
    parsed = [(c, t, r, (json.loads(x) if x.startswith('{"') and r in ("assistant", "tool") else {}), x) for c, t, r, x in rows]
    for c, t, r, v, _ in parsed:
        for k, x in enumerate(v.get("tool_calls", ()) if r == "assistant" else ()):
            if x["id"] is not None:
                first[c, x["id"]] = min(first.get((c, x["id"]), (t, k)), (t, k))
        if r == "tool" and "tool_call_id" in v:
            results[c, v["tool_call_id"]] = True
    def whole(x):
        return {k: whole(y) for k, y in x.items()} if isinstance(x, dict) else [whole(y) for y in x] if isinstance(x, list) else (int(x) if isinstance(x, float) and x == int(x) else x)

    for c, t, r, v, text in parsed:
        if r == "tool" and "tool_call_id" in v:
            at = first.get((c, v["tool_call_id"]))
            place = (max(t, at[0]), 2, at[1]) if at else (t, 2, 0)
            want.append((c, *place, "result", v["tool_call_id"], at is not None, None, None if at else "no such call", dump({**v, "role": "tool"})))
            continue
        body = v["content"] if "tool_calls" in v and r == "assistant" else text
        want.append((c, t, 0, 0, "message", None, None, None, None, dump({"content": body, "role": r})))
        for k, x in enumerate(v.get("tool_calls", ()) if r == "assistant" else ()):
            again = x["id"] is not None and first[c, x["id"]] != (t, k)
            known, args = x["name"] in chat.SCHEMAS, x["arguments"]
            valid = known and isinstance(args, dict) and _fits(args, chat.SCHEMAS[x["name"]])
            problem = ("unknown tool" if not known else "arguments are no object" if not isinstance(args, dict)
                       else "arguments do not fit the schema" if not valid else "id used again" if again else None)
            shown = {k: y for k, y in {**x, "arguments": whole(args)}.items() if y is not None or k == "arguments"}
            text = dump(shown).replace(str(10**30), "1e+30")
            want.append((c, t, 1, k, "call", x["id"], (c, x["id"]) in results and not again, valid, problem, text))
    got = chat.link_tool_calls(spark.createDataFrame(rows, SCHEMA)).collect()
    columns = "conv_id order_turn order_stage order_index kind call_id linked valid problem json".split()
    assert sorted((tuple(r[x] for x in columns) for r in got), key=str) == sorted(want, key=str)
    assert len({(r.conv_id, r.position) for r in got}) == len(got) and {r.valid for r in got} == {True, False, None}
    ordered = sorted(got, key=lambda r: (r.conv_id, r.position))
    assert [tuple(r[x] for x in columns[:4]) for r in ordered] == sorted(w[:4] for w in want)


def test_a_long_conversation_is_numbered_in_stretches(spark):
    rows = [(1, t % 1500, "user", str(t)) for t in range(2000)] + [(1, None, "user", "no turn"), (None, 3, "user", "no conversation")]
    got = chat.link_tool_calls(spark.createDataFrame(rows, SCHEMA).repartition(5)).collect()
    mine = sorted((r.position, -1 if r.turn is None else r.turn) for r in got if r.conv_id == 1)
    assert [p for p, _ in mine] == list(range(1, 2002)) and [t for _, t in mine] == sorted(t for _, t in mine)
    assert [r.position for r in got if r.conv_id is None] == [1]


def test_hot_stretches_are_dealt_by_ranges(spark):
    """Rows without a conversation, and one turn that stands very often, equal rows among them; as numbered in one window."""
    rng = random.Random(3)
    rows = [(None, rng.randrange(3), "user", f"text {rng.randrange(40)}") for _ in range(400)] + [(7, 0, "user", "the same")] * 300
    rows += [(conv, t, "user", str(t)) for conv in range(5) for t in range(6)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(4)
    whole, dealt = (chat.link_tool_calls(df, hot=h).collect() for h in (10**6, 50))
    places = lambda got: sorted((str(r.conv_id), r.position, r.order_turn, r.json) for r in got)
    assert places(whole) == places(dealt) and len(dealt) == len(rows)
    mine = sorted(r.position for r in dealt if r.conv_id is None)
    assert mine == list(range(1, 401))
