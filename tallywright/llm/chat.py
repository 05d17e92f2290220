"""Chat formatting with tool-call linking (native: DataFrame functions only).

An assistant turn may be a JSON object with `tool_calls` (id, name, arguments) and `content`; a turn of
the role tool one with `tool_call_id` and `content`. Calls and results are hash-joined by conversation
and identifier, brought into a topological order (message, its calls, their results), arguments are
checked against the tools' schemas, and each item is written as canonical JSON: keys sorted, no
white space, no null fields outside the arguments, and each number in one form whatever its spelling (1e2, 100 and 100.0 are
100), exact at any length.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, let, materialize, pick

#: The tools' parameters, in the terms of JSON Schema: type, required, properties, items, enum. Other properties are not allowed.
_text, _number, _flag = {"type": "string"}, {"type": "number"}, {"type": "boolean"}
SCHEMAS = {
    "search": {"properties": {"query": _text, "limit": {"type": "integer"}}, "required": ["query"]},
    "calculate": {"properties": {"expression": _text}, "required": ["expression"]},
    "read_file": {"properties": {"path": _text, "binary": _flag}, "required": ["path"]},
    "weather": {
        "properties": {"latitude": _number, "longitude": _number, "units": {"type": "string", "enum": ["metric", "imperial"]}},
        "required": ["latitude", "longitude"],
    },
    "send": {
        "properties": {
            "to": {"type": "array", "items": _text},
            "options": {"type": "object", "properties": {"priority": {"type": "integer", "enum": [1, 2, 3]}, "silent": _flag}, "required": []},
        },
        "required": ["to"],
    },
}

ITEM = "conv_id, turn, kind, call_id, linked, valid, problem, order_turn, order_stage, order_index, position, json"

#: Private-use characters that stand for a number's start, an escaped backslash and an escaped quote while a text is rewritten.
NUMBER, BACKSLASH, QUOTE = "\ue000", "\ue001", "\ue002"
#: Turns of a conversation that are numbered together.
TURNS = 256
#: Items of one such stretch that a task may sort; more are dealt out by ranges of the order.
HOT_STRETCH = 100_000


def _plain_number(token: Column) -> Column:
    """A JSON number in one form: plain digits up to 21 before the point, down to 1e-7 behind it, else d.ddde±x; digits are never lost."""
    group = lambda pattern: F.regexp_extract(token, pattern, 1)
    whole, fraction = group(r"^-?([0-9]+)"), group(r"\.([0-9]+)")
    exponent = F.when(token.rlike("[eE]"), F.try_to_number(group(r"[eE]\+?(-?[0-9]{1,9})$"), F.lit("S999999999")).cast("int")).otherwise(0)
    digits = F.concat(whole, fraction)

    def form(d: Column) -> Column:
        kept = F.regexp_replace(d, "^0+", "")
        point = F.length(whole) + exponent - (F.length(d) - F.length(kept))
        return let(F.struct(F.regexp_replace(kept, "0+$", "").alias("d"), point.alias("point")), spelled)

    def spelled(x: Column) -> Column:
        d, point = x["d"], x["point"]
        n = F.length(d)
        power = F.concat(F.when(point > 0, "e+").otherwise("e"), (point - 1).cast("string"))
        return (
            F.when(d == "", "0")
            .when((n <= point) & (point <= 21), F.concat(d, F.repeat(F.lit("0"), point - n)))
            .when((point > 0) & (point < n), F.concat(F.substring(d, 1, point), F.lit("."), F.substring(d, point + 1, n)))
            .when((point <= 0) & (point > -7), F.concat(F.lit("0."), F.repeat(F.lit("0"), -point), d))
            .when(n == 1, F.concat(d, power))
            .otherwise(F.concat(F.substring(d, 1, F.lit(1)), F.lit("."), F.substring(d, F.lit(2), n), power))
        )

    value = let(digits, form)
    signed = F.when(token.startswith("-") & (value != "0"), F.concat(F.lit("-"), value)).otherwise(value)
    return F.coalesce(signed, token)  # an exponent of ten digits and more stays as it is


def mark_numbers(json: Column) -> Column:
    """The JSON text with each number as a string of NUMBER and its canonical form, so that no parser rounds it."""
    safe = F.replace(F.replace(json, F.lit("\\\\"), F.lit(BACKSLASH)), F.lit('\\"'), F.lit(QUOTE))
    tokens = F.regexp_extract_all(safe, F.lit(r'"[^"]*+"?|-?[0-9]+(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?|[^"0-9-]++|-'), F.lit(0))
    number = lambda t: F.concat(F.lit(f'"{NUMBER}'), _plain_number(t), F.lit('"'))
    marked = F.array_join(F.transform(tokens, lambda t: F.when(t.rlike("^-?[0-9]"), number(t)).otherwise(t)), "")
    return F.replace(F.replace(marked, F.lit(QUOTE), F.lit('\\"')), F.lit(BACKSLASH), F.lit("\\\\"))


def canonical(value: Column) -> Column:
    """A struct or variant as JSON, its marked numbers as numbers again."""
    return F.regexp_replace(F.to_json(value), f'"{NUMBER}([^"]*+)"', "$1")


def _text_of(value: Column) -> Column:
    """The string in a variant, null for anything else; a number as it is spelled."""
    text = F.when(F.schema_of_variant(value) == "STRING", F.try_variant_get(value, "$", "string"))
    return F.regexp_replace(text, f"^{NUMBER}", "")


def _json_type(value: Column) -> Column:
    """JSON type of a variant with marked numbers: string, integer, number, boolean, array, object or null."""
    kind = F.schema_of_variant(value)
    text = F.try_variant_get(value, "$", "string")
    return (
        F.when(kind.startswith("ARRAY"), "array").when(kind.startswith("OBJECT"), "object").when(kind == "BOOLEAN", "boolean")
        .when(kind == "VOID", "null").when(~text.startswith(NUMBER), "string")
        .when(text.contains(".") & ~text.contains("e+") | text.contains("e-"), "number").otherwise("integer")
    )


def _literal(value) -> str:
    import json

    return f'"{NUMBER}{value}"' if isinstance(value, (int, float)) and not isinstance(value, bool) else json.dumps(value, ensure_ascii=False)


def conforms(value: Column, schema: dict) -> Column:
    """Whether a variant (with marked numbers) fits a schema; null is no value. The schema is part of the expression."""
    kind = _json_type(value)
    want = schema.get("type", "object" if "properties" in schema else None)
    ok = F.lit(True) if want is None else (kind == want) | ((kind == "integer") if want == "number" else F.lit(False))
    if "enum" in schema:
        ok = ok & F.to_json(value).isin(*[_literal(x) for x in schema["enum"]])
    if "properties" in schema:
        fields = F.try_variant_get(value, "$", "map<string, variant>")
        for name, inner in schema["properties"].items():
            field = F.try_element_at(fields, F.lit(name))
            ok = ok & F.when(field.isNull(), F.lit(name not in schema.get("required", ()))).otherwise(conforms(field, inner))
        ok = ok & F.forall(F.map_keys(fields), lambda k: k.isin(*schema["properties"]))
    if "items" in schema:
        ok = ok & F.forall(F.try_variant_get(value, "$", "array<variant>"), lambda x: conforms(x, schema["items"]))
    return F.coalesce(ok, F.lit(False))


def _numbered(items: DataFrame, hot: int = HOT_STRETCH) -> DataFrame:
    """Adds position: 1, 2, … within the conversation, in topological order; equal items in the order of `uid`.

    Stretches of TURNS turns are numbered on their own and the counts of the stretches before are added, so that a conversation with very many turns is not
    one task's. A stretch of more than `hot` items (rows without a conversation, a turn that stands very often) is dealt by ranges of the order, each one
    written with its number and ranked on its own.
    """
    at = F.coalesce(F.floor(F.col("order_turn") / TURNS), F.lit(-(2**62)))
    items = items.withColumn("_at", at).withColumn("_conv", F.struct("conv_id"))
    counts = materialize(items.groupBy("_conv", "_at").agg(F.count(F.lit(1)).alias("_n")), "stretches")
    before = F.sum("_n").over(Window.partitionBy("_conv").orderBy("_at")) - F.col("_n")
    before = counts.select("_conv", "_at", before.alias("_before"))
    order = ["order_turn", "order_stage", "order_index", "kind", "call_id", "json", "uid"]
    large = counts.where(F.col("_n") > hot).select("_conv", "_at")  # at most one for each `hot` items
    most = counts.agg(F.sum(F.when(F.col("_n") > hot, F.col("_n")))).first()[0]
    ranked = lambda rows, *own: rows.withColumn("_rank", F.row_number().over(Window.partitionBy(*own, "_conv", "_at").orderBy(*order)))
    if not most:
        out = ranked(items)
    else:
        large = F.broadcast(large) if large.count() <= BROADCAST_ROWS else large
        dealt = items.join(large, ["_conv", "_at"]).repartitionByRange(2 * -(-most // hot), "_conv", "_at", *order)
        dealt = materialize(dealt.withColumn("_range", F.spark_partition_id()), "ranges")
        parts = dealt.groupBy("_conv", "_at", "_range").agg(F.count(F.lit(1)).alias("_n"))
        less = F.sum("_n").over(Window.partitionBy("_conv", "_at").orderBy("_range")) - F.col("_n")
        offsets = parts.select("_conv", "_at", "_range", less.alias("_less"))
        parted = ranked(dealt, "_range").join(offsets, ["_conv", "_at", "_range"]).withColumn("_rank", F.col("_rank") + F.col("_less"))
        rest = ranked(items.join(large, ["_conv", "_at"], "left_anti"))
        out = rest.unionByName(parted.select(*rest.columns))
    return out.join(before, ["_conv", "_at"]).withColumn("position", F.col("_before") + F.col("_rank")).select(*ITEM.split(", "))


def link_tool_calls(
    turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", schemas: dict[str, dict] = SCHEMAS,
    hot: int = HOT_STRETCH,
) -> DataFrame:
    """One row per message, call and result, with the columns of ITEM.

    position is a topological order of the conversation, that of (order_turn, order_stage, order_index): a call stands
    after its message, a result after its call even if its turn came before. A result joins the first call of
    its id; `linked` tells whether a call has a result or a result a call; null for messages. Calls that need each other's
    results name no such thing, so those of one turn keep their order in it, and results of earlier turns stand before.
    `valid` is about a call's arguments (null otherwise), `problem` says why not, or that an id is used again, or that a
    result has no call. Turns that are not such JSON (numbers out of JSON's grammar and repeated keys included) are messages as they
    stand, null text as empty; null ids link nothing; a null conversation is one of its own, a null turn its first. Repeated rows stay.
    An empty table gives an empty result. A JSON string that begins with the private-use character U+E000 loses it.
    """
    rows = pick(turns, conv_id=conv_col, turn=turn_col, role=role_col, text=text_col)
    rows = rows.withColumn("text", F.coalesce("text", F.lit("")))
    marked = F.try_parse_json(mark_numbers(F.col("text")))
    shaped = F.when(F.ltrim("text").startswith("{") & F.col("role").isin("assistant", "tool") & F.try_parse_json("text").isNotNull(), marked)
    rows = rows.withColumn("v", shaped)
    rows = rows.withColumn("calls", F.when(F.col("role") == "assistant", F.try_variant_get("v", "$.tool_calls", "array<variant>")))
    rows = rows.withColumn("result_of", F.when(F.col("role") == "tool", _text_of(F.try_variant_get("v", "$.tool_call_id", "variant"))))
    content = _text_of(F.try_variant_get("v", "$.content", "variant"))
    rows = rows.withColumn("content", F.when(F.col("calls").isNotNull() | F.col("result_of").isNotNull(), content).otherwise(F.col("text")))
    items = materialize(_items(rows, schemas), "items")

    calls, results = items.where("kind = 'call'"), items.where("kind = 'result'")
    first = calls.where(F.col("call_id").isNotNull()).groupBy("conv_id", "call_id").agg(F.min(F.struct("turn", "k")).alias("first"))
    answered = results.select("conv_id", "call_id").distinct().withColumn("has_result", F.lit(True))
    place = lambda turn, stage, index: (turn.alias("order_turn"), F.lit(stage).alias("order_stage"), index.alias("order_index"))
    columns = ["conv_id", "turn", "kind", "call_id", "linked", "valid", "problem", "order_turn", "order_stage", "order_index", "json", "uid"]

    messages = items.where("kind = 'message'").withColumn("linked", F.lit(None).cast("boolean")).select("*", *place(F.col("turn"), 0, F.lit(0)))
    again = F.coalesce(F.col("first") != F.struct("turn", "k"), F.lit(False))
    calls = calls.join(first, ["conv_id", "call_id"], "left").join(answered, ["conv_id", "call_id"], "left")
    calls = calls.withColumn("linked", F.coalesce("has_result", F.lit(False)) & ~again).withColumn("problem", F.coalesce("problem", F.when(again, "id used again")))
    calls = calls.select("*", *place(F.col("turn"), 1, F.col("k")))
    results = results.join(first, ["conv_id", "call_id"], "left").withColumn("linked", F.col("first").isNotNull())
    results = results.withColumn("problem", F.when(~F.col("linked"), "no such call"))
    results = results.select("*", *place(F.greatest("turn", F.col("first.turn")), 2, F.coalesce(F.col("first.k"), F.lit(0))))
    return _numbered(messages.select(*columns).unionByName(calls.select(*columns)).unionByName(results.select(*columns)), hot)


def _items(rows: DataFrame, schemas: dict[str, dict]) -> DataFrame:
    """(conv_id, turn, kind, k, call_id, valid, problem, json, uid) of each message, call and result: all that needs no other turn, from one pass."""
    own = F.array(F.lit(None).cast("variant"))  # the turn itself, before its calls
    each = F.posexplode(F.when(F.col("calls").isNull(), own).otherwise(F.concat(own, F.col("calls"))))
    rows = rows.select("conv_id", "turn", "role", "content", "result_of", each.alias("at", "call"))
    kind = F.when(F.col("at") > 0, "call").when(F.col("result_of").isNotNull(), "result").otherwise("message")
    part = lambda name: F.try_variant_get("call", f"$.{name}", "variant")
    is_call = F.col("kind") == "call"
    rows = rows.select(
        "conv_id", "turn", "role", "content", kind.alias("kind"), (F.col("at") - 1).alias("k"), part("arguments").alias("arguments"),
        _text_of(part("name")).alias("name"), F.coalesce(F.col("result_of"), _text_of(part("id"))).alias("call_id"),
    )
    known = F.coalesce(F.col("name").isin(*schemas), F.lit(False)) if schemas else F.lit(False)
    fits = F.lit(False)
    for name, schema in schemas.items():
        fits = F.when(F.col("name") == name, conforms(F.col("arguments"), {"type": "object"} | schema)).otherwise(fits)
    rows = rows.withColumn("valid", F.when(is_call, known & F.coalesce(fits, F.lit(False))))
    is_object = F.coalesce(_json_type(F.col("arguments")) == "object", F.lit(False))
    problem = F.when(~known, "unknown tool").when(~is_object, "arguments are no object").when(~F.col("valid"), "arguments do not fit the schema")
    json = (
        F.when(is_call, canonical(F.struct("arguments", F.col("call_id").alias("id"), "name")))
        .when(F.col("kind") == "result", F.to_json(F.struct("content", F.lit("tool").alias("role"), F.col("call_id").alias("tool_call_id"))))
        .otherwise(F.to_json(F.struct("content", "role")))
    )
    return rows.select(
        "conv_id", "turn", "kind", "k", "call_id", "valid", F.when(is_call, problem).alias("problem"), json.alias("json"), F.monotonically_increasing_id().alias("uid")
    )
