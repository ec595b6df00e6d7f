"""Tool-call linking for chat training data, with DataFrame functions only.

Messages carry calls and results as JSON text. Calls are hash-joined with their results by (conversation, call id), put in
topological order of what they depend on, checked against the tools' argument schemas, and written as canonical JSON:
keys sorted at every depth, no blanks, numbers in one form (what the variant type prints).

The order is found level by level over all conversations at once: a round joins the calls settled last with the edges
that wait for them and counts down what each call still waits for. Rounds are as many as the longest chain of calls, work
on waiting calls only, and store their result. Numbering within a conversation uses range partitions, so a conversation
may hold any share of the rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sonarlake.plans.durable import discard, durable, save_table
from sonarlake.plans.ordered import dense_index

from .common import pick

#: Argument schemas: per tool its parameters with type (string, integer, number, boolean, array, object) and whether required.
TOOLS: dict[str, dict[str, tuple[str, bool]]] = {
    "search": {"query": ("string", True), "limit": ("integer", True), "lang": ("string", False)},
    "note": {"title": ("string", True), "tags": ("array", False)},
    "convert": {"value": ("number", True), "unit": ("string", True)},
}
#: How the variant type names the types of a schema.
TYPES = {"string": "^STRING", "integer": "^BIGINT", "number": "^(BIGINT|DOUBLE|DECIMAL)", "boolean": "^BOOLEAN", "array": "^ARRAY", "object": "^OBJECT"}
CALL, RESULT = "call", "tool"


def messages_of(conversations: DataFrame) -> DataFrame:
    """Conversations retold with tools: every assistant turn calls a tool, every turn is the result of the turn before.

    Columns conv_id, turn, role, text. A call depends on the turn at half its number; some arguments break their schema
    and some results belong to no call, as in real logs.
    """
    c = pick(conversations, conv_id="conv_id", turn="turn", role="role", text="text")
    text = F.coalesce(F.col("text"), F.lit(""))
    n = F.length(text)
    name_of = lambda turn: F.concat(F.lit("call_"), F.col("conv_id").cast("string"), F.lit("_"), turn.cast("string"))
    quoted = _json_string(text)
    search = F.concat(F.lit('{ "query" : '), quoted, F.lit(', "limit": '), F.when(n % 7 == 0, F.lit('"many"')).otherwise(F.col("turn").cast("string")), F.lit("}"))
    note = F.concat(F.lit('{"title":'), quoted, F.when(n % 5 == 0, F.lit(', "colour": 1')).otherwise(F.lit("")), F.lit(', "tags": ["b", "a"]}'))
    convert = F.concat(F.lit('{"unit": "char"'), F.when(n % 5 == 0, F.lit("")).otherwise(F.concat(F.lit(', "value": '), n.cast("string"), F.lit(".50"))), F.lit("}"))
    kind = n % 3
    call = F.to_json(F.struct(
        name_of(F.col("turn")).alias("id"), F.when(kind == 0, "search").when(kind == 1, "note").otherwise("convert").alias("name"),
        F.when(kind == 0, search).when(kind == 1, note).otherwise(convert).alias("arguments"),
        F.when(F.col("turn") > 1, F.array(name_of(F.floor(F.col("turn") / 2)))).otherwise(F.array().cast("array<string>")).alias("after")))
    result = F.to_json(F.struct(name_of(F.col("turn") - 1).alias("tool_call_id"), text.alias("content")))
    told = F.array(F.struct(F.lit(RESULT).alias("role"), result.alias("text")),
                   F.when(F.col("role") == "assistant", F.struct(F.lit(CALL).alias("role"), call.alias("text"))))
    return c.select("conv_id", "turn", F.explode(F.filter(told, lambda x: x.isNotNull())).alias("m")).select("conv_id", "turn", "m.role", "m.text")


def _json_string(text: Column) -> Column:
    """The text as a JSON string literal."""
    whole = F.to_json(F.struct(text.alias("x")))
    return F.substr(whole, F.lit(6), F.length(whole) - 6)


def validate(name: Column, arguments: Column, tools: dict[str, dict[str, tuple[str, bool]]]) -> Column:
    """Sorted list of what is wrong with a call's arguments (a variant, null if it was no JSON)."""
    kind = F.schema_of_variant(arguments)
    per_tool = F.when(arguments.isNull(), F.array(F.lit("arguments are not JSON"))).when(~kind.startswith("OBJECT"), F.array(F.lit("arguments are no object")))
    keys = F.map_keys(F.try_variant_get(arguments, "$", "map<string,variant>"))
    for tool, parameters in sorted(tools.items()):
        found = []
        for p, (type_, required) in sorted(parameters.items()):
            value = F.try_variant_get(arguments, f"$.{p}", "variant")
            missing = F.when(F.lit(required), F.lit(f"{p} is missing"))
            found.append(F.when(value.isNull(), missing).when(~F.schema_of_variant(value).rlike(TYPES[type_]), F.lit(f"{p} is no {type_}")))
        strange = F.transform(F.filter(keys, lambda k: ~k.isin(*parameters)), lambda k: F.concat(k, F.lit(" is unknown")))
        errors = F.concat(F.filter(F.array(*found), lambda e: e.isNotNull()), F.coalesce(strange, F.array().cast("array<string>")))
        per_tool = per_tool.when(name == tool, F.array_sort(errors))
    return per_tool.otherwise(F.array(F.lit("tool is unknown")))


def topological_levels(calls: DataFrame, edges: DataFrame) -> DataFrame:
    """(key, level): 0 for calls that wait for nothing, else one more than the highest they wait for; null on and behind cycles.

    ``calls`` has distinct ``key``; ``edges`` distinct (key, dep) with both ends among the calls.
    """
    spark = calls.sparkSession
    edges = durable(edges, "edges")
    waiting, path = save_table(calls.select("key").join(edges.groupBy("key").agg(F.count(F.lit(1)).alias("left")), "key", "left")
                               .select("key", F.coalesce("left", F.lit(0)).cast("long").alias("left")), "waiting")
    parts, level = [], 0
    while True:
        settled = durable(waiting.filter("left = 0").select("key"), "settled")
        if settled.isEmpty():
            break
        parts.append(settled.withColumn("level", F.lit(level)))
        done = edges.join(settled.withColumnRenamed("key", "dep"), "dep", "left_semi").groupBy("key").agg(F.count(F.lit(1)).alias("n"))
        nxt, nxt_path = save_table(waiting.filter("left > 0").join(done, "key", "left").select("key", (F.col("left") - F.coalesce("n", F.lit(0))).alias("left")), "waiting")
        discard(spark, path)
        waiting, path, level = nxt, nxt_path, level + 1
    out = waiting.filter("left > 0").select("key", F.lit(None).cast("int").alias("level"))
    for p in parts:
        out = p.unionByName(out)
    return out


def link_calls(messages: DataFrame, tools: dict[str, dict[str, tuple[str, bool]]] = TOOLS, conv_id: str = "conv_id", turn: str = "turn",
               role: str = "role", text: str = "text") -> DataFrame:
    """One row per call: conv_id, call_id, turn, name, level, position, status, errors, record.

    Messages without text, conversation or a readable id are no calls and no results. Of calls with one id in a
    conversation the earliest counts (then the smaller text), of results the earliest likewise. ``level`` is null on
    cycles, which are placed last; dependencies on ids that no call has are ignored. ``position`` numbers a conversation's
    calls from 0 by level, turn and id. ``status`` is linked or unanswered; ``errors`` is empty for valid arguments;
    ``record`` is the call with its result as canonical JSON. Repeated messages change nothing; an empty table gives no
    rows.
    """
    m = pick(messages, conv_id=conv_id, turn=turn, role=role, text=text).filter("conv_id IS NOT NULL AND text IS NOT NULL")
    call = m.filter(F.col("role") == CALL).select("conv_id", "turn", F.from_json("text", "id string, name string, arguments string, after array<string>").alias("c"), "text")
    first = F.struct(F.coalesce("turn", F.lit(2**62)).alias("at"), F.col("text"), F.col("turn"), F.col("c.name").alias("name"), F.col("c.arguments").alias("arguments"), F.col("c.after").alias("after"))
    calls = (call.filter("c.id IS NOT NULL").groupBy("conv_id", F.col("c.id").alias("call_id")).agg(F.min(first).alias("f"))
             .select("conv_id", "call_id", "f.turn", "f.name", "f.arguments", "f.after"))
    calls = durable(calls, "calls")
    answer = m.filter(F.col("role") == RESULT).select("conv_id", "turn", F.from_json("text", "tool_call_id string, content string").alias("r"))
    results = (answer.filter("r.tool_call_id IS NOT NULL").groupBy("conv_id", F.col("r.tool_call_id").alias("call_id"))
               .agg(F.min(F.struct(F.coalesce("turn", F.lit(2**62)).alias("at"), F.col("r.content").alias("content"))).alias("f"), F.lit(True).alias("found"))
               .select("conv_id", "call_id", F.col("f.content").alias("content"), "found"))
    key = lambda i: F.struct(F.col("conv_id").alias("conv"), F.col(i).alias("call"))
    ids = calls.select(key("call_id").alias("key"))
    edges = calls.select(key("call_id").alias("key"), "conv_id", F.explode("after").alias("_dep")).select("key", key("_dep").alias("dep")).distinct()
    edges = edges.join(ids.withColumnRenamed("key", "dep"), "dep", "left_semi")
    levels = topological_levels(ids, edges).select(F.col("key.conv").alias("conv_id"), F.col("key.call").alias("call_id"), "level")
    linked = calls.join(results, ["conv_id", "call_id"], "left").join(levels, ["conv_id", "call_id"])
    order = [F.coalesce("level", F.lit(2**31 - 1)), F.coalesce("turn", F.lit(2**62)), F.col("call_id")]
    placed = dense_index(linked, ["conv_id"], order, "position")
    arguments = F.try_parse_json("arguments")
    errors = validate(F.col("name"), arguments, tools)
    record = F.to_json(F.struct(
        F.coalesce(arguments, F.try_parse_json(F.lit("null"))).alias("arguments"), F.col("call_id").alias("id"), F.col("name"),
        F.col("position"), F.col("content").alias("result"), (F.size(errors) == 0).alias("valid")), {"ignoreNullFields": "false"})
    return placed.select("conv_id", "call_id", "turn", "name", "level", F.col("position").cast("long").alias("position"),
                         F.when(F.col("found"), "linked").otherwise("unanswered").alias("status"), F.array_join(errors, "; ").alias("errors"), record.alias("record"))
