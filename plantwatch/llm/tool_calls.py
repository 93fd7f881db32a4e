"""Tool calls of chats: linked with their results, ordered by dependency, checked against schemas, written as canonical JSON.

Messages are (conv_id, turn, role, text). An assistant message may hold {"tool_calls": [{"id", "name", "arguments",
"after"}]}, with arguments as an object or as JSON text and `after` naming calls of the conversation that come first. A
message of role `tool` holds {"tool_call_id", "content"}. Everything is DataFrame functions; keys are (conv_id, id), so a
long conversation is spread over tasks.

Defined results: text that is no such JSON, or null, has no calls and no result. Calls without conversation, turn or id are
`unidentified`. Equal rows count once, `copies` says how many there were. Of several calls of one id the first by turn,
index and content is the call, the others are `duplicate`; of several results the first by turn and content is
linked and `n_results` counts them. Results without a call are rows of status `orphan_result`. Calls on or behind a
dependency cycle have status `cycle`, no level and no position. Ties in the order go by turn, index and id.
Empty tables give an empty result. Other columns are ignored. JSON with a repeated key is not an object.

Schemas are read at the top level of the arguments: type, minimum, maximum and enum of each property, required and
additionalProperties. What else a schema says (nested properties, items, patterns, lengths, a list of types) is not checked.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plantwatch.llm.common import cut_lineage

CALLS = "tool_calls array<struct<id: string, name: string, arguments: string, after: array<string>>>"
RESULT = "tool_call_id string, content string"
PARAMETERS = (
    "properties map<string, struct<type: string, minimum: double, maximum: double, enum: array<string>>>, "
    "required array<string>, additionalProperties boolean"
)
TURNS = 256  # turns of a conversation whose calls are ranked together

COLUMNS = (
    "conv_id", "turn", "call_index", "call_id", "name", "status", "level", "position", "result_turn", "n_results", "copies",
    "valid", "errors", "canonical",
)


def canonical_json(text: Column) -> Column:
    """JSON with sorted keys and no spaces; null for what is not JSON."""
    return F.to_json(F.try_parse_json(text))


def json_string(text: Column) -> Column:
    quoted = F.to_json(F.array(text))
    return F.when(text.isNull(), F.lit("null")).otherwise(F.substring(quoted, F.lit(2), F.length(quoted) - 2))


def calls_of(messages: DataFrame) -> DataFrame:
    """One row per distinct call, with the number of its copies."""
    parsed = messages.where("role = 'assistant'").select("conv_id", "turn", F.from_json("text", CALLS)["tool_calls"].alias("calls"))
    each = parsed.select("conv_id", "turn", F.posexplode("calls").alias("call_index", "call")).select(
        "conv_id", "turn", "call_index", F.col("call.id").alias("call_id"), "call.name", "call.arguments", "call.after"
    )
    return each.groupBy(*each.columns).agg(F.count("*").alias("copies"))


def results_of(messages: DataFrame) -> DataFrame:
    parsed = messages.where("role = 'tool'").select("conv_id", "turn", F.from_json("text", RESULT).alias("r"))
    rows = parsed.select("conv_id", "turn", F.col("r.tool_call_id").alias("call_id"), F.col("r.content").alias("content"))
    rows = rows.where(F.col("call_id").isNotNull())
    return rows.groupBy(*rows.columns).agg(F.count("*").alias("copies"))


def levels(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(conv_id, call_id, level): length of the longest chain of dependencies under each call; calls with a cycle are left out.

    Calls with a single dependency form chains that are followed by pointer doubling; only calls with several are then
    resolved level by level.
    """
    key = ["conv_id", "call_id"]
    count = edges.groupBy(*key).agg(F.count("*").alias("n"), F.min("dep").alias("dep"))
    all_nodes = nodes.join(count, key, "left")
    chain = all_nodes.select(*key, F.when(F.col("n") == 1, F.col("dep")).otherwise(F.col("call_id")).alias("to"), F.when(F.col("n") == 1, 1).otherwise(0).cast("long").alias("far"))
    chain = cut_lineage(chain)
    single = chain.where("far > 0").count()
    for _ in range(math.ceil(math.log2(single + 1)) + 1 if single else 0):
        ahead = chain.select("conv_id", F.col("call_id").alias("to"), F.col("to").alias("next"), F.col("far").alias("more"))
        moved = cut_lineage(chain.join(ahead, ["conv_id", "to"]).select(*key, F.col("next").alias("to"), (F.col("far") + F.col("more")).alias("far"), (F.col("more") > 0).alias("moved")))
        chain = moved.drop("moved")
        if moved.where("moved").isEmpty():
            break
    # A chain that still leads to a call with a single dependency runs in a circle.
    ends = all_nodes.where("n IS NULL OR n > 1").select("conv_id", F.col("call_id").alias("to"))
    chain = cut_lineage(chain.join(ends, ["conv_id", "to"]))
    several = all_nodes.where("n > 1").select(*key)
    known = cut_lineage(all_nodes.where("n IS NULL").select(*key, F.lit(0).cast("long").alias("level")))
    reach = chain.select("conv_id", F.col("call_id").alias("dep"), "to", "far")
    lasting = edges.join(several, key, "left_semi").join(reach, ["conv_id", "dep"], "left")
    open_edges = cut_lineage(lasting.select(*key, "to", "far"))
    while not open_edges.isEmpty():
        met = open_edges.join(known.select("conv_id", F.col("call_id").alias("to"), "level"), ["conv_id", "to"], "left")
        ready = met.groupBy(*key).agg(F.count("*").alias("all"), F.count("level").alias("met"), (F.max(F.col("level") + F.col("far")) + 1).alias("level"))
        ready = cut_lineage(ready.where(F.col("all") == F.col("met")).select(*key, "level"))
        if ready.isEmpty():
            break
        known = cut_lineage(known.unionByName(ready))
        open_edges = cut_lineage(open_edges.join(ready, key, "left_anti"))
    base = known.select("conv_id", F.col("call_id").alias("to"), F.col("level").alias("base"))
    return chain.join(base, ["conv_id", "to"]).select(*key, (F.col("base") + F.col("far")).alias("level"))


def with_position(rows: DataFrame) -> DataFrame:
    """Numbers the calls of each conversation by level, turn, index and id, from 1; counts of turn ranges are summed first."""
    part = rows.withColumn("part", F.floor(F.col("turn") / TURNS))
    inside = Window.partitionBy("conv_id", "level", "part").orderBy("turn", "call_index", "call_id")
    before = Window.partitionBy("conv_id").orderBy("level", "part").rowsBetween(Window.unboundedPreceding, -1)
    counts = part.groupBy("conv_id", "level", "part").agg(F.count("*").alias("n"))
    counts = counts.withColumn("earlier", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    ranked = part.withColumn("rank", F.row_number().over(inside)).join(counts, ["conv_id", "level", "part"])
    return ranked.withColumn("position", F.col("earlier") + F.col("rank")).drop("part", "rank", "earlier")


def _type_fits(kind: Column, wanted: Column) -> Column:
    whole = (kind == "BIGINT") | kind.rlike(r"^DECIMAL\(\d+,0\)$")
    return (
        F.when(wanted == "string", kind == "STRING").when(wanted == "integer", whole)
        .when(wanted == "number", whole | kind.startswith("DECIMAL") | kind.isin("DOUBLE", "FLOAT"))
        .when(wanted == "boolean", kind == "BOOLEAN").when(wanted == "array", kind.startswith("ARRAY"))
        .when(wanted == "object", kind.startswith("OBJECT")).when(wanted == "null", kind == "VOID").otherwise(F.lit(True))
    )


def argument_errors(arguments: Column, known_tool: Column, schema: Column) -> Column:
    """What is wrong with the arguments (JSON text) of a call, sorted and joined by commas; empty if nothing is."""
    parsed = F.try_parse_json(arguments)
    is_object = F.coalesce(F.schema_of_variant(parsed).startswith("OBJECT"), F.lit(False))
    given = F.from_json(arguments, "map<string, variant>")
    wanted = F.coalesce(schema["properties"], F.from_json(F.lit("{}"), "map<string, struct<type: string, minimum: double, maximum: double, enum: array<string>>>"))
    names, has = F.map_keys(given), F.map_keys(wanted)
    required = F.coalesce(schema["required"], F.array().cast("array<string>"))
    tagged = lambda tag, items: F.transform(items, lambda x: F.concat(F.lit(tag), x))
    both = F.array_intersect(names, has)
    value = lambda x: F.element_at(given, x)
    rule = lambda x: F.element_at(wanted, x)
    number = lambda x: F.try_variant_get(value(x), "$", "double")
    wrong_type = F.filter(both, lambda x: ~_type_fits(F.schema_of_variant(value(x)), rule(x)["type"]))
    out_of_range = F.filter(
        both, lambda x: F.coalesce(number(x) < rule(x)["minimum"], F.lit(False)) | F.coalesce(number(x) > rule(x)["maximum"], F.lit(False))
    )
    not_listed = F.filter(
        both, lambda x: F.coalesce(~F.array_contains(rule(x)["enum"], F.coalesce(F.try_variant_get(value(x), "$", "string"), F.lit(""))), F.lit(False))
    )
    unexpected = F.when(F.coalesce(schema["additionalProperties"], F.lit(True)), F.array().cast("array<string>")).otherwise(F.array_except(names, has))
    found = F.concat(
        tagged("missing:", F.array_except(required, names)), tagged("type:", wrong_type), tagged("range:", out_of_range),
        tagged("enum:", not_listed), tagged("unexpected:", unexpected),
    )
    return (
        F.when(~known_tool, F.lit("unknown_tool")).when(~is_object, F.lit("arguments_not_object")).otherwise(F.array_join(F.array_sort(found), ","))
    )


def link_tool_calls(messages: DataFrame, tools: DataFrame) -> DataFrame:
    """One row per distinct call, and one per distinct result without a call.

    `tools` has a name and a JSON schema (`parameters`) per tool; a name given twice keeps its smallest text. Calls and
    results meet by a hash join on conversation and id; schemas by a join on the name.
    """
    messages = messages.select(F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").cast("bigint").alias("turn"), "role", "text")
    key = ["conv_id", "call_id"]
    calls, results = cut_lineage(calls_of(messages)), cut_lineage(results_of(messages))
    named = F.col("conv_id").isNotNull() & F.col("turn").isNotNull() & F.col("call_id").isNotNull()
    content = F.struct("turn", "call_index", "name", "arguments", "after")
    firsts = calls.where(named).groupBy(*key).agg(F.min(content).alias("first"))
    marked = calls.where(named).join(firsts, key).withColumn("is_first", content.eqNullSafe(F.col("first"))).drop("first")
    first = cut_lineage(marked.where("is_first").drop("is_first"))

    deps = first.select(*key, F.explode(F.array_distinct("after")).alias("dep")).where(F.col("dep").isNotNull())
    nodes = first.select(*key)
    real = cut_lineage(deps.join(nodes.select("conv_id", F.col("call_id").alias("dep")), ["conv_id", "dep"], "left_semi").select(*key, "dep"))
    unknown = deps.join(real, [*key, "dep"], "left_anti").groupBy(*key).agg(F.count("*").alias("unknown"))
    placed = with_position(first.select(*key, "turn", "call_index").join(levels(nodes, real), key)).select(*key, "level", "position")

    answer = results.groupBy(*key).agg(F.min(F.struct("turn", "content")).alias("answer"), F.sum("copies").alias("n_results"))
    schemas = tools.groupBy("name").agg(F.min("parameters").alias("parameters")).withColumn("schema", F.from_json("parameters", PARAMETERS))
    schemas = schemas.select(F.col("name").alias("tool"), "schema")
    joined = first.join(placed, key, "left").join(answer, key, "left").join(unknown, key, "left")
    status = (
        F.when(F.col("level").isNull(), "cycle").when(F.col("answer").isNull(), "no_result")
        .when(F.col("answer.turn") <= F.col("turn"), "result_before_call").otherwise("ok")
    )
    blank = [F.lit(None).cast("long").alias(c) for c in ("level", "position", "result_turn", "n_results")]
    linked = joined.select(
        *key, "turn", "call_index", "name", "arguments", "copies", status.alias("status"), "level", "position", F.col("answer.turn").alias("result_turn"),
        F.coalesce("n_results", F.lit(0)).alias("n_results"), F.coalesce("unknown", F.lit(0)).alias("unknown"), F.col("answer.content").alias("content"),
    )
    rest = lambda rows, status: rows.select(
        *key, "turn", "call_index", "name", "arguments", "copies", F.lit(status).alias("status"), *blank, F.lit(0).cast("long").alias("unknown"),
        F.lit(None).cast("string").alias("content"),
    )
    every = linked.unionByName(rest(marked.where("NOT is_first"), "duplicate")).unionByName(rest(calls.where(~named), "unidentified"))

    checked = every.join(schemas, every["name"] == schemas["tool"], "left")
    errors = argument_errors(F.col("arguments"), F.col("tool").isNotNull(), F.col("schema"))
    errors = F.when(F.col("unknown") > 0, F.concat_ws(",", F.when(errors != "", errors), F.lit("unknown_dependency"))).otherwise(errors)
    is_object = F.coalesce(F.schema_of_variant(F.try_parse_json("arguments")).startswith("OBJECT"), F.lit(False))
    canonical = F.concat(
        F.lit('{"arguments":'), F.when(is_object, canonical_json(F.col("arguments"))).otherwise(F.lit("null")),
        F.lit(',"id":'), json_string(F.col("call_id")), F.lit(',"name":'), json_string(F.col("name")),
        F.lit(',"result":'), json_string(F.col("content")), F.lit("}"),
    )
    rows = checked.withColumn("errors", errors).withColumn("valid", F.col("errors") == "").withColumn("canonical", canonical)
    orphans = results.join(nodes, key, "left_anti").select(
        "conv_id", "turn", F.lit(None).cast("int").alias("call_index"), "call_id", F.lit(None).cast("string").alias("name"), F.lit("orphan_result").alias("status"),
        *blank[:2], F.col("turn").alias("result_turn"), F.lit(None).cast("long").alias("n_results"), "copies", F.lit(None).cast("boolean").alias("valid"),
        F.lit(None).cast("string").alias("errors"),
        F.concat(F.lit('{"content":'), json_string(F.col("content")), F.lit(',"tool_call_id":'), json_string(F.col("call_id")), F.lit("}")).alias("canonical"),
    )
    return rows.select(*COLUMNS).unionByName(orphans.select(*COLUMNS))
