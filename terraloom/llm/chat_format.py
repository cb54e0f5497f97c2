"""Tool-call linking and canonical chat messages, by DataFrame functions alone."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored

#: A tool's fields: JSON type and whether the field is required.
Schemas = Mapping[str, Mapping[str, tuple[str, bool]]]
#: The variant types that stand for a JSON type.
TYPES = {"string": "STRING", "integer": "BIGINT", "number": "(BIGINT|DOUBLE|FLOAT|DECIMAL.*)", "boolean": "BOOLEAN", "array": "ARRAY.*", "object": "OBJECT.*"}
#: Tools as which the turns of plain conversations are read.
TURN_SCHEMAS: Schemas = {"ask": {"text": ("string", True), "turn": ("integer", True)}, "configure": {"text": ("string", True), "turn": ("integer", True)}}


def _path(field: str) -> str:
    return "$['" + field.replace("\\", "\\\\").replace("'", "\\'") + "']"


def _complaints(args: Column, name: Column, schemas: Schemas) -> Column:
    """Sorted complaints about a call's parsed arguments (a variant; null: not JSON)."""
    every = [F.when(args.isNull(), F.lit("arguments: not JSON")), F.when(args.isNotNull() & ~F.schema_of_variant(args).startswith("OBJECT"), F.lit("arguments: not an object")), F.when(name.isNull() | ~name.isin(*schemas), F.lit("name: unknown"))]
    for tool, fields in sorted(schemas.items()):
        for field, (kind, required) in sorted(fields.items()):
            got = F.try_variant_get(args, _path(field), "variant")
            mine = (name == tool) & args.isNotNull()
            if required:
                every.append(F.when(mine & got.isNull(), F.lit(f"{field}: missing")))
            every.append(F.when(mine & got.isNotNull() & ~F.is_variant_null(got) & ~F.schema_of_variant(got).rlike(f"^{TYPES[kind]}$"), F.lit(f"{field}: not of type {kind}")))
    return F.concat_ws("; ", *every)


def call_depths(calls: DataFrame) -> DataFrame:
    """calls(call_id, parent_id) to (call_id, depth): calls before it on the way to a root, null on a cycle.

    Pointer doubling: each round joins every call with the call it points to, adds its distance and takes its pointer; so
    a chain of n calls takes log2(n) rounds, each a hash join on unique ids, however the calls spread over conversations.
    A parent that is not in calls counts as none. Of the parents of a repeated id the least counts (null only if all are).
    """
    ids = calls.groupBy("call_id").agg(F.min("parent_id").alias("parent_id"))
    known = ids.select(F.col("call_id").alias("to"))
    linked = ids.select("call_id", F.col("parent_id").alias("to")).join(known, "to", "left_semi").select("call_id", "to")
    links = ids.select("call_id").join(linked, "call_id", "left").withColumn("steps", F.when(F.col("to").isNull(), F.lit(0)).otherwise(F.lit(1)).cast("long"))
    links = stored(links, "chat-links")
    rounds = links.count().bit_length() + 1
    while rounds and links.filter("to IS NOT NULL").limit(1).count():
        after = links.select(F.col("call_id").alias("to"), F.col("to").alias("next"), F.col("steps").alias("more"))
        moved = links.filter("to IS NOT NULL").join(after, "to").select("call_id", F.col("next").alias("to"), (F.col("steps") + F.col("more")).alias("steps"))
        links = stored(links.filter("to IS NULL").unionByName(moved), "chat-links")
        rounds -= 1
    return links.select("call_id", F.when(F.col("to").isNull(), F.col("steps")).alias("depth"))


def link_tool_calls(calls: DataFrame, results: DataFrame, schemas: Schemas) -> DataFrame:
    """One row for each call and each result, in canonical JSON.

    calls(call_id, parent_id, name, arguments): parent_id is the call whose result it follows; arguments are JSON text.
    results(call_id, content). Returned: call_id, kind ('call' or 'result'), linked (the call has a result, the result a
    call), depth (a topological order: calls and results of one depth depend on none of that depth or above; null on a
    cycle and for a result without a call), valid, errors, message (keys sorted, no white space, null content empty).

    Calls and results meet in hash joins on the identifier alone, so a hot conversation spreads like any other. schemas is
    a parameter, not data: its checks become expressions. Repeated call ids: each row is kept, the id counts as one call, whose
    parent is the least of those named.
    Null ids link to nothing. Empty tables give no rows. Other columns are not read.
    """
    calls = calls.select(*(F.col(c).cast("string") for c in ("call_id", "parent_id", "name", "arguments")))
    results = results.select(*(F.col(c).cast("string") for c in ("call_id", "content")))
    args = F.try_parse_json(F.coalesce("arguments", F.lit("")))
    errors = _complaints(F.col("args"), F.col("name"), schemas)
    depth = call_depths(calls.filter("call_id IS NOT NULL"))
    answered = results.select("call_id").filter("call_id IS NOT NULL").distinct().withColumn("linked", F.lit(True))
    message = F.to_json(F.struct(F.lit("assistant").alias("role"), F.array(F.struct(F.struct(F.coalesce(F.to_json("args"), F.to_json(F.struct(F.col("arguments").alias("raw")))).alias("arguments"), F.coalesce("name", F.lit("")).alias("name")).alias("function"), F.coalesce("call_id", F.lit("")).alias("id"), F.lit("function").alias("type"))).alias("tool_calls")))
    said = calls.withColumn("args", args).withColumn("errors", errors).select("call_id", F.lit("call").alias("kind"), "errors", message.alias("message"))
    said = said.join(depth, "call_id", "left").join(answered, "call_id", "left").withColumn("linked", F.coalesce("linked", F.lit(False)))
    answer = F.to_json(F.struct(F.coalesce("content", F.lit("")).alias("content"), F.lit("tool").alias("role"), F.coalesce("call_id", F.lit("")).alias("tool_call_id")))
    told = results.select("call_id", F.lit("result").alias("kind"), answer.alias("message")).join(depth.withColumn("linked", F.lit(True)), "call_id", "left")
    told = told.withColumn("linked", F.coalesce("linked", F.lit(False))).withColumn("errors", F.when(F.col("linked"), F.lit("")).otherwise(F.lit("call: missing")))
    out = said.unionByName(told)
    return out.select("call_id", "kind", "linked", "depth", (F.col("errors") == "").alias("valid"), "errors", "message")


def turns_as_calls(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Plain turns as calls and results: a user's or system's turn calls a tool, the assistant's next turn is its result.

    The identifier holds conversation and turn; a turn's parent is the turn two before it, which is a call where roles
    alternate. Null roles and roles of other names count as the user's.
    """
    key = lambda turn: F.concat(F.lit("call_"), F.col("conv_id").cast("string"), F.lit("_"), turn.cast("string"))
    is_result = F.coalesce(F.col("role") == "assistant", F.lit(False))
    args = F.to_json(F.struct(F.coalesce(F.col("text"), F.lit("")).alias("text"), F.col("turn")))
    calls = conversations.filter(~is_result).select(key(F.col("turn")).alias("call_id"), key(F.col("turn") - 2).alias("parent_id"), F.when(F.col("role") == "system", F.lit("configure")).otherwise(F.lit("ask")).alias("name"), args.alias("arguments"))
    results = conversations.filter(is_result).select(key(F.col("turn") - 1).alias("call_id"), F.col("text").alias("content"))
    return calls, results


def chat_messages(conversations: DataFrame) -> DataFrame:
    """The linked, validated, canonical messages of a table (conv_id, turn, role, text)."""
    return link_tool_calls(*turns_as_calls(conversations), TURN_SCHEMAS)


ORACLE_SQL = r"""
WITH RECURSIVE c AS (
  SELECT 'call_' || conv_id || '_' || turn AS call_id, 'call_' || conv_id || '_' || (turn - 2) AS parent_id,
         CASE WHEN role = 'system' THEN 'configure' ELSE 'ask' END AS name, coalesce(text, '') AS text, turn
  FROM conversations WHERE coalesce(role, '') <> 'assistant'),
r AS (SELECT 'call_' || conv_id || '_' || (turn - 1) AS call_id, coalesce(text, '') AS content FROM conversations WHERE role = 'assistant'),
d AS (
  SELECT call_id, 0::BIGINT AS depth FROM c WHERE parent_id NOT IN (SELECT call_id FROM c)
  UNION ALL
  SELECT c.call_id, d.depth + 1 FROM c JOIN d ON c.parent_id = d.call_id)
SELECT c.call_id, 'call' AS kind, c.call_id IN (SELECT call_id FROM r) AS linked, d.depth, true AS valid, '' AS errors,
       json_object('role', 'assistant', 'tool_calls', json_array(json_object('function', json_object('arguments',
         json_object('text', c.text, 'turn', c.turn)::VARCHAR, 'name', c.name), 'id', c.call_id, 'type', 'function')))::VARCHAR AS message
FROM c LEFT JOIN d USING (call_id)
UNION ALL
SELECT r.call_id, 'result', d.depth IS NOT NULL, d.depth, d.depth IS NOT NULL, CASE WHEN d.depth IS NULL THEN 'call: missing' ELSE '' END,
       json_object('content', r.content, 'role', 'tool', 'tool_call_id', r.call_id)::VARCHAR
FROM r LEFT JOIN d USING (call_id)
"""
