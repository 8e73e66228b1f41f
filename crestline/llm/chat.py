"""Chat formatting: tool calls linked to their results, ordered by dependency, validated and serialised.

All steps are DataFrame functions.  Calls and results meet in a hash join on (conversation, identifier, occurrence).
Depth along dependencies comes from pointer jumping, so a chain of n calls takes about log n rounds; each round is a
written table.  JSON goes through the variant type, which keeps object keys sorted, so equal values have equal text.

Defined cases: a call without a result keeps null there, a result without a call is listed as an orphan; the k-th call
of a repeated identifier goes with its k-th result; a dependency on an unknown call counts as met; calls on a cycle have
no depth; arguments that are no JSON object fail with one error; null conversations or identifiers link to nothing;
empty tables give no rows.  Extra columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from crestline.llm.common import read
from crestline.session import stage

#: Argument schemas: tool, field, JSON type as Spark names it, and whether the field must be there.
SCHEMA = "name string, field string, kind string, required boolean"
REPLY_SCHEMA = [("reply", "prompt", "STRING", True), ("reply", "role", "STRING", True), ("reply", "turn", "BIGINT", True)]


def _occurrence(rows: DataFrame, at: str) -> DataFrame:
    """Number the rows of a repeated (conv_id, call_id) by their place."""
    return rows.withColumn("nth", F.row_number().over(Window.partitionBy("conv_id", "call_id", "spread").orderBy(at)))


def link(calls: DataFrame, results: DataFrame) -> DataFrame:
    """Full hash join of calls (conv_id, call_id, turn, ...) and results (conv_id, call_id, result_turn, content).

    A row without conversation or identifier takes part under its own turn and finds no partner.
    """
    known = F.col("conv_id").isNotNull() & F.col("call_id").isNotNull()
    left = _occurrence(calls.withColumn("spread", F.when(known, F.lit(-1)).otherwise(F.col("turn"))), "turn")
    right = _occurrence(results.withColumn("spread", F.when(known, F.lit(-1)).otherwise(F.col("result_turn"))), "result_turn")
    return left.join(right.hint("shuffle_hash"), ["conv_id", "call_id", "nth"], "full_outer").drop("spread")


def depths(calls: DataFrame) -> DataFrame:
    """(conv_id, call_id, depth): 0 for a call that waits for none, else one more than its deepest dependency.

    ``calls`` has conv_id, call_id and after, the identifiers it waits for.  A call with one open dependency points at
    it and jumps to where that points; a call with several waits until all have a depth.
    """
    nodes = calls.where(F.col("conv_id").isNotNull() & F.col("call_id").isNotNull())
    nodes = stage(nodes.groupBy("conv_id", "call_id").agg(F.array_distinct(F.flatten(F.collect_set("after"))).alias("after")), "calls")
    wants = nodes.select("conv_id", "call_id", F.explode("after").alias("to"))
    exists = nodes.select("conv_id", F.col("call_id").alias("to"))
    edges = stage(wants.join(exists, ["conv_id", "to"], "left_semi").select("conv_id", "call_id", "to", F.lit(1).alias("far")), "waits")
    done = stage(nodes.join(edges, ["conv_id", "call_id"], "left_anti").select("conv_id", "call_id", F.lit(0).alias("depth")), "depths")
    while not edges.isEmpty():
        met = done.select("conv_id", F.col("call_id").alias("to"), "depth")
        tried = edges.join(met, ["conv_id", "to"], "left")
        ready = tried.groupBy("conv_id", "call_id").agg(
            F.count(F.lit(1)).alias("n"), F.count("depth").alias("known"), F.max(F.col("depth") + F.col("far")).alias("depth")
        )
        fresh = stage(ready.where("n = known").select("conv_id", "call_id", F.col("depth").cast("int").alias("depth")), "depths")
        if fresh.isEmpty():
            break
        open_edges = edges.join(fresh, ["conv_id", "call_id"], "left_anti")
        lone = open_edges.groupBy("conv_id", "call_id").agg(F.count(F.lit(1)).alias("n"), F.first("to").alias("next"), F.first("far").alias("more"))
        jump = lone.where("n = 1").select("conv_id", F.col("call_id").alias("to"), "next", "more")
        moved = open_edges.join(jump, ["conv_id", "to"], "left").select(
            "conv_id", "call_id", F.coalesce("next", "to").alias("to"), (F.col("far") + F.coalesce("more", F.lit(0))).alias("far")
        )
        # of several ways to one call the longest counts
        edges = stage(moved.groupBy("conv_id", "call_id", "to").agg(F.max("far").alias("far")), "waits")
        done = stage(done.unionByName(fresh), "depths")
    return done


def validate(calls: DataFrame, schemas: DataFrame) -> DataFrame:
    """``calls`` with errors: sorted, comma-joined; empty if the arguments fit the tool's schema."""
    rules = schemas.groupBy("name").agg(F.collect_list(F.struct("field", "kind", "required")).alias("rules"))
    value = F.try_parse_json("arguments")
    keys = F.json_object_keys("arguments")
    path = lambda field: F.concat(F.lit("$['"), field, F.lit("']"))
    kind = lambda field: F.schema_of_variant(F.try_variant_get(value, path(field), "variant"))

    def check(rule: Column) -> Column:
        there = F.array_contains(keys, rule["field"])
        wrong = there & (F.coalesce(kind(rule["field"]), F.lit("VOID")) != rule["kind"])
        return F.when(~there & rule["required"], F.concat(F.lit("missing:"), rule["field"])).when(wrong, F.concat(F.lit("type:"), rule["field"]))

    fields = F.transform("rules", lambda r: r["field"])
    found = F.concat(
        F.transform("rules", check),
        F.transform(F.filter(keys, lambda k: ~F.array_contains(fields, k)), lambda k: F.concat(F.lit("unknown:"), k)),
    )
    errors = (
        F.when(F.col("name").isNull(), F.lit(None))
        .when(F.col("rules").isNull(), F.lit("no schema"))
        .when(value.isNull() | keys.isNull(), F.lit("no object"))
        .otherwise(F.array_join(F.array_sort(F.filter(found, lambda e: e.isNotNull())), ","))
    )
    return calls.join(rules, "name", "left").withColumn("errors", errors).drop("rules")


def format_calls(calls: DataFrame, results: DataFrame, schemas: DataFrame) -> DataFrame:
    """One row per call or orphan result: conv_id, call_id, nth, turn, result_turn, depth, errors, valid, line.

    Sorted by depth, turn and identifier, the rows of a conversation are in topological order; ``line`` is the call with
    its result as canonical JSON.
    """
    linked = link(calls.select("conv_id", "call_id", "turn", "name", "arguments", "after"), results.select("conv_id", "call_id", "result_turn", "content"))
    placed = linked.join(depths(calls), ["conv_id", "call_id"], "left")
    checked = validate(placed, schemas)
    # fields in the order of their names; text that is no JSON stays a string
    arguments = F.coalesce(F.try_parse_json("arguments"), F.expr("cast(arguments AS variant)"))
    line = F.to_json(F.struct(arguments.alias("arguments"), F.col("call_id").alias("id"), "name", F.col("content").alias("result")))
    return checked.select(
        "conv_id",
        "call_id",
        "nth",
        "turn",
        "result_turn",
        F.when(F.col("turn").isNotNull(), F.col("depth")).alias("depth"),
        "errors",
        F.coalesce(F.col("errors") == "", F.lit(False)).alias("valid"),
        line.alias("line"),
    )


def reply_calls(conversations: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(calls, results, schemas) of a plain conversation: every user turn asks for a reply, every assistant turn gives it.

    A call is named by its turn and waits for the call two turns before; a result is named by the turn before it.
    """
    turns = conversations.select("conv_id", "turn", "role", "text")
    user = turns.where("role = 'user'")
    arguments = F.to_json(F.struct(F.col("turn").alias("turn"), F.col("text").alias("prompt"), F.col("role").alias("role")))
    calls = user.select(
        "conv_id",
        F.concat(F.lit("call_"), F.col("turn").cast("string")).alias("call_id"),
        "turn",
        F.lit("reply").alias("name"),
        arguments.alias("arguments"),
        F.array(F.concat(F.lit("call_"), (F.col("turn") - 2).cast("string"))).alias("after"),
    )
    results = turns.where("role = 'assistant'").select(
        "conv_id", F.concat(F.lit("call_"), (F.col("turn") - 1).cast("string")).alias("call_id"), F.col("turn").alias("result_turn"), F.col("text").alias("content")
    )
    return calls, results, conversations.sparkSession.createDataFrame(REPLY_SCHEMA, SCHEMA)


def plain_messages(conversations: DataFrame) -> DataFrame:
    """The turns that neither ask nor answer (system, other and null roles), in the columns of ``format_calls``.

    ``line`` is the turn as canonical JSON; such a turn has no identifier and nothing to validate.
    """
    line = F.to_json(F.struct(F.col("text").alias("content"), "role", "turn"))
    return conversations.where(F.coalesce(~F.col("role").isin("user", "assistant"), F.lit(True))).select(
        "conv_id",
        F.lit(None).cast("string").alias("call_id"),
        F.lit(None).cast("int").alias("nth"),
        "turn",
        F.lit(None).cast("long").alias("result_turn"),
        F.lit(None).cast("int").alias("depth"),
        F.lit(None).cast("string").alias("errors"),
        F.lit(False).alias("valid"),
        line.alias("line"),
    )


def op8_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    conversations = read(spark, sf_dir, "conversations")
    return format_calls(*reply_calls(conversations)).unionByName(plain_messages(conversations))


QUERIES = {"op8_chat_formatting": op8_chat_formatting}
ORACLE = {
    "op8_chat_formatting": """
WITH calls AS (
    SELECT conv_id, turn, text, 'call_' || turn AS call_id,
           turn // 2 - row_number() OVER (PARTITION BY conv_id, turn % 2 ORDER BY turn) AS chain
    FROM conversations WHERE role = 'user'),
placed AS (
    SELECT *, CAST(row_number() OVER (PARTITION BY conv_id, turn % 2, chain ORDER BY turn) - 1 AS INTEGER) AS depth FROM calls),
results AS (
    SELECT conv_id, turn AS result_turn, text AS content, 'call_' || (turn - 1) AS call_id
    FROM conversations WHERE role = 'assistant')
SELECT conv_id, call_id, CAST(1 AS INTEGER) AS nth, turn, result_turn, depth,
       CASE WHEN turn IS NOT NULL THEN '' END AS errors, turn IS NOT NULL AS valid,
       '{' || CASE WHEN turn IS NULL THEN '' ELSE
           '"arguments":{"prompt":' || to_json(text) || ',"role":"user","turn":' || turn || '},' END
       || '"id":"' || call_id || '"' || CASE WHEN turn IS NULL THEN '' ELSE ',"name":"reply"' END
       || CASE WHEN content IS NULL THEN '' ELSE ',"result":' || to_json(content) END || '}' AS line
FROM placed FULL JOIN results USING (conv_id, call_id)
UNION ALL
SELECT conv_id, CAST(NULL AS VARCHAR), CAST(NULL AS INTEGER), turn, CAST(NULL AS BIGINT), CAST(NULL AS INTEGER), CAST(NULL AS VARCHAR), FALSE,
       '{' || concat_ws(',', '"content":' || to_json(text), '"role":' || to_json(role), '"turn":' || turn) || '}'
FROM conversations WHERE role IS NULL OR role NOT IN ('user', 'assistant')
"""
}
