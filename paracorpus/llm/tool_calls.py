"""Link tool calls with their results, order them, check their arguments, write canonical JSON."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from paracorpus.llm.common import pin

#: Kinds of arguments, by the type names that Spark gives to parsed JSON values.
KINDS = {
    "string": r"^STRING$",
    "integer": r"^(BIGINT|DECIMAL\(\d+,0\))$",
    "number": r"^(BIGINT|DECIMAL\(.*\)|DOUBLE)$",
    "boolean": r"^BOOLEAN$",
    "array": r"^ARRAY<.*>$",
    "object": r"^OBJECT<.*>$",
}
#: tool -> argument -> (kind, required)
Schemas = Mapping[str, Mapping[str, tuple[str, bool]]]


def json_string(value: Column) -> Column:
    """A string as a JSON string; null as null."""
    wrapped = F.to_json(F.array(value))
    return F.when(value.isNull(), F.lit("null")).otherwise(wrapped.substr(F.lit(2), F.length(wrapped) - 2))


def canonical_json(text: Column) -> Column:
    """Keys sorted at every level, no white space; null for what is not JSON or repeats a key."""
    return F.to_json(F.try_parse_json(text))


def argument_errors(name: Column, arguments: Column, schemas: Schemas) -> Column:
    """Sorted codes: bad_json, not_object, unknown_tool, missing:x, kind:x, unknown:x.

    One case per tool; the schemas are a small catalogue that is read with the query.
    """
    parsed = F.try_parse_json(arguments)
    none = F.array().cast("array<string>")
    by_tool = F.array(F.lit("unknown_tool"))
    for tool, fields in schemas.items():
        found = []
        for field, (kind, required) in fields.items():
            value = F.try_variant_get(parsed, f"$['{field}']", "variant")
            absent = F.array(F.lit(f"missing:{field}")) if required else none
            wrong = ~F.schema_of_variant(value).rlike(KINDS[kind])
            found.append(
                F.when(value.isNull(), absent).when(wrong, F.array(F.lit(f"kind:{field}"))).otherwise(none)
            )
        extra = F.array_except(F.json_object_keys(arguments), F.array(*map(F.lit, fields)).cast("array<string>"))
        found.append(F.transform(extra, lambda x: F.concat(F.lit("unknown:"), x)))
        by_tool = F.when(name == tool, F.array_sort(F.concat(*found))).otherwise(by_tool)
    return (
        F.when(parsed.isNull(), F.array(F.lit("bad_json")))
        .when(~F.schema_of_variant(parsed).startswith("OBJECT"), F.array(F.lit("not_object")))
        .otherwise(by_tool)
    )


def call_levels(calls: DataFrame) -> DataFrame:
    """conv_id, call_id, level, ordered from conv_id, call_id, parent_id (unique, non-null ids).

    A call comes after the call whose result it uses, its parent: level 0 has no parent among the
    calls, every other call is one level below its parent. Each round replaces a call's link by its
    parent's link, so the known distance doubles: a chain of n calls takes log2(n) rounds, each one
    equi-join of narrow rows. A round that settles no call leaves only calls on or behind a cycle;
    their level is null.
    """
    keys = calls.select("conv_id", "call_id")
    known = keys.withColumnRenamed("call_id", "parent_id").withColumn("_known", F.lit(True))
    nodes = pin(
        calls.select("conv_id", "call_id", "parent_id")
        .join(known, ["conv_id", "parent_id"], "left")
        .select("conv_id", "call_id", F.when(F.col("_known"), F.col("parent_id")).alias("link"))
        .withColumn("level", F.col("link").isNotNull().cast("long")),
        "calls",
    )
    left = nodes.where("link is not null").count()
    while left:
        above = nodes.select(
            "conv_id", F.col("call_id").alias("link"), F.col("link").alias("_link"), F.col("level").alias("_level")
        )
        # Settled calls have no link and so match nothing; the left join keeps them as they are.
        nodes = pin(
            nodes.join(above, ["conv_id", "link"], "left").select(
                "conv_id", "call_id", F.col("_link").alias("link"),
                (F.col("level") + F.coalesce("_level", F.lit(0))).alias("level"),
            ),
            "calls",
        )
        now = nodes.where("link is not null").count()
        if now == left:
            break
        left = now
    return nodes.select("conv_id", "call_id", F.when(F.col("link").isNull(), F.col("level")).alias("level"))


def link_tool_calls(calls: DataFrame, results: DataFrame, schemas: Schemas) -> DataFrame:
    """One row per call and result, and per call or result without the other.

    `calls`: conv_id, call_id, turn, name, arguments (JSON), parent_id; `results`: conv_id, call_id,
    turn, content. Columns out: conv_id, call_id, name, level, call_turn, result_turn, status,
    errors, record. (level, call_turn, call_id) is a topological order of a conversation.

    Calls and results are joined by a hash of (conv_id, call_id). Of calls that repeat an
    identifier the one with the smallest (turn, name, arguments) is linked, the others are returned
    as `duplicate`. Several results of one call give a row each. A result before its call is
    `early`; a call without a result is `unanswered`, a result without a call `orphan`, a call on or
    behind a cycle of parents `cycle`, one whose arguments break its schema `invalid`, all others
    are `ok`; the first that applies counts, in the order duplicate, orphan, cycle, invalid,
    unanswered, early. Rows with a null conv_id or call_id are never linked. Nulls are written as
    null. Repeated results stay repeated. Empty inputs give no rows; other columns are ignored.
    """
    result = results.select("conv_id", "call_id", F.col("turn").alias("result_turn"), "content", F.lit(True).alias("_result"))
    order = W.partitionBy("conv_id", "call_id").orderBy(
        F.col("turn").asc_nulls_last(), F.col("name").asc_nulls_last(), F.col("arguments").asc_nulls_last()
    )
    named = calls.select("conv_id", "call_id", "turn", "name", "arguments", "parent_id").where("conv_id is not null and call_id is not null")
    nameless = calls.where("conv_id is null or call_id is null").select("conv_id", "call_id", "turn", "name", "arguments")
    # Rows that share an identifier are copies of one call; the rank limit combines them before the shuffle.
    first = named.withColumn("_rank", F.row_number().over(order)).where("_rank = 1").drop("_rank")
    repeats = named.withColumn("_rank", F.row_number().over(order)).where("_rank > 1")
    levels = call_levels(first)
    linked = (
        first.join(levels, ["conv_id", "call_id"])
        .select("conv_id", "call_id", F.col("turn").alias("call_turn"), "name", "arguments", "level", F.lit("call").alias("_call"))
        .hint("shuffle_hash")
        .join(result, ["conv_id", "call_id"], "full_outer")
    )
    apart = [
        x.select("conv_id", "call_id", F.col("turn").alias("call_turn"), "name", "arguments", F.lit(kind).alias("_call"))
        for x, kind in ((repeats, "repeat"), (nameless, "call"))
    ]
    rows = linked.unionByName(apart[0], allowMissingColumns=True).unionByName(apart[1], allowMissingColumns=True)
    errors = F.when(F.col("_call").isNull(), F.array().cast("array<string>")).otherwise(
        argument_errors(F.col("name"), F.col("arguments"), schemas)
    )
    rows = rows.withColumn("errors", errors)
    cyclic = F.col("level").isNull() & F.col("conv_id").isNotNull() & F.col("call_id").isNotNull()
    status = (
        F.when(F.col("_call") == "repeat", "duplicate")
        .when(F.col("_call").isNull(), "orphan")
        .when(cyclic, "cycle")
        .when(F.size("errors") > 0, "invalid")
        .when(F.col("_result").isNull(), "unanswered")
        .when(F.col("result_turn") < F.col("call_turn"), "early")
        .otherwise("ok")
    )
    arguments = F.coalesce(canonical_json(F.col("arguments")), F.lit("null"))
    # Keys in code point order, like those inside the arguments.
    record = F.concat(
        F.lit('{"arguments":'), arguments, F.lit(',"call_id":'), json_string(F.col("call_id").cast("string")),
        F.lit(',"name":'), json_string(F.col("name")), F.lit(',"result":'), json_string(F.col("content")), F.lit("}"),
    )
    return rows.select(
        "conv_id", "call_id", "name", "level", "call_turn", "result_turn",
        status.alias("status"), F.concat_ws(",", "errors").alias("errors"), record.alias("record"),
    )
