"""Tool-call linking: calls and results by identifier, ordered, validated, canonical.

``link_calls`` joins calls and results by (conversation, call) id, orders calls
behind the calls they build on, checks arguments against schemas and writes each
linked call as canonical JSON (sorted keys, no white space). DataFrame
functions only.

The order is the number of ancestors of a call. It is found by pointer doubling:
in round k every call knows its ancestor 2^k steps up, so a conversation of n
calls takes log2(n) joins and never has to be gathered in one task. Calls whose
ancestors form a cycle get a null level.

Rows: calls without an id stay, unlinked and invalid. Repeated calls of an id
are one call (the smallest by content) with the problem ``repeated``; of repeated
results the smallest counts. A parent that does not exist makes the call a root
with the problem ``no_parent``. Arguments that are no JSON object are invalid.
Extra columns of the inputs are ignored. Empty inputs give an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foldwise.llm.common import hinted, stored

#: Schemas by tool: argument, kind, required, longest text (null: any).
TOOLS = [
    ("lookup", "query", "string", True, 60),
    ("lookup", "turn", "integer", True, None),
    ("reply", "prompt", "string", True, None),
    ("reply", "turn", "integer", True, None),
]
SCHEMA = "name string, arg string, kind string, required boolean, longest int"
#: Questions shorter than this are lookups.
SHORT = 80

#: Type names of parsed JSON values by kind.
KINDS = {
    "string": "^STRING",
    "integer": "^(BIGINT|INT|SMALLINT|TINYINT)",
    "number": "^(BIGINT|INT|SMALLINT|TINYINT|DECIMAL|DOUBLE|FLOAT)",
    "boolean": "^BOOLEAN",
    "array": "^ARRAY",
    "object": "^OBJECT",
}


def _levels(calls: DataFrame) -> DataFrame:
    """``(id, level)`` from ``(id, parent)`` where every parent is an id or null."""
    state = stored(calls.select("id", F.col("parent").alias("up"), F.col("parent").isNotNull().cast("long").alias("level")), "levels")
    total, rounds = state.count(), 0
    while state.where("up is not null").limit(1).count():
        if 2**rounds > total:  # longer than any path: a cycle
            return state.select("id", F.when(F.col("up").isNull(), F.col("level")).alias("level"))
        above = state.select(F.col("id").alias("up"), F.col("up").alias("next"), F.col("level").alias("more"))
        ahead = state.where("up is not null").join(above, "up").select("id", F.col("next").alias("up"), (F.col("level") + F.col("more")).alias("level"))
        state = stored(state.where("up is null").unionByName(ahead), "levels")
        rounds += 1
    return state.select("id", "level")


def _checked(calls: DataFrame, schemas: DataFrame) -> DataFrame:
    """``(id, problems)``: what the arguments of each call break in its tool's schema."""
    tools = schemas.groupBy("name").agg(F.collect_list(F.struct("arg", "kind", "required", "longest")).alias("args"))
    rows = calls.select("id", "name", F.try_parse_json("arguments").alias("v")).join(hinted(stored(tools, "tools"), 10_000), "name", "left")
    given = F.try_variant_get("v", "$", "map<string,variant>")
    rows = rows.select("id", "args", given.alias("given"))

    def broken(a: Column) -> Column:
        value = F.col("given")[a["arg"]]
        there = F.array_contains(F.map_keys("given"), a["arg"])
        kind = F.schema_of_variant(value)
        wrong = F.lit(False)
        for name, pattern in KINDS.items():
            wrong = wrong | ((a["kind"] == name) & ~F.coalesce(kind.rlike(pattern), F.lit(False)))
        long = F.coalesce(F.length(value.cast("string")) > a["longest"], F.lit(False))
        return (
            F.when(~there & a["required"], F.concat(F.lit("missing:"), a["arg"]))
            .when(there & wrong, F.concat(F.lit("kind:"), a["arg"]))
            .when(there & ~wrong & long, F.concat(F.lit("long:"), a["arg"]))
        )

    known = F.transform("args", lambda a: a["arg"])
    unknown = F.transform(F.array_except(F.map_keys("given"), known), lambda k: F.concat(F.lit("unknown:"), k))
    problems = (
        F.when(F.col("args").isNull(), F.array(F.lit("no_tool")))
        .when(F.col("given").isNull(), F.array(F.lit("no_object")))
        .otherwise(F.concat(F.array_compact(F.transform("args", broken)), unknown))
    )
    return rows.select("id", F.array_sort(problems).alias("problems"))


def link_calls(calls: DataFrame, results: DataFrame, schemas: DataFrame) -> DataFrame:
    """One row per call of ``calls(conv_id, call_id, parent_id, name, arguments)``.

    ``results(conv_id, call_id, content)``; ``schemas`` as SCHEMA. Gives
    ``conv_id, call_id, parent_id, name, level, n_results, valid, problems, record``.
    """
    fields = ["parent_id", "name", "arguments"]
    named = calls.where("conv_id is not null and call_id is not null")
    one = named.groupBy("conv_id", "call_id").agg(F.min(F.struct(*fields)).alias("c"), F.count("*").alias("times"))
    one = stored(one.select(F.struct("conv_id", "call_id").alias("id"), "conv_id", "call_id", *[F.col(f"c.{f}").alias(f) for f in fields], "times"), "calls")
    parents = one.select("conv_id", F.col("call_id").alias("parent_id"), F.col("id").alias("parent"))
    linked = stored(one.join(parents, ["conv_id", "parent_id"], "left"), "linked")
    answers = (
        results.where("conv_id is not null and call_id is not null")
        .groupBy(F.struct("conv_id", "call_id").alias("id"))
        .agg(F.count("*").alias("n_results"), F.min("content").alias("content"))
    )
    levels, checks = _levels(linked), _checked(linked, schemas)
    full = linked.join(levels, "id").join(checks, "id").join(answers, "id", "left")
    more = F.array_compact(
        F.array(
            F.when(F.col("times") > 1, F.lit("repeated")),
            F.when(F.col("parent_id").isNotNull() & F.col("parent").isNull(), F.lit("no_parent")),
            F.when(F.col("level").isNull(), F.lit("cycle")),
            F.when(F.col("n_results").isNull(), F.lit("no_result")),
        )
    )
    problems = F.concat("problems", more)
    record = F.to_json(
        F.struct(
            F.coalesce(F.try_parse_json("arguments"), F.parse_json(F.lit("null"))).alias("arguments"),
            F.col("call_id"),
            F.col("conv_id"),
            F.col("level"),
            F.col("name"),
            F.col("content").alias("result"),
        ),
        {"ignoreNullFields": "false"},
    )
    out = ["conv_id", "call_id", "parent_id", "name", "level", "n_results", "valid", "problems", "record"]
    whole = full.select(
        "conv_id",
        "call_id",
        "parent_id",
        "name",
        "level",
        F.coalesce("n_results", F.lit(0)).cast("long").alias("n_results"),
        (F.size(F.filter(problems, lambda p: ~p.isin("no_result", "no_parent"))) == 0).alias("valid"),
        F.array_join(problems, ",").alias("problems"),
        record.alias("record"),
    )
    lost = calls.where("conv_id is null or call_id is null").select(
        "conv_id",
        "call_id",
        "parent_id",
        "name",
        F.lit(None).cast("long").alias("level"),
        F.lit(0).cast("long").alias("n_results"),
        F.lit(False).alias("valid"),
        F.lit("no_id").alias("problems"),
        F.lit(None).cast("string").alias("record"),
    )
    return whole.select(*out).unionByName(lost)


def calls_of(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Questions as calls and answers as results, from ``conversations(conv_id, turn, role, text)``.

    A user's turn calls a tool and builds on the user's turn before it; the
    assistant's next turn is its result. All by turn number, without sorting.
    """
    name = F.when(F.length("text") < SHORT, F.lit("lookup")).otherwise(F.lit("reply"))
    short = F.to_json(F.struct(F.col("turn"), F.col("text").alias("query")))
    long = F.to_json(F.struct(F.col("turn"), F.col("text").alias("prompt")))
    at = lambda shift: F.concat(F.lit("call"), (F.col("turn") + shift).cast("string"))
    calls = conversations.where("role = 'user'").select(
        F.col("conv_id").cast("string").alias("conv_id"),
        at(0).alias("call_id"),
        F.when(F.col("turn") >= 2, at(-2)).alias("parent_id"),
        name.alias("name"),
        F.when(F.length("text") < SHORT, short).otherwise(long).alias("arguments"),
    )
    results = conversations.where("role = 'assistant'").select(F.col("conv_id").cast("string").alias("conv_id"), at(-1).alias("call_id"), F.col("text").alias("content"))
    return calls, results


def schemas(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(TOOLS, SCHEMA)


def tool_records(spark: SparkSession, conversations: DataFrame) -> DataFrame:
    calls, results = calls_of(conversations)
    return link_calls(calls, results, schemas(spark))


ORACLE = f"""
WITH RECURSIVE calls AS (
  SELECT CAST(conv_id AS VARCHAR) AS conv_id, 'call' || turn AS call_id,
         CASE WHEN turn >= 2 THEN 'call' || (turn - 2) END AS parent_id,
         CASE WHEN length(text) < {SHORT} THEN 'lookup' ELSE 'reply' END AS name, text, turn,
         count(*) OVER (PARTITION BY conv_id, turn) AS times,
         row_number() OVER (PARTITION BY conv_id, turn ORDER BY CASE WHEN length(text) < {SHORT} THEN 0 ELSE 1 END, text) AS nth
  FROM conversations WHERE role = 'user'
), one AS (SELECT * FROM calls WHERE nth = 1
), answers AS (
  SELECT CAST(conv_id AS VARCHAR) AS conv_id, 'call' || (turn - 1) AS call_id, count(*) AS n_results, min(text) AS content
  FROM conversations WHERE role = 'assistant' GROUP BY 1, 2
), levels AS (
  SELECT o.conv_id, o.call_id, 0 AS level FROM one o
  WHERE NOT EXISTS (SELECT 1 FROM one p WHERE p.conv_id = o.conv_id AND p.call_id = o.parent_id)
  UNION ALL
  SELECT o.conv_id, o.call_id, l.level + 1 FROM one o JOIN levels l ON l.conv_id = o.conv_id AND l.call_id = o.parent_id
), joined AS (
  SELECT o.*, l.level, coalesce(a.n_results, 0) AS n_results, a.content,
         EXISTS (SELECT 1 FROM one p WHERE p.conv_id = o.conv_id AND p.call_id = o.parent_id) AS has_parent
  FROM one o JOIN levels l USING (conv_id, call_id) LEFT JOIN answers a USING (conv_id, call_id)
)
SELECT conv_id, call_id, parent_id, name, CAST(level AS BIGINT) AS level, CAST(n_results AS BIGINT) AS n_results,
  NOT (name = 'lookup' AND length(text) > 60) AND times = 1 AS valid,
  concat_ws(',', CASE WHEN name = 'lookup' AND length(text) > 60 THEN 'long:query' END, CASE WHEN times > 1 THEN 'repeated' END,
    CASE WHEN parent_id IS NOT NULL AND NOT has_parent THEN 'no_parent' END, CASE WHEN n_results = 0 THEN 'no_result' END) AS problems,
  CAST(CASE WHEN name = 'lookup' THEN to_json({{'arguments': {{'query': text, 'turn': turn}}, 'call_id': call_id, 'conv_id': conv_id, 'level': level, 'name': name, 'result': content}})
       ELSE to_json({{'arguments': {{'prompt': text, 'turn': turn}}, 'call_id': call_id, 'conv_id': conv_id, 'level': level, 'name': name, 'result': content}}) END AS VARCHAR) AS record
FROM joined
"""
