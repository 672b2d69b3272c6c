"""Link tool calls with their results, order and validate them, and write canonical JSON.

Calls and results meet in a hash join on their identifier. A call may name calls whose results
it uses (``after``). Chains of calls with one prerequisite are followed by pointers, twice as
far per round; calls with several are peeled, those first whose prerequisites are settled. Both
give the depth of every call, and depth orders a conversation topologically. Arguments are
checked against the schema of their tool. Canonical JSON has sorted keys and no white space.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from refracta.operators.ordered import row_numbers
from refracta.session import cut_lineage

#: tool -> field -> (type, required); types: string, integer, number, boolean, array, object
Schemas = Mapping[str, Mapping[str, tuple[str, bool]]]


def _key(call: Column) -> Column:
    """Conversation and identifier as one text; NULL, and so never linked, without identifier."""
    return F.when(call.isNotNull(), F.to_json(F.struct("conv_id", call.alias("call_id"))))


def _kind(value: Column) -> Column:
    """The schema type of a parsed value."""
    kind = F.schema_of_variant(value)
    return (
        F.when(kind == "BIGINT", "integer")
        .when(kind.startswith("DECIMAL") | (kind == "DOUBLE"), "number")
        .when(kind.startswith("ARRAY"), "array")
        .when(kind.startswith("OBJECT"), "object")
        .otherwise(F.lower(kind))
    )


def _rules(schemas: Schemas) -> Column:
    """The fields of the row's tool, in order; NULL for an unknown tool."""
    kind = "array<struct<field:string,type:string,required:boolean>>"
    rows = []
    for tool, fields in sorted(schemas.items()):
        entries = [F.struct(F.lit(f), F.lit(t), F.lit(r)) for f, (t, r) in sorted(fields.items())]
        rows += [F.lit(tool), F.array(*entries).cast(kind)]
    return F.create_map(*rows)[F.col("name")] if rows else F.lit(None).cast(kind)


def argument_errors(schemas: Schemas) -> Column:
    """Sorted errors of a call's parsed ``fields`` (map of variants) under its tool's schema."""
    rules, fields = F.col("rules"), F.col("fields")
    none = F.array().cast("array<string>")

    def judged(rule: Column) -> Column:
        kind = _kind(fields[rule["field"]])
        fits = (kind == rule["type"]) | ((rule["type"] == "number") & (kind == "integer"))
        absent = ~F.map_contains_key(fields, rule["field"])
        return (
            F.when(absent & rule["required"], F.concat(F.lit("missing:"), rule["field"]))
            .when(~absent & ~F.coalesce(fits, F.lit(False)), F.concat(F.lit("type:"), rule["field"]))
        )

    known = F.transform(rules, lambda r: r["field"])
    unknown = F.transform(
        F.filter(F.map_keys(fields), lambda k: ~F.array_contains(known, k)), lambda k: F.concat(F.lit("unknown:"), k)
    )
    of_fields = F.concat(F.filter(F.transform(rules, judged), lambda e: e.isNotNull()), unknown)
    return F.array_sort(
        F.when(rules.isNull(), F.array(F.lit("tool")))
        .when(F.col("parsed").isNull(), F.array(F.lit("malformed")))
        .when(fields.isNull(), F.array(F.lit("not_object")))
        .otherwise(F.coalesce(of_fields, none))
    )


def _chains(nodes: DataFrame) -> DataFrame:
    """(key, at, depth, endless) over the pointers ``to``: the last node that pointers lead to
    and its distance; ``endless`` on and behind a cycle of pointers.

    Each round doubles how far a pointer reaches, so the rounds are the logarithm of the
    longest chain. What still points on when every chain must have ended is cyclic.
    """
    state = cut_lineage(
        nodes.select("key", "to", F.coalesce("to", "key").alias("at"), F.col("to").isNotNull().cast("int").alias("depth"))
    )
    reach, rows = 1, state.count()
    while reach <= rows and state.filter("to IS NOT NULL").limit(1).count():
        ahead = state.select(
            F.col("key").alias("to"), F.col("to").alias("next"), F.col("at").alias("end"), F.col("depth").alias("more")
        )
        state = cut_lineage(
            state.join(ahead, "to", "left").select(
                "key", F.col("next").alias("to"), F.coalesce("end", "at").alias("at"),
                (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth"),
            )
        )
        reach *= 2
    return state.select("key", "at", "depth", F.col("to").isNotNull().alias("endless"))


def _peeled(edges: DataFrame) -> DataFrame:
    """(key, depth) of the nodes with several prerequisites, without those on or behind a cycle.

    ``edges`` says per prerequisite at which node it ends (``at``, NULL when that needs
    nothing), after how many steps, and whether it is ``endless``. A round settles the nodes
    all of whose ends are settled, so there are as many rounds as such nodes in a row.
    """
    settled, known = None, 0
    while True:
        if settled is None:
            seen = edges.withColumn("below", F.lit(0))
        else:
            seen = edges.join(settled.select(F.col("key").alias("at"), F.col("depth").alias("below")), "at", "left")
        open_end = F.col("endless") | (F.col("at").isNotNull() & (F.col("below").isNull() if settled is not None else F.lit(True)))
        ready = seen.groupBy("key").agg(
            F.max(F.col("steps") + F.coalesce("below", F.lit(0))).alias("depth"), F.bool_or(open_end).alias("open")
        )
        settled = cut_lineage(ready.filter("NOT open").select("key", "depth"))
        count = settled.count()
        if count == known:
            return settled
        known = count


def _depths(nodes: DataFrame) -> DataFrame:
    """(key, depth) from the keys of each node's prerequisites, ``parents``: the longest way to a
    node that needs none, NULL on and behind a cycle. Prerequisites that are no node are ignored.
    """
    keys = nodes.select(F.col("key").alias("parent"))
    edges = cut_lineage(nodes.select("key", F.explode("parents").alias("parent")).join(keys, "parent", "left_semi"))
    counts = edges.groupBy("key").agg(F.count(F.lit(1)).alias("needs"), F.min("parent").alias("one"))
    needs = cut_lineage(nodes.select("key").join(counts, "key", "left"))
    chains = _chains(needs.select("key", F.when(F.col("needs") == 1, F.col("one")).alias("to")))
    several = needs.filter("needs > 1").select("key")
    if not several.limit(1).count():
        return chains.select("key", F.when(~F.col("endless"), F.col("depth")).alias("depth"))
    ends = cut_lineage(
        chains.join(several.select(F.col("key").alias("at"), F.lit(True).alias("joins")), "at", "left").select(
            "key", F.when(F.col("joins"), F.col("at")).alias("at"), "depth", "endless"
        )
    )
    of_parent = ends.select(F.col("key").alias("parent"), "at", (F.col("depth") + 1).alias("steps"), "endless")
    settled = _peeled(cut_lineage(edges.join(several, "key", "left_semi").join(of_parent, "parent").drop("parent")))
    below = settled.select(F.col("key").alias("at"), F.col("depth").alias("below"))
    reached = F.col("at").isNull() | F.col("below").isNotNull()
    return ends.join(below, "at", "left").select(
        "key", F.when(~F.col("endless") & reached, F.col("depth") + F.coalesce("below", F.lit(0))).alias("depth")
    )


def linked(calls: DataFrame, results: DataFrame, schemas: Schemas, messages: DataFrame | None = None) -> DataFrame:
    """One row per call, one per result identifier without a call, and one per message.

    calls     conv_id, turn, call_id, name, arguments (JSON text), after (a call_id, or an array
              of them; NULL for none)
    results   conv_id, turn, call_id, content
    messages  conv_id, turn, role, content: turns that are neither

    position   place in the conversation, from 1: by depth, then turn, then identifier;
               cyclic calls, then orphans and then messages come last
    status     ok, invalid (see ``errors``), unanswered, cycle, duplicate, orphan or message
    depth      the longest chain of calls that must come before; NULL for any other status
               than ok, invalid and unanswered, and on and behind a cycle
    errors     comma-joined: malformed, not_object, tool, missing:f, type:f, unknown:f
    n_results  results with the identifier; the first by turn, then content is the one linked
    json       canonical JSON of the call and its result, or of the message

    Of calls that share conversation and identifier the first by turn is linked, the others
    are duplicates. NULL identifiers link to nothing; a NULL conversation is one of its own.
    An ``after`` that names no call of the conversation is ignored. Other columns are
    ignored, whatever their names. Empty tables are fine on either side. A conversation or
    identifier may hold any share of the rows: results and first calls are reduced before the
    join, and positions are numbered by range.
    """
    after = F.col("after") if dict(calls.dtypes)["after"].startswith("array") else F.array("after")
    parents = F.transform(F.array_distinct(F.array_compact(after)), _key)
    told = cut_lineage(
        calls.select(
            "conv_id", F.col("turn").cast("bigint").alias("turn"), "call_id", "name", "arguments",
            _key(F.col("call_id")).alias("key"), parents.alias("parents"),
            F.monotonically_increasing_id().alias("row"),
        )
    )
    firsts = cut_lineage(told.groupBy("key").agg(F.min(F.struct("turn", "row")).alias("first")))
    named = told.join(firsts.withColumnRenamed("key", "of"), F.col("key") == F.col("of"), "left").drop("of")
    named = named.withColumn("linkable", F.coalesce(F.col("row") == F.col("first.row"), F.lit(True)))
    nodes = named.filter("linkable AND key IS NOT NULL").select("key", "parents")
    depths = _depths(nodes)
    answers = cut_lineage(
        results.select("conv_id", F.col("turn").cast("bigint").alias("turn"), "call_id", "content", _key(F.col("call_id")).alias("key"))
        .groupBy("conv_id", "call_id", "key")
        .agg(F.min(F.struct("turn", "content")).alias("answer"), F.count(F.lit(1)).alias("n_results"))
    )
    parsed = F.try_parse_json("arguments")
    checked = (
        named.join(depths, "key", "left")
        .join(answers.select("key", "answer", "n_results").hint("shuffle_hash"), "key", "left")
        .withColumns({"parsed": parsed, "rules": _rules(schemas)})
        .withColumn("fields", F.try_variant_get("parsed", "$", "map<string,variant>"))
        .withColumn("errors", argument_errors(schemas))
    )
    used = F.col("linkable")
    depth = F.when(used, F.when(F.col("key").isNull(), F.lit(0)).otherwise(F.col("depth")))
    status = (
        F.when(~used, "duplicate")
        .when(F.col("key").isNotNull() & F.col("depth").isNull(), "cycle")
        .when(F.size("errors") > 0, "invalid")
        .when(F.col("answer").isNull(), "unanswered")
        .otherwise("ok")
    )
    result = F.when(used, F.col("answer.content"))
    canonical = F.to_json(
        F.struct(
            F.col("parsed").alias("arguments"), "errors", F.col("call_id").alias("id"), "name", result.alias("result")
        ),
        {"ignoreNullFields": "false"},
    )
    of_calls = checked.select(
        "conv_id", "turn", "call_id", status.alias("status"), depth.cast("bigint").alias("depth"),
        F.array_join("errors", ",").alias("errors"),
        F.when(used, F.coalesce("n_results", F.lit(0))).otherwise(F.lit(0)).cast("bigint").alias("n_results"),
        canonical.alias("json"),
    )
    lone = answers.join(firsts.select("key"), "key", "left_anti")
    no_arguments = F.lit(None).cast("string")
    orphans = lone.select(
        "conv_id", F.col("answer.turn").alias("turn"), "call_id", F.lit("orphan").alias("status"),
        F.lit(None).cast("bigint").alias("depth"), F.lit("").alias("errors"), "n_results",
        F.to_json(
            F.struct(
                no_arguments.alias("arguments"), F.array().cast("array<string>").alias("errors"),
                F.col("call_id").alias("id"), no_arguments.alias("name"), F.col("answer.content").alias("result"),
            ),
            {"ignoreNullFields": "false"},
        ).alias("json"),
    )
    rows = of_calls.unionByName(orphans)
    if messages is not None:
        said = F.to_json(F.struct("content", "role"), {"ignoreNullFields": "false"})
        rows = rows.unionByName(
            messages.select(
                "conv_id", F.col("turn").cast("bigint").alias("turn"), F.lit(None).cast("string").alias("call_id"),
                F.lit("message").alias("status"), F.lit(None).cast("bigint").alias("depth"), F.lit("").alias("errors"),
                F.lit(0).cast("bigint").alias("n_results"), said.alias("json"),
            )
        )
    lasts = F.when(F.col("status") == "message", 3).when(F.col("status") == "orphan", 2)
    rows = rows.withColumn("last", lasts.otherwise(F.col("depth").isNull().cast("int")))
    order = ["last", "depth", "turn", "call_id", "json"]
    placed = row_numbers(rows, order, "position", ["conv_id"])
    return placed.select(
        "conv_id", F.col("position").cast("bigint").alias("position"), "turn", "call_id", "status", "depth", "errors", "n_results", "json"
    )
