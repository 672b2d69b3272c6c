"""Domain tables derived from the given ones, as DataFrames and as SQL subqueries.

The given tables hold no source code, so code-like texts are built from their columns
by string templates that both engines evaluate identically. Every derivation is a
projection: rows stay one to one with the table they come from.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from refracta.constants import STRATEGIES, TASKS
from refracta.functions.metrics import with_metrics
from refracta.functions.domains import domain_from_task
from refracta.session import spread
from refracta.sources.catalogue import models

NL = "\n"
LANGS = ("python", "java", "javascript", "cpp")
EXTS = (".py", ".java", ".js", ".cpp")
TOPICS = (
    "Binary search", "Linked list", "Parse text", "Prime number", "Read file", "Palindrome", "Ring",
)
PY_REP = "    if a > 0 and b < 9:\n        a = a + b\n"
C_REP = "  if (a&&b||c) { a = b; }\n"
HEADERS = ("def f", "public int f", "function f", "int f")
PARAMS = ("(a, b):", "(int a, int b) {", "(a, b) {", "(int a, int b) {")

# Seven models, m6 outside the catalogue, m5 without a price.
RUN_MODELS = ("m0", "m1", "m2", "m3", "m4", "m5", "m6")
CATALOGUE_ROWS = (
    ("tier1", "m0", "model 0", 0.0002),
    ("tier1", "m1", "model 1", 0.000125),
    ("tier1", "m2", "model 2", 0.00024),
    ("tier2", "m3", "model 3", 0.003),
    ("tier2", "m4", "model 4", 0.00175),
    ("tier3", "m5", "model 5", None),
)


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def catalogue(spark: SparkSession) -> DataFrame:
    return models(spark, CATALOGUE_ROWS)


def pick(index: Column, values) -> Column:
    """values[index] as a CASE."""
    expr = F
    for i, v in enumerate(values[:-1]):
        expr = expr.when(index == i, F.lit(v))
    return expr.otherwise(F.lit(values[-1]))


def code_text(lang_no: Column, size: Column, reps: Column, note: Column, tail: Column) -> Column:
    """A function of ``reps`` branches in the language with the given number."""
    head = F.concat(pick(lang_no, HEADERS), size.cast("string"), pick(lang_no, PARAMS), F.lit(NL))
    python = F.concat(
        head, F.lit("    # "), note, F.lit(NL), F.repeat(F.lit(PY_REP), reps), F.lit("    return a\n")
    )
    braces = F.concat(
        head, F.lit("  // "), note, F.lit(NL), F.repeat(F.lit(C_REP), reps), F.lit("  /* "), tail,
        F.lit(" */\n  return a;\n}\n"),
    )
    return F.when(lang_no == 0, python).otherwise(braces)


def corpus(spark: SparkSession, sf: str) -> DataFrame:
    """Source functions, one per part."""
    part = table(spark, sf, "part")
    n = (F.col("p_partkey") % 4).cast("int")
    size = F.col("p_size")
    return part.select(
        F.concat(F.lit("fn_"), F.col("p_partkey").cast("string")).alias("id"),
        F.col("p_partkey").alias("no"),
        pick(n, LANGS).alias("language"),
        code_text(n, size, (size % 17).cast("int"), F.col("p_name"), F.col("p_type")).alias("code"),
        F.concat(
            pick((F.col("p_partkey") % 7).cast("int"), TOPICS), F.lit(" "), F.col("p_name")
        ).alias("task_name"),
        F.when(F.col("p_partkey") % 2 == 0, "rosetta_code").otherwise("the_algorithms").alias("source"),
        (F.col("p_partkey") % 3 == 0).alias("validated"),
        F.when(F.col("p_partkey") % 5 == 0, F.concat(F.lit("old/"), F.col("p_brand")))
        .alias("test_suite_path"),
        "p_size",
    )


def functions(spark: SparkSession, sf: str, only: Column | None = None) -> DataFrame:
    """The corpus with its metrics: the ``functions`` table, or its rows that ``only`` picks."""
    rows = corpus(spark, sf) if only is None else corpus(spark, sf).filter(only)
    return with_metrics(spread(rows)).withColumn("domain", domain_from_task(F.col("task_name")))


def run_log(spark: SparkSession, sf: str) -> DataFrame:
    """Experiment results, one per line item. Natural keys repeat.

    Scores and costs are binary fractions: their sums are exact in any order, so rounding
    a mean or a total gives the same digits everywhere.
    """
    li = table(spark, sf, "lineitem")
    q = F.col("l_quantity").cast("int")
    return li.select(
        F.concat(F.lit("fn_"), F.col("l_partkey").cast("string")).alias("function_id"),
        F.concat(F.lit("m"), (F.col("l_suppkey") % 7).cast("string")).alias("model"),
        pick((F.col("l_linenumber") % 3).cast("int"), TASKS).alias("task"),
        pick((F.col("l_orderkey") % 8).cast("int"), STRATEGIES).alias("strategy"),
        F.lit(0.2).alias("temperature"),
        (q % 13).cast("double").alias("delta_cc"),
        F.when(F.col("l_returnflag") == "R", 0)
        .when((F.col("l_returnflag") == "N") & (F.col("l_linenumber") == 7), None)
        .otherwise(1)
        .alias("preservation"),
        (F.col("l_discount") * 10).alias("diversity"),
        (1.0 / (1.0 + F.col("l_extendedprice") / 1000.0)).alias("effort"),
        F.when(F.col("l_tax") == 0.08, None)
        .otherwise(F.floor(F.col("l_extendedprice") / 100).cast("double") / 8)
        .alias("se_score"),
        (F.round(F.col("l_discount") * 100).cast("int") / F.lit(1024.0)).alias("cost_usd"),
        F.when(F.col("l_linenumber") != 5, q * 20).alias("latency_ms"),
        (q * 10).alias("tokens_input"),
        (F.col("l_partkey") % 1000).cast("int").alias("tokens_output"),
        F.when(
            F.col("l_returnflag") == "R",
            pick((F.col("l_suppkey") % 3).cast("int"), ("timeout", "rate_limit", "parse_error")),
        ).alias("error_type"),
        (
            F.col("l_shipdate")
            + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), (F.col("l_orderkey") % 86400).cast("decimal(18,6)"))
        ).alias("timestamp"),
        "l_orderkey",
        "l_linenumber",
        "l_partkey",
        "l_suppkey",
        "l_extendedprice",
    )


# A total order over run_log rows.
ARRIVAL = ("timestamp", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")


def attempts(spark: SparkSession, sf: str) -> DataFrame:
    """Unscored results with code, one per order; the natural key repeats.

    The function is the customer's number, so its language follows from it.
    """
    o = table(spark, sf, "orders")
    n = (F.col("o_custkey") % 4).cast("int")
    reps = (F.floor("o_totalprice").cast("bigint") % 17).cast("int")
    return o.select(
        F.concat(F.lit("fn_"), F.col("o_custkey").cast("string")).alias("function_id"),
        F.concat(F.lit("m"), (F.col("o_orderkey") % 7).cast("string")).alias("model"),
        pick((F.col("o_orderkey") % 3).cast("int"), TASKS).alias("task"),
        pick(
            (F.substring("o_orderpriority", 1, 1).cast("int") - 1), STRATEGIES[:5]
        ).alias("strategy"),
        code_text(
            n, F.col("o_custkey") % 50, reps, F.col("o_orderpriority"), F.col("o_orderstatus")
        ).alias("transformed_code"),
        F.lit(None).cast("double").alias("se_score"),
        F.col("o_orderdate").alias("timestamp"),
        "o_orderkey",
        "o_custkey",
        reps.alias("reps"),
    )


def test_results(spark: SparkSession, sf: str) -> DataFrame:
    """Outcomes of test suites, one per label; many functions have none."""
    return table(spark, sf, "labels").select(
        F.concat(F.lit("fn_"), F.col("doc_id").cast("string")).alias("function_id"),
        F.col("quality").cast("int").alias("passed"),
        ((F.col("doc_id") * 7) % 101).cast("double").alias("coverage_pct"),
        ((F.col("doc_id") * 13) % 140).cast("int").alias("execution_time_ms"),
    )


def suites(spark: SparkSession, sf: str) -> DataFrame:
    """Generated test code, one per document: the text in a per-language frame."""
    d = table(spark, sf, "documents")
    n = (F.col("doc_id") % 4).cast("int")
    frame = pick(
        n,
        (
            "import pytest\ndef test_a():\n    assert True\n# ",
            "import org.junit.Test;\n@Test\n// ",
            "describe('x', () => {});\n// ",
            "#include <gtest/gtest.h>\nTEST(A, B) {}\n// ",
        ),
    )
    return d.select(
        F.concat(F.lit("fn_"), F.col("doc_id").cast("string")).alias("function_id"),
        pick(n, LANGS).alias("language"),
        F.when(F.col("doc_id") % 9 == 0, F.col("text"))
        .otherwise(F.concat(frame, F.replace("text", F.lit("\n"), F.lit(" "))))
        .alias("test_code"),
        "doc_id",
    )


FENCE = "```"


def responses(spark: SparkSession, sf: str) -> DataFrame:
    """Model replies, one per assistant turn, wrapped in the shapes replies take."""
    c = table(spark, sf, "conversations").filter(F.col("role") == "assistant")
    n = (F.col("conv_id") % 4).cast("int")
    kind = (F.col("conv_id") + F.col("turn")) % 7
    lang, text = pick(n, LANGS), F.col("text")
    content = (
        F.when(kind == 0, F.concat(F.lit("Sure.\n" + FENCE), lang, F.lit("\nx = 1;\n"), text, F.lit("\n" + FENCE)))
        .when(kind == 1, F.concat(F.lit(FENCE + "\n"), text, F.lit("\n" + FENCE + " done")))
        .when(kind == 2, F.concat(F.lit(FENCE), lang, F.lit(" "), F.replace(text, F.lit("\n"), F.lit(" ")), F.lit(FENCE)))
        .when(kind == 3, F.concat(F.lit("Here is the code:\nimport x; class A; int f();\n"), text))
        .when(kind == 4, text)
        .when(
            kind == 6,
            F.concat(
                F.lit(FENCE + "\nshort\n" + FENCE + "\nand\n" + FENCE), lang, F.lit("\n  "), text,
                F.lit("\n\n" + FENCE),
            ),
        )
    )
    error = F.when(
        kind == 5,
        pick(
            (F.col("conv_id") % 5).cast("int"),
            (
                "API error 429: slow down", "Request timeout", "API error 402: no credit",
                "API error 503: busy", "connection reset",
            ),
        ),
    )
    return c.select(
        "conv_id",
        F.col("turn").cast("int").alias("turn"),
        F.floor((F.col("turn") + 1) / 2).cast("int").alias("attempt"),
        F.concat(F.lit("m"), (F.col("conv_id") % 7).cast("string")).alias("model"),
        lang.alias("language"),
        content.alias("content"),
        error.alias("error"),
        F.length(text).alias("tokens_input"),
        (F.col("turn") * 100).cast("int").alias("tokens_output"),
    )


def source_files(spark: SparkSession, sf: str) -> DataFrame:
    """Source files with two functions each, one file per part; some in excluded places."""
    c = spread(corpus(spark, sf))
    n = (F.col("no") % 4).cast("int")
    second = F.concat(
        pick(n, ("def g", "public int g", "function g", "int g")), F.lit("7"),
        F.substring("code", F.position(F.lit("("), F.col("code")), F.length("code")),
    )
    text = F.concat(pick(n, ("import os", "package x;", "'use strict';", "#pragma once")), F.lit("\n"), F.col("code"), F.lit("\n"), second)
    big = F.when(F.col("no") % 11 == 0, F.repeat(F.concat(text, F.lit("\n")), 40)).otherwise(text)
    folder = pick((F.col("no") % 6).cast("int"), ("sorts", "tests", "lists", "strings", "math", "misc"))
    name = F.when(F.col("no") % 13 == 0, "test_unit").otherwise("Unit")
    path = F.concat(folder, F.lit("/"), name, F.col("no").cast("string"), pick(n, EXTS))
    return c.select(
        path.alias("relative_path"),
        F.concat(F.lit("/data/trees/"), path).alias("path"),
        F.octet_length(big).cast("bigint").alias("length"),
        big.alias("code"),
        "language",
        "no",
        F.col("code").alias("first_code"),
    )


ALIASES = ("Python", "Java", "JavaScript", "C++")


def wiki_pages(spark: SparkSession, sf: str) -> DataFrame:
    """Pages with a listing per language heading, one page per part."""
    c = spread(corpus(spark, sf))
    escaped = F.replace(
        F.replace(F.replace("code", F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")),
        F.lit(">"), F.lit("&gt;"),
    )
    html = F.concat(
        F.lit("<html><body><h1>"), F.col("task_name"),
        F.lit("</h1><p>intro</p><h2><span class=\"mw-headline\" id=\""),
        pick((F.col("no") % 4).cast("int"), ALIASES),
        F.lit("\">x</span></h2>"),
        F.when(F.col("no") % 5 == 0, "<p>see <code>short</code></p>").otherwise("<p>see<br></p>"),
        F.lit("<div><pre class=\"hl\">"), escaped,
        F.lit("</pre></div><pre>another listing that is long enough to pass the limit of fifty</pre>"),
        F.lit("<h3><span class=\"mw-headline\" id=\"Perl\">Perl</span></h3><div><pre>"), escaped,
        F.lit("</pre></div></body></html>"),
    )
    return c.select(
        F.col("no").alias("page_id"),
        F.concat(F.lit("https://example.org/wiki/"), F.replace("task_name", F.lit(" "), F.lit("_"))).alias("url"),
        html.alias("html"),
    )


# --- the same tables as SQL ---------------------------------------------------------


def sql_str(text: str) -> str:
    return "'" + text.replace("'", "''").replace("\n", "' || chr(10) || '") + "'"


def sql_pick(index: str, values) -> str:
    arms = " ".join(f"WHEN {index} = {i} THEN {sql_str(v)}" for i, v in enumerate(values[:-1]))
    return f"(CASE {arms} ELSE {sql_str(values[-1])} END)"


def sql_code(lang_no: str, size: str, reps: str, note: str, tail: str) -> str:
    head = f"{sql_pick(lang_no, HEADERS)} || {size} || {sql_pick(lang_no, PARAMS)} || chr(10)"
    python = f"{head} || '    # ' || {note} || chr(10) || repeat({sql_str(PY_REP)}, {reps}) || {sql_str('    return a' + NL)}"
    braces = (
        f"{head} || '  // ' || {note} || chr(10) || repeat({sql_str(C_REP)}, {reps}) || '  /* ' || {tail}"
        f" || {sql_str(' */' + NL + '  return a;' + NL + '}' + NL)}"
    )
    return f"(CASE WHEN {lang_no} = 0 THEN {python} ELSE {braces} END)"


CORPUS = f"""(SELECT 'fn_' || p_partkey AS id, p_partkey AS no,
  {sql_pick("p_partkey % 4", LANGS)} AS language,
  {sql_code("p_partkey % 4", "p_size", "p_size % 17", "p_name", "p_type")} AS code,
  {sql_pick("p_partkey % 7", TOPICS)} || ' ' || p_name AS task_name,
  CASE WHEN p_partkey % 2 = 0 THEN 'rosetta_code' ELSE 'the_algorithms' END AS source,
  p_partkey % 3 = 0 AS validated,
  CASE WHEN p_partkey % 5 = 0 THEN 'old/' || p_brand END AS test_suite_path,
  p_size FROM part)"""

_COMMENTS = (
    ("//[^\\n]*", "g"), ("#[^\\n]*", "g"), ("/\\*.*?\\*/", "gs"), ("'''.*?'''", "gs"), ('""".*?"""', "gs"),
)


def sql_strip(x: str) -> str:
    return f"regexp_replace({x}, '^\\s+|\\s+$', '', 'g')"


def sql_norm(x: str) -> str:
    for pattern, flags in _COMMENTS:
        x = f"regexp_replace({x}, {sql_str(pattern)}, '', '{flags}')"
    lines = f"list_transform(string_split({x}, chr(10)), lambda l: {sql_strip('l')})"
    return f"array_to_string(list_filter({lines}, lambda l: l <> ''), chr(10))"


def sql_cc(x: str) -> str:
    words = ("if", "elif", "else", "for", "while", "case", "catch", "and", "or", "&&", "\\|\\|", "\\?", "switch")
    return "CAST(1 + " + " + ".join(f"len(regexp_extract_all({x}, '\\b{w}\\b'))" for w in words) + " AS INTEGER)"


def sql_volume(x: str) -> str:
    n = f"len(regexp_extract_all({x}, '[\\p{{L}}\\p{{N}}_]+'))"
    return f"(CASE WHEN {n} = 0 THEN 0.0 ELSE round({n} * log2({n}), 2) END)"


def sql_loc(norm: str) -> str:
    return f"CAST(CASE WHEN {norm} = '' THEN 0 ELSE len(string_split({norm}, chr(10))) END AS INTEGER)"


def sql_tier(cc: str) -> str:
    return f"(CASE WHEN {cc} <= 10 THEN 'simple' WHEN {cc} <= 30 THEN 'medium' ELSE 'complex' END)"


def sql_like_any(x: str, words) -> str:
    return "(" + " OR ".join(f"contains({x}, {sql_str(w)})" for w in words) + ")"


SQL_DOMAIN = (
    "(CASE WHEN regexp_matches(lower({0}), 'sort|search|tree|graph|dynamic') THEN 'algorithms' "
    "WHEN regexp_matches(lower({0}), 'list|array|stack|queue|hash') THEN 'data_structures' "
    "WHEN regexp_matches(lower({0}), 'string|text|parse|regex') THEN 'strings' "
    "WHEN regexp_matches(lower({0}), 'math|number|prime|factorial|fibonacci') THEN 'math' "
    "WHEN regexp_matches(lower({0}), 'file|read|write|io') THEN 'io' ELSE 'other' END)"
)

FUNCTIONS = f"""(SELECT c.* EXCLUDE (norm), sha256(norm) AS code_hash, {sql_loc("norm")} AS lines_of_code,
  {sql_cc("code")} AS cyclomatic_complexity, {sql_volume("code")} AS halstead_volume,
  {sql_tier(sql_cc("code"))} AS complexity_tier, {SQL_DOMAIN.format("task_name")} AS domain
  FROM (SELECT *, {sql_norm("code")} AS norm FROM {CORPUS}) c)"""

RUN_LOG = f"""(SELECT 'fn_' || l_partkey AS function_id, 'm' || (l_suppkey % 7) AS model,
  {sql_pick("l_linenumber % 3", TASKS)} AS task, {sql_pick("l_orderkey % 8", STRATEGIES)} AS strategy,
  CAST(0.2 AS DOUBLE) AS temperature,
  CAST(CAST(l_quantity AS INTEGER) % 13 AS DOUBLE) AS delta_cc,
  CASE WHEN l_returnflag = 'R' THEN 0 WHEN l_returnflag = 'N' AND l_linenumber = 7 THEN NULL ELSE 1 END AS preservation,
  l_discount * 10 AS diversity, 1.0 / (1.0 + l_extendedprice / 1000.0) AS effort,
  CASE WHEN l_tax = CAST(0.08 AS DOUBLE) THEN NULL ELSE CAST(floor(l_extendedprice / 100) AS DOUBLE) / 8 END AS se_score,
  CAST(round(l_discount * 100) AS INTEGER) / 1024.0::DOUBLE AS cost_usd,
  CASE WHEN l_linenumber <> 5 THEN CAST(l_quantity AS INTEGER) * 20 END AS latency_ms,
  CAST(l_quantity AS INTEGER) * 10 AS tokens_input, CAST(l_partkey % 1000 AS INTEGER) AS tokens_output,
  CASE WHEN l_returnflag = 'R' THEN {sql_pick("l_suppkey % 3", ("timeout", "rate_limit", "parse_error"))} END AS error_type,
  l_shipdate + to_seconds(l_orderkey % 86400) AS timestamp,
  l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice FROM lineitem)"""
ARRIVAL_SQL = ", ".join(ARRIVAL)

ATTEMPTS = f"""(SELECT 'fn_' || o_custkey AS function_id, 'm' || (o_orderkey % 7) AS model,
  {sql_pick("o_orderkey % 3", TASKS)} AS task,
  {sql_pick("(CAST(substr(o_orderpriority, 1, 1) AS INTEGER) - 1)", STRATEGIES[:5])} AS strategy,
  {sql_code("o_custkey % 4", "(o_custkey % 50)", "CAST(CAST(floor(o_totalprice) AS BIGINT) % 17 AS INTEGER)",
            "o_orderpriority", "o_orderstatus")} AS transformed_code,
  CAST(NULL AS DOUBLE) AS se_score, o_orderdate AS timestamp, o_orderkey, o_custkey,
  CAST(CAST(floor(o_totalprice) AS BIGINT) % 17 AS INTEGER) AS reps FROM orders)"""

TEST_RESULTS = """(SELECT 'fn_' || doc_id AS function_id, CAST(quality AS INTEGER) AS passed,
  CAST((doc_id * 7) % 101 AS DOUBLE) AS coverage_pct, CAST((doc_id * 13) % 140 AS INTEGER) AS execution_time_ms
  FROM labels)"""

_FRAMES = (
    "import pytest\ndef test_a():\n    assert True\n# ",
    "import org.junit.Test;\n@Test\n// ",
    "describe('x', () => {});\n// ",
    "#include <gtest/gtest.h>\nTEST(A, B) {}\n// ",
)
SUITES = f"""(SELECT 'fn_' || doc_id AS function_id, {sql_pick("doc_id % 4", LANGS)} AS language,
  CASE WHEN doc_id % 9 = 0 THEN text ELSE {sql_pick("doc_id % 4", _FRAMES)} || replace(text, chr(10), ' ') END AS test_code,
  doc_id FROM documents)"""

_LANG = sql_pick("conv_id % 4", LANGS)
RESPONSES = f"""(SELECT conv_id, CAST(turn AS INTEGER) AS turn, CAST((turn + 1) // 2 AS INTEGER) AS attempt,
  'm' || (conv_id % 7) AS model, {_LANG} AS language,
  CASE (conv_id + turn) % 7
    WHEN 0 THEN {sql_str("Sure." + NL + FENCE)} || {_LANG} || {sql_str(NL + "x = 1;" + NL)} || text || {sql_str(NL + FENCE)}
    WHEN 1 THEN {sql_str(FENCE + NL)} || text || {sql_str(NL + FENCE + " done")}
    WHEN 2 THEN '```' || {_LANG} || ' ' || replace(text, chr(10), ' ') || '```'
    WHEN 3 THEN {sql_str("Here is the code:" + NL + "import x; class A; int f();" + NL)} || text
    WHEN 4 THEN text
    WHEN 6 THEN {sql_str(FENCE + NL + "short" + NL + FENCE + NL + "and" + NL + FENCE)} || {_LANG} || {sql_str(NL + "  ")} || text || {sql_str(NL + NL + FENCE)}
  END AS content,
  CASE WHEN (conv_id + turn) % 7 = 5 THEN {sql_pick("conv_id % 5", (
      "API error 429: slow down", "Request timeout", "API error 402: no credit",
      "API error 503: busy", "connection reset"))} END AS error,
  CAST(length(text) AS INTEGER) AS tokens_input, CAST(turn * 100 AS INTEGER) AS tokens_output
  FROM conversations WHERE role = 'assistant')"""

MODELS_SQL = """(SELECT * FROM (VALUES ('tier1','m0',0.0002::DOUBLE), ('tier1','m1',0.000125), ('tier1','m2',0.00024),
  ('tier2','m3',0.003), ('tier2','m4',0.00175), ('tier3','m5',NULL)) t(tier, id, cost_per_1k_tokens))"""


def rounded(df: DataFrame, places: int = 6) -> DataFrame:
    """Doubles rounded, so that results do not depend on the order of partial sums."""
    return df.select(
        *[
            F.round(F.col(f"`{c}`"), places).alias(c) if t == "double" else F.col(f"`{c}`")
            for c, t in df.dtypes
        ]
    )
