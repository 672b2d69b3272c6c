"""Scans, filters, lookups, derived columns, contracts and file round trips."""

from pyspark.sql import functions as F

from refracta.functions import attributes
from refracta.functions.metrics import complexity_tier
from refracta.operators import corpus as C
from refracta.operators import lookups as L
from refracta.operators import quality as Q
from refracta.operators.sampling import feed_forward, hardest
from refracta.plans import fixtures as X
from refracta.plans.fixtures import CORPUS, FUNCTIONS, MODELS_SQL, RUN_LOG, SUITES, rounded
from refracta.plans.registry import query
from refracta.session import scratch_path
from refracta.sources import catalogue as K
from refracta.sources import files as R
from refracta.sources import writers as W

CC_SQL = X.sql_cc("code")


# --- sources and sinks ------------------------------------------------------------------


def _jsonl_rows(spark, sf):
    f = X.functions(spark, sf)
    return f.select(
        "id", "language", "code", "code_hash", "cyclomatic_complexity", "halstead_volume",
        "lines_of_code", "domain", "source", "task_name",
    )


_JSONL_SQL = (
    "SELECT id, language, code, code_hash, cyclomatic_complexity, halstead_volume, lines_of_code, "
    f"domain, source, task_name FROM {FUNCTIONS}"
)


@query("s1_read_function_jsonl", _JSONL_SQL)
def _(spark, sf):
    path = scratch_path(spark, "functions-jsonl")
    W.write_function_jsonl(_jsonl_rows(spark, sf), path)
    return R.read_function_jsonl(spark, path).drop("url", "file_path")


@query(
    "s2_combine_inputs",
    f"SELECT source, CAST(count(*) AS BIGINT) AS functions, CAST(count(url) AS BIGINT) AS urls FROM "
    f"(SELECT source, CASE WHEN source = 'rosetta_code' THEN 'u' END AS url FROM {CORPUS}) GROUP BY source",
)
def _(spark, sf):
    base = scratch_path(spark, "inputs")
    rows = _jsonl_rows(spark, sf)
    pages = rows.filter(F.col("source") == "rosetta_code").withColumn("url", F.lit("u"))
    trees = rows.filter(F.col("source") == "the_algorithms").withColumn("file_path", F.lit("f"))
    W.write_function_jsonl(pages, f"{base}/pages")
    W.write_function_jsonl(trees, f"{base}/trees")
    both = R.read_function_files(spark, [f"{base}/pages", f"{base}/trees", f"{base}/missing"])
    return both.groupBy("source").agg(
        F.count(F.lit(1)).alias("functions"), F.count("url").alias("urls")
    )


@query(
    "s3_write_function_jsonl",
    f"SELECT language, CAST(count(*) AS BIGINT) AS lines FROM {CORPUS} GROUP BY language",
)
def _(spark, sf):
    path = scratch_path(spark, "functions-out")
    W.write_function_jsonl(_jsonl_rows(spark, sf), path)
    lines = spark.read.text(path)
    return lines.groupBy(F.get_json_object("value", "$.language").alias("language")).agg(
        F.count(F.lit(1)).alias("lines")
    )


@query("s4_all_functions", f"SELECT id, language, validated FROM {CORPUS} WHERE validated")
def _(spark, sf):
    return L.all_functions(X.corpus(spark, sf)).select("id", "language", "validated")


@query("s5_grid_input", f"SELECT id, language, code, {CC_SQL} AS cyclomatic_complexity FROM {CORPUS}")
def _(spark, sf):
    return L.grid_input(X.functions(spark, sf))


@query(
    "s7_pages",
    "SELECT CAST(count(*) AS BIGINT) AS pages, CAST(count(DISTINCT url) AS BIGINT) AS urls, "
    "CAST(sum(length(html)) AS BIGINT) AS chars FROM pages",
)
def _(spark, sf):
    pages = R.read_pages(spark, f"{sf}/pages.parquet")
    return pages.agg(
        F.count(F.lit(1)).alias("pages"),
        F.count_distinct("url").alias("urls"),
        F.sum(F.length("html")).alias("chars"),
    )


@query(
    "s9_runs_per_tier",
    f"SELECT m.tier, CAST(count(*) AS BIGINT) AS runs, CAST(count(DISTINCT r.model) AS BIGINT) AS models "
    f"FROM {RUN_LOG} r JOIN {MODELS_SQL} m ON m.id = r.model GROUP BY m.tier",
)
def _(spark, sf):
    models = X.catalogue(spark)
    all_models = K.combine_tiers([K.models_of_tier(models, f"tier{i}") for i in (1, 2, 3)])
    per_model = X.run_log(spark, sf).groupBy("model").agg(F.count(F.lit(1)).alias("n"))
    return (
        K.with_model_attributes(per_model, all_models)
        .filter(F.col("tier").isNotNull())
        .groupBy("tier")
        .agg(F.sum("n").alias("runs"), F.count(F.lit(1)).alias("models"))
    )


@query(
    "s12_suite_files",
    f"SELECT language, function_id, function_id || '_test' || "
    f"{X.sql_pick('doc_id % 4', X.EXTS)} AS file_name, test_code FROM {SUITES}",
)
def _(spark, sf):
    path = scratch_path(spark, "suites")
    W.write_suites(X.suites(spark, sf), path)
    return spark.read.parquet(path).select("language", "function_id", "file_name", "test_code")


@query(
    "s13_suite_paths",
    f"SELECT c.id, c.language, coalesce(s.file_name, c.test_suite_path) AS test_suite_path FROM {CORPUS} c "
    f"LEFT JOIN (SELECT function_id, max(function_id || '_test' || {X.sql_pick('doc_id % 4', X.EXTS)}) AS file_name "
    f"FROM {SUITES} GROUP BY 1) s ON s.function_id = c.id",
)
def _(spark, sf):
    functions = X.corpus(spark, sf).select("id", "language", "test_suite_path")
    return W.with_suite_path(functions, W.suite_files(X.suites(spark, sf)))


@query(
    "s15_summary_csv",
    f"SELECT model, CAST(count(*) AS BIGINT) AS runs, round(avg(delta_cc), 6) AS avg_delta_cc "
    f"FROM {RUN_LOG} GROUP BY model",
)
def _(spark, sf):
    path = scratch_path(spark, "summary-csv")
    summary = X.run_log(spark, sf).groupBy("model").agg(
        F.count(F.lit(1)).alias("runs"), F.avg("delta_cc").alias("avg_delta_cc")
    )
    W.write_summary_csv(rounded(summary), path)
    return spark.read.schema("model string, runs bigint, avg_delta_cc double").option(
        "header", True
    ).csv(path)


@query(
    "s16_tier_export",
    f"SELECT coalesce(m.tier, 'unknown') AS tier, CAST(count(*) AS BIGINT) AS rows, "
    f"CAST(sum(r.l_orderkey) AS BIGINT) AS key_sum FROM {RUN_LOG} r LEFT JOIN {MODELS_SQL} m ON m.id = r.model GROUP BY 1",
)
def _(spark, sf):
    path = scratch_path(spark, "tiers")
    facts = K.with_model_attributes(X.run_log(spark, sf), X.catalogue(spark))
    facts = facts.withColumn("tier", F.coalesce("tier", F.lit("unknown"))).select(
        "tier", "function_id", "model", "task", "strategy", "se_score", "l_orderkey"
    )
    W.write_tier_jsonl(facts, path)
    back = spark.read.schema("function_id string, l_orderkey bigint, tier string").json(path)
    return back.groupBy("tier").agg(
        F.count(F.lit(1)).alias("rows"), F.sum("l_orderkey").alias("key_sum")
    )


# --- lookups and filters -------------------------------------------------------------------


@query("f1_function_by_id", f"SELECT id, language, task_name FROM {CORPUS} WHERE id = 'fn_42'")
def _(spark, sf):
    return L.function_by_id(X.corpus(spark, sf), "fn_42").select("id", "language", "task_name")


@query(
    "f2_functions_by_language",
    f"SELECT id, task_name FROM {CORPUS} WHERE language = 'java' AND validated",
)
def _(spark, sf):
    return L.functions_by_language(X.corpus(spark, sf), "java").select("id", "task_name")


@query(
    "f3_functions_by_tier",
    f"SELECT id, cyclomatic_complexity FROM (SELECT id, {CC_SQL} AS cyclomatic_complexity FROM {CORPUS}) "
    "WHERE cyclomatic_complexity > 10 AND cyclomatic_complexity <= 30",
)
def _(spark, sf):
    return L.functions_by_tier(X.functions(spark, sf), "medium", validated_only=False).select(
        "id", "cyclomatic_complexity"
    )


_KEY4 = "function_id = 'fn_7' AND model = 'm4' AND task = 'refactor' AND strategy = 'zero_shot'"


@query(
    "f4_transformation_by_key",
    f"SELECT l_orderkey, se_score, cost_usd FROM {RUN_LOG} WHERE {_KEY4}",
)
def _(spark, sf):
    return L.transformation_by_key(
        X.run_log(spark, sf), "fn_7", "m4", "refactor", "zero_shot"
    ).select("l_orderkey", "se_score", "cost_usd")


@query(
    "f5_transformations_of_function",
    f"SELECT l_orderkey, l_linenumber, model, task, strategy FROM {RUN_LOG} WHERE function_id = 'fn_7'",
)
def _(spark, sf):
    return L.transformations_of(X.run_log(spark, sf), "fn_7").select(
        "l_orderkey", "l_linenumber", "model", "task", "strategy"
    )


@query(
    "f8_pending_scores",
    f"SELECT function_id, model, task, strategy, l_orderkey, l_linenumber FROM {RUN_LOG} WHERE se_score IS NULL",
)
def _(spark, sf):
    return L.pending_scores(X.run_log(spark, sf)).select(
        "function_id", "model", "task", "strategy", "l_orderkey", "l_linenumber"
    )


@query(
    "f9_scored_rows",
    f"SELECT model, CAST(count(*) AS BIGINT) AS scored FROM {RUN_LOG} WHERE se_score IS NOT NULL GROUP BY model",
)
def _(spark, sf):
    return L.scored(X.run_log(spark, sf)).groupBy("model").agg(F.count(F.lit(1)).alias("scored"))


@query(
    "f10_optional_filters",
    f"SELECT strategy, CAST(count(*) AS BIGINT) AS n FROM {RUN_LOG} WHERE task = 'obfuscate' GROUP BY strategy",
)
def _(spark, sf):
    rows = L.matching(X.run_log(spark, sf), task="obfuscate", strategy=None)
    return rows.groupBy("strategy").agg(F.count(F.lit(1)).alias("n"))


@query(
    "f11_complex_enough",
    f"SELECT id, cyclomatic_complexity FROM (SELECT id, {CC_SQL} AS cyclomatic_complexity FROM {CORPUS}) "
    "WHERE cyclomatic_complexity >= 3",
)
def _(spark, sf):
    return C.complex_enough(X.functions(spark, sf)).select("id", "cyclomatic_complexity")


@query(
    "f12_length_limits",
    "SELECT doc_id, CAST(length(text) AS INTEGER) AS chars FROM documents WHERE length(text) BETWEEN 50 AND 3000",
)
def _(spark, sf):
    docs = X.table(spark, sf, "documents").select("doc_id", "text")
    return C.length_between(docs, "text").select("doc_id", F.length("text").alias("chars"))


# Rows with planted defects: what a rule check has to find.
_DIRTY_SQL = (
    f"(SELECT CASE WHEN l_partkey % 97 = 0 THEN NULL ELSE function_id END AS function_id, model, "
    f"CASE WHEN l_linenumber = 6 THEN 'translate' ELSE task END AS task, "
    f"CASE WHEN l_orderkey % 50 = 0 THEN 'best_of_n' ELSE strategy END AS strategy, "
    f"CASE WHEN l_suppkey % 31 = 0 THEN 2 ELSE preservation END AS preservation, l_orderkey FROM {RUN_LOG})"
)


def _dirty(spark, sf):
    r = X.run_log(spark, sf)
    return r.select(
        F.when(F.col("l_partkey") % 97 != 0, F.col("function_id")).alias("function_id"),
        "model",
        F.when(F.col("l_linenumber") == 6, "translate").otherwise(F.col("task")).alias("task"),
        F.when(F.col("l_orderkey") % 50 == 0, "best_of_n").otherwise(F.col("strategy")).alias("strategy"),
        F.when(F.col("l_suppkey") % 31 == 0, 2).otherwise(F.col("preservation")).alias("preservation"),
        "l_orderkey",
    )


_STRATEGY_LIST = ", ".join(f"'{s}'" for s in X.STRATEGIES)


@query(
    "f13_rule_violations",
    f"""WITH d AS (SELECT count(*) FILTER (function_id IS NULL) AS a, count(*) FILTER (model IS NULL) AS b,
    count(*) FILTER (task NOT IN ('obfuscate', 'deobfuscate', 'refactor')) AS c,
    count(*) FILTER (strategy NOT IN ({_STRATEGY_LIST})) AS s,
    count(*) FILTER (preservation NOT IN (0, 1)) AS p FROM {_DIRTY_SQL})
    SELECT 'function_id_not_null' AS rule, a AS violations FROM d UNION ALL SELECT 'model_not_null', b FROM d
    UNION ALL SELECT 'task_domain', c FROM d UNION ALL SELECT 'strategy_domain', s FROM d
    UNION ALL SELECT 'preservation_0_or_1', p FROM d""",
)
def _(spark, sf):
    return Q.rule_violations(_dirty(spark, sf), Q.transformation_rules())


@query(
    "f13_function_rules",
    f"""SELECT rule, CAST(0 AS BIGINT) AS violations FROM (SELECT unnest(['id_not_null', 'language_not_null',
    'code_not_null', 'code_hash_not_null', 'source_not_null', 'language_domain', 'cc_at_least_1', 'loc_positive']) AS rule)
    WHERE (SELECT count(*) FROM {CORPUS}) > 0""",
)
def _(spark, sf):
    return Q.rule_violations(X.functions(spark, sf), Q.function_rules())


@query(
    "f13_quarantine",
    f"""SELECT l_orderkey, array_to_string(list_filter([CASE WHEN function_id IS NULL THEN 'function_id_not_null' END,
    CASE WHEN task NOT IN ('obfuscate', 'deobfuscate', 'refactor') THEN 'task_domain' END,
    CASE WHEN strategy NOT IN ({_STRATEGY_LIST}) THEN 'strategy_domain' END,
    CASE WHEN preservation NOT IN (0, 1) THEN 'preservation_0_or_1' END], lambda x: x IS NOT NULL), ',') AS broken
    FROM {_DIRTY_SQL} WHERE function_id IS NULL OR task = 'translate' OR strategy = 'best_of_n' OR preservation = 2""",
)
def _(spark, sf):
    _good, bad = Q.quarantine(_dirty(spark, sf), Q.transformation_rules())
    return bad.select("l_orderkey", F.array_join("broken_rules", ",").alias("broken"))


@query(
    "f14_complexity_tier",
    f"SELECT id, {X.sql_tier(CC_SQL)} AS tier FROM {CORPUS}",
)
def _(spark, sf):
    return X.functions(spark, sf).select(
        "id", complexity_tier(F.col("cyclomatic_complexity")).alias("tier")
    )


@query(
    "f15_success",
    f"SELECT success, CAST(count(*) AS BIGINT) AS n FROM (SELECT coalesce(preservation = 1, false) AS success FROM {RUN_LOG}) GROUP BY success",
)
def _(spark, sf):
    flag = attributes.success(F.col("preservation")).alias("success")
    return X.run_log(spark, sf).groupBy(flag).agg(F.count(F.lit(1)).alias("n"))


@query(
    "f16_total_tokens",
    f"SELECT model, CAST(sum(coalesce(i, 0) + coalesce(o, 0)) AS BIGINT) AS tokens FROM "
    f"(SELECT model, CASE WHEN l_linenumber <> 3 THEN tokens_input END AS i, "
    f"CASE WHEN l_linenumber <> 2 THEN tokens_output END AS o FROM {RUN_LOG}) GROUP BY model",
)
def _(spark, sf):
    rows = X.run_log(spark, sf).select(
        "model",
        attributes.total_tokens(
            F.when(F.col("l_linenumber") != 3, F.col("tokens_input")),
            F.when(F.col("l_linenumber") != 2, F.col("tokens_output")),
        ).alias("t"),
    )
    return rows.groupBy("model").agg(F.sum("t").alias("tokens"))


@query(
    "f18_anomalies",
    f"""SELECT l_orderkey, l_linenumber, array_to_string(list_filter([CASE WHEN se > 50 THEN 'se_too_high' END,
    CASE WHEN cost > 0.1 THEN 'cost_too_high' END, CASE WHEN lat > 60000 THEN 'latency_too_high' END],
    lambda x: x IS NOT NULL), ',') AS anomalies FROM (SELECT l_orderkey, l_linenumber, se_score AS se,
    cost_usd * 110 AS cost, latency_ms * 61 AS lat FROM {RUN_LOG}) WHERE se > 50 OR cost > 0.1 OR lat > 60000""",
)
def _(spark, sf):
    r = X.run_log(spark, sf).withColumns(
        {"cost_usd": F.col("cost_usd") * 110, "latency_ms": F.col("latency_ms") * 61}
    )
    return Q.anomalies(r).select(
        "l_orderkey", "l_linenumber", F.array_join("anomalies", ",").alias("anomalies")
    )


@query(
    "f18_groups_without_success",
    f"SELECT function_id, strategy, CAST(count(*) AS BIGINT) AS n FROM {RUN_LOG} WHERE preservation IS NOT NULL "
    "GROUP BY 1, 2 HAVING bool_and(preservation = 0)",
)
def _(spark, sf):
    return Q.groups_without_success(X.run_log(spark, sf), ["function_id", "strategy"])


@query(
    "f19_hardest_functions",
    f"SELECT id FROM (SELECT id, {CC_SQL} AS cc FROM {CORPUS}) WHERE cc > 20",
)
def _(spark, sf):
    return hardest(X.functions(spark, sf)).select("id")


@query(
    "f19_feed_forward",
    f"""WITH best AS (SELECT task, strategy FROM (SELECT task, strategy, avg(se_score) AS m FROM {RUN_LOG}
    WHERE se_score IS NOT NULL GROUP BY 1, 2) ORDER BY m DESC, task, strategy LIMIT 5)
    SELECT task, strategy, CAST(count(*) AS BIGINT) AS n FROM {RUN_LOG} SEMI JOIN best USING (task, strategy) GROUP BY 1, 2""",
)
def _(spark, sf):
    return feed_forward(X.run_log(spark, sf)).groupBy("task", "strategy").agg(F.count(F.lit(1)).alias("n"))


# --- integrity ----------------------------------------------------------------------------------

_KEPT = f"(SELECT id FROM {CORPUS} WHERE no % 10 <> 0)"


@query(
    "j2_orphans",
    f"SELECT function_id, CAST(count(*) AS BIGINT) AS n FROM {RUN_LOG} WHERE function_id NOT IN {_KEPT} GROUP BY 1",
)
def _(spark, sf):
    kept = X.corpus(spark, sf).filter(F.col("no") % 10 != 0)
    lost = Q.orphans(X.run_log(spark, sf).select("function_id"), kept)
    return lost.groupBy("function_id").agg(F.count(F.lit(1)).alias("n"))


@query(
    "j2_cascade_delete",
    f"SELECT model, CAST(count(*) AS BIGINT) AS n FROM {RUN_LOG} WHERE function_id IN {_KEPT} GROUP BY 1",
)
def _(spark, sf):
    kept = X.corpus(spark, sf).filter(F.col("no") % 10 != 0)
    left = Q.cascade_delete(X.run_log(spark, sf).select("function_id", "model"), kept)
    return left.groupBy("model").agg(F.count(F.lit(1)).alias("n"))


@query(
    "u1_union_all",
    f"SELECT id, language, source FROM {CORPUS}",
)
def _(spark, sf):
    c = X.corpus(spark, sf)
    pages = c.filter(F.col("source") == "rosetta_code").withColumn("url", F.lit("u"))
    trees = c.filter(F.col("source") == "the_algorithms").withColumn("file_path", F.lit("p"))
    return R.combine_corpora([pages, trees]).select("id", "language", "source")
