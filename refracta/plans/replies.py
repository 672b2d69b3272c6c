"""Prompts, replies, attempts and errors."""

from pyspark.sql import functions as F

from refracta.constants import TASKS
from refracta.functions import responses as P
from refracta.functions.text import longest
from refracta.operators import cost as O
from refracta.operators import grid as G
from refracta.operators.results import result_rows
from refracta.plans import fixtures as X
from refracta.plans.fixtures import CORPUS, FENCE, MODELS_SQL, RESPONSES, RUN_LOG, SUITES, rounded, sql_strip
from refracta.plans.registry import query
from refracta.session import scratch_path
from refracta.sources import writers as W


# --- prompts ---------------------------------------------------------------------------------

_TEMPLATES_SQL = (
    "(SELECT DISTINCT task, strategy, 'Please ' || task || ' (' || strategy || ') this {language} code: {code} -- {language}' AS template "
    f"FROM {RUN_LOG})"
)


def _templates(spark, sf):
    """One template per (task, strategy) of the log."""
    pairs = X.run_log(spark, sf).select("task", "strategy").distinct()
    return pairs.withColumn(
        "template",
        F.concat(
            F.lit("Please "), "task", F.lit(" ("), "strategy",
            F.lit(") this {language} code: {code} -- {language}"),
        ),
    )


def _cells(spark, sf):
    """Results of the log that need a prompt, with their code."""
    c = X.corpus(spark, sf).select(F.col("id").alias("function_id"), "code", "language")
    rows = X.run_log(spark, sf).filter(F.col("se_score").isNull())
    return rows.select("function_id", "task", "strategy", "l_orderkey", "l_linenumber").join(c, "function_id")


_CELLS_SQL = (
    f"(SELECT r.l_orderkey, r.l_linenumber, r.task, r.strategy, c.code, c.language FROM {RUN_LOG} r JOIN {CORPUS} c "
    "ON c.id = r.function_id WHERE r.se_score IS NULL)"
)


@query(
    "e16_render_prompt",
    f"SELECT l_orderkey, l_linenumber, md5(replace(replace(template, '{{code}}', code), '{{language}}', language)) AS prompt_md5 "
    f"FROM {_CELLS_SQL} JOIN {_TEMPLATES_SQL} USING (task, strategy)",
)
def _(spark, sf):
    cells = G.attach_templates(_cells(spark, sf), _templates(spark, sf))
    prompt = P.render_prompt(F.col("template"), F.col("code"), F.col("language"))
    return cells.select("l_orderkey", "l_linenumber", F.md5(prompt).alias("prompt_md5"))


@query(
    "e16_render_test_prompt",
    f"SELECT id, md5('Write tests for ' || code || ' in {{language}}') AS prompt_md5 FROM {CORPUS}",
)
def _(spark, sf):
    template = F.lit("Write tests for {code} in {language}")
    return X.corpus(spark, sf).select(
        "id", F.md5(P.render_prompt(template, F.col("code"))).alias("prompt_md5")
    )


@query(
    "j9_attach_templates",
    f"SELECT task, strategy, CAST(count(*) AS BIGINT) AS cells, CAST(sum(length(template)) AS BIGINT) AS chars FROM {_CELLS_SQL} JOIN {_TEMPLATES_SQL} USING (task, strategy) GROUP BY 1, 2",
)
def _(spark, sf):
    cells = G.attach_templates(_cells(spark, sf), _templates(spark, sf))
    return cells.groupBy("task", "strategy").agg(
        F.count(F.lit(1)).alias("cells"), F.sum(F.length("template")).alias("chars")
    )


@query(
    "s8_missing_templates",
    f"SELECT DISTINCT task, strategy FROM {RUN_LOG} WHERE strategy = 'self_reflection'",
)
def _(spark, sf):
    known = _templates(spark, sf).filter(F.col("strategy") != "self_reflection")
    return G.missing_templates(X.run_log(spark, sf), known)


# --- code in replies -----------------------------------------------------------------------------


def _block_sql(opening: str) -> str:
    found = f"regexp_extract_all(content, '(?s)```{opening}(.*?)```', 1)"
    best = f"list_reduce(list_concat([''], {found}), lambda a, b: CASE WHEN length(b) > length(a) THEN b ELSE a END)"
    return f"nullif({sql_strip(best)}, '')"


def _fenced_sql() -> str:
    arms = []
    for lang in X.LANGS:
        styles = ", ".join(
            _block_sql(o) for o in (f"(?:{lang})?\\s*\\n", "\\s*\\n", f"(?:{lang})?\\s+", "\\s+")
        )
        arms.append(f"WHEN '{lang}' THEN coalesce({styles})")
    return f"(CASE language {' '.join(arms)} END)"


def _markers_sql(markers: dict) -> str:
    arms = " ".join(f"WHEN '{k}' THEN {X.sql_like_any('content', v)}" for k, v in markers.items())
    return f"(CASE language {arms} END)"


_CLEAN_SQL = (
    "nullif(regexp_replace(" + sql_strip("content")
    + ", '^(?i:Here is|Here''s|This is)[^\\n]*?:\\s*', ''), '')"
)
_EXTRACTED_SQL = (
    f"coalesce({_fenced_sql()}, CASE WHEN {_markers_sql(P.CODE_INDICATORS)} THEN {_CLEAN_SQL} END)"
)


@query(
    "e17_fenced_code",
    f"SELECT conv_id, turn, {_fenced_sql()} AS code FROM {RESPONSES}",
)
def _(spark, sf):
    return X.responses(spark, sf).select(
        "conv_id", "turn", P.fenced_code(F.col("content"), F.col("language")).alias("code")
    )


@query("e18_extract_code", f"SELECT conv_id, turn, {_EXTRACTED_SQL} AS code FROM {RESPONSES}")
def _(spark, sf):
    return X.responses(spark, sf).select(
        "conv_id", "turn", P.extract_code(F.col("content"), F.col("language")).alias("code")
    )


def _tail_sql() -> str:
    arms = []
    for lang, tokens in P.TEST_STARTS.items():
        lines = "string_split(content, chr(10))"
        first = f"list_position(list_transform({lines}, lambda l: {X.sql_like_any('l', tokens)}), true)"
        tail = f"array_to_string(list_slice({lines}, {first}, len({lines})), chr(10))"
        arms.append(f"WHEN '{lang}' THEN CASE WHEN {first} > 0 THEN nullif({sql_strip(tail)}, '') END")
    return f"(CASE language {' '.join(arms)} END)"


# Suites as chatty replies: text before and after the code, every fifth one fenced.
_CHATTY_SQL = (
    f"(SELECT function_id, language, doc_id, CASE WHEN doc_id % 5 = 0 THEN 'Tests:' || chr(10) || '```' || chr(10) || test_code || chr(10) || '```' "
    f"WHEN doc_id % 5 = 1 THEN 'Here''s the suite: ' || test_code ELSE 'Sure, see below.' || chr(10) || test_code END AS content FROM {SUITES})"
)


def _chatty(spark, sf):
    kind = F.col("doc_id") % 5
    return X.suites(spark, sf).withColumn(
        "content",
        F.when(kind == 0, F.concat(F.lit("Tests:\n" + FENCE + "\n"), "test_code", F.lit("\n" + FENCE)))
        .when(kind == 1, F.concat(F.lit("Here's the suite: "), "test_code"))
        .otherwise(F.concat(F.lit("Sure, see below.\n"), "test_code")),
    ).drop("test_code")


_TEST_SQL = (
    f"coalesce({_fenced_sql()}, CASE WHEN {_markers_sql(P.TEST_TRIGGERS)} THEN {_tail_sql()} END, "
    f"CASE WHEN {_markers_sql(P.TEST_INDICATORS)} THEN {_CLEAN_SQL} END)"
)


@query("e19_extract_test_code", f"SELECT doc_id, md5({_TEST_SQL}) AS code_md5 FROM {_CHATTY_SQL}")
def _(spark, sf):
    code = P.extract_test_code(F.col("content"), F.col("language"))
    return _chatty(spark, sf).select("doc_id", F.md5(code).alias("code_md5"))


@query(
    "e20_test_indicators",
    f"SELECT doc_id, md5(CASE WHEN {_markers_sql(P.TEST_INDICATORS)} THEN {_CLEAN_SQL} END) AS code_md5 FROM "
    "(SELECT doc_id, 'Here is: ' || text AS content, CASE WHEN doc_id % 2 = 0 THEN 'cpp' ELSE 'java' END AS language FROM documents)",
)
def _(spark, sf):
    docs = X.table(spark, sf, "documents").select(
        "doc_id",
        F.concat(F.lit("Here is: "), "text").alias("content"),
        F.when(F.col("doc_id") % 2 == 0, "cpp").otherwise("java").alias("language"),
    )
    code = P.when_marked(
        F.col("content"), F.col("language"), P.TEST_INDICATORS, P.without_lead_in(F.col("content"))
    )
    return docs.select("doc_id", F.md5(code).alias("code_md5"))


@query(
    "e22_error_type",
    f"""SELECT conv_id, turn, CASE WHEN error IS NULL AND code IS NOT NULL THEN NULL WHEN error IS NULL THEN 'parse_error'
    WHEN error LIKE '%402%' THEN 'insufficient_funds' WHEN error LIKE '%429%' THEN 'rate_limit' WHEN error LIKE '%503%' THEN 'server_error'
    WHEN lower(error) LIKE '%timeout%' THEN 'timeout' ELSE 'request_error' END AS error_type,
    coalesce(error LIKE '%402%', false) AS fatal FROM (SELECT *, {_EXTRACTED_SQL} AS code FROM {RESPONSES})""",
)
def _(spark, sf):
    return _extracted(spark, sf).select(
        "conv_id", "turn",
        P.error_type(F.col("error"), F.col("code")).alias("error_type"),
        P.is_fatal(F.col("error")).alias("fatal"),
    )


def _extracted(spark, sf):
    return X.responses(spark, sf).withColumn("code", P.extract_code(F.col("content"), F.col("language")))


@query(
    "o7_longest_block",
    "SELECT doc_id, list_reduce(list_concat([''], string_split(text, chr(10))), lambda a, b: CASE WHEN length(b) > length(a) THEN b ELSE a END) AS line FROM documents",
)
def _(spark, sf):
    return X.table(spark, sf, "documents").select("doc_id", longest(F.split("text", "\n")).alias("line"))


@query(
    "w6_first_usable_attempt",
    f"""SELECT conv_id, attempt, md5(code) AS code_md5 FROM (SELECT *, {_EXTRACTED_SQL} AS code FROM {RESPONSES})
    WHERE code IS NOT NULL AND attempt <= 3 QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY attempt) = 1""",
)
def _(spark, sf):
    first = G.first_usable_attempt(_extracted(spark, sf), ["conv_id"], F.col("code").isNotNull())
    return first.select("conv_id", "attempt", F.md5("code").alias("code_md5"))


_OUTCOME_SQL = f"""(SELECT conv_id, max(CASE WHEN code IS NOT NULL AND attempt <= 3 THEN 1 ELSE 0 END) AS ok,
  sum((tokens_input + tokens_output) / 1000.0::DOUBLE * 0.002::DOUBLE) AS cost FROM (SELECT *, {_EXTRACTED_SQL} AS code FROM {RESPONSES}) GROUP BY 1)"""


@query(
    "a20_run_outcome",
    f"SELECT count(*) FILTER (ok = 1 AND conv_id % 5 <> 0) AS completed, count(*) FILTER (ok = 0 AND conv_id % 5 <> 0) AS failed, "
    f"count(*) FILTER (conv_id % 5 = 0) AS skipped, round(sum(CASE WHEN conv_id % 5 <> 0 THEN cost END), 6) AS total_cost_usd FROM {_OUTCOME_SQL}",
)
def _(spark, sf):
    cost = (F.col("tokens_input") + F.col("tokens_output")) / F.lit(1000.0) * 0.002
    usable = F.col("code").isNotNull() & (F.col("attempt") <= 3)
    skipped = F.col("conv_id") % 5 == 0
    runs = _extracted(spark, sf).groupBy("conv_id").agg(
        F.bool_or(usable).alias("ok"), F.sum(cost).alias("cost")
    )
    outcomes = runs.select(
        F.when(skipped, "skipped").when(F.col("ok"), "completed").otherwise("failed").alias("outcome"),
        F.when(~skipped, F.col("cost")).alias("cost_usd"),
    )
    return rounded(G.outcome_report(outcomes))


@query(
    "a26_generation_report",
    f"""SELECT CAST(count(*) AS BIGINT) AS total, CAST(count(code) AS BIGINT) AS generated, CAST(count(*) - count(code) AS BIGINT) AS failed,
    round(coalesce(sum(CASE WHEN code IS NOT NULL THEN cost END), 0), 6) AS total_cost_usd,
    round(coalesce(sum(CASE WHEN code IS NOT NULL THEN cost END), 0) / greatest(1, count(code)), 9) AS avg_cost_usd
    FROM (SELECT {_TEST_SQL} AS code, (doc_id % 10) / 1000.0::DOUBLE AS cost FROM {_CHATTY_SQL})""",
)
def _(spark, sf):
    generated = _chatty(spark, sf).select(
        P.extract_test_code(F.col("content"), F.col("language")).alias("test_code"),
        ((F.col("doc_id") % 10) / F.lit(1000.0)).alias("cost_usd"),
    )
    report = O.generation_report(generated)
    return report.select(
        "total", "generated", "failed", F.round("total_cost_usd", 6).alias("total_cost_usd"),
        F.round("avg_cost_usd", 9).alias("avg_cost_usd"),
    )


# --- results ---------------------------------------------------------------------------------

_TASK_OF_REPLY = X.sql_pick("conv_id % 3", TASKS)
_RESULTS_SQL = f"""WITH e AS (SELECT *, 'fn_' || conv_id AS function_id, {_TASK_OF_REPLY} AS task, {_EXTRACTED_SQL} AS new_code FROM {RESPONSES}),
    u AS (SELECT e.*, c.code FROM e JOIN {CORPUS} c ON c.id = e.function_id WHERE attempt <= 3
    QUALIFY row_number() OVER (PARTITION BY function_id, model, task ORDER BY new_code IS NULL, CASE WHEN new_code IS NULL THEN -attempt ELSE attempt END, turn) = 1)
    SELECT function_id, model, task, 'zero_shot' AS strategy, md5(new_code) AS code_md5,
    CAST(abs({X.sql_cc("new_code")} - {X.sql_cc("code")}) AS DOUBLE) AS delta_cc,
    round((tokens_input + tokens_output) / 1000.0::DOUBLE * CASE WHEN m.id IS NULL THEN 0.002 ELSE coalesce(cost_per_1k_tokens, 0.001) END, 9) AS cost_usd,
    turn * 10 AS latency_ms, CASE WHEN new_code IS NOT NULL AND error IS NULL THEN NULL WHEN error IS NULL THEN 'parse_error'
    WHEN error LIKE '%402%' THEN 'insufficient_funds' WHEN error LIKE '%429%' THEN 'rate_limit' WHEN error LIKE '%503%' THEN 'server_error'
    WHEN lower(error) LIKE '%timeout%' THEN 'timeout' ELSE 'request_error' END AS error_type
    FROM u LEFT JOIN {MODELS_SQL} m ON m.id = u.model"""


@query("x3_result_rows", _RESULTS_SQL)
def _(spark, sf):
    # The replies as answers to a grid, appended to the fact table twice.
    functions, path = X.functions(spark, sf), scratch_path(spark, "results")
    cells = G.grid(functions, [f"m{i}" for i in range(7)], TASKS, ["zero_shot"])
    replies = X.responses(spark, sf).drop("language").withColumns(
        {
            "function_id": F.concat(F.lit("fn_"), F.col("conv_id").cast("string")),
            "task": X.pick((F.col("conv_id") % 3).cast("int"), TASKS),
            "strategy": F.lit("zero_shot"),
            "latency_ms": F.col("turn") * 10,
            "timestamp": F.timestamp_seconds("turn").cast("timestamp_ntz"),
        }
    )
    rows = result_rows(cells, replies, functions, X.catalogue(spark))
    for _attempt in range(2):
        W.append_results(rows, path, ["timestamp"])
    return spark.read.parquet(path).select(
        "function_id", "model", "task", "strategy", F.md5("transformed_code").alias("code_md5"), "delta_cc",
        F.round("cost_usd", 9).alias("cost_usd"), "latency_ms", "error_type",
    )
