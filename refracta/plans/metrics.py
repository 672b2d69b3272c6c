"""Code metrics and scores, checked value by value."""

from pyspark.sql import functions as F

from refracta.functions import metrics as M
from refracta.functions import scoring as S
from refracta.functions.distance import edit_shares
from refracta.functions.domains import domain_from_path, domain_from_task, language_from_alias, suite_file_name
from refracta.functions.text import without_whitespace
from refracta.operators import astnodes as A
from refracta.operators import quality as Q
from refracta.operators import scoring as SC
from refracta.operators.corpus import keep_first
from refracta.plans import fixtures as X
from refracta.plans.fixtures import ATTEMPTS, CORPUS, FUNCTIONS, TEST_RESULTS
from refracta.plans.registry import query
from refracta.session import spread

NORM = X.sql_norm("code")


@query("e1_normalize_code", f"SELECT id, {NORM} AS norm FROM {CORPUS}")
def _(spark, sf):
    return spread(X.corpus(spark, sf)).select("id", M.normalize_code(F.col("code")).alias("norm"))


@query("e1_normalize_documents", f"SELECT doc_id, {X.sql_norm('text')} AS norm FROM documents")
def _(spark, sf):
    return X.table(spark, sf, "documents").select(
        "doc_id", M.normalize_code(F.col("text")).alias("norm")
    )


@query("e2_code_hash", f"SELECT id, sha256({NORM}) AS code_hash FROM {CORPUS}")
def _(spark, sf):
    return spread(X.corpus(spark, sf)).select("id", M.code_hash(F.col("code")).alias("code_hash"))


@query(
    "e3_lines_of_code",
    f"SELECT id, {X.sql_loc('n')} AS lines_of_code FROM (SELECT id, {NORM} AS n FROM {CORPUS})",
)
def _(spark, sf):
    return spread(X.corpus(spark, sf)).select("id", M.lines_of_code(F.col("code")).alias("lines_of_code"))


@query("e4_keyword_complexity", f"SELECT id, {X.sql_cc('code')} AS cc FROM {CORPUS}")
def _(spark, sf):
    return spread(X.corpus(spark, sf)).select("id", M.keyword_complexity(F.col("code")).alias("cc"))


@query(
    "e5_tree_complexity",
    "SELECT 'fn_' || p_partkey AS id, CAST(1 + 2 * (p_size % 17) AS INTEGER) AS cc FROM part WHERE p_partkey % 4 = 0",
)
def _(spark, sf):
    python = X.corpus(spark, sf).filter(F.col("language") == "python")
    return A.with_tree(python, fields=A.COMPLEXITY_FIELDS).select("id", A.tree_complexity(F.col("tree")).alias("cc"))


@query(
    "e5_complexity_by_language",
    f"SELECT id, CASE WHEN language = 'python' THEN CAST(1 + 2 * (p_size % 17) AS INTEGER) ELSE {X.sql_cc('code')} END AS cc FROM {CORPUS}",
)
def _(spark, sf):
    return A.with_complexity(X.corpus(spark, sf), out="cc").select("id", "cc")


# A class per part: up to two conditions in its body, up to three methods of up to four each.
_CLASS_PARTS = "SELECT p_partkey, p_size % 3 AS own, p_partkey % 4 AS methods, (p_size // 3) % 5 AS inside FROM part"


@query(
    "e5_class_complexity",
    f"""SELECT p_partkey, CAST(greatest(CASE WHEN methods > 0 THEN 1 + inside ELSE 1 END, CASE WHEN methods = 0 THEN 1 + own
    ELSE (1 + own + methods * (1 + inside)) // methods + CAST(methods > 1 AS INTEGER) END) AS INTEGER) AS cc FROM ({_CLASS_PARTS})""",
)
def _(spark, sf):
    size, key = F.col("p_size"), F.col("p_partkey")
    method = F.concat(
        F.lit("    def f(self, x):\n"),
        F.repeat(F.lit("        if x:\n            x += 1\n"), (F.floor(size / 3) % 5).cast("int")),
        F.lit("        def nested(y):\n            return y or x\n        return nested(x)\n"),
    )
    code = F.concat(
        F.lit("class C:\n    a = 1\n"),
        F.repeat(F.lit("    if a:\n        a = 2\n"), (size % 3).cast("int")),
        F.repeat(method, (key % 4).cast("int")),
        F.lit("    class Inner:\n        b = 1 if a else 2\n"),
    )
    classes = spread(X.table(spark, sf, "part").select("p_partkey", code.alias("code")))
    return A.with_tree(classes, fields=A.COMPLEXITY_FIELDS).select("p_partkey", A.tree_complexity(F.col("tree")).alias("cc"))


@query(
    "e6_halstead_volume",
    f"SELECT id, {X.sql_volume('code')} AS volume FROM {CORPUS}",
)
def _(spark, sf):
    return spread(X.corpus(spark, sf)).select("id", M.halstead_volume(F.col("code")).alias("volume"))


@query(
    "e7_document_volume",
    f"SELECT doc_id, CAST(len(regexp_extract_all(text, '[\\p{{L}}\\p{{N}}_]+')) AS INTEGER) AS tokens, "
    f"{X.sql_volume('text')} AS volume FROM documents",
)
def _(spark, sf):
    return X.table(spark, sf, "documents").select(
        "doc_id",
        M.token_count(F.col("text")).alias("tokens"),
        M.halstead_volume(F.col("text")).alias("volume"),
    )


@query(
    "e8_tier_counts",
    f"SELECT tier, CAST(count(*) AS BIGINT) AS n FROM (SELECT {X.sql_tier(X.sql_cc('code'))} AS tier FROM {CORPUS}) GROUP BY tier",
)
def _(spark, sf):
    tier = M.complexity_tier(M.keyword_complexity(F.col("code"))).alias("tier")
    return spread(X.corpus(spark, sf)).groupBy(tier).agg(F.count(F.lit(1)).alias("n"))


@query(
    "e9_metrics_bundle",
    f"SELECT id, code_hash, lines_of_code, cyclomatic_complexity, halstead_volume, complexity_tier FROM {FUNCTIONS}",
)
def _(spark, sf):
    return M.with_metrics(spread(X.corpus(spark, sf))).select(
        "id", "code_hash", "lines_of_code", "cyclomatic_complexity", "halstead_volume", "complexity_tier"
    )


@query("e10_domain_from_task", f"SELECT id, {X.SQL_DOMAIN.format('task_name')} AS domain FROM {CORPUS}")
def _(spark, sf):
    return X.corpus(spark, sf).select("id", domain_from_task(F.col("task_name")).alias("domain"))


_PATH_SQL = (
    "(SELECT 'fn_' || no AS id, lower(replace(task_name, ' ', '_') || '/' || language || '/f' || no) AS p FROM " + CORPUS + ")"
)


@query(
    "e11_domain_from_path",
    f"""SELECT id, CASE WHEN regexp_matches(p, 'sort|search|dp|dynamic|graph|tree') THEN 'algorithms'
    WHEN regexp_matches(p, 'data_structure|list|stack|queue|hash') THEN 'data_structures'
    WHEN regexp_matches(p, 'string|text') THEN 'strings' WHEN regexp_matches(p, 'math|number') THEN 'math'
    WHEN regexp_matches(p, 'file|io') THEN 'io' ELSE 'other' END AS domain FROM {_PATH_SQL}""",
)
def _(spark, sf):
    path = F.concat(
        F.replace("task_name", F.lit(" "), F.lit("_")), F.lit("/"), F.col("language"), F.lit("/f"),
        F.col("no").cast("string"),
    )
    return X.corpus(spark, sf).select("id", domain_from_path(path).alias("domain"))


@query(
    "e12_language_alias",
    f"SELECT id, CASE WHEN no % 5 = 4 THEN NULL ELSE "
    f"{X.sql_pick('no % 5', ('python', 'java', 'javascript', 'cpp', 'x'))} END AS language FROM {CORPUS}",
)
def _(spark, sf):
    alias = X.pick((F.col("no") % 5).cast("int"), ("Python", "Java", "JavaScript", "C%2B%2B", "Perl"))
    return X.corpus(spark, sf).select("id", language_from_alias(alias).alias("language"))


@query(
    "e13_python_compiles",
    f"SELECT id, no % 3 <> 1 AS parse_ok, no % 3 = 0 AS compile_ok FROM {CORPUS} WHERE language = 'python'",
)
def _(spark, sf):
    # A third unparsable, a third that parses but does not compile.
    code = (
        F.when(F.col("no") % 3 == 1, F.concat("code", F.lit("def (:\n")))
        .when(F.col("no") % 3 == 2, F.concat("code", F.lit("return 1\n")))
        .otherwise(F.col("code"))
    )
    python = X.corpus(spark, sf).filter(F.col("language") == "python").withColumn("code", code)
    flags = A.with_tree(python, fields=("parse_ok", "compile_ok"))
    return flags.select("id", "tree.parse_ok", "tree.compile_ok")


@query(
    "e23_delta_cc",
    f"SELECT a.o_orderkey, CAST(abs({X.sql_cc('a.transformed_code')} - {X.sql_cc('c.code')}) AS INTEGER) AS delta_cc "
    f"FROM {ATTEMPTS} a JOIN {CORPUS} c ON c.id = a.function_id",
)
def _(spark, sf):
    pairs = _pairs(spark, sf)
    return pairs.select(
        "o_orderkey",
        S.delta_cc(
            M.keyword_complexity(F.col("code")), M.keyword_complexity(F.col("transformed_code"))
        ).alias("delta_cc"),
    )


def _pairs(spark, sf):
    c = X.corpus(spark, sf).select(F.col("id").alias("function_id"), "code", "language", "p_size")
    return spread(X.attempts(spark, sf).join(c, "function_id"))


def _diversity_sql(a: str, b: str) -> str:
    bare_a, bare_b = f"regexp_replace({a}, '\\s', '', 'g')", f"regexp_replace({b}, '\\s', '', 'g')"
    sa = f"len(regexp_extract_all({a}, '[{{}}()\\[\\];,]'))"
    sb = f"len(regexp_extract_all({b}, '[{{}}()\\[\\];,]'))"
    return (
        f"least(1.0, levenshtein({bare_a}, {bare_b})::DOUBLE / greatest(length({bare_a}), length({bare_b})) * "
        f"CASE WHEN abs({sa} - {sb}) > greatest({sa}, {sb}) * 0.2::DOUBLE THEN 1.2::DOUBLE ELSE 1.0::DOUBLE END)"
    )


@query(
    "e24_text_diversity",
    f"SELECT a.o_orderkey, round({_diversity_sql('c.code', 'a.transformed_code')}, 9) AS diversity "
    f"FROM {ATTEMPTS} a JOIN {CORPUS} c ON c.id = a.function_id",
)
def _(spark, sf):
    # A function's part is found once; with their texts functions are too wide for a broadcast.
    own = spread(X.corpus(spark, sf).select(F.col("id").alias("function_id"), "code"))
    own = SC.with_text_parts(own, "code", "structure")
    pairs = X.attempts(spark, sf).join(own.hint("merge"), "function_id")
    result = F.col("transformed_code")
    share = edit_shares(F.col("code"), without_whitespace(result))
    diversity = S.diversity_of_parts(share, F.col("structure"), S.structure_count(result))
    return pairs.select("o_orderkey", F.round(diversity, 9).alias("diversity"))


@query(
    "e25_tree_distance_bound",
    f"SELECT a.o_orderkey, round(CAST(22 * abs(a.reps - c.p_size % 17) AS DOUBLE) / "
    f"(8 + 22 * greatest(a.reps, c.p_size % 17)), 9) AS bound "
    f"FROM {ATTEMPTS} a JOIN {CORPUS} c ON c.id = a.function_id WHERE c.language = 'python'",
)
def _(spark, sf):
    # Every function is parsed once. With their trees they are too wide for a broadcast.
    python = X.corpus(spark, sf).filter(F.col("language") == "python")
    own = A.with_tree(python.select(F.col("id").alias("function_id"), "code"), "code", "ta", fields=A.DISTANCE_FIELDS)
    pairs = X.attempts(spark, sf).join(own.drop("code").hint("merge"), "function_id")
    trees = pairs.withColumn("tb", A.syntax_tree(F.col("transformed_code"), A.DISTANCE_FIELDS))
    bound = A.tree_distance_bound(F.col("ta"), F.col("tb"))
    return trees.select("o_orderkey", F.round(bound, 9).alias("bound"))


@query(
    "e26_effort",
    f"SELECT id, round(CASE WHEN v <= 0 THEN 1.0 ELSE 1.0 / (1.0 + v / 1000.0) END, 9) AS effort "
    f"FROM (SELECT id, {X.sql_volume('code')} AS v FROM {CORPUS})",
)
def _(spark, sf):
    e = S.effort(M.halstead_volume(F.col("code")))
    return spread(X.corpus(spark, sf)).select("id", F.round(e, 9).alias("effort"))


@query(
    "e27_se_score",
    f"SELECT l_orderkey, l_linenumber, l_partkey, round(delta_cc * preservation * preservation * diversity / effort, 6) AS se "
    f"FROM {X.RUN_LOG}",
)
def _(spark, sf):
    se = S.se_score(F.col("delta_cc"), F.col("preservation"), F.col("diversity"), F.col("effort"))
    return X.run_log(spark, sf).select(
        "l_orderkey", "l_linenumber", "l_partkey", F.round(se, 6).alias("se")
    )


@query(
    "e28_preservation",
    f"SELECT a.o_orderkey, CAST(CASE WHEN c.language <> 'python' THEN 1 ELSE coalesce(t.passed, 1) END AS INTEGER) AS preservation "
    f"FROM {ATTEMPTS} a JOIN {CORPUS} c ON c.id = a.function_id LEFT JOIN {TEST_RESULTS} t ON t.function_id = a.function_id",
)
def _(spark, sf):
    joined = SC.with_preservation(
        _pairs(spark, sf).select("o_orderkey", "function_id", "language"),
        X.test_results(spark, sf), ["function_id"],
    )
    return joined.select("o_orderkey", "preservation")


@query(
    "e37_suite_file_name",
    f"SELECT id, id || '_test' || {X.sql_pick('no % 4', X.EXTS)} AS file_name FROM {CORPUS}",
)
def _(spark, sf):
    return X.corpus(spark, sf).select(
        "id", suite_file_name(F.col("id"), F.col("language")).alias("file_name")
    )


_RULES_SQL = """(VALUES ('obfuscate','light',0.8::DOUBLE,1.2::DOUBLE,0.9::DOUBLE,1.1::DOUBLE), ('obfuscate','medium',NULL,1.5,1.2,1.5),
 ('obfuscate','heavy',NULL,2.0,1.5,NULL), ('deobfuscate','light',0.8,1.2,1.0,1.0), ('deobfuscate','medium',NULL,1.5,0.7,0.9),
 ('deobfuscate','heavy',NULL,2.0,0.5,0.7), ('refactor','light',0.8,1.2,0.9,1.1), ('refactor','medium',NULL,1.5,0.7,0.9),
 ('refactor','heavy',NULL,2.0,0.5,0.7)) r(task, intensity, loc_lo, loc_hi, cc_lo, cc_hi)"""


@query(
    "e38_intensity_conformance",
    f"""WITH p AS (SELECT a.o_orderkey, a.task, {X.sql_pick('a.o_orderkey % 3', ('light', 'medium', 'heavy'))} AS intensity,
    {X.sql_cc('c.code')}::DOUBLE AS cc0, {X.sql_cc('a.transformed_code')}::DOUBLE AS cc1,
    len(string_split({X.sql_norm('c.code')}, chr(10)))::DOUBLE AS l0,
    len(string_split({X.sql_norm('a.transformed_code')}, chr(10)))::DOUBLE AS l1
    FROM {ATTEMPTS} a JOIN {CORPUS} c ON c.id = a.function_id)
    SELECT o_orderkey, coalesce(l1 >= l0 * loc_lo, true) AND coalesce(l1 <= l0 * loc_hi, true) AS loc_ok,
    coalesce(cc1 >= cc0 * cc_lo, true) AND coalesce(cc1 <= cc0 * cc_hi, true) AS cc_ok
    FROM p JOIN {_RULES_SQL} USING (task, intensity)""",
)
def _(spark, sf):
    # A function is measured once, not once per result, and only numbers meet in the join.
    code, result = F.col("code"), F.col("transformed_code")
    before = spread(X.corpus(spark, sf)).select(
        F.col("id").alias("function_id"),
        M.keyword_complexity(code).alias("cc_before"),
        M.lines_of_code(code).alias("loc_before"),
    )
    after = spread(X.attempts(spark, sf)).select(
        "function_id",
        "o_orderkey",
        "task",
        X.pick((F.col("o_orderkey") % 3).cast("int"), ("light", "medium", "heavy")).alias("intensity"),
        M.keyword_complexity(result).alias("cc_after"),
        M.lines_of_code(result).alias("loc_after"),
    )
    pairs = after.join(before, "function_id")
    return Q.intensity_conformance(pairs).select("o_orderkey", "loc_ok", "cc_ok")


@query(
    "e39_sorted_import_hash",
    f"SELECT id, sha256('from a import b' || chr(10) || 'import m' || p_size || chr(10) || 'import z' || chr(10) || norm) AS h "
    f"FROM (SELECT id, p_size, {NORM} AS norm FROM {CORPUS})",
)
def _(spark, sf):
    code = F.concat(
        F.lit("import z\nfrom a import b\n"), F.col("code"), F.lit("\nimport m"), F.col("p_size").cast("string")
    )
    return spread(X.corpus(spark, sf)).select("id", M.sorted_import_hash(code).alias("h"))


# --- the scoring run --------------------------------------------------------------------------

_FIRST = (
    f"(SELECT * FROM {ATTEMPTS} QUALIFY row_number() OVER (PARTITION BY function_id, model, task, strategy "
    "ORDER BY timestamp, o_orderkey) = 1)"
)


def _pending(spark, sf):
    first = keep_first(
        X.attempts(spark, sf), ["function_id", "model", "task", "strategy"], ["timestamp", "o_orderkey"]
    )
    return first.select(
        "function_id", "model", "task", "strategy", "transformed_code", "se_score", "o_orderkey"
    )


_SCORED_SQL = f"""WITH s AS (SELECT a.o_orderkey, c.language,
    CAST(abs({X.sql_cc('a.transformed_code')} - {X.sql_cc('c.code')}) AS DOUBLE) AS delta_cc,
    CAST(CASE WHEN c.language <> 'python' THEN 1 ELSE coalesce(t.passed, 1) END AS INTEGER) AS preservation,
    {_diversity_sql('c.code', 'a.transformed_code')} AS diversity, {X.sql_volume('a.transformed_code')} AS v
    FROM {_FIRST} a JOIN {CORPUS} c ON c.id = a.function_id LEFT JOIN {TEST_RESULTS} t ON t.function_id = a.function_id),
    r AS (SELECT *, CASE WHEN v <= 0 THEN 1.0 ELSE 1.0 / (1.0 + v / 1000.0) END AS effort FROM s)"""


@query(
    "j1_score_transformations",
    f"{_SCORED_SQL} SELECT o_orderkey, language, delta_cc, preservation, round(diversity, 9) AS diversity, "
    "round(effort, 9) AS effort, round(delta_cc * preservation * preservation * diversity / effort, 6) AS se_score FROM r",
)
def _(spark, sf):
    results = _results_by_key(spark, sf)
    scored = SC.score(_pending(spark, sf), X.functions(spark, sf), results)
    return scored.select(
        "o_orderkey", "language", "delta_cc", "preservation", F.round("diversity", 9).alias("diversity"),
        F.round("effort", 9).alias("effort"), F.round("se_score", 6).alias("se_score"),
    )


def _results_by_key(spark, sf):
    """Suite outcomes per result: the suite's outcome for every result of its function."""
    keys = _pending(spark, sf).select("function_id", "model", "task", "strategy")
    return keys.join(X.test_results(spark, sf).select("function_id", "passed"), "function_id")


_TREES_SQL = f"""WITH p AS (SELECT a.*, c.language, c.code, c.language = 'python' AS py, c.p_size % 17 AS r FROM {_FIRST} a JOIN {CORPUS} c ON c.id = a.function_id),
    s AS (SELECT o_orderkey, language, CAST(abs(CASE WHEN py THEN 1 + 2 * reps ELSE {X.sql_cc('transformed_code')} END - {X.sql_cc('code')}) AS DOUBLE) AS delta_cc,
    CASE WHEN py THEN CAST(22 * abs(reps - r) AS DOUBLE) / (8 + 22 * greatest(reps, r)) ELSE {_diversity_sql('code', 'transformed_code')} END AS diversity,
    {X.sql_volume('transformed_code')} AS v FROM p),
    e AS (SELECT *, CASE WHEN v <= 0 THEN 1.0 ELSE 1.0 / (1.0 + v / 1000.0) END AS effort FROM s)
    SELECT o_orderkey, language, delta_cc, round(diversity, 9) AS diversity, round(effort, 9) AS effort,
    round(delta_cc * diversity / effort, 6) AS se_score FROM e"""


@query("j1_score_with_trees", _TREES_SQL)
def _(spark, sf):
    scored = SC.score(_pending(spark, sf), X.functions(spark, sf), None, use_trees=True)
    return scored.select(
        "o_orderkey", "language", "delta_cc", F.round("diversity", 9).alias("diversity"),
        F.round("effort", 9).alias("effort"), F.round("se_score", 6).alias("se_score"),
    )


@query(
    "j7_preservation_join",
    f"SELECT c.language, CAST(sum(CASE WHEN c.language <> 'python' THEN 1 ELSE coalesce(t.passed, 1) END) AS BIGINT) AS preserved, "
    f"CAST(count(t.passed) AS BIGINT) AS tested, CAST(count(*) AS BIGINT) AS n FROM {CORPUS} c LEFT JOIN {TEST_RESULTS} t ON t.function_id = c.id GROUP BY 1",
)
def _(spark, sf):
    c = X.corpus(spark, sf).select(F.col("id").alias("function_id"), "language")
    results = X.test_results(spark, sf)
    with_p = SC.with_preservation(c, results, ["function_id"]).join(
        results.select("function_id", "passed"), "function_id", "left"
    )
    return with_p.groupBy("language").agg(
        F.sum("preservation").alias("preserved"),
        F.count("passed").alias("tested"),
        F.count(F.lit(1)).alias("n"),
    )


@query(
    "a27_score_report",
    f"SELECT CAST(count(c.id) AS BIGINT) AS success, CAST(count(*) - count(c.id) AS BIGINT) AS failed, "
    f"CAST(count(*) AS BIGINT) AS total FROM {_FIRST} a LEFT JOIN (SELECT id FROM {CORPUS} WHERE no % 10 <> 0) c ON c.id = a.function_id",
)
def _(spark, sf):
    known = X.functions(spark, sf).filter(F.col("no") % 10 != 0)
    return SC.score_report(SC.score(_pending(spark, sf), known))


@query(
    "s14_merge_scores",
    f"SELECT CAST(count(*) AS BIGINT) AS n, CAST(count(se_score) AS BIGINT) AS scored, round(sum(se_score), 4) AS total FROM "
    f"(SELECT coalesce(se_score, delta_cc * preservation * preservation * diversity / effort) AS se_score FROM {X.RUN_LOG})",
)
def _(spark, sf):
    facts = X.run_log(spark, sf).select(
        "function_id", "model", "task", "strategy", "delta_cc", "preservation", "diversity", "effort", "se_score"
    )
    fresh = facts.filter(F.col("se_score").isNull()).withColumn(
        "se_score",
        S.se_score(F.col("delta_cc"), F.col("preservation"), F.col("diversity"), F.col("effort")),
    )
    merged = SC.merge_scores(facts, fresh)
    return merged.agg(
        F.count(F.lit(1)).alias("n"), F.count("se_score").alias("scored"),
        F.round(F.sum("se_score"), 4).alias("total"),
    )


@query(
    "x4_ast_nodes",
    "SELECT 'fn_' || p_partkey AS id, CAST(8 + 22 * (p_size % 17) AS BIGINT) AS nodes, "
    "CAST(p_size % 17 AS BIGINT) AS ifs FROM part WHERE p_partkey % 4 = 0",
)
def _(spark, sf):
    python = X.corpus(spark, sf).filter(F.col("language") == "python").select("id", "code")
    nodes = A.ast_nodes(A.with_tree(python, fields=A.NODE_FIELDS).drop("code"))
    return nodes.groupBy("id").agg(
        F.count(F.lit(1)).alias("nodes"), F.count_if(F.col("label") == "If").alias("ifs")
    )


@query(
    "x3_sql_functions",
    f"""SELECT {X.sql_tier("CAST(delta_cc * 4 AS INTEGER)")} AS tier, round(sum(delta_cc * preservation * preservation * diversity
    / (1.0 / (1.0 + l_extendedprice / 1000.0))), 4) AS se, CAST(sum(abs(l_linenumber - CAST(delta_cc AS INTEGER))) AS BIGINT) AS moved FROM {X.RUN_LOG} GROUP BY 1""",
)
def _(spark, sf):
    from refracta.functions import sql

    sql.register(spark)
    log = X.run_log(spark, sf)
    tier = F.expr("complexity_tier(int(delta_cc * 4))").alias("tier")
    se = F.expr("se_score(delta_cc, preservation, diversity, effort(l_extendedprice))")
    return log.groupBy(tier).agg(
        F.round(F.sum(se), 4).alias("se"),
        F.sum(F.expr("delta_cc(int(delta_cc), l_linenumber)")).alias("moved"),
    )
