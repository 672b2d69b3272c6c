"""Collecting functions: files, pages, duplicates, quotas, loads and their reports."""

from pyspark.sql import functions as F

from refracta import schemas
from refracta.functions import sql
from refracta.functions.domains import plausible_code, task_name_from_url
from refracta.functions.extraction import first_block, page_links, sections, unescape
from refracta.operators import collection as N
from refracta.operators import corpus as C
from refracta.operators import quality as Q
from refracta.operators.ordered import row_numbers
from refracta.operators.sampling import random_order
from refracta.plans import fixtures as X
from refracta.plans.fixtures import CORPUS, FUNCTIONS, sql_pick, sql_strip
from refracta.plans.registry import query
from refracta.session import scratch_path, spread
from refracta.sources import files as R
from refracta.sources import writers as W

# --- source files -----------------------------------------------------------------------------

_N = "no % 4"
_FIRST_LINE = sql_pick(_N, ("import os", "package x;", "'use strict';", "#pragma once"))
_SECOND = (
    f"{sql_pick(_N, ('def g', 'public int g', 'function g', 'int g'))} || '7' || substr(code, strpos(code, '('))"
)
_TEXT = f"({_FIRST_LINE} || chr(10) || code || chr(10) || {_SECOND})"
_PATH = (
    f"({sql_pick('no % 6', ('sorts', 'tests', 'lists', 'strings', 'math', 'misc'))} || '/' || "
    f"CASE WHEN no % 13 = 0 THEN 'test_unit' ELSE 'Unit' END || no || {sql_pick(_N, X.EXTS)})"
)
FILES = (
    f"(SELECT {_PATH} AS relative_path, CASE WHEN no % 11 = 0 THEN repeat({_TEXT} || chr(10), 40) ELSE {_TEXT} END AS text, "
    f"code AS first_code, {_SECOND} AS second_code, language, no, p_size FROM {CORPUS})"
)
_KEPT = (
    "no % 13 <> 0 AND no % 6 <> 1 AND octet_length(encode(text)) BETWEEN 100 AND 5000"
)


# A function as it is reported: Java headers take up to two preceding line ends along,
# which never decides about the limits here.
_SHOWN = "rtrim({0}, chr(10))"


@query("s6_source_files", f"SELECT relative_path, language FROM {FILES} WHERE {_KEPT}")
def _(spark, sf):
    return R.source_file_filter(X.source_files(spark, sf)).select("relative_path", "language")


def _extracted_sql(language: str, second_prefix: str, first_prefix: str = "") -> str:
    """All functions of every file, stated from the template instead of by matching.

    A large file repeats the template 40 times.

    A Java header takes the whitespace before it along; Python keeps whole lines.
    """
    cut = "rtrim({0}, chr(10))"
    first = f"{first_prefix}{cut.format('first_code')}"
    second = f"{second_prefix}{cut.format('second_code')}"
    return (
        f"SELECT relative_path, CAST(2 * k + seq AS INTEGER) AS seq, name, code FROM (SELECT relative_path, no, 0 AS seq, 'f' || p_size AS name, {first} AS code FROM {FILES} "
        f"WHERE language = '{language}' UNION ALL SELECT relative_path, no, 1, 'g7', {second} FROM {FILES} "
        f"WHERE language = '{language}'), range(40) r(k) WHERE (k = 0 OR no % 11 = 0) AND length(code) BETWEEN 50 AND 3000"
    )


def _functions_of(spark, sf, language):
    files = X.source_files(spark, sf).filter(F.col("language") == language)
    return N.file_functions(files).select("relative_path", "seq", "name", "code")


@query("e32_python_functions", _extracted_sql("python", ""))
def _(spark, sf):
    return _functions_of(spark, sf, "python")


@query("e33_java_functions", _extracted_sql("java", "chr(10) || chr(10) || ", "chr(10) || "))
def _(spark, sf):
    return _functions_of(spark, sf, "java")


@query("e34_javascript_functions", _extracted_sql("javascript", ""))
def _(spark, sf):
    return _functions_of(spark, sf, "javascript")


@query("e35_cpp_functions", _extracted_sql("cpp", ""))
def _(spark, sf):
    return _functions_of(spark, sf, "cpp")


@query(
    "e36_balanced_prefix",
    f"SELECT id, rtrim(code, chr(10)) AS code FROM {CORPUS} WHERE language <> 'python'",
)
def _(spark, sf):
    from refracta.functions.extraction import balanced_prefix

    braces = X.corpus(spark, sf).filter(F.col("language") != "python")
    longer = F.concat("code", F.lit("int x; { { } trailing"))
    return braces.select("id", balanced_prefix(longer).alias("code"))


@query(
    "x2_functions_per_file",
    f"SELECT language, CAST(sum(n) AS BIGINT) AS functions, CAST(count(*) AS BIGINT) AS files FROM (SELECT language, "
    f"CAST(length({_SHOWN.format('first_code')}) BETWEEN 50 AND 3000 AS INTEGER) + CAST(length({_SHOWN.format('second_code')}) BETWEEN 50 AND 3000 AS INTEGER) AS n "
    f"FROM {FILES} WHERE {_KEPT}) WHERE n > 0 GROUP BY language",
)
def _(spark, sf):
    found = N.file_functions(R.source_file_filter(X.source_files(spark, sf)))
    per_file = found.groupBy("language", "path").agg(F.count(F.lit(1)).alias("n"))
    return per_file.groupBy("language").agg(
        F.sum("n").alias("functions"), F.count(F.lit(1)).alias("files")
    )


@query(
    "x2_functions_lateral",
    f"SELECT language, CAST(sum(n) AS BIGINT) AS functions, CAST(count(*) AS BIGINT) AS files FROM (SELECT language, "
    f"CAST(length({_SHOWN.format('first_code')}) BETWEEN 50 AND 3000 AS INTEGER) + CAST(length({_SHOWN.format('second_code')}) BETWEEN 50 AND 3000 AS INTEGER) AS n "
    f"FROM {FILES} WHERE {_KEPT}) WHERE n > 0 AND language <> 'python' GROUP BY language",
)
def _(spark, sf):
    sql.register(spark)
    files = R.source_file_filter(X.source_files(spark, sf))
    per_file = spark.sql(
        "SELECT language, path, count(*) AS n FROM {files}, LATERAL file_functions(code, language) f GROUP BY language, path",
        files=spread(files.select("language", "path", "code")),
    )
    return per_file.groupBy("language").agg(F.sum("n").alias("functions"), F.count(F.lit(1)).alias("files"))


# --- pages -----------------------------------------------------------------------------------------

_ALIAS = sql_pick(_N, X.ALIASES)


@query(
    "e29_page_links",
    "SELECT page_id, CAST(len(l) AS INTEGER) AS links, array_to_string(l, '|') AS joined FROM (SELECT page_id, list_transform(list_filter("
    "list_distinct_ordered, lambda h: starts_with(h, '/') AND NOT contains(h, ':') AND h <> '/'), lambda h: 'https://x' || h) AS l FROM "
    "(SELECT page_id, list_filter(a, lambda x, i: list_position(a, x) = i) AS list_distinct_ordered FROM "
    "(SELECT page_id, regexp_extract_all(html, '<a [^>]*?href=\"([^\"]*)\"', 1) AS a FROM pages)))",
)
def _(spark, sf):
    links = page_links(F.col("html"), "/", "https://x")
    return X.table(spark, sf, "pages").select("page_id", links.alias("l")).select(
        "page_id", F.size("l").alias("links"), F.array_join("l", "|").alias("joined")
    )


@query(
    "u5_first_seen_links",
    """SELECT link, page_id, CAST(pos - 1 AS INTEGER) AS pos FROM (SELECT page_id, unnest(a) AS link, generate_subscripts(a, 1) AS pos FROM
    (SELECT page_id, list_filter(regexp_extract_all(html, '<a [^>]*?href="([^"]*)"', 1), lambda h: starts_with(h, '/') AND NOT contains(h, ':') AND h <> '/') AS r,
    list_filter(r, lambda x, i: list_position(r, x) = i) AS a FROM pages))
    QUALIFY row_number() OVER (PARTITION BY link ORDER BY page_id, pos) = 1""",
)
def _(spark, sf):
    links = X.table(spark, sf, "pages").select(
        "page_id", F.posexplode(page_links(F.col("html"), "/")).alias("pos", "link")
    )
    return C.keep_first(links, ["link"], ["page_id", "pos"])


@query(
    "e30_task_name_from_url",
    f"SELECT no AS page_id, task_name FROM {CORPUS}",
)
def _(spark, sf):
    return X.wiki_pages(spark, sf).select("page_id", task_name_from_url(F.col("url")).alias("task_name"))


@query(
    "x3_page_links_lateral",
    "SELECT page_id, CAST(list_position(l, h) AS INTEGER) AS position, 'https://x' || h AS link FROM (SELECT page_id, l, unnest(l) AS h FROM "
    "(SELECT page_id, list_filter(a, lambda h, i: starts_with(h, '/') AND NOT contains(h, ':') AND h <> '/' AND list_position(a, h) = i) AS l FROM "
    "(SELECT page_id, regexp_extract_all(html, '<a [^>]*?href=\"([^\"]*)\"', 1) AS a FROM pages)))",
)
def _(spark, sf):
    sql.register(spark)
    return spark.sql(
        "SELECT page_id, position, link FROM {pages}, LATERAL page_links(html, '/', 'https://x')",
        pages=X.table(spark, sf, "pages").select("page_id", "html"),
    )


@query(
    "e31_language_blocks",
    f"SELECT no AS page_id, {_ALIAS} AS alias, language, {sql_strip('code')} AS code FROM {CORPUS} "
    f"WHERE no % 5 <> 0 AND length({sql_strip('code')}) BETWEEN 50 AND 5000",
)
def _(spark, sf):
    return N.page_blocks(X.wiki_pages(spark, sf)).select("page_id", "alias", "language", "code")


_UNESCAPED = "replace(replace(replace(replace({0}, '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&amp;', '&')"


@query(
    "e31_page_paragraphs",
    f"""SELECT page_id, md5(list_filter(list_transform(regexp_extract_all(body, '(?is)<(?:p)\\b[^>]*>(.*?)</p>', 1),
    lambda b: {sql_strip(_UNESCAPED.format("regexp_replace(b, '<[^>]*>', '', 'g')"))}), lambda t: length(t) BETWEEN 50 AND 5000)[1]) AS block_md5
    FROM (SELECT page_id, substr(html, strpos(html, '<h1')) AS body FROM pages)""",
)
def _(spark, sf):
    after = F.element_at(sections(F.col("html"), r"<h1\b"), 2)
    return X.table(spark, sf, "pages").select(
        "page_id", F.md5(first_block(after, ("p",))).alias("block_md5")
    )


@query(
    "e31_unescape",
    f"SELECT page_id, md5({_UNESCAPED.format('html')}) AS m FROM pages",
)
def _(spark, sf):
    return X.table(spark, sf, "pages").select("page_id", F.md5(unescape(F.col("html"))).alias("m"))


@query(
    "e13_plausible_code",
    f"""SELECT id, CASE language WHEN 'java' THEN contains(code, 'class ') OR contains(code, 'interface ')
    WHEN 'javascript' THEN contains(code, 'function ') OR contains(code, '=>') OR contains(code, 'const ') OR contains(code, 'var ')
    WHEN 'cpp' THEN contains(code, '#include') OR contains(code, 'int ') OR contains(code, 'void ') ELSE no % 8 = 0 END AS plausible FROM {CORPUS}""",
)
def _(spark, sf):
    compiles = F.when(F.col("language") == "python", F.col("no") % 8 == 0)
    return X.corpus(spark, sf).select(
        "id", plausible_code(F.col("code"), F.col("language"), compiles).alias("plausible")
    )


_PLAUSIBLE = (
    "CASE language WHEN 'java' THEN contains(code, 'class ') OR contains(code, 'interface ') "
    "WHEN 'javascript' THEN contains(code, 'function ') OR contains(code, '=>') OR contains(code, 'const ') OR contains(code, 'var ') "
    "WHEN 'cpp' THEN contains(code, '#include') OR contains(code, 'int ') OR contains(code, 'void ') ELSE true END"
)
# One branch and one operator in every repetition of the Python template.
_TREE_CC = "CAST(CASE WHEN language = 'python' THEN 1 + 2 * (p_size % 17) ELSE {0} END AS INTEGER)"


@query(
    "s7_function_rows_from_pages",
    f"SELECT no AS page_id, language, code_hash, {_TREE_CC.format('cyclomatic_complexity')} AS cyclomatic_complexity, halstead_volume, lines_of_code, "
    f"domain, 'rosetta_code' AS source, {_PLAUSIBLE} AS plausible FROM {FUNCTIONS} WHERE no % 5 <> 0 AND length({sql_strip('code')}) BETWEEN 50 AND 5000",
)
def _(spark, sf):
    rows = N.from_pages(N.page_blocks(X.wiki_pages(spark, sf)))
    return rows.select(
        "page_id", "language", "code_hash", "cyclomatic_complexity", "halstead_volume",
        "lines_of_code", "domain", "source", "plausible",
    )


_PATH_DOMAIN = (
    "CASE WHEN regexp_matches(lower(relative_path), 'sort|search|dp|dynamic|graph|tree') THEN 'algorithms' "
    "WHEN regexp_matches(lower(relative_path), 'data_structure|list|stack|queue|hash') THEN 'data_structures' "
    "WHEN regexp_matches(lower(relative_path), 'string|text') THEN 'strings' "
    "WHEN regexp_matches(lower(relative_path), 'math|number') THEN 'math' WHEN regexp_matches(lower(relative_path), 'file|io') THEN 'io' ELSE 'other' END"
)


def _file_rows_sql() -> str:
    both = " UNION ALL ".join(
        f"SELECT relative_path, language, no, p_size, {seq} AS seq, {name} AS task_name, {code} AS code FROM {FILES} "
        f"WHERE {_KEPT} AND length({_SHOWN.format(code)}) BETWEEN 50 AND 3000"
        for seq, name, code in ((0, "'f' || p_size", "first_code"), (1, "'g7'", "second_code"))
    )
    found = f"(SELECT *, {_TREE_CC.format(X.sql_cc('code'))} AS cyclomatic_complexity FROM ({both}))"
    place = "CAST(row_number() OVER (PARTITION BY relative_path ORDER BY seq) - 1 AS INTEGER)"
    return (
        f"SELECT * FROM (SELECT relative_path, {place} AS seq, language, task_name, sha256({X.sql_norm('code')}) AS code_hash, "
        f"cyclomatic_complexity, {_PATH_DOMAIN} AS domain FROM {found}) WHERE cyclomatic_complexity >= 3"
    )


@query("x2_function_rows_from_files", _file_rows_sql())
def _(spark, sf):
    files = R.source_file_filter(X.source_files(spark, sf))
    rows = N.from_files(N.file_functions(files))
    return C.complex_enough(rows).select(
        "relative_path", "seq", "language", "task_name", "code_hash", "cyclomatic_complexity", "domain"
    )


# --- duplicates, quotas, ids ---------------------------------------------------------------------

_ORDERED = "ORDER BY md5(id || '1'), id"


def _candidates(spark, sf):
    f = X.functions(spark, sf)
    return f.withColumn("k", random_order(F.col("id"), "1"))


_FIRST_SQL = f"(SELECT * FROM {FUNCTIONS} QUALIFY row_number() OVER (PARTITION BY code_hash {_ORDERED}) = 1)"


@query("w4_keep_first_by_hash", f"SELECT id, code_hash FROM {_FIRST_SQL}")
def _(spark, sf):
    return C.keep_first(_candidates(spark, sf), ["code_hash"], ["k", "id"]).select("id", "code_hash")


@query(
    "w4_keep_first_documents",
    "SELECT doc_id FROM documents QUALIFY row_number() OVER (PARTITION BY text ORDER BY doc_id) = 1",
)
def _(spark, sf):
    docs = X.table(spark, sf, "documents").select("doc_id", F.sha2("text", 256).alias("h"))
    return C.keep_first(docs, ["h"], ["doc_id"]).select("doc_id")


_TARGETS = {"python": 15, "java": 15, "javascript": 10, "cpp": 10}
_TARGET_SQL = "CASE WHEN language IN ('python', 'java') THEN 15 ELSE 10 END"


@query(
    "w2_quota_take",
    f"SELECT id, language FROM {_FIRST_SQL} QUALIFY row_number() OVER (PARTITION BY language {_ORDERED}) <= {_TARGET_SQL}",
)
def _(spark, sf):
    first = C.keep_first(_candidates(spark, sf), ["code_hash"], ["k", "id"])
    return C.take_quota(first, _TARGETS, ["k", "id"]).select("id", "language")


@query(
    "w3_sequence_ids",
    f"SELECT id, format('{{}}_rc_{{:03d}}', language, row_number() OVER (PARTITION BY language {_ORDERED}) - 1) AS new_id FROM {CORPUS}",
)
def _(spark, sf):
    c = X.corpus(spark, sf).select("id", "language", random_order(F.col("id"), "1").alias("k"))
    return C.with_sequence_id(c, "rc", ["k", "id"], "new_id").select("id", "new_id")


@query(
    "w3_collected_corpus",
    f"SELECT id, format('{{}}_ta_{{:03d}}', language, row_number() OVER (PARTITION BY language {_ORDERED}) - 1) AS new_id FROM "
    f"(SELECT * FROM {_FIRST_SQL} QUALIFY row_number() OVER (PARTITION BY language {_ORDERED}) <= {_TARGET_SQL})",
)
def _(spark, sf):
    rows = _candidates(spark, sf).withColumnRenamed("id", "origin")
    got = C.collect_functions(rows, _TARGETS, "ta", ["k", "origin"])
    return got.select(F.col("origin").alias("id"), F.col("id").alias("new_id"))


_KNOWN = f"(SELECT code_hash FROM {FUNCTIONS} WHERE p_size < 10)"


@query("j8_unknown_hashes", f"SELECT id FROM {FUNCTIONS} WHERE code_hash NOT IN {_KNOWN}")
def _(spark, sf):
    f = X.functions(spark, sf)
    return C.not_in(f.select("id", "code_hash"), f.filter(F.col("p_size") < 10)).select("id")


@query("u4_seen_hashes", f"SELECT code_hash, CAST(count(*) AS BIGINT) AS copies FROM {FUNCTIONS} GROUP BY 1 HAVING count(*) > 1")
def _(spark, sf):
    return C.repeated_keys(X.functions(spark, sf))


# --- loads -----------------------------------------------------------------------------------------

_STATUS_SQL = f"""(SELECT *, CASE WHEN no % 50 = 49 THEN 'error' WHEN code_hash IN (SELECT code_hash FROM {FUNCTIONS} WHERE no % 3 = 0 AND p_size < 10) THEN 'duplicate'
  WHEN row_number() OVER (PARTITION BY code_hash, no % 50 = 49 ORDER BY no) > 1 THEN 'duplicate' ELSE 'inserted' END AS status
  FROM {FUNCTIONS} WHERE no % 3 <> 0 OR p_size >= 10)"""


def _flagged(spark, sf):
    stored = (F.col("no") % 3 == 0) & (F.col("p_size") < 10)
    existing = X.functions(spark, sf, stored)
    new = X.functions(spark, sf, ~stored).withColumn(
        "lines_of_code", F.when(F.col("no") % 50 == 49, 0).otherwise(F.col("lines_of_code"))
    )
    return C.flag_insert(new, existing, "no")


@query("s11_insert_flags", f"SELECT id, status FROM {_STATUS_SQL}")
def _(spark, sf):
    return _flagged(spark, sf).select("id", "status")


@query(
    "s11_load_report",
    f"SELECT count(*) AS total, count(*) FILTER (status = 'inserted') AS inserted, count(*) FILTER (status = 'duplicate') AS duplicates, "
    f"count(*) FILTER (status = 'error') AS errors FROM {_STATUS_SQL}",
)
def _(spark, sf):
    return C.load_report(_flagged(spark, sf))


@query(
    "a23_collection_counters",
    f"""WITH s AS (SELECT status, language, complexity_tier AS tier FROM {_STATUS_SQL})
    SELECT counter, CAST(count(*) AS BIGINT) AS n FROM (SELECT 'collected' AS counter FROM s WHERE status = 'inserted'
    UNION ALL SELECT 'language:' || language FROM s WHERE status = 'inserted' UNION ALL SELECT 'tier:' || tier FROM s WHERE status = 'inserted'
    UNION ALL SELECT status FROM s WHERE status <> 'inserted') GROUP BY counter""",
)
def _(spark, sf):
    return C.collection_counters(_flagged(spark, sf))


_STORED = "(no % 3 = 0 AND p_size < 10)"


@query(
    "s11_next_version",
    f"""SELECT id, language, code_hash, domain, task_name, validated FROM {FUNCTIONS} WHERE {_STORED} UNION ALL
    (SELECT id, language, code_hash, CASE WHEN no % 4 = 0 THEN 'other' ELSE domain END, CASE WHEN no % 7 = 0 THEN '' ELSE task_name END, false
    FROM {FUNCTIONS} WHERE NOT {_STORED} AND code_hash NOT IN (SELECT code_hash FROM {FUNCTIONS} WHERE {_STORED})
    QUALIFY row_number() OVER (PARTITION BY code_hash ORDER BY no) = 1)""",
)
def _(spark, sf):
    # A load of the whole corpus from JSONL into a table that holds a part of it.
    f, base = X.functions(spark, sf), scratch_path(spark, "load")
    f.filter(_STORED).select(
        "id", "language", "code", "code_hash", "cyclomatic_complexity", "lines_of_code", "domain", "source",
        "task_name", "validated",
    ).write.parquet(f"{base}/v1")
    exported = f.withColumns(
        {
            "domain": F.when(F.col("no") % 4 != 0, F.col("domain")),
            "task_name": F.when(F.col("no") % 7 != 0, F.col("task_name")),
        }
    ).select(
        "id", "language", "code", "code_hash", "cyclomatic_complexity", "halstead_volume", "lines_of_code",
        "domain", "source", "task_name",
    )
    W.write_function_jsonl(exported, f"{base}/jsonl")
    loaded = R.read_function_jsonl(spark, f"{base}/jsonl").withColumn("no", F.substring("id", 4, 20).cast("bigint"))
    C.next_version(spark.read.parquet(f"{base}/v1"), loaded, "no").write.parquet(f"{base}/v2")
    return spark.read.parquet(f"{base}/v2").select("id", "language", "code_hash", "domain", "task_name", "validated")


@query(
    "a12_counts_by_language_and_tier",
    f"""SELECT 'language' AS dimension, language AS value, CAST(count(*) AS BIGINT) AS functions FROM {FUNCTIONS} GROUP BY language
    UNION ALL SELECT 'tier', complexity_tier, CAST(count(*) AS BIGINT) FROM {FUNCTIONS} GROUP BY complexity_tier""",
)
def _(spark, sf):
    return C.counts_by_language_and_tier(X.functions(spark, sf))


_CHECK_SQL = f"""(SELECT l AS language, CAST(r AS BIGINT) AS required, CAST(coalesce(n, 0) AS BIGINT) AS actual,
  coalesce(n, 0) * 100.0::DOUBLE / r AS pct, coalesce(n, 0) >= r * 0.9 AS ok FROM (VALUES ('python', 150), ('java', 900), ('javascript', 40), ('cpp', 20000)) t(l, r)
  LEFT JOIN (SELECT language, count(*) AS n FROM {CORPUS} GROUP BY 1) c ON c.language = t.l)"""


def _check(spark, sf):
    required = {"python": 150, "java": 900, "javascript": 40, "cpp": 20000}
    return C.distribution_check(X.corpus(spark, sf), required)


@query(
    "a13_distribution_check",
    f"SELECT language, required, actual, round(pct, 6) AS pct, ok FROM {_CHECK_SQL}",
)
def _(spark, sf):
    return X.rounded(_check(spark, sf))


@query(
    "a13_distribution_verdict",
    f"SELECT CAST(sum(actual) AS BIGINT) AS functions, bool_and(ok) AND sum(actual) >= 450 AS ok FROM {_CHECK_SQL}",
)
def _(spark, sf):
    return C.distribution_verdict(_check(spark, sf))


@query(
    "u3_schema_gaps",
    f"""SELECT g.*, CASE g."table" WHEN 'functions' THEN CAST((SELECT count(*) FROM {CORPUS}) AS BIGINT)
    ELSE CAST((SELECT count(*) FROM {X.RUN_LOG}) AS BIGINT) END AS rows FROM (VALUES ('functions', 'created_at', 'timestamp_ntz'),
    ('transformations', 'transformed_code', 'string')) g("table", "column", "type")""",
)
def _(spark, sf):
    tables = {"functions": X.functions(spark, sf), "transformations": X.run_log(spark, sf)}
    gaps = Q.schema_gaps(
        tables, {"functions": schemas.FUNCTIONS, "transformations": schemas.TRANSFORMATIONS}
    )
    sizes = [
        df.groupBy(F.lit(name).alias("table")).agg(F.count(F.lit(1)).alias("rows"))
        for name, df in tables.items()
    ]
    return gaps.join(sizes[0].union(sizes[1]), "table")


_CONTRACT = {
    "functions": (FUNCTIONS, schemas.FUNCTIONS, "created_at"),
    "transformations": (X.RUN_LOG, schemas.TRANSFORMATIONS, "transformed_code"),
}


def _contract_sql(name, rows, schema, missing):
    """Counts of one table, its columns as rows. All columns but ``missing`` are there."""
    counts = ", ".join(f"count({f.name}) AS {f.name}" for f in schema.fields if f.name != missing)
    cells = ", ".join(
        f"('{f.name}', '{f.dataType.simpleString()}', {f.nullable}, {'NULL' if f.name == missing else f.name})" for f in schema.fields
    )
    return (
        f"""SELECT '{name}' AS "table", c."column", c."type", c.found IS NOT NULL AS present, c.found IS NOT NULL AS right_type, n AS rows,
        n - coalesce(c.found, 0) AS nulls, c.found IS NULL OR (NOT c.nullable AND c.found < n) AS broken
        FROM (SELECT count(*) AS n, {counts} FROM {rows}) t, LATERAL (VALUES {cells}) c("column", "type", nullable, found)"""
    )


@query("u3_contract_report", " UNION ALL ".join(_contract_sql(name, *parts) for name, parts in _CONTRACT.items()))
def _(spark, sf):
    tables = {"functions": X.functions(spark, sf), "transformations": X.run_log(spark, sf)}
    return Q.contract_report(tables, {name: schema for name, (_rows, schema, _missing) in _CONTRACT.items()})


@query(
    "o6_shuffled_numbers",
    "SELECT doc_id, CAST(row_number() OVER (PARTITION BY lang ORDER BY md5(doc_id || 'z'), doc_id) AS BIGINT) AS place FROM documents",
)
def _(spark, sf):
    docs = X.table(spark, sf, "documents").select(
        "doc_id", "lang", random_order(F.col("doc_id"), "z").alias("k")
    )
    return row_numbers(docs, ["k", "doc_id"], "place", ["lang"]).select("doc_id", "place")
