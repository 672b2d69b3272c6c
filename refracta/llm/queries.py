"""The registered queries of the text operators, with SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from refracta.llm import (
    decontaminate,
    exact_dedup,
    jaccard_join,
    language_id,
    licenses,
    mixing,
    negatives,
    sharding,
    token_counts,
    tool_calls,
    toxicity,
    url_filter,
    whitening,
)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


OP1_SQL = """
WITH RECURSIVE doc AS (
    SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents
), shingled AS (
    SELECT doc_id, list_sort(list_distinct([array_to_string(w[i:i + 4], ' ') FOR i IN range(1, greatest(len(w) - 4, 1) + 1)])) AS s
    FROM doc WHERE len(w) > 0
), keyed AS (
    SELECT doc_id, md5(array_to_string(s, chr(10))) AS node, s FROM shingled
), node AS (
    SELECT node, any_value(s) AS s, count(*) AS documents, min(doc_id) AS least_id FROM keyed GROUP BY node
), item AS (
    SELECT node, len(s) AS n, unnest(s) AS x FROM node
), link AS (
    SELECT a.node AS a, b.node AS b FROM item a JOIN item b ON a.x = b.x AND a.node <> b.node
    GROUP BY a.node, b.node, a.n, b.n HAVING count(*) >= 0.8::DOUBLE * (a.n + b.n - count(*)) - 1e-9::DOUBLE
), reached AS (
    SELECT node AS a, node AS b FROM node
    UNION
    SELECT r.a, l.b FROM reached r JOIN link l ON l.a = r.b
), class AS (
    SELECT r.a AS node, min(n.least_id) AS class_id FROM reached r JOIN node n ON n.node = r.b GROUP BY r.a
), counted AS (
    SELECT l.a AS node, sum(n.documents) AS links, count(*) AS linked_texts FROM link l JOIN node n ON n.node = l.b GROUP BY l.a
)
SELECT doc_id, coalesce(class_id, doc_id) AS class_id, (coalesce(links, 0) + coalesce(documents, 1) - 1)::BIGINT AS links,
    coalesce(linked_texts, 0)::BIGINT AS linked_texts, coalesce(documents, 1)::BIGINT AS copies
FROM doc LEFT JOIN keyed USING (doc_id) LEFT JOIN node USING (node) LEFT JOIN class USING (node) LEFT JOIN counted USING (node)
"""


@_query("op1_jaccard_join", OP1_SQL)
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Class and number of links of every document, five words, similarity 0.8 or more."""
    return jaccard_join.jaccard_classes(_table(spark, sf_dir, "documents")).drop("text_key", "class_root")


#: The tools that the conversations are read as calls of.
TOOLS = {
    "search": {"query": ("string", True), "limit": ("integer", True), "after": ("string", False)},
    "quote": {"query": ("string", True), "limit": ("number", False), "after": ("string", False)},
    "send": {"query": ("string", True), "after": ("string", True)},
}

OP2_SQL = """
WITH turns AS (
    SELECT conv_id, turn, role, coalesce(text, '') AS text, length(coalesce(text, '')) AS n FROM conversations
), raw AS (
    SELECT conv_id, turn, 'c' || conv_id || '-' || turn AS call_id,
        CASE WHEN n % 11 = 0 THEN 'lookup' ELSE ['search', 'quote', 'send'][1 + (n % 3)] END AS name, n, text,
        CASE WHEN turn >= 2 THEN 'c' || conv_id || '-' || (turn - 2) END AS after,
        CASE WHEN n % 23 = 0 THEN [turn + 2] WHEN n % 29 = 0 THEN [turn - 2, turn - 4] ELSE [turn - 2] END AS needs
    FROM turns WHERE role = 'assistant'
), calls AS (
    SELECT *, json_object(
        'after', after, 'limit', CASE WHEN n % 7 = 0 THEN to_json('all') ELSE to_json(n % 50) END, 'query', text
    )::VARCHAR AS full_args FROM raw
), args AS (
    SELECT *, CASE WHEN n % 13 = 0 THEN NULL WHEN n % 19 = 0 THEN json_array(text)::VARCHAR
        WHEN after IS NULL THEN regexp_replace(full_args, '^\\{"after":null,', '{')
        ELSE full_args END AS args FROM calls
), answers AS (
    SELECT conv_id, 'c' || conv_id || '-' || (turn - 1) AS call_id, min(turn) AS turn, min(text) AS content, count(*) AS k
    FROM turns WHERE role = 'user' GROUP BY ALL
), needed AS (
    SELECT DISTINCT a.conv_id, a.call_id, p.call_id AS needs
    FROM (SELECT conv_id, call_id, unnest(needs) AS turn FROM args) a JOIN args p ON p.conv_id = a.conv_id AND p.turn = a.turn
), many AS (
    SELECT conv_id, count(*) AS calls FROM args GROUP BY conv_id
), chain AS (
    -- A way as long as the conversation has calls meets one of them twice.
    WITH RECURSIVE up AS (
        SELECT conv_id, call_id, call_id AS at, 0 AS depth FROM args
        UNION
        SELECT u.conv_id, u.call_id, e.needs, u.depth + 1 FROM up u JOIN needed e ON e.conv_id = u.conv_id AND e.call_id = u.at
            JOIN many m ON m.conv_id = u.conv_id WHERE u.depth < m.calls
    ) SELECT conv_id, call_id, CASE WHEN max(depth) < any_value(calls) THEN max(depth) END AS depth
    FROM up JOIN many USING (conv_id) GROUP BY conv_id, call_id
), judged AS (
    SELECT a.*, c.depth, r.content, coalesce(r.k, 0) AS k,
        CASE WHEN name = 'lookup' THEN ['tool'] WHEN n % 13 = 0 THEN ['malformed'] WHEN n % 19 = 0 THEN ['not_object'] ELSE list_sort(list_concat(
            CASE WHEN name = 'send' AND after IS NULL THEN ['missing:after'] ELSE [] END, list_concat(
            CASE WHEN name <> 'send' AND n % 7 = 0 THEN ['type:limit'] ELSE [] END,
            CASE WHEN name = 'send' THEN ['unknown:limit'] ELSE [] END))) END AS errs
    FROM args a JOIN chain c USING (conv_id, call_id) LEFT JOIN answers r USING (conv_id, call_id)
), rows AS (
    SELECT conv_id, turn, call_id,
        CASE WHEN depth IS NULL THEN 'cycle' WHEN len(errs) > 0 THEN 'invalid' WHEN content IS NULL THEN 'unanswered' ELSE 'ok' END AS status,
        depth, array_to_string(errs, ',') AS errors, k AS n_results,
        '{"arguments":' || coalesce(args, 'null') || ',"errors":' || to_json(errs)::VARCHAR || ',"id":' ||
        to_json(call_id)::VARCHAR || ',"name":' || to_json(name)::VARCHAR || ',"result":' ||
        coalesce(to_json(content)::VARCHAR, 'null') || '}' AS json, CASE WHEN depth IS NULL THEN 1 ELSE 0 END AS last
    FROM judged
    UNION ALL
    SELECT conv_id, turn, call_id, 'orphan', NULL, '', k,
        '{"arguments":null,"errors":[],"id":' || to_json(call_id)::VARCHAR || ',"name":null,"result":' ||
        to_json(content)::VARCHAR || '}', 2
    FROM answers r WHERE NOT EXISTS (SELECT 1 FROM args a WHERE a.conv_id = r.conv_id AND a.call_id = r.call_id)
    UNION ALL
    SELECT conv_id, turn, NULL, 'message', NULL, '', 0,
        '{"content":' || to_json(text)::VARCHAR || ',"role":' || coalesce(to_json(role)::VARCHAR, 'null') || '}', 3
    FROM turns WHERE coalesce(role, '') NOT IN ('assistant', 'user')
)
SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY last, depth NULLS FIRST, turn, call_id, json) AS position,
    turn, call_id, status, depth::BIGINT AS depth, errors, n_results, json FROM rows
"""


@_query("op2_tool_calls", OP2_SQL)
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every assistant turn read as a tool call, every user turn as the result of the one before,
    any other turn as a message.

    The arguments are the whole turn and a number; by its length some are malformed, no object,
    break their schema or call an unknown tool. A call comes after the assistant's call two turns
    before, where there is one; by its length, some also after the one four turns before, and some
    after the one two turns later instead, which may close a cycle.
    """
    turns = _table(spark, sf_dir, "conversations").select(
        "conv_id", "turn", "role", F.coalesce("text", F.lit("")).alias("text")
    )
    n = F.char_length("text")

    def call_id(turn):
        return F.concat(F.lit("c"), F.col("conv_id"), F.lit("-"), turn)

    after = F.when(F.col("turn") >= 2, call_id(F.col("turn") - 2))
    texts = F.to_json(F.struct(F.col("text").alias("query"), F.lit("all").alias("limit"), after.alias("after")))
    numbers = F.to_json(F.struct(F.col("text").alias("query"), (n % 50).alias("limit"), after.alias("after")))
    arguments = F.when(n % 19 == 0, F.to_json(F.array("text"))).when(n % 7 == 0, texts).otherwise(numbers)
    near = F.when(n % 23 == 0, F.array(call_id(F.col("turn") + 2))).when(
        n % 29 == 0, F.array(call_id(F.col("turn") - 2), call_id(F.col("turn") - 4))
    )
    tool = F.element_at(F.array(*[F.lit(t) for t in ("search", "quote", "send")]), n % 3 + 1)
    calls = turns.filter("role = 'assistant'").select(
        "conv_id",
        "turn",
        call_id(F.col("turn")).alias("call_id"),
        F.when(n % 11 == 0, "lookup").otherwise(tool).alias("name"),
        F.when(n % 13 == 0, F.substring(arguments, F.lit(1), F.char_length(arguments) - 1)).otherwise(arguments).alias("arguments"),
        near.otherwise(F.array(call_id(F.col("turn") - 2))).alias("after"),
    )
    results = turns.filter("role = 'user'").select(
        "conv_id", "turn", call_id(F.col("turn") - 1).alias("call_id"), F.col("text").alias("content")
    )
    other = turns.filter("coalesce(role, '') NOT IN ('assistant', 'user')")
    return tool_calls.linked(calls, results, TOOLS, other.withColumnRenamed("text", "content"))


OP3_SQL = """
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
    doc_id = max(doc_id) OVER g AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW g AS (PARTITION BY coalesce(text, ''))
"""


@_query("op3_exact_dedup", OP3_SQL)
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which documents stay when only the largest doc_id of each text does."""
    return exact_dedup.exact_dedup(_table(spark, sf_dir, "documents"))


@_query("op4_token_counts")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every document under the unigram vocabulary."""
    return token_counts.token_counts(_table(spark, sf_dir, "documents"), token_counts.vocabulary())


OP5_SQL = """
WITH sized AS (
    SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS size,
        ('0x' || substr(md5('17|' || coalesce(doc_id::VARCHAR, '') || '|' || coalesce(text, '')), 1, 15))::BIGINT AS key
    FROM documents
), totals AS (
    SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source IS NULL, source) AS place
    FROM sized GROUP BY source
), weighed AS (
    SELECT *, source_size * 3::DOUBLE AS bound, [5::DOUBLE, 2, 1][1 + (place - 1) % 3] AS weight FROM totals
), filled AS (
    SELECT *, bound / weight AS ratio,
        (sum(source_size) OVER ()::DOUBLE - coalesce(sum(bound) OVER before, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER before, 0)) AS share
    FROM weighed WINDOW before AS (ORDER BY bound / weight, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), targets AS (
    SELECT source, source_size, CASE WHEN ratio <= share THEN bound
        ELSE weight * (SELECT share FROM filled WHERE ratio > share ORDER BY ratio, place LIMIT 1) END AS target
    FROM filled
), facts AS (
    SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS rounds FROM targets
), placed AS (
    SELECT d.*, source_size, target, rounds, target - rounds * source_size AS rest,
        sum(size) OVER (PARTITION BY d.source ORDER BY key, doc_id ROWS UNBOUNDED PRECEDING) - size AS before
    FROM sized d JOIN facts f ON d.source IS NOT DISTINCT FROM f.source
), cut AS (
    SELECT source, min({'key': key, 'doc_id': doc_id}) AS cut FROM placed WHERE before + size > rest GROUP BY source
), parts AS (
    SELECT p.source, cut, floor((max(rest) - min(before)) / count(*)) AS part
    FROM placed p JOIN cut c ON p.source IS NOT DISTINCT FROM c.source AND {'key': key, 'doc_id': doc_id} = cut GROUP BY p.source, cut
)
SELECT doc_id, size::BIGINT AS size, source_size, target, (size * rounds + CASE
    WHEN {'key': key, 'doc_id': doc_id} < cut THEN size WHEN {'key': key, 'doc_id': doc_id} = cut THEN part ELSE 0 END)::BIGINT AS taken
FROM placed p LEFT JOIN parts c ON p.source IS NOT DISTINCT FROM c.source
"""


@_query("op5_mixing", OP5_SQL)
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many words of each document the mix of all sources takes."""
    return mixing.mix_plan(_table(spark, sf_dir, "documents"))


@_query("op6_language_id")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document."""
    return language_id.languages(_table(spark, sf_dir, "documents"))


OP7_SQL = """
WITH RECURSIVE crc_table AS MATERIALIZED (
    SELECT list_transform(range(256), lambda i: list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0],
        lambda c, zero: xor(c >> 1, 3988292384 * (c & 1)))) AS t
), summed AS MATERIALIZED (
    SELECT text, xor(list_reduce(list_prepend(4294967295, list_transform(regexp_extract_all(hex(encode(text)), '..'),
        lambda two: ('0x' || two)::BIGINT)), lambda c, b: xor(c >> 8, t[1 + (xor(c, b) & 255)])), 4294967295) AS crc
    FROM (SELECT DISTINCT coalesce(text, '') AS text FROM documents), crc_table
), keyed AS (
    SELECT doc_id, coalesce(text, '') AS text, md5(coalesce(doc_id::VARCHAR, '') || '|' || coalesce(text, '')) AS key FROM documents
), numbered AS (
    SELECT *, row_number() OVER (PARTITION BY key) - 1 AS number FROM keyed
), slotted AS (
    SELECT *, strlen(text) + 8 AS size, ('0x' || substr(md5(key || '|' || number), 1, 15))::BIGINT % 16384 AS virtual_slot FROM numbered
), filled AS MATERIALIZED (
    SELECT virtual_slot, bytes, row_number() OVER (ORDER BY bytes DESC, virtual_slot) AS turn
    FROM (SELECT virtual_slot, sum(size)::BIGINT AS bytes FROM slotted GROUP BY virtual_slot)
), placed AS (
    SELECT 0::BIGINT AS turn, -1::BIGINT AS virtual_slot, 0 AS shard, list_transform(range(24), lambda i: 0::BIGINT) AS loads
    UNION ALL
    SELECT f.turn, f.virtual_slot, list_position(loads, list_min(loads)) - 1,
        list_transform(loads, lambda load, i: CASE WHEN i = list_position(loads, list_min(loads)) THEN load + f.bytes ELSE load END)
    FROM placed p JOIN filled f ON f.turn = p.turn + 1
)
SELECT doc_id, size::BIGINT AS size, crc::BIGINT AS text_crc32, 'bytes' AS law, shard::INTEGER AS shard,
    row_number() OVER (PARTITION BY shard ORDER BY virtual_slot, key, number) - 1 AS slot,
    NULL::INTEGER AS grown_shard, virtual_slot::INTEGER AS virtual_slot
FROM slotted JOIN placed USING (virtual_slot) JOIN summed USING (text)
"""


@_query("op7_sharding", OP7_SQL)
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The shard of every document, of 24 with equal bytes."""
    return sharding.shard(_table(spark, sf_dir, "documents"))


@_query("op8_toxicity")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The toxicity of every document."""
    return toxicity.toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


#: The rules of the page filter.
URL_RULES = (
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
)

OP9_SQL = """
WITH parts AS (
    SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages
), named AS (
    SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
        regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM parts
), rules(verdict, rhost, rpath) AS (
    VALUES ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'),
        ('allow', 'com', '/fr/'), ('block', 'com', '/de/')
), best AS (
    SELECT page_id, arg_max(rhost || rpath, length(rhost || rpath)) AS rule, arg_max(verdict, length(rhost || rpath)) AS verdict
    FROM named JOIN rules ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath) GROUP BY page_id
)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM named LEFT JOIN best USING (page_id)
"""


@_query("op9_url_filter", OP9_SQL)
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The verdict on the url of every page."""
    return url_filter.judged(_table(spark, sf_dir, "pages"), URL_RULES)


OP10_SQL = """
WITH doc AS (
    SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents
), item AS (
    SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM benchmark
), size AS (
    SELECT DISTINCT least(10, len(w)) AS k FROM item WHERE len(w) > 0
), window_of AS (
    SELECT DISTINCT item_id, least(10, len(w)) AS k, array_to_string(list_slice(w, i, i + least(10, len(w)) - 1), ' ') AS x
    FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 10, 0) + 2)) AS i FROM item WHERE len(w) > 0)
), place AS (
    SELECT doc_id, k, i, array_to_string(list_slice(w, i, i + k - 1), ' ') AS x
    FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM doc, size WHERE len(w) >= k)
), hit AS (
    SELECT p.doc_id, p.i, p.k, v.item_id FROM place p JOIN window_of v ON v.k = p.k AND v.x = p.x
), counted AS (
    SELECT doc_id, count(DISTINCT j) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS j FROM hit) GROUP BY doc_id
), items AS (
    SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS ids
    FROM hit GROUP BY doc_id
), spans AS (
    SELECT doc_id, max(n) AS longest_span FROM (
        SELECT doc_id, r, count(*) AS n FROM (
            SELECT doc_id, j, j - row_number() OVER (PARTITION BY doc_id ORDER BY j) AS r
            FROM (SELECT DISTINCT doc_id, unnest(range(i, i + k)) AS j FROM hit)
        ) GROUP BY doc_id, r
    ) GROUP BY doc_id
)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
    sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated,
    coalesce(longest_span, 0)::BIGINT AS longest_span
FROM doc LEFT JOIN counted USING (doc_id) LEFT JOIN items USING (doc_id) LEFT JOIN spans USING (doc_id)
"""


@_query("op10_decontamination", OP10_SQL)
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which words of every document occur in windows of the benchmark."""
    return decontaminate.contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def _license_sql() -> str:
    """The positions of all template words as a table, joined with the words of the documents."""
    postings = ", ".join(
        f"({k}, '{t.label}', {t.base}, {p}, '{w}', {p in t.needed})"
        for k, t in enumerate(licenses.TEMPLATES)
        for p, w in enumerate(t.words)
    )
    return f"""
WITH posting(k, label, base, pos, word, needed) AS (
    VALUES {postings}
), doc AS (
    SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents
), place AS (
    SELECT r, i - 1 AS i, w[i] AS word FROM (SELECT r, w, unnest(range(1, len(w) + 1)) AS i FROM doc)
    WHERE w[i] IN (SELECT word FROM posting)
), seen AS (
    SELECT word, count(DISTINCT r) AS df FROM place GROUP BY word
), weighed AS (
    SELECT p.*, length(bin(((SELECT count(*) FROM doc) + 1) // (coalesce(df, 0) + 1))) AS weight FROM posting p LEFT JOIN seen USING (word)
), template AS (
    SELECT k, sum(weight) AS total, count(*) FILTER (needed) AS n_needed FROM weighed GROUP BY k
), aligned AS (
    SELECT r, k, label, base, i - pos AS start, sum(weight) AS matched
    FROM place JOIN weighed USING (word) GROUP BY r, k, label, base, i - pos
    HAVING count(*) FILTER (needed) = (SELECT n_needed FROM template t WHERE t.k = weighed.k)
), found AS (
    SELECT r, label, base, start, matched::DOUBLE / total AS share FROM aligned JOIN template USING (k)
), counted AS (
    SELECT r, count(*) FILTER (base) AS n_base, min(start) FILTER (base) AS first_word, max(start) FILTER (base) AS last_word,
        string_agg(DISTINCT label, ',' ORDER BY label) FILTER (base) AS base_labels,
        string_agg(DISTINCT label, ',' ORDER BY label) FILTER (base OR share >= 0.5) AS labels, max(share) AS score
    FROM found GROUP BY r
)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word::BIGINT AS first_word,
    last_word::BIGINT AS last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels,
    coalesce(score, 0::DOUBLE) AS score
FROM doc LEFT JOIN counted USING (r)
"""


@_query("op11_license_scan", _license_sql())
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The licences that every document names."""
    return licenses.licenses(_table(spark, sf_dir, "documents"))


@_query("op12_whitening")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every embedding on the first 16 principal components, whitened; a row per component."""
    found = whitening.whiten(_table(spark, sf_dir, "embeddings"))
    return found.select(
        "vec_id",
        "n",
        F.col("deviation").cast("bigint").alias("deviation"),
        "identity_error",
        F.posexplode(F.arrays_zip("whitened", "explained")).alias("place", "value"),
    ).select(
        "vec_id",
        (F.col("place") + 1).alias("component"),
        "n",
        "deviation",
        F.col("value.whitened").alias("whitened"),
        F.col("value.explained").alias("explained"),
        "identity_error",
    )


OP13_SQL = """
WITH clean AS (
    SELECT row_number() OVER () AS r, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label::BIGINT + 1) % 10 ELSE label END AS label,
        list_transform(embedding, lambda c: floor(256 * c::DOUBLE)) AS x
    FROM embeddings
    WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
        AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c::DOUBLE))) = 0
), scored AS (
    SELECT a.vec_id AS anchor_id, c.vec_id, c.label = a.label AS same,
        list_inner_product(a.x, c.x)::BIGINT AS score
    FROM clean a JOIN clean c ON a.vec_id % 100 = 0 AND c.vec_id <> a.vec_id AND len(a.x) = len(c.x)
), positive AS (
    SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM scored WHERE same
    QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
)
SELECT anchor_id, positive_id, (row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id))::INTEGER AS rank,
    vec_id AS negative_id, positive_score, score AS negative_score
FROM positive JOIN scored USING (anchor_id)
WHERE NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
QUALIFY row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) <= 10
"""


@_query("op13_hard_negatives", OP13_SQL)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of every hundredth embedding; the labels of every seventh are moved on."""
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label").cast("bigint") + 1) % 10).otherwise(F.col("label"))
    rows = _table(spark, sf_dir, "embeddings").withColumn("label", moved)
    return negatives.hard_negatives(rows, F.col("vec_id") % 100 == 0)
