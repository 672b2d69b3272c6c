"""Functions for SQL users, as temporary SQL functions of a session: metrics, and table functions
for LATERAL joins, which Spark plans as one generator over the row's text."""

from pyspark.sql import SparkSession

from refracta.constants import FUNCTION_CHARS, FUNCTION_WINDOW, MEDIUM_MAX_CC, SIMPLE_MAX_CC
from refracta.functions.extraction import HEADERS, HEADERS_IN_WINDOW

DEFINITIONS = (
    f"complexity_tier(cc INT) RETURNS STRING RETURN CASE WHEN cc <= {SIMPLE_MAX_CC} THEN 'simple' "
    f"WHEN cc <= {MEDIUM_MAX_CC} THEN 'medium' ELSE 'complex' END",
    "delta_cc(cc_before INT, cc_after INT) RETURNS INT RETURN abs(cc_after - cc_before)",
    "effort(volume DOUBLE) RETURNS DOUBLE RETURN CASE WHEN volume <= 0 THEN 1.0D "
    "ELSE 1.0D / (1.0D + volume / 1000.0D) END",
    "se_score(delta DOUBLE, preservation INT, diversity DOUBLE, effort DOUBLE) RETURNS DOUBLE RETURN "
    "CASE WHEN effort = 0 THEN 0.0D ELSE delta * preservation * preservation * diversity / nullif(effort, 0.0D) END",
)

#: Length of a text up to the brace that first returns to depth 0, 0 if none does.
_CLOSED_AT = r"""closed_at(text STRING) RETURNS INT RETURN aggregate(
    slice(split(text, r'\}'), 1, size(split(text, r'\}')) - 1), named_struct('depth', 0, 'pos', 0, 'end', 0),
    (s, piece) -> if(s.end > 0, s, named_struct(
        'depth', s.depth + length(piece) - length(replace(piece, '{', '')) - 1,
        'pos', s.pos + length(piece) + 1,
        'end', if(s.depth + length(piece) - length(replace(piece, '{', '')) = 1, s.pos + length(piece) + 1, 0))),
    s -> s.end)"""

_PAGE_LINKS = r"""page_links(html STRING, prefix STRING, base STRING) RETURNS TABLE(position INT, link STRING)
    RETURN SELECT at + 1, concat(base, link) FROM posexplode(array_distinct(filter(
        regexp_extract_all(html, r'(?i)<a\b[^>]*?\bhref="([^"]*)"', 1),
        h -> startswith(h, prefix) AND NOT contains(h, ':') AND h <> prefix))) AS t(at, link)"""


def _found(header: str) -> str:
    """Name and window of every match of a header: the parts from it on, up to the window."""
    return f"""transform(array(named_struct('heads', regexp_extract_all(code, r'{header}', 0), 'rest', split(code, r'{header}'))),
        p -> transform(array(named_struct('heads', p.heads, 'parts', zip_with(p.heads, slice(p.rest, 2, size(p.rest)), (h, r) -> concat(h, r)))),
            q -> transform(q.heads, (h, i) -> named_struct('name', regexp_extract(h, r'{header}', 1), 'text',
                left(array_join(slice(q.parts, i + 1, {HEADERS_IN_WINDOW}), ''), {FUNCTION_WINDOW}))))[0])[0]"""


def _file_functions() -> str:
    """Functions of a file in a brace language, in the order they are reported; none for others."""
    branches = " ".join(
        f"WHEN '{language}' THEN concat({', '.join(_found(h) for h in headers)})" for language, headers in HEADERS.items()
    )
    low, high = FUNCTION_CHARS
    return f"""file_functions(code STRING, language STRING) RETURNS TABLE(seq INT, name STRING, body STRING)
    RETURN SELECT at, name, body FROM (
        SELECT at, name, if(end > 0, left(text, end), text) AS body FROM (
            SELECT at, f.name, f.text, closed_at(f.text) AS end FROM posexplode(CASE language {branches} END) AS t(at, f)))
    WHERE length(body) BETWEEN {low} AND {high}"""


TABLE_DEFINITIONS = (_CLOSED_AT, _PAGE_LINKS, _file_functions())


def register(spark: SparkSession) -> None:
    """Make the functions callable from SQL; Spark inlines their bodies, so nothing is lost.

    ``FROM pages, LATERAL page_links(html, '/wiki/', '')`` gives a page's links in order, from 1.
    ``FROM files, LATERAL file_functions(code, language)`` gives the functions of Java, JavaScript
    and C++ files; Python files need a parser (``operators.collection.file_functions``) and give
    no rows, like NULL texts and unknown languages.
    """
    for definition in (*DEFINITIONS, *TABLE_DEFINITIONS):
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {definition}")
