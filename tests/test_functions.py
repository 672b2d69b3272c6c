"""Column functions against hand-computed answers."""

import math
import random
import re

import pytest
from pyspark.sql import functions as F

from refracta.functions import attributes, domains, extraction, metrics, responses, scoring, sql
from refracta.functions.text import common_prefix_length, edit_distance, strip

JAVA = """public class Factorial {
    public static int factorial(int n) {
        if (n <= 1) {
            return 1;
        }
        return n * factorial(n - 1);
    }
}
"""


def one(spark, column, **values):
    """The value of a column expression over literal inputs."""
    row = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()])
    return row.select(column.alias("x")).collect()[0]["x"]


def many(spark, rows, schema, column):
    return [r["x"] for r in spark.createDataFrame(rows, schema).select(column.alias("x")).collect()]


def batch(spark, rows, schema, *columns):
    """Evaluate columns over numbered rows in one query, back in input order."""
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], f"__i int, {schema}")
    out = df.select("__i", *[c.alias(f"c{j}") for j, c in enumerate(columns)]).collect()
    return [tuple(r)[1:] for r in sorted(out, key=lambda r: r["__i"])]


NORMAL_CASES = [
    ("a // b\n\n  c  # d\n", "a\nc"),
    ("a /* x\ny */ b\n", "a  b"),
    ("x = '''doc\nstring'''\ny", "x =\ny"),
    ('f() """a\nb""" \t\n z', "f()\nz"),
    ("url = 'http://host/p'\n#include <x>\n", "url = 'http:"),
    ("\r\n a \r\n\x0b\n b \n", "a\nb"),
    ("", ""),
    (" \n \n", ""),
    ("a\x1c\n\x1fb", "a\nb"),
]


def test_normal_form(spark):
    c = F.col("c")
    rows = [(code,) for code, _ in NORMAL_CASES]
    got = batch(spark, rows, "c string", metrics.normalize_code(c), metrics.lines_of_code(c))
    assert got == [(want, len(want.split("\n")) if want else 0) for _, want in NORMAL_CASES]


COMPLEXITY_CASES = [
    ("", 1),
    ("a&&b && c || d||e", 3),
    ("if else elif iffy elseif", 4),
    ("else if (x) {}", 3),
    ("a ? b : c", 1),
    ("a?b:c", 2),
    ("for while case catch and or switch", 8),
    ("déif ifé _if if_", 1),
    ("// if in a comment", 2),
]


def test_keyword_complexity(spark):
    rows = [(code,) for code, _ in COMPLEXITY_CASES]
    got = batch(spark, rows, "c string", metrics.keyword_complexity(F.col("c")))
    assert [g[0] for g in got] == [cc for _, cc in COMPLEXITY_CASES]


def test_volume_and_tokens(spark):
    n = one(spark, metrics.token_count(F.col("c")), c="héllo wörld a_1 +")
    assert n == 3
    assert one(spark, metrics.halstead_volume(F.col("c")), c="+ -") == 0.0
    assert one(spark, metrics.halstead_volume(F.col("c")), c="one") == 0.0
    assert one(spark, metrics.halstead_volume(F.col("c")), c=" ".join("w" * 28)) == 134.61
    assert one(spark, metrics.halstead_volume(F.col("c")), c=" ".join("w" * 37)) == 192.75


def test_tiers(spark):
    got = many(spark, [(c,) for c in (5, 10, 11, 15, 30, 31)], "c int", metrics.complexity_tier(F.col("c")))
    assert got == ["simple", "simple", "medium", "medium", "medium", "complex"]


def test_bundle_matches_single_functions(spark):
    df = spark.createDataFrame([(JAVA,), ("x",), ("",)], "code string")
    code = F.col("code")
    rows = metrics.with_metrics(df).select(
        "code_hash", "lines_of_code", "cyclomatic_complexity", "halstead_volume",
        metrics.code_hash(code).alias("h"), metrics.lines_of_code(code).alias("l"),
        metrics.keyword_complexity(code).alias("c"), metrics.halstead_volume(code).alias("v"),
    )
    for r in rows.collect():
        assert (r[0], r[1], r[2], r[3]) == (r["h"], r["l"], r["c"], r["v"])


def test_domains(spark):
    names = ["Merge SORT", "Linked list", "Parse text", "Prime number", "Read a file", "Radio", "Knight"]
    got = many(spark, [(n,) for n in names], "n string", domains.domain_from_task(F.col("n")))
    assert got == ["algorithms", "data_structures", "strings", "math", "io", "io", "other"]
    paths = ["dp/knapsack.py", "data_structures/heap.py", "strings/kmp.py", "maths/pi.py", "misc/a.py"]
    got = many(spark, [(p,) for p in paths], "p string", domains.domain_from_path(F.col("p")))
    assert got == ["algorithms", "data_structures", "strings", "math", "other"]


def test_names(spark):
    assert one(spark, domains.suite_file_name(F.col("i"), F.col("l")), i="f", l="cpp") == "f_test.cpp"
    assert one(spark, domains.suite_file_name(F.col("i"), F.col("l")), i="f", l="go") == "f_test.txt"
    assert one(spark, domains.task_name_from_url(F.col("u")), u="https://x/wiki/A_b_c") == "A b c"
    assert one(spark, domains.language_from_alias(F.col("a")), a="C%2B%2B") == "cpp"
    assert one(spark, domains.language_from_alias(F.col("a")), a="Perl") is None


def test_prompt_order(spark):
    tpl = "{language}: {code}"
    got = one(
        spark, responses.render_prompt(F.col("t"), F.col("c"), F.col("l")), t=tpl, c="say {language}", l="java"
    )
    assert got == "java: say java"


FENCED = "Sure\n```python\nshort\n```\nand\n```python\nlonger one\n```"


EXTRACT_CASES = [
    ("python", FENCED, "longer one"),
    ("python", "```java\nint x;\n```", None),
    ("python", "```\nint x;\n```", "int x;"),
    ("python", "```python x = 1```", "x = 1"),
    ("python", "``` x = 1```", "x = 1"),
    ("python", "```\n\n```x``` a b c```", "a b c"),
    ("python", "Here is the code:\n\n def f(): pass ", "def f(): pass"),
    ("python", "HERE'S it: import os", "import os"),
    ("python", "Well: import os", "Well: import os"),
    ("python", "nothing to see", None),
    ("java", "def f", None),
    ("cpp", "int x", "int x"),
    ("cpp", None, None),
]


def test_extract_code(spark):
    rows = [c[:2] for c in EXTRACT_CASES]
    got = batch(spark, rows, "l string, r string", responses.extract_code(F.col("r"), F.col("l")))
    assert [g[0] for g in got] == [c[2] for c in EXTRACT_CASES]


TEST_CODE_CASES = [
    ("python", "ok\nimport pytest\ndef test_a(): pass\n", "import pytest\ndef test_a(): pass"),
    ("python", "x def test_ y\nz", "x def test_ y\nz"),
    ("javascript", "hi\nfc.assert(1)\nbye", "fc.assert(1)\nbye"),
    ("cpp", "EXPECT_EQ only", None),
    ("cpp", "a\nASSERT_ b\nvoid f();", "a\nASSERT_ b\nvoid f();"),
    ("java", "Here is it: class A", "Here is it: class A"),
]


def test_extract_test_code(spark):
    rows = [c[:2] for c in TEST_CODE_CASES]
    got = batch(spark, rows, "l string, r string", responses.extract_test_code(F.col("r"), F.col("l")))
    assert [g[0] for g in got] == [c[2] for c in TEST_CODE_CASES]


ERROR_CASES = [
    (None, "x", None, False),
    (None, None, "parse_error", False),
    ("API error 402: money", None, "insufficient_funds", True),
    ("API error 401: key", None, "invalid_api_key", True),
    ("API error 403: no", None, "fatal_api_error", True),
    ("API error 429: slow", None, "rate_limit", False),
    ("API error 500: boom", None, "server_error", False),
    ("Request TIMEOUT", None, "timeout", False),
    ("boom", None, "request_error", False),
]


def test_errors(spark):
    columns = responses.error_type(F.col("e"), F.col("c")), responses.is_fatal(F.col("e"))
    got = batch(spark, [c[:2] for c in ERROR_CASES], "e string, c string", *columns)
    assert got == [c[2:] for c in ERROR_CASES]


def test_edit_distance_is_exact(spark):
    import random

    rng = random.Random(5)

    def slow(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            nxt = [i]
            for j, y in enumerate(b, 1):
                nxt.append(min(nxt[-1] + 1, row[j] + 1, row[j - 1] + (x != y)))
            row = nxt
        return row[-1]

    texts = ["".join(rng.choice("abé") for _ in range(rng.randrange(0, 12))) for _ in range(120)]
    pairs = list(zip(texts[::2], texts[1::2], strict=True)) + [("aaa", "aa"), ("abc", "abc"), ("", "")]
    got = many(spark, pairs, "a string, b string", edit_distance(F.col("a"), F.col("b")))
    assert got == [slow(a, b) for a, b in pairs]
    prefix = many(spark, pairs, "a string, b string", common_prefix_length(F.col("a"), F.col("b")))
    assert prefix == [
        next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b))) for a, b in pairs
    ]


DIVERSITY_CASES = [
    ("", "", 0.0),
    (" \n", "\t", 0.0),
    ("abc", "abd", 1 / 3),
    ("a b", "ab", 0.0),
    ("", "abc", 1.0),
    ("abcdefghij", "abcdefghi{", 0.1 * 1.2),
    ("{{{{{x", "{{{{{y", 1 / 6),
]


def test_text_diversity(spark):
    rows = [c[:2] for c in DIVERSITY_CASES]
    got = batch(spark, rows, "a string, b string", scoring.text_diversity(F.col("a"), F.col("b")))
    for (d,), (_a, _b, want) in zip(got, DIVERSITY_CASES, strict=True):
        assert math.isclose(d, want, abs_tol=1e-12)


def test_scores(spark):
    assert one(spark, scoring.effort(F.col("v")), v=1000.0) == 0.5
    assert one(spark, scoring.effort(F.col("v")), v=0.0) == 1.0
    assert one(spark, scoring.effort(F.col("v").cast("double")), v=None) is None
    cols = [F.col(c) for c in "dpse"]
    assert one(spark, scoring.se_score(*cols), d=4.0, p=1, s=0.5, e=0.5) == 4.0
    assert one(spark, scoring.se_score(*cols), d=4.0, p=0, s=0.5, e=0.5) == 0.0
    assert one(spark, scoring.se_score(*cols), d=4.0, p=1, s=0.5, e=0.0) == 0.0


def test_attributes(spark):
    df = spark.createDataFrame([(1, None, 3), (0, 2, None), (None, None, None)], "p int, i int, o int")
    rows = df.select(
        attributes.success(F.col("p")), attributes.total_tokens(F.col("i"), F.col("o"))
    ).collect()
    assert [tuple(r) for r in rows] == [(True, 3), (False, 2), (False, 0)]
    assert one(spark, attributes.ratio_or_zero(F.col("a"), F.col("b")), a=3, b=0) == 0.0


def test_strip_is_linear(spark):
    text = "x" + " " * 200_000 + "y"
    assert one(spark, F.length(strip(F.col("t"))), t=text) == len(text)


def test_links(spark):
    html = (
        '<a href="/wiki/A">a</a><a class="x" href="/wiki/B&amp;C">b</a><a href="/wiki/A">a</a>'
        '<a href="/wiki/Category:X">c</a><a href="/wiki/">d</a><a href="/other">e</a>'
    )
    got = one(spark, extraction.page_links(F.col("h"), base_url="https://s"), h=html)
    assert got == ["https://s/wiki/A", "https://s/wiki/B&C"]


def _page(*sections):
    return "<html><body><h1>T</h1>" + "".join(
        f'<h2><span class="mw-headline" id="{i}">{i}</span></h2>{body}' for i, body in sections
    ) + "</body></html>"


LONG = "x &lt; 1; " * 10
PLAIN = ("x < 1; " * 10).strip()


PAGE_CASES = [
    (_page(("Python", f"<div><pre>{LONG}</pre></div>")), {"Python": PLAIN}),
    (_page(("Java", f"<p>t<br>u</p><div><div><pre><b>{LONG}</b></pre></div></div>")), {"Java": PLAIN}),
    # the first element with a block decides, even when its block is too short
    (_page(("Java", f"<p><code>no</code></p><div><pre>{LONG}</pre></div>")), {}),
    # a listing that is itself the sibling does not count
    (_page(("Java", f"<pre>{LONG}</pre>")), {}),
    # the next heading ends the section
    (_page(("C++", "<p>none</p>"), ("Perl", f"<div><pre>{LONG}</pre></div>")), {}),
    (
        _page(("C++", f"<div><pre>{LONG}</pre></div>"), ("Python", f"<div><pre>a{LONG}</pre></div>")),
        {"C++": PLAIN, "Python": "a" + PLAIN},
    ),
    # never closed: the listing, what is around it, paragraphs and list items before it
    (_page(("Java", f"<div><pre>{LONG}</div><div><pre>b{LONG}</pre></div>")), {"Java": PLAIN}),
    (_page(("Java", f"<div><b><pre>{LONG}</pre>")), {"Java": PLAIN}),
    (_page(("Java", f"<p>one<p>two<ul><li>x<li><br>y</ul><div><pre>{LONG}</pre></div>")), {"Java": PLAIN}),
    (_page(("Java", f"<p>one<div><pre>{LONG}</pre></div><div><pre>b{LONG}</pre></div>")), {"Java": PLAIN}),
    # crossed tags, and end tags of nothing
    (_page(("Java", f"<div><b><i>t</b></i></div><div><pre>{LONG}</pre></div>")), {"Java": PLAIN}),
    (_page(("Java", f"</span></pre><div></b><pre>{LONG}</pre></i></div><div><pre>b{LONG}</pre></div>")), {"Java": PLAIN}),
    # signs that are no tags, comments and scripts
    (_page(("Java", f"<div>if a < b<pre>{LONG}</pre></div>")), {"Java": PLAIN}),
    (_page(("Java", f"<!-- <div><pre>no</pre> --><script>'<div><pre>'</script><div><pre>{LONG}</pre></div>")), {"Java": PLAIN}),
    (_page(("Java", f"<div><pre>i < n; j > m; {LONG}</pre></div>")), {"Java": "i < n; j > m; " + PLAIN}),
]


def test_language_blocks(spark):
    rows = [(page,) for page, _ in PAGE_CASES]
    got = batch(spark, rows, "h string", extraction.language_blocks(F.col("h")))
    assert [{b["alias"]: b["code"] for b in g[0]} for g in got] == [want for _, want in PAGE_CASES]


BODY = "\n  return a + b + c + d + e + f + g + h;\n"


@pytest.mark.parametrize(
    "language, code, names",
    [
        ("java", f"class A {{\n  public int f(int a) {{{BODY}}}\n  static void g() {{{BODY}}}\n}}", ["f", "g"]),
        ("javascript", f"const b = (x) => {{{BODY}}}\nfunction a(x) {{{BODY}}}", ["a", "b"]),
        ("cpp", f"int f(int a) {{{BODY}}}\nstd::string g(A &a) {{{BODY}}}", ["f", "g"]),
        ("cpp", "int f() { }", []),
    ],
)
def test_brace_functions(spark, language, code, names):
    got = one(spark, extraction.language_functions(F.col("c"), language), c=code)
    assert [f["name"] for f in got] == names
    assert all(f["code"].endswith("}") and f["code"].count("{") == f["code"].count("}") for f in got)


def test_java_header_survives_long_whitespace(spark):
    code = " " * 100_000 + "x"
    assert one(spark, extraction.language_functions(F.col("c"), "java"), c=code) == []


def test_unbalanced_keeps_the_window(spark):
    code = "int f() {" + "a" * 5000
    (f,) = one(spark, extraction.language_functions(F.col("c"), "cpp"), c=code)
    assert len(f["code"]) == 2000


def test_balanced_prefix(spark):
    cases = [("a{b{c}d}e}", "a{b{c}d}"), ("}{}", "}{}"), ("{}}{", "{}"), ("{", "{"), ("", "")]
    got = batch(spark, [(t,) for t, _ in cases], "t string", extraction.balanced_prefix(F.col("t")))
    assert [g[0] for g in got] == [kept for _, kept in cases]


def plain_functions(code, header, window=2000):
    out = []
    for m in re.finditer(header, code):
        text, depth = code[m.start() : m.start() + window], 0
        for i, c in enumerate(text):
            depth += (c == "{") - (c == "}")
            if c == "}" and depth == 0:
                text = text[: i + 1]
                break
        if 50 <= len(text) <= 3000:
            out.append((m.group(1), text))
    return out


def test_brace_functions_match_brute_force(spark):
    rng = random.Random(3)
    parts = ["function f(a) {", "}", "{", "} }", "x = 1; ", "y" * 90 + " ", "function g() { return {a: 1}; }", "\n", "é{ü}"]
    codes = ["".join(rng.choices(parts, k=rng.randrange(60))) for _ in range(150)]
    codes += ["", "function a(){" * 500, "function a(){}" * 500, "function z() {" + "w" * 5000 + "}", "function z() { " + "{}" * 400 + " }"]
    got = batch(
        spark, [(c,) for c in codes], "c string",
        extraction.brace_functions(F.col("c"), extraction.JS_FUNCTION_HEADER),
    )
    want = [plain_functions(c, r"function\s+(\w+)\s*\([^)]*\)\s*\{") for c in codes]
    assert [[tuple(f) for f in found] for (found,) in got] == want


def test_edit_distance_matches_brute_force(spark):
    def plain(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
        return row[-1]

    rng = random.Random(7)
    pairs = [("", ""), ("a", ""), ("kitten", "sitting")]
    for n in (30, 80, 300, 700):
        for edits in (0, 3, 20, 150):
            a = [rng.choice("abcdé") for _ in range(n)]
            b = list(a)
            for _ in range(edits):
                at = rng.randrange(len(b) + 1)
                b[at : at + rng.randrange(2)] = rng.choices("abcx", k=rng.randrange(2))
            pairs.append(("".join(a), "".join(b)))
        pairs.append(("".join(rng.choices("ab", k=n)), "".join(rng.choices("cd", k=n + 9))))
    got = batch(spark, pairs, "a string, b string", edit_distance(F.col("a"), F.col("b")))
    assert [d for (d,) in got] == [plain(a, b) for a, b in pairs]


def test_table_functions_match_the_columns(spark):
    sql.register(spark)
    cases = [
        ("java", f"class A {{\n  public int f(int a) {{{BODY}}}\n  static void g() {{{BODY}}}\n}}"),
        ("javascript", f"const b = (x) => {{{BODY}}}\nfunction a(x) {{{BODY} if (x) {{ y(); }} }}\nfunction c() {{{BODY}"),
        ("cpp", f"int f(int a) {{{BODY}}}\nstd::string g(A &a) {{{BODY}}}" * 3),
        ("cpp", "int f(int a) {" + BODY * 90 + "}"),
        ("cpp", "int f() { }"), ("java", ""), ("java", None), ("python", "def f():\n    return 1\n"), (None, "int f() {"),
    ]
    df = spark.createDataFrame([(i, *c) for i, c in enumerate(cases)], "id int, language string, code string")
    got = spark.sql("SELECT id, seq, name, body FROM {df}, LATERAL file_functions(code, language)", df=df).collect()
    want = []
    for language in extraction.HEADERS:
        found = F.posexplode(extraction.language_functions(F.col("code"), language))
        rows = df.filter(F.col("language") == language).select("id", found.alias("seq", "f"))
        want += [(r["id"], r["seq"], r["f"]["name"], r["f"]["code"]) for r in rows.collect()]
    assert len(want) > 9 and [(r[0], r[2], r[3]) for r in sorted(map(tuple, got))] == [(w[0], w[2], w[3]) for w in sorted(want)]


def test_link_table_function(spark):
    sql.register(spark)
    html = '<a href="/wiki/B">x</a><A class="c" href="/wiki/A"></a><a href="/wiki/B">y</a><a href="/wiki/X:Y"></a><a href="/wiki/">z</a>'
    df = spark.createDataFrame([(1, html), (2, ""), (3, None)], "id int, html string")
    got = spark.sql("SELECT id, position, link FROM {df}, LATERAL page_links(html, '/wiki/', 'https://s')", df=df).collect()
    assert sorted(map(tuple, got)) == [(1, 1, "https://s/wiki/B"), (1, 2, "https://s/wiki/A")]
