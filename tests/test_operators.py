"""Operators against brute force on small inputs."""

import ast
import bisect
import collections
import functools
import random
import statistics

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from refracta import schemas
from refracta.functions.metrics import with_metrics
from refracta.operators import (
    astnodes,
    collection,
    corpus,
    cost,
    grid,
    inference,
    leaderboard,
    lookups,
    monitor,
    ordered,
    quality,
    sampling,
    scoring,
    stats,
)
from refracta.sources import catalogue
from refracta.streaming import rollups

SMALL = "function_id string, model string, task string, strategy string"


@pytest.fixture(scope="module")
def skewed(spark):
    """300 rows, group 'hot' holds more than half of them, many ties."""
    rng = random.Random(3)
    rows = [
        (i, "hot" if rng.random() < 0.6 else rng.choice("abc"), float(rng.randrange(12)), rng.randrange(40))
        for i in range(300)
    ]
    return rows, spark.createDataFrame(rows, "id int, g string, x double, t int").repartition(7).cache()


def test_running_total_and_row_numbers(skewed):
    rows, df = skewed
    for group in ([], ["g"]):
        got = ordered.running_total(df, "x", ["t", "id"], "before", group)
        numbers = ordered.row_numbers(df, ["t", "id"], "n", group)
        total, seen, want, want_n = collections.Counter(), collections.Counter(), {}, {}
        for i, g, x, _t in sorted(rows, key=lambda r: (r[3], r[0])):
            key = g if group else ""
            want[i], want_n[i] = total[key], seen[key] + 1
            total[key] += x
            seen[key] += 1
        assert {r["id"]: r["before"] for r in got.collect()} == want
        assert {r["id"]: r["n"] for r in numbers.collect()} == want_n


def test_quantiles_equal_the_built_in(spark):
    inf, nan = float("inf"), float("nan")
    values = {
        "nan": [1.0, nan, 2.0], "inf": [1.0, inf, inf], "both": [-inf, 0.0, inf], "ties": [2.0] * 9 + [3.0],
        "one": [7.0], "empty": [None, None], None: [None, 4.0, 5.0], "hot": [float(i % 50) for i in range(4000)],
    }
    rows = [(g, v) for g, vs in values.items() for v in vs]
    df = spark.createDataFrame(rows, "g string, x double").repartition(5)
    cuts = {"q1": 0.25, "mid": 0.5, "p95": 0.95}
    built_in = [F.percentile("x", F.lit(p)).alias(n) for n, p in cuts.items()]
    for group in (["g"], []):
        want = df.groupBy(*group).agg(*built_in).collect()
        got = ordered.quantiles(df, group, "x", cuts).collect()
        assert sorted(map(repr, got)) == sorted(map(repr, want))
    assert ordered.quantiles(df.limit(0), ["g"], "x", cuts).count() == 0


def test_quantiles(skewed):
    rows, df = skewed
    got = ordered.quantiles(df, ["g"], "x", {"q1": 0.25, "mid": 0.5, "p95": 0.95})

    def q(values, p):
        values = sorted(values)
        at = p * (len(values) - 1)
        low = int(at)
        high = min(low + 1, len(values) - 1)
        return values[low] + (values[high] - values[low]) * (at - low)

    for r in got.collect():
        values = [x for _i, g, x, _t in rows if g == r["g"]]
        for name, p in (("q1", 0.25), ("mid", 0.5), ("p95", 0.95)):
            assert r[name] == pytest.approx(q(values, p))


def test_value_ranks(skewed):
    rows, df = skewed
    values = [x for _i, _g, x, _t in rows]
    for r in ordered.value_ranks(df, "x").collect():
        below = sum(v < r["x"] for v in values)
        assert (r["below"], r["n"]) == (below, values.count(r["x"]))
        assert r["avg_rank"] == below + (r["n"] + 1) / 2


def test_keep_first_limits_before_the_shuffle(skewed):
    rows, df = skewed
    first = corpus.keep_first(df, ["g"], ["t", "id"])
    want = {}
    for i, g, _x, t in rows:
        want[g] = min(want.get(g, (t, i)), (t, i))
    assert {r["g"]: (r["t"], r["id"]) for r in first.collect()} == want
    plan = first._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "Partial" in plan


@pytest.mark.parametrize("quota", [5, 2000])
def test_quotas(skewed, quota):
    rows, df = skewed
    got = sampling.take_per_group(df, ["g"], {("hot",): quota, ("a",): 3, ("none",): 4}, ["t", "id"])
    want = set()
    for g, k in (("hot", quota), ("a", 3)):
        want |= {i for i, _g, _x, t in sorted(rows, key=lambda r: (r[3], r[0])) if _g == g and True} & {
            r[0] for r in sorted((r for r in rows if r[1] == g), key=lambda r: (r[3], r[0]))[:k]
        }
    assert {r["id"] for r in got.collect()} == want


def test_greedy_load(spark):
    rng = random.Random(11)
    for _round in range(4):
        rows = [(i, f"i{rng.randrange(15)}", f"h{rng.randrange(15)}", rng.choice([1, 1, 1, 0])) for i in range(60)]
        target = [("i0", "h3"), ("i1", "h4")]
        ids, hashes = {a for a, _ in target}, {b for _, b in target}
        want = {}
        for n, i, h, loc in rows:
            if loc == 0:
                want[n] = "error"
            elif i in ids or h in hashes:
                want[n] = "duplicate"
            else:
                want[n] = "inserted"
                ids.add(i)
                hashes.add(h)
        new = spark.createDataFrame(
            [(n, i, "java", "c", h, 1, loc, "s") for n, i, h, loc in rows],
            "n int, id string, language string, code string, code_hash string, cyclomatic_complexity int, "
            "lines_of_code int, source string",
        )
        existing = spark.createDataFrame(target, "id string, code_hash string")
        flagged = corpus.flag_insert(new, existing, "n")
        assert {r["n"]: r["status"] for r in flagged.collect()} == want
        report = corpus.load_report(flagged).collect()[0]
        counts = collections.Counter(want.values())
        assert tuple(report) == (60, counts["inserted"], counts["duplicate"], counts["error"])


def test_load_of_a_long_chain_takes_few_rounds(spark, monkeypatch):
    # Every row shares its id with the row before and its hash with the row after it.
    n = 400
    rows = [(i, f"i{(i + 1) // 2}", f"h{i // 2}") for i in range(n)]
    rounds = []
    firsts = corpus._firsts
    monkeypatch.setattr(corpus, "_firsts", lambda *a: rounds.append(1) or firsts(*a))
    got = corpus._admit(spark.createDataFrame(rows, "n int, id string, code_hash string"), "n")
    assert {r["n"] for r in got.collect()} == set(range(0, n, 2))
    assert len(rounds) <= 3


def test_next_version_fills_defaults_of_what_gets_in(spark):
    columns = "id string, language string, code string, code_hash string, cyclomatic_complexity int, lines_of_code int, domain string, source string"
    existing = spark.createDataFrame([("a", "java", "c", "h1", 1, 1, "io", "s")], columns)
    rows = [("b", "java", "c", "h1", 1, 1, None, "s", "t", 1), ("c", "java", "c", "h2", 1, 1, None, "s", None, 2), ("d", None, "c", "h3", 1, 1, "io", "s", None, 3)]
    loaded = spark.createDataFrame(rows, f"{columns}, task_name string, n int")
    got = corpus.next_version(existing, loaded, "n")
    assert got.columns == existing.columns
    assert {(r["id"], r["domain"]) for r in got.collect()} == {("a", "io"), ("c", "other")}


def test_result_rows_keep_the_first_usable_attempt_or_the_last_failure(spark):
    from refracta.operators.results import result_rows
    from refracta.schemas import TRANSFORMATIONS

    key = "function_id string, model string, task string, strategy string"
    cells = spark.createDataFrame([(f, "m1", "refactor", "s") for f in ("f1", "f2", "f3")], key)
    good = "```java\nint f() { if (a) {} }\n```"
    replies = [
        ("f1", "m1", 1, None, "API error 429: slow"), ("f1", "m1", 2, good, None), ("f1", "m1", 3, good + "x", None),
        ("f2", "m1", 1, None, "timeout"), ("f2", "m1", 3, "no", None), ("f2", "m1", 4, good, None),
        ("f1", "other", 1, good, None),
    ]
    responses = spark.createDataFrame(
        [(f, m, "refactor", "s", a, c, e, 100, 50, a, None) for f, m, a, c, e in replies],
        f"{key}, attempt int, content string, error string, tokens_input int, tokens_output int, latency_ms int, timestamp timestamp_ntz",
    )
    functions = spark.createDataFrame([(f, "java", 5) for f in ("f1", "f2")], "id string, language string, cyclomatic_complexity int")
    catalogue = spark.createDataFrame([("tier1", "m1", 0.01)], "tier string, id string, cost_per_1k_tokens double")
    rows = result_rows(cells, responses, functions, catalogue)
    assert rows.columns == TRANSFORMATIONS.names
    got = {r["function_id"]: r for r in rows.collect()}
    assert set(got) == {"f1", "f2"}
    assert (got["f1"]["latency_ms"], got["f1"]["error_type"], got["f1"]["delta_cc"]) == (2, None, 3.0)
    assert (got["f2"]["latency_ms"], got["f2"]["error_type"], got["f2"]["transformed_code"]) == (3, "parse_error", None)
    assert got["f1"]["cost_usd"] == pytest.approx(0.0015) and got["f1"]["se_score"] is None


def test_collection_counters(spark):
    languages, tiers = ["python", "java", "javascript", "cpp"], [5, 20, 40]
    rows = [("inserted", languages[i % 4], tiers[i % 3]) for i in range(50)]
    rows += [("duplicate", "java", 5)] * 5 + [("error", "java", 5)] * 4
    df = spark.createDataFrame(rows, "status string, language string, cyclomatic_complexity int")
    got = {r["counter"]: r["n"] for r in corpus.collection_counters(df).collect()}
    assert [got[f"language:{x}"] for x in languages] == [13, 13, 12, 12]
    assert [got[f"tier:{t}"] for t in ("simple", "medium", "complex")] == [17, 17, 16]
    assert (got["collected"], got["duplicate"], got["error"]) == (50, 5, 4)


def test_distribution(spark):
    rows = [("python",)] * 135 + [("java",)] * 134
    check = corpus.distribution_check(spark.createDataFrame(rows, "language string"), {"python": 150, "java": 150, "go": 0})
    got = {r["language"]: (r["actual"], r["ok"], r["pct"]) for r in check.collect()}
    assert got["python"] == (135, True, 90.0)
    assert got["java"][:2] == (134, False)
    assert got["go"] == (0, True, 0.0)
    assert corpus.distribution_verdict(check).collect()[0]["ok"] is False


def test_stratum_quotas():
    q = sampling.stratum_quotas()
    assert [q["python", t] for t in ("simple", "medium", "complex")] == [12, 12, 6]
    assert [q["cpp", t] for t in ("simple", "medium", "complex")] == [8, 8, 4]


def test_sample_is_repeatable(spark):
    rows = [(f"f{i}", ["python", "java"][i % 2], i % 45 + 1) for i in range(400)]
    df = spark.createDataFrame(rows, "id string, language string, cyclomatic_complexity int")
    a = {r["id"] for r in sampling.stratified_sample(df, "1").collect()}
    b = {r["id"] for r in sampling.stratified_sample(df.repartition(9), "1").collect()}
    c = {r["id"] for r in sampling.stratified_sample(df, "2").collect()}
    assert a == b != c and len(a) == 60
    report = sampling.sample_report(sampling.stratified_sample(df, "1"))
    assert {r["shortfall"] for r in report.filter("language = 'python'").collect()} == {0}
    assert {r["shortfall"] for r in report.filter("language = 'cpp'").collect()} == {8, 4}


def test_grid_and_resume(spark):
    f = spark.createDataFrame([(f"f{i}",) for i in range(5)], "id string")
    dims = (["m0", "m1"], ["refactor"], ["a", "b", "c"])
    done = spark.createDataFrame(
        [("f1", "m0", "refactor", "a")] * 50 + [("f1", "mX", "refactor", "a"), ("gone", "m0", "refactor", "a")]
        + [("f2", m, "refactor", s) for m in dims[0] for s in dims[2]],
        SMALL,
    )
    whole = {tuple(r) for r in grid.grid(f, *dims).collect()}
    queue = {tuple(r) for r in grid.pending_grid(f, done, *dims).collect()}
    assert len(whole) == 30
    assert queue == whole - {tuple(r) for r in done.collect()}
    report = grid.resume_report(f, done, *dims).collect()[0].asDict()
    assert report == {"total": 30, "queued": len(queue), "skipped": 7}
    assert grid.pending_grid(f, done, *dims, resume=False).count() == 30


def test_budget_admits_the_crossing_row(spark):
    rows = [(i, 1.0) for i in range(10)] + [(10, None)]
    df = spark.createDataFrame(rows, "n int, cost_usd double")
    got = sorted(r["n"] for r in grid.within_budget(df, ["n"], 3.5).collect())
    assert got == [0, 1, 2, 3]
    assert grid.within_budget(df, ["n"], 0.0).count() == 0


def test_first_usable_attempt(spark):
    rows = [("a", 1, None), ("a", 2, "x"), ("a", 3, "y"), ("b", 4, "z"), ("c", 1, None)]
    df = spark.createDataFrame(rows, "k string, attempt int, code string")
    got = grid.first_usable_attempt(df, ["k"], F.col("code").isNotNull()).collect()
    assert [(r["k"], r["attempt"]) for r in got] == [("a", 2)]


def test_lookup_errors(spark):
    df = spark.createDataFrame([("a", 5, True)], "id string, cyclomatic_complexity int, validated boolean")
    with pytest.raises(ValueError):
        lookups.functions_by_tier(df, "huge")
    with pytest.raises(ValueError):
        catalogue.models_of_tier(catalogue.models(spark), "tier9")
    assert lookups.functions_by_tier(df, "simple").count() == 1


def test_catalogue(spark):
    models = catalogue.models(spark)
    assert models.count() == 7
    calls = spark.createDataFrame(
        [("anthropic/claude-sonnet-4.5", 1000, 500), ("unknown", 600, 400)],
        "model string, tokens_input int, tokens_output int",
    )
    got = {r["model"]: r["cost_usd"] for r in cost.with_estimated_cost(calls, models).collect()}
    assert got == pytest.approx({"anthropic/claude-sonnet-4.5": 0.0045, "unknown": 0.002})
    with pytest.raises(ValueError):
        catalogue.with_model_attributes(calls, models, strict=True)


FACT = f"{SMALL}, preservation int, se_score double, cost_usd double, latency_ms int, error_type string, timestamp timestamp_ntz"


def test_rollup_of_one_row(spark):
    import datetime

    t = datetime.datetime(2025, 1, 2, 3)
    df = spark.createDataFrame([("f", "m", "refactor", "zero_shot", 1, 1.0, 0.001, 100, None, t)], FACT)
    r = cost.daily_rollup(df).collect()[0]
    assert tuple(r) == (t.date(), "m", 1, 0.001, 100.0, 1, 0)


def test_budget_report(spark):
    rollup = spark.createDataFrame(
        [("m0", 570.0), ("m1", 1.0), ("other", 100.0)], "model string, total_cost_usd double"
    )
    models = catalogue.models(spark, [("tier2", "m0", "x", 0.1), ("tier1", "m1", "y", 0.1)])
    got = {r["tier"]: r for r in cost.budget_report(rollup, models).collect()}
    assert (got["tier2"]["remaining_usd"], got["tier2"]["exhausted"]) == (30.0, True)
    assert (got["tier3"]["remaining_usd"], got["tier3"]["exhausted"]) == (200.0, False)
    assert got["total"]["spent_usd"] == 671.0


def test_progress_demo(spark):
    import datetime

    t = datetime.datetime(2025, 1, 1)
    rows = [
        ("f", "m", "refactor", "zero_shot", int(i % 3 != 0), 6.5 + i % 5, 0.001, 10, None, t + datetime.timedelta(seconds=i))
        for i in range(20)
    ]
    r = monitor.experiment_progress(spark.createDataFrame(rows, FACT), planned=100).collect()[0]
    assert (r["completed"], r["successful"], r["failed"]) == (20, 13, 7)
    assert r["success_rate"] == pytest.approx(65.0)
    assert r["avg_se"] == pytest.approx(8.5769, abs=1e-4)
    assert r["std_se"] == pytest.approx(1.3846, abs=1e-4)
    assert r["total_cost_usd"] == pytest.approx(0.02)
    assert (r["eta_s"], r["eta"]) == (76, "0h 1m")


def test_leaderboard_keeps_null_groups(spark):
    import datetime

    rng = random.Random(1)
    t = datetime.datetime(2025, 1, 1)
    rows = [
        ("f", rng.choice(["m", "n", None]), "refactor", rng.choice(["a", "b"]), rng.choice([0, 1, None]),
         rng.choice([None, rng.randrange(100) / 10]), 0.5, rng.choice([None, 100, 200]), None, t)
        for _ in range(200)
    ]
    df = spark.createDataFrame(rows, FACT)
    board = leaderboard.leaderboard(df).collect()
    scored = [r for r in rows if r[5] is not None]
    assert {(r["model"], r["strategy"]) for r in board} == {(r[1], r[3]) for r in scored}
    for r in board:
        mine = [x[5] for x in scored if (x[1], x[3]) == (r["model"], r["strategy"])]
        assert r["total_transformations"] == len(mine)
        assert r["median_se"] == pytest.approx(statistics.median(mine), abs=1e-3)
    top = leaderboard.top_leaderboard(df, strategy="a", limit=1).collect()
    assert len(top) == 1 and top[0]["strategy"] == "a"


def test_pareto(spark):
    rng = random.Random(8)
    rows = [(f"m{i}", rng.randrange(6) / 2, rng.randrange(6) / 4) for i in range(40)]
    df = spark.createDataFrame(rows, "model string, mean_se double, mean_cost double")
    want = {
        m for m, s, c in rows if not any(o != m and s2 >= s and c2 <= c for o, s2, c2 in rows)
    }
    assert {r["model"] for r in leaderboard.pareto_front(df).collect()} == want


PY = """def fibonacci(n):
    if n <= 1:
        return n
    return fibonacci(n - 1) + fibonacci(n - 2)


class A:
    @staticmethod
    def factorial(n):
        if n == 0 or n == 1:
            return 1
        def inner(x):
            return [y for y in x if y if x]
        return n * factorial(n - 1) + 0 * len("padding padding")
"""


def test_trees(spark):
    rows = [("a", PY), ("b", "x = 1"), ("c", "def (:"), ("d", "return 1"), ("e", None)]
    df = astnodes.with_tree(spark.createDataFrame(rows, "id string, code string"))
    got = {
        r["id"]: (r["cc"], r["p"], r["k"])
        for r in df.select(
            "id", astnodes.tree_complexity(F.col("tree")).alias("cc"),
            F.col("tree.parse_ok").alias("p"), F.col("tree.compile_ok").alias("k"),
        ).collect()
    }
    assert got == {
        "a": (4, True, True), "b": (1, True, True), "c": (None, False, False), "d": (1, True, False),
        "e": (None, None, None),
    }
    found = df.select(F.inline(astnodes.python_function_array(F.col("code"), F.col("tree")))).collect()
    names = sorted((r["name"], r["code"].split("\n")[0].strip()) for r in found)
    assert names == [
        ("factorial", "def factorial(n):"), ("fibonacci", "def fibonacci(n):"), ("inner", "def inner(x):")
    ]


def test_tree_distance_is_a_bound(spark):
    rows = [("x = 1", "x = 1"), ("x = 1", "y = f(2)"), ("a", "def (")]
    df = spark.createDataFrame(rows, "a string, b string")
    both = astnodes.with_tree(astnodes.with_tree(df, "a", "ta"), "b", "tb")
    got = [
        r[0] for r in both.select("a", "b", astnodes.tree_distance_bound(F.col("ta"), F.col("tb")).alias("d"))
        .select("d").collect()
    ]
    # Module Assign Name Store Constant / Module Assign Name Store Call Name Load Constant
    assert sorted(got, key=lambda v: (v is None, v)) == [0.0, 3 / 8, None]


def test_scoring_run(spark):
    f = spark.createDataFrame(
        [("f1", "java", "int f() { if (a) { b(); } }", 2), ("p1", "python", "def f():\n    return 1\n", 1)],
        "id string, language string, code string, cyclomatic_complexity int",
    )
    pending = spark.createDataFrame(
        [
            ("f1", "m", "refactor", "zero_shot", "int f() { if (a) { if (c) { b(); } } }"),
            ("p1", "m", "refactor", "zero_shot", "def f():\n    if x:\n        return 1\n"),
            ("zz", "m", "refactor", "zero_shot", "int x"),
        ],
        f"{SMALL}, transformed_code string",
    )
    results = spark.createDataFrame(
        [("p1", "m", "refactor", "zero_shot", 0), ("f1", "m", "refactor", "zero_shot", 0)], f"{SMALL}, passed int"
    )
    for trees in (False, True):
        scored = scoring.score(pending, f, results, use_trees=trees)
        got = {r["function_id"]: r for r in scored.collect()}
        assert (got["f1"]["delta_cc"], got["f1"]["preservation"]) == (1.0, 1)
        assert got["f1"]["se_score"] > 0
        assert (got["p1"]["delta_cc"], got["p1"]["preservation"], got["p1"]["se_score"]) == (1.0, 0, 0.0)
        assert got["zz"]["se_score"] is None and got["zz"]["preservation"] is None
        assert tuple(scoring.score_report(scored).collect()[0]) == (2, 1, 3)


def test_rules_and_schema(spark):
    rows = [("f", "m", "refactor", "zero_shot", 1), (None, "m", "refactor", "x", 2), ("f", None, "bad", "zero_shot_heavy", None)]
    df = spark.createDataFrame(rows, f"{SMALL}, preservation int")
    rules = quality.transformation_rules()
    got = {r["rule"]: r["violations"] for r in quality.rule_violations(df, rules).collect()}
    assert got == {
        "function_id_not_null": 1, "model_not_null": 1, "task_domain": 1, "strategy_domain": 1, "preservation_0_or_1": 1,
    }
    good, bad = quality.quarantine(df, rules)
    assert (good.count(), bad.count()) == (1, 2)
    gaps = quality.schema_gaps({"t": df}, {"t": schemas.TRANSFORMATIONS}).collect()
    assert ("t", "se_score", "double") in [tuple(g) for g in gaps] and len(gaps) == 12
    assert quality.schema_gaps({"t": df}, {"t": df.schema}).count() == 0


def test_suites(spark):
    rows = [
        ("j", "java", "import org.junit.Test; @Test"), ("k", "java", "@Test"), ("s", "javascript", "it('x')"),
        ("c", "cpp", "#include <gtest/gtest.h> TEST(a,b)"), ("p", "python", "x = 1"), ("q", "python", "def ("),
    ]
    df = astnodes.with_tree(spark.createDataFrame(rows, "function_id string, language string, test_code string"), "test_code")
    flagged = quality.suite_structure(df, F.col("tree.compile_ok"))
    results = spark.createDataFrame(
        [("p", 1, 80.0, 99), ("q", 1, 90.0, 10), ("j", 1, 90.0, 10)],
        "function_id string, passed int, coverage_pct double, execution_time_ms int",
    )
    verdicts = quality.suite_verdicts(flagged, results)
    got = {r["function_id"]: (r["syntax_valid"], r["functional_valid"], r["fully_valid"], list(r["errors"])) for r in verdicts.collect()}
    assert got == {
        "j": (True, True, False, []), "k": (False, False, False, ["Missing JUnit test structure"]),
        "s": (True, True, False, []), "c": (True, True, False, []), "p": (True, True, True, []),
        "q": (False, False, False, ["Syntax error"]),
    }
    report = quality.suite_report(verdicts).collect()[0]
    assert (report["total"], report["syntax_passed"], report["fully_valid"]) == (6, 4, 1)


def test_statistics_by_hand(spark):
    rows = [("a", x) for x in (1.0, 2.0, 3.0)] + [("b", x) for x in (2.0, 4.0, 6.0)]
    df = spark.createDataFrame(rows, "g string, x double")
    a = stats.anova(df, "g", "x").collect()[0]
    assert (a["df_between"], a["df_within"]) == (1, 4)
    assert a["f_statistic"] == pytest.approx(2.4)
    assert a["eta_squared"] == pytest.approx(6 / 16)
    u = stats.mann_whitney(df, "g", "x", "a", "b").collect()[0]
    assert (u["n1"], u["n2"], u["u1"], u["u2"]) == (3, 3, 1.5, 7.5)
    h = stats.kruskal_wallis(df, "g", "x").collect()[0]
    # ranks 1 2.5 4 / 2.5 5 6: H = 12/42*(7.5^2/3+13.5^2/3)-21 = 1.714..., tie correction 1-6/210
    assert h["h_statistic"] == pytest.approx((12 / 42 * (7.5**2 + 13.5**2) / 3 - 21) / (1 - 6 / 210))


def test_fits_recover_known_coefficients(spark):
    rows = [(float(i), float(i * i % 7), 2.0 * i - 3.0 * (i * i % 7) + 5.0) for i in range(40)]
    df = spark.createDataFrame(rows, "a double, b double, y double")
    got = {r["term"]: r["coefficient"] for r in stats.multiple_fit(df, ["a", "b"], "y").collect()}
    assert got == pytest.approx({"a": 2.0, "b": -3.0, "intercept": 5.0, "r2": 1.0}, abs=1e-6)
    quad = spark.createDataFrame([(float(i), 0.5 * i * i - i + 2) for i in range(20)], "x double, y double")
    got = {r["term"]: r["coefficient"] for r in stats.quadratic_fit(quad, "x", "y").collect()}
    assert got == pytest.approx({"x": -1.0, "x_squared": 0.5, "intercept": 2.0, "r2": 1.0}, abs=1e-6)
    broken = spark.createDataFrame([(float(i), 1.0 * i if i <= 10 else 33.0 - 2 * i) for i in range(25)], "x double, y double")
    fit = stats.piecewise_fit(broken, "x", "y").collect()[0]
    assert (fit["breakpoint"], round(fit["sse"], 6)) == (10.0, 0.0)
    assert stats.piecewise_fit(broken.limit(0), "x", "y").count() == 0


def test_logistic_separates(spark):
    rows = [(int(i % 4 != 0) if g == "b" else int(i % 4 == 0), g, float(i % 10)) for i in range(400) for g in "ab"]
    df = spark.createDataFrame(rows, "p int, g string, x double")
    got = {r["term"]: r["coefficient"] for r in inference.logistic_fit(df, "p", ["x"], "g").collect()}
    assert got["g=b"] > 1.5


def test_rank_agreement(spark):
    rows = [(f"f{i}", m, t, "zero_shot", float(s)) for i in range(2)
            for t, order in (("refactor", "abc"), ("obfuscate", "cba")) for s, m in enumerate(order)]
    df = spark.createDataFrame(rows, f"{SMALL}, se_score double")
    got = stats.rank_agreement(stats.model_ranks(df)).collect()
    assert [(r["task_a"], r["task_b"], r["models"]) for r in got] == [("obfuscate", "refactor", 3)]
    assert got[0]["spearman"] == pytest.approx(-1.0)


def test_function_rows_from_files(spark):
    body = "\n".join(f"    if (a{i}) {{ b(); }}" for i in range(3))
    files = spark.createDataFrame(
        [
            ("/r/sorts/A.java", "sorts/A.java", "java", f"class A {{\n  public int f(int a) {{\n{body}\n  }}\n}}"),
            ("/r/sorts/b.py", "sorts/b.py", "python", PY),
        ],
        "path string, relative_path string, language string, code string",
    )
    rows = collection.from_files(collection.file_functions(files)).collect()
    got = {(r["task_name"], r["cyclomatic_complexity"], r["domain"], r["source"]) for r in rows}
    assert ("f", 4, "algorithms", "the_algorithms") in got
    assert ("factorial", 3, "algorithms", "the_algorithms") not in got  # indented: no tree of its own
    assert len(rows) == 4


def test_metrics_evaluate_the_normal_form_once(spark):
    df = with_metrics(spark.createDataFrame([("x",)], "code string"))
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("'''") <= 2  # the pattern is printed once per evaluation


def _finished_spend(calls, limit):
    """Admitted calls by following the events one after the other."""
    found = {}
    for n, at, _end, _cost in calls:
        if at is None:
            continue
        spent = sum(
            c or 0.0 for m, s, e, c in calls
            if s is not None and e is not None and ((max(e, s) <= at and s < at) or max(e, s) < at)
        )
        begun = sum(s is not None and (s, m) < (at, n) for m, s, _e, _c in calls)
        done = sum(s is not None and e is not None and ((max(e, s) <= at and s < at) or max(e, s) < at) for _m, s, e, _c in calls)
        if spent < limit:
            found[n] = (spent, begun - done)
    return found


@pytest.mark.parametrize("seed", range(3))
def test_budget_with_calls_in_flight(spark, seed):
    rng = random.Random(seed)
    calls = []
    for n in range(120):
        at = rng.choice([None, *[rng.randrange(60) for _ in range(20)]])
        end = None if at is None or rng.random() < 0.1 else at + rng.choice([-2, 0, 1, 5, 20])
        calls.append((n, at, end, rng.choice([None, 0.0, 0.25, 0.5])))
    df = spark.createDataFrame(calls, "n int, started int, finished int, cost_usd double").withColumn("__spent_x", F.lit("own"))
    got = grid.admitted_in_flight(df, ["n"], 3.0)
    assert got.columns == [*df.columns, "spent_before", "in_flight"]
    rows = {r["n"]: (r["spent_before"], r["in_flight"]) for r in got.collect()}
    assert rows == _finished_spend(calls, 3.0) and 0 < len(rows) < 120
    assert grid.admitted_in_flight(df, ["n"], 0.0).count() == 0
    assert grid.admitted_in_flight(df.limit(0), ["n"], 3.0).count() == 0


def test_overshoot_is_bounded_by_the_calls_in_flight(spark):
    # Four slots, each call takes a second: the limit is reached with four calls under way.
    calls = [(n, n // 4, n // 4 + 1, 1.0) for n in range(40)]
    df = spark.createDataFrame(calls, "n int, started int, finished int, cost_usd double")
    got = grid.admitted_in_flight(df, ["n"], 10.0)
    assert got.count() == 12 and got.agg(F.max("in_flight")).first()[0] == 3


CLASSES = {
    "class A:\n    pass\n": 1,
    "class A:\n    x = 1 if y else 2\n": 2,
    "class A:\n    def f(self):\n        return 1 if self else 2\n": 3,
    # totals 1 + (1 + 1) + ... per method, and one more for several methods
    "class A:\n    def f(self): pass\n    def g(self): pass\n": 2,
    "class A:\n    if y:\n        z = 1\n    def f(self):\n        if a and b: pass\n    def g(self): pass\n": 4,
    # functions in functions and classes in classes or functions are no blocks
    "class A:\n    class B:\n        def f(self):\n            return a or b or c or d or e\n": 1,
    "def f():\n    class B:\n        def g(self):\n            return a or b or c\n    return a or b\n": 2,
    "class A:\n    async def f(self):\n        def g():\n            return a or b or c or d\n        return a or b\n": 3,
}


def test_class_totals(spark):
    rows = list(CLASSES.items())
    df = astnodes.with_tree(spark.createDataFrame(rows, "code string, want int"))
    got = df.select("code", "want", astnodes.tree_complexity(F.col("tree")).alias("cc")).collect()
    assert [(r["code"], r["cc"]) for r in got] == [(r["code"], r["want"]) for r in got]


def _edits(a, b):
    """Edit distance of two ordered trees, given as (label, children), by plain recursion on forests."""

    @functools.cache
    def size(forest):
        return sum(1 + size(kids) for _label, kids in forest)

    @functools.cache
    def distance(left, right):
        if not left or not right:
            return size(left) + size(right)
        (la, ka), (lb, kb) = left[-1], right[-1]
        return min(
            distance(left[:-1] + ka, right) + 1,
            distance(left, right[:-1] + kb) + 1,
            distance(left[:-1], right[:-1]) + distance(ka, kb) + (la != lb),
        )

    return distance((a,), (b,))


def _as_tree(node):
    return (type(node).__name__, tuple(_as_tree(c) for c in ast.iter_child_nodes(node)))


def test_tree_bound_against_the_distance(spark):
    rng = random.Random(5)

    def expression(depth):
        if depth == 0 or rng.random() < 0.3:
            return rng.choice(["a", "1", "b"])
        kind = rng.randrange(5)
        x, y = expression(depth - 1), expression(depth - 1)
        return (f"({x} + {y})", f"f({x}, {y})", f"[{x}, {y}]", f"(not {x})", f"({x} if {y} else a)")[kind]

    pairs = [(expression(3), expression(3)) for _ in range(60)] + [("f(g(a), b)", "g(f(a), b)"), ("[[a], 1]", "[a, [1]]")]
    df = spark.createDataFrame(pairs, "a string, b string")
    both = astnodes.with_tree(astnodes.with_tree(df, "a", "ta"), "b", "tb")
    got = both.select(
        "a", "b", astnodes.tree_distance_bound(F.col("ta"), F.col("tb")).alias("bound"),
        astnodes.branch_distance(F.col("ta"), F.col("tb")).alias("branches"), F.col("ta.label").alias("la"), F.col("tb.label").alias("lb"),
    ).collect()
    tighter = 0
    for r in got:
        labels = collections.Counter(r["la"]), collections.Counter(r["lb"])
        by_labels = max((labels[0] - labels[1]).total(), (labels[1] - labels[0]).total())
        most = max(len(r["la"]), len(r["lb"]))
        exact = _edits(_as_tree(ast.parse(r["a"])), _as_tree(ast.parse(r["b"])))
        assert r["branches"] <= 5 * exact
        assert by_labels - 1e-9 <= r["bound"] * most <= exact + 1e-9
        tighter += r["bound"] * most > by_labels + 1e-9
    assert tighter > 0


def test_latency_sketches_merge(spark, tmp_path):
    rng = random.Random(1)
    rows = [(f"m{i % 2}", f"2024-01-0{1 + i % 5}", None if i % 11 == 0 else rng.randrange(10_000)) for i in range(20_000)]
    log = spark.createDataFrame(rows, "model string, day string, latency_ms int").withColumn("timestamp", F.to_timestamp_ntz("day"))
    days = cost.latency_sketches(log)
    assert days.count() == 10
    at = {"p50": 0.5, "p95": 0.95, "p99": 0.99}
    for r in cost.sketched_percentiles(cost.merged_sketches(days, ["model"]), at).collect():
        values = sorted(v for m, _d, v in rows if m == r["model"] and v is not None)
        assert r["n"] == len(values)
        for name, p in at.items():
            low, high = bisect.bisect_left(values, r[name]), bisect.bisect_right(values, r[name])
            off = 2 * cost.sketch_rank_error() * len(values)
            assert low - off <= p * len(values) <= high + off
    empty = cost.latency_sketches(log.filter("latency_ms IS NULL"))
    assert empty.count() == 0 and cost.sketched_percentiles(cost.merged_sketches(empty), at).count() == 0


def test_live_latencies(spark, tmp_path):
    target, state, source = (str(tmp_path / n) for n in ("target", "state", "source"))
    assert rollups.read_latencies(spark, target).count() == 0
    schema = "model string, latency_ms int, timestamp timestamp_ntz"
    for batch in range(3):
        rows = [("m", 100 * batch + i) for i in range(100)]
        day = F.to_timestamp_ntz(F.lit("2024-01-01"))
        spark.createDataFrame(rows, "model string, latency_ms int").withColumn("timestamp", day).write.mode("append").parquet(source)
        rollups.start_latencies(spark.readStream.schema(schema).parquet(source), target, state).awaitTermination()
        if batch == 1:
            rollups.compact_latencies(spark, target)
    # Fewer values than a sketch holds: it is exact.
    got = cost.sketched_percentiles(rollups.read_latencies(spark, target, ["model"]), {"p50": 0.5, "last": 1.0}).first()
    assert (got["n"], got["last"]) == (300, 299.0) and abs(got["p50"] - 149.5) <= 0.5


def test_contract_report(spark):
    t = spark.createDataFrame([("a", 1, None), (None, 2, 0.5)], "id string, n long, x double")
    want = schemas._struct(("id", T.StringType(), False), ("n", T.IntegerType(), True), ("x", T.DoubleType(), True), ("y", T.DateType(), True))
    got = {r["column"]: r for r in quality.contract_report({"t": t}, {"t": want}).collect()}
    assert {c: (r["present"], r["right_type"], r["nulls"], r["broken"]) for c, r in got.items()} == {
        "id": (True, True, 1, True), "n": (True, False, 0, True), "x": (True, True, 1, False), "y": (False, False, 2, True),
    }
    empty = quality.contract_report({"t": t.limit(0)}, {"t": t.schema, "lost": want}).collect()
    assert [r["broken"] for r in empty if r["table"] == "t"] == [False] * 3
    assert [(r["present"], r["rows"]) for r in empty if r["table"] == "lost"] == [(False, 0)] * 4


def test_means_from_parts(spark):
    rng = random.Random(7)
    rows = [(rng.choice("abc"), rng.choice([None, *range(9)]), rng.randrange(5)) for _ in range(200)] + [("none", None, 0)]
    df = spark.createDataFrame(rows, "g string, x int, part int")
    parts = [cost.mean_parts(df.filter(F.col("part") == k), ["g"], F.col("x")) for k in range(5)]
    got = {r["g"]: r["mean"] for r in cost.merged_means(functools.reduce(lambda a, b: a.unionByName(b), parts), ["g"]).collect()}
    for g in "abc":
        values = [x for h, x, _ in rows if h == g and x is not None]
        assert got[g] == pytest.approx(sum(values) / len(values))
    assert got["none"] is None


def test_repeated_keys(spark):
    df = spark.createDataFrame([("a",), ("a",), ("b",), (None,), (None,)], "code_hash string")
    assert [tuple(r) for r in corpus.repeated_keys(df).collect()] == [("a", 2)]
