"""Plans and memory that must hold on tables far larger than the test files."""

import random
import subprocess
import sys
from pathlib import Path

import pandas as pd
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from refracta.constants import NATURAL_KEY, TASKS
from refracta.functions import distance, text
from refracta.operators import astnodes, collection, grid, scoring
from refracta.operators.collection import file_functions
from refracta.operators.results import result_rows
from refracta.sources import catalogue


def physical_plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def broadcasts(df) -> int:
    return physical_plan(df).count("BroadcastExchange")


def test_cached_results_do_not_broadcast_the_grid(spark):
    functions = spark.createDataFrame([("f1",), ("f2",), ("f2",)], "id string")
    facts = spark.createDataFrame(
        [("f1", "m0", "refactor", "zero_shot", 1), ("f1", "m0", "refactor", "zero_shot", 2),
         ("f2", "m0", "obfuscate", "zero_shot", 3), ("f2", "m9", "obfuscate", "zero_shot", 4),
         ("f3", "m0", "obfuscate", "zero_shot", 5), (None, "m0", "obfuscate", "zero_shot", 6)],
        "function_id string, model string, task string, strategy string, n int",
    )
    keys = grid.grid(functions, ["m0", "m1"], TASKS, ["zero_shot"])
    found = grid.cached_results(keys, facts.select("n", *NATURAL_KEY))
    assert found.columns == [*NATURAL_KEY, "n"]
    assert sorted(r["n"] for r in found.collect()) == [1, 2, 3]
    assert broadcasts(found) == 0


def test_result_rows_do_not_broadcast_the_grid_or_the_functions(spark):
    functions = spark.range(3).select(
        F.concat(F.lit("f"), "id").alias("id"), F.lit("python").alias("language"), F.lit(2).alias("cyclomatic_complexity")
    )
    cells = grid.grid(functions, ["m0"], TASKS, ["zero_shot"])
    responses = spark.range(4).select(
        F.concat(F.lit("f"), "id").alias("function_id"), F.lit("m0").alias("model"), F.lit("refactor").alias("task"),
        F.lit("zero_shot").alias("strategy"), F.lit(1).alias("attempt"), F.lit("```\nif x: y()\n```").alias("content"),
        F.lit(None).cast("string").alias("error"), F.lit(5).alias("tokens_input"), F.lit(5).alias("tokens_output"),
        F.lit(7).alias("latency_ms"), F.lit(None).cast("timestamp_ntz").alias("timestamp"),
    )
    rows = result_rows(cells, responses, functions, catalogue.models(spark))
    assert [(r["function_id"], r["transformed_code"]) for r in rows.orderBy("function_id").collect()] == [
        (f"f{i}", "if x: y()") for i in range(3)
    ]
    # only the catalogue, a table of literals
    assert broadcasts(rows) <= 1


def test_trees_are_sent_on_in_bounded_parts():
    code = "def f(a):\n" + "    a = a + 1\n" * 5000
    parts = list(astnodes._chunks(pd.Series([code, None, "x ="] * 6), astnodes.DISTANCE_FIELDS))
    assert [len(p) for p in parts].count(0) == 0 and sum(len(p) for p in parts) == 18
    one = len(parts[0]["kind"][0])
    assert max(sum(len(k) for k in p["kind"]) for p in parts) < astnodes._CHUNK_NODES + one
    assert len(parts) > 1
    assert parts[0].columns.tolist() == list(astnodes.DISTANCE_FIELDS)


def test_trees_of_large_files_keep_their_rows(spark):
    files = spark.range(60).select(
        F.col("id").cast("string").alias("path"), F.lit("p").alias("relative_path"), F.lit("python").alias("language"),
        F.repeat(F.concat(F.lit("def f"), "id", F.lit("(a):\n"), F.repeat(F.lit("    a = a + 1 if a else 2\n"), 4), F.lit("\n")), 200).alias("code"),
    )
    found = file_functions(files).groupBy("path").agg(F.count(F.lit(1)).alias("n"), F.min("name").alias("low"), F.max("name").alias("high"))
    assert {(r["n"], r["low"], r["high"]) for r in found.collect()} == {(200, f"f{i}", f"f{i}") for i in range(60)}


def test_functions_are_parsed_before_they_meet_their_results(spark):
    functions = spark.createDataFrame([("f1", "python", "def f(a):\n    return a\n", 1)], "id string, language string, code string, cyclomatic_complexity int")
    pending = spark.createDataFrame([("f1", i, "def f(a):\n    return a + a\n") for i in range(3)], "function_id string, n int, transformed_code string")
    scored = scoring.score(pending, functions, use_trees=True)
    assert [r["diversity"] for r in scored.select("diversity").collect()] == [pytest.approx(4 / 11)] * 3
    plan = physical_plan(scored)
    # the function's tree is computed below the join, and never broadcast
    assert plan.index("SortMergeJoin") < plan.rindex("ArrowEvalPython") and plan.count("ArrowEvalPython") == 2
    assert plan.index("ArrowEvalPython") < plan.index("SortMergeJoin") and broadcasts(scored) == 0


def test_scores_with_trees_send_no_nodes_and_fill_no_table_per_pair(spark):
    functions = spark.createDataFrame([("f1", "python", "def f(a):\n    return a\n", 1)], "id string, language string, code string, cyclomatic_complexity int")
    pending = spark.createDataFrame([("f1", "def f(a):\n    return a + a\n")], "function_id string, transformed_code string")
    plan = physical_plan(scoring.score(pending, functions, use_trees=True))
    assert not [x for x in ("levenshtein", "array_except", "label", "decisions") if x in plan]


def test_pairs_measured_together_equal_the_trees_and_texts(spark):
    rng = random.Random(11)

    def block(depth, indent):
        pad = "    " * indent
        if depth == 0 or rng.random() < 0.2:
            return pad + rng.choice(["a = b", "f(x, *y, k=1)", "return_ = {1: a, **b}", "global g", "x: int = [i for i in y if i if a]", "assert a or b and c"]) + "\n"
        inner = "".join(block(depth - 1, indent + 1) for _ in range(rng.randrange(1, 4)))
        heads = [
            "if a:", "while b:", "for i, j in c:", "def f(a, *b, c=(d if e else 1)):", "async def g():", "class C(D):", "with a as b:",
            "class E:", "def h(x):", "try:", "match x:",
        ]
        head = rng.choice(heads)
        if head == "match x:":
            return f"{pad}match x:\n{pad}    case 1 | 2 if y:\n" + inner.replace(pad + "    ", pad + "        ") + f"{pad}    case _:\n{pad}        pass\n"
        return f"{pad}{head}\n{inner}" + (f"{pad}except (A, B):\n{pad}    pass\n{pad}else:\n{pad}    z = 1\n" if head == "try:" else "")

    texts = ["".join(block(4, 0) for _ in range(rng.randrange(1, 4))) for _ in range(120)]
    texts += ["", "x =", "def f(:", None, "a" + " + a" * 300, "x\0", "if a: [{;]}", "\u3000if\u2028 b;\x1f\x85 {;}"]
    pairs = [(rng.choice(texts), t, rng.choice(["python", "python", "java", None])) for t in texts for _ in range(3)]
    df = spark.createDataFrame([(i, *p) for i, p in enumerate(pairs)], "i int, a string, b string, language string").repartition(3)
    python = F.col("language") == "python"
    bare = text.without_whitespace(F.col("a"))
    got = df.withColumn("own", astnodes.tree_sketch(F.when(python, F.col("a")))).select(
        "i", astnodes.pair_parts(F.col("own"), bare, F.col("b"), python).alias("p")
    ).select("i", "p.*")
    trees = astnodes.with_tree(astnodes.with_tree(df, "a", "ta", python), "b", "tb", python)
    bound = astnodes.tree_distance_bound(F.col("ta"), F.col("tb"))
    want = trees.select("i", bound.alias("bound"), astnodes.tree_complexity(F.col("tb")).alias("complexity"), bare.alias("a"), text.without_whitespace(F.col("b")).alias("b"))
    want = want.select("i", "bound", "complexity", F.when(F.col("bound").isNull(), distance.edit_shares(F.col("a"), F.col("b"))).alias("share"))
    got, want = (sorted(tuple(r) for r in x.collect()) for x in (got, want))
    assert got == want
    assert len({r[2] for r in want}) > 5 and sum(r[1] is not None and r[1] > 0 for r in want) > 100


def test_whitespace_is_what_texts_are_split_at():
    assert set(text.WS_CHARS) == {chr(i) for i in range(sys.maxunicode + 1) if chr(i).isspace()}


def test_node_numbers_do_not_depend_on_what_was_asked_of_the_module():
    show = "from refracta.operators import astnodes; print(sorted(astnodes._TYPES.items()))"
    ask = "import ast, warnings; warnings.simplefilter('ignore'); [getattr(ast, n, None) for n in ('Num', 'Str', 'Bytes', 'NameConstant', 'Ellipsis')]; "
    plain, asked = (subprocess.run([sys.executable, "-c", c], cwd=Path(entry.__file__).parent, capture_output=True, text=True, check=True).stdout for c in (show, ask + show))
    assert plain == asked


def test_leaderboard_by_range_scores_as_logged(spark):
    queries = entry.queries()
    sf = "/root/testdata/sf0.001"
    by_range, board = (
        sorted(tuple(r) for r in queries[q](spark, sf).select("model", "task", "strategy", "mean_se", "median_se").collect())
        for q in ("a1_leaderboard_by_range", "a1_leaderboard")
    )
    assert by_range == board


def test_the_expanded_grid_is_not_grouped_by_function(spark):
    plan = physical_plan(entry.queries()["j3_experiment_grid"](spark, "/root/testdata/sf0.001"))
    above = plan[: plan.index("Generate explode")]
    assert not [x for x in above.splitlines() if "keys=" in x and "function_id" in x.split("functions=")[0]]


@pytest.mark.parametrize("name", ["e1_normalize_code", "e2_code_hash", "e9_metrics_bundle"])
def test_metrics_of_a_small_file_use_all_cores(spark, name):
    df = entry.queries()[name](spark, "/root/testdata/sf0.001")
    assert "RoundRobinPartitioning" in physical_plan(df)


@pytest.mark.parametrize("name", ["f3_functions_by_tier", "f11_complex_enough"])
def test_filters_on_metrics_run_on_all_cores_and_compute_them_once(spark, name):
    plan = physical_plan(entry.queries()[name](spark, "/root/testdata/sf0.001"))
    below = plan[plan.index("RoundRobinPartitioning") :]
    assert "regexp_extract_all" not in below
    assert plan.count("regexp_extract_all") == 1


def test_distances_of_many_pairs_are_exact_in_blocks_and_alone(monkeypatch):
    rng = random.Random(3)

    def plain(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
        return row[-1]

    pairs = [("", ""), ("a", ""), ("kitten", "sitting")]
    for n in (1, 5, 63, 64, 65, 128, 130, 200):
        for _ in range(12):
            a = rng.choices("ab\u00e9\u4e2d\U0001f600", k=n)
            b = [rng.choice("abx") if rng.random() < 0.2 else c for c in a if rng.random() < 0.9]
            pairs.append(("".join(a), "".join(rng.choice((b, rng.choices("abc", k=rng.randrange(200)))))))
    want = [plain(a, b) for a, b in pairs]
    sides = [list(side) for side in zip(*pairs, strict=True)]
    for per_word in (0, 8, 10**9):
        monkeypatch.setattr(distance, "_PAIRS_PER_WORD", per_word)
        assert distance.distances(*sides).tolist() == want
    for limit in ("_BLOCK_PAIRS", "_BLOCK_CHARS", "_BLOCK_WORDS"):
        with monkeypatch.context() as m:
            m.setattr(distance, "_PAIRS_PER_WORD", 0)
            m.setattr(distance, limit, 300)
            assert distance.distances(*sides).tolist() == want


def test_shares_of_missing_texts_are_null(spark):
    rows = [("abc", "abd"), (None, "a"), ("a", None), ("", ""), ("", "ab")]
    df = spark.createDataFrame(rows, "a string, b string").coalesce(1)
    got = [r[0] for r in df.select(distance.edit_shares("a", "b")).collect()]
    assert got == [pytest.approx(1 / 3), None, None, 0.0, 1.0]


@pytest.mark.parametrize("name", ["e24_text_diversity", "j1_score_transformations", "a27_score_report"])
def test_distances_are_taken_in_batches_and_functions_read_once(spark, name):
    plan = physical_plan(entry.queries()[name](spark, "/root/testdata/sf0.001"))
    assert "levenshtein" not in plan and plan.count("ArrowEvalPython") == 1
    # a function's whitespace goes before it meets its results
    join = plan[plan.index("ArrowEvalPython") :]
    assert join.index("SortMergeJoin") < join.rindex("translate(")


def test_functions_are_measured_before_they_meet_their_results(spark):
    plan = physical_plan(entry.queries()["e38_intensity_conformance"](spark, "/root/testdata/sf0.001"))
    # line counts and complexity are no part of the join's output or of what stands above it
    assert "regexp" not in plan[: plan.index("Join [function_id")]


def test_whitespace_characters_are_those_of_the_pattern(spark):
    df = spark.range(0x20000).filter("id NOT BETWEEN 55296 AND 57343").select(
        F.decode(F.unhex(F.lpad(F.hex("id"), 8, "0")), "UTF-32").alias("c")
    )
    differ = F.rlike("c", F.lit(rf"\A{text.WS}\z")) != F.contains(F.lit(text.WS_CHARS), F.col("c"))
    assert [r["c"] for r in df.filter(differ & (F.col("c") != "")).collect()] == []


def test_a_load_hashes_its_rows_once(spark):
    plan = physical_plan(entry.queries()["s11_insert_flags"](spark, "/root/testdata/sf0.001"))
    assert "sha2" not in plan and "regexp" not in plan


def test_rows_from_files_count_keywords_once_and_compile_nothing(spark, monkeypatch):
    fields = []
    monkeypatch.setattr(collection, "with_tree", lambda df, *a: fields.append(a[-1]) or astnodes.with_tree(df, *a))
    plan = physical_plan(entry.queries()["x2_function_rows_from_files"](spark, "/root/testdata/sf0.001"))
    assert ["compile_ok" in f for f in fields] == [False, False]
    assert plan.count("switch|while") == 1
