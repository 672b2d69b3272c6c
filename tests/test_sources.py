"""Files, writers and streams, written and read back."""

import json

import pytest
from pyspark.sql import functions as F

from refracta.operators import monitor
from refracta.sources import files, writers
from refracta.streaming import rollups

FUNCTION = {
    "id": "java_rc_000", "language": "java", "code": "x", "code_hash": "h", "cyclomatic_complexity": 1,
    "halstead_volume": 1.5, "lines_of_code": 1, "domain": "io", "source": "rosetta_code", "task_name": "t",
}


def test_jsonl(spark, tmp_path):
    good = tmp_path / "a.jsonl"
    good.write_text(json.dumps(FUNCTION | {"url": "u"}) + "\n")
    other = tmp_path / "b.jsonl"
    other.write_text(json.dumps(FUNCTION | {"id": "j2", "file_path": "p"}) + "\n")
    df = files.read_function_files(spark, [str(good), str(other), str(tmp_path / "missing.jsonl")])
    assert {(r["id"], r["url"], r["file_path"]) for r in df.collect()} == {
        ("java_rc_000", "u", None), ("j2", None, "p")
    }
    with pytest.raises(FileNotFoundError):
        files.read_function_files(spark, [str(tmp_path / "missing.jsonl")])
    bad = tmp_path / "bad.jsonl"
    bad.write_text("{not json\n")
    with pytest.raises(Exception, match="MALFORMED|Malformed"):
        files.read_function_jsonl(spark, str(bad)).collect()


def test_source_tree(spark, tmp_path):
    root = tmp_path / "io_tree"
    body = "def f():\n    return 1\n" * 6
    keep = {"sorts/a.py": body, "math/B.java": body, "x/c.js": body, "x/d.cpp": body}
    drop = {
        "tests/a.py": body, "x/Test_a.py": body, "x/my_spec.js": body, "x/__init__.py": body, "x/a.txt": body,
        "x/small.py": "x", "x/big.py": body * 100, "__pycache__/a.py": body,
    }
    for name, text in (keep | drop).items():
        path = root / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(text)
    (root / "x" / "latin.py").write_bytes(body.encode() + b"# \xe9\n")
    df = files.read_source_tree(spark, str(root))
    got = {r["relative_path"]: (r["language"], r["code"]) for r in df.collect()}
    assert set(got) == set(keep) | {"x/latin.py"}
    assert got["math/B.java"] == ("java", body)
    assert got["x/latin.py"][1] == body + "# \n"


def test_templates(spark, tmp_path):
    for name in ("refactor_zero_shot", "obfuscate_few_shot_k3", "test_gen_java"):
        (tmp_path / f"{name}.txt").write_text(f"{name}\n{{code}}\n")
    templates = files.read_templates(spark, str(tmp_path))
    tasks = files.task_templates(templates, ["refactor", "obfuscate"])
    got = {(r["task"], r["strategy"], r["template"]) for r in tasks.collect()}
    assert ("obfuscate", "few_shot_k3", "obfuscate_few_shot_k3\n{code}\n") in got and len(got) == 2
    assert [r["language"] for r in files.suite_templates(templates).collect()] == ["java"]
    cells = spark.createDataFrame([("refactor", "zero_shot"), ("refactor", "x")], "task string, strategy string")
    files.require_templates(cells.filter("strategy = 'zero_shot'"), tasks)
    with pytest.raises(FileNotFoundError, match="refactor_x"):
        files.require_templates(cells, tasks)


FACTS = "function_id string, model string, task string, strategy string, n int"


def test_append_is_idempotent(spark, tmp_path):
    path = str(tmp_path / "facts")
    batch = spark.createDataFrame([("f", "m", "refactor", "a", 2), ("f", "m", "refactor", "a", 1), ("g", "m", "refactor", "a", 3)], FACTS)
    for _ in range(3):
        writers.append_results(batch, path, ["n"])
    assert sorted(r["n"] for r in spark.read.parquet(path).collect()) == [1, 3]


def test_append_takes_null_keys_as_equal(spark, tmp_path):
    path = str(tmp_path / "facts")
    batch = spark.createDataFrame([("f", None, "refactor", None, 1), (None, "m", "refactor", "a", 2)], FACTS)
    for _ in range(2):
        writers.append_results(batch, path, ["n"])
    assert sorted(r["n"] for r in spark.read.parquet(path).collect()) == [1, 2]


def test_suite_writer(spark, tmp_path):
    suites = spark.createDataFrame(
        [("f1", "java", "code"), ("f2", "python", None)], "function_id string, language string, test_code string"
    )
    writers.write_suites(suites, str(tmp_path / "s"))
    assert [r["file_name"] for r in spark.read.parquet(str(tmp_path / "s")).collect()] == ["f1_test.java"]


STREAM = (
    "function_id string, model string, task string, strategy string, cost_usd double, latency_ms int, "
    "error_type string, se_score double, timestamp timestamp_ntz"
)


def _write_batch(spark, folder, rows):
    df = spark.createDataFrame(rows, "f string, model string, c double, l int, e string, ts string")
    df.select(
        F.col("f").alias("function_id"), "model", F.lit("refactor").alias("task"), F.lit("a").alias("strategy"),
        F.col("c").alias("cost_usd"), F.col("l").alias("latency_ms"), F.col("e").alias("error_type"),
        F.lit(None).cast("double").alias("se_score"), F.col("ts").cast("timestamp_ntz").alias("timestamp"),
    ).coalesce(1).write.mode("append").parquet(folder)


def test_streams_survive_restarts(spark, tmp_path):
    source, table, target = (str(tmp_path / n) for n in ("in", "table", "rollup"))
    day = "2025-03-01 10:00:00"
    _write_batch(spark, source, [("f1", "m", 1.0, 100, None, day), ("f2", "m", 2.0, None, "timeout", day)])

    def run():
        stream = spark.readStream.schema(STREAM).parquet(source)
        rollups.start_rollup(stream, target, str(tmp_path / "c1")).awaitTermination()
        stream = spark.readStream.schema(STREAM).parquet(source)
        rollups.start_append_once(stream, table, str(tmp_path / "c2"), ["timestamp"]).awaitTermination()

    run()
    (r,) = rollups.read_rollup(spark, target).collect()
    assert (r["total_calls"], r["total_cost_usd"], r["avg_latency_ms"]) == (2, 3.0, 50.0)
    assert (r["successful_calls"], r["failed_calls"]) == (1, 1)
    # a second run sees a repeated key and a new one
    _write_batch(spark, source, [("f1", "m", 9.0, 1, None, day), ("f3", "m", 1.0, 10, None, day)])
    run()
    run()
    (r,) = rollups.read_rollup(spark, target).collect()
    assert (r["total_calls"], r["total_cost_usd"], r["failed_calls"]) == (4, 13.0, 1)
    keys = sorted((x["function_id"], x["cost_usd"]) for x in spark.read.parquet(table).collect())
    assert keys == [("f1", 1.0), ("f2", 2.0), ("f3", 1.0)]


def test_rollup_counts_rows_of_any_age(spark, tmp_path):
    source, target = str(tmp_path / "in"), str(tmp_path / "rollup")

    def run(day):
        _write_batch(spark, source, [("f1", "m", 1.0, 100, None, day)])
        stream = spark.readStream.schema(STREAM).parquet(source)
        rollups.start_rollup(stream, target, str(tmp_path / "c")).awaitTermination()

    for day in ("2025-03-10 10:00:00", "2025-03-01 10:00:00", "2025-03-10 23:59:59"):
        run(day)
    want = [("2025-03-01", 1), ("2025-03-10", 2)]

    def got():
        return sorted((str(r["date"]), r["total_calls"]) for r in rollups.read_rollup(spark, target).collect())

    assert got() == want
    rollups.compact_rollup(spark, target)
    rollups.compact_rollup(spark, target)
    assert got() == want and not list((tmp_path / "rollup").glob("part=*"))
    run("2025-02-01 00:00:00")
    assert got() == [("2025-02-01", 1), *want]


def test_live_table_keeps_the_last_two_versions(spark, tmp_path):
    source, target = tmp_path / "in", str(tmp_path / "out")
    for k in range(4):
        spark.range(k, k + 2).write.parquet(f"{source}/{k}")
    stream = spark.readStream.schema("id bigint").option("maxFilesPerTrigger", 1).option(
        "recursiveFileLookup", True
    ).parquet(str(source))
    counted = stream.groupBy("id").count()
    rollups.start_table(counted, target, str(tmp_path / "state")).awaitTermination()
    got = {r["id"]: r["count"] for r in rollups.read_table(spark, target, counted.schema).collect()}
    assert got == {0: 1, 1: 2, 2: 2, 3: 2, 4: 1}
    assert len(list((tmp_path / "out").glob("version=*"))) == 2


LOG = (
    "function_id string, model string, task string, strategy string, cost_usd double, latency_ms int, "
    "se_score double, delta_cc double"
)


def test_monitor_survives_restarts_and_compaction(spark, tmp_path):
    source, target, state = (str(tmp_path / n) for n in ("in", "monitor", "state"))
    rows = [
        [("f1", "m", "t", "a", 1.0, 100, None, 2.0), ("f2", "n", "t", "b", 2.0, None, 1.0, None)],
        [("f1", "n", "u", "a", 0.5, 300, 3.0, 4.0), (None, None, "t", "a", None, 1, None, 1.0)],
        [("f3", "m", "t", "a", 4.0, 50, None, 0.0), ("f2", "m", "t", "a", 0.25, 7, 2.0, 1.0)],
    ]

    def run():
        stream = spark.readStream.schema(LOG).parquet(source)
        rollups.start_monitor(stream, target, state).awaitTermination()

    def check(seen):
        log = spark.createDataFrame(seen, LOG)
        live = rollups.read_monitor(spark, target)
        assert monitor.report_totals(live).collect() == monitor.run_totals(log).collect()
        assert monitor.report_by_model(live).collect() == monitor.by_model(log).collect()
        assert monitor.report_by_task_strategy(live).collect() == monitor.by_task_strategy(log, with_delta=True).collect()

    assert rollups.read_monitor(spark, target).collect() == []
    check([])
    for k in range(3):
        spark.createDataFrame(rows[k], LOG).coalesce(1).write.mode("append").parquet(source)
        run()
        check(sum(rows[: k + 1], []))
        if k == 1:
            rollups.compact_monitor(spark, target)
            # a part that the base holds is replayed
            rollups.write_part(spark.createDataFrame(rows[0], LOG), 0, target, monitor.monitor_parts)
            check(sum(rows[:2], []))
    rollups.compact_monitor(spark, target)
    rollups.compact_monitor(spark, target)
    check(sum(rows, []))
    assert not list((tmp_path / "monitor").glob("part=*"))


def test_report_reads_the_log_once(spark, tmp_path):
    spark.createDataFrame([("f1", "m", "t", "a", 1.0, 100, None, 2.0)], LOG).write.parquet(str(tmp_path / "log"))
    report = monitor.monitor_report(monitor.monitor_parts(spark.read.parquet(str(tmp_path / "log"))))
    assert report._jdf.queryExecution().optimizedPlan().collectLeaves().size() == 1
    assert sorted(r["block"] for r in report.collect()) == ["model", "task_strategy", "totals"]


def test_targets_without_a_batch_are_empty(spark, tmp_path):
    target = str(tmp_path / "nothing")
    assert rollups.read_rollup(spark, target).collect() == []
    assert rollups.read_table(spark, target, spark.range(1).schema).collect() == []
    rollups.compact_rollup(spark, target)
    assert not (tmp_path / "nothing").exists()
