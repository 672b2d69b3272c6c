"""Any column names, and how often the documents are read."""

import pytest
from pyspark.sql import functions as F

from refracta.llm import decontaminate, jaccard_join, language_id, mixing, sharding, toxicity

SF = "/root/testdata/sf0.001"
NAMES = (
    "__words __spans __items __may __lang __score __unsure __source __plan __copies __copy __at_cut __id __first "
    "__rows __key __own_key carried c0 c1 end bucket class_root salt names slot kind least virtual_slot number place key"
).split() + ["with `ticks`", "a.b", "two words", "é"]


@pytest.fixture(scope="module")
def odd(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    mark = F.col("doc_id").cast("string")
    return docs.select("doc_id", *[F.concat(F.lit(f"{n}:"), mark).alias(n) for n in NAMES], "text", "lang", "source", "n_chars")


def checked(before, after):
    """All columns in place, and every value of an extra column that of its own row."""
    assert after.columns == before.columns
    rows = after.collect()
    assert rows
    at = {n: after.columns.index(n) for n in NAMES}
    for r in rows:
        assert all(r[at[n]] == f"{n}:{r[0]}" for n in NAMES)
    return sorted(tuple(r[after.columns.index(n)] for n in ("doc_id", "text", "n_chars")) for r in rows)


def stage(rows, run):
    plain = rows.select("doc_id", "text", "lang", "source", "n_chars")
    got = checked(rows, run(rows))
    assert got == sorted(tuple(r) for r in run(plain).select("doc_id", "text", "n_chars").collect())


def test_language_stage_keeps_any_columns(odd):
    stage(odd, language_id.identified)


def test_copies_stage_keeps_any_columns(odd):
    stage(odd, jaccard_join.one_of_each_class)


@pytest.mark.parametrize("slice_bytes", [10**6, 400])
def test_benchmark_stage_keeps_any_columns(odd, spark, slice_bytes, monkeypatch):
    monkeypatch.setattr(decontaminate, "AUTOMATON_BYTES", slice_bytes)
    items = spark.read.parquet(f"{SF}/benchmark.parquet")
    stage(odd, lambda docs: decontaminate.decontaminate(docs, items))


def test_mixing_stage_keeps_any_columns(odd):
    stage(odd, mixing.mix)


def test_queries_ignore_any_columns(odd, spark):
    plain = odd.select("doc_id", "text", "lang", "source")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    for run in (mixing.mix_plan, sharding.shard, language_id.languages, lambda d: toxicity.toxicity(d, labels)):
        assert sorted(map(str, run(odd).collect())) == sorted(map(str, run(plain).collect()))


def test_documents_are_read_once_whatever_the_items_weigh(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "AUTOMATON_BYTES", 200)
    items = [(f"i{k}", " ".join(f"w{k}x{j}" for j in range(12))) for k in range(20)]
    docs = [(k, f"before {items[k % 20][1]} after" if k % 3 else "none of it " * 20) for k in range(60)]
    read = spark.sparkContext.accumulator(0)

    def counting(batches):
        for batch in batches:
            read.add(batch.num_rows)
            yield batch

    d = spark.createDataFrame(docs, "doc_id long, text string")
    d = d.mapInArrow(counting, d.schema)
    b = spark.createDataFrame(items, "item_id string, text string")
    got = {r["doc_id"]: (r["n_hit"], r["n_items"]) for r in decontaminate.contamination(d, b).collect()}
    assert got == {k: (12, 1) if k % 3 else (0, 0) for k, _ in docs}
    assert read.value == len(docs)


def test_equal_items_are_one_text_with_many_ids(spark):
    item = " ".join(f"q{i}" for i in range(12))
    b = spark.createDataFrame([(i % 900, item) for i in range(5000)], "item_id long, text string")
    d = spark.createDataFrame([(1, item), (2, "else")], "doc_id long, text string")
    got = {r["doc_id"]: r["n_items"] for r in decontaminate.contamination(d, b).collect()}
    assert got == {1: 900, 2: 0}


def test_pair_table_never_misses_a_window(spark):
    items = ["one", "two words", "a b c d e f g h i j k l", "é ü ö"]
    rows = spark.createDataFrame([(t,) for t in items], "text string")
    table = decontaminate.pair_table(rows, 10)
    assert table.single and table.least == 2
    for text in ("ONE", "x two, words y", "b c d e f g h i j k", "É ü ö"):
        assert table.may_hold(text.lower().encode())
    long_only = decontaminate.pair_table(rows.filter("text LIKE 'a b%'"), 10)
    assert (long_only.single, long_only.least) == (False, 10)
    assert long_only.may_hold(b"z b c d e f g h i j k z") and not long_only.may_hold(b"b c d e f g h i j")
    nothing = decontaminate.pair_table(rows.limit(0), 10)
    assert not nothing.may_hold(b"one two words")
