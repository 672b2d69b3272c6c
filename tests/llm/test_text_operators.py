"""The text operators against brute force, and on awkward rows."""

import hashlib
import json
import random
import re
import string
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from refracta.llm import (
    components,
    decontaminate,
    exact_dedup,
    jaccard_join,
    language_id,
    mixing,
    sharding,
    token_counts,
    tool_calls,
    toxicity,
    url_filter,
    wordhash,
)

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
UPPER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)
LONG = " ".join(f"w{i % 7919}" for i in range(120_000))

AWKWARD = [
    (1, "One two three four five six seven.", "en", "b"),
    (2, None, "en", "b"),
    (3, "", None, "b"),
    (4, LONG, "en", None),
    (5, "One two three four five six seven.", "de", "a"),
    (5, "One two three four five six seven.", "de", "a"),
    (None, "One two three four five six seven.", None, None),
    (None, "des mots tout à fait différents, là", "fr", "é"),
    (6, "?!… --", "en", "b"),
    (7, "🙂 ünï çøde", "de", "Z"),
    (8, "x" * 300_000, "en", "b"),
    (9, " \t\n", "en", "b"),
]
#: Names that the operators use for results or on the way.
CLASHES = (
    "node key row size score label digest shard slot place before target taken cut part root links class_id "
    "keep_id kept host path rule verdict bucket salt a b n parent depth toxic held_out virtual_slot rounds"
).split()


@pytest.fixture(scope="module")
def awkward(spark):
    rows = spark.createDataFrame(AWKWARD, "doc_id long, text string, lang string, source string")
    rows = rows.withColumn("n_chars", F.char_length("text").cast("bigint"))
    return rows.withColumns({c: F.lit("clash") for c in CLASHES})


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def words(text):
    return WORD.findall((text or "").translate(UPPER))


def pieces_of(text, width=5):
    w = words(text)
    return frozenset(tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))) if w else frozenset()


# --- words and components --------------------------------------------------------------


def test_word_hashes_follow_the_words():
    texts = ["A b c", "a-B\tc", "aB c", "é É x1", "", "...", LONG[:5000], "x" * 1000 + " " + "x" * 1001]
    for text in texts:
        hashed = wordhash.word_hashes(text.encode())
        assert len(hashed) == len(words(text))
        assert len(set(hashed.tolist())) == len(set(words(text)))
    one, two = (wordhash.word_hashes(t.encode()) for t in ("the quick fox", "quick the fox"))
    assert one[0] == two[1] and one[1] == two[0] and one[2] == two[2]


#: Stretches of over 64 bytes: words, and runs without a word.
STRETCHES = ["x" * 65, "0f" * 50, "字" * 22, "-" * 100, " " * 64 + ".", "\n" * 200]


@pytest.mark.parametrize("stretch", STRETCHES)
def test_word_hashes_do_not_depend_on_the_rest_of_the_text(stretch):
    def hashed(text):
        return wordhash.word_hashes(text.encode()).tolist()

    alone = hashed("one") + hashed("two") + hashed("y" * 130)
    own = hashed(stretch)
    assert len(own) == len(words(stretch))
    for text, want in [
        (f"{stretch} one two {'y' * 130}", own + alone),
        (f"one {stretch} two {'y' * 130}", alone[:1] + own + alone[1:]),
        (f"one two {'y' * 130} {stretch}", alone + own),
    ]:
        assert hashed(text) == want


def test_long_words_differ_in_every_byte():
    base = "a" * 300
    changed = {base[:i] + "b" + base[i + 1 :] for i in range(300)} | {"a" * n for n in range(1, 301)}
    assert len({int(wordhash.word_hashes(w.encode())[0]) for w in changed}) == len(changed)
    # Blocks of 64 bytes that change places.
    parts = ["p" * 64, "q" * 64, "r" * 64]
    orders = {"".join(parts[i] for i in o) for o in [(0, 1, 2), (0, 2, 1), (1, 0, 2), (1, 2, 0), (2, 0, 1), (2, 1, 0)]}
    assert len({int(wordhash.word_hashes(w.encode())[0]) for w in orders}) == 6


def test_components_of_random_graphs(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(i, i + 1) for i in range(500, 640)]
    edges += [(7, 7), (None, 3)]
    low = {x: x for e in edges for x in e if x is not None and e[0] != e[1] and None not in e}
    changed = True
    while changed:
        changed = False
        for a, b in edges:
            if a in low and b in low and low[a] != low[b] and None not in (a, b):
                low[a] = low[b] = min(low[a], low[b])
                changed = True
    got = components.components(spark.createDataFrame(edges, "a long, b long"))
    assert {r["id"]: r["root"] for r in got.collect()} == low
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


# --- 1: n-gram Jaccard join ------------------------------------------------------------


def brute_links(rows, threshold=0.8):
    """Per row (links, class) by comparing everything with everything."""
    sets = [pieces_of(t) for _, t in rows]
    n, root = [0] * len(rows), list(range(len(rows)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, x in enumerate(sets):
        for j in range(i):
            y = sets[j]
            if x and y and len(x & y) >= threshold * len(x | y) - 1e-9:
                n[i], n[j] = n[i] + 1, n[j] + 1
                root[max(top(i), top(j))] = min(top(i), top(j))
    members = {}
    for i in range(len(rows)):
        members.setdefault(top(i), []).append(i)
    least = {k: min((rows[i][0] for i in v if rows[i][0] is not None), default=None) for k, v in members.items()}
    return [(n[i], least[top(i)] if sets[i] else rows[i][0]) for i in range(len(rows))]


def near_copies(n, seed=5):
    """Different texts, each a few words away from one text: similarities around 0.8."""
    rng = random.Random(seed)
    base = [f"b{i}" for i in range(80)]
    out = []
    for i in range(n):
        own = list(base)
        for at in rng.sample(range(80), rng.randrange(1, 4)):
            own[at] = f"n{i}x{at}"
        out.append((1000 + i, " ".join(own)))
    return out


def test_jaccard_join_against_brute_force(spark, documents):
    rows = [(r["doc_id"], r["text"]) for r in documents.collect()] + near_copies(600)
    rng = random.Random(1)
    rng.shuffle(rows)
    got = jaccard_join.jaccard_classes(spark.createDataFrame(rows, "doc_id long, text string").repartition(7))
    found = {r["doc_id"]: (r["links"], r["class_id"]) for r in got.collect()}
    want = {i: x for (i, _), x in zip(rows, brute_links(rows))}
    assert found == want
    assert max(n for n, _ in want.values()) > 100


def test_jaccard_join_of_texts_with_a_long_stretch(spark):
    rows = []
    for k, stretch in enumerate(STRETCHES):
        base = [f"t{k}w{i}" for i in range(80)]
        rows += [(10 * k, " ".join(base)), (10 * k + 1, " ".join([*base, stretch])), (10 * k + 2, " ".join([stretch, *base]))]
        rows.append((10 * k + 3, " ".join([*base[:40], stretch, *base[40:]])))
    want = brute_links(rows)
    assert all(n == 3 for n, _ in want)
    got = jaccard_join.jaccard_classes(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {r["doc_id"]: (r["links"], r["class_id"]) for r in got.collect()} == {i: x for (i, _), x in zip(rows, want)}


def test_jaccard_join_on_awkward_rows(awkward, spark):
    got = jaccard_join.jaccard_classes(awkward).collect()
    assert len(got) == len(AWKWARD)
    want = brute_links([(r[0], r[1]) for r in AWKWARD])
    key = str
    assert sorted(((r["doc_id"], r["links"], r["class_id"]) for r in got), key=key) == sorted(
        ((r[0], *x) for r, x in zip(AWKWARD, want)), key=key
    )
    kept = jaccard_join.one_of_each_class(awkward)
    assert kept.columns == awkward.columns
    # 1, 5, 5 and one row without id are one class; texts without words stay.
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == sorted("1 2 3 4 None 6 7 8 9".split())
    assert jaccard_join.jaccard_classes(awkward.limit(0)).count() == 0
    assert jaccard_join.one_of_each_class(awkward.limit(0)).count() == 0


@pytest.mark.parametrize("tail", ["", " last"])
def test_one_of_each_class_keeps_classes_apart_that_share_an_id(spark, tail):
    a, b = " ".join(f"a{i}" for i in range(80)), " ".join(f"b{i}" for i in range(80))
    near = b + tail  # one or two shingle sets in a class
    for rows, want in [
        ([(None, a), (None, a), (None, b), (None, near)], {(None, "a0"), (None, "b0")}),
        ([(5, a), (6, a), (5, b), (7, near)], {(5, "a0"), (5, "b0")}),
        ([(5, a), (5, a), (None, b), (None, near), (5, "alone"), (None, None)], {(5, "a0"), (None, "b0"), (5, "alone"), (None, None)}),
    ]:
        df = spark.createDataFrame(rows, "doc_id long, text string")
        got = [(r["doc_id"], r["text"] and r["text"].split()[0]) for r in jaccard_join.one_of_each_class(df).collect()]
        assert len(got) == len(want) and set(got) == want


def test_pruning_bounds():
    bounds = jaccard_join.least_matches(0.8, 1e-6)
    assert bounds == sorted(bounds) and len(bounds) == 8 and 0 < bounds[0] < 16 * 0.8
    rng = np.random.default_rng(0)
    # 20,000 pairs of similarity 0.8: none may be dropped on the way.
    same = rng.random((20_000, 128)) < 0.8
    counts = same.cumsum(axis=1)[:, 15::16]
    assert (counts >= np.array(bounds)).all()


# --- 2: tool calls ---------------------------------------------------------------------

SCHEMAS = {"f": {"x": ("integer", True), "y": ("number", False), "z": ("array", False)}}


def test_tool_calls_link_order_and_validate(spark):
    calls = [
        ("k", 5, "c1", "f", '{"y": 1.5, "x": 1}', None),
        ("k", 1, "c2", "f", '{"x":2,"y":3}', "c1"),  # logged before what it needs
        ("k", 2, "c3", "f", '{"x":"2","z":{}}', "c2"),
        ("k", 7, "c3", "f", '{"x":9}', None),  # repeats an identifier
        ("k", 3, "l1", "f", '{"x":1}', "l2"),
        ("k", 4, "l2", "f", '{"x":1}', "l1"),
        ("k", 8, "c4", "g", '{"b":[2,1], "a" : {"d":1,"c":"é\\n"}}', "nothing"),
        ("k", 9, "c5", "f", '{"x":', None),
        ("k", 10, "c6", "f", "[1]", None),
        ("k", 11, None, "f", '{"q":1}', None),
        (None, 1, "c1", "f", '{"x":1}', None),
    ]
    results = [("k", 6, "c1", "later"), ("k", 6, "c1", "first"), ("k", 2, "c2", None), ("k", 3, "zz", "lost"), (None, 2, "c1", "other"), ("k", 1, None, "no id")]
    c = spark.createDataFrame(calls, "conv_id string, turn long, call_id string, name string, arguments string, after string")
    r = spark.createDataFrame(results, "conv_id string, turn long, call_id string, content string")
    c = c.withColumns({n: F.lit("clash") for n in ("key", "row", "depth", "errors", "answer", "first", "to", "parent")})
    got = tool_calls.linked(c, r, SCHEMAS).orderBy("conv_id", "position").collect()
    by = {(x["conv_id"], x["call_id"], x["status"]): x for x in got}
    assert len(got) == len(calls) + 2
    assert [x["position"] for x in got if x["conv_id"] == "k"] == list(range(1, 13))
    assert by[("k", "c1", "ok")]["depth"] == 0 and by[("k", "c2", "ok")]["depth"] == 1
    assert json.loads(by[("k", "c1", "ok")]["json"])["result"] == "first" and by[("k", "c1", "ok")]["n_results"] == 2
    third = by[("k", "c3", "invalid")]
    assert third["depth"] == 2 and third["errors"] == "type:x,type:z"
    place = {k[1]: x["position"] for k, x in by.items() if k[0] == "k" and k[2] != "duplicate"}
    assert place["c1"] < place["c2"] < place["c3"]
    assert ("k", "l1", "cycle") in by and ("k", "l2", "cycle") in by and ("k", "c3", "duplicate") in by
    assert by[("k", "c4", "invalid")]["errors"] == "tool"
    assert by[("k", "c4", "invalid")]["json"] == (
        '{"arguments":{"a":{"c":"é\\n","d":1},"b":[2,1]},"errors":["tool"],"id":"c4","name":"g","result":null}'
    )
    assert by[("k", "c5", "invalid")]["errors"] == "malformed" and by[("k", "c6", "invalid")]["errors"] == "not_object"
    assert by[("k", None, "invalid")]["errors"] == "missing:x,unknown:q"
    assert by[(None, "c1", "ok")]["position"] == 1
    assert ("k", "zz", "orphan") in by and ("k", None, "orphan") in by
    assert tool_calls.linked(c.limit(0), r.limit(0), SCHEMAS).count() == 0
    assert tool_calls.linked(c.limit(0), r, SCHEMAS).count() == 5


def test_long_chains_need_few_rounds(spark):
    n = 300
    calls = [("k", n - i, f"c{i}", "f", '{"x":1}', f"c{i - 1}" if i else None) for i in range(n)]
    c = spark.createDataFrame(calls, "conv_id string, turn long, call_id string, name string, arguments string, after string")
    r = spark.createDataFrame([], "conv_id string, turn long, call_id string, content string")
    got = tool_calls.linked(c, r, SCHEMAS).orderBy("position").collect()
    assert [x["call_id"] for x in got] == [f"c{i}" for i in range(n)]


def _longest_ways(needs):
    """Depth of every call by plain recursion; None on and behind a cycle."""
    found = {}

    def depth(key, above):
        if key in above:
            return None
        if key not in found:
            below = [depth(p, above | {key}) for p in needs[key] if p in needs]
            if None in below:
                return None  # not kept: it may depend on where the walk began
            found[key] = max((d + 1 for d in below), default=0)
        return found[key]

    return {key: depth(key, frozenset()) for key in needs}


@pytest.mark.parametrize("cyclic", [False, True])
def test_several_prerequisites_are_peeled(spark, cyclic):
    rng = random.Random(4)
    needs = {}
    for i in range(60):
        wanted = {f"c{rng.randrange(i)}" for _ in range(rng.choice([0, 1, 1, 1, 2, 3]))} if i else set()
        if cyclic and i in (20, 31):
            wanted.add(f"c{51 - i}")
        needs[f"c{i}"] = sorted(wanted) + (["nothing"] if i % 9 == 0 else [])
    rows = [(conv, i, key, "f", '{"x":1}', [*wanted, None]) for conv in ("a", "b") for i, (key, wanted) in enumerate(needs.items())]
    rng.shuffle(rows)
    c = spark.createDataFrame(rows, "conv_id string, turn long, call_id string, name string, arguments string, after array<string>")
    r = spark.createDataFrame([], "conv_id string, turn long, call_id string, content string")
    m = spark.createDataFrame([("a", None, None, None), ("c", 0, "system", "be brief")], "conv_id string, turn long, role string, content string")
    got = tool_calls.linked(c, r, SCHEMAS, m).collect()
    want = _longest_ways(needs)
    assert {(x["conv_id"], x["call_id"]): x["depth"] for x in got if x["call_id"]} == {(v, k): d for v in "ab" for k, d in want.items()}
    assert {x["call_id"] for x in got if x["status"] == "cycle"} == {k for k, d in want.items() if d is None}
    assert (None in want.values()) == cyclic
    place = {(x["conv_id"], x["call_id"]): x["position"] for x in got}
    assert all(place[v, p] < place[v, k] for v in "ab" for k in needs for p in needs[k] if want[k] is not None and p in needs)
    assert sorted((x["conv_id"], x["position"], x["json"]) for x in got if x["status"] == "message") == [
        ("a", 61, '{"content":null,"role":null}'), ("c", 1, '{"content":"be brief","role":"system"}'),
    ]


# --- 3: exact dedup --------------------------------------------------------------------


@pytest.mark.parametrize("bits", [1 << 16, 64])
def test_exact_dedup(awkward, bits, monkeypatch):
    monkeypatch.setattr(exact_dedup, "MAX_BITS", bits)
    got = exact_dedup.exact_dedup(awkward.repartition(5)).collect()
    groups = {}
    for i, text, *_ in AWKWARD:
        groups.setdefault(text or "", []).append(i)
    assert len(got) == len(AWKWARD)
    for text, ids in groups.items():
        digest = hashlib.sha256(text.encode()).hexdigest()
        rows = [r for r in got if r["text_sha256"] == digest]
        best = max((i for i in ids if i is not None), default=None)
        assert [r["kept"] for r in rows].count(True) == 1
        assert {(r["keep_id"], r["group_size"]) for r in rows} == {(best, len(ids))}
        assert next(r for r in rows if r["kept"])["doc_id"] == best
    assert exact_dedup.exact_dedup(awkward.limit(0)).count() == 0


def test_exact_dedup_with_a_saturated_filter(spark, monkeypatch):
    monkeypatch.setattr(exact_dedup, "_slots", lambda bits: F.array(*[F.pmod(F.xxhash64(F.lit(k), "digest"), F.lit(64)) for k in (1, 2)]))
    rows = [(i, f"text {i % 700}") for i in range(3000)]
    got = exact_dedup.exact_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sum(r["kept"] for r in got) == 700
    assert all(r["keep_id"] % 700 == r["doc_id"] % 700 for r in got)


# --- 4: token counts -------------------------------------------------------------------


def test_token_counts_against_a_reference_tokenizer(documents):
    from tokenizers import Tokenizer, models

    vocabulary = token_counts.vocabulary()
    other = Tokenizer(models.Unigram([("<unk>", -1e4), *vocabulary.items()], unk_id=0, byte_fallback=False))
    texts = {r["doc_id"]: r["text"] for r in documents.limit(60).collect()}
    plain = {i: t for i, t in texts.items() if all(c in vocabulary for c in "".join(t.split()))}
    assert len(plain) > 40
    got = {r["doc_id"]: r for r in token_counts.token_counts(documents, vocabulary).collect()}
    for i, text in plain.items():
        assert got[i]["n_words"] == len(text.split())
        assert got[i]["n_tokens"] == sum(len(other.encode("▁" + w).ids) for w in text.split())


def test_token_counts_by_exhaustion_and_awkward_rows(awkward):
    pieces = {"▁": -4.0, "▁a": -2.0, "a": -3.0, "b": -3.0, "ab": -2.5, "ba": -2.0, "aba": -4.4, "abab": -5.0}
    counts = token_counts.Counts(pieces)

    def best(path):
        if not path:
            return (0.0, 0)
        found = []
        for n in range(1, len(path) + 1):
            score, tokens = best(path[:-n])
            if path[-n:] in pieces:
                found.append((score + pieces[path[-n:]], tokens + 1))
            elif n == 1:
                size = len(path[-1].encode())
                found.append((score + counts.byte * size, tokens + size))
        top = max(s for s, _ in found)
        return next(x for x in found if x[0] == top)

    rng = random.Random(2)
    tried = {"".join(rng.choice("abé") for _ in range(rng.randrange(1, 9))) for _ in range(300)}
    counts.add(tried)
    for word in tried:
        assert counts.stored[word] == best("▁" + word)[1], word
    got = token_counts.token_counts(awkward, pieces).collect()
    assert len(got) == len(AWKWARD)
    assert {r["doc_id"]: r["n_tokens"] for r in got if r["doc_id"] in (2, 3, 9)} == {2: 0, 3: 0, 9: 0}
    assert next(r for r in got if r["doc_id"] == 8)["n_tokens"] == 300_001
    assert token_counts.token_counts(awkward.limit(0), pieces).count() == 0


# --- 5: mixing -------------------------------------------------------------------------


def filled(sizes, weights=(5, 2, 1), most=3):
    """Targets by passing the excess on until nothing is above."""
    order = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    target, open_ = {}, set(order)
    while open_:
        left = sum(sizes.values()) - sum(target.values())
        share = left / sum(weight[s] for s in open_)
        over = {s for s in open_ if weight[s] * share >= most * sizes[s]}
        target |= {s: float(most * sizes[s]) for s in over}
        if not over:
            target |= {s: weight[s] * share for s in open_}
            break
        open_ -= over
    return target


def check_mix(df):
    got = mixing.mix_plan(df).collect()
    per, taken = {}, {}
    for r, n in df.join(df.groupBy("doc_id").count(), "doc_id", "left").select("source", mixing.words().alias("n")).collect():
        per[r] = per.get(r, 0) + n
    want = filled(per)
    again = sorted(map(tuple, mixing.mix_plan(df.repartition(3)).collect()), key=str)
    assert sorted(map(tuple, got), key=str) == again
    assert all(0 <= r["taken"] <= 3 * r["size"] for r in got)
    by_size = {}
    for r in got:
        by_size.setdefault((r["source_size"], round(r["target"], 3)), 0)
        by_size[(r["source_size"], round(r["target"], 3))] += r["taken"]
    targets = {}
    for s, t in want.items():
        targets.setdefault((per[s], round(t, 3)), 0)
        targets[(per[s], round(t, 3))] += t
    assert set(by_size) <= set(targets)
    for k, v in by_size.items():
        assert abs(v - targets[k]) <= 1 + 1e-6 * targets[k] + 25, (k, v, targets[k])
    return got, taken


def test_mixing_meets_its_targets(documents, awkward, spark):
    got, _ = check_mix(documents)
    assert len(got) == documents.count()
    assert len(check_mix(awkward)[0]) == len(AWKWARD)
    assert mixing.mix_plan(awkward.limit(0)).count() == 0 and mixing.mix(awkward.limit(0)).count() == 0
    skewed = spark.createDataFrame(
        [(i, "w " * (1 + i % 9), None, "big" if i % 3 else f"s{i % 5}") for i in range(900)],
        "doc_id long, text string, lang string, source string",
    )
    check_mix(skewed)


def test_mixed_documents_are_what_the_plan_takes(documents):
    plan = {r["doc_id"]: r["taken"] for r in mixing.mix_plan(documents).collect()}
    mixed = mixing.mix(documents)
    assert mixed.columns == documents.columns
    taken = {}
    for r in mixed.collect():
        assert r["n_chars"] == len(r["text"])
        taken[r["doc_id"]] = taken.get(r["doc_id"], 0) + len(re.findall(mixing.WORD, r["text"]))
    assert {k: v for k, v in taken.items() if v} == {k: v for k, v in plan.items() if v}


# --- 6: language -----------------------------------------------------------------------


def test_language_is_right_on_held_out_rows(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = language_id.languages(docs).join(docs.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in rows if r["held_out"]]
    assert all((zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) == r["held_out"] for r in rows)
    assert np.mean([r["lang"] == r["lang_pred"] for r in held]) > 0.97
    changed = docs.withColumn("lang", F.when(language_id.fold() == 1, F.lit("xx")).otherwise(F.col("lang")))
    assert sorted(map(tuple, language_id.languages(changed).collect())) == sorted(map(tuple, language_id.languages(docs).collect()))


def test_language_of_awkward_rows(awkward):
    got = language_id.languages(awkward).collect()
    assert len(got) == len(AWKWARD) and all(0 <= r["score"] <= 1 for r in got)
    assert all(r["lang_pred"] == "und" for r in got if r["doc_id"] in (2, 3, 6, 9))
    assert {r["lang_pred"] for r in got} - {"und", "en", "de", "fr"} == set()
    kept = language_id.identified(awkward)
    assert kept.columns == awkward.columns and kept.count() == len(AWKWARD) - 4
    nameless = awkward.withColumn("lang", F.lit(None).cast("string"))
    assert {r["lang_pred"] for r in language_id.languages(nameless).collect()} == {"und"}
    assert language_id.identified(nameless).count() == len(AWKWARD) - 4
    assert language_id.languages(awkward.limit(0)).count() == 0


def test_codewords_are_apart():
    for n in (2, 3, 5, 6, 20):
        code = language_id.codewords(n)
        apart = (code.shape[1] - code @ code.T) / 2 + np.eye(n) * 99
        assert apart.min() >= max(1, code.shape[1] // 4), n
        assert (np.abs(code.sum(axis=0)) < n).all()


# --- 7: sharding -----------------------------------------------------------------------


def test_shards_have_equal_bytes_and_gapless_slots(documents, awkward):
    got = sharding.shard(documents).collect()
    texts = {r["doc_id"]: r["text"] for r in documents.collect()}
    load, places = [0] * 24, {}
    for r in got:
        raw = (texts[r["doc_id"]] or "").encode()
        assert (r["size"], r["text_crc32"]) == (len(raw) + 8, zlib.crc32(raw))
        load[r["shard"]] += r["size"]
        places.setdefault(r["shard"], []).append(r["slot"])
    assert all(sorted(p) == list(range(len(p))) for p in places.values())
    # 200 documents, of which the largest is larger than a fair share
    largest = max(r["size"] for r in got)
    assert max(load) <= max(largest, 1.05 * sum(load) / 24)
    assert len(sharding.shard(awkward).collect()) == len(AWKWARD)
    assert {r["size"] for r in sharding.shard(awkward).filter("doc_id IN (2, 3)").collect()} == {8}
    assert sharding.shard(awkward.limit(0)).count() == 0


def test_rebalancing_moves_only_what_it_must(spark, tmp_path):
    rng = random.Random(4)
    sizes = spark.createDataFrame([(i, rng.randrange(1, 1000)) for i in range(0, 512, 2)], "virtual_slot int, bytes long")
    first = sharding.rebalanced(sizes, 8, slots=512)
    sharding.save_map(first, str(tmp_path), 1)
    current = sharding.read_map(spark, str(tmp_path), 1)
    assert current.count() == 512 and current.select("virtual_slot").distinct().count() == 512
    sharding.save_map(sharding.rebalanced(sizes, 9, current, slots=512), str(tmp_path), 2)
    new = {r["virtual_slot"]: r["shard"] for r in sharding.read_map(spark, str(tmp_path), 2).collect()}
    old = {r["virtual_slot"]: r["shard"] for r in current.collect()}
    bytes_of = {r["virtual_slot"]: r["bytes"] for r in sizes.collect()}
    moved = sum(b for s, b in bytes_of.items() if new[s] != old[s])
    total = sum(bytes_of.values())
    load = [sum(b for s, b in bytes_of.items() if new[s] == k) for k in range(9)]
    assert max(load) - min(load) < 1000 and moved < 1.5 * total / 9
    same = {r["virtual_slot"]: r["shard"] for r in sharding.rebalanced(sizes, 8, current, slots=512).collect()}
    assert sum(bytes_of[s] for s in bytes_of if same[s] != old[s]) < 0.05 * total
    with pytest.raises(Exception, match="exist"):
        sharding.save_map(first, str(tmp_path), 1)


# --- 8: toxicity -----------------------------------------------------------------------


def test_toxicity_on_held_out_rows(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    rows = toxicity.toxicity(docs, labels).join(labels, "doc_id").filter("held_out").collect()
    hit = sum(r["predicted"] and r["toxic"] for r in rows)
    assert hit > 0.8 * sum(r["toxic"] for r in rows)
    assert hit > 0.9 * sum(r["predicted"] for r in rows)


def test_toxicity_of_awkward_rows(awkward, spark):
    labels = spark.createDataFrame([(1, 0), (5, 1), (5, 0), (4, None), (None, 1), (8, 0)], "doc_id long, toxic int")
    got = toxicity.toxicity(awkward, labels).collect()
    assert len(got) == len(AWKWARD) and all(0 <= r["score"] <= 1 for r in got)
    assert len({r["score"] for r in got if r["doc_id"] in (2, 3)}) == 1
    for few in (labels.limit(0), labels.filter("toxic = 1")):
        assert len({r["score"] for r in toxicity.toxicity(awkward, few).collect()}) == 1
    assert toxicity.toxicity(awkward.limit(0), labels).count() == 0


def test_grammar_scores_clauses():
    scorer = toxicity.Scorer({"idiot": 4.0, "moron*": 4.0})

    def best(text):
        return scorer.features(text)[0]

    assert best("what an idiot") == 4.0 and best("the moronic plan") == 4.0
    assert best("you are an idiot") == pytest.approx(6.0)
    assert best("he is not an idiot") == pytest.approx(2.4)
    assert best("they said idiot") == pytest.approx(2.4)
    assert best("I will kill you") > 0 and best("I will kill time") == 0 and best("never kill you") == 0
    assert best("you. idiot") == 4.0  # a clause end stops the aim
    assert best("") == 0


# --- 9: urls ---------------------------------------------------------------------------

URLS = [
    None, "", "no scheme", "http://", "HTTPS://A.Example.ORG/en/12?x#y", "http://example.org/es/", "http://example.org/esx",
    "http://notexample.org/es/", "ftp://x.com/fr/a", "http://com/de/", "http://a.com", "http://org?p=/", "http://é.org/é",
    "http://a://b.org/", "x" * 5000 + "://q.org/" + "y" * 50_000, "http://..org/", "http://EXAMPLE.org/en/1", "http://a.org#/en/1",
]
RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/"), ("block", "", "/x"), ("allow", "org", "/")]


def brute_url(url):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        host = re.match(r"[^/?#]*", rest).group()
        path = re.match(r"[^?#]*", rest[len(host) :]).group()
        host = host.translate(UPPER)
    fits = [r for r in RULES if (host == r[1] or host.endswith("." + r[1])) and path.startswith(r[2])]
    best = max(fits, key=lambda r: len(r[1] + r[2]), default=None)
    return host, path, best and best[1] + best[2], best[0] if best else "allow"


def test_urls_against_brute_force(spark):
    pages = spark.createDataFrame(list(enumerate(URLS)) + [(4, URLS[4])], "page_id long, url string")
    pages = pages.withColumns({c: F.lit("clash") for c in ("host", "path", "rule", "verdict", "row")})
    want = sorted((i, *brute_url(u)) for i, u in [*enumerate(URLS), (4, URLS[4])])
    key = str
    assert sorted((tuple(r) for r in url_filter.judged(pages, RULES).collect()), key=key) == sorted(want, key=key)
    table = spark.createDataFrame(RULES, "verdict string, host string, path string")
    short = pages.filter(F.length("url").isNull() | (F.length("url") < 1000))
    got = sorted((tuple(r) for r in url_filter.judged_by_join(short, table).collect()), key=key)
    assert got == sorted((w for w in want if w[0] != 14), key=key)
    assert url_filter.judged(pages.limit(0), RULES).count() == 0
    assert {r["verdict"] for r in url_filter.judged(pages, []).collect()} == {"allow"}


def test_equal_digests_are_told_apart(monkeypatch, tmp_path):
    monkeypatch.setattr(url_filter, "digest", lambda key: 7)
    index = url_filter.Index.build(RULES)
    index.save(str(tmp_path / "i"))
    index = url_filter.Index.mapped(str(tmp_path / "i"))
    found = index.found([b"org/", b"com/de/", b"com/xx/"], np.array([3, 3, 3]))
    assert [index.key(r) if r >= 0 else None for r in found] == ["org/", "com/de/", None]


# --- 10: decontamination ---------------------------------------------------------------


def brute_hits(text, items, window=10):
    w, hit, found = words(text), set(), set()
    for name, item in items:
        iw = words(item)
        n = min(window, len(iw))
        for at in range(len(iw) - n + 1) if n else ():
            for i in range(len(w) - n + 1):
                if w[i : i + n] == iw[at : at + n]:
                    hit.update(range(i, i + n))
                    found.add(name)
    return len(w), hit, found


@pytest.mark.parametrize("slice_bytes", [10**6, 400])
def test_contamination_against_brute_force(spark, slice_bytes, monkeypatch):
    monkeypatch.setattr(decontaminate, "AUTOMATON_BYTES", slice_bytes)
    rng = random.Random(9)
    letters = "a b c d é 1".split()

    def text(n):
        return rng.choice([" ", ", ", "\n"]).join(rng.choice(letters) for _ in range(n))

    items = [(i, text(rng.choice([2, 3, 5, 9, 10, 11, 14, 40]) + (0 if i % 4 else 1))) for i in range(40)]
    items = [(i, t) for i, t in items if len(words(t)) > 5] + [(50, "..."), (51, None), (52, items[0][1]), (52, items[0][1])]
    docs = [(i, text(rng.randrange(0, 60))) for i in range(40)]
    docs += [(100 + i, f"zz {t} zz {t[:20]}") for i, t in items if t] + [(None, None), (7, "")]
    d = spark.createDataFrame(docs, "doc_id long, text string").withColumn("n_hit", F.lit("clash"))
    b = spark.createDataFrame(items, "item_id long, text string")
    want = []
    for i, t in docs:
        n, hit, found = brute_hits(t, items)
        ids = ",".join(sorted(str(x) for x in found))
        want.append((i, n, len(hit), len(found), hashlib.sha256(ids.encode()).hexdigest(), bool(hit)))
    got = [tuple(r)[:6] for r in decontaminate.contamination(d, b).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert any(w[2] for w in want)


def test_decontaminated_texts(spark, awkward):
    item = " ".join(f"q{i}" for i in range(12))
    other = " ".join(f"o{i}" for i in range(30))
    docs = [(1, f"Before, {item}; after. {other}"), (2, item), (3, other), (4, f"{other} " + " ".join(item.split()[:9])), (5, f"{other} {item.upper()} {other} {item}!")]
    d = spark.createDataFrame(docs, "doc_id long, text string").withColumn("n_chars", F.lit(-1).cast("bigint"))
    b = spark.createDataFrame([(1, item), (2, None)], "item_id long, text string")
    got = {r["doc_id"]: r for r in decontaminate.decontaminate(d, b).collect()}
    assert set(got) == {1, 3, 4, 5}
    assert got[1]["text"] == f"Before, ; after. {other}" and got[1]["n_chars"] == len(got[1]["text"])
    assert got[3]["text"] == other and got[3]["n_chars"] == -1 and got[4]["text"] == docs[3][1]
    assert got[5]["text"] == f"{other}  {other} !"
    same = decontaminate.decontaminate(awkward, b)
    assert same.columns == awkward.columns and same.count() == len(AWKWARD)
    assert sorted(str(r) for r in same.select("doc_id", "text").collect()) == sorted(str(r) for r in awkward.select("doc_id", "text").collect())
    assert decontaminate.contamination(awkward.limit(0), b.limit(0)).count() == 0
    assert decontaminate.contamination(awkward, b.limit(0)).filter("contaminated").count() == 0


def test_short_items_are_cut_too(spark):
    item, other = "who wrote the old man's sea", " ".join(f"o{i}" for i in range(100))
    assert len(words(item)) == 7
    items = [(1, "who wrote the old red book"), (2, item), (3, "zebra")]
    docs = [(1, f"{other} Who wrote the old red book? {other}"), (2, f"{item}, {other} a zebra"), (3, f"{other} who wrote the old red"), (4, other)]
    d = spark.createDataFrame(docs, "doc_id long, text string").withColumn("n_chars", F.char_length("text").cast("bigint"))
    b = spark.createDataFrame(items, "item_id long, text string")
    cleaned = decontaminate.decontaminate(d, b)
    got = {r["doc_id"]: (r["text"], r["n_chars"]) for r in cleaned.collect()}
    want = {1: f"{other} ? {other}", 2: f", {other} a ", 3: docs[2][1], 4: other}
    assert got == {i: (t, len(t)) for i, t in want.items()}
    assert decontaminate.contamination(cleaned, b).filter("contaminated").count() == 0
    assert {r["text"] for r in decontaminate.decontaminate(d, b, max_span=9).collect()} == {t for _, t in docs}
