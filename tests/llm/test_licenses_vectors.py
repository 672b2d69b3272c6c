"""Licence scan, whitening and hard negatives against brute force, and on awkward rows."""

import math
import random
import re
import string

import numpy as np
import pytest
from pyspark.sql import functions as F

from refracta.llm import common, licenses, negatives, queries, whitening

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
UPPER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)
PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}


def words_of(text):
    return WORD.findall((text or "").translate(UPPER))


def plain_licenses(texts):
    """All templates tried at every place of every text."""
    docs = [words_of(t) for t in texts]
    df = {}
    for w in {w for t in licenses.TEMPLATES for w in t.words}:
        df[w] = sum(w in d for d in docs)
    weigh = {w: len(bin((len(docs) + 1) // (n + 1))) - 2 for w, n in df.items()}
    out = []
    for d in docs:
        places = sorted((i, p) for p in PHRASES for i in range(len(d)) if d[i : i + len(p.split())] == p.split())
        labels, score = {PHRASES[p] for _, p in places}, 0.0
        for t in licenses.TEMPLATES:
            for start in range(-len(t.words), len(d)):
                here = [0 <= start + p < len(d) and d[start + p] == w for p, w in enumerate(t.words)]
                if all(here[p] for p in t.needed):
                    share = sum(weigh[w] for w, h in zip(t.words, here) if h) / sum(weigh[w] for w in t.words)
                    score = max(score, share)
                    if share >= 0.5:
                        labels.add(t.label)
        out.append(
            (
                len(d),
                len(places),
                places[0][0] if places else None,
                places[-1][0] if places else None,
                ",".join(sorted({PHRASES[p] for _, p in places})),
                ",".join(sorted(labels)),
                score,
            )
        )
    return out


TEXTS = [
    "Licensed under the Apache License, Version 2.0.",
    "apache license apache license MIT LICENSE",
    "license version 2 0",
    "This work is licensed under the GNU General Public License, version 3; gnu general public license",
    "gnu general public gnu general public license",
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the",
    "Permission is hereby granted, free of charge, to nobody",
    "under the terms of the GNU General Public License as published by the FSF; either version 3 of the License",
    "cc by-nc 4.0 cc",
    "cc",
    "",
    None,
    "?? --",
    "mit license " * 3000,
    "x" * 300_000 + " mit license",
    "bsd license",
    "mit license mit_license",
]


def licence_rows(spark, texts):
    rows = [(i, t, "clash", 1) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, found string, n_words int")


def test_licenses_match_brute_force(spark):
    rng = random.Random(5)
    parts = [w for t in licenses.TEMPLATES for w in t.words] + ["and", "other", "words"]
    texts = TEXTS + [
        " ".join(
            x
            for _ in range(rng.randrange(1, 6))
            for x in (rng.choice(licenses.TEMPLATES).words if rng.random() < 0.5 else rng.choices(parts, k=9))
        )
        for _ in range(150)
    ]
    got = {r["doc_id"]: tuple(r)[1:] for r in licenses.licenses(licence_rows(spark, texts)).collect()}
    assert [got[i] for i in range(len(texts))] == plain_licenses(texts)


def test_license_operator_gives_places(spark):
    rows = licence_rows(spark, ["so: licensed under the Apache License, Version 2.0"])
    found = licenses.notices(rows).first()["found"]
    assert {(f["label"], f["first"], f["share"]) for f in found} == {("apache", 4, 1.0), ("apache-2.0", 1, 1.0)}


def test_licenses_of_repeats_and_nothing(spark):
    rows = licence_rows(spark, TEXTS)
    twice = licenses.licenses(rows.union(rows))
    assert twice.count() == 2 * len(TEXTS)
    assert twice.distinct().count() == len(TEXTS)
    assert licenses.licenses(rows.limit(0)).collect() == []


def test_a_template_needs_its_phrases():
    with pytest.raises(ValueError):
        licenses.template("x", "one two", ("three",))


def test_pieces_follow_bytes_and_rows():
    import pyarrow as pa

    texts = ["a" * 3_000_000, None, "b" * 3_000_000, "c" * 9_000_000, "", "d"] + ["e"] * 1200
    batch = pa.record_batch([pa.array(texts)], names=["text"])
    got = list(common.pieces(iter([batch, batch.slice(2, 3), batch.slice(0, 0)])))
    assert [t for p in got for t in p.column("text").to_pylist()] == texts + texts[2:5]
    assert [p.num_rows for p in got][:3] == [2, 1, 1]
    assert max(p.num_rows for p in got) <= common.PIECE_ROWS


# ---- whitening


def plain_whitening(vectors, components=16):
    x = [tuple(math.floor(64 * c) + 1_000_000 for c in v) for v in vectors]
    kept = sorted(set(x))
    n, dims = len(kept), len(kept[0])
    sums = [sum(v[d] for v in kept) for d in range(dims)]
    y = np.array([[n * v[d] - sums[d] for d in range(dims)] for v in kept], object)
    cov = np.array([[sum(y[:, i] * y[:, j]) / n**3 for j in range(dims)] for i in range(dims)], float)
    values, columns = np.linalg.eigh(cov)
    order = np.argsort(values)[::-1][:components]
    out = {}
    for i, v in enumerate(x):
        c = np.array([n * a - s for a, s in zip(v, sums)], object)
        out[i] = (n, sum(int(a) ** 2 for a in c), (c / n).astype(float) @ columns[:, order] / np.sqrt(values[order]))
    return out, values[order] / values.sum()


def vector_rows(spark, vectors, kind="float"):
    rows = [(i, v, 0, "clash", 1) for i, v in enumerate(vectors)]
    return spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>, label int, x string, carried int")


@pytest.mark.parametrize("spread", [1.0, 1e6, 1e13])
def test_whitening_matches_brute_force(spark, spread):
    rng = np.random.Generator(np.random.PCG64(3))
    base = rng.normal(size=(60, 5)) @ rng.normal(size=(5, 5)) * spread
    vectors = [*base.tolist(), *base[:20].tolist(), *[base[3].tolist()] * 30]
    want, explained = plain_whitening(vectors)
    found = whitening.whiten(vector_rows(spark, vectors, "double")).collect()
    assert sorted(r["vec_id"] for r in found) == list(range(len(vectors)))
    signs = None
    for r in sorted(found, key=lambda r: r["vec_id"]):
        n, deviation, whitened = want[r["vec_id"]]
        got = np.array(r["whitened"])
        signs = np.sign(got * whitened) if signs is None else signs
        assert (r["n"], int(r["deviation"])) == (n, deviation)
        assert np.allclose(got, whitened * signs, rtol=1e-7, atol=1e-9)
        assert np.allclose(r["explained"], explained, rtol=1e-9)
        assert r["identity_error"] < 1e-6


def test_whitening_query_covers_the_table(spark):
    rows = queries.QUERIES["op12_whitening"](spark, SF)
    vectors = {r["vec_id"]: r["embedding"] for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()}
    ids = sorted(vectors)
    want, explained = plain_whitening([vectors[i] for i in ids])
    got = {(r["vec_id"], r["component"]): r for r in rows.collect()}
    assert set(got) == {(i, c) for i in ids for c in range(1, 17)}
    for c in range(1, 17):
        column = np.array([got[i, c]["whitened"] for i in ids])
        known = np.array([want[k][2][c - 1] for k in range(len(ids))])
        assert min(np.abs(column - known).max(), np.abs(column + known).max()) < 1e-8
        assert abs(got[ids[0], c]["explained"] - explained[c - 1]) < 1e-9
    assert all(got[i, 1]["deviation"] == want[k][1] for k, i in enumerate(ids))
    assert {r["identity_error"] for r in got.values()} == {got[ids[0], 1]["identity_error"]}
    assert got[ids[0], 1]["identity_error"] < 1e-4


def test_whitening_of_awkward_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = vector_rows(
        spark, [[1.0, 2.0], None, [nan, 1.0], [1.0, inf], [None, 1.0], [], [1.0, 2.0], [3.0, 5.0], [1.0, 2.0, 3.0]], "double"
    )
    found = {r["vec_id"]: r for r in whitening.whiten(rows).collect()}
    assert sorted(found) == [0, 6, 7]
    assert found[0]["n"] == 2 and found[0]["whitened"] == found[6]["whitened"]
    # two vectors vary along one line only: the second component has no variance
    assert abs(abs(found[7]["whitened"][0]) - 1) < 1e-12 and found[7]["whitened"][1] is None
    assert found[0]["explained"][1] < 1e-12 and found[0]["identity_error"] < 1e-12
    one = whitening.whiten(rows.filter("vec_id = 0")).first()
    assert (one["n"], int(one["deviation"]), one["whitened"], one["explained"]) == (1, 0, [None, None], [0.0, 0.0])
    assert whitening.whiten(rows.filter("vec_id < 0")).collect() == []
    assert whitening.whiten(rows.filter("vec_id = 1")).collect() == []


def test_square_sums_are_exact():
    rng = random.Random(2)
    for bits in (8, 27, 40, 51, 57, 70):
        rows = [[rng.randrange(-(2**bits), 2**bits) for _ in range(3)] for _ in range(500)]
        y = np.array(rows, np.int64 if bits < 62 else object)
        assert whitening.square_sums(y) == [sum(r[k] ** 2 for r in rows) for k in range(3)]


# ---- hard negatives


@pytest.mark.parametrize("most", [1, 100, 5_000, 10**6, 10**9, 10**17])
def test_packed_products_are_exact(most):
    rng = random.Random(most)
    a = [[rng.randrange(-most, most + 1) for _ in range(13)] for _ in range(7)]
    c = [[rng.randrange(-most, most // 2 + 1) for _ in range(13)] for _ in range(23)]
    got = negatives.packed_products(np.array(a, np.int64), np.array(c, np.int64))
    assert [[int(s) for s in row] for row in got] == [[sum(p * q for p, q in zip(x, y)) for y in c] for x in a]


def test_packed_products_of_nothing():
    assert negatives.packed_products(np.zeros((0, 3), np.int64), np.zeros((2, 3), np.int64)).shape == (0, 2)
    assert negatives.packed_products(np.zeros((2, 0), np.int64), np.zeros((3, 0), np.int64)).tolist() == [[0] * 3] * 2


def plain_negatives(rows, every=10):
    whole = [
        (i, label, [math.floor(256 * c) for c in v])
        for i, label, v in rows
        if i is not None and label is not None and v is not None and all(c is not None and math.isfinite(c) for c in v)
    ]
    out, anchors = [], []
    for row in whole:
        if row[0] % every == 0 and row not in anchors:
            anchors.append(row)
    for i, label, x in anchors:
        others = [(sum(a * b for a, b in zip(x, y)), j, m) for j, m, y in whole if j != i and len(y) == len(x)]
        others.sort(key=lambda o: (-o[0], o[1]))
        for s, j, _ in [o for o in others if o[2] == label][:5]:
            fits = [o for o in others if o[2] != label and 30 * s <= 100 * o[0] <= 90 * s]
            out += [(i, j, k, o[1], s, o[0]) for k, o in enumerate(fits[:10], 1)]
    return sorted(out)


def negative_rows(spark, rows):
    schema = "vec_id long, label int, embedding array<double>, anchor string, score string, x string"
    return spark.createDataFrame([(*r, "a", "b", "c") for r in rows], schema)


@pytest.mark.parametrize("blocks", [(2048, 4096), (3, 17)])
def test_hard_negatives_match_brute_force(spark, blocks, monkeypatch):
    monkeypatch.setattr(negatives, "ANCHOR_BLOCK", blocks[0])
    monkeypatch.setattr(negatives, "CANDIDATE_BLOCK", blocks[1])
    rng = random.Random(9)
    nan = float("nan")
    rows = [(i, rng.randrange(4), [round(rng.random() * 3 - 0.7) / 4 for _ in range(4)]) for i in range(150)]
    rows += [(200, 1, None), (210, None, [1.0] * 4), (220, 2, [nan, 1.0, 1.0, 1.0]), (230, 2, [None, 1.0, 1.0, 1.0])]
    rows += [(None, 1, [1.0] * 4), (240, 9, [1.0] * 4), (250, 1, []), (251, 1, []), (260, 1, [1.0, 1.0]), (-10, -1, [0.5] * 4)]
    rows += [rows[20], rows[20], rows[35], (30, 3, [0.25] * 4)]  # whole repeats, and an id with two vectors
    got = negatives.hard_negatives(negative_rows(spark, rows), F.col("vec_id") % 10 == 0)
    assert sorted(tuple(r) for r in got.collect()) == plain_negatives(rows)
    assert dict(got.dtypes)["rank"] == "int"


def test_hard_negatives_of_one_common_vector(spark):
    rows = [(i, i % 2, [1.0, 0.5] if i % 3 else [0.5 + i / 300, 0.25]) for i in range(300)]
    got = negatives.hard_negatives(negative_rows(spark, rows), F.col("vec_id") % 10 == 0)
    assert sorted(tuple(r) for r in got.collect()) == plain_negatives(rows)


def test_hard_negatives_of_nothing(spark):
    rows = negative_rows(spark, [(1, 1, [1.0])])
    assert negatives.hard_negatives(rows, F.col("vec_id") == 1).collect() == []
    assert negatives.hard_negatives(rows.limit(0), F.col("vec_id") == 1).collect() == []


def test_far_scores_are_exact(spark):
    rows = [(i, i % 2, [(-1.0) ** i * 10.0**14 + 7.0 * i, 10.0**5 * i]) for i in range(40)]
    want = plain_negatives(rows)
    got = negatives.hard_negatives(negative_rows(spark, rows), F.col("vec_id") % 10 == 0)
    ends = 2**63 - 1
    assert sorted(tuple(r) for r in got.collect()) == sorted((*w[:4], min(w[4], ends), min(w[5], ends)) for w in want)
