"""Licence notices in texts, by a positional index of the rare words of known notices.

The notices are few and known; their words, with template and position, are the index. Of a
text only the words of the index count. A template whose key words are not all in the text is
out at once. For the others the text's highest-IDF key word is looked up, each of its places
fixes where the template would start, and the postings of the next rarer words keep only the
starts at which they stand at the same relative position. What is left has the whole key
phrases in place and is scored by the IDF weight of all template words found in place.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from refracta.llm.common import pieces
from refracta.llm.wordhash import FOLD, as_bytes

#: The phrases that name a licence by themselves, with their labels.
BASE = (
    ("gpl", "gnu general public license"),
    ("apache", "apache license"),
    ("cc-by", "cc by"),
    ("mit", "mit license"),
)
#: Label, the words of a usual notice, and the phrases that must be in place.
NOTICES = (
    ("gpl-3.0", "this work is licensed under the gnu general public license version 3", ("gnu general public license version 3",)),
    ("gpl-2.0", "this work is licensed under the gnu general public license version 2", ("gnu general public license version 2",)),
    (
        "gpl-3.0",
        "under the terms of the gnu general public license as published by the free software foundation either version 3 of the license",
        ("gnu general public license", "version 3 of the license"),
    ),
    (
        "gpl-2.0",
        "under the terms of the gnu general public license as published by the free software foundation either version 2 of the license",
        ("gnu general public license", "version 2 of the license"),
    ),
    ("lgpl", "licensed under the gnu lesser general public license", ("gnu lesser general public license",)),
    ("agpl", "licensed under the gnu affero general public license", ("gnu affero general public license",)),
    ("apache-2.0", "licensed under the apache license version 2 0", ("apache license version 2 0",)),
    ("cc0", "cc0 1 0 universal public domain dedication", ("cc0 1 0",)),
    ("cc-by-4.0", "licensed under cc by 4 0", ("cc by 4 0",)),
    ("cc-by-nc", "licensed under cc by nc 4 0", ("cc by nc",)),
    ("cc-by-nd", "licensed under cc by nd 4 0", ("cc by nd",)),
    ("cc-by-sa", "licensed under cc by sa 4 0", ("cc by sa",)),
    (
        "cc-by",
        "this work is licensed under a creative commons attribution 4 0 international license",
        ("creative commons attribution 4 0",),
    ),
    (
        "cc-by-nc",
        "this work is licensed under a creative commons attribution noncommercial 4 0 international license",
        ("creative commons attribution noncommercial",),
    ),
    (
        "cc-by-sa",
        "this work is licensed under a creative commons attribution sharealike 4 0 international license",
        ("creative commons attribution sharealike",),
    ),
    (
        "mit",
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files",
        ("permission is hereby granted free of charge", "associated documentation files"),
    ),
    ("bsd", "released under the bsd license", ("bsd license",)),
    (
        "bsd",
        "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
        ("redistribution and use in source and binary forms",),
    ),
    (
        "isc",
        "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted",
        ("permission to use copy modify and or distribute",),
    ),
    ("mpl-2.0", "subject to the terms of the mozilla public license v 2 0", ("mozilla public license v 2 0",)),
    ("epl-2.0", "made available under the terms of the eclipse public license 2 0", ("eclipse public license 2 0",)),
    ("bsl-1.0", "distributed under the boost software license version 1 0", ("boost software license version 1 0",)),
    ("unlicense", "this is free and unencumbered software released into the public domain", ("free and unencumbered software",)),
)


@dataclass(frozen=True)
class Template:
    """One notice: its words, and which of their positions belong to a key phrase."""

    label: str
    words: tuple[str, ...]
    needed: tuple[int, ...]
    base: bool


def template(label: str, notice: str, phrases: Sequence[str], base: bool = False) -> Template:
    """The template of ``notice``; each phrase is needed where it first stands in it."""
    words = tuple(notice.split())
    needed: set[int] = set()
    for phrase in phrases:
        part = tuple(phrase.split())
        starts = [i for i in range(len(words) - len(part) + 1) if words[i : i + len(part)] == part]
        if not part or not starts:
            raise ValueError(f"{phrase!r} is not in {notice!r}")
        needed.update(range(starts[0], starts[0] + len(part)))
    return Template(label, words, tuple(sorted(needed)), base)


TEMPLATES = (
    *[template(label, phrase, (phrase,), base=True) for label, phrase in BASE],
    *[template(*notice) for notice in NOTICES],
)
SCHEMA = (
    "doc_id {id}, n_words bigint, "
    "found array<struct<label:string,template:int,base:boolean,first:bigint,share:double>>"
)


class PositionalIndex:
    """Postings (template, position) of every template word, rarest first.

    ``counted`` gives the number of documents with each word, ``documents`` their total. A word
    weighs the binary digits of (documents + 1) / (its documents + 1): its IDF as a whole number.
    """

    def __init__(self, templates: Sequence[Template], counted: dict[str, int], documents: int):
        words = sorted({w for t in templates for w in t.words})
        self.numbers = {w.encode(): i for i, w in enumerate(words)}
        weigh = {w: ((documents + 1) // (counted.get(w, 0) + 1)).bit_length() for w in words}
        self.templates = tuple(templates)
        self.postings: list[list[tuple[int, int, int]]] = []
        self.total: list[int] = []
        self.by_rarest: dict[int, list[int]] = {}
        for k, t in enumerate(templates):
            rows = [(p, self.numbers[w.encode()], weigh[w]) for p, w in enumerate(t.words)]
            rare = sorted(rows, key=lambda r: (counted.get(t.words[r[0]], 0), r[0]))
            needed = [r for r in rare if r[0] in t.needed]
            self.postings.append(needed + [r for r in rare if r[0] not in t.needed])
            self.total.append(sum(r[2] for r in rows))
            self.by_rarest.setdefault(needed[0][1], []).append(k)

    def found(self, words: list[bytes]) -> list[tuple[int, int, float]]:
        """(template, start, share) wherever all key phrases of a template are in place.

        ``start`` is negative where the text begins inside the notice."""
        numbers = np.fromiter(map(self.numbers.get, words, repeat(-1)), np.int32, len(words))
        places = np.flatnonzero(numbers >= 0)
        if not len(places):
            return []
        present = set(np.unique(numbers[places]).tolist())
        out: list[tuple[int, int, float]] = []
        for word in present & self.by_rarest.keys():
            at = places[numbers[places] == word]
            for k in self.by_rarest[word]:
                out += self._aligned(k, at, numbers, present)
        return out

    def _aligned(self, k: int, at: np.ndarray, numbers: np.ndarray, present: set[int]) -> list[tuple[int, int, float]]:
        n_needed = len(self.templates[k].needed)
        needed, others = self.postings[k][:n_needed], self.postings[k][n_needed:]
        if not all(w in present for _, w, _ in needed):
            return []
        starts = at - needed[0][0]
        for position, word, _ in needed[1:]:
            starts = starts[_stands(numbers, starts + position, word)]
            if not len(starts):
                return []
        weights = np.full(len(starts), sum(w for _, _, w in needed), np.int64)
        for position, word, weight in others:
            if word in present:
                weights += weight * _stands(numbers, starts + position, word)
        shares = weights / self.total[k]
        return [(k, s, x) for s, x in zip(starts.tolist(), shares.tolist())]


def _stands(numbers: np.ndarray, places: np.ndarray, word: int) -> np.ndarray:
    """Where ``word`` stands; places outside of the text hold no word."""
    inside = (places >= 0) & (places < len(numbers))
    return inside & (numbers[np.where(inside, places, 0)] == word)


def _count_words(vocabulary: frozenset[bytes]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[bytes] = Counter()
        rows = 0
        for batch in pieces(batches):
            for text in as_bytes(batch.column("text")):
                seen.update(vocabulary.intersection(text.translate(FOLD).split()))
            rows += batch.num_rows
        words = [None, *[w.decode() for w in seen]]
        yield pa.record_batch([pa.array(words, pa.string()), pa.array([rows, *seen.values()], pa.int64())], names=["word", "n"])

    return run


def _scan(index):
    kind = pa.list_(
        pa.struct(
            [("label", pa.string()), ("template", pa.int32()), ("base", pa.bool_()), ("first", pa.int64()), ("share", pa.float64())]
        )
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = index.value
        for batch in pieces(batches):
            counts, found = [], []
            for text in as_bytes(batch.column("text")):
                words = text.translate(FOLD).split()
                counts.append(len(words))
                found.append(
                    [
                        {"label": t.label, "template": k, "base": t.base, "first": s, "share": x}
                        for k, s, x in known.found(words)
                        for t in (known.templates[k],)
                    ]
                )
            yield pa.record_batch(
                [batch.column("doc_id"), pa.array(counts, pa.int64()), pa.array(found, kind)],
                names=["doc_id", "n_words", "found"],
            )

    return run


def notices(docs: DataFrame, templates: Sequence[Template] = TEMPLATES) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): ``n_words`` and the notices ``found``.

    found   array of (label, template, base, first, share): template number, first word of the
            notice (words from 0, negative where the text begins inside the notice) and the
            share of its IDF weight that stands in place; one entry for every place

    Document counts of the template words come from all documents, one row per word and task;
    the index is as large as the templates. NULL and empty texts have no words and no notices.
    Rows that repeat are scanned each and count each. Texts are scanned whole. Other columns
    are ignored, whatever their names; an empty table gives an empty table.
    """
    narrow = docs.select("doc_id", F.col("text"))
    vocabulary = frozenset(w.encode() for t in templates for w in t.words)
    counts = {
        r["word"]: int(r["n"])
        for r in narrow.select("text")
        .mapInArrow(_count_words(vocabulary), "word string, n bigint")
        .groupBy("word")
        .agg(F.sum("n").alias("n"))
        .collect()  # at most one row per word of the templates
    }
    documents = counts.pop(None, 0)
    index = docs.sparkSession.sparkContext.broadcast(PositionalIndex(templates, counts, documents))
    return narrow.mapInArrow(_scan(index), SCHEMA.format(id=dict(narrow.dtypes)["doc_id"]))


def licenses(docs: DataFrame, templates: Sequence[Template] = TEMPLATES, least_share: float = 0.5) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): the licences it names.

    n_words       words of the whole text
    n_base        places where a base phrase stands
    first_word    smallest and ...
    last_word     ... largest start of such a place, NULL without one
    base_labels   labels of those phrases, distinct, sorted, comma-joined
    labels        those and the labels of the notices of which ``least_share`` is in place
    score         largest share of a notice with its key phrases in place, 0 without one

    NULL, empty and repeated rows, clashing names and empty tables: as in :func:`notices`.
    """
    base = F.filter("found", lambda f: f["base"])
    starts = F.transform(base, lambda f: f["first"])
    named = F.filter("found", lambda f: f["base"] | (f["share"] >= least_share))

    def joined(entries):
        return F.concat_ws(",", F.array_sort(F.array_distinct(F.transform(entries, lambda f: f["label"]))))

    return notices(docs, templates).select(
        "doc_id",
        "n_words",
        F.size(base).cast("bigint").alias("n_base"),
        F.array_min(starts).alias("first_word"),
        F.array_max(starts).alias("last_word"),
        joined(base).alias("base_labels"),
        joined(named).alias("labels"),
        F.coalesce(F.array_max(F.transform("found", lambda f: f["share"])), F.lit(0.0)).alias("score"),
    )
