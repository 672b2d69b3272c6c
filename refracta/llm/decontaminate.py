"""Find and remove passages of test items, with a generalised suffix automaton of the items.

The automaton accepts every run of words of every item. A document's words are streamed
through it, tracking the longest run that ends at each word. Where that run is as long as the
window, its last words are hit; an item shorter than the window is hit only as a whole.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from refracta.llm.common import packed, pieces
from refracta.llm.wordhash import FOLD, as_bytes, mixed, word_hashes
from refracta.session import cut_lineage

WINDOW = 10
#: Bytes of the items in one automaton, some 100 MB of memory in each Python worker. Larger
#: sets of items are split over several automata.
AUTOMATON_BYTES = 1_000_000
#: Slots (bits) of the table of word pairs, 16 MB in each Python worker.
PAIR_SLOTS = 1 << 27
SEGMENT = 32768  # bits of one built-in bitmap
MARKS = "__words bigint, __spans array<struct<first:int,last:int>>, __items array<string>"


class Automaton:
    """Suffix automaton over word numbers; knows which items' windows end in each state."""

    def __init__(self, items: Iterable[tuple[str, bytes]], window: int = WINDOW):
        self.window = self.least = window
        self.numbers: dict[bytes, int] = {}
        self.moves: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        self.names: list[str] = []
        self._ends: list[set[int]] = [set()]
        whole: dict[int, dict[int, set[int]]] = {}
        pairs: set[int] = set()
        for name, text in items:
            words = [self.numbers.setdefault(w, len(self.numbers)) for w in text.translate(FOLD).split()]
            if not words:
                continue
            self.names.append(name)
            pairs.update((a << 32) | b for a, b in zip(words, words[1:]))
            state = 0
            for word in words:
                state = self._read(state, word)
                self._ends[state].add(len(self.names) - 1)
            if len(words) < window:
                self.least = min(self.least, len(words))
                whole.setdefault(state, {}).setdefault(len(words), set()).add(len(self.names) - 1)
        self.pairs = np.array(sorted(pairs) or [-1], np.int64)
        self.found = self._windows(whole)
        del self._ends

    def _state(self, length: int, moves: dict[int, int]) -> int:
        self.moves.append(moves)
        self.link.append(0)
        self.length.append(length)
        self._ends.append(set())
        return len(self.length) - 1

    def _read(self, last: int, word: int) -> int:
        """The state whose longest run is that of ``last`` and ``word``."""
        known = self.moves[last].get(word)
        if known is not None:
            fits = self.length[known] == self.length[last] + 1
            return known if fits else self._split(last, word, known)
        state = self._state(self.length[last] + 1, {})
        while last >= 0 and word not in self.moves[last]:
            self.moves[last][word] = state
            last = self.link[last]
        if last >= 0:
            known = self.moves[last][word]
            fits = self.length[known] == self.length[last] + 1
            self.link[state] = known if fits else self._split(last, word, known)
        return state

    def _split(self, last: int, word: int, known: int) -> int:
        """A state of its own for the shorter runs of ``known``, those that go on from ``last``."""
        shorter = self._state(self.length[last] + 1, dict(self.moves[known]))
        self.link[shorter], self.link[known] = self.link[known], shorter
        while last >= 0 and self.moves[last].get(word) == known:
            self.moves[last][word] = shorter
            last = self.link[last]
        return shorter

    def _windows(self, whole: dict[int, dict[int, set[int]]]) -> list[tuple[tuple[int, tuple[int, ...]], ...]]:
        """Per state the windows that end where its runs end: (words, items)."""
        by_length = sorted(range(1, len(self.length)), key=self.length.__getitem__)
        for state in reversed(by_length):
            self._ends[self.link[state]] |= self._ends[state]
        found: list[tuple[tuple[int, tuple[int, ...]], ...]] = [()] * len(self.length)
        for state in by_length:
            own = [(n, tuple(sorted(x))) for n, x in sorted(whole.get(state, {}).items())]
            if self.length[state] >= self.window > self.length[self.link[state]]:
                own.append((self.window, tuple(sorted(self._ends[state]))))
            found[state] = found[self.link[state]] + tuple(own)
        return found

    def hits(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """Spans [first, last) of hit words, merged, and the items whose windows occur."""
        spans: list[tuple[int, int]] = []
        items: set[str] = set()
        if len(words) < self.least:
            return spans, items
        numbers = np.fromiter(map(self.numbers.get, words, repeat(-1)), np.int64, len(words))
        for start, end in self._runs(numbers):
            self._walk(numbers[start:end].tolist(), start, spans, items)
        return spans, items

    def _runs(self, numbers: np.ndarray) -> list[tuple[int, int]]:
        """Stretches that can hold a window: known words, each pair of them also in an item."""
        if self.least == 1:
            inside = numbers >= 0
            edges = np.flatnonzero(np.diff(inside, prepend=False, append=False))
            return list(zip(edges[::2].tolist(), edges[1::2].tolist()))
        both = np.flatnonzero((numbers[:-1] >= 0) & (numbers[1:] >= 0))
        codes = (numbers[both] << 32) | numbers[both + 1]
        at = np.searchsorted(self.pairs, codes)
        at[at == len(self.pairs)] = 0
        joined = np.zeros(len(numbers), bool)
        joined[both[self.pairs[at] == codes]] = True
        edges = np.flatnonzero(np.diff(joined, prepend=False, append=False))
        starts, ends = edges[::2], edges[1::2] + 1
        long = ends - starts >= self.least
        return list(zip(starts[long].tolist(), ends[long].tolist()))

    def _walk(self, numbers: list[int], offset: int, spans: list[tuple[int, int]], items: set[str]) -> None:
        state = matched = 0
        for i, word in enumerate(numbers, offset + 1):
            while state and word not in self.moves[state]:
                state = self.link[state]
                matched = self.length[state]
            if word not in self.moves[state]:
                continue
            state = self.moves[state][word]
            matched += 1
            for n, members in self.found[state]:
                if n <= matched:
                    items.update(self.names[x] for x in members)
                    if spans and i - n <= spans[-1][1]:
                        spans[-1] = (min(spans[-1][0], i - n), i)
                    else:
                        spans.append((i - n, i))


def merged(spans: Iterable[tuple[int, int]]) -> list[tuple[int, int]]:
    """Disjoint spans in order; overlapping and touching ones become one."""
    out: list[tuple[int, int]] = []
    for first, last in sorted(spans):
        if out and first <= out[-1][1]:
            out[-1] = (out[-1][0], max(last, out[-1][1]))
        else:
            out.append((first, last))
    return out


def _scan(automaton, again: bool):
    """Add the marks of one automaton, and the ids its texts stand for, to every row; ``again``:
    to the marks it has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, ids = automaton.value
        for batch in pieces(batches):
            counts, spans, items = [], [], []
            for i, text in enumerate(as_bytes(batch.column("text"))):
                words = text.translate(FOLD).split()
                own_spans, texts = known.hits(words)
                own_items = {x for t in texts for x in ids[t]}
                if again:
                    before = [(s["first"], s["last"]) for s in batch.column("__spans")[i].as_py()]
                    own_spans, own_items = own_spans + before, own_items | set(batch.column("__items")[i].as_py())
                counts.append(len(words))
                spans.append([{"first": a, "last": b} for a, b in merged(own_spans)])
                items.append(sorted(own_items))
            kept = [n for n in batch.schema.names if n not in ("__words", "__spans", "__items")]
            span = pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32())]))
            yield pa.record_batch(
                [
                    *[batch.column(n) for n in kept],
                    pa.array(counts, pa.int64()),
                    pa.array(spans, span),
                    pa.array(items, pa.list_(pa.string())),
                ],
                names=[*kept, "__words", "__spans", "__items"],
            )

    return run


def _with_marks(schema: StructType) -> StructType:
    return StructType(schema.fields + StructType.fromDDL(MARKS).fields)


def _pair_slots(words: np.ndarray) -> np.ndarray:
    """A slot of the pair table for every two adjacent words."""
    return (mixed(words[:-1] * np.uint64(3) + words[1:]) % np.uint64(PAIR_SLOTS)).astype(np.int64)


def _word_slots(words: np.ndarray) -> np.ndarray:
    return (mixed(words ^ np.uint64(0x5BD1E995)) % np.uint64(PAIR_SLOTS)).astype(np.int64)


def _item_slots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Every slot of the items' pairs, or of the word of an item that is one; with the words of
    the shortest item of the batch."""
    for batch in pieces(batches):
        hashes = [h for h in map(word_hashes, as_bytes(batch.column("text"))) if len(h)]
        slots = [_pair_slots(h) if len(h) > 1 else _word_slots(h) for h in hashes]
        flat = np.unique(np.concatenate(slots)) if slots else np.empty(0, np.int64)
        for kind, least in (("pair", [len(h) for h in hashes if len(h) > 1]), ("word", [1 for h in hashes if len(h) == 1])):
            if least:
                yield pa.record_batch(
                    [pa.array(flat), pa.array([kind] * len(flat)), pa.array([min(least)] * len(flat), pa.int64())],
                    names=["slot", "kind", "least"],
                )


class PairTable:
    """Slots of all items' adjacent words: which documents can hold a window at all."""

    def __init__(self, bits: np.ndarray, least: int | None, single: bool):
        self.bits, self.least, self.single = bits, least, single

    def _set(self, slots: np.ndarray) -> np.ndarray:
        return (self.bits[slots >> 3] >> (slots & 7)) & 1 == 1

    def may_hold(self, text: bytes) -> bool:
        """False only if no window of any item stands in the text."""
        words = word_hashes(text)
        if self.single and len(words) and self._set(_word_slots(words)).any():
            return True
        if self.least is None or len(words) < self.least:
            return False
        hit = self._set(_pair_slots(words))
        edges = np.flatnonzero(np.diff(hit, prepend=False, append=False))
        return bool(len(edges)) and int((edges[1::2] - edges[::2]).max()) >= self.least - 1


def pair_table(items: DataFrame, window: int) -> PairTable:
    """The table of ``items`` (text): PAIR_SLOTS bits, whatever the items weigh."""
    found = items.mapInArrow(_item_slots, "slot bigint, kind string, least bigint")
    segments = found.groupBy(F.expr(f"slot div {SEGMENT}").alias("segment")).agg(
        F.bitmap_construct_agg(F.col("slot") % SEGMENT).alias("bitmap"),
        F.min(F.when(F.col("kind") == "pair", F.col("least"))).alias("least"),
        F.count_if(F.col("kind") == "word").alias("single"),
    )
    bits = np.zeros(PAIR_SLOTS // 8, np.uint8)
    least, single = None, False
    for r in segments.toLocalIterator():  # at most PAIR_SLOTS bits
        at = r["segment"] * SEGMENT // 8
        bits[at : at + SEGMENT // 8] = np.frombuffer(r["bitmap"], np.uint8)
        single |= r["single"] > 0
        if r["least"] is not None:
            least = min(window, r["least"], least or window)
    return PairTable(bits, least, single)


def _flag(table):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            texts = as_bytes(batch.column("text"))
            yield pa.record_batch(
                [
                    *batch.columns,
                    pa.array([len(t.translate(FOLD).split()) for t in texts], pa.int64()),
                    pa.array([table.value.may_hold(t) for t in texts], pa.bool_()),
                ],
                names=[*batch.schema.names, "__words", "__may"],
            )

    return run


Pass = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]


def marked(
    docs: DataFrame, items: DataFrame, window: int = WINDOW, then: Pass | None = None, then_schema: StructType | None = None
) -> DataFrame:
    """``docs`` with ``__words``, ``__spans`` (hit words [first, last)) and ``__items``.

    ``then`` works on the marked batches in the same Python worker and gives ``then_schema``.

    Items with the same text are one text with several ids. Items that fit one automaton are
    looked for in one scan of the documents. For more, the documents are scanned once against a
    table of the items' word pairs and written; only those that may hold a window, as a rule
    the few that do, are then taken through the automata in turn.
    """
    sc = docs.sparkSession.sparkContext
    named = cut_lineage(
        items.select(
            F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("name"),
            F.coalesce("text", F.lit("")).cast("binary").alias("text"),
        )
        .groupBy("text")
        .agg(F.sort_array(F.collect_set("name")).alias("names"))
    )
    weight = F.octet_length("text") + F.aggregate("names", F.lit(0), lambda total, n: total + F.octet_length(n))
    size = named.agg(F.coalesce(F.sum(weight), F.lit(0))).first()[0]
    slices = max(1, -(-int(size) // AUTOMATON_BYTES))
    part = F.pmod(F.xxhash64("text"), F.lit(slices))

    def automaton(k: int):
        rows = named.filter(part == k).collect()  # some AUTOMATON_BYTES
        texts = {str(i): bytes(r["text"]) for i, r in enumerate(rows)}
        return sc.broadcast((Automaton(texts.items(), window), {str(i): r["names"] for i, r in enumerate(rows)}))

    schema = _with_marks(docs.schema)
    if slices == 1:
        scan = _scan(automaton(0), False)
        if then is None:
            return docs.mapInArrow(scan, schema)
        return docs.mapInArrow(lambda batches: then(scan(batches)), then_schema)
    table = sc.broadcast(pair_table(named, window))
    flags = StructType.fromDDL("__words bigint, __may boolean")
    flagged = cut_lineage(docs.mapInArrow(_flag(table), StructType(docs.schema.fields + flags.fields)))
    without = flagged.filter("NOT __may").select(
        *docs.columns, "__words", *[F.array().cast(f.dataType).alias(f.name) for f in StructType.fromDDL(MARKS).fields[1:]]
    )
    found = flagged.filter("__may").select(*docs.columns)
    for k in range(slices):
        found = (cut_lineage(found) if k else found).mapInArrow(_scan(automaton(k), k > 0), schema)
    out = without.unionByName(found)
    return out if then is None else out.mapInArrow(then, then_schema)


def contamination(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text), against ``items`` (item_id, text).

    n_words        words of the whole text
    n_hit          words inside an occurrence of a window of an item
    n_items        item ids with an occurring window
    items_sha256   lowercase hex of those ids as strings, sorted, comma-joined
    contaminated   n_hit > 0
    longest_span   words of the longest unbroken hit

    NULL and empty texts have no words, and items without words no window; repeated item ids
    count once, a NULL id is the empty string. Rows that repeat are judged each. Other
    columns are ignored, whatever their names. Empty tables are fine on either side.
    """
    found = marked(docs.select("doc_id", "text"), items, window)
    lengths = F.transform("__spans", lambda s: (s["last"] - s["first"]).cast("bigint"))
    total = F.aggregate(lengths, F.lit(0).cast("bigint"), lambda a, b: a + b)
    return found.select(
        "doc_id",
        F.col("__words").alias("n_words"),
        total.alias("n_hit"),
        F.size("__items").cast("bigint").alias("n_items"),
        F.sha2(F.concat_ws(",", F.array_sort("__items")).cast("binary"), 256).alias("items_sha256"),
        (total > 0).alias("contaminated"),
        F.coalesce(F.array_max(lengths), F.lit(0)).cast("bigint").alias("longest_span"),
    )


def without_spans(text: bytes, spans: list[tuple[int, int]]) -> bytes:
    """``text`` without the words [first, last) of each span and what stands between them."""
    inside = np.frombuffer(text.translate(FOLD), np.uint8) != 0x20
    edges = np.flatnonzero(np.diff(inside, prepend=False, append=False))
    starts, ends = edges[::2], edges[1::2]
    out, at = [], 0
    for first, last in spans:
        out.append(text[at : starts[first]])
        at = int(ends[last - 1])
    return b"".join([*out, text[at:]])


def _cut(least: int, most: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, keep = batch.column("text").to_pylist(), []
            counted = "n_chars" in batch.schema.names
            chars = batch.column("n_chars").to_pylist() if counted else []
            for i, spans in enumerate(batch.column("__spans").to_pylist()):
                long = [(s["first"], s["last"]) for s in spans if s["last"] - s["first"] >= least]
                hit = sum(s["last"] - s["first"] for s in spans)
                if hit and hit > most * batch.column("__words")[i].as_py():
                    continue
                keep.append(i)
                if long:
                    texts[i] = without_spans(texts[i].encode(), long).decode("utf-8", "replace")
                    if counted:
                        chars[i] = len(texts[i])
            names = [n for n in batch.schema.names if n not in ("__words", "__spans", "__items")]
            columns = {n: batch.column(n) for n in names} | {"text": pa.array(texts, batch.column("text").type)}
            if counted:
                columns["n_chars"] = pa.array(chars, batch.column("n_chars").type)
            yield pa.record_batch(list(columns.values()), names=names).take(pa.array(keep, pa.int64()))

    return run


def decontaminate(
    docs: DataFrame, items: DataFrame, window: int = WINDOW, max_span: int = 0, max_coverage: float = 0.5
) -> DataFrame:
    """``docs`` without the passages of ``items``; all columns stay.

    A hit span of more than ``max_span`` words is cut out of the text: by default every one, the
    occurrence of an item shorter than the window too. A document of whose
    words more than ``max_coverage`` are hit goes. ``n_chars``, where it is a column, follows
    the text. Documents without a hit are returned as they are, NULL and empty texts too.
    Rows that repeat are judged each. Columns may have any names; empty tables are fine on
    either side.
    """
    rows, unpacked = packed(docs, "text", *[n for n in docs.columns if n == "n_chars"])
    return unpacked(marked(rows, items, window, _cut(max_span + 1, max_coverage), rows.schema))
