"""Toxicity by a weighted finite-state grammar over clauses.

A lexer turns words into a few symbols: insults (with a weight learned from labels), threats,
targets, negations, reporting verbs and clause ends. Small transducers rewrite these symbols:
one weakens what is negated, one what is reported, one joins threats with their targets, one
strengthens insults that are aimed at someone. Their composition is a single table; it reads a
text once, and every clause gets the weight of what it matches.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from refracta.llm.common import fold, pieces

# Words of the grammar in English, German, French and Spanish.
THREATS = """kill hurt destroy beat punch stab shoot burn hang attack crush
töten schlagen verletzen zerstören tuer frapper détruire brûler matar golpear destruir quemar""".split()
TARGETS = """you your yours yourself them those du dich dir dein deine euch ihr
tu toi ton vous vos votre te usted ustedes vosotros""".split()
NEGATIONS = "not no never without isn't don't nicht kein keine nie pas jamais sans nunca jamás ningún sin".split()
REPORTS = """said says say wrote writes claimed called quoted quote according
sagte sagt schrieb zitiert disait écrit selon dijo dice escribió según""".split()

OTHER, INSULT, THREAT, TARGET, NEGATION, REPORT, END = range(7)
# What rewriting makes of insults and threats.
WEAK_INSULT, AIMED_INSULT, AIMED_THREAT = 7, 8, 9
FACTORS = {INSULT: 1.0, AIMED_INSULT: 1.5, WEAK_INSULT: 0.6, AIMED_THREAT: 1.2}
THREAT_WEIGHT = 2.0
REACH = 3  # words that a negation or a target covers

TOKEN = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)?|[.!?;\n]")
PREFIXES = range(5, 9)
#: Bounds of the training: labelled rows, and entries of the lexicon.
SAMPLE_ROWS, LEXICON = 20_000, 3_000
CANDIDATES = 60_000
LEAST_ROWS, LEAST_RATIO = 5, 4.0

Step = Callable[[int, int], tuple[int, int]]


@dataclass
class Transducer:
    """A deterministic rewriting of symbols: (state, symbol) -> (state, symbol)."""

    table: list[list[tuple[int, int]]]

    @classmethod
    def of(cls, states: int, step: Step, symbols: int = 10) -> Transducer:
        return cls([[step(q, s) for s in range(symbols)] for q in range(states)])

    def then(self, after: Transducer) -> Transducer:
        """The composition: what ``after`` makes of this one's output."""
        width = len(after.table)

        def step(q: int, symbol: int) -> tuple[int, int]:
            first, middle = self.table[q // width][symbol]
            second, out = after.table[q % width][middle]
            return first * width + second, out

        return Transducer.of(len(self.table) * width, step, len(self.table[0]))


def _negated(q: int, s: int) -> tuple[int, int]:
    """A negation weakens an insult, and lifts a threat, within REACH words."""
    if s == NEGATION:
        return REACH, s
    if s == END or not q:
        return 0, s
    return q - 1, {INSULT: WEAK_INSULT, THREAT: OTHER}.get(s, s)


def _reported(q: int, s: int) -> tuple[int, int]:
    """After a reporting verb the clause tells what someone else said."""
    if s in (REPORT, END):
        return int(s == REPORT), s
    return q, {INSULT: WEAK_INSULT, THREAT: OTHER}.get(s, s) if q else s


def _aimed(q: int, s: int) -> tuple[int, int]:
    """An insult up to REACH words after a target is aimed at it."""
    if s == TARGET:
        return REACH, s
    if s == END or not q:
        return 0, s
    return q - 1, AIMED_INSULT if s == INSULT else s


def _threatened(q: int, s: int) -> tuple[int, int]:
    """A threat counts once a target follows in its clause."""
    if s == END:
        return 0, s
    if q and s == TARGET:
        return 0, AIMED_THREAT
    return (1, OTHER) if s == THREAT else (q, s)


def grammar() -> Transducer:
    negated = Transducer.of(REACH + 1, _negated)
    reported, aimed = Transducer.of(2, _reported), Transducer.of(REACH + 1, _aimed)
    return negated.then(reported).then(aimed).then(Transducer.of(2, _threatened))


class Scorer:
    """Clause scores of whole texts under a lexicon of insults (words, and stems as ``stem*``)."""

    def __init__(self, lexicon: dict[str, float]):
        self.lexicon, self.grammar = lexicon, grammar()
        groups = ((THREATS, THREAT), (TARGETS, TARGET), (NEGATIONS, NEGATION), (REPORTS, REPORT))
        self.plain = {w: s for words, s in groups for w in words} | dict.fromkeys(".!?;\n", END)
        self.known: dict[str, float] = {}
        self.threats = frozenset(THREATS)

    def weight(self, word: str) -> float:
        """The insult weight of a word: its own, or its heaviest stem's."""
        found = self.known.get(word)
        if found is None:
            stems = [word, *(word[:n] + "*" for n in PREFIXES if n < len(word))]
            found = max(self.lexicon.get(s, 0.0) for s in stems)
            if len(self.known) > 500_000:
                self.known.clear()
            self.known[word] = found
        return found

    def features(self, text: str) -> tuple[float, float, float]:
        """Best clause, log of the sum over clauses, and that sum per root of the words."""
        tokens = TOKEN.findall(text.lower())
        distinct = set(tokens)
        insults = {w: x for w in distinct if (x := self.weight(w))}
        if not insults and distinct.isdisjoint(self.threats):
            return 0.0, 0.0, 0.0
        symbol = self.plain | dict.fromkeys(insults, INSULT)
        state, table = 0, self.grammar.table
        clause = best = total = 0.0
        for word in tokens:
            state, out = table[state][symbol.get(word, OTHER)]
            if out in FACTORS:
                clause += FACTORS[out] * insults.get(word, THREAT_WEIGHT)
            elif out == END:
                best, total, clause = max(best, clause), total + clause, 0.0
        best, total = max(best, clause), total + clause
        return best, float(np.log1p(total)), float(total / len(tokens) ** 0.5)


@dataclass
class Model:
    lexicon: dict[str, float]
    weights: np.ndarray  # constant, then one per feature

    def probability(self, features: Iterable[float]) -> float:
        z = float(self.weights[0] + self.weights[1:] @ np.array(list(features)))
        return 1.0 / (1.0 + float(np.exp(-np.clip(z, -30, 30))))


def _parts(text: str) -> set[str]:
    """Distinct words of a text and their stems."""
    words = {w for w in TOKEN.findall(text.lower()) if len(w) > 2}
    return words | {w[:n] + "*" for w in words for n in PREFIXES if n < len(w)}


def _part_counts(wanted):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[str] = Counter()
        chosen = wanted.value if wanted else None
        for batch in pieces(batches):
            for text in batch.column("text").to_pylist():
                parts = _parts(text or "")
                counts.update(parts if chosen is None else parts & chosen)
        yield pa.record_batch(
            [pa.array(counts.keys(), pa.string()), pa.array(counts.values(), pa.int64())], names=["part", "n"]
        )

    return run


def _counted(texts: DataFrame, wanted=None) -> DataFrame:
    parts = texts.select("text").mapInArrow(_part_counts(wanted), "part string, n bigint")
    return parts.groupBy("part").agg(F.sum("n").alias("n"))


def _features(broadcast):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(broadcast.value.lexicon)
        for batch in pieces(batches):
            rows = np.array([scorer.features(t or "") for t in batch.column("text").to_pylist()]).reshape(-1, 3)
            yield pa.record_batch([batch.column("toxic"), *map(pa.array, rows.T)], names=["toxic", "a", "b", "c"])

    return run


def _logistic(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Ridge-regularised logistic regression by Newton's method."""
    x = np.column_stack([np.ones(len(x)), x])
    w, ridge = np.zeros(x.shape[1]), np.diag([1e-3, *[1e-2] * (x.shape[1] - 1)])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge, x.T @ (y - p) - ridge @ w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def train(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Model:
    """Learn the lexicon and the calibration from the labelled rows outside the held-out fold.

    At most about ``sample_rows`` labelled documents are read, chosen by a hash of their id.
    A doc_id with several labels counts as toxic if one of them says so.
    """
    judged = (
        labels.filter("toxic IS NOT NULL AND doc_id IS NOT NULL")
        .filter(fold(parts=5) != 0)
        .groupBy("doc_id")
        .agg(F.max("toxic").cast("int").alias("toxic"))
    )
    rows = judged.count()
    bound = int((1 << 20) * min(1.0, sample_rows / max(rows, 1)))
    chosen = F.broadcast(judged.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < bound))
    texts = docs.select("doc_id", "text").join(chosen, "doc_id").repartition(16).persist()
    try:
        return _fitted(texts)
    finally:
        texts.unpersist()


def _fitted(texts: DataFrame) -> Model:
    sizes = {bool(r["t"]): r["n"] for r in texts.groupBy((F.col("toxic") > 0).alias("t")).agg(F.count("*").alias("n")).collect()}
    toxic, clean = sizes.get(True, 0), sizes.get(False, 0)
    if not toxic or not clean:
        share = (toxic + 0.5) / (toxic + clean + 1) if toxic or clean else 0.1
        return Model({}, np.array([np.log(share / (1 - share)), 0, 0, 0]))
    sc = texts.sparkSession.sparkContext
    often = _counted(texts.filter("toxic > 0")).filter(F.col("n") >= LEAST_ROWS)
    hits = {r["part"]: r["n"] for r in often.orderBy(F.desc("n"), "part").limit(CANDIDATES).collect()}
    wanted = sc.broadcast(frozenset(hits))
    misses = {r["part"]: r["n"] for r in _counted(texts.filter("toxic = 0"), wanted).collect()}
    ratio = {
        p: float(np.log((n + 0.5) / (toxic + 1)) - np.log((misses.get(p, 0) + 0.5) / (clean + 1)))
        for p, n in hits.items()
    }
    strong = sorted((p for p, x in ratio.items() if x >= LEAST_RATIO), key=lambda p: (-hits[p] * ratio[p], p))
    model = Model({p: ratio[p] for p in strong[:LEXICON]}, np.zeros(4))
    scored = texts.select("text", "toxic").mapInArrow(
        _features(sc.broadcast(model)), "toxic int, a double, b double, c double"
    )
    rows = np.array([(r["toxic"] > 0, r["a"], r["b"], r["c"]) for r in scored.collect()], float)
    model.weights = _logistic(rows[:, 1:], rows[:, 0])
    return model


def _score(broadcast):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = broadcast.value
        scorer = Scorer(model.lexicon)
        for batch in pieces(batches):
            found = [scorer.features(t or "") for t in batch.column("text").to_pylist()]
            yield pa.record_batch(
                [
                    batch.column("doc_id"),
                    pa.array([model.probability(f) for f in found], pa.float64()),
                    pa.array([f[0] for f in found], pa.float64()),
                ],
                names=["doc_id", "score", "clause_score"],
            )

    return run


def toxicity(docs: DataFrame, labels: DataFrame, model: Model | None = None) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): how toxic its whole text is.

    held_out      whether the row is in the fold that training leaves out
    score         0 to 1, the calibrated probability of the label
    predicted     1 if score >= 0.5, else 0
    clause_score  weight of the heaviest clause

    A score depends on the text alone; NULL and empty texts get the score of a text that
    matches nothing. Without labels, or with labels of one kind, all scores are equal.
    Repeated rows are scored each; a NULL doc_id is not in the fold. Other columns are
    ignored, whatever their names. An empty table gives an empty table.
    """
    fit = train(docs, labels) if model is None else model
    broadcast = docs.sparkSession.sparkContext.broadcast(fit)
    kind = dict(docs.dtypes)["doc_id"]
    scored = docs.select("doc_id", "text").mapInArrow(
        _score(broadcast), f"doc_id {kind}, score double, clause_score double"
    )
    return scored.select(
        "doc_id",
        F.coalesce(fold(parts=5) == 0, F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
        "clause_score",
    )
