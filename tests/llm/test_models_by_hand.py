"""The trained operators against plain versions without arrays, tables or Spark."""

import collections
import math
import random
import zlib

import pytest

from refracta.llm import language_id, toxicity
from refracta.llm.toxicity import END, INSULT, NEGATION, OTHER, REPORT, TARGET, THREAT

# --- 6: language identification --------------------------------------------------------

WORDS = {
    "en": "the of and house water with night letter think where every".split(),
    "de": "der und das haus wasser mit nacht brief denken wohin jeder".split(),
    "es": "el de y casa agua con noche carta pensar adonde cada".split(),
    "fr": "le et la maison eau avec nuit lettre penser quand chaque".split(),
}


def _plain_grams(text):
    """Hashed 3-grams of letters, one at a time."""
    raw = text.lower().encode("utf-8", "replace")
    kept = bytes(b if b >= 0x80 or 0x61 <= b <= 0x7A else 0x20 for b in raw)
    codes = b" ".join([b"", *kept.split(), b""])
    found = collections.Counter()
    for a, b, c in zip(codes, codes[1:], codes[2:]):
        x = (a * 0x9E3779B1 + b * 0x85EBCA77 + c * 0xC2B2AE3D) % 2**32
        x = (x ^ (x >> 15)) * 0x2C1B3C6D % 2**32
        found[x >> 19] += 1
    return found


def _plain_languages(rows):
    """doc_id -> (language, score): every split of the languages is a bit with its own classifier."""
    names = sorted({lang for key, _t, lang in rows if lang and zlib.crc32(str(key).encode()) % 3 != 1})
    total = {name: collections.Counter() for name in names}
    for key, text, lang in rows:
        if lang and text is not None and zlib.crc32(str(key).encode()) % 3 != 1:
            total[lang] += _plain_grams(text)
    size = language_id.BUCKETS
    share = {
        name: [(total[name][g] + 0.5) / (sum(total[name].values()) + 0.5 * size) for g in range(size)] for name in names
    }
    bits = []
    for split in range(1, 1 << (len(names) - 1)):
        word = {name: 1 if (split >> k) & 1 else -1 for k, name in enumerate(names)}
        ones, zeros = ([n for n in names if word[n] == s] for s in (1, -1))
        one = [sum(share[n][g] for n in ones) / len(ones) for g in range(size)]
        zero = [sum(share[n][g] for n in zeros) / len(zeros) for g in range(size)]
        ratio = [math.log(x / y) for x, y in zip(one, zero)]
        up, down = sum(x * r for x, r in zip(one, ratio)), sum(x * r for x, r in zip(zero, ratio))
        bits.append((word, ratio, (up + down) / 2, max((up - down) / 2, 1e-6)))
    gaps = sum(gap for *_x, gap in bits)
    found = {}
    for key, text, _lang in rows:
        if not text or not any(map(str.isalpha, text)):
            found[key] = ("und", 0.0)
            continue
        grams = _plain_grams(text)
        n = sum(grams.values())
        loss = dict.fromkeys(names, 0.0)
        for word, ratio, middle, gap in bits:
            margin = sum(k * (ratio[g] - middle) for g, k in grams.items()) / max(n, 1) / gap
            for name in names:
                loss[name] += gap / gaps * math.log1p(math.exp(-4 * min(1, (n / 100) ** 0.5) * word[name] * margin))
        best = min(names, key=lambda name: loss[name])
        found[key] = (best, 1 / sum(math.exp(-4 * (loss[name] - loss[best])) for name in names))
    return found


def test_languages_match_a_plain_version(spark):
    rng = random.Random(6)
    rows = []
    for key in range(160):
        lang = rng.choice(list(WORDS))
        mix = WORDS[lang] + (WORDS[rng.choice(list(WORDS))] if key % 5 == 0 else [])
        text = " ".join(rng.choice(mix).capitalize() for _ in range(rng.choice([1, 3, 10, 60]))) + f", {key}."
        rows.append((key, text, None if key % 13 == 0 else lang))
    rows += [(900, "", "de"), (901, None, "de"), (902, "12 !", "en"), (903, "ÄÖÜ ß", None), (904, "a", "fr")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r["doc_id"]: r for r in language_id.languages(docs).collect()}
    want = _plain_languages(rows)
    assert set(got) == set(want)
    for key, (lang, score) in want.items():
        assert got[key]["score"] == pytest.approx(score, abs=1e-3), key
        assert got[key]["lang_pred"] == lang or got[key]["ambiguous"], key


# --- 8: toxicity -----------------------------------------------------------------------


def _plain_rewriting(symbols):
    """What becomes of the symbols, rule by rule over the whole text instead of by one table."""

    def near(at, kind, reach):
        """A symbol of this kind stands up to ``reach`` places before, in the same clause."""
        for back in range(1, reach + 1):
            if at - back < 0 or symbols[at - back] == END:
                return False
            if symbols[at - back] == kind:
                return True
        return False

    def clause(at):
        start = at
        while start > 0 and symbols[start - 1] != END:
            start -= 1
        return symbols[start:at]

    out = []
    for at, s in enumerate(symbols):
        covered = near(at, NEGATION, toxicity.REACH) or REPORT in clause(at)
        if s == INSULT and covered:
            s = toxicity.WEAK_INSULT
        elif s == INSULT and near(at, TARGET, toxicity.REACH):
            s = toxicity.AIMED_INSULT
        elif s == THREAT and covered:
            s = OTHER
        out.append(s)
    waiting = False
    for at, s in enumerate(out):
        if s == END:
            waiting = False
        elif s == THREAT:
            waiting, out[at] = True, OTHER
        elif s == TARGET and waiting:
            waiting, out[at] = False, toxicity.AIMED_THREAT
    return out


def _run(transducer, symbols):
    state, out = 0, []
    for s in symbols:
        state, made = transducer.table[state][s]
        out.append(made)
    return out


def test_composition_equals_its_parts_and_the_rules():
    steps = ((toxicity.REACH + 1, toxicity._negated), (2, toxicity._reported), (toxicity.REACH + 1, toxicity._aimed), (2, toxicity._threatened))
    parts = [toxicity.Transducer.of(n, step) for n, step in steps]
    whole, rng = toxicity.grammar(), random.Random(8)
    for _ in range(3000):
        symbols = rng.choices(range(7), weights=[3, 2, 2, 2, 1, 1, 1], k=rng.randrange(25))
        in_turn = symbols
        for part in parts:
            in_turn = _run(part, in_turn)
        assert _run(whole, symbols) == in_turn == _plain_rewriting(symbols), symbols


def test_features_match_a_plain_clause_scorer():
    lexicon = {"idiot": 3.0, "trott*": 2.5, "trottel": 4.0, "pig": 1.5}
    plain = {**dict.fromkeys(("kill", "töten"), THREAT), **dict.fromkeys(("you", "dich"), TARGET), "not": NEGATION, "said": REPORT}
    weight = {"idiot": 3.0, "trotteln": 2.5, "trottel": 4.0, "pig": 1.5}
    scorer, rng = toxicity.Scorer(lexicon), random.Random(9)
    for _ in range(500):
        words = rng.choices([*plain, *weight, "tree", "goes", ".", "!", "\n"], k=rng.randrange(1, 40))
        made = _plain_rewriting([plain.get(w, INSULT if w in weight else END if w in ".!\n" else OTHER) for w in words])
        clauses = [0.0]
        for word, s in zip(words, made):
            if s == END:
                clauses.append(0.0)
            elif s in toxicity.FACTORS:
                clauses[-1] += toxicity.FACTORS[s] * weight.get(word, toxicity.THREAT_WEIGHT)
        want = (max(clauses), math.log1p(sum(clauses)), sum(clauses) / math.sqrt(len(words)))
        assert scorer.features(" ".join(words).upper()) == pytest.approx(want)


def test_scores_follow_the_features_of_whole_texts(spark):
    rng = random.Random(3)
    common = "tree goes you the river said not stone".split()
    rows, labels = [], []
    for key in range(300):
        bad = key % 3 == 0
        words = rng.choices(common, k=rng.choice([5, 40])) + (["grobwort", "you", "grobwort"] if bad else [])
        rows.append((key, " ".join(words)))
        labels.append((key, int(bad)))
    rows.append((1000, "tree " * 30_000 + "you grobwort"))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    marks = spark.createDataFrame(labels, "doc_id long, toxic int")
    model = toxicity.train(docs, marks)
    scorer = toxicity.Scorer(model.lexicon)
    assert set(model.lexicon) >= {"grobwort", "grobw*"} and not set(model.lexicon) & set(common)
    got = {r["doc_id"]: r for r in toxicity.toxicity(docs, marks, model).collect()}
    for key, text in rows:
        z = model.weights[0] + sum(w * x for w, x in zip(model.weights[1:], scorer.features(text)))
        assert got[key]["score"] == pytest.approx(1 / (1 + math.exp(-max(-30, min(30, z)))))
        assert got[key]["predicted"] == int(got[key]["score"] >= 0.5)
    assert got[1000]["clause_score"] > 0
    assert {k for k, r in got.items() if r["predicted"] and k < 1000} == {k for k, bad in labels if bad}
