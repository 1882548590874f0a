"""Toxicity by a weighted finite-state pattern grammar over clauses.

Tokens become symbols: insult (with a learned weight), threat verb, target, negation, report, clause end, other. Five small
transducers read the symbols: *insult* and *threat* mark matches, *target* marks a match up to ``NEAR`` tokens behind an addressed person,
*late target* an addressed person up to ``NEAR`` tokens behind a match (which then counts as targeted), *negation*
a match behind a negator, *reported speech* a match behind a reporting verb or inside quotation marks. ``compose`` builds
their product, one table of (state, symbol) -> (state, tags), that runs over a document's clauses; the state starts
anew in every clause, and a clause ends at its closing sign or with its line. A threat counts only next to a target; a clause's matches add up by
weight and tags, so a word counts by the pattern it stands in.

**Learning** uses labelled rows only, at most ``TRAIN_ROWS`` of them (a bounded sample by hash order):

* insult stems: words and word prefixes whose share among toxic documents is far above that among the others
  (``MIN_WEIGHT`` in log odds, ``MIN_DOCS`` toxic documents, the ``LEXICON`` strongest); a token weighs as its strongest stem;
* the weights of the patterns: logistic regression over a document's clause features. The features of one half of the sample
  use stems learned from the other half, so words that are rare by chance get no credit.

Labels, language, source and id are no inputs of a score. Defined results: a null or empty text has no clauses and scores
the regression's base rate; of labels that repeat an id the largest counts, null labels are ignored; with no labels of one kind the
score is the share of toxic labels (0 without labels); rows that repeat are scored alike; other columns of the input stay,
except ``score`` and ``clauses``, which are replaced; an empty table gives no rows.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass, field
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chatlake.llm.common import materialize, ship

TRAIN_ROWS = 20_000
LEXICON = 20_000
MIN_DOCS, MIN_WEIGHT = 8, 3.0
PREFIXES = range(3, 9)
CACHE = 400_000
RIDGE = 1.0

OTHER, INSULT, THREAT, TARGET, NEGATION, REPORT, QUOTE = range(7)
END = 16  # added to a symbol that ends its clause
T_INSULT, T_THREAT, T_TARGET, T_NEGATED, T_REPORTED, T_LATE = 1, 2, 4, 8, 16, 32
NEAR = 4  # tokens between a match and the person it addresses

#: Function words of the grammar in the corpus' languages (fixed values).
WORDS = {
    TARGET: "you your yours yourself u ya he she they them him her his their us everyone du dein deine deinen dich dir euch euer ihr ihn ihm sie uns "
            "tu toi ton ta tes vous votre vos lui elle eux leur tú ti te usted ustedes vos vosotros él ella ellos ellas",
    NEGATION: "not no never none nobody cannot can't won't don't doesn't didn't isn't aren't wasn't without nicht kein keine keinen nie niemals niemand ohne "
              "ne pas jamais non aucun sans nunca jamás ni nadie sin",
    REPORT: "said says say saying claimed claims called calls quoted quotes reported reports wrote writes told sagte sagt sagen schrieb schreibt nannte "
            "nennt zitierte behauptete dit disait écrit écrivait appelé appelle cité dijo dice decía escribió escribe llamó llama citó",
    THREAT: "kill kills killing hurt hurts hurting shoot shoots stab stabs beat beats beating destroy destroys murder murders strangle strangles burn burns "
            "punch smash crush attack töten tötet umbringen umbringt schlagen schlägt verprügeln erschießen erstechen vernichten zerstören "
            "tuer tue tuerai frapper frappe égorger détruire brûler écraser attaquer matar mato mataré golpear golpeo degollar destruir quemar aplastar atacar",
}
_FUNCTION = {w: s for s, words in WORDS.items() for w in words.split()}
_WORD = re.compile(r"[^\W\d_]+(?:'[^\W\d_]+)?")
_CLAUSE_END = re.compile(r"[.!?;:]['\")\]]*$")
_QUOTES = "\"“”«»„"


@dataclass(frozen=True)
class Transducer:
    """States 0..states-1 (0 starts a clause); ``step(state, symbol)`` gives the next state and the tags it emits."""

    states: int
    step: object


def _marker(symbol: int, tag: int) -> Transducer:
    return Transducer(1, lambda s, x: (0, tag if x == symbol else 0))


def _window(opener: int, length: int, tag: int) -> Transducer:
    """Tags what stands at most ``length`` tokens behind ``opener``; state: tokens left."""
    def step(s, x):
        if x == opener:
            return length, 0
        return max(0, s - 1), tag if s else 0
    return Transducer(length + 1, step)


def _late(length: int) -> Transducer:
    """Tags a target at most ``length`` tokens behind a match; state: tokens left."""
    def step(s, x):
        if x in (INSULT, THREAT):
            return length, 0
        return max(0, s - 1), T_LATE if s and x == TARGET else 0
    return Transducer(length + 1, step)


def _reported() -> Transducer:
    """State 1: behind a reporting verb, to the clause's end; 2: inside quotation marks."""
    def step(s, x):
        if x == QUOTE:
            return (0 if s == 2 else 2), 0
        return (max(s, 1) if x == REPORT else s), T_REPORTED if s else 0
    return Transducer(3, step)


def compose(*parts: Transducer) -> tuple[np.ndarray, np.ndarray]:
    """The product of the transducers: next state and tags by state * 7 + symbol."""
    states = list(product(*(range(p.states) for p in parts)))
    number = {s: i for i, s in enumerate(states)}
    nxt, tags = np.zeros(len(states) * 7, np.int32), np.zeros(len(states) * 7, np.int32)
    for (i, state), symbol in product(enumerate(states), range(7)):
        moved = [p.step(s, symbol) for p, s in zip(parts, state)]
        nxt[i * 7 + symbol] = number[tuple(s for s, _ in moved)]
        tags[i * 7 + symbol] = sum(t for _, t in moved)
    return nxt, tags


_NEXT, _TAGS = (x.tolist() for x in compose(_marker(INSULT, T_INSULT), _marker(THREAT, T_THREAT), _window(TARGET, NEAR, T_TARGET),
                                            _late(NEAR), _window(NEGATION, 3, T_NEGATED), _reported()))
FEATURES = ("best clause", "matches", "stems", "plain", "targeted", "negated", "reported", "threats", "share")


def stems(word: str) -> set[str]:
    """The word and its prefixes (marked by a star)."""
    return {word, *(word[:k] + "*" for k in PREFIXES if len(word) > k)}


class Symbols(dict):
    """Raw token -> (symbol, weight, stem); remembered, emptied when full."""

    def __init__(self, lexicon: dict[str, float]):
        super().__init__()
        self.lexicon = lexicon

    def __missing__(self, raw: str) -> tuple[int, float, str | None]:
        if len(self) >= CACHE:
            self.clear()
        symbol, weight, stem = OTHER, 0.0, None
        for word in _WORD.findall(raw.lower()):
            w, s = max(((self.lexicon.get(s, 0.0), s) for s in stems(word)), default=(0.0, None))
            if w > weight:
                symbol, weight, stem = INSULT, w, s
            elif symbol == OTHER:
                symbol = _FUNCTION.get(word, OTHER)
        if symbol == OTHER and any(q in raw for q in _QUOTES):
            symbol = QUOTE
        self[raw] = out = (symbol + (END if _CLAUSE_END.search(raw) else 0), weight, stem)
        return out


@dataclass
class Model:
    """What scoring needs: stems with weights, and the regression over clause features."""

    lexicon: dict[str, float] = field(default_factory=dict)
    coefficients: np.ndarray = field(default_factory=lambda: np.zeros(len(FEATURES) + 1))

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.coefficients[0] + x @ self.coefficients[1:], -30, 30)))


def clauses(text: str | None, symbols: Symbols) -> tuple[list[tuple[int, float, dict[int, float]]], int, set, int]:
    """Matched clauses (number, score, weight by tags), matches, stems and tokens of a text."""
    lines = [[symbols[t] for t in line.split()] for line in (text or "").splitlines()]
    total = sum(map(len, lines))
    if not any(s & 15 in (INSULT, THREAT) for line in lines for s, _, _ in line):
        return [], 0, set(), total
    out, number, matches, found = [], 0, 0, set()
    for line in lines:
        last = len(line) - 1
        state, tags, waiting = 0, {}, []  # waiting: matches that may still meet their target
        for i, (symbol, weight, stem) in enumerate(line):
            at = state * 7 + (symbol & 15)
            tag, state = _TAGS[at], _NEXT[at]
            if tag & (T_INSULT | T_THREAT):
                if tag & T_THREAT:
                    weight = MIN_WEIGHT
                if tag & (T_INSULT | T_TARGET):
                    tags[tag] = tags.get(tag, 0.0) + weight
                    matches += 1
                    found.add(stem)
                if not tag & T_TARGET:
                    waiting.append((i, tag, weight, stem))
            elif tag & T_LATE:
                for place, old, weight, stem in waiting:
                    if i - place > NEAR:
                        continue
                    if old & T_INSULT:
                        tags[old] -= weight
                    else:
                        matches += 1
                        found.add(stem)
                    tags[old | T_TARGET] = tags.get(old | T_TARGET, 0.0) + weight
                waiting = []
            if symbol & END or i == last:
                if tags:
                    out.append((number, _clause_score(tags), tags))
                state, tags, waiting, number = 0, {}, [], number + 1
    return out, matches, found, total


def _clause_score(tags: dict[int, float]) -> float:
    """Weights of a clause's matches, more where a person is addressed, less where negated or reported."""
    return sum(w * (1.3 if t & T_TARGET else 1) * (0.4 if t & T_NEGATED else 1) * (0.6 if t & T_REPORTED else 1) for t, w in tags.items())


def features(found: tuple) -> list[float]:
    rows, matches, stems_, tokens = found
    by = Counter()
    for _, _, tags in rows:
        for t, w in tags.items():
            kind = "reported" if t & T_REPORTED else "negated" if t & T_NEGATED else "threats" if t & T_THREAT else "targeted" if t & T_TARGET else "plain"
            by[kind] += w
    scores = [s for _, s, _ in rows]
    return [max(scores, default=0.0), np.log1p(matches), np.log1p(len(stems_)),
            *(np.log1p(by[k]) for k in ("plain", "targeted", "negated", "reported", "threats")), np.sqrt(matches / max(1, tokens))]


def stem_counts(rows: DataFrame) -> DataFrame:
    """(stem, half, toxic, docs): documents of the sample (text, toxic, half) that hold the stem."""
    def run(batches):
        counts: Counter = Counter()

        def flush():
            keys = list(counts)
            batch = pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys]), pa.array([k[1] for k in keys], pa.int32()),
                                                pa.array([counts[k] for k in keys], pa.int64())], names=["stem", "kind", "n"])
            counts.clear()
            return batch
        for batch in batches:
            for text, toxic, half in zip(*(batch.column(k).to_pylist() for k in range(3))):
                words = set(_WORD.findall((text or "").lower()))
                kind = half * 2 + toxic
                counts.update((s, kind) for s in set().union(*map(stems, words)))
                if len(counts) > CACHE:
                    yield flush()
        if counts:
            yield flush()

    return ship(rows).select("text", "toxic", "half").mapInArrow(run, "stem string, kind int, n long").groupBy("stem").agg(
        *(F.sum(F.when(F.col("kind") == k, F.col("n")).otherwise(0)).alias(f"n{k}") for k in range(4)))


def _lexicon(counts, toxic_docs: int, clean_docs: int) -> dict[str, float]:
    """Stems with their weights; a prefix stays only if it covers clearly more toxic documents than any longer stem below it."""
    counts, longer, out = list(counts), Counter(), {}
    for stem, toxic, _ in counts:
        for k in PREFIXES:
            if k < len(stem.rstrip("*")):
                longer[stem[:k] + "*"] = max(longer[stem[:k] + "*"], toxic)
    for stem, toxic, clean in counts:
        if stem.endswith("*") and toxic < 1.25 * longer[stem]:
            continue
        weight = np.log((toxic + 0.5) / (toxic_docs + 1)) - np.log((clean + 0.5) / (clean_docs + 1))
        if toxic >= MIN_DOCS and weight >= MIN_WEIGHT:
            out[stem] = float(weight)
    return dict(sorted(out.items(), key=lambda x: (-x[1], x[0]))[:LEXICON])


def _regression(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Logistic regression with a small ridge, by Newton's method."""
    x = np.column_stack([np.ones(len(x)), x])
    w = np.zeros(x.shape[1])
    ridge = np.full(x.shape[1], RIDGE)
    ridge[0] = 1e-3
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(ridge), x.T @ (y - p) - ridge * w)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    return w


def train(docs: DataFrame, labels: DataFrame, may_learn: Column, id_col: str = "doc_id", text_col: str = "text",
          label_col: str = "toxic", rows: int = TRAIN_ROWS) -> Model:
    """Learn from at most ``rows`` labelled documents; ``may_learn`` is a condition on the column ``id``."""
    known = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("toxic")).where("id is not null and toxic is not null")
    known = known.where(may_learn).groupBy("id").agg(F.max("toxic").alias("toxic"))
    known = known.orderBy(F.xxhash64("id"), "id").limit(rows)  # a bounded sample: at most ``rows`` pairs of numbers
    known = materialize(known.withColumn("half", F.pmod(F.xxhash64("id", F.lit(1)), F.lit(2)).cast("int")), "tox-labels")
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(known), "id")
    sample = materialize(texts.select("text", F.when(F.col("toxic") > 0, 1).otherwise(0).alias("toxic"), "half"), "tox-sample")
    size = {r["kind"]: r["n"] for r in sample.groupBy((F.col("half") * 2 + F.col("toxic")).alias("kind")).agg(F.count(F.lit(1)).alias("n")).collect()}
    n = [size.get(k, 0) for k in range(4)]
    if not n[1] + n[3] or not n[0] + n[2]:
        base = (n[1] + n[3]) / max(1, sum(n))
        model = Model()
        model.coefficients[0] = np.log((base + 1e-9) / (1 - base + 1e-9))
        return model
    counts = stem_counts(sample).where(f"n1 + n3 >= {MIN_DOCS} and n1 + n3 > n0 + n2")
    counts = counts.orderBy(((F.col("n1") + F.col("n3") + 0.5) / (F.col("n0") + F.col("n2") + 0.5)).desc(), "stem").limit(4 * LEXICON).collect()
    whole = _lexicon(((r["stem"], r["n1"] + r["n3"], r["n0"] + r["n2"]) for r in counts), n[1] + n[3], n[0] + n[2])
    halves = [_lexicon(((r["stem"], 2 * r[f"n{3 - 2 * h}"], 2 * r[f"n{2 - 2 * h}"]) for r in counts), n[1] + n[3], n[0] + n[2]) for h in (0, 1)]

    def run(batches):
        symbols = [Symbols(x) for x in halves]
        for batch in batches:
            x = [features(clauses(t, symbols[h])) for t, h in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(x, pa.list_(pa.float64()))], names=["toxic", "x"])

    seen = ship(sample).select("text", "toxic", "half").mapInArrow(run, "toxic int, x array<double>").collect()  # at most ``rows``
    order = sorted((r["toxic"], r["x"]) for r in seen)
    return Model(whole, _regression(np.array([r[1] for r in order]), np.array([r[0] for r in order], float)))


def score(docs: DataFrame, model: Model, text_col: str = "text", keep_text: bool = False) -> DataFrame:
    """``docs`` (without the text unless ``keep_text``) with ``score`` (0..1) and ``clauses``, the matched ones (number, score)."""
    keep = [f for f in docs.schema.fields if f.name not in ("score", "clauses") and (keep_text or f.name != text_col)]
    clause = T.StructType([T.StructField("number", T.IntegerType()), T.StructField("score", T.DoubleType())])
    schema = T.StructType([*keep, T.StructField("score", T.DoubleType()), T.StructField("clauses", T.ArrayType(clause))])
    names, arrow = schema.names, pa.list_(pa.struct([("number", pa.int32()), ("score", pa.float64())]))

    def run(batches):
        symbols = Symbols(model.lexicon)
        for batch in batches:
            for low in range(0, batch.num_rows, 512):
                part = batch.slice(low, 512)
                found = [clauses(t.as_py(), symbols) for t in part.column(text_col)]
                cols = {"score": pa.array(model.score(np.array([features(f) for f in found]))),
                        "clauses": pa.array([[{"number": n, "score": s} for n, s, _ in f[0]] for f in found], arrow)}
                yield pa.RecordBatch.from_arrays([cols[n] if n in cols else part.column(n) for n in names], names=names)

    return ship(docs).mapInArrow(run, schema)
