"""Quality by histogram gradient-boosted trees over document statistics.

**Statistics** (``FEATURES``) come from a whole text's UTF-8 bytes by numpy: byte classes from one byte histogram, words as hashes
(repetition of words, neighbours and word pairs), lines. Texts are read ``SLICE`` bytes at a time, cut at white space, so only eight bytes a
word are held of a long text. Language, source, id and labels are no inputs.

**Learning** uses labelled rows only: at most ``TRAIN_ROWS`` labelled ids (a bounded sample by hash order) send their statistics, some
two dozen numbers each, to the driver. Each statistic is cut at its quantiles into at most ``BINS`` bins; every tree sums gradients
and curvatures of the logistic loss by (node, statistic, bin) and splits all nodes of a level at their best bin.

**Scoring** runs in the tasks: the trees are flat arrays in heap order (children of i at 2i + 1 and 2i + 2; a node that isn't split sends
everything left), and all rows of a batch walk down all trees at once, one numpy step a level.

Defined results: a null or empty text has statistics 0 and is scored like any other; of labels that repeat an id the largest counts, null
labels and ids are ignored; of rows that repeat a labelled id the smallest statistics train; with labels of one kind every score is their share (0.5 without
labels); other columns of the input stay, except ``score``, which is replaced; an empty table gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chatlake.llm.common import materialize, ship

TRAIN_ROWS = 20_000
TREES, DEPTH, BINS, RATE, RIDGE, LEAST = 80, 4, 64, 0.15, 1.0, 10
SLICE = 1 << 20

FEATURES = ("words", "word length", "distinct words", "commonest word", "equal neighbours", "distinct pairs", "commonest pair", "long words",
            "upper", "digits", "stops", "exclamations", "symbols", "bars", "spaces", "other bytes", "byte entropy", "capitalised",
            "no letter", "lines", "words a line", "distinct lines", "short lines", "longest line")


def _class(chars: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(chars)] = True
    return out


_SPACE = _class(b" \t\n\v\f\r")
_UPPER, _LOWER, _DIGIT = (_class(bytes(range(a, b + 1))) for a, b in ((65, 90), (97, 122), (48, 57)))
_HIGH = _class(bytes(range(128, 256)))
_LETTER = _UPPER | _LOWER | _HIGH
_POWERS = np.cumprod(np.full(256, 0x9E3779B97F4A7C15, np.uint64))  # odd, modulo 2**64


def _words(data: np.ndarray):
    """(hashes, lengths, first bytes, holds a letter) of the words of a byte array."""
    edges = np.diff(np.concatenate([[0], (~_SPACE[data]).view(np.int8), [0]]))
    starts, ends = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
    if not len(starts):
        return np.empty(0, np.uint64), starts, data[:0], starts.astype(bool)
    lengths = ends - starts
    inside = np.repeat(starts, lengths) + (place := np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths, lengths))
    first = np.cumsum(lengths) - lengths
    value = (data[inside].astype(np.uint64) + np.uint64(1)) * _POWERS[np.minimum(place, 255)]
    return np.add.reduceat(value, first), lengths, data[starts], np.logical_or.reduceat(_LETTER[data[inside]], first)


def _slices(data: np.ndarray):
    """Pieces of about ``SLICE`` bytes that end at white space."""
    low = 0
    while low < len(data):
        high = low + SLICE
        while high < len(data) and not _SPACE[data[high]]:
            high += 1
        yield data[low:high]
        low = high


def _repeats(values: np.ndarray) -> tuple[float, float]:
    """Shares of the distinct and of the commonest value."""
    counts = np.unique(values, return_counts=True)[1]
    return len(counts) / len(values), counts.max() / len(values)


def statistics(text: str | None) -> list[float]:
    raw = (text or "").encode()
    data = np.frombuffer(raw, np.uint8)
    parts = [_words(s) for s in _slices(data)]
    hashes, lengths, heads, letters = (np.concatenate(x) for x in zip(*parts)) if parts else _words(data)
    n = len(hashes)
    if not n:
        return [0.0] * len(FEATURES)
    h = np.bincount(data, minlength=256)
    share = h[h > 0] / len(data)
    pairs = hashes[1:] * np.uint64(0x2545F4914F6CDD1D) + hashes[:-1] if n > 1 else hashes
    lines = [line for line in raw.split(b"\n") if line.strip()]
    line_words = np.array([len(line.split()) for line in lines])
    symbols = h[list(b"#$%&*@~^<>{}[]\\/=+_")].sum()
    return [np.log1p(n), lengths.mean(), *_repeats(hashes), (hashes[1:] == hashes[:-1]).mean() if n > 1 else 0.0, *_repeats(pairs),
            (lengths > 20).mean(), h[_UPPER].sum() / max(1, h[_UPPER | _LOWER].sum()), h[_DIGIT].sum() / len(data), h[list(b".,;:")].sum() / n,
            h[list(b"!?")].sum() / n, symbols / n, h[ord("|")] / n, h[_SPACE].sum() / len(data), h[_HIGH].sum() / len(data),
            -(share * np.log2(share)).sum(), _UPPER[heads].mean(), 1 - letters.mean(), np.log1p(len(lines)), n / len(lines),
            len(set(lines)) / len(lines), (line_words < 3).mean(), np.log1p(line_words.max())]


@dataclass(frozen=True)
class Forest:
    """Perfect trees in heap order: inner nodes' statistic and threshold (trees x 2**depth - 1), leaves' values (trees x 2**depth)."""

    base: float
    feature: np.ndarray
    threshold: np.ndarray
    value: np.ndarray

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probabilities of label 1 of the rows of ``x``."""
        trees, inner = self.feature.shape
        tree, row = np.arange(trees)[None, :], np.arange(len(x))[:, None]
        node = np.zeros((len(x), trees), np.int64)
        for _ in range((inner + 1).bit_length() - 1):
            node = 2 * node + 1 + (x[row, self.feature[tree, node]] > self.threshold[tree, node])
        return _logistic(self.base + self.value[tree, node - inner].sum(1))


def _logistic(x):
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def constant(p: float) -> Forest:
    p = min(max(p, 1e-9), 1 - 1e-9)
    return Forest(float(np.log(p / (1 - p))), np.zeros((0, 1), int), np.zeros((0, 1)), np.zeros((0, 2)))


def fit(x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH, bins: int = BINS, rate: float = RATE) -> Forest:
    """Boosted trees over a table of statistics; the rows' order makes no difference beyond rounding."""
    if not len(y) or y.min() == y.max():
        return constant(float(y.mean()) if len(y) else 0.5)
    n, f = x.shape
    edges = [np.unique(np.quantile(x[:, k], np.linspace(0, 1, bins + 1)[1:-1])) for k in range(f)]
    codes = np.column_stack([np.searchsorted(e, x[:, k], "left") for k, e in enumerate(edges)])  # bin b: x <= edge b
    at = codes + np.arange(f) * bins
    splits = np.zeros((f, bins), bool)
    for k, e in enumerate(edges):
        splits[k, :len(e)] = True
    base = float(np.log(y.mean() / (1 - y.mean())))
    margin, inner = np.full(n, base), 2 ** depth - 1
    feature, threshold, value = np.zeros((trees, inner), int), np.full((trees, inner), np.inf), np.zeros((trees, inner + 1))
    for t in range(trees):
        p = _logistic(margin)
        g, h = p - y, p * (1 - p)
        node = np.zeros(n, np.int64)
        for level in range(depth):
            wide, first = 2 ** level, 2 ** level - 1
            place = ((node - first)[:, None] * (f * bins) + at).ravel()
            sums = [np.bincount(place, None if w is None else np.repeat(w, f), wide * f * bins).reshape(wide, f, bins).cumsum(2) for w in (g, h, None)]
            whole = [s[:, :, -1:] for s in sums]
            rest = [a - b for a, b in zip(whole, sums)]
            worth = lambda s: s[0] ** 2 / (s[1] + RIDGE)
            gain = worth(sums) + worth(rest) - worth(whole)
            gain[~(splits[None] & (sums[2] >= LEAST) & (rest[2] >= LEAST))] = -np.inf
            best = gain.reshape(wide, -1).argmax(1)
            good = gain.reshape(wide, -1)[np.arange(wide), best] > 1e-6
            where, cut = best // bins, best % bins
            for k in np.flatnonzero(good):
                feature[t, first + k], threshold[t, first + k] = where[k], edges[where[k]][cut[k]]
            node = 2 * node + 1 + (x[np.arange(n), feature[t, node]] > threshold[t, node])
        leaf = node - inner
        value[t] = -rate * np.bincount(leaf, g, inner + 1) / (np.bincount(leaf, h, inner + 1) + RIDGE)
        margin += value[t, leaf]
    return Forest(base, feature, threshold, value)


def document_statistics(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The columns of ``docs`` without the text, and ``x``, the statistics."""
    keep = [f for f in docs.schema.fields if f.name not in ("x", text_col)]
    schema = T.StructType([*keep, T.StructField("x", T.ArrayType(T.DoubleType()))])

    def run(batches):
        for batch in batches:
            x = pa.array([statistics(t.as_py()) for t in batch.column(text_col)], pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([*(batch.column(f.name) for f in keep), x], names=schema.names)

    return ship(docs).mapInArrow(run, schema)


def train(docs: DataFrame, labels: DataFrame, may_learn: Column, id_col: str = "doc_id", text_col: str = "text",
          label_col: str = "quality", rows: int = TRAIN_ROWS) -> Forest:
    """Learn from at most ``rows`` labelled ids; ``may_learn`` is a condition on the column ``id``."""
    known = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("y")).where("id is not null and y is not null")
    known = known.where(may_learn).groupBy("id").agg(F.max("y").alias("y"))
    known = materialize(known.orderBy(F.xxhash64("id", F.lit(11)), "id").limit(rows), "quality-labels")  # at most ``rows`` pairs of numbers
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(known), "id")
    seen = document_statistics(texts).groupBy("id").agg(F.min("y").alias("y"), F.min("x").alias("x")).collect()  # at most ``rows``
    seen = sorted((r["id"], r["y"], r["x"]) for r in seen)
    return fit(np.array([r[2] for r in seen], float).reshape(-1, len(FEATURES)), np.array([r[1] > 0 for r in seen], float))


def score(docs: DataFrame, model: Forest, text_col: str = "text", keep_text: bool = False) -> DataFrame:
    """``docs`` (without the text unless ``keep_text``) with ``score``, 0 to 1, higher for better texts."""
    keep = [f for f in docs.schema.fields if f.name != "score" and (keep_text or f.name != text_col)]
    schema = T.StructType([*keep, T.StructField("score", T.DoubleType())])

    def run(batches):
        for batch in batches:
            for low in range(0, batch.num_rows, 512):
                part = batch.slice(low, 512)
                x = np.array([statistics(t.as_py()) for t in part.column(text_col)])
                yield pa.RecordBatch.from_arrays([*(part.column(f.name) for f in keep), pa.array(model.score(x))], names=schema.names)

    return ship(docs).mapInArrow(run, schema)
