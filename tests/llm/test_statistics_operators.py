"""Quality trees, whitening and the divergence audit: contracts against plain versions, and their defined results."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from chatlake.llm import divergence, quality, whitening
from chatlake.llm import queries as Q
from chatlake.plans.check import duckdb_connection
from .test_contracts import LABELLED, SF

NAN, INF = float("nan"), float("inf")


# ---- quality -------------------------------------------------------------------------------------------------------------------

def test_op11_held_out_accuracy(spark):
    rows = Q.op11_quality_trees(spark, LABELLED).collect()
    labels = dict(duckdb_connection(LABELLED).execute("SELECT doc_id, quality FROM labels").fetchall())
    assert len({r.doc_id for r in rows}) == len(rows) == 1000
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows)
    seen = [(r.predicted, labels[r.doc_id]) for r in rows if r.held_out and r.doc_id in labels]
    assert sum(p == y for p, y in seen) / len(seen) > 0.95
    assert sum(not p for p, y in seen if not y) / sum(not y for _, y in seen) > 0.85


def test_held_out_labels_are_not_learned(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{SF}/labels.parquet").select("doc_id", "quality")
    may = ~Q.quality_held_out(F.col("id"))
    turned = labels.withColumn("quality", F.when(Q.quality_held_out(F.col("doc_id")), 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = (quality.train(docs, x, may) for x in (labels, turned))
    assert all(np.array_equal(getattr(a, k), getattr(b, k)) for k in ("base", "feature", "threshold", "value"))


def test_trees_learn_and_flat_walk_equals_a_walk_node_by_node():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(1500, 4))
    x[:, 3] = 1.0  # a statistic without any cut
    y = ((x[:, 0] > 0.3) ^ (x[:, 1] > -0.2)).astype(float)
    model = quality.fit(x, y, trees=30, depth=3)
    assert ((model.score(x) >= 0.5) == y).mean() > 0.97
    for row in x[:200]:
        total = model.base
        for feature, threshold, value in zip(model.feature, model.threshold, model.value):
            node = 0
            while node < len(feature):
                node = 2 * node + (2 if row[feature[node]] > threshold[node] else 1)
            total += value[node - len(feature)]
        assert model.score(row[None])[0] == pytest.approx(1 / (1 + np.exp(-total)), rel=1e-12)
    order = rng.permutation(len(x))
    assert np.allclose(quality.fit(x[order], y[order], trees=30, depth=3).score(x), model.score(x))


def test_statistics_are_those_of_plain_python(monkeypatch):
    rnd = random.Random(5)
    text = "".join(rnd.choice(["the ", "The ", "été\n", "a|b ", "12 ", "x" * 25 + " ", "wow!\n", "\n\n", "\t"]) for _ in range(3000))
    words, lines = text.split(), [x for x in text.split("\n") if x.strip()]
    pairs = Counter(zip(words, words[1:]))
    n = len(words)
    want = {"words": np.log1p(n), "word length": sum(len(w.encode()) for w in words) / n, "distinct words": len(set(words)) / n,
            "commonest word": max(Counter(words).values()) / n, "equal neighbours": sum(a == b for a, b in zip(words, words[1:])) / (n - 1),
            "distinct pairs": len(pairs) / (n - 1), "commonest pair": max(pairs.values()) / (n - 1), "bars": text.count("|") / n,
            "long words": sum(len(w) > 20 for w in words) / n, "exclamations": text.count("!") / n, "no letter": sum(w == "12" for w in words) / n,
            "capitalised": sum(w[0] == "T" for w in words) / n, "lines": np.log1p(len(lines)), "words a line": n / len(lines),
            "distinct lines": len(set(lines)) / len(lines), "longest line": np.log1p(max(len(x.split()) for x in lines))}
    whole = quality.statistics(text)
    assert {k: v for k, v in zip(quality.FEATURES, whole) if k in want} == pytest.approx(want)
    monkeypatch.setattr(quality, "SLICE", 100)
    assert quality.statistics(text) == pytest.approx(whole)  # slices change nothing
    monkeypatch.setattr(quality, "SLICE", 7)
    assert len(quality.statistics("y" * 1000)) == len(quality.FEATURES)  # no white space at all
    assert quality.statistics(None) == quality.statistics("") == quality.statistics(" \n\t") == [0.0] * len(quality.FEATURES)


def test_quality_edges(spark):
    rows = [(1, None, "mine"), (2, "", "mine"), (3, "a b c", "mine"), (3, "a b c", "mine"), (None, "x", None), (4, "long " * 50_000, "mine")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score string").withColumn("x", F.lit(1))
    one_kind = spark.createDataFrame([(1, 1), (2, None), (None, 0), (3, 1)], "doc_id long, quality int")
    model = quality.train(docs, one_kind, F.lit(True))
    out = quality.score(docs, model)
    assert out.columns == ["doc_id", "x", "score"] and out.count() == 6
    assert all(r.score > 0.999 for r in out.collect())
    assert {r.score for r in quality.score(docs, quality.train(docs, one_kind.where("false"), F.lit(True))).collect()} == {0.5}
    both = spark.createDataFrame([(1, 1), (3, 0), (3, 1), (4, 0)], "doc_id long, quality int")
    assert all(0 <= r.score <= 1 for r in quality.score(docs, quality.train(docs, both, F.lit(True))).collect())
    empty = docs.where("false")
    assert quality.score(empty, quality.train(empty, both, F.lit(True))).count() == 0
    assert quality.score(docs, model, keep_text=True).columns == ["doc_id", "text", "x", "score"]


# ---- whitening -----------------------------------------------------------------------------------------------------------------

def plain_whitening(vectors, count=8):
    dim = max(map(len, vectors))
    x = np.array([[int(np.floor(1024 * c)) + 100000 for c in [*v, *[0.0] * (dim - len(v))]] for v in vectors])
    mean = x.mean(0)
    values, turn = np.linalg.eigh((x - mean).T @ (x - mean) / len(x))
    values, turn = values[::-1][:count], turn[:, ::-1][:, :count]
    total = ((x - mean) ** 2).sum() / len(x)
    sums = x.sum(0)
    deviation = [sum((len(x) * int(c) - int(s)) ** 2 for c, s in zip(row, sums)) for row in x]
    return (x - mean) @ turn, values, values / total, deviation


def check_whitening(rows, ids, vectors, count=8):
    projected, values, explained, deviation = plain_whitening(vectors, count)
    got = {(r.vec_id, r.component): r for r in rows}
    assert len(got) == len(rows) == len(ids) * len(values)
    for k in range(len(values)):
        mine = np.array([got[i, k + 1].whitened for i in ids]) * np.sqrt(values[k])
        sign = np.sign((mine * projected[:, k]).sum())
        assert np.allclose(sign * mine, projected[:, k], atol=1e-6 * np.sqrt(values[0]))
        assert got[ids[0], k + 1].explained == pytest.approx(explained[k], rel=1e-9)
    assert [got[i, 1].deviation for i in ids] == deviation
    assert {r.n for r in rows} == {len(ids)} and {r.identity_error < 1e-4 for r in rows} == {True} and len({r.identity_error for r in rows}) == 1


def test_op12_equals_plain_eigenvectors(spark):
    known = dict(duckdb_connection(SF).execute("SELECT vec_id, embedding FROM embeddings").fetchall())
    rows = Q.op12_lanczos_whitening(spark, SF).collect()
    check_whitening(rows, sorted(known), [known[i] for i in sorted(known)])
    w = np.zeros((len(known), 8))
    for r in rows:
        w[sorted(known).index(r.vec_id), r.component - 1] = r.whitened
    assert abs(np.cov(w.T, bias=True) - np.eye(8)).max() == pytest.approx(rows[0].identity_error, abs=1e-9)


def test_whitening_edges(spark):
    make = lambda rows: spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumns({"n": F.lit("mine"), "x": F.lit(0)})
    rng = np.random.default_rng(8)
    good = [(i, [float(c) for c in rng.normal(size=5)]) for i in range(40)] + [(40, [1.0, 2.0]), (41, [])]
    bad = [(50, None), (51, [1.0, None, 2.0]), (52, [NAN, 1.0]), (53, [INF, 0.0, 0.0]), (54, [-INF])]
    rows = whitening.whiten(make(good + bad)).collect()
    stored = [np.float32(v).astype(float).tolist() for _, v in good]
    check_whitening(rows, [i for i, _ in good], stored, count=5)
    twice = whitening.whiten(make(good + good + [(None, [0.5] * 5)])).collect()
    assert len(twice) == 5 * 85 and sum(r.vec_id is None for r in twice) == 5
    assert whitening.whiten(make([])).count() == 0
    assert whitening.whiten(make(bad)).count() == 0
    assert whitening.whiten(make([(1, [1.0, 2.0])])).count() == 0  # no variance
    assert whitening.whiten(make([(k, [3.0, 3.0]) for k in range(9)])).count() == 0
    line = whitening.whiten(make([(k, [float(k), 2.0 * k, 0.0]) for k in range(9)])).collect()  # rank 1
    assert {r.component for r in line} == {1} and line[0].explained == pytest.approx(1)


def test_whitening_finds_equal_components_and_stops_early(spark):
    """All corners of a cross: every direction has the same variance; then a table with few strong directions."""
    cross = [(2 * k + s, [4.0 * (2 * s - 1) * (j == k) for j in range(12)]) for k in range(12) for s in (0, 1)]
    rows = whitening.whiten(spark.createDataFrame(cross, "vec_id long, embedding array<double>"), count=8).collect()
    assert {r.component for r in rows} == set(range(1, 9)) and all(r.explained == pytest.approx(1 / 12) for r in rows)
    assert rows[0].identity_error < 1e-9
    rng = np.random.default_rng(2)
    x = rng.normal(size=(400, 30)) * np.array([50, 40, 30, *[0.01] * 27])
    packs, dim = whitening.pack(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>"),
                                "vec_id", "embedding", 1024, 0)
    model = whitening.fit(packs, dim, 3)
    assert model.steps < 15
    whole = np.floor(1024 * x)
    values = np.linalg.eigvalsh(np.cov(whole.T, bias=True))[::-1]
    assert np.allclose(model.variances, values[:3], rtol=1e-12)


def test_whitening_is_exact_beyond_64_bits(spark):
    rows = [(k, [float(k) * 2 ** 30, 1.0]) for k in range(50)]
    out = {r.vec_id: r.deviation for r in whitening.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    x = [(k * 2 ** 40 + 100000, 1024 + 100000) for k in range(50)]
    sums = [sum(c) for c in zip(*x)]
    assert out == {k: sum((50 * c - s) ** 2 for c, s in zip(v, sums)) for k, v in enumerate(x)}


# ---- divergence ----------------------------------------------------------------------------------------------------------------

def plain_audit(rows, min_docs, top=10):
    docs = [tuple(x or "" for x in r) for r in rows]
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    words = [(a, b, [w.translate(low) for w in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", t)]) for a, b, t in docs]
    out = set()
    for lang in {a for a, _, _ in docs}:
        own = [(s, w) for a, s, w in words if a == lang]
        df, total, by = Counter(), Counter(), {s: Counter() for s, _ in own}
        for s, w in own:
            df.update(set(w))
            total.update(w)
            by[s].update(w)
        kept = [t for t in df if df[t] >= min_docs]

        def shares(c):
            whole = sum(c[t] for t in kept) + 2 * len(kept)
            return {t: 1 + 10 ** 9 * (c[t] + 2) // whole for t in kept}
        p = {s: shares(c) for s, c in by.items()}
        q = shares(total)
        f = lambda a, b: (a - b) ** 2 // (a + b)
        for s in by:
            pairs = [(sum(f(p[s][t], p[o][t]) for t in kept), o) for o in by if o != s]
            ranked = sorted(((f(p[s][t], q[t]), t) for t in kept if by[s][t] and p[s][t] > q[t]), key=lambda x: (-x[0], x[1].encode()))[:top]
            for part, items in (("pair", sorted(pairs, key=lambda x: (-x[0], x[1].encode()))), ("term", ranked)):
                out |= {(lang, s, part, item, v, k + 1) for k, (v, item) in enumerate(items)}
    return out


@pytest.fixture(scope="module")
def said():
    rnd = random.Random(4)
    words = ["Alpha", "alpha", "béta", "BÉTA", "straße", "İx", "日本語", "a1b", "don't", "x_y", "zz", *(f"w{chr(97 + k)}" for k in range(26))]
    rows = [(rnd.choice(["en", "de", None]), rnd.choice(["hot", "hot", "s1", "s2", "é", "z", None]),
             " ".join(rnd.choices(words, k=rnd.randrange(40)))) for _ in range(300)]
    return [*rows, ("en", "s1", None), ("fr", "only", "few words"), ("fr", "other", ""), ("xx", "lone", "one"), ("en", "empty", ""), rows[0], rows[0],
            ("de", "long", "béta " * 30_000)]


@pytest.mark.parametrize("segment, block", [(4096, 16), (5, 2)])
def test_audit_equals_plain_counts(spark, said, monkeypatch, segment, block):
    monkeypatch.setattr(divergence, "BLOCK", block)
    monkeypatch.setattr(divergence, "SEGMENT", segment)
    docs = spark.createDataFrame(said, "lang string, source string, text string").withColumns({k: F.lit("mine") for k in ("g", "term", "counts", "n")})
    rows = divergence.audit(docs, min_docs=3).collect()
    want = plain_audit(said, 3)
    assert {tuple(r) for r in rows} == want and len(rows) == len(want)
    assert ("fr", "only", "pair", "other", 0, 1) in want


def test_audit_of_nothing(spark, said):
    docs = spark.createDataFrame(said, "lang string, source string, text string")
    assert divergence.audit(docs.where("false")).count() == 0
    nothing_kept = divergence.audit(docs, min_docs=1000).collect()
    assert nothing_kept and all(r.part == "pair" and r.value == 0 for r in nothing_kept)


def test_shares_are_exact_for_large_counts():
    whole = 3 * 10 ** 13 + 7
    counts = np.array([0, 5, 10 ** 9, 2 * 10 ** 13, 3 * 10 ** 13])
    assert divergence.shares(counts, whole).tolist() == [1 + 10 ** 9 * (int(c) + 2) // whole for c in counts]


def test_run_length_pairs_equal_dense_pairs():
    rng = np.random.default_rng(1)
    for _ in range(50):
        n = int(rng.integers(1, 60))
        p, q = (np.repeat(rng.integers(1, 10 ** 9, n), rng.integers(1, 5, n))[:n] for _ in "ab")
        a, b = divergence.run_length(p), divergence.run_length(q)
        assert divergence.pair_sum(a, p[a], b, q[b], n) == int(divergence.difference(p, q).sum())
