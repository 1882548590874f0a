"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns: each operator's defined results."""

import base64
import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from chatlake.llm import bpe, chat_format, exact_dedup, minhash, mixing, pii, suffix_dedup, topk, toxicity, warc
from chatlake.llm.components import components
from chatlake.llm.queries import bpe_path
from .test_contracts import brute_components

rnd = random.Random(11)
WORDS = [f"w{k}" for k in range(400)]
LONG = " ".join(rnd.choice(WORDS) for _ in range(30_000))
NEAR = " ".join(rnd.choice(WORDS) for _ in range(300))
ROWS = [(1, "en", None, "s1"), (2, "en", "", "s1"), (3, None, "one two", None), (4, "en", "One  two", "s1"), (4, "en", "One  two", "s1"),
        (None, "en", "one two", "s2"), (5, "en", LONG, "s2"), (6, "en", LONG + " end", None), (7, "en", NEAR, "s1"), (8, "en", NEAR + " x y", "s1"),
        (9, "en", "Hello \t\n world's  end ", "s2"), (10, "en", "ONE\ttwo", "s2")]
CLASH = ("kept", "size", "ids", "score", "spans", "positions", "__key", "component_id")


@pytest.fixture(scope="module")
def docs(spark):
    df = spark.createDataFrame(ROWS, "doc_id long, lang string, text string, source string")
    return df.withColumns({c: F.lit("mine") for c in CLASH}).cache()


@pytest.fixture(scope="module")
def empty(docs):
    return docs.where("false")


def test_exact_dedup(docs, empty):
    rows = [(r.doc_id, r.keep_id, r.group_size, r.kept) for r in exact_dedup.exact_dedup(docs.select("doc_id", "text", "size")).collect()]
    assert sorted(rows, key=str) == sorted([(1, 1, 2, True), (2, 1, 2, False), (3, 3, 2, True), (None, 3, 2, False), (4, 4, 2, True), (4, 4, 2, True),
                                            (5, 5, 1, True), (6, 6, 1, True), (7, 7, 1, True), (8, 8, 1, True), (9, 9, 1, True), (10, 10, 1, True)], key=str)
    assert exact_dedup.exact_dedup(docs).columns[:3] == ["doc_id", "lang", "text"]
    assert exact_dedup.exact_dedup(empty).count() == 0


def test_directory_doubles_until_buckets_fit(spark):
    texts = spark.range(3000).select("id", F.concat(F.lit("text "), "id").alias("text"))
    index = exact_dedup.build_index(texts, "id", "text", capacity=100)
    sizes = [r["count"] for r in index.entries.groupBy("bucket", "depth").count().collect()]
    assert sum(sizes) == 3000 and max(sizes) <= 100 and index.entries.agg(F.max("chain")).first()[0] == 1
    assert index.directory.count() <= 2 ** index.depth and index.directory.select("bucket").distinct().count() == len(sizes) > 30
    copies = exact_dedup.build_index(spark.range(3000).select("id", F.lit("same").alias("text")), "id", "text", capacity=100)
    assert copies.entries.collect()[0].group_size == 3000 and copies.depth == 0


def test_depth_follows_the_keys(spark):
    """Keys that agree in their first 20 bits: the directory doubles past them, and buckets of other keys stay shallow."""
    near = spark.range(64).select((F.lit(5).cast("long") * 2 ** 44 + F.col("id") * 2 ** 38).alias("key"))
    far = spark.range(8).select((F.col("id") * 2 ** 58 + 2 ** 62).alias("key"))
    cells, depth = exact_dedup.directory(near.unionAll(far).distinct(), capacity=8)
    assert depth >= 23
    rows = near.unionAll(far).distinct().withColumnRenamed("key", "__key")
    sizes = {(r["__bucket"], r["__local"]): r["count"] for r in exact_dedup.addressed(rows, cells, depth).groupBy("__bucket", "__local").count().collect()}
    assert sum(sizes.values()) == 72 and max(sizes.values()) <= 8 and min(d for _, d in sizes) <= 3


def test_collisions_are_chained_and_bytes_decide(spark):
    rows = [(k, f"text {k % 7}") for k in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    few = lambda norm: F.pmod(F.xxhash64(norm), F.lit(2)).cast("long")
    index = exact_dedup.build_index(docs, key=few)
    assert index.entries.count() == 7 and index.entries.agg(F.max("chain")).first()[0] >= 4
    got = {(r.doc_id, r.keep_id, r.group_size) for r in exact_dedup.annotate(docs, index, key=few).collect()}
    assert got == {(k, k % 7, len(range(k % 7, 40, 7))) for k in range(40)}


def test_lookup_goes_through_the_directory(spark):
    docs = spark.range(500).select(F.col("id").alias("doc_id"), F.concat(F.lit("t"), F.col("id") % 300).alias("text"))
    index = exact_dedup.build_index(docs, capacity=20)
    assert exact_dedup.annotate(docs, index).count() == 500
    broken = exact_dedup.Index(index.directory.withColumn("bucket", F.col("bucket") + 1), index.depth, index.entries)
    assert exact_dedup.annotate(docs, broken).count() < 500


def test_near_dedup(docs, empty):
    rows = {(r.doc_id, r.n_shingles, r.component_id, r.kept) for r in minhash.near_dedup(docs.select("doc_id", "text", "kept")).collect()}
    n5, n6 = (len(minhash.shingles(minhash.words_of(t))) for t in (LONG, LONG + " end"))
    n7, n8 = (len(minhash.shingles(minhash.words_of(t))) for t in (NEAR, NEAR + " x y"))
    assert rows == {(1, 0, 1, True), (2, 0, 2, True), (3, 1, 3, True), (4, 1, 3, False), (None, 0, None, False), (5, n5, 5, True), (6, n6, 5, False),
                    (7, n7, 7, True), (8, n8, 7, False), (9, 1, 9, True), (10, 1, 3, False)}
    assert minhash.near_dedup(empty.select("doc_id", "text")).count() == 0


def test_near_dedup_completes_chains(spark):
    """A chain of documents, each near the next only, is one component; strangers in shared buckets stay apart."""
    words = [f"t{k}" for k in range(2000)]
    chain = [(k, " ".join(words[20 * k:20 * k + 260])) for k in range(12)]
    passage = " ".join(words[1500:1540])
    apart = [(100 + k, passage + " " + " ".join(f"u{k}_{j}" for j in range(30))) for k in range(40)]
    rows = minhash.near_dedup(spark.createDataFrame(chain + apart, "doc_id long, text string")).collect()
    assert {r.component_id for r in rows if r.doc_id < 100} == {0}
    assert all(r.component_id == r.doc_id for r in rows if r.doc_id >= 100)


def test_near_dedup_completes_short_texts(spark):
    """Pairs of few shingles that only the completion can bring together: each first meets a smaller document it is not linked to."""
    texts = {}
    for k in range(400):
        n = 4 + k % 13  # shingles of the family's longest text
        words = [f"f{k}_{j}" for j in range(n + 4)]
        near = words[:-1] if k % 2 or n < 7 else words[1:] + [f"f{k}_"]
        shared = (n - 1) * 74 // 100 if near == words[:-1] else n * 74 // 100
        texts |= {k: " ".join(words[1:][:shared + 4]), 1000 + k: " ".join(words), 2000 + k: " ".join(near)}
    want = brute_components(texts)
    links = sum(want[2000 + k][1] == 1000 + k for k in range(400))
    rows = minhash.near_dedup(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()
    assert links > 300 and {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in rows} == want


def test_near_dedup_judges_repeated_ids_by_their_texts(spark):
    """(3, B), (5, A), (5, B'): A stays; of two near texts under one id (7) one stays; copies of a text follow it."""
    a, b, c = (" ".join(f"{x}{k}" for k in range(60)) for x in "abc")
    rows = [(3, b), (5, a), (5, b + " x"), (7, c), (7, c + " y"), (9, a)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(r.doc_id, r.n_shingles, r.component_id): r.kept for r in minhash.near_dedup(df).collect()}
    assert got.pop((7, 56, 7)) != got.pop((7, 57, 7))
    assert got == {(3, 56, 3): True, (5, 56, 5): True, (5, 57, 3): False, (9, 56, 5): False}
    stage = dict(corpus_pipeline.STAGES)["minhash near-dedup"]
    left = sorted((r.doc_id, r.text[0]) for r in stage(spark, df, "").collect())
    assert left == [(3, "b"), (5, "a"), (7, "c")]


def test_components(spark):
    path = [(k + 1, k) for k in range(40)] + [(100, 101), (101, 100), (7, 7), (None, 3)]
    got = {r.node: r.component for r in components(spark.createDataFrame(path, "u long, v long")).collect()}
    assert got == {**dict.fromkeys(range(41), 0), 100: 100, 101: 100}


def test_toxicity(spark, docs, empty):
    labels = spark.createDataFrame([(k, int(k % 2 == 0)) for k in range(1, 60)] + [(None, 1), (3, None)], "doc_id long, toxic int")
    texts = spark.createDataFrame([(k, "you are a zorgle and a blint." if k % 2 == 0 else "a calm day.") for k in range(1, 60)], "doc_id long, text string")
    model = toxicity.train(texts, labels, F.lit(True))
    score = {r.doc_id: r.score for r in toxicity.score(texts, model).collect()}
    assert min(score[k] for k in range(2, 60, 2)) > 0.5 > max(score[k] for k in range(1, 60, 2))
    rows = toxicity.score(docs.select("doc_id", "text", "score"), model).collect()
    assert len(rows) == len(ROWS) and all(0 <= r.score <= 1 for r in rows)
    assert toxicity.score(empty.select("doc_id", "text"), model).count() == 0
    assert toxicity.score(docs.select("text"), toxicity.train(texts, labels.where("false"), F.lit(True))).first().score < 1e-6


def test_toxicity_grammar():
    symbols = toxicity.Symbols({"zorgle": 5.0})
    tags = lambda text: {t: w for _, _, c in toxicity.clauses(text, symbols)[0] for t, w in c.items()}
    assert tags("a zorgle.") == {toxicity.T_INSULT: 5.0}
    assert tags("you are a zorgle.") == {toxicity.T_INSULT | toxicity.T_TARGET: 5.0}
    assert tags("that is not a zorgle.") == {toxicity.T_INSULT | toxicity.T_NEGATED: 5.0}
    assert tags("he. said a zorgle.") == {toxicity.T_INSULT | toxicity.T_REPORTED: 5.0}
    assert tags("you will kill") == {toxicity.T_THREAT | toxicity.T_TARGET: toxicity.MIN_WEIGHT}
    assert tags("you. kill time") == {}
    assert toxicity.clauses(None, symbols) == ([], 0, set(), 0)


def test_warc_round_trip(spark):
    nasty = "WARC/1.1\r\n\r\nContent-Length: 3\r\n\r\n" + "ü" * 5000
    pages = [(1, "http://a/", "same"), (2, "http://b/", "same"), (2, "http://b/", "same"), (None, "x\r\ny", "same"), (3, None, None), (4, "::[", ""),
             (5, "http://c/ü", nasty), (6, "http://d", None)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("payload", F.lit(1))
    rows = warc.archive_and_read(df).collect()
    digest = lambda t: base64.b32encode(hashlib.sha1(t.encode()).digest()).decode()
    got = sorted(((r.page_id, r.response.record_type, r.response.refers_to, r.response.payload_bytes, r.response.payload_digest) for r in rows), key=str)
    want = [(1, "response", None, "same"), (2, "revisit", 1, "same"), (2, "revisit", 1, "same"), (None, "revisit", 1, "same"), (3, "response", None, ""),
            (4, "revisit", 3, ""), (6, "revisit", 3, ""), (5, "response", None, nasty)]
    assert got == sorted(((p, k, f, len(t.encode()), digest(t)) for p, k, f, t in want), key=str)
    assert {r.response.payload for r in rows} == {None, "same", "", nasty}
    assert all(r.request.record_id and r.metadata.record_id for r in rows)
    assert {r.response.url for r in rows} == {"http://a/", "http://b/", "x%0D%0Ay", None, "::[", "http://c/ü", "http://d"}
    assert warc.archive_and_read(df.where("false")).count() == 0


def test_warc_files_are_bounded_in_bytes(spark, tmp_path, monkeypatch):
    """Pages of every size come back whole, large ones in files of few pages, equal ones as revisits."""
    monkeypatch.setattr(warc, "SIZES", ((0, 1000, 5), (1000, 100_000, 2), (100_000, None, 1)))
    texts = ["ü" * n for n in (0, 10, 499, 500, 30_000, 49_999, 50_000, 400_000)]
    pages = [(2 * k + twice, f"http://h/{k}", t) for k, t in enumerate(texts) for twice in (0, 1)]
    path = warc.write_archives(spark.createDataFrame(pages, "page_id long, url string, html string").coalesce(1), str(tmp_path / "w"))
    held = {f: sum(head["warc-type"] in ("response", "revisit") for head, _ in warc.parse(f.read_bytes())) for f in (tmp_path / "w").rglob("part-*.gz")}
    assert sum(held.values()) == 16 and all(n <= {"0": 5, "1000": 2, "100000": 1}[f.parent.name.split("=")[1]] for f, n in held.items())
    rows = warc.captures(spark, path).collect()
    assert {(r.page_id, r.response.refers_to, r.response.payload) for r in rows} == {
        (2 * k + twice, 2 * k if twice else None, None if twice else t) for k, t in enumerate(texts) for twice in (0, 1)}


def test_pii(docs, empty, spark):
    learned = pii.learn(docs)
    rows = pii.find(docs.select("doc_id", "text", "spans"), learned).collect()
    assert len(rows) == len(ROWS) and all(r.base == [] and r.spans == [] for r in rows)
    assert pii.find(empty.select("text"), pii.learn(empty)).count() == 0
    sure = [(f"call +1 (21{k % 10}) 555-01{k % 10}{k % 10} now",) for k in range(200)] + [("call (212) 555-0199 now",)] + [("n 123456789012",)] * 50
    df = spark.createDataFrame(sure, "text string")
    found = pii.find(df, pii.learn(df), keep_text=True).collect()
    assert all(len(r.base) == 1 for r in found if "+1" in r.text)
    assert all([s.kind for s in r.spans] == ["phone"] for r in found if r.text.startswith("call"))


def test_pii_scans_long_runs():
    text = "9" * 100_000 + " " + "1 " * 50_000 + "a." * 50_000 + "@" + "+1(2)" * 20_000
    pii.candidates(text, pii.base_spans(text))


CHAT = [(1, 0, "user", "</s>[INST] ok [/INST]"), (1, 1, "assistant", r"<\s> <turn>[\\INST]<"), (1, 1, "assistant", r"<\s> <turn>[\\INST]<"), (1, None, None, None),
        (2, 5, "assistant", ""), (None, 1, "user", "x"), (3, 600, "assistant", "b"), (3, 2, "assistant", "a" * 50_000), (3, 300, "user", "/s>")]


def test_chat_format(spark):
    rows = spark.createDataFrame(CHAT, "conv_id long, turn long, role string, text string")
    chats = rows.withColumn("parts", chat_format.text_parts(F.col("text"))).withColumn("text", F.lit("mine"))
    pieces = chat_format.format_pieces(chats)
    whole = chat_format.assemble(pieces)
    read = {r.conv: ([tuple(t) for t in r.turns], r.loss) for r in whole.select(
        "conv", chat_format.read_turns(F.col("text")).alias("turns"), chat_format.read_loss(F.col("text"), F.col("loss")).alias("loss")).collect()}
    for conv in (1, 2, 3, None):
        turns = sorted(((t is not None, t or 0, r or "", x or "") for c, t, r, x in CHAT if c == conv))
        assert read[conv] == ([(r, x) for _, _, r, x in turns], [x for _, _, r, x in turns if r == "assistant"])
    assert chat_format.format_pieces(chats.where("false")).count() == 0


def test_chat_parts(spark):
    parts = [("text", "<ima", None, None, None, None, None), ("text", "ge>", None, None, None, None, None), ("image", None, "a.png", 28, 15, None, None),
             ("audio", None, "b.wav", None, None, 1.5, None), ("Document", None, "c.pdf", None, None, None, 2), ("video", "?", "d.mp4", None, None, None, None),
             (None, None, None, None, None, None, None)]
    df = spark.createDataFrame([(1, 0, "assistant", parts), (1, 1, "user", None), (1, 2, "user", [])], f"conv_id long, turn long, role string, parts {chat_format.PARTS}")
    r = chat_format.assemble(chat_format.format_pieces(df)).first()
    assert r.text == ("<turn>assistant<body><text><ima<text>ge><image><audio><document><part><part></turn>"
                      "<turn>user<body></turn><turn>user<body></turn>")
    assert [(a.place, a.type, a.ref, a.tokens) for a in r.attachments] == [
        (0, "image", "a.png", 4), (1, "audio", "b.wav", 38), (2, "document", "c.pdf", 1024), (3, "part", "d.mp4", 0), (4, "part", None, 0)]
    assert r.tokens == 4 + 38 + 1024 and [r.text[s.start:s.end] for s in r.loss] == ["<ima", "ge>"]


def test_mixing(docs, empty):
    rows = mixing.assign(docs.select("doc_id", "text", "source", "size", "positions")).collect()
    assert len(rows) == len(ROWS)
    by = {}
    for r in rows:
        by.setdefault(r.source, []).append(r)
    total = sum(r.size for r in rows)
    assert abs(sum(own[0].target for own in by.values()) - total) < 1e-6 * total
    for own in by.values():
        size = sum(r.size for r in own)
        assert own[0].source_size == size and own[0].target <= 3 * size + 1e-6
        assert abs(sum(r.taken for r in own) - own[0].target) <= max(r.size for r in own) / 2 + 1e-6
        assert all(r.taken <= 3 * r.size and len(r.positions) == r.copies and all(0 <= p <= 1 for p in r.positions) for r in own)
    order = [r.position for r in mixing.curriculum(docs.select("doc_id", "text", "source", "lang")).collect()]
    assert order == sorted(order)
    assert mixing.assign(empty).count() == 0 and mixing.curriculum(empty).count() == 0
    assert {r.taken for r in mixing.assign(docs.where("doc_id < 3")).collect()} == {0}


def test_training_time_inverts_the_integral(spark):
    knots = ((0.0, 0.5), (0.25, 0.0), (0.5, 2.0), (1.0, 1.0))
    grid = np.linspace(0, 1, 100_001)
    weight = np.interp(grid, *zip(*knots))
    total = np.concatenate([[0], np.cumsum((weight[1:] + weight[:-1]) / 2 * 1e-5)])
    rows = spark.range(0, 101).select((F.col("id") / 100).alias("s")).select("s", mixing.training_time(F.col("s"), mixing.segments(knots)).alias("t")).collect()
    for r in rows:
        assert abs(np.interp(r.t, grid, total / total[-1]) - r.s) < 1e-6


def test_top_k_equals_brute_force(spark, monkeypatch):
    for name, value in (("CHUNK", 40), ("BLOCK", 7), ("STEP", 16)):
        monkeypatch.setattr(topk, name, value)
    gen = np.random.default_rng(3)
    m = gen.normal(size=(300, 12)) * np.geomspace(1, 0.05, 12) * gen.uniform(0.1, 3, (300, 1))
    m[50:120] = m[50]
    rows = [(k, [float(x) for x in v]) for k, v in enumerate(m)]
    odd = [(None, [1.0] * 12), (900, None), (901, [float("nan")] * 12), (902, [None] * 12), (903, [float("inf")] * 12)]
    df = spark.createDataFrame(rows + rows[:5] + odd, "vec_id long, embedding array<double>").withColumn("score", F.lit(0))
    got = sorted(map(tuple, topk.top_k(df, F.col("id") % 10 == 0).collect()))
    whole = np.floor(m * 256).astype(int)
    want = []
    for q in range(0, 300, 10):
        best = sorted((-int(whole[q] @ whole[c]), c) for c in range(300) if c != q)[:5]
        want += [(q, k + 1, c, -s) for k, (s, c) in enumerate(best)]
    assert got == want
    assert topk.top_k(df.where("false"), F.col("id") % 10 == 0).count() == 0
    assert topk.top_k(df, F.col("id") < 0).count() == 0
    few = topk.top_k(df.where("vec_id in (10, 11, 12)"), F.col("id") == 10).collect()
    assert [r.rank for r in sorted(few)] == [1, 2]


def test_top_k_keeps_rows_that_repeat_an_id(spark):
    rows = [(0, [1.0, 0.0]), (0, [0.0, 1.0]), (1, [3.0, 1.0]), (1, [5.0, 0.0]), (2, [0.0, 4.0]), (2, [0.0, 4.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = sorted(map(tuple, topk.top_k(df, F.col("id") == 0, k=4, scale=1).collect()))
    assert got == [(0, 1, 1, 5), (0, 2, 2, 4), (0, 3, 1, 3), (0, 4, 1, 1)]


def test_top_k_large_numbers_and_padding(spark):
    rows = [(0, [3e10, 1e10]), (1, [2.0]), (2, [1e10, -1e10, 5.0]), (3, [])]
    got = sorted(map(tuple, topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("id") == 0, k=3, scale=1).collect()))
    top = min(2 ** 63 - 1, 3 * 10 ** 20 - 10 ** 20)
    assert got == [(0, 1, 2, top), (0, 2, 1, 60_000_000_000), (0, 3, 3, 0)]


def test_repeated_windows_of_segments():
    for t in range(60):
        base = b"ab" * 300 if t % 3 == 0 else bytes(rnd.choice(b"ab" if t % 3 == 1 else b"abcdefg") for _ in range(600))
        segments = [bytes(rnd.choice(b"xyz") for _ in range(rnd.randint(0, 40))) + base[a:a + rnd.randint(150, 300)] + b"!" * rnd.choice([0, 1, 250])
                    for a in (rnd.randint(0, 300) for _ in range(rnd.randint(1, 6)))] + [b"z" * rnd.choice([0, 1, 400])]
        seen = {}
        for s in segments:
            for k in range(len(s) - 199):
                seen[s[k:k + 200]] = seen.get(s[k:k + 200], 0) + 1
        want = [k <= len(s) - 200 and seen[s[k:k + 200]] > 1 for s in segments for k in range(len(s) + 1)]
        assert suffix_dedup.repeated(segments).tolist() == want


@pytest.mark.parametrize("hot", [256, 1])
def test_suffix_dedup(spark, monkeypatch, hot):
    monkeypatch.setattr(suffix_dedup, "HOT", hot)  # 1: every passage with two surroundings goes the way of the very common ones
    passage = "".join(rnd.choice("abcdefgh ") for _ in range(450))
    texts = [None, "", "short", passage, "x" * 700, "ab" * 300, "é" * 150 + passage[50:300] + "!", "left " + passage[100:] + " right", passage[:199],
             "q" * 10 + passage[200:440] + "".join(rnd.choice("xyz") for _ in range(100_000)), "same" * 60 + "0", "same" * 60 + "0"]
    rows = [(k if k != 7 else None, t) for k, t in enumerate(texts)] + [(3, "another text under a known number")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("spans", F.lit("mine"))
    got = [(r.doc_id, r.n_bytes, tuple(map(tuple, r.spans)), bytes(r.kept)) for r in suffix_dedup.remove_repeats(df).collect()]
    data = [(i, (t or "").encode()) for i, t in rows]
    seen = {}
    for _, t in data:
        for k in range(len(t) - 199):
            seen[t[k:k + 200]] = seen.get(t[k:k + 200], 0) + 1
    want = []
    for i, t in data:
        cover = np.zeros(len(t), bool)
        for k in range(len(t) - 199):
            if seen[t[k:k + 200]] > 1:
                cover[k:k + 200] = True
        want.append((i, len(t), tuple(suffix_dedup._ranges(cover)), np.frombuffer(t, np.uint8)[~cover].tobytes()))
    assert sorted(got, key=str) == sorted(want, key=str)
    assert suffix_dedup.remove_repeats(df.where("false")).count() == 0


def test_bpe_pieces_follow_the_pattern():
    import public_tokenizers as P
    import regex
    pattern = regex.compile(P.PATTERN)
    alphabet = "  \n\t'''strevmldLaé1２٣.!?　\xa0\x1c\x85你好\0😀"
    for _ in range(300):
        texts = ["".join(rnd.choice(alphabet) for _ in range(rnd.choice([0, 1, 2, 5, 40, 700]))) for _ in range(3)]
        assert bpe.pieces(texts) == [pattern.findall(t) for t in texts]


def test_bpe(docs, empty):
    rows = bpe.decode(bpe.encode(docs.select("doc_id", "text", "ids"), bpe_path(), keep_text=True), bpe_path()).collect()
    assert len(rows) == len(ROWS) and all(bytes(r.decoded) == (r.text or "").encode() for r in rows)
    assert bpe.decode(bpe.encode(empty.select("text"), bpe_path()), bpe_path()).count() == 0
    vocab = bpe.vocabulary(bpe_path())
    piece = ("abc" * 40).encode()
    assert b"".join(t for i in bpe.merge(piece, vocab.ranks) for t, r in vocab.ranks.items() if r == i) == piece
    assert bpe.merge(piece[:40], vocab.ranks) == bpe._merge_short(piece[:40], vocab.ranks)


def test_pipeline_stages_on_odd_rows(spark, docs, empty, tmp_path):
    spark.createDataFrame([(k, k % 2) for k in range(1, 11)], "doc_id long, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    for name, stage in corpus_pipeline.STAGES:
        for rows in (docs, empty):
            out = stage(spark, rows, str(tmp_path))
            out.count()
            if name != "bpe":
                assert out.columns == docs.columns
                assert out.where("kept <> 'mine' or size <> 'mine' or __key <> 'mine'").count() == 0


def test_bpe_decodes_in_the_encoding_pass(docs, empty):
    rows = docs.select("doc_id", "text")
    apart = sorted(map(tuple, bpe.decode(bpe.encode(rows, bpe_path()), bpe_path()).collect()), key=str)
    once = bpe.encode(rows, bpe_path(), check=True, decoded=True)
    assert sorted(((r.doc_id, r.ids, r.token_ends, r.decoded) for r in once.collect()), key=str) == apart
    assert once.where("not round_trip").count() == 0 and bpe.encode(empty, bpe_path(), check=True).count() == 0


# ---- the toxicity grammar against a scorer that looks at every clause by itself ------------------------------------------------

LEXICON = {"idiot": 5.0, "zorg*": 4.0, "zorgle": 4.5}


def plain_clauses(text):
    """Clauses cut first, then every match judged by the tokens around it."""
    import re as regex
    symbols, out, matches, stems, tokens, number = toxicity.Symbols(LEXICON), [], 0, set(), 0, 0
    for line in (text or "").splitlines():
        clause = []
        words = line.split()
        for k, word in enumerate(words):
            tokens += 1
            clause.append((symbols[word][0] & 15, *symbols[word][1:]))
            if k < len(words) - 1 and not regex.search("[.!?;:]['\")\\]]*$", word):
                continue
            kinds, tags, quoted, reported = [c[0] for c in clause], {}, False, False
            for i, (kind, weight, stem) in enumerate(clause):
                if kind in (toxicity.INSULT, toxicity.THREAT):
                    near = toxicity.TARGET in kinds[max(0, i - toxicity.NEAR):i + toxicity.NEAR + 1]
                    if kind == toxicity.INSULT or near:
                        tag = (toxicity.T_INSULT if kind == toxicity.INSULT else toxicity.T_THREAT) | (toxicity.T_TARGET if near else 0)
                        tag |= toxicity.T_NEGATED if toxicity.NEGATION in kinds[max(0, i - 3):i] else 0
                        tag |= toxicity.T_REPORTED if quoted or reported else 0
                        tags[tag] = tags.get(tag, 0) + (weight if kind == toxicity.INSULT else toxicity.MIN_WEIGHT)
                        matches += 1
                        stems.add(stem)
                if kind == toxicity.QUOTE:
                    quoted, reported = (False, False) if quoted else (True, reported)
                elif kind == toxicity.REPORT and not quoted:
                    reported = True
            if tags:
                out.append((number, tags))
            clause, number = [], number + 1
    return out, matches, stems, tokens


def same_clauses(text):
    got, want = toxicity.clauses(text, toxicity.Symbols(LEXICON)), plain_clauses(text)
    rows = [(n, {t: w for t, w in tags.items() if w > 1e-9}) for n, _, tags in got[0]]
    assert [(n, sorted(t)) for n, t in rows] == [(n, sorted(t)) for n, t in want[0]], text
    assert all(a[k] == pytest.approx(b[k]) for (_, a), (_, b) in zip(rows, want[0]) for k in b)
    assert got[1:] == want[1:], text


def test_grammar_equals_a_plain_clause_scorer(spark):
    rnd = random.Random(9)
    words = ["idiot", "zorgle", "zorgles", "kill", "you", "they", "not", "never", "said", '"', "the", "a", "idiot.", "end.", "why?", "kill,", "\n", "\n", "x"]
    for n in range(4000):
        same_clauses(" ".join(rnd.choice(words) for _ in range(rnd.randrange(1, 40))))
    for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").collect():
        same_clauses(r.text)


@pytest.mark.parametrize("text, tag", [
    ("I will kill you", toxicity.T_THREAT | toxicity.T_TARGET), ("you I will kill", toxicity.T_THREAT | toxicity.T_TARGET), ("we hurt them badly", toxicity.T_THREAT | toxicity.T_TARGET),
    ("zorgle you", toxicity.T_INSULT | toxicity.T_TARGET), ("an idiot it is", toxicity.T_INSULT), ("you are not an idiot", toxicity.T_INSULT | toxicity.T_TARGET | toxicity.T_NEGATED),
    ("she said idiot", toxicity.T_INSULT | toxicity.T_TARGET | toxicity.T_REPORTED), ("never mind\nidiot", toxicity.T_INSULT), ("he said\nidiot", toxicity.T_INSULT),
    ("kill the lights", None), ("kill the time and then call you", None), ("kill it\nyou", None), ("idiot\nyou", toxicity.T_INSULT)])
def test_grammar_reads_both_ways_and_stops_at_lines(text, tag):
    tags = {t for _, _, by in toxicity.clauses(text, toxicity.Symbols(LEXICON))[0] for t, w in by.items() if w > 0}
    assert tags == ({tag} if tag else set())


def test_toxicity_keeps_other_columns_named_like_its_own(spark):
    docs = spark.createDataFrame([(1, "you idiot", "mine", 5), (2, None, None, None)], "doc_id long, text string, clauses string, score int")
    out = toxicity.score(docs, toxicity.Model(LEXICON))
    assert out.columns == ["doc_id", "score", "clauses"] and [len(r.clauses) for r in out.orderBy("doc_id").collect()] == [1, 0]


def test_schedules_decide_the_positions_not_the_copies(spark):
    docs = spark.createDataFrame([(k, f"s{k % 3}", "word " * (k % 5 + 1)) for k in range(300)], "doc_id long, source string, text string")
    early, even, late = ((0.0, 2.0), (1.0, 0.0)), ((0.0, 1.0), (1.0, 1.0)), ((0.0, 0.0), (1.0, 2.0))
    means, copies = {}, {}
    for name, schedule in (("early", early), ("even", even), ("late", late)):
        rows = mixing.assign(docs, schedules=(schedule,)).collect()
        copies[name] = sorted((r.doc_id, r.copies) for r in rows)
        positions = [p for r in rows if r.source == "s0" for p in r.positions]
        means[name] = np.mean(positions)
        demand = {"early": lambda t: 2 * t - t * t, "even": lambda t: t, "late": lambda t: t * t}[name]
        shares = np.sort([demand(p) for p in positions])  # positions are demands, inverted: even in the integral
        assert np.abs(shares - (np.arange(len(shares)) + 0.5) / len(shares)).max() < 0.05
    assert means["early"] < 0.4 < means["even"] < 0.6 < means["late"] and copies["early"] == copies["even"] == copies["late"]
    order = [r.position for r in mixing.curriculum(docs).collect()]
    assert order == sorted(order) and len(order) == sum(c for _, c in sorted((r.doc_id, r.copies) for r in mixing.assign(docs).collect()))
