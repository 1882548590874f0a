import random

from pyspark.sql import functions as F

from chatlake.operators import messages as msg
from chatlake.operators import text_stats as ts


def test_two_level_concat_equals_plain_join(spark):
    rng = random.Random(5)
    rows = []
    for conv in range(4):
        for turn in range(rng.randint(0, 25)):
            rows.append((conv, turn, None if rng.random() < 0.3 else f"t{conv}.{turn}"))
    rows += [(9, 0, None), (9, 1, None), (9, 2, "only")]  # a bucket with nulls only
    df = spark.createDataFrame(rows, "conv_id long, turn long, text string")
    got = {r.conv_id: (r.all_text, r.n_parts) for r in ts.concat_texts(df, ["conv_id"], "turn", bucket_size=2).collect()}
    want = {}
    for conv in {r[0] for r in rows}:
        parts = [t for c, _, t in sorted(rows) if c == conv and t is not None]
        want[conv] = ("\n\n".join(parts) if parts else None, len(parts))
    assert got == want


def test_histogram_and_summary(spark):
    df = spark.createDataFrame([(i, " ".join(["w"] * n)) for i, n in enumerate([0, 1, 2, 10, 10, 5])],
                               "doc_id long, text string")
    h = {r.bucket: r.n for r in ts.words_histogram(df).collect()}
    assert h == {1: 1, 2: 1, 3: 1, 6: 1, 10: 2}  # the maximum lands in the last bin
    s = ts.words_summary(df).first()
    assert (s.n_messages, s.mean_words) == (6, round(28 / 6, 6))
    assert abs(s.p99_words - (10.0)) < 1e-9
    c = ts.corpus_chars(df.union(spark.createDataFrame([(99, None)], "doc_id long, text string"))).first()
    assert c.n_chars == sum(len(" ".join(["w"] * n)) for n in [0, 1, 2, 10, 10, 5]) + 2 * 5


def test_compose_and_render(spark):
    m = spark.createDataFrame([
        (0, 0, "hi", "c", "ann", "", "2024-01-02T03:04:05"),
        (0, 1, "yo", "c", None, "", "2024-01-02T03:05:00"),
    ], "chat_idx long, pos long, msg_content string, chat_name string, sender string, forwarded_from string, date string")
    c = msg.compose_index_text(m).collect()
    assert [r.text for r in c] == ["hi\nFrom the chat: c\n\nSender: ann\nForwarded from: "]  # null sender dropped (Q3)
    kept = msg.compose_index_text(m, null_as="").collect()
    assert len(kept) == 2
    hits = spark.createDataFrame([(1, c[0].text, c[0].date), (1, c[0].text, c[0].date), (1, "no marker", "2024-01-01T00:00:00")],
                                 "query_id long, text string, date string")
    r = {x.body: x for x in msg.render_hits(hits).collect()}
    assert len(r) == 2  # duplicates rendered once (SET4)
    a = r["hi\n"]
    assert a.origin == "c\n\nSender: ann\nForwarded from: \n\nDate: 2024-01-02"
    assert a.rendered == "```\nhi\n```From the chat: " + a.origin
    b = r["no marker\n\nDate: 2024-01-01"]
    assert b.origin is None and b.rendered == "```\nno marker\n\nDate: 2024-01-01```"


def test_last_n_per_group(spark):
    m = spark.createDataFrame([(f, c, p) for f in ("a", "b") for c in range(2) for p in range(3)],
                              "file string, chat_idx long, pos long")
    got = sorted((r.file, r.chat_idx, r.pos) for r in msg.last_n_by_arrival(m, n=2, per=["file"]).collect())
    assert got == [("a", 1, 1), ("a", 1, 2), ("b", 1, 1), ("b", 1, 2)]


def test_the_limit_falls_inside_a_piece_of_a_chat(spark):
    rows = [(c, p) for c in (0, 1, None) for p in range(50)] + [(2, None), (2, 7)]
    m = spark.createDataFrame(rows, "chat_idx long, pos long").withColumn("_n", F.lit("mine"))
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or 0), reverse=True)
    for n in (0, 1, 2, 30, 53, 102, 152, 1000):
        for piece in (1, 8, 4096):
            got = [(r.chat_idx, r.pos) for r in msg.last_n_by_arrival(m, n=n, piece=piece).collect()]
            assert sorted(got, key=str) == sorted(order[:n], key=str)
    out = msg.last_n_by_arrival(m, n=30, piece=8)
    assert out.columns == m.columns
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrdered" not in plan and "CollectLimit" not in plan
