from pyspark.sql import functions as F

from chatlake.operators import tfidf
from chatlake.sources.stopwords import read_stopword_list, stopwords_df


def test_three_tiny_documents(spark):
    # hand-computed: n = 3 (the empty text counts), smoothed idf, L2 rows, corpus sum
    docs = spark.createDataFrame([(1, "cat cat dog"), (2, "dog fish"), (3, "")], "doc_id long, text string")
    got = {r.term: r.weight for r in tfidf.top_terms(tfidf.keyword_weights(docs), k=100).collect()}
    assert got == {"dog": 0.960781, "cat": 0.934702, "fish": 0.795961}


def test_rel_weight_and_order(spark):
    docs = spark.createDataFrame([(1, "cat cat dog"), (2, "dog fish"), (3, "")], "doc_id long, text string")
    rows = tfidf.top_terms(tfidf.keyword_weights(docs), k=2).collect()
    assert [r.term for r in rows] == ["dog", "cat"]
    assert rows[0].rel_weight == 1.0


def test_stopwords_removed_and_norm_is_one(spark):
    docs = spark.createDataFrame([(1, "The cat and the dog"), (2, "a dog: and fish")], "doc_id long, text string")
    sw = stopwords_df(spark)
    w = tfidf.tfidf(docs, stopwords=sw)
    terms = {r.term for r in w.select("term").distinct().collect()}
    assert "the" not in terms and "and" not in terms and {"cat", "dog", "fish"} <= terms
    norms = w.groupBy("doc_id").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("n")).collect()
    assert all(abs(r.n - 1.0) < 1e-12 for r in norms)


def test_stopword_list_shape():
    words = read_stopword_list()
    assert len(words) == 606 and words[0] == "" and len(set(words)) == 606
    assert "dont" not in words  # apostrophe forms can never match cleaned tokens


def test_grouped_top_terms(spark):
    docs = spark.createDataFrame([(1, "a1", "cat cat dog"), (2, "a1", "dog"), (3, "b2", "fish fish")],
                                 "doc_id long, source string, text string")
    r = tfidf.top_terms(tfidf.keyword_weights(docs, group_cols=["source"]), k=1, group_cols=["source"]).collect()
    # a1: cat = 2*1.405/2.983 = 0.942, dog = 1/2.983 + 1 = 1.335
    assert {(x.source, x.term) for x in r} == {("a1", "dog"), ("b2", "fish")}


def test_plan_moves_no_text_and_one_row_a_message(spark):
    # after the written (term, tf) arrays: one exchange by message (of arrays), none of a text, no window, no fixed partition count
    docs = spark.createDataFrame([(1, "cat cat dog"), (2, "dog fish"), (3, "")], "doc_id long, text string")
    plan = tfidf.keyword_weights(docs, stopwords=stopwords_df(spark))._jdf.queryExecution().executedPlan().toString()
    exchanges = [ln for ln in plan.splitlines() if "Exchange hashpartitioning" in ln]
    assert sum("doc_id" in ln for ln in exchanges) == 1 and "REPARTITION" not in plan and "Window" not in plan and "text#" not in plan, plan


def test_counts_inside_the_row_equal_a_counter(spark):
    from collections import Counter
    import random
    rnd = random.Random(2)
    rows = [(k, " ".join(rnd.choice(["aa", "bb", "cc", "ab", "zz"]) for _ in range(rnd.choice([0, 1, 2, 7, 300])))) for k in range(60)] + [(100, None), (101, "a b"), (60, "x" * 5000)]
    got = {r.doc_id: {t.term: t.tf for t in r.terms} for r in tfidf.message_terms(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {k: dict(Counter(w for w in t.split() if len(w) > 1)) for k, t in rows if t is not None}


def test_groups_and_messages_without_a_key(spark):
    docs = spark.createDataFrame([(1, None, "cat dog"), (2, None, "cat"), (3, "s", "cat"), (None, "s", "bird cat"), (4, "t", None)],
                                 "doc_id long, source string, text string")
    w = {(r.source, r.term): r.weight for r in tfidf.keyword_weights(docs, group_cols=["source"]).collect()}
    assert set(w) == {(None, "cat"), (None, "dog"), ("s", "cat"), ("s", "bird")}
    plain = {(None, r.term): r.weight for r in tfidf.keyword_weights(docs.where("source is null")).collect()}
    assert all(abs(w[k] - v) < 1e-12 for k, v in plain.items())


def test_large_vocabulary_path_gives_same_weights(spark):
    # With broadcasting disabled the idf table is sort-merge joined; the weights must not change.
    docs = spark.createDataFrame([(1, "cat cat dog"), (2, "dog fish"), (3, ""), (4, "cat: bird")],
                                 "doc_id long, text string")
    small = {r.term: r.weight for r in tfidf.top_terms(tfidf.keyword_weights(docs)).collect()}
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        big = tfidf.keyword_weights(docs)
        assert "SortMergeJoin" in big._jdf.queryExecution().executedPlan().toString()
        assert {r.term: r.weight for r in tfidf.top_terms(big).collect()} == small
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_keywords_from_postings_equal_plain_sums(spark, monkeypatch):
    # few pairs a block: many blocks; ids that repeat or are null, groups that are null; no (message, term) pair is collected
    from collections import Counter, defaultdict
    import math
    import random
    monkeypatch.setattr(tfidf, "BLOCK_PAIRS", 40)
    rnd = random.Random(3)
    words = ["aa", "bb", "Cc", "dd:ee", "the", "x", "q" * 40, "ёж,", "éa", "re-use"]
    rows = [(rnd.choice([None, *range(40)]), rnd.choice([None, "s", "t"]), " ".join(rnd.choice(words) for _ in range(rnd.choice([0, 1, 3, 30])))) for _ in range(120)] + [(7, "s", None)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string")
    split = lambda t: [w for w in t.lower().replace("é", "").replace(",", "").replace("-", "").replace(":", " ").split() if len(w) > 1 and w != "the"]
    sw = stopwords_df(spark, ["the"])
    for g in ([], ["source"]):
        of = lambda r: r[1] if g else ""
        n, df, want = Counter(of(r) for r in rows if r[2] is not None), Counter(), defaultdict(float)
        counted = [(of(r), r[0], Counter(split(r[2]))) for r in rows if r[2] is not None]
        for s, _, c in counted:
            df.update((s, w) for w in c)
        idf = lambda s, w: math.log((1 + n[s]) / (1 + df[s, w])) + 1
        square = defaultdict(float)
        for s, k, c in counted:
            square[s, k] += sum((v * idf(s, w)) ** 2 for w, v in c.items())
        for s, k, c in counted:
            for w, v in c.items():
                want[s, w] += v * idf(s, w) / math.sqrt(square[s, k])
        weights = tfidf.keyword_weights(docs, group_cols=g, stopwords=sw)
        got = {(r.source if g else "", r.term): r.weight for r in weights.collect()}
        assert set(got) == set(want) and all(abs(got[k] - v) < 1e-9 for k, v in want.items())
        assert "collect_list" not in weights._jdf.queryExecution().executedPlan().toString()
        each = tfidf.tfidf(docs, group_cols=g, stopwords=sw).groupBy(*g, "term").agg(F.sum("w").alias("weight")).collect()
        assert all(abs(r.weight - want[r.source if g else "", r.term]) < 1e-9 for r in each) and len(each) == len(want)


def test_a_term_is_one_posting_in_a_block(spark):
    docs = spark.createDataFrame([(k, "cat dog") for k in range(500)], "doc_id long, text string").coalesce(1)
    p = tfidf._postings(tfidf.message_terms(docs), [], "doc_id")
    assert p.count() <= 2 * spark.sparkContext.defaultParallelism and p.select(F.sum(F.size("ids"))).first()[0] == 1000
