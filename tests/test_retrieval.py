import numpy as np
from pyspark.sql import functions as F

from chatlake.functions.embed import embed_column, hashing_embedder
from chatlake.operators import retrieval as rt


def _vectors(spark, n=120, dim=8, seed=1):
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        v = rng.normal(size=dim)
        rows.append((i, f"ns{i % 3}", (v / np.linalg.norm(v)).astype(float).tolist(), f"s{i % 7}", f"text {i % 11}"))
    return spark.createDataFrame(rows, "vec_id long, namespace string, embedding array<double>, source string, "
                                       "page_content string"), rows


def test_topk_matches_brute_force(spark):
    vecs, rows = _vectors(spark)
    q = rt.centroids(vecs, "namespace").withColumn("query_id", F.col("namespace"))
    qs = {r.namespace: np.array(r.qvec) for r in q.collect()}
    hits = rt.top_k(rt.score(q, vecs, "namespace"), k=5, threshold=0.55).collect()
    got = {(h.query_id, h.rank): h.vec_id for h in hits}
    want = {}
    for ns, qv in qs.items():
        cand = [((1 + float(qv @ np.array(e)) / (np.linalg.norm(qv) * np.linalg.norm(e))) / 2, i)
                for i, n, e, _, _ in rows if n == ns]
        cand = sorted([c for c in cand if c[0] >= 0.55], key=lambda c: (-c[0], c[1]))[:5]
        for r, (_, i) in enumerate(cand, 1):
            want[(ns, r)] = i
    assert got == want
    assert all(h.score >= 0.55 for h in hits)  # top-k is inside the threshold set


def test_dedupe_and_context(spark):
    vecs, _ = _vectors(spark)
    q = rt.centroids(vecs, "namespace").withColumn("query_id", F.col("namespace"))
    hits = rt.top_k(rt.score(q, vecs, "namespace"), k=10, threshold=None).join(
        vecs.select("vec_id", "source", "page_content"), "vec_id")
    best = rt.best_per_source(hits).collect()
    assert len({(b.query_id, b.source) for b in best}) == len(best)
    ctx = {r.query_id: r for r in rt.assemble_context(hits, tail="END").collect()}
    for qid, r in ctx.items():
        parts = r.context.split("\n\n")
        assert parts[-1] == "END" and len(parts) - 1 == r.n_docs == len(set(parts[:-1]))


def test_unit_norm_and_embedder(spark):
    df = spark.createDataFrame([(1, "Hello world hello"), (2, ""), (3, "Написание кода")], "id long, t string")
    e = df.select("id", embed_column("t", hashing_embedder(16)).alias("v"))
    out = {r.id: np.array(r.v) for r in e.collect()}
    assert abs(np.linalg.norm(out[1]) - 1) < 1e-6 and abs(np.linalg.norm(out[3]) - 1) < 1e-6
    assert np.linalg.norm(out[2]) == 0
    n = e.select(rt.norm(rt.as_double("v")).alias("n"), rt.normalize(rt.as_double("v")).alias("u")).collect()
    assert all(abs(x.n - 1) < 1e-6 or x.n == 0 for x in n)


def test_with_documents_equals_left_join(spark):
    from chatlake.operators import retrieval as rt
    hits = spark.createDataFrame([(1, 10, 0.9), (1, 11, 0.8), (2, 10, 0.7), (2, 99, 0.65)],
                                 "query_id long, vec_id long, score double")
    docs = spark.createDataFrame([(10, "s1", "ten"), (11, None, "eleven"), (12, "s2", "twelve")],
                                 "vec_id long, source string, page_content string")
    got = rt.with_documents(hits, docs).select("query_id", "vec_id", "score", "source", "page_content")
    want = hits.join(docs, "vec_id", "left").select(*got.columns)
    assert sorted(got.collect()) == sorted(want.collect()) and got.count() == 4


def test_block_scores_equal_pairwise_scores(spark):
    vecs, rows = _vectors(spark, n=200)
    odd = spark.createDataFrame([(900, "ns0", [0.0] * 8, "z", "t"), (901, "ns1", None, "z", "t"), (902, "ns1", [1.0], "z", "t"), (903, None, [1.0] * 8, "z", "t")], vecs.schema)
    vecs = vecs.unionAll(odd)
    q = spark.createDataFrame([(f"q{i}", f"ns{i % 4}", rows[i][2]) for i in range(9)] + [("q9", "ns0", rows[0][2]), ("q10", "ns1", None)],
                              "query_id string, namespace string, qvec array<double>")
    for k, threshold in ((3, None), (5, 0.6), (500, None)):
        pairwise = rt.top_k(rt.score(q, vecs.where("vec_id <> 902"), "namespace").where("score is not null"), k=k, threshold=threshold)
        blocks = rt.top_k(rt.score(q, vecs, "namespace", keep=("source",), k=k, threshold=threshold), k=k, threshold=threshold)
        want = {(r.query_id, r.rank): (r.vec_id, round(r.score, 9)) for r in pairwise.collect()}
        assert {(r.query_id, r.rank): (r.vec_id, round(r.score, 9)) for r in blocks.collect()} == want and want
    plan = rt.top_k(rt.score(q, vecs, "namespace", k=3), k=3)._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan and "Join" not in plan  # no explode by dimension, no pair rows


def test_centroids_are_means_of_whole_vectors(spark):
    vecs, rows = _vectors(spark)
    got = {r.namespace: np.array(r.qvec) for r in rt.centroids(vecs, "namespace").collect()}
    for ns in got:
        m = np.mean([e for _, n, e, _, _ in rows if n == ns], axis=0)
        assert np.allclose(got[ns], m / np.linalg.norm(m))
    assert "Generate" not in rt.centroids(vecs, "namespace")._jdf.queryExecution().executedPlan().toString()
