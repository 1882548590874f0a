import json

from pyspark.sql import functions as F

from chatlake.functions.embed import hashing_embedder
from chatlake.plans import flows
from chatlake.sources import sinks


def _export(folder):
    ms = [{"id": i, "type": "message", "date": f"2024-01-01T10:{i:02d}:00", "date_unixtime": str(1704103200 + 60 * i),
           "from": "Ann", "from_id": "user1", "text": t}
          for i, t in enumerate(["cooking pasta with tomato", "writing code in python", "cooking soup", "python code review"])]
    (folder / "result.json").write_text(json.dumps({"name": "Kitchen", "messages": ms}))


def test_import_index_search(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    _export(src)
    store = str(tmp_path / "store")
    emb = hashing_embedder(32)
    msgs, rejects, kw = flows.import_chat_export(spark, str(src), 42, store, embed_fn=emb)
    assert msgs.count() == 4 and rejects.count() == 0
    assert {"cooking", "python", "code"} <= {r.term for r in kw.collect()}
    notes = spark.createDataFrame([(42, 7, "python code notes"), (42, 8, "soup recipe"), (43, 9, "other user")],
                                  "user_id long, telegram_message_id long, text string")
    users = spark.createDataFrame([(42, 42, None), (43, 43, "index-3")], "user_id long, telegram_id long, index_name string")
    flows.index_pending_notes(spark, notes, users, store, embed_fn=emb)
    flows.index_pending_notes(spark, notes, users, store, embed_fn=emb)  # nothing new the second time
    st = spark.read.parquet(store)
    assert st.where(F.col("telegram_message_id").isNotNull()).count() == 3
    assert {r.index_name for r in st.where("user_id = 43").collect()} == {"index-3"}
    qv = emb(__import__("pandas").Series(["python code"]))[0]
    q = spark.createDataFrame([(1, 42, qv)], "query_id long, telegram_id long, qvec array<float>") \
        .withColumn("qvec", F.col("qvec").cast("array<double>"))
    hits = flows.search_notes(spark, q, store, threshold=0.0)
    assert [r.source for r in hits.collect()] == [7]  # only notes of user 42 have a source
    both = flows.search_notes(spark, q, store, threshold=0.0, include_imported=True).collect()
    assert len(both) > 1 and any(r.source is None for r in both)
    part, _ = sinks.store_part(spark, store, q.select(F.lit("user_42_notes").alias("namespace"), F.lit("index-1").alias("index_name")))
    assert "PartitionFilters" in part._jdf.queryExecution().executedPlan().toString() and part.select("bucket").distinct().count() == 1
    # the user's own index only; users that may not search get nothing, and searches are counted
    assert flows.search_notes(spark, q.withColumn("index_name", F.lit("index-2")), store, threshold=0.0).count() == 0
    gate = spark.createDataFrame([(42, True, True), (43, True, False), (44, False, True)], "telegram_id long, access boolean, within_limits boolean")
    asked = q.unionByName(q.withColumns({"query_id": F.lit(2), "telegram_id": F.lit(43).cast("long")})).unionByName(q.withColumn("query_id", F.lit(3)))
    allowed = flows.allowed_queries(asked, gate)
    assert sorted(r.query_id for r in allowed.collect()) == [1, 3]
    assert {r.query_id for r in flows.search_notes(spark, asked, store, threshold=0.0, users=gate).collect()} == {1, 3}
    counted = flows.count_searches(gate.withColumn("queries_count", F.lit(5)), allowed).collect()
    assert {r.telegram_id: r.queries_count for r in counted} == {42: 7, 43: 5, 44: 5}
