import json
import os

from pyspark.sql import functions as F

import __spark_entry__ as entry
from chatlake.operators import chunks as ch
from chatlake.session import scratch_path
from chatlake.sources import sinks
from chatlake.streaming import streams as st
from tests.conftest import SF001


def _chunks(spark):
    notes = spark.createDataFrame([(1, 10, "a\nb" * 300, "user_1_notes", "index-2"),
                                   (2, 11, "c", "user_2_notes", "index-3")],
                                  "user_id long, telegram_message_id long, text string, namespace string, index_name string")
    c = ch.chunk_documents(notes, id_cols=("user_id", "telegram_message_id"), separator="\n",
                           keep_cols=("namespace", "index_name"))
    return c.withColumn("chunk_id", ch.chunk_id("namespace", "telegram_message_id", "chunk_idx", "chunk"))


def test_chunk_store_is_idempotent_and_clearable(spark, tmp_path):
    path = str(tmp_path / "store")
    c = _chunks(spark)
    sinks.append_chunks(c, path)
    n1 = spark.read.parquet(path).count()
    sinks.append_chunks(c, path)
    assert spark.read.parquet(path).count() == n1 == c.count()
    stats = {(r.index_name, r.namespace): r.n_records for r in sinks.index_stats(spark.read.parquet(path)).collect()}
    assert sum(stats.values()) == n1 and ("index-3", "user_2_notes") in stats
    # one folder a bucket: a filter on index and bucket reads one folder
    part = sinks.touched_buckets(spark.read.parquet(path), c.withColumn("bucket", sinks.bucket_of("namespace")).where("namespace = 'user_1_notes'"))
    plan = part._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and part.select("namespace").distinct().count() == 1
    sinks.drop_index(spark, path, "index-3")
    assert {r.index_name for r in spark.read.parquet(path).select("index_name").distinct().collect()} == {"index-2"}


def _files(path):
    return {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, fs in os.walk(path) for f in fs if f.endswith(".parquet")}


def test_many_namespaces_share_bounded_files_and_one_is_cleared_alone(spark, tmp_path):
    path = str(tmp_path / "store")
    rows = spark.range(5000).select(F.concat(F.lit("index-"), F.col("id") % 3 + 1).alias("index_name"), F.concat(F.lit("user_"), F.col("id") % 900, F.lit("_notes")).alias("namespace"),
                                    F.concat(F.lit("c"), "id").alias("chunk_id"))
    sinks.append_chunks(rows.repartition(16), path)
    before = _files(path)
    assert len(before) <= 3 * sinks.BUCKETS  # not tasks x users
    sinks.append_chunks(rows.limit(0), path)
    sinks.clear_namespace(spark, path, "index-2", "user_1_notes")
    left = spark.read.parquet(path)
    assert left.where("namespace = 'user_1_notes'").count() == 0
    want = rows.where("namespace <> 'user_1_notes'")
    assert left.select(*rows.columns).exceptAll(want).count() == 0 and left.count() == want.count()
    after = _files(path)
    bucket = spark.range(1).select(sinks.bucket_of(F.lit("user_1_notes"))).first()[0]
    same = {f for f in before if f"index_name=index-2/bucket={bucket}/" not in f}
    assert all(after.get(f) == before[f] for f in same)  # no other file was written
    sinks.clear_namespace(spark, path, "index-1", "nobody")
    assert spark.read.parquet(path).count() == want.count()


def test_a_namespace_alone_in_its_bucket_is_cleared(spark, tmp_path):
    path = str(tmp_path / "store")
    sinks.append_chunks(_chunks(spark), path)
    sinks.clear_namespace(spark, path, "index-2", "user_1_notes")
    assert [r.namespace for r in spark.read.parquet(path).select("namespace").distinct().collect()] == ["user_2_notes"]


def test_csv_writers_keep_text(spark, tmp_path):
    df = spark.createDataFrame([(" a, \"b\"\n c ", "2024-01-01T00:00:00"), (None, "x")], "text string, date string")
    p = str(tmp_path / "c")
    sinks.write_text_date_csv(df, p)
    from chatlake.sources.csv import read_csv
    back = sorted(map(tuple, read_csv(spark, p, "text string, date string").collect()), key=str)
    assert back == sorted(map(tuple, df.collect()), key=str)


def test_streams_equal_batch(spark):
    q = entry.queries()
    for s, b in [("stream_modes", "mode_routing"), ("stream_quota_exact", "quota_24h")]:
        a = q[s](spark, SF001)
        c = q[b](spark, SF001).select(*a.columns)
        assert a.exceptAll(c).count() == 0 and c.exceptAll(a).count() == 0


def test_ingest_exports_stream_is_replay_safe(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    (src / "a.json").write_text(json.dumps({"name": "A", "messages": [
        {"id": 1, "type": "message", "date": "2024-01-01T00:00:00", "date_unixtime": "1704067200",
         "from": "x", "from_id": "u", "text": "hi"}]}))
    out = str(tmp_path / "out")
    ck = scratch_path(spark, "test_ingest_ckpt")
    st.ingest_exports(spark, str(src), out, ckpt=ck)
    st.ingest_exports(spark, str(src), out, ckpt=ck)  # same checkpoint: nothing new
    st.ingest_exports(spark, str(src), out)  # another checkpoint replays the file: the key drops it
    rows = spark.read.parquet(out).collect()
    assert [(r.chat_name, r.msg_content) for r in rows] == [("A", "hi")]


def test_ingest_exports_writes_rejects_and_cleans_its_source(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    (src / "bad.json").write_text('{"name": "x')
    (src / "odd.json").write_text('{"foo": 1}')
    out = str(tmp_path / "out")
    st.ingest_exports(spark, str(src), out, clean_source="delete")
    got = {(r.file.rsplit("/", 1)[-1], r.reason) for r in spark.read.parquet(out + "_rejects").collect()}
    assert got == {("bad.json", "invalid JSON"), ("odd.json", "unrecognised layout")}
    for k in (1, 2):  # a consumed file goes when a later batch has been finished
        (src / f"m{k}.json").write_text(json.dumps({"name": "A", "messages": [{"id": k, "type": "message", "text": "t"}]}))
        st.ingest_exports(spark, str(src), out, clean_source="delete")
    assert spark.read.parquet(out).count() == 2
    assert "bad.json" not in os.listdir(src)


def test_message_and_notes_csv(spark, tmp_path):
    msgs = spark.createDataFrame([(1, "a", "x\ny", "chat 1"), (2, None, "z", "chat 2")],
                                 "msg_id long, sender string, msg_content string, chat_name string")
    p = str(tmp_path / "m")
    assert sinks.write_messages_csv(msgs, p) == p
    stamp = sinks.stamp_of(spark, "2024-01-02 03:04:05")
    assert sinks.write_messages_csv(msgs, p, stamp=stamp) == f"{p}_2024-01-02_03-04-05" and os.path.isdir(f"{p}_{stamp}")
    assert sorted(x for x in os.listdir(p) if x.startswith("chat_name=")) == ["chat_name=chat 1", "chat_name=chat 2"]
    back = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(p)
    assert {(r.msg_id, r.msg_content) for r in back.collect()} == {("1", "x\ny"), ("2", "z")}
    notes = spark.createDataFrame([(7, 100, "n1", False), (7, 101, "n2", True)],
                                  "telegram_id long, telegram_message_id long, text string, is_vectorized boolean")
    q = str(tmp_path / "n")
    sinks.write_pending_notes_csv(notes, q)
    got = spark.read.option("header", True).csv(q).collect()
    assert [(r.telegram_id, r.message_id, r.text) for r in got] == [(7, "100", "n1")]
    assert [r.index_name for r in sinks.list_indexes(spark.createDataFrame(
        [("index-1", 1), ("index-1", 2)], "index_name string, x int")).collect()] == ["index-1"]


def test_csv_folders_are_written_by_number_and_large_ones_split(spark, tmp_path, monkeypatch):
    # tasks by the number of folders, however few bytes these hold; large folders and one without a name keep all rows
    rows = spark.range(600).selectExpr("nullif(id % 60, 7) AS k", "id", "'t' AS text")
    monkeypatch.setattr(sinks, "FOLDERS_A_TASK", 10)
    assert sinks._by_folder(rows, "k").rdd.getNumPartitions() == 7
    monkeypatch.setattr(sinks, "LARGE_FOLDER", 50)
    uneven = rows.union(spark.range(1000, 1200).selectExpr("nullif(id % 2, 1) AS k", "id", "'t' AS text"))
    p = sinks._csv_folders(uneven, "k", str(tmp_path / "f"), quoteAll=True)
    got = spark.read.option("header", True).csv(p).selectExpr("k", "cast(id AS bigint)", "text")
    assert sorted(map(str, got.collect())) == sorted(map(str, uneven.collect()))


def test_csv_folders_have_no_checksum_files_and_are_listed_by_few_tasks(spark, tmp_path):
    # a checksum file costs a process of its own; a listing task a folder is what Spark does by itself
    from chatlake.sources.csv import LISTING_TASKS, read_csv
    msgs = spark.range(100).selectExpr("id % 80 AS chat_name", "id AS msg_id", "concat('a \"', id, '\"') AS msg_content")
    p = sinks.write_messages_csv(msgs, str(tmp_path / "m"))
    notes = spark.range(4).selectExpr("id AS telegram_id", "id AS telegram_message_id", "'t' AS text", "false AS is_vectorized")
    q = sinks.write_pending_notes_csv(notes, str(tmp_path / "n"))
    names = [f for d in (p, q) for _, _, fs in os.walk(d) for f in fs]
    assert sum(f.endswith(".csv") for f in names) == 84 and not [f for f in names if f.endswith(".csv.crc")]
    key, sc = "spark.sql.sources.parallelPartitionDiscovery.parallelism", spark.sparkContext
    before = spark.conf.get(key)
    sc.setJobGroup("listing", "")
    back = read_csv(spark, p, "msg_id bigint, msg_content string, chat_name bigint")
    stages = [st_ for j in sc.statusTracker().getJobIdsForGroup("listing") for st_ in sc.statusTracker().getJobInfo(j).stageIds]
    assert stages and max(sc.statusTracker().getStageInfo(x).numTasks for x in stages) <= LISTING_TASKS and spark.conf.get(key) == before
    sc.setLocalProperty("spark.jobGroup.id", None)
    assert sorted(map(tuple, back.select("chat_name", "msg_id", "msg_content").collect())) == sorted((k % 80, k, f'a "{k}"') for k in range(100))


def test_replayed_micro_batch_is_written_once(spark, tmp_path):
    # foreachBatch is at-least-once: the same batch id written twice must leave one copy
    out = str(tmp_path / "log")
    b = spark.createDataFrame([(1, "a"), (2, "b")], "k long, v string")
    st.write_batch(b, out, 0)
    st.write_batch(b, out, 0)
    st.write_batch(b.limit(1), out, 1)
    got = spark.read.parquet(out)
    assert got.count() == 3 and sorted(r.batch_id for r in got.collect()) == [0, 0, 1]
    assert st.latest_rows(spark, out, ["k"]).count() == 2


def _one_file_each(df, folder, conditions):
    """Write the rows of each condition as one file ``ev<i>.parquet`` of ``folder``; the stream takes one a micro-batch, oldest first."""
    for i, cond in enumerate(conditions):
        df.where(cond).coalesce(1).write.parquet(str(folder / f"part{i}"))
        os.rename(next(p for p in (folder / f"part{i}").iterdir() if p.name.endswith(".parquet")), folder / f"ev{i}.parquet")


def test_mode_state_carries_across_micro_batches(spark, tmp_path):
    # four time-ordered files, one a micro-batch: a user's mode, also that of messages without a user, carries over
    from chatlake.operators import modes
    from tests.test_modes import SCHEMA, messages
    ev = spark.createDataFrame([r for r in messages(800, seed=5) if r[2] is not None], SCHEMA)
    folder, out = tmp_path / "events", str(tmp_path / "routed")
    bounds = ["2024-01-10 20:00:00", "2024-01-11 12:00:00", "2024-01-12 00:00:00"]
    t = F.col("ts")
    _one_file_each(ev, folder, [t < bounds[0], (t >= bounds[0]) & (t < bounds[1]), (t >= bounds[1]) & (t < bounds[2]), t >= bounds[2]])
    st.route_modes_stream(spark, st.file_stream(spark, str(folder), ev.schema, glob="ev*.parquet", max_files=1), out)
    got = spark.read.parquet(out)
    assert got.select("batch_id").distinct().count() == 4
    got = got.drop("batch_id")
    want = modes.route(ev).select(*got.columns)
    assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0
    assert got.where("user_id is null").select("mode_before").distinct().count() > 3
    state = spark.read.format("statestore").option("stateVarName", "mode").load(f"{out}_checkpoint")
    assert state.count() == ev.select("user_id").distinct().count()  # one row a user, whatever the number of messages


def test_messages_without_a_time_stay_in_the_mode_stream(spark, tmp_path):
    from chatlake.operators import modes
    from tests.test_modes import SCHEMA, messages
    ev = spark.createDataFrame(messages(300, seed=6), SCHEMA)
    ev.coalesce(1).write.parquet(str(tmp_path / "ev"))
    out = str(tmp_path / "out")
    st.route_modes_stream(spark, st.file_stream(spark, str(tmp_path / "ev"), ev.schema, glob="*.parquet"), out)
    got = spark.read.parquet(out).drop("batch_id")
    want = modes.route(ev).select(*got.columns)
    assert got.count() == 300 and got.exceptAll(want).count() == 0


def test_a_changed_export_at_a_known_path_is_ingested(spark, tmp_path):
    src, out = tmp_path / "in", str(tmp_path / "out")
    src.mkdir()

    def put(*texts):
        (src / "result.json").write_text(json.dumps({"name": "A", "messages": [{"id": k, "type": "message", "text": t} for k, t in enumerate(texts)]}))
    for n, texts in enumerate((["old", "same"], ["new", "same"], ["new", "same"])):
        put(*texts)
        st.ingest_exports(spark, str(src), out, ckpt=str(tmp_path / f"ck{n}"))
    assert sorted((r.pos, r.msg_content) for r in spark.read.parquet(out).collect()) == [(0, "new"), (0, "old"), (1, "same")]


def test_quota_stream_keeps_batches_without_times_and_users(spark, tmp_path):
    import datetime as dt
    from chatlake.operators import accounts as acc
    t = dt.datetime(2024, 1, 1)
    rows = [(0, 1, None, 0), (1, 1, None, 0), (2, None, None, 0), (3, 1, t, 1), (4, None, t, 1), (5, 1, None, 2), (6, None, t + dt.timedelta(hours=2), 2),
            (7, 1, t + dt.timedelta(hours=3), 2)]
    ev = spark.createDataFrame(rows, "event_id long, user_id long, ts timestamp, part int")
    folder, out = tmp_path / "ev", str(tmp_path / "out")
    _one_file_each(ev, folder, [F.col("part") == k for k in range(3)])
    stream = st.file_stream(spark, str(folder), ev.schema, glob="ev*.parquet", max_files=1)
    st.trailing_quota_batches(spark, stream.drop("part"), out, out + "_state")
    got = {r.event_id: (r.batch_id, r.prior_24h) for r in spark.read.parquet(out).collect()}
    # messages without a time count those that arrived before them, the rest those of the day before
    assert got == {0: (0, 1), 1: (0, 1), 2: (0, 0), 3: (1, 0), 4: (1, 0), 5: (2, 2), 6: (2, 1), 7: (2, 1)}
    assert acc.trailing_24h(ev).count() == len(rows)


def test_new_senders_are_stored_once_with_defaults(spark, tmp_path):
    schema = "user_id long, telegram_id long, username string, first_name string, last_name string"
    path = str(tmp_path / "users")
    st.write_users(spark.createDataFrame([(1, 1, "known", "K", "N")], schema), path)
    msgs = [(1, 1, "other", "O", "O"), (2, 2, None, "", None), (2, 2, None, "", None), (3, 3, "three", None, "L"), (None, None, "nobody", "x", "y")]
    df = spark.createDataFrame(msgs, schema)
    for n in range(2):  # the second stream has a checkpoint of its own and meets stored users only
        df.write.mode("overwrite").parquet(str(tmp_path / f"m{n}"))
        st.upsert_users_stream(spark, st.file_stream(spark, str(tmp_path / f"m{n}"), df.schema, glob="*.parquet"), path, ckpt=str(tmp_path / f"ck{n}"))
        got = sorted(tuple(r)[:5] for r in spark.read.parquet(path).select("telegram_id", "username", "first_name", "last_name").collect())
        assert got == [(1, "known", "K", "N"), (2, "there", "", ""), (3, "three", "", "L")]


def test_hourly_slices_give_the_sliding_windows(spark, tmp_path):
    ev = spark.read.parquet(f"{SF001}/events.parquet").select("user_id", "ts")
    folder, out = tmp_path / "ev", str(tmp_path / "out")
    _one_file_each(ev, folder, [F.col("ts") < "2024-01-15", F.col("ts") >= "2024-01-15"])
    stream = st.file_stream(spark, str(folder), ev.schema, glob="ev*.parquet", max_files=1)
    st.run_update_table(spark, st.hourly_counts(stream), out)
    log = spark.read.parquet(out)
    assert log.count() <= ev.count()  # an event updates one row
    got = st.daily_quota(st.latest_rows(spark, out, ["user_id", "slice"]))
    want = entry.queries()["stream_quota"](spark, SF001)
    assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0


def test_append_of_stored_chunks_adds_nothing(spark, tmp_path):
    path = str(tmp_path / "store")
    c = _chunks(spark)
    sinks.append_chunks(c, path)
    sinks.append_chunks(c.where(F.col("namespace") == "user_1_notes"), path)  # a re-import of user 1
    got = spark.read.parquet(path)
    assert got.count() == c.count() and got.select("namespace").distinct().count() == 2


def test_exact_quota_stream_counts_across_micro_batches(spark, tmp_path):
    # three time-ordered files, one per micro-batch: messages of the previous batch within 24 hours
    # must be counted, so the stream equals the batch trailing count over all messages
    from chatlake.operators import accounts as acc
    from chatlake.sources.tables import table
    ev = table(spark, SF001, "events").select("event_id", "user_id", "ts")
    folder = tmp_path / "ev"
    bounds = ["2024-01-08 12:00:00", "2024-01-18 06:30:00"]
    parts = [F.col("ts") < bounds[0], (F.col("ts") >= bounds[0]) & (F.col("ts") < bounds[1]), F.col("ts") >= bounds[1]]
    for i, cond in enumerate(parts):
        ev.where(cond).coalesce(1).write.parquet(str(folder / f"part{i}"))
        os.rename(next(p for p in (folder / f"part{i}").iterdir() if p.name.endswith(".parquet")),
                  folder / f"ev{i}.parquet")
    stream = st.file_stream(spark, str(folder), ev.schema, glob="ev*.parquet", max_files=1)
    out = str(tmp_path / "quota")
    st.trailing_quota_batches(spark, stream, out, out + "_state")
    got = spark.read.parquet(out)
    assert got.select("batch_id").distinct().count() == 3
    # each batch replaced only its own (day, batch) folders: all messages are still in the state
    assert spark.read.parquet(out + "_state").count() == ev.count()
    got = got.select("event_id", "user_id", "ts", "prior_24h", "within_quota")
    want = acc.trailing_24h(ev).select(*got.columns)
    assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0


def test_a_folder_table_streams_like_a_file(spark, tmp_path):
    q = entry.queries()
    for n in ("events", "documents", "customer"):
        spark.read.parquet(f"{SF001}/{n}.parquet").repartition(3).write.parquet(str(tmp_path / f"{n}.parquet"))
    for name in ("stream_users", "stream_modes", "stream_quota_exact"):
        a, b = q[name](spark, str(tmp_path)), q[name](spark, SF001)
        assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0 and a.count() > 0


def test_second_run_goes_on_where_the_first_ended(spark, tmp_path):
    from chatlake.operators import accounts as acc
    ev = spark.read.parquet(f"{SF001}/events.parquet").select("event_id", "user_id", "ts")
    folder, out = str(tmp_path / "ev"), str(tmp_path / "out")
    for k, half in enumerate((F.col("ts") < "2024-01-15", F.col("ts") >= "2024-01-15")):
        ev.where(half).write.mode("append").parquet(folder)
        st.trailing_quota_batches(spark, st.file_stream(spark, folder, ev.schema, glob="*.parquet"), out, out + "_state")
    got = spark.read.parquet(out).select("event_id", "user_id", "ts", "prior_24h", "within_quota")
    want = acc.trailing_24h(ev).select(*got.columns)
    assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0


def test_append_raises_on_an_unreadable_store(spark, tmp_path):
    import pytest
    from pyspark.errors import AnalysisException
    path = str(tmp_path / "store")
    spark.range(3).withColumn("index_name", F.lit("i")).withColumn("namespace", F.lit("n")).write.partitionBy("index_name", "namespace").parquet(path)
    with pytest.raises(AnalysisException):
        sinks.append_chunks(_chunks(spark), path)


def test_equal_chunk_ids_of_one_run_are_stored_once(spark, tmp_path):
    path = str(tmp_path / "store")
    c = _chunks(spark)
    sinks.append_chunks(c.unionAll(c), path)
    assert spark.read.parquet(path).count() == c.count()


def test_doubled_quotes_read_back_whole(spark, tmp_path):
    from chatlake.sources.csv import read_csv
    (tmp_path / "q.csv").write_text('text,date\n"say ""hi"", ok",2024\n"two\nlines",2025\nplain,2026\n')
    got = sorted(map(tuple, read_csv(spark, str(tmp_path / "q.csv"), "text string, date string").collect()))
    assert got == [("plain", "2026"), ('say "hi", ok', "2024"), ("two\nlines", "2025")]
