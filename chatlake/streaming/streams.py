"""Structured Streaming jobs (STR1-5).

Every job is a ``readStream`` over a folder of files, a DataFrame transformation, and an
idempotent sink: micro-batches go through ``foreachBatch`` into tables whose writes are
keyed (anti join on a deterministic key), so a batch replayed after an executor or driver
failure adds nothing twice. Checkpoints live under the shared ``spark.checkpoint.dir``.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from chatlake.operators import accounts as acc
from chatlake.operators import chunks as ch
from chatlake.operators import modes, scan
from chatlake.session import scratch_path, ship_package
from chatlake.sources import exports as ex
from chatlake.sources.tables import stored


def _ckpt(out_path: str) -> str:
    """The checkpoint that belongs to an output: a second run goes on where the first one ended."""
    return f"{out_path.rstrip('/')}_checkpoint"


MAX_FILES = 1000  # files of one micro-batch unless the caller says otherwise


def file_stream(spark: SparkSession, folder: str, schema, glob: str | None = None,
                fmt: str = "parquet", max_files: int = MAX_FILES) -> DataFrame:
    """A file-folder stream with an explicit schema; ``glob`` picks files inside the folder."""
    r = spark.readStream.format(fmt).schema(schema).option("maxFilesPerTrigger", max_files)
    if glob:
        r = r.option("pathGlobFilter", glob)
    return r.load(folder)


def table_stream(spark: SparkSession, path: str, schema, max_files: int = MAX_FILES) -> DataFrame:
    """A parquet table as a stream, whether it is stored as one file or as a folder of files."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    if p.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(p).isDirectory():
        return file_stream(spark, path, schema, glob="*.parquet", max_files=max_files)
    return file_stream(spark, os.path.dirname(path), schema, glob=os.path.basename(path), max_files=max_files)


def run_available(writer, ckpt: str) -> None:
    """Process everything available now, then stop (``trigger(availableNow=True)``)."""
    q = writer.option("checkpointLocation", ckpt).trigger(availableNow=True).start()
    q.awaitTermination()
    if q.exception():
        raise q.exception()


# ---------------------------------------------------------------- STR1: export ingest

FILE_BUCKETS = 64  # hash buckets of the source file that partition the ingested messages
PIECE = 1 << 16  # messages of one chat that are written by one task


def ingest_exports(spark: SparkSession, in_folder: str, out_path: str, clean_source: str | None = None,
                   ckpt: str | None = None, multi_line: bool = True, max_files: int = MAX_FILES) -> None:
    """STR1 + SRC3 + SRC5: parse each export file as it arrives, append its messages to ``out_path`` and
    write broken or unknown exports (file, reason) to ``<out_path>_rejects``.

    ``clean_source='archive'|'delete'`` removes consumed files (done by a later batch);
    ``multi_line=False`` reads JSON lines, one export each.
    """
    options = {"maxFilesPerTrigger": max_files}
    if clean_source:
        options["cleanSource"] = clean_source
        if clean_source == "archive":
            options["sourceArchiveDir"] = scratch_path(spark, "export_archive")
    raw = ex.with_layout(ex.stream_exports(spark, in_folder, options, multi_line))
    key = ["file", "chat_idx", "pos", "digest"]

    def sink(batch: DataFrame, batch_id: int) -> None:
        # A message read again by a replayed batch (or a new checkpoint) is dropped by its key: file, place and
        # what it says, so an export that changed at a known path adds its changed messages. The output is partitioned
        # by a fixed hash bucket of the file: only the folders of this batch's files are read (by path), then semi-joined to them.
        batch = batch.withColumn("file_bucket", F.pmod(F.xxhash64("file"), F.lit(FILE_BUCKETS)).cast("int"))
        batch = batch.persist()  # read several times; recomputed from the files if an executor is lost
        try:
            write_batch(ex.rejects_of(batch), f"{out_path}_rejects", batch_id)
            good = batch.where(~F.col("layout").isin("invalid", "unknown"))
            buckets = sorted(r[0] for r in good.select("file_bucket").distinct().collect())  # <= 64 numbers
            if not buckets:
                return
            new = ex.project_messages(ex.explode_messages(ex.explode_chats(good)))
            new = new.withColumns({"file_bucket": F.pmod(F.xxhash64("file"), F.lit(FILE_BUCKETS)).cast("int"),
                                   "digest": F.xxhash64(F.to_json(F.struct("chat_name", *ex.MESSAGE_COLUMNS)))})
            old = stored(spark, f"{out_path}/file_bucket={{{','.join(str(b) for b in buckets)}}}", basePath=out_path)
            if old is not None:
                done = old.select(*key).join(good.select("file").distinct(), "file", "left_semi")
                new = new.join(done, key, "left_anti")
            new.repartition("file_bucket", "chat_idx", F.floor(F.col("pos") / PIECE)).write.mode("append").partitionBy("file_bucket").parquet(out_path)
        finally:
            batch.unpersist()

    run_available(raw.writeStream.foreachBatch(sink), ckpt or _ckpt(out_path))


# ---------------------------------------------------------------- STR2: incremental indexing

def index_notes_stream(spark: SparkSession, notes: DataFrame, store_path: str, separator: str = "\n\n",
                       embed_fn=None, ckpt: str | None = None) -> None:
    """STR2: every new note is chunked (and embedded, when ``embed_fn`` is given) and appended
    to the store (``sinks.append_chunks``). The checkpoint replaces the 'indexed'
    flag; deterministic chunk ids make a replayed batch a no-op."""
    def sink(batch: DataFrame, batch_id: int) -> None:
        batch = batch.persist()  # chunked and used for the touched namespaces; recomputed if lost
        try:
            _index_batch(batch)
        finally:
            batch.unpersist()

    def _index_batch(batch: DataFrame) -> None:
        from chatlake.sources.sinks import append_chunks
        from chatlake.sources.tables import spread
        # chunk inside the batch: a small batch read by one task is spread over the cores first
        notes_b = spread(batch, "telegram_message_id")
        c = ch.chunk_documents(notes_b, id_cols=("user_id", "telegram_message_id"), separator=separator,
                               keep_cols=("namespace", "index_name"))
        c = c.withColumn("chunk_id", ch.chunk_id("namespace", "telegram_message_id", "chunk_idx", "chunk"))
        if embed_fn is not None:
            c = embed_fn(c)
        append_chunks(c, store_path)

    run_available(notes.writeStream.foreachBatch(sink), ckpt or _ckpt(store_path))


# ---------------------------------------------------------------- STR4: users from the stream

USER_BUCKETS = 64  # hash buckets of the telegram id that partition the users table
USER_DEFAULTS = {"username": "there", "first_name": "", "last_name": ""}  # fixed values


def user_bucket(telegram_id):
    return F.pmod(F.xxhash64(telegram_id), F.lit(USER_BUCKETS)).cast("int")


def write_users(users: DataFrame, path: str) -> None:
    """A users table partitioned by the telegram id's bucket, one file a bucket."""
    users.withColumn("bucket", user_bucket("telegram_id")).repartition("bucket").write.partitionBy("bucket").parquet(path)


def upsert_users_stream(spark: SparkSession, messages: DataFrame, users_path: str, ckpt: str | None = None, remember: str = "1 hour") -> None:
    """STR4 + JN3: senders in the message stream (user_id, telegram_id, username, first_name, last_name) are inserted once; names they lack get
    the defaults, and what is stored of a user stays.

    A sender passes once while it is remembered: the stream drops repeats within ``remember`` of *arrival* (its watermark is the
    arrival time, so no message is late and the state stays bounded). What is left meets only the users of its buckets, by a partition
    filter; a replayed batch finds its users stored. Messages without a sender add nobody.
    """
    incoming = (messages.where("telegram_id is not null").withColumn("_seen", F.current_timestamp()).withWatermark("_seen", remember)
                .dropDuplicatesWithinWatermark(["telegram_id"]).drop("_seen"))
    names = {c: F.coalesce(F.nullif(F.col(c), F.lit("")), F.lit(d)) for c, d in USER_DEFAULTS.items()}
    incoming = incoming.select("user_id", "telegram_id", *(v.alias(k) for k, v in names.items()))

    def sink(batch: DataFrame, batch_id: int) -> None:
        batch = batch.withColumn("bucket", user_bucket("telegram_id")).persist()  # read twice; recomputed from the source if lost
        try:
            touched = sorted(r[0] for r in batch.select("bucket").distinct().collect())  # at most USER_BUCKETS numbers
            old = stored(spark, users_path)
            if old is not None:
                batch = batch.join(old.where(F.col("bucket").isin(touched)).select("bucket", "telegram_id"), ["bucket", "telegram_id"], "left_anti")
            batch.repartition("bucket").write.mode("append").partitionBy("bucket").parquet(users_path)
        finally:
            batch.unpersist()

    run_available(incoming.writeStream.foreachBatch(sink), ckpt or _ckpt(users_path))


# ---------------------------------------------------------------- STR5: daily quota

def hourly_counts(messages: DataFrame, key: str = "user_id", ts: str = "ts", watermark: str = "1 day", slide: str = "1 hour") -> DataFrame:
    """STR5, the stateful part: messages per user and slice; an event updates one state row.

    Late rule: rows more than ``watermark`` behind the latest time are dropped (the reference has no rule of its own).
    """
    # event time must be TIMESTAMP (zone-aware); wall-clock NTZ values are read in the session zone
    return (messages.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, watermark)
            .groupBy(key, F.window(ts, slide).alias("w")).agg(F.count(F.lit(1)).alias("n")).select(key, F.col("w.start").alias("slice"), "n"))


def daily_quota(slices: DataFrame, key: str = "user_id", hours: int = 24) -> DataFrame:
    """STR5: messages per user in sliding windows of ``hours`` slices, from the newest count of each slice (batch or read from the stream's log)."""
    starts = F.sequence(F.col("slice") - F.make_dt_interval(hours=F.lit(hours - 1)), F.col("slice"), F.expr("INTERVAL 1 HOUR"))
    return (slices.select(key, "n", F.explode(starts).alias("start")).groupBy(key, "start").agg(F.sum("n").alias("n_messages"))
            .select(key, F.col("start").cast("timestamp_ntz").alias("window_start"),
                    (F.col("start") + F.make_dt_interval(hours=F.lit(hours))).cast("timestamp_ntz").alias("window_end"), "n_messages",
                    (F.col("n_messages") <= acc.QUOTA_MESSAGES).alias("within_quota")))


def write_batch(batch: DataFrame, out_path: str, batch_id: int) -> None:
    """Write one micro-batch into its own ``batch_id=N`` folder, replacing what is there.

    ``foreachBatch`` is at-least-once: a batch replayed after a failure has the same id and the
    same rows, so overwriting its folder makes the replay a no-op instead of a duplicate.
    Reading ``out_path`` gives the rows with a ``batch_id`` column (partition discovery).
    """
    batch.write.mode("overwrite").parquet(f"{out_path}/batch_id={batch_id}")


NO_DAY = "none"  # the state folder of messages without a time


def trailing_quota_batches(spark: SparkSession, messages: DataFrame, out_path: str, state_path: str,
                           key: str = "user_id", ts: str = "ts", ckpt: str | None = None) -> None:
    """STR5, exact form (WIN1 + FLT8 per message): messages of the same user in the 24 hours
    before each message, counted over everything that arrived so far.

    Each micro-batch is counted with the skew-safe trailing window (``accounts.trailing_24h``)
    over the batch plus, as context only, the earlier batches' messages of its users from the
    preceding day. The state is the messages themselves, partitioned by (day, batch_id) and written
    with dynamic partition overwrite (a replay replaces its own folders). A batch reads only the
    day folders from one day before its earliest message to its latest one (a partition filter),
    then filters by time and semi-joins to its users. Messages without a time, which count among themselves, have a folder of
    their own that is read only by batches with such messages; a null user is a user like any other.
    """
    cols = list(messages.columns)
    t = F.col(ts).cast("timestamp")

    def sink(batch: DataFrame, batch_id: int) -> None:
        batch = batch.persist()  # read several times below; recomputed from the source if lost
        try:
            _count_batch(batch, batch_id)
        finally:
            batch.unpersist()

    def _count_batch(batch: DataFrame, batch_id: int) -> None:
        span = batch.agg(  # two short texts and a flag to the driver: the time range the context must cover
            F.date_format(F.min(t) - F.expr("INTERVAL 1 DAY"), "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("since"),
            F.date_format(F.max(t), "yyyy-MM-dd").alias("last"), F.coalesce(F.bool_or(t.isNull()), F.lit(False)).alias("timeless")).first()
        rows = batch.withColumn("_cur", F.lit(True))
        hist = stored(spark, state_path)
        if hist is not None:  # the day folders of the range are a partition filter
            inside = F.lit(False)
            if span["since"] is not None:
                inside = F.col("day").cast("string").between(span["since"][:10], span["last"]) & (t >= F.lit(span["since"]).cast("timestamp"))
            if span["timeless"]:
                inside = inside | (F.col("day").cast("string") == NO_DAY)
            users = batch.select(F.col(key).alias("_k")).distinct()
            ctx = (hist.where((F.col("batch_id") < batch_id) & inside).select(*cols)
                   .join(users, F.col(key).eqNullSafe(F.col("_k")), "left_semi"))
            rows = rows.unionByName(ctx.withColumn("_cur", F.lit(False)))
        counted = acc.trailing_24h(rows, key, ts).where("_cur").drop("_cur")
        write_batch(counted, out_path, batch_id)
        (batch.select(*cols).withColumn("day", F.coalesce(F.date_format(t, "yyyy-MM-dd"), F.lit(NO_DAY)))
         .withColumn("batch_id", F.lit(batch_id))
         .write.option("partitionOverwriteMode", "dynamic").mode("overwrite")
         .partitionBy("day", "batch_id").parquet(state_path))

    run_available(messages.writeStream.foreachBatch(sink), ckpt or _ckpt(out_path))


def run_update_table(spark: SparkSession, agg: DataFrame, out_path: str, ckpt: str | None = None) -> None:
    """Run an aggregate in update mode; every batch writes its changed rows under its batch id."""
    def sink(batch: DataFrame, batch_id: int) -> None:
        write_batch(batch, out_path, batch_id)

    run_available(agg.writeStream.outputMode("update").foreachBatch(sink), ckpt or _ckpt(out_path))


def latest_rows(spark: SparkSession, path: str, keys) -> DataFrame:
    """The newest version of each key in an update log (max batch id per key)."""
    d = spark.read.parquet(path)
    rest = [c for c in d.columns if c not in keys and c != "batch_id"]
    # one pass, partial aggregate per key: the row of the newest batch wins
    return (d.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch_id").alias("_row"))
            .select(*keys, "_row.*"))


# ---------------------------------------------------------------- STR3: mode routing with state

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class _ModeProcessor(StatefulProcessor):
    """A user's mode as value state: the messages of a micro-batch in time order, each through its own transition."""

    def init(self, handle) -> None:
        self.mode = handle.getValueState("mode", "number int")

    def handleInputRows(self, key, rows, timerValues):
        import pandas as pd

        part = pd.concat(list(rows), ignore_index=True).set_axis(["_user", "_at", "_tie", "_fn", "_command"], axis=1)  # Spark hands them over by place
        part = part.sort_values(["_at", "_tie"], kind="stable")
        state = self.mode.get()[0] if self.mode.exists() else 0
        before = []
        for fn in part["_fn"].tolist():
            before.append(state)
            state = (fn >> (scan.BITS * state)) & (2 ** scan.BITS - 1)
        self.mode.update((state,))
        yield pd.DataFrame({"_user": key[0], "_at": part["_at"].to_numpy(), "_tie": part["_tie"].to_numpy(),
                            "_fn": part["_fn"].to_numpy(), "_command": part["_command"].to_numpy(), "_before": before})

    def close(self) -> None:
        pass


def routed_modes(messages: DataFrame, key: str = "user_id", ts: str = "ts", tie: str = "event_id", command: str = "command") -> DataFrame:
    """STR3: each message of a stream with its user's mode before and after it (key, ts, tie, command, mode_before, mode_after).

    The transitions, with their guards, are computed by SQL (``modes.transition``); the mode is Spark's own state per user, so
    a batch reads and writes the users it meets and a replay starts from the state before it. Messages are taken in time order
    inside a micro-batch and in arrival order across batches; a micro-batch (``maxFilesPerTrigger``) bounds what one user's task holds, five
    numbers a message. Messages without a user are those of one user; those without a time come first.
    """
    dtype = messages.schema[ts].dataType.simpleString()
    least = F.lit(-2 ** 62)
    # the state's key is a text that is never null: groups of a null key run into their neighbours in this operator
    user = F.coalesce(F.concat(F.lit("u"), F.col(key).cast("string")), F.lit(""))
    rows = messages.select(user.alias("_user"), F.coalesce(F.unix_micros(F.col(ts).cast("timestamp")), least).alias("_at"),
                           F.col(tie).cast("long").alias("_tie"), modes.transition(messages, command).alias("_fn"), F.col(command).alias("_command"))
    ship_package(messages.sparkSession)
    out = rows.groupBy("_user").transformWithStateInPandas(
        _ModeProcessor(), "_user string, _at long, _tie long, _fn long, _command string, _before int", "update", "none")
    named = F.when(F.col("_user") != "", F.substr("_user", F.lit(2))).cast(messages.schema[key].dataType)
    return out.select(named.alias(key), F.when(F.col("_at") != least, F.timestamp_micros("_at")).cast(dtype).alias(ts), F.col("_tie").alias(tie),
                      F.col("_command").alias(command), modes.name(F.col("_before")).alias("mode_before"),
                      modes.name(scan.apply(F.col("_fn"), F.col("_before"))).alias("mode_after"))


def route_modes_stream(spark: SparkSession, messages: DataFrame, out_path: str, key: str = "user_id", ts: str = "ts", tie: str = "event_id",
                       ckpt: str | None = None) -> None:
    """STR3 run to its end into ``out_path``, one folder a micro-batch; state in RocksDB, which keeps it off the heap."""
    def sink(batch: DataFrame, batch_id: int) -> None:
        write_batch(batch, out_path, batch_id)

    setting = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(setting)
    spark.conf.set(setting, ROCKSDB)  # what a query starts with stays in its checkpoint
    try:
        run_available(routed_modes(messages, key, ts, tie).writeStream.outputMode("update").foreachBatch(sink), ckpt or _ckpt(out_path))
    finally:
        spark.conf.set(setting, before)
