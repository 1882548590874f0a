from pyspark.sql import functions as F

from chatlake.session import bounded_broadcast, broadcast_fits, materialize


def test_broadcast_only_under_the_measured_bound(spark):
    df = spark.range(1000).select(F.col("id").alias("k"), F.sha2(F.col("id").cast("string"), 256).alias("v"))
    t = materialize(df, "bound_probe")
    assert broadcast_fits(t, max_bytes=10 * 1024 * 1024)
    assert not broadcast_fits(t, max_bytes=10 * 1024)  # 1000 rows of a 64-character string do not fit
    assert not broadcast_fits(t, max_bytes=-1)  # a disabled threshold never broadcasts
    small, chosen = bounded_broadcast(df, "bound_probe_small", max_bytes=10 * 1024 * 1024)
    big, not_chosen = bounded_broadcast(df, "bound_probe_big", max_bytes=10 * 1024)
    assert chosen and not not_chosen
    probe = spark.range(2000).select(F.col("id").alias("k"))
    assert "BroadcastHashJoin" in probe.join(small, "k")._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in probe.join(big, "k")._jdf.queryExecution().executedPlan().toString()


def test_checkpoint_folder_when_the_setting_is_unset():
    # spark.checkpoint.dir cannot be set at runtime: an unset session falls back to the context's
    # checkpoint folder, or registers a scratch folder with setCheckpointDir (local runs only)
    from chatlake.session import ensure_checkpoint_dir

    class Conf:
        def get(self, key, default=None):
            return default

    class Context:
        def __init__(self, current):
            self.current = current

        def getCheckpointDir(self):
            return self.current

        def setCheckpointDir(self, d):
            self.current = d + "/app"

    class Session:
        def __init__(self, current):
            self.conf, self.sparkContext = Conf(), Context(current)

    assert ensure_checkpoint_dir(Session("file:/shared/ckpt/app")) == "file:/shared/ckpt/app"
    fresh = Session(None)
    d = ensure_checkpoint_dir(fresh)
    assert d.endswith("/app") and fresh.sparkContext.current == d
