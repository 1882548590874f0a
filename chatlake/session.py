"""Session helpers: a tuned builder for local runs and the shared checkpoint folder."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession

# Settings that matter at any scale: AQE re-plans joins/partition counts at runtime,
# skew-join splits hot keys, timestamps are UTC so results match the SQL oracle.
DEFAULT_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    # Upper bound for a broadcast side; sizes are measured before a broadcast is chosen.
    "spark.sql.autoBroadcastJoinThreshold": str(64 * 1024 * 1024),
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def build_session(master: str | None = None, shuffle_partitions: int | None = None,
                  app_name: str = "chatlake", extra: dict | None = None) -> SparkSession:
    """Create (or reuse) a session. On a cluster pass ``master=None`` and let spark-submit decide."""
    b = SparkSession.builder.appName(app_name)
    if master:
        b = b.master(master)
    conf = dict(DEFAULT_CONF)
    if master and master.startswith("local"):
        # local mode runs everything (tasks, state stores, broadcasts) in the driver JVM; the 1 GB
        # default heap ends in long GC pauses. On a cluster the deployment sizes the JVMs.
        conf["spark.driver.memory"] = "8g"
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by ``spark.checkpoint.dir``.

    On a cluster this setting names a shared (distributed) folder and is used as is. When it is
    unset, the SparkContext's checkpoint folder is used if one was set; only when neither exists
    (a local run) a scratch folder is created and registered with ``setCheckpointDir`` -- the
    ``spark.checkpoint.dir`` setting itself cannot be changed at runtime. With a cluster master and no folder it raises.
    """
    d = spark.conf.get("spark.checkpoint.dir", None)
    try:
        sc = spark.sparkContext
    except Exception:  # remote session: no SparkContext here
        sc = None
    if d:
        if sc is not None and sc.getCheckpointDir() is None:
            sc.setCheckpointDir(d)
        return d
    current = sc.getCheckpointDir() if sc is not None else None
    if current:
        return current
    if not spark.conf.get("spark.master", "local").startswith("local") or spark.conf.get("spark.master", "local").startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    d = tempfile.mkdtemp(prefix="chatlake-ckpt-")
    if sc is not None:
        sc.setCheckpointDir(d)
        return sc.getCheckpointDir() or d  # the same folder on every later call
    return d


def scratch_path(spark: SparkSession, name: str) -> str:
    """A path for an intermediate table under the shared checkpoint folder."""
    base = ensure_checkpoint_dir(spark)
    return os.path.join(base, name)


def materialize(df, name: str):
    """Write an intermediate table under the shared checkpoint folder and read it back.

    Used where one expensive intermediate feeds several branches (it is computed once) and to
    cut lineage: after an executor loss only the work after this table is redone.
    """
    import uuid

    spark = df.sparkSession
    path = scratch_path(spark, f"tables/{name}-{uuid.uuid4().hex}")
    df.write.mode("overwrite").parquet(path)
    return spark.read.schema(df.schema).parquet(path)  # known schema: no footer-reading job


def _row_bytes(schema) -> int:
    """Estimated bytes of one row held in a broadcast hash relation (Spark's default sizes)."""
    from pyspark.sql import types as T
    size = 8  # row header
    for f in schema.fields:
        t = f.dataType
        if isinstance(t, (T.StringType, T.BinaryType)):
            size += 8 + 20
        elif isinstance(t, (T.ByteType, T.ShortType, T.IntegerType, T.FloatType, T.DateType, T.BooleanType)):
            size += 8
        else:
            size += 8 if not isinstance(t, (T.ArrayType, T.MapType, T.StructType)) else 8 + 64
    return size


def broadcast_fits(table, max_bytes: int | None = None) -> bool:
    """True when ``table`` (a written, re-read table) measures under the broadcast bound.

    The estimate is the larger of (row count from the footers x Spark's per-row size) and three
    times the files' size; the bound is ``spark.sql.autoBroadcastJoinThreshold`` unless ``max_bytes``
    is given (a negative threshold disables broadcasting).
    """
    spark = table.sparkSession
    limit = max_bytes if max_bytes is not None else _parse_bytes(
        spark.conf.get("spark.sql.autoBroadcastJoinThreshold"))
    if limit <= 0:
        return False
    estimate = table.count() * _row_bytes(table.schema)
    try:  # the written files' size covers long strings and arrays (vectors) the row estimate misses
        disk = int(table._jdf.queryExecution().optimizedPlan().stats().sizeInBytes().toString())
        estimate = max(estimate, 3 * disk)
    except Exception:  # no JVM handle (remote session): the row estimate alone
        pass
    return estimate <= limit


def bounded_broadcast(df, name: str, max_bytes: int | None = None):
    """Write ``df`` to the shared folder, measure it, and broadcast it only if it fits.

    Beyond the bound the table is hinted to a shuffle (sort-merge) join, so a large side is never
    broadcast on an estimate. Returns ``(table, broadcast_chosen)``.
    """
    from pyspark.sql import functions as F

    t = materialize(df, name)
    if broadcast_fits(t, max_bytes):
        return F.broadcast(t), True
    return t.hint("shuffle_merge"), False


def _parse_bytes(v: str) -> int:
    v = v.strip().lower()
    units = {"k": 1 << 10, "m": 1 << 20, "g": 1 << 30, "t": 1 << 40}
    v = v[:-1] if v.endswith("b") and len(v) > 1 and not v[-2].isdigit() else v
    if v and v[-1] in units:
        return int(float(v[:-1]) * units[v[-1]])
    return int(v.rstrip("b"))


def ship_package(spark: SparkSession) -> None:
    """Make ``chatlake`` importable in the Python workers (``addPyFile`` of a zipped copy).

    Needed only where Python runs on the executors (pandas UDFs, grouped state). Done once per
    SparkContext; the zip is written under the shared checkpoint folder.
    """
    import shutil

    sc = spark.sparkContext
    if getattr(sc, "_chatlake_shipped", False):
        return
    pkg = os.path.dirname(os.path.abspath(__file__))
    base = scratch_path(spark, "pyfiles")
    if "://" not in base or base.startswith("file:"):
        local_base = base.replace("file:", "")
        os.makedirs(local_base, exist_ok=True)
        archive = shutil.make_archive(os.path.join(local_base, "chatlake"), "zip",
                                      root_dir=os.path.dirname(pkg), base_dir="chatlake")
    else:  # remote shared folder: build locally on the driver, addPyFile uploads it
        archive = shutil.make_archive(os.path.join(tempfile.mkdtemp(), "chatlake"), "zip",
                                      root_dir=os.path.dirname(pkg), base_dir="chatlake")
    sc.addPyFile(archive)
    sc._chatlake_shipped = True
