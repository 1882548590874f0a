"""Skew-safe running windows: split each key's history into time buckets.

A per-key window over the whole history puts a hot key (say a third of all rows) in one
task. Here every window is partitioned by (key, bucket); what crosses bucket borders is
carried by a small per-(key, bucket) summary with one row per bucket, windowed per key and
equi-joined back. Results are exact; only the task granularity changes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _join_back(rows: DataFrame, summary: DataFrame, keys) -> DataFrame:
    """Equi-join on the keys that also matches nulls (a null key or time is a key like any other)."""
    renamed = summary.withColumnsRenamed({k: f"_s_{k}" for k in keys})
    on = [rows[k].eqNullSafe(renamed[f"_s_{k}"]) for k in keys]
    return rows.join(renamed, on).drop(*(f"_s_{k}" for k in keys))


def running_sum(df: DataFrame, keys, order_cols, value: str, bucket: Column, out: str,
                first_of: str | None = None) -> DataFrame:
    """``out`` = sum of ``value`` over all earlier-or-equal rows of the key (rows frame).

    The bucket totals are a partial aggregate of the input (one row per key and bucket crosses
    the shuffle), windowed per key; only the row window shuffles the full data. ``first_of`` also
    adds ``first_<col>``: the key's minimum of that column, from the same small summary.
    """
    keys = list(keys)
    d = df.withColumn("_bucket", bucket)
    inner = F.sum(value).over(Window.partitionBy(*keys, "_bucket").orderBy(*order_cols)
                              .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    w_in = d.withColumn("_inner", inner)
    aggs = [F.sum(value).alias("_bt")]
    if first_of:
        aggs.append(F.min(first_of).alias("_bmin"))
    summary = d.groupBy(*keys, "_bucket").agg(*aggs)
    before = F.coalesce(F.sum("_bt").over(Window.partitionBy(*keys).orderBy("_bucket")
                                          .rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    cols = [*keys, "_bucket", before.alias("_before")]
    if first_of:
        cols.append(F.min("_bmin").over(Window.partitionBy(*keys)).alias(f"first_{first_of}"))
    summary = summary.select(*cols)
    return (_join_back(w_in, summary, [*keys, "_bucket"])
            .withColumn(out, F.col("_before") + F.col("_inner")).drop("_bucket", "_inner", "_before"))


def carry_forward(df: DataFrame, keys, order_cols, value: str, bucket: Column, out: str,
                  include_current: bool = True) -> DataFrame:
    """``out`` = last non-null ``value`` of the key up to this row (or strictly before it).

    Each bucket's last non-null value is a partial aggregate of the input (max of an ordered
    struct), windowed per key over one row per bucket; only the row window shuffles the full data.
    """
    keys = list(keys)
    d = df.withColumn("_bucket", bucket)
    end = Window.currentRow if include_current else -1
    inner = F.last(value, ignorenulls=True).over(
        Window.partitionBy(*keys, "_bucket").orderBy(*order_cols).rowsBetween(Window.unboundedPreceding, end))
    w_in = d.withColumn("_inner", inner)
    ordered = F.struct(*[F.col(c) for c in order_cols], F.col(value).alias("_v"))
    summary = (d.groupBy(*keys, "_bucket")
               .agg(F.max(F.when(F.col(value).isNotNull(), ordered)).getField("_v").alias("_last")))
    prev = F.last("_last", ignorenulls=True).over(
        Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1))
    summary = summary.select(*keys, "_bucket", prev.alias("_prev"))
    return (_join_back(w_in, summary, [*keys, "_bucket"])
            .withColumn(out, F.coalesce("_inner", "_prev")).drop("_bucket", "_inner", "_prev"))


def trailing_count(df: DataFrame, keys, ts: str, window_micros: int, out: str, slices: int = 24) -> DataFrame:
    """Rows of the same key with time in [ts - window, ts] (closed at both ends), per row.

    The window is cut into ``slices`` (hours of a day). Whole slices between a row's own and the window's first are counted by a partial
    aggregate, one row per (key, slice), and summed over a small window; only the two boundary slices are row work: a row meets its own
    slice, and its time alone (the other columns are left out) meets the rows one window later. So one exchange moves the rows, partitioned by (key,
    slice): a hot key is spread over its hours. Time is compared in microseconds. Rows without a time count among themselves only.
    """
    keys, names = list(keys), df.columns
    width = window_micros // slices
    if width * slices != window_micros:
        raise ValueError("the window must be a whole number of slices")
    us = F.unix_micros(F.col(ts).cast("timestamp"))
    own = F.struct(F.floor(us / width).alias("b"), us.alias("at"), F.lit(0).alias("kind"))
    later = F.struct(F.floor(us / width + slices).alias("b"), (us + window_micros).alias("at"), F.lit(1).alias("kind"))
    copies = F.explode(F.when(us.isNull(), F.array(own)).otherwise(F.array(own, later)))
    rows = df.withColumn("_c", copies).select(
        *((F.col(c) if c in keys else F.when(F.col("_c.kind") == 0, F.col(c)).alias(c)) for c in names), "_c.b", "_c.at", "_c.kind", F.lit(0).cast("long").alias("_whole"))
    rows = rows.toDF(*names, "_b", "_at", "_kind", "_whole")
    counts = df.where(us.isNotNull()).groupBy(*keys, F.floor(us / width).alias("_b")).agg(F.count(F.lit(1)).alias("_n"))
    # a count serves the slices behind it: each slice with rows gets the sum of the slices - 1 whole ones before it
    between = Window.partitionBy(*keys).orderBy("_b").rangeBetween(-(slices - 1), -1)
    whole = counts.select(*keys, "_b", F.lit(2).alias("_kind"), F.coalesce(F.sum("_n").over(between), F.lit(0)).alias("_whole"))
    both = rows.unionByName(whole, allowMissingColumns=True)
    part = Window.partitionBy(*keys, "_b").orderBy("_at")
    upto, behind = part.rangeBetween(Window.unboundedPreceding, Window.currentRow), part.rangeBetween(Window.currentRow, Window.unboundedFollowing)
    every = part.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    kind = lambda k: F.when(F.col("_kind") == k, 1)
    n = F.count(kind(0)).over(upto) + F.count(kind(1)).over(behind) + F.max("_whole").over(every)
    return both.withColumn(out, n).where("_kind = 0").select(*names, out)
