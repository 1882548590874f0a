"""Running composition of small functions: a prefix scan that splits a hot key.

A row carries a function over a few states, packed into one long (``bits`` bits a state). Composition is associative, so rows are
range-sorted by (key, order) -- a key with a third of all rows simply spans many partitions --, every partition composes its
own rows, and only the keys that span several partitions pass one function per partition on. Those are at most two rows a partition.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chatlake.session import bounded_broadcast, materialize, ship_package

BITS = 3


def pack(images: list[Column]) -> Column:
    """The function that sends state i to ``images[i]`` (whole numbers below 2**BITS)."""
    out = F.lit(0).cast("long")
    for state, image in enumerate(images):
        out = out.bitwiseOR(F.shiftleft(image.cast("long"), BITS * state))
    return out


def apply(function: Column, state: Column) -> Column:
    """The state that ``function`` sends ``state`` to."""
    return F.call_function("shiftright", function, (state * BITS).cast("int")).bitwiseAND(F.lit(2 ** BITS - 1).cast("long")).cast("int")


def _same_as_before(keys: pa.Array) -> np.ndarray:
    """For each place but the first: is the key that of the place before it? Nulls equal each other."""
    a, b = keys.slice(0, len(keys) - 1), keys.slice(1)
    same = pc.or_(pc.fill_null(pc.equal(a, b), False), pc.and_(pc.is_null(a), pc.is_null(b)))
    return same.to_numpy(zero_copy_only=False)


def compose_runs(functions: np.ndarray, run: np.ndarray) -> np.ndarray:
    """Inclusive composition (rows x states) inside each run of equal numbers in ``run``, by doubling."""
    out, shift = functions, 1
    longest = np.bincount(run).max(initial=0)
    while shift < longest:
        at = np.flatnonzero(run[shift:] == run[:-shift])
        new = out.copy()
        new[at + shift] = np.take_along_axis(out[at + shift], out[at], 1)
        out, shift = new, 2 * shift
    return out


def _scan_partitions(rows: DataFrame, key: str, fn: str, states: int) -> DataFrame:
    """``rows`` (sorted inside their partitions) with ``_part``, ``_n`` (place in it) and ``_local``: what the partition's earlier
    rows of the same key compose to."""
    schema = T.StructType([*rows.schema.fields, T.StructField("_part", T.IntegerType()), T.StructField("_n", T.LongType()),
                           T.StructField("_local", T.LongType())])
    names, shifts = schema.names, np.arange(states, dtype=np.int64) * BITS

    def run(batches):
        part, n, identity = TaskContext.get().partitionId(), 0, np.arange(states, dtype=np.int64)
        last_key, carry = None, None
        for batch in batches:
            size = batch.num_rows
            if not size:
                continue
            keys = batch.column(key)
            f = (batch.column(fn).to_numpy()[:, None] >> shifts) & (2 ** BITS - 1)
            same = _same_as_before(keys)
            number = np.concatenate([[0], np.cumsum(~same)])
            done = compose_runs(f, number)
            start = carry if carry is not None and keys[0].as_py() == last_key else identity
            first = int(np.searchsorted(number, 1))
            done[:first] = done[:first][:, start]
            before = np.concatenate([start[None], done[:-1]])
            before[1:][~same] = identity
            last_key, carry = keys[-1].as_py(), done[-1].copy()
            cols = [pa.array(np.full(size, part, np.int32)), pa.array(np.arange(n, n + size)), pa.array((before << shifts).sum(1))]
            n += size
            yield pa.RecordBatch.from_arrays([*batch.columns, *cols], names=names)

    ship_package(rows.sparkSession)
    return rows.mapInArrow(run, schema)


def running_state(rows: DataFrame, key: str, order: list[str], fn: str, states: int, out: str, start: int = 0) -> DataFrame:
    """``rows`` with ``out``: the state in which each row's key is before that row, beginning in ``start``.

    ``fn`` holds the rows' functions (``pack``). A null key is a key like any other. The order should be total inside a key.
    """
    sorted_rows = rows.repartitionByRange(key, *order).sortWithinPartitions(key, *order)
    placed = materialize(_scan_partitions(sorted_rows, key, fn, states), "scan-rows")
    tails = placed.groupBy(key, "_part").agg(F.max_by(F.struct("_local", fn), "_n").alias("t"))
    through = pack([apply(F.col(f"t.{fn}"), apply(F.col("t._local"), F.lit(s))) for s in range(states)])
    tails = materialize(tails.select(key, "_part", through.alias("_f")), "scan-tails")
    several = tails.groupBy(key).agg(F.count(F.lit(1)).alias("_k")).where("_k > 1").select(F.col(key).alias("_key"))
    several = tails.join(several, F.col(key).eqNullSafe(F.col("_key")), "left_semi")  # at most two rows a partition
    several = several.select(F.col(key).alias("_key"), F.col("_part").alias("_at"), "_f").coalesce(1).sortWithinPartitions("_key", "_at")
    starts = _scan_partitions(several, "_key", "_f", states).select("_key", "_at", F.col("_local").alias("_from"))
    starts, _ = bounded_broadcast(starts, "scan-starts")
    joined = placed.join(starts, F.col(key).eqNullSafe(F.col("_key")) & (F.col("_part") == F.col("_at")), "left")
    began = F.coalesce(apply(F.col("_from"), F.lit(start)), F.lit(start))
    return joined.withColumn(out, apply(F.col("_local"), began)).drop("_part", "_n", "_local", "_key", "_at", "_from")
