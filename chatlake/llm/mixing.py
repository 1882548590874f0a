"""Mixing sources to target weights along a time-varying curriculum.

* **Targets.** Sources in code-point order (null last) take ``weights`` in turn and share the corpus' words by weight; a
  source's target stops at ``ceiling`` times its own words and the excess is reshared by weight among the others until
  no target is above its ceiling (sources in the order of ceiling / weight: the first that isn't reached fixes the
  level for all later ones).
* **Demand.** A source's schedule is piecewise linear over training time 0..1: knots (time, relative weight). Scaled to
  the target, its integral is the cumulative demand of the source's words. The source's documents stand in a seeded order,
  one pass behind another; a pass takes a document while the middle of its words is below the target, so the words
  taken differ from the target by at most half a document. The middle's place is looked up in the inverted demand
  (a quadratic in the segment that holds it): that time is the copy's training position.
* **Order.** Copies are range-sorted by position.

The running sum of a source's words is not one task's work: documents fall into ``2**BUCKET_BITS`` buckets by the first
bits of their order, the buckets' totals are aggregated before the shuffle and summed per source, and the running sum
then runs inside one (source, bucket). Sources' figures reach documents through the buckets, so a source that holds a
third of all rows is spread like any other.

Defined results: a null text has no words; documents without words take no words and are placed like the others;
a null source is a source of its own; a null doc_id stands in the order of the empty string; rows that repeat a doc_id are separate
documents next to each other; a corpus without words has targets 0 and takes nothing; an empty table gives no rows; input
columns stay, except that ``size, source_size, target, copies, taken, positions`` are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chatlake.llm.common import WORD, materialize, text_or_empty

WEIGHTS = (5, 2, 1)
CEILING = 3
BUCKET_BITS = 10
#: Knots (time, relative weight) in turn for the sources, like the weights: early, even, late.
SCHEDULES = (((0.0, 1.5), (1.0, 0.5)), ((0.0, 1.0), (1.0, 1.0)), ((0.0, 0.5), (0.5, 1.0), (1.0, 1.5)))
ADDED = ("size", "source_size", "target", "copies", "taken", "positions")


def word_count(col: str) -> Column:
    return F.regexp_count(text_or_empty(col), F.lit(WORD)).cast("long")


def segments(knots) -> Column:
    """The schedule as segments with the share of its integral before each (scaled to 1 in all)."""
    parts = [(a, b, u, v, (b - a) * (u + v) / 2) for (a, u), (b, v) in zip(knots, knots[1:]) if b > a]
    total = sum(p[-1] for p in parts)
    if not total > 0 or any(min(p[2], p[3]) < 0 for p in parts):
        raise ValueError(f"a schedule needs a positive integral and no negative weight: {knots}")
    out, before = [], 0.0
    for a, b, u, v, area in parts:
        values = {"t": a, "dt": b - a, "w0": u / total, "w1": v / total, "d0": before, "d1": before + area / total}
        out.append(F.struct(*(F.lit(float(x)).alias(n) for n, x in values.items())))
        before += area / total
    return F.array(*out)


def training_time(share: Column, schedule: Column) -> Column:
    """The time at which the schedule's integral reaches ``share`` (0..1): cumulative demand, inverted."""
    def inverse(s):
        need = F.greatest(share - s["d0"], F.lit(0.0))
        # w0 * x + (w1 - w0) / (2 dt) * x**2 = need, in the form that is stable for even and falling weights
        root = F.sqrt(F.greatest(s["w0"] * s["w0"] + 2 * (s["w1"] - s["w0"]) / s["dt"] * need, F.lit(0.0)))
        under = s["w0"] + root
        return s["t"] + F.when(under > 0, F.least(2 * need / under, s["dt"])).otherwise(F.lit(0.0))
    reached = F.filter(schedule, lambda s: share <= s["d1"])
    return F.coalesce(inverse(F.try_element_at(reached, F.lit(1))), F.lit(1.0))


def targets(sizes: DataFrame, weights=WEIGHTS, ceiling: float = CEILING, schedules=SCHEDULES) -> DataFrame:
    """(source, source_size) -> target and schedule of every source; one row per source."""
    turn = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    pick = lambda values: F.element_at(F.array(*values), (F.col("turn") % len(values) + 1).cast("int"))
    s = sizes.withColumn("turn", turn).withColumn("weight", pick([F.lit(float(w)) for w in weights]))
    s = s.withColumn("schedule", pick([segments(k) for k in schedules]))
    s = s.withColumn("cap", F.col("source_size") * F.lit(float(ceiling)))
    order = Window.orderBy(F.col("cap") / F.col("weight"), "turn")
    every = Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    s = s.withColumns({"place": F.row_number().over(order), "total": F.sum("source_size").over(every),
                       "before": F.sum("cap").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("cap"),
                       "rest": F.sum("weight").over(order.rowsBetween(Window.currentRow, Window.unboundedFollowing))})
    s = s.withColumn("level", (F.col("total") - F.col("before")) / F.col("rest"))
    free = F.when(F.col("cap") > F.col("level") * F.col("weight"), F.struct("place", "level"))
    s = s.withColumn("open", F.min(free).over(every))
    target = F.when(F.col("open").isNull() | (F.col("place") < F.col("open.place")), F.col("cap")
                    ).otherwise(F.col("open.level") * F.col("weight"))
    return s.select("source", "source_size", target.alias("target"), "schedule")


def assign(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", weights=WEIGHTS,
           ceiling: int = CEILING, schedules=SCHEDULES) -> DataFrame:
    """``docs`` with size, source_size, target, copies, taken (words, repeats counted) and positions (one per copy)."""
    own = [c for c in docs.columns if c not in ADDED or c in (id_col, source_col, text_col)]
    rows = docs.select(*own)
    # the first 32 bits of a digest of the id: a seeded order that SQL can repeat
    order = F.conv(F.substring(F.md5(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")), 1, 8), 16, 10)
    keyed = {"__size": word_count(text_col), "__order": order.cast("long"), "__source": F.col(source_col)}
    rows = rows.withColumns(keyed).withColumn("__bucket", F.expr(f"shiftright(__order, {32 - BUCKET_BITS})"))
    buckets = rows.groupBy(F.col("__source").alias("source"), F.col("__bucket").alias("bucket")).agg(F.sum("__size").alias("words"))
    buckets = materialize(buckets, "mix-buckets")
    per_source = targets(buckets.groupBy("source").agg(F.sum("words").alias("source_size")), weights, ceiling, schedules)
    upto = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    offsets = buckets.withColumn("before", F.sum("words").over(upto) - F.col("words"))
    names = {n: F.col(n).alias(f"b_{n}") for n in ("source", "bucket", "before")}
    figures = per_source.select(F.col("source").alias("s_source"), "source_size", "target", "schedule")
    offsets = offsets.select(*names.values()).join(figures, F.col("b_source").eqNullSafe(F.col("s_source")))
    offsets = materialize(offsets.select(*(F.col(f"b_{n}").alias(f"__b_{n}") for n in names), F.col("source_size").alias("__source_size"),
                                         F.col("target").alias("__target"), F.col("schedule").alias("__schedule")), "mix-offsets")
    joined = rows.join(offsets, F.col("__source").eqNullSafe(F.col("__b_source")) & (F.col("__bucket") == F.col("__b_bucket")))
    running = Window.partitionBy("__source", "__bucket").orderBy("__order", id_col, "__size")
    done = F.sum("__size").over(running.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    middle = F.col("__b_before") + done - F.col("__size") / 2
    joined = joined.withColumn("__middle", middle)
    passes = F.transform(F.sequence(F.lit(0), F.lit(max(0, int(ceiling) - 1))), lambda e: F.col("__middle") + e * F.col("__source_size"))
    joined = joined.withColumn("__taken", F.filter(passes, lambda m: m < F.col("__target")))
    out = {"size": F.col("__size"), "source_size": F.col("__source_size"), "target": F.col("__target"),
           "copies": F.size("__taken"), "taken": F.size("__taken") * F.col("__size"),
           "positions": F.transform("__taken", lambda m: training_time(m / F.col("__target"), F.col("__schedule")))}
    return joined.withColumns(out).select(*(c for c in own if c not in out), *out)


def curriculum(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", **options) -> DataFrame:
    """The mix in training order: ``docs``' columns and ``position``, one row per copy, range-sorted by position."""
    placed = assign(docs, id_col, source_col, text_col, **options)
    rows = placed.select(*docs.columns, F.explode("positions").alias("__position"))
    rows = rows.orderBy("__position", id_col)
    return rows.select(*(c for c in docs.columns if c != "position"), F.col("__position").alias("position"))
