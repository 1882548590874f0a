"""How far apart a language's sources are: smoothed term shares compared over run-length columns.

A term is a run of ASCII letters and non-ASCII code points, ASCII letters in lower case. A language keeps the terms that at least
``min_docs`` of its documents hold. Every (language, source) group and the language itself give each kept term the whole number
``p = 1 + floor(SCALE * (count + 2) / (N + 2 * V))``; two shares differ by ``f = floor((p - q)**2 / (p + q))``.

1. **Counts.** Tasks count the terms of whole texts by (language, source) and send sums on; each kept term becomes one row with
   its counts by group (zeros left out), at most as long as the language has sources.
2. **Order.** A language's terms are range-sorted by these counts, so terms that are equally frequent everywhere stand together,
   and the columns of the first groups consist of few long runs.
3. **Columns.** The sorted terms are cut into segments of ``SEGMENT`` terms. Inside a segment a group's counts are a run-length
   column; a group without any of the terms is a single run of zeros.
4. **Pairs.** ``BLOCK`` columns of a segment travel together. Two blocks of a segment meet, each pair of columns is cut at the
   boundaries of both, and f is taken once for each common run and multiplied by its length. Sums over segments are added up.

Counts up to 9 * 10**13 are exact. The number of pairs is that of the result; no pair of documents or of terms is ever formed.

Defined results: null text, language and source are ''; a group without terms takes part with zero counts; a language without kept
terms gives its pairs the value 0 and no terms; a language with one source gives no pairs; rows that repeat count each; other
columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chatlake.llm.common import materialize, ship, text_or_empty
from chatlake.session import bounded_broadcast

SCALE, MIN_DOCS, TOP = 1_000_000_000, 10, 10
SEGMENT, BLOCK = 4096, 16
CACHE = 400_000  # counts and sums a task holds before it sends them on
_TERM = re.compile(rb"[a-z\x80-\xff]+")  # in UTF-8 every byte of a non-ASCII code point is 0x80 or more
_AT_ONCE = 1 << 20


def terms(text: str | None):
    """The terms of a whole text, as UTF-8, a list or, of a long text, their counts; bytes.lower() changes ASCII letters only."""
    low = (text or "").encode().lower()
    return _TERM.findall(low) if len(low) <= _AT_ONCE else Counter(m.group() for m in _TERM.finditer(low))


def count_terms(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, docs): occurrences and documents, partial sums of each task; ``docs`` has lang, source, text."""
    def run(batches):
        groups: dict = {}  # (lang, source) -> occurrences and documents by term, in the same order

        def flush():
            for (lang, source), (found, held) in groups.items():
                cols = [pa.repeat(pa.scalar(x, pa.string()), len(found)) for x in (lang, source)]
                cols += [pa.array(list(found), pa.binary()).cast(pa.string()), pa.array(list(found.values()), pa.int64()),
                         pa.array(list(held.values()), pa.int64())]
                yield pa.RecordBatch.from_arrays(cols, names=["lang", "source", "term", "n", "docs"])
            groups.clear()
        for batch in batches:
            for lang, source, text in zip(*(batch.column(k).to_pylist() for k in range(3))):
                found, held = groups.setdefault((lang, source), (Counter(), Counter()))
                words = terms(text)
                found.update(words)
                held.update(list(dict.fromkeys(words)))
                if sum(len(f) for f, _ in groups.values()) > CACHE:
                    yield from flush()
        yield from flush()

    return ship(docs).select("lang", "source", "text").mapInArrow(run, "lang string, source string, term string, n long, docs long")


def kept_terms(docs: DataFrame, groups: DataFrame, min_docs: int) -> DataFrame:
    """(lang, term, total, counts): the kept terms with their counts by group number, ascending."""
    counted = count_terms(docs).join(groups, ["lang", "source"])
    # one exchange for both sums: what shares a term also shares (term, group)
    summed = counted.repartition("lang", "term").groupBy("lang", "term", "g").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    rows = summed.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("total"),
                                              F.sort_array(F.collect_list(F.struct("g", "n"))).alias("counts"))
    return rows.where(F.col("docs") >= min_docs).select("lang", "term", "total", "counts")


def share(count: Column, whole: Column) -> Column:
    """1 + floor(SCALE * count / whole) in two steps, so that no product leaves 64 bits."""
    a, b = count * 100_000, F.lit(SCALE // 100_000)
    div = lambda x, y: F.call_function("div", x, y)
    return div(a, whole) * b + div((a % whole) * b, whole) + 1


def shares(counts: np.ndarray, whole: int) -> np.ndarray:
    """``share`` of counts + 2."""
    a = (counts + 2) * 100_000
    b = SCALE // 100_000
    return a // whole * b + a % whole * b // whole + 1


def difference(p, q):
    """floor((p - q)**2 / (p + q)) of arrays of whole numbers."""
    return (p - q) ** 2 // (p + q)


def run_length(column: np.ndarray) -> np.ndarray:
    """Where the runs of equal values start."""
    return np.flatnonzero(np.concatenate([[True], column[1:] != column[:-1]])).astype(np.int32)


def pair_sum(starts_a, p, starts_b, q, length: int) -> int:
    """Sum of the difference over two run-length columns of ``length`` terms, one product for each common run."""
    cuts = np.union1d(starts_a, starts_b)
    f = difference(p[np.searchsorted(starts_a, cuts, "right") - 1], q[np.searchsorted(starts_b, cuts, "right") - 1])
    return int((f * np.diff(np.append(cuts, length))).sum())


_COLUMNS = "lang string, segment long, length int, g int, starts binary, counts binary"


def columns(kept: DataFrame) -> DataFrame:
    """Run-length columns by (lang, segment, g); a row without g states each segment's length."""
    def run(batches):
        part, number = TaskContext.get().partitionId() << 32, 0
        lang, held = None, []

        def segment():
            nonlocal number, held
            size = sum(len(x) for x in held)
            table = pa.chunked_array(held).combine_chunks()
            at = np.repeat(np.arange(size), np.diff(table.offsets.to_numpy()))
            g, n = (table.flatten().field(k).to_numpy() for k in ("g", "n"))
            order = np.argsort(g, kind="stable")
            present, first = np.unique(g[order], return_index=True)
            out = [(None, None, None)]
            for k, low, high in zip(present, first, [*first[1:], len(g)]):
                dense = np.zeros(size, np.int64)
                dense[at[order[low:high]]] = n[order[low:high]]
                starts = run_length(dense)
                out.append((int(k), starts.tobytes(), dense[starts].tobytes()))
            cols = [pa.array([lang] * len(out), pa.string()), pa.array([part + number] * len(out), pa.int64()), pa.array([size] * len(out), pa.int32()),
                    *(pa.array([x[i] for x in out], t) for i, t in enumerate((pa.int32(), pa.binary(), pa.binary())))]
            number, held = number + 1, []
            return pa.RecordBatch.from_arrays(cols, names=["lang", "segment", "length", "g", "starts", "counts"])
        for batch in batches:
            langs = batch.column(0).to_pylist()
            low = 0
            while low < len(langs):
                if held and langs[low] != lang:
                    yield segment()
                lang, room = langs[low], SEGMENT - sum(len(x) for x in held)
                high = low
                while high < len(langs) and high - low < room and langs[high] == lang:
                    high += 1
                held.append(batch.column(1).slice(low, high - low))
                if high - low == room:
                    yield segment()
                low = high
        if held:
            yield segment()

    ordered = kept.repartitionByRange("lang", "counts", "term").sortWithinPartitions("lang", "counts", "term")
    return ship(ordered).select("lang", "counts").mapInArrow(run, _COLUMNS)


def pair_sums(runs: DataFrame, groups: DataFrame) -> DataFrame:
    """(lang, a, b, value): the summed differences of the groups a < b; ``groups`` has lang, g and whole (N + 2 * V)."""
    heads = runs.where("g is null").select("lang", "segment", "length").join(groups.select("lang", "g", "whole"), "lang")
    full = heads.join(runs.where("g is not null").select("lang", "segment", "g", "starts", "counts"), ["lang", "segment", "g"], "left")
    blocks = full.groupBy("lang", "segment", F.expr(f"g div {BLOCK}").alias("block")).agg(
        F.max("length").alias("length"), F.collect_list(F.struct("g", "whole", "starts", "counts")).alias("cols"))
    blocks = materialize(blocks, "divergence-blocks")
    left = blocks.select("lang", "segment", "length", F.col("block").alias("i"), F.col("cols").alias("left"))
    right = blocks.select("lang", "segment", F.col("block").alias("j"), F.col("cols").alias("right"))
    met = left.join(right, ["lang", "segment"]).where("i <= j")

    def unpack(cols):
        for c in cols:
            starts = np.zeros(1, np.int32) if c["starts"] is None else np.frombuffer(c["starts"], np.int32)
            counts = np.zeros(1, np.int64) if c["counts"] is None else np.frombuffer(c["counts"], np.int64)
            yield c["g"], starts, shares(counts, c["whole"])

    def run(batches):
        sums: Counter = Counter()

        def flush():
            keys = list(sums)
            cols = [pa.array([k[0] for k in keys], pa.string()), *(pa.array([k[i] for k in keys], pa.int32()) for i in (1, 2)),
                    pa.array([sums[k] for k in keys], pa.int64())]
            sums.clear()
            return pa.RecordBatch.from_arrays(cols, names=["lang", "a", "b", "value"])
        for batch in batches:
            for k in range(batch.num_rows):
                lang, length, one, two = (batch.column(n)[k].as_py() for n in range(4))
                two = list(unpack(two))
                for a, starts_a, p in unpack(one):
                    for b, starts_b, q in two:
                        if a < b:  # a block that meets itself holds both orders
                            sums[lang, a, b] += pair_sum(starts_a, p, starts_b, q, length)
                if len(sums) > CACHE:
                    yield flush()
        if sums:
            yield flush()

    parts = ship(met).select("lang", "length", "left", "right").mapInArrow(run, "lang string, a int, b int, value long")
    return parts.groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))


def audit(docs: DataFrame, min_docs: int = MIN_DOCS, top: int = TOP, lang_col: str = "lang", source_col: str = "source",
          text_col: str = "text") -> DataFrame:
    """(lang, source, part, item, value, rank): ``pair`` rows for each other source, ``term`` rows for the ``top`` terms that a
    source uses more than its language does."""
    rows = docs.select(*(text_or_empty(c).alias(n) for n, c in (("lang", lang_col), ("source", source_col), ("text", text_col))))
    number = F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1
    groups = materialize(rows.select("lang", "source").distinct().withColumn("g", number), "divergence-groups")  # one row a source
    kept = materialize(kept_terms(rows, bounded_broadcast(groups, "divergence-groups")[0], min_docs), "divergence-terms")
    uses = kept.select("lang", "term", "total", F.explode("counts").alias("c")).select("lang", "term", "total", "c.g", "c.n")
    sizes = uses.groupBy("lang", "g").agg(F.sum("n").alias("size"))
    langs = kept.groupBy("lang").agg(F.count(F.lit(1)).alias("terms"), F.sum("total").alias("all"))
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long"))
    groups = groups.join(sizes, ["lang", "g"], "left").join(langs, "lang", "left")
    groups = groups.select("lang", "source", "g", (zero(F.col("size")) + 2 * zero(F.col("terms"))).alias("whole"),
                           (zero(F.col("all")) + 2 * zero(F.col("terms"))).alias("lang_whole"))
    groups, _ = bounded_broadcast(groups, "divergence-sizes")

    sums = pair_sums(materialize(columns(kept), "divergence-columns"), groups)
    mirrored = sums.select("lang", F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("x"), "value")
    mirrored = mirrored.select("lang", F.col("x.a").alias("g"), F.col("x.b").alias("h"), "value")
    others = groups.select("lang", F.col("source").alias("item"), F.col("g").alias("h"))
    pairs = groups.select("lang", "source", "g").join(others, "lang").where("g <> h").join(mirrored, ["lang", "g", "h"], "left")
    pairs = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", zero(F.col("value")).alias("value"))

    said = uses.join(groups, ["lang", "g"]).where("n > 0")
    said = said.withColumns({"p": share(F.col("n") + 2, F.col("whole")), "q": share(F.col("total") + 2, F.col("lang_whole"))}).where("p > q")
    said = said.select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), F.expr("(p - q) * (p - q) div (p + q)").alias("value"))
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item"))
    return pairs.withColumn("rank", rank).unionByName(said.withColumn("rank", rank).where(F.col("rank") <= top))
