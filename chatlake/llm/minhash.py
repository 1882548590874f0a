"""Near-duplicate documents: MinHash banding, signature verification, full-set confirmation, connected components.

A document's set is its distinct shingles of ``WIDTH`` words (ASCII lower case, split at ASCII white space); a shorter
document has its whole word sequence as its one shingle; a document without words has no set and no links. Two documents
are linked when the Jaccard similarity of their sets is at least ``PERCENT`` / 100.

1. **Sketch** (one pass over the texts): each distinct shingle is hashed to 64 bits; ``BANDS * ROWS`` universal hash
   functions a * x + b give the minima; each band of ``ROWS`` minima becomes one key; four bits of every minimum, mixed,
   are packed into ``BITS`` longs as the signature. A pair at the threshold misses every band with probability
   (1 - 0.75**4)**32 = 5e-6.
2. **Classes**: documents with equal word sequences are one class, so copies are aggregated away before anything else. A class
   is a node (smallest doc_id, hash of the class); nodes compare by doc_id first.
3. **Stars**: every document is paired with the smallest document of all the buckets (band, key) it lies in.
4. **Completion**: in buckets whose members still lie in several components, pivots from the rarest components are paired
   with the members of other components, until no such bucket is left: every candidate pair is then either inside one
   component or tested, without all pairs of a bucket. A round takes up to ``PIVOTS`` pivots of a bucket. The signature tests are part of the
   join condition, so only likely pairs leave it, each pair once: in the first band that its documents share.
5. **Confirmation** on the full shingle sets; components by large-star and small-star over the confirmed links.

Texts are moved once: the sets of the documents that share a bucket with another class are written, and confirmation and the second
signature work on them.

The signature test drops a pair whose bits agree in fewer than ``AGREE`` of 512 places; a pair at the threshold has
mean 448 and standard deviation 11.3 there (5.5 deviations). The second one asks for ``DEEP_AGREE`` of 2048, two of every minimum (mean 1792,
standard deviation 17.9: 5 deviations). Both hold for sets of any size, as the bits of different minima are independent.

Defined results: a null text has no words; a null doc_id is given no set, no component and kept false; rows that repeat
a doc_id are judged each by its own text, and of near texts under one doc_id one class is kept; an empty table
gives no rows; the input's other columns are not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from chatlake.llm.common import materialize, ship
from chatlake.llm.components import components

WIDTH, PERCENT = 5, 75
ROWS, BANDS = 4, 32
BITS = ROWS * BANDS * 4 // 64
AGREE = 386
DEEP, DEEP_AGREE = 1024, 1703
PIVOTS = 1024
CACHE = 100_000
BLOCK = 2048

_RNG = np.random.default_rng(20240229)
_A = _RNG.integers(0, 1 << 32, ROWS * BANDS + DEEP, np.uint32) | np.uint32(1)
_B = _RNG.integers(0, 1 << 32, ROWS * BANDS + DEEP, np.uint32)
_FIRST, _SECOND = slice(0, ROWS * BANDS), slice(ROWS * BANDS, None)
_POSITION = _RNG.integers(0, 1 << 63, max(WIDTH, ROWS), np.uint64) * np.uint64(2) + np.uint64(1)


class WordHash(dict):
    """Word -> 64-bit hash, remembered; emptied when full."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHE:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


_WORDS = WordHash()


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def words_of(text: str | None) -> list[bytes]:
    """ASCII lower case, split at runs of ASCII white space (bytes know no other white space)."""
    return (text or "").encode().lower().split()


def shingles(words: list[bytes], width: int = WIDTH) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the document's shingles."""
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(_WORDS.__getitem__, words), np.uint64, len(words))
    n = max(1, len(h) - width + 1)
    out = np.full(n, len(h) if len(h) < width else width, np.uint64)
    for k in range(min(width, len(h))):
        out += h[k:k + n] * _POSITION[k]
    return np.unique(_mix(out))


def minima(x: np.ndarray, which: slice = _FIRST) -> np.ndarray:
    """The least value of each universal hash function over the set, block by block."""
    x = (x >> np.uint64(32)).astype(np.uint32)
    a, b = _A[which, None], _B[which, None]
    out = np.full(len(a), 0xFFFFFFFF, np.uint32)
    block = BLOCK * ROWS * BANDS // len(a)
    for low in range(0, len(x), block):
        h = x[low:low + block] * a
        h += b
        np.minimum(out, h.min(1), out=out)
    return out


def signature(m: np.ndarray, bits: int = 4) -> np.ndarray:
    """Some bits of every mixed minimum, packed into longs (unmixed, the last bits of a * x + b are those of x, whatever the function)."""
    part = (_mix(m.astype(np.uint64))[:, None] >> np.arange(bits, dtype=np.uint64)) & np.uint64(1)
    return np.packbits(part.astype(np.uint8).ravel()).view(np.int64)


def word_class(words: list[bytes]) -> bytes | None:
    """Digest of the word sequence, null without words."""
    return hashlib.blake2b(b" ".join(words), digest_size=16).digest() if words else None


def class_of(text: Column) -> Column:
    """``word_class`` of a text column."""
    @F.arrow_udf("binary")
    def digest(t: pa.Array) -> pa.Array:
        return pa.array((word_class(words_of(x.as_py())) for x in t), pa.binary())
    return digest(text)


def _tie(cls: bytes | None) -> int:
    """What Spark's xxhash64 makes of the digest: tells classes of one smallest doc_id apart."""
    h = xxhash.xxh64_intdigest(cls or b"", 42)
    return h - (1 << 64) if h >> 63 else h


def sketch(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, class (digest of the word sequence, null without words), n_shingles, bands, bits."""
    def run(batches):
        for batch in batches:
            for low in range(0, batch.num_rows, 1024):
                part = batch.slice(low, 1024)
                cls, sizes, bands, bits = [], [], [], []
                for text in part.column(1).to_pylist():
                    words = words_of(text)
                    x = shingles(words)
                    sizes.append(len(x))
                    if not words:
                        cls.append(None)
                        bands.append(None)
                        bits.append(None)
                        continue
                    cls.append(word_class(words))
                    m = minima(x)
                    rows = m.reshape(BANDS, ROWS).astype(np.uint64)
                    bands.append(_mix((rows * _POSITION[:ROWS]).sum(1, dtype=np.uint64)).view(np.int64))
                    bits.append(signature(m))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).cast(pa.int64()), pa.array(cls, pa.binary()), pa.array(sizes, pa.int64()),
                     pa.array(bands, pa.list_(pa.int64())), pa.array(bits, pa.list_(pa.int64()))],
                    names=["id", "cls", "n_shingles", "bands", "bits"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return ship(rows).mapInArrow(run, "id long, cls binary, n_shingles long, bands array<long>, bits array<long>")


def shingle_sets(docs: DataFrame, ids: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(node, shingles) of the documents whose ids ``ids`` (node) names, from their texts."""
    def run(batches):
        for batch in batches:
            for low in range(0, batch.num_rows, 64):
                part = batch.slice(low, 64)
                words = [words_of(t) for t in part.column(1).to_pylist()]
                made = [shingles(w).view(np.int64) for w in words]
                ties = pa.array([_tie(word_class(w)) for w in words], pa.int64())
                nodes = pa.StructArray.from_arrays([part.column(0), ties], names=["id", "tie"])
                yield pa.RecordBatch.from_arrays([nodes, pa.array(made, pa.list_(pa.int64()))], names=["node", "shingles"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    # one plan at every size: the texts are moved once
    named = ship(rows).join(ids.select("node.id").distinct().hint("merge"), "id", "left_semi")
    return named.mapInArrow(run, "node struct<id: long, tie: long>, shingles array<long>")


def deep_signatures(sets: DataFrame) -> DataFrame:
    """(node, deep): the second signature of each set."""
    def run(batches):
        for batch in batches:
            made = [signature(minima(x.values.to_numpy(zero_copy_only=False).view(np.uint64), _SECOND), 2) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made, pa.list_(pa.int64()))], names=["node", "deep"])

    return ship(sets).select("node", "shingles").mapInArrow(run, "node struct<id: long, tie: long>, deep array<long>")


def _alike(a: str, b: str) -> str:
    """SQL: the signatures of rows ``a`` and ``b`` agree well enough, and their sizes allow the similarity."""
    differ = " + ".join(f"bit_count({a}.bits[{k}] ^ {b}.bits[{k}])" for k in range(BITS))
    return f"100 * least({a}.n, {b}.n) >= {PERCENT} * greatest({a}.n, {b}.n) and {differ} <= {64 * BITS - AGREE}"


def _confirm(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Of ``pairs`` (a, b) those whose full sets are similar enough, written to the shared folder."""
    ids = pairs.select(F.col("a").alias("node")).unionAll(pairs.select("b")).distinct()
    sets = materialize(sets.join(ids.hint("merge"), "node", "left_semi"), "sets")
    left = sets.select(F.col("node").alias("a"), F.col("shingles").alias("sa"))
    right = sets.select(F.col("node").alias("b"), F.col("shingles").alias("sb"))
    both = pairs.join(left, "a").join(right, "b")
    common = both.select("a", "b", F.size(F.array_intersect("sa", "sb")).alias("common"),
                         (F.size("sa") + F.size("sb")).alias("total"))
    return materialize(common.where(f"100 * common >= {PERCENT} * (total - common)").select("a", "b"), "links")


def _joined(comp: DataFrame, links: DataFrame) -> DataFrame:
    """(node, component) after ``links`` (a, b) between nodes of ``comp`` or alone: only the components that they join are worked on."""
    ends = links
    for end in ("a", "b"):
        place = comp.select(F.col("node").alias(end), F.col("component").alias(f"c{end}"))
        ends = ends.join(place, end, "left").withColumn(end, F.coalesce(f"c{end}", end)).drop(f"c{end}")
    merged = materialize(components(ends, "a", "b"), "merged")  # components' smallest nodes, and nodes that were alone
    moved = merged.select(F.col("node").alias("component"), F.col("component").alias("__to"))
    kept = comp.join(moved, "component", "left").select("node", F.coalesce("__to", "component").alias("component"))
    alone = merged.join(comp.select("node"), "node", "left_anti")
    return kept.unionAll(alone.select("node", "component"))


def link_components(docs: DataFrame, nodes: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(node, component) over all links between ``nodes`` (node, n, bands, bits); nodes without a link are left out."""
    keys = nodes.select("node", F.posexplode("bands").alias("band", "key"))
    keys = keys.select("node", "band", F.xxhash64("band", "key").alias("bucket"))
    shared = keys.groupBy("bucket").agg(F.min("node").alias("first"), F.max("node").alias("last")).where("first <> last")
    members = materialize(keys.join(shared.hint("merge"), "bucket").select("bucket", "band", "node", "first"), "buckets")
    facts = nodes.select("node", "n", "bits", "bands")
    sets = materialize(shingle_sets(docs, members.select("node"), id_col, text_col).dropDuplicates(["node"]), "sets")
    stars = members.groupBy(F.col("node").alias("b")).agg(F.min("first").alias("a")).where("a <> b")
    a, b = facts.alias("x"), facts.alias("y")
    likely = stars.join(a, F.col("a") == F.col("x.node")).join(b, F.col("b") == F.col("y.node")).where(F.expr(_alike("x", "y")))
    links = _confirm(materialize(likely.select("a", "b"), "pairs"), sets)
    comp = materialize(components(links, "a", "b"), "components")
    info = None
    deep = f"aggregate(zip_with(x.deep, y.deep, (a, b) -> bit_count(a ^ b)), 0, (s, d) -> s + d) <= {DEEP * 2 - DEEP_AGREE}"
    # a pair leaves the join once: with the pivot that ranks first, and in the first band that its documents share
    once = "(x.mates < y.mates or x.mates = y.mates and x.node < y.node)"
    here = "array_position(zip_with(x.bands, y.bands, (a, b) -> a = b), true) = x.band + 1"
    while True:
        placed = members.join(comp.withColumnRenamed("node", "cnode"), F.col("node") == F.col("cnode"), "left")
        placed = placed.select("bucket", "band", "node", F.coalesce("component", "node").alias("comp"))
        counts = placed.groupBy("bucket", "comp").agg(F.count(F.lit(1)).alias("mates"))
        mixed = counts.groupBy("bucket").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi")
        left = placed.join(mixed.select("bucket").hint("merge"), "bucket", "left_semi")
        left = materialize(left.join(counts.hint("merge"), ["bucket", "comp"]), "open")
        rank = F.row_number().over(Window.partitionBy("bucket").orderBy("mates", "node"))
        pivots = left.withColumn("rank", rank).where(F.col("rank") <= PIVOTS).drop("rank")
        pivots = materialize(pivots, "pivots")
        if pivots.isEmpty():
            return comp
        if info is None:  # later rounds work on a part of these nodes
            sets = materialize(sets.join(left.select("node").distinct().hint("merge"), "node", "left_semi"), "sets")
            deeper = materialize(deep_signatures(sets), "deep")
            info = materialize(facts.join(deeper, "node").select("node", "n", "bits", "bands", "deep"), "facts")
        x, y = pivots.join(info, "node").alias("x"), left.join(info, "node").alias("y")
        pairs = y.join(x.hint("merge"), F.expr(f"x.bucket = y.bucket and x.comp <> y.comp and {once} and {_alike('x', 'y')} and {deep} and {here}"))
        pairs = pairs.select(F.least("x.node", "y.node").alias("a"), F.greatest("x.node", "y.node").alias("b")).distinct()
        pairs = materialize(pairs, "pairs")
        if not pairs.isEmpty():
            more = _confirm(pairs, sets)
            if not more.isEmpty():
                comp = materialize(_joined(comp, more), "components")
        members = left.join(pivots.select("bucket", "node"), ["bucket", "node"], "left_anti").select("bucket", "band", "node")


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of ``docs``: its id, n_shingles, component_id (smallest id reachable, itself included), kept."""
    return judge(docs, id_col, text_col).drop("cls")


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``near_dedup`` with each row's class, ``cls``."""
    rows = materialize(sketch(docs, id_col, text_col), "sketch")
    with_set = rows.where("cls is not null and id is not null")
    least = F.min(F.struct("id", "n_shingles", "bands", "bits")).alias("first")
    classes = materialize(with_set.groupBy("cls").agg(least).select("cls", "first.*"), "classes")
    node = F.struct("id", F.xxhash64("cls").alias("tie")).alias("node")
    nodes = classes.select(node, F.col("n_shingles").alias("n"), "bands", "bits")
    comp = link_components(docs, nodes, id_col, text_col)
    placed = classes.select("cls", node).join(comp, "node", "left")
    placed = placed.select("cls", F.coalesce("component", "node").alias("reach"))
    out = rows.select("id", "cls", "n_shingles").join(placed.hint("merge"), "cls", "left")
    own = F.when(F.col("id").isNotNull(), F.coalesce("reach.id", "id"))
    first = F.col("reach").isNull() | (F.col("reach.tie") == F.xxhash64("cls"))
    return out.select(F.col("id").alias(id_col), F.when(F.col("id").isNotNull(), F.col("n_shingles")).otherwise(0).alias("n_shingles"),
                      own.alias("component_id"), F.coalesce((F.col("id") == own) & first, F.lit(False)).alias("kept"), "cls")
