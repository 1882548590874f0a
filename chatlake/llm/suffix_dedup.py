"""Removal of repeated passages: every byte of a ``LENGTH``-byte string that also starts anywhere else in the corpus.

A suffix array of the whole corpus fits no task, so equal windows are first brought together, then sorted:

1. **Anchors** (one pass over the texts). Each window of ``LENGTH`` bytes picks the ``GRAM``-byte string in it with the least
   hash, leftmost among equals. The choice depends on the window's bytes alone, so equal windows pick equal strings. Consecutive
   windows with one pick are one *segment*: their bytes, the pick's 64-bit fingerprint f and a digest of the bytes.
2. **Candidates.** Only segments whose f occurs more than once can hold repeated windows. Equal segments are counted,
   aggregated before the shuffle: all windows of a segment that occurs twice are repeated, without sorting anything.
3. **Suffix arrays.** Where one f has several different segments, one copy of each is fetched and all segments of an f go to one
   task, which concatenates them (0xFF, never in UTF-8, between them) and sorts their suffixes in two stages: only the
   suffixes smaller than their successors are compared directly; the others are induced by scanning the buckets of the first byte
   from small to large. Windows whose common prefix with a neighbour reaches ``LENGTH`` are repeated. An f with more than ``HOT`` different
   segments (the edge of a very common passage) is not sorted in one task: 128-bit digests of its windows are counted, in blocks of ``STRIDE``.
4. **Cut.** Covered ranges return to their documents and are cut out.

Defined results: a null text is empty; a text shorter than ``LENGTH`` loses nothing; matches never cross documents; rows are told
apart by the id where it is unique and never null, otherwise by numbers given once to a written copy of the rows, so repeated rows and
rows without an id count as documents of their own; an empty table gives no rows; other columns of the input stay, except ``n_bytes, spans, kept``, which are replaced.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chatlake.llm.common import materialize, ship, text_or_empty

LENGTH, GRAM = 200, 64
HOT = 256
STRIDE = 12  # windows of a block where an f is hot
WIDE = LENGTH - GRAM + 1  # strings a window picks from
CHUNK, PLACE = 1 << 16, 17  # windows hashed at once; bits for a place among them
SORT_BYTES = 1 << 20
SEPARATOR = 0xFF

_RNG = np.random.default_rng(8)
_BYTE = _RNG.integers(0, 1 << 63, 256, np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


_UP = _powers(_BASE, CHUNK + LENGTH)
_DOWN = _powers(pow(_BASE, -1, 1 << 64), CHUNK + LENGTH)


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """A hash of each ``GRAM``-byte string, by sums of byte values times powers (mod 2**64), mixed."""
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE[data] * _UP[:len(data)], out=sums[1:])
    h = (sums[GRAM:] - sums[:-GRAM]) * _DOWN[:len(data) - GRAM + 1]
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(29))


def picks(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For every window start of ``data``: the place of its pick; and the hashes of all places."""
    n = len(data) - LENGTH + 1
    place, hashes = np.empty(n, np.int64), np.empty(len(data) - GRAM + 1, np.uint64)
    low_bits = np.uint64((1 << PLACE) - 1)
    for low in range(0, n, CHUNK):
        size = min(CHUNK, n - low)
        h = gram_hashes(data[low:low + size + LENGTH - 1])
        hashes[low:low + len(h)] = h
        least = (h & ~low_bits) | np.arange(len(h), dtype=np.uint64)
        step = 1
        while 2 * step <= WIDE:  # minima of doubling widths
            least = np.minimum(least[:-step], least[step:])
            step *= 2
        if WIDE > step:
            least = np.minimum(least[:size], least[WIDE - step:WIDE - step + size])
        place[low:low + size] = (least[:size] & low_bits).astype(np.int64) + low
    return place, hashes


def anchors(texts: list[bytes]) -> tuple[np.ndarray, ...]:
    """Segments of the texts: (text number, first window, pick minus first window, windows - 1, fingerprint, digest)."""
    size = np.array([len(t) for t in texts], np.int64)
    end = np.cumsum(size)
    start = end - size
    data = b"".join(texts)
    if len(data) < LENGTH:
        return tuple(np.empty(0, np.int64) for _ in range(6))
    array = np.frombuffer(data, np.uint8)
    place, hashes = picks(array)
    inside = np.zeros(len(array) + 1, np.int32)  # windows that lie in one text
    long = size >= LENGTH
    np.add.at(inside, start[long], 1)
    np.add.at(inside, end[long] - LENGTH + 1, -1)
    window = np.flatnonzero(np.cumsum(inside)[:len(place)])
    pick = place[window]
    first = np.flatnonzero(np.append(True, pick[1:] != pick[:-1]))[:len(window)]
    lo, hi = window[first], window[np.append(first[1:], len(window)) - 1] if len(window) else window
    pick = pick[first]
    text = np.searchsorted(end, lo, "right")
    view, digest = memoryview(data), xxhash.xxh3_64_intdigest
    digests = np.fromiter((digest(view[a:b]) for a, b in zip(lo.tolist(), (hi + LENGTH).tolist())), np.uint64, len(lo))
    return text, lo - start[text], pick - lo, hi - lo, hashes[pick].view(np.int64), digests.view(np.int64)


def suffix_array(data: np.ndarray, words: np.ndarray, depth: int = LENGTH) -> np.ndarray:
    """All places of ``data`` in the order of their suffixes (to ``depth`` bytes), by two-stage sorting.

    ``words``: the eight bytes from each place as one number, at least ``depth`` places longer than ``data``.
    """
    n = len(data)
    step = np.sign(np.diff(data.astype(np.int16)))
    known = np.where(step != 0, np.arange(n - 1), n)  # equal neighbours have the type of the next unequal ones
    nxt = np.append(np.minimum.accumulate(known[::-1])[::-1], n)
    small = np.append(step, -1)[np.minimum(nxt, n - 1)] > 0  # smaller than its successor; the last suffix is larger
    # first stage: sort the small suffixes, eight bytes at a time, among those still tied
    order = np.flatnonzero(small)
    order = order[np.argsort(words[order], kind="stable")]
    group = np.cumsum(np.append(True, words[order][1:] != words[order][:-1])[:len(order)]) if len(order) else order
    tied = np.arange(len(order))
    for at in range(8, depth, 8):
        if not len(tied):
            break
        g = group[tied]
        same = np.append(g[1:] == g[:-1], False)
        tied = tied[same | np.append(False, same[:-1])]
        g, p = group[tied], order[tied]
        w = words[p + at]
        sort = np.lexsort((w, g))
        order[tied], w = p[sort], w[sort]
        fresh = np.append(True, (g[1:] != g[:-1]) | (w[1:] != w[:-1]))[:len(tied)]
        group[tied] = np.cumsum(fresh) + n * 2  # numbers only need to differ between neighbours
    # second stage: scan buckets by first byte; a suffix's larger predecessor goes to the next place of its own bucket
    count = np.bincount(data, minlength=256)
    begin = np.cumsum(count) - count
    small_count = np.bincount(data[order], minlength=256)
    out = np.empty(n, np.int64)
    split = np.cumsum(small_count) - small_count
    for c in np.flatnonzero(small_count):
        out[begin[c] + count[c] - small_count[c]:begin[c] + count[c]] = order[split[c]:split[c] + small_count[c]]
    free = begin.copy()
    out[free[data[n - 1]]] = n - 1  # behind the last suffix stands the empty one, smallest of all
    free[data[n - 1]] += 1

    def induce(places: np.ndarray) -> None:
        before = places[places > 0] - 1
        before = before[~small[before]]
        if len(before):
            byte = data[before]
            sort = np.argsort(byte, kind="stable")
            before, byte = before[sort], byte[sort]
            rank = np.arange(len(byte)) - np.searchsorted(byte, byte)
            out[free[byte] + rank] = before
            np.add(free, np.bincount(byte, minlength=256), out=free)

    for c in np.flatnonzero(count):
        done = begin[c]
        while done < free[c]:  # larger suffixes of this bucket, in the order in which they arrive
            done, batch = free[c], out[done:free[c]].copy()
            induce(batch)
        induce(out[begin[c] + count[c] - small_count[c]:begin[c] + count[c]])
    return out


def repeated(segments: list[bytes]) -> np.ndarray:
    """For the segments laid out with a separator behind each: does the window at a place also start at another place."""
    data = np.frombuffer(bytes([SEPARATOR]).join([*segments, b""]), np.uint8)
    padded = np.concatenate([data, np.full(LENGTH + 8, SEPARATOR, np.uint8)])
    words = np.zeros(len(padded) - 7, np.uint64)
    for k in range(8):
        words = words << np.uint64(8) | padded[k:k + len(words)]
    order = suffix_array(data, words)
    a, b = order[:-1], order[1:]
    # a common prefix never reaches over a separator: such places stand before the last LENGTH bytes of their segment
    left = np.zeros(len(data) + 1, np.int32)
    size = np.array([len(s) for s in segments], np.int64)
    start = np.cumsum(size + 1) - size - 1
    np.add.at(left, start, 1)
    np.add.at(left, start + np.maximum(size - LENGTH + 1, 0), -1)
    whole = np.cumsum(left)[:-1] > 0
    both = whole[a] & whole[b]
    a, b = a[both], b[both]
    for at in range(0, LENGTH, 8):
        same = words[a + at] == words[b + at]
        a, b = a[same], b[same]
    out = np.zeros(len(data), bool)
    out[a] = True
    out[b] = True
    return out


def _ranges(mask: np.ndarray) -> list[tuple[int, int]]:
    edge = np.flatnonzero(np.diff(np.concatenate([[0], mask.astype(np.int8), [0]])))
    return list(zip(edge[::2].tolist(), edge[1::2].tolist()))


def _anchor_rows(docs: DataFrame) -> DataFrame:
    def run(batches):
        for batch in batches:
            low = 0
            while low < batch.num_rows:  # about a megabyte of texts at a time
                texts, size = [], 0
                while low + len(texts) < batch.num_rows and (not texts or size < 1 << 20):
                    texts.append((batch.column(1)[low + len(texts)].as_py() or "").encode())
                    size += len(texts[-1])
                ids = batch.column(0).slice(low, len(texts)).to_numpy()
                low += len(texts)
                text, lo, pick, span, f, h = anchors(texts)
                place = lo << 16 | pick << 8 | span
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (f, h, ids[text], place)], names=["f", "h", "rid", "place"])

    return ship(docs).select("rid", "text").mapInArrow(run, "f long, h long, rid long, place long")


def _segment_rows(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """The bytes of the wanted segments (f, h, n, rid, place)."""
    lists = wanted.groupBy("rid").agg(F.collect_list(F.struct("f", "h", "n", "hot", "place")).alias("wanted"))

    def run(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                text = batch.column(1)[k].as_py().encode()
                rid, out = batch.column(0)[k].as_py(), []
                for x in batch.column(2)[k].as_py():
                    lo, span = x["place"] >> 16, x["place"] & 255
                    out.append({**x, "rid": rid, "bytes": text[lo:lo + span + LENGTH]})
                yield pa.RecordBatch.from_pylist(out, arrow)

    arrow = pa.schema([("f", pa.int64()), ("h", pa.int64()), ("n", pa.int64()), ("hot", pa.bool_()), ("place", pa.int64()), ("rid", pa.int64()),
                       ("bytes", pa.binary())])
    joined = docs.join(lists.hint("merge"), "rid")
    return ship(joined).select("rid", "text", "wanted").mapInArrow(
        run, "f long, h long, n long, hot boolean, place long, rid long, bytes binary")


def _sorted_ranges(segments: DataFrame) -> DataFrame:
    """(rid, start, end) covered in the segments that occur once, by suffix arrays over all segments of an f."""
    def flush(rows):
        mask, at = repeated([r["bytes"] for r in rows]), 0
        out = []
        for r in rows:
            if r["n"] == 1:
                lo = r["place"] >> 16
                out += [(r["rid"], lo + a, lo + b - 1 + LENGTH) for a, b in _ranges(mask[at:at + len(r["bytes"])])]
            at += len(r["bytes"]) + 1
        rid, start, end = zip(*out) if out else ((), (), ())
        return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (rid, start, end)], names=["rid", "start", "end"])

    def run(batches):
        rows, size, last = [], 0, None
        for batch in batches:
            for r in batch.to_pylist():
                if size > SORT_BYTES and r["f"] != last:
                    yield flush(rows)
                    rows, size = [], 0
                rows.append(r)
                size += len(r["bytes"])
                last = r["f"]
        if rows:
            yield flush(rows)

    dealt = segments.repartition("f").sortWithinPartitions("f", "h")
    return ship(dealt).select("f", "n", "place", "rid", "bytes").mapInArrow(run, "rid long, start long, end long")


def _halves(digest: int) -> tuple[int, int]:
    return (digest >> 64) - (1 << 63), (digest & (1 << 64) - 1) - (1 << 63)


def _digests(data, ranges) -> list[pa.Array]:
    """Two columns: the 128-bit digests of these ranges of ``data``."""
    d = [_halves(xxhash.xxh3_128_intdigest(data[a:b])) for a, b in ranges]
    return [pa.array([x[k] for x in d], pa.int64()) for k in (0, 1)]


def _hot_blocks(segments: DataFrame) -> DataFrame:
    """Up to ``STRIDE`` neighbouring windows of a segment as one block, numbered by their distance to the pick.

    Blocks that hold equal windows have the same number and the same *core*, the bytes that all windows of the full block share; blocks
    with the same *piece* (all their bytes) hold the same windows.
    """
    def run(batches):
        for batch in batches:
            for f, n, place, rid, data in zip(*(batch.column(k).to_pylist() for k in range(5))):
                lo, pick, span = place >> 16, place >> 8 & 255, place & 255
                blocks, core = [], []
                for number in range((pick - span) // STRIDE, pick // STRIDE + 1):
                    first, last = max(0, pick - number * STRIDE - STRIDE + 1), min(span, pick - number * STRIDE)
                    blocks.append((first, last))
                    core.append((pick - number * STRIDE, pick - number * STRIDE - STRIDE + 1 + LENGTH))
                k = len(blocks)
                piece = [(a, b + LENGTH) for a, b in blocks]
                yield pa.RecordBatch.from_arrays(
                    [*_digests(data, piece), *_digests(data, core), pa.array([n] * k, pa.int64()), pa.array([rid] * k, pa.int64()),
                     pa.array([lo + a for a, _ in blocks], pa.int64()), pa.array([data[a:b] for a, b in piece], pa.binary())],
                    names=["p1", "p2", "c1", "c2", "n", "rid", "start", "bytes"])

    return ship(segments).select("f", "n", "place", "rid", "bytes").mapInArrow(
        run, "p1 long, p2 long, c1 long, c2 long, n long, rid long, start long, bytes binary")


def _block_windows(blocks: DataFrame) -> DataFrame:
    def run(batches):
        for batch in batches:
            for n, rid, start, data in zip(*(batch.column(k).to_pylist() for k in range(4))):
                k = len(data) - LENGTH + 1
                yield pa.RecordBatch.from_arrays(
                    [*_digests(data, [(i, i + LENGTH) for i in range(k)]), pa.array([n] * k, pa.int64()), pa.array([rid] * k, pa.int64()),
                     pa.array(range(start, start + k), pa.int64())], names=["d1", "d2", "n", "rid", "start"])

    return ship(blocks).select("n", "rid", "start", "bytes").mapInArrow(run, "d1 long, d2 long, n long, rid long, start long")


def _hot_ranges(segments: DataFrame) -> DataFrame:
    """The same for an f with very many segments, whose windows' digests are counted, block by block.

    All windows of a piece that occurs twice are repeated. Only blocks that share their core with a different piece can hold other
    repeated windows: one copy of each such piece is taken apart and its windows are counted.
    """
    blocks = materialize(_hot_blocks(segments), "hot-blocks")
    pieces = blocks.groupBy("c1", "c2", "p1", "p2").agg(F.sum("n").alias("n"), F.min(F.struct("rid", "start", "bytes")).alias("one"))
    pieces = materialize(pieces.select("c1", "c2", "p1", "p2", "n", "one.*"), "hot-pieces")
    twice = pieces.where("n > 1").select("p1", "p2").distinct()
    whole = blocks.where("n = 1").join(twice.hint("merge"), ["p1", "p2"], "left_semi")
    whole = whole.select("rid", "start", (F.col("start") + F.octet_length("bytes")).alias("end"))
    mixed = pieces.groupBy("c1", "c2").agg(F.count(F.lit(1)).alias("kinds")).where("kinds > 1")
    windows = materialize(_block_windows(pieces.join(mixed.hint("merge"), ["c1", "c2"], "left_semi")), "hot-windows")
    again = materialize(windows.groupBy("d1", "d2").agg(F.sum("n").alias("all")).where("all > 1").drop("all"), "hot-repeats")
    found = windows.where("n = 1").join(again.hint("merge"), ["d1", "d2"], "left_semi")
    return whole.unionAll(found.select("rid", "start", (F.col("start") + LENGTH).alias("end")))


def repeated_ranges(docs: DataFrame) -> DataFrame:
    """(rid, start, end) byte ranges, possibly overlapping, that cover all repeated windows of ``docs`` (rid, text)."""
    all_ = materialize(_anchor_rows(docs), "anchors")
    twice = materialize(all_.groupBy("f").agg(F.count(F.lit(1)).alias("n")).where("n > 1").drop("n"), "repeated-picks")
    rows = materialize(all_.join(twice.hint("merge"), "f", "left_semi"), "candidates")
    classes = materialize(rows.groupBy("f", "h").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("rid", "place")).alias("first"))
                          .select("f", "h", "n", "first.*"), "segments")
    kinds = classes.groupBy("f").agg(F.count(F.lit(1)).alias("kinds")).where("kinds > 1")
    wanted = classes.join(kinds.hint("merge"), "f").withColumn("hot", F.col("kinds") > HOT).drop("kinds")
    segments = materialize(_segment_rows(docs, wanted), "segment-bytes")
    again = classes.where("n > 1").select("f", "h")  # written, so the join on the right of it can split a hot segment
    copies = rows.join(again.hint("merge"), ["f", "h"], "left_semi")
    copies = copies.selectExpr("rid", "shiftright(place, 16) as start", f"shiftright(place, 16) + (place & 255) + {LENGTH} as end")
    sorted_ = _sorted_ranges(segments.where("not hot"))
    return copies.unionAll(sorted_).unionAll(_hot_ranges(segments.where("hot")))


def _cut(batches, names, text_at):
    for batch in batches:
        for low in range(0, batch.num_rows, 256):
            part = batch.slice(low, 256)
            sizes, spans, kept = [], [], []
            for text, ranges in zip(part.column("__text"), part.column("__ranges")):
                data = (text.as_py() or "").encode()
                cover = np.zeros(len(data) + 1, np.int32)
                if ranges.values is not None and len(ranges.values):
                    np.add.at(cover, ranges.values.field("start").to_numpy(), 1)
                    np.add.at(cover, ranges.values.field("end").to_numpy(), -1)
                mask = np.cumsum(cover[:-1]) > 0
                sizes.append(len(data))
                spans.append([{"start": a, "end": b} for a, b in _ranges(mask)])
                kept.append(np.frombuffer(data, np.uint8)[~mask].tobytes())
            cols = {"n_bytes": pa.array(sizes, pa.int64()), "kept": pa.array(kept, pa.binary()),
                    "spans": pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))}
            yield pa.RecordBatch.from_arrays([cols[n] if n in cols else part.column(n) for n in names], names=names)


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without its text, with n_bytes, spans (maximal removed byte runs) and kept (the remaining bytes)."""
    keep = [c for c in docs.columns if c not in ("n_bytes", "spans", "kept") and (c != text_col)]
    rows = docs.select(*keep, F.col(text_col).alias("__text"))
    ids = docs.select(F.col(id_col).alias("id")).groupBy("id").agg(F.count(F.lit(1)).alias("n")).where("n > 1 or id is null")
    if dict(docs.dtypes)[id_col] == "bigint" and ids.isEmpty():
        rows = rows.withColumn("__rid", F.col(id_col))
    else:
        rows = materialize(rows.withColumn("__rid", F.monotonically_increasing_id()), "numbered")
    plain = rows.select(F.col("__rid").alias("rid"), text_or_empty("__text").alias("text"))
    ranges = repeated_ranges(plain).groupBy("rid").agg(F.collect_list(F.struct("start", "end")).alias("__ranges"))
    ranges = materialize(ranges, "ranges").withColumnRenamed("rid", "__rrid")
    joined = rows.join(ranges.hint("merge"), F.col("__rid") == F.col("__rrid"), "left").select(*keep, "__text", "__ranges")
    span = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))
    schema = T.StructType([*(docs.schema[c] for c in keep), T.StructField("n_bytes", T.LongType()), T.StructField("spans", span),
                           T.StructField("kept", T.BinaryType())])
    names = schema.names
    return ship(joined).mapInArrow(lambda batches: _cut(batches, names, text_col), schema)
