"""Exact top-k search by inner product: norm-sorted vectors, SVD-rotated partial sums, Cauchy-Schwarz bounds.

Vectors hold whole numbers, ``floor(scale * x)`` of the input. Rotating by the right singular vectors of the whole table
(from its Gram matrix, summed over the tasks) keeps inner products and moves their weight into the leading
coordinates. Vectors are range-sorted by descending length and packed into chunks of ``CHUNK`` rows; queries
into blocks of ``BLOCK`` rows.

1. Every query meets the chunk of the longest vectors; its k-th best score there is its first threshold.
2. A (chunk, query block) pair is scored only if the longest vector times the longest query reaches the smallest
   threshold of the block: |q||v| bounds the product.
3. Inside a pair, vectors are taken ``STEP`` at a time by descending length; after each of a few leading groups of
   coordinates a candidate survives only if partial sum + |rest of q||rest of v| reaches the query's threshold; survivors
   are scored exactly in whole numbers, and the thresholds rise.
4. The k best of all pairs, ties to the smaller id.

Bounds are widened by ``SLACK`` of |q||v|, far above the rounding of the rotation, so pruning never loses a result. Scores are exact: where products
may pass 2**53 they are computed with Python integers, and scores outside the 64-bit range are set to its ends.

Defined results: a vector that is null, has no id or holds a null or non-finite component takes no part; rows equal
in id and vector take part once, other rows that repeat an id each (a query's results are the k best of all its rows); a shorter vector counts as padded with
zeros; a query with fewer than k candidates gets them all; no queries or no vectors give no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chatlake.llm.common import materialize, ship

CHUNK, BLOCK, STEP = 4096, 1024, 512
LEADING = (0.25, 0.5)  # shares of the coordinates after which candidates are pruned
SLACK = 1e-9
_PACKED = "n long, longest double, ids binary, vectors binary"


def whole_vectors(vectors: DataFrame, id_col: str, vector_col: str, scale: int) -> DataFrame:
    """(id, v array<double> of whole numbers, norm2), one row per id and vector that takes part."""
    good = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("x"))
    rows = rows.where(F.col("id").isNotNull() & F.col("x").isNotNull() & F.forall("x", good))
    whole = F.transform("x", lambda x: F.floor(x * F.lit(float(scale))).cast("double"))
    rows = rows.distinct().select("id", whole.alias("v"))
    return rows.withColumn("norm2", F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x))


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    out = np.zeros((len(column), dim))
    for i, v in enumerate(column):
        a = v.values.to_numpy(zero_copy_only=False)
        out[i, :len(a)] = a
    return out


def rotation(rows: DataFrame, dim: int) -> np.ndarray:
    """Right singular vectors of the table, leading first; tasks send dim * dim sums, whatever they read."""
    def run(batches):
        gram = np.zeros((dim, dim))
        for batch in batches:
            m = _matrix(batch.column(0), dim)
            gram += m.T @ m
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(dim * dim)), pa.array(gram.ravel())], names=["place", "s"])

    sums = ship(rows).select("v").mapInArrow(run, "place long, s double").groupBy("place").agg(F.sum("s").alias("s"))
    gram = np.zeros(dim * dim)
    for place, s in sums.collect():  # dim * dim numbers
        gram[place] = s
    return np.ascontiguousarray(np.linalg.eigh(gram.reshape(dim, dim))[1][:, ::-1])


def pack(rows: DataFrame, dim: int, size: int) -> DataFrame:
    """Rows in their partition's order, ``size`` at a time, as one row of bytes."""
    def run(batches):
        ids, vs = np.empty(0, np.int64), np.empty((0, dim))

        def packed(i, v):
            longest = float(np.sqrt((v * v).sum(1).max()))
            return pa.RecordBatch.from_arrays([pa.array([len(i)]), pa.array([longest]), pa.array([i.tobytes()], pa.binary()),
                                               pa.array([v.tobytes()], pa.binary())], names=["n", "longest", "ids", "vectors"])
        for batch in batches:
            ids = np.append(ids, batch.column(0).to_numpy())
            vs = np.concatenate([vs, _matrix(batch.column(1), dim)])
            while len(ids) >= size:
                yield packed(ids[:size], vs[:size])
                ids, vs = ids[size:], vs[size:]
        if len(ids):
            yield packed(ids, vs)

    return ship(rows).select("id", "v").mapInArrow(run, _PACKED)


def _exact(q: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Row-wise inner products of whole numbers."""
    if not len(q) or np.abs(q).max() * np.abs(v).max() * q.shape[1] < 2 ** 53:
        return np.einsum("ij,ij->i", q, v).astype(np.int64)
    exact = (sum(int(a) * int(b) for a, b in zip(x, y)) for x, y in zip(q, v))
    return np.array([min(max(s, -2 ** 63), 2 ** 63 - 1) for s in exact], np.int64)


def best(qids, q, ids, v, threshold, turn, k):
    """(query row, id, score) of each query's k best among ``v`` that reach its threshold."""
    dim = q.shape[1]
    qr, vr = q @ turn, v @ turn
    cuts = sorted({max(1, int(dim * s)) for s in LEADING if dim} | {dim}) if dim else [0]
    rest = lambda m, c: np.sqrt((m[:, c:] ** 2).sum(1))
    qn, vn = rest(qr, 0), rest(vr, 0)
    top = np.array(threshold, float)
    kept = (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64))
    for low in range(0, len(v), STEP):
        part = slice(low, low + STEP)
        live = np.flatnonzero(qn * vn[part].max() * (1 + SLACK) >= top)  # vectors come by descending length
        if not len(live):
            break
        bound = None
        i, j = None, None
        for a, c in zip([0, *cuts], cuts):
            tail = rest(qr, c), rest(vr[part], c)
            if bound is None:
                partial = qr[live, :c] @ vr[part, :c].T
                bound = partial + tail[0][live, None] * tail[1][None, :]
                ok = bound >= top[live, None] - SLACK * qn[live, None] * vn[part][None, :] - 1e-6
                ok &= qids[live, None] != ids[part][None, :]
                x, j = np.nonzero(ok)
                i, s = live[x], partial[x, j]
            else:
                s = s + np.einsum("ij,ij->i", qr[i, a:c], vr[low + j, a:c])
                ok = s + tail[0][i] * tail[1][j] >= top[i] - SLACK * qn[i] * vn[low + j] - 1e-6
                i, j, s = i[ok], j[ok], s[ok]
        score = _exact(q[i], v[low + j])
        i, j, score = (np.concatenate(x) for x in zip(kept, (i, ids[low + j], score)))
        order = np.lexsort((j, -score.astype(object) if len(score) and score.min() == -2 ** 63 else -score, i))
        i, j, score = i[order], j[order], score[order]
        first = np.searchsorted(i, i)
        place = np.arange(len(i)) - first
        last = place == k - 1
        top[i[last]] = np.maximum(top[i[last]], score[last].astype(float))
        kept = tuple(x[place < k] for x in (i, j, score))
    return kept


def _unpack(row: dict, name: str, dim: int):
    return np.frombuffer(row[f"{name}_ids"], np.int64), np.frombuffer(row[f"{name}_vectors"]).reshape(-1, dim)


def _scores(pairs: DataFrame, turn: np.ndarray, dim: int, k: int) -> DataFrame:
    def run(batches):
        for batch in batches:
            for n in range(batch.num_rows):
                row = {name: batch.column(name)[n].as_py() for name in batch.schema.names}
                (qids, q), (ids, v) = _unpack(row, "q", dim), _unpack(row, "c", dim)
                threshold = np.frombuffer(row["thresholds"]) if row.get("thresholds") else np.full(len(qids), -np.inf)
                i, j, score = best(qids, q, ids, v, threshold, turn, k)
                yield pa.RecordBatch.from_arrays([pa.array(qids[i]), pa.array(j), pa.array(score)], names=["query_id", "id", "score"])

    return ship(pairs).mapInArrow(run, "query_id long, id long, score long")


def _with_thresholds(blocks: DataFrame, longest: DataFrame, turn: np.ndarray, dim: int, k: int) -> DataFrame:
    """Query blocks with each query's k-th best score in the chunk of the longest vectors, and the least of these."""
    def run(batches):
        for batch in batches:
            for n in range(batch.num_rows):
                row = {name: batch.column(name)[n].as_py() for name in batch.schema.names}
                (qids, q), (ids, v) = _unpack(row, "q", dim), _unpack(row, "c", dim)
                i, _, score = best(qids, q, ids, v, np.full(len(qids), -np.inf), turn, k)
                top = np.full(len(qids), -np.inf)
                last = np.arange(len(i)) - np.searchsorted(i, i) == k - 1
                top[i[last]] = score[last]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([row["block"]]), pa.array([row["q_longest"]]), pa.array([float(top.min())]), pa.array([row["q_ids"]], pa.binary()),
                     pa.array([row["q_vectors"]], pa.binary()), pa.array([top.tobytes()], pa.binary())],
                    names=["block", "q_longest", "least", "q_ids", "q_vectors", "thresholds"])

    both = blocks.withColumn("one", F.lit(1)).join(F.broadcast(longest.withColumn("one", F.lit(1))), "one").drop("one")  # one chunk
    return ship(both).mapInArrow(run, "block long, q_longest double, least double, q_ids binary, q_vectors binary, thresholds binary")


def top_k(vectors: DataFrame, is_query: Column, k: int = 5, scale: int = 256, id_col: str = "vec_id",
          vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the k largest inner products of each row of ``vectors`` that ``is_query`` selects.

    ``is_query`` is a condition on the column ``id``.
    """
    spark = vectors.sparkSession
    rows = materialize(whole_vectors(vectors, id_col, vector_col, scale), "topk-vectors")
    dim = rows.agg(F.max(F.size("v"))).first()[0]
    if dim is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    turn = rotation(rows, dim)
    name = lambda df, p: df.select(F.monotonically_increasing_id().alias({"c": "chunk", "q": "block"}[p]),
                                   *(F.col(c).alias(f"{p}_{c}") for c in ("longest", "ids", "vectors")))
    chunks = materialize(name(pack(rows.orderBy(F.col("norm2").desc(), "id"), dim, CHUNK), "c"), "topk-chunks")
    blocks = materialize(name(pack(rows.where(is_query).orderBy("id"), dim, BLOCK), "q"), "topk-blocks")
    longest = chunks.orderBy(F.col("c_longest").desc(), "chunk").limit(1).drop("chunk")
    blocks = materialize(_with_thresholds(blocks, longest, turn, dim, k), "topk-queries")
    # heads of chunks meet the numbers of the blocks, then the blocks' heads; only pairs within the bound remain
    numbers = blocks.select("block", "q_longest", "least").withColumn("number", F.row_number().over(Window.orderBy("block")))
    count = blocks.count()
    heads = chunks.select("chunk", "c_longest", F.explode(F.sequence(F.lit(1), F.lit(count))).alias("number")) if count else None
    if heads is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    heads = heads.join(numbers, "number")
    heads = heads.where(F.col("c_longest") * F.col("q_longest") * (1 + SLACK) + 1e-6 >= F.col("least")).select("chunk", "block")
    pairs = heads.join(chunks.select("chunk", "c_ids", "c_vectors"), "chunk").join(blocks.select("block", "q_ids", "q_vectors", "thresholds"), "block")
    found = _scores(pairs.select("c_ids", "c_vectors", "q_ids", "q_vectors", "thresholds"), turn, dim, k)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "id"))
    out = found.withColumn("rank", rank).where(F.col("rank") <= k)
    return out.select("query_id", "rank", F.col("id").alias("vec_id"), "score")
