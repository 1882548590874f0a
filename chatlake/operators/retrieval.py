"""Vector retrieval: exact top-k per query inside a namespace, dedupe, context assembly
(JN5-6, MTH3, FLT9-10, WIN3, LIM4-5, SRT2, SET2-3, SET6, AGG19).

Plan: a query only meets the vectors of its own namespace, never all pairs. The query side is written and
measured first; where it fits, the vectors are scored in place by blocks and a task sends on its best k per query, so a hot
namespace never ships more. The top-k is a row_number window, which Spark plans with a partial limit before the shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TOP_K = 5
RETRIEVER_K = 4
SCORE_THRESHOLD = 0.6
# Fixed value: the instruction appended after the retrieved texts.
CONTEXT_TAIL = 'Carefully analyze relevant documents provided above and just say "OK"'


def _c(c):
    return F.col(c) if isinstance(c, str) else c


def as_double(vec) -> Column:
    return _c(vec).cast("array<double>")


def dot(a, b) -> Column:
    return F.aggregate(F.zip_with(_c(a), _c(b), lambda x, y: x * y), F.lit(0.0), lambda s, p: s + p)


def norm(v) -> Column:
    return F.sqrt(dot(v, v))


def normalize(v) -> Column:
    """Unit vector (done once at write time makes scoring one dot product)."""
    n = norm(v)
    return F.when(n > 0, F.transform(_c(v), lambda x: x / n)).otherwise(_c(v))


def relevance(cos: Column) -> Column:
    """MTH3: cosine in [-1, 1] -> relevance in [0, 1]."""
    return (F.lit(1.0) + cos) / F.lit(2.0)


def centroids(vectors: DataFrame, ns_col: str, vec_col: str = "embedding") -> DataFrame:
    """Mean vector per namespace, unit-normalised: (ns, qvec); whole vectors are averaged by a partial aggregate."""
    from pyspark.ml.functions import array_to_vector, vector_to_array
    from pyspark.ml.stat import Summarizer
    mean = vectors.groupBy(ns_col).agg(Summarizer.mean(array_to_vector(as_double(vec_col))).alias("_m"))
    return mean.select(ns_col, vector_to_array("_m").alias("qvec")).withColumn("qvec", normalize("qvec"))


def score(queries: DataFrame, vectors: DataFrame, on: str | list, qvec: str = "qvec",
          vec_col: str = "embedding", id_col: str = "vec_id", keep=(), k: int | None = None, threshold: float | None = None) -> DataFrame:
    """JN5: the vectors in each query's namespace (the columns ``on``) with their relevance; with ``k`` only those that can be
    among the query's best ``k`` (of at least ``threshold``).

    The query side is written and measured. Where it fits it goes to the tasks, and the vectors are read once, in place: a batch is a
    matrix, its namespaces' queries another, one product scores them, and a task keeps its best ``k`` per query so far. Beyond
    the bound both sides are joined on the namespace (Spark splits a hot one), scored pair by pair.
    ``keep`` names vector columns carried along (metadata such as source, date, text). A zero vector scores null.
    """
    from chatlake.session import broadcast_fits, materialize
    on = [on] if isinstance(on, str) else list(on)
    v = vectors.select(*on, id_col, *keep, as_double(vec_col).alias("_v"))
    q = materialize(queries, "search_queries")
    if k is not None and broadcast_fits(q):
        return _score_blocks(q, v, on, qvec, id_col, list(keep), k, threshold)
    q = q.withColumn("_qnorm", norm(qvec)).hint("shuffle_merge")
    j = q.join(v.withColumn("_vnorm", norm("_v")), on)
    cos = F.try_divide(dot(qvec, "_v"), F.col("_qnorm") * F.col("_vnorm"))
    return j.withColumn("score", relevance(cos)).drop("_v", "_qnorm", "_vnorm")


def _score_blocks(queries: DataFrame, vectors: DataFrame, on: list, qvec: str, id_col: str, keep: list, k: int, threshold: float | None) -> DataFrame:
    """Each task's best ``k`` vectors per query, from Arrow batches; ``queries`` is measured to be small."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute  # noqa: F401
    from pyspark.sql import types as T

    named = [f for f in queries.schema.fields if f.name not in on]
    schema = T.StructType([*(vectors.schema[c] for c in [*on, id_col, *keep]), *named, T.StructField("score", T.DoubleType())])
    table = queries.where(F.forall(_c(qvec), lambda x: x.isNotNull())).toArrow().combine_chunks()  # below the broadcast bound; no vector, no hits
    asked = [np.array(x, float) for x in table[qvec].to_pylist()]
    by: dict = {}  # (namespace, dimension) -> query rows
    for row, key in enumerate(zip(*(table[c].to_pylist() for c in on))):
        by.setdefault((key, len(asked[row])), []).append(row)
    blocks = {key: np.array([asked[r] for r in rows]) for key, rows in by.items()}
    lengths = {key: np.sqrt((m ** 2).sum(1)) for key, m in blocks.items()}

    def run(batches):
        best: dict = {}  # query row -> (scores, ids, one-row columns)
        for batch in batches:
            keys = list(zip(*(batch.column(c).to_pylist() for c in on)))
            lists = batch.column("_v")
            sizes = pa.compute.list_value_length(lists).to_pylist()
            places: dict = {}
            for i, key in enumerate(zip(keys, sizes)):
                if key in by and None not in key[0]:
                    places.setdefault(key, []).append(i)
            for key, rows in places.items():
                x = lists.take(pa.array(rows)).flatten().to_numpy(zero_copy_only=False).reshape(len(rows), -1)
                size = np.sqrt((x ** 2).sum(1))
                with np.errstate(divide="ignore", invalid="ignore"):
                    score = (1 + x @ blocks[key].T / (size[:, None] * lengths[key])) / 2
                for n, query in enumerate(by[key]):
                    s = score[:, n]
                    good = np.flatnonzero(~np.isnan(s) if threshold is None else s >= threshold)
                    if not len(good):
                        continue
                    part = batch.take(pa.array(np.array(rows)[good])).append_column("_s", pa.array(s[good]))
                    part = pa.Table.from_batches([part]).select([*on, id_col, *keep, "_s"])
                    if query in best:
                        part = pa.concat_tables([best[query], part])
                    best[query] = part.take(pa.compute.sort_indices(part, [("_s", "descending"), (id_col, "ascending")])[:k]).combine_chunks()
        for query, part in best.items():
            cols = [*(part[c] for c in [*on, id_col, *keep]), *(pa.chunked_array([table[f.name].take(pa.array([query] * len(part))).combine_chunks()]) for f in named), part["_s"]]
            yield from pa.table(cols, names=schema.names).combine_chunks().to_batches()

    return vectors.mapInArrow(run, schema)


def top_k(scored: DataFrame, k: int = TOP_K, threshold: float | None = SCORE_THRESHOLD,
          key: str = "query_id", id_col: str = "vec_id") -> DataFrame:
    """FLT9 + LIM4 + SRT2: hits at or above the threshold, best k per query (ties by id)."""
    s = scored if threshold is None else scored.where(F.col("score") >= threshold)
    w = Window.partitionBy(key).orderBy(F.desc("score"), F.asc(id_col))
    return s.withColumn("rank", F.row_number().over(w).cast("bigint")).where(F.col("rank") <= k)


def with_documents(hits: DataFrame, docs: DataFrame, key: str = "vec_id") -> DataFrame:
    """JN6: every hit with its document's columns (left-join semantics; ``key`` unique in ``docs``).

    A left join could only broadcast the document side, so at scale it would shuffle all the
    documents. Instead the hits are measured and, when they fit, broadcast into an inner join:
    the documents are read in place. The matched rows are written (they are no more than the
    hits), and hits without a document are added back by an anti join of two small tables.
    """
    from chatlake.session import bounded_broadcast, materialize
    h, small = bounded_broadcast(hits, "hits")
    if not small:
        return h.join(docs, key, "left")
    matched = materialize(docs.join(h, key), "hits_matched")
    unmatched = h.join(matched.select(key).distinct(), key, "left_anti")
    columns = [key, *(c for c in hits.columns if c != key), *(c for c in docs.columns if c != key)]
    return matched.unionByName(unmatched, allowMissingColumns=True).select(*columns)  # as the left join has them


def best_per_source(hits: DataFrame, key: str = "query_id", source: str = "source",
                    id_col: str = "vec_id") -> DataFrame:
    """FLT10 + WIN3 + SET3: hits without a source are skipped; the best hit per source stays."""
    w = Window.partitionBy(key, source).orderBy(F.desc("score"), F.asc(id_col))
    return (hits.where(F.col(source).isNotNull())
            .withColumn("_r", F.row_number().over(w)).where(F.col("_r") == 1).drop("_r"))


def assemble_context(hits: DataFrame, key: str = "query_id", text_col: str = "page_content",
                     sep: str = "\n\n", tail: str | None = None, answer: Column | None = None) -> DataFrame:
    """AGG19 + SET2 (+ SET6 with ``answer`` and ``tail``): distinct texts of a query's hits, best first, then
    the query's answer (an expression over its key; a null answer is empty) and the closing line,
    joined by a blank line. At most k texts per query are collected (bounded)."""
    d = hits.groupBy(key, text_col).agg(F.min("rank").alias("_r"))
    texts = F.transform(F.array_sort(F.collect_list(F.struct("_r", text_col))), lambda s: s[text_col])
    if answer is not None:
        texts = F.concat(texts, F.array(F.coalesce(answer, F.lit(""))))
    if tail is not None:
        texts = F.concat(texts, F.array(F.lit(tail)))
    return d.groupBy(key).agg(F.count(F.lit(1)).alias("n_docs"), F.array_join(texts, sep).alias("context"))
