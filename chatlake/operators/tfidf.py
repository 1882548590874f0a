"""Keyword ranking by TF-IDF (AGG1-5, AGG17, JN4, LIM3).

Rules (smoothed IDF with L2-normalised rows, then a corpus sum per term):
  n   = number of messages with non-null text (empty messages count)
  idf = ln((1 + n) / (1 + df)) + 1
  w   = tf * idf / ||tf * idf||_2 (per message)
  weight(term) = sum of w over messages

Plan shape: one pass over the texts makes a row per message, its array of (term, tf), inside the row: no text and no token is
ever shuffled. That table is written once. Blocks of these rows are turned into postings, a term once a block with the messages
it is in, so that what is grouped or joined by term is a fraction of the (message, term) pairs. Document frequency is a sum over
the postings, the corpus size a count of the messages. Terms of a single message all have the same idf, so only terms of two
messages or more make the idf table; it is measured and broadcast where it fits, else joined by sort-merge. The postings joined
with it give the squares, summed to one norm per message (written). Norm and array of a message meet in the one exchange of arrays,
keyed by message; tf / norm leaves it as partial sums per term, and the idf, the same for all of them, is multiplied in
at the end, once per term. Partition counts are Spark's own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chatlake.functions.text import FILE_PLACEHOLDER, KEPT_NO_COLON, KEPT_WITH_COLON, terms
from chatlake.session import broadcast_fits, materialize
from chatlake.sources.tables import spread


def tokens(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", group_cols=(),
           keep_colon: bool = True, stopwords: DataFrame | None = None) -> DataFrame:
    """One row per token occurrence: (group..., id, term). Stop words removed by an anti join."""
    t = docs.where(F.col(text_col).isNotNull()).select(*group_cols, id_col, F.explode(terms(text_col, keep_colon)).alias("term"))
    return without(t, stopwords)


def without(rows: DataFrame, stopwords: DataFrame | None) -> DataFrame:
    """``rows`` (term, ...) without the stop words; how the list is joined is left to its size."""
    return rows if stopwords is None else rows.join(stopwords.select("term"), "term", "left_anti")


#: Postings are made of blocks of messages with so many (message, term) pairs (a longer message is a block of its own).
BLOCK_PAIRS = 1_500_000
TERMS = "array<struct<term: string, tf: int>>"


def message_terms(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", group_cols=(), keep_colon: bool = True) -> DataFrame:
    """(group..., id, terms array<struct<term, tf>>): one row per message with a text, written to the shared folder.

    The terms are those of ``functions.text.terms``, counted by message in Arrow batches.
    """
    import re
    keys = [*group_cols, id_col]
    placeholder, kept = FILE_PLACEHOLDER, KEPT_WITH_COLON if keep_colon else KEPT_NO_COLON

    def count(batches):
        from collections import Counter

        import pyarrow as pa
        dropped = re.compile(f"[^{kept}]+")
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                b = whole.slice(at, 256)
                words, tfs, offsets = [], [], [0]
                for raw in b.column(len(keys)):
                    text = dropped.sub("", raw.as_buffer().to_pybytes().decode("utf-8", "replace").replace(placeholder, ""))
                    found = Counter(text.lower().replace(":", " ").split(" "))
                    for w, n in found.items():
                        if len(w) > 1:
                            words.append(w)
                            tfs.append(n)
                    offsets.append(len(words))
                pairs = pa.StructArray.from_arrays([pa.array(words, pa.string()), pa.array(tfs, pa.int32())], ["term", "tf"])
                lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pairs)
                yield pa.RecordBatch.from_arrays([*b.columns[:len(keys)], lists], [*keys, "terms"])

    texts = spread(docs.where(F.col(text_col).isNotNull()).select(*keys, text_col), id_col)
    schema = T.StructType([*texts.select(*keys).schema.fields, T.StructField("terms", T._parse_datatype_string(TERMS))])
    return materialize(texts.select(*keys, F.col(text_col).cast("binary").alias("_b")).mapInArrow(count, schema), "message-terms")


def _by_term(rows: DataFrame, keys, values, of, schema) -> DataFrame:
    """Blocks of ``rows`` (..., terms) grouped by (keys..., term) inside the task: ``of`` (list or sum) of each of ``values``; ``tf`` is divided by ``_norm`` where there is one."""
    limit, keys, values = BLOCK_PAIRS, list(keys), list(values)

    def group(batches):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc
        for whole in batches:
            ends = np.cumsum(pc.list_value_length(whole.column("terms")).to_numpy(zero_copy_only=False))
            at = 0
            while at < whole.num_rows:
                done = ends[at - 1] if at else 0
                to = max(at + 1, int(np.searchsorted(ends, done + limit, "right")))
                b = whole.slice(at, to - at)
                at = to
                pairs, row = b.column("terms").flatten(), pc.list_parent_indices(b.column("terms"))
                cols = {c: b.column(c).take(row) for c in b.schema.names if c != "terms"} | {"term": pairs.field(0), "tf": pairs.field(1)}
                if "_norm" in cols:
                    cols["tf"] = pc.divide(cols["tf"].cast(pa.float64()), cols["_norm"])
                out = pa.table(cols).group_by([*keys, "term"], use_threads=False).aggregate([(v, of) for v in values])
                yield from out.select([*keys, "term", *(f"{v}_{of}" for v in values)]).rename_columns(schema.names).combine_chunks().to_batches(max_chunksize=20_000)

    return rows.mapInArrow(group, schema)


def _postings(rows: DataFrame, keys, id_col: str) -> DataFrame:
    """(group..., term, ids, tfs): a row per term and block of messages, written to the shared folder."""
    fields = {f.name: f for f in rows.schema.fields}
    schema = T.StructType([*(fields[c] for c in keys), T.StructField("term", T.StringType()),
                           T.StructField("ids", T.ArrayType(fields[id_col].dataType)), T.StructField("tfs", T.ArrayType(T.IntegerType()))])
    return materialize(_by_term(rows, keys, [id_col, "tf"], "list", schema), "term-postings")


def term_frequencies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", group_cols=(),
                     keep_colon: bool = True, stopwords: DataFrame | None = None) -> DataFrame:
    """AGG1: (group..., id, term, tf)."""
    return _exploded(message_terms(docs, id_col, text_col, group_cols, keep_colon), [*group_cols, id_col], stopwords)


def _exploded(rows: DataFrame, keys, stopwords: DataFrame | None) -> DataFrame:
    t = rows.select(*keys, F.explode("terms").alias("_e")).select(*keys, "_e.term", "_e.tf")
    return without(t, stopwords)


def _common(postings: DataFrame, g) -> DataFrame:
    """(_c0..., _term, df) of the terms of two messages or more, to be joined as its measured size allows."""
    common = postings.groupBy(*g, "term").agg(F.sum(F.size("ids")).alias("df")).where("df > 1")
    common = materialize(common.toDF(*(f"_c{i}" for i in range(len(g))), "_term", "df"), "term-df")
    return F.broadcast(common) if broadcast_fits(common) else common.hint("shuffle_merge")


def _with_idf(t: DataFrame, common: DataFrame, rows: DataFrame, g) -> DataFrame:
    """``t`` (group..., term, ...) with the term's ``_idf`` among the messages ``rows``."""
    match = (F.col("term") == F.col("_term"))
    for i, c in enumerate(g):
        match &= F.col(c).eqNullSafe(F.col(f"_c{i}"))
    t = t.join(common, match, "left")
    if g:
        sizes = rows.groupBy(*(F.col(c).alias(f"_g{i}") for i, c in enumerate(g))).agg(F.count(F.lit(1)).alias("_n"))
        t = t.join(sizes, _same(g, "_g"))
        n = F.col("_n")
    else:  # one corpus: a scalar subquery over the written rows, no join
        n = rows.select(F.count(F.lit(1))).scalar()
    return t.withColumn("_idf", F.log((1 + n) / (1 + F.coalesce("df", F.lit(1)))) + 1)


def _same(cols, prefix: str):
    on = F.lit(True)
    for i, c in enumerate(cols):
        on &= F.col(c).eqNullSafe(F.col(f"{prefix}{i}"))
    return on


def _normed(docs: DataFrame, id_col: str, text_col: str, g, keep_colon: bool, stopwords: DataFrame | None):
    """(message terms, idf table, message terms with their message's norm)."""
    rows = message_terms(docs, id_col, text_col, g, keep_colon)
    postings = without(_postings(rows, g, id_col), stopwords)
    common = _common(postings, g)
    pairs = _with_idf(postings, common, rows, g).select(*g, "_idf", F.explode(F.arrays_zip("ids", "tfs")).alias("_e"))
    v = F.col("_e.tfs") * F.col("_idf")
    keys = [*g, id_col]
    norms = pairs.select(*g, F.col("_e.ids").alias(id_col), (v * v).alias("_v2")).groupBy(*keys).agg(F.sqrt(F.sum("_v2")).alias("_norm"))
    norms = materialize(norms.toDF(*(f"_k{i}" for i in range(len(keys))), "_norm"), "message-norms")
    return rows, common, rows.join(norms.hint("shuffle_merge"), _same(keys, "_k")).select(*keys, "_norm", "terms")


def tfidf(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", group_cols=(), keep_colon: bool = True,
          stopwords: DataFrame | None = None) -> DataFrame:
    """AGG1-3: normalised TF-IDF weight per (group..., id, term). Rows that repeat a group and id are one message."""
    g = list(group_cols)
    rows, common, normed = _normed(docs, id_col, text_col, g, keep_colon, stopwords)
    each = _with_idf(_exploded(normed, [*g, id_col, "_norm"], stopwords), common, rows, g)
    return each.select(*g, id_col, "term", (F.col("tf") * F.col("_idf") / F.col("_norm")).alias("w"))


def keyword_weights(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", group_cols=(),
                    keep_colon: bool = True, stopwords: DataFrame | None = None) -> DataFrame:
    """AGG4: corpus weight per term = sum of the normalised weights = idf * sum of tf / norm."""
    g = list(group_cols)
    rows, common, normed = _normed(docs, id_col, text_col, g, keep_colon, stopwords)
    schema = T.StructType([*(f for f in rows.schema.fields if f.name in g), T.StructField("term", T.StringType()), T.StructField("_part", T.DoubleType())])
    parts = _by_term(normed, g, ["tf"], "sum", schema)
    sums = without(parts.groupBy(*g, "term").agg(F.sum("_part").alias("_sum")), stopwords)
    return _with_idf(sums, common, rows, g).select(*g, "term", (F.col("_sum") * F.col("_idf")).alias("weight"))


def top_terms(weights: DataFrame, k: int = 100, group_cols=(), digits: int | None = 6) -> DataFrame:
    """LIM3 + AGG5: top ``k`` terms (weight desc, term asc) and weight relative to the best one.

    Ungrouped this plans as TakeOrderedAndProject; grouped as a window-group-limit.
    """
    r = (lambda c: F.round(c, digits)) if digits is not None else (lambda c: c)
    if not group_cols:
        top = weights.orderBy(F.desc("weight"), F.asc("term")).limit(k)
        # one window over the <= k kept rows (they are already in one partition after the limit)
        rel = F.col("weight") / F.max("weight").over(Window.partitionBy())
        return top.select("term", r(F.col("weight")).alias("weight"), r(rel).alias("rel_weight"))
    g = list(group_cols)
    w = Window.partitionBy(*g).orderBy(F.desc("weight"), F.asc("term"))
    ranked = weights.withColumn("rank", F.row_number().over(w).cast("bigint")).where(F.col("rank") <= k)
    rel = F.col("weight") / F.max("weight").over(Window.partitionBy(*g))
    return ranked.select(*g, "rank", "term", r(F.col("weight")).alias("weight"), r(rel).alias("rel_weight"))


def vocabulary_shape(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                     keep_colon: bool = True, stopwords: DataFrame | None = None,
                     exact: bool = True) -> DataFrame:
    """AGG17: (n_docs, n_terms) of the document-term matrix; ``exact=False`` uses a sketch."""
    n = docs.where(F.col(text_col).isNotNull()).select(F.count(F.lit(1))).scalar()
    t = tokens(docs, id_col, text_col, (), keep_colon, stopwords)
    if exact:
        vocab = t.select("term").distinct().agg(F.count(F.lit(1)).alias("n_terms"))
    else:
        vocab = t.agg(F.approx_count_distinct("term").alias("n_terms"))
    return vocab.select(n.alias("n_docs"), "n_terms")
