"""Word statistics over message texts (AGG6-11, STRF5, SRT3, AGG18).

Every statistic is an aggregate with a map-side partial step, so a hot chat or user is
combined before the shuffle. Percentiles over word counts are exact: the buffer holds one
entry per *distinct* count, which is bounded by the longest message, not by the row count.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chatlake.functions.text import clean_text, sorted_words, terms, words_count
from chatlake.operators.tfidf import without


def term_counts(docs: DataFrame, text_col: str = "text", stopwords: DataFrame | None = None,
                keep_colon: bool = False) -> DataFrame:
    """AGG6: corpus count of each term after cleaning and stop-word removal (unigrams)."""
    t = without(docs.select(F.explode(terms(text_col, keep_colon)).alias("term")), stopwords)
    return t.groupBy("term").agg(F.count(F.lit(1)).alias("n"))


def with_words_count(docs: DataFrame, text_col: str = "text", out: str = "words_count") -> DataFrame:
    """UD3 / STRF5 as a column."""
    return docs.withColumn(out, words_count(text_col))


def words_summary(docs: DataFrame, text_col: str = "text", group_cols=(), q: float = 0.99,
                  exact: bool = True) -> DataFrame:
    """AGG9-10: message count, mean words per message and the ``q`` quantile (linear interpolation)."""
    wc = words_count(text_col)
    pct = F.percentile(wc, F.lit(q)) if exact else F.percentile_approx(wc, q, 10000)
    return docs.groupBy(*group_cols).agg(F.count(F.lit(1)).alias("n_messages"),
                                         F.round(F.avg(wc), 6).alias("mean_words"),
                                         F.round(pct, 6).alias("p99_words"))


def words_histogram(docs: DataFrame, text_col: str = "text", bins: int = 10) -> DataFrame:
    """AGG11: equal-width histogram between min and max; the maximum falls in the last bin.

    The texts are read once: messages are first counted per distinct word count (a partial
    aggregate whose size is bounded by the longest message), and both the bounds and the bins
    are computed from that small table.
    """
    per_count = (docs.select(words_count(text_col).alias("wc"))
                 .groupBy("wc").agg(F.count(F.lit(1)).alias("_n")))
    # per_count has one row per distinct word count (at most the longest message's length), so a
    # window over all of it is bounded; it keeps the texts to one pass (a subquery would re-split)
    whole = Window.partitionBy()
    bounds = F.struct(F.min("wc").over(whole).alias("lo"), F.max("wc").over(whole).alias("hi"))
    d = per_count.select("wc", "_n", bounds.alias("_b"))
    lo, span = F.col("_b.lo"), F.col("_b.hi") - F.col("_b.lo")
    b = F.when(span == 0, F.lit(1)).otherwise(F.least(F.floor((F.col("wc") - lo) * bins / span) + 1, F.lit(bins)))
    return (d.groupBy(b.cast("int").alias("bucket"), F.col("_b").alias("_b"))
            .agg(F.sum("_n").alias("n"))
            .select("bucket", F.round(F.col("_b.lo") + (F.col("bucket") - 1) * (F.col("_b.hi") - F.col("_b.lo"))
                                      / bins, 6).alias("bucket_start"), "n"))


def corpus_chars(docs: DataFrame, text_col: str = "text", sep_len: int = 2) -> DataFrame:
    """AGG8: characters of all non-null texts joined by a ``sep_len`` separator, without building it."""
    return docs.agg((F.coalesce(F.sum(F.length(text_col)), F.lit(0))
                     + sep_len * F.greatest(F.count(text_col) - 1, F.lit(0))).alias("n_chars"),
                    F.count(text_col).alias("n_messages"))


def concat_texts(df: DataFrame, key_cols, order_col: str, text_col: str = "text",
                 sep: str = "\n\n", bucket_size: int = 1024) -> DataFrame:
    """AGG7: one string per group, texts in ``order_col`` order, nulls skipped.

    Two levels, so a hot group (one huge chat) is not sorted and joined by one task: texts are
    first joined per (group, order bucket of ``bucket_size`` positions), in parallel, then the
    bucket strings are joined in bucket order. The result is inherently one value per group
    (that is the feature); it is never built over the whole corpus.
    """
    keys = list(key_cols)
    sep_sql = sep.replace("\\", "\\\\").replace("'", "\\'").replace("\n", "\\n")
    part = (df.withColumn("_bucket", F.floor(F.col(order_col) / bucket_size))
            .groupBy(*keys, "_bucket")
            .agg(F.expr(f"listagg(`{text_col}`, '{sep_sql}') WITHIN GROUP (ORDER BY `{order_col}`)").alias("_s"),
                 F.count(text_col).alias("_n")))
    return (part.groupBy(*keys)
            .agg(F.expr(f"listagg(_s, '{sep_sql}') WITHIN GROUP (ORDER BY _bucket)").alias("all_text"),
                 F.sum("_n").alias("n_parts")))


def sorted_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """SRT3 over cleaned text (no colon), as the notebook prepares TF-IDF input."""
    return docs.where(F.col(text_col).isNotNull()).select(
        id_col, sorted_words(clean_text(text_col, keep_colon=False)).alias("sorted_text"))


def rows_per_unit(df: DataFrame, group_cols, unit: int = 1) -> DataFrame:
    """AGG18: rows per group divided by a unit size."""
    return df.groupBy(*group_cols).agg((F.count(F.lit(1)) / F.lit(unit)).alias("rows_per_unit"))
