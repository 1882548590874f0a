"""Text chunking (UD4, PRJ8-9, UD2/STRF7) as a per-row fold in built-in higher-order functions.

Splitter rules (character lengths):
  1. split on the separator, drop empty pieces; a piece longer than chunk_size stays whole;
  2. for each piece d: when the current list is non-empty and joined+sep+d would exceed
     chunk_size, emit the joined list, then drop pieces from its left until what remains is
     at most ``overlap`` long and d fits next to it (or nothing remains); append d;
  3. emit what is left. Emitted texts are stripped at both ends and dropped when empty.

The fold runs inside one row (one document), so chunking is a narrow, map-only stage: no
shuffle, no Python, whole texts.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chatlake.functions.text import PY_WHITESPACE_CHARS

CHUNK_SIZE = 1024
CHUNK_OVERLAP = 256
SEPARATOR = "\n\n"


def strip_py(c: Column) -> Column:
    """Python ``str.strip()``: remove leading and trailing whitespace (no regex: ``btrim``)."""
    return F.btrim(c, F.lit(PY_WHITESPACE_CHARS))


def split_text(text, chunk_size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP,
               separator: str = SEPARATOR) -> Column:
    """array<string> of chunks for one text.

    The fold state is (emitted chunks, pieces of the current chunk, joined length of those
    pieces); carrying the length makes the usual step O(1). On an overflow the kept overlap is
    the longest suffix of the current pieces that is within ``overlap`` and leaves room for the
    new piece; both limits only tighten as the suffix grows, so one pass from the right finds it.
    """
    t = F.col(text) if isinstance(text, str) else text
    sep_len = len(separator)
    pieces = F.filter(F.split(t, re.escape(separator)), lambda x: x != "")
    empty = F.array().cast("array<string>")
    init = F.struct(empty.alias("docs"), empty.alias("cur"), F.lit(0).alias("clen"))

    def kept_suffix(cur, ld):
        """(k, length) of the longest admissible suffix of ``cur`` for a new piece of length ``ld``."""
        def take(a, x):
            L = F.when(a["k"] == 0, F.length(x)).otherwise(a["L"] + sep_len + F.length(x))
            ok = ~a["stop"] & (L <= overlap) & (L + sep_len + ld <= chunk_size)
            return F.struct(F.when(ok, a["k"] + 1).otherwise(a["k"]).alias("k"),
                            F.when(ok, L).otherwise(a["L"]).alias("L"), (~ok).alias("stop"))
        start = F.struct(F.lit(0).alias("k"), F.lit(0).alias("L"), F.lit(False).alias("stop"))
        return F.aggregate(F.reverse(cur), start, take)

    def step(acc, d):
        cur, docs, clen = acc["cur"], acc["docs"], acc["clen"]
        n = F.size(cur)
        ld = F.length(d)
        overflow = (n > 0) & (clen + sep_len + ld > chunk_size)
        emitted = strip_py(F.array_join(cur, separator))
        docs2 = F.when(overflow & (F.length(emitted) > 0), F.concat(docs, F.array(emitted))).otherwise(docs)
        suf = kept_suffix(cur, ld)
        k, klen = suf["k"], suf["L"]
        kept = F.when(overflow, F.slice(cur, n - k + 1, k)).otherwise(cur)
        kept_len = F.when(overflow, klen).otherwise(clen)
        new_len = F.when(F.size(kept) > 0, kept_len + sep_len + ld).otherwise(ld)
        return F.struct(docs2.alias("docs"), F.concat(kept, F.array(d)).alias("cur"), new_len.alias("clen"))

    def finish(acc):
        last = strip_py(F.array_join(acc["cur"], separator))
        return F.when(F.length(last) > 0, F.concat(acc["docs"], F.array(last))).otherwise(acc["docs"])

    return F.aggregate(pieces, init, step, finish)


def chunk_documents(docs: DataFrame, id_cols=("doc_id",), text_col: str = "text",
                    chunk_size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP,
                    separator: str = SEPARATOR, keep_cols=()) -> DataFrame:
    """One row per chunk: (ids..., keep..., chunk_idx, chunk, n_chars)."""
    ids = list(id_cols) + list(keep_cols)
    return (docs.where(F.col(text_col).isNotNull())
            .select(*ids, F.posexplode(split_text(text_col, chunk_size, overlap, separator))
                    .alias("chunk_idx", "chunk"))
            .withColumn("chunk_idx", F.col("chunk_idx").cast("bigint"))
            .withColumn("n_chars", F.length("chunk").cast("bigint")))


def chunk_id(*cols) -> Column:
    """Deterministic id of a chunk, so re-running an import adds no new row (Q10)."""
    return F.xxhash64(*[F.col(c) if isinstance(c, str) else c for c in cols])
