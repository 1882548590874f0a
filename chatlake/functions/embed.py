"""UD5: text -> vector on the executors with an Arrow-batched pandas UDF.

``embed_fn`` takes a pandas Series of texts and returns a list of float vectors; it is called
once per Arrow batch, never per row. The hashing embedder here is deterministic and needs no
model, so tests and offline runs work; a real model client is passed in the same way.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def hashing_embedder(dim: int = 64):
    """Hashed bag of words (crc32 of each lower-cased token -> one of ``dim`` counts), L2-normalised.

    Counts only add, so a non-empty text never cancels to the zero vector.
    """
    import re
    import zlib

    tok = re.compile(r"\w\w+", re.UNICODE)

    def embed(texts: pd.Series) -> list:
        out = []
        for t in texts:
            v = np.zeros(dim, dtype=np.float64)
            for w in tok.findall((t or "").lower()):
                v[zlib.crc32(w.encode("utf-8")) % dim] += 1.0
            n = np.linalg.norm(v)
            out.append((v / n if n else v).astype(np.float32).tolist())
        return out

    return embed


def embed_column(text: str | Column, embed_fn) -> Column:
    """An ``array<float>`` column computed by ``embed_fn`` over Arrow batches.

    Call ``chatlake.session.ship_package(spark)`` first when ``embed_fn`` lives in this package
    and the workers cannot import it.
    """
    @F.pandas_udf(T.ArrayType(T.FloatType()))
    def _embed(s: pd.Series) -> pd.Series:
        return pd.Series(embed_fn(s))

    return _embed(F.col(text) if isinstance(text, str) else text)
