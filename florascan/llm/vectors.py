"""Integer vectors from embeddings: what the vector operators share."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Integer components stay within this; a component beyond it (x beyond 65,536 at a scale of 1,024) counts as the limit.
LIMIT = 1 << 26


def usable(embedding: Column) -> Column:
    """True for a vector that is there and holds finite numbers only."""
    bad = F.exists(embedding, lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == F.lit(float("inf"))))
    return embedding.isNotNull() & ~F.coalesce(bad, F.lit(False))


def scaled(embedding: Column, scale: int) -> Column:
    """floor(scale * x) of each component."""
    return F.transform(embedding, lambda x: F.greatest(F.least(F.floor(F.lit(float(scale)) * x.cast("double")), F.lit(LIMIT)), F.lit(-LIMIT)).cast("int"))


def integer_vectors(df: DataFrame, scale: int, vec_id: str, embedding: str, *more: Column) -> DataFrame:
    """(vec_id, v, more) of the rows with a usable vector."""
    e = F.col(embedding)
    return df.filter(usable(e)).select(F.col(vec_id).cast("long").alias("vec_id"), scaled(e, scale).alias("v"), *more)


def matrix(vectors: pd.Series, width: int) -> np.ndarray:
    """Rows of ``width`` numbers; shorter vectors end in zeros."""
    out = np.zeros((len(vectors), width), dtype=np.int64)
    if len({len(v) for v in vectors}) == 1 and len(vectors.iloc[0]) == width:
        out[:] = np.stack(vectors.to_list()) if width else 0
    else:
        for k, v in enumerate(vectors):
            out[k, : len(v)] = v
    return out


def nullable_ids(ids: pd.Series) -> tuple[np.ndarray, np.ndarray]:
    """The ids as 64-bit integers, and which of them are null (these read as the largest number, so they sort last)."""
    null = ids.isna().to_numpy()
    return np.array([np.iinfo(np.int64).max if n else int(v) for v, n in zip(ids, null)], dtype=np.int64), null
