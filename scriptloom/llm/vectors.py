"""What the vector operators share: valid rows, vectors as matrices, blocks of rows as one row."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def is_valid(embedding: Column) -> Column:
    """Whether a vector takes part: not null, no null or non-finite component, not all zero."""
    finite = F.forall(embedding, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce(finite & F.exists(embedding, lambda x: x != 0), F.lit(False))


def matrix(column, width: int) -> np.ndarray:
    """Rows of an Arrow list column as a float64 matrix; vectors shorter than ``width`` are filled up with zeros."""
    lengths = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    if len(lengths) and (lengths == width).all():
        return flat.reshape(-1, width)
    out = np.zeros((len(lengths), width))
    ends = np.cumsum(lengths)
    for i, (e, n) in enumerate(zip(ends, lengths)):
        out[i, :n] = flat[e - n : e]
    return out


def width_of(valid: DataFrame, embedding: str) -> int:
    return valid.agg(F.max(F.size(embedding))).first()[0] or 1


def sample(valid: DataFrame, row_id: str, columns: list[str], rows: int) -> list:
    """About ``rows`` rows at most, the same in every run: those whose id's hash is low."""
    n = valid.count()
    if n > rows:
        valid = valid.where(F.pmod(F.xxhash64(row_id, F.lit(11)), F.lit(1 << 30)) < int((1 << 30) * (rows * 0.9) / n))
    return valid.select(*columns).orderBy(row_id).limit(rows).collect()
