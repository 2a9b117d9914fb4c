"""What the two vector searches share: valid rows, and numpy matrices from Arrow lists."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftspark.llm.common import own_columns


def finite(vector: Column) -> Column:
    """Not null, and no component null, NaN or infinite."""
    inf = float("inf")
    ok = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (x != inf) & (x != -inf))
    return F.coalesce(vector.isNotNull() & ok, F.lit(False))


def valid(embeddings: DataFrame) -> DataFrame:
    """(vec_id, v, dim) of the rows that take part: an id and a whole vector; components as doubles."""
    rows = own_columns(embeddings, "vec_id", "embedding").where("vec_id is not null and embedding is not null")
    rows = rows.where(finite(F.col("embedding")))
    return rows.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>").alias("v"), F.size("embedding").alias("dim"))


def matrix(column: pa.ChunkedArray | pa.Array, dim: int) -> np.ndarray:
    """Lists of one length as the rows of a matrix."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks)
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), dim)
