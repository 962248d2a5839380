"""What the vector searches share: vectors as Arrow matrices, and the merging of partial results."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def usable(column: str) -> Column:
    """No null and no non-finite component, and not empty."""
    x = F.col(column)
    bad = F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    return x.isNotNull() & (F.size(x) > 0) & ~F.coalesce(bad, F.lit(True))


def matrix(column: pa.Array | pa.ChunkedArray, kind: type = np.float64) -> np.ndarray:
    """Lists of one length, without nulls, as rows of a matrix. Unequal lengths are an error."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    n = len(column)
    if not n:
        return np.zeros((0, 0), kind)
    lengths = pc.min_max(pc.list_value_length(column)).as_py()
    if lengths["min"] != lengths["max"]:
        raise ValueError("the vectors' lengths differ")
    return column.flatten().to_numpy(zero_copy_only=False).astype(kind).reshape(n, -1)


def same_length(a: np.ndarray, b: np.ndarray) -> None:
    """An error unless the vectors of two matrices, where both have any, are of one length."""
    if len(a) and len(b) and a.shape[1] != b.shape[1]:
        raise ValueError("the vectors' lengths differ")


def first_k(partial: DataFrame, k: int, ascending: bool) -> DataFrame:
    """(query_id, rank, vec_id, score) of the k best of each query's partial results; ties go to the smaller vec_id.

    Spark keeps each task's k best of a query before it shuffles them.
    """
    score = F.col("score").asc() if ascending else F.col("score").desc()
    order = Window.partitionBy("query_id").orderBy(score, F.col("vec_id").asc())
    return partial.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
