"""Sparse matrices as coordinate rows (row, col, v)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def to_dense(coo: DataFrame, rows: int, cols: int, default: Column) -> DataFrame:
    """(row, items): every row as an array of ``cols`` values."""
    cells = coo.groupBy("row").agg(F.map_from_entries(F.collect_list(F.struct("col", "v"))).alias("_m"))
    grid = coo.sparkSession.range(rows).select(F.col("id").alias("row"))
    get = lambda j: F.coalesce(F.try_element_at(F.col("_m"), j), default)
    return grid.join(cells, "row", "left").select("row", F.transform(F.sequence(F.lit(0).cast("long"), F.lit(cols - 1).cast("long")), get).alias("items"))


def fill_empty_rows(coo: DataFrame, rows: int, default: Column) -> DataFrame:
    """``coo`` with (row, 0, default) for each row that has none; ``was_empty`` marks them."""
    grid = coo.sparkSession.range(rows).select(F.col("id").alias("row"))
    return grid.join(coo, "row", "left").select("row", F.coalesce("col", F.lit(0)).alias("col"), F.coalesce("v", default).alias("v"), F.col("v").isNull().alias("was_empty"))


def sliced(coo: DataFrame, start: tuple[int, int], size: tuple[int, int]) -> DataFrame:
    inside = coo.where(F.col("row").between(start[0], start[0] + size[0] - 1) & F.col("col").between(start[1], start[1] + size[1] - 1))
    return inside.select((F.col("row") - start[0]).alias("row"), (F.col("col") - start[1]).alias("col"), "v")


def reshaped(coo: DataFrame, cols: int, new_cols: int) -> DataFrame:
    at = F.col("row") * cols + F.col("col")
    return coo.select(F.floor(at / new_cols).alias("row"), (at % new_cols).alias("col"), "v")


def combined(a: DataFrame, b: DataFrame, how: str = "add") -> DataFrame:
    """Cell by cell: add, max or min; a missing cell is 0."""
    x, y = a.toDF("row", "col", "_a"), b.toDF("row", "col", "_b")
    left, right = F.coalesce("_a", F.lit(0)), F.coalesce("_b", F.lit(0))
    v = {"add": left + right, "max": F.greatest(left, right), "min": F.least(left, right)}[how]
    return x.join(y, ["row", "col"], "full").select("row", "col", v.alias("v"))


def softmax(coo: DataFrame) -> DataFrame:
    """Over the cells that each row has."""
    window = Window.partitionBy("row")
    shifted = coo.withColumn("_e", F.exp(F.col("v") - F.max("v").over(window)))
    return shifted.select("row", "col", (F.col("_e") / F.sum("_e").over(window)).alias("v"))


def reduced(coo: DataFrame, keep: str, how: str = "sum") -> DataFrame:
    return coo.groupBy(keep).agg((F.sum if how == "sum" else F.max)("v").alias("v"))


def concatenated(parts: list[tuple[DataFrame, int]]) -> DataFrame:
    """Along the columns: each part with its number of columns."""
    out, offset = None, 0
    for coo, cols in parts:
        part = coo.select("row", (F.col("col") + offset).alias("col"), "v")
        out, offset = part if out is None else out.unionByName(part), offset + cols
    return out


def band(coo: DataFrame, lower: int, upper: int) -> DataFrame:
    """Cells within ``lower`` diagonals below and ``upper`` above the main one; below 0: all."""
    off = F.col("row") - F.col("col")
    return coo.where((F.lit(lower < 0) | (off <= lower)) & (F.lit(upper < 0) | (-off <= upper)))


def row_slices(coo: DataFrame) -> DataFrame:
    """(row, cells): each row's cells in order, one row of the matrix a row."""
    return coo.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("col", "v"))).alias("cells"))


def reordered(coo: DataFrame) -> DataFrame:
    """The cells in row-major order, with their place ``at``."""
    from rillflow.operators.ordering import numbered

    return numbered(coo, ["row", "col"], "at")


def split(coo: DataFrame, cols: int, parts: int) -> list[DataFrame]:
    """``parts`` matrices of neighbouring columns; the first ones get one more where they don't divide evenly."""
    small, extra = divmod(cols, parts)
    out, at = [], 0
    for k in range(parts):
        width = small + (k < extra)
        out.append(coo.where(F.col("col").between(at, at + width - 1)).select("row", (F.col("col") - at).alias("col"), "v"))
        at += width
    return out


def serialized(coo: DataFrame, key: str, keys: DataFrame | None = None) -> DataFrame:
    """(key, cells): each sparse value as one array of (row, col, v), in order: a form to store. ``keys`` (key) names all values, so that one without cells is stored, too: as an empty array."""
    cells = coo.select(key, F.struct("row", "col", "v").alias("_c"))
    if keys is not None:
        cells = cells.unionByName(keys.select(key, F.lit(None).cast(cells.schema["_c"].dataType).alias("_c")))
    return cells.groupBy(key).agg(F.array_sort(F.collect_list("_c")).alias("cells"))


def deserialized(stored: DataFrame, key: str, handles: DataFrame | None = None) -> DataFrame:
    """(key, row, col, v); of stored values named by ``handles`` only, which may repeat: then (handle_pos, ...), and a handle without a value is an error."""
    if handles is None:
        return stored.select(key, F.explode("cells").alias("c")).select(key, "c.*")
    found = handles.select("handle_pos", F.col(key).alias("_h")).join(stored.withColumn("_there", F.lit(True)), F.col("_h") == F.col(key), "left")
    cells = F.when(F.col("_there"), F.col("cells")).otherwise(F.raise_error(F.lit("no value of that handle")))
    return found.select("handle_pos", F.explode(cells).alias("c")).select("handle_pos", "c.*")


def diag(vector: DataFrame) -> DataFrame:
    """(row, col, v) of a diagonal matrix from (i, v)."""
    return vector.select(F.col("i").alias("row"), F.col("i").alias("col"), "v")


def diag_part(coo: DataFrame) -> DataFrame:
    return coo.where(F.col("row") == F.col("col")).select(F.col("row").alias("i"), "v")


def set_diag(coo: DataFrame, vector: DataFrame) -> DataFrame:
    """With the diagonal replaced by ``vector`` (i, v) wherever it has a value."""
    rest = coo.join(vector.select(F.col("i").alias("_i")), (F.col("row") == F.col("_i")) & (F.col("col") == F.col("_i")), "left_anti")
    return rest.unionByName(diag(vector))


def transposed(coo: DataFrame) -> DataFrame:
    return coo.select(F.col("col").alias("row"), F.col("row").alias("col"), "v")


def times_dense(coo: DataFrame, dense: DataFrame, how: str = "mul") -> DataFrame:
    """Cell by cell with a dense matrix (row, col, d): mul, div or add, at the cells that ``coo`` has."""
    met = coo.join(dense, ["row", "col"])
    v = {"mul": F.col("v") * F.col("d"), "div": F.col("v") / F.col("d"), "add": F.col("v") + F.col("d")}[how]
    return met.select("row", "col", v.alias("v"))
