"""Measures of predictions: each a plan of one aggregate, or of two where a measure is made of the matrix of labels and predictions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rillflow.operators.aggregate import confusion_matrix
from rillflow.operators.ordering import running


def _weight(weight: Column | None) -> Column:
    return F.lit(1.0) if weight is None else weight.cast("double")


def accuracy(df: DataFrame, label: str, prediction: str, weight: Column | None = None) -> DataFrame:
    """(accuracy, total weight n)."""
    w = _weight(weight)
    return df.agg((F.sum(F.when(F.col(label) == F.col(prediction), w).otherwise(0.0)) / F.sum(w)).alias("accuracy"), F.sum(w).alias("n"))


def precision_recall(df: DataFrame, label: Column, prediction: Column, weight: Column | None = None) -> DataFrame:
    """(tp, fp, fn, tn, precision, recall, f1) of boolean labels and predictions; 0 where nothing is predicted or labelled."""
    w = _weight(weight)
    part = lambda a, b, n: F.coalesce(F.sum(F.when((label == a) & (prediction == b), w)), F.lit(0.0)).alias(n)
    found = df.agg(part(True, True, "tp"), part(False, True, "fp"), part(True, False, "fn"), part(False, False, "tn"))
    share = lambda x, y: F.coalesce(F.try_divide(x, y), F.lit(0.0))
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return found.withColumns({"precision": share(tp, tp + fp), "recall": share(tp, tp + fn), "f1": share(2 * tp, 2 * tp + fp + fn)})


def auc(df: DataFrame, label: Column, score: str) -> DataFrame:
    """(auc): the chance that a positive row scores above a negative one, ties counting half: exact, by running counts over the distinct scores."""
    counted = df.groupBy(score).agg(F.sum(label.cast("int")).alias("_p"), F.sum((~label).cast("int")).alias("_n"))
    below = running(counted, "_n", [score], "_below", exclusive=True)
    sums = below.agg(F.sum(F.col("_p") * (F.col("_below") + F.col("_n") / 2)).alias("_won"), F.sum("_p").alias("_p"), F.sum("_n").alias("_n"))
    return sums.select(F.try_divide(F.col("_won"), F.col("_p") * F.col("_n")).alias("auc"))


def mean_iou(df: DataFrame, label: str, prediction: str) -> DataFrame:
    """(mean_iou): the mean over classes of hits by all rows that have the class as label or prediction."""
    cells = confusion_matrix(df, label, prediction)
    ends = cells.select(F.explode(F.array("label", "prediction")).alias("c"), "n", (F.col("label") == F.col("prediction")).alias("hit"))
    each = ends.groupBy("c").agg((F.sum(F.when(F.col("hit"), F.col("n")).otherwise(0)) / 2).alias("hit"), F.sum(F.when(F.col("hit"), F.col("n") / 2).otherwise(F.col("n"))).alias("any"))
    return each.agg(F.avg(F.col("hit") / F.col("any")).alias("mean_iou"))


def regression(df: DataFrame, label: str, prediction: str) -> DataFrame:
    """(mse, rmse, mae, r2)."""
    y, p = F.col(label).cast("double"), F.col(prediction).cast("double")
    sums = df.agg(F.avg((y - p) * (y - p)).alias("mse"), F.avg(F.abs(y - p)).alias("mae"), F.var_pop(y).alias("_v"))
    return sums.select("mse", F.sqrt("mse").alias("rmse"), "mae", (1 - F.try_divide(F.col("mse"), F.col("_v"))).alias("r2"))


def top_k_accuracy(df: DataFrame, predictions: Column, target: Column, k: int) -> DataFrame:
    """(accuracy): the share of rows whose target is among the k largest predictions."""
    from rillflow.operators.sort import in_top_k

    return df.agg(F.avg(in_top_k(predictions, target, k).cast("int")).alias("accuracy"))


def entropy(df: DataFrame, value: str) -> DataFrame:
    """(entropy): in nats, of the shares of a column's values."""
    counted = df.groupBy(value).agg(F.count(F.lit(1)).alias("_n"))
    sums = counted.agg(F.sum("_n").alias("_all"), F.sum(F.col("_n") * F.log("_n")).alias("_s"))
    return sums.select((F.log("_all") - F.col("_s") / F.col("_all")).alias("entropy"))
