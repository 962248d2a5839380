"""Request-scoped gates in batch form. A request is a set of rows with one ``request_id``; ``request_count`` says how many belong to it.

Assumed, as no surviving source states it: batches never mix requests, and a request's last batch may be short.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rillflow.operators.ordering import numbered


def ingress(df: DataFrame, request: list[str], order: list[str], id_start: int = 0) -> DataFrame:
    """Tags every row with its request's id, by first occurrence in the order of ``request``, its count and its place ``ord``."""
    sizes = df.groupBy(*request).agg(F.count(F.lit(1)).alias("request_count"))
    ids = numbered(sizes, request, "request_id", id_start)
    return numbered(df, order, "ord", partition=request).join(ids, request)


def egress(df: DataFrame) -> DataFrame:
    """(request_id, n): requests of which all rows have come."""
    found = df.groupBy("request_id").agg(F.count(F.lit(1)).alias("n"), F.max("request_count").alias("request_count"))
    return found.where(F.col("n") == F.col("request_count")).select("request_id", "n")


def complete(df: DataFrame) -> DataFrame:
    """The rows of requests of which all rows have come, as ``egress`` tells, counted where a request's rows lie, so that ``df`` is gone through once."""
    whole = Window.partitionBy("request_id")
    counted = df.withColumn("_all", F.count(F.lit(1)).over(whole) == F.max("request_count").over(whole))
    return counted.where(F.col("_all") & F.col("request_id").isNotNull()).drop("_all")


def dequeue_many(df: DataFrame, size: int) -> DataFrame:
    """``df`` with ``batch``: batches of up to ``size`` rows of one request."""
    return numbered(df, ["ord"], "_pos", partition=["request_id"]).withColumn("batch", F.floor(F.col("_pos") / size)).drop("_pos")


def dequeue_partition(df: DataFrame, size: int) -> DataFrame:
    """A nested level: ``partition_id`` and ``partition_count`` (rows in it) of each row within its request."""
    parts = dequeue_many(df, size).withColumnRenamed("batch", "partition_id")
    return parts.withColumn("partition_count", F.count(F.lit(1)).over(Window.partitionBy("request_id", "partition_id")))


def open_requests(df: DataFrame) -> DataFrame:
    """(n): requests of which rows are missing."""
    found = df.groupBy("request_id").agg((F.count(F.lit(1)) < F.max("request_count")).alias("open"))
    return found.agg(F.count_if("open").alias("n"))


def rounds(df: DataFrame, most_open: int) -> DataFrame:
    """``df`` with ``round``: at most ``most_open`` requests are open at a time, admitted in the order of their ids; credits come back when all of a round are done."""
    ids = df.select("request_id").distinct()
    placed = numbered(ids, ["request_id"], "_at").withColumn("round", F.floor(F.col("_at") / most_open)).select(F.col("request_id").alias("_r"), "round")
    return df.join(placed, F.col("request_id") == F.col("_r")).drop("_r")


def num_rounds(df: DataFrame, most_open: int) -> DataFrame:
    """(n): the rounds that ``rounds`` needs."""
    return df.agg(F.ceil(F.count_distinct("request_id") / most_open).alias("n"))


def released_credits(df: DataFrame, most_open: int) -> DataFrame:
    """(round, supplied, released): the requests admitted in each round, and those of them that are complete, whose credits go back upstream."""
    found = df.groupBy("request_id").agg((F.count(F.lit(1)) == F.max("request_count")).alias("_done"))
    placed = numbered(found, ["request_id"], "_at").withColumn("round", F.floor(F.col("_at") / most_open))
    return placed.groupBy("round").agg(F.count(F.lit(1)).alias("supplied"), F.count_if("_done").alias("released"))


def closed(df: DataFrame, at: Column, cancel_pending: bool = False) -> DataFrame:
    """The rows that a gate lets in before it closes: those for which ``at`` (came after the close) is false. Pending requests, which can't be completed any more, go too if they are cancelled."""
    inside = df.where(~F.coalesce(at, F.lit(False)))
    return complete(inside) if cancel_pending else inside


def dequeue_whole(df: DataFrame, value: str | Column) -> DataFrame:
    """(request_id, items, n): each complete request as one row, its values in order. A request's rows meet in one row, so requests are what bounds it."""
    from rillflow.operators.window import gathered

    return complete(df).groupBy("request_id").agg(gathered(["ord"], value).alias("items"), F.count(F.lit(1)).alias("n"))


def pipeline(df: DataFrame, stages: list[tuple[str, int | None, Callable[[DataFrame], DataFrame]]], most_open: int | None = None) -> DataFrame:
    """A chain of gates: each stage takes what its gate lets out and keeps request_id, request_count and ord.

    A stage is (mode, batch_size, function): ``each`` row by row; ``batch`` with a column ``batch`` of rows of one request; ``whole`` only complete requests. With ``most_open``, column ``round`` tells when a request is admitted.
    """
    out = rounds(df, most_open) if most_open else df
    for mode, size, function in stages:
        if mode == "batch":
            out = dequeue_many(out, size)
        elif mode == "whole":
            out = complete(out)
        elif mode != "each":
            raise ValueError(f"unknown mode {mode}")
        out = function(out)
        if missing := {"request_id", "request_count", "ord"} - set(out.columns):
            raise ValueError(f"a stage dropped {sorted(missing)}")
    return out
