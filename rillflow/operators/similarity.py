"""Hyperplane hashing, nearest centres, clustering and factorisation."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rillflow.functions.random import unit


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def sign_bits(vector: Column, planes: list[list[int]]) -> Column:
    """Bit k is set where the vector lies on the positive side of plane k."""
    bits = [F.when(dot(vector, F.array(*map(F.lit, p))) >= 0, F.lit(1 << k)).otherwise(0) for k, p in enumerate(planes)]
    out = bits[0]
    for b in bits[1:]:
        out = out + b
    return out.cast("long")


def probes(vector: Column, planes: list[list[int]], extra: int) -> Column:
    """The hash of ``sign_bits``, then those with one bit flipped, least certain bit first, ``extra`` of them."""
    products = [dot(vector, F.array(*map(F.lit, p))) for p in planes]
    base = sign_bits(vector, planes)
    flips = F.array_sort(F.array(*[F.struct(F.abs(d).alias("d"), F.lit(1 << k).cast("long").alias("b")) for k, d in enumerate(products)]))
    return F.concat(F.array(base), F.transform(F.slice(flips, 1, extra), lambda f: base.bitwiseXOR(f["b"])))


def squared_distance(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, x: s + x)


def nearest_centers(points: DataFrame, centers: list[tuple[int, list[float]]], vector: str, k: int, ties: str = "center") -> DataFrame:
    """Each point with its k nearest of a fixed list of centres: a scan of an array in the row, no join."""
    listed = F.array(*[F.struct(F.lit(i).alias("center"), F.array(*map(F.lit, c)).alias("at")) for i, c in centers])
    ranked = F.slice(F.array_sort(F.transform(listed, lambda c: F.struct(squared_distance(F.col(vector), c["at"]).alias("distance"), c["center"].alias("center")))), 1, k)
    return points.select("*", F.posexplode(ranked).alias("rank", "_c")).select("*", F.col("_c.center").alias("center"), F.col("_c.distance").alias("distance")).drop("_c")


def nearest_rows(points: DataFrame, others: DataFrame, point_id: str, other_id: str, vector: str, k: int, block: int = 256, parts: int = 64) -> DataFrame:
    """(point, rank, other, distance): for a stated query set ``points``, the k nearest of all ``others`` but rows of the same id.

    Queries are gathered into blocks of about ``block``, the others dealt into ``parts``; each block meets each part in a task that keeps k a query, by one matrix product. So what is shuffled
    is the two tables once for each block and part, and k rows a query and part. Distances of those kept are computed anew, exactly.
    """
    import numpy as np
    import pandas as pd

    blocks = max(1, math.ceil(points.count() / block))
    deal = lambda column, n, salt: F.pmod(F.xxhash64(column, F.lit(salt)), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    double = F.transform(vector, lambda x: x.cast("double"))
    asked = points.select(F.col(point_id).alias("id"), double.alias("v"), deal(point_id, blocks, 1).alias("block"), every(parts).alias("part"))
    held = others.select(F.col(other_id).alias("id"), double.alias("v"), every(blocks).alias("block"), deal(other_id, parts, 2).alias("part"))

    def run(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple] = []
        if len(a) and len(b):
            x, y, names = np.stack(a["v"]), np.stack(b["v"]), b["id"].to_numpy()
            rough = (x * x).sum(1)[:, None] + (y * y).sum(1)[None, :] - 2 * x @ y.T
            for q, mine in enumerate(a["id"].tolist()):
                near = np.flatnonzero(names != mine)
                if len(near) > k:
                    kth = np.partition(rough[q][near], k - 1)[k - 1]
                    near = near[rough[q][near] <= kth + 1e-9 * (1 + abs(kth) + (x[q] ** 2).sum())]
                exact = ((y[near] - x[q]) ** 2).sum(1)
                for j in np.lexsort((names[near], exact))[:k]:
                    out.append((mine, names[near][j], exact[j]))
        return pd.DataFrame(out, columns=["point", "other", "distance"])

    found = asked.groupBy("block", "part").cogroup(held.groupBy("block", "part")).applyInPandas(run, "point long, other long, distance double")
    window = Window.partitionBy("point").orderBy("distance", "other")
    return found.withColumn("rank", F.row_number().over(window)).where(F.col("rank") <= k)


def seeds(df: DataFrame, key: str, vector: str, k: int, seed: int = 1) -> DataFrame:
    """(center, key, vector): k starting centres far from each other: each is drawn with a chance in proportion to the squared distance from those before it.

    A draw gives every row the arrival time of an exponential wait at that rate and takes the first: one aggregate a centre, no row leaves its task but the least."""
    chosen: list[list[float]] = []
    spark, found = df.sparkSession, []
    for c in range(k):
        away = F.lit(1.0)
        if chosen:
            away = F.array_min(F.transform(F.array(*[F.array(*map(F.lit, v)) for v in chosen]), lambda at: squared_distance(F.col(vector), at)))
        due = F.when(away > 0, -F.log(unit(f"{seed}c{c}", key)) / away)
        row = df.agg(F.min_by(F.struct(F.col(key).alias("key"), F.transform(vector, lambda x: x.cast("double")).alias("v")), F.struct(due.isNull().alias("n"), due.alias("d"), F.col(key).alias("k"))).alias("s")).first()["s"]
        chosen.append(list(row["v"]))
        found.append((c, row["key"], list(row["v"])))
    return spark.createDataFrame(found, "center int, key long, vector array<double>")


def chain_seeds(points: list[float], draws: list[float]) -> int:
    """The point at which a Markov chain over ``points`` ends: from the first it goes on to each next one if its squared distance over that of the present one exceeds the draw."""
    at = 0
    for k in range(1, len(points)):
        if points[at] == 0 or points[k] / points[at] > draws[k - 1]:
            at = k
    return at


def partial_sides(ratings: DataFrame, row: str, col: str, value: str, factors: DataFrame, unobserved_weight: float, row_weight: float = 1.0) -> DataFrame:
    """(row, lhs, rhs): for a half step of weighted alternating least squares, the sums of each row's observed cells: outer products of the other side's factors, and factors times values.
    ``factors``: (id, factors). Cells that aren't observed count with their weight in a term common to all rows, which the caller adds once."""
    f = factors.select(F.col("id").alias("_id"), F.transform("factors", lambda x: x.cast("double")).alias("_f"))
    met = ratings.join(f, ratings[col] == F.col("_id"))
    cells = met.select(row, F.col(value).cast("double").alias("_v"), "_f").select(row, "_v", F.posexplode("_f").alias("i", "a"), "_f")
    left = cells.select(row, "i", F.posexplode("_f").alias("j", "b"), "a").groupBy(row, "i", "j").agg((F.sum(F.col("a") * F.col("b")) * row_weight).alias("x"))
    right = cells.groupBy(row, "i").agg((F.sum(F.col("a") * F.col("_v")) * (row_weight + unobserved_weight)).alias("x"))
    lhs = left.groupBy(row).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "j", "x"))), lambda s: s["x"]).alias("lhs"))
    rhs = right.groupBy(row).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias("rhs"))
    return lhs.join(rhs, row)


def gather_tree(steps: Column, parents: Column, end: int) -> Column:
    """The beams of a search, read back from their last step: ``steps`` and ``parents`` are arrays over time of arrays over beams. After a beam's first ``end`` the rest is ``end``."""
    times = F.reverse(F.sequence(F.lit(0), F.size(steps) - 1))

    def beam(b: Column) -> Column:
        state = F.aggregate(times, F.struct(b.alias("at"), F.slice(F.get(steps, F.lit(0)), 1, 0).alias("out")), lambda s, t: F.struct(F.get(F.get(parents, t), s["at"]).alias("at"), F.concat(F.array(F.get(F.get(steps, t), s["at"])), s["out"]).alias("out")))
        out = state["out"]
        first = F.array_position(out, F.lit(end))
        return F.when(first > 0, F.transform(out, lambda x, i: F.when(i >= first - 1, F.lit(end)).otherwise(x))).otherwise(out)

    return F.transform(F.sequence(F.lit(0), F.size(F.get(steps, F.lit(0))) - 1), beam)


def ctc_greedy(best: Column, blank: int, merge_repeated: bool = True) -> Column:
    """The labels of the likeliest classes over time, repeated ones merged and blanks taken out."""
    kept = F.filter(best, lambda x, i: (i == 0) | (x != F.get(best, i - 1))) if merge_repeated else best
    return F.filter(kept, lambda x: x != blank)


def kmeans(df: DataFrame, vector: str, k: int, seed: int = 1) -> DataFrame:
    """``df`` with ``cluster``, by k-means started with parallel seeding."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    data = df.withColumn("_v", array_to_vector(F.transform(vector, lambda x: x.cast("double"))))
    model = KMeans(k=k, seed=seed, featuresCol="_v", predictionCol="cluster", initMode="k-means||").fit(data)
    return model.transform(data).drop("_v")


def als(df: DataFrame, user: str, item: str, rating: str, rank: int = 4, seed: int = 1) -> DataFrame:
    """(id, factors) of the users, by alternating weighted least squares."""
    from pyspark.ml.recommendation import ALS

    return ALS(rank=rank, maxIter=3, seed=seed, userCol=user, itemCol=item, ratingCol=rating, nonnegative=False).fit(df).userFactors.select("id", F.col("features").alias("factors"))
