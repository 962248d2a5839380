"""Random draws that a seed and a row's key decide: the same at any partitioning, and in any engine that has MD5.

A draw is a whole number below 2**32, the first eight digits of the MD5 of ``seed:key...``; distributions are made of such draws. Further draws of one row take further seeds.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

TOP = 1 << 32


def draw(seed: int | str | Column, *key: Column | str) -> Column:
    """A whole number in [0, 2**32)."""
    parts = [seed if isinstance(seed, Column) else F.lit(str(seed)), *[F.col(k) if isinstance(k, str) else k for k in key]]
    return F.conv(F.substring(F.md5(F.concat_ws(":", *[p.cast("string") for p in parts])), 1, 8), 16, 10).cast("long")


def unit(seed: int | str, *key: Column | str) -> Column:
    """A double in (0, 1): the middle of one of 2**32 equal parts."""
    return (draw(seed, *key) + F.lit(0.5)) / TOP


def uniform(low: float, high: float, seed: int, *key: Column | str) -> Column:
    return F.lit(low) + F.lit(high - low) * unit(seed, *key)


def uniform_int(low: int, high: int, seed: int, *key: Column | str) -> Column:
    """A whole number in [low, high), from the high bits of a draw."""
    return F.lit(low) + F.shiftright(draw(seed, *key) * F.lit(high - low), 32)


def normal(mean: float, deviation: float, seed: int, *key: Column | str) -> Column:
    """By Box and Muller, of two draws."""
    length = F.sqrt(F.lit(-2.0) * F.log(unit(f"{seed}a", *key)))
    return F.lit(mean) + F.lit(deviation) * length * F.cos(F.lit(2 * math.pi) * unit(f"{seed}b", *key))


def truncated_normal(mean: float, deviation: float, seed: int, *key: Column | str, tries: int = 12) -> Column:
    """The first of ``tries`` normal draws within two deviations; the mean, should there be none (one row in 10**15)."""
    draws = F.array(*[normal(0.0, 1.0, f"{seed}t{k}", *key) for k in range(tries)])
    return F.lit(mean) + F.lit(deviation) * F.coalesce(F.get(F.filter(draws, lambda x: F.abs(x) <= 2), F.lit(0)), F.lit(0.0))


def exponential(rate: float, seed: int, *key: Column | str) -> Column:
    return -F.log(unit(seed, *key)) / F.lit(rate)


def gamma(shape: int, rate: float, seed: int, *key: Column | str) -> Column:
    """For a whole ``shape``: the sum of so many exponential draws."""
    total = exponential(rate, f"{seed}g0", *key)
    for k in range(1, shape):
        total = total + exponential(rate, f"{seed}g{k}", *key)
    return total


def poisson(mean: float, seed: int, *key: Column | str) -> Column:
    """By the inverse of the distribution function, whose values up to a share of 2**-33 below 1 stand in the plan."""
    steps, p, total, k = [], math.exp(-mean), 0.0, 0
    while total < 1 - 2.0**-33 and k < 100 + 20 * mean:
        total += p
        steps.append(min(total, 1.0))
        k += 1
        p *= mean / k
    u = unit(seed, *key)
    return F.size(F.filter(F.array(*map(F.lit, steps)), lambda s: s < u)).cast("long")


def categorical(weights: list[float], seed: int, *key: Column | str) -> Column:
    """The number of a class, with chances in proportion to ``weights``."""
    total, bounds, at = sum(weights), [], 0.0
    for w in weights[:-1]:
        at += w
        bounds.append(int(at / total * TOP))
    d = draw(seed, *key)
    return F.size(F.filter(F.array(*map(F.lit, bounds)) if bounds else F.array().cast("array<bigint>"), lambda b: b <= d))


def multinomial(logits: list[float], samples: int, seed: int, *key: Column | str) -> Column:
    """An array of ``samples`` class numbers with chances in proportion to exp(logit)."""
    most = max(logits)
    weights = [math.exp(x - most) for x in logits]
    return F.array(*[categorical(weights, f"{seed}m{k}", *key) for k in range(samples)])


def log_uniform(classes: int, seed: int, *key: Column | str) -> Column:
    """A class below ``classes``; class k comes with a chance in proportion to log((k + 2) / (k + 1))."""
    return F.least(F.floor(F.exp(unit(seed, *key) * F.lit(math.log(classes + 1))) - 1), F.lit(classes - 1)).cast("long")
