"""Numeric functions with the rounding, division and overflow rules of tensor programs."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F


def _quotient(a: Column, b: Column) -> Column:
    """The quotient of two integers, cut towards 0, in 64 bits throughout; null where ``b`` is 0."""
    return F.call_function("div", a, F.nullif(b, F.lit(0)))


def truncate_div(a: Column, b: Column) -> Column:
    """Towards 0, as in C. Integers only; 0 divides into null."""
    return _quotient(a, b)


def _uneven(a: Column, b: Column) -> Column:
    """There is a remainder, and its sign isn't that of ``b``."""
    rest = truncate_mod(a, b)
    return (rest != 0) & ((rest < 0) != (b < 0))


def floor_div(a: Column, b: Column) -> Column:
    """Towards minus infinity. Integers only; 0 divides into null."""
    return _quotient(a, b) - F.when(_uneven(a, b), 1).otherwise(0)


def truncate_mod(a: Column, b: Column) -> Column:
    return a % F.nullif(b, F.lit(0))


def floor_mod(a: Column, b: Column) -> Column:
    """With the sign of ``b``."""
    return truncate_mod(a, b) + F.when(_uneven(a, b), b).otherwise(0)


def div_no_nan(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a, b), F.lit(0.0))


def round_half_even(x: Column) -> Column:
    return F.rint(x)


def clip(x: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(x, F.lit(low)), F.lit(high))


def bucketize(x: Column, boundaries: list[float]) -> Column:
    """The number of boundaries that are not above x."""
    return F.size(F.filter(F.array(*map(F.lit, boundaries)), lambda b: b <= x))


def is_finite(x: Column) -> Column:
    return ~F.isnan(x) & (F.abs(x) != float("inf"))


def check_numerics(x: Column, message: str) -> Column:
    return F.when(is_finite(x), x).otherwise(F.raise_error(F.lit(message)).cast("double"))


def is_infinite(x: Column) -> Column:
    return F.abs(x) == float("inf")


# comparisons and logic with two values: what is unknown counts as unequal and false
def equal(a: Column, b: Column) -> Column:
    return a.eqNullSafe(b)


def approximately_equal(a: Column, b: Column, tolerance: float = 1e-5) -> Column:
    return F.coalesce(F.abs(a - b) < tolerance, F.lit(False))


def compare(a: Column, how: str, b: Column) -> Column:
    """``how``: <, <=, >, >=."""
    found = {"<": a < b, "<=": a <= b, ">": a > b, ">=": a >= b}[how]
    return F.coalesce(found, F.lit(False))


def logical(how: str, *columns: Column) -> Column:
    """and, or, not, xor of booleans."""
    known = [F.coalesce(c, F.lit(False)) for c in columns]
    if how == "not":
        return ~known[0]
    out = known[0]
    for c in known[1:]:
        out = {"and": lambda x, y: x & y, "or": lambda x, y: x | y, "xor": lambda x, y: x != y}[how](out, c)
    return out


def select(condition: Column, a: Column, b: Column) -> Column:
    """``a`` where the condition holds, else ``b``; of arrays, element by element."""
    return F.when(condition, a).otherwise(b)


def select_elements(condition: Column, a: Column, b: Column) -> Column:
    """For arrays of one length: ``a``'s element where the condition's element holds, else ``b``'s."""
    return F.transform(condition, lambda c, i: F.when(c, F.get(a, i)).otherwise(F.get(b, i)))


#: Types whose bits can be read as another's.
BITS = {"double": pa.float64(), "bigint": pa.int64(), "float": pa.float32(), "int": pa.int32(), "smallint": pa.int16(), "tinyint": pa.int8()}


def bitcast(x: Column, source: str, target: str) -> Column:
    """The bits of a value of type ``source`` read as ``target``, of the same width; a batch's buffer is looked at anew, nothing is copied."""
    if BITS[source].bit_width != BITS[target].bit_width:
        raise ValueError("the types' widths differ")
    kind = BITS[target]

    @F.arrow_udf(target)
    def run(values: pa.Array) -> pa.Array:
        return values.view(kind)

    return run(x)


def complex_(re: Column, im: Column) -> Column:
    return F.struct(re.cast("double").alias("re"), im.cast("double").alias("im"))


def complex_add(a: Column, b: Column) -> Column:
    return complex_(a["re"] + b["re"], a["im"] + b["im"])


def complex_mul(a: Column, b: Column) -> Column:
    return complex_(a["re"] * b["re"] - a["im"] * b["im"], a["re"] * b["im"] + a["im"] * b["re"])


def complex_div(a: Column, b: Column) -> Column:
    size = b["re"] * b["re"] + b["im"] * b["im"]
    found = complex_mul(a, conjugate(b))
    return complex_(found["re"] / size, found["im"] / size)


def conjugate(a: Column) -> Column:
    return complex_(a["re"], -a["im"])


def complex_abs(a: Column) -> Column:
    return F.hypot(a["re"], a["im"])


def angle(a: Column) -> Column:
    return F.atan2(a["im"], a["re"])


def fft(items: Column, inverse: bool = False) -> Column:
    """The discrete Fourier transform of an array of complex numbers; rows of one length are transformed together."""

    @F.arrow_udf("array<struct<re: double, im: double>>")
    def run(arrays: pa.Array) -> pa.Array:
        flat, sizes = arrays.flatten(), np.asarray(pc.fill_null(pc.list_value_length(arrays), 0), np.int64)
        if flat.null_count or any(c.null_count for c in flat.flatten()):
            raise ValueError("a complex number is null")
        re, im = (flat.field(k).to_numpy(zero_copy_only=False) for k in ("re", "im"))
        ends = np.cumsum(sizes)
        out = np.empty(len(re), complex)
        for n in np.unique(sizes[sizes > 0]).tolist():
            at = (ends[sizes == n] - n)[:, None] + np.arange(n)
            out[at] = (np.fft.ifft if inverse else np.fft.fft)(re[at] + 1j * im[at], axis=1)
        made = pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(out.real)), pa.array(np.ascontiguousarray(out.imag))], names=["re", "im"])
        return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), made, mask=arrays.is_null())

    return run(items)


def timestamp_seconds() -> Column:
    """The time now, in seconds since the epoch."""
    return F.unix_micros(F.current_timestamp()) / 1e6


def timestamp_micros() -> Column:
    """The time now, in whole microseconds since the epoch."""
    return F.unix_micros(F.current_timestamp())


def fact() -> Column:
    """The text that the example operator gives."""
    return F.lit("0! == 1")
