"""Array functions: shape, padding, indicators, shifts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def one_hot(x: Column, depth: int, on: float = 1.0, off: float = 0.0) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(depth - 1)), lambda i: F.when(i == x, on).otherwise(off))


def multi_hot(ids: Column, depth: int) -> Column:
    """How often each id of the array occurs."""
    return F.transform(F.sequence(F.lit(0), F.lit(depth - 1)), lambda i: F.size(F.filter(ids, lambda x: x == i)))


def roll(items: Column, shift: int) -> Column:
    """Shifted to the right around the end; an empty array stays."""
    n = F.size(items)
    cut = n - F.pmod(F.lit(shift), F.greatest(n, F.lit(1)))
    return F.concat(F.slice(items, cut + 1, n), F.slice(items, F.lit(1), cut))


def strided_slice(items: Column, start: int, end: int, stride: int = 1) -> Column:
    return F.filter(items, lambda v, i: (i >= start) & (i < end) & ((i - start) % stride == 0))


def pad(items: Column, before: int, after: int, value: Column) -> Column:
    return F.concat(F.array_repeat(value, before), items, F.array_repeat(value, after))


def mirror_pad(items: Column, before: int, after: int, symmetric: bool = False) -> Column:
    """Mirrored at the ends, the end itself repeated if ``symmetric``."""
    skip = 0 if symmetric else 1
    n = F.size(items)
    head = F.reverse(F.slice(items, 1 + skip, before))
    tail = F.reverse(F.slice(items, n - after - skip + 1, F.lit(after)))
    return F.concat(head, items, tail)


def tile(items: Column, count: int) -> Column:
    return F.flatten(F.array_repeat(items, count))


def where_indices(items: Column) -> Column:
    return F.filter(F.transform(items, lambda v, i: F.when(v, i)), lambda i: i.isNotNull())


def linspace(start: float, stop: float, count: int) -> Column:
    step = (stop - start) / (count - 1) if count > 1 else 0.0
    return F.transform(F.sequence(F.lit(0), F.lit(count - 1)), lambda i: F.lit(start) + i * step)


def unravel(index: Column, dims: list[int]) -> list[Column]:
    """The place of a flat index in each dimension, row-major."""
    out, rest = [], index
    for d in reversed(dims):
        out.append(rest % d)
        rest = F.floor(rest / d)
    return out[::-1]


def ensure_size(items: Column, size: int) -> Column:
    return F.when(F.size(items) == size, items).otherwise(F.raise_error(F.lit(f"array must have {size} elements")))


def split_sizes(items: Column, sizes: list[int]) -> list[Column]:
    out, at = [], 1
    for n in sizes:
        out.append(F.slice(items, at, n))
        at += n
    return out


# columns and arrays
def pack(*columns: Column) -> Column:
    """The values of columns as one array."""
    return F.array(*columns)


def unpack(items: Column, count: int) -> list[Column]:
    """The elements of an array of ``count``, as columns; another size is an error."""
    checked = ensure_size(items, count)
    return [F.get(checked, F.lit(k)) for k in range(count)]


def concat(*items: Column, axis: int = 0) -> Column:
    """Arrays end to end; on axis 1 the rows of nested arrays, which must be as many in each."""
    if not axis:
        return F.concat(*items)
    same = F.lit(True)
    for other in items[1:]:
        same = same & (F.size(other) == F.size(items[0]))
    rows = F.transform(items[0], lambda row, i: F.concat(row, *[F.get(o, i) for o in items[1:]]))
    return F.when(same, rows).otherwise(F.raise_error(F.lit("arrays to concatenate differ in rows")))


def split_even(items: Column, parts: int) -> list[Column]:
    """``parts`` pieces of one size; a size that they don't divide is an error."""
    each = F.when(F.size(items) % parts == 0, F.floor(F.size(items) / parts).cast("int")).otherwise(F.raise_error(F.lit(f"array doesn't split into {parts}")).cast("int"))
    return [F.slice(items, each * k + 1, each) for k in range(parts)]


# shapes, row-major
def shape(items: Column, rank: int) -> Column:
    """The sizes of a nested array of ``rank`` levels, read along its first elements."""
    sizes, at = [], items
    for _ in range(rank):
        sizes.append(F.coalesce(F.size(at), F.lit(0)))
        at = F.get(at, F.lit(0))
    return F.array(*sizes)


def flattened(items: Column, rank: int) -> Column:
    for _ in range(rank - 1):
        items = F.flatten(items)
    return items


def reshape(items: Column, dims: list[int], rank: int = 1) -> Column:
    """A nested array of ``rank`` levels laid out anew with ``dims``, one of which may be -1: what is left. A size that doesn't fit is an error."""
    if dims.count(-1) > 1:
        raise ValueError("one dimension at most can be -1")
    flat = flattened(items, rank)
    known = 1
    for d in dims:
        known *= d if d >= 0 else 1
    n = F.size(flat)
    fits = (n % max(known, 1) == 0) if -1 in dims else (n == known)
    out = F.when(fits, flat).otherwise(F.raise_error(F.lit(f"array doesn't fit shape {dims}")))
    for d in reversed(dims[1:]):
        size = F.lit(d) if d >= 0 else F.floor(n / known).cast("int")
        out = chunks_of(out, size)
    return out


def chunks_of(items: Column, size: Column) -> Column:
    """Consecutive pieces of ``size`` elements."""
    count = F.floor(F.size(items) / size).cast("int")
    return F.transform(F.when(count > 0, F.sequence(F.lit(0), count - 1)).otherwise(F.array().cast("array<int>")), lambda i: F.slice(items, i * size + 1, size))


def transpose(rows: Column) -> Column:
    """Rows for columns of a nested array."""
    width = F.coalesce(F.size(F.get(rows, F.lit(0))), F.lit(0))
    return F.transform(F.when(width > 0, F.sequence(F.lit(0), width - 1)).otherwise(F.array().cast("array<int>")), lambda j: F.transform(rows, lambda row: F.get(row, j)))


def expand_dims(items: Column) -> Column:
    """One level of nesting more, of one element."""
    return F.array(items)


def squeeze(items: Column) -> Column:
    """The only element of an outer level; another size is an error."""
    return F.get(ensure_size(items, 1), F.lit(0))


# fills
def fill(count: int | Column, value: Column) -> Column:
    return F.array_repeat(value, count)


def like(items: Column, value: Column) -> Column:
    """An array of the size of ``items`` that holds ``value`` throughout: zeros and ones of another's shape."""
    return F.transform(items, lambda _: value)


def broadcast_to(items: Column, rows: int) -> Column:
    """``rows`` rows, each of them ``items``."""
    return F.array_repeat(items, rows)


def repeat_each(items: Column, count: int) -> Column:
    return F.flatten(F.transform(items, lambda x: F.array_repeat(x, count)))


# matrices as nested arrays
def diag(items: Column, zero: Column) -> Column:
    """A square matrix with ``items`` on its diagonal."""
    return F.transform(items, lambda x, i: F.transform(items, lambda _, j: F.when(i == j, x).otherwise(zero)))


def diag_part(rows: Column) -> Column:
    return F.filter(F.transform(rows, lambda row, i: F.get(row, i)), lambda x: x.isNotNull())


def set_diag(rows: Column, items: Column) -> Column:
    return F.transform(rows, lambda row, i: F.transform(row, lambda x, j: F.when((i == j) & (i < F.size(items)), F.get(items, i)).otherwise(x)))


def band_part(rows: Column, lower: int, upper: int, zero: Column) -> Column:
    """Zero beyond ``lower`` diagonals below and ``upper`` above the main one; below 0: none is cut."""
    inside = lambda i, j: (F.lit(lower < 0) | (i - j <= lower)) & (F.lit(upper < 0) | (j - i <= upper))
    return F.transform(rows, lambda row, i: F.transform(row, lambda x, j: F.when(inside(i, j), x).otherwise(zero)))


def matmul(a: Column, b: Column) -> Column:
    """The product of two nested arrays of one row."""
    columns = transpose(b)
    return F.transform(a, lambda row: F.transform(columns, lambda column: F.aggregate(F.zip_with(row, column, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)))


def gather_nd(items: Column, indices: Column, rank: int) -> Column:
    """The elements of a nested array at ``indices``, an array of arrays of ``rank`` places each; a place out of range is an error."""

    def one(place: Column) -> Column:
        at = items
        for k in range(rank):
            at = F.element_at(at, F.get(place, F.lit(k)) + 1)
        return at

    return F.transform(indices, one)


# growable lists
def push_back(items: Column, value: Column) -> Column:
    return F.array_append(items, value)


def pop_back(items: Column) -> tuple[Column, Column]:
    """(the list without its last element, that element); an empty list is an error."""
    n = F.when(F.size(items) > 0, F.size(items)).otherwise(F.raise_error(F.lit("pop from an empty list")).cast("int"))
    return F.slice(items, F.lit(1), n - 1), F.element_at(items, n)


def set_item(items: Column, index: int, value: Column) -> Column:
    """With the element at ``index`` replaced; out of range is an error."""
    inside = F.size(items) > index
    return F.when(inside, F.transform(items, lambda x, i: F.when(i == index, value).otherwise(x))).otherwise(F.raise_error(F.lit("index out of range")))


def gather(items: Column, indices: Column) -> Column:
    return F.transform(indices, lambda i: F.element_at(items, i.cast("int") + 1))


def scatter(indices: Column, values: Column, size: int, default: Column) -> Column:
    """A list of ``size`` with ``values`` at ``indices``, the later of equal ones, and ``default`` elsewhere."""
    last = lambda i: F.array_max(F.transform(indices, lambda x, at: F.when(x == i, at)))
    return F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda i: F.coalesce(F.get(values, last(i)), default))


# optional values: a struct that holds one, or null
def some(value: Column) -> Column:
    return F.struct(value.alias("value"))


def has_value(optional: Column) -> Column:
    return optional.isNotNull()


def get_value(optional: Column) -> Column:
    """The value; an error if there is none."""
    return F.when(optional.isNotNull(), optional["value"]).otherwise(F.raise_error(F.lit("the optional has no value")))
