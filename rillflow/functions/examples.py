"""Examples: rows as maps from feature names to lists of bytes, floats or integers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EXAMPLE = "map<string, struct<bytes: array<binary>, floats: array<float>, ints: array<bigint>>>"
#: Fixed names of the lists in the JSON form of an example.
JSON_LISTS = "features struct<feature: map<string, struct<bytesList: struct<value: array<string>>, floatList: struct<value: array<float>>, int64List: struct<value: array<bigint>>>>>"


def example(bytes_: dict[str, Column] | None = None, floats: dict[str, Column] | None = None, ints: dict[str, Column] | None = None) -> Column:
    """An example of array columns by name."""
    entries = []
    for kind, given in enumerate((bytes_, floats, ints)):
        for name, value in (given or {}).items():
            lists = [value if k == kind else F.lit(None) for k in range(3)]
            entries += [F.lit(name), F.struct(lists[0].cast("array<binary>").alias("bytes"), lists[1].cast("array<float>").alias("floats"), lists[2].cast("array<bigint>").alias("ints"))]
    return F.create_map(*entries)


def dense(column: Column, key: str, kind: str, size: int, default: Column | None = None) -> Column:
    """A feature of ``size`` values; its default where it is missing. One that is missing without a default, or has another size, is an error."""
    values = F.try_element_at(column, F.lit(key))[kind]
    missing = F.raise_error(F.lit(f"feature {key} is required")).cast(f"array<{ {'bytes': 'binary', 'floats': 'float', 'ints': 'bigint'}[kind]}>") if default is None else F.array_repeat(default, size)
    wrong = F.raise_error(F.lit(f"feature {key} must have {size} values")).cast(f"array<{ {'bytes': 'binary', 'floats': 'float', 'ints': 'bigint'}[kind]}>")
    return F.when(values.isNull() | (F.size(values) == 0), missing).when(F.size(values) == size, values).otherwise(wrong)


def ragged(column: Column, key: str, kind: str) -> Column:
    """A feature of any number of values; empty where it is missing."""
    return F.coalesce(F.try_element_at(column, F.lit(key))[kind], F.array())


def from_json(s: Column) -> Column:
    """The map of a JSON example; byte values are base64 there."""
    found = F.from_json(s, JSON_LISTS)["features"]["feature"]
    return F.transform_values(found, lambda _, v: F.struct(F.transform(v["bytesList"]["value"], lambda x: F.unbase64(x)).alias("bytes"), v["floatList"]["value"].alias("floats"), v["int64List"]["value"].alias("ints")))
