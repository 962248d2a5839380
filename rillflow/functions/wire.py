"""The wire format of protocol messages: tagged fields of varints, fixed words and lengths. Examples, sequence examples, tensors, and messages of any declared fields.

A decoder is a function of bytes; on columns it runs over Arrow batches. Unknown fields are skipped, as readers of the format must; a message that ends within a field is an error.
"""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType, _parse_datatype_string

from rillflow.functions.examples import EXAMPLE

VARINT, FIXED64, LENGTH, FIXED32 = 0, 1, 2, 5
ONE_BYTE = [bytes((k,)) for k in range(0x80)]


def varint(data: bytes, at: int) -> tuple[int, int]:
    """(value, next place)."""
    value = shift = 0
    while True:
        if at >= len(data) or shift > 63:
            raise ValueError("truncated varint")
        byte = data[at]
        value |= (byte & 0x7F) << shift
        at += 1
        if byte < 0x80:
            return value & 0xFFFFFFFFFFFFFFFF, at
        shift += 7


def signed(value: int) -> int:
    return value - (1 << 64) if value >= 1 << 63 else value


def fields(data: bytes) -> Iterator[tuple[int, int, int | bytes]]:
    """(number, wire type, value) of each field in order."""
    at = 0
    while at < len(data):
        tag, at = varint(data, at)
        number, kind = tag >> 3, tag & 7
        if kind == VARINT:
            value, at = varint(data, at)
        elif kind in (FIXED64, FIXED32):
            size = 8 if kind == FIXED64 else 4
            value, at = data[at : at + size], at + size
            if at > len(data):
                raise ValueError("truncated field")
        elif kind == LENGTH:
            size, at = varint(data, at)
            value, at = data[at : at + size], at + size
            if at > len(data):
                raise ValueError("truncated field")
        else:
            raise ValueError(f"unknown wire type {kind}")
        yield number, kind, value


def packed_varints(data: bytes) -> list[int]:
    """All varints of a packed field, at once."""
    raw = np.frombuffer(data, np.uint8)
    if not len(raw):
        return []
    ends = np.flatnonzero(raw < 0x80)
    if not len(ends) or ends[-1] != len(raw) - 1:
        raise ValueError("truncated varint")
    starts = np.concatenate([[0], ends[:-1] + 1])
    place = np.arange(len(raw)) - np.repeat(starts, ends - starts + 1)
    if place.max() > 9:
        raise ValueError("truncated varint")
    bits = (raw & 0x7F).astype(np.uint64) << (7 * place).astype(np.uint64)
    return np.bitwise_or.reduceat(bits, starts).view(np.int64).tolist()


def put_varint(value: int) -> bytes:
    if 0 <= value < 0x80:
        return ONE_BYTE[value]
    value &= 0xFFFFFFFFFFFFFFFF
    out = bytearray()
    while value >= 0x80:
        out.append(value & 0x7F | 0x80)
        value >>= 7
    out.append(value)
    return bytes(out)


def put(number: int, kind: int, value: int | bytes) -> bytes:
    head = put_varint(number << 3 | kind)
    if kind == VARINT:
        return head + put_varint(value)
    return head + (put_varint(len(value)) if kind == LENGTH else b"") + value


# messages of declared fields: name -> (number, type); a list type is repeated
SCALARS: dict[str, tuple[int, Callable, Callable]] = {
    "int64": (VARINT, signed, lambda v: v),
    "int32": (VARINT, lambda v: signed(v), lambda v: v),
    "uint64": (VARINT, lambda v: v, lambda v: v),
    "uint32": (VARINT, lambda v: v & 0xFFFFFFFF, lambda v: v),
    "sint64": (VARINT, lambda v: v >> 1 ^ -(v & 1), lambda v: (v << 1 ^ v >> 63) & 0xFFFFFFFFFFFFFFFF),
    "bool": (VARINT, bool, int),
    "enum": (VARINT, signed, lambda v: v),
    "fixed64": (FIXED64, lambda v: struct.unpack("<Q", v)[0], lambda v: struct.pack("<Q", v)),
    "sfixed64": (FIXED64, lambda v: struct.unpack("<q", v)[0], lambda v: struct.pack("<q", v)),
    "double": (FIXED64, lambda v: struct.unpack("<d", v)[0], lambda v: struct.pack("<d", v)),
    "fixed32": (FIXED32, lambda v: struct.unpack("<I", v)[0], lambda v: struct.pack("<I", v)),
    "float": (FIXED32, lambda v: struct.unpack("<f", v)[0], lambda v: struct.pack("<f", v)),
    "string": (LENGTH, lambda v: v.decode(), lambda v: v.encode()),
    "bytes": (LENGTH, bytes, bytes),
}
SQL = {"int64": "bigint", "int32": "int", "uint64": "decimal(20,0)", "uint32": "bigint", "sint64": "bigint", "bool": "boolean", "enum": "int", "fixed64": "decimal(20,0)", "sfixed64": "bigint", "double": "double", "fixed32": "bigint", "float": "float", "string": "string", "bytes": "binary"}
Spec = dict[str, tuple[int, "str | Spec | list"]]


def decode(data: bytes, spec: Spec) -> dict:
    """The declared fields of a message; absent ones are None, repeated ones lists. Of a field that isn't repeated, the last value counts; numbers may be packed or not."""
    by_number = {number: (name, kind) for name, (number, kind) in spec.items()}
    out: dict = {name: [] if isinstance(kind, list) else None for name, (_, kind) in spec.items()}
    for number, wire, value in fields(data):
        if number not in by_number:
            continue
        name, kind = by_number[number]
        many = isinstance(kind, list)
        one = kind[0] if many else kind
        if isinstance(one, dict):
            made = [decode(value, one)]
        else:
            expected, read, _ = SCALARS[one]
            if wire == LENGTH and expected == VARINT:
                made = [read(v & 0xFFFFFFFFFFFFFFFF) for v in packed_varints(value)]
            elif wire == LENGTH and expected in (FIXED32, FIXED64):
                size = 8 if expected == FIXED64 else 4
                made = [read(value[k : k + size]) for k in range(0, len(value), size)]
            elif wire == expected:
                made = [read(value)]
            else:
                raise ValueError(f"field {name} has wire type {wire}")
        if many:
            out[name] += made
        elif made:
            out[name] = made[-1]
    return out


def encode(message: dict, spec: Spec) -> bytes:
    """The bytes of a message, fields by their numbers; None and empty lists are left out. Repeated numbers are packed."""
    out = []
    for name, (number, kind) in sorted(spec.items(), key=lambda x: x[1][0]):
        value = message.get(name)
        if value is None:
            continue
        many = isinstance(kind, list)
        one, values = kind[0] if many else kind, value if many else [value]
        if isinstance(one, dict):
            out += [put(number, LENGTH, encode(v, one)) for v in values]
            continue
        wire, _, write = SCALARS[one]
        if many and wire != LENGTH:
            if len(values):
                out.append(put(number, LENGTH, b"".join(put_varint(write(v)) if wire == VARINT else write(v) for v in values)))
        else:
            out += [put(number, wire, write(v)) for v in values]
    return b"".join(out)


def sql_type(spec: Spec) -> str:
    def one(kind) -> str:
        if isinstance(kind, list):
            return f"array<{one(kind[0])}>"
        return sql_type(kind) if isinstance(kind, dict) else SQL[kind]

    return "struct<" + ", ".join(f"`{name}`: {one(kind)}" for name, (_, kind) in spec.items()) + ">"


def _wide(value, kind):
    """Numbers as the column's type wants them: unsigned ones of 64 bits are decimals."""
    from decimal import Decimal

    if isinstance(kind, list):
        return [_wide(v, kind[0]) for v in value]
    if isinstance(kind, dict):
        return None if value is None else {k: _wide(value[k], t) for k, (_, t) in kind.items()}
    return Decimal(value) if value is not None and kind in ("uint64", "fixed64") else value


def decode_column(data: Column, spec: Spec) -> Column:
    """A struct of the declared fields of each message; null for null."""

    def run(series: pd.Series) -> pd.DataFrame:
        made = [None if b is None else {k: _wide(v, spec[k][1]) for k, v in decode(bytes(b), spec).items()} for b in series]
        return pd.DataFrame([dict.fromkeys(spec) if m is None else m for m in made], columns=[*spec], dtype=object)

    run.__annotations__ = {"series": pd.Series, "return": pd.DataFrame}
    return F.when(data.isNotNull(), F.pandas_udf(run, _parse_datatype_string(sql_type(spec)))(data))


def encode_column(message: Column, spec: Spec) -> Column:
    """The bytes of each struct of the declared fields."""

    def plain(row, kind):
        if row is None:
            return None
        if isinstance(kind, list):
            return [plain(v, kind[0]) for v in row]
        if isinstance(kind, dict):
            return {k: plain(row[k], t) for k, (_, t) in kind.items() if row.get(k) is not None}
        return int(row) if SCALARS[kind][0] in (VARINT,) or kind in ("fixed64", "sfixed64", "fixed32") else row

    def run(series: pd.Series) -> pd.Series:
        return pd.Series([None if row[0] is None else encode(plain(row[0], spec), spec) for row in series])

    run.__annotations__ = {"series": pd.Series, "return": pd.Series}
    return F.pandas_udf(run, "binary")(F.array(message))


# examples: maps from names to lists of one of three kinds
FEATURE: Spec = {"bytes": (1, {"value": (1, ["bytes"])}), "floats": (2, {"value": (1, ["float"])}), "ints": (3, {"value": (1, ["int64"])})}
EXAMPLE_MESSAGE: Spec = {"features": (1, {"feature": (1, [{"key": (1, "string"), "value": (2, FEATURE)}])})}
SEQUENCE_MESSAGE: Spec = {"context": (1, {"feature": (1, [{"key": (1, "string"), "value": (2, FEATURE)}])}), "feature_lists": (2, {"feature_list": (1, [{"key": (1, "string"), "value": (2, {"feature": (1, [FEATURE])})}])})}
SEQUENCE = f"struct<context: {EXAMPLE}, lists: map<string, array<struct<bytes: array<binary>, floats: array<float>, ints: array<bigint>>>>>"


def _feature(message: dict | None) -> dict:
    message = message or {}
    return {kind: (message[kind]["value"] if message.get(kind) else None) for kind in ("bytes", "floats", "ints")}


def example_of(data: bytes) -> list[tuple[str, dict]]:
    found = decode(data, EXAMPLE_MESSAGE)["features"] or {"feature": []}
    return list({e["key"] or "": _feature(e["value"]) for e in found["feature"]}.items())


class Unusual(Exception):
    """A message of another layout than writers make: one for the general decoder."""


def spans(data: bytes, at: int, end: int) -> Iterator[tuple[int, int, int]]:
    """(number, start, end) of each field in a part of a message whose fields all have a length and a small number."""
    while at < end:
        tag, size, at = data[at], data[at + 1], at + 2
        if size >= 0x80:
            size, at = varint(data, at - 1)
        stop = at + size
        if tag & 7 != LENGTH or tag >= 0x80 or stop > end:
            raise Unusual
        yield tag >> 3, at, stop
        at = stop


def values_of(kind: int, data: bytes, at: int, end: int) -> list:
    """The values of a list of bytes, floats or integers."""
    out: list = []
    for number, start, stop in spans(data, at, end):
        if number != 1:
            continue
        if kind == 1:
            out.append(data[start:stop])
        elif kind == 2:
            if (stop - start) % 4:
                raise Unusual
            out += struct.unpack_from(f"<{(stop - start) // 4}f", data, start)
        elif stop - start > 64:
            out += packed_varints(data[start:stop])
        else:
            while start < stop:
                value = data[start]
                start += 1
                if value >= 0x80:
                    value, start = varint(data, start - 1)
                out.append(signed(value))
            if start > stop:
                raise Unusual
    return out


def quick_example(data: bytes) -> dict[str, tuple]:
    """(bytes, floats, ints) of each feature, None for the lists that it hasn't."""
    whole = None
    for number, *span in spans(data, 0, len(data)):
        whole = span if number == 1 else whole
    found: dict[str, tuple] = {}
    for number, start, end in spans(data, *whole) if whole else ():
        if number != 1:
            continue
        key, feature = "", None
        for part, *span in spans(data, start, end):
            if part == 1:
                key = data[span[0] : span[1]].decode()
            elif part == 2:
                feature = span
        lists: list = [None, None, None, None]
        for kind, *span in spans(data, *feature) if feature else ():
            if 0 < kind < 4:
                lists[kind] = values_of(kind, data, *span)
        found[key] = tuple(lists[1:])
    return found


def examples_array(records: list[bytes | None], kind: pa.DataType) -> pa.Array:
    """The examples of records as maps, built column by column."""
    offsets: list = []
    keys: list = []
    lists: tuple[list, list, list] = ([], [], [])
    for data in records:
        offsets.append(None if data is None else len(keys))
        if data is None:
            continue
        try:
            found = quick_example(data)
        except (Unusual, IndexError, ValueError):
            found = {k: (f["bytes"], f["floats"], f["ints"]) for k, f in example_of(data)}
        keys += found
        for feature in found.values():
            for values, one in zip(lists, feature, strict=True):
                values.append(one)
    struct_ = kind.item_type
    items = pa.StructArray.from_arrays([pa.array(values, struct_.field(k).type) for k, values in enumerate(lists)], fields=[*struct_])
    return pa.MapArray.from_arrays(pa.array([*offsets, len(keys)], pa.int32()), pa.array(keys, kind.key_type), items).cast(kind)


def sequence_of(data: bytes) -> dict:
    found = decode(data, SEQUENCE_MESSAGE)
    context = {e["key"] or "": _feature(e["value"]) for e in (found["context"] or {"feature": []})["feature"]}
    lists = {e["key"] or "": [_feature(f) for f in (e["value"] or {"feature": []})["feature"]] for e in (found["feature_lists"] or {"feature_list": []})["feature_list"]}
    return {"context": list(context.items()), "lists": list(lists.items())}


def example_bytes(features: dict[str, dict]) -> bytes:
    """An example of features, each {"bytes" or "floats" or "ints": values}."""
    return encode({"features": {"feature": [{"key": k, "value": {kind: {"value": list(v)} for kind, v in f.items() if v is not None}} for k, f in features.items()]}}, EXAMPLE_MESSAGE)


def sequence_bytes(context: dict[str, dict], lists: dict[str, list[dict]]) -> bytes:
    feature = lambda f: {kind: {"value": list(v)} for kind, v in f.items() if v is not None}
    return encode({"context": {"feature": [{"key": k, "value": feature(f)} for k, f in context.items()]}, "feature_lists": {"feature_list": [{"key": k, "value": {"feature": [feature(f) for f in fs]}} for k, fs in lists.items()]}}, SEQUENCE_MESSAGE)


def _with(df: DataFrame, data: str, name: str, kind: str, read: Callable[[bytes], object] | None = None, made: Callable[[list, pa.DataType], pa.Array] | None = None) -> DataFrame:
    """``df`` with what ``read`` makes of each value, or ``made`` of those of a batch."""
    from pyspark.sql.pandas.types import to_arrow_type

    schema = StructType([*df.schema.fields, StructField(name, _parse_datatype_string(kind))])
    arrow = to_arrow_type(_parse_datatype_string(kind))

    def run(batches):
        for batch in batches:
            values = batch.column(data).to_pylist()
            column = made(values, arrow) if made else pa.array([None if b is None else read(b) for b in values], arrow)
            yield pa.RecordBatch.from_arrays([*batch.columns, column], names=[*batch.schema.names, name])

    return df.mapInArrow(run, schema)


def parse_examples(df: DataFrame, data: str = "record", name: str = "example") -> DataFrame:
    """``df`` with the examples in column ``data`` as maps, for ``examples.dense`` and ``ragged``."""
    return _with(df, data, name, EXAMPLE, made=examples_array)


def parse_sequences(df: DataFrame, data: str = "record", name: str = "sequence") -> DataFrame:
    """``df`` with a struct of the context (a map as of an example) and the feature lists."""
    return _with(df, data, name, SEQUENCE, sequence_of)


def write_examples(example: Column) -> Column:
    """The bytes of maps such as ``examples.example`` makes."""
    entries = F.transform(F.map_entries(example), lambda e: F.struct(e["key"].alias("key"), e["value"]["bytes"].alias("b"), e["value"]["floats"].alias("f"), e["value"]["ints"].alias("i")))

    def run(found: pa.Array) -> pa.Array:
        flat = found.flatten()
        heads = {k: put(1, LENGTH, k.encode()) for k in flat.field("key").unique().to_pylist()}
        keys, lists = flat.field("key").to_pylist(), []
        for kind, name in enumerate("bfi", 1):
            column = flat.field(name)
            sizes = column.value_lengths().to_pylist()  # None for a null list
            values, at, made = column.flatten(), 0, []
            if values.null_count:
                raise ValueError("a feature's value is null")
            raw = values.to_numpy(zero_copy_only=False).astype("<f4").tobytes() if kind == 2 else values.to_pylist()
            for n in sizes:
                if not n:
                    made.append(b"" if n is None else put(kind, LENGTH, b""))
                    continue
                end = at + n
                if kind == 1:
                    body = b"".join([put(1, LENGTH, v) for v in raw[at:end]])
                else:
                    body = put(1, LENGTH, raw[4 * at : 4 * end] if kind == 2 else b"".join(map(put_varint, raw[at:end])))
                made.append(put(kind, LENGTH, body))
                at = end
            lists.append(made)
        entries_ = [put(1, LENGTH, heads[k] + put(2, LENGTH, b + f + i)) for k, b, f, i in zip(keys, *lists, strict=True)]
        out, at = [], 0
        for n in found.value_lengths().to_pylist():
            out.append(None if n is None else put(1, LENGTH, b"".join(entries_[at : at + n])))
            at += n or 0
        return pa.array(out, pa.binary())

    run.__annotations__ = {"found": pa.Array, "return": pa.Array}
    return F.arrow_udf(run, "binary")(entries)


# tensors
#: Fixed numbers of element types, and the field that holds values which aren't written as raw content.
TENSOR_TYPES = {1: ("<f4", 5), 2: ("<f8", 6), 3: ("<i4", 7), 9: ("<i8", 10), 4: ("u1", 7), 6: ("i1", 7), 5: ("<i2", 7), 10: ("?", 11), 7: ("S", 8)}
TENSOR_NUMBERS = {"float": 1, "double": 2, "int": 3, "bigint": 9, "string": 7, "boolean": 10}
TENSOR_MESSAGE: Spec = {"dtype": (1, "enum"), "shape": (2, {"dim": (2, [{"size": (1, "int64")}])}), "content": (4, "bytes"), "float": (5, ["float"]), "double": (6, ["double"]), "int": (7, ["int32"]), "string": (8, ["bytes"]), "bigint": (10, ["int64"]), "boolean": (11, ["bool"])}


def tensor_bytes(values: list, dims: list[int], kind: str) -> bytes:
    """A tensor of flat values, row-major, and its shape; numbers as raw content."""
    number = TENSOR_NUMBERS[kind]
    head = {"dtype": number, "shape": {"dim": [{"size": d} for d in dims]}}
    if kind == "string":
        return encode(head | {"string": [v if isinstance(v, bytes) else v.encode() for v in values]}, TENSOR_MESSAGE)
    return encode(head | {"content": np.asarray(values, TENSOR_TYPES[number][0]).tobytes()}, TENSOR_MESSAGE)


def tensor_of(data: bytes, kind: str) -> dict:
    """{dims, values}. Another type than ``kind`` is an error; a single value stands for all elements."""
    found = decode(data, TENSOR_MESSAGE)
    if found["dtype"] != TENSOR_NUMBERS[kind]:
        raise ValueError(f"the tensor is of type {found['dtype']}, not {kind}")
    dims = [d["size"] or 0 for d in (found["shape"] or {"dim": []})["dim"]]
    size = int(np.prod(dims)) if dims else 1
    if found["content"]:
        values = np.frombuffer(found["content"], TENSOR_TYPES[found["dtype"]][0]).tolist()
    else:
        values = found[kind] * (size if len(found[kind]) == 1 else 1)
    if len(values) != size:
        raise ValueError("the tensor's values don't fit its shape")
    return {"dims": dims, "values": values}


def serialize_tensor(values: Column, dims: list[int], kind: str) -> Column:
    """Arrays of one shape as tensors' bytes."""

    def run(series: pd.Series) -> pd.Series:
        return series.map(lambda v: None if v is None else tensor_bytes(list(v), dims, kind))

    run.__annotations__ = {"series": pd.Series, "return": pd.Series}
    return F.pandas_udf(run, "binary")(values)


def parse_tensors(df: DataFrame, data: str, kind: str, name: str = "tensor") -> DataFrame:
    """``df`` with a struct of each tensor's dims and flat values."""
    element = "binary" if kind == "string" else kind
    return _with(df, data, name, f"struct<dims: array<bigint>, values: array<{element}>>", lambda b: tensor_of(b, kind))
