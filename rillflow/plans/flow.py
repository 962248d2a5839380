"""``Flow``: a DataFrame with its order. Each method returns a new flow; plans stay lazy but for the bounded samples that place rows. Steps that change nothing add nothing to the plan."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame

from rillflow.operators import aggregate, join, ordering, sort, transform, window


@dataclass(frozen=True)
class Flow:
    """``order``: the columns by whose ascending values the rows are in order; together they identify a row."""

    df: DataFrame
    order: tuple[str, ...]

    @classmethod
    def of(cls, df: DataFrame, *order: str) -> Flow:
        return cls(df, order)

    def _with(self, df: DataFrame, *order: str) -> Flow:
        return Flow(df, order or self.order)

    # rows
    def map(self, *columns: Column | str, keep_order: bool = True) -> Flow:
        return self._with(self.df.select(*(self.order if keep_order else ()), *columns))

    def filter(self, predicate: Column | str) -> Flow:
        return self._with(self.df.filter(predicate))

    def flat_map(self, items: Column, name: str = "item") -> Flow:
        return self._with(transform.flat_map(self.df, items, name), *self.order, "item_pos")

    def enumerate(self, start: int = 0, name: str = "index") -> Flow:
        return self._with(transform.enumerate_rows(self.df, [*self.order], start, name))

    def zip(self, *others: Flow) -> Flow:
        flows = [self, *others]
        return Flow(transform.zip_rows([f.df for f in flows], [[*f.order] for f in flows]), ("pos",))

    def concatenate(self, *others: Flow) -> Flow:
        return Flow(transform.concatenate(self.df, *[o.df for o in others]), ("part", *self.order))

    def repeat(self, count: int) -> Flow:
        return self if count == 1 else Flow(transform.repeat(self.df, count), ("epoch", *self.order))

    def take(self, count: int) -> Flow:
        return self if count < 0 else self._with(transform.take(self.df, count, [*self.order]))

    def skip(self, count: int) -> Flow:
        return self if count == 0 else self._with(transform.skip(self.df, count, [*self.order]))

    def shard(self, shards: int, index: int) -> Flow:
        return self if shards == 1 else self._with(transform.shard(self.df, shards, index, [*self.order]).drop("pos"))

    def shuffle(self, seed: int) -> DataFrame:
        return sort.shuffled(self.df, seed, [*self.order])

    def interleave(self, *others: Flow, block_length: int = 1, cycle_length: int | None = None) -> Flow:
        flows = [self, *others]
        return Flow(transform.interleave([f.df for f in flows], [[*f.order] for f in flows], block_length, cycle_length), ("round", "slot", "inner"))

    def cache(self, path: str | None = None) -> Flow:
        return self._with(transform.cached(self.df, path))

    def apply(self, *functions) -> Flow:
        return reduce(lambda flow, f: f(flow), functions, self)

    # windows
    def batch(self, size: int, value: str | Column, drop_remainder: bool = False) -> Flow:
        return Flow(window.batch(self.df, size, [*self.order], value, drop_remainder), ("batch",))

    def padded_batch(self, size: int, value: str, padding: Column, length: int = -1) -> Flow:
        return Flow(window.padded_batch(self.df, size, [*self.order], value, padding, length), ("batch",))

    def window(self, size: int, value: str, shift: int = 1, stride: int = 1) -> Flow:
        return Flow(window.sliding_window(self.df, size, [*self.order], value, shift, stride), ("start",))

    def map_and_batch(self, size: int, value: Column, drop_remainder: bool = False) -> Flow:
        return Flow(transform.map_and_batch(self.df, value, size, [*self.order], drop_remainder), ("batch",))

    def group_by_window(self, key: list[str], size: int, *aggregates: Column, spread: bool = False) -> Flow:
        return Flow(window.group_by_window(self.df, key, size, [*self.order], *aggregates, spread=spread), (*key, "window"))

    def cumsum(self, value: str, name: str, partition: list[str] | None = None, exclusive: bool = False, reverse: bool = False) -> Flow:
        return self._with(ordering.running(self.df, value, [*self.order], name, partition, exclusive, reverse))

    # reductions
    def group_by_reducer(self, key: Column, *aggregates: Column) -> DataFrame:
        return aggregate.group_by_reducer(self.df, key, *aggregates)

    def reduce(self, **aggregates: tuple[Column, Column]) -> DataFrame:
        return aggregate.reduce_all(self.df, **aggregates)

    def unique(self, *keys: str) -> Flow:
        return self._with(aggregate.unique_first(self.df, [*keys], [*self.order]))

    def top_k(self, row: list[str], value: str, k: int) -> DataFrame:
        return sort.top_k_per_row(self.df, row, value, k, [*self.order])

    def lookup(self, table: DataFrame, key: str, table_key: str, table_value: str, default: Column, name: str = "value") -> Flow:
        return self._with(join.lookup(self.df, table, key, table_key, table_value, default, name))
