"""Running values over keys of any size: rows are cut into ranges of order, each range is scanned by itself, and what came before it is carried in."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from presswire.operators.ordered import free_name
from presswire.operators.store import cut

#: How a running value goes on: over the rows of a range, over ranges, and both together.
OPERATIONS = {
    "sum": (F.sum, F.sum, lambda carry, own: F.coalesce(carry + own, carry, own)),
    "max": (F.max, F.max, lambda carry, own: F.greatest(carry, own)),
    "last": (lambda c: F.last(c, ignorenulls=True), lambda c: F.last(c, ignorenulls=True), lambda carry, own: F.coalesce(own, carry)),
}


class Ranges:
    """Rows dealt by ranges of (keys, order), so that a key with very many rows lies in many ranges, one after the other.

    order should be unique in a key: rows of equal order lie in one range and take any order there. Null keys are keys; nulls come first.
    Ranges have the size Spark gives shuffle partitions. Dealt rows are checkpointed, for their numbers are used twice.
    """

    def __init__(self, rows: DataFrame, keys: list[str], order: list[str]) -> None:
        self.part, self.keys, self.order = free_name(rows, "_part"), keys, order
        by = [*keys, *order]
        self.rows = cut(rows.repartitionByRange(*by).withColumn(self.part, F.spark_partition_id()))

    def running(self, value: Column, operation: str, name: str, own: bool = True) -> None:
        """Adds name: the running sum, maximum or last non-null of value, with the row's own or without; null where nothing came before.

        A task scans one range of one key. The carries are one row a range and key, their window holds a key's ranges, never its rows.
        """
        of_rows, of_parts, both = OPERATIONS[operation]
        rows = self.rows.withColumn(name, value)
        here = Window.partitionBy(self.part, *self.keys).orderBy(*self.order)
        # The last non-null one is that of highest order; ranges without any still pass on what came before them.
        latest = F.max_by(name, F.when(F.col(name).isNotNull(), F.struct(*self.order))) if operation == "last" else of_rows(F.col(name))
        carried, same = free_name(rows, "_carried"), {k: free_name(rows, f"_k{i}") for i, k in enumerate(self.keys)}
        parts = rows.groupBy(self.part, *self.keys).agg(latest.alias(carried))
        before = Window.partitionBy(*self.keys).orderBy(self.part).rowsBetween(Window.unboundedPreceding, -1)
        parts = parts.select(F.col(self.part).alias(self.part + "c"), *[F.col(k).alias(v) for k, v in same.items()], of_parts(F.col(carried)).over(before).alias(carried))
        frame = here.rowsBetween(Window.unboundedPreceding, 0 if own else -1)
        scanned = rows.withColumn(name, of_rows(F.col(name)).over(frame))
        on = F.col(self.part) == F.col(self.part + "c")
        for k, v in same.items():
            on &= F.col(k).eqNullSafe(F.col(v))
        joined = scanned.join(parts, on, "left")
        self.rows = joined.withColumn(name, both(F.col(carried), F.col(name))).drop(carried, self.part + "c", *same.values())

    def result(self) -> DataFrame:
        return self.rows.drop(self.part)


def running(rows: DataFrame, keys: list[str], order: list[str], value: Column, operation: str, name: str, own: bool = True) -> DataFrame:
    """rows with name, as Ranges.running() adds it."""
    ranges = Ranges(rows, keys, order)
    ranges.running(value, operation, name, own)
    return ranges.result()


def spaced(rows: DataFrame, keys: list[str], order: list[str], asked: Column, every: float, name: str) -> DataFrame:
    """rows with name: when each may start if rows of a key start `every` apart at least, in their order, none before it is asked for.

    The n-th starts at the latest of asked[i] + (n - i) * every: two scans over the same ranges, the place and the maximum of asked - place * every.
    """
    ranges, place = Ranges(rows, keys, order), free_name(rows, "_place")
    ranges.running(F.lit(1), "sum", place)
    ranges.running(asked - F.col(place) * every, "max", name)
    return ranges.result().withColumn(name, F.col(name) + F.col(place) * every).drop(place)
