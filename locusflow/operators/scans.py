"""Running values along ordered rows of keys of any size.

A key's rows are cut by a bin of their position.  Within a bin a window gives the running
value; a row for each bin gives what all bins before it leave.  Both are windows over small
groups and one equi-join, so that a key with a third of all rows is spread over its bins,
and bins follow from the rows alone: no partitioning has to be kept.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

#: Positions in one bin.
SPAN = 1 << 18


def bin_of(position: str | Column, span: int = SPAN) -> Column:
    return F.floor((F.col(position) if isinstance(position, str) else position) / F.lit(span)).cast("long")


def _running(kind: str, value: Column, order: Sequence[str]) -> tuple[Column, Column, Callable[[Column, Column], Column]]:
    """(over ordered rows, over a group, what comes before with what is there)."""
    if kind == "sum":
        return F.sum(value), F.sum(value), lambda before, own: F.coalesce(before, F.lit(0)) + F.coalesce(own, F.lit(0))
    if kind == "max":
        return F.max(value), F.max(value), lambda before, own: F.greatest(before, own)
    if kind == "last":
        place = F.when(value.isNotNull(), F.struct(*order))
        return F.last(value, ignorenulls=True), F.max_by(value, place), lambda before, own: F.coalesce(own, before)
    raise ValueError(kind)


def running(df: DataFrame, keys: Sequence[str], position: str, order: Sequence[str], values: dict[str, tuple[str, Column]], inclusive: bool = True, span: int = SPAN) -> DataFrame:
    """``df`` with a column for each of ``values``: the sum, maximum or last known value of all rows of the key up to this one (before it, unless ``inclusive``).

    ``order`` are columns, ascending, that follow ``position``: equal orders have equal bins.
    A sum over no rows is 0, the other kinds give null.
    """
    # one struct is the key of windows, totals and join alike: nothing is dealt twice, and nulls in it are equal
    held = df.withColumn("_at", F.struct(*keys, bin_of(position, span).alias("_bin")))
    inside = Window.partitionBy("_at").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    before = Window.partitionBy(*(F.col(f"_at.{k}") for k in keys)).orderBy("_at._bin").rowsBetween(Window.unboundedPreceding, -1)
    made = {name: _running(kind, value, order) for name, (kind, value) in values.items()}
    totals = held.groupBy("_at").agg(*(group.alias(f"_t_{n}") for n, (_, group, _) in made.items()))
    # a row for each bin of a key that has rows: at most the key's length over the span
    carried = totals.select("_at", *(_running(kind, F.col(f"_t_{n}"), ["_at"])[0].over(before).alias(f"_c_{n}") for n, (kind, _) in values.items()))
    own = held.withColumns({f"_o_{n}": rows.over(inside) for n, (rows, _, _) in made.items()})
    joined = own.join(carried, "_at")
    return joined.select(*df.columns, *(both(F.col(f"_c_{n}"), F.col(f"_o_{n}")).alias(n) for n, (_, _, both) in made.items()))


def numbered_islands(df: DataFrame, keys: Sequence[str], min_gap: int, span: int = SPAN) -> DataFrame:
    """Intervals (start, end) with ``island``, counted from 1 along each key: one opens where a start lies more than ``min_gap`` behind all ends before it."""
    reach = running(df, keys, "start", ["start", "end"], {"_reach": ("max", F.col("end"))}, inclusive=False, span=span)
    stays = F.when(F.col("_reach").isNull() | (F.col("start") > F.col("_reach") + min_gap), 0).otherwise(1)
    # of equal intervals the one that opens comes first
    return running(reach.withColumn("_stays", stays), keys, "start", ["start", "end", "_stays"], {"island": ("sum", 1 - F.col("_stays"))}, span=span).drop("_reach", "_stays")


def sorted_stream(df: DataFrame, groups: Sequence[str], order: Sequence[str | Column], step: Callable[[Iterator[dict]], Iterator[dict]], schema: str, rows: int = 4096) -> DataFrame:
    """A group's rows, in order, go through a generator of rows that keeps its own small state; groups are never held.

    ``step`` gets all rows of a partition, group after group (``group`` is the tuple of the
    group's columns), and yields rows of ``schema``.
    """
    kinds = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def every() -> Iterator[dict]:
            for batch in batches:
                for row in batch.to_pylist():
                    row["group"] = tuple(row[g] for g in groups)
                    yield row

        held: list[dict] = []
        for row in step(every()):
            held.append(row)
            if len(held) == rows:
                yield pa.RecordBatch.from_pylist(held, kinds)
                held = []
        if held:
            yield pa.RecordBatch.from_pylist(held, kinds)

    return df.repartition(*groups).sortWithinPartitions(*groups, *order).mapInArrow(run, schema)

