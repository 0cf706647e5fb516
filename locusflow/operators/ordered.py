"""Operators over ordered rows.  Every window is partitioned; keys of order are explicit."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from .scans import sorted_stream


def change_since(df: DataFrame, keys: Sequence[str], order: str, value: str, back: int) -> DataFrame:
    """Relative change against the value ``back`` rows before; null where there is none or it is 0."""
    before = F.lag(value, back).over(Window.partitionBy(*keys).orderBy(order))
    return df.withColumn("change", F.try_divide(F.col(value) - before, F.abs(before)))


def first_where(df: DataFrame, keys: Sequence[str], order: str, condition: Column) -> DataFrame:
    """The first place of each key that meets a condition; null where none does."""
    return df.groupBy(*keys).agg(F.min(F.when(condition, F.col(order))).alias(f"first_{order}"))


def step_rates(df: DataFrame, keys: Sequence[str], order: str, time: str, count: str) -> DataFrame:
    """Median of (count gained / seconds taken) between neighbouring rows."""
    w = Window.partitionBy(*keys).orderBy(order)
    seconds = F.unix_timestamp(F.col(time).cast("timestamp")) - F.unix_timestamp(F.lag(time).over(w).cast("timestamp"))
    rated = df.withColumn("rate", F.try_divide((F.col(count) - F.lag(count).over(w)).cast("double"), seconds.cast("double")))
    return rated.groupBy(*keys).agg(F.median("rate").alias("median_rate"))


def epoch_lengths(df: DataFrame, keys: Sequence[str], order: str, epoch: str, count: str, time: str | None = None) -> DataFrame:
    """Count gained, and with ``time`` the seconds taken, from the first row of an epoch to the first of the next, by epoch."""
    heads = df.groupBy(*keys, epoch).agg(F.min_by(count, order).alias("start"), *([F.min_by(F.unix_timestamp(F.col(time).cast("timestamp")), order).alias("_at")] if time else []))
    w = Window.partitionBy(*keys).orderBy(epoch)
    out = heads.withColumn("length", F.lead("start").over(w) - F.col("start"))
    return out.withColumn("seconds", F.lead("_at").over(w) - F.col("_at")).drop("_at") if time else out


def segment_means(df: DataFrame, keys: Sequence[str], segment: str, value: str) -> DataFrame:
    return df.groupBy(*keys, segment).agg(F.avg(value).alias("mean"))


def mend_scale_break(df: DataFrame, keys: Sequence[str], order: str, value: str) -> DataFrame:
    """Finds the largest relative drop between neighbours and divides all earlier rows by it (a change of logging scale)."""
    w = Window.partitionBy(*keys).orderBy(order)
    ratio = df.withColumn("_ratio", F.try_divide(F.lag(value).over(w), F.col(value)))
    breaks = ratio.groupBy(*keys).agg(F.max_by(F.struct(F.col(order).alias("at"), F.col("_ratio").alias("by")), "_ratio").alias("_b"))
    joined = df.join(breaks, list(keys), "left")
    before = (F.col(order) < F.col("_b.at")) & (F.col("_b.by") > 1)
    return joined.withColumn("mended", F.when(before, F.col(value) / F.col("_b.by")).otherwise(F.col(value))).drop("_b")


def moving_average(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, beta: float = 0.98) -> DataFrame:
    """Bias-corrected exponential moving average, as the fold over the ordered values up to each row (a null value adds nothing).

    A key's rows are numbered and cut into stretches.  The fold is linear, so that the rows
    of a stretch only need the fold of those before: decay by length, plus its own sum.
    What is carried is a window over the stretches, one row each.
    """
    if not 0 < beta < 1:
        raise ValueError("beta lies between 0 and 1")
    numbered = df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    # beta^-i stays finite and exact enough within a stretch of rows
    stretch = max(1, int(-8 / math.log10(beta)))
    inside = numbered.withColumn("_at", (F.col("_n") - 1) % stretch).withColumn("_part", F.floor((F.col("_n") - 1) / stretch))
    raised = F.coalesce(F.col(value).cast("double"), F.lit(0.0)) * (1 - beta) * F.pow(F.lit(beta), -F.col("_at"))
    w = Window.partitionBy(*keys, "_part").orderBy("_n").rowsBetween(Window.unboundedPreceding, 0)
    own = inside.withColumn("_own", F.sum(raised).over(w) * F.pow(F.lit(beta), F.col("_at")))
    # one row for each part: what it leaves at its end, and how far that has decayed
    ends = own.groupBy(*keys, "_part").agg(F.max_by("_own", "_n").alias("_left"), F.count(F.lit(1)).alias("_rows"))
    # a stretch has decayed to 1e-8 at the end of the next, so that three of them hold all that a double can tell
    last = Window.partitionBy(*keys).orderBy("_part").rowsBetween(-3, -1)
    parts = F.collect_list(F.struct(F.col("_left"), F.col("_rows"))).over(last)
    carried = ends.withColumn("_carried", F.aggregate(parts, F.lit(0.0), lambda s, p: s * F.pow(F.lit(beta), p["_rows"]) + p["_left"])).select(*keys, "_part", "_carried")
    out = own.join(carried, [*keys, "_part"])
    fold = F.col("_own") + F.col("_carried") * F.pow(F.lit(beta), F.col("_at") + 1)
    return out.withColumn("ema", fold / (1 - F.pow(F.lit(beta), F.col("_n")))).select(*df.columns, "ema")


def interleaved_folds(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str], folds: int) -> DataFrame:
    """Fold = row number modulo the number of folds, within each key."""
    return df.withColumn("fold", (F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) - 1) % folds)


def contiguous_folds(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str], folds: int) -> DataFrame:
    """Fold = block of n // folds + 1 neighbouring rows."""
    n = F.count(F.lit(1)).over(Window.partitionBy(*keys))
    size = F.floor(n / folds) + 1
    return df.withColumn("fold", F.floor((F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) - 1) / size).cast("int"))


def contiguous_chain(df: DataFrame, keys: Sequence[str], start: str, length: str) -> DataFrame:
    """Rows of each key up to the first gap: a row stays while it starts where the one before ended."""
    w = Window.partitionBy(*keys).orderBy(start)
    joins = F.coalesce(F.lag(F.col(start) + F.col(length)).over(w) == F.col(start), F.lit(True))
    broken = df.withColumn("_j", F.when(joins, 0).otherwise(1))
    return broken.withColumn("_b", F.sum("_j").over(w.rowsBetween(Window.unboundedPreceding, 0))).filter("_b = 0").drop("_j", "_b")


def stitch_chunks(df: DataFrame, key: str, order: str, values: str, shift: str) -> DataFrame:
    """Chunk outputs in order as one: arrays, or texts with a character for each place; each drops as many head values as its left shift."""
    is_text = isinstance(df.schema[values].dataType, StringType)
    size = F.length if is_text else F.size
    kept = F.col(values) if shift is None else (F.substr if is_text else F.slice)(values, F.col(shift) + 1, F.greatest(size(values) - F.col(shift), F.lit(0)))
    parts = df.select(key, F.struct(F.col(order).alias("o"), kept.alias("v")).alias("p"))
    outputs = F.transform(F.sort_array(F.collect_list("p")), lambda p: p["v"])
    return parts.groupBy(key).agg((F.array_join(outputs, "") if is_text else F.flatten(outputs)).alias(values))


def within_tolerances(df: DataFrame, keys: Sequence[str], gap: str, tolerances: Sequence[int]) -> DataFrame:
    """How many matches lie within each tolerance, and the mobility (n_R - n_0) / (n_R + 1)."""
    out = df.groupBy(*keys).agg(*(F.count_if(F.col(gap) <= r).alias(f"within_{r}") for r in (0, *tolerances)))
    return out.withColumns({f"mobility_{r}": (F.col(f"within_{r}") - F.col("within_0")) / (F.col(f"within_{r}") + 1.0) for r in tolerances})


def cluster_by_anchor(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Clusters of intervals that overlap the cluster's first one, its anchor; ``anchor`` is that interval's name.

    A cluster never reaches over a place that no interval covers, so each such island is a group of its own; its
    intervals are read in order, with the anchor as all that is kept.
    """
    from .intervals import with_island

    islands = with_island(df.select(*keys, "name", "start", "end"), keys)

    def mark(rows: Iterator[dict]) -> Iterator[dict]:
        group, end, anchor = None, None, None
        for row in rows:
            if row["group"] != group or row["start"] >= end:
                group, end, anchor = row["group"], row["end"], row["name"]
            yield row | {"anchor": anchor}

    kinds = dict(islands.dtypes)
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in (*keys, "name", "start", "end")) + f", anchor {kinds['name']}"
    return sorted_stream(islands, [*keys, "island"], ["start", "end", "name"], mark, schema)
