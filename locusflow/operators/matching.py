"""One-to-one matches of places on a line, nearest first."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def best_matches(places: DataFrame, others: DataFrame, keys: Sequence[str], most: int | None = None) -> DataFrame:
    """(keys, place, other, gap): each place with at most one other and the reverse, by smallest gap first (then smaller place, then smaller other).

    A place reaches only to its neighbouring places, not so far as to touch them; ``most`` bounds the gap as well.

    Between two neighbouring places only the first and the last other place can be taken, the
    first by the place before it, the last by the one behind it.  So the pairs that compete
    form paths along the line, and taking the smallest first leaves, on every path, the pairs
    at an even number of steps from the smallest ones below them, on both sides.  That is what
    the windows count: no rounds, no pairs of far places.  Repeated places count once.
    """
    keys = list(keys)
    refs = places.select(*keys, F.col("place").cast("long").alias("at"), F.lit(0).alias("kind")).distinct()
    tests = others.select(*keys, F.col("other").cast("long").alias("at"), F.lit(1).alias("kind")).distinct()
    up, down = Window.partitionBy(*keys).orderBy("at", "kind"), Window.partitionBy(*keys).orderBy(F.desc("at"), F.desc("kind"))
    ref = F.when(F.col("kind") == 0, F.col("at"))
    sofar = lambda w: w.rowsBetween(Window.unboundedPreceding, 0)
    seen = refs.unionByName(tests).withColumn("low", F.last(ref, ignorenulls=True).over(sofar(up))).withColumn("high", F.last(ref, ignorenulls=True).over(sofar(down)))
    seen = seen.filter("kind = 1")
    exact = seen.filter("at = low").select(*keys, F.col("low").alias("place"), F.col("at").alias("other"), F.lit(0).cast("long").alias("gap"))
    between = seen.filter("low is null or at > low").groupBy(*keys, "low", "high").agg(F.min("at").alias("first"), F.max("at").alias("last"))
    pair = lambda side, place, other: F.struct(F.lit(side).alias("side"), F.col(place).alias("place"), F.col(other).alias("other"), F.abs(F.col(place) - F.col(other)).alias("gap"))
    pairs = between.select(*keys, F.explode(F.array(pair(1, "low", "first"), pair(0, "high", "last"))).alias("p")).select(*keys, "p.*").filter("place is not null")
    if most is not None:
        pairs, exact = pairs.filter(F.col("gap") <= most), exact.filter(F.lit(most) >= 0)
    same = [F.col(f"p.{k}").eqNullSafe(F.col(f"e.{k}")) for k in keys] + [F.col("p.place") == F.col("e.place")]
    pairs = pairs.alias("p").join(exact.alias("e"), same, "left_anti")
    along, back = Window.partitionBy(*keys).orderBy("place", "side"), Window.partitionBy(*keys).orderBy(F.desc("place"), F.desc("side"))
    rank = F.struct("gap", "place", "other")

    def climbs(step) -> Column:
        """Whether the neighbour competes and is smaller."""
        return F.coalesce(((step("place") == F.col("place")) | (step("other") == F.col("other"))) & (rank > step(rank)), F.lit(False))

    marked = pairs.withColumns({"i": F.row_number().over(along), "from_low": climbs(lambda c: F.lag(c).over(along)), "from_high": climbs(lambda c: F.lead(c).over(along))})
    marked = marked.withColumn("low_end", F.last(F.when(~F.col("from_low"), F.col("i")), ignorenulls=True).over(sofar(along)))
    marked = marked.withColumn("high_end", F.last(F.when(~F.col("from_high"), F.col("i")), ignorenulls=True).over(sofar(back)))
    taken = marked.filter("(i - low_end) % 2 = 0 and (high_end - i) % 2 = 0")
    return taken.select(*keys, "place", "other", "gap").unionByName(exact)
