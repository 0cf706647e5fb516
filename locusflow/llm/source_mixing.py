"""Mixing sources to target weights by Poisson replication; DataFrame functions only.

Each document gets a uniform number from a hash of the seed and its id, and the
inverse of a Poisson distribution at that number says how often it is written;
the mean is its source's target share over its present share.  Replicas are then
shuffled globally by a hash of seed, id and replica.

The order is random across and within partitions: a row's partition and its place in
it both come from that hash.

Defined results: null sources are one source of their own; rows with a null doc_id
are hashed by their other columns; repeated rows get equal counts; long texts play no
other part; an empty table gives an empty table; other columns pass through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, MapType, StructType

from .common import Scratch, column_name, join_checked

#: Rows of the rate table up to which it is broadcast.
BROADCAST_SOURCES = 100_000
#: A larger mean is a sum of parts, each with a hash of its own.
LARGEST_MEAN = 64.0


def uniform(*parts: Column) -> Column:
    """A number in [0, 1) with 52 bits, from the md5 of the parts joined by colons."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *parts)), 1, 13), 16, 10).cast("long").cast("double") / F.lit(4503599627370496.0)


def rates(docs: DataFrame, weights: dict[str, float] | None = None, exponent: float = 0.5) -> DataFrame:
    """(source, rate): target share over present share; without weights the target is proportional to count ** exponent."""
    counts = docs.groupBy("source").agg(F.count(F.lit(1)).cast("double").alias("n"))
    if weights is None:
        goal = F.pow("n", F.lit(exponent))
    else:
        goal = F.coalesce(F.create_map(*(F.lit(x) for kv in weights.items() for x in kv))[F.col("source")], F.lit(0.0))
    counts = counts.withColumn("goal", goal)
    both = counts.agg(F.sum("n").alias("all_n"), F.sum("goal").alias("all_goal"))
    return counts.crossJoin(F.broadcast(both)).select("source", (F.col("goal") / F.col("all_goal") * F.col("all_n") / F.col("n")).alias("rate"))


def _distribution(mean: Column) -> Column:
    """P(X <= 0), P(X <= 1), ... of a Poisson variable, far enough for any 52-bit uniform number."""
    last = F.ceil(mean + 12 * F.sqrt(mean) + 24).cast("int")
    step = lambda s, k: F.struct(
        (s["p"] * mean / F.greatest(k, F.lit(1))).alias("p"),
        (s["sum"] + s["p"] * mean / F.greatest(k, F.lit(1))).alias("sum"),
        F.concat(s["all"], F.array(s["sum"] + s["p"] * mean / F.greatest(k, F.lit(1)))).alias("all"),
    )
    first = F.exp(-mean)
    return F.aggregate(F.sequence(F.lit(1), last), F.struct(first.alias("p"), first.alias("sum"), F.array(first).alias("all")), step, lambda s: s["all"])


def mix(docs: DataFrame, weights: dict[str, float] | None = None, exponent: float = 0.5, seed: str = "mix", scratch: Scratch | None = None) -> DataFrame:
    """Replicas of ``docs`` (doc_id, source, ...) in random global order, with ``replica`` from 0."""
    scratch = scratch or Scratch(docs.sparkSession)
    replica, key = column_name(docs, "replica"), column_name(docs, "shuffle_key")
    parts, below, match = (column_name(docs, n) for n in ("rate_parts", "rate_below", "rate_source"))
    table = rates(docs, weights, exponent).withColumn(parts, F.greatest(F.ceil(F.col("rate") / LARGEST_MEAN).cast("int"), F.lit(1)))
    table = scratch.save(table.select(F.col("source").alias(match), parts, _distribution(F.col("rate") / F.col(parts)).alias(below)))
    plain = [docs[f.name] for f in docs.schema.fields if not isinstance(f.dataType, (ArrayType, MapType, StructType))]
    name = F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("row "), F.xxhash64(*plain).cast("string")))
    numbers = F.transform(F.sequence(F.lit(0), F.col(parts) - 1), lambda j: uniform(F.lit(seed), name, j.cast("string")))
    # how often: the number of values whose cumulative probability is not over the uniform number
    times = F.aggregate(numbers, F.lit(0), lambda s, u: s + F.size(F.filter(F.col(below), lambda p: p <= u)))
    joined = join_checked(docs, table, docs["source"].eqNullSafe(table[match]), "inner", BROADCAST_SOURCES)
    copies = joined.withColumn(key, times).filter(F.col(key) > 0).select(*(docs[c] for c in docs.columns), F.explode(F.sequence(F.lit(0), F.col(key) - 1)).alias(replica))
    copies = copies.withColumn(key, F.xxhash64(F.lit(seed), name, F.col(replica)))
    return copies.repartition(key).sortWithinPartitions(key).drop(key)
