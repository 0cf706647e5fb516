"""Deterministic samples, shuffles and shards: the choice depends on a hash of the key and a seed, never on partitioning."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .checkpoints import checkpoints


def hash_order(key: str | Column, seed: str | int = 0) -> Column:
    """A text to order by that looks random: md5 of key and seed (any engine computes the same)."""
    key = F.col(key) if isinstance(key, str) else key
    return F.md5(F.concat_ws(":", key.cast("string"), F.lit(str(seed))))


def shuffled(df: DataFrame, key: str, seed: str | int = 0) -> DataFrame:
    """All rows in a global random order."""
    return df.orderBy(hash_order(key, seed), key)


def sample_per_group(df: DataFrame, groups: Sequence[str], key: str, n: int, seed: str | int = 0) -> DataFrame:
    """At most n rows of each group, without replacement.

    Only rows whose hash is under their group's share are ranked, so that a group's rank is over about n rows, however large it is.
    """
    sizes = df.groupBy(F.struct(*groups).alias("_g")).agg(F.count(F.lit(1)).alias("_size"))
    near = df.withColumn("_g", F.struct(*groups)).join(sizes, "_g").filter(hash_fraction(key, seed) <= _below(F.lit(float(n)), F.col("_size")))
    order = Window.partitionBy("_g").orderBy(hash_order(key, seed), key)
    return near.withColumn("_r", F.row_number().over(order)).filter(F.col("_r") <= n).select(*df.columns)


def sample_at_most(df: DataFrame, key: str, n: int, seed: str | int = 0) -> DataFrame:
    """At most n rows of all: a distributed top-n by hash."""
    return df.orderBy(hash_order(key, seed), key).limit(n)


def _below(wanted: Column, size: Column) -> Column:
    """A share of a group's hashes that is sure to hold the wanted number of smallest ones: ten deviations more than needed."""
    return F.least((wanted + 10 * F.sqrt(wanted) + 50) / size, F.lit(1.0))


def matched_sample(positives: DataFrame, negatives: DataFrame, match: Sequence[str], key: str, seed: str | int = 0) -> DataFrame:
    """For each matching key as many negatives as there are positives (all, if fewer).

    Only rows whose hash is under their group's share are ranked, so that a group's rank is over about as many rows as it needs.
    """
    wanted = positives.groupBy(*match).agg(F.count(F.lit(1)).alias("_n")).join(negatives.groupBy(*match).agg(F.count(F.lit(1)).alias("_size")), list(match))
    near = negatives.join(wanted.withColumn("_below", _below(F.col("_n"), F.col("_size"))), list(match)).filter(hash_fraction(key, seed) <= F.col("_below"))
    order = Window.partitionBy(*match).orderBy(hash_order(key, seed), key)
    return near.withColumn("_r", F.row_number().over(order)).filter("_r <= _n").drop("_r", "_n", "_size", "_below")


def upsample_to_balance(df: DataFrame, label: str, key: str, seed: str | int = 0) -> DataFrame:
    """Smaller classes repeated to the size of the largest: whole rounds, then the first rows by hash; ``copy`` numbers the repeats."""
    n = df.groupBy(label).agg(F.count(F.lit(1)).alias("_n"))
    n = n.join(F.broadcast(n.agg(F.max("_n").alias("_most"))))
    rank = F.row_number().over(Window.partitionBy(label).orderBy(hash_order(key, seed), key))
    ranked = df.join(F.broadcast(n), label).withColumn("_r", rank)
    times = F.expr("_most div _n") + F.when(F.col("_r") <= F.col("_most") % F.col("_n"), 1).otherwise(0)
    return ranked.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), times))).drop("_r", "_n", "_most")


def pool_for_splits(splits: DataFrame, split: str, size: str, pool: DataFrame, key: str) -> DataFrame:
    """A sample of one common pool for each split (``splits(split, size)``, few rows): the split is the seed, the same row may serve several.

    A row meets the splits where it lies and stays only where its hash for the split is under the split's share.
    """
    n = pool.agg(F.count(F.lit(1)).alias("_pool"))
    shares = splits.join(F.broadcast(n)).withColumn("_below", _below(F.col(size).cast("double"), F.greatest(F.col("_pool"), F.lit(1)))).drop("_pool")
    digest = F.md5(F.concat_ws(":", F.col(key).cast("string"), F.col(split).cast("string")))
    fraction = F.conv(F.substring(digest, 1, 13), 16, 10).cast("long") / F.lit(4503599627370496.0)
    near = pool.join(F.broadcast(shares), fraction <= F.col("_below"))
    order = Window.partitionBy(split).orderBy(digest, key)
    return near.withColumn("_r", F.row_number().over(order)).filter(F.col("_r") <= F.col(size)).drop("_r", "_below", size)


def bag_groups(df: DataFrame, group: str, rounds: int, seed: str | int = 0) -> DataFrame:
    """Rows of the groups drawn in each round, as when the labels of all N rows are drawn N times with replacement: a group of n rows is in a bag with probability 1 - (1 - n / N) ** N."""
    u = F.conv(F.substring(F.md5(F.concat_ws(":", F.col(group).cast("string"), F.col("round").cast("string"), F.lit(str(seed)))), 1, 13), 16, 10).cast("long") / F.lit(4503599627370496.0)
    sizes = df.groupBy(group).agg(F.count(F.lit(1)).alias("_n"))
    whole = sizes.agg(F.sum("_n").cast("double").alias("_whole"))  # one row
    missed = F.pow(1 - F.col("_n") / F.col("_whole"), F.col("_whole"))
    drawn = sizes.crossJoin(F.broadcast(whole)).withColumn("round", F.explode(F.sequence(F.lit(1), F.lit(rounds)))).filter(u >= missed).select(group, "round")
    return df.join(drawn, group)


def with_global_index(df: DataFrame, key: str, seed: str | int | None = None, partitions: int = 64, index: str = "index") -> DataFrame:
    """Row numbers from 0 in order of the key (or of its hash): range partitions are numbered inside, their sizes give each its offset."""
    checkpoints(df.sparkSession)
    order = F.col(key) if seed is None else hash_order(key, seed)
    ranged = df.withColumn("_o", order).repartitionByRange(partitions, "_o", key).withColumn("_p", F.spark_partition_id()).checkpoint()
    sizes = ranged.groupBy("_p").agg(F.count(F.lit(1)).alias("_s"))
    offsets = sizes.withColumn("_before", F.coalesce(F.sum("_s").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_s")  # a row for each partition
    inside = F.row_number().over(Window.partitionBy("_p").orderBy("_o", key))
    return ranged.withColumn("_i", inside).join(F.broadcast(offsets), "_p").withColumn(index, F.col("_before") + F.col("_i") - 1).drop("_o", "_p", "_i", "_before")


def shards(df: DataFrame, key: str, rows: int, seed: str | int = 0, from_one: bool = False, partitions: int = 64) -> DataFrame:
    """Shards of ``rows`` rows of a global shuffle; ``from_one`` counts rows from 1, so the first shard is one short."""
    indexed = with_global_index(df, key, seed, partitions)
    return indexed.withColumn("shard", F.floor((F.col("index") + (1 if from_one else 0)) / rows).cast("int"))


def hash_fraction(key: str | Column, seed: str | int = 0) -> Column:
    return F.conv(F.substring(hash_order(key, seed), 1, 13), 16, 10).cast("long") / F.lit(4503599627370496.0)


def train_test(df: DataFrame, key: str, test: float, seed: str | int = 0, column: str = "part") -> DataFrame:
    return df.withColumn(column, F.when(hash_fraction(key, seed) < test, "test").otherwise("train"))


def stratified_folds(df: DataFrame, label: str, key: str, folds: int, seed: str | int = 0) -> DataFrame:
    order = Window.partitionBy(label).orderBy(hash_order(key, seed), key)
    return df.withColumn("fold", ((F.row_number().over(order) - 1) % folds).cast("int"))


def group_folds(df: DataFrame, group: str, folds: int, seed: str | int = 0) -> DataFrame:
    """All rows of a group in one fold."""
    return df.withColumn("fold", F.floor(hash_fraction(group, seed) * folds).cast("int"))


#: Groups that are ranked by size to deal them out evenly; beyond that a hash deals them.
MOST_RANKED_GROUPS = 100_000


def balanced_group_folds(df: DataFrame, group: str, folds: int, column: str = "fold") -> DataFrame:
    """All rows of a group in one fold, folds of about equal size: groups by falling size go to the folds in turn, there and back."""
    sizes = df.groupBy(group).agg(F.count(F.lit(1)).alias("_n"))
    if sizes.limit(MOST_RANKED_GROUPS + 1).count() > MOST_RANKED_GROUPS:
        return group_folds(df, group, folds).withColumnRenamed("fold", column)
    turn = (F.row_number().over(Window.orderBy(F.desc("_n"), group)) - 1) % (2 * folds)
    dealt = sizes.select(group, F.when(turn < folds, turn).otherwise(2 * folds - 1 - turn).cast("int").alias(column))
    return df.join(F.broadcast(dealt), group)
