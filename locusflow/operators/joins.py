"""Joins beyond the built-in ones."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def natural_join(a: DataFrame, b: DataFrame) -> DataFrame:
    """Inner join on all columns of one name."""
    return a.join(b, [c for c in a.columns if c in b.columns], "inner")


def one_to_one_join(a: DataFrame, b: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """A join that fails when either side repeats a key (checked inside the plan, on both sides' key counts)."""
    keys = list(keys)

    def unique(df: DataFrame, name: str) -> DataFrame:
        n = F.count(F.lit(1)).over(Window.partitionBy(*keys))
        checked = df.withColumn("_n", n).withColumn("_n", F.when(F.col("_n") > 1, F.raise_error(F.lit(f"the {name} side repeats a key")).cast("long")).otherwise(F.col("_n")))
        return checked.filter("_n = 1").drop("_n")

    return unique(a, "left").join(unique(b, "right"), keys, how)


def outer_concat(tables: Sequence[DataFrame], key: str) -> DataFrame:
    """Feature tables side by side, one row for each key of any of them."""
    return reduce(lambda x, y: x.join(y, key, "full_outer"), tables)


def conditional_anti(df: DataFrame, key: Sequence[str], drop_if: Column, present_if: Column) -> DataFrame:
    """Rows without those that match ``drop_if`` and whose key occurs in a row with ``present_if``."""
    known = df.filter(present_if).select(*key).distinct()
    return df.filter(~F.coalesce(drop_if, F.lit(False))).unionByName(df.filter(drop_if).join(known, list(key), "left_anti"))


def last_wins(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str]) -> DataFrame:
    """One row for each key: the last in the given order."""
    columns = [c for c in df.columns if c not in keys]
    best = F.max_by(F.struct(*columns), F.struct(*(F.col(o).alias(f"o{i}") if isinstance(o, str) else o.alias(f"o{i}") for i, o in enumerate(order))))
    return df.groupBy(*keys).agg(best.alias("_row")).select(*keys, "_row.*")


def fallback_lookup(df: DataFrame, own: DataFrame, own_key: Sequence[str], shared: DataFrame, shared_key: Sequence[str], value: str) -> DataFrame:
    """The value of the row's own record, or else of the record it shares with others."""
    a = df.join(own.select(*own_key, F.col(value).alias("_own")), list(own_key), "left")
    b = a.join(shared.select(*shared_key, F.col(value).alias("_shared")), list(shared_key), "left")
    return b.withColumn(value, F.coalesce("_own", "_shared")).drop("_own", "_shared")


def alternate_rows(df: DataFrame, key: str, columns: Sequence[str], suffix: str = "_2") -> DataFrame:
    """Columns taken from the row whose key is this one's with the suffix, where there is one."""
    other = df.filter(F.col(key).endswith(suffix)).select(F.expr(f"left({key}, length({key}) - {len(suffix)})").alias(key), *(F.col(c).alias(f"_{c}") for c in columns))
    out = df.join(other, key, "left")
    return out.select(*((F.coalesce(f"_{c}", c).alias(c)) if c in columns else F.col(c) for c in df.columns))


def parent_rows(df: DataFrame, key: str, parent: str, columns: Sequence[str]) -> DataFrame:
    """Child rows beside columns of their parent row (parent_*)."""
    up = df.select(F.col(key).alias(parent), *(F.col(c).alias(f"parent_{c}") for c in columns))
    return df.filter(F.col(parent).isNotNull()).join(up, parent)


def paired(df: DataFrame, name: str, columns: Sequence[str], suffixes: tuple[str, str] = ("_ref", "_alt")) -> DataFrame:
    """Rows ``x_ref`` and ``x_alt`` as one row of x; names without a partner are left out."""
    base = F.regexp_replace(name, f"({suffixes[0]}|{suffixes[1]})$", "")
    marked = df.withColumn("pair", base)
    one = lambda s, t: marked.filter(F.col(name).endswith(s)).select("pair", *(F.col(c).alias(f"{t}_{c}") for c in columns))
    return one(suffixes[0], "ref").join(one(suffixes[1], "alt"), "pair")


def agreeing_keys(df: DataFrame, key: str, member: str, value: str) -> DataFrame:
    """Keys that occur for every member, with one and the same value."""
    n = df.agg(F.countDistinct(member).alias("members"))
    per = df.groupBy(key).agg(F.countDistinct(member).alias("m"), F.countDistinct(value).alias("v"))
    return per.join(F.broadcast(n), F.col("m") == F.col("members")).filter("v = 1").select(key)


def mismatches(df: DataFrame, observed: str, declared: str) -> tuple[DataFrame, DataFrame]:
    """(consistent rows, one-row count of the others)."""
    same = F.upper(observed).eqNullSafe(F.upper(declared))
    return df.filter(same), df.agg(F.count_if(~same).alias("mismatches"), F.count(F.lit(1)).alias("rows"))


def variant_scores(variants: DataFrame, exact: DataFrame, by_position: DataFrame, position: Sequence[str] = ("contig", "pos"), alleles: Sequence[str] = ("ref", "alt")) -> DataFrame:
    """Variants with the scores of exactly their alleles, and with those of their position; null where there are none."""
    return variants.join(exact, [*position, *alleles], "left").join(by_position, list(position), "left")


def rows_with_vectors(rows: DataFrame, vectors: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """(rows that have a vector, one row of counts: rows, vectors, both)."""
    both = rows.join(vectors, key)
    n = lambda df, name: df.agg(F.count(F.lit(1)).alias(name))
    return both, n(rows, "n_rows").join(n(vectors, "n_vectors")).join(n(both, "n_both"))


def shard_contents(shards: DataFrame, sequences: DataFrame, key: str, shard: str, order: str) -> DataFrame:
    """Sequences beside the shard that lists them, in the shard's order; write with ``partitionBy(shard)``."""
    return shards.select(shard, key, order).join(sequences, key).repartition(shard).sortWithinPartitions(shard, order)
