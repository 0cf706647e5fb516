"""Column expressions that pick, map and judge by rules given as parameters."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def by_value(name: Column | str, columns: Mapping[str, Column]) -> Column:
    """The column that a row's own value names; null where it names none."""
    name, out = F.col(name) if isinstance(name, str) else name, F.lit(None)
    for value, column in columns.items():
        out = F.when(name == value, column).otherwise(out)
    return out


def by_prefix(name: Column | str, columns: Sequence[tuple[str, Column]], default: Column | None = None) -> Column:
    """The column of the first prefix that a row's name begins with."""
    name, out = F.col(name) if isinstance(name, str) else name, F.lit(None) if default is None else default
    for prefix, column in reversed(columns):
        out = F.when(name.startswith(prefix), column).otherwise(out)
    return out


def by_suffix(name: Column | str, suffix: str, with_it: Column, without: Column) -> Column:
    """One measure for ids that end in a suffix, another for all others."""
    return F.when((F.col(name) if isinstance(name, str) else name).endswith(suffix), with_it).otherwise(without)


def mapped(value: Column | str, table: Mapping[str, str]) -> Column:
    """A value's alias in a small dictionary; values that it lacks stay."""
    value = F.col(value) if isinstance(value, str) else value
    pairs = [F.lit(x) for kv in table.items() for x in kv]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), value), value) if pairs else value


def matches(text: Column | str, include: str | None = None, exclude: str | None = None) -> Column:
    """Whether a text matches one pattern and not another, ignoring case."""
    text = F.col(text) if isinstance(text, str) else text
    ok = F.lit(True) if include is None else text.rlike(f"(?i){include}")
    return ok if exclude is None else ok & ~text.rlike(f"(?i){exclude}")


def under_limit(value: Column | str, source: Column | str, limit: float, stricter: Mapping[str, float]) -> Column:
    """Whether a value is at most the limit, or its source's stricter one."""
    value, source = (F.col(c) if isinstance(c, str) else c for c in (value, source))
    return value <= reduce(lambda out, kv: F.when(source == kv[0], kv[1]).otherwise(out), stricter.items(), F.lit(limit))


def all_of(predicates: Iterable[Column | None]) -> Column:
    """All predicates that a caller asked for; those that are None were not."""
    return reduce(lambda a, b: a & b, (p for p in predicates if p is not None), F.lit(True))


def status(rules: Sequence[tuple[str, Column]], passed: str = "PASS") -> Column:
    """The name of the last rule that holds for a row; ``passed`` where none does."""
    out = F.lit(passed)
    for name, holds in rules:
        out = F.when(holds, name).otherwise(out)
    return out


def summed(columns: Sequence[str]) -> Column:
    """Sum of columns; null when one of them is."""
    return reduce(lambda a, b: a + b, map(F.col, columns))


def meaningful_tokens(tokens: Column | str, special: Sequence[int]) -> Column:
    """How many of an array's tokens are not special ones."""
    return F.size(F.filter(tokens, lambda t: ~t.isin(*special)))


def category_index(df: DataFrame, column: str, to: str, default: str | None = None) -> DataFrame:
    """Adds the place of a value among the sorted distinct ones; null and unknown values get the default's."""
    kinds = df.select(column).filter(F.col(column).isNotNull()).distinct()
    index = kinds.withColumn(to, (F.row_number().over(Window.orderBy(column)) - 1).cast("int"))  # one row for each category
    out = df.join(index, column, "left")
    if default is None:
        return out
    fallback = index.filter(F.col(column) == default).select(F.col(to).alias("_default"))
    return out.join(F.broadcast(fallback), how="left").withColumn(to, F.coalesce(to, "_default")).drop("_default")


def interleaved(df: DataFrame, pair: str, columns: tuple[Sequence[str], Sequence[str]], names: Sequence[str]) -> DataFrame:
    """Two rows for each row of pairs, ``role`` 0 with the first columns' values and 1 with the second's: in order of (pair, role) they come by turns."""
    sides = F.array(*(F.struct(F.lit(i).alias("role"), *(F.col(c).alias(n) for c, n in zip(side, names, strict=True))) for i, side in enumerate(columns)))
    return df.select(pair, F.explode(sides).alias("_s")).select(pair, "_s.*")
