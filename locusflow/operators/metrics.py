"""Aggregates for evaluation.  Scores that are null or NaN are left out everywhere."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from hashlib import md5

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.sequence import let
from .checkpoints import checkpoints

#: Two-sided 95 % normal quantile, and Student t quantiles for 1 to 30 degrees of freedom (fixed values).
Z95 = 1.959963984540054
T95 = (12.7062, 4.3027, 3.1824, 2.7764, 2.5706, 2.4469, 2.3646, 2.3060, 2.2622, 2.2281, 2.2010, 2.1788, 2.1604, 2.1448, 2.1314, 2.1199, 2.1098, 2.1009, 2.0930, 2.0860, 2.0796, 2.0739, 2.0687, 2.0639, 2.0595, 2.0555, 2.0518, 2.0484, 2.0452, 2.0423)


def t_quantile(df: Column) -> Column:
    """97.5 % Student quantile: the table up to 30 degrees of freedom, then the Cornish-Fisher series."""
    series = F.lit(Z95) + F.try_divide(F.lit((Z95**3 + Z95) / 4), df) + F.try_divide(F.lit((5 * Z95**5 + 16 * Z95**3 + 3 * Z95) / 96), df * df)
    return F.when(df < 1, F.lit(None)).when(df <= 30, F.element_at(F.array(*map(F.lit, T95)), F.greatest(F.least(df, F.lit(30)), F.lit(1)).cast("int"))).otherwise(series)


def mean_ci(df: DataFrame, groups: Sequence[str], value: str) -> DataFrame:
    """Mean with the half-width of its 95 % Student interval (standard error)."""
    out = df.groupBy(*groups).agg(F.avg(value).alias("mean"), F.stddev_samp(value).alias("_s"), F.count(value).alias("n"))
    return out.withColumn("half_width", t_quantile(F.col("n") - 1) * F.col("_s") / F.sqrt("n")).drop("_s")


def spread_interval(df: DataFrame, groups: Sequence[str], value: str) -> DataFrame:
    """Mean with the half-width of a Student interval scaled by the population deviation: a spread of values, not an error of the mean."""
    out = df.groupBy(*groups).agg(F.avg(value).alias("mean"), F.stddev_pop(value).alias("_s"), F.count(value).alias("n"))
    return out.withColumn("half_width", t_quantile(F.col("n") - 1) * F.col("_s")).drop("_s")


def pearson_ci(df: DataFrame, groups: Sequence[str], x: str, y: str) -> DataFrame:
    """r with the half-width of its 95 % interval by Fisher's z; null for fewer than four rows."""
    both = df.filter(F.col(x).isNotNull() & F.col(y).isNotNull())
    out = both.groupBy(*groups).agg(F.corr(x, y).alias("r"), F.count(F.lit(1)).alias("n"))
    z, d = F.atanh("r"), F.lit(1.96) / F.sqrt(F.col("n") - 3.0)
    return out.withColumn("half_width", F.when(F.col("n") > 3, (F.tanh(z + d) - F.tanh(z - d)) / 2))


def score_counts(df: DataFrame, groups: Sequence[str], score: str, label: str, weight: Column | None = None) -> DataFrame:
    """Positives and negatives for each distinct score: all that AUC and ROC need, after a map-side combine."""
    w = F.lit(1.0) if weight is None else weight
    ok = df.filter(F.col(score).isNotNull() & ~F.isnan(F.col(score).cast("double")) & F.col(label).isNotNull())
    return ok.groupBy(*groups, F.col(score).alias("score")).agg(F.sum(F.when(F.col(label) == 1, w).otherwise(0.0)).alias("pos"), F.sum(F.when(F.col(label) == 1, 0.0).otherwise(w)).alias("neg"))


def roc_auc(df: DataFrame, groups: Sequence[str], score: str, label: str, weight: Column | None = None) -> DataFrame:
    """Area under the ROC curve with ties averaged (Mann-Whitney); null when a class is missing."""
    counts = score_counts(df, groups, score, label, weight)
    below = F.coalesce(F.sum("neg").over(Window.partitionBy(*groups).orderBy("score").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    wins = counts.withColumn("wins", F.col("pos") * (below + F.col("neg") / 2))
    out = wins.groupBy(*groups).agg(F.sum("wins").alias("_w"), F.sum("pos").alias("n_pos"), F.sum("neg").alias("n_neg"))
    return out.withColumn("auc", F.try_divide(F.col("_w"), F.col("n_pos") * F.col("n_neg"))).drop("_w")


def ranged_sums(counts: DataFrame, groups: Sequence[str], order: str, values: Sequence[str], partitions: int = 200) -> DataFrame:
    """Rows of distinct (groups, order) with ``below_v``, the sum of v over the group's rows of smaller order, and ``all_v``, the whole group's: no window over a whole group.

    Rows are range-partitioned and written to the checkpoint folder, so that both passes see one partitioning; totals of partitions give each its offset.
    """
    checkpoints(counts.sparkSession)
    dealt = counts.repartitionByRange(partitions, *groups, order).checkpoint().withColumn("_p", F.struct(F.spark_partition_id().alias("part"), *groups))
    inside = Window.partitionBy("_p").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    # one row for each partition and group in it: at most partitions + groups
    totals = dealt.groupBy("_p").agg(*(F.sum(v).alias(v) for v in values))
    group = [F.col(f"_p.{g}") for g in groups]
    sofar, whole = Window.partitionBy(*group).orderBy("_p.part").rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy(*group)
    offsets = totals.select("_p", *(F.coalesce(F.sum(v).over(sofar), F.lit(0)).alias(f"_b_{v}") for v in values), *(F.sum(v).over(whole).alias(f"all_{v}") for v in values))
    own = dealt.withColumns({f"_o_{v}": F.coalesce(F.sum(v).over(inside), F.lit(0)) for v in values})
    return own.join(offsets, "_p").select(*counts.columns, *((F.col(f"_b_{v}") + F.col(f"_o_{v}")).alias(f"below_{v}") for v in values), *(f"all_{v}" for v in values))


def ranged_roc_auc(df: DataFrame, groups: Sequence[str], score: str, label: str, partitions: int = 200, weight: Column | None = None) -> DataFrame:
    """AUC of groups of any size, from sums over ranges of scores."""
    wins = ranged_sums(score_counts(df, groups, score, label, weight), groups, "score", ["pos", "neg"], partitions)
    out = wins.groupBy(*groups).agg(F.sum(F.col("pos") * (F.col("below_neg") + F.col("neg") / 2)).alias("w"), F.sum("pos").alias("n_pos"), F.sum("neg").alias("n_neg"))
    return out.select(*groups, F.try_divide(F.col("w"), F.col("n_pos") * F.col("n_neg")).alias("auc"), "n_pos", "n_neg")


def global_roc_auc(df: DataFrame, score: str, label: str, partitions: int = 200) -> DataFrame:
    """AUC of all rows."""
    return ranged_roc_auc(df, [], score, label, partitions)


def roc_curve(df: DataFrame, groups: Sequence[str], score: str, label: str, partitions: int = 200) -> DataFrame:
    """(threshold, fpr, tpr) for each distinct score: the shares of both classes that score as much or more."""
    sums = ranged_sums(score_counts(df, groups, score, label), groups, "score", ["pos", "neg"], partitions)
    above = lambda c: F.try_divide(F.col(f"all_{c}") - F.col(f"below_{c}"), F.col(f"all_{c}"))
    return sums.select(*groups, F.col("score").alias("threshold"), above("neg").alias("fpr"), above("pos").alias("tpr"))


def either_way(auc: Column) -> Column:
    """The AUC without regard to the score's direction."""
    return F.greatest(auc, 1 - auc)


def auc_grid(df: DataFrame, groups: Sequence[str], scores: Sequence[str], label: str) -> DataFrame:
    """AUC of every score column in every group; a row with null where it cannot be computed."""
    long = df.unpivot([*groups, label], list(scores), "score_name", "score_value")
    found = roc_auc(long, [*groups, "score_name"], "score_value", label)
    cells = df.select(*groups).distinct().withColumn("score_name", F.explode(F.array(*map(F.lit, scores))))
    return cells.join(found, [*groups, "score_name"], "left")


def auc_over_subsets(df: DataFrame, groups: Sequence[str], score: str, label: str, subsets: dict[str, Column]) -> DataFrame:
    """AUC over all rows and over overlapping subsets: the negatives with those positives that a flag selects."""
    tags = F.array(F.lit("all"), *(F.when((F.col(label) == 0) | flag, F.lit(name)) for name, flag in subsets.items()))
    tagged = df.withColumn("subset", F.explode(tags)).filter("subset is not null")
    return roc_auc(tagged, [*groups, "subset"], score, label)


def odds_ratio(df: DataFrame, groups: Sequence[str], label: str, top: Column, bottom: Column) -> DataFrame:
    """(top positives x bottom negatives) / (top negatives x bottom positives); null when a cell of the divisor is empty."""
    out = df.groupBy(*groups).agg(
        F.count_if(top & (F.col(label) == 1)).alias("a"), F.count_if(top & (F.col(label) == 0)).alias("b"),
        F.count_if(bottom & (F.col(label) == 1)).alias("c"), F.count_if(bottom & (F.col(label) == 0)).alias("d"),
    )
    return out.withColumn("odds_ratio", F.try_divide((F.col("a") * F.col("d")).cast("double"), (F.col("b") * F.col("c")).cast("double")))


def best_set(df: DataFrame, groups: Sequence[str], score: str, error: str, strict: bool = False, floor: float | None = None) -> DataFrame:
    """All entries whose interval overlaps the best entry's (touching counts unless ``strict``); with ``floor``, the lower bound must exceed it."""
    whole = Window.partitionBy(*groups)
    top = F.max(F.struct(F.col(score), F.col(error))).over(whole)
    low, high = top[score] - top[error], F.col(score) + F.col(error)
    keep = (high > low) if strict else (high >= low)
    if floor is not None:
        keep = keep & (F.col(score) - F.col(error) > floor)
    return df.filter(F.col(score).isNotNull()).withColumn("_k", keep).filter("_k").drop("_k")


def best_name(df: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Name of the column with the largest value in each row (the first by name among equals)."""
    pairs = F.array(*(F.struct(F.col(c).cast("double").alias("v"), F.lit(c).alias("name")) for c in sorted(columns)))
    best = F.array_max(F.transform(F.filter(pairs, lambda p: p["v"].isNotNull()), lambda p: p["v"]))
    return df.select(*keys, F.get(F.filter(pairs, lambda p: p["v"] == best), F.lit(0))["name"].alias("best"))


#: Largest mean of a Poisson draw.
LARGEST_MEAN = 500.0


def poisson_weight(key: Column, replicate: Column, mean: Column | float = 1.0) -> Column:
    """A Poisson draw from the hash of key and replicate: how often a row is in a bootstrap resample.  The distribution is summed as far as the mean needs; a mean over ``LARGEST_MEAN`` is an error."""
    u = uniform(key_hash(key), replicate)
    return let(_poisson_steps(mean), lambda below: F.size(F.filter(below, lambda p: p <= u)).cast("double"))


#: Step between replicates and the two factors of the hash (fixed values; products with 32 bits stay within 63).
_STEP, _FACTORS = 2654435769, (2146121005, 1540483477)


def key_hash(key: Column) -> Column:
    """32 bits of the md5 of a key as text."""
    return F.conv(F.substring(F.md5(key.cast("string")), 1, 8), 16, 10).cast("long")


def uniform(hashed: Column, replicate: Column) -> Column:
    """A number in [0, 1) from a key's hash and a replicate: 32 bits, mixed twice."""
    low = lambda x: x.bitwiseAND(F.lit(0xFFFFFFFF))
    fold = lambda x, n: x.bitwiseXOR(F.shiftright(x, n))
    x = low(hashed + replicate.cast("long") * F.lit(_STEP))
    x = let(x, lambda v: low(fold(v, 16) * F.lit(_FACTORS[0])))
    x = let(x, lambda v: low(fold(v, 13) * F.lit(_FACTORS[1])))
    return let(x, lambda v: fold(v, 16)) / F.lit(4294967296.0)


def _uniforms(hashed: np.ndarray, replicates: int) -> np.ndarray:
    """``uniform`` of every key (rows) and replicate from 1 (columns)."""
    low = np.uint64(0xFFFFFFFF)
    x = (hashed.astype(np.uint64)[:, None] + np.arange(1, replicates + 1, dtype=np.uint64) * np.uint64(_STEP)) & low
    for n, factor in zip((16, 13), _FACTORS, strict=True):
        x = ((x ^ (x >> np.uint64(n))) * np.uint64(factor)) & low
    return (x ^ (x >> np.uint64(16))) / 4294967296.0


def _digest_uniforms(keys: np.ndarray, replicates: int) -> np.ndarray:
    """52 bits of the md5 of every key (rows) and replicate from 1 (columns), each drawn anew."""
    tails = [b":%d" % r for r in range(1, replicates + 1)]
    drawn = b"".join([md5(k + t).digest()[:8] for k in (str(k).encode() for k in keys) for t in tails])
    return ((np.frombuffer(drawn, ">u8").astype(np.uint64) >> np.uint64(12)) / 4503599627370496.0).reshape(len(keys), replicates)


def _draws(hashed: np.ndarray, means: np.ndarray | float, replicates: int) -> np.ndarray:
    """Poisson draws of keys (rows) in replicates (columns): how many steps of the distribution lie at or below the key's number."""
    u = _digest_uniforms(hashed, replicates) if hashed.dtype == object else _uniforms(hashed, replicates)
    if isinstance(means, float):
        k = np.arange(1, int(means + 12 * np.sqrt(means) + 25))
        return np.searchsorted(np.cumsum(np.cumprod(np.concatenate([[np.exp(-means)], means / k]))), u, "right").astype(np.float64)
    means = means[:, None]
    if means.max(initial=0) > LARGEST_MEAN:
        raise ValueError(f"a mean over {LARGEST_MEAN}")
    p, drawn = np.exp(-means), np.zeros(u.shape)
    below = p.copy()
    for k in range(1, int(means.max(initial=0) + 12 * np.sqrt(means.max(initial=0)) + 26)):
        drawn += below <= u
        p = p * means / k
        below = below + p
    return drawn


def _poisson_steps(mean: Column | float) -> Column:
    """P(X <= 0), P(X <= 1), ..., beyond what 52 bits can tell from 1; literals where the mean is a number."""
    if not isinstance(mean, Column):
        if mean > LARGEST_MEAN:
            raise ValueError(f"a mean over {LARGEST_MEAN}")
        p = np.cumprod(np.concatenate([[np.exp(-mean)], mean / np.arange(1, int(mean + 12 * np.sqrt(mean) + 25))]))
        return F.array(*map(F.lit, np.cumsum(p).tolist()))
    last = F.ceil(mean + 12 * F.sqrt(mean) + 24).cast("int")
    checked = F.when(mean > LARGEST_MEAN, F.raise_error(F.lit(f"a mean over {LARGEST_MEAN}")).cast("int")).otherwise(last)

    def step(s: Column, k: Column) -> Column:
        p = s["p"] * mean / k
        return F.struct(p.alias("p"), (s["sum"] + p).alias("sum"), F.concat(s["all"], F.array(s["sum"] + p)).alias("all"))

    first = F.exp(-mean)
    return F.aggregate(F.sequence(F.lit(1), checked), F.struct(first.alias("p"), first.alias("sum"), F.array(first).alias("all")), step, lambda s: s["all"])


#: Draws that are held at once (rows by replicates).
DRAWS_AT_ONCE = 1 << 20


def _resampled(rows: DataFrame, order: Sequence[str], replicates: int, fold: Callable[[list[np.ndarray], np.ndarray, object], None], start: Callable[[], object], parts: Callable[[object], list[np.ndarray]]) -> DataFrame:
    """(g, part, sums): what ``fold`` gathers for each group of a range partition; rows (g, hashed, mean, ...) come in order.

    A group's state is made by ``start``, fed with blocks of its rows and their draws, and
    given away as soon as the group ends: ``parts`` are vectors over the replicates.
    """
    partitions = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.repartitionByRange(partitions, "g", *order).sortWithinPartitions("g", *order)
    kind, step = rows.schema["g"].dataType.simpleString(), max(1, DRAWS_AT_ONCE // replicates)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, held, state = TaskContext.get().partitionId(), None, None

        def close(group: pa.Array) -> pa.RecordBatch:
            flat = np.concatenate(parts(state))
            return pa.RecordBatch.from_arrays([group, pa.array([part], pa.int32()), pa.ListArray.from_arrays(pa.array([0, len(flat)], pa.int32()), pa.array(flat))], names=["g", "part", "sums"])

        for batch in batches:
            groups = batch.column(0)
            names = groups.to_pylist()
            columns = [c.to_numpy(zero_copy_only=False) for c in batch.columns[1:]]
            at = 0
            while at < len(names):
                if held is None or held[0].as_py() != names[at]:
                    if held is not None:
                        yield close(held)
                    held, state = groups.slice(at, 1), start()
                to = at + 1
                while to < len(names) and to - at < step and names[to] == names[at]:
                    to += 1
                own = [c[at:to] for c in columns]
                fold(own, _draws(own[0], own[1], replicates), state)
                at = to
        if held is not None:
            yield close(held)

    return dealt.mapInArrow(run, f"g {kind}, part int, sums array<double>")


def bootstrap_metric(df: DataFrame, groups: Sequence[str], key: str, terms: Sequence[Column], finish: Callable[[Sequence[Column]], Column], replicates: int = 1000, mean: Column | float = 1.0) -> DataFrame:
    """Any metric that follows from sums over rows, over Poisson resamples: ``finish`` makes it from the weighted sums of the ``terms`` (null: 0).

    Gives replicate_mean and the half_width of the 95 % percentile interval over replicates for
    each group.  ``mean`` may be a column: a row's own rate (a weighted bootstrap).  Rows are not
    repeated: a worker draws a row's numbers and adds them to its group's sums.
    """
    g = F.struct(*groups, F.lit(0).alias("_"))
    names = [f"t{i}" for i in range(len(terms))]
    rate = mean if isinstance(mean, Column) else F.lit(float(mean))
    rows = df.select(g.alias("g"), key_hash(F.col(key)).alias("hashed"), rate.cast("double").alias("mean"), *(F.coalesce(t.cast("double"), F.lit(0.0)).alias(n) for t, n in zip(terms, names, strict=True)))

    def fold(own: list[np.ndarray], drawn: np.ndarray, sums: np.ndarray) -> None:
        sums += np.stack(own[2:]) @ drawn

    partial = _resampled(rows, ["hashed"], replicates, fold, lambda: np.zeros((len(names), replicates)), list)
    each = partial.select("g", F.posexplode("sums").alias("i", "x")).groupBy("g", "i").agg(F.sum("x").alias("x"))
    wide = each.groupBy("g", (F.col("i") % replicates).alias("r")).agg(*(F.sum(F.when(F.floor(F.col("i") / replicates) == j, F.col("x"))).alias(n) for j, n in enumerate(names)))
    draws = wide.select(*(F.col("g")[c].alias(c) for c in groups), finish([F.col(n) for n in names]).alias("value"))
    return _spread(draws, groups, "value")


def _spread(draws: DataFrame, groups: Sequence[str], value: str) -> DataFrame:
    spread = draws.groupBy(*groups).agg(F.percentile(value, F.array(F.lit(0.025), F.lit(0.975))).alias("q"), F.avg(value).alias("replicate_mean"))
    return spread.withColumn("half_width", (F.col("q")[1] - F.col("q")[0]) / 2).drop("q")


class _Wins:
    """Weights of both classes and pairs won, over ordered scores; the tie that is open at a block's end is held apart."""

    def __init__(self, replicates: int):
        self.pos, self.neg, self.wins, self.tie_pos, self.tie_neg = (np.zeros(replicates) for _ in range(5))
        self.score = None

    def close_tie(self) -> None:
        self.wins += self.tie_pos * (self.neg + self.tie_neg / 2)
        self.pos, self.neg = self.pos + self.tie_pos, self.neg + self.tie_neg

    def add(self, scores: np.ndarray, positive: np.ndarray, drawn: np.ndarray) -> None:
        heads = np.concatenate([[0], np.flatnonzero(scores[1:] != scores[:-1]) + 1])
        pos, neg = np.add.reduceat(drawn * positive[:, None], heads, axis=0), np.add.reduceat(drawn * ~positive[:, None], heads, axis=0)
        if self.score is not None and scores[0] == self.score:
            pos[0], neg[0] = pos[0] + self.tie_pos, neg[0] + self.tie_neg
        elif self.score is not None:
            self.close_tie()
        below = np.cumsum(neg, axis=0) - neg + self.neg
        self.wins += (pos[:-1] * (below[:-1] + neg[:-1] / 2)).sum(axis=0)
        self.pos, self.neg = self.pos + pos[:-1].sum(axis=0), below[-1]
        self.tie_pos, self.tie_neg, self.score = pos[-1], neg[-1], scores[-1]


def bootstrap_auc(df: DataFrame, groups: Sequence[str], key: str, score: str, label: str, replicates: int = 1000, mean: Column | float = 1.0, digest: bool = False) -> DataFrame:
    """AUC on the full data, and the half-width of the 95 % percentile interval over Poisson resamples (null labels and scores left out).

    Rows are range-partitioned by group and score.  Each partition draws its rows' numbers
    and gives, for each group and replicate, the weights of both classes and the wins inside it;
    what lies before a partition is added afterwards, so that no row is repeated for a replicate.
    Numbers are 32 bits mixed from the key's hash, or, with ``digest``, 52 bits of the md5 of key and replicate.
    """
    ok = df.filter(F.col(score).isNotNull() & ~F.isnan(F.col(score).cast("double")) & F.col(label).isNotNull())
    rate = mean if isinstance(mean, Column) else F.lit(float(mean))
    rows = ok.select(F.struct(*groups, F.lit(0).alias("_")).alias("g"), (F.coalesce(F.col(key).cast("string"), F.lit("")) if digest else key_hash(F.col(key))).alias("hashed"), rate.cast("double").alias("mean"), F.col(score).cast("double").alias("score"), (F.col(label) == 1).alias("positive"))

    def parts(state: _Wins) -> list[np.ndarray]:
        state.close_tie()
        return [state.pos, state.neg, state.wins]

    partial = _resampled(rows, ["score"], replicates, lambda own, drawn, state: state.add(own[2], own[3].astype(bool), drawn), lambda: _Wins(replicates), parts)
    place = lambda j: F.get("sums", F.col("r") + j * replicates)
    each = partial.withColumn("r", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1)))).select("g", "part", "r", place(0).alias("pos"), place(1).alias("neg"), place(2).alias("wins"))
    # one row for each partition, group and replicate
    before = F.coalesce(F.sum("neg").over(Window.partitionBy("g", "r").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    whole = each.withColumn("wins", F.col("wins") + F.col("pos") * before).groupBy("g", "r").agg(*(F.sum(c).alias(c) for c in ("pos", "neg", "wins")))
    draws = whole.select(*(F.col("g")[c].alias(c) for c in groups), F.try_divide(F.col("wins"), F.col("pos") * F.col("neg")).alias("auc"))
    return roc_auc(df, groups, score, label).join(_spread(draws, groups, "auc"), list(groups))


def reference_weights(df: DataFrame, label: str, category: str, reference: DataFrame, keep_class_share: bool = True) -> DataFrame:
    """Row weights, of sum 1, under which each class has the category distribution that its own class has in ``reference``; with ``keep_class_share`` classes keep the share that they have in ``df``.

    Categories that the class lacks in the reference weigh 0.
    """
    n = df.groupBy(label, category).agg(F.count(F.lit(1)).alias("n"))
    wanted = reference.groupBy(label, category).agg(F.count(F.lit(1)).alias("m"))
    cell = n.join(wanted, [label, category], "left").withColumn("m", F.coalesce("m", F.lit(0)))
    if keep_class_share:
        by_class = cell.groupBy(label).agg((F.sum("n") / F.nullif(F.sum("m"), F.lit(0))).alias("scale"))
        cell = cell.join(by_class, label).withColumn("mass", F.col("m") * F.coalesce("scale", F.lit(0.0)))
    else:
        cell = cell.withColumn("mass", F.col("m").cast("double"))
    whole = cell.agg(F.sum("mass").alias("whole"))  # one row
    cell = cell.crossJoin(F.broadcast(whole)).select(label, category, (F.col("mass") / F.col("n") / F.col("whole")).alias("weight"))
    return df.join(cell, [label, category], "left").withColumn("weight", F.coalesce("weight", F.lit(0.0)))


def masked_accuracy(predicted: str, target: str, ignore: int = -100) -> Column:
    """Share of hits among targets that are not ignored; 0 when there are none."""
    seen = F.col(target) != ignore
    return F.coalesce(F.try_divide(F.count_if(seen & (F.col(predicted) == F.col(target))).cast("double"), F.count_if(seen).cast("double")), F.lit(0.0))


def calibration_error(df: DataFrame, groups: Sequence[str], confidence: str, hit: Column, bins: int = 15) -> DataFrame:
    """Expected calibration error over equal bins (lo, hi]; a confidence of 0 is in no bin."""
    per = df.filter(F.col(confidence) > 0).groupBy(*groups, F.ceil(F.col(confidence) * bins).alias("bin")).agg(F.avg(confidence).alias("c"), F.avg(hit.cast("double")).alias("h"), F.count(F.lit(1)).alias("n"))
    n = df.groupBy(*groups).agg(F.count(F.lit(1)).alias("total"))
    out = per.groupBy(*groups).agg(F.sum(F.abs(F.col("c") - F.col("h")) * F.col("n")).alias("s"))
    joined = out.join(n, list(groups)) if groups else out.crossJoin(n)
    return joined.select(*groups, (F.col("s") / F.col("total")).alias("ece"))


def r_squared(df: DataFrame, groups: Sequence[str], y: str, predicted: str) -> DataFrame:
    """1 - residual / total sum of squares."""
    out = df.groupBy(*groups).agg(F.sum((F.col(y) - F.col(predicted)) ** 2).alias("res"), F.var_pop(y).alias("v"), F.count(y).alias("n"))
    return out.select(*groups, (1 - F.try_divide(F.col("res"), F.col("v") * F.col("n"))).alias("r2"))


def linear_fit(df: DataFrame, groups: Sequence[str], x: str, y: str) -> DataFrame:
    return df.groupBy(*groups).agg(F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"), F.corr(x, y).alias("r"))


def edge_bin(value: Column, edges: Sequence[float]) -> Column:
    """Number from 0 of the bin (edge, next edge] that holds a value; null outside."""
    above = F.size(F.filter(F.array(*map(F.lit, edges)), lambda e: e < value))
    return F.when((above > 0) & (above < len(edges)), above - 1)


def histogram(df: DataFrame, value: str, low: float, high: float, bins: int, groups: Sequence[str] = ()) -> DataFrame:
    """Counts in equal bins from 1; values outside are left out, the last bin holds its upper edge."""
    inside = df.filter(F.col(value).between(low, high))
    return inside.groupBy(*groups, F.least(F.width_bucket(F.col(value).cast("double"), F.lit(float(low)), F.lit(float(high)), F.lit(bins)), F.lit(bins)).cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def cumulative_counts(df: DataFrame, value: str, groups: Sequence[str] = (), partitions: int = 200) -> DataFrame:
    """For each distinct value, how many rows have at most it, in groups of any size."""
    n = df.groupBy(*groups, value).agg(F.count(F.lit(1)).alias("n"))
    return ranged_sums(n, groups, value, ["n"], partitions).select(*groups, value, "n", (F.col("below_n") + F.col("n")).alias("cumulative"))


def duplicated_out(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows whose key occurs once."""
    return df.withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy(*keys))).filter("_n = 1").drop("_n")


def first_by(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The first row of each key in an order that decides ties."""
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("_r = 1").drop("_r")


def top_k(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int) -> DataFrame:
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col("rank") <= k)


#: Bins of one narrowing, and the rows among which a percentile is looked up without another one.
PERCENTILE_BINS, PERCENTILE_ROWS = 4096, 200_000
#: Searches that may be broadcast.
MOST_SEARCHES = 50_000


def group_percentiles(df: DataFrame, groups: Sequence[str], value: str, shares: Sequence[float], bins: int = PERCENTILE_BINS, rows: int = PERCENTILE_ROWS) -> DataFrame:
    """(groups, percentiles): exact percentiles by linear interpolation, nulls and NaN left out, of groups of any size; groups without values have no row.

    Distributed selection: each wanted order statistic has a range of values that holds it.
    While a range holds more than ``rows`` values, a histogram over it, combined where the rows
    lie, narrows it to one bin; then the values inside are counted in order.  No group meets in a task.
    """
    checkpoints(df.sparkSession)
    held = df.filter(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double"))).select(F.struct(*groups, F.lit(0).alias("_")).alias("g"), F.col(value).cast("double").alias("v"))
    sizes = held.groupBy("g").agg(F.min("v").alias("lo"), F.max("v").alias("hi"), F.count(F.lit(1)).alias("n"))
    rank = lambda q: F.lit(float(q)) * (F.col("n") - 1)
    ranks = F.array_distinct(F.flatten(F.array(*(F.array(F.floor(rank(q)), F.ceil(rank(q))) for q in shares))))
    searches = sizes.select("g", "lo", "hi", F.lit(0).cast("long").alias("below"), F.col("n").alias("size"), F.explode(ranks).alias("k")).checkpoint()

    def inside() -> tuple[DataFrame, bool]:
        """Values in the ranges (each range once), and whether a range holds too many."""
        state = searches.agg(F.count(F.lit(1)).alias("n"), F.max(F.when(F.col("hi") > F.col("lo"), F.col("size"))).alias("most")).first()
        ranges = searches.select("g", "lo", "hi").distinct()
        ranges = F.broadcast(ranges) if state.n <= MOST_SEARCHES else ranges
        return held.join(ranges, "g").filter((F.col("v") >= F.col("lo")) & (F.col("v") <= F.col("hi"))), (state.most or 0) > rows

    while True:
        found, wide = inside()
        if not wide:
            break
        share = F.nanvl(F.coalesce(F.try_divide(F.col("v") / 2 - F.col("lo") / 2, F.col("hi") / 2 - F.col("lo") / 2), F.lit(0.5)), F.lit(0.5))
        # a range's ends never share a bin, so every round narrows it
        place = F.when(F.col("v") == F.col("lo"), 0).when(F.col("v") == F.col("hi"), bins - 1).otherwise(F.least(F.floor(share * bins), F.lit(bins - 1)))
        counts = found.groupBy("g", "lo", "hi", place.alias("bin")).agg(F.count(F.lit(1)).alias("c"), F.min("v").alias("low"), F.max("v").alias("high"))
        sofar = Window.partitionBy("g", "lo", "hi").orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
        counts = counts.withColumn("upto", F.sum("c").over(sofar))
        hit = searches.join(counts, ["g", "lo", "hi"]).filter((F.col("k") >= F.col("below") + F.col("upto") - F.col("c")) & (F.col("k") < F.col("below") + F.col("upto")))
        searches = hit.select("g", F.col("low").alias("lo"), F.col("high").alias("hi"), (F.col("below") + F.col("upto") - F.col("c")).alias("below"), F.col("c").alias("size"), "k").checkpoint()
    counts = found.groupBy("g", "lo", "hi", "v").agg(F.count(F.lit(1)).alias("c")).withColumn("upto", F.sum("c").over(Window.partitionBy("g", "lo", "hi").orderBy("v").rowsBetween(Window.unboundedPreceding, 0)))
    hit = searches.join(counts, ["g", "lo", "hi"]).filter((F.col("k") >= F.col("below") + F.col("upto") - F.col("c")) & (F.col("k") < F.col("below") + F.col("upto")))
    known = hit.groupBy("g").agg(F.map_from_entries(F.collect_list(F.struct("k", "v"))).alias("at")).join(sizes.select("g", "n"), "g")
    at = lambda x: F.element_at("at", x.cast("long"))
    lerp = lambda q: at(F.floor(rank(q))) + (at(F.ceil(rank(q))) - at(F.floor(rank(q)))) * (rank(q) - F.floor(rank(q)))
    return known.select(*(F.col("g")[c].alias(c) for c in groups), F.array(*(lerp(q) for q in shares)).alias("percentiles"))


def percentile_flags(df: DataFrame, groups: Sequence[str], value: str, low: float = 0.1, high: float = 0.9) -> DataFrame:
    """Flags for rows at or below, and at or above, their group's percentiles (linear interpolation, nulls left out)."""
    edges = group_percentiles(df, groups, value, (low, high)).select(*groups, F.col("percentiles").alias("_e"))
    joined = df.join(edges, list(groups), "left")
    return joined.withColumn("in_bottom", F.col(value) <= F.get("_e", F.lit(0))).withColumn("in_top", F.col(value) >= F.get("_e", F.lit(1))).drop("_e")


def flip_low(columns: Sequence[str], digits: int = 3) -> dict[str, Column]:
    """AUC columns turned above one half, and rounded."""
    return {c: F.round(either_way(F.col(c)), digits) for c in columns}


def score_text(score: Column, error: Column) -> Column:
    """Score and error in one cell; null when either is null."""
    return F.when(score.isNotNull() & error.isNotNull(), F.format_string("%.3f±%.3f", score, error))
