"""Queries that evaluate scores."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import evaluate as ev
from ..operators import metrics as mt
from ..operators import sampling as sp
from ..operators.logistic import logistic_out_of_fold
from .frames import SQL_LABELLED as L
from .frames import labelled
from .registry import query, table, with_checkpoints


def _auc(source: str, groups: str, score: str = "score", label: str = "quality", weight: str = "1.0") -> str:
    """Mann-Whitney over distinct scores."""
    keys = f"{groups}, " if groups else ""
    part = f"partition by {groups}" if groups else ""
    by = f"group by {groups}" if groups else ""
    return f"""(with c as (select {keys}{score} as s, sum(case when {label} = 1 then {weight} else 0 end)::double as pos, sum(case when {label} = 1 then 0 else {weight} end)::double as neg from {source} where {score} is not null and {label} is not null group by {keys}{score}),
w as (select *, coalesce(sum(neg) over ({part} order by s rows between unbounded preceding and 1 preceding), 0) as below from c)
select {keys}sum(pos) as n_pos, sum(neg) as n_neg, sum(pos * (below + neg / 2)) / nullif(sum(pos) * sum(neg), 0) as auc from w {by})"""


@query(f"select lang, n_pos, n_neg, auc, greatest(auc, 1 - auc) as auc_either from {_auc(L, 'lang')}")
def roc_auc_group(spark: SparkSession, folder: str) -> DataFrame:
    return mt.roc_auc(labelled(spark, folder), ["lang"], "score", "quality").withColumn("auc_either", mt.either_way(F.col("auc")))


@query(f"select n_pos, n_neg, auc from {_auc(L, '')}")
def roc_auc_all(spark: SparkSession, folder: str) -> DataFrame:
    with_checkpoints(spark)
    return mt.global_roc_auc(labelled(spark, folder), "score", "quality", 16)


@query(
    f"""with c as (select lang, score as threshold, count(*) filter (where quality = 1) as pos, count(*) filter (where quality = 0) as neg from {L} group by 1, 2)
select lang, threshold, sum(neg) over w / nullif(sum(neg) over (partition by lang), 0)::double as fpr, sum(pos) over w / nullif(sum(pos) over (partition by lang), 0)::double as tpr from c window w as (partition by lang order by threshold desc)"""
)
def roc_curve(spark: SparkSession, folder: str) -> DataFrame:
    return mt.roc_curve(labelled(spark, folder), ["lang"], "score", "quality", 16)


_GRID = f"(select lang, quality, n_chars::double as n_chars, length(source)::double as source_length, (doc_id % 97)::double as arbitrary from {L})"


@query(
    f"""with long as (select lang, quality, unnest(['n_chars', 'source_length', 'arbitrary']) as score_name, unnest([n_chars, source_length, arbitrary]) as score_value from {_GRID}),
cells as (select distinct lang, score_name from long) select lang, score_name, n_pos, n_neg, auc from cells left join {_auc('long', 'lang, score_name', 'score_value')} using (lang, score_name)"""
)
def auc_grid(spark: SparkSession, folder: str) -> DataFrame:
    d = labelled(spark, folder).select("lang", "quality", F.col("n_chars").cast("double").alias("n_chars"), F.length("source").cast("double").alias("source_length"), (F.col("doc_id") % 97).cast("double").alias("arbitrary"))
    return mt.auc_grid(d, ["lang"], ["n_chars", "source_length", "arbitrary"], "quality")


_FLAGS = f"(select d.*, score >= hi as in_top, score <= lo as in_bottom from {L} d join (select lang, quantile_cont(score, 0.1) as lo, quantile_cont(score, 0.9) as hi from {L} group by 1) using (lang))"


@query(
    f"""with t as (select *, 'all' as subset from {_FLAGS} union all select *, 'top' from {_FLAGS} where quality = 0 or in_top union all select *, 'bottom' from {_FLAGS} where quality = 0 or in_bottom)
select lang, subset, n_pos, n_neg, auc from {_auc('t', 'lang, subset')}"""
)
def auc_subsets(spark: SparkSession, folder: str) -> DataFrame:
    d = mt.percentile_flags(labelled(spark, folder), ["lang"], "score")
    return mt.auc_over_subsets(d, ["lang"], "score", "quality", {"top": F.col("in_top"), "bottom": F.col("in_bottom")})


@query(f"select doc_id, in_top, in_bottom from {_FLAGS}")
def percentile_flags(spark: SparkSession, folder: str) -> DataFrame:
    return mt.percentile_flags(labelled(spark, folder), ["lang"], "score").select("doc_id", "in_top", "in_bottom")


@query(
    f"""select lang, a, b, c, d, (a * d)::double / nullif(b * c, 0) as odds_ratio from (
  select lang, count(*) filter (where above and quality = 1) as a, count(*) filter (where above and quality = 0) as b, count(*) filter (where below and quality = 1) as c, count(*) filter (where below and quality = 0) as d
  from (select d.*, score > hi as above, score < lo as below from {L} d join (select lang, quantile_cont(score, 0.1) as lo, quantile_cont(score, 0.9) as hi from {L} group by 1) using (lang)) group by 1)"""
)
def odds_ratio_bands(spark: SparkSession, folder: str) -> DataFrame:
    """Bands lie above and below the percentiles, without the percentiles themselves."""
    edges = mt.group_percentiles(labelled(spark, folder), ["lang"], "score", (0.1, 0.9))
    d = labelled(spark, folder).join(edges, "lang")
    return mt.odds_ratio(d, ["lang"], "quality", F.col("score") > F.get("percentiles", F.lit(1)), F.col("score") < F.get("percentiles", F.lit(0)))


def _poisson_sql(key: str, replicate: str, most: int = 38, mean: str | None = None) -> str:
    """A Poisson draw of mean 1, or of a row's own mean, from 32 bits of the key's md5 and the replicate."""
    x = f"((('0x' || substr(md5({key}::varchar), 1, 8))::ubigint + {replicate}::ubigint * {mt._STEP}::ubigint) % 4294967296::ubigint)"
    for n, factor in zip((16, 13), mt._FACTORS):
        x = f"list_transform([{x}], lambda v: (xor(v, v >> {n}) * {factor}::ubigint) % 4294967296::ubigint)[1]"
    u = f"(list_transform([{x}], lambda v: xor(v, v >> 16))[1] / 4294967296.0)"
    if mean is None:
        return f"len(list_filter({_cumulated(most)}, lambda x: x <= {u}))"
    steps = f"list_transform(range(0, 60), lambda k: list_sum(list_transform(range(0, k + 1), lambda j: exp(j * ln({mean}) - {mean} - lgamma(j + 1)))))"
    return f"case when {mean} > 0 then len(list_filter({steps}, lambda x: x <= {u})) else 0 end"


def _digest_poisson_sql(key: str, replicate: str, most: int = 38) -> str:
    """A Poisson draw of mean 1 from 52 bits of the md5 of key and replicate."""
    u = f"(('0x' || substr(md5({key} || ':' || {replicate}), 1, 13))::bigint / 4503599627370496.0)"
    return f"len(list_filter({_cumulated(most)}, lambda x: x <= {u}))"


def _cumulated(most: int) -> str:
    import math

    total, out = 0.0, []
    for k in range(most):
        total += math.exp(-1) / math.factorial(k)
        out.append(repr(total))
    return f"[{', '.join(out)}]::double[]"


@query(
    f"""with r as (select lang, quality, score, rep, {_digest_poisson_sql('doc_id', 'rep')} as w from {L}, (select unnest(range(1, 1001)) as rep)),
a as (select lang, rep, auc from {_auc('(select * from r where w > 0)', 'lang, rep', weight='w')}),
q as (select lang, avg(auc) as replicate_mean, (quantile_cont(auc, 0.975) - quantile_cont(auc, 0.025)) / 2 as half_width from a group by 1)
select lang, n_pos, n_neg, auc, replicate_mean, half_width from {_auc(L, 'lang')} join q using (lang)"""
)
def bootstrap_auc(spark: SparkSession, folder: str) -> DataFrame:
    return mt.bootstrap_auc(labelled(spark, folder), ["lang"], "doc_id", "score", "quality", 1000, digest=True)


#: Each class gets its own class's languages of the reference, and keeps its share of the rows.
_WEIGHTED = f"""(with cur as (select * from {L} where doc_id % 2 = 0), n as (select quality, lang, count(*) as n from cur group by 1, 2), m as (select quality, lang, count(*) as m from {L} group by 1, 2),
  w as (select doc_id, quality, score, coalesce(m, 0) / n::double as w from cur join n using (quality, lang) left join m using (quality, lang)),
  k as (select *, w / sum(w) over (partition by quality) * count(*) over (partition by quality) as v from w) select doc_id, quality, score, v / sum(v) over () as weight from k)"""


def _weighted(spark: SparkSession, folder: str) -> DataFrame:
    every = labelled(spark, folder)
    return mt.reference_weights(every.filter("doc_id % 2 = 0"), "quality", "lang", every)


@query(f"select doc_id, weight from {_WEIGHTED}")
def reweight_reference(spark: SparkSession, folder: str) -> DataFrame:
    return _weighted(spark, folder).select("doc_id", "weight")


@query(f"select quality, sum(weight * score) / sum(weight) as mean from {_WEIGHTED} group by 1")
def weighted_means(spark: SparkSession, folder: str) -> DataFrame:
    return _weighted(spark, folder).groupBy("quality").agg((F.sum(F.col("weight") * F.col("score")) / F.sum("weight")).alias("mean"))


@query(
    """with c as (select l_returnflag, l_linestatus, corr(l_quantity, l_extendedprice) as r, count(*) as n from lineitem group by 1, 2)
select l_returnflag, l_linestatus, r, n, case when n > 3 then (tanh(atanh(r) + 1.96 / sqrt(n - 3)) - tanh(atanh(r) - 1.96 / sqrt(n - 3))) / 2 end as half_width from c"""
)
def pearson_ci(spark: SparkSession, folder: str) -> DataFrame:
    return mt.pearson_ci(table(spark, folder, "lineitem"), ["l_returnflag", "l_linestatus"], "l_quantity", "l_extendedprice")


@query(
    """with e as (select l_suppkey, corr(l_quantity, l_extendedprice) as r, 1.0 / sqrt(count(*)) as err, max(l_returnflag) as m, l_suppkey % 7 as g from lineitem group by 1), t as (select *, max(struct_pack(r, err)) over (partition by g) as top from e)
select l_suppkey, g, r, err from t where r + err >= top.r - top.err"""
)
def best_set(spark: SparkSession, folder: str) -> DataFrame:
    e = table(spark, folder, "lineitem").groupBy("l_suppkey").agg(F.corr("l_quantity", "l_extendedprice").alias("r"), (1.0 / F.sqrt(F.count(F.lit(1)))).alias("err")).withColumn("g", F.col("l_suppkey") % 7)
    return mt.best_set(e, ["g"], "r", "err").select("l_suppkey", "g", "r", "err")


@query("select o_orderkey, case when a >= b and a >= c then 'a' when b >= c then 'b' else 'c' end as best from (select o_orderkey, o_totalprice % 7 as a, o_totalprice % 11 as b, o_totalprice % 5 as c from orders)")
def best_column_name(spark: SparkSession, folder: str) -> DataFrame:
    o = table(spark, folder, "orders").select("o_orderkey", (F.col("o_totalprice") % 7).alias("a"), (F.col("o_totalprice") % 11).alias("b"), (F.col("o_totalprice") % 5).alias("c"))
    return mt.best_name(o, ["o_orderkey"], ["a", "b", "c"])


@query(
    f"""with b as (select lang, ceil(conf * 15) as bin, avg(conf) as c, avg(quality) as h, count(*) as n from (select lang, quality, (doc_id % 1000 + 1) / 1000.0::double as conf from {L}) group by 1, 2)
select lang, sum(abs(c - h) * n) / sum(n) as ece from b group by 1"""
)
def calibration_ece(spark: SparkSession, folder: str) -> DataFrame:
    d = labelled(spark, folder).withColumn("conf", ((F.col("doc_id") % 1000) + 1) / 1000.0)
    return mt.calibration_error(d, ["lang"], "conf", F.col("quality") == 1)


@query("select l_returnflag, 1 - sum((l_extendedprice - 1500 * l_quantity) ** 2) / (var_pop(l_extendedprice) * count(*)) as r2, regr_slope(l_extendedprice, l_quantity) as slope, regr_intercept(l_extendedprice, l_quantity) as intercept, corr(l_quantity, l_extendedprice) as r from lineitem group by 1")
def linear_fit_r2(spark: SparkSession, folder: str) -> DataFrame:
    d = table(spark, folder, "lineitem").withColumn("predicted", 1500 * F.col("l_quantity"))
    return mt.r_squared(d, ["l_returnflag"], "l_extendedprice", "predicted").join(mt.linear_fit(d, ["l_returnflag"], "l_quantity", "l_extendedprice"), "l_returnflag")


@query("select least(floor((l_quantity - 1) / 49 * 7)::int + 1, 7) as bin, count(*) as n from lineitem where l_quantity between 1 and 50 group by 1")
def histogram_quantity(spark: SparkSession, folder: str) -> DataFrame:
    return mt.histogram(table(spark, folder, "lineitem"), "l_quantity", 1.0, 50.0, 7)


@query("select l_returnflag, l_quantity, n, sum(n) over (partition by l_returnflag order by l_quantity) as cumulative from (select l_returnflag, l_quantity, count(*) as n from lineitem group by 1, 2)")
def ecdf(spark: SparkSession, folder: str) -> DataFrame:
    return mt.cumulative_counts(table(spark, folder, "lineitem"), "l_quantity", ["l_returnflag"], 16)


@query(
    """with e as (select p_brand, quantile_cont(p_retailprice, [0.25, 0.5, 0.75]) as q from part group by 1)
select p_brand, (p_retailprice > q[1])::int + (p_retailprice > q[2])::int + (p_retailprice > q[3])::int as bin, avg(p_size) as mean_size, count(*) as n from part join e using (p_brand) group by 1, 2"""
)
def quantile_bins(spark: SparkSession, folder: str) -> DataFrame:
    p = table(spark, folder, "part")
    edges = p.groupBy("p_brand").agg(F.percentile("p_retailprice", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias("q"))
    bin_ = sum(((F.col("p_retailprice") > F.col("q")[i]).cast("int") for i in (1, 2)), (F.col("p_retailprice") > F.col("q")[0]).cast("int"))
    return p.join(edges, "p_brand").groupBy("p_brand", bin_.alias("bin")).agg(F.avg("p_size").alias("mean_size"), F.count(F.lit(1)).alias("n"))



@query(
    f"""select event_type, mean, n, round(({mt.Z95} + {(mt.Z95**3 + mt.Z95) / 4} / (n - 1) + {(5 * mt.Z95**5 + 16 * mt.Z95**3 + 3 * mt.Z95) / 96} / ((n - 1) * (n - 1)::double)) * s / sqrt(n), 9) as half_width
from (select event_type, avg(value) as mean, stddev_samp(value) as s, count(value) as n from events group by 1)"""
)
def mean_student_ci(spark: SparkSession, folder: str) -> DataFrame:
    return mt.mean_ci(table(spark, folder, "events"), ["event_type"], "value").withColumn("half_width", F.round("half_width", 9))


@query(
    """select event_type, count(*) as n, max(value) as most, avg(value) as mean, median(value) as middle, count(distinct user_id) as users, avg((value > 100)::int) as share_high,
  quantile_cont(value, 0.1) as band_low, quantile_cont(value, 0.9) as band_high, count(*) / count(distinct user_id)::double as per_user from events group by 1"""
)
def group_summary(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "events").groupBy("event_type").agg(
        F.count(F.lit(1)).alias("n"), F.max("value").alias("most"), F.avg("value").alias("mean"), F.median("value").alias("middle"), F.countDistinct("user_id").alias("users"),
        F.avg(F.when(F.col("value") > 100, 1).otherwise(0)).alias("share_high"), F.percentile("value", 0.1).alias("band_low"), F.percentile("value", 0.9).alias("band_high"), (F.count(F.lit(1)) / F.countDistinct("user_id")).alias("per_user"),
    )


@query(f"select count(*) filter (where p = quality and quality <> 0) / count(*) filter (where quality <> 0)::double as accuracy from (select quality, (n_chars % 2)::int as p from {L})")
def masked_accuracy(spark: SparkSession, folder: str) -> DataFrame:
    d = labelled(spark, folder).withColumn("p", (F.col("n_chars") % 2).cast("int"))
    return d.agg(mt.masked_accuracy("p", "quality", 0).alias("accuracy"))


@query(f"select source, avg(r) as mean_r, count(*) as folds from (select source, lang, covar_pop(n_chars, length(source) + doc_id % 13) / nullif(stddev_pop(n_chars) * stddev_pop(length(source) + doc_id % 13), 0) as r from {L} group by 1, 2) group by 1")
def fold_metric_mean(spark: SparkSession, folder: str) -> DataFrame:
    d = labelled(spark, folder).groupBy("source", "lang").agg(F.try_divide(F.covar_pop("n_chars", F.length("source") + F.col("doc_id") % 13), F.stddev_pop("n_chars") * F.stddev_pop(F.length("source") + F.col("doc_id") % 13)).alias("r"))
    return d.groupBy("source").agg(F.avg("r").alias("mean_r"), F.count(F.lit(1)).alias("folds"))


@query(f"select lang, format('{{:.3f}}±{{:.3f}}', auc, 0.5 - auc / 4) as cell, round(greatest(auc, 1 - auc), 3) as auc from {_auc(L, 'lang')}")
def score_cells(spark: SparkSession, folder: str) -> DataFrame:
    a = mt.roc_auc(labelled(spark, folder), ["lang"], "score", "quality")
    return a.select("lang", mt.score_text(F.col("auc"), 0.5 - F.col("auc") / 4).alias("cell"), mt.flip_low(["auc"])["auc"].alias("auc"))


def _examples(spark: SparkSession, folder: str) -> DataFrame:
    e = table(spark, folder, "embeddings").filter("embedding is not null")
    return sp.stratified_folds(e.withColumn("is_high", (F.col("label") >= 5).cast("double")), "label", "vec_id", 3).select("vec_id", "label", "is_high", "fold", F.transform("embedding", lambda x: x.cast("double")).alias("x"))


def _vectors(df: DataFrame) -> DataFrame:
    from pyspark.ml.functions import array_to_vector

    return df.withColumn("features", array_to_vector("x"))


def _grouped(spark: SparkSession, folder: str) -> DataFrame:
    """Vectors with a group, and folds that never part one."""
    d = _examples(spark, folder).drop("fold").withColumn("y", F.col("label").cast("double")).withColumn("g", F.col("vec_id") % 12)
    return _vectors(sp.balanced_group_folds(d, "g", 3))


@query()
def ridge_oof(spark: SparkSession, folder: str) -> DataFrame:
    """Ridge with its penalty searched over inner folds of groups, held-out predictions over outer folds of groups."""
    return ev.out_of_fold(_grouped(spark, folder), "fold", range(3), lambda train, inner: ev.ridge("y", train, inner=inner), ["vec_id", "g", "y"], group="g")


@query()
def lasso_oof(spark: SparkSession, folder: str) -> DataFrame:
    return ev.out_of_fold(_grouped(spark, folder), "fold", range(3), lambda train, inner: ev.lasso("y", inner=inner), ["vec_id", "g", "y"], group="g")


@query()
def logreg_oof(spark: SparkSession, folder: str) -> DataFrame:
    return logistic_out_of_fold(_examples(spark, folder), "fold", range(3), "is_high", "vec_id", ["vec_id", "is_high"], ev.LOGISTIC_CS)


@query()
def mlp_oof(spark: SparkSession, folder: str) -> DataFrame:
    return ev.out_of_fold(_vectors(_examples(spark, folder)), "fold", range(3), lambda train, inner: ev.perceptron("is_high", (64, 16, 2)), ["vec_id", "is_high"], "probability")


@query()
def fold_table_oof(spark: SparkSession, folder: str) -> DataFrame:
    """Held-out predictions over the folds of a table."""
    d = _vectors(_examples(spark, folder).drop("fold")).withColumn("y", F.col("label").cast("double"))
    folds = table(spark, folder, "embeddings").select("vec_id", (F.col("vec_id") % 4).cast("int").alias("fold"))
    return ev.out_of_fold(ev.with_folds(d, folds, "vec_id"), "fold", range(4), lambda train, inner: ev.ridge("y", train, alphas=(100.0,), inner=2), ["vec_id", "y"])


@query()
def bagged_groups(spark: SparkSession, folder: str) -> DataFrame:
    d = _vectors(_examples(spark, folder)).withColumn("y", F.col("label").cast("double")).withColumn("g", F.col("vec_id") % 10)
    return ev.bagged(d, "g", 10, lambda: ev._scaled(ev.LinearRegression(featuresCol="scaled", labelCol="y", regParam=0.1), "features"), d, "vec_id")


@query()
def word2vec_mean(spark: SparkSession, folder: str) -> DataFrame:
    """Mean vectors of all words of four bases, at every place."""
    from pyspark.ml.functions import vector_to_array

    from .frames import sequences

    return ev.word_vectors(sequences(spark, folder).select("doc_id", "seq"), "seq", k=4).select("doc_id", vector_to_array("vector").alias("vector"))
