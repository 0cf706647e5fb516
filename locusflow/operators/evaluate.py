"""Supervised baselines with predictions for held-out folds, on spark.ml."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from functools import reduce

import pandas as pd
from pyspark.ml import Estimator, Pipeline
from pyspark.ml.classification import LogisticRegression, MultilayerPerceptronClassifier
from pyspark.ml.evaluation import BinaryClassificationEvaluator, RegressionEvaluator
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.regression import LinearRegression
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .sampling import bag_groups, balanced_group_folds
from .word_vectors import word_vectors  # noqa: F401


def assembled(df: DataFrame, columns: Sequence[str], to: str = "features") -> DataFrame:
    """Number columns as one vector, nulls as 0."""
    clean = df.withColumns({c: F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in columns})
    return VectorAssembler(inputCols=list(columns), outputCol=to).transform(clean)


def features_by_name(tables: dict[str, DataFrame], wanted: Sequence[str], key: str) -> tuple[DataFrame, list[str]]:
    """Named feature tables side by side on a key, and the names of all feature columns."""
    parts = [tables[n].select(key, *(F.col(c).alias(f"{n}.{c}".replace(".", "__")) for c in tables[n].columns if c != key)) for n in wanted]
    joined = reduce(lambda a, b: a.join(b, key, "full_outer"), parts)
    return joined, [c for c in joined.columns if c != key]


def _scaled(model: Estimator, features: str) -> Pipeline:
    scaler = StandardScaler(inputCol=features, outputCol="scaled", withMean=True, withStd=True)
    return Pipeline(stages=[scaler, model])


def _searched(model: Estimator, features: str, grid: Sequence[float], evaluator, inner: tuple[str, int] | int) -> Estimator:
    """Scaling and a model whose penalty is chosen by cross-validation: over a column's folds, given by its name and their number, or over that many random ones."""
    params = ParamGridBuilder().addGrid(model.regParam, [float(x) for x in grid]).build()
    folds = {"numFolds": inner} if isinstance(inner, int) else {"foldCol": inner[0], "numFolds": inner[1]}
    return CrossValidator(estimator=_scaled(model, features), estimatorParamMaps=params, evaluator=evaluator, seed=1, parallelism=4, **folds)


#: Penalties that are searched by default (fixed values): of the sum of squares for ridge, of the mean of squares for lasso.
RIDGE_ALPHAS, LASSO_ALPHAS = (10.0, 100.0, 1000.0, 10000.0), (1e-6, 1e-5, 1e-4, 1e-3, 1e-2, 1e-1)
#: Inverse penalties of the logistic regression.
LOGISTIC_CS = (1e-4, 1e-3, 1e-2, 1e-1, 1.0, 10.0)


def ridge(label: str, train: DataFrame, features: str = "features", alphas: Sequence[float] = RIDGE_ALPHAS, inner: tuple[str, int] | int = 3) -> Estimator:
    """Scaled linear regression with a squared penalty: an alpha weighs the squared coefficients against the sum of squares over the training rows.

    spark.ml weighs them against half the mean of squares of labels over their deviation: number and deviation of the labels of ``train`` turn one into the other.
    """
    seen = train.agg(F.count(label).alias("n"), F.stddev_pop(label).alias("s")).first()
    model = LinearRegression(featuresCol="scaled", labelCol=label, elasticNetParam=0.0, standardization=False, solver="normal")
    return _searched(model, features, [a * (seen.s or 1.0) / max(seen.n, 1) for a in alphas], RegressionEvaluator(labelCol=label, metricName="mse"), inner)


def lasso(label: str, features: str = "features", alphas: Sequence[float] = LASSO_ALPHAS, inner: tuple[str, int] | int = 3) -> Estimator:
    """Scaled linear regression with an absolute penalty against half the mean of squares."""
    model = LinearRegression(featuresCol="scaled", labelCol=label, elasticNetParam=1.0, standardization=False, solver="normal", maxIter=100)
    return _searched(model, features, alphas, RegressionEvaluator(labelCol=label, metricName="mse"), inner)


def logistic(label: str, train: DataFrame, features: str = "features", cs: Sequence[float] = LOGISTIC_CS, inner: tuple[str, int] | int = 3) -> Estimator:
    """Scaled logistic regression; C weighs the summed loss over the training rows against half the squared coefficients."""
    rows = train.count()
    model = LogisticRegression(featuresCol="scaled", labelCol=label, standardization=False, maxIter=50)
    return _searched(model, features, [1.0 / (c * max(rows, 1)) for c in cs], BinaryClassificationEvaluator(labelCol=label), inner)


def perceptron(label: str, layers: Sequence[int], features: str = "features") -> Estimator:
    """A multilayer perceptron (spark.ml's has no dropout and no weight decay)."""
    return _scaled(MultilayerPerceptronClassifier(featuresCol="scaled", labelCol=label, layers=list(layers), maxIter=40, seed=1), features)


def out_of_fold(df: DataFrame, fold: str, folds: Sequence, estimator: Callable[[DataFrame, tuple[str, int] | int], Estimator], keep: Sequence[str], score: str = "prediction", group: str | None = None, inner: int = 3) -> DataFrame:
    """Every row's prediction by the model trained on all other folds; ``score``: prediction, or probability of class 1.

    ``estimator(train, inner)`` makes the model for training rows and inner folds: with
    ``group``, a column that puts the training rows of a group into one inner fold, and the number of folds.
    """
    held = df.persist()
    models = []
    for k in folds:
        train = held.filter(F.col(fold) != k)
        if group:
            train = balanced_group_folds(train, group, inner, "_inner")
        models.append(estimator(train, ("_inner", inner) if group else inner).fit(train))
    held.unpersist()
    parts = []
    for k, model in zip(folds, models, strict=True):
        test = model.transform(df.filter(F.col(fold) == k))
        if score == "probability":
            from pyspark.ml.functions import vector_to_array

            test = test.withColumn("score", vector_to_array("probability")[1])
        else:
            test = test.withColumn("score", F.col("prediction").cast("double"))
        parts.append(test.select(*keep, fold, "score"))
    return reduce(DataFrame.unionByName, parts)


def with_folds(df: DataFrame, folds: DataFrame, key: str, fold: str = "fold") -> DataFrame:
    """Rows with the fold that a table gives their key; rows that it lacks go, a key that it repeats is an error."""
    from .joins import one_to_one_join

    return one_to_one_join(df, folds.select(key, fold), [key])


def bagged(df: DataFrame, group: str, rounds: int, estimator: Callable[[], Estimator], test: DataFrame, key: str) -> DataFrame:
    """Mean prediction of models each trained on a bag of groups."""
    bags = bag_groups(df, group, rounds).persist()
    models = [estimator().fit(bags.filter(F.col("round") == r)) for r in range(1, rounds + 1)]
    bags.unpersist()
    parts = [m.transform(test).select(key, "prediction") for m in models]
    return reduce(DataFrame.unionByName, parts).groupBy(key).agg(F.avg("prediction").alias("prediction"))


#: Groups of a leave-one-group-out, each of which is a model.
MOST_GROUPS = 1000


def leave_one_group_out(df: DataFrame, group: str) -> tuple[DataFrame, list]:
    """Fold = the group, and the list of folds; more than ``MOST_GROUPS`` groups are an error."""
    groups = sorted(r[0] for r in df.select(group).distinct().limit(MOST_GROUPS + 1).collect())
    if len(groups) > MOST_GROUPS:
        raise ValueError(f"more than {MOST_GROUPS} groups")
    return df.withColumn("fold", F.col(group)), groups


def score_in_batches(df: DataFrame, scorer: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """A user's batch scorer over sequences, in Arrow batches."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield scorer(batch)

    return df.mapInPandas(run, schema)


def score_missing(df: DataFrame, shard: str, path: str, scorer: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """Scores of all rows, shard by shard, written below ``path``; shards that an earlier run finished are not scored again.

    A shard is one task and one file, which appears whole or not at all: a run that was stopped goes on where it ended.
    Only the shards' names are listed; what is left to score is an anti-join.  ``schema`` names the scorer's columns, of
    which the shard is one.
    """
    spark = df.sparkSession
    top = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = top.getFileSystem(spark._jsc.hadoopConfiguration())
    if fs.exists(top) and any(f.isDirectory() and f.getPath().getName().startswith(f"{shard}=") for f in fs.listStatus(top)):
        done = spark.read.parquet(path).select(F.col(shard).cast(df.schema[shard].dataType).alias(shard)).distinct()
        left = df.join(done, shard, "left_anti")
    else:
        left = df
    scored = score_in_batches(left.repartition(shard).sortWithinPartitions(shard), scorer, schema)
    scored.write.mode("append").partitionBy(shard).parquet(path)
    return spark.read.parquet(path)
