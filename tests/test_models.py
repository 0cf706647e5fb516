"""Models of spark.ml against closed forms and properties; a scorer that goes on where it was stopped."""

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from locusflow.operators import evaluate as ev, sampling as sp
from locusflow.plans import metric_queries  # noqa: F401
from locusflow.plans.registry import QUERIES

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def made(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(300, 4)) * [1, 5, 0.1, 2] + 3
    y = x @ [1.0, -0.5, 4.0, 0.0] + rng.normal(size=300)
    df = spark.createDataFrame([(i, [float(v) for v in r], float(t), i % 7) for i, (r, t) in enumerate(zip(x, y))], "id long, x array<double>, y double, g long")
    return df.withColumn("features", array_to_vector("x")).cache(), x, y


def test_ridge_equals_its_closed_form(made):
    df, x, y = made
    for alpha in (10.0, 1000.0):
        best = ev.ridge("y", df, alphas=(alpha,), inner=2).fit(df).bestModel.stages[-1]
        z = (x - x.mean(0)) / x.std(0, ddof=1)
        wanted = np.linalg.solve(z.T @ z + alpha * np.eye(4), z.T @ (y - y.mean()))
        assert np.allclose(best.coefficients.toArray(), wanted, atol=1e-5) and abs(best.intercept - y.mean()) < 1e-6


def test_lasso_drops_what_does_not_help(made):
    df, _, _ = made
    best = ev.lasso("y", alphas=(0.2,), inner=2).fit(df).bestModel.stages[-1]
    assert best.coefficients[3] == 0 and all(best.coefficients[i] != 0 for i in range(3))


def test_inner_and_outer_folds_never_part_a_group(made):
    df, _, _ = made
    seen = []

    def estimator(rows, inner):
        model = ev.ridge("y", rows, alphas=(1.0, 100.0), inner=inner)
        fit = model.fit

        def noted(train):
            folds = train.groupBy("g").agg(F.countDistinct(inner[0]).alias("n")).collect()
            assert all(r.n == 1 for r in folds) and train.select(inner[0]).distinct().count() == 3
            seen.append({r.g for r in folds})
            return fit(train)

        model.fit = noted
        return model

    folded = sp.balanced_group_folds(df, "g", 3)
    out = ev.out_of_fold(folded, "fold", range(3), estimator, ["id", "g"], group="g").collect()
    assert sorted(r.id for r in out) == list(range(300)) and len(seen) == 3
    for k in range(3):
        assert not {r.g for r in out if r.fold == k} & seen[k]
    sizes = sorted(r["count"] for r in folded.groupBy("fold").count().collect())
    assert sizes[-1] - sizes[0] <= 43


def test_leave_one_group_out_and_fold_tables(made):
    df, _, _ = made
    folded, groups = ev.leave_one_group_out(df, "g")
    assert groups == list(range(7)) and folded.filter("fold <> g").count() == 0
    table = df.filter("id < 200").select("id", (F.col("id") % 2).alias("fold"))
    assert ev.with_folds(df, table, "id").count() == 200
    with pytest.raises(Exception, match="repeats a key"):
        ev.with_folds(df, table.unionByName(table), "id").collect()


def test_groups_are_drawn_by_their_size(spark):
    sizes = {0: 1, 1: 10, 2: 300}
    df = spark.createDataFrame([(g, i) for g, n in sizes.items() for i in range(n)], "g long, i long")
    rounds = 400
    drawn = {r.g: r.n for r in sp.bag_groups(df, "g", rounds).groupBy("g").agg(F.countDistinct("round").alias("n")).collect()}
    for g, n in sizes.items():
        p = 1 - (1 - n / 311) ** 311
        assert abs(drawn[g] / rounds - p) < 4 * (p * (1 - p) / rounds) ** 0.5 + 1e-9


@pytest.mark.parametrize("name", ["ridge_oof", "lasso_oof", "logreg_oof", "mlp_oof", "fold_table_oof"])
def test_every_row_is_predicted_once(spark, name):
    out = QUERIES[name](spark, FOLDER).toPandas()
    assert out.vec_id.is_unique and len(out) == 500 and out.score.notna().all()
    if name in ("logreg_oof", "mlp_oof"):
        assert out.score.between(0, 1).all()


def test_bags_and_word_vectors(spark):
    bags = QUERIES["bagged_groups"](spark, FOLDER).toPandas()
    assert bags.vec_id.is_unique and len(bags) == 500 and bags.prediction.notna().all()
    words = spark.createDataFrame([(1, ["AC", "CG"] * 20), (2, ["AC"] * 5), (3, ["CG"] * 5)], "id int, t array<string>")
    from pyspark.ml.functions import vector_to_array

    v = {r.id: np.array(r.v) for r in ev.word_vectors(words, "t", size=8, partitions=2).select("id", vector_to_array("vector").alias("v")).collect()}
    assert np.allclose(v[1], (v[2] + v[3]) / 2, atol=1e-6) and v[1].shape == (8,)
    out = QUERIES["word2vec_mean"](spark, FOLDER).toPandas()
    assert out.doc_id.is_unique and {len(x) for x in out.vector} == {128}


def test_scorer_goes_on_where_it_was_stopped(spark, tmp_path):
    import pandas as pd

    df = spark.range(40).select("id", (F.col("id") % 4).cast("int").alias("shard"), F.col("id").cast("string").alias("seq"))
    path, count = str(tmp_path / "scores"), spark.sparkContext.accumulator(0)

    def scorer(batch: pd.DataFrame) -> pd.DataFrame:
        count.add(len(batch))
        return pd.DataFrame({"id": batch.id, "shard": batch.shard, "score": batch.seq.str.len().astype(float)})

    schema = "id long, shard int, score double"
    ev.score_missing(df.filter("shard < 2"), "shard", path, scorer, schema)
    assert count.value == 20
    out = ev.score_missing(df, "shard", path, scorer, schema)
    assert count.value == 40 and out.count() == 40 and out.select("id").distinct().count() == 40
    assert ev.score_missing(df, "shard", path, scorer, schema).count() == 40 and count.value == 40


def test_word_vectors_follow_the_words_and_not_the_partitions(spark):
    from pyspark.ml.functions import vector_to_array

    from locusflow.operators import word_vectors as wv

    rng = np.random.default_rng(3)
    seqs = ["".join(rng.choice(list("ACGT"), n, p=[0.5, 0.2, 0.2, 0.1])) for n in (0, 1, 2, 5, 60, 300, 2500)]
    df = spark.createDataFrame(list(enumerate(seqs)), "id int, seq string")
    get = lambda d: {r.id: np.array(r.v) for r in d.select("id", vector_to_array("vector").alias("v")).collect()}
    # the same words, as tokens that are made and as words of a text; rows in one partition and in many
    tokens = spark.createDataFrame([(i, [s[j : j + 2] for j in range(len(s) - 1)]) for i, s in enumerate(seqs)], "id int, t array<string>")
    one, many, made = get(ev.word_vectors(df.coalesce(1), "seq", size=8, k=2)), get(ev.word_vectors(df.repartition(5), "seq", size=8, k=2, partitions=3)), get(ev.word_vectors(tokens, "t", size=8))
    for i in range(len(seqs)):
        assert np.allclose(one[i], many[i], atol=1e-6) and np.allclose(one[i], made[i], atol=1e-6)
    assert not one[0].any() and not one[1].any() and one[2].any()
    # pairs at every place, each distance by how often a window reaches it
    words, window = sorted({s[j : j + 2] for s in seqs for j in range(len(s) - 1)}), 3
    want: dict = {}
    for s in seqs:
        ids = [words.index(s[j : j + 2]) for j in range(len(s) - 1)]
        for i in range(len(ids)):
            for d in range(1, min(window, len(ids) - 1 - i) + 1):
                want[ids[i], ids[i + d]] = want.get((ids[i], ids[i + d]), 0) + window - d + 1
    got = wv._pair_counts(df, "seq", wv._of_bases(words, 2), len(words), window).groupBy("a", "b").agg(F.sum("n").alias("n"))
    assert {(r.a, r.b): r.n for r in got.collect()} == want


def test_word_vectors_learn_the_pairs(spark):
    from locusflow.operators import word_vectors as wv

    rng = np.random.default_rng(5)
    n = rng.integers(1, 100, (6, 6))
    n = n + n.T
    pairs = spark.createDataFrame([(a, b, int(n[a, b])) for a in range(6) for b in range(6)], "a long, b long, n long")
    counts = n.sum(axis=1).tolist()
    nodes, turns = wv.huffman(counts)
    assert abs(sum(2.0 ** -len(t) for t in turns) - 1) < 1e-12 and len({tuple(zip(a, b, strict=True)) for a, b in zip(nodes, turns, strict=True)}) == 6
    # as many dimensions as words: the likelihood comes near that of the pairs' own shares
    _, seen = wv.trained(pairs, counts, 8, 1, 2, 300)
    best = float((n * np.log(n / n.sum(axis=1, keepdims=True))).sum() / n.sum())
    alone = float((n * np.log(n.sum(axis=0) / n.sum())).sum() / n.sum())
    assert seen[0] < alone < seen[-1] <= best + 1e-9 and seen[-1] > best - 0.1 * (best - alone)


def test_logistic_models_of_all_folds_are_trained_together(spark):
    from pyspark.ml.functions import vector_to_array

    from locusflow.operators.logistic import logistic_out_of_fold

    rng = np.random.default_rng(7)
    x = rng.normal(size=(240, 3)) * [1, 20, 0.1] + [0, 1000, 3]
    y = (x @ [1.0, 0.05, 5.0] + rng.normal(size=240) > 65).astype(float)
    rows = [(i, [*(float(v) for v in r), 4.0], float(t), i % 2) for i, (r, t) in enumerate(zip(x, y))]
    df = spark.createDataFrame(rows, "id long, x array<double>, y double, fold int").repartition(3)
    cs, sc = (0.003, 0.3, 10.0), spark.sparkContext
    sc.setJobGroup("together", "")
    got = {r.id: r for r in logistic_out_of_fold(df, "fold", [0, 1], "y", "id", ["id"], cs).collect()}
    jobs = len(sc.statusTracker().getJobIdsForGroup("together"))
    sc.setJobGroup("alone", "")
    inner = df.withColumn("inner", F.floor(sp.hash_fraction("id", 1) * 3).cast("int")).withColumn("features", array_to_vector("x")).cache()
    for k in (0, 1):
        train = inner.filter(F.col("fold") != k)
        model = ev.logistic("y", train, cs=cs, inner=("inner", 3)).fit(train)
        for r in model.transform(inner.filter(F.col("fold") == k)).select("id", vector_to_array("probability")[1].alias("p")).collect():
            assert got[r.id].fold == k and abs(got[r.id].score - r.p) < 1e-3
    alone = len(sc.statusTracker().getJobIdsForGroup("alone"))
    assert len(got) == 240 and jobs < 80 < alone
    # twice as many penalties take no more jobs for each model
    sc.setJobGroup("more", "")
    logistic_out_of_fold(df, "fold", [0, 1], "y", "id", ["id"], (0.003, 0.01, 0.1, 0.3, 1.0, 10.0)).collect()
    assert len(sc.statusTracker().getJobIdsForGroup("more")) < jobs + 20
    sc.setJobGroup("", "")
    # one class, and no rows
    one = logistic_out_of_fold(df.withColumn("y", F.lit(1.0)), "fold", [0, 1], "y", "id", ["id"], cs).toPandas()
    assert len(one) == 240 and (one.score > 0.999).all()
    assert logistic_out_of_fold(df.limit(0), "fold", [0, 1], "y", "id", ["id"], cs).count() == 0
