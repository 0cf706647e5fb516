"""Logistic regressions of all folds and penalties, trained together: a pass over the rows serves every model."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .checkpoints import scratch_folder
from .metrics import ranged_roc_auc
from .sampling import hash_fraction

#: Most passes of a training, steps that are remembered, and the decrease (of the mean loss) below which a model has settled.
MOST_PASSES, MEMORY, SETTLED = 100, 10, 1e-12

Rows = tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]


def _sums(rows: DataFrame, shift: np.ndarray, size: int, add: Callable[[np.ndarray, Rows], None]) -> np.ndarray:
    """Sums over all rows: ``add`` adds a batch (vectors less ``shift``, labels, folds, inner folds) to a task's ``size`` numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size)
        for batch in batches:
            if batch.num_rows:
                add(total, (_vectors(batch.column(0), len(shift)) - shift, *(batch.column(i).to_numpy(zero_copy_only=False) for i in (1, 2, 3))))
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at])], names=["at", "value"])

    found = rows.select("x", "y", "fold", "inner").mapInArrow(run, "at long, value double").groupBy("at").agg(F.sum("value").alias("value")).toArrow()
    out = np.zeros(size)
    out[found.column("at").to_numpy()] = found.column("value").to_numpy()
    return out


def _vectors(column: pa.Array, width: int) -> np.ndarray:
    values = column.flatten().to_numpy(zero_copy_only=False)
    if column.null_count or len(values) != width * len(column) or not np.isfinite(values).all():
        raise ValueError("vectors must have one length and finite components")
    return values.reshape(-1, width)


def _sigmoid(margin: np.ndarray) -> np.ndarray:
    return 0.5 + 0.5 * np.tanh(0.5 * margin)


class _Path:
    """Steps of one model: L-BFGS from the bound of its curvature, halved until the loss falls."""

    def __init__(self, at: np.ndarray, bound: np.ndarray):
        self.at, self.bound, self.loss, self.steps, self.done = at, np.linalg.inv(bound), None, [], False
        self.trial = at

    def see(self, loss: float, slope: np.ndarray) -> None:
        if self.loss is not None:
            if loss > self.loss + 1e-4 * self.rate * self.fall:
                self.rate /= 2
                self.trial = self.at + self.rate * self.way
                self.done = self.rate < 1e-6
                return
            moved, turned = self.trial - self.at, slope - self.slope
            if moved @ turned > 0:
                self.steps = [*self.steps, (moved, turned, 1 / (moved @ turned))][-MEMORY:]
        self.at, self.loss, self.slope = self.trial, loss, slope
        way, shares = -slope, []
        for moved, turned, inverse in reversed(self.steps):
            shares.append(inverse * (moved @ way))
            way = way - shares[-1] * turned
        way = self.bound @ way
        for (moved, turned, inverse), share in zip(self.steps, reversed(shares), strict=True):
            way = way + (share - inverse * (turned @ way)) * moved
        self.way, self.rate, self.fall = way, 1.0, float(slope @ way)
        self.trial, self.done = self.at + way, -self.fall <= SETTLED


def logistic_out_of_fold(df: DataFrame, fold: str, folds: Sequence, label: str, key: str, keep: Sequence[str], cs: Sequence[float], vector: str = "x", inner: int = 3, seed: int = 1) -> DataFrame:
    """Every row's probability of class 1 by the model trained on all other folds: ``out_of_fold`` with ``logistic``, whose losses these are.

    C is searched by AUC over inner folds, which a hash of ``key`` deals.  AUC is exact, from sums over ranges of scores.  The models of all folds, inner folds and
    penalties are columns of one matrix: each pass over the written rows gives the loss and slope of all of them, and only
    those sums reach the driver.
    """
    spark, folds, cs = df.sparkSession, list(folds), list(cs)
    number = F.coalesce(*(F.when(F.col(fold) == v, i) for i, v in enumerate(folds)), F.lit(-1))
    path = scratch_folder(spark, "folds")
    wanted = df.filter(F.col(fold).isNotNull()).select(*keep, fold, F.struct(F.col(vector).alias("x"), F.col(label).cast("double").alias("y"), number.alias("fold"), F.least(F.floor(hash_fraction(key, seed) * inner), F.lit(inner - 1)).cast("int").alias("inner")).alias("_row"))
    wanted.write.option("compression", "zstd").parquet(path)
    held = spark.read.schema(wanted.schema).parquet(path)
    rows = held.select("_row.*")
    first = rows.first()
    if first is None:
        return held.select(*keep, fold, F.lit(None).cast("double").alias("score"))
    if not rows.filter("y is null or y not in (0, 1)").isEmpty():
        raise ValueError("labels must be 0 or 1")
    shift = np.array(first["x"], float)
    d, n_cells, n_groups = len(shift), (len(folds) + 1) * inner, len(folds) * (inner + 1)

    # numbers, labels, sums and products of each (fold, inner fold)
    def moments(total: np.ndarray, batch: Rows) -> None:
        x, y, outer, within = batch
        by_cell, cell = total.reshape(n_cells, -1), (outer + 1) * inner + within
        for c in np.unique(cell):
            own = x[cell == c]
            by_cell[c] += np.concatenate([[len(own), y[cell == c].sum()], own.sum(axis=0), (own.T @ own).ravel()])

    cells = _sums(rows, shift, n_cells * (2 + d + d * d), moments).reshape(len(folds) + 1, inner, -1)
    trained_on = lambda outer, within, g: (outer != g // (inner + 1)) & (within != g % (inner + 1))
    outer_at, inner_at = np.meshgrid(np.arange(-1, len(folds)), np.arange(inner), indexing="ij")
    sums = np.array([cells[trained_on(outer_at, inner_at, g)].sum(axis=0) for g in range(n_groups)])
    n = np.maximum(sums[:, 0], 1)
    mean = sums[:, 2 : 2 + d] / n[:, None]
    spread = sums[:, 2 + d :].reshape(-1, d, d) / n[:, None, None] - mean[:, :, None] * mean[:, None, :]
    deviation = np.sqrt(np.maximum(np.einsum("gii->gi", spread), 0) * (n / np.maximum(n - 1, 1))[:, None])
    # a component that does not vary counts as 0, as in spark.ml's scaler
    varies = deviation > 1e-7 * np.abs(mean)
    scale = np.where(varies, 1 / np.where(varies, deviation, 1.0), 0.0)
    spread = spread * scale[:, :, None] * scale[:, None, :]
    group = np.repeat(np.arange(n_groups), len(cs))
    # the penalty of an outer fold's training rows holds for its inner folds too
    penalty = np.array([1.0 / (c * n[g // (inner + 1) * (inner + 1) + inner]) for g in range(n_groups) for c in cs])
    with np.errstate(divide="ignore"):
        base = np.clip(np.nan_to_num(np.log(sums[:, 1]) - np.log(sums[:, 0] - sums[:, 1])), -700, 700)
    models = []
    for g, p in zip(group, penalty, strict=True):
        bound = np.zeros((d + 1, d + 1))
        bound[:d, :d] = spread[g] / 4 + p * np.eye(d)
        bound[d, d] = 0.25
        models.append(_Path(np.append(np.zeros(d), base[g]), bound))
        models[-1].done = not 0 < sums[g, 1] < sums[g, 0]

    def raw(g: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Weights and intercepts for vectors less ``shift``, of models over scaled ones."""
        weights = at[:, :d] * scale[g]
        return weights.T, at[:, d] - (weights * mean[g]).sum(axis=1)

    for _ in range(MOST_PASSES):
        live = [i for i, m in enumerate(models) if not m.done]
        if not live:
            break
        of, at = group[live], np.array([models[i].trial for i in live])
        weights, intercept = raw(of, at)

        def slopes(total: np.ndarray, batch: Rows, of=of, weights=weights, intercept=intercept) -> None:
            x, y, outer, within = batch
            margin = x @ weights + intercept
            part = trained_on(outer[:, None], within[:, None], of[None, :])
            rest = (_sigmoid(margin) - y[:, None]) * part
            by_model = total.reshape(d + 2, -1)
            by_model[:d] += x.T @ rest
            by_model[d] += rest.sum(axis=0)
            by_model[d + 1] += ((np.logaddexp(0, margin) - y[:, None] * margin) * part).sum(axis=0)

        seen = _sums(rows, shift, (d + 2) * len(live), slopes).reshape(d + 2, -1)
        for j, i in enumerate(live):
            g, w = group[i], at[j, :d]
            slope = (seen[:d, j] - mean[g] * seen[d, j]) * scale[g] / n[g] + penalty[i] * w
            models[i].see(seen[d + 1, j] / n[g] + penalty[i] / 2 * (w @ w), np.append(slope, seen[d, j] / n[g]))

    at = np.array([m.at for m in models])
    weights, intercept = raw(group, at)
    searched = np.flatnonzero(group % (inner + 1) != inner)

    def held_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, (y, outer, within) = _vectors(batch.column(0), d) - shift, (batch.column(i).to_numpy(zero_copy_only=False) for i in (1, 2, 3))
            # vectors that are equal tie, wherever they lie
            margin = np.round(x @ weights[:, searched] + intercept[searched], 12)
            row, model = np.nonzero((outer[:, None] != group[searched] // (inner + 1)) & (within[:, None] == group[searched] % (inner + 1)))
            yield pa.RecordBatch.from_arrays([pa.array(model.astype(np.int32)), pa.array(margin[row, model]), pa.array(y[row])], names=["model", "score", "y"])

    margins = rows.select("x", "y", "fold", "inner").mapInArrow(held_out, "model int, score double, y double")
    by_model = ranged_roc_auc(margins, ["model"], "score", "y", max(8, min(200, int(cells[:, :, 0].sum()) * len(folds) * len(cs) // 1_000_000)))
    auc = np.full(len(searched), 0.5)
    for r in by_model.filter("auc is not null").collect():
        auc[r["model"]] = r["auc"]
    auc = auc.reshape(len(folds), inner, len(cs)).mean(axis=1)
    chosen = [(k * (inner + 1) + inner) * len(cs) + int(np.argmax(auc[k])) for k in range(len(folds))]
    weights, intercept = weights[:, chosen], intercept[chosen]

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, own = batch.column(batch.num_columns - 1), batch.select(list(range(batch.num_columns - 1)))
            outer = row.field("fold").to_numpy(zero_copy_only=False)
            margin = (_vectors(row.field("x"), d) - shift) @ weights + intercept
            score = _sigmoid(margin[np.arange(len(outer)), np.maximum(outer, 0)])
            yield pa.RecordBatch.from_arrays([*own.columns, pa.array(score)], names=[*own.schema.names, "score"])

    result = held.drop("_row").withColumn("score", F.lit(0.0)).schema
    # rows of other folds are only trained on
    return held.filter("_row.fold >= 0").mapInArrow(scored, result)
