"""Approximate nearest neighbours by multi-index hashing.

Vectors become 128-bit codes: a rotation is learned (iterative quantisation) on a
bounded sample so that signs keep as much of the geometry as they can.  A code is
split into substrings, each with an index from value to rows.  Two codes within
Hamming distance r agree in some substring up to distance floor(r / m), so probing
every substring's buckets within that distance retrieves every code within r; the
retrieved rows are ranked again by exact inner products in double precision.

The radius is calibrated on the sample for a wanted recall, and widened for a
query that finds fewer than k rows.  Rows are dealt to blocks, queries to groups;
each pair of a block and a query group is one task's work and keeps k rows for
each query, which are merged by rank.  Groups are large, so that a row is shuffled
once for every ``QUERY_ROWS`` queries.

Defined results: vectors that are null, zero, of another length than the sample's or that hold
null or non-finite components take no part; every row is a query and a candidate
of its own, whatever its id, and meets all rows but itself (of repeated ids each
has its own list); fewer than k candidates give them all; ties go to the smaller id,
and equal vectors always tie; other columns than vec_id and embedding are left out; an empty
table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch

#: Rows on which the rotation and the radius are fitted.
SAMPLE_ROWS = 8192
SUBSTRINGS = 16
BLOCK_ROWS = 8192
QUERY_ROWS = 16384
_BITS = 128


def fit_rotation(x: np.ndarray, rounds: int = 20, seed: int = 3) -> np.ndarray:
    """Dimensions x 128: directions of most variance (and random ones where there are fewer), rotated so that signs lose little."""
    rng = np.random.default_rng(seed)
    _, vectors = np.linalg.eigh(x.T @ x / max(len(x), 1))
    base = vectors[:, ::-1][:, :_BITS]
    while base.shape[1] < _BITS:
        more = np.linalg.qr(rng.normal(size=(x.shape[1], x.shape[1])))[0]
        base = np.hstack([base, more[:, : _BITS - base.shape[1]]])
    rotation, y = np.linalg.qr(rng.normal(size=(_BITS, _BITS)))[0], x @ base
    for _ in range(rounds):
        u, _, v = np.linalg.svd(np.sign(y @ rotation).T @ y)
        rotation = (u @ v).T
    return base @ rotation


def encode(x: np.ndarray, rotation: np.ndarray) -> np.ndarray:
    """Codes as rows of 64-bit words."""
    return np.packbits(x @ rotation > 0, axis=1, bitorder="little").view(np.uint64)


def hamming(codes: np.ndarray, code: np.ndarray) -> np.ndarray:
    return np.bitwise_count(codes ^ code).sum(-1, dtype=np.int64)


def calibrate_radius(x: np.ndarray, rotation: np.ndarray, k: int, recall: float, queries: int = 256) -> int:
    """Hamming radius that holds the wanted share of the sample's true k nearest rows."""
    codes, own = encode(x, rotation), np.arange(min(queries, len(x)))
    score = x[own] @ x.T
    score[own, own] = -np.inf
    near = np.argsort(-score, axis=1)[:, : max(1, min(k, len(x) - 1))]
    distance = hamming(codes[near], codes[own, None])
    return int(np.quantile(distance, recall)) if distance.size else _BITS


#: Values of a substring in order of their distance to 0, and how many lie within each distance.
_NEAR = np.array(sorted(range(256), key=lambda v: (v.bit_count(), v)), np.uint8)
_WITHIN = np.cumsum(np.bincount(np.bitwise_count(_NEAR), minlength=9))


class MultiIndex:
    """Substring indexes over a block of codes."""

    def __init__(self, codes: np.ndarray):
        self.codes = codes
        parts = np.ascontiguousarray(codes).view(np.uint8).reshape(-1, SUBSTRINGS)  # substrings of 8 bits
        self.order = np.argsort(parts, axis=0, kind="stable")
        self.bucket = [np.searchsorted(parts[self.order[:, j], j], np.arange(257)) for j in range(SUBSTRINGS)]

    def within(self, code: np.ndarray, radius: int) -> np.ndarray:
        """Rows whose codes are within the radius: probes by the pigeonhole principle, then the whole distance."""
        probes, hit = _NEAR[: _WITHIN[min(radius // SUBSTRINGS, 8)]], np.zeros(len(self.codes), bool)
        for j, own in enumerate(np.ascontiguousarray(code).view(np.uint8)):
            values = (probes ^ own).astype(np.int64)
            begin = self.bucket[j][values]
            width = self.bucket[j][values + 1] - begin
            ends = np.cumsum(width)
            hit[self.order[np.repeat(begin - (ends - width), width) + np.arange(ends[-1]), j]] = True
        rows = np.flatnonzero(hit)
        return rows[hamming(self.codes[rows], code) <= radius]


def best_scores(v: np.ndarray, rows: np.ndarray, q: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The rows that may be among the k best, with their inner products.

    A matrix product, whose last bits depend on a row's place, only bounds the choice; what
    it leaves is summed row by row, so that equal vectors have equal products wherever they lie.
    """
    if len(rows) > k:
        rough = v[rows] @ q
        slack = 1e-12 * (1 + np.abs(q).sum()) * (1 + np.abs(v[rows]).max())
        rows = rows[rough >= np.partition(rough, len(rough) - k)[len(rough) - k] - slack]
    score = (v[rows] * q).sum(axis=1)
    if len(rows) > k:  # everything that ties with the k-th stays for the choice by id
        edge = np.partition(score, len(score) - k)[len(score) - k]
        rows, score = rows[score >= edge], score[score >= edge]
    return rows, score


def search(vectors: DataFrame, queries, k: int = 20, recall: float = 0.97, sample_rows: int = SAMPLE_ROWS, scratch: Scratch | None = None) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row of ``vectors(vec_id, embedding)`` that ``queries`` (a condition) selects, its nearest other rows found."""
    spark, scratch = vectors.sparkSession, scratch or Scratch(vectors.sparkSession)
    fit = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding")
    fit = fit.filter("vec_id is not null and embedding is not null and not exists(embedding, x -> x is null or isnan(x) or abs(x) = double('inf')) and exists(embedding, x -> x <> 0)")
    fit = scratch.save(fit.withColumn("uid", F.monotonically_increasing_id()))
    n = fit.count()
    rows = fit.select("embedding").sample(min(1.0, 1.2 * sample_rows / max(n, 1)), 11).limit(sample_rows).collect() if n else []
    widths = [len(r[0]) for r in rows]
    width = max(set(widths), key=widths.count) if widths else 0
    if not width:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    x = np.array([r[0] for r in rows if len(r[0]) == width], np.float64).reshape(-1, width)
    rotation = fit_rotation(x)
    radius = calibrate_radius(x, rotation, k, recall) if len(x) > k else _BITS
    fit = fit.filter(F.size("embedding") == width)
    asked = fit.filter(queries)
    blocks = max(1, -(-n // BLOCK_ROWS))
    groups = max(1, -(-asked.count() // QUERY_ROWS))
    deal = lambda n, salt: F.pmod(F.xxhash64("uid", F.lit(salt)), F.lit(n)).cast("int")
    stored = fit.withColumn("block", deal(blocks, 1)).withColumn("group", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    wanted = asked.withColumn("group", deal(groups, 2)).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))

    def near(left: pa.Table, right: pa.Table) -> pa.Table:
        found: list[tuple[np.ndarray, ...]] = []
        if left.num_rows and right.num_rows:
            ids, uids = left.column("vec_id").to_numpy(), left.column("uid").to_numpy()
            own_ids, own_uids = right.column("vec_id").to_numpy(), right.column("uid").to_numpy()
            values = lambda t: np.array(t.column("embedding").combine_chunks().flatten(), np.float64).reshape(-1, width)
            v, q = values(left), values(right)
            index, codes = MultiIndex(encode(v, rotation)), encode(q, rotation)
            for i in range(len(q)):
                reach = radius
                while True:
                    rows = index.within(codes[i], reach)
                    rows = rows[uids[rows] != own_uids[i]]
                    if len(rows) >= k or reach >= _BITS:
                        break
                    reach += 8
                rows, score = best_scores(v, rows, q[i], k)
                best = np.lexsort((uids[rows], ids[rows], -score))[:k]
                found.append((np.full(len(best), own_ids[i]), np.full(len(best), own_uids[i]), ids[rows[best]], uids[rows[best]], score[best]))
        cat = lambda j, kind: np.concatenate([f[j] for f in found]) if found else np.zeros(0, kind)
        return pa.table({"query_id": cat(0, np.int64), "query_uid": cat(1, np.int64), "vec_id": cat(2, np.int64), "uid": cat(3, np.int64), "score": cat(4, np.float64)})

    some = stored.groupBy("block", "group").cogroup(wanted.groupBy("block", "group")).applyInArrow(near, "query_id long, query_uid long, vec_id long, uid long, score double")
    order = Window.partitionBy("query_uid").orderBy(F.desc("score"), "vec_id", "uid")
    return some.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
