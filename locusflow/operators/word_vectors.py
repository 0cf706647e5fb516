"""Skip-gram word vectors (hierarchical softmax) from counts of word pairs.

What skip-gram learns from a corpus is, for each pair of words, how often one stands in the
other's window.  These counts are taken at every place of every whole row in one pass; the
training then goes over distinct pairs, so that its work follows the vocabulary and not the
corpus.  A window is as word2vec draws it, from 1 to ``window`` words to either side, with each
distance weighed by how often it is drawn.  All sums of the corpus are whole numbers, and the
gradient is that of all pairs: vectors do not depend on how rows lie in partitions (but for the
rounding of sums).

As in spark.ml's Word2Vec, the driver holds the vocabulary and its vectors.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructType

from .kmers import _blocks, _digits, _words, corpus_kmer_counts

#: Full steps over all pairs, and the size of a step.
ROUNDS, RATE = 60, 0.05
#: Pairs of a vocabulary that a task counts in one array, and pairs that are worked on at once.
DENSE, AT_ONCE = 1 << 22, 1 << 14

#: Numbers the tokens of a batch's column: (first row, number of each token or -1, row of each token, all tokens of each row), in blocks.
Numbers = Callable[[pa.Array], Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]]


def _of_tokens(words: list[str]) -> Numbers:
    known = pa.array(words, pa.string())

    def numbers(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        sizes = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        ids = pc.index_in(pc.list_flatten(column).cast(pa.string()), known).fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
        yield 0, ids, np.repeat(np.arange(len(sizes)), sizes), sizes

    return numbers


def _of_bases(words: list[str], k: int) -> Numbers:
    place = np.full(4**k, -1, np.int64)
    place[[int(w.translate(str.maketrans("ACGT", "0123")), 4) for w in words]] = np.arange(len(words))

    def numbers(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        for at, data, ends in _blocks(column):
            digits, owner = _digits(data, ends)
            value, known = _words(digits, owner, k)
            row = owner[: len(known)][known]
            yield at, place[value[known]], row, np.bincount(row, minlength=len(ends))

    return numbers


def _pair_counts(df: DataFrame, column: str, numbers: Numbers, size: int, window: int) -> DataFrame:
    """(a, b, n): how often word b stands within the window behind word a, a distance d counting ``window - d + 1`` times; rows of the same pair from each task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dense = np.zeros(size * size, np.int64) if size * size <= DENSE else None

        def made(code: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(code // size), pa.array(code % size), pa.array(n)], names=["a", "b", "n"])

        for batch in batches:
            for _, ids, row, _ in numbers(batch.column(0)):
                ids, row = ids[ids >= 0], row[ids >= 0]
                for d in range(1, window + 1):
                    code = (ids[:-d] * size + ids[d:])[row[:-d] == row[d:]]
                    if dense is not None:
                        dense += np.bincount(code, minlength=len(dense)) * (window - d + 1)
                    elif len(code):
                        code, n = np.unique(code, return_counts=True)
                        yield made(code, n.astype(np.int64) * (window - d + 1))
        if dense is not None and dense.any():
            code = np.flatnonzero(dense)
            yield made(code, dense[code])

    return df.select(column).mapInArrow(run, "a long, b long, n long")


def huffman(counts: list[int]) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """The inner nodes on each word's way from the root, and the turns taken there."""
    n = len(counts)
    heap = [(c, i) for i, c in enumerate(counts)]
    heapq.heapify(heap)
    parent, turn = np.zeros(2 * n, np.int64), np.zeros(2 * n, np.int64)
    for made in range(n, 2 * n - 1):
        (x, i), (y, j) = heapq.heappop(heap), heapq.heappop(heap)
        parent[[i, j]], turn[j] = made, 1
        heapq.heappush(heap, (x + y, made))
    nodes, turns = [], []
    for i in range(n):
        way, at = [], i
        while at < 2 * n - 2:
            way.append((parent[at] - n, turn[at]))
            at = parent[at]
        nodes.append(np.array([w[0] for w in way[::-1]], np.int64))
        turns.append(np.array([w[1] for w in way[::-1]], np.int64))
    return nodes, turns


def _choices(nodes: list[np.ndarray], turns: list[np.ndarray]) -> Callable[[Iterator], Iterator[tuple[np.ndarray, ...]]]:
    """Pairs of a task as (word, node, times turned 0, times turned 1), in order of the word."""
    size = len(nodes)

    def run(rows: Iterator) -> Iterator[tuple[np.ndarray, ...]]:
        table = np.array([(r[0], r[1], r[2]) for r in rows], np.int64).reshape(-1, 3)
        if not len(table):
            return
        steps = np.array([len(x) for x in nodes])[table[:, 1]]
        word, n = np.repeat(table[:, 0], steps), np.repeat(table[:, 2], steps).astype(float)
        node, turned = (np.concatenate([way[b] for b in table[:, 1]]) for way in (nodes, turns))
        code, of = np.unique(word * size + node, return_inverse=True)
        sums = [np.bincount(of, n * (turned == t), minlength=len(code)) for t in (0, 1)]
        yield code // size, code % size, *sums

    return run


def _summed(index: np.ndarray, rows: np.ndarray, to: np.ndarray) -> None:
    order = np.argsort(index, kind="stable")
    heads = np.flatnonzero(np.diff(index[order], prepend=-1))
    to[index[order][heads]] += np.add.reduceat(rows[order], heads)


def _gradient(part: tuple[np.ndarray, ...], model: np.ndarray) -> tuple[np.ndarray, float]:
    """The gradient of the log-likelihood of a task's pairs in the model (vectors of words, vectors of nodes), and this likelihood."""
    out, likelihood = np.zeros_like(model), 0.0
    for at in range(0, len(part[0]), AT_ONCE):
        word, node, left, right = (x[at : at + AT_ONCE] for x in part)
        own, way = model[0][word], model[1][node]
        score = np.einsum("ij,ij->i", own, way)
        likelihood -= float(left @ np.logaddexp(0, -score) + right @ np.logaddexp(0, score))
        step = (left - (left + right) / (1 + np.exp(-score)))[:, None]
        _summed(word, step * way, out[0])
        _summed(node, step * own, out[1])
    return out, likelihood


def _weights(part: tuple[np.ndarray, ...], size: int) -> np.ndarray:
    return np.stack([np.bincount(part[i], part[2] + part[3], minlength=size) for i in (0, 1)])


def trained(pairs: DataFrame, counts: list[int], size: int, seed: int, tasks: int, rounds: int = ROUNDS) -> tuple[np.ndarray, list[float]]:
    """Vectors of words from symmetric ``pairs(a, b, n)``, and the mean log-likelihood of a pair before each round.

    Adam over the full gradient, with each vector's part divided by the weight of its pairs.
    """
    spark = pairs.sparkSession
    sent = spark.sparkContext.broadcast(huffman(counts))
    whole, distinct = pairs.agg(F.sum("n"), F.count(F.lit(1))).first()
    # a model goes to each task and a gradient comes back in each round
    held = pairs.repartition(max(1, min(tasks, distinct // AT_ONCE)), "a").select("a", "b", "n").rdd.mapPartitions(lambda rows: _choices(*sent.value)(rows)).persist()
    words = len(counts)
    weight = held.map(lambda part: _weights(part, words)).treeReduce(np.add)[:, :, None]
    model = np.zeros((2, words, size))
    model[0] = (np.random.default_rng(seed).random((words, size)) - 0.5) / size
    mean, square, seen = np.zeros_like(model), np.zeros_like(model), []
    for r in range(1, rounds + 1):
        now = spark.sparkContext.broadcast(model)
        gradient, likelihood = held.map(lambda part: _gradient(part, now.value)).treeReduce(lambda x, y: (x[0] + y[0], x[1] + y[1]))  # noqa: B023
        now.destroy()
        seen.append(likelihood / whole)
        gradient = gradient / np.maximum(weight, 1)
        mean, square = 0.9 * mean + 0.1 * gradient, 0.99 * square + 0.01 * gradient**2
        model = model + RATE * (1 - r / (rounds + 1)) * (mean / (1 - 0.9**r)) / (np.sqrt(square / (1 - 0.99**r)) + 1e-8)
    held.unpersist()
    return model[0], seen


def word_vectors(df: DataFrame, tokens: str, size: int = 128, window: int = 5, least: int = 1, seed: int = 1, partitions: int | None = None, k: int | None = None) -> DataFrame:
    """``df`` with the mean skip-gram vector of each row's tokens (rows without tokens: zeros); words that occur fewer than ``least`` times have none.

    ``tokens`` is an array of words, or with ``k`` a text whose words of k bases are the tokens (those with
    other characters than A, C, G, T are left out): these are numbered where they stand and never made.  Training runs
    in at most ``partitions`` tasks (the shuffle's number by default).
    """
    from pyspark.ml.functions import array_to_vector

    if k is None:
        counted = df.select(F.explode(tokens).alias("w")).filter("w is not null").groupBy("w").agg(F.count(F.lit(1)).alias("n"))
    else:
        counted = corpus_kmer_counts(df, tokens, k).filter(F.col("k") == k).select(F.col("kmer").alias("w"), F.col("n").cast("long").alias("n"))
    known = sorted(((r.w, r.n) for r in counted.filter(F.col("n") >= least).collect()), key=lambda x: (-x[1], x[0]))
    words = [w for w, _ in known]
    numbers = _of_tokens(words) if k is None else _of_bases(words, k)
    vectors = np.zeros((len(words), size))
    if words:
        one_way = _pair_counts(df, tokens, numbers, len(words), window)
        pairs = one_way.select("a", "b", "n").unionByName(one_way.select(F.col("b").alias("a"), F.col("a").alias("b"), "n")).groupBy("a", "b").agg(F.sum("n").alias("n")).persist()
        if pairs.take(1):
            vectors, _ = trained(pairs, [n for _, n in known], size, seed, partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
        pairs.unpersist()
    sent = df.sparkSession.sparkContext.broadcast(vectors)
    at = df.columns.index(tokens)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sums = np.zeros((batch.num_rows, size))
            for first, ids, row, all_ in numbers(batch.column(at)):
                ids, row = ids[ids >= 0], row[ids >= 0]
                own = sums[first : first + len(all_)]
                if len(all_) * len(words) <= DENSE:
                    own += np.bincount(row * len(words) + ids, minlength=len(all_) * len(words)).reshape(len(all_), -1) @ sent.value
                else:
                    code, n = np.unique(row * len(words) + ids, return_counts=True)
                    for c in range(0, len(code), AT_ONCE):
                        part = code[c : c + AT_ONCE]
                        _summed(part // len(words), sent.value[part % len(words)] * n[c : c + AT_ONCE, None], own)
                own /= np.maximum(all_, 1)[:, None]
            flat = pa.ListArray.from_arrays(pa.array(np.arange(batch.num_rows + 1, dtype=np.int32) * size), pa.array(sums.ravel()))
            yield pa.RecordBatch.from_arrays([*batch.columns, flat], names=[*batch.schema.names, "vector"])

    schema = StructType([*df.schema.fields]).add("vector", ArrayType(DoubleType()))
    return df.mapInArrow(run, schema).withColumn("vector", array_to_vector("vector"))
