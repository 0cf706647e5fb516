"""A hidden Markov language model over words, with exact likelihoods of whole texts.

Latent states emit words.  Every word that training texts hold at least twice has
emissions of its own; words seen once, and unseen ones, share one class, inside
which a word has its smoothed share.  All of this, and the smoothing, comes from
training counts alone.  With one state the model is the smoothed unigram base.

The vocabulary is never held in one place.  Texts are kept in blocks, each with
the sorted hashes of its own words; hash ranges of the vocabulary are shards.  In
a Baum-Welch round every block sends its expected counts to the shards, which add
them up and send each block the new counts of the words it holds: two shuffles,
each in proportion to the distinct words of the blocks.  Blocks are written once,
bucketed by block, so that texts are not shuffled again.

Recursions run over whole texts.  A text of over ``PIECE`` tokens is worked on in
pieces side by side: a piece is a K x K operator, operators applied in order give
the exact state distribution at each border, forwards and backwards, and with
these messages the pieces' counts and likelihoods are those of the whole text.

Defined results: null and empty texts hold the end token only; repeated rows are
scored one by one; a null doc_id counts as empty text for the fold; with no
training text at all every word is unseen; other columns than doc_id and text are left
out; a very long text is a block of its own.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, crc_remainder, text_sub_batches
from .textarrays import mix, words_of

STATES, ROUNDS = 4, 4
#: Tokens of a piece, a unit of work only; tokens worked on at once.
PIECE, AT_ONCE = 512, 300_000
#: Text of one block, and listed words of one shard (of all blocks together).
BLOCK_BYTES, SHARD_WORDS = 16_000_000, 2_000_000
BUCKET_BYTES, MOST_BUCKETS = 64_000_000, 50_000
#: Training counts from which a word has emissions of its own.
OWN_FROM = 2
END = mix(np.array([0x656E64], np.uint64))[0]


def _token_hashes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of words and, behind each text, of the end token; first token of each text."""
    w = words_of(column, lower=True)
    first = w.first + np.arange(len(w) + 1)
    out = np.full(first[-1], END, np.uint64)
    is_word = np.ones(len(out), bool)
    is_word[first[1:] - 1] = False
    out[is_word] = w.hash
    return out, first


# -- the model and its recursions ----------------------------------------------------------------------------------


@dataclass
class Model:
    start: np.ndarray  # K
    step: np.ndarray  # K x K
    emit: np.ndarray  # words x K


@dataclass
class Pieces:
    """Pieces of texts: where each begins in the flat tokens, its length, text, and number within the text."""

    begin: np.ndarray
    length: np.ndarray
    owner: np.ndarray
    number: np.ndarray

    @staticmethod
    def of(first: np.ndarray, piece: int) -> Pieces:
        size = np.diff(first)
        many = -(-size // piece)
        owner = np.repeat(np.arange(len(size)), many)
        number = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
        return Pieces(first[owner] + number * piece, np.minimum(piece, size[owner] - number * piece), owner, number)


def _longest_first(length: np.ndarray, most: int) -> Iterator[np.ndarray]:
    """Groups of pieces in order of falling length, each of at most ``most`` tokens with all pieces as long as its first."""
    order = np.argsort(-length, kind="stable")
    at = 0
    while at < len(order):
        to = at + max(1, most // int(length[order[at]]))
        yield order[at:to]
        at = to


def _active(length: np.ndarray) -> list[int]:
    """How many of the pieces (longest first) reach each place."""
    return np.searchsorted(-length, -np.arange(length[0]), "left").tolist()


def _operators(m: Model, flat: np.ndarray, p: Pieces, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Operators of pieces, as rows of sum one and the logs of their sums; the first piece of a text applies no transition before its first token."""
    k = len(m.start)
    out, logs = np.zeros((len(which), k, k)), np.zeros((len(which), k))
    for rows in _longest_first(p.length[which], AT_ONCE // k):
        own = which[rows]
        begin, active = p.begin[own], _active(p.length[own])
        head = np.where((p.number[own] == 0)[:, None, None], np.eye(k), m.step)
        now, log = head * m.emit[flat[begin]][:, None, :], np.zeros((len(own), k))
        for t, a in enumerate(active):
            if t:
                now[:a] = (now[:a] @ m.step) * m.emit[flat[begin[:a] + t]][:, None, :]
            if t % 16 == 15 or t + 1 == len(active) or active[t + 1] < a:
                total = now[:a].sum(2)
                total[total == 0] = 1.0
                now[:a] /= total[:, :, None]
                log[:a] += np.log(total)
        out[rows], logs[rows] = now, log
    return out, logs


@dataclass
class Messages:
    """At the borders of pieces: the state distribution before each, the weight of what follows each, and the log-likelihood of texts of several pieces (0 for others)."""

    before: np.ndarray
    behind: np.ndarray
    likelihood: np.ndarray


def messages(m: Model, flat: np.ndarray, first: np.ndarray, p: Pieces) -> Messages:
    k = len(m.start)
    out = Messages(np.tile(m.start, (len(p.begin), 1)), np.ones((len(p.begin), k)), np.zeros(len(first) - 1))
    which = np.flatnonzero(np.diff(first)[p.owner] > p.length) if len(p.begin) else np.zeros(0, np.int64)
    if not len(which):
        return out
    operator, logs = _operators(m, flat, p, which)
    high = logs.max(1)
    operator = operator * np.exp(logs - high[:, None])[:, :, None]
    rank = np.argsort(p.number[which], kind="stable")
    steps = np.split(rank, np.flatnonzero(np.diff(p.number[which][rank])) + 1)
    state = np.tile(m.start, (len(first) - 1, 1))
    for rows in steps:
        own = which[rows]
        out.before[own] = state[p.owner[own]]
        now = np.einsum("pk,pkl->pl", state[p.owner[own]], operator[rows])
        total = now.sum(1)
        state[p.owner[own]] = now / total[:, None]
        out.likelihood[p.owner[own]] += np.log(total) + high[rows]
    weight = np.ones((len(first) - 1, k))
    for rows in reversed(steps):
        own = which[rows]
        out.behind[own] = weight[p.owner[own]]
        now = np.einsum("pkl,pl->pk", operator[rows], weight[p.owner[own]])
        weight[p.owner[own]] = now / now.sum(1, keepdims=True)
    return out


def expected_counts(m: Model, flat: np.ndarray, first: np.ndarray, piece: int = PIECE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Expected starts, steps and emissions of whole texts by the scaled forward-backward recursion."""
    k = len(m.start)
    start, step, emit = np.zeros(k), np.zeros((k, k)), np.zeros(m.emit.shape)
    p = Pieces.of(first, piece)
    if not len(p.begin):
        return start, step, emit
    at = messages(m, flat, first, p)
    for own in _longest_first(p.length, AT_ONCE):
        begin, active, heads = p.begin[own], _active(p.length[own]), p.number[own] == 0
        alpha, scale = np.empty((len(active), len(own), k)), np.empty((len(active), len(own), 1))
        now = np.where(heads[:, None], m.start, at.before[own] @ m.step) * m.emit[flat[begin]]
        for t, a in enumerate(active):
            if t:
                now = (alpha[t - 1, :a] @ m.step) * m.emit[flat[begin[:a] + t]]
            np.sum(now, axis=1, keepdims=True, out=scale[t, :a])
            np.divide(now, scale[t, :a], out=alpha[t, :a])
        beta, done = at.behind[own], 0
        for t in range(len(active) - 1, -1, -1):
            a = active[t]
            if a > done:  # pieces that end here
                beta[done:a] /= (alpha[t, done:a] * beta[done:a]).sum(1, keepdims=True)
                done = a
            weighted = beta[:a] * m.emit[flat[begin[:a] + t]] / scale[t, :a]
            before = alpha[t - 1, :a] if t else at.before[own]
            alpha[t, :a] *= beta[:a]  # from here on the posterior
            if t:
                step += before.T @ weighted
                beta[:a] = weighted @ m.step.T
            else:
                start += alpha[0, heads].sum(0)
                step += before[~heads].T @ weighted[~heads]
        reach = np.arange(len(own)) < np.array(active)[:, None]
        tokens = flat[(begin + np.arange(len(active))[:, None])[reach]]
        for j in range(k):
            emit[:, j] += np.bincount(tokens, alpha[:, :, j][reach], minlength=len(emit))
    return start, step * m.step, emit


def log_likelihoods(m: Model, flat: np.ndarray, first: np.ndarray, piece: int = PIECE) -> np.ndarray:
    """Exact natural-log likelihood of each whole text."""
    p = Pieces.of(first, piece)
    out = messages(m, flat, first, p).likelihood
    alone = np.flatnonzero(np.diff(first)[p.owner] == p.length)
    for rows in _longest_first(p.length[alone], AT_ONCE):
        own = alone[rows]
        begin, active = p.begin[own], _active(p.length[own])
        now, logs = m.start * m.emit[flat[begin]], np.zeros(len(own))
        for t, a in enumerate(active):
            if t:
                now = (now[:a] @ m.step) * m.emit[flat[begin[:a] + t]]
            if t % 16 == 15 or t + 1 == len(active) or active[t + 1] < a:
                total = now.sum(1)
                now = now / total[:, None]
                logs[:a] += np.log(total)
        out[p.owner[own]] = logs
    return out


@dataclass
class Corpus:
    """Training totals: tokens, distinct words and the words seen once."""

    tokens: int
    words: int
    once: int

    @property
    def denominator(self) -> float:
        return self.tokens + 0.5 * (self.words + 1)

    @property
    def rare_mass(self) -> float:
        return 1.5 * self.once + 0.5


@dataclass
class Shared:
    """What every task needs of a model: K, K x K and K numbers, whatever the vocabulary."""

    start: np.ndarray
    step: np.ndarray
    rare: np.ndarray
    total: np.ndarray
    corpus: Corpus

    def model(self, counts: np.ndarray) -> Model:
        """With the expected counts (words x K) of some words; the last row of the emissions is the class of rare words.

        Each state has a half count for every word, split over the states, so that one state alone is the base.
        """
        k = len(self.start)
        emit = np.concatenate([counts + 0.5 / k, [self.rare + 0.5 / k * (self.corpus.once + 1)]])
        return Model(self.start, self.step, emit / (self.total + 0.5 / k * (self.corpus.words + 1)))

    @staticmethod
    def initial(corpus: Corpus, k: int) -> Shared:
        step = np.full((k, k), 0.1 / max(k - 1, 1))
        np.fill_diagonal(step, 0.9 if k > 1 else 1.0)
        return Shared(np.full(k, 1 / k), step, np.full(k, corpus.once / k), np.full(k, corpus.tokens / k), corpus)

    def updated(self, start: np.ndarray, step: np.ndarray, rare: np.ndarray, total: np.ndarray) -> Shared:
        return Shared((start + 0.1) / (start + 0.1).sum(), (step + 0.1) / (step + 0.1).sum(1, keepdims=True), rare, total, self.corpus)


def first_counts(counts: np.ndarray, seeds: np.ndarray, k: int) -> np.ndarray:
    """Counts of words split over the states unevenly, by a hash of word and state, so that the states differ."""
    shares = np.stack([mix(seeds.astype(np.uint64) * np.uint64(k) + np.uint64(j)).astype(np.float64) for j in range(k)], 1) / 2.0**64 + 0.5
    return counts[:, None] * shares / shares.sum(1, keepdims=True)


# -- the jobs ------------------------------------------------------------------------------------------------------

_ROWS = "block long, doc_id long, train boolean, length long, tokens binary, words binary, seen binary"


def _text_blocks(docs: DataFrame) -> DataFrame:
    """Rows of two kinds: each of ``docs(text, train, doc_id)`` with its block and its tokens as places among the block's words, and for each block one with the sorted hashes of its words and their training counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, made = [], 0
        task = TaskContext.get().partitionId() << 32

        def block() -> Iterator[pa.RecordBatch]:
            words, place = np.unique(np.concatenate([h[0] for h in held]), return_inverse=True)
            place = place.astype(np.int32)
            seen, at = np.zeros(len(words)), 0
            for tokens, first, train, ids in held:
                own, n = place[at : at + len(tokens)], len(ids)
                at += len(tokens)
                seen += np.bincount(own, np.repeat(train, np.diff(first)), minlength=len(words))
                lists = pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer((first * 4).astype(np.int32)), pa.py_buffer(own)])
                none = pa.nulls(n, pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array([task + made] * n, pa.int64()), ids, pa.array(train), pa.array(np.diff(first)), lists, none, none], names=_NAMES)
            one = [pa.array([task + made], pa.int64()), *(pa.nulls(1, t) for t in (pa.int64(), pa.bool_(), pa.int64(), pa.binary())), pa.array([words.tobytes()], pa.binary()), pa.array([seen.astype(np.int32).tobytes()], pa.binary())]
            yield pa.RecordBatch.from_arrays(one, names=_NAMES)
            held.clear()

        size = 0
        for batch in batches:
            for part in text_sub_batches(batch):
                tokens, first = _token_hashes(part.column(0))
                held.append((tokens, first.astype(np.int64), part.column(1).to_numpy(zero_copy_only=False).astype(bool), part.column(2)))
                size += part.column(0).nbytes
                if size >= BLOCK_BYTES:
                    yield from block()
                    size, made = 0, made + 1
        if held:
            yield from block()

    return docs.select("text", "train", "doc_id").mapInArrow(run, _ROWS)


_NAMES = [x.split()[0] for x in _ROWS.split(", ")]


class _Buckets:
    """A table written in buckets of blocks, so that joins by block read it as it lies."""

    def __init__(self, df: DataFrame, size: int, scratch: Scratch):
        spark, name = df.sparkSession, f"hmm_blocks_{uuid.uuid4().hex}"
        # in proportion to the texts, so that a bucket's size does not follow the input
        buckets = min(max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // BUCKET_BYTES)), MOST_BUCKETS)
        df.write.format("parquet").option("compression", "zstd").option("path", f"{scratch.top}/{name}").bucketBy(buckets, "block").saveAsTable(name)
        self.table = spark.table(name)


def _shard_edges(shards: int) -> np.ndarray:
    """Shards are ranges of word hashes; edge i ends shard i."""
    return np.array([(i + 1) * 2**64 // shards - 1 for i in range(shards)], np.uint64)


def _word_counts(blocks: DataFrame, shards: int) -> DataFrame:
    """For each shard and block: the training counts and seeds of the block's words, the places of its own words in the shard, and (once for each shard) totals."""
    edges = _shard_edges(shards)

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, words, seen in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                # words are sorted: a step for each shard that the block has words of, however many there are
                shard = np.searchsorted(edges, np.frombuffer(words, np.uint64))
                cut = np.concatenate([[0], np.flatnonzero(np.diff(shard)) + 1, [len(shard)]]).tolist() if len(shard) else []
                parts = [(int(shard[a]), a, b) for a, b in zip(cut[:-1], cut[1:], strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([s for s, _, _ in parts], pa.int32()), pa.array([block] * len(parts), pa.int64()), pa.array([words[8 * a : 8 * b] for _, a, b in parts], pa.binary()), pa.array([seen[4 * a : 4 * b] for _, a, b in parts], pa.binary())],
                    names=["shard", "block", "words", "seen"],
                )

    def add(t: pa.Table) -> pa.Table:
        words = [np.frombuffer(x, np.uint64) for x in t.column("words").to_pylist()]
        seen = np.concatenate([np.frombuffer(x, np.int32) for x in t.column("seen").to_pylist()])
        every, place = np.unique(np.concatenate(words), return_inverse=True)
        total = np.bincount(place, seen, minlength=len(every)).astype(np.int64)
        own = total >= OWN_FROM
        at = np.where(own, np.cumsum(own) - 1, -1).astype(np.int32)[place]
        count = np.minimum(total, 2**31 - 1).astype(np.int32)[place]
        ends = np.cumsum([len(w) for w in words]).tolist()
        rows, zeros = [], [0] * (len(words) - 1)
        for w, b in zip(words, ends, strict=True):
            here, c = at[b - len(w) : b], count[b - len(w) : b]
            rows.append((c.tobytes(), (w[here >= 0] & np.uint64(0xFFFFFFFF)).astype(np.uint32).tobytes(), here[here >= 0].tobytes()))
        column = lambda j: pa.array([r[j] for r in rows], pa.binary())
        return pa.table({
            "shard": t.column("shard").combine_chunks(), "block": t.column("block").combine_chunks(), "counts": column(0), "seeds": column(1), "places": column(2), "n_own": pa.array([int(own.sum())] * len(words), pa.int64()),
            "n_tokens": pa.array([int(total.sum()), *zeros], pa.int64()), "n_words": pa.array([int((total > 0).sum()), *zeros], pa.int64()), "n_once": pa.array([int((total == 1).sum()), *zeros], pa.int64()),
        })

    parts = blocks.filter("words is not null").select("block", "words", "seen").mapInArrow(listed, "shard int, block long, words binary, seen binary")
    return parts.groupBy("shard").applyInArrow(add, "shard int, block long, counts binary, seeds binary, places binary, n_own long, n_tokens long, n_words long, n_once long")


def _arrays(t: pa.Table, column: str, kind) -> list[np.ndarray]:
    """A block's arrays, one for each shard, in order of the shards."""
    return [np.frombuffer(x, kind) for _, x in sorted(zip(t.column("shard").to_pylist(), t.column(column).to_pylist(), strict=True))]


def _joined(arrays: list[np.ndarray], kind=np.int64) -> np.ndarray:
    return np.concatenate(arrays) if arrays else np.zeros(0, kind)


def _texts(t: pa.Table, own: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(tokens as places among the block's words, the same among its own words, first token of each text); behind the own words comes the class of rare ones."""
    tokens = _joined([np.frombuffer(x, np.int32) for x in t.column("tokens").to_pylist()], np.int32)
    first = np.concatenate([[0], np.cumsum(t.column("length").to_numpy())]).astype(np.int64)
    return tokens, np.where(own, np.cumsum(own) - 1, own.sum()).astype(np.int32)[tokens], first


def _expected(texts: pa.Table, words: pa.Table, shared: Shared, begin: bool) -> pa.Table:
    """Expected counts of a block's training texts: a row for each shard, and one (shard -1) with starts, steps, rare words and totals."""
    k = len(shared.start)
    if begin:
        counts = _arrays(words, "counts", np.int32)
        own = [c >= OWN_FROM for c in counts]
        weights = first_counts(_joined([c[o] for c, o in zip(counts, own, strict=True)]).astype(np.float64), _joined(_arrays(words, "seeds", np.uint32), np.uint32), k)
    else:
        own = [o.astype(bool) for o in _arrays(words, "own", np.uint8)]
        weights = _joined(_arrays(words, "sums", np.float32), np.float32).astype(np.float64).reshape(-1, k)
    _, flat, first = _texts(texts, _joined(own, bool))
    start, step, emit = expected_counts(shared.model(weights), flat, first)
    sums = emit[:-1].astype(np.float32)
    sizes = [int(o.sum()) for o in own]
    rows = [(s, sums[e - n : e].tobytes(), None) for s, n, e in zip(sorted(words.column("shard").to_pylist()), sizes, np.cumsum(sizes).tolist(), strict=True)]
    rows.append((-1, b"", np.concatenate([start, step.ravel(), emit[-1], emit.sum(0)]).tolist()))
    return pa.table({
        "shard": pa.array([r[0] for r in rows], pa.int32()), "block": pa.array([texts.column("block")[0].as_py() if texts.num_rows else -1] * len(rows), pa.int64()),
        "sums": pa.array([r[1] for r in rows], pa.binary()), "totals": pa.array([r[2] for r in rows], pa.list_(pa.float64())),
    })


def _added(places: pa.Table, sums: pa.Table, k: int) -> pa.Table:
    """A shard's counts summed over all blocks, and for each block those of its words."""
    blocks = places.column("block").to_pylist()
    at = dict(zip(blocks, (np.frombuffer(x, np.int32) for x in places.column("places").to_pylist()), strict=True))
    total = np.zeros((places.column("n_own")[0].as_py() if blocks else 0, k))
    for block, x in zip(sums.column("block").to_pylist(), sums.column("sums").to_pylist(), strict=True):
        if block in at:
            total[at[block]] += np.frombuffer(x, np.float32).reshape(-1, k)
    total = total.astype(np.float32)
    own = [(np.frombuffer(x, np.int32) >= OWN_FROM).astype(np.uint8).tobytes() for x in places.column("counts").to_pylist()]
    return pa.table({"shard": places.column("shard").combine_chunks(), "block": places.column("block").combine_chunks(), "sums": pa.array([total[at[b]].tobytes() for b in blocks], pa.binary()), "own": pa.array(own, pa.binary())})


def _train(table: DataFrame, counts: DataFrame, corpus: Corpus, k: int, rounds: int, scratch: Scratch) -> tuple[Shared, DataFrame | None]:
    """Baum-Welch over all training texts: what tasks share of the model, and each block's counts of its own words (none before the first round)."""
    shared, values = Shared.initial(corpus, k), None
    texts = table.filter("train").select("block", "length", "tokens")
    places = counts.select("shard", "block", "counts", "places", "n_own")

    def expect(shared: Shared, values: DataFrame | None) -> DataFrame:
        begin = values is None

        def run(left: pa.Table, right: pa.Table) -> pa.Table:
            return _expected(left, right, shared, begin)

        words = counts.select("shard", "block", "counts", "seeds") if values is None else values
        return texts.groupBy("block").cogroup(words.groupBy("block")).applyInArrow(run, "shard int, block long, sums binary, totals array<double>")

    for _ in range(rounds):
        sums = scratch.save(expect(shared, values))
        totals = sums.filter("shard = -1").agg(*(F.sum(F.col("totals")[j]) for j in range(k * k + 3 * k))).first()  # one row, K * K + 3 K numbers
        t = np.array([x or 0.0 for x in totals])
        shared = shared.updated(t[:k], t[k : k + k * k].reshape(k, k), t[-2 * k : -k], t[-k:])
        old = values
        added = places.groupBy("shard").cogroup(sums.filter("shard >= 0").select("shard", "block", "sums").groupBy("shard")).applyInArrow(lambda a, b: _added(a, b, k), "shard int, block long, sums binary, own binary")
        values = scratch.save(added)
        scratch.drop(sums, *([old] if old is not None else []))
    return shared, values


def score_documents(docs: DataFrame, k: int = STATES, rounds: int = ROUNDS, fold: int = 1, folds: int = 5, scratch: Scratch | None = None) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) for every row of ``docs(doc_id, text)``."""
    scratch = scratch or Scratch(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).withColumn("train", crc_remainder("doc_id", folds) != fold)
    size = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    table = _Buckets(_text_blocks(docs), size, scratch).table
    listed = table.filter("words is not null").agg(F.coalesce(F.sum(F.length("seen")), F.lit(0)) / 4).first()[0]
    counts = scratch.save(_word_counts(table, max(1, int(-(-listed // SHARD_WORDS)))))
    corpus = Corpus(*counts.agg(*(F.coalesce(F.sum(c), F.lit(0)) for c in ("n_tokens", "n_words", "n_once"))).first())
    shared, values = _train(table, counts, corpus, k, rounds, scratch)
    begin = values is None
    # a block's words come with their counts and what the rounds made of them
    words = counts.select("shard", "block", "counts", "seeds")
    words = words.withColumn("sums", F.lit(None).cast("binary")) if begin else words.join(values.select("shard", "block", "sums"), ["shard", "block"])

    def finish(left: pa.Table, right: pa.Table) -> pa.Table:
        c = _joined(_arrays(right, "counts", np.int32), np.int32).astype(np.int64)
        own = c >= OWN_FROM
        if begin:
            weights = first_counts(c[own].astype(np.float64), _joined(_arrays(right, "seeds", np.uint32), np.uint32), k)
        else:
            weights = _joined(_arrays(right, "sums", np.float32), np.float32).astype(np.float64).reshape(-1, k)
        tokens, flat, first = _texts(left, own)
        sums = lambda of_word: np.diff(np.concatenate([[0], np.cumsum(of_word[tokens])])[first])
        log = np.log10(c + 0.5)
        share = sums(np.where(own, 0.0, log - np.log10(corpus.rare_mass)))
        score = log_likelihoods(shared.model(weights), flat, first) / np.log(10) + share
        return pa.table({
            "doc_id": left.column("doc_id").combine_chunks(), "held_out": pa.array([not x for x in left.column("train").to_pylist()]), "n_tokens": left.column("length").combine_chunks(), "n_known": pa.array(sums((c > 0).astype(np.int64))),
            "train_tokens": pa.array([corpus.tokens] * len(score), pa.int64()), "base_score": pa.array(sums(log - np.log10(corpus.denominator))), "score": pa.array(score),
        })

    shape = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    texts = table.filter("tokens is not null").select("block", "doc_id", "train", "length", "tokens")
    return texts.groupBy("block").cogroup(words.groupBy("block")).applyInArrow(finish, shape)
