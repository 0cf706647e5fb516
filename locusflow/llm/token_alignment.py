"""Alignment of two tokenizers' tokens by interval coalescing, and how often their ids meet in a corpus.

A is a byte-level BPE (``byte_bpe``) of a space and the text, B a SentencePiece model of
the text, which adds that space itself.  All tokens of a batch lie on one line of bytes.
Sorted by start, with the running maximum of ends, a group ends where a start reaches that
maximum: there a token of A and one of B both end.  Within a group every A token is linked
with every B token.  Links of a large group are counted by its distinct ids, so that a
long stretch without a common end (a run of spaces) costs no square of its tokens.

Corpus-wide counts need no link to travel: a batch sends each id pair that it holds
once, with its number of documents, and gets the pair's corpus-wide count and rank back.

Defined results: null and empty texts, and texts that one of the tokenizers does not
reproduce (a literal space mark, for example), have no tokens: all numbers are 0 and the
groups an empty string, unhashed.  Repeated rows count as documents of their own; an empty table
gives an empty table; other columns pass through, new ones get an underscore where a name is taken.
A very long text is one batch of its own; what is held for it follows its length.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import byte_bpe
from .byte_bpe import ragged
from .common import Scratch, column_name, text_sub_batches
from .piece_codec import codec

#: Groups with more links than this are counted by distinct ids.
DENSE = 4096
#: Tokens whose ids are written as text at once.
TOKENS_AT_ONCE = 400_000
#: Text of one batch: tokens of both sides, their bytes and their links are held for it at once.
BATCH_BYTES = 1_500_000
NUMBERS = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")


def coalesce(start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Group number of every interval: a group breaks where a start reaches the largest end so far."""
    if not len(start):
        return np.zeros(0, np.int64)
    order = np.lexsort((end, start))
    reach = np.maximum.accumulate(end[order])
    group = np.zeros(len(start), np.int64)
    group[order[1:]] = np.cumsum(start[order[1:]] >= reach[:-1])
    return group


@dataclass
class Aligned:
    """Tokens of a batch's texts: ids, text and group of each; groups are numbered through, in order."""

    a: np.ndarray
    b: np.ndarray
    doc_a: np.ndarray
    doc_b: np.ndarray
    group_a: np.ndarray
    group_b: np.ndarray
    end_a: np.ndarray
    n: int

    def __post_init__(self):
        self.groups = int(self.group_a[-1]) + 1 if len(self.a) else 0
        self.size_a, self.size_b = np.bincount(self.group_a, minlength=self.groups), np.bincount(self.group_b, minlength=self.groups)
        self.first_a, self.first_b = np.cumsum(self.size_a) - self.size_a, np.cumsum(self.size_b) - self.size_b
        self.doc = self.doc_a[self.first_a]

    def per_doc(self, of: np.ndarray, weight: np.ndarray | None = None) -> np.ndarray:
        return np.bincount(of, weight, minlength=self.n).astype(np.int64)

    def digests(self) -> list[str]:
        """sha256 of ``a1,a2|b1;a3|b2,b3`` for each text; an empty string for one without tokens."""
        last_a, last_b = np.ones(len(self.a), bool), np.ones(len(self.b), bool)
        last_a[:-1], last_b[:-1] = self.group_a[1:] != self.group_a[:-1], self.group_b[1:] != self.group_b[:-1]
        ids = np.empty(len(self.a) + len(self.b), np.int32)
        mark = np.empty(len(ids), np.uint8)
        place_a = np.arange(len(self.a)) + self.first_b[self.group_a]
        place_b = np.arange(len(self.b)) + (self.first_a + self.size_a)[self.group_b]
        ids[place_a], ids[place_b] = self.a, self.b
        mark[place_a], mark[place_b] = np.where(last_a, ord("|"), ord(",")), np.where(last_b, ord(";"), ord(","))
        del place_a, place_b, last_a, last_b
        ends = np.concatenate([[0], np.cumsum(self.per_doc(self.doc_a) + self.per_doc(self.doc_b))])
        words, digits = _decimals(int(ids.max(initial=0)))
        out: list[str] = []
        while len(out) < self.n:  # some texts at a time: a token takes eight bytes while it is written
            d = len(out)
            to = max(d + 1, int(np.searchsorted(ends, ends[d] + TOKENS_AT_ONCE, "right")) - 1)
            own = slice(int(ends[d]), int(ends[to]))
            length = digits[ids[own]]
            cells = words[ids[own]] | mark[own].astype(np.uint64) << (8 * length).astype(np.uint64)
            width = length + 1
            last = ends[d + 1 : to + 1][np.diff(ends[d : to + 1]) > 0] - 1 - ends[d]
            width[last] -= 1  # nothing behind the last one of a text
            flat = cells.view(np.uint8).reshape(-1, 8)[np.arange(8) < width[:, None]]
            cut = np.concatenate([[0], np.cumsum(width)])[ends[d : to + 1] - ends[d]].tolist()
            out += [hashlib.sha256(flat[x:y]).hexdigest() if y > x else "" for x, y in zip(cut[:-1], cut[1:], strict=True)]
        return out

    def pairs(self, bits_a: int, bits_b: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, pair, times) of every distinct linked id pair of each text; a pair is ``a << bits_b | b``."""
        links = self.size_a * self.size_b
        dense = links > DENSE
        small = np.flatnonzero(~dense[self.group_a])
        g = self.group_a[small]
        key = self._key(np.repeat(small, self.size_b[g]), ragged(self.first_b[g], self.size_b[g]), bits_a, bits_b)
        key, times = np.unique(key, return_counts=True)
        more = [(key, times)]
        for g in np.flatnonzero(dense).tolist():
            ids_a, n_a = np.unique(self.a[self.first_a[g] : self.first_a[g] + self.size_a[g]], return_counts=True)
            ids_b, n_b = np.unique(self.b[self.first_b[g] : self.first_b[g] + self.size_b[g]], return_counts=True)
            pair = (int(self.doc[g]) << (bits_a + bits_b)) + (ids_a.astype(np.int64)[:, None] << bits_b) + ids_b
            more.append((pair.ravel(), (n_a[:, None] * n_b).ravel()))
        if len(more) > 1:
            key, inverse = np.unique(np.concatenate([k for k, _ in more]), return_inverse=True)
            times = np.zeros(len(key), np.int64)
            np.add.at(times, inverse, np.concatenate([t for _, t in more]))
        return key >> (bits_a + bits_b), key & ((1 << (bits_a + bits_b)) - 1), times

    def _key(self, i: np.ndarray, j: np.ndarray, bits_a: int, bits_b: int) -> np.ndarray:
        return (self.doc_a[i] << (bits_a + bits_b)) | (self.a[i].astype(np.int64) << bits_b) | self.b[j]


def _decimals(most: int) -> tuple[np.ndarray, np.ndarray]:
    """Every number up to ``most`` as decimal digits in a little-endian word, and how many they are."""
    if most >= 10**7:
        raise ValueError("ids have seven digits at most")
    n = np.arange(most + 1)
    digits = 1 + sum((n >= 10**k).astype(np.int64) for k in range(1, 7))
    words = np.zeros(len(n), np.uint64)
    for k in range(7):  # the k-th digit from the left
        digit = n // 10 ** np.maximum(digits - 1 - k, 0) % 10
        words |= np.where(k < digits, digit + 48, 0).astype(np.uint64) << np.uint64(8 * k)
    return words, digits


class Aligner:
    def __init__(self, a: str, b: str):
        self.a, self.b = byte_bpe.load(a), codec(b)
        self.bits_a, self.bits_b = len(self.a.width).bit_length(), len(self.b.width).bit_length()

    def align(self, texts: pa.Array) -> Aligned:
        texts = texts.fill_null("").cast(pa.large_string())
        word = lambda x: pa.scalar(x, pa.large_string())
        led = pc.if_else(pc.equal(texts, word("")), word(""), pc.binary_join_element_wise(word(" "), texts, word("")))
        a, first_a, data = self.a.encode_column(led)
        b, first_b, _ = self.b.encode_column(texts)
        n = len(texts)
        doc_a, doc_b = np.repeat(np.arange(n), np.diff(first_a)), np.repeat(np.arange(n), np.diff(first_b))
        size = np.diff(np.frombuffer(led.cast(pa.large_string()).buffers()[1], np.int64)[led.offset : led.offset + n + 1]) if n else np.zeros(0, np.int64)
        good = size > 0
        for ids, doc, codes in ((a, doc_a, self.a), (b, doc_b, self.b)):
            good &= np.bincount(doc, codes.width[ids], minlength=n).astype(np.int64) == size
            # where lengths agree, bytes are compared; the others' are left out on both sides
            same = codes.decode_bytes(ids[good[doc]]) == data[np.repeat(good, size)]
            good[np.unique(np.repeat(np.flatnonzero(good), size[good])[~same])] = False
        a, doc_a, b, doc_b = a[good[doc_a]], doc_a[good[doc_a]], b[good[doc_b]], doc_b[good[doc_b]]
        end_a, end_b = np.cumsum(self.a.width[a]), np.cumsum(self.b.width[b])
        group = coalesce(np.concatenate([end_a - self.a.width[a], end_b - self.b.width[b]]), np.concatenate([end_a, end_b]))
        return Aligned(a, b, doc_a, doc_b, group[: len(a)], group[len(a) :], end_a, n)


def token_groups(docs: DataFrame, a: str, b: str, text: str = "text") -> DataFrame:
    """A row for every group of every text: the other columns, its bytes [start, end) of the text (a group with the added space starts at 0), and the ids of both sides in order."""
    keep = [c for c in docs.columns if c != text]
    made = {"group": "int", "start": "long", "end": "long", "a_ids": "array<int>", "b_ids": "array<int>"}
    names = {k: column_name(docs, k) for k in made}
    schema = docs.select(*keep).limit(0).selectExpr("*", *(f"cast(null as {t}) as `{names[k]}`" for k, t in made.items())).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = Aligner(a, b)
        for batch in batches:
            for part in text_sub_batches(batch, text, BATCH_BYTES):
                x = aligner.align(part.column(part.schema.get_field_index(text)))
                end = x.end_a[x.first_a + x.size_a - 1] if x.groups else np.zeros(0, np.int64)
                head = np.flatnonzero(np.diff(x.doc, prepend=-1))  # first group of each text
                base = np.repeat(np.concatenate([[0], end])[head], np.diff(np.append(head, x.groups)))
                start = np.maximum(np.concatenate([[0], end])[: x.groups] - base - 1, 0)
                lists = [pa.ListArray.from_arrays(pa.array(np.append(f, len(ids)), pa.int32()), pa.array(ids.astype(np.int32))) for f, ids in ((x.first_a, x.a), (x.first_b, x.b))]
                number = np.arange(x.groups) - np.repeat(head, np.diff(np.append(head, x.groups)))
                rows = part.select(keep).take(pa.array(x.doc))
                yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(number, pa.int32()), pa.array(start), pa.array(end - base - 1), *lists], names=[*keep, *names.values()])

    return docs.mapInArrow(run, schema)


def _encoded(docs: DataFrame, a: str, b: str, text: str) -> DataFrame:
    """A row for each text (kept columns, numbers, digest, its pairs as places in its batch's list, and times), and a row for each entry of that list (pair, documents of the batch that hold it)."""
    keep = [c for c in docs.columns if c != text]
    plain = docs.select(F.struct(*keep, F.lit(0).alias("_")).alias("kept"), F.col(text).alias("text"))
    kept = plain.schema["kept"].dataType
    schema = f"block long, kept {kept.simpleString()}, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, at array<int>, times array<long>, pair long, place int, documents long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner, block = Aligner(a, b), TaskContext.get().partitionId() << 32
        for batch in batches:
            for part in text_sub_batches(batch, size=BATCH_BYTES):
                x = aligner.align(part.column(1))
                doc, pair, times = x.pairs(aligner.bits_a, aligner.bits_b)
                listed, place = np.unique(pair, return_inverse=True)
                offsets = pa.array(np.concatenate([[0], np.cumsum(x.per_doc(doc))]), pa.int32())
                numbers = [x.per_doc(x.doc_a), x.per_doc(x.doc_b), x.per_doc(x.doc), x.per_doc(x.doc, x.size_a * x.size_b)]
                lists = [pa.ListArray.from_arrays(offsets, pa.array(place.astype(np.int32))), pa.ListArray.from_arrays(offsets, pa.array(times.astype(np.int64)))]
                own = [pa.array(np.full(x.n, block)), part.column(0), *map(pa.array, numbers), pa.array(x.digests(), pa.string()), *lists]
                yield pa.RecordBatch.from_arrays([*own, pa.nulls(x.n, pa.int64()), pa.nulls(x.n, pa.int32()), pa.nulls(x.n, pa.int64())], names=names)
                m = len(listed)
                empty = [pa.nulls(m, c.type) for c in own[1:]]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(m, block)), *empty, pa.array(listed), pa.array(np.arange(m, dtype=np.int32)), pa.array(np.bincount(place, minlength=m).astype(np.int64))], names=names)
                block += 1

    names = [x.split(" ")[0] for x in ("block", "kept", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "at", "times", "pair", "place", "documents")]
    return plain.mapInArrow(run, schema)


def _counted(entries: DataFrame, bits_b: int) -> DataFrame:
    """(pair, documents, is_best) of all pairs of a corpus."""
    counts = entries.groupBy("pair").agg(F.sum("documents").alias("documents")).withColumn("a_id", F.shiftright("pair", bits_b))
    best = counts.groupBy("a_id").agg(F.max("documents").alias("most"))
    return counts.join(best, "a_id").select("pair", "documents", (F.col("documents") == F.col("most")).alias("is_best"))


def linked_pairs(docs: DataFrame, a: str, b: str, text: str = "text", scratch: Scratch | None = None) -> DataFrame:
    """(a_id, b_id, documents, is_best) of every id pair that some text holds linked: a map from one vocabulary to the other."""
    bits = len(codec(b).width).bit_length()
    saved = (scratch or Scratch(docs.sparkSession)).save(_encoded(docs.select(text), a, b, text).filter("pair is not null").select("pair", "documents"))
    return _counted(saved, bits).select(F.shiftright("pair", bits).cast("int").alias("a_id"), F.col("pair").bitwiseAND((1 << bits) - 1).cast("int").alias("b_id"), "documents", "is_best")


def align_documents(docs: DataFrame, a: str, b: str, text: str = "text", scratch: Scratch | None = None) -> DataFrame:
    """Every row's other columns with n_a, n_b, n_groups, n_links, n_best (links whose pair has its A id's highest count), count_sum (of all links' counts) and groups_sha256."""
    keep = [c for c in docs.columns if c != text]
    names = {n: column_name(docs, n) for n in (*NUMBERS, "groups_sha256")}
    # batches are numbered where they are made, so they are written before anything is sent by that number
    saved = (scratch or Scratch(docs.sparkSession)).save(_encoded(docs, a, b, text))
    entries = saved.filter("pair is not null").select("block", "pair", "place", "documents")
    counted = _counted(entries, len(codec(b).width).bit_length())
    answers = entries.select("block", "pair", "place").join(counted, "pair").select("block", "place", "documents", "is_best")
    rows = saved.filter("pair is null").drop("pair", "place", "documents").withColumnRenamed("block", "batch")
    kind = saved.schema["kept"].dataType.simpleString()

    def settle(left: pa.Table, right: pa.Table) -> pa.Table:
        left, right = left.combine_chunks(), right.combine_chunks()
        place = right["place"].to_numpy()
        count, best = np.zeros(len(place), np.int64), np.zeros(len(place), np.int64)
        count[place], best[place] = right["documents"].to_numpy(), right["is_best"].to_numpy(zero_copy_only=False)
        lists = left["at"].combine_chunks() if isinstance(left["at"], pa.ChunkedArray) else left["at"]
        doc = np.repeat(np.arange(len(left)), pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64))
        at, times = lists.flatten().to_numpy(), left["times"].combine_chunks().flatten().to_numpy()
        sums = [np.zeros(len(left), np.int64) for _ in range(2)]
        for total, what in zip(sums, (best, count), strict=True):
            np.add.at(total, doc, times * what[at])
        return pa.table({n: left[n] for n in ("kept", "n_a", "n_b", "n_groups", "n_links")} | {"n_best": sums[0], "count_sum": sums[1], "groups_sha256": left["groups_sha256"]})

    out = rows.groupBy("batch").cogroup(answers.groupBy("block")).applyInArrow(settle, f"kept {kind}, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string")
    return out.select(*(F.col("kept")[c].alias(c) for c in keep), *(F.col(n).alias(names[n]) for n in (*NUMBERS, "groups_sha256")))
