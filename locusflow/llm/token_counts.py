"""Token counts of whole texts, huge ones by overlap resynchronisation.

A text of up to ``chunk_chars`` code points is encoded at once.  A longer one is
cut into chunks that overlap; every chunk is encoded by its own task with token
offsets.  Two neighbours are spliced at the first stable boundary in their overlap:
a space behind another character, where both encodings must have a token boundary
(no piece of the vocabulary reaches over it).  Where an overlap holds no such place
it is widened, twofold each time, in the end to the whole rest of the text.  Should
a token reach over a cut all the same, that text alone is encoded again with wider
overlaps.

The boundary is proven for vocabularies that ``Codec.splits_at_spaces`` accepts.
With any other model, and with tokenizers in ``.json`` files, every text is encoded
at once.

Defined results: a null or empty text has no bytes and no tokens; repeated rows
are counted one by one; an empty table gives an empty table.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, column_name, text_sub_batches
from .piece_codec import SPACE_MARK, Codec, codec

CHUNK_CHARS = 32_768
OVERLAP_CHARS = 512
_STABLE = re.compile(f"(?<=[^ {SPACE_MARK}]) ")


def stable_boundary(text: str, at: int) -> int | None:
    """First place behind ``at`` where a space follows another character."""
    found = _STABLE.search(text, at)
    # the character before must be part of what is seen: a chunk's first place never counts
    while found and found.start() <= at:
        found = _STABLE.search(text, found.start() + 1)
    return found.start() if found else None


def _tokens_between(c: Codec, text: str, a: int, b: int | None) -> int | None:
    """Tokens of ``text`` from place ``a`` to ``b`` (None: its end); None if a token reaches over one of them."""
    ids, _, _ = c.encode_column(pa.array([text]))
    ends = np.cumsum(c.width[ids]) - 1  # bytes of the text up to each token's end; the prefix adds one
    place = lambda p: len(text[:p].replace(SPACE_MARK, " ").encode())
    first, last = 0, len(ids)
    if a:
        first = int(np.searchsorted(ends, place(a)))
        if ends[first] != place(a):
            return None
        first += 1
    if b is not None:
        last = int(np.searchsorted(ends, place(b)))
        if last >= len(ends) or ends[last] != place(b):
            return None
        last += 1
    return last - first


def cut_chunks(text: str, core: int, overlap: int) -> list[tuple[int, int, int, int | None]]:
    """(start, end, left cut, right cut) of overlapping chunks, cuts relative to the start; the last right cut is None."""
    cuts = [0]
    for at in range(core, len(text), core):
        if at < cuts[-1]:
            continue  # a widened overlap reached over this chunk
        wide = overlap
        while (cut := stable_boundary(text[at : at + wide], 0)) is None and at + wide < len(text):
            wide *= 2
        if cut is None:
            break
        cuts.append(at + cut)
    ends = [*cuts[1:], None]
    starts = [max(0, c - 1) for c in cuts]  # the character before a cut is part of what is seen
    return [(s, len(text) if e is None else e + overlap, c - s, None if e is None else e - s) for s, c, e in zip(starts, cuts, ends, strict=True)]


def count_by_widening(c: Codec, text: str, core: int, overlap: int) -> int:
    """Tokens of a text whose chunks did not align: overlaps double until each pair does."""
    total, at, left = 0, 0, 0
    while True:
        wide, more = overlap, None
        while at + core < len(text):
            piece = text[at : at + core + wide]
            right = stable_boundary(piece, core)
            if right is not None and (more := _tokens_between(c, piece, left, right)) is not None:
                break
            if at + core + wide >= len(text):
                right = None
                break
            wide *= 2
        else:
            right = None
        if right is None:
            rest = _tokens_between(c, text[at:], left, None)
            # a token over the last cut: nothing before it counts, the text is encoded at once
            return total + rest if rest is not None else len(c.encode_column(pa.array([text]))[0])
        total += more
        at, left = at + right - 1, 1  # the next chunk starts one character before the cut


def count_tokens(docs: DataFrame, model: str, chunk_chars: int = CHUNK_CHARS, overlap_chars: int = OVERLAP_CHARS, limit: int = 4096, scratch: Scratch | None = None) -> DataFrame:
    """``docs`` without its text, with n_bytes, n_tokens and over_limit for every row."""
    names = {n: column_name(docs, n) for n in ("n_bytes", "n_tokens", "over_limit")}
    keep = [c for c in docs.columns if c != "text"]
    uid, size, kept = (column_name(docs, n) for n in ("uid", "size", "kept_columns"))
    rows = docs.select(F.struct(*keep, F.lit(0).alias("_")).alias(kept), F.coalesce("text", F.lit("")).alias("text")).withColumn(uid, F.monotonically_increasing_id())
    rows = rows.withColumn(size, F.length("text")).withColumn(names["n_bytes"], F.octet_length("text").cast("long"))
    counter = _whole_counter(model)
    proven = not model.endswith(".json") and codec(model).splits_at_spaces
    # huge texts are a written table: their uids must stay the same however often they are read
    usual = rows.filter(F.col(size) <= chunk_chars) if proven else rows

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter()
        for batch in batches:
            for part in text_sub_batches(batch):
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array(count(part.column(1)), pa.int64())], names=["kept", "n_bytes", "n_tokens"])

    done = f"kept {rows.schema[kept].dataType.simpleString()}, n_bytes long, n_tokens long"
    out = usual.select(kept, "text", names["n_bytes"]).mapInArrow(whole, done)
    if proven:
        huge = (scratch or Scratch(docs.sparkSession)).save(rows.filter(F.col(size) > chunk_chars))
        out = out.unionByName(_huge(huge.select(F.col(kept).alias("kept"), F.col(uid).alias("uid"), "text", F.col(names["n_bytes"]).alias("n_bytes")), model, chunk_chars, overlap_chars, done))
    return out.select(*(F.col("kept")[c].alias(c) for c in keep), F.col("n_bytes").alias(names["n_bytes"]), F.col("n_tokens").alias(names["n_tokens"]), (F.col("n_tokens") > limit).alias(names["over_limit"]))


def _whole_counter(model: str):
    """Makes, in a task, a function from a column of texts to their token counts."""
    if not model.endswith(".json"):
        return lambda: lambda column: np.diff(codec(model).encode_column(column)[1]).astype(np.int64)

    def load():
        from tokenizers import Tokenizer

        t = Tokenizer.from_file(model)
        t.encode_special_tokens = True  # their strings in a text are ordinary text
        t.no_truncation()
        t.no_padding()
        return lambda column: np.array([len(e.ids) for e in t.encode_batch([x or "" for x in column.to_pylist()], add_special_tokens=False)], np.int64)

    return load


def _huge(huge: DataFrame, model: str, chunk_chars: int, overlap_chars: int, done: str) -> DataFrame:
    """(kept, n_bytes, n_tokens) of the written ``huge(kept, uid, text, n_bytes)``."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uid, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for a, b, left, right in cut_chunks(text, chunk_chars, overlap_chars):
                    yield pa.RecordBatch.from_arrays([pa.array([uid], pa.int64()), pa.array([a], pa.int64()), pa.array([left], pa.int64()), pa.array([right], pa.int64()), pa.array([text[a:b]])], names=["uid", "start", "left_cut", "right_cut", "text"])

    def encode_chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(model)
        for batch in batches:
            tokens = [_tokens_between(c, r["text"], r["left_cut"], r["right_cut"]) for r in batch.to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(tokens, pa.int64())], names=["uid", "tokens"])

    def widen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(model)
        for batch in batches:
            tokens = [count_by_widening(c, t, chunk_chars, 2 * overlap_chars) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(tokens, pa.int64())], names=["kept", "n_bytes", "n_tokens"])

    chunks = huge.select("uid", "text").mapInArrow(cut, "uid long, start long, left_cut long, right_cut long, text string").repartition("uid", "start")
    encoded = chunks.mapInArrow(encode_chunks, "uid long, tokens long")
    spliced = encoded.groupBy("uid").agg(F.sum("tokens").alias("n_tokens"), (F.count("tokens") == F.count(F.lit(1))).alias("aligned"))
    joined = huge.join(spliced, "uid")
    again = joined.filter("not aligned").select("kept", "text", "n_bytes").mapInArrow(widen, done)
    return joined.filter("aligned").select("kept", "n_bytes", "n_tokens").unionByName(again)
