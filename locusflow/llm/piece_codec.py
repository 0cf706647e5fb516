"""SentencePiece encoding with byte offsets into the original text, and decoding.

Normalisation follows the compiled character map of the model: at each place the
longest prefix that the map knows is replaced, and every normalised byte keeps
the original byte it came from, so that each piece projects to a byte span of
the source.  A space becomes the model's space mark.  With a model that has a map the
library only sees what the map made of a text; a model whose map is empty changes
nothing but space marks.

No piece of a vocabulary checked by ``splits_at_spaces`` holds a space mark
behind another character.  A merge can then never cross the place where a space
follows another character, so the text falls into segments that are encoded on
their own; equal segments are encoded once per batch.

Defined results: a null text counts as empty; an empty text has no pieces (only
begin and end ids where asked for); repeated rows are encoded alike; an empty table
gives an empty table; other columns pass through, new ones get an underscore where a name
is taken; a very long text is encoded whole, with memory in proportion to its length.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from sentencepiece import sentencepiece_model_pb2 as model_pb2

from .common import column_name, text_sub_batches
from .textarrays import span_hashes, string_buffers

SPACE_MARK = "▁"
#: Segments that are given to the library as one string.
RUN_SEGMENTS = 256


def space_marks(data: np.ndarray) -> np.ndarray:
    """Where a text itself holds a space mark."""
    return np.flatnonzero((data[:-2] == 0xE2) & (data[1:-1] == 0x96) & (data[2:] == 0x81))


class CharacterMap:
    """The compiled character map: a double-array trie over UTF-8 bytes, and the replacements it points to."""

    def __init__(self, blob: bytes = b""):
        self.units, self.texts = np.zeros(0, np.uint32), b""
        if blob:
            size = int.from_bytes(blob[:4], "little")
            self.units, self.texts = np.frombuffer(blob[4 : 4 + size], "<u4"), blob[4 + size :]

    def longest(self, data: bytes, at: int) -> tuple[int, bytes] | None:
        """Length of the longest known prefix of ``data[at:]`` and what replaces it."""
        units = self.units
        if not len(units):
            return None
        offset = lambda u: (u >> 10) << ((u & 0x200) >> 6)
        node, found = offset(int(units[0])), None
        for i in range(at, len(data)):
            node ^= data[i]
            if node >= len(units):
                break
            unit = int(units[node])
            if unit & 0x800000FF != data[i]:
                break
            node ^= offset(unit)
            if unit & 0x100:
                start = int(units[node]) & 0x7FFFFFFF
                found = i + 1 - at, self.texts[start : self.texts.index(b"\0", start)]
        return found


class Normaliser:
    def __init__(self, spec: model_pb2.NormalizerSpec):
        self.map = CharacterMap(spec.precompiled_charsmap)
        self.add_prefix, self.squeeze = spec.add_dummy_prefix, spec.remove_extra_whitespaces
        self.identity = not len(self.map.units) and not self.squeeze

    def __call__(self, text: str) -> tuple[bytes, np.ndarray]:
        """Normalised bytes (a space mark is one space byte), and for each the original byte; one more entry marks the end."""
        data = text.encode()
        if self.identity:  # nothing to look up: only space marks change
            return self._without_map(data)
        out, source, at = bytearray(), [], 0
        while at < len(data):
            hit = self.map.longest(data, at)
            if hit:
                width, new = hit
            else:
                lead = data[at]
                width = 1 if lead < 0x80 else 2 if lead < 0xE0 else 3 if lead < 0xF0 else 4
                new = data[at : at + width]
            if new == SPACE_MARK.encode():  # a space mark in the text is read as a space
                new = b" "
            for byte in new:
                if not (self.squeeze and byte == 32 and (not out or out[-1] == 32)):
                    out.append(byte)
                    source.append(at)
            at += width
        end = len(data)
        while self.squeeze and out and out[-1] == 32:
            out.pop()
            end = source.pop()
        if self.add_prefix and out:
            out.insert(0, 32)
            source.insert(0, source[0])
        return bytes(out), np.array([*source, end], np.int64)


    def _without_map(self, data: bytes) -> tuple[bytes, np.ndarray]:
        marks = space_marks(np.frombuffer(data, np.uint8))
        source = np.append(np.delete(np.arange(len(data)), np.concatenate([marks + 1, marks + 2])), len(data))
        out = data.replace(SPACE_MARK.encode(), b" ")
        return (b" " + out, np.append(source[:1], source)) if self.add_prefix and out else (out, source)


class Codec:
    """A loaded model; one for each Python worker and path."""

    def __init__(self, path: str):
        proto = model_pb2.ModelProto()
        with open(path, "rb") as f:
            proto.ParseFromString(f.read())
        self.lib = sentencepiece.SentencePieceProcessor(model_file=path)
        self.normaliser = Normaliser(proto.normalizer_spec)
        pieces = [p.piece for p in proto.pieces]
        user_defined = any(p.type == model_pb2.ModelProto.SentencePiece.USER_DEFINED for p in proto.pieces)
        #: Encodes text that is normalised already; None where the map is empty or pieces of the user's are matched before it.
        self.plain = None
        if not (self.normaliser.identity or user_defined or proto.trainer_spec.treat_whitespace_as_suffix):
            proto.normalizer_spec.precompiled_charsmap, proto.normalizer_spec.normalization_rule_tsv = b"", ""
            proto.normalizer_spec.add_dummy_prefix = proto.normalizer_spec.remove_extra_whitespaces = False
            self.plain = sentencepiece.SentencePieceProcessor(model_proto=proto.SerializeToString())
        self.bos, self.eos = self.lib.bos_id(), self.lib.eos_id()
        #: Ordinary pieces are all that a text can hold: nothing user defined that could reach over a boundary.
        self.splits_at_spaces = (
            self.normaliser.identity and self.normaliser.add_prefix
            and not any(re.search(f"[^{SPACE_MARK}]{SPACE_MARK}", p) for p in pieces)
            and not user_defined
        )
        surface = [self._surface(p) for p in proto.pieces]
        self.width = np.array([len(x) for x in surface], np.int64)
        self.start = np.cumsum(self.width) - self.width
        self.bytes = np.frombuffer(b"".join(surface), np.uint8)

    @staticmethod
    def _surface(p) -> bytes:
        """The bytes that a piece stands for, as decoded."""
        kind = model_pb2.ModelProto.SentencePiece
        if p.type == kind.BYTE:
            return bytes([int(p.piece[3:5], 16)])
        if p.type == kind.CONTROL:
            return b""
        return b" \xe2\x81\x87 " if p.type == kind.UNKNOWN else p.piece.replace(SPACE_MARK, " ").encode()

    def _segments(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts and ends of the segments, and the first segment of each text."""
        cut = np.zeros(len(data), bool)
        if len(data) > 1:
            cut[1:] = (data[1:] == 32) & (data[:-1] != 32)
            cut[offsets[:-1][offsets[:-1] < len(data)]] = False
            if len(data) > 3:  # behind a space mark that the text itself holds nothing is cut
                marks = space_marks(data) + 3
                cut[marks[marks < len(data)]] = False
        full = offsets[:-1][np.diff(offsets) > 0]
        inner = np.flatnonzero(cut)
        head = np.concatenate([full, inner])  # a text's start, or the space that is cut away
        order = np.argsort(head, kind="stable")
        head = head[order]
        start = np.concatenate([full, inner + 1])[order]
        end = np.append(head[1:], len(data))
        return start, end, np.searchsorted(head, offsets)

    def encode_column(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids of all texts, first id of each text, text bytes) of a column of whole texts."""
        data, offsets = string_buffers(column)
        if not self.splits_at_spaces:
            texts = [x or "" for x in column.to_pylist()]
            each = self.lib.encode(texts, num_threads=1) if self.plain is None else self.plain.encode([self.normaliser(x)[0].decode() for x in texts], num_threads=1)
            return np.array([i for x in each for i in x], np.uint32), np.cumsum([0, *map(len, each)]), data
        start, end, first = self._segments(data, offsets)
        _, where, inverse = np.unique(span_hashes(data, start, end), return_index=True, return_inverse=True)
        raw, uniq_start, uniq_end = data.tobytes(), start[where], end[where]
        # equal segments are encoded once; those that end in a space mark (or are it) stand alone, the others go in runs joined by spaces again
        last = np.where(uniq_end > uniq_start, data[np.maximum(uniq_end - 1, 0)], 32)
        alone = (last == 32) | (last == 0x81)
        order = np.concatenate([np.flatnonzero(~alone), np.flatnonzero(alone)])
        pieces = [raw[a:b] for a, b in zip(uniq_start[order].tolist(), uniq_end[order].tolist(), strict=True)]
        n = len(pieces) - int(alone.sum())
        runs = [b" ".join(pieces[i : min(i + RUN_SEGMENTS, n)]).decode() for i in range(0, n, RUN_SEGMENTS)]
        runs += [x.decode() for x in pieces[n:]]
        each = self.lib.encode(runs, num_threads=1)
        for i in range(len(runs) - len(pieces) + n, len(runs)):
            each[i] = each[i] or self._lone_mark()
        flat = np.fromiter(chain.from_iterable(each), np.uint32)
        # a segment stands for one leading space and its bytes; token ends fall on segment ends
        length = uniq_end - uniq_start
        marks = space_marks(data)
        if len(marks):  # a space mark in the text is three bytes, its piece stands for one
            length = length - 2 * (np.searchsorted(marks, uniq_end) - np.searchsorted(marks, uniq_start))
        reach = np.cumsum(length[order] + 1)
        token_ends = np.cumsum(self.width[flat])
        stop = np.searchsorted(token_ends, reach)
        if len(reach) and not (token_ends[np.minimum(stop, len(flat) - 1)] == reach).all():
            raise ValueError("a token reaches over a segment's end")
        stop += 1
        width, begin = np.empty(len(order), np.int64), np.empty(len(order), np.int64)
        width[order] = np.diff(stop, prepend=0)
        begin[order] = stop - np.diff(stop, prepend=0)
        width, begin = width[inverse], begin[inverse]
        ends = np.cumsum(width)
        ids = flat[np.repeat(begin - (ends - width), width) + np.arange(ends[-1] if len(ends) else 0)]
        return ids, np.concatenate([[0], ends])[first], data

    def _lone_mark(self) -> list[int]:
        return [self.lib.piece_to_id(SPACE_MARK)]

    def decode_bytes(self, ids: np.ndarray) -> np.ndarray:
        """The bytes that ids stand for, before the leading space that the prefix made goes."""
        width = self.width[ids]
        ends = np.cumsum(width)
        return self.bytes[np.repeat(self.start[ids] - (ends - width), width) + np.arange(ends[-1] if len(ends) else 0)]

    def decoded(self, ids: np.ndarray) -> bytes:
        """What the library's ``decode`` gives for ids of a text, in UTF-8."""
        if not self.splits_at_spaces or (ids == self.lib.unk_id()).any():
            return self.lib.decode(ids.tolist()).encode()
        out = self.decode_bytes(ids).tobytes()
        return out[1:] if out[:1] == b" " else out

    def spans(self, text: str, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Starts and ends of the original byte span of each piece."""
        normal, source = self.normaliser(text)
        ends = np.cumsum(self.width[ids])
        if len(ids) and (ends[-1] != len(normal) or (ids == self.lib.unk_id()).any()):
            seen = text if self.plain is None else normal.decode()  # unknown pieces: their surface decides
            proto = (self.plain or self.lib).encode(seen, return_type="proto")
            at = np.cumsum([0] + [len(x) for x in map(str.encode, seen)])
            begin, end = at[[p.begin for p in proto.pieces]], at[[p.end for p in proto.pieces]]
            return (begin, end) if self.plain is None else (source[begin], np.maximum(source[begin], source[end]))
        starts = source[ends - self.width[ids]]
        return starts, np.maximum(starts, source[ends])


@lru_cache(maxsize=2)
def codec(path: str) -> Codec:
    return Codec(path)


def encode_documents(docs: DataFrame, model: str, text: str = "text", with_ids: bool = False, with_spans: bool = False) -> DataFrame:
    """Adds n_tokens, ids_sha256, decoded_sha256 (begin and end ids included), spans_sha256, and where asked for the ids and each piece's byte span.

    ``spans_sha256`` is the lowercase hex of start, end of each piece's span of the
    original UTF-8 text, in order, as little-endian unsigned 64-bit integers.
    """
    kinds = {"n_tokens": ("long", pa.int64()), "ids_sha256": ("string", pa.string()), "decoded_sha256": ("string", pa.string()), "spans_sha256": ("string", pa.string())}
    if with_ids:
        kinds["ids"] = ("array<int>", pa.list_(pa.int32()))
    if with_spans:
        kinds["spans"] = ("array<struct<start:bigint,end:bigint>>", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))
    names = {k: column_name(docs, k) for k in kinds}
    schema = docs.limit(0).selectExpr("*", *(f"cast(null as {kinds[k][0]}) as `{n}`" for k, n in names.items())).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(model)
        head, tail = np.array([c.bos], np.uint32), np.array([c.eos], np.uint32)
        for batch in batches:
            for part in text_sub_batches(batch, text):
                column = part.column(part.schema.get_field_index(text))
                ids, first, _ = c.encode_column(column)
                rows: dict[str, list] = {k: [] for k in kinds}
                for d in range(len(column)):
                    own = ids[first[d] : first[d + 1]]
                    whole = np.concatenate([head, own, tail])
                    rows["n_tokens"].append(len(whole))
                    rows["ids_sha256"].append(hashlib.sha256(whole.astype("<u4").tobytes()).hexdigest())
                    rows["decoded_sha256"].append(hashlib.sha256(c.decoded(own)).hexdigest())
                    starts, ends = c.spans(column[d].as_py() or "", own)
                    rows["spans_sha256"].append(hashlib.sha256(np.column_stack([starts, ends]).astype("<u8").tobytes()).hexdigest())
                    if with_ids:
                        rows["ids"].append(whole.astype(np.int32))
                    if with_spans:
                        rows["spans"].append([{"start": a, "end": b} for a, b in zip(starts.tolist(), ends.tolist(), strict=True)])
                made = [pa.array(rows[k], kinds[k][1]) for k in kinds]
                yield pa.RecordBatch.from_arrays([*part.columns, *made], names=[*part.schema.names, *names.values()])

    return docs.mapInArrow(run, schema)


def decode_ids(table: DataFrame, model: str, ids: str = "ids", to: str = "text") -> DataFrame:
    """Adds the decoded text of an array of ids (null: null)."""
    to = column_name(table, to)
    schema = table.limit(0).selectExpr("*", f"cast(null as string) as `{to}`").schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lib = codec(model).lib
        for batch in batches:
            values = batch.column(batch.schema.get_field_index(ids)).to_pylist()
            texts = [None if v is None else lib.decode(v) for v in values]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=[*batch.schema.names, to])

    return table.mapInArrow(run, schema)
