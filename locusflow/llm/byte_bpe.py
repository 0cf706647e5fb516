"""Byte-level BPE encoding and decoding with numpy matrices.

A batch of whole texts is cut into pieces as the usual pattern of byte-level BPE cuts
it, by classes of code points instead of a regular expression.  Equal pieces are encoded
once per batch.  Pieces of similar length lie in one padded matrix of token ids; each
round every row looks all its neighbours up in a hash table of pairs, merges its
leftmost pair of the least rank and closes the gap.  Other places of that very pair are
merged in the same round where the vocabulary proves that they come next anyway: no
pair with the merged token has a lower rank.

Vocabularies: ``.tiktoken`` (ranks; two neighbours merge when their joined bytes have a
rank, and a piece that has one itself is one token), or a tokenizer ``.json`` of the
byte-level BPE kind (its own list of merges).  Special tokens are never produced; their
strings inside texts are ordinary text.

Defined results: a null text counts as empty; an empty text has no tokens; repeated rows
are encoded alike; an empty table gives an empty table; other columns pass through, and new
ones get an underscore where a name is taken.  A very long text is worked on in stretches
cut where pieces always end, so memory follows its longest piece, not its length; a long
piece is cut first where two bytes stand side by side in no token.
"""

from __future__ import annotations

import base64
import hashlib
import json
import sys
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import column_name, text_sub_batches
from .textarrays import span_hashes, string_buffers

STRETCH = 5_000_000
#: Cells of one matrix.
CELLS = 1 << 18
#: Pieces whose ids a worker remembers before it forgets all of them, and the longest one that it remembers.
REMEMBERED, LONGEST_REMEMBERED = 250_000, 64
NONE = np.iinfo(np.int32).max
OTHER, LETTER, NUMBER, SPACE = range(4)
#: Code points with the White_Space property (fixed values).
WHITE_SPACE = (*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)


@lru_cache(maxsize=1)
def _classes() -> np.ndarray:
    """The class of every code point."""
    kinds = {"L": LETTER, "N": NUMBER}
    table = np.fromiter((kinds.get(unicodedata.category(chr(c))[0], OTHER) for c in range(sys.maxunicode + 1)), np.uint8, sys.maxunicode + 1)
    table[list(WHITE_SPACE)] = SPACE
    return table


def ragged(start: np.ndarray, width: np.ndarray) -> np.ndarray:
    """All indices of spans, one span after the other."""
    ends = np.cumsum(width)
    return np.repeat(start - (ends - width), width) + np.arange(ends[-1] if len(ends) else 0)


def piece_starts(points: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Where pieces begin among code points; ``first`` marks the beginnings of texts.

    A space before a run of letters, numbers or other characters belongs to it; all of a run
    of white space but its last character is a piece where something follows; an apostrophe
    with one of the usual English endings is a piece unless a space belongs to it.
    """
    n = len(points)
    if not n:
        return np.zeros(0, bool)
    kind = _classes()[points]
    run = first.copy()
    run[0] = True
    run[1:] |= kind[1:] != kind[:-1]
    starts = run.copy()
    head = np.flatnonzero(run & ~first & (kind != SPACE))
    head = head[head > 0]
    head = head[kind[head - 1] == SPACE]
    starts[head - 1] = True
    starts[head] = points[head - 1] != 0x20
    # endings: the apostrophe opens a piece, and letters of the same text follow
    at = np.flatnonzero((points == 0x27) & starts)
    at = at[at + 1 < n]
    at = at[~first[at + 1]]
    one = np.append(points, [0, 0])[at + 1]
    two = np.where(np.append(first, [True, True])[at + 2], 0, np.append(points, [0, 0])[at + 2])
    short = np.isin(one, [ord(c) for c in "stmd"])
    long = ((one == ord("r")) | (one == ord("v"))) & (two == ord("e")) | (one == ord("l")) & (two == ord("l"))
    starts[at[short | long] + 1] = False
    behind = np.concatenate([at[short] + 2, at[long] + 3])
    starts[behind[behind < n]] = True
    return starts


def _stretches(text: str, first: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(code points, piece starts) of stretches that end where a piece ends whatever follows: behind a letter or number, or before white space, where the class changes."""
    at, size = 0, STRETCH
    while at < len(text):
        points = np.frombuffer(text[at : at + size].encode("utf-32-le"), np.uint32)
        to = len(points)
        if at + to < len(text):
            kind = _classes()[points]
            cut = np.flatnonzero((kind[1:] != kind[:-1]) & ((kind[:-1] == LETTER) | (kind[:-1] == NUMBER) | (kind[:-1] == OTHER) & (kind[1:] == SPACE)) | first[at + 1 : at + to]) + 1
            if not len(cut):
                size *= 2
                continue
            to = int(cut[-1])
        yield points[:to], piece_starts(points[:to], first[at : at + to])
        at, size = at + to, STRETCH


class PairTable:
    """A hash table from pairs of ids to (rank, merged id): open addressing, looked up for whole arrays."""

    def __init__(self, left: np.ndarray, right: np.ndarray, rank: np.ndarray, merged: np.ndarray):
        self.bits = max(4, int(np.ceil(np.log2(max(len(left), 1) * 4))))
        self.keys = np.full(1 << self.bits, -1, np.int64)
        self.rank, self.merged = np.full(1 << self.bits, NONE, np.int32), np.zeros(1 << self.bits, np.int32)
        key = (left.astype(np.int64) << 32) | right
        slot, open_ = self._slot(key), np.arange(len(key))
        while len(open_):
            free = open_[self.keys[slot[open_]] == -1]
            _, winner = np.unique(slot[free], return_index=True)
            won = free[winner]
            self.keys[slot[won]], self.rank[slot[won]], self.merged[slot[won]] = key[won], rank[won], merged[won]
            open_ = open_[self.keys[slot[open_]] != key[open_]]
            slot[open_] = (slot[open_] + 1) & ((1 << self.bits) - 1)

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(rank, merged id) of flat arrays of pairs; the rank of an unknown pair is NONE."""
        key = (left.astype(np.int64) << 32) | right
        slot = self._slot(key)
        held = self.keys[slot]
        open_ = np.flatnonzero((held != key) & (held != -1))
        while len(open_):
            slot[open_] = (slot[open_] + 1) & ((1 << self.bits) - 1)
            held = self.keys[slot[open_]]
            open_ = open_[(held != key[open_]) & (held != -1)]
        return self.rank[slot], self.merged[slot]


def _byte_letters() -> dict[str, int]:
    """How byte-level vocabularies write bytes: printable ones as themselves, the others from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(0x100 + i): b for i, b in enumerate(rest)}


class _Memory:
    """Ids of pieces seen before, so that a word is merged once in many batches; it changes no result."""

    def __init__(self):
        self.place: dict[bytes, int] = {}
        self.ids, self.start, self.width = np.zeros(0, np.uint32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def add(self, keys: list[bytes], ids: np.ndarray, size: np.ndarray) -> None:
        self.place.update((k, len(self.start) + i) for i, k in enumerate(keys) if len(k) <= LONGEST_REMEMBERED)
        self.start = np.concatenate([self.start, len(self.ids) + np.cumsum(size) - size])
        self.width, self.ids = np.concatenate([self.width, size]), np.concatenate([self.ids, ids])


class ByteBPE:
    def __init__(self, tokens: dict[bytes, int], pairs: np.ndarray, whole: bool):
        """``pairs``: rows of left id, right id, rank, merged id; ``whole``: a piece that is a token itself is not merged."""
        size = max(tokens.values()) + 1
        by_id: list[bytes] = [b""] * size
        for t, i in tokens.items():
            by_id[i] = t
        self.width = np.array([len(t) for t in by_id], np.int64)
        self.start = np.cumsum(self.width) - self.width
        self.bytes = np.frombuffer(b"".join(by_id), np.uint8)
        self.of_byte = np.array([tokens[bytes([b])] for b in range(256)], np.int32)
        self.whole = tokens if whole else None
        self.memory = _Memory()
        left, right, rank, merged = pairs.T
        self.table = PairTable(left, right, rank, merged)
        lowest = np.full(size, NONE, np.int64)
        np.minimum.at(lowest, left, rank)
        np.minimum.at(lowest, right, rank)
        #: Whether all places of a pair of this rank may be merged in one round.
        self.at_once = np.ones(int(rank.max(initial=0)) + 1, bool)
        self.at_once[rank[lowest[merged] <= rank]] = False
        self.side_by_side = np.zeros((256, 256), bool)
        inner = np.ones(len(self.bytes), bool)
        inner[self.start[self.width > 0]] = False
        places = np.flatnonzero(inner)
        self.side_by_side[self.bytes[places - 1], self.bytes[places]] = True

    @staticmethod
    def from_ranks(path: str) -> ByteBPE:
        with open(path, "rb") as f:
            tokens = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        found = [(tokens[t[:i]], tokens[t[i:]], r, r) for t, r in tokens.items() for i in range(1, len(t)) if t[:i] in tokens and t[i:] in tokens]
        return ByteBPE(tokens, np.array(found, np.int64).reshape(-1, 4), True)

    @staticmethod
    def from_json(path: str) -> ByteBPE:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, split = spec["model"], spec["pre_tokenizer"] or {}
        plain = model["type"] == "BPE" and not any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback"))
        if not plain or spec["normalizer"] or split.get("type") != "ByteLevel" or not split.get("use_regex", True) or split.get("add_prefix_space"):
            raise ValueError("not a plain byte-level BPE tokenizer")
        letters = _byte_letters()
        as_bytes = lambda t: bytes(letters[c] for c in t)
        special = {t["content"] for t in spec["added_tokens"]}
        tokens = {as_bytes(t): i for t, i in model["vocab"].items() if t not in special}
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        found = [(tokens[a], tokens[b], r, tokens[a + b]) for r, (a, b) in enumerate((as_bytes(x), as_bytes(y)) for x, y in merges)]
        return ByteBPE(tokens, np.array(found, np.int64).reshape(-1, 4), bool(model.get("ignore_merges")))

    def _merge_rows(self, ids: np.ndarray, length: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Rounds over a padded matrix; gives (rows, their ids, their lengths) as rows end."""
        row = np.arange(len(ids))
        while len(row):
            n, w = ids.shape
            rank, merged = np.full((n, max(w - 1, 0)), NONE, np.int32), np.zeros((n, max(w - 1, 0)), np.int32)
            paired = np.arange(1, w) < length[:, None]
            rank[paired], merged[paired] = self.table.find(ids[:, :-1][paired], ids[:, 1:][paired])
            best = rank.min(axis=1, initial=NONE)
            over = best == NONE
            if over.any():
                yield row[over], ids[over], length[over]
                row, ids, length, rank, merged, best = (x[~over] for x in (row, ids, length, rank, merged, best))
                if not len(row):
                    return
            chosen = rank == best[:, None]
            single = ~self.at_once[best]
            if single.any():
                leftmost = chosen[single].argmax(axis=1)
                chosen[single] = False
                chosen[np.flatnonzero(single), leftmost] = True
            if (chosen[:, 1:] & chosen[:, :-1]).any():  # of neighbouring places every second one, from the left
                place = np.arange(chosen.shape[1])
                opens = chosen.copy()
                opens[:, 1:] &= ~chosen[:, :-1]
                chosen &= (place - np.maximum.accumulate(np.where(opens, place, 0), axis=1)) % 2 == 0
            ids[:, :-1][chosen] = merged[chosen]
            kept = np.arange(w) < length[:, None]
            kept[:, 1:] &= ~chosen
            flat = ids[kept]
            length = kept.sum(axis=1)
            ids = np.zeros((len(row), int(length.max())), np.int32)
            ids[np.arange(ids.shape[1]) < length[:, None]] = flat

    def encode_pieces(self, data: np.ndarray, start: np.ndarray, width: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all pieces, number of ids of each piece)."""
        n = len(start)
        part_of, part_start, part_width = np.arange(n), start, width
        known = np.full(n, -1, np.int64)
        if self.whole is not None:
            raw = data.tobytes()
            known = np.fromiter((self.whole.get(raw[a : a + w], -1) for a, w in zip(start.tolist(), width.tolist(), strict=True)), np.int64, n)
        todo = np.flatnonzero(known < 0)
        # what no token holds side by side never merges: cut there
        at = ragged(start[todo], width[todo])
        owner = np.repeat(todo, width[todo])
        opens = np.ones(len(at), bool)
        opens[1:] = (owner[1:] != owner[:-1]) | ~self.side_by_side[data[at[:-1]], data[at[1:]]]
        heads = np.flatnonzero(opens)
        part_of, part_start, part_width = owner[heads], at[heads], np.diff(np.append(heads, len(at)))
        part_size, found = np.zeros(len(heads), np.int64), []
        level = np.ceil(np.log2(np.maximum(part_width, 2))).astype(np.int64)
        for k in np.unique(level):
            rows = np.flatnonzero(level == k)
            step = max(1, CELLS >> int(k))
            for i in range(0, len(rows), step):
                own = rows[i : i + step]
                ids = np.zeros((len(own), int(part_width[own].max())), np.int32)
                ids[np.arange(ids.shape[1]) < part_width[own][:, None]] = self.of_byte[data[ragged(part_start[own], part_width[own])]]
                for done, made, length in self._merge_rows(ids, part_width[own].copy()):
                    part_size[own[done]] = length
                    found.append((own[done], length, made[np.arange(made.shape[1]) < length[:, None]]))
        size = np.bincount(part_of, part_size, minlength=n).astype(np.int64)
        size[known >= 0] = 1
        first = np.cumsum(size) - size
        out = np.zeros(int(size.sum()), np.uint32)
        out[first[known >= 0]] = known[known >= 0]
        inside = np.cumsum(part_size) - part_size  # parts of a piece follow each other
        base = inside - inside[np.searchsorted(part_of, part_of)] if len(part_of) else inside
        for own, length, flat in found:
            out[ragged(first[part_of[own]] + base[own], length)] = flat
        return out, size

    def _remembered(self, data: np.ndarray, start: np.ndarray, width: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids of many pieces, where each given piece's begin, how many they are)."""
        if len(self.memory.start) > REMEMBERED or len(self.memory.ids) > 8 * REMEMBERED:
            self.memory = _Memory()
        raw, known = data.tobytes(), self.memory.place
        keys = [raw[a : a + w] for a, w in zip(start.tolist(), width.tolist(), strict=True)]
        place = np.fromiter((known.get(k, -1) for k in keys), np.int64, len(keys))
        new = np.flatnonzero(place < 0)
        if len(new):
            place[new] = len(self.memory.start) + np.arange(len(new))
            self.memory.add([keys[i] for i in new.tolist()], *self.encode_pieces(data, start[new], width[new]))
        return self.memory.ids, self.memory.start[place], self.memory.width[place]

    def encode_column(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids of all texts, first id of each text and the end, text bytes) of a column of whole texts."""
        data, offsets = string_buffers(column)
        text = data.tobytes().decode()
        lead = np.cumsum((data & 0xC0) != 0x80) if len(data) else np.zeros(0, np.int64)
        at_point = np.concatenate([[0], lead])[offsets]  # code points before each text
        first = np.zeros(len(text) + 1, bool)
        first[at_point] = True
        all_ids, token_ends, byte_ends, at, tokens = [], [np.zeros(1, np.int64)], [np.zeros(1, np.int64)], 0, 0
        for points, starts in _stretches(text, first[: len(text)]):
            size = 1 + (points >= 0x80).astype(np.int64) + (points >= 0x800) + (points >= 0x10000)
            before = np.cumsum(size) - size
            part = data[at : at + int(size.sum())]
            start = before[starts]
            width = np.diff(np.append(start, len(part)))
            code, unique = pd.factorize(span_hashes(part, start, start + width))
            one = np.zeros(len(unique), np.int64)
            one[code[::-1]] = np.arange(len(code))[::-1]
            if not ((width[one[code]] == width).all() and (part[ragged(start[one[code]], width)] == part).all()):  # two pieces with one hash
                code, _ = pd.factorize(np.array([part[a : a + w].tobytes() for a, w in zip(start.tolist(), width.tolist(), strict=True)], object))
                one = np.zeros(code.max() + 1, np.int64)
                one[code[::-1]] = np.arange(len(code))[::-1]
            ids, begin, count = self._remembered(part, start[one], width[one])
            all_ids.append(ids[ragged(begin[code], count[code])])
            token_ends.append(tokens + np.cumsum(count[code]))
            byte_ends.append(at + start + width)
            at, tokens = at + len(part), tokens + len(all_ids[-1])
        ids = np.concatenate(all_ids) if all_ids else np.zeros(0, np.uint32)
        return ids, np.concatenate(token_ends)[np.searchsorted(np.concatenate(byte_ends), offsets)], data

    def decode_bytes(self, ids: np.ndarray) -> np.ndarray:
        """The bytes that ids stand for."""
        return self.bytes[ragged(self.start[ids], self.width[ids])]


@lru_cache(maxsize=3)
def load(path: str) -> ByteBPE:
    return ByteBPE.from_json(path) if path.endswith(".json") else ByteBPE.from_ranks(path)


def encode_documents(docs: DataFrame, vocabulary: str, text: str = "text", with_ids: bool = False) -> DataFrame:
    """Adds n_tokens, ids_sha256 (of the ids as little-endian unsigned 32-bit integers), decoded_sha256 (of the decoded bytes), and where asked for the ids."""
    kinds = {"n_tokens": ("long", pa.int64()), "ids_sha256": ("string", pa.string()), "decoded_sha256": ("string", pa.string())}
    if with_ids:
        kinds["ids"] = ("array<int>", pa.list_(pa.int32()))
    names = {k: column_name(docs, k) for k in kinds}
    schema = docs.limit(0).selectExpr("*", *(f"cast(null as {kinds[k][0]}) as `{n}`" for k, n in names.items())).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(vocabulary)
        for batch in batches:
            for part in text_sub_batches(batch, text):
                ids, first, _ = bpe.encode_column(part.column(part.schema.get_field_index(text)))
                each = [ids[a:b] for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True)]
                made = [
                    pa.array(np.diff(first), pa.int64()),
                    pa.array([hashlib.sha256(x.astype("<u4").tobytes()).hexdigest() for x in each], pa.string()),
                    pa.array([hashlib.sha256(bpe.decode_bytes(x).tobytes()).hexdigest() for x in each], pa.string()),
                ]
                if with_ids:
                    made.append(pa.ListArray.from_arrays(pa.array(first, pa.int32()), pa.array(ids.astype(np.int32))))
                yield pa.RecordBatch.from_arrays([*part.columns, *made], names=[*part.schema.names, *names.values()])

    return docs.mapInArrow(run, schema)


def decode_ids(table: DataFrame, vocabulary: str, ids: str = "ids", to: str = "text") -> DataFrame:
    """Adds the decoded text of an array of ids (null: null); bytes that are no UTF-8 become U+FFFD."""
    to = column_name(table, to)
    schema = table.limit(0).selectExpr("*", f"cast(null as string) as `{to}`").schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(vocabulary)
        for batch in batches:
            values = batch.column(batch.schema.get_field_index(ids)).to_pylist()
            texts = [None if v is None else bpe.decode_bytes(np.array(v, np.int64)).tobytes().decode(errors="replace") for v in values]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=[*batch.schema.names, to])

    return table.mapInArrow(run, schema)
