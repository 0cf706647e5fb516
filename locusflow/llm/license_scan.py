"""Licence scan: winnowed fingerprints pick candidates, banded alignment measures them.

Words are lower-cased runs of letters, digits and other non-ASCII characters.
Every template's word k-grams are winnowed (the least hash of each window of
``WINDOW`` k-grams) into an inverted index of fingerprint -> (template, place); every
k-gram of a text is looked up in it, so a shared run of ``K + WINDOW - 1`` words is
sure to meet.  Hits of one template that advance in both are chained, past insertions
of up to half the template; the text around a chain is aligned with the template in
a band over all diagonals of its hits and ``BAND`` more.  This gives the matched words, coverage of the template and the span in code points.

Of overlapping finds the one with most matched words less skipped text words stays.
In templates of under ``SHORT`` words every word with a digit, and every word that
under a third of them hold, must be matched, so that no licence is taken for another.

Defined results: null, empty and unlicensed texts have no row; repeated rows are
scanned one by one; equal finds (ties) go to the first licence by name; a template
shorter than K words is never found; an empty table gives an empty table; other columns
than doc_id and text are left out; a very long text is scanned whole, with memory in
proportion to its length.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import text_sub_batches
from .license_templates import TEMPLATES
from .textarrays import Words, code_points, windows, words_of

K, WINDOW, BAND, COVERAGE, SHORT = 3, 3, 8, 0.8, 20
#: Most templates; they are part of every task.
MOST_TEMPLATES = 20_000
_BETWEEN = np.ones(256, bool)
for _a, _b in ((48, 58), (65, 91), (97, 123), (128, 256)):
    _BETWEEN[_a:_b] = False


def _words(column: pa.Array) -> Words:
    return words_of(column, lower=True, space=_BETWEEN)


def winnow(h: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """Places of the winnowed fingerprints among k-gram hashes: the rightmost least value of each window."""
    if not len(h):
        return np.zeros(0, np.int64)
    if len(h) <= window:
        return np.array([len(h) - 1 - int(np.argmin(h[::-1]))])
    view = np.lib.stride_tricks.sliding_window_view(h[::-1], window)
    return np.unique(len(h) - 1 - (np.arange(len(view)) + view.argmin(1)))


class TemplateIndex:
    """Inverted index over the templates, which are a parameter and small."""

    def __init__(self, templates: list[tuple[str, str]], k: int = K):
        templates = sorted(templates)
        self.names = [name for name, _ in templates]
        w = _words(pa.array([text for _, text in templates], pa.string()))
        self.words = [w.hash[w.of(d)] for d in range(len(w))]
        numbered = np.array([any(48 <= c < 58 for c in w.text(i)) for i in range(len(w.hash))], bool)
        short = [np.unique(own) for own in self.words if len(own) < SHORT]
        word, held = np.unique(np.concatenate(short or [np.zeros(0, np.uint64)]), return_counts=True)
        telling = word[3 * held < len(short)]
        self.must = [(numbered[w.of(d)] | np.isin(own, telling)) & (len(own) < SHORT) for d, own in enumerate(self.words)]
        entries = []
        for d, own in enumerate(self.words):
            grams = windows(own, k)
            entries += [(int(grams[p]), d, int(p)) for p in winnow(grams)]
        entries.sort()
        self.prints = np.array([e[0] for e in entries], np.uint64)
        self.owner = np.array([e[1] for e in entries], np.int64)
        self.place = np.array([e[2] for e in entries], np.int64)

    def hits(self, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(index into ``prints``, entry) of all equal fingerprints."""
        a, b = np.searchsorted(self.prints, prints, "left"), np.searchsorted(self.prints, prints, "right")
        width = b - a
        ends = np.cumsum(width)
        return np.repeat(np.arange(len(prints)), width), np.repeat(a - (ends - width), width) + np.arange(ends[-1] if len(ends) else 0)


def banded_alignment(template: np.ndarray, text: np.ndarray, low: int, high: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of the matched words in the template and in the text, of an alignment with most matches on the diagonals (text place - template place) from ``low`` to ``high``; of equal ones the earliest in the text."""
    m, n, width = len(template), len(text), high - low + 1
    none = np.zeros(0, np.int64)
    if not m or not n:
        return none, none
    # best[i][j]: matches of the first i template words with the first i + low + j text words
    best = np.zeros((m + 1, width), np.int32)
    for i in range(1, m + 1):
        at = i + low + np.arange(width)  # text words read
        hit = (at >= 1) & (at <= n) & (text[np.clip(at - 1, 0, n - 1)] == template[i - 1])
        best[i] = np.maximum.accumulate(np.maximum(best[i - 1] + hit, np.append(best[i - 1][1:], 0)))
    i, j = m, width - 1
    a, b = [], []
    while i > 0 and best[i][j]:
        if j > 0 and best[i][j] == best[i][j - 1]:
            j -= 1  # a text word is skipped
        elif j + 1 < width and best[i][j] == best[i - 1][j + 1]:
            i, j = i - 1, j + 1  # a template word is skipped
        else:
            if best[i][j] > best[i - 1][j]:
                a.append(i - 1)
                b.append(i + low + j - 1)
            i -= 1
    return np.array(a[::-1], np.int64), np.array(b[::-1], np.int64)


def _chains(text_place: np.ndarray, place: np.ndarray, size: int) -> Iterator[list[int]]:
    """Chains of hits (in order of text place) that advance in text and template, with at most half the template of text inserted in one gap; best first, each hit in one chain."""
    reach = size + max(BAND, size // 2)
    n = len(text_place)
    score, back = np.ones(n), np.full(n, -1)
    for i in range(n):
        first = int(np.searchsorted(text_place, text_place[i] - reach))
        step, move = text_place[i] - text_place[first:i], place[i] - place[first:i]
        # hits on one diagonal are worth most: a gap costs a little for each word that it differs by
        worth = np.where((step > 0) & (move > 0) & (step - move <= max(BAND, size // 2)), score[first:i] - 0.01 * np.abs(step - move), -1.0)
        if len(worth) and worth.max() > 0:
            back[i] = first + int(np.argmax(worth))
            score[i] += worth.max()
    used = np.zeros(n, bool)
    for i in np.argsort(-score, kind="stable").tolist():
        chain, at = [], i
        while at >= 0 and not used[at]:
            chain.append(at)
            used[at] = True
            at = int(back[at])
        if chain:
            yield chain[::-1]


def align_chain(template: np.ndarray, text: np.ndarray, text_place: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Matched places in template and text of the alignment around a chain of hits: forwards from its first hit in a band over all their diagonals, and backwards from there."""
    p, q = int(text_place[0]), int(place[0])
    diagonal = (text_place - p) - (place - q)
    end = int(text_place[-1] + len(template) - place[-1]) + BAND
    a, b = banded_alignment(template[q:], text[p:end], int(diagonal.min()) - BAND, int(diagonal.max()) + BAND)
    c, d = banded_alignment(template[:q][::-1], text[max(0, p - q - BAND) : p][::-1], -BAND, BAND)
    return np.concatenate([q - 1 - c[::-1], a + q]), np.concatenate([p - 1 - d[::-1], b + p])


def scan_text(index: TemplateIndex, own: np.ndarray, prints: np.ndarray, places: np.ndarray, coverage: float) -> list[tuple[int, int, int, int]]:
    """(template, matched, first word, behind the last) of a text's licences; of overlapping ones the one with most matched less skipped words."""
    hit, entry = index.hits(prints)
    owner = index.owner[entry]
    found = []
    for t in np.unique(owner).tolist():
        template, mine = index.words[t], owner == t
        text_place, place = places[hit[mine]], index.place[entry[mine]]
        order = np.lexsort((place, text_place))
        text_place, place = text_place[order], place[order]
        for chain in _chains(text_place, place, len(template)):
            a, b = align_chain(template, own, text_place[chain], place[chain])
            if len(a) >= coverage * len(template) and not (index.must[t] & ~np.isin(np.arange(len(template)), a)).any():
                found.append((t, len(a), int(b[0]), int(b[-1]) + 1))
    # matched less skipped words of the text; then the first by name
    found.sort(key=lambda f: (-(2 * f[1] - (f[3] - f[2])), f[2], index.names[f[0]]))
    kept: list[tuple[int, int, int, int]] = []
    for f in found:
        if all(f[3] <= o[2] or o[3] <= f[2] for o in kept):
            kept.append(f)
    return sorted(kept, key=lambda f: f[2])


def template_table(templates: DataFrame, most: int = MOST_TEMPLATES) -> list[tuple[str, str]]:
    """Templates from a table (name, text) of at most ``most`` rows; rows without a text are left out."""
    rows = templates.select("name", "text").filter("name is not null and text is not null").limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} templates")
    return [(r["name"], r["text"]) for r in rows]


def scan(docs: DataFrame, templates: DataFrame | list[tuple[str, str]] | None = None, coverage: float = COVERAGE) -> DataFrame:
    """(doc_id, license, matched_words, template_words, coverage, span_start, span_end) of every licence found in ``docs(doc_id, text)``."""
    templates = TEMPLATES if templates is None else template_table(templates) if isinstance(templates, DataFrame) else templates

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = TemplateIndex(templates)
        wanted = np.unique(index.prints)
        for batch in batches:
            for part in text_sub_batches(batch):
                w = _words(part.column(1))
                grams = windows(w.hash, K)
                # a fingerprint of a template can only be chosen in texts that hold its k-gram at all
                near = np.flatnonzero(np.isin(grams, wanted))
                texts = np.unique(np.searchsorted(w.first, near, "right") - 1)
                rows = []
                for d in texts.tolist():
                    own = w.hash[w.of(d)]
                    h = windows(own, K)
                    places = np.flatnonzero(np.isin(h, wanted))
                    starts = None
                    for t, matched, a, b in scan_text(index, own, h[places], places, coverage):
                        if starts is None:
                            text = w.data[w.offsets[d] : w.offsets[d + 1]]
                            starts = np.concatenate([[0], np.cumsum(code_points(text))])
                        at = int(w.first[d])
                        lo, hi = int(w.start[at + a] - w.offsets[d]), int(w.end[at + b - 1] - w.offsets[d])
                        size = len(index.words[t])
                        rows.append((part.column(0)[d].as_py(), index.names[t], matched, size, matched / size, int(starts[lo]), int(starts[hi])))
                columns = list(zip(*rows, strict=True)) or [[]] * 7
                kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["doc_id", "license", "matched_words", "template_words", "coverage", "span_start", "span_end"])

    shape = "doc_id long, license string, matched_words long, template_words long, coverage double, span_start long, span_end long"
    return docs.selectExpr("cast(doc_id as long) as doc_id", "text").mapInArrow(run, shape)
