"""Quality rules as a short-circuit cascade.

Rules are plain measures with a limit.  Each rule's cost (the array elements that it
visits) and its rejection rate are estimated on a bounded sample chosen by hashes of
the rows; rules then run in the order of rejections by cost, and a text that one rule
rejects is not shown to the next.  So the order, and the rule named for a rejected
text, are the same in every run.  The verdict does not depend on the order: a text
is kept when no rule rejects it.

Defined results: a null text counts as empty; an empty text has no words and is
rejected by ``few_words``; repeated rows are judged one by one; rules that tie run in
the order of their names; an empty table gives an empty table; other columns are
passed through untouched, new ones get an underscore where a name is taken; a very long
text is measured whole, with memory in proportion to its length.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, MapType, StructType

from .common import column_name, text_sub_batches
from .textarrays import Words, code_points, span_hashes, windows, words_of

#: Texts on which costs and rejection rates are estimated.
SAMPLE_ROWS = 2000
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_BLANK = np.zeros(256, bool)
_BLANK[list(b" \t\n\v\f\r")] = True
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_LETTER = _UPPER.copy()
_LETTER[97:123] = True


def _per_text(words: Words, flags: np.ndarray) -> np.ndarray:
    out, full = np.zeros(len(words), np.int64), np.diff(words.offsets) > 0
    if full.any():  # texts follow each other, so each full one ends where the next begins
        out[full] = np.add.reduceat(flags.view(np.uint8), words.offsets[:-1][full], dtype=np.int64)
    return out


def n_words(w: Words) -> np.ndarray:
    return np.diff(w.first)


def word_chars(w: Words) -> np.ndarray:
    starts = code_points(w.data)
    return _per_text(w, starts & ~_BLANK[w.data])


def n_symbols(w: Words) -> np.ndarray:
    return _per_text(w, _SYMBOL[w.data])


def n_upper(w: Words) -> np.ndarray:
    return _per_text(w, _UPPER[w.data])


def n_letters(w: Words) -> np.ndarray:
    return _per_text(w, _LETTER[w.data])


def _lines(w: Words) -> tuple[np.ndarray, np.ndarray]:
    """(text, hash) of every line with a word."""
    breaks = np.flatnonzero(w.data == 10)
    start = np.concatenate([w.offsets[:-1], breaks + 1])
    owner = np.concatenate([np.arange(len(w)), np.searchsorted(w.offsets, breaks, "right") - 1])
    order = np.lexsort((start, owner))
    start, owner = start[order], owner[order]
    end = np.empty_like(start)
    end[:-1] = start[1:] - 1
    end[-1:] = w.offsets[-1:]
    last = np.flatnonzero(np.diff(owner, append=-1))
    end[last] = w.offsets[owner[last] + 1]
    full = np.searchsorted(w.start, end) > np.searchsorted(w.start, start)
    return owner[full], span_hashes(w.data, start[full], end[full])


def _repeats(owner: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order by (text, value), and whether each place equals the one before."""
    order = np.lexsort((value, owner))
    same = np.zeros(len(order), bool)
    same[1:] = (owner[order][1:] == owner[order][:-1]) & (value[order][1:] == value[order][:-1])
    return order, same


def n_lines(w: Words) -> np.ndarray:
    return np.bincount(_lines(w)[0], minlength=len(w))


def n_dup_lines(w: Words) -> np.ndarray:
    owner, value = _lines(w)
    order, same = _repeats(owner, value)
    return np.bincount(owner[order][same], minlength=len(w))


def n_repeat_words(w: Words) -> np.ndarray:
    h = windows(w.hash, 3)
    owner = np.repeat(np.arange(len(w)), np.diff(w.first))
    whole = np.flatnonzero(owner[: len(h)] == owner[2:]) if len(h) else np.zeros(0, np.int64)
    order, same = _repeats(owner[whole], h[whole])
    twice = same.copy()
    twice[:-1] |= same[1:]
    covered = np.zeros(len(owner), bool)
    at = whole[order[twice]]
    for j in range(3):
        covered[at + j] = True
    return np.bincount(owner[covered], minlength=len(w))


MEASURES: dict[str, Callable[[Words], np.ndarray]] = {f.__name__: f for f in (n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words)}


@dataclass(frozen=True)
class Rule:
    """Rejects the texts for which ``rejects(words)`` is true; ``cost(words)`` is how many array elements that visits."""

    name: str
    rejects: Callable[[Words], np.ndarray]
    cost: Callable[[Words], int]


BASE_RULES = (
    Rule("few_words", lambda w: w.measured(n_words) < 50, len),
    # three look-ups for each window, and a sort
    Rule("repeated_windows", lambda w: 100 * w.measured(n_repeat_words) > 50 * w.measured(n_words), lambda w: len(w.hash) * (3 + int(np.log2(len(w.hash) + 2)))),
)
#: Limits are far from ordinary prose: a symbol for every fourth word, half the letters in capitals, half the lines repeated, words of 1 or of over 16 characters.
MORE_RULES = (
    Rule("symbols", lambda w: 4 * w.measured(n_symbols) > w.measured(n_words), lambda w: len(w.data)),
    Rule("capitals", lambda w: 2 * w.measured(n_upper) > w.measured(n_letters) + 1, lambda w: 2 * len(w.data)),
    Rule("repeated_lines", lambda w: 2 * w.measured(n_dup_lines) > w.measured(n_lines), lambda w: 4 * len(w.data)),
    Rule("word_length", lambda w: (w.measured(word_chars) < 2 * w.measured(n_words)) | (w.measured(word_chars) > 16 * w.measured(n_words)), lambda w: 2 * len(w.data)),
)
RULES = BASE_RULES + MORE_RULES


def estimate_order(docs: DataFrame, rules: tuple[Rule, ...] = RULES, sample_rows: int = SAMPLE_ROWS) -> list[str]:
    """Rule names by rejections per cost on a sample of at most ``sample_rows`` texts, best first."""
    total = docs.count()
    atomic = [f.name for f in docs.schema.fields if not isinstance(f.dataType, (ArrayType, MapType, StructType))]
    share = min(1.0, 0.8 * sample_rows / max(total, 1))
    # the whole hash decides, so that a share of any smallness holds rows
    sample = (docs if share == 1 else docs.filter(F.xxhash64(*atomic) < int(share * 2**64) - 2**63)).select("text").limit(sample_rows)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spent, thrown = np.zeros(len(rules), np.int64), np.zeros(len(rules), np.int64)
        for batch in batches:
            for part in text_sub_batches(batch):
                words = words_of(part.column(0))
                for k, rule in enumerate(rules):
                    thrown[k] += int(rule.rejects(words).sum())
                    spent[k] += rule.cost(words)
        yield pa.RecordBatch.from_pydict({"rule": [r.name for r in rules], "cost": spent, "rejected": thrown})

    found = sample.mapInArrow(measure, "rule string, cost long, rejected long").groupBy("rule").agg(F.sum("cost").alias("cost"), F.sum("rejected").alias("rejected")).collect()  # one row per rule
    per = {r["rule"]: (r["rejected"] + 0.5) / (r["cost"] + 1) for r in found}
    return sorted((r.name for r in rules), key=lambda n: (-per.get(n, 0.0), n))


def judge(docs: DataFrame, rules: tuple[Rule, ...] = RULES, order: list[str] | None = None, measures: bool = False) -> DataFrame:
    """``docs`` with ``kept`` and ``failed_rule`` (the rule that threw a text out, by the estimated order), and the measures if wanted."""
    order = order or estimate_order(docs, rules)
    by_name = {r.name: r for r in rules}
    ranked = [by_name[n] for n in order]
    kept_col, rule_col = column_name(docs, "kept"), column_name(docs, "failed_rule")
    extra = [(column_name(docs, n), f) for n, f in MEASURES.items()] if measures else []
    out = docs.limit(0).selectExpr("*", f"cast(null as boolean) as `{kept_col}`", f"cast(null as string) as `{rule_col}`", *(f"cast(null as long) as `{n}`" for n, _ in extra)).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_sub_batches(batch):
                whole = words = words_of(part.column(part.schema.get_field_index("text")))
                made = [pa.array(whole.measured(f).astype(np.int64)) for _, f in extra]
                left = np.arange(len(words))
                failed = np.full(len(words), -1)
                for k, rule in enumerate(ranked):
                    if not len(left):
                        break
                    bad = rule.rejects(words)
                    failed[left[bad]] = k
                    if bad.any():
                        left, words = left[~bad], words.take(~bad)
                names = np.array([r.name for r in ranked] + [None], object)[failed]
                columns = list(part.columns) + [pa.array(failed < 0), pa.array(names.tolist(), pa.string())] + made
                yield pa.RecordBatch.from_arrays(columns, names=list(part.schema.names) + [kept_col, rule_col] + [n for n, _ in extra])

    return docs.mapInArrow(run, out)
