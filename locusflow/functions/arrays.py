"""Column expressions over per-position arrays and vectors."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from hashlib import md5

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def total(a: Column | str) -> Column:
    return F.aggregate(_col(a), F.lit(0.0), lambda s, x: s + F.coalesce(x.cast("double"), F.lit(0.0)))


def mean(a: Column | str) -> Column:
    """Mean of the values that are not null; null if there are none."""
    known = F.filter(_col(a), lambda x: x.isNotNull())
    return F.try_divide(total(known), F.size(known).cast("double"))


def dot(a: Column | str, b: Column | str) -> Column:
    return total(F.zip_with(_col(a), _col(b), lambda x, y: x.cast("double") * y.cast("double")))


def l1(a: Column | str, b: Column | str) -> Column:
    return total(F.zip_with(_col(a), _col(b), lambda x, y: F.abs(x.cast("double") - y.cast("double"))))


def l2(a: Column | str, b: Column | str) -> Column:
    return F.sqrt(total(F.zip_with(_col(a), _col(b), lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double")))))


def cosine(a: Column | str, b: Column | str) -> Column:
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def normalised(p: Column | str) -> Column:
    """Values over their sum."""
    p = _col(p)
    return F.transform(p, lambda x: F.try_divide(x.cast("double"), total(p)))


def normalised_rows(m: Column | str) -> Column:
    return F.transform(_col(m), normalised)


def reversed_matrix(m: Column | str) -> Column:
    """A per-position A, C, G, T matrix read on the other strand."""
    return F.transform(F.reverse(_col(m)), lambda row: F.reverse(row))


#: Added to a probability before its logarithm is taken (fixed value).
EPSILON = 1e-14


def influence(ref: Column | str, alt: Column | str, epsilon: float = EPSILON) -> Column:
    """For each position the largest change of any base's log2 odds between two probability matrices, whose rows are normalised first."""
    odds = lambda p: F.log2(p + epsilon) - F.log2(1 - p + epsilon)
    return F.zip_with(normalised_rows(ref), normalised_rows(alt), lambda r, a: F.array_max(F.zip_with(r, a, lambda x, y: F.abs(odds(x) - odds(y)))))


def mean_without(a: Column | str, centre: Column | int) -> Column:
    """Mean of an array with one place left out."""
    return mean(F.filter(_col(a), lambda x, i: i != centre))


def mean_around(a: Column | str, centre: Column | str | int, radius: Column | int) -> Column:
    """Mean of the ``radius`` values before a centre and the ``radius - 1`` behind it."""
    c, r = (_col(centre) if isinstance(centre, (str, Column)) else F.lit(centre)), radius if isinstance(radius, Column) else F.lit(radius)
    return mean(F.filter(_col(a), lambda x, i: (i >= c - r) & (i < c + r) & (i != c)))


def log_scores(p_ref: Column | str, p_alt: Column | str, epsilon: float = EPSILON) -> tuple[Column, Column, Column]:
    """(log p_ref, -log p_alt, their sum)."""
    a, b = F.log(_col(p_ref) + epsilon), -F.log(_col(p_alt) + epsilon)
    return a, b, a + b


def motif_scores(probs: Column | str, seq: Column | str, start: Column | str, k: int, how: str = "mean", epsilon: float = EPSILON) -> tuple[Column, Column, Column]:
    """(reference, alternative, ratio) scores of a motif: the mean or maximum over its k positions of the reference base's
    probability, of minus the log of the least other base's, and of the log ratio of both.

    Rows are normalised over their first four values.
    """
    rows = F.transform(F.slice(_col(probs), _col(start) + 1, F.lit(k)), lambda row: normalised(F.slice(row, 1, 4)))
    letters = F.split(F.substr(F.upper(_col(seq)), _col(start) + 1, F.lit(k)), "")
    at = lambda c: F.instr(F.lit("ACGT"), c) - 1
    ref = F.zip_with(rows, letters, lambda row, c: F.get(row, at(c)))
    least = F.zip_with(rows, letters, lambda row, c: F.array_min(F.filter(row, lambda x, i: i != at(c))))
    both = F.zip_with(ref, least, lambda x, y: F.log(x + epsilon) - F.log(y + epsilon))
    fold = mean if how == "mean" else F.array_max
    return fold(ref), fold(F.transform(least, lambda y: -F.log(y + epsilon))), fold(both)


def track_score(track: Column | str, start: Column | str, k: int) -> Column:
    """A conservation track's score of a motif: the largest of its k values."""
    return F.array_max(F.slice(_col(track), _col(start) + 1, F.lit(k)))


def masked_mean(vectors: Column | str, mask: Column | str) -> Column:
    """Mean of the vectors whose mask is 1, dimension by dimension."""
    kept = F.filter(F.arrays_zip(_col(vectors).alias("v"), _col(mask).alias("m")), lambda z: z["m"] == 1)
    n = F.size(kept).cast("double")
    width = F.size(F.get(_col(vectors), F.lit(0)))
    zero = F.array_repeat(F.lit(0.0), width)
    return F.transform(F.aggregate(F.transform(kept, lambda z: F.transform(z["v"], lambda x: x.cast("double"))), zero, lambda s, v: F.zip_with(s, v, lambda x, y: x + y)), lambda x: F.try_divide(x, n))


def densified(track: DataFrame, key: str, pos: str, value: str, lengths: DataFrame, length: str) -> DataFrame:
    """Sparse (pos, value) rows as one array for each key, null in the gaps; of several values at one place the last by value stays."""
    found = track.groupBy(key, pos).agg(F.max(value).alias(value)).groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct(pos, value))).alias("_m"))
    out = lengths.join(found, key, "left")
    domain = F.when(F.col(length) > 0, F.sequence(F.lit(0), F.col(length) - 1)).otherwise(F.array().cast("array<int>"))
    return out.withColumn("scores", F.transform(domain, lambda i: F.try_element_at("_m", i.cast(track.schema[pos].dataType)))).drop("_m")


def centre_window(a: Column | str, length: int) -> Column:
    """The middle ``length`` values."""
    a = _col(a)
    return F.slice(a, F.greatest(F.floor((F.size(a) - length) / 2).cast("int"), F.lit(0)) + 1, F.lit(length))


def only_lower(a: Column | str, seq: Column | str) -> Column:
    """Values from the first to the last lower-case base; none where there is no such base."""
    a, seq = _col(a), _col(seq)
    first, last = F.regexp_instr(seq, F.lit("[a-z]")), F.length(F.regexp_extract(seq, "(?s)^(.*[a-z])", 1))
    return F.slice(a, F.greatest(first, F.lit(1)), F.when(first > 0, last - first + 1).otherwise(0))


def padded(a: Column | str, left: Column | int, right: Column | int) -> Column:
    """Nulls on both sides."""
    a = _col(a)
    empty = lambda n: F.filter(F.transform(F.array_repeat(F.lit(0), n if isinstance(n, Column) else F.lit(n)), lambda _: F.get(F.filter(a, lambda x: F.lit(False)), F.lit(0))), lambda x: F.lit(True))
    return F.concat(empty(left), a, empty(right))


def best_column(columns: Sequence[str], default: float | None = None) -> Column:
    return F.greatest(*(F.col(c) for c in columns)) if default is None else F.coalesce(F.greatest(*(F.col(c) for c in columns)), F.lit(default))


def rolling_masks(length: Column | str, stride: int) -> Column:
    """``stride`` masks; together they cover every place once."""
    n = _col(length)
    places = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    return F.transform(F.sequence(F.lit(0), F.lit(stride - 1)), lambda s: F.transform(places, lambda i: (i % stride == s).cast("int")))


#: Rows whose arrays are masked at once.
ROWS_AT_ONCE = 500


def masked_tokens(df: DataFrame, key: str, tokens: str, share: float = 0.15, seed: int = 0, mask: int = 4, classes: int = 4, frame: int = 0) -> DataFrame:
    """Random masking with exact counts among the places inside a frame: of n places, taken in an order by hash, round(0.8 share n)
    become the mask, the next round(0.1 share n), one at least, a random class, and the next round(0.1 share n) stay; labels are -100 elsewhere.

    Halves are rounded to even.  Nothing is masked where the frame leaves no place.  Hashes and ranks are taken inside each row's array, so nothing is shuffled.
    """
    kind = df.schema[tokens].dataType.simpleString()

    def hashed(name: str | None, n: int) -> tuple[np.ndarray, np.ndarray]:
        """The order of the n places inside the frame, and their digests."""
        head = b"" if name is None else name.encode() + b":"
        digests = b"".join([md5(b"%b%d:%d" % (head, i, seed)).digest() for i in range(frame, frame + n)])
        halves = np.frombuffer(digests, ">u8").astype(np.uint64).reshape(-1, 2)
        return np.lexsort((halves[:, 1], halves[:, 0])), np.frombuffer(digests, np.uint8).reshape(-1, 16)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS_AT_ONCE):
                part = batch.slice(at, ROWS_AT_ONCE)
                lists, names = part.column(part.num_columns - 2), part.column(part.num_columns - 1).to_pylist()
                flat = lists.flatten()
                void, values = flat.is_null().to_numpy(zero_copy_only=False), flat.fill_null(0).to_numpy(zero_copy_only=False)
                sizes = pc.list_value_length(lists).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
                ends = np.cumsum(sizes)
                masked, labels, gone, hidden = values.copy(), np.full(len(values), -100, values.dtype), void.copy(), np.zeros(len(values), bool)
                for r, (end, size) in enumerate(zip(ends, sizes, strict=True)):
                    n = size - 2 * frame
                    if n < 1:
                        continue
                    order, digests = hashed(names[r], n)
                    first = int(np.rint(share * 0.8 * n))
                    second = first + max(int(np.rint(share * 0.1 * n)), 1)
                    third = second + int(np.rint(share * 0.1 * n))
                    place = end - size + frame + order[:third]
                    d = digests[order[first:second]].astype(np.int64)
                    # hexadecimal digits 14 to 21
                    number = ((d[:, 6] & 15) << 28) | (d[:, 7] << 20) | (d[:, 8] << 12) | (d[:, 9] << 4) | (d[:, 10] >> 4)
                    masked[place[:first]], masked[place[first:second]] = mask, number % classes
                    gone[place[:second]] = False
                    labels[place], hidden[place] = values[place], void[place]
                bounds = pa.array(np.concatenate([[0], ends]).astype(np.int32), mask=np.append(lists.is_null().to_numpy(zero_copy_only=False), False))
                arrays = [pa.ListArray.from_arrays(bounds, pa.array(x, mask=m)) for x, m in ((masked, gone), (labels, hidden))]
                yield pa.RecordBatch.from_arrays([*part.columns[:-2], *arrays], names=[*part.schema.names[:-2], "masked", "labels"])

    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
    return df.select("*", F.col(tokens).alias("_t"), F.col(key).cast("string").alias("_name")).mapInArrow(run, f"{kept}, masked {kind}, labels {kind}")


def spread_mask(mask: Column | str, before: int = 3, behind: int = 2) -> Column:
    """A place is masked if any mask lies up to ``before`` places before or ``behind`` places behind it."""
    m = _col(mask)
    return F.transform(m, lambda x, i: F.array_max(F.slice(m, F.greatest(i - before, F.lit(0)) + 1, F.least(i, F.lit(before)) + behind + 1)))
