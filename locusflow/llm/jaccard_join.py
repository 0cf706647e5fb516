"""N-gram Jaccard join: all links between documents whose shingle sets overlap enough, exactly.

The join is aware of set sizes.  *Small* sets list their fixed-size subsets: two
sets of sizes a <= b link just when they share a subset of the needed overlap, so
a subset key that a set of size a and another one list is a link with nothing left
to verify (two sets of the larger size b alone may share too little).  *Large* sets go into
inverted lists: with the rarest shingles first, linked sets share one of their
first ``size - ceil(0.8 size) + 1`` shingles.  The boundary between the two is the
size for which the estimated work, from the histogram of sizes, is least.

How rare a shingle is comes from counts of all shingles of all documents, folded
into a fixed number of cells; any fixed order finds all links, a good one keeps
the lists short although passages and whole documents are shared by many.

Lists are not expanded into pairs.  Each list names its smallest member as its
centre; all lists with one centre form a neighbourhood (every pair that shares a
list meets in it).  Members are verified against their centre first.  Those linked to
it are connected already, so only the others are verified against all members, by
scanning the local inverted lists of the members' full sets; large neighbourhoods are
cut into pairs of blocks of like sizes.  Copies with one set are one class throughout.

Before texts are moved to be verified, members meet by *parities*, about a bit for
each shingle: two sets differ in at least as many shingles as their parities differ
in bits.  A member whose parities rule out its centre, or all it meets, is not moved.

Defined results: null and empty texts have no shingles and link with nothing (a
component of their own); repeated rows are copies; a null doc_id takes part like
any other but is never the smallest.  Every row has a written key of its own, so
that one doc_id may stand for several texts.  Sets are compared by 64-bit hashes.  An
empty table gives an empty table; ``link_components`` leaves other columns out,
``one_of_each_group`` passes them through; a very long text is one set, held whole in a task.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, column_name, join_checked, small_enough, text_sub_batches
from .components import connected_components
from .textarrays import mix, shingle_set, windows, words_of

#: Cells into which shingle counts are folded, and how many travel in one row.
CELLS, CELLS_A_ROW = 1 << 20, 1 << 13
#: Largest size whose subsets may be listed.
MOST_SMALL = 16
#: Members of one block of a neighbourhood.
BLOCK = 512
#: A list whose cell counts more than this is split over tasks.
HEAVY = 4096
#: Texts with over 1 / MOST_OFTEN of all rows are joined apart.
MOST_OFTEN = 1000
#: Most rows of a table that is broadcast; larger ones are joined by shuffling.
BROADCAST_ROWS = 1_000_000


class Threshold:
    """Jaccard >= num / den, in whole numbers."""

    def __init__(self, num: int = 80, den: int = 100):
        self.num, self.den = num, den

    def overlap(self, a: int, b: int) -> int:
        """Least intersection of linked sets with sizes a and b."""
        return -(-self.num * (a + b) // (self.num + self.den))

    def links(self, common, a, b):
        return self.den * common >= self.num * (a + b - common)

    def least(self, n: int) -> int:
        """Least size of a partner, which is also the least intersection."""
        return -(-self.num * n // self.den)

    def most(self, n: int) -> int:
        return self.den * n // self.num

    def prefix(self, n: int) -> int:
        return n - self.least(n) + 1

    def subset_work(self, n: int) -> int:
        return sum(comb(n, self.overlap(n, b)) for b in range(n, self.most(n) + 1)) + sum(comb(n, self.overlap(a, n)) for a in range(self.least(n), n))


def boundary(sizes: dict[int, int], at: Threshold) -> int:
    """Largest small size: the choice with the least work, where a large set costs its listed shingles and, to verify, its whole set."""
    large = lambda n: at.prefix(n) + n
    work = {}
    for x in range(MOST_SMALL + 1):
        # sets next to the boundary take part on both sides
        work[x] = sum(c * ((at.subset_work(n) if n <= x else 0) + (large(n) if at.most(n) > x else 0)) for n, c in sizes.items())
    return min(work, key=lambda x: (work[x], x))


def subset_keys(values: np.ndarray, at: Threshold) -> tuple[list[int], list[int]]:
    """Keys of the subsets that a small set shares with every set that links to it, and their kinds: 0 where the set has the smaller size of the key, 3 where it has the larger."""
    n, keys, kinds = len(values), [], []
    for other in range(at.least(n), at.most(n) + 1):
        a, b = min(n, other), max(n, other)
        tag = np.uint64((a << 32) | b)
        for part in combinations(values, at.overlap(a, b)):
            keys.append(mix(windows(np.array([tag, *part], np.uint64), len(part) + 1))[0])
            kinds.append(0 if n == a else 3)
    return keys, kinds


def _digest(values: np.ndarray) -> np.int64:
    """One number for a whole set."""
    with np.errstate(over="ignore"):
        return mix(np.array([np.bitwise_xor.reduce(mix(values)) + np.sum(values) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(len(values))], np.uint64)).view(np.int64)[0]


def _sets(batch: pa.RecordBatch, k: int) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray]]]:
    for part in text_sub_batches(batch):
        words = words_of(part.column(part.schema.get_field_index("text")), lower=True)
        yield part, [shingle_set(words.hash[words.of(d)], k) for d in range(len(words))]


def _parities(values: np.ndarray) -> np.ndarray:
    """Whether an odd number of shingles falls on each of as many bits as there are shingles, rounded up to a power of two (64 at least)."""
    bits = max(64, 1 << (len(values) - 1).bit_length())
    odd = np.bincount((values & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.uint64)


def _folded(parities: np.ndarray, words: int) -> np.ndarray:
    """Parities over fewer bits."""
    return np.bitwise_xor.reduce(parities.reshape(-1, words), axis=0)


def _cell(values: np.ndarray) -> np.ndarray:
    return (values >> np.uint64(44)).astype(np.int64)


def _summaries(docs: DataFrame, k: int) -> DataFrame:
    """Rows of two kinds: (uid, doc_id, digest, n, parities) of each of ``docs(uid, doc_id, text)``, and partial cell counts of each task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = np.zeros(CELLS, np.int32)
        schema = pa.schema([("uid", pa.int64()), ("doc_id", pa.int64()), ("digest", pa.int64()), ("n", pa.int64()), ("row", pa.int32()), ("counts", pa.binary()), ("parities", pa.binary())])
        for batch in batches:
            for part, sets in _sets(batch, k):
                full = [s for s in sets if len(s)]
                if full:
                    cells += np.bincount(_cell(np.concatenate(full)), minlength=CELLS).astype(np.int32)
                n = len(sets)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array([_digest(s) if len(s) else None for s in sets], pa.int64()), pa.array([len(s) for s in sets], pa.int64()), pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary()), pa.array([_parities(s).tobytes() if len(s) else None for s in sets], pa.binary())], schema=schema
                )
        if cells.any():
            rows = cells.reshape(-1, CELLS_A_ROW)
            n = len(rows)
            yield pa.RecordBatch.from_arrays([*(pa.nulls(n, pa.int64()) for _ in range(4)), pa.array(np.arange(n, dtype=np.int32)), pa.array([r.tobytes() for r in rows], pa.binary()), pa.nulls(n, pa.binary())], schema=schema)

    return docs.mapInArrow(run, "uid long, doc_id long, digest long, n long, row int, counts binary, parities binary")


def _cell_counts(parts: DataFrame) -> np.ndarray:
    """All cells' counts: a fixed 4 MB, however many documents there are."""

    def add(table: pa.Table) -> pa.Table:
        total = np.zeros(CELLS_A_ROW, np.int64)
        for x in table.column("counts").to_pylist():
            total += np.frombuffer(x, np.int32)
        return pa.table({"row": pa.array([table.column("row")[0].as_py()], pa.int32()), "counts": pa.array([np.minimum(total, 2**31 - 1).astype(np.int32).tobytes()], pa.binary())})

    # partial sums first, so that no task holds a row of every task
    some = parts.groupBy("row", (F.spark_partition_id() % 16).alias("salt")).applyInArrow(add, "row int, counts binary")
    out = np.zeros(CELLS, np.int32)
    for r in some.groupBy("row").applyInArrow(add, "row int, counts binary").collect():
        out[r["row"] * CELLS_A_ROW : (r["row"] + 1) * CELLS_A_ROW] = np.frombuffer(r["counts"], np.int32)
    return out


def _postings(docs: DataFrame, k: int, at: Threshold, small: int, cells, heavy: int) -> DataFrame:
    """(token, digest, size, kind): kind 0 or 3 for a subset key, 1 for a listed shingle, 2 for a shingle of a heavy cell."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, seen = cells.value, set()
        for batch in batches:
            tokens, owners, sizes, kinds = [], [], [], []
            for _, sets in _sets(batch, k):
                for values in sets:
                    n = len(values)
                    if not n or (digest := _digest(values)) in seen:
                        continue
                    if len(seen) < 1_000_000:
                        seen.add(digest)
                    if n <= small:
                        keys, roles = subset_keys(values, at)
                        tokens.append(np.array(keys, np.uint64))
                        owners.append(np.full(len(keys), digest))
                        sizes.append(np.full(len(keys), n, np.int32))
                        kinds.append(np.array(roles, np.int8))
                    if at.most(n) > small:
                        seen_often = counts[_cell(values)]
                        first = np.lexsort((values, seen_often))[: at.prefix(n)]
                        tokens.append(values[first])
                        owners.append(np.full(len(first), digest))
                        sizes.append(np.full(len(first), n, np.int32))
                        kinds.append(np.where(seen_often[first] > heavy, 2, 1).astype(np.int8))
            if tokens:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(tokens).view(np.int64)), pa.array(np.concatenate(owners).astype(np.int64)), pa.array(np.concatenate(sizes)), pa.array(np.concatenate(kinds))], names=["token", "digest", "size", "kind"])

    return docs.select("text").mapInArrow(run, "token long, digest long, size int, kind byte")


def _spokes(postings: DataFrame, at: Threshold, scratch: Scratch) -> DataFrame:
    """(centre, member, exact): every member of a list with the list's smallest member.

    A list in order of size breaks where the next set is too large to link with
    any before: pairs across the break cannot link.  The list of a subset key that
    no set of the smaller size is in has no spokes.
    """
    # postings are worked out once: those of heavy cells, whose lists may hold a large part of all rows, are dealt over tasks and pass through
    salt = F.when(F.col("kind") == 2, F.pmod("digest", F.lit(4096))).otherwise(0)
    dealt = postings.withColumn("salt", salt).repartition("token", "salt").sortWithinPartitions("token", "salt", "size", "digest").drop("salt")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, last_size, centre, role = None, 0, None, 0
        for batch in batches:
            token, digest, size, kind = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(4))
            often = kind == 2
            if often.any():
                rows = batch.filter(pa.array(often))
                none = pa.nulls(rows.num_rows, pa.int64())
                yield pa.RecordBatch.from_arrays([none, rows.column(1), pa.nulls(rows.num_rows, pa.bool_()), rows.column(0), rows.column(2)], names=names)
                token, digest, size, kind = (x[~often] for x in (token, digest, size, kind))
            size = size.astype(np.int64)
            if not len(token):
                continue
            new = np.empty(len(token), bool)
            new[0] = token[0] != last or at.den * last_size < at.num * size[0]
            new[1:] = (token[1:] != token[:-1]) | (at.den * size[:-1] < at.num * size[1:])
            head = np.where(new, np.arange(len(token)), 0)
            np.maximum.accumulate(head, out=head)
            middle, first_kind = digest[head], kind[head]
            if not new[0]:
                goes_on = int(np.argmax(new)) if new.any() else len(token)
                middle[:goes_on], first_kind[:goes_on] = centre, role
            last, last_size, centre, role = token[-1], size[-1], middle[-1], first_kind[-1]
            apart = (middle != digest) & (first_kind != 3)
            pairs = np.unique(np.rec.fromarrays([middle[apart], digest[apart], kind[apart] != 1], names="a,b,exact"))
            yield pa.RecordBatch.from_arrays([pa.array(pairs.a), pa.array(pairs.b), pa.array(pairs.exact), pa.nulls(len(pairs), pa.int64()), pa.nulls(len(pairs), pa.int32())], names=names)

    names = ["centre", "member", "exact", "token", "size"]
    made = scratch.save(dealt.mapInArrow(run, "centre long, member long, exact boolean, token long, size int"))
    # a heavy list falls into one list for every two neighbouring classes of size; a partial minimum finds its centre, and a join gives it to the members
    many = made.filter("centre is null").select("token", F.col("member").alias("digest"), F.explode(F.array(_size_class(F.col("size"), at), _size_class(F.col("size"), at) - 1)).alias("class"))
    centres = many.groupBy("token", "class").agg(F.min("digest").alias("centre"), F.count(F.lit(1)).alias("members")).filter("members > 1").select("token", "class", "centre")
    heavy = join_checked(many, scratch.save(centres), ["token", "class"], "inner", BROADCAST_ROWS).filter("centre <> digest").select("centre", F.col("digest").alias("member"), F.lit(False).alias("exact"))
    return made.filter("centre is not null").select("centre", "member", "exact").unionByName(heavy).groupBy("centre", "member").agg(F.max("exact").alias("exact"))


def _size_class(size, at: Threshold):
    """Classes of set sizes: linked sets are in the same or in neighbouring ones."""
    return F.floor(F.log(size.cast("double")) / F.log(F.lit(at.den / at.num)) + 1e-9).cast("int")


def _local_links(ids: list[int], sets: list[np.ndarray], left: np.ndarray, right: np.ndarray, at: Threshold) -> tuple[list[int], list[int]]:
    """A forest of the links between sets on the left and sets on the right (masks over ``ids``), by scanning inverted lists."""
    sizes = np.array([len(s) for s in sets], np.int64)
    parent = np.arange(len(ids))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    index = np.flatnonzero(right)
    flat = np.concatenate([sets[i] for i in index])
    owner = np.repeat(index, sizes[index])
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], owner[order]
    us, vs = [], []
    for i in np.flatnonzero(left):
        begin, end = np.searchsorted(flat, sets[i], "left"), np.searchsorted(flat, sets[i], "right")
        width = end - begin
        ends = np.cumsum(width)
        if not ends[-1]:
            continue
        hits = owner[np.repeat(begin - (ends - width), width) + np.arange(ends[-1])]
        common = np.bincount(hits, minlength=len(ids))
        for j in np.flatnonzero(at.links(common, sizes[i], sizes) & (common > 0)):
            if j != i and (a := root(i)) != (b := root(j)):
                parent[max(a, b)] = min(a, b)
                us.append(ids[i])
                vs.append(ids[j])
    return us, vs


def _near(rows: DataFrame, at: Threshold) -> DataFrame:
    """(centre, salt, member, size, near): whether parities let members link to their centre, whose row comes first as in ``_starred``."""
    ordered = rows.repartition("centre", "salt").sortWithinPartitions("centre", "salt", "lead")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centre, centre_size = None, 0
        for batch in batches:
            lead, size = (batch.column(i).to_numpy(zero_copy_only=False) for i in (3, 4))
            near = np.zeros(batch.num_rows, bool)
            for i, packed in enumerate(batch.column(5)):
                own = np.frombuffer(packed.as_buffer(), np.uint64)
                if not lead[i]:
                    centre, centre_size = own.copy(), int(size[i])
                else:
                    words = min(len(own), len(centre))
                    differ = int(np.bitwise_count(_folded(own, words) ^ _folded(centre, words)).sum())
                    near[i] = at.links((centre_size + int(size[i]) - differ) // 2, centre_size, int(size[i]))
            some = pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(3)), batch.column(4), pa.array(near)], names=["centre", "salt", "member", "size", "near"])
            yield some.filter(pa.array(lead != 0))

    return ordered.select("centre", "salt", "member", "lead", "size", "parities").mapInArrow(run, "centre long, salt int, member long, size int, near boolean")


def _with_partner(sides: np.ndarray, sizes: np.ndarray, parities: list[np.ndarray], at: Threshold) -> np.ndarray:
    """Mask of the members of a cell whose parities let them link to one on the other side."""
    left, right, words, keep = sides != 1, sides != 0, np.array([len(p) for p in parities]), np.zeros(len(sizes), bool)
    for w in np.unique(words):
        short = np.flatnonzero(words == w)
        # sets over more bits that are not too large to link
        others = np.flatnonzero((words >= w) & (sizes <= at.most(int(sizes[short].max()))))
        folded = np.stack([_folded(parities[j], w) for j in others])
        for i, own in zip(short, folded[words[others] == w], strict=True):
            meets = ((left[i] & right[others]) | (right[i] & left[others])) & (others != i)
            differ = np.bitwise_count(folded ^ own).sum(axis=1, dtype=np.int64)
            meets &= at.links((sizes[i] + sizes[others] - differ) // 2, sizes[i], sizes[others])
            if meets.any():
                keep[i] = True
                keep[others[meets]] = True
    return keep


def _may_meet(members: DataFrame, at: Threshold) -> DataFrame:
    """The rows of cells, as for ``_verified``, without the members whose parities rule out all that they meet."""
    ordered = members.repartition("centre", "cell").sortWithinPartitions("centre", "cell")
    names = ["centre", "cell", "member", "side"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, rows = None, []

        def flush() -> pa.RecordBatch | None:
            keep = _with_partner(np.array([r["side"] for r in rows]), np.array([r["size"] for r in rows], np.int64), [np.frombuffer(r["parities"], np.uint64) for r in rows], at) if len(rows) > 1 else np.zeros(0, bool)
            kept = [rows[i] for i in np.flatnonzero(keep)]
            return pa.RecordBatch.from_arrays([pa.array([r[c] for r in kept], t) for c, t in zip(names, (pa.int64(), pa.string(), pa.int64(), pa.int32()), strict=True)], names=names) if kept else None

        for batch in batches:
            for r in batch.to_pylist():
                now = (r["centre"], r["cell"])
                if now != key:
                    if (made := flush()) is not None:
                        yield made
                    key, rows = now, []
                rows.append(r)
        if (made := flush()) is not None:
            yield made

    return ordered.select(*names, "size", "parities").mapInArrow(run, "centre long, cell string, member long, side int")


def _starred(rows: DataFrame, k: int, at: Threshold) -> DataFrame:
    """(centre, member, size, linked): members against their centre, whose row (``lead`` 0) comes first in each ``(centre, salt)``; nothing but the centre's set is held."""
    ordered = rows.repartition("centre", "salt").sortWithinPartitions("centre", "salt", "lead")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centre = np.zeros(0, np.uint64)
        for batch in batches:
            lead, out, at_row = batch.column(batch.schema.get_field_index("lead")).to_numpy(zero_copy_only=False), [], 0
            for part, sets in _sets(batch, k):
                for d, own in enumerate(sets):
                    if not lead[at_row + d]:
                        centre = own
                    else:
                        common = int((centre[np.minimum(np.searchsorted(centre, own), len(centre) - 1)] == own).sum())
                        out.append((at_row + d, len(own), bool(at.links(common, len(centre), len(own)))))
                at_row += len(sets)
            some = batch.take(pa.array([o[0] for o in out], pa.int64()))
            yield pa.RecordBatch.from_arrays([some.column(0), some.column(1), pa.array([o[1] for o in out], pa.int32()), pa.array([o[2] for o in out], pa.bool_())], names=["centre", "member", "size", "linked"])

    return ordered.select("centre", "member", "lead", "text").mapInArrow(run, "centre long, member long, size int, linked boolean")


def _verified(members: DataFrame, k: int, at: Threshold) -> DataFrame:
    """Links between the two sides of each ``cell`` of a neighbourhood (side 2 is on both), whose members come with their texts, streamed in order of the key."""
    ordered = members.repartition("centre", "cell").sortWithinPartitions("centre", "cell")

    def links(ids: list[int], sides: list[int], texts: list[str]) -> tuple[list[int], list[int]]:
        words = words_of(pa.array(texts), lower=True)
        sets = [shingle_set(words.hash[words.of(d)], k) for d in range(len(words))]
        side = np.array(sides)
        left, right = side != 1, side != 0
        return _local_links(ids, sets, left, right, at) if left.any() and right.any() else ([], [])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, ids, sides, texts = None, [], [], []

        def flush() -> pa.RecordBatch | None:
            if len(ids) > 1:
                us, vs = links(ids, sides, texts)
                if us:
                    return pa.RecordBatch.from_arrays([pa.array(us, pa.int64()), pa.array(vs, pa.int64())], names=["u", "v"])
            return None

        for batch in batches:
            for r in batch.to_pylist():
                now = (r["centre"], r["cell"])
                if now != key:
                    if (made := flush()) is not None:
                        yield made
                    key, ids, sides, texts = now, [], [], []
                ids.append(r["member"])
                sides.append(r["side"])
                texts.append(r["text"])
        if (made := flush()) is not None:
            yield made

    return ordered.select("centre", "cell", "member", "side", "text").mapInArrow(run, "u long, v long")


def _open_cells(stars: DataFrame, at: Threshold, scratch: Scratch) -> DataFrame:
    """(centre, cell, member, side): pairs that the centres leave open.  Members linked to one centre are connected, so only a member that is not meets all others: in one cell, or in large neighbourhoods in pairs of blocks of neighbouring size classes."""
    around = stars.groupBy("centre").agg(F.count(F.lit(1)).alias("size_"), F.count_if(~F.col("linked")).alias("apart")).filter("apart > 0 and size_ > 1").select("centre", "size_")
    some = join_checked(stars, scratch.save(around), "centre", "inner", BROADCAST_ROWS)
    few = some.filter(F.col("size_") <= BLOCK).select("centre", F.lit("").alias("cell"), "member", F.when(F.col("linked"), 1).otherwise(2).alias("side"))
    many = scratch.save(some.filter(F.col("size_") > BLOCK).withColumn("class", _size_class(F.col("size"), at)))
    half = BLOCK // 2
    groups = many.groupBy("centre", "class", "linked").agg(F.ceil(F.count(F.lit(1)) / half).cast("int").alias("blocks"))
    placed = join_checked(many, scratch.save(groups), ["centre", "class", "linked"], "inner", BROADCAST_ROWS).withColumn("b", F.pmod(F.xxhash64("member"), F.col("blocks")).cast("int")).select("centre", "member", "class", "linked", "b")
    block = groups.select("centre", "class", "linked", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("b"))
    name = lambda c: F.concat_ws(":", F.col(f"{c}class").cast("string"), F.col(f"{c}linked").cast("string"), F.col(f"{c}b").cast("string"))
    other = block.select("centre", *(F.col(c).alias(f"o_{c}") for c in ("class", "linked", "b")))
    pairs = block.filter("not linked").join(other, "centre").filter(F.abs(F.col("class") - F.col("o_class")) <= 1).withColumn("x", name("")).withColumn("y", name("o_"))
    # each pair of blocks of unlinked members once
    pairs = scratch.save(pairs.filter(F.col("o_linked") | (F.col("x") <= F.col("y"))).select("centre", "x", "y", F.concat_ws("|", "x", "y").alias("cell")))
    ends = pairs.select("centre", F.col("x").alias("block"), "cell", F.when(F.col("x") == F.col("y"), 2).otherwise(0).alias("side"))
    ends = ends.unionByName(pairs.filter("x <> y").select("centre", F.col("y").alias("block"), "cell", F.lit(1).alias("side")))
    cut = placed.withColumn("block", name("")).join(ends, ["centre", "block"]).select("centre", "cell", "member", "side")
    return few.unionByName(cut)


def _linked(docs: DataFrame, k: int, at: Threshold, scratch: Scratch) -> DataFrame:
    """(uid, doc_id, n, component, first) for every row of the written ``docs(uid, doc_id, text)``; of rows with a link or copies, ``first`` is the uid of the row with the smallest doc_id in their component."""
    spark = docs.sparkSession
    summaries = scratch.save(_summaries(docs, k))
    own = summaries.filter("row is null").select("uid", "doc_id", "digest", "n")
    counts = _cell_counts(summaries.filter("row is not null").select("row", "counts"))
    cells = spark.sparkContext.broadcast(counts)
    sizes = {r["n"]: r["c"] for r in own.filter(f"n > 0 and n <= {at.most(at.most(MOST_SMALL)) + 1}").groupBy("n").agg(F.count(F.lit(1)).alias("c")).collect()}
    small = boundary(sizes, at)
    spokes = scratch.save(_spokes(_postings(docs, k, at, small, cells, HEAVY), at, scratch))
    exact = spokes.filter("exact").select(F.col("centre").alias("u"), F.col("member").alias("v"))
    open_ = spokes.filter("not exact").select("centre", "member")
    wanted = scratch.save(open_.select(F.explode(F.array("centre", "member")).alias("digest")).distinct())
    # copies are folded before anything is dealt by digest: one text may hold a third of all rows
    of_classes = summaries.filter("digest is not null").groupBy("digest").agg(F.min("uid").alias("uid"), F.max("n").cast("int").alias("size"), F.max("parities").alias("parities"))
    classes_wanted = scratch.save(of_classes.join(wanted, "digest", "left_semi").withColumnRenamed("digest", "member"))
    chosen, sketches = classes_wanted.select("member", "uid"), classes_wanted.select("member", "size", "parities")

    def with_texts(rows: DataFrame) -> DataFrame:
        """Rows with the text of their member; a text is only moved to where it is compared."""
        placed = scratch.save(rows.join(chosen, "member"))
        return docs.select("uid", "text").join(F.broadcast(placed) if small_enough(placed, BROADCAST_ROWS) else placed, "uid")

    # members against their centre first, large neighbourhoods in several tasks
    around = open_.groupBy("centre").agg(F.count(F.lit(1)).alias("size")).select("centre", F.ceil(F.col("size") / BLOCK).cast("int").alias("salts"))
    salted = join_checked(open_, scratch.save(around.filter("salts > 1")), "centre", "left", BROADCAST_ROWS)
    salted = salted.select("centre", F.pmod(F.xxhash64("member"), F.coalesce("salts", F.lit(1))).cast("int").alias("salt"), "member", F.lit(1).alias("lead"))
    led = lambda rows: rows.unionByName(rows.select("centre", "salt").distinct().select("centre", "salt", F.col("centre").alias("member"), F.lit(0).alias("lead")))
    near = scratch.save(_near(led(salted).join(sketches, "member"), at))
    to_verify = near.filter("near").select("centre", "salt", "member", F.lit(1).alias("lead"))
    starred = _starred(with_texts(led(to_verify)).select("centre", "salt", "member", "lead", "text"), k, at)
    stars = scratch.save(starred.unionByName(near.filter("not near").select("centre", "member", "size", F.lit(False).alias("linked"))))
    cells_left = scratch.save(_may_meet(_open_cells(stars, at, scratch).join(sketches, "member"), at))
    found = _verified(with_texts(cells_left).select("centre", "cell", "member", "side", "text"), k, at)
    edges = scratch.save(exact.unionByName(stars.filter("linked").select(F.col("centre").alias("u"), F.col("member").alias("v"))).unionByName(found).distinct())
    roots = connected_components(edges, scratch)
    classes = own.filter("digest is not null").groupBy("digest").agg(F.min(F.struct(F.isnull("doc_id").alias("none"), "doc_id", "uid")).alias("low"), F.count(F.lit(1)).alias("copies"))
    classes = classes.join(roots.withColumnRenamed("node", "digest"), "digest", "left").filter("copies > 1 or root is not null").withColumn("root", F.coalesce("root", "digest"))
    classes = scratch.save(classes.select("digest", "root", "low", "copies"))
    lowest = scratch.save(classes.groupBy("root").agg(F.min("low").alias("low")).select("root", F.col("low.doc_id").alias("component"), F.col("low.uid").alias("first")))
    named = scratch.save(classes.select("digest", "root", "copies").join(lowest, "root").select("digest", "component", "first", "copies"))
    # fewer than MOST_OFTEN texts can hold over 1 / MOST_OFTEN of the rows each: they are broadcast, so that no task gets all copies of one
    often = F.col("copies") * MOST_OFTEN > own.count()
    heavy_texts, other_texts = named.filter(often).drop("copies"), named.filter(~often).drop("copies")
    out = own.join(F.broadcast(heavy_texts), "digest").unionByName(
        own.filter("digest is not null").join(F.broadcast(heavy_texts), "digest", "left_anti").join(other_texts, "digest", "left")
    ).unionByName(own.filter("digest is null").withColumn("component", F.lit(None).cast("long")).withColumn("first", F.lit(None).cast("long")))
    return out.select("uid", "doc_id", "n", "component", "first")


def link_components(docs: DataFrame, k: int = 5, at: Threshold | None = None, scratch: Scratch | None = None) -> DataFrame:
    """(doc_id, n_shingles, component_id) for every row of ``docs(doc_id, text)``."""
    scratch = scratch or Scratch(docs.sparkSession)
    keyed = scratch.save(docs.select(F.monotonically_increasing_id().alias("uid"), F.col("doc_id").cast("long").alias("doc_id"), "text"))
    out = _linked(keyed, k, at or Threshold(), scratch)
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id"))


def one_of_each_group(docs: DataFrame, k: int = 5, at: Threshold | None = None) -> DataFrame:
    """One row of each component of ``docs``, that with the smallest doc_id (and all rows without shingles); of repeated rows, one stays."""
    scratch, key = Scratch(docs.sparkSession), column_name(docs, "row_key")
    keyed = scratch.save(docs.withColumn(key, F.monotonically_increasing_id()))
    rows = _linked(keyed.select(F.col(key).alias("uid"), F.col("doc_id").cast("long").alias("doc_id"), "text"), k, at or Threshold(), scratch)
    gone = scratch.save(rows.filter("uid <> first").select(F.col("uid").alias(key)))
    return keyed.join(F.broadcast(gone) if small_enough(gone, BROADCAST_ROWS) else gone, key, "left_anti").select(*docs.columns)
