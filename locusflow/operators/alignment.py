"""Operators on alignment blocks and per-species alignments.

Two steps choose greedily in order and cannot be a set expression: chaining fragments
reads blocks as a sorted stream, netting alignments reads islands of overlapping chains as
one; everything else is column work.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .scans import sorted_stream


def gap_blocks(rows: DataFrame, reference: str) -> DataFrame:
    """Cuts every block where the reference row has gaps: one sub-block for each run of reference bases, with starts and sizes computed anew; rows without bases go."""
    runs = rows.filter(F.col("species") == reference).select("block", F.posexplode(F.split("seq", "")).alias("at", "c")).filter("c <> ''")
    w = Window.partitionBy("block").orderBy("at")
    runs = runs.withColumn("solid", F.col("c") != "-").withColumn("new", F.when(F.col("solid") & ~F.coalesce(F.lag("solid").over(w), F.lit(False)), 1).otherwise(0))
    runs = runs.withColumn("part", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0))).filter("solid").groupBy("block", "part").agg(F.min("at").alias("low"), F.count(F.lit(1)).cast("int").alias("width"))
    cut = rows.join(runs, "block").withColumn("own", F.substr("seq", F.col("low") + 1, F.col("width")))
    bases = lambda c: F.length(F.replace(c, F.lit("-"), F.lit(""))).cast("long")
    size, before = bases(F.col("own")), bases(F.substr("seq", F.lit(1), F.col("low")))
    # on the other strand the row runs down the contig
    start = F.when(F.col("strand") == "-", F.col("start") + F.col("size") - before - size).otherwise(F.col("start") + before)
    return cut.select("block", "part", "row", "species", "contig", start.alias("start"), size.alias("size"), "strand", "contig_length", F.col("own").alias("seq")).filter("size > 0")


def chain_fragments(rows: DataFrame, key: str, most_gap: int = 50) -> DataFrame:
    """Rows (key, block, row, width, species, contig, start, size, strand, seq) of alignments as chains (key, species, chain, seq, contig, strand, start, end).

    In each block fragments go on chains of their species, contig and strand that end less
    than ``most_gap`` before them: of all such pairs the smallest gap first (then the earlier
    row, then the earlier chain).  A fragment left over opens a chain that is padded with
    gaps on the left; chains without a fragment in a block get gaps of the block's width.

    Blocks are read as a sorted stream: one block's rows and the ends of the alignment's
    chains are all that is held.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, offset, made, rest = None, 0, 0, None
        chains: dict[tuple, list[list]] = {}

        def placed_rows(rows: pa.RecordBatch) -> pa.RecordBatch:
            """Whole blocks with each row's chain and its block's offset; sequences are passed on and not looked at."""
            nonlocal group, offset, made, chains
            keys, blocks, widths, *lane, starts, sizes = (rows.column(c).to_pylist() for c in (key, "block", "width", "species", "contig", "strand", "start", "size"))
            lane = list(zip(*lane, strict=True))
            chain, offsets, n, first = [-1] * len(keys), [0] * len(keys), len(keys), 0
            while first < n:
                stop = first + 1
                while stop < n and keys[stop] == keys[first] and blocks[stop] == blocks[first]:
                    stop += 1
                if keys[first] != group:
                    group, offset, made, chains = keys[first], 0, 0, {}
                own: dict[tuple, list[tuple[int, int]]] = {}  # (row, start in the strand's direction)
                for i in range(first, stop):
                    offsets[i] = offset
                    own.setdefault(lane[i], []).append((i, starts[i] if lane[i][2] != "-" else -(starts[i] + sizes[i])))
                for at, some in own.items():
                    known = chains.setdefault(at, [])  # [chain, far end in the strand's direction]
                    gaps, used = sorted((reach - c[1], i, j) for i, reach in some for j, c in enumerate(known) if 0 <= reach - c[1] < most_gap), set()
                    for gap, i, j in gaps:
                        if chain[i] < 0 and j not in used:
                            chain[i] = known[j][0]
                            known[j][1] += gap + sizes[i]
                            used.add(j)
                for i in range(first, stop):
                    if chain[i] < 0:
                        chain[i] = made
                        chains[lane[i]].append([made, (starts[i] if lane[i][2] != "-" else -(starts[i] + sizes[i])) + sizes[i]])
                        made += 1
                offset += widths[first]
                first = stop
            return pa.RecordBatch.from_arrays([*(rows.column(c) for c in kept), pa.array(chain, pa.int64()), pa.array(offsets, pa.int64())], names=[*kept, "chain", "offset"])

        for batch in batches:
            if not batch.num_rows:
                continue
            rows = batch if rest is None else pa.concat_batches([rest, batch])
            # the last block may go on in the next batch
            last = [rows.column(c)[-1].as_py() for c in (key, "block")]
            open_ = rows.num_rows - 1
            while open_ > 0 and [rows.column(c)[open_ - 1].as_py() for c in (key, "block")] == last:
                open_ -= 1
            if open_:
                yield placed_rows(rows.slice(0, open_))
            rest = rows.slice(open_)
        if rest is not None:
            yield placed_rows(rest)

    kind = rows.schema[key].dataType.simpleString()
    kept = [key, "species", "contig", "strand", "start", "size", "width", "seq"]
    slim = rows.select(key, F.col("block").cast("long"), "row", F.col("width").cast("int"), "species", "contig", F.col("start").cast("long"), F.col("size").cast("long"), "strand", "seq")
    sorted_ = slim.repartition(key).sortWithinPartitions(key, "block", "row")
    placed = sorted_.mapInArrow(run, f"{key} {kind}, species string, contig string, strand string, start long, size long, width int, seq string, chain long, offset long").withColumn("end", F.col("start") + F.col("size"))
    # a window and a grouping over one dealing of the rows: the stream runs once
    placed = placed.withColumn("_whole", F.max(F.col("offset") + F.col("width")).over(Window.partitionBy(key)))
    parts = F.array_sort(F.collect_list(F.struct("offset", "width", "seq")))
    chains = placed.groupBy(key, "species", "chain", "contig", "strand").agg(parts.alias("_p"), F.min("start").alias("start"), F.max("end").alias("end"), F.first("_whole").alias("_whole"))
    gaps = lambda n: F.repeat(F.lit("-"), n.cast("int"))
    ends = lambda p: p["offset"] + p["width"]
    filled = F.transform("_p", lambda p, i: F.concat(gaps(p["offset"] - F.when(i > 0, ends(F.get("_p", i - 1))).otherwise(0)), p["seq"]))
    seq = F.concat(F.array_join(filled, ""), gaps(F.col("_whole") - ends(F.element_at("_p", -1))))
    return chains.select(key, "species", "chain", seq.alias("seq"), "contig", "strand", "start", "end")


def with_reference_distance(chains: DataFrame, key: str, reference: str) -> DataFrame:
    """Chains with their distance to the reference row (columns that differ, ignoring case; an error where lengths differ), and its rank within the species."""
    ref = chains.filter((F.col("species") == reference) & (F.col("chain") == 0)).select(key, F.upper("seq").alias("_ref"))
    differ = F.when(F.length("seq") != F.length("_ref"), F.raise_error(F.lit("rows of different lengths")).cast("int")).otherwise(
        F.size(F.filter(F.zip_with(F.split(F.upper("seq"), ""), F.split("_ref", ""), lambda x, y: x != y), lambda d: d))
    )
    return chains.join(ref, key).withColumn("distance", differ).withColumn("rank", F.row_number().over(Window.partitionBy(key, "species").orderBy("distance", "contig", "chain"))).drop("_ref")


def net_chains(ranked: DataFrame, key: str) -> DataFrame:
    """One row for each species: at every column the base of the best-ranked chain that has one there, else a gap.

    A chain that overlaps a better one of its contig is left out, so that no base of the genome is used twice.
    """
    bases = exclude_overlaps(ranked, [key, "species", "contig"], ["rank"]).select(key, "species", "rank", F.posexplode(F.split("seq", "")).alias("at", "base")).filter("base <> ''")
    best = bases.groupBy(key, "species", "at").agg(F.coalesce(F.min_by(F.when(F.col("base") != "-", F.col("base")), F.when(F.col("base") != "-", F.col("rank"))), F.lit("-")).alias("base"))
    return best.groupBy(key, "species").agg(F.concat_ws("", F.transform(F.array_sort(F.collect_list(F.struct("at", "base"))), lambda x: x["base"])).alias("seq"))


def exclude_overlaps(intervals: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Intervals (start, end) of each key in an order of preference; those that overlap one already kept are dropped.

    Only an interval's two neighbours among the kept ones can overlap it, so each costs one search.  Islands of
    overlapping intervals are groups of their own, read as one sorted stream: only the kept intervals' ends are held.
    """
    from .intervals import with_island

    shape = with_island(intervals, keys)

    def keep(rows: Iterator[dict]) -> Iterator[dict]:
        group, starts, ends = None, [], []
        for row in rows:
            if row["group"] != group:
                group, starts, ends = row["group"], [], []
            at = bisect_left(starts, row["start"])
            if (at == 0 or ends[at - 1] <= row["start"]) and (at == len(starts) or row["end"] <= starts[at]):
                starts.insert(at, row["start"])
                ends.insert(at, row["end"])
                yield row

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in shape.schema)
    return sorted_stream(shape, [*keys, "island"], order, keep, schema).drop("island")


def pinned_first(df: DataFrame, is_first, *order) -> DataFrame:
    """Sorted, but for one row that stays on top."""
    return df.orderBy(F.when(is_first, 0).otherwise(1), *order)


def frequencies_of_alignment(rows: DataFrame, key: str, reference: str, most_gap: int = 50) -> DataFrame:
    """Alignment blocks to base counts and shares of each column: chained, ranked by distance to the reference, netted to one row a species, strangers as gaps, counted."""
    from ..functions.sequence import gap_strangers
    from .kmers import column_counts

    ranked = with_reference_distance(chain_fragments(rows, key, most_gap), key, reference)
    return column_counts(net_chains(ranked, key).withColumn("seq", gap_strangers("seq")), key, "seq")


def stops_like_reference(rows: DataFrame, key: str, reference: str) -> DataFrame:
    """Rows (key, species, seq, strand) of three bases with ``is_stop``, and ``like_reference``: equal, ignoring case, to the key's reference row."""
    ref = rows.filter(F.col("species") == reference).select(key, F.upper("seq").alias("_ref"))
    return rows.join(ref, key, "left").withColumn("is_stop", stop_codon(F.col("seq"), F.col("strand"))).withColumn("like_reference", F.coalesce(F.upper("seq") == F.col("_ref"), F.lit(False))).drop("_ref")


def regions_of_species(rows: DataFrame, genes: DataFrame, key: str, reference: str) -> DataFrame:
    """Where the region behind an anchor (the stop codon's alignment, a few blocks) lies in each species: (key, species, contig, start, end, strand).

    ``rows(key, block, species, contig, start, size, strand, contig_length, seq)`` have starts
    on their own strand, ``genes(key, gene_strand, length)`` the region's strand and length.
    Blocks are put together while a row starts where the one before ended; contigs that the
    first block lacks go.  Anchors whose reference row is no stop codon give nothing, species whose
    row differs from it are left out, regions end at the contig's ends.
    """
    from .ordered import contiguous_chain

    lane = [key, "species", "contig"]
    first = Window.partitionBy(key)
    known = rows.withColumn("_first", F.min("block").over(first)).withColumn("_opens", F.min("block").over(Window.partitionBy(*lane))).filter("_first = _opens").drop("_first", "_opens")
    chained = contiguous_chain(known, lane, "start", "size")
    whole = chained.groupBy(*lane).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block", "seq"))), lambda x: x["seq"]), "").alias("seq"),
        F.max(F.col("start") + F.col("size")).alias("next"), F.first("strand").alias("strand"), F.first("contig_length").alias("contig_length"),
    ).join(genes, key)
    ref = whole.filter((F.col("species") == reference) & stop_codon(F.col("seq"), F.col("gene_strand"))).select(key, F.upper("seq").alias("_ref"))
    same = whole.join(ref, key).filter(F.upper("seq") == F.col("_ref"))
    forward, plus = F.col("gene_strand") == "+", F.col("strand") == "+"
    behind = F.when(plus, F.col("next")).otherwise(F.col("contig_length") - F.col("next"))  # where the anchor ends, on the contig
    inner = F.when(forward, behind).when(plus, behind - 3).otherwise(behind + 3)
    grows = forward == plus
    start = F.when(grows, inner).otherwise(F.greatest(inner - F.col("length"), F.lit(0)))
    end = F.when(grows, F.least(inner + F.col("length"), F.col("contig_length"))).otherwise(inner)
    return same.select(*lane, start.alias("start"), end.alias("end"), "strand")


def stop_codon(seq, strand) -> object:
    """Whether three bases are a stop codon as read on the strand."""
    up = F.upper(seq)
    return F.when(strand == "-", up.isin("TTA", "CTA", "TCA")).otherwise(up.isin("TAA", "TAG", "TGA"))
