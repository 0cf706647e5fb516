"""Interval operators: half-open intervals ``[start, end)`` on a contig.

Range conditions become equi-joins on (contig, bin): each interval is listed once
for every bin it touches, and a pair is kept only in the first bin that both
touch, so nothing has to be made distinct afterwards.  Choose ``bin_size`` near
the usual interval length; contigs with most of the rows are spread over bins.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scans import SPAN, numbered_islands, running


def _bin(x: Column, size: int) -> Column:
    return F.floor(x / F.lit(size)).cast("long")


def _binned(df: DataFrame, start: str, end: str, size: int, tag: str) -> DataFrame:
    """A row for each bin that an interval touches; empty intervals touch none."""
    first, last = _bin(F.col(start), size), _bin(F.col(end) - 1, size)
    return df.filter(F.col(start) < F.col(end)).withColumn(f"{tag}_first", first).withColumn("bin", F.explode(F.sequence(first, last)))


#: Bins of one level in one of the next, and so about the most bins that an interval is listed in.
LEVEL_BINS = 64


def _levelled(df: DataFrame, start: str, end: str, size: int, tag: str, levels: int) -> DataFrame:
    """A row for each (level, bin): an interval's own level is the first at which it touches ``LEVEL_BINS`` bins at most (the last, if none is); it is listed there and at all coarser levels."""
    a, b = F.col(start), F.col(end)
    width = [size * LEVEL_BINS**i for i in range(levels)]
    own = F.lit(levels - 1)
    for i in range(levels - 2, -1, -1):
        own = F.when(b - a <= width[i] * (LEVEL_BINS - 1), i).otherwise(own)
    none = F.array().cast("array<struct<level:int,bin:bigint>>")

    def at(i: int, w: int) -> Column:
        bins = F.transform(F.sequence(_bin(a, w), _bin(b - 1, w)), lambda x: F.struct(F.lit(i).alias("level"), x.alias("bin")))
        return F.when(own <= i, bins).otherwise(none)

    listed = [at(i, w) for i, w in enumerate(width)]
    return df.filter(a < b).withColumn(f"{tag}_level", own).withColumn("_x", F.explode(F.flatten(F.array(*listed)))).withColumn("level", F.col("_x.level")).withColumn("bin", F.col("_x.bin")).drop("_x")


def _prefixed(df: DataFrame, prefix: str, keys: Sequence[str]) -> DataFrame:
    return df.select(*(F.col(c).alias(c if c in keys else prefix + c) for c in df.columns))


def overlap_join(left: DataFrame, right: DataFrame, keys: Sequence[str] = ("contig",), bin_size: int = 4096, how: str = "inner", min_overlap: int = 1, levels: int = 1) -> DataFrame:
    """All pairs of overlapping intervals (columns l_*, r_*, overlap).  ``how``: inner, or left_semi for the left rows alone.

    Add the strand to ``keys`` for a strand-aware join.  With ``levels``, bins grow by
    ``LEVEL_BINS`` from level to level and a pair meets at the coarser level of its two, so that
    an interval as long as a contig is listed in a few dozen bins, not in all of them.
    """
    overlap = F.least("l_end", "r_end") - F.greatest("l_start", "r_start")
    if levels == 1:
        a = _binned(_prefixed(left, "l_", keys), "l_start", "l_end", bin_size, "l")
        b = _binned(_prefixed(right, "r_", keys), "r_start", "r_end", bin_size, "r")
        on = [a[k] == b[k] for k in keys] + [a["bin"] == b["bin"], a["bin"] == F.greatest("l_first", "r_first"), overlap >= min_overlap]
    else:
        a = _levelled(_prefixed(left, "l_", keys), "l_start", "l_end", bin_size, "l", levels)
        b = _levelled(_prefixed(right, "r_", keys), "r_start", "r_end", bin_size, "r", levels)
        width = F.element_at(F.array(*(F.lit(bin_size * LEVEL_BINS**i).cast("long") for i in range(levels))), a["level"] + 1)
        both = F.floor(F.greatest("l_start", "r_start") / width)  # the first bin that both touch
        on = [a[k] == b[k] for k in keys] + [a["level"] == b["level"], a["bin"] == b["bin"], a["level"] == F.greatest("l_level", "r_level"), a["bin"] == both, overlap >= min_overlap]
    condition = on[0]
    for c in on[1:]:
        condition = condition & c
    if how == "left_semi":
        return a.join(b, condition, "left_semi").select(*(F.col(c if c in keys else "l_" + c).alias(c) for c in left.columns))
    joined = a.join(b, condition, "inner")
    made = {"l_first", "r_first", "l_level", "r_level"}
    return joined.select(*(a[k] for k in keys), *(a[c] for c in a.columns if c.startswith("l_") and c not in made), *(b[c] for c in b.columns if c.startswith("r_") and c not in made), overlap.alias("overlap"))


def point_join(points: DataFrame, intervals: DataFrame, keys: Sequence[str] = ("contig",), bin_size: int = 4096, how: str = "inner") -> DataFrame:
    """Points (column pos) with every interval that holds them.  ``how``: inner, left, left_semi or left_anti."""
    p = points.withColumn("bin", _bin(F.col("pos"), bin_size))
    i = _binned(_prefixed(intervals, "r_", keys), "r_start", "r_end", bin_size, "r").drop("r_first")
    condition = (p["bin"] == i["bin"]) & (F.col("pos") >= F.col("r_start")) & (F.col("pos") < F.col("r_end"))
    for k in keys:
        condition = condition & (p[k] == i[k])
    joined = p.join(i, condition, how)
    kept = [p[c] for c in points.columns]
    return joined.select(*kept) if how in ("left_semi", "left_anti") else joined.select(*kept, *(i[c] for c in i.columns if c.startswith("r_")))


def containment_join(inner: DataFrame, outer: DataFrame, keys: Sequence[str] = ("contig",), bin_size: int = 4096) -> DataFrame:
    """Pairs in which the left interval lies fully inside the right one."""
    return overlap_join(inner, outer, keys, bin_size).filter("l_start >= r_start and l_end <= r_end")


def last_start_containment(queries: DataFrame, regions: DataFrame, keys: Sequence[str] = ("contig",), span: int = SPAN) -> DataFrame:
    """Each query with the last region (by start, then name) that starts at or before it, if that region also reaches its end."""
    region = F.struct(*(F.col(c) for c in regions.columns if c not in keys))
    a = regions.select(*keys, F.col("start").alias("at"), F.lit(0).alias("side"), F.col("name").alias("tie"), region.alias("region"), F.lit(None).cast(queries.schema.simpleString()).alias("query"))
    b = queries.select(*keys, F.col("start").alias("at"), F.lit(1).alias("side"), F.lit(None).cast("string").alias("tie"), F.lit(None).cast(a.schema["region"].dataType).alias("region"), F.struct(*queries.columns).alias("query"))
    found = running(a.unionByName(b), keys, "at", ["at", "side", "tie"], {"last": ("last", F.col("region"))}, span=span).filter("side = 1 and last.end >= query.end")
    return found.select("query.*", *(F.col(f"last.{c}").alias(f"r_{c}") for c in regions.columns if c not in keys))


def merge_intervals(df: DataFrame, keys: Sequence[str] = ("contig",), min_gap: int = 0, span: int = SPAN) -> DataFrame:
    """Overlapping intervals as one (touching ones too, unless ``min_gap`` is negative: then an overlap of that size is needed).

    Intervals of one start are one row before anything is ordered, so a bin has at most ``span`` rows (not so for a negative ``min_gap``).
    """
    plain = df.select(*keys, "start", "end")
    if min_gap >= 0:
        rows = plain.groupBy(*keys, "start").agg(F.max("end").alias("end"), F.count(F.lit(1)).alias("members"))
    else:
        rows = plain.withColumn("members", F.lit(1).cast("long"))
    return numbered_islands(rows, keys, min_gap, span).groupBy(*keys, "island").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.sum("members").alias("members")).drop("island")


def with_island(df: DataFrame, keys: Sequence[str] = ("contig",), min_gap: int = -1, span: int = SPAN) -> DataFrame:
    """Every interval with the number of its cluster on the contig (positive overlap needed by default)."""
    return numbered_islands(df, keys, min_gap, span)


def subtract_intervals(regions: DataFrame, blockers: DataFrame, keys: Sequence[str] = ("contig",), bin_size: int = 4096) -> DataFrame:
    """What is left of ``regions(name, start, end)`` outside all blockers; the strand plays no part unless it is a key."""
    hits = overlap_join(regions, merge_intervals(blockers, keys), keys, bin_size)
    whole = Window.partitionBy(*keys, "l_name", "l_start", "l_end").orderBy("r_start")
    left = F.coalesce(F.lag("r_end").over(whole), F.col("l_start"))
    inner = hits.select(*keys, F.col("l_name").alias("name"), left.alias("start"), F.col("r_start").alias("end"))
    tail = hits.groupBy(*keys, "l_name", "l_start", "l_end").agg(F.max("r_end").alias("start")).select(*keys, F.col("l_name").alias("name"), "start", F.col("l_end").alias("end"))
    free = regions.join(hits.select(*keys, F.col("l_name").alias("name"), F.col("l_start").alias("start"), F.col("l_end").alias("end")).distinct(), [*keys, "name", "start", "end"], "left_anti")
    return inner.unionByName(tail).filter("start < end").unionByName(free.select(*keys, "name", "start", "end"))


def with_contained_flag(points: DataFrame, intervals: DataFrame, keys: Sequence[str] = ("contig",), bin_size: int = 4096, flag: str = "inside") -> DataFrame:
    """Points with a flag for being in any interval; the intervals are merged first, so no point meets two of them."""
    merged = merge_intervals(intervals, keys).drop("members")
    return point_join(points, merged, keys, bin_size, "left").withColumn(flag, F.col("r_start").isNotNull()).drop("r_start", "r_end")


def annotate(points: DataFrame, regions: DataFrame, keys: Sequence[str] = ("contig",), bin_size: int = 4096, id_column: str = "point_id") -> DataFrame:
    """Points with the sorted names of all regions that hold them (an empty list if none does)."""
    names = point_join(points, regions, keys, bin_size).groupBy(id_column).agg(F.sort_array(F.collect_set("r_name")).alias("regions"))
    return points.join(names, id_column, "left").withColumn("regions", F.coalesce("regions", F.array().cast("array<string>")))


#: Categories that get a column each while neighbours are counted.
MOST_CATEGORIES = 1000


def neighbour_counts(points: DataFrame, width: int, category: str, keys: Sequence[str] = ("contig",), span: int = SPAN) -> DataFrame:
    """For each point and each category that its contig has, how many other points of the category lie less than ``width`` away (0 where none does).

    Differences of running counts at both ends of a point's surroundings: the work follows
    the number of different places, not the pairs of neighbours.  Positions are whole numbers.
    """
    names = sorted(r[0] for r in points.select(category).filter(F.col(category).isNotNull()).distinct().limit(MOST_CATEGORIES + 1).collect())
    if len(names) > MOST_CATEGORIES:
        raise ValueError(f"more than {MOST_CATEGORIES} categories")
    ns = [f"n{i}" for i in range(len(names))]
    places = points.groupBy(*keys, "pos").agg(*(F.count_if(F.col(category) == c).alias(n) for c, n in zip(names, ns, strict=True)))
    event = lambda at, side, sign, counts: F.struct(at.alias("at"), F.lit(side).alias("side"), F.lit(sign).alias("sign"), *(c.alias(n) for n, c in zip(ns, counts, strict=True)))
    none = [F.lit(0).cast("long")] * len(ns)
    pos = F.col("pos")
    events = places.select(*keys, "pos", F.explode(F.array(event(pos, 0, 0, map(F.col, ns)), event(pos + (width - 1), 1, 1, none), event(pos - width, 1, -1, none))).alias("e")).select(*keys, "pos", "e.*")
    counted = running(events, keys, "at", ["at", "side"], {f"s{i}": ("sum", F.col(n)) for i, n in enumerate(ns)}, span=span).filter("side = 1")
    near = counted.groupBy(*keys, "pos").agg(*(F.sum(F.col("sign") * F.col(f"s{i}")).alias(f"near{i}") for i in range(len(ns))))
    whole = places.groupBy(*keys).agg(*(F.sum(n).alias(f"all{i}") for i, n in enumerate(ns)))
    found = points.select("point_id", *keys, "pos", category).join(near, [*keys, "pos"]).join(whole, list(keys))
    each = F.array(*(F.when(F.col(f"all{i}") > 0, F.struct(F.lit(c).alias("near_category"), (F.col(f"near{i}") - F.when(F.col(category) == c, 1).otherwise(0)).alias("neighbours"))) for i, c in enumerate(names)))
    return found.select("point_id", F.explode(F.filter(each, lambda x: x.isNotNull())).alias("x")).select("point_id", "x.*")


def flanking(queries: DataFrame, candidates: DataFrame, k: int, radius: int, keys: Sequence[str] = ("contig",), span: int = SPAN) -> DataFrame:
    """Ids of the k nearest candidates on each side within a radius (same positions left out), nearest first (the smaller id among equals), missing ones -1.

    Candidates are numbered along the contig, a query gets the number of the last one before
    it and looks up the k numbers next to it, so a dense place costs no pairs.
    """
    def side(name: str, toward: int) -> DataFrame:
        # on the left nearest first means from the end: equal positions are numbered with the smallest id last
        place = F.col("pos") * -toward
        c = candidates.select(*keys, place.alias("at"), F.lit(1).alias("query"), (-F.col("point_id")).alias("id"), "pos", F.col("point_id").alias("other"))
        q = queries.select(*keys, place.alias("at"), F.lit(0).alias("query"), F.col("point_id").alias("id"), "pos", F.lit(None).cast("long").alias("other"))
        ranked = running(c.unionByName(q), keys, "at", ["at", "query", "id"], {"rank": ("sum", F.col("query"))}, span=span)
        wanted = ranked.filter("query = 0").select(*keys, F.col("id").alias("point_id"), F.col("pos").alias("own"), F.explode(F.sequence(F.lit(0), F.lit(k - 1))).alias("nth"), "rank").withColumn("rank", F.col("rank") - F.col("nth"))
        hits = wanted.join(ranked.filter("query = 1").select(*keys, "rank", "pos", "other"), [*keys, "rank"]).filter(F.abs(F.col("pos") - F.col("own")) <= radius)
        return hits.groupBy("point_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("nth", "other"))), lambda x: x["other"]).alias(name))

    full = lambda s: F.slice(F.concat(F.coalesce(s, F.array().cast("array<bigint>")), F.array_repeat(F.lit(-1).cast("long"), k)), 1, k)
    out = queries.join(side("left", -1), "point_id", "left").join(side("right", 1), "point_id", "left")
    return out.withColumn("left", full(F.col("left"))).withColumn("right", full(F.col("right")))


def neighbourhood_median(centres: DataFrame, track: DataFrame, width: int, keys: Sequence[str] = ("contig",)) -> DataFrame:
    """Median of a track's scores from width/2 before each centre to width/2 behind it, the centre left out; null where there are none."""
    half = width // 2
    windows = centres.withColumn("start", F.col("pos") - half).withColumn("end", F.col("pos") + half)
    hits = point_join(track.select(*keys, "pos", "score"), windows.select(*keys, "point_id", "start", "end", F.col("pos").alias("centre")), keys, max(width, 1)).filter("pos <> r_centre")
    medians = hits.groupBy(F.col("r_point_id").alias("point_id")).agg(F.median("score").alias("median_score"))
    return centres.join(medians, "point_id", "left")


def lift_over(intervals: DataFrame, blocks: DataFrame, bin_size: int = 4096) -> tuple[DataFrame, DataFrame]:
    """(mapped, unmapped) intervals by a table of blocks (contig, start, end, to_contig, to_start, to_strand): only intervals inside one block map."""
    hit = containment_join(intervals, blocks, ("contig",), bin_size)
    size, offset = F.col("l_end") - F.col("l_start"), F.col("l_start") - F.col("r_start")
    start = F.when(F.col("r_to_strand") == "-", F.col("r_to_start") + (F.col("r_end") - F.col("l_end"))).otherwise(F.col("r_to_start") + offset)
    mapped = hit.select(F.col("l_name").alias("name"), F.col("r_to_contig").alias("contig"), start.alias("start"), (start + size).alias("end"), F.col("r_to_strand").alias("strand"))
    return mapped, intervals.join(mapped.select("name").distinct(), "name", "left_anti")


def most_overlap(intervals: DataFrame, others: DataFrame, keys: Sequence[str] = ("contig",), bin_size: int = 4096) -> DataFrame:
    """Each interval with its largest overlap with any of the others, 0 where there is none."""
    most = overlap_join(intervals, others, keys, bin_size).groupBy(F.col("l_name").alias("name")).agg(F.max("overlap").alias("most_overlap"))
    return intervals.join(most, "name", "left").withColumn("most_overlap", F.coalesce("most_overlap", F.lit(0)))


def group_overlaps(df: DataFrame, keys: Sequence[str], bin_size: int = 4096) -> DataFrame:
    """All pairs of different rows of one group that overlap, each pair once."""
    return overlap_join(df, df, keys, bin_size).filter("l_name < r_name")


def extend_upstream(df: DataFrame, by: int) -> DataFrame:
    """Intervals grown at their 5' end, not below 0."""
    grown = F.when(F.col("strand") == "-", F.col("start")).otherwise(F.greatest(F.col("start") - by, F.lit(0)))
    return df.withColumn("end", F.when(F.col("strand") == "-", F.col("end") + by).otherwise(F.col("end"))).withColumn("start", grown)


def clipped(start: Column, end: Column, low: Column, high: Column) -> tuple[Column, Column]:
    return F.greatest(start, low), F.least(end, high)


def relative_position(start: Column | str, end: Column | str, region_start: Column | str, region_end: Column | str, strand: Column | str) -> Column:
    """Offset from the 5' end of the region."""
    c = lambda x: F.col(x) if isinstance(x, str) else x
    return F.when(c(strand) == "-", c(region_end) - c(end)).otherwise(c(start) - c(region_start))


def end_distances(pos: str, start: str, end: str, strand: str) -> tuple[Column, Column]:
    """(distance to the 5' end, to the 3' end)."""
    low, high = F.col(pos) - F.col(start), F.col(end) - 1 - F.col(pos)
    return F.when(F.col(strand) == "-", high).otherwise(low), F.when(F.col(strand) == "-", low).otherwise(high)


def anchor_window(start: Column, end: Column, strand: Column, size: int = 3) -> Column:
    """The ``size`` bases before the 5' end of an interval, as (start, end)."""
    return F.struct(F.when(strand == "-", end).otherwise(start - size).alias("start"), F.when(strand == "-", end + size).otherwise(start).alias("end"))


def projected(anchor_start: Column, anchor_end: Column, ref_strand: Column, own_strand: Column, length: Column, contig_length: Column) -> Column:
    """Interval of a length that follows an anchor: to its right where reference and own strand agree, else to its left; clipped to the contig."""
    forward = ref_strand == own_strand
    start, end = F.when(forward, anchor_end).otherwise(anchor_start - length), F.when(forward, anchor_end + length).otherwise(anchor_start)
    zero = F.lit(0).cast("long")
    return F.struct(F.least(F.greatest(start, zero), contig_length).alias("start"), F.least(F.greatest(end, zero), contig_length).alias("end"))


def overlap_jaccard(a_start: Column, a_end: Column, b_start: Column, b_end: Column) -> Column:
    """Intersection over union of two intervals; null for two empty ones."""
    both = F.greatest(F.least(a_end, b_end) - F.greatest(a_start, b_start), F.lit(0))
    return F.try_divide(both, (a_end - a_start) + (b_end - b_start) - both)
