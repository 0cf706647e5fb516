"""Queries over intervals and positions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import intervals as iv
from .frames import HOUR, intervals, points, sql_intervals, sql_points
from .registry import query, table

A, B = sql_intervals("signup", 6), sql_intervals("purchase", 3)
P = sql_points("view", "click", "error")
_BIN = 6 * HOUR
_MERGED = """select contig, min(start) as start, max("end") as "end", count(*) as members from (
  select *, sum(opens) over (partition by contig order by start, "end" rows unbounded preceding) as island from (
    select *, case when start > max("end") over (partition by contig order by start, "end" rows between unbounded preceding and 1 preceding) then 1
      when row_number() over (partition by contig order by start, "end") = 1 then 1 else 0 end as opens from {t} t)) group by contig, island"""


@query(f'select p.point_id, p.contig, p.pos, a.name as r_name from {P} p join {A} a on p.contig = a.contig and p.pos >= a.start and p.pos < a."end"')
def point_in_interval(spark: SparkSession, folder: str) -> DataFrame:
    hits = iv.point_join(points(spark, folder, "view", "click", "error"), intervals(spark, folder, "signup", 6), bin_size=_BIN)
    return hits.select("point_id", "contig", "pos", "r_name")


@query(f'select p.point_id, coalesce(list_sort(list(distinct a.name) filter (where a.name is not null)), []) as regions from {P} p left join {A} a on p.contig = a.contig and p.pos >= a.start and p.pos < a."end" group by 1')
def annotate_regions(spark: SparkSession, folder: str) -> DataFrame:
    out = iv.annotate(points(spark, folder, "view", "click", "error"), intervals(spark, folder, "signup", 6), bin_size=_BIN)
    return out.select("point_id", "regions")


@query(f'select a.contig, a.name as l_name, b.name as r_name, least(a."end", b."end") - greatest(a.start, b.start) as overlap from {A} a join {B} b on a.contig = b.contig and a.start < b."end" and b.start < a."end"')
def interval_overlap(spark: SparkSession, folder: str) -> DataFrame:
    return iv.overlap_join(intervals(spark, folder, "signup", 6), intervals(spark, folder, "purchase", 3), bin_size=_BIN).select("contig", "l_name", "r_name", "overlap")


@query(f'select a.name as l_name, b.name as r_name, least(a."end", b."end") - greatest(a.start, b.start) as overlap from (select contig, name, start, case when name::bigint % 50 = 0 then "end" + 2000000 else "end" end as "end" from {A}) a join {B} b on a.contig = b.contig and a.start < b."end" and b.start < a."end"')
def long_interval_overlap(spark: SparkSession, folder: str) -> DataFrame:
    """Overlaps where some intervals are hundreds of times longer than the others."""
    a = intervals(spark, folder, "signup", 6).withColumn("end", F.when(F.col("name").cast("long") % 50 == 0, F.col("end") + 2000000).otherwise(F.col("end")))
    return iv.overlap_join(a, intervals(spark, folder, "purchase", 3), bin_size=HOUR, levels=3).select("l_name", "r_name", "overlap")


@query(
    f"""with grown as (select name, contig, strand, case when strand = '-' then start else greatest(start - 50, 0) end as start, case when strand = '-' then "end" + 50 else "end" end as "end" from {B})
select g.contig, g.strand, g.name as l_name, a.name as r_name, greatest(g.start, a.start) as start, least(g."end", a."end") as "end"
from grown g join {A} a on g.contig = a.contig and g.strand = a.strand and g.start < a."end" and a.start < g."end\""""
)
def strand_overlap_clip(spark: SparkSession, folder: str) -> DataFrame:
    peaks = iv.extend_upstream(intervals(spark, folder, "purchase", 3), 50)
    hits = iv.overlap_join(peaks, intervals(spark, folder, "signup", 6), ("contig", "strand"), _BIN)
    start, end = iv.clipped(F.col("l_start"), F.col("l_end"), F.col("r_start"), F.col("r_end"))
    return hits.select("contig", "strand", "l_name", "r_name", start.alias("start"), end.alias("end"))


@query(f'select b.contig, b.name as l_name, a.name as r_name from {B} b join {A} a on a.contig = b.contig and b.start >= a.start and b."end" <= a."end"')
def containment(spark: SparkSession, folder: str) -> DataFrame:
    return iv.containment_join(intervals(spark, folder, "purchase", 3), intervals(spark, folder, "signup", 6), bin_size=_BIN).select("contig", "l_name", "r_name")


@query(
    f"""with last as (select b.name, b.contig, b.start, b."end", max(struct_pack(s := a.start, n := a.name, e := a."end")) as r from {B} b join {A} a on a.contig = b.contig and a.start <= b.start group by all)
select name, contig, start, "end", r.n as r_name, r.s as r_start, r.e as r_end from last where r.e >= "end\""""
)
def containment_asof(spark: SparkSession, folder: str) -> DataFrame:
    out = iv.last_start_containment(intervals(spark, folder, "purchase", 3).drop("strand"), intervals(spark, folder, "signup", 6).drop("strand"))
    return out.select("name", "contig", "start", "end", "r_name", "r_start", "r_end")


@query(_MERGED.format(t=A))
def interval_merge(spark: SparkSession, folder: str) -> DataFrame:
    return iv.merge_intervals(intervals(spark, folder, "signup", 6))


@query(
    f"""with blockers as ({_MERGED.format(t=B)}),
hits as (select a.contig, a.name, a.start, a."end", b.start as bs, b."end" as be from {A} a join blockers b on a.contig = b.contig and a.start < b."end" and b.start < a."end"),
gaps as (select contig, name, coalesce(lag(be) over (partition by contig, name order by bs), start) as start, bs as "end" from hits
  union all select contig, name, max(be), any_value("end") from hits group by contig, name
  union all select contig, name, start, "end" from {A} a where not exists (select 1 from hits h where h.name = a.name))
select * from gaps where start < "end\""""
)
def interval_subtract(spark: SparkSession, folder: str) -> DataFrame:
    return iv.subtract_intervals(intervals(spark, folder, "signup", 6), intervals(spark, folder, "purchase", 3), bin_size=_BIN)


@query(f'select point_id, exists (select 1 from {A} a where a.contig = p.contig and p.pos >= a.start and p.pos < a."end") as inside from {P} p')
def in_interval_flag(spark: SparkSession, folder: str) -> DataFrame:
    return iv.with_contained_flag(points(spark, folder, "view", "click", "error"), intervals(spark, folder, "signup", 6), bin_size=_BIN).select("point_id", "inside")


@query(f'select point_id, contig, pos from {sql_points()} p where exists (select 1 from {A} a where a.contig = p.contig and p.pos >= a.start and p.pos < a."end")')
def restricted_scan(spark: SparkSession, folder: str) -> DataFrame:
    merged = iv.merge_intervals(intervals(spark, folder, "signup", 6)).drop("members")
    return iv.point_join(points(spark, folder), merged, bin_size=_BIN, how="left_semi").select("point_id", "contig", "pos")


_N = sql_points()
#: Zeros count: every point meets every category that its contig has.
_NEAR = f"""select a.point_id, a.event_type, c.event_type as near_category, count(b.point_id) as neighbours from {_N} a join (select distinct contig, event_type from {_N}) c using (contig)
  left join {_N} b on b.contig = a.contig and b.event_type = c.event_type and abs(a.pos - b.pos) < 7200 and a.point_id <> b.point_id group by all"""


@query(f"select point_id, near_category, neighbours from ({_NEAR})")
def neighbor_counts(spark: SparkSession, folder: str) -> DataFrame:
    return iv.neighbour_counts(points(spark, folder), 2 * HOUR, "event_type")


@query(f"select event_type, near_category, avg(neighbours) as mean, stddev_pop(neighbours) as deviation from ({_NEAR}) group by 1, 2")
def neighbor_matrix(spark: SparkSession, folder: str) -> DataFrame:
    p = points(spark, folder)
    n = iv.neighbour_counts(p, 2 * HOUR, "event_type").join(p.select("point_id", "event_type"), "point_id")
    return n.groupBy("event_type", "near_category").agg(F.avg("neighbours").alias("mean"), F.stddev_pop("neighbours").alias("deviation"))


@query(
    f"""with q as {sql_points("error")}, c as {sql_points("view")},
near as (select q.point_id, case when c.pos < q.pos then 'l' else 'r' end as side, c.point_id as o, row_number() over (partition by q.point_id, c.pos < q.pos order by abs(c.pos - q.pos), c.point_id) as k
  from q join c on q.contig = c.contig and c.pos <> q.pos and abs(c.pos - q.pos) <= 86400),
lists as (select point_id, coalesce(list(o order by k) filter (where side = 'l'), []) as l, coalesce(list(o order by k) filter (where side = 'r'), []) as r from near where k <= 3 group by 1)
select point_id, list_resize(coalesce(l, []), 3, -1) as "left", list_resize(coalesce(r, []), 3, -1) as "right" from q left join lists using (point_id)"""
)
def flanking_k(spark: SparkSession, folder: str) -> DataFrame:
    out = iv.flanking(points(spark, folder, "error"), points(spark, folder, "view"), 3, 24 * HOUR)
    return out.select("point_id", "left", "right")


@query(f'select c.point_id, median(t.value) as median_score from {sql_points("signup")} c left join {sql_points("click")} t on t.contig = c.contig and t.pos >= c.pos - 43200 and t.pos < c.pos + 43200 and t.pos <> c.pos group by 1')
def neighborhood_median(spark: SparkSession, folder: str) -> DataFrame:
    track = points(spark, folder, "click").withColumn("score", F.col("value"))
    return iv.neighbourhood_median(points(spark, folder, "signup"), track, 24 * HOUR).select("point_id", "median_score")


@query("select median(value) as median_score from events")
def background_median(spark: SparkSession, folder: str) -> DataFrame:
    from ..operators.metrics import group_percentiles

    return group_percentiles(points(spark, folder), [], "value", (0.5,)).select(F.get("percentiles", F.lit(0)).alias("median_score"))


_BLOCKS = """(select user_id as contig, (epoch_us(ts) // 1000000 // 43200) * 43200 as start, (epoch_us(ts) // 1000000 // 43200 + 1) * 43200 as "end", user_id + 1000 as to_contig,
  (epoch_us(ts) // 1000000 // 43200) * 100000 as to_start, case when user_id % 2 = 0 then '+' else '-' end as to_strand from events where event_type = 'signup' group by all)"""


def _blocks(spark: SparkSession, folder: str) -> DataFrame:
    half_day = F.expr("pos div 43200")
    return points(spark, folder, "signup").select("contig", (half_day * 43200).alias("start"), ((half_day + 1) * 43200).alias("end"), (F.col("contig") + 1000).alias("to_contig"), (half_day * 100000).alias("to_start"), F.when(F.col("contig") % 2 == 0, "+").otherwise("-").alias("to_strand")).distinct()


@query(
    f"""select i.name, b.to_contig as contig, case when b.to_strand = '-' then b.to_start + (b."end" - i."end") else b.to_start + i.start - b.start end as start,
  case when b.to_strand = '-' then b.to_start + (b."end" - i."end") else b.to_start + i.start - b.start end + i."end" - i.start as "end", b.to_strand as strand
from {B} i join {_BLOCKS} b on i.contig = b.contig and i.start >= b.start and i."end" <= b."end\""""
)
def liftover_blocks(spark: SparkSession, folder: str) -> DataFrame:
    return iv.lift_over(intervals(spark, folder, "purchase", 3), _blocks(spark, folder), 43200)[0]


@query(f'select name from {B} i where not exists (select 1 from {_BLOCKS} b where i.contig = b.contig and i.start >= b.start and i."end" <= b."end")')
def liftover_unmapped(spark: SparkSession, folder: str) -> DataFrame:
    return iv.lift_over(intervals(spark, folder, "purchase", 3), _blocks(spark, folder), 43200)[1].select("name")


@query(f'select b.name, coalesce(max(case when a.name is not null then least(a."end", b."end") - greatest(a.start, b.start) end), 0) as most_overlap from {B} b left join {A} a on a.contig = b.contig and a.start < b."end" and b.start < a."end" group by 1')
def most_overlap(spark: SparkSession, folder: str) -> DataFrame:
    return iv.most_overlap(intervals(spark, folder, "purchase", 3), intervals(spark, folder, "signup", 6), bin_size=_BIN).select("name", "most_overlap")


@query(f'select a.contig, a.strand, a.name as l_name, b.name as r_name from {A} a join {A} b on a.contig = b.contig and a.strand = b.strand and a.name < b.name and a.start < b."end" and b.start < a."end"')
def overlaps_in_group(spark: SparkSession, folder: str) -> DataFrame:
    return iv.group_overlaps(intervals(spark, folder, "signup", 6), ("contig", "strand"), _BIN).select("contig", "strand", "l_name", "r_name")


@query(
    f"""select a.name, b.name as r_name, greatest(0, least(a."end", b."end") - greatest(a.start, b.start)) / ((a."end" - a.start) + (b."end" - b.start) - greatest(0, least(a."end", b."end") - greatest(a.start, b.start)))::double as jaccard,
  case when a.strand = b.strand then b."end" - a."end" else b.start - a.start end as end_shift
from {A} a join {B} b on a.contig = b.contig and a.start < b."end" and b.start < a."end\""""
)
def interval_agreement(spark: SparkSession, folder: str) -> DataFrame:
    hits = iv.overlap_join(intervals(spark, folder, "signup", 6), intervals(spark, folder, "purchase", 3), bin_size=_BIN)
    shift = F.when(F.col("l_strand") == F.col("r_strand"), F.col("r_end") - F.col("l_end")).otherwise(F.col("r_start") - F.col("l_start"))
    return hits.select(F.col("l_name").alias("name"), "r_name", iv.overlap_jaccard(F.col("l_start"), F.col("l_end"), F.col("r_start"), F.col("r_end")).alias("jaccard"), shift.alias("end_shift"))


@query(
    f"""select p.point_id, a.name, case when a.strand = '-' then a."end" - p.pos - 1 else p.pos - a.start end as relative, case when a.strand = '-' then a."end" - 1 - p.pos else p.pos - a.start end as to_five,
  case when a.strand = '-' then p.pos - a.start else a."end" - 1 - p.pos end as to_three from {P} p join {A} a on p.contig = a.contig and p.pos >= a.start and p.pos < a."end\""""
)
def strand_positions(spark: SparkSession, folder: str) -> DataFrame:
    hits = iv.point_join(points(spark, folder, "view", "click", "error"), intervals(spark, folder, "signup", 6), bin_size=_BIN)
    five, three = iv.end_distances("pos", "r_start", "r_end", "r_strand")
    return hits.select("point_id", F.col("r_name").alias("name"), iv.relative_position("pos", F.col("pos") + 1, "r_start", "r_end", "r_strand").alias("relative"), five.alias("to_five"), three.alias("to_three"))


@query(
    f"""with recursive o as (select *, row_number() over (partition by contig order by start, "end", name) as k from {A}),
walk as (select contig, k, name, "end" as reach, name as anchor from o where k = 1
  union all select o.contig, o.k, o.name, case when o.start >= w.reach then o."end" else w.reach end, case when o.start >= w.reach then o.name else w.anchor end from walk w join o on o.contig = w.contig and o.k = w.k + 1)
select contig, name, anchor from walk"""
)
def anchor_clusters(spark: SparkSession, folder: str) -> DataFrame:
    from ..operators.ordered import cluster_by_anchor

    return cluster_by_anchor(intervals(spark, folder, "signup", 6), ("contig",)).select("contig", "name", "anchor")


@query(
    f"""select contig, name, sum(opens) over (partition by contig order by start, "end" rows unbounded preceding) as island from (
  select *, case when start > max("end") over (partition by contig order by start, "end" rows between unbounded preceding and 1 preceding) - 1 then 1
    when row_number() over (partition by contig order by start, "end") = 1 then 1 else 0 end as opens from {A})"""
)
def interval_islands(spark: SparkSession, folder: str) -> DataFrame:
    return iv.with_island(intervals(spark, folder, "signup", 6)).select("contig", "name", "island")


@query("select event_id, regexp_extract(props, '\"k\": ([0-9]+)', 1)::int as k, ('GT=' || event_type || '/' || user_id || ';AF=' || value || ';') as info, value > 100 as is_common from events where value is not null")
def info_fields(spark: SparkSession, folder: str) -> DataFrame:
    from ..functions.sequence import info_field

    e = table(spark, folder, "events").filter("value is not null")
    packed = e.withColumn("info", F.concat(F.lit("GT="), "event_type", F.lit("/"), F.col("user_id").cast("string"), F.lit(";AF="), F.col("value").cast("string"), F.lit(";")))
    return packed.select("event_id", F.get_json_object("props", "$.k").cast("int").alias("k"), "info", (info_field("info", "AF").cast("double") > 100).alias("is_common"))
