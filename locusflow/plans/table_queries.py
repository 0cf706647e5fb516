"""Queries over plain tables: projections, joins, aggregates, ordered rows, samples and sets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import sequence as sq
from ..operators import joins, metrics, ordered, sampling
from .registry import query, table, with_checkpoints


@query("select p_partkey, p_brand, p_name from (select *, count(*) over (partition by p_brand, p_name) as n from part) where n = 1")
def canonical_unique(spark: SparkSession, folder: str) -> DataFrame:
    return metrics.duplicated_out(table(spark, folder, "part"), ["p_brand", "p_name"]).select("p_partkey", "p_brand", "p_name")


@query("select o_custkey, o_orderkey, o_totalprice from (select *, row_number() over (partition by o_custkey order by o_totalprice desc, o_orderkey) as r from orders) where r = 1")
def longest_wins(spark: SparkSession, folder: str) -> DataFrame:
    return metrics.first_by(table(spark, folder, "orders"), ["o_custkey"], [F.desc("o_totalprice"), F.col("o_orderkey")]).select("o_custkey", "o_orderkey", "o_totalprice")


@query("select o_custkey, arg_max(o_orderkey, (o_orderdate, o_orderkey)) as o_orderkey from orders group by 1")
def last_wins(spark: SparkSession, folder: str) -> DataFrame:
    return joins.last_wins(table(spark, folder, "orders").select("o_custkey", "o_orderkey", "o_orderdate"), ["o_custkey"], ["o_orderdate", "o_orderkey"]).select("o_custkey", "o_orderkey")


@query("select 'a' as tag, event_id as id, event_type, null::varchar as mktsegment from events where event_type = 'click' union all select 'b', c_custkey, null, c_mktsegment from customer")
def union_sources(spark: SparkSession, folder: str) -> DataFrame:
    a = table(spark, folder, "events").filter("event_type = 'click'").select(F.lit("a").alias("tag"), F.col("event_id").alias("id"), "event_type")
    b = table(spark, folder, "customer").select(F.lit("b").alias("tag"), F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("mktsegment"))
    return a.unionByName(b, allowMissingColumns=True)


@query("select event_id, user_id, event_type from events e where not (event_type = 'error' and exists (select 1 from events s where s.user_id = e.user_id and s.event_type = 'signup' and s.value > 50))")
def conditional_anti(spark: SparkSession, folder: str) -> DataFrame:
    e = table(spark, folder, "events")
    return joins.conditional_anti(e, ["user_id"], F.col("event_type") == "error", (F.col("event_type") == "signup") & (F.col("value") > 50)).select("event_id", "user_id", "event_type")


@query("select n_name, r_name, c_custkey from customer join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey")
def chained_joins(spark: SparkSession, folder: str) -> DataFrame:
    c = table(spark, folder, "customer").select("c_custkey", F.col("c_nationkey").alias("nation"))
    n = table(spark, folder, "nation").select(F.col("n_nationkey").alias("nation"), "n_name", F.col("n_regionkey").alias("region"))
    r = table(spark, folder, "region").select(F.col("r_regionkey").alias("region"), "r_name")
    return joins.natural_join(joins.natural_join(c, n), r).select("n_name", "r_name", "c_custkey").distinct()


@query("select c_custkey from customer where c_custkey in (select o_custkey from orders where o_orderstatus = 'F') and c_custkey not in (select o_custkey from orders where o_totalprice > 400000)")
def semi_and_anti(spark: SparkSession, folder: str) -> DataFrame:
    o = table(spark, folder, "orders").withColumnRenamed("o_custkey", "c_custkey")
    c = table(spark, folder, "customer").select("c_custkey")
    return c.join(o.filter("o_orderstatus = 'F'"), "c_custkey", "left_semi").join(o.filter("o_totalprice > 400000"), "c_custkey", "left_anti")


@query("select s_suppkey, s_name, n_name from supplier join nation on s_nationkey = n_nationkey")
def one_to_one(spark: SparkSession, folder: str) -> DataFrame:
    s = table(spark, folder, "supplier")
    names = s.select("s_suppkey", "s_nationkey").join(table(spark, folder, "nation").withColumnRenamed("n_nationkey", "s_nationkey"), "s_nationkey").select("s_suppkey", "n_name")
    return joins.one_to_one_join(s.select("s_suppkey", "s_name"), names, ["s_suppkey"])


@query(
    """select user_id, c.n as clicks, v.n as views, e.n as errors from (select user_id, count(*) as n from events where event_type = 'click' group by 1) c
full join (select user_id, count(*) as n from events where event_type = 'view' group by 1) v using (user_id) full join (select user_id, count(*) as n from events where event_type = 'error' and value > 60 group by 1) e using (user_id)"""
)
def outer_concat(spark: SparkSession, folder: str) -> DataFrame:
    e = table(spark, folder, "events")
    per = lambda cond, name: e.filter(cond).groupBy("user_id").agg(F.count(F.lit(1)).alias(name))
    return joins.outer_concat([per("event_type = 'click'", "clicks"), per("event_type = 'view'", "views"), per("event_type = 'error' and value > 60", "errors")], "user_id")


@query(
    """with own as (select o_custkey, max(o_totalprice) as price from orders where o_orderstatus = 'P' group by 1), shared as (select c_nationkey, avg(o_totalprice) as price from orders join customer on o_custkey = c_custkey group by 1)
select c_custkey, coalesce(own.price, shared.price) as price from customer left join own on o_custkey = c_custkey left join shared using (c_nationkey)"""
)
def fallback_lookup(spark: SparkSession, folder: str) -> DataFrame:
    c, o = table(spark, folder, "customer"), table(spark, folder, "orders").withColumnRenamed("o_custkey", "c_custkey")
    own = o.filter("o_orderstatus = 'P'").groupBy("c_custkey").agg(F.max("o_totalprice").alias("price"))
    shared = o.join(c, "c_custkey").groupBy("c_nationkey").agg(F.avg("o_totalprice").alias("price"))
    return joins.fallback_lookup(c, own, ["c_custkey"], shared, ["c_nationkey"], "price").select("c_custkey", "price")


@query("select a.event_id, b.event_id as parent_event_id, b.value as parent_value from events a join events b on a.event_id % 4 <> 0 and b.event_id = a.event_id - a.event_id % 4")
def parent_rows(spark: SparkSession, folder: str) -> DataFrame:
    e = table(spark, folder, "events").withColumn("parent", F.when(F.col("event_id") % 4 != 0, F.col("event_id") - F.col("event_id") % 4))
    return joins.parent_rows(e, "event_id", "parent", ["value", "event_id"]).select("event_id", "parent_event_id", "parent_value")


@query("select k as key, coalesce(b.v, a.v) as v from (select event_id::varchar || case when event_id % 5 = 0 then '_2' else '' end as k, value as v from events) a left join (select (event_id - event_id % 5 - 5)::varchar as k, null::double as v from events where false) b using (k)")
def alternate_rows(spark: SparkSession, folder: str) -> DataFrame:
    e = table(spark, folder, "events").select(F.concat(F.col("event_id").cast("string"), F.when(F.col("event_id") % 5 == 0, "_2").otherwise("")).alias("key"), F.col("value").alias("v"))
    return joins.alternate_rows(e, "key", ["v"])


@query("select user_id from events group by 1 having count(distinct event_type) = (select count(distinct event_type) from events) and count(distinct user_id % 3) = 1")
def key_intersection(spark: SparkSession, folder: str) -> DataFrame:
    e = table(spark, folder, "events").withColumn("v", F.col("user_id") % 3)
    return joins.agreeing_keys(e, "user_id", "event_type", "v")


@query("select count(*) filter (where upper(left(p_name, 1)) is distinct from upper(left(p_type, 1))) as mismatches, count(*) as rows from part")
def reference_mismatches(spark: SparkSession, folder: str) -> DataFrame:
    p = table(spark, folder, "part").select(F.left("p_name", F.lit(1)).alias("a"), F.left("p_type", F.lit(1)).alias("b"))
    return joins.mismatches(p, "a", "b")[1]


@query("select user_id, string_agg(event_type || '_' || event_id, ',' order by ts, event_id) as path, list_sort(list(distinct event_type)) as types from events group by 1")
def joined_strings(spark: SparkSession, folder: str) -> DataFrame:
    e = table(spark, folder, "events").withColumn("w", F.concat_ws("_", "event_type", F.col("event_id").cast("string")))
    path = F.concat_ws(",", F.transform(F.array_sort(F.collect_list(F.struct("ts", "event_id", "w"))), lambda s: s["w"]))
    return e.groupBy("user_id").agg(path.alias("path"), F.sort_array(F.collect_set("event_type")).alias("types"))


@query("select c_nationkey, c_mktsegment, c_custkey, c_acctbal from (select *, row_number() over (partition by c_nationkey order by c_acctbal desc, c_custkey) as r from customer) where r <= 3")
def topk_group(spark: SparkSession, folder: str) -> DataFrame:
    return metrics.top_k(table(spark, folder, "customer"), ["c_nationkey"], [F.desc("c_acctbal"), F.col("c_custkey")], 3).select("c_nationkey", "c_mktsegment", "c_custkey", "c_acctbal")


@query("select l_returnflag, sum(l_quantity) filter (where l_linestatus = 'F') as \"F\", sum(l_quantity) filter (where l_linestatus = 'O') as \"O\" from lineitem group by 1")
def pivot_wide(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "lineitem").groupBy("l_returnflag").pivot("l_linestatus", ["F", "O"]).agg(F.sum("l_quantity"))


@query("select l_orderkey, l_linenumber, measure, v from (select l_orderkey, l_linenumber, unnest(['tax', 'discount']) as measure, unnest([l_tax, l_discount]) as v from lineitem)")
def unpivot_long(spark: SparkSession, folder: str) -> DataFrame:
    li = table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_tax").alias("tax"), F.col("l_discount").alias("discount"))
    return li.unpivot(["l_orderkey", "l_linenumber"], ["tax", "discount"], "measure", "v")


@query(
    """select p_partkey, string_split(p_type || '_' || p_size || '_' || p_retailprice, '_')[1] as kind, p_size::int as size, case when p_size < 10 then 'small' when p_size < 30 then 'middle' else 'large' end as band, split_part(p_brand, '#', 2)::int as brand,
  case when p_size >= 10 then 'low' else 'PASS' end as status from part where not coalesce(p_name like '%red%', false) and (p_size < 45 or p_retailprice > 1000)"""
)
def projections(spark: SparkSession, folder: str) -> DataFrame:
    p = table(spark, folder, "part").filter(~F.coalesce(F.col("p_name").contains("red"), F.lit(False)) & ((F.col("p_size") < 45) | (F.col("p_retailprice") > 1000)))
    packed = F.split(F.concat_ws("_", "p_type", F.col("p_size").cast("string"), F.col("p_retailprice").cast("string")), "_")
    band = F.when(F.col("p_size") < 10, "small").when(F.col("p_size") < 30, "middle").otherwise("large")
    return p.select("p_partkey", packed[0].alias("kind"), packed[1].cast("int").alias("size"), band.alias("band"), F.substring_index("p_brand", "#", -1).cast("int").alias("brand"), F.when(F.col("p_size") >= 10, "low").otherwise("PASS").alias("status"))


@query("select n_nationkey, 'chr' || case when n_nationkey = 24 then 'M' when n_nationkey = 22 then 'X' when n_nationkey = 23 then 'Y' else (n_nationkey + 1)::varchar end as contig, case when n_nationkey = 24 then null when n_nationkey >= 22 then n_nationkey + 1 else n_nationkey + 1 end as rank from nation")
def contig_names(spark: SparkSession, folder: str) -> DataFrame:
    n = table(spark, folder, "nation")
    raw = F.when(F.col("n_nationkey") == 24, "MT").when(F.col("n_nationkey") == 22, "X").when(F.col("n_nationkey") == 23, "Y").otherwise((F.col("n_nationkey") + 1).cast("string"))
    return n.select("n_nationkey", sq.contig_name(raw).alias("contig"), sq.contig_order(sq.contig_name(raw)).alias("rank"))


@query("select user_id, event_id, (value - b) / nullif(abs(b), 0) as change from (select *, lag(value, 3) over (partition by user_id order by event_id) as b from events)")
def pct_change_n(spark: SparkSession, folder: str) -> DataFrame:
    return ordered.change_since(table(spark, folder, "events"), ["user_id"], "event_id", "value", 3).select("user_id", "event_id", "change")


@query("select user_id, min(event_id) filter (where value >= 100) as first_event_id from events group by 1")
def first_over_threshold(spark: SparkSession, folder: str) -> DataFrame:
    return ordered.first_where(table(spark, folder, "events"), ["user_id"], "event_id", F.col("value") >= 100)


@query("select user_id, median(rate) as median_rate from (select user_id, (event_id - lag(event_id) over w)::double / nullif(epoch_us(ts) // 1000000 - lag(epoch_us(ts) // 1000000) over w, 0) as rate from events window w as (partition by user_id order by event_id)) group by 1")
def rate_per_step(spark: SparkSession, folder: str) -> DataFrame:
    return ordered.step_rates(table(spark, folder, "events"), ["user_id"], "event_id", "ts", "event_id")


@query("with h as (select user_id, day(ts) as epoch, min(event_id) as start from events group by 1, 2) select user_id, epoch, start, lead(start) over (partition by user_id order by epoch) - start as length from h")
def epoch_lengths(spark: SparkSession, folder: str) -> DataFrame:
    e = table(spark, folder, "events").withColumn("epoch", F.dayofmonth("ts").cast("long"))
    return ordered.epoch_lengths(e, ["user_id"], "event_id", "epoch", "event_id")


@query(
    """with r as (select *, lag(value) over (partition by user_id order by event_id) / nullif(value, 0) as ratio from events), b as (select user_id, arg_max(event_id, ratio) as at_, max(ratio) as by_ from r where ratio is not null group by 1)
select event_id, case when event_id < at_ and by_ > 1 then value / by_ else value end as mended from events left join b using (user_id)"""
)
def mend_scale_break(spark: SparkSession, folder: str) -> DataFrame:
    return ordered.mend_scale_break(table(spark, folder, "events"), ["user_id"], "event_id", "value").select("event_id", "mended")


@query(
    """with o as (select user_id, event_id, value, row_number() over (partition by user_id order by event_id) as t from events)
select event_id, list_reduce(list_prepend(0.0::double, list(value::double) over w), lambda s, x: s * 0.98 + x * (1 - 0.98)) / (1 - pow(0.98, t)) as ema from o window w as (partition by user_id order by event_id rows unbounded preceding)"""
)
def ema(spark: SparkSession, folder: str) -> DataFrame:
    return ordered.moving_average(table(spark, folder, "events"), ["user_id"], ["event_id"], "value").select("event_id", "ema")


@query("select c_custkey, ((row_number() over (partition by c_nationkey order by c_custkey) - 1) % 5)::int as fold from customer")
def fold_interleaved(spark: SparkSession, folder: str) -> DataFrame:
    return ordered.interleaved_folds(table(spark, folder, "customer"), ["c_nationkey"], ["c_custkey"], 5).select("c_custkey", "fold")


@query("select c_custkey, ((row_number() over (partition by c_nationkey order by c_custkey) - 1) // (count(*) over (partition by c_nationkey) // 5 + 1))::int as fold from customer")
def fold_contiguous(spark: SparkSession, folder: str) -> DataFrame:
    return ordered.contiguous_folds(table(spark, folder, "customer"), ["c_nationkey"], ["c_custkey"], 5).select("c_custkey", "fold")


@query("select c_custkey, index, (index // 100)::int as shard from (select c_custkey, row_number() over (order by md5(c_custkey || ':7'), c_custkey) - 1 as index from customer)")
def shard_shuffle(spark: SparkSession, folder: str) -> DataFrame:
    with_checkpoints(spark)
    return sampling.shards(table(spark, folder, "customer").select("c_custkey"), "c_custkey", 100, 7, partitions=8).select("c_custkey", "index", "shard")


@query("select c_custkey, c_mktsegment from (select *, row_number() over (partition by c_nationkey, c_mktsegment order by md5(c_custkey || ':0'), c_custkey) as r from customer) where r <= 4")
def sample_stratified(spark: SparkSession, folder: str) -> DataFrame:
    return sampling.sample_per_group(table(spark, folder, "customer"), ["c_nationkey", "c_mktsegment"], "c_custkey", 4).select("c_custkey", "c_mktsegment")


@query("select o_orderkey from orders order by md5(o_orderkey || ':3'), o_orderkey limit 500")
def sample_n(spark: SparkSession, folder: str) -> DataFrame:
    return sampling.sample_at_most(table(spark, folder, "orders").select("o_orderkey"), "o_orderkey", 500, 3)


@query(
    """with p as (select user_id, count(*) as n from events where event_type = 'error' group by 1), g as (select event_id, user_id, row_number() over (partition by user_id order by md5(event_id || ':0'), event_id) as r from events where event_type = 'view')
select event_id, user_id from g join p using (user_id) where r <= n"""
)
def matched_sample(spark: SparkSession, folder: str) -> DataFrame:
    e = table(spark, folder, "events").select("event_id", "user_id", "event_type")
    return sampling.matched_sample(e.filter("event_type = 'error'"), e.filter("event_type = 'view'"), ["user_id"], "event_id").select("event_id", "user_id")


@query(
    """with n as (select quality, count(*) as n from labels group by 1), r as (select *, row_number() over (partition by quality order by md5(doc_id || ':0'), doc_id) as r from labels join n using (quality), (select max(n) as most from n))
select doc_id, quality, unnest(range(1, most // n + case when r <= most % n then 1 else 0 end + 1)) as copy from r"""
)
def upsample_balance(spark: SparkSession, folder: str) -> DataFrame:
    return sampling.upsample_to_balance(table(spark, folder, "labels"), "quality", "doc_id").select("doc_id", "quality", "copy")


@query(
    """with s as (select event_type as split, count(*) // 10 as size from events group by 1), r as (select split, c_custkey, size, row_number() over (partition by split order by md5(c_custkey || ':' || split), c_custkey) as r from customer, s)
select split, c_custkey from r where r <= size"""
)
def pool_per_split(spark: SparkSession, folder: str) -> DataFrame:
    splits = table(spark, folder, "events").groupBy(F.col("event_type").alias("split")).agg(F.expr("count(*) div 10").alias("size"))
    return sampling.pool_for_splits(splits, "split", "size", table(spark, folder, "customer").select("c_custkey"), "c_custkey")


@query(
    """with n as (select c_nationkey, count(*) as n, sum(count(*)) over ()::double as whole from customer group by 1)
select c_custkey, round from customer join (select *, unnest(range(1, 6)) as round from n) using (c_nationkey) where ('0x' || substr(md5(c_nationkey || ':' || round || ':0'), 1, 13))::bigint / 4503599627370496.0 >= power(1 - n / whole, whole)"""
)
def bagged_rows(spark: SparkSession, folder: str) -> DataFrame:
    return sampling.bag_groups(table(spark, folder, "customer"), "c_nationkey", 5).select("c_custkey", F.col("round").cast("long").alias("round"))


@query("select doc_id, case when ('0x' || substr(md5(doc_id || ':1'), 1, 13))::bigint / 4503599627370496.0 < 0.2 then 'test' else 'train' end as part, floor(('0x' || substr(md5(source || ':0'), 1, 13))::bigint / 4503599627370496.0 * 4)::int as fold from documents")
def train_test_folds(spark: SparkSession, folder: str) -> DataFrame:
    d = sampling.train_test(table(spark, folder, "documents").select("doc_id", "source"), "doc_id", 0.2, 1)
    return sampling.group_folds(d, "source", 4).select("doc_id", "part", "fold")


@query("select a.c_nationkey as a, b.c_nationkey as b, len(list_intersect(a.s, b.s)) / len(list_distinct(list_concat(a.s, b.s)))::double as jaccard from (select c_nationkey, list(distinct c_mktsegment || (c_custkey % 11)) as s from customer group by 1) a join (select c_nationkey, list(distinct c_mktsegment || (c_custkey % 11)) as s from customer group by 1) b on b.c_nationkey = a.c_nationkey + 1")
def set_jaccard(spark: SparkSession, folder: str) -> DataFrame:
    s = table(spark, folder, "customer").groupBy("c_nationkey").agg(F.collect_set(F.concat("c_mktsegment", (F.col("c_custkey") % 11).cast("string"))).alias("s"))
    b = s.select((F.col("c_nationkey") - 1).alias("a"), F.col("c_nationkey").alias("b"), F.col("s").alias("t"))
    joined = s.withColumnRenamed("c_nationkey", "a").join(b, "a")
    return joined.select("a", "b", F.try_divide(F.size(F.array_intersect("s", "t")).cast("double"), F.size(F.array_union("s", "t")).cast("double")).alias("jaccard"))


@query("select distinct o_custkey from orders except select c_custkey from customer where c_mktsegment = 'BUILDING'")
def set_difference(spark: SparkSession, folder: str) -> DataFrame:
    c = table(spark, folder, "customer").filter("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("o_custkey"))
    return table(spark, folder, "orders").select("o_custkey").distinct().join(c, "o_custkey", "left_anti")


@query("select conv_id, n, md5(whole) as digest from (select conv_id, count(*) as n, string_agg(coalesce(text, ''), chr(10) order by turn) as whole from conversations group by 1)")
def stitched_turns(spark: SparkSession, folder: str) -> DataFrame:
    c = table(spark, folder, "conversations").groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_list(F.struct("turn", F.coalesce("text", F.lit("")).alias("t")))).alias("parts"))
    return c.select("conv_id", "n", F.md5(F.array_join(F.transform("parts", lambda p: p["t"]), "\n")).alias("digest"))
