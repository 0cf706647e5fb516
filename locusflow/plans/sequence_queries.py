"""Queries over sequences, k-mers and per-position arrays."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import arrays, sequence as sq
from ..operators import joins, kmers as km, ordered
from .frames import SQL_SEQUENCES as S
from .frames import sequences
from .registry import query, table

_RC = "reverse(translate(seq, 'ACGTacgt', 'TGCAtgca'))"


@query(f"select doc_id, md5({_RC}) as digest, length(seq) as length, case when doc_id % 2 = 1 then md5({_RC}) else md5(seq) end as stranded from {S}")
def revcomp(spark: SparkSession, folder: str) -> DataFrame:
    strand = F.when(F.col("doc_id") % 2 == 1, "-").otherwise("+")
    return sequences(spark, folder).select("doc_id", F.md5(sq.reverse_complement("seq")).alias("digest"), F.length("seq").alias("length"), F.md5(sq.on_strand("seq", strand)).alias("stranded"))


_MID = "(length(seq) // 2)"


@query(
    f"""select doc_id, substr(seq, greatest({_MID} - 20, 0) + 1, 41) as window_seq, md5(substr(seq, 1, {_MID}) || 'TT' || substr(seq, {_MID} + 2)) as substituted,
  md5(repeat('N', least(10, length(seq))) || substr(seq, 11, greatest(length(seq) - 20, 0)) || repeat('N', length(seq) - greatest(length(seq) - 10, least(10, length(seq))))) as masked,
  md5(substr(seq, 1, {_MID}) || lower(substr(seq, {_MID} + 1, 1)) || substr(seq, {_MID} + 2)) as marked, left(repeat('N', greatest(60 - length(seq), 0)) || seq, 60) as left_padded from {S}"""
)
def seq_window_substitute(spark: SparkSession, folder: str) -> DataFrame:
    s = sequences(spark, folder).withColumn("mid", F.expr("cast(length(seq) div 2 as int)"))
    return s.select(
        "doc_id", F.substr("seq", F.greatest(F.col("mid") - 20, F.lit(0)) + 1, F.lit(41)).alias("window_seq"), F.md5(sq.substitute("seq", F.col("mid"), 1, F.lit("TT"))).alias("substituted"),
        F.md5(sq.mask_outside("seq", 10, F.greatest(F.length("seq") - 10, F.least(F.length("seq"), F.lit(10))))).alias("masked"), F.md5(sq.lower_at("seq", F.col("mid"))).alias("marked"), F.left(sq.pad("seq", 60, "left"), F.lit(60)).alias("left_padded"),
    )


def _kmers_sql(k: int) -> str:
    return f"(select doc_id, substr(seq, i, {k}) as kmer from (select doc_id, seq, unnest(range(1, length(seq) - {k} + 2)) as i from {S}))"


@query(f"select doc_id, kmer, count(*) as n from {_kmers_sql(3)} group by 1, 2")
def kmer_counts(spark: SparkSession, folder: str) -> DataFrame:
    return km.kmer_counts(sequences(spark, folder), "doc_id", "seq", 3, unique_key=True)


@query(
    f"""with c as (select doc_id, kmer, count(*) as n from {_kmers_sql(2)} group by 1, 2), d as (select a || b as kmer from (select unnest(['A', 'C', 'G', 'T']) as a), (select unnest(['A', 'C', 'G', 'T']) as b))
select doc_id, list(coalesce(n, 0) order by kmer) as counts from documents cross join d left join c using (doc_id, kmer) group by 1"""
)
def kmer_vector(spark: SparkSession, folder: str) -> DataFrame:
    return km.kmer_vector(sequences(spark, folder), "doc_id", "seq", 2)


def _all_k(longest: int) -> str:
    each = " union all ".join(f"select {k} as k, kmer, count(*)::double as n from {_kmers_sql(k)} group by 2" for k in range(1, longest + 1))
    return f"({each})"


@query(_all_k(4)[1:-1])
def kmer_all_k(spark: SparkSession, folder: str) -> DataFrame:
    return km.corpus_kmer_counts(sequences(spark, folder), "seq", 4)


@query(f"select k, kmer, n / sum(n) over (partition by k, left(kmer, k - 1)) as p from {_all_k(3)}")
def markov_forward(spark: SparkSession, folder: str) -> DataFrame:
    return km.markov_forward(km.corpus_kmer_counts(sequences(spark, folder), "seq", 3)).select("k", "kmer", "p")


@query(f"select k, kmer, n / sum(n) over (partition by k, left(kmer, k // 2), right(kmer, k // 2)) as p from {_all_k(3)} where k % 2 = 1")
def markov_bidirectional(spark: SparkSession, folder: str) -> DataFrame:
    return km.markov_both_sides(km.corpus_kmer_counts(sequences(spark, folder), "seq", 3)).select("k", "kmer", "p")


_MODEL = f"(select kmer, n / sum(n) over (partition by k, left(kmer, k - 1)) as p from {_all_k(3)})"


@query(
    f"""select doc_id, count(*) as n, sum(ln(p)) as log_likelihood from (select doc_id, substr(seq, greatest(i - 2, 1), least(i, 3)) as kmer from (select doc_id, seq, unnest(range(1, length(seq) + 1)) as i from {S}))
join {_MODEL} using (kmer) group by 1"""
)
def markov_base_scores(spark: SparkSession, folder: str) -> DataFrame:
    s = sequences(spark, folder)
    model = km.markov_forward(km.corpus_kmer_counts(s, "seq", 3))
    return km.forward_likelihood(s, "doc_id", "seq", model, 2)


_TWO = f"(select left(kmer, k // 2) || '.' || right(kmer, k // 2) as flanks, substr(kmer, k // 2 + 1, 1) as base, n / sum(n) over (partition by k, left(kmer, k // 2), right(kmer, k // 2)) as p from {_all_k(3)} where k % 2 = 1)"


@query(
    f"""with m as {_TWO}, best as (select flanks, max(p) as top from m group by 1),
pos as (select seq, i, least(1, i - 1, length(seq) - i) as side from (select seq, unnest(range(1, length(seq) + 1)) as i from {S})),
hit as (select (m.p = best.top)::int::double as h from (select substr(seq, i - side, side) || '.' || substr(seq, i + 1, side) as flanks, substr(seq, i, 1) as base from pos) join m using (flanks, base) join best using (flanks))
select avg(h) as accuracy, stddev_pop(h) as deviation, count(*) as n from hit"""
)
def markov_accuracy(spark: SparkSession, folder: str) -> DataFrame:
    s = sequences(spark, folder)
    model = km.markov_both_sides(km.corpus_kmer_counts(s, "seq", 3))
    return km.both_sides_accuracy(s, "seq", model, 1)


@query(
    f"""with pairs as (select doc_id, i, substr(seq, i, 1) as b, substr(seq, i + 1, 1) as c from (select doc_id, seq, unnest(range(1, length(seq))) as i from {S})),
u as (select doc_id, count(*) filter (where b = c) as uniformity, count(*) filter (where b || c = 'AC') as count_ac from pairs group by 1),
runs as (select doc_id, max(n) as longest from (select doc_id, count(*) as n from (
  select doc_id, i, b, i - row_number() over (partition by doc_id, b order by i) as g from (select doc_id, unnest(range(1, length(seq) + 1)) as i, unnest(string_split(seq, '')) as b from {S} where seq <> '')) group by doc_id, b, g) group by 1)
select doc_id, coalesce(uniformity, 0) as uniformity, coalesce(count_ac, 0) as count_ac, coalesce(longest, 0) as longest, (length(seq) - length(replace(seq, 'G', ''))) / nullif(length(seq), 0)::double as share_g
from {S} left join u using (doc_id) left join runs using (doc_id)"""
)
def sequence_features(spark: SparkSession, folder: str) -> DataFrame:
    s = sequences(spark, folder)
    n = F.length("seq").cast("double")
    ac = F.size(F.regexp_extract_all("seq", F.lit("AC"), F.lit(0)))
    return s.select("doc_id", F.when(F.length("seq") > 0, sq.uniformity("seq")).otherwise(0).alias("uniformity"), ac.alias("count_ac"), F.when(F.length("seq") > 0, sq.longest_repeat("seq", 1)).otherwise(0).alias("longest"), F.try_divide((n - F.length(F.replace("seq", F.lit("G"), F.lit("")))), n).alias("share_g"))


@query(f"""with p as (select doc_id, seq, lead(doc_id) over w as other, lead(seq) over w as other_seq from {S} window w as (partition by source, length(seq) order by doc_id))
select doc_id, other, len(list_filter(range(1, length(seq) + 1), lambda i: substr(seq, i, 1) <> substr(other_seq, i, 1))) as distance from p where other is not null""")
def hamming_same_length(spark: SparkSession, folder: str) -> DataFrame:
    """Distance to the next sequence of one source and length."""
    w = Window.partitionBy("source", F.length("seq")).orderBy("doc_id")
    s = sequences(spark, folder).withColumn("other", F.lead("doc_id").over(w)).withColumn("other_seq", F.lead("seq").over(w))
    return s.filter("other is not null").select("doc_id", "other", sq.hamming("seq", "other_seq").alias("distance"))


_CH = f"(select doc_id, length(seq) as n, seq, unnest(range(0, greatest(length(seq) - 16, 1), 112)) as s from {S})"


@query(f"select doc_id, (s // 112)::int as chunk, substr(seq, greatest(0, least(s, n - 128)) + 1, 128) as part, (s - least(s, greatest(n - 128, 0)))::int as left_shift from {_CH}")
def chunk_overlap(spark: SparkSession, folder: str) -> DataFrame:
    c = sequences(spark, folder).select("doc_id", F.posexplode(sq.overlapping_chunks("seq", 128, 16)).alias("chunk", "c"))
    return c.select("doc_id", "chunk", F.col("c.chunk").alias("part"), F.col("c.left_shift").alias("left_shift"))


@query(f"select doc_id, length(seq) as n, md5(seq) as digest from {S} where seq <> ''")
def stitch_chunks(spark: SparkSession, folder: str) -> DataFrame:
    """Chunks, and their outputs (here the bases themselves) put together again: the input comes back."""
    c = sequences(spark, folder).filter("seq <> ''").select("doc_id", F.posexplode(sq.overlapping_chunks("seq", 128, 16)).alias("chunk", "c"))
    drop = F.when(F.col("chunk") > 0, F.col("c.left_shift") + 16).otherwise(0)
    parts = c.select("doc_id", "chunk", F.col("c.chunk").alias("seq"), drop.alias("drop"))
    out = ordered.stitch_chunks(parts, "doc_id", "chunk", "seq", "drop")
    return out.select("doc_id", F.length("seq").alias("n"), F.md5("seq").alias("digest"))


@query(
    f"""select source, pos, count(*) filter (where b = 'A') as "A", count(*) filter (where b = 'C') as "C", count(*) filter (where b = 'G') as "G", count(*) filter (where b = 'T') as "T", count(*) as depth,
  count(*) filter (where b = 'A') / count(*)::double as "p_A" from (select source, unnest(range(0, length(seq)))::int as pos, unnest(string_split(seq, '')) as b from {S} where seq <> '') group by 1, 2"""
)
def column_base_freq(spark: SparkSession, folder: str) -> DataFrame:
    return km.column_counts(sequences(spark, folder), "source", "seq").select("source", "pos", *km.BASES, "depth", "p_A")


@query(
    """with t as (select user_id as contig, (hour(ts))::int as pos, max(value) as score from events group by 1, 2), c as (select distinct user_id as contig, 24 as length from events)
select contig, list(score order by i) as scores from (select contig, unnest(range(0, 24)) as i from c) left join t on t.contig = contig and t.pos = i group by 1""".replace("on t.contig = contig and t.pos = i", "using (contig)").replace("left join t using (contig)", "d left join t on t.contig = d.contig and t.pos = d.i").replace("select contig, list", "select d.contig, list")
)
def densify_track(spark: SparkSession, folder: str) -> DataFrame:
    e = table(spark, folder, "events").select(F.col("user_id").alias("contig"), F.hour("ts").alias("pos"), F.col("value").alias("score"))
    lengths = e.select("contig").distinct().withColumn("length", F.lit(24))
    return arrays.densified(e, "contig", "pos", "score", lengths, "length").select("contig", "scores")


def _d(f: str) -> str:
    return f"list_sum(list_transform(range(1, 65), lambda i: {f}))"


@query(
    f"""with p as (select a.vec_id // 2 as pair, a.embedding::double[] as x, b.embedding::double[] as y from embeddings a join embeddings b on a.vec_id % 2 = 0 and b.vec_id = a.vec_id + 1)
select pair, {_d("abs(x[i] - y[i])")} as l1, sqrt({_d("(x[i] - y[i]) * (x[i] - y[i])")}) as l2, {_d("x[i] * y[i]")} as dot, {_d("x[i] * y[i]")} / (sqrt({_d("x[i] * x[i]")}) * sqrt({_d("y[i] * y[i]")})) as cosine from p"""
)
def embedding_distances(spark: SparkSession, folder: str) -> DataFrame:
    e = table(spark, folder, "embeddings")
    named = e.withColumn("name", F.concat(F.expr("vec_id div 2").cast("string"), F.when(F.col("vec_id") % 2 == 0, "_ref").otherwise("_alt")))
    p = joins.paired(named, "name", ["embedding"])
    x, y = "ref_embedding", "alt_embedding"
    return p.select(F.col("pair").cast("long").alias("pair"), arrays.l1(x, y).alias("l1"), arrays.l2(x, y).alias("l2"), arrays.dot(x, y).alias("dot"), arrays.cosine(x, y).alias("cosine"))


@query("select label, list(m order by i) as pooled from (select label, i, avg(x) as m from (select label, unnest(range(0, 64)) as i, unnest(embedding)::double as x from embeddings where vec_id % 3 <> 0) group by 1, 2) group by 1")
def masked_mean_pool(spark: SparkSession, folder: str) -> DataFrame:
    """Mean vector of each label over the rows whose mask is 1, dimension by dimension with partial sums (groups may be large)."""
    e = table(spark, folder, "embeddings").withColumn("mask", (F.col("vec_id") % 3 != 0).cast("int"))
    each = e.select("label", "mask", F.posexplode("embedding").alias("i", "x"))
    means = each.groupBy("label", "i").agg(F.try_divide(F.sum(F.col("mask") * F.col("x").cast("double")), F.sum("mask").cast("double")).alias("m")).filter("m is not null")
    return means.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda s: s["m"]).alias("pooled"))


@query(
    """select a.label, corr(x, y) as r, count(*) as n from (select vec_id, label, unnest(range(0, 64)) as i, unnest(embedding)::double as x from embeddings) a
join (select vec_id - 1 as vec_id, unnest(range(0, 64)) as i, unnest(embedding)::double as y from embeddings) b using (vec_id, i) group by 1"""
)
def flat_matrix_corr(spark: SparkSession, folder: str) -> DataFrame:
    e = table(spark, folder, "embeddings")
    a = e.select("vec_id", "label", F.posexplode("embedding").alias("i", "x"))
    b = e.select((F.col("vec_id") - 1).alias("vec_id"), F.posexplode("embedding").alias("i", "y"))
    return a.join(b, ["vec_id", "i"]).groupBy("label").agg(F.corr(F.col("x").cast("double"), F.col("y").cast("double")).alias("r"), F.count(F.lit(1)).alias("n"))


@query(
    """select vec_id, radius, list_avg(list_transform(list_filter(range(greatest(32 - radius, 0), 32 + radius), lambda i: i <> 32), lambda i: embedding[i + 1]::double)) as mean,
  (list_sum(embedding::double[]) - embedding[33]::double) / 63 as rest from embeddings, (select unnest([4, 8, 16, 32])::int as radius)"""
)
def vis_radius(spark: SparkSession, folder: str) -> DataFrame:
    e = table(spark, folder, "embeddings").withColumn("radius", F.explode(F.array(*map(F.lit, (4, 8, 16, 32)))))
    return e.select("vec_id", "radius", arrays.mean_around("embedding", 32, F.col("radius")).alias("mean"), arrays.mean_without("embedding", 32).alias("rest"))


@query(f"select doc_id, s::int as variant, len(list_filter(range(0, length(seq)), lambda i: i % 3 = s)) as masked from {S}, (select unnest([0, 1, 2]) as s)")
def rolling_mask(spark: SparkSession, folder: str) -> DataFrame:
    m = sequences(spark, folder).select("doc_id", F.posexplode(arrays.rolling_masks(F.length("seq"), 3)).alias("variant", "mask"))
    return m.select("doc_id", "variant", F.size(F.filter("mask", lambda x: x == 1)).cast("long").alias("masked"))


#: Counts are rounded part by part, halves to even, inside a frame of five places on both sides.
_MASKED = f"""(with s as (select doc_id, seq, length(seq) as len, length(seq) - 10 as n from {S} where seq <> ''),
  c as (select *, round_even(0.12 * n, 0)::int as a, round_even(0.12 * n, 0)::int + greatest(round_even(0.015 * n, 0)::int, 1) as b, round_even(0.12 * n, 0)::int + greatest(round_even(0.015 * n, 0)::int, 1) + round_even(0.015 * n, 0)::int as c from s),
  t as (select *, md5(doc_id || ':' || i || ':0') as h, (instr('ACGT', substr(seq, i::int + 1, 1)) - 1) as base from (select *, unnest(range(0, len)) as i from c)),
  r as (select *, case when i >= 5 and i < len - 5 then row_number() over (partition by doc_id, i >= 5 and i < len - 5 order by h, i) end as r from t)
  select doc_id, i, base, r, case when r <= a then 4 when r <= b then ('0x' || substr(h, 14, 8))::bigint % 4 else base end as masked, case when r <= c then base else -100 end as label from r)"""


@query(f"select doc_id, md5(string_agg(masked::int, '' order by i)) as masked, md5(string_agg(label::int, '' order by i)) as labels, count(*) filter (where label >= 0) as chosen, count(*) filter (where masked = 4) as hidden from {_MASKED} group by 1")
def mask_tokens(spark: SparkSession, folder: str) -> DataFrame:
    s = sequences(spark, folder).filter("seq <> ''").select("doc_id", sq.base_class("seq").alias("t"))
    m = arrays.masked_tokens(s, "doc_id", "t", frame=5)
    text = lambda c: F.md5(F.array_join(F.transform(c, lambda x: x.cast("string")), ""))
    count = lambda c, f: F.size(F.filter(c, f)).cast("long")
    return m.select("doc_id", text("masked").alias("masked"), text("labels").alias("labels"), count("labels", lambda x: x >= 0).alias("chosen"), count("masked", lambda x: x == 4).alias("hidden"))


@query("select page_id, unnest(regexp_extract_all(html, '<a\\s[^>]*?href=\"([^\"]*)\"', 1)) as href from pages")
def href_extract(spark: SparkSession, folder: str) -> DataFrame:
    from ..sources.files import links

    return links(table(spark, folder, "pages").select("page_id", "html"))


_MOTIFS = "(select distinct 'M' || (item_id % 5) as target, kmer from (select item_id, substr(s, i, 6) as kmer from (select item_id, s, unnest(range(1, length(s) - 4)) as i from (select item_id, translate(regexp_replace(lower(text), '[^a-z]', '', 'g'), 'abcdefghijklmnopqrstuvwxyz', 'ACGTACGTACGTACGTACGTACGTAC') as s from benchmark))) where length(kmer) = 6)"


def _motifs(spark: SparkSession, folder: str) -> DataFrame:
    items = table(spark, folder, "benchmark").select(F.concat(F.lit("M"), (F.col("item_id") % 5).cast("string")).alias("target"), sq.as_bases("text").alias("seq"))
    return items.select("target", F.explode(sq.kmers("seq", 6)).alias("motif")).distinct()


@query(f"select doc_id, target, count(*) as hits, count(distinct kmer) as motifs, min(i) - 1 as first_start from (select doc_id, substr(seq, i, 6) as kmer, i from (select doc_id, seq, unnest(range(1, length(seq) - 4)) as i from {S})) join {_MOTIFS} using (kmer) group by 1, 2")
def motif_hits(spark: SparkSession, folder: str) -> DataFrame:
    return km.motif_counts(sequences(spark, folder), "doc_id", "seq", _motifs(spark, folder), "target", "motif", 6)


@query(f"select doc_id, len(string_split(seq, 'ACG')) - 1 as n, case when instr(seq, 'ACG') > 0 then instr(seq, 'ACG') - 1 end as first_place from {S}")
def motif_places(spark: SparkSession, folder: str) -> DataFrame:
    places = sequences(spark, folder).select("doc_id", sq.match_places("seq", F.lit("ACG")).alias("p"))
    return places.select("doc_id", F.size("p").cast("long").alias("n"), F.get("p", F.lit(0)).cast("long").alias("first_place"))


# -- edits, masks and fields of a sequence -----------------------------------------------------------------------------

_SPOT = "(doc_id % 10)"
_MARKED = f"substr(seq, 1, {_SPOT}) || lower(substr(seq, {_SPOT} + 1, 3)) || substr(seq, {_SPOT} + 4)"


@query(
    f"""select doc_id, md5(seq) as dna, md5(replace(replace(seq, 'AC', '-'), '-', '')) as stripped, md5(replace(seq, 'AC', '-')) as gapped, md5(case when doc_id % 7 < 3 then repeat('N', (3 - doc_id % 7)::int) || seq else substr(seq, (doc_id % 7 - 3)::int + 1) end) as shifted,
  {_SPOT} as first_lower, {_SPOT} + 1 as median_lower, md5(substr(seq, 1, {_SPOT}) || '---' || substr(seq, {_SPOT} + 4)) as hidden, doc_id || '_' || length(seq) || '_A' as key,
  length(seq) as n_hot, (doc_id % 20) // 7 as first_token, (doc_id % 20 + 4) // 7 + 1 as stop_token from {S} where length(seq) >= 40"""
)
def sequence_edits(spark: SparkSession, folder: str) -> DataFrame:
    k = F.col("doc_id")
    s = sequences(spark, folder).filter("length(seq) >= 40")
    marked = sq.lower_at(sq.lower_at(sq.lower_at("seq", k % 10), k % 10 + 1), k % 10 + 2)
    window = sq.tokens_of_window(sq.chunks("seq", 7), k % 20, k % 20 + 5)
    hot = F.aggregate(F.flatten(sq.one_hot("seq")), F.lit(0), lambda t, x: t + x)
    return s.withColumn("marked", marked).select(
        "doc_id", F.md5(sq.dna(F.translate("seq", "T", "U"))).alias("dna"), F.md5(sq.strip_gaps(F.replace("seq", F.lit("AC"), F.lit("-")))).alias("stripped"), F.md5(sq.gap_strangers(F.replace("seq", F.lit("AC"), F.lit("X")))).alias("gapped"),
        F.md5(sq.shift("seq", k % 7 - 3)).alias("shifted"), sq.first_lower("marked").cast("long").alias("first_lower"), sq.median_lower("marked").cast("long").alias("median_lower"), F.md5(sq.mask_repeats("marked")).alias("hidden"),
        sq.variant_key(k, F.length("seq"), F.lit("A")).alias("key"), hot.cast("long").alias("n_hot"), window["first"].cast("long").alias("first_token"), window["stop"].cast("long").alias("stop_token"),
    )


@query(
    f"""with hits as (select doc_id, length(seq) as n, i - 1 as at_ from (select doc_id, seq, unnest(range(1, length(seq) - 1)) as i from {S}) where substr(seq, i, 3) = 'ACG'),
covered as (select doc_id, n, at_ + j as p from hits, (select unnest([0, 1, 2]) as j)), near as (select distinct doc_id, p + j as p from covered, (select unnest([-2, -1, 0, 1, 2, 3]) as j) where p + j >= 0 and p + j < n)
select doc_id, coalesce(c, 0) as covered, coalesce(m, 0) as near from {S} left join (select doc_id, count(*) as c from covered group by 1) using (doc_id) left join (select doc_id, count(*) as m from near group by 1) using (doc_id) where seq <> ''"""
)
def motif_masks(spark: SparkSession, folder: str) -> DataFrame:
    """How many places a motif's matches cover, and how many lie near them."""
    return km.motif_mask_sizes(sequences(spark, folder).filter("seq <> ''"), "doc_id", "seq", "ACG")


@query("select event_id, (event_id % 9)::varchar as depth, case when event_id % 2 = 0 then event_type end as state from events")
def format_fields(spark: SparkSession, folder: str) -> DataFrame:
    """Values of a sample by the keys of its format; keys without a value are null."""
    e = table(spark, folder, "events")
    even, depth = F.col("event_id") % 2 == 0, (F.col("event_id") % 9).cast("string")
    form, sample = F.when(even, "GT:DP:ST").otherwise("DP:GT:ST"), F.when(even, F.concat_ws(":", F.lit("0/1"), depth, "event_type")).otherwise(F.concat_ws(":", depth, F.lit("0/1")))
    return e.select("event_id", sq.format_value(form, sample, F.lit("DP")).alias("depth"), sq.format_value(form, sample, F.lit("ST")).alias("state"))


@query("select l_suppkey, l_linenumber, avg(l_quantity) as mean from lineitem group by 1, 2")
def segment_means(spark: SparkSession, folder: str) -> DataFrame:
    return ordered.segment_means(table(spark, folder, "lineitem"), ["l_suppkey"], "l_linenumber", "l_quantity")


_LINKS = "(select user_id, event_id * 10 as start, case when event_id % 4 = 0 then 9 else (lead(event_id) over (partition by user_id order by event_id) - event_id) * 10 end as length from events)"


@query(f"""with l as (select *, case when lag(start + length) over w <> start then 1 else 0 end as gap from {_LINKS} window w as (partition by user_id order by start)),
b as (select *, sum(gap) over (partition by user_id order by start rows unbounded preceding) as g from l) select user_id, start, length from b where g = 0""")
def contiguous_chain(spark: SparkSession, folder: str) -> DataFrame:
    """Rows of each user up to the first gap."""
    e = table(spark, folder, "events")
    following = F.lead("event_id").over(Window.partitionBy("user_id").orderBy("event_id"))
    rows = e.select("user_id", (F.col("event_id") * 10).alias("start"), F.when(F.col("event_id") % 4 == 0, 9).otherwise((following - F.col("event_id")) * 10).alias("length"))
    return ordered.contiguous_chain(rows, ["user_id"], "start", "length").select("user_id", "start", "length")


@query(
    """select coalesce(c.k, o.k, s.k) as k, coalesce(c.bal, 0) as base__bal, coalesce(o.n, 0)::double as orders__n, coalesce(s.cost, 0) as supply__cost from (select c_custkey as k, c_acctbal as bal from customer) c
full join (select o_custkey as k, count(*) as n from orders group by 1) o on o.k = c.k full join (select s_suppkey * 3 as k, s_acctbal as cost from supplier) s on s.k = coalesce(c.k, o.k)"""
)
def named_features(spark: SparkSession, folder: str) -> DataFrame:
    """Feature tables by name side by side as one vector, nulls as 0."""
    from pyspark.ml.functions import vector_to_array

    from ..operators import evaluate as ev

    tables = {
        "base": table(spark, folder, "customer").select(F.col("c_custkey").alias("k"), F.col("c_acctbal").alias("bal")), "orders": table(spark, folder, "orders").groupBy(F.col("o_custkey").alias("k")).agg(F.count(F.lit(1)).alias("n")),
        "supply": table(spark, folder, "supplier").select((F.col("s_suppkey") * 3).alias("k"), F.col("s_acctbal").alias("cost")), "unused": table(spark, folder, "nation").select(F.col("n_nationkey").alias("k")),
    }
    joined, names = ev.features_by_name(tables, ["base", "orders", "supply"], "k")
    x = ev.assembled(joined, names).select("k", vector_to_array("features").alias("x"))
    return x.select("k", *(F.get("x", F.lit(i)).alias(n) for i, n in enumerate(names)))
