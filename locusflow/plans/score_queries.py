"""Queries over per-position probabilities of models: influence of a change, scores of variants and motifs, and the AUC tables that follow; fields of sample columns and logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import arrays, sequence as sq
from ..operators import kmers as km, metrics as mt, ordered
from ..sources.files import training_log
from .frames import SQL_LABELLED as L, SQL_SEQUENCES as S, sequences
from .metric_queries import _auc
from .registry import query, table

#: A vector as sixteen rows of four values, on a grid of tenths so that zeros and certainties occur; the letter (id + place) mod 4 has some mass everywhere.
_M = """(select vec_id, label, list_transform(range(0, 16), lambda i: list_transform(range(0, 4), lambda b: floor(abs(embedding[4 * i + b + 1]::double) * 10) / 10 + case when b = (vec_id + i) % 4 then 0.1::double else 0::double end)) as m from embeddings where embedding is not null)"""
_ROWS = "list_transform({m}, lambda r: list_transform(r, lambda x: x / list_sum(r)))"
_E = "1e-14::double"


def _matrices(spark: SparkSession, folder: str) -> DataFrame:
    e = table(spark, folder, "embeddings").filter("embedding is not null")
    value = lambda i, b: F.floor(F.abs(F.get("embedding", 4 * i + b).cast("double")) * 10) / 10 + F.when(b == (F.col("vec_id") + i) % 4, 0.1).otherwise(0.0)
    places = lambda n: F.array(*map(F.lit, range(n)))
    return e.select("vec_id", "label", F.transform(places(16), lambda i: F.transform(places(4), lambda b: value(i, b))).alias("m"))


_ODDS = f"(log2(x + {_E}) - log2(1 - x + {_E}))"
#: Influence of the next vector's matrix on this one's.
_INFLUENCE = f"""(select vec_id, label, list_transform(range(1, 17), lambda i: list_max(list_transform(range(1, 5), lambda b: abs(a[i][b] - c[i][b])))) as d from (
  select x.vec_id, x.label, list_transform({_ROWS.format(m='x.m')}, lambda r: list_transform(r, lambda x: {_ODDS})) as a, list_transform({_ROWS.format(m='y.m')}, lambda r: list_transform(r, lambda x: {_ODDS})) as c
  from {_M} x join {_M} y on y.vec_id = x.vec_id + 1))"""


def _influences(spark: SparkSession, folder: str) -> DataFrame:
    x = _matrices(spark, folder)
    y = x.select((F.col("vec_id") - 1).alias("vec_id"), F.col("m").alias("other"))
    return x.join(y, "vec_id").select("vec_id", "label", arrays.influence("m", "other").alias("d"))


@query(f"select vec_id, (list_sum(d) - d[9]) / 15 as vis, d[1] as first_place, list_max(d) as most from {_INFLUENCE}")
def influence_scores(spark: SparkSession, folder: str) -> DataFrame:
    return _influences(spark, folder).select("vec_id", arrays.mean_without("d", 8).alias("vis"), F.get("d", F.lit(0)).alias("first_place"), F.array_max("d").alias("most"))


@query(
    f"""with w as (select vec_id, label, radius, list_avg(list_transform(list_filter(range(greatest(8 - radius, 0), 8 + radius), lambda i: i <> 8 and i < 16), lambda i: d[i + 1])).round(9) as vis from {_INFLUENCE}, (select unnest([2, 4, 8]) as radius))
select radius, n_pos, n_neg, auc, greatest(auc, 1 - auc) as auc_either from {_auc("(select radius, vis, (label >= 5)::int as y from w)", "radius", "vis", "y")}"""
)
def influence_by_width(spark: SparkSession, folder: str) -> DataFrame:
    """AUC of the influence around a change against the width of the window that it is averaged over."""
    d = _influences(spark, folder).withColumn("radius", F.explode(F.array(*map(F.lit, (2, 4, 8))))).select("radius", F.round(arrays.mean_around("d", 8, F.col("radius")), 9).alias("vis"), (F.col("label") >= 5).cast("int").alias("y"))
    return mt.roc_auc(d, ["radius"], "vis", "y").withColumn("auc_either", mt.either_way(F.col("auc")))


_PROBS = f"(select vec_id, label, m[9][vec_id % 4 + 1] / list_sum(m[9]) as p, m[9][(vec_id + 1) % 4 + 1] / list_sum(m[9]) as q from {_M})"


@query(
    f"""select p.vec_id, case when p.vec_id % 2 = 0 then (list_sum(d) - d[9]) / 15 end as vis, case when p.vec_id % 2 = 1 then ln(p + {_E}) end as pref, case when p.vec_id % 2 = 1 then -ln(q + {_E}) end as palt_inv,
  case when p.vec_id % 2 = 1 then ln(p + {_E}) - ln(q + {_E}) end as pratio from {_PROBS} p left join {_INFLUENCE} i on i.vec_id = p.vec_id"""
)
def variant_model_scores(spark: SparkSession, folder: str) -> DataFrame:
    """Scores of variants by models: the influence where there are probabilities of the changed sequence, log probabilities of both alleles where there are not."""
    x = _matrices(spark, folder)
    row = arrays.normalised(F.get("m", F.lit(8)))
    ref, alt, ratio = arrays.log_scores(F.get(row, (F.col("vec_id") % 4).cast("int")), F.get(row, ((F.col("vec_id") + 1) % 4).cast("int")))
    changed = _influences(spark, folder).select("vec_id", arrays.mean_without("d", 8).alias("vis"))
    single = F.col("vec_id") % 2 == 1
    return x.join(changed, "vec_id", "left").select("vec_id", F.when(~single, F.col("vis")).alias("vis"), *(F.when(single, c).alias(n) for c, n in ((ref, "pref"), (alt, "palt_inv"), (ratio, "pratio"))))


#: A motif of five letters that begins at id mod 12; its letter at place i is (3 id + i) mod 4.
_MOTIF = f"""(select vec_id, label, m, list_transform(range(0, 5), lambda j: m[vec_id % 12 + j + 1][(3 * vec_id + vec_id % 12 + j) % 4 + 1] / list_sum(m[vec_id % 12 + j + 1])) as p,
  list_transform(range(0, 5), lambda j: list_min(list_transform(list_filter(range(0, 4), lambda b: b <> (3 * vec_id + vec_id % 12 + j) % 4), lambda b: m[vec_id % 12 + j + 1][b + 1])) / list_sum(m[vec_id % 12 + j + 1])) as q,
  list_transform(range(0, 5), lambda j: m[vec_id % 12 + j + 1][1]) as t from {_M})"""
_LOGS = f"list_transform(range(1, 6), lambda j: ln(p[j] + {_E}) - ln(q[j] + {_E}))"
_LEAST = f"list_transform(q, lambda x: -ln(x + {_E}))"
_SCORES = f"(select vec_id, label, list_avg(p) as ref_mean, list_avg({_LEAST}) as alt_mean, list_avg({_LOGS}) as ratio_mean, list_max(p) as ref_max, list_max({_LEAST}) as alt_max, list_max({_LOGS}) as ratio_max, list_max(t) as track from {_MOTIF})"


def _motif_scores(spark: SparkSession, folder: str) -> DataFrame:
    x = _matrices(spark, folder).withColumn("start", (F.col("vec_id") % 12).cast("int"))
    letters = F.transform(F.array(*map(F.lit, range(16))), lambda i: F.substr(F.lit("ACGT"), ((3 * F.col("vec_id") + i) % 4 + 1).cast("int"), F.lit(1)))
    x = x.withColumn("seq", F.array_join(letters, ""))
    scores = {f"{n}_{how}": c for how in ("mean", "max") for n, c in zip(("ref", "alt", "ratio"), arrays.motif_scores("m", "seq", F.col("start"), 5, how), strict=True)}
    track = arrays.track_score(F.transform("m", lambda row: F.get(row, F.lit(0))), F.col("start"), 5)
    return x.select("vec_id", "label", *(c.alias(n) for n, c in scores.items()), track.alias("track"))


@query(f"select vec_id, ref_mean, alt_mean, ratio_mean, ref_max, alt_max, ratio_max, track from {_SCORES}")
def motif_model_scores(spark: SparkSession, folder: str) -> DataFrame:
    return _motif_scores(spark, folder).drop("label")


_C6 = f"""with s as (select *, (label >= 5)::int as y from {_SCORES}), edges as (select label, quantile_cont(track, 0.9) as hi, quantile_cont(track, 0.1) as lo from s where y = 1 group by 1),
flagged as (select s.*, coalesce(track >= hi, false) as top, coalesce(track <= lo, false) as bottom from s left join edges using (label)),
long as (select y, top, bottom, unnest(['track', 'LM-mean', 'LM-max']) as model, unnest([track, ratio_mean, ratio_max]) as score from flagged),
t as (select model, 'all' as how, score, y from long union all select model, 'top', score, y from long where y = 0 or top union all select model, 'bottom', score, y from long where y = 0 or bottom)"""


@query(f"{_C6} select model, how, n_pos, n_neg, auc from {_auc('t', 'model, how', 'score', 'y')}")
def motif_model_auc(spark: SparkSession, folder: str) -> DataFrame:
    """Motif scores of models, marked by the top and bottom tenth of conservation among functional motifs of each group, to AUC over all, top and bottom motifs."""
    s = _motif_scores(spark, folder).withColumn("y", (F.col("label") >= 5).cast("int"))
    edges = mt.group_percentiles(s.filter("y = 1"), ["label"], "track", (0.1, 0.9))
    marked = s.join(edges, "label", "left").withColumns({"top": F.coalesce(F.col("track") >= F.get("percentiles", F.lit(1)), F.lit(False)), "bottom": F.coalesce(F.col("track") <= F.get("percentiles", F.lit(0)), F.lit(False))})
    models = F.array(*(F.struct(F.lit(n).alias("model"), F.col(c).alias("score")) for n, c in (("track", "track"), ("LM-mean", "ratio_mean"), ("LM-max", "ratio_max"))))
    long = marked.select("y", "top", "bottom", F.explode(models).alias("m")).select("y", "top", "bottom", "m.*")
    return mt.auc_over_subsets(long, ["model"], "score", "y", {"top": F.col("top"), "bottom": F.col("bottom")}).withColumnRenamed("subset", "how")


# -- fields ------------------------------------------------------------------------------------------------------------

_ALLELE = "case event_id % 4 when 0 then 'A' when 1 then 'C' when 2 then 'A,C' else 'AC' end"


@query(
    f"""with e as (select event_id, user_id, {_ALLELE} as ref, case when event_id % 3 = 0 then 'G' else 'T' end as alt, event_id % 4 = 3 as indel, list_sort([1, (user_id % 5) + 2]) as r from events)
select event_id, case when contains(ref, ',') then -1 else user_id % 10 + case when indel then 50 when ref = 'A' then 10 else 20 end end as ref_depth,
  case when contains(ref, ',') then -1 else user_id % 10 + case when indel then 60 when alt = 'G' then 30 else 40 end end as alt_depth,
  case when length(ref) = 1 then 'SNP' when length(ref) > 1 then 'DEL' end as kind, case when length(ref) = 1 then 'SNP' else 'DEL' end as kind_by_change,
  list_concat([(user_id % 7)::int], range(r[1]::int, r[2]::int + 1, 2)) as places from e"""
)
def sample_fields(spark: SparkSession, folder: str) -> DataFrame:
    """Depths from format and sample strings, kinds of changes and lists of ranges."""
    k, u = F.col("event_id"), F.col("user_id")
    ref = F.when(k % 4 == 0, "A").when(k % 4 == 1, "C").when(k % 4 == 2, "A,C").otherwise("AC")
    alt, indel = F.when(k % 3 == 0, "G").otherwise("T"), k % 4 == 3
    n = lambda x: F.concat((u % 10 + x).cast("string"), F.lit(",7"))
    form = F.when(indel, "DP:TAR:TIR").otherwise("DP:AU:CU:GU:TU")
    sample = F.when(indel, F.concat_ws(":", F.lit("9"), n(50), n(60))).otherwise(F.concat_ws(":", F.lit("9"), n(10), n(20), n(30), n(40)))
    depths = sq.allele_depths(form, sample, ref, alt)
    places = sq.range_list(F.format_string("%d,1:%d:2", u % 7, u % 5 + 2))
    return table(spark, folder, "events").select(
        "event_id", depths["ref"].cast("long").alias("ref_depth"), depths["alt"].cast("long").alias("alt_depth"), sq.variant_type(ref, alt).alias("kind"), sq.variant_type_by_change(ref, alt).alias("kind_by_change"), places.alias("places")
    )


@query(
    """select ts, n_sequences, epoch, checkpoint, split, metric, value from (select date_trunc('second', ts) as ts, event_id * 2 as n_sequences, (user_id % 5)::int as epoch, case when event_id % 3 > 0 then (event_id % 11)::int end as checkpoint,
  case when event_id % 2 = 0 then 'train' else 'test' end as split, unnest(['loss', 'total acc']) as metric, unnest([value, user_id / 4.0]) as value from events where value is not null and event_type <> 'view')"""
)
def log_metrics(spark: SparkSession, folder: str) -> DataFrame:
    """Metrics read back from log lines, of checkpoints and of epochs alone."""
    k, u = F.col("event_id"), F.col("user_id").cast("long")
    time, split = F.date_format("ts", "yyyy/MM/dd-HH:mm:ss"), F.when(k % 2 == 0, "train").otherwise("test")
    tail = F.concat(F.lit("sequences: "), (k * 2).cast("string"), F.lit("), loss: "), F.col("value").cast("string"), F.lit(", total acc: "), (u / 4).cast("string"))
    by_checkpoint = F.concat(F.lit("checkpoint "), (k % 11).cast("string"), F.lit(" - "), split, F.lit(" (epoch: "), (u % 5).cast("string"), F.lit("; "), tail)
    by_epoch = F.concat(F.lit("epoch "), (u % 5).cast("string"), F.lit(" - "), split, F.lit(" ("), tail)
    e = table(spark, folder, "events").filter("value is not null and event_type <> 'view'")
    lines = e.select(F.concat(F.lit("["), time, F.lit("] "), F.when(k % 3 > 0, by_checkpoint).otherwise(by_epoch)).alias("value"))
    return training_log(lines).withColumn("ts", F.col("ts").cast("timestamp_ntz"))


@query("""with h as (select user_id, day(ts)::int as epoch, min(event_id) as first, min_by(epoch_us(ts) // 1000000, event_id) as sec from events group by 1, 2)
select user_id, epoch, lead(first) over w - first as length, lead(sec) over w - sec as seconds from h window w as (partition by user_id order by epoch)""")
def epoch_times(spark: SparkSession, folder: str) -> DataFrame:
    e = table(spark, folder, "events").withColumn("epoch", F.dayofmonth("ts"))
    return ordered.epoch_lengths(e, ["user_id"], "event_id", "epoch", "event_id", "ts").select("user_id", "epoch", "length", "seconds")


# -- columns of an alignment and bins --------------------------------------------------------------------------------------


@query(
    f"""with s as (select doc_id, source, case when doc_id % 2 = 0 then seq else lower(substr(seq, 1, 30)) || substr(seq, 31) end as seq from {S} where length(seq) >= 60),
first as (select source, min_by(seq, doc_id) as ref from s group by 1), v as (select doc_id, source, (doc_id % 60)::int as pos, case when doc_id % 3 = 0 then '-' else '+' end as strand, substr('ACGT', (doc_id % 4 + 1)::int, 1) as ref, substr('CGTA', (doc_id % 4 + 1)::int, 1) as alt from s),
c as (select v.doc_id, count(*) as depth, count(*) filter (where upper(substr(s.seq, pos + 1, 1)) = case when strand = '-' then translate(v.ref, 'ACGT', 'TGCA') else v.ref end) as r,
  count(*) filter (where upper(substr(s.seq, pos + 1, 1)) = case when strand = '-' then translate(v.alt, 'ACGT', 'TGCA') else v.alt end) as a from v join s using (source) group by 1)
select doc_id, depth, r / depth::double as ref_share, a / depth::double as alt_share, regexp_matches(substr(first.ref, pos + 1, 1), '[a-z]') as in_repeat from v join c using (doc_id) join first using (source)"""
)
def depth_by_strand(spark: SparkSession, folder: str) -> DataFrame:
    """Depth and allele shares of an alignment column, alleles read on the variant's strand, and whether the reference has a repeat there."""
    k = F.col("doc_id")
    s = sequences(spark, folder).filter("length(seq) >= 60").withColumn("seq", F.when(k % 2 == 0, F.col("seq")).otherwise(F.concat(F.lower(sq.piece("seq", 0, 30)), F.substr("seq", F.lit(31)))))
    base = lambda word: F.substr(F.lit(word), (k % 4 + 1).cast("int"), F.lit(1))
    v = s.select("doc_id", "source", (k % 60).cast("int").alias("pos"), F.when(k % 3 == 0, "-").otherwise("+").alias("strand"), base("ACGT").alias("ref"), base("CGTA").alias("alt"))
    reference = s.groupBy("source").agg(F.min_by("seq", "doc_id").alias("reference"))
    found = km.depth_at(km.column_counts(s, "source", "seq"), v, ["source", "pos"], "strand").join(reference, "source")
    return found.select("doc_id", "depth", "ref_share", "alt_share", km.in_repeat("reference", F.col("pos")).alias("in_repeat"))


_EDGES = (0, 128, 256, 512, 1024, 2048, 4096)


@query(
    f"""with b as (select *, case {' '.join(f"when n_chars > {a} and n_chars <= {b} then {i}" for i, (a, b) in enumerate(zip(_EDGES, _EDGES[1:])))} end as bin from (select *, (doc_id % 97)::double as arbitrary from {L}))
select bin, n_pos, n_neg, auc from {_auc("(select * from b where bin is not null)", "bin", "arbitrary")}"""
)
def auc_by_bin(spark: SparkSession, folder: str) -> DataFrame:
    """AUC within bins of fixed edges, open on the left."""
    from .frames import labelled

    d = labelled(spark, folder).withColumns({"arbitrary": (F.col("doc_id") % 97).cast("double"), "bin": mt.edge_bin(F.col("n_chars"), _EDGES)})
    return mt.roc_auc(d.filter("bin is not null"), ["bin"], "arbitrary", "quality")


@query("select vec_id, list_slice(e, case when vec_id % 5 = 0 then 1 else (vec_id % 7 + 1) end, case when vec_id % 5 = 0 then 0 else vec_id % 7 + 1 + vec_id % 9 end) as kept from (select vec_id, list_transform(embedding, lambda x: x::double) as e from embeddings where embedding is not null)")
def lower_window(spark: SparkSession, folder: str) -> DataFrame:
    """Outputs between the first and the last lower-case base."""
    k = F.col("vec_id")
    marked = F.concat(F.repeat(F.lit("A"), (k % 7).cast("int")), F.when(k % 9 == 0, "c").otherwise(F.concat(F.lit("c"), F.repeat(F.lit("G"), (k % 9 - 1).cast("int")), F.lit("t"))))
    seq = F.when(k % 5 == 0, F.repeat(F.lit("A"), F.lit(64))).otherwise(F.rpad(marked, 64, "A"))
    e = table(spark, folder, "embeddings").filter("embedding is not null")
    return e.select("vec_id", arrays.only_lower(F.transform("embedding", lambda x: x.cast("double")), seq).alias("kept"))


# -- tokens ------------------------------------------------------------------------------------------------------------

_WORDS = "(select vec_id, i, substr('ACGT', i // 16 + 1, 1) || substr('ACGT', i // 4 % 4 + 1, 1) || substr('ACGT', i % 4 + 1, 1) as token, abs(embedding[i + 1]::double) as p from (select *, unnest(range(0, 64)) as i from embeddings where embedding is not null))"


@query(
    f"""with w as (select * from {_WORDS}), o as (select unnest([0, 1, 2]) as off), b as (select unnest(['A', 'C', 'G', 'T']) as base),
every as (select vec_id, off, substr(token, off + 1, 1) as base, sum(p) as p_all from w, o group by 1, 2, 3),
truth as (select vec_id, token as t from w where i = vec_id % 64),
single as (select t.vec_id, off, base, p as p_single from truth t, o, b join w on w.vec_id = t.vec_id and w.token = substr(t.t, 1, off) || base || substr(t.t, off + 2))
select vec_id, off::int as "offset", base, p_all, p_single from every join single using (vec_id, off, base)"""
)
def token_bases(spark: SparkSession, folder: str) -> DataFrame:
    """Token probabilities as those of single bases: over all tokens with the base at the offset, and over the one that differs from the true token there."""
    words = [a + b + c for a in km.BASES for b in km.BASES for c in km.BASES]
    e = table(spark, folder, "embeddings").filter("embedding is not null")
    tokens = e.select("vec_id", F.posexplode("embedding").alias("i", "x")).select("vec_id", "i", F.get(F.array(*map(F.lit, words)), F.col("i")).alias("token"), F.abs(F.col("x").cast("double")).alias("p"))
    truth = tokens.filter("i = vec_id % 64").select("vec_id", F.col("token").alias("true_token"))
    every = km.token_base_probabilities(tokens, ["vec_id"], "token", "p", km.token_dictionary(tokens, "token", 3)).withColumnRenamed("p", "p_all")
    single = km.substituted_base_probabilities(tokens, ["vec_id"], "token", "p", truth, "true_token").withColumnRenamed("p", "p_single")
    return every.join(single, ["vec_id", "offset", "base"]).select("vec_id", "offset", "base", "p_all", "p_single")


@query(f"select doc_id, (doc_id % 8)::int as shard, length(seq)::double as length, (length(seq) - length(replace(replace(seq, 'C', ''), 'G', ''))) / length(seq)::double as gc from {S} where seq <> ''")
def resumed_scores(spark: SparkSession, folder: str) -> DataFrame:
    """A batch scorer that is run over some shards, then over all: finished ones are kept as they are."""
    from ..operators.checkpoints import scratch_folder
    from ..operators.evaluate import score_missing

    def scorer(batch):
        gc = batch.seq.str.count("[CG]") / batch.seq.str.len()
        return batch.assign(length=batch.seq.str.len().astype(float), gc=gc)[["doc_id", "shard", "length", "gc"]]

    s = sequences(spark, folder).filter("seq <> ''").select("doc_id", (F.col("doc_id") % 8).cast("int").alias("shard"), "seq")
    path, schema = scratch_folder(spark, "scores"), "doc_id long, shard int, length double, gc double"
    score_missing(s.filter("shard < 3"), "shard", path, scorer, schema)
    return score_missing(s, "shard", path, scorer, schema).select("doc_id", "shard", "length", "gc")


@query(
    """with m as (select lang, lim, n_chars::double as y, least(n_chars, lim) + doc_id % 50 as p from documents, (select unnest([200, 800, 3200]) as lim) union all select lang, null, n_chars::double, n_chars + doc_id % 50 from documents),
r as (select lang, coalesce(lim::varchar, 'whole') as longest, corr(y, p) as r, count(*) as n from m group by 1, 2), c as (select lang, longest, format('{:.2f}±{:.2f}', r, case when n > 3 then (tanh(atanh(r) + 1.96 / sqrt(n - 3)) - tanh(atanh(r) - 1.96 / sqrt(n - 3))) / 2 end) as cell from r)
select longest, max(cell) filter (where lang = 'en') as en, max(cell) filter (where lang = 'fr') as fr from c group by 1"""
)
def length_experiment(spark: SparkSession, folder: str) -> DataFrame:
    """Pearson's r, with its interval, of predictions from sequences cut at several lengths and from whole ones, as a table of lengths by group."""
    from ..sources.files import tagged_union

    d = table(spark, folder, "documents").select("lang", F.col("n_chars").cast("double").alias("y"), "n_chars", "doc_id")
    runs = {(str(m) if m else "whole",): d.withColumn("p", ((F.least("n_chars", F.lit(m)) if m else F.col("n_chars")) + F.col("doc_id") % 50).cast("double")) for m in (200, 800, 3200, None)}
    r = mt.pearson_ci(tagged_union(runs, ["longest"]), ["longest", "lang"], "y", "p")
    cell = F.format_string("%.2f±%.2f", F.col("r"), F.col("half_width"))
    return r.withColumn("cell", cell).groupBy("longest").pivot("lang", ["en", "fr"]).agg(F.max("cell"))
