"""Queries that write given tables in the formats of the library, read them back and work on what was read."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import sequence as sq
from ..operators import intervals as iv, joins, sampling as sp
from ..operators.checkpoints import scratch_folder
from ..sources import files
from ..streaming import streams
from .frames import SQL_SEQUENCES as S, intervals, points, sequences, sql_intervals, sql_points
from .registry import query, table

TILE = 64


def _genome(spark: SparkSession, folder: str) -> DataFrame:
    return sequences(spark, folder).select(F.col("doc_id").cast("string").alias("name"), "doc_id", "seq").filter("seq <> ''")


def _tiled(spark: SparkSession, folder: str) -> DataFrame:
    """Sequences in a tile store of the shared folder."""
    return files.write_tiles(_genome(spark, folder).drop("doc_id"), f"tiles_{uuid.uuid4().hex}", TILE, 16, scratch_folder(spark, "tiles"))


_VARIANT = f"(select doc_id, seq, length(seq) as n, (doc_id * 37) % length(seq) as pos, case when doc_id % 5 = 0 then 'T' else substr(seq, ((doc_id * 37) % length(seq) + 1)::int, 1) end as ref from {S} where seq <> '')"


def _variants(spark: SparkSession, folder: str) -> DataFrame:
    at = F.col("doc_id") * 37 % F.length("seq")
    return _genome(spark, folder).select("doc_id", "name", F.length("seq").cast("long").alias("n"), at.alias("pos"), F.when(F.col("doc_id") % 5 == 0, "T").otherwise(F.substr("seq", (at + 1).cast("int"), F.lit(1))).alias("ref"))


@query(
    f"""with w as (select *, greatest(pos - 150, least(10, n)) as low, least(pos + 150, greatest(n - 10, 0)) as high from {_VARIANT})
select doc_id, low as start, high as "end", md5(case when doc_id % 2 = 0 then substr(seq, (low + 1)::int, (high - low)::int) else reverse(translate(substr(seq, (low + 1)::int, (high - low)::int), 'ACGT', 'TGCA')) end) as digest from w where low < high"""
)
def fetched_windows(spark: SparkSession, folder: str) -> DataFrame:
    """Windows around variants, clipped to a region of their sequence, fetched from the tile store over several tiles, read on their strand."""
    v = _variants(spark, folder)
    start, end = iv.clipped(F.col("pos") - 150, F.col("pos") + 150, F.least(F.lit(10), F.col("n")), F.greatest(F.col("n") - 10, F.lit(0)))
    found = files.fetch(v.select("name", F.col("name").alias("contig"), start.alias("start"), end.alias("end")), _tiled(spark, folder), TILE)
    strand = F.when(F.col("name").cast("long") % 2 == 0, "+").otherwise("-")
    return found.select(F.col("name").cast("long").alias("doc_id"), "start", "end", F.md5(sq.on_strand("seq", strand)).alias("digest"))


@query(f"select count(*) filter (where ref <> substr(seq, (pos + 1)::int, 1)) as mismatches, count(*) as rows from {_VARIANT}")
def fetched_mismatches(spark: SparkSession, folder: str) -> DataFrame:
    """How many declared bases differ from the one that the tile store has."""
    v = _variants(spark, folder)
    base = files.fetch(v.select("name", F.col("name").alias("contig"), F.col("pos").alias("start"), (F.col("pos") + 1).alias("end")), _tiled(spark, folder), TILE)
    return joins.mismatches(v.join(base.select("name", F.col("seq").alias("observed")), "name"), "observed", "ref")[1]


_CHUNKS = f"(select doc_id, start, least(start + 99, n) as stop from (select doc_id, length(seq) as n, unnest(range(1, greatest(length(seq) - 10, 1), 90)) as start from {S} where seq <> '') where least(start + 99, n) - start + 1 >= 6)"


@query(
    f"""with c as (select doc_id || ':' || start || '-' || stop as chunk, * from {_CHUNKS}), o as (select *, row_number() over (order by md5(chunk || ':42'), chunk) - 1 as i, count(*) over () as n from c)
select chunk, (i // (n // 20 + 1))::int as shard, md5(substr(seq, start::int, (stop - start + 1)::int)) as digest from o join {S} using (doc_id)"""
)
def chunk_shards(spark: SparkSession, folder: str) -> DataFrame:
    """Overlapping chunks of sequences in a global random order, dealt into twenty shards with their bases from the tile store, written by shard and read back."""
    index = files.sequence_index(_genome(spark, folder))
    listed = sp.with_global_index(files.genome_chunks(index, 100, 10), "chunk", 42)
    whole = listed.agg(F.count(F.lit(1)).alias("whole"))  # one row
    dealt = listed.crossJoin(F.broadcast(whole)).withColumn("shard", F.expr("cast(index div (whole div 20 + 1) as int)"))
    bases = files.fetch(dealt.select(F.col("chunk").alias("name"), F.col("name").alias("contig"), (F.col("start") - 1).alias("start"), "end"), _tiled(spark, folder), TILE)
    path = scratch_folder(spark, "shards")
    files.write_shards(dealt.select("chunk", "shard").join(bases.select(F.col("name").alias("chunk"), "seq"), "chunk"), path, "shard")
    return spark.read.parquet(path).select("chunk", F.col("shard").cast("int").alias("shard"), F.md5("seq").alias("digest"))


# -- formats -----------------------------------------------------------------------------------------------------------


@query(f"select doc_id::varchar as name, length(seq) as length, md5(seq) as digest from {S} where seq <> ''")
def fasta_round_trip(spark: SparkSession, folder: str) -> DataFrame:
    path = scratch_folder(spark, "fasta")
    files.write_fasta(_genome(spark, folder), path)
    back = files.fasta(spark, path)
    return files.sequence_index(back).join(back, "name").select("name", "length", F.md5("seq").alias("digest"))


@query(f"select 'docs:' || doc_id as name, md5(seq) as digest from {S} where seq <> ''")
def species_round_trip(spark: SparkSession, folder: str) -> DataFrame:
    """Files whose name is their species, one from each task: names get it in front."""
    path = scratch_folder(spark, "species")
    files.write_fasta(_genome(spark, folder), f"{path}/parts")
    files.name_parts(spark, f"{path}/parts", path, "docs.fa")
    return files.merged_species(spark, f"{path}/*/docs.fa").select("name", F.md5("seq").alias("digest"))


_A = sql_intervals("signup", 6)


@query(f"""select 'c' || contig as contig, start, "end", name, strand, length(name)::double as score from {_A}""")
def bed_round_trip(spark: SparkSession, folder: str) -> DataFrame:
    path = scratch_folder(spark, "bed")
    i = intervals(spark, folder, "signup", 6)
    files.write_tsv(i.select(F.concat(F.lit("c"), F.col("contig").cast("string")).alias("contig"), "start", "end", "name", F.length("name").cast("double").alias("score"), "strand"), path)
    return files.bed(spark, path)


@query(f"""select contig::varchar as contig, pos as start, pos + 1 as "end", 'GT=' || ref || '/' || alt || ';AF=' || value as info, ref, alt, contig || '_' || (pos + 1) || '_' || ref || '_' || alt as id
from (select *, upper(left(event_type, 1)) as ref, case when point_id % 2 = 0 then 'A' else 'G' end as alt from {sql_points()} where value is not null)""")
def vcf_round_trip(spark: SparkSession, folder: str) -> DataFrame:
    """Variants written with their fields, read as intervals, their ids taken apart."""
    path = scratch_folder(spark, "vcf")
    ref, alt = F.upper(F.left("event_type", F.lit(1))), F.when(F.col("point_id") % 2 == 0, "A").otherwise("G")
    pos, contig = (F.col("pos") + 1).cast("string"), F.col("contig").cast("string")
    p = points(spark, folder).filter("value is not null").select(contig.alias("contig"), pos.alias("pos"), F.concat_ws("_", contig, pos, ref, alt).alias("id"), ref.alias("ref"), alt.alias("alt"), F.lit(".").alias("qual"), F.lit("PASS").alias("filter"), F.concat(F.lit("AF="), F.col("value").cast("string")).alias("info"), F.lit("GT").alias("format"), F.lit("0/1").alias("sample"))
    files.write_tsv(p, path)
    back = files.vcf(spark, path, ["contig", "pos", "id", "ref", "alt", "info"])
    known = files.variant_ids(back.select("id").distinct(), "id").select("id", "ref", "alt")
    return files.vcf_intervals(back).join(known, [F.regexp_extract("info", "GT=([A-Z]+)/", 1) == F.col("ref"), F.regexp_extract("info", "/([A-Z]+);", 1) == F.col("alt"), F.col("contig") == F.substring_index("id", "_", 1), F.col("end") == F.get(F.split("id", "_"), F.lit(1)).cast("long")]).select("contig", "start", "end", "info", "ref", "alt", "id")


@query(f"""select 'g' || (contig % 7) as gene, 't' || name as transcript, contig::varchar as contig, start, "end", strand from {_A} where contig % 2 = 0""")
def gtf_round_trip(spark: SparkSession, folder: str) -> DataFrame:
    """Rows of one feature with the names in their attributes."""
    path = scratch_folder(spark, "gtf")
    i = intervals(spark, folder, "signup", 6)
    attributes = F.concat(F.lit('gene_name "g'), (F.col("contig") % 7).cast("string"), F.lit('"; transcript_id "t'), F.col("name"), F.lit('";'))
    line = F.concat_ws("\t", F.col("contig").cast("string"), F.lit("own"), F.when(F.col("contig") % 2 == 0, "exon").otherwise("gene"), (F.col("start") + 1).cast("string"), F.col("end").cast("string"), F.lit("."), "strand", F.lit("."), attributes)
    i.select(line.alias("value")).write.text(path)
    return files.gtf(spark, path, "exon").select("gene", "transcript", "contig", "start", "end", "strand")


@query(f"""select contig::varchar as contig, unnest(range(pos + 1, pos + 2 + point_id % 3)) as pos, value as score from {sql_points("purchase")} where value is not null""")
def bedgraph_round_trip(spark: SparkSession, folder: str) -> DataFrame:
    """Runs of one score as a row for each base."""
    path = scratch_folder(spark, "bedgraph")
    p = points(spark, folder, "purchase").filter("value is not null")
    files.write_tsv(p.select(F.col("contig").cast("string").alias("contig"), "pos", (F.col("pos") + 1 + F.col("point_id") % 3).alias("end"), "value"), path)
    return files.bedgraph(spark, path)


@query(f"""select species, contig, start, size, strand, contig_length, md5(seq) as digest from (
  select 'ref' as species, 'c' || (doc_id % 5) as contig, doc_id * 10 as start, 20 as size, '+' as strand, 100000000 as contig_length, left(seq, 20) as seq from {S} where length(seq) >= 20
  union all select 'other', 'd' || (doc_id % 3), doc_id * 7, 18, '-', 90000000, left(seq, 9) || '--' || substr(seq, 12, 9) from {S} where length(seq) >= 20)""")
def maf_round_trip(spark: SparkSession, folder: str) -> DataFrame:
    """Alignment blocks of two rows; starts on the other strand are turned and turned back."""
    path = scratch_folder(spark, "maf")
    s = sequences(spark, folder).filter("length(seq) >= 20")
    k = F.col("doc_id")
    row = lambda n, species, contig, start, size, strand, whole, seq: F.struct(F.lit(n).alias("row"), F.lit(species).alias("species"), contig.alias("contig"), start.alias("start"), F.lit(size).cast("long").alias("size"), F.lit(strand).alias("strand"), F.lit(whole).cast("long").alias("contig_length"), seq.alias("seq"))
    rows = F.array(
        row(0, "ref", F.concat(F.lit("c"), (k % 5).cast("string")), k * 10, 20, "+", 100000000, F.left("seq", F.lit(20))),
        row(1, "other", F.concat(F.lit("d"), (k % 3).cast("string")), k * 7, 18, "-", 90000000, F.concat(F.left("seq", F.lit(9)), F.lit("--"), F.substr("seq", F.lit(12), F.lit(9)))),
    )
    files.write_maf(s.select(k.alias("block"), F.explode(rows).alias("r")).select("block", "r.*"), path)
    return files.maf(spark, path).select("species", "contig", "start", "size", "strand", "contig_length", F.md5("seq").alias("digest"))


@query("select c_custkey as key, case when c_custkey % 3 = 0 then c_mktsegment else c_name end as who, c_acctbal as value, case when c_custkey % 2 = 0 then 7 else -1 end as extra from customer")
def sharded_results(spark: SparkSession, folder: str) -> DataFrame:
    """Result files of which the later one by name wins, with a default for a column that only one of them has."""
    path = scratch_folder(spark, "results")
    c = table(spark, folder, "customer").select(F.col("c_custkey").alias("key"), F.col("c_name").alias("who"), F.col("c_acctbal").alias("value"), "c_mktsegment")
    c.drop("c_mktsegment").filter("key % 2 = 1 or key % 3 <> 0").coalesce(1).write.parquet(f"{path}/run=1")
    c.select("key", F.when(F.col("key") % 3 == 0, F.col("c_mktsegment")).otherwise(F.col("who")).alias("who"), "value", F.when(F.col("key") % 2 == 0, 7).alias("extra")).filter("key % 2 = 0 or key % 3 = 0").coalesce(1).write.parquet(f"{path}/run=2")
    return files.later_wins(spark, path, "key", {"extra": -1}).select("key", "who", "value", "extra")


@query("select n_name as name, coalesce(case when n_nationkey % 2 = 0 then 'N' || n_nationkey end, n_name) as renamed from nation")
def renamed_by_file(spark: SparkSession, folder: str) -> DataFrame:
    """Names replaced by those of a rename file; the others stay."""
    path = scratch_folder(spark, "names")
    n = table(spark, folder, "nation").withColumn("n_name", F.col("n_name"))
    n.filter("n_nationkey % 2 = 0").select(F.concat_ws("  ", F.regexp_replace("n_name", " ", "~"), F.concat(F.lit("N"), F.col("n_nationkey").cast("string"))).alias("value")).write.text(path)
    names = files.rename_map(spark, path).withColumn("old", F.regexp_replace("old", "~", " "))
    return files.renamed(n.select(F.col("n_name").alias("name"), F.col("n_name").alias("renamed")), "renamed", names)


@query(f"select md5(seq) as digest, count(*) as n from {S} where seq <> '' group by 1")
def streamed_sequences(spark: SparkSession, folder: str) -> DataFrame:
    """Sequence files read as a stream into a table, in two runs of which the second finds only what is new."""
    path = scratch_folder(spark, "stream")
    lines = _genome(spark, folder).select(F.col("seq").alias("value"), "doc_id")
    for parity in (0, 1):
        lines.filter(F.col("doc_id") % 2 == parity).select("value").write.mode("append").text(f"{path}/in")
        streams.to_parquet(streams.sequence_lines(spark, f"{path}/in"), f"{path}/out", f"{path}/state").awaitTermination()
    return spark.read.parquet(f"{path}/out").groupBy(F.md5("seq").alias("digest")).agg(F.count(F.lit(1)).alias("n"))
