"""Queries over matches of motif places, fragments of alignments, and regions that follow an anchor."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import sequence as sq
from ..operators import alignment as al
from ..operators import intervals as iv
from ..operators import matching, ordered
from .frames import SQL_SEQUENCES as S
from .frames import intervals, sequences, sql_intervals
from .registry import query, table

# -- motif places of a reference sequence and of the others of its source -----------------------------------------------

_MOTIFS = ("ACGGT", "CATGA")
_PLACES = f"""(select source, doc_id, motif, spot from (select source, doc_id, seq, motif, unnest(range(0, length(seq) - 4)) as spot from {S}, (select unnest({list(_MOTIFS)}) as motif)) where substr(seq, spot + 1, 5) = motif)"""
#: The matrix rule: every allowed pair of a place and another, the smallest gap taken, its row and column struck out, and again.
_MATCHED = f"""with recursive places as {_PLACES}, first as (select source, min(doc_id) as doc_id from documents group by 1),
refs as (select source, motif, spot as place, lag(spot) over w as low, lead(spot) over w as high from places join first using (source, doc_id) window w as (partition by source, motif order by spot)),
tests as (select p.source, p.doc_id, p.motif, p.spot as other from places p join first f on f.source = p.source and f.doc_id <> p.doc_id),
cand as (select source, motif, doc_id, place, other, abs(place - other) as gap from refs join tests using (source, motif)
  where (place >= other and (low is null or place - other < place - low)) or (place < other and (high is null or other - place < high - place))),
rem as (select *, min(struct_pack(g := gap, p := place, o := other)) over (partition by source, motif, doc_id) as best from cand
  union all select source, motif, doc_id, place, other, gap, min(struct_pack(g := gap, p := place, o := other)) over (partition by source, motif, doc_id) from rem where place <> best.p and other <> best.o),
matched as (select source, motif, doc_id, place, other, gap from rem where place = best.p and other = best.o)"""


def _matches(spark: SparkSession, folder: str) -> DataFrame:
    s = sequences(spark, folder).withColumn("motif", F.explode(F.array(*map(F.lit, _MOTIFS))))
    # neither motif overlaps itself
    places = s.select("source", "doc_id", "motif", F.explode(sq.match_places("seq", F.col("motif"))).alias("at"))
    first = table(spark, folder, "documents").groupBy("source").agg(F.min("doc_id").alias("first"))
    marked = places.join(first, "source")
    own, others = marked.filter("doc_id = first"), marked.filter("doc_id <> first")
    # every other sequence is matched with the reference's places on its own
    lanes = others.select("source", "motif", "doc_id").distinct()
    refs = own.select("source", "motif", F.col("at").alias("place")).join(lanes, ["source", "motif"])
    return matching.best_matches(refs, others.select("source", "motif", "doc_id", F.col("at").alias("other")), ["source", "motif", "doc_id"])


@query(f"{_MATCHED} select source, motif, doc_id, place, other, gap from matched")
def motif_matches(spark: SparkSession, folder: str) -> DataFrame:
    return _matches(spark, folder).select("source", "motif", "doc_id", "place", "other", "gap")


_TOLERANCES = (5, 50, 500)


@query(
    f"""{_MATCHED}, n as (select source, motif, place, count(*) filter (where gap <= 0) as within_0, {', '.join(f"count(*) filter (where gap <= {r}) as within_{r}" for r in _TOLERANCES)} from matched group by 1, 2, 3)
select *, {', '.join(f"(within_{r} - within_0) / (within_{r} + 1.0::double) as mobility_{r}" for r in _TOLERANCES)} from n"""
)
def motif_mobility(spark: SparkSession, folder: str) -> DataFrame:
    """Conservation and mobility of every place of a motif in the reference sequence: in how many others it has a match, at which tolerance."""
    return ordered.within_tolerances(_matches(spark, folder), ["source", "motif", "place"], "gap", _TOLERANCES)


# -- alignments ----------------------------------------------------------------------------------------------------------

#: Blocks of ten columns of a document, with a reference row, and a fragment each of two contigs of one species, one of them twice.
_BLOCK = f"(select doc_id, seq, unnest(range(0, least(length(seq) // 10, 8)))::int as block from {S})"
_PIECE = "substr(seq, block * 10 + 1, 10)"


def _fragments(spark: SparkSession, folder: str) -> DataFrame:
    blocks = sequences(spark, folder).filter("length(seq) >= 10").select("doc_id", "seq", F.explode(F.expr("sequence(0, cast(least(length(seq) div 10, 8) as int) - 1)")).alias("block"))
    own = F.substr("seq", F.col("block") * 10 + 1, F.lit(10))
    k, b = F.col("doc_id"), F.col("block").cast("long")
    row = lambda n, species, contig, start, size, strand, seq: F.struct(F.lit(n).alias("row"), F.lit(species).alias("species"), F.lit(contig).alias("contig"), start.alias("start"), F.lit(size).cast("long").alias("size"), F.lit(strand).alias("strand"), seq.alias("seq"))
    rows = F.array(
        row(0, "ref", "r", b * 10, 10, "+", own), row(1, "s1", "a", 100 + b * 10 + (k * 7 + b * 13) % 4 * 20, 10, "+", F.translate(own, "A", "C")),
        row(2, "s1", "a", 100 + b * 10 + (k + b * 5) % 3 * 15, 10, "+", F.translate(own, "G", "T")), row(3, "s1", "b", 5000 - b * 10 - (k * 3 + b) % 3 * 30, 8, "-", F.concat(F.lit("--"), F.substr(own, F.lit(3), F.lit(8)))),
    )
    return blocks.select("doc_id", "block", F.lit(10).alias("width"), F.explode(rows).alias("r")).select("doc_id", "block", "width", "r.*")


_FRAGMENTS = f"""(select doc_id, block, 0 as row, 'ref' as species, 'r' as contig, block * 10::bigint as start, 10 as size, '+' as strand, {_PIECE} as seq from {_BLOCK}
  union all select doc_id, block, 1, 's1', 'a', 100 + block * 10 + (doc_id * 7 + block * 13) % 4 * 20, 10, '+', translate({_PIECE}, 'A', 'C') from {_BLOCK}
  union all select doc_id, block, 2, 's1', 'a', 100 + block * 10 + (doc_id + block * 5) % 3 * 15, 10, '+', translate({_PIECE}, 'G', 'T') from {_BLOCK}
  union all select doc_id, block, 3, 's1', 'b', 5000 - block * 10 - (doc_id * 3 + block) % 3 * 30, 8, '-', '--' || substr({_PIECE}, 3, 8) from {_BLOCK})"""
#: Chains of a lane as a list of their far ends; in each block all pairs by gap, the best, then the best that shares nothing with it (a lane has two fragments at most).
_CHAINED = f"""with recursive f as (select *, case when strand = '-' then -(start + size) else start end as reach from {_FRAGMENTS}),
lanes as (select doc_id, species, contig, block, list(struct_pack(reach := reach, size := size, seq := seq, start := start) order by row) as r from f group by all),
walk as (
  select doc_id, species, contig, -1 as block, []::bigint[] as ends, []::struct(i bigint, chain bigint)[] as put from (select distinct doc_id, species, contig from lanes)
  union all
  select doc_id, species, contig, block, list_concat(list_transform(ends, lambda e, j: coalesce(list_filter(list_transform([p1, p2], lambda p: case when p.j = j then r[p.i].reach + r[p.i].size end), lambda x: x is not null)[1], e)),
      list_transform(news, lambda i: r[i].reach + r[i].size)),
    list_concat(list_transform(list_filter([p1, p2], lambda p: p is not null), lambda p: struct_pack(i := p.i, chain := p.j)), list_transform(news, lambda i, n: struct_pack(i := i, chain := len(ends) + n)))
  from (select *, list_filter(range(1, len(r) + 1), lambda i: i is distinct from p1.i and i is distinct from p2.i) as news
    from (select *, list_filter(pairs, lambda p: p.i <> p1.i and p.j <> p1.j)[1] as p2 from (select *, pairs[1] as p1 from (
      select l.doc_id, l.species, l.contig, l.block, l.r, w.ends, list_sort(list_filter(flatten(list_transform(range(1, len(l.r) + 1), lambda i: list_transform(range(1, len(w.ends) + 1), lambda j: struct_pack(g := l.r[i].reach - w.ends[j], i := i, j := j)))),
        lambda p: p.g >= 0 and p.g < 50)) as pairs
      from walk w join lanes l on l.doc_id = w.doc_id and l.species = w.species and l.contig = w.contig and l.block = w.block + 1))))),
placed as (select w.doc_id, w.species, w.contig, w.block, unnest(w.put) as p from walk w where w.block >= 0),
pieces as (select p.doc_id, p.species, p.contig, p.p.chain as chain, p.block, l.r[p.p.i] as r from placed p join lanes l using (doc_id, species, contig, block)),
sizes as (select doc_id, max(block) + 1 as n from f group by 1),
chains as (select doc_id, species, contig, chain, string_agg(coalesce(r.seq, '----------'), '' order by b) as seq, min(r.start) as start, max(r.start + r.size) as stop
  from (select c.*, b from (select distinct doc_id, species, contig, chain from pieces) c join (select doc_id, unnest(range(0, n)) as b from sizes) using (doc_id)) g
  left join pieces p on p.doc_id = g.doc_id and p.species = g.species and p.contig = g.contig and p.chain = g.chain and p.block = g.b group by g.doc_id, g.species, g.contig, g.chain)"""
_CHAINED = _CHAINED.replace("select doc_id, species, contig, chain, string_agg", "select g.doc_id, g.species, g.contig, g.chain, string_agg")


@query(f"""{_CHAINED} select doc_id, species, contig, md5(seq) as digest, start, stop as "end" from chains""")
def fragment_chains(spark: SparkSession, folder: str) -> DataFrame:
    chains = al.chain_fragments(_fragments(spark, folder), "doc_id")
    return chains.select("doc_id", "species", "contig", F.md5("seq").alias("digest"), "start", "end")


@query()
def alignment_frequencies(spark: SparkSession, folder: str) -> DataFrame:
    """Blocks to base frequencies of each alignment column: chains, distances, netting, counts."""
    return al.frequencies_of_alignment(_fragments(spark, folder), "doc_id", "ref").select("doc_id", "pos", "A", "C", "G", "T", "depth", "p_A")


# -- regions behind an anchor ----------------------------------------------------------------------------------------------

_CODONS = "'TAATAGCTATGA'"
_ANCHORS = f"""(select doc_id // 4 as gene, b as block, case when doc_id % 4 = 0 then 'ref' else 's' || (doc_id % 4) end as species, 'c' || (doc_id % 3) as contig, n_chars + case when b = 0 then 0 when doc_id % 5 = 0 then 3 else 2 end as start,
  case when b = 0 then 2 else 1 end as size, case when doc_id % 3 = 0 then '-' else '+' end as strand, 2 * n_chars + 40 as contig_length,
  substr(substr({_CODONS}, (((case when doc_id % 4 < 3 then doc_id // 4 else doc_id end) * 5) % 4 * 3 + 1)::int, 3), 2 * b + 1, 2 - b) as seq from documents, (select unnest([0, 1])::int as b))"""


@query(
    f"""with first as (select * from {_ANCHORS} where block = 0), second as (select * from {_ANCHORS} where block = 1),
whole as (select f.gene, f.species, f.contig, f.strand, f.contig_length, upper(f.seq || coalesce(s.seq, '')) as seq, coalesce(s.start + s.size, f.start + f.size) as next_pos, case when f.gene % 2 = 0 then '+' else '-' end as gene_strand, 30 as len
  from first f left join second s on s.gene = f.gene and s.species = f.species and s.contig = f.contig and s.start = f.start + f.size),
ref as (select gene, seq as ref from whole where species = 'ref' and seq in (case when gene_strand = '+' then 'TAG' else 'CTA' end, case when gene_strand = '+' then 'TAA' else 'TTA' end, case when gene_strand = '+' then 'TGA' else 'TCA' end)),
r as (select gene, species, contig, strand,
  case when gene_strand = '+' and strand = '+' then next_pos when gene_strand = '+' then greatest(contig_length - next_pos - len, 0) when strand = '+' then greatest(next_pos - 3 - len, 0) else contig_length - next_pos + 3 end as start,
  case when gene_strand = '+' and strand = '+' then least(next_pos + len, contig_length) when gene_strand = '+' then contig_length - next_pos when strand = '+' then next_pos - 3 else least(contig_length - next_pos + 3 + len, contig_length) end as "end"
  from whole join ref using (gene) where seq = ref)
select gene, species, contig, start, "end", strand from r"""
)
def regions_of_species(spark: SparkSession, folder: str) -> DataFrame:
    """Regions behind a stop codon in all species that share it, from two-block anchor alignments."""
    d = table(spark, folder, "documents")
    k = F.col("doc_id")
    codon = F.substr(F.lit("TAATAGCTATGA"), ((F.when(k % 4 < 3, F.floor(k / 4)).otherwise(k) * 5) % 4 * 3 + 1).cast("int"), F.lit(3))
    b = F.col("block")
    rows = d.withColumn("block", F.explode(F.array(F.lit(0), F.lit(1)))).select(
        F.floor(k / 4).alias("gene"), "block", F.when(k % 4 == 0, "ref").otherwise(F.concat(F.lit("s"), (k % 4).cast("string"))).alias("species"), F.concat(F.lit("c"), (k % 3).cast("string")).alias("contig"),
        (F.col("n_chars") + F.when(b == 0, 0).when(k % 5 == 0, 3).otherwise(2)).alias("start"), F.when(b == 0, 2).otherwise(1).cast("long").alias("size"), F.when(k % 3 == 0, "-").otherwise("+").alias("strand"),
        (2 * F.col("n_chars") + 40).alias("contig_length"), F.substr(codon, 2 * b + 1, 2 - b).alias("seq"),
    )
    genes = rows.select("gene").distinct().select("gene", F.when(F.col("gene") % 2 == 0, "+").otherwise("-").alias("gene_strand"), F.lit(30).alias("length"))
    return al.regions_of_species(rows, genes, "gene", "ref").select("gene", "species", "contig", "start", "end", "strand")


_I = sql_intervals("signup", 6)


@query(
    f"""select name, case when strand = '-' then "end" else start - 3 end as anchor_start, case when strand = '-' then "end" + 3 else start end as anchor_end,
  least(greatest(case when strand = '+' then "end" else start - 5000 end, 0), 1704400000) as projected_start, least(greatest(case when strand = '+' then "end" + 5000 else start end, 0), 1704400000) as projected_end from {_I}"""
)
def anchor_windows(spark: SparkSession, folder: str) -> DataFrame:
    """The bases before an interval's 5' end, and the interval that follows an anchor, clipped to the contig."""
    i = intervals(spark, folder, "signup", 6)
    c: list[Column] = [F.col(x) for x in ("start", "end", "strand")]
    whole = F.lit(1704400000).cast("long")
    return i.select("name", iv.anchor_window(*c).alias("a"), iv.projected(c[0], c[1], F.lit("+"), c[2], F.lit(5000), whole).alias("p")).select(
        "name", F.col("a.start").alias("anchor_start"), F.col("a.end").alias("anchor_end"), F.col("p.start").alias("projected_start"), F.col("p.end").alias("projected_end")
    )
