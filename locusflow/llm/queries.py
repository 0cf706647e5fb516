"""The registered queries of the training-data operators, and SQL for those that it can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann_mih, byte_bpe, conversation_repair, hmm_lm, jaccard_join, license_scan, piece_codec, pii_bootstrap, quality_cascade, source_mixing, token_alignment, token_counts, url_reputation


def model_path(name: str = "piece_bpe_32k.model") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _documents(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select(*columns)


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(_documents(spark, sf_dir, "doc_id", "text"))


def op2_multi_index_hashing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann_mih.search(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding"), F.expr("vec_id % 20 = 0"), k=20)


def op3_quality_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality_cascade.judge(_documents(spark, sf_dir, "doc_id", "text"), measures=True)
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), (F.col("kept") & ~failed).alias("kept"))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(_documents(spark, sf_dir, "doc_id", "text"), model_path())


def op5_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_codec.encode_documents(_documents(spark, sf_dir, "doc_id", "text"), model_path()).drop("text")


def op6_url_reputation(spark: SparkSession, sf_dir: str) -> DataFrame:
    outcomes = spark.read.parquet(f"{sf_dir}/labels.parquet").select(F.col("doc_id").alias("page_id"), ((F.col("quality") == 0) | (F.col("toxic") == 1)).alias("bad"))
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    return url_reputation.judge_urls(pages, outcomes).select("page_id", "host", "path", "rule", "verdict")


def op7_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_mixing.mix(_documents(spark, sf_dir, "doc_id", "text", "lang", "source", "n_chars"))


def op8_hidden_markov_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hmm_lm.score_documents(_documents(spark, sf_dir, "doc_id", "text"))


def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.link_components(_documents(spark, sf_dir, "doc_id", "text"))


def op10_bootstrapped_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii_bootstrap.find_personal_data(_documents(spark, sf_dir, "doc_id", "text"))


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_repair.repair_damaged(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_alignment.align_documents(_documents(spark, sf_dir, "doc_id", "text"), model_path("byte_bpe_50k.json"), model_path())


def op13_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe.encode_documents(_documents(spark, sf_dir, "doc_id", "text"), model_path("byte_bpe_multi_50k.tiktoken")).drop("text")


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {f.__name__: f for f in (op1_license_scan, op2_multi_index_hashing, op3_quality_cascade, op4_token_counts, op5_sentencepiece, op6_url_reputation, op7_source_mixing, op8_hidden_markov_lm, op9_jaccard_join, op10_bootstrapped_pii, op11_conversation_repair, op12_token_alignment, op13_byte_bpe, pipeline)}

_W = r"[^\x20\x09-\x0D]+"
_QUALITY = rf"""
with docs as (select row_number() over () as id, doc_id, coalesce(text, '') as text from documents),
words as (select id, doc_id, text, regexp_extract_all(text, '{_W}') as w from docs),
windows as (select id, i, list_value(w[i], w[i + 1], w[i + 2]) as v from (select id, w, unnest(range(1, len(w) - 1)) as i from words)),
twice as (select id, i from (select id, i, count(*) over (partition by id, v) as n from windows) where n > 1),
covered as (select id, count(distinct i + j) as n from twice, (select unnest([0, 1, 2]) as j) group by id),
lines as (select id, line, row_number() over (partition by id, line) as k from (select id, unnest(string_split(text, chr(10))) as line from docs) where regexp_matches(line, '{_W}')),
per_line as (select id, count(*) as n_lines, count(*) filter (where k > 1) as n_dup_lines from lines group by id),
measured as (
  select doc_id, len(w) as n_words, length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g')) as word_chars,
    length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) as n_symbols,
    coalesce(n_dup_lines, 0) as n_dup_lines, coalesce(covered.n, 0) as n_repeat_words, coalesce(n_lines, 0) as n_lines,
    length(regexp_replace(text, '[^A-Z]', '', 'g')) as n_upper, length(regexp_replace(text, '[^A-Za-z]', '', 'g')) as n_letters
  from words left join covered using (id) left join per_line using (id)),
judged as (select *, n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed from measured)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  not (base_failed or 4 * n_symbols > n_words or 2 * n_upper > n_letters + 1 or 2 * n_dup_lines > n_lines or word_chars < 2 * n_words or word_chars > 16 * n_words) as kept
from judged"""

_SUFFIXES = ", ".join(f"'{s}'" for s in url_reputation.SUFFIXES)


def _url_rule(field: str) -> str:
    fits = lambda r: f"((host = '{r.host}' or ends_with(host, '.{r.host}')) and starts_with(path, '{r.path}'))"
    longest = sorted(url_reputation.RULES, key=lambda r: -len(r.text))
    return "case " + " ".join(f"when {fits(r)} then '{getattr(r, field)}'" for r in longest) + " end"


def _url_level(name: str, table: str, keys: str, parent: str) -> str:
    return f"""
{name}_rho as (select least(greatest(coalesce(sum((bad - n * {parent}) ** 2 - n * {parent} * (1 - {parent})) / nullif(sum(n * (n - 1) * {parent} * (1 - {parent})), 0), 0), 0.001), 0.999) as rho from {table}),
{name}_post as (select {keys}, ((1 / rho - 1) * {parent} + bad) / (1 / rho - 1 + n) as {name}_rate, 1 / rho - 1 + n as total from {table}, {name}_rho)"""


_URLS = rf"""
with split as (
  select page_id, case when instr(url, '://') > 0 then substr(url, instr(url, '://') + 3) else '' end as rest from pages),
parts as (
  select page_id, translate(regexp_extract(coalesce(rest, ''), '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
    regexp_extract(coalesce(rest, ''), '^[^/?#]*([^?#]*)', 1) as path from split),
labelled as (select doc_id as page_id, max((quality = 0 or toxic = 1)::int) as bad from labels where doc_id is not null group by 1),
named as (select *, regexp_replace(regexp_replace(regexp_replace(host, '^.*@', ''), ':[0-9]*$', ''), '[.]+$', '') as name from parts),
labels_of as (select array_to_string(list_slice(string_split(name, '.'), -2, -1), '.') as two, regexp_matches(name, '^[0-9]+([.][0-9]+){{3}}$') or starts_with(name, '[') as address, * from named left join labelled using (page_id)),
hosts as (
  select host, case when address then name when two in ({_SUFFIXES}) then array_to_string(list_slice(string_split(name, '.'), -3, -1), '.') else two end as domain,
    case when address then name when two in ({_SUFFIXES}) then two else string_split(name, '.')[-1] end as suffix, count(bad) as n, coalesce(sum(bad), 0)::double as bad
  from labels_of group by all),
world as (select least(greatest(coalesce(sum(bad) / nullif(sum(n), 0), 0), 1e-6), 1 - 1e-6) as world from hosts),
s as (select suffix, sum(n)::double as n, sum(bad) as bad, any_value(world) as world from hosts, world group by 1),
{_url_level("suffix", "s", "suffix", "world")},
d as (select domain, suffix, sum(n)::double as n, sum(bad) as bad, any_value(suffix_rate) as suffix_rate from hosts join suffix_post using (suffix) group by 1, 2),
{_url_level("domain", "d", "domain", "suffix_rate")},
h as (select host, n::double as n, bad, domain_rate from hosts join domain_post using (domain)),
{_url_level("host", "h", "host", "domain_rate")}
select page_id, host, path, {_url_rule("text")} as rule,
  coalesce({_url_rule("verdict")}, case when host_rate - {url_reputation.Z} * sqrt(host_rate * (1 - host_rate) / (total + 1)) > {url_reputation.LIMIT} then 'block' else 'allow' end) as verdict
from parts left join host_post using (host)"""

_MIX = """
with counts as (select source, count(*)::double as n, sqrt(count(*)) as goal from documents group by 1),
rate as (select source, goal / sum(goal) over () * sum(n) over () / n as mean from counts),
below as (select source, k, sum(exp(k * ln(mean) - mean - lgamma(k + 1))) over (partition by source order by k) as p from rate, (select unnest(range(0, 200)) as k) where k < ceil(mean + 12 * sqrt(mean) + 24)),
steps as (select source, list(p order by k) as p from below group by 1),
drawn as (
  select d.*, len(list_filter(p, lambda x: x <= ('0x' || substr(md5('mix:' || coalesce(doc_id::varchar, '') || ':0'), 1, 13))::bigint / 4503599627370496.0)) as times
  from documents d join steps on d.source is not distinct from steps.source)
select doc_id, text, lang, source, n_chars, unnest(range(0, times))::int as replica from drawn"""

_JACCARD = rf"""
with recursive words as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_W}') as w from documents),
shingles as (
  select distinct doc_id, list_slice(w, i, i + 4) as s from (select doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) as i from words where len(w) > 0)),
sizes as (select doc_id, count(*) as n from shingles group by 1),
common as (select a.doc_id as x, b.doc_id as y, count(*) as c from shingles a join shingles b on a.s = b.s and a.doc_id <> b.doc_id group by 1, 2),
links as (select x, y from common join sizes p on p.doc_id = x join sizes q on q.doc_id = y where 100 * c >= 80 * (p.n + q.n - c)),
reach(x, y) as (select x, y from links union select reach.x, links.y from reach join links on reach.y = links.x)
select doc_id, coalesce(n, 0) as n_shingles, least(doc_id, coalesce(low, doc_id)) as component_id
from documents left join sizes using (doc_id) left join (select x as doc_id, min(y) as low from reach group by 1) using (doc_id)"""

ORACLE_SQL = {"op3_quality_cascade": _QUALITY, "op6_url_reputation": _URLS, "op7_source_mixing": _MIX, "op9_jaccard_join": _JACCARD}
