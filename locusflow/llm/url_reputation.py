"""URL filter: hand-written rules first, then the host's empirical-Bayes reputation.

Labelled page outcomes (bad or not) are summed by host, registered domain and
public suffix (from a table of suffixes; user, port and dots at the end are no part of
a name, and an address is its own domain and suffix).  Each level's rate is shrunk towards its parent's through a beta
prior whose strength is the level's own moment estimate: a beta-binomial with
intraclass correlation rho has prior strength 1 / rho - 1.  A page that no rule
decides is blocked when the lower posterior bound of its host's bad rate
(mean - z standard deviations) is over the limit.

Defined results: a url that is null or has no ``://`` has an empty host and path,
fits no rule and is judged by the reputation of the empty host; labels that are
null do not count; repeated rows are judged one by one; hosts without a labelled
page take their domain's prior, and so on up; an empty table gives an empty table;
other columns pass through.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, column_name


@dataclass(frozen=True)
class UrlRule:
    host: str
    path: str
    verdict: str

    @property
    def text(self) -> str:
        return self.host + self.path


RULES = (UrlRule("net", "/", "block"), UrlRule("example.net", "/en/", "allow"), UrlRule("example.com", "/de/", "block"), UrlRule("org", "/fr/", "allow"))
#: Two-label suffixes under which names are registered unless a table is given: each of these labels in each of these countries.
SECOND_LABELS = ("ac", "co", "com", "edu", "go", "gov", "ne", "net", "or", "org")
COUNTRIES = ("ar", "au", "br", "cn", "hk", "id", "il", "in", "jp", "kr", "mx", "my", "nz", "sg", "th", "tr", "tw", "uk", "za")
SUFFIXES = tuple(f"{label}.{country}" for country in COUNTRIES for label in SECOND_LABELS)
#: Most entries of a suffix table, which becomes part of the expression.
MOST_SUFFIXES = 20_000
LIMIT, Z = 0.5, 1.645


def _behind_scheme(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))


def host_of(url: Column) -> Column:
    return F.translate(F.regexp_extract(_behind_scheme(url), r"^[^/?#]*", 0), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    return F.regexp_extract(_behind_scheme(url), r"^[^/?#]*([^?#]*)", 1)


def name_of(host: Column) -> Column:
    """The host without user, port and dots at its end."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(host, "^.*@", ""), ":[0-9]*$", ""), "[.]+$", "")


def is_address(name: Column) -> Column:
    return name.rlike("^[0-9]+([.][0-9]+){3}$") | name.startswith("[")


def _labels(suffixes: Sequence[str], name: Column) -> Column:
    """How many labels of a name its suffix has: those of the longest one in the table, else one."""
    if len(suffixes) > MOST_SUFFIXES:
        raise ValueError(f"more than {MOST_SUFFIXES} suffixes")
    found = F.lit(1)
    for n in sorted({s.count(".") + 1 for s in suffixes} - {1}):
        found = F.when(F.substring_index(name, ".", -n).isin(*(s for s in suffixes if s.count(".") + 1 == n)), n).otherwise(found)
    return found


def _last(name: Column, labels: Column) -> Column:
    parts = F.split(name, "[.]")
    return F.array_join(F.slice(parts, F.greatest(F.size(parts) - labels + 1, F.lit(1)), labels), ".")


def suffix_of(host: Column, suffixes: Sequence[str] = SUFFIXES) -> Column:
    """The public suffix; of an address, the address."""
    name = name_of(host)
    return F.when(is_address(name), name).otherwise(_last(name, _labels(suffixes, name)))


def domain_of(host: Column, suffixes: Sequence[str] = SUFFIXES) -> Column:
    """The registered domain: one label more than the suffix."""
    name = name_of(host)
    return F.when(is_address(name), name).otherwise(_last(name, _labels(suffixes, name) + 1))


def rule_of(host: Column, path: Column, rules: tuple[UrlRule, ...] = RULES) -> tuple[Column, Column]:
    """(rule text, verdict) of the longest rule that fits; null where none does."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: (len(r.text), r.text)):
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        name, verdict = F.when(fits, r.text).otherwise(name), F.when(fits, r.verdict).otherwise(verdict)
    return name, verdict


def _shrunk(level: DataFrame, parent: str) -> DataFrame:
    """``level(n, bad, <parent>)`` with the posterior ``alpha``, ``total``: one aggregate row gives the level's prior strength."""
    m = F.col(parent)
    over = F.sum((F.col("bad") - F.col("n") * m) ** 2 - F.col("n") * m * (1 - m))
    under = F.sum(F.col("n") * (F.col("n") - 1) * m * (1 - m))
    rho = level.agg(F.least(F.greatest(F.coalesce(F.try_divide(over, under), F.lit(0.0)), F.lit(0.001)), F.lit(0.999)).alias("rho"))
    return level.crossJoin(F.broadcast(rho)).withColumn("strength", 1 / F.col("rho") - 1).withColumn("alpha", F.col("strength") * m + F.col("bad")).withColumn("total", F.col("strength") + F.col("n"))


def reputation(pages: DataFrame, outcomes: DataFrame, scratch: Scratch, suffixes: Sequence[str] = SUFFIXES) -> DataFrame:
    """(host, bad_rate, bad_rate_low) for every host of ``pages(page_id, host)``, from ``outcomes(page_id, bad)``."""
    labelled = outcomes.filter("page_id is not null and bad is not null").groupBy("page_id").agg(F.max(F.col("bad").cast("int")).alias("bad"))
    hosts = pages.join(labelled, "page_id", "left").groupBy("host").agg(F.count("bad").alias("n"), F.coalesce(F.sum("bad"), F.lit(0)).alias("bad"))
    hosts = scratch.save(hosts.withColumn("domain", domain_of(F.col("host"), suffixes)).withColumn("suffix", suffix_of(F.col("host"), suffixes)))
    world = hosts.agg(F.coalesce(F.try_divide(F.sum("bad"), F.sum("n")), F.lit(0.0)).alias("world"))
    world = world.select(F.least(F.greatest("world", F.lit(1e-6)), F.lit(1 - 1e-6)).alias("world"))
    total = lambda key: hosts.groupBy(*key).agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    suffixes = _shrunk(total(["suffix"]).crossJoin(F.broadcast(world)), "world").select("suffix", (F.col("alpha") / F.col("total")).alias("suffix_rate"))
    domains = _shrunk(scratch.save(total(["domain", "suffix"])).join(scratch.save(suffixes), "suffix"), "suffix_rate").select("domain", (F.col("alpha") / F.col("total")).alias("domain_rate"))
    known = _shrunk(hosts.join(scratch.save(domains), "domain"), "domain_rate").withColumn("bad_rate", F.col("alpha") / F.col("total"))
    low = F.col("bad_rate") - Z * F.sqrt(F.col("bad_rate") * (1 - F.col("bad_rate")) / (F.col("total") + 1))
    return known.select("host", "bad_rate", low.alias("bad_rate_low"))


def judge_urls(
    pages: DataFrame, outcomes: DataFrame, rules: tuple[UrlRule, ...] = RULES, limit: float = LIMIT, scratch: Scratch | None = None, suffixes: Sequence[str] = SUFFIXES
) -> DataFrame:
    """``pages(page_id, url, ...)`` without the url, with host, path, rule, verdict, bad_rate and bad_rate_low for every row."""
    scratch = scratch or Scratch(pages.sparkSession)
    keep = [c for c in pages.columns if c != "url"]
    names = {n: column_name(pages, n) for n in ("host", "path", "rule", "verdict", "bad_rate", "bad_rate_low")}
    split = pages.select(F.struct(*keep).alias("kept"), "page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    hosts = scratch.save(reputation(split.select("page_id", "host"), outcomes, scratch, suffixes))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    # hosts are a written table: the join deals both sides anew, and Spark splits a host that holds many pages
    made = split.join(hosts, "host", "left").select(
        "kept", "host", "path", rule.alias("rule"), F.coalesce(verdict, F.when(F.col("bad_rate_low") > limit, "block").otherwise("allow")).alias("verdict"), "bad_rate", "bad_rate_low"
    )
    return made.select(*(F.col("kept")[c].alias(c) for c in keep), *(F.col(n).alias(to) for n, to in names.items()))
