"""Personal data: base patterns, and bootstrapped contextual extraction; DataFrame functions only.

Base entities (email, ip, card, phone) seed the bootstrap, and so do secrets: quoted
values that a text assigns to a key such as ``token`` in the plainest form.  Every
mention of a seed and of any other identifier-like string (a word with ``@``, with
five digits, or digit groups joined by single spaces) has patterns: the two words
left of it, the left and the right word alone and together, the key that a ``=`` or
``:`` assigns it to, and the shape of the string itself.  Words are lower-cased,
digits in them count as 0.  Only whole words that end within ``WINDOW`` characters
of the mention are contexts; longer ones give no pattern.

Patterns and instances form a graph.  In each round a pattern's confidence for a
kind is the share of its distinct instances that are trusted, shrunk towards the
kind's share of all instances; an instance's confidence is the noisy-or over its
confident patterns, of which one at least must be a context; trusted instances count
as evidence in the next round.  Mentions of instances that end above the limit are
reported beside the seeds.

Positions come from splitting a text at the matches of a pattern and summing the
lengths of gaps and matches, in code points.  All loops of the patterns are
possessive or guarded, so that long runs take linear time and no deep stack.

Defined results: null and empty texts have no spans; repeated rows are searched
one by one; an empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, column_name

KINDS = ("email", "ip", "card", "phone")
#: Kinds with seeds; those beyond the base are listed behind it.
ALL_KINDS = (*KINDS, "secret")
# the guards only stop a search from starting inside a run that was already tried
_CLASS = r"[A-Za-z0-9._%+-]"
PATTERNS = {
    "email": rf"(?:\G|(?<!{_CLASS})){_CLASS}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[ -]?+[0-9])++",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
#: A text without a hit here has no match of the kind.
HINTS = {"email": r"@", "ip": r"[0-9]\.[0-9]", "card": r"(?:[0-9][ -]?+){16}", "phone": r"\+[0-9]"}
SPACE = r"\x20\x09-\x0D"
_CANDIDATE = rf"(?<![^{SPACE}])[^{SPACE}0-9@]*+[0-9@][^{SPACE}]*+"
_CANDIDATE_HINT = r"[0-9@]"
_GROUP = rf"[0-9]++(?:[^{SPACE}0-9A-Za-z@]++[0-9]++)*+"
_RUN = rf"(?<![^{SPACE}])[^{SPACE}0-9A-Za-z@]*+{_GROUP}(?:\x20{_GROUP}(?![^{SPACE}0-9A-Za-z@]*+[0-9A-Za-z@]))++"
_RUN_HINT = r"[0-9]\x20[0-9]"

#: The plainest assignment of a secret: a lower-case key and a quoted value of 16 characters or more that stands alone.
_SECRET = r"(?<![A-Za-z0-9_-])(?:password|passwd|secret|token|api[_-]?key|access[_-]?key)\x20?[:=]\x20?\"[A-Za-z0-9+/=_-]{16,}+\"(?![^" + SPACE + "])"
_SECRET_HINT = r'(?:password|passwd|secret|token|key)\x20?[:=]\x20?"'

#: Distinct trusted instances that a pattern needs, the confidence from which patterns and instances are trusted, the weight of the prior share, and rounds.
SUPPORT, TRUST, PRIOR, ROUNDS = 3, 0.8, 10.0, 2
#: Characters beside a mention in which its context words must lie.
WINDOW = 64
_NO_SPANS = "cast(array() as array<struct<start:bigint,end:bigint,value:string>>)"


def _with_matches(df: DataFrame, name: str, pattern: str, hint: str) -> DataFrame:
    """Adds ``name``: all matches with their places.  Kept in steps, so that each search runs once."""
    m, g, a, b = f"{name}_m", f"{name}_g", f"{name}_a", f"{name}_b"
    hit = F.col("text").rlike(hint)
    df = df.withColumn(m, F.when(hit, F.regexp_extract_all("text", F.lit(pattern), F.lit(0))))
    df = df.withColumn(g, F.when(F.size(m) > 0, F.split("text", pattern, -1)))
    df = df.withColumn(a, F.expr(f"case when {g} is not null then transform({m}, (x, i) -> length({g}[i]) + length(x)) end"))
    # lengths summed in stretches of 256, so that the work for n matches stays near n
    df = df.withColumn(b, F.expr(f"case when {a} is not null then transform(sequence(0, (size({a}) - 1) div 256), j -> aggregate(slice({a}, cast(j * 256 + 1 as int), 256), 0L, (s, x) -> s + x)) end"))
    end = f"(case when i >= 256 then aggregate(slice({b}, 1, cast(i div 256 as int)), 0L, (s, x) -> s + x) else 0L end + aggregate(slice({a}, cast((i div 256) * 256 + 1 as int), cast(i % 256 + 1 as int)), 0L, (s, x) -> s + x))"
    spans = f"transform(transform({m}, (x, i) -> named_struct('end', {end}, 'value', x)), y -> named_struct('start', y.end - length(y.value), 'end', y.end, 'value', y.value))"
    return df.withColumn(name, F.expr(f"case when {a} is not null then {spans} else {_NO_SPANS} end")).drop(m, g, a, b)


def _valid(kind: str, value: Column) -> Column:
    if kind == "ip":
        bare = lambda p: F.regexp_replace(p, "^0+", "")
        return F.forall(F.split(value, r"\."), lambda p: (F.length(bare(p)) <= 3) & (F.coalesce(bare(p).try_cast("int"), F.lit(0)) <= 255))
    if kind == "card":
        digits = F.regexp_replace(value, "[ -]", "")
        n = F.length(digits)
        digit = lambda i: F.substr(digits, n - i, F.lit(1)).cast("int")
        twice = lambda d: F.when(d > 4, 2 * d - 9).otherwise(2 * d)
        luhn = F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0), lambda s, i: s + F.when(i % 2 == 0, digit(i)).otherwise(twice(digit(i))))
        return F.when((n >= 16) & (n <= 19), luhn % 10 == 0).otherwise(F.lit(False))
    if kind == "phone":
        n = F.length(F.regexp_replace(value, "[^0-9]", ""))
        return (n >= 8) & (n <= 15)
    return F.lit(True)


def base_spans(docs: DataFrame) -> DataFrame:
    """Adds ``base`` to ``docs(text)``: array of (kind, start, end, value) by kind as listed, then start."""
    for kind in KINDS:
        docs = _with_matches(docs, f"_{kind}", PATTERNS[kind], HINTS[kind])
    def tagged(kind: str) -> Column:
        named = lambda s: F.struct(F.lit(kind).alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["value"].alias("value"))
        return F.transform(F.filter(f"_{kind}", lambda s: _valid(kind, s["value"])), named)

    return docs.withColumn("base", F.concat(*map(tagged, KINDS))).drop(*(f"_{k}" for k in KINDS))


def _contexts(text: Column, s: Column) -> Column:
    """The patterns of one mention; null where it has none of a kind."""
    first = F.greatest(s["start"] - WINDOW, F.lit(0))
    zero = lambda c: F.translate(F.lower(c), "123456789", "000000000")
    # a blank stands for the text's start and end, so that only whole words are taken
    left = F.concat(F.when(s["start"] <= WINDOW, " ").otherwise(""), zero(F.substr(text, (first + 1).cast("int"), (s["start"] - first).cast("int"))))
    right = F.concat(zero(F.substr(text, (s["end"] + 1).cast("int"), F.lit(WINDOW))), F.when(F.length(text) <= s["end"] + WINDOW, " ").otherwise(""))
    two = F.regexp_extract(left, rf"[{SPACE}]([^{SPACE}]++[{SPACE}]++[^{SPACE}]++)[{SPACE}]++[^{SPACE}]*+$", 1)
    one = F.regexp_extract(left, rf"[{SPACE}]([^{SPACE}]++)[{SPACE}]++[^{SPACE}]*+$", 1)
    after = F.regexp_extract(right, rf"^[^{SPACE}]*+[{SPACE}]++([^{SPACE}]++)[{SPACE}]", 1)
    key = F.regexp_extract(left, rf"[^a-z0-9_-]([a-z][a-z0-9_-]*+)[{SPACE}\"']*+[:=]++[{SPACE}\"']*+$", 1)
    value = F.lower(s["value"])
    shape = (
        F.when(value.rlike("^[0-9]+$"), F.concat(F.lit("digits:"), F.length(value)))
        .when(value.rlike("^[0-9a-f]+$"), F.concat(F.lit("hex:"), F.length(value)))
        .when(value.rlike("^[0-9a-z]+$"), F.concat(F.lit("alnum:"), F.length(value)))
        .otherwise(F.regexp_replace(F.regexp_replace(value, "[0-9]+", "9"), "[a-z]+", "a"))
    )
    given = lambda name, c: F.when(c != "", F.concat(F.lit(name), c))
    both = F.when((one != "") & (after != ""), F.concat(F.lit("lr:"), one, F.lit(" _ "), after))
    return F.array(given("l2:", F.regexp_replace(two, rf"[{SPACE}]+", " ")), given("l1:", one), given("r1:", after), both, given("key:", key), F.concat(F.lit("shape:"), shape))


def mentions(docs: DataFrame) -> DataFrame:
    """Adds ``base``, ``seeds`` (base and secrets) and ``found``: all identifier-like mentions (kind null where no seed is) with their patterns."""
    docs = _with_matches(base_spans(docs), "_secret", _SECRET, _SECRET_HINT)
    inner = lambda v: F.regexp_extract(v, '"([^"]+)"$', 1)
    secret = F.transform("_secret", lambda s: F.struct(F.lit("secret").alias("kind"), (s["end"] - 1 - F.length(inner(s["value"]))).alias("start"), (s["end"] - 1).alias("end"), inner(s["value"]).alias("value")))
    docs = docs.withColumn("seeds", F.concat("base", secret)).drop("_secret")
    docs = _with_matches(_with_matches(docs, "_word", _CANDIDATE, _CANDIDATE_HINT), "_run", _RUN, _RUN_HINT)
    docs = docs.withColumn("_word", F.concat("_word", "_run")).drop("_run")
    lead = lambda v: F.length(F.regexp_extract(v, "^[^A-Za-z0-9+]*", 0))
    bare = lambda v: F.regexp_replace(v, "^[^A-Za-z0-9+]+|[^A-Za-z0-9]+$", "")
    cut = F.transform("_word", lambda s: F.struct((s["start"] + lead(s["value"])).alias("start"), (s["start"] + lead(s["value"]) + F.length(bare(s["value"]))).alias("end"), bare(s["value"]).alias("value")))
    docs = docs.withColumn("_word", cut)
    like = F.filter(
        "_word",
        lambda s: (s["value"].contains("@") | (F.length(F.regexp_replace(s["value"], "[^0-9]", "")) >= 5))
        & ~F.exists("seeds", lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"])),
    )
    docs = docs.withColumn("_word", F.transform(like, lambda s: F.struct(F.lit(None).cast("string").alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["value"].alias("value"))))
    found = F.transform(F.concat("seeds", "_word"), lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["value"].alias("value"), _contexts(F.col("text"), s).alias("patterns")))
    return docs.withColumn("found", F.when((F.size("seeds") > 0) | (F.size("_word") > 0), found)).drop("_word")


def discover(table: DataFrame, scratch: Scratch, support: int = SUPPORT, trust: float = TRUST, rounds: int = ROUNDS) -> DataFrame:
    """(uid, kind, start, end) of mentions beyond the seeds, from ``table(uid, found)``."""
    each = scratch.save(table.select("uid", F.explode("found").alias("m")).select("uid", "m.*").withColumn("instance", F.lower("value")))
    edges = scratch.save(each.select(F.explode("patterns").alias("pattern"), "instance", "kind").filter("pattern is not null").groupBy("pattern", "instance").agg(F.min("kind").alias("kind")))
    instances = scratch.save(each.groupBy("instance").agg(F.min("kind").alias("kind")))
    seeds = scratch.save(instances.filter("kind is not null").select("instance", "kind", F.lit(1.0).alias("confidence"), F.lit(True).alias("seed")))
    # one row for each kind: its share of all instances
    share = F.count(F.lit(1)) / F.greatest(F.lit(float(instances.count())), F.lit(1.0))
    prior = scratch.save(seeds.groupBy("kind").agg(share.alias("prior")))
    sizes = scratch.save(edges.groupBy("pattern").agg(F.count(F.lit(1)).alias("size")).filter(F.col("size") >= support))
    trusted = seeds
    for _ in range(rounds):
        told = edges.select("pattern", "instance").join(trusted, "instance").groupBy("pattern", "kind").agg(F.sum("confidence").alias("weight"), F.count(F.lit(1)).alias("backed"))
        told = told.filter(F.col("backed") >= support).join(F.broadcast(prior), "kind").join(sizes, "pattern")
        scored = told.withColumn("p", (F.col("weight") + PRIOR * F.col("prior")) / (F.col("size") + PRIOR)).filter(F.col("p") >= trust)
        scored = scratch.save(scored.select("pattern", F.col("kind").alias("as_kind"), "p"))
        reached = edges.filter("kind is null").select("pattern", "instance").join(scored, "pattern").groupBy("instance", "as_kind")
        reached = reached.agg((-F.sum(F.log(1 - F.col("p")))).alias("evidence"), F.max(~F.col("pattern").startswith("shape:")).alias("in_context")).filter("in_context")
        # kinds are compared before the noisy-or, which rounds strong evidence to 1
        best = reached.groupBy("instance").agg(F.max(F.struct("evidence", "as_kind")).alias("b"))
        best = best.select("instance", F.col("b.as_kind").alias("kind"), (1 - F.exp(-F.col("b.evidence"))).alias("confidence"), F.lit(False).alias("seed")).filter(F.col("confidence") >= trust)
        best = scratch.save(best.join(seeds, "instance", "left_anti"))
        trusted = scratch.save(seeds.unionByName(best))
    new = trusted.filter("not seed").select("instance", F.col("kind").alias("as_kind"))
    return each.filter("kind is null").join(new, "instance").select("uid", F.col("as_kind").alias("kind"), "start", "end")


def _searched(docs: DataFrame, keep: list[str], scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """A written table of ``docs`` with uid, base, all seeds and (apart) what the bootstrap adds to each uid."""
    rows = docs.select(F.struct(*(docs[c] for c in keep), F.lit(0).alias("_")).alias("kept"), F.coalesce(docs["text"], F.lit("")).alias("text"))
    table = scratch.save(mentions(rows).drop("text").withColumn("uid", F.monotonically_increasing_id()))
    new = discover(table.filter("found is not null").select("uid", "found"), scratch)
    added = scratch.save(new.groupBy("uid").agg(F.collect_list(F.struct("kind", "start", "end")).alias("added")))
    return table.drop("found"), added


def _joined(spans: Column) -> Column:
    order = F.create_map(*(x for i, k in enumerate(ALL_KINDS) for x in (F.lit(k), F.lit(i))))
    keyed = F.sort_array(F.transform(spans, lambda s: F.struct(order[s["kind"]].alias("o"), s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))
    return F.concat_ws(",", F.transform(keyed, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))))


def _plain(spans: str) -> Column:
    return F.transform(F.col(spans), lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end")))


_EMPTY = "cast(array() as array<struct<kind:string,start:bigint,end:bigint>>)"


def find_personal_data(docs: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """``docs`` without its text, with the base counts n_<kind>, base_sha256, ``spans`` (base, secrets and discovered) and their number n_spans."""
    scratch = scratch or Scratch(docs.sparkSession)
    keep = [c for c in docs.columns if c != "text"]
    table, added = _searched(docs, keep, scratch)
    out = table.join(added, "uid", "left").withColumn("all", F.concat(_plain("seeds"), F.coalesce("added", F.expr(_EMPTY))))
    counts = [F.size(F.expr(f"filter(base, s -> s.kind = '{k}')")).cast("long").alias(column_name(docs, f"n_{k}")) for k in KINDS]
    return out.select(*(F.col("kept")[c].alias(c) for c in keep), *counts, F.sha2(_joined(_plain("base")), 256).alias(column_name(docs, "base_sha256")), _joined(F.col("all")).alias(column_name(docs, "spans")), F.size("all").cast("long").alias(column_name(docs, "n_spans")))


def redact(docs: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """``docs`` with every found span replaced by its kind in angle brackets (overlapping spans as one, named by the first)."""
    scratch = scratch or Scratch(docs.sparkSession)
    table, added = _searched(docs, docs.columns, scratch)
    out = table.join(added, "uid", "left").withColumn("all", F.array_sort(F.transform(F.concat(_plain("seeds"), F.coalesce("added", F.expr(_EMPTY))), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind")))))
    # each span starts behind the furthest end before it, or is swallowed
    ends = F.expr("transform(all, (s, i) -> case when i = 0 then 0L else array_max(transform(slice(all, 1, i), x -> x.end)) end)")
    pieces = F.expr(
        "concat_ws('', transform(all, (s, i) -> concat("
        "case when s.start > ends[i] then substring(kept.text, cast(ends[i] + 1 as int), cast(s.start - ends[i] as int)) else '' end, "
        "case when s.start >= ends[i] then concat('<', upper(s.kind), '>') else '' end)))"
    )
    tail = F.expr("substring(kept.text, cast(array_max(transform(all, x -> x.end)) + 1 as int))")
    text = F.when(F.size("all") > 0, F.concat(pieces, tail)).otherwise(F.col("kept.text"))
    out = out.withColumn("ends", ends).withColumn("clean", text)
    return out.select(*((F.col("clean") if c == "text" else F.length("clean").cast("long") if c == "n_chars" else F.col("kept")[c]).alias(c) for c in docs.columns))
