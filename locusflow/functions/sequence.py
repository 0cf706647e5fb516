"""Column expressions over nucleotide sequences.  Positions are 0-based and intervals half-open."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_BASES = "ACGTacgt"
_PAIRED = "TGCAtgca"
_MAPPED = "ACGT" * 6 + "AC"


def _col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def _int(x: Column | int) -> Column:
    return (x if isinstance(x, Column) else F.lit(x)).cast("int")


def piece(seq: Column | str, start: Column | int, end: Column | int) -> Column:
    """``seq[start:end]``."""
    start, end = _int(start), _int(end)
    return F.substr(_col(seq), start + 1, F.greatest(end - start, F.lit(0)))


def as_bases(text: Column | str) -> Column:
    """A text read as a sequence: its letters, mapped to A, C, G and T in alphabetic turn."""
    letters = F.regexp_replace(F.lower(_col(text)), "[^a-z]", "")
    return F.translate(letters, "abcdefghijklmnopqrstuvwxyz", _MAPPED)


def reverse_complement(seq: Column | str) -> Column:
    """Case is kept; characters that are no bases stay as they are."""
    return F.reverse(F.translate(_col(seq), _BASES, _PAIRED))


def on_strand(seq: Column | str, strand: Column | str) -> Column:
    """The sequence as read on its strand."""
    return F.when(_col(strand) == "-", reverse_complement(seq)).otherwise(_col(seq))


def dna(seq: Column | str) -> Column:
    """U read as T."""
    return F.translate(_col(seq), "Uu", "Tt")


def lower_at(seq: Column | str, at: Column | int) -> Column:
    """One position in lower case."""
    # the sequence may itself be such an expression: it is worked out once
    return let(_col(seq), lambda s: F.concat(piece(s, 0, at), F.lower(piece(s, at, _int(at) + 1)), F.substr(s, _int(at) + 2)))


def substitute(seq: Column | str, at: Column | int, ref_length: Column | int, alt: Column | str) -> Column:
    """``ref_length`` characters from ``at`` replaced by ``alt`` (empty: a deletion; length 0: an insertion)."""
    return F.concat(piece(seq, 0, at), _col(alt), F.substr(_col(seq), _int(at) + _int(ref_length) + 1))


def mask_outside(seq: Column | str, start: Column | int, end: Column | int) -> Column:
    """N everywhere but in ``[start, end)``."""
    seq = _col(seq)
    n = F.length(seq)
    a, b = F.least(F.greatest(_int(start), F.lit(0)), n), F.least(F.greatest(_int(end), F.lit(0)), n)
    return F.concat(F.repeat(F.lit("N"), a), piece(seq, a, b), F.repeat(F.lit("N"), n - F.greatest(a, b)))


def mask_repeats(seq: Column | str) -> Column:
    """Lower-case bases as gaps."""
    return F.regexp_replace(_col(seq), "[acgt]", "-")


def strip_gaps(seq: Column | str) -> Column:
    return F.replace(_col(seq), F.lit("-"), F.lit(""))


def gap_strangers(seq: Column | str) -> Column:
    """Characters outside the alphabet as gaps."""
    return F.regexp_replace(_col(seq), "[^ACTGactgN]", "-")


def crop_around(seq: Column | str, centre: Column | int, length: int) -> Column:
    """``length`` characters around a centre, moved inside where it would reach over an end."""
    seq = _col(seq)
    start = F.greatest(F.least(_int(centre) - length // 2, F.length(seq) - length), F.lit(0))
    return F.substr(seq, start + 1, F.lit(length))


def pad(seq: Column | str, length: int, side: str = "right") -> Column:
    """Filled with N up to a length; longer sequences stay whole."""
    seq = _col(seq)
    fill = F.repeat(F.lit("N"), F.greatest(F.lit(length) - F.length(seq), F.lit(0)))
    return F.concat(seq, fill) if side == "right" else F.concat(fill, seq)


def shift(seq: Column | str, by: Column | int, keep_at_least: int = 1) -> Column:
    """N on the left for a negative shift, the left end cut off for a positive one if enough is left."""
    seq, by = _col(seq), _int(by)
    cut = F.when(F.length(seq) - by >= keep_at_least, F.substr(seq, by + 1)).otherwise(seq)
    return F.when(by < 0, F.concat(F.repeat(F.lit("N"), -by), seq)).otherwise(cut)


def let(value: Column, body) -> Column:
    """``body`` of a value that is worked out once, however often the body (or a loop in it) names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def kmers(seq: Column | str, k: int, step: int = 1) -> Column:
    """Words of length k; with ``step=k`` they do not overlap.  Sequences shorter than k have none."""
    if step in (1, k):  # one pass of a pattern; cutting words by place would walk from the start for each
        return F.regexp_extract_all(_col(seq), F.lit(f"(?s)(?=(.{{{k}}}))" if step == 1 else f"(?s)(.{{{k}}})"), F.lit(1))
    every = F.regexp_extract_all(_col(seq), F.lit(f"(?s)(?=(.{{{k}}}))"), F.lit(1))
    return F.filter(every, lambda w, i: i % step == 0)


def chunks(seq: Column | str, length: int) -> Column:
    """Neighbouring pieces of a fixed length, the last one shorter; one pass of a pattern."""
    return F.regexp_extract_all(_col(seq), F.lit(f"(?s)(.{{1,{length}}})"), F.lit(1))


def overlapping_chunks(seq: Column | str, length: int, overlap: int) -> Column:
    """Array of (chunk, start, left_shift): the last chunk reaches back so that it is full; left_shift says how far beyond the usual overlap."""
    seq, step = _col(seq), length - overlap

    def cut(n: Column) -> Column:
        # one pass of a pattern that looks ahead over the overlap; cutting by place would walk from the start for each
        every = F.regexp_extract_all(seq, F.lit(f"(?s)(?=(.{{1,{length}}})).{{1,{step}}}"), F.lit(1))
        every = F.when(n > 0, F.slice(every, F.lit(1), F.floor((F.greatest(n - overlap, F.lit(1)) - 1) / step).cast("int") + 1)).otherwise(F.array(seq))

        def one(chunk: Column, i: Column) -> Column:
            begin = F.least(i * step, F.greatest(n - length, F.lit(0)))
            return F.struct(F.when(i * step > begin, F.right(seq, F.lit(length))).otherwise(chunk).alias("chunk"), begin.alias("start"), (i * step - begin).alias("left_shift"))

        return F.transform(every, one)

    return let(F.length(seq), cut)


def first_lower(seq: Column | str) -> Column:
    """Place of the first lower-case base; null if there is none."""
    at = F.regexp_instr(_col(seq), F.lit("[a-z]"))
    return F.when(at > 0, at - 1)


def lower_places(seq: Column | str) -> Column:
    """All places of lower-case bases."""
    letters = F.split(_col(seq), "")
    return F.filter(F.transform(letters, lambda c, i: F.when((c >= "a") & (c <= "z"), i)), lambda i: i.isNotNull())


def median_lower(seq: Column | str) -> Column:
    """Middle (the upper one of two) of the lower-case places; null if there is none."""
    return let(lower_places(seq), lambda places: F.when(F.size(places) > 0, F.get(places, F.floor(F.size(places) / 2).cast("int"))))


def hamming(a: Column | str, b: Column | str) -> Column:
    """Places where two sequences of one length differ, ignoring case; null for other lengths."""
    a, b = F.upper(_col(a)), F.upper(_col(b))
    differ = F.filter(F.zip_with(F.split(a, ""), F.split(b, ""), lambda x, y: x != y), lambda d: d)
    return F.when(F.length(a) == F.length(b), F.size(differ))


def match_places(seq: Column | str, motif: Column | str) -> Column:
    """Places of all matches of a motif that do not overlap, from the left."""
    seq, motif = _col(seq), _col(motif)
    gaps = F.transform(F.split(seq, F.concat(F.lit(r"\Q"), motif, F.lit(r"\E")), -1), lambda g: F.length(g))
    stretch = 256  # lengths are summed by stretches, so that the work for n matches stays near n

    def places(g: Column) -> Column:
        width = lambda xs: F.aggregate(xs, F.lit(0), lambda s, x: s + x + F.length(motif))
        sums = F.transform(F.sequence(F.lit(0), F.floor((F.size(g) - 1) / stretch).cast("int")), lambda j: width(F.slice(g, j * stretch + 1, F.lit(stretch))))

        def ends(s: Column) -> Column:
            at = lambda i: (i / stretch).cast("int")
            before = lambda i: F.when(i >= stretch, F.aggregate(F.slice(s, F.lit(1), at(i)), F.lit(0), lambda t, x: t + x)).otherwise(F.lit(0))
            return F.transform(g, lambda x, i: before(i) + width(F.slice(g, at(i) * stretch + 1, i % stretch + 1)) - F.length(motif))

        # each gap ends where a match begins, but for the last
        return F.slice(let(sums, ends), F.lit(1), F.size(g) - 1)

    return let(gaps, places)


def motif_mask(seq: Column | str, motif: Column | str, mark: int = 1) -> Column:
    """``mark`` at all positions that matches cover (from the left, without overlap), 0 elsewhere: one pass over the stretches between matches."""
    seq, motif = _col(seq), _col(motif)
    fill = lambda x, n: F.array_repeat(F.lit(x), n)

    def marked(gaps: Column) -> Column:
        return F.flatten(F.transform(gaps, lambda g, i: F.concat(fill(0, F.length(g)), F.when(i < F.size(gaps) - 1, fill(mark, F.length(motif))).otherwise(fill(mark, F.lit(0))))))

    return let(F.split(seq, F.concat(F.lit(r"\Q"), motif, F.lit(r"\E")), -1), marked)


def uniformity(seq: Column | str) -> Column:
    """Number of neighbours that are equal."""
    letters = F.split(_col(seq), "")
    pairs = F.zip_with(F.slice(letters, F.lit(1), F.greatest(F.size(letters) - 1, F.lit(0))), F.slice(letters, F.lit(2), F.greatest(F.size(letters) - 1, F.lit(0))), lambda x, y: x == y)
    return F.size(F.filter(pairs, lambda p: p))


def longest_repeat(seq: Column | str, k: int) -> Column:
    """Most times that one k-mer follows itself directly, in any frame."""
    seq = _col(seq)

    def frame(f: int) -> Column:
        words = F.filter(kmers(F.substr(seq, F.lit(f + 1)), k, k), lambda w: F.length(w) == k)
        start = F.struct(F.lit("").alias("last"), F.lit(0).alias("run"), F.lit(0).alias("best"))

        def step(s: Column, w: Column) -> Column:
            run = F.when(s["last"] == w, s["run"] + 1).otherwise(F.lit(1))
            return F.struct(w.alias("last"), run.alias("run"), F.greatest(s["best"], run).alias("best"))

        return F.aggregate(words, start, step, lambda s: s["best"])

    frames = [frame(f) for f in range(k)]
    return F.greatest(*frames) if k > 1 else frames[0]


def base_class(seq: Column | str) -> Column:
    """A, C, G, T as 0 to 3, everything else as 4."""
    return F.transform(F.split(F.upper(_col(seq)), ""), lambda c: F.when(F.length(c) == 0, F.lit(4)).otherwise((F.instr(F.lit("ACGT"), c) + 4) % 5))


def one_hot(seq: Column | str) -> Column:
    """Rows of four for each base; unknown ones are zero."""
    rows = F.array(*(F.array(*(F.lit(int(i == c)) for i in range(4))) for c in range(5)))  # literals, looked up by class
    return F.transform(base_class(seq), lambda c: F.get(rows, c))


def pad_classes(classes: Column | str, length: int, centre: bool = False, fill: int = -100) -> Column:
    """An array filled up on the right, or on both sides."""
    classes = _col(classes)
    missing = F.greatest(F.lit(length) - F.size(classes), F.lit(0))
    left = F.floor(missing / 2).cast("int") if centre else F.lit(0)
    return F.concat(F.array_repeat(F.lit(fill), left), classes, F.array_repeat(F.lit(fill), missing - left))


def variant_type(ref: Column | str, alt: Column | str) -> Column:
    """SNP, DEL, INS or INDEL: the first three need an allele of one base on the shorter side."""
    a, b = F.length(_col(ref)), F.length(_col(alt))
    return F.when((a == 1) & (b == 1), "SNP").when((a > 1) & (b == 1), "DEL").when((a == 1) & (b > 1), "INS").otherwise("INDEL")


def variant_type_by_change(ref: Column | str, alt: Column | str) -> Column:
    """SNP where both alleles have one length, else DEL or INS by which is longer."""
    a, b = F.length(_col(ref)), F.length(_col(alt))
    return F.when(a == b, "SNP").when(a > b, "DEL").otherwise("INS")


def same_length(ref: Column | str, alt: Column | str) -> Column:
    return F.length(_col(ref)) == F.length(_col(alt))


def info_field(info: Column | str, key: str) -> Column:
    """A field of a ``k=v;k=v`` string; null where it is missing."""
    found = F.regexp_extract(_col(info), rf"(?:^|;){key}=([^;]*)", 1)
    return F.when(_col(info).rlike(rf"(?:^|;){key}="), found)


def info_map(info: Column | str) -> Column:
    return F.str_to_map(_col(info), F.lit(";"), F.lit("="))


def format_value(form: Column | str, sample: Column | str, key: Column | str) -> Column:
    """The sample's value for one of the colon-joined format keys."""
    keys, values = F.split(_col(form), ":"), F.split(_col(sample), ":")
    return F.element_at(F.map_from_arrays(keys, F.slice(F.concat(values, F.array_repeat(F.lit(None).cast("string"), F.size(keys))), F.lit(1), F.size(keys))), _col(key))


def allele_depths(form: Column | str, sample: Column | str, ref: Column | str, alt: Column | str) -> Column:
    """(ref, alt) depths of a sample, first tiers: keys TAR and TIR where the format has them (indels), else the alleles' own keys such as ``AU``; -1 for both where an allele is a list."""
    form, ref, alt = _col(form), _col(ref), _col(alt)
    depth = lambda key: F.split(format_value(form, sample, key), ",")[0].try_cast("int")
    indel, several = form.contains("TAR"), ref.contains(",") | alt.contains(",")
    one = lambda key, allele: F.when(several, F.lit(-1)).otherwise(depth(F.when(indel, key).otherwise(F.concat(allele, F.lit("U")))))
    return F.struct(one("TAR", ref).alias("ref"), one("TIR", alt).alias("alt"))


def range_list(text: Column | str) -> Column:
    """``1,4:8:2`` as 1, 4, 6, 8: ranges hold their end."""
    parts = F.split(_col(text), ",")

    def one(p: Column) -> Column:
        bits = F.transform(F.split(p, ":"), lambda b: F.trim(b).cast("int"))
        step = F.coalesce(F.get(bits, 2), F.lit(1))
        return F.when(F.size(bits) == 1, bits).when(F.get(bits, 1) >= bits[0], F.sequence(bits[0], F.get(bits, 1), step)).otherwise(F.array().cast("array<int>"))

    return F.flatten(F.transform(parts, one))


def token_of_base(tokens: Column | str) -> Column:
    """For every base the index of the token that covers it."""
    return F.flatten(F.transform(_col(tokens), lambda t, i: F.array_repeat(i, F.length(t))))


def tokens_of_window(tokens: Column | str, start: Column | int, end: Column | int) -> Column:
    """(first, behind the last) token of a window of bases."""
    return let(token_of_base(tokens), lambda owner: F.struct(F.get(owner, _int(start)).alias("first"), (F.get(owner, _int(end) - 1) + 1).alias("stop")))


def decimal_comma(text: Column | str) -> Column:
    """A number written with a decimal comma; null where it is none."""
    return F.replace(_col(text), F.lit(","), F.lit(".")).try_cast("double")


def finite(x: Column | str) -> Column:
    """NaN and infinities as null."""
    x = _col(x)
    return F.when(~F.isnan(x) & (F.abs(x) != float("inf")), x)


def contig_name(name: Column | str) -> Column:
    """``1`` as ``chr1``; ``MT`` as ``chrM``; names with the prefix stay."""
    name = _col(name)
    return F.when(name.startswith("chr"), name).when(name == "MT", "chrM").otherwise(F.concat(F.lit("chr"), name))


def contig_order(name: Column | str) -> Column:
    """1 to 22, then X and Y; null for all other contigs."""
    bare = F.regexp_replace(_col(name), "^chr", "")
    number = F.when(bare.rlike("^[0-9]+$"), bare.try_cast("int"))
    return F.when(number.between(1, 22), number).when(bare == "X", 23).when(bare == "Y", 24)


def variant_key(*parts: Column | str) -> Column:
    return F.concat_ws("_", *(_col(p).cast("string") for p in parts))
