import pytest
from pyspark.sql import functions as F

from locusflow.functions import arrays, sequence as sq
from locusflow.operators import alignment, intervals, joins, kmers, metrics, ordered, sampling
from locusflow.sources import files
from locusflow.streaming import streams


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_reverse_complement_keeps_case_and_strangers(spark):
    assert one(spark, sq.reverse_complement(F.lit("AACGTnN-"))) == "-NnACGTT"


def test_kmers_and_matches(spark):
    assert one(spark, sq.kmers(F.lit("ACTAC"), 2)) == ["AC", "CT", "TA", "AC"]
    assert one(spark, sq.kmers(F.lit("ACTACG"), 2, 2)) == ["AC", "TA", "CG"]
    assert one(spark, sq.kmers(F.lit("A"), 2)) == []
    assert one(spark, sq.match_places(F.lit("TAACTACACTAC"), F.lit("ACTAC"))) == [2, 7]
    assert one(spark, sq.motif_mask(F.lit("TACT"), F.lit("AC"))) == [0, 1, 1, 0]


def test_chunks_reach_back_at_the_end(spark):
    got = one(spark, sq.overlapping_chunks(F.lit("ABCDEFGHIJK"), 4, 1))
    assert [(c.chunk, c.left_shift) for c in got] == [("ABCD", 0), ("DEFG", 0), ("GHIJ", 0), ("HIJK", 2)]


def test_rolling_masks_cover_each_place_once(spark):
    masks = one(spark, arrays.rolling_masks(F.lit(6), 3))
    assert masks == [[1, 0, 0, 1, 0, 0], [0, 1, 0, 0, 1, 0], [0, 0, 1, 0, 0, 1]]


def test_small_scalars(spark):
    assert one(spark, sq.substitute(F.lit("ACGT"), 1, 2, F.lit(""))) == "AT"
    assert one(spark, sq.mask_outside(F.lit("ACGT"), 1, 3)) == "NCGN"
    assert one(spark, sq.longest_repeat(F.lit("AACACACG"), 2)) == 3
    assert one(spark, sq.first_lower(F.lit("ACgT"))) == 2
    assert one(spark, sq.hamming(F.lit("ACG"), F.lit("aTG"))) == 1
    assert one(spark, sq.range_list(F.lit("1,4:8:2,3:4,9:7"))) == [1, 4, 6, 8, 3, 4]
    depths = lambda *x: tuple(one(spark, sq.allele_depths(*map(F.lit, x))))
    assert depths("AU:CU", "7,8:3,4", "A", "C") == (7, 3)
    assert depths("DP:TAR:TIR", "9:5,6:2,2", "AC", "A") == (5, 2)
    assert depths("AU:CU", "7,8:3,4", "A", "C,G") == (-1, -1)
    assert one(spark, sq.variant_type_by_change(F.lit("AC"), F.lit("GT"))) == "SNP" and one(spark, sq.variant_type(F.lit("AC"), F.lit("GT"))) == "INDEL"
    assert one(spark, sq.info_field(F.lit("AC=1;AF=0.5"), "AF")) == "0.5"
    assert one(spark, sq.decimal_comma(F.lit("1,5"))) == 1.5
    assert one(spark, sq.finite(F.lit(float("inf")))) is None
    assert one(spark, sq.base_class(F.lit("ACGTN"))) == [0, 1, 2, 3, 4]
    assert one(spark, sq.token_of_base(F.array(F.lit("AC"), F.lit("G")))) == [0, 0, 1]
    assert one(spark, arrays.spread_mask(F.array(*map(F.lit, (0, 0, 0, 1, 0, 0, 0, 0))))) == [0, 1, 1, 1, 1, 1, 1, 0]


def test_masked_tokens_have_exact_counts(spark):
    for n, share, frame in ((100, 0.2, 0), (7, 0.15, 0), (50, 0.15, 5), (10, 0.5, 5), (0, 0.5, 0)):
        df = spark.range(5).select(F.col("id").alias("k"), F.expr(f"transform(sequence(1, {n}), i -> i % 4)" if n else "cast(array() as array<int>)").alias("t"))
        inner = n - 2 * frame
        parts = [round(share * 0.8 * inner), max(round(share * 0.1 * inner), 1), round(share * 0.1 * inner)] if inner > 0 else [0, 0, 0]
        for r in arrays.masked_tokens(df, "k", "t", share, frame=frame).collect():
            chosen = [i for i, x in enumerate(r.labels) if x != -100]
            assert len(chosen) == sum(parts) and sum(x == 4 for x in r.masked) == parts[0]
            assert all(frame <= i < n - frame and r.labels[i] == r.t[i] for i in chosen)
            assert all(r.masked[i] == r.t[i] for i in range(n) if i not in chosen)


def test_probability_scores(spark):
    import math

    m = F.array(*(F.array(*map(F.lit, row)) for row in ((1.0, 0.0, 0.0, 0.0), (0.5, 0.5, 1.0, 0.0), (0.1, 0.2, 0.3, 0.4))))
    other = F.array(*(F.array(*map(F.lit, row)) for row in ((0.0, 1.0, 0.0, 0.0), (0.5, 0.5, 1.0, 0.0), (0.4, 0.3, 0.2, 0.1))))
    odds = lambda p: math.log2(p + 1e-14) - math.log2(1 - p + 1e-14)
    got = one(spark, arrays.influence(m, other))
    assert got[1] == 0 and abs(got[0] - (odds(1.0) - odds(0.0))) < 1e-9 and abs(got[2] - (odds(0.4) - odds(0.1))) < 1e-9
    scores = [one(spark, c) for c in arrays.motif_scores(m, F.lit("AGC"), F.lit(1), 2)]
    assert abs(scores[0] - (0.5 + 0.2) / 2) < 1e-12
    assert abs(scores[1] - (-math.log(1e-14) - math.log(0.1 + 1e-14)) / 2) < 1e-9
    assert abs(scores[2] - (math.log(0.5) - math.log(1e-14) + math.log(0.2) - math.log(0.1)) / 2) < 1e-6
    assert abs(one(spark, arrays.motif_scores(m, F.lit("AGC"), F.lit(1), 2, "max")[0]) - 0.5) < 1e-12
    assert one(spark, arrays.track_score(F.array(*map(F.lit, (3.0, 1.0, 2.0))), F.lit(1), 2)) == 2.0
    assert one(spark, arrays.only_lower(F.array(*map(F.lit, (1, 2, 3, 4, 5))), F.lit("AcGtA"))) == [2, 3, 4]
    assert one(spark, arrays.only_lower(F.array(*map(F.lit, (1, 2))), F.lit("AC"))) == []
    assert one(spark, kmers.in_repeat(F.lit("AcG"), F.lit(1))) is True


def test_merge_and_subtract(spark):
    df = spark.createDataFrame([("c", a, b) for a, b in [(1, 3), (3, 5), (7, 9), (2, 4), (8, 12)]], "contig string, start long, end long")
    assert sorted((r.start, r.end) for r in intervals.merge_intervals(df).collect()) == [(1, 5), (7, 12)]
    whole = spark.createDataFrame([("c", "r", 0, 10)], "contig string, name string, start long, end long")
    assert sorted((r.start, r.end) for r in intervals.subtract_intervals(whole, df, bin_size=4).collect()) == [(0, 1), (5, 7)]


def test_bins_do_not_change_pairs(spark):
    a = spark.createDataFrame([("c", str(i), i * 3 % 50, i * 3 % 50 + 1 + i % 17) for i in range(60)], "contig string, name string, start long, end long")
    pairs = {n: sorted(map(tuple, intervals.overlap_join(a, a, bin_size=n).select("l_name", "r_name").collect())) for n in (1, 5, 64)}
    assert pairs[1] == pairs[5] == pairs[64]
    long = a.union(spark.createDataFrame([("c", f"long{i}", 3 * i, 20_000 * i + 50) for i in range(4)], a.schema))
    listed = lambda **x: sorted(map(tuple, intervals.overlap_join(long, long, **x).select("l_name", "r_name", "overlap").collect()))
    assert listed(bin_size=1, levels=3) == listed(bin_size=3, levels=2) == listed(bin_size=64)
    semi = lambda **x: sorted(r.name for r in intervals.overlap_join(long, a, how="left_semi", **x).distinct().collect())
    assert semi(bin_size=2, levels=3) == semi(bin_size=64)


def test_one_to_one_join_fails_on_repeats(spark):
    a = spark.createDataFrame([(1, 2), (1, 3)], "k int, a int")
    b = spark.createDataFrame([(1, 4)], "k int, b int")
    with pytest.raises(Exception, match="repeats a key"):
        joins.one_to_one_join(a, b, ["k"]).collect()


def test_auc_with_ties(spark):
    df = spark.createDataFrame([(0.1, 0), (0.4, 0), (0.4, 1), (0.8, 1), (None, 1)], "s double, y int")
    assert metrics.roc_auc(df, [], "s", "y").first().auc == 0.875


def test_samples_do_not_depend_on_partitions(spark):
    df = spark.range(200).withColumn("g", F.col("id") % 3)
    a = sampling.sample_per_group(df, ["g"], "id", 5).collect()
    b = sampling.sample_per_group(df.repartition(7), ["g"], "id", 5).collect()
    assert sorted(a) == sorted(b) and len(a) == 15



def test_chaining_and_netting(spark):
    rows = spark.createDataFrame(
        [("x", 0, 0, 2, "hg", "1", 0, 2, "+", "AC"), ("x", 0, 1, 2, "mm", "1", 5, 2, "+", "AG"), ("x", 1, 0, 2, "hg", "1", 2, 2, "+", "GT"), ("x", 1, 1, 2, "mm", "1", 7, 2, "+", "GT"), ("x", 1, 2, 2, "mm", "2", 0, 2, "+", "G-")],
        "k string, block long, row int, width int, species string, contig string, start long, size long, strand string, seq string",
    )
    chains = alignment.chain_fragments(rows, "k")
    assert {(r.species, r.seq) for r in chains.collect()} == {("hg", "ACGT"), ("mm", "AGGT"), ("mm", "--G-")}
    net = alignment.net_chains(alignment.with_reference_distance(chains, "k", "hg"), "k")
    assert {(r.species, r.seq) for r in net.collect()} == {("hg", "ACGT"), ("mm", "AGGT")}
    # the second-best chain of a contig fills gaps only where it does not overlap the best
    own = [("x", "mm", 1, "A--T", "1", 0, 4), ("x", "mm", 2, "ACCT", "1", 2, 6), ("x", "mm", 3, "-G--", "1", 4, 8), ("x", "mm", 4, "TTTT", "2", 0, 4)]
    ranked = spark.createDataFrame(own, "k string, species string, rank int, seq string, contig string, start long, end long")
    assert [r.seq for r in alignment.net_chains(ranked, "k").collect()] == ["AGTT"]


def test_overlaps_are_excluded_in_order(spark):
    import random

    random.seed(3)
    rows = [("c", i, s, s + random.randint(1, 9)) for i, s in enumerate(random.randrange(60) for _ in range(40))]
    kept = []
    for _, i, a, b in rows:
        if all(b <= x or y <= a for _, x, y in kept):
            kept.append((i, a, b))
    out = alignment.exclude_overlaps(spark.createDataFrame(rows, "k string, i int, start long, end long"), ["k"], ["i"])
    assert sorted((r.i, r.start, r.end) for r in out.collect()) == sorted(kept)


def test_gap_blocks(spark):
    rows = spark.createDataFrame([(0, 0, "hg", "1", 10, 4, "+", 99, "AC-GT"), (0, 1, "mm", "2", 5, 3, "+", 99, "A-TG-")], "block long, row int, species string, contig string, start long, size long, strand string, contig_length long, seq string")
    got = {(r.part, r.species, r.start, r.size, r.seq) for r in alignment.gap_blocks(rows, "hg").collect()}
    assert got == {(1, "hg", 10, 2, "AC"), (1, "mm", 5, 1, "A-"), (2, "hg", 12, 2, "GT"), (2, "mm", 7, 1, "G-")}


def test_fasta_and_tiles(spark, tmp_path):
    (tmp_path / "a.fa").write_text(">one x\nACGT\nAC\n>two\nGGtt\n")
    seqs = files.fasta(spark, str(tmp_path / "a.fa"))
    assert {(r.name, r.seq) for r in seqs.collect()} == {("one x", "ACGTAC"), ("two", "GGtt")}
    files.write_fasta(seqs, str(tmp_path / "b"), 4)
    assert {(r.name, r.seq) for r in files.fasta(spark, str(tmp_path / "b")).collect()} == {("one x", "ACGTAC"), ("two", "GGtt")}
    wanted = spark.createDataFrame([("q", "two", 1, 4)], "name string, contig string, start long, end long")
    assert files.fetch(wanted, files.tiles(seqs, 2), 2).first().seq == "Gtt"


def test_maf_gtf_log(spark, tmp_path):
    (tmp_path / "a.maf").write_text("a\ns hg.chr1 2 3 + 20 ACG\ns mm.chr2 4 3 - 30 A-G\n\na\ns hg.chr1 9 2 + 20 AC\n\n")
    rows = files.maf(spark, str(tmp_path / "a.maf")).collect()
    assert sorted((r.species, r.start) for r in rows) == [("hg", 2), ("hg", 9), ("mm", 23)]
    (tmp_path / "a.gtf").write_text('#c\n1\tx\texon\t5\t9\t.\t+\t.\tgene_name "G"; transcript_id "T";\n1\tx\tgene\t1\t9\t.\t+\t.\tgene_name "G";\n')
    assert [tuple(r) for r in files.gtf(spark, str(tmp_path / "a.gtf"), "exon").collect()] == [("1", 4, 9, "+", "G", "T")]
    (tmp_path / "log").mkdir()
    (tmp_path / "log" / "1.txt").write_text("[2024/01/02-03:04:05] checkpoint 3 - train (epoch: 1; sequences: 20; x), loss: 0.5, total acc: 0.25\nnoise\n[2024/01/02-04:04:05] epoch 2 - test (sequences: 40), loss: 0.75\n")
    events = files.training_log(spark.read.text(str(tmp_path / "log"))).collect()
    assert [(e.metric, e.value, e.epoch, e.n_sequences) for e in events] == [("loss", 0.5, 1, 20), ("total acc", 0.25, 1, 20), ("loss", 0.75, 2, 40)]
    for _ in range(2):  # the second run finds nothing new
        streams.to_parquet(streams.log_events(spark, str(tmp_path / "log")), str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 3


def test_kmers_are_counted_row_by_row(spark, monkeypatch):
    import random
    from collections import Counter

    rnd = random.Random(1)
    seqs = ["".join(rnd.choice("ACGTNé") for _ in range(rnd.randint(0, 40))) for _ in range(60)] + [None, "", "AC", "ACG" * 30]
    df = spark.createDataFrame(list(enumerate(seqs)), "id int, seq string").repartition(3)
    for k, at_once in ((1, 2_000_000), (3, 2_000_000), (3, 20), (6, 50), (12, 2_000_000)):
        monkeypatch.setattr(kmers, "BASES_AT_ONCE", at_once)
        wanted = Counter((i, s[j : j + k]) for i, s in enumerate(seqs) if s for j in range(len(s) - k + 1) if set(s[j : j + k]) <= set("ACGT"))
        for unique in (True, False):
            assert {(r.id, r.kmer): r.n for r in kmers.kmer_counts(df, "id", "seq", k, unique).collect()} == wanted


def test_markov_probabilities_sum_to_one(spark):
    df = spark.createDataFrame([(1, "ACGTACGGTN")], "id int, seq string")
    t = kmers.markov_forward(kmers.corpus_kmer_counts(df, "seq", 2, 0.1))
    assert all(abs(r.s - 1) < 1e-9 for r in t.groupBy("k", "prefix").agg(F.sum("p").alias("s")).collect())


@pytest.mark.parametrize("length, overlap", [(128, 16), (4, 1), (5, 0), (3, 2)])
def test_chunks_are_those_of_a_loop(spark, length, overlap):
    texts = ["x" * 0, "a", "ab", *("ACGTTGCAé\n𝄞"[i % 5 :] * (i + 1) for i in range(30)), None]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, t string")
    got = {r.id: [tuple(c) for c in r.c] for r in df.select("id", sq.overlapping_chunks("t", length, overlap).alias("c")).collect()}
    for i, t in enumerate(texts):
        n = len(t or "")
        want = [(t and t[max(min(s, n - length), 0) :][:length], max(min(s, n - length), 0), s - max(min(s, n - length), 0)) for s in range(0, max(n - overlap, 1), length - overlap)]
        assert got[i] == want


def test_stitched_texts_are_those_of_arrays(spark):
    df = spark.createDataFrame([(1, 1, "CDE", 1), (1, 0, "ABC", 0), (2, 0, "", 0), (3, 1, "X", 4), (3, 0, "é𝄞", 1)], "k int, o int, v string, d int")
    got = {r.k: r.v for r in ordered.stitch_chunks(df, "k", "o", "v", "d").collect()}
    assert got == {1: "ABCDE", 2: "", 3: "𝄞"}
    split = ordered.stitch_chunks(df.withColumn("v", F.split("v", "")), "k", "o", "v", "d").select("k", F.concat_ws("", "v").alias("v"))
    assert {r.k: r.v for r in split.collect()} == got


@pytest.mark.parametrize("motif, before, behind", [("ACG", 3, 2), ("AA", 0, 0), ("ACA", 1, 4), ("é", 2, 1), (".", 3, 2)])
def test_mask_sizes_are_those_of_the_masks(spark, motif, before, behind):
    texts = ["ACGACGTTACG", "AAAAA", "ACACACA", "", "TT", None, "ACGTTTTTTTACG", "xéyé𝄞ACG", "A.C", "G" * 50 + "ACG"]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, t string").coalesce(2)
    got = {r.id: (r.covered, r.near) for r in kmers.motif_mask_sizes(df, "id", "t", motif, before, behind).collect()}
    ones = lambda c: F.size(F.filter(c, lambda x: x == 1))
    mask = df.filter("t is not null").withColumn("m", sq.motif_mask("t", F.lit(motif)))
    want = {r.id: (r.c, r.n) for r in mask.select("id", ones("m").alias("c"), ones(arrays.spread_mask("m", before, behind)).alias("n")).collect()}
    assert got == want | {5: (0, 0)}


def test_texts_as_bases_are_those_of_the_expression(spark):
    texts = ["", None, "Hello, World", "abcdefghijklmnopqrstuvwxyz ABCDEFGHIJKLMNOPQRSTUVWXYZ", "\u212a\u0130\u00e9\u00ff\U0001d11e zz", "\u4e2d\u6587", "12 3\n\tx", None, "x" * 1000]
    df = spark.createDataFrame([(i, t, "s") for i, t in enumerate(texts)], "id long, t string, s string")
    for rows in (df.coalesce(1), df.filter("id <> 4").coalesce(1), df.limit(0)):
        want = {r.id: r.b for r in rows.select("id", sq.as_bases("t").alias("b")).collect()}
        assert {r.id: r.t for r in kmers.texts_as_bases(rows, "t").select("id", "t", "s").collect()} == want
