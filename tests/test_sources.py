"""Files written by hand are read as they should be, and what is written is read back."""

import gzip

import pytest
from pyspark.sql import functions as F

from locusflow.functions import arrays, rules, sequence as sq
from locusflow.operators import kmers as km, metrics as mt, ordered
from locusflow.sources import files


def rows(df, *columns):
    return sorted(tuple(r) for r in (df.select(*columns) if columns else df).collect())


def write(tmp_path, name, text):
    path = tmp_path / name
    path.write_text(text)
    return str(path)


def test_delimited_files(spark, tmp_path):
    plain = write(tmp_path, "a.tsv", "x\t1\t2.5\ny\t2\t\n")
    assert rows(files.tsv(spark, plain, "name string, n int, v double", ["name", "v"])) == [("x", 2.5), ("y", None)]
    quoted = write(tmp_path, "b.csv", 'name,what\nx,"a, b"\n')
    assert rows(files.tsv(spark, quoted, "name string, what string", header=True, sep=",")) == [("x", "a, b")]
    with gzip.open(tmp_path / "c.tsv.gz", "wt") as f:
        f.write("x\t1\ny\t2\n")
    packed = files.tsv(spark, str(tmp_path / "c.tsv.gz"), "name string, n int")
    assert rows(packed) == [("x", 1), ("y", 2)]
    files.write_tsv(packed, str(tmp_path / "out"), ["name"], compression="gzip")
    assert list((tmp_path / "out").glob("*.gz")) and rows(files.tsv(spark, str(tmp_path / "out"), "name string, n int")) == rows(packed)


def test_bed_and_vcf(spark, tmp_path):
    bed = write(tmp_path, "a.bed", "chr1\t5\t9\tn\t1.5\t+\tT1\n")
    assert rows(files.bed(spark, bed, "transcript string")) == [("chr1", 5, 9, "n", 1.5, "+", "T1")]
    vcf = write(tmp_path, "a.vcf", "##x\n#CHROM\n1\t7\tid\tA\tC\t.\tPASS\tAC=2\tGT\t0/1\n")
    v = files.vcf(spark, vcf, ["contig", "pos", "ref", "alt", "info"])
    assert rows(v) == [("1", 7, "A", "C", "AC=2")] and rows(files.vcf_intervals(v)) == [("1", 6, 7, "GT=A/C;AC=2")]
    ids = spark.createDataFrame([("chr2_10_G_T",), ("odd",)], "id string")
    assert {r.id: (r.contig, r.pos, r.ref, r.alt) for r in files.variant_ids(ids, "id").collect()} == {"chr2_10_G_T": ("chr2", 10, "G", "T"), "odd": ("odd", None, None, None)}


def test_fasta_maf_and_species_come_back(spark, tmp_path):
    d = spark.createDataFrame([("a", "ACGT" * 45), ("b", "TT")], "name string, seq string")
    files.write_fasta(d.coalesce(1), str(tmp_path / "fa"))
    assert rows(files.fasta(spark, str(tmp_path / "fa"))) == rows(d)
    assert rows(files.sequence_index(d)) == [("a", 180), ("b", 2)]
    write(tmp_path, "mouse.fa", ">x\nAC\nGT\n>y\nA\n")
    assert rows(files.merged_species(spark, str(tmp_path / "mouse.fa"))) == [("mouse:x", "ACGT"), ("mouse:y", "A")]
    block = "a\ns hg.chr1 3 4 + 100 ACGT\ns mm.chr2 10 3 - 50 AC-T\n\na\ns hg.chr1 9 1 + 100 A\n"
    maf = files.maf(spark, write(tmp_path, "a.maf", block))
    columns = ["species", "contig", "start", "size", "strand", "seq"]
    assert rows(maf, *columns) == [("hg", "chr1", 3, 4, "+", "ACGT"), ("hg", "chr1", 9, 1, "+", "A"), ("mm", "chr2", 37, 3, "-", "AC-T")]
    files.write_maf(maf.coalesce(1), str(tmp_path / "maf"))
    assert rows(files.maf(spark, str(tmp_path / "maf")), *columns) == rows(maf, *columns)


def test_tracks_and_names(spark, tmp_path):
    track = write(tmp_path, "a.bedgraph", "chr1\t0\t3\t1.5\nchr1\t5\t6\t2\n")
    assert rows(files.bedgraph(spark, track)) == [("chr1", 1, 1.5), ("chr1", 2, 1.5), ("chr1", 3, 1.5), ("chr1", 6, 2.0)]
    assert rows(files.bedgraph(spark, track, first_only=True)) == [("chr1", 1, 1.5), ("chr1", 6, 2.0)]
    d = spark.createDataFrame([("x",), ("y",)], "name string")
    files.write_names(d, "name", str(tmp_path / "names"))
    assert rows(files.read_names(spark, str(tmp_path / "names"))) == [("x",), ("y",)]
    names = files.rename_map(spark, write(tmp_path, "map.txt", "1 chr1\n\nMT\tchrM\n"))
    assert rows(files.renamed(spark.createDataFrame([("1", 5), ("7", 6)], "contig string, pos int"), "contig", names)) == [("7", 6), ("chr1", 5)]


def test_results_and_parameters(spark, tmp_path):
    files.write_config(spark, {"seed": 3, "model": "m", "rates": [0.5, 1.0]}, str(tmp_path / "config"))
    assert files.read_config(spark, str(tmp_path / "config")) == {"seed": 3, "model": "m", "rates": [0.5, 1.0]}
    for i, (k, v) in enumerate([(1, "old"), (1, "new")]):
        spark.createDataFrame([(k, v)], "k int, v string").coalesce(1).write.parquet(str(tmp_path / f"r/part{i}"))
    assert rows(files.later_wins(spark, str(tmp_path / "r/*"), "k", {"extra": 7})) == [(1, "new", 7)]
    marked = files.with_path_fields(spark.read.parquet(str(tmp_path / "r/*")), {"part": r"part(\d)"})
    assert rows(marked, "v", "part") == [("new", "1"), ("old", "0")]
    one = spark.createDataFrame([(1,)], "x int")
    assert rows(files.tagged_union({("a", 1): one, ("b", 2): one.withColumn("y", F.lit(5))}, ["model", "fold"]), "model", "fold", "x", "y") == [("a", 1, 1, None), ("b", 2, 1, 5)]
    assert files.without_columns(marked, ["par"]).columns == ["k", "v"] and files.with_prefix(marked, "p", ["k"]).columns == ["k", "part"]
    path = write(tmp_path, "sum.txt", "abc")
    found = files.provenance(spark, path).first()
    assert found.md5 == "900150983cd24fb0d6963f7d28e17f72" and found.length == 3
    files.write_shards(spark.createDataFrame([(1, "a"), (2, "b")], "shard int, v string"), str(tmp_path / "shards"), "shard")
    assert rows(spark.read.parquet(str(tmp_path / "shards")).select("v", "shard")) == [("a", 1), ("b", 2)]
    peaks = [write(tmp_path, f"p{i}.bed", f"chr{i}\t1\t2\n") for i in (1, 2)]
    table = spark.createDataFrame([(p, f"cell{i}") for i, p in enumerate(peaks)], "path string, cell string")
    assert rows(files.listed_files(spark, table, "path", "contig string, start long, end long"), "contig", "cell") == [("chr1", "cell0"), ("chr2", "cell1")]
    arrays_out = spark.createDataFrame([("s", [[0.1, 0.9], [1.0, 0.0]])], "name string, probs array<array<double>>")
    arrays_out.write.parquet(str(tmp_path / "columnar"))
    assert rows(spark.read.parquet(str(tmp_path / "columnar")).select("name", F.col("probs")[0][1])) == [("s", 0.9)]


def test_sequence_and_array_functions(spark):
    one = lambda *c: tuple(spark.range(1).select(*c).first())
    assert one(sq.strip_gaps(F.lit("A-C")), sq.gap_strangers(F.lit("ACXG")), sq.shift(F.lit("ACGT"), -2), sq.shift(F.lit("ACGT"), 1)) == ("AC", "AC-G", "NNACGT", "CGT")
    assert one(sq.one_hot(F.lit("AN"))) == ([[1, 0, 0, 0], [0, 0, 0, 0]],) and one(sq.pad_classes(F.array(F.lit(1)), 4, centre=True, fill=9)) == ([9, 1, 9, 9],)
    assert one(*(sq.variant_type(F.lit(a), F.lit(b)) for a, b in (("A", "C"), ("AC", "A"), ("A", "AC"), ("AC", "GT")))) == ("SNP", "DEL", "INS", "INDEL")
    assert one(sq.chunks(F.lit("ABCDE"), 2)) == (["AB", "CD", "E"],) and one(sq.chunks(F.lit(""), 2)) == ([],)
    assert one(sq.match_places(F.lit("xACx" * 700), F.lit("AC"))) == ([4 * i + 1 for i in range(700)],) and one(sq.match_places(F.lit("aaaaa"), F.lit("aa"))) == ([0, 2],)
    probs = F.array(F.lit(1.0), F.lit(3.0))
    assert one(arrays.normalised(probs)) == ([0.25, 0.75],) and one(arrays.reversed_matrix(F.array(F.array(F.lit(1), F.lit(2)), F.array(F.lit(3), F.lit(4))))) == ([[4, 3], [2, 1]],)
    assert one(rules.meaningful_tokens(F.array(F.lit(1), F.lit(5), F.lit(0)), (0, 1))) == (1,)


def test_running_average_equals_the_fold(spark):
    values = [(k, i, float((i * 37) % 11) if i % 9 else None) for k, n in (("a", 2500), ("b", 3)) for i in range(n)]
    for beta in (0.98, 0.5, 1e-9):
        out = ordered.moving_average(spark.createDataFrame(values, "k string, i int, v double"), ["k"], ["i"], "v", beta).collect()
        got = {(r.k, r.i): r.ema for r in out}
        for k in ("a", "b"):
            s = 0.0
            for n, (_, i, v) in enumerate((x for x in values if x[0] == k), 1):
                s = s * beta + (v or 0.0) * (1 - beta)
                assert got[k, i] == pytest.approx(s / (1 - beta**n), rel=1e-6, abs=1e-12)


def test_weights_follow_large_means(spark):
    d = spark.range(4000)
    for mean in (0.3, 30.0):
        draws = [r[0] for r in d.select(mt.poisson_weight(F.col("id"), F.lit(1), mean)).collect()]
        by_column = [r[0] for r in d.select(mt.poisson_weight(F.col("id"), F.lit(1), F.lit(mean) + F.col("id") * 0)).limit(300).collect()]
        assert abs(sum(draws) / 4000 - mean) < 5 * (mean / 4000) ** 0.5 and by_column == draws[:300]
    with pytest.raises(ValueError):
        mt.poisson_weight(F.col("id"), F.lit(1), 1e6)


def test_bootstrap_interval_equals_weighted_aucs(spark):
    rows_ = [(i, i % 2, float((i * 7) % 13) if i % 17 else None, (i * 5) % 3 == 0) for i in range(200)]
    d = spark.createDataFrame(rows_, "id long, g long, score double, y boolean").withColumn("y", F.col("y").cast("int"))
    got = {r.g: r for r in mt.bootstrap_auc(d.repartition(5), ["g"], "id", "score", "y", 40).collect()}
    each = d.withColumn("replicate", F.explode(F.sequence(F.lit(1), F.lit(40))))
    draws = mt.roc_auc(each.withColumn("w", mt.poisson_weight(F.col("id"), F.col("replicate"))).filter("w > 0"), ["g", "replicate"], "score", "y", F.col("w"))
    for r in draws.groupBy("g").agg(F.avg("auc").alias("m"), F.percentile("auc", F.array(F.lit(0.025), F.lit(0.975))).alias("q")).collect():
        assert got[r.g].replicate_mean == pytest.approx(r.m) and got[r.g].half_width == pytest.approx((r.q[1] - r.q[0]) / 2)


def test_kmers_are_counted_in_the_row(spark):
    d = spark.createDataFrame([(1, "ACGTACNACé"), (2, None), (3, "AC"), (1, "ACG")], "k int, s string")
    want = [(1, "ACG", 2), (1, "CGT", 1), (1, "GTA", 1), (1, "TAC", 1)]
    assert rows(km.kmer_counts(d, "k", "s", 3)) == want
    assert rows(km.kmer_counts(d.filter("s <> 'ACG'"), "k", "s", 3, unique_key=True)) == [(1, "ACG", 1), (1, "CGT", 1), (1, "GTA", 1), (1, "TAC", 1)]
