"""Steps whose disk or time grew faster than their input: nothing of a sequence's length is shuffled, and odd rows give what a loop gives."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

from locusflow.operators import kmers
from locusflow.plans import alignment_queries, job_queries, sequence_queries  # noqa: F401
from locusflow.plans.registry import QUERIES

FOLDER = "/root/testdata/sf0.001"
SEQS = ["", None, "A", "AAAA", "ACACACAC", "GGNNGGG", "acgtACG", "éé€TT", "CCCAAACCC", "ACGTACGTTTGA" * 9, "NNN", "ACGGT"]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(list(enumerate(SEQS)), "id int, seq string").repartition(3).cache()


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def longest(s, k):
    best = {}
    for i in range(len(s) - k + 1):
        w, n = s[i : i + k], 1
        while s[i + n * k : i + (n + 1) * k] == w:
            n += 1
        if set(w) <= set("ACGT"):
            best[w] = max(best.get(w, 0), n)
    return best


@pytest.mark.parametrize("at_once", [2_000_000, 5])
def test_repeat_runs_stay_in_the_row(spark, odd, monkeypatch, at_once):
    monkeypatch.setattr(kmers, "BASES_AT_ONCE", at_once)
    for k in (1, 2, 3):
        wanted = {(i, w): n for i, s in enumerate(SEQS) if s for w, n in longest(s, k).items()}
        for unique in (True, False):
            assert {(r.id, r.kmer): r.run for r in kmers.repeat_runs(odd, "id", "seq", k, unique).collect()} == wanted
    assert "Exchange" not in plan(QUERIES["repeat_runs"](spark, FOLDER))


def test_feature_table_stays_in_the_row(spark, odd):
    rows = {r.id: r for r in kmers.minimal_feature_table(odd, "id", "seq").collect()}
    assert len(rows) == len(SEQS) and rows[1].share_A is None and rows[1].count_AA is None and rows[1].run_any == 0
    for i, s in enumerate(SEQS):
        if s is not None:
            pairs, runs = Counter(s[j : j + 2] for j in range(len(s) - 1)), longest(s, 1) | longest(s, 2)
            assert all(rows[i][f"count_{w}"] == pairs[w] for w in kmers.domain(2)) and all(rows[i][f"run_{w}"] == runs.get(w, 0) for w in [*"ACGT", *kmers.domain(2)])
            assert rows[i].uniformity == sum(x == y for x, y in zip(s, s[1:])) and rows[i].run_any == max(runs.get(b, 0) for b in "ACGT")
            assert rows[i].share_A == (s.count("A") / len(s) if s else None) and rows[i].rate_AC == (pairs["AC"] / (len(s) - 1) if len(s) > 1 else (None if len(s) == 1 else 0.0))
    assert "Exchange" not in plan(QUERIES["minimal_features"](spark, FOLDER))


def test_motifs_are_counted_in_the_row(spark, odd, monkeypatch):
    motifs = spark.createDataFrame([("x", "ACG"), ("x", "CCC"), ("y", "ACG"), ("y", "ACG"), ("y", "GNN"), ("z", "TTT")], "t string, m string")
    wanted = {}
    for i, s in enumerate(SEQS):
        for t, own in {"x": {"ACG", "CCC"}, "y": {"ACG"}, "z": {"TTT"}}.items():
            at = [j for j in range(len(s or "") - 2) if s[j : j + 3] in own]
            if at:
                wanted[i, t] = (len(at), len({s[j : j + 3] for j in at}), at[0])
    for at_once, most in ((2_000_000, 100), (5, 100), (2_000_000, 2)):
        monkeypatch.setattr(kmers, "BASES_AT_ONCE", at_once)
        monkeypatch.setattr(kmers, "MOST_MOTIFS", most)
        assert {(r.id, r.t): (r.hits, r.motifs, r.first_start) for r in kmers.motif_counts(odd, "id", "seq", motifs, "t", "m", 3).collect()} == wanted
    monkeypatch.setattr(kmers, "MOST_MOTIFS", 100_000)
    assert kmers.motif_counts(odd, "id", "seq", motifs.filter("false"), "t", "m", 3).count() == 0
    assert "Exchange" not in plan(QUERIES["motif_hits"](spark, FOLDER))


def test_corpus_counts_are_made_in_the_row(spark, odd):
    wanted = Counter(s[j : j + k] for s in SEQS if s for k in (1, 2, 3) for j in range(len(s) - k + 1) if set(s[j : j + k]) <= set("ACGT"))
    counts = kmers.corpus_kmer_counts(odd, "seq", 3)
    assert {r.kmer: r.n for r in counts.collect()} == wanted and "Generate" not in plan(counts)


def test_markov_sums_are_those_of_the_scores(spark, odd):
    counts = kmers.corpus_kmer_counts(odd, "seq", 3)
    model = kmers.markov_forward(counts).filter("kmer <> 'ACG'")
    each = kmers.forward_scores(odd, "id", "seq", model, 2).groupBy("id").agg(F.count(F.lit(1)).alias("n"), F.sum(F.log("p")).alias("s"))
    wanted = {r.id: (r.n, r.s and round(r.s, 9)) for r in each.collect()}
    got = kmers.forward_likelihood(odd, "id", "seq", model, 2)
    assert {r.id: (r.n, r.log_likelihood and round(r.log_likelihood, 9)) for r in got.collect()} == wanted
    two = kmers.markov_both_sides(counts).filter("kmer <> 'CGT'")
    p = {r.kmer: r.p for r in two.collect()}
    seen = []
    for s in SEQS:
        for i in range(len(s or "")):
            r = min(1, i, len(s) - 1 - i)
            w = s[i - r : i + r + 1]
            if w in p:
                seen.append(p[w] == max(p.get(w[:r] + b + w[r + 1 :], -1) for b in "ACGT"))
    out = kmers.both_sides_accuracy(odd, "seq", two, 1).first()
    assert out.n == len(seen) and abs(out.accuracy - sum(seen) / len(seen)) < 1e-12
    for name in ("markov_base_scores", "markov_accuracy"):
        assert "Generate" not in plan(QUERIES[name](spark, FOLDER))


def test_masks_are_drawn_in_the_row(spark):
    from hashlib import md5

    from locusflow.functions import arrays

    rows = [("a", [0, 1, 2, 3, 4] * 12), (None, [1] * 11), ("b", None), ("c", []), ("é", [2, None, 3] * 9), ("d", [1] * 10)]
    df = spark.createDataFrame(rows, "k string, t array<int>").repartition(2)
    out = arrays.masked_tokens(df, "k", "t", 0.4, seed=7, frame=5)
    got = {r.k: r for r in out.collect()}
    assert "Sort" not in plan(out) and "md5" not in plan(out)
    for k, t in rows:
        if t is None:
            assert got[k].masked is None and got[k].labels is None
            continue
        n, masked, labels = len(t) - 10, list(t), [-100] * len(t)
        if n > 0:
            h = {i: md5(f"{'' if k is None else k + ':'}{i}:7".encode()).hexdigest() for i in range(5, 5 + n)}
            a = round(0.4 * 0.8 * n)
            b = a + max(round(0.4 * 0.1 * n), 1)
            for r, i in enumerate(sorted(h, key=lambda i: (h[i], i))[: b + round(0.4 * 0.1 * n)]):
                labels[i] = t[i]
                masked[i] = 4 if r < a else int(h[i][13:21], 16) % 4 if r < b else t[i]
        assert got[k].masked == masked and got[k].labels == labels


def test_species_are_written_by_every_task(spark, monkeypatch):
    from locusflow.plans import source_queries
    from locusflow.sources import files

    whole = source_queries._genome
    monkeypatch.setattr(source_queries, "_genome", lambda spark, folder: whole(spark, folder).repartition(3))
    seen, write = [], files.write_fasta

    def noted(df, path):
        seen.append(df.rdd.getNumPartitions())
        write(df, path)

    monkeypatch.setattr(files, "write_fasta", noted)
    out = QUERIES["species_round_trip"](spark, FOLDER).collect()
    assert seen == [3] and len({r.name for r in out}) == len(out) == whole(spark, FOLDER).count() and all(r.name.startswith("docs:") for r in out)


def test_bootstrap_draws_are_digests_of_key_and_replicate(spark):
    from hashlib import md5

    import numpy as np

    from locusflow.operators import metrics as mt
    from locusflow.plans.registry import ORACLE_SQL

    assert "md5(doc_id || ':' || rep)" in ORACLE_SQL["bootstrap_auc"]
    wanted = [[int(md5(f"{k}:{r}".encode()).hexdigest()[:13], 16) / 2**52 for r in (1, 2, 3)] for k in (5, 77)]
    assert mt._digest_uniforms(np.array(["5", "77"], object), 3).tolist() == wanted


def test_overlaps_are_left_out_in_a_stream(spark):
    from locusflow.operators import alignment

    rows = [(k, i, (i * 7 + k) % 40, (i * 7 + k) % 40 + 1 + i % 6) for k in range(5) for i in range(30)]
    wanted = set()
    for k in range(5):
        kept = []
        for r in sorted(r for r in rows if r[0] == k):
            if all(r[3] <= a or b <= r[2] for *_, a, b in kept):
                kept.append(r)
        wanted |= set(kept)
    out = alignment.exclude_overlaps(spark.createDataFrame(rows, "k int, i int, start long, end long"), ["k"], ["i"])
    assert {tuple(r) for r in out.collect()} == wanted and out.count() == len(wanted)
    # no call of Python for each island
    assert "FlatMapGroups" not in plan(out) and "FlatMapGroups" not in plan(QUERIES["alignment_frequencies"](spark, FOLDER))


def test_edited_places_are_worked_out_once(spark):
    from locusflow.functions import sequence as sq

    text = lambda c: plan(spark.createDataFrame([("ACgtN", 1)], "seq string, k int").select(c.alias("c")))
    nested = sq.lower_at(sq.lower_at(sq.lower_at("seq", F.col("k")), F.col("k") + 1), F.col("k") + 2)
    assert text(nested).count("seq#") < 27 and "RLIKE" not in text(sq.lower_places("seq"))
    out = spark.createDataFrame([("ACGTN", 1), ("", 0), ("éACGa", 0)], "seq string, k int").select(nested.alias("low"), sq.median_lower("seq").alias("m"), sq.one_hot("seq").alias("hot")).collect()
    assert [r.low for r in out] == ["AcgtN", "", "éacGa"] and [r.m for r in out] == [None, None, 4]
    assert out[0].hot == [[1, 0, 0, 0], [0, 1, 0, 0], [0, 0, 1, 0], [0, 0, 0, 1], [0, 0, 0, 0]]
