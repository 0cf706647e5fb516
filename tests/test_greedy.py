"""Greedy choices against plain loops that follow their rules step by step."""

import random


from locusflow.operators import alignment, intervals, matching, ordered, scans


def brute_matches(refs, tests, most=None):
    """A matrix of allowed gaps, the smallest cell taken again and again."""
    refs, tests = sorted(set(refs)), sorted(set(tests))
    cells = {}
    for i, r in enumerate(refs):
        low = r - refs[i - 1] if i else 10**10
        high = refs[i + 1] - r if i + 1 < len(refs) else 10**10
        for t in tests:
            gap = abs(r - t)
            if gap < (low if r >= t else high) and (most is None or gap <= most):
                cells[r, t] = gap
    out = []
    while cells:
        r, t = min(cells, key=lambda c: (cells[c], c))
        out.append((r, t))
        cells = {c: g for c, g in cells.items() if c[0] != r and c[1] != t}
    return sorted(out)


def test_matches_follow_the_matrix_rule(spark):
    rnd, refs, tests = random.Random(4), {}, {}
    for k in range(300):
        width = rnd.choice([8, 20, 60])
        refs[k] = [rnd.randrange(width) for _ in range(rnd.randint(0, 12))]
        tests[k] = [rnd.randrange(width) for _ in range(rnd.randint(0, 12))]
    refs[300], tests[300] = [10, 20], [22]
    table = lambda d, c: spark.createDataFrame([(k, x) for k, v in d.items() for x in v], f"k int, {c} long")
    for most in (None, 3):
        got = {}
        for r in matching.best_matches(table(refs, "place"), table(tests, "other"), ["k"], most).collect():
            assert r.gap == abs(r.place - r.other)
            got.setdefault(r.k, []).append((r.place, r.other))
        for k in refs:
            assert sorted(got.get(k, [])) == brute_matches(refs[k], tests[k], most), (refs[k], tests[k])
    counts = ordered.within_tolerances(matching.best_matches(table(refs, "place"), table(tests, "other"), ["k"]), ["k"], "gap", [2, 5]).collect()
    for r in counts:
        gaps = [abs(a - b) for a, b in brute_matches(refs[r.k], tests[r.k])]
        n0, n5 = sum(g == 0 for g in gaps), sum(g <= 5 for g in gaps)
        assert (r.within_0, r.within_5) == (n0, n5) and abs(r.mobility_5 - (n5 - n0) / (n5 + 1)) < 1e-12


def brute_chains(blocks, most_gap=50):
    """Chains of one alignment, block by block; starts are on the forward strand."""
    chains, done = [], 0
    for width, rows in blocks:
        pairs = []
        for i, (sp, contig, start, size, strand, _) in enumerate(rows):
            for j, c in enumerate(chains):
                if c["lane"] == (sp, contig, strand):
                    gap = start - c["end"] if strand == "+" else c["start"] - (start + size)
                    if 0 <= gap < most_gap:
                        pairs.append((gap, i, j))
        of, used, old = {}, set(), len(chains)
        for _, i, j in sorted(pairs):
            if i not in of and j not in used:
                of[i] = j
                used.add(j)
        for i, (sp, contig, start, size, strand, seq) in enumerate(rows):
            if i not in of:
                of[i] = len(chains)
                chains.append({"lane": (sp, contig, strand), "seq": "-" * done, "start": start, "end": start + size})
            c = chains[of[i]]
            c["seq"] += seq
            c["start"], c["end"] = min(c["start"], start), max(c["end"], start + size)
        for j, c in enumerate(chains):
            if j not in of.values():
                c["seq"] += "-" * width
        done += width
    return [(*c["lane"], c["seq"], c["start"], c["end"]) for c in chains]


def alignments(n, seed):
    rnd, out = random.Random(seed), {}
    for k in range(n):
        blocks = []
        for b in range(rnd.randint(1, 6)):
            width = rnd.randint(2, 6)
            rows = [("ref", "1", b * 6, width, "+", "".join(rnd.choice("ACGT") for _ in range(width)))]
            for _ in range(rnd.randint(0, 6)):
                seq = "".join(rnd.choice("ACGTacn-") for _ in range(width))
                size = len(seq.replace("-", ""))
                if size:
                    rows.append((rnd.choice(["s1", "s2"]), rnd.choice("12"), rnd.randrange(0, 120), size, rnd.choice("+-"), seq))
            blocks.append((width, rows))
        out[k] = blocks
    return out


SHAPE = "k int, block long, row int, width int, species string, contig string, start long, size long, strand string, seq string"


def test_chains_take_the_smallest_gap_of_a_block_first(spark):
    every = alignments(120, 7)
    # the later row has the smaller gap to the one chain
    every[1000] = [(2, [("ref", "1", 0, 2, "+", "AC"), ("s1", "1", 10, 2, "+", "AC")]), (2, [("ref", "1", 2, 2, "+", "GT"), ("s1", "1", 30, 2, "+", "TT"), ("s1", "1", 12, 2, "+", "GG")])]
    rows = [(k, b, i, w, *r) for k, blocks in every.items() for b, (w, rs) in enumerate(blocks) for i, r in enumerate(rs)]
    got = {}
    for r in alignment.chain_fragments(spark.createDataFrame(rows, SHAPE).repartition(5), "k").collect():
        got.setdefault(r.k, []).append((r.species, r.contig, r.strand, r.seq, r.start, r.end))
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(brute_chains(v)) for k, v in every.items()}
    assert ("s1", "1", "+", "ACGG", 10, 14) in got[1000]


def test_alignment_to_column_frequencies(spark):
    every = alignments(40, 9)
    rows = [(k, b, i, w, *r) for k, blocks in every.items() for b, (w, rs) in enumerate(blocks) for i, r in enumerate(rs)]
    got = {(r.k, r.pos): (r.A, r.C, r.G, r["T"]) for r in alignment.frequencies_of_alignment(spark.createDataFrame(rows, SHAPE), "k", "ref").collect()}
    wanted = {}
    for k, blocks in every.items():
        chains = brute_chains(blocks)
        ref = next(c for c in chains if c[0] == "ref")[3]
        net = []
        for sp in {c[0] for c in chains}:
            own = sorted((sum(x != y for x, y in zip(c[3].upper(), ref)), c[1], i, c) for i, c in enumerate(chains) if c[0] == sp)
            kept = []
            for *_, c in own:
                if all(c[1] != d[1] or c[5] <= d[4] or d[5] <= c[4] for d in kept):
                    kept.append(c)
            net.append("".join(next((c[3][i] for c in kept if c[3][i] != "-"), "-") for i in range(len(ref))))
        for i in range(len(ref)):
            wanted[k, i] = tuple(sum(s[i].upper() == b for s in net) for b in "ACGT")
    assert {p: c for p, c in got.items() if any(c)} == {p: c for p, c in wanted.items() if any(c)}


def test_running_values_do_not_depend_on_bins(spark):
    rnd = random.Random(2)
    rows = [(rnd.choice(["a", "b", None]), rnd.randrange(-50, 50), i, rnd.choice([None, 1, 2, 3])) for i in range(400)]
    df = spark.createDataFrame(rows, "k string, at long, id int, v int")
    from pyspark.sql import functions as F

    values = {"s": ("sum", F.col("v")), "m": ("max", F.col("v")), "l": ("last", F.col("v"))}
    for inclusive in (True, False):
        wanted = {}
        for k in {r[0] for r in rows}:
            total, most, last = 0, None, None
            for _, _, i, v in sorted((r for r in rows if r[0] == k), key=lambda r: (r[1], r[2])):
                if not inclusive:
                    wanted[i] = total, most, last
                if v is not None:
                    total, most, last = total + v, v if most is None else max(most, v), v
                if inclusive:
                    wanted[i] = total, most, last
        for span in (1, 7, 1000):
            got = scans.running(df, ["k"], "at", ["at", "id"], values, inclusive, span).collect()
            assert {r.id: (r.s, r.m, r.l) for r in got} == wanted


def test_dense_places_cost_no_pairs(spark):
    """20,000 points of one place: counts follow from places, not pairs."""
    from pyspark.sql import functions as F

    p = spark.range(20_000).select(F.col("id").alias("point_id"), F.lit("c").alias("contig"), F.lit(5).cast("long").alias("pos"), F.when(F.col("id") % 4 == 0, "x").otherwise("y").alias("kind"))
    n = intervals.neighbour_counts(p, 10, "kind").groupBy("near_category").agg(F.min("neighbours").alias("low"), F.max("neighbours").alias("high")).collect()
    assert {(r.near_category, r.low, r.high) for r in n} == {("x", 4999, 5000), ("y", 14999, 15000)}


def test_flanking_and_islands_against_loops(spark):
    rnd = random.Random(6)
    q = [(i, rnd.choice("ab"), rnd.randrange(40)) for i in range(60)]
    c = [(100 + i, rnd.choice("ab"), rnd.randrange(40)) for i in range(80)]
    shape = "point_id long, contig string, pos long"
    got = {r.point_id: (r.left, r.right) for r in intervals.flanking(spark.createDataFrame(q, shape), spark.createDataFrame(c, shape), 3, 6, span=5).collect()}
    for i, contig, pos in q:
        sides = []
        for sign in (-1, 1):
            near = sorted((abs(x - pos), j) for j, d, x in c if d == contig and 0 < (x - pos) * sign <= 6)
            sides.append(([j for _, j in near] + [-1] * 3)[:3])
        assert got[i] == tuple(sides)
    spans = [("c", str(i), s, s + rnd.randint(0, 6)) for i, s in enumerate(rnd.randrange(100) for _ in range(50))]
    table = spark.createDataFrame(spans, "contig string, name string, start long, end long")
    for gap in (0, 2, -1, -3):
        merged, reach = [], None
        for _, _, s, e in sorted(spans, key=lambda x: (x[2], x[3])):
            if reach is None or s > reach + gap:
                merged.append([s, e, 0])
                reach = e
            reach = max(reach, e)
            merged[-1] = [merged[-1][0], max(merged[-1][1], e), merged[-1][2] + 1]
        for span in (4, 1 << 18):
            assert sorted([r.start, r.end, r.members] for r in intervals.merge_intervals(table, min_gap=gap, span=span).collect()) == sorted(merged)


def test_percentiles_are_selected_exactly(spark):
    import numpy as np

    from locusflow.operators import metrics

    rnd = random.Random(11)
    groups = {"even": [float(i) for i in range(997)], "ties": [rnd.choice([1.0, 1.0, 2.0, 5.5]) for _ in range(800)], "skewed": [10.0 ** rnd.uniform(-12, 12) for _ in range(900)], "one": [3.25], None: [rnd.gauss(0, 1) for _ in range(300)]}
    rows = [(g, v) for g, vs in groups.items() for v in vs] + [("even", None), ("even", float("nan")), ("empty", None)]
    rnd.shuffle(rows)
    df = spark.createDataFrame(rows, "g string, v double")
    shares = (0.0, 0.1, 0.5, 0.93, 1.0)
    for bins, most in ((4096, 200_000), (256, 60)):  # looked up at once, and after several narrowings
        got = {r.g: r.percentiles for r in metrics.group_percentiles(df, ["g"], "v", shares, bins, most).collect()}
        assert set(got) == set(groups)
        for g, vs in groups.items():
            assert np.allclose(got[g], np.quantile(vs, shares), rtol=1e-12, atol=0)
    assert np.allclose(metrics.group_percentiles(df, [], "v", (0.5,)).first().percentiles, np.median([v for vs in groups.values() for v in vs]))


def test_sums_of_a_bootstrap_equal_repeated_rows(spark):
    from pyspark.sql import functions as F

    from locusflow.operators import metrics

    df = spark.range(300).select("id", (F.col("id") % 3).alias("g"), (F.col("id") * F.col("id") % 101).cast("double").alias("v"), ((F.col("id") % 5) / F.lit(2.0)).alias("rate")).repartition(6)
    for mean in (1.0, F.col("rate")):
        got = {r.g: r for r in metrics.bootstrap_metric(df, ["g"], "id", [F.col("v"), F.lit(1.0)], lambda s: F.try_divide(s[0], s[1]), 50, mean).collect()}
        each = df.withColumn("r", F.explode(F.sequence(F.lit(1), F.lit(50)))).withColumn("w", metrics.poisson_weight(F.col("id"), F.col("r"), mean))
        draws = each.groupBy("g", "r").agg((F.sum(F.col("w") * F.col("v")) / F.sum("w")).alias("x"))
        wanted = draws.groupBy("g").agg(F.avg("x").alias("m"), ((F.percentile("x", 0.975) - F.percentile("x", 0.025)) / 2).alias("h")).collect()
        for r in wanted:
            assert abs(got[r.g].replicate_mean - r.m) < 1e-9 and abs(got[r.g].half_width - r.h) < 1e-9


def test_fragments_are_chained_once_and_across_batches(spark, capsys):
    import random

    rng = random.Random(4)
    rows = [(d, b, r, 4, rng.choice(["s", "t"]), rng.choice(["a", "b"]), rng.randrange(b * 20, b * 20 + 60), 4, rng.choice("+-"), "ACGT") for d in range(6) for b in range(5) for r in range(rng.randrange(1, 7))]
    df = spark.createDataFrame(rows, "k long, block int, row int, width int, species string, contig string, start int, size int, strand string, seq string")
    whole = sorted(alignment.chain_fragments(df, "k").collect())
    alignment.chain_fragments(df, "k").explain()
    assert capsys.readouterr().out.count("MapInArrow") == 1
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2")
    try:
        assert sorted(alignment.chain_fragments(df, "k").collect()) == whole
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert {(r.k, len(r.seq)) for r in whole} == {(d, 20) for d in range(6)}
