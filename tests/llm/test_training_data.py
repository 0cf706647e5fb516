"""The training-data operators against brute-force versions on small tables, with the odd cases that their docstrings define."""

import hashlib
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from locusflow.llm import ann_mih, hmm_lm, jaccard_join, license_scan, piece_codec, pii_bootstrap, quality_cascade, source_mixing, token_counts, url_reputation
from locusflow.llm.license_templates import TEXTS
from locusflow.llm.queries import model_path

WORD = r"[^\x20\x09-\x0D]+"
ODD = [(1, None), (2, ""), (3, " \n\t "), (4, "one two three four"), (5, "x " * 400), (None, "no id here at all today"), (6, "é|é< 日本\n日本"), (6, "é|é< 日本\n日本")]


@pytest.fixture(scope="module")
def docs(spark):
    base = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    return base.withColumn("doc_id", F.col("doc_id") + 100).unionByName(spark.createDataFrame(ODD, "doc_id long, text string")).coalesce(2).cache()


def empty(spark, extra=""):
    return spark.createDataFrame([], f"doc_id long, text string, lang string, source string, n_chars long{extra}")


def test_empty_tables_and_clashing_columns(spark):
    for f in (quality_cascade.judge, lambda d: token_counts.count_tokens(d, model_path()), lambda d: piece_codec.encode_documents(d, model_path()), source_mixing.mix, hmm_lm.score_documents, jaccard_join.link_components, pii_bootstrap.find_personal_data, pii_bootstrap.redact, license_scan.scan):
        assert f(empty(spark)).count() == 0
    one = spark.createDataFrame([(1, "a b", "en", "s", 3, True, 7, "z")], "doc_id long, text string, lang string, source string, n_chars long, kept boolean, n_tokens long, replica string")
    assert "kept_" in quality_cascade.judge(one).columns
    assert token_counts.count_tokens(one, model_path()).first()["n_tokens"] == 7
    assert source_mixing.mix(one).columns[-1] == "replica_"


def test_quality_measures_and_verdict(spark, docs):
    def brute(x):
        x = x or ""
        w = re.findall(WORD, x)
        seen, dup = set(), 0
        for line in x.split("\n"):
            if re.search(WORD, line):
                dup += line in seen
                seen.add(line)
        n = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
        covered = {i + j for i in range(len(w) - 2) if n[tuple(w[i : i + 3])] > 1 for j in range(3)}
        return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in x), dup, len(covered)

    out = quality_cascade.judge(docs, measures=True).collect()
    for r in out:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == brute(r.text)
    assert [(r.doc_id, r.failed_rule) for r in out] == [(r.doc_id, r.failed_rule) for r in quality_cascade.judge(docs).collect()]
    other = quality_cascade.judge(docs, order=[r.name for r in reversed(quality_cascade.RULES)]).collect()
    assert Counter((r.doc_id, r.kept) for r in out) == Counter((r.doc_id, r.kept) for r in other)  # the order changes no verdict


def test_tokens_equal_the_library(spark, docs):
    lib = piece_codec.codec(model_path()).lib
    more = spark.createDataFrame([(9001, "a▁ b▁c "), (9002, "▁"), (9003, "longwordwithoutspaces" * 60), (9004, "  two  spaces  " * 40)], "doc_id long, text string")
    rows = docs.unionByName(more)
    wanted = Counter((r.doc_id, len((r.text or "").encode()), len(lib.encode(r.text or ""))) for r in rows.collect())
    for chunk, overlap in ((32768, 512), (100, 8), (37, 3)):
        got = token_counts.count_tokens(rows, model_path(), chunk, overlap).collect()
        assert Counter((r.doc_id, r.n_bytes, r.n_tokens) for r in got) == wanted
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    other = Tokenizer.from_file(path)
    other.encode_special_tokens = True
    got = token_counts.count_tokens(rows, path, 100, 8).collect()
    assert Counter((r.doc_id, r.n_tokens) for r in got) == Counter((r.doc_id, len(other.encode(r.text or "", add_special_tokens=False).ids)) for r in rows.collect())
    enc = piece_codec.encode_documents(rows, model_path(), with_ids=True, with_spans=True).collect()
    for r in enc:
        ids = lib.encode(r.text or "", add_bos=True, add_eos=True)
        assert r.ids == ids and r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(lib.decode(ids).encode()).hexdigest()
        data = (r.text or "").encode()
        assert b"".join(data[s.start : s.end] for s in r.spans) == data
        assert r.spans_sha256 == hashlib.sha256(np.array([x for s in r.spans for x in (s.start, s.end)], "<u8").tobytes()).hexdigest()
    assert {r.back for r in piece_codec.decode_ids(spark.createDataFrame([([1, 264, 2],)], "ids array<int>"), model_path(), to="back").collect()} == {lib.decode([1, 264, 2])}


def test_chunks_overlap_at_every_cut():
    text = "word " * 40 + "x" * 500 + " tail" * 30
    chunks = token_counts.cut_chunks(text, 50, 4)
    assert len(chunks) > 5 and chunks[-1][3] is None
    for (a, b, _, right), (c, _, left, _) in zip(chunks, chunks[1:]):
        assert a + right == c + left and c < a + right < b and text[a + right] == " " != text[a + right - 1]
    assert token_counts.cut_chunks("y" * 999, 50, 4) == [(0, 999, 0, None)]


def test_character_map_projects_to_source_bytes():
    # a hand-made double array with one entry: "ﬁ" (EF AC 81) -> "fi"
    key, units = "ﬁ".encode(), np.zeros(1024, np.uint32)
    node = 0
    units[0] = 512 << 10  # the root's children start at 512
    base = 512
    for i, b in enumerate(key):
        node = base ^ b
        child = 256 * (i + 1) if i < 2 else 768 + 255
        leaf = i == len(key) - 1
        offset = node ^ (child & ~0xFF if not leaf else child)
        units[node] = (offset << 10) | (0x100 if leaf else 0) | b
        base = node ^ offset
    units[base] = 0x80000000
    blob = (len(units) * 4).to_bytes(4, "little") + units.tobytes() + b"fi\0"
    m = piece_codec.CharacterMap(blob)
    assert m.longest(key + b"x", 0) == (3, b"fi") and m.longest(b"abc", 0) is None
    from sentencepiece import sentencepiece_model_pb2 as pb

    n = piece_codec.Normaliser(pb.NormalizerSpec(precompiled_charsmap=blob, add_dummy_prefix=True, remove_extra_whitespaces=True))
    out, source = n("a  ﬁb ")
    assert out == b" a fib" and source.tolist() == [0, 0, 1, 3, 3, 6, 7]


def test_a_model_with_a_character_map(spark, docs, tmp_path):
    import sentencepiece
    from sentencepiece import sentencepiece_model_pb2 as pb

    model, rules = pb.ModelProto(), pb.ModelProto()
    with open(model_path(), "rb") as f:
        model.ParseFromString(f.read())
    rules.ParseFromString(sentencepiece.SentencePieceNormalizer(rule_name="nmt_nfkc").serialized_model_proto())
    model.normalizer_spec.precompiled_charsmap = rules.normalizer_spec.precompiled_charsmap
    rng = np.random.default_rng(3)
    letters = list("ab é\u0301ﬁＨ①\t\n \u3000\u200b▁日本ーｶﾞ½ ﷺ x\u00ad")
    odd = ["".join(rng.choice(letters, rng.integers(0, 30))) for _ in range(300)] + ["ﬁ  Ｈello ①  x "]
    rows = docs.limit(40).unionByName(spark.createDataFrame([(8000 + i, t) for i, t in enumerate(odd)], "doc_id long, text string"))
    for squeeze, prefix in ((True, True), (False, True), (True, False)):
        model.normalizer_spec.remove_extra_whitespaces, model.normalizer_spec.add_dummy_prefix = squeeze, prefix
        path = tmp_path / f"{squeeze}{prefix}.model"
        path.write_bytes(model.SerializeToString())
        lib = sentencepiece.SentencePieceProcessor(model_file=str(path))
        for r in piece_codec.encode_documents(rows, str(path), with_ids=True, with_spans=True).collect():
            ids, data = lib.encode(r.text or "", add_bos=True, add_eos=True), (r.text or "").encode()
            assert r.ids == ids and r.decoded_sha256 == hashlib.sha256(lib.decode(ids).encode()).hexdigest(), r.text
            edges = [x for s in r.spans for x in (s.start, s.end)]
            assert edges == sorted(edges) and len(r.spans) == len(ids) - 2 and all(0 <= x <= len(data) for x in edges)
            # spans lie on characters' borders, and what each one covers normalises to its piece
            assert all(x == len(data) or data[x] & 0xC0 != 0x80 for x in edges)
    spans = piece_codec.Codec(str(path))
    starts, ends = spans.spans("ﬁ Ｈi", np.array(lib.encode("ﬁ Ｈi")))
    assert starts[0] == 0 and ends[-1] == len("ﬁ Ｈi".encode())


def test_nearest_neighbours(spark):
    v = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").select("vec_id", "embedding")
    odd = spark.createDataFrame([(10000, None), (10020, [0.0] * 64), (10040, [float("nan")] * 64), (10060, [None] * 64)], "vec_id long, embedding array<float>")
    got = ann_mih.search(v.unionByName(odd), F.expr("vec_id % 20 = 0")).toPandas()
    p = v.toPandas()
    x, ids = np.stack(p.embedding).astype(float), p.vec_id.values
    hits = 0
    for q, g in got.groupby("query_id"):
        s = x @ x[ids == q][0]
        s[ids == q] = -9
        order = np.lexsort((ids, -s))[:20]
        hits += len(set(ids[order]) & set(g.vec_id))
        assert len(g) == 20 and np.allclose(g.sort_values("rank").score, [s[ids == i][0] for i in g.sort_values("rank").vec_id])
    assert got.query_id.nunique() == (ids % 20 == 0).sum() and hits >= 0.9 * len(got)
    few = ann_mih.search(v.filter("vec_id < 5"), F.expr("vec_id = 0")).collect()
    assert [r["rank"] for r in few] == [1, 2, 3, 4]
    assert ann_mih.search(v.limit(0), F.lit(True)).count() == 0


def test_nearest_neighbours_are_ranked_row_by_row(spark):
    # two rows with one id are two queries and two candidates; ties go to the smaller id
    rows = [(0, [1.0, 0.0]), (0, [0.0, 1.0]), (7, [1.0, 0.0]), (3, [1.0, 0.0]), (5, [-1.0, 0.0]), (9, [1.0, 2.0, 3.0])]
    out = ann_mih.search(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), F.expr("vec_id = 0"), k=3).collect()
    assert sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in out) == [(0, 1, 0, 0.0), (0, 1, 3, 1.0), (0, 2, 3, 0.0), (0, 2, 7, 1.0), (0, 3, 0, 0.0), (0, 3, 5, 0.0)]


def test_equal_vectors_have_equal_scores_wherever_they_lie(spark, monkeypatch):
    rng = np.random.default_rng(8)
    kinds = rng.normal(size=(40, 33)).astype(np.float32)
    own = rng.integers(0, 40, 900)
    rows = [(int(i), [float(x) for x in kinds[j]]) for i, j in zip(rng.permutation(900), own)]
    monkeypatch.setattr(ann_mih, "BLOCK_ROWS", 100)
    got = ann_mih.search(spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(6), F.expr("vec_id % 20 = 0")).toPandas()
    vector = {i: np.array(v, np.float32).astype(float) for i, v in rows}
    for q, g in got.groupby("query_id"):
        listed = [(-(vector[i] * vector[q]).sum(), i) for i in vector if i != q]
        assert g.sort_values("rank").vec_id.tolist() == [i for _, i in sorted(listed)[:20]]
        assert len({(r.vec_id, r.score) for r in g.itertuples()}) == 20


def test_cascade_sample_of_a_very_large_table(spark):
    """The share of a table of two billion rows still holds rows of this one, as far as their hashes go."""
    docs = spark.range(200_000).select(F.col("id").alias("doc_id"), F.lit("some words here").alias("text"))
    share = 0.8 * 2000 / 2e9
    assert int(share * 2**64) - 2**63 > -(2**63)
    seen = docs.filter(F.xxhash64("doc_id", "text") < int(0.01 * 2**64) - 2**63).count()
    assert 1700 < seen < 2300
    order = quality_cascade.estimate_order(docs, sample_rows=500)
    assert sorted(order) == sorted(r.name for r in quality_cascade.RULES) and order[0] == "few_words"


def test_multi_index_finds_every_code_within_the_radius():
    codes = np.random.default_rng(0).integers(0, 2**63, (500, 2), dtype=np.uint64)
    codes[:50, 0] = codes[0, 0] ^ (np.uint64(1) << np.arange(50, dtype=np.uint64))
    codes[:50, 1] = codes[0, 1]
    index = ann_mih.MultiIndex(codes)
    for r in (0, 2, 17, 40, 60, 128):
        assert set(index.within(codes[7], r)) == set(np.flatnonzero(np.bitwise_count(codes ^ codes[7]).sum(1) <= r))


def test_url_rules_and_reputation(spark):
    urls = [(1, "http://A.example.NET/en/x?q"), (2, "http://a.net/x"), (3, "nothing"), (4, None), (5, "https://b.example.com/de/"), (6, "http://x.org/fr/1"), (7, "http://example.net"), (8, "http://bad.io/1"), (9, "http://good.io/#/")]
    urls += [(100 + i, "http://bad.io/p") for i in range(40)] + [(200 + i, "http://good.io/p") for i in range(40)]
    pages = spark.createDataFrame(urls, "page_id long, url string")
    outcomes = spark.createDataFrame([(100 + i, True) for i in range(40)] + [(200 + i, False) for i in range(40)] + [(8, None)], "page_id long, bad boolean")
    r = {x.page_id: x for x in url_reputation.judge_urls(pages, outcomes).collect()}
    assert (r[1].host, r[1].path, r[1].rule, r[1].verdict) == ("a.example.net", "/en/x", "example.net/en/", "allow")
    assert (r[2].rule, r[2].verdict) == ("net/", "block") and (r[3].host, r[3].path, r[3].rule) == ("", "", None) and r[4].host == ""
    assert r[5].verdict == "block" and r[6].rule == "org/fr/" and r[7].rule is None
    long = [(1, "x" * 100_000), (2, "y" * 100_000 + "://H.org/" + "p" * 100_000)]
    split = {x.page_id: x for x in url_reputation.judge_urls(spark.createDataFrame(long, "page_id long, url string"), outcomes).collect()}
    assert split[1].host == "" and (split[2].host, split[2].path) == ("h.org", "/" + "p" * 100_000)
    assert r[8].verdict == "block" and r[9].verdict == "allow" and r[9].path == "/"


def test_domains_and_odd_pages(spark):
    hosts = {"a.b.co.uk": ("b.co.uk", "co.uk"), "u:p@x.example.com:8080": ("example.com", "com"), "www.example.org.": ("example.org", "org"), "10.0.0.1:80": ("10.0.0.1", "10.0.0.1"), "[::1]:80": ("[::1]", "[::1]"), "com": ("com", "com"), "": ("", ""), "co.uk": ("co.uk", "co.uk")}
    d = spark.createDataFrame([(h,) for h in hosts], "h string").select("h", url_reputation.domain_of(F.col("h")).alias("d"), url_reputation.suffix_of(F.col("h")).alias("s"))
    assert {r.h: (r.d, r.s) for r in d.collect()} == hosts
    own = spark.createDataFrame([("a.b.c.d.e",)], "h string").select(url_reputation.domain_of(F.col("h"), ["c.d.e"]).alias("d")).first()
    assert own.d == "b.c.d.e"
    outcomes = spark.createDataFrame([(1, True)], "page_id long, bad boolean")
    assert url_reputation.judge_urls(spark.createDataFrame([], "page_id long, url string"), outcomes).count() == 0
    assert url_reputation.judge_urls(spark.createDataFrame([(1, "http://a.io/")], "page_id long, url string"), outcomes.limit(0)).first().verdict == "allow"
    odd = spark.createDataFrame([(1, "http://a.io/x", "h", "v"), (1, "http://a.io/x", "h", "v"), (None, None, None, None)], "page_id long, url string, host string, verdict string")
    out = url_reputation.judge_urls(odd, outcomes)
    assert out.columns == ["page_id", "host", "verdict", "host_", "path", "rule", "verdict_", "bad_rate", "bad_rate_low"]
    assert sorted(str(r.host_) for r in out.collect()) == ["", "a.io", "a.io"]


def test_mixing_reaches_its_targets(spark):
    rows = [(i, "a" if i % 10 else "b") for i in range(20000)] + [(None, None)]
    d = spark.createDataFrame(rows, "doc_id long, source string")
    got = Counter(r.source for r in source_mixing.mix(d, {"a": 0.25, "b": 0.75}).select("source").collect())
    assert abs(got["a"] / 20001 - 0.25) < 0.02 and abs(got["b"] / 20001 - 0.75) < 0.03  # a rate of 7.5 for b
    bare = spark.createDataFrame([(None, "a" if i % 10 else "b", i) for i in range(20000)], "doc_id long, source string, place long")
    got = Counter(r.source for r in source_mixing.mix(bare, {"a": 0.25, "b": 0.75}).select("source").collect())
    assert abs(got["a"] / 20000 - 0.25) < 0.02 and abs(got["b"] / 20000 - 0.75) < 0.03
    same = source_mixing.mix(spark.createDataFrame([(1, "a")] * 5 + [(2, "b")] * 5, "doc_id long, source string")).groupBy("doc_id").count().collect()
    assert all(r["count"] % 5 == 0 for r in same)
    few = spark.createDataFrame([(i, "r" if i < 2 else "s") for i in range(3000)], "doc_id long, source string")
    assert abs(Counter(r.source for r in source_mixing.mix(few, {"r": 0.5, "s": 0.5}).collect())["r"] - 1500) < 200  # means over one part


def test_jaccard_components(spark, docs):
    variants = [(5000 + i, " ".join(f"w{j}" if (i, j) not in {(1, 3), (2, 90), (3, 91)} else "changed" for j in range(120))) for i in range(6)]
    short = [(6000 + n, " ".join(f"s{j}" for j in range(n))) for n in range(1, 16)]
    all_ = docs.unionByName(spark.createDataFrame(variants + short, "doc_id long, text string")).filter("doc_id is not null").dropDuplicates(["doc_id"])

    def shingles(x):
        w = re.findall(WORD, re.sub("[A-Z]+", lambda m: m.group().lower(), x or ""))
        return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])

    sets = {r.doc_id: shingles(r.text) for r in all_.collect()}
    root = {k: k for k in sets}

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    keys = sorted(sets)
    for i, a in enumerate(keys):
        for b in keys[:i]:
            n = len(sets[a] & sets[b])
            if n and 100 * n >= 80 * (len(sets[a]) + len(sets[b]) - n):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    wanted = {k: (len(sets[k]), find(k)) for k in sets}
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.link_components(all_).collect()} == wanted
    left = {r.doc_id for r in jaccard_join.one_of_each_group(all_).collect()}
    assert left == {k for k in sets if find(k) == k}
    assert jaccard_join.link_components(docs).count() == docs.count()


def test_jaccard_links_of_small_sets_are_true(spark, monkeypatch):
    monkeypatch.setattr(jaccard_join, "boundary", lambda sizes, at: 16)
    text = lambda p, n, changed=0: " ".join(f"{p}{j}" if j < n - changed else f"{p}x{j}" for j in range(n))
    # n + 4 words have n shingles; a changed last word leaves n - 1 of n + 1 in common, a longer text n of n + 1
    texts = [(100 * n + i, t) for n in range(1, 17) for i, t in enumerate([text(f"a{n}q", n + 4), text(f"a{n}q", n + 4, 1), text(f"b{n}q", n + 4), text(f"b{n}q", n + 5), text(f"c{n}q", n + 4), text(f"c{n}q", n + 4, 2), text(f"c{n}q", n + 3)])]
    sets = {i: frozenset(tuple(t.split()[j : j + 5]) for j in range(max(len(t.split()) - 4, 1))) for i, t in texts}
    component = {i: i for i in sets}
    for _ in sets:
        for n in range(1, 17):
            group = [100 * n + i for i in range(7)]
            for x in group:
                component[x] = min(component[y] for y in group if 100 * len(sets[x] & sets[y]) >= 80 * len(sets[x] | sets[y]))
    out = {r.doc_id: r.component_id for r in jaccard_join.link_components(spark.createDataFrame(texts, "doc_id long, text string")).collect()}
    assert out == component and out[501] == 501


def test_one_row_of_each_group_stays(spark):
    words = lambda p, n=60: " ".join(f"{p}{j}" for j in range(n))
    a, b, c, near = words("a"), words("b"), words("c"), words("c", 59)
    texts = [(3, a), (7, a), (7, b), (5, words("e")), (5, words("e")), (None, words("f")), (None, words("f")), (None, c), (None, near), (9, near + " end"), (None, ""), (None, ""), (None, words("g"))]
    d = spark.createDataFrame(texts, "doc_id long, text string").repartition(3)
    left = Counter((r.doc_id, r.text) for r in jaccard_join.one_of_each_group(d).collect())
    assert left == Counter([(3, a), (7, b), (5, words("e")), (None, words("f")), (9, near + " end"), (None, ""), (None, ""), (None, words("g"))])
    # a set that only rows with a null doc_id hold links the sets around it
    chain = [(1, words("h", 100)), (None, words("h", 84)), (2, words("h", 70))]
    out = jaccard_join.link_components(spark.createDataFrame(chain, "doc_id long, text string")).collect()
    assert [r.component_id for r in out] == [1, 1, 1]


@pytest.mark.parametrize("block,heavy", [(4, 4096), (1024, 0)])
def test_jaccard_blocks_and_heavy_lists(spark, monkeypatch, block, heavy):
    monkeypatch.setattr(jaccard_join, "BLOCK", block)
    monkeypatch.setattr(jaccard_join, "HEAVY", heavy)
    texts = [(i, " ".join(f"w{j}" if j != i + 30 else f"x{i}" for j in range(100))) for i in range(30)] + [(100, "other words " * 30)]
    out = {r.doc_id: r.component_id for r in jaccard_join.link_components(spark.createDataFrame(texts, "doc_id long, text string")).collect()}
    assert all(out[i] == 0 for i in range(30)) and out[100] == 100


@pytest.mark.parametrize("block,heavy", [(4, 0), (4, 4096), (1024, 4096)])
def test_jaccard_members_that_their_centre_leaves_open(spark, monkeypatch, block, heavy):
    monkeypatch.setattr(jaccard_join, "BLOCK", block)
    monkeypatch.setattr(jaccard_join, "HEAVY", heavy)
    # windows that drift: near ones link, far ones only meet
    texts = [(100 * g + i, " ".join(f"g{g}w{j}" for j in range((3 + g) * i, (3 + g) * i + 60 + (i * 7) % 23))) for g in range(4) for i in range(40)]
    sets = {i: {tuple(t.split()[j : j + 5]) for j in range(len(t.split()) - 4)} for i, t in texts}
    component = {i: i for i in sets}
    links = [(x, y) for x in sets for y in sets if x < y and 100 * len(sets[x] & sets[y]) >= 80 * len(sets[x] | sets[y])]
    for _ in sets:
        for x, y in links:
            component[x] = component[y] = min(component[x], component[y])
    out = {r.doc_id: r.component_id for r in jaccard_join.link_components(spark.createDataFrame(texts, "doc_id long, text string")).collect()}
    assert out == component and 4 < len(set(out.values())) < len(out)


def test_jaccard_moves_no_text_that_parities_rule_out(spark, monkeypatch):
    # pairs that meet by rare shared words, but differ in most others, and pairs that link
    words = lambda p, n: [f"{p}w{j}" for j in range(n)]
    texts = [(10 * g + i, " ".join(words(f"g{g}", 20) + words(f"g{g}i{i}", 60 + 30 * g))) for g in range(20) for i in range(2)]
    texts += [(1000 + 10 * g + i, " ".join(words(f"c{g}", 90 + i))) for g in range(3) for i in range(2)]
    moved = []
    for name in ("_starred", "_verified"):
        step = getattr(jaccard_join, name)
        monkeypatch.setattr(jaccard_join, name, lambda rows, *rest, step=step: moved.append({r.member for r in rows.select("member").collect()}) or step(rows, *rest))
    out = {r.doc_id: r.component_id for r in jaccard_join.link_components(spark.createDataFrame(texts, "doc_id long, text string")).collect()}
    assert out == {i: i // 10 * 10 if i >= 1000 else i for i, _ in texts}
    assert [len(m) for m in moved] == [6, 0]


@pytest.mark.parametrize("num", [40, 80, 95])
def test_parities_never_rule_out_a_link(num):
    at, rng = jaccard_join.Threshold(num, 100), np.random.default_rng(num)
    sets = []
    for n in (1, 3, 30, 63, 64, 65, 120, 130, 500):
        base = rng.integers(0, 2**64, n, dtype=np.uint64)
        for share in (0, 0.02, 0.1, 0.3, 0.6):
            sets.append(np.unique(np.concatenate([base[int(share * n) :], rng.integers(0, 2**64, int(rng.integers(0, 2) * share * n), dtype=np.uint64)])))
    sizes, parities = np.array([len(s) for s in sets]), [jaccard_join._parities(s) for s in sets]
    links = np.array([[at.links(len(np.intersect1d(a, b)), len(a), len(b)) for b in sets] for a in sets])
    ruled_out = 0
    for i in range(len(sets)):
        for j in range(i):
            may = jaccard_join._with_partner(np.array([0, 1]), sizes[[i, j]], [parities[i], parities[j]], at)
            assert may.all() if links[i, j] else may.all() == may.any()
            ruled_out += not may.any()
    assert ruled_out > 100 and links.sum() > 2 * len(sets)


def test_language_model(spark, docs):
    import zlib

    out = {r.doc_id: r for r in hmm_lm.score_documents(docs).collect()}
    tokens = {r.doc_id: [*re.findall(WORD, re.sub("[A-Z]+", lambda m: m.group().lower(), r.text or "")), None] for r in docs.collect() if r.doc_id != 6}
    held = lambda k: zlib.crc32(b"" if k is None else str(k).encode()) % 5 == 1
    counts = Counter(t for r in docs.collect() if not held(r.doc_id) for t in [*re.findall(WORD, re.sub("[A-Z]+", lambda m: m.group().lower(), r.text or "")), None])
    n, v = sum(counts.values()), len(counts)
    for k, ts in tokens.items():
        base = sum(np.log10((counts[t] + 0.5) / (n + 0.5 * (v + 1))) for t in ts)
        assert abs(out[k].base_score - base) < 1e-6 * abs(base) + 1e-9
        assert (out[k].n_tokens, out[k].n_known, out[k].train_tokens, out[k].held_out) == (len(ts), sum(counts[t] > 0 for t in ts), n, held(k))


def test_states_help_on_held_out_texts(spark):
    for sf, gain in (("0.001", 0.03), ("0.01", 0.05)):
        docs = spark.read.parquet(f"/root/testdata/sf{sf}/documents.parquet")
        score, base = hmm_lm.score_documents(docs).filter("held_out").agg(F.sum("score"), F.sum("base_score")).first()
        assert score > base * (1 - gain)


def _brute(m, s):
    """Log-likelihood and expected starts, steps and emissions of one sequence, with every state path's weight from unscaled recursions in high precision."""
    from fractions import Fraction as Q

    k = len(m.start)
    start, step, emit = [Q(x) for x in m.start], [[Q(x) for x in r] for r in m.step], [[Q(x) for x in r] for r in m.emit]
    alpha = [[start[i] * emit[s[0]][i] for i in range(k)]]
    for x in s[1:]:
        alpha.append([sum(alpha[-1][i] * step[i][j] for i in range(k)) * emit[x][j] for j in range(k)])
    beta = [[Q(1)] * k]
    for x in reversed(s[1:]):
        beta.append([sum(step[i][j] * emit[x][j] * beta[-1][j] for j in range(k)) for i in range(k)])
    beta.reverse()
    total = sum(alpha[-1])
    gamma = np.array([[float(a * b / total) for a, b in zip(x, y)] for x, y in zip(alpha, beta)])
    steps = np.array([[float(sum(alpha[t][i] * step[i][j] * emit[s[t + 1]][j] * beta[t + 1][j] for t in range(len(s) - 1)) / total) for j in range(k)] for i in range(k)])
    emits = np.zeros(m.emit.shape)
    np.add.at(emits, s, gamma)
    return np.log(float(total * 2 ** (8 * len(s)))) - 8 * len(s) * np.log(2), gamma[0], steps, emits


@pytest.mark.parametrize("singular", [False, True])
def test_recursions_are_exact_for_every_piece_length(singular):
    rng = np.random.default_rng(1)
    step = rng.dirichlet(np.ones(3), 3)
    if singular:
        step[1] = step[0]
    m = hmm_lm.Model(rng.dirichlet(np.ones(3)), step, rng.dirichlet(np.ones(9), 3).T)
    seqs = [rng.integers(0, 9, n) for n in (1, 2, 7, 8, 9, 40, 41, 3, 120)]
    wanted = [_brute(m, s.tolist()) for s in seqs]
    flat, first = np.concatenate(seqs), np.cumsum([0, *map(len, seqs)])
    for piece in (1, 2, 7, 40, 1024):
        assert np.allclose(hmm_lm.log_likelihoods(m, flat, first, piece), [w[0] for w in wanted])
        got = hmm_lm.expected_counts(m, flat, first, piece)
        for j in range(3):
            assert np.allclose(got[j], sum(w[j + 1] for w in wanted))


def _plain_model(texts, k, rounds):
    """The whole model on a few training token lists, word by word; gives a scorer of token lists."""
    c = Counter(t for ts in texts for t in ts)
    own = sorted(w for w in c if c[w] >= 2)
    place = {w: i for i, w in enumerate(own)}
    corpus = hmm_lm.Corpus(sum(c.values()), len(c), sum(n == 1 for n in c.values()))
    shared = hmm_lm.Shared.initial(corpus, k)
    seeds = np.array([w & 0xFFFFFFFF for w in own], np.uint32)
    counts = hmm_lm.first_counts(np.array([c[w] for w in own], float), seeds, k)
    for _ in range(rounds):
        m = shared.model(counts)
        sums = [_brute(m, [place.get(t, len(own)) for t in ts])[1:] for ts in texts]
        start, step, emit = (sum(s[j] for s in sums) for j in range(3))
        shared, counts = shared.updated(start, step, emit[-1], emit.sum(0)), emit[:-1]
    m = shared.model(counts)
    rare = lambda t: np.log10((c[t] + 0.5) / corpus.rare_mass) if t not in place else 0.0
    return lambda ts: _brute(m, [place.get(t, len(own)) for t in ts])[0] / np.log(10) + sum(map(rare, ts))


def test_training_over_blocks_and_shards_equals_a_plain_one(spark, monkeypatch):
    monkeypatch.setattr(hmm_lm, "BLOCK_BYTES", 60)
    monkeypatch.setattr(hmm_lm, "SHARD_WORDS", 9)
    monkeypatch.setattr(hmm_lm, "PIECE", 5)
    import pyarrow as pa

    words = ["aa b aa cc dd", "b x y z b b aa", "", "dd dd q", "cc aa b new words here", "aa " * 20 + "b", "b cc dd aa q unseen x", "one aa two b"]
    rows = [(i, t) for i, t in enumerate(words * 2)]
    d = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    held = {r.doc_id: r.held_out for r in hmm_lm.score_documents(d).collect()}
    assert 0 < sum(held.values()) < len(held)
    tokens = {i: hmm_lm._token_hashes(pa.array([t]))[0].tolist() for i, t in rows}
    score = _plain_model([tokens[i] for i, _ in rows if not held[i]], 3, 2)
    got = {r.doc_id: r.score for r in hmm_lm.score_documents(d, 3, 2).collect()}
    assert all(abs(got[i] - score(tokens[i])) < 1e-4 * abs(score(tokens[i])) for i, _ in rows)
    # held-out texts teach nothing: with others in their place no training text's score moves
    other = spark.createDataFrame([(i, "aa b totally other words aa aa" if held[i] else t) for i, t in rows], "doc_id long, text string")
    again = {r.doc_id: r.score for r in hmm_lm.score_documents(other, 3, 2).collect()}
    assert all(abs(got[i] - again[i]) < 1e-5 * abs(got[i]) for i, _ in rows if not held[i])


def test_one_state_is_the_base_and_long_texts_are_whole(spark):
    long = " ".join(f"w{(i * i) % 97}" for i in range(30_000))
    rows = [(i, f"some words {i} and w{i % 97} more w{i % 7}") for i in range(60)] + [(100, long), (101, long), (102, None), (102, "")]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    for r in hmm_lm.score_documents(d, 1, 1).collect():
        assert abs(r.score - r.base_score) < 1e-5 * abs(r.base_score)
    out = [(r.doc_id, r.n_tokens, r.score) for r in hmm_lm.score_documents(d).collect() if r.doc_id in (100, 101, 102)]
    assert sorted(n for _, n, _ in out) == [1, 1, 30_001, 30_001] and len({s for i, _, s in out if i != 102}) == 1


def test_licences(spark):
    mit = TEXTS["mit"].split()
    edited = " ".join(w for i, w in enumerate(mit) if i % 37 != 5)
    pushed = " ".join(mit[:80] + [f"inserted{i}" for i in range(12)] + mit[80:])
    texts = [(1, "Some é words. Licensed under the Apache License, Version 2.0. More words."), (2, "before " + edited + " after"), (3, "plain text about the license of things"), (4, None), (5, "Released under the MIT License.\nReleased under the MIT License.")]
    texts += [(6, pushed), (7, "This work is licensed under the GNU General Public License, version 2."), (8, "This work is licensed under the GNU Lesser General Public License, version 3"), (9, ""), (10, "x y " * 30_000 + TEXTS["mit"] + " z" * 30_000), (11, "This work is licensed under the GNU General Public License, version 9.")]
    got = license_scan.scan(spark.createDataFrame(texts + texts[:1], "doc_id long, text string")).collect()
    found = {(r.doc_id, r.license) for r in got}
    assert found == {(1, "apache-2.0-line"), (2, "mit"), (5, "mit-line"), (6, "mit"), (7, "gpl-2.0-line"), (8, "lgpl-3.0-line"), (10, "mit")}
    a = next(r for r in got if r.doc_id == 1)
    assert texts[0][1][a.span_start : a.span_end] == "Licensed under the Apache License, Version 2.0" and a.coverage == 1
    assert next(r for r in got if r.doc_id == 2).coverage > 0.9 and sum(r.doc_id == 5 for r in got) == 2 and sum(r.doc_id == 1 for r in got) == 2
    whole = next(r for r in got if r.doc_id == 6)
    assert whole.coverage == 1 and pushed[whole.span_start : whole.span_end] == pushed.rstrip(".")
    own = spark.createDataFrame([("house", "only for use in this house by its owner"), ("house", None)], "name string, text string")
    mine = license_scan.scan(spark.createDataFrame([(1, "It is ONLY for use in this house, by its owner!")], "doc_id long, text string"), own).collect()
    assert [(r.license, r.span_start, r.span_end) for r in mine] == [("house", 6, 46)]


def test_alignment_equals_the_full_matrix():
    def lcs(x, y):
        best = np.zeros((len(x) + 1, len(y) + 1), int)
        for i in range(len(x)):
            for j in range(len(y)):
                best[i + 1, j + 1] = best[i, j] + 1 if x[i] == y[j] else max(best[i, j + 1], best[i + 1, j])
        return best[-1, -1]

    rng = np.random.default_rng(2)
    index = license_scan.TemplateIndex([(k, t) for k, t in TEXTS.items()])
    for t, template in enumerate(index.words):
        for edits in (0, 3, 8):
            text = template.tolist()
            for _ in range(edits * len(template) // 100):
                at = int(rng.integers(0, len(text)))
                kind = rng.integers(0, 3)
                text[at : at + (kind != 1)] = [int(x) for x in rng.integers(0, 99, (0, 5, 1)[kind])]
            own = np.array([7, 8] * 20 + text + [9] * 40, np.uint64)
            h = license_scan.windows(own, license_scan.K)
            places = np.flatnonzero(np.isin(h, index.prints))
            found = [f for f in license_scan.scan_text(index, own, h[places], places, 0.6) if f[0] == t]
            assert len(found) == 1 and 0 <= lcs(template, own) - found[0][1] <= 1, (index.names[t], edits)
    for _ in range(50):  # a band over everything is the full matrix
        x, y = rng.integers(0, 4, rng.integers(0, 12)), rng.integers(0, 4, rng.integers(0, 12))
        a, b = license_scan.banded_alignment(x, y, -30, 30)
        assert len(a) == lcs(x, y) and (x[a] == y[b]).all() and (np.diff(a) > 0).all() and (np.diff(b) > 0).all()


def test_personal_data(spark, docs):
    extra = ["a@b.c_d@e.f x", "1.2.3.4.5 256.1.1.1 001.002.003.0004", "+1 (555) 555-0100.", "é 4111 1111 1111 1111 é 4111-1111-1111-1112", "+12345678+12345678", "a" * 5000, "a@" + ".b" * 9000, "1.2.3.4 " * 600]
    rows = docs.unionByName(spark.createDataFrame([(7000 + i, t) for i, t in enumerate(extra)], "doc_id long, text string"))
    patterns = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}

    def luhn(d):
        return sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(d))) % 10 == 0

    def brute(t):
        out = []
        for k, p in patterns.items():
            for m in re.finditer(p, t or ""):
                d = re.sub("[^0-9]", "", m.group())
                if not (k == "ip" and any(int(x) > 255 for x in m.group().split(".")) or k == "card" and not (16 <= len(d) <= 19 and luhn(d)) or k == "phone" and not 8 <= len(d) <= 15):
                    out.append(f"{k}:{m.start()}:{m.end()}")
        return ",".join(out)

    wanted = Counter((r.doc_id, hashlib.sha256(brute(r.text).encode()).hexdigest()) for r in rows.collect())
    assert Counter((r.doc_id, r.base_sha256) for r in pii_bootstrap.find_personal_data(rows).collect()) == wanted


def test_bootstrap_discovers_and_redacts(spark):
    texts = [(i, f"please write to user{i}@mail{i}.org for help") for i in range(30)] + [(100, "please write to user_at_990077 for help"), (101, "we counted 1234567 birds in May")]
    d = spark.createDataFrame(texts, "doc_id long, text string")
    spans = {r.doc_id: r.spans for r in pii_bootstrap.find_personal_data(d).collect()}
    assert spans[100] == "email:16:30" and spans[101] == ""
    clean = {r.doc_id: r.text for r in pii_bootstrap.redact(d).collect()}
    assert clean[3] == "please write to <EMAIL> for help" == clean[100] and clean[101] == texts[-1][1]


def test_bootstrap_keeps_the_strongest_discoveries(spark):
    # five contexts with 200 seeds each: ten patterns at p near 0.99, so the noisy-or rounds to 1
    seeds = [(1000 * c + i, f"context{c} write{c} user{c}x{i}@mail.org for{c} help") for c in range(5) for i in range(200)]
    texts = seeds + [(9000 + c, f"context{c} write{c} Strong_at_990077 for{c} help") for c in range(5)]
    d = spark.createDataFrame(texts, "doc_id long, text string")
    spans = {r.doc_id: r.spans for r in pii_bootstrap.find_personal_data(d).collect()}
    assert [spans[9000 + c] for c in range(5)] == ["email:16:32"] * 5
    clean = {r.doc_id: r.text for r in pii_bootstrap.redact(d).collect()}
    assert clean[9003] == "context3 write3 <EMAIL> for3 help"


def test_bootstrap_finds_digit_groups(spark):
    texts = [(i, f"please call to +1 555 010 {1000 + i} for help") for i in range(30)]
    texts += [(100, "please call to 55 12 34-5 6. for help"), (101, "we sold 12 34 56 birds"), (102, "please call to 12 34 for help"), (103, "please call to 123 4567 8th for help")]
    d = spark.createDataFrame(texts, "doc_id long, text string")
    spans = {r.doc_id: r.spans for r in pii_bootstrap.find_personal_data(d).collect()}
    assert spans[100] == "phone:15:27" and spans[101] == spans[102] == ""
    found = {r.doc_id: [m.value for m in r.found or []] for r in pii_bootstrap.mentions(d.filter("doc_id > 99")).collect()}
    assert found == {100: ["55 12 34-5 6"], 101: ["12 34 56"], 102: [], 103: ["123 4567"]}


def _contexts(t, start, end, value):
    """The patterns of a mention, word by word."""
    zero = lambda x: re.sub("[1-9]", "0", x.lower())
    words = [(m.start(), m.end()) for m in re.finditer(WORD, t)]
    low = start - pii_bootstrap.WINDOW
    # what is glued to the mention is no context
    before = [zero(t[a:b]) for a, b in words if b < start and a >= (0 if low <= 0 else low + 1)]
    last = next((b for a, b in words if a < end <= b), end)
    after = [zero(t[a:b]) for a, b in words if a > last and b < end + pii_bootstrap.WINDOW + (b == len(t))]
    after = after if next((b for a, b in words if a > last), 0) < end + pii_bootstrap.WINDOW + 1 else []
    out = []
    if len(before) > 1:
        out.append(f"l2:{before[-2]} {before[-1]}")
    if before:
        out.append(f"l1:{before[-1]}")
    if after:
        out.append(f"r1:{after[0]}")
    if before and after:
        out.append(f"lr:{before[-1]} _ {after[0]}")
    if m := re.search(r"(?:^|[^a-z0-9_-])([a-z][a-z0-9_-]*)[\x20\t-\r\"']*[:=]+[\x20\t-\r\"']*$", zero(t[:start])):
        out.append(f"key:{m[1]}")
    v = value.lower()
    kind = next((k for k, p in (("digits", "[0-9]+"), ("hex", "[0-9a-f]+"), ("alnum", "[0-9a-z]+")) if re.fullmatch(p, v)), None)
    out.append("shape:" + (f"{kind}:{len(v)}" if kind else re.sub("[a-z]+", "a", re.sub("[0-9]+", "9", v))))
    return out


def test_bootstrap_equals_brute_force(spark):
    rng = np.random.default_rng(4)
    word = lambda: str(rng.choice(["the", "of", "mail", "id", "no9", "x" * 70, "call", "é", "sent"]))
    values = [("write to", "a%d@b%d.org"), ("id no9", "1.2.%d.%d"), ("reach me:", "+1 555 %d 90%d"), ("sent by", "token = \"abcdef%dghijklm%dnop\""), ("sent by", "Token=\"abcdef%dghijklm%dnop\"!"), ("write to", "user%d%d77777"), ("", "90%d88%d7")]

    def text():
        lead, value = values[rng.choice(7, p=[0.25, 0.1, 0.2, 0.3, 0.05, 0.05, 0.05])]
        return " ".join([word() for _ in range(rng.integers(0, 3))] + [lead, value % tuple(rng.integers(0, 200, 2))] + [word() for _ in range(rng.integers(0, 3))])

    texts = [text() for _ in range(400)]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    mentions = [(r.doc_id, m.kind, m.start, m.end, m.value, [p for p in m.patterns if p]) for r in pii_bootstrap.mentions(d).collect() for m in r.found or []]
    for i, _, start, end, v, patterns in mentions:
        assert texts[i][start:end] == v and sorted(patterns) == sorted(_contexts(texts[i], start, end, v)), (texts[i], v, patterns)
    # every word with five digits or an @ is a mention, and every base span and secret is a seed
    for i, t in enumerate(texts):
        spans = [(a, b) for j, _, a, b, _, _ in mentions if j == i]
        for m in re.finditer(WORD, t):
            if "@" in m.group() or len(re.sub("[^0-9]", "", m.group())) >= 5:
                assert any(a < m.end() and m.start() < b for a, b in spans), t
    edges = {(p, v.lower()) for *_, v, patterns in mentions for p in patterns}
    kinds = {}
    for _, k, _, _, v, _ in mentions:
        if k:
            kinds[v.lower()] = min(k, kinds.get(v.lower(), k))
    every = {v.lower() for *_, v, _ in mentions}
    prior = {k: n / len(every) for k, n in Counter(kinds.values()).items()}
    members = {}
    for p, v in edges:
        members.setdefault(p, set()).add(v)
    trusted = {v: (k, 1.0) for v, k in kinds.items()}
    for _ in range(pii_bootstrap.ROUNDS):
        strong = {}
        for p, vs in members.items():
            for k in prior:
                told = [trusted[v][1] for v in vs if v in trusted and trusted[v][0] == k]
                share = (sum(told) + pii_bootstrap.PRIOR * prior[k]) / (len(vs) + pii_bootstrap.PRIOR)
                if len(told) >= pii_bootstrap.SUPPORT and share >= pii_bootstrap.TRUST:
                    strong[p, k] = share
        found = {}
        for v in every - set(kinds):
            for k in prior:
                own = [(p, strong[p, k]) for p, vs in members.items() if v in vs and (p, k) in strong]
                if any(not p.startswith("shape:") for p, _ in own):
                    sure = 1 - np.prod([1 - x for _, x in own])
                    if sure >= pii_bootstrap.TRUST:
                        found[v] = max(found.get(v, (0, "")), (sure, k))
        trusted = {v: (k, 1.0) for v, k in kinds.items()} | {v: (k, c) for v, (c, k) in found.items()}
    wanted = {i: set() for i in range(len(texts))}
    for i, k, a, b, v, _ in mentions:
        if k or v.lower() in found:
            wanted[i].add(f"{k or trusted[v.lower()][0]}:{a}:{b}")
    got = {r.doc_id: set(r.spans.split(",")) - {""} for r in pii_bootstrap.find_personal_data(d).collect()}
    assert got == wanted and sum(len(x) for x in got.values()) > sum(k is not None for _, k, *_ in mentions)


def test_pipeline_stages_are_whole(spark):
    import corpus_pipeline as cp

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    kept = cp.quality(spark, docs, "")
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {r.doc_id for r in quality_cascade.judge(docs).filter("kept").collect()}
    out = cp.run(spark, "/root/testdata/sf0.001")
    assert out.count() > 0 and [n for n, _ in cp.STAGES][0] == "quality rules"


def test_pipeline_equals_brute_force(spark):
    import math

    import corpus_pipeline as cp

    rng = np.random.default_rng(8)
    vocabulary = [f"w{i}x" for i in range(400)]
    plain = [" ".join(rng.choice(vocabulary, 70)) for _ in range(30)]
    texts = plain + [plain[0], plain[1] + " end", plain[2].replace(" ", "  ", 3), "WORDS " * 60, "too short", None, "", plain[3] + " mail a.b@c.org and 10.0.0.1 and +1 (555) 010-2030", "# * $ " * 40]
    docs = spark.createDataFrame([(i if i != 20 else None, t, "en", f"s{i % 3}", len(t or "")) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    rows = [tuple(r) for r in docs.collect()]

    def good(t):
        w = re.findall(WORD, t or "")
        n, lines = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2)), [x for x in (t or "").split("\n") if re.search(WORD, x)]
        covered = {i + j for i in range(len(w) - 2) if n[tuple(w[i : i + 3])] > 1 for j in range(3)}
        letters, chars = re.findall("[A-Za-z]", t or ""), sum(map(len, w))
        return not (len(w) < 50 or 2 * len(covered) > len(w) or 4 * len(re.findall(r"[#*$%&|<>]", t)) > len(w) or 2 * len(re.findall("[A-Z]", t)) > len(letters) + 1 or 2 * (len(lines) - len(set(lines))) > len(lines) or not 2 * len(w) <= chars <= 16 * len(w))

    kept = [r for r in rows if good(r[1])]
    sets = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in (re.findall(WORD, r[1].lower()) for r in kept)]
    one = []
    for i in sorted(range(len(kept)), key=lambda i: (kept[i][0] is None, kept[i][0])):  # no chains here: a row goes if a smaller id links to it
        if not any(100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]) for j in one):
            one.append(i)
    clean = []
    for i in one:
        text = kept[i][1]
        for kind, p in (("EMAIL", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("IP", r"[0-9]+(\.[0-9]+){3}"), ("PHONE", r"\+[0-9][ ().0-9-]+[0-9]")):
            text = re.sub(p, f"<{kind}>", text)
        clean.append((kept[i][0], text, kept[i][2], kept[i][3], len(text)))
    n = Counter(r[3] for r in clean)
    goal = sum(math.sqrt(x) for x in n.values())
    lib = piece_codec.codec(model_path()).lib
    wanted = Counter()
    for r in clean:
        mean, key = math.sqrt(n[r[3]]) / goal * len(clean) / n[r[3]], r[0]
        if key is None:
            continue  # its number is a hash of its columns: only its presence is free
        u = int(hashlib.md5(f"mix:{key}:0".encode()).hexdigest()[:13], 16) / 2**52
        p = c = math.exp(-mean)
        times = 0
        while c <= u:
            times += 1
            p *= mean / times
            c += p
        ids = lib.encode(r[1], add_bos=True, add_eos=True)
        wanted[(key, r[3], len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())] += times
    stages = dict(cp.STAGES)
    out = docs
    for name, f in stages.items():
        before, out = out, f(spark, out, "").cache()
        assert name == "SentencePiece" or out.columns == docs.columns
        assert f(spark, docs.limit(0), "").count() == 0 and (name != "PII" or before.count() == out.count())
    got = Counter((r.doc_id, r.source, r.n_tokens, r.ids_sha256) for r in out.collect() if r.doc_id is not None)
    assert got == +wanted and len(got) > 10


@pytest.mark.parametrize("name", ["op3_quality_cascade", "op6_url_reputation", "op7_source_mixing", "op9_jaccard_join"])
def test_query_matches_sql(spark, name):
    import duckdb

    from locusflow.llm.queries import ORACLE_SQL, QUERIES

    con = duckdb.connect()
    for t in ("documents", "pages", "labels"):
        con.sql(f"create view {t} as select * from '/root/testdata/sf0.001/{t}.parquet'")
    got, wanted = QUERIES[name](spark, "/root/testdata/sf0.001").toPandas(), con.sql(ORACLE_SQL[name]).df()
    assert sorted(got.columns) == sorted(wanted.columns)
    plain = lambda df: Counter(tuple(None if v is None or v != v else v for v in r) for r in df[sorted(df.columns)].itertuples(index=False))
    assert plain(got) == plain(wanted)
