"""Byte-level BPE, token alignment and conversation repair against the libraries and brute force."""

import base64
import hashlib
import heapq
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from locusflow.llm import byte_bpe, conversation_repair, token_alignment
from locusflow.llm.queries import QUERIES, model_path

FOLDER = "/root/testdata/sf0.001"
RANKS, JSON = model_path("byte_bpe_multi_50k.tiktoken"), model_path("byte_bpe_50k.json")
ODD = [
    None, "", " ", "  ", "a", "don't 'll they're I'VE ''s 's\n's\t't  'd'", "ab'", "'r're'rex'lll 'l", "a's's", "<|endoftext|> hi", "x" * 3000, " " * 900, "\n\n\n a  b\t\tc \n",
    "日本語　テスト 123四五", "  x 　y", "1'2's3", "é'sé", "\x00\x00 \x1c\x1d\x85a", "😀😀 🏳️‍🌈", "a ▁ b", "▁",
]


@pytest.fixture(scope="module")
def libraries():
    import public_tokenizers
    import sentencepiece
    import tiktoken
    from tokenizers import Tokenizer

    with open(RANKS, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    tokenizer = Tokenizer.from_file(JSON)
    tokenizer.encode_special_tokens = True
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}), tokenizer, sentencepiece.SentencePieceProcessor(model_file=model_path())


def mixed_texts(n: int, seed: int) -> list[str]:
    rnd = random.Random(seed)
    letters = " \n\t'''strevmld abcXY12½.,!?日é 　😀 "
    return ["".join(rnd.choice(letters) for _ in range(rnd.randint(0, 60))) for _ in range(n)]


def encoded(path: str, texts: list) -> list[list[int]]:
    ids, first, _ = byte_bpe.load(path).encode_column(pa.array(texts, pa.string()))
    return [ids[a:b].tolist() for a, b in zip(first[:-1], first[1:])]


def test_byte_bpe_equals_the_libraries(libraries, monkeypatch):
    texts = ODD + mixed_texts(1500, 1)
    for stretch, remembered in ((5_000_000, 250_000), (40, 30)):
        monkeypatch.setattr(byte_bpe, "STRETCH", stretch)
        monkeypatch.setattr(byte_bpe, "REMEMBERED", remembered)
        assert encoded(RANKS, texts) == [libraries[0].encode_ordinary(t or "") for t in texts]
        assert encoded(JSON, texts) == [libraries[1].encode(t or "", add_special_tokens=False).ids for t in texts]


def test_byte_bpe_classes_of_code_points(libraries):
    texts = [f"a{chr(c)}b {chr(c)}1{chr(c)} {chr(c)}{chr(c)}" for c in [*range(0x3100), *range(0x3100, 0x110000, 97)] if not 0xD800 <= c < 0xE000]
    assert encoded(RANKS, texts) == [libraries[0].encode_ordinary(t) for t in texts]


def test_merging_all_places_at_once_equals_one_by_one():
    bpe = byte_bpe.load(RANKS)
    texts = pa.array(["".join(random.Random(s).choice("aab \n") for _ in range(400)) for s in range(20)])
    fast = bpe.encode_column(texts)[0].tolist()
    held, bpe.at_once, bpe.memory = bpe.at_once, np.zeros_like(bpe.at_once), byte_bpe._Memory()
    slow = bpe.encode_column(texts)[0].tolist()
    bpe.at_once = held
    assert fast == slow


def test_byte_bpe_documents_round_trip(spark, libraries):
    docs = spark.createDataFrame([(i % 5, t, "kept") for i, t in enumerate(ODD + ODD)], "doc_id long, text string, n_tokens string")
    out = byte_bpe.encode_documents(docs, RANKS, with_ids=True)
    assert out.columns == ["doc_id", "text", "n_tokens", "n_tokens_", "ids_sha256", "decoded_sha256", "ids"]
    for r in byte_bpe.decode_ids(out, RANKS, to="again").collect():
        wanted = libraries[0].encode_ordinary(r.text or "")
        assert r.ids == wanted and r.n_tokens_ == len(wanted) and r.again == (r.text or "") and r.n_tokens == "kept"
        assert r.ids_sha256 == hashlib.sha256(np.array(wanted, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256((r.text or "").encode()).hexdigest()
    assert byte_bpe.encode_documents(docs.limit(0), RANKS).count() == 0


def test_op13_on_documents(spark, libraries):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}
    rows = QUERIES["op13_byte_bpe"](spark, FOLDER).collect()
    assert len(rows) == len(texts)
    for r in rows:
        ids = libraries[0].encode_ordinary(texts[r.doc_id] or "")
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())


def brute_alignment(texts: list, libraries) -> list[tuple]:
    """Per text: n_a, n_b, n_groups, n_links, n_best, count_sum, digest."""
    letters = byte_bpe._byte_letters()
    _, tokenizer, pieces = libraries
    every = []
    for t in texts:
        a = tokenizer.encode(" " + t, add_special_tokens=False).ids if t else []
        b = pieces.encode(t) if t else []
        bytes_a = [bytes(letters[c] for c in tokenizer.id_to_token(i)) for i in a]
        bytes_b = [bytes([int(p[3:5], 16)]) if pieces.is_byte(i) else p.replace("▁", " ").encode() for i, p in ((i, pieces.id_to_piece(i)) for i in b)]
        groups = []
        if t and b"".join(bytes_a) == b"".join(bytes_b) == (" " + t).encode():
            ends_a, ends_b = np.cumsum([len(x) for x in bytes_a]), np.cumsum([len(x) for x in bytes_b])
            low_a = low_b = 0
            for end in sorted(set(ends_a.tolist()) & set(ends_b.tolist())):
                high_a, high_b = int((ends_a <= end).sum()), int((ends_b <= end).sum())
                groups.append((a[low_a:high_a], b[low_b:high_b]))
                low_a, low_b = high_a, high_b
        every.append(groups)
    count = Counter(p for groups in every for p in {(x, y) for a, b in groups for x in a for y in b})
    most = defaultdict(int)
    for (x, _), n in count.items():
        most[x] = max(most[x], n)
    out = []
    for groups in every:
        links = [(x, y) for a, b in groups for x in a for y in b]
        text = ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in groups)
        out.append((
            sum(len(a) for a, _ in groups), sum(len(b) for _, b in groups), len(groups), len(links), sum(count[p] == most[p[0]] for p in links), sum(count[p] for p in links),
            hashlib.sha256(text.encode()).hexdigest() if groups else "",
        ))
    return out


def alignment_columns(r) -> tuple:
    return tuple(r[c] for c in ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"))


def test_alignment_equals_brute_force(spark, libraries, monkeypatch):
    texts = ODD + ["the cat sat. The cat!"] * 3 + mixed_texts(60, 2)
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, n_best string").repartition(3)
    wanted = brute_alignment(texts, libraries)
    got = token_alignment.align_documents(docs, JSON, model_path()).collect()
    assert len(got) == len(texts) and {"n_best", "n_best_"} <= set(got[0].asDict())
    assert {r.doc_id: (r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best_, r.count_sum, r.groups_sha256) for r in got} == dict(enumerate(wanted))
    assert token_alignment.align_documents(docs.limit(0), JSON, model_path()).count() == 0
    # groups counted by distinct ids give the same pairs as expanded ones
    aligner = token_alignment.Aligner(JSON, model_path())
    plain = aligner.align(pa.array([" " * 700, "ab  cd"])).pairs(17, 15)
    monkeypatch.setattr(token_alignment, "DENSE", 3)
    assert all((x == y).all() for x, y in zip(plain, aligner.align(pa.array([" " * 700, "ab  cd"])).pairs(17, 15)))


def test_token_groups_and_linked_pairs(spark, libraries):
    docs = spark.createDataFrame([(1, "the cat saté."), (2, ""), (3, "the dog")], "doc_id long, text string")
    rows = token_alignment.token_groups(docs, JSON, model_path()).orderBy("doc_id", "group").collect()
    for k, text in ((1, "the cat saté."), (3, "the dog")):
        own = [r for r in rows if r.doc_id == k]
        assert own[0].start == 0 and own[-1].end == len(text.encode()) and all(x.end == y.start for x, y in zip(own, own[1:]))
        assert [i for r in own for i in r.a_ids] == libraries[1].encode(" " + text, add_special_tokens=False).ids
        assert [i for r in own for i in r.b_ids] == libraries[2].encode(text)
    pairs = {(r.a_id, r.b_id): r.documents for r in token_alignment.linked_pairs(docs, JSON, model_path()).collect()}
    assert pairs[(libraries[1].encode(" the").ids[0], libraries[2].encode("the")[0])] == 2


def test_op12_on_documents(spark, libraries):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").collect()
    wanted = dict(zip((d.doc_id for d in docs), brute_alignment([d.text for d in docs], libraries)))
    assert {r.doc_id: alignment_columns(r) for r in QUERIES["op12_token_alignment"](spark, FOLDER).collect()} == wanted


SPACES = " \t\n\v\f\r"


def brute_repair(rows: list[tuple]) -> tuple:
    """Dijkstra over (rows done, grammar state), by (cost, audit)."""
    hurt = []
    for conv, turn, role, text in rows:
        role, text = (" " if x is None else x for x in (role, text))
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role = "user" if kind == 4 else role
        text = "" if kind == 1 else text.translate({ord(c): None for c in ".!?"}) if kind == 2 else text
        hurt += [(turn, role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    hurt.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.sha256(r[2].encode()).hexdigest()))
    faults, seen = [], set()
    for _, role, text in hurt:
        core = text.strip(SPACES)
        faults.append("blank" if not core else "duplicate" if (role, text) in seen else "truncated" if core[-1] not in ".!?" else "")
        seen.add((role, text))
    step = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}
    heap, done = [(0, "", 0, "", [])], set()
    while True:
        cost, audit, i, state, made = heapq.heappop(heap)
        if i == len(hurt) and state in ("", "a"):
            break
        if (i, state) in done:
            continue
        done.add((i, state))
        for name in ("user", "assistant"):
            if (state, name[0]) in step:
                heapq.heappush(heap, (cost + 3, audit + "I", i, name[0], [*made, f"{name}:"]))
        if i < len(hurt):
            _, role, text = hurt[i]
            heapq.heappush(heap, (cost + 4, audit + "D", i + 1, state, made))
            if faults[i] not in ("blank", "duplicate"):
                more = 3 * (faults[i] == "truncated")
                if (state, role[:1]) in step:
                    heapq.heappush(heap, (cost + more, audit + "K", i + 1, role[:1], [*made, f"{role}:{text}"]))
                for name in ("user", "assistant"):
                    if (state, name[0]) in step:
                        heapq.heappush(heap, (cost + more + 3, audit + "R", i + 1, name[0], [*made, f"{name}:{text}"]))
    turns = [t for t, _, _ in hurt if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(hurt, hurt[1:]))
    return gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit, hashlib.sha256("\n".join(made).encode()).hexdigest()


def repaired(rows) -> dict:
    return {r.conv_id: tuple(r)[1:] for r in rows}


def test_repair_equals_brute_force_on_odd_conversations(spark):
    rnd, rows = random.Random(5), []
    for conv in [*range(150), None]:
        for i in range(rnd.randint(1, 9)):
            turn = rnd.choice([i, i, i, i + 3, None])
            rows.append((conv, turn, rnd.choice(["user", "assistant", "user", "assistant", "system", "tool", "", "sys", None]), rnd.choice(["Hi.", "Yes!", "no", "", " \t\v", "a?  ", None, "long é. \n", "other.", "Hi."])))
    rows += [(500, t, ("user", "assistant")[t % 2], f"turn {t}.") for t in range(700)]
    by = defaultdict(list)
    for r in rows:
        by[r[0]].append(r)
    table = spark.createDataFrame([(*r, 7) for r in rows], "conv_id long, turn long, role string, text string, gone int").repartition(3)
    got = conversation_repair.repair_damaged(table)
    assert got.columns == ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    got = repaired(got.collect())
    assert set(got) == set(by)
    for conv, own in by.items():
        assert got[conv] == brute_repair(own), own
    assert conversation_repair.repair_damaged(table.limit(0)).count() == 0


def test_rests_are_shared(spark):
    words = ["UAUA", "XAUA", "AUA", "UA", "UAD"]
    dawg = conversation_repair.SuffixDawg(words)
    rests = {w[i:] for w in words for i in range(len(w) + 1)}
    assert len(dawg.cost) == len(rests) and dawg.audits() == ["KKKK", "RKKK", "IKKK", "KK", "KKD"] and dawg.cost[dawg.node, 0].tolist() == [0, 3, 3, 0, 4]


def test_op11_on_conversations(spark):
    by = defaultdict(list)
    for r in spark.read.parquet(f"{FOLDER}/conversations.parquet").select("conv_id", "turn", "role", "text").collect():
        by[r.conv_id].append(tuple(r))
    assert repaired(QUERIES["op11_conversation_repair"](spark, FOLDER).collect()) == {k: brute_repair(v) for k, v in by.items()}
