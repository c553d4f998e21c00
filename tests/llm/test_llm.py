"""The llm operators against brute force, on small fixtures with nulls, ties, repeated rows and clashing columns."""

import hashlib
import random
import tracemalloc
import zlib
from collections import Counter
from decimal import Decimal

import duckdb
import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tapeweave.llm import catalog as llm_catalog
from tapeweave.llm import bpe, bpe_codec, components, cross_polytope, near_dup, packing, quality, suffix_dedup, suffix_tree_lm, telephony, token_orc, toxicity

BYTE, WORD = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
SF = "/root/testdata/sf0.001"
KIND = "doc_id long, text string, lang string, score double, rank int, ids binary"


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(4)
    words = ["alpha", "beta", "gamma", "Delta", "é́t", "idiot", "x1", "don't", "straße", "the", "of"]
    base = [" ".join(rng.choice(words) + str(rng.randrange(60)) for _ in range(rng.choice([3, 20, 120]))) for _ in range(40)]
    passage = " ".join(f"shared{k}" for k in range(30))
    texts = base + base[:6] + [base[2] + " end", base[7].upper(), passage + " " + base[3], base[4] + passage, "", None, " ", "a", "a b", "a  b \n c", "<|endoftext|> z", "日本 語 " * 9, "w" * 6000, "e\x1c  f"]
    return [(i, t) for i, t in enumerate(texts)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame([(i, t, "en", 0.5, 1, b"") for i, t in rows], KIND).repartition(3)


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], KIND)


def plain(text):
    return text or ""


@pytest.mark.parametrize("remembered", [bpe.REMEMBERED, 3])
@pytest.mark.parametrize(("kind", "path"), [(bpe.SegmentTreeBPE, BYTE), (bpe.LibraryBPE, BYTE), (bpe.LibraryBPE, WORD)])
def test_encoders_equal_the_library(rows, kind, path, remembered, monkeypatch):
    monkeypatch.setattr(bpe, "REMEMBERED", remembered)
    rng, letters = random.Random(1), ["a", "B", " ", "  ", "\n", "'s", "é", "1", "!", "<|endoftext|>", "<|startoftext|>", "\t", "\x1c", "́", "İ", "᠎", " a"]
    texts = [plain(t) for _, t in rows] + ["".join(rng.choice(letters) for _ in range(rng.randint(1, 25))) for _ in range(800)]
    tokenizer, mine = Tokenizer.from_file(path), kind(path)
    for at in range(0, len(texts), 40):
        part = texts[at : at + 40]
        got = mine.encode_batch(part)
        for text, ids in zip(part, got):
            want = tokenizer.encode(text, add_special_tokens=False).ids
            assert np.frombuffer(ids, "<u4").tolist() == want, repr(text)
            if kind is bpe.SegmentTreeBPE:
                assert mine.decode(ids) == tokenizer.decode(want, skip_special_tokens=False)


def test_round_trip(spark, docs, rows, nothing):
    got = {r.doc_id: r for r in bpe_codec.round_trip(docs, BYTE).collect()}
    tokenizer = Tokenizer.from_file(BYTE)
    for i, t in rows:
        ids = tokenizer.encode(plain(t), add_special_tokens=False).ids
        assert got[i].n_tokens == len(ids) and got[i].ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert got[i].decoded_sha256 == hashlib.sha256(plain(t).encode()).hexdigest()
    assert {r.doc_id: r.text for r in bpe_codec.decoded(bpe_codec.encoded(docs, BYTE), BYTE).collect()} == {i: plain(t) for i, t in rows}
    assert bpe_codec.round_trip(nothing, BYTE).count() == 0


def test_packing(docs, rows, nothing):
    got = packing.packed(docs, BYTE).collect()
    tokenizer, pieces, sequences = Tokenizer.from_file(BYTE), {}, {}
    for r in got:
        pieces.setdefault(r.doc_id, []).append(r)
        sequences.setdefault(r.sequence_id, []).append(r)
    for i, t in rows:
        ids, at = np.array([*tokenizer.encode(plain(t), add_special_tokens=False).ids, 0], "<u4"), 0
        for r in sorted(pieces[i], key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids) and r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes())
            at += r.length
        assert at == len(ids)
    for rs in sequences.values():
        at = 0
        for r in sorted(rs, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 1024
    assert packing.packed(nothing, BYTE).count() == 0
    assert all(sum(packing.lengths(n)) == n for n in range(1, 1024))


def test_token_orc(spark, docs, rows, nothing, tmp_path):
    token_orc.write_ids(docs, str(tmp_path / "ids"), WORD, 2)
    got = {r.doc_id: r for r in token_orc.digest(spark, str(tmp_path / "ids")).collect()}
    tokenizer, start = Tokenizer.from_file(WORD), 0
    for i, t in rows:
        ids = np.array([*tokenizer.encode(plain(t), add_special_tokens=False).ids, 2], "<u4")
        assert (got[i].start, got[i].n_tokens, got[i].ids_crc32) == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    assert [r.doc_id for r in token_orc.read_ids(spark, str(tmp_path / "ids"), [7]).collect()] == [7]
    token_orc.write_ids(nothing, str(tmp_path / "none"), WORD, 2)
    assert token_orc.digest(spark, str(tmp_path / "none")).count() == 0


def test_telephony(spark, docs, rows, nothing):
    rows = [*rows, (500, "three blocks " * 120)]
    more = spark.createDataFrame([(*rows[-1], "en", 0.5, 1, b"")], KIND)
    media = telephony.saved(telephony.stored(docs.union(docs.where("doc_id = 3")).union(more)), "media")
    found = telephony.digest(media).collect()
    got = {r.doc_id: r for r in found}
    assert Counter(r.doc_id for r in found)[3] == 2
    pcm_of = {r.doc_id: bytes(r.pcm) for r in telephony.resampled(media).collect()}
    for i, t in rows:
        raw = plain(t).encode()
        payload = raw + b"\xff" * (max(1, -(-len(raw) // 576)) * 576 - len(raw))
        assert (got[i].n_bytes, got[i].payload_bytes, got[i].payload_sha256, got[i].tail_crc32) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]))
        tag = telephony.TURNS[len(payload) // 576 % 3]
        wav = telephony.to_wav(payload, tag)
        assert got[i].media_sha256 == hashlib.sha256(wav).hexdigest() and telephony.from_wav(wav) == (tag, payload) and got[i].media_bytes == len(wav)
        if tag == telephony.IMA:
            pcm = [x for at in range(0, len(payload), 576) for x in telephony.adpcm(np.frombuffer(payload[at : at + 576], np.uint8).reshape(1, -1))[:, 0].tolist()]
        else:
            pcm = [int((telephony.mulaw_table() if tag == telephony.MULAW else telephony.alaw_table())[x]) for x in payload]
        wide = [x for a, b in zip(pcm, [*pcm[1:], pcm[-1]]) for x in (a, (a + b) >> 1)]
        assert np.frombuffer(pcm_of[i], "<i2").tolist() == wide
        turns = sum((a < 0) != (b < 0) for a, b in zip(pcm, pcm[1:]))
        assert got[i].feature == f"format={tag} power={sum(x * x for x in pcm) // len(pcm)} turns={turns} pcm16k={zlib.crc32(pcm_of[i]):08x}"
    assert {got[i].feature.split()[0] for i, _ in rows} == {"format=6", "format=7", "format=17"}
    assert telephony.digest(telephony.stored(nothing)).count() == 0


def test_telephony_reads_its_features_from_stored_pcm(spark, docs, rows, monkeypatch):
    seen = {}

    def spoilt(df, name, *options):
        seen[name] = telephony_saved(df, name, *options)
        if name != "pcm":
            return seen[name]
        return seen[name].withColumn("pcm", F.unhex(F.repeat(F.lit("07"), F.octet_length("pcm").cast("int"))))

    telephony_saved = telephony.saved
    monkeypatch.setattr(telephony, "saved", spoilt)
    media = telephony.saved(telephony.stored(docs), "media")
    want = {r.doc_id: bytes(r.pcm) for r in telephony.resampled(media).collect()}
    got = telephony.digest(media).collect()
    assert {r.doc_id: telephony.unlifted(bytes(r.pcm)).tobytes() for r in seen["pcm"].collect()} == want
    assert len(got) == len(rows) and all(r.feature.split()[1:3] == [f"power={0x0707**2}", "turns=0"] for r in got)


def test_lifted_pcm():
    rng = np.random.default_rng(1)
    for n in (0, 2, 4, 1000):
        pcm = rng.integers(-32768, 32768, n).astype("<i2")
        assert telephony.unlifted(telephony.lifted(pcm)).tolist() == pcm.tolist()
    pcm = telephony.doubled(pcm)
    assert not any(telephony.lifted(pcm)[len(pcm) :])


def test_long_words_equal_the_library():
    rng = random.Random(8)
    tokenizer, mine = Tokenizer.from_file(BYTE), bpe.SegmentTreeBPE(BYTE)
    for n in (bpe.ALONE - 1, bpe.ALONE + 1, 30_000):
        for letters in ("ab", "abcdefghijklmnopqrstuvwxyz", "é日x"):
            text = "".join(rng.choice(letters) for _ in range(n))
            assert np.frombuffer(mine.encode_batch([text])[0], "<u4").tolist() == tokenizer.encode(text, add_special_tokens=False).ids


def test_expansion_tables_and_adpcm():
    mu, a = telephony.mulaw_table(), telephony.alaw_table()
    assert (mu[0], mu[0x7F], mu[0x80], mu[0xFF]) == (-32124, 0, 32124, 0)
    assert (a[0x55], a[0xD5], a[0x2A], a[0xAA]) == (-8, 8, -32256, 32256)
    rng = np.random.default_rng(0)
    blocks = rng.integers(0, 256, (5, 64)).astype(np.uint8)
    got = telephony.adpcm(blocks)
    for k, block in enumerate(blocks.tolist()):
        sample, index = int.from_bytes(bytes(block[:2]), "little", signed=True), min(block[2], 88)
        want = [sample]
        for code in (c for b in block[4:] for c in (b & 15, b >> 4)):
            step = telephony.IMA_STEPS[index]
            change = (step >> 3) + (step if code & 4 else 0) + (step >> 1 if code & 2 else 0) + (step >> 2 if code & 1 else 0)
            sample = max(-32768, min(32767, sample - change if code & 8 else sample + change))
            index = max(0, min(88, index + telephony.IMA_INDEX[code & 7]))
            want.append(sample)
        assert got[:, k].tolist() == want


def test_suffix_dedup(docs, rows, nothing):
    seen, want = set(), {}
    for i, t in rows:
        raw = plain(t).encode()
        gone, own = bytearray(len(raw)), set()
        for k in range(len(raw) - 49):
            if raw[k : k + 50] in seen:
                gone[k : k + 50] = b"\1" * 50
            own.add(raw[k : k + 50])
        seen |= own
        runs = sum(gone[k] and (k == 0 or not gone[k - 1]) for k in range(len(raw)))
        want[i] = (len(raw), sum(gone), runs, hashlib.sha256(bytes(b for b, g in zip(raw, gone) if not g)).hexdigest())
    twice = suffix_dedup.digest(docs.union(docs.where("doc_id in (3, 42)"))).collect()
    assert Counter(r.doc_id for r in twice)[42] == 2
    assert {r.doc_id: tuple(r)[1:] for r in twice} == want and sum(w[1] for w in want.values())
    assert suffix_dedup.digest(nothing).count() == 0
    cleaned = suffix_dedup.without_repeats(docs)
    assert cleaned.columns == docs.columns and cleaned.count() == len(rows)


def test_suffix_dedup_of_a_passage_twice_in_one_document(spark):
    rng = random.Random(12)
    filler = lambda n: "".join(rng.choice("abcdefghij ") for _ in range(n))
    rows, want = [], {}
    for k in range(30):
        passage = filler(200)
        rows += [(2 * k, f"{filler(60)}0{passage}1{filler(60)}"), (2 * k + 1, f"{filler(60)}2{passage}3{filler(70)}4{passage}5{filler(60)}")]
        want |= {2 * k: (0, 0), 2 * k + 1: (400, 2)}
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = {r.doc_id: (r.n_removed, r.n_spans) for r in suffix_dedup.digest(frame).collect()}
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert got == want


def test_suffix_dedup_of_several_texts_under_one_id(spark):
    rng = random.Random(6)
    q, z = ("".join(rng.choice("abcdefgh ") for _ in range(n)) for n in (90, 70))
    rows = [(1, q), (2, q), (2, q[:60] + z), (2, z + "!"), (-3, z[:55]), (4, "x" + z), (4, "x" + z), (None, q)]
    gone = {}
    for i, t in rows:
        cut = bytearray(len(t))
        for k in range(len(t) - 49):
            if i is not None and any(j is not None and j < i and t[k : k + 50] in u for j, u in rows):
                cut[k : k + 50] = b"\1" * 50
        gone.setdefault((i, len(t)), []).append(sum(cut))
    got = {}
    for r in suffix_dedup.digest(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect():
        got.setdefault((r.doc_id, r.n_bytes), []).append(r.n_removed)
    assert got == gone and gone[2, 130] == [115] and gone[2, 90] == [90]


def test_loser_tree_merges_with_prefixes():
    rng = random.Random(2)
    for _ in range(200):
        runs = [sorted(bytes(rng.choice(b"ab") for _ in range(rng.randint(1, 6))) for _ in range(rng.randint(1, 9))) for _ in range(rng.randint(1, 6))]
        of, at, known = suffix_dedup.merged([(r, suffix_dedup.front_coded(r)[0].tolist()) for r in runs])
        out = [runs[r][k] for r, k in zip(of, at)]
        assert out == sorted(w for r in runs for w in r)
        for a, b, k in zip(out, out[1:], known[1:]):
            assert a[:k] == b[:k] and (k == min(len(a), len(b)) or a[k] != b[k])
        shared, rests = suffix_dedup.front_coded(runs[0])
        assert suffix_dedup.opened(shared, np.array([len(w) for w in runs[0]]), rests) == runs[0]


@pytest.mark.parametrize("minhash", [near_dup.MinHash(), near_dup.MinHash(words=5, over=80, block=2)])
def test_near_duplicates(spark, rows, nothing, minhash):
    rng, texts = random.Random(8), [plain(t) for _, t in rows]
    for k in range(60):  # a family of near copies
        words = [f"w{j}" for j in range(150)]
        for _ in range(rng.choice([1, 2, 3])):
            words[rng.randrange(150)] = f"new{rng.random()}"
        texts.append(" ".join(words))
    sets = []
    for t in texts:
        w = t.encode().lower().split()
        sets.append({tuple(w[k : k + minhash.words]) for k in range(max(1, len(w) - minhash.words + 1))} if w else set())
    root = list(range(len(texts)))
    for i in range(len(sets)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and both * minhash.under >= len(sets[i] | sets[j]) * minhash.over and root[i] != root[j]:
                a, b = sorted((root[i], root[j]))
                root = [a if r == b else r for r in root]
    frame = spark.createDataFrame([(i, t or None, "x", 0.0, 1, b"") for i, t in enumerate(texts)], KIND)
    got = {r.doc_id: tuple(r)[1:] for r in near_dup.near_duplicates(frame, minhash).collect()}
    assert got == {i: (len(sets[i]), root[i], root[i] == i) for i in range(len(texts))}
    assert near_dup.near_duplicates(nothing, minhash).count() == 0


def test_posting_lists_are_merged_with_prefix_and_skip():
    """Exact counts: every pair at or over the similarity is found, at its very edge too, and no other."""
    rng = np.random.default_rng(7)
    sets = [np.arange(120)]
    for k in range(80):
        gone = rng.choice(120, rng.integers(0, 20), replace=False)
        sets.append(np.sort(np.concatenate([np.setdiff1d(np.arange(120), gone), 1000 + rng.choice(60, rng.integers(0, 20), replace=False)])))
    sets += [np.concatenate([np.arange(102), 5000 + np.arange(n)]) for n in (0, 1, 18, 19)] + [np.arange(9000, 9003)]  # 102 of 120
    sets = [x.astype(np.uint64) for x in sets]
    minhash, found = near_dup.MinHash(), 0
    postings = near_dup.Postings(sets, minhash)
    for i in range(len(sets)):
        common = np.array([len(np.intersect1d(sets[i], x)) for x in sets])
        want = [k for k in range(i + 1, len(sets)) if common[k] * 100 >= (len(sets[i]) + len(sets[k]) - common[k]) * 85]
        assert postings.linked(i, np.ones(len(sets), bool)).tolist() == want
        found += len(want)
    assert 100 < found < len(sets) ** 2 // 3 and len(postings.linked(0, np.zeros(len(sets), bool))) == 0


@pytest.mark.parametrize("name", sorted(llm_catalog.oracle_sql()))
def test_queries_equal_their_sql(spark, name):
    con = duckdb.connect()
    for view in ("documents", "embeddings"):
        con.sql(f"create view {view} as select * from '{SF}/{view}.parquet'")
    got = llm_catalog.queries()[name](spark, SF)
    want = con.sql(f"select {', '.join(got.columns)} from ({llm_catalog.oracle_sql()[name]})").fetchall()
    assert sorted(map(tuple, got.collect())) == sorted(want)


CONTRACT = {
    "op1_cross_polytope": "query_id bigint, rank int, vec_id bigint, score double",
    "op2_suffix_tree_lm": "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double",
    "op3_suffix_dedup": "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string",
    "op4_telephony": "doc_id bigint, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string",
    "op5_token_orc": "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint",
    "op6_bpe_codec": "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string",
    "op7_rule_quality": "doc_id bigint, held_out boolean, score double, predicted int",
    "op8_bigru_toxicity": "doc_id bigint, held_out boolean, score double, predicted int",
    "op9_minhash_near_dedup": "doc_id bigint, n_shingles bigint, component_id bigint, kept boolean",
    "op10_harmonic_packing": "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint",
}


@pytest.mark.parametrize("name", sorted(CONTRACT))
def test_queries_keep_to_their_contract(spark, name):
    got = llm_catalog.queries()[name](spark, SF)
    kinds = dict(got.dtypes)
    assert all(kinds[c] == kind for c, kind in (x.split() for x in CONTRACT[name].split(", ")))
    ids = Counter(r[0] for r in got.select(got.columns[0]).collect())
    if name == "op1_cross_polytope":
        assert set(ids.values()) == {5}
    else:
        docs = spark.read.parquet(f"{SF}/documents.parquet")
        assert len(ids) == docs.count() and (name == "op10_harmonic_packing" or set(ids.values()) == {1})


def test_boilerplate_does_not_chain_documents(spark):
    template = [f"line{j}" for j in range(160)]
    rng = random.Random(2)
    texts = [" ".join([*template, *(f"own{k}x{rng.randrange(9**9)}" for _ in range(41))]) for k in range(600)]
    texts += [t + " end" for t in texts[:30]]
    frame = spark.createDataFrame([(i, t, "x", 0.0, 1, b"") for i, t in enumerate(texts)], KIND)
    minhash = near_dup.MinHash()
    described = near_dup.saved(near_dup.described(frame, minhash), "described")
    classes = described.groupBy(*near_dup.CLASS).agg(near_dup.F.min("doc_id").alias("rep"), near_dup.F.any_value("signature").alias("signature"))
    assert near_dup.candidates(classes, minhash).count() > 500  # by coordinates alone nearly all are chained
    members = frame.selectExpr("doc_id as rep", "text")

    def sets_of(batches):
        for b in batches:
            code, count = minhash.shingles([x.encode() for x in b["text"].to_pylist()])
            end = np.cumsum(count)
            yield near_dup.pa.record_batch([b["rep"], near_dup.pa.array([code[e - n : e].tobytes() for e, n in zip(end.tolist(), count.tolist())])], ["rep", "set"])

    left = near_dup.clustered(members.mapInArrow(sets_of, "rep long, set binary").selectExpr("*", "1 as cluster"), minhash)
    assert {r.rep for r in left.collect()} == {*range(30), *range(600, 630)}
    got = {r.doc_id: r.component_id for r in near_dup.near_duplicates(frame, minhash).collect()}
    assert got == {i: i - 600 if i >= 600 else i for i in range(630)}


def test_components(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(80), rng.randrange(80)) for _ in range(60)] + [(100 + k, 101 + k) for k in range(12)]
    root = {v: v for e in edges for v in e}
    for a, b in edges * 30:
        root[a] = root[b] = min(root[a], root[b])
    got = {r.id: r.component for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {v: r for v, r in root.items() if any(v in e and e[0] != e[1] for e in edges)}


def plain_tree(texts, tree):
    """Each text's log10 probability by a suffix tree in dictionaries. texts: words of each and whether it is learnt from."""
    tokens = [([None, *t, None], train) for t, train in texts]
    counts = Counter(w for t, train in tokens if train for w in t[1:])
    mass = sum(counts.values()) + len(counts) + 1
    after = {}
    for t, train in tokens:
        for i in range(1, len(t)):
            for d in range(1, min(i, tree.depth) + 1):
                if train:
                    after.setdefault(tuple(t[i - d : i]), Counter())[t[i]] += 1
    states = {}

    def chance(context, w):
        p = (counts[w] + 1) / mass
        for d in range(1, len(context) + 1):
            c = context[len(context) - d :]
            if c not in states:
                return p
            n, kinds = states[c]
            p = (max(after[c][w] - tree.discount, 0) + tree.discount * kinds * p) / n
        return p

    for d in range(1, tree.depth + 1):
        new = {}
        for c, f in after.items():
            n = sum(f.values())
            if len(c) == d and n >= tree.least and (d == 1 or c[1:] in states):
                gain = sum(k * (np.log(k / n) + round(-np.log(chance(c[1:], w)) * 8) / 8) for w, k in f.items())
                if gain > tree.gain * len(f) + 1e-6:
                    new[c] = (n, len(f))
        states |= new
    return [sum(np.log10(chance(tuple(t[max(0, i - tree.depth) : i]), t[i])) for i in range(1, len(t))) for t, _ in tokens], Counter(map(len, states))


@pytest.mark.parametrize("kind, to", [("string", str), ("long", lambda i: i << 59), ("int", int), ("decimal(20, 0)", int)])
def test_suffix_dedup_counts_off_ids(spark, kind, to):
    """Strings stand in order of their bytes; ids too large to number texts under one, and several texts under one."""
    rng = random.Random(9)
    z = "".join(rng.choice("abcdefgh ") for _ in range(80))
    rows = [(to(i), t) for i, t in [(2, z), (10, "p" + z), (7, z[:60]), (7, "q" + z[20:]), (3, "short"), (3, "short"), (4, None), (9, "x" * 120)]] + [(None, z)]
    want = Counter()
    for i, t in rows:
        cut = bytearray(len(t or ""))
        for k in range(len(cut) - 49):
            if i is not None and any(j is not None and j < i and t[k : k + 50] in (u or "") for j, u in rows):
                cut[k : k + 50] = b"\1" * 50
        want[i, len(cut), sum(cut)] += 1
    frame = spark.createDataFrame([(None if i is None else Decimal(i) if "dec" in kind else i, t, "x") for i, t in rows], f"doc_id {kind}, text string, tag string").repartition(3)
    out = suffix_dedup.digest(frame)
    assert out.schema["doc_id"].dataType.simpleString().replace("bigint", "long") in (kind, "long", kind.replace(" ", ""))
    assert Counter((r.doc_id, r.n_bytes, r.n_removed) for r in out.collect()) == want and sum(n for _, _, n in want) > 100
    cleaned = suffix_dedup.without_repeats(frame)
    assert cleaned.schema == frame.schema and cleaned.count() == len(rows)
    assert suffix_dedup.digest(frame.where("doc_id is null and doc_id is not null")).count() == 0


@pytest.mark.parametrize("tree", [suffix_tree_lm.SuffixTree(block=150, range=400), suffix_tree_lm.SuffixTree(least=2, depth=3)])
def test_language_model(spark, rows, nothing, tree):
    rows = [*rows, *rows[3:9], (None, "the of the of"), (None, None), (2, "another text under that id"), *((100 + k, "p a b q p a b q r a b s r a b s c b t c b t") for k in range(9))]
    docs = spark.createDataFrame([(i, t, "en", 0.5, 1, b"") for i, t in rows], KIND).repartition(3)
    tokens = [plain(t).encode().lower().split() for _, t in rows]
    held = [i is not None and zlib.crc32(str(i).encode()) % 7 == 2 for i, _ in rows]
    counts = Counter(w for t, h in zip(tokens, held) if not h for w in [*t, None])
    n, v = sum(counts.values()), len(counts)
    scores, states = plain_tree([(t, not h) for t, h in zip(tokens, held)], tree)
    assert states[1] and states[2] and states[3]
    want = sorted((i is None, i or 0, len(t) + 1, round(sum(np.log10((counts[w] + 1) / (n + v + 1)) for w in [*t, None]), 6), round(s, 6), sum(w in counts for w in [*t, None]), h) for (i, _), t, h, s in zip(rows, tokens, held, scores))
    out = suffix_tree_lm.scored(docs, tree)
    assert [f.dataType.simpleString() for f in out.schema] == ["bigint", "boolean", "bigint", "bigint", "bigint", "double", "double"]
    got = sorted((r.doc_id is None, r.doc_id or 0, r.n_tokens, round(r.base_score, 6), round(r.score, 6), r.n_known, bool(r.held_out)) for r in out.collect())
    assert all(np.allclose(a[:5], b[:5], atol=2e-6) and a[5:] == b[5:] for a, b in zip(got, want, strict=True))
    assert out.select("train_tokens").distinct().collect() == [(n,)]
    assert suffix_tree_lm.scored(nothing, tree).collect() == []
    assert not [t.name for t in spark.catalog.listTables() if t.name.startswith("suffix_tree")]


def test_language_model_by_block(spark, rows):
    """However texts are dealt out to blocks, also with blocks in which no context goes on while others' do."""
    texts = [*(t for _, t in rows), *["p a b q p a b q r a b s r a b s c b t c b t"] * 9, *["rare" + str(k) for k in range(9)]]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    whole, single = (sorted(suffix_tree_lm.scored(docs.repartition(n), suffix_tree_lm.SuffixTree(block=b)).collect()) for n, b in ((2, 500_000), (70, 2)))
    assert [r[:5] for r in whole] == [r[:5] for r in single]
    assert np.allclose([r[5:] for r in whole], [r[5:] for r in single], atol=1e-9)


def test_language_model_fills_its_blocks(spark):
    docs = spark.range(0, 6000, 1, 1).selectExpr("id as doc_id", "repeat('longer words ', 120) as text")
    got = sorted(r[0] for r in suffix_tree_lm.blocks(docs, suffix_tree_lm.SuffixTree()).select("n_tokens").collect())
    assert sum(got) == 6000 * 241 and len(got) == 4 and got[1] > 450_000


def test_language_model_walks_in_little_room(spark):
    """What a block's walk holds at once, in bytes for each token: work on codes, with places in 32 bits."""
    rng = np.random.default_rng(3)
    texts = [(k, " ".join(f"w{w}" for w in np.minimum(rng.zipf(1.3, 500), 20_000))) for k in range(400)]
    tree = suffix_tree_lm.SuffixTree()
    row = suffix_tree_lm.blocks(spark.createDataFrame(texts, "doc_id long, text string").coalesce(1), tree).first().asDict()
    known, answers = suffix_tree_lm.Known(1), []
    for depth in range(3):
        tracemalloc.start()
        codes, _, hot, counts, _ = suffix_tree_lm.walk(row, answers, known, tree).ask
        most = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert len(codes) > 3000 and not hot.any()
        assert most < 110 * row["n_tokens"]
        head = np.flatnonzero(np.append(True, codes[1:] >> np.uint64(24) != codes[:-1] >> np.uint64(24)))
        answers.append({0: (counts, np.add.reduceat((counts > 0).astype(np.int64), head))})
        known = suffix_tree_lm.Known(1, 10**9, int((counts > 0).sum()) if not depth else known.distinct, known.hot + ((np.empty(0, np.uint64), np.empty(0, np.int64)),) * (depth > 0))


@pytest.mark.parametrize("top", [50, 2**40])
def test_pairs(top):
    rng = np.random.default_rng(2)
    a, b = rng.integers(0, top, 300), rng.integers(0, top, 300)
    a[150:], b[150:] = a[:150], b[150:] % 3
    place, one = suffix_tree_lm.pairs(a, b)
    want = sorted(set(zip(a.tolist(), b.tolist())))
    assert list(zip(a[one].tolist(), b[one].tolist())) == want and [want[k] for k in place] == list(zip(a.tolist(), b.tolist()))
    assert [len(x) for x in suffix_tree_lm.pairs(a[:0], b[:0])] == [0, 0]


def test_cross_polytope(spark):
    rng = np.random.default_rng(5)
    x = rng.standard_normal((600, 24)).astype(np.float32)
    x[40:80] = x[3]
    rows = [(i, v.tolist(), 1) for i, v in enumerate(x)] + [(1000, None, 1), (1001, [0.0] * 24, 1), (1002, [float("nan")] * 24, 1), (1003, [None] * 24, 1), (1004, [], 1), (3, x[3].tolist(), 1)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    got = {}
    for r in cross_polytope.search(frame.where("vec_id % 50 = 0 or vec_id = 3"), frame).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    wide = x.astype(float)
    norm = np.sqrt((wide * wide).sum(1))
    hits = 0
    for q, found in got.items():
        cosine = (wide @ wide[q]) / (norm * norm[q])
        want = [k for k in np.lexsort((np.arange(600), -np.round(cosine, 12))) if k != q][:5]
        found.sort()
        assert [r for r, _, _ in found] == [1, 2, 3, 4, 5] and all(abs(cosine[v] - s) < 1e-12 for _, v, s in found)
        hits += len({v for _, v, _ in found} & set(want))
    assert set(got) == {3, *range(0, 600, 50)} and hits >= 0.9 * 5 * len(got)
    assert [v for _, v, _ in got[50]] == [3, 40, 41, 42, 43]
    few = spark.createDataFrame(rows[:3], frame.schema)
    assert cross_polytope.search(few, few).count() == 6
    assert cross_polytope.search(frame.limit(0), frame.limit(0)).count() == 0


def corpus(spark):
    rng, rows, labels = random.Random(6), [], []
    vocabulary = [f"w{chr(97 + k % 26)}{k}" for k in range(300)]
    for i in range(400):
        words = [rng.choice(vocabulary) for _ in range(rng.choice([20, 90, 200]))]
        toxic, poor = i % 4 == 0, i % 5 == 0
        if toxic:
            for _ in range(3):
                words[rng.randrange(len(words))] = rng.choice(["idiot", "moron!", "Scum"])
        rows.append((i, " ".join(w + "###" * poor for w in words), "en", 0.0, 1, b""))
        labels.append((i, int(not poor), int(toxic)))
    return spark.createDataFrame([*rows, (400, "", "en", 0.0, 1, b""), (401, None, "en", 0.0, 1, b"")], KIND), spark.createDataFrame([*labels, (7, None, None), (None, 1, 1)], "doc_id long, quality int, toxic int")


def test_classifiers_on_held_out_rows(spark, nothing):
    docs, labels = corpus(spark)
    of = {r.doc_id: r for r in labels.collect() if r.quality is not None}
    for scored, label, modulus, rest in ((quality.scored(docs, quality.train(docs, labels)), "quality", 4, 2), (toxicity.scored(docs, toxicity.train(docs, labels)), "toxic", 5, 0)):
        got = {r.doc_id: r for r in scored.collect()}
        assert len(got) == 402 and all(0 <= r.score <= 1 for r in got.values())
        assert all(r.held_out == (zlib.crc32(str(i).encode()) % modulus == rest) for i, r in got.items())
        held = [i for i, r in got.items() if r.held_out and i < 400]
        assert np.mean([got[i].predicted == of[i][label] for i in held]) > 0.9
    assert quality.scored(nothing, quality.train(nothing, labels)).count() == 0
    assert toxicity.scored(nothing, toxicity.train(nothing, labels)).count() == 0


def test_training_samples_are_bounded(spark, monkeypatch):
    """Rows that repeat an id don't grow the sample beyond its bound, and huge texts take no part in training."""
    seen = []
    monkeypatch.setattr(toxicity, "train_network", lambda rows: seen.append(rows))
    labels = spark.createDataFrame([(1, 1, 1), (3, 0, 0), (4, 0, 0)], "doc_id long, quality int, toxic int")
    rows = [(i, f"word{i} again {k}") for i in (1, 3, 4) for k in range(20)] + [(i, "x" * (toxicity.LONGEST + 1)) for i in (1, 3, 4)] + [(1, None), (None, "none")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    toxicity.train(docs, labels, most=3)
    assert len(seen[0]) == 6
    assert all(len(text) <= toxicity.LONGEST for text, _ in seen[0])
    monkeypatch.setattr(toxicity, "BYTES", 40)
    toxicity.train(docs, labels, most=3)
    assert 0 < sum(len(text) for text, _ in seen[1]) <= 40
    assert len(quality._sample(quality.sample_of(docs, labels, "quality", F.lit(True), 5), 5)[1]) == 5


def test_gradients():
    rng = np.random.default_rng(1)
    weights = {k: v.astype(np.float64) for k, v in toxicity.fresh().items()}
    words = [b"one", b"two", b"three", b"four"]
    index, live = toxicity.laid([[1, 2, 3], [4, 1]])
    labels = np.array([1.0, 0.0])

    def loss(keep=None):
        x = np.vstack([weights["pad"], toxicity.inputs(weights, words)])
        logit = toxicity.forward(weights, tuple(x @ weights[f"W{s}"] + weights[f"b{s}"] for s in "fb"), index, live, keep)
        return x, logit, np.sum(np.log1p(np.exp(logit)) - labels * logit)

    keep = {}
    x, logit, _ = loss(keep)
    keep["inputs"] = x
    grads, _ = toxicity.back(weights, index, keep, toxicity.sigmoid(logit) - labels, len(x))
    for name in ("Uf", "Wb", "A", "v", "o"):
        at = tuple(rng.integers(0, n) for n in weights[name].shape)
        before = weights[name][at]
        weights[name][at] = before + 1e-2
        up = loss()[2]
        weights[name][at] = before - 1e-2
        down = loss()[2]
        weights[name][at] = before
        assert grads[name][at] == pytest.approx((up - down) / 2e-2, rel=0.05, abs=1e-3)


def test_pipeline(spark):
    import corpus_pipeline

    packed = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    kept = {r.doc_id for r in packed.select("doc_id").distinct().collect()}
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet").collect()
    clean = [r.doc_id for r in labels if r.quality and not r.toxic]
    assert kept and np.mean([i in kept for i in clean]) > 0.6
    assert {name for name, _ in corpus_pipeline.STAGES} == {"toxicity", "quality", "near_dedup", "suffix_dedup", "packing"}


def test_quality_without_a_split_scores_the_share_of_ones():
    """Rows of both labels, too few or too alike for any rule."""
    for x in (np.random.default_rng(1).random((30, len(quality.STATS))), np.ones((200, len(quality.STATS)))):
        y = np.arange(len(x)) % 3 == 0
        rules = quality.fit(x, y.astype(float))
        assert not rules.rules and rules.score(x) == pytest.approx(np.full(len(x), y.mean()))
