"""Hard negatives, token alignment and line dedup against plain loops."""

import hashlib
import math
import random
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer

from tapeweave.llm import hard_negatives, line_dedup, token_alignment

BYTE, PIECE = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
KIND = "doc_id long, text string, tag long, keep string, at int, block int, h long"


def frame(spark, rows, kind=KIND):
    """Rows with further columns whose names the operators use inside."""
    return spark.createDataFrame([(*r, 7, "x", 1, 2, 3) for r in rows], kind).repartition(3)


# Hard negatives.


def plain_mined(rows, every, positives, negatives, low, high, scale=256):
    good = [(i, label, tuple(math.floor(scale * x) for x in v)) for i, label, v in rows if i is not None and label is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    good, out = sorted(set(good)), []
    for i, label, v in good:
        if i % every:
            continue
        scored = sorted((-sum(a * b for a, b in zip(v, w)), j, m) for j, m, w in good if len(w) == len(v))
        for score, j, m in [s for s in scored if s[2] == label and s[1] != i][:positives]:
            hits = [s for s in scored if s[2] != label and -low * score <= -100 * s[0] <= -high * score][:negatives]
            out += [(i, j, k + 1, s[1], -score, -s[0]) for k, s in enumerate(hits)]
    return sorted(out)


VECTORS = "vec_id long, label int, embedding array<double>, lane int, `group` int, window int, score int"


def vectors(spark, rows):
    return spark.createDataFrame([(*r, 1, 2, 3, 4) for r in rows], VECTORS).repartition(3)


@pytest.mark.parametrize("bucket", [2048, 7])
def test_hard_negatives_against_loops(spark, monkeypatch, bucket):
    rng = random.Random(bucket)
    rows = [(k, rng.randrange(3), [rng.gauss(0, 1) * (1 + k % 5) for _ in range(4)]) for k in range(260)]
    rows += [(300 + k, k % 3, [0.5, 0.25, 0.0, 1.0]) for k in range(60)]  # ties
    rows += [(400 + k, k % 2, [0.0] * 4) for k in range(8)] + [(500 + k, k % 2, [1.0 * k, 2.0]) for k in range(12)]
    rows += rows[:15] + [(0, 1, [1.0, 1.0, 1.0, 1.0]), (20, 2, [3.0, 0.0, 0.0, 0.0])]  # repeated rows and ids
    rows += [(600, None, [1.0] * 4), (None, 1, [1.0] * 4), (620, 1, None), (640, 1, [1.0, None, 1.0, 1.0]), (660, 1, [float("nan")] * 4), (680, 1, [float("inf"), 0.0, 0.0, 0.0])]
    rows += [(700 + k, 9, [0.1 * k] * 3) for k in range(3)]  # one label only: no negatives
    monkeypatch.setattr(hard_negatives, "BUCKET", bucket)
    monkeypatch.setattr(hard_negatives, "LANE", 2)
    assert hard_negatives.in_buckets(hard_negatives.quantized(vectors(spark, rows), 256)).count() >= (3 if bucket > 99 else 40)
    got = hard_negatives.mined(vectors(spark, rows), 20, 5, 10)
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    want = plain_mined(rows, 20, 5, 10, 30, 90)
    both = [sorted(map(tuple, got.collect())), want]
    for side in both:  # two rows share the ids 0 and 20: their results stand under one id
        assert len(side) > 100
    assert both[0] == both[1]


def test_hard_negatives_edges(spark):
    assert hard_negatives.mined(vectors(spark, []), 20).count() == 0
    assert hard_negatives.mined(vectors(spark, [(20, 1, [1.0]), (21, 1, [1.0])]), 20).count() == 0
    big = [(20, 1, [9e5, 0.0]), (21, 1, [9e5, 1.0]), (22, 0, [8e5, 0.0]), (23, 0, [1e5, 0.0])]
    assert sorted(map(tuple, hard_negatives.mined(vectors(spark, big), 20).collect())) == plain_mined(big, 20, 5, 10, 30, 90)
    with pytest.raises(Exception, match="too long"):
        hard_negatives.mined(vectors(spark, [(20, 1, [1e12])]), 20).count()


def test_buckets_are_left_out():
    """A bucket whose norm can't reach the kth score is not looked at."""
    at, high = np.zeros(1, np.int64), np.array([hard_negatives.HIGHEST])
    s = hard_negatives.Sweep(np.array([[3, 4]]), np.array([1]), np.array([1]), np.array([5.0]), at, high, np.array([hard_negatives.LOWEST]), 1, True)
    s.meet(np.array([[30, 40]]), np.array([2]), np.array([1]), 50.0)
    assert s.limit.tolist() == [250]
    s.meet(np.array([[300, 400]]), np.array([3]), np.array([1]), 40.0)  # a norm that says less than is there
    assert [x.tolist() for x in s.found] == [[0], [250], [2]]


# Token alignment.


def plain_alignment(texts):
    a_side, sp = Tokenizer.from_file(BYTE), SentencePieceProcessor(model_file=PIECE)
    a_side.encode_special_tokens = True
    byte_of = {c: b for b, c in token_alignment.byte_letters().items()}
    docs = []
    for text in texts:
        one, groups, links = ([], []), [], []
        if text:
            whole = (" " + text).encode()
            a = [(i, bytes(byte_of[c] for c in a_side.id_to_token(i))) for i in a_side.encode(" " + text, add_special_tokens=False).ids]
            b = [(i, bytes([int(p[3:5], 16)]) if sp.is_byte(i) else p.replace("▁", " ").encode()) for i in sp.encode(text) for p in [sp.id_to_piece(i)]]
            if b"".join(x for _, x in a) == whole == b"".join(x for _, x in b):
                one = (a, b)
                spans = []
                for side in one:
                    at, out = 0, []
                    for i, x in side:
                        out.append((at, at + len(x), i))
                        at += len(x)
                    spans.append(out)
                links = [(x[2], y[2]) for x in spans[0] for y in spans[1] if x[0] < y[1] and y[0] < x[1]]
                start = 0
                for end in sorted({x[1] for x in spans[0]} & {y[1] for y in spans[1]}):
                    groups.append("|".join(",".join(str(x[2]) for x in s if start < x[1] <= end) for s in spans))
                    start = end
        docs.append((len(one[0]), len(one[1]), groups, links))
    counts = Counter(p for *_, links in docs for p in set(links))
    most = defaultdict(int)
    for (a, _), n in counts.items():
        most[a] = max(most[a], n)
    return [(n_a, n_b, len(g), len(k), sum(counts[p] == most[p[0]] for p in k), sum(counts[p] for p in k), hashlib.sha256(";".join(g).encode()).hexdigest() if g else "") for n_a, n_b, g, k in docs]


@pytest.fixture(scope="module")
def odd_texts():
    rng, parts = random.Random(12), ["a", "The", " ", "  ", "\n", "'s", "é", "ﬁ", "12", "!", "<|endoftext|>", "<s>", "</s>", "<0x0A>", "▁", "\t", "日本", "𝒳", " ", "hello", " world", "naïve", "\r\n", "<unk>"]
    texts = ["", None, " ", "a", " a", "a ", "hello world " * 400, "w" * 4000, "日本語 " * 50, "▁x", "The cat's 12 hats."] * 2
    return texts + ["".join(rng.choice(parts) for _ in range(rng.randint(1, 30))) for _ in range(250)]


@pytest.mark.parametrize("step", [2_000_000, 300])
def test_alignment_against_loops(spark, odd_texts, monkeypatch, step):
    monkeypatch.setattr(token_alignment, "BLOCK_BYTES", step)
    docs = frame(spark, list(enumerate(odd_texts)))
    got = {r.doc_id: r for r in token_alignment.alignment(docs, BYTE, PIECE).collect()}
    want = plain_alignment(odd_texts)
    assert len(got) == len(odd_texts)
    for k, w in enumerate(want):
        assert tuple(got[k])[1:] == w, repr(odd_texts[k])
    assert sum(w[0] == 0 for w in want) > 10 and sum(w[0] > 0 for w in want) > 100


def test_alignment_edges(spark, odd_texts):
    assert token_alignment.alignment(frame(spark, []), BYTE, PIECE).count() == 0
    rows = [(None, "one two"), (3, "one two"), (3, "one two"), (3, "three")]
    got = token_alignment.alignment(frame(spark, rows), BYTE, PIECE).collect()
    assert sorted(r.count_sum for r in got) == sorted(w[5] for w in plain_alignment([t for _, t in rows])) and sum(r.doc_id is None for r in got) == 1
    long = "many words make a long text " * 40_000
    one = token_alignment.alignment(frame(spark, [(1, long)]), BYTE, PIECE).first()
    assert one.n_links >= max(one.n_a, one.n_b) and one.n_best == one.n_links
    texts = [t for t in odd_texts if t][:60]
    groups = token_alignment.groups(frame(spark, list(enumerate(texts))), BYTE, PIECE)
    by_doc = defaultdict(list)
    for r in groups.orderBy("doc_id", "group").collect():
        by_doc[r.doc_id].append(f"{','.join(map(str, r.a))}|{','.join(map(str, r.b))}")
    want = plain_alignment(texts)
    assert {k: hashlib.sha256(";".join(g).encode()).hexdigest() for k, g in by_doc.items()} == {k: w[6] for k, w in enumerate(want) if w[6]}
    assert token_alignment.products(groups).count() == sum(len(r.a) * len(r.b) for r in groups.collect())


# Line dedup.


def plain_lines(rows, least=10):
    keys = lambda t: [(x, x.strip(" \t\n\x0b\x0c\r").translate({c: c + 32 for c in range(65, 91)})) for x in (t or "").split("\n")]
    order = lambda i: (i is not None, i or 0)
    owner: dict = {}
    for i, t in sorted(rows, key=lambda r: order(r[0])):
        for _, key in keys(t):
            owner.setdefault(key, i)
    out = []
    for i, t in rows:
        lines = keys(t)
        kept = [x for x, key in lines if len(key) < least or owner[key] == i]
        out.append((order(i), len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out)


def line_rows():
    rng = random.Random(13)
    pool = [" A common line \t", "a COMMON line", "short", "ten points", "éé éé éé éé", "日本語日本語日本語日", "日本語日本語日本語", " not stripped", "not stripped..", "\x0bnot stripped..\x0c", "x" * 300, "", "   "] + [f"line number {k}" for k in range(40)]
    rows = [(k, "\n".join(rng.choice(pool) for _ in range(rng.randint(1, 12)))) for k in range(120)]
    rows += [(k, "a common line") for k in range(200, 420)]  # one line in most documents
    rows += [(500, None), (501, ""), (502, "\n\n"), (503, "Trailing line here\n"), (504, "trailing line here"), (None, "line number 3\nonly here once"), (3, "other text\nline number 5\nline number 5"), *rows[5:9]]
    return rows + [(600, "\n".join(["repeated in one text"] * 3000)), (601, "repeated in one text\nkept " + "z" * 300_000)]


@pytest.mark.parametrize("partitions", ["4", "97"])
def test_line_dedup_against_loops(spark, partitions):
    rows = line_rows()
    old = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    spark.conf.set("spark.sql.adaptive.enabled", str(partitions == "4").lower())  # else small ranges become one
    try:
        docs = frame(spark, rows)
        bitmaps = line_dedup.keep_bitmaps(docs)
        order = lambda i: (i is not None, i or 0)
        want = plain_lines(rows)
        got = sorted((order(r.doc_id), r.n_lines, r.n_dropped, r.kept_sha256) for r in line_dedup.digest(docs, bitmaps).collect())
        assert got == sorted((*w[:3], hashlib.sha256(w[3].encode()).hexdigest()) for w in want)
        assert sum(w[2] for w in want) > 400
        assert sorted((order(r.doc_id), r.text) for r in line_dedup.without_lines(docs, bitmaps).collect()) == sorted((w[0], w[3]) for w in want)
        kinds = {r.kind for r in line_dedup.streamed(line_dedup.hashed(docs, 10)).collect()}
        assert kinds == {0, 1, 2}
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)


def test_line_dedup_edges(spark):
    nothing = frame(spark, [])
    assert line_dedup.keep_bitmaps(nothing).count() == 0 and line_dedup.digest(nothing, line_dedup.keep_bitmaps(nothing)).count() == 0
    named = spark.createDataFrame([("b", "the same line"), ("a", "the same line"), ("c", "another line here")], "doc_id string, text string")
    got = {r.doc_id: r.n_dropped for r in line_dedup.digest(named, line_dedup.keep_bitmaps(named)).collect()}
    assert got == {"a": 0, "b": 1, "c": 0}
    bits = line_dedup.packed(np.array([1, 9]))
    assert line_dedup.kept_lines(b"\n".join(b"%d" % k for k in range(20)), bits) == ([b"%d" % k for k in range(20) if k not in (1, 9)], 20)


def test_alignment_remembers_a_bounded_number_of_pieces(monkeypatch):
    """Both encoders begin anew beyond the bound, and give the same ids."""
    import public_tokenizers

    from tapeweave.llm import token_alignment

    path_a, path_b = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
    texts = [[f" word{k * j} x{k} tail" .encode() for j in range(40)] for k in range(30)]
    for kind, path in ((token_alignment.PlainBPE, path_a), (token_alignment.SentencePieceBPE, path_b)):
        whole = kind(path)
        assert whole.most <= 500_000 and len(whole.keys) <= 1 << 20
        monkeypatch.setattr(kind, "most", 200)
        small = kind(path)
        assert all(small.encode_raw(t) == whole.encode_raw(t) and small.rows <= 200 for t in texts) and whole.rows > 100
        monkeypatch.undo()
