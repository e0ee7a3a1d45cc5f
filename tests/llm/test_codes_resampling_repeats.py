"""Vector codes, importance resampling and repeated passages against brute force."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

pytest.importorskip("lightshelf.llm")

from pyspark.sql import functions as F  # noqa: E402

from lightshelf.llm import codebooks, common, repeats, resampling  # noqa: E402

LONG = "the cat sat on the mat and " * 40_000
ODD = [None, "", " ", "a", "É", "a\0b a\0b", "<x> 中文 中文 😀 A1b2", LONG, "same text " * 30, "same text " * 30, "w" * 700]
DOCS = "doc_id long, text string, id long, key string, h long, score double, rank int, label string"


def documents(spark, texts, ids=None):
    return spark.createDataFrame([(i if ids is None else ids[i], t, 1, "k", 2, 0.5, 3, "l") for i, t in enumerate(texts)], DOCS)


# --- 11 ---


def brute_codes(rows, entries, parts, rounds):
    """rows of (id, label, vector), kept ones, in order of id: codes, errors and codebooks by comparing everything."""
    x = np.floor(np.array([r[2] for r in rows], np.float64) * 256).astype(np.int64)
    d = x.shape[1] // parts
    x = x.reshape(len(rows), parts, d)
    books = x[:entries].transpose(1, 0, 2).copy()

    def near():
        gaps = ((x[:, :, None, :] - books[None]) ** 2).sum(3)
        return gaps.argmin(2), gaps.min(2)

    for _ in range(rounds):
        codes, _ = near()
        for p in range(parts):
            for k in range(books.shape[1]):
                own = x[codes[:, p] == k, p]
                if len(own):
                    books[p, k] = [math.floor(int(s) / len(own)) for s in own.sum(0)]
    codes, errors = near()
    return codes, errors.sum(1), books


@pytest.mark.parametrize("scale", [0.01, 1.0, 1000.0])
def test_vector_codes(spark, scale):
    rng = np.random.default_rng(5)
    rows = [(i, None if i % 7 == 0 else i % 3, (rng.normal(size=16) * scale).astype(np.float32).tolist()) for i in range(300)]
    rows += [(300, 1, rows[5][2]), (300, 1, rows[5][2])]  # a row given twice
    odd = [(1000, 1, None), (1001, 1, [None] + [0.0] * 15), (1002, None, [float("nan")] * 16), (-5, 1, [float("inf")] * 16), (1003, 1, [1.0, 2.0]), (1004, 1, [])]
    given = spark.createDataFrame(rows + odd, "vec_id long, label int, embedding array<float>").withColumn("error", F.lit("x")).withColumn("id", F.lit(1)).repartition(5)
    codes, errors, books = brute_codes(rows, 64, 4, 2)
    got = sorted(map(tuple, codebooks.compress(given, 64, 4, 2).select("vec_id", "code", "error", "label_error", "codebooks_sha256").collect()))
    by_label = Counter()
    for r, e in zip(rows, errors.tolist()):
        by_label[r[1]] += e
    digest = hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()
    assert got == sorted((r[0], "".join(f"{c:02x}" for c in code), int(e), by_label[r[1]], digest) for r, code, e in zip(rows, codes, errors))


def test_screening_settles_ties_and_near_ties():
    rng = np.random.default_rng(1)
    for most in (2, 500, 1 << 24):
        x, entries = rng.integers(-most, most, (500, 4)), rng.integers(-most, most, (64, 4))
        entries[40:60] = entries[3] + rng.integers(-1, 2, (20, 4))
        entries[63] = entries[2]
        x[:100] = entries[3] + rng.integers(-2, 3, (100, 4))
        code, gap, again = codebooks.screened(x, entries)
        gaps = ((x[:, None] - entries[None]) ** 2).sum(2)
        assert (code == gaps.argmin(1)).all() and (gap == gaps.min(1)).all() and len(x) <= again < x.shape[0] * 64


def test_vector_codes_small_and_empty(spark, monkeypatch):
    schema = "vec_id long, label string, embedding array<double>"
    assert codebooks.compress(spark.createDataFrame([], schema), 64, 2).count() == 0
    assert codebooks.compress(spark.createDataFrame([(1, "a", None), (2, "b", [float("nan")] * 4)], schema), 64, 2).count() == 0
    monkeypatch.setattr(codebooks, "FEW", 0)  # labels by the salted join
    three = spark.createDataFrame([(None, None, [1.0, 1.0]), (4, None, [0.0, 0.0]), (5, "a", [-1.0, 2.0])], schema)
    assert sorted(tuple(r)[:4] for r in codebooks.compress(three, 64, 2).select("code", "error", "label_error", "vec_id").collect()) == [("0000", 0, 0, 4), ("0101", 0, 0, 5), ("0202", 0, 0, None)]
    with pytest.raises(Exception, match="cannot be cut"):
        codebooks.compress(spark.createDataFrame([(1, "a", [1.0, 2.0, 3.0])], schema), 64, 2)
    books = codebooks.fit(three, 3, 2, 0)
    assert np.abs(codebooks.decode(np.array([[0, 0], [1, 1]]), books) - [[0, 0], [-1, 2]]).max() <= 1 / 512


# --- 12 ---


def brute_features(text):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return w, w + [f"{a} {b}" for a, b in zip(w, w[1:])]


def brute_resample(rows, target, percent, least, buckets, seed):
    place = lambda f: zlib.crc32(f.encode()) % buckets
    s, t = Counter(place(f) for _, x in rows for f in brute_features(x)[1]), Counter(place(f) for x in target for f in brute_features(x)[1])
    n_s, n_t = sum(s.values()), sum(t.values())
    out = []
    for i, x in rows:
        words, feats = brute_features(x)
        gains = [math.floor(1000 * math.log((t[place(f)] + 1) * (n_s + buckets) / ((s[place(f)] + 1) * (n_t + buckets)))) for f in feats]
        weight = sum(gains) // len(feats) if feats else 0
        if i is None:
            out.append([i, len(feats), weight, None, None, False])
            continue
        h = int(hashlib.sha256(f"{seed}:{i}".encode()).hexdigest()[:8], 16)
        out.append([i, len(feats), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, len(words) >= least])
    able = sorted((r for r in out if r[5]), key=lambda r: (-r[3], r[0], r[1]))
    for k, r in enumerate(able[: percent * len(able) // 100]):
        r[4] = k + 1
    return sorted((tuple(r[:5]) for r in out), key=repr)


@pytest.mark.parametrize("block", [1 << 18, 7])
def test_resampling(spark, monkeypatch, block):
    monkeypatch.setattr(resampling, "BLOCK", block)
    rng = random.Random(3)
    texts = [" ".join(rng.choice(["Alpha", "beta", "été", "x" * 80, "9z", "中文"]) for _ in range(rng.randrange(0, 60))) for _ in range(120)]
    odd = [t if t is not LONG else t[: 27 * 300] for t in ODD] if block == 7 else ODD
    rows = list(enumerate(texts + odd)) + [(None, texts[7]), (5, texts[5]), (5, texts[6] + " and more")]
    target = ["beta beta été", None, "", "alpha-9z"]
    got = resampling.resample(documents(spark, [t for _, t in rows], [i for i, _ in rows]).repartition(3), spark.createDataFrame([(t,) for t in target], "text string"), percent=25, least_words=5, buckets=97, seed=7)
    assert sorted(map(tuple, got.select("doc_id", "n_features", "weight", "score", "rank").collect()), key=repr) == brute_resample(rows, target, 25, 5, 97, 7)


def test_resampling_empty(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert resampling.resample(none, none).count() == 0
    one = resampling.resample(documents(spark, ["a b c"]), none).first()
    assert (one.n_features, one.weight, one["rank"]) == (5, math.floor(1000 * math.log(10005 / 2 / 10000)), None)


def test_checksums_of_joined_texts():
    rng = random.Random(1)
    shifts = resampling.Shifts()
    for n in (0, 1, 2, 63, 255, 256, 5000):
        a, b = rng.randbytes(9), rng.randbytes(n)
        moved = shifts.moved(np.array([zlib.crc32(a)], np.uint32), np.array([n]))[0]
        assert int(moved) ^ zlib.crc32(b) == zlib.crc32(a + b)


# --- 13 ---


def brute_repeats(texts, least):
    data = [(t or "").encode() for t in texts]
    seen = Counter(d[p : p + least] for d in data for p in range(len(d) - least + 1))
    out = []
    for d in data:
        gone = bytearray(len(d))
        for p in range(len(d) - least + 1):
            if seen[d[p : p + least]] > 1:
                gone[p : p + least] = b"\1" * least
        spans = len(re.findall(b"\1+", bytes(gone)))
        out.append((len(d), sum(gone), spans, hashlib.sha256(bytes(c for c, g in zip(d, gone) if not g)).hexdigest()))
    return out


def digests(spark, texts, least, **more):
    got = repeats.repeat_digests(documents(spark, texts).repartition(3), least=least, **more)
    return [tuple(r)[1:] for r in sorted(got.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect(), key=lambda r: r[0])]


@pytest.mark.parametrize("group_rows", [1 << 15, 4])
def test_repeats(spark, monkeypatch, group_rows):
    monkeypatch.setattr(repeats, "BLOCK", 300)
    monkeypatch.setattr(repeats, "SORTED_ROWS", 50)
    rng = random.Random(8)
    word = lambda n: "".join(rng.choice("abcdé ") for _ in range(n))
    shared = [word(rng.randrange(10, 90)) for _ in range(6)]
    texts = ["".join(rng.choice([word(rng.randrange(1, 40)), rng.choice(shared)]) for _ in range(rng.randrange(1, 12))) for _ in range(60)]
    base = word(400)  # near copies: one sign changed here and there
    for _ in range(15):
        at = rng.randrange(400)
        texts.append(base[:at] + word(1) + base[at + 1 :])
    line = word(24)  # a line in most texts, shorter than what counts
    texts += [word(20) + line + word(20) for _ in range(40)] + [None, "", "x", "ab" * 100, "z" * 300, texts[3], texts[3], "a\0" * 30, word(30) + shared[0]]
    assert digests(spark, texts, 32, group_rows=group_rows) == brute_repeats(texts, 32)


def test_repeats_of_two_hundred_bytes(spark):
    rng = random.Random(4)
    word = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    p199, p200, p201, tail = word(199), word(200), word(201), word(5000)
    texts = [p199 + "!", "?" + p199 + "#", word(50) + p200 + word(70), word(3) + p200, p201 + p201, tail, "@" + tail[1:], LONG[:3000], word(10_000)]
    assert digests(spark, texts, 200) == brute_repeats(texts, 200)


def test_repeats_odd_rows(spark):
    assert repeats.repeat_digests(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    long = [t if t is not LONG else LONG[:60_000] for t in ODD]
    assert digests(spark, long, 50) == brute_repeats(long, 50)
    # one id with two texts, null ids, and a row given twice
    rows = [(1, "p" * 10 + "0123456789" * 30), (1, "q" * 250 + "r"), (None, "a" * 20), (None, "b" * 210 + "c"), (2, "the same row again " * 20), (2, "the same row again " * 20)]
    got = repeats.repeat_digests(documents(spark, [t for _, t in rows], [i for i, _ in rows]), least=200).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(((i, *r) for (i, _), r in zip(rows, brute_repeats([t for _, t in rows], 200))), key=repr)
    kept = repeats.without_repeats(documents(spark, ["abc" + "0123456789" * 30, "x"])).orderBy("doc_id").collect()
    assert [bytes(r["kept"]) for r in kept] == [b"abc", b"x"] and kept[0]["starts"] == [3] and kept[0]["ends"] == [303]


def test_common_prefix_intervals():
    # suffixes of banana$ in order: $ a$ ana$ anana$ banana$ na$ nana$
    assert sorted(repeats.intervals([0, 1, 3, 0, 0, 2], 1)) == [(1, 3, 1), (2, 3, 3), (5, 6, 2)]
    contexts = ["xxABCDEF", "yxABCDEG", "yxABCDxx", "zzABCDEF"]
    found = {(left, r, tuple(sorted(m.tolist()))) for left, r, m in repeats.maximal_repeats([c[:2][::-1].encode() for c in contexts], [c[2:].encode() for c in contexts], 5, 4)}
    assert found == {(0, 6, (0, 3)), (0, 5, (0, 1, 3)), (1, 5, (0, 1)), (1, 4, (0, 1, 2)), (2, 4, (1, 2))}


def test_stored_tables_are_discarded(spark):
    held = common.stored(spark.range(5))
    common.discard(held)
    with pytest.raises(Exception):
        held.count()
