"""The llm operators on small fixtures, against brute force, exact round trips and held-out accuracy."""

import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest

pytest.importorskip("lightshelf.llm")

from pyspark.sql import functions as F  # noqa: E402

from lightshelf.llm import common, components, html_pages, id_matrices, langid, lp_packing, matroska, ngram_join, pieces, token_counts, tokens, toxicity, vectors  # noqa: E402

SF = "/root/testdata/sf0.001"
JSON, RANKS, MODEL = (tokens.vocabulary_path(n) for n in ("byte_bpe_50k.json", "byte_bpe_50k.tiktoken", "piece_bpe_32k.model"))
DOCS = "doc_id long, text string, lang string, source string, n_chars long, score double, bucket string, n int"
LONG = "the cat sat on the mat and " * 6000


def documents(spark, texts):
    rows = [(i, t, "en", "s", None if t is None else len(t), 0.5, "b", 1) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS)


ODD = [None, "", " ", "   ", "a", "a  b", "x\n\n\n y", LONG, "same text here for all", "same text here for all", "été 中文 😀", "<|endoftext|> end", "!!! ???"]


# --- 1 ---


def test_matroska_round_trip():
    rng = np.random.default_rng(1)
    for n in (0, 1, 575, 576, 577, 5000, 400_000):
        payload = matroska.padded(rng.bytes(n))
        file = matroska.mux_bytes(payload)
        got = matroska.parse(file)
        assert got["error"] is None and b"".join(file[p[2] : p[2] + p[3]] for p in got["packets"]) == payload
        assert [p[1] for p in got["packets"]] == [i * 72_000_000 for i in range(len(payload) // 576)]
        assert all(file[c[2] : c[2] + 4] == bytes.fromhex("1f43b675") for c in got["cues"])
        for cut in (4, len(file) // 2, len(file) - 3):
            assert matroska.parse(file[:cut])["error"]


def test_matroska_lacings_and_unknown_sizes():
    frames = [b"a" * 300, b"b" * 2, b"c" * 1000, b"d" * 7]
    for lacing in (1, 3):
        body = matroska.block(2, -5, frames, lacing, 0)
        group = matroska.element(matroska.BLOCK_GROUP, matroska.element(matroska.BLOCK, body))
        cluster = b"\x1f\x43\xb6\x75\xff" + matroska._uint(matroska.CLUSTER_TIMESTAMP, 100) + group
        tags = matroska.element(matroska.TAGS, b"")
        file = matroska._HEADER + b"\x18\x53\x80\x67\xff" + cluster + tags + cluster
        got = matroska.parse(file)
        assert got["error"] is None and [file[p[2] : p[2] + p[3]] for p in got["packets"]] == frames * 2
        assert got["packets"][0][:2] == (2, 95_000_000)


def test_matroska_columns(spark):
    out = matroska.text_media(documents(spark, ODD)).toPandas().sort_values("doc_id")
    for r, t in zip(out.itertuples(), ODD):
        payload = matroska.padded((t or "").encode())
        assert (r.n_bytes, r.payload_bytes, r.tail_crc32) == (len((t or "").encode()), len(payload), zlib.crc32(payload[-32:]))
    assert out.feature[out.doc_id == 8].item() == out.feature[out.doc_id == 9].item()
    bad = spark.createDataFrame([(1, None), (2, bytearray(b"junk")), (3, bytearray(matroska.mux_bytes(b"x" * 576)))], "k long, media binary")
    assert {r.k: r.error for r in matroska.with_packets(bad, keys=("k",)).collect()} == {1: "empty", 2: "no EBML header", 3: None}
    assert matroska.packet_table(bad, keys=("k",)).count() == 1
    assert matroska.text_media(documents(spark, ODD).where("false")).count() == 0


# --- 2 ---


def test_language_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    out = langid.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").toPandas()
    assert (out.lang == out.lang_pred).mean() > 0.97 and out.score.between(0, 1).all()


def test_language_odd_texts(spark):
    texts = ["the cat and the dog"] * 12 + ["der hund und die katze"] * 12 + [None, "", "123 !!", LONG]
    docs = documents(spark, texts).withColumn("lang", F.when(F.col("doc_id") < 12, "en").when(F.col("doc_id") < 24, "de")).withColumn("lang_pred", F.lit("clash"))
    out = {r.doc_id: (r.lang_pred, r.score) for r in langid.identify(docs).collect()}
    assert out[24] == out[25] == out[26] == ("und", 0.0) and out[27][0] == "en" and out[0][0] == "en" and out[13][0] == "de"
    assert langid.identify(docs.where("false")).count() == 0
    assert {r.lang_pred for r in langid.identify(docs.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


def test_terms_of_long_texts(monkeypatch):
    rng = random.Random(3)
    texts = ["".join(rng.choice("ab É1. \u4e2d") for _ in range(n)) for n in (1, 6, 7, 8, 13, 14, 15, 50, 200)]
    whole = [langid.term_counts(t) for t in texts]
    low = langid.plain_letters(texts[-1])
    assert (low[0], low[-1]) == (32, 32) and not ((low[1:-1][1:] == 32) & (low[1:-1][:-1] == 32)).any()
    for window in (7, 9, 64):
        monkeypatch.setattr(langid, "WINDOW", window)
        for t, (places, counts) in zip(texts, whole):
            got = langid.term_counts(t)
            assert got[0].tolist() == places.tolist() and got[1].tolist() == counts.tolist()


def test_predictions_against_plain_sums():
    """Places, counts, weights and softmax of a small model, with dictionaries."""
    rng = np.random.default_rng(2)
    model = {"classes": ["a", "b", "c"], "weights": rng.normal(size=(1 << langid.BITS, 3)).astype(np.float32), "idf": rng.uniform(1, 3, 1 << langid.BITS).astype(np.float32)}
    for text in ("Das ist ein Haus.", "x", "été 12 été", "a" * 300):
        letters = " " + re.sub(r"[^a-zé]+", " ", text.lower()) + " "
        terms = defaultdict(int)
        for n in (1, 2, 3, 4):
            for i in range(len(letters) - n + 1):
                h = 0
                for c in letters[i : i + n]:
                    h = (h * 0x9E3779B1 + ord(c)) % 2**32
                terms[((h ^ h >> 15) * (0x85EBCA6B + 2 * n) % 2**32) >> 16] += 1
        x = {k: (1 + np.log(v)) * float(model["idf"][k]) for k, v in terms.items()}
        norm = np.sqrt(sum(v * v for v in x.values()))
        z = sum(v / norm * model["weights"][k].astype(float) for k, v in x.items())
        p = np.exp(z - z.max()) / np.exp(z - z.max()).sum()
        lang, score = langid.predict_one(text, model)
        assert lang == "abc"[p.argmax()] and score == pytest.approx(p.max(), abs=1e-5)


def test_regularisation_gives_zero_weights():
    model = langid.FollowTheLeader(2, l1=5.0)
    model.learn(np.array([1, 2]), np.array([0.7, 0.7]), 0)
    assert not model.weights(slice(None)).any()


def test_temperature_softens_wrong_certainty():
    scores, labels = np.array([[9.0, 0.0]] * 10), np.array([0] * 6 + [1] * 4)
    assert langid.temperature(scores, labels) > 3


# --- 3 ---

_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_LOW = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def shingle_set(text):
    w = _WORD.findall((text or "").translate(_LOW))
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute_components(texts, percent=80):
    sets = [shingle_set(t) for t in texts]
    root = list(range(len(sets)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(sets)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= percent * len(sets[i] | sets[j]):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return [len(s) for s in sets], [find(i) for i in range(len(sets))]


def near_copies(seed):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    texts = list(ODD)
    for _ in range(12):
        base = [rng.choice(words) for _ in range(rng.choice([6, 12, 40, 90]))]
        for _ in range(rng.randint(1, 9)):
            copy = list(base)
            for _ in range(rng.randint(0, 3)):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            if rng.random() < 0.3:
                copy += ["tail"] * rng.randint(1, 4)
            texts.append(" ".join(copy).replace("w1 ", "W1\t"))
    boiler = " ".join(rng.choice(words) for _ in range(60))
    texts += [boiler + " " + " ".join(rng.choice(words) for _ in range(50)) for _ in range(6)]
    return texts


@pytest.mark.parametrize("seed,percent", [(1, 80), (2, 60)])
def test_join_against_all_pairs(spark, seed, percent):
    texts = near_copies(seed)
    out = ngram_join.link_components(documents(spark, texts), percent).toPandas().sort_values("doc_id")
    sizes, roots = brute_components(texts, percent)
    assert out.n_shingles.tolist() == sizes and out.component_id.tolist() == roots


def test_join_odd_tables(spark):
    docs = documents(spark, ODD)
    assert ngram_join.link_components(docs.where("false")).count() == 0
    twice = docs.unionByName(docs.withColumn("doc_id", F.lit(None).cast("long")))
    out = ngram_join.link_components(twice).toPandas()
    assert len(out) == 2 * len(ODD) and out.component_id.isna().sum() == len(ODD)
    kept = ngram_join.one_of_each(docs.unionByName(docs.where("doc_id = 4"))).select("doc_id").toPandas().doc_id.tolist()
    assert sorted(kept) == [i for i in range(len(ODD)) if i != 9]


def test_shingles_of_slices():
    texts = pa.array([f"É{'x' * i} Ab\tcd\x0bef gh {i} \x85 z" for i in range(50)], pa.string())
    whole = ngram_join.shingles(common.plain_strings(texts))
    part = ngram_join.shingles(common.plain_strings(texts.slice(20, 10)))
    assert all((a == b).all() for a, b in zip(whole[20:30], part))
    assert [len(s) for s in whole] == [len(shingle_set(t)) for t in texts.to_pylist()]


def test_filters_never_drop_similar_sets():
    rng = np.random.default_rng(3)
    for _ in range(300):
        x = np.unique(rng.integers(0, 2**63, 40).astype(np.uint64))
        y = np.unique(np.concatenate([rng.permutation(x)[: rng.integers(20, 41)], rng.integers(0, 2**63, rng.integers(0, 12)).astype(np.uint64)]))
        both = len(np.intersect1d(x, y))
        links = 100 * both >= 80 * (len(x) + len(y) - both)
        assert ngram_join.similar(x, y, 80) == links
        cx, cy = (np.frombuffer(ngram_join.range_counts(s), "<u2").astype(np.int64)[None] for s in (x, y))
        assert ngram_join.possible(cx, cy, 80)[0] or not links


def test_components_with_parted_labels(spark, monkeypatch):
    monkeypatch.setattr(components, "FEW", 0)
    rng = random.Random(6)
    pairs = [(rng.randint(0, 60), rng.randint(0, 60)) for _ in range(40)] + [(100, i) for i in range(101, 140)]
    root = {x: x for p in pairs for x in p}
    for _ in root:
        for a, b in pairs:
            root[a] = root[b] = min(root[a], root[b])
    got = {r.node: r.component for r in components.components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert all(root[n] == c for n, c in got.items()) and set(got) == {x for a, b in pairs if a != b for x in (a, b)}


def test_components_of_a_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(99, 98)], "a long, b long")
    got = {r.node: r.component for r in components.components(edges).collect()}
    assert all(got[i] == 0 for i in range(41)) and got[99] == 98
    assert components.components(edges.where("false")).count() == 0


# --- 4, 5, 9 ---


def library_ids(texts):
    return [e.ids for e in tokens.library(JSON).encode_batch([t or "" for t in texts], add_special_tokens=False)]


def random_texts(n=3000):
    rng = random.Random(5)
    parts = list(" \n\t  \x1c\x85ab1!,.é中　<|>'s") + ["the ", "ing"]
    return ["".join(rng.choice(parts) for _ in range(rng.randint(0, 40))) for _ in range(n)]


@pytest.mark.parametrize("ranks", [None, RANKS])
def test_ids_equal_the_library(ranks):
    texts = [t or "" for t in ODD] + random_texts()
    ids, offsets = tokens.encode_texts(pa.array(texts, pa.large_string()), JSON, ranks)
    assert all(ids[a:b].tolist() == want for a, b, want in zip(offsets, offsets[1:], library_ids(texts)))


def test_token_counts(spark):
    texts = ODD + random_texts(300) + ["a " * 70_000]
    docs = documents(spark, texts)
    out = token_counts.count_tokens(docs, JSON).toPandas().sort_values("doc_id")
    want = library_ids(texts)
    assert out.n_tokens.tolist() == [len(x) for x in want] and out.n_bytes.tolist() == [len((t or "").encode()) for t in texts]
    assert out.over_limit.tolist() == [len(x) > 512 for x in want]
    assert token_counts.count_tokens(docs.where("false"), JSON).count() == 0
    once = [w for b in token_counts.requests(iter([pa.RecordBatch.from_pydict({"doc_id": [1, 2], "text": ["a b a", "b c"], "part": [0, 0]})]), 3) for row in b.column("words").to_pylist() for w in row]
    assert sorted(once) == [" a", " b", " c", "a", "b"]
    nulls = docs.withColumn("doc_id", F.lit(None).cast("long"))
    assert token_counts.count_tokens(nulls, JSON).where("doc_id is null").count() == len(texts)


def test_token_counts_of_many_batches(spark, monkeypatch):
    monkeypatch.setattr(token_counts, "BUCKET_BYTES", 100)
    texts = random_texts(200) + ["the same words again"] * 50
    docs = documents(spark, texts).withColumn("batch", F.lit("clash")).repartition(6)
    docs = common.stored(docs)
    out = token_counts.count_tokens(docs, JSON).toPandas().sort_values("doc_id")
    assert out.n_tokens.tolist() == [len(x) for x in library_ids(texts)]


def test_packing(spark):
    texts = ODD + random_texts(400)
    docs = documents(spark, texts).unionByName(documents(spark, texts).where("doc_id = 5"))
    out = lp_packing.pack(docs, JSON, RANKS, capacity=64).toPandas()
    want = {i: np.array(x + [0], "<u4") for i, x in enumerate(library_ids(texts))}
    for r in out.itertuples():
        assert zlib.crc32(want[r.doc_id][r.start : r.start + r.length].tobytes()) == r.ids_crc32
    for d, g in out[out.doc_id != 5].groupby("doc_id"):
        g = g.sort_values("piece")
        assert g.piece.tolist() == list(range(len(g))) and g.length.sum() == len(want[d]) and (g.start.to_numpy() == np.r_[0, g.length.cumsum()[:-1]]).all() and (g.length[1:] == 64).all()
    s = out.sort_values(["sequence_id", "offset"])
    assert (s.groupby("sequence_id").length.cumsum() - s.length == s.offset).all() and s.groupby("sequence_id").length.sum().max() <= 64
    assert s.sequence_id.nunique() <= 1.02 * out.length.sum() / 64 + 1
    assert lp_packing.pack(docs.where("false"), JSON).count() == 0


@pytest.mark.parametrize("n", [30, 3000, 60_000])
def test_fillings_use_the_histogram(n):
    h = np.bincount(np.random.default_rng(n).integers(1, 201, n), minlength=201)
    found = lp_packing.fillings(h, 200)
    used = np.zeros_like(h)
    for key, copies in found:
        assert sum(key) <= 200
        for size in key:
            used[size] += copies
    assert (used == h).all()
    assert sum(c for _, c in found) <= -(-int((h * np.arange(201)).sum()) // 200) * 1.01 + 2


def test_program_packs_few_documents():
    docs = pd.read_parquet(f"{SF}/documents.parquet").text
    ids, offsets = tokens.encode_texts(pa.array(docs, pa.large_string()), JSON, RANKS)
    size = np.diff(offsets) + 1
    h = np.bincount((size - 1) % 2048 + 1, minlength=2049)
    h[2048] += ((size - 1) // 2048).sum()
    assert h.sum() < 300
    left = h.copy()
    left[2048] = 0
    _, bound = lp_packing.weighted_fillings(left, 2048)
    before = int(left.sum())
    lp_packing.taken_from_program(left, 2048)
    assert before - left.sum() > before * 2 / 3  # the program gives the fillings of most pieces
    assert sum(c for _, c in lp_packing.fillings(h, 2048)) <= np.ceil(bound) + h[2048] + 1


def fewest(sizes, capacity):
    """The least number of sequences, by trying every set that the largest piece can be in."""
    if not sizes:
        return 0
    first, rest = sizes[0], sizes[1:]
    best = len(sizes)
    for mask in range(1 << len(rest)):
        inside = [x for k, x in enumerate(rest) if mask >> k & 1]
        if first + sum(inside) <= capacity:
            best = min(best, 1 + fewest([x for k, x in enumerate(rest) if not mask >> k & 1], capacity))
    return best


def test_program_against_all_packings():
    rng = np.random.default_rng(12)
    for _ in range(25):
        sizes = sorted(rng.integers(1, 12, rng.integers(1, 8)).tolist(), reverse=True)
        h = np.bincount(sizes, minlength=13)
        least = fewest(sizes, 12)
        left = h.copy()
        left[12] = 0
        assert (lp_packing.weighted_fillings(left, 12)[1] if left.any() else 0) + h[12] <= least + 1e-9
        assert least <= sum(c for _, c in lp_packing.fillings(h, 12)) <= least + 1


def test_packing_null_ids_and_columns(spark):
    docs = documents(spark, ["a b c", None, "a b c"]).withColumn("doc_id", F.lit(None).cast("long")).withColumn("length", F.lit("clash")).withColumn("_rank", F.lit("clash"))
    out = lp_packing.pack(docs, JSON, RANKS, capacity=8).toPandas()
    assert len(out) == 3 and out.doc_id.isna().all() and sorted(out.length) == [1, 4, 4] and out.sequence_id.nunique() == 2


def test_best_fit_decreasing_against_a_list():
    rng = np.random.default_rng(2)
    for _ in range(60):
        sizes = rng.integers(1, 31, rng.integers(0, 60))
        bins = []
        for s in sorted(sizes.tolist(), reverse=True):
            fits = [(b, k) for k, b in enumerate(bins) if b >= s]
            if fits:
                b, k = min(fits)
                bins[k] -= s
            else:
                bins.append(30 - s)
        where, n = id_matrices.best_fit_decreasing(sizes, 30)
        assert n == len(bins) and (not n or np.bincount(where, sizes).max() <= 30)


def test_matrices_are_lossless(spark, tmp_path):
    texts = ODD + random_texts(200)
    packed = id_matrices.matrices(documents(spark, texts), JSON, RANKS, capacity=128)
    id_matrices.write_matrices(packed, str(tmp_path / "m"))
    parts = defaultdict(dict)
    for r in spark.read.parquet(str(tmp_path / "m")).collect():
        ids = np.frombuffer(r.ids, "<u2")
        assert len(ids) == 128 and r.cu_seqlens[-1] == r.n_tokens and r.position_resets == r.cu_seqlens[:-1]
        for d, k, a, b in zip(r.doc_ids, r.pieces, r.cu_seqlens, r.cu_seqlens[1:]):
            parts[d][k] = ids[a:b].tolist()
        assert (id_matrices.position_ids(r.cu_seqlens)[r.position_resets] == 0).all()
    got = {d: [i for k in sorted(p) for i in p[k]] for d, p in parts.items()}
    assert got == {i: x + [0] for i, x in enumerate(library_ids(texts))}


# --- 6 ---


def test_vectors_against_all_pairs(spark):
    rng = np.random.default_rng(4)
    base = rng.normal(size=(40, 16))
    x = [list(map(float, v)) for v in np.concatenate([base, base[:15] + rng.normal(size=(15, 16)) * 0.12, base[:5] * 3, base[:3]]).astype(np.float32)]
    bad = [None, [0.0] * 16, [float("nan")] + [1.0] * 15, [float("inf")] + [1.0] * 15, [None] + [1.0] * 15, []]
    rows = [(i, v, 0) for i, v in enumerate(x + bad)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    out = vectors.near_duplicates(df).toPandas().sort_values("vec_id")
    u = np.array(x)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    near = u @ u.T >= 0.95
    np.fill_diagonal(near, False)
    root = vectors._roots(len(x), *np.nonzero(near))
    assert out.n_links.tolist() == near.sum(1).tolist() + [0] * len(bad)
    assert out.component_id.tolist() == root.tolist() + list(range(len(x), len(rows))) and (out.kept == (out.component_id == out.vec_id)).all()
    assert vectors.near_duplicates(df.where("false")).count() == 0


def test_vectors_without_ids_or_with_repeated_ones(spark):
    near, far = [1.0, 0.0, 0.1], [0.0, 1.0, 0.0]
    rows = [(1, near), (None, near), (4, near), (4, near), (7, [1.0, 0.0, 0.11]), (9, far), (9, [0.0, 0.0, 1.0]), (2, far + [0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("n_links", F.lit("clash")).withColumn("raw", F.lit(0)).withColumn("class", F.lit(0))
    out = sorted((r.vec_id or -1, r.n_links, r.component_id, r.kept) for r in vectors.near_duplicates(df).collect())
    assert out == sorted([(1, 2, 1, True), (-1, 0, None, False), (4, 2, 1, False), (4, 2, 1, False), (7, 2, 1, False), (9, 0, 9, True), (9, 0, 9, True), (2, 0, 2, True)])


@pytest.mark.parametrize("numbers", [64, 256])
def test_strips_against_all_pairs(spark, monkeypatch, numbers):
    monkeypatch.setattr(vectors, "GROUP_NUMBERS", numbers)
    rng = np.random.default_rng(14)
    base = rng.normal(size=(30, 8))
    x = np.concatenate([base + rng.normal(size=(30, 8)) * 0.15 for _ in range(8)]).astype(np.float32)
    df = spark.createDataFrame([(i, list(map(float, v))) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    out = vectors.near_duplicates(df).toPandas().sort_values("vec_id")
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    close = u @ u.T >= 0.95
    np.fill_diagonal(close, False)
    assert out.n_links.tolist() == close.sum(1).tolist() and out.component_id.tolist() == vectors._roots(len(x), *np.nonzero(close)).tolist()


def test_quantisation_bound_holds():
    rng = np.random.default_rng(6)
    u = rng.normal(size=(300, 33))
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    codes, scale, error = vectors.quantised(u)
    approx = (codes.astype(float) @ codes.astype(float).T) * scale[:, None] * scale[None]
    bound = error[:, None] + error[None] + error[:, None] * error[None]
    assert (np.abs(u @ u.T - approx) <= bound + 1e-12).all()
    wide = rng.integers(-127, 128, (5, 3000)).astype(np.int8)
    assert (vectors._code_product(wide, wide) == wide.astype(int) @ wide.astype(int).T).all()


# --- 7 ---


def test_toxicity_held_out(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    out = toxicity.rate_documents(docs, labels).join(labels, "doc_id").where("held_out").toPandas()
    toxic, clean = out[out.toxic == 1], out[out.toxic == 0]
    assert clean.predicted.mean() < 0.02 and toxic.predicted.mean() > 0.6
    ranks = out.score.rank()
    auc = (ranks[out.toxic == 1].sum() - len(toxic) * (len(toxic) + 1) / 2) / (len(toxic) * len(clean))
    assert auc > 0.9


def test_toxicity_odd_texts(spark):
    texts = ["you are a nice person and a friend"] * 30 + ["you are a vilestink person"] * 30 + [None, "", LONG, "vilestinker " * 3]
    docs = documents(spark, texts)
    labels = docs.where("doc_id < 60").select("doc_id", F.lit(1).alias("quality"), (F.col("doc_id") >= 30).cast("int").alias("toxic"))
    out = {r.doc_id: r for r in toxicity.rate_documents(docs, labels).collect()}
    assert len(out) == len(texts) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in out.values())
    assert out[60].score == out[61].score < 0.7 and out[0].score < 0.5 < out[63].score
    assert {r.score for r in toxicity.rate_documents(docs, labels.where("false")).collect()} == {0.0}
    assert toxicity.rate_documents(docs.where("false"), labels).count() == 0


def kneser_ney_ratio(word, toxic, ordinary, everything):
    """Log ratio of a word under two models, by counting strings in lists of words."""
    counts = [defaultdict(int), defaultdict(int)]
    for c, words in zip(counts, (toxic, ordinary)):
        for w in words:
            m = f"\x02{w}\x03"
            for k in range(2, 6):
                for i in range(len(m) - k + 1):
                    c[m[i : i + k]] += 1
    kinds = {f"\x02{w}\x03"[i : i + k] for w in everything for k in (2, 3) for i in range(len(w) + 3 - k)}
    two, three = [g for g in kinds if len(g) == 2], [g for g in kinds if len(g) == 3]

    def shared(g):
        ends = sum(t[1] == g[1] for t in two)
        low = (ends + 0.5) / (len(two) + 0.5 * 4096)
        total = sum(t[1] == g[0] for t in three)
        if not total:
            return low
        return max(sum(t[1:] == g for t in three) - 0.75, 0) / total + min(0.75 * sum(t[0] == g[0] for t in two) / total, 1) * low

    def number(t, c):
        # occurrences at the highest order and at the beginning of words, else distinct characters before
        return c[t] if len(t) == 5 or t[0] == "\x02" else sum(len(x) == len(t) + 1 and x[1:] == t for x in list(c))

    def chance(g, c):
        if len(g) == 2:
            return shared(g)
        after = {t: number(t, c) for t in c if len(t) == len(g) and t[:-1] == g[:-1]}
        total = sum(after.values())
        if not total:
            return chance(g[1:], c)
        return max(after.get(g, 0) - 0.75, 0) / total + min(0.75 * len(after) / total, 1) * chance(g[1:], c)

    m = f"\x02{word}\x03"
    return sum(np.log(chance(m[max(0, i - 4) : i + 1], counts[0]) / chance(m[max(0, i - 4) : i + 1], counts[1])) for i in range(1, len(m)))


def test_entries_against_counted_strings(spark):
    rng = random.Random(8)
    sides = [["".join(rng.choice("abcé") for _ in range(rng.randint(1, 7))) for _ in range(40)] for _ in range(4)]
    rows = spark.createDataFrame([(" ".join(w), i) for i, w in enumerate(sides)], "text string, side int")
    table = toxicity.entries(toxicity.gram_counts(toxicity.word_counts(rows)))
    known = toxicity._small(table, list(toxicity.MODELS), 1 << 30)
    words = sides[0][:5] + sides[3][:5] + ["zebra", "abcabcabc", "a"]
    got = toxicity.word_ratios(words, known)
    for w, row in zip(words, got):
        assert row == pytest.approx([kneser_ney_ratio(w, t, o, sum(sides, [])) for t, o in ((sides[2] + sides[3], sides[0] + sides[1]), (sides[3], sides[1]), (sides[2], sides[0]))], abs=1e-4)


def test_toxicity_ways_and_rows(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "PART", 500)
    texts = [None, "", "vilestink you", "vilestink you", "a nice friend " * 200, "x" * 700 + " vilestink"]
    train = documents(spark, ["you are a nice person and a friend"] * 20 + ["you are a vilestink person"] * 20)
    model = toxicity.fit(train, train.select("doc_id", (F.col("doc_id") >= 20).cast("int").alias("toxic")))
    docs = documents(spark, texts).withColumn("_full0", F.lit("clash")).withColumn("score", F.lit("clash")).withColumn("doc_id", F.when(F.col("doc_id") != 2, F.col("doc_id")))
    few = toxicity.score(docs, model).toPandas()
    many = toxicity.score(docs, model | {"most_bytes": 0}).toPandas()
    assert few.columns.tolist() == many.columns.tolist() == [c for c in docs.columns if c != "score"] + ["score", "predicted"]
    assert sorted(few.score) == sorted(many.score) and len(few) == len(texts) and (few["_full0"] == "clash").all()
    by = dict(zip(few.text, few.score))
    assert by["vilestink you"] > by[texts[4]]
    monkeypatch.setattr(toxicity, "PART", 1 << 21)
    assert sorted(toxicity.score(docs, model).toPandas().score) == sorted(few.score)


# --- 8 ---

PAGE = """<!DOCTYPE html><html><head><title>T &amp; t</title><style>p{}</style><script>var t="</p>";</script></head><body><nav><ul><li><a href="/a">Menu</a></li></ul></nav>
<!-- c --><div class="ad">Buy now</div><article><h1>Head&amp;line</h1><p><b>One</b> two&nbsp;three
four.<br><p>Five <aside>side note</aside> six.</p><form>Mail <input></form><p>Seven.</p></article><section class="comments"><p>Nice one!</p></section><footer>&copy; x</footer>"""


def test_main_text():
    assert html_pages.main_text(PAGE) == "Head&line One two three four. Five six. Seven."
    for marked in html_pages.LABELLED:
        main = " ".join(re.findall(r"\[\[(.*?)\]\]", marked))
        assert html_pages.main_text(re.sub(r"\[\[|\]\]", "", marked)) == " ".join(re.sub(r"<[^>]+>", lambda m: "" if re.match(r"</?(b|i|a)>", m[0]) else " ", main).split())


STORY = "<h1>The old mill</h1><p>It stood by the river for many years.</p><p>Now it is gone.</p>"
STORY_TEXT = "The old mill It stood by the river for many years. Now it is gone."


@pytest.mark.parametrize(
    "around",
    [
        '<div style="overflow:hidden">{}</div>', '<div data-id="share">{}</div>', '<div class="content has-sidebar">{}</div>', '<article class="no-ads">{}</article>', "<div>{}</div>", "<main>{}</main>", "{}",
        '<div class="page share"><article>{}</article></div>', "<table><tr><td><article>{}</article></td></tr></table>", "<div class=ad><article>{}</article>", '<body class="menu"><nav><a>One</a></nav><div>{}</div>',
    ],
)
def test_main_text_whatever_holds_it(around):
    page = f'<nav><ul><li><a>Start</a><li><a>More</a></ul></nav>{around.format(STORY)}<div class="comments"><p>I remember it well and miss it.</p></div><div hidden><p>not shown at all</p></div><footer><p>A small paper</p></footer>'
    assert html_pages.main_text(page) == STORY_TEXT


def test_weights_decide():
    flat = dict.fromkeys(html_pages.WEIGHTS, 0.0) | {"word": 1.0}
    assert "Menu" in html_pages.main_text(PAGE, flat) and "Nice one!" in html_pages.main_text(PAGE, flat)
    assert html_pages.main_text(PAGE, html_pages.WEIGHTS | {"word": -100.0}) == ""
    assert html_pages.main_text(PAGE, html_pages.WEIGHTS | {"flow": -40.0}) != html_pages.main_text(PAGE)


def test_region_against_all_runs_of_pages():
    rng = random.Random(4)
    parts = ["<p>", "</p>", "<div>", "</div>", "<nav>", "</nav>", "<a>", "</a>", "one two", "three", "<aside>", "</aside>", "<div class='ad'>", "<article>", "</article>", "<script>x</script>"]
    for _ in range(300):
        scores, each = html_pages.token_scores(html_pages.Page("".join(rng.choice(parts) + " " for _ in range(rng.randint(0, 25)))), html_pages.WEIGHTS)
        a, b = html_pages.best_run(scores)
        most = max([sum(scores[i : j + 1]) for i in range(len(scores)) for j in range(i, len(scores))] + [0])
        assert sum(scores[a : b + 1]) == pytest.approx(most) and all(x >= 0 for x in each)


def test_deep_and_broken_pages():
    deep = "<div>" * 30_000 + STORY + "</div>" * 30_000
    assert html_pages.main_text(deep) == STORY_TEXT
    assert html_pages.main_text("<p " * 20_000) == "<p " * 19_999 + "<p" and html_pages.main_text("<p>x</p><script>y > z") == html_pages.main_text("<p>x</p><!-- y > z") == "x"
    assert html_pages.main_text("< p > a < b & c &lt; d") == "< p > a < b & c < d"


def test_best_run_against_all_runs():
    rng = random.Random(1)
    for _ in range(200):
        s = [rng.uniform(-1, 1) for _ in range(rng.randint(0, 12))]
        a, b = html_pages.best_run(s)
        most = max([sum(s[i : j + 1]) for i in range(len(s)) for j in range(i, len(s))] + [0])
        assert sum(s[a : b + 1]) == pytest.approx(most)


def test_extract_table(spark):
    df = spark.createDataFrame([(1, "u", None), (2, "u", ""), (3, "u", "<p>only <b"), (4, "u", PAGE), (5, "u", "plain words"), (6, "u", "<script>x"), (7, None, "<p>" + "word " * 50_000)], "page_id long, url string, html string").withColumn("text", F.lit("clash"))
    out = {r.page_id: (r.text, r.n_chars) for r in html_pages.extract(df).collect()}
    assert out[1] == out[2] == out[6] == ("", 0) and out[5] == ("plain words", 11) and out[4][1] == len(out[4][0]) and out[7][1] == 249_999
    assert html_pages.extract(df.where("false")).count() == 0


def test_article_text_of_the_pages():
    pages = pd.read_parquet("/root/testdata/sf0.01/pages.parquet")
    import html

    for source in pages.html:
        article = re.search(r"<article>(.*?)</article>", source, re.S)[1]
        want = " ".join(html.unescape(re.sub(r"<[^>]*>", lambda m: "" if m[0] in ("<b>", "</b>") else " ", article)).split())
        assert html_pages.main_text(source) == want


# --- 10 ---


def test_pieces_equal_the_library(spark):
    import sentencepiece

    lib = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    v = pieces.vocabulary(MODEL, "bpe")
    texts = [t or "" for t in ODD] + [" lead", "▁ ▁x", "a   b ", "ﬁ １２"] + random_texts()
    ids, offsets = pieces.encode_texts(pa.array(texts, pa.large_string()), v)
    for t, a, b in zip(texts, offsets, offsets[1:]):
        want = lib.encode(t)
        assert ids[a:b].tolist() == want and pieces.decode(want, v) == lib.decode(want)
    out = pieces.encode(documents(spark, ODD), MODEL)
    assert out.where("not round_trip").count() == 0
    assert {r.doc_id: r.decoded for r in pieces.decoded(out, MODEL).collect()} == {i: t or "" for i, t in enumerate(ODD)}
    assert pieces.encode(documents(spark, ODD).where("false"), MODEL).count() == 0


def test_shared_prefix_viterbi_against_all_segmentations():
    rng = random.Random(9)
    chars = "▁abc"
    for _ in range(30):
        vocab = {c: rng.uniform(-9, -4) for c in chars} | {"".join(rng.choice(chars) for _ in range(rng.randint(2, 4))): rng.uniform(-9, -1) for _ in range(15)}
        v = pieces.Vocabulary([(p, s, i) for i, (p, s) in enumerate(vocab.items(), 1)], {}, "unigram")
        words = sorted({"▁" + "".join(rng.choice("abc") for _ in range(rng.randint(0, 6))) for _ in range(25)})

        def best(w):
            return max((vocab[w[:k]] + best(w[k:]) for k in range(1, len(w) + 1) if w[:k] in vocab), default=-1e9) if w else 0.0

        for w, got in zip(words, pieces.encode_sorted(words, v)):
            assert "".join(v.text[i] for i in got) == w and sum(v.score[i] for i in got) == pytest.approx(best(w))


# --- the pipeline ---


def test_pipeline(spark):
    import corpus_pipeline

    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "toxicity", "ngram_join", "lp_packing"]
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    texts = [r.text for r in docs.orderBy("doc_id").collect()]
    ids = [r.doc_id for r in docs.orderBy("doc_id").collect()]
    for stage in (corpus_pipeline.known_language, corpus_pipeline.not_toxic):
        kept = stage(spark, docs, SF)
        assert kept.columns == docs.columns and 0.7 * len(ids) < kept.count() <= len(ids)
    one = corpus_pipeline.one_of_each_group(spark, docs, SF)
    _, roots = brute_components(texts)
    assert one.columns == docs.columns and sorted(r.doc_id for r in one.collect()) == sorted({ids[k] for k in roots})
    assert corpus_pipeline.run(spark, SF).count() > 0


# --- rows of every kind, operator by operator ---


def odd_documents(spark):
    """Documents with nulls, repeated rows and ids, ties, a very long text, and columns that operators use themselves."""
    docs = documents(spark, ODD + ["the cat and the dog", "the cat and the dog"])
    docs = docs.unionByName(docs.where("doc_id in (4, 8)")).unionByName(docs.where("doc_id = 8").withColumn("doc_id", F.lit(None).cast("long")))
    names = ["_lang", "_sure", "_rate", "_toxic", "_text", "_full0", "score", "predicted", "held_out", "batch", "part", "bucket_", "length", "raw"]
    return docs.drop("score").select("*", *[F.lit("clash").alias(c) for c in names])


def test_pipeline_stages_on_odd_rows(spark):
    import corpus_pipeline

    docs = odd_documents(spark)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, docs, SF)
        assert kept.columns == docs.columns, name
        rows = kept.collect()
        assert all(r["_rate"] == r["_toxic"] == r["score"] == r["_lang"] == "clash" for r in rows), name
        assert stage(spark, docs.where("false"), SF).count() == 0, name
    one = corpus_pipeline.one_of_each_group(spark, docs, SF)
    assert sorted(r.doc_id for r in one.where("doc_id is not null").collect()) == [i for i in range(len(ODD) + 2) if i not in (9, len(ODD) + 1)] and one.where("doc_id is null").count() == 1
    packed = corpus_pipeline.packed(spark, docs, SF)
    assert packed.groupBy("doc_id").count().where("doc_id = 8").first()[1] == 2 and packed.where("doc_id is null").count() == 1
    assert corpus_pipeline.packed(spark, docs.where("false"), SF).count() == 0


def test_language_stage_against_single_predictions(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = langid.fit(docs, ~langid.held_out())
    guess = {r.doc_id: langid.predict_one(r.text, model) for r in docs.collect()}
    want = sorted(d for d, (lang, score) in guess.items() if lang != "und" and score >= corpus_pipeline.LEAST_LANGUAGE_SCORE)
    assert sorted(r.doc_id for r in corpus_pipeline.known_language(spark, docs, SF).collect()) == want


@pytest.mark.parametrize("name", ["matroska", "langid", "tokens", "toxicity", "ids", "pieces"])
def test_operators_on_odd_rows(spark, name):
    docs = odd_documents(spark)
    run = {
        "matroska": matroska.text_media, "langid": langid.identify, "tokens": lambda d: token_counts.count_tokens(d, JSON), "pieces": lambda d: pieces.encode(d, MODEL),
        "toxicity": lambda d: toxicity.rate_documents(d, spark.read.parquet(f"{SF}/labels.parquet")), "ids": lambda d: id_matrices.matrices(d, JSON, RANKS).select(F.explode("doc_ids").alias("doc_id")),
    }[name]
    rows = run(docs).select("doc_id").collect()
    wide = 1 if name != "ids" else None
    got = sorted((-1 if r.doc_id is None else r.doc_id) for r in rows)
    want = sorted((-1 if r.doc_id is None else r.doc_id) for r in docs.select("doc_id").collect())
    assert got == want if wide else set(got) == set(want)
    assert run(docs.where("false")).count() == 0


def test_ids_beyond_the_vocabulary(spark):
    with pytest.raises(Exception, match="beyond a vocabulary"):
        id_matrices.matrices(documents(spark, ["some words"]), JSON, RANKS, vocabulary=10).collect()


def test_matroska_bytes_written_by_hand():
    """A file put together byte by byte: EBML head, a segment and a cluster of unknown size, a two-frame EBML lacing and a plain block."""
    head = bytes.fromhex("1a45dfa3" "8b" "4286" "81" "01" "4282" "84" "7765626d")
    info = bytes.fromhex("1549a966" "87" "2ad7b1" "83" "0f4240")
    tracks = bytes.fromhex("1654ae6b" "8e" "ae" "8c" "d7" "81" "05" "83" "81" "02" "86" "84" "415f5043")
    laced = bytes.fromhex("a3" "8a" "85" "0003" "86" "01" "82") + b"aabbb"
    plain = bytes.fromhex("a3" "86" "85" "fffe" "80") + b"zz"
    cluster = bytes.fromhex("1f43b675" "01ffffffffffffff" "e7" "81" "0a") + laced[:1] + bytes([0x80 | (len(laced) - 2)]) + laced[2:] + plain
    file = head + bytes.fromhex("18538067" "01ffffffffffffff") + info + tracks + cluster
    got = matroska.parse(file)
    assert got["error"] is None
    assert [(p[0], p[1], file[p[2] : p[2] + p[3]]) for p in got["packets"]] == [(5, 13_000_000, b"aa"), (5, 13_000_000, b"bbb"), (5, 8_000_000, b"zz")]


def test_kind_of_the_model_file():
    with open(MODEL, "rb") as f:
        raw = f.read()
    assert pieces.model_kind(raw) == "bpe" and pieces.vocabulary(MODEL).kind == "bpe"
    assert pieces.model_kind(b"\x12\x02\x18\x01") == pieces.model_kind(b"") == "unigram"
    with pytest.raises(ValueError):
        pieces.model_kind(b"\x12\x02\x18\x03")


def test_pieces_of_one_long_word(spark):
    import sentencepiece

    lib = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    text = "".join(random.Random(1).choice("abcde") for _ in range(20_000))
    out = pieces.encode(documents(spark, [text, text, "aaaa " * 3000]), MODEL).orderBy("doc_id").collect()
    assert out[0].ids == out[1].ids == lib.encode(text) and out[2].ids == lib.encode("aaaa " * 3000)
