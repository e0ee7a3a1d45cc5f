"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

Features: n-grams of 1 to 4 characters of the lower-cased text, runs of other
characters than letters read as one space, hashed to 2^16 places; sublinear
term frequency times inverse document frequency, scaled to unit length.
Document frequencies cover every document that may be learned from.  Weights
are trained by follow-the-regularised-leader with elastic-net penalties on a
sample of at most `per_class` labelled documents of each language, chosen by a
hash of the id; a fifth of the sample is kept aside and sets the temperature
by which scores are calibrated.

Predictions depend on the text alone.  Texts without a letter, and null ones,
get `und` with score 0.  Ties between languages go to the first by name.  Each
row gives one row, repeated ones and those with a null id (never held out) as
well.  N-grams of very long texts are counted window by window.  A table without
labelled documents gives `und` for all, an empty one nothing.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lightshelf.llm.common import LETTER, fresh, give_back, quoted, schema_of, slices

BITS = 16
SIZES = (1, 2, 3, 4)
#: Labelled documents of one language that training reads at most.
PER_CLASS = 1500


def _codes() -> np.ndarray:
    """For each character below 2^16: its letter in lower case, or a space."""
    table = np.full(1 << 16, 32, np.uint32)
    for c in range(1 << 16):
        x = chr(c)
        if not 0xD800 <= c < 0xE000 and x.isalpha():
            low = x.lower()
            table[c] = ord(low) if len(low) == 1 else c
    return table


CODES = _codes()


#: N-grams of long texts are counted for this many places at a time.
WINDOW = 1 << 20


def plain_letters(text: str) -> np.ndarray:
    """Code points in lower case, runs of other characters than letters as one space, a space at both ends."""
    parts = [np.array([32], np.uint32)]
    for a in range(0, len(text), WINDOW):
        points = np.frombuffer(text[a : a + WINDOW].encode("utf-32-le", "replace"), np.uint32)
        low = np.where(points < 1 << 16, CODES[np.minimum(points, (1 << 16) - 1)], points).astype(np.uint32)
        keep = np.ones(len(low), bool)
        keep[1:] = (low[1:] != 32) | (low[:-1] != 32)
        # a run of spaces may reach over the cut
        keep[0] = low[0] != 32 or not a or parts[-1][-1] != 32
        if keep.any():
            parts.append(low[keep])
    parts.append(np.array([32], np.uint32))
    return np.concatenate(parts)


def ngram_places(low: np.ndarray) -> np.ndarray:
    """Hashed places of all n-grams of plain letters, in order of size and position."""
    parts, rolled = [], np.zeros(len(low), np.uint32)
    for n in SIZES:
        m = len(low) - n + 1
        if m <= 0:
            break
        rolled = rolled[:m] * np.uint32(0x9E3779B1) + low[n - 1 :]
        mixed = (rolled ^ rolled >> np.uint32(15)) * np.uint32(0x85EBCA6B + 2 * n)
        parts.append(mixed >> np.uint32(32 - BITS))
    return np.concatenate(parts)


def term_counts(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Places of the text's n-grams and how often each is there."""
    low = plain_letters(text)
    if len(low) <= WINDOW:
        counts = np.bincount(ngram_places(low), minlength=1 << BITS)
    else:
        counts = np.zeros(1 << BITS, np.int64)
        for a in range(0, len(low), WINDOW):
            counts += np.bincount(ngram_places(low[a : a + WINDOW]), minlength=1 << BITS)
            # n-grams that begin before the next cut and end behind it
            for n in SIZES[1:]:
                edge = low[max(0, a + WINDOW - n + 1) : a + WINDOW + n - 1] if a + WINDOW < len(low) else low[:0]
                if len(edge) >= n:
                    own = ngram_places(edge)
                    before = sum(len(edge) - k + 1 for k in SIZES if k < n)
                    counts += np.bincount(own[before : before + len(edge) - n + 1], minlength=1 << BITS)
    places = np.flatnonzero(counts)
    return places, counts[places]


def has_letter(text: str | None) -> bool:
    return bool(text) and LETTER.search(text) is not None


def document_frequencies(docs: DataFrame) -> tuple[np.ndarray, int]:
    """How many texts with letters hold each place, over all of `docs`, and how many those are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros(1 << BITS, np.int64), 0
        seen = np.zeros(1 << BITS, bool)
        for batch in slices(batches, "text"):
            for text in batch.column("text").to_pylist():
                if has_letter(text):
                    seen[:] = False
                    seen[term_counts(text)[0]] = True
                    total += seen
                    n += 1
        places = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(np.r_[-1, places]), pa.array(np.r_[n, total[places]])], ["place", "n"])

    # at most 2^16 rows, whatever the corpus
    rows = docs.select("text").mapInArrow(run, "place bigint, n bigint").groupBy("place").agg(F.sum("n").alias("n")).toPandas()
    counts = np.zeros(1 << BITS, np.int64)
    n = int(rows.n[rows.place == -1].sum())
    rows = rows[rows.place >= 0]
    counts[rows.place.to_numpy()] = rows.n.to_numpy()
    return counts, n


def vector(text: str, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    places, counts = term_counts(text)
    x = (1 + np.log(counts)) * idf[places]
    return places, x / max(1e-12, math.sqrt(float(x @ x)))


class FollowTheLeader:
    """Per-coordinate FTRL for multinomial logistic regression: `l1` keeps weights at zero, `l2` shrinks them."""

    def __init__(self, n_classes: int, alpha: float = 2.0, beta: float = 1.0, l1: float = 0.02, l2: float = 0.002) -> None:
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2
        self.z = np.zeros((1 << BITS, n_classes))
        self.n = np.zeros((1 << BITS, n_classes))

    def weights(self, places: np.ndarray | slice) -> np.ndarray:
        z = self.z[places]
        shrunk = np.sign(z) * np.maximum(np.abs(z) - self.l1, 0)
        return -shrunk / ((self.beta + np.sqrt(self.n[places])) / self.alpha + self.l2)

    def learn(self, places: np.ndarray, x: np.ndarray, label: int) -> None:
        w = self.weights(places)
        p = softmax(x @ w)
        p[label] -= 1
        g = x[:, None] * p
        n = self.n[places]
        square = g * g
        self.z[places] += g - (np.sqrt(n + square) - np.sqrt(n)) / self.alpha * w
        self.n[places] = n + square


def softmax(scores: np.ndarray) -> np.ndarray:
    e = np.exp(scores - scores.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def temperature(scores: np.ndarray, labels: np.ndarray) -> float:
    """Temperature with the least log loss on scores kept aside, by golden sections of its logarithm in [1/20, 20]."""
    if not len(labels):
        return 1.0

    # targets short of certainty, as n cases without an error say no more than n/(n+2)
    n, k = scores.shape
    target = np.full((n, k), 1 / (n + 2) / max(1, k - 1))
    target[np.arange(n), labels] = 1 - 1 / (n + 2)

    def loss(t: float) -> float:
        return -float((target * np.log(softmax(scores / math.exp(t)) + 1e-300)).sum(axis=1).mean())

    a, b, ratio = -math.log(20), math.log(20), (math.sqrt(5) - 1) / 2
    for _ in range(40):
        c, d = b - ratio * (b - a), a + ratio * (b - a)
        a, b = (a, d) if loss(c) <= loss(d) else (c, b)
    return math.exp((a + b) / 2)


def train(sample: pd.DataFrame, idf: np.ndarray, epochs: int = 3) -> dict:
    """Model of the labelled sample (text, lang, and `aside` for rows that calibrate)."""
    classes = sorted(sample.lang.unique())
    number = {c: i for i, c in enumerate(classes)}
    rows = []
    for t, c, a in zip(sample.text, sample.lang, sample.aside):
        places, x = vector(t, idf)
        rows.append((places.astype(np.uint16), x.astype(np.float32), number[c], bool(a)))  # 6 bytes a feature
    model = FollowTheLeader(len(classes))
    learn = [r for r in rows if not r[3]] or rows
    for epoch in range(epochs):
        for i in np.random.default_rng(epoch).permutation(len(learn)).tolist():
            model.learn(*learn[i][:3])
    weights = model.weights(slice(None))
    aside = [r for r in rows if r[3]]
    scores = np.array([x @ weights[places] for places, x, _, _ in aside]).reshape(len(aside), len(classes))
    t = temperature(scores, np.array([r[2] for r in aside], np.int64))
    return {"classes": classes, "weights": (weights / t).astype(np.float32), "idf": idf.astype(np.float32)}


def fit(docs: DataFrame, learnable: Column, text: str = "text", lang: str = "lang", id_col: str = "doc_id", per_class: int = PER_CLASS) -> dict | None:
    """Model from the rows of `docs` where `learnable` holds: frequencies from all of them, weights from a bounded sample."""
    rows = docs.where(learnable).select(F.col(id_col).cast("string").alias("id"), F.col(text).alias("text"), F.col(lang).alias("lang"))
    counts, n = document_frequencies(rows)
    order = F.xxhash64("id", F.lit(17))
    labelled = rows.where("lang is not null and text is not null and text <> ''")
    # a hash threshold for each language, so that no task sorts the whole of one; then the first by hash
    # (languages are as few as the model's columns)
    shares = [(r.lang, min(1.0, (per_class * 1.25 + 50) / r.n)) for r in labelled.groupBy("lang").agg(F.count("*").alias("n")).collect()]
    if not shares:
        return None
    share = F.element_at(F.create_map(*[F.lit(x) for pair in shares for x in pair]), F.col("lang"))
    unit = order.bitwiseAND(F.lit((1 << 40) - 1)) / F.lit(float(1 << 40))
    near = labelled.withColumn("u", unit).where(F.col("u") < share)
    sample = near.select("text", "lang", "u").toPandas()
    sample = sample.sort_values(["lang", "u", "text"]).groupby("lang").head(per_class)
    sample = sample[[has_letter(t) for t in sample.text]]
    if not len(sample):
        return None
    sample["aside"] = np.arange(len(sample)) % 5 == 4
    idf = np.log((1 + n) / (1 + counts)) + 1
    model = train(sample.reset_index(drop=True), idf)
    del sample, near, labelled, rows
    give_back()
    return model


def predict_one(text: str | None, model: dict | None) -> tuple[str, float]:
    if model is None or not has_letter(text):
        return "und", 0.0
    places, x = vector(text, model["idf"])
    p = softmax((x @ model["weights"][places]).astype(np.float64))
    i = int(p.argmax())
    return model["classes"][i], float(p[i])


def predict(docs: DataFrame, model: dict | None, text: str = "text", out: tuple[str, str] = ("lang_pred", "score"), keep: list[str] | None = None) -> DataFrame:
    """The columns `keep` of `docs` (all, if not given) with the predicted language and its score, as the columns named in `out` (which they replace)."""
    held = docs.sparkSession.sparkContext.broadcast(model)  # of fixed size: 2^16 places times languages
    keep = [c for c in (docs.columns if keep is None else keep) if c not in out]
    asked = text if text in keep else fresh("_text", keep)
    read = docs.select(*[F.col(quoted(c)) for c in keep], *([] if text in keep else [F.col(quoted(text)).alias(asked)]))

    def guess(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, asked):
            got = [predict_one(x.as_py(), held.value) for x in batch.column(asked)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64())], [*keep, *out])

    return read.mapInArrow(guess, f"{schema_of(docs, keep)}{quoted(out[0])} string, {quoted(out[1])} double")


def held_out(id_col: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def identify(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every document."""
    model = fit(docs, ~held_out())
    return predict(docs.select("doc_id", held_out().alias("held_out"), "text"), model, keep=["doc_id", "held_out"])
