"""Toxicity: class-conditional Kneser-Ney models of words, compared passage by passage.

Two interpolated Kneser-Ney models over the characters of words, one for toxic
and one for ordinary labelled documents, give each word a log-likelihood ratio.
The highest order counts occurrences, all lower ones the distinct characters that
stand before an n-gram (continuation counts): per class down to the third order, and of
both classes together at the lowest two, so that expressions that are rare in both
differ by their known parts alone.  A document is compared as a whole and by its
passages: ratios are divided by the number of words, over the whole text and
over the best window of 1, 3 and 10 words; a logistic regression on these
length-normalised ratios gives the score.

1. Words per class are counted over all labelled rows, then the n-grams of the
   distinct words.  Counts are a table keyed by the 64-bit hash of the n-gram and
   grow with the corpus; nothing is cut to a fixed number of places.
2. Joins of the n-grams with their contexts and their shorter n-grams, order by
   order, give two kinds of entries: the log ratio of each n-gram that was seen,
   and the log ratio of the back-off weights of each context.  An n-gram has at
   most as many partners in such a join as there are characters.
3. A document's words need the entries of their n-grams.  If the measured size of
   all entries is at most `MODEL_BYTES`, they are sent to all tasks; if it is
   larger, the entries that a batch of documents needs are joined to the batch.
   Both ways give the same scores.
4. The regression is fitted on at most `FIT_ROWS` labelled rows of each class,
   each scored by class counts of the half of the labelled rows that lacks it (the
   shared counts know no labels and are those of all).

Scores depend on the text alone; null and empty texts score as texts without any
evidence.  Rows that repeat are scored each, also those with a null id.  Very
long texts are read in parts of words.  A table without labels of both classes
scores 0 throughout.
"""

from __future__ import annotations

import functools
import math
import re
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lightshelf.llm.common import fresh, maybe_among, plain_strings, quoted, schema_of, slices, stored

ORDERS = 5
#: Orders up to this one are continuation counts of both classes together.
SHARED = 2
#: Distinct words whose n-grams are gathered at once.
TOGETHER = 80_000
#: Largest measured size of the entries that are sent to all tasks.
MODEL_BYTES = 64 << 20
DISCOUNT = 0.75
#: Longer words are read in parts of this many characters.
LONGEST = 40
FIT_ROWS = 4000
WINDOWS = (1, 3, 10)
SPLIT = r"[\s\x{85}\x{A0}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+"
#: The same white space for a text that is cut before it is split.
_SPACE = re.compile("[\t\n\f\r \x85\xa0\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")


def words_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """Codes of the words of all texts, the texts' offsets, and the distinct words (lower case, without marks at the ends)."""
    split = pc.split_pattern_regex(pc.utf8_lower(texts), SPLIT) if len(texts) else pa.array([], pa.list_(pa.string()))
    offsets = np.asarray(split.offsets, np.int64)
    encoded = split.flatten().dictionary_encode()
    raw = encoded.dictionary
    trimmed = pc.utf8_trim(raw, "!\"#$%&'()*+,-./:;<=>?@[]^_`{|}~«»“”‘’…¿¡")
    again = trimmed.dictionary_encode()
    codes = again.indices.to_numpy(zero_copy_only=False).astype(np.int64)[encoded.indices.to_numpy(zero_copy_only=False)]
    return codes, offsets - offsets[0], again.dictionary.to_pylist()


def _points(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of words with a mark at both ends, one after the other, and the number of each."""
    joined = "".join(["\x02" + w + "\x03" for w in words])
    return np.frombuffer(joined.encode("utf-32-le", "replace"), np.uint32), np.array([len(w) + 2 for w in words], np.int64)


def _hashes(points: np.ndarray, within: np.ndarray) -> list[np.ndarray]:
    """For each order k the hash of the k characters that end at each place (valid where within >= k - 1), as 64 bits."""
    out = [points.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)]
    for k in range(2, ORDERS + 1):
        before = np.zeros(len(points), np.uint64)
        before[1:] = out[-1][:-1]  # of the k - 1 characters that end one before
        mixed = (before ^ before >> np.uint64(29)) * np.uint64(0xBF58476D1CE4E5B9)
        out.append((mixed + points.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15 + 2 * k & (1 << 64) - 1)) * np.uint64(0x94D049BB133111EB))
    return out


def _within(lengths: np.ndarray) -> np.ndarray:
    """Place of each character in its word."""
    return np.arange(int(lengths.sum())) - np.repeat(np.cumsum(lengths) - lengths, lengths)


def word_counts(rows: DataFrame) -> DataFrame:
    """word and its counts `n0`..`n3` over `rows` (text, side) for side = 0..3, gathered by batch before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            codes, offsets, names = words_of(plain_strings(batch.column("text")))
            side = np.repeat(batch.column("side").to_numpy().astype(np.int64), np.diff(offsets))
            n = np.bincount(codes * 4 + side, minlength=4 * len(names)).reshape(-1, 4)
            keep = np.array([0 < len(w) <= LONGEST for w in names], bool) if names else np.zeros(0, bool)
            parts = [pa.array([w for w, k in zip(names, keep) if k], pa.string()), *(pa.array(n[keep, i]) for i in range(4))]
            yield pa.RecordBatch.from_arrays(parts, ["word", "n0", "n1", "n2", "n3"])
            long = [(w, n[i]) for i, w in enumerate(names) if len(w) > LONGEST]
            if long:
                cut = [(w[k : k + LONGEST], x) for w, x in long for k in range(0, len(w), LONGEST)]
                yield pa.RecordBatch.from_arrays([pa.array([w for w, _ in cut], pa.string()), *(pa.array(np.array([x[i] for _, x in cut], np.int64)) for i in range(4))], ["word", "n0", "n1", "n2", "n3"])

    return rows.select("text", "side").mapInArrow(run, "word string, n0 bigint, n1 bigint, n2 bigint, n3 bigint").groupBy("word").agg(*[F.sum(f"n{i}").alias(f"n{i}") for i in range(4)])


NS = ["n0", "n1", "n2", "n3"]
#: Sides (2 * toxic + fold) that the toxic and the ordinary model count: of all rows, and without the rows of a fold.
MODELS = {"full": ((2, 3), (0, 1)), "without0": ((3,), (1,)), "without1": ((2,), (0,))}


def _gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[str], np.ndarray]]:
    names, counts = [], []
    for batch in batches:
        names += batch.column("word").to_pylist()
        counts.append(np.stack([batch.column(c).to_numpy() for c in NS], axis=1))
        if len(names) >= TOGETHER:
            yield names, np.concatenate(counts)
            names, counts = [], []
    if names:
        yield names, np.concatenate(counts)


def gram_counts(words: DataFrame) -> DataFrame:
    """k, gram, context, shorter, middle (hashes) and the counts `n0`..`n3` of all n-grams of 2 to ORDERS characters."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for names, n in _gathered(batches):
            points, lengths = _points(names)
            within, weight = _within(lengths), np.repeat(n, lengths, axis=0)
            hashes = _hashes(points, within)
            for k in range(2, ORDERS + 1):
                ok = np.flatnonzero(within >= k - 1)
                h, first, back = np.unique(hashes[k - 1][ok], return_index=True, return_inverse=True)
                at = ok[first]
                total = [np.bincount(back, weight[ok, i], len(h)).astype(np.int64) for i in range(4)]
                context, shorter = hashes[k - 2][at - 1], hashes[k - 2][at]
                middle = hashes[k - 3][at - 1] if k > 2 else np.zeros(len(at), np.uint64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(h), k, np.int32)), *(pa.array(x.view(np.int64)) for x in (h, context, shorter, middle)), *map(pa.array, total)], ["k", "gram", "context", "shorter", "middle", *NS])

    grams = words.mapInArrow(run, "k int, gram bigint, context bigint, shorter bigint, middle bigint, n0 bigint, n1 bigint, n2 bigint, n3 bigint")
    return grams.groupBy("k", "gram", "context", "shorter", "middle").agg(*[F.sum(c).alias(c) for c in NS])


def shared_chances(grams: DataFrame) -> DataFrame:
    """gram and its chance `p` for all n-grams of two characters, by continuation counts of both classes together."""
    two, three = grams.where("k = 2"), grams.where("k = 3")
    single = two.groupBy(F.col("shorter").alias("c")).agg(F.count("*").alias("ends"))
    total = single.agg(F.coalesce(F.sum("ends"), F.lit(0)).alias("total"))
    lowest = two.join(single, two.shorter == single.c, "left").crossJoin(F.broadcast(total))  # of one row
    lowest = lowest.select("gram", "context", ((F.coalesce("ends", F.lit(0)) + 0.5) / (F.col("total") + 0.5 * 4096)).alias("p"))
    before = three.groupBy(F.col("shorter").alias("gram")).agg(F.count("*").alias("n"))
    around = three.groupBy(F.col("middle").alias("context")).agg(F.count("*").alias("all"))
    kinds = two.groupBy("context").agg(F.count("*").alias("kinds"))
    held = lowest.join(before, "gram", "left").join(around, "context", "left").join(kinds, "context")
    smoothed = F.greatest(F.coalesce("n", F.lit(0)) - DISCOUNT, F.lit(0.0)) / F.col("all") + F.least(DISCOUNT * F.col("kinds") / F.col("all"), F.lit(1.0)) * F.col("p")
    return held.select("gram", F.coalesce(smoothed, "p").alias("p"))


def counted(grams: DataFrame, k: int, sides: list[tuple[str, tuple[int, ...]]]) -> DataFrame:
    """gram, context, shorter and what each class counts of the n-grams of k characters.

    Occurrences at the highest order; below it the distinct characters that stand before the n-gram, but at the
    beginning of a word, where none does, occurrences again.
    """
    total = lambda of: sum((F.col(f"n{i}") for i in of[1:]), F.col(f"n{of[0]}"))
    own = grams.where(F.col("k") == k).select("gram", "context", "shorter", *[total(of).alias(f"n_{s}") for s, of in sides])
    if k == ORDERS:
        return own
    longer = grams.where(F.col("k") == k + 1).groupBy(F.col("shorter").alias("gram")).agg(*[F.sum((total(of) > 0).cast("int")).alias(f"c_{s}") for s, of in sides])
    return own.join(longer, "gram", "left").select("gram", "context", "shorter", *[F.coalesce(f"c_{s}", f"n_{s}").alias(f"n_{s}") for s, _ in sides])


def entries(grams: DataFrame) -> DataFrame:
    """kind, key and for each of MODELS a value.

    Kind 0: n-grams that were seen, with the log of their chance as toxic over
    that as ordinary.  Kind 1: contexts, with the log of their back-off weights'
    ratio, to be added to the shorter n-gram's value where an n-gram was not seen.
    """
    sides = [(f"{m}_{c}", of) for m, both in MODELS.items() for c, of in zip("to", both)]
    lower = shared_chances(grams).select("gram", *[F.col("p").alias(f"p_{s}") for s, _ in sides])
    out = []
    for k in range(SHARED + 1, ORDERS + 1):
        own = counted(grams, k, sides)
        contexts = own.groupBy("context").agg(*[F.sum(f"n_{s}").alias(f"all_{s}") for s, _ in sides], *[F.sum((F.col(f"n_{s}") > 0).cast("int")).alias(f"kinds_{s}") for s, _ in sides])
        # a context that a class never had hands on the shorter n-gram's chance whole
        weights = contexts.select("context", *[F.col(f"all_{s}") for s, _ in sides], *[F.when(F.col(f"all_{s}") > 0, F.least(DISCOUNT * F.col(f"kinds_{s}") / F.col(f"all_{s}"), F.lit(1.0))).otherwise(1.0).alias(f"w_{s}") for s, _ in sides])
        weights = stored(weights)
        joined = own.join(weights, "context").join(lower.withColumnRenamed("gram", "shorter"), "shorter")
        chance = {s: F.when(F.col(f"all_{s}") > 0, F.greatest(F.col(f"n_{s}") - DISCOUNT, F.lit(0.0)) / F.col(f"all_{s}")).otherwise(0.0) + F.col(f"w_{s}") * F.col(f"p_{s}") for s, _ in sides}
        lower = stored(joined.select("gram", *[x.alias(f"p_{s}") for s, x in chance.items()]))
        for kind, df, key, of in ((0, lower, "gram", "p"), (1, weights, "context", "w")):
            out.append(df.select(F.lit(kind).alias("kind"), F.col(key).alias("key"), *[F.log(F.greatest(F.col(f"{of}_{m}_t"), F.lit(1e-30)) / F.greatest(F.col(f"{of}_{m}_o"), F.lit(1e-30))).cast("float").alias(m) for m in MODELS]))
    every = functools.reduce(DataFrame.unionByName, out)
    return every.where(F.col("kind").eqNullSafe(0) | functools.reduce(Column.__or__, [F.col(m) != 0 for m in MODELS]))


# --- entries to texts -------------------------------------------------------


def needed(words: list[str]) -> tuple[np.ndarray, np.ndarray, list, np.ndarray]:
    """The parts of all words: lengths, place in the part, hashes of each order, and the word that a part is of."""
    parts = [(i, w[k : k + LONGEST]) for i, w in enumerate(words) for k in range(0, max(1, len(w)), LONGEST)]
    points, lengths = _points([p for _, p in parts])
    within = _within(lengths)
    return lengths, within, _hashes(points, within), np.array([i for i, _ in parts], np.int64)


def needed_keys(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-grams and contexts of the words."""
    _, within, hashes, _ = needed(words)
    oks = [(k, np.flatnonzero(within >= k - 1)) for k in range(SHARED + 1, ORDERS + 1)]
    return np.unique(np.concatenate([hashes[k - 1][ok] for k, ok in oks])), np.unique(np.concatenate([hashes[k - 2][ok - 1] for k, ok in oks]))


class Entries:
    """Entries as two sorted arrays of keys with a row of values for each key."""

    def __init__(self, kinds: np.ndarray, keys: np.ndarray, values: np.ndarray) -> None:
        self.n = values.shape[1]
        self.held = []
        for kind in (0, 1):
            rows = np.flatnonzero(kinds == kind)
            mine = keys[rows].view(np.uint64)
            order = np.argsort(mine)
            self.held.append((mine[order], values[rows[order]]))

    def find(self, kind: int, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Whether each key is there, and its values (0 where it is not)."""
        keys, values = self.held[kind]
        if not len(keys):
            return np.zeros(len(wanted), bool), np.zeros((len(wanted), self.n), np.float32)
        code, distinct = pd.factorize(wanted)
        at = np.minimum(np.searchsorted(keys, distinct), len(keys) - 1)
        there = keys[at] == distinct
        return there[code], np.where(there[:, None], values[at], 0)[code]


def word_ratios(words: list[str], known: Entries) -> np.ndarray:
    """Log-likelihood of each word under the toxic model less that under the ordinary one, a column for each model."""
    if not words:
        return np.zeros((0, known.n))
    lengths, within, hashes, word = needed(words)
    ratio = np.zeros((len(within), known.n), np.float64)
    for k in range(SHARED + 1, ORDERS + 1):
        ok = np.flatnonzero(within >= k - 1)
        seen, value = known.find(0, hashes[k - 1][ok])
        ratio[ok[seen]] = value[seen]
        rest = ok[~seen]
        ratio[rest] += known.find(1, hashes[k - 2][rest - 1])[1]
    by_part = np.add.reduceat(ratio, np.cumsum(lengths) - lengths)
    return np.column_stack([np.bincount(word, by_part[:, i], len(words)) for i in range(known.n)])


#: Longer texts are read in parts of about this many characters.
PART = 1 << 21


def _parts(text: str) -> Iterator[str]:
    at = 0
    while len(text) - at > PART:
        cut = next((m.start() for m in _SPACE.finditer(text, at + PART)), len(text))
        yield text[at:cut]
        at = cut
    yield text[at:]


def text_ratios(texts: pa.Array, known: Entries) -> list[np.ndarray]:
    """For each text the ratios of its words, a column for each model."""
    codes, offsets, names = words_of(texts)
    ratio = word_ratios(names, known)
    real = np.array([bool(w) for w in names], bool)
    out = []
    for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
        c = codes[a:b]
        out.append(ratio[c[real[c]]] if b > a else ratio[:0])
    return out


def features(texts: pa.Array, known: Entries) -> np.ndarray:
    """Length-normalised ratios of each text: the whole, and the best windows; all 0 for texts without words.

    Shape: texts, models, 1 + windows.
    """
    out = np.zeros((len(texts), known.n, 1 + len(WINDOWS)))
    long = pc.greater(pc.utf8_length(texts), PART).to_numpy(zero_copy_only=False) if len(texts) else np.zeros(0, bool)
    held = text_ratios(pc.if_else(pa.array(long), "", texts) if long.any() else texts, known)
    for d in np.flatnonzero(long).tolist():
        held[d] = np.concatenate([text_ratios(pa.array([part], pa.large_string()), known)[0] for part in _parts(texts[d].as_py())])
    for d, x in enumerate(held):
        if not len(x):
            continue
        total = np.concatenate([np.zeros((1, known.n)), np.cumsum(x, axis=0)])
        out[d, :, 0] = total[-1] / len(x)
        for j, w in enumerate(WINDOWS):
            m = min(w, len(x))
            out[d, :, 1 + j] = (total[m:] - total[:-m]).max(axis=0) / m
    return out


def _small(table: DataFrame, models: list[str], most_bytes: int) -> Entries | None:
    """The entries, if their measured size is at most `most_bytes`."""
    if table.count() * (9 + 4 * len(models)) > most_bytes:
        return None

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            packed = (batch.column("kind").to_numpy().astype(np.int8), batch.column("key").to_numpy(), np.stack([batch.column(m).to_numpy() for m in models], axis=1).astype(np.float32))
            yield pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary()) for x in packed], ["kind", "key", "value"])

    rows = table.select("kind", "key", *models).mapInArrow(pack, "kind binary, key binary, value binary").toArrow()
    kind, key, value = (np.frombuffer(b"".join(rows.column(c).to_pylist()), t) for c, t in (("kind", np.int8), ("key", np.int64), ("value", np.float32)))
    return Entries(kind, key, value.reshape(-1, len(models)))


def feature_names(model: str, keep: list[str]) -> list[str]:
    """Names of the feature columns of a model, none of which is in `keep`."""
    return [f"{fresh('_' + model, keep)}{j}" for j in range(1 + len(WINDOWS))]


def with_features(docs: DataFrame, table: DataFrame, models: list[str], text: str, keep: list[str], most_bytes: int) -> DataFrame:
    """The columns `keep` of `docs` and, for each model, the columns that :func:`feature_names` gives."""
    names = [c for m in models for c in feature_names(m, keep)]
    schema = schema_of(docs, keep) + ", ".join(f"{c} double" for c in names)
    asked = text if text in keep else fresh("_text", keep)
    read = docs.select(*[F.col(quoted(c)) for c in keep], *([] if text in keep else [F.col(quoted(text)).alias(asked)]))

    def rated(batch: pa.RecordBatch, known: Entries) -> pa.RecordBatch:
        f = features(plain_strings(batch.column(asked)), known).reshape(batch.num_rows, -1)
        return pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), *(pa.array(np.ascontiguousarray(f[:, i])) for i in range(f.shape[1]))], [*keep, *names])

    small = _small(table, models, most_bytes)
    if small is not None:
        held = docs.sparkSession.sparkContext.broadcast(small)  # of a measured size
        del small
        return read.mapInArrow(lambda batches: (rated(b, held.value) for b in slices(batches, asked, 1 << 20)), schema)

    # too large to send everywhere: each batch of documents gets the entries that it needs
    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, asked, 1 << 20):
            whole = pa.RecordBatch.from_arrays([pa.concat_arrays([c]) for c in batch.columns], schema=batch.schema)
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, whole.schema) as stream:
                stream.write_batch(whole)
            yield pa.RecordBatch.from_arrays([pa.array([uuid.uuid4().hex]), pa.array([sink.getvalue().to_pybytes()], pa.binary())], ["batch", "block"])

    def opened(block: bytes) -> pa.RecordBatch:
        return next(iter(pa.ipc.open_stream(block)))

    def requests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number, block in zip(batch.column("batch").to_pylist(), batch.column("block").to_pylist()):
                texts = plain_strings(opened(block).column(asked))
                for kind, keys in enumerate(needed_keys(words_of(texts)[2] or [""])):
                    n = len(keys)
                    yield pa.RecordBatch.from_arrays([pa.array([number] * n), pa.array(np.full(n, kind, np.int32)), pa.array(keys.view(np.int64))], ["batch", "kind", "key"])

    def answered(rows: pd.DataFrame) -> pd.DataFrame:
        there = rows.block.notna()
        got = rows[~there]
        known = Entries(got.kind.to_numpy(np.int64), got.key.to_numpy(np.int64), got[models].to_numpy(np.float32).reshape(-1, len(models)))
        out = [rated(opened(b), known) for b in rows.block[there]]
        return pa.Table.from_batches(out).to_pandas(types_mapper=pd.ArrowDtype)

    packed = stored(read.mapInArrow(blocks, "batch string, block binary"))
    replies = packed.mapInArrow(requests, "batch string, kind int, key bigint").join(table.select("kind", "key", *models), ["kind", "key"]).select("batch", "kind", "key", *models, F.lit(None).cast("binary").alias("block"))
    heads = packed.select("batch", F.lit(-1).alias("kind"), F.lit(0).cast("bigint").alias("key"), *[F.lit(None).cast("float").alias(m) for m in models], "block")
    return replies.unionByName(heads).groupBy("batch").applyInPandas(answered, schema)


#: Factors of the features in the regression; there, ratios are bounded so that a single odd word cannot rule.
FACTORS = (10.0, *(math.sqrt(w) for w in WINDOWS))
BOUND = 15.0


def squashed(f: np.ndarray) -> np.ndarray:
    return np.clip(f * FACTORS, -BOUND, BOUND)


def logistic(x: np.ndarray, y: np.ndarray, l2: float = 1e-2, steps: int = 50) -> dict:
    """Logistic regression by Newton steps on standardised features, with a small penalty."""
    mean, width = x.mean(axis=0), x.std(axis=0) + 1e-6
    z = np.column_stack([np.ones(len(x)), (x - mean) / width])
    w = np.zeros(z.shape[1])
    penalty = np.r_[1e-6, np.full(z.shape[1] - 1, l2)] * len(x)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-z @ w))
        h = (z * (p * (1 - p))[:, None]).T @ z + np.diag(penalty) + 1e-9 * np.eye(len(w))
        step = np.linalg.solve(h, z.T @ (y - p) - penalty * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return {"w": w, "mean": mean, "width": width}


def probability(columns: list[Column], fit: dict) -> Column:
    """The regression's score of a text with these features."""
    z = F.lit(float(fit["w"][0]))
    for x, factor, mean, width, w in zip(columns, FACTORS, fit["mean"], fit["width"], fit["w"][1:]):
        bounded = F.greatest(F.lit(-BOUND), F.least(F.lit(BOUND), x * float(factor)))
        z = z + (bounded - float(mean)) / float(width) * float(w)
    return F.lit(1.0) / (1 + F.exp(-F.greatest(F.lit(-35.0), F.least(F.lit(35.0), z))))


def held_out(id_col: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, learnable: Column | None = None, most_bytes: int = MODEL_BYTES) -> dict | None:
    """Model of the labelled documents (doc_id joined to labels.toxic) for which `learnable` holds."""
    learnable = ~held_out() if learnable is None else learnable
    marks = labels.where(learnable & F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    # most texts without a label are left out before the shuffle; the labelled ones are written once
    read = docs.select("doc_id", "text").where("text is not null").where(maybe_among(marks.select(F.col("doc_id").alias("doc"))))
    fold = F.xxhash64("doc_id", F.lit(29)).bitwiseAND(1)
    rows = stored(read.join(marks, "doc_id").select("text", "doc_id", "toxic", (F.col("toxic") * 2 + fold).cast("int").alias("side")))
    sizes = {r.side: r.n for r in rows.groupBy("side").agg(F.count("*").alias("n")).collect()}
    if not (sizes.get(0, 0) + sizes.get(1, 0)) or not (sizes.get(2, 0) + sizes.get(3, 0)):
        return None
    share = F.element_at(F.create_map(*[F.lit(x) for s, n in sizes.items() for x in (s, min(1.0, (FIT_ROWS / 2 * 1.1 + 50) / n))]), F.col("side"))
    unit = F.xxhash64("doc_id", F.lit(31)).bitwiseAND(F.lit((1 << 40) - 1)) / F.lit(float(1 << 40))
    table = stored(entries(stored(gram_counts(word_counts(rows)))))
    models = ["without0", "without1"]
    near = rows.withColumn("u", unit).where(F.col("u") < share)
    sample = with_features(near, table, models, "text", ["side", "u"], most_bytes).toPandas()  # of bounded size
    columns = [f"f{j}" for j in range(1 + len(WINDOWS))]
    for c, a, b in zip(columns, *(feature_names(m, ["side", "u"]) for m in models)):
        sample[c] = np.where(sample.side % 2 == 0, sample[a], sample[b])
    sample["toxic"] = sample.side // 2
    sample = sample.sort_values(["toxic", "u", *columns]).groupby("toxic").head(FIT_ROWS)
    # both classes were sampled by themselves: shift the intercept back to their share of all rows
    x, y = squashed(sample[columns].to_numpy()), sample.toxic.to_numpy().astype(float)
    if y.min() == y.max():
        return None
    got = logistic(x, y)
    n1 = sizes.get(2, 0) + sizes.get(3, 0)
    n0 = sizes.get(0, 0) + sizes.get(1, 0)
    got["w"][0] += math.log(n1 / n0) - math.log(y.sum() / (len(y) - y.sum()))
    return {"table": table, "fit": got, "most_bytes": most_bytes}


def score(docs: DataFrame, model: dict | None, threshold: float = 0.7, text: str = "text", out: tuple[str, str] = ("score", "predicted"), keep: list[str] | None = None) -> DataFrame:
    """The columns `keep` of `docs` (all, if not given) with the score and the decision, as the columns named in `out` (which they replace)."""
    keep = [c for c in (docs.columns if keep is None else keep) if c not in out]
    kept = [F.col(quoted(c)) for c in keep]
    if model is None:
        rated = docs.select(*kept, F.lit(0.0).alias(out[0]))
    else:
        found = with_features(docs, model["table"], ["full"], text, keep, model["most_bytes"])
        rated = found.select(*kept, probability([F.col(c) for c in feature_names("full", keep)], model["fit"]).alias(out[0]))
    return rated.withColumn(out[1], (F.col(quoted(out[0])) >= threshold).cast("int"))


def rate_documents(docs: DataFrame, labels: DataFrame, threshold: float = 0.7) -> DataFrame:
    """doc_id, held_out, score and predicted of every document."""
    model = fit(docs, labels)
    return score(docs.select("doc_id", held_out().alias("held_out"), "text"), model, threshold, keep=["doc_id", "held_out"])
