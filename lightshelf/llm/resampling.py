"""Importance resampling towards a target: hashed n-gram counts, gains per bucket, and the best of the documents by weight and noise.

1. Words are runs of letters, digits and signs beyond ASCII; features are all
   runs of one and two words.  A feature's bucket is the CRC-32 of its bytes
   modulo `buckets`.  Checksums are computed for whole batches: bytes of all
   words side by side, and a pair's from those of its words, as appending L
   bytes to a text moves its checksum by a linear map that depends on L alone.
2. First pass: each partition counts its features with `np.bincount`; the
   vectors are merged by `treeReduce`.  So is the target's.
3. Gains of the buckets, one vector of fixed size, are broadcast; the second
   pass gathers them and sums each document's by `np.bincount` with weights.
4. Documents long enough are dealt to ranges of the order by score; a row's
   place is its place in the range and the sizes of the ranges before.

Defined results: null and empty texts have no features, weight 0 and are never
drawn; rows with a null id have no score and are not drawn or counted either;
a row that is given twice is drawn twice; equal scores go to the smaller id,
then to the row with fewer features.  An empty table gives an empty result, an
empty target gains that only tell rare buckets from common ones.  Texts of any
length are gone through in blocks of words.  Further columns are not read.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lightshelf.llm.common import plain_strings, slices, stored

#: Longest words whose checksums are computed side by side; longer ones go to zlib one by one.
SIDE_BY_SIDE = 64
#: Words of a block.
BLOCK = 1 << 18
#: Rows of a range of the order.
RANGE_ROWS = 1 << 20

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_WORD = np.zeros(256, bool)
_WORD[0x30:0x3A] = _WORD[0x61:0x7B] = _WORD[0x80:] = True


def _crc_table() -> np.ndarray:
    """What each byte does to a checksum's register."""
    t = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        t = np.where(t & 1, (t >> 1) ^ np.uint32(0xEDB88320), t >> 1).astype(np.uint32)
    return t


_STEP = _crc_table()


def _append(crc: np.ndarray, byte: np.ndarray | int) -> np.ndarray:
    """Checksums after one more byte."""
    r = ~crc
    return ~(_STEP[(r ^ np.uint32(byte) if isinstance(byte, int) else r ^ byte) & np.uint32(255)] ^ (r >> np.uint32(8)))


class Shifts:
    """For each length L asked for: four tables of 256 that move a checksum over L zero bytes."""

    def __init__(self) -> None:
        bits = np.uint32(1) << np.arange(32, dtype=np.uint32)
        self.powers = [_STEP[bits & np.uint32(255)] ^ (bits >> np.uint32(8))]  # images of the bits over 1, 2, 4, ... bytes
        self.known: dict[int, np.ndarray] = {}

    @staticmethod
    def _apply(images: np.ndarray, values: np.ndarray) -> np.ndarray:
        out = np.zeros_like(values)
        for i in range(32):
            out ^= np.where(values >> np.uint32(i) & np.uint32(1), images[i], np.uint32(0))
        return out

    def table(self, length: int) -> np.ndarray:
        if length not in self.known:
            values = np.concatenate([np.arange(256, dtype=np.uint32) << np.uint32(8 * k) for k in range(4)])
            for bit in range(length.bit_length()):
                if bit >= len(self.powers):
                    self.powers.append(self._apply(self.powers[-1], self.powers[-1]))
                if length >> bit & 1:
                    values = self._apply(self.powers[bit], values)
            if len(self.known) > 4096:
                self.known.clear()
            self.known[length] = values.reshape(4, 256)
        return self.known[length]

    def moved(self, crc: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        distinct, which = np.unique(lengths, return_inverse=True)
        tables = np.stack([self.table(int(n)) for n in distinct]) if len(distinct) else np.zeros((1, 4, 256), np.uint32)
        out = np.zeros(len(crc), np.uint32)
        for k in range(4):
            out ^= tables[which, k, crc >> np.uint32(8 * k) & np.uint32(255)]
        return out


def word_checksums(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """CRC-32 of each word."""
    order = np.argsort(-np.minimum(lengths, SIDE_BY_SIDE + 1), kind="stable")
    n_long = int((lengths > SIDE_BY_SIDE).sum())
    out = np.zeros(len(starts), np.uint32)
    for i in order[:n_long].tolist():
        out[i] = zlib.crc32(data[starts[i] : starts[i] + lengths[i]].data)
    short = order[n_long:]
    at, left, crc = starts[short], lengths[short], np.zeros(len(short), np.uint32)
    for k in range(int(left[0]) if len(left) else 0):
        n = int(np.searchsorted(-left, -k, "left"))  # words of more than k bytes come first
        crc[:n] = _append(crc[:n], data[at[:n] + k].astype(np.uint32))
    out[short] = crc
    return out


def features(texts: pa.Array, buckets: int, shifts: Shifts) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Blocks of (document of each word, bucket of each word, bucket of each pair that ends at a word or -1)."""
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    held = texts.buffers()[2]
    raw = np.frombuffer(held, np.uint8)[offsets[0] : offsets[-1]] if held is not None and held.size else np.zeros(0, np.uint8)
    data, offsets = _LOWER[raw], offsets - offsets[0]
    inside = np.zeros(len(data) + 2, bool)
    inside[1:-1] = _WORD[data]
    first, last = inside[1:-1] & ~inside[:-2], inside[1:-1] & ~inside[2:]
    edge = offsets[1:-1][(offsets[1:-1] > 0) & (offsets[1:-1] < len(data))]
    first[edge] = inside[1:-1][edge]  # words end with their document
    last[edge - 1] = inside[1:-1][edge - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    before: tuple[int, np.ndarray] = (-1, np.zeros(1, np.uint32))
    for i in range(0, len(starts), BLOCK):
        s, n = starts[i : i + BLOCK], ends[i : i + BLOCK] - starts[i : i + BLOCK]
        doc = np.searchsorted(offsets, s, "right") - 1
        crc = word_checksums(data, s, n)
        left_doc, left = np.r_[before[0], doc[:-1]], np.r_[before[1], crc[:-1]].astype(np.uint32)
        pair = shifts.moved(_append(left, 32), n) ^ crc
        yield doc, (crc % buckets).astype(np.int64), np.where(left_doc == doc, (pair % buckets).astype(np.int64), -1)
        before = (int(doc[-1]), crc[-1:])


def bucket_counts(docs: DataFrame, text_col: str = "text", buckets: int = 10000) -> np.ndarray:
    """How many features of all texts fall in each bucket."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, shifts = np.zeros(buckets, np.int64), Shifts()
        for batch in slices(batches, "text"):
            for _, word, pair in features(plain_strings(batch.column("text")), buckets, shifts):
                total += np.bincount(word, minlength=buckets) + np.bincount(pair[pair >= 0], minlength=buckets)
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["counts"])

    parts = docs.select(F.col(text_col).alias("text")).mapInArrow(count, "counts binary").rdd.map(lambda row: np.frombuffer(row[0], np.int64))
    none = docs.sparkSession.sparkContext.parallelize([np.zeros(buckets, np.int64)], 1)
    return parts.union(none).treeReduce(np.add)


def bucket_gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Whole thousandths of the log ratio of the smoothed shares in target and source."""
    s_all, t_all, n = int(source.sum()), int(target.sum()), len(source)
    return np.array([math.floor(1000 * math.log(float((t + 1) * (s_all + n)) / float((s + 1) * (t_all + n)))) for s, t in zip(source.tolist(), target.tolist())], np.int64)


def _noise(seed: int, name: int) -> int:
    h = int(hashlib.sha256(f"{seed}:{name}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def resample(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", target_col: str = "text", percent: int = 25, least_words: int = 20, buckets: int = 10000, seed: int = 7) -> DataFrame:
    """One row per document: id, n_features, weight, score, and its rank among the drawn ones (else null)."""
    spark = docs.sparkSession
    gains = spark.sparkContext.broadcast(bucket_gains(bucket_counts(docs, text_col, buckets), bucket_counts(target, target_col, buckets)))

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shifts, gain = Shifts(), gains.value.astype(np.float64)
        for batch in slices(batches, "text"):
            n = batch.num_rows
            total, words, pairs = np.zeros(n), np.zeros(n, np.int64), np.zeros(n, np.int64)
            for doc, word, pair in features(plain_strings(batch.column("text")), buckets, shifts):
                both = pair >= 0
                total += np.bincount(doc, gain[word], n) + np.bincount(doc[both], gain[pair[both]], n)  # whole numbers below 2^53
                words += np.bincount(doc, minlength=n)
                pairs += np.bincount(doc[both], minlength=n)
            weight = total.astype(np.int64) // np.maximum(words + pairs, 1)
            ids = batch.column("id").to_pylist()
            score = [None if i is None else w + _noise(seed, i) for i, w in zip(ids, weight.tolist())]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(words), pa.array(words + pairs), pa.array(weight), pa.array(score, pa.int64())], ["id", "words", "n_features", "weight", "score"])

    weighed = stored(docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text")).mapInArrow(weigh, "id bigint, words bigint, n_features bigint, weight bigint, score bigint"))
    able = (F.col("words") >= least_words) & F.col("score").isNotNull()
    n = weighed.where(able).count()
    ranges = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n // RANGE_ROWS))
    order = [F.col("score").desc(), F.col("id"), F.col("n_features")]
    # the id of a row holds its partition and its place there
    sorted_rows = stored(weighed.where(able).repartitionByRange(ranges, *order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id()))
    part = F.shiftright("at", 33)
    sizes = sorted({r["part"]: r["n"] for r in sorted_rows.groupBy(part.alias("part")).agg(F.count("*").alias("n")).collect()}.items())  # a row for each range
    before, offsets = 0, []
    for p, size in sizes:
        offsets.append((p, before))
        before += size
    starts = F.broadcast(spark.createDataFrame(offsets, "part bigint, before bigint"))  # of the same size
    place = F.col("before") + F.col("at").bitwiseAND((1 << 33) - 1) + 1
    drawn = sorted_rows.withColumn("part", part).join(starts, "part").withColumn("rank", F.when(place <= percent * n // 100, place))
    rest = weighed.where(~F.coalesce(able, F.lit(False))).withColumn("rank", F.lit(None).cast("bigint"))
    columns = [F.col("id").alias(id_col), "n_features", "weight", "score", "rank"]
    return drawn.select(*columns).unionByName(rest.select(*columns))
