"""Token counts without token ids: each distinct pre-token is counted once, then joined to its documents.

1. Each batch of documents lists its distinct pre-tokens (pieces between spaces),
   dealt to buckets by a hash.  A pre-token is in one bucket only, once for each
   batch that has it, so that a word of every document is no bucket's burden.
2. Each bucket counts the pieces of each of its pre-tokens once, and answers each
   batch with the counts in the order in which it asked.  Buckets hold about
   `BUCKET_BYTES` of text each, so that their number follows the input.
3. The batch's per-document pre-token frequencies meet the answers: pieces times
   frequency, summed by document.

Ids are never kept: only the number of pieces of a pre-token is.  Texts that
are encoded whole (runs of white space that are one piece) are no pre-tokens of
others and are counted with their batch.

Defined results: null and empty texts have 0 bytes and 0 tokens; each input row
gives one output row, repeated ids and null ids included; very long texts are
batches of their own.  The input is read twice and should be a stored table: if
a batch is not the same the second time, the job fails.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lightshelf.llm.common import RUN_OF_THREE, plain_strings, slices, spaced_words
from lightshelf.llm.tokens import encode_pieces

REQUESTS = "bucket int, batch bigint, mark bigint, words array<string>"
ANSWERS = "batch bigint, mark bigint, bucket int, counts binary, packed binary"
#: Bytes of text of a batch and of a bucket, and the least number of buckets, for parallelism.
BATCH_BYTES, BUCKET_BYTES, LEAST_BUCKETS = 8 << 20, 24 << 20, 24


def _batches(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.RecordBatch]]:
    """The task's batches with numbers that no other task of the same scan uses."""
    number = 0
    for batch in slices(batches, "text", BATCH_BYTES):
        number += 1
        yield (batch.column("part")[0].as_py() << 24) + number, batch


class Batch:
    """The distinct pre-tokens of a batch in the order of their buckets, and each text's codes into them."""

    def __init__(self, column: pa.Array, n_buckets: int) -> None:
        self.texts = plain_strings(column)
        self.whole = pc.match_substring_regex(self.texts, RUN_OF_THREE).to_numpy(zero_copy_only=False)
        codes, self.offsets, names = spaced_words(pc.if_else(pa.array(self.whole), "", self.texts), RUN_OF_THREE)
        hashed = pd.util.hash_array(np.array(names + [""], object)[:-1], categorize=False)
        bucket = (hashed % np.uint64(n_buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        self.codes = rank[codes]
        self.words = pa.array(names, pa.string()).take(pa.array(order))
        self.cuts = np.searchsorted(bucket[order], np.arange(n_buckets + 1))
        self.mark = int(np.bitwise_xor.reduce(hashed, initial=np.uint64(len(codes))).astype(np.int64))

    def frequencies(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Text, code and frequency of each pre-token of each text, in the order of texts and codes."""
        most = max(1, len(self.words))
        key = np.sort(np.repeat(np.arange(len(self.texts)), np.diff(self.offsets)) * most + self.codes)
        first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.zeros(0, np.int64)
        return key[first] // most, key[first] % most, np.diff(np.r_[first, len(key)])


def requests(batches: Iterator[pa.RecordBatch], n_buckets: int) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("bucket", pa.int32()), ("batch", pa.int64()), ("mark", pa.int64()), ("words", pa.list_(pa.string()))])
    for number, rows in _batches(batches):
        b = Batch(rows.column("text"), n_buckets)
        there = np.flatnonzero(np.diff(b.cuts))
        words = pa.ListArray.from_arrays(pa.array(np.r_[b.cuts[there], b.cuts[-1]].astype(np.int32)), b.words)
        yield pa.RecordBatch.from_arrays([pa.array(there.astype(np.int32)), pa.array([number] * len(there), pa.int64()), pa.array([b.mark] * len(there), pa.int64()), words], schema=schema)


def answers(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    """Counts the pieces of each pre-token of the bucket (a partition is one) once."""
    schema = pa.schema([("batch", pa.int64()), ("mark", pa.int64()), ("bucket", pa.int32()), ("counts", pa.binary()), ("packed", pa.binary())])
    counted: dict[str, int] = {}
    for batch in batches:
        for i in range(batch.num_rows):
            words = batch.column("words")[i].as_py()
            new = [w for w in words if w not in counted]
            counted.update(zip(new, encode_pieces(new, path)[1].tolist()))
            pieces = np.fromiter(map(counted.__getitem__, words), np.uint32, len(words))
            yield pa.RecordBatch.from_arrays([batch.column("batch").slice(i, 1), batch.column("mark").slice(i, 1), batch.column("bucket").slice(i, 1), pa.array([pieces.tobytes()], pa.binary()), pa.nulls(1, pa.binary())], schema=schema)


_PACKED = pa.schema([("doc_ids", pa.list_(pa.int64())), ("n_bytes", pa.list_(pa.int64())), ("own", pa.list_(pa.int64())), ("per_text", pa.list_(pa.int32())), ("cuts", pa.list_(pa.int32())), ("steps", pa.list_(pa.uint32())), ("freqs", pa.list_(pa.uint32()))])


def frequency_rows(batches: Iterator[pa.RecordBatch], n_buckets: int, path: str) -> Iterator[pa.RecordBatch]:
    """A row for each batch: ids, bytes and pre-token frequencies of its texts."""
    schema = pa.schema([("batch", pa.int64()), ("mark", pa.int64()), ("bucket", pa.int32()), ("counts", pa.binary()), ("packed", pa.binary())])
    options = pa.ipc.IpcWriteOptions(compression="zstd")
    for number, rows in _batches(batches):
        b = Batch(rows.column("text"), n_buckets)
        n = len(b.texts)
        own = np.zeros(n, np.int64)
        at = np.flatnonzero(b.whole)
        if len(at):
            distinct = b.texts.take(pa.array(at)).dictionary_encode()
            own[at] = encode_pieces(distinct.dictionary.to_pylist(), path)[1][distinct.indices.to_numpy(zero_copy_only=False)]
        text, code, freq = b.frequencies()
        # codes as steps from one to the next: small numbers, which pack well
        steps = np.diff(code, prepend=0)
        begins = np.flatnonzero(np.r_[True, text[1:] != text[:-1]]) if len(text) else np.zeros(0, np.int64)
        steps[begins] = code[begins]
        size = pc.binary_length(b.texts).to_numpy().astype(np.int64)
        held = (rows.column("doc_id").cast(pa.int64()), pa.array(size), pa.array(own), pa.array(np.bincount(text, minlength=n).astype(np.int32)), pa.array(b.cuts.astype(np.int32)), pa.array(steps.astype(np.uint32)), pa.array(freq.astype(np.uint32)))
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, _PACKED, options=options) as stream:
            stream.write_batch(pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x) for x in held], schema=_PACKED))
        yield pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), pa.array([b.mark], pa.int64()), pa.nulls(1, pa.int32()), pa.nulls(1, pa.binary()), pa.array([sink.getvalue().to_pybytes()], pa.binary())], schema=schema)


def _joined(rows: pd.DataFrame) -> pd.DataFrame:
    """Pieces times frequency of one batch, summed by document."""
    heads = rows.packed.notna()
    if heads.sum() != 1 or rows.mark.nunique() != 1:
        raise RuntimeError("count_tokens: documents were not the same when read again; store the table first")
    held = next(iter(pa.ipc.open_stream(rows.packed[heads].iloc[0])))
    ids, n_bytes, own, per_text, cuts, steps, freqs = (held.column(i).flatten() for i in range(held.num_columns))
    cuts, per_text = cuts.to_numpy(), per_text.to_numpy()
    pieces = np.zeros(cuts[-1], np.int64)
    answered = 0
    for bucket, counts in zip(rows.bucket[~heads].astype(int), rows.counts[~heads]):
        pieces[cuts[bucket] : cuts[bucket + 1]] = np.frombuffer(counts, np.uint32)
        answered += cuts[bucket + 1] - cuts[bucket]
    if answered != len(pieces):
        raise RuntimeError("count_tokens: documents were not the same when read again; store the table first")
    # codes start anew with each text: what was summed up before it is taken off
    code = np.cumsum(steps.to_numpy().astype(np.int64))
    ends = np.cumsum(per_text)
    before = np.concatenate([[0], code])[ends - per_text]
    code -= np.repeat(before, per_text)
    total = np.bincount(np.repeat(np.arange(len(per_text)), per_text), pieces[code] * freqs.to_numpy().astype(np.int64), len(per_text)).astype(np.int64)
    return pd.DataFrame({"doc_id": ids.to_pandas(types_mapper={pa.int64(): pd.Int64Dtype()}.get), "n_bytes": n_bytes.to_numpy(), "n_tokens": total + own.to_numpy()})


def count_tokens(docs: DataFrame, path: str, limit: int = 512) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit of each document, tokens as by the tokenizer file at `path`."""
    # the scan's own partition number: a task's number counts those of other branches, too
    docs = docs.select("doc_id", "text", F.spark_partition_id().alias("part"))
    size = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    n_buckets = max(LEAST_BUCKETS, -(-size // BUCKET_BYTES))
    asked = docs.mapInArrow(lambda it: requests(it, n_buckets), REQUESTS).repartitionById(n_buckets, "bucket")
    counts = asked.mapInArrow(lambda it: answers(it, path), ANSWERS)
    heads = docs.mapInArrow(lambda it: frequency_rows(it, n_buckets, path), ANSWERS)
    counted = counts.unionByName(heads).groupBy("batch").applyInPandas(_joined, "doc_id bigint, n_bytes bigint, n_tokens bigint")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
