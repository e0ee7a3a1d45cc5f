"""Token-id matrices: best-fit-decreasing packing within shards, with a segment tree over free capacities.

Each task encodes its documents, cuts overlong ones into pieces without losing
an id, gathers pieces up to `SHARD_TOKENS` ids and packs them: the longest piece
first, each into the fullest sequence that still has room, which a segment tree
over the free capacities finds in logarithmic time.  No rows are shuffled; a
shard is a few thousand sequences, so that only its last ones stay unfilled.

A row of the result is one sequence: its ids (little endian, two bytes each
where the vocabulary allows), cumulative segment lengths as attention kernels
take them, the places where positions start again at 0, and for each segment
the document, the piece's number and its place in the document's ids.

Which documents share a sequence follows from the tasks' splits of the input;
the ids of each document do not.

Defined results: null and empty texts are documents of the end id alone; each
input row is packed once, repeated ones and those with a null id as well; an
empty table gives no sequences.  An id beyond the stated vocabulary is an error.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from lightshelf.llm.common import plain_strings, slices
from lightshelf.llm.tokens import encode_texts

SHARD_TOKENS = 6_000_000


class FreeSpace:
    """Sequences by free capacity: a segment tree of counts over capacities, with a stack at each leaf."""

    def __init__(self, capacity: int) -> None:
        self.leaves = 1 << capacity.bit_length()
        self.count = [0] * (2 * self.leaves)
        self.held: list[list[int]] = [[] for _ in range(capacity + 1)]

    def add(self, free: int, sequence: int) -> None:
        self.held[free].append(sequence)
        i = free + self.leaves
        while i:
            self.count[i] += 1
            i >>= 1

    def take(self, size: int) -> tuple[int, int] | None:
        """Removes and returns (free capacity, sequence) with the least room for `size`, or None."""
        count, i = self.count, size + self.leaves
        if not count[i]:
            while True:  # up to the first subtree on the right with a sequence
                if i & 1 == 0 and count[i + 1]:
                    i += 1
                    break
                i >>= 1
                if i <= 1:
                    return None
            while i < self.leaves:
                i <<= 1
                if not count[i]:
                    i += 1
        free = i - self.leaves
        while i:
            count[i] -= 1
            i >>= 1
        return free, self.held[free].pop()


def best_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, int]:
    """The sequence of each piece, and how many sequences there are. Ties by order of appearance."""
    room, n = FreeSpace(capacity), 0
    out = np.zeros(len(lengths), np.int64)
    for i in np.argsort(-lengths, kind="stable").tolist():
        size = int(lengths[i])
        got = room.take(size)
        if got is None:
            free, sequence, n = capacity, n, n + 1
        else:
            free, sequence = got
        out[i] = sequence
        if free > size:
            room.add(free - size, sequence)
    return out, n


MATRIX = pa.schema([
    ("sequence_id", pa.int64()), ("n_tokens", pa.int32()), ("ids", pa.binary()), ("cu_seqlens", pa.list_(pa.int32())), ("position_resets", pa.list_(pa.int32())),
    ("doc_ids", pa.list_(pa.int64())), ("pieces", pa.list_(pa.int32())), ("starts", pa.list_(pa.int64())), ("ids_crc32", pa.int64()),
])
MATRIX_DDL = "sequence_id bigint, n_tokens int, ids binary, cu_seqlens array<int>, position_resets array<int>, doc_ids array<bigint>, pieces array<int>, starts array<bigint>, ids_crc32 bigint"


class Shard:
    """Pieces of documents that wait to be packed."""

    def __init__(self, capacity: int, end_id: int, pad_id: int, kind: str) -> None:
        self.capacity, self.end, self.pad, self.kind = capacity, end_id, pad_id, kind
        self.parts: list[tuple] = []
        self.tokens = 0

    def add(self, doc_ids: list, ids: np.ndarray, offsets: np.ndarray) -> None:
        for doc, a, b in zip(doc_ids, offsets[:-1].tolist(), offsets[1:].tolist()):
            full = np.append(ids[a:b], self.end).astype(self.kind)
            for k, start in enumerate(range(0, len(full), self.capacity)):
                self.parts.append((doc, k, start, full[start : start + self.capacity]))
        self.tokens += len(ids) + len(doc_ids)

    def packed(self, number: int) -> Iterator[pa.RecordBatch]:
        """Rows of MATRIX for what was added, which is then forgotten; sequence ids begin at `number`."""
        lengths = np.array([len(p[3]) for p in self.parts], np.int64)
        where, n = best_fit_decreasing(lengths, self.capacity)
        order = np.argsort(where, kind="stable")
        cuts = np.searchsorted(where[order], np.arange(n + 1))
        for first in range(0, n, 2000):
            rows: dict[str, list] = {k: [] for k in MATRIX.names}
            for s in range(first, min(n, first + 2000)):
                parts = [self.parts[i] for i in order[cuts[s] : cuts[s + 1]].tolist()]
                ends = np.cumsum([len(p[3]) for p in parts])
                line = np.full(self.capacity, self.pad, self.kind)
                line[: ends[-1]] = np.concatenate([p[3] for p in parts])
                values = (number + s, int(ends[-1]), line.tobytes(), [0, *ends.tolist()], [0, *ends[:-1].tolist()], [p[0] for p in parts], [p[1] for p in parts], [p[2] for p in parts], zlib.crc32(line[: ends[-1]].tobytes()))
                for k, v in zip(rows, values):
                    rows[k].append(v)
            yield pa.RecordBatch.from_arrays([pa.array(rows[k], t) for k, t in zip(MATRIX.names, MATRIX.types)], schema=MATRIX)
        self.parts, self.tokens = [], 0


def matrices(docs: DataFrame, path: str, ranks: str | None = None, capacity: int = 2048, end_id: int = 0, pad_id: int = 0, vocabulary: int = 50257) -> DataFrame:
    """Packed sequences of all documents; see the module's text. `ids` has `capacity` ids in each row."""
    kind = "<u2" if vocabulary <= 1 << 16 else "<u4"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        number = (task.partitionId() if task else 0) << 40
        shard = Shard(capacity, end_id, pad_id, kind)
        for batch in slices(batches, "text", 8 << 20):
            ids, offsets = encode_texts(plain_strings(batch.column("text")), path, ranks)
            if len(ids) and int(ids.max()) >= vocabulary:
                raise ValueError(f"id {int(ids.max())} is beyond a vocabulary of {vocabulary}")
            shard.add(batch.column("doc_id").to_pylist(), ids, offsets)
            if shard.tokens >= SHARD_TOKENS:
                for out in shard.packed(number):
                    number += out.num_rows
                    yield out
        if shard.parts:
            yield from shard.packed(number)

    return docs.select("doc_id", "text").mapInArrow(run, MATRIX_DDL)


def position_ids(cu_seqlens: list[int]) -> np.ndarray:
    """Positions of a sequence's ids: 0, 1, ... again from each segment's start."""
    ends = np.asarray(cu_seqlens)
    return np.arange(ends[-1]) - np.repeat(ends[:-1], np.diff(ends))


def write_matrices(packed: DataFrame, folder: str) -> None:
    """Writes packed sequences as Parquet files, compressed, in the order of their ids within each file."""
    packed.sortWithinPartitions("sequence_id").write.option("compression", "zstd").parquet(folder)
