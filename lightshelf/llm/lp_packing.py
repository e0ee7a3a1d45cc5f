"""Best-fit packing of documents into sequences by a configuration linear program.

1. Documents are encoded; longer ones are cut into pieces of the capacity, of
   which the first may be shorter.  Pieces (ids, place, length, checksum) are
   written once.
2. Their length histogram, of at most `capacity` entries whatever the corpus,
   goes to the driver.  There the configuration program - fewest sequences so
   that every length is covered - is solved by multiplicative weights, whatever
   the number of pieces: lengths lose weight as they are covered, and knapsack
   dynamic programming prices the best fillings.
3. It is rounded down to whole copies; what is left goes through the same
   again, and the last lengths are filled largest first, each with the
   fullest completion that a subset-sum over the remaining lengths finds.
4. Each piece's rank among those of its length picks its sequence and place.
   Ranks are counted within hash buckets and shifted by the buckets before, so
   that a length that a third of all pieces have is no single task's load.

Defined results: null and empty texts are documents of one token (the end id);
each input row is one document; rows that repeat are packed each, and so are
rows with a null id.  An empty table gives an empty result.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lightshelf.llm.common import plain_strings, slices, stored
from lightshelf.llm.tokens import encode_texts

PIECES = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, source_row bigint"


def token_pieces(docs: DataFrame, path: str, ranks: str | None, capacity: int, end_id: int) -> DataFrame:
    """A row for each piece of each document: place, length and checksum of its ids.

    source_row tells rows of equal doc_id apart.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("source_row", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 3 << 20):
            ids, offsets = encode_texts(plain_strings(batch.column("text")), path, ranks)
            size = np.diff(offsets) + 1
            n_pieces = -(-size // capacity)
            doc = np.repeat(np.arange(len(size)), n_pieces)
            piece = np.arange(len(doc)) - np.repeat(np.cumsum(n_pieces) - n_pieces, n_pieces)
            first = (size - 1) % capacity + 1
            start = np.where(piece > 0, first[doc] + (piece - 1) * capacity, 0)
            length = np.where(piece > 0, capacity, first[doc])
            last = piece == n_pieces[doc] - 1
            end = np.array([end_id], "<u4").tobytes()
            raw = memoryview(ids.astype("<u4")).cast("B")
            a = (offsets[doc] + start) * 4
            b = a + (length - last) * 4
            crc = [zlib.crc32(end, zlib.crc32(raw[x:y])) if z else zlib.crc32(raw[x:y]) for x, y, z in zip(a.tolist(), b.tolist(), last.tolist())]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()).take(pa.array(doc)), pa.array(piece.astype(np.int32)), pa.array(start), pa.array(length), pa.array(crc, pa.int64()), batch.column("_row").take(pa.array(doc))], schema=schema)

    return docs.select("doc_id", "text", F.monotonically_increasing_id().alias("_row")).mapInArrow(run, PIECES)


# --- the program over the histogram ----------------------------------------

#: Rounds of weights in one pass, fillings taken from one pricing, and the weights' step.
ROUNDS, FILLINGS, STEP = 60, 96, 0.5
#: Power of a size by which a piece is worth more at first.
LARGE = 0.1
#: Passes over what is left, and the share of it that a pass must use to be followed by another.
PASSES, LEAST_USE = 12, 0.1


def _knapsack(sizes: np.ndarray, values: np.ndarray, most: np.ndarray, capacity: int) -> tuple[np.ndarray, list[tuple[int, int]], np.ndarray]:
    """Best value for each capacity when each size may be used `most` times.

    Also the items (size number, copies) that the sizes were split into, and
    for each capacity which items were taken when they were tried.
    """
    best = np.zeros(capacity + 1)
    items: list[tuple[int, int]] = []
    # large sizes first: of fillings that are worth the same, those with large ones stay
    for i in np.flatnonzero((values > 0) & (most > 0))[::-1].tolist():
        rest, copies = int(most[i]), 1
        while rest > 0:
            items.append((i, min(copies, rest)))
            rest -= copies
            copies *= 2
    taken = np.zeros((len(items), capacity + 1), bool)
    for row, (i, copies) in zip(taken, items):
        size = int(sizes[i]) * copies
        got = best[: capacity + 1 - size] + values[i] * copies
        np.greater(got, best[size:] + 1e-15, out=row[size:])
        np.maximum(best[size:], got, out=best[size:])
    return best, items, np.ascontiguousarray(taken.T)


def _trace(sizes: np.ndarray, items: list[tuple[int, int]], taken: np.ndarray, c: int) -> list[int]:
    """Size numbers of the best filling of capacity `c`."""
    out, end = [], len(items)
    while end:
        there = np.flatnonzero(taken[c, :end])
        if not len(there):
            break
        end = int(there[-1])
        i, copies = items[end]
        out += [i] * copies
        c -= int(sizes[i]) * copies
    return out


def weighted_fillings(left: np.ndarray, capacity: int) -> tuple[dict[tuple[int, ...], float], float]:
    """Solution of the covering program by multiplicative weights: fillings (sizes, descending) with counts of at least 1.

    Also the largest lower bound on the program's optimum that the prices gave:
    no filling is worth more than the best one, so that all pieces' worth, over
    the best filling's, is a bound.
    """
    sizes = np.flatnonzero(left)
    need = left[sizes].astype(float)
    total = float((sizes * need).sum()) / capacity
    # as many fillings as sequences are needed, up to a bound; so each is used once at least
    rounds = max(1, min(ROUNDS, math.ceil(total)))
    some = max(1, min(FILLINGS, math.ceil(total / rounds)))
    per = max(1.0, total / (rounds * some))
    # large pieces are harder to place: they are worth more by size from the start
    first = (sizes / capacity) ** LARGE
    weight, covered = first, np.zeros(len(sizes))
    found: dict[tuple[int, ...], float] = {}
    bound = total  # by prices that are the sizes
    for _ in range(rounds):
        # a piece is worth its share of a sequence, less the more of its length is covered
        behind = covered < need
        values = np.where(behind, weight * sizes / capacity, 0.0)
        most = np.minimum(need, capacity // sizes).astype(np.int64)
        best, items, taken = _knapsack(sizes, values, most, capacity)
        if best[capacity] <= 0:
            break
        bound = max(bound, float((values * need).sum()) / best[capacity])
        worth = np.round(values + best[capacity - sizes], 9)
        for i in np.lexsort((-sizes, -worth, ~behind))[:some].tolist():
            chosen = [i, *_trace(sizes, items, taken, capacity - int(sizes[i]))]
            key = tuple(sorted((int(sizes[j]) for j in chosen), reverse=True))
            found[key] = found.get(key, 0.0) + per
            for j in chosen:
                covered[j] += per
        weight = first * np.exp(-STEP * covered / need * min(1.0, ROUNDS / 10))
    return found, bound


def fill_up(left: np.ndarray, free: int) -> list[int]:
    """Lengths, each at most as often as left, whose sum is as near below `free` as any can be (large ones first)."""
    reach, steps = 1, []
    mask = (1 << free + 1) - 1
    full = 1 << free
    for size in np.flatnonzero(left[: free + 1])[::-1].tolist():
        for _ in range(min(int(left[size]), free // size)):
            steps.append((size, reach))
            reach |= reach << size & mask
            if reach & full:
                break
        if reach & full:
            break
    c, out = reach.bit_length() - 1, []
    for size, before in reversed(steps):
        if not before >> c & 1:
            out.append(size)
            c -= size
    return out


def taken_from_program(left: np.ndarray, capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Whole copies of the program's fillings, full ones first, as far as `left` has their lengths; takes them from `left`."""
    out = []
    for _ in range(PASSES):
        before = int(left.sum())
        if not before:
            break
        found, _ = weighted_fillings(left, capacity)
        for key, x in sorted(found.items(), key=lambda kx: (-sum(kx[0]), -kx[1], kx[0])):
            if sum(key) * 200 < capacity * 199:
                break  # fillings with room left wait for the last step
            used = {size: key.count(size) for size in set(key)}
            copies = min(int(x + 1e-9), *(int(left[s]) // k for s, k in used.items()))
            if copies > 0:
                out.append((key, copies))
                for s, k in used.items():
                    left[s] -= copies * k
        if int(left.sum()) > (1 - LEAST_USE) * before:
            break
    return out


def fillings(histogram: np.ndarray, capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Fillings with whole numbers of copies that use every length exactly as often as the histogram (by length) has it."""
    left = histogram.astype(np.int64).copy()
    out: list[tuple[tuple[int, ...], int]] = []
    if left[capacity]:
        out.append(((capacity,), int(left[capacity])))
        left[capacity] = 0
    out += taken_from_program(left, capacity)
    while left.any():
        largest = int(np.flatnonzero(left)[-1])
        left[largest] -= 1
        key = (largest, *fill_up(left, capacity - largest))
        left[largest] += 1
        used = {size: key.count(size) for size in set(key)}
        copies = max(1, min(int(left[s]) // k for s, k in used.items()))
        out.append((tuple(sorted(key, reverse=True)), copies))
        for s, k in used.items():
            left[s] -= copies * k
    return out


def places(found: list[tuple[tuple[int, ...], int]]) -> pd.DataFrame:
    """For each length, which ranks go to which fillings: rank range, first sequence, place and multiplicity."""
    rows, used, sequence = [], {}, 0
    for key, copies in found:
        offset = 0
        for size in sorted(set(key), reverse=True):
            times = key.count(size)
            start = used.get(size, 0)
            rows.append((size, start, start + copies * times, sequence, times, offset))
            used[size] = start + copies * times
            offset += size * times
        sequence += copies
    return pd.DataFrame(rows, columns=["size", "first_rank", "end_rank", "first_sequence", "times", "place"]).sort_values(["size", "first_rank"], ignore_index=True)


def pack(docs: DataFrame, path: str, ranks: str | None = None, capacity: int = 2048, end_id: int = 0) -> DataFrame:
    """Pieces of all documents with their sequence and place in it."""
    spark = docs.sparkSession
    pieces = stored(token_pieces(docs, path, ranks, capacity, end_id))
    histogram = np.zeros(capacity + 1, np.int64)
    for length, n in pieces.groupBy("length").count().collect():  # at most `capacity` rows
        histogram[length] = n
    table = places(fillings(histogram, capacity))
    n_buckets = max(8, int(spark.conf.get("spark.sql.shuffle.partitions")))
    dealt = pieces.withColumn("_bucket", F.pmod(F.xxhash64("doc_id", "piece", "source_row"), F.lit(n_buckets)))
    counts = dealt.groupBy("length", "_bucket").agg(F.count("*").alias("_n"))
    before = counts.select("length", "_bucket", (F.sum("_n").over(Window.partitionBy("length").orderBy("_bucket")) - F.col("_n")).alias("_before"))
    within = Window.partitionBy("length", "_bucket").orderBy("doc_id", "piece", "source_row")
    ranked = dealt.withColumn("_in", F.row_number().over(within) - 1).join(before, ["length", "_bucket"]).withColumn("_rank", F.col("_in") + F.col("_before"))
    held = spark.sparkContext.broadcast({k: table[k].to_numpy() for k in table})  # bounded by the lengths' fillings

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = held.value
        key = t["size"].astype(np.int64) << 44 | t["first_rank"]
        for batch in batches:
            size, rank = batch.column("length").to_numpy(), batch.column("_rank").to_numpy()
            row = np.searchsorted(key, size << 44 | rank, side="right") - 1
            k = rank - t["first_rank"][row]
            sequence = t["first_sequence"][row] + k // t["times"][row]
            offset = t["place"][row] + k % t["times"][row] * size
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")), pa.array(sequence.astype(np.int64)), pa.array(offset.astype(np.int64))], ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return ranked.select("doc_id", "piece", "start", "length", "ids_crc32", "_rank").mapInArrow(place, "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, sequence_id bigint, offset bigint")
