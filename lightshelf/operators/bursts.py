"""Pairs near in time and in distance, by tiles of dense spans.

A pair belongs to the span of its earlier row, so that each span (some windows long)
gets its own rows and those of the next one's first window.  Spans with more rows than
`PART_NUMBERS` numbers of their vectors are dealt to parts by hash, and every two parts meet
in a task: a task holds two parts, however many rows a span has.
Within a task, matrix products leave the pairs that may be near, and their
distances are summed exactly as the column expressions do.

Where only links are asked for, rows that are joined already are not compared:
in a dense span one component soon holds nearly all of them, and tiles meet for
what is left outside.  Rows of equal time and vector stand behind one of them.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lightshelf.functions import scalar as S

#: Windows in a span, numbers in the vectors of a part (16 MB in doubles), rows of a tile's side, and pairs whose distances are summed at once.
SPAN, PART_NUMBERS, TILE, AT_ONCE = 4, 1 << 21, 512, 1 << 16
#: Pairs that a task sends on at once, and pairs after which it looks what is joined.
SENT, LOOK = 1 << 20, 1 << 11


def _exact(x: np.ndarray, y: np.ndarray, cosine: bool) -> np.ndarray:
    """Distances of rows, summed component by component in their order; NaN where there is none."""
    total = np.zeros((3, len(x)))
    for a, b in zip(x.T, y.T):
        if cosine:
            total += np.stack([a * b, a * a, b * b])
        else:
            total[0] += (a - b) * (a - b)
    if not cosine:
        return np.sqrt(total[0])
    norms = np.sqrt(total[1]) * np.sqrt(total[2])
    return 1.0 - total[0] / np.where(norms == 0, np.nan, norms)


def _may(dots: np.ndarray, x2: np.ndarray, y2: np.ndarray, most: float, cosine: bool) -> np.ndarray:
    """Which pairs may be near, by their products and squares."""
    if cosine:
        scale = np.sqrt(x2[:, None] * y2[None, :])
        return scale - dots <= (most + 1e-6) * scale
    scale = x2[:, None] + y2[None, :]
    return scale - 2 * dots <= most * most + 1e-6 * (1 + scale)


def _near(t: np.ndarray, x: np.ndarray, u: np.ndarray, y: np.ndarray, same: bool, most_gap: float, most: float, cosine: bool) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Places in x and in y of pairs near in time and distance, with their distances; rows lie in order of their times t and u."""
    x2, y2 = (x * x).sum(1), (y * y).sum(1)
    for i in range(0, len(x), TILE):
        e = min(i + TILE, len(x))
        for j in range(i if same else 0, len(y), TILE):
            f = min(j + TILE, len(y))
            if u[j] - t[e - 1] > most_gap or t[i] - u[f - 1] > most_gap:
                continue
            may = _may(x[i:e] @ y[j:f].T, x2[i:e], y2[j:f], most, cosine)
            may &= np.abs(t[i:e, None] - u[None, j:f]) <= most_gap
            p, q = np.nonzero(np.triu(may, 1) if same and i == j else may)
            for k in range(0, len(p), AT_ONCE):
                a, b = i + p[k : k + AT_ONCE], j + q[k : k + AT_ONCE]
                d = _exact(x[a], y[b], cosine)
                keep = d < most if cosine else d <= most
                yield a[keep], b[keep], d[keep]


def _spans(rows: DataFrame, seconds: float, part_numbers: int) -> DataFrame:
    """Rows (id, t, v) sent to the tasks of their span and of the one before: span, low, high (its parts), part, own, dims."""
    width = int(max(1, math.ceil(seconds))) * 1_000_000 * SPAN
    placed = rows.withColumn("dims", F.size("v")).withColumn("band", F.floor(F.col("t") / width))
    early = F.col("t") - F.col("band") * width <= seconds * 1e6  # what rows of the span before may be near to
    sent = placed.withColumn("own", F.explode(F.when(early, F.array(F.lit(True), F.lit(False))).otherwise(F.array(F.lit(True))))).withColumn("span", F.when(F.col("own"), F.col("band")).otherwise(F.col("band") - 1)).drop("band")
    size = F.greatest("dims", F.lit(1))
    numbers = placed.groupBy("band").agg(F.sum(size).alias("n"), F.coalesce(F.sum(F.when(early, size)), F.lit(0)).alias("m"))
    spans = F.explode(F.array(F.struct(F.col("band").alias("span"), "n"), F.struct((F.col("band") - 1).alias("span"), F.col("m").alias("n")))).alias("s")
    both = numbers.select(spans).groupBy("s.span").agg(F.ceil(F.sum("s.n") / part_numbers).cast("int").alias("parts"))
    crowded = both.where("parts > 1")
    dealt = sent.join(crowded, "span", "left").withColumn("parts", F.coalesce("parts", F.lit(1))).withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int"))
    met = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    return met.select("span", F.least("part", "other").alias("low"), F.greatest("part", "other").alias("high"), "dims", "part", "own", "id", "t", "v")


def _rows(key: tuple, table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, list[tuple[np.ndarray, np.ndarray, bool]]]:
    """Ids, times, parts and vectors of a task's rows in order of time, and the places of the rows that meet."""
    _, low, high, dims = (k.as_py() for k in key)
    table = table.take(pc.sort_indices(table, [("t", "ascending")])).combine_chunks()
    ids, t, part = (table.column(c).to_numpy() for c in ("id", "t", "part"))
    own = table.column("own").to_numpy()
    x = pc.list_flatten(table.column("v")).cast(pa.float64()).to_numpy().reshape(len(ids), dims)
    place = lambda p, mine: np.flatnonzero((part == p) & (own == mine))
    meetings = [(place(low, True), place(high, True), low == high), (place(low, True), place(high, False), False)]
    if low != high:
        meetings.append((place(high, True), place(low, False), False))
    return ids, t, part, x, meetings


def _found(key: tuple, table: pa.Table, seconds: float, most: float, cosine: bool) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Ids of the pairs of a task, the smaller first, with their distances."""
    ids, t, _, x, meetings = _rows(key, table)
    for a, b, same in meetings:
        for p, q, d in _near(t[a], x[a], t[b], x[b], same, seconds * 1e6, most, cosine):
            u, w = ids[a[p]], ids[b[q]]
            other = u != w
            yield np.minimum(u, w)[other], np.maximum(u, w)[other], d[other]


class _Joined:
    """The component of each row, by links as they are found."""

    def __init__(self, n: int) -> None:
        self.root = np.arange(n)

    def add(self, p: np.ndarray, q: np.ndarray) -> None:
        while True:
            a, b = self.root[p], self.root[q]
            apart = a != b
            if not apart.any():
                return
            p, q, a, b = p[apart], q[apart], a[apart], b[apart]
            np.minimum.at(self.root, np.maximum(a, b), np.minimum(a, b))
            while (self.root[self.root] != self.root).any():
                self.root = self.root[self.root]


def _links(key: tuple, table: pa.Table, seconds: float, most: float, cosine: bool) -> tuple[np.ndarray, np.ndarray]:
    """The smallest id of each component of a task and the others of it, comparing only rows that are not joined yet."""
    ids, t, part, x, meetings = _rows(key, table)
    joined, gap, x2 = _Joined(len(ids)), seconds * 1e6, (x * x).sum(1)
    near = lambda d: d < most if cosine else d <= most
    # -0.0 is another pattern than 0.0, so that such rows are compared as others are
    packed = np.ascontiguousarray(np.concatenate([np.stack([t, part], 1).astype(np.int64).view(np.float64), x], 1))
    _, first, back = np.unique(packed.view(np.dtype((np.void, packed.shape[1] * 8))).ravel(), return_index=True, return_inverse=True)
    first = first[back.ravel()]
    copies = np.flatnonzero((first != np.arange(len(ids))) & (ids[first] != ids))
    copies = copies[near(_exact(x[copies], x[first[copies]], cosine))]
    joined.add(first[copies], copies)
    shown = np.ones(len(ids), bool)
    shown[copies] = False

    def compare(a: np.ndarray, b: np.ndarray) -> None:
        if not len(a) or not len(b):
            return
        may = _may(x[a] @ x[b].T, x2[a], x2[b], most, cosine)
        may &= np.abs(t[a, None] - t[None, b]) <= gap
        may &= joined.root[a, None] != joined.root[None, b]
        p, q = np.nonzero(may)
        p, q = a[p], b[q]
        while len(p):
            u, w = p[:LOOK], q[:LOOK]
            hit = near(_exact(x[u], x[w], cosine)) & (ids[u] != ids[w])
            joined.add(u[hit], w[hit])
            p, q = p[LOOK:], q[LOOK:]
            apart = joined.root[p] != joined.root[q]
            p, q = p[apart], q[apart]

    for a, b, same in meetings:
        a, b = a[shown[a]], b[shown[b]]
        for i in range(0, len(a), TILE):
            u = a[i : i + TILE]
            for j in range(i if same else 0, len(b), TILE):
                w = b[j : j + TILE]
                if t[w[0]] - t[u[-1]] > gap or t[u[0]] - t[w[-1]] > gap:
                    continue
                r, s = joined.root[u], joined.root[w]
                most_have = np.bincount(np.r_[r, s]).argmax()
                compare(u[r != most_have], w)
                if not (same and i == j):
                    compare(u[r == most_have], w[s != most_have])
    least = np.full(len(ids), np.iinfo(np.int64).max)
    np.minimum.at(least, joined.root, ids)
    least = least[joined.root]
    other = least != ids
    return least[other], ids[other]


def near_pairs(photos: DataFrame, seconds: float, most: float, vector: str = "embedding", cosine: bool = True, links: bool = False, part_numbers: int = PART_NUMBERS) -> DataFrame:
    """id, o_id (the larger) and distance of pairs within `seconds` and nearer than `most` (or as near, by Euclidean distance).

    With `links`, id and o_id of fewer links in each task than it has rows, which join what the pairs join: the least id of each component there (id) and the others.
    """
    rows = photos.where(F.col("taken_ts").isNotNull() & F.col(vector).isNotNull()).select(F.col("id").cast("bigint").alias("id"), S.micros("taken_ts").alias("t"), F.col(vector).alias("v"))

    def run(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(list(batches))
        if links:
            a, b = _links(key, table, seconds, most, cosine)
            yield _batch([(a, b, np.zeros(len(a)))])
            return
        # spans of few rows come in one batch
        held, n = [], 0
        for found in _found(key, table, seconds, most, cosine):
            held.append(found)
            n += len(found[0])
            if n >= SENT:
                yield _batch(held)
                held, n = [], 0
        if held:
            yield _batch(held)

    def _batch(held: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate([h[i] for h in held]), k) for i, k in enumerate((pa.int64(), pa.int64(), pa.float64()))], ["id", "o_id", "distance"])

    found = _spans(rows, seconds, part_numbers).groupBy("span", "low", "high", "dims").applyInArrow(run, "id bigint, o_id bigint, distance double")
    return found.drop("distance") if links else found
