"""Pairs within a radius, and what follows from them, without comparing blocks that cannot hold any.

1. A few pivots, spread over a bounded sample, divide the rows into cells by
   nearest pivot.  Rows are put in order of key, cell and distance to the
   pivot, and consecutive ones are packed to blocks of a bounded size: many
   small keys share a block, a large key or a crowded cell has many.
2. A block knows its keys and the least and largest distance of its rows to
   every pivot.  For any pivot p, d(x, y) >= |d(x, p) - d(y, p)|: two blocks
   whose ranges of distances to some pivot lie further apart than the radius
   hold no pair, nor do blocks without a key in common.  Only what is left is sent.
3. Blocks form strips of up to `SIDE`; two strips with pairs of blocks left are
   one task, which gets the blocks concerned and goes through them in tiles.
4. What a task reports depends on what is asked: the pairs; how many
   neighbours each row has; or links enough to join what belongs together, of
   which a task has fewer than rows, however dense a clump is.

The pivots only decide how much is skipped, never what is found.  Vectors near
no structure at all (independent directions in many dimensions) have nearly
equal distances to any pivot: nothing can be skipped there, and all blocks of a key meet.

Rows with null vectors are left out; vectors of one table have one length.  Keys
may be null: rows without a key are compared with each other, as those of a key of their own.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lightshelf.operators.lineage import written

#: Rows of a tile's side, numbers in the vectors of a block (4 MB), and blocks in a strip as a power of two.
TILE, BLOCK_NUMBERS, SIDE_BITS = 1024, 1 << 19, 3
#: Pivots, and rows of the sample from which they are taken.
PIVOTS, SAMPLE = 32, 1024
#: Blocks whose bounds are compared in one task with as many others.
CHUNK = 2048
#: Answers of tiles that a task holds before it gathers them, if they are not more when gathered.
HELD = 1 << 18
#: Room for rounding where distances bound each other.
SLACK = 1e-6

PACKED = "ids binary, vectors binary, flags binary, keys array<string>, counts array<int>, lo array<double>, hi array<double>"
Reduce = Callable[[dict, dict, np.ndarray, np.ndarray, np.ndarray], pd.DataFrame]


def _distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum((x * x).sum(1)[:, None] + (y * y).sum(1)[None, :] - 2 * x @ y.T, 0))


def _spread(sample: np.ndarray, most: int) -> np.ndarray:
    """Rows of the sample, each as far as possible from those before."""
    chosen, far = [0], np.full(len(sample), np.inf)
    while len(chosen) < min(most, len(sample)):
        far = np.minimum(far, np.sqrt(((sample - sample[chosen[-1]]) ** 2).sum(1)))
        if far.max() <= 0:
            break
        chosen.append(int(far.argmax()))
    points = sample[chosen]
    # in a row, each beside the nearest that is left, as blocks may hold the end of one cell and the beginning of the next
    row, left = [0], set(range(1, len(points)))
    while left:
        row.append(min(left, key=lambda i: float(((points[i] - points[row[-1]]) ** 2).sum())))
        left.remove(row[-1])
    return points[row]


def _vectors(column: pa.Array) -> np.ndarray:
    flat = pc.list_flatten(column).cast(pa.float64()).to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1)


def packed_blocks(df: DataFrame, vector: str = "embedding", id_col: str = "vec_id", by: str | None = None, flag: str | None = None, pivots: int = PIVOTS, block_numbers: int = BLOCK_NUMBERS) -> DataFrame:
    """Rows packed to blocks, a row for each, written to the shared folder."""
    key = F.lit("") if by is None else F.coalesce(F.concat(F.lit("="), F.col(by).cast("string")), F.lit(""))
    rows = df.where(F.col(vector).isNotNull()).select(key.alias("k"), F.col(id_col).cast("bigint").alias("id"), F.col(vector).alias("v"), (F.lit(False) if flag is None else F.col(flag)).alias("f"))
    sample = rows.orderBy(F.xxhash64("id"), "id").select("v").limit(SAMPLE).collect()  # of a fixed number
    points = _spread(np.array([r[0] for r in sample], float), pivots) if sample else np.zeros((1, 0))
    numbers = rows.agg(F.coalesce(F.sum(F.size("v")), F.lit(0))).first()[0]
    per_block = max(1, block_numbers // max(1, points.shape[1]))
    parts = max(2, -(-numbers // (block_numbers << SIDE_BITS)))

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            d = _distances(_vectors(batch.column("v")), points)
            cell = d.argmin(1)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("k", "id", "v", "f")), pa.array(cell, pa.int32()), pa.array(d[np.arange(len(d)), cell])], ["k", "id", "v", "f", "cell", "near"])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n, cell = [], 0, None
        for batch in batches:
            cells = batch.column("cell").to_numpy()
            ends = np.flatnonzero(np.r_[cells[:1] != cell if len(cells) and cell is not None else [], cells[1:] != cells[:-1]].astype(bool)) + (cell is None)
            at = 0
            while at < len(cells):
                # a block ends where a cell does if a quarter of it is full, and when it is full
                upto = min(len(cells), at + per_block - n)
                i = int(np.searchsorted(ends, at + max(0, -(-per_block // 4) - n)))
                closed = i < len(ends) and ends[i] <= upto
                upto = int(ends[i]) if closed else upto
                if upto > at:
                    held.append(batch.slice(at, upto - at))
                n, at = n + upto - at, upto
                if n == per_block or closed and n:
                    yield _block(held, points)
                    held, n = [], 0
            cell = cells[-1] if len(cells) else cell
        if n:
            yield _block(held, points)

    kind = dict(rows.dtypes)["v"]
    order = ["k", "cell", "near", "id"]
    placed = rows.mapInArrow(assign, f"k string, id bigint, v {kind}, f boolean, cell int, near double").repartitionByRange(parts, *order).sortWithinPartitions(*order)
    # the id of a block holds its partition and its place there; eight that follow each other are a strip
    return written(placed.select("k", "id", "v", "f", "cell").mapInArrow(pack, PACKED).withColumn("block", F.monotonically_increasing_id()))


def _block(batches: list[pa.RecordBatch], points: np.ndarray) -> pa.RecordBatch:
    rows = pa.Table.from_batches(batches).combine_chunks().to_batches()[0]
    x = _vectors(rows.column("v"))
    d = _distances(x, points)
    runs = pc.run_end_encode(rows.column("k"))
    ends = np.asarray(runs.run_ends)
    flags = rows.column("f").to_numpy(zero_copy_only=False).astype(bool)
    one = [rows.column("id").to_numpy().astype(np.int64).tobytes(), x.tobytes(), flags.tobytes(), runs.values.to_pylist(), np.diff(np.r_[0, ends]).tolist(), d.min(0).tolist(), d.max(0).tolist()]
    kinds = [pa.binary()] * 3 + [pa.list_(pa.string()), pa.list_(pa.int32()), pa.list_(pa.float64()), pa.list_(pa.float64())]
    return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(one, kinds)], [c.split()[0] for c in PACKED.split(", ")])


def _strip(block: str = "block") -> Column:
    return F.shiftright(block, SIDE_BITS)


def _may_meet(a: dict, b: dict, radius: float) -> np.ndarray:
    """Which blocks of `a` (lo, hi, first, last as arrays) may hold a pair with which of `b`."""
    out = (a["first"][:, None] <= b["last"][None, :]) & (b["first"][None, :] <= a["last"][:, None])
    for p in range(a["lo"].shape[1]):
        out &= (a["lo"][:, p, None] - b["hi"][None, :, p] <= radius + SLACK) & (b["lo"][None, :, p] - a["hi"][:, p, None] <= radius + SLACK)
    return out


def near_blocks(packed: DataFrame, radius: float) -> DataFrame:
    """a, b: blocks that may hold a pair within the radius, each with itself too (a <= b), by their bounds alone."""
    meta = packed.select("block", F.element_at("keys", 1).alias("first"), F.element_at("keys", -1).alias("last"), "lo", "hi")
    chunks = max(1, -(-meta.count() // CHUNK))
    dealt = meta.withColumn("c", F.pmod(F.xxhash64("block"), F.lit(chunks)).cast("int")).withColumn("p", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))))
    sent = dealt.withColumn("low", F.least("c", "p")).withColumn("high", F.greatest("c", "p")).drop("p")

    def meet(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        names = {k: i for i, k in enumerate(sorted({*rows["first"], *rows["last"]}, key=lambda k: k.encode()))}
        sides = []
        for c in key:
            side = rows[rows.c == c]
            sides.append({"block": side.block.to_numpy(), "first": side["first"].map(names).to_numpy(), "last": side["last"].map(names).to_numpy(), "lo": np.stack(side.lo.to_numpy()) if len(side) else np.zeros((0, 1)), "hi": np.stack(side.hi.to_numpy()) if len(side) else np.zeros((0, 1))})
        a, b = sides
        if not len(a["block"]) or not len(b["block"]):
            return pd.DataFrame({"a": [], "b": []}).astype("int64")
        i, j = np.nonzero(_may_meet(a, b, radius))
        x, y = a["block"][i], b["block"][j]
        keep = x <= y if key[0] == key[1] else np.ones(len(x), bool)
        return pd.DataFrame({"a": np.minimum(x, y)[keep], "b": np.maximum(x, y)[keep]})

    return sent.groupBy("low", "high").applyInPandas(meet, "a bigint, b bigint")


def compared_share(packed: DataFrame, radius: float) -> float:
    """Share of all pairs of blocks that are compared."""
    n = packed.count()
    return near_blocks(packed, radius).count() / max(1, n * (n + 1) // 2)


def _unpacked(row: dict) -> dict:
    ids = np.frombuffer(row["ids"], np.int64)
    ends = np.cumsum(row["counts"])
    where = {k: (e - n, e) for k, n, e in zip(row["keys"], row["counts"], ends.tolist())}
    return {"block": row["block"], "ids": ids, "x": np.frombuffer(row["vectors"]).reshape(len(ids), -1), "flags": np.frombuffer(row["flags"], bool), "where": where}


def _tiles(a: dict, b: dict, radius: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Places p in `a` and q in `b` of pairs within the radius, with their distances; within one block each pair once."""
    same = a["block"] == b["block"]
    for key in a["where"].keys() & b["where"].keys():
        (a0, a1), (b0, b1) = a["where"][key], b["where"][key]
        for i in range(a0, a1, TILE):
            t = a["x"][i : min(i + TILE, a1)]
            for j in range(i if same else b0, b1, TILE):
                u = b["x"][j : min(j + TILE, b1)]
                p, q = np.nonzero((t * t).sum(1)[:, None] + (u * u).sum(1)[None, :] - 2 * t @ u.T <= radius * radius + 1e-9)
                if same and i == j:
                    p, q = p[p < q], q[p < q]
                if len(p):
                    exact = np.concatenate([np.sqrt(((t[p[k : k + 65536]] - u[q[k : k + 65536]]) ** 2).sum(1)) for k in range(0, len(p), 65536)])
                    keep = exact <= radius
                    if keep.any():
                        yield i + p[keep], j + q[keep], exact[keep]


def _compared(packed: DataFrame, radius: float, reduce: Reduce, gather: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """`reduce` for the pairs of each tile and `gather` over a task's tiles."""
    pairs = written(near_blocks(packed, radius))
    sides = pairs.select(F.col("a").alias("block"), _strip("a").alias("low"), _strip("b").alias("high")).unionByName(pairs.select(F.col("b").alias("block"), _strip("a").alias("low"), _strip("b").alias("high"))).distinct()
    sent = packed.join(sides, "block")
    names = [c.split()[0] for c in schema.split(", ")]

    def compare(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        most = HELD
        held = [(r, _unpacked(r)) for r in rows.sort_values("block").to_dict("records")]
        bounds = [{"lo": np.array([r["lo"]]), "hi": np.array([r["hi"]]), "first": np.zeros(1), "last": np.zeros(1)} for r, _ in held]
        out, n = [], 0
        for i, (r, a) in enumerate(held):
            if r["block"] >> SIDE_BITS != key[0]:
                continue
            for j in range(i, len(held)):
                s, b = held[j]
                if s["block"] >> SIDE_BITS == key[1] and _may_meet(bounds[i], bounds[j], radius)[0, 0]:
                    for found in _tiles(a, b, radius):
                        out.append(reduce(a, b, *found))
                        n += len(out[-1])
                        if n > most:
                            # what is gathered may be as much again before the next time
                            out = [gather(pd.concat(out))]
                            n, most = len(out[0]), max(HELD, 2 * len(out[0]))
        return gather(pd.concat(out)) if out else pd.DataFrame({c: [] for c in names})

    tasks = max(8, int(packed.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return sent.repartition(tasks, "low", "high").groupBy("low", "high").applyInPandas(compare, schema)


def pairs_within(packed: DataFrame, radius: float) -> DataFrame:
    """a, b (a < b) and distance of all pairs within the radius."""

    def named(a: dict, b: dict, p: np.ndarray, q: np.ndarray, d: np.ndarray) -> pd.DataFrame:
        u, w = a["ids"][p], b["ids"][q]
        frame = pd.DataFrame({"a": np.minimum(u, w), "b": np.maximum(u, w), "distance": d})
        return frame[u != w]

    return _compared(packed, radius, named, lambda found: found, "a bigint, b bigint, distance double")


def neighbours(packed: DataFrame, radius: float) -> DataFrame:
    """id and n, how many others lie within the radius; rows without any are not listed."""

    def counted(a: dict, b: dict, p: np.ndarray, q: np.ndarray, d: np.ndarray) -> pd.DataFrame:
        ids, n = np.unique(np.r_[a["ids"][p], b["ids"][q]], return_counts=True)
        return pd.DataFrame({"id": ids, "n": n})

    each = _compared(packed, radius, counted, lambda found: found.groupby("id", as_index=False).n.sum(), "id bigint, n bigint")
    return each.groupBy("id").agg(F.sum("n").alias("n"))


def _joined(frame: pd.DataFrame) -> pd.DataFrame:
    """Links a-b as fewer links that join the same rows: each row with the smallest of its component."""
    ids, where = np.unique(frame[["a", "b"]].to_numpy(), return_inverse=True)
    where = where.reshape(-1, 2)
    root = np.arange(len(ids))
    while True:
        low = root[where].min(1)
        new = root.copy()
        for side in (0, 1):
            np.minimum.at(new, where[:, side], low)
            np.minimum.at(new, root[where[:, side]], low)
        while (new[new] != new).any():
            new = new[new]
        if (new == root).all():
            break
        root = new
    own = np.flatnonzero(root != np.arange(len(ids)))
    return pd.DataFrame({"a": ids[root[own]], "b": ids[own]})


def joining_links(packed: DataFrame, radius: float) -> DataFrame:
    """Links a-b that join what pairs within the radius join: fewer than rows in each task."""

    def links(a: dict, b: dict, p: np.ndarray, q: np.ndarray, d: np.ndarray) -> pd.DataFrame:
        return _joined(pd.DataFrame({"a": a["ids"][p], "b": b["ids"][q]}))

    return _compared(packed, radius, links, _joined, "a bigint, b bigint")


def core_links(packed: DataFrame, radius: float) -> DataFrame:
    """Links of density clusters (a, b, border): joining ones between flagged rows, and for each other row those to flagged ones (b).

    An unflagged row has fewer neighbours than make a core, so that it has few links.
    """

    def links(a: dict, b: dict, p: np.ndarray, q: np.ndarray, d: np.ndarray) -> pd.DataFrame:
        u, w, f, g = a["ids"][p], b["ids"][q], a["flags"][p], b["flags"][q]
        out = [_joined(pd.DataFrame({"a": u[f & g], "b": w[f & g]})).assign(border=False)]
        for x, y, edge in ((u, w, ~f & g), (w, u, f & ~g)):
            out.append(pd.DataFrame({"a": x[edge], "b": y[edge], "border": True}))
        return pd.concat(out)

    def gather(found: pd.DataFrame) -> pd.DataFrame:
        inner = found.border.to_numpy(bool)
        return pd.concat([_joined(found[~inner]).assign(border=False), found[inner]])

    return _compared(packed, radius, links, gather, "a bigint, b bigint, border boolean")
