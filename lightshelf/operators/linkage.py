"""Average linkage of scopes of any size: rounds of reciprocal nearest clusters over sums of distances.

The distance of two clusters is the mean of their rows' distances, so the sum of
distances between clusters is all that a merge needs: sums of merged clusters
add up.  Average linkage is reducible (a merged cluster is no nearer to a third
than the nearer of its parts was), hence all pairs of clusters that are each
other's nearest may be merged in one round, and the merges are those of
merging the nearest pair again and again.

`near_linkage` does so in a task that holds the vectors of a scope and a bounded
number of its nearest pairs of clusters.  Merges below a distance need no pair
beyond it: a merged cluster is the weighted mean of its parts, so that it is near
a third one only if a part was.  `merges`, for still larger scopes, has a table
of all pairs.  There a round is three aggregates and two joins on cluster ids;
the table shrinks with the square of the clusters left.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lightshelf.operators.lineage import written
from lightshelf.operators.radius import packed_blocks, pairs_within
from lightshelf.operators.scans import row_numbers
from lightshelf.operators.similar import FEW, LEAST_CUT, clusters_below, connected, cut_height

#: Photos of one scope that are linked in a task (64 MB of 64 numbers each), near pairs of clusters listed there for each
#: merge that is wanted, rows of a tile's side, and pairs of rows whose distances are summed at once.
MAX_NEAR, NEAR_PAIRS, TILE, AT_ONCE = 1 << 17, 32, 1024, 1 << 15


def _places(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """starts[0], starts[0] + 1, ... of so many numbers as counts[0] says, then those of the next."""
    ends = np.cumsum(counts)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - ends + counts, counts)


def _tiles(x: np.ndarray, starts: np.ndarray, counts: np.ndarray) -> Iterator[tuple[int, int, np.ndarray, bool]]:
    """First cluster of either side and the sums of distances between the clusters of two tiles; x lies in order of clusters.

    Between clusters of one row they are squares of the distances, with a flag.
    """
    square = (x * x).sum(1)
    cuts, n = [0], 0
    for c, m in enumerate(counts.tolist()):
        if n and n + m > TILE:
            cuts.append(c)
            n = 0
        n += m
    cuts.append(len(counts))
    ends = np.r_[starts, len(x)]

    def blocks(c: int, e: int) -> Iterator[tuple[slice, np.ndarray | None]]:
        """Rows of the tile of clusters c to e and their clusters' places in it; only a cluster of its own may have several blocks."""
        for r in range(ends[c], ends[e], TILE):
            rows = slice(r, min(r + TILE, ends[e]))
            yield rows, None if rows.stop - rows.start == e - c else starts[c:e] - starts[c]

    for i in range(len(cuts) - 1):
        for j in range(i if cuts[i + 1] - cuts[i] > 1 else i + 1, len(cuts) - 1):
            total, single = 0, ends[cuts[i + 1]] - ends[cuts[i]] == cuts[i + 1] - cuts[i] and ends[cuts[j + 1]] - ends[cuts[j]] == cuts[j + 1] - cuts[j]
            for p, first in blocks(cuts[i], cuts[i + 1]):
                for q, second in blocks(cuts[j], cuts[j + 1]):
                    d = x[p] @ x[q].T
                    d *= -2
                    d += square[p, None]
                    d += square[None, q]
                    if not single:
                        np.sqrt(np.maximum(d, 0, out=d), out=d)
                    d = d if first is None else np.add.reduceat(d, first, axis=0)
                    total = total + (d if second is None else np.add.reduceat(d, second, axis=1))
            yield cuts[i], cuts[j], total, single


def _near_clusters(x: np.ndarray, where: np.ndarray, size: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, float, bool]:
    """a, b (a < b) and sum of the pairs of clusters nearer than a limit, which is as high as some `most` pairs allow, and the limit.

    If more pairs than that are the nearest of all, some of these, with a flag.
    """
    order = np.argsort(where, kind="stable")
    starts = np.cumsum(size) - size
    limit, held, n = np.inf, [], 0
    tied: tuple | None = None

    def kept() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        a, b, s = (np.concatenate([h[i] for h in held]) if held else np.zeros(0, t) for i, t in enumerate((int, int, float)))
        near = s / (size[a] * size[b]) < limit
        return a[near], b[near], s[near]

    for i, j, total, single in _tiles(x[order], starts, size):
        if single:
            near = total < limit * limit
        else:
            near = total < limit * (size[i : i + total.shape[0], None] * size[None, j : j + total.shape[1]])
        p, q = np.nonzero(np.triu(near, 1) if i == j else near)
        held.append((i + p, j + q, np.sqrt(np.maximum(total[p, q], 0)) if single else total[p, q]))
        n += len(p)
        if n > 2 * most:
            a, b, s = kept()
            mean = s / (size[a] * size[b])
            limit = float(np.partition(mean, most)[most])
            if limit == mean.min():
                at = np.flatnonzero(mean == limit)[:most]
                tied = a[at], b[at], s[at]
            held = [(a, b, s)]
            held = [kept()]
            n = len(held[0][0])
    a, b, s = kept()
    if not len(a) and tied:
        return *tied, limit, True
    return a, b, s, limit, False


def _sums(x: np.ndarray, where: np.ndarray, size: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Sums of the distances between the rows of clusters a and b, pair by pair."""
    order = np.argsort(where, kind="stable")
    starts = np.cumsum(size) - size
    out, rows = np.zeros(len(a)), size[a] * size[b]
    ends = np.cumsum(rows)
    at = 0
    while at < len(a):
        upto = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + AT_ONCE, "right")))
        if upto == at + 1:
            u, w = (x[order[starts[c] : starts[c] + size[c]]] for c in (a[at], b[at]))
            for i in range(0, len(u), max(1, AT_ONCE // len(w))):
                t = u[i : i + max(1, AT_ONCE // len(w))]
                out[at] += np.sqrt(np.maximum((t * t).sum(1)[:, None] + (w * w).sum(1)[None, :] - 2 * t @ w.T, 0)).sum()
        else:
            u, w = a[at:upto], b[at:upto]
            left = _places(starts[u], size[u])  # rows of the first clusters, each with all of the second
            times = np.repeat(size[w], size[u])
            i, j = order[np.repeat(left, times)], order[_places(np.repeat(starts[w], size[u]), times)]
            d = np.sqrt(((x[i] - x[j]) ** 2).sum(1))
            out[at:upto] = np.add.reduceat(d, np.cumsum(rows[at:upto]) - rows[at:upto])
        at = upto
    return out


def near_linkage(x: np.ndarray, target: int, each: int = NEAR_PAIRS) -> np.ndarray:
    """Cluster numbers as `average_linkage` gives them, with some `each` pairs of clusters for a merge in memory instead of all.

    Each pass over the distances lists the pairs of clusters nearer than a limit; rounds merge those that are each
    other's nearest until none is left below it.  Passes end when there are fewer clusters than the target.
    """
    _, first, where = np.unique(x, axis=0, return_index=True, return_inverse=True)
    where = first[where.reshape(-1)]  # equal vectors are merged to begin with; a cluster has the name of one of its rows
    links = [(np.zeros(len(x)), where, np.arange(len(x)))]
    limit, tied = np.inf, False
    while True:
        names, where = np.unique(where, return_inverse=True)
        if len(names) == 1:
            limit = np.inf
        if len(names) == 1 or len(names) < target and limit > LEAST_CUT and not tied:
            break
        size = np.bincount(where)
        order = np.argsort(size, kind="stable")  # clusters of one row side by side
        names, size, to = names[order], size[order], np.empty_like(order)
        to[order] = np.arange(len(order))
        where = to[where]
        a, b, s, limit, tied = _near_clusters(x, where, size, each * max(2, len(names) - target, len(names) // 16))
        while len(a):
            mean = s / (size[a] * size[b])
            best, near = np.full(len(size), np.inf), np.full(len(size), len(size))
            for c, o in ((a, b), (b, a)):
                np.minimum.at(best, c, mean)
            for c, o in ((a, b), (b, a)):
                at = mean == best[c]
                np.minimum.at(near, c[at], o[at])
            hit = (near[a] == b) & (near[b] == a)
            u, w = a[hit], b[hit]
            links.append((mean[hit], names[u], names[w]))
            known, to, changed = size[a] * size[b], np.arange(len(size)), np.zeros(len(size), bool)
            to[w], changed[u] = u, True
            size[u] += size[w]
            size[w] = 0
            where = to[where]
            if tied:
                break
            a, b = to[a], to[b]
            a, b, apart = np.minimum(a, b), np.maximum(a, b), a != b
            same = apart & ~changed[a] & ~changed[b]
            other = apart & ~same
            key, back = np.unique(a[other] * len(size) + b[other], return_inverse=True)
            p, q = key // len(size), key % len(size)
            sums, pairs = np.bincount(back, s[other], len(key)), np.bincount(back, known[other], len(key))
            less = np.flatnonzero(pairs < size[p] * size[q])
            sums[less] = _sums(x, where, size, p[less], q[less])
            left = sums / (size[p] * size[q]) < limit
            a, b, s = np.r_[a[same], p[left]], np.r_[b[same], q[left]], np.r_[s[same], sums[left]]
        where = names[where]
        if limit == np.inf:
            break
    h, i, j = (np.concatenate(column) for column in zip(*links))
    h, i, j = h[i != j], i[i != j], j[i != j]
    if not len(h):
        return np.arange(len(x))
    return clusters_below(len(x), zip(h.tolist(), i.tolist(), j.tolist()), cut_height(h, len(x), target, limit))


def merges(rows: DataFrame, by: str, vector: str = "embedding", id_col: str = "id", most_rounds: int = 1000) -> DataFrame:
    """a, b (a < b, smallest ids of the two clusters) and height of every merge within the groups of `by`; ids are unique over all groups."""
    pairs = written(pairs_within(packed_blocks(rows, vector, id_col, by), float("inf")).select("a", "b", F.col("distance").alias("s"), F.lit(1.0).alias("m")))
    done = None
    for _ in range(most_rounds):
        mean = F.col("s") / F.col("m")  # m: how many pairs of rows
        ways = pairs.groupBy(F.col("a").alias("c")).agg(F.min(F.struct(mean.alias("d"), F.col("b").alias("o"))).alias("near")).unionByName(pairs.groupBy(F.col("b").alias("c")).agg(F.min(F.struct(mean.alias("d"), F.col("a").alias("o"))).alias("near")))
        nearest = written(ways.groupBy("c").agg(F.min("near").alias("near")).select("c", "near.o", "near.d"))
        back = nearest.select(F.col("o").alias("a"), F.col("c").alias("b"), F.col("d").alias("_d"))
        mutual = written(nearest.select(F.col("c").alias("a"), F.col("o").alias("b"), F.col("d").alias("height")).where("a < b").join(back, ["a", "b"]).select("a", "b", "height"))
        n = mutual.count()
        if not n:
            break
        done = mutual if done is None else done.unionByName(mutual)
        gone = mutual.select("b", "a")
        gone = F.broadcast(gone) if n <= FEW else gone  # of a measured size
        first = pairs.join(gone.select(F.col("b").alias("a"), F.col("a").alias("_x")), "a", "left").withColumn("a", F.coalesce("_x", "a")).drop("_x")
        both = first.join(gone.select("b", F.col("a").alias("_y")), "b", "left").withColumn("b", F.coalesce("_y", "b")).drop("_y")
        summed = both.where("a <> b").groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.sum("s").alias("s"), F.sum("m").alias("m"))
        pairs = written(summed)
    else:
        raise RuntimeError("merges: clusters are left")
    return done if done is not None else pairs.select("a", "b", F.col("s").alias("height"))


def linkage_clusters(rows: DataFrame, targets: DataFrame, by: str, vector: str = "embedding", id_col: str = "id") -> DataFrame:
    """id and cluster (from 0, in order of the smallest ids) of every row, cut where the number of clusters is nearest the group's target.

    `targets` has the group and its `target`.  The heights of a group's merges, a number for each row, meet in one task.
    """
    own = written(rows.select(F.col(by).alias("g"), F.col(id_col).cast("bigint").alias("id"), F.col(vector).alias("v")))
    tree = written(merges(own, "g", "v", "id"))
    sized = written(own.groupBy("g").agg(F.count("*").alias("n")).join(targets.select(F.col(by).alias("g"), "target"), "g"))
    heights = tree.join(own.select(F.col("id").alias("a"), "g"), "a").select("g", "height")

    def cut(found: pd.DataFrame, size: pd.DataFrame) -> pd.DataFrame:
        if not len(found) or not len(size):
            return pd.DataFrame({"g": [], "cut": []})
        return pd.DataFrame({"g": size.g, "cut": cut_height(found.height.to_numpy(), int(size.n.iat[0]), int(size.target.iat[0]))})

    cuts = heights.groupBy("g").cogroup(sized.groupBy("g")).applyInPandas(cut, f"g {dict(own.dtypes)['g']}, cut double")
    low = tree.join(own.select(F.col("id").alias("a"), "g"), "a").join(cuts, "g").where("height <= cut").select("a", "b")
    found = own.select("g", "id").join(connected(low).withColumnRenamed("node", "id"), "id", "left").withColumn("root", F.coalesce("component", "id"))
    found = written(found.select("g", "id", "root"))
    names = row_numbers(found.select("g", "root").distinct(), ["g"], ["root"], "cluster")
    return found.join(names, ["g", "root"]).select(F.col("g").alias(by), F.col("id").alias(id_col), (F.col("cluster") - 1).alias("cluster"))
