"""Vector search, clustering and graphs over embeddings."""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lightshelf.functions import scalar as S
from lightshelf.functions import vectors as V
from lightshelf.operators.lineage import written
from lightshelf.operators.radius import _joined, core_links, joining_links, neighbours, packed_blocks, pairs_within
from lightshelf.operators.ranking import top_per_group

#: Bytes up to which a side of query vectors is broadcast.
BROADCAST_BYTES = 64 << 20


def nearest(df: DataFrame, query: list[float], k: int, vector: str = "embedding", id_col: str = "vec_id") -> DataFrame:
    """The k rows nearest to a query vector by L2 distance, ties by id."""
    target = F.array(*[F.lit(float(x)) for x in query])
    return df.select(id_col, V.l2(vector, target).alias("distance")).orderBy("distance", id_col).limit(k)


def with_own_references(df: DataFrame, references: DataFrame, by: str, parts: int = 16) -> DataFrame:
    """Each row with each reference (ref) of its own group; a group that many rows have is cut into parts, unless all references are small."""
    refs = references.select(by, "ref")
    size = refs.agg(F.coalesce(F.sum(F.size("ref") * 8 + 64), F.lit(0))).first()[0]
    if size <= BROADCAST_BYTES:
        return df.join(F.broadcast(refs), by)
    a = df.withColumn("_b", F.pmod(F.xxhash64(*df.columns), F.lit(parts)).cast("int"))
    return a.join(refs.withColumn("_b", F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))), [by, "_b"]).drop("_b")


#: Sides of a tile of rows against references (8 MB), pairs whose distances are summed at once, and rows that meet references in one task.
TILE_ROWS, TILE_REFS, AT_ONCE, TASK_ROWS = 512, 2048, 1 << 15, 1 << 13
#: Answers that a task sends on at once.
SENT = 1 << 20


def nearest_rows(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row of x the place of the nearest row of y, of equal ones the first, and the distance; what is held is bounded by tiles.

    Matrix products leave the rows that may be nearest, within a bound of their rounding, and those alone are summed exactly.
    """
    place, least = np.zeros(len(x), np.int64), np.full(len(x), np.inf)
    square = (y * y).sum(1)
    for i in range(0, len(x), TILE_ROWS):
        t = x[i : i + TILE_ROWS]
        own = (t * t).sum(1)
        at, low = place[i : i + len(t)], least[i : i + len(t)]
        for j in range(0, len(y), TILE_REFS):
            u, u2 = y[j : j + TILE_REFS], square[j : j + TILE_REFS]
            d = t @ u.T
            d *= -2
            d += u2[None, :]
            d += own[:, None]
            slack = 1e-9 * (1 + own + np.fmax.reduce(u2))
            p, q = np.nonzero(d <= (np.fmin(low * low, np.fmin.reduce(d, axis=1)) + slack)[:, None])
            for k in range(0, len(p), AT_ONCE):
                r, c = p[k : k + AT_ONCE], q[k : k + AT_ONCE]
                e = np.sqrt(((t[r] - u[c]) ** 2).sum(1))
                order = np.lexsort((c, e, r))
                first = order[np.r_[True, r[order][1:] != r[order][:-1]]]
                first = first[e[first] < low[r[first]]]
                at[r[first]], low[r[first]] = j + c[first], e[first]
    lost = np.flatnonzero(np.isinf(least))  # distances that are no numbers
    for k in range(0, len(lost), AT_ONCE):
        least[lost[k : k + AT_ONCE]] = np.sqrt(((x[lost[k : k + AT_ONCE]] - y[0]) ** 2).sum(1))
    return place, least


def reference_distances(df: DataFrame, references: DataFrame, vector: str, id_col: str, best: bool = False) -> DataFrame:
    """id, person_id and the least distance to the person's references (person_id, ref), for every person or for the nearest alone.

    References are sent to all tasks as one matrix if their measured size allows; else rows and references are dealt
    to parts and blocks that meet in a task each, and their answers are reduced. Of equal references only one is sent.
    """
    kinds, person = dict(df.dtypes), dict(references.dtypes)["person_id"]
    refs = references.select("person_id", F.col("ref").cast("array<double>").alias("ref")).where("ref is not null and person_id is not null")
    refs = written(refs.groupBy("ref").agg(F.min("person_id").alias("person_id")).select("person_id", "ref") if best else refs.distinct())
    rows = df.where(F.col(vector).isNotNull()).select(F.col(id_col).alias("id"), F.col(vector).cast("array<double>").alias("v"))
    n, size = refs.agg(F.count("*"), F.coalesce(F.sum(F.size("ref") * 8 + 64), F.lit(0))).first()
    schema = f"id {kinds[id_col]}, person_id {person}, distance double"
    if not n:
        return df.sparkSession.createDataFrame([], schema).withColumnRenamed("id", id_col)
    parts = max(1, -(-rows.count() // TASK_ROWS))

    def packed(frame: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
        frame = frame.sort_values("person_id", kind="stable")
        return frame.person_id.to_numpy(), np.stack(frame.ref.to_numpy()).astype(float)

    def answered(rows: pd.DataFrame, held: tuple[np.ndarray, np.ndarray]) -> Iterator[pd.DataFrame]:
        persons, y = held
        ids, x = rows.id.to_numpy(), np.stack(rows.v.to_numpy()).astype(float)
        if best:
            at, d = nearest_rows(x, y)
            yield pd.DataFrame({"id": ids, "person_id": persons[at], "distance": d})
            return
        names, starts = np.unique(persons, return_index=True)
        step = max(1, SENT // len(ids))
        ends = np.r_[starts[1:], len(y)]
        for k in range(0, len(names), step):
            some = names[k : k + step]
            d = np.concatenate([nearest_rows(x, y[a:b])[1] for a, b in zip(starts[k : k + step], ends[k : k + step])])
            yield pd.DataFrame({"id": np.tile(ids, len(some)), "person_id": np.repeat(some, len(ids)), "distance": d})

    if size <= BROADCAST_BYTES:
        held = df.sparkSession.sparkContext.broadcast(packed(refs.toPandas()))  # of a measured size

        def each(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for f in frames:
                if len(f):
                    yield from answered(f, held.value)

        return (rows.repartition(parts, "id") if parts > 1 else rows).mapInPandas(each, schema).withColumnRenamed("id", id_col)
    blocks = max(2, -(-size // max(BROADCAST_BYTES, 1 << 20)))
    a = rows.withColumn("part", F.pmod(F.xxhash64("id"), F.lit(parts)).cast("int")).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    b = refs.withColumn("block", F.pmod(F.xxhash64("ref"), F.lit(blocks)).cast("int")).withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))

    def meet(own: pd.DataFrame, theirs: pd.DataFrame) -> pd.DataFrame:
        if not len(own) or not len(theirs):
            return pd.DataFrame({"id": [], "person_id": [], "distance": []})
        return pd.concat(answered(own, packed(theirs)))

    met = a.groupBy("part", "block").cogroup(b.groupBy("part", "block")).applyInPandas(meet, schema)
    if best:
        first = F.min(F.struct("distance", "person_id")).alias("p")
        return met.groupBy("id").agg(first).select(F.col("id").alias(id_col), "p.person_id", "p.distance")
    return met.groupBy("id", "person_id").agg(F.min("distance").alias("distance")).withColumnRenamed("id", id_col)


def nearest_reference(df: DataFrame, references: DataFrame, tolerance: float, vector: str = "embedding", id_col: str = "vec_id") -> DataFrame:
    """For each row the person of the nearest reference within the tolerance, and the distance."""
    return reference_distances(df, references, vector, id_col, best=True).where(F.col("distance") <= tolerance)


def radius_pairs(df: DataFrame, radius: float, vector: str = "embedding", id_col: str = "vec_id", by: str | None = None) -> DataFrame:
    """Pairs (a < b) of rows within L2 `radius`, of one group if `by` is given; every such pair, so n(n-1)/2 of a clump."""
    return pairs_within(packed_blocks(df, vector, id_col, by), radius)


def radius_components(df: DataFrame, radius: float, vector: str = "embedding", id_col: str = "vec_id", by: str | None = None) -> DataFrame:
    """node and component of the rows that have another within the radius; pairs stay within tasks, which answer by joining links."""
    return connected(joining_links(packed_blocks(df, vector, id_col, by), radius))


#: Rows of two ids up to which relabellings are sent to all tasks, and the parts that a label's nodes are cut into beyond.
FEW, PARTS = 200_000, 16


def _relabelled(labels: DataFrame, changes: DataFrame) -> DataFrame:
    """`labels` with the column `new` of `changes` (old, new) where the label is `old`: most nodes may have one label."""
    if changes.count() <= FEW:
        return labels.join(F.broadcast(changes), labels.label == changes.old, "left")  # of a measured size
    salted = labels.withColumn("_p", F.pmod(F.xxhash64("node"), F.lit(PARTS)).cast("int"))
    spread = changes.withColumn("_p", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))))
    return salted.join(spread, (salted.label == spread.old) & (salted._p == spread._p), "left").drop("_p")


def connected(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """node and its component (smallest node reachable) for the nodes of edges a-b.

    Each round, where two labels meet, the larger one and its nodes take the
    smaller, and labels jump to their own labels.  Labels are written out, so
    lost executors cost a round.
    """
    links = written(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    ways = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    labels = written(ways.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("label")).withColumnRenamed("a", "node"))
    for _ in range(most_rounds):
        ends = links.join(labels.select(F.col("node").alias("a"), F.col("label").alias("la")), "a").join(labels.select(F.col("node").alias("b"), F.col("label").alias("lb")), "b").where("la <> lb")
        hooks = written(ends.select(F.greatest("la", "lb").alias("old"), F.least("la", "lb").alias("new")).groupBy("old").agg(F.min("new").alias("new")))
        if hooks.isEmpty():
            return labels.withColumnRenamed("label", "component")
        held = written(_relabelled(labels, hooks).select("node", F.least(F.coalesce("new", "label"), "label").alias("label")))
        up = held.where("node <> label").select(F.col("node").alias("old"), F.col("label").alias("new"))
        # only nodes that are labels can be jumped over
        up = written(up.join(held.select(F.col("label").alias("old")).distinct(), "old", "left_semi"))
        labels = written(_relabelled(held, up).select("node", F.coalesce("new", "label").alias("label")))
    raise RuntimeError("connected: labels still change")


def connected_stars(links: DataFrame) -> DataFrame:
    """As `connected`, for links a-b of stars: tasks that see a row give it the least node a of its component there.

    Roots that share a row are joined, so that the rounds go over roots alone, of which there are few where components are large.
    """
    stars = written(links.select("a", "b"))
    every = stars.unionByName(stars.select("a", F.col("a").alias("b")).distinct())
    w = Window.partitionBy("b").orderBy("a")
    held = written(every.select("a", "b", F.first("a").over(w).alias("root"), F.row_number().over(w).alias("n")).where("n = 1 or a <> root"))
    edges = written(held.where("a <> root").select("a", F.col("root").alias("b")).distinct())

    def few(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found = list(frames)
        if found:
            yield _joined(pd.concat(found)).rename(columns={"a": "component", "b": "node"})

    # a chain of tasks takes many rounds, where one task can join the roots of a measured number
    joined = edges.coalesce(1).mapInPandas(few, "component bigint, node bigint") if edges.count() <= FEW else connected(edges)
    return held.where("n = 1").select(F.col("b").alias("node"), "root").join(joined.withColumnRenamed("node", "root"), "root", "left").select("node", F.coalesce("component", "root").alias("component"))


def density_clusters(points: DataFrame, radius: float, min_samples: int, vector: str = "embedding", id_col: str = "vec_id", by: str | None = None) -> DataFrame:
    """id and cluster of every row, by density within each group of `by`, all groups in one plan; as `dbscan`, but pairs stay within tasks.

    Three steps: neighbours are counted; core rows are joined, and rows beside
    them linked, by tasks that report fewer links than rows; components follow.
    Rows without a vector are noise.
    """
    rows = points.select(F.col(id_col).cast("bigint").alias("id"), F.col(vector).alias("v"), *([F.col(by).alias("g")] if by else []))
    first = packed_blocks(rows, "v", "id", "g" if by else None)
    core = written(neighbours(first, radius).where(F.col("n") + 1 >= min_samples).select("id") if min_samples > 1 else rows.where("v is not null").select("id"))
    flagged = rows.join(core.withColumn("c", F.lit(True)), "id", "left").withColumn("c", F.coalesce("c", F.lit(False)))
    links = written(core_links(packed_blocks(flagged, "v", "id", "g" if by else None, "c"), radius))
    joined = connected(links.where("not border").select("a", "b"))
    cores = written(core.join(joined, core.id == joined.node, "left").select("id", F.coalesce("component", "id").alias("cluster")))
    beside = links.where("border").join(cores.withColumnRenamed("id", "b"), "b").groupBy("a").agg(F.min("cluster").alias("cluster")).select(F.col("a").alias("id"), "cluster")
    return rows.select("id").join(cores.unionByName(beside), "id", "left")


def dbscan(points: DataFrame, edges: DataFrame, min_samples: int, id_col: str = "vec_id") -> DataFrame:
    """Clusters by density from radius edges: core points have `min_samples` within the radius, themselves included.

    A cluster's label is its smallest core id; border points join the cluster
    of the smallest label beside them; noise has NULL.
    """
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    core = both.groupBy("a").agg((F.count("*") + 1).alias("n")).where(F.col("n") >= min_samples).select("a")
    between = both.join(core, "a", "left_semi").join(core.withColumnRenamed("a", "b"), "b", "left_semi").where("a < b").select("a", "b")
    joined = connected(between)
    cores = core.join(joined, core.a == joined.node, "left").select(F.col("a").alias("id"), F.coalesce("component", "a").alias("cluster"))
    border = both.join(core, "a", "left_anti").join(cores.withColumnRenamed("id", "b"), "b").groupBy("a").agg(F.min("cluster").alias("cluster")).select(F.col("a").alias("id"), "cluster")
    found = cores.unionByName(border)
    return points.select(F.col(id_col).cast("bigint").alias("id")).join(found, "id", "left")


def _near(x: np.ndarray, y: np.ndarray, radius: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Places in x and in y of the pairs within the radius, with their distances, some at a time."""
    square = (y * y).sum(1)
    for i in range(0, len(x), TILE_ROWS):
        t = x[i : i + TILE_ROWS]
        own = (t * t).sum(1)
        for j in range(0, len(y), TILE_REFS):
            u = y[j : j + TILE_REFS]
            d = t @ u.T
            d *= -2
            d += square[None, j : j + TILE_REFS]
            d += own[:, None]
            p, q = np.nonzero(d <= radius * radius + 1e-9)
            for k in range(0, len(p), AT_ONCE):
                r, c = p[k : k + AT_ONCE], q[k : k + AT_ONCE]
                e = np.sqrt(((t[r] - u[c]) ** 2).sum(1))
                yield i + r[e <= radius], j + c[e <= radius], e[e <= radius]


def sharper_alternatives(cells: DataFrame, photos: DataFrame, vectors: DataFrame, radius: float, target_ppi: float = 240.0, days: float = 3.0, copy: float = 0.20, most: int = 8, vector: str = "embedding", id_col: str = "vec_id") -> DataFrame:
    """Sharper pictures of the same moment for the cells of a book: cell_id, id, distance, ppi, place.

    `cells` has cell_id, photo_id and the size w, h in inches; `photos` id,
    image_width, image_height and taken_ts; pictures whose `vectors` lie within the radius
    count as near.  A picture is out if it is placed already or a copy of another
    placed one, if its date is unknown or too far off (for cells with a dated
    picture), or if it would not print at the target.

    Only pairs of a cell and a picture that is not placed are compared, in parts and blocks that meet in a task each.  A first
    pass finds the least and the largest placed picture that each one is a copy of, so that copies of two or more are gone; a
    second one keeps the best of each cell, in each task.
    """
    known = vectors.where(F.col(vector).isNotNull()).select(F.col(id_col).alias("id"), F.col(vector).cast("array<double>").alias("v"))
    kinds = {**dict(cells.dtypes), **dict(known.dtypes)}
    dated = photos.select("id", F.coalesce(S.micros("taken_ts"), F.lit(0)).alias("t"), F.col("taken_ts").isNotNull().alias("dated"), F.col("image_width").cast("double").alias("iw"), F.col("image_height").cast("double").alias("ih"))
    book = known.withColumnRenamed("id", "photo_id").join(cells.select("cell_id", "photo_id", F.col("w").cast("double").alias("w"), F.col("h").cast("double").alias("h")), "photo_id")
    book = written(book.join(dated.select(F.col("id").alias("photo_id"), "t", "dated"), "photo_id", "left").withColumns({"t": F.coalesce("t", F.lit(0)), "dated": F.coalesce("dated", F.lit(False))}))
    rows = written(known.join(cells.select(F.col("photo_id").alias("id")).where("id is not null").distinct(), "id", "left_anti").join(dated, "id"))
    blocks = max(1, -(-book.count() // TASK_ROWS))
    sent = book.withColumn("block", F.pmod(F.xxhash64("cell_id", "photo_id"), F.lit(blocks)).cast("int"))

    def met(left: DataFrame, run, schema: str) -> DataFrame:
        parts = max(1, -(-left.count() // TASK_ROWS))
        a = left.withColumn("part", F.pmod(F.xxhash64("id"), F.lit(parts)).cast("int")).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
        b = sent.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
        return a.groupBy("part", "block").cogroup(b.groupBy("part", "block")).applyInPandas(run, schema)

    def stacked(frame: pd.DataFrame) -> np.ndarray:
        return np.stack(frame.v.to_numpy()).astype(float)

    def copied(own: pd.DataFrame, spots: pd.DataFrame) -> pd.DataFrame:
        if not len(own) or not len(spots):
            return pd.DataFrame({"id": [], "lo": [], "hi": []})
        photo = spots.photo_id.to_numpy(np.int64)
        lo, hi = np.full(len(own), np.iinfo(np.int64).max), np.full(len(own), np.iinfo(np.int64).min)
        for p, q, d in _near(stacked(own), stacked(spots), min(copy, radius)):
            p, q = p[d < copy], q[d < copy]
            np.minimum.at(lo, p, photo[q])
            np.maximum.at(hi, p, photo[q])
        keep = lo <= hi
        return pd.DataFrame({"id": own.id[keep], "lo": lo[keep], "hi": hi[keep]})

    copies = met(rows.select("id", "v"), copied, f"id {kinds['id']}, lo bigint, hi bigint").groupBy("id").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    left = rows.join(copies, "id", "left").where("lo is null or lo = hi")
    left = written(left.select("id", "v", "t", "dated", "iw", "ih", F.col("lo").isNotNull().alias("copy"), F.coalesce("lo", F.lit(0)).alias("only")))

    def best(found: list[pd.DataFrame]) -> pd.DataFrame:
        every = pd.concat(found).sort_values(["cell_id", "distance", "id"])
        return every[every.groupby("cell_id").cumcount() < most]

    def chosen(own: pd.DataFrame, spots: pd.DataFrame) -> pd.DataFrame:
        none = pd.DataFrame({"cell_id": [], "id": [], "distance": [], "ppi": []})
        if not len(own) or not len(spots):
            return none
        o, s = ({c: f[c].to_numpy() for c in f.columns if c != "v"} for f in (own, spots))
        found, n = [], 0
        for p, q, d in _near(stacked(own), stacked(spots), radius):
            ppi = np.fmin(o["iw"][p] / s["w"][q], o["ih"][p] / s["h"][q])
            moment = ~s["dated"][q] | (o["dated"][p] & (np.abs(o["t"][p] - s["t"][q]) <= days * 86400e6))
            keep = moment & (ppi >= target_ppi) & (~o["copy"][p] | (o["only"][p] == s["photo_id"][q]))
            found.append(pd.DataFrame({"cell_id": s["cell_id"][q[keep]], "id": o["id"][p[keep]], "distance": d[keep], "ppi": ppi[keep]}))
            n += int(keep.sum()) + 64
            if n >= SENT:
                found, n = [best(found)], 0
        return best(found) if found else none

    kept = met(left, chosen, f"cell_id {kinds['cell_id']}, id {kinds['id']}, distance double, ppi double")
    return top_per_group(kept, ["cell_id"], [F.col("distance"), F.col("id")], most, "place")


def centroids(members: DataFrame, by: str, dims: int, vector: str = "embedding") -> DataFrame:
    """Mean vector of each group, scaled to unit length. Places are averaged apart, which combines before the shuffle."""
    means = members.groupBy(by).agg(F.count("*").alias("n"), *[m.alias(f"_m{i}") for i, m in enumerate(V.mean_vector(F.col(vector), dims))])
    return means.select(by, "n", V.normalised(F.array(*[F.col(f"_m{i}") for i in range(dims)])).alias("centroid"))


def merge_suggestions(members: DataFrame, by: str, dims: int, centroid_radius: float = 0.95, member_radius: float = 0.60, copy: float = 0.05, most_members: int = 60, vector: str = "embedding", id_col: str = "vec_id", area: str | None = None) -> DataFrame:
    """Pairs of groups whose centroids and nearest members are near: least distance, least beyond copies, and copies.

    Members are the `most_members` of the largest `area` of each group (by id without one), as the operator defines.
    """
    largest = [F.col(area).desc_nulls_last()] if area else []
    own = top_per_group(members.select(by, id_col, vector, *([area] if area else [])), [by], [*largest, F.col(id_col)], most_members).drop("rn")
    centres = centroids(own, by, dims, vector)
    near = radius_pairs(centres.select(F.xxhash64(by).alias("vec_id"), "centroid"), centroid_radius, "centroid")
    names = centres.select(F.col(by), F.xxhash64(by).alias("k"))
    pairs = near.join(names.select(F.col(by).alias("g1"), F.col("k").alias("a")), "a").join(names.select(F.col(by).alias("g2"), F.col("k").alias("b")), "b")
    pairs = pairs.select(F.least("g1", "g2").alias("left_group"), F.greatest("g1", "g2").alias("right_group"), F.col("distance").alias("centroid_distance"))
    x = own.select(F.col(by).alias("left_group"), F.col(vector).alias("x"))
    y = own.select(F.col(by).alias("right_group"), F.col(vector).alias("y"))
    d = pairs.join(x, "left_group").join(y, "right_group").withColumn("d", V.l2("x", "y"))
    return d.groupBy("left_group", "right_group", "centroid_distance").agg(F.min("d").alias("least"), F.min(F.when(F.col("d") >= copy, F.col("d"))).alias("robust"), F.sum((F.col("d") < copy).cast("bigint")).alias("copies")).where(F.col("least") <= member_radius)


#: No cut is lower.
LEAST_CUT = 0.01


def cut_height(heights: np.ndarray, n: int, target: int, most: float = math.inf) -> float:
    """The height at which the number of clusters is nearest the target, by bisection; heights from `most` on may be left out."""
    low, high, best = LEAST_CUT, float(heights.max()) if most == math.inf else most, (n + 1, 0.0)
    heights = np.sort(heights)
    for _ in range(30):
        middle = (low + high) / 2
        k = n - int(np.searchsorted(heights, middle, "right"))
        best = min(best, (abs(k - target), middle))
        if k > target:
            low = middle
        elif k < target:
            high = middle
        else:
            break
    return best[1]


def average_linkage(vectors: np.ndarray, target: int) -> np.ndarray:
    """Cluster numbers by average linkage, cut where the number of clusters is nearest the target (bisection of the height).

    Chains of nearest neighbours: average linkage is reducible, so two clusters
    that are each other's nearest may be merged at once, in time by the square
    of the vectors and with one matrix of their distances.
    """
    n = len(vectors)
    if n <= 1:
        return np.zeros(n, int)
    square = (vectors * vectors).sum(1)
    d = vectors @ vectors.T
    d *= -2
    d += square[:, None]
    d += square[None, :]
    np.sqrt(np.maximum(d, 0, out=d), out=d)
    np.fill_diagonal(d, np.inf)
    size, active, merges, chain = np.ones(n), np.ones(n, bool), [], []
    while len(merges) < n - 1:
        if not chain:
            chain.append(int(np.flatnonzero(active)[0]))
        at = chain[-1]
        near = int(d[at].argmin())
        if len(chain) > 1 and d[at, chain[-2]] <= d[at, near]:
            near = chain[-2]
        if len(chain) < 2 or near != chain[-2]:
            chain.append(near)
            continue
        del chain[-2:]
        i, j = min(at, near), max(at, near)
        merges.append((float(d[i, j]), i, j))
        row = (size[i] * d[i] + size[j] * d[j]) / (size[i] + size[j])
        d[i], d[:, i] = row, row
        d[i, i] = np.inf
        d[j], d[:, j] = np.inf, np.inf
        size[i] += size[j]
        active[j] = False
    return clusters_below(n, merges, cut_height(np.array([h for h, _, _ in merges]), n, target))


def clusters_below(n: int, merges: Iterable[tuple[float, int, int]], cut: float) -> np.ndarray:
    """Cluster numbers, from 0 in order of their first rows, by the merges (height, rows i and j) up to a height."""
    root = list(range(n))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for h, i, j in merges:
        if h <= cut:
            root[find(j)] = find(i)
    names: dict[int, int] = {}
    return np.array([names.setdefault(find(i), len(names)) for i in range(n)])


def select_best(photos: DataFrame, by: list[str], share: float = 0.1, least_quality: float = 4.0, runner_up: float = 6.0, vector: str = "embedding", task_rows: int | None = None) -> DataFrame:
    """Culling of each scope: clusters, the best of each, rare-tag picks, runners-up, then the best of the rest.

    A scope is a directory or a collection.  Scopes whose vectors fit in a task are linked and chosen from there, by all their
    distances or by the near ones; larger ones are linked by rounds of merges over tables.  The choice itself needs an id, a
    score and a cluster for each photo of a scope.
    """
    from lightshelf.operators.linkage import MAX_NEAR, linkage_clusters, near_linkage

    most = MAX_NEAR if task_rows is None else task_rows

    def budgets(n: int) -> tuple[int, int]:
        target = max(1, math.floor(n * share))
        return target, max(target + 2, math.floor(1.5 * target))

    def link(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("id", ignore_index=True)
        linkage = average_linkage if len(rows) <= MAX_SCOPE else near_linkage
        cluster = linkage(np.stack(rows[vector].to_numpy()).astype(float), max(8, budgets(len(rows))[1]))
        return rows[["id", "score"]].assign(cluster=cluster)

    def choose(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("id", ignore_index=True)
        n = len(rows)
        target, budget = budgets(n)
        quality = rows.score.fillna(0).to_numpy(float)
        cluster = rows.cluster.to_numpy(int)
        sizes = np.bincount(cluster)
        order = np.lexsort((rows.id, -quality))
        rank = np.zeros(n, int)
        seen: dict[int, int] = {}
        for i in order:
            rank[i] = seen[cluster[i]] = seen.get(cluster[i], 0) + 1
        reps = [i for i in order if rank[i] == 1]
        if len(reps) > budget:
            weak = sorted((i for i in reps if sizes[cluster[i]] <= 2 and quality[i] < least_quality + 0.3), key=lambda i: quality[i] + min(1.0, 0.1 * sizes[cluster[i]]))
            dropped = set(weak[: len(reps) - budget])
            reps = [i for i in reps if i not in dropped][:budget]
        chosen = {i for i in reps if quality[i] >= least_quality}
        taken = np.bincount([cluster[i] for i in chosen], minlength=len(sizes)) if chosen else np.zeros(len(sizes), int)
        cap = np.minimum(4, 1 + sizes // 8)

        def take(candidates, most: int, capped: bool = True) -> None:
            for i in candidates:
                if len(chosen) >= most:
                    return
                if i not in chosen and (not capped or taken[cluster[i]] < cap[cluster[i]]):
                    chosen.add(i)
                    taken[cluster[i]] += 1

        if len(chosen) < target:
            take([i for i in order if quality[i] >= runner_up], target)
            take(order, target)
            take(order, target, capped=False)
        return pd.DataFrame({"id": rows.id, "cluster": cluster, "rank_in_cluster": rank, "selected": [i in chosen for i in range(n)], "score": quality})

    kinds = dict(photos.dtypes)
    held = photos.select(*by, "id", "score", vector)
    sizes = written(held.groupBy(*by).agg(F.count("*").alias("_n")))
    scopes, n = sizes.agg(F.count("*"), F.coalesce(F.sum("_n"), F.lit(0))).first()
    chosen = f"id {kinds['id']}, cluster bigint, rank_in_cluster bigint, selected boolean, score double"
    # by ranges: each scope with its share of the rows gets a task, where hashes would put some together
    tasks = max(1, min(2 * scopes, max(8, n // SCOPE_ROWS)))
    dealt = held.join(sizes.where(F.col("_n") <= most), by, "left_semi").repartitionByRange(tasks, *by)
    found = dealt.groupBy(*by).applyInPandas(lambda rows: choose(link(rows)), chosen)
    large = sizes.where(F.col("_n") > most)
    if not large.isEmpty():
        target = F.greatest(F.lit(1), F.floor(F.col("_n") * share))
        names = F.to_json(F.struct(*by))
        targets = large.select(names.alias("_s"), F.greatest(F.lit(8), target + 2, F.floor(target * 1.5)).alias("target"))
        rows = held.join(large, by, "left_semi").withColumn("_s", names)
        linked = rows.select(*by, "id", "score").join(linkage_clusters(rows, targets, "_s", vector, "id").select("id", "cluster"), "id")
        found = found.unionByName(linked.groupBy(*by).applyInPandas(choose, chosen))
    return found


#: Photos of one scope whose distances fit in a task (512 MB), and photos of small scopes that share a task.
MAX_SCOPE, SCOPE_ROWS = 8000, 2000


def running_centroids(rows: pd.DataFrame, tolerance: float, vector: str = "embedding") -> pd.DataFrame:
    """Greedy clusters in order of id: the nearest centroid within the tolerance takes the row and moves to the mean."""
    sums: list[np.ndarray] = []
    counts: list[int] = []
    out = []
    for r in rows.sort_values("id").itertuples():
        v = np.asarray(getattr(r, vector), float)
        if sums:
            d = [np.linalg.norm(v - s / n) for s, n in zip(sums, counts)]
            i = int(np.argmin(d))
            if d[i] <= tolerance:
                sums[i], counts[i] = sums[i] + v, counts[i] + 1
                out.append((r.id, i))
                continue
        sums.append(v)
        counts.append(1)
        out.append((r.id, len(sums) - 1))
    return pd.DataFrame(out, columns=["id", "cluster"])


def similarity_chain(centres: DataFrame, by: list[str], vector: str = "centroid", id_col: str = "id", most: int | None = None) -> DataFrame:
    """Order of each scope's groups so that neighbours are alike: from the first, always the nearest left; by size beyond `most`, if that is given.

    Each step depends on the one before: a scope's centroids are one task, whose time grows with their square.
    """

    def order(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["n", id_col], ascending=[False, True], ignore_index=True)
        if most is not None and len(rows) > most:
            return pd.DataFrame({id_col: rows[id_col], "place": np.arange(len(rows))})
        v = np.stack(rows[vector].to_numpy()).astype(float)
        at, path, left = 0, [0], np.ones(len(rows), bool)
        left[0] = False
        while left.any():
            d = ((v - v[at]) ** 2).sum(1)
            at = int(np.where(left, d, np.inf).argmin())
            left[at] = False
            path.append(at)
        return pd.DataFrame({id_col: rows[id_col].to_numpy()[path], "place": np.arange(len(path))})

    return centres.select(*by, id_col, "n", vector).groupBy(*by).applyInPandas(order, f"{id_col} {dict(centres.dtypes)[id_col]}, place bigint")
