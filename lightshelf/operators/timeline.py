"""Sessions, bursts, time joins and location imputation over time-ordered rows.

Work is cut where the gap to the next row exceeds the operator's window: nothing
looks across such a place, so each cut is a task of its own.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lightshelf.functions import scalar as S
from lightshelf.operators.lineage import written
from lightshelf.functions import vectors as V
from lightshelf.operators.bursts import near_pairs
from lightshelf.operators.ranking import cut_at_gaps, grouped
from lightshelf.operators.scans import first_after, in_parts, last_before
from lightshelf.operators.similar import connected, connected_stars


def chapters(photos: DataFrame, by: list[str], hours: float, least: int, place: str = "place_name") -> DataFrame:
    """Runs without a gap above `hours` and without a change of place, of at least `least` photos: span, days, places, and the best photo."""
    runs = cut_at_gaps(photos, by, "taken_ts", hours * 3600, "chapter", place)
    return runs.groupBy(*by, "chapter").agg(
        F.count("*").alias("n"), F.min("taken_ts").alias("first_ts"), F.max("taken_ts").alias("last_ts"), F.size(F.collect_set(F.to_date("taken_ts"))).cast("bigint").alias("n_days"), F.size(F.collect_set(place)).cast("bigint").alias("n_places"), F.min("id").alias("first_id"),
        F.array_join(F.array_sort(F.collect_set(place)), ";").alias("places"), F.max_by("id", F.struct(F.coalesce("score", F.lit(-1.0)), -F.col("id"))).alias("best_id"),
    ).where(F.col("n") >= least)


def sessions(df: DataFrame, by: list[str], seconds: float) -> DataFrame:
    """Sessions of each group by inactivity gap."""
    return cut_at_gaps(df, by, "taken_ts", seconds, "session").groupBy(*by, "session").agg(F.count("*").alias("n"), F.min("taken_ts").alias("first_ts"), F.max("taken_ts").alias("last_ts"))


def near_in_time(left: DataFrame, right: DataFrame, seconds: float, strictly: bool = False, lt: str = "taken_ts", rt: str = "taken_ts", by: list[str] | None = None) -> DataFrame:
    """Pairs of rows within `seconds`: an equi-join on time bands, a row of the right side in its own band and the two beside it.

    Columns of the right side get the prefix `o_`.
    """
    width = int(max(1, math.ceil(seconds))) * 1_000_000
    a = left.withColumn("_band", F.floor(S.micros(lt) / width))
    others = right.select(*[F.col(c).alias(f"o_{c}") for c in right.columns])
    band = F.floor(S.micros(f"o_{rt}") / width)
    b = others.withColumn("_band", F.explode(F.array(band - 1, band, band + 1)))
    gap = F.abs(S.micros(lt) - S.micros(f"o_{rt}"))
    hit = gap < seconds * 1e6 if strictly else gap <= seconds * 1e6
    for c in by or []:
        b = b.withColumn(c, F.col(f"o_{c}"))
    return a.join(b, ["_band", *(by or [])]).where(hit).drop("_band")


#: Members of a stack that are held in one row, stacks of a band that one task begins from, and sides of a tile of stacks against stacks (2 MB).
STACK_ROW, TASK_STACKS, TILE_STACKS, TILE_OTHERS = 256, 1 << 13, 256, 1024


def _padded(times: pa.ListArray, base: int, fill: float) -> np.ndarray:
    """Times of stacks from `base` on, one row each, shorter ones filled up."""
    n = np.diff(times.offsets.to_numpy())
    out = np.full((len(n), max(1, int(n.max(initial=0)))), fill)
    out[np.arange(out.shape[1])[None, :] < n[:, None]] = times.flatten().to_numpy() - base
    return out


def _met(key: tuple, batches: Iterator[pa.RecordBatch], width: int, most: float) -> Iterator[pa.RecordBatch]:
    """Pairs of stacks of a task, both ways, if the first least gap of the two is from a time in its band."""
    base = key[0].as_py() * width
    table = pa.Table.from_batches(list(batches)).combine_chunks()
    # long ones apart from short ones; else in order of stacks, as pairs have the smaller one first
    order = pc.sort_indices(table.append_column("n", pc.bit_wise_and(pc.list_value_length(table.column("times")), pa.scalar(-8, pa.int32()))), [("n", "ascending"), ("stack_id", "ascending")])
    table = table.take(order).combine_chunks()
    sides = [(t.column("stack_id").to_numpy(), t.column("times").combine_chunks() if t.num_rows else pa.array([], pa.list_(pa.int64()))) for t in (table.filter(table.column("own")), table)]
    if not len(sides[0][0]):
        return
    for i in range(0, len(sides[0][0]), TILE_STACKS):
        a = sides[0][0][i : i + TILE_STACKS]
        x = _padded(sides[0][1][i : i + TILE_STACKS], base, 1e18)
        before, inside = x < 0, (x >= 0) & (x < width)
        for j in range(0, len(sides[1][0]), TILE_OTHERS):
            b = sides[1][0][j : j + TILE_OTHERS]
            if a.min() >= b.max():
                continue
            y = _padded(sides[1][1][j : j + TILE_OTHERS], base, -1e18)
            gaps = {k: np.full((len(a), len(b)), np.inf) for k in ("before", "inside", "after")}
            theirs = [np.zeros((len(a), len(b)), bool) for _ in range(y.shape[1])]
            n_own = np.zeros((len(a), len(b)), np.int16)
            for p in range(x.shape[1]):
                least, any_near = None, None
                for q in range(y.shape[1]):
                    gap = np.abs(x[:, p, None] - y[None, :, q])
                    near = gap < most
                    theirs[q] |= near
                    least, any_near = (gap, near) if least is None else (np.minimum(least, gap, out=least), np.logical_or(any_near, near))
                n_own += any_near
                for name, rows in (("before", before[:, p]), ("inside", inside[:, p]), ("after", ~before[:, p] & ~inside[:, p])):
                    if rows.any():
                        gaps[name][rows] = np.minimum(gaps[name][rows], least[rows])
            hit = (gaps["inside"] < most) & (gaps["inside"] < gaps["before"]) & (gaps["inside"] <= gaps["after"])
            hit &= a[:, None] < b[None, :]
            u, w = np.nonzero(hit)
            if len(u):
                n_theirs = np.add.reduce([t[hit] for t in theirs], dtype=np.int64)
                gap = gaps["inside"][hit] / 1e6
                for own, other, n in ((a[u], b[w], n_theirs), (b[w], a[u], n_own[hit].astype(np.int64))):
                    yield pa.RecordBatch.from_arrays([pa.array(own), pa.array(other), pa.array(n), pa.array(gap)], ["stack_id", "o_stack_id", "n_members", "least_gap"])


def nearby_stacks(stacks: DataFrame, seconds: float = 60.0, row: int = STACK_ROW) -> DataFrame:
    """Stacks with a member within `seconds` of a member of another one: distinct members and the least gap.

    Stacks of up to `row` members are a row each, and meet in bands of time, in tiles of times; the two ways of a pair come
    from the band of its least gap, so that nothing about pairs is shuffled.  Pairs with larger stacks, or with stacks
    that list a member twice, are counted by members.
    """
    rows = stacks.where("stack_id is not null").select(F.col("stack_id").cast("bigint").alias("stack_id"), "id", "taken_ts", S.micros("taken_ts").alias("t")).where("t is not null")
    width, most = int(max(1, math.ceil(seconds))) * 1_000_000, seconds * 1e6
    # what is held is never more than a row allows
    sizes = rows.groupBy("stack_id").agg(F.count("*").alias("_n"))
    held = rows.join(sizes.where(F.col("_n") <= row), "stack_id").groupBy("stack_id").agg(F.sort_array(F.collect_list("t")).alias("times"), F.collect_set("id").alias("_i"), F.count("*").alias("_n"))
    held = held.withColumn("_whole", F.size("_i") == F.col("_n"))
    large = sizes.where(F.col("_n") > row).select("stack_id").unionByName(held.where("not _whole").select("stack_id"))
    few = held.where("_whole").select("stack_id", "times", F.array_distinct(F.transform("times", lambda t: F.floor(t / width))).alias("_own"))
    around = F.array_distinct(F.flatten(F.transform("_own", lambda t: F.array(*[t + i for i in (-1, 0, 1)]))))
    sent = few.withColumn("band", F.explode(around)).select("stack_id", "times", "band", F.array_contains("_own", F.col("band")).alias("own"))
    crowded = few.select(F.explode("_own").alias("band")).groupBy("band").agg(F.ceil(F.count("*") / TASK_STACKS).cast("int").alias("_parts")).where("_parts > 1")
    parts = sent.join(crowded, "band", "left").withColumn("_parts", F.coalesce("_parts", F.lit(1))).withColumn("_mine", F.pmod(F.xxhash64("stack_id"), F.col("_parts")).cast("int"))
    dealt = parts.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1))).select("stack_id", "times", "band", "part", (F.col("own") & (F.col("part") == F.col("_mine"))).alias("own"))
    def run(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _met(key, batches, width, most)

    tasks = max(8, int(stacks.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    found = dealt.repartition(tasks, "band", "part").groupBy("band", "part").applyInArrow(run, "stack_id bigint, o_stack_id bigint, n_members bigint, least_gap double")
    # pairs with a stack of many members on either side
    many, others = rows.drop("t").join(large, "stack_id", "left_semi"), rows.drop("t").join(large, "stack_id", "left_anti")
    pairs = near_in_time(many, rows.drop("t"), seconds, strictly=True).unionByName(near_in_time(others, many, seconds, strictly=True)).where("stack_id <> o_stack_id")
    counted = pairs.groupBy("stack_id", "o_stack_id").agg(F.countDistinct("o_id").alias("n_members"), (F.min(F.abs(S.micros("taken_ts") - S.micros("o_taken_ts"))) / 1e6).alias("least_gap"))
    return found.unionByName(counted)


def burst_pairs(photos: DataFrame, seconds: float, most_distance: float, vector: str = "embedding", cosine: bool = True, by: list[str] | None = None) -> DataFrame:
    """Pairs close in time (of equal `by`) whose vectors are near: strictly for cosine distance.

    Rows of few each `by` are joined; without `by`, times are dense, and spans are compared by tiles.
    """
    if not by:
        return near_pairs(photos, seconds, most_distance, vector, cosine)
    pairs = near_in_time(photos, photos, seconds, by=by).where("id < o_id")
    d = V.cosine_distance(vector, f"o_{vector}") if cosine else V.l2(vector, f"o_{vector}")
    return pairs.withColumn("distance", d).where(F.col("distance") < most_distance if cosine else F.col("distance") <= most_distance).select("id", "o_id", "distance")


def burst_stacks(photos: DataFrame, seconds: float = 5.0, most_distance: float = 0.05, span: float = 10.0, vector: str = "embedding", cosine: bool = True, by: list[str] | None = None) -> DataFrame:
    """Bursts: linked photos, cut to `span` seconds from the earliest, at least two, best first (the first is the top).

    Links come from spans of time, as many as join what is linked; stacks are their components.
    """
    own = by or []
    timed = photos.where(F.col("taken_ts").isNotNull())
    shown = timed.where(F.col(vector).isNotNull()).select(*own, "id", "taken_ts", vector)
    pairs = burst_pairs(shown, seconds, most_distance, vector, cosine, by) if by else near_pairs(shown, seconds, most_distance, vector, cosine, links=True)
    joined = connected if by else connected_stars
    found = joined(pairs.select(F.col("id").alias("a"), F.col("o_id").alias("b")))
    members = found.withColumnRenamed("node", "id").join(timed.select("id", "taken_ts", "score"), "id")
    first = members.groupBy("component").agg(F.min(F.struct("taken_ts", "id")).alias("_f"))
    kept = members.join(first, "component").where(S.seconds_between("_f.taken_ts", "taken_ts") <= span).withColumn("stack_id", F.col("_f.id"))
    # what is left of a stack lies within its span
    w = Window.partitionBy("stack_id")
    ranked = kept.withColumn("_n", F.count("*").over(w)).where("_n > 1").withColumn("place", F.row_number().over(w.orderBy(F.coalesce("score", F.lit(0.0)).desc(), "taken_ts", "id")) - 1)
    return ranked.select("stack_id", "id", (F.col("place") == 0).alias("is_top"), "place")


def anchored(photos: DataFrame, by: list[str], anchor: Column, part_rows: int | None = None) -> DataFrame:
    """`_l` and `_r`: the nearest anchors before and after each row in the order of time of its group."""
    parts = in_parts(photos, by, ["taken_ts", "id"], F.col("taken_ts").cast("timestamp").cast("double"), part_rows)
    return first_after(last_before(parts, anchor, "_l"), anchor, "_r").done()


def flanked(photos: DataFrame, by: list[str], minutes: float, part_rows: int | None = None) -> DataFrame:
    """For each row without coordinates the nearest row with them on either side within the window."""
    anchor = F.when(F.col("gps_lat").isNotNull() & F.col("gps_lon").isNotNull(), F.struct("id", "taken_ts", "gps_lat", "gps_lon"))
    rows = anchored(photos, by, anchor, part_rows).where("gps_lat is null or gps_lon is null")
    rows = rows.withColumn("left_gap", S.seconds_between("_l.taken_ts", "taken_ts")).withColumn("right_gap", S.seconds_between("taken_ts", "_r.taken_ts"))
    far = minutes * 60
    return rows.withColumn("_l", F.when(F.col("left_gap") <= far, F.col("_l"))).withColumn("_r", F.when(F.col("right_gap") <= far, F.col("_r")))


def infer_locations(photos: DataFrame, by: list[str], minutes: float = 30.0, drift_km: float = 25.0, least: float = 0.0) -> DataFrame:
    """Coordinates from the nearest anchors in time, with a confidence; none where the anchors on both sides lie apart."""
    rows = flanked(photos, by, minutes)
    both = F.col("_l").isNotNull() & F.col("_r").isNotNull()
    drift = F.when(both, S.haversine_km("_l.gps_lat", "_l.gps_lon", "_r.gps_lat", "_r.gps_lon")).otherwise(0.0)
    use_left = F.col("_l").isNotNull() & (F.col("_r").isNull() | (F.col("left_gap") <= F.col("right_gap")))
    source = F.when(use_left, F.col("_l")).otherwise(F.col("_r"))
    gap = F.when(use_left, F.col("left_gap")).otherwise(F.col("right_gap"))
    confidence = F.greatest(F.lit(0.0), 1.0 - gap / (minutes * 60.0)) * F.when(both, 1.0).otherwise(0.7)
    out = rows.withColumn("drift_km", drift).withColumn("_s", source).withColumn("confidence", confidence).where(F.col("_s").isNotNull() & (F.col("drift_km") <= drift_km) & (F.col("confidence") > least))
    return out.select("id", F.col("_s.id").alias("source_id"), F.col("_s.gps_lat").alias("lat"), F.col("_s.gps_lon").alias("lon"), "confidence", "drift_km")


def infer_locations_cascade(photos: DataFrame, by: list[str], minutes: float = 30.0, drift_km: float = 25.0, least: float = 0.0) -> DataFrame:
    """As `infer_locations`, in time order: what was inferred is an anchor for later rows, its confidence multiplied in, one hop more."""
    cut = cut_at_gaps(photos.select(*by, "id", "taken_ts", "gps_lat", "gps_lon"), by, "taken_ts", minutes * 60, "_run")
    window = minutes * 60

    def fold(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["taken_ts", "id"], ignore_index=True)
        t = rows.taken_ts.to_numpy().astype("datetime64[us]").astype(np.int64) / 1e6
        real = (rows.gps_lat.notna() & rows.gps_lon.notna()).to_numpy()
        where = [(rows.at[i, "gps_lat"], rows.at[i, "gps_lon"], 1.0, 0) if real[i] else None for i in range(len(rows))]
        following: list[int | None] = [None] * len(rows)
        nxt = None
        for i in reversed(range(len(rows))):
            following[i] = nxt
            if real[i]:
                nxt = i
        out, last = [], None
        for i in range(len(rows)):
            if not real[i]:
                a = last if last is not None and t[i] - t[last] <= window else None
                b = following[i] if following[i] is not None and t[following[i]] - t[i] <= window else None
                if a is not None or b is not None:
                    apart = _km(where[a], where[b]) if a is not None and b is not None else 0.0
                    pick = a if b is None or (a is not None and t[i] - t[a] <= t[b] - t[i]) else b
                    lat, lon, c, hop = where[pick]
                    confidence = max(0.0, 1 - abs(t[i] - t[pick]) / window) * (1.0 if a is not None and b is not None else 0.7) * c
                    if apart <= drift_km and confidence > least:
                        where[i] = (lat, lon, confidence, hop + 1)
                        out.append((int(rows.at[i, "id"]), lat, lon, confidence, hop + 1))
            if where[i] is not None:
                last = i
        return pd.DataFrame(out, columns=["id", "lat", "lon", "confidence", "hop"])

    w = Window.partitionBy(*by, "_run")
    there = F.count(F.when(F.col("gps_lat").isNotNull() & F.col("gps_lon").isNotNull(), 1)).over(w)
    useful = cut.withColumn("_a", there).withColumn("_n", F.count("*").over(w)).where("_a > 0 and _a < _n").drop("_a", "_n")
    return grouped(useful, [*by, "_run"], fold, "id bigint, lat double, lon double, confidence double, hop int")


def _km(a: tuple, b: tuple) -> float:
    x, y = math.radians(a[0]), math.radians(b[0])
    h = math.sin((y - x) / 2) ** 2 + math.cos(x) * math.cos(y) * math.sin(math.radians(b[1] - a[1]) / 2) ** 2
    return 2 * S.EARTH_KM * math.asin(math.sqrt(h))


def capped_scenes(scenes: DataFrame, by: list[str], cap: int) -> DataFrame:
    """At most `cap` scenes of a book: days share by photos (at least one), the densest scenes of each day stay.

    Scenes are a book's few; a book is a group.
    """

    def choose(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["day", "first_ts"], ignore_index=True)
        if len(rows) > cap:
            weight, have = rows.groupby("day").n.sum(), rows.groupby("day").size()
            budget = np.minimum(np.maximum(1, np.floor(cap * weight / weight.sum())), have).astype(int)
            while budget.sum() > cap and (budget > 1).any():
                over = budget[budget > 1].index
                budget[min(over, key=lambda d: (weight[d], d))] -= 1
            for d in sorted(weight.index, key=lambda d: (-weight[d], d)):
                if budget.sum() >= cap:
                    break
                if budget[d] < have[d]:
                    budget[d] += 1
            kept = [g.sort_values(["n", "first_ts"], ascending=[False, True]).head(int(budget[d])) for d, g in rows.groupby("day")]
            rows = pd.concat(kept).sort_values(["day", "first_ts"], ignore_index=True)
        rows["place"] = np.arange(1, len(rows) + 1)
        return rows

    kinds = ", ".join(f"`{c}` {t}" for c, t in scenes.dtypes)
    return scenes.groupBy(*by).applyInPandas(choose, f"{kinds}, place bigint")


def overlap_days(a1: Column, a2: Column, b1: Column, b2: Column) -> Column:
    """Days that two ranges share: NULL for unknown ends, 0 if apart or only touching, else at least 1."""
    first, last = F.greatest(a1, b1), F.least(a2, b2)
    unknown = a1.isNull() | a2.isNull() | b1.isNull() | b2.isNull()
    return F.when(unknown, None).when(first >= last, 0).otherwise(F.greatest(F.lit(1), F.floor(S.seconds_between(first, last) / 86400))).cast("bigint")


#: Pairs of ranges that one task makes, about.
TASK_PAIRS = 1 << 26


def overlapping(ranges: DataFrame, id_col: str, first: str, last: str) -> DataFrame:
    """left, right and the days that their ranges share (as `overlap_days`), for every two rows, left < right.

    The result grows with the square of the rows; they are dealt to so many tasks that each makes some
    `TASK_PAIRS` pairs at most, and ends are turned to numbers before the pairs are made.
    """
    held = written(ranges.select(F.col(id_col).alias("id"), S.micros(first).alias("a"), S.micros(last).alias("b")))
    n = held.count()
    tasks = min(max(1, n), max(1, -(-n * n // TASK_PAIRS)))
    x = held.select(F.col("id").alias("left"), F.col("a").alias("a1"), F.col("b").alias("b1")).repartition(tasks, "left")
    y = held.select(F.col("id").alias("right"), F.col("a").alias("a2"), F.col("b").alias("b2"))
    start, end = F.greatest("a1", "a2"), F.least("b1", "b2")
    unknown = F.col("a1").isNull() | F.col("b1").isNull() | F.col("a2").isNull() | F.col("b2").isNull()
    days = F.when(unknown, None).when(start >= end, 0).otherwise(F.greatest(F.lit(1), F.floor((end - start) / F.lit(1e6) / 86400))).cast("bigint")
    return x.join(y, F.col("left") < F.col("right")).select("left", "right", days.alias("days"))
