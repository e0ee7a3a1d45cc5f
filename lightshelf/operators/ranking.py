"""Windows, top-k, sort modes, rank fusion and greedy suppression."""

from __future__ import annotations

from bisect import bisect
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lightshelf.functions import scalar as S
from lightshelf.operators.lineage import written
from lightshelf.operators.scans import in_parts, last_before, running_sum


def top_per_group(df: DataFrame, by: list[str], order: list[Column], n: int, rank: str = "rn") -> DataFrame:
    """The first n rows of each group; the order should end in an id. Spark keeps n rows of each group before the shuffle."""
    return df.withColumn(rank, F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col(rank) <= n)


def latest_per_key(df: DataFrame, by: list[str], order: list[Column]) -> DataFrame:
    return top_per_group(df, by, order, 1, "_latest").drop("_latest")


def dedupe_by_hash(df: DataFrame, order: list[Column], key: str = "file_hash", id_col: str = "id") -> DataFrame:
    """The first row, in order, of those with equal keys; rows without a key all stay."""
    same = F.when(F.col(key).isNull() | (F.col(key) == ""), F.concat(F.lit("id:"), F.col(id_col).cast("string"))).otherwise(F.col(key))
    return latest_per_key(df.withColumn("_same", same), ["_same"], order).drop("_same")


def sort_order(mode: str, id_col: str = "id", quality: str = "score", percentile: str | None = None, date: str = "date_taken", relevance: str = "rrf") -> list[Column]:
    """Sort keys of a mode; the undated and unscored come last, ties by id."""
    valid = F.when(S.valid_date(date), F.col(date))
    if mode == "date_desc":
        return [valid.desc_nulls_last(), F.col(id_col)]
    if mode == "date_asc":
        return [valid.asc_nulls_last(), F.col(id_col)]
    if mode in ("quality", "aesthetic", "subject", "day"):
        best = F.coalesce(F.col(quality), F.lit(-1.0)) if percentile is None else F.coalesce(F.col(percentile) + 1000, F.col(quality), F.lit(-1.0))
        return [best.desc(), F.col(id_col)]
    if mode == "relevance":
        return [F.col(relevance).desc_nulls_last(), F.col(id_col)]
    raise ValueError(f"unknown sort: {mode}")


def page(df: DataFrame, order: list[Column], offset: int, limit: int) -> DataFrame:
    return df.orderBy(*order).offset(offset).limit(limit)


def ranked(df: DataFrame, order: list[Column], id_col: str = "id", rank: str = "rank") -> DataFrame:
    """id and its rank from 0 in the given order, which should end in an id.

    Rows are dealt to ranges of the order, and written so that the ranges stay
    as they are; rows count within their range, and the sizes of the ranges
    before, a number for each, are added.
    """
    # ids of sorted ranges: the range in the upper bits, the place within it in the lower 33
    rows = written(df.repartitionByRange(*order).sortWithinPartitions(*order).select(id_col, F.monotonically_increasing_id().alias("_at")))
    placed = rows.select(id_col, F.shiftright("_at", 33).alias("_range"), F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)).alias("_place"))
    sizes = placed.groupBy("_range").agg(F.count("*").alias("_n"))
    before = sizes.select("_range", F.coalesce(F.sum("_n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))  # a row for each range
    return placed.join(F.broadcast(before), "_range").select(id_col, (F.col("_before") + F.col("_place")).alias(rank))


def fused(sets: list[DataFrame], id_col: str = "id", k: int = 60) -> DataFrame:
    """Ids that are in every set, with the sum of 1 / (k + rank) over the sets (each with columns id, rank)."""
    named = [s.select(id_col, F.col("rank").alias(f"_r{i}")) for i, s in enumerate(sets)]
    joined = reduce(lambda a, b: a.join(b, id_col), named)
    return joined.select(id_col, sum((F.lit(1.0) / (F.lit(k) + F.col(f"_r{i}")) for i in range(len(sets))), F.lit(0.0)).alias("rrf"))


def buckets_best_first(df: DataFrame, bucket: str, score: str, n_buckets: int, id_col: str = "id") -> DataFrame:
    """Rows of the buckets whose best scores are the highest, best first."""
    best = df.groupBy(bucket).agg(F.max(score).alias("_best"))
    keep = best.orderBy(F.col("_best").desc_nulls_last(), bucket).limit(n_buckets)
    return df.join(keep, bucket).orderBy(F.col("_best").desc_nulls_last(), bucket, F.col(score).desc_nulls_last(), id_col).drop("_best")


def cut_at_gaps(df: DataFrame, by: list[str], ts: str, seconds: float, out: str, place: str | None = None, strictly: bool = True, part_rows: int | None = None) -> DataFrame:
    """Number of the run of rows, within each group, whose consecutive gaps are at most `seconds` (below it if not `strictly`).

    With `place`, a run also ends where that column changes from one known value to another.  A large group is cut into
    parts, each of which hears of the row before its first and of the runs begun so far.
    """
    parts = in_parts(df, by, [ts, "id"], F.col(ts).cast("timestamp").cast("double"), part_rows)
    before = last_before(parts, F.struct(F.col(ts).alias("t"), *([F.col(place).alias("p")] if place else [])), "_before")
    gap = S.seconds_between("_before.t", ts)
    new = gap.isNull() | (gap > seconds if strictly else gap >= seconds)
    if place:
        new = new | F.coalesce(F.col("_before.p") != F.col(place), F.lit(False))
    return running_sum(before, new.cast("int"), out).done().drop("_before")


def keep_best_apart(df: DataFrame, by: list[str], seconds: float, n: int | None = None, score: str = "score", ts: str = "taken_ts", same: list[str] | None = None) -> DataFrame:
    """Greedy suppression: best first, a row stays unless it lies within `seconds` of one kept, or shares a key with one.

    Greedy choice looks at what was kept before, so each group lies in one task,
    which goes through its sorted rows and holds only what it kept of the
    present group; groups are days or buckets, which may be cut further where no gap
    is shorter than `seconds` (see `cut_at_gaps`).  NULL times and keys never reject.
    """
    same = same or []
    window = seconds * 1e6
    order = F.coalesce(F.nanvl(F.col(score).cast("double"), F.lit(-np.inf)), F.lit(-np.inf)).desc()
    rows = df.withColumn("_t", S.micros(ts)).repartition(*by).sortWithinPartitions(*by, order, "id")

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, kept, times, seen = None, 0, [], {}
        for batch in batches:
            groups = list(zip(*(batch.column(c).to_pylist() for c in by)))
            marks = list(zip(*(batch.column(c).to_pylist() for c in same))) if same else [()] * len(groups)
            stay = []
            for i, (g, t, keys) in enumerate(zip(groups, batch.column("_t").to_pylist(), marks)):
                if g != group:
                    group, kept, times, seen = g, 0, [], {k: set() for k in range(len(same))}
                if n is not None and kept >= n:
                    continue
                held = [(k, v) for k, v in enumerate(keys) if v is not None and v == v and v != ""]
                if any(v in seen[k] for k, v in held):
                    continue
                if t is not None:
                    at = bisect(times, t)
                    if any(abs(t - x) < window for x in times[max(0, at - 1) : at + 1]):
                        continue
                    times.insert(at, t)
                kept += 1
                stay.append(i)
                for k, v in held:
                    seen[k].add(v)
            yield batch.take(pa.array(stay, pa.int64())).select(names)

    names = df.columns
    return rows.mapInArrow(choose, df.schema)


def best_apart(df: DataFrame, by: list[str], seconds: float, n: int, score: str = "score", ts: str = "taken_ts", same: list[str] | None = None) -> DataFrame:
    """The first `n` rows of each group that `keep_best_apart` keeps, without sorting whole groups.

    The best few of each group are tried first; groups in which too many of
    them fell get eight times as many, until they have `n` or have no more.
    """
    most, todo, done = 6 * n, df, None
    while True:
        near = top_per_group(todo, by, [F.col(score).desc_nulls_last(), F.col("id")], most, "_rn").drop("_rn")
        kept = written(keep_best_apart(near, by, seconds, n, score, ts, same))
        full = kept.groupBy(*by).agg(F.count("*").alias("_n")).where(F.col("_n") >= n).select(*by)
        short = written(todo.groupBy(*by).agg(F.count("*").alias("_n")).where(F.col("_n") > most).select(*by).join(full, by, "left_anti"))
        left = short.count()
        sure = kept if not left else kept.join(F.broadcast(short) if left <= 100_000 else short, by, "left_anti")
        done = sure if done is None else done.unionByName(sure)
        if not left:
            return done
        todo, most = todo.join(short, by, "left_semi"), 8 * most


def grouped(df: DataFrame, keys: list[str], run: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """`run` on each group of many small ones: groups are dealt to buckets by hash, and a bucket's groups run in one call.

    Buckets are a few for each shuffle partition, which is sized to the data.
    """
    n = 4 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def each(rows: pd.DataFrame) -> pd.DataFrame:
        parts = [run(g.drop(columns="_bucket")) for _, g in rows.groupby(keys, sort=True, dropna=False)]
        return pd.concat([p for p in parts if len(p)] or parts[:1], ignore_index=True)

    return df.withColumn("_bucket", F.pmod(F.xxhash64(*keys), F.lit(n))).groupBy("_bucket").applyInPandas(each, schema)


def even_parts(df: DataFrame, order: list[Column], k: int, by: list[str] | None = None, out: str = "part") -> DataFrame:
    """Chronological parts of equal size within each scope; the first ones take the rest."""
    return df.withColumn(out, F.ntile(k).over(Window.partitionBy(*(by or [F.lit(1)])).orderBy(*order)))


def largest_remainder(df: DataFrame, weight: str, seats: int, key: str, by: list[str] | None = None, out: str = "seats") -> DataFrame:
    """Seats by weight: whole shares, and the rest to the largest remainders."""
    scope = Window.partitionBy(*(by or [F.lit(1)]))
    share = F.col(weight) * F.lit(float(seats)) / F.sum(weight).over(scope)
    parts = df.withColumn("_w", F.floor(share)).withColumn("_r", share - F.floor(share))
    left = F.lit(seats) - F.sum("_w").over(scope)
    rank = F.row_number().over((Window.partitionBy(*(by or [F.lit(1)]))).orderBy(F.desc("_r"), key))
    return parts.withColumn("_left", left).withColumn("_k", rank).withColumn(out, (F.col("_w") + (F.col("_k") <= F.col("_left")).cast("bigint")).cast("bigint")).drop("_w", "_r", "_left", "_k")


def interleaved(df: DataFrame, kind: str, order: list[Column], by: list[str] | None = None) -> DataFrame:
    """Rows of each kind in turn: place within the kind, then kind."""
    return df.withColumn("turn", F.row_number().over(Window.partitionBy(*(by or []), kind).orderBy(*order)))
