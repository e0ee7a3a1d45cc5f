"""Upkeep: validation and repair, enrichment queues, merges, stacks, collections, duplicate plans, sweeps."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lightshelf.functions import scalar as S
from lightshelf.operators.filters import bad_gps
from lightshelf.operators.ranking import latest_per_key
from lightshelf.operators.scans import row_numbers

MAX_ATTEMPTS = 3


# --- quality ---------------------------------------------------------------


def quality_report(photos: DataFrame, faces: DataFrame | None = None, bad: Column | None = None) -> DataFrame:
    """Counts of faulty rows by kind, in one pass (orphan faces by an anti join); `bad` says which coordinates are faulty, by default those at 0, 0 and out of range."""
    kinds = {
        "corrupt_date": F.col("date_taken").isNotNull() & ~S.valid_date("date_taken"), "missing_date": F.col("date_taken").isNull(), "bad_gps": bad_gps() if bad is None else bad, "half_gps": F.col("gps_lat").isNull() != F.col("gps_lon").isNull(),
        "missing_hash": F.col("file_hash").isNull() | (F.col("file_hash") == ""), "missing_place": F.col("place_name").isNull(), "bad_score": ~F.coalesce(F.col("score").between(0, 100), F.lit(True)),
    }
    counted = photos.agg(*[F.count(F.when(c, 1)).alias(k) for k, c in kinds.items()])
    pairs = ", ".join(f"'{k}', {k}" for k in kinds)
    out = counted.selectExpr(f"stack({len(kinds)}, {pairs}) AS (kind, n)")
    if faces is None:
        return out
    orphans = faces.join(photos, "photo_id", "left_anti").agg(F.count("*").alias("n")).select(F.lit("orphan_face").alias("kind"), "n")
    return out.unionByName(orphans)


def repaired(photos: DataFrame, bad: Column | None = None) -> DataFrame:
    """Corrupt dates replaced by the folder's date, impossible coordinates (or those that `bad` names) taken away."""
    bad = bad_gps() if bad is None else bad
    date = F.when(S.valid_date("date_taken"), F.col("date_taken")).otherwise(F.concat(S.folder_date("filepath"), F.lit(" 00:00:00")))
    return photos.withColumn("date_taken", date).withColumn("_bad", bad).withColumn("gps_lat", F.when(~F.col("_bad"), F.col("gps_lat"))).withColumn("gps_lon", F.when(~F.col("_bad"), F.col("gps_lon"))).drop("_bad")


def garbage_tags(c, most: int = 16) -> Column:
    """A JSON array of tags, NULL where it has `most` or more."""
    return F.when(F.coalesce(F.json_array_length(S.col(c)), F.lit(0)) < most, S.col(c))


# --- queues ----------------------------------------------------------------


@dataclass(frozen=True)
class Pass:
    """An enrichment pass: rows lack it where `missing` holds; some passes need other columns first."""

    name: str
    missing: str
    capped: bool = False
    needs: str | None = None


def unprocessed(photos: DataFrame, step: Pass, processed: DataFrame | None = None, claims: DataFrame | None = None, now: str | None = None, key: str = "id") -> DataFrame:
    """Rows that lack a pass, less those with too many attempts, and those claimed by claims that have not run out."""
    out = photos.where(step.missing)
    if step.needs:
        out = out.where(step.needs)
    if step.capped and processed is not None:
        out = out.join(processed.where((F.col("pass_type") == step.name) & (F.col("attempts") >= MAX_ATTEMPTS)).select(key), key, "left_anti")
    if claims is not None:
        live = claims if now is None else claims.where(F.col("expires_at") > F.lit(now).cast("timestamp"))
        out = out.join(live.where(F.col("pass_type") == step.name).select(key), key, "left_anti")
    return out


def queue_depths(photos: DataFrame, passes: list[Pass]) -> DataFrame:
    """Rows that lack each pass, in one scan."""
    counted = photos.agg(*[F.count(F.when(F.expr(f"({p.missing}) AND ({p.needs or 'true'})"), 1)).alias(p.name) for p in passes])
    return counted.selectExpr(f"stack({len(passes)}, " + ", ".join(f"'{p.name}', `{p.name}`" for p in passes) + ") AS (pass_type, n)")


def stuck(rows: DataFrame, value: str, attempts: str = "attempts") -> DataFrame:
    """Rows with an empty result, or without one after all attempts."""
    v = F.col(value)
    return rows.where(v.isin("", "[]") | (v.isNull() & (F.col(attempts) >= MAX_ATTEMPTS)))


# --- tables as values ------------------------------------------------------


def one_per_key(df: DataFrame, keys: list[str]) -> DataFrame:
    """One row for each key: that with the largest values, column by column."""
    return latest_per_key(df, keys, [F.col(c).desc_nulls_last() for c in df.columns if c not in keys] or [F.lit(0)])


def upserted(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """The table after new rows replace those of equal keys; of new rows with equal keys one counts."""
    return old.join(new.select(*keys), keys, "left_anti").unionByName(one_per_key(new, keys))


def inserted(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """The table after new rows are added whose keys it lacks."""
    return old.unionByName(new.join(old.select(*keys), keys, "left_anti").dropDuplicates(keys))


def merged(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """The table after new values that are not NULL replace old ones, column by column; of new rows with equal keys one counts."""
    n = one_per_key(new, keys).select(*keys, *[F.col(c).alias(f"_n_{c}") for c in new.columns if c not in keys])
    joined = old.join(n, keys, "full_outer")
    return joined.select(*keys, *[F.coalesce(f"_n_{c}", c).alias(c) if f"_n_{c}" in joined.columns else F.col(c) for c in old.columns if c not in keys])


def without_orphans(rows: DataFrame, parents: DataFrame, key: str) -> DataFrame:
    return rows.join(parents.select(key).distinct(), key, "left_semi")


def stacks_created(members: DataFrame, new: DataFrame) -> DataFrame:
    """Stack members after new stacks took theirs from other stacks; stacks of one are dissolved, a lost top is replaced by the best."""
    left = members.join(new.select("photo_id"), "photo_id", "left_anti")
    size = Window.partitionBy("stack_id")
    kept = left.withColumn("_n", F.count("*").over(size)).where("_n > 1")
    best = F.first("photo_id").over(size.orderBy(F.desc("is_top"), F.col("score").desc_nulls_last(), "photo_id").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    topped = kept.withColumn("is_top", F.col("photo_id") == best).drop("_n")
    return topped.unionByName(new.select(topped.columns))


def stack_overview(members: DataFrame) -> DataFrame:
    return members.groupBy("stack_id").agg(F.count("*").alias("n"), F.max(F.when(F.col("is_top"), F.col("photo_id"))).alias("top_id"), F.max("score").alias("best"))


def expanded_to_stacks(ids: DataFrame, members: DataFrame) -> DataFrame:
    """Ids with all members of their stacks."""
    stacks = members.join(ids, "photo_id", "left_semi").select("stack_id").distinct()
    return ids.select("photo_id").unionByName(members.join(stacks, "stack_id", "left_semi").select("photo_id")).distinct()


def appended(collection: DataFrame, new: DataFrame) -> DataFrame:
    """Photos added to collections behind the last place, those already there left out: collection_id, photo_id, sort_order."""
    fresh = new.join(collection.select("collection_id", "photo_id"), ["collection_id", "photo_id"], "left_anti")
    last = collection.groupBy("collection_id").agg(F.max("sort_order").alias("_last"))
    numbered = row_numbers(fresh.select("collection_id", "photo_id"), ["collection_id"], ["photo_id"], "_rn")
    placed = numbered.join(last, "collection_id", "left").select("collection_id", "photo_id", (F.coalesce("_last", F.lit(0)) + F.col("_rn")).alias("sort_order"))
    return collection.select("collection_id", "photo_id", "sort_order").unionByName(placed)


def tags_added(old, new, replace: bool = False) -> Column:
    """Tags with new ones behind them, each once; or the new ones alone."""
    return F.array_distinct(S.col(new)) if replace else F.array_union(F.coalesce(S.col(old), F.array().cast("array<string>")), S.col(new))


def located(photos: DataFrame, writes: DataFrame, overwrite: bool = False) -> DataFrame:
    """Coordinates written to photos that have none, or to all if asked: writes have (id, lat, lon)."""
    w = one_per_key(writes.select("id", F.col("lat").alias("_lat"), F.col("lon").alias("_lon")), ["id"])
    take = F.col("_lat").isNotNull() & (F.lit(overwrite) | F.col("gps_lat").isNull())
    out = photos.join(w, "id", "left").withColumn("_take", take)
    return out.withColumn("gps_lat", F.when(F.col("_take"), F.col("_lat")).otherwise(F.col("gps_lat"))).withColumn("gps_lon", F.when(F.col("_take"), F.col("_lon")).otherwise(F.col("gps_lon"))).withColumn("location_source", F.when(F.col("_take"), "written")).drop("_lat", "_lon", "_take")


# --- duplicates and paths --------------------------------------------------


def duplicate_plan(groups: DataFrame) -> DataFrame:
    """Which row of each component stays: most named faces, then faces, then a description, then the lowest id."""
    w = Window.partitionBy("component").orderBy(F.desc("named_faces"), F.desc("faces"), F.desc("has_description"), "id")
    size = F.count("*").over(Window.partitionBy("component"))
    return groups.withColumn("rn", F.row_number().over(w)).withColumn("n", size).where("n > 1").select("component", "id", (F.col("rn") == 1).alias("keep"), "n")


# A file in the folder of a day below that of its year, and the number that marks a copy of a file.
DAY_FOLDER = r"(?:^|/)(\d{4})/\1-\d{2}-\d{2}[^/]*/[^/]+$"
COPY_MARK = r"(?:\(\d+\)|-\d{3,})\.[^.]+$"


def canonical_paths(photos: DataFrame, key: str = "file_hash") -> DataFrame:
    """Of files with equal hashes the one to keep: in a day's folder, no copy mark, the shortest name, then the shortest path."""
    dated, copy = F.col("filepath").rlike(DAY_FOLDER), F.col("filename").rlike(COPY_MARK)
    w = Window.partitionBy(key).orderBy(F.desc(dated.cast("int")), copy.cast("int"), F.length("filename"), "filename", F.length("filepath"), "filepath", "id")
    n = F.count("*").over(Window.partitionBy(key))
    return photos.where(F.col(key).isNotNull() & (F.col(key) != "")).withColumn("rn", F.row_number().over(w)).withColumn("n", n).where("n > 1").select(key, "id", "filepath", (F.col("rn") == 1).alias("keep"))


def remapped(path, old: str, new: str) -> Column:
    """A path with the prefix `old` (whole folders) replaced."""
    c = S.col(path)
    return F.when((c == old) | F.startswith(c, F.lit(old.rstrip("/") + "/")), F.concat(F.lit(new.rstrip("/")), F.substring(c, len(old.rstrip("/")) + 1, 1 << 30))).otherwise(c)


def relocated(photos: DataFrame) -> DataFrame:
    """Targets under year folders, and whether another file goes to the same place."""
    target = F.concat(F.lit("/lib/"), F.substring("day", 1, 4), F.lit("/"), F.regexp_extract("folder", "([^/]+)$", 1), F.lit("/"), F.col("filename"))
    rows = photos.select("id", "filepath", target.alias("target"))
    return rows.withColumn("conflict", F.count("*").over(Window.partitionBy("target")) > 1)


# --- sweep -----------------------------------------------------------------


@dataclass(frozen=True)
class Stage:
    """A stage of a sweep: which rows it would change, and how."""

    name: str
    would: Callable[[DataFrame], DataFrame]
    apply: Callable[[DataFrame], DataFrame]
    after: tuple[str, ...] = ()


def ordered(stages: list[Stage]) -> list[Stage]:
    """Stages so that each follows those it depends on."""
    left, out, done = list(stages), [], set()
    while left:
        ready = [s for s in left if set(s.after) <= done]
        if not ready:
            raise ValueError("stages depend on each other in a circle")
        out += ready
        done |= {s.name for s in ready}
        left = [s for s in left if s.name not in done]
    return out


def swept(photos: DataFrame, stages: list[Stage], dry_run: bool = False) -> tuple[DataFrame, DataFrame]:
    """The table after all stages (unchanged in a dry run), and how many rows each stage would change when its turn comes."""
    counts, now = None, photos
    for s in ordered(stages):
        n = s.would(now).agg(F.count("*").alias("n")).select(F.lit(s.name).alias("stage"), "n")
        counts = n if counts is None else counts.unionByName(n)
        now = s.apply(now)
    return (photos if dry_run else now), counts


def fingerprint(df: DataFrame, key: str = "id") -> DataFrame:
    return df.agg(F.count("*").alias("n"), F.max(key).alias("max_id"))


def latest_generation(generations: DataFrame) -> DataFrame:
    return latest_per_key(generations, ["photo_id", "text_type"], [F.desc("created_at"), F.desc("id")])
