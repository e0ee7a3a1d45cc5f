"""Tables of key buckets: a write rewrites the buckets that it touches, and a manifest says which files count.

Rows lie in buckets by a hash of their key.  A write reads the buckets of its
changes, writes what becomes of them to a folder of its own, and then puts down a
new manifest: for each bucket its folder and the version that wrote it last.  Readers
read what one manifest names.  A write that fails before its manifest leaves
files that no manifest names and no reader sees; it is simply done again.  Two
writers that began from one version cannot both put down the next: the later one fails.

The manifest has a line for each bucket, whose number is a parameter, and may
carry marks (such as the version up to which a stage has seen the table), which
are put down with the rows in one step.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lightshelf.operators import upkeep

CHANGED = "changed"


@dataclass
class BucketedTable:
    """A table in a folder that all executors share; `schema` without the column `changed`, the version that wrote a row last."""

    spark: SparkSession
    path: str
    keys: list[str]
    schema: str
    buckets: int = 64

    # --- manifests ---

    def _files(self):
        jvm = self.spark._jvm
        at = jvm.org.apache.hadoop.fs.Path(self.path)
        return jvm.org.apache.hadoop.fs.Path, at.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def manifest(self, version: int | None = None) -> dict:
        """The manifest of a version, by default the latest; version 0 is an empty table."""
        path, fs = self._files()
        folder = path(f"{self.path}/manifests")
        if version is None:
            names = [s.getPath().getName() for s in fs.listStatus(folder)] if fs.exists(folder) else []
            version = max((int(n) for n in names if n.isdigit()), default=0)
        if not version:
            return {"version": 0, "buckets": {}, "marks": {}}
        stream = fs.open(path(f"{self.path}/manifests/{version:09d}"))
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def _put(self, manifest: dict) -> None:
        path, fs = self._files()
        draft = path(f"{self.path}/drafts/{uuid.uuid4().hex}")
        stream = fs.create(draft, False)
        try:
            stream.write(bytearray(json.dumps(manifest).encode()))
        finally:
            stream.close()
        final = path(f"{self.path}/manifests/{manifest['version']:09d}")
        fs.mkdirs(final.getParent())
        if fs.exists(final) or not fs.rename(draft, final):
            raise RuntimeError(f"version {manifest['version']} was written by another writer")

    # --- reading ---

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")

    def _read(self, folders: list[str]) -> DataFrame:
        schema = f"{self.schema}, {CHANGED} bigint"
        return self.spark.read.schema(schema).parquet(*folders) if folders else self.spark.createDataFrame([], schema)

    def read(self, version: int | None = None) -> DataFrame:
        return self._read([b["folder"] for b in self.manifest(version)["buckets"].values()])

    def since(self, version: int) -> DataFrame:
        """Rows written after a version; buckets that no later version wrote are not read."""
        return self._read([b["folder"] for b in self.manifest()["buckets"].values() if b["version"] > version]).where(F.col(CHANGED) > version)

    # --- writing ---

    def create(self, rows: DataFrame) -> BucketedTable:
        """The first rows, which may have equal keys."""
        self.write(rows, lambda old, new: old.unionByName(new.select(*old.columns)))
        return self

    def write(self, changes: DataFrame, become: Callable[[DataFrame, DataFrame], DataFrame], marks: dict | None = None) -> int:
        """Rewrites the buckets that `changes` touch: `become` gets their rows and the changes. Returns how many were rewritten."""
        held = self.manifest()
        columns = self.spark.createDataFrame([], self.schema).columns
        changes = changes.withColumn("_bucket", self._bucket())
        touched = {r[0] for r in changes.select("_bucket").distinct().collect()}  # no more than buckets
        if touched:
            version = held["version"] + 1
            old = self._read([held["buckets"][str(b)]["folder"] for b in sorted(touched) if str(b) in held["buckets"]])
            new = become(old.drop(CHANGED), changes.drop("_bucket")).select(*columns)
            # a row that is as it was keeps its version
            before = old.select(*[F.col(c).alias(f"_{c}") for c in columns], CHANGED)
            same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in columns]
            first = before.dropDuplicates([f"_{c}" for c in columns])
            rows = new.join(first, same, "left").select(*columns, F.coalesce(CHANGED, F.lit(version).cast("bigint")).alias(CHANGED))
            folder = f"{self.path}/data/{version:09d}-{uuid.uuid4().hex}"
            rows.withColumn("bucket", self._bucket()).repartition("bucket").write.partitionBy("bucket").parquet(folder)
            path, fs = self._files()
            there = {int(s.getPath().getName().removeprefix("bucket=")) for s in fs.listStatus(path(folder)) if s.getPath().getName().startswith("bucket=")}
            buckets = {k: v for k, v in held["buckets"].items() if int(k) not in touched}
            buckets |= {str(b): {"folder": f"{folder}/bucket={b}", "version": version} for b in there}
            held = held | {"version": version, "buckets": buckets}
        elif marks:
            held = held | {"version": held["version"] + 1}
        if touched or marks:
            self._put(held | {"marks": held["marks"] | (marks or {})})
        return len(touched)

    def upsert(self, rows: DataFrame, marks: dict | None = None) -> int:
        """Rows replace those of equal keys, or are added."""
        return self.write(rows, lambda old, new: upkeep.upserted(old, new.select(*old.columns), self.keys), marks)

    def merge(self, rows: DataFrame, marks: dict | None = None) -> int:
        """Values that are not NULL replace those of equal keys, column by column; rows of new keys are added."""
        return self.write(rows, lambda old, new: upkeep.merged(old, new, self.keys), marks)

    def insert(self, rows: DataFrame, marks: dict | None = None) -> int:
        """Rows are added whose keys are not there."""
        return self.write(rows, lambda old, new: upkeep.inserted(old, new.select(*old.columns), self.keys), marks)

    def replace(self, keys: DataFrame, rows: DataFrame) -> int:
        """All rows of the keys named go, and `rows`, which are of those keys, take their place: keys may have many rows or none."""
        return self.write(keys.select(*self.keys).distinct(), lambda old, new: old.join(new, self.keys, "left_anti").unionByName(rows.join(new, self.keys, "left_semi").select(*old.columns)))

    def delete(self, keys: DataFrame) -> int:
        return self.write(keys.select(*self.keys).distinct(), lambda old, new: old.join(new, self.keys, "left_anti"))

    def sweep_files(self) -> int:
        """Removes bucket folders that the latest manifest does not name; for when no reader or writer is at work. Returns how many."""
        path, fs = self._files()
        data = path(f"{self.path}/data")
        tail = lambda folder: tuple(folder.rsplit("/", 2)[-2:])
        named = {tail(b["folder"]) for b in self.manifest()["buckets"].values()}
        found = [b.getPath() for w in (fs.listStatus(data) if fs.exists(data) else []) for b in fs.listStatus(w.getPath()) if b.isDirectory()]
        gone = [p for p in found if tail(p.toString()) not in named]
        for p in gone:
            fs.delete(p, True)
        return len(gone)


# --- writes of several tables -----------------------------------------------


def submit_results(results: DataFrame, photos: BucketedTable, processed: BucketedTable, activity: BucketedTable, step: str, batch: str, at: str) -> None:
    """Results of a pass (id and columns of `photos`): values that are not NULL are taken over, the rows are marked as processed, and the batch is logged.

    A batch that is submitted again changes nothing: marks and log rows are named by it.
    """
    photos.merge(results)
    before = processed.read().where(F.col("pass_type") == step).select("id", F.col("attempts").alias("_n"), F.col("batch").alias("_b"))
    marks = results.select("id").distinct().join(before, "id", "left")
    tried = F.when(F.col("_b") == batch, F.col("_n")).otherwise(F.coalesce("_n", F.lit(0)) + 1)
    processed.upsert(marks.select("id", F.lit(step).alias("pass_type"), tried.cast("int").alias("attempts"), F.lit(batch).alias("batch")))
    n = results.agg(F.count("*").alias("n")).where("n > 0")  # no row for an empty batch
    activity.upsert(n.select(F.lit(batch).alias("batch"), F.lit(step).alias("pass_type"), F.lit(at).cast("timestamp").alias("at"), "n"))


def mirror(photos: BucketedTable, vectors: BucketedTable, faces: BucketedTable, scalars: DataFrame | None = None, embeddings: DataFrame | None = None, found: DataFrame | None = None, asked: DataFrame | None = None) -> None:
    """The state of other photos taken over: scalars that are given; vectors replaced, or taken away where NULL; all faces of the photos asked for replaced."""
    if scalars is not None:
        photos.merge(scalars)
    if embeddings is not None:
        vectors.replace(embeddings.select("photo_id"), embeddings.where("embedding is not null"))
    if found is not None:
        faces.replace(asked, found)


def restack(members: BucketedTable, new: DataFrame) -> None:
    """Stacks that share a photo with a new one are dissolved, then the new ones stand; other stacks are not touched."""
    now = members.read()
    hit = now.join(new.select("photo_id"), "photo_id", "left_semi").select("stack_id").distinct()
    gone = now.join(hit, "stack_id", "left_semi").select("photo_id")
    keys = gone.unionByName(new.select("photo_id")).distinct()
    members.replace(keys, new)


def save_selection(selections: BucketedTable, scope: str, chosen: DataFrame) -> None:
    """A scope's choice (photo_id, selected, cluster, rank_in_cluster) in place of the one it had; `selections` is keyed by `scope`."""
    key = chosen.sparkSession.createDataFrame([(scope,)], "scope string")
    selections.replace(key, chosen.withColumn("scope", F.lit(scope)))


def toggle_selection(selections: BucketedTable, photo_id: int, selected: bool) -> int:
    """A photo's mark in every scope that has it; buckets of other scopes are not touched."""
    hit = selections.read().where(F.col("photo_id") == photo_id).select("scope").distinct()
    mark = F.when(F.col("photo_id") == photo_id, selected).otherwise(F.col("selected"))
    return selections.write(hit, lambda old, _: old.withColumn("selected", mark))
