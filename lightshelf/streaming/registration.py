"""Files registered as they arrive: a file stream whose batches are looked at, paired and written to key-bucketed tables.

A batch that is run again after a restart finds its paths in the tables, and adds nothing twice.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lightshelf.plans.vocabulary import EXTENSIONS
from lightshelf.sources import files
from lightshelf.sources.tables import BucketedTable

#: Files that go with a picture of the same name.
RAW = (".arw",)
PHOTOS = "filepath string, filename string, folder string, file_hash string, size bigint, modified timestamp, raw_filepath string"
RAWS = "stem string, raw_filepath string"
REJECTS = "filepath string, reason string"


@dataclass
class Registry:
    """Registered pictures, raw files seen, and files that are no pictures, below one folder."""

    photos: BucketedTable
    raws: BucketedTable
    rejects: BucketedTable

    @classmethod
    def at(cls, spark: SparkSession, path: str, buckets: int = 64) -> Registry:
        return cls(BucketedTable(spark, f"{path}/photos", ["filepath"], PHOTOS, buckets), BucketedTable(spark, f"{path}/raws", ["stem"], RAWS, buckets), BucketedTable(spark, f"{path}/rejects", ["filepath"], REJECTS, buckets))


def arrivals(spark: SparkSession, folder: str, files_per_batch: int = 10_000) -> DataFrame:
    """A stream of the files below a folder (path, modificationTime, length, content)."""
    schema = "path string, modificationTime timestamp, length bigint, content binary"
    return spark.readStream.format("binaryFile").schema(schema).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", str(files_per_batch)).load(folder)


def _stem(path: str) -> Column:
    return F.regexp_replace(path, r"\.[^./]*$", "")


def register(batch: DataFrame, registry: Registry, extensions: tuple[str, ...] = EXTENSIONS) -> None:
    """Takes over a batch of files: new pictures with their hash and the raw file of the same name, be it there already, in the batch or yet to come.

    Paths that are registered are passed over before their content is looked at.  Files that have a picture's name but no
    picture's content are noted and not registered.
    """
    name = F.regexp_extract("path", "([^/]+)$", 1)
    suffix = F.lower(F.regexp_extract("path", r"(\.[^./]*)$", 1))
    named = batch.where(~F.startswith(name, F.lit("._"))).withColumn("_suffix", suffix)
    raw = named.where(F.col("_suffix").isin(list(RAW))).groupBy(_stem("path").alias("stem")).agg(F.min("path").alias("raw_filepath"))
    registry.raws.insert(raw)
    raws = registry.raws.read().select("stem", "raw_filepath")
    pictures = named.where(F.col("_suffix").isin([e for e in extensions if e not in RAW])).withColumnRenamed("path", "filepath")
    new = pictures.join(registry.photos.read().select("filepath"), "filepath", "left_anti")
    good = files.is_image("content")
    registry.rejects.insert(new.where(~good).select("filepath", F.lit("content is no picture").alias("reason")))
    rows = new.where(good).select("filepath", F.regexp_extract("filepath", "([^/]+)$", 1).alias("filename"), F.regexp_extract("filepath", "^(.*)/[^/]+$", 1).alias("folder"), files.content_hash("content").alias("file_hash"), F.col("length").alias("size"), F.col("modificationTime").alias("modified"), _stem("filepath").alias("stem"))
    registry.photos.insert(rows.join(raws, "stem", "left").drop("stem"))
    # raw files that came after their pictures
    late = registry.photos.read().where("raw_filepath is null").withColumn("stem", _stem("filepath")).drop("raw_filepath", "changed").join(raw, "stem").drop("stem")
    registry.photos.upsert(late)


def register_stream(stream: DataFrame, registry: Registry, checkpoint: str, **trigger) -> StreamingQuery:
    """Registers what arrives; `trigger` as `availableNow=True` or `processingTime="1 minute"`."""
    return stream.writeStream.foreachBatch(lambda batch, _: register(batch, registry)).option("checkpointLocation", checkpoint).trigger(**trigger).start()
