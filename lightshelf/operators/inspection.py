"""Every group's inner structure in one plan: sub-clusters, distance to its core, equal encodings."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lightshelf.functions import vectors as V
from lightshelf.operators.lineage import written
from lightshelf.operators.scans import row_numbers
from lightshelf.operators.similar import density_clusters, nearest_rows

#: Rows of a group, and references of it, that are held against each other in one task.
TASK_ROWS, BLOCK_REFS = 1 << 14, 1 << 14


def core_references(faces: DataFrame, clusters: DataFrame, by: str, id_col: str, vector: str, trusted: str, least_trusted: int, most: int, part_rows: int | None = None) -> DataFrame:
    """References of each group (by, ref): its trusted rows if there are enough, else its largest sub-cluster, else all; `most` evenly spaced ones by id."""
    own = faces.select(by, F.col(id_col).alias("id"), F.col(vector).alias("v"), F.coalesce(F.col(trusted), F.lit(False)).alias("t")).join(clusters, "id", "left")
    own = written(own)
    sizes = own.where("cluster is not null").groupBy(by, "cluster").agg(F.count("*").alias("n"), F.min("id").alias("first"))
    largest = sizes.groupBy(by).agg(F.max_by("cluster", F.struct("n", -F.col("first"))).alias("core"))
    enough = own.groupBy(by).agg((F.count(F.when(F.col("t"), 1)) >= least_trusted).alias("enough"))
    rule = enough.join(largest, by, "left")  # a row for each group
    kept = own.join(rule, by).where(F.when(F.col("enough"), F.col("t")).when(F.col("core").isNotNull(), F.coalesce(F.col("cluster") == F.col("core"), F.lit(False))).otherwise(True))
    numbered = row_numbers(kept.select(by, "id", "v"), [by], ["id"], "rn", rows=part_rows)
    n = kept.groupBy(by).agg(F.count("*").alias("n"))
    # places floor(i (n - 1) / (most - 1)), as even steps give them
    step = F.explode(F.sequence(F.lit(0), F.lit(most - 1)))
    places = n.where(F.col("n") > most).select(by, "n", step.alias("i")).select(by, F.when(F.col("i") == most - 1, F.col("n")).otherwise(F.floor(F.col("i") * ((F.col("n") - 1) / F.lit(float(most - 1)))) + 1).alias("rn")).distinct()
    few = numbered.join(n.where(F.col("n") <= most).select(by), by, "left_semi")
    return few.unionByName(numbered.join(places, [by, "rn"], "left_semi")).select(by, F.col("v").alias("ref"))


def _own_least(rows: DataFrame, references: DataFrame, by: str, id_col: str, vector: str) -> DataFrame:
    """The group (by), id and the least distance to a reference of the group; rows in parts of some `TASK_ROWS` meet references in blocks of some `BLOCK_REFS`."""
    held = written(rows.select(by, F.col(id_col).alias("id"), F.col(vector).alias("v")).where("v is not null"))
    own = written(references.select(by, "ref").where("ref is not null"))
    parts = held.groupBy(by).agg(F.ceil(F.count("*") / TASK_ROWS).cast("int").alias("parts"))
    sizes = written(parts.join(own.groupBy(by).agg(F.ceil(F.count("*") / BLOCK_REFS).cast("int").alias("blocks")), by))
    large = sizes.where("parts > 1 or blocks > 1")
    several = not sizes.where("blocks > 1").isEmpty()
    large = F.broadcast(large) if large.count() <= 100_000 else large
    upto = lambda c: F.explode(F.sequence(F.lit(0), F.coalesce(c, F.lit(1)) - 1))
    at = lambda c, n: F.pmod(F.xxhash64(c), F.coalesce(n, F.lit(1))).cast("int")
    dealt = held.join(large, by, "left").select(by, "id", "v", at("id", "parts").alias("part"), upto("blocks").alias("block"))
    sent = own.join(large, by, "left").select(by, "ref", at("ref", "blocks").alias("block"), upto("parts").alias("part"))

    def least(own: pd.DataFrame, refs: pd.DataFrame) -> pd.DataFrame:
        if not len(own) or not len(refs):
            return pd.DataFrame({by: [], "id": [], "distance": []})
        _, out = nearest_rows(np.stack(own.v.to_numpy()).astype(float), np.stack(refs.ref.to_numpy()).astype(float))
        return pd.DataFrame({by: own[by], "id": own.id, "distance": out})

    kinds = dict(held.dtypes)
    met = dealt.groupBy(by, "part", "block").cogroup(sent.groupBy(by, "part", "block")).applyInPandas(least, f"`{by}` {kinds[by]}, id {kinds['id']}, distance double")
    return met.groupBy(by, "id").agg(F.min("distance").alias("distance")) if several else met


def nearest_own_reference(rows: DataFrame, references: DataFrame, by: str, id_col: str, vector: str) -> DataFrame:
    """id and the least distance to a reference of the row's group."""
    return _own_least(rows, references, by, id_col, vector).select("id", "distance")


def own_distances(rows: DataFrame, references: DataFrame, by: str, id_col: str, vector: str) -> DataFrame:
    """The group (by), id and the least distance to a reference of the group, NULL where rows and references of a group have no vectors."""
    known = references.where(F.col(by).isNotNull()).groupBy(by).agg(F.count("ref").alias("_n"))
    own = rows.where(F.col(by).isNotNull()).select(by, F.col(id_col).alias("id"), F.col(vector).alias("v")).join(known, by)
    without = own.where("v is null or _n = 0").select(by, "id", F.lit(None).cast("double").alias("distance"))
    return _own_least(own.where("_n > 0"), references, by, "id", "v").unionByName(without)


def inspected(faces: DataFrame, by: str, radius: float = 0.5, min_samples: int = 3, id_col: str = "id", vector: str = "embedding", trusted: str = "trusted", least_trusted: int = 3, most_references: int = 500, part_rows: int | None = None) -> DataFrame:
    """One row per face of every group: `sub_id` (the smallest core of its sub-cluster, NULL for outliers), `distance` to the core, and `copy_of`, the first face of equal encoding (NULL if there is no other).

    Vectors are scaled to unit length first, zero ones stay as they are.  Rows without a group or a vector are left out.
    """
    unit = written(faces.where(F.col(vector).isNotNull() & F.col(by).isNotNull()).select(by, F.col(id_col).alias("id"), F.col(vector).alias("raw"), V.normalised(vector).alias("v"), F.col(trusted).alias("trusted")))
    clusters = written(density_clusters(unit, radius, min_samples, "v", "id", by).select("id", "cluster"))
    references = written(core_references(unit, clusters, by, "id", "v", "trusted", least_trusted, most_references, part_rows))
    distance = nearest_own_reference(unit, references, by, "id", "v")
    same = unit.select(by, "id", F.xxhash64("raw").alias("h"), "raw")
    first = same.groupBy(by, "h", "raw").agg(F.min("id").alias("first"), F.count("*").alias("n")).where("n > 1")
    copies = same.join(first.select(by, "h", F.col("raw").alias("_raw"), "first"), [by, "h"]).where("raw = _raw").select("id", F.col("first").alias("copy_of"))
    found = unit.select(by, "id").join(clusters, "id").join(distance, "id", "left").join(copies, "id", "left")
    return found.select(by, F.col("id").alias(id_col), F.col("cluster").alias("sub_id"), "distance", "copy_of")


def sub_clusters(found: DataFrame, areas: DataFrame, by: str, id_col: str = "id") -> DataFrame:
    """Summary of each sub-cluster, and of each group's outliers (`sub_id` NULL): size, the largest face, median and largest distance to the core."""
    rows = found.join(areas.select(F.col(id_col), F.col("area")), id_col, "left")
    largest = F.max_by(id_col, F.struct(F.coalesce("area", F.lit(0.0)), -F.col(id_col)))
    return rows.groupBy(by, "sub_id").agg(F.count("*").alias("size"), largest.alias("largest_id"), F.expr("percentile(distance, 0.5)").alias("median_distance"), F.max("distance").alias("most_distance"))


def reference_dedupe(faces: DataFrame, references: DataFrame, min_gap: float, trusted: tuple[str, ...] = ("strict", "manual"), vector: str = "embedding") -> DataFrame:
    """For faces (face_id, photo_id, person_id, match_source and a vector) of photos that have a person twice or more: the rule, the gap and whether the face stays.

    One trusted face stays and the others go (`source`).  Of faces none of which is trusted the nearest to the person's references (person_id, ref)
    stays if the next one is more than `min_gap` further (`distance`), and all stay otherwise (`ambiguous`); with two trusted ones or more all stay (`review`).
    """
    group = ["photo_id", "person_id"]
    twice = faces.where("person_id is not null").groupBy(*group).agg(F.count("*").alias("n"), F.count(F.when(F.col("match_source").isin(*trusted), 1)).alias("trusted")).where("n > 1")
    held = faces.join(twice, group).withColumn("v", V.normalised(vector))
    near = nearest_own_reference(held.select("person_id", "face_id", "v"), references.select("person_id", V.normalised("ref").alias("ref")), "person_id", "face_id", "v")
    rows = written(held.join(near.withColumnRenamed("id", "face_id"), "face_id").select("face_id", *group, "trusted", F.col("match_source").isin(*trusted).alias("sure"), "distance"))
    # the two nearest of each group, with a plain aggregate: a photo's faces of one person are few
    best = rows.groupBy(*group).agg(F.array_sort(F.collect_list(F.struct("distance", "face_id"))).alias("d")).select(*group, F.col("d")[0]["face_id"].alias("first"), (F.col("d")[1]["distance"] - F.col("d")[0]["distance"]).alias("between"))
    rule = F.when(F.col("trusted") == 1, "source").when(F.col("trusted") > 1, "review").when(F.col("between") > min_gap, "distance").otherwise("ambiguous")
    stays = F.when(F.col("rule") == "source", F.coalesce("sure", F.lit(False))).when(F.col("rule") == "distance", F.col("face_id") == F.col("first")).otherwise(True)
    out = rows.join(best, group).withColumn("rule", rule).withColumn("keep", stays)
    return out.select("face_id", *group, "rule", F.when(F.col("rule") == "distance", F.col("between")).alias("gap"), "keep")
