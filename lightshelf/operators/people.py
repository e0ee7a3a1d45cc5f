"""Persons and faces: groups, coverage, duplicates, matching, assignments."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lightshelf.functions import scalar as S
from lightshelf.operators.ranking import latest_per_key, top_per_group
from lightshelf.operators.similar import reference_distances
from lightshelf.operators.timeline import near_in_time

#: Order of trust of a match, best first.
SOURCES = ("manual", "strict", "temporal")


def photo_counts(persons: DataFrame, faces: DataFrame, key: str = "person_id") -> DataFrame:
    """Every person with the number of distinct photos, 0 included; faces are counted before the join."""
    counts = faces.where(F.col(key).isNotNull()).groupBy(key).agg(F.countDistinct("photo_id").alias("n_photos"))
    return persons.join(counts, key, "left").withColumn("n_photos", F.coalesce("n_photos", F.lit(0)))


def group_key(person: str = "person_id", cluster: str = "cluster_id"):
    """'p:<id>' of a named face, 'c:<id>' of a clustered one, NULL of others."""
    return F.when(F.col(person).isNotNull(), F.concat(F.lit("p:"), F.col(person).cast("string"))).when(F.col(cluster).isNotNull(), F.concat(F.lit("c:"), F.col(cluster).cast("string")))


def face_groups(faces: DataFrame, least: int = 1, ignored: DataFrame | None = None) -> DataFrame:
    """Persons and clusters: faces, photos, the largest face, and whether the cluster is ignored."""
    keyed = faces.withColumn("group_key", group_key()).where("group_key is not null")
    out = keyed.groupBy("group_key").agg(F.count("*").alias("n_faces"), F.countDistinct("photo_id").alias("n_photos"), F.max_by("face_id", F.struct("area", F.bitwise_not("face_id").alias("i"))).alias("top_face")).where(F.col("n_faces") >= least)
    if ignored is None:
        return out
    marks = ignored.select(F.concat(F.lit("c:"), F.col("cluster_id").cast("string")).alias("group_key"), F.lit(True).alias("ignored")).distinct()
    return out.join(marks, "group_key", "left").withColumn("ignored", F.coalesce("ignored", F.lit(False)))


def sample_faces(faces: DataFrame, n: int = 4) -> DataFrame:
    """The n largest faces of each group."""
    return top_per_group(faces.withColumn("group_key", group_key()).where("group_key is not null").select("group_key", "face_id", "area"), ["group_key"], [F.desc("area"), F.col("face_id")], n)


def date_ranges(faces: DataFrame, photos: DataFrame) -> DataFrame:
    """Faces and first and last day of each group."""
    keyed = faces.withColumn("group_key", group_key()).where("group_key is not null").select("group_key", "photo_id")
    return keyed.join(photos.select("photo_id", "day"), "photo_id", "left").groupBy("group_key").agg(F.count("*").alias("n_faces"), F.min("day").alias("first_day"), F.max("day").alias("last_day"))


def duplicate_person_faces(faces: DataFrame) -> DataFrame:
    """Faces to unmatch so that a person has one face in a photo: manual before strict before others, then detection, then size."""
    trust = F.when(F.col("match_source") == "manual", 0).when(F.col("match_source") == "strict", 1).otherwise(2)
    w = Window.partitionBy("photo_id", "person_id").orderBy(trust, F.col("det_score").desc_nulls_last(), F.desc("area"), "face_id")
    return faces.where("person_id is not null").withColumn("rn", F.row_number().over(w)).where("rn > 1")


def coverage(faces: DataFrame) -> DataFrame:
    """For each person the photos by match source."""
    parts = [F.countDistinct(F.when(F.col("match_source") == s, F.col("photo_id"))).alias(f"n_{s}") for s in SOURCES]
    return faces.where("person_id is not null").groupBy("person_id").agg(F.countDistinct("photo_id").alias("n_photos"), *parts)


def cluster_summary(faces: DataFrame) -> DataFrame:
    return faces.where("cluster_id is not null").groupBy("cluster_id").agg(F.count("*").alias("n_faces"), F.countDistinct("photo_id").alias("n_photos"), F.countDistinct("match_source").alias("n_sources"))


def prominence(faces: DataFrame, photos: DataFrame) -> DataFrame:
    """Largest share of each photo that a face takes."""
    shown = faces.join(photos.select("photo_id", "width", "height"), "photo_id")
    area = S.face_area("bbox_top", "bbox_right", "bbox_bottom", "bbox_left")
    return shown.groupBy("photo_id").agg(F.max(S.prominence(area, "width", "height")).alias("prominence"))


def by_prominence(photos: DataFrame, faces: DataFrame, low: float = 0.04, high: float = 0.22):
    """Photos with their prominence and the order: in the band first, then quality, then prominence."""
    rows = photos.join(prominence(faces, photos), "photo_id").withColumn("in_band", F.col("prominence").between(low, high))
    return rows, [F.desc("in_band"), F.col("score").desc_nulls_last(), F.desc("prominence"), F.col("photo_id")]


def best_reference(faces: DataFrame, references: DataFrame, id_col: str = "face_id", vector: str = "encoding") -> DataFrame:
    """Least distance of each face to each person's references, banded."""
    least = reference_distances(faces, references, vector, id_col)
    return least.withColumn("band", F.when(F.col("distance") <= 1.15, "match").when(F.col("distance") <= 1.30, "near").otherwise("far"))


def seen_near(faces: DataFrame, sightings: DataFrame, minutes: float) -> DataFrame:
    """Faces whose candidate person was seen within the minutes before or after."""
    near = near_in_time(faces, sightings, minutes * 60, by=["person_id"])
    return faces.join(near.select("face_id").distinct(), "face_id", "left_semi")


def match_in_time(distances: DataFrame, faces: DataFrame, sightings: DataFrame, most: float = 1.45, margin: float = 0.08, minutes: float = 30.0) -> DataFrame:
    """Identity by the nearest person where it is clear and fits in time.

    `distances` has (face_id, person_id, distance).  A face without a time, or a
    person without sightings, skips the test in time.
    """
    ranked = top_per_group(distances, ["face_id"], [F.col("distance"), F.col("person_id")], 2)
    best = ranked.groupBy("face_id").agg(F.min(F.when(F.col("rn") == 1, F.struct("person_id", "distance"))).alias("b"), F.min(F.when(F.col("rn") == 2, F.col("distance"))).alias("second"))
    clear = best.where((F.col("b.distance") <= most) & (F.col("second").isNull() | (F.col("second") - F.col("b.distance") >= margin))).select("face_id", "b.person_id", "b.distance")
    timed = clear.join(faces.select("face_id", "taken_ts"), "face_id", "left").join(sightings.select("person_id").distinct().withColumn("known", F.lit(True)), "person_id", "left")
    free = timed.where("taken_ts is null or known is null").select("face_id", "person_id", "distance")
    checked = seen_near(timed.where("taken_ts is not null and known"), sightings, minutes).select("face_id", "person_id", "distance")
    return free.unionByName(checked)


def best_overlaps(assignments: DataFrame, faces: DataFrame, least: float = 0.5) -> DataFrame:
    """For each assignment (assignment_id, photo_id, box) the face of its photo with the largest overlap above `least`."""
    pairs = assignments.alias("a").join(faces.alias("f"), F.col("a.photo_id") == F.col("f.photo_id")).select(F.col("a.assignment_id"), F.col("f.face_id"), S.box_iou("a", "f").alias("iou"))
    return latest_per_key(pairs.where(F.col("iou") > least), ["assignment_id"], [F.desc("iou"), F.col("face_id")])


def overlapping_boxes(faces: DataFrame, least: float = 0.4) -> DataFrame:
    """Pairs of boxes of one photo that overlap by at least `least`."""
    x, y = faces.alias("x"), faces.alias("y")
    pairs = x.join(y, (F.col("x.photo_id") == F.col("y.photo_id")) & (F.col("x.face_id") < F.col("y.face_id")))
    return pairs.select(F.col("x.photo_id"), F.col("x.face_id").alias("a"), F.col("y.face_id").alias("b"), S.box_iou("x", "y").alias("iou")).where(F.col("iou") >= least)


def cleared(faces: DataFrame, person_id: int | None = None, keep_manual: bool = True) -> DataFrame:
    """Faces with matches taken away: of a person or of all, manual ones kept if asked."""
    hit = F.lit(True) if person_id is None else F.col("person_id") == person_id
    if keep_manual:
        hit = hit & (F.col("match_source").isNull() | (F.col("match_source") != "manual"))
    hit = F.coalesce(hit, F.lit(False))
    return faces.withColumn("match_source", F.when(~hit, F.col("match_source"))).withColumn("person_id", F.when(~hit, F.col("person_id")))


def merged_groups(faces: DataFrame, merges: DataFrame) -> DataFrame:
    """Faces with clusters merged into persons or other clusters: merges have (cluster_id, to_person, to_cluster)."""
    m = merges.select("cluster_id", "to_person", "to_cluster", F.lit(True).alias("_m"))
    out = faces.join(m, "cluster_id", "left")
    return out.withColumn("person_id", F.coalesce("to_person", "person_id")).withColumn("cluster_id", F.when(F.col("_m") & F.col("to_person").isNotNull(), None).otherwise(F.coalesce("to_cluster", "cluster_id"))).drop("to_person", "to_cluster", "_m")


def restored(faces: DataFrame, snapshot: DataFrame) -> DataFrame:
    """Faces with the person and source that an earlier snapshot (face_id, person_id, match_source) held for them."""
    one = snapshot.groupBy("face_id").agg(F.max(F.struct("person_id", "match_source")).alias("_o"))  # a face that is there twice stays one
    old = one.select("face_id", F.col("_o.person_id").alias("_p"), F.col("_o.match_source").alias("_s"))
    return faces.join(old, "face_id", "left").withColumn("person_id", F.coalesce("person_id", "_p")).withColumn("match_source", F.coalesce("match_source", "_s")).drop("_p", "_s")
