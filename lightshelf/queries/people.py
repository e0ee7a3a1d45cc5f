"""Persons, faces and the joins between them and their photos."""

from __future__ import annotations

from pyspark.sql import functions as F

from lightshelf.functions import scalar as S
from lightshelf.operators import filters, people, ranking, upkeep
from lightshelf.queries import Registry
from lightshelf.sources.library import library, table, with_library

REGISTRY = Registry()
add = REGISTRY.add
FP = with_library("faces", "face_photos", "persons")


def faces(spark, sf):
    return library(spark, sf, "faces")


def face_photos(spark, sf):
    return library(spark, sf, "face_photos")


def persons(spark, sf):
    return library(spark, sf, "persons")


_ALL = "SELECT photo_id FROM faces WHERE person_id IN ({ids}) GROUP BY photo_id HAVING count(DISTINCT person_id) = {n}"


@add("f12_person", FP + "SELECT photo_id, day FROM face_photos WHERE photo_id IN (SELECT photo_id FROM faces WHERE person_id = 7 AND match_source = 'strict')")
def f12(spark, sf):
    return filters.with_person(face_photos(spark, sf), faces(spark, sf), 7, "strict").select("photo_id", "day")


@add("f13_all_persons", FP + f"SELECT photo_id, day FROM face_photos WHERE photo_id IN ({_ALL.format(ids='1, 2', n=2)})")
def f13(spark, sf):
    return filters.with_all_persons(face_photos(spark, sf), faces(spark, sf), [1, 2]).select("photo_id", "day")


@add("f14_only_these", FP + "SELECT photo_id, day FROM face_photos WHERE photo_id IN (SELECT photo_id FROM faces GROUP BY photo_id HAVING count(*) = 1 AND count(CASE WHEN person_id = 7 THEN 1 END) = 1)")
def f14(spark, sf):
    return filters.only_persons(face_photos(spark, sf), faces(spark, sf), [7]).select("photo_id", "day")


@add("f15_faces_in_frame", FP + "SELECT photo_id FROM face_photos p WHERE NOT EXISTS (SELECT 1 FROM faces f WHERE f.photo_id = p.photo_id AND f.person_id IN (1, 2, 3) AND (bbox_left < 10 OR bbox_top < 14 OR bbox_right > 990 OR bbox_bottom > 1386))")
def f15(spark, sf):
    return filters.faces_in_frame(face_photos(spark, sf), faces(spark, sf), [1, 2, 3]).select("photo_id")


@add("f16_persons_and_frame", FP + f"SELECT photo_id FROM face_photos p WHERE photo_id IN ({_ALL.format(ids='1, 2', n=2)}) AND NOT EXISTS (SELECT 1 FROM faces f WHERE f.photo_id = p.photo_id AND f.person_id IN (1, 2) AND (bbox_left < 10 OR bbox_top < 14 OR bbox_right > 990 OR bbox_bottom > 1386))")
def f16(spark, sf):
    f = faces(spark, sf)
    return filters.faces_in_frame(filters.with_all_persons(face_photos(spark, sf), f, [1, 2]), f, [1, 2]).select("photo_id")


@add("f23_usable_faces", FP + "SELECT face_id FROM faces WHERE (det_score IS NULL OR det_score >= 0.65) AND least(bbox_bottom - bbox_top, bbox_right - bbox_left) >= 60")
def f23(spark, sf):
    return faces(spark, sf).where(filters.usable_face()).select("face_id")


@add("f25_face_content_filter", FP + "SELECT face_id FROM faces f WHERE EXISTS (SELECT 1 FROM face_photos p WHERE p.photo_id = f.photo_id AND p.camera_model = '1-URGENT' AND p.status = 'F')")
def f25(spark, sf):
    return faces(spark, sf).join(face_photos(spark, sf).where("camera_model = '1-URGENT' and status = 'F'").select("photo_id"), "photo_id", "left_semi").select("face_id")


@add("j01_photo_face_person", FP + "SELECT p.photo_id, f.face_id, n.name FROM face_photos p JOIN faces f USING (photo_id) JOIN persons n USING (person_id) WHERE f.match_source = 'manual' AND p.day >= '2001-01-01'")
def j01(spark, sf):
    named = faces(spark, sf).where("match_source = 'manual'").join(persons(spark, sf), "person_id")
    return face_photos(spark, sf).where("day >= '2001-01-01'").join(named, "photo_id").select("photo_id", "face_id", "name")


@add("j02_persons_without_faces", FP + "SELECT n.person_id, n.name, count(DISTINCT f.photo_id) AS n_photos FROM persons n LEFT JOIN faces f ON f.person_id = n.person_id AND f.match_source = 'manual' AND f.det_score > 0.97 GROUP BY 1, 2")
def j02(spark, sf):
    return people.photo_counts(persons(spark, sf), faces(spark, sf).where("match_source = 'manual' and det_score > 0.97")).select("person_id", "name", "n_photos")


@add("j03_collections", "SELECT c_custkey AS collection_id, c_name AS name, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1, 2")
def j03(spark, sf):
    members = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("collection_id")).agg(F.count("*").alias("n"))
    return table(spark, sf, "customer").select(F.col("c_custkey").alias("collection_id"), F.col("c_name").alias("name")).join(members, "collection_id", "left").withColumn("n", F.coalesce("n", F.lit(0)))


@add("j04_semi_having", FP + f"SELECT photo_id, score FROM face_photos WHERE photo_id IN ({_ALL.format(ids='1, 2, 3', n=2)})")
def j04(spark, sf):
    some = faces(spark, sf).where(F.col("person_id").isin(1, 2, 3)).groupBy("photo_id").agg(F.countDistinct("person_id").alias("n")).where("n = 2")
    return face_photos(spark, sf).join(some, "photo_id", "left_semi").select("photo_id", "score")


@add("j05_anti_unprocessed", FP + "SELECT photo_id FROM face_photos p WHERE NOT EXISTS (SELECT 1 FROM faces f WHERE f.photo_id = p.photo_id)")
def j05(spark, sf):
    return face_photos(spark, sf).join(faces(spark, sf).select("photo_id"), "photo_id", "left_anti").select("photo_id")


@add("j06_representative_face", FP + "SELECT person_id, face_id FROM (SELECT person_id, face_id, row_number() OVER (PARTITION BY person_id ORDER BY area DESC, face_id) AS rn FROM faces WHERE person_id IS NOT NULL) WHERE rn = 1")
def j06(spark, sf):
    return ranking.latest_per_key(faces(spark, sf).where("person_id is not null").select("person_id", "face_id", "area"), ["person_id"], [F.desc("area"), F.col("face_id")]).select("person_id", "face_id")


@add("j07_face_counts", FP + "SELECT photo_id, (SELECT count(*) FROM faces f WHERE f.photo_id = p.photo_id) AS n_faces FROM face_photos p")
def j07(spark, sf):
    n = faces(spark, sf).groupBy("photo_id").agg(F.count("*").alias("n_faces"))
    return face_photos(spark, sf).select("photo_id").join(n, "photo_id", "left").withColumn("n_faces", F.coalesce("n_faces", F.lit(0)))


@add("j14_stack_expansion", with_library("photos") + "SELECT id AS photo_id FROM photos WHERE id % 50 = 0 UNION SELECT id FROM photos WHERE stack_id IN (SELECT stack_id FROM photos WHERE id % 50 = 0 AND stack_id IS NOT NULL)")
def j14(spark, sf):
    p = library(spark, sf, "photos")
    members = p.where("stack_id is not null").select("stack_id", F.col("id").alias("photo_id"))
    return upkeep.expanded_to_stacks(p.where("id % 50 = 0").select(F.col("id").alias("photo_id")), members)


@add("j15_place_lookup", "SELECT o_orderkey AS photo_id, n_name AS admin, r_name AS country FROM orders JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey")
def j15(spark, sf):
    nation, region = table(spark, sf, "nation"), table(spark, sf, "region")
    named = nation.join(region, nation.n_regionkey == region.r_regionkey, "left").select("n_nationkey", "n_name", "r_name")
    owners = table(spark, sf, "customer").select("c_custkey", "c_nationkey").join(named, F.col("c_nationkey") == F.col("n_nationkey"), "left")
    return table(spark, sf, "orders").select("o_orderkey", "o_custkey").join(owners, F.col("o_custkey") == F.col("c_custkey")).select(F.col("o_orderkey").alias("photo_id"), F.col("n_name").alias("admin"), F.col("r_name").alias("country"))


@add("j16_update_from", FP + "SELECT f.face_id, coalesce(s.person_id, f.person_id) AS person_id FROM faces f LEFT JOIN (SELECT face_id, person_id + 1 AS person_id FROM faces WHERE match_source = 'manual' AND person_id IS NOT NULL) s USING (face_id)")
def j16(spark, sf):
    f = faces(spark, sf)
    state = f.where("match_source = 'manual' and person_id is not null").select("face_id", (F.col("person_id") + 1).alias("_p"))
    return f.select("face_id", "person_id").join(state, "face_id", "left").select("face_id", F.coalesce("_p", "person_id").alias("person_id"))


@add("j18_name_join", FP + "SELECT n.person_id, c.c_custkey FROM persons n JOIN customer c ON lower(replace(n.name, 'Supplier', 'CUSTOMER')) = lower(c.c_name)")
def j18(spark, sf):
    a = persons(spark, sf).select("person_id", F.lower(F.replace("name", F.lit("Supplier"), F.lit("CUSTOMER"))).alias("k"))
    b = table(spark, sf, "customer").select("c_custkey", F.lower("c_name").alias("k"))
    return a.join(b, "k").select("person_id", "c_custkey")


@add("a02_facet_person", FP + "SELECT n.name AS bucket, count(DISTINCT f.photo_id) AS n FROM faces f JOIN persons n USING (person_id) GROUP BY 1")
def a02(spark, sf):
    counts = faces(spark, sf).where("person_id is not null").groupBy("person_id").agg(F.countDistinct("photo_id").alias("n"))
    return counts.join(persons(spark, sf), "person_id").select(F.col("name").alias("bucket"), "n")


@add("a04_people_list", FP + "SELECT n.name, count(DISTINCT f.photo_id) AS n_photos FROM persons n LEFT JOIN faces f USING (person_id) WHERE contains(lower(n.name), '0001') GROUP BY n.person_id, n.name ORDER BY n_photos DESC, n.name LIMIT 20")
def a04(spark, sf):
    return people.photo_counts(persons(spark, sf).where(filters.contains("name", "0001")), faces(spark, sf)).orderBy(F.desc("n_photos"), "name").limit(20).select("name", "n_photos")


_KEY = "CASE WHEN person_id IS NOT NULL THEN concat('p:', person_id) WHEN cluster_id IS NOT NULL THEN concat('c:', cluster_id) END"


@add("a16_face_groups", FP + f"SELECT g.group_key, n_faces, n_photos, top_face, group_key IN (SELECT concat('c:', l_partkey % 50) FROM lineitem WHERE l_partkey % 200 = 4) AS ignored FROM (SELECT {_KEY} AS group_key, count(*) AS n_faces, count(DISTINCT photo_id) AS n_photos, arg_max(face_id, (area, -face_id)) AS top_face FROM faces GROUP BY 1 HAVING count(*) >= 5) g WHERE group_key IS NOT NULL")
def a16(spark, sf):
    ignored = table(spark, sf, "lineitem").where("l_partkey % 200 = 4").select((F.col("l_partkey") % 50).alias("cluster_id"))
    return people.face_groups(faces(spark, sf), 5, ignored)


@add("a17_group_detail", FP + "SELECT 'p:7' AS group_key, count(*) AS n_faces, count(DISTINCT photo_id) AS n_photos, arg_max(face_id, (area, -face_id)) AS top_face FROM faces WHERE person_id = 7")
def a17(spark, sf):
    return people.face_groups(faces(spark, sf).where("person_id = 7"))


@add("a18_cluster_summary", FP + "SELECT cluster_id, count(*) AS n_faces, count(DISTINCT photo_id) AS n_photos, count(DISTINCT match_source) AS n_sources FROM faces WHERE cluster_id IS NOT NULL GROUP BY 1")
def a18(spark, sf):
    return people.cluster_summary(faces(spark, sf))


@add("a19_person_coverage", FP + "SELECT person_id, count(DISTINCT photo_id) AS n_photos, " + ", ".join(f"count(DISTINCT CASE WHEN match_source = '{s}' THEN photo_id END) AS n_{s}" for s in people.SOURCES) + " FROM faces WHERE person_id IS NOT NULL GROUP BY 1")
def a19(spark, sf):
    return people.coverage(faces(spark, sf))


@add("a20_group_date_ranges", FP + f"SELECT group_key, count(*) AS n_faces, min(day) AS first_day, max(day) AS last_day FROM (SELECT {_KEY} AS group_key, photo_id FROM faces) f LEFT JOIN face_photos USING (photo_id) WHERE group_key IS NOT NULL GROUP BY 1")
def a20(spark, sf):
    return people.date_ranges(faces(spark, sf), face_photos(spark, sf))


@add("a25_division_counts", FP + "SELECT photo_id, count(DISTINCT person_id) AS n FROM faces WHERE person_id IN (1, 2, 3, 4) GROUP BY 1 HAVING count(DISTINCT person_id) >= 2")
def a25(spark, sf):
    return faces(spark, sf).where(F.col("person_id").isin(1, 2, 3, 4)).groupBy("photo_id").agg(F.countDistinct("person_id").alias("n")).where("n >= 2")


@add("w02_largest_faces", FP + f"SELECT group_key, face_id, rn FROM (SELECT {_KEY} AS group_key, face_id, CAST(row_number() OVER (PARTITION BY {_KEY} ORDER BY area DESC, face_id) AS INT) AS rn FROM faces WHERE {_KEY} IS NOT NULL) WHERE rn <= 60")
def w02(spark, sf):
    return people.sample_faces(faces(spark, sf), 60).select("group_key", "face_id", "rn")


@add("w03_sample_faces", FP + f"SELECT group_key, face_id FROM (SELECT {_KEY} AS group_key, face_id, row_number() OVER (PARTITION BY {_KEY} ORDER BY area DESC, face_id) AS rn FROM faces WHERE {_KEY} IS NOT NULL) WHERE rn <= 4")
def w03(spark, sf):
    return people.sample_faces(faces(spark, sf), 4).select("group_key", "face_id")


@add("w09_duplicate_person_faces", FP + "SELECT face_id FROM (SELECT face_id, row_number() OVER (PARTITION BY photo_id, person_id ORDER BY CASE match_source WHEN 'manual' THEN 0 WHEN 'strict' THEN 1 ELSE 2 END, det_score DESC NULLS LAST, area DESC, face_id) AS rn FROM faces WHERE person_id IS NOT NULL) WHERE rn > 1")
def w09(spark, sf):
    return people.duplicate_person_faces(faces(spark, sf)).select("face_id")


_AREA = "CAST((bbox_right - bbox_left) * (bbox_bottom - bbox_top) AS DOUBLE) / (1000 * 1400)"


@add("h13_prominence", FP + f"SELECT photo_id, round(max({_AREA}), 9) AS prominence FROM faces JOIN face_photos USING (photo_id) GROUP BY 1")
def h13(spark, sf):
    return people.prominence(faces(spark, sf), face_photos(spark, sf)).select("photo_id", F.round("prominence", 9).alias("prominence"))


@add("o06_subject_ranking", FP + f"SELECT photo_id, score FROM face_photos JOIN (SELECT photo_id, max({_AREA}) AS m FROM faces GROUP BY 1) USING (photo_id) ORDER BY CASE WHEN m BETWEEN 0.04 AND 0.22 THEN 0 ELSE 1 END, score DESC NULLS LAST, m DESC, photo_id LIMIT 100")
def o06(spark, sf):
    rows, order = people.by_prominence(face_photos(spark, sf), faces(spark, sf))
    return rows.orderBy(*order).limit(100).select("photo_id", "score")


@add("o11_cover_pick", FP + "SELECT p.photo_id FROM face_photos p LEFT JOIN (SELECT photo_id, count(*) AS n FROM faces GROUP BY 1) f USING (photo_id) WHERE coalesce(n, 0) <= 1 AND 1.4 * p.width <= p.height ORDER BY score DESC NULLS LAST, photo_id LIMIT 1")
def o11(spark, sf):
    n = faces(spark, sf).groupBy("photo_id").agg(F.count("*").alias("n"))
    rows = face_photos(spark, sf).join(n, "photo_id", "left").where("coalesce(n, 0) <= 1 and 1.4D * width <= height")
    return rows.orderBy(F.col("score").desc_nulls_last(), "photo_id").limit(1).select("photo_id")


_IOU = "greatest(0, least(x.bbox_right, y.bbox_right) - greatest(x.bbox_left, y.bbox_left)) * greatest(0, least(x.bbox_bottom, y.bbox_bottom) - greatest(x.bbox_top, y.bbox_top))"
_UNION = f"((x.bbox_right - x.bbox_left) * (x.bbox_bottom - x.bbox_top) + (y.bbox_right - y.bbox_left) * (y.bbox_bottom - y.bbox_top) - {_IOU})"


@add("g04_overlapping_boxes", FP + f"SELECT x.face_id AS a, y.face_id AS b, round({_IOU} / CAST({_UNION} AS DOUBLE), 6) AS iou FROM faces x JOIN faces y ON x.photo_id = y.photo_id AND x.face_id < y.face_id WHERE {_IOU} / CAST({_UNION} AS DOUBLE) >= 0.1")
def g04(spark, sf):
    return people.overlapping_boxes(faces(spark, sf), 0.1).select("a", "b", F.round("iou", 6).alias("iou"))


@add("n02_import_assignments", FP + f"SELECT assignment_id, face_id FROM (SELECT x.face_id AS assignment_id, y.face_id, row_number() OVER (PARTITION BY x.face_id ORDER BY {_IOU} / CAST({_UNION} AS DOUBLE) DESC, y.face_id) AS rn FROM (SELECT face_id, photo_id, bbox_top, bbox_left + 9 AS bbox_left, bbox_bottom, bbox_right + 9 AS bbox_right FROM faces WHERE match_source = 'manual') x JOIN faces y ON x.photo_id = y.photo_id WHERE {_IOU} / CAST({_UNION} AS DOUBLE) > 0.5) WHERE rn = 1")
def n02(spark, sf):
    f = faces(spark, sf)
    moved = f.where("match_source = 'manual'").select(F.col("face_id").alias("assignment_id"), "photo_id", "bbox_top", (F.col("bbox_left") + 9).alias("bbox_left"), "bbox_bottom", (F.col("bbox_right") + 9).alias("bbox_right"))
    return people.best_overlaps(moved, f).select("assignment_id", "face_id")


@add("n03_manual_assignments", FP + "SELECT p.photo_id, f.face_id, n.name FROM face_photos p JOIN faces f USING (photo_id) JOIN persons n USING (person_id) WHERE match_source = 'manual' ORDER BY p.photo_id, f.face_id")
def n03(spark, sf):
    own = faces(spark, sf).where("match_source = 'manual'").join(persons(spark, sf), "person_id")
    return face_photos(spark, sf).select("photo_id").join(own, "photo_id").select("photo_id", "face_id", "name").orderBy("photo_id", "face_id")


@add("n06_clear_matches", FP + "SELECT face_id, CASE WHEN NOT (coalesce(person_id = 7, FALSE) AND (match_source IS NULL OR match_source <> 'manual')) THEN person_id END AS person_id FROM faces")
def n06(spark, sf):
    return people.cleared(faces(spark, sf), 7).select("face_id", "person_id")


@add("n07_restore_matches", FP + "SELECT face_id, CASE WHEN person_id = 7 AND match_source <> 'manual' THEN NULL ELSE person_id END AS person_id, CASE WHEN person_id = 7 AND match_source <> 'manual' THEN NULL ELSE match_source END AS match_source FROM faces")
def n07(spark, sf):
    f = faces(spark, sf)
    snapshot = f.where("match_source = 'manual'")  # taken before, of the manual matches
    return people.restored(people.cleared(f, 7, keep_manual=False), snapshot).select("face_id", "person_id", "match_source")


@add("n08_manual_tag", FP + "SELECT face_id, person_id FROM faces WHERE face_id NOT IN (SELECT face_id FROM faces WHERE cluster_id = 4) UNION ALL SELECT face_id, 99 FROM faces WHERE cluster_id = 4")
def n08(spark, sf):
    f = faces(spark, sf).select("face_id", "person_id", "cluster_id")
    new = f.where("cluster_id = 4").select("face_id", F.lit(99).cast("bigint").alias("person_id"))
    return upkeep.upserted(f.select("face_id", "person_id"), new, ["face_id"])


@add("n19_merge_groups", FP + "SELECT face_id, CASE WHEN cluster_id IN (4, 8) THEN cluster_id * 10 ELSE person_id END AS person_id, CASE WHEN cluster_id IN (4, 8) THEN NULL WHEN cluster_id = 12 THEN 16 ELSE cluster_id END AS cluster_id FROM faces")
def n19(spark, sf):
    merges = spark.sql("SELECT * FROM VALUES (4L, 40L, NULL), (8L, 80L, NULL), (12L, NULL, 16L) AS m(cluster_id, to_person, to_cluster)").withColumn("to_cluster", F.col("to_cluster").cast("bigint"))
    return people.merged_groups(faces(spark, sf), merges).select("face_id", "person_id", "cluster_id")


@add("n20_bulk_assign", FP + "SELECT face_id, CASE WHEN cluster_id IN (SELECT cluster_id FROM faces WHERE cluster_id IS NOT NULL GROUP BY 1 HAVING count(*) >= 300) THEN 500 ELSE person_id END AS person_id FROM faces")
def n20(spark, sf):
    f = faces(spark, sf)
    chosen = f.where("cluster_id is not null").groupBy("cluster_id").agg(F.count("*").alias("n")).where("n >= 300").select("cluster_id", F.lit(True).alias("_c"))
    return f.join(chosen, "cluster_id", "left").select("face_id", F.when(F.col("_c"), 500).otherwise(F.col("person_id")).alias("person_id"))


@add("n23_photo_detail", FP + "SELECT p.photo_id, p.day, coalesce(string_agg(CASE WHEN f.face_id IS NOT NULL THEN concat(f.face_id, '=', coalesce(n.name, '?')) END, ';' ORDER BY f.face_id), '') AS faces FROM face_photos p LEFT JOIN faces f USING (photo_id) LEFT JOIN persons n USING (person_id) GROUP BY 1, 2")
def n23(spark, sf):
    own = faces(spark, sf).join(persons(spark, sf), "person_id", "left")
    one = own.groupBy("photo_id").agg(F.array_sort(F.collect_list(F.struct("face_id", F.coalesce("name", F.lit("?")).alias("name")))).alias("f"))
    doc = F.concat_ws(";", F.transform("f", lambda x: F.concat(x["face_id"].cast("string"), F.lit("="), x["name"])))
    return face_photos(spark, sf).join(one, "photo_id", "left").select("photo_id", "day", F.coalesce(doc, F.lit("")).alias("faces"))


@add("n33_person_references", FP + "SELECT n.person_id, n.name, count(f.face_id) AS n_refs FROM persons n LEFT JOIN faces f ON f.person_id = n.person_id AND f.match_source = 'manual' GROUP BY 1, 2")
def n33(spark, sf):
    refs = faces(spark, sf).where("match_source = 'manual' and person_id is not null").groupBy("person_id").agg(F.count("*").alias("n_refs"))
    return persons(spark, sf).select("person_id", "name").join(refs, "person_id", "left").withColumn("n_refs", F.coalesce("n_refs", F.lit(0)))


@add("s16_face_state", FP + "SELECT p.photo_id, f.face_id, f.person_id, f.cluster_id FROM faces f JOIN face_photos p USING (photo_id) WHERE f.person_id IS NOT NULL OR f.cluster_id IS NOT NULL")
def s16(spark, sf):
    return faces(spark, sf).where("person_id is not null or cluster_id is not null").join(face_photos(spark, sf).select("photo_id"), "photo_id").select("photo_id", "face_id", "person_id", "cluster_id")


@add("s17_assignment_export", FP + "SELECT concat('/lib/', day, '/', photo_id, '.jpg') AS filepath, face_id, n.name FROM faces f JOIN face_photos USING (photo_id) JOIN persons n USING (person_id) WHERE match_source <> 'temporal'")
def s17(spark, sf):
    own = faces(spark, sf).where("match_source <> 'temporal'").join(persons(spark, sf).select("person_id", "name"), "person_id")
    return own.join(face_photos(spark, sf).select("photo_id", "day"), "photo_id").select(F.concat(F.lit("/lib/"), "day", F.lit("/"), F.col("photo_id").cast("string"), F.lit(".jpg")).alias("filepath"), "face_id", "name")


@add("h25_crop_centre", FP + "SELECT photo_id, round((min(bbox_left) + max(bbox_right)) / CAST(2000 AS DOUBLE), 6) AS x, round((min(bbox_top) + max(bbox_bottom)) / CAST(2800 AS DOUBLE), 6) AS y FROM faces GROUP BY 1")
def h25(spark, sf):
    middle = lambda a, b, n: F.round(S.clamped((F.min(a) + F.max(b)) / F.lit(2.0 * n), 0.0, 10.0), 6)
    return faces(spark, sf).groupBy("photo_id").agg(middle("bbox_left", "bbox_right", 1000).alias("x"), middle("bbox_top", "bbox_bottom", 1400).alias("y"))
