"""Windows, orders, sessions, bursts and imputation over time-ordered photos."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lightshelf.functions import scalar as S
from lightshelf.operators import facets, people, ranking, timeline
from lightshelf.queries import Registry
from lightshelf.sources import files
from lightshelf.sources.library import library, table, with_library
from lightshelf.streaming import activity

REGISTRY = Registry()
add = REGISTRY.add
P = with_library("photos")


def photos(spark, sf):
    return library(spark, sf, "photos")


def best_first():
    return [F.col("score").desc_nulls_last(), F.col("id")]


for _kind, _n in (("month", 7), ("day", 10)):
    add(f"w01_representatives_{_kind}", P + f"SELECT bucket, id, rn FROM (SELECT substr(day, 1, {_n}) AS bucket, id, CAST(row_number() OVER (PARTITION BY substr(day, 1, {_n}) ORDER BY score DESC NULLS LAST, id) AS INT) AS rn FROM photos) WHERE rn <= 3")(
        lambda spark, sf, n=_n: ranking.top_per_group(photos(spark, sf).select(F.substring("day", 1, n).alias("bucket"), "id", "score"), ["bucket"], best_first(), 3).select("bucket", "id", "rn")
    )


@add("w04_latest_generation", "SELECT conv_id, turn, role FROM (SELECT *, row_number() OVER (PARTITION BY conv_id, role ORDER BY turn DESC) AS rn FROM conversations) WHERE rn = 1")
def w04(spark, sf):
    return ranking.latest_per_key(table(spark, sf, "conversations").select("conv_id", "turn", "role"), ["conv_id", "role"], [F.desc("turn")])


@add("w08_rank_in_cluster", P + "SELECT id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY score DESC NULLS LAST, id) AS INT) AS rank_in_cluster FROM photos")
def w08(spark, sf):
    return photos(spark, sf).select("id", F.row_number().over(Window.partitionBy("user_id").orderBy(*best_first())).alias("rank_in_cluster"))


_ANCHOR = "PARTITION BY user_id ORDER BY taken_ts, id"


@add("w10_nearest_anchors", P + f"SELECT id, last_value(CASE WHEN gps_lat IS NOT NULL AND gps_lon IS NOT NULL THEN id END IGNORE NULLS) OVER ({_ANCHOR} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS left_id, first_value(CASE WHEN gps_lat IS NOT NULL AND gps_lon IS NOT NULL THEN id END IGNORE NULLS) OVER ({_ANCHOR} ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS right_id FROM photos")
def w10(spark, sf):
    anchor = F.when(F.col("gps_lat").isNotNull() & F.col("gps_lon").isNotNull(), F.col("id"))
    found = timeline.anchored(photos(spark, sf).select("id", "user_id", "taken_ts", "gps_lat", "gps_lon"), ["user_id"], anchor)
    return found.select("id", F.col("_l").alias("left_id"), F.col("_r").alias("right_id"))


_GAP = "epoch_us(taken_ts) - epoch_us(lag(taken_ts) OVER (PARTITION BY {by} ORDER BY taken_ts, id))"


@add("w11_gap_sessions", P + f"SELECT id, session FROM (SELECT *, CAST(sum(new) OVER (PARTITION BY day ORDER BY taken_ts, id) AS BIGINT) AS session FROM (SELECT *, CASE WHEN coalesce({_GAP.format(by='day')} <= 600000000, FALSE) THEN 0 ELSE 1 END AS new FROM photos))")
def w11(spark, sf):
    return ranking.cut_at_gaps(photos(spark, sf), ["day"], "taken_ts", 600, "session").select("id", "session")


for _mode, _order in (("date_desc", "v DESC NULLS LAST, id"), ("date_asc", "v ASC NULLS LAST, id")):
    add(f"o01_sort_{_mode}", P + f"SELECT id, date_taken FROM (SELECT *, CASE WHEN substr(date_taken, 1, 4) > '0000' THEN date_taken END AS v FROM photos) ORDER BY {_order} LIMIT 200")(
        lambda spark, sf, m=_mode: photos(spark, sf).orderBy(*ranking.sort_order(m)).limit(200).select("id", "date_taken")
    )


@add("o01_sort_quality", P + "SELECT id, score FROM photos ORDER BY coalesce(score, -1) DESC, id LIMIT 200")
def o01(spark, sf):
    return photos(spark, sf).orderBy(*ranking.sort_order("quality")).limit(200).select("id", "score")


@add("o02_page", P + "SELECT id FROM photos ORDER BY coalesce(score, -1) DESC, id LIMIT 30 OFFSET 60")
def o02(spark, sf):
    return ranking.page(photos(spark, sf), ranking.sort_order("quality"), 60, 30).select("id")


@add("o04_dedupe_by_hash", P + "SELECT id FROM (SELECT id, row_number() OVER (PARTITION BY coalesce(nullif(file_hash, ''), concat('id:', id)) ORDER BY score DESC NULLS LAST, id) AS rn FROM photos) WHERE rn = 1")
def o04(spark, sf):
    return ranking.dedupe_by_hash(photos(spark, sf), best_first()).select("id")


@add("o05_best_buckets", P + "SELECT locality, id FROM photos WHERE score IS NOT NULL AND locality IN (SELECT locality FROM photos GROUP BY 1 ORDER BY max(score) DESC NULLS LAST, locality LIMIT 5)")
def o05(spark, sf):
    return ranking.buckets_best_first(photos(spark, sf).where("score is not null"), "locality", "score", 5).select("locality", "id")


@add("o07_over_fetch", P + "SELECT day, id FROM (SELECT day, id, row_number() OVER (PARTITION BY day ORDER BY score DESC NULLS LAST, id) AS rn FROM photos) WHERE rn <= 18")
def o07(spark, sf):
    return ranking.top_per_group(photos(spark, sf).select("day", "id", "score"), ["day"], best_first(), 18).select("day", "id")


@add("o09_manual_order", "SELECT o_custkey AS collection_id, o_orderkey AS photo_id, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority, o_orderdate, o_orderkey) AS INT) AS place FROM orders")
def o09(spark, sf):
    w = Window.partitionBy("o_custkey").orderBy("o_orderpriority", "o_orderdate", "o_orderkey")
    return table(spark, sf, "orders").select(F.col("o_custkey").alias("collection_id"), F.col("o_orderkey").alias("photo_id"), F.row_number().over(w).alias("place"))


@add("o10_effective_date_order", P + "SELECT id, coalesce(date_taken, day) AS d FROM photos ORDER BY d DESC NULLS LAST, id LIMIT 100")
def o10(spark, sf):
    return photos(spark, sf).select("id", S.effective_date("date_taken", F.lit(None).cast("string"), "filepath").alias("d")).orderBy(F.col("d").desc_nulls_last(), "id").limit(100)


@add("u01_intersection", P + "SELECT id FROM photos WHERE camera_model = 'click' INTERSECT SELECT id FROM photos WHERE score >= 10 INTERSECT SELECT id FROM photos WHERE gps_lat IS NOT NULL")
def u01(spark, sf):
    p = photos(spark, sf)
    return p.where("camera_model = 'click'").select("id").join(p.where("score >= 10").select("id"), "id").join(p.where("gps_lat is not null").select("id"), "id")


@add("u02_union_keep_first", P + "SELECT id, min(part) AS part FROM (SELECT id, 0 AS part FROM photos WHERE contains(place_name, 'town3,') UNION ALL SELECT id, 1 FROM photos WHERE admin1 = 'state3' UNION ALL SELECT id, 2 FROM photos WHERE gps_lat BETWEEN 40.2 AND 40.3) GROUP BY id")
def u02(spark, sf):
    p = photos(spark, sf)
    sets = [p.where("contains(place_name, 'town3,')"), p.where("admin1 = 'state3'"), p.where("gps_lat between 40.2D and 40.3D")]
    all_ = sets[0].select("id", F.lit(0).alias("part")).unionByName(sets[1].select("id", F.lit(1).alias("part"))).unionByName(sets[2].select("id", F.lit(2).alias("part")))
    return all_.groupBy("id").agg(F.min("part").alias("part"))


@add("u03_difference", "SELECT doc_id AS id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def u03(spark, sf):
    return table(spark, sf, "documents").select(F.col("doc_id").alias("id")).join(table(spark, sf, "labels").select(F.col("doc_id").alias("id")), "id", "left_anti")


@add("u04_tag_union", P + "SELECT id, CASE WHEN camera_model = locality THEN concat(camera_model, ',', admin1) ELSE concat(camera_model, ',', locality, ',', admin1) END AS tags FROM photos")
def u04(spark, sf):
    from lightshelf.operators.upkeep import tags_added

    return photos(spark, sf).select("id", F.concat_ws(",", tags_added(F.array("camera_model", "locality"), F.array("locality", "admin1"))).alias("tags"))


@add("u05_overlap", P + "SELECT id FROM photos WHERE camera_model IN ('view', 'town2') OR locality IN ('view', 'town2')")
def u05(spark, sf):
    return photos(spark, sf).where(F.arrays_overlap(F.array("camera_model", "locality"), F.array(F.lit("view"), F.lit("town2")))).select("id")


def _greedy(group, window, most, key):
    """SQL of greedy suppression in each `g`: rows best first, each against those kept before, until `most` are kept."""
    return f"""WITH RECURSIVE {P.removeprefix('WITH ').rstrip()}, r AS MATERIALIZED (SELECT {group} AS g, id, taken_ts, score, epoch_us(taken_ts) AS t, CAST(nullif(CAST({key} AS VARCHAR), '') AS VARCHAR) AS key, row_number() OVER (PARTITION BY {group} ORDER BY score DESC NULLS LAST, id) AS rn FROM photos),
    k AS (SELECT g, rn, [id] AS ids, [t] AS times, [coalesce(key, '#')] AS keys FROM r WHERE rn = 1
      UNION ALL SELECT g, rn, CASE WHEN ok THEN list_append(ids, id) ELSE ids END, CASE WHEN ok THEN list_append(times, t) ELSE times END, CASE WHEN ok THEN list_append(keys, coalesce(key, '#')) ELSE keys END
      FROM (SELECT r.*, k.ids, k.times, k.keys, (r.key IS NULL OR NOT list_contains(k.keys, r.key)) AND len(list_filter(k.times, lambda x: abs(x - r.t) < {window}000000)) = 0 AS ok FROM k JOIN r ON r.g = k.g AND r.rn = k.rn + 1 WHERE len(k.ids) < {most})),
    f AS (SELECT g, unnest(ids) AS id FROM (SELECT g, arg_max(ids, rn) AS ids FROM k GROUP BY g))"""


@add("t03_daily_highlights", _greedy("day", 600, 20, "stack_id") + " SELECT r.g AS day, r.id, r.taken_ts, r.score FROM f JOIN r USING (id)")
def t03(spark, sf):
    held = photos(spark, sf).select("id", "day", "taken_ts", "score", "stack_id")
    return ranking.best_apart(held, ["day"], 600.0, 20, same=["stack_id"]).select("day", "id", "taken_ts", "score").orderBy("taken_ts", "id")


@add("t04_ranked_near_duplicates", _greedy("substr(day, 1, 7)", 45, 10, "file_hash") + " SELECT g AS bucket, id FROM f")
def t04(spark, sf):
    held = photos(spark, sf).select("id", F.substring("day", 1, 7).alias("bucket"), "taken_ts", "score", "file_hash")
    return ranking.best_apart(held, ["bucket"], 45.0, 10, same=["file_hash"]).select("bucket", "id")


_CHAP = "SELECT *, CAST(sum(new) OVER (PARTITION BY {by} ORDER BY taken_ts, id) AS BIGINT) AS chapter FROM (SELECT *, CASE WHEN coalesce({gap} <= {us}, FALSE) AND NOT coalesce(lag(place_name) OVER (PARTITION BY {by} ORDER BY taken_ts, id) <> place_name, FALSE) THEN 0 ELSE 1 END AS new FROM photos)"


_SPAN = "count(*) AS n, min(taken_ts) AS first_ts, max(taken_ts) AS last_ts, count(DISTINCT CAST(taken_ts AS DATE)) AS n_days, count(DISTINCT {place}) AS n_places, min(id) AS first_id, coalesce(string_agg(DISTINCT {place}, ';' ORDER BY {place}), '') AS places, arg_max(id, (coalesce(score, -1), -id)) AS best_id"


@add("t01_chapters", P + f"SELECT user_id, chapter, {_SPAN.format(place='place_name')} FROM ({_CHAP.format(by='user_id', gap=_GAP.format(by='user_id'), us=43200000000)}) GROUP BY 1, 2 HAVING count(*) >= 3")
def t01(spark, sf):
    return timeline.chapters(photos(spark, sf), ["user_id"], 12.0, 3)


@add("t02_daily_scenes", P + f"SELECT day, chapter, {_SPAN.format(place='admin1')} FROM ({_CHAP.format(by='day', gap=_GAP.format(by='day'), us=300000000).replace('place_name', 'admin1')}) GROUP BY 1, 2")
def t02(spark, sf):
    return timeline.chapters(photos(spark, sf), ["day"], 300 / 3600, 1, "admin1")


_FLANK = f"""f AS (SELECT *, last_value(CASE WHEN ok THEN [epoch_us(taken_ts), gps_lat, gps_lon, id] END IGNORE NULLS) OVER ({_ANCHOR} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS l0,
 first_value(CASE WHEN ok THEN [epoch_us(taken_ts), gps_lat, gps_lon, id] END IGNORE NULLS) OVER ({_ANCHOR} ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS r0 FROM (SELECT *, gps_lat IS NOT NULL AND gps_lon IS NOT NULL AS ok FROM photos)),
 g AS (SELECT *, CASE WHEN epoch_us(taken_ts) - l0[1] <= 21600000000 THEN l0 END AS l, CASE WHEN r0[1] - epoch_us(taken_ts) <= 21600000000 THEN r0 END AS r FROM f WHERE NOT ok),
 h AS (SELECT *, CASE WHEN l IS NOT NULL AND r IS NOT NULL THEN 2 * 6371.0 * asin(sqrt(pow(sin(radians(r[2] - l[2]) / 2), 2) + cos(radians(l[2])) * cos(radians(r[2])) * pow(sin(radians(r[3] - l[3]) / 2), 2))) ELSE 0 END AS drift, l IS NOT NULL AND (r IS NULL OR epoch_us(taken_ts) - l[1] <= r[1] - epoch_us(taken_ts)) AS use_left FROM g),
 i AS (SELECT *, CASE WHEN use_left THEN l ELSE r END AS s, CASE WHEN use_left THEN epoch_us(taken_ts) - l[1] ELSE r[1] - epoch_us(taken_ts) END AS gap FROM h)
 SELECT id, CAST(s[4] AS BIGINT) AS source_id, round(s[2], 6) AS lat, round(s[3], 6) AS lon, round(greatest(0, 1 - gap / CAST(21600000000 AS DOUBLE)) * CASE WHEN l IS NOT NULL AND r IS NOT NULL THEN 1.0 ELSE 0.7 END, 6) AS confidence FROM i WHERE s IS NOT NULL AND drift <= 25 AND greatest(0, 1 - gap / CAST(21600000000 AS DOUBLE)) * CASE WHEN l IS NOT NULL AND r IS NOT NULL THEN 1.0 ELSE 0.7 END > 0.2"""


@add("t07_infer_locations", P.rstrip() + ", " + _FLANK)
def t07(spark, sf):
    found = timeline.infer_locations(photos(spark, sf), ["user_id"], 360.0, 25.0, 0.2)
    return found.select("id", "source_id", F.round("lat", 6).alias("lat"), F.round("lon", 6).alias("lon"), F.round("confidence", 6).alias("confidence"))


@add("j10_flanking_anchors", P.rstrip() + ", " + _FLANK.split(" h AS")[0].rstrip().rstrip(",") + " SELECT id, l IS NOT NULL AS has_left, r IS NOT NULL AS has_right FROM g")
def j10(spark, sf):
    return timeline.flanked(photos(spark, sf), ["user_id"], 360.0).select("id", F.col("_l").isNotNull().alias("has_left"), F.col("_r").isNotNull().alias("has_right"))


_KM = "2 * 6371.0 * asin(sqrt(pow(sin(radians(n_lat - l_lat) / 2), 2) + cos(radians(l_lat)) * cos(radians(n_lat)) * pow(sin(radians(n_lon - l_lon) / 2), 2)))"
_FOLD = f"""WITH RECURSIVE {P.removeprefix('WITH ').rstrip()}, o AS MATERIALIZED (SELECT user_id, id, epoch_us(taken_ts) / CAST(1000000 AS DOUBLE) AS t, gps_lat AS lat, gps_lon AS lon, gps_lat IS NOT NULL AND gps_lon IS NOT NULL AS ok, row_number() OVER u AS rn FROM photos WINDOW u AS (PARTITION BY user_id ORDER BY taken_ts, id)),
 r AS MATERIALIZED (SELECT *, first_value(CASE WHEN ok THEN [t, lat, lon] END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY rn ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS nxt FROM o),
 k AS (SELECT user_id, CAST(0 AS BIGINT) AS rn, CAST(NULL AS BIGINT) AS id, CAST(NULL AS DOUBLE) AS l_t, CAST(NULL AS DOUBLE) AS l_lat, CAST(NULL AS DOUBLE) AS l_lon, CAST(1 AS DOUBLE) AS l_c, 0 AS l_hop, FALSE AS made FROM (SELECT DISTINCT user_id FROM r)
  UNION ALL SELECT user_id, rn, id, CASE WHEN ok OR good THEN t ELSE l_t END, CASE WHEN ok THEN lat WHEN good THEN s_lat ELSE l_lat END, CASE WHEN ok THEN lon WHEN good THEN s_lon ELSE l_lon END, CASE WHEN ok THEN 1 WHEN good THEN c ELSE l_c END, CASE WHEN ok THEN 0 WHEN good THEN s_hop + 1 ELSE l_hop END, NOT ok AND good
  FROM (SELECT *, (has_l OR has_n) AND c > 0 AND (NOT (has_l AND has_n) OR {_KM} <= 25) AS good
   FROM (SELECT *, CASE WHEN left_ THEN l_lat ELSE n_lat END AS s_lat, CASE WHEN left_ THEN l_lon ELSE n_lon END AS s_lon, CASE WHEN left_ THEN l_hop ELSE 0 END AS s_hop, greatest(0, 1 - CASE WHEN left_ THEN t - l_t ELSE n_t - t END / 21600) * CASE WHEN has_l AND has_n THEN 1.0 ELSE 0.7 END * CASE WHEN left_ THEN l_c ELSE 1 END AS c
    FROM (SELECT *, has_l AND (NOT has_n OR t - l_t <= n_t - t) AS left_ FROM (SELECT r.*, k.l_t, k.l_lat, k.l_lon, k.l_c, k.l_hop, r.nxt[1] AS n_t, r.nxt[2] AS n_lat, r.nxt[3] AS n_lon, coalesce(r.t - k.l_t <= 21600, FALSE) AS has_l, coalesce(r.nxt[1] - r.t <= 21600, FALSE) AS has_n FROM k JOIN r ON r.user_id = k.user_id AND r.rn = k.rn + 1)))))
 SELECT id, round(l_lat, 6) AS lat, round(l_lon, 6) AS lon, round(l_c, 6) AS confidence, l_hop AS hop FROM k WHERE made"""


@add("t08_infer_locations_cascade", _FOLD)
def t08(spark, sf):
    found = timeline.infer_locations_cascade(photos(spark, sf), ["user_id"], 360.0)
    return found.select("id", F.round("lat", 6).alias("lat"), F.round("lon", 6).alias("lon"), F.round("confidence", 6).alias("confidence"), "hop")


@add("a24_confidence_buckets", P.rstrip() + ", " + _FLANK.split(" SELECT id, CAST(s[4]")[0] + " SELECT CASE WHEN c >= 0.8 THEN 'high' WHEN c >= 0.5 THEN 'medium' WHEN c >= 0.2 THEN 'low' ELSE 'very_low' END AS bucket, count(*) AS n FROM (SELECT greatest(0, 1 - gap / CAST(21600000000 AS DOUBLE)) * CASE WHEN l IS NOT NULL AND r IS NOT NULL THEN 1.0 ELSE 0.7 END AS c FROM i WHERE s IS NOT NULL AND drift <= 25) WHERE c > 0.2 GROUP BY 1")
def a24(spark, sf):
    return facets.counts_by(timeline.infer_locations(photos(spark, sf), ["user_id"], 360.0, 25.0, 0.2), facets.confidence_bucket("confidence"))


@add("n15_apply_inference", P.rstrip() + ", " + _FLANK.split(" SELECT id, CAST(s[4]")[0] + ", got AS (SELECT id, s[2] AS lat FROM i WHERE s IS NOT NULL AND drift <= 25 AND greatest(0, 1 - gap / CAST(21600000000 AS DOUBLE)) * CASE WHEN l IS NOT NULL AND r IS NOT NULL THEN 1.0 ELSE 0.7 END > 0.5) SELECT p.id, round(coalesce(p.gps_lat, got.lat), 6) AS lat, CASE WHEN p.gps_lat IS NULL AND got.lat IS NOT NULL THEN 'inferred' END AS source FROM photos p LEFT JOIN got USING (id)")
def n15(spark, sf):
    p = photos(spark, sf)
    got = timeline.infer_locations(p, ["user_id"], 360.0, 25.0, 0.5).select("id", "lat")
    return p.join(got, "id", "left").select("id", F.round(F.coalesce("gps_lat", "lat"), 6).alias("lat"), F.when(F.col("gps_lat").isNull() & F.col("lat").isNotNull(), "inferred").alias("source"))


@add("j08_nearby_stacks", P + "SELECT a.stack_id, b.stack_id AS o_stack_id, count(DISTINCT b.id) AS n_members, round(min(abs(epoch_us(a.taken_ts) - epoch_us(b.taken_ts))) / CAST(1000000 AS DOUBLE), 6) AS least_gap FROM photos a JOIN photos b ON a.stack_id <> b.stack_id AND abs(epoch_us(a.taken_ts) - epoch_us(b.taken_ts)) < 600000000 GROUP BY 1, 2")
def j08(spark, sf):
    s = photos(spark, sf).where("stack_id is not null").select("id", "stack_id", "taken_ts")
    # whole microseconds as seconds are rounded to six places already
    return timeline.nearby_stacks(s, 600.0)


_VEC = "v AS (SELECT event_id AS id, ts AS taken_ts, CAST(embedding AS DOUBLE[]) AS e FROM events JOIN embeddings ON vec_id = event_id % (SELECT count(*) FROM embeddings))"


def with_vectors(spark, sf):
    e = table(spark, sf, "embeddings").select((F.col("vec_id")).alias("_v"), "embedding")
    return photos(spark, sf).select("id", "user_id", "taken_ts", "score").withColumn("_v", F.col("id") % e.count()).join(e, "_v").drop("_v")


@add("j09_burst_pairs", f"WITH {_VEC} SELECT a.id, b.id AS o_id, round(list_distance(a.e, b.e), 6) AS distance FROM v a JOIN v b ON a.id < b.id AND abs(epoch_us(a.taken_ts) - epoch_us(b.taken_ts)) <= 300000000 WHERE list_distance(a.e, b.e) <= 1.25")
def j09(spark, sf):
    rows = with_vectors(spark, sf).select("id", "taken_ts", "embedding")
    return timeline.burst_pairs(rows, 300.0, 1.25, cosine=False).select("id", "o_id", F.round("distance", 6).alias("distance"))


def stacks_sql(rows, seconds, distance, span, same="TRUE"):
    """SQL: pairs of `v` (given by `rows`) near in time and distance, their components, cut and ranked."""
    return f"""{rows},
    p AS MATERIALIZED (SELECT a.id AS a, b.id AS b FROM v a JOIN v b ON a.id <> b.id AND {same} AND abs(epoch_us(a.taken_ts) - epoch_us(b.taken_ts)) <= {seconds}000000 WHERE list_distance(a.e, b.e) <= {distance}),
    r AS (SELECT a AS node, a AS seen FROM p UNION SELECT r.node, p.b FROM r JOIN p ON p.a = r.seen),
    c AS (SELECT node AS id, min(seen) AS component FROM r GROUP BY 1),
    m AS (SELECT id, score, taken_ts, first_value(id) OVER w AS stack_id, first_value(taken_ts) OVER w AS first_ts FROM c JOIN v USING (id) WINDOW w AS (PARTITION BY component ORDER BY taken_ts, id)),
    k AS (SELECT *, count(*) OVER (PARTITION BY stack_id) AS n, row_number() OVER (PARTITION BY stack_id ORDER BY coalesce(score, 0) DESC, taken_ts, id) - 1 AS place FROM m WHERE epoch_us(taken_ts) - epoch_us(first_ts) <= {span}000000)
    SELECT stack_id, id, place = 0 AS is_top, CAST(place AS INT) AS place FROM k WHERE n > 1"""


_ROWS = "WITH RECURSIVE " + _VEC.replace("event_id AS id,", "event_id AS id, user_id, CASE WHEN event_id % 11 = 0 THEN NULL ELSE value END AS score,")


@add("t05_burst_stacks", stacks_sql(_ROWS, 300, 1.25, 600))
def t05(spark, sf):
    return timeline.burst_stacks(with_vectors(spark, sf), 300.0, 1.25, 600.0, cosine=False)


@add("t06_session_stacks", stacks_sql(_ROWS, 3600, 1.2, 36000, "a.user_id = b.user_id"))
def t06(spark, sf):
    return timeline.burst_stacks(with_vectors(spark, sf), 3600.0, 1.2, 36000.0, cosine=False, by=["user_id"])


@add("j11_seen_near", P + "SELECT id FROM photos a WHERE camera_model = 'error' AND EXISTS (SELECT 1 FROM photos b WHERE b.camera_model = 'purchase' AND b.user_id = a.user_id AND abs(epoch_us(a.taken_ts) - epoch_us(b.taken_ts)) <= 36000000000)")
def j11(spark, sf):
    p = photos(spark, sf)
    a = p.where("camera_model = 'error'").select(F.col("id").alias("face_id"), F.col("user_id").alias("person_id"), "taken_ts")
    b = p.where("camera_model = 'purchase'").select(F.col("user_id").alias("person_id"), "taken_ts")
    return people.seen_near(a, b, 600.0).select(F.col("face_id").alias("id"))


@add("t10_capped_scenes")
def t10(spark, sf):
    scenes = ranking.cut_at_gaps(photos(spark, sf), ["user_id", "day"], "taken_ts", 2400.0, "scene").groupBy("user_id", "day", "scene").agg(F.count("*").alias("n"), F.min("taken_ts").alias("first_ts"))
    return timeline.capped_scenes(scenes, ["user_id"], 20)


@add("t11_largest_remainder", P + "SELECT user_id, day, CAST(w + CASE WHEN k <= seats THEN 1 ELSE 0 END AS BIGINT) AS seats FROM (SELECT *, 40 - sum(w) OVER (PARTITION BY user_id) AS seats, row_number() OVER (PARTITION BY user_id ORDER BY share - w DESC, day) AS k FROM (SELECT user_id, day, n * CAST(40 AS DOUBLE) / sum(n) OVER (PARTITION BY user_id) AS share, floor(n * CAST(40 AS DOUBLE) / sum(n) OVER (PARTITION BY user_id)) AS w FROM (SELECT user_id, day, count(*) AS n FROM photos GROUP BY 1, 2)))")
def t11(spark, sf):
    days = photos(spark, sf).groupBy("user_id", "day").agg(F.count("*").alias("n"))
    return ranking.largest_remainder(days, "n", 40, "day", ["user_id"]).select("user_id", "day", "seats")


@add("t12_layout", P + "SELECT user_id, part, count(*) AS n, arg_max(id, (coalesce(score, -1), -id)) AS hero FROM (SELECT *, CAST(ntile(6) OVER (PARTITION BY user_id ORDER BY taken_ts, id) AS INT) AS part FROM photos) GROUP BY 1, 2")
def t12(spark, sf):
    parts = ranking.even_parts(photos(spark, sf), [F.col("taken_ts"), F.col("id")], 6, ["user_id"])
    return parts.groupBy("user_id", "part").agg(F.count("*").alias("n"), F.max_by("id", F.struct(F.coalesce("score", F.lit(-1.0)), -F.col("id"))).alias("hero"))


@add("t14_overlap_days", P + ", g AS (SELECT user_id, min(taken_ts) AS a, max(taken_ts) AS b FROM photos GROUP BY 1) SELECT x.user_id AS left_user, y.user_id AS right_user, CASE WHEN greatest(x.a, y.a) >= least(x.b, y.b) THEN 0 ELSE greatest(1, CAST(floor((epoch_us(least(x.b, y.b)) - epoch_us(greatest(x.a, y.a))) / CAST(86400000000 AS DOUBLE)) AS BIGINT)) END AS days FROM g x JOIN g y ON x.user_id < y.user_id")
def t14(spark, sf):
    g = photos(spark, sf).groupBy("user_id").agg(F.min("taken_ts").alias("a"), F.max("taken_ts").alias("b"))
    return timeline.overlapping(g, "user_id", "a", "b").selectExpr("left AS left_user", "right AS right_user", "days")


@add("h27_interleave", P + "SELECT id, CAST(row_number() OVER (PARTITION BY user_id, camera_model = 'view' ORDER BY taken_ts, id) AS INT) AS turn FROM photos")
def h27(spark, sf):
    rows = photos(spark, sf).withColumn("scenery", F.col("camera_model") == "view")
    return ranking.interleaved(rows, "scenery", [F.col("taken_ts"), F.col("id")], ["user_id"]).select("id", "turn")


@add("x01_hourly_windows", "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS hour, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def x01(spark, sf):
    return activity.hourly(table(spark, sf, "events")).withColumn("total", F.round("total", 4))


@add("x02_sliding_look_back", "SELECT CAST(d AS TIMESTAMP) AS start, count(*) AS n FROM (SELECT unnest([CAST(CAST(ts AS DATE) AS TIMESTAMP), CAST(CAST(ts AS DATE) AS TIMESTAMP) - INTERVAL 1 DAY, CAST(CAST(ts AS DATE) AS TIMESTAMP) - INTERVAL 2 DAY]) AS d FROM events) GROUP BY 1")
def x02(spark, sf):
    return activity.sliding(table(spark, sf, "events"))


@add("x03_session_windows", "SELECT user_id, min(ts) AS first_ts, count(*) AS n FROM (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM (SELECT *, CASE WHEN epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id)) < 2400000000 THEN 0 ELSE 1 END AS new FROM events)) GROUP BY user_id, s")
def x03(spark, sf):
    return activity.sessions(table(spark, sf, "events")).select("user_id", "first_ts", "n")


@add("x05_ingest_dedupe", "SELECT min(event_id) AS event_id FROM (SELECT event_id, row_number() OVER (PARTITION BY event_type, CAST(floor(value) AS BIGINT) ORDER BY ts, event_id) AS rn, event_type, CAST(floor(value) AS BIGINT) AS v FROM events) WHERE rn = 1 GROUP BY event_type, v")
def x05(spark, sf):
    keyed = table(spark, sf, "events").withColumn("content_hash", F.concat_ws(":", "event_type", F.floor("value").cast("string")))
    return activity.first_of_each(keyed).select("event_id")


@add("s15_points", P + "SELECT id, round(gps_lat, 6) AS lat, round(gps_lon, 6) AS lon, TRY_CAST(substr(date_taken, 1, 4) AS INT) AS year, place_name AS place FROM photos WHERE gps_lat IS NOT NULL AND gps_lon IS NOT NULL")
def s15(spark, sf):
    return files.points(photos(spark, sf))


@add("s19_book_manifest", "SELECT l_suppkey AS book_id, l_partkey AS photo_id, CAST(row_number() OVER (PARTITION BY l_suppkey ORDER BY min(l_orderkey * 10 + l_linenumber), l_partkey) AS INT) AS position FROM lineitem GROUP BY l_suppkey, l_partkey")
def s19(spark, sf):
    cells = table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("book_id"), F.col("l_partkey").alias("photo_id"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("position"))
    return files.book_manifest(cells)
