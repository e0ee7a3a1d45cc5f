"""Scans, filters, facets and aggregates over photos and texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from lightshelf.functions import scalar as S
from lightshelf.functions import text as T
from lightshelf.operators import facets, filters, ranking
from lightshelf.queries import Registry
from lightshelf.sources.library import library, table, with_library

REGISTRY = Registry()
add = REGISTRY.add
P = with_library("photos")
X = with_library("texts")


def photos(spark, sf):
    return library(spark, sf, "photos")


def texts(spark, sf):
    return library(spark, sf, "texts")


def filtered(name, condition, sql):
    """A filter of photos: its ids, against a WHERE clause."""
    add(name, f"{P} SELECT id FROM photos WHERE {sql}")(lambda spark, sf: photos(spark, sf).where(condition()).select("id"))


@add("s01_scan_projection", P + "SELECT id, day, score FROM photos")
def s01(spark, sf):
    return photos(spark, sf).select("id", "day", "score")


@add("s02_point_lookup", P + "SELECT id, filepath FROM photos WHERE id = 42 OR filepath = (SELECT min(filepath) FROM photos WHERE id = 77)")
def s02(spark, sf):
    p = photos(spark, sf)
    path = p.where("id = 77").select(F.min("filepath").alias("filepath"))
    return p.where("id = 42").select("id", "filepath").unionByName(p.join(path, "filepath", "left_semi").where("id <> 42").select("id", "filepath"))


@add("s03_bulk_lookup", P + "SELECT id, score FROM photos WHERE id IN (SELECT doc_id * 3 FROM labels)")
def s03(spark, sf):
    ids = table(spark, sf, "labels").select((F.col("doc_id") * 3).alias("id")).distinct()
    return photos(spark, sf).join(ids, "id", "left_semi").select("id", "score")


filtered("s04_directory_scan", lambda: filters.in_directory("filepath", "/lib/2024/2024-01-28_u33"), "starts_with(filepath, '/lib/2024/2024-01-28_u33/')")
filtered("f01_date_range", lambda: filters.date_between("date_taken", "2024-01-05", "2024-01-09"), "regexp_matches(date_taken, '^[0-9]{4}-[0-9]{2}-[0-9]{2}') AND substr(date_taken, 1, 4) > '0000' AND substr(date_taken, 1, 10) BETWEEN '2024-01-05' AND '2024-01-09'")
filtered("f02_location", lambda: filters.at_location("town2", "FR"), "coalesce(contains(lower(place_name), 'town2') OR suffix(place_name, ', FR'), FALSE) OR coalesce(country = 'FR', FALSE) OR coalesce(lower(locality) = 'town2' OR lower(admin1) = 'town2', FALSE) OR coalesce(lower(country) = 'town2', FALSE)")
filtered("f03_bounding_box", lambda: filters.in_box("gps_lat", "gps_lon", 40.2, 40.6, -119.9, -119.6), "gps_lat BETWEEN CAST(40.2 AS DOUBLE) - CAST(0.04 AS DOUBLE) AND CAST(40.6 AS DOUBLE) + CAST(0.04 AS DOUBLE) AND gps_lon BETWEEN CAST(-119.9 AS DOUBLE) - CAST(0.04 AS DOUBLE) AND CAST(-119.6 AS DOUBLE) + CAST(0.04 AS DOUBLE)")
filtered("f04_place_text", lambda: filters.contains("place_name", "State3"), "coalesce(contains(lower(place_name), 'state3'), FALSE)")
filtered("f05_filename_part", lambda: filters.contains("filename", "img_0012"), "contains(lower(filename), 'img_0012')")
filtered("f09_camera", lambda: F.col("camera_model") == "click", "camera_model = 'click'")
filtered("f10_quality_floor", lambda: filters.at_least("score", 20.0), "coalesce(score, -1) >= 20.0")
filtered("f11_dimension_floors", lambda: filters.at_least("aes_technical", 5.0) & filters.at_least("aes_composition", 30.0) & filters.at_least("aes_impact", 10.0), "coalesce(aes_technical, -1) >= 5.0 AND coalesce(aes_composition, -1) >= 30.0 AND coalesce(aes_impact, -1) >= 10.0")
_RGB = "sqrt(power(CAST(concat('0x', substr({c}, 2, 2)) AS INT) - 128, 2) + power(CAST(concat('0x', substr({c}, 4, 2)) AS INT) - 128, 2) + power(CAST(concat('0x', substr({c}, 6, 2)) AS INT) - 128, 2))"
filtered("f17_colour_within", lambda: filters.colour_within(F.array("colour", "colour2"), "#808080", 60.0), f"least({_RGB.format(c='colour')}, {_RGB.format(c='colour2')}) <= 60")
filtered("f21_corrupt_date", lambda: F.col("date_taken").isNotNull() & ~S.valid_date("date_taken"), "date_taken IS NOT NULL AND (NOT regexp_matches(date_taken, '^[0-9]{4}-[0-9]{2}-[0-9]{2}') OR substr(date_taken, 1, 4) = '0000')")
filtered("f22_bad_gps", lambda: filters.bad_gps(), "gps_lat = 0 AND gps_lon = 0 OR abs(gps_lat) > 90 OR abs(gps_lon) > 180")

_TERMS = "list_distinct(list_filter(regexp_extract_all(lower(description), '([a-z]+(?:-[a-z]+)*)', 1), lambda w: len(w) >= 5))"


def with_terms(df):
    return df.withColumn("keywords", T.content_terms("description", 5))


_STOP = "(" + ", ".join(f"'{w}'" for w in sorted(T.STOP_WORDS) if len(w) >= 5) + ")"
_KEYWORDS = f"list_distinct(list_filter(regexp_extract_all(lower(description), '([a-z]+(?:-[a-z]+)*)', 1), lambda w: len(w) >= 5 AND w NOT IN {_STOP}))"


@add("f06_member", X + f"SELECT id FROM texts WHERE list_contains({_KEYWORDS}, 'thtion')")
def f06(spark, sf):
    return with_terms(texts(spark, sf)).where(filters.has_member("keywords", "ThTion")).select("id")


@add("f07_member_part", X + f"SELECT id FROM texts WHERE len(list_filter({_KEYWORDS}, lambda w: contains(w, 'tiontion'))) > 0")
def f07(spark, sf):
    return with_terms(texts(spark, sf)).where(filters.has_member_part("keywords", "tionTion")).select("id")


@add("f08_style_member", X + "SELECT id FROM texts WHERE category IN ('fr') AND list_contains([category, camera_model], 'src3')")
def f08(spark, sf):
    return texts(spark, sf).withColumn("tags", F.array("category", "camera_model")).where(filters.has_member("tags", "FR") & filters.has_member("tags", "src3")).select("id")


@add("f18_excluded_terms", X + "SELECT id FROM texts WHERE NOT regexp_matches(lower(description), '(^|[^\\w])(idiot|moron)([^\\w]|$)')")
def f18(spark, sf):
    return texts(spark, sf).where(~T.contains_excluded("description", ["idiot", "moron"])).select("id")


@add("f19_all_words", X + "SELECT id FROM texts WHERE contains(lower(concat_ws(' ', description, category, camera_model)), 'src1') AND contains(lower(concat_ws(' ', description, category, camera_model)), 'the')")
def f19(spark, sf):
    return texts(spark, sf).where(filters.all_words(["src1", "the"], "description", "category", "camera_model")).select("id")


@add("f20_description_words", X + "SELECT id FROM texts WHERE contains(lower(description), 'with') AND contains(lower(description), 'thing')")
def f20(spark, sf):
    return texts(spark, sf).where(filters.all_words(["with", "thing"], "description")).select("id")


@add("f24_scope", P + "SELECT id FROM photos WHERE starts_with(filepath, '/lib/2024/2024-01-02_u7/') OR id IN (SELECT doc_id FROM labels WHERE quality = 0)")
def f24(spark, sf):
    p = photos(spark, sf)
    collection = table(spark, sf, "labels").where("quality = 0").select(F.col("doc_id").alias("id"))
    return p.join(collection, "id", "left_semi").select("id").unionByName(p.where(filters.in_directory("filepath", "/lib/2024/2024-01-02_u7")).select("id")).distinct()


@add("f26_verification_failures", "SELECT doc_id AS id, CASE WHEN toxic = 1 THEN 'fail' ELSE 'regenerated' END AS status FROM labels WHERE toxic = 1 OR quality = 0")
def f26(spark, sf):
    return table(spark, sf, "labels").where("toxic = 1 or quality = 0").select(F.col("doc_id").alias("id"), F.when(F.col("toxic") == 1, "fail").otherwise("regenerated").alias("status"))


@add("f27_geotag_worklist", P + "SELECT id, coalesce(date_taken, filepath) AS sort_key FROM photos WHERE gps_lat IS NULL AND user_id = 9")
def f27(spark, sf):
    return photos(spark, sf).where("gps_lat is null and user_id = 9").select("id", F.coalesce("date_taken", "filepath").alias("sort_key")).orderBy("sort_key", "id")


@add("f28_compact_hit", X + "SELECT id, category, CASE WHEN length(description) > 240 THEN concat(rtrim(substr(description, 1, 239)), '…') ELSE description END AS description FROM texts")
def f28(spark, sf):
    return filters.compact(texts(spark, sf), ["id", "category"], "description", 240)


@add("f29_serialised_hits", P + "SELECT p.id, coalesce(json_extract_string(props, '$.k'), '') AS k, s.n AS stack_size, s.top_id FROM photos p LEFT JOIN (SELECT stack_id, count(*) AS n, min(id) AS top_id FROM photos WHERE stack_id IS NOT NULL GROUP BY stack_id) s ON p.stack_id = s.stack_id")
def f29(spark, sf):
    p = photos(spark, sf)
    stacks = p.where("stack_id is not null").groupBy("stack_id").agg(F.count("*").alias("stack_size"), F.min("id").alias("top_id"))
    return p.join(stacks, "stack_id", "left").select("id", F.coalesce(F.get_json_object("props", "$.k"), F.lit("")).alias("k"), "stack_size", "top_id")


@add("filters_together", P + "SELECT id FROM photos WHERE regexp_matches(date_taken, '^[0-9]{4}-[0-9]{2}-[0-9]{2}') AND substr(date_taken, 1, 10) BETWEEN '2024-01-03' AND '2024-01-20' AND camera_model = 'view' AND coalesce(score, -1) >= 5.0")
def together(spark, sf):
    return filters.apply_filters(photos(spark, sf), filters.FilterSpec(date_from="2024-01-03", date_to="2024-01-20", camera="view", min_quality=5.0)).select("id")


for _kind, _n in (("year", 4), ("month", 7), ("day", 10)):
    add(f"a01_facet_{_kind}", P + f"SELECT substr(date_taken, 1, {_n}) AS bucket, count(*) AS n FROM photos WHERE regexp_matches(date_taken, '^[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}') AND substr(date_taken, 1, 4) > '0000' GROUP BY 1")(
        lambda spark, sf, kind=_kind: facets.counts_by(photos(spark, sf).where(S.valid_date("date_taken")), S.date_bucket("date_taken", kind))
    )
for _column in ("camera_model", "locality"):
    add(f"a01_facet_{_column}", P + f"SELECT {_column} AS bucket, count(*) AS n FROM photos GROUP BY 1")(lambda spark, sf, c=_column: facets.counts_by(photos(spark, sf), F.col(c)))


@add("a03_overview", P + "SELECT count(*) AS n_photos, count(gps_lat) AS n_located, count(score) AS n_scored, count(place_name) AS n_placed, count(DISTINCT camera_model) AS n_cameras, count(stack_id) AS n_stacked, min(CASE WHEN substr(date_taken, 1, 4) > '0000' THEN date_taken END) AS first_date, max(CASE WHEN substr(date_taken, 1, 4) > '0000' THEN date_taken END) AS last_date FROM photos")
def a03(spark, sf):
    valid = F.when(S.valid_date("date_taken"), F.col("date_taken"))
    return photos(spark, sf).agg(
        F.count("*").alias("n_photos"), F.count("gps_lat").alias("n_located"), F.count("score").alias("n_scored"), F.count("place_name").alias("n_placed"),
        F.countDistinct("camera_model").alias("n_cameras"), F.count("stack_id").alias("n_stacked"), F.min(valid).alias("first_date"), F.max(valid).alias("last_date"),
    )


_KINDS = " UNION ALL ".join(f"SELECT '{c}' AS kind, {c} AS value, count(*) AS n FROM photos WHERE {c} IS NOT NULL GROUP BY {c}" for c in ("locality", "admin1", "country"))


@add("a05_places_by_kind", P + f"SELECT kind, value, n FROM (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY n DESC, value) AS rn FROM ({_KINDS})) WHERE rn <= 5")
def a05(spark, sf):
    return facets.values_by_kind(photos(spark, sf), ["locality", "admin1", "country"], 5)


@add("a06_vocabulary", X + f"SELECT term, count(*) AS n FROM (SELECT unnest({_KEYWORDS}) AS term FROM texts) GROUP BY term HAVING count(*) >= 5")
def a06(spark, sf):
    return facets.vocabulary(with_terms(texts(spark, sf)), F.col("keywords"), least=5)


@add("a07_top_vocabulary", X + f"SELECT term, count(*) AS n FROM (SELECT unnest({_KEYWORDS}) AS term FROM texts) GROUP BY term ORDER BY n DESC, term LIMIT 25")
def a07(spark, sf):
    return facets.vocabulary(with_terms(texts(spark, sf)), F.col("keywords")).orderBy(F.desc("n"), "term").limit(25)


@add("a08_stats", P + "SELECT count(*) AS n, min(score) AS least, max(score) AS most, round(avg(score), 2) AS mean, count(DISTINCT stack_id) AS n_stacks FROM photos")
def a08(spark, sf):
    return photos(spark, sf).agg(F.count("*").alias("n"), F.min("score").alias("least"), F.max("score").alias("most"), F.round(F.avg("score"), 2).alias("mean"), F.countDistinct("stack_id").alias("n_stacks"))


@add("a09_hourly_activity", "SELECT strftime(date_trunc('hour', ts), '%Y-%m-%dT%H:00:00') AS hour, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events WHERE ts > (SELECT max(ts) FROM events) - INTERVAL 3 DAY GROUP BY 1, 2")
def a09(spark, sf):
    e = table(spark, sf, "events")
    now = e.agg(F.max("ts").alias("now"))
    late = e.join(F.broadcast(now), F.col("ts") > F.col("now") - F.expr("INTERVAL 3 DAYS"))  # one row
    return late.groupBy(S.hour_bucket("ts").alias("hour"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))


@add("a10_model_histogram", "SELECT role AS model, count(*) AS n FROM (SELECT conv_id, role, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS rn FROM conversations) WHERE rn = 1 GROUP BY 1")
def a10(spark, sf):
    return ranking.latest_per_key(table(spark, sf, "conversations").select("conv_id", "turn", "role"), ["conv_id"], [F.desc("turn")]).groupBy(F.col("role").alias("model")).agg(F.count("*").alias("n"))


@add("a11_recent_errors", "SELECT event_id, ts, value FROM events WHERE event_type = 'error' AND ts > (SELECT max(ts) FROM events) - INTERVAL 3 DAY ORDER BY ts DESC, event_id LIMIT 200")
def a11(spark, sf):
    e = table(spark, sf, "events")
    now = e.agg(F.max("ts").alias("now"))
    return e.where("event_type = 'error'").join(F.broadcast(now), F.col("ts") > F.col("now") - F.expr("INTERVAL 3 DAYS")).orderBy(F.desc("ts"), "event_id").limit(200).select("event_id", "ts", "value")


@add("a12_cameras", P + "SELECT camera_model, count(*) AS n, max(camera_make) AS make, max(CASE WHEN substr(date_taken, 1, 4) > '0000' THEN date_taken END) AS last_used FROM photos GROUP BY 1")
def a12(spark, sf):
    return photos(spark, sf).groupBy("camera_model").agg(F.count("*").alias("n"), F.max("camera_make").alias("make"), F.max(F.when(S.valid_date("date_taken"), F.col("date_taken"))).alias("last_used"))


@add("a13_folders", P + "SELECT folder, coalesce(max(date_taken), '') AS last_date, count(*) AS n FROM photos GROUP BY folder")
def a13(spark, sf):
    return photos(spark, sf).groupBy("folder").agg(F.coalesce(F.max("date_taken"), F.lit("")).alias("last_date"), F.count("*").alias("n"))


@add("a14_geotag_folders", P + "SELECT folder, count(*) AS n, CAST(sum(CASE WHEN gps_lat IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS no_gps, min(nullif(date_taken, '')) AS first_date FROM photos GROUP BY folder HAVING sum(CASE WHEN gps_lat IS NULL THEN 1 ELSE 0 END) > 0")
def a14(spark, sf):
    return photos(spark, sf).groupBy("folder").agg(F.count("*").alias("n"), F.sum(F.col("gps_lat").isNull().cast("bigint")).alias("no_gps"), F.min(F.nullif("date_taken", F.lit(""))).alias("first_date")).where("no_gps > 0")


@add("a15_known_places", P + "SELECT place_name, count(*) AS n FROM photos WHERE place_name IS NOT NULL GROUP BY 1 ORDER BY n DESC, place_name LIMIT 20")
def a15(spark, sf):
    return photos(spark, sf).where("place_name is not null").groupBy("place_name").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "place_name").limit(20)


@add("a22_duplicate_groups", X + "SELECT file_hash, count(*) AS n, count(*) - 1 AS redundant, list_sort(list(id)) AS ids FROM texts GROUP BY 1 HAVING count(*) > 1")
def a22(spark, sf):
    return facets.duplicates_by(texts(spark, sf).select("id", "file_hash"), "file_hash").select("file_hash", "n", "redundant", "ids")


@add("a23_ids_per_hash", P + "SELECT file_hash, array_to_string(list_sort(list(id)), ',') AS ids FROM photos WHERE file_hash IS NOT NULL GROUP BY 1 HAVING count(*) > 1")
def a23(spark, sf):
    return facets.duplicates_by(photos(spark, sf), "file_hash").select("file_hash", F.concat_ws(",", F.col("ids").cast("array<string>")).alias("ids"))


@add("a26_weighted_overall", P + "SELECT id, CASE WHEN aes_technical IS NULL AND aes_composition IS NULL AND aes_impact IS NULL THEN NULL ELSE round((coalesce(aes_technical, 0) * CAST(0.3 AS DOUBLE) + coalesce(aes_composition, 0) * CAST(0.3 AS DOUBLE) + coalesce(aes_impact, 0) * CAST(0.4 AS DOUBLE)) / (CASE WHEN aes_technical IS NULL THEN CAST(0 AS DOUBLE) ELSE CAST(0.3 AS DOUBLE) END + CASE WHEN aes_composition IS NULL THEN CAST(0 AS DOUBLE) ELSE CAST(0.3 AS DOUBLE) END + CASE WHEN aes_impact IS NULL THEN CAST(0 AS DOUBLE) ELSE CAST(0.4 AS DOUBLE) END), 3) END AS overall FROM photos")
def a26(spark, sf):
    return photos(spark, sf).select("id", facets.weighted_mean({"aes_technical": 0.3, "aes_composition": 0.3, "aes_impact": 0.4}).alias("overall"))


@add("a27_outlier_floor", P + "SELECT camera_model, quantile_cont(score, 0.5) AS median, round(stddev_pop(score), 6) AS deviation, round(quantile_cont(score, 0.5) - 1.5 * stddev_pop(score), 6) AS floor FROM photos GROUP BY 1")
def a27(spark, sf):
    return facets.outlier_floor(photos(spark, sf), "camera_model", "score").select("camera_model", "median", F.round("deviation", 6).alias("deviation"), F.round("floor", 6).alias("floor"))


_DIMS = ("aes_composition", "aes_impact", "aes_technical")
_LONG = " UNION ALL ".join(f"SELECT id, '{d}' AS k, {d} AS v FROM photos WHERE {d} IS NOT NULL" for d in _DIMS)


@add("a28_strengths_weaknesses", P + f", dims AS ({_LONG}), st AS (SELECT *, avg(v) OVER (PARTITION BY id) AS m, max(v) OVER (PARTITION BY id) AS b FROM dims), s AS (SELECT id, list(k ORDER BY v DESC, k) AS strengths FROM st WHERE v > m GROUP BY id), w AS (SELECT id, list(k ORDER BY v, k) AS weaknesses FROM st WHERE v < b GROUP BY id) SELECT id, strengths[1:3] AS strengths, weaknesses[1:2] AS weaknesses FROM s JOIN w USING (id)")
def a28(spark, sf):
    scores = F.map_filter(F.create_map(*[x for d in _DIMS for x in (F.lit(d), F.col(d))]), lambda k, v: v.isNotNull())
    strong, weak = facets.above_and_below(scores)
    return photos(spark, sf).select("id", strong.alias("strengths"), weak.alias("weaknesses")).where("size(strengths) > 0 and size(weaknesses) > 0")


@add("a29_term_frequency", X + "SELECT term, count(*) AS n FROM (SELECT DISTINCT id, unnest(regexp_extract_all(lower(description), '([a-z]{6,})', 1)) AS term FROM texts WHERE category = 'en') GROUP BY term HAVING count(*) >= 10")
def a29(spark, sf):
    t = texts(spark, sf).where("category = 'en'")
    return facets.vocabulary(t, F.regexp_extract_all(F.lower("description"), F.lit("([a-z]{6,})"), 1), least=10)


@add("a30_term_coverage", X + "SELECT 'idiot' AS term, round(100.0 * avg(CASE WHEN regexp_matches(lower(description), '(^|[^\\w])idiot([^\\w]|$)') THEN 1.0 ELSE 0.0 END), 6) AS percent FROM texts UNION ALL SELECT 'with', round(100.0 * avg(CASE WHEN regexp_matches(lower(description), '(^|[^\\w])with([^\\w]|$)') THEN 1.0 ELSE 0.0 END), 6) FROM texts")
def a30(spark, sf):
    hits = texts(spark, sf).select(*[T.has_term("description", t).cast("double").alias(t) for t in ("idiot", "with")])
    return hits.agg(*[F.round(F.avg(t) * 100, 6).alias(t) for t in ("idiot", "with")]).selectExpr("stack(2, 'idiot', idiot, 'with', `with`) AS (term, percent)")


@add("a31_stacks", P + "SELECT stack_id, count(*) AS n, max(CASE WHEN id % 6 = 0 THEN id END) AS top_id FROM photos WHERE stack_id IS NOT NULL GROUP BY 1")
def a31(spark, sf):
    return photos(spark, sf).where("stack_id is not null").groupBy("stack_id").agg(F.count("*").alias("n"), F.max(F.when(F.col("id") % 6 == 0, F.col("id"))).alias("top_id"))


@add("a34_fingerprint", P + "SELECT count(*) AS n, max(id) AS max_id FROM photos")
def a34(spark, sf):
    from lightshelf.operators.upkeep import fingerprint

    return fingerprint(photos(spark, sf))


@add("a36_nested_rows", P + "SELECT user_id, array_to_string(list(concat(CAST(id AS VARCHAR), ':', coalesce(CAST(stack_id AS VARCHAR), '-')) ORDER BY id), ';') AS members FROM photos GROUP BY 1")
def a36(spark, sf):
    pair = F.struct("id", F.concat(F.col("id").cast("string"), F.lit(":"), F.coalesce(F.col("stack_id").cast("string"), F.lit("-"))).alias("s"))
    return photos(spark, sf).groupBy("user_id").agg(F.concat_ws(";", F.transform(F.array_sort(F.collect_list(pair)), lambda x: x["s"])).alias("members"))


_PCT = "CASE WHEN {n} = 1 THEN 50.0 ELSE round((rank() OVER ({o}) - 1 + (count(*) OVER ({s}) - 1) / 2.0 + 0.5) * CAST(100 AS DOUBLE) / {n}, 3) END"


@add("w05_percentile_overall", P + "SELECT id, " + _PCT.format(n="count(*) OVER ()", o="ORDER BY score", s="PARTITION BY score") + " AS pct FROM photos WHERE score IS NOT NULL UNION ALL SELECT id, NULL FROM photos WHERE score IS NULL")
def w05(spark, sf):
    return facets.percentile_overall(photos(spark, sf).select("id", "score"), "score", "pct").select("id", "pct")


@add("w06_percentile_by_day", P + "SELECT id, " + _PCT.format(n="count(*) OVER (PARTITION BY day)", o="PARTITION BY day ORDER BY score", s="PARTITION BY day, score") + " AS pct FROM photos WHERE score IS NOT NULL UNION ALL SELECT id, NULL FROM photos WHERE score IS NULL")
def w06(spark, sf):
    return facets.percentile_within(photos(spark, sf).select("id", "day", "score"), "score", ["day"], "pct").select("id", "pct")


# --- scalar functions -------------------------------------------------------


def scalar(name, expression, sql, source="photos"):
    """A function of each row: id and value, against its SQL."""
    add(name, with_library(source) + f"SELECT id, {sql} AS v FROM {source}")(lambda spark, sf: library(spark, sf, source).select("id", expression().alias("v")))


_HAV = "round(2 * 6371.0 * asin(sqrt(pow(sin(radians(40.5 - gps_lat) / 2), 2) + cos(radians(gps_lat)) * cos(radians(CAST(40.5 AS DOUBLE))) * pow(sin(radians(-119.5 - gps_lon) / 2), 2))), 6)"
scalar("h01_haversine", lambda: F.round(S.haversine_km("gps_lat", "gps_lon", F.lit(40.5), F.lit(-119.5)), 6), _HAV)
scalar("h02_box_area", lambda: F.round(S.box_area("gps_lat", F.col("gps_lat") + 0.5, "gps_lon", F.col("gps_lon") + 0.25), 6), "round((gps_lat + CAST(0.5 AS DOUBLE) - gps_lat) * (gps_lon + CAST(0.25 AS DOUBLE) - gps_lon), 6)")
scalar("h03_colour_round_trip", lambda: S.rgb_to_hex(*[S.hex_channel("colour", i) for i in range(3)]), "colour")
scalar("h04_parsed_time", lambda: F.date_format(S.parsed_time(F.replace("date_taken", F.lit(" "), F.lit("T"))), "yyyy-MM-dd HH:mm:ss"), "CASE WHEN date_taken LIKE '0000%' THEN NULL ELSE date_taken END")
scalar("h05_month_bucket", lambda: S.date_bucket("date_taken", "month"), "substr(date_taken, 1, 7)")
scalar("h06_folder_of", lambda: S.folder_of("filepath"), "folder")
scalar("h07_folder_date", lambda: S.effective_date(F.lit(None).cast("string"), F.lit(None).cast("string"), "filepath"), "day")
scalar("h08_hour_bucket", lambda: S.hour_bucket("taken_ts"), "strftime(date_trunc('hour', taken_ts), '%Y-%m-%dT%H:00:00')")
scalar("h09_seconds_between", lambda: F.round(S.seconds_between(F.lit("2024-01-01 00:00:00").cast("timestamp_ntz"), "taken_ts"), 6), "round((epoch_us(taken_ts) - epoch_us(TIMESTAMP '2024-01-01 00:00:00')) / CAST(1000000 AS DOUBLE), 6)")
scalar("h10_json_array", lambda: F.size(S.json_strings(F.when(F.col("id") % 3 == 0, F.concat(F.lit('["a","'), F.col("camera_model"), F.lit('"]'))).when(F.col("id") % 3 == 1, F.lit("[bad")))), "CAST(CASE WHEN id % 3 = 0 THEN 2 ELSE 0 END AS INT)")
scalar("h11_dms_degrees", lambda: S.dms_to_degrees(F.col("id") % 90, F.col("id") % 60, (F.col("id") % 60).cast("double"), F.when(F.col("id") % 2 == 0, "N").otherwise("S")), "round((CASE WHEN id % 2 = 0 THEN 1 ELSE -1 END) * (id % 90 + (id % 60) / CAST(60 AS DOUBLE) + CAST(id % 60 AS DOUBLE) / CAST(3600 AS DOUBLE)), 7)")
scalar("h12_oriented_width", lambda: S.oriented("image_width", "image_height", F.col("id") % 9)[0], "CASE WHEN id % 9 BETWEEN 5 AND 8 THEN image_height ELSE image_width END")
scalar("h14_archetype", lambda: F.concat_ws("/", S.archetype(F.col("id") % 6), F.round(S.aspect("image_width", "image_height"), 3).cast("string")), "concat_ws('/', CASE WHEN id % 6 <= 1 THEN 'single' WHEN id % 6 = 2 THEN 'pair' WHEN id % 6 = 3 THEN 'trio' WHEN id % 6 = 4 THEN 'grid' ELSE 'collage' END, CASE WHEN image_width = 4000 THEN '1.333' ELSE '0.75' END)")
scalar("h15_resolution_factor", lambda: S.resolution_factor(S.print_ppi("image_width", "image_height", 20.0, 15.0)), "CASE WHEN least(image_width / 20.0, image_height / 15.0) >= 200 THEN CAST(1.0 AS DOUBLE) WHEN least(image_width / 20.0, image_height / 15.0) >= 150 THEN CAST(0.9 AS DOUBLE) ELSE CAST(0.6 AS DOUBLE) END")
scalar("h16_score_coercion", lambda: S.score_1_to_10(F.concat(F.lit("score: "), (F.col("id") % 25 - 3).cast("string"), F.lit(" of 10"))), "CAST(greatest(1, least(10, id % 25 - 3)) AS DOUBLE)")
scalar("h19_content_terms", lambda: F.concat_ws(",", F.array_sort(T.content_terms("description", 5))), f"array_to_string(list_sort({_KEYWORDS}), ',')", "texts")
scalar("h20_whole_word", lambda: T.has_term("description", "with"), "regexp_matches(lower(description), '(^|[^\\w])with([^\\w]|$)')", "texts")
scalar("h23_numbered_copy", lambda: F.col("filename").rlike(r"(?i) \(\d+\)\.[a-z0-9]+$"), "id % 50 = 0")
scalar("h24_place_label", lambda: S.place_label("locality", "admin1", "country"), "concat_ws(', ', locality, admin1, country)")
scalar("t13_recency", lambda: F.round(S.recency(F.when(F.col("id") % 4 > 0, (F.col("id") % 20).cast("double"))), 9), "CASE WHEN id % 4 = 0 THEN CAST(0.5 AS DOUBLE) ELSE round(exp(-0.05 * (id % 20)), 9) END")
scalar("n12_folder_backfill", lambda: S.folder_of("filepath"), "folder")
scalar("n27_text_validity", lambda: T.is_description("description"), "len(list_filter(regexp_split_to_array(trim(description), '\\s+'), lambda w: w <> '')) >= 4 AND (NOT regexp_matches(description, '-?\\d+\\.\\d{3,}') OR len(list_filter(regexp_split_to_array(trim(regexp_replace(description, '-?\\d+\\.\\d+', ' ', 'g')), '\\s+'), lambda w: regexp_matches(w, '[A-Za-z]'))) >= 6)", "texts")
scalar("n35_controlled_list", lambda: F.concat_ws(",", T.controlled_list(F.concat("camera_model", F.lit(", VIEW., click,junk,"), "camera_model"), ["view", "click", "error"])), "CASE camera_model WHEN 'view' THEN 'view,click' WHEN 'click' THEN 'click,view' WHEN 'error' THEN 'error,view,click' ELSE 'view,click' END")
_WORDS = "list_filter(regexp_split_to_array(trim(lower(description)), '\\s+'), lambda w: w <> '')"
_RUNS = "list_max(map_values(list_aggregate(list_transform(range(1, len(w) - 4), lambda i: array_to_string(w[i:i + 5], ' ')), 'histogram')))"
_N26 = f"SELECT id, coalesce(len(w) > 350 OR (len(w) > 60 AND len(list_distinct(w)) / CAST(len(w) AS DOUBLE) < 0.45) OR (len(w) BETWEEN 6 AND 350 AND {_RUNS} >= 3) OR (length(t) - length(replace(t, '...', ''))) / CAST(3 AS DOUBLE) > 8, FALSE) AS v FROM (SELECT id, description AS t, {_WORDS} AS w FROM texts)"
REGISTRY.add("n26_degenerate_text", with_library("texts") + _N26)(lambda spark, sf: library(spark, sf, "texts").select("id", T.is_degenerate("description").alias("v")))
