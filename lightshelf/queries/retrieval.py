"""Hybrid retrieval: scorers, fusion, and whole searches."""

from __future__ import annotations

import datetime as dt
import uuid

from pyspark.sql import functions as F

from lightshelf.functions import text as T
from lightshelf.operators import ranking
from lightshelf.operators.lineage import shared_folder
from lightshelf.plans import operations, search
from lightshelf.queries import Registry, timeline
from lightshelf.sources.library import library, table, with_library
from lightshelf.sources.text_index import TextIndex, containing, description_scores, excluded

REGISTRY = Registry()
add = REGISTRY.add
P = with_library("photos")
X = with_library("texts")
_STOP = "(" + ", ".join(f"'{w}'" for w in sorted(T.STOP_WORDS) if len(w) >= 5) + ")"
_KEYWORDS = f"list_distinct(list_filter(regexp_extract_all(lower(description), '([a-z]+(?:-[a-z]+)*)', 1), lambda w: len(w) >= 5 AND w NOT IN {_STOP}))"


def texts(spark, sf):
    return library(spark, sf, "texts").withColumn("keywords", T.content_terms("description", 5))


@add("r03_rank_fusion", P + ", a AS (SELECT id, row_number() OVER (ORDER BY score DESC NULLS LAST, id) - 1 AS r FROM photos WHERE camera_model = 'click'), b AS (SELECT id, row_number() OVER (ORDER BY taken_ts, id) - 1 AS r FROM photos WHERE gps_lat IS NOT NULL) SELECT id, round(CAST(1 AS DOUBLE) / (60 + a.r) + CAST(1 AS DOUBLE) / (60 + b.r), 9) AS rrf FROM a JOIN b USING (id)")
def r03(spark, sf):
    p = library(spark, sf, "photos")
    a = ranking.ranked(p.where("camera_model = 'click'"), [F.col("score").desc_nulls_last(), F.col("id")])
    b = ranking.ranked(p.where("gps_lat is not null"), [F.col("taken_ts"), F.col("id")])
    return ranking.fused([a, b]).select("id", F.round("rrf", 9).alias("rrf"))


@add("r04_recency_decay", P + "SELECT id, CASE WHEN date_taken IS NULL OR date_taken LIKE '0000%' THEN CAST(0.5 AS DOUBLE) ELSE round(exp(-0.05 * ((epoch_us(TIMESTAMP '2026-01-01') - epoch_us(CAST(date_taken AS TIMESTAMP))) / CAST(31557600000000 AS DOUBLE))), 6) END AS weight FROM (SELECT id, nullif(date_taken, '0000-00-00 00:00:00') AS date_taken FROM photos)")
def r04(spark, sf):
    from lightshelf.functions import scalar as S

    years = S.seconds_between(S.parsed_time("date_taken"), F.lit("2026-01-01 00:00:00").cast("timestamp")) / (365.25 * 86400)
    return library(spark, sf, "photos").select("id", F.round(S.recency(years), 6).alias("weight"))


@add("r05_date_only_search", P + "SELECT id, date_taken FROM (SELECT id, date_taken, row_number() OVER (PARTITION BY coalesce(nullif(file_hash, ''), concat('id:', id)) ORDER BY date_taken DESC, id) AS rn FROM photos WHERE regexp_matches(date_taken, '^[0-9]{4}') AND date_taken NOT LIKE '0000%' AND substr(date_taken, 1, 10) BETWEEN '2024-01-10' AND '2024-01-12') WHERE rn = 1 ORDER BY date_taken DESC, id LIMIT 50")
def r05(spark, sf):
    return search.search(library(spark, sf, "photos"), search.SearchSpec(date_from="2024-01-10", date_to="2024-01-12")).select("id", "date_taken")


@add("r05_quality_only_search", P + "SELECT id, score FROM (SELECT id, score, row_number() OVER (PARTITION BY coalesce(nullif(file_hash, ''), concat('id:', id)) ORDER BY coalesce(score, -1) DESC, id) AS rn FROM photos WHERE coalesce(score, -1) >= 30) WHERE rn = 1 ORDER BY coalesce(score, -1) DESC, id LIMIT 50")
def r05q(spark, sf):
    return search.search(library(spark, sf, "photos"), search.SearchSpec(min_quality=30.0, sort="quality")).select("id", "score")


@add("r06_category_score", X + "SELECT id, CASE WHEN category = 'fr' THEN CAST(1.0 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END + CASE WHEN category IN ('de', 'es') THEN CAST(0.4 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END AS v FROM texts")
def r06(spark, sf):
    return library(spark, sf, "texts").select("id", search.category_score(F.array("category", "camera_model"), "fr", {"fr": ["de", "es"]}).alias("v"))


@add("r07_visual_score", X + "SELECT id, round(CASE WHEN category = 'en' THEN CAST(0.4 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END + CASE WHEN camera_model = 'src1' THEN CAST(0.4 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END, 6) AS v FROM texts")
def r07(spark, sf):
    return library(spark, sf, "texts").select("id", F.round(search.visual_score(F.array("category", "camera_model"), "en src1"), 6).alias("v"))


_STEM = "(w = 'thtion' OR (len(w) >= 4 AND abs(len(w) - 6) <= 2 AND (starts_with(w, 'thtion') OR starts_with('thtion', w))))"


@add("r08_keyword_score", X + f"SELECT id, round(list_sum(list_transform(list_append({_KEYWORDS}, ''), lambda w: CASE WHEN w = 'thtion' THEN CAST(1.2 AS DOUBLE) WHEN {_STEM} THEN CAST(0.6 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END)), 6) AS v FROM texts")
def r08(spark, sf):
    return texts(spark, sf).select("id", F.round(search.keyword_score("keywords", "thtion"), 6).alias("v"))


def _here(word: str) -> str:
    """SQL: whether the text t has the word, with no negation up to 30 characters before it (but for 'no other')."""
    parts = f"regexp_split_to_array(t, '\\b{word}\\b')"
    before = f"right(array_to_string(list_slice({parts}, 1, i), '{word}'), 60)"
    return f"len(list_filter(range(1, len({parts})), lambda i: NOT regexp_matches({before}, '\\b(no|without|absence of)\\b.{{0,30}}$') OR regexp_matches({before}, '\\bno other\\b.{{0,30}}$'))) > 0"


def _ruled_out(word: str) -> str:
    """SQL: whether the text t negates the word at once, not close behind 'no other'."""
    parts = f"regexp_split_to_array(t, '\\b(?:no visible |no |without |absence of ){word}')"
    return f"len(list_filter(range(1, len({parts})), lambda i: NOT regexp_matches({parts}[i], '\\bno other.{{0,9}}$'))) > 0"


@add("r09_description_score", X + f"SELECT id, CAST(CASE WHEN t = '' THEN 0 WHEN {_ruled_out('with')} OR {_ruled_out('thing')} THEN -0.04 WHEN {_here('with')} AND {_here('thing')} THEN 0.05 WHEN {_here('with')} OR {_here('thing')} THEN 0 ELSE -0.02 END AS DOUBLE) AS v FROM (SELECT id, lower(coalesce(description, '')) AS t FROM texts)")
def r09(spark, sf):
    return library(spark, sf, "texts").select("id", search.description_score("description", "with thing").alias("v"))


@add("r02_semantic_search")
def r02(spark, sf):
    e = table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    q = list(e.where("id = 1").first().embedding)
    docs = texts(spark, sf).join(e, "id", "left")
    return search.semantic(docs, "thtion", q, 50).select("id", F.round("semantic_score", 6).alias("score"), F.round("clip", 6).alias("clip"))


def indexed(spark, sf, fields):
    """An index over the texts in two batches, of which the second brings rows of the first again."""
    found = TextIndex(spark, f"{shared_folder(spark)}/texts-{uuid.uuid4().hex}")
    docs = library(spark, sf, "texts")
    old = docs.withColumn("description", F.when(F.col("id") % 5 == 0, F.lit("no idiot with nothing, src1")).otherwise(F.col("description")))
    found.add(old, fields, "000")
    found.add(docs.where("id % 5 = 0"), fields, "001")
    return found


@add("r09_indexed_scores", REGISTRY.sql["r09_description_score"])
def r09_indexed(spark, sf):
    """As `r09`, from postings."""
    return description_scores(indexed(spark, sf, ["description"]), "with thing").withColumnRenamed("score", "v")


@add("f18_indexed_exclusion", X + "SELECT id FROM texts WHERE regexp_matches(lower(description), '(^|[^\\w])(idiot|moron)([^\\w]|$)')")
def f18_indexed(spark, sf):
    """The rows that `f18` leaves out, from postings."""
    return excluded(indexed(spark, sf, ["description"]), ["idiot", "moron"])


@add("f19_indexed_words", X + "SELECT id FROM texts WHERE contains(lower(concat_ws(' ', description, category, camera_model)), 'src1') AND contains(lower(concat_ws(' ', description, category, camera_model)), 'the')")
def f19_indexed(spark, sf):
    """As `f19`, from the dictionary and postings."""
    return containing(indexed(spark, sf, ["description", "category", "camera_model"]), ["src1", "the"])


@add("r02_indexed_search")
def r02_indexed(spark, sf):
    """As `r02`, descriptions from postings."""
    e = table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    q = list(e.where("id = 1").first().embedding)
    docs = texts(spark, sf).join(e, "id", "left")
    found = search.semantic(docs, "thtion", q, 50, index=indexed(spark, sf, ["description"]))
    return found.select("id", F.round("semantic_score", 6).alias("score"), F.round("clip", 6).alias("clip"))


_SEEN = "CASE WHEN substr(date_taken, 1, 4) > '0000' THEN date_taken END"


@add("r01_hybrid_search", P + f"SELECT id, date_taken, camera_model, locality FROM (SELECT *, {_SEEN} AS v, row_number() OVER (PARTITION BY coalesce(nullif(file_hash, ''), concat('id:', id)) ORDER BY {_SEEN} DESC NULLS LAST, id) AS rn FROM photos WHERE camera_model = 'view' AND (contains(lower(place_name), 'town2') OR lower(locality) = 'town2') AND {_SEEN} IS NOT NULL AND substr(date_taken, 1, 10) BETWEEN '2024-01-01' AND '2024-01-31') WHERE rn = 1 ORDER BY v DESC, id LIMIT 40")
def r01(spark, sf):
    p = library(spark, sf, "photos").withColumn("embedding", F.lit(None).cast("array<float>")).withColumn("description", F.concat_ws(" ", "camera_model", "locality", "admin1"))
    spec = search.parsed(search.SearchSpec(query="view in town2 january 2024", sort="date_desc", limit=40, today=dt.date(2024, 2, 1)))
    return search.search(p, spec).select("id", "date_taken", "camera_model", "locality")


@add("r01_camera_place_search", P + ", a AS (SELECT id, row_number() OVER (ORDER BY date_taken ASC NULLS LAST, id) - 1 AS r FROM photos WHERE contains(lower(place_name), 'town2') OR lower(locality) = 'town2'), b AS (SELECT id, row_number() OVER (ORDER BY id) - 1 AS r FROM photos WHERE camera_model = 'click'), f AS (SELECT p.*, CAST(1 AS DOUBLE) / (60 + a.r) + CAST(1 AS DOUBLE) / (60 + b.r) AS rrf FROM photos p JOIN a USING (id) JOIN b USING (id)) SELECT id, round(CASE WHEN date_taken IS NULL OR date_taken LIKE '0000%' THEN rrf * 0.5 ELSE rrf END, 9) AS rrf FROM (SELECT *, row_number() OVER (PARTITION BY coalesce(nullif(file_hash, ''), concat('id:', id)) ORDER BY CASE WHEN date_taken IS NULL OR date_taken LIKE '0000%' THEN rrf * 0.5 ELSE rrf END DESC, id) AS rn FROM f) WHERE rn = 1 ORDER BY 2 DESC, id LIMIT 30")
def r01b(spark, sf):
    found = search.search(library(spark, sf, "photos"), search.SearchSpec(location="town2", camera="click", limit=30))
    return found.select("id", F.round("rrf", 9).alias("rrf"))


@add("r11_external_rerank", P + "SELECT p.id FROM (SELECT id, row_number() OVER (ORDER BY score DESC NULLS LAST, id) AS pos FROM photos ORDER BY score DESC NULLS LAST, id LIMIT 60) p LEFT JOIN (SELECT doc_id AS id, quality + toxic AS s FROM labels) l USING (id) ORDER BY s DESC NULLS LAST, pos LIMIT 20")
def r11(spark, sf):
    top = ranking.page(library(spark, sf, "photos"), [F.col("score").desc_nulls_last(), F.col("id")], 0, 60)
    placed = ranking.ranked(top, [F.col("score").desc_nulls_last(), F.col("id")], rank="pos")
    ext = table(spark, sf, "labels").select(F.col("doc_id").alias("id"), (F.col("quality") + F.col("toxic")).alias("s"))
    return placed.join(ext, "id", "left").orderBy(F.col("s").desc_nulls_last(), "pos").limit(20).select("id")


_MODES = {"flat": "o01_sort_quality", "daily": "t03_daily_highlights", "per_bucket": "w01_representatives_month", "chapters": "t01_chapters", "scenes": "t02_daily_scenes"}


def dispatch(spark, sf, mode="flat"):
    """The query of a browsing mode."""
    if mode not in _MODES:
        raise ValueError(f"unknown mode: {mode}")
    return timeline.REGISTRY.queries[_MODES[mode]](spark, sf)


@add("r12_dispatch_chapters", timeline.REGISTRY.sql["t01_chapters"])
def r12(spark, sf):
    return dispatch(spark, sf, "chapters")


# --- called by name -----------------------------------------------------------


def called(spark, sf) -> operations.Library:
    """The library as operations see it: persons are those of a third of the ids each, colours and tags follow from ids."""
    p = library(spark, sf, "photos")
    vectors = table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    photos = p.withColumns({
        "description": F.concat_ws(" ", "camera_model", "locality", "admin1"), "categories": F.array("camera_model", "locality"), "keywords": F.array("admin1", F.concat(F.lit("k"), (F.col("id") % 3).cast("string"))),
        "colours": F.array(F.when(F.col("id") % 4 == 0, "#0000ff").otherwise("#f00a0a"), F.lit("#00ff00")),
    }).join(vectors, "id", "left")
    faces = p.where("id % 7 <> 0").select(F.col("id").alias("photo_id"), (F.col("id") % 3).alias("person_id"))
    persons = spark.range(3).select(F.col("id").alias("person_id"), F.concat(F.lit("Person "), F.col("id").cast("string")).alias("name"))
    return operations.Library(photos, faces, persons)


_ALL_SETS = """, x AS (SELECT p.*, CAST(embedding AS DOUBLE[]) AS e FROM photos p LEFT JOIN embeddings ON vec_id = p.id),
d AS (SELECT *, 1 - list_distance(e, (SELECT e FROM x WHERE id = 1)) AS clip, CASE WHEN camera_model = 'view' THEN 0.6 * 0.05 + 1.5 + 1.2 * 0 ELSE 0.6 * -0.02 END AS rel FROM x),
m AS (SELECT *, camera_model = 'view' AS matched, CASE WHEN camera_model = 'view' THEN rel + coalesce(greatest(clip, 0), 0) ELSE clip + rel END AS s FROM d WHERE camera_model = 'view' OR clip IS NOT NULL),
t AS (SELECT id, row_number() OVER (ORDER BY s DESC, id) - 1 AS r FROM m WHERE matched OR (s >= -0.2 AND clip >= CASE WHEN (SELECT bool_or(matched) FROM m) THEN 0.15 ELSE -0.2 END)),
f AS (SELECT id, row_number() OVER (ORDER BY date_taken NULLS LAST, id) - 1 AS r FROM photos WHERE id % 7 <> 0 AND id % 3 = 1),
c AS (SELECT id, row_number() OVER (ORDER BY CASE WHEN id % 4 <> 0 THEN sqrt(200.0) ELSE 0 END, id) - 1 AS r FROM photos WHERE id % 4 <> 0),
g AS (SELECT id, row_number() OVER (ORDER BY id) - 1 AS r FROM photos WHERE locality IN ('town1') OR camera_model = 'town1'),
k AS (SELECT id, row_number() OVER (ORDER BY id) - 1 AS r FROM photos)
SELECT id, round(rrf, 9) AS rrf FROM (SELECT p.id, (CAST(1 AS DOUBLE) / (60 + t.r) + CAST(1 AS DOUBLE) / (60 + f.r) + CAST(1 AS DOUBLE) / (60 + c.r) + CAST(1 AS DOUBLE) / (60 + k.r)) * CASE WHEN substr(date_taken, 1, 4) > '0000' THEN 1 ELSE 0.5 END AS rrf, p.file_hash FROM photos p JOIN t USING (id) JOIN f USING (id) JOIN c USING (id) JOIN k USING (id))
QUALIFY row_number() OVER (PARTITION BY coalesce(nullif(file_hash, ''), concat('id:', id)) ORDER BY rrf DESC, id) = 1 ORDER BY rrf DESC, id LIMIT 100"""


@add("r01_all_sets_search", P.rstrip() + _ALL_SETS)
def r01_all(spark, sf):
    """Words, vector, person, colour and keyword in one search, called by name."""
    held = called(spark, sf)
    vector = [str(x) for x in table(spark, sf, "embeddings").where("vec_id = 1").first().embedding]
    tools = operations.library_operations()
    found = tools.call("search", {"query": "view", "vector": vector, "colour": "red", "keyword": "k", "limit": "100"}, {"people": ["person 1"]}, library=held)
    return found.select("id", F.round("rrf", 9).alias("rrf"))


@add("e02_called_summary", P + "SELECT locality AS bucket, count(*) AS n FROM photos WHERE camera_model = 'click' AND id % 7 <> 0 AND id % 3 = 2 AND coalesce(score, -1) >= 20 GROUP BY 1")
def e02_summary(spark, sf):
    return operations.library_operations().call("summary", {"by": "place", "camera": "click", "min_quality": "20", "people": "Person 2"}, library=called(spark, sf))


@add("t01_chapter_picks", timeline._greedy("concat(user_id, '-', chapter)", 900, 3, "stack_id").replace("FROM photos)", "FROM ch WHERE cn >= 3)").replace(", r AS MATERIALIZED", f", ch AS (SELECT *, count(*) OVER (PARTITION BY user_id, chapter) AS cn FROM ({timeline._CHAP.format(by='user_id', gap=timeline._GAP.format(by='user_id'), us=43200000000)})), r AS MATERIALIZED", 1) + " SELECT g AS chapter, id FROM f")
def t01_picks(spark, sf):
    """The three best of each chapter, a quarter of an hour apart."""
    arguments = {"gap_hours": 12, "min_photos": 3, "per_chapter": 3, "apart": 900}
    found = operations.browse(operations.library_operations(), called(spark, sf), "chapters", arguments)
    return found.select(F.concat_ws("-", F.col("user_id").cast("string"), F.col("chapter").cast("string")).alias("chapter"), "id")


@add("t02_scene_picks", timeline._greedy("concat(day, '-', scene)", 60, 2, "stack_id").replace("FROM photos)", "FROM ch)").replace(", r AS MATERIALIZED", f", ch AS (SELECT *, CAST(sum(new) OVER (PARTITION BY day ORDER BY taken_ts, id) AS BIGINT) AS scene FROM (SELECT *, CASE WHEN coalesce({timeline._GAP.format(by='day')} <= 300000000, FALSE) THEN 0 ELSE 1 END AS new FROM photos)), r AS MATERIALIZED", 1) + " SELECT g AS scene, id FROM f")
def t02_picks(spark, sf):
    """The two best of each scene of a day, a minute apart."""
    found = operations.browse(operations.library_operations(), called(spark, sf), "scenes", {"gap_minutes": 5, "per_scene": 2, "apart": 60})
    return found.select(F.concat_ws("-", "day", F.col("chapter").cast("string")).alias("scene"), "id")
