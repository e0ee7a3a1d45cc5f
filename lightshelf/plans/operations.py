"""The library's operations as they are called by name: browsing, searching, summaries, and what writes.

Each gets the library's tables as context (`Library`) and its arguments in the types of its parameters; filters that
several operations share are applied alike.  Operations that write give the table as it is afterwards.
"""

from __future__ import annotations

from dataclasses import dataclass
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lightshelf.functions import scalar as S
from lightshelf.operators import facets, filters, people, ranking, upkeep
from lightshelf.plans import parse, search
from lightshelf.plans.tools import Operation, Tools


@dataclass
class Library:
    """Tables of a library: photos (id, date_taken, taken_ts, ...), faces (photo_id, person_id), persons (person_id, name), collection (collection_id, photo_id, sort_order)."""

    photos: DataFrame
    faces: DataFrame | None = None
    persons: DataFrame | None = None
    collection: DataFrame | None = None


FILTERS: dict[str, dict[str, Any]] = {
    "camera": {"type": "string"}, "place": {"type": "string"}, "date_from": {"type": "string"}, "date_to": {"type": "string"}, "category": {"type": "string"}, "keyword": {"type": "string"},
    "min_quality": {"type": "number"}, "people": {"type": "array"},
}
LIMIT = {"type": "integer", "minimum": 1, "maximum": 500, "default": 50}
BUCKETS = {"month": 7, "day": 10, "year": 4}


def _ids_of(library: Library, names: list[str]) -> list[int]:
    """Ids of the persons of these names, as many as names are given at most; unknown names are an error."""
    if not names:
        return []
    wanted = [n.strip().lower() for n in names]
    found = {r["k"]: r["person_id"] for r in library.persons.where(F.lower("name").isin(wanted)).groupBy(F.lower("name").alias("k")).agg(F.min("person_id").alias("person_id")).collect()}
    missing = [n for n in wanted if n not in found]
    if missing:
        raise ValueError(f"unknown persons: {', '.join(missing)}")
    return [found[n] for n in wanted]


def scoped(library: Library, camera=None, place=None, date_from=None, date_to=None, category=None, keyword=None, min_quality=None, people=()) -> DataFrame:
    """Photos that pass the filters which several operations share."""
    ids = _ids_of(library, list(people))
    spec = filters.FilterSpec(date_from=date_from, date_to=date_to, location=place, country_code=parse.country_code(place) if place else None, camera=camera, category=category, keyword=keyword, min_quality=min_quality, person_ids=ids or None)
    faces = library.faces.withColumnRenamed("photo_id", "id") if ids else None
    rows = filters.apply_filters(library.photos, filters.FilterSpec(**{**spec.__dict__, "person_ids": None}))
    return rows.join(filters.photos_of_all(faces, ids, "id"), "id", "left_semi") if ids else rows


def chapter_picks(photos: DataFrame, by: list[str], seconds: float, least: int, per_chapter: int, apart: float, place: str | None = "place_name") -> DataFrame:
    """The best photos of each chapter (a run without a longer gap or a change of place, of at least `least` photos), none within `apart` seconds of a better one or of its stack."""
    runs = ranking.cut_at_gaps(photos, by, "taken_ts", seconds, "chapter", place)
    sizes = runs.groupBy(*by, "chapter").agg(F.count("*").alias("n")).where(F.col("n") >= least)
    held = runs.select(*by, "chapter", "id", "taken_ts", "score", "stack_id").join(sizes.select(*by, "chapter"), [*by, "chapter"])
    return ranking.best_apart(held, [*by, "chapter"], apart, per_chapter, same=["stack_id"])


def _overview(library: Library) -> DataFrame:
    valid = F.when(S.valid_date("date_taken"), F.col("date_taken"))
    return library.photos.agg(F.count("*").alias("n_photos"), F.count("gps_lat").alias("n_located"), F.count("score").alias("n_scored"), F.min(valid).alias("first_date"), F.max(valid).alias("last_date"))


def _people(library: Library, limit: int) -> DataFrame:
    return people.photo_counts(library.persons, library.faces).orderBy(F.desc("n_photos"), "person_id").limit(limit)


def _places(library: Library, limit: int) -> DataFrame:
    return facets.values_by_kind(library.photos, ["locality", "admin1", "country"], limit)


def _vocabulary(library: Library, field: str, least: int, limit: int) -> DataFrame:
    return facets.vocabulary(library.photos, F.col(field), least=least).orderBy(F.desc("n"), "term").limit(limit)


def _summary(library: Library, by: str, **kept) -> DataFrame:
    rows = scoped(library, **kept)
    if by in BUCKETS:
        return facets.counts_by(rows.where(S.valid_date("date_taken")), S.date_bucket("date_taken", by))
    return facets.counts_by(rows, F.col({"camera": "camera_model", "place": "locality"}[by]))


def _search(library: Library, query="", colour=None, vector=(), sort="relevance", limit=50, offset=0, **kept) -> DataFrame:
    spec = search.SearchSpec(
        query=query, vector=[float(x) for x in vector] or None, camera=kept.get("camera"), date_from=kept.get("date_from"), date_to=kept.get("date_to"), location=kept.get("place"), colour=colour, category=kept.get("category"), keyword=kept.get("keyword"),
        min_quality=kept.get("min_quality"), person_ids=_ids_of(library, list(kept.get("people", ()))), sort=sort, limit=limit, offset=offset,
    )
    return search.search(library.photos, spec, library.faces)


def _representatives(library: Library, bucket: str, per_bucket: int, **kept) -> DataFrame:
    rows = scoped(library, **kept).select(F.substring("day", 1, BUCKETS[bucket]).alias("bucket"), "id", "score")
    return ranking.top_per_group(rows, ["bucket"], [F.col("score").desc_nulls_last(), F.col("id")], per_bucket)


def _daily(library: Library, per_day: int, apart: float, **kept) -> DataFrame:
    rows = scoped(library, **kept).select("id", "day", "taken_ts", "score", "stack_id")
    return ranking.best_apart(rows, ["day"], apart, per_day, same=["stack_id"])


def _chapters(library: Library, gap_hours: float, min_photos: int, per_chapter: int, apart: float, **kept) -> DataFrame:
    return chapter_picks(scoped(library, **kept), ["user_id"], gap_hours * 3600, min_photos, per_chapter, apart)


def _scenes(library: Library, gap_minutes: float, per_scene: int, apart: float, **kept) -> DataFrame:
    return chapter_picks(scoped(library, **kept), ["day"], gap_minutes * 60, 1, per_scene, apart, None)


def _layout(library: Library, spreads: int, **kept) -> DataFrame:
    return ranking.even_parts(scoped(library, **kept).select("user_id", "id", "taken_ts"), [F.col("taken_ts"), F.col("id")], spreads, ["user_id"], "spread")


def _photo(library: Library, id: int) -> DataFrame:
    return library.photos.where(F.col("id") == id)


def _written_location(library: Library, ids: list[str], lat: float, lon: float, overwrite: bool) -> DataFrame:
    writes = library.photos.where(F.col("id").cast("string").isin(ids)).select("id", F.lit(lat).alias("lat"), F.lit(lon).alias("lon"))
    return upkeep.located(library.photos, writes, overwrite)


def _written_tags(library: Library, ids: list[str], tags: list[str], replace: bool) -> DataFrame:
    new = upkeep.tags_added("keywords", F.array(*[F.lit(t) for t in tags]).cast("array<string>"), replace)
    return library.photos.withColumn("keywords", F.when(F.col("id").cast("string").isin(ids), new).otherwise(F.col("keywords")))


def _collected(library: Library, collection: int, ids: list[str]) -> DataFrame:
    new = library.photos.where(F.col("id").cast("string").isin(ids)).select(F.lit(collection).cast("bigint").alias("collection_id"), F.col("id").alias("photo_id"))
    return upkeep.appended(library.collection, new)


_APART = {"type": "number", "default": 600.0}
_IDS = {"type": "array"}
#: Modes of browsing and the operations that they stand for.
MODES = {"flat": "search", "daily": "daily_highlights", "per_bucket": "representatives", "chapters": "chapters", "scenes": "scenes"}


def library_operations() -> Tools:
    """All operations of the library."""
    tools = Tools()
    add = lambda name, text, kinds, run, **more: tools.register(Operation(name, text, kinds, run, **more))
    add("overview", "How many photos there are, and what is known of them.", {}, _overview, filters=False)
    add("people", "Persons by number of photos.", {"limit": LIMIT}, _people, filters=False)
    add("places", "The most frequent places of each kind.", {"limit": LIMIT}, _places, filters=False)
    add("vocabulary", "Terms of a field by frequency.", {"field": {"type": "string", "enum": ["keywords", "categories"], "default": "keywords"}, "least": {"type": "integer", "minimum": 1, "default": 1}, "limit": LIMIT}, _vocabulary, filters=False)
    add("summary", "Numbers of photos by year, month, day, camera or place.", {"by": {"type": "string", "enum": [*BUCKETS, "camera", "place"], "default": "month"}, **FILTERS}, _summary)
    add("search", "Photos by words, vector, colour and filters.", {"query": {"type": "string", "default": ""}, "colour": {"type": "string"}, "vector": {"type": "array"}, "sort": {"type": "string", "enum": ["relevance", "date_desc", "date_asc", "quality"], "default": "relevance"}, "limit": LIMIT, "offset": {"type": "integer", "minimum": 0, "default": 0}, **FILTERS}, _search)
    add("representatives", "The best photos of each year, month or day.", {"bucket": {"type": "string", "enum": list(BUCKETS), "default": "month"}, "per_bucket": {"type": "integer", "minimum": 1, "maximum": 50, "default": 3}, **FILTERS}, _representatives)
    add("daily_highlights", "The best photos of each day, none close to a better one.", {"per_day": {"type": "integer", "minimum": 1, "maximum": 50, "default": 10}, "apart": _APART, **FILTERS}, _daily)
    add("chapters", "The best photos of each chapter of a user's photos.", {"gap_hours": {"type": "number", "default": 12.0}, "min_photos": {"type": "integer", "minimum": 1, "default": 8}, "per_chapter": {"type": "integer", "minimum": 1, "maximum": 20, "default": 3}, "apart": _APART, **FILTERS}, _chapters)
    add("scenes", "The best photos of each scene of a day.", {"gap_minutes": {"type": "number", "default": 40.0}, "per_scene": {"type": "integer", "minimum": 1, "maximum": 20, "default": 1}, "apart": _APART, **FILTERS}, _scenes)
    add("layout", "Photos in order of time, dealt to spreads.", {"spreads": {"type": "integer", "minimum": 1, "default": 10}, **FILTERS}, _layout)
    add("photo", "One photo.", {"id": {"type": "integer"}}, _photo, filters=False, required=("id",))
    add("write_location", "Coordinates for photos without them, or for all that are named.", {"ids": _IDS, "lat": {"type": "number"}, "lon": {"type": "number"}, "overwrite": {"type": "boolean", "default": False}}, _written_location, filters=False, required=("ids", "lat", "lon"), writes=True)
    add("write_tags", "Keywords added to photos, or put in place of theirs.", {"ids": _IDS, "tags": {"type": "array"}, "replace": {"type": "boolean", "default": False}}, _written_tags, filters=False, required=("ids", "tags"), writes=True)
    add("add_to_collection", "Photos put behind the last of a collection.", {"collection": {"type": "integer"}, "ids": _IDS}, _collected, filters=False, required=("collection", "ids"), writes=True)
    return tools


def browse(tools: Tools, library: Library, mode: str, arguments: dict[str, Any], pinned: dict[str, Any] | None = None) -> DataFrame:
    """The operation of a browsing mode."""
    if mode not in MODES:
        raise ValueError(f"unknown mode: {mode}")
    return tools.call(MODES[mode], arguments, pinned, library=library)
