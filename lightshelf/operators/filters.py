"""Filters of the library: a specification is compiled to one predicate and a few semi or anti joins.

Filters keep ids only when used as ranked sets; rows are joined once at the end
of a search (:mod:`lightshelf.plans.search`).
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lightshelf.functions import scalar as S


def contains(c, part: str) -> Column:
    """Substring whatever the case of ASCII letters; wildcards in `part` are plain characters."""
    return F.coalesce(F.contains(F.lower(S.col(c)), F.lit(part.lower())), F.lit(False))


def date_between(c, first: str | None, last: str | None) -> Column:
    """Whole days from first to last, both included; NULL and corrupt times are out."""
    day = F.substring(S.col(c), 1, 10)
    return S.valid_date(c) & (day >= (first or "0000-00-00")) & (day <= (last or "9999-12-31"))


def in_box(lat, lon, south: float, north: float, west: float, east: float, pad: float = 0.04) -> Column:
    s, n, w, e = (F.lit(x) for x in (south - pad, north + pad, west - pad, east + pad))
    return F.coalesce(S.col(lat).between(s, n) & S.col(lon).between(w, e), F.lit(False))


def at_location(name: str, code: str | None = None, place="place_name", parts: tuple[str, ...] = ("locality", "admin1", "country"), box: Column | None = None) -> Column:
    """A place by substring, its country code at the end, any structured part, or within a box."""
    hit = contains(place, name)
    if code:
        hit = hit | F.coalesce(F.endswith(S.col(place), F.lit(f", {code}")), F.lit(False)) | F.coalesce(F.col(parts[-1]) == code, F.lit(False))
    for p in parts:
        hit = hit | F.coalesce(F.lower(F.col(p)) == name.lower(), F.lit(False))
    return hit if box is None else hit | box


def has_member(c, value: str) -> Column:
    return F.coalesce(F.exists(S.col(c), lambda x: F.lower(x) == value.lower()), F.lit(False))


def has_member_part(c, part: str) -> Column:
    return F.coalesce(F.exists(S.col(c), lambda x: F.contains(F.lower(x), F.lit(part.lower()))), F.lit(False))


def at_least(c, floor: float, missing: float = -1.0) -> Column:
    return F.coalesce(S.col(c), F.lit(missing)) >= floor


def colour_within(palette, target: str, tolerance: float = 60.0) -> Column:
    """Whether the nearest colour of a palette is within `tolerance`."""
    return F.coalesce(F.array_min(F.transform(S.col(palette), lambda c: S.colour_distance(c, F.lit(target)))) <= tolerance, F.lit(False))


def all_words(words: list[str], *columns) -> Column:
    """All words somewhere in the columns together."""
    text = F.lower(F.concat_ws(" ", *[S.col(c) for c in columns]))
    hit = F.lit(True)
    for w in words:
        hit = hit & F.contains(text, F.lit(w.lower()))
    return hit


def bad_gps(lat="gps_lat", lon="gps_lon") -> Column:
    lat, lon = S.col(lat), S.col(lon)
    return F.coalesce(((lat == 0) & (lon == 0)) | ~lat.between(-90, 90) | ~lon.between(-180, 180), F.lit(False))


def at_zero(lat="gps_lat", lon="gps_lon") -> Column:
    """Coordinates of 0, 0, which stand for none; what lies out of range is not looked at."""
    return F.coalesce((S.col(lat) == 0) & (S.col(lon) == 0), F.lit(False))


def usable_face(det="det_score", least: float = 0.65, edge: int = 60) -> Column:
    """Detection score unknown or good, and the short side of the box long enough (unknown sides fail)."""
    short = S.min_or_null(F.col("bbox_bottom") - F.col("bbox_top"), F.col("bbox_right") - F.col("bbox_left"))
    return (F.col(det).isNull() | (F.col(det) >= least)) & F.coalesce(short >= edge, F.lit(False))


def with_person(photos: DataFrame, faces: DataFrame, person_id: int, source: str | None = None, key: str = "photo_id") -> DataFrame:
    """Photos with a face of the person (and of the match source, if given)."""
    hit = F.col("person_id") == person_id
    return photos.join(faces.where(hit & (F.col("match_source") == source) if source else hit).select(key), key, "left_semi")


def photos_of_all(faces: DataFrame, person_ids: list[int], key: str = "photo_id") -> DataFrame:
    """Ids of photos that show every one of the persons (relational division)."""
    return faces.where(F.col("person_id").isin(person_ids)).groupBy(key).agg(F.countDistinct("person_id").alias("n")).where(F.col("n") == len(set(person_ids))).select(key)


def with_all_persons(photos: DataFrame, faces: DataFrame, person_ids: list[int], key: str = "photo_id") -> DataFrame:
    return photos.join(photos_of_all(faces, person_ids, key), key, "left_semi")


def only_persons(photos: DataFrame, faces: DataFrame, person_ids: list[int], key: str = "photo_id") -> DataFrame:
    """Photos that show every one of the persons and have no further face."""
    counts = faces.groupBy(key).agg(F.count("*").alias("n")).where(F.col("n") == len(set(person_ids))).select(key)
    return with_all_persons(photos, faces, person_ids, key).join(counts, key, "left_semi")


def faces_in_frame(photos: DataFrame, faces: DataFrame, person_ids: list[int] | None = None, margin: float = 0.01, key: str = "photo_id") -> DataFrame:
    """Photos of known size without a (named) face within `margin` of an edge."""
    own = faces if person_ids is None else faces.where(F.col("person_id").isin(person_ids))
    sized = photos.where("width is not null and height is not null")
    cut = own.join(sized.select(key, "width", "height"), key).where(
        (F.col("bbox_left") < F.col("width") * margin) | (F.col("bbox_top") < F.col("height") * margin) | (F.col("bbox_right") > F.col("width") * (1 - margin)) | (F.col("bbox_bottom") > F.col("height") * (1 - margin))
    )
    return sized.join(cut.select(key), key, "left_anti")


def in_directory(path, directory: str) -> Column:
    return F.startswith(S.col(path), F.lit(directory.rstrip("/") + "/"))


def compact(df: DataFrame, columns: list[str], text: str | None = None, most: int = 240) -> DataFrame:
    """A few columns, a long text cut to `most` characters with an ellipsis."""
    if text is None:
        return df.select(*columns)
    short = F.when(F.length(text) > most, F.concat(F.rtrim(F.substring(text, 1, most - 1)), F.lit("…"))).otherwise(F.col(text))
    return df.select(*columns, short.alias(text))


@dataclass
class FilterSpec:
    """Structured filters; those that are None do not apply."""

    date_from: str | None = None
    date_to: str | None = None
    location: str | None = None
    country_code: str | None = None
    box: tuple[float, float, float, float] | None = None
    camera: str | None = None
    category: str | None = None
    keyword: str | None = None
    min_quality: float | None = None
    min_percentiles: dict[str, float] = field(default_factory=dict)
    directory: str | None = None
    person_ids: list[int] | None = None
    only_these: bool = False
    in_frame: bool = False


def apply_filters(photos: DataFrame, spec: FilterSpec, faces: DataFrame | None = None) -> DataFrame:
    """Photos that pass every filter of the specification, as one predicate and semi joins."""
    hit = F.lit(True)
    if spec.date_from or spec.date_to:
        hit = hit & date_between("date_taken", spec.date_from, spec.date_to)
    box = in_box("gps_lat", "gps_lon", *spec.box) if spec.box else None
    if spec.location:
        hit = hit & at_location(spec.location, spec.country_code, box=box)
    elif box is not None:
        hit = hit & box
    if spec.camera:
        hit = hit & F.coalesce(F.col("camera_model") == spec.camera, F.lit(False))
    if spec.category:
        hit = hit & has_member("categories", spec.category)
    if spec.keyword:
        hit = hit & has_member_part("keywords", spec.keyword)
    if spec.min_quality is not None:
        hit = hit & at_least("score", spec.min_quality)
    for c, floor in spec.min_percentiles.items():
        hit = hit & at_least(c, floor)
    if spec.directory:
        hit = hit & in_directory("filepath", spec.directory)
    out = photos.where(hit)
    if spec.person_ids and faces is not None:
        out = only_persons(out, faces, spec.person_ids) if spec.only_these else with_all_persons(out, faces, spec.person_ids)
        if spec.in_frame:
            out = faces_in_frame(out, faces, spec.person_ids)
    return out
