"""Files as rows: recursive scans, content tests, import plans, gazetteers, and sinks."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lightshelf.functions import scalar as S
from lightshelf.operators.lineage import written
from lightshelf.plans.vocabulary import EXTENSIONS

NUMBERED_COPY = r"(?i) \(\d+\)\.[a-z0-9]+$"


def scan(spark: SparkSession, folder: str, extensions: tuple[str, ...] = EXTENSIONS, excluded: tuple[str, ...] = (".thumbnails", "@eaDir"), copies: bool = True) -> DataFrame:
    """Files below a folder with their content: those of the extensions, not in excluded folders, no sidecars."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    name = F.regexp_extract("path", "([^/]+)$", 1)
    keep = F.lower(name).rlike("(" + "|".join(e.replace(".", r"\.") for e in extensions) + ")$") & ~F.startswith(name, F.lit("._"))
    for d in excluded:
        keep = keep & ~F.contains("path", F.lit(f"/{d}/"))
    if not copies:
        keep = keep & ~name.rlike(NUMBERED_COPY)
    return files.where(keep).withColumn("filename", name)


def is_image(content) -> Column:
    """Whether the first bytes are those of an image: JPEG, PNG, GIF, TIFF, WebP or HEIF."""
    head = F.hex(F.substring(S.col(content), 1, 12))
    starts = [F.startswith(head, F.lit(x)) for x in ("FFD8FF", "89504E470D0A1A0A", "47494638", "49492A00", "4D4D002A")]
    boxed = (F.startswith(head, F.lit("52494646")) & (F.substring(head, 17, 8) == "57454250")) | (F.substring(head, 9, 8) == "66747970")
    out = boxed
    for s in starts:
        out = out | s
    return F.coalesce(out, F.lit(False))


def content_hash(content) -> Column:
    return F.sha2(S.col(content), 256)


def import_plan(files: DataFrame, library: DataFrame, suffix: str = "import") -> DataFrame:
    """What an import does with each file (file_id, file_hash, day, filename): new, in the library, or repeated in the import.

    New files get a dated target; files of one target are numbered.
    """
    known = library.select("file_hash").where("file_hash is not null").distinct().withColumn("_known", F.lit(True))
    w = Window.partitionBy("file_hash").orderBy("file_id")
    rows = files.join(known, "file_hash", "left").withColumn("_rn", F.row_number().over(w))
    state = F.when(F.col("_known"), "in_library").when(F.col("file_hash").isNotNull() & (F.col("_rn") > 1), "repeated").otherwise("new")
    rows = rows.withColumn("state", state)
    folder = F.when(F.col("day").isNotNull(), F.concat(F.substring("day", 1, 4), F.lit("/"), F.col("day"), F.lit(f"_{suffix}"))).otherwise(F.lit(f"_undated/{suffix}"))
    rows = rows.withColumn("_target", F.when(F.col("state") == "new", F.concat(folder, F.lit("/"), F.col("filename"))))
    n = F.row_number().over(Window.partitionBy("_target").orderBy("file_id")) - 1
    stem, end = F.regexp_extract("_target", r"^(.*)(\.[^./]*)$", 1), F.regexp_extract("_target", r"^(.*)(\.[^./]*)$", 2)
    target = F.when(n == 0, F.col("_target")).otherwise(F.concat(stem, F.lit("_"), n.cast("string"), end))
    return rows.select("file_id", "file_hash", "state", F.when(F.col("state") == "new", target).alias("target"))


# The columns of a place file.
PLACE_COLUMNS = "geonameid string, name string, asciiname string, alternatenames string, lat double, lon double, feature_class string, feature_code string, country string, cc2 string, admin1_code string, admin2_code string"


def gazetteer(spark: SparkSession, places: str, admins: str, classes: tuple[str, ...] = ("P",), codes: tuple[str, ...] = (), counties: str | None = None) -> DataFrame:
    """A place file of tab-separated columns with the names of its administrative areas: name, lat, lon, country, admin1, admin2.

    Rows of the given feature classes (and codes, if any) stay.
    """
    raw = spark.read.csv(places, sep="\t", quote="", schema=PLACE_COLUMNS, enforceSchema=True)
    return with_areas(raw, _areas(spark, admins, "admin1"), None if counties is None else _areas(spark, counties, "admin2"), classes, codes)


def _areas(spark: SparkSession, path: str, name: str) -> DataFrame:
    return spark.read.csv(path, sep="\t", quote="", schema=f"code string, {name} string, ascii string, id string").select("code", name)


def with_areas(places: DataFrame, admins: DataFrame, counties: DataFrame | None = None, classes: tuple[str, ...] = ("P",), codes: tuple[str, ...] = ()) -> DataFrame:
    """Places of some feature classes with the names of their areas, by codes 'US.CA' and 'US.CA.037'."""
    rows = places.where(F.col("feature_class").isin(list(classes)))
    if codes:
        rows = rows.where(F.col("feature_code").isin(list(codes)))
    first = F.concat_ws(".", "country", "admin1_code")
    out = rows.withColumn("code", first).join(admins, "code", "left")
    if counties is None:
        out = out.withColumn("admin2", F.lit(None).cast("string"))
    else:
        out = out.withColumn("code", F.concat_ws(".", "country", "admin1_code", "admin2_code")).join(counties, "code", "left")
    return out.select("name", "lat", "lon", "country", "admin1", "admin2")


def nearest_place(points: DataFrame, places: DataFrame, cell: float = 0.5, id_col: str = "id") -> DataFrame:
    """For each point (id, lat, lon) the nearest place and its distance; NULL for points without coordinates.

    Distinct spots meet the places of their own and the neighbouring grid cells.
    A hit counts only if it is nearer than anything outside of these cells can
    be; other spots go on to cells of twice the size, at last to all places.
    """
    known = places.where("lat is not null and lon is not null").select("name", F.col("lat").alias("plat"), F.col("lon").alias("plon"))
    spots = points.where("lat is not null and lon is not null and not isnan(lat) and not isnan(lon)").select("lat", "lon").distinct()
    sure = None
    while True:
        every = cell >= 60
        # lat and lon are those of the spot; outside of the block either differs by a cell at least
        beyond = F.lit(S.EARTH_KM) * F.asin(F.cos(F.radians("lat")) * F.lit(math.sin(math.radians(cell))))
        hits = written(_in_block(spots, known, None if every else cell).withColumn("_sure", F.lit(every) | F.coalesce(F.col("p.km") < beyond - 1e-6, F.lit(False))))
        near = hits.where("_sure").select("lat", "lon", "p")
        sure = near if sure is None else sure.unionByName(near)
        spots = hits.where("not _sure").select("lat", "lon")
        if every or spots.isEmpty():
            break
        cell *= 2
    return points.select(id_col, "lat", "lon").join(sure, ["lat", "lon"], "left").select(id_col, F.col("p.name").alias("place"), F.col("p.km").alias("km"))


def _in_block(spots: DataFrame, known: DataFrame, cell: float | None) -> DataFrame:
    """Each spot (lat, lon) with its nearest place `p` (km, name) in its own and the neighbouring cells, or of all if no cell is given."""
    around = int(360 // cell) if cell else 1
    row = lambda c: F.floor(F.col(c) / cell) if cell else F.lit(0)
    column = lambda c: F.floor(F.pmod(F.col(c), F.lit(360.0)) / (360.0 / around)) % around if cell else F.lit(0)
    shift = F.array(*[F.lit(i) for i in ((-1, 0, 1) if cell else (0,))])
    spread = known.withColumn("_dx", F.explode(shift)).withColumn("_dy", F.explode(shift)).withColumn("_x", row("plat") + F.col("_dx")).withColumn("_y", F.pmod(column("plon") + F.col("_dy"), F.lit(around)))
    pairs = spots.withColumn("_x", row("lat")).withColumn("_y", column("lon")).join(spread, ["_x", "_y"], "left")
    d = F.round(S.haversine_km("lat", "lon", "plat", "plon"), 9)
    return pairs.groupBy("lat", "lon").agg(F.min(F.when(F.col("plat").isNotNull(), F.struct(d.alias("km"), "name"))).alias("p"))


# Tags of a file's metadata, in the order in which they count.
DATE_TAGS = ("EXIF DateTimeOriginal", "EXIF DateTimeDigitized", "Image DateTime")
WIDTH_TAGS, HEIGHT_TAGS = ("EXIF ExifImageWidth", "Image ImageWidth"), ("EXIF ExifImageLength", "Image ImageLength")


def exif_record(tags) -> dict[str, Column]:
    """Columns of a photo from a map of metadata tags to texts: dates, camera, exposure, size as shown, and place.

    Reading tags from bytes is left to the reader of the files; a tag that is
    not there or not in its form gives NULL.
    """
    t = S.col(tags)
    first = lambda names: F.coalesce(*[t[n] for n in names])
    width, height = first(WIDTH_TAGS).try_cast("int"), first(HEIGHT_TAGS).try_cast("int")
    turned = t["Image Orientation"]
    orientation = F.coalesce(turned.try_cast("int"), F.when(turned.rlike("90|270"), 6).otherwise(1))
    shown = S.oriented(width, height, F.when(width.isNotNull() & height.isNotNull(), orientation).otherwise(1))

    def degrees(name: str) -> Column:
        parts = F.transform(F.split(F.regexp_replace(t[f"GPS {name}"], r"[\[\]\s]", ""), ","), S.rational)
        return F.when(F.size(parts) == 3, S.dms_to_degrees(parts[0], parts[1], parts[2], F.coalesce(F.upper(F.trim(t[f"GPS {name}Ref"])), F.lit(""))))

    return {
        "date_taken": F.regexp_replace(first(DATE_TAGS), r"^([^:]*):([^:]*):", "$1-$2-"), "camera_make": F.trim(t["Image Make"]), "camera_model": F.trim(t["Image Model"]), "focal_length": t["EXIF FocalLength"],
        "exposure_time": t["EXIF ExposureTime"], "f_number": t["EXIF FNumber"], "iso": t["EXIF ISOSpeedRatings"].try_cast("int"), "image_width": shown[0], "image_height": shown[1], "gps_lat": degrees("GPSLatitude"), "gps_lon": degrees("GPSLongitude"),
    }


def created_from_files(photos: DataFrame, files: DataFrame) -> DataFrame:
    """id and date_created for photos without one, from the time at which the file at their path was changed.

    `files` has filepath and modified (as `scan` gives it, by _metadata.file_modification_time); photos without a file are left out.
    """
    times = files.groupBy("filepath").agg(F.max("modified").alias("modified"))
    return photos.where("date_created is null").select("id", "filepath").join(times, "filepath").select("id", F.date_format("modified", "yyyy-MM-dd HH:mm:ss").alias("date_created"))


def book_manifest(cells: DataFrame) -> DataFrame:
    """Each photo of a book once, in the order of its first place: book_id, photo_id, position."""
    first = cells.groupBy("book_id", "photo_id").agg(F.min("position").alias("first"))
    w = Window.partitionBy("book_id").orderBy("first", "photo_id")
    return first.select("book_id", "photo_id", F.row_number().over(w).alias("position"))


def not_uploaded(photos: DataFrame, ledger: DataFrame, album: str) -> DataFrame:
    return photos.join(ledger.where(F.col("album_id") == album).select("filepath"), "filepath", "left_anti")


def write_results(df: DataFrame, folder: str) -> None:
    """Rows as JSON lines, NULL fields left out."""
    df.write.mode("overwrite").option("ignoreNullFields", "true").json(folder)


def points(photos: DataFrame) -> DataFrame:
    """Compact points of photos with coordinates: id, lat, lon, year, place."""
    return photos.where("gps_lat is not null and gps_lon is not null").select("id", F.round("gps_lat", 6).alias("lat"), F.round("gps_lon", 6).alias("lon"), F.substring("date_taken", 1, 4).try_cast("int").alias("year"), F.col("place_name").alias("place"))
