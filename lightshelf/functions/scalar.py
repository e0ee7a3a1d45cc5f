"""Scalar functions on columns: geography, colour, dates, paths, JSON, boxes. All stay in generated code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_KM = 6371.0
#: A date at the start of a text, as a stored time has it.
DATE_START = "^[0-9]{4}-[0-9]{2}-[0-9]{2}"


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def haversine_km(lat1, lon1, lat2, lon2) -> Column:
    """Great-circle distance in km of two points in degrees."""
    lat1, lon1, lat2, lon2 = map(col, (lat1, lon1, lat2, lon2))
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return F.lit(2 * EARTH_KM) * F.asin(F.sqrt(a))


def padded_box(south, north, west, east, pad: float = 0.04) -> tuple[Column, Column, Column, Column]:
    return col(south) - pad, col(north) + pad, col(west) - pad, col(east) + pad


def box_area(south, north, west, east) -> Column:
    return (col(north) - col(south)) * (col(east) - col(west))


def hex_channel(c, i: int) -> Column:
    """Channel i (0 red, 1 green, 2 blue) of '#rrggbb'."""
    return F.conv(F.substring(col(c), 2 + 2 * i, 2), 16, 10).cast("double")


def rgb_to_hex(r, g, b) -> Column:
    return F.lower(F.concat(F.lit("#"), *[F.lpad(F.hex(col(x).cast("bigint")), 2, "0") for x in (r, g, b)]))


def colour_distance(a, b) -> Column:
    """Euclidean distance of two hex colours in RGB."""
    return F.sqrt(sum((F.pow(hex_channel(a, i) - hex_channel(b, i), 2) for i in range(3)), F.lit(0.0)))


def parsed_time(c) -> Column:
    """Timestamp of 'YYYY-MM-DD HH:MM:SS' or with a T; NULL for corrupt or missing ones."""
    return F.when(col(c).rlike(DATE_START), F.try_to_timestamp(col(c)))


def valid_date(c) -> Column:
    """A stored time that begins with a date whose month and day are in range; false for NULL."""
    c = col(c)
    month, day = F.substring(c, 6, 2).try_cast("int"), F.substring(c, 9, 2).try_cast("int")
    return F.coalesce(c.rlike(DATE_START) & month.between(1, 12) & day.between(1, 31) & (F.substring(c, 1, 4) > "0000"), F.lit(False))


def date_bucket(c, kind: str) -> Column:
    """Prefix of a stored time: year, month or day."""
    return F.substring(col(c), 1, {"year": 4, "month": 7, "day": 10}[kind])


def folder_of(path) -> Column:
    return F.regexp_replace(col(path), "/[^/]*$", "")


def folder_date(path) -> Column:
    """The date at the start of the innermost folder's name, or NULL if there is none or it is out of range."""
    found = F.regexp_extract(col(path), r"/(\d{4}-\d{2}-\d{2})[^/]*/[^/]+$", 1)
    return F.when(valid_date(found), found)


def effective_date(taken, created, path) -> Column:
    """The first of: time taken, time created, the folder's date."""
    return F.coalesce(col(taken), col(created), folder_date(path))


def hour_bucket(ts) -> Column:
    return F.date_format(F.date_trunc("hour", col(ts)), "yyyy-MM-dd'T'HH:00:00")


def micros(ts) -> Column:
    """Microseconds since 1970 of a timestamp, with or without time zone."""
    return F.unix_micros(col(ts).cast("timestamp"))


def seconds_between(a, b) -> Column:
    return (micros(b) - micros(a)) / 1e6


def json_strings(c) -> Column:
    """A JSON array of strings; an empty array for NULL, '' and anything malformed."""
    return F.coalesce(F.from_json(col(c), "array<string>"), F.array().cast("array<string>"))


def dms_to_degrees(degrees, minutes, seconds, hemisphere) -> Column:
    value = col(degrees) + col(minutes) / 60.0 + col(seconds) / 3600.0
    return F.round(F.when(col(hemisphere).isin("S", "W"), -value).otherwise(value), 7)


def oriented(width, height, orientation) -> tuple[Column, Column]:
    """Width and height as shown: orientations 5 to 8 lie on their side."""
    side = col(orientation).between(5, 8)
    return F.when(side, col(height)).otherwise(col(width)), F.when(side, col(width)).otherwise(col(height))


def face_area(top, right, bottom, left) -> Column:
    return (col(right) - col(left)) * (col(bottom) - col(top))


def prominence(area, width, height) -> Column:
    """Share of the picture that a face takes; NULL without the picture's size."""
    return col(area).cast("double") / F.nullif(col(width) * col(height), F.lit(0))


def min_or_null(a, b) -> Column:
    """The smaller of two values, NULL if either is (unlike `least`)."""
    return F.when(col(a).isNotNull() & col(b).isNotNull(), F.least(col(a), col(b)))


def aspect(width, height) -> Column:
    return col(width).cast("double") / F.nullif(col(height), F.lit(0))


def archetype(n) -> Column:
    """Kind of spread for a number of pictures."""
    n = col(n)
    return F.when(n <= 1, "single").when(n == 2, "pair").when(n == 3, "trio").when(n == 4, "grid").otherwise("collage")


def print_ppi(width, height, inches_w: float, inches_h: float) -> Column:
    """Pixels an inch when a picture fills a print of the given size."""
    return F.least(col(width) / F.lit(inches_w), col(height) / F.lit(inches_h))


def resolution_factor(ppi, good: float = 200.0, fair: float = 150.0) -> Column:
    return F.when(col(ppi) >= good, 1.0).when(col(ppi) >= fair, 0.9).otherwise(0.6)


def score_1_to_10(text) -> Column:
    """The first number of a reply, held within 1 to 10; NULL without one."""
    found = F.regexp_extract(col(text).cast("string"), r"(-?\d+(?:\.\d+)?)", 1).try_cast("double")
    return F.when(found.isNotNull(), F.greatest(F.lit(1.0), F.least(F.lit(10.0), found)))


def place_label(*parts) -> Column:
    """'name, admin, country' of the parts that are there and not blank."""
    return F.concat_ws(", ", *[F.nullif(F.trim(col(p)), F.lit("")) for p in parts])


def box_iou(a: str, b: str) -> Column:
    """Intersection over union of two boxes whose columns are `{a}.bbox_top` and so on."""
    side = lambda x, s: F.col(f"{x}.bbox_{s}").cast("double")
    wide = F.greatest(F.lit(0.0), F.least(side(a, "right"), side(b, "right")) - F.greatest(side(a, "left"), side(b, "left")))
    high = F.greatest(F.lit(0.0), F.least(side(a, "bottom"), side(b, "bottom")) - F.greatest(side(a, "top"), side(b, "top")))
    both = wide * high
    area = lambda x: (side(x, "right") - side(x, "left")) * (side(x, "bottom") - side(x, "top"))
    return both / F.nullif(area(a) + area(b) - both, F.lit(0.0))


def clamped(x, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), col(x)))


def recency(years) -> Column:
    """Weight of an age in years; half for the undated."""
    return F.when(col(years).isNull(), 0.5).otherwise(F.exp(col(years) * -0.05))


def rational(c) -> Column:
    """Value of 'num/den' or of a plain number."""
    parts = F.split(col(c), "/")
    return F.when(F.size(parts) == 2, parts[0].try_cast("double") / F.nullif(parts[1].try_cast("double"), F.lit(0.0))).otherwise(col(c).try_cast("double"))
