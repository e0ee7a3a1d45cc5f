"""The media library's tables, derived from the test tables by expressions that Spark and DuckDB read alike.

`photos` come from events, `faces` from lineitem, `face_photos` from orders,
`persons` from supplier, `texts` from documents, `vectors` from embeddings,
`generations` from conversations.  Each is a projection (with pushed-down
columns), so a query reads only what it needs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

_DAY = "CAST(CAST(ts AS DATE) AS STRING)"
_FOLDER = f"concat('/lib/', substr({_DAY}, 1, 4), '/', {_DAY}, '_u', CAST(user_id AS STRING))"
_FILE = "concat('IMG_', lpad(CAST(event_id AS STRING), 6, '0'), CASE WHEN event_id % 50 = 0 THEN ' (1)' ELSE '' END, '.jpg')"
_LOCALITY = "concat('town', CAST(user_id % 23 AS STRING))"
_ADMIN = "concat('state', CAST(user_id % 7 AS STRING))"
_COUNTRY = "CASE user_id % 3 WHEN 0 THEN 'FR' WHEN 1 THEN 'US' ELSE 'DE' END"

PHOTOS = {
    "id": "event_id", "taken_ts": "ts", "day": _DAY, "user_id": "user_id",
    "date_taken": "CASE WHEN event_id % 97 = 0 THEN NULL WHEN event_id % 89 = 0 THEN '0000-00-00 00:00:00' ELSE CAST(date_trunc('second', ts) AS STRING) END",
    "camera_model": "event_type", "camera_make": "upper(substr(event_type, 1, 1))", "folder": _FOLDER, "filename": _FILE, "filepath": f"concat({_FOLDER}, '/', {_FILE})",
    "file_hash": "CASE WHEN event_id % 101 = 0 THEN NULL ELSE md5(CAST(CASE WHEN event_id % 10 = 1 THEN event_id - 1 ELSE event_id END AS STRING)) END",
    "score": "CASE WHEN event_id % 11 = 0 THEN NULL ELSE value END",
    "aes_technical": "CASE WHEN event_id % 13 = 0 THEN NULL ELSE value END", "aes_composition": "CASE WHEN event_id % 7 = 0 THEN NULL ELSE CAST(event_id % 100 AS DOUBLE) END", "aes_impact": "CASE WHEN event_id % 5 = 0 THEN NULL ELSE CAST(user_id % 50 AS DOUBLE) END",
    "gps_lat": "CASE WHEN event_id % 3 = 0 THEN CAST(40 AS DOUBLE) + user_id * CAST(0.01 AS DOUBLE) + event_id * CAST(0.00001 AS DOUBLE) WHEN event_id % 211 = 1 THEN CAST(0 AS DOUBLE) END",
    "gps_lon": "CASE WHEN event_id % 3 = 0 THEN CAST(-120 AS DOUBLE) + (user_id % 7) * CAST(0.1 AS DOUBLE) WHEN event_id % 211 = 1 THEN CAST(0 AS DOUBLE) END",
    "locality": _LOCALITY, "admin1": _ADMIN, "country": f"CASE WHEN event_id % 17 = 0 THEN NULL ELSE {_COUNTRY} END", "place_name": f"CASE WHEN event_id % 19 = 0 THEN NULL ELSE concat({_LOCALITY}, ', ', {_ADMIN}, ', ', {_COUNTRY}) END",
    "image_width": "CASE WHEN event_id % 4 = 0 THEN 3000 ELSE 4000 END", "image_height": "CASE WHEN event_id % 4 = 0 THEN 4000 ELSE 3000 END",
    "colour": "concat('#', substr(md5(CAST(event_id AS STRING)), 1, 6))", "colour2": "concat('#', substr(md5(CAST(event_id AS STRING)), 7, 6))",
    "stack_id": "CASE WHEN event_id % 6 < 2 THEN CAST(floor(event_id / 6) AS BIGINT) END", "props": "props",
}
FACES = {
    "face_id": "l_orderkey * 10000000000000 + l_linenumber * 1000000000000 + l_partkey * 10000000 + l_suppkey * 1000 + CAST(l_quantity AS BIGINT)", "photo_id": "l_orderkey",
    "person_id": "CASE WHEN l_partkey % 4 = 0 THEN NULL ELSE l_suppkey END", "cluster_id": "CASE WHEN l_partkey % 4 = 0 THEN l_partkey % 50 END",
    "match_source": "CASE l_returnflag WHEN 'A' THEN 'strict' WHEN 'N' THEN 'temporal' ELSE 'manual' END", "det_score": "l_quantity / 50",
    "bbox_top": "CAST(l_partkey % 900 AS INT)", "bbox_left": "CAST(l_suppkey % 70 * 13 AS INT)", "bbox_bottom": "CAST(l_partkey % 900 + 40 + l_linenumber * 37 AS INT)", "bbox_right": "CAST(l_suppkey % 70 * 13 + 30 + l_quantity * 4 AS INT)",
    "area": "l_extendedprice",
}
FACE_PHOTOS = {"photo_id": "o_orderkey", "day": "CAST(CAST(o_orderdate AS DATE) AS STRING)", "taken_ts": "o_orderdate", "score": "o_totalprice", "camera_model": "o_orderpriority", "status": "o_orderstatus", "owner_id": "o_custkey", "width": "1000", "height": "1400"}
PERSONS = {"person_id": "s_suppkey", "name": "s_name", "nation_id": "s_nationkey"}
TEXTS = {
    "id": "doc_id", "description": "text", "category": "lang", "camera_model": "source", "file_hash": "md5(text)", "n_chars": "n_chars",
    "colour": "concat('#', substr(md5(text), 1, 6))",
}

#: What is left of `face_id` without its order, and the id in Spark: the SQL's number, wrapped to 64 bits where that
#: number needs more (orders from 922,337 on, for which the SQL has none). 10^13 is 5^13 * 2^13: the shift wraps, and
#: the 51 bits before it are summed from two parts of the order, so that no 64-bit order overflows.
_FACE_REST = "(l_linenumber * 1000000000000 + l_partkey * 10000000 + l_suppkey * 1000 + CAST(l_quantity AS BIGINT))"
_ORDER_LOW = "(l_orderkey & 16777215) * 1220703125"
_ORDER_HIGH = "shiftleft(((shiftright(l_orderkey, 24) & 134217727) * 1220703125) & 134217727, 24)"
SPARK_ONLY = {"faces": {"face_id": f"shiftleft({_ORDER_LOW} + {_ORDER_HIGH} + shiftright({_FACE_REST}, 13), 13) | ({_FACE_REST} & 8191)"}}

TABLES = {"photos": ("events", PHOTOS), "faces": ("lineitem", FACES), "face_photos": ("orders", FACE_PHOTOS), "persons": ("supplier", PERSONS), "texts": ("documents", TEXTS)}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A test table as it is."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def library(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the media library."""
    source, columns = TABLES[name]
    columns = columns | SPARK_ONLY.get(name, {})
    return table(spark, sf_dir, source).selectExpr(*[f"{e} AS {c}" for c, e in columns.items()])


def with_library(*names: str) -> str:
    """The start of a DuckDB query in which the library's tables of these names exist."""
    parts = [f"{n} AS (SELECT {', '.join(f'{e} AS {c}' for c, e in TABLES[n][1].items())} FROM {TABLES[n][0]})" for n in names]
    return "WITH " + ", ".join(parts) + " "
