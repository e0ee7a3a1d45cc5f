"""Whole jobs: every row that a query is asked for, against brute force and SQL without cuts."""

import datetime as dt
import math
import random
import re

import pytest

duckdb = pytest.importorskip("duckdb")

from lightshelf.operators import people  # noqa: E402
from lightshelf.queries import every  # noqa: E402
from lightshelf.queries.curation import _PLACES  # noqa: E402
from lightshelf.sources import files  # noqa: E402
from lightshelf.sources.library import with_library  # noqa: E402
from tests.test_queries import SF, TABLES, rows  # noqa: E402

FOUND = every()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def km(a, b):
    (la, lo), (pa, po) = [[math.radians(x) for x in p] for p in (a, b)]
    h = math.sin((pa - la) / 2) ** 2 + math.cos(la) * math.cos(pa) * math.sin((po - lo) / 2) ** 2
    return 2 * 6371.0 * math.asin(math.sqrt(h))


def test_nearest_place_of_every_point(spark):
    rng = random.Random(3)
    places = [(f"p{i}", rng.uniform(-85, 85), rng.uniform(-180, 180)) for i in range(60)] + [("beyond", 60.0, 10.501), ("within", 60.49, 9.51), ("west", -10.0, -179.9)]
    points = [(i, rng.uniform(-90, 90), rng.uniform(-180, 180)) for i in range(150)] + [(150, 60.0, 9.999), (151, -10.0, 179.9), (152, 90.0, 0.0), (153, -90.0, 12.0), (154, 60.0, 9.999), (155, None, 1.0)]
    got = files.nearest_place(spark.createDataFrame(points, "id long, lat double, lon double"), spark.createDataFrame(places, "name string, lat double, lon double")).collect()
    assert sorted(r.id for r in got) == list(range(156))
    want = {i: min((km((la, lo), p[1:]), p[0]) for p in places) for i, la, lo in points if la is not None}
    for r in got:
        assert (r.place, r.km) == (None, None) if r.id == 155 else (r.place == want[r.id][1] and abs(r.km - want[r.id][0]) < 1e-6), r


def test_n14_nearest_place(spark, duck):
    sql = with_library("photos").rstrip() + f", {_PLACES} SELECT id, arg_min(name, (d, name)) AS place, round(min(d), 6) AS km FROM (SELECT id, name, round(2 * 6371.0 * asin(sqrt(pow(sin(radians(plat - gps_lat) / 2), 2) + cos(radians(gps_lat)) * cos(radians(plat)) * pow(sin(radians(plon - gps_lon) / 2), 2))), 9) AS d FROM photos, p WHERE place_name IS NULL AND gps_lat IS NOT NULL) GROUP BY id"
    assert rows(FOUND.queries["n14_nearest_place"](spark, SF).toPandas()) == rows(duck.execute(sql).df())


#: Restrictions to some ids that the SQL of these queries had once; tests/test_queries.py compares all rows.
ONCE = {
    "o01_sort_date_desc": ["user_id < 20"], "o01_sort_date_asc": ["user_id < 20"], "t14_overlap_days": ["user_id < 25"], "h27_interleave": ["user_id < 40"], "a36_nested_rows": ["user_id < 5"], "n23_photo_detail": ["photo_id < 200"],
    "n01_diagnose_faces": ["vec_id < 20"], "v14_sharper_alternatives": ["<= 200"], "t09_identity_in_time": ["event_id < 500", "user_id < 3"], "m18_review_selection": ["id < 50"], "n14_nearest_place": ["gps_lat > 1"], "r09_description_score": ["WHERE NOT"],
}


@pytest.mark.parametrize("name", sorted(ONCE))
def test_no_restriction_to_some_ids(name):
    assert not [c for c in ONCE[name] if c in FOUND.sql[name]]


def test_capped_scenes_of_all_users(spark, duck):
    got = FOUND.queries["t10_capped_scenes"](spark, SF).toPandas()
    want = duck.execute("SELECT user_id, greatest(count(DISTINCT day), least(20, sum(new))) AS n FROM (SELECT user_id, CAST(ts AS DATE) AS day, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id, CAST(ts AS DATE) ORDER BY ts, event_id) <= 2400000000 THEN 0 ELSE 1 END AS new FROM events) GROUP BY 1").df()
    assert got.groupby("user_id").size().to_dict() == dict(zip(want.user_id, want.n))


def test_identity_of_faces_without_a_photo(spark):
    d = spark.createDataFrame([(1, 7, 1.0), (2, 7, 1.0)], "face_id long, person_id long, distance double")
    f = spark.createDataFrame([(1, dt.datetime(2026, 1, 1, 10))], "face_id long, taken_ts timestamp")
    s = spark.createDataFrame([(7, dt.datetime(2026, 1, 2))], "person_id long, taken_ts timestamp")
    assert [r.face_id for r in people.match_in_time(d, f, s).collect()] == [2]


def description_score(text):
    """What r09 gives a text for 'with thing', by its rules read one by one."""
    if not text:
        return 0.0
    text, cues = text.lower(), r"\b(?:no|without|absence of)\b"

    def after(pattern, end, most):
        """Whether a match of the pattern ends at most so many characters, all of one line, before `end`."""
        return any(m.end() <= end and end - m.end() <= most and "\n" not in text[m.end() : end] for m in re.finditer(pattern, text, re.A))

    hits = 0
    for word in ("with", "thing"):
        for cue in ("no ", "no visible ", "without ", "absence of "):
            if any(not after(r"\bno other", m.start(), 9) for m in re.finditer(rf"\b{cue}{word}", text, re.A)):
                return -0.04
        found = [m.start() for m in re.finditer(rf"\b{word}\b", text, re.A)]
        hits += any(not after(cues, at, 30) or after(r"\bno other\b", at, 30) for at in found)
    return {0: -0.02, 1: 0.0, 2: 0.05}[hits]


def test_description_score_of_all_texts(spark, tmp_path):
    data = ["with a thing", "no thing here with it", "a room without things", "there is no other thing with it", "no one is with the thing", "with it. Not one single thing that anybody could have seen, then a thing", "nothing", "without\nwith thing", "no", "no chair. with", "", None]
    table = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in enumerate(data)], "doc_id long, text string, lang string, source string, n_chars long")
    table.write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.id: r.v for r in FOUND.queries["r09_description_score"](spark, str(tmp_path)).collect()}
    assert got == {i: description_score(t) for i, t in enumerate(data)}
    assert -0.04 in got.values() and len(set(got.values())) == 4
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()}
    assert {r.id: r.v for r in FOUND.queries["r09_description_score"](spark, SF).collect()} == {i: description_score(t) for i, t in texts.items()}
