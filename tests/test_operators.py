"""Operators on small tables with known answers."""

import datetime as dt
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from lightshelf.functions import layout, replies
from lightshelf.functions import scalar as S
from lightshelf.functions import text as T
from lightshelf.operators import facets, filters, lineage, people, ranking, similar, timeline, upkeep
from lightshelf.plans import parse, search, tools
from lightshelf.sources import files
from lightshelf.streaming import activity

TODAY = dt.date(2026, 4, 15)


def one(df, expression):
    return df.select(expression.alias("v")).first().v


@pytest.fixture(scope="module")
def row(spark):
    return spark.range(1)


def times(spark, data, schema):
    return spark.createDataFrame(data, schema)


def test_percentiles(spark):
    df = spark.createDataFrame([(i, float(i)) for i in range(1, 6)], "id long, score double")
    got = {r.id: r.p for r in facets.percentile_overall(df, "score", "p").collect()}
    assert got == {1: 10.0, 2: 30.0, 3: 50.0, 4: 70.0, 5: 90.0}
    ties = spark.createDataFrame([(1, 2.0), (2, 2.0), (3, None)], "id long, score double")
    got = {r.id: r.p for r in facets.percentile_overall(ties, "score", "p").collect()}
    assert got[1] == got[2] == 50.0 and got[3] is None
    single = spark.createDataFrame([(1, 7.0)], "id long, score double")
    assert facets.percentile_overall(single, "score", "p").first().p == 50.0
    assert facets.percentile_overall(single.where("false"), "score", "p").count() == 0


def test_daily_highlights_window(spark):
    data = [(1, "a", dt.datetime(2026, 3, 13, 10, 0), 6.2), (2, "a", dt.datetime(2026, 3, 13, 10, 5), 5.4), (3, "a", dt.datetime(2026, 3, 13, 12, 0), 8.3), (4, "a", dt.datetime(2026, 3, 13, 14, 0), 7.0), (5, "a", dt.datetime(2026, 3, 13, 16, 0), 9.1)]
    df = spark.createDataFrame(data, "id long, day string, taken_ts timestamp, score double")
    keep = lambda **k: {r.id for r in ranking.keep_best_apart(df, ["day"], **k).collect()}
    assert keep(seconds=600) == {1, 3, 4, 5}
    assert keep(seconds=0) == {1, 2, 3, 4, 5}
    assert keep(seconds=600, n=2) == {3, 5}


def test_suppression_by_key_and_missing_time(spark):
    data = [(1, "a", None, 3.0, "h"), (2, "a", None, 2.0, "h"), (3, "a", None, 1.0, None), (4, "a", None, None, "")]
    df = spark.createDataFrame(data, "id long, day string, taken_ts timestamp, score double, file_hash string")
    assert {r.id for r in ranking.keep_best_apart(df, ["day"], 45, same=["file_hash"]).collect()} == {1, 3, 4}


def anchors(spark, data):
    rows = [(i, 1, dt.datetime(2026, 1, 1) + dt.timedelta(minutes=m), lat, lon) for i, (m, lat, lon) in enumerate(data)]
    return spark.createDataFrame(rows, "id long, user_id long, taken_ts timestamp, gps_lat double, gps_lon double")


def test_movement_guard_and_window_edge(spark):
    apart = anchors(spark, [(0, 47.6, -122.3), (30, None, None), (60, 45.5, -122.6)])
    assert timeline.infer_locations(apart, ["user_id"], 90.0).count() == 0
    assert timeline.infer_locations_cascade(apart, ["user_id"], 90.0).count() == 0
    edge = anchors(spark, [(0, 47.6, -122.3), (30, None, None)])
    assert timeline.infer_locations(edge, ["user_id"], 30.0).count() == 0


def test_cascade_confidence(spark):
    hops = anchors(spark, [(0, 47.6, -122.3), (10, None, None), (20, None, None), (30, None, None)])
    got = sorted(timeline.infer_locations_cascade(hops, ["user_id"], 30.0).collect(), key=lambda r: r.id)
    assert [r.hop for r in got] == [1, 2, 3]
    for k, r in enumerate(got, 1):
        assert r.confidence == pytest.approx((2 / 3 * 0.7) ** k)
    once = timeline.infer_locations(hops, ["user_id"], 30.0).collect()
    assert {r.id for r in once} == {1, 2}


def test_anchor_tie_goes_left(spark):
    tie = anchors(spark, [(0, 47.60, -122.30), (10, None, None), (20, 47.61, -122.31)])
    assert timeline.infer_locations(tie, ["user_id"], 30.0).first().source_id == 0


def test_burst_stack_and_span(spark):
    start = dt.datetime(2026, 1, 1)
    v = [1.0, 0.0]
    data = [(i, 1, start + dt.timedelta(seconds=4 * i), float(i), v) for i in range(5)] + [(9, 1, start + dt.timedelta(hours=3), 9.0, v), (10, 1, None, 1.0, v), (11, 1, start + dt.timedelta(hours=9), 1.0, None)]
    df = spark.createDataFrame(data, "id long, user_id long, taken_ts timestamp, score double, embedding array<double>")
    got = timeline.burst_stacks(df).collect()
    assert {r.id for r in got} == {0, 1, 2} and [r.id for r in got if r.is_top] == [2]  # the ten seconds end after the third
    assert timeline.burst_stacks(df.where("id >= 9")).count() == 0


def test_newest_first_with_undated(spark):
    df = spark.createDataFrame([(1, "2020-01-01 00:00:00"), (2, None), (3, "2024-01-01T00:00:00"), (4, "0000-00-00")], "id long, date_taken string")
    assert [r.id for r in df.orderBy(*ranking.sort_order("date_desc")).collect()] == [3, 1, 2, 4]
    assert [r.id for r in df.orderBy(*ranking.sort_order("date_asc")).collect()] == [1, 3, 2, 4]
    with pytest.raises(ValueError):
        ranking.sort_order("nothing")


def test_pages_are_consistent(spark):
    df = spark.range(50).select("id", (F.col("id") % 7).cast("double").alias("score"))
    order = ranking.sort_order("quality")
    parts = [r.id for o in (0, 20, 40) for r in ranking.page(df, order, o, 20).collect()]
    assert parts == [r.id for r in df.orderBy(*order).collect()]


def test_fusion_and_buckets(spark):
    a = spark.createDataFrame([(1, 0), (2, 1), (3, 2)], "id long, rank int")
    b = spark.createDataFrame([(3, 0), (1, 1)], "id long, rank int")
    got = {r.id: r.rrf for r in ranking.fused([a, b]).collect()}
    assert got == {1: pytest.approx(1 / 60 + 1 / 61), 3: pytest.approx(1 / 62 + 1 / 60)}
    df = spark.createDataFrame([(1, "x", 5.4), (2, "x", 6.2), (3, "y", 9.1)], "id long, b string, score double")
    assert [r.id for r in ranking.buckets_best_first(df, "b", "score", 1).collect()] == [3]
    assert [r.id for r in ranking.buckets_best_first(df, "b", "score", 50).collect()] == [3, 2, 1]


def test_layout_parts_and_seats(spark):
    df = spark.range(8).withColumn("s", F.lit(1))
    parts = ranking.even_parts(df, [F.col("id")], 3, ["s"]).groupBy("part").count().orderBy("part").collect()
    assert [r["count"] for r in parts] == [3, 3, 2]
    days = spark.createDataFrame([("a", 5), ("b", 3), ("c", 2)], "day string, n int")
    assert sum(r.seats for r in ranking.largest_remainder(days, "n", 7, "day").collect()) == 7


def test_dates():
    for text, want in {
        "last week": ("2026-04-06", "2026-04-12", ""), "march 13 2026": ("2026-03-13", "2026-03-13", ""), "sunset march 2026": ("2026-03-01", "2026-03-31", "sunset"),
        "2024": ("2024-01-01", "2024-12-31", ""), "march to may 2026": ("2026-03-01", "2026-05-31", ""), "sunset 2026-01 to 2026-03": ("2026-01-01", "2026-03-31", "sunset"), "beach last week": (None, None, "beach last week"), "this week": ("2026-04-13", "2026-04-19", ""), "this month": ("2026-04-01", "2026-04-30", ""), "this year": ("2026-01-01", "2026-12-31", ""),
    }.items():
        assert parse.dates(text, TODAY) == want


def test_query_parts():
    assert parse.location("birds in California") == ("California", "birds")
    assert parse.country_code("France") == "FR" and parse.country_code("xx") == "XX" and parse.country_code("Atlantis") is None
    assert parse.persons("Calvin and Ellie at the beach", {"Calvin": 1, "Ellie": 2}) == ([1, 2], "at the beach")
    assert parse.persons("beach -Calvin", {"Calvin": 1}) == ([], "beach -Calvin")
    assert parse.negations("beach no dogs") == ("beach", ["dogs"])
    assert "child" in parse.negations("beach -people")[1]
    assert parse.colour("red") == "#ff0000" and parse.colour("abcdef") == "#abcdef"
    assert parse.looks_like_file("DSC06241") and not parse.looks_like_file("sunset")
    assert parse.clamp("99", 1, 10, 3) == 10 and parse.clamp(None, 1, 10, 3) == 3 and parse.strings("a, ,b") == ["a", "b"] and parse.truthy("yes") and parse.number("x") is None


def test_scores_without_people(row):
    for text, want in {"An empty beach at dawn": 0.05, "There is no visible presence of people": 0.05, "Two kids on a beach": -0.04, "A person, no other people": -0.04, "A lighthouse": 0.02, "": 0.0}.items():
        assert one(row, search.description_score(F.lit(text), "no people", True)) == pytest.approx(want), text


def test_text_scores(row):
    assert one(row, search.description_score(F.lit("A bird on a branch"), "bird")) == pytest.approx(0.05)
    assert one(row, search.description_score(F.lit("A field without birds"), "bird")) == pytest.approx(-0.04)
    assert one(row, search.description_score(F.lit("Driftwood scattered around"), "cat")) == pytest.approx(-0.02)
    assert one(row, search.description_score(F.lit(None).cast("string"), "cat")) == 0
    assert one(row, search.keyword_score(F.array(F.lit("marmot burrow"), F.lit("arm")), "marmots")) == pytest.approx(0.6)
    assert one(row, search.category_score(F.array(F.lit("beach")), "beach")) == 1.0
    assert one(row, T.contains_excluded(F.lit("two dogs on grass"), ["dog"])) is False
    assert one(row, T.contains_excluded(F.lit("a horse on grass"), ["horses"])) is True
    assert one(row, T.contains_excluded(F.lit("a lawn, no visible dog here"), ["dog"])) is False


def test_scalars(row):
    assert one(row, S.haversine_km(F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(1.0))) == pytest.approx(111.19, abs=0.01)
    assert one(row, S.folder_date(F.lit("/a/2024-13-01_x/f.jpg"))) is None and one(row, S.folder_date(F.lit("/a/2024-11-01_x/f.jpg"))) == "2024-11-01"
    assert one(row, S.min_or_null(F.lit(1), F.lit(None).cast("int"))) is None
    assert one(row, S.rational(F.lit("28/10"))) == pytest.approx(2.8)
    assert one(row, S.score_1_to_10(F.lit("none"))) is None
    assert one(row, T.is_degenerate(F.lit("one two three four five six " * 3))) is True
    assert one(row, T.is_description(F.lit("too short"))) is False
    assert one(row, files.is_image(F.unhex(F.lit("FFD8FFE000104A46494600")))) is True and one(row, files.is_image(F.lit(None).cast("binary"))) is False


def test_filters_keep_null_out(spark):
    df = spark.createDataFrame([(1, None, None, None), (2, "2024-01-05 10:00:00", 0.0, 0.0), (3, "2024-01-05T23:59:59", 40.0, 1.0)], "id long, date_taken string, gps_lat double, gps_lon double")
    assert [r.id for r in df.where(filters.date_between("date_taken", "2024-01-05", "2024-01-05")).collect()] == [2, 3]
    assert [r.id for r in df.where(filters.bad_gps()).collect()] == [2]
    assert [r.id for r in df.where(filters.in_box("gps_lat", "gps_lon", 40, 40, 1, 1)).collect()] == [3]


def test_components_and_dbscan(spark):
    chain = spark.createDataFrame([(i, i + 1) for i in range(20)] + [(50, 51)], "a long, b long")
    got = {r.node: r.component for r in similar.connected(chain).collect()}
    assert all(got[i] == 0 for i in range(21)) and got[51] == 50
    points = spark.createDataFrame([(1, [0.0, 0.0]), (2, [0.1, 0.0]), (3, [0.2, 0.0]), (4, [9.0, 9.0]), (5, [0.4, 0.0])], "vec_id long, embedding array<double>")
    got = {r.id: r.cluster for r in similar.dbscan(points, similar.radius_pairs(points, 0.21), 3).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: None, 5: 1}
    assert similar.radius_pairs(points.where("false"), 1.0).count() == 0


def test_stacks_and_collections(spark):
    members = spark.createDataFrame([(1, 10, True, 1.0), (1, 11, False, 5.0), (1, 12, False, 3.0), (2, 20, True, 1.0), (2, 21, False, 1.0)], "stack_id long, photo_id long, is_top boolean, score double")
    new = spark.createDataFrame([(3, 10, True, 1.0), (3, 20, False, 1.0)], "stack_id long, photo_id long, is_top boolean, score double")
    got = {r.photo_id: (r.stack_id, r.is_top) for r in upkeep.stacks_created(members, new).collect()}
    assert got == {11: (1, True), 12: (1, False), 10: (3, True), 20: (3, False)}
    with pytest.raises(ValueError):
        upkeep.ordered([upkeep.Stage("a", None, None, ("b",)), upkeep.Stage("b", None, None, ("a",))])


def test_import_plan(spark):
    new = spark.createDataFrame([(1, "x", "2024-01-01", "a.jpg"), (2, "x", "2024-01-01", "b.jpg"), (3, "y", "2024-01-01", "a.jpg"), (4, "z", None, "a.jpg"), (5, "k", "2024-01-01", "c.jpg")], "file_id long, file_hash string, day string, filename string")
    library = spark.createDataFrame([("k",)], "file_hash string")
    got = {r.file_id: (r.state, r.target) for r in files.import_plan(new, library).collect()}
    assert got[1] == ("new", "2024/2024-01-01_import/a.jpg") and got[2][0] == "repeated" and got[3] == ("new", "2024/2024-01-01_import/a_1.jpg") and got[4] == ("new", "_undated/import/a.jpg") and got[5] == ("in_library", None)


def test_files_round_trip(spark, tmp_path):
    (tmp_path / "in" / "sub").mkdir(parents=True)
    (tmp_path / "in" / "sub" / "a.jpg").write_bytes(b"\xff\xd8\xff\xe0abc")
    (tmp_path / "in" / "._a.jpg").write_bytes(b"x")
    (tmp_path / "in" / "note.txt").write_text("x")
    found = files.scan(spark, str(tmp_path / "in")).select("filename", files.is_image("content").alias("ok"), files.content_hash("content").alias("h")).collect()
    assert [(r.filename, r.ok, len(r.h)) for r in found] == [("a.jpg", True, 64)]
    files.write_results(spark.createDataFrame([(1, None), (2, "x")], "id long, v string"), str(tmp_path / "out"))
    assert sorted(r.value for r in spark.read.text(str(tmp_path / "out")).collect()) == ['{"id":1}', '{"id":2,"v":"x"}']


def test_gazetteer(spark, tmp_path):
    line = "\t".join(["1", "Town", "Town", "", "40.0", "-120.0", "P", "PPL", "US", "", "CA", ""])
    (tmp_path / "p.txt").write_text(line + "\n" + line.replace("\tP\t", "\tT\t") + "\n")
    (tmp_path / "a.txt").write_text("US.CA\tCalifornia\tCalifornia\t5\n")
    got = files.gazetteer(spark, str(tmp_path / "p.txt"), str(tmp_path / "a.txt")).collect()
    assert [(r.name, r.admin1) for r in got] == [("Town", "California")]


def test_identity_in_time(spark):
    d = spark.createDataFrame([(1, 7, 1.0), (1, 8, 1.2), (2, 7, 1.0), (2, 8, 1.01), (3, 9, 1.0)], "face_id long, person_id long, distance double")
    f = spark.createDataFrame([(1, dt.datetime(2026, 1, 1, 10)), (2, None), (3, None)], "face_id long, taken_ts timestamp")
    s = spark.createDataFrame([(7, dt.datetime(2026, 1, 1, 10, 30))], "person_id long, taken_ts timestamp")
    assert {r.face_id for r in people.match_in_time(d, f, s).collect()} == {1, 3}
    late = spark.createDataFrame([(7, dt.datetime(2026, 1, 1, 10, 31))], "person_id long, taken_ts timestamp")
    assert {r.face_id for r in people.match_in_time(d, f, late).collect()} == {3}


def test_streaming_counts(spark):
    stream = spark.readStream.schema(spark.read.parquet("/root/testdata/sf0.001/events.parquet").schema).parquet("/root/testdata/sf0.001/events.parquet*")
    stream = stream.withColumn("ts", F.col("ts").cast("timestamp"))
    q = activity.hourly(stream).writeStream.format("memory").queryName("hourly_counts").outputMode("complete").start()
    try:
        q.processAllAvailable()
        n = spark.sql("SELECT sum(n) AS n FROM hourly_counts").first().n
    finally:
        q.stop()
    assert n == spark.read.parquet("/root/testdata/sf0.001/events.parquet").count()


def test_reply_scores(spark):
    import json

    full = {d: {p: k + 3 for k, p in enumerate(parts)} | {"critique": f"{d} {{x}}"} for d, parts in replies.PARTS.items()}
    half = json.loads(json.dumps(full))
    half["impact"]["wow"] = "N/A"
    odd = json.loads(json.dumps(full)) | {"style": {"mood": " calm ", "color": ""}, "style_tags": ["Blue", "blue ", ""]}
    odd["technical"]["sharpness"], odd["technical"]["exposure"] = "about 7.5", 99
    rows = [(1, f"```json\n{json.dumps(full)}\n``` done }}"), (2, json.dumps(half)), (3, json.dumps(odd)), (4, None), (5, "no"), (6, '{"technical": {')]
    got = {r.id: r.s for r in replies.scored_replies(spark.createDataFrame(rows, "id int, reply string"), "reply", "s").collect()}
    assert [k for k, s in got.items() if s is None] == [2, 4, 5, 6]
    assert got[1].dim_scores == {"technical": 4.5, "composition": 4.5, "impact": 4.0} and got[1].overall == 4.3 and got[1].critiques["impact"] == "impact {x}"
    assert got[3].sub_scores["sharpness"] == 7.5 and got[3].sub_scores["exposure"] == 10.0 and got[3].style == {"mood": "calm"} and got[3].style_tags == ["blue"]


def test_subject_boxes(spark):
    rows = [
        (1, '[{"bbox_2d": [0, 0, 50, 50], "label": "a"}, {"bbox_2d": [100, 200, 0, 0], "label": "b"}]'), (2, 'One: {"bbox": ["10", 20, 30.5, 40]} there'), (3, '{"bbox_2d": [-5, -5, 500, 500]}'), (4, '[{"bbox_2d": [5, 5, 5, 9]}, {"bbox_2d": [1, 2]}, 7]'),
        (5, "nothing"), (6, None), (7, '{"bbox_2d": ["x", 1, 2, 3]}'),
    ]
    got = {r.id: [(b.label, b.bbox, b.area_frac) for b in r.b] for r in spark.createDataFrame(rows, "id int, reply string").select("id", replies.subject_boxes("reply", F.lit(100), F.lit(200)).alias("b")).collect()}
    assert got[1] == [("b", [0.0, 0.0, 1.0, 1.0], 1.0), ("a", [0.0, 0.0, 0.5, 0.25], 0.125)]
    assert got[2] == [(None, [0.1, 0.1, 0.305, 0.2], 0.0205)] and got[3][0][1] == [0.0, 0.0, 1.0, 1.0] and got[4] == got[5] == got[6] == got[7] == []


def test_cells_do_not_overlap(spark):
    for r in spark.range(0, 14).select("id", layout.cells("id", 24.0, 12.0).alias("c")).collect():
        assert len(r.c) == max(1, r.id)
        for i, a in enumerate(r.c):
            assert a.x >= 0 and a.y >= 0 and a.x + a.w <= 24.0 + 1e-9 and a.y + a.h <= 12.0 + 1e-9
            assert all(a.x + a.w <= b.x + 1e-9 or b.x + b.w <= a.x + 1e-9 or a.y + a.h <= b.y + 1e-9 or b.y + b.h <= a.y + 1e-9 for b in r.c[i + 1 :])


def test_tools(spark):
    photos = spark.createDataFrame([(1, "a", 5.0), (2, "b", 7.0), (3, "a", 9.0)], "id long, place string, score double")
    held = tools.Tools()
    kinds = {"limit": {"type": "integer", "minimum": 1, "maximum": 2, "default": 2}, "place": {"type": "string"}, "people": {"type": "array"}, "best": {"type": "boolean", "default": False}, "mode": {"type": "string", "enum": ["flat", "daily"]}}

    def top(photos, limit, place=None, people=(), best=False, mode="flat"):
        rows = photos if place is None else photos.where(F.col("place") == place)
        return rows.orderBy(F.desc("score") if best else "id").limit(limit).withColumn("people", F.lit(",".join(people)))

    held.register(tools.Operation("top", "best photos", kinds, top))
    held.register(tools.Operation("clear", "drop all", {"id": {"type": "integer"}}, lambda photos, id: photos, required=("id",), writes=True))
    assert [r.id for r in held.call("top", {"limit": "99", "best": "yes", "other": 1}, photos=photos).collect()] == [3, 2]
    got = held.call("top", {"place": "b", "people": "Ann"}, {"place": "a", "people": ["Ann", "Ben"], "per_day": 3}, photos=photos).collect()
    assert [(r.id, r.people) for r in got] == [(1, "Ann,Ben"), (3, "Ann,Ben")]
    assert list(held.schemas()) == ["top"] and list(held.schemas(writes=True)) == ["top", "clear"] and held.schemas()["top"]["properties"] == kinds
    for bad in (("none", {}), ("clear", {}), ("top", {"mode": "x"})):
        with pytest.raises(ValueError):
            held.call(*bad, photos=photos)
    with pytest.raises(ValueError):
        held.register(tools.Operation("top", "", {}, top))


def test_ranks_of_ranges(spark):
    df = spark.range(500).select("id", F.when(F.col("id") % 9 != 0, (F.col("id") * 7919 % 101).cast("double")).alias("v")).repartition(7)
    order = [F.col("v").desc_nulls_last(), F.col("id")]
    got = {r.id: r["rank"] for r in ranking.ranked(df, order).collect()}
    assert got == {r.id: i for i, r in enumerate(df.orderBy(*order).collect())}
    assert ranking.ranked(df.where("false"), order).count() == 0


def test_average_linkage_against_all_pairs():
    rng = np.random.default_rng(5)
    for n, k in ((1, 1), (12, 3), (40, 7), (30, 12)):
        v = rng.normal(size=(n, 3))
        groups = [[i] for i in range(n)]
        while len(groups) > k:
            _, a, b = min((np.mean([np.linalg.norm(v[p] - v[q]) for p in x for q in y]), i, j) for i, x in enumerate(groups) for j, y in enumerate(groups) if i < j)
            groups[a] += groups.pop(b)
        got = similar.average_linkage(v, k)
        assert {frozenset(np.flatnonzero(got == c).tolist()) for c in set(got.tolist())} == {frozenset(g) for g in groups}


def test_references_in_blocks(spark, monkeypatch):
    rng = np.random.default_rng(6)
    rows = spark.createDataFrame([(i, rng.normal(size=4).tolist()) for i in range(60)], "vec_id long, embedding array<double>")
    refs = spark.createDataFrame([(i, rng.normal(size=4).tolist()) for i in range(9)], "person_id long, ref array<double>")
    few = {r.vec_id: r.person_id for r in similar.nearest_reference(rows, refs, 9.0).collect()}
    own = rows.withColumn("label", F.col("vec_id") % 3)
    sides = [similar.with_own_references(own, refs.withColumn("label", F.col("person_id") % 3), "label").select("vec_id", "ref")]
    pairs = sorted(map(tuple, sides[0].collect()))
    monkeypatch.setattr(similar, "BROADCAST_BYTES", 0)
    assert pairs == sorted(map(tuple, similar.with_own_references(own, refs.withColumn("label", F.col("person_id") % 3), "label").select("vec_id", "ref").collect())) and len(pairs) == 180
    assert few == {r.vec_id: r.person_id for r in similar.nearest_reference(rows, refs, 9.0).collect()} and len(few) == 60


def test_shared_folder_on_a_cluster():
    class Conf:
        def get(self, key, default=None):
            return default

    class Session:
        conf = Conf()
        sparkContext = type("C", (), {"master": "spark://host:7077", "getCheckpointDir": lambda self: None})()

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        lineage.shared_folder(Session())


def test_chain_of_centres(spark):
    rows = [(0, i, 10 - k, [x, 0.0]) for k, (i, x) in enumerate([(5, 0.0), (3, 9.0), (8, 1.0), (1, 4.0), (2, -1.5)])]
    df = spark.createDataFrame(rows, "scope int, id long, n int, centroid array<double>")
    got = similar.similarity_chain(df, ["scope"]).orderBy("place").collect()
    assert [r.id for r in got] == [5, 8, 2, 1, 3]  # from the largest group always the nearest that is left
    few = similar.similarity_chain(df, ["scope"], most=4).orderBy("place").collect()
    assert [r.id for r in few] == [5, 3, 8, 1, 2]  # by size


def test_running_centroids():
    import pandas as pd

    rows = pd.DataFrame({"id": [4, 1, 2, 3, 5], "embedding": [[1.1], [0.0], [0.5], [3.0], [0.9]]})
    got = similar.running_centroids(rows, 0.6)
    # 0 and 0.5 meet at 0.25, 1.1 is too far from there, 0.9 is nearer to 1.1 than to 0.25
    assert got.set_index("id").cluster.to_dict() == {1: 0, 2: 0, 3: 1, 4: 2, 5: 2}


def test_scenes_of_a_capped_book(spark):
    at = lambda h: dt.datetime(2024, 1, 1, h)
    rows = [(1, "a", 10, at(1)), (1, "a", 5, at(2)), (1, "a", 1, at(3)), (1, "b", 4, at(4)), (1, "b", 2, at(5)), (2, "a", 1, at(1))]
    df = spark.createDataFrame(rows, "user_id int, day string, n int, first_ts timestamp")
    got = sorted((r.user_id, r.place, r.day, r.n) for r in timeline.capped_scenes(df, ["user_id"], 3).collect())
    assert got == [(1, 1, "a", 10), (1, 2, "a", 5), (1, 3, "b", 4), (2, 1, "a", 1)]
    one = timeline.capped_scenes(df.where("user_id = 1"), ["user_id"], 1).collect()
    assert sorted((r.day, r.n) for r in one) == [("a", 10), ("b", 4)]  # a day keeps at least one


def test_best_apart_goes_on(spark):
    """The best rows all fall to the first one: rows far down the order must still be found."""
    base = dt.datetime(2024, 1, 1)
    rows = [(i, "x", base + dt.timedelta(seconds=i % 7), 1000.0 - i) for i in range(200)] + [(200 + k, "x", base + dt.timedelta(hours=k + 1), 1.0) for k in range(3)] + [(300, "y", None, None)]
    df = spark.createDataFrame(rows, "id long, g string, taken_ts timestamp, score double")
    got = {(r.g, r.id) for r in ranking.best_apart(df, ["g"], 60.0, 2).collect()}
    assert got == {(r.g, r.id) for r in ranking.keep_best_apart(df, ["g"], 60.0, 2).collect()} == {("x", 0), ("x", 200), ("y", 300)}


def test_culling_of_scopes(spark):
    rng = np.random.default_rng(3)
    rows = [(s, i + 1000 * s, float(rng.uniform(1, 10)), (rng.normal(size=3) + 9 * (i % 5)).tolist()) for s in (0, 1) for i in range(60)]
    df = spark.createDataFrame(rows, "scope int, id long, score double, embedding array<double>")
    out = similar.select_best(df, ["scope"], 0.2).toPandas()
    for s in (0, 1):
        part = out[(out.id >= 1000 * s) & (out.id < 1000 * s + 1000)]
        n, target = len(part), math.floor(len(part) * 0.2)
        assert n == 60 and target <= part.selected.sum() <= max(target + 2, math.floor(1.5 * target))
        for _, c in part.groupby("cluster"):
            order = c.sort_values(["score", "id"], ascending=[False, True])
            assert order.rank_in_cluster.tolist() == list(range(1, len(c) + 1))
            assert c.selected.sum() <= max(1, min(4, 1 + len(c) // 8))
        best = part[part.rank_in_cluster == 1]
        assert best[best.score >= 4.0].selected.mean() >= 0.5
