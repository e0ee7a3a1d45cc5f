"""Radius graphs, density clusters, linkage, inspection and scans in parts, against brute force."""

import datetime as dt
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from lightshelf.operators import facets, inspection, linkage, radius, ranking, scans, similar, timeline
from lightshelf.plans import operations

VECTORS = "vec_id long, g string, embedding array<float>, x int, block string"


def clumps(n_clumps, each, dims=8, spread=0.01, seed=1):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(n_clumps, dims))
    return (np.repeat(centres, each, 0) + rng.normal(size=(n_clumps * each, dims)) * spread).astype(np.float32)


def frame(spark, x, groups=None):
    rows = [(i, None if groups is None else groups[i], None if v is None else [float(a) for a in v], 1, "b") for i, v in enumerate(x)]
    return spark.createDataFrame(rows, VECTORS).repartition(3)


def brute_pairs(x, r, groups=None):
    x = np.asarray(x, np.float64)
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    return {(i, j) for i in range(len(x)) for j in range(i + 1, len(x)) if d[i, j] <= r and (groups is None or groups[i] == groups[j])}


def brute_density(x, r, least, groups=None):
    near = {i: {i} for i in range(len(x))}
    for i, j in brute_pairs(x, r, groups):
        near[i].add(j)
        near[j].add(i)
    core = {i for i in near if len(near[i]) >= least}
    label = {}
    for i in sorted(core):
        if i not in label:
            todo = [i]
            while todo:
                k = todo.pop()
                if k not in label:
                    label[k] = i
                    todo += near[k] & core
    return [label[i] if i in core else min((label[j] for j in near[i] & core), default=None) for i in near]


@pytest.mark.parametrize("numbers", [1 << 19, 8 * 16])
def test_radius_graph_skips_blocks_and_loses_nothing(spark, numbers):
    x = clumps(12, 25)
    packed = radius.packed_blocks(frame(spark, x), block_numbers=numbers)
    for r in (0.0, 0.03, 0.05, 3.0):
        got = radius.pairs_within(packed, r).toPandas()
        assert set(zip(got.a, got.b)) == brute_pairs(x, r) and len(got) == len(brute_pairs(x, r))
    if numbers < 1000:
        assert radius.compared_share(packed, 0.05) < 0.3 and radius.compared_share(packed, 1e9) == 1.0


def test_density_clusters_of_all_groups(spark):
    x = np.r_[clumps(6, 20, spread=0.05), clumps(1, 5, seed=9)]
    rng = random.Random(1)
    groups = [rng.choice(["a", "b", "", None, "long é"]) for _ in x]
    for by, own in ((None, None), ("g", groups)):
        got = similar.density_clusters(frame(spark, x, groups), 0.2, 4, by=by).orderBy("id").collect()
        assert [r.cluster for r in got] == brute_density(x, 0.2, 4, own)
    links = similar.radius_components(frame(spark, x, groups), 0.2, by="g").toPandas()
    alone = brute_density(x, 0.2, 2, groups)
    assert dict(zip(links.node, links.component)) == {i: c for i, c in enumerate(alone) if c is not None}


def test_density_clusters_of_odd_rows(spark):
    none = frame(spark, [None, None])
    assert [r.cluster for r in similar.density_clusters(none, 1.0, 1).collect()] == [None, None]
    assert similar.density_clusters(none.limit(0), 1.0, 1).count() == 0 and similar.radius_pairs(none.limit(0), 1.0).count() == 0
    same = frame(spark, [[1.0] * 4] * 3000 + [None])  # one clump: its pairs stay within tasks
    found = similar.density_clusters(same, 0.1, 5).groupBy("cluster").count().collect()
    assert sorted((r["cluster"], r["count"]) for r in found if r["cluster"] is not None) == [(0, 3000)]


def test_components_by_salted_labels(spark, monkeypatch):
    monkeypatch.setattr(similar, "FEW", 0)
    edges = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101), (7, 7), (101, 102)], "a long, b long")
    got = {r.node: r.component for r in similar.connected(edges).collect()}
    assert got == {i: 0 for i in range(61)} | {100: 100, 101: 100, 102: 100}


# --- linkage ---


@pytest.mark.parametrize("n", [1, 2, 7, 160])
def test_linkage_by_rounds_is_average_linkage(spark, n):
    x = clumps(max(1, n // 8), 8, spread=0.5)[:n]
    own = similar.average_linkage(x.astype(float), max(1, n // 5))
    rows = frame(spark, x, ["s"] * len(x)).withColumnRenamed("vec_id", "id")
    targets = spark.createDataFrame([("s", max(1, n // 5))], "g string, target int")
    got = [r.cluster for r in linkage.linkage_clusters(rows, targets, "g").orderBy("id").collect()]
    assert got == own.tolist()


def test_linkage_heights_are_those_of_merging_the_nearest_pair(spark):
    x = np.random.default_rng(4).normal(size=(40, 3))
    clusters, heights = [[i] for i in range(40)], []
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    while len(clusters) > 1:
        h, i, j = min((d[np.ix_(a, b)].mean(), i, j) for i, a in enumerate(clusters) for j, b in enumerate(clusters) if i < j)
        heights.append(h)
        clusters[i] = clusters[i] + clusters.pop(j)
    rows = spark.createDataFrame([(i, "s", v.tolist()) for i, v in enumerate(x)], "id long, g string, embedding array<double>")
    assert np.allclose(sorted(heights), sorted(r.height for r in linkage.merges(rows, "g").collect()))


def test_culling_is_the_same_by_either_linkage(spark):
    x = clumps(30, 6, spread=0.4)
    rows = [(i, i % 3, f"f{i % 2}", float(i * 7 % 100) / 10, [float(a) for a in v]) for i, v in enumerate(x)]
    photos = spark.createDataFrame(rows, "id long, scope int, folder string, score double, embedding array<double>")
    order = lambda df: sorted(map(tuple, df.collect()))
    assert order(similar.select_best(photos, ["scope", "folder"], 0.2)) == order(similar.select_best(photos, ["scope", "folder"], 0.2, task_rows=10))



@pytest.mark.parametrize("each", [1, 3, 32])
def test_linkage_by_near_pairs_is_average_linkage(monkeypatch, each):
    """few pairs in memory, in several passes, against the matrix of all; with copies, and clusters of more rows than a tile."""
    monkeypatch.setattr(linkage, "TILE", 32)
    rng = np.random.default_rng(7)
    x = [clumps(20, 9, spread=0.4), rng.normal(size=(200, 5)), rng.normal(size=(60, 3))[rng.integers(0, 60, 200)], np.r_[rng.normal(size=(130, 2)) * 1e-4, rng.normal(size=(50, 2))], np.ones((50, 2)), rng.normal(size=(1, 4))]
    for v in x:
        for target in (1, 8, len(v) // 7 + 1, len(v) // 3 + 1):
            assert linkage.near_linkage(v.astype(float), target, each).tolist() == similar.average_linkage(v.astype(float), target).tolist()


def test_large_scopes_are_culled_in_tasks(spark, monkeypatch):
    """scopes whose matrix is too large for a task are linked by near pairs, not by a table of all pairs; each in a task of its own."""
    x = clumps(40, 15, spread=0.4)
    photos = spark.createDataFrame([(i, i % 3, float(i * 7 % 100) / 10, [float(a) for a in v]) for i, v in enumerate(x)], "id long, scope int, score double, embedding array<double>")
    wanted = sorted(map(tuple, similar.select_best(photos, ["scope"], 0.2).collect()))
    monkeypatch.setattr(similar, "MAX_SCOPE", 20)
    monkeypatch.setattr(linkage, "merges", None)
    made = similar.select_best(photos, ["scope"], 0.2)
    assert sorted(map(tuple, made.collect())) == wanted
    assert made.select(F.spark_partition_id().alias("p"), (F.col("id") % 3).alias("scope")).distinct().groupBy("p").count().agg(F.max("count")).first()[0] == 1


# --- inspection ---


def brute_inspection(rows, r, least, most):
    """rows: (id, group, trusted, vector), by id, of one group."""
    x = np.array([v for *_, v in rows], np.float64)
    n = np.linalg.norm(x, axis=1, keepdims=True)
    x = x / np.where(n > 0, n, 1)
    ids = [i for i, *_ in rows]
    labels = brute_density(x, r, least)
    trusted = [i for i, (_, _, t, _) in enumerate(rows) if t]
    if len(trusted) >= 3:
        refs = trusted
    else:
        sizes = {c: (-labels.count(c), labels.index(c)) for c in labels if c is not None}
        refs = [i for i, c in enumerate(labels) if c == min(sizes, key=sizes.get)] if sizes else list(range(len(rows)))
    if len(refs) > most:
        refs = [refs[i] for i in np.linspace(0, len(refs) - 1, most).astype(int)]
    d = np.sqrt(((x[:, None] - x[refs][None]) ** 2).sum(2)).min(1)
    seen = {}
    for i, (_, _, _, v) in enumerate(rows):
        seen.setdefault(tuple(v), []).append(ids[i])
    return [(ids[i], None if c is None else ids[c], round(float(d[i]), 6), seen[tuple(rows[i][3])][0] if len(seen[tuple(rows[i][3])]) > 1 else None) for i, c in enumerate(labels)]


@pytest.mark.parametrize("part_rows", [None, 7])
def test_inspection(spark, monkeypatch, part_rows):
    monkeypatch.setattr(inspection, "TASK_ROWS", 1 << 14 if part_rows is None else 11)
    x = clumps(9, 12, dims=4, spread=0.1).tolist()
    rows = [(i, i % 3, i % 3 == 0 and i % 2 == 0, v) for i, v in enumerate(x)]
    rows += [(200, 0, None, x[0]), (201, 2, False, x[5]), (202, 2, False, x[5]), (203, 1, False, [0.0] * 4), (300, 9, False, [1.0, 0.0, 0.0, 0.0]), (301, 9, False, [0.0, 1.0, 0.0, 0.0])]
    faces = spark.createDataFrame(rows + [(400, 1, True, None), (401, None, True, x[0])], "id long, person int, trusted boolean, embedding array<float>").repartition(3)
    found = inspection.inspected(faces, "person", 0.25, 3, most_references=5, part_rows=part_rows)
    got = sorted((r.id, r.sub_id, round(r.distance, 6), r.copy_of) for r in found.collect())
    assert got == sorted(q for p in (0, 1, 2, 9) for q in brute_inspection([r for r in rows if r[1] == p], 0.25, 3, 5))
    areas = faces.select("id", (F.col("id") % 10).cast("double").alias("area"))
    for r in inspection.sub_clusters(found, areas, "person").collect():
        own = [q for q in got if q[1] == r.sub_id and next(p[1] for p in rows if p[0] == q[0]) == r.person]
        assert (r["size"], r.largest_id) == (len(own), max(own, key=lambda q: (q[0] % 10, -q[0]))[0])
        assert abs(r.median_distance - np.median([q[2] for q in own])) < 1e-5 and abs(r.most_distance - max(q[2] for q in own)) < 1e-5


def test_faces_of_one_person_in_a_photo(spark):
    x = np.random.default_rng(3).normal(size=(90, 4))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    rng = random.Random(2)
    rows = [(i, i // 4, i % 2, rng.choice(["strict", "temporal", "temporal", "temporal", None]), v.tolist()) for i, v in enumerate(x)]
    refs = [(p, v.tolist()) for p in (0, 1) for v in np.random.default_rng(p + 10).normal(size=(3, 4))]
    faces = spark.createDataFrame(rows + [(200, 3, None, "strict", [1.0] * 4)], "face_id long, photo_id long, person_id long, match_source string, embedding array<double>")
    got = {r.face_id: (r.rule, r.keep) for r in inspection.reference_dedupe(faces, spark.createDataFrame(refs, "person_id long, ref array<double>"), 0.3).collect()}
    want = {}
    for key in {(r[1], r[2]) for r in rows}:
        own = [r for r in rows if (r[1], r[2]) == key]
        if len(own) > 1:
            near = sorted((min(np.linalg.norm(np.array(r[4]) - np.array(v) / np.linalg.norm(v)) for p, v in refs if p == key[1]), r[0]) for r in own)
            sure = [r[0] for r in own if r[3] == "strict"]
            rule = "source" if len(sure) == 1 else "review" if sure else "distance" if near[1][0] - near[0][0] > 0.3 else "ambiguous"
            want |= {r[0]: (rule, r[0] in sure if rule == "source" else r[0] == near[0][1] if rule == "distance" else True) for r in own}
    assert got == want and {r for r, _ in want.values()} == {"source", "review", "distance", "ambiguous"}


def test_operations_by_name(spark):
    photos = busy(spark).withColumns({"date_taken": F.date_format("taken_ts", "yyyy-MM-dd HH:mm:ss"), "day": F.date_format("taken_ts", "yyyy-MM-dd"), "camera_model": F.when(F.col("id") % 2 == 0, "X").otherwise("Y"), "locality": F.col("place"), "admin1": F.lit("a"), "country": F.lit("FR"), "place_name": F.col("place"), "stack_id": F.lit(None).cast("long"), "keywords": F.array(F.lit("k")), "categories": F.array(F.lit("c")), "file_hash": F.col("id").cast("string"), "description": F.lit("x"), "colours": F.array(F.lit("#ff0000"))})
    faces = spark.createDataFrame([(i, i % 2) for i in range(0, 400, 5)], "photo_id long, person_id long")
    persons = spark.createDataFrame([(0, "Ann"), (1, "Ben")], "person_id long, name string")
    collection = spark.createDataFrame([(7, 3, 1), (7, 5, 2)], "collection_id long, photo_id long, sort_order long")
    held = operations.Library(photos, faces, persons, collection)
    tools = operations.library_operations()
    assert {n for n, o in tools.held.items() if o.writes} == {"write_location", "write_tags", "add_to_collection"} and not {"write_tags"} & set(tools.schemas())
    call = lambda name, arguments=None, pinned=None: tools.call(name, arguments, pinned, library=held).collect()
    for name in tools.schemas():
        assert call(name, {"id": 3} if name == "photo" else {}) is not None
    assert call("overview")[0].n_photos == 400 and call("people")[0]["person_id"] in (0, 1)
    by = {r.bucket: r.n for r in call("summary", {"by": "camera"}, {"people": ["ann"], "min_quality": 0})}
    known = {r.id: r for r in photos.collect()}
    assert by == {"X": sum(1 for i in range(0, 400, 10) if (known[i].score if known[i].score is not None else -1) >= 0)}
    with pytest.raises(ValueError, match="unknown persons: zoe"):
        call("summary", {"people": "Zoe"})
    assert {r.id: r.keywords for r in call("write_tags", {"ids": "3,4", "tags": "new"})}[3] == ["k", "new"]
    assert sorted((r.photo_id, r.sort_order) for r in call("add_to_collection", {"collection": "7", "ids": "9,5"})) == [(3, 1), (5, 2), (9, 3)]
    located = {r.id: r.gps_lat for r in call("write_location", {"ids": "1,2", "lat": "5", "lon": "6", "overwrite": "true"})}
    assert located[1] == located[2] == 5.0
    with pytest.raises(ValueError, match="unknown mode"):
        operations.browse(tools, held, "none", {})
    assert operations.browse(tools, held, "daily", {"per_day": 2}).groupBy("day").count().agg(F.max("count")).first()[0] <= 2


# --- scans in parts ---


def busy(spark, n=400):
    """Photos of which most belong to one user, with equal times, unknown times and unknown users."""
    rng = random.Random(2)
    start = dt.datetime(2024, 1, 1)
    rows = []
    for i in range(n):
        user = rng.choice([1] * 8 + [2, 3, None])
        at = None if rng.random() < 0.02 else start + dt.timedelta(minutes=rng.randrange(3000))
        gps = (float(rng.randrange(3)), float(rng.randrange(3))) if rng.random() < 0.2 else (None, None)
        rows.append((i, user, at, *gps, rng.choice(["p", "q", None]), None if rng.random() < 0.1 else float(rng.randrange(30))))
    return spark.createDataFrame(rows, "id long, user_id int, taken_ts timestamp, gps_lat double, gps_lon double, place string, score double").repartition(4)


def same(a, b):
    assert sorted(map(repr, a.collect())) == sorted(map(repr, b.collect()))


def test_runs_in_parts(spark):
    photos = busy(spark)
    for place in (None, "place"):
        cut = lambda rows: ranking.cut_at_gaps(photos, ["user_id"], "taken_ts", 600, "run", place, part_rows=rows).select("id", "run")
        same(cut(None), cut(20))
    rows = sorted(photos.toPandas().itertuples(), key=lambda r: (pd.notna(r.taken_ts), r.taken_ts if pd.notna(r.taken_ts) else 0, r.id))
    run, last, want = 0, None, {}
    for r in rows:
        if r.user_id == 1:
            run += 1 if last is None or pd.isna(last) or (r.taken_ts - last).total_seconds() > 600 else 0
            last = r.taken_ts
            want[r.id] = run
    got = {r.id: r.run for r in ranking.cut_at_gaps(photos, ["user_id"], "taken_ts", 600, "run", part_rows=20).where("user_id = 1").collect()}
    assert got == want and max(want.values()) > 30


def test_anchors_in_parts(spark):
    photos = busy(spark)
    same(timeline.flanked(photos, ["user_id"], 45.0), timeline.flanked(photos, ["user_id"], 45.0, part_rows=15))
    anchors = lambda rows: timeline.anchored(photos, ["user_id"], F.when(F.col("gps_lat").isNotNull(), F.col("id")), rows).select("id", "_l", "_r")
    same(anchors(None), anchors(9))


def test_percentiles_and_places_in_parts(spark):
    photos = busy(spark)
    same(facets.percentile_within(photos, "score", ["user_id"], "pct").select("id", "pct"), facets.percentile_within(photos, "score", ["user_id"], "pct", part_rows=3).select("id", "pct"))
    same(scans.row_numbers(photos.select("user_id", "id"), ["user_id"], ["id"]), scans.row_numbers(photos.select("user_id", "id"), ["user_id"], ["id"], rows=30))
    parts = scans.in_parts(photos, ["user_id"], ["id"], rows=30)
    sizes = parts.rows.groupBy("user_id", "_part").count().collect()
    assert parts.cut and max(r["count"] for r in sizes) <= 60 and len(sizes) > 10
