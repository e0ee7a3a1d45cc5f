"""Text index, bucketed tables, sweeps, claims, registration and place names: increments, failures and brute force."""

import datetime as dt
import os
import random

import pytest
from pyspark.sql import functions as F

from lightshelf.functions import text as T
from lightshelf.operators import sweeps
from lightshelf.plans import search
from lightshelf.sources import place_index, tables, text_index
from lightshelf.streaming import claims, registration

TEXTS = [
    "A dog on the beach with no people and a red car", "no visible dogs here.\nA beach", "there is no other dog; without cats", "Without a dog, but with water", "no\ndog but dogs", "",
    None, "absence of birds over the sea", "not a dog. A dog", "nothing but an empty beach at night", "no other cat stands near the dog in the long grass of the park", "no dogs", "été à la plage: no one, dog-like", "two people, no dog no cat", "dog",
    "no other thing; no dog", "no otherdog no dog", "many dogs without a leash", "NO DOG", "a no-dog zone", "this is no place that any sensible dog would like", "absence  of dog", "no visible dog", "no visible signs of a dog",
]


def texts(spark, rows, first=0):
    return spark.createDataFrame([(first + i, t, "tag one" if i % 2 else "Other") for i, t in enumerate(rows)], "id long, description string, kind string")


@pytest.fixture(scope="module")
def index(spark, tmp_path_factory):
    found = text_index.TextIndex(spark, str(tmp_path_factory.mktemp("index")), slots=8)
    found.add(texts(spark, ["no dog no cat no people"] * 5 + TEXTS[5:]), ["description", "kind"], "000")
    found.add(texts(spark, TEXTS[:5]), ["description", "kind"], "001")  # these rows come again
    return found


@pytest.mark.parametrize("query", ["dog", "dog beach", "cat", "people dog", "birds", "nobody knows", "animal water", "no", "d", ""])
def test_index_scores_are_those_of_the_texts(spark, index, query):
    want = {r.id: r.v for r in texts(spark, TEXTS).select("id", search.description_score("description", query).alias("v")).collect()}
    assert {r.id: r.score for r in text_index.description_scores(index, query).collect()} == want


@pytest.mark.parametrize("terms", [["dog"], ["dogs", "cat"], ["people"], ["bird"]])
def test_index_exclusions_are_those_of_the_texts(spark, index, terms):
    more = {"bird": ["birds", "sea"]}
    want = {r.id for r in texts(spark, TEXTS).where(T.contains_excluded("description", terms, more)).collect()}
    assert {r.id for r in text_index.excluded(index, terms, more).collect()} == want


def test_index_words_within_words(spark, index):
    rows = {i: f"{t or ''} {'tag one' if i % 2 else 'other'}".lower() for i, t in enumerate(TEXTS)}
    for words in (["dog"], ["og", "the"], ["ta", "on"], ["xyz"], []):
        for most in (2000, 0):
            assert {r.id for r in text_index.containing(index, words, most).collect()} == {i for i, t in rows.items() if all(w in t for w in words)}
    with pytest.raises(ValueError):
        text_index.containing(index, ["two words"])


def test_a_batch_of_the_index_that_failed_is_not_read_and_is_written_again(spark, tmp_path):
    found = text_index.TextIndex(spark, str(tmp_path), slots=4)
    found.add(texts(spark, ["dog", "cat"]), ["description"], "000")
    half = texts(spark, ["cat"], 5)
    half.select(F.lit("dog").alias("word"), F.lit("description").alias("field"), "id", F.array(F.lit(0)).alias("starts")).write.parquet(f"{tmp_path}/postings/batch=001/slot={text_index._slot('dog', 4)}")
    assert {r.id for r in found.postings(["dog"]).collect()} == {0}
    found.add(half, ["description"], "001")
    found.add(half, ["description"], "001")
    assert {r.id for r in found.postings(["cat"]).collect()} == {1, 5} and found.postings(["cat"]).count() == 2


def test_search_by_the_index_is_search_by_the_texts(spark, index):
    photos = texts(spark, TEXTS).withColumn("embedding", F.array(F.col("id") / 10, F.lit(1.0)))
    for query in ("dog beach -cat", "people on the beach", "beach without people"):
        by = lambda ix: sorted((r.id, round(r.semantic_score, 9)) for r in search.semantic(photos, query, [0.5, 1.0], 3, index=ix).collect())
        assert by(index) == by(None)


def test_all_vectors_are_candidates_without_a_limit(spark):
    photos = spark.range(5000).select("id", F.lit("").alias("description"), F.array((F.col("id") / 100000).cast("double")).alias("embedding"))
    assert search.semantic(photos, "x", [0.0], None).count() == 5000
    assert search.semantic(photos, "x", [0.0], 1500).count() == 4500


# --- tables ---


def held(spark, path, buckets=8):
    rows = spark.range(100).select("id", F.concat(F.lit("v"), F.col("id")).alias("name"), F.lit(None).cast("int").alias("n"))
    return tables.BucketedTable(spark, str(path), ["id"], "id bigint, name string, n int", buckets).create(rows)


def values(table, version=None):
    return {r.id: (r.name, r.n) for r in table.read(version).select("id", F.col("name"), "n").collect()}


def test_only_touched_buckets_are_written(spark, tmp_path):
    t = held(spark, tmp_path)
    before = t.manifest()
    some = spark.createDataFrame([(3, "new", None), (1000, "added", 5)], "id long, name string, n int")
    n = t.merge(some)
    after = t.manifest()
    moved = [b for b in before["buckets"] if before["buckets"][b] != after["buckets"][b]]
    assert n == len(moved) <= 2 and len(after["buckets"]) == 8
    want = {i: (f"v{i}", None) for i in range(100)} | {3: ("new", None), 1000: ("added", 5)}
    assert values(t) == want and values(t, 1) == {i: (f"v{i}", None) for i in range(100)}
    assert {r.id for r in t.since(1).collect()} == {3, 1000}  # rows beside them in their buckets are as old as before
    t.delete(spark.createDataFrame([(3,), (7,), (12345,)], "id long"))
    assert values(t) == {i: v for i, v in want.items() if i not in (3, 7)} and t.since(2).count() == 0
    assert t.sweep_files() > 0 and values(t) == {i: v for i, v in want.items() if i not in (3, 7)}


def test_a_write_that_fails_leaves_the_table_as_it_was(spark, tmp_path, monkeypatch):
    t = held(spark, tmp_path)
    row = spark.createDataFrame([(3, "new", 1)], "id long, name string, n int")
    put = tables.BucketedTable._put
    monkeypatch.setattr(tables.BucketedTable, "_put", lambda self, m: (_ for _ in ()).throw(OSError("lost")))
    with pytest.raises(OSError):
        t.upsert(row)
    assert values(t)[3] == ("v3", None)
    monkeypatch.setattr(tables.BucketedTable, "_put", put)
    t.upsert(row)
    assert values(t)[3] == ("new", 1) and len(values(t)) == 100
    # two writers from one version: the later one fails
    stale = t.manifest()
    t.upsert(row.withColumn("n", F.lit(2)))
    with pytest.raises(RuntimeError, match="another writer"):
        t._put(stale | {"version": stale["version"] + 1})
    assert values(t)[3] == ("new", 2)


def test_keys_with_many_rows_and_emptied_buckets(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a"), (1, "a"), (1, "b"), (2, "c"), (None, "d")], "photo_id long, face string")
    t = tables.BucketedTable(spark, str(tmp_path), ["photo_id"], "photo_id bigint, face string", 2).create(rows)
    now = lambda: sorted(map(repr, [tuple(r)[:2] for r in t.read().collect()]))
    assert now() == sorted(map(repr, [(1, "a"), (1, "a"), (1, "b"), (2, "c"), (None, "d")]))
    t.replace(spark.createDataFrame([(1,), (2,)], "photo_id long"), spark.createDataFrame([(1, "z")], "photo_id long, face string"))
    assert now() == sorted(map(repr, [(1, "z"), (None, "d")]))
    t.delete(spark.createDataFrame([(1,)], "photo_id long"))
    assert now() == ["(None, 'd')"]


# --- sweeps ---


def test_a_sweep_goes_on_from_where_it_stood(spark, tmp_path):
    t = held(spark, tmp_path, 16)
    seen = []

    def counted(d):
        seen.append(d.count())
        return d.where("n is null").withColumn("n", F.lit(1))

    stages = [sweeps.SweepStage("second", lambda d: d.where("n = 1 and id % 10 = 0").withColumn("n", F.lit(2)), after=("first",)), sweeps.SweepStage("first", counted), sweeps.SweepStage("gone", lambda d: d.where("id = 5"), "name", removes=True, after=("second",))]
    dry = sweeps.sweep(t, stages, apply=False)
    assert [(s["stage"], s["changes"]) for s in dry] == [("first", 100), ("second", 0), ("gone", 1)] and values(t)[0] == ("v0", None)
    assert [(s["stage"], s["changes"]) for s in sweeps.sweep(t, stages)] == [("first", 100), ("second", 10), ("gone", 1)]
    sweeps.sweep(t, stages)  # what later stages wrote is looked at once more
    assert [s["read"] for s in sweeps.sweep(t, stages)] == [0, 0, 0]
    t.upsert(spark.createDataFrame([(500, "late", None)], "id long, name string, n int"))
    again = sweeps.sweep(t, stages)
    assert [(s["stage"], s["read"], s["changes"]) for s in again] == [("first", 1, 1), ("second", 1, 1), ("gone", 1, 0)]
    assert values(t)[500] == ("late", 2) and 5 not in values(t) and seen[-1] == 1


def test_a_sweep_that_breaks_off_goes_on_with_the_stage_that_failed(spark, tmp_path):
    t = held(spark, tmp_path)
    fail = [True]

    def second(d):
        if fail[0]:
            raise OSError("lost")
        return d.where("n = 1").withColumn("n", F.lit(2))

    stages = [sweeps.SweepStage("first", lambda d: d.where("n is null").withColumn("n", F.lit(1))), sweeps.SweepStage("second", second, after=("first",))]
    with pytest.raises(OSError):
        sweeps.sweep(t, stages)
    fail[0] = False
    assert [(s["stage"], s["changes"]) for s in sweeps.sweep(t, stages)] == [("first", 0), ("second", 100)]
    assert {v[1] for v in values(t).values()} == {2}


# --- claims ---


def brute_claims(events):
    """Each item's events one after the other."""
    out = []
    for item in sorted({e[0] for e in events}):
        holder, begins, ends, renewals = None, None, None, 0
        for _, worker, action, ts, minutes in sorted((e for e in events if e[0] == item), key=lambda e: (e[3], e[1], e[2], e[4])):
            if holder is not None and ends < ts:
                out.append((item, holder, begins, ends, "expired", renewals))
                holder = None
            if holder is None and action == "claim":
                holder, begins, ends, renewals = worker, ts, ts + dt.timedelta(minutes=minutes), 0
            elif holder == worker and action in ("claim", "renew"):
                ends, renewals = ts + dt.timedelta(minutes=minutes), renewals + 1
            elif holder == worker and action == "release":
                out.append((item, holder, begins, ts, "released", renewals))
                holder = None
        if holder is not None:
            out.append((item, holder, begins, ends, "expired", renewals))
    return sorted(out)


def claim_events(workers, n=150, seed=3):
    rng = random.Random(seed)
    at = dt.datetime(2026, 1, 1)
    rows = []
    for _ in range(n):
        at += dt.timedelta(seconds=rng.randrange(1, 240), microseconds=rng.randrange(1000))
        rows.append((rng.randrange(4), rng.choice(workers), rng.choice(["claim", "claim", "renew", "renew", "release"]), at, rng.choice([5, 10, 20])))
    return rows


SCHEMA = "item_id long, worker string, action string, ts timestamp, minutes int"


def test_claims_of_one_claimant_each(spark):
    rows = claim_events(["w"])
    got = claims.claim_table(spark.createDataFrame(rows, SCHEMA), ["item_id", "worker"], ["ts", "action"]).collect()
    assert sorted((r.item_id, r.worker, r.begins, r.ends, r.outcome, r.renewals) for r in got) == brute_claims(rows)


def test_claims_as_a_stream(spark, tmp_path):
    old = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        rows = claim_events(["a", "b", "c"])
        rng = random.Random(1)
        # rows come out of order, within ten minutes; a last one, of no item asked about, moves the watermark past all
        order = sorted(rows, key=lambda r: r[3] + dt.timedelta(seconds=rng.randrange(500)))
        end = (99, "z", "renew", rows[-1][3] + dt.timedelta(hours=3), 1)
        late = (0, "a", "claim", rows[0][3] - dt.timedelta(minutes=1), 600)  # behind the watermark by then: left out
        parts = [order[:50], order[50:100], order[100:], [end], [late, (99, "z", "renew", end[3] + dt.timedelta(hours=3), 1)], [(99, "z", "renew", end[3] + dt.timedelta(hours=9), 1)]]
        for part in parts:
            spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
            stream = spark.readStream.schema(SCHEMA).parquet(f"{tmp_path}/in")
            claims.claim_stream(stream).writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start().awaitTermination()
        got = spark.read.schema(claims.RESULT).parquet(f"{tmp_path}/out").where("item_id <> 99").collect()
        assert sorted((r.item_id, r.worker, r.begins, r.ends, r.outcome, r.renewals) for r in got) == brute_claims(rows)
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", old)


# --- arrivals ---


def test_files_are_registered_as_they_arrive(spark, tmp_path):
    jpeg = b"\xff\xd8\xff\xe0"

    def put(name, content):
        path = tmp_path / "in" / name
        os.makedirs(path.parent, exist_ok=True)
        path.write_bytes(content)

    registry = registration.Registry.at(spark, str(tmp_path / "db"), 4)

    def run(state="state"):
        stream = registration.arrivals(spark, str(tmp_path / "in"), 2)
        registration.register_stream(stream, registry, str(tmp_path / state), availableNow=True).awaitTermination()
        return {r.filename: (r.size, r.file_hash[:8], (r.raw_filepath or "").rsplit("/", 1)[-1]) for r in registry.photos.read().collect()}

    put("2024/DSC1.JPG", jpeg + b"1")
    put("2024/DSC1.ARW", b"raw")
    put("2024/fake.jpg", b"PK\x03\x04")
    put("2024/DSC2.jpg", jpeg + b"22")
    put("2024/notes.txt", b"text")
    put("2024/._DSC1.JPG", jpeg)
    first = run()
    assert {n: (v[0], v[2]) for n, v in first.items()} == {"DSC1.JPG": (5, "DSC1.ARW"), "DSC2.jpg": (6, "")}
    assert [r.filepath.rsplit("/", 1)[-1] for r in registry.rejects.read().collect()] == ["fake.jpg"]
    put("2024/DSC2.arw", b"raw")
    put("2025/DSC1.JPG", jpeg + b"3")
    second = {r.filepath.rsplit("/in/", 1)[-1]: (r.raw_filepath or "").rsplit("/", 1)[-1] for r in registry.photos.read().collect()} if run() else {}
    assert second == {"2024/DSC1.JPG": "DSC1.ARW", "2024/DSC2.jpg": "DSC2.arw", "2025/DSC1.JPG": ""}
    version = registry.photos.manifest()["version"]
    assert len(run()) == 2 and registry.photos.manifest()["version"] == version  # nothing new
    run("another")  # a stream that has lost its checkpoint sees all files again
    assert registry.photos.read().count() == 3 and registry.rejects.read().count() == 1


# --- places ---

PLACES = "geonameid long, name string, asciiname string, alternatenames string, lat double, lon double, feature_class string, population long, country string, admin1_code string"


def test_place_names_exact_and_near(spark):
    rng = random.Random(6)
    syllables = ["san", "ta", "mar", "ia", "bel", "mon", "te", "ville", "burg", "new ", "port", " de "]
    names = [" ".join("".join(rng.choice(syllables) for _ in range(rng.randrange(1, 5))).split()) for _ in range(150)]
    rows = [(i, n.title(), n, f"{n} town,Old {n}" if i % 3 == 0 else None, float(i % 40), float(i % 90), "A" if i % 6 == 0 else "P", rng.randrange(3) * 1000, "XY"[i % 2], str(i % 3)) for i, n in enumerate(names)]
    index = place_index.PlaceIndex(spark.createDataFrame(rows, PLACES))
    queries = [*names[:20], *(n[:-1] for n in names[20:40]), *(n + "x" for n in names[40:60]), "zzz", "", "a", " San   MARIA "]
    got = {}
    for r in index.lookup(spark.createDataFrame([(q,) for q in queries], "query string"), 4).collect():
        got.setdefault(r["query"], []).append((r.place, r.geonameid, round(r.likeness, 9)))
    for q in set(queries):
        key = " ".join(q.lower().split())
        scored = []
        for i, n, _, alt, *_, kind, population, _, _ in rows:
            like = max((place_index.likeness(key, k) for k in {n.lower(), *(a.strip().lower() for a in (alt or "").split(",") if a.strip())}), default=0) if key else 0
            if like >= place_index.LEAST:
                scored.append((-like, "PA".index(kind), -population, i, round(like, 9)))
        want = [(k + 1, s[3], s[4]) for k, s in enumerate(sorted(scored)[:4])]
        assert sorted(got.get(q, [])) == want, q


def test_region_of_a_name(spark):
    rows = [(1, "Tahoe", "Tahoe", None, 39.0, -120.0, "P", 100, "US", "CA"), (2, "Tahoe Region", "Tahoe Region", "the lake", 39.2, -120.1, "A", 0, "US", "CA"), (3, "A", "A", None, 38.8, -120.4, "P", 5, "US", "CA"), (4, "B", "B", None, 39.4, -119.9, "P", 5, "US", "CA"), (5, "Far", "Far", None, 0.0, 0.0, "P", 5, "US", "NV")]
    index = place_index.PlaceIndex(spark.createDataFrame(rows, PLACES))
    assert index.region("tahoe") == pytest.approx((38.8, 39.4, -120.4, -119.9))
    assert index.region("far") == pytest.approx((-0.01, 0.01, -0.01, 0.01)) and index.region("nowhere at all") is None
