"""What only larger tables show: keys beyond those of the test tables, equal paths, coordinates out of range, dense times."""

import pytest

duckdb = pytest.importorskip("duckdb")

from lightshelf.sources.library import FACES, library  # noqa: E402


@pytest.fixture(scope="module")
def grown(tmp_path_factory):
    """A function that writes tables given as DuckDB queries to a folder and gives the folder."""

    def write(**tables):
        path = tmp_path_factory.mktemp("grown")
        for name, query in tables.items():
            duckdb.execute(f"COPY ({query}) TO '{path}/{name}.parquet' (FORMAT parquet)")
        return str(path)

    return write


def same_as_sql(spark, path, name, tables):
    """The rows of a query and of its SQL over the tables of a folder."""
    from lightshelf.queries import every

    found = every()
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in tables:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path}/{t}.parquet'")
    made = found.queries[name](spark, path)
    wanted = con.execute(f"SELECT {', '.join(made.columns)} FROM ({found.sql[name]})").fetchall()
    assert sorted(map(repr, map(tuple, made.collect()))) == sorted(map(repr, wanted))
    return len(wanted)


def test_face_ids_of_large_orders(spark, grown):
    """Ids where the SQL's number needs more than 64 bits are told apart, others are the SQL's."""
    rows = "SELECT o AS l_orderkey, n::INT AS l_linenumber, p AS l_partkey, (p % 1000)::BIGINT AS l_suppkey, (1 + p % 50)::DOUBLE AS l_quantity, 'A' AS l_returnflag, 1.5::DOUBLE AS l_extendedprice FROM range(1, 8) a(n), range(0, 1200000, 99999) b(p), (SELECT unnest([1::BIGINT, 922336, 922337, 922338, 1844675, 9000000]) AS o) c"
    path = grown(lineitem=rows)
    made = {(r.photo_id, r.face_id) for r in library(spark, path, "faces").collect()}
    exact = [r[0] for r in duckdb.execute(f"SELECT {FACES['face_id'].replace('l_orderkey *', 'l_orderkey::HUGEINT *')} FROM ({rows})").fetchall()]
    assert len({i for _, i in made}) == len(exact) == 6 * 7 * 13
    assert {i for _, i in made} == {(x + 2**63) % 2**64 - 2**63 for x in exact}


EVENTS = "SELECT i::BIGINT AS event_id, TIMESTAMP '2024-01-01' + to_seconds(CAST(i % 1000 * 61 AS BIGINT)) AS ts, {user}::BIGINT AS user_id, CASE i % 3 WHEN 0 THEN 'view' WHEN 1 THEN 'click' ELSE 'purchase' END AS event_type, (i * 37 % 1000)::DOUBLE / 10 AS value, '{{}}' AS props FROM {ids} t(i)"


@pytest.mark.parametrize("name", ["a33_quality_report", "m12_repair", "m11_sweep_counts", "m11_sweep_applied", "m11_sweep_resumed"])
def test_coordinates_out_of_range(spark, grown, name):
    """Users from 5,000 on have latitudes above 90, which the SQL leaves as they are."""
    path = grown(events=EVENTS.format(user="i % 7 * 1000", ids="range(2000, 3000)"), lineitem="SELECT o AS l_orderkey, 1 AS l_linenumber, o AS l_partkey, o AS l_suppkey, 1.0::DOUBLE AS l_quantity, 'A' AS l_returnflag, 1.5::DOUBLE AS l_extendedprice FROM range(1990, 2010) t(o)")
    made = library(spark, path, "photos").where("gps_lat > 90").count()
    assert made and same_as_sql(spark, path, name, ["events", "lineitem"])


@pytest.mark.parametrize("name", ["n13_created_backfill", "n37_registered_arrivals"])
def test_photos_that_share_a_path(spark, grown, name):
    """names keep six digits of an id, so that ids of seven digits share paths."""
    path = grown(events=EVENTS.format(user="i // 10 % 4 * 40", ids="range(1000000, 1000400)"))
    made = library(spark, path, "photos")
    assert made.select("filepath").distinct().count() < 100
    assert same_as_sql(spark, path, name, ["events"])


@pytest.fixture(scope="module")
def crowd(spark):
    """180 photos within 60 seconds, with vectors of three numbers, in stacks of 1 to 20."""
    import random

    draw = random.Random(5)
    rows = [(i, 1_700_000_000_000_000 + draw.randrange(60_000_000), draw.randrange(3) * 100 + (draw.randrange(20) if i % 4 else 99), [draw.gauss(0, 1) for _ in range(3)]) for i in range(180)]
    df = spark.createDataFrame(rows, "id bigint, t bigint, stack_id bigint, embedding array<float>")
    return df.selectExpr("id", "timestamp_micros(t) AS taken_ts", "stack_id", "embedding"), [tuple(r) for r in df.collect()]


def apart(x, y):
    return sum((a - b) ** 2 for a, b in zip(x, y)) ** 0.5


@pytest.mark.parametrize("part_numbers", [1 << 20, 60])
def test_bursts_by_tiles(crowd, part_numbers):
    """pairs and links of spans, whole or dealt to parts, against brute force."""
    from lightshelf.operators.bursts import near_pairs
    from lightshelf.operators.similar import connected

    df, rows = crowd
    wanted = {(a[0], b[0]) for a in rows for b in rows if a[0] < b[0] and abs(a[1] - b[1]) <= 5_000_000 and apart(a[3], b[3]) <= 0.8}
    made = near_pairs(df, 5.0, 0.8, cosine=False, part_numbers=part_numbers).collect()
    assert len(made) == len(wanted) and {(r.id, r.o_id) for r in made} == wanted
    links = near_pairs(df, 5.0, 0.8, cosine=False, links=True, part_numbers=part_numbers)
    assert links.count() < len(wanted)
    roots = {i: i for pair in wanted for i in pair}
    for _ in roots:
        for a, b in wanted:
            roots[a] = roots[b] = min(roots[a], roots[b])
    assert {r.node: r.component for r in connected(links.selectExpr("id AS a", "o_id AS b")).collect()} == roots


@pytest.mark.parametrize("row", [256, 5])
def test_nearby_stacks_once(crowd, row):
    """every two stacks once, those of many members too, against brute force."""
    from lightshelf.operators.timeline import nearby_stacks

    df, rows = crowd
    wanted = {}
    for _, t, s, _ in rows:
        for o, u, r, _ in rows:
            if s != r and abs(t - u) < 3_000_000:
                members, gap = wanted.get((s, r), (set(), 1e9))
                wanted[s, r] = (members | {o}, min(gap, abs(t - u) / 1e6))
    found = nearby_stacks(df, 3.0, row)
    assert {(r.stack_id, r.o_stack_id): (r.n_members, r.least_gap) for r in found.collect()} == {k: (len(m), g) for k, (m, g) in wanted.items()}
    assert found.count() == len(wanted)


def test_greedy_choice_holds_one_group(spark):
    """F32: groups are gone through as sorted rows, with no call for each; times are compared in microseconds."""
    from lightshelf.operators.ranking import keep_best_apart

    df = spark.sql("SELECT id, id % 500 AS g, timestamp_micros(1700000000000000 + (id DIV 500) * 1000000 - IF(id DIV 500 = 2, 1, 0)) AS taken_ts, CASE id DIV 500 WHEN 0 THEN 9D WHEN 1 THEN double('NaN') WHEN 2 THEN 5D END AS score FROM range(2000)")
    kept = keep_best_apart(df, ["g"], 1.999999)
    assert "FlatMapGroupsInPandas" not in kept._jdf.queryExecution().executedPlan().toString()
    assert sorted(r.id for r in kept.collect()) == list(range(500)) + list(range(1000, 1500))


#: Queries with face ids, by the number of their finding.
LARGE_ORDERS = [
    "a17_group_detail",  # F4
    "j01_photo_face_person",  # F5
    "f25_face_content_filter",  # F6
    "f23_usable_faces",  # F7
    "j06_representative_face",  # F8
    "g04_overlapping_boxes",  # F9
    "j16_update_from",  # F10
    "n02_import_assignments",  # F11
    "n03_manual_assignments",  # F12
    "n07_restore_matches",  # F13
    "n08_manual_tag",  # F14
    "n06_clear_matches",  # F15
    "n19_merge_groups",  # F16
    "n20_bulk_assign",  # F17
    "n23_photo_detail",  # F18
    "s16_face_state",  # F19
    "w03_sample_faces",  # F23
]


@pytest.mark.parametrize("name", LARGE_ORDERS)
def test_queries_of_large_orders(spark, grown, name):
    """Whole queries over orders past 922,337 give the rows of their SQL with ids taken in 128 bits and wrapped."""
    from lightshelf.queries import every

    path = grown(
        lineitem="SELECT 922300 + o * 13 AS l_orderkey, n::INT AS l_linenumber, (o * 37 + n * 11) % 2400 AS l_partkey, (o * 5 + n) % 20 AS l_suppkey, (1 + (o * 7 + n * 3) % 50)::DOUBLE AS l_quantity, substr('ANR', (o + n)::INT % 3 + 1, 1) AS l_returnflag, ((o * 31 + n) % 97)::DOUBLE AS l_extendedprice FROM range(3000) a(o), range(1, 6) b(n)",
        orders="SELECT 922300 + o * 13 AS o_orderkey, o % 50 AS o_custkey, substr('FOP', o::INT % 3 + 1, 1) AS o_orderstatus, (o % 89)::DOUBLE AS o_totalprice, TIMESTAMP '2000-01-01' + to_days((o % 900)::INT) AS o_orderdate, CASE o % 2 WHEN 0 THEN '1-URGENT' ELSE '5-LOW' END AS o_orderpriority FROM range(3000) t(o)",
        supplier="SELECT i AS s_suppkey, concat('Supplier#', i) AS s_name, (i % 5)::INT AS s_nationkey FROM range(20) t(i)",
    )
    found = every()
    wide = FACES["face_id"].replace("l_orderkey *", "l_orderkey::HUGEINT *")
    sql = found.sql[name].replace(FACES["face_id"], f"CAST(({wide} + {2**63}::HUGEINT) % {2**64}::HUGEINT - {2**63}::HUGEINT AS BIGINT)")
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in ("lineitem", "orders", "supplier"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path}/{t}.parquet'")
    made = found.queries[name](spark, path)
    wanted = con.execute(f"SELECT {', '.join(made.columns)} FROM ({sql})").fetchall()
    assert wanted and sorted(map(repr, map(tuple, made.collect()))) == sorted(map(repr, wanted))


def test_nearest_rows_by_tiles(monkeypatch):
    """the nearest of many references, of equal ones the first, without a matrix as wide as they are many."""
    import tracemalloc

    import numpy as np

    from lightshelf.operators import similar

    draw = np.random.default_rng(3)
    x, y = draw.normal(size=(300, 8)), draw.normal(size=(500, 8))
    y[400:450], x[:20] = y[:50], y[30:50]
    wanted = np.sqrt(((x[:, None, :] - y[None, :, :]) ** 2).sum(2))
    for tiles in ((512, 2048), (7, 11)):
        monkeypatch.setattr(similar, "TILE_ROWS", tiles[0])
        monkeypatch.setattr(similar, "TILE_REFS", tiles[1])
        place, least = similar.nearest_rows(x, y)
        assert place.tolist() == wanted.argmin(1).tolist() and np.allclose(least, wanted.min(1), rtol=0, atol=1e-12)
    monkeypatch.undo()
    x, y = draw.normal(size=(1000, 8)), draw.normal(size=(30_000, 8))
    tracemalloc.start()
    similar.nearest_rows(x, y)
    assert tracemalloc.get_traced_memory()[1] < 64 << 20  # the whole matrix has 240 MB
    tracemalloc.stop()


def test_least_distances_to_each_person(spark, monkeypatch):
    """every person's nearest reference, whole or dealt to blocks, of which the answers are sent on in pieces."""
    import numpy as np

    from lightshelf.operators import similar

    draw = np.random.default_rng(4)
    x, y = draw.normal(size=(90, 4)), draw.normal(size=(200, 4))
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id bigint, embedding array<double>")
    refs = spark.createDataFrame([(i % 30, v.tolist()) for i, v in enumerate(y)], "person_id bigint, ref array<double>")
    d = np.sqrt(((x[:, None, :] - y[None, :, :]) ** 2).sum(2))
    wanted = {(i, p): d[i, p::30].min() for i in range(90) for p in range(30)}
    for whole in (64 << 20, 0):
        monkeypatch.setattr(similar, "SENT", 500)
        monkeypatch.setattr(similar, "TASK_ROWS", 40)
        monkeypatch.setattr(similar, "BROADCAST_BYTES", whole)
        made = similar.reference_distances(rows, refs, "embedding", "vec_id").collect()
        assert len(made) == len(wanted) and all(abs(r.distance - wanted[r.vec_id, r.person_id]) < 1e-12 for r in made)


def test_own_references_in_blocks(spark, monkeypatch):
    """rows and references of a group dealt to parts and blocks, also without vectors; no pair is a row of its own."""
    import numpy as np

    from lightshelf.operators import inspection

    draw = np.random.default_rng(6)
    x, y = draw.normal(size=(120, 4)), draw.normal(size=(80, 4))
    made = lambda i, v: v.tolist() if i % 11 else None
    rows = spark.createDataFrame([(i, i % 5 if i % 7 else None, made(i, v)) for i, v in enumerate(x)], "id bigint, label int, e array<double>")
    refs = spark.createDataFrame([(i % 4, made(i // 4 if i % 4 < 3 else 11, v)) for i, v in enumerate(y)], "label int, ref array<double>")
    wanted = {}
    for i, v in enumerate(x):
        if i % 7 and i % 5 < 4:
            d = [float(np.sqrt(((v - u) ** 2).sum())) for k, u in enumerate(y) if k % 4 == i % 5 and i % 5 < 3 and k // 4 % 11 and i % 11]
            wanted[i] = min(d, default=None)
    for task, block in ((1 << 14, 1 << 14), (7, 5)):
        monkeypatch.setattr(inspection, "TASK_ROWS", task)
        monkeypatch.setattr(inspection, "BLOCK_REFS", block)
        found = {r.id: r.distance for r in inspection.own_distances(rows, refs, "label", "id", "e").collect()}
        assert found.keys() == wanted.keys()
        assert all(found[i] is None if d is None else abs(found[i] - d) < 1e-12 for i, d in wanted.items())


@pytest.mark.parametrize("limits", [{}, {"TASK_ROWS": 9, "TILE_ROWS": 4, "TILE_REFS": 3, "AT_ONCE": 5, "SENT": 100}])
def test_sharper_alternatives_of_placed_pictures(spark, monkeypatch, limits):
    """cells meet pictures in parts and blocks, each picture held against all placed ones, against brute force."""
    import numpy as np

    from lightshelf.operators import similar

    for k, v in limits.items():
        monkeypatch.setattr(similar, k, v)
    draw = np.random.default_rng(9)
    x = draw.normal(size=(150, 3))
    day = [None if i % 13 == 0 else i * 7 % 10 for i in range(150)]
    wide = [3000 + i * 37 % 1500 for i in range(150)]
    cells = [(1000 + i, i // 2 * 5, 10.0 + i % 3, 12.0) for i in range(30)] + [(2000, None, 9.0, 9.0)]
    vectors = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id bigint, embedding array<double>")
    photos = spark.createDataFrame([(i, wide[i], 4000, None if day[i] is None else day[i] * 86400) for i in range(149)], "id bigint, image_width int, image_height int, s bigint").selectExpr("id", "image_width", "image_height", "timestamp_seconds(s) AS taken_ts")
    d = np.sqrt(((x[:, None, :] - x[None, :, :]) ** 2).sum(2))
    placed, wanted = {c[1] for c in cells} - {None}, set()
    for cell, p, w, h in cells[:-1]:
        fit = []
        for i in set(range(149)) - placed:
            ppi = min(wide[i] / w, 4000 / h)
            near = d[p, i] <= 1.2 and (day[p] is None or (day[i] is not None and abs(day[i] - day[p]) <= 3))
            if near and ppi >= 330 and not any(d[q, i] < 0.6 for q in placed - {p}):
                fit.append((d[p, i], i, ppi))
        wanted |= {(cell, i, round(a, 9), round(ppi, 9), k + 1) for k, (a, i, ppi) in enumerate(sorted(fit)[:3])}
    made = similar.sharper_alternatives(spark.createDataFrame(cells, "cell_id bigint, photo_id bigint, w double, h double"), photos, vectors, 1.2, 330.0, 3.0, 0.6, 3)
    assert wanted and {(r.cell_id, r.id, round(r.distance, 9), round(r.ppi, 9), r.place) for r in made.collect()} == wanted


def test_degenerate_texts_are_split_once(spark):
    """against brute force, and each text's words are made once, not for every run of six."""
    import random

    from lightshelf.functions import text as T

    draw = random.Random(11)
    texts = [None, "", "  ", "..." * 9, "one two three four five six " * 3] + [" ".join(draw.choice("abcdefgh"[: 2 + i % 7]) for _ in range(i % 40)) for i in range(300)]
    texts += [" ".join(f"W{draw.randrange(most)}" for _ in range(n)) for n in (5, 6, 59, 60, 61, 100, 349, 350, 351) for most in (3, 10, 50, 1000)] + [" ".join(f"w{i}" for i in range(n)) for n in (350, 351)]

    def wanted(t):
        words = (t or "").lower().split()
        n, runs = len(words), [tuple(words[i : i + 6]) for i in range(len(words) - 5)]
        thrice = 6 <= n <= 350 and max(map(runs.count, runs)) >= 3
        return n > 350 or (n > 60 and len(set(words)) / n < 0.45) or thrice or (t or "").count("...") > 8

    df = spark.createDataFrame(list(enumerate(texts)), "id int, t string").select("id", T.is_degenerate("t").alias("v"))
    assert {r.id: r.v for r in df.collect()} == {i: wanted(t) for i, t in enumerate(texts)}
    assert df._jdf.queryExecution().optimizedPlan().toString().count("split(") == 1


def test_answers_of_tiles_are_gathered_on_the_way(spark, monkeypatch):
    """counts and links of a task's tiles are gathered as they come, so that it holds about as many as it has rows."""
    import numpy as np

    from lightshelf.operators import radius
    from lightshelf.operators.similar import density_clusters

    draw = np.random.default_rng(12)
    x = np.concatenate([draw.normal(size=(40, 3)) * 0.1 + c for c in range(6)] + [draw.uniform(-9, 9, size=(60, 3))])
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id bigint, embedding array<double>")
    whole = {r.id: r.cluster for r in density_clusters(df, 0.3, 4).collect()}
    monkeypatch.setattr(radius, "TILE", 16)
    monkeypatch.setattr(radius, "HELD", 20)
    assert {r.id: r.cluster for r in density_clusters(df, 0.3, 4).collect()} == whole
    assert len({c for c in whole.values() if c is not None}) >= 6
    near = np.sqrt(((x[:, None, :] - x[None, :, :]) ** 2).sum(2)) <= 0.3
    packed = radius.packed_blocks(df, block_numbers=90)
    assert {r.id: r.n for r in radius.neighbours(packed, 0.3).collect()} == {i: n - 1 for i, n in enumerate(near.sum(1).tolist()) if n > 1}


@pytest.mark.parametrize("name", LARGE_ORDERS)
def test_queries_of_any_order(spark, grown, name):
    """Orders of up to 64 bits, and a face whose id is the least number of 64 bits, give ids too, not an overflow."""
    from lightshelf.queries import every

    # the order whose first line gives -2^63: order * 10^13 = 2^63 - rest (mod 2^64), as 10^13 is 2^13 times an odd number
    rest = 1_000_000_000_000 + 10_000_000 * 7021 + 1000 * 7
    rest += (2**63 - rest) % 8192
    least = ((2**63 - rest) >> 13) * pow(5**13, -1, 2**51) % 2**51
    quantity = rest - 1_000_000_000_000 - 10_000_000 * 7021 - 1000 * 7
    keys = [10**9 * k + o for k in (7, 8, 59, 10**3, 9 * 10**9) for o in (1, 2, 99_999)] + [2**63 - 1]
    orders = f"SELECT unnest({keys}::BIGINT[]) AS o UNION ALL SELECT {least}"
    path = grown(
        lineitem=f"SELECT o AS l_orderkey, n::INT AS l_linenumber, ((o * 37::HUGEINT + n * 11) % 2400)::BIGINT AS l_partkey, CASE WHEN n < 3 THEN 7 ELSE o % 20 END AS l_suppkey, (1 + (o % 100 * 7 + n * 3) % 50)::DOUBLE AS l_quantity, substr('ANR', (o % 3)::INT + 1, 1) AS l_returnflag, (n % 97)::DOUBLE AS l_extendedprice FROM ({orders}) a, range(2, 40) b(n) UNION ALL SELECT {least}, 1, 7021, 7, {quantity}, 'A', 99",
        orders=f"SELECT o AS o_orderkey, o % 50 AS o_custkey, substr('FOP', (o % 3)::INT + 1, 1) AS o_orderstatus, (o % 89)::DOUBLE AS o_totalprice, TIMESTAMP '2001-01-01' + to_days((o % 900)::INT) AS o_orderdate, CASE o % 2 WHEN 0 THEN '1-URGENT' ELSE '5-LOW' END AS o_orderpriority FROM ({orders})",
        supplier="SELECT i AS s_suppkey, concat('Supplier#', i) AS s_name, (i % 5)::INT AS s_nationkey FROM range(20) t(i)",
    )
    wide = FACES["face_id"].replace("l_orderkey *", "l_orderkey::HUGEINT *")
    wrapped = f"CAST((({wide}) % {2**64}::HUGEINT + {2**63}::HUGEINT) % {2**64}::HUGEINT - {2**63}::HUGEINT AS BIGINT)"
    found = every()
    # the SQL's own -id of the least number has no place in 64 bits either
    sql = found.sql[name].replace(FACES["face_id"], wrapped).replace("(area, -face_id)", "(area, -face_id::HUGEINT)")
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in ("lineitem", "orders", "supplier"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path}/{t}.parquet'")
    assert con.execute(f"SELECT min({wrapped}) FROM lineitem").fetchone()[0] == -(2**63)
    made = found.queries[name](spark, path)
    wanted = con.execute(f"SELECT {', '.join(made.columns)} FROM ({sql})").fetchall()
    assert wanted and sorted(map(repr, map(tuple, made.collect()))) == sorted(map(repr, wanted))


@pytest.mark.parametrize("task", [1 << 17, 10_000])
def test_places_of_equal_names(spark, monkeypatch, task):
    """of a name that many places have only the best go on, in one part or several, against brute force."""
    from lightshelf.sources import place_index

    if hasattr(place_index, "TASK_NAMES"):
        monkeypatch.setattr(place_index, "TASK_NAMES", task)
    names = ["Old Town", "Old Towns", "Cold Town", "New Port", "New Sport", "Far"]
    rows = [(i, names[i % 6], names[i % 6], names[i * 7 % 5] if i % 9 == 0 else None, i % 90 - 45.0, i % 170 * 1.0, "PAL"[i * 11 % 3] if i % 13 else None, i * 37 % 400 if i % 17 else None, f"N{i % 3}", str(i % 4)) for i in range(60_000)]
    rows += rows[-500:]  # a place that is listed twice is one place
    places = spark.createDataFrame(rows, "geonameid long, name string, asciiname string, alternatenames string, lat double, lon double, feature_class string, population long, country string, admin1_code string").repartition(4)
    asked = spark.createDataFrame([(q,) for q in ("old town", "NEW  port", "far", "none")], "query string")
    ranked = {}
    for q in ("old town", "NEW  port", "far"):
        best = {}
        for i, name, _, other, _, _, kind, population, *_ in rows:
            like = max(place_index.likeness(" ".join(q.lower().split()), k.lower()) for k in (name, other) if k)
            if like >= place_index.LEAST:
                best[i] = (-like, "PA".find(kind) if kind in ("P", "A") else 2, -(population or 0), i)
        ranked |= {(q, n + 1): (b[3], round(-b[0], 9)) for n, b in enumerate(sorted(best.values())[:3])}
    index = place_index.PlaceIndex(places)
    ordered, own = [], place_index.top_per_group
    monkeypatch.setattr(place_index, "top_per_group", lambda df, *rest: ordered.append(df.count()) or own(df, *rest))
    made = index.lookup(asked, 3).collect()
    assert {(r["query"], r.place): (r.geonameid, round(r.likeness, 9)) for r in made} == ranked
    assert ordered[0] < 100  # before, a row for every place of a near name


def test_overlaps_are_dealt_to_tasks(spark, grown, monkeypatch):
    """every two users, in more tasks than the few that small aggregates are packed into."""
    from lightshelf.operators import timeline
    from lightshelf.queries import every

    monkeypatch.setattr(timeline, "TASK_PAIRS", 1000, raising=False)
    path = grown(events=EVENTS.format(user="i % 120", ids="range(1000)").replace("* 61", "* i % 900 * 6151"))
    assert same_as_sql(spark, path, "t14_overlap_days", ["events"]) == 120 * 119 // 2
    made = every().queries["t14_overlap_days"](spark, path)
    assert made.selectExpr("spark_partition_id() AS p").distinct().count() >= 10


def test_review_run_of_large_scopes(spark, grown, monkeypatch):
    """a run over scopes whose matrix is too large for a task makes no table of all pairs; picks have their stacks."""
    from lightshelf.operators import linkage, similar
    from lightshelf.queries import every

    path = grown(events=EVENTS.format(user="i % 12", ids="range(200, 600)"), embeddings="SELECT i::BIGINT AS vec_id, (i % 3)::INT AS label, list_transform(range(4), lambda k: sin(i * (k + 2.5) * 1.7)::FLOAT) AS embedding FROM range(450) t(i)")
    run = every().queries["n31_review_run"]
    wanted = sorted(map(tuple, run(spark, path).collect()), key=repr)
    monkeypatch.setattr(similar, "MAX_SCOPE", 40)
    monkeypatch.setattr(linkage, "merges", None)
    made = run(spark, path)
    assert sorted(map(tuple, made.collect()), key=repr) == wanted and len(wanted) == 450
    assert {r.id: r.stack_id for r in made.collect()} == {i: i // 6 if 200 <= i and i % 6 < 2 else None for i in range(450)}


@pytest.mark.parametrize("cosine", [False, True])
@pytest.mark.parametrize("part", [0, 1])
def test_bursts_compare_what_is_not_joined(monkeypatch, cosine, part):
    """the components of a task are those of all its pairs, of which a dense span sums few; rows of equal time and vector are one."""
    import numpy as np
    import pyarrow as pa

    from lightshelf.operators import bursts

    rng = np.random.default_rng(3)
    x = np.r_[rng.normal(size=(900, 6)), rng.normal(size=(300, 6)) + np.r_[30, np.zeros(5)], np.zeros((3, 6))].astype(np.float32)
    t = rng.integers(0, 40_000_000, len(x))
    again = np.r_[np.arange(len(x)), rng.integers(0, len(x), 400)]  # copies, of the zero vectors too
    x, t, n = x[again], t[again], len(again)
    ids, own, parts = rng.permutation(n * 3)[:n].astype(np.int64), np.ones(n, bool), rng.integers(0, part + 1, n)
    table = pa.table({"id": ids, "t": t, "own": own, "part": parts.astype(np.int32), "v": pa.array(list(x), pa.list_(pa.float32()))})
    summed, exact = [], bursts._exact
    monkeypatch.setattr(bursts, "_exact", lambda a, b, c: summed.append(len(a)) or exact(a, b, c))
    monkeypatch.setattr(bursts, "TILE", 64)
    most = 0.05 if cosine else 2.0
    root = {int(i): int(i) for i in ids}
    pairs = 0
    for low, high in [(0, 0)] + [(0, 1), (1, 1)] * part:
        some = table.filter(pa.array(np.isin(parts, [low, high])))
        a, b = bursts._links(tuple(pa.scalar(k) for k in (0, low, high, 6)), some, 5.0, most, cosine)
        assert len(set(b.tolist())) == len(b) < some.num_rows and (a < b).all()
        for u, w in zip(a.tolist(), b.tolist()):
            r, q = root[u], root[w]
            root = {k: min(r, q) if v in (r, q) else v for k, v in root.items()}
    wide = x.astype(float)
    wanted = {int(i): int(i) for i in ids}
    for i in range(n):
        d = exact(np.repeat(wide[i : i + 1], n, 0), wide, cosine)
        near = (np.abs(t - t[i]) <= 5_000_000) & ((d < most) if cosine else (d <= most)) & (ids != ids[i])
        pairs += int(near.sum())
        for w in ids[near].tolist():
            r, q = wanted[int(ids[i])], wanted[w]
            if r != q:
                wanted = {k: min(r, q) if v in (r, q) else v for k, v in wanted.items()}
    assert root == wanted and 1 < len(set(wanted.values())) < n
    if not part and not cosine:
        assert sum(summed) < pairs / 2 / 4


@pytest.mark.parametrize("few", [200_000, 0])
def test_stars_are_connected_by_their_roots(spark, monkeypatch, few):
    """links of stars that share rows, by rounds over roots and in one task, against rounds over all rows."""
    from lightshelf.operators import similar

    chain = [(10 * k, 10 * k + i) for k in range(40) for i in range(1, 12)] + [(1000, 1001), (1002, 1001), (990, 1002), (2000, 2001), (2000, 2001)]
    links = spark.createDataFrame([(a, b) for a, b in chain if not 200 <= a < 210], "a long, b long")
    wanted = sorted(map(tuple, similar.connected(links).collect()))
    monkeypatch.setattr(similar, "FEW", few)
    assert sorted(map(tuple, similar.connected_stars(links).select("node", "component").collect())) == wanted


def test_nearby_stacks_by_tiles(spark, crowd, monkeypatch):
    """stacks meet in tiles of times, crowded bands dealt to parts; members listed twice count once."""
    from lightshelf.operators import timeline

    monkeypatch.setattr(timeline, "TASK_STACKS", 4)
    df, _ = crowd
    df = df.unionByName(df.where("id % 29 = 0").selectExpr("id", "taken_ts + INTERVAL 2 SECONDS AS taken_ts", "stack_id", "embedding"))
    rows = [(r.id, r.t, r.stack_id) for r in df.selectExpr("id", "unix_micros(taken_ts) AS t", "stack_id").collect()]
    wanted = {}
    for _, t, s in rows:
        for o, u, r in rows:
            if s != r and abs(t - u) < 3_000_000:
                members, gap = wanted.get((s, r), (set(), 1e9))
                wanted[s, r] = (members | {o}, min(gap, abs(t - u) / 1e6))
    found = timeline.nearby_stacks(df, 3.0)
    assert "FlatMapGroupsInArrow" in found._jdf.queryExecution().executedPlan().toString()
    made = found.collect()
    assert {(r.stack_id, r.o_stack_id): (r.n_members, r.least_gap) for r in made} == {k: (len(m), g) for k, (m, g) in wanted.items()}
    assert len(made) == len(wanted)
