"""Every query against its SQL on DuckDB, at the smallest scale; those without SQL must run and give rows."""

import math

import pandas as pd
import pytest

duckdb = pytest.importorskip("duckdb")

from lightshelf.queries import every  # noqa: E402

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
FOUND = every()
#: Queries whose thresholds give no rows at this scale.
MAY_BE_EMPTY = {"f16_persons_and_frame", "f13_all_persons", "g01_components", "r05_quality_only_search", "s04_directory_scan", "v10_merge_suggestions", "j13_two_stage_similarity_join", "t05_burst_stacks", "t06_session_stacks", "f07_member_part"}


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(v):
    if v is None or v is pd.NaT or v is pd.NA:
        return None
    if hasattr(v, "tolist") and not isinstance(v, (str, bytes)):
        v = v.tolist()
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    if isinstance(v, bool):
        return v
    if isinstance(v, (int, float)):
        return None if isinstance(v, float) and math.isnan(v) else round(float(v), 6) + 0.0
    return str(v)


def rows(frame):
    names = sorted(frame.columns)
    return names, sorted((tuple(plain(v) for v in r) for r in frame[names].itertuples(index=False)), key=repr)


@pytest.mark.parametrize("name", sorted(FOUND.queries))
def test_query(spark, duck, name):
    got = FOUND.queries[name](spark, SF).toPandas()
    if name in FOUND.sql:
        assert rows(got) == rows(duck.execute(FOUND.sql[name]).df())
    else:
        assert len(got) or name in MAY_BE_EMPTY


@pytest.mark.parametrize("name", ["t05_burst_stacks", "t06_session_stacks", "g01_components", "v10_merge_suggestions"])
def test_rows_at_a_larger_scale(spark, name):
    assert FOUND.queries[name](spark, "/root/testdata/sf0.01").count() > 0


def test_every_vector_meets_a_photo(spark):
    from lightshelf.queries.timeline import with_vectors

    sf = "/root/testdata/sf0.1"
    met = with_vectors(spark, sf).select("embedding").distinct().count()
    assert met == spark.read.parquet(f"{sf}/embeddings.parquet").select("embedding").distinct().count()
