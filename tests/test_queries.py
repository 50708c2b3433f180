"""Every registered query of the library against its SQL, on the smallest tables."""

import duckdb
import pytest
from pyspark.sql import functions as F

from palimpsest.functions import scoring
from palimpsest.plans.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{SF}/{name}.parquet')")
    return con


def plain(x):
    if isinstance(x, float):
        return round(x, 9) + 0.0
    return x


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_sql(spark, con, name):
    rows = QUERIES[name](spark, SF)
    columns = sorted(rows.columns)
    got = sorted((tuple(map(plain, r)) for r in rows.select(*columns).collect()), key=repr)
    if name in ORACLES:
        want = con.sql(ORACLES[name])
        assert sorted(want.columns) == columns
        assert got == sorted((tuple(map(plain, r)) for r in want.project(", ".join(f'"{c}"' for c in columns)).fetchall()), key=repr)


def test_rrf_score_rounds_halves_as_its_sql(spark):
    """At sf0.01 a score is 0.15 * 0.0817 * 61 / 190, a half of the sixth place but for the last bit."""
    more = SF.replace("0.001", "0.01")
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{more}/{name}.parquet')")
    want = set(con.sql(ORACLES["rrf_score"]).project("query_id, key, score").fetchall())
    assert {tuple(r) for r in QUERIES["rrf_score"](spark, more).select("query_id", "key", "score").collect()} == want


def test_scaled_round_is_that_of_the_sql(spark, con):
    halves = [sign * (n + 0.5) / 10**places for places in (4, 6) for n in range(0, 40_000, 7) for sign in (1, -1)] + [0.15 * (0.0817 * (61 / 190)), 0.0, 1.0, 2.5]
    got = spark.createDataFrame([(x,) for x in halves], "x double").select("x", scoring.scaled_round(F.col("x"), 4), scoring.scaled_round(F.col("x"), 6)).collect()
    rounds = con.execute("SELECT x, round(x, 4), round(x, 6) FROM (SELECT unnest(?::DOUBLE[]) AS x)", [halves]).fetchall()
    assert sorted(map(tuple, got)) == sorted(rounds)
