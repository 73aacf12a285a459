"""Queries whose results hang on how numbers are rounded, against their SQL on small tables made for it."""

from decimal import ROUND_HALF_EVEN, ROUND_HALF_UP, Decimal, localcontext

import duckdb
import pytest
from pyspark.sql import functions as F

from specdrift.functions import text as T
from specdrift.plans import catalog, more  # noqa: F401 - it registers its queries


def both(spark, folder, name, source, rows):
    """Rows of a query and of its SQL over one table, given as a SELECT."""
    duckdb.sql(f"COPY ({rows}) TO '{folder}/{source}.parquet'")
    got = catalog.QUERIES[name](spark, str(folder))
    duck = duckdb.connect()
    duck.sql(f"CREATE VIEW {source} AS SELECT * FROM '{folder}/{source}.parquet'")
    want = duck.sql(f"SELECT {', '.join(got.columns)} FROM ({catalog.ORACLES[name]})").fetchall()
    return sorted(map(tuple, got.collect())), sorted(want)


def test_windows_end_at_the_nearest_second(spark, tmp_path):
    seconds = [-3600.4, -1.5, -0.5, 0.5, 0.6, 1.5, 2.499999, 3599.5, 3600.2, 3600.499999, 3600.5, 3601.500001, 7200.4]
    rows = f"SELECT i - 1 AS event_id, TIMESTAMP '1970-01-01' + to_microseconds(CAST(round({seconds}[i] * 1e6) AS BIGINT)) AS ts, i % 2 AS user_id FROM range(1, {len(seconds) + 1}) t(i)"
    got, want = both(spark, tmp_path, "pacing_window", "events", rows)
    assert got == want
    at = [(i % 2, round(s)) for i, s in enumerate(seconds)]
    assert [n for _, n in got] == [sum(u == v and t - 3599 <= s <= t for v, s in at) for u, t in at]


def test_windows_do_not_hang_on_the_session_zone(spark, tmp_path):
    ts = "TIMESTAMP '2024-03-10 00:00:00' + to_minutes(CAST(7 * i AS INT))"
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")  # the clock changes at 2:00 of that day
    try:
        for name, one in (("local", ts), ("zoned", f"({ts}) AT TIME ZONE 'UTC'")):
            (tmp_path / name).mkdir()
            got, want = both(spark, tmp_path / name, "pacing_window", "events", f"SELECT i AS event_id, {one} AS ts, 1 AS user_id FROM range(60) t(i)")
            assert got == want == [(i, min(i + 1, 9)) for i in range(60)]
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_costs_have_the_digits_of_their_doubles(spark, tmp_path):
    prices = {"1a": [45210571592.70], "1b": [22491141309.93, 22491141309.93], "1c": [35184372088832.01], "1d": [-45210571592.70], "1e": [0.1, 0.2]}
    values = ", ".join(f"(1, 2, 'P', {p!r}::DOUBLE, '{run}')" for run, some in prices.items() for p in some)
    rows = f"SELECT * FROM (VALUES {values}) AS t(o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderpriority)"
    got, want = both(spark, tmp_path, "usage_text", "orders", rows)
    assert got == want == [(run, f"${float(sum(Decimal(str(p)) for p in some)):.6f}") for run, some in prices.items()]
    assert got[0] == ("1a", "$45210571592.699997")


@pytest.mark.parametrize("even", [True, False])
def test_six_places_are_exact(spark, even):
    values = [0.0, 0.1, 5e-7, 4.9999999999999998e-7, 0.0078125, 0.0234375, 0.9999995, 0.99999949, 999999.9999995, 45210571592.7, 35184372088832.0078125, 2.0**53, 2.0**64 + 4096, 1e22, 4.2e37, 5e-324]
    values += [-v for v in values[1:]]
    rows = spark.createDataFrame(list(enumerate(values)), "i int, v double").select("i", T.six_places(F.col("v"), even).alias("t")).orderBy("i")
    with localcontext(prec=60):
        want = [f"{Decimal(v).quantize(Decimal('0.000001'), ROUND_HALF_EVEN if even else ROUND_HALF_UP):f}" for v in values]
    assert [r["t"] for r in rows.collect()] == want
