"""Every query with SQL against DuckDB, and the others for rows, on the smallest tables."""

import glob
import os

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from kestrova.queries import ORACLE_SQL, QUERIES


def same(a, b):
    assert sorted(a.columns) == sorted(b.columns)
    columns = sorted(a.columns)

    def plain(frame):
        out = frame[columns].apply(lambda c: c.astype(float).round(9) + 0.0 if c.dtype.kind in "fiub" else c.astype(str).str[:10] if c.dtype.kind == "M" else c.astype(str))
        return out.sort_values(columns).reset_index(drop=True)

    a, b = plain(a), plain(b)
    assert len(a) == len(b)
    for c in columns:
        assert ((a[c] == b[c]) | (a[c].isna() & b[c].isna())).all(), c


@pytest.fixture(scope="module")
def duck(small):
    con = duckdb.connect()
    for path in glob.glob(f"{small}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS FROM '{path}'")
    return con


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_matches_sql(spark, small, duck, name):
    same(QUERIES[name](spark, small).toPandas(), duck.execute(ORACLE_SQL[name]).df())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE_SQL)))
def test_runs(spark, small, name):
    out = QUERIES[name](spark, small)
    assert out.count() > 0 and len(set(out.columns)) == len(out.columns)


def test_entry(spark, small):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def of_values(spark, folder, name, series):
    """(Spark's rows, DuckDB's) of a query over events of users 0, 1 ... with these values, as text: NaN isn't null."""
    rows = [(user, k, v) for user, values in enumerate(series) for k, v in enumerate(values)]
    user, at, value = zip(*rows)
    events = pa.table({"event_id": range(len(rows)), "ts": pa.array([10**15 + k for k in at], pa.timestamp("us")), "user_id": user, "value": pa.array(value, pa.float64())})
    pq.write_table(events, f"{folder}/events.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS FROM '{folder}/events.parquet'")
    text = lambda rows: sorted(tuple(map(str, r)) for r in rows)
    return text(QUERIES[name](spark, str(folder)).collect()), text(con.execute(ORACLE_SQL[name]).fetchall())


def test_quick_backtest_from_prices_of_zero(spark, tmp_path):
    up, down = [1.0, 2.0, 3.0, 0.0, 5.0, 6.0, 0.0, 7.0, 0.0, 0.0, 4.0], [-4.0, -3.0, 2.0, 0.0, -5.0, None, 0.0, None, 1.0, 0.0]
    got, want = of_values(spark, tmp_path, "quick_backtest", [up, down, [1.0, 1.0, 2.0, -0.0, 3.0], [-1.0, 1.0, 2.0, -0.0, 3.0, 0.0, -2.0]])
    assert got == want
    assert {r[2] for r in got} >= {"inf", "-inf", "nan", "None"}


def test_quick_backtest_between_two_roundings(spark, tmp_path):
    """Returns that are the middle between two results but for the last bit, and one that is too large to be multiplied."""
    got, want = of_values(spark, tmp_path, "quick_backtest", [[22.45, 88.69, 34.47, 6.4, 60.03], [1.47, 17.16, 22.65, 51.2, 77.04], [1.0, 2.0, 3.0, 1e-300, 1e5]])
    assert got == want


def test_label_slope_of_equal_slopes(spark, tmp_path):
    """Slopes of 5 and 6 rows, or of 5 and 7, that are as steep but of opposite sign: the shorter horizon's counts."""
    tied = [[2.49, 111.08, 52.8, 22.98, 19.93, 47.89, 11.11, 18.7, 43.24, 19.68, 122.24, 4.11, 37.84, 31.88, 12.86], [31.06, 8.71, 65.71, 58.55, 15.08, 13.3, 11.96, 65.36, 27.12, 23.37, 33.84, 12.62, 50.51, 39.26, 9.9]]
    steep = [[round(v * k, 6) for v in values] for values in tied for k in (1, -1, 3, -7, 11, 1000, 0.01)]
    got, want = of_values(spark, tmp_path, "label_slope", steep)
    assert got == want
