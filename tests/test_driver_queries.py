import duckdb
import pytest

from chronoweave.operators import messages
from chronoweave.plans import driver_queries, operator_queries

SF = "/root/testdata/sf0.001"


QUERIES = driver_queries.QUERIES | operator_queries.QUERIES
ORACLE_SQL = driver_queries.ORACLE_SQL | operator_queries.ORACLE_SQL


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(spark, name):
    df = QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = [tuple(r[c] for c in columns) for r in df.collect()]
    con = duckdb.connect()
    for t in ("events", "orders", "lineitem", "conversations", "pages"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = con.sql(ORACLE_SQL[name])
    places = [want.columns.index(c) for c in columns]
    assert sorted(map(repr, got)) == sorted(repr(tuple(r[i] for i in places)) for r in want.fetchall())


def _equal_to_sql(spark, name, folder):
    df = QUERIES[name](spark, folder)
    con = duckdb.connect()
    for t in ("events", "orders", "lineitem"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    want = con.sql(ORACLE_SQL[name])
    assert sorted(map(tuple, df.select(want.columns).collect())) == sorted(want.fetchall())


@pytest.mark.parametrize("name", ["merge_rendered", "search_plain", "search_gz", "search_takewhile", "search_no_year"])
def test_positions_of_wide_rows_equal_sql(spark, tmp_path, name):
    """Rows much wider than their keys: a shuffle of both is read in more parts than one of the keys."""
    wide = ", ".join(f"sha256(event_id || '-{i}')" for i in range(16))
    duckdb.sql(f"COPY (SELECT * REPLACE (translate(concat({wide}), '0123456789', 'ghijklmnop') AS event_type) FROM '/root/testdata/sf0.01/events.parquet') TO '{tmp_path}/events.parquet'")
    for t in ("orders", "lineitem"):
        (tmp_path / f"{t}.parquet").symlink_to(f"/root/testdata/sf0.01/{t}.parquet")
    _equal_to_sql(spark, name, tmp_path)


def test_no_year_search_of_a_table_that_steps_back(spark, tmp_path):
    """Events of the same month three times over, and of the years after: the files' mtimes tell the years."""
    moved = "ts + to_days(CAST(CASE k WHEN 3 THEN 365 WHEN 4 THEN 330 ELSE 0 END AS INTEGER))"
    copies = f"SELECT event_id + k * 1000 AS event_id, {moved} AS ts, user_id, event_type, value, props FROM '{SF}/events.parquet', range(5) r(k)"
    duckdb.sql(f"COPY ({copies}) TO '{tmp_path}/events.parquet'")
    for t in ("orders", "lineitem"):
        (tmp_path / f"{t}.parquet").symlink_to(f"{SF}/{t}.parquet")
    _equal_to_sql(spark, "search_no_year", tmp_path)


@pytest.mark.parametrize("name", ["search_gz", "search_plain", "search_takewhile"])
def test_searches_where_the_session_limits_rows_a_file(spark, name):
    """A source is one file however many rows a session lets into one."""
    spark.conf.set("spark.sql.files.maxRecordsPerFile", "100")
    try:
        _equal_to_sql(spark, name, SF)
    finally:
        spark.conf.unset("spark.sql.files.maxRecordsPerFile")


@pytest.mark.parametrize("name", ["search_plain", "search_takewhile"])
def test_searches_where_cores_are_added_between_passes(spark, monkeypatch, name):
    """The pass over the blocks and the one over their lines cut large files alike, however many cores there are at each."""
    bases, folder = messages.bases, "/root/testdata/sf0.01"

    def on_few_cores(stats):
        found = bases(stats).localCheckpoint()
        spark.conf.set("spark.sql.files.minPartitionNum", "64")
        return found

    monkeypatch.setattr(messages, "bases", on_few_cores)
    spark.conf.set("spark.sql.files.openCostInBytes", "1000")
    spark.conf.set("spark.sql.files.minPartitionNum", "1")
    try:
        _equal_to_sql(spark, name, folder)
    finally:
        spark.conf.unset("spark.sql.files.openCostInBytes")
        spark.conf.unset("spark.sql.files.minPartitionNum")


def test_entry_has_queries():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
