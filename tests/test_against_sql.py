"""Queries against their SQL on rows that the given tables lack."""

import duckdb
import pytest

from stratal import catalogue, plans

plans.load()


def _same(spark, root, name, table):
    rows = lambda found: sorted(map(repr, map(tuple, found)))
    db = duckdb.connect()
    db.execute(f"CREATE VIEW {table} AS SELECT * FROM '{root}/{table}.parquet/*.parquet'")
    want = rows(db.execute(catalogue.oracle_sql()[name]).fetchall())
    assert rows(catalogue.queries()[name](spark, str(root)).collect()) == want and want
    return want


@pytest.mark.parametrize("last", ["2024-01-30 23:59:59.499999", "2024-01-30 23:59:59.5", "2024-01-30 23:59:59.999999", "2024-01-31 00:00:00.5"])
def test_a_time_just_before_the_next_slot(spark, tmp_path, last):
    times = spark.createDataFrame([("2024-01-30 20:00:00",), (last,), (None,)], "ts string")
    times.selectExpr("CAST(ts AS TIMESTAMP_NTZ) AS ts").write.parquet(f"{tmp_path}/events.parquet")
    _same(spark, tmp_path, "search_rotation", "events")


TEXTS = [None, "", "  ", "the tree is here", "the " * 20_000 + "is", "he " * 40_000, "is it", "\n\t", "Heading", "e"]


@pytest.mark.parametrize("name", ["working_map_validate", "working_map_nulls"])
def test_maps_of_any_text_and_id(spark, tmp_path, name):
    ids = [None, *range(-12, 12)]
    rows = [(k, t) for k in ids for t in TEXTS]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert len(_same(spark, tmp_path, name, "documents")) > len(ids)
