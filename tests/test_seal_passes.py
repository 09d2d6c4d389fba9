"""How often a seal and the query of deliveries compute their inputs."""

import pytest

from stratal.catalogue import queries
from stratal.operators import ledger as L
from stratal.plans import handoff_queries as Q
from stratal.sources.observations import table


def counting(spark):
    rows = spark.sparkContext.accumulator(0)

    def counted(df):
        def count(batches):
            for b in batches:
                rows.add(b.num_rows)
                yield b

        return df.mapInArrow(count, df.schema)

    return rows, counted


def test_deliveries_read_each_line_once(spark, tmp_path, monkeypatch):
    lines = [(k // 3, k % 3 + 1) for k in range(90)] + [(0, 1), (99, 1), (7, None)]
    spark.createDataFrame(lines, "l_orderkey long, l_linenumber int").write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.createDataFrame([(k, "FOP"[k % 3]) for k in range(30)], "o_orderkey long, o_orderstatus string").write.parquet(f"{tmp_path}/orders.parquet")
    rows, counted = counting(spark)
    monkeypatch.setattr(Q, "table", lambda *at: counted(table(*at)))
    got = {tuple(r) for r in queries()["versioned_deliveries"](spark, str(tmp_path)).collect()}
    state = {"F": (True, "published"), "O": (True, "queued"), "P": (False, "sealed")}
    assert got == {(f"{o}-{n}" if n else f"{o}", "FOP"[o % 3], *state["FOP"[o % 3]]) for o, n in lines if o < 30}
    assert rows.value == len(lines) + 30


@pytest.fixture
def held(spark):
    return spark.createDataFrame([(f"i{k}", "r0") for k in range(5)], "item_id string, run_id string")


def test_a_seal_reads_what_is_sealed_once(spark, held):
    items, none = spark.createDataFrame([(f"i{k}",) for k in range(40)], "item_id string"), spark.createDataFrame([], "item_id string")
    wanted = spark.createDataFrame([("r1", f"i{k}") for k in range(5, 40)], "run_id string, item_id string")
    rows, counted = counting(spark)
    assert {(r["run_id"], r["item_id"]) for r in L.seal(wanted, items, none, counted(held)).collect()} == {("r1", f"i{k}") for k in range(5, 40)}
    assert rows.value == 5


def test_a_repeated_seal_adds_what_is_missing(spark, held):
    items, none = spark.createDataFrame([(f"i{k}",) for k in range(8)] * 2, "item_id string"), spark.createDataFrame([], "item_id string")
    wanted = spark.createDataFrame([("r0", f"i{k}") for k in range(7)], "run_id string, item_id string")
    assert sorted((r["run_id"], r["item_id"]) for r in L.seal(wanted, items, none, held).collect()) == [("r0", "i5"), ("r0", "i6")]
    with pytest.raises(KeyError):
        L.seal(wanted.unionByName(spark.createDataFrame([("r0", None)], "run_id string, item_id string")), items, none, held)
    with pytest.raises(RuntimeError, match="delivered"):
        L.seal(wanted, items, held.select("item_id"), held)
