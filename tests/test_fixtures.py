"""Inputs made from small tables."""

from __future__ import annotations

import datetime

from checks import fixtures


def write_tables(spark, folder):
    day = datetime.date(1995, 3, 1)
    tables = {
        "region": ("r_regionkey int, r_name string", [(0, "R")]),
        "nation": ("n_nationkey int, n_name string, n_regionkey int", [(0, "N0", 0), (1, "N1", 0)]),
        "customer": (
            "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
            [(1, "one", 0, 5.0, "HOUSEHOLD"), (2, "two", 1, -5.0, "BUILDING")],
        ),
        "supplier": ("s_suppkey bigint, s_nationkey int, s_acctbal double", [(1, 0, 1.0), (2, 1, -1.0)]),
        "part": (
            "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int",
            [(1, "bolt", "B1", "T1", 10), (2, "nut", "B2", "T2", 50)],
        ),
        "orders": (
            "o_orderkey bigint, o_custkey bigint, o_totalprice double, o_orderdate date, o_orderpriority string",
            # The last one lists nothing, the one before has no customer.
            [(10, 1, 300_000.0, day, "1-URGENT"), (11, 2, 1.0, day, "2-HIGH"), (12, 9, 400_000.0, day, "1-URGENT"),
             (13, 2, 500_000.0, day, None)],
        ),
        "lineitem": (
            "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, "
            "l_extendedprice double, l_returnflag string, l_linestatus string",
            [(o, p, s, n, 2.0, 7.5, "R", "F") for o in (10, 11, 12, None) for n, (p, s) in enumerate([(1, 1), (2, 2), (2, None), (2, 2)])],
        ),
    }
    for name, (schema, rows) in tables.items():
        spark.createDataFrame(rows, schema).write.parquet(f"{folder}/{name}.parquet")


def test_transactions_are_joined_once_for_all_inputs(spark, tmp_path, monkeypatch):
    write_tables(spark, tmp_path)
    asked, table = [], fixtures.table
    monkeypatch.setattr(fixtures, "table", lambda s, d, name: asked.append(name) or table(s, d, name))
    made = fixtures.inputs(spark, str(tmp_path))
    assert asked.count("lineitem") == 1
    ids = sorted(r.txn_id for r in made["transactions"].collect())
    assert ids == [f"T{o}-{n}-{p}-{p}" for o in (10, 11) for n, p in ((0, 1), (1, 2), (3, 2))]
    alerts = {r.alert_id: (r.party_id, r.supporting_txn_ids, r.txn_count) for r in made["alerts"].collect()}
    assert alerts == {"AL10": ("P1", "T10-0-1-1|T10-1-2-2|T10-3-2-2||TMISSING", 3), "AL13": ("U2", "", 0)}


def test_no_wide_shuffle_by_supplier(spark, conf, tmp_path):
    write_tables(spark, tmp_path)
    conf(spark__sql__autoBroadcastJoinThreshold="-1", spark__sql__adaptive__enabled="false")
    plan = fixtures.fixture(spark, str(tmp_path), "fx_transactions")._jdf.queryExecution().executedPlan().toString()
    # Lines and parts, orders and customers, both together; suppliers are broadcast and nations are few.
    assert "hashpartitioning(l_suppkey" not in plan
    assert plan.count("hashpartitioning(l_orderkey") == plan.count("hashpartitioning(l_partkey") == 1
