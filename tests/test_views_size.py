"""A view writes only what several frames read."""

from caseloom.operators import packet
from checks import queries as Q
from tests.rows import DAY, alert, inputs, txn


def given(spark):
    days = [txn(f"T{p}-{i}", party=p, ts=i * DAY // 2, merchant_id="M1") for p in ("P1", "P2", "P3") for i in range(9)]
    return inputs(spark, transactions=days, alerts=[alert("1", party="P1", start=0, end=3 * DAY - 1), alert("2", party="P2", start=5, end=2 * DAY)])


def test_a_view_of_one_frame_writes_no_table_for_others(spark, monkeypatch):
    tables, staged, stage = given(spark), [], packet.stage
    monkeypatch.setattr(packet, "stage", lambda df, name: staged.append(name) or stage(df, name))
    monkeypatch.setattr(Q, "inputs", lambda spark, sf: tables)
    for name in ("v_top_counterparties", "v_top_merchants"):
        found = Q._view(spark, "", name)
        assert staged == []
        assert found.where("txn_count > 0").count() > 0
    Q._view(spark, "", "v_case_packet")
    assert staged == ["tx-case"]
