"""Daily partials are shuffled no more often than they must be."""

import re

from caseloom.operators import cases as C
from caseloom.operators import partials as P
from tests.rows import DAY, alert, inputs, txn


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def given(spark):
    days = [txn(f"T{p}-{i}", party=p, ts=i * DAY // 2, merchant_id="M1") for p in ("P1", "P2", "P3") for i in range(9)]
    return inputs(spark, transactions=days, alerts=[alert("1", party="P1", start=0, end=3 * DAY - 1), alert("2", party="P2", start=5, end=2 * DAY)])


def rows(df):
    return sorted(map(repr, df.collect()))


def test_blocks_are_put_together_where_their_days_were_placed(spark, conf):
    conf(spark__sql__autoBroadcastJoinThreshold="-1", spark__sql__adaptive__enabled="false")
    tables = given(spark)
    made = P.DayPartials(C.with_usd(tables["transactions"]), C.case_index(tables["alerts"]))
    text = plan(made.counterparty_totals())
    assert not re.search(r"hashpartitioning\(party_id#\d+, (_chunk#\d+L?, )?_level#\d+, _block#\d+L?, counterparty_id", text)


def test_parties_are_looked_up_only_where_that_drops_most(spark, monkeypatch):
    tables = given(spark)
    usd, cases = C.with_usd(tables["transactions"]), C.case_index(tables["alerts"])
    wanted = rows(C.counterparty_totals(C.transactions_in_cases(usd, cases)))
    for few, parties in ((0, {"P1", "P2", "P3"}), (10, {"P1", "P2"})):
        monkeypatch.setattr(P, "FEW_PARTIES", few)
        made = P.DayPartials(usd, cases)
        assert {r.party_id for r in made.facts.collect()} == parties
        assert rows(made.counterparty_totals()) == wanted != []
    monkeypatch.setattr(P, "FEW_PARTIES", 0)
    one = P.DayPartials(usd, cases.where("party_id = 'P1'"))
    assert {r.party_id for r in one.facts.collect()} == {"P1"}
