"""Listed transactions are looked up by their ids where no other frame needs the case transactions."""

from caseloom.operators.packet import CaseFrames, Limits
from tests.rows import DAY, alert, inputs, txn


def test_listed_transactions_come_by_one_join_and_equal_those_of_the_window_join(spark, conf):
    copies = [txn("x", ts=k, description=d) for k in (0, 3, 3, DAY, 40 * DAY) for d in (None, "a", "b")]
    others = [txn("x", party="P2", ts=5), txn("y", ts=2 * DAY), txn("late", ts=60 * DAY), txn("no", ts=1), txn(None, ts=2)]
    given = inputs(
        spark,
        transactions=copies + others + [txn("x", ts=None), txn("x", party=None, ts=4)],
        alerts=[
            alert("1", supporting_txn_ids="x|y|missing|late"), alert("2", supporting_txn_ids="x||x"),
            alert("3", start=2, end=50 * DAY, supporting_txn_ids="x|late"), alert("4", party="P2", supporting_txn_ids="y|x"),
            alert("5", start=9, end=3, supporting_txn_ids="x"), alert("6", party=None, supporting_txn_ids="x"),
        ],
    )
    conf(spark__sql__adaptive__enabled="false", spark__sql__autoBroadcastJoinThreshold="-1")
    for n in (2, 200):
        frames = [CaseFrames(given, Limits(supporting_transactions=n), staged).supporting_transactions for staged in (False, True)]
        found, wanted = (sorted(map(repr, f.collect())) for f in frames)
        assert found == wanted and len(found) >= 7
        assert frames[0].columns == frames[1].columns
        plan = frames[0]._jdf.queryExecution().executedPlan().toString()
        # Ids, transactions, and the copies of an id by case.
        assert plan.count("SortMergeJoin") == 1 and plan.count("Exchange ") == 3
