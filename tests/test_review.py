"""Prompts, checks on responses and the run log."""

import copy
import json

import pytest

from caseloom.operators import review
from caseloom.operators.packet import CaseFrames
from tests.rows import alert, inputs

VALID = {
    "case_summary": "Four wires in two days.",
    "key_indicators": [{"text": "size", "evidence_refs": ["supporting_transactions[2]"]}],
    "benign_explanations_to_rule_out": [{"text": "payroll", "policy_citations": ["guide 2 (v1)"]}],
    "policy_mapping": [
        {"policy_ref": "guide", "rationale": "r", "citations": [{"citation": "guide 3 (v1)"}]}
    ],
    "missing_information": [{"text": "invoices"}],
    "recommended_disposition": "escalate",
    "confidence": 0.75,
    "uncertainty_reasons": ["short history"],
    "investigator_next_steps": [{"text": "ask", "evidence_refs": ["alerts[1]"]}],
    "narrative_draft": None,
}
NOT_JSON, NOTHING, BAD = review.NOT_JSON, review.NOTHING, review.BAD_SCHEMA


def changed(**fields):
    out = copy.deepcopy(VALID)
    out.update(fields)
    return json.dumps({k: v for k, v in out.items() if v != "DROP"})


def uncited(field, **more):
    items = [{"evidence_refs": ["x"]}, {"text": "t", **more}]
    return changed(**{field: items})


MAPPING = VALID["policy_mapping"][0]
CASES = [
    (json.dumps(VALID), None),
    (changed(narrative_draft="DROP"), None),
    (changed(extra=1), None),
    (changed(confidence=1), None),
    (changed(confidence=7.5e300), None),
    (changed(confidence=-0.0), None),
    (changed(key_indicators=[], policy_mapping=[], investigator_next_steps=[]), None),
    (changed(case_summary=""), None),
    (changed(missing_information=[{}]), None),
    (uncited("key_indicators", policy_citations="p"), None),
    (uncited("key_indicators", evidence_refs=[], policy_citations={"a": 1}), None),
    ("{bad", NOT_JSON),
    ("", NOT_JSON),
    (None, NOT_JSON),
    *[(json.dumps(VALID) + tail, NOT_JSON) for tail in (
        " Let me know if you need more.", json.dumps(VALID), "\n```", "}", "]", ",", "]}", ", 1", ',"r":1', "], [1", '}, {"r":1'
    )],
    ("```json\n" + json.dumps(VALID), NOT_JSON),
    ("  \n" + json.dumps(VALID) + "\n ", None),
    (json.dumps(VALID)[:-1] + ', "confidence": 0.5}', None),
    (json.dumps(VALID)[:-1] + ', "confidence": "high"}', BAD),
    *[(text, NOTHING) for text in ("{}", "[]", "null", "0", "0.0", '""', "false", " {} ")],
    *[(text, BAD) for text in ("[1]", '"text"', "5", "true", '{"a": 1}')],
    *[(changed(**{f: "DROP"}), BAD) for f in VALID if f != "narrative_draft"],
    (changed(confidence="0.5"), BAD),
    (changed(confidence=True), BAD),
    (changed(confidence=None), BAD),
    (changed(case_summary=None), BAD),
    (changed(case_summary=3), BAD),
    (changed(narrative_draft=3), BAD),
    (changed(key_indicators={}), BAD),
    (changed(key_indicators=["text"]), BAD),
    (changed(uncertainty_reasons=[1]), BAD),
    (changed(uncertainty_reasons="x"), BAD),
    (changed(policy_mapping=[{**MAPPING, "citations": [{}]}]), BAD),
    (changed(policy_mapping=[{**MAPPING, "citations": ["x"]}]), BAD),
    (changed(policy_mapping=[{**MAPPING, "citations": [{"citation": "c", "doc_id": 1}]}]), BAD),
    (changed(policy_mapping=[{**MAPPING, "citations": [{"citation": "c", "doc_id": None}]}]), None),
    (changed(policy_mapping=[{"policy_ref": "p", "citations": []}]), BAD),
    (uncited("key_indicators"), "Key indicator missing citations"),
    (uncited("key_indicators", evidence_refs=[], policy_citations=None), "Key indicator missing citations"),
    (uncited("key_indicators", evidence_refs="", policy_citations=0), "Key indicator missing citations"),
    (uncited("benign_explanations_to_rule_out"), "Benign explanation missing citations"),
    (uncited("investigator_next_steps", evidence_refs={}), "Next step missing citations"),
    (changed(policy_mapping=[MAPPING, {**MAPPING, "citations": []}]), "Policy mapping missing citations"),
    (
        changed(key_indicators=[{}], benign_explanations_to_rule_out=[{}], policy_mapping=[{**MAPPING, "citations": []}]),
        "Key indicator missing citations",
    ),
    (
        changed(investigator_next_steps=[{}], policy_mapping=[{**MAPPING, "citations": []}]),
        "Next step missing citations",
    ),
]


@pytest.fixture(scope="module")
def verdicts(spark):
    rows = [(str(i), text) for i, (text, _) in enumerate(CASES)]
    checked = review.validate(spark.createDataFrame(rows, "case_id string, raw_response string"))
    return {r.case_id: r.error for r in checked.collect()}


@pytest.mark.parametrize("number", range(len(CASES)))
def test_verdict(verdicts, number):
    text, wanted = CASES[number]
    assert verdicts[str(number)] == wanted, text


def test_prompt_holds_packet_passages_and_schema(spark):
    packets = CaseFrames(inputs(spark, alerts=[alert("1"), alert("2", party="P2")])).packet
    case = packets.where("party_id = 'P1'").first().case_id
    passages = spark.createDataFrame(
        [(case, 2, "k2", "d", "v1", "s", "two", "c", 0.1), (case, 1, "k1", "d", "v1", "s", "one", "c", 0.2)],
        "query_id string, rank int, chunk_id string, doc_id string, version string, "
        "section string, passage string, citation string, score double",
    )
    rows = {r.case_id: r for r in review.prompts(packets, passages).collect()}
    assert len(rows) == 2
    body = json.loads(rows[case].user_message)
    assert list(body) == ["case_packet", "policy_passages", "schema"]
    assert body["case_packet"]["party_id"] == "P1" and body["case_packet"]["party_name"] is None
    assert [p["passage"] for p in body["policy_passages"]] == ["one", "two"]
    assert body["schema"] == review.response_schema()
    other = next(r for k, r in rows.items() if k != case)
    assert json.loads(other.user_message)["policy_passages"] == []


def test_schema_lists_required_fields():
    assert review.response_schema()["required"] == [f for f in VALID if f != "narrative_draft"]


def test_runs_are_appended(spark, tmp_path):
    responses = spark.createDataFrame(
        [("a", json.dumps(VALID)), ("b", "{}")], "case_id string, raw_response string"
    )
    prompted = spark.createDataFrame([("a", "{}", "[]")], "case_id string, packet string, policy_passages string")
    path = str(tmp_path / "runs")
    for epoch in (5, 86_400 + 5):
        log = review.run_log(review.validate(responses), prompted, "model", epoch)
        review.append_runs(log, path)
    rows = spark.read.parquet(path).orderBy("run_id").collect()
    assert [(r.run_id, str(r.run_date)) for r in rows] == [("a_5", "1970-01-01"), ("a_86405", "1970-01-02")]
    assert all((r.packet, r.policy_passages, r.raw_response) == ("{}", "[]", json.dumps(VALID)) for r in rows)
    assert all(json.loads(r.response) == VALID for r in rows)


def test_a_run_is_in_the_log_once_however_often_it_is_written(spark, tmp_path, monkeypatch):
    prompted = spark.createDataFrame([("a", "{}", "[]")], "case_id string, packet string, policy_passages string")

    def log(text, epoch):
        rows = spark.createDataFrame([("a", json.dumps({**VALID, "case_summary": text})), ("b", "{}")], "case_id string, raw_response string")
        return review.run_log(review.validate(rows), prompted, "model", epoch)

    def content():
        rows = review.committed_runs(spark, path).collect()
        return sorted((r.run, r.run_id, json.loads(r.response)["case_summary"], str(r.run_date)) for r in rows)

    path = str(tmp_path / "runs")
    with pytest.raises(FileNotFoundError):
        review.committed_runs(spark, path)
    assert review.commit_run(log("one", 5), path, "r1") and not review.commit_run(log("again", 5), path, "r1")
    first = [("r1", "a_5", "one", "1970-01-01")]
    assert content() == first
    # A run that breaks off before its name is there is not read, and is written over later.
    log("lost", 86_405).write.mode("overwrite").partitionBy("run_date").parquet(f"{path}/records/run=r2")
    assert content() == first
    assert review.commit_run(log("two", 86_405), path, "r2")
    assert content() == [*first, ("r2", "a_86405", "two", "1970-01-02")]
    assert [r.run for r in review.committed_runs(spark, path, ["r2"]).collect()] == ["r2"]
    assert review.commit_run(log("x", 7).limit(0), path, "empty") and len(content()) == 2


def test_runs_of_pages_take_the_packet_of_their_page(spark):
    responses = spark.createDataFrame(
        [("a", 0, json.dumps(VALID)), ("a", 1, json.dumps(VALID)), ("b", 0, json.dumps(VALID))],
        "case_id string, page int, raw_response string",
    )
    prompted = spark.createDataFrame(
        [("a", 0, "zero", "[]"), ("a", 1, "one", "[]")], "case_id string, page int, packet string, policy_passages string"
    )
    rows = review.run_log(review.validate(responses), prompted, "model", 7).collect()
    assert sorted((r.run_id, r.packet) for r in rows if r.packet) == [("a_0_7", "zero"), ("a_1_7", "one")]
    assert [(r.run_id, r.policy_passages) for r in rows if not r.packet] == [("b_0_7", None)]
