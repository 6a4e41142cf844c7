"""The same results in DuckDB SQL, written independently of the Spark code."""

from __future__ import annotations

import re

from checks.fixtures import DUCKDB_SPELLING, FIXTURES, fixture_sql

_IDS = "string_split(coalesce(supporting_txn_ids,''),'|')"


def _topped(totals: str, id_column: str, n: int) -> str:
    return f"""
SELECT *, row_number() OVER (PARTITION BY case_id
  ORDER BY round(amount_total_usd,6) DESC, txn_count DESC, {id_column}) AS rnk
FROM {totals} QUALIFY rnk <= {n}"""


def _weights(source: str, id_column: str, text: str) -> str:
    """Nonzero sums of signed token hashes per bucket."""
    return f"""
SELECT id, CAST('0x'||substr(h,1,8) AS BIGINT)%128 AS bucket,
  sum(CASE WHEN substr(h,9,1) IN ('1','3','5','7','9','b','d','f') THEN 1 ELSE -1 END)::DOUBLE AS w
FROM (SELECT id, sha256(t) AS h FROM (
  SELECT {id_column} AS id, unnest(regexp_extract_all(lower({text}),'[a-z0-9_]+')) AS t
  FROM {source}))
GROUP BY ALL HAVING w <> 0"""


def _dense(ids: str, id_column: str, weights: str) -> str:
    """128 numbers per id, as a list."""
    return f"""
SELECT g.id, list(coalesce(w,0) ORDER BY g.bucket) AS v, sqrt(sum(coalesce(w,0)*coalesce(w,0))) AS norm
FROM (SELECT DISTINCT {id_column} AS id, unnest(range(128)) AS bucket FROM {ids}) g
LEFT JOIN {weights} USING (id, bucket) GROUP BY g.id"""


_CHUNKS = """
SELECT sha256(concat_ws('||',doc_id,version,section,CAST(k AS VARCHAR),piece)) AS chunk_id,
  doc_id, version, section, CAST(k AS INT) AS chunk_index, piece AS text,
  concat(doc_id,' ',section,' (',version,')') AS citation
FROM (SELECT doc_id, version, section, k,
    CASE WHEN length(body)<=1200 THEN body
      ELSE trim(substr(body,CAST(k*1100+1 AS BIGINT),1200),' '||chr(9)||chr(10)) END AS piece
  FROM (SELECT *, unnest(range(CASE WHEN length(body)<=1200 THEN 1
      ELSE CAST(1+ceil((length(body)-1200)/1100.0) AS BIGINT) END)) AS k FROM {sections}))"""

_SECTIONS = """
SELECT doc_id, version, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY part)-1 AS INT) AS section_no,
  section, body
FROM (
  SELECT doc_id, version, part,
    coalesce(max(CASE WHEN head THEN trim(regexp_extract(trim(line),'^#{1,6}\\s+(.*)$',1)) END),'Introduction') AS section,
    trim(coalesce(string_agg(CASE WHEN NOT head THEN line END, chr(10) ORDER BY pos),''),' '||chr(9)||chr(10)) AS body
  FROM (
    SELECT *, sum(CAST(head AS INT)) OVER (PARTITION BY doc_id ORDER BY pos) AS part
    FROM (
      SELECT doc_id, version, pos, line, regexp_matches(trim(line),'^#{1,6}\\s+.*$') AS head
      FROM (SELECT doc_id, version, unnest(string_split(text,chr(10))) AS line,
              generate_subscripts(string_split(text,chr(10)),1) AS pos FROM {docs})))
  GROUP BY doc_id, version, part)
WHERE body <> ''"""


def _set(column: str) -> str:
    return f"array_to_string(list_sort(list_distinct(list({column}))),',')"


_DETAILS = """instrument_type direction amount currency counterparty_id merchant_id channel
    country state is_international description""".split()
_BY_DETAILS = ", ".join(f"{c} DESC NULLS LAST" for c in _DETAILS)
_RECENT = f"ts DESC NULLS LAST, txn_id, {_BY_DETAILS}"
_LISTED = f"ts DESC NULLS LAST, txn_id DESC, {_BY_DETAILS}"

PARTS = {
    **{name: fixture_sql(name, DUCKDB_SPELLING) for name in FIXTURES},
    "cases": """
SELECT DISTINCT sha256(concat_ws('||',party_id,CAST(window_start_ms_utc AS VARCHAR),CAST(window_end_ms_utc AS VARCHAR))) AS case_id,
  party_id, window_start_ms_utc AS case_window_start_ms_utc, window_end_ms_utc AS case_window_end_ms_utc
FROM fx_alerts""",
    "profiled": """
SELECT c.*, p.* EXCLUDE (party_id) FROM cases c LEFT JOIN fx_parties p ON c.party_id=p.party_id""",
    "cased_alerts": """
SELECT c.case_id, a.* FROM fx_alerts a JOIN cases c ON a.party_id=c.party_id
  AND a.window_start_ms_utc=c.case_window_start_ms_utc AND a.window_end_ms_utc=c.case_window_end_ms_utc""",
    "cased_tx": """
SELECT c.case_id, c.case_window_start_ms_utc, c.case_window_end_ms_utc, t.*,
  amount * CASE currency WHEN 'EUR' THEN CAST(1.10 AS DOUBLE) WHEN 'GBP' THEN CAST(1.28 AS DOUBLE)
    WHEN 'CAD' THEN CAST(0.75 AS DOUBLE) WHEN 'MXN' THEN CAST(0.058 AS DOUBLE) ELSE CAST(1 AS DOUBLE) END AS amount_usd
FROM fx_transactions t JOIN cases c ON t.party_id=c.party_id
  AND t.txn_timestamp_ms_utc BETWEEN c.case_window_start_ms_utc AND c.case_window_end_ms_utc""",
    "alert_figures": f"""
SELECT case_id, party_id, window_start_ms_utc AS case_window_start_ms_utc, window_end_ms_utc AS case_window_end_ms_utc,
  count(*) AS alerts_count,
  count(*) FILTER (severity='high') AS alerts_high, count(*) FILTER (severity='medium') AS alerts_medium,
  count(*) FILTER (severity='low') AS alerts_low, max(risk_score) AS max_risk_score,
  quantile_disc(risk_score,0.5) AS median_risk_score, {_set("model_type")} AS model_types,
  {_set("scenario_code")} AS scenario_codes, {_set("severity")} AS severities
FROM cased_alerts GROUP BY ALL""",
    "rolling_tx": """
SELECT sha256(concat_ws('||',c.party_id,CAST(s AS VARCHAR),CAST(e AS VARCHAR))) AS case_id,
  c.party_id, s AS case_window_start_ms_utc, e AS case_window_end_ms_utc, t.* EXCLUDE (party_id),
  amount * CASE currency WHEN 'EUR' THEN CAST(1.10 AS DOUBLE) WHEN 'GBP' THEN CAST(1.28 AS DOUBLE)
    WHEN 'CAD' THEN CAST(0.75 AS DOUBLE) WHEN 'MXN' THEN CAST(0.058 AS DOUBLE) ELSE CAST(1 AS DOUBLE) END AS amount_usd
FROM (SELECT DISTINCT party_id, alert_timestamp_ms_utc-34560000000 AS s, alert_timestamp_ms_utc AS e FROM fx_alerts) c
JOIN fx_transactions t ON t.party_id=c.party_id AND t.txn_timestamp_ms_utc BETWEEN s AND e""",
    "tx_figures": f"""
SELECT case_id, party_id, case_window_start_ms_utc, case_window_end_ms_utc,
  count(*) AS txn_count_case, round(fsum(amount_usd),6) AS amount_total_usd_case,
  round(quantile_disc(amount_usd,0.5),6) AS median_amount_usd_case,
  round(max(amount_usd),6) AS max_amount_usd_case,
  min(txn_timestamp_ms_utc) AS first_txn_ms_utc_case, max(txn_timestamp_ms_utc) AS last_txn_ms_utc_case,
  avg(is_international) AS intl_ratio_case, {_set("instrument_type")} AS instrument_types_case
FROM cased_tx GROUP BY ALL""",
    "by_instrument": """
SELECT case_id, party_id, case_window_start_ms_utc, case_window_end_ms_utc, instrument_type,
  count(*) AS txn_count, fsum(amount_usd) AS amount_total_usd FROM cased_tx GROUP BY ALL""",
    "by_counterparty": """
SELECT case_id, party_id, case_window_start_ms_utc, case_window_end_ms_utc, counterparty_id,
  count(*) AS txn_count, fsum(amount_usd) AS amount_total_usd,
  avg(is_international) AS intl_ratio, max(txn_timestamp_ms_utc) AS last_txn_ms_utc
FROM cased_tx GROUP BY ALL""",
    "by_merchant": """
SELECT case_id, party_id, case_window_start_ms_utc, case_window_end_ms_utc, merchant_id,
  count(*) AS txn_count, fsum(amount_usd) AS amount_total_usd, max(txn_timestamp_ms_utc) AS last_txn_ms_utc
FROM cased_tx WHERE merchant_id IS NOT NULL GROUP BY ALL""",
    "by_day": """
SELECT case_id, party_id, strftime(make_timestamp(txn_timestamp_ms_utc*1000),'%Y-%m-%d') AS txn_date_utc,
  instrument_type, count(*) AS txn_count, round(fsum(amount_usd),6) AS amount_total_usd
FROM cased_tx GROUP BY ALL""",
    "cp_short": _topped("by_counterparty", "counterparty_id", 3),
    "cp_full": _topped("by_counterparty", "counterparty_id", 50),
    "m_short": _topped("by_merchant", "merchant_id", 3),
    "m_full": _topped("by_merchant", "merchant_id", 50),
    "listed_ids": f"""
SELECT DISTINCT case_id, party_id, window_start_ms_utc AS case_window_start_ms_utc,
  window_end_ms_utc AS case_window_end_ms_utc, txn_id
FROM (SELECT *, unnest({_IDS}) AS txn_id FROM cased_alerts) WHERE txn_id <> ''""",
    "listed_tx": """
SELECT i.case_id, i.party_id, t.txn_timestamp_ms_utc AS ts, i.txn_id, t.instrument_type, t.direction,
  t.amount, t.currency, t.counterparty_id, t.merchant_id, t.channel, t.country, t.state,
  t.is_international, t.description
FROM listed_ids i LEFT JOIN cased_tx t ON i.case_id=t.case_id AND i.txn_id=t.txn_id""",
    "support_short": f"""
SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY {_RECENT}) AS cut
FROM listed_tx QUALIFY cut <= 3""",
    "support_full": f"""
SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY {_RECENT}) AS cut
FROM listed_tx QUALIFY cut <= 200""",
    "packet": """
SELECT c.case_id, c.party_id, party_type, party_name, industry, country, state, onboarding_date,
  expected_monthly_volume_usd, expected_avg_txn_usd, risk_rating, c.case_window_start_ms_utc,
  c.case_window_end_ms_utc, alerts_count, alerts_high, alerts_medium, alerts_low, max_risk_score,
  median_risk_score, model_types, scenario_codes, severities, txn_count_case, amount_total_usd_case,
  median_amount_usd_case, max_amount_usd_case, first_txn_ms_utc_case, last_txn_ms_utc_case,
  intl_ratio_case, instrument_types_case, alerts, top_counterparties, top_merchants,
  supporting_transactions
FROM profiled c LEFT JOIN alert_figures a ON c.case_id=a.case_id
LEFT JOIN tx_figures t ON c.case_id=t.case_id
LEFT JOIN (SELECT case_id, string_agg(alert_id,',' ORDER BY alert_timestamp_ms_utc DESC, alert_id DESC) AS alerts
  FROM cased_alerts GROUP BY case_id) al ON c.case_id=al.case_id
LEFT JOIN (SELECT case_id, string_agg(counterparty_id,',' ORDER BY rnk) AS top_counterparties
  FROM {cp} GROUP BY case_id) cp ON c.case_id=cp.case_id
LEFT JOIN (SELECT case_id, string_agg(merchant_id,',' ORDER BY rnk) AS top_merchants
  FROM {m} GROUP BY case_id) m ON c.case_id=m.case_id
LEFT JOIN (SELECT case_id, string_agg(txn_id,',' ORDER BY ts DESC NULLS LAST, txn_id DESC) AS supporting_transactions
  FROM {s} GROUP BY case_id) s ON c.case_id=s.case_id""",
    "sections": _SECTIONS.replace("{docs}", "fx_policy_docs"),
    "chunks": _CHUNKS.replace("{sections}", "sections"),
    "amended_sections": _SECTIONS.replace("{docs}", "fx_amended_docs"),
    "amended_chunks": _CHUNKS.replace("{sections}", "amended_sections"),
    "unique_chunks": "SELECT DISTINCT * FROM chunks",
    "case_text": """
SELECT f.case_id AS query_id, concat_ws(chr(10),
  CASE WHEN party_type<>'' THEN 'party_type: '||party_type END,
  CASE WHEN industry<>'' THEN 'industry: '||industry END,
  CASE WHEN risk_rating<>'' THEN 'risk_rating: '||risk_rating END,
  CASE WHEN model_types<>'' THEN 'model_types: '||replace(model_types,',',', ') END,
  CASE WHEN scenario_codes<>'' THEN 'scenario_codes: '||replace(scenario_codes,',',', ') END,
  summaries) AS query
FROM alert_figures f LEFT JOIN fx_parties p ON f.party_id=p.party_id
LEFT JOIN (SELECT case_id, string_agg(trigger_summary,chr(10) ORDER BY n) AS summaries FROM (
    SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY alert_timestamp_ms_utc DESC, alert_id DESC) AS n
    FROM cased_alerts) WHERE n<=5 AND trigger_summary<>'' GROUP BY case_id) a ON f.case_id=a.case_id""",
    "all_text": """
SELECT query_id, query FROM case_text UNION ALL SELECT 'B'||item_id, text FROM benchmark""",
    "case_w": _weights("case_text", "query_id", "query"),
    "case_v": _dense("case_text", "query_id", "case_w"),
    "all_w": _weights("all_text", "query_id", "query"),
    "all_v": _dense("all_text", "query_id", "all_w"),
    "chunk_w": _weights("unique_chunks", "chunk_id", "text"),
    "chunk_v": """
SELECT *, row_number() OVER (ORDER BY id) AS no FROM ("""
    + _dense("unique_chunks", "chunk_id", "chunk_w")
    + ")",
    "queue": """
SELECT case_id, party_id, party_type, party_name, risk_rating, max_risk_score, alerts_count,
  txn_count_case, amount_total_usd_case, last_txn_ms_utc_case, case_window_start_ms_utc,
  case_window_end_ms_utc,
  row_number() OVER (ORDER BY max_risk_score DESC NULLS LAST, last_txn_ms_utc_case DESC NULLS LAST, case_id)-1 AS position
FROM packet_full""",
}
for _size in ("short", "full"):
    PARTS[f"packet_{_size}"] = PARTS["packet"].format(
        cp=f"cp_{_size}", m=f"m_{_size}", s=f"support_{_size}"
    )
del PARTS["packet"]
for _name in ("case", "all"):
    PARTS[f"{_name}_hits"] = f"""
SELECT q.id AS query_id, c.id AS chunk_id, rank, score FROM (
  SELECT qid, no, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, no) AS rank FROM (
    SELECT q.id AS qid, c.no, CASE WHEN q.norm*c.norm>0
      THEN list_dot_product(q.v,c.v)/(q.norm*c.norm) ELSE 0 END AS score
    FROM {_name}_v q, chunk_v c) QUALIFY rank<=5) best
JOIN {_name}_v q ON best.qid=q.id JOIN chunk_v c ON best.no=c.no"""

_REQUIRED = {
    "transactions": """txn_id party_id account_id instrument_type txn_timestamp_ms_utc direction
        amount currency counterparty_id channel country is_international description""",
    "parties": """party_id party_type party_name country onboarding_date
        expected_monthly_volume_usd expected_avg_txn_usd risk_rating""",
    "counterparties": "counterparty_id counterparty_type country",
    "merchants": "merchant_id merchant_name merchant_category country",
    "alerts": """alert_id party_id model_type model_version scenario_code alert_timestamp_ms_utc
        window_start_ms_utc window_end_ms_utc risk_score severity trigger_summary
        supporting_txn_ids amount_total_usd txn_count features_json data_quality_flags""",
}
_KEY = {
    "transactions": "txn_id",
    "parties": "party_id",
    "counterparties": "counterparty_id",
    "merchants": "merchant_id",
    "alerts": "alert_id",
}


def _contract() -> str:
    rows = []
    for name, columns in _REQUIRED.items():
        rows += [
            f"""SELECT '{name}' AS "table", '{c}' AS "column", 'required' AS rule,
  count(*) - count({c}) AS violations FROM fx_{name}"""
            for c in columns.split()
        ]
        key = _KEY[name]
        rows.append(
            f"""SELECT '{name}', '{key}', 'unique', count({key}) - count(DISTINCT {key}) FROM fx_{name}"""
        )
    for name, part in (("case_packet", "packet_full"), ("case_queue", "queue")):
        rows.append(f"SELECT '{name}', 'case_id', 'unique', count(case_id) - count(DISTINCT case_id) FROM {part}")
    rows.append("SELECT 'case_queue', 'position', 'required', count(*) - count(position) FROM queue")
    rows.append("SELECT 'tx_timeline_daily', 'txn_count', 'required', count(*) - count(txn_count) FROM by_day")
    broken = {
        ("merchant_id", "required"): "2 * (count(*) - count(merchant_id))",
        ("merchant_name", "required"): "2 * (count(*) - count(merchant_name))",
        ("country", "required"): "2 * (count(*) - count(nullif(country, 'US')))",
        ("merchant_id", "unique"): "2 * count(merchant_id) - count(DISTINCT merchant_id)",
        ("merchant_category", "missing"): "CAST(max(1) AS BIGINT)",
        ("extra", "unexpected"): "CAST(max(1) AS BIGINT)",
        ("state", "type"): "CAST(max(1) AS BIGINT)",
    }
    for (column, rule), n in broken.items():
        rows.append(f"SELECT 'broken merchants', '{column}', '{rule}', {n} FROM fx_merchants")
    return "\nUNION ALL ".join(rows)


_PARSED = "CASE WHEN json_valid(raw_response) THEN CAST(raw_response AS JSON) END"


def _verdict() -> str:
    """What is wrong with the JSON value ``j`` of a response."""
    kinds = {
        "VARCHAR": ("case_summary", "recommended_disposition"),
        "ARRAY": (
            "key_indicators", "benign_explanations_to_rule_out", "policy_mapping", "missing_information",
            "uncertainty_reasons", "investigator_next_steps",
        ),
        "DOUBLE": ("confidence",),
    }
    fits = [f"json_type(j,'$.{n}') IS NOT DISTINCT FROM '{kind}'" for kind, names in kinds.items() for n in names]

    def lacks(field: str, *lists: str) -> str:
        none = " AND ".join(f"coalesce(json_array_length(x,'$.{n}'),0)=0" for n in lists)
        return f"len(list_filter(CAST(json_extract(j,'$.{field}[*]') AS JSON[]), lambda x: {none}))>0"

    cited = ("evidence_refs", "policy_citations")
    return f"""CASE WHEN j IS NULL THEN 'LLM output is not valid JSON'
  WHEN json_type(j)='OBJECT' AND len(json_keys(j))=0 THEN 'LLM output missing required fields'
  WHEN NOT ({" AND ".join(fits)}) THEN 'LLM output failed JSON schema validation'
  WHEN {lacks("key_indicators", *cited)} THEN 'Key indicator missing citations'
  WHEN {lacks("benign_explanations_to_rule_out", *cited)} THEN 'Benign explanation missing citations'
  WHEN {lacks("investigator_next_steps", *cited)} THEN 'Next step missing citations'
  WHEN {lacks("policy_mapping", "citations")} THEN 'Policy mapping missing citations' END"""


_TOTAL = "* REPLACE (round(amount_total_usd,6) AS amount_total_usd)"
_HIGH = "case_id IN (SELECT case_id FROM cased_alerts WHERE severity='high')"
_KEYED = "window_start_ms_utc AS case_window_start_ms_utc, window_end_ms_utc AS case_window_end_ms_utc"
_NARROW = "EXCLUDE (case_window_start_ms_utc, case_window_end_ms_utc)"

QUERIES = {
    "csv_roundtrip": "SELECT * FROM fx_transactions",
    "alerts_multi_file_scan": """SELECT * REPLACE (nullif(supporting_txn_ids,'') AS supporting_txn_ids,
  nullif(data_quality_flags,'') AS data_quality_flags) FROM fx_alerts""",
    "alerts_by_drops": """SELECT * REPLACE (nullif(supporting_txn_ids,'') AS supporting_txn_ids,
  nullif(data_quality_flags,'') AS data_quality_flags) FROM fx_alerts""",
    "parquet_roundtrip": "SELECT * FROM by_day",
    "case_lookup": f"""SELECT case_id, party_id, party_name, alerts_high, txn_count_case,
  CAST(alerts_count AS INT) AS listed_alerts FROM packet_full WHERE {_HIGH}""",
    "timeline_lookup": f"""SELECT *, CAST(row_number() OVER (PARTITION BY case_id ORDER BY txn_date_utc, instrument_type) AS INT) AS place
FROM by_day WHERE {_HIGH}""",
    "policy_docs": """SELECT CASE WHEN strpos(title,'__v')>0 THEN substr(title,1,strpos(title,'__v')-1) ELSE title END AS doc_id,
  CASE WHEN strpos(title,'__v')>0 THEN substr(title,strpos(title,'__v')+2) ELSE 'v1' END AS version,
  title, path AS source_path, sha256(text) AS content_hash, CAST(length(text) AS INT) AS chars
FROM (SELECT *, regexp_extract(path,'([^/]*)\\.[^./]*$',1) AS title FROM fx_files
  WHERE lower(regexp_extract(path,'\\.([^./]*)$',1)) IN ('md','markdown','txt'))""",
    "schema_contract": _contract(),
    "contract_offenders": """SELECT 'merchants' AS "table", "column", rule, key, CAST(place AS INT) AS place FROM (
  SELECT "column", rule, key, row_number() OVER (PARTITION BY "column", rule ORDER BY key) AS place FROM (
    SELECT 'country' AS "column", 'required' AS rule, merchant_id AS key FROM fx_merchants
      WHERE country='Brand#13'
    UNION ALL SELECT 'country', 'required', merchant_id FROM fx_merchants
      WHERE country='Brand#13' AND starts_with(merchant_category,'PROMO')
    UNION ALL SELECT 'merchant_id', 'unique', merchant_id FROM fx_merchants WHERE starts_with(merchant_category,'PROMO')))
WHERE place<=7""",
    "dataset_counts": "\nUNION ALL ".join(
        f"SELECT '{n}' AS dataset, count(*) AS rows FROM fx_{n}" for n in _KEY
    ),
    "parse_id_list": f"""SELECT alert_id, CAST(k-1 AS INT) AS place, ids[k] AS txn_id FROM (
  SELECT alert_id, ids, unnest(range(1,len(ids)+1)) AS k FROM (
    SELECT alert_id, list_filter({_IDS}, lambda x: x<>'') AS ids FROM fx_alerts))""",
    "fx_normalize": """SELECT txn_id, currency, amount, round(CASE currency WHEN 'EUR' THEN amount*CAST(1.10 AS DOUBLE)
  WHEN 'GBP' THEN amount*CAST(1.28 AS DOUBLE) WHEN 'CAD' THEN amount*CAST(0.75 AS DOUBLE)
  WHEN 'MXN' THEN amount*CAST(0.058 AS DOUBLE) ELSE amount END,6) AS amount_usd FROM fx_transactions""",
    "case_index": "SELECT * FROM cases",
    "case_party": "SELECT * FROM profiled",
    "alerts_case": f"""SELECT * EXCLUDE (window_start_ms_utc, window_end_ms_utc), {_KEYED},
  array_to_string(list_filter({_IDS}, lambda x: x<>''),',') AS supporting_txn_id_arr FROM cased_alerts""",
    "tx_case": "SELECT * REPLACE (round(amount_usd,6) AS amount_usd) FROM cased_tx",
    "alerts_summary": "SELECT * FROM alert_figures",
    "alerts_details": """SELECT case_id, party_id, 0 AS page,
  CAST(row_number() OVER (PARTITION BY case_id ORDER BY alert_timestamp_ms_utc DESC, alert_id DESC)-1 AS INT) AS place,
  alert_timestamp_ms_utc AS ts, alert_id, model_type, scenario_code, risk_score, severity, trigger_summary,
  supporting_txn_ids, amount_total_usd, txn_count, features_json, data_quality_flags FROM cased_alerts""",
    "tx_summary": "SELECT * FROM tx_figures",
    "rolling_tx_summary": PARTS["tx_figures"].replace("cased_tx", "rolling_tx"),
    "tx_summary_by_day": "SELECT * FROM tx_figures",
    "instrument_breakdown_by_day": f"SELECT {_TOTAL} FROM by_instrument",
    "counterparty_totals_by_day": f"SELECT {_TOTAL} FROM by_counterparty",
    "merchant_totals_by_day": f"SELECT {_TOTAL} FROM by_merchant",
    "tx_timeline_by_day": "SELECT * FROM by_day",
    "case_packet_kept_up": "SELECT * FROM packet_full",
    "triage_page_kept_up": """SELECT *, (SELECT count(*) FROM cases) AS total FROM queue
WHERE position>=300 AND position<800""",
    "tx_timeline_kept_up": "SELECT * FROM by_day",
    "case_packet_by_day": "SELECT * FROM packet_full",
    "instrument_breakdown": f"SELECT {_TOTAL} FROM by_instrument",
    "counterparty_totals": f"SELECT {_TOTAL} FROM by_counterparty",
    "merchant_totals": f"SELECT {_TOTAL} FROM by_merchant",
    "tx_timeline_daily": "SELECT * FROM by_day",
    "alerts_by_model": "SELECT model_type, count(*) AS alerts FROM fx_alerts GROUP BY model_type",
    "top_counterparties": """SELECT t.* EXCLUDE (rnk) REPLACE (round(amount_total_usd,6) AS amount_total_usd),
  CAST(rnk AS INT) AS rank, c.counterparty_type, c.country
FROM cp_short t LEFT JOIN fx_counterparties c ON t.counterparty_id=c.counterparty_id""",
    "top_merchants": """SELECT t.* EXCLUDE (rnk) REPLACE (round(amount_total_usd,6) AS amount_total_usd),
  CAST(rnk AS INT) AS rank, m.merchant_name, m.merchant_category, m.country, m.state
FROM m_short t LEFT JOIN fx_merchants m ON t.merchant_id=m.merchant_id""",
    "supporting_ids": "SELECT * FROM listed_ids",
    "supporting_transactions": f"""SELECT * EXCLUDE (cut),
  CAST(row_number() OVER (PARTITION BY case_id ORDER BY {_LISTED})-1 AS INT) AS place
FROM support_short""",
    "case_packet": "SELECT * FROM packet_full",
    "case_packet_json": """SELECT case_id AS row_id, case_id, party_id, industry, expected_avg_txn_usd,
  case_window_end_ms_utc AS end_ms_utc, alerts_count, scenario_codes, alerts, txn_count_case,
  amount_total_usd_case, top_counterparties, top_merchants, supporting_transactions FROM packet_full""",
    "triage_queue": "SELECT * FROM queue",
    "triage_page": """SELECT *, (SELECT count(*) FROM cases) AS total FROM queue
WHERE position>=25 AND position<525""",
    "triage_deep_page": """SELECT *, (SELECT count(*) FROM cases) AS total FROM queue
WHERE position>=300 AND position<800""",
    "top_risk_cases": """SELECT case_id, party_id, max_risk_score, alerts_count, txn_count_case, amount_total_usd_case
FROM packet_full ORDER BY max_risk_score DESC NULLS LAST, case_id LIMIT 20""",
    "case_counterparties": """SELECT t.* EXCLUDE (rnk, case_window_start_ms_utc, case_window_end_ms_utc)
  REPLACE (round(amount_total_usd,6) AS amount_total_usd), c.counterparty_type, c.country
FROM cp_full t LEFT JOIN fx_counterparties c ON t.counterparty_id=c.counterparty_id
WHERE case_id=(SELECT case_id FROM packet_full ORDER BY max_risk_score DESC NULLS LAST, case_id LIMIT 1)""",
    "v_alert_summary": "SELECT * FROM alert_figures",
    "v_instrument_breakdown": f"SELECT {_TOTAL[0]} {_NARROW} {_TOTAL[2:]} FROM by_instrument",
    "v_tx_timeline_daily": "SELECT * FROM by_day",
    "v_top_counterparties": f"""SELECT t.* EXCLUDE (rnk, case_window_start_ms_utc, case_window_end_ms_utc)
  REPLACE (round(amount_total_usd,6) AS amount_total_usd), c.counterparty_type, c.country
FROM cp_short t LEFT JOIN fx_counterparties c ON t.counterparty_id=c.counterparty_id""",
    "v_top_merchants": """SELECT t.* EXCLUDE (rnk, case_window_start_ms_utc, case_window_end_ms_utc)
  REPLACE (round(amount_total_usd,6) AS amount_total_usd), m.merchant_name, m.merchant_category, m.country, m.state
FROM m_short t LEFT JOIN fx_merchants m ON t.merchant_id=m.merchant_id""",
    "v_supporting_transactions": """SELECT * EXCLUDE (cut, ts), ts AS txn_timestamp_ms_utc FROM support_short""",
    "v_case_queue": "SELECT * EXCLUDE (position) FROM queue",
    "case_packet_json_pages": """SELECT case_id, page, pages, CASE WHEN pages>1 THEN page END AS told_page,
  CASE WHEN pages>1 THEN pages END AS told_pages, CAST(n%2 AS INT) AS place, alert_id
FROM (SELECT case_id, alert_id, n, CAST(n//2 AS INT) AS page, CAST((total+1)//2 AS INT) AS pages FROM (
  SELECT case_id, alert_id, count(*) OVER (PARTITION BY case_id) AS total,
    row_number() OVER (PARTITION BY case_id ORDER BY alert_timestamp_ms_utc DESC, alert_id DESC)-1 AS n FROM cased_alerts))""",
    "copilot_prompt_pages": """SELECT case_id, page, page AS told_page, pages,
  CAST(least(5, (SELECT count(DISTINCT chunk_id) FROM chunks)) AS INT) AS passages, CAST(n%2 AS INT) AS place, alert_id
FROM (SELECT case_id, alert_id, n, CAST(n//2 AS INT) AS page, CAST((total+1)//2 AS INT) AS pages FROM (
  SELECT case_id, alert_id, count(*) OVER (PARTITION BY case_id) AS total,
    row_number() OVER (PARTITION BY case_id ORDER BY alert_timestamp_ms_utc DESC, alert_id DESC)-1 AS n FROM cased_alerts))""",
    "v_case_packet": "SELECT * FROM packet_short",
    "policy_sections": "SELECT * FROM sections",
    "policy_chunks": "SELECT * FROM chunks",
    "hash_embed": """SELECT id AS doc_id, CAST(bucket AS INT) AS bucket,
  round(w/sqrt(sum(w*w) OVER (PARTITION BY id)),6) AS value FROM doc_w""",
    "embedding_topk": """SELECT query_id, item_id, round(score,6) AS score, CAST(rank AS INT) AS rank FROM (
  SELECT a.vec_id AS query_id, b.vec_id AS item_id, list_dot_product(a.v,b.v)/(a.norm*b.norm) AS score,
    row_number() OVER (PARTITION BY a.vec_id
      ORDER BY round(list_dot_product(a.v,b.v)/(a.norm*b.norm),9) DESC, b.vec_id) AS rank
  FROM vec a, vec b) WHERE rank<=5""",
    "case_query_text": "SELECT query_id AS case_id, query FROM case_text",
    "policy_retrieval": """SELECT query_id, CAST(rank AS INT) AS rank, chunk_id, doc_id, version, section, citation,
  CAST(length(text) AS INT) AS chars, round(score,6) AS score
FROM all_hits JOIN unique_chunks USING (chunk_id)""",
    "index_stats": """SELECT (SELECT count(*) FROM fx_policy_docs) AS documents, (SELECT count(*) FROM chunks) AS chunks""",
    "policy_index_run": """SELECT 'document' AS kind, o.doc_id,
  CASE WHEN n.doc_id IS NULL THEN '/1/'||o.doc_id ELSE '/2/'||o.doc_id END AS entry,
  sha256(coalesce(n.text,o.text)) AS content_hash
FROM fx_policy_docs o LEFT JOIN fx_amended_docs n ON o.doc_id=n.doc_id AND o.version=n.version
WHERE EXISTS (SELECT 1 FROM chunks c WHERE c.doc_id=o.doc_id AND c.version=o.version) OR n.doc_id IS NOT NULL
UNION ALL SELECT 'chunk', doc_id, chunk_id, sha256(text)
FROM (SELECT * FROM chunks UNION SELECT * FROM amended_chunks)""",
    "policy_index_generations": """SELECT 'document' AS kind, o.doc_id, '/3/'||o.doc_id AS entry, sha256(o.text) AS content_hash, '3' AS born
FROM fx_policy_docs o WHERE EXISTS (SELECT 1 FROM chunks c WHERE c.doc_id=o.doc_id AND c.version=o.version)
UNION ALL SELECT 'chunk', doc_id, chunk_id, sha256(text), CASE WHEN chunk_id IN (SELECT chunk_id FROM chunks) THEN '1' ELSE '2' END
FROM (SELECT * FROM chunks UNION SELECT * FROM amended_chunks)""",
    "policy_upsert": """SELECT 'document' AS kind, o.doc_id,
  CASE WHEN n.doc_id IS NULL THEN '/old/'||o.doc_id ELSE '/new/'||o.doc_id END AS entry,
  sha256(coalesce(n.text,o.text)) AS content_hash
FROM fx_policy_docs o LEFT JOIN fx_amended_docs n ON o.doc_id=n.doc_id AND o.version=n.version
UNION ALL SELECT 'chunk', doc_id, chunk_id, sha256(text)
FROM (SELECT * FROM chunks UNION SELECT * FROM amended_chunks)""",
    "copilot_prompts": "SELECT *, 9 AS required_fields FROM prompted",
    "copilot_validation": f"SELECT case_id, {_verdict()} AS error FROM (SELECT *, {_PARSED} AS j FROM fx_responses)",
    "copilot_runs": f"""SELECT concat(r.case_id,'_',epoch) AS run_id, r.case_id, p.party_id, p.alerts_count,
  p.alerts, p.chunks, 'Summary of '||r.case_id AS case_summary, CAST(len(json_keys(j)) AS INT) AS answered_fields,
  raw_response, 'v1' AS prompt_version, 'drafting-model' AS model,
  strftime(make_timestamp(epoch*1000000),'%Y-%m-%d') AS run_date
FROM (SELECT *, {_PARSED} AS j FROM fx_case_responses) r JOIN prompted p ON p.case_id=r.case_id,
  (SELECT CAST(unnest([1700000000,1700100000]) AS BIGINT) AS epoch)
WHERE {_verdict()} IS NULL""",
}
PARTS["prompted"] = """
SELECT f.case_id, 'v1' AS prompt_version, f.party_id, f.alerts_count,
  CAST(f.alerts_count AS INT) AS alerts, chunks, documents
FROM alert_figures f JOIN (SELECT query_id, string_agg(chunk_id,',' ORDER BY rank) AS chunks,
    string_agg(doc_id,',' ORDER BY rank) AS documents
  FROM case_hits JOIN unique_chunks USING (chunk_id) GROUP BY query_id) h ON h.query_id=f.case_id"""
PARTS["doc_w"] = _weights("documents", "doc_id", "text")
PARTS["vec"] = """
SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v,
  sqrt(list_dot_product(CAST(embedding AS DOUBLE[]),CAST(embedding AS DOUBLE[]))) AS norm FROM embeddings"""


def _needed(sql: str, found: dict[str, None]) -> None:
    for name in PARTS:
        if name not in found and re.search(rf"\b{name}\b", sql):
            _needed(PARTS[name], found)
            found[name] = None


def oracle(name: str) -> str:
    """The query with the parts it uses as a WITH prefix, in order of use."""
    found: dict[str, None] = {}
    _needed(QUERIES[name], found)
    if not found:
        return QUERIES[name]
    parts = ",\n".join(f"{part} AS ({PARTS[part]})" for part in found)
    return f"WITH {parts}\n{QUERIES[name]}"
