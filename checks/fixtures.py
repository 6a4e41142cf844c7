"""Inputs of the engine, derived from the test tables.

One SQL text serves Spark and the oracle; ``{...}`` marks the few spellings that
differ between the two.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from caseloom import schemas
from caseloom.session import COMPRESSED, give_back, scratch_path, spread

TABLES = (
    "region nation customer supplier part orders lineitem events "
    "documents embeddings pages benchmark labels conversations"
).split()

# Tables with many rows, or rows that take long to process.
HEAVY = ("lineitem", "orders", "documents", "events", "embeddings")

# Suppliers of so many rows (three narrow columns of them) are broadcast, beyond that shuffled.
BROADCAST_ROWS = 2_000_000

_INSTRUMENT = """CASE substr(o_orderpriority,1,1) WHEN '1' THEN 'wires' WHEN '2' THEN 'cash'
    WHEN '3' THEN 'credit_cards' WHEN '4' THEN 'loans' ELSE 'ngi' END"""

# Some parties, counterparties and merchants have ids that no profile lists.
_PARTY = "concat(CASE WHEN c_acctbal<0 THEN 'U' ELSE 'P' END,o_custkey)"

FIXTURES = {
    "fx_transactions": f"""
SELECT concat('T',l_orderkey,'-',l_linenumber,'-',l_partkey,'-',l_suppkey) AS txn_id,
  {_PARTY} AS party_id, concat('A',o_orderkey) AS account_id,
  {_INSTRUMENT} AS instrument_type,
  {{days_o_orderdate}}*86400000 + CAST(l_quantity AS BIGINT)*86400000 + l_linenumber*3600000
    AS txn_timestamp_ms_utc,
  CASE WHEN l_returnflag='R' THEN 'credit' ELSE 'debit' END AS direction,
  l_extendedprice AS amount,
  CASE s_nationkey%7 WHEN 1 THEN 'EUR' WHEN 2 THEN 'GBP' WHEN 3 THEN 'CAD' WHEN 4 THEN 'MXN'
    WHEN 5 THEN 'JPY' ELSE 'USD' END AS currency,
  concat(CASE WHEN s_acctbal<0 THEN 'U' ELSE 'S' END,l_suppkey) AS counterparty_id,
  CASE WHEN l_linestatus='F' THEN concat(CASE WHEN p_size>45 THEN 'U' ELSE 'M' END,l_partkey) END
    AS merchant_id,
  CASE WHEN l_linestatus='F' THEN 'pos' ELSE 'online' END AS channel, n_name AS country,
  CASE WHEN l_partkey%3=0 THEN concat('R',n_regionkey) END AS state,
  CASE WHEN c_nationkey<>s_nationkey THEN 1 ELSE 0 END AS is_international,
  p_name AS description
FROM {{tx_tables}}""",
    "fx_parties": """
SELECT concat('P',c_custkey) AS party_id,
  CASE WHEN c_mktsegment IN ('HOUSEHOLD','FURNITURE') THEN 'individual' ELSE 'business' END
    AS party_type,
  c_name AS party_name,
  CASE WHEN c_mktsegment NOT IN ('HOUSEHOLD','FURNITURE') THEN lower(c_mktsegment) END AS industry,
  n_name AS country, CASE WHEN c_custkey%2=0 THEN concat('R',n_regionkey) END AS state,
  concat('20',CAST(10+c_custkey%10 AS {string}),'-01-15') AS onboarding_date,
  c_acctbal*10 AS expected_monthly_volume_usd, c_acctbal AS expected_avg_txn_usd,
  CASE c_custkey%3 WHEN 0 THEN 'low' WHEN 1 THEN 'medium' ELSE 'high' END AS risk_rating
FROM customer JOIN nation ON c_nationkey=n_nationkey""",
    "fx_counterparties": """
SELECT concat('S',s_suppkey) AS counterparty_id,
  CASE WHEN s_suppkey%2=0 THEN 'business' ELSE 'individual' END AS counterparty_type,
  n_name AS country
FROM supplier JOIN nation ON s_nationkey=n_nationkey""",
    "fx_merchants": """
SELECT concat('M',p_partkey) AS merchant_id, p_name AS merchant_name,
  p_type AS merchant_category, p_brand AS country,
  CASE WHEN p_size>25 THEN p_brand END AS state
FROM part""",
    "fx_alerts": f"""
SELECT concat('AL',o.o_orderkey) AS alert_id, {_PARTY} AS party_id,
  CAST(NULL AS {{string}}) AS party_type,
  {_INSTRUMENT} AS model_type,
  concat('v',1+o.o_orderkey%3) AS model_version, concat('SC',o.o_orderkey%4) AS scenario_code,
  {{days_o_orderdate}}*86400000 + (o.o_orderkey%86400)*1000 AS alert_timestamp_ms_utc,
  {{year_start_o_orderdate}}*86400000 AS window_start_ms_utc,
  {{year_end_o_orderdate}}*86400000-1 AS window_end_ms_utc,
  round(o_totalprice/5000,2) AS risk_score,
  CASE WHEN o_totalprice>=425000 THEN 'high' WHEN o_totalprice>=325000 THEN 'medium'
    ELSE 'low' END AS severity,
  concat('Total above limit, suspicious activity on order ',o.o_orderkey) AS trigger_summary,
  concat(coalesce(ids,''), CASE WHEN o.o_orderkey%10=0 THEN '||TMISSING' ELSE '' END)
    AS supporting_txn_ids,
  o_totalprice AS amount_total_usd, CAST(coalesce(n,0) AS INT) AS txn_count,
  concat('{{{{"k": ',o.o_orderkey%100,'}}}}') AS features_json,
  CASE WHEN o.o_orderkey%7=0 THEN 'late|partial' ELSE '' END AS data_quality_flags
FROM orders o JOIN customer ON o_custkey=c_custkey LEFT JOIN (
    SELECT account_id, {{ids}} AS ids, count(*) AS n FROM fx_transactions GROUP BY account_id
  ) x ON x.account_id=concat('A',o.o_orderkey)
WHERE o_totalprice>=250000""",
    "fx_policy_docs": """
SELECT concat('D',doc_id) AS doc_id, 'v1' AS version,
  {headed_text} AS text
FROM documents""",
    "fx_files": """
SELECT concat('/corpus/',source,'/D',doc_id,
  CASE doc_id%5 WHEN 1 THEN ' of two' WHEN 2 THEN '%20x' WHEN 3 THEN '+a_b' ELSE '' END,
  CASE WHEN source='src7' THEN '.html'
  WHEN lang='en' THEN '__v2.md' WHEN lang='de' THEN '.TXT' WHEN lang='fr' THEN '__v1__v3.markdown'
  ELSE '.notes.Md' END) AS path, CASE WHEN doc_id%50=7 THEN '' ELSE text END AS text
FROM documents""",
    "fx_amended_docs": """
SELECT p.doc_id, p.version,
  concat(p.text,chr(10),'## Amendment',chr(10),'Reviewed text of ',p.doc_id) AS text
FROM fx_policy_docs p JOIN documents d ON p.doc_id=concat('D',d.doc_id) WHERE d.lang='en'""",
    "fx_responses": """
SELECT concat('E',event_id) AS case_id, CASE WHEN event_id%16=1 THEN '{{bad'
  WHEN event_id%16=2 THEN '{{}}' ELSE concat(
  CASE event_id%16 WHEN 10 THEN concat('```json',chr(10)) WHEN 14 THEN concat(' ',chr(10)) ELSE '' END,
  '{{"case_summary":"s","key_indicators":[{{"text":"t"',
  CASE WHEN event_id%16=5 THEN '' ELSE ',"evidence_refs":["alerts[0]"]' END,
  '}}],"benign_explanations_to_rule_out":[{{"text":"b"',
  CASE WHEN event_id%16=12 THEN '' ELSE ',"policy_citations":["c"]' END, '}}],',
  '"policy_mapping":[{{"policy_ref":"p","rationale":"r","citations":',
  CASE WHEN event_id%16=6 THEN '[]' ELSE '[{{"citation":"c"}}]' END,
  '}}],"missing_information":[{{"text":"m"}}],"recommended_disposition":"file"',
  CASE event_id%16 WHEN 3 THEN '' WHEN 4 THEN ',"confidence":"0.5"'
    ELSE ',"confidence":0.5' END,
  ',"uncertainty_reasons":["u"],"investigator_next_steps":[{{"text":"n"',
  CASE WHEN event_id%16=7 THEN '' ELSE ',"evidence_refs":["x"]' END, '}}]}}',
  CASE event_id%16 WHEN 8 THEN concat(chr(10),'Let me know if you need more.')
    WHEN 9 THEN '{{"case_summary":"again"}}' WHEN 10 THEN concat(chr(10),'```') WHEN 11 THEN ','
    WHEN 13 THEN '}}' WHEN 14 THEN concat(chr(10),' ') WHEN 15 THEN ']' ELSE '' END) END AS raw_response
FROM events""",
    "fx_case_responses": """
SELECT case_id, concat('{{"case_summary":"Summary of ',case_id,
  '","key_indicators":[{{"text":"t","evidence_refs":["alerts[0]"]}}],',
  '"benign_explanations_to_rule_out":[{{"text":"b"',
  CASE WHEN right(case_id,1)='0' THEN '' ELSE ',"policy_citations":["c"]' END, '}}],',
  '"policy_mapping":[{{"policy_ref":"p","rationale":"r","citations":[{{"citation":"c"}}]}}],',
  '"missing_information":[],"recommended_disposition":"file","confidence":0.5,',
  '"uncertainty_reasons":[],"investigator_next_steps":[{{"text":"n","evidence_refs":["x"]}}]}}') AS raw_response
FROM cases""",
}

_DAY = "CAST(o_orderdate AS DATE)"
SPARK_SPELLING = {
    "string": "STRING",
    # Lines meet parts while they are narrow and then orders with their customers: two shuffles of all
    # lines, and those of an order are written side by side.
    "tx_tables": """lineitem JOIN part ON l_partkey=p_partkey
  JOIN (orders JOIN customer ON o_custkey=c_custkey) ON l_orderkey=o_orderkey
  JOIN supplier ON l_suppkey=s_suppkey JOIN nation ON s_nationkey=n_nationkey""",
    "days_o_orderdate": f"CAST(unix_date({_DAY}) AS BIGINT)",
    "year_start_o_orderdate": f"CAST(unix_date(trunc({_DAY},'YEAR')) AS BIGINT)",
    "year_end_o_orderdate": f"CAST(unix_date(add_months(trunc({_DAY},'YEAR'),12)) AS BIGINT)",
    "ids": r"array_join(sort_array(collect_set(txn_id)),'|')",
    "headed_text": """array_join(transform(split(text,chr(10)),
    (l,i) -> CASE WHEN i%4=0 THEN concat('## Part ',i%12,chr(10),l) ELSE l END), chr(10))""",
}
DUCKDB_SPELLING = {
    "string": "VARCHAR",
    "tx_tables": """lineitem JOIN orders ON l_orderkey=o_orderkey JOIN customer ON o_custkey=c_custkey
  JOIN supplier ON l_suppkey=s_suppkey JOIN nation ON s_nationkey=n_nationkey
  JOIN part ON l_partkey=p_partkey""",
    "days_o_orderdate": f"date_diff('day', DATE '1970-01-01', {_DAY})",
    "year_start_o_orderdate": (
        "date_diff('day', DATE '1970-01-01', CAST(date_trunc('year',o_orderdate) AS DATE))"
    ),
    "year_end_o_orderdate": (
        "date_diff('day', DATE '1970-01-01', "
        "CAST(date_trunc('year',o_orderdate) + INTERVAL 1 YEAR AS DATE))"
    ),
    "ids": "string_agg(DISTINCT txn_id,'|' ORDER BY txn_id)",
    "headed_text": """array_to_string(list_transform(string_split(text,chr(10)),
    lambda l, i: CASE WHEN (i-1)%4=0 THEN concat('## Part ',(i-1)%12,chr(10),l) ELSE l END), chr(10))""",
}


def fixture_sql(name: str, spelling: dict[str, str]) -> str:
    return FIXTURES[name].format(**spelling)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    if name == "supplier" and df.count() <= BROADCAST_ROWS:
        return F.broadcast(df)
    return spread(df) if name in HEAVY else df


def fixture(
    spark: SparkSession, sf_dir: str, name: str, given: Mapping[str, DataFrame] | None = None
) -> DataFrame:
    """A fixture as a lazy frame over the test tables; fixtures in ``given`` are not made again."""
    given = given or {}
    sql = fixture_sql(name, SPARK_SPELLING)
    for t in TABLES:
        if t in sql:
            table(spark, sf_dir, t).createOrReplaceTempView(t)
    for needed in FIXTURES:
        if needed in sql:
            made = given[needed] if needed in given else fixture(spark, sf_dir, needed)
            made.createOrReplaceTempView(needed)
    return spark.sql(sql)


def write_files(files: DataFrame, folder: str) -> None:
    """Write the text of each row under its path below ``folder``, a file per row."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = pa.fs.FileSystem.from_uri(folder if "://" in folder else f"file://{folder.removeprefix('file:')}")
        for batch in batches:
            for path, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                name = root + path
                system.create_dir(name.rpartition("/")[0], recursive=True)
                with system.open_output_stream(name) as out:
                    out.write((text or "").encode())
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64())], names=["files"])

    files.select("path", "text").mapInArrow(work, "files long").agg(F.sum("files")).collect()


_WRITTEN: dict[tuple[str, str], str] = {}


def inputs(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """The five input tables.  They are written once per application and data folder,
    as the engine's real inputs are files, not a join over other tables."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _WRITTEN:
        base = scratch_path(spark, "inputs")
        given: dict[str, DataFrame] = {}
        # Alerts list transactions: these are written first and read for them, not joined again.
        for name in sorted(schemas.INPUTS, key=lambda n: n != "transactions"):
            df = fixture(spark, sf_dir, f"fx_{name}", given)
            typed = [df[f.name].cast(f.dataType) for f in schemas.schema(name)]
            df.select(*typed).write.options(**COMPRESSED).parquet(f"{base}/{name}")
            give_back(spark, f"{base}/{name}")
            if name == "transactions":
                rows = spark.read.schema(schemas.schema(name)).parquet(f"{base}/{name}")
                # Dealt out by account before they are grouped: ids of one account are hardly ever
                # combined before a shuffle.
                given[f"fx_{name}"] = rows.select("account_id", "txn_id").repartition("account_id")
        _WRITTEN[key] = base
    return {
        name: spark.read.schema(schemas.schema(name)).parquet(f"{_WRITTEN[key]}/{name}")
        for name in schemas.INPUTS
    }
