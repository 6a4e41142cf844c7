"""Registered queries: each operator over the whole test tables, as flat rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from caseloom import schemas
from caseloom.functions.cases import pipe_items
from caseloom.functions.embedding import token_codes, token_weights, unit
from caseloom.operators import cases as C
from caseloom.operators import evidence as E
from caseloom.operators import policy, review, triage
from caseloom.operators.nearest import nearest
from caseloom.operators.packet import CaseFrames, Limits, packet_json, with_case_id
from caseloom.operators.partials import DayPartials
from caseloom.plans import daily, incremental, policy_index
from caseloom.plans.views import register_views
from caseloom.session import scratch_path, stage
from caseloom.sources import contract, corpus, datasets, drops

from checks.fixtures import fixture, inputs, table, write_files

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

# A cut that bites on the small groups of the test data.
SHORT = Limits(supporting_transactions=3, top_counterparties=3, top_merchants=3)

RUN_EPOCHS = (1_700_000_000, 1_700_100_000)
MODEL = "drafting-model"
# 1 June 1998: what is later comes with the second run or drop.
SECOND_RUN_MS = 896_659_200_000


def register(query: Query) -> Query:
    QUERIES[query.__name__] = query
    return query


def usd6(column: str) -> Column:
    """Money rounded to where the order of summation no longer shows."""
    return F.round(column, 6).alias(column)


def joined(column: str) -> Column:
    return F.array_join(column, ",").alias(column)


def frames(spark: SparkSession, sf: str, limits: Limits = SHORT, staged: bool = False) -> CaseFrames:
    return CaseFrames(inputs(spark, sf), limits, staged)


_WRITTEN: dict[tuple[str, str], str] = {}


def written(spark: SparkSession, sf: str, name: str) -> DataFrame:
    """A dataset of the daily job, which runs once per session and data folder."""
    key = (spark.sparkContext.applicationId, sf)
    if key not in _WRITTEN:
        out = scratch_path(spark, "datasets")
        daily.run(spark, inputs(spark, sf), out)
        _WRITTEN[key] = out
    return datasets.read_dataset(spark, _WRITTEN[key], name)


# --- sources and sinks --------------------------------------------------------------


@register
def csv_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch_path(spark, "csv")
    datasets.write_csv(inputs(spark, sf)["transactions"], path)
    return datasets.read_csv(spark, path, schemas.schema("transactions"), match_header=True)


@register
def alerts_multi_file_scan(spark: SparkSession, sf: str) -> DataFrame:
    base = scratch_path(spark, "alerts")
    alerts = inputs(spark, sf)["alerts"]
    for model in ("cash", "wires", "credit_cards", "loans", "ngi"):
        part = alerts.where(F.col("model_type") == model)
        datasets.write_csv(part, f"{base}/alerts_{model}.csv")
    return datasets.read_csv(spark, f"{base}/alerts_*.csv", schemas.schema("alerts"))


@register
def alerts_by_drops(spark: SparkSession, sf: str) -> DataFrame:
    """Alert files in two drops, the second of which brings the first one's again."""
    root, schema = scratch_path(spark, "drops"), schemas.schema("alerts")
    alerts = inputs(spark, sf)["alerts"]
    for day in ("1", "2"):
        for again in ("1", "2")[: int(day)]:
            rows = alerts.where((F.col("alert_timestamp_ms_utc") >= SECOND_RUN_MS) == F.lit(again == "2"))
            # One file of a fixed name per model family and drop.
            for model in ("cash", "wires", "credit_cards", "loans", "ngi"):
                part = rows.where(F.col("model_type") == model)
                datasets.write_named_csv(part, f"{root}/in/{day}", f"alerts_{model}_{again}.csv")
        drops.take_drops(spark, f"{root}/in/*", schema, f"{root}/store")
    return drops.read_drops(spark, schema, f"{root}/store").drop("source_file")


@register
def parquet_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch_path(spark, "roundtrip")
    datasets.write_by_case(frames(spark, sf).timeline_daily, f"{path}/tx_timeline_daily")
    rows = datasets.read_dataset(spark, path, "tx_timeline_daily")
    return rows.withColumn("amount_total_usd", usd6("amount_total_usd"))


def _high_alert_cases(spark: SparkSession, sf: str) -> DataFrame:
    alerts = C.alerts_in_cases(inputs(spark, sf)["alerts"])
    return with_case_id(alerts.where(F.col("severity") == "high"))


@register
def case_lookup(spark: SparkSession, sf: str) -> DataFrame:
    packets = triage.of_cases(written(spark, sf, "case_packet"), _high_alert_cases(spark, sf))
    return packets.select(
        "case_id", "party_id", "party_name", "alerts_high", "txn_count_case",
        F.size("alerts").alias("listed_alerts"),
    )


@register
def timeline_lookup(spark: SparkSession, sf: str) -> DataFrame:
    days = triage.of_cases(written(spark, sf, "tx_timeline_daily"), _high_alert_cases(spark, sf))
    order = Window.partitionBy("case_id").orderBy("txn_date_utc", "instrument_type")
    return days.withColumn("place", F.row_number().over(order)).withColumn(
        "amount_total_usd", usd6("amount_total_usd")
    )


@register
def policy_docs(spark: SparkSession, sf: str) -> DataFrame:
    """Files with blanks, percent and plus signs in their names, some of them empty."""
    folder = scratch_path(spark, "files") + "/corpus"
    write_files(fixture(spark, sf, "fx_files"), folder.removesuffix("/corpus"))
    docs = corpus.read_corpus(spark, folder)
    below = F.concat(F.lit("/corpus/"), F.substring_index("source_path", "/corpus/", -1))
    return docs.select(
        "doc_id", "version", "title", below.alias("source_path"),
        F.sha2("text", 256).alias("content_hash"), F.length("text").alias("chars"),
    )


@register
def schema_contract(spark: SparkSession, sf: str) -> DataFrame:
    """All inputs and outputs, and merchants that break each rule."""
    tables = inputs(spark, sf)
    merchants = tables["merchants"]
    for name in schemas.OUTPUTS:
        tables = {**tables, name: written(spark, sf, name)}
    broken = merchants.unionByName(merchants).drop("merchant_category").withColumns(
        {"state": F.lit(1), "extra": F.lit(1), "country": F.nullif("country", F.lit("US"))}
    )
    found = contract.check({"merchants": broken}).withColumn("table", F.lit("broken merchants"))
    return contract.check(tables).unionByName(found)


@register
def contract_offenders(spark: SparkSession, sf: str) -> DataFrame:
    """The first keys that break a rule, among merchants of which some are doubled or lack a country."""
    merchants = inputs(spark, sf)["merchants"]
    doubled = merchants.where(F.col("merchant_category").startswith("PROMO"))
    broken = merchants.unionByName(doubled).withColumn("country", F.nullif("country", F.lit("Brand#13")))
    return contract.offending({"merchants": broken}, each=7)


@register
def dataset_counts(spark: SparkSession, sf: str) -> DataFrame:
    return datasets.row_counts(inputs(spark, sf))


# --- cases and their figures --------------------------------------------------------


@register
def parse_id_list(spark: SparkSession, sf: str) -> DataFrame:
    items = F.posexplode(pipe_items("supporting_txn_ids")).alias("place", "txn_id")
    return inputs(spark, sf)["alerts"].select("alert_id", items)


@register
def fx_normalize(spark: SparkSession, sf: str) -> DataFrame:
    rows = C.with_usd(inputs(spark, sf)["transactions"])
    return rows.select("txn_id", "currency", "amount", usd6("amount_usd"))


@register
def case_index(spark: SparkSession, sf: str) -> DataFrame:
    return with_case_id(frames(spark, sf).cases)


@register
def case_party(spark: SparkSession, sf: str) -> DataFrame:
    return with_case_id(frames(spark, sf).case_party)


@register
def alerts_case(spark: SparkSession, sf: str) -> DataFrame:
    return with_case_id(frames(spark, sf).alerts_case).withColumn(
        "supporting_txn_id_arr", joined("supporting_txn_id_arr")
    )


@register
def tx_case(spark: SparkSession, sf: str) -> DataFrame:
    return with_case_id(frames(spark, sf).tx_case).withColumn("amount_usd", usd6("amount_usd"))


@register
def alerts_summary(spark: SparkSession, sf: str) -> DataFrame:
    return with_case_id(frames(spark, sf).alerts_summary).withColumns(
        {c: joined(c) for c in ("model_types", "scenario_codes", "severities")}
    )


@register
def alerts_details(spark: SparkSession, sf: str) -> DataFrame:
    pages = with_case_id(frames(spark, sf).alert_pages)
    return pages.select(
        "case_id", "party_id", "page", F.posexplode("alerts").alias("place", "alert")
    ).select("case_id", "party_id", "page", "place", "alert.*")


@register
def tx_summary(spark: SparkSession, sf: str) -> DataFrame:
    return with_case_id(frames(spark, sf, staged=True).tx_summary).withColumns(
        {
            "instrument_types_case": joined("instrument_types_case"),
            **{
                c: usd6(c)
                for c in ("amount_total_usd_case", "median_amount_usd_case", "max_amount_usd_case")
            },
        }
    )


def _totals(df: DataFrame) -> DataFrame:
    return with_case_id(df).withColumn("amount_total_usd", usd6("amount_total_usd"))


@register
def instrument_breakdown(spark: SparkSession, sf: str) -> DataFrame:
    return _totals(frames(spark, sf).instrument_breakdown)


@register
def counterparty_totals(spark: SparkSession, sf: str) -> DataFrame:
    return _totals(C.counterparty_totals(frames(spark, sf).tx_case))


@register
def merchant_totals(spark: SparkSession, sf: str) -> DataFrame:
    return _totals(C.merchant_totals(frames(spark, sf).tx_case))


@register
def tx_timeline_daily(spark: SparkSession, sf: str) -> DataFrame:
    return frames(spark, sf).timeline_daily.withColumn(
        "amount_total_usd", usd6("amount_total_usd")
    )


@register
def alerts_by_model(spark: SparkSession, sf: str) -> DataFrame:
    return C.alerts_by_model(inputs(spark, sf)["alerts"])


# --- the same figures from daily partials -------------------------------------------


def _by_day(spark: SparkSession, sf: str, limits: Limits = SHORT) -> CaseFrames:
    return CaseFrames(inputs(spark, sf), limits, staged=True, by_day=True)


def _summary(df: DataFrame) -> DataFrame:
    money = ("amount_total_usd_case", "median_amount_usd_case", "max_amount_usd_case")
    columns = {"instrument_types_case": joined("instrument_types_case"), **{c: usd6(c) for c in money}}
    return with_case_id(df).withColumns(columns)


@register
def tx_summary_by_day(spark: SparkSession, sf: str) -> DataFrame:
    return _summary(_by_day(spark, sf).tx_summary)


@register
def instrument_breakdown_by_day(spark: SparkSession, sf: str) -> DataFrame:
    return _totals(_by_day(spark, sf).instrument_breakdown)


@register
def counterparty_totals_by_day(spark: SparkSession, sf: str) -> DataFrame:
    return _totals(_by_day(spark, sf).counterparty_totals)


@register
def merchant_totals_by_day(spark: SparkSession, sf: str) -> DataFrame:
    return _totals(_by_day(spark, sf).merchant_totals)


@register
def tx_timeline_by_day(spark: SparkSession, sf: str) -> DataFrame:
    return _by_day(spark, sf).timeline_daily.withColumn("amount_total_usd", usd6("amount_total_usd"))


@register
def case_packet_by_day(spark: SparkSession, sf: str) -> DataFrame:
    return flat_packet(_by_day(spark, sf, Limits()).packet)


@register
def rolling_tx_summary(spark: SparkSession, sf: str) -> DataFrame:
    """Figures of the 400 days before each alert: windows that overlap and cut days at both ends."""
    tables = inputs(spark, sf)
    end = F.col("alert_timestamp_ms_utc")
    windows = tables["alerts"].select(
        "party_id", (end - 400 * 86_400_000).alias("case_window_start_ms_utc"), end.alias("case_window_end_ms_utc")
    ).distinct()
    return _summary(DayPartials(C.with_usd(tables["transactions"]), windows).tx_summary())


# --- datasets kept up to date -------------------------------------------------------


def _kept_up(spark: SparkSession, sf: str) -> str:
    """Datasets of two runs: everything but the last months, then these and the merchants of a brand."""
    tables = inputs(spark, sf)
    late = {
        "transactions": F.col("txn_timestamp_ms_utc") >= SECOND_RUN_MS,
        "alerts": F.col("alert_timestamp_ms_utc") >= SECOND_RUN_MS,
        "merchants": F.col("country") == "Brand#13",
    }
    root = scratch_path(spark, "kept-up")
    before = {name: df.where(~late[name]) if name in late else df for name, df in tables.items()}
    renamed = F.when(late["merchants"], F.lit("?")).otherwise(F.col("merchant_name"))
    before["merchants"] = tables["merchants"].withColumn("merchant_name", renamed)
    incremental.first_run(spark, before, root, "1", slices=16)
    incremental.apply(spark, tables, {name: tables[name].where(late[name]) for name in late}, root, "2")
    return root


@register
def case_packet_kept_up(spark: SparkSession, sf: str) -> DataFrame:
    return flat_packet(incremental.read(spark, _kept_up(spark, sf), "case_packet"))


@register
def triage_page_kept_up(spark: SparkSession, sf: str) -> DataFrame:
    """A page of the queue after two runs, from the bands of the risk score that it lies in."""
    page = incremental.queue_page(spark, _kept_up(spark, sf), limit=500, offset=300)
    return page.withColumn("amount_total_usd_case", usd6("amount_total_usd_case"))


@register
def tx_timeline_kept_up(spark: SparkSession, sf: str) -> DataFrame:
    rows = incremental.read(spark, _kept_up(spark, sf), "tx_timeline_daily")
    return rows.withColumn("amount_total_usd", usd6("amount_total_usd"))


# --- ranked lists -------------------------------------------------------------------


@register
def top_counterparties(spark: SparkSession, sf: str) -> DataFrame:
    return _totals(frames(spark, sf).top_counterparties)


@register
def top_merchants(spark: SparkSession, sf: str) -> DataFrame:
    return _totals(frames(spark, sf).top_merchants)


@register
def supporting_ids(spark: SparkSession, sf: str) -> DataFrame:
    return with_case_id(frames(spark, sf).supporting_ids)


@register
def supporting_transactions(spark: SparkSession, sf: str) -> DataFrame:
    lists = with_case_id(E.supporting_list(frames(spark, sf).supporting_transactions))
    return lists.select(
        "case_id", "party_id", F.posexplode("supporting_transactions").alias("place", "txn")
    ).select("case_id", "party_id", "place", "txn.*")


# --- packet -------------------------------------------------------------------------


def _ids(items: str, field: str) -> Column:
    return F.array_join(F.transform(items, lambda i: i[field]), ",").alias(items)


def flat_packet(packet: DataFrame) -> DataFrame:
    """The packet with every list as the text of its ids in order."""
    sets = ("model_types", "scenario_codes", "severities", "instrument_types_case")
    money = ("amount_total_usd_case", "median_amount_usd_case", "max_amount_usd_case")
    return packet.withColumns(
        {
            **{c: joined(c) for c in sets},
            **{c: usd6(c) for c in money},
            "alerts": _ids("alerts", "alert_id"),
            "top_counterparties": _ids("top_counterparties", "counterparty_id"),
            "top_merchants": _ids("top_merchants", "merchant_id"),
            "supporting_transactions": _ids("supporting_transactions", "txn_id"),
        }
    )


@register
def case_packet(spark: SparkSession, sf: str) -> DataFrame:
    return flat_packet(frames(spark, sf, Limits(), staged=True).packet)


@register
def case_packet_json(spark: SparkSession, sf: str) -> DataFrame:
    text = packet_json(frames(spark, sf, Limits(), staged=True).pages)
    # The text is read back in one pass.
    shape = """case_id STRING, party STRUCT<party_id: STRING, industry: STRING, expected_avg_txn_usd: DOUBLE>,
        window STRUCT<end_ms_utc: BIGINT>,
        alerts_summary STRUCT<alerts_count: BIGINT, scenario_codes: ARRAY<STRING>>,
        alerts ARRAY<STRUCT<alert_id: STRING>>,
        tx_summary STRUCT<txn_count_case: BIGINT, amount_total_usd_case: DOUBLE>,
        top_counterparties ARRAY<STRUCT<counterparty_id: STRING>>,
        top_merchants ARRAY<STRUCT<merchant_id: STRING>>,
        supporting_transactions ARRAY<STRUCT<txn_id: STRING>>"""
    read = text.select("case_id", F.from_json("case_packet_json", shape).alias("read"))
    return read.select(F.col("case_id").alias("row_id"), "read.*").select(
        "row_id", "case_id", "party.*", "window.*", "alerts_summary.alerts_count",
        F.array_join("alerts_summary.scenario_codes", ",").alias("scenario_codes"),
        _ids("alerts", "alert_id"),
        "tx_summary.txn_count_case",
        F.round("tx_summary.amount_total_usd_case", 6).alias("amount_total_usd_case"),
        _ids("top_counterparties", "counterparty_id"),
        _ids("top_merchants", "merchant_id"),
        _ids("supporting_transactions", "txn_id"),
    )


@register
def case_packet_json_pages(spark: SparkSession, sf: str) -> DataFrame:
    """Every alert of every case, from JSON texts of two alerts each."""
    text = packet_json(frames(spark, sf, Limits(alert_page=2), staged=True).pages)
    shape = "alerts ARRAY<STRUCT<alert_id: STRING>>, alert_page INT, alert_pages INT"
    read = text.select("case_id", "page", "pages", F.from_json("case_packet_json", shape).alias("read"))
    return read.select(
        "case_id", "page", "pages", F.col("read.alert_page").alias("told_page"),
        F.col("read.alert_pages").alias("told_pages"), F.posexplode("read.alerts").alias("place", "alert"),
    ).select("case_id", "page", "pages", "told_page", "told_pages", "place", "alert.alert_id")


# --- queue and views ----------------------------------------------------------------


@register
def triage_queue(spark: SparkSession, sf: str) -> DataFrame:
    queue = triage.numbered_queue(written(spark, sf, "case_packet"))
    return queue.withColumn("amount_total_usd_case", usd6("amount_total_usd_case"))


@register
def triage_page(spark: SparkSession, sf: str) -> DataFrame:
    page = triage.page(written(spark, sf, "case_packet"), limit=10_000, offset=25)
    return page.withColumn("amount_total_usd_case", usd6("amount_total_usd_case"))


@register
def triage_deep_page(spark: SparkSession, sf: str) -> DataFrame:
    page = triage.stored_page(written(spark, sf, "case_queue"), limit=500, offset=300)
    return page.withColumn("amount_total_usd_case", usd6("amount_total_usd_case"))


@register
def top_risk_cases(spark: SparkSession, sf: str) -> DataFrame:
    top = triage.highest_risk(written(spark, sf, "case_packet"))
    return top.withColumn("amount_total_usd_case", usd6("amount_total_usd_case"))


@register
def case_counterparties(spark: SparkSession, sf: str) -> DataFrame:
    packets = written(spark, sf, "case_packet")
    riskiest = triage.highest_risk(packets, 1).select("case_id").scalar()
    rows = triage.case_counterparties(packets, riskiest)
    return rows.withColumn("amount_total_usd", usd6("amount_total_usd"))


# Views that read the case transactions more than once.
STAGED_VIEWS = ("v_case_queue", "v_case_packet")


def _view(spark: SparkSession, sf: str, name: str) -> DataFrame:
    """A view of one frame joins its own columns only and writes no table for others."""
    register_views(spark, frames(spark, sf, staged=name in STAGED_VIEWS), [name])
    return spark.table(name)


@register
def v_alert_summary(spark: SparkSession, sf: str) -> DataFrame:
    return _view(spark, sf, "v_alert_summary").withColumns(
        {c: joined(c) for c in ("model_types", "scenario_codes", "severities")}
    )


@register
def v_instrument_breakdown(spark: SparkSession, sf: str) -> DataFrame:
    view = _view(spark, sf, "v_instrument_breakdown")
    return view.withColumn("amount_total_usd", usd6("amount_total_usd"))


@register
def v_tx_timeline_daily(spark: SparkSession, sf: str) -> DataFrame:
    view = _view(spark, sf, "v_tx_timeline_daily")
    return view.withColumn("amount_total_usd", usd6("amount_total_usd"))


@register
def v_top_counterparties(spark: SparkSession, sf: str) -> DataFrame:
    view = _view(spark, sf, "v_top_counterparties")
    return view.withColumn("amount_total_usd", usd6("amount_total_usd"))


@register
def v_top_merchants(spark: SparkSession, sf: str) -> DataFrame:
    view = _view(spark, sf, "v_top_merchants")
    return view.withColumn("amount_total_usd", usd6("amount_total_usd"))


@register
def v_supporting_transactions(spark: SparkSession, sf: str) -> DataFrame:
    return _view(spark, sf, "v_supporting_transactions")


@register
def v_case_queue(spark: SparkSession, sf: str) -> DataFrame:
    view = _view(spark, sf, "v_case_queue")
    return view.withColumn("amount_total_usd_case", usd6("amount_total_usd_case"))


@register
def v_case_packet(spark: SparkSession, sf: str) -> DataFrame:
    return flat_packet(_view(spark, sf, "v_case_packet"))


# --- policy text --------------------------------------------------------------------


@register
def policy_sections(spark: SparkSession, sf: str) -> DataFrame:
    return policy.sections(fixture(spark, sf, "fx_policy_docs"))


@register
def policy_chunks(spark: SparkSession, sf: str) -> DataFrame:
    return policy.chunks(fixture(spark, sf, "fx_policy_docs"))


@register
def hash_embed(spark: SparkSession, sf: str) -> DataFrame:
    vectors = table(spark, sf, "documents").select(
        "doc_id", token_weights(token_codes("text")).alias("weights")
    )
    parts = vectors.select("doc_id", F.posexplode(unit("weights")).alias("bucket", "value"))
    return parts.where(F.col("value") != 0).withColumn("value", usd6("value"))


@register
def embedding_topk(spark: SparkSession, sf: str) -> DataFrame:
    vectors = stage(
        table(spark, sf, "embeddings").select(
            F.col("vec_id").alias("query_id"),
            F.col("embedding").cast("array<double>").alias("vector"),
        ),
        "vectors",
    )
    best = nearest(vectors, vectors.withColumnRenamed("query_id", "item_id"), 5, decimals=9)
    return best.withColumn("score", usd6("score"))


def _policy_index(spark: SparkSession, sf: str) -> DataFrame:
    chunks = policy.chunks(fixture(spark, sf, "fx_policy_docs"))
    return stage(policy.embed(policy.upsert_chunks(chunks.limit(0), chunks)), "policy-index")


@register
def case_query_text(spark: SparkSession, sf: str) -> DataFrame:
    return policy.case_queries(written(spark, sf, "case_packet"))


@register
def policy_retrieval(spark: SparkSession, sf: str) -> DataFrame:
    """Passages for every case and for every benchmark text."""
    cases = policy.case_queries(written(spark, sf, "case_packet")).withColumnRenamed(
        "case_id", "query_id"
    )
    texts = table(spark, sf, "benchmark").select(
        F.concat(F.lit("B"), F.col("item_id")).alias("query_id"), F.col("text").alias("query")
    )
    found = policy.passages(cases.unionByName(texts), _policy_index(spark, sf))
    return found.select(
        "query_id", "rank", "chunk_id", "doc_id", "version", "section", "citation",
        F.length("passage").alias("chars"), usd6("score"),
    )


@register
def index_stats(spark: SparkSession, sf: str) -> DataFrame:
    docs = fixture(spark, sf, "fx_policy_docs")
    return policy.index_stats(docs, policy.chunks(docs))


@register
def policy_upsert(spark: SparkSession, sf: str) -> DataFrame:
    """English documents are issued again with a further section."""
    old = fixture(spark, sf, "fx_policy_docs").withColumns(
        {"title": F.col("doc_id"), "source_path": F.concat(F.lit("/old/"), F.col("doc_id"))}
    )
    new = fixture(spark, sf, "fx_amended_docs").withColumns(
        {"title": F.col("doc_id"), "source_path": F.concat(F.lit("/new/"), F.col("doc_id"))}
    )
    documents = policy.upsert_documents(policy.document_entries(old), policy.document_entries(new))
    chunks = policy.upsert_chunks(policy.chunks(old), policy.chunks(new))
    return documents.select(
        F.lit("document").alias("kind"), "doc_id", F.col("source_path").alias("entry"),
        "content_hash",
    ).unionByName(
        chunks.select(
            F.lit("chunk").alias("kind"), "doc_id", F.col("chunk_id").alias("entry"),
            F.sha2("text", 256).alias("content_hash"),
        )
    )


@register
def policy_index_run(spark: SparkSession, sf: str) -> DataFrame:
    """The stored index after two generations: all documents, then the amended English ones."""
    root = scratch_path(spark, "policy")
    for generation, name in (("1", "fx_policy_docs"), ("2", "fx_amended_docs")):
        docs = fixture(spark, sf, name).withColumns(
            {"title": F.col("doc_id"), "source_path": F.concat(F.lit(f"/{generation}/"), F.col("doc_id"))}
        )
        policy_index.update(spark, docs, root, generation)
    documents = spark.read.parquet(f"{root}/2/documents")
    return documents.select(
        F.lit("document").alias("kind"), "doc_id", F.col("source_path").alias("entry"),
        "content_hash",
    ).unionByName(
        policy_index.read_index(spark, root).select(
            F.lit("chunk").alias("kind"), "doc_id", F.col("chunk_id").alias("entry"),
            F.sha2("text", 256).alias("content_hash"),
        )
    )


@register
def policy_index_generations(spark: SparkSession, sf: str) -> DataFrame:
    """The stored index after three generations: all documents, the amended English ones, and all again
    in their first wording.  Chunks are listed with the generation that they were embedded in."""
    root = scratch_path(spark, "policy")
    for generation, name in (("1", "fx_policy_docs"), ("2", "fx_amended_docs"), ("3", "fx_policy_docs")):
        docs = fixture(spark, sf, name).withColumns(
            {"title": F.col("doc_id"), "source_path": F.concat(F.lit(f"/{generation}/"), F.col("doc_id"))}
        )
        policy_index.update(spark, docs, root, generation)
    born = F.regexp_extract(F.col("_metadata.file_path"), "/([^/]*)/chunks/", 1)
    stored = [spark.read.parquet(f"{root}/{g}/chunks").select("chunk_id", born.alias("born")) for g in ("1", "2")]
    chunks = policy_index.read_index(spark, root).join(stored[0].unionByName(stored[1]), "chunk_id")
    return policy_index.read_documents(spark, root).select(
        F.lit("document").alias("kind"), "doc_id", F.col("source_path").alias("entry"), "content_hash",
        F.lit("3").alias("born"),
    ).unionByName(
        chunks.select(
            F.lit("chunk").alias("kind"), "doc_id", F.col("chunk_id").alias("entry"),
            F.sha2("text", 256).alias("content_hash"), "born",
        )
    )


# --- drafted summaries --------------------------------------------------------------


@register
def copilot_prompts(spark: SparkSession, sf: str) -> DataFrame:
    packets = written(spark, sf, "case_packet")
    queries = policy.case_queries(packets).withColumnRenamed("case_id", "query_id")
    prompts = review.prompts(packets, policy.passages(queries, _policy_index(spark, sf)))

    shape = """case_packet STRUCT<party_id: STRING, alerts_count: BIGINT, alerts: ARRAY<STRING>>,
        policy_passages ARRAY<STRUCT<chunk_id: STRING, doc_id: STRING>>,
        schema STRUCT<required: ARRAY<STRING>>"""
    read = prompts.select(
        "case_id", "prompt_version", F.from_json("user_message", shape).alias("read")
    )
    return read.select("case_id", "prompt_version", "read.*").select(
        "case_id",
        "prompt_version",
        "case_packet.party_id",
        "case_packet.alerts_count",
        F.size("case_packet.alerts").alias("alerts"),
        F.array_join("policy_passages.chunk_id", ",").alias("chunks"),
        F.array_join("policy_passages.doc_id", ",").alias("documents"),
        F.size("schema.required").alias("required_fields"),
    )


@register
def copilot_prompt_pages(spark: SparkSession, sf: str) -> DataFrame:
    """Every alert of every case, from the messages of pages of two alerts each."""
    pages = stage(frames(spark, sf, Limits(alert_page=2), staged=True).pages, "pages")
    queries = policy.case_queries(pages.where("page = 0")).withColumnRenamed("case_id", "query_id")
    prompts = review.prompts(pages, policy.passages(queries, _policy_index(spark, sf)))
    shape = """case_packet STRUCT<page: INT, pages: INT, alerts: ARRAY<STRUCT<alert_id: STRING>>>,
        policy_passages ARRAY<STRUCT<chunk_id: STRING>>"""
    read = prompts.select("case_id", "page", F.from_json("user_message", shape).alias("read"))
    return read.select(
        "case_id", "page", F.col("read.case_packet.page").alias("told_page"), F.col("read.case_packet.pages").alias("pages"),
        F.size("read.policy_passages").alias("passages"), F.posexplode("read.case_packet.alerts").alias("place", "alert"),
    ).select("case_id", "page", "told_page", "pages", "passages", "place", "alert.alert_id")


@register
def copilot_validation(spark: SparkSession, sf: str) -> DataFrame:
    return review.validate(fixture(spark, sf, "fx_responses")).select("case_id", "error")


@register
def copilot_runs(spark: SparkSession, sf: str) -> DataFrame:
    """Two runs for all cases in one log, each delivered twice, with the packets and passages of their
    prompts."""
    packets = written(spark, sf, "case_packet")
    queries = policy.case_queries(packets).withColumnRenamed("case_id", "query_id")
    prompted = review.prompts(packets, policy.passages(queries, _policy_index(spark, sf)))
    # A record holds these; the messages are made of them.
    prompted = stage(prompted.select("case_id", "packet", "policy_passages"), "prompts")
    packets.select("case_id").createOrReplaceTempView("cases")
    checked = review.validate(fixture(spark, sf, "fx_case_responses"))
    path = scratch_path(spark, "runs")
    for epoch in (*RUN_EPOCHS, *RUN_EPOCHS):
        review.commit_run(review.run_log(checked, prompted, MODEL, epoch), path, f"run-{epoch}")
    shape = "party_id STRING, alerts_count BIGINT, alerts ARRAY<STRING>"
    read = F.from_json("packet", shape)
    chunks = F.from_json("policy_passages", "ARRAY<STRUCT<chunk_id: STRING>>")["chunk_id"]
    return review.committed_runs(spark, path).select(
        "run_id", "case_id", read["party_id"].alias("party_id"), read["alerts_count"].alias("alerts_count"),
        F.size(read["alerts"]).alias("alerts"), F.array_join(chunks, ",").alias("chunks"),
        F.get_json_object("response", "$.case_summary").alias("case_summary"),
        F.size(F.json_object_keys("response")).alias("answered_fields"),
        "raw_response", "prompt_version", "model", F.col("run_date").cast("string").alias("run_date"),
    )
