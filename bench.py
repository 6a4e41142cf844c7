"""Headline queries at ``$BENCH_SF_DIR`` on ``local[$BENCH_CPUS]``; prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import DataFrame

from caseloom.session import build_session
from checks import queries as Q
from checks.fixtures import inputs

HEADLINES = (
    "case_index alerts_summary tx_case tx_summary tx_timeline_daily top_counterparties "
    "top_merchants supporting_transactions alerts_details case_packet case_packet_json "
    "triage_queue triage_page case_lookup policy_chunks hash_embed embedding_topk "
    "policy_retrieval copilot_prompts copilot_validation schema_contract"
).split()


def run(df: DataFrame) -> None:
    """Compute every row and column without a sink."""
    df.write.format("noop").mode("overwrite").save()


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        "bench",
        **{
            "spark.master": f"local[{cpus}]",
            "spark.sql.shuffle.partitions": cpus,
            "spark.driver.memory": os.environ.get("BENCH_MEMORY", "8g"),
            "spark.ui.enabled": "false",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    seconds: dict[str, float] = {}

    def timed(name: str, action) -> None:
        start = time.perf_counter()
        action()
        seconds[name] = round(time.perf_counter() - start, 3)

    spark.range(1).count()
    # The engine reads files, so the inputs are written first; then the daily job
    # writes the datasets that the read queries use.
    timed("inputs", lambda: inputs(spark, sf_dir))
    timed("daily_job", lambda: Q.written(spark, sf_dir, "case_packet"))
    for name in HEADLINES:
        timed(name, lambda: run(Q.QUERIES[name](spark, sf_dir)))
    spark.stop()
    headline = {k: v for k, v in seconds.items() if k != "inputs"}
    print(
        json.dumps(
            {
                "metric": "headline queries, total",
                "value": round(sum(headline.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
