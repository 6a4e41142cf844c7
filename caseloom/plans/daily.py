"""The daily job: input files to the case datasets."""

from __future__ import annotations

import argparse
import logging
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from caseloom import schemas
from caseloom.operators.packet import CaseFrames, Limits, packet_json, paged
from caseloom.operators.triage import numbered_queue
from caseloom.session import COMPRESSED, build_session, give_back, staging, stored_bytes
from caseloom.sources import contract
from caseloom.sources.datasets import file_count, read_dataset, read_inputs, write_by_case

log = logging.getLogger(__name__)


def run(
    spark: SparkSession,
    inputs: Mapping[str, DataFrame],
    out: str,
    limits: Limits = Limits(),
    files: int | None = None,
    checked: bool = True,
) -> None:
    """Write the packet, its JSON form, further alert pages, timeline, queue and contract.

    The packet is computed once; its JSON form, in which every alert is, and the queue are
    made from the written datasets.  ``files`` is the number of files of a dataset laid out by
    case; without it, it follows from the size of the staged case transactions.  The contract
    is the check of inputs and outputs, which reads each of them once more; ``checked=False``
    leaves it out.  What the run stages is deleted at its end.
    """
    with staging(spark) as staged:
        frames = CaseFrames(inputs, limits)
        if files is None:
            frames.tx_case  # staged here
            files = file_count(spark, sum(stored_bytes(spark, path) for path in staged()))
        _write(spark, frames, out, files)
    if checked:
        tables = dict(inputs)
        for name in schemas.OUTPUTS:
            tables[name] = spark.read.parquet(f"{out}/{name}")
        contract.check(tables).coalesce(1).write.mode("overwrite").parquet(f"{out}/contract")


def _write(spark: SparkSession, frames: CaseFrames, out: str, files: int) -> None:
    write_by_case(frames.packet, f"{out}/case_packet", files)
    packet = read_dataset(spark, out, "case_packet")
    # Pages of one case are many and large, so they stay spread as they are.
    further = frames.further_alerts
    further.write.options(**COMPRESSED).mode("overwrite").parquet(f"{out}/case_further_alerts")
    further = spark.read.schema(further.schema).parquet(f"{out}/case_further_alerts")
    _write_json(packet, further, f"{out}/case_packet_json")
    columns = schemas.schema("tx_timeline_daily").fieldNames()
    write_by_case(frames.timeline, f"{out}/tx_timeline_daily", files, columns)
    # By position, so that a page's filter leaves one file or two to read.
    queue = numbered_queue(packet).repartitionByRange("position").sortWithinPartitions("position")
    queue.write.options(**COMPRESSED).mode("overwrite").parquet(f"{out}/case_queue")
    give_back(spark, f"{out}/case_queue")


def _write_json(packet: DataFrame, further: DataFrame, path: str) -> None:
    """The JSON form without a shuffle of the packets: each task writes the slices that it reads.

    Cases with further pages are few and are written apart; their ids are joined by Spark's own
    size check.
    """
    many, large = not further.isEmpty(), further.select("case_id").distinct()
    single = packet.join(large, "case_id", "left_anti") if many else packet
    single = single.select(*packet.columns, F.lit(0).alias("page"), F.lit(1).alias("pages"))
    packet_json(single).sortWithinPartitions("case_id").write.options(**COMPRESSED).mode("overwrite").parquet(path)
    if many:
        pages = paged(packet.join(large, "case_id", "left_semi").select(*packet.columns), further)
        packet_json(pages).write.options(**COMPRESSED).mode("append").parquet(path)


def main() -> None:
    parser = argparse.ArgumentParser(description=__doc__)
    parser.add_argument("--base-path", default="data", help="folder with the input CSV files")
    parser.add_argument("--output-base", help="folder for the datasets (default: the base path)")
    parser.add_argument("--match-header", action="store_true", help="reject re-ordered headers")
    parser.add_argument("--files", type=int, help="files per dataset (default: by size)")
    parser.add_argument("--no-contract", action="store_true", help="do not check the tables")
    args = parser.parse_args()
    logging.basicConfig(level=logging.INFO)
    spark = build_session("caseloom-daily")
    out = args.output_base or args.base_path
    try:
        inputs = read_inputs(spark, args.base_path, args.match_header)
        run(spark, inputs, out, files=args.files, checked=not args.no_contract)
        log.info("datasets written to %s", out)
    finally:
        spark.stop()


if __name__ == "__main__":
    main()
