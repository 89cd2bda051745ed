"""The lake job: broker records to curated, deduplicated and quarantined tables and to mergeable daily deltas.

One query screens the records: each micro-batch is parsed once, kept while it is split, and gives the quarantine with its
deltas and the valid rows of each topic. These are passed on as files to one query per topic, which drops repeated
events within the watermark and writes rows and deltas. Every query has a checkpoint of its own; files that were passed
on are removed once they have been read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ledgerloom.functions.contracts import Contract
from ledgerloom.functions.profiles import DECISIONS_TOPIC, PAYMENTS_TOPIC, default_contracts
from ledgerloom.operators import curate, metrics
from ledgerloom.sources.records import RECORD_SCHEMA, kafka_stream, replayed_stream
from ledgerloom.sources.settings import Settings
from ledgerloom.streaming import sinks
from ledgerloom.streaming.supervise import supervise

WATERMARK = "7 days"
#: Tables and how each is partitioned.
PARTITIONS = {"payments": ["event_date"], "decisions": ["event_date", "decision"], "quarantine": ["event_date", "source_topic"], "deltas": []}
LOGS = ("payments", "decisions", "quarantine")


def deduplicated(stream: DataFrame, event_time: str = "occurred_at", ids: tuple[str, ...] = ("event_id",), delay: str = WATERMARK) -> DataFrame:
    """The first row of each id within the watermark; rows behind the watermark are dropped (see ``hourly`` for those)."""
    return stream.withWatermark(event_time, delay).dropDuplicatesWithinWatermark(list(ids))


def log_of(spark: SparkSession, output_root: str, name: str) -> sinks.BatchLog:
    """The tables of one query: its rows under its own name, and ``deltas``."""
    return sinks.BatchLog(spark, f"{output_root}/{name}", {"deltas": metrics.merge_deltas})


def start_lake(
    records: DataFrame, output_root: str, checkpoint_root: str, payments_topic: str = PAYMENTS_TOPIC, decisions_topic: str = DECISIONS_TOPIC, contracts: dict[str, Contract] | None = None, **schedule: object
) -> list[StreamingQuery]:
    """The screening query and those of both topics. With ``availableNow`` the latter start when the former has ended."""
    spark = records.sparkSession
    contracts = contracts or default_contracts(payments_topic, decisions_topic)
    topics = {"payments": payments_topic, "decisions": decisions_topic}
    passed_on = {name: f"{output_root}/_passed_on/{name}" for name in topics}
    empty = curate.curate(spark.createDataFrame([], RECORD_SCHEMA), contracts)

    def screen(batch: DataFrame, batch_id: int) -> None:
        judged = curate.curate(batch, contracts)
        parsed = judged.over(judged.judged.persist())
        try:
            for name, topic in topics.items():
                # a batch that is run again replaces its files; what was read already is dropped as repeated
                parsed.valid(topic).write.mode("overwrite").parquet(f"{passed_on[name]}/{batch_id:020d}")
            rejected = parsed.quarantine()
            log_of(spark, output_root, "quarantine").write(batch_id, {"quarantine": rejected, "deltas": metrics.quarantine_errors(rejected)}, PARTITIONS)
        finally:
            parsed.judged.unpersist()

    def payments(batch: DataFrame, batch_id: int) -> None:
        deltas = metrics.payment_volume(batch).unionByName(metrics.ingestion_latency(batch))
        log_of(spark, output_root, "payments").write(batch_id, {"payments": batch, "deltas": deltas}, PARTITIONS)

    def decisions(batch: DataFrame, batch_id: int) -> None:
        deltas = metrics.decision_counts(batch).unionByName(metrics.score_distribution(batch)).unionByName(metrics.ingestion_latency(batch))
        log_of(spark, output_root, "decisions").write(batch_id, {"decisions": batch, "deltas": deltas}, PARTITIONS)

    queries = [sinks.start_batches(records, screen, f"{checkpoint_root}/screen", "lake_screen", **schedule)]
    if schedule.get("availableNow"):
        queries[0].awaitTermination()
    for name, each in (("payments", payments), ("decisions", decisions)):
        # the folder must be there before its first file
        empty.valid(topics[name]).write.mode("append").parquet(f"{passed_on[name]}/none")
        rows = replayed_stream(spark, f"{passed_on[name]}/*", empty.valid(topics[name]).schema, cleanSource="delete")
        queries.append(sinks.start_batches(deduplicated(rows), each, f"{checkpoint_root}/{name}", f"lake_{name}", **schedule))
    return queries


def read_table(spark: SparkSession, output_root: str, name: str) -> DataFrame | None:
    """``payments``, ``decisions`` or ``quarantine`` as of the last committed batch; null before the first."""
    return log_of(spark, output_root, name).read(name)


def read_deltas(spark: SparkSession, output_root: str) -> DataFrame | None:
    """All deltas, merged, with rates and averages; null before the first batch."""
    parts = [own for name in LOGS if (own := log_of(spark, output_root, name).read("deltas")) is not None]
    if not parts:
        return None
    found = parts[0]
    for more in parts[1:]:
        found = found.unionByName(more)
    return metrics.with_derived(metrics.merge_deltas(found))


def main() -> int:
    """Runs until a query ends or a signal comes; settings are taken from the environment."""
    settings = Settings.from_env()
    spark = SparkSession.builder.appName("ledgerloom-lake").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    records = kafka_stream(spark, settings.kafka_brokers, [settings.payments_topic, settings.decisions_topic], settings.starting_offsets, settings.max_offsets_per_trigger)
    return supervise(start_lake(records, settings.output_root, settings.checkpoint_root, settings.payments_topic, settings.decisions_topic, processingTime=settings.trigger_interval))


if __name__ == "__main__":
    raise SystemExit(main())
