"""The tables as the operators want them: payments, outbox, decisions, deliveries and reviews with comparable ids."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.functions.profiles import DECISIONS_TOPIC, PAYMENTS_TOPIC
from ledgerloom.functions.rules import sealed_error_text
from ledgerloom.operators.curate import Profile
from ledgerloom.operators.rejects import read_contracts
from ledgerloom.operators.snapshot import newest_by, oldest_by
from ledgerloom.tables import clean_id, table

#: Whose contract a table of deliveries follows.
TOPICS = {"payment_events": PAYMENTS_TOPIC, "decision_events": DECISIONS_TOPIC}
#: Which payment status each decision leads to.
EXPECTED_STATUS = {"ALLOW": "ALLOWED", "REVIEW": "REVIEW", "BLOCK": "BLOCKED"}
#: The instant at which the read models look at the data, and the grace before it.
AS_OF, CUTOFF = "2024-01-15 00:00:00", "2024-01-14 23:59:30"


#: What the reports need of payments and decisions.
PAYMENT_COLUMNS = ["payment_id", "customer_id", "merchant_id", "device_id", "amount_minor", "currency", "country", "status", "created_at", "updated_at", "loaded_at"]
DECISION_COLUMNS = "decision_id payment_id delivery_id decision risk_score model_probability rule_version model_version decision_at source_topic kafka_timestamp ingested_at event_date".split()


def payments(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    """The latest state of each payment; only ``columns`` are carried through the aggregation, if they are named."""
    rows = table(spark, d, "payments").withColumn("payment_id", clean_id("id")).filter(F.col("payment_id").isNotNull())
    rows = rows.withColumns({"merchant_id": F.trim("merchant_id"), "country": F.upper("country")})
    return newest_by(rows, "payment_id", ["updated_at", "loaded_at", "status"], columns or PAYMENT_COLUMNS)


def outbox(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "outbox_events").withColumn("payment_id", clean_id("aggregate_id"))


def checked(spark: SparkSession, d: str, name: str) -> DataFrame:
    """Rows of ``payment_events`` or ``decision_events`` as delivered, with their violations of the contract."""
    contract = read_contracts(table(spark, d, "contract_fields"))[TOPICS[name]]
    return table(spark, d, name).withColumn("errors", sealed_error_text(Profile(contract).typed_violations()))


def valid(spark: SparkSession, d: str, name: str) -> DataFrame:
    return checked(spark, d, name).filter(F.col("errors") == "")


def decisions(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    """The first valid delivery of each decision; only ``columns`` are carried through the aggregation, if they are named."""
    rows = valid(spark, d, "decision_events").withColumns({"decision_id": clean_id("decision_id"), "payment_id": clean_id("payment_id")})
    return oldest_by(rows, "decision_id", ["delivery_id"], columns or DECISION_COLUMNS)


def deliveries(spark: SparkSession, d: str) -> DataFrame:
    """Every delivery of a decision: rejected if it violates the contract, else applied the first time and replayed after."""
    rows = checked(spark, d, "decision_events").withColumn("decision_id", F.coalesce(clean_id("decision_id"), F.lit("")))
    good = rows.filter(F.col("errors") == "").groupBy("decision_id").agg(F.min("delivery_id").alias("first"))
    keep = ["decision_id", "delivery_id", "source_topic", "source_partition", "source_offset", "leader_epoch", "errors"]
    joined = rows.select(*keep).join(good, "decision_id", "left")
    state = F.when(F.col("errors") != "", "REJECTED").when(F.col("delivery_id") == F.col("first"), "APPLIED").otherwise("REPLAYED")
    return joined.select("*", state.alias("disposition"), F.substring_index("errors", ",", 1).alias("error_code")).drop("first", "errors")


def reviews(spark: SparkSession, d: str, paid: DataFrame | None = None, decided: DataFrame | None = None) -> DataFrame:
    """The review list: payments whose status says so, with their newest decision."""
    paid = payments(spark, d, "status") if paid is None else paid
    decided = decisions(spark, d, "payment_id", "decision_at") if decided is None else decided
    newest = newest_by(decided.select("payment_id", "decision_id", "decision_at"), "payment_id", ["decision_at", "decision_id"])
    waiting = paid.filter(F.col("status") == "REVIEW").select("payment_id")
    return waiting.join(newest, "payment_id").select("payment_id", "decision_id", F.col("decision_at").alias("enqueued_at"), F.lit("PENDING").alias("status"))


def unique_events(spark: SparkSession, d: str, name: str, *columns: str) -> DataFrame:
    """One row per event id: its first valid delivery."""
    rows = valid(spark, d, name).withColumn("event_id", clean_id("event_id"))
    return oldest_by(rows, "event_id", ["delivery_id"], columns)


def labelled(spark: SparkSession, d: str) -> DataFrame:
    """Decisions' probabilities against what became of the payment: (score, label)."""
    ended = payments(spark, d, "status").filter(F.col("status").isin("ALLOWED", "BLOCKED")).select("payment_id", F.when(F.col("status") == "BLOCKED", 1).otherwise(0).alias("label"))
    scored = decisions(spark, d, "payment_id", "model_probability").select("payment_id", F.col("model_probability").alias("score"))
    return scored.join(ended, "payment_id").select("score", "label")
