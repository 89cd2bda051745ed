"""Reconciliation controls between payments, outbox, decisions, deliveries and a review list, each a frame of its own.

Every control is an equi-join, a semi- or anti-join, or a group count, on ids; the report is their union. All give
(code, payment_id, decision_id, detail), with the empty text where a control has no such id. Inputs carry comparable ids:
payments (payment_id, status, created_at), outbox (payment_id, event_type, published_at), decisions (payment_id,
decision_id, decision), deliveries (decision_id, disposition and the broker coordinates), reviews (decision_id,
payment_id, status). Which status a decision should lead to is a table the caller gives.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

COLUMNS = ["code", "payment_id", "decision_id", "detail"]


def _report(df: DataFrame, code: str, detail: Column, payment: Column | None = None, decision: Column | None = None) -> DataFrame:
    blank = F.lit("")
    return df.select(F.lit(code).alias("code"), (blank if payment is None else payment).alias("payment_id"), (blank if decision is None else decision).alias("decision_id"), detail.alias("detail"))


def missing_decisions(payments: DataFrame, outbox: DataFrame, decisions: DataFrame, cutoff: Column, waiting: str = "PENDING_RISK", event_type: str = "payments.created") -> DataFrame:
    """Payments still waiting at the cut-off that were published but have no decision."""
    open_ = payments.filter((F.col("status") == waiting) & (F.col("created_at") <= cutoff))
    published = outbox.filter((F.col("event_type") == event_type) & F.col("published_at").isNotNull()).select("payment_id")
    found = open_.join(published, "payment_id", "left_semi").join(decisions.select("payment_id"), "payment_id", "left_anti")
    return _report(found, "MISSING_DECISION", F.lit("published payment is still waiting after the grace period"), F.col("payment_id"))


def duplicate_decisions(decisions: DataFrame) -> DataFrame:
    """Payments with several decisions."""
    found = decisions.groupBy("payment_id").agg(F.count("*").alias("n")).filter("n > 1")
    return _report(found, "DUPLICATE_DECISION", F.concat(F.col("n").cast("string"), F.lit(" decisions for one payment")), F.col("payment_id"))


def duplicate_deliveries(deliveries: DataFrame, decisions: DataFrame) -> DataFrame:
    """Decisions that several accepted deliveries carried. Counted before the join."""
    counted = deliveries.filter(F.col("disposition").isin("APPLIED", "REPLAYED")).groupBy("decision_id").agg(F.count("*").alias("n")).filter("n > 1")
    found = counted.join(decisions.select("decision_id", "payment_id"), "decision_id")
    return _report(found, "DUPLICATE_DELIVERY", F.concat(F.col("n").cast("string"), F.lit(" deliveries of one decision")), F.coalesce("payment_id", F.lit("")), F.col("decision_id"))


def status_mismatches(payments: DataFrame, decisions: DataFrame, expected: dict[str, str]) -> DataFrame:
    """Payments whose status isn't the one that ``expected`` gives for their decision."""
    wanted = F.coalesce(*[F.when(F.col("decision") == d, F.lit(s)) for d, s in expected.items()])
    found = payments.select("payment_id", "status").join(decisions.select("payment_id", "decision_id", "decision"), "payment_id").filter(F.col("status") != wanted)
    return _report(found, "PAYMENT_STATUS_MISMATCH", F.concat(F.lit("status "), F.col("status"), F.lit(" with decision "), F.col("decision")), F.col("payment_id"), F.col("decision_id"))


def reviews_missing(decisions: DataFrame, reviews: DataFrame, outcome: str = "REVIEW") -> DataFrame:
    """Decisions for review that the review list lacks."""
    found = decisions.filter(F.col("decision") == outcome).join(reviews.select("decision_id"), "decision_id", "left_anti")
    return _report(found, "REVIEW_QUEUE_MISSING", F.lit("decision has no entry in the review list"), F.coalesce("payment_id", F.lit("")), F.col("decision_id"))


def reviews_unexpected(decisions: DataFrame, reviews: DataFrame, outcome: str = "REVIEW") -> DataFrame:
    """Entries of the review list whose decision was another."""
    other = decisions.filter(F.col("decision") != outcome).select("decision_id", "decision")
    found = reviews.select("payment_id", "decision_id").join(other, "decision_id")
    return _report(found, "UNEXPECTED_REVIEW_QUEUE", F.concat(F.lit("entry for decision "), F.col("decision")), F.col("payment_id"), F.col("decision_id"))


def rejected_deliveries(deliveries: DataFrame) -> DataFrame:
    """Deliveries that were rejected, with their coordinates."""
    found = deliveries.filter(F.col("disposition") == "REJECTED")
    where = F.format_string("%s[%s] offset %s: %s", F.col("source_topic"), F.col("source_partition").cast("string"), F.col("source_offset").cast("string"), F.col("error_code"))
    return _report(found, "REJECTED_DECISION_EVENT", where)


def run_controls(payments: DataFrame, outbox: DataFrame, decisions: DataFrame, deliveries: DataFrame, reviews: DataFrame, cutoff: Column, expected: dict[str, str]) -> DataFrame:
    """All controls, unordered; order the report by its columns where it is shown."""
    found = [
        missing_decisions(payments, outbox, decisions, cutoff), duplicate_decisions(decisions), duplicate_deliveries(deliveries, decisions),
        status_mismatches(payments, decisions, expected), reviews_missing(decisions, reviews), reviews_unexpected(decisions, reviews), rejected_deliveries(deliveries),
    ]
    return reduce(DataFrame.unionByName, found)


def count_by_code(exceptions: DataFrame) -> DataFrame:
    return exceptions.groupBy("code").agg(F.count("*").alias("n"))
