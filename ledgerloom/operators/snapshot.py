"""The operational read model: one pass of conditional counts per table, top-k lists, latest versions."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions.contracts import Bad, Contract, contracts_of, parse_json


def summary(df: DataFrame, by: str, values: Sequence[str], total: str | None = None) -> DataFrame:
    """One row: rows, the sum of ``total`` (0 for none), and the rows with each of the values."""
    counts = [F.count_if(F.col(by) == v).alias(f"n_{v.lower()}") for v in values]
    sums = [F.coalesce(F.sum(total), F.lit(0)).cast("bigint").alias(f"{total}_sum")] if total else []
    return df.agg(F.count("*").alias("n_rows"), *sums, *counts)


def decision_summary(decisions: DataFrame, outcomes: Sequence[str] = ("ALLOW", "REVIEW", "BLOCK")) -> DataFrame:
    counts = [F.count_if(F.col("decision") == v).alias(f"n_{v.lower()}") for v in outcomes]
    return decisions.agg(F.count("*").alias("n_rows"), *counts, F.coalesce(F.avg("risk_score"), F.lit(0.0)).alias("risk_score_avg"))


def processing(outbox: DataFrame, deliveries: DataFrame) -> DataFrame:
    """Pending (retrying among them), retrying, dead-lettered and rejected: one aggregate per table."""
    waiting = F.col("published_at").isNull() & F.col("dead_lettered_at").isNull()
    sent = outbox.agg(F.count_if(waiting).alias("n_pending"), F.count_if(waiting & (F.col("delivery_attempts") > 0)).alias("n_retrying"), F.count_if(F.col("dead_lettered_at").isNotNull()).alias("n_dead_lettered"))
    got = deliveries.agg(F.count_if(F.col("disposition") == "REJECTED").alias("n_rejected"))
    return _side_by_side(sent, got)


def gauges(outbox: DataFrame, deliveries: DataFrame, reviews: DataFrame) -> DataFrame:
    """As ``processing``, but pending leaves out what is being retried."""
    waiting = F.col("published_at").isNull() & F.col("dead_lettered_at").isNull()
    sent = outbox.agg(
        F.count_if(waiting & (F.col("delivery_attempts") == 0)).alias("n_pending"), F.count_if(waiting & (F.col("delivery_attempts") > 0)).alias("n_retrying"), F.count_if(F.col("dead_lettered_at").isNotNull()).alias("n_dead_lettered")
    )
    got = deliveries.agg(F.count_if(F.col("disposition") == "REJECTED").alias("n_rejected"))
    return _side_by_side(_side_by_side(sent, got), reviews.agg(F.count_if(F.col("status") == "PENDING").alias("n_reviews")))


def _side_by_side(a: DataFrame, b: DataFrame) -> DataFrame:
    """Two frames of one row each as one row."""
    one = F.lit(1).alias("_one")
    return a.select("*", one).join(b.select("*", one), "_one").drop("_one")


def attention(processed: DataFrame, reviews: DataFrame, exceptions: DataFrame) -> DataFrame:
    """How many things wait for a person: reviews, dead letters, rejected deliveries and exceptions."""
    waiting = _side_by_side(reviews.agg(F.count_if(F.col("status") == "PENDING").alias("n_reviews")), exceptions.agg(F.count("*").alias("n_exceptions")))
    both = _side_by_side(processed, waiting)
    return both.select("n_reviews", "n_dead_lettered", "n_rejected", "n_exceptions", (F.col("n_reviews") + F.col("n_dead_lettered") + F.col("n_rejected") + F.col("n_exceptions")).alias("n_attention"))


def recent(decisions: DataFrame, payments: DataFrame, limit: int = 20) -> DataFrame:
    """The newest decisions that have a payment, with it; k is the feature."""
    joined = decisions.drop("status").join(payments.select("payment_id", "customer_id", "merchant_id", "amount_minor", "currency", "country", "status"), "payment_id")
    return joined.orderBy(F.desc("decision_at"), F.desc("decision_id")).limit(limit)


def latest_versions(decisions: DataFrame) -> DataFrame:
    """Versions of the newest decision, one row; no row if there is none. A partial ``max_by``, not a sort."""
    found = decisions.agg(F.max_by(F.struct("rule_version", "model_version", "decision_at"), F.struct("decision_at", "decision_id")).alias("v"))
    return found.filter(F.col("v").isNotNull()).select("v.*")


def newest_by(df: DataFrame, key: str, order: Sequence[str], columns: Sequence[str] | None = None) -> DataFrame:
    """The row of each key that is greatest by ``order``; combined map-side, so a hot key costs no task more.

    Only ``columns`` (default: all) are carried through the aggregation.
    """
    kept = [c for c in (columns or df.columns) if c != key]
    return df.groupBy(key).agg(F.max_by(F.struct(*kept), F.struct(*order)).alias("v")).select(key, "v.*")


def oldest_by(df: DataFrame, key: str, order: Sequence[str], columns: Sequence[str] | None = None) -> DataFrame:
    """The row of each key that is least by ``order``."""
    kept = [c for c in (columns or df.columns) if c != key]
    return df.groupBy(key).agg(F.min_by(F.struct(*kept), F.struct(*order)).alias("v")).select(key, "v.*")


def next_due(outbox: DataFrame, now: Column, limit: int = 100) -> DataFrame:
    """Unpublished, not dead-lettered events whose next attempt is due, in the order of delivery."""
    due = outbox.filter(F.col("published_at").isNull() & F.col("dead_lettered_at").isNull() & (F.col("next_attempt_at") <= now))
    return due.orderBy("next_attempt_at", "created_at", "id").limit(limit)


#: What the served read model must hold: whole numbers from zero on, and an average score.
_COUNTS = {
    "payments": ["n_rows", "amount_minor_sum", "n_pending_risk", "n_allowed", "n_review", "n_blocked", "n_failed"], "decisions": ["n_rows", "n_allow", "n_review", "n_block"],
    "processing": ["n_pending", "n_retrying", "n_dead_lettered", "n_rejected"],
}


def snapshot_contract() -> Contract:
    """The contract of the read model, in the form of those of messages."""
    none = dict.fromkeys(("lowest", "highest", "pattern", "allowed", "equal_to"))
    rows = [none | {"source_topic": "snapshot", "field_path": part, "value_kind": "object"} for part in _COUNTS]
    rows += [none | {"source_topic": "snapshot", "field_path": f"{part}.{c}", "value_kind": "integer", "lowest": ">=0"} for part, cs in _COUNTS.items() for c in cs]
    rows.append(none | {"source_topic": "snapshot", "field_path": "decisions.risk_score_avg", "value_kind": "number", "lowest": ">=0", "highest": "<=100"})
    return contracts_of(rows)["snapshot"]


def as_json(parts: dict[str, DataFrame]) -> DataFrame:
    """Frames of one row each as one row with the column ``snapshot``, a JSON object."""
    packed = [df.select(F.struct(*df.columns).alias(name)) for name, df in parts.items()]
    whole = packed[0]
    for more in packed[1:]:
        whole = _side_by_side(whole, more)
    return whole.select(F.to_json(F.struct(*parts), {"ignoreNullFields": "false"}).alias("snapshot"))


def contract_problems(snapshots: DataFrame) -> DataFrame:
    """(problem): each way in which a snapshot breaks its contract. Few rows of few bytes."""
    contract = snapshot_contract()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for text in batch.column(0).to_pylist():
                try:
                    faults, values = contract.walk(parse_json(text or ""))
                except ValueError:
                    found.append("malformed_json")
                    continue
                found += faults
                for rule, each in zip(contract.rules, values, strict=True):
                    for value in each:
                        try:
                            rule.cast(value)
                        except Bad as bad:
                            found.append(f"{bad}:{rule.path}")
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.string())], names=["problem"])

    return snapshots.select("snapshot").mapInArrow(run, "problem string")
