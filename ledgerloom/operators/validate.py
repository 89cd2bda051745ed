"""Ordered validation of decision events: the first rule that fails names the row's error, for two profiles.

Rows are typed and flat; ids and texts are taken without white space at their ends. The profile of the store checks all
rules below; the profile of the worker wants one version of the rules and doesn't compare with the features' instant,
which flat rows don't carry. A null value fails the rule of its field; a row that fails none has no error.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ledgerloom.functions import text as X

#: The messages, in the order in which the rules are checked.
NOT_A_UUID = "must be a UUID"
IDS = {
    "event_id": "event_id", "aggregate_id": "aggregate_id", "trace_id": "trace_id", "decision_id": "payload.decision_id", "payment_id": "payload.payment_id", "source_event_id": "payload.source_event_id",
}
MESSAGES = {
    "event_type": 'event_type must be "risk.decision.completed"',
    "schema_version": "schema_version must be 2",
    "event": "event_id must match payload.decision_id",
    "aggregate": "aggregate_id must match payload.payment_id",
    "timestamps": "decision timestamps are required",
    "occurred": "occurred_at must match payload.decision_at",
    "decision": "decision must be ALLOW, REVIEW, or BLOCK",
    "scores": "risk, rule, and model scores must be between 0 and 100",
    "probability": "model_probability must be between 0 and 1",
    "threshold": "model_review_threshold must be between 0 and 1 exclusively",
    "reasons": "reason_codes must contain at least one value",
    "rule_version": "rule_version must contain 1-255 characters",
    "model_version": "model_version must contain 1-255 characters",
    "velocity": "velocity_5m must be at least 1",
    "country": "baseline_country must contain two uppercase letters",
    "reason": "invalid reason_code",
}


def decision_error(rule_version: str | None = None) -> Column:
    """The message of the first rule that fails, or null; ``rule_version`` (the worker's profile) is the only one allowed."""
    fails = lambda holds: ~F.coalesce(holds, F.lit(False))
    same_id = lambda a, b: F.lower(X.trim_white(a)) == F.lower(X.trim_white(b))
    share, limit, codes = F.col("model_probability"), F.col("model_review_threshold"), F.col("reason_codes")
    version = lambda c: F.length(X.trim_white(c)).between(1, 255)
    rules = {
        "event_type": X.trim_white("event_type") == "risk.decision.completed", "schema_version": F.col("schema_version") == 2, "event": same_id("event_id", "decision_id"), "aggregate": same_id("aggregate_id", "payment_id"),
        "timestamps": F.col("occurred_at").isNotNull() & F.col("decision_at").isNotNull(), "occurred": F.col("occurred_at") == F.col("decision_at"), "decision": X.trim_white("decision").isin("ALLOW", "REVIEW", "BLOCK"),
        "scores": F.col("risk_score").between(0, 100) & F.col("rule_score").between(0, 100) & F.col("model_score").between(0, 100), "probability": ~F.isnan(share) & share.between(0, 1), "threshold": ~F.isnan(limit) & (limit > 0) & (limit < 1),
        "reasons": F.size(codes) > 0, "rule_version": version("rule_version") if rule_version is None else X.trim_white("rule_version") == rule_version, "model_version": version("model_version"), "velocity": F.col("velocity_5m") >= 1,
        "country": X.trim_white("baseline_country").rlike(r"^[A-Z]{2}\z"), "reason": F.forall(codes, lambda c: F.coalesce(X.trim_white(c).rlike(X.REASON_SHAPE), F.lit(False))),
    }
    steps = [F.when(fails(X.is_uuid(X.trim_white(c))), f"{name}: {NOT_A_UUID}") for c, name in IDS.items()]
    return F.coalesce(*steps, *[F.when(fails(rules[r]), message) for r, message in MESSAGES.items()])
