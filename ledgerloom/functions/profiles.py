"""The contracts of the two topics as text, for jobs that aren't given a table of contract fields."""

from __future__ import annotations

from ledgerloom.functions.contracts import Contract, contracts_of

PAYMENTS_TOPIC = "payments.created"
DECISIONS_TOPIC = "risk.decisions"

#: Path, kind, then bounds, the pattern, the allowed values or ``=`` and the path of an equal field.
_ENVELOPE = """
event_id uuid
event_type enum {event_type}
aggregate_id uuid = payload.payment_id
schema_version enum {version}
occurred_at timestamp
trace_id uuid
payload object
"""
_PAYMENT = """
payload.payment_id uuid
payload.customer_id text
payload.merchant_id text
payload.device_id text
payload.amount_minor integer >=1 <=9223372036854775807
payload.currency code [A-Z]{3}
payload.country code [A-Z]{2}
payload.status enum PENDING_RISK
payload.created_at timestamp
"""
_DECISION = """
payload.decision_id uuid
payload.payment_id uuid
payload.source_event_id uuid
payload.decision enum ALLOW|REVIEW|BLOCK
payload.risk_score integer >=0 <=100
payload.rule_score integer >=0 <=100
payload.model_score integer >=0 <=100
payload.model_probability number >=0 <=1
payload.model_review_threshold number >0 <1
payload.reason_codes code_list [A-Z0-9_]{1,100}
payload.rule_version text
payload.model_version text
payload.decision_at timestamp = payload.features.decision_at
payload.features object
payload.features.velocity_5m integer >=1 <=2147483647
payload.features.new_device boolean
payload.features.cross_border boolean
payload.features.baseline_country code [A-Z]{2}
payload.features.decision_at timestamp
"""
#: Equal fields of a decision beyond those of every envelope.
_DECISION_EQUAL = {"event_id": "payload.decision_id", "occurred_at": "payload.decision_at"}


def _rows(topic: str, text: str, equal: dict[str, str]) -> list[dict]:
    rows = []
    for line in text.strip().splitlines():
        path, kind, *more = line.split()
        row = dict.fromkeys(("lowest", "highest", "pattern", "allowed", "equal_to")) | {"source_topic": topic, "field_path": path, "value_kind": kind}
        row["equal_to"] = equal.get(path) or (more[1] if more[:1] == ["="] else None)
        if more and more[0] != "=":
            names = {"enum": ["allowed"], "code": ["pattern"], "code_list": ["pattern"], "integer": ["lowest", "highest"], "number": ["lowest", "highest"]}[kind]
            row |= dict(zip(names, more, strict=True))
        rows.append(row)
    return rows


def default_rows(payments_topic: str = PAYMENTS_TOPIC, decisions_topic: str = DECISIONS_TOPIC) -> list[dict]:
    """Rows in the form of the table ``contract_fields``."""
    payment = _ENVELOPE.format(event_type="payments.created", version=1) + _PAYMENT.strip()
    decision = _ENVELOPE.format(event_type="risk.decision.completed", version=2) + _DECISION.strip()
    return _rows(payments_topic, payment, {}) + _rows(decisions_topic, decision, _DECISION_EQUAL)


def default_contracts(payments_topic: str = PAYMENTS_TOPIC, decisions_topic: str = DECISIONS_TOPIC) -> dict[str, Contract]:
    """The contract of each topic."""
    return contracts_of(default_rows(payments_topic, decisions_topic))
