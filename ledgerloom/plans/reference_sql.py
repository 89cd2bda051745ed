"""The SQL that the queries of ``reference_queries`` are checked against, as DuckDB runs it."""

from __future__ import annotations

from ledgerloom.plans import domain
from ledgerloom.plans.contract_sql import _LAKE, _UUID
from ledgerloom.plans.contract_sql import instant_text as text

def _id(column: str) -> str:
    return f"nullif(lower(trim({column}, ' ')), '')"


def _instant(value: str) -> str:
    return f"TIMESTAMPTZ '{value}+00'"


def _typed_errors(topic: str) -> str:
    """The codes of typed rows: the checks of the lenient contract without those of texts of instants."""

    def condition(path: str, check: str, argument: str) -> str | None:
        c, other, parts = path.rpartition(".")[2], argument.rpartition(".")[2], argument.split("|")
        listed = ", ".join(f"'{p}'" for p in parts)
        if check == "offset" or "features.decision_at" in (path.removeprefix("payload."), argument.removeprefix("payload.")):
            return None
        return {
            "is": lambda: f"{c} IS NULL OR CAST({c} AS VARCHAR) NOT IN ({listed})", "uuid": lambda: f"{c} IS NULL OR NOT regexp_full_match(trim({c}, ' '), '{_UUID}')",
            "text": lambda: f"{c} IS NULL OR trim({c}, ' ') = '' OR length(trim({c}, ' ')) > 255", "instant": lambda: f"{c} IS NULL", "from": lambda: f"{c} IS NULL OR {c} < {argument}",
            "like": lambda: f"{c} IS NULL OR NOT regexp_full_match({c}, '{argument}')", "between": lambda: f"{c} IS NULL OR isnan({c}) OR {c} NOT BETWEEN {parts[0]} AND {parts[1]}",
            "inside": lambda: f"{c} IS NULL OR isnan({c}) OR {c} <= {parts[0]} OR {c} >= {parts[1]}", "present": lambda: f"{c} IS NULL", "some": lambda: f"{c} IS NULL OR len({c}) = 0",
            "each": lambda: f"len(list_filter({c}, lambda x: NOT coalesce(regexp_full_match(x, '{argument}'), false))) > 0",
            "differs": lambda: f"lower(trim({c}, ' ')) <> lower(trim({other}, ' '))", "later": lambda: f"{c} <> {other}",
        }[check]()

    lines = [(line.split(" ", 3) + [""])[:4] for line in _LAKE[topic].strip().splitlines()]
    found = [(code, condition(path, check, argument)) for code, path, check, argument in lines]
    return ", ".join(f"CASE WHEN {c} THEN '{code}' END" for code, c in found if c)


def _digest() -> str:
    """SHA-256 of the canonical form of a decision's normalized fields."""
    cells = {c: _id(c) for c in ("event_id", "aggregate_id", "trace_id", "decision_id", "payment_id", "source_event_id")}
    cells |= {c: f"CAST({c} AS VARCHAR)" for c in ("schema_version", "risk_score", "rule_score", "model_score", "velocity_5m", "new_device", "cross_border")}
    cells |= {c: f"trim({c}, ' ')" for c in ("event_type", "decision", "rule_version", "model_version", "baseline_country")} | {c: f"CAST(epoch_us({c}) AS VARCHAR)" for c in ("occurred_at", "decision_at")}
    cells |= {c: f"CASE WHEN NOT isnan({c}) THEN CAST(CAST({c} AS DECIMAL(20, 9)) AS VARCHAR) END" for c in ("model_probability", "model_review_threshold")}
    cells["reason_codes"] = "array_to_string(list_transform(reason_codes, lambda x: trim(x, ' ')), '|')"
    return "sha256(" + " || ".join(f"'{n}:' || strlen(coalesce({e}, '')) || ':' || coalesce({e}, '') || chr(10)" for n, e in cells.items()) + ")"


def _applied_sql(rounds: int = 6) -> str:
    """Decisions taken in order, by rounds; a round takes what is first for all its ids. More rounds than any chain needs."""
    ids = ("decision_id", "payment_id", "source_event_id")
    steps = ["c0 AS (SELECT * FROM log WHERE fresh AND good AND paid AND decision_id IS NOT NULL AND source_event_id IS NOT NULL)"]
    for k in range(rounds):
        firsts = " AND ".join(f"delivery_id = min(delivery_id) OVER (PARTITION BY {i})" for i in ids)
        steps.append(f"w{k} AS (SELECT * FROM c{k} QUALIFY {firsts})")
        steps.append(f"c{k + 1} AS (SELECT * FROM c{k} WHERE " + " AND ".join(f"{i} NOT IN (SELECT {i} FROM w{k})" for i in ids) + ")")
    won = " UNION ALL ".join(f"SELECT * FROM w{k}" for k in range(rounds))
    joins = " ".join(f"LEFT JOIN won {n} ON {n}.{i} = l.{i} AND {n}.delivery_id < l.delivery_id" for n, i in zip(("wd", "wp", "ws"), ids, strict=True))
    steps.append(f"won AS ({won})")
    steps.append(f"""own AS (SELECT l.*, CASE WHEN NOT l.good THEN 'invalid_event' WHEN NOT l.paid THEN 'payment_not_found' WHEN wd.delivery_id IS NOT NULL THEN CASE WHEN wd.digest = l.digest THEN '' ELSE 'decision_conflict' END
  WHEN ws.delivery_id IS NOT NULL THEN 'decision_conflict' WHEN wp.delivery_id IS NOT NULL THEN 'payment_state_conflict' ELSE '' END AS code, wd.delivery_id IS NOT NULL AND wd.digest = l.digest AND l.good AND l.paid AS again FROM log l {joins})""")
    steps.append("""full_ AS (SELECT o.*, f.code <> '' AS first_rejected FROM own o JOIN own f ON f.record = o.record AND f.fresh)""")
    steps.append("""done AS (SELECT *, CASE WHEN NOT fresh THEN CASE WHEN digest = first_digest AND NOT first_rejected THEN 'REPLAYED' ELSE 'CONFLICT' END WHEN code <> '' THEN 'REJECTED' WHEN again THEN 'REPLAYED' ELSE 'APPLIED' END AS disposition FROM full_)""")
    return "WITH " + ", ".join(steps) + " SELECT delivery_id, decision_id, payment_id, disposition, CASE disposition WHEN 'CONFLICT' THEN 'source_record_conflict' WHEN 'REJECTED' THEN code ELSE '' END AS error_code FROM done"


_CTE = {
    "pay": f"""SELECT {_id('id')} AS payment_id, customer_id, trim(merchant_id, ' ') AS merchant_id, device_id, amount_minor, currency, upper(country) AS country, status, created_at, updated_at, loaded_at
  FROM payments WHERE trim(id, ' ') <> '' QUALIFY row_number() OVER (PARTITION BY {_id('id')} ORDER BY updated_at DESC NULLS LAST, loaded_at DESC NULLS LAST, status DESC NULLS LAST) = 1""",
    "dec": f"""SELECT {_id('decision_id')} AS decision_id, {_id('payment_id')} AS payment_id, delivery_id, decision, risk_score, model_probability, rule_version, model_version, decision_at, source_topic, kafka_timestamp, ingested_at, event_date
  FROM chk WHERE errors = '' QUALIFY row_number() OVER (PARTITION BY {_id('decision_id')} ORDER BY delivery_id) = 1""",
    "chk": f"SELECT *, concat_ws(',', {_typed_errors('risk.decisions')}) AS errors FROM decision_events",
    "chp": f"SELECT *, concat_ws(',', {_typed_errors('payments.created')}) AS errors FROM payment_events",
    "del": f"""SELECT coalesce({_id('decision_id')}, '') AS decision_id, delivery_id, source_topic, source_partition, source_offset, split_part(errors, ',', 1) AS error_code,
  CASE WHEN errors <> '' THEN 'REJECTED' WHEN delivery_id = min(CASE WHEN errors = '' THEN delivery_id END) OVER (PARTITION BY coalesce({_id('decision_id')}, '')) THEN 'APPLIED' ELSE 'REPLAYED' END AS disposition FROM chk""",
    "dig": f"SELECT *, {_digest()} AS digest FROM chk",
    "log": f"""SELECT delivery_id, concat_ws('|', source_topic, source_partition, source_offset, leader_epoch) AS record, digest, errors = '' AS good, {_id('decision_id')} AS decision_id, {_id('payment_id')} AS payment_id, {_id('source_event_id')} AS source_event_id,
  delivery_id = min(delivery_id) OVER (PARTITION BY concat_ws('|', source_topic, source_partition, source_offset, leader_epoch)) AS fresh, first_value(digest) OVER (PARTITION BY concat_ws('|', source_topic, source_partition, source_offset, leader_epoch) ORDER BY delivery_id) AS first_digest,
  EXISTS (SELECT 1 FROM payments p WHERE {_id('p.id')} = {_id('dig.payment_id')}) AS paid FROM dig""",
    "app": _applied_sql(),
    "out": f"SELECT * , {_id('aggregate_id')} AS payment_id FROM outbox_events",
    "newest": "SELECT payment_id, decision_id, decision, risk_score, decision_at FROM dec WHERE payment_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY payment_id ORDER BY decision_at DESC NULLS LAST, decision_id DESC) = 1",
    "rev": "SELECT p.payment_id, n.decision_id, n.decision_at AS enqueued_at, 'PENDING' AS status FROM pay p JOIN newest n USING (payment_id) WHERE p.status = 'REVIEW'",
    "pev": f"SELECT * REPLACE ({_id('event_id')} AS event_id) FROM chp WHERE errors = '' QUALIFY row_number() OVER (PARTITION BY {_id('event_id')} ORDER BY delivery_id) = 1",
    "dev": f"SELECT * REPLACE ({_id('event_id')} AS event_id) FROM chk WHERE errors = '' QUALIFY row_number() OVER (PARTITION BY {_id('event_id')} ORDER BY delivery_id) = 1",
    "lab": "SELECT d.model_probability AS score, CAST(p.status = 'BLOCKED' AS INTEGER) AS label FROM dec d JOIN pay p USING (payment_id) WHERE p.status IN ('ALLOWED', 'BLOCKED') AND d.model_probability BETWEEN 0 AND 1",
    "delays": """SELECT p.country, (epoch_us(s.at) - epoch_us(p.created_at)) / 1000.0 AS publish_ms, (epoch_us(d.at) - epoch_us(p.created_at)) / 1000.0 AS decision_ms FROM pay p
  JOIN (SELECT payment_id, min(published_at) AS at FROM out WHERE published_at IS NOT NULL GROUP BY 1) s USING (payment_id)
  JOIN (SELECT payment_id, min(ingested_at) AS at FROM dec WHERE payment_id IS NOT NULL GROUP BY 1) d USING (payment_id)""",
    "exc": f"""SELECT 'MISSING_DECISION' AS code, payment_id, '' AS decision_id, 'published payment is still waiting after the grace period' AS detail FROM pay p WHERE status = 'PENDING_RISK' AND created_at <= {_instant(domain.CUTOFF)}
    AND EXISTS (SELECT 1 FROM out o WHERE o.payment_id = p.payment_id AND o.event_type = 'payments.created' AND o.published_at IS NOT NULL) AND NOT EXISTS (SELECT 1 FROM dec d WHERE d.payment_id = p.payment_id)
  UNION ALL SELECT 'DUPLICATE_DECISION', payment_id, '', concat(count(*), ' decisions for one payment') FROM dec WHERE payment_id IS NOT NULL GROUP BY payment_id HAVING count(*) > 1
  UNION ALL SELECT 'DUPLICATE_DELIVERY', d.payment_id, d.decision_id, concat(count(*), ' deliveries of one decision') FROM del x JOIN dec d USING (decision_id) WHERE x.disposition <> 'REJECTED' AND d.payment_id IS NOT NULL GROUP BY ALL HAVING count(*) > 1
  UNION ALL SELECT 'PAYMENT_STATUS_MISMATCH', p.payment_id, d.decision_id, concat('status ', p.status, ' with decision ', d.decision) FROM pay p JOIN dec d USING (payment_id) WHERE p.status <> CASE d.decision WHEN 'ALLOW' THEN 'ALLOWED' WHEN 'REVIEW' THEN 'REVIEW' WHEN 'BLOCK' THEN 'BLOCKED' END
  UNION ALL SELECT 'REVIEW_QUEUE_MISSING', d.payment_id, d.decision_id, 'decision has no entry in the review list' FROM dec d LEFT JOIN rev r USING (decision_id) WHERE d.decision = 'REVIEW' AND d.payment_id IS NOT NULL AND r.decision_id IS NULL
  UNION ALL SELECT 'UNEXPECTED_REVIEW_QUEUE', r.payment_id, r.decision_id, concat('entry for decision ', d.decision) FROM rev r JOIN dec d USING (decision_id) WHERE d.decision <> 'REVIEW' AND d.payment_id IS NOT NULL
  UNION ALL SELECT 'REJECTED_DECISION_EVENT', '', '', format('{{}}[{{}}] offset {{}}: {{}}', source_topic, source_partition, source_offset, error_code) FROM del WHERE disposition = 'REJECTED'""",
    "bad": "SELECT strftime(kafka_timestamp AT TIME ZONE 'UTC', '%Y-%m-%d') AS event_date, source_topic, unnest(string_split(errors, ',')) AS error_code FROM (SELECT kafka_timestamp, source_topic, errors FROM chk UNION ALL SELECT kafka_timestamp, source_topic, errors FROM chp) WHERE errors <> ''",
    "lat": "SELECT CAST(event_date AS VARCHAR) AS event_date, source_topic, greatest(0, epoch_us(ingested_at) // 1000 - epoch_us(kafka_timestamp) // 1000) AS ms FROM pev UNION ALL SELECT CAST(event_date AS VARCHAR), source_topic, greatest(0, epoch_us(ingested_at) // 1000 - epoch_us(kafka_timestamp) // 1000) FROM dev",
    "sco": "SELECT CAST(event_date AS VARCHAR) AS event_date, decision, risk_score, CAST(least(floor(risk_score / 10) * 10, 90) AS INTEGER) AS lo FROM dev",
    "sc2": "SELECT *, format('{:02d}-{:02d}', lo, CASE WHEN lo = 90 THEN 100 ELSE lo + 9 END) AS bucket FROM sco",
    "m": """SELECT CAST(event_date AS VARCHAR) AS event_date, 'payment_volume' AS metric_family, CASE g WHEN 1 THEN 'merchant' WHEN 2 THEN 'country' ELSE 'overall' END AS dimension_type,
    CASE g WHEN 1 THEN trim(merchant_id, ' ') WHEN 2 THEN country ELSE 'ALL' END AS dimension_value, CAST(NULL AS VARCHAR) AS outcome, CAST(NULL AS VARCHAR) AS metric_bucket, count(*) AS event_count, CAST(sum(amount_minor) AS BIGINT) AS amount_minor_sum,
    CAST(NULL AS BIGINT) AS risk_score_sum, 0 AS risk_score_count, CAST(NULL AS INTEGER) AS risk_score_min, CAST(NULL AS INTEGER) AS risk_score_max, CAST(NULL AS BIGINT) AS latency_ms_sum, 0 AS latency_ms_count, CAST(NULL AS BIGINT) AS latency_ms_min, CAST(NULL AS BIGINT) AS latency_ms_max
    FROM pev, (VALUES (0), (1), (2)) v(g) GROUP BY ALL
  UNION ALL SELECT CAST(event_date AS VARCHAR), 'decision_rate', 'overall', 'ALL', decision, NULL, count(*), NULL, NULL, 0, NULL, NULL, NULL, 0, NULL, NULL FROM dev GROUP BY ALL
  UNION ALL SELECT event_date, 'risk_score_distribution', CASE g WHEN 0 THEN 'overall' ELSE 'decision' END, CASE g WHEN 0 THEN 'ALL' ELSE decision END, NULL, bucket, count(*), NULL, CAST(sum(risk_score) AS BIGINT), count(risk_score), min(risk_score), max(risk_score), NULL, 0, NULL, NULL FROM sc2, (VALUES (0), (1)) v(g) GROUP BY ALL
  UNION ALL SELECT event_date, 'ingestion_latency', 'source_topic', source_topic, NULL, NULL, count(*), NULL, NULL, 0, NULL, NULL, CAST(sum(ms) AS BIGINT), count(ms), min(ms), max(ms) FROM lat GROUP BY ALL
  UNION ALL SELECT event_date, 'quarantine_error', 'source_topic', source_topic, NULL, error_code, count(*), NULL, NULL, 0, NULL, NULL, NULL, 0, NULL, NULL FROM bad GROUP BY ALL""",
    "ev": f"SELECT customer_id, {_id('payment_id')} AS payment_id, device_id, country, epoch_us(occurred_at) // 1000 AS ms, delivery_id AS seq FROM pev WHERE customer_id IS NOT NULL AND occurred_at IS NOT NULL",
}

_NEEDS = {
    "dec": ["chk"], "pev": ["chp"], "dev": ["chk"], "del": ["chk"], "newest": ["dec"], "rev": ["pay", "newest"], "lab": ["dec", "pay"], "delays": ["pay", "out", "dec"], "exc": ["pay", "out", "dec", "del", "rev"],
    "dig": ["chk"], "log": ["dig"], "app": ["log"], "bad": ["chk", "chp"], "lat": ["pev", "dev"], "sco": ["dev"], "sc2": ["sco"], "m": ["pev", "dev", "sc2", "lat", "bad"], "ev": ["pev"],
}


def _query(body: str, *names: str) -> str:
    """``body`` with the common tables that it needs, and those that they need, in order."""
    order: list[str] = []

    def visit(name: str) -> None:
        for needed in _NEEDS.get(name, []):
            visit(needed)
        if name not in order:
            order.append(name)

    for name in names:
        visit(name)
    return "WITH " + ",\n".join(f"{n} AS ({_CTE[n]})" for n in order) + "\n" + body


_DERIVED = """SELECT *, CASE WHEN metric_family = 'decision_rate' THEN CAST(sum(event_count) OVER w AS BIGINT) END AS denominator_count,
  CASE WHEN metric_family = 'decision_rate' THEN event_count / sum(event_count) OVER w END AS rate, risk_score_sum / nullif(risk_score_count, 0) AS risk_score_avg, latency_ms_sum / nullif(latency_ms_count, 0) AS latency_ms_avg
FROM m WINDOW w AS (PARTITION BY event_date, metric_family, dimension_type, dimension_value)"""
_PAY_TEXT = ", ".join(f"{text(c)} AS {c}" for c in ("created_at", "updated_at", "loaded_at"))


def _percentiles(value: str) -> str:
    cells = ", ".join(
        f"round(quantile_cont({value}, {p}), 6) AS p{int(p * 100)}_cont, min({value}) FILTER (rn >= ceil({p} * n)) AS p{int(p * 100)}_disc" for p in (0.5, 0.95, 0.99)
    )
    ranked = f"SELECT country, {value}, row_number() OVER (PARTITION BY country ORDER BY {value}) AS rn, count({value}) OVER (PARTITION BY country) AS n FROM delays"
    return _query(f"SELECT country, count({value}) AS n, min({value}) AS least, {cells}, max({value}) AS greatest FROM ({ranked}) GROUP BY country", "delays")


_EDGES = (0.05, 0.1, 0.25, 0.5, 1, 2.5, 5, 10, 30, 60, 300)
_HISTOGRAM = " UNION ALL ".join(f"SELECT country, '{e}' AS edge, count(*) FILTER (decision_ms / 1000.0 <= {e}) AS n FROM delays GROUP BY country" for e in _EDGES)
_WAITING = "published_at IS NULL AND dead_lettered_at IS NULL"
_PROCESSING = f"SELECT (SELECT count(*) FROM out WHERE {_WAITING}) AS n_pending, (SELECT count(*) FROM out WHERE {_WAITING} AND delivery_attempts > 0) AS n_retrying, (SELECT count(*) FROM out WHERE dead_lettered_at IS NOT NULL) AS n_dead_lettered, (SELECT count(*) FROM del WHERE disposition = 'REJECTED') AS n_rejected"
_CANONICAL = " || ".join(
    ["'fingerprint_version:1:1' || chr(10)"]
    + [f"'{n}:' || strlen(coalesce({e}, '')) || ':' || coalesce({e}, '') || chr(10)" for n, e in (
        ("customer_id", "trim(customer_id, ' ')"), ("merchant_id", "merchant_id"), ("device_id", "trim(device_id, ' ')"), ("amount_minor", "CAST(amount_minor AS VARCHAR)"), ("currency", "upper(trim(currency))"), ("country", "upper(trim(country))"),
    )]
)
_NAME = "encode('decision:model-v2:' || event_id)"
_SHA1 = f"sha1(unhex('6ba7b8119dad11d180b400c04fd430c8') || {_NAME})"

def _features(window_ms: int, ttl_ms: int) -> str:
    return _query(f"""SELECT a.seq, CAST((SELECT count(DISTINCT b.payment_id) + CAST(count(*) > count(b.payment_id) AS INTEGER) FROM ev b WHERE b.customer_id = a.customer_id AND b.ms BETWEEN a.ms - {window_ms} AND a.ms AND (b.ms < a.ms OR b.seq <= a.seq)) AS INTEGER) AS velocity,
  a.device_id IS NOT NULL AND row_number() OVER (PARTITION BY customer_id, epoch, device_id ORDER BY ms, seq) = 1 AS new_device,
  a.country IS DISTINCT FROM first_value(country) OVER (PARTITION BY customer_id, epoch ORDER BY ms, seq) AS cross_border, first_value(country) OVER (PARTITION BY customer_id, epoch ORDER BY ms, seq) AS baseline_country
FROM (SELECT *, sum(CAST(gap AS INTEGER)) OVER (PARTITION BY customer_id ORDER BY ms, seq) AS epoch FROM (SELECT *, coalesce(ms - lag(ms) OVER (PARTITION BY customer_id ORDER BY ms, seq) > {ttl_ms}, false) AS gap FROM ev)) a""", "ev")


_REQUESTS = f"""SELECT {_id('id')} AS payment_id, nullif(trim(idempotency_key), '') AS request, request_fingerprint, loaded_at AS loaded, status, CASE WHEN nullif(trim(idempotency_key), '') IS NOT NULL THEN first_value(request_fingerprint) OVER w END AS first, row_number() OVER w AS rn
  FROM payments WINDOW w AS (PARTITION BY nullif(trim(idempotency_key), '') ORDER BY loaded_at NULLS FIRST, status NULLS FIRST, {_id('id')} NULLS FIRST)"""
_IDENTIFIERS = ", ".join(f"CASE WHEN coalesce(trim({c}), '') = '' THEN 'is required' WHEN length(trim({c})) > 255 THEN 'must be at most 255 characters' END" for c in ("customer_id", "merchant_id", "device_id"))
_NOW = f"'{domain.AS_OF}.000000'"
_BLANK = [("id", "event_id is required"), ("event_type", "event_type is required"), ("aggregate_id", "aggregate_id is required")]
_ENVELOPE_ERROR = (
    "CASE " + " ".join(f"WHEN trim(coalesce({c}, ''), ' ') = '' THEN '{m}'" for c, m in _BLANK) + " WHEN coalesce(schema_version < 1, true) THEN 'schema_version must be positive' WHEN occurred_at IS NULL THEN 'occurred_at is required'"
    " WHEN trim(coalesce(trace_id, ''), ' ') = '' THEN 'trace_id is required' WHEN NOT coalesce(json_valid(payload) AND json_type(payload) = 'OBJECT', false) THEN 'payload must be a JSON object' END"
)


def _decision_error(version: str) -> str:
    uuids = {"event_id": "event_id", "aggregate_id": "aggregate_id", "trace_id": "trace_id", "decision_id": "payload.decision_id", "payment_id": "payload.payment_id", "source_event_id": "payload.source_event_id"}
    steps = [(f"regexp_full_match(trim({c}), '{_UUID}')", f"{name}: must be a UUID") for c, name in uuids.items()]
    steps += [
        ("trim(event_type) = 'risk.decision.completed'", 'event_type must be "risk.decision.completed"'), ("schema_version = 2", "schema_version must be 2"),
        ("lower(trim(event_id)) = lower(trim(decision_id))", "event_id must match payload.decision_id"), ("lower(trim(aggregate_id)) = lower(trim(payment_id))", "aggregate_id must match payload.payment_id"),
        ("occurred_at IS NOT NULL AND decision_at IS NOT NULL", "decision timestamps are required"), ("occurred_at = decision_at", "occurred_at must match payload.decision_at"),
        ("trim(decision) IN ('ALLOW', 'REVIEW', 'BLOCK')", "decision must be ALLOW, REVIEW, or BLOCK"), ("risk_score BETWEEN 0 AND 100 AND rule_score BETWEEN 0 AND 100 AND model_score BETWEEN 0 AND 100", "risk, rule, and model scores must be between 0 and 100"),
        ("NOT isnan(model_probability) AND model_probability BETWEEN 0 AND 1", "model_probability must be between 0 and 1"),
        ("NOT isnan(model_review_threshold) AND model_review_threshold > 0 AND model_review_threshold < 1", "model_review_threshold must be between 0 and 1 exclusively"),
        ("len(reason_codes) > 0", "reason_codes must contain at least one value"), (version, "rule_version must contain 1-255 characters"), ("length(trim(model_version)) BETWEEN 1 AND 255", "model_version must contain 1-255 characters"),
        ("velocity_5m >= 1", "velocity_5m must be at least 1"), ("regexp_full_match(trim(baseline_country), '[A-Z]{2}')", "baseline_country must contain two uppercase letters"),
        ("len(list_filter(reason_codes, lambda x: NOT coalesce(regexp_full_match(trim(x), '[A-Z0-9_]{1,100}'), false))) = 0", "invalid reason_code"),
    ]
    return "CASE " + " ".join(f"WHEN NOT coalesce({holds}, false) THEN '{message}'" for holds, message in steps) + " END"


ORACLE: dict[str, str] = {
    "decision_violations": _query("SELECT delivery_id, errors FROM chk WHERE errors <> ''", "chk"),
    "payment_violations": _query("SELECT delivery_id, errors FROM chp WHERE errors <> ''", "chp"),
    "first_violations": _query("SELECT split_part(errors, ',', 1) AS error_code, count(*) AS n FROM chk WHERE errors <> '' GROUP BY 1", "chk"),
    "violation_histogram": _query("SELECT stream_table, error_code, count(*) AS n FROM (SELECT 'decision_events' AS stream_table, unnest(string_split(errors, ',')) AS error_code FROM chk WHERE errors <> '' UNION ALL SELECT 'payment_events', unnest(string_split(errors, ',')) FROM chp WHERE errors <> '') GROUP BY ALL", "chk", "chp"),
    "stream_counts": " UNION ALL ".join(f"SELECT '{t}' AS stream_table, count(*) AS n_rows, count(DISTINCT {_id('event_id')}) AS n_events, count(DISTINCT batch_id) AS n_batches FROM {t}" for t in ("payment_events", "decision_events")),
    "metrics_daily": _query(_DERIVED, "m"),
    "metrics_merged": _query(_DERIVED, "m"),
    "metrics_inspection": _query("""SELECT concat_ws('.', metric_family, dimension_type) AS section, concat_ws('|', dimension_value, outcome, metric_bucket) AS member, CAST(sum(event_count) AS BIGINT) AS event_count, CAST(sum(amount_minor_sum) AS BIGINT) AS amount_minor_sum,
  sum(latency_ms_sum) / nullif(sum(latency_ms_count), 0) AS average_ms, min(latency_ms_min) AS least, max(latency_ms_max) AS greatest FROM m GROUP BY metric_family, dimension_type, dimension_value, outcome, metric_bucket""", "m"),
    "payments_current": _query(f"SELECT * REPLACE ({_PAY_TEXT}) FROM pay", "pay"),
    "payment_summary": _query("SELECT count(*) AS n_rows, CAST(coalesce(sum(amount_minor), 0) AS BIGINT) AS amount_minor_sum, " + ", ".join(f"count(*) FILTER (status = '{s}') AS n_{s.lower()}" for s in ("PENDING_RISK", "ALLOWED", "REVIEW", "BLOCKED", "FAILED")) + " FROM pay", "pay"),
    "decision_summary": _query("SELECT count(*) AS n_rows, " + ", ".join(f"count(*) FILTER (decision = '{s}') AS n_{s.lower()}" for s in ("ALLOW", "REVIEW", "BLOCK")) + ", coalesce(avg(risk_score), 0) AS risk_score_avg FROM dec", "dec"),
    "processing_summary": _query(_PROCESSING, "out", "del"),
    "operational_gauges": _query(_PROCESSING.replace(f"WHERE {_WAITING})", f"WHERE {_WAITING} AND delivery_attempts = 0)") + ", (SELECT count(*) FROM rev) AS n_reviews", "out", "del", "rev"),
    "recent_decisions": _query(f"SELECT d.decision_id, payment_id, p.customer_id, p.merchant_id, p.amount_minor, p.currency, p.country, p.status, d.decision, d.risk_score, {text('d.decision_at')} AS decision_at FROM dec d JOIN pay p USING (payment_id) ORDER BY d.decision_at DESC NULLS LAST, d.decision_id DESC LIMIT 20", "dec", "pay"),
    "latest_versions": _query(f"SELECT rule_version, model_version, {text('decision_at')} AS decision_at FROM dec ORDER BY dec.decision_at DESC NULLS LAST, decision_id DESC LIMIT 1", "dec"),
    "pending_reviews": _query(f"SELECT r.payment_id, r.decision_id, {text('r.enqueued_at')} AS enqueued_at, p.customer_id, p.amount_minor, p.currency, d.risk_score, d.model_version FROM rev r JOIN pay p ON p.payment_id = r.payment_id JOIN dec d ON d.decision_id = r.decision_id ORDER BY r.enqueued_at NULLS FIRST, r.payment_id LIMIT 50", "rev", "pay", "dec"),
    "next_due_events": f"SELECT id, {text('next_attempt_at')} AS next_attempt_at, delivery_attempts FROM outbox_events o WHERE {_WAITING} AND next_attempt_at <= {_instant(domain.AS_OF)} ORDER BY o.next_attempt_at, created_at, id LIMIT 100",
    "attention_count": _query(f"SELECT n_reviews, n_dead_lettered, n_rejected, n_exceptions, n_reviews + n_dead_lettered + n_rejected + n_exceptions AS n_attention FROM ({_PROCESSING}, (SELECT count(*) FROM rev) AS n_reviews, (SELECT count(*) FROM exc) AS n_exceptions)", "out", "del", "rev", "exc"),
    "newest_decision": _query(f"SELECT * REPLACE ({text('decision_at')} AS decision_at) FROM newest", "newest"),
    "decisions_by_day": _query("SELECT strftime(decision_at AT TIME ZONE 'UTC', '%Y-%m-%d') AS decision_date, count(*) AS total, count(*) FILTER (decision = 'ALLOW') AS allowed, count(*) FILTER (decision = 'REVIEW') AS reviewed, count(*) FILTER (decision = 'BLOCK') AS blocked FROM dec GROUP BY 1", "dec"),
    "dispositions": _query("SELECT disposition, count(*) AS n FROM del GROUP BY 1", "del"),
    "outcome_shares": _query("SELECT decision, count(*) AS n, CAST(floor(count(*) * 100.0 / sum(count(*)) OVER () + 0.5) AS INTEGER) AS percent FROM dec GROUP BY 1", "dec"),
    "reconciliation_report": _query("SELECT * FROM exc ORDER BY ALL", "exc"),
    "reconciliation_counts": _query("SELECT code, count(*) AS n FROM exc GROUP BY 1", "exc"),
    "reported_exceptions_by_code": "SELECT code, count(*) AS n FROM reconciliation_exceptions GROUP BY 1",
    "outbox_cardinality": _query("SELECT payment_id, count(o.id) AS n_events FROM pay p LEFT JOIN out o USING (payment_id) GROUP BY 1 HAVING count(o.id) <> 1", "pay", "out"),
    "exception_context": _query(f"SELECT exception_id, code, p.payment_id, status FROM reconciliation_exceptions x JOIN pay p ON p.payment_id = {_id('x.payment_id')} AND code LIKE '%DECISION%'", "pay"),
    "delay_percentiles": _percentiles("publish_ms"),
    "decision_delay_percentiles": _percentiles("decision_ms"),
    "delay_histogram": _query(_HISTOGRAM + " UNION ALL SELECT country, '+Inf', count(decision_ms) FROM delays GROUP BY country", "delays"),
    "decision_errors": f"SELECT * FROM (SELECT delivery_id, {_decision_error('length(trim(rule_version)) BETWEEN 1 AND 255')} AS store_error, {_decision_error("trim(rule_version) = 'rules-v1'")} AS worker_error FROM decision_events) WHERE store_error IS NOT NULL OR worker_error IS NOT NULL",
    "stream_counters": _query("""SELECT stream_table, source_topic, outcome, count(*) AS n FROM (
  SELECT 'payment_events' AS stream_table, source_topic, CASE WHEN errors <> '' THEN 'rejected' WHEN row_number() OVER (PARTITION BY errors <> '', lower(trim(event_id, ' ')) ORDER BY delivery_id) = 1 THEN 'accepted' ELSE 'repeated' END AS outcome FROM chp
  UNION ALL SELECT 'decision_events', source_topic, CASE WHEN errors <> '' THEN 'rejected' WHEN row_number() OVER (PARTITION BY errors <> '', lower(trim(event_id, ' ')) ORDER BY delivery_id) = 1 THEN 'accepted' ELSE 'repeated' END FROM chk) GROUP BY ALL""", "chp", "chk"),
    "load_summary": f"SELECT count(*) AS n_requests, count(DISTINCT {_id('payment_id')}) AS n_payments, count(*) FILTER (status = 'PENDING_RISK') AS n_accepted, count(*) FILTER (status IS DISTINCT FROM 'PENDING_RISK') AS n_other, count(*) / ((epoch_us(max(ingested_at)) - epoch_us(min(ingested_at))) / 1e6) AS per_second, avg(epoch_us(ingested_at) // 1000 - epoch_us(kafka_timestamp) // 1000) AS wait_ms_avg, min(amount_minor) AS least, max(amount_minor) AS greatest FROM payment_events",
    "score_confusion": _query("""SELECT *, coalesce(round_even(tp / nullif(tp + fp, 0), 6), 0) AS precision, coalesce(round_even(tp / nullif(tp + fn, 0), 6), 0) AS recall, coalesce(round_even(2 * tp / nullif(2 * tp + fp + fn, 0), 6), 0) AS f1
  FROM (SELECT count(*) FILTER (score < 0.05 AND label = 0) AS tn, count(*) FILTER (score >= 0.05 AND label = 0) AS fp, count(*) FILTER (score < 0.05 AND label = 1) AS fn, count(*) FILTER (score >= 0.05 AND label = 1) AS tp FROM lab)""", "lab"),
    "score_ranking": _query("""SELECT round(sum(neg * (cp - pos / 2)) / nullif(sum(pos) * sum(neg), 0), 9) AS roc_auc, round(sum(pos * cp / (cp + cn)) / nullif(sum(pos), 0), 9) AS average_precision FROM (
  SELECT pos, neg, sum(pos) OVER w AS cp, sum(neg) OVER w AS cn FROM (SELECT score AS s, CAST(count(*) FILTER (label = 1) AS DOUBLE) AS pos, CAST(count(*) FILTER (label = 0) AS DOUBLE) AS neg FROM lab GROUP BY 1) WINDOW w AS (ORDER BY s DESC))""", "lab"),
    "threshold_costs": _query("SELECT CAST(t AS INTEGER) AS threshold, CAST(500 * count(*) FILTER (label = 1 AND floor(round(score * 100, 9)) < t) + 25 * count(*) FILTER (label = 0 AND floor(round(score * 100, 9)) >= t) AS BIGINT) AS cost FROM lab, range(1, 100) r(t) GROUP BY t", "lab"),
    "best_threshold": _query("SELECT CAST(t AS INTEGER) AS threshold, CAST(500 * count(*) FILTER (label = 1 AND floor(round(score * 100, 9)) < t) + 25 * count(*) FILTER (label = 0 AND floor(round(score * 100, 9)) >= t) AS BIGINT) AS cost FROM lab, range(1, 100) r(t) GROUP BY t ORDER BY 2, 1 LIMIT 1", "lab"),
    "positive_rate": _query("SELECT count(*) AS n, avg(label) AS positive_rate FROM lab", "lab"),
    "customer_features": _features(300_000, 2_592_000_000),
    "customer_features_hourly": _features(3_600_000, 86_400_000),
    "created_requests": f"SELECT * EXCLUDE (first, rn, loaded), {text('loaded')} AS loaded_at, CASE WHEN request IS NULL THEN 'INVALID' WHEN rn = 1 THEN 'CREATED' WHEN request_fingerprint IS NOT DISTINCT FROM first THEN 'REPLAYED' ELSE 'CONFLICT' END AS outcome, first AS made_by FROM ({_REQUESTS})",
    "request_outcomes": f"SELECT CASE WHEN request IS NULL THEN 'INVALID' WHEN rn = 1 THEN 'CREATED' WHEN request_fingerprint IS NOT DISTINCT FROM first THEN 'REPLAYED' ELSE 'CONFLICT' END AS outcome, count(*) AS n FROM ({_REQUESTS}) GROUP BY 1",
    "request_violations": f"""SELECT {_id('id')} AS payment_id, {text('loaded_at')} AS loaded_at, unnest(['customer_id', 'merchant_id', 'device_id', 'amount_minor', 'currency', 'country']) AS field, unnest([{_IDENTIFIERS},
  CASE WHEN coalesce(amount_minor <= 0, true) THEN 'must be greater than zero' END, CASE WHEN NOT coalesce(regexp_full_match(upper(trim(currency)), '[A-Z]{{3}}'), false) THEN 'must be a three-letter currency code' END,
  CASE WHEN NOT coalesce(regexp_full_match(upper(trim(country)), '[A-Z]{{2}}'), false) THEN 'must be a two-letter country code' END]) AS message FROM payments""".replace("SELECT", "SELECT * FROM (SELECT", 1) + ") WHERE message IS NOT NULL",
    "canonical_ids": f"SELECT CASE WHEN regexp_full_match(trim(id), '(?i)[0-9a-f]{{8}}-[0-9a-f]{{4}}-4[0-9a-f]{{3}}-[89ab][0-9a-f]{{3}}-[0-9a-f]{{12}}') THEN 'version 4' WHEN regexp_full_match(trim(id), '{_UUID}') THEN 'other' ELSE 'none' END AS kind, count(*) AS n, count(DISTINCT CASE WHEN regexp_full_match(trim(id), '{_UUID}') THEN lower(trim(id)) END) AS n_ids FROM payments GROUP BY 1",
    "event_fingerprints": _query("SELECT delivery_id, digest AS fingerprint FROM dig WHERE errors = ''", "dig"),
    "decisions_applied": _query("SELECT delivery_id, decision_id, payment_id, disposition, error_code FROM app", "app"),
    "audit_log": _query(f"SELECT a.decision_id AS audit_id, a.payment_id, 'RISK_DECISION_RECORDED' AS event_type, 'SYSTEM' AS actor_type, {text('e.decision_at')} AS occurred_at FROM app a JOIN decision_events e USING (delivery_id) WHERE disposition = 'APPLIED'", "app"),
    "reviews_resolved": _query(f"""SELECT exception_id, payment_id, {text('reported_at')} AS reported_at, action, expected_version, outcome, CASE WHEN outcome = 'RESOLVED' THEN CASE action WHEN 'APPROVE' THEN 'APPROVED' ELSE 'REJECTED' END END AS review_status,
  CASE WHEN outcome = 'RESOLVED' THEN CASE action WHEN 'APPROVE' THEN 'ALLOWED' ELSE 'BLOCKED' END END AS payment_status, CAST(CASE WHEN outcome = 'RESOLVED' THEN 2 END AS INTEGER) AS version,
  CASE WHEN outcome = 'RESOLVED' THEN CASE action WHEN 'APPROVE' THEN 'MANUAL_REVIEW_APPROVED' ELSE 'MANUAL_REVIEW_REJECTED' END END AS audit_type FROM (
  SELECT *, CASE WHEN action = 'ESCALATE' THEN 'UNSUPPORTED_ACTION' WHEN NOT queued THEN 'NOT_FOUND' WHEN able AND turn = 1 THEN 'RESOLVED' WHEN turn > 1 OR (turn = 1 AND NOT able) THEN 'ALREADY_RESOLVED' WHEN expected_version <> 1 THEN 'VERSION_CONFLICT' ELSE 'STATE_CONFLICT' END AS outcome FROM (
  SELECT *, sum(CASE WHEN able THEN 1 ELSE 0 END) OVER (PARTITION BY payment_id ORDER BY reported_at, exception_id) AS turn FROM (
  SELECT x.*, q.payment_id IS NOT NULL AS queued, coalesce(x.action <> 'ESCALATE' AND x.expected_version = 1 AND q.payment_id IS NOT NULL AND p.status = 'REVIEW', false) AS able FROM (
  SELECT exception_id, {_id('payment_id')} AS payment_id, reported_at, CASE WHEN code IS NULL THEN 'ESCALATE' WHEN exception_id % 2 = 0 THEN 'APPROVE' ELSE 'REJECT' END AS action, CASE WHEN exception_id % 3 = 0 THEN 2 ELSE 1 END AS expected_version FROM reconciliation_exceptions) x
  LEFT JOIN (SELECT a.payment_id FROM app a JOIN decision_events e USING (delivery_id) WHERE disposition = 'APPLIED' AND e.decision = 'REVIEW') q ON q.payment_id = x.payment_id LEFT JOIN pay p ON p.payment_id = x.payment_id)))""", "app", "pay"),
    "outbox_drained": f"""SELECT id, CASE WHEN permanent IS NOT NULL THEN 'DEAD_LETTERED' WHEN last_error IS NOT NULL THEN 'RETRY' ELSE 'PUBLISHED' END AS outcome, CASE WHEN err IS NULL THEN {_NOW} END AS published_at, CASE WHEN permanent IS NOT NULL THEN {_NOW} END AS dead_lettered_at, {_NOW} AS last_attempt_at,
  CASE WHEN err IS NULL THEN {text('next_attempt_at')} ELSE {text(f"({_instant(domain.AS_OF)} + to_milliseconds(CAST(least(5000, 100 * pow(2, least(coalesce(delivery_attempts, 0), 20))) AS BIGINT)))")} END AS next_attempt_at, coalesce(delivery_attempts, 0) + 1 AS delivery_attempts, left(coalesce(err, last_error), 2000) AS last_error
FROM (SELECT *, coalesce(permanent, last_error) AS err FROM (SELECT *, coalesce({_ENVELOPE_ERROR}, CASE WHEN event_type <> 'payments.created' THEN 'unsupported event type ' || event_type END) AS permanent FROM outbox_events WHERE {_WAITING} AND next_attempt_at <= {_instant(domain.AS_OF)}))""",
    "outbox_envelope_errors": f"SELECT coalesce({_ENVELOPE_ERROR}, 'none') AS error, CASE WHEN json_valid(payload) THEN payload ->> '$.amount_minor' END IS NULL AS without_amount, count(*) AS n FROM outbox_events GROUP BY ALL",
    "forbidden_changes": _query(f"""SELECT decision_id, 'UPDATE' AS change FROM (SELECT {_id('decision_id')} AS decision_id, count(DISTINCT concat_ws('|', coalesce({_id('payment_id')}, '-'), coalesce(decision, '-'), coalesce(CAST(risk_score AS VARCHAR), '-'), coalesce(rule_version, '-'))) AS n
  FROM (SELECT *, row_number() OVER (PARTITION BY {_id('decision_id')} ORDER BY delivery_id) AS a, row_number() OVER (PARTITION BY {_id('decision_id')} ORDER BY delivery_id DESC) AS z FROM chk WHERE errors = '') WHERE a = 1 OR z = 1 GROUP BY 1) WHERE n > 1""", "chk"),
    "snapshot_contract": "SELECT CAST(NULL AS VARCHAR) AS problem WHERE false",
    "request_fingerprints": _query(f"SELECT payment_id, sha256({_CANONICAL}) AS fingerprint FROM pay", "pay"),
    "deterministic_ids": _query(f"SELECT event_id, concat(h[1:8], '-', h[9:12], '-5', h[14:16], '-', ('89ab')[(CAST('0x' || h[17] AS INTEGER) % 4) + 1], h[18:20], '-', h[21:32]) AS id FROM (SELECT event_id, {_SHA1} AS h FROM pev)", "pev"),
    "coordinate_conflicts": f"SELECT source_topic, source_partition, source_offset, leader_epoch, count(DISTINCT concat_ws('|', {_id('event_id')}, {_id('payment_id')}, decision, risk_score)) AS n_digests FROM decision_events GROUP BY ALL HAVING n_digests > 1",
    "retry_backoff": "SELECT delivery_attempts, count(*) AS n, CAST(least(5000, 100 * pow(2, least(delivery_attempts - 1, 20))) AS BIGINT) AS wait_ms FROM outbox_events WHERE delivery_attempts > 0 GROUP BY 1",
    "outbox_payloads": """SELECT payload ->> '$.currency' AS currency, count(*) AS n, CAST(sum(CAST(payload ->> '$.amount_minor' AS BIGINT)) AS BIGINT) AS amount_minor_sum,
  count(*) FILTER (NOT coalesce(list_sort(json_keys(payload)) = ['amount_minor', 'country', 'currency'], false)) AS n_other_keys FROM outbox_events GROUP BY 1""",
}
