"""The SQL of the contract queries: strict (p1_...) and lenient (lake_...), as DuckDB runs it over ``contract_fields``.

Members of objects are listed with their order, so that names which occur twice are seen; kinds are judged from the JSON
type and text of each value. DuckDB's reader takes trailing commas and NaN, which are looked for apart.
"""

from __future__ import annotations

_UUID = "[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}"
_INSTANT = r"[0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9]{2}:[0-9]{2}:[0-9]{2}(\.[0-9]{1,6})?(Z|[+-][0-9]{2}:[0-9]{2})"
_NUMBERS = "('UBIGINT', 'BIGINT', 'HUGEINT', 'UHUGEINT', 'DOUBLE')"
_WHOLE = "('UBIGINT', 'BIGINT', 'HUGEINT', 'UHUGEINT')"


def instant_text(instant: str) -> str:
    """SQL for an instant as text with microseconds, in UTC."""
    return f"strftime({instant} AT TIME ZONE 'UTC', '%Y-%m-%d %H:%M:%S.%f')"


_RECORDS = r"""
r AS (SELECT row_number() OVER () AS rid, source_topic AS t, source_partition AS p, source_offset AS o, kafka_timestamp AS k, raw_value AS raw, regexp_replace(raw_value, '"([^"\\]|\\.)*"', '""', 'g') AS bare FROM broker_records),
c AS (SELECT source_topic AS t, field_path AS path, CASE WHEN contains(field_path, '.') THEN regexp_extract(field_path, '^(.*)\.[^.]*$', 1) ELSE '' END AS parent, regexp_extract(field_path, '[^.]*$') AS name,
  value_kind AS kind, lowest, highest, pattern, allowed, equal_to FROM contract_fields),
known AS (SELECT DISTINCT t FROM c),
j AS (SELECT r.*, CASE WHEN known.t IS NULL THEN 'unknown_topic' WHEN raw IS NULL THEN 'null_value'
    WHEN NOT json_valid(raw) OR regexp_matches(bare, ',\s*[\]}]') OR regexp_matches(bare, '(?i)nan|inf') THEN 'malformed_json' WHEN json_type(raw) <> 'OBJECT' THEN 'not_an_object' END AS fault
  FROM r LEFT JOIN known USING (t)),
o0 AS (SELECT rid, t, '' AS parent, 0 AS oid, CAST(raw AS JSON) AS obj FROM j WHERE fault IS NULL),
m1 AS (SELECT b.rid, b.t, b.parent, b.oid, e.key AS name, e.value AS v, e.id AS n FROM o0 b, json_each(b.obj) e),
o1 AS (SELECT m1.rid, m1.t, m1.name AS parent, m1.n AS oid, m1.v AS obj FROM m1 JOIN c ON c.t = m1.t AND c.path = m1.name AND c.kind = 'object' WHERE json_type(m1.v) = 'OBJECT'),
m2 AS (SELECT b.rid, b.t, b.parent, b.oid, e.key AS name, e.value AS v, e.id AS n FROM o1 b, json_each(b.obj) e),
o2 AS (SELECT m2.rid, m2.t, m2.parent || '.' || m2.name AS parent, m2.oid * 1000000 + m2.n AS oid, m2.v AS obj FROM m2 JOIN c ON c.t = m2.t AND c.path = m2.parent || '.' || m2.name AND c.kind = 'object' WHERE json_type(m2.v) = 'OBJECT'),
m3 AS (SELECT b.rid, b.t, b.parent, b.oid, e.key AS name, e.value AS v, e.id AS n FROM o2 b, json_each(b.obj) e),
objects AS (SELECT * FROM o0 UNION ALL SELECT * FROM o1 UNION ALL SELECT * FROM o2),
members AS (SELECT * FROM m1 UNION ALL SELECT * FROM m2 UNION ALL SELECT * FROM m3),
typed AS (SELECT m.rid, m.t, c.path, c.kind, c.name, c.lowest, c.highest, c.pattern, c.allowed, m.oid, m.n, m.v, json_type(m.v) AS jt, m.v ->> '$' AS s, CAST(m.v AS VARCHAR) AS w FROM members m JOIN c ON c.t = m.t AND c.parent = m.parent AND c.name = m.name)"""


def _outside(kind: str, bound: str) -> str:
    """True for a number that violates a bound such as ``>= 0``; one that ``kind`` can't hold violates any."""
    number, value = f"coalesce(TRY_CAST(w AS {kind}), 'inf'::DOUBLE)" if kind == "DOUBLE" else f"TRY_CAST(w AS {kind})", f"TRY_CAST(regexp_extract({bound}, '[^<>= ].*$') AS {kind})"
    signs = " ".join(f"WHEN '{sign}' THEN NOT {number} {sign} {value}" for sign in (">=", "<=", ">", "<"))
    return f"coalesce(CASE regexp_extract({bound}, '^[<>=]+') {signs} END, false)"


_OUT = f"({_outside('DOUBLE', 'lowest')} OR {_outside('DOUBLE', 'highest')})"
_OUT_WHOLE = f"(TRY_CAST(w AS HUGEINT) IS NULL OR {_outside('HUGEINT', 'lowest')} OR {_outside('HUGEINT', 'highest')})"
_PARTS = "CAST(s[12:13] AS INTEGER) > 23 OR CAST(s[15:16] AS INTEGER) > 59 OR CAST(s[18:19] AS INTEGER) > 59 OR s[1:4] = '0000' OR TRY_CAST(s[1:10] AS DATE) IS NULL"
_OFFSET = r"regexp_extract(s, '[+-][0-9]{2}:[0-9]{2}$')"
_MICROS = (
    f"epoch_us(CAST(regexp_extract(s, '^[^Z+]{{19,26}}') AS TIMESTAMP)) - CASE WHEN {_OFFSET} = '' THEN 0 ELSE (CASE {_OFFSET}[1] WHEN '-' THEN -1 ELSE 1 END) * (CAST({_OFFSET}[2:3] AS BIGINT) * 60 + CAST({_OFFSET}[5:6] AS BIGINT)) * 60000000 END"
).replace("'^[^Z+]{19,26}'", r"'^[0-9-]{10}T[0-9:]{8}(\.[0-9]+)?'")

_STRICT = _RECORDS + f""",
why AS (SELECT *, CASE
  WHEN kind = 'object' AND jt = 'OBJECT' THEN NULL WHEN jt = 'NULL' THEN 'null' WHEN kind = 'object' THEN 'not_an_object'
  WHEN kind = 'enum' AND name = 'schema_version' THEN CASE WHEN jt NOT IN {_NUMBERS} THEN 'not_an_integer' WHEN NOT list_contains(string_split(allowed, '|'), w) THEN 'not_allowed' END
  WHEN kind IN ('uuid', 'text', 'enum', 'code', 'timestamp') AND jt <> 'VARCHAR' THEN 'not_a_string'
  WHEN kind = 'uuid' THEN CASE WHEN NOT regexp_full_match(s, '{_UUID}') THEN 'not_a_uuid' END
  WHEN kind = 'text' THEN CASE WHEN trim(s, ' ') = '' THEN 'blank' WHEN length(trim(s, ' ')) > 255 THEN 'too_long' END
  WHEN kind = 'enum' THEN CASE WHEN NOT list_contains(string_split(allowed, '|'), s) THEN 'not_allowed' END
  WHEN kind = 'code' THEN CASE WHEN NOT regexp_full_match(s, pattern) THEN 'not_a_code' END
  WHEN kind = 'boolean' THEN CASE WHEN jt <> 'BOOLEAN' THEN 'not_a_boolean' END
  WHEN kind = 'integer' THEN CASE WHEN jt NOT IN {_WHOLE} THEN 'not_an_integer' WHEN {_OUT_WHOLE} THEN 'out_of_range' END
  WHEN kind = 'number' THEN CASE WHEN jt NOT IN {_NUMBERS} THEN 'not_a_number' WHEN {_OUT} THEN 'out_of_range' END
  WHEN kind = 'code_list' THEN CASE WHEN jt <> 'ARRAY' THEN 'not_a_list' WHEN json_array_length(v) = 0 THEN 'empty_list'
    ELSE list_extract(list_filter(list_transform(CAST(v AS JSON[]), lambda x: CASE WHEN coalesce(json_type(x), 'NULL') <> 'VARCHAR' THEN 'not_a_string' WHEN NOT regexp_full_match(x ->> '$', pattern) THEN 'not_a_code' END), lambda x: x IS NOT NULL), 1) END
  WHEN NOT regexp_full_match(s, '{_INSTANT}') THEN 'not_a_timestamp' WHEN {_PARTS} THEN 'timestamp_does_not_exist'
  WHEN {_OFFSET} <> '' AND (CAST({_OFFSET}[2:3] AS INTEGER) > 23 OR CAST({_OFFSET}[5:6] AS INTEGER) > 59) THEN 'offset_does_not_exist' END AS reason FROM typed),
best AS (SELECT rid, t, path, kind, last(CASE WHEN kind = 'timestamp' THEN CAST({_MICROS} AS VARCHAR) WHEN kind = 'uuid' THEN lower(s) WHEN kind = 'text' THEN trim(s, ' ')
    WHEN kind = 'code_list' THEN array_to_string(CAST(v AS VARCHAR[]), '|') WHEN jt = 'VARCHAR' THEN s ELSE w END ORDER BY oid, n) AS x FROM why WHERE reason IS NULL AND kind <> 'object' GROUP BY ALL),
faults AS (
  SELECT rid, fault AS f FROM j WHERE fault IS NOT NULL
  UNION SELECT b.rid, 'missing:' || c.path FROM objects b JOIN c ON c.t = b.t AND c.parent = b.parent LEFT JOIN members m ON m.rid = b.rid AND m.parent = b.parent AND m.oid = b.oid AND m.name = c.name WHERE m.rid IS NULL
  UNION SELECT m.rid, 'unlisted:' || CASE WHEN m.parent = '' THEN 'envelope' ELSE m.parent END FROM members m LEFT JOIN c ON c.t = m.t AND c.parent = m.parent AND c.name = m.name WHERE c.t IS NULL
  UNION SELECT rid, reason || ':' || path FROM why WHERE reason IS NOT NULL
  UNION SELECT a.rid, 'differs:' || a.path FROM best a JOIN c ON c.t = a.t AND c.path = a.path JOIN best b ON b.rid = a.rid AND b.path = c.equal_to WHERE a.x <> b.x)"""


def _envelopes(topic: str, columns: dict[str, tuple[str, str]]) -> str:
    """``columns``: name to (path, SQL form of the text x)."""
    cells = ", ".join(f"any_value({form}) FILTER (path = '{path}') AS {name}" for name, (path, form) in columns.items())
    return f"""WITH {_STRICT}
SELECT any_value(j.t) AS source_topic, any_value(j.p) AS source_partition, any_value(j.o) AS source_offset, any_value({instant_text('j.k')}) AS kafka_timestamp, {cells}
FROM j JOIN best USING (rid) WHERE j.t = '{topic}' AND j.rid NOT IN (SELECT rid FROM faults) GROUP BY j.rid"""


_TIME = instant_text("TRY(make_timestamptz(TRY_CAST(x AS BIGINT)))")
_ENVELOPE = {n: (n, "x") for n in ("event_id", "event_type", "aggregate_id", "trace_id")} | {"schema_version": ("schema_version", "TRY_CAST(x AS INTEGER)"), "occurred_at": ("occurred_at", _TIME)}
_PAYMENT = {n: (f"payload.{n}", "x") for n in ("payment_id", "customer_id", "merchant_id", "device_id", "currency", "country", "status")} | {"amount_minor": ("payload.amount_minor", "TRY_CAST(x AS BIGINT)"), "created_at": ("payload.created_at", _TIME)}
_DECISION = (
    {n: (f"payload.{n}", "x") for n in ("decision_id", "payment_id", "source_event_id", "decision", "reason_codes", "rule_version", "model_version")}
    | {n: (f"payload.{n}", "TRY_CAST(x AS BIGINT)") for n in ("risk_score", "rule_score", "model_score")} | {n: (f"payload.{n}", "TRY_CAST(x AS DOUBLE)") for n in ("model_probability", "model_review_threshold")}
    | {"decision_at": ("payload.decision_at", _TIME), "features_decision_at": ("payload.features.decision_at", _TIME), "velocity_5m": ("payload.features.velocity_5m", "TRY_CAST(x AS BIGINT)"), "baseline_country": ("payload.features.baseline_country", "x")}
    | {n: (f"payload.features.{n}", "TRY_CAST(x AS BOOLEAN)") for n in ("new_device", "cross_border")}
)

#: Code, path, check and its argument, in the order of the report.
_LAKE = {
    "payments.created": """
invalid_event_type event_type is payments.created
invalid_schema_version schema_version is 1
invalid_event_id event_id uuid
invalid_aggregate_id aggregate_id uuid
invalid_trace_id trace_id uuid
missing_occurred_at occurred_at instant
occurred_at_not_utc occurred_at offset
invalid_payment_id payload.payment_id uuid
invalid_customer_id payload.customer_id text
invalid_merchant_id payload.merchant_id text
invalid_device_id payload.device_id text
invalid_amount_minor payload.amount_minor from 1
invalid_currency payload.currency like [A-Z]{3}
invalid_country payload.country like [A-Z]{2}
invalid_payment_status payload.status is PENDING_RISK
missing_created_at payload.created_at instant
created_at_not_utc payload.created_at offset
aggregate_payment_mismatch aggregate_id differs payload.payment_id
""",
    "risk.decisions": """
invalid_event_type event_type is risk.decision.completed
invalid_schema_version schema_version is 2
invalid_event_id event_id uuid
invalid_aggregate_id aggregate_id uuid
invalid_trace_id trace_id uuid
missing_occurred_at occurred_at instant
occurred_at_not_utc occurred_at offset
invalid_decision_id payload.decision_id uuid
invalid_payment_id payload.payment_id uuid
invalid_source_event_id payload.source_event_id uuid
invalid_decision payload.decision is ALLOW|REVIEW|BLOCK
invalid_risk_score payload.risk_score between 0|100
invalid_rule_score payload.rule_score between 0|100
invalid_model_score payload.model_score between 0|100
invalid_model_probability payload.model_probability between 0|1
invalid_model_threshold payload.model_review_threshold inside 0|1
missing_reason_codes payload.reason_codes some
invalid_reason_code payload.reason_codes each [A-Z0-9_]{1,100}
invalid_rule_version payload.rule_version text
invalid_model_version payload.model_version text
missing_decision_at payload.decision_at instant
decision_at_not_utc payload.decision_at offset
invalid_velocity_5m payload.features.velocity_5m from 1
missing_new_device payload.features.new_device present
missing_cross_border payload.features.cross_border present
invalid_baseline_country payload.features.baseline_country like [A-Z]{2}
missing_feature_decision_at payload.features.decision_at instant
event_decision_mismatch event_id differs payload.decision_id
aggregate_payment_mismatch aggregate_id differs payload.payment_id
occurred_decision_time_mismatch occurred_at later payload.decision_at
feature_decision_time_mismatch payload.decision_at later payload.features.decision_at
""",
}


def _v(path: str) -> str:
    return '"' + path.replace(".", "_") + '"'


def _instant(path: str) -> str:
    return f"TRY_CAST({_v(path)} AS TIMESTAMPTZ)"


def _condition(path: str, check: str, argument: str) -> str:
    v, parts = _v(path), argument.split("|")
    listed = ", ".join(f"'{p}'" for p in parts)
    return {
        "is": lambda: f"{v} IS NULL OR {v} NOT IN ({listed})", "uuid": lambda: f"{v} IS NULL OR NOT regexp_full_match({v}, '{_UUID}')",
        "text": lambda: f"{v} IS NULL OR trim({v}, ' ') = '' OR length(trim({v}, ' ')) > 255", "instant": lambda: f"{_instant(path)} IS NULL",
        "offset": lambda: f"{v} IS NOT NULL AND NOT regexp_matches({v}, '(Z|[+-][0-9]{{2}}:[0-9]{{2}})$')", "from": lambda: f"{v} IS NULL OR TRY_CAST({v} AS BIGINT) < {argument}",
        "like": lambda: f"{v} IS NULL OR NOT regexp_full_match({v}, '{argument}')", "between": lambda: f"{v} IS NULL OR TRY_CAST({v} AS DOUBLE) NOT BETWEEN {parts[0]} AND {parts[1]}",
        "inside": lambda: f"{v} IS NULL OR TRY_CAST({v} AS DOUBLE) <= {parts[0]} OR TRY_CAST({v} AS DOUBLE) >= {parts[1]}", "present": lambda: f"{v} IS NULL",
        "some": lambda: f"{v} IS NULL OR TRY_CAST({v} AS JSON[]) IS NULL OR len(TRY_CAST({v} AS JSON[])) = 0",
        "each": lambda: f"len(list_filter(TRY_CAST({v} AS JSON[]), lambda x: NOT coalesce(regexp_full_match(x ->> '$', '{argument}'), false))) > 0",
        "differs": lambda: f"lower({v}) <> lower({_v(argument)})", "later": lambda: f"{_instant(path)} <> {_instant(argument)}",
    }[check]()


def _lake(topic: str) -> tuple[list[str], list[tuple[str, str]]]:
    """(paths, (code, condition) in order)."""
    lines = [(line.split(" ", 3) + [""])[:4] for line in _LAKE[topic].strip().splitlines()]
    times = sorted({path for _, path, check, _ in lines if check == "instant"})
    unread = " OR ".join(f"({_v(p)} IS NOT NULL AND {_instant(p)} IS NULL)" for p in times)
    return sorted({path for _, path, _, _ in lines}), [("malformed_json", f"broken OR {unread}")] + [(code, _condition(path, check, argument)) for code, path, check, argument in lines]


#: Spark's reader takes names and texts in single quotes, and ignores what follows the first value.
_SPELLED = r"""CASE WHEN regexp_matches(raw_value, '^\s*\{\s*''') THEN replace(raw_value, '''', '"') WHEN NOT json_valid(raw_value) AND json_valid(regexp_replace(raw_value, '\}[^}]*$', '}')) THEN regexp_replace(raw_value, '\}[^}]*$', '}') ELSE raw_value END"""


def _lake_tables() -> str:
    """Tables e0, e1: a topic's records with the last value at each path as text, and their codes; and ``quarantined``."""
    lenient = _RECORDS.replace(" OR regexp_matches(bare, '(?i)nan|inf')", "")  # Spark's reader takes these as numbers too
    out = [lenient.replace("raw_value AS raw, regexp_replace(raw_value,", f"raw_value AS written, {_SPELLED} AS raw, regexp_replace({_SPELLED},")]
    out.append(f"""typed2 AS (SELECT *, CASE WHEN jt = 'NULL' THEN NULL WHEN kind = 'code_list' THEN w ELSE s END AS text,
  jt <> 'NULL' AND CASE WHEN kind = 'object' THEN jt <> 'OBJECT' WHEN kind = 'boolean' THEN jt <> 'BOOLEAN' WHEN kind = 'code_list' THEN jt <> 'ARRAY' WHEN kind = 'number' THEN jt NOT IN {_NUMBERS}
    WHEN kind = 'integer' OR name = 'schema_version' THEN jt NOT IN {_WHOLE} OR TRY_CAST(w AS BIGINT) IS NULL OR (TRY_CAST(w AS INTEGER) IS NULL AND name <> 'amount_minor') ELSE false END AS misfit FROM typed)""")
    parts = []
    for k, topic in enumerate(_LAKE):
        paths, codes = _lake(topic)
        cells = ", ".join(f"last(CASE WHEN NOT misfit THEN text END ORDER BY oid, n) FILTER (path = '{p}') AS {_v(p)}" for p in paths)
        out.append(f"f{k} AS (SELECT rid, bool_or(misfit) AS misfit, {cells} FROM typed2 WHERE t = '{topic}' GROUP BY rid)")
        listed = ", ".join(f"CASE WHEN {condition} THEN '{code}' END" for code, condition in codes)
        out.append(f"g{k} AS (SELECT j.rid, j.t, j.p, j.o, j.k, j.written, j.fault IS NOT NULL OR coalesce(misfit, false) AS broken, f{k}.* EXCLUDE (rid, misfit) FROM j LEFT JOIN f{k} USING (rid) WHERE j.t = '{topic}')")
        out.append(f"e{k} AS (SELECT *, concat_ws('|', {listed}) AS errors FROM g{k})")
        parts.append(f"SELECT t, p, o, k, written, errors FROM e{k} WHERE errors <> ''")
    unknown = " AND ".join(f"t <> '{topic}'" for topic in _LAKE)
    parts.append(f"SELECT t, p, o, k, written, 'unsupported_topic' FROM r WHERE t IS NULL OR ({unknown})")
    out.append("quarantined AS (" + " UNION ALL ".join(parts) + ")")
    return ",\n".join(out)


def _flat(k: int, plain: str, lower: str, trimmed: str, times: str, casts: dict[str, str], lists: str = "") -> str:
    name = lambda path: path.rpartition(".")[2]
    cells = [f"{_v(p)} AS {name(p)}" for p in plain.split()] + [f"lower({_v(p)}) AS {name(p)}" for p in lower.split()] + [f"trim({_v(p)}, ' ') AS {name(p)}" for p in trimmed.split()]
    cells += [f"{instant_text(_instant(p))} AS {name(p)}" for p in times.split()] + [f"CAST({_v(p)} AS {kind}) AS {name(p)}" for p, kind in casts.items()]
    cells += [f"array_to_string(CAST({_v(p)} AS VARCHAR[]), '|') AS {name(p)}" for p in lists.split()]
    cells.append(f"strftime({_instant('occurred_at')} AT TIME ZONE 'UTC', '%Y-%m-%d') AS event_date")
    return f"WITH {_lake_tables()} SELECT t AS source_topic, p AS source_partition, o AS source_offset, {instant_text('k')} AS kafka_timestamp, {', '.join(cells)} FROM e{k} WHERE errors = ''"


_IDS = "event_id aggregate_id trace_id payload.payment_id"
ORACLE: dict[str, str] = {
    "p1_found": f"WITH {_STRICT} SELECT t AS source_topic, p AS source_partition, o AS source_offset FROM j WHERE rid IN (SELECT rid FROM faults)",
    "p1_quarantine": f"""WITH {_STRICT} SELECT any_value(t) AS source_topic, any_value(p) AS source_partition, any_value(o) AS source_offset, any_value({instant_text('k')}) AS kafka_timestamp, any_value(raw) AS _corrupt_record, string_agg(f, ';' ORDER BY f) AS reasons
FROM j JOIN faults USING (rid) GROUP BY rid""",
    "p1_invalid_values": f"WITH {_STRICT} SELECT t AS source_topic, path, reason, count(DISTINCT w) AS n_values FROM why WHERE reason IS NOT NULL GROUP BY ALL",
    "p1_payment_envelopes": _envelopes("payments.created", _ENVELOPE | _PAYMENT),
    "p1_decision_envelopes": _envelopes("risk.decisions", _ENVELOPE | _DECISION),
    "lake_payments": _flat(0, "event_type payload.currency payload.country payload.status", _IDS, "payload.customer_id payload.merchant_id payload.device_id", "occurred_at payload.created_at", {"schema_version": "INTEGER", "payload.amount_minor": "BIGINT"}),
    "lake_decisions": _flat(
        1, "event_type payload.decision payload.features.baseline_country", _IDS + " payload.decision_id payload.source_event_id", "payload.rule_version payload.model_version", "occurred_at payload.decision_at",
        {"schema_version": "INTEGER"} | {f"payload.{n}": "INTEGER" for n in ("risk_score", "rule_score", "model_score", "features.velocity_5m")} | {f"payload.{n}": "DOUBLE" for n in ("model_probability", "model_review_threshold")}
        | {f"payload.features.{n}": "BOOLEAN" for n in ("new_device", "cross_border")}, "payload.reason_codes",
    ),
    "lake_quarantine": f"WITH {_lake_tables()} SELECT t AS source_topic, p AS source_partition, o AS source_offset, {instant_text('k')} AS kafka_timestamp, written AS raw_value, errors AS error_codes, strftime(k AT TIME ZONE 'UTC', '%Y-%m-%d') AS event_date FROM quarantined",
}
