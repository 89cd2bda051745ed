"""Parse failures over whole records, against a plain validator."""

from __future__ import annotations

import json
import re
from datetime import datetime, timezone

import pyarrow.parquet as pq

from ledgerloom.operators import rejects
from ledgerloom.sources.records import RECORD_SCHEMA
from ledgerloom.tables import table

FIELDS = "source_topic string, field_path string, value_kind string, lowest string, highest string, pattern string, allowed string, equal_to string"
NOW = datetime(2026, 8, 30, 12, tzinfo=timezone.utc)


def plain_failure(topic, raw, rules) -> bool:
    """Whether a value breaks the rules of its topic, spelled out without dictionaries."""
    own = {r["field_path"]: r for r in rules if r["source_topic"] == topic}
    if not own or raw is None:
        return True

    class Num(str):
        pass

    def no(x):
        raise ValueError

    try:
        message = json.loads(raw, parse_int=Num, parse_float=Num, parse_constant=no)
    except ValueError:
        return True
    if not isinstance(message, dict):
        return True
    flat = {}

    def walk(prefix, node) -> bool:
        names = {p[len(prefix):] for p in own if p.startswith(prefix) and "." not in p[len(prefix):]}
        if set(node) != names:
            return True
        for name, v in node.items():
            path = prefix + name
            flat[path] = v
            if own[path]["value_kind"] == "object" and (not isinstance(v, dict) or walk(path + ".", v)):
                return True
        return False

    if walk("", message):
        return True

    def moment(v):
        m = re.fullmatch(r"(\d{4}-\d\d-\d\dT\d\d:\d\d:\d\d)(\.\d{1,6})?(Z|[+-]\d\d:\d\d)", v, re.ASCII)
        return datetime.fromisoformat(m[1] + (m[2] or ".0").ljust(7, "0") + m[3].replace("Z", "+00:00")) if m else None

    for path, v in flat.items():
        r, kind = own[path], own[path]["value_kind"]
        is_text = isinstance(v, str) and not isinstance(v, Num)
        try:
            good = {
                "object": lambda: True,
                "uuid": lambda: is_text and bool(re.fullmatch("[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}", v)),
                "text": lambda: is_text and 1 <= len(v.strip(" ")) <= 255,
                "enum": lambda: isinstance(v, Num if path == "schema_version" else str) and (path == "schema_version" or is_text) and v in r["allowed"].split("|"),
                "integer": lambda: isinstance(v, Num) and bool(re.fullmatch("-?[0-9]+", v)) and eval(f"{int(v)} {r['lowest']} and {int(v)} {r['highest']}"),
                "number": lambda: isinstance(v, Num) and eval(f"{float(v)!r} {r['lowest']} and {float(v)!r} {r['highest']}"),
                "boolean": lambda: isinstance(v, bool),
                "code": lambda: is_text and bool(re.fullmatch(r["pattern"], v)),
                "code_list": lambda: isinstance(v, list) and len(v) > 0 and all(isinstance(x, str) and not isinstance(x, Num) and re.fullmatch(r["pattern"], x) for x in v),
                "timestamp": lambda: is_text and moment(v) is not None,
            }[kind]()
        except ValueError:
            return True
        if v is None or not good:
            return True
    for path, r in own.items():
        if r["equal_to"]:
            a, b = flat[path], flat[r["equal_to"]]
            if (moment(a) != moment(b)) if r["value_kind"] == "timestamp" else a.lower() != b.lower():
                return True
    return False


def test_against_a_plain_validator(spark, data):
    rules = pq.read_table(f"{data}/contract_fields.parquet").to_pylist()
    for directory in (data, data.replace("0.001", "0.01")):
        rows = pq.read_table(f"{directory}/broker_records.parquet").to_pylist()
        expected = {(r["source_topic"], r["source_partition"], r["source_offset"]) for r in rows if plain_failure(r["source_topic"], r["raw_value"], rules)}
        screened = rejects.Screened(table(spark, directory, "broker_records"), table(spark, directory, "contract_fields"))
        found = [tuple(r) for r in screened.coordinates().collect()]
        assert len(found) == len(set(found)) and set(found) == expected
        rejected = screened.rejected().collect()
        assert {(r.source_topic, r.source_partition, r.source_offset) for r in rejected} == expected
        assert all(r.reasons for r in rejected)
        loaded = sum(screened.valid(t).count() for t in ("payments.created", "risk.decisions"))
        assert loaded == len(rows) - len(expected)


def test_reasons_dictionary_and_edge_cases(spark):
    fields = spark.createDataFrame([("t", "a", "text", None, None, None, None, None), ("t", "n", "integer", ">= 1", "<= 9", None, None, None), ("t", "b", "text", None, None, None, None, "a")], FIELDS)
    long = "x" * 300_000
    raws = ['{"a":"x","n":5,"b":"x"}', '{"a":"x","n":0,"b":"x"}', '{"a":"y","n":0,"b":"y"}', '{"a":"x","n":"0","b":"y"}', None, "", '{"a":"x"}', f'{{"a":"{long}","n":5,"b":"x"}}', '{"a":"\\ud800","n":5,"b":"\\ud800"}', '{"n":1,"a":"q","b":"q","n":11}']
    records = [("t", 0, k, NOW, r) for k, r in enumerate(raws)] + [("u", 0, 99, NOW, raws[0]), (None, None, None, None, None)]
    frame = spark.createDataFrame(records, RECORD_SCHEMA).selectExpr("*", "1 AS raw", "'q' AS reason", "2 AS kind")
    screened = rejects.Screened(frame, fields)
    reasons = {r.source_offset: r.reasons for r in screened.rejected().collect()}
    assert reasons == {
        1: ["out_of_range:n"], 2: ["out_of_range:n"], 3: ["differs:b", "not_an_integer:n"], 4: ["null_value"], 5: ["malformed_json"], 6: ["missing:b", "missing:n"],
        7: ["too_long:a"], 9: ["out_of_range:n"], 99: ["unknown_topic"], None: ["unknown_topic"],
    }
    entries = {(r.path, r.token): r.reason for r in screened.invalid_values().collect()}
    assert entries[("n", "0")] == "out_of_range" and entries[("n", '"0"')] == "not_an_integer" and len(entries) == 4
    loaded = {r.source_offset: r for r in screened.valid("t").collect()}
    assert set(loaded) == {0, 8} and loaded[0].n == 5 and loaded[8].a == "\ufffd"


def test_the_dictionary_decides(spark, monkeypatch):
    """Listed values are judged nowhere but in the dictionary; each distinct one is cast once, however many rows have it."""
    fields = spark.createDataFrame([("t", "s", "enum", None, None, None, "A|B", None), ("t", "c", "code_list", None, None, "[A-Z]+", None, None), ("t", "f", "boolean", None, None, None, None, None)], FIELDS)
    row = lambda s, c, f: json.dumps({"s": s, "c": c, "f": f})
    raws = [row("A", ["X"], True), row("Z", ["X"], False), row("Z", ["x", "Y"], True)] * 50 + ['{"s":"Z","s":"A","c":["X"],"f":true}', '{"s":"\\u0041","c":["X"],"f":false}', row(None, [], 0)]
    frame = spark.createDataFrame([("t", None, None, NOW, r) for r in raws], RECORD_SCHEMA).repartition(5)
    for limit in (rejects.MAX_BROADCAST_BYTES, -1):
        monkeypatch.setattr(rejects, "MAX_BROADCAST_BYTES", limit)
        screened = rejects.Screened(frame, fields)
        assert sorted((r.path, r.token, r.reason) for r in screened.dictionary.collect()) == [("c", '["x","Y"]', "not_a_code"), ("c", "[]", "empty_list"), ("f", "0", "not_a_boolean"), ("s", '"Z"', "not_allowed"), ("s", "null", "null")]
        assert screened.found.filter("size(faults) + size(suspects) > 0").count() == 0
        counts = {}
        for r in screened.rejected().collect():
            counts[";".join(r.reasons)] = counts.get(";".join(r.reasons), 0) + 1
        assert counts == {"not_allowed:s": 51, "not_a_code:c;not_allowed:s": 50, "empty_list:c;not_a_boolean:f;null:s": 1}
        assert len(screened.coordinates().collect()) == 102
        loaded = screened.valid("t").collect()
        assert len(loaded) == 51 and {(r.s, tuple(r.c), r.f) for r in loaded} == {("A", ("X",), True), ("A", ("X",), False)}


def test_no_records(spark):
    fields = spark.createDataFrame([("t", "a", "text", None, None, None, None, None)], FIELDS)
    screened = rejects.Screened(spark.createDataFrame([], RECORD_SCHEMA), fields)
    assert screened.coordinates().count() == 0 and screened.rejected().count() == 0 and screened.invalid_values().count() == 0
    # without any contract every record fails
    one = spark.createDataFrame([("t", 0, 0, NOW, "{}")], RECORD_SCHEMA)
    assert rejects.Screened(one, fields.limit(0)).coordinates().count() == 1
