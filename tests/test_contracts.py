"""The casts of single values, and the strict parse, against Python's own rules."""

from __future__ import annotations

import json
from datetime import datetime, timedelta, timezone

import pytest
from hypothesis import given
from hypothesis import strategies as st

from ledgerloom.functions.contracts import Bad, Contract, Number, Rule, as_decimal, as_micros, parse_json


def outcome(kind: str, value: object, **more: str) -> object:
    try:
        return Rule("t", more.pop("path", "f"), kind, **more).cast(value)
    except Bad as bad:
        return str(bad)


@pytest.mark.parametrize(
    ("kind", "value", "more", "expected"),
    [
        ("uuid", "AAAAAAAA-0000-4000-8000-00000000000F", {}, "aaaaaaaa-0000-4000-8000-00000000000f"),
        ("uuid", "aaaaaaaa-0000-4000-8000-00000000000f\n", {}, "not_a_uuid"),
        ("uuid", Number("5"), {}, "not_a_string"),
        ("text", "  x ", {}, "x"),
        ("text", "   ", {}, "blank"),
        ("text", "\t", {}, "\t"),
        ("text", "é" * 255, {}, "é" * 255),
        ("text", "x" * 256, {}, "too_long"),
        ("enum", "A", {"allowed": "A|B"}, "A"),
        ("enum", "a", {"allowed": "A|B"}, "not_allowed"),
        ("enum", Number("2"), {"allowed": "2", "path": "schema_version"}, 2),
        ("enum", "2", {"allowed": "2", "path": "schema_version"}, "not_an_integer"),
        ("enum", Number("2.0"), {"allowed": "2", "path": "schema_version"}, "not_allowed"),
        ("integer", Number("9223372036854775807"), {"highest": "<= 9223372036854775807"}, 2**63 - 1),
        ("integer", Number("9223372036854775808"), {"highest": "<= 9223372036854775807"}, "out_of_range"),
        ("integer", Number("9" * 9000), {"highest": "<= 5"}, "out_of_range"),
        ("integer", Number("1e2"), {}, "not_an_integer"),
        ("integer", Number("-0"), {"lowest": ">= 0"}, 0),
        ("integer", True, {}, "not_an_integer"),
        ("number", Number("1e-3"), {"lowest": "> 0"}, 0.001),
        ("number", Number("0"), {"lowest": "> 0"}, "out_of_range"),
        ("number", Number("1e-99999999999999999999"), {"lowest": "> 0", "highest": "< 1"}, 0.0),
        ("number", Number("1e99999999999999999999"), {"highest": "< 1"}, "out_of_range"),
        ("number", "0.5", {}, "not_a_number"),
        ("boolean", Number("1"), {}, "not_a_boolean"),
        ("boolean", False, {}, False),
        ("code", "USD", {"pattern": "[A-Z]{3}"}, "USD"),
        ("code", "USD\n", {"pattern": "[A-Z]{3}"}, "not_a_code"),
        ("code_list", [], {"pattern": "[A-Z]+"}, "empty_list"),
        ("code_list", ["A", None], {"pattern": "[A-Z]+"}, "not_a_string"),
        ("code_list", "A", {"pattern": "[A-Z]+"}, "not_a_list"),
        ("timestamp", "2024-02-30T00:00:00Z", {}, "timestamp_does_not_exist"),
        ("timestamp", "2024-01-01T24:00:00Z", {}, "timestamp_does_not_exist"),
        ("timestamp", "2024-01-01T00:00:00", {}, "not_a_timestamp"),
        ("timestamp", "2024-01-01T00:00:00.1234567Z", {}, "not_a_timestamp"),
        ("timestamp", "2024-01-01t00:00:00Z", {}, "not_a_timestamp"),
        ("timestamp", "2024-01-01T00:00:00+24:00", {}, "offset_does_not_exist"),
        ("timestamp", "1970-01-01T01:00:00.5+01:00", {}, 500_000),
        ("object", [], {}, "not_an_object"),
        ("uuid", None, {}, "null"),
    ],
)
def test_casts(kind, value, more, expected):
    assert outcome(kind, value, **dict(more)) == expected


@given(st.datetimes(datetime(1000, 1, 2), datetime(9998, 1, 1)), st.integers(-1439, 1439))
def test_instants(moment, minutes):
    zone = timezone(timedelta(minutes=minutes))
    text = moment.replace(tzinfo=zone).isoformat()
    expected = (moment.replace(tzinfo=zone) - datetime(1970, 1, 1, tzinfo=timezone.utc)) // timedelta(microseconds=1)
    assert as_micros(text) == expected


@pytest.mark.parametrize("text", ["", " ", "NaN", "[1,]", "{} {}", "{'a':1}", '{"a":01}', '{"a":+1}', '{"a":"\t"}', "\ufeff{}", '{"a":.5}', "[" * 100_000, "Infinity", '{"a":1.}'])
def test_what_json_is_not(text):
    with pytest.raises(ValueError):
        parse_json(text)


def test_json_keeps_numbers_and_pairs():
    found = parse_json(' \n{"a": 1.50, "b": "1.50", "a": -0}\t')
    assert isinstance(found["a"], list) and [str(x) for x in found["a"]] == ["1.50", "-0"]
    assert isinstance(found["a"][0], Number) and not isinstance(found["b"], Number)


@given(st.recursive(st.none() | st.booleans() | st.text(max_size=5), lambda x: st.lists(x, max_size=3) | st.dictionaries(st.text(max_size=3), x, max_size=3)))
def test_json_as_the_library_reads_it(value):
    assert parse_json(json.dumps(value)) == value


def test_structure():
    contract = Contract([Rule("t", "a", "text"), Rule("t", "o", "object"), Rule("t", "o.b", "boolean")])
    assert contract.walk(parse_json('{"o":{"b":true},"a":"x"}'))[0] == []
    assert contract.walk(parse_json('{"o":{"b":true}}'))[0] == ["missing:a"]
    assert contract.walk(parse_json('{"a":"x","o":{"b":true,"c":1}}'))[0] == ["unlisted:o"]
    assert contract.walk(parse_json('{"a":"x","A":1,"o":{"b":true}}'))[0] == ["unlisted:envelope"]
    assert contract.walk(parse_json("[]"))[0] == ["not_an_object"]
    # an object of the wrong kind is a value, not a structure
    faults, values = contract.walk(parse_json('{"a":"x","o":null}'))
    assert faults == [] and values[1] == [None]


def test_bounds_must_be_readable():
    with pytest.raises(ValueError):
        Rule("t", "f", "integer", lowest="5")
    with pytest.raises(ValueError):
        Rule("t", "f", "colour")
    assert as_decimal("-1e99999999999999999999") < 0
