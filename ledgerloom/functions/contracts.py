"""Contracts of JSON messages, as a table of fields, and the casts of single values.

Nothing here knows Spark: the rules are plain objects that executors get with the function that uses them.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field
from datetime import datetime, timedelta, timezone
from decimal import Decimal, InvalidOperation

#: What a contract's patterns mean.
UUID = re.compile(r"[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}")
INSTANT = re.compile(r"([0-9]{4})-([0-9]{2})-([0-9]{2})T([0-9]{2}):([0-9]{2}):([0-9]{2})(?:\.([0-9]{1,6}))?(?:Z|([+-])([0-9]{2}):([0-9]{2}))")
BOUND = re.compile(r"(>=|<=|>|<) *(\S+)")
EPOCH = datetime(1970, 1, 1, tzinfo=timezone.utc)
MICRO = timedelta(microseconds=1)
#: More digits than any bound of a contract has; longer integers are out of range without being converted.
MAX_DIGITS = 60


class Number(str):
    """A JSON number as it is written."""

    __slots__ = ()


class Bad(ValueError):
    """A value that isn't of its kind; the message is the reason."""


def as_decimal(text: str) -> Decimal:
    """The exact value of a JSON number, with exponents beyond ``decimal`` replaced by its extremes."""
    try:
        value = Decimal(text)
        if value.is_finite():
            return value
    except InvalidOperation:
        pass
    mantissa, _, exponent = text.lower().partition("e")
    if not mantissa.strip("-0."):
        return Decimal(0)
    size = Decimal("1e-999999") if exponent.startswith("-") else Decimal("1e999999")
    return -size if text.startswith("-") else size


def as_micros(text: str) -> int:
    """Microseconds since the epoch of ``YYYY-MM-DDThh:mm:ss[.f]`` with ``Z`` or an offset under 24 hours."""
    parts = INSTANT.fullmatch(text)
    if parts is None:
        raise Bad("not_a_timestamp")
    year, month, day, hour, minute, second = map(int, parts.groups()[:6])
    try:
        moment = datetime(year, month, day, hour, minute, second, int((parts[7] or "").ljust(6, "0")), timezone.utc)
    except ValueError:
        raise Bad("timestamp_does_not_exist") from None
    shift = 0
    if parts[8]:
        hours, minutes = int(parts[9]), int(parts[10])
        if hours > 23 or minutes > 59:
            raise Bad("offset_does_not_exist")
        shift = (hours * 60 + minutes) * (-1 if parts[8] == "-" else 1)
    return (moment - EPOCH) // MICRO - shift * 60_000_000


@dataclass
class Rule:
    """One field of a contract. ``cast`` turns a JSON value into its comparable form, or raises ``Bad``."""

    topic: str
    path: str
    kind: str
    lowest: str | None = None
    highest: str | None = None
    pattern: str | None = None
    allowed: str | None = None
    equal_to: str | None = None
    bounds: list[tuple[str, Decimal]] = field(default_factory=list)

    def __post_init__(self) -> None:
        for text in (self.lowest, self.highest):
            if text is not None:
                parts = BOUND.fullmatch(text.strip())
                if parts is None:
                    raise ValueError(f"{self.topic} {self.path}: {text!r} is no bound")
                self.bounds.append((parts[1], Decimal(parts[2])))
        if self.kind not in CASTS:
            raise ValueError(f"{self.topic} {self.path}: kind {self.kind!r} is unknown")

    def cast(self, value: object) -> object:
        if value is None:
            raise Bad("null")
        return CASTS[self.kind](self, value)

    def within(self, number: Decimal) -> None:
        for sign, bound in self.bounds:
            if not {">=": number >= bound, "<=": number <= bound, ">": number > bound, "<": number < bound}[sign]:
                raise Bad("out_of_range")


def _text_of(value: object, reason: str) -> str:
    if isinstance(value, Number) or not isinstance(value, str):
        raise Bad(reason)
    return value


def _uuid(rule: Rule, value: object) -> str:
    if not UUID.fullmatch(_text_of(value, "not_a_string")):
        raise Bad("not_a_uuid")
    return value.lower()


def _text(rule: Rule, value: object) -> str:
    trimmed = _text_of(value, "not_a_string").strip(" ")
    if not trimmed:
        raise Bad("blank")
    if len(trimmed) > 255:
        raise Bad("too_long")
    return trimmed


def _enum(rule: Rule, value: object) -> object:
    allowed = (rule.allowed or "").split("|")
    whole = rule.path.rpartition(".")[2] == "schema_version"
    if isinstance(value, Number) != whole or not isinstance(value, str):
        raise Bad("not_an_integer" if whole else "not_a_string")
    if value not in allowed:
        raise Bad("not_allowed")
    return int(value) if whole else value


def _integer(rule: Rule, value: object) -> int:
    if not isinstance(value, Number) or not value.lstrip("-").isdigit():
        raise Bad("not_an_integer")
    if len(value) > MAX_DIGITS:
        raise Bad("out_of_range")
    rule.within(Decimal(value))
    return int(value)


def _number(rule: Rule, value: object) -> float:
    if not isinstance(value, Number):
        raise Bad("not_a_number")
    rule.within(as_decimal(value))
    return float(value)


def _boolean(rule: Rule, value: object) -> bool:
    if not isinstance(value, bool):
        raise Bad("not_a_boolean")
    return value


def _code(rule: Rule, value: object) -> str:
    if not re.fullmatch(rule.pattern or "", _text_of(value, "not_a_string")):
        raise Bad("not_a_code")
    return value


def _code_list(rule: Rule, value: object) -> list[str]:
    if not isinstance(value, list):
        raise Bad("not_a_list")
    if not value:
        raise Bad("empty_list")
    return [_code(rule, item) for item in value]


def _timestamp(rule: Rule, value: object) -> int:
    return as_micros(_text_of(value, "not_a_string"))


def _object(rule: Rule, value: object) -> dict:
    if not isinstance(value, dict):
        raise Bad("not_an_object")
    return value


CASTS: dict[str, Callable[[Rule, object], object]] = {
    "uuid": _uuid, "text": _text, "enum": _enum, "integer": _integer, "number": _number, "boolean": _boolean,
    "code": _code, "code_list": _code_list, "timestamp": _timestamp, "object": _object,
}


class Repeated(list):
    """The values of a name that occurs more than once in an object, in order."""


def _members(pairs: list[tuple[str, object]]) -> dict[str, object]:
    members: dict[str, object] = {}
    for name, value in pairs:
        if name in members:
            before = members[name]
            value = Repeated([*(before if isinstance(before, Repeated) else [before]), value])
        members[name] = value
    return members


def _no_constant(text: str) -> None:
    raise ValueError(text)


_DECODER = json.JSONDecoder(object_pairs_hook=_members, parse_int=Number, parse_float=Number, parse_constant=_no_constant, strict=True)


def parse_json(text: str) -> object:
    """The value of exactly one JSON text by RFC 8259, with numbers as written; ``ValueError`` for anything else.

    Nesting deeper than the interpreter's stack allows is an error too: no contract is that deep.
    """
    try:
        return _DECODER.decode(text)
    except RecursionError:
        raise ValueError("nested too deeply") from None


class Contract:
    """The fields of one topic and the walk over a message that finds its structural faults and its values."""

    def __init__(self, rules: Iterable[Rule]):
        self.rules = list(rules)
        self.by_path = {r.path: k for k, r in enumerate(self.rules)}
        self.objects: dict[str, list[tuple[str, int]]] = {"": []}
        for k, r in enumerate(self.rules):
            if r.kind == "object":
                self.objects.setdefault(r.path, [])
        for k, r in enumerate(self.rules):
            parent, _, name = r.path.rpartition(".")
            if parent not in self.objects:
                raise ValueError(f"{r.topic} {r.path}: {parent} is no object of the contract")
            self.objects[parent].append((name, k))
        self.equal = [(k, self.by_path[r.equal_to]) for k, r in enumerate(self.rules) if r.equal_to]

    def walk(self, message: object) -> tuple[list[str], list[list[object]]]:
        """Structural faults, and for each rule the values that occur at its path (objects are walked, not listed)."""
        values: list[list[object]] = [[] for _ in self.rules]
        if not isinstance(message, dict):
            return ["not_an_object"], values
        faults: list[str] = []
        waiting = [("", message)]
        while waiting:
            path, members = waiting.pop()
            listed = self.objects[path]
            prefix = f"{path}." if path else ""
            known = 0
            for name, k in listed:
                if name not in members:
                    faults.append(f"missing:{prefix}{name}")
                    continue
                known += 1
                value = members[name]
                for each in value if type(value) is Repeated else (value,):
                    if self.rules[k].kind == "object" and isinstance(each, dict):
                        waiting.append((self.rules[k].path, each))
                    else:
                        values[k].append(each)
            if known < len(members):
                faults.append(f"unlisted:{prefix.rstrip('.') or 'envelope'}")
        return faults, values


def contracts_of(rows: Iterable[dict]) -> dict[str, Contract]:
    """Contracts by topic, from rows of the table ``contract_fields``."""
    by_topic: dict[str, list[Rule]] = {}
    for r in rows:
        rule = Rule(r["source_topic"], r["field_path"], r["value_kind"], r["lowest"], r["highest"], r["pattern"], r["allowed"], r["equal_to"])
        by_topic.setdefault(rule.topic, []).append(rule)
    return {topic: Contract(rules) for topic, rules in by_topic.items()}
