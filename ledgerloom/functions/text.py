"""Text and code normalisation and predicates, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Shapes of ids and codes.
UUID_SHAPE = r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}\z"
UUID4_SHAPE = r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-4[0-9a-fA-F]{3}-[89abAB][0-9a-fA-F]{3}-[0-9a-fA-F]{12}\z"
OFFSET_SHAPE = r"(?:Z|[+-][0-9]{2}:[0-9]{2})\z"
REASON_SHAPE = r"^[A-Z0-9_]{1,100}\z"


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def trim_white(c: str | Column) -> Column:
    """Without Unicode white space at both ends (``trim`` takes only blanks off)."""
    return F.regexp_replace(_col(c), r"^\p{IsWhite_Space}+|\p{IsWhite_Space}+$", "")


def code(c: str | Column) -> Column:
    """A code as compared: trimmed, upper case."""
    return F.upper(trim_white(c))


def is_uuid(c: str | Column) -> Column:
    return _col(c).rlike(UUID_SHAPE)


def is_uuid4(c: str | Column) -> Column:
    return _col(c).rlike(UUID4_SHAPE)


def canonical_uuid(c: str | Column) -> Column:
    """Lower case, or null if it is no UUID."""
    value = trim_white(c)
    return F.when(is_uuid(value), F.lower(value))


def request_key(c: str | Column) -> Column:
    """A request key: trimmed, 1 to 255 code points, no control characters; else null."""
    value = trim_white(c)
    return F.when(F.length(value).between(1, 255) & ~value.rlike(r"\p{Cntrl}"), value)


def bad_uuid(c: str | Column) -> Column:
    """True for null and for what is no UUID."""
    return _col(c).isNull() | ~is_uuid(c)


def bad_text(c: str | Column, longest: int = 255) -> Column:
    """True for null, blank and too long text."""
    value = F.trim(_col(c))
    return value.isNull() | (value == "") | (F.length(value) > longest)


def bad_score(c: str | Column) -> Column:
    """True for null and for scores outside 0 to 100."""
    return _col(c).isNull() | ~_col(c).between(0, 100)


def without_offset(c: str | Column) -> Column:
    """True for the text of an instant that doesn't end with Z or an offset; null for null."""
    return ~_col(c).rlike(OFFSET_SHAPE)


def cut(c: str | Column, longest: int = 2000) -> Column:
    """At most ``longest`` code points."""
    return F.left(_col(c), F.lit(longest))


def json_keys_differ(c: str | Column, names: list[str]) -> Column:
    """True if a JSON object's keys aren't exactly ``names``; null for null."""
    keys, expected = F.json_object_keys(_col(c)), F.array(*[F.lit(n) for n in names])
    return (F.size(F.array_except(keys, expected)) > 0) | (F.size(F.array_except(expected, keys)) > 0)
