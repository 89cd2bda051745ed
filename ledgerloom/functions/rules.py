"""Rule tables: a list of (code, condition) that compiles to columns with the codes of all conditions that hold."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

Rule = tuple[str, Column]


def error_text(rules: Sequence[Rule]) -> Column:
    """The codes, joined by commas, in order; empty if none. A null condition is no error.

    Built of ``concat_ws`` and ``when`` only, so it stays in generated code, where a shared parse is evaluated once.
    """
    return F.concat_ws(",", *[F.when(condition, F.lit(code)) for code, condition in rules])


def sealed_error_text(rules: Sequence[Rule]) -> Column:
    """``error_text`` that the optimizer must not copy: a filter on it stays above the projection that computes it.

    Pushed below, such a filter would parse each record once per rule, and the optimizer would substitute every renamed
    field in its condition, in all combinations. A term that depends on the row's place, and is never true, keeps it there.
    """
    never = F.when(F.spark_partition_id() < 0, F.lit("never"))
    return F.concat_ws(",", *[F.when(condition, F.lit(code)) for code, condition in rules], never)


def error_codes(text: Column) -> Column:
    """The array of codes of an ``error_text``."""
    return F.when(text == "", F.array().cast("array<string>")).otherwise(F.split(text, ","))


def first_error(text: Column) -> Column:
    """The first code of an ``error_text``, or null."""
    return F.when(text != "", F.substring_index(text, ",", 1))
