"""Validated settings of the streaming job, from environment variables."""

from __future__ import annotations

import os
import re
from collections.abc import Mapping
from dataclasses import dataclass, fields

#: The variables' names, by setting.
VARIABLES = {
    "kafka_brokers": "KAFKA_BROKERS", "output_root": "SPARK_OUTPUT_ROOT", "checkpoint_root": "SPARK_CHECKPOINT_ROOT", "payments_topic": "PAYMENTS_TOPIC",
    "decisions_topic": "RISK_DECISIONS_TOPIC", "starting_offsets": "SPARK_STARTING_OFFSETS", "trigger_interval": "SPARK_TRIGGER_INTERVAL", "max_offsets_per_trigger": "SPARK_MAX_OFFSETS_PER_TRIGGER",
}
_PATH = r"(?:[a-z][a-z0-9+.-]*://[^\s]+|/[^\s]*[^\s/])"
#: What each setting must look like as a whole, and how to say so.
SHAPES = {
    "kafka_brokers": (r"\S+", "names no brokers, or has blanks in it"),
    "output_root": (_PATH, "is neither an absolute path nor a URL"),
    "checkpoint_root": (_PATH, "is neither an absolute path nor a URL"),
    "payments_topic": (r"[A-Za-z0-9._-]{1,249}", "can't be the name of a topic"),
    "decisions_topic": (r"[A-Za-z0-9._-]{1,249}", "can't be the name of a topic"),
    "starting_offsets": (r"earliest|latest", "is not one of earliest, latest"),
    "trigger_interval": (r"[1-9][0-9]* (?:millisecond|second|minute)s?", "is no whole number of milliseconds, seconds or minutes"),
    "max_offsets_per_trigger": (r"0*[1-9][0-9]*", "is no positive whole number"),
}
#: Settings that would overwrite each other.
APART = (("payments_topic", "decisions_topic"), ("output_root", "checkpoint_root"))


@dataclass(frozen=True)
class Settings:
    kafka_brokers: str
    output_root: str = "/var/lib/ledgerloom/data"
    checkpoint_root: str = "/var/lib/ledgerloom/checkpoints"
    payments_topic: str = "payments.created"
    decisions_topic: str = "risk.decisions"
    starting_offsets: str = "earliest"
    trigger_interval: str = "5 seconds"
    max_offsets_per_trigger: int = 10_000

    def __post_init__(self) -> None:
        problems = [f"{VARIABLES[n]} {why}" for n, (shape, why) in SHAPES.items() if not re.fullmatch(shape, str(getattr(self, n)))]
        problems += [f"{VARIABLES[n]} leads out of its folder" for n in ("output_root", "checkpoint_root") if ".." in getattr(self, n).split("/")]
        problems += [f"{VARIABLES[a]} and {VARIABLES[b]} are the same" for a, b in APART if getattr(self, a) == getattr(self, b)]
        if problems:
            raise ValueError("; ".join(problems))

    @classmethod
    def from_env(cls, environment: Mapping[str, str] | None = None) -> Settings:
        """All problems are reported at once. Unset variables take the defaults."""
        env = os.environ if environment is None else environment
        given = {f.name: env[VARIABLES[f.name]].strip() for f in fields(cls) if VARIABLES[f.name] in env}
        number = given.get("max_offsets_per_trigger")
        if number is not None and re.fullmatch(r"[0-9]{1,18}", number):
            given["max_offsets_per_trigger"] = int(number)
        return cls(**({"kafka_brokers": ""} | given))
