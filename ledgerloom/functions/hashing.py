"""Digests and deterministic ids, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: the URL namespace of RFC 9562.
URL_NAMESPACE = "6ba7b8119dad11d180b400c04fd430c8"


def canonical_fields(fields: dict[str, Column]) -> Column:
    """``name:length:value`` and a line end for each field, in order; lengths in bytes, null as empty."""
    lines = []
    for name, value in fields.items():
        text = F.coalesce(value.cast("string"), F.lit(""))
        lines += [F.lit(f"{name}:"), F.octet_length(text).cast("string"), F.lit(":"), text, F.lit("\n")]
    return F.concat(*lines)


def fingerprint(fields: dict[str, Column]) -> Column:
    """SHA-256 in hex of the canonical form: equal values give equal fingerprints, and no two field lists collide."""
    return F.sha2(canonical_fields(fields), 256)


def uuid5(name: Column, namespace: str = URL_NAMESPACE) -> Column:
    """The version 5 UUID of a name: SHA-1 with version and variant bits set."""
    digest = F.sha1(F.concat(F.unhex(F.lit(namespace)), F.encode(name, "UTF-8")))
    variant = F.substring(F.lit("89ab"), 1, 4)
    high = F.conv(F.substring(digest, 17, 1), 16, 10).cast("int")
    nibble = F.substring(variant, F.pmod(high, F.lit(4)) + 1, F.lit(1))
    return F.concat(
        F.substring(digest, 1, 8), F.lit("-"), F.substring(digest, 9, 4), F.lit("-5"), F.substring(digest, 14, 3),
        F.lit("-"), nibble, F.substring(digest, 18, 3), F.lit("-"), F.substring(digest, 21, 12),
    )


def random_uuid() -> Column:
    """A random version 4 UUID, another one in every run: for marks that nothing is compared with."""
    return F.uuid()
