"""Identifiers as column expressions: digests, record, pair, cluster and merge ids."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The DNS name space of RFC 4122.
NAMESPACE = "6ba7b810-9dad-11d1-80b4-00c04fd430c8"


def sha256(content: Column) -> Column:
    """``sha256:`` and the digest of a binary or string."""
    return F.concat(F.lit("sha256:"), F.sha2(content, 256))


def uuid5(name: Column) -> Column:
    """The version-5 UUID of a string in ``NAMESPACE``."""
    h = F.sha1(F.concat(F.unhex(F.lit(NAMESPACE.replace("-", ""))), F.encode(name, "UTF-8")))
    variant = F.translate(F.substring(h, 17, 1), "0123456789abcdef", "89ab89ab89ab89ab")
    return F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit("5"), F.substring(h, 14, 3)), F.concat(variant, F.substring(h, 18, 3)), F.substring(h, 21, 12))


def record_id(source_digest: Column, record_digest: Column) -> Column:
    return uuid5(F.concat_ws(":", source_digest, record_digest))


def pair_id(a: Column, b: Column) -> Column:
    """Both ids, the lesser one first."""
    return F.concat_ws("|", F.least(a, b), F.greatest(a, b))


def group_id(prefix: str, members: Column) -> Column:
    """``prefix``, a colon and twelve digits of the digest of the sorted members, one a line."""
    return F.concat(F.lit(f"{prefix}:"), F.substring(F.sha2(F.array_join(F.array_sort(members), "\n"), 256), 1, 12))


def is_digest(value: Column) -> Column:
    return F.coalesce(value.rlike("^sha256:[0-9a-fA-F]{64}$"), F.lit(False))


def is_record_id(value: Column) -> Column:
    """Whether a string is a version-5 UUID."""
    return F.coalesce(value.rlike("(?i)^[0-9a-f]{8}-[0-9a-f]{4}-5[0-9a-f]{3}-[89ab][0-9a-f]{3}-[0-9a-f]{12}$"), F.lit(False))
