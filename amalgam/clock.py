"""Times as text."""

from __future__ import annotations

from datetime import UTC, datetime


def iso(moment: datetime) -> str:
    """A UTC time in ISO 8601 with a Z."""
    return f"{moment:%Y-%m-%dT%H:%M:%S.%f}Z"


def iso_now() -> str:
    return iso(datetime.now(UTC))
