"""Audit trail of a run: an event log, a manifest and a context that keeps both. All of it runs on the driver."""

from amalgam.audit.context import RunContext
from amalgam.audit.log import AuditLogger
from amalgam.audit.manifest import ManifestWriter

__all__ = ["AuditLogger", "ManifestWriter", "RunContext"]
