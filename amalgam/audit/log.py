"""Events as JSON lines, flushed one by one."""

from __future__ import annotations

import json
from pathlib import Path

from amalgam.clock import iso_now

#: Kinds of events: their data in order, needed ones first, those that may be left out with a question mark.
KINDS = {
    "run_started": "command parameters",
    "run_finished": "status duration_seconds records_processed?",
    "stage_started": "expected_records?",
    "stage_finished": "duration_seconds counters?",
    "record_flagged": "flag_name reason_code",
    "artifact_written": "path sha256 bytes? record_count?",
    "error": "exception_class message traceback? rid?",
}


class AuditLogger:
    """Appends events to a file; a context manager. Besides ``event`` it has a method for each of ``KINDS``."""

    def __init__(self, run_id: str, log_path: str | Path) -> None:
        self.run_id, self.path, self.stage = run_id, Path(log_path), None
        self.path.parent.mkdir(parents=True, exist_ok=True)
        self._out = self.path.open("ab")

    def __enter__(self) -> AuditLogger:
        return self

    def __exit__(self, *_: object) -> None:
        self.close()

    def close(self) -> None:
        self._out.close()

    def event(self, event: str, data: dict | None = None, *, level: str = "INFO", rid: str | None = None, stage: str | None = None) -> None:
        row = {"ts": iso_now(), "run_id": self.run_id, "level": level, "event": event, "data": data or {}, "stage": stage or self.stage, "rid": rid}
        self._out.write(f"{json.dumps(row, separators=(',', ':'), ensure_ascii=False)}\n".encode())
        self._out.flush()


def _method(kind: str, fields: str):  # noqa: ANN202
    names = [f.rstrip("?") for f in fields.split()]
    needed = [f for f in fields.split() if not f.endswith("?")]

    def emit(self: AuditLogger, *values: object, rid: str | None = None, stage: str | None = None, **more: object) -> None:
        data = dict(zip(names, values, strict=False)) | more
        if kind == "error" and rid:
            data["rid"] = rid
        if set(data) - set(names) or set(needed) - set(data):
            raise TypeError(f"{kind} takes {fields}")
        if kind == "stage_started":
            self.stage = stage
        self.event(kind, {k: v for k, v in data.items() if v is not None}, stage=stage, rid=rid, level="ERROR" if kind == "error" else "INFO")

    emit.__name__, emit.__doc__ = kind, f"An event with {fields}."
    return emit


for _kind, _fields in KINDS.items():
    setattr(AuditLogger, _kind, _method(_kind, _fields))
