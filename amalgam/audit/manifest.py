"""The manifest of a run, written at its end in one move."""

from __future__ import annotations

import hashlib
import json
import os
from pathlib import Path

from amalgam.clock import iso_now

MANIFEST_VERSION = "1.0.0"


def file_sha256(path: Path) -> str:
    with path.open("rb") as f:
        return hashlib.file_digest(f, "sha256").hexdigest()


class ManifestWriter:
    """Collects what a run did; ``finish`` writes ``run.json``."""

    def __init__(self, run_id: str, output_dir: str | Path, command: dict, environment: dict, transform_version: str, parameters: dict) -> None:
        self.output_dir = Path(output_dir)
        self.path = self.output_dir / "run.json"
        self.data: dict = {
            "manifest_version": MANIFEST_VERSION, "run_id": run_id, "created_at": iso_now(), "status": "partial", "transform_version": transform_version,
            "command": command, "environment": environment, "parameters": parameters, "inputs": dict(root="", total_records_extracted=0, files=[]),
            "stages": [], "errors": [], "outputs": dict(artifacts=[]), "finished_at": None, "duration_seconds": None,
        }

    def _stage(self, name: str) -> dict:
        for stage in self.data["stages"]:
            if stage["name"] == name:
                return stage
        raise ValueError(f"no such stage: {name}")

    def set_inputs(self, root: str, files: list[dict], total_records: int) -> None:
        self.data["inputs"] = {"root": root, "files": files, "total_records_extracted": total_records}

    def add_stage(self, name: str, started_at: str | None = None) -> None:
        self.data["stages"].append({"name": name, "started_at": started_at or iso_now(), "finished_at": None, "duration_seconds": None, "counters": {}})

    def update_stage_counters(self, name: str, counts: dict) -> None:
        self._stage(name)["counters"] |= counts

    def finish_stage(self, name: str, seconds: float | None = None, at: str | None = None) -> None:
        self._stage(name).update(finished_at=at or iso_now(), duration_seconds=seconds)

    def add_output_artifact(self, path: str, sha256: str, size: int | None = None, records: int | None = None) -> None:
        self.data["outputs"]["artifacts"].append({"path": path, "sha256": sha256, "bytes": size, "record_count": records})

    def add_error(self, exception: BaseException, *, rid: str | None = None, stage: str | None = None, traceback: str | None = None) -> None:
        self.data["errors"].append({"timestamp": iso_now(), "exception_class": type(exception).__name__, "message": str(exception), "stage": stage, "traceback": traceback, "rid": rid})

    def compute_output_artifacts(self) -> None:
        """Adds the event log, if there is one."""
        events = self.output_dir / "events.jsonl"
        if events.exists():
            self.add_output_artifact("events.jsonl", f"sha256:{file_sha256(events)}", events.stat().st_size)

    def to_dict(self) -> dict:
        return self.data

    def finish(self, status: str, duration_seconds: float | None = None) -> None:
        self.data.update(status=status, finished_at=iso_now(), duration_seconds=duration_seconds)
        part = self.path.with_suffix(".part")
        with part.open("wb") as out:
            out.write(json.dumps(self.data, indent=2, ensure_ascii=False).encode())
            out.flush()
            os.fsync(out)
        part.replace(self.path)
