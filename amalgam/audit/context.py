"""A run with its log and manifest."""

from __future__ import annotations

import importlib.metadata
import platform
import secrets
import subprocess
import sys
import time
import traceback
from datetime import datetime
from pathlib import Path

from amalgam.audit.log import AuditLogger
from amalgam.audit.manifest import ManifestWriter
from amalgam.clock import iso_now

VERSION = "0.1.0"


def run_id() -> str:
    """The time, and eight random digits."""
    return f"{iso_now()}__{secrets.token_hex(4)}"


def parse_iso(text: str) -> datetime:
    return datetime.fromisoformat(text)


def git_sha() -> str | None:
    """The first seven digits of the current commit, or None outside of a repository."""
    try:
        out = subprocess.check_output(["git", "rev-parse", "--short=7", "HEAD"], text=True, stderr=subprocess.DEVNULL, timeout=10)
    except (OSError, subprocess.SubprocessError):
        return None
    return out.strip() or None


def versions(packages: tuple[str, ...]) -> dict[str, str]:
    def one(name: str) -> str:
        try:
            return importlib.metadata.version(name)
        except importlib.metadata.PackageNotFoundError:
            return "unknown"

    return {p: one(p) for p in packages}


class RunContext:
    """``with RunContext.start(folder, parameters) as run``: the manifest says whether the block ended well."""

    def __init__(self, run: str, output_dir: Path, logger: AuditLogger, manifest: ManifestWriter) -> None:
        self.run_id, self.output_dir, self.logger, self.manifest = run, output_dir, logger, manifest
        self._began, self._stages = time.monotonic(), {}

    @classmethod
    def start(cls, output_dir: str | Path, parameters: dict, command_argv: list[str] | None = None) -> RunContext:
        out, argv, name = Path(output_dir), command_argv or sys.argv, run_id()
        for folder in (out, out / "artifacts", out / "reports"):
            folder.mkdir(parents=True, exist_ok=True)
        environment = {"python_version": platform.python_version(), "platform": f"{platform.system()}-{platform.release()}-{platform.machine()}", "package_version": VERSION, "dependencies": versions(("pyspark", "pyarrow", "numpy"))}
        sha = git_sha()
        logger = AuditLogger(name, out / "events.jsonl")
        manifest = ManifestWriter(name, out, {"argv": argv, "cwd": Path.cwd().name or None}, environment, f"git:{sha}" if sha else VERSION, parameters)
        logger.run_started(argv, parameters)
        return cls(name, out, logger, manifest)

    def start_stage(self, name: str, expected_records: int | None = None) -> None:
        self._stages[name] = time.monotonic()
        self.manifest.add_stage(name)
        self.logger.stage_started(expected_records, stage=name)

    def finish_stage(self, name: str, counts: dict | None = None) -> None:
        if name not in self._stages:
            raise ValueError(f"stage not started: {name}")
        seconds = time.monotonic() - self._stages.pop(name)
        self.manifest.finish_stage(name, seconds)
        self.manifest.update_stage_counters(name, counts or {})
        self.logger.stage_finished(seconds, counts or None, stage=name)

    def record_error(self, exception: BaseException, *, include_traceback: bool = False, rid: str | None = None, stage: str | None = None) -> None:
        text = "".join(traceback.format_exception(exception)) if include_traceback else None
        self.manifest.add_error(exception, stage=stage, traceback=text, rid=rid)
        self.logger.error(type(exception).__name__, str(exception), traceback=text, stage=stage, rid=rid)

    def finish(self, status: str = "success", n_records: int | None = None) -> None:
        seconds = time.monotonic() - self._began
        self.logger.run_finished(status, seconds, n_records)
        self.logger.close()
        self.manifest.compute_output_artifacts()
        self.manifest.finish(status, seconds)

    def __enter__(self) -> RunContext:
        return self

    def __exit__(self, kind: object, value: BaseException | None, trace: object) -> None:
        if value is not None:
            self.record_error(value, include_traceback=True)
        self.finish("failed" if value is not None else "success")
