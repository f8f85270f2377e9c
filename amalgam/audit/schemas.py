"""JSON schemas of audit events and run manifests, made from the same table that makes the events, and a check of documents against them.

``python -m amalgam.audit.schemas FOLDER`` writes both as files.
"""

from __future__ import annotations

import json
import re
import sys
from pathlib import Path

from amalgam.audit.log import KINDS

DRAFT = "http://json-schema.org/draft-07/schema#"
_DIGEST = r"^sha256:[a-f0-9]{64}$"
_COUNT = {"minimum": 0, "type": "integer"}
_SECONDS = {"minimum": 0, "type": "number"}
_TEXT, _TEXT_OR_NULL = {"type": "string"}, {"type": ["string", "null"]}
_COUNTERS = {"type": "object", "additionalProperties": {"type": "integer"}}
_DATA = {
    "command": {"type": "array", "items": _TEXT}, "parameters": {"type": "object"}, "status": {"enum": ["success", "failed", "partial"], "type": "string"}, "duration_seconds": _SECONDS,
    "records_processed": _COUNT, "expected_records": _COUNT, "counters": _COUNTERS, "flag_name": _TEXT, "reason_code": _TEXT, "path": _TEXT, "sha256": {"pattern": _DIGEST, "type": "string"},
    "bytes": _COUNT, "record_count": _COUNT, "exception_class": _TEXT, "message": _TEXT, "traceback": _TEXT_OR_NULL, "rid": _TEXT_OR_NULL,
}
#: Kinds of events that belong to a stage, and those that belong to a record too.
_OF_STAGE, _OF_RECORD = ("stage_started", "stage_finished", "record_flagged", "artifact_written", "record_stage1_completed"), ("record_flagged", "record_stage1_completed")


def _object(required: str, **properties: dict) -> dict:
    return {"type": "object", "required": required.split(), "properties": properties}


def event_schema() -> dict:
    """Of a line of ``events.jsonl``: what all events have, and for each kind what its data have."""
    rules = []
    for kind, fields in {**KINDS, "record_stage1_completed": ""}.items():
        names = fields.split()
        needed = [n for n in names if not n.endswith("?") and n != "parameters"]
        then: dict = {"properties": {"data": _object(" ".join(needed), **{n.rstrip("?"): _DATA[n.rstrip("?")] for n in names})}}
        beside = [*(["stage"] if kind in _OF_STAGE else []), *(["rid"] if kind in _OF_RECORD else [])]
        for name in beside:
            then["properties"][name] = _TEXT
        if beside:
            then["required"] = beside
        if kind == "error":
            then["properties"]["level"] = {"const": "ERROR"}
        rules.append({"if": {"properties": {"event": {"const": kind}}}, "then": then})
    stamp = {"pattern": r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}\.\d+Z$", "type": "string"}
    kinds = {"enum": sorted([*KINDS, "record_stage1_completed"]), "type": "string"}
    whole = _object("ts run_id level event data", ts=stamp, run_id=_TEXT, level={"enum": ["DEBUG", "INFO", "WARN", "ERROR"], "type": "string"}, event=kinds, stage=_TEXT_OR_NULL, rid=_TEXT_OR_NULL, data={"type": "object"})
    return {"$schema": DRAFT, **whole, "allOf": rules}


def manifest_schema() -> dict:
    """Of ``run.json``."""
    size = {"minimum": 0, "type": ["integer", "null"]}
    artifact = _object("path sha256", path=_TEXT, sha256=_DATA["sha256"], bytes=size, record_count=size)
    seconds = {"minimum": 0, "type": ["number", "null"]}
    file = _object("name format bytes sha256 records_extracted", name=_TEXT, format=_TEXT, bytes=_COUNT, mtime=_TEXT_OR_NULL, sha256=_DATA["sha256"], records_extracted=_COUNT)
    stage = _object("name started_at counters", name=_TEXT, started_at=_TEXT, finished_at=_TEXT_OR_NULL, duration_seconds=seconds, counters=_COUNTERS, artifacts={"type": "array", "items": artifact})
    error = _object("timestamp exception_class message", timestamp=_TEXT, stage=_TEXT_OR_NULL, exception_class=_TEXT, message=_TEXT, traceback=_TEXT_OR_NULL, rid=_TEXT_OR_NULL)
    whole = _object(
        "manifest_version run_id created_at status transform_version command environment inputs parameters stages outputs",
        manifest_version={"pattern": r"^\d+\.\d+\.\d+$", "type": "string"}, run_id=_TEXT, created_at=_TEXT, finished_at=_TEXT_OR_NULL, duration_seconds=seconds, status=_DATA["status"], transform_version=_TEXT,
        command=_object("argv", argv={"type": "array", "items": _TEXT, "minItems": 1}, cwd=_TEXT_OR_NULL),
        environment=_object("python_version platform package_version", python_version=_TEXT, platform=_TEXT, package_version=_TEXT, dependencies={"type": "object", "additionalProperties": _TEXT}),
        inputs=_object("root files total_records_extracted", root=_TEXT, files={"type": "array", "items": file}, total_records_extracted=_COUNT),
        parameters={"type": "object"}, stages={"type": "array", "items": stage}, outputs=_object("artifacts", artifacts={"type": "array", "items": artifact}), errors={"type": "array", "items": error},
    )
    return {"$schema": DRAFT, **whole}


_KINDS = {"object": dict, "array": list, "string": str, "integer": int, "number": (int, float), "null": type(None), "boolean": bool}


def problems(value: object, schema: dict, at: str = "$") -> list[str]:
    """What is wrong with a document, by the keywords that the two schemas use; nothing if it is valid."""
    if "const" in schema and value != schema["const"]:
        return [f"{at}: {value!r} isn't {schema['const']!r}"]
    kinds = schema.get("type", [])
    kinds = [kinds] if isinstance(kinds, str) else kinds
    if kinds and not any(isinstance(value, _KINDS[k]) and (k in ("boolean",) or not isinstance(value, bool)) for k in kinds):
        return [f"{at}: {value!r} isn't {' or '.join(kinds)}"]
    out = []
    if "enum" in schema and value not in schema["enum"]:
        out.append(f"{at}: {value!r} isn't one of {', '.join(schema['enum'])}")
    if isinstance(value, str) and "pattern" in schema and not re.search(schema["pattern"], value):
        out.append(f"{at}: {value!r} doesn't match {schema['pattern']}")
    if isinstance(value, int | float) and value < schema.get("minimum", value):
        out.append(f"{at}: {value} is below {schema['minimum']}")
    if isinstance(value, list):
        if len(value) < schema.get("minItems", 0):
            out.append(f"{at}: too few items")
        out += [p for i, v in enumerate(value) for p in problems(v, schema.get("items", {}), f"{at}[{i}]")]
    if isinstance(value, dict):
        out += [f"{at}: {name} is missing" for name in schema.get("required", []) if name not in value]
        known = schema.get("properties", {})
        for name, v in value.items():
            out += problems(v, known.get(name, schema.get("additionalProperties", {})), f"{at}.{name}")
    for rule in schema.get("allOf", []):
        if not problems(value, rule["if"], at):
            out += problems(value, rule["then"], at)
    return out


def main(folder: str) -> None:
    for name, schema in (("log_event", event_schema()), ("run_manifest", manifest_schema())):
        Path(folder, f"{name}.schema.json").write_text(json.dumps(schema, indent=1, sort_keys=True) + "\n")


if __name__ == "__main__":
    main(sys.argv[1])
