"""Bibliographic formats: lines to records of tags.

A line format is a table of rules (what begins, ends and continues a record) that one scanner follows; BibTeX, which has nested braces,
has a reader of its own. Each parser yields :class:`Entry` objects and collects warnings and errors.
"""

from __future__ import annotations

import codecs
import hashlib
import json
import re
import uuid
from collections import Counter
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

PARSER_VERSION = "1.0.0"
EXTENSIONS = {f".{e}": fmt for fmt, known in (("pubmed", "nbib txt"), ("ris", "ris"), ("wos", "ciw"), ("bibtex", "bib"), ("endnote_tagged", "enw")) for e in known.split()}
_NAMESPACE = uuid.NAMESPACE_DNS

#: Signs of a format, the surest first.
_SIGNS = (
    ("bibtex", re.compile(r"^@\w+\s*\{", re.M)),
    ("wos", re.compile(r"^PT [JS]\b", re.M)),
    ("ris", re.compile(r"^TY  - ", re.M)),
    ("pubmed", re.compile(r"^PMID-? ", re.M)),
    ("endnote_tagged", re.compile(r"^%[A-Z0-9] ", re.M)),
)


@dataclass
class Tag:
    name: str
    lines: list[str]
    start: int
    end: int
    value: str = ""
    occurrence: int = 0


@dataclass
class Entry:
    lines: list[str] = field(default_factory=list)
    tags: list[Tag] = field(default_factory=list)


@dataclass
class Notes:
    warnings: list[str] = field(default_factory=list)
    errors: list[str] = field(default_factory=list)


def detect_encoding(content: bytes) -> str:
    """utf-8-sig with a byte order mark, else utf-8 if that is what it is, else latin-1."""
    if content.startswith(codecs.BOM_UTF8):
        return "utf-8-sig"
    try:
        content.decode()
    except UnicodeDecodeError:
        return "latin-1"
    return "utf-8"


def text_lines(content: bytes) -> list[str]:
    """The lines of a file, whatever ends them."""
    return re.split(r"\r\n?|\n", content.decode(detect_encoding(content)))


def sniff_format(lines: Sequence[str]) -> str:
    """The format that the first hundred lines show, or ``unknown``."""
    head = "\n".join(lines[:100])
    return next((name for name, sign in _SIGNS if sign.search(head)), "unknown")


@dataclass(frozen=True)
class Rules:
    """How a line format marks its records.

    ``opens``/``closes``: tags that begin and end a record; without ``closes`` a blank line ends it. ``header``: tags outside of records.
    ``stops``: a line after which nothing counts. ``glue``: what joins the lines of a value; ``trims``: whether continuations lose their indent.
    """

    tag: re.Pattern[str]
    continues: re.Pattern[str]
    opens: str | None = None
    closes: str | None = None
    header: tuple[str, ...] = ()
    stops: str | None = None
    glue: str = "\n"
    trims: bool = False
    needs_open: bool = False


LINE_FORMATS = {
    "ris": Rules(re.compile(r"^([0-9A-Z]{2})  - ?(.*)"), re.compile(r"^\s"), "TY", "ER", needs_open=True),
    "wos": Rules(re.compile(r"^([0-9A-Z]{2})(?:$| (.*))"), re.compile(r"^\s"), "PT", "ER", ("FN", "VR"), "EF", " ", trims=True, needs_open=True),
    "pubmed": Rules(re.compile(r"^([A-Z]{2}[A-Z]{0,2})\s*-\s+(.*)"), re.compile(r"^ {6}"), "PMID"),
    "endnote_tagged": Rules(re.compile(r"^%([0-9A-Z]) (.*)"), re.compile(r"")),
}


def scan(rules: Rules, lines: list[str], notes: Notes) -> Iterator[Entry]:
    """The records of a line format."""
    entry: Entry | None = None
    tag: Tag | None = None

    def seal(end: int) -> None:
        nonlocal tag
        if tag is not None:
            tag.end = end
            entry.tags.append(tag)
            tag = None

    for at, line in enumerate(lines):
        if rules.stops and line.strip() == rules.stops:
            lines = lines[:at]
            break
        blank = not line.strip()
        found = rules.tag.match(line)
        if found:
            name, value = found[1], found[2] or ""
            if entry is not None:
                seal(at - 1)
            if name in rules.header:
                if entry is not None:
                    notes.warnings.append(f"Line {at}: header tag {name} inside a record")
            elif name == rules.opens and (rules.needs_open or (entry is not None and entry.lines)):
                if entry is not None:
                    if rules.needs_open:
                        notes.warnings.append(f"Line {at}: {name} before the last record was closed")
                    yield entry
                entry, tag = Entry([line]), Tag(name, [value], at, at)
            elif rules.closes and name == rules.closes:
                if entry is None:
                    notes.warnings.append(f"Line {at}: {name} without a record")
                else:
                    entry.lines.append(line)
                    entry.tags.append(Tag(name, [value] if rules.trims and value.strip() else [], at, at))
                    yield entry
                    entry = None
            elif entry is not None or not rules.needs_open:
                entry = entry or Entry()
                entry.lines.append(line)
                tag = Tag(name, [value], at, at)
            elif not rules.header:
                continue
            else:
                notes.warnings.append(f"Line {at}: tag {name} outside of a record")
        elif blank and rules.closes is None:
            if entry is not None:
                seal(at - 1)
                yield entry
                entry = None
        elif entry is not None:
            entry.lines.append(line)
            if tag is not None and rules.continues.match(line) and line:
                tag.lines.append(line.strip() if rules.trims else line)
            elif not blank:
                notes.warnings.append(f"Line {at}: not understood: {line[:50]}")
        elif rules is LINE_FORMATS["endnote_tagged"]:
            entry = Entry([line])
    if entry is not None:
        if rules.closes:
            notes.warnings.append(f"The last record has no {rules.closes}")
        seal(len(lines) - 1)
        yield entry


_ENTRY = re.compile(r"@(\w+)\s*[{]([^,]*),?$")
_FIELD = re.compile(r"(\w+)\s*=[ \t\n]*")


def _closing_line(lines: list[str], start: int) -> int:
    """The line in which the brace that opens in line ``start`` closes, or -1; quotes hide braces, a backslash hides one character."""
    depth, quoted = 0, False
    for at in range(start, len(lines)):
        hidden = False
        for c in lines[at]:
            if hidden:
                hidden = False
            elif c == "\\":
                hidden = True
            elif c == '"':
                quoted = not quoted
            elif not quoted and c in "{}":
                depth += 1 if c == "{" else -1
                if not depth:
                    return at
    return -1


def _value_end(text: str, at: int) -> tuple[str, int]:
    """The value that begins at ``at`` (in braces, in quotes or bare) and the place after it."""
    opener = text[at]
    if opener == "{":
        depth = 0
        for end in range(at, len(text)):
            depth += {"{": 1, "}": -1}.get(text[end], 0)
            if not depth:
                return text[at + 1 : end], end + 1
        return text[at + 1 :], len(text)
    if opener == '"':
        out, end = [], at + 1
        while end < len(text) and text[end] != '"':
            end += text[end] == "\\"
            out.append(text[end : end + 1])
            end += 1
        return "".join(out), min(end + 1, len(text))
    end = at
    while end < len(text) and text[end] not in ",\n}#":
        end += 1
    return text[at:end].strip(), end


def _bibtex_fields(lines: list[str], first: int) -> Iterator[Tag]:
    text, at = "\n".join(lines), 0
    while found := _FIELD.search(text, at):
        if found.end() >= len(text):
            return
        value, end = _value_end(text, found.end())
        rest = re.compile(r"[ \t\n]*,?").match(text, end).end()
        start = found.start()
        yield Tag(found[1].lower(), text[start:rest].split("\n"), first + text.count("\n", 0, start), first + text.count("\n", 0, rest), value.strip())
        at = max(rest, start + 1)


def scan_bibtex(lines: list[str], notes: Notes) -> Iterator[Entry]:
    """The entries of a BibTeX file; @string, @preamble and @comment are passed over, unclosed entries are errors."""
    at = 0
    while at < len(lines):
        line = lines[at].strip()
        if line[:1] != "@":
            at += 1
            continue
        found = _ENTRY.match(line)
        if not found:
            notes.warnings.append(f"Line {at}: malformed entry: {line[:50]}")
            at += 1
            continue
        kind, cite = found[1].lower(), found[2].strip()
        end = _closing_line(lines, at)
        if end < 0:
            notes.errors.append(f"Line {at}: unclosed @{kind}{{{cite}")
            at += 1
            continue
        if kind in ("string", "preamble", "comment"):
            notes.warnings.append(f"Line {at}: @{kind} passed over (to line {end})")
        else:
            head = [Tag("__bibtex_entrytype", [kind], at, at, kind), Tag("__bibtex_citekey", [cite], at, at, cite)]
            yield Entry(lines[at : end + 1], head + list(_bibtex_fields(lines[at + 1 : end], at + 1)))
        at = end + 1


def parse(fmt: str, lines: list[str], notes: Notes) -> Iterator[Entry]:
    """The records of ``lines`` that have tags, with values joined and repeated tags counted."""
    if fmt == "bibtex":
        entries = scan_bibtex(lines, notes)
    elif fmt in LINE_FORMATS:
        entries = scan(LINE_FORMATS[fmt], lines, notes)
    else:
        notes.errors.append(f"No parser for format: {fmt}")
        return
    for entry in entries:
        seen: Counter[str] = Counter()
        for tag in entry.tags:
            tag.occurrence = seen[tag.name]
            seen[tag.name] += 1
            if fmt != "bibtex":
                tag.value = LINE_FORMATS[fmt].glue.join(tag.lines)
        if entry.tags:
            yield entry


def record_digest(fmt: str, tags: list[Tag]) -> str:
    """A digest of format, tags and values; where they are in the file doesn't count."""
    content = {"source_format": fmt, "tags": [{"tag": t.name, "value": t.value} for t in tags]}
    return "sha256:" + hashlib.sha256(json.dumps(content, separators=(",", ":"), sort_keys=True, ensure_ascii=False).encode("utf-8", "surrogatepass")).hexdigest()


def record_id(source_digest: str, digest: str) -> str:
    return str(uuid.uuid5(_NAMESPACE, f"{source_digest}:{digest}"))


def read_content(name: str, content: bytes, modified: str, ingested: str) -> tuple[list[dict], dict]:
    """The records of a file, as rows of ``schema.PARSED``, and a report on it. Never raises for what the file holds."""
    notes, rows, tags = Notes(), [], 0
    lines = text_lines(content)
    extension = "." + name.rsplit(".", 1)[-1].lower() if "." in name else ""
    fmt = sniff_format(lines)
    if fmt == "unknown":
        fmt = EXTENSIONS.get(extension, "unknown")
    source = "sha256:" + hashlib.sha256(content).hexdigest()
    for number, entry in enumerate(parse(fmt, lines, notes)):
        digest = record_digest(fmt, entry.tags)
        tags += len(entry.tags)
        rows.append(
            {
                "schema_version": "1.0.0", "rid": record_id(source, digest), "record_digest": digest, "source_digest": source,
                "meta": {"source_file": name, "source_format": fmt, "source_db": None, "source_record_index": number, "ingested_at": ingested, "source_file_mtime": modified, "source_file_size_bytes": len(content), "parser_version": PARSER_VERSION},
                "raw": {
                    "record_lines": entry.lines,
                    "tags": [{"tag": t.name, "value_lines": t.lines, "value_raw_joined": t.value, "occurrence": t.occurrence, "line_start": t.start, "line_end": t.end} for t in entry.tags],
                    "unknown_lines": [],
                },
            }
        )
    report = {
        "filename": name, "file_size": len(content), "file_mtime": modified, "format_detected": fmt, "source_ext": extension, "encoding_used": detect_encoding(content),
        "records_parsed": len(rows), "tags_parsed": tags, "warnings": notes.warnings, "errors": notes.errors, "file_digest": source if rows else "",
    }
    return rows, report
