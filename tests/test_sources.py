import pytest

from amalgam.sources import datasource, parsers
from amalgam.sources.files import bibliographic_files, file_reports, read_records
from tests import samples


def parse(name, text):
    rows, report = parsers.read_content(name, text if isinstance(text, bytes) else text.encode(), "m", "i")
    return rows, report


def tags(row, name):
    return [t["value_raw_joined"] for t in row["raw"]["tags"] if t["tag"] == name]


def test_ris_records_and_continuations():
    rows, report = parse("a.ris", samples.RIS)
    assert len(rows) == 2 and not report["errors"] and report["format_detected"] == "ris"
    assert tags(rows[0], "AB") == ["First line\n      second line"]
    assert tags(rows[0], "AU") == ["Smith, John A.", "Doe, JB"]
    assert [t["occurrence"] for t in rows[0]["raw"]["tags"] if t["tag"] == "AU"] == [0, 1]
    assert rows[0]["raw"]["tags"][-1]["tag"] == "ER" and rows[0]["raw"]["record_lines"][-1].startswith("ER")


def test_ris_without_end_warns_and_keeps_the_record():
    rows, report = parse("a.ris", "TY  - JOUR\nTI  - One\nTY  - JOUR\nTI  - Two\nodd line\n")
    assert len(rows) == 2 and len(report["warnings"]) == 3


def test_pubmed_breaks_at_pmid_and_blank():
    rows, _ = parse("b.nbib", "PMID- 1\nTI  - A\nPMID- 2\nTI  - B\n\nPMID- 3\nTI  - C\n      more")
    assert [tags(r, "PMID") for r in rows] == [["1"], ["2"], ["3"]]
    assert tags(rows[2], "TI") == ["C\n      more"]


def test_wos_joins_with_blanks_and_stops():
    rows, _ = parse("c.ciw", samples.WOS)
    assert len(rows) == 2
    assert tags(rows[0], "TI") == ["Some Title"] and tags(rows[0], "AU") == ["Smith, John Doe, Jane"]


def test_open_wos_record_before_the_end_counts_once():
    rows, _ = parse("c.ciw", "PT J\nTI One\nEF\n")
    assert len(rows) == 1


def test_endnote_lines_without_tag_continue():
    rows, _ = parse("d.enw", samples.ENDNOTE)
    assert len(rows) == 2 and tags(rows[0], "T") == ["A title\nmore of it"]


def test_bibtex_values_and_unclosed_entry():
    rows, report = parse("e.bib", samples.BIBTEX)
    assert len(rows) == 1 and len(report["errors"]) == 1 and len(report["warnings"]) == 1
    assert tags(rows[0], "title") == ["A {Nested} Title"] and tags(rows[0], "year") == ["2005"] and tags(rows[0], "__bibtex_citekey") == ["key1"]
    assert tags(rows[0], "author") == ["Doe, Jane and John Smith"]


def test_unclosed_comment_ends():
    rows, report = parse("e.bib", "@comment{never\n@article{a,\n title = {T}\n}\n")
    assert len(rows) == 1 and report["errors"]


@pytest.mark.parametrize(
    ("text", "fmt"),
    [("@article{a,", "bibtex"), ("PT J\n", "wos"), ("TY  - X", "ris"), ("PMID- 1", "pubmed"), ("%A x", "endnote_tagged"), ("nothing", "unknown"), ("TY  - X\n@book {b,", "bibtex")],
)
def test_sniffing(text, fmt):
    assert parsers.sniff_format(text.split("\n")) == fmt


def test_encodings_and_line_ends():
    assert parsers.text_lines(b"\xef\xbb\xbfa\r\nb\rc") == ["a", "b", "c"]
    assert parsers.detect_encoding("é".encode("latin-1")) == "latin-1" and parsers.detect_encoding("é".encode()) == "utf-8"


def test_ids_ignore_place_and_depend_on_file():
    (a,), _ = parse("a.ris", "TY  - J\nTI  - X\nER  - \n")
    (b,), _ = parse("a.ris", "\n\nTY  - J\nTI  - X\nER  - \n")
    assert a["record_digest"] == b["record_digest"] and a["rid"] != b["rid"]


def test_empty_files():
    for name in samples.ALL:
        assert parse(name, "")[0] == []
    assert parse("x.xyz", "hello")[1]["errors"]


def test_folder_scan_and_reports(spark, tmp_path):
    samples.write_all(tmp_path)
    (tmp_path / "notes.md").write_text("no")
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "z.ris").write_text(samples.RIS.replace("Another", "Deeper"))
    flat, deep = read_records(spark, str(tmp_path)), read_records(spark, str(tmp_path), recursive=True)
    assert flat.count() == 9 and deep.count() == 11
    assert deep.select("rid").distinct().count() == 11
    reports = {r["filename"]: r for r in file_reports(bibliographic_files(spark, str(tmp_path))).collect()}
    assert reports["a.ris"]["records_parsed"] == 2 and reports["e.bib"]["errors"]


def test_data_source(spark, tmp_path):
    samples.write_all(tmp_path)
    datasource.register(spark)
    rows = spark.read.format("bibliography").option("recursive", "true").load(str(tmp_path))
    assert {r["rid"] for r in rows.select("rid").collect()} == {r["rid"] for r in read_records(spark, str(tmp_path)).select("rid").collect()}
