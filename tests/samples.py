"""Small records in every format, and helpers that make records."""

from amalgam.operators.normalize import normalize
from amalgam.schema import PARSED
from amalgam.sources import parsers

RIS = """TY  - JOUR
TI  - Étude: of Machine-Learning
AU  - Smith, John A.
AU  - Doe, JB
PY  - 2020/03
DO  - https://doi.org/10.1234/ABC%2Fd.
JF  - The  Journal.
SP  - 12
EP  - 19
AB  - First line
      second line
ER  -

TY  - JOUR
T1  - Another title
ER  -
"""
PUBMED = """PMID- 123
AU  - Smith JA
FAU - Smith, John A
TI  - A title that goes
      on
DP  - 2019 Jan
AID - S001 [pii]
AID - 10.1/xyz [doi]
AID - PMC77 [pmc]
PG  - e12

PMID- 124
TI  - Second
PG  - 10-15
"""
WOS = """FN Export
VR 1.0
PT J
AU Smith, John
   Doe, Jane
TI Some
   Title
PY 2001
BP 5
EP 9
ER

PT J
TI Other
ER

EF
PT J
TI After the end
ER
"""
ENDNOTE = """%0 Journal Article
%A Jane Doe
%T A title
more of it
%D 1999
%P 3-8

%0 Book
%T Next
"""
BIBTEX = r"""@string{x = "y"}
@article{key1,
  title = {A {Nested} Title},
  author = "Doe, Jane and John Smith",
  year = 2005,
  pages = {10--20},
  doi = {10.9/q}
}
@book{broken,
  title = {never closed
"""
ALL = {"a.ris": RIS, "b.nbib": PUBMED, "c.ciw": WOS, "d.enw": ENDNOTE, "e.bib": BIBTEX}


def write_all(folder):
    for name, text in ALL.items():
        (folder / name).write_text(text, encoding="utf-8")
    return folder


def normalized(spark, text, name="a.ris"):
    rows, _ = parsers.read_content(name, text.encode(), "2024-01-01T00:00:00Z", "2024-01-01T00:00:00Z")
    return normalize(spark.createDataFrame(rows, PARSED)).orderBy("meta.source_record_index")


def ris(*records):
    """RIS text of dicts from tag to value or list of values."""
    out = []
    for record in records:
        out.append("TY  - JOUR")
        for tag, values in record.items():
            out += [f"{tag}  - {v}" for v in (values if isinstance(values, list) else [values])]
        out.append("ER  - \n")
    return "\n".join(out)
