import unicodedata
import uuid

import pytest
from pyspark.sql import functions as F

from amalgam.functions import fields as E
from amalgam.functions import ids
from amalgam.functions import text as X
from amalgam.operators.normalize import normalize
from tests import samples


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    ("raw", "doi"),
    [
        ("https://doi.org/10.1234/ABC%2Fd.", "10.1234/abc/d"),
        ("10.1234/test [doi]", "10.1234/test"),
        ("DOI:10.5/x;", "10.5/x"),
        ("http://dx.doi.org/10.5/a+b?z=1", "10.5/a+b"),
        ("10.5/50%zz", "10.5/50%zz"),
        ("not a doi", None),
        ("", None),
        (None, None),
    ],
)
def test_doi(spark, raw, doi):
    assert one(spark, E.doi(F.lit(raw).cast("string"))) == doi


@pytest.mark.parametrize(
    ("raw", "fmt", "parts"),
    [
        ("Smith, John A.", "ris", ("Smith", "John A.", "JA", None)),
        ("Smith, JA", "ris", ("Smith", None, "JA", None)),
        ("Smith, J. A.", "ris", ("Smith", None, "JA", None)),
        ("Smith Jr., John", "ris", ("Smith", "John", "J", "Jr.")),
        ("Smith JA", "ris", ("Smith", "JA", "J", None)),
        ("John Q Smith", "bibtex", ("Smith", "John Q", "JQ", None)),
        ("Plato", "ris", ("Plato", None, None, None)),
        ("Smith,", "ris", ("Smith", "", None, None)),
    ],
)
def test_author(spark, raw, fmt, parts):
    a = one(spark, E.author(F.lit(raw), F.lit(fmt)))
    assert (a["family"], a["given"], a["initials"], a["suffix"]) == parts and a["raw"] == raw


@pytest.mark.parametrize("text", ["", "  A  b ", "Straße: ÉTUDE (x)", "ﬁn…al Ⅳ", "Ünï'cödé [1]", "ǅ İ"])
def test_folding_is_that_of_python(spark, text):
    want = X.fold_text(text, accents=False)
    for mark in X.PUNCTUATION[1:-2].replace("\\", ""):
        want = want.replace(mark, " ")
    assert one(spark, X.for_matching(F.lit(text))) == " ".join(want.split())
    assert one(spark, X.light(F.lit(text))) == " ".join(unicodedata.normalize("NFKC", text).casefold().split())


def test_shingles(spark):
    from amalgam.functions import keys as K

    title = "the a of machine-learning study"
    assert one(spark, K.shingles(F.lit(title))) == ["the", "machine-learning", "study", "the machine-learning", "machine-learning study"]
    assert one(spark, K.shingles(F.lit("a b"))) is None and one(spark, K.shingles(F.lit("one"))) == ["one"]


def test_identifiers(spark):
    assert one(spark, ids.uuid5(F.lit("sha256:x:y"))) == str(uuid.uuid5(uuid.UUID(ids.NAMESPACE), "sha256:x:y"))
    assert one(spark, ids.pair_id(F.lit("b"), F.lit("a"))) == "a|b"
    assert one(spark, ids.is_record_id(F.lit(str(uuid.uuid4())))) is False
    assert one(spark, ids.group_id("c", F.array(F.lit("b"), F.lit("a")))) == one(spark, ids.group_id("c", F.array(F.lit("a"), F.lit("b"))))


def test_ris_record(spark):
    first, second = samples.normalized(spark, samples.RIS).collect()
    c = first["canon"]
    assert (c["doi_norm"], c["doi_url"]) == ("10.1234/abc/d", "https://doi.org/10.1234/abc/d")
    assert c["title_norm_basic"] == "etude of machine-learning" and c["year_norm"] == 2020 and c["year_source"] == "RIS.PY"
    assert c["first_author_sig"] == "smith|JA" and c["author_sig_strict"] == ["smith|JA", "doe|JB"] and c["author_sig_loose"] == ["doe|J", "smith|J"]
    assert (c["pages_raw"], c["pages_norm_long"], c["page_first"], c["page_last"]) == ("12-19", "12-19", "12", "19")
    assert c["journal_norm"] == "the journal" and c["publication_type"] == ["JOUR"]
    assert first["keys"]["title_year_key"] == "etude of machine-learning|2020" and first["keys"]["title_key_fuzzy"] == "etude of machine learning"
    assert first["provenance"]["canon.doi_norm"].confidence == "high" and first["provenance"]["canon.title_norm_basic"]["sources"][0]["tag"] == "TI"
    assert [t["name"] for t in first["provenance"]["canon.doi_norm"]["transforms"]] == ["extract_from_url", "url_decode", "trim_punct", "casefold"]
    assert second["canon"]["title_raw"] == "Another title" and second["flags"]["authors_missing"] and second["canon"]["year_norm"] is None and second["keys"]["title_year_key"] is None


def test_pubmed_record(spark):
    first, second = samples.normalized(spark, samples.PUBMED, "b.nbib").collect()
    c = first["canon"]
    assert (c["pmid_norm"], c["pmcid"], c["doi_norm"]) == ("123", "PMC77", "10.1/xyz")
    assert c["first_author_sig"] == "smith|J" and len(c["authors_raw"]) == 2
    assert c["article_number"] == "e12" and first["flags"]["pages_unreliable"] and c["pages_norm_long"] is None
    assert (second["canon"]["page_first"], second["canon"]["page_last"]) == ("10", "15")


def test_bibtex_record(spark):
    (row,) = samples.normalized(spark, samples.BIBTEX, "e.bib").collect()
    assert row["canon"]["authors_raw"] == ["Doe, Jane", "John Smith"] and row["canon"]["author_sig_strict"] == ["doe|J", "smith|J"]
    assert row["flags"]["pages_unreliable"], "a run of dashes isn't a range"


def test_url_fallback_and_flags(spark):
    text = samples.ris({"TI": "Erratum: some study...", "UR": "see https://doi.org/10.7/Q?x", "AU": ["et al.", "Plato"]}, {"TI": "Ok", "M3": "something", "UR": "https://doi.org/10.7/q"})
    first, second = samples.normalized(spark, text).collect()
    assert first["canon"]["doi_norm"] == "10.7/q" and first["flags"]["title_truncated"] and first["flags"]["is_erratum_notice"]
    assert first["canon"]["authors_raw"] == ["Plato"] and first["canon"]["first_author_sig"] is None and first["canon"]["author_sig_strict"] is None
    assert second["canon"]["doi"] == "something" and second["canon"]["doi_norm"] is None, "a preferred tag hides the URL"


def test_idempotent_and_schema(spark):
    from amalgam.schema import RECORD, struct_type

    once = samples.normalized(spark, samples.RIS)
    assert normalize(once).collect() == once.collect()
    assert [(f.name, f.dataType.simpleString()) for f in once.schema] == [(f.name, f.dataType.simpleString()) for f in struct_type(RECORD)]


def test_unknown_format_fails(spark):
    bad = samples.normalized(spark, samples.RIS).withColumn("meta", F.col("meta").withField("source_format", F.lit("pdf")))
    with pytest.raises(Exception, match="unsupported format"):
        normalize(bad).collect()


def test_a_cluster_needs_a_shared_folder():
    """Only a local session may leave the checkpoint folder out."""
    from types import SimpleNamespace

    from amalgam.session import checkpoint_dir

    chosen = []
    make = lambda master, named=None: SimpleNamespace(sparkContext=SimpleNamespace(master=master, getCheckpointDir=lambda: chosen[-1] if chosen else None, setCheckpointDir=chosen.append), conf=SimpleNamespace(get=lambda key, other: named))
    for master in ("yarn", "spark://host:7077", "local-cluster[2,1,1024]", "k8s://x"):
        with pytest.raises(ValueError, match="spark.checkpoint.dir"):
            checkpoint_dir(make(master))
        assert checkpoint_dir(make(master, "hdfs:///shared")) == "hdfs:///shared"
        chosen.clear()
    for master in ("local", "local[*]", "local[8]", "local[4,2]"):
        assert "amalgam-checkpoint" in checkpoint_dir(make(master))
        chosen.clear()
