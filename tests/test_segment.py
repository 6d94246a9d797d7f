import pytest
from pyspark.sql import functions as F

from refaudit.operators import layout as L
from refaudit.operators import report as R
from refaudit.operators.segment import references_of

TEXTS = {
    "marked": ("Title\nReferences\n[1] A one.\n[2] B two.", "line", ["[1] A one.", "[2] B two."]),
    "continued": ("References\n[1] A one.\nstill one\n[2] B two.", "line", ["[1] A one. still one", "[2] B two."]),
    "inline": ("References [15] Aa one. doi:10.1000/x tail [16] Bb two. [2] Cc three.", "inline", ["[15] Aa one. doi:10.1000/x", "[16] Bb two.", "[2] Cc three."]),
    "blank": ("A b.\n\nC d.", "line", ["A b.", "C d."]),
    "single": ("[1] Foo bar.", "inline", ["[1] Foo bar."]),
    "stop": ("Funding was provided", "fallback", []),
    "author_date": ("Quill, A., & Ink, B. (2015). One.\nInk, K. (2021). Two\nmore.", "author-date", ["Quill, A., & Ink, B. (2015). One.", "Ink, K. (2021). Two more."]),
    "empty": ("", "none", []),
    "heading_only": ("x\nReferences\n", "none", []),
}


@pytest.fixture(scope="module")
def segmented(spark):
    df = spark.createDataFrame([(k, v[0]) for k, v in TEXTS.items()] + [("null", None), ("many", "\n".join(f"[{i}] x" for i in range(1, 121)))], "k string, text string")
    return {r.k: r for r in references_of(df, debug=True).collect()}


@pytest.mark.parametrize("name", TEXTS)
def test_strategies(segmented, name):
    assert (segmented[name].strategy, segmented[name].references) == TEXTS[name][1:]


def test_limits_and_nulls(segmented):
    assert len(segmented["many"].references) == 100
    assert segmented["null"].references == []
    assert "using line-based extraction" in segmented["marked"].debug


def block(no, x0, y0, text, page=0, doc="d"):
    return (doc, page, 600.0, 800.0, no, float(x0), float(y0), 0.0, 0.0, text)


SCHEMA = "doc_id string, page_no int, page_width double, page_height double, {} int, x0 double, y0 double, x1 double, y1 double, text string"


def blocks(spark, rows, no="block_no"):
    return spark.createDataFrame(rows, SCHEMA.format(no))


def test_bands(spark):
    b = blocks(spark, [block(0, 50, 70, "body"), block(1, 50, 70, "References"), block(2, 50, 760, "[1] foot"), block(3, 50, 300, " ")])
    assert [r.text for r in L.in_body(b).collect()] == ["References"]


def test_columns(spark):
    b = blocks(spark, [block(0, 320, 100, "[3] c"), block(1, 50, 200, "[2] b"), block(2, 50, 100, "[1] a"), block(3, 320, 200, "[4] d")])
    assert [r.text for r in L.ordered_blocks(b).orderBy("pos").collect()] == ["[1] a", "[2] b", "[3] c", "[4] d"]
    near = blocks(spark, [block(0, 50, 100, "[1] a"), block(1, 150, 90, "[2] b")])
    assert {r.col_no for r in L.with_columns(near).collect()} == {0}


def test_heading_on_the_right(spark):
    b = blocks(spark, [block(0, 40, 100, "above"), block(1, 320, 200, "References"), block(2, 40, 300, "left"), block(3, 320, 300, "[1] right")])
    assert {r.text for r in L.beside_heading(L.in_body(b)).collect()} == {"above", "References", "[1] right"}


@pytest.mark.parametrize("given, wanted", [(["[2] b", "[1] a", "[3] c"], ["[1] a", "[2] b", "[3] c"]), (["[2] b", "[1] a", "[9] c"], ["[2] b", "[1] a", "[9] c"]), (["[1] a", "more", "[2] b"], ["[1] a more", "[2] b"]), ([], [])])
def test_sorted_groups(spark, given, wanted):
    df = spark.createDataFrame([(given,)], "g array<string>")
    assert L.with_sorted_groups(df, "g", "s").first()["s"] == wanted


def document(spark, rows):
    b = blocks(spark, rows)
    pages = b.select("doc_id", "page_no").distinct().withColumn("plain", F.lit("plain"))
    return L.document_texts(pages, b, b.withColumnRenamed("block_no", "line_no")).first()


def test_document_tiers(spark):
    refs = [block(i, 50, 200 + 20 * i, f"[{i}] Author {i}. Title.") for i in (1, 2, 3)]
    got = document(spark, [block(9, 50, 150, "References"), *refs, block(8, 50, 400, "Appendix")])
    assert (got.tier, got.text) == (1, "\n\n".join(f"[{i}] Author {i}. Title." for i in (1, 2, 3)))
    assert document(spark, refs).tier == 2
    lines = [block(0, 50, 150, "References"), block(1, 50, 200, "Quill, A. (2019). A study of"), block(2, 70, 220, "some letters in the world. Press."), block(3, 50, 240, "Ink, B. (2020). Too short.")]
    got = document(spark, lines)
    assert (got.tier, got.text) == (3, "Quill, A. (2019). A study of some letters in the world. Press.")
    assert document(spark, [block(0, 50, 200, "Just text")]).text == "Just text"


@pytest.fixture(scope="module")
def audited(spark):
    meta = "struct<extracted:struct<authors:string,date:string,title:string,venue:string,volume:string,issue:string,pages:string>,matched:struct<authors:string,date:string,title:string,venue:string,volume:string,issue:string,pages:string>>"
    m = (("A", "2020", "T", "", "", "", ""), ("", "", "", "", "", "", ""))
    rows = [(1, 1, "r1", "high", "10.1/x", m, ["<e>"]), (1, 2, "r2", "low", None, m, []), (1, 3, "r3", "high", None, m, [])]
    return spark.createDataFrame(rows, f"doc_id int, ref_no int, reference string, confidence string, doi string, metadata {meta}, evidence array<string>")


def test_summary(audited):
    assert [(r.level, r.n, r.refs) for r in R.confidence_summary(audited).orderBy("ord").collect()] == [("HIGH", 2, "Ref 1, Ref 3"), ("MEDIUM", 0, "None"), ("LOW", 1, "Ref 2")]


def test_comparison(audited):
    got = R.metadata_comparison(audited.where("ref_no = 1"), ["ref_no"]).orderBy("ord").collect()
    assert [r.field for r in got] == ["Authors", "Date", "Title of work", "Publication venue", "Volume", "Issue", "Pages"]
    assert got[3].extracted == "Not found" and got[0].extracted == "A"


def test_evidence_and_links(spark, audited):
    assert [r.evidence for r in R.evidence_rows(audited, ["ref_no"]).orderBy("ref_no").collect()] == ["&lt;e&gt;", "None", "None"]
    assert [r[0] for r in audited.select(R.doi_link(F.col("doi"))).collect()] == ["https://doi.org/10.1/x", "None", "None"]


def test_response_and_events(spark, audited):
    docs = spark.createDataFrame([(1, "f.pdf", "raw", "clean", "a😀", ["trace"]), (2, "g.pdf", "", "", "", [])], "doc_id int, filename string, raw string, cleaned string, processed string, debug array<string>")
    plain = {r.doc_id: r for r in R.responses(docs, audited).collect()}
    assert plain[1].debugOutput is None and plain[1].totalCharacters == 3 and [x.reference for x in plain[1].references] == ["r1", "r2", "r3"]
    assert plain[2].referencesFound == 0
    assert R.responses(docs, audited, debug=True).where("doc_id = 1").first().debugOutput == "trace"
    got = R.events(docs, audited).where("doc_id = 1").orderBy("seq").collect()
    assert [r.event for r in got] == ["references-found", *["checking-reference", "checked-reference"] * 3, "complete"]
    assert got[2].value == '{"event":"checked-reference","index":1,"total":3,"confidence":"high","doi":"10.1/x"}'
    assert [r.event for r in R.events(docs, audited).where("doc_id = 2").orderBy("seq").collect()] == ["references-found", "complete"]


def test_stream(spark, tmp_path):
    from refaudit.operators.report import read_events
    from refaudit.sources.works import normalize_works
    from refaudit.streaming.progress import audit_stream

    source = tmp_path / "in"
    source.mkdir()
    (source / "a.txt").write_text("Paper\nReferences\n[1] A. Quill. 2020. A fine study of letters. doi:10.1000/x\n[2] B. Ink. 2019. Another thing.\n")
    works = normalize_works(spark.createDataFrame([('{"DOI":"10.1000/x","title":"A fine study of letters"}',)], "json string"))
    query = audit_stream(spark, str(source), works, str(tmp_path / "out"), str(tmp_path / "cp"))
    query.awaitTermination()
    got = read_events(spark, str(tmp_path / "out")).groupBy("event").count().collect()
    assert {r.event: r["count"] for r in got} == {"references-found": 1, "checking-reference": 2, "checked-reference": 2, "complete": 1}
