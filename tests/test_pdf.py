"""The PDF adapter, with a stand-in for the parser that reads pages from JSON."""

import json

import pytest

from refaudit.sources import pdf

STAND_IN = """
import json
from types import SimpleNamespace


class open:
    def __init__(self, stream, filetype):
        self.pages = json.loads(stream)

    def __enter__(self):
        return [Page(p) for p in self.pages]

    def __exit__(self, *_):
        pass


class Page:
    def __init__(self, p):
        self.p, self.rect = p, SimpleNamespace(width=600, height=800)

    def get_text(self, kind):
        if kind == "text":
            return "\\n".join(t for *_, t in self.p)
        if kind == "blocks":
            return [(x, y, x + 100, y + 10, t, i, 0) for i, (x, y, t) in enumerate(self.p)]
        return {"blocks": [{"lines": [{"bbox": (x, y, x + 100, y + 10), "spans": [{"text": t[:3]}, {"text": t[3:]}]}]} for x, y, t in self.p] + [{"image": 1}]}
"""


@pytest.fixture(scope="module")
def rows(spark, tmp_path_factory):
    d = tmp_path_factory.mktemp("pdf")
    (d / "fitz.py").write_text(STAND_IN)
    spark.sparkContext.addPyFile(str(d / "fitz.py"))
    (d / "in" / "deep").mkdir(parents=True)
    two = [[50, 100, "References"], [320, 140, "[3] Third one."], [50, 140, "[1] First one."], [50, 160, "[2] Second one."], [320, 160, "[4] Fourth one."]]
    (d / "in" / "a.pdf").write_text(json.dumps([[[50, 100, "Before"]], two]))
    (d / "in" / "deep" / "B.PDF").write_text(json.dumps([[[50, 300, "Only text"]]]))
    (d / "in" / "broken.pdf").write_text("{")
    (d / "in" / "not.txt").write_text("[]")
    files = pdf.read_files(spark, str(d / "in" / "*"))
    found = pdf.layout(files.union(pdf.read_files(spark, str(d / "in" / "deep")))).dropDuplicates()
    found.write.parquet(str(d / "rows"))
    return spark.read.parquet(str(d / "rows"))


def test_rows(rows):
    got = {(r.doc_id.rsplit("/", 1)[1], r.kind, r.page_no, r.no, r.text) for r in rows.where("error is null").collect()}
    assert ("a.pdf", "page", 1, 0, "References\n[3] Third one.\n[1] First one.\n[2] Second one.\n[4] Fourth one.") in got
    assert ("a.pdf", "block", 1, 2, "[1] First one.") in got and ("a.pdf", "line", 1, 2, "[1] First one.") in got
    assert not any(name == "not.txt" for name, *_ in got)


def test_texts_and_failures(rows):
    texts, failed = pdf.texts(rows)
    got = {r.doc_id.rsplit("/", 1)[1]: (r.tier, r.text) for r in texts.collect()}
    assert got["a.pdf"] == (1, "[1] First one.\n\n[2] Second one.\n\n[3] Third one.\n\n[4] Fourth one.") and got["B.PDF"] == (4, "Only text")
    assert [(r.doc_id.rsplit("/", 1)[1], bool(r.error)) for r in failed.collect()] == [("broken.pdf", True)]
