"""PDF files to layout rows. Needs PyMuPDF on the executors; imported only there."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

PLACE = "doc_id string, kind string, page_no int, page_width double, page_height double, no int, x0 double, y0 double, x1 double, y1 double, text string, error string"


def is_pdf(name: Column, mime: Column) -> Column:
    """By its MIME type, or by the end of its name."""
    return F.coalesce(mime == "application/pdf", F.lit(False)) | F.coalesce(F.endswith(F.lower(name), F.lit(".pdf")), F.lit(False))


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """PDF files as (path, content); other files are left out by name."""
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.[pP][dD][fF]").load(path).select("path", "content")


def layout(files: DataFrame) -> DataFrame:
    """PLACE rows of kind page, block or line; a file that can't be read gives one row with its error."""

    def run(batches) -> Iterator:
        import fitz
        import pandas as pd

        names = [x.split(" ")[0] for x in PLACE.split(", ")]
        for b in batches:
            for path, content in zip(b["path"], b["content"], strict=True):
                rows = []
                try:
                    with fitz.open(stream=bytes(content), filetype="pdf") as doc:
                        for p, page in enumerate(doc):
                            w, h = page.rect.width, page.rect.height
                            add = lambda kind, no, box, text: rows.append((path, kind, p, w, h, no, *map(float, box), text, None))  # noqa: B023, E731
                            add("page", 0, (0, 0, w, h), page.get_text("text") or "")
                            for i, x in enumerate(page.get_text("blocks")):
                                add("block", i, x[:4], x[4])
                            lines = (x for block in page.get_text("dict").get("blocks", []) for x in block.get("lines", []))
                            for i, x in enumerate(lines):
                                add("line", i, x["bbox"], "".join(s.get("text", "") for s in x.get("spans", [])))
                except Exception as e:  # noqa: BLE001  a broken file is a row, not a failed job
                    rows = [(path, "error", None, None, None, None, None, None, None, None, None, str(e))]
                yield pd.DataFrame(rows, columns=names)

    return files.mapInPandas(run, PLACE)


def parts(rows: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(pages, blocks, lines) of layout rows, as operators.layout takes them."""
    place = ["doc_id", "page_no", "page_width", "page_height"]
    of = lambda kind, no: rows.where(F.col("kind") == kind).select(*place, F.col("no").alias(no), "x0", "y0", "x1", "y1", "text")
    return rows.where("kind = 'page'").select("doc_id", "page_no", F.col("text").alias("plain")), of("block", "block_no"), of("line", "line_no")


def texts(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(doc_id, tier, text of every file that could be read; doc_id, error of the others) from layout rows. They are read
    several times: write them first, since parsing is the dear step."""
    from ..operators.layout import document_texts

    return document_texts(*parts(rows)), rows.where("kind = 'error'").select("doc_id", "error")
