import pytest
from pyspark.sql import functions as F

from refaudit.functions import metadata as M
from refaudit.functions import text as T


@pytest.fixture
def value(spark):
    def run(make, *texts):
        df = spark.createDataFrame([tuple(texts)], ", ".join(f"c{i} string" for i in range(len(texts))))
        return df.select(make(*[F.col(f"c{i}") for i in range(len(texts))])).first()[0]

    return run


def test_normalize(value):
    assert value(T.normalize_text, "  a\t\n b  c﻿ ") == "a b c"
    assert value(T.normalize_text, None) == ""


def test_clean_joins_letters_and_drops_blank_lines(value):
    assert value(T.clean_extracted, "a\nb\n\n[1]  c\r\n") == "a b\n[1] c"


def test_strip_headers(value):
    assert value(T.strip_headers, "Title\n REFERENCES \n[1] x\n\n[2] y") == "[1] x\n[2] y"
    assert value(T.strip_headers, "a\n\nb") == "a\nb"
    assert value(T.strip_headers, "a\nBibliography") == ""


def test_interleave(value):
    assert value(T.interleave_columns, "a\nb\nc\nd\ne") == "a d b e c"
    assert value(T.interleave_columns, "a\nb\n\nc") == "a b\n\nc"
    assert value(T.interleave_columns, "") == ""


def test_looks_like_references(value):
    assert value(T.looks_like_references, "[1] a\n2. b\n3) c")
    assert not value(T.looks_like_references, "Intro\nbody\n[1] a")
    line = "Quill, A., & Ink, B. (2011). Title here."
    assert value(T.looks_like_references, "\n".join([line] * 3))


@pytest.mark.parametrize("given, wanted", [("compu- tation", "computation"), ("ACM- style", "ACM-style"), ("A- bcd", "Abcd"), ("10.1000/ab- c1", "10.1000/ab-c1"), ("see  this", "see this")])
def test_repair_wrapping(value, given, wanted):
    assert value(T.repair_wrapping, given) == wanted


def test_split_inline(value):
    assert value(T.split_inline, "see [1] One x. [2] Two y.") == ["see", "[1] One x.", "[2] Two y."]
    assert value(T.split_inline, "[1] One") == ["[1] One"]
    assert value(T.split_inline, "none") == ["none"]


def test_tokens_and_dice(value):
    assert value(T.tokens, "Müller K–12") == ["m", "ller", "k", "12"]
    d = lambda a, b: T.dice(T.token_set(a), T.token_set(b))
    assert value(d, "The Cat", "cat the the") == 1.0
    assert value(d, "", "abc") == 0.0
    assert value(d, "a b", "b c") == 0.5


@pytest.mark.parametrize("x, wanted", [("0.8", "strong"), ("0.45", "medium"), ("0.01", "weak"), ("0", "none")])
def test_labels(value, x, wanted):
    assert value(lambda c: T.score_label(c.cast("double")), x) == wanted


@pytest.mark.parametrize("x, wanted", [("0.125", "0.13"), ("0.625", "0.63"), ("0.615", "0.61"), ("1.005", "1.00"), ("0.846667", "0.85")])
def test_to_fixed2(value, x, wanted):
    assert value(lambda c: T.to_fixed2(c.cast("double")), x) == wanted


def test_utf16_length(value):
    assert value(T.utf16_length, "a😀") == 3


def test_path_encode(value):
    assert value(T.path_encode, "10.1000/a b(c)~é") == "10.1000%2Fa%20b(c)~%C3%A9"


@pytest.mark.parametrize("given, wanted", [("x doi:10.1/x", "doi"), ("Smith. Thing. 10.1000/x", "unknown"), ("A process for foo", "article"), ("arXiv:1", "arxiv")])
def test_type(value, given, wanted):
    assert value(M.reference_type, given) == wanted


def test_doi_and_year(value):
    assert value(M.extract_doi, "(doi 10.1000/ABC)") == "10.1000/abc)"
    assert value(M.extract_doi, "10.1000/abc.;") == "10.1000/abc"
    assert value(M.extract_doi, "none") is None
    assert value(M.extract_year, "arXiv:2003.01234, 2021") == 2003
    assert value(M.extract_year, "x12019 1899") is None


def test_same_value(value):
    assert value(M.same_value, "12.", "12")
    assert not value(M.same_value, "09", "9")
    assert not value(M.same_value, "", "")
    assert value(lambda a, b: M.same_value(a, b, M.page_range), "834 – 860", "834-860")


def test_last_page_range(value):
    assert value(M.last_page_range, "1-2 and 33 – 44.") == "33 – 44"
    assert value(M.last_page_range, "none") == ""
