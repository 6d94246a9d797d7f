"""Citations built from known fields, and what has to be read from them; then the rules' edges, one by one."""

import random

import pytest

from refaudit.functions.metadata import FIELDS, with_metadata

WORDS = "tidal basalt lichen harbour meadow copper lantern orchard quartz willow saddle marble".split()


def _field(r):
    title = " ".join(r.sample(WORDS, r.randrange(3, 7))).capitalize()
    first = r.randrange(1, 900)
    return {
        "authors": ", ".join(f"{r.choice('KLMNP')}. {r.choice(WORDS).capitalize()}" for _ in range(r.randrange(1, 4))),
        "date": str(r.randrange(1900, 2100)), "title": title, "venue": f"Annals of {r.choice(WORDS)} Studies",
        "volume": str(r.randrange(1, 99)), "issue": str(r.randrange(1, 13)), "pages": f"{first}{r.choice(['-', '–'])}{first + r.randrange(1, 40)}",
    }


def _marker(r):
    return r.choice(["", f"[{r.randrange(1, 200)}] ", f"{r.randrange(1, 200)}. ", f"{r.randrange(1, 200)}) "])


def _plain(r, f):
    return f"{_marker(r)}{f['authors']}. {f['date']}. {f['title']}. {f['venue']} {f['volume']}, {f['issue']} ({f['date']}), {f['pages']}.", f | {"authors": f["authors"]}


def _dated(r, f):
    authors = "; ".join(reversed(f["authors"].split(", ")))
    return f"{authors} ({f['date']}). {f['title']}. {f['venue']} {f['volume']} ({f['date']}), {f['pages']}. https://doi.org/10.5555/{r.randrange(10**6)}", f | {"authors": authors, "issue": ""}


def _quoted(r, f):
    a, b = r.choice(['""', "“”"])
    return f"{_marker(r)}{f['authors']}, {a}{f['title']},{b} {r.choice(['', 'in '])}{f['venue']}, vol. {f['volume']}, no. {f['issue']}, pp. {f['pages']}, {f['date']}.", f


def _bare(r, f):
    return f"{f['authors']}. {f['date']}. {f['title']}.", f | dict.fromkeys(("venue", "volume", "issue", "pages"), "")


def _read(spark, references):
    df = spark.createDataFrame(list(enumerate(references)), "i int, reference string")
    return [r.extracted.asDict() for r in with_metadata(df).orderBy("i").collect()]


def test_fields_come_back(spark):
    r = random.Random(11)
    made = [r.choice([_plain, _dated, _quoted, _bare])(r, _field(r)) for _ in range(400)]
    for (reference, want), got in zip(made, _read(spark, [m[0] for m in made]), strict=True):
        assert got == want, reference


EDGES = {
    # the first year counts, words that only look like one don't
    "N. Fern. Survey 20195. 1899. Reached 2031 places today. 2044.": {"date": "2031"},
    # a quoted title wins over what follows the year; fewer than three characters are no title
    'L. Moss, 2003. "Salt," Not the title at all.': {"title": "Salt"},
    'L. Moss. 2003. "It" was here again. Done.': {"title": '"It" was here again'},
    # segments that name a venue, hold a semicolon or have fewer than three words are no titles
    "L. Moss. 2003. Two words. One; two three four. IEEE list of things. Where the river bends. End.": {"title": "Where the river bends"},
    # volume letters, page ranges with spaces, and the last range of several
    "L. Moss. 2003. Where the river bends. Bog Letters 7B (2003), 5 — 9.": {"venue": "Bog Letters", "volume": "7B", "issue": "", "pages": "5 — 9"},
    "L. Moss. 2003. Where the river bends. In Proceedings of Bogs, 3-4 and 11-12.": {"venue": "Proceedings of Bogs, 3-4 and 11-12", "pages": "11-12"},
    # after a quote: a year at the end goes, one inside stays; an acronym ends the venue; a single page
    'K. Reed, "Where it bends," Bog Days 1999 Notes, 2004.': {"venue": "Bog Days 1999 Notes"},
    'K. Reed, "Where it bends," in Meeting on Bogs (MOB), Riga, Latvia, 2004.': {"venue": "Meeting on Bogs (MOB)"},
    'K. Reed, "Where it bends," Bog Notes, vol. A-1, no. 3b, p. 77, 2004.': {"volume": "A-1", "issue": "3b", "pages": "77"},
    # nothing to read
    "": dict.fromkeys(FIELDS, ""),
}


@pytest.fixture(scope="module")
def edges(spark):
    return dict(zip(EDGES, _read(spark, list(EDGES)), strict=True))


@pytest.mark.parametrize("reference", EDGES)
def test_edges(edges, reference):
    assert {k: edges[reference][k] for k in EDGES[reference]} == EDGES[reference]


def test_null(spark):
    df = spark.createDataFrame([(None,)], "reference string")
    assert with_metadata(df).first().extracted.asDict() == dict.fromkeys(FIELDS, "")
