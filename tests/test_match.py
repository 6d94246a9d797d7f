import json
import random
import re

import pytest
from pyspark.sql import functions as F

from refaudit.functions import text as T
from refaudit.operators import audit as A
from refaudit.operators import match as J
from refaudit.operators.remote import audit_remote
from refaudit.plans.queries import QUERIES
from refaudit.sources import lookup as H
from refaudit.sources import works as W
from refaudit.streaming.progress import finished, read_event_stream
from refaudit.tables import in_slices, swept

CAND = "struct<source:string,doi:string,title:string,authors:string,containerTitle:string,year:int,volume:string,issue:string,pages:string,publisher:string,url:string,crossrefScore:double>"


def cand(**k):
    return tuple(k.get(f) for f in W.CANDIDATE)


@pytest.fixture
def score(spark):
    def run(reference, **k):
        df = spark.createDataFrame([(reference, cand(**k))], f"reference string, cand {CAND}")
        return J.scored(J.with_keys(df)).first()["match"]

    return run


def test_scores_by_hand(score):
    """Sets of tokens counted by hand: title 2*4/(4+4), author 2*2/(11+2), venue 2*3/(11+3), one same year, three details."""
    m = score("K. Reed. 2003. Where the river bends. Bog Letters 7, 2 (2003), 5-9.", title="Where the river bends", authors="K. Reed", containerTitle="Bog Letters", year=2003, volume="7", issue="2", pages="5–9")
    tokens = len({"k", "reed", "2003", "where", "the", "river", "bends", "bog", "letters", "7", "2", "5", "9"})
    want = 0.5 * 1 + 0.2 * 2 * 2 / (tokens + 2) + 0.15 + 0.1 * 2 * 2 / (tokens + 2) + 3 * 0.03
    assert m.score == pytest.approx(want) and m.confidence == "high"
    assert m.evidence == ["Title overlap: strong", "Author overlap: weak", "Venue overlap: weak", "Year matched: 2003", "Volume matched: 7", "Issue matched: 2", "Pages matched: 5–9"]


@pytest.mark.parametrize("off, taken", [(0, -0.15), (1, 0.15), (2, 0.35), (-9, 0.35)])
def test_years_off(score, off, taken):
    k = dict(title="Where the river bends", authors="K. Reed", containerTitle="Bog Letters")
    reference = "K. Reed. 2003. Where the river bends. Bog Letters."
    undated, m = score(reference, **k), score(reference, year=2003 + off, **k)
    assert m.score == pytest.approx(undated.score - taken)
    assert m.details.severeYearMismatch == (abs(off) > 1) and (m.confidence == "low") == (abs(off) > 1)
    assert ("Year matched: 2003" if not off else f"Year mismatch: cited 2003, candidate {2003 + off}") in m.evidence


def test_a_doi_outweighs_the_year(score):
    m = score("K. Reed. 2003. Where the river bends. Bog Letters. doi:10.5555/A.b", title="Where the river bends", authors="K. Reed", containerTitle="Bog Letters", year=2010, doi="10.5555/a.B")
    assert m.details.doiMatched and m.confidence != "low" and "DOI exactly matched" in m.evidence


def test_no_shared_word_is_zero(score):
    m = score("K. Reed. 2003. Where the river bends.", title="Copper", authors="L. Moss", containerTitle="Annals", year=1950)
    assert (m.score, m.confidence) == (0, "low") and m.evidence[:3] == ["Title overlap: none", "Author overlap: none", "Venue overlap: none"]


@pytest.mark.parametrize("title, confidence", [("Where the river bends", "medium"), ("Where the river flows north", "low")])
def test_without_author_or_details(score, title, confidence):
    """Score 0.4 or more and a title above 0.25, but nothing that identifies the work: the title decides."""
    m = score("2003. Where the river bends. Bog Letters.", title=title, authors="Zed", containerTitle="Bog Letters", year=2003)
    assert m.score >= 0.4 and m.details.authorScore == 0 and m.confidence == confidence


def test_ranking_is_stable(spark):
    rows = [(1, "Smith. 2020. Title of a paper.", 1, cand(title="Other", doi="10.1/a")), (1, "Smith. 2020. Title of a paper.", 2, cand(title="Title of a paper", doi="10.1/b")), (1, "Smith. 2020. Title of a paper.", 3, cand(title="Title of a paper", doi="10.1/c"))]
    df = spark.createDataFrame(rows, f"id int, reference string, ord int, cand {CAND}")
    got = J.ranked(J.scored(J.with_keys(df)), ["id"]).orderBy("rank").select("cand.doi").collect()
    assert [r.doi for r in got] == ["10.1/b", "10.1/c", "10.1/a"]


RAW = {
    "plain": ({"DOI": "10.1000/ABC.", "title": ["T"], "author": [{"given": "Jane", "family": "Smith"}], "container-title": ["J"], "issued": {"date-parts": [[2022, 5, 1]]}, "volume": "12", "page": "45-67", "score": 3}, ("10.1000/abc", "T", "Jane Smith", "J", 2022, 3.0)),
    "print_first": ({"title": "Scalar", "issued": {"date-parts": [[2014]]}, "published-print": {"date-parts": [[2015, 5]]}, "score": "3"}, (None, "Scalar", "", "", 2015, None)),
    "issue_print": ({"title": ["T"], "issued": {"date-parts": [[2014]]}, "journal-issue": {"published-print": {"date-parts": [[2015]]}}}, (None, "T", "", "", 2015, None)),
    "malformed": ({"title": ["T"], "issued": {"date-parts": [[2014]]}, "published-print": {}}, (None, "T", "", "", None, None)),
    "nulls": ({"title": None, "issued": {"date-parts": [[2014]]}, "published-print": None, "author": [{"name": "G"}, {"family": "F"}, {}]}, (None, "", "G, F", "", 2014, None)),
    "nine": ({"author": [{"name": str(i)} for i in range(9)]}, (None, "", ", ".join(map(str, range(8))), "", None, None)),
}


def test_normalize_works(spark):
    df = spark.createDataFrame([(k, json.dumps(v[0])) for k, v in RAW.items()] + [("broken", "{not json")], "k string, json string")
    got = {r.k: (r.doi, r.title, r.authors, r.containerTitle, r.year, r.crossrefScore) for r in W.normalize_works(df).collect()}
    assert got == {k: v[1] for k, v in RAW.items()} | {"broken": (None, "", "", "", None, None)}


@pytest.fixture(scope="module")
def audited(spark):
    works = spark.createDataFrame([cand(doi="10.1000/x", title="A fine study of letters", authors="A. Quill", containerTitle="Journal of Letters", year=2020), cand(doi="10.1000/y", title="Gadgets and their makers", authors="B. Ink", containerTitle="Journal of Gadgets", year=2019)], CAND[7:-1].replace(":", " "))
    refs = [(1, "A. Quill. 2020. A fine study of letters. Journal of Letters. doi:10.1000/x"), (2, "No one. 2020. Thing. doi:10.1000/none"), (3, "B. Ink. 2019. Gadgets and their makers. Journal of Gadgets."), (4, "zzz")]
    return {r.id: r for r in A.audit(spark.createDataFrame(refs, "id int, reference string"), works, ["id"]).collect()}


def test_audit_branches(audited):
    assert audited[1].confidence == "high" and audited[1].summary.startswith("DOI resolved in Crossref: A fine study of letters (2020) DOI 10.1000/x.")
    assert audited[2].confidence == "low" and "failed" in audited[2].summary and audited[2].doi == "10.1000/none"
    assert audited[3].confidence == "medium" and audited[3].doi == "10.1000/y"
    assert audited[4].confidence == "low" and audited[4].doi is None and audited[4].evidence == []
    assert {r.status for r in audited.values()} == {"checked"}


def test_lookup_errors(spark):
    df = spark.createDataFrame([(404, "m"), (429, ""), (None, None)], "status int, message string")
    got = df.select(A.error_confidence(F.col("status")), A.error_text(F.col("message"))).collect()
    assert [tuple(r) for r in got] == [("low", "m"), ("medium", "unknown error"), ("medium", "unknown error")]


def test_fetch_retries_and_gives_up(spark):
    def get(url):
        return (503, "", None) if url.endswith("down") else (404, "", None) if url.endswith("gone") else (200, "{}", None)

    df = spark.createDataFrame([("a/ok",), ("a/down",), ("a/gone",)], "url string")
    got = {r.url: (r.status, r.body, r.error) for r in H.fetch_json(df, get, H.Config(min_interval_ms=0, retries=2), sleep=lambda s: None).collect()}
    assert got == {"a/ok": (200, "{}", None), "a/down": (503, None, "Remote request failed with status 503"), "a/gone": (404, None, "Remote request failed with status 404")}


def test_config_rejects_bad_numbers(spark):
    with pytest.raises(ValueError):
        H.Config(retries="many")
    spark.conf.set("spark.refaudit.rows", "5")
    spark.conf.set("spark.refaudit.mailto", "a@b.c")
    assert H.Config.of(spark) == H.Config(rows=5, mailto="a@b.c")
    spark.conf.set("spark.refaudit.rows", "five")
    with pytest.raises(ValueError, match="spark.refaudit.rows"):
        H.Config.of(spark)
    spark.conf.unset("spark.refaudit.rows")
    spark.conf.unset("spark.refaudit.mailto")


def test_event_stream_in_windows(spark, tmp_path):
    """Files of event lines as audits write them, read as they arrive and counted by window and confidence."""
    for i, lines in enumerate([['{"event":"references-found","total":2}', '{"event":"checked-reference","index":1,"total":2,"confidence":"high"}'], ['{"event":"checked-reference","index":2,"total":2,"confidence":"high"}', "{broken", '{"event":"complete","total":2}']]):
        (tmp_path / "in" / f"batch={i}").mkdir(parents=True)
        (tmp_path / "in" / f"batch={i}" / "part-0.txt").write_text("\n".join(lines))
    counted = finished(read_event_stream(spark, str(tmp_path / "in")), window="365 days")
    query = counted.writeStream.format("memory").queryName("finished").outputMode("complete").trigger(availableNow=True).start()
    query.awaitTermination()
    assert [(r.confidence, r.n) for r in spark.table("finished").collect()] == [("high", 2)]


def test_remote_audit_keeps_every_reference(spark):
    """A failed search, one without items and one whose items are all unusable leave a row each; a candidate is scored."""
    def get(url):
        if "down" in url:
            return 500, "", None
        if "none" in url:
            return 200, '{"message":{"items":[]}}', None
        if "odd" in url:
            return 200, '{"message":{"items":[{"publisher":"x"},7]}}', None
        return 200, '{"message":{"items":[{"title":"Other"},{"title":["Where the river bends"],"issued":{"date-parts":[[2003]]},"author":[{"family":"Reed"}]}]}}', None

    refs = [(i, f"K. Reed. 2003. Where the river bends. {x}.") for i, x in enumerate(["down", "none", "odd", "found"])] + [(9, None)]
    got = {r.id: r for r in audit_remote(spark.createDataFrame(refs, "id int, reference string"), ["id"], get, H.Config(min_interval_ms=0, retries=0), sleep=lambda s: None).collect()}
    assert [got[i].summary.split(":")[0] for i in range(4)] == ["No DOI was detected and Crossref candidate search failed", A.NO_CANDIDATE, A.NO_CANDIDATE, "No DOI was present in the citation. Best Crossref candidate"]
    assert got[3].confidence == "medium" and "Crossref candidates reviewed: 2" in got[3].evidence and len(got) == 5


WORK = CAND[7:-1].replace(":", " ")


def _by_brute_force(refs, works, k):
    """(ref, place): doi, by counting every pair."""
    tokens = lambda x: set(re.findall("[a-z0-9]+", x.lower()))
    held = [(w[1], tokens(" ".join(str(x) for x in (w[2], w[3], w[4], w[5]) if x is not None))) for w in works]
    out = {}
    for i, text in refs:
        own = tokens(text)
        order = sorted((-len(own & t), len(t), doi) for doi, t in held if own & t)
        out |= {(i, n): doi for n, (_, _, doi) in enumerate(order[:k], 1)}
    return out


def test_candidates_share_words_that_most_works_hold(spark):
    """The work that shares most tokens, all of them held by more than 1000 works, comes first."""
    works = [cand(doi=f"10.1/{i:05d}", title="red blue" if i % 2 else "red green", authors="A. Ink") for i in range(2400)] + [cand(doi="10.1/z", title="red blue green", authors="A. Ink"), cand(doi="10.1/rare", title="odd")]
    refs = spark.createDataFrame([(1, "Ink, A. red blue green odd")], "id int, reference string").withColumn("ref_tokens", T.token_set(F.col("reference")))
    got = J.candidates(refs, spark.createDataFrame(works, WORK), ["id"]).orderBy("ord").select("cand.doi").collect()
    assert [r.doi for r in got] == ["10.1/z", *[f"10.1/{i:05d}" for i in range(7)]]


def test_candidates_against_brute_force(spark):
    r = random.Random(5)
    words = [f"w{i}" for i in range(60)]
    pick = lambda n: " ".join(words[min(59, int(r.expovariate(0.12)))] for _ in range(n))
    works = [cand(doi=f"10.1/{i}", title=pick(r.randint(1, 9)) + (f" n{i}" if i % 3 else ""), authors=pick(1), year=r.choice([None, 2019, 2020])) for i in range(700)]
    refs = [(i, pick(r.randint(1, 12)) + f" 2019 n{r.randint(0, 900)}") for i in range(120)] + [(200, " ".join(f"n{i}" for i in range(300)) + " 2020 w0 w1"), (201, "nothing"), (202, "")]
    refs += [(300 + i, " ".join(works[i][2].split()[-1:])) for i in range(20)]
    asked = spark.createDataFrame(refs, "id int, reference string").withColumn("ref_tokens", T.token_set(F.col("reference")))
    twice = spark.createDataFrame(works + works[:50], WORK)
    want = _by_brute_force(refs, works, 8)
    for sizes in ({}, {"block": 100, "chunk": 40}):
        got = {(x.id, x.ord): x.doi for x in J.candidates(asked, twice, ["id"], **sizes).select("id", "ord", "cand.doi").collect()}
        assert got == want


def test_candidates_of_long_works(spark):
    """Works of more than 32 tokens, nearly all of them frequent, so that bounds are loose and ties many."""
    r = random.Random(11)
    words = [f"w{i}" for i in range(90)]
    works = [cand(doi=f"10.1/{i}", title=" ".join(r.sample(words, r.choice([3, 40, 41, 60]))), authors="A. Ink", year=2019) for i in range(900)]
    refs = [(i, " ".join(r.sample(words, r.randint(1, 70)))) for i in range(60)] + [(100, "Ink"), (101, "a ink 2019"), (102, "w1 w1 unheard")]
    asked = spark.createDataFrame(refs, "id int, reference string").withColumn("ref_tokens", T.token_set(F.col("reference")))
    want = _by_brute_force(refs, works, 8)
    for sizes in ({}, {"block": 300, "chunk": 20}):
        got = {(x.id, x.ord): x.doi for x in J.candidates(asked, spark.createDataFrame(works, WORK), ["id"], **sizes).select("id", "ord", "cand.doi").collect()}
        assert got == want


def test_works_are_sent_in_a_fifth_of_the_bytes(spark):
    """What candidates sends many times goes as pieces that hold all rows."""
    import pyarrow as pa

    df = spark.range(0, 4000, 1, 2).select("id", F.concat(F.lit("large red ring study of journal rings 2019 q"), "id").alias("_tokens"))
    pieces = J._packed(df, 900).collect()
    back = [x for p in pieces for x in pa.ipc.open_stream(p["_blob"]).read_all().to_pylist()]
    assert sorted(x["id"] for x in back) == list(range(4000)) and all(x["_tokens"].endswith(f"q{x['id']}") for x in back)
    assert max(p["_rows"] for p in pieces) <= 900 and 5 * sum(len(p["_blob"]) for p in pieces) < sum(len(x["_tokens"]) + 16 for x in back)


def test_blocks_add_up_in_one_row_a_reference(spark):
    """Blocks of works follow each other through one task: a reference leaves it once, with the best of all blocks, and neither
    an earlier block nor an earlier place in the stream counts, only the number of shared tokens and then _pos."""
    import pyarrow as pa

    def piece(**columns):
        table, sink = pa.table(columns), pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, table.schema) as out:
            out.write_table(table)
        return sink.getvalue().to_pybytes()

    works = lambda *rows: piece(**{c: [r[i] for r in rows] for i, c in enumerate(["_pos", "_row", "_tokens"])})
    stream = [
        (-1, piece(id=[1, 2, 3], _asked=["red ring 2019 odd", "unheard", "blue"])),
        (0, works((5, 50, "red ring"), (9, 90, "red"), (7, 70, "green"))),
        (1, works((2, 20, "ring red"), (1, 10, "ring"))),
        (2, works((3, 30, "blue ring 2019 red"), (8, 80, "blue"))),
    ]
    batches = [pa.RecordBatch.from_arrays([pa.array([n], pa.int32()), pa.array([b], pa.binary())], ["_block", "_blob"]) for n, b in stream]
    schema = pa.schema([("id", pa.int64()), ("_rows", pa.list_(pa.int64()))])
    got = [r for b in J._nearest(["id"], 3, schema)(batches) for r in b.to_pylist()]
    assert sorted(got, key=lambda r: r["id"]) == [{"id": 1, "_rows": [30, 20, 50]}, {"id": 3, "_rows": [30, 80]}]


def test_more_chunks_than_cores(spark):
    """Chunks go in rounds of as many as there are cores; no reference is lost between them."""
    works = [cand(doi=f"10.1/{i:03d}", title=f"red ring n{i % 7}", authors="A. Ink") for i in range(60)]
    refs = [(i, f"Ink red n{i % 7}") for i in range(90)]
    asked = spark.createDataFrame(refs, "id int, reference string").withColumn("ref_tokens", T.token_set(F.col("reference")))
    got = {(x.id, x.ord): x.doi for x in J.candidates(asked, spark.createDataFrame(works, WORK), ["id"], block=25, chunk=9).select("id", "ord", "cand.doi").collect()}
    assert got == _by_brute_force(refs, works, 8)


def test_slices_lose_no_reference(spark):
    """References go slice by slice past their candidates: every one comes out once, as from one slice, with or without any."""
    r = random.Random(3)
    works = spark.createDataFrame([cand(doi=f"10.1/{i:03d}", title=f"red ring {r.choice('abc')} n{i % 9}", authors="A. Ink", year=2019) for i in range(60)], WORK)
    refs = spark.createDataFrame([(i, f"Ink, A. 2019. Red ring n{i % 11}.") for i in range(50)] + [(100, "zzz"), (101, ""), (102, None)], "id int, reference string")
    pick = lambda df: df.select("id", "rank", "cand.doi", "match.score", "n_candidates")
    one, many = ({tuple(x) for x in J.ranked_candidates(refs, works, ["id"], pick, how="left", slices=n).collect()} for n in (1, 3))
    assert one == many and {x[0] for x in one} == {*range(50), 100, 101, 102}
    assert len(one) == 50 * 8 + 3 and {x[2:] for x in one if x[0] > 99} == {(None, 0.0, 1)}


def test_audit_gives_a_row_for_each_reference_of_any_kind(spark):
    works = spark.createDataFrame([cand(doi=f"10.1000/{i}", title=f"Red rings of n{i}", authors="A. Ink", containerTitle="Journal of Rings", year=2019) for i in range(30)], WORK)
    refs = [(i, f"A. Ink. 2019. Red rings of n{i}. Journal of Rings." + (f" doi:10.1000/{i}" if i % 2 else "")) for i in range(40)] + [(99, None)]
    got = {x.id: x for x in A.audit(spark.createDataFrame(refs, "id int, reference string"), works, ["id"]).collect()}
    assert sorted(got) == [x for x, _ in refs]
    assert all(got[i].doi == f"10.1000/{i}" for i in range(30)) and all(got[i].confidence == ("high" if i % 2 else "medium") for i in range(30))
    assert got[31].summary.endswith("404.") and got[99].doi is None and got[99].evidence == []


def test_a_sweep_lets_go_of_what_python_gave_up(spark):
    """Before the driver collects its garbage, not up to a second later, when the next step's shuffles lie beside the last one's."""
    pending = spark.sparkContext._gateway._gateway_client.finalizer_deque
    left = 0
    for _ in range(8):
        given_up = [spark.range(i) for i in range(20)]
        del given_up
        swept(spark)
        left += len(pending)
    assert not left


@pytest.mark.parametrize("name", ["scr02_audit", "win07_rank"])
def test_order_tables_are_joined_once(spark, name):
    """Works and the references made of them come from one written table; the result joins no order tables again."""
    assert not [f for f in QUERIES[name](spark, "/root/testdata/sf0.001").inputFiles() if "/root/testdata" in f]


def test_a_response_collects_only_what_it_shows(spark, monkeypatch):
    from refaudit.plans import queries as Q

    plans = []
    monkeypatch.setattr(Q, "in_slices", lambda n, keys, step: plans.append(step(lambda df: df)) or plans[0])
    assert Q.snk02_response(spark, "/root/testdata/sf0.001").count() > 0
    plan = plans[0]._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_list" in plan and "overlap" not in plan and "Crossref" not in plan


def test_slices_add_up(spark):
    df = spark.range(100).withColumn("x", F.when(F.col("id") % 10 > 0, F.col("id")))
    for n in (1, 4):
        assert sorted(r.id for r in in_slices(n, ["x"], lambda own: own(df)).collect()) == list(range(100))
