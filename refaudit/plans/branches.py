"""Queries for branches, caps and adapters that the derived corpus alone doesn't reach, and their SQL twins."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import metadata as M
from ..functions import text as T
from ..operators import match as J
from ..operators import remote as O
from ..operators import report as R
from ..operators import segment as G
from ..sources import corpus as C
from ..sources import lookup as H
from ..sources import papers as P
from ..sources import pdf
from ..sources import works as W
from ..streaming import progress as S
from .queries import KEY, ranked_without_doi, table
from .sql import RANKED, WITH


def _join(*x) -> Column:
    return F.concat(*[i.cast("string") if isinstance(i, Column) else F.lit(i) for i in x])


def lim01_first_hundred(spark, d):
    """Bibliographies of up to 160 references, of which the first hundred count."""
    big = P.cited(spark, d).groupBy(F.floor(F.col("doc_id") / 8).cast("long").alias("big_id")).agg(F.array_sort(F.collect_list(F.struct("doc_id", "no", "body"))).alias("r"))
    lines = F.transform("r", lambda x, i: F.concat(F.lit("["), (i + 1).cast("string"), F.lit("] "), x["body"]))
    docs = big.select("big_id", F.concat(F.lit("Text\nReferences\n"), F.array_join(lines, "\n")).alias("text"))
    return G.references_of(docs).select("big_id", F.size("references").cast("long").alias("n_references"), F.try_element_at("references", F.lit(-1)).alias("last"))


def _numbers(spark, d):
    return C.works(spark, d).select("n")


def lim03_authors(spark, d):
    names = F.array_join(F.transform(F.sequence(F.lit(0), F.col("n") % 13), lambda i: F.concat(F.lit('{"given":"G'), i.cast("string"), F.lit('","family":"'), F.when(i == 3, "").otherwise("Ink"), F.lit('"}'))), ",")
    return W.normalize_works(_numbers(spark, d).select("n", _join('{"title":"t","author":[{},', names, "]}").alias("json"))).select("n", "authors")


def lim04_caps(spark, d):
    long = _join(F.repeat(F.lit("Quill Ink, "), (F.col("n") % 40).cast("int") + 1), "2001. ", F.repeat(F.lit("word; "), (F.col("n") % 50).cast("int") + 1), "end")
    return M.with_metadata(_numbers(spark, d).select("n", long.alias("reference"))).select("n", F.col("extracted.authors").alias("authors"), F.col("extracted.title").alias("title"))


def md09_venues(spark, d):
    n = F.col("n")
    head = _join("[", n % 20 + 1, "] A. Quill. 2001. A title of rings. ")
    tail = (
        F.when(n % 4 == 0, _join("In Proceedings of the ", n, "th Meeting on Rings. 10-1", n % 10))
        .when(n % 4 == 1, _join("IEEE Letters on Rings ", n, ". 10-1", n % 10))
        .when(n % 4 == 2, _join("Some wiley notes ", n, ". 10-1", n % 10))
        .otherwise(_join("Rings Quarterly ", n, ", ", n % 5, ", Article ", n % 9, ", 9 pages"))
    )
    df = M.with_metadata(_numbers(spark, d).select("n", F.concat(head, tail, F.lit(".")).alias("reference")))
    return df.select("n", *[F.col(f"extracted.{x}").alias(x) for x in ("title", "venue", "volume", "issue", "pages")])


def sim03_fixed(spark, d):
    x = (F.col("n") % 1001) / F.lit(1000.0)
    return _numbers(spark, d).select("n", T.to_fixed2(x).alias("shown"))


def agg10_reviewed(spark, d):
    return ranked_without_doi(spark, d, lambda r: r.where("rank = 1").select(*KEY, F.col("n_candidates").cast("long").alias("n_candidates")))


def prj13_evidence(spark, d):
    lines = F.array_compact(F.array(F.when(F.col("n") % 3 > 0, _join("a < b & ", F.col("n"))), F.when(F.col("n") % 3 > 1, F.lit("\"c\" > 'd'"))))
    return R.evidence_rows(_numbers(spark, d).withColumn("evidence", lines), ["n"]).select("n", F.col("ord").cast("long").alias("ord"), "evidence")


def prj14_search(spark, d):
    return C.references(spark, d).select(*KEY, H.search_url(F.col("reference"), H.Config(mailto="a b@c.org", rows=5)).alias("url"))


#: The remote service of the queries: an answer for each url, without a network.
def _service(url: str) -> tuple[int, str, float | None]:
    import re

    if doi := re.search(r"/works/10\.1000%2Fw(\d+)$", url):
        n = int(doi[1])
        if n % 5 == 0:
            return 404, "", None
        if n % 5 == 1:
            return 503, "", None
        return 200, "oops" if n % 5 == 2 else '{"message":{"DOI":"10.1000/W%d","title":["Nothing like it"]}}' % n, None
    no = int(re.search(r"bibliographic=%5B(\d+)%5D", url)[1])
    if no % 4 == 0:
        return 500, "", None
    return 200, '{"message":{"items":[%s]}}' % ("{}" if no % 8 == 4 else '{"publisher":"p"},{"title":"Nothing like it"}' if no % 3 else ""), None


def _quick() -> dict:
    return {"config": H.Config(min_interval_ms=0, retries=1, concurrency=4), "sleep": lambda s: None}


def src11_fetch(spark, d):
    urls = C.works(spark, d).select("n", H.doi_url(F.col("doi")).alias("url"))
    return H.fetch_json(urls, _service, **_quick()).select("n", "status", F.length("body").alias("size"), "error")


def scr02_remote(spark, d):
    a = O.audit_remote(C.references(spark, d), KEY, _service, **_quick())
    return a.select(*KEY, "doi", "confidence", "summary", F.array_join("recommendations", " ").alias("advice"), F.size("evidence").cast("long").alias("n_evidence"))


def src14_is_pdf(spark, d):
    name = F.concat(F.substring_index("url", "?", 1), F.when(F.col("page_id") % 3 == 0, ".PDF").otherwise(""))
    return table(spark, d, "pages").select("page_id", pdf.is_pdf(name, F.when(F.col("page_id") % 5 == 0, "application/pdf")).alias("is_pdf"))


def _checked(spark, d):
    level = F.element_at(F.array(*map(F.lit, R.LEVELS)), F.col("ref_no") % 3 + 1)
    return C.references(spark, d).select(*KEY, level.alias("confidence"), M.extract_doi(F.col("reference")).alias("doi"))


def src15_events(spark, d):
    lines = R.events(C.documents(spark, d), _checked(spark, d)).select("doc_id", "value")
    return R.parsed_events(lines).select("doc_id", "event", "index", "total", "confidence", "doi", "error")


def str05_windows(spark, d):
    ts = F.timestamp_seconds(F.lit(1_700_000_000) + F.col("doc_id") * 20 + F.col("ref_no"))
    stream = _checked(spark, d).select(F.lit("checked-reference").alias("event"), "confidence", ts.alias("ts"))
    return S.finished(stream).select(F.unix_timestamp("window.start").alias("started"), "confidence", "n")


def snk06_debug(spark, d):
    df = G.references_of(C.documents(spark, d), debug=True)
    return df.select("doc_id", F.get("debug", F.lit(0)).alias("first"), F.get("debug", F.lit(1)).alias("second"), F.exists("debug", lambda x: x == "using line-based extraction").alias("by_line"))


def snk07_errors(spark, d):
    return _numbers(spark, d).select("n", R.error_event(F.when(F.col("n") % 2 == 0, _join('No "pdf" ', F.col("n")))).alias("line"))


def seg05_fallback(spark, d):
    stop = F.when(F.col("n") % 3 == 0, "Appendixes of it\nhidden").when(F.col("n") % 3 == 1, "Abstract").otherwise("more of it")
    docs = C.works(spark, d).select("n", F.concat(F.lit("Bibliography\n"), "title", F.lit("\n"), "authors", F.lit("\n"), stop).alias("text"))
    return G.references_of(docs).select("n", "strategy", F.size("references").cast("long").alias("n_references"), F.get("references", F.lit(0)).alias("reference"))


_ALL = (lim01_first_hundred, lim03_authors, lim04_caps, md09_venues, sim03_fixed, agg10_reviewed, prj13_evidence, prj14_search, src11_fetch, scr02_remote, src14_is_pdf, src15_events, str05_windows, snk06_debug, snk07_errors, seg05_fallback)
QUERIES = {f.__name__: f for f in _ALL}

_SHOWN = WITH + "," + P.PAPERS_SQL
_LEVEL = "CASE ref_no % 3 WHEN 0 THEN 'high' WHEN 1 THEN 'medium' ELSE 'low' END"
_ACM = "CASE n % 4 WHEN 3 THEN NULL ELSE '10.1000/w' || n END"

SQL = {
    "lim01_first_hundred": _SHOWN + """, k AS (SELECT doc_id // 8 AS big_id, body, row_number() OVER (PARTITION BY doc_id // 8 ORDER BY doc_id, no) AS k FROM shown)
        SELECT big_id, least(100, count(*)) AS n_references, arg_max('[' || k || '] ' || body, k) FILTER (k <= 100) AS last FROM k GROUP BY big_id""",
    "lim03_authors": WITH + """, a AS (SELECT n, unnest(range(n % 13 + 1)) AS i FROM works)
        SELECT n, string_agg('G' || i || CASE WHEN i = 3 THEN '' ELSE ' Ink' END, ', ' ORDER BY i) FILTER (i < 8) AS authors FROM a GROUP BY n""",
    "lim04_caps": WITH + " SELECT n, substr(rtrim(repeat('Quill Ink, ', CAST(n % 40 + 1 AS INTEGER)), ', '), 1, 240) AS authors, substr(repeat('word; ', CAST(n % 50 + 1 AS INTEGER)) || 'end', 1, 160) AS title FROM works",
    "md09_venues": WITH + """ SELECT n, 'A title of rings' AS title, CASE n % 4 WHEN 0 THEN 'Proceedings of the ' || n || 'th Meeting on Rings' WHEN 1 THEN 'IEEE Letters on Rings ' || n WHEN 2 THEN 'Some wiley notes ' || n ELSE 'Rings Quarterly' END AS venue,
          CASE n % 4 WHEN 3 THEN CAST(n AS VARCHAR) ELSE '' END AS volume, CASE n % 4 WHEN 3 THEN CAST(n % 5 AS VARCHAR) ELSE '' END AS issue, CASE n % 4 WHEN 3 THEN 'Article ' || n % 9 || ', 9 pages' ELSE '10-1' || n % 10 END AS pages FROM works""",
    "sim03_fixed": WITH + " SELECT n, CASE n % 1001 WHEN 125 THEN '0.13' WHEN 625 THEN '0.63' ELSE printf('%.2f', (n % 1001) / 1000.0::DOUBLE) END AS shown FROM works",
    "agg10_reviewed": RANKED + " SELECT doc_id, ref_no, n_cand AS n_candidates FROM ranked WHERE rank = 1",
    "prj13_evidence": WITH + """ SELECT n, 1::BIGINT AS ord, CASE WHEN n % 3 = 0 THEN 'None' ELSE 'a &lt; b &amp; ' || n END AS evidence FROM works UNION ALL SELECT n, 2, '&quot;c&quot; &gt; &#039;d&#039;' FROM works WHERE n % 3 = 2""",
    "prj14_search": WITH + " SELECT doc_id, ref_no, 'https://api.crossref.org/works?rows=5&query.bibliographic=' || replace(url_encode(reference), '%20', '+') || '&mailto=a+b%40c.org' AS url FROM refs",
    "src11_fetch": WITH + """ SELECT n, CAST(CASE n % 5 WHEN 0 THEN 404 WHEN 1 THEN 503 ELSE 200 END AS INTEGER) AS status, CAST(CASE n % 5 WHEN 2 THEN 4 WHEN 3 THEN len('{"message":{"DOI":"10.1000/W","title":["Nothing like it"]}}' || n) WHEN 4 THEN len('{"message":{"DOI":"10.1000/W","title":["Nothing like it"]}}' || n) END AS INTEGER) AS size,
          CASE n % 5 WHEN 0 THEN 'Remote request failed with status 404' WHEN 1 THEN 'Remote request failed with status 503' END AS error FROM works""",
    "scr02_remote": WITH + f""", s AS (SELECT *, {_ACM} AS d, CASE WHEN n % 4 <> 3 THEN CASE n % 5 WHEN 0 THEN 'Remote request failed with status 404' WHEN 1 THEN 'Remote request failed with status 503' WHEN 2 THEN 'Remote answer is not JSON' END
          WHEN ref_no % 4 = 0 THEN 'Remote request failed with status 500' END AS e FROM refs)
        SELECT doc_id, ref_no, d AS doi, CASE WHEN d IS NOT NULL AND e IS NOT NULL AND n % 5 > 0 THEN 'medium' ELSE 'low' END AS confidence,
          CASE WHEN d IS NOT NULL AND e IS NOT NULL THEN 'DOI ' || d || ' was detected, but the Crossref lookup failed: ' || e || '.' WHEN e IS NOT NULL THEN 'No DOI was detected and Crossref candidate search failed: ' || e || '.'
            WHEN d IS NOT NULL THEN 'DOI resolved in Crossref: Nothing like it DOI ' || d || '.' WHEN ref_no % 3 > 0 THEN 'No DOI was present in the citation. Best Crossref candidate: Nothing like it.'
            ELSE 'No DOI detected. Best-effort verification will rely on author/title/journal matching.' END AS summary,
          CASE WHEN d IS NOT NULL AND e IS NOT NULL THEN 'Check the DOI manually and confirm the citation fields against the authoritative record.' WHEN e IS NOT NULL THEN 'Add a DOI or a stable URL and verify title, author, and venue details manually.'
            WHEN d IS NOT NULL THEN 'Confirm that the author list, title, and venue exactly match the source metadata. The metadata overlap was weak, so this reference should be reviewed manually.'
            WHEN ref_no % 3 > 0 THEN 'Add an explicit DOI or stable URL if available and verify the reference metadata. The title/author/venue/year overlap was weak, so this reference should be reviewed manually.'
            ELSE 'Consider adding a DOI or a stable URL for the cited work.' END AS advice,
          CASE WHEN e IS NOT NULL THEN 1::BIGINT WHEN d IS NOT NULL THEN 9 WHEN ref_no % 3 > 0 THEN 9 ELSE 0 END AS n_evidence FROM s""",
    "src14_is_pdf": "SELECT page_id, page_id % 5 = 0 OR page_id % 3 = 0 OR lower(split_part(url, '?', 1)) LIKE '%.pdf' AS is_pdf FROM pages",
    "src15_events": WITH + f""", t AS (SELECT doc_id, CAST(count(*) AS INTEGER) AS total FROM refs GROUP BY doc_id)
        SELECT doc_id, e AS event, NULL::INTEGER AS index, total, NULL::VARCHAR AS confidence, NULL::VARCHAR AS doi, NULL::VARCHAR AS error FROM t, (VALUES ('references-found'), ('complete')) v(e)
        UNION ALL SELECT doc_id, 'checking-reference', ref_no, total, NULL, NULL, NULL FROM refs JOIN t USING (doc_id)
        UNION ALL SELECT doc_id, 'checked-reference', ref_no, total, {_LEVEL}, {_ACM}, NULL FROM refs JOIN t USING (doc_id)""",
    "str05_windows": WITH + f" SELECT (1700000000 + doc_id * 20 + ref_no) // 60 * 60 AS started, {_LEVEL} AS confidence, count(*) AS n FROM refs GROUP BY ALL",
    "snk06_debug": _SHOWN + """, b AS (SELECT doc_id, sum(len('[' || no || '] ' || body)) + count(*) - 1 AS size FROM shown GROUP BY doc_id)
        SELECT doc_id, 'raw section length: ' || CAST(size AS BIGINT) AS first, 'reference heading index: 2' AS second, true AS by_line FROM b""",
    "snk07_errors": WITH + """ SELECT n, '{"event":"error","error":"' || CASE WHEN n % 2 = 0 THEN 'No \\"pdf\\" ' || n ELSE 'unknown error' END || '"}' AS line FROM works""",
    "seg05_fallback": WITH + " SELECT n, 'fallback' AS strategy, 1::BIGINT AS n_references, title || ' ' || authors || CASE WHEN n % 3 = 2 THEN ' more of it' ELSE '' END AS reference FROM works",
}
