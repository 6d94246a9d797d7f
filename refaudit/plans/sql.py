"""SQL twins of the named queries for DuckDB, written from what each should return, not from how it is computed."""

from __future__ import annotations

from ..sources.corpus import CORPUS_SQL

WITH = "WITH " + CORPUS_SQL


def _tokens(x: str) -> str:
    return f"list_filter(string_split(regexp_replace(lower({x}), '[^a-z0-9]+', ' ', 'g'), ' '), lambda e: e <> '')"


def _set(x: str) -> str:
    return f"list_distinct({_tokens(x)})"


def _dice(a: str, b: str) -> str:
    return f"CASE WHEN len({a}) = 0 OR len({b}) = 0 THEN 0.0::DOUBLE ELSE 2.0::DOUBLE * len(list_intersect({a}, {b})) / (len({a}) + len({b})) END"


_TRIM = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
#: References taken apart by the style they were written in.
_PARTS = """,
parts AS (
  SELECT doc_id, ref_no, n, reference, CAST(regexp_extract(reference, '\\b(?:19|20)\\d{2}\\b') AS INTEGER) AS ref_year,
    lower(nullif(rtrim(regexp_extract(reference, '10\\.\\d{4,9}/[-._;()/:A-Za-z0-9]+'), '.,;:'), '')) AS ref_doi,
    CASE n % 4 WHEN 1 THEN regexp_extract(reference, '^(.*?) \\(', 1) WHEN 2 THEN regexp_extract(reference, '\\] (.*?), "', 1) ELSE regexp_extract(reference, '\\] (.*?)\\. \\d{4}\\.', 1) END AS authors,
    CASE n % 4 WHEN 1 THEN regexp_extract(reference, '\\)\\. ([^.]+)\\.', 1) WHEN 2 THEN regexp_extract(reference, '"([^"]+),"', 1) ELSE regexp_extract(reference, '\\. \\d{4}\\. ([^.]+)\\.', 1) END AS title,
    regexp_extract(reference, 'Journal of [a-z]+') AS venue,
    CASE n % 4 WHEN 2 THEN regexp_extract(reference, 'vol\\. (\\d+)', 1) ELSE regexp_extract(reference, 'Journal of [a-z]+ (\\d+), ', 1) END AS volume,
    CASE n % 4 WHEN 2 THEN regexp_extract(reference, 'no\\. (\\d+)', 1) ELSE regexp_extract(reference, 'Journal of [a-z]+ \\d+, (\\d+)', 1) END AS issue,
    CASE n % 4 WHEN 2 THEN regexp_extract(reference, 'pp\\. ([0-9-]+)', 1) ELSE regexp_extract(reference, '\\), (\\d+-\\d+)\\.', 1) END AS pages
  FROM refs)"""
_BASE = WITH + _PARTS


def _score(pairs: str) -> str:
    """CTEs scoring `pairs`: rows of parts with the work's fields as w_<field>."""
    return f""",
sets AS (
  SELECT *, {_set("reference")} AS rt, {_set("title")} AS tt, {_set("w_title")} AS wt, {_set("w_authors")} AS wa, {_set("w_container")} AS wc FROM ({pairs})),
dices AS (
  SELECT *, greatest({_dice("tt", "wt")}, {_dice("rt", "wt")}) AS ts, {_dice("rt", "wa")} AS aus, {_dice("rt", "wc")} AS vs, abs(w_year - ref_year) AS off,
    coalesce(ref_doi = w_doi, false) AS dm, volume = w_volume AS vm, issue = w_issue AS im, pages = w_pages AS pm FROM sets),
scores AS (
  SELECT *, greatest(0.0::DOUBLE, least(1.0::DOUBLE, ts * 0.5::DOUBLE + aus * 0.2::DOUBLE + (off = 0)::INT * 0.15::DOUBLE + vs * 0.1::DOUBLE + dm::INT * 0.2::DOUBLE + (vm::INT + im::INT + pm::INT) * 0.03::DOUBLE
      - CASE WHEN off > 1 THEN 0.35::DOUBLE WHEN off = 1 THEN 0.15::DOUBLE ELSE 0.0::DOUBLE END - CASE WHEN ts < 0.25 THEN 0.15::DOUBLE ELSE 0.0::DOUBLE END)) AS score FROM dices),
matched AS (
  SELECT *, CASE WHEN off > 1 AND NOT dm THEN 'low' WHEN score >= 0.75 AND ts >= 0.45 THEN CASE WHEN dm OR aus > 0 OR vm OR im OR pm THEN 'high' WHEN ts >= 0.75 THEN 'medium' ELSE 'low' END
      WHEN score >= 0.4 AND ts >= 0.25 THEN CASE WHEN dm OR aus > 0 OR vm OR im OR pm OR ts >= 0.75 THEN 'medium' ELSE 'low' END ELSE 'low' END AS confidence FROM scores)"""


_W = "w.title AS w_title, w.authors AS w_authors, w.container AS w_container, w.year AS w_year, w.doi AS w_doi, w.volume AS w_volume, w.issue AS w_issue, w.pages AS w_pages"
_BY_DOI = _BASE + _score(f"SELECT p.*, {_W} FROM parts p JOIN works w ON p.ref_doi = w.doi")
#: Every token counts, however many works hold it; numbers stand for works, references and tokens while pairs are counted.
_CANDIDATES = _BASE + f""",
post AS (SELECT n AS w, doi, len(s) AS size, unnest(s) AS token FROM (SELECT n, doi, {_set("concat_ws(' ', title, authors, container, CAST(year AS VARCHAR))")} AS s FROM works)),
ids AS (SELECT token, CAST(row_number() OVER () AS INTEGER) AS t FROM (SELECT DISTINCT token FROM post)),
asked AS (SELECT CAST(doc_id * 100 + ref_no AS INTEGER) AS r, t FROM (SELECT doc_id, ref_no, unnest({_set("reference")}) AS token FROM parts WHERE ref_doi IS NULL) JOIN ids USING (token)),
held AS (SELECT CAST(w AS INTEGER) AS w, t FROM post JOIN ids USING (token)),
pairs AS (SELECT r, w, count(*) AS shared FROM asked JOIN held USING (t) GROUP BY ALL),
most AS (SELECT r, min(shared) AS least FROM (SELECT r, unnest(max(shared, 8)) AS shared FROM pairs GROUP BY r) GROUP BY r),
hits AS (SELECT r // 100 AS doc_id, CAST(r % 100 AS INTEGER) AS ref_no, p.shared, i.doi, i.size
  FROM pairs p JOIN most USING (r) JOIN (SELECT DISTINCT w, doi, size FROM post) i USING (w) WHERE p.shared >= least),
top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, ref_no ORDER BY shared DESC, size, doi) AS ord FROM hits) WHERE ord <= 8)"""
RANKED = _CANDIDATES + _score(f"SELECT p.*, t.ord, {_W} FROM parts p JOIN top t USING (doc_id, ref_no) JOIN works w ON t.doi = w.doi") + """,
ranked AS (SELECT *, row_number() OVER o AS rank, lead(score) OVER o AS next_score, count(*) OVER (PARTITION BY doc_id, ref_no) AS n_cand FROM matched WINDOW o AS (PARTITION BY doc_id, ref_no ORDER BY score DESC, ord))"""
_AUDIT = RANKED.replace("SELECT p.*, t.ord, ", "SELECT p.*, t.ord, ").replace(
    "FROM parts p JOIN top t USING (doc_id, ref_no) JOIN works w ON t.doi = w.doi",
    "FROM parts p JOIN (SELECT doc_id, ref_no, ord, doi FROM top UNION ALL SELECT doc_id, ref_no, 1, ref_doi FROM parts WHERE ref_doi IS NOT NULL) t USING (doc_id, ref_no) JOIN works w ON t.doi = w.doi",
) + """,
audit AS (
  SELECT doc_id, ref_no, reference, CASE WHEN reference LIKE '%doi:%' OR reference LIKE '%https://doi.org/%' THEN 'doi' ELSE 'article' END AS type, w_doi AS doi,
    CASE WHEN ref_doi IS NULL AND confidence = 'high' THEN 'medium' ELSE confidence END AS confidence, ref_doi, w_title, w_authors, w_container, w_year, w_volume, w_issue, w_pages, authors, title, venue, volume, issue, pages, ref_year, n_cand,
    score - next_score < 0.12 AS close FROM ranked WHERE rank = 1),
texts AS (SELECT *, w_title || ' (' || w_year || ') DOI ' || doi AS described FROM audit)"""
_DOCS = """,
lined AS (SELECT doc_id, ref_no, CASE WHEN reference LIKE '[%' THEN reference ELSE '[' || ref_no || '] ' || reference END AS line FROM refs)"""
_BLOCKS = """
b AS (SELECT DISTINCT ON (l_orderkey, l_linenumber, l_partkey, l_extendedprice) CAST(l_orderkey % 97 AS VARCHAR) AS doc_id, CAST(l_orderkey // 97 AS INTEGER) AS page_no, l_orderkey * 1000000 + l_linenumber * 100000 + l_partkey AS block_no,
  CASE WHEN l_linenumber % 2 = 0 THEN 320.0::DOUBLE ELSE 50.0::DOUBLE END AS x0, l_quantity * 16 AS y0 FROM lineitem),
marked AS (SELECT * FROM b WHERE y0 <= 800 * 0.94::DOUBLE),
col AS (SELECT *, CASE WHEN max(x0) OVER p - min(x0) OVER p >= 120 AND x0 >= 185 THEN 1 ELSE 0 END AS col_no FROM marked WINDOW p AS (PARTITION BY doc_id, page_no))"""

SQL: dict[str, str] = {
    "txt01_normalize": r"SELECT doc_id, trim(regexp_replace(text, '[\t\n\x0B\f\r \x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]+', ' ', 'g')) AS normalized FROM documents",
    "txt02_clean": rf"SELECT doc_id, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(replace(text, chr(13), ''), '([a-zA-Z])\n([a-zA-Z])\n', '\1 \2 ', 'g'), '([a-zA-Z])\n([a-zA-Z])', '\1 \2', 'g'), '\n{{2,}}', chr(10), 'g'), '[ \t]+', ' ', 'g'), {_TRIM}) AS cleaned FROM documents",
    "txt03_strip_headers": WITH + _DOCS + " SELECT doc_id, string_agg(line, chr(10) ORDER BY ref_no) AS body FROM lined GROUP BY doc_id",
    "txt04_interleave": rf"""
        WITH p AS (SELECT doc_id, unnest(string_split_regex(text, '\n{{2,}}')) AS para, generate_subscripts(string_split_regex(text, '\n{{2,}}'), 1) AS pi FROM documents),
        l AS (SELECT doc_id, pi, unnest(ls) AS line, generate_subscripts(ls, 1) AS li, len(ls) AS n FROM (SELECT doc_id, pi, list_filter(list_transform(string_split(replace(para, chr(13) || chr(10), chr(10)), chr(10)), lambda x: trim(x, {_TRIM})), lambda x: x <> '') AS ls FROM p)),
        o AS (SELECT *, CAST(ceil(n / 2.0) AS BIGINT) AS h FROM l),
        q AS (SELECT doc_id, pi, string_agg(line, ' ' ORDER BY CASE WHEN n <= 2 THEN li WHEN li <= h THEN 2 * li - 1 ELSE 2 * (li - h) END) AS para FROM o GROUP BY doc_id, pi)
        SELECT d.doc_id, coalesce(string_agg(para, chr(10) || chr(10) ORDER BY pi), '') AS reordered FROM documents d LEFT JOIN q USING (doc_id) GROUP BY d.doc_id""",
    "txt08_tokens": f"SELECT doc_id, len(t) AS n_tokens, array_to_string(t, ' ') AS tokens FROM (SELECT doc_id, {_tokens('text')} AS t FROM documents)",
    "agg02_lengths": "SELECT doc_id, CAST(length(text) + len(list_filter(string_split(text, ''), lambda c: unicode(c) > 65535)) AS BIGINT) AS utf16_units FROM documents",
    "agg08_distinct_tokens": f"SELECT doc_id, len({_set('text')}) AS n_distinct FROM documents",
    "sim01_dice": f"""SELECT doc_id, item_id, round({_dice("a", "b")}, 6) AS dice FROM (SELECT doc_id, {_set("text")} AS a FROM documents) JOIN (SELECT item_id, {_set("text")} AS b FROM benchmark)
        ON item_id = doc_id % (SELECT count(*) FROM benchmark)""",
    "sim02_labels": f"""WITH s AS (SELECT {_dice("a", "b")} AS x FROM (SELECT doc_id, {_set("text")} AS a FROM documents) JOIN (SELECT item_id, {_set("text")} AS b FROM benchmark) ON item_id = doc_id % (SELECT count(*) FROM benchmark))
        SELECT CASE WHEN x >= 0.8 THEN 'strong' WHEN x >= 0.45 THEN 'medium' WHEN x > 0 THEN 'weak' ELSE 'none' END AS label, count(*) AS n FROM s GROUP BY 1""",
    "flt01_looks_like": WITH + " SELECT doc_id, count(*) >= 3 AS looks FROM refs GROUP BY doc_id",
    "prj12_escape": """SELECT page_id, replace(replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#039;') AS escaped FROM pages""",
    "win01_islands": rf"""
        WITH l AS (SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS i FROM (SELECT doc_id, list_transform(string_split(text, chr(10)), lambda x: trim(x, {_TRIM})) AS ls FROM documents)),
        s AS (SELECT *, regexp_matches(line, '^(?:\[\d{{1,3}}\]|[1-9]\d{{0,2}}[.)])\s') OR coalesce(lag(line) OVER w = '', true) AS starts FROM l WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
        g AS (SELECT *, sum(starts::INT) OVER (PARTITION BY doc_id ORDER BY i) AS grp FROM s),
        t AS (SELECT doc_id, grp, string_agg(line, ' ' ORDER BY i) AS island FROM g WHERE line <> '' GROUP BY doc_id, grp)
        SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY grp) AS n, island FROM t""",
    "seg01_strategy": WITH + " SELECT doc_id, CASE WHEN count(*) > 1 THEN 'line' ELSE 'inline' END AS strategy, count(*) AS n_references FROM refs GROUP BY doc_id",
    "seg02_references": WITH + _DOCS + " SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY ref_no) AS ref_no, CASE WHEN count(*) OVER (PARTITION BY doc_id) > 1 THEN line WHEN strpos(line, '10.1000') > 0 THEN regexp_extract(line, '^.*?10\\.1000/[-._;()/:A-Za-z0-9]+') ELSE line END AS reference FROM lined",
    "seg03_author_date": WITH + """, a AS (SELECT doc_id, reference, row_number() OVER w AS k, count(*) OVER (PARTITION BY doc_id) AS n FROM refs WHERE reference NOT LIKE '[%' WINDOW w AS (PARTITION BY doc_id ORDER BY ref_no))
        SELECT doc_id, k AS ref_no, reference || CASE WHEN k < n THEN ' and more' ELSE '' END AS reference FROM a""",
    "seg04_inline": WITH + _DOCS + r""", one AS (SELECT doc_id, string_agg(line, ' ' ORDER BY ref_no) AS body FROM lined GROUP BY doc_id),
        pieces AS (SELECT doc_id, string_split(regexp_replace('see ' || body, '(\s)((?:\[\d{1,3}\]|[1-9]\d{0,2}[.)])\s+[A-Za-z"''“])', '\1' || chr(1) || '\2', 'g'), chr(1)) AS ps FROM one),
        flat AS (SELECT doc_id, unnest(ps[2:]) AS piece, generate_subscripts(ps[2:], 1) AS ref_no FROM pieces)
        SELECT doc_id, ref_no, CASE WHEN strpos(piece, '10.1000') > 0 THEN regexp_extract(piece, '^.*?10\.1000/[-._;()/:A-Za-z0-9]+') ELSE trim(piece) END AS reference FROM flat WHERE ref_no <= 100""",
    "flt08_bands": "WITH " + _BLOCKS.split("marked AS")[0].rstrip().rstrip(",") + " SELECT doc_id, page_no, block_no, y0 FROM b WHERE y0 >= 80 AND y0 <= 800 * 0.94::DOUBLE",
    "seg06_columns": "WITH " + _BLOCKS + " SELECT doc_id, page_no, block_no, col_no FROM col",
    "agg06_gap": "WITH " + _BLOCKS + """, g AS (SELECT doc_id, page_no, lead(y0) OVER w - y0 AS gap, row_number() OVER w - 1 AS place FROM marked WINDOW w AS (PARTITION BY doc_id, page_no ORDER BY y0)),
        r AS (SELECT *, row_number() OVER (PARTITION BY doc_id, page_no ORDER BY gap DESC, place DESC) AS k FROM g WHERE gap IS NOT NULL) SELECT doc_id, page_no, gap, place FROM r WHERE k = 1""",
    "srt01_reading_order": "WITH " + _BLOCKS + " SELECT doc_id, page_no, row_number() OVER (PARTITION BY doc_id, page_no ORDER BY col_no, y0, x0, block_no) AS pos, col_no, y0 FROM col",
    "agg05_coverage": "SELECT l_orderkey AS doc_id, count(*) >= 3 AND count(DISTINCT l_linenumber) = count(*) AND count(*) / (max(l_linenumber) - min(l_linenumber) + 1.0) >= 0.8 AS is_full FROM lineitem GROUP BY l_orderkey",
    "srt02_sort": """WITH f AS (SELECT l_orderkey AS doc_id, count(*) >= 3 AND count(DISTINCT l_linenumber) = count(*) AND count(*) / (max(l_linenumber) - min(l_linenumber) + 1.0) >= 0.8 AS is_full FROM lineitem GROUP BY l_orderkey)
        SELECT doc_id, string_agg('[' || l_linenumber || '] part ' || l_partkey, chr(10) ORDER BY CASE WHEN is_full THEN l_linenumber ELSE 0 END, l_partkey, '[' || l_linenumber || '] part ' || l_partkey) AS sorted FROM lineitem JOIN f ON doc_id = l_orderkey GROUP BY doc_id""",
    "agg04_style": WITH + " SELECT doc_id, CASE WHEN count(*) FILTER (reference LIKE '[%') >= 2 THEN 'bracket' ELSE 'any' END AS style FROM refs GROUP BY doc_id",
    "md01_doi": _BASE + " SELECT doc_id, ref_no, ref_doi AS doi FROM parts",
    "md03_year": _BASE + " SELECT doc_id, ref_no, ref_year AS year FROM parts",
    "md04_title": _BASE + " SELECT doc_id, ref_no, title FROM parts",
    "md05_authors": _BASE + " SELECT doc_id, ref_no, authors FROM parts",
    "md08_publication": _BASE + " SELECT doc_id, ref_no, venue, volume, issue, pages FROM parts",
    "md10_page_range": WITH + " SELECT doi, pages FROM works",
    "md12_last_range": WITH + r" SELECT doc_id, ref_no, regexp_extract(reference, '.*\b(\d+-\d+)\b', 1) AS pages FROM refs",
    "md13_cleaned": WITH + r""" SELECT doc_id, ref_no, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(reference, '^\[\d+\] ', ''), 'doi: ?10\.1000/[-._;()/:A-Za-z0-9]+', ''), '10\.1000/[-._;()/:A-Za-z0-9]+', ''), 'https?://\S+', ''), ' +', ' ', 'g')) AS cleaned FROM refs""",
    "prj06_type": WITH + " SELECT doc_id, ref_no, CASE n % 4 WHEN 3 THEN 'article' ELSE 'doi' END AS type FROM refs",
    "rec01_year": WITH + " SELECT n, CASE WHEN n % 3 < 2 THEN year END AS year FROM works",
    "rec02_normalize": WITH + """ SELECT n, doi, title, replace(authors, '  ', ' ') || ', The Group' AS authors, container AS containerTitle, volume, '' AS issue, pages, 1.5::DOUBLE AS crossrefScore FROM works""",
    "prj08_describe": WITH + " SELECT n, title || ' (' || year || ') DOI ' || doi AS description FROM works",
    "j01_doi_join": WITH + " SELECT r.doc_id, r.ref_no, w.title, w.year FROM refs r JOIN works w USING (n) WHERE n % 4 <> 3",
    "j02_candidates": _CANDIDATES + " SELECT doc_id, ref_no, ord, doi FROM top",
    "scr01_score": _BY_DOI + " SELECT doc_id, ref_no, round(score, 6) AS score, round(ts, 6) AS title_score, round(aus, 6) AS author_score, round(vs, 6) AS venue_score FROM matched",
    "scr01_confidence": _BY_DOI + " SELECT doc_id, ref_no, confidence, off = 0 AS year_matched, off > 1 AS severe, vm AS volume_matched, pm AS pages_matched FROM matched",
    "scr01_evidence": _BY_DOI + """, l AS (SELECT *, lambda_label(ts) AS lt, lambda_label(aus) AS la, lambda_label(vs) AS lv FROM matched)
        SELECT doc_id, ref_no, 'Title overlap: ' || lt || '; Author overlap: ' || la || '; Venue overlap: ' || lv || '; ' || CASE WHEN off = 0 THEN 'Year matched: ' || w_year ELSE 'Year mismatch: cited ' || ref_year || ', candidate ' || w_year END
          || '; Volume ' || CASE WHEN vm THEN 'matched: ' || w_volume ELSE 'mismatch: cited ' || volume || ', candidate ' || w_volume END || '; Issue ' || CASE WHEN im THEN 'matched: ' || w_issue ELSE 'mismatch: cited ' || issue || ', candidate ' || w_issue END
          || '; Pages ' || CASE WHEN pm THEN 'matched: ' || w_pages ELSE 'mismatch: cited ' || pages || ', candidate ' || w_pages END || '; DOI exactly matched' AS evidence FROM l""",
    "win07_rank": RANKED + " SELECT doc_id, ref_no, rank, w_doi AS doi, round(score, 6) AS score FROM ranked",
    "win08_gap": RANKED + " SELECT doc_id, ref_no, round(score - next_score, 6) AS gap, score - next_score < 0.12::DOUBLE AS close FROM ranked WHERE rank = 1",
    "scr02_audit": _AUDIT + """ SELECT doc_id, ref_no, type, doi, confidence, CASE WHEN ref_doi IS NULL THEN 'No DOI was present in the citation. Best Crossref candidate: ' ELSE 'DOI resolved in Crossref: ' END || described || '.' AS summary,
        1 + CAST(confidence = 'low' AS BIGINT) + CAST(ref_doi IS NULL AND coalesce(close, false) AS BIGINT) AS n_recommendations,
        CASE WHEN ref_doi IS NULL THEN 11 + CAST(n_cand > 1 AS BIGINT) ELSE 11 END AS n_evidence, w_title AS matched_title FROM texts""",
    "agg01_summary": _AUDIT + """, lv AS (SELECT * FROM (VALUES ('HIGH', 'high'), ('MEDIUM', 'medium'), ('LOW', 'low')) v(level, c)),
        d AS (SELECT DISTINCT doc_id FROM audit) SELECT d.doc_id, level, count(a.ref_no) AS n, coalesce(string_agg('Ref ' || ref_no, ', ' ORDER BY ref_no), 'None') AS refs
        FROM d CROSS JOIN lv LEFT JOIN audit a ON a.doc_id = d.doc_id AND a.confidence = lv.c GROUP BY d.doc_id, level""",
    "prj10_comparison": _AUDIT + """, u AS (SELECT doc_id, ref_no, unnest([
          {'ord': 1::BIGINT, 'field': 'Authors', 'e': authors, 'm': w_authors}, {'ord': 2, 'field': 'Date', 'e': CAST(ref_year AS VARCHAR), 'm': CAST(w_year AS VARCHAR)}, {'ord': 3, 'field': 'Title of work', 'e': title, 'm': w_title},
          {'ord': 4, 'field': 'Publication venue', 'e': venue, 'm': w_container}, {'ord': 5, 'field': 'Volume', 'e': volume, 'm': w_volume}, {'ord': 6, 'field': 'Issue', 'e': issue, 'm': w_issue}, {'ord': 7, 'field': 'Pages', 'e': pages, 'm': w_pages}]) AS r FROM audit)
        SELECT doc_id, ref_no, r.ord AS ord, r.field AS field, coalesce(nullif(r.e, ''), 'Not found') AS extracted, coalesce(nullif(r.m, ''), 'Not found') AS matched FROM u""",
    "prj11_links": _BASE + " SELECT doc_id, ref_no, coalesce('https://doi.org/' || ref_doi, 'None') AS link FROM parts",
    "snk02_response": WITH + _DOCS + """, b AS (SELECT doc_id, string_agg(line, chr(10) ORDER BY ref_no) AS body FROM lined GROUP BY doc_id)
        SELECT doc_id, 'paper-' || doc_id || '.pdf' AS filename, CAST(length(any_value(body)) AS BIGINT) AS totalCharacters, count(*) AS referencesFound, arg_min(reference, ref_no) AS first_reference, true AS no_debug FROM b JOIN refs USING (doc_id) GROUP BY doc_id""",
    "str01_events": _AUDIT + """, t AS (SELECT doc_id, count(*) AS total FROM audit GROUP BY doc_id)
        SELECT doc_id, 0::BIGINT AS seq, 'references-found' AS event, '{"event":"references-found","total":' || total || '}' AS value FROM t
        UNION ALL SELECT doc_id, 2 * total + 1, 'complete', '{"event":"complete","total":' || total || '}' FROM t
        UNION ALL SELECT doc_id, 2 * ref_no - 1, 'checking-reference', '{"event":"checking-reference","index":' || ref_no || ',"total":' || total || '}' FROM audit JOIN t USING (doc_id)
        UNION ALL SELECT doc_id, 2 * ref_no, 'checked-reference', '{"event":"checked-reference","index":' || ref_no || ',"total":' || total || ',"confidence":"' || confidence || '","doi":"' || doi || '"}' FROM audit JOIN t USING (doc_id)""",
    "str03_backoff": """SELECT CAST(a.a AS INTEGER) AS attempt, CAST(s.s AS INTEGER) AS status, r.r AS retry_after, CASE WHEN r.r = '7' THEN 7000 WHEN s.s = 429 THEN 10000 * 2 ** a.a ELSE 400 * 2 ** a.a END::BIGINT AS delay_ms, s.s IN (408, 429) OR s.s >= 500 AS retriable
        FROM range(4) a(a), (VALUES (408), (429), (500), (503)) s(s), (VALUES (NULL), ('7'), ('soon')) r(r)""",
    "prj14_urls": WITH + " SELECT n, 'https://api.crossref.org/works/10.1000%2Fw' || n || '(a%20b)' AS url FROM works",
    "src16_engine": "SELECT true AS ok, 'refaudit-0.1.0' AS engineVersion",
}
SQL["scr01_evidence"] = SQL["scr01_evidence"].replace("lambda_label(ts)", "CASE WHEN ts >= 0.8 THEN 'strong' WHEN ts >= 0.45 THEN 'medium' WHEN ts > 0 THEN 'weak' ELSE 'none' END").replace("lambda_label(aus)", "CASE WHEN aus >= 0.8 THEN 'strong' WHEN aus >= 0.45 THEN 'medium' WHEN aus > 0 THEN 'weak' ELSE 'none' END").replace("lambda_label(vs)", "CASE WHEN vs >= 0.8 THEN 'strong' WHEN vs >= 0.45 THEN 'medium' WHEN vs > 0 THEN 'weak' ELSE 'none' END")
