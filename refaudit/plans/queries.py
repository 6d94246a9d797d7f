"""The named queries: each runs operators of this library over whole tables. Their SQL twins are in `sql`."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import metadata as M
from ..functions import text as T
from ..operators import audit as A
from ..operators import layout as L
from ..operators import match as J
from ..operators import report as R
from ..operators import segment as G
from ..sources import corpus as C
from ..sources import lookup as H
from ..sources import works as W
from ..tables import in_slices, swept, written

KEY = ["doc_id", "ref_no"]
FIELDS = W.CANDIDATE


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _docs(spark, d):
    return table(spark, d, "documents").select("doc_id", "text")


def _works(spark, d):
    return C.works(spark, d).select(*FIELDS)


def _six(c: Column) -> Column:
    return F.round(c, 6)


# Text

def txt01_normalize(spark, d):
    return _docs(spark, d).select("doc_id", T.normalize_text(F.col("text")).alias("normalized"))


def txt02_clean(spark, d):
    return _docs(spark, d).select("doc_id", T.clean_extracted(F.col("text")).alias("cleaned"))


def txt03_strip_headers(spark, d):
    return C.documents(spark, d).select("doc_id", T.strip_headers(F.col("text")).alias("body"))


def txt04_interleave(spark, d):
    return _docs(spark, d).select("doc_id", T.interleave_columns(F.col("text")).alias("reordered"))


def txt08_tokens(spark, d):
    return _docs(spark, d).select("doc_id", T.tokens(F.col("text")).alias("t")).select("doc_id", F.size("t").cast("long").alias("n_tokens"), F.array_join("t", " ").alias("tokens"))


def agg02_lengths(spark, d):
    return _docs(spark, d).select("doc_id", T.utf16_length(F.col("text")).alias("utf16_units"))


def agg08_distinct_tokens(spark, d):
    return _docs(spark, d).select("doc_id", F.size(T.token_set(F.col("text"))).cast("long").alias("n_distinct"))


def sim01_dice(spark, d):
    """One pairing per document, as the SQL twin has it, not documents times items: the document with remainder k takes the item
    at place k by item_id. Without an item (no doc_id, or no items) the document stays, with a null item_id and dice 0."""
    b = table(spark, d, "benchmark").select("item_id", T.token_set(F.col("text")).alias("b"))
    n = b.count()
    b = b.withColumn("_place", F.row_number().over(Window.orderBy("item_id")) - 1)
    docs = _docs(spark, d).select("doc_id", T.token_set(F.col("text")).alias("a"), F.pmod("doc_id", F.lit(max(n, 1))).alias("k"))
    empty = F.array().cast("array<string>")
    return docs.join(b, F.col("k") == F.col("_place"), "left").select("doc_id", "item_id", _six(T.dice(F.col("a"), F.coalesce("b", empty))).alias("dice"))


def sim02_labels(spark, d):
    return sim01_dice(spark, d).groupBy(T.score_label(F.col("dice")).alias("label")).agg(F.count("*").alias("n"))


def flt01_looks_like(spark, d):
    return C.documents(spark, d).select("doc_id", T.looks_like_references(F.col("text")).alias("looks"))


def prj12_escape(spark, d):
    return table(spark, d, "pages").select("page_id", T.html_escape(F.col("html")).alias("escaped"))


# Segmentation

def win01_islands(spark, d):
    lines = F.transform(F.split("text", "\n"), T.trimmed)
    g = _docs(spark, d).select("doc_id", F.posexplode(G.marked(lines)).alias("i", "island"))
    return g.select("doc_id", (F.col("i") + 1).cast("long").alias("n"), "island")


def seg02_references(spark, d):
    return G.exploded(G.references_of(C.documents(spark, d)), ["doc_id"]).select("doc_id", F.col("ref_no").cast("long").alias("ref_no"), "reference")


def seg01_strategy(spark, d):
    return G.references_of(C.documents(spark, d)).select("doc_id", "strategy", F.size("references").cast("long").alias("n_references"))


def _one_line(spark, d):
    """Documents whose references stand on one line."""
    return C.documents(spark, d).withColumn("text", F.concat(F.lit("Intro\nReferences\nsee "), F.replace(F.substring_index("text", "References\n", -1), F.lit("\n"), F.lit(" "))))


def seg04_inline(spark, d):
    df = G.references_of(_one_line(spark, d))
    return G.exploded(df, ["doc_id"]).select("doc_id", F.col("ref_no").cast("long").alias("ref_no"), "reference")


def seg03_author_date(spark, d):
    refs = C.references(spark, d).where("reference not like '[%'")
    docs = refs.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ref_no", "reference"))), lambda x: x["reference"]), "\nand more\n").alias("text"))
    df = G.references_of(docs)
    return G.exploded(df, ["doc_id"]).select("doc_id", F.col("ref_no").cast("long").alias("ref_no"), "reference")


# Layout, on blocks made from line items

def _blocks(spark, d):
    li = table(spark, d, "lineitem").dropDuplicates(["l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice"])
    n = F.col("l_linenumber")
    return li.select(
        (F.col("l_orderkey") % 97).cast("string").alias("doc_id"),
        F.floor(F.col("l_orderkey") / 97).cast("int").alias("page_no"),
        F.lit(600.0).alias("page_width"),
        F.lit(800.0).alias("page_height"),
        (F.col("l_orderkey") * 1_000_000 + n * 100_000 + F.col("l_partkey")).alias("block_no"),
        F.when(n % 2 == 0, 320.0).otherwise(50.0).alias("x0"),
        (F.col("l_quantity") * 16).alias("y0"),
        F.lit(0.0).alias("x1"),
        F.lit(0.0).alias("y1"),
        F.concat(F.lit("["), n.cast("string"), F.lit("] Part "), F.col("l_partkey").cast("string"), F.lit(" of it")).alias("text"),
    )


def flt08_bands(spark, d):
    plain = _blocks(spark, d).withColumn("text", F.regexp_replace("text", r"^\[\d+\] ", ""))
    return L.in_body(plain).select("doc_id", "page_no", "block_no", "y0")


def seg06_columns(spark, d):
    return L.with_columns(L.in_body(_blocks(spark, d))).select("doc_id", "page_no", "block_no", "col_no")


def agg06_gap(spark, d):
    b = L.in_body(_blocks(spark, d)).groupBy("doc_id", "page_no").agg(F.array_sort(F.collect_list("y0")).alias("s")).withColumn("g", L.largest_gap(F.col("s")))
    return b.where("g is not null").select("doc_id", "page_no", F.col("g.gap").alias("gap"), F.col("g.i").cast("long").alias("place"))


def srt01_reading_order(spark, d):
    return L.ordered_blocks(_blocks(spark, d)).select("doc_id", "page_no", F.col("pos").cast("long").alias("pos"), "col_no", "y0")


def agg05_coverage(spark, d):
    g = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("doc_id")).agg(F.array_sort(F.collect_list("l_linenumber")).alias("n"))
    return g.select("doc_id", F.coalesce(L.is_full_numbering(F.col("n")), F.lit(False)).alias("is_full"))


def srt02_sort(spark, d):
    li = table(spark, d, "lineitem")
    text = F.concat(F.lit("["), F.col("l_linenumber").cast("string"), F.lit("] part "), F.col("l_partkey").cast("string"))
    g = li.groupBy(F.col("l_orderkey").alias("doc_id")).agg(F.transform(F.array_sort(F.collect_list(F.struct(F.col("l_partkey"), text.alias("t")))), lambda x: x["t"]).alias("groups"))
    return L.with_sorted_groups(g, "groups", "sorted").select("doc_id", F.array_join("sorted", "\n").alias("sorted"))


def agg04_style(spark, d):
    g = C.references(spark, d).groupBy("doc_id").agg(F.collect_list("reference").alias("texts"))
    return g.select("doc_id", L.marker_style(F.col("texts")).alias("style"))


# Metadata

def _meta(spark, d):
    return M.with_metadata(C.references(spark, d))


def md01_doi(spark, d):
    return C.references(spark, d).select(*KEY, M.extract_doi(F.col("reference")).alias("doi"))


def md03_year(spark, d):
    return C.references(spark, d).select(*KEY, M.extract_year(F.col("reference")).alias("year"))


def md04_title(spark, d):
    return _meta(spark, d).select(*KEY, F.col("extracted.title").alias("title"))


def md05_authors(spark, d):
    return _meta(spark, d).select(*KEY, F.col("extracted.authors").alias("authors"))


def md08_publication(spark, d):
    return _meta(spark, d).select(*KEY, *[F.col(f"extracted.{x}").alias(x) for x in ("venue", "volume", "issue", "pages")])


def md10_page_range(spark, d):
    shown = F.concat(F.lit(" "), F.replace("pages", F.lit("-"), F.lit(" – ")), F.lit(".,"))
    return C.works(spark, d).select("doi", M.page_range(shown).alias("pages"))


def md12_last_range(spark, d):
    return C.references(spark, d).select(*KEY, M.last_page_range(F.col("reference")).alias("pages"))


def md13_cleaned(spark, d):
    return C.references(spark, d).select(*KEY, M.cleaned(F.col("reference")).alias("cleaned"))


def prj06_type(spark, d):
    return C.references(spark, d).select(*KEY, M.reference_type(F.col("reference")).alias("type"))


# Works

def _raw(spark, d):
    """Records as the service writes them: titles as arrays for even numbers, dates in one field or another."""
    w, n = C.works(spark, d), F.col("n")
    year = F.col("year").cast("string")
    join = lambda *x: F.concat(*[F.lit(i) if isinstance(i, str) else i for i in x])
    title = F.when(n % 2 == 0, join('["', F.col("title"), '"]')).otherwise(join('"', F.col("title"), '"'))
    dates = F.when(n % 3 == 0, join('"issued":{"date-parts":[[', year, ',1]]}')).when(n % 3 == 1, join('"published-print":{"date-parts":[[', year, ']]},"issued":{"date-parts":[[1900]]}')).otherwise(join('"published-print":{},"issued":{"date-parts":[[', year, "]]}"))
    author = join('[{"given":"', F.substring_index("authors", " ", 1), '","family":"', F.substring_index("authors", " ", -1), '"},{"name":"The Group"}]')
    return w.select("n", join('{"DOI":"', F.upper("doi"), '.","title":', title, ',"author":', author, ',"container-title":["', F.col("containerTitle"), '"],', dates, ',"volume":"', F.col("volume"), '","page":"', F.col("pages"), '","score":1.5}').alias("json"))


def rec01_year(spark, d):
    return W.normalize_works(_raw(spark, d)).select("n", "year")


def rec02_normalize(spark, d):
    return W.normalize_works(_raw(spark, d)).select("n", "doi", "title", "authors", "containerTitle", "volume", "issue", "pages", "crossrefScore")


def prj08_describe(spark, d):
    return C.works(spark, d).select("n", W.describe().alias("description"))


# Matching

def j01_doi_join(spark, d):
    r = C.references(spark, d).withColumn("ref_doi", M.extract_doi(F.col("reference")))
    return J.doi_join(r, _works(spark, d)).select(*KEY, F.col("cand.title").alias("title"), F.col("cand.year").alias("year"))


def _plain(spark, d):
    r = C.references(spark, d)
    return r.withColumns({"ref_doi": M.extract_doi(F.col("reference")), "ref_tokens": T.token_set(F.col("reference"))}).where("ref_doi is null")


def j02_candidates(spark, d):
    return J.candidates(_plain(spark, d), _works(spark, d), KEY).select(*KEY, F.col("ord").cast("long").alias("ord"), F.col("cand.doi").alias("doi"))


def _scored_by_doi(spark, d):
    return J.scored(J.doi_join(J.with_keys(C.references(spark, d)), _works(spark, d)))


def scr01_score(spark, d):
    m = "match.details."
    return _scored_by_doi(spark, d).select(*KEY, _six(F.col("match.score")).alias("score"), *[_six(F.col(m + x)).alias(y) for x, y in (("titleScore", "title_score"), ("authorScore", "author_score"), ("venueScore", "venue_score"))])


def scr01_confidence(spark, d):
    return _scored_by_doi(spark, d).select(*KEY, F.col("match.confidence").alias("confidence"), *[F.col("match.details." + x).alias(y) for x, y in (("yearMatched", "year_matched"), ("severeYearMismatch", "severe"), ("volumeMatched", "volume_matched"), ("pagesMatched", "pages_matched"))])


def scr01_evidence(spark, d):
    return _scored_by_doi(spark, d).select(*KEY, F.array_join("match.evidence", "; ").alias("evidence"))


def _at_hand(spark, d):
    """The works, written: what takes them and the references made of them several times joins the order tables once."""
    w = written(C.works(spark, d))
    swept(spark)
    return w


def ranked_without_doi(spark, d, pick):
    w = _at_hand(spark, d)
    refs = C.references(spark, d, w).where(M.extract_doi(F.col("reference")).isNull())
    return J.ranked_candidates(refs, w.select(*FIELDS), KEY, pick)


def win07_rank(spark, d):
    return ranked_without_doi(spark, d, lambda r: r.select(*KEY, F.col("rank").cast("long").alias("rank"), F.col("cand.doi").alias("doi"), _six(F.col("match.score")).alias("score")))


def win08_gap(spark, d):
    gap = F.col("match.score") - F.col("next_score")
    return ranked_without_doi(spark, d, lambda r: r.where("rank = 1").select(*KEY, _six(gap).alias("gap"), (gap < A.CLOSE_GAP).alias("close")))


# Audit and reports

def _audit(spark, d, w=None):
    w = _at_hand(spark, d) if w is None else w
    return A.audit(C.references(spark, d, w), w.select(*FIELDS), KEY)


def scr02_audit(spark, d):
    a = _audit(spark, d)
    return a.select(*KEY, "type", "doi", "confidence", "summary", F.size("recommendations").cast("long").alias("n_recommendations"), F.size("evidence").cast("long").alias("n_evidence"), F.col("metadata.matched.title").alias("matched_title"))


def agg01_summary(spark, d):
    return R.confidence_summary(_audit(spark, d)).select("doc_id", "level", F.col("n").cast("long").alias("n"), "refs")


def prj10_comparison(spark, d):
    return R.metadata_comparison(_audit(spark, d), KEY).select(*KEY, F.col("ord").cast("long").alias("ord"), "field", "extracted", "matched")


def prj11_links(spark, d):
    return C.references(spark, d).select(*KEY, R.doi_link(M.extract_doi(F.col("reference"))).alias("link"))


def snk02_response(spark, d):
    w = _at_hand(spark, d)
    docs = C.documents(spark, d, w).withColumns({"processed": T.strip_headers(F.col("text")), "raw": F.col("text"), "cleaned": F.col("text"), "debug": F.array(F.lit("trace"))})
    # Of each audited reference the response shows its text alone; the rest would be collected only to be dropped.
    a = _audit(spark, d, w).select(*KEY, "reference")

    def one(own):
        r = R.responses(own(docs), own(a))
        return r.select("doc_id", "filename", "totalCharacters", F.col("referencesFound").cast("long").alias("referencesFound"), F.col("references")[0]["reference"].alias("first_reference"), F.col("debugOutput").isNull().alias("no_debug"))

    # All texts meet twice, as lines of documents and as references: a slice of the documents for each million of them, 8 at most.
    return in_slices(min(8, -(-w.count() // (1 << 20)) or 1), ["doc_id"], one)


def str01_events(spark, d):
    w = _at_hand(spark, d)
    return R.events(C.documents(spark, d, w), _audit(spark, d, w)).select("doc_id", F.col("seq").cast("long").alias("seq"), "event", "value")


def str03_backoff(spark, d):
    rows = [(a, s, r) for a in range(4) for s in (408, 429, 500, 503) for r in (None, "7", "soon")]
    df = spark.createDataFrame(rows, "attempt int, status int, retry_after string")
    return df.select("*", H.retry_delay_ms(F.col("attempt"), F.col("status"), F.col("retry_after")).alias("delay_ms"), H.is_retriable(F.col("status")).alias("retriable"))


def prj14_urls(spark, d):
    return C.works(spark, d).select("n", H.doi_url(F.concat("doi", F.lit("(a b)"))).alias("url"))


def src16_engine(spark, d):
    return R.engine_info(spark)


NAMES = [
    "txt01_normalize", "txt02_clean", "txt03_strip_headers", "txt04_interleave", "txt08_tokens", "agg02_lengths", "agg08_distinct_tokens", "sim01_dice", "sim02_labels", "flt01_looks_like", "prj12_escape",
    "win01_islands", "seg01_strategy", "seg02_references", "seg03_author_date", "seg04_inline",
    "flt08_bands", "seg06_columns", "agg06_gap", "srt01_reading_order", "agg05_coverage", "srt02_sort", "agg04_style",
    "md01_doi", "md03_year", "md04_title", "md05_authors", "md08_publication", "md10_page_range", "md12_last_range", "md13_cleaned", "prj06_type",
    "rec01_year", "rec02_normalize", "prj08_describe", "j01_doi_join", "j02_candidates", "scr01_score", "scr01_confidence", "scr01_evidence", "win07_rank", "win08_gap",
    "scr02_audit", "agg01_summary", "prj10_comparison", "prj11_links", "snk02_response", "str01_events", "str03_backoff", "prj14_urls", "src16_engine",
]
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {n: globals()[n] for n in NAMES}
