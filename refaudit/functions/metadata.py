"""Citation metadata from the text of a reference.

`with_metadata` works in layers of withColumns, so that each regular expression is evaluated once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import patterns as P
from .text import blank_to_null, normalize_text, present, strip_marker, trimmed, without

#: Between the groups of one match, where no text has it.
_BETWEEN = "\x01\x02\x01"
FIELDS = ["authors", "date", "title", "venue", "volume", "issue", "pages"]


def normalize_doi(c: Column) -> Column:
    return blank_to_null(F.lower(without(c, P.DOI_TAIL)))


def extract_doi(c: Column) -> Column:
    """The first DOI, lower-cased, without trailing punctuation; null if there is none."""
    return normalize_doi(F.regexp_substr(c, F.lit(P.DOI)))


def extract_year(c: Column) -> Column:
    """The first word that is a year from 1900 to 2099; null if there is none."""
    return F.regexp_substr(c, F.lit(P.YEAR)).cast("int")


def reference_type(c: Column) -> Column:
    low = F.lower(c)
    has = lambda x: F.contains(low, F.lit(x))
    return F.when(has("doi:") | has("https://doi.org/"), "doi").when(has("arxiv"), "arxiv").when(has("journal") | has("proc") | has("transactions"), "article").otherwise("unknown")


def page_range(c: Column) -> Column:
    """A page range in normal form for comparison."""
    c = F.regexp_replace(normalize_text(c), P.DASH, "-")
    return F.lower(without(c, rf"[.,;:{P.SPACE_CLASS}]+\z"))


def plain_value(c: Column) -> Column:
    return F.lower(without(normalize_text(c), rf"[.,;:{P.SPACE_CLASS}]+\z"))


def same_value(left: Column, right: Column, form=plain_value) -> Column:
    """Both present and equal in normal form; two missing values are not the same."""
    return present(left) & present(right) & F.coalesce(form(left) == form(right), F.lit(False))


def last_page_range(c: Column) -> Column:
    found = F.regexp_extract_all(normalize_text(c), F.lit(P.PAGE_RANGE), F.lit(1))
    return F.coalesce(trimmed(F.try_element_at(found, F.lit(-1))), F.lit(""))


def cleaned(c: Column) -> Column:
    """Without marker, arXiv id, DOIs and urls; white space collapsed."""
    for p in (P.ANY_MARKER, P.ARXIV_ID, P.DOI_WITH_PREFIX, P.DOI_WORD, P.URL):
        c = without(c, p)
    return normalize_text(c)


def _segments(c: Column) -> Column:
    return F.filter(F.transform(F.split(c, P.SEGMENT), trimmed), lambda x: x != "")


def _is_title(segment: Column) -> Column:
    return segment.rlike(rf"^{P.NS}+(?:{P.S}+{P.NS}+){{2}}") & ~F.contains(segment, F.lit(";")) & ~segment.rlike(P.NOT_A_TITLE)


def _after(c: Column, at: Column, length: Column) -> Column:
    """What follows the `length` characters from the 1-based place `at`."""
    return F.substring(c, at + length, F.char_length(c))


def _no_in(c: Column) -> Column:
    return trimmed(without(c, P.LEADING_IN))


def _groups(c: Column, pattern: str, n: int) -> Column:
    """The n groups of a pattern that starts at ^, from one match; an array of one where it doesn't match."""
    return F.split(F.regexp_replace(c, pattern + r"[\s\S]*\z", _BETWEEN.join(f"${i}" for i in range(1, n + 1))), _BETWEEN, -1)


def with_metadata(df: DataFrame, reference: str = "reference", out: str = "extracted") -> DataFrame:
    """df with the struct `out` of authors, date, title, venue, volume, issue and pages; '' is missing."""
    c = F.col
    none = F.lit("")
    df = df.withColumns({"_strip": strip_marker(F.coalesce(c(reference), none)), "_clean": cleaned(F.coalesce(c(reference), none))})
    df = df.withColumns({
        "_year": extract_year(c(reference)),
        "_quote": F.regexp_extract("_strip", P.QUOTED, 1),
        "_bare": trimmed(without(trimmed(without(c("_strip"), "(?i)" + P.DOI)), P.URL)),
        "_source": strip_marker(c("_clean")),
        "_clean_year": extract_year(c("_clean")).cast("string"),
    })
    df = df.withColumns({
        "_at": F.regexp_instr(c("_source"), F.lit(P.QUOTED)),
        "_whole": F.regexp_extract("_source", P.QUOTED, 0),
        "_bare_year": extract_year(c("_bare")).cast("string"),
    })
    # Title: the quoted one; else the first segment after the year that reads like a title.
    rest = F.when(c("_bare_year").isNotNull(), _after(c("_bare"), F.instr(c("_bare"), c("_bare_year")), F.lit(4))).otherwise(c("_bare"))
    df = df.withColumn("_rest", rest)
    first = F.get(F.filter(_segments(c("_rest")), _is_title), F.lit(0))
    fallback = F.substring(without(c("_rest"), rf"^[.{P.SPACE_CLASS}]+"), 1, 160)
    quoted_title = without(normalize_text(c("_quote")), P.TAIL)
    df = df.withColumn("_title", F.when(c("_quote") != "", quoted_title).otherwise(F.coalesce(first, fallback)))
    # Authors: what comes before the quote, or before the year, or the first sentence.
    before_year = F.when(c("_clean_year").isNotNull(), trimmed(F.substring(c("_clean"), F.lit(1), F.instr(c("_clean"), c("_clean_year")) - 1))).otherwise(F.get(F.split(c("_clean"), rf"\.{P.S}+"), F.lit(0)))
    df = df.withColumn("_before", without(without(before_year, P.OPENING_TAIL), P.TAIL))
    plain_authors = F.when(c("_before").rlike(P.INITIAL_AT_END), c("_before")).otherwise(without(c("_before"), r"\.+\z"))
    quoted_authors = without(F.substring(c("_source"), F.lit(1), c("_at") - 1), P.TAIL)
    df = df.withColumn("_authors", F.substring(F.when(c("_at") > 0, quoted_authors).otherwise(plain_authors), 1, 240))
    # Publication after a quoted title; null without one, so that none of these patterns runs.
    is_quoted = c("_at") > 0
    tail = normalize_text(without(_after(c("_source"), c("_at"), F.char_length("_whole")), rf"^[,{P.SPACE_CLASS}]+"))
    df = df.withColumn("_details", F.when(is_quoted, without(tail, rf"[.;{P.SPACE_CLASS}]+\z")))
    df = df.withColumn("_last_year", F.regexp_extract("_details", P.LAST_YEAR, 1))
    venue = without(without(c("_details"), P.FROM_VOLUME), P.FROM_PAGES)
    own_year = F.concat(F.lit(f",?{P.S}*"), c("_last_year"), F.lit(rf"[.;{P.SPACE_CLASS}]*\z"))
    venue = F.when(c("_last_year") != "", F.regexp_replace(venue, own_year, F.lit(""))).otherwise(venue)
    venue = without(without(venue, rf"^[,{P.SPACE_CLASS}]+"), rf"[,;{P.SPACE_CLASS}]+\z")
    df = df.withColumn("_qvenue", _no_in(venue))
    acronym = trimmed(F.regexp_extract("_qvenue", P.UP_TO_ACRONYM, 1))
    pages = trimmed(F.regexp_extract("_details", P.PAGES, 1))
    quoted = F.struct(
        F.when(acronym != "", acronym).otherwise(c("_qvenue")).alias("venue"),
        trimmed(F.regexp_extract("_details", P.VOLUME, 1)).alias("volume"),
        trimmed(F.regexp_extract("_details", P.ISSUE, 1)).alias("issue"),
        F.when(pages != "", pages).otherwise(last_page_range(c("_details"))).alias("pages"),
    )
    # Publication after a plain title.
    at = F.when(c("_title") != "", F.instr(F.lower(c("_clean")), F.lower(c("_title")))).otherwise(0)
    after = F.when(at > 0, _after(c("_clean"), at, F.char_length("_title"))).otherwise(c("_clean"))
    df = df.withColumn("_after", F.when(~is_quoted, trimmed(without(after, rf"^[.,{P.SPACE_CLASS}]+"))))
    form = lambda v, vol, iss, pg: F.struct(v.alias("venue"), vol.alias("volume"), iss.alias("issue"), pg.alias("pages"))
    # Each form in a layer of its own, which takes all groups in one match and runs only where those before found nothing.
    found = None
    for name, pattern, n in (("_j1", P.JOURNAL_WITH_ISSUE, 4), ("_j2", P.JOURNAL, 3), ("_j3", P.ARTICLE, 5)):
        groups = _groups(c("_after"), pattern, n)
        df = df.withColumn(name, groups if found is None else F.when(~found, groups))
        found = F.coalesce(F.size(name) > 1, F.lit(False)) if found is None else found | F.coalesce(F.size(name) > 1, F.lit(False))
    for name, pattern in (("_j4", P.PROCEEDINGS), ("_j5", P.VENUE_START)):
        df = df.withColumn(name, F.when(~found, F.regexp_extract("_after", pattern, 1)))
        found = found | F.coalesce(c(name) != "", F.lit(False))
    by_word = F.get(F.filter(_segments(c("_after")), lambda x: x.rlike(P.VENUE_WORD)), F.lit(0))
    part = lambda name, i: trimmed(F.get(name, F.lit(i)))
    hit = lambda name: F.size(name) > 1
    plain = (
        F.when(hit("_j1"), form(_no_in(part("_j1", 0)), part("_j1", 1), part("_j1", 2), part("_j1", 3)))
        .when(hit("_j2"), form(_no_in(part("_j2", 0)), part("_j2", 1), none, part("_j2", 2)))
        .when(hit("_j3"), form(_no_in(part("_j3", 0)), part("_j3", 1), part("_j3", 2), F.concat(part("_j3", 3), F.lit(", "), part("_j3", 4))))
        .when(c("_j4") != "", form(_no_in(trimmed(c("_j4"))), none, none, last_page_range(c("_after"))))
        .when(c("_j5") != "", form(_no_in(trimmed(c("_j5"))), none, none, last_page_range(c("_after"))))
        .otherwise(form(F.coalesce(F.substring(by_word, 1, 240), none), none, none, last_page_range(c("_after"))))
    )
    df = df.withColumn("_pub", F.when(is_quoted, quoted).otherwise(plain))
    made = F.struct(c("_authors").alias("authors"), F.coalesce(c("_year").cast("string"), none).alias("date"), c("_title").alias("title"), *[c(f"_pub.{x}").alias(x) for x in ("venue", "volume", "issue", "pages")])
    return df.withColumn(out, made).drop("_strip", "_clean", "_year", "_quote", "_bare", "_source", "_clean_year", "_at", "_whole", "_bare_year", "_rest", "_title", "_before", "_authors", "_details", "_last_year", "_qvenue", "_after", "_pub", "_j1", "_j2", "_j3", "_j4", "_j5")
