"""Text functions: Column in, Column out."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import patterns as P


def trimmed(c: Column) -> Column:
    """Without white space at either end; white space is what JavaScript calls so."""
    return F.btrim(c, F.lit(P.SPACE_CHARS))


def normalize_text(c: Column) -> Column:
    """White-space runs become one space; null becomes ''."""
    return trimmed(F.regexp_replace(F.coalesce(c, F.lit("")), P.S + "+", " "))


def blank_to_null(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def present(c: Column) -> Column:
    """Neither null nor empty."""
    return F.coalesce(c != "", F.lit(False))


def without(c: Column, pattern: str) -> Column:
    return F.regexp_replace(c, pattern, "")


def utf16_length(c: Column) -> Column:
    """Length in UTF-16 units."""
    return F.floor(F.octet_length(F.encode(c, "UTF-16BE")) / 2).cast("long")


def lines_of(c: Column) -> Column:
    """Trimmed, non-empty lines."""
    return F.filter(F.transform(F.split(F.regexp_replace(c, "\r\n", "\n"), "\n"), trimmed), lambda x: x != "")


def clean_extracted(c: Column) -> Column:
    """Drops carriage returns, joins lines that break between two letters, collapses blank lines and spaces."""
    c = F.replace(c, F.lit("\r"), F.lit(""))
    c = F.regexp_replace(c, r"([a-zA-Z])\n(?=[a-zA-Z])", "$1 ")
    return trimmed(F.regexp_replace(F.regexp_replace(c, r"\n{2,}", "\n"), r"[ \t]+", " "))


def strip_headers(c: Column) -> Column:
    """The lines after the first heading line; all lines if there is none."""
    return F.array_join(after_heading(lines_of(c)), "\n")


def after_heading(lines: Column) -> Column:
    at = F.array_position(F.transform(lines, lambda x: x.rlike(P.HEADING)), F.lit(True))
    return F.when(at > 0, F.slice(lines, at + 1, F.greatest(F.size(lines), F.lit(1)))).otherwise(lines)


def interleave_columns(c: Column) -> Column:
    """Within each paragraph of three lines or more, the first half's lines alternate with the second half's."""

    def one(paragraph: Column) -> Column:
        lines = lines_of(paragraph)
        half = F.ceil(F.size(lines) / 2).cast("int")
        pairs = F.transform(F.sequence(F.lit(0), half - 1), lambda i: F.array(F.get(lines, i), F.get(lines, i + half)))
        mixed = F.filter(F.flatten(pairs), lambda x: x.isNotNull())
        return F.when(F.size(lines) <= 2, F.array_join(lines, " ")).otherwise(F.array_join(mixed, " "))

    paragraphs = F.filter(F.transform(F.split(c, r"\n{2,}"), trimmed), lambda x: x != "")
    return F.array_join(F.transform(paragraphs, one), "\n\n")


def looks_like_references(c: Column) -> Column:
    """At least three lines with a marker, or three that start like an author-date reference."""
    lines = F.transform(F.split(c, r"\r?\n"), trimmed)
    count = lambda p: F.size(F.filter(lines, lambda x: x.rlike(p)))
    return (count(P.MARKER) >= 3) | (count(P.AUTHOR_DATE_START) >= 3)


def processed_text(raw: Column) -> Column:
    """What segmentation reads: cleaned, without headers, columns interleaved unless it already looks like references."""
    body = strip_headers(clean_extracted(raw))
    return F.when(looks_like_references(body), body).otherwise(interleave_columns(body))


def repair_wrapping(c: Column, strict_parity: bool = True) -> Column:
    """Glues DOIs and words that a line break cut. With strict_parity a word after 'doi:10.x/...' is glued on as well."""
    c = F.coalesce(c, F.lit(""))
    if strict_parity:
        c = F.regexp_replace(c, P.WRAPPED_DOI, "$1$2")
    c = F.regexp_replace(c, P.WRAPPED_DOI_TAIL, "$1$2")
    # A left part of two or more capitals keeps its hyphen; otherwise the hyphen goes.
    c = F.regexp_replace(c, rf"(?<![A-Za-z])([A-Z]{{2,}})-{P.S}+([a-z]{{2,}})", "$1-$2")
    return normalize_text(F.regexp_replace(c, rf"([A-Za-z])-{P.S}+([a-z]{{2,}})", "$1$2"))


def split_inline(c: Column) -> Column:
    """Pieces that start at each marker within the text; what comes before the first one is a piece of its own."""
    parts = F.transform(F.split(c, P.INLINE_START_BLOCK), trimmed)
    return F.filter(parts, lambda x, i: (x != "") | (i == 0))


def reference_number(c: Column) -> Column:
    number = F.coalesce(blank_to_null(F.regexp_extract(c, P.BRACKET_MARKER, 1)), blank_to_null(F.regexp_extract(c, P.NUMBER_MARKER, 1)))
    return number.cast("int")


def strip_marker(c: Column) -> Column:
    return trimmed(without(c, P.ANY_MARKER))


def tokens(c: Column) -> Column:
    """Lower-case runs of ASCII letters and digits."""
    return F.filter(F.split(F.regexp_replace(F.lower(normalize_text(c)), "[^a-z0-9]+", " "), " "), lambda x: x != "")


def token_set(c: Column) -> Column:
    return F.array_distinct(tokens(c))


def dice(left: Column, right: Column) -> Column:
    """Sørensen-Dice of two arrays of distinct tokens; 0 if either is empty."""
    total = F.size(left) + F.size(right)
    found = F.size(F.array_intersect(left, right)) * F.lit(2.0) / F.greatest(F.lit(1), total)
    return F.when((F.size(left) > 0) & (F.size(right) > 0), found).otherwise(F.lit(0.0))


def score_label(c: Column) -> Column:
    return F.when(c >= 0.8, "strong").when(c >= 0.45, "medium").when(c > 0, "weak").otherwise("none")


def to_fixed2(c: Column) -> Column:
    """Two decimals, exact ties upward (0.125 and 0.625 are the only scores that tie)."""
    return F.when(c.isin(0.125, 0.625), F.format_number(c + 0.001, 2)).otherwise(F.format_number(c, 2))


def html_escape(c: Column) -> Column:
    c = F.coalesce(c, F.lit(""))
    for char, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#039;")):
        c = F.replace(c, F.lit(char), F.lit(entity))
    return c


def path_encode(c: Column) -> Column:
    """Percent-encoding for a path segment: a space is %20, and ! ' ( ) * ~ stay as they are."""
    c = F.replace(F.url_encode(c), F.lit("+"), F.lit("%20"))
    for code, char in (("%21", "!"), ("%27", "'"), ("%28", "("), ("%29", ")"), ("%7E", "~")):
        c = F.replace(c, F.lit(code), F.lit(char))
    return c
