"""Works: bibliographic records from raw JSON, one per row, normalised to the candidate schema."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.metadata import normalize_doi
from ..functions.text import present

#: The date fields of a record, the most authoritative first.
DATE_FIELDS = ['$["published-print"]', '$["journal-issue"]["published-print"]', "$.issued", "$.published", '$["published-online"]', "$.created"]
MAX_AUTHORS = 8
CANDIDATE = ["source", "doi", "title", "authors", "containerTitle", "year", "volume", "issue", "pages", "publisher", "url", "crossrefScore"]


def _text(v: Column, path: str) -> Column:
    return F.coalesce(F.try_variant_get(v, path, "string"), F.lit(""))


def _first_text(v: Column, path: str) -> Column:
    """A text, or the first of an array of texts."""
    items = F.try_variant_get(v, path, "array<variant>")
    return F.coalesce(F.try_variant_get(F.get(items, F.lit(0)), "$", "string"), F.when(items.isNull(), F.try_variant_get(v, path, "string")), F.lit(""))


def work_year(v: Column) -> Column:
    """The year of the first date field that is there at all; null if that one is malformed."""
    out = None
    for path in DATE_FIELDS:
        field = F.try_variant_get(v, path, "variant")
        there = field.isNotNull() & ~F.is_variant_null(field)
        year = F.try_variant_get(v, path + '["date-parts"][0][0]', "int")
        out = F.when(there, year) if out is None else out.when(there, year)
    return out


def normalize_works(raw: DataFrame, json_col: str = "json") -> DataFrame:
    """raw's other columns and those of CANDIDATE. Text that isn't JSON gives an empty work."""
    v = F.col("_v")
    df = raw.withColumn("_v", F.coalesce(F.try_parse_json(json_col), F.parse_json(F.lit("{}"))))
    author = lambda a: F.coalesce(
        F.nullif(F.try_variant_get(a, "$.name", "string"), F.lit("")),
        F.concat_ws(" ", F.nullif(F.try_variant_get(a, "$.given", "string"), F.lit("")), F.nullif(F.try_variant_get(a, "$.family", "string"), F.lit(""))),
    )
    names = F.filter(F.transform(F.try_variant_get(v, "$.author", "array<variant>"), author), lambda x: x != "")
    doi = F.coalesce(F.nullif(_text(v, "$.DOI"), F.lit("")), _text(v, "$.doi"))
    kind = F.schema_of_variant(F.try_variant_get(v, "$.score", "variant"))
    return df.select(
        *[c for c in raw.columns if c != json_col],
        F.lit("crossref").alias("source"),
        normalize_doi(doi).alias("doi"),
        _first_text(v, "$.title").alias("title"),
        F.coalesce(F.array_join(F.slice(names, 1, MAX_AUTHORS), ", "), F.lit("")).alias("authors"),
        _first_text(v, '$["container-title"]').alias("containerTitle"),
        work_year(v).alias("year"),
        _text(v, "$.volume").alias("volume"),
        _text(v, "$.issue").alias("issue"),
        _text(v, "$.page").alias("pages"),
        _text(v, "$.publisher").alias("publisher"),
        _text(v, "$.URL").alias("url"),
        F.when(kind.rlike("^(?:BIGINT|DOUBLE|FLOAT|DECIMAL)"), F.try_variant_get(v, "$.score", "double")).alias("crossrefScore"),
    )


def read_works(spark: SparkSession, path: str) -> DataFrame:
    """Works from files of one JSON record per line."""
    return normalize_works(spark.read.text(path).withColumnRenamed("value", "json"))


def usable(works: DataFrame) -> DataFrame:
    """Works with a title or a DOI."""
    return works.where(present(F.col("title")) | present(F.col("doi")))


def candidate_metadata(prefix: str = "") -> Column:
    """A candidate's fields as the metadata struct; '' is missing, and the publisher stands in for a missing venue."""
    c = lambda n: F.col(f"{prefix}{n}")
    text = lambda n: F.coalesce(c(n), F.lit(""))
    return F.struct(
        text("authors").alias("authors"),
        F.coalesce(F.when(c("year") != 0, c("year").cast("string")), F.lit("")).alias("date"),
        text("title").alias("title"),
        F.coalesce(F.nullif(c("containerTitle"), F.lit("")), c("publisher"), F.lit("")).alias("venue"),
        text("volume").alias("volume"),
        text("issue").alias("issue"),
        text("pages").alias("pages"),
    )


def describe(prefix: str = "") -> Column:
    """'title (year) DOI x'; 'unknown candidate' where prefix names a null struct."""
    c = lambda n: F.col(f"{prefix}{n}")
    parts = F.concat_ws(" ", F.coalesce(F.nullif(c("title"), F.lit("")), F.lit("untitled work")), F.when(c("year") != 0, F.concat(F.lit("("), c("year").cast("string"), F.lit(")"))), F.when(present(c("doi")), F.concat(F.lit("DOI "), c("doi"))))
    return F.when(F.col(prefix[:-1]).isNull(), "unknown candidate").otherwise(parts) if prefix else parts
