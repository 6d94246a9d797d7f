"""A corpus of works and references derived from the order tables, which hold no citations themselves.

Every order with a line is a work; every work is cited once, in one of four styles, some citations with a wrong year, volume
or title. `CORPUS_SQL` says the same for a SQL engine, for the queries' SQL twins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

REFS_PER_DOC = 20
#: As many different last words of titles: no title names its work alone.
TOPICS = 499


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _text(c: Column) -> Column:
    return c.cast("string")


def _word(c: Column) -> Column:
    """A number in letters."""
    return F.translate(_text(c), "0123456789", "abcdefghij")


def works(spark: SparkSession, sf_dir: str) -> DataFrame:
    """n (the order), then the candidate fields."""
    # The table is small in bytes, so it is read in few tasks; what is done with each row is not.
    orders = _table(spark, sf_dir, "orders").repartition(spark.sparkContext.defaultParallelism, "o_orderkey")
    first = _table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.min(F.struct("l_linenumber", "l_partkey")).alias("_l"))
    o = orders.join(_table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(first, F.col("o_orderkey") == F.col("l_orderkey"))
    o = o.join(_table(spark, sf_dir, "part"), F.col("_l.l_partkey") == F.col("p_partkey"))
    n = F.col("o_orderkey")
    family = F.concat(F.lit("Q"), _word(F.col("c_custkey")))
    given = F.char(F.lit(65) + F.col("c_custkey") % 26)
    return o.select(
        n.alias("n"),
        F.lit("crossref").alias("source"),
        F.concat(F.lit("10.1000/w"), _text(n)).alias("doi"),
        F.concat("p_name", F.lit(" "), F.lower("c_mktsegment"), F.lit(" study of "), _word(n % TOPICS)).alias("title"),
        F.concat(given, F.lit(". "), family).alias("authors"),
        F.concat(F.lit("Journal of "), F.lower("p_type")).alias("containerTitle"),
        F.year("o_orderdate").alias("year"),
        _text(n % 50 + 1).alias("volume"),
        _text(n % 4 + 1).alias("issue"),
        F.concat(_text(n % 900 + 1), F.lit("-"), _text(n % 900 + 9)).alias("pages"),
        F.lit("").alias("publisher"),
        F.lit("").alias("url"),
        F.lit(None).cast("double").alias("crossrefScore"),
    )


def references(spark: SparkSession, sf_dir: str, cited: DataFrame | None = None) -> DataFrame:
    """doc_id, ref_no, reference. cited: the works, if they are at hand."""
    w, n = works(spark, sf_dir) if cited is None else cited, F.col("n")
    w = w.withColumns({
        "y": F.col("year") + F.when(n % 7 == 0, 1).when(n % 11 == 0, 3).otherwise(0),
        "t": F.when(n % 5 == 0, F.regexp_replace("title", "^[^ ]+ ", "")).otherwise(F.col("title")),
        "v": F.when(n % 13 == 0, "77").otherwise(F.col("volume")),
        "no": n % REFS_PER_DOC + 1,
    })
    mark = F.concat(F.lit("["), _text(F.col("no")), F.lit("] "))
    given, family = F.substring_index("authors", " ", 1), F.substring_index("authors", " ", -1)
    join = lambda *x: F.concat(*[F.lit(i) if isinstance(i, str) else i for i in x])
    c = F.col
    acm = join(mark, c("authors"), ". ", _text(c("y")), ". ", c("t"), ". ", c("containerTitle"), " ", c("v"), ", ", c("issue"), " (", _text(c("y")), "), ", c("pages"), ".")
    apa = join(family, ", ", given, " (", _text(c("y")), "). ", c("t"), ". ", c("containerTitle"), " ", c("v"), ", ", c("issue"), " (", _text(c("y")), "), ", c("pages"), ". https://doi.org/", c("doi"))
    ieee = join(mark, c("authors"), ', "', c("t"), '," ', c("containerTitle"), ", vol. ", c("v"), ", no. ", c("issue"), ", pp. ", c("pages"), ", ", _text(c("y")), ", doi: ", c("doi"), ".")
    text = F.when(n % 4 == 0, join(acm, " doi:", c("doi"))).when(n % 4 == 1, apa).when(n % 4 == 2, ieee).otherwise(acm)
    return w.select((F.floor(n / REFS_PER_DOC)).cast("long").alias("doc_id"), c("no").cast("int").alias("ref_no"), text.alias("reference"))


def documents(spark: SparkSession, sf_dir: str, cited: DataFrame | None = None) -> DataFrame:
    """doc_id, filename, text: a page of text, the heading, and the marked references of the document, a line each; those
    without a marker get one, as every reference list has. cited: the works, if they are at hand."""
    r = references(spark, sf_dir, cited)
    line = F.when(F.col("reference").startswith("["), F.col("reference")).otherwise(F.concat(F.lit("["), _text(F.col("ref_no")), F.lit("] "), F.col("reference")))
    d = r.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("ref_no", line.alias("line")))).alias("_l"))
    body = F.array_join(F.transform("_l", lambda x: x["line"]), "\n")
    return d.select("doc_id", F.concat(F.lit("paper-"), _text(F.col("doc_id")), F.lit(".pdf")).alias("filename"), F.concat(F.lit("A study\nAbstract. Text.\nReferences\n"), body).alias("text"))


CORPUS_SQL = """
works AS (
  SELECT o_orderkey AS n, '10.1000/w' || o_orderkey AS doi, p_name || ' ' || lower(c_mktsegment) || ' study of ' || translate(CAST(o_orderkey % 499 AS VARCHAR), '0123456789', 'abcdefghij') AS title,
    chr(CAST(65 + c_custkey % 26 AS INTEGER)) || '. Q' || translate(CAST(c_custkey AS VARCHAR), '0123456789', 'abcdefghij') AS authors,
    'Journal of ' || lower(p_type) AS container, CAST(year(o_orderdate) AS INTEGER) AS year, CAST(o_orderkey % 50 + 1 AS VARCHAR) AS volume,
    CAST(o_orderkey % 4 + 1 AS VARCHAR) AS issue, (o_orderkey % 900 + 1) || '-' || (o_orderkey % 900 + 9) AS pages
  FROM orders JOIN customer ON o_custkey = c_custkey
  JOIN (SELECT l_orderkey, l_partkey FROM (SELECT l_orderkey, l_partkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) AS k FROM lineitem) WHERE k = 1) ON o_orderkey = l_orderkey
  JOIN part ON l_partkey = p_partkey),
cited AS (
  SELECT *, n % 20 + 1 AS no, year + CASE WHEN n % 7 = 0 THEN 1 WHEN n % 11 = 0 THEN 3 ELSE 0 END AS y,
    CASE WHEN n % 5 = 0 THEN substr(title, strpos(title, ' ') + 1) ELSE title END AS t, CASE WHEN n % 13 = 0 THEN '77' ELSE volume END AS v,
    split_part(authors, ' ', 1) AS given, split_part(authors, ' ', 2) AS family
  FROM works),
refs AS (
  SELECT n, CAST(n // 20 AS BIGINT) AS doc_id, CAST(no AS INTEGER) AS ref_no, CASE n % 4
    WHEN 1 THEN family || ', ' || given || ' (' || y || '). ' || t || '. ' || container || ' ' || v || ', ' || issue || ' (' || y || '), ' || pages || '. https://doi.org/' || doi
    WHEN 2 THEN '[' || no || '] ' || authors || ', "' || t || '," ' || container || ', vol. ' || v || ', no. ' || issue || ', pp. ' || pages || ', ' || y || ', doi: ' || doi || '.'
    ELSE '[' || no || '] ' || authors || '. ' || y || '. ' || t || '. ' || container || ' ' || v || ', ' || issue || ' (' || y || '), ' || pages || '.' || CASE WHEN n % 4 = 0 THEN ' doi:' || doi ELSE '' END
  END AS reference FROM cited)"""
