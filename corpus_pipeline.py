"""The corpus pipeline: language identification, exact dedup, near-dedup, source mixing, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of documents. Stages
work on all rows of their input and on whole texts. Rows are told apart by numbers, not by doc_id, so repeated rows and null
ids stay apart; any other column may be null; columns other than those of documents are dropped; an empty table gives one.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from refaudit.llm.common import maybe_in, temporary, written
from refaudit.llm.exact_dedup import exact_groups
from refaudit.llm.langid import UNKNOWN, identify, train
from refaudit.llm.mixing import mix
from refaudit.llm.near_dedup import near_groups
from refaudit.llm.packing import pack

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
VOCAB = "byte_bpe_50k.json"


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Learns from the labelled documents and drops those whose language can't be told: a null text, or one without a letter
    (all of them, if no row is labelled). Repeated rows stay or go together."""
    model = train(docs)
    return identify(docs.select(*COLUMNS), model).where(F.col("lang_pred") != UNKNOWN).select(*COLUMNS)


def _numbered(docs: DataFrame) -> DataFrame:
    """docs with _row, which names each row, and _id: doc_id and that name, which orders like doc_id.

    A row of files is named by its file and its place there, which no other scan changes. Numbers given in a scan depend on how
    it is split, so rows that don't come straight from files are written with theirs.
    """
    try:
        rows = docs.select(*COLUMNS, F.struct(F.xxhash64("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("at")).alias("_row"))
    except AnalysisException:
        rows = written(docs.select(*COLUMNS, F.struct(F.monotonically_increasing_id().alias("at")).alias("_row")))
    return rows.withColumn("_id", F.struct("doc_id", "_row"))


def _without(docs: DataFrame, groups: DataFrame) -> DataFrame:
    """The rows of docs that groups (doc_id: their _id, kept) keep. Few are dropped, so a bit map tells most rows that they stay
    without a shuffle of their texts."""
    out = written(groups.where("not kept").select(F.col("doc_id._row").alias("_row")))
    marked = maybe_in(docs, F.xxhash64("_row"), out.select(F.xxhash64("_row").alias("_h")))
    return marked.where("not _maybe").select(*COLUMNS).union(marked.where("_maybe").join(out, "_row", "left_anti").select(*COLUMNS))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of equal texts (but for white space) stays: the one with most characters, then smallest id (a null
    one comes first), then any of equal rows. Null counts as the empty text."""
    rows = _numbered(docs)
    return _without(rows, exact_groups(rows, id_col="_id"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies stays, that of the smallest id (five-word shingles, similarity 0.8 or more). Rows
    without words are in no group and stay."""
    rows = _numbered(docs)
    return _without(rows, near_groups(rows, n=5, percent=80, id_col="_id"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix takes it: a row for each pass in which a slot takes its first word. Rows without words
    are never taken; a null source is a source of its own."""
    rows = _numbered(docs)
    _, taken = mix(rows, id_col="_id", shuffle_col="doc_id")
    copies = taken.where("first_word = 0").groupBy(F.col("doc_id._row").alias("_r")).agg(F.count("*").cast("int").alias("_times"))
    out = rows.join(written(copies), F.col("_row") == F.col("_r"))
    return out.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_times")))).select(*COLUMNS)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents, packed into sequences of 2048 tokens. A null text is one piece with the end alone."""
    return pack(docs, public_tokenizers.path(VOCAB), capacity=2048, end_id=0)


STAGES = [
    ("language_id", language_id),
    ("exact_dedup", exact_dedup),
    ("near_dedup", near_dedup),
    ("mix_sources", mix_sources),
    ("pack_sequences", pack_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to documents; each one's rows are written and read again as the next one's docs. What a stage writes
    on the way is deleted with its end."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        with temporary():
            docs = written(stage(spark, docs, sf_dir), outlive=True)
    return STAGES[-1][1](spark, docs, sf_dir)


#: A pass of naive Bayes, similarity classes and packing aren't SQL; tests/llm holds run() against a brute-force version.
ORACLE_SQL = None
