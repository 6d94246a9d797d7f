"""Audits of arriving documents: a file stream in, event lines out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.text import processed_text
from ..operators.audit import audit
from ..operators.report import EVENT_SCHEMA, events
from ..operators.segment import exploded, references_of
from ..sources.lookup import Config

KEY = ["doc_id", "ref_no"]

def audit_documents(docs: DataFrame, works: DataFrame, config: Config = Config()) -> tuple[DataFrame, DataFrame]:
    """(documents, audited references) of docs (doc_id, raw)."""
    docs = docs.withColumn("text", processed_text(F.col("raw")))
    return docs, audit(exploded(references_of(docs, limit=config.max_references), ["doc_id"]), works, KEY, config.rows)


def audit_stream(spark: SparkSession, source: str, works: DataFrame, sink: str, checkpoint: str, config: Config | None = None) -> StreamingQuery:
    """Audits every text file that arrives in `source`, one document a file, and writes its event lines to `sink`.

    Each micro-batch replaces its own folder, so a batch that is run again after a failure leaves no line twice. Stops when
    all files there are done (availableNow)."""
    docs = spark.readStream.format("text").option("wholetext", True).load(source).select(F.col("_metadata.file_path").alias("doc_id"), F.col("value").alias("raw"))

    def write(batch: DataFrame, number: int) -> None:
        own, audited = audit_documents(batch, works, config or Config.of(spark))
        lines = events(own, audited).select("doc_id", "seq", "value").repartition("doc_id").sortWithinPartitions("doc_id", "seq")
        lines.select("value").write.mode("overwrite").text(f"{sink}/batch={number}")

    return docs.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read_event_stream(spark: SparkSession, path: str) -> DataFrame:
    """Event lines as they arrive, with the time `ts` at which their file was written."""
    files = spark.readStream.schema(EVENT_SCHEMA).option("recursiveFileLookup", True).json(path)
    return files.withColumn("ts", F.col("_metadata.file_modification_time"))


def finished(stream: DataFrame, window: str = "1 minute", late: str = "10 minutes") -> DataFrame:
    """Checked references by confidence per time window of a stream with the time column `ts`."""
    checked = stream.where("event = 'checked-reference'").withWatermark("ts", late)
    return checked.groupBy(F.window("ts", window), "confidence").agg(F.count("*").alias("n"))
