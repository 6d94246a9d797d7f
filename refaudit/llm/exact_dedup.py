"""Exact dedup by distributed MSD radix partitioning.

The key of a document is its length and then its bytes. Level 0 splits all documents by the length and the first bytes;
each later level splits what is still together by the next, eight times longer, stretch of bytes, until a group is a single
document or its text has ended. Two documents that stay together to the end are equal byte for byte: no digest decides.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACES, maybe_in, spread_join, temporary, written


def squeezed(text: Column) -> Column:
    """The text without any of the six separators; null counts as empty."""
    out = F.coalesce(text.cast("string"), F.lit(""))
    for c in SPACES:
        out = F.replace(out, F.lit(c), F.lit(""))
    return out


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", first: int = 48, factor: int = 8) -> DataFrame:
    """One row per row of docs: doc_id, keep_id, group_size, kept, text_sha256, and n_chars, the original's code points.

    Texts are equal when they are after deleting the separators; null equals empty. Of each group the row with most code
    points in its original text stays, then the smallest doc_id (a null id comes last); of repeated rows that tie in both, one
    stays. Only rows that share length and first bytes with another row carry their text any further: a bit map of those
    keys, of fixed size, keeps nearly all others out of the shuffle of texts. Each level aggregates before its shuffle, and
    where rows meet their group again, those of a hot group are dealt to cells.
    """
    norm = squeezed(F.col(text_col))
    base = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.char_length(F.col(text_col).cast("string")), F.lit(0)).cast("long").alias("n_chars"), norm.cast("binary").alias("_b"))
    size, head = F.octet_length("_b").cast("long"), F.substring("_b", 1, first)
    same = base.groupBy(size.alias("_n"), head.alias("_p")).agg(F.count("*").alias("_c"))
    with temporary():
        shared = written(same.where("_c > 1").select("_n", "_p", F.col("_c").alias("_count")))
        mates = shared.agg(F.coalesce(F.sum("_count"), F.lit(0))).first()[0]
        slim = maybe_in(base.withColumns({"_n": size, "_p": head}), F.xxhash64("_n", "_p"), shared.select(F.xxhash64("_n", "_p").alias("_h")))
        # The same plan at every size; a merge join spills where a hash join would have to hold its side in memory.
        tried = slim.where("_maybe").withColumn("_salt0", F.monotonically_increasing_id())
        found = spread_join(tried, shared.withColumn("_hit", F.lit(True)), ["_n", "_p"], "_salt0", mates, "left", "merge")
        # Written with an own number for each row: what follows refers to rows by it. A row that is alone drops its text.
        alone = F.col("_hit").isNull()
        shape = ["doc_id", "n_chars", F.sha2("_b", 256).alias("text_sha256"), "_n"]
        kept = found.select(*shape, F.when(alone, None).otherwise(F.col("_p")).alias("_p"), F.when(alone | (F.col("_n") <= first), None).otherwise(F.col("_b")).alias("_b"), alone.alias("_alone"))
        rest = slim.where("not _maybe").select(*shape, F.lit(None).cast("binary").alias("_p"), F.lit(None).cast("binary").alias("_b"), F.lit(True).alias("_alone"))
        rows = written(kept.union(rest).withColumn("_row", F.monotonically_increasing_id()))
        groups = rows.where("not _alone").select("_row", "_n", "_p")
        ids = groups.groupBy("_n", "_p").agg(F.min("_row").alias("_class"), F.count("*").alias("_count"))
        state = written(spread_join(groups, ids, ["_n", "_p"], "_row", mates).select("_row", "_class", "_n"))
        at, width = first, first * factor
        while True:
            # Classes that have ended need no further level, nor have those of one row.
            open_rows = state.where(F.col("_n") > at)
            many = open_rows.groupBy("_class").agg(F.count("*").alias("_count")).where("_count > 1")
            if many.isEmpty():
                break
            part = spread_join(open_rows, many, ["_class"], "_row", mates).select("_row", "_class").join(rows.where("_b is not null").select("_row", F.substring("_b", at + 1, width).alias("_p")), "_row")
            part = written(part.select("_row", "_class", "_p"))
            split = part.groupBy("_class", "_p").agg(F.min("_row").alias("_to"), F.count("*").alias("_count"))
            moved = spread_join(part, split, ["_class", "_p"], "_row", mates).select(F.col("_row").alias("_r"), "_to")
            state = written(state.join(moved, F.col("_row") == F.col("_r"), "left").select("_row", F.coalesce("_to", "_class").alias("_class"), "_n"))
            at, width = at + width, width * factor
        labelled = written(rows.drop("_b", "_p", "_n").join(state.select(F.col("_row").alias("_r"), "_class"), F.col("_row") == F.col("_r"), "left").withColumn("_class", F.coalesce("_class", "_row")), outlive=True)
    # The best row of each class: most code points, then smallest id, nulls last, then the smallest row number.
    best = F.min(F.struct((-F.col("n_chars")).alias("a"), F.col("doc_id").isNull().alias("b"), F.col("doc_id").alias("c"), F.col("_row").alias("d"))).alias("_best")
    keep = labelled.where("not _alone").groupBy("_class").agg(best, F.count("*").alias("_count"))
    out = spread_join(labelled, keep, ["_class"], "_row", mates, "left")
    return out.select(
        "doc_id",
        F.when(F.col("_best").isNull(), F.col("doc_id")).otherwise(F.col("_best.c")).alias("keep_id"),
        F.coalesce("_count", F.lit(1)).cast("long").alias("group_size"),
        F.coalesce(F.col("_best.d") == F.col("_row"), F.lit(True)).alias("kept"),
        "text_sha256",
        "n_chars",
    )
