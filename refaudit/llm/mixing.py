"""Mixing sources to target weights by a low-discrepancy schedule.

Each source's documents are shuffled by a hash and laid end to end; that stream of words is cut into equal blocks. Slot i
of the schedule has the golden-ratio point frac(i * phi); mapped through the sources' cumulative weights it names a source,
and its rank among that source's slots names the block to take, starting over when the source has been taken whole. So any
stretch of the schedule holds the sources in nearly their target shares, and nothing depends on a random generator.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import in_order, running, spread, spread_join, words, written

#: frac(i * phi) in 31 bits: i times the odd number next to 2**31 / phi, modulo 2**31.
_GOLDEN, _RANGE = 1327217885, 1 << 31


def targets(sizes: DataFrame, weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """sizes (source, source_size) with `target`: sources by code point, null last, get the weights in turn and share
    `share` times all sizes; a target stops at `most` times its source's size and the excess goes to the others by weight.

    The level at which all of it is shared is found in one pass over the sources sorted by how early they stop: a source's
    target is min(most * size, weight * level). Sources may be many: ranks and sums in order come from range partitions.
    """
    if share > most:
        raise ValueError("share exceeds most: the sources can't supply that much")
    n, whole = sizes.agg(F.count("*"), F.coalesce(F.sum("source_size"), F.lit(0))).first()
    name = [F.col("source").isNull(), F.encode("source", "UTF-8")]
    t = in_order(sizes.select("source", "source_size"), name, {"_rank": F.lit(1).cast("long")}, n)
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.pmod(F.col("_rank"), F.lit(len(weights))) + 1).cast("int"))
    t = t.withColumns({"weight": w, "_cap": F.col("source_size") * most})
    # Sorted by cap / weight: if the first k stop, the level is (total - their caps) / (weights of the rest).
    all_weights = t.agg(F.sum("weight")).first()[0] or 0.0
    t = written(in_order(t, [F.col("_cap") / F.col("weight"), *name], {"_caps": F.col("_cap"), "_weights": F.col("weight"), "_place": F.lit(1).cast("long")}, n))
    level = (F.lit(whole * share) - F.col("_caps")) / (F.lit(all_weights) - F.col("_weights"))
    held = t.withColumn("_level", level).where(F.col("_cap") >= F.col("weight") * F.col("_level")).agg(F.min_by("_level", "_place")).first()[0]
    target = F.col("_cap") if held is None else F.least("_cap", F.col("weight") * F.lit(held))
    return t.select("source", "source_size", "weight", target.alias("target"))


def schedule(plan: DataFrame, n_slots: int) -> DataFrame:
    """Slots for a plan of (source, need, and more): slot, rank and the plan's columns. n_slots golden-ratio points are mapped
    through the cumulative needs and ranked within their source; points a source doesn't need are dropped and missing ones
    added at the end.

    Points meet the sources' stretches in equal cells of the range, as many as grow with the slots: in a cell, a point takes
    the stretch that starts last before it. Ranks come from counts per stretch of slots and a window within each. So no
    source's slots meet in one task, and neither do all sources.
    """
    spark = plan.sparkSession
    columns = plan.columns
    cells = 1 << max(4, (spread(n_slots) - 1).bit_length())  # a power of two, so that points and cells are exact
    n, total = plan.where("need > 0").agg(F.count("*"), F.coalesce(F.sum("need"), F.lit(0))).first()
    p = plan.where("need > 0").select(F.struct(*columns).alias("_plan"))
    p = in_order(p, [F.col("_plan.source").isNull(), F.encode("_plan.source", "UTF-8")], {"_from": F.col("_plan.need")}, n)
    total = max(1, total)
    p = written(p.select("_plan", (F.col("_from") / total).alias("_lo"), ((F.col("_from") + F.col("_plan.need")) / total).alias("_hi")))
    starts = p.select("_plan", "_lo", F.explode(F.sequence(F.floor(F.col("_lo") * cells), F.least(F.floor(F.col("_hi") * cells), F.lit(cells - 1)))).alias("_cell"))
    starts = starts.select("_cell", F.greatest("_lo", F.col("_cell") / cells).alias("_u"), "_lo", "_plan", F.lit(None).cast("long").alias("slot"))
    point = ((F.col("id").bitwiseAND(_RANGE - 1) * _GOLDEN).bitwiseAND(_RANGE - 1) / F.lit(_RANGE)).alias("_u")
    points = spark.range(n_slots).select(F.col("id").alias("slot"), point).select(F.floor(F.col("_u") * cells).alias("_cell"), "_u", F.lit(None).cast("double").alias("_lo"), F.lit(None).cast(p.schema["_plan"].dataType).alias("_plan"), "slot")
    so_far = Window.partitionBy("_cell").orderBy("_u", F.col("slot").isNotNull(), "_lo").rowsBetween(Window.unboundedPreceding, 0)
    slots = starts.union(points).withColumn("_own", F.last("_plan", ignorenulls=True).over(so_far)).where("slot is not null").select("slot", "_own")
    slots = slots.withColumns({"_source": F.to_json(F.struct("_own.source")), "_part": F.floor(F.col("slot") / spread(n_slots, 64))})
    counts = written(slots.groupBy("_part", "_source").agg(F.count("*").alias("_n")))
    before = Window.partitionBy("_source").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.select(F.col("_part").alias("_p"), F.col("_source").alias("_s"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    ranked = slots.withColumn("_r", F.row_number().over(Window.partitionBy("_part", "_source").orderBy("slot")) - 1)
    ranked = ranked.join(base, (F.col("_part") == F.col("_p")) & (F.col("_source") == F.col("_s"))).withColumn("rank", F.col("_r") + F.col("_base"))
    kept = ranked.where(F.col("rank") < F.col("_own.need")).select("slot", "rank", "_own.*")
    got = counts.groupBy("_source").agg(F.sum("_n").alias("_got"))
    short = p.select("_plan", F.to_json(F.struct("_plan.source")).alias("_source")).join(got, "_source", "left").withColumn("_got", F.coalesce("_got", F.lit(0)))
    added = short.where(F.col("_got") < F.col("_plan.need")).select("_plan", F.explode(F.sequence(F.col("_got"), F.col("_plan.need") - 1)).alias("rank"))
    return kept.union(added.select((F.lit(n_slots) + F.col("rank")).alias("slot"), "rank", "_plan.*"))


def mix(docs: DataFrame, weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, most: float = 2.0, block: int = 1024, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", shuffle_col: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(laid, taken): `laid` has a row per document: doc_id, source, size (words), start (its first word's place in its
    source's stream), source_size, target. `taken` has a row per stretch of a document that a slot takes: slot, rank,
    doc_id, source, start, size, first_word, n_words; read by slot, it is the mix.

    The last block of a source's last pass is cut where the target is reached, so a source's taken words are its target
    without the fraction, and no document is taken more than `most` times. Documents are shuffled
    by the hash of shuffle_col (the id unless given). A null source is a source; null and empty texts
    have no words and are never taken; a null id is hashed like a value; repeated rows are laid out one after another and
    rows that tie in hash, id and size are interchangeable. No rows, or no words, give no slots.
    """
    h = F.xxhash64(F.col(shuffle_col or id_col), F.lit("mix"))
    slim = written(docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), words(F.col(text_col)).alias("size"), h.alias("_h")))
    sizes = written(slim.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("_count")))
    plan = targets(sizes, weights, share, most)
    s, t = F.col("source_size"), F.floor(F.col("target") + 1e-6)
    passes = F.when(s > 0, F.floor(t / s)).otherwise(0)
    blocks = F.ceil(s / F.lit(block))
    plan = plan.withColumn("_blocks", blocks).withColumn("_target", t).withColumn("need", F.coalesce(passes * F.col("_blocks") + F.ceil((F.col("_target") - passes * s) / F.lit(block)), F.lit(0)).cast("long"))
    plan = written(plan)
    n_slots, n_rows = plan.agg(F.coalesce(F.sum("need"), F.lit(0))).first()[0], slim.count()
    laid = running(slim, ["source"], ["_h", "doc_id", "size"], "size", "start", spread(n_rows), "_h")
    # A null source has a key as well; the rows of a large source meet its numbers in several cells.
    own = plan.select("source", "source_size", "target").join(sizes.select(F.col("source").alias("_s"), "_count"), F.col("source").eqNullSafe(F.col("_s"))).select(F.to_json(F.struct("source")).alias("_key"), "source_size", "target", "_count")
    laid = spread_join(laid.withColumn("_key", F.to_json(F.struct("source"))), own, ["_key"], "start", n_rows)
    laid = written(laid.select("doc_id", "source", "size", "start", "source_size", "target"))
    slots = schedule(plan.select("source", "need", "source_size", "_blocks", "_target"), n_slots)
    # A slot takes the words [from, to) of its source's stream.
    which = F.pmod("rank", F.col("_blocks"))
    done = F.floor(F.col("rank") / F.col("_blocks")) * F.col("source_size")
    start = which * block
    end = F.least(start + block, F.col("source_size"), F.col("_target") - done)
    slots = slots.select("slot", F.col("rank"), F.col("source").alias("_source"), which.alias("_block"), start.alias("_from"), end.alias("_to")).where("_to > _from")
    over = laid.where("size > 0").withColumn("_b", F.explode(F.sequence(F.floor(F.col("start") / block), F.floor((F.col("start") + F.col("size") - 1) / block))))
    hit = over.join(slots, F.col("source").eqNullSafe(F.col("_source")) & (F.col("_b") == F.col("_block")))
    first, last = F.greatest("start", "_from"), F.least(F.col("start") + F.col("size"), F.col("_to"))
    taken = hit.where(last > first).select("slot", "rank", "doc_id", "source", "start", "size", (first - F.col("start")).alias("first_word"), (last - first).alias("n_words"))
    return laid, taken


def taken_words(laid: DataFrame, taken: DataFrame) -> DataFrame:
    """A row per document: doc_id, source, size, source_size, target, taken (words the mix takes, repeats counted)."""
    sums = taken.groupBy(F.col("source").alias("_s"), F.col("start").alias("_at")).agg(F.sum("n_words").alias("_taken"))
    at = F.when(F.col("size") > 0, F.col("start"))
    out = laid.join(sums, F.col("source").eqNullSafe(F.col("_s")) & (at == F.col("_at")), "left")
    return out.select("doc_id", "source", "size", "source_size", "target", F.coalesce("_taken", F.lit(0)).cast("long").alias("taken"))
