"""Sharding by balanced label propagation.

`shard` takes links as keys: documents that share one are linked. Documents start evenly dealt. Then each round every linked
document would move to the shard that holds most of its neighbours; a shard admits movers only up to its quota, those that gain
most first, so that sizes stay even. Keys that are still cut when few moves or none are admitted, for want of room, are placed
anew in the room that the others leave, and propagation goes on from there. Documents without a neighbour then fill what is left. The state is kept as counts per (link key, shard), since linked documents
of one key and shard are interchangeable: a key's neighbours are never listed in pairs.

`shard_linked` takes any table of links. Documents start evenly dealt; each round those with more neighbours in another shard
ask to move there, and a shard admits as many as it has room for or can swap for others, those that gain most first.
"""

from __future__ import annotations

from itertools import count

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import running, spread, spread_join, written


def _plan(kinds: list[tuple[int, int]], room: list[int]) -> list[tuple[int, int, int, int, int]]:
    """Where keys go: rows (size, from, to, shard, n), n documents of each of the keys numbered from .. to - 1 among those of
    this size. kinds: (size, number of keys); room: free places by shard.

    Sizes by falling order; a key goes whole to the first shard with room for it. One larger than all quotas takes the
    roomiest shards; one that has no room whole when its turn comes is cut over the roomiest shards at the end.
    """
    room, plan, late, most = list(room), [], [], max(room, default=0)

    def cut(size: int, at: int) -> None:
        left = size
        while left:
            to = max(range(len(room)), key=lambda s: room[s])
            n = min(left, room[to])
            plan.append((size, at, at + 1, to, n))
            room[to] -= n
            left -= n

    for size, keys in sorted(kinds, reverse=True):
        at = 0
        if size > most:
            for at in range(keys):
                cut(size, at)
            continue
        for to in range(len(room)):
            fit = min(keys - at, room[to] // size)
            if fit:
                plan.append((size, at, at + fit, to, size))
                room[to] -= fit * size
                at += fit
        late += [(size, x) for x in range(at, keys)]
    for size, at in late:
        cut(size, at)
    return plan


def _dealt(linked: DataFrame, shards: int, cells: int) -> DataFrame:
    """Counts (_key, shard, n) of the linked rows (_row, _h, _key), dealt evenly by hash: no shard gets more than its quota."""
    rows = running(linked.withColumn("_one", F.lit(1)), [], ["_h", "_row"], "_one", "_place", cells, "_h")
    return rows.groupBy("_key", F.pmod("_place", F.lit(shards)).cast("int").alias("shard")).agg(F.count("*").alias("n"))


def _mended(counts: DataFrame, quota: DataFrame) -> DataFrame:
    """counts (_key, shard, n) with the keys that are still cut placed anew in what room the others leave, whole as far as they
    fit, if that cuts fewer links. The driver sees the number of such keys of each size: sizes that differ are few, at most the
    square root of twice the rows."""
    own = counts.groupBy("_key").agg(F.count("*").alias("_parts"), F.sum("n").cast("long").alias("_all"), F.sum(F.col("n") * F.col("n")).alias("_kept"))
    cut = written(own.where("_parts > 1"))
    kinds = [tuple(r) for r in cut.groupBy("_all").agg(F.count("*"), F.sum("_kept")).collect()]
    if not kinds:
        return counts
    whole = counts.join(cut.select("_key"), "_key", "left_anti").select("_key", "shard", "n")
    plan = _plan([(size, keys) for size, keys, _ in kinds], _rooms(whole, "n", quota)[0])
    if sum((end - at) * n * n for _, at, end, _, n in plan) <= sum(kept for _, _, kept in kinds):
        return counts
    rows = counts.sparkSession.createDataFrame(plan, "_size long, _from long, _to long, shard int, n long")
    one = cut.select("_key", "_all", F.lit(1).alias("_one"), F.xxhash64("_key").alias("_h"))
    one = running(one, ["_all"], ["_h", "_key"], "_one", "_place", spread(sum(keys for _, keys, _ in kinds)), "_h")
    placed = one.join(F.broadcast(rows), (F.col("_all") == F.col("_size")) & (F.col("_place") >= F.col("_from")) & (F.col("_place") < F.col("_to")))
    return written(whole.union(placed.select("_key", "shard", "n")))


def _octaves(c: str):
    """0 for the largest values, one more for each halving."""
    return F.lit(63) - F.floor(F.log2(F.col(c).cast("double") + 1)).cast("int")


def propagate(counts: DataFrame, quota: DataFrame, rounds: int | None = None, cells: int = 64, least: int = 1) -> DataFrame:
    """Moves counts (_key, shard, n) towards each key's fullest shard under quota (shard, room), until no move is admitted,
    or moves of fewer than `least` rows in a round (at most `rounds` times, if given). It ends: a move makes a key's larger part larger, so the sum of squares of n grows.

    In a round, a key's shards are taken by how much of it they hold (ties: one with room first, then by hash). As many of
    them as it takes to hold all of the key are its targets, for nearly all keys one; its documents elsewhere ask to move to
    those targets that have room. A shard admits requests in order of gain
    until its room is used; a request that fits in part moves in part. Within a shard's requests the running sums come from
    `cells` cells by hash of the key, so no shard's requests meet in one task.
    """
    for k in range(rounds) if rounds is not None else count():
        load = counts.groupBy(F.col("shard").alias("_s")).agg(F.sum("n").alias("_load"))
        room = quota.join(load, F.col("shard") == F.col("_s"), "left").select(F.col("shard").alias("_to"), (F.col("room") - F.coalesce("_load", F.lit(0))).alias("_room")).where("_room > 0")
        # Each key's parts by falling count: the first ones that can take all of it are its targets, the others move there.
        tie = F.xxhash64("_key", F.lit(k // 2), F.col("shard"))
        own = Window.partitionBy("_key").orderBy(F.desc("n"), F.desc(F.col("_room") > 0), tie, "shard")
        before = own.rowsBetween(Window.unboundedPreceding, -1)
        so_far = lambda x: F.coalesce(F.sum(x).over(before), F.lit(0))
        parts = counts.join(F.broadcast(room), F.col("shard") == F.col("_to"), "left").withColumn("_room", F.coalesce("_room", F.lit(0)))
        parts = parts.withColumns({"_total": F.sum("n").over(Window.partitionBy("_key")), "_held": so_far(F.col("n") + F.col("_room")), "_spare": so_far("_room")})
        parts = parts.withColumn("_target", F.col("_held") < F.col("_total"))
        parts = parts.withColumn("_at", so_far(F.when(~F.col("_target"), F.col("n")).otherwise(0)))
        goals = parts.where("_target and _room > 0").groupBy(F.col("_key").alias("_k")).agg(F.array_sort(F.collect_list(F.struct("_spare", "shard", "n"))).alias("_goals"))
        asks = parts.where("not _target").join(goals, F.col("_key") == F.col("_k"))
        goal = F.array_max(F.filter("_goals", lambda g: g["_spare"] <= F.col("_at")))
        asks = asks.withColumn("_goal", goal).select("_key", "shard", F.col("_goal.shard").alias("_to"), "n", F.greatest(F.col("_goal.n") - F.col("n"), F.lit(0)).alias("_gain"), F.xxhash64("_key").alias("_h"))
        asks = running(asks, ["_to"], ["_h", "shard"], "n", "_before", cells, "_h", _octaves("_gain"))
        moved = written(asks.join(F.broadcast(room), "_to").withColumn("_m", F.greatest(F.lit(0), F.least("n", F.col("_room") - F.col("_before")))).where("_m > 0"))
        size = moved.agg(F.sum("_m")).first()[0] or 0
        if not size:
            break
        both = moved.select("_key", "shard", (-F.col("_m")).alias("n")).union(moved.select("_key", F.col("_to").alias("shard"), F.col("_m").alias("n")))
        counts = written(counts.select("_key", "shard", "n").union(both).groupBy("_key", "shard").agg(F.sum("n").cast("long").alias("n")).where("n > 0"))
        if size < least:
            break
    return counts


def shard(docs: DataFrame, key_cols: list[str], shards: int = 40, rounds: int | None = None, id_col: str = "doc_id") -> DataFrame:
    """docs with `shard` (0 to shards - 1) and `slot` (gapless from 0 within the shard); counts differ by at most one. Columns
    of docs that are called so are replaced.

    Rows with equal values in all key_cols are linked (a null in one: not linked). Each shard's quota is the number of rows
    over shards, rounded up for the first ones. Linked rows come first: label propagation moves them
    together from an even deal as far as quotas allow, and keys that lacked room for that are placed anew, the largest first, so
    a key stays cut only when it is larger than a shard or no shard has room left for it when its turn comes. Repeated rows
    and null ids are rows like others; with fewer rows than shards some shards are empty. Texts aren't needed here: give
    docs with the columns to return.
    """
    h = F.xxhash64(*[F.col(c) for c in [id_col, *key_cols]], F.lit("shard"))
    # The caller's columns travel in a struct, so that none of their names can clash with those used here.
    names = [c for c in docs.columns if c not in ("shard", "slot")]
    base = docs.select(F.struct(*names).alias("_doc"), h.alias("_h"), *[F.col(c).alias(f"_c{i}") for i, c in enumerate(key_cols)])
    base = written(base.withColumn("_row", F.monotonically_increasing_id()))
    key_cols = [f"_c{i}" for i in range(len(key_cols))]
    total = base.count()
    quota = _quota(docs.sparkSession, total, shards)
    known = None
    for c in key_cols:
        known = F.col(c).isNotNull() if known is None else known & F.col(c).isNotNull()
    key = F.xxhash64(*[F.col(c) for c in key_cols], F.lit("key"))
    keyed = base.where(known).withColumn("_key", key)
    sizes = keyed.groupBy("_key").agg(F.count("*").alias("_count")).where("_count > 1")
    linked = spread_join(keyed.select("_row", "_h", "_key"), sizes, ["_key"], "_row", total)
    linked = written(linked.select("_row", "_h", "_key"))
    counts = written(_dealt(linked, shards, spread(total, times=16)))
    # Where nearly all rows are linked a round moves one or two of them; what is cut then is mended at once.
    moved = propagate(counts, quota, rounds, spread(total, 64), linked.count() // 64)
    counts = _mended(moved, quota)
    if counts is not moved:
        counts = propagate(counts, quota, rounds, spread(total, 64))
    # Deal each key's documents to its shards by their place within the key; free documents take what is left.
    within = running(linked.withColumn("_one", F.lit(1)), ["_key"], ["_h", "_row"], "_one", "_place", spread(total), "_h")
    spans = counts.withColumn("_end", F.sum("n").over(Window.partitionBy("_key").orderBy("shard"))).withColumn("_span", F.struct((F.col("_end") - F.col("n")).alias("from"), F.col("_end").alias("end"), "shard"))
    spans = spans.groupBy("_key").agg(F.collect_list("_span").alias("_spans"), F.sum("n").alias("_count"))
    own = F.get(F.filter("_spans", lambda s: (s["from"] <= F.col("_place")) & (F.col("_place") < s["end"])), F.lit(0))["shard"]
    placed = spread_join(within, spans, ["_key"], "_row", total).select(F.col("_row").alias("_r"), own.alias("_linked"))
    return _filled(base, placed, *_rooms(counts, "n", quota), total)


def _filled(base: DataFrame, placed: DataFrame, room: list[int], load: list[int], total: int) -> DataFrame:
    """base's documents with shard and slot: those of placed (_r, _linked) first in their shard, the others in what is free."""
    marked = written(base.join(placed, F.col("_row") == F.col("_r"), "left").drop("_r"))
    free = running(marked.where("_linked is null").withColumn("_one", F.lit(1)), [], ["_h", "_row"], "_one", "_place", spread(total, times=16), "_h")
    free = free.withColumn("shard", _cell_of(F.col("_place"), room))
    used = F.array(*[F.lit(x) for x in load])
    starts = F.array(*[F.lit(x) for x in [0, *_ends(room)]])
    free = free.select("_doc.*", "shard", (F.col("_place") - F.get(starts, F.col("shard")) + F.get(used, F.col("shard"))).alias("slot"))
    held = running(marked.where("_linked is not null").withColumn("_one", F.lit(1)), ["_linked"], ["_h", "_row"], "_one", "slot", spread(total), "_h")
    return held.select("_doc.*", F.col("_linked").alias("shard"), "slot").union(free)


def _quota(spark: SparkSession, total: int, shards: int) -> DataFrame:
    low, more = divmod(total, shards)
    return spark.range(shards).select(F.col("id").cast("int").alias("shard"), (F.lit(low) + (F.col("id") < more).cast("int")).cast("long").alias("room"))


def propagate_links(labels: DataFrame, both: DataFrame, quota: DataFrame, n_links: int, cells: int = 64, rounds: int = 40, patience: int = 3) -> tuple[DataFrame, int, int]:
    """(labels, cut at first, cut now) for labels (node, shard) and links in both directions (u, v), under quota (shard, room).

    A round counts each node's neighbours by shard; a node with more of them in another shard than in its own asks to move
    there, in a round that its hash picks, so that two neighbours don't change places for ever. Of the requests from one shard
    to another as many go, by falling gain, as come the other way; what is left goes where there is room. It ends when no
    link is cut, no round of `patience` made the cut smaller, or after `rounds`; the best labels met are returned.
    """
    best, least, first, tired = labels, None, 0, 0
    for k in range(rounds):
        known = labels.join(both.groupBy(F.col("v").alias("node")).agg(F.count("*").alias("_count")), "node").withColumnRenamed("node", "v")
        votes = spread_join(both, known, ["v"], "u", 2 * n_links).groupBy("u", "shard").agg(F.count("*").alias("n"))
        votes = votes.join(labels.select(F.col("node").alias("u"), F.col("shard").alias("_own")), "u")
        top = F.max(F.struct("n", F.xxhash64("u", "shard", F.lit(k)).alias("tie"), "shard"))
        state = written(votes.groupBy("u").agg(top.alias("_best"), F.coalesce(F.max(F.when(F.col("shard") == F.col("_own"), F.col("n"))), F.lit(0)).alias("_n"), F.first("_own").alias("_own"), F.sum("n").alias("_all")))
        cut = (state.agg(F.sum(F.col("_all") - F.col("_n"))).first()[0] or 0) // 2
        first = cut if least is None else first
        if least is None or cut < least:
            best, least, tired = labels, cut, 0
        else:
            tired += 1
        if not cut or tired == patience:
            break
        turn = F.pmod(F.xxhash64("u", F.lit(k // 2)), F.lit(2)) == k % 2
        asks = state.where((F.col("_best.n") > F.col("_n")) & turn).select(F.col("u").alias("node"), F.col("_own").alias("shard"), F.col("_best.shard").alias("_to"), (F.col("_best.n") - F.col("_n")).alias("_gain"), F.xxhash64("u").alias("_h"), F.lit(1).alias("_one"))
        # As many rows as pairs of shards.
        flow = asks.groupBy("shard", "_to").agg(F.count("*").alias("_f"))
        back = flow.select(F.col("shard").alias("_to"), F.col("_to").alias("shard"), F.col("_f").alias("_m"))
        asks = running(asks, ["shard", "_to"], ["_h", "node"], "_one", "_i", cells, "_h", _octaves("_gain"))
        asks = written(asks.join(F.broadcast(back), ["shard", "_to"], "left").withColumn("_swap", F.col("_i") < F.coalesce("_m", F.lit(0))))
        load = labels.groupBy("shard").agg(F.count("*").alias("_load"))
        room = quota.join(load, "shard", "left").select(F.col("shard").alias("_to"), (F.col("room") - F.coalesce("_load", F.lit(0))).alias("_room"))
        rest = running(asks.where("not _swap").select("node", "_to", "_gain", "_h", "_one"), ["_to"], ["_h", "node"], "_one", "_j", cells, "_h", _octaves("_gain"))
        moved = asks.where("_swap").select("node", "_to").union(rest.join(F.broadcast(room), "_to").where("_j < _room").select("node", "_to"))
        labels = written(labels.join(moved, "node", "left").select("node", F.coalesce("_to", "shard").alias("shard")))
    return best, first, least or 0


def shard_linked(docs: DataFrame, links: DataFrame, shards: int = 40, id_col: str = "doc_id", rounds: int = 40) -> tuple[DataFrame, int, int]:
    """(docs with shard and slot as `shard` gives them, links cut by an even deal, links cut now) for links (a, b) of ids.

    Links count once, in either direction; those of a row to itself, with a null or an id that docs don't have, don't count.
    Of rows that share an id the first is the linked one, the others are free. Counts per shard differ by at most one.
    """
    names = [c for c in docs.columns if c not in ("shard", "slot")]
    base = docs.select(F.struct(*names).alias("_doc"), F.xxhash64(F.col(id_col), F.lit("shard")).alias("_h"), F.col(id_col).alias("_id"))
    base = written(base.withColumn("_row", F.monotonically_increasing_id()))
    total = base.count()
    quota = _quota(docs.sparkSession, total, shards)
    ids = base.where("_id is not null").groupBy("_id").agg(F.min("_row").alias("node"))
    once = written(links.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    n_links = once.count()
    for end, new in (("a", "u"), ("b", "v")):
        known = once.groupBy(end).agg(F.count("*").alias("_count")).join(ids.withColumnsRenamed({"_id": end, "node": new}), end)
        other = "b" if end == "a" else "u"
        once = written(spread_join(once, known, [end], other, n_links).select(*(["u", "b"] if end == "a" else ["u", "v"])))
    both = written(once.union(once.select(F.col("v").alias("u"), F.col("u").alias("v"))))
    nodes = both.select(F.col("u").alias("node")).distinct().withColumns({"_h": F.xxhash64("node", F.lit("deal")), "_one": F.lit(1)})
    nodes = running(nodes, [], ["_h", "node"], "_one", "_place", spread(total, times=16), "_h")
    labels = written(nodes.select("node", F.pmod("_place", F.lit(shards)).cast("int").alias("shard")))
    labels, first, cut = propagate_links(labels, both, quota, n_links, spread(total, 64), rounds)
    placed = labels.select(F.col("node").alias("_r"), F.col("shard").alias("_linked"))
    return _filled(base, placed, *_rooms(labels.withColumn("n", F.lit(1)), "n", quota), total), first, cut


def cut_links(placed: DataFrame, key_cols: list[str]) -> DataFrame:
    """One row: links (pairs of rows with equal, non-null key_cols) and cut (those of them in different shards)."""
    known = placed.dropna(subset=key_cols)
    parts = known.groupBy(*[F.col(c).alias(f"_c{i}") for i, c in enumerate(key_cols)], F.col("shard")).agg(F.count("*").alias("n"))
    keys = parts.groupBy(*[f"_c{i}" for i in range(len(key_cols))]).agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("n")).alias("s"))
    pairs = lambda x: F.coalesce(F.sum(x), F.lit(0)).cast("long")
    return keys.agg(pairs((F.col("n") * F.col("n") - F.col("n")) / 2).alias("links"), pairs((F.col("n") * F.col("n") - F.col("s")) / 2).alias("cut"))


def _ends(room: list[int]) -> list[int]:
    total, out = 0, []
    for x in room:
        total += x
        out.append(total)
    return out


def _cell_of(place, room: list[int]):
    """The shard whose free places, laid end to end in the order of shards, hold `place`."""
    return F.size(F.filter(F.array(*[F.lit(x) for x in _ends(room)]), lambda e: e <= place))


def _rooms(counts: DataFrame, value, quota: DataFrame) -> tuple[list[int], list[int]]:
    """(free places, places used) of each shard: as many numbers as shards, on the driver."""
    load = counts.groupBy(F.col("shard").alias("_s")).agg(F.sum(value).alias("_load"))
    rows = quota.join(load, F.col("shard") == F.col("_s"), "left").select("shard", "room", F.coalesce("_load", F.lit(0)).alias("_load")).collect()
    rows = sorted(rows)
    return [r[1] - r[2] for r in rows], [r[2] for r in rows]
