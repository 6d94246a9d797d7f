"""Shared pieces: intermediate tables where all executors see them, running sums, hot keys, and connected components."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..tables import _tables, release, shared_dir, temporary, written  # noqa: F401  the operators' way to them

#: What separates words in every contract here: space and the five ASCII controls from tab to carriage return.
SPACES = " \t\n\x0b\f\r"
WORD = r"[^\x20\x09-\x0D]+"
#: A key is hot if it holds more than this share of the rows (and this many), so there are at most SPLIT hot keys.
SPLIT, LEAST_HOT = 1 << 10, 1 << 8
#: Hot keys are dealt to this many cells.
SALTS = 64

def words(text: Column) -> Column:
    """Number of words; null counts as no text."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def each(column, step: int = 256):
    """The values of an Arrow column, made into Python objects a few at a time: texts of a batch are never all there twice."""
    for at in range(0, len(column), step):
        yield from column.slice(at, step).to_pylist()


def spread(n_rows: int, low: int = 1, times: int = 1) -> int:
    """Number of cells that n_rows are dealt to: the square root, so that both a cell and the table of cells stay small, or
    some times that where rows have no key besides and each task should have several cells."""
    return max(low, int(times * max(n_rows, 1) ** 0.5))


def in_order(df: DataFrame, order: list[Column], sums: dict[str, Column], rows: int, part_rows: int = 100_000) -> DataFrame:
    """Adds for each of `sums` its total over the rows before, in a global order: range partitions, the sums within each, and
    the sums of those before from one row a partition. The order should leave no ties."""
    names = [f"_o{i}" for i in range(len(order))]
    kept = df.columns
    df = df.withColumns({n: c for n, c in zip(names, order, strict=True)} | {f"_v_{k}": c for k, c in sums.items()})
    df = written(df.repartitionByRange(max(1, -(-rows // part_rows)), *names).withColumn("_part", F.spark_partition_id()))
    before = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    zero = lambda c: F.coalesce(c, F.lit(0))
    parts = df.groupBy("_part").agg(*[F.sum(f"_v_{k}").alias(f"_p_{k}") for k in sums])
    parts = parts.select(F.col("_part").alias("_at"), *[zero(F.sum(f"_p_{k}").over(before(Window.orderBy("_part")))).alias(f"_p_{k}") for k in sums])
    own = before(Window.partitionBy("_part").orderBy(*names))
    df = df.withColumns({f"_v_{k}": zero(F.sum(f"_v_{k}").over(own)) for k in sums})
    return df.join(parts, F.col("_part") == F.col("_at")).select(*kept, *[(F.col(f"_v_{k}") + F.col(f"_p_{k}")).alias(k) for k in sums])


def running(df: DataFrame, keys: list[str], order: list[str], value: str, out: str, cells: int, cell_hash: str, first: Column | None = None) -> DataFrame:
    """Adds `out`: the sum of `value` over the rows of the same keys that come before, without ever gathering a key.

    Rows are ordered by `first` (an int of few values, if given), by a cell of the 64-bit `cell_hash`, then by `order`. Sums within a cell come from a window over
    (keys, cell); the cells' own offsets from a window over the small table of sums per cell. Rows that tie in all of
    `order` are interchangeable.
    """
    cell = F.pmod(F.shiftrightunsigned(F.col(cell_hash), 20), F.lit(cells))
    df = df.withColumn("_cell", cell if first is None else cell + first.cast("long") * cells)
    sums = df.groupBy(*keys, "_cell").agg(F.sum(value).alias("_sum"))
    before = Window.partitionBy(*keys).orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col("_cell").alias("_c"), F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_base"))
    within = Window.partitionBy(*keys, "_cell").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    df = df.withColumn("_within", F.coalesce(F.sum(value).over(within), F.lit(0)))
    on = F.col("_cell") == F.col("_c")
    for i, k in enumerate(keys):
        on = on & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    kept = [c for c in df.columns if c not in ("_cell", "_within")]
    return df.join(sums, on).select(*kept, (F.col("_base") + F.col("_within")).cast("long").alias(out))


def spread_join(rows: DataFrame, one: DataFrame, keys: list[str], salt: str, total: int, how: str = "inner", hint: str | None = None) -> DataFrame:
    """rows joined with `one` (keys, `_count`: their number of rows, and more), which has one row a key; the rows of a hot
    key meet in no one task.

    A key of more than total / SPLIT rows is hot. At most SPLIT keys are, so their list is broadcast whatever the size of
    the data; their rows are dealt to SALTS cells by the column `salt`, which varies within a key, and their row of `one` is
    copied to each cell. Rows with a null key meet none; `how` is inner or left, `hint` the kind of join.
    """
    most = max(LEAST_HOT, -(-total // SPLIT))
    same = lambda to: [F.col(k) == F.col(f"{to}{i}") for i, k in enumerate(keys)]
    renamed = lambda df, to: df.withColumnsRenamed({k: f"{to}{i}" for i, k in enumerate(keys)})
    hot = F.broadcast(renamed(one.where(F.col("_count") > most).select(*keys, F.lit(True).alias("_hot")), "_hot"))
    left = rows.join(hot, same("_hot"), "left").select(*rows.columns, F.when(F.col("_hot"), F.pmod(F.xxhash64(salt), F.lit(SALTS))).otherwise(F.lit(0)).cast("int").alias("_salt"))
    cells = F.when(F.col("_count") > most, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    right = renamed(one.withColumn("_cell", F.explode(cells)), "_own")
    right = right.hint(hint) if hint else right
    return left.join(right, [*same("_own"), F.col("_salt") == F.col("_cell")], how).drop("_salt", "_cell", *[f"_own{i}" for i in range(len(keys))])


def maybe_in(rows: DataFrame, h: Column, wanted: DataFrame, bits: int = 24) -> DataFrame:
    """rows with `_maybe`: false only if their 64-bit h is none of `wanted` (one long column, _h). A join that decides follows.

    Hashes mark a map of 2**bits bits, at most 2 MB whatever the size of the data, which is broadcast; a row that hits an
    unmarked bit is not wanted. A full map lets all rows pass, so the result after the join never depends on it.
    """
    maps = wanted.select(F.pmod("_h", F.lit(1 << bits)).alias("_at")).groupBy(F.floor(F.col("_at") / 32768).alias("_map")).agg(F.bitmap_construct_agg(F.col("_at") % 32768).alias("_bits"))
    at = rows.withColumn("_at", F.pmod(h, F.lit(1 << bits))).join(F.broadcast(maps), F.floor(F.col("_at") / 32768) == F.col("_map"), "left")
    byte = "cast(conv(hex(substring(_bits, cast(_at % 32768 as int) div 8 + 1, 1)), 16, 10) as int)"
    return at.select(*rows.columns, F.expr(f"coalesce(shiftright({byte}, cast(_at % 8 as int)) & 1 = 1, false)").alias("_maybe"))


def connected(links: DataFrame, rounds: int = 60) -> DataFrame:
    """Connected components of links (a long, b long): rows (node, root), root being the smallest node reachable.

    Alternates two steps until the edges stay the same: every node tells its larger neighbours the smallest one it knows, then
    its smaller ones. Each step is one shuffle by node, the edges of hubs dealt to cells; state between rounds is a table in
    the shared folder.
    """
    edges = written(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    n = edges.count()
    lowest = lambda e: e.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("_count"))
    for _ in range(rounds):
        both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = lowest(both).select("u", F.least("u", "m").alias("m"), "_count")
        large = spread_join(both, low, ["u"], "v", 2 * n).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        small = spread_join(large, lowest(large), ["u"], "v", 2 * n).select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.u", "e.v").where("u <> v").distinct()
        now = written(small)
        same, n = n, now.count()
        if same == n and now.join(edges, ["u", "v"], "left_anti").isEmpty():
            break
        edges = now
    else:
        raise RuntimeError("components did not settle")
    return now.groupBy("u").agg(F.min("v").alias("root")).select(F.col("u").alias("node"), "root")
