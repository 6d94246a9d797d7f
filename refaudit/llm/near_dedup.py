"""Near-duplicate detection with HyperMinHash.

A document's distinct word shingles are hashed once. The top bits name one of 128 buckets; a bucket keeps the smallest hash
that fell into it as a leading-zero count and ten mantissa bits (16 bits in all). An empty bucket borrows from the first
non-empty one in an order of its own, the same for all documents. Bands of five registers bring candidates together; their
Jaccard similarity, estimated from equal registers and corrected for chance collisions, prunes; full sets decide.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..tables import swept
from .common import connected, each, maybe_in, spread_join, temporary, written
from .shingles import WordHashes, mix64, shingle_set

BITS, MANTISSA = 7, 10
M = 1 << BITS
BANDS, ROWS = 25, 5
#: For each bucket, all buckets in a fixed order of its own: where an empty one borrows from.
_ORDER = np.argsort(mix64(np.arange(M * M, dtype=np.uint64)).reshape(M, M), axis=1)


def registers(hashes: np.ndarray) -> np.ndarray:
    """The 128 registers (uint16) of a non-empty sorted set of 64-bit hashes."""
    bucket = (hashes >> np.uint64(64 - BITS)).astype(np.int64)
    first = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1]))
    low = (hashes[first] >> np.uint64(64 - BITS - 53 if 64 - BITS > 53 else 0)) & np.uint64((1 << 53) - 1)
    length = np.frexp(low.astype(np.float64))[1]  # exact: 53 bits
    zeros = 53 - length
    mantissa = (low << zeros.astype(np.uint64)) >> np.uint64(52 - MANTISSA)
    value = (zeros << MANTISSA).astype(np.uint16) | (mantissa & np.uint64((1 << MANTISSA) - 1)).astype(np.uint16)
    out, full = np.zeros(M, np.uint16), np.zeros(M, bool)
    out[bucket[first]], full[bucket[first]] = value, True
    empty = np.flatnonzero(~full)
    if len(empty):
        order = _ORDER[empty]
        out[empty] = out[order[np.arange(len(empty)), full[order].argmax(axis=1)]]
    return out


def band_keys(regs: np.ndarray) -> np.ndarray:
    """(documents, BANDS) keys as int64 from (documents, M) registers; the lowest five bits are the number of the band."""
    parts = regs[:, : BANDS * ROWS].reshape(len(regs), BANDS, ROWS).astype(np.uint64)
    h = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64), parts.shape[:2]).copy()
    for i in range(ROWS):
        h = mix64(h * np.uint64(0x9E3779B97F4A7C15) + parts[:, :, i])
    return (h & ~np.uint64(31) | np.arange(BANDS, dtype=np.uint64)).view(np.int64)


def first_band(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The first band in which registers a (pairs, M) and b (M) agree; BANDS if there is none."""
    same = (a[:, : BANDS * ROWS].reshape(-1, BANDS, ROWS) == b[: BANDS * ROWS].reshape(BANDS, ROWS)).all(axis=2)
    return np.where(same.any(axis=1), same.argmax(axis=1), BANDS)


def collisions(n: np.ndarray) -> np.ndarray:
    """Chance that two registers over disjoint sets of n elements agree: their smallest hashes need the same leading-zero
    count and mantissa. Summed over the counts, with the minimum of k = n / M (at least one) uniform hashes."""
    k = np.maximum(1.0, n / M)[:, None]
    z = np.arange(1, 40)[None, :]
    hi, lo = 0.5 ** (z - 1), 0.5**z
    p = (1 - lo) ** k - (1 - hi) ** k
    return (p * p).sum(axis=1) / (1 << MANTISSA)


def estimate(a: np.ndarray, b: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Jaccard similarity from registers (pairs, M), corrected for collisions; n: mean set size of each pair."""
    equal = (a == b).mean(axis=1)
    c = collisions(n)
    return np.clip((equal - c) / (1 - c), 0, 1)


def _floor(threshold: float, n: np.ndarray) -> np.ndarray:
    """Estimates below this can't belong to a linked pair, but for six standard deviations."""
    return threshold - 6 * np.sqrt(threshold * (1 - threshold) / np.minimum(M, np.maximum(n, 1)))


def _overlap(a: np.ndarray, b: np.ndarray) -> int:
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    return int((b[at] == a).sum()) if len(b) else 0


def _linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    if 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
        return False
    both = _overlap(a, b)
    return 100 * both >= percent * (len(a) + len(b) - both)


class _Union(dict):
    def root(self, x: int) -> int:
        while (y := self.get(x, x)) != x:
            self[x] = self.get(y, y)
            x = y
        return x


def _regs(column) -> np.ndarray:
    return np.frombuffer(b"".join(column), "<u2").reshape(-1, M)


def sketches(docs: DataFrame, n: int, id_col: str, text_col: str) -> DataFrame:
    """doc_id, _t (a hash of the text), n_shingles, digest (of the whole set) and regs for each row."""
    import pyarrow as pa

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = WordHashes()
        for b in batches:
            size, digest, regs = [], [], []
            for text in each(b.column(2)):
                s = shingle_set(words.of(text or ""), n)
                size.append(len(s))
                digest.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None)
                regs.append(registers(s).tobytes() if len(s) else None)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(size, pa.int64()), pa.array(digest, pa.binary()), pa.array(regs, pa.binary())], ["doc_id", "_t", "n_shingles", "digest", "regs"])

    text = F.col(text_col).cast("string")
    kind = dict(docs.dtypes)[id_col]
    return docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text).alias("_t"), text.alias("text")).mapInArrow(run, f"doc_id {kind}, _t long, n_shingles long, digest binary, regs binary")


def _band_rows(reps: DataFrame) -> DataFrame:
    import pyarrow as pa

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                keys = band_keys(_regs(b.column(1).to_pylist()))
                yield pa.RecordBatch.from_arrays([pa.array(keys.ravel()), pa.array(np.repeat(b.column(0).to_numpy(), BANDS))], ["_key", "_row"])

    return reps.select("_row", "regs").mapInArrow(run, "_key long, _row long")


def _estimated(pairs: DataFrame, reps: DataFrame, percent: int) -> DataFrame:
    """Of pairs (_hub, _row), those whose estimate and set sizes allow a link."""
    import pyarrow as pa

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                na, nb = b.column(2).to_numpy(), b.column(3).to_numpy()
                est = estimate(_regs(b.column(4).to_pylist()), _regs(b.column(5).to_pylist()), (na + nb) / 2)
                ok = (100 * np.minimum(na, nb) >= percent * np.maximum(na, nb)) & (est >= _floor(percent / 100, np.minimum(na, nb)))
                yield b.select([0, 1]).filter(pa.array(ok))

    size = pairs.groupBy("_hub").agg(F.count("*").alias("_count"))
    a = size.join(reps.select(F.col("_row").alias("_hub"), F.col("n_shingles").alias("na"), F.col("regs").alias("ra")), "_hub")
    b = reps.select("_row", F.col("n_shingles").alias("nb"), F.col("regs").alias("rb"))
    both = spread_join(pairs.join(b, "_row"), a, ["_hub"], "_row", pairs.count())
    return both.select("_hub", "_row", "na", "nb", "ra", "rb").mapInArrow(run, "_hub long, _row long")


def _sets(docs: DataFrame, wanted: DataFrame, n: int, id_col: str, text_col: str) -> DataFrame:
    """(_row, set) for wanted (_row, doc_id, _t): the texts are read again and only the wanted ones are hashed; a bit map keeps
    nearly all others out of the shuffle."""
    import pyarrow as pa

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = WordHashes()
        for b in batches:
            found = [shingle_set(words.of(x or ""), n).tobytes() for x in each(b.column(1))]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found, pa.binary())], ["_row", "set"])

    text = F.col(text_col).cast("string")
    w = wanted.select(F.col("doc_id").alias("_d"), F.col("_t").alias("_t2"), "_row")
    again = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text).alias("_t"), text.alias("text"))
    again = maybe_in(again, F.col("_t"), w.select(F.col("_t2").alias("_h"))).where("_maybe")
    hit = again.join(w, (F.col("_t") == F.col("_t2")) & F.col("doc_id").eqNullSafe(F.col("_d"))).select("_row", "text")
    return hit.mapInArrow(run, "_row long, set binary").dropDuplicates(["_row"])


def _verified(pairs: DataFrame, sets: DataFrame, percent: int, share: int = 256) -> DataFrame:
    """Of pairs (_hub, _row), those linked on their full sets. A hub's set goes once to each `share` of its members."""
    many = pairs.groupBy("_hub").agg(F.ceil(F.count("*") / share).cast("int").alias("_salts"), F.count("*").alias("_count"))
    members = spread_join(pairs, many, ["_hub"], "_row", pairs.count()).withColumn("_salt", F.pmod(F.xxhash64("_row"), F.col("_salts")).cast("int"))
    left = members.join(sets, "_row").select("_hub", "_salt", "_row", "set")
    hubs = many.join(sets.withColumnRenamed("_row", "_hub"), "_hub").select("_hub", F.explode(F.sequence(F.lit(0), F.col("_salts") - 1)).alias("_salt"), F.lit(-1).cast("long").alias("_row"), "set")

    def run(part):
        is_hub = (part["_row"] == -1).to_numpy()
        hub = np.frombuffer(part["set"][is_hub].iloc[0], np.uint64)
        ok = [not h and _linked(hub, np.frombuffer(s, np.uint64), percent) for h, s in zip(is_hub, part["set"], strict=True)]
        return part.loc[ok, ["_hub", "_row"]]

    return left.union(hubs).groupBy("_hub", "_salt").applyInPandas(run, "_hub long, _row long")


def _block_pairs(members: DataFrame, block: int, rows: int) -> DataFrame:
    """members (_key, _row, _count, ...) with a row for each pair of blocks (_i <= _j) of its bucket that it takes part in, and
    the task group _g: buckets of one block share groups of about `block` of the `rows` rows, other pairs have their own."""
    m = members.withColumn("_blocks", F.ceil(F.col("_count") / block).cast("int"))
    m = m.withColumn("_b", F.pmod(F.xxhash64("_row"), F.col("_blocks")).cast("int"))
    m = m.withColumn("_o", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)))
    m = m.withColumns({"_i": F.least("_b", "_o"), "_j": F.greatest("_b", "_o")})
    few = F.pmod(F.xxhash64("_key"), F.lit(-(-rows // block) or 1))
    return m.withColumn("_g", F.when(F.col("_blocks") == 1, few).otherwise(F.xxhash64("_key", "_i", "_j"))).drop("_o", "_blocks")


def _compared(part, percent: int):
    """For each row x of the first block of the bucket `part`: (x, rows of the second block in another component whose
    estimate allows a link, the estimates). A pair is met in the first band in which it agrees, and in no other."""
    regs, comp, n = _regs(part["regs"]), part["_comp"].to_numpy(), part["n_shingles"].to_numpy()
    b, i, j, band = part["_b"].to_numpy(), int(part["_i"].iloc[0]), int(part["_j"].iloc[0]), int(part["_key"].iloc[0]) & 31
    right = np.flatnonzero(b == j)
    for x in np.flatnonzero(b == i):
        y = right[(comp[right] != comp[x]) & (100 * np.minimum(n[right], n[x]) >= percent * np.maximum(n[right], n[x]))]
        if len(y):
            est = estimate(regs[y], regs[x][None, :], (n[y] + n[x]) / 2)
            ok = est >= _floor(percent / 100, np.minimum(n[y], n[x]))
            ok[ok] = first_band(regs[y[ok]], regs[x]) == band
            if ok.any():
                yield x, y[ok], est[ok]


def _promising(members: DataFrame, percent: int, block: int, rows: int) -> DataFrame:
    """Of members (_key, _row, _comp, _count, n_shingles, regs), the distinct (_key, _row) that have a partner in their bucket to
    be compared on full sets."""

    def run(part):
        import pandas as pd

        hit = [part.iloc[:0][["_key", "_row"]]]
        for _, own in part.groupby(["_key", "_i", "_j"]):
            near = np.zeros(len(own), bool)
            for x, y, _ in _compared(own, percent):
                near[x] = near[y] = True
            hit.append(own.loc[near, ["_key", "_row"]])
        return pd.concat(hit)

    return _block_pairs(members, block, rows).groupBy("_g").applyInPandas(run, "_key long, _row long").distinct()


def _joined(members: DataFrame, percent: int, block: int, rows: int) -> DataFrame:
    """Links (_hub, _row) that join different components among members (as in _promising, with set); pairs that are already
    connected within the task aren't compared."""

    def run(part):
        import pandas as pd

        known, out = _Union(), []
        for _, own in part.groupby(["_key", "_i", "_j"]):
            row, comp, sets = own["_row"].to_numpy(), own["_comp"].to_numpy(), own["set"].to_numpy()
            for x, y, est in _compared(own, percent):
                for k in y[np.argsort(-est)]:
                    p, q = known.root(int(comp[x])), known.root(int(comp[k]))
                    if p != q and _linked(np.frombuffer(sets[x], np.uint64), np.frombuffer(sets[k], np.uint64), percent):
                        known[p] = q
                        out.append((row[x], row[k]))
        return pd.DataFrame(out, columns=["_hub", "_row"], dtype="int64")

    return _block_pairs(members, block, rows).groupBy("_g").applyInPandas(run, "_hub long, _row long")


def near_groups(docs: DataFrame, n: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text", block: int = 256) -> DataFrame:
    """One row per row of docs: doc_id, n_shingles, component_id (smallest doc_id reachable over links), kept (doc_id = component_id).

    Two documents are linked if 100 * intersection >= percent * union of their sets of n-word shingles (A-Z lower-cased; with
    fewer words, the whole sequence). No link between different texts is lost but for the bands' miss rate (below one in a
    million at 0.85, 25 bands of five) and estimates six standard deviations off:

    1. Rows with equal sets form a class, found by a digest of the whole set; only one row of each goes on.
    2. In each band bucket every member is compared with the bucket's hub, the member with most bucket mates overall:
       as many pairs as members, however large the bucket.
    3. A bucket whose other members are connected by then is done. In the others they are compared across components, in
       pairs of blocks of the bucket, first by registers, then by full sets; a pair that shares several buckets is met in one.

    Shingles are 64-bit hashes of 64-bit word hashes: n_shingles counts hashes, and two different shingles of a pair of
    documents with m of them pass for one at odds of about m * m / 2**64 (one in a million at four million shingles).
    Wherever rows meet a key of which they may be many (a class, bucket, hub or component), hot keys are dealt to cells.

    What a step has shuffled is deleted before the next one, so the steps share the disk.

    Empty and null texts have no shingles, no link and component_id = doc_id. A null id is never the smallest unless all are
    null; repeated rows are of one class. Columns other than the id and the text aren't looked at.
    """
    spark = docs.sparkSession
    swept(spark)
    with temporary():
        rows = written(sketches(docs, n, id_col, text_col).withColumn("_row", F.monotonically_increasing_id()))
        slim = written(rows.select("doc_id", "n_shingles", "digest", "_row"), outlive=True)
        total = rows.count()
        classes = rows.where("n_shingles > 0").groupBy("digest").agg(F.min("_row").alias("_rep"), F.min("doc_id").alias("_low"), F.count("*").alias("_count"))
        classes = written(classes)
        swept(spark)
        reps = written(rows.join(classes.select(F.col("_rep").alias("_row")), "_row").select("_row", "doc_id", "_t", "n_shingles", "regs"))
        swept(spark)
        bands = _band_rows(reps)
        shared = bands.groupBy("_key").agg(F.count("*").alias("_count")).where("_count > 1")
        near = written(spread_join(bands, shared, ["_key"], "_row", BANDS * total).select("_key", "_row", "_count"))
        met = near.count()
        swept(spark)
        mates = near.groupBy("_row").agg(F.sum("_count").alias("_mates"))
        hubs = near.join(mates, "_row").groupBy("_key").agg(F.max(F.struct("_mates", (-F.col("_row")).alias("r"))).alias("_h"), F.count("*").alias("_count"))
        hubs = hubs.select("_key", (-F.col("_h.r")).alias("_hub"), "_count")
        starred = written(spread_join(near.select("_key", "_row"), hubs, ["_key"], "_row", met).select("_key", "_row", "_hub"))
        swept(spark)
        pairs = written(_estimated(written(starred.where("_row <> _hub").select("_hub", "_row").distinct()), reps, percent))
        swept(spark)
        wanted = pairs.select("_row").union(pairs.select(F.col("_hub").alias("_row"))).distinct()
        sets = written(_sets(docs, reps.join(wanted, "_row").select("_row", "doc_id", "_t"), n, id_col, text_col))
        swept(spark)
        links = written(_verified(pairs, sets, percent))
        comps = written(connected(links.select(F.col("_hub").alias("a"), F.col("_row").alias("b"))).withColumnsRenamed({"node": "_n", "root": "_comp"}))
        swept(spark)
        # Buckets whose members other than the hub lie in different components hold pairs that weren't compared.
        other = written(starred.where("_row <> _hub").join(comps, F.col("_row") == F.col("_n"), "left").select("_key", "_row", F.coalesce("_comp", "_row").alias("_comp")))
        split = other.groupBy("_key").agg(F.min("_comp").alias("_x"), F.max("_comp").alias("_y"), F.count("*").alias("_count")).where("_x <> _y").select("_key", "_count")
        rest = written(spread_join(other, split, ["_key"], "_row", met).join(reps.select("_row", "n_shingles", "regs"), "_row"))
        left = rest.count()
        swept(spark)
        if left:
            # Registers are small, so eight times as many rows of them meet as of sets.
            hot = written(_promising(rest, percent, 8 * block, left))
            if not hot.isEmpty():
                missing = hot.select("_row").distinct().join(sets.select("_row"), "_row", "left_anti")
                more = sets.union(_sets(docs, reps.join(missing, "_row").select("_row", "doc_id", "_t"), n, id_col, text_col))
                found = written(_joined(rest.join(hot, ["_key", "_row"]).join(more, "_row"), percent, block, hot.count()))
                links = links.union(found)
                comps = written(connected(links.select(F.col("_hub").alias("a"), F.col("_row").alias("b"))).withColumnsRenamed({"node": "_n", "root": "_comp"}))
        # Smallest id of each component over all its classes, then back to every row.
        low = written(classes.join(comps, F.col("_rep") == F.col("_n"), "left").select("digest", "_low", "_count", F.coalesce("_comp", "_rep").alias("_comp")), outlive=True)
    swept(spark)
    smallest = low.groupBy("_comp").agg(F.min("_low").alias("_id"), F.count("*").alias("_count"))
    by_class = spread_join(low.withColumnRenamed("_count", "_rows"), smallest, ["_comp"], "digest", total).select("digest", "_id", F.col("_rows").alias("_count"))
    out = spread_join(slim, by_class, ["digest"], "_row", total, "left")
    component = F.coalesce("_id", "doc_id")
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))
