"""Exact top-k by inner product over norm-sorted vectors with SVD-rotated partial sums and Cauchy-Schwarz bounds.

Vectors are packed into blocks by falling length, with their partial sums over the leading rotated dimensions and the length
of the remainder. Blocks of queries meet only groups of vectors long enough to reach a query's k-th score so far; there a
vector is dropped for a query when its partial sum plus the product of both remainders' lengths stays below that score.
What is left is scored exactly in integers.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written

_EXACT = float(1 << 53)
#: Levels of length for block pruning: 16 an octave below the longest vector.
_LEVELS = 1 << 10


def scaled(column, scale: float):
    """(components as floor(scale * x), first place of each row and the end, rows that take part) of an Arrow list column."""
    import pyarrow as pa
    import pyarrow.compute as pc

    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    ends = np.append(0, np.cumsum(pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False))).astype(np.int64)
    with np.errstate(over="ignore", invalid="ignore"):
        x = np.floor(scale * pc.cast(pc.list_flatten(column), pa.float64()).to_numpy(zero_copy_only=False))  # nulls become NaN
    bad = np.append(0, np.cumsum(~np.isfinite(x)))
    return x, ends, (bad[ends[1:]] == bad[ends[:-1]]) & pc.is_valid(column).to_numpy(zero_copy_only=False)


def exact_scores(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of the integer-valued vector a with the rows of b, as int64; in Python integers (clipped) where doubles could round."""
    if np.abs(a).max(initial=0) * np.abs(b).max(initial=0) * max(1, len(a)) < _EXACT:
        return (b @ a).astype(np.int64)
    own = [int(x) for x in a]
    return np.asarray([min(max(sum(x * int(y) for x, y in zip(own, row, strict=True)), -(1 << 63)), (1 << 63) - 1) for row in b], np.int64)


def best(scores: np.ndarray, ids: np.ndarray, rows: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best: highest score, then smallest id."""
    return np.lexsort((rows, ids, -scores))[:k]


def _whole(block: dict, i: int, width: int) -> np.ndarray:
    """Row i of a block as long as `width` or its own length, whichever is more."""
    tail = block["tail"][i]
    return np.concatenate([block["head"][i], tail]) if len(tail) else block["head"][i]


def _scores(q: dict, x: int, c: dict, at: np.ndarray) -> np.ndarray:
    """Exact scores of query x and the rows `at` of c."""
    own = q["tail"][x]
    if not len(own) or not any(len(c["tail"][i]) for i in at):
        return exact_scores(q["head"][x], c["head"][at])
    out = []
    for i in at:
        a, b = _whole(q, x, 0), _whole(c, i, 0)
        n = min(len(a), len(b))
        out.append(exact_scores(a[:n], b[None, :n])[0])
    return np.asarray(out, np.int64)


def search_block(q: dict, c: dict, kth: np.ndarray, k: int, tops: list[list[np.ndarray]], step: int = 512) -> None:
    """Merges block c of vectors into the queries' tops ([scores, ids, rows] each); kth: a lower bound of each query's k-th score."""
    plain = not any(map(len, c["tail"])) or not any(map(len, q["tail"]))
    safe = plain and np.abs(q["head"]).max(initial=0) * np.abs(c["head"]).max(initial=0) * max(1, q["head"].shape[1]) < _EXACT
    # The block's longest vector comes first, so a query that it can't serve is served by none.
    near = np.flatnonzero(q["norm"] * c["norm"][0] * (1 + 1e-9) + 1e-6 >= kth)
    for start in range(0, len(near), step):
        own = near[start : start + step]
        bound = q["lead"][own] @ c["lead"].T + q["rest"][own][:, None] * c["rest"][None, :]
        keep = bound + 1e-9 * q["norm"][own][:, None] * c["norm"][None, :] + 1e-6 >= kth[own][:, None]
        keep &= q["row"][own][:, None] != c["row"][None, :]
        # Doubles add integers exactly, so where many are left one product scores them all.
        every = q["head"][own] @ c["head"].T if safe and keep.mean() > 0.02 else None
        for i in np.flatnonzero(keep.any(axis=1)):
            x, at = own[i], np.flatnonzero(keep[i])
            if every is not None:
                s = every[i, at]
                at, s = at[s >= kth[x]], s[s >= kth[x]].astype(np.int64)
            else:
                s = _scores(q, x, c, at)
            parts = [np.concatenate(p) for p in zip(tops[x], (s, c["id"][at], c["row"][at]), strict=True)]
            first = best(*parts, k)
            tops[x] = [p[first] for p in parts]
            if len(first) == k:
                kth[x] = max(kth[x], float(tops[x][0][-1]))


_BLOCK = "head binary, lead binary, rest binary, norm binary, tail binary, tails binary, ids binary, rows binary, longest double"


def _unpack(row: dict, width: int, lead: int) -> dict:
    numbers = lambda name, kind=np.float64: np.frombuffer(row[name], kind)
    return {
        "head": numbers("head").reshape(-1, width), "lead": numbers("lead").reshape(-1, lead), "rest": numbers("rest"), "norm": numbers("norm"),
        "tail": np.split(numbers("tail"), np.cumsum(numbers("tails", np.int64))[:-1]), "id": numbers("ids", np.int64), "row": numbers("rows", np.int64),
    }


def _packed(rows: DataFrame, rotation: np.ndarray, lead: int, size: int, most_bytes: int) -> DataFrame:
    """Blocks of up to `size` rows and about most_bytes, as they come, numbered _c by partition and place."""
    import pyarrow as pa

    width = len(rotation)
    leading = np.ascontiguousarray(rotation[:, :lead])
    shared = rows.sparkSession.sparkContext.broadcast(leading)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn = shared.value
        held: list[list] = [[], [], []]

        def block() -> pa.RecordBatch:
            vectors = [np.frombuffer(x, np.float64) for x in held[0]]
            head = np.zeros((len(vectors), width))
            for i, v in enumerate(vectors):
                head[i, : len(v)] = v[:width]
            tails = [v[width:] for v in vectors]
            norm = np.sqrt((head**2).sum(axis=1) + [t @ t for t in tails])
            front = head @ turn
            rest = np.sqrt(np.maximum(0, norm**2 - (front**2).sum(axis=1)))
            # The difference of squares may round; the remainder is never taken for shorter than it is.
            rest = rest + 1e-7 * norm
            binary = [head, front, rest, norm, np.concatenate(tails), np.asarray([len(t) for t in tails], np.int64), np.asarray(held[1], np.int64), np.asarray(held[2], np.int64)]
            for h in held:
                h.clear()
            return pa.RecordBatch.from_arrays([*(pa.array([x.tobytes()], pa.binary()) for x in binary), pa.array([float(norm.max())])], [x.split(" ")[0] for x in _BLOCK.split(", ")])

        used = 0
        for b in batches:
            for row in zip(*(c.to_pylist() for c in b.columns), strict=True):
                for h, x in zip(held, row, strict=True):
                    h.append(x)
                used += max(len(row[0]), 8 * width)
                if len(held[0]) >= size or used >= most_bytes:
                    yield block()
                    used = 0
        if held[0]:
            yield block()

    return rows.select("data", "id", "_row").mapInArrow(run, _BLOCK).withColumn("_c", F.monotonically_increasing_id())


def _rotation(vectors: DataFrame, width: int, n: int, sample: int) -> np.ndarray:
    """Right singular vectors, strongest first, of the leading `width` components of about `sample` vectors, by the sums of
    products. Any rotation keeps the bounds true, so the sample decides only how early they bite."""
    import pyarrow as pa

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((width, width))
        for b in batches:
            m = np.zeros((b.num_rows, width))
            for i, x in enumerate(b.column(0)):
                v = np.frombuffer(x.as_buffer(), np.float64)[:width]
                m[i, : len(v)] = v / max(1.0, np.sqrt(v @ v))
            total += m.T @ m
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(width)), pa.array([r.tobytes() for r in total], pa.binary())], ["at", "v"])

    def add(part):
        import pandas as pd

        return pd.DataFrame({"at": part["at"].iloc[:1], "v": [np.sum([np.frombuffer(x, np.float64) for x in part["v"]], axis=0).tobytes()]})

    few = vectors.where(F.pmod(F.xxhash64("_row"), F.lit(1 << 20)) < F.lit(int((1 << 20) * min(1.0, sample / max(1, n)))))
    sums = few.select(F.substring("data", 1, 8 * width).alias("data")).repartition(16).mapInArrow(run, "at long, v binary").groupBy("at").applyInPandas(add, "at long, v binary").collect()
    gram = np.zeros((width, width))
    for at, v in sums:
        gram[at] = np.frombuffer(v, np.float64)
    values, vectors_ = np.linalg.eigh(gram)
    return np.ascontiguousarray(vectors_[:, np.argsort(-values)])


def top_k(table: DataFrame, is_query: Column, k: int = 10, scale: float = 1024.0, id_col: str = "vec_id", vector_col: str = "embedding", block: int = 4096, queries_block: int = 16384, group: int = 4, most_width: int = 1024, most_bytes: int = 1 << 24, sample: int = 1_000_000) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k best of all other rows for every row where is_query holds.

    Components become floor(scale * x); the score is their integer inner product (clipped to a long), ties go to the smaller
    id. Rows whose id is null, whose vector is null or has a null or non-finite component (after scaling too) take no part;
    shorter vectors count as filled up with zeros; an empty one scores 0. A row is never its own candidate, a repeated row
    is. Fewer than k candidates give all of them; no queries give no rows. Only the first most_width components are rotated;
    those beyond, in overlong vectors, count in the remainder's length and in the exact score, and are stored as they are.

    Vectors are dealt by falling length to groups of about `group` blocks of at most `block` rows and most_bytes. The block of
    the longest ones gives each query its first bound. Then a block of queries meets only the groups whose longest vector can
    reach a bound of it: the pairs are found from numbers alone, by level of length, before any vector is sent. On the
    driver there are at most most_width ** 2 sums; what is sent is the packed blocks, each as often as it meets.
    """
    import pyarrow as pa

    kind = dict(table.dtypes)[id_col]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x, ends, ok = scaled(b.column(2), scale)
            rows = np.flatnonzero(ok)
            data = [x[ends[i] : ends[i + 1]] for i in rows]
            norm = pa.array(np.asarray([np.sqrt(v @ v) for v in data]), pa.float64())
            took = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0).take(took), b.column(1).take(took), pa.array([v.tobytes() for v in data], pa.binary()), norm], ["id", "_query", "data", "norm"])

    rows = table.select(F.col(id_col).cast("long").alias("id"), F.coalesce(is_query, F.lit(False)).alias("_query"), F.col(vector_col).alias("v")).where("id is not null")
    rows = written(rows.mapInArrow(read, "id long, _query boolean, data binary, norm double").withColumn("_row", F.monotonically_increasing_id()))
    n, asking, dim = rows.agg(F.count("*"), F.count_if("_query"), F.coalesce(F.max(F.octet_length("data")), F.lit(0)) / 8).first()
    if not asking:
        return table.sparkSession.createDataFrame([], f"query_id {kind}, rank int, vec_id {kind}, score long")
    width = max(1, min(int(dim), most_width))
    rotation, lead = _rotation(rows, width, n, sample), max(1, width // 4)
    size = max(1, min(block, most_bytes // (8 * width)))
    # The row number too, so that equally long vectors are not one partition.
    by_length = rows.repartitionByRange(max(1, -(-n // (group * size))), F.desc("norm"), "_row").sortWithinPartitions(F.desc("norm"), "_row")
    vectors = written(_packed(by_length, rotation, lead, size, most_bytes).withColumn("_g", F.shiftright("_c", 33).cast("long")))
    per_ask = max(1, min(queries_block, most_bytes // (8 * width)))
    asked = written(_packed(rows.where("_query").repartition(max(1, -(-asking // per_ask)), "_row"), rotation, lead, per_ask, most_bytes).withColumnRenamed("_c", "_q"))
    parts = [x.split(" ")[0] for x in _BLOCK.split(", ")]

    def search(key, ask, blocks):
        import pandas as pd

        if not len(ask) or not len(blocks):
            return pd.DataFrame({x.split(" ")[0]: [] for x in schema.split(", ")})
        row = ask.iloc[0]
        q = _unpack(row, width, lead)
        kth = np.full(len(q["id"]), -np.inf) if row["kth"] is None else np.frombuffer(row["kth"], np.float64).copy()
        tops = [[np.empty(0, np.int64)] * 3 for _ in range(len(kth))]
        for _, own in blocks.sort_values("_c").iterrows():
            search_block(q, _unpack(own, width, lead), kth, k, tops)
        size = [len(t[0]) for t in tops]
        cols = [np.concatenate([t[i] for t in tops]) for i in range(3)]
        return pd.DataFrame({"_q": key[0], "_at": np.repeat(np.arange(len(tops)), size), "query_row": np.repeat(q["row"], size), "query_id": np.repeat(q["id"], size), "score": cols[0], "vec_id": cols[1], "_row": cols[2]})

    schema = "_q long, _at long, query_row long, query_id long, score long, vec_id long, _row long"

    def meet(pairs: DataFrame, blocks: DataFrame, ask: DataFrame) -> DataFrame:
        """Searches the groups of pairs (_q, _g): asks and blocks go straight to the pair's task."""
        again = pairs.select(F.col("_q").alias("_q2"), F.col("_g").alias("_g2"))
        sent = again.join(blocks, F.col("_g2") == F.col("_g")).drop("_g")
        return pairs.join(ask, "_q").groupBy("_q", "_g").cogroup(sent.groupBy("_q2", "_g2")).applyInPandas(search, schema)

    first = vectors.agg(F.min("_c"), F.max("longest")).first()
    opening = vectors.where(F.col("_c") == F.lit(first[0]))
    all_first = asked.select("_q", F.lit(first[0] >> 33).cast("long").alias("_g"))
    opening = written(meet(all_first, opening, asked.select("_q", *parts, F.lit(None).cast("binary").alias("kth"))))

    def bounds(part):
        """Each query's k-th score, and the length from which on a vector can reach one of them."""
        import pandas as pd

        norm = np.frombuffer(part["norm"].dropna().iloc[0], np.float64)
        kth = np.full(len(norm), -np.inf)
        for at, own in part[part["_at"] >= 0].groupby("_at"):
            if len(own) >= k:
                kth[int(at)] = own["score"].min()
        need = np.where((kth > 0) & (norm > 0), (kth * (1 - 1e-9) - 1e-6) / np.maximum(norm, 1e-300), 0).min()
        return pd.DataFrame({"_q": part["_q"].iloc[:1], "kth": [kth.tobytes()], "need": [max(0.0, float(need))]})

    known = opening.select("_q", "_at", "score", F.lit(None).cast("binary").alias("norm")).union(asked.select("_q", F.lit(-1).cast("long"), F.lit(0).cast("long"), "norm"))
    kths = written(known.groupBy("_q").applyInPandas(bounds, "_q long, kth binary, need double"))
    # Lengths by level below the longest: a group is met if its level is not deeper than the needed length's.
    level = lambda x: F.when(F.col(x) > 0, F.greatest(F.lit(0), F.least(F.lit(_LEVELS - 1), F.floor(16 * F.log2(F.lit(max(first[1], 1e-300)) / F.col(x)))))).otherwise(F.lit(_LEVELS - 1)).cast("int")
    later = vectors.where(F.col("_c") != F.lit(first[0]))
    groups = later.groupBy("_g").agg(F.max("longest").alias("longest")).select("_g", level("longest").alias("_level"))
    pairs = kths.select("_q", F.explode(F.sequence(F.lit(0), level("need"))).alias("_level")).join(groups, "_level").select("_q", "_g")
    rest = meet(written(pairs), later, asked.join(kths, "_q").select("_q", *parts, "kth"))
    order = Window.partitionBy("query_row").orderBy(F.desc("score"), "vec_id", "_row")
    out = opening.union(rest).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return out.select(F.col("query_id").cast(kind), "rank", F.col("vec_id").cast(kind), "score")
