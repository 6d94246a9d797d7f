"""Best-fit packing by sums of squares: a piece goes where the squared counts of open sequences per remaining gap become smallest."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import each, written
from .tokens import encoder


def sum_of_squares(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """(sequence, offset) of each piece, 0 < length <= capacity, placed in the order given.

    With N(g) open sequences of gap g, putting s into gap g changes the sum of N squared by 2(N(g-s) - N(g)) + 2, or by
    1 - 2 N(g) when it fills the gap; the smallest change wins, then the tightest gap. A new sequence is opened only when
    none has room, which keeps the number of sequences low for pieces sorted by falling length.
    """
    count = np.zeros(capacity + 1, np.int64)
    open_at: list[list[int]] = [[] for _ in range(capacity + 1)]
    seq, off = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    n = 0
    for i, s in enumerate(lengths.tolist()):
        here = count[s:]
        change = 2 * (count[: capacity - s + 1] - here) + 2
        change[0] = 1 - 2 * here[0]
        change[here == 0] = np.iinfo(np.int64).max
        j = int(change.argmin())
        if here[j]:
            gap = s + j
            seq[i] = open_at[gap].pop()
            count[gap] -= 1
        else:
            gap, seq[i], n = capacity, n, n + 1
        off[i] = capacity - gap
        if gap > s:
            open_at[gap - s].append(int(seq[i]))
            count[gap - s] += 1
    return seq, off


def cut(docs: DataFrame, path: str, capacity: int = 2048, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """The pieces of every document: doc_id, piece, start, length, ids_crc32 (and the ids themselves if asked for).

    A document is its token ids and then end_id; only one longer than capacity is cut, its first piece taking what does not
    fill a whole one.
    """
    import pyarrow as pa
    import pyarrow.compute as pc

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        last = np.asarray([end_id], "<u4")
        for b in batches:
            row, piece, start, length, crc, kept = [], [], [], [], [], []
            for i, text in enumerate(each(pc.fill_null(b.column(1), ""))):
                ids = np.concatenate([enc.ids(text).astype("<u4", copy=False), last])
                raw, at, k = memoryview(ids.tobytes()), 0, 0
                end = len(ids) % capacity or capacity
                while at < len(ids):
                    row.append(i)
                    piece.append(k)
                    start.append(at)
                    length.append(end - at)
                    crc.append(zlib.crc32(raw[4 * at : 4 * end]))
                    if with_ids:
                        kept.append(ids[at:end].astype(np.int32))
                    at, end, k = end, end + capacity, k + 1
            cols = [b.column(0).take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, crc))]
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            if with_ids:
                cols.append(pa.array(kept, pa.list_(pa.int32())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(cols, names)

    kind = dict(docs.dtypes)[id_col]
    schema = f"doc_id {kind}, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, schema)


def pack(docs: DataFrame, path: str, capacity: int = 2048, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False, group_rows: int = 1 << 16) -> DataFrame:
    """Packs every document into sequences of at most `capacity` tokens; one row per piece with sequence_id and offset.

    The pieces are written once (tokenising is the dear step) without texts, dealt by a hash of their place to groups of about group_rows
    and packed group by group, longest first; a group of tens of thousands wastes at most a few sequences, and no
    document's or source's rows meet in one task. Null and empty texts are one piece holding only end_id; repeated rows
    are packed each; a null id stays null; no rows give no rows.
    """
    if capacity < 1:
        raise ValueError("capacity must be positive")
    pieces = written(cut(docs, path, capacity, end_id, id_col, text_col, with_ids))
    groups = max(1, -(-pieces.count() // group_rows))

    def place(part):
        part = part.sort_values(["length", "ids_crc32", "start"], ascending=[False, True, True], kind="stable")
        seq, part["offset"] = sum_of_squares(part["length"].to_numpy(), capacity)
        part["sequence_id"] = seq * groups + int(part["_g"].iloc[0])
        return part.drop(columns="_g")

    schema = ", ".join(f"{c} {t}" for c, t in pieces.dtypes)
    dealt = pieces.withColumn("_g", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(groups)).cast("int"))
    return dealt.groupBy("_g").applyInPandas(place, f"{schema}, offset long, sequence_id long")
