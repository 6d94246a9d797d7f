"""Token counts: batch encoding in Arrow functions that return lengths only.

`encoder(path)` reads a tokenizers .json, a tiktoken rank file or a sentencepiece .model. A .json that is plain byte-level
BPE (no normaliser, merges in the order of their ids) is run by tiktoken's core with the ranks taken from that very file:
the ids are the same, several times faster; any other .json is run by tokenizers itself.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The split of byte-level BPE before merging, as the public tokenizer defines it (a fixed value).
BYTE_BPE_SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Places that no token of byte-level BPE spans: one space between two characters that aren't spaces (before the space).
_SPACE = re.compile(r"\S(?= \S)")
#: And where a run of letters, digits or signs ends, told by characters of which every Unicode version thinks alike. Not
#: after an apostrophe, which may begin a contraction. A special token's name may hold such places.
_RUNS = re.compile(
    r"\S(?= \S)|[A-Za-z](?=[!-@\[-`{-~])|[0-9](?=[!-/:-~])|[!-&(-/:-@\[-`{-~](?=[A-Za-z0-9])"
    r"|[\u3001\u3002\uff01\uff0c\uff1a\uff1b\uff1f](?=[\u3041-\u3096\u30a1-\u30fa\u4e00-\u9fa5\uac00-\ud7a3])|[\u3041-\u3096\u30a1-\u30fa\u4e00-\u9fa5\uac00-\ud7a3](?=[\u3001\u3002\uff01\uff0c\uff1a\uff1b\uff1f])"
)


class Encoder:
    """ids(text): its token ids as a uint32 array; count(texts): their token counts. No special tokens are added."""

    def __init__(self, ids: Callable[[str], np.ndarray], count: Callable[[list[str]], list[int]], splittable: bool, names: tuple[str, ...] = ()):
        self._ids, self._count, self.splittable, self._names = ids, count, splittable, names

    def pieces(self, text: str, size: int) -> list[str]:
        """The text cut after about `size` characters each, only where no token can be cut; whole if there is no such place."""
        if not self.splittable or len(text) <= size:
            return [text]
        safe = _SPACE if any(x in text for x in self._names) else _RUNS
        out, at = [], 0
        while len(text) - at > size and (m := safe.search(text, at + size)):
            out.append(text[at : m.end()])
            at = m.end()
        return [*out, text[at:]]

    def ids(self, text: str, size: int = 1 << 16) -> np.ndarray:
        parts = [self._ids(x) for x in self.pieces(text, size)]
        return parts[0] if len(parts) == 1 else np.concatenate(parts)

    def count(self, texts: list[str], batch_bytes: int = 1 << 20, size: int = 1 << 16) -> list[int]:
        """Counts of the texts, encoded in batches of about batch_bytes (UTF-8), long texts cut at safe places."""
        out = [0] * len(texts)
        owner: list[int] = []
        batch: list[str] = []
        held = 0

        def flush() -> None:
            for i, n in zip(owner, self._count(batch), strict=True):
                out[i] += n
            owner.clear()
            batch.clear()

        for i, text in enumerate(texts):
            for part in self.pieces(text, size):
                owner.append(i)
                batch.append(part)
                held += len(part) if part.isascii() else len(part.encode())
                if held >= batch_bytes:
                    flush()
                    held = 0
        flush()
        return out


def by_bytes(column, most: int) -> Iterator:
    """An Arrow text column in slices of about `most` bytes, at least a text each: so much becomes Python objects at a time."""
    import pyarrow.compute as pc

    ends = np.cumsum(pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < len(column):
        done = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, done + most, side="right")))
        yield column.slice(at, to - at)
        at = to


def _byte_letters() -> dict[str, int]:
    """Byte-level vocabularies write a byte as itself where that is a visible Latin-1 character, and otherwise as the next unused code point from 256."""
    shown = {b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255}
    letters, free = {}, 256
    for b in range(256):
        letters[chr(b if b in shown else free)] = b
        free += b not in shown
    return letters


def _plain_byte_bpe(spec: dict) -> tuple[dict[bytes, int], dict[str, int]] | None:
    """(rank of each token, special tokens) if the file is byte-level BPE that tiktoken's core runs the same; else None."""
    model, pre, added = spec.get("model", {}), spec.get("pre_tokenizer") or {}, spec.get("added_tokens") or []
    plain = (
        model.get("type") in ("BPE", None)
        and spec.get("normalizer") is None
        and pre.get("type") == "ByteLevel"
        and not pre.get("add_prefix_space")
        and pre.get("use_regex", True)
        and not any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "fuse_unk", "byte_fallback", "ignore_merges"))
        and all(a.get("special") and not any(a.get(k) for k in ("lstrip", "rstrip", "single_word", "normalized")) for a in added)
    )
    if not plain:
        return None
    letters, vocab = _byte_letters(), model["vocab"]
    merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
    made = [vocab.get(a + b, -1) for a, b in merges]
    special = {a["content"]: a["id"] for a in added}
    ranks = {bytes(letters[c] for c in t): i for t, i in vocab.items() if t not in special}
    first = min(made, default=256)
    if any(y <= x for x, y in zip(made, made[1:])) or first < 256 or len(ranks) != 256 + len(merges):
        return None
    return ranks, special


@lru_cache(maxsize=4)
def encoder(path: str) -> Encoder:
    """The encoder of a vocabulary file; one per worker process, on one thread."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    if path.endswith(".model"):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        return Encoder(lambda t: np.asarray(sp.encode(t, num_threads=1), np.uint32), lambda ts: [len(x) for x in sp.encode(ts, num_threads=1)], False)
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    if found := _plain_byte_bpe(spec):
        import tiktoken

        ranks, special = found
        core = tiktoken.Encoding("own", pat_str=BYTE_BPE_SPLIT, mergeable_ranks=ranks, special_tokens=special)
        names = tuple(special)

        def run(text: str) -> list[int]:
            if any(x in text for x in names):  # the library's default: such strings become their special token
                return core.encode(text, allowed_special="all")
            return core.encode_ordinary(text)

        # Not encode_ordinary_batch: it hands each text to a thread, which costs more than a short text does.
        return Encoder(lambda t: np.asarray(run(t), np.uint32), lambda ts: [len(run(t)) for t in ts], True, names)
    from tokenizers import Tokenizer

    tk = Tokenizer.from_file(path)
    tk.no_truncation()
    tk.no_padding()
    return Encoder(lambda t: np.asarray(tk.encode(t, add_special_tokens=False).ids, np.uint32), lambda ts: [len(x) for x in tk.encode_batch(ts, add_special_tokens=False)], False)


def count_tokens(docs: DataFrame, path: str, limit: int = 1024, id_col: str = "doc_id", text_col: str = "text", batch_bytes: int = 1 << 20) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for every row of docs.

    Only the id and the text are read; the scan's splits are even in bytes, and within a task texts go to the encoder in
    batches of about batch_bytes (UTF-8), long ones cut at safe boundaries, so one long text never makes a batch large. Only the
    lengths leave the worker; nothing is shuffled. A null or empty text has 0 bytes and 0 tokens; repeated rows each give a
    row; a null id stays null; other columns are not looked at. `path` must exist on every executor.
    """
    import pyarrow as pa
    import pyarrow.compute as pc

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for b in batches:
            texts = pc.fill_null(b.column(1), "")
            counts = pa.array([n for part in by_bytes(texts, batch_bytes) for n in enc.count(part.to_pylist(), batch_bytes)], pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0), pc.cast(pc.binary_length(texts), pa.int64()), counts], ["doc_id", "n_bytes", "n_tokens"])

    kind = dict(docs.dtypes)[id_col]
    out = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, f"doc_id {kind}, n_bytes long, n_tokens long")
    return out.withColumn("over_limit", F.col("n_tokens") > limit)
