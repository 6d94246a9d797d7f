"""Language-model scoring by deleted interpolation.

The probability of a token after the one before it mixes three maximum-likelihood estimates: bigram, unigram and uniform
over the vocabulary and one unknown. The weights depend on how often the context was seen (one set for each power of two)
and are learned by expectation-maximisation on the counts of a deleted part of the training documents, against the counts
of the rest; afterwards the deleted part is counted too.

Documents are packed into blocks of about half a million tokens. Each block asks for the counts of its distinct n-grams,
as hashes packed in arrays by the hash's top bits; each such bucket adds up what all blocks know and answers
each block in its own order. So what is shuffled is a few bytes for each distinct n-gram of a block.

Words are told apart by 80 bits, so token counts, the vocabulary and base_score are exact but for odds of one in two million
that any two of a billion words are confused. Bigrams are told apart by the bits of their bucket and 48
more, a bucket holding about a million of them at every size: one in some hundred million shares another's count, which
only `score` can feel.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import each, written
from .shingles import mix64

#: No word holds a space, so these name no word.
END, BEGIN = b" end", b" begin"
KEPT, DELETED, TEST = 0, 1, 2
_STEP = 8  # bins per octave of probability ratios in expectation-maximisation


def _hashes(words: list[bytes]) -> np.ndarray:
    """(words, 2): the 64-bit halves of the words' 128-bit hashes."""
    return np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, words)), ">u8").astype(np.uint64).reshape(-1, 2)


def _small(x: np.ndarray) -> bytes:
    """Counts in the fewest bytes each that hold them all, the number of bytes first."""
    most = int(x.max(initial=0))
    width = 1 if most < 1 << 8 else 2 if most < 1 << 16 else 4 if most < 1 << 32 else 8
    return bytes([width]) + x.astype(f"<u{width}").tobytes()


def _large(data: bytes) -> np.ndarray:
    return np.frombuffer(data, f"<u{data[0]}", offset=1).astype(np.int64)


def _split(x: np.ndarray, low: str) -> bytes:
    """The low bits of the numbers, then the 16 bits above them: numbers alike in those compress to little more than `low`."""
    return x.astype(low).tobytes() + (x >> (8 * np.dtype(low).itemsize)).astype("<u2").tobytes()


def _join(data: bytes, low: str, kind) -> np.ndarray:
    width = np.dtype(low).itemsize
    n = len(data) // (width + 2)
    return np.frombuffer(data, low, n).astype(kind) | np.frombuffer(data, "<u2", n, n * width).astype(kind) << kind(8 * width)


class _Numbers(dict):
    """Word -> its number in the order of first use."""

    def __missing__(self, word: bytes) -> int:
        n = self[word] = len(self)
        return n


def _blocks(docs: DataFrame, block_tokens: int) -> DataFrame:
    """Blocks of documents of one part each: part, ids (as strings), lens, vocab and more (48 and 32 bits of the words' hashes,
    sorted by them), words (places in vocab)."""
    import pyarrow as pa

    names = ["part", "ids", "lens", "vocab", "more", "words", "n"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple[list, list, _Numbers]] = {p: ([], [], _Numbers()) for p in (KEPT, DELETED, TEST)}
        size = dict.fromkeys(held, 0)

        def block(p: int) -> pa.RecordBatch:
            ids, tokens, known = held[p]
            vocab, more = _hashes(list(known)).T
            vocab, more = vocab >> np.uint64(16), (more >> np.uint64(32)).astype("<u4")
            order = np.lexsort((more, vocab))
            place = np.empty(len(order), np.int32)
            place[order] = np.arange(len(order), dtype=np.int32)
            lens = np.asarray([len(t) for t in tokens], np.int32)
            row = [p, ids, lens.tobytes(), _split(vocab[order], "<u4"), more[order].tobytes(), _split(place[np.concatenate(tokens)], "<u2"), int(lens.sum())]
            held[p], size[p] = ([], [], _Numbers()), 0
            kinds = [pa.int32(), pa.list_(pa.string()), *[pa.binary()] * 4, pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip(row, kinds, strict=True)], names)

        for b in batches:
            for i, p, text in zip(*(each(c) for c in b.columns), strict=True):
                # bytes.split cuts at exactly the six separators.
                words = (text or "").encode("utf-8").lower().split()
                words.append(END)
                held[p][0].append(i)
                held[p][1].append(np.fromiter(map(held[p][2].__getitem__, words), np.int32, len(words)))
                size[p] += len(words)
                if size[p] >= block_tokens:
                    yield block(p)
        for p in held:
            if size[p]:
                yield block(p)

    return docs.mapInArrow(run, "part int, ids array<string>, lens binary, vocab binary, more binary, words binary, n long")


def _read(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(lens, vocab, words, before): before is each token's context as a place in vocab, len(vocab) at a document's begin."""
    lens, vocab, words = np.frombuffer(row["lens"], np.int32), _join(row["vocab"], "<u4", np.uint64), _join(row["words"], "<u2", np.int32)
    before = np.append(np.int32(len(vocab)), words[:-1])
    before[np.cumsum(lens)[:-1]] = len(vocab)
    return lens, vocab, words, before


def _pairs(vocab: np.ndarray, words: np.ndarray, before: np.ndarray, bits: int) -> np.ndarray:
    """Keys of the bigrams, one per token: bits + 48 bits, 64 at most."""
    left = mix64(np.append(vocab, _hashes([BEGIN])[0, 0]))
    return mix64(left[before] + np.uint64(0x9E3779B97F4A7C15) * vocab[words]) >> np.uint64(max(0, 16 - bits))


def _asks(blocks: DataFrame, bits: int) -> DataFrame:
    """order, bucket, block, part, keys, more, n: the distinct n-grams of each block by the top bits of their hash, sorted; more
    is the other part of a word's hash."""
    import pyarrow as pa

    kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.binary()]
    names = ["order", "bucket", "block", "part", "keys", "more", "n"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in b.to_pylist():
                _, vocab, words, before = _read(row)
                learn = row["part"] != TEST
                for order in (1, 2):
                    if order == 1:
                        keys, more, n = vocab, np.frombuffer(row["more"], "<u4"), np.bincount(words, minlength=len(vocab))
                        top = keys >> np.uint64(48 - bits)
                    else:
                        keys, n = np.unique(_pairs(vocab, words, before, bits), return_counts=True)
                        top = keys >> np.uint64(64 - bits - max(0, 16 - bits))
                    cuts = np.flatnonzero(np.concatenate([[True], top[1:] > top[:-1], [True]]))
                    spans = [slice(x, y) for x, y in zip(cuts[:-1], cuts[1:], strict=True)]
                    bucket = top[cuts[:-1]].astype(np.int32)
                    cols = [[order] * len(spans), bucket, [row["_block"]] * len(spans), [row["part"]] * len(spans), [_split(keys[s], "<u4") for s in spans], [more[s].tobytes() if order == 1 else None for s in spans], [_small(n[s]) if learn else None for s in spans]]
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names)

    return blocks.select("_block", "part", "lens", "vocab", "more", "words").mapInArrow(run, "order int, bucket int, block long, part int, keys binary, more binary, n binary")


def _answer(part):
    """The counts of each block's keys in all training documents (all) and in the deleted ones (gone); at block -1 the
    bucket's own totals."""
    import pandas as pd

    order, bucket = int(part["order"].iloc[0]), int(part["bucket"].iloc[0])
    size = [len(k) // 6 for k in part["keys"]]
    keys = np.concatenate([_join(k, "<u4", np.uint64) for k in part["keys"]])
    if order == 1:
        # Words are told apart by both parts: sorted by them, a word starts where either changes.
        more = np.frombuffer(b"".join(part["more"]), "<u4")
        by = np.lexsort((more, keys))
        starts = np.append(True, (np.diff(keys[by]) != 0) | (np.diff(more[by]) != 0))
        at = np.empty(len(by), np.int64)
        at[by] = np.cumsum(starts) - 1
        distinct = int(starts.sum())
    else:
        found, at = np.unique(keys, return_inverse=True)
        distinct = len(found)
    n = np.concatenate([np.zeros(k, np.int64) if x is None else _large(x) for k, x in zip(size, part["n"], strict=True)])
    deleted = np.repeat((part["part"] == DELETED).to_numpy(), size)
    total = np.bincount(at, n, distinct).astype(np.int64)
    gone = np.bincount(at, n * deleted, distinct).astype(np.int64)
    cuts = np.append(0, np.cumsum(size))
    out = []
    for i, (block, p) in enumerate(zip(part["block"], part["part"], strict=True)):
        own = at[cuts[i] : cuts[i + 1]]
        out.append((block, order, bucket, _small(total[own]), _small(gone[own]) if p == DELETED else None, 0, 0, 0))
    out.append((-1, order, bucket, None, None, int(total.sum()), int((total > 0).sum()), int(gone.sum())))
    return pd.DataFrame(out, columns=["block", "order", "bucket", "all", "gone", "tokens", "types", "deleted"])


def _counts(answers, column: str) -> tuple[np.ndarray, np.ndarray]:
    """(unigram counts by place in vocab, bigram counts by place among the block's sorted keys)."""
    a = answers.sort_values("bucket")
    return tuple(np.concatenate([_large(x) for x in a[column][a["order"] == k]]) for k in (1, 2))


def _token_counts(row: dict, answers, column: str, bits: int):
    """(lens, words, c(word), c(context), c(pair)) for each token, and c(word) by place."""
    lens, vocab, words, before = _read(row)
    single, double = _counts(answers, column)
    _, at = np.unique(_pairs(vocab, words, before, bits), return_inverse=True)
    end = single[words[lens[0] - 1]]  # each training document begins once and ends once
    context = np.append(single, end)[before]
    return lens, single[words], context, double[at]


def _level(context: np.ndarray) -> np.ndarray:
    """0 for an unseen context, else one more than the floor of the binary logarithm of its count."""
    return np.frexp(context.astype(np.float64))[1]


def learn_weights(bins: np.ndarray, rounds: int = 200) -> np.ndarray:
    """Mixture weights (64 levels; bigram, unigram, uniform) from rows (level, bigram ratio, unigram ratio, n), the ratios
    to the uniform probability. Every component gets one token on top, so none vanishes; a level without tokens takes the
    nearest one that has some; an unseen context has no bigram part."""
    weights = np.full((64, 3), np.nan)
    for level in np.unique(bins[:, 0]).astype(int):
        own = bins[bins[:, 0] == level]
        p = np.column_stack([own[:, 1], own[:, 2], np.ones(len(own))])
        w = np.full(3, 1 / 3)
        for _ in range(rounds):
            mixed = p * w
            new = (mixed / mixed.sum(axis=1, keepdims=True) * own[:, 3:4]).sum(axis=0) + 1
            new /= new.sum()
            done = np.abs(new - w).max() < 1e-9
            w = new
            if done:
                break
        weights[level] = w
    known = np.flatnonzero(~np.isnan(weights[:, 0]))
    for level in range(64):
        if np.isnan(weights[level, 0]):
            weights[level] = weights[known[np.abs(known - level).argmin()]] if len(known) else 1 / 3
    weights[0, 0] = 0
    weights[0] /= weights[0].sum()
    return weights


def score_texts(docs: DataFrame, part: Column, id_col: str = "doc_id", text_col: str = "text", block_tokens: int = 500_000) -> tuple[DataFrame, np.ndarray]:
    """(scores, weights): for every row of docs doc_id, part, n_tokens, n_known, train_tokens, base_score, score.

    part: KEPT and DELETED rows are learned from (the weights on the latter), TEST rows are only scored. Tokens are the
    words of the text with A-Z lower-cased, then one end; a null or empty text is just that end. base_score is the sum of
    log10((c + 1) / (N + V + 1)) over the tokens; score the model's log10 probability. With nothing to learn from, every
    count is 0 and both are the uniform probability over the unknown. Repeated rows are scored each; a null id stays null.

    A document longer than a block is a block of its own. Each bucket of hashes holds about a million distinct keys of
    blocks; on the driver there are only totals and the binned ratios (a fixed number of bins).
    """
    kind = dict(docs.dtypes)[id_col]
    read = docs.select(F.col(id_col).cast("string").alias("id"), part.cast("int").alias("part"), F.col(text_col).cast("string").alias("text"))
    blocks = written(_blocks(read, block_tokens).withColumn("_block", F.monotonically_increasing_id()))
    tokens = blocks.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    bits = max(3, int(np.ceil(np.log2(max(1, tokens / 1_000_000)))))
    schema = "block long, order int, bucket int, all binary, gone binary, tokens long, types long, deleted long"
    answers = written(_asks(blocks, bits).groupBy("order", "bucket").applyInPandas(_answer, schema))
    sums = answers.where("block = -1 and order = 1").agg(*[F.coalesce(F.sum(c), F.lit(0)) for c in ("tokens", "types", "deleted")]).first()
    n_all, n_types, n_gone = (int(x) for x in sums)
    uniform = 1 / (n_types + 1)

    def ratios(_key, block, own):
        import pandas as pd

        row = block.iloc[0].to_dict()
        found, lost = (_token_counts(row, own, c, bits) for c in ("all", "gone"))
        word, context, pair = (x - y for x, y in zip(found[1:], lost[1:], strict=True))
        with np.errstate(divide="ignore"):
            two = np.where(pair > 0, np.round(_STEP * np.log2(pair / np.maximum(context, 1) / uniform)), -9999)
            one = np.where(word > 0, np.round(_STEP * np.log2(word / max(1, n_all - n_gone) / uniform)), -9999)
        cells, n = np.unique(np.column_stack([_level(context), two, one]).astype(np.int32), axis=0, return_counts=True)
        return pd.DataFrame({"level": cells[:, 0], "two": cells[:, 1], "one": cells[:, 2], "n": n})

    gone = blocks.where(F.col("part") == DELETED).select("_block", "part", "lens", "vocab", "words")
    replies = answers.where("block >= 0").withColumnRenamed("block", "_block")
    bins = gone.groupBy("_block").cogroup(replies.where("gone is not null").groupBy("_block")).applyInPandas(ratios, "level int, two int, one int, n long")
    bins = np.asarray(bins.groupBy("level", "two", "one").agg(F.sum("n").alias("n")).collect(), np.float64).reshape(-1, 4)
    for c in (1, 2):
        bins[:, c] = np.where(bins[:, c] == -9999, 0, 2.0 ** (bins[:, c] / _STEP))
    weights = learn_weights(bins)

    def scored(_key, block, own):
        import pandas as pd

        row = block.iloc[0].to_dict()
        lens, word, context, pair = _token_counts(row, own, "all", bits)
        w = weights[_level(context)]
        p = w[:, 0] * pair / np.maximum(context, 1) + w[:, 1] * word / max(1, n_all) + w[:, 2] * uniform
        starts = np.append(0, np.cumsum(lens)[:-1])
        add = lambda x: np.add.reduceat(x, starts)
        return pd.DataFrame({
            "id": block["ids"].iloc[0], "part": row["part"], "n_tokens": lens.astype(np.int64), "n_known": add((word > 0).astype(np.int64)),
            "base_score": add(np.log10((word + 1) / (n_all + n_types + 1))), "score": add(np.log10(p)),
        })

    out = blocks.select("_block", "part", "ids", "lens", "vocab", "words").groupBy("_block").cogroup(replies.select("_block", "order", "bucket", "all").groupBy("_block"))
    out = out.applyInPandas(scored, "id string, part int, n_tokens long, n_known long, base_score double, score double")
    return out.select(F.col("id").cast(kind).alias("doc_id"), "part", "n_tokens", "n_known", F.lit(n_all).cast("long").alias("train_tokens"), "base_score", "score"), weights
