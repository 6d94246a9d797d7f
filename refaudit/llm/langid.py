"""Language identification: multinomial naive Bayes over hashed character n-grams."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import each

UNKNOWN = "und"
_WORD_CHARACTER = re.compile(r"[^\W\d_]")
_SPACE = re.compile("[\\x00-`{-\\x7f]+")
#: Odd multipliers for the n-gram hash (any odd numbers do).
_MIX = np.asarray([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F, 0x165667B1], np.uint32)


@dataclass(frozen=True)
class Model:
    langs: list[str]
    log_prob: np.ndarray  # one row per language and one column per bucket
    log_prior: np.ndarray
    bits: int
    sizes: tuple[int, ...]


def has_letter(text: str) -> bool:
    """Whether a character of the text is a letter (category L). Number signs such as a fraction or a Roman numeral aren't."""
    return any(m[0].isalpha() for m in _WORD_CHARACTER.finditer(text))


def _plain(text: str) -> str:
    """The lower-cased text with a space before and after, each run of ASCII characters that aren't letters one space."""
    return _SPACE.sub(" ", f" {text.lower()} ")


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), np.uint32)


def hashed(codes: np.ndarray, n: int, bits: int) -> np.ndarray:
    """The bucket of the n-gram that starts at each character."""
    h = np.full(max(0, len(codes) - n + 1), n * 0x51ED27, np.uint32)
    for i in range(n):
        h = (h ^ codes[i : len(codes) - n + 1 + i]) * _MIX[i]
        h ^= h >> np.uint32(15)
    return (h >> np.uint32(32 - bits)).astype(np.int32)


def windows(text: str, size: int, sizes: tuple[int, ...]) -> Iterator[str]:
    """A prepared text in stretches of `size` characters, each with what the last n-grams that start in it need besides."""
    for at in range(0, len(text), size):
        yield text[at : at + size + max(sizes) - 1]


def train(docs: DataFrame, bits: int = 15, sizes: tuple[int, ...] = (1, 2, 3), sample: int = 20_000, smoothing: float = 0.5, text_col: str = "text", lang_col: str = "lang", seed_col: str = "doc_id", most_langs: int = 256, window: int = 1 << 18) -> Model:
    """Fits on labelled rows (text and lang not null), at most about `sample` of them, chosen by a hash of seed_col.

    Rows of one language are counted where they lie, a dense vector of 2**bits counts for each task and language; only those
    vectors, once summed, reach the driver. They are as many as languages, and of labels only the most_langs most frequent
    (ties: first by name) are learned, so that dirty labels can't fill the driver: at most most_langs * 2**bits counts. No
    labelled row gives a model that knows no language.
    """
    import pyarrow as pa

    rows = docs.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"), F.xxhash64(F.col(seed_col).cast("string"), F.lit("langid")).alias("_h")).where("lang is not null and text is not null")
    found = rows.groupBy("lang").agg(F.count("*").alias("n"))
    n = found.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    langs = sorted(r[0] for r in found.orderBy(F.desc("n"), "lang").limit(most_langs).collect())
    rows = rows.where(F.col("lang").isin(langs))
    if n > sample:
        rows = rows.where(F.pmod("_h", F.lit(1 << 20)) < F.lit(int((1 << 20) * sample / n)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, np.ndarray] = {}
        seen: dict[str, int] = {}
        for b in batches:
            for lang, text in zip(b.column(0).to_pylist(), each(b.column(1)), strict=True):
                c = counts.setdefault(lang, np.zeros(1 << bits, np.int64))
                seen[lang] = seen.get(lang, 0) + 1
                for part in windows(_plain(text), window, sizes):
                    codes = _codes(part)
                    for k in sizes:
                        c += np.bincount(hashed(codes, k, bits)[:window], minlength=1 << bits)
        for lang, c in counts.items():
            at = np.flatnonzero(c)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * (len(at) + 1)), pa.array(np.append(at, -1).astype(np.int32)), pa.array(np.append(c[at], seen[lang]))], ["lang", "bucket", "n"])

    sums = rows.select("lang", "text").mapInArrow(run, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()
    langs = [x for x in langs if (sums["lang"] == x).any()]
    table = np.zeros((len(langs), 1 << bits))
    prior = np.ones(max(1, len(langs)))
    for k, lang in enumerate(langs):
        own = sums[sums["lang"] == lang]
        grams = own[own["bucket"] >= 0]
        table[k, grams["bucket"].to_numpy()] = grams["n"].to_numpy()
        prior[k] = own[own["bucket"] < 0]["n"].sum()
    table += smoothing
    return Model(langs, np.log(table) - np.log(table.sum(axis=1, keepdims=True)), np.log(prior / prior.sum()), bits, sizes)


def _sums(model: Model, parts: list[str], window: int) -> np.ndarray:
    """For each part (row) and language (column), the log probabilities of the n-grams that start in its first `window`
    characters, added up: the parts' characters lie end to end, and one reduction per n-gram size and language takes them all."""
    codes = _codes("".join(parts))
    lens = np.fromiter(map(len, parts), np.int64, len(parts))
    starts = np.cumsum(lens) - lens
    out = np.zeros((len(parts), len(model.langs)))
    for n in model.sizes:
        ends = starts + np.minimum(lens - n + 1, window)
        some = np.flatnonzero(ends > starts)
        if not len(some):
            continue
        buckets = hashed(codes, n, model.bits)
        cuts = np.column_stack([starts[some], ends[some]]).ravel()
        for j, own in enumerate(model.log_prob):
            # A last zero, since the last cut may lie at the end.
            out[some, j] += np.add.reduceat(np.append(own[buckets], 0.0), cuts)[::2]
    return out


def score(model: Model, texts: Iterable[str | None], window: int = 1 << 18) -> tuple[list[str], np.ndarray]:
    """(language, posterior probability) of each text, scored in batches of about `window` characters: short texts together,
    long ones in stretches. Besides the texts and one lower-cased copy of each, memory doesn't follow their length."""
    rows: list[int] = []
    parts: list[str] = []
    totals: list[np.ndarray | None] = []
    held = 0

    def flush() -> None:
        if parts:
            for i, s in zip(rows, _sums(model, parts, window), strict=True):
                totals[i] = totals[i] + s
        rows.clear()
        parts.clear()

    for i, text in enumerate(texts):
        known = bool(text) and bool(model.langs) and has_letter(text)
        totals.append(model.log_prior if known else None)
        for part in windows(_plain(text), window, model.sizes) if known else ():
            rows.append(i)
            parts.append(part)
            held += len(part)
            if held >= window:
                flush()
                held = 0
    flush()
    langs = [UNKNOWN if t is None else model.langs[int(t.argmax())] for t in totals]
    return langs, np.asarray([0.0 if t is None else 1 / np.exp(t - t.max()).sum() for t in totals])


def identify(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """All columns of docs, then lang_pred and score (0 to 1), read from the text alone.

    A null text or one without a letter is `und` with score 0; so is every text if the model knows no language. Ties go to
    the language that sorts first. Repeated rows and null columns are passed through; columns named lang_pred or score are
    replaced. The model (at most most_langs rows of 2**bits numbers) is broadcast; its size doesn't depend on the input.
    """
    import pyarrow as pa

    docs = docs.drop("lang_pred", "score")
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in batches:
            langs, best = score(m, each(b.column(at)))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(langs, pa.string()), pa.array(best, pa.float64())], [*b.schema.names, "lang_pred", "score"])

    from pyspark.sql.types import DoubleType, StringType, StructType

    schema = StructType([*docs.schema.fields]).add("lang_pred", StringType()).add("score", DoubleType())
    return docs.mapInArrow(run, schema)
