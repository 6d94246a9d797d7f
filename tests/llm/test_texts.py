"""Token counts, packing, language identification and language-model scoring."""

import math
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from refaudit.llm.langid import identify, score, train
from refaudit.llm.ngram_lm import DELETED, KEPT, TEST, learn_weights, score_texts
from refaudit.llm.packing import pack, sum_of_squares
from refaudit.llm.tokens import count_tokens, encoder

from .brute import brute_bayes

PATH = public_tokenizers.path("byte_bpe_50k.json")
_LIB = Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


@given(st.text(max_size=200))
@settings(max_examples=150, deadline=None)
def test_ids_are_the_librarys(text):
    assert encoder(PATH).ids(text).tolist() == _LIB.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("text", ["", "a  b\n\n c  ", "x<|endoftext|>y", "it's we'll 12३४ ñ 😀😀", "word " * 30_000, " " * 100_000, "a b c d " * 9_000])
def test_long_texts_split_safely(library, text):
    wanted = library.encode(text, add_special_tokens=False).ids
    assert encoder(PATH).ids(text, size=1000).tolist() == wanted
    assert encoder(PATH).count([text, "x"], batch_bytes=100, size=1000) == [len(wanted), 1]


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "piece_bpe_32k.model"])
def test_other_vocabularies(name):
    path = public_tokenizers.path(name)
    if name.endswith(".json"):
        wanted = Tokenizer.from_file(path).encode("Hello big world", add_special_tokens=False).ids
    else:
        import sentencepiece

        wanted = sentencepiece.SentencePieceProcessor(model_file=path).encode("Hello big world")
    assert encoder(path).ids("Hello big world").tolist() == wanted and encoder(path).count(["Hello big world"]) == [len(wanted)]


def test_count_tokens(odd, library):
    got = count_tokens(odd, PATH).collect()
    texts = [r.text or "" for r in odd.collect()]
    assert Counter((r.n_bytes, r.n_tokens, r.over_limit) for r in got) == Counter((len(t.encode()), n := len(library.encode(t).ids), n > 1024) for t in texts)
    assert count_tokens(odd.limit(0), PATH).count() == 0


@given(st.lists(st.integers(1, 64), max_size=300))
@settings(max_examples=60, deadline=None)
def test_sum_of_squares_never_overlaps(sizes):
    seq, off = sum_of_squares(np.asarray(sizes, np.int64), 64)
    used = {}
    for s, q, o in zip(sizes, seq, off):
        assert used.setdefault(q, 0) == o
        used[q] += s
    assert all(x <= 64 for x in used.values())


def test_pack_round_trip(odd, library):
    rows = pack(odd, PATH, capacity=64, with_ids=True, group_rows=200).collect()
    by_sequence = {}
    for r in rows:
        assert zlib.crc32(np.asarray(r.ids, "<u4").tobytes()) == r.ids_crc32 and len(r.ids) == r.length <= 64
        by_sequence.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in by_sequence.values():
        parts.sort()
        assert [o for o, _ in parts] == [sum(n for _, n in parts[:i]) for i in range(len(parts))] and sum(n for _, n in parts) <= 64
    pieces = sorted((r for r in rows if r.doc_id == 5), key=lambda r: r.piece)
    assert [i for r in pieces for i in r.ids] == library.encode(odd.where("doc_id = 5").first().text).ids + [0]
    assert [r.start for r in pieces] == [sum(x.length for x in pieces[:i]) for i in range(len(pieces))] and all(r.length == 64 for r in pieces[1:])
    assert sum(r.length for r in rows) == sum(len(library.encode(r.text or "").ids) + 1 for r in odd.collect())
    assert len(by_sequence) <= 1.1 * sum(r.length for r in rows) / 64 + 2
    assert pack(odd.limit(0), PATH).count() == 0


def test_language(spark, odd):
    from pathlib import Path

    SF = Path("/root/testdata/sf0.001")

    docs = spark.read.parquet(str(SF / "documents.parquet")).withColumn("held", F.crc32(F.col("doc_id").cast("string")) % 4 == 2)
    model = train(docs.where("not held"))
    held = identify(docs.where("held"), model).toPandas()
    assert (held["lang"] == held["lang_pred"]).mean() >= 0.98 and held["score"].between(0, 1).all()
    got = {(r.doc_id, r.text is None): r for r in identify(odd, model).collect()}
    assert got[(2, False)].lang_pred == got[(3, True)].lang_pred == got[(6, False)].lang_pred == got[(7, False)].lang_pred == "und"
    assert got[(4, False)].lang_pred != "und" and got[(2, False)].score == 0
    assert identify(odd.limit(0), model).count() == 0
    assert {r.lang_pred for r in identify(odd, train(odd.limit(0))).collect()} == {"und"}


def test_number_signs_are_no_letters(spark):
    texts = ["½ ① 12", "²", "Ⅷ", "12_3", "ª", "x", "½ ñ", "日"]
    docs = spark.createDataFrame([(i, t, lang) for i, t in enumerate(texts) for lang in ("aa", "bb")], "doc_id int, text string, lang string")
    got = {r.text: r.lang_pred for r in identify(docs, train(docs)).collect()}
    assert [got[t] == "und" for t in texts] == [True, True, True, True, False, False, False, False]


def test_language_against_brute_force(spark):
    labelled = [("the cat sat on the mat", "en"), ("a dog and the bird", "en"), ("der hund und die katze", "de"), ("ein Vogel über dem Haus", "de"), ("le chat et l'oiseau", "fr")]
    texts = ["the dog", "die Katze über uns", "l'oiseau, le chat!", "x" * 50 + " und " * 30, "Ünd 12 the", "ΑΣ ΣΑΣ"]
    train_on = spark.createDataFrame([(i, *r) for i, r in enumerate(labelled)], "doc_id int, text string, lang string")
    model = train(train_on)
    want = brute_bayes(labelled, texts)
    for window in (1 << 18, 16, 3):
        langs, best = score(model, texts, window)
        assert langs == [w[0] for w in want] and best == pytest.approx([w[1] for w in want])
    assert train(train_on, window=5).log_prob == pytest.approx(model.log_prob)
    assert train(train_on, most_langs=2).langs == ["de", "en"]


def _brute_counts(rows):
    tokens = {i: (t or "").encode().lower().split() + [0] for i, t, _ in rows}
    c = Counter()
    for i, _, part in rows:
        if part != TEST:
            c.update(tokens[i])
    return tokens, c


def test_lm_matches_brute_force(spark):
    from pathlib import Path

    SF = Path("/root/testdata/sf0.001")

    docs = spark.read.parquet(str(SF / "documents.parquet")).select("doc_id", "text", "lang")
    rem = F.crc32(F.col("doc_id").cast("string")) % 7
    part = F.when(rem == 2, TEST).when(rem == 3, DELETED).otherwise(KEPT)
    scores, weights = score_texts(docs, part, block_tokens=5000)
    got = {r.doc_id: r for r in scores.collect()}
    rows = [(r.doc_id, r.text, r.part) for r in docs.withColumn("part", part).collect()]
    tokens, c = _brute_counts(rows)
    pairs = Counter()
    for i, _, p in rows:
        if p != TEST:
            pairs.update(zip([None, *tokens[i]], tokens[i]))
    n, v = sum(c.values()), len(c)
    c[None] = c[0]
    for i, _, p in rows:
        base = sum(math.log10((c[w] + 1) / (n + v + 1)) for w in tokens[i])
        full = 0.0
        for h, w in zip([None, *tokens[i]], tokens[i]):
            a, b, u = weights[math.frexp(c[h])[1]]
            full += math.log10(a * pairs[h, w] / max(1, c[h]) + b * c[w] / n + u / (v + 1))
        r = got[i]
        assert (r.part, r.n_tokens, r.n_known, r.train_tokens) == (p, len(tokens[i]), sum(c[w] > 0 for w in tokens[i]), n)
        assert r.base_score == pytest.approx(base) and r.score == pytest.approx(full)
    held = [r for r in got.values() if r.part == TEST]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_lm_weights():
    w = learn_weights(np.asarray([[3, 1000.0, 10.0, 500], [3, 0.0, 10.0, 100], [5, 0.0, 0.0, 50]]))
    assert np.allclose(w.sum(axis=1), 1) and w[3, 0] > 0.5 and w[5, 2] > 0.9 and w[0, 0] == 0 and (w[:, 2] > 0).all()


def test_lm_odd_rows(odd):
    got = score_texts(odd, F.lit(KEPT))[0].collect()
    assert len(got) == odd.count() and all(r.score <= 0 and r.n_tokens >= 1 for r in got)
    assert {r.train_tokens for r in score_texts(odd, F.lit(TEST))[0].collect()} == {0}
    assert score_texts(odd.limit(0), F.lit(KEPT))[0].count() == 0


def test_near_dedup_frees_shuffles_between_steps(spark, monkeypatch):
    """Shuffle files of a step are given up before later steps write theirs, not when the driver's heap happens to fill."""
    from refaudit.llm import near_dedup

    steps = []
    for name in ("swept", "written"):
        monkeypatch.setattr(near_dedup, name, lambda *a, f=getattr(near_dedup, name), n=name, **k: (steps.append(n), f(*a, **k))[1])
    docs = spark.createDataFrame([(i, " ".join(f"w{j}" for j in range(40)) + f" x{i // 2}") for i in range(8)], "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in near_dedup.near_groups(docs).collect()}
    assert got == dict.fromkeys(range(8), 0)
    assert steps[0] == steps[-1] == "swept" and steps.count("swept") >= 8
