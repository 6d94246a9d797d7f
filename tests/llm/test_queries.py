"""The queries as registered, on a small folder of odd tables: types, parameters and brute force."""

import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from refaudit.llm.mixing import mix, taken_words
from refaudit.llm.packing import sum_of_squares
from refaudit.llm.queries import QUERIES, URL_RULES
from refaudit.llm.sharding import cut_links

from .brute import brute_bayes, brute_exact, brute_near, brute_templates, brute_top, water

PATH = public_tokenizers.path("byte_bpe_50k.json")


def _documents():
    r = random.Random(21)
    say = {"en": "the of and river stone house with light over".split(), "de": "der und die Fluss Stein Haus über Licht mit".split()}
    rows = []
    for i in range(90):
        lang = r.choice(["en", "de"])
        rows.append((i, " ".join(r.choice(say[lang]) for _ in range(r.randrange(1, 60))), lang, r.choice(["src1", "src1", "Src2", None])))
    rows += [(100 + i, rows[0][1], "en", "src1") for i in range(12)] + [(120, rows[1][1] + "  \n", "en", "é"), (5, rows[5][1], rows[5][2], rows[5][3])]
    rows += [(130, None, "en", "src1"), (131, "", None, None), (132, "½ ² Ⅷ 7", "en", "src1"), (133, " ".join(f"w{i}" for i in range(5000)), "en", "src1"), (None, "no id here but words", "en", "src1"), (134, "日本語、テキスト。" * 400, None, "é")]
    return rows


@pytest.fixture(scope="module")
def docs():
    return _documents()


@pytest.fixture(scope="module")
def sf(spark, tmp_path_factory, docs):
    d = str(tmp_path_factory.mktemp("tables"))
    df = spark.createDataFrame([(*x, len(x[1] or "")) for x in docs], "doc_id long, text string, lang string, source string, n_chars int")
    df.withColumns({"shard": F.lit("x"), "size": F.lit(1), "_row": F.lit(2)}).repartition(3).write.parquet(f"{d}/documents.parquet")
    return d


def _remainder(i, n):
    return -1 if i is None else zlib.crc32(str(i).encode()) % n


def _words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def _types(df):
    return ", ".join(f"{n} {t}" for n, t in df.dtypes)


def test_op1(spark, sf, docs):
    """Every document's words, taken as often as the passes and the cut last block of its source's stream say."""
    df = QUERIES["op1_mixing"](spark, sf)
    assert _types(df) == "doc_id bigint, size bigint, source_size bigint, target double, taken bigint"
    got = Counter(map(tuple, df.collect()))
    sizes = Counter()
    for _, text, _, source in docs:
        sizes[source] += len(_words(text))
    target = water(sizes, (5, 2, 1), 1.5, 2.0)
    laid, taken = mix(spark.read.parquet(f"{sf}/documents.parquet"))
    streams = defaultdict(list)
    for x in laid.collect():
        streams[x.source].append(x)
    want = Counter()
    for source, own in streams.items():
        own.sort(key=lambda x: (x.start, x["size"]))
        at = 0
        for x in own:
            assert x.start == at
            at += x["size"]
        times, left = np.zeros(at, int), int(target[source] + 1e-6)
        while left:
            for start in range(0, at, 1024):
                end = min(start + 1024, at, start + left)
                times[start:end] += 1
                left -= end - start
        for x in own:
            want[x.doc_id, x["size"], at, x.target, int(times[x.start : x.start + x["size"]].sum())] += 1
        assert own[0].target == pytest.approx(target[source])
    assert got == want == Counter(map(tuple, taken_words(laid, taken).select("doc_id", "size", "source_size", "target", "taken").collect()))


def test_op2(spark, sf, docs):
    df = QUERIES["op2_sharding"](spark, sf)
    assert _types(df) == "doc_id bigint, size bigint, text_crc32 bigint, law string, shard int, slot bigint, grown_shard int"
    rows = df.collect()
    assert Counter((r.doc_id, r["size"], r.text_crc32) for r in rows) == Counter((i, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t, *_ in docs)
    assert {(r.law, r.grown_shard) for r in rows} == {("rows", None)}
    sizes, slots = Counter(r.shard for r in rows), defaultdict(list)
    assert set(sizes) == set(range(40)) and max(sizes.values()) - min(sizes.values()) <= 1
    for r in rows:
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    # 13 equal rows over shards of 2 and 3: at least 5 shards, so the cut is at least that of 3, 3, 3, 3 and 1.
    links, cut = cut_links(df.where("size > 16"), ["text_crc32", "size"]).first()
    assert links == 13 * 12 // 2 + 1 and 13 * 12 // 2 - 12 <= cut <= 78 - 6


def test_op3(spark, tmp_path):
    r = random.Random(2)
    rows = [(i, [r.gauss(0, 1) for _ in range(16)]) for i in range(250)] + [(300, None), (400, [1.0, float("inf")])]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    df = QUERIES["op3_top_k"](spark, str(tmp_path))
    assert _types(df) == "query_id bigint, rank int, vec_id bigint, score bigint"
    stored = [(i, None if v is None else np.float32(v).astype(float).tolist()) for i, v in rows]
    assert sorted(map(tuple, df.collect())) == brute_top(stored)


def _brute_urls(urls):
    split = []
    for url in urls:
        rest = url.split("://", 1)[1] if url and "://" in url else ""
        host = re.match(r"[^/?#]*", rest)[0]
        split.append((host.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")), re.match(r"[^?#]*", rest[len(host) :])[0]))
    said = {}
    for h, p in split:
        fits = [(len(rh + rp), what, rh + rp) for what, rh, rp in URL_RULES if (h == rh or h.endswith("." + rh)) and p.startswith(rp)]
        said[h, p] = max(fits)[1:] if fits else (None, None)
    paths = defaultdict(lambda: np.zeros(3, int))
    for k in split:
        paths[k] += (1, said[k][0] is not None, said[k][0] == "block")
    found = brute_templates({k: tuple(map(int, v)) for k, v in paths.items()})
    return [(*k, said[k][1], said[k][0] or ("block" if found[k][2] and found[k][1] >= 0.7 else "allow"), found[k][0]) for k in split]


def test_op4(spark, tmp_path):
    r = random.Random(8)
    hosts = ["www.example.com", "a.Example.com", "b.net", "c.org", "d.org", "e.com"]
    urls = [f"http://{r.choice(hosts)}/{r.choice(['en', 'es', 'fr', 'pt'])}/{r.choice(['x', 'y/z', r.randrange(99), f'{r.randrange(9)}.html'])}{r.choice(['', '?q', '#f'])}" for _ in range(500)]
    urls += [None, "", "no scheme/en/", "://", "http://c.org", "http://c.org/" + "k" * 5000]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").withColumns({"html": F.lit("h"), "path": F.lit(0)})
    df.write.parquet(f"{tmp_path}/pages.parquet")
    out = QUERIES["op4_url_filter"](spark, str(tmp_path))
    assert _types(out) == "page_id bigint, host string, path string, rule string, verdict string, template string"
    got = sorted(map(tuple, out.collect()))
    assert got == [(i, *x) for i, x in enumerate(_brute_urls(urls))]
    assert {v for _, _, _, rule, v, _ in got if rule is None} == {"allow", "block"}


def test_op5_and_op7(spark, sf, docs):
    library = Tokenizer.from_file(PATH)
    ids = {}
    for _, t, *_ in docs:
        ids[t] = library.encode(t or "", add_special_tokens=False).ids
    df = QUERIES["op5_token_counts"](spark, sf)
    assert _types(df) == "doc_id bigint, n_bytes bigint, n_tokens bigint, over_limit boolean"
    assert Counter(map(tuple, df.collect())) == Counter((i, len((t or "").encode()), len(ids[t]), len(ids[t]) > 1024) for i, t, *_ in docs)
    df = QUERIES["op7_packing"](spark, sf)
    assert dict(df.dtypes) == {"doc_id": "bigint", "piece": "int", "start": "bigint", "length": "bigint", "ids_crc32": "bigint", "offset": "bigint", "sequence_id": "bigint"}
    rows, want = df.collect(), Counter()
    for i, t, *_ in docs:
        own, at, k = ids[t] + [0], 0, 0
        while at < len(own):
            end = at + ((len(own) - at) % 2048 or 2048)
            want[i, k, at, end - at, zlib.crc32(np.asarray(own[at:end], "<u4").tobytes())] += 1
            at, k = end, k + 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want
    filled = defaultdict(list)
    for r in rows:
        filled[r.sequence_id].append((r.offset, r.length))
    for own in filled.values():
        assert [o for o, _ in sorted(own)] == [sum(n for _, n in sorted(own)[:k]) for k in range(len(own))] and sum(n for _, n in own) <= 2048
    assert len(filled) == -(-sum(r.length for r in rows) // 2048)


def test_sum_of_squares_by_brute_force():
    """Each piece goes where the sum over gaps of squared counts of open sequences is smallest, then to the tightest gap."""
    r = random.Random(6)
    for _ in range(40):
        sizes = [r.randrange(1, 21) for _ in range(60)]
        seq, off = sum_of_squares(np.asarray(sizes), 20)
        gaps, used = [], 0
        for s, q, o in zip(sizes, seq.tolist(), off.tolist()):
            fit = [g for g in set(gaps) if g >= s]
            if not fit:
                assert (q, o) == (used, 0)
                used += 1
                gaps.append(20)
            else:
                def cost(g):
                    n = Counter(x for x in gaps if x)
                    n[g] -= 1
                    n[g - s] += g > s
                    return sum(v * v for v in n.values())

                assert gaps[q] == min(fit, key=lambda g: (cost(g), g)) and o == 20 - gaps[q]
            gaps[q] -= s


def test_op6(spark, sf, docs):
    df = QUERIES["op6_lm_score"](spark, sf)
    assert _types(df) == "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double"
    tokens = [[*(t or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")).split(), None] if t is None or t.isascii() else [*(w.encode().lower() for w in _words(t)), None] for _, t, *_ in docs]
    tokens = [[w.encode() if isinstance(w, str) else w for w in own] for own in tokens]
    c = Counter()
    for (i, *_), own in zip(docs, tokens):
        if _remainder(i, 7) != 2:
            c.update(own)
    n, v = sum(c.values()), len(c)
    want = sorted(((i is None, i or 0, _remainder(i, 7) == 2, len(own), sum(c[w] > 0 for w in own), n), sum(np.log10((c[w] + 1) / (n + v + 1)) for w in own)) for (i, *_), own in zip(docs, tokens))
    got = sorted(((r.doc_id is None, r.doc_id or 0, r.held_out, r.n_tokens, r.n_known, r.train_tokens), r.base_score) for r in df.collect())
    assert [x[0] for x in got] == [x[0] for x in want] and [x[1] for x in got] == pytest.approx([x[1] for x in want])
    assert all(r.score < 0 for r in df.collect())


def test_op8(spark, sf, docs):
    df = QUERIES["op8_exact_dedup"](spark, sf)
    assert _types(df) == "doc_id bigint, keep_id bigint, group_size bigint, kept boolean, text_sha256 string"
    assert Counter(map(tuple, df.collect())) == brute_exact([(i, t) for i, t, *_ in docs])


def test_op9(spark, sf, docs):
    df = QUERIES["op9_language"](spark, sf)
    assert _types(df) == "doc_id bigint, held_out boolean, lang_pred string, score double"
    labelled = [(t, lang) for i, t, lang, _ in docs if _remainder(i, 4) != 2 and t is not None and lang is not None]
    texts = [t for _, t, *_ in docs]
    has = [bool(t) and any(ch.isalpha() for ch in t) for t in texts]
    brute = iter(brute_bayes(labelled, [t for t, ok in zip(texts, has) if ok]))
    want = sorted((i is None, i or 0, _remainder(i, 4) == 2, *(next(brute) if ok else ("und", 0.0))) for (i, *_), ok in zip(docs, has))
    got = sorted((r.doc_id is None, r.doc_id or 0, r.held_out, r.lang_pred, r.score) for r in df.collect())
    assert [x[:4] for x in got] == [x[:4] for x in want] and [x[4] for x in got] == pytest.approx([x[4] for x in want])


def test_op10(spark, sf, docs):
    df = QUERIES["op10_near_dedup"](spark, sf)
    assert _types(df) == "doc_id bigint, n_shingles bigint, component_id bigint, kept boolean"
    assert Counter(map(tuple, df.collect())) == brute_near([(i, t) for i, t, *_ in docs], 3, 85)


def test_pipeline(spark, sf, docs):
    rows = QUERIES["pipeline"](spark, sf).collect()
    known = {i for i, t, *_ in docs if t and any(ch.isalpha() for ch in t)}
    assert {r.doc_id for r in rows} <= known and {132, 131, 130} & {r.doc_id for r in rows} == set()
    first = Counter((r.doc_id, r.piece) for r in rows)
    assert max(first.values()) <= 2 and sum(r.length for r in rows if r.sequence_id == rows[0].sequence_id) <= 2048
