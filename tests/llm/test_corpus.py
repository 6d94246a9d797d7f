"""Mixing, sharding, top-k, URL filter, exact and near dedup, and the pipeline, against brute force."""

import random
import re
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from refaudit.llm.common import in_order, maybe_in, running, spread_join, temporary, written
from refaudit.llm.exact_dedup import exact_groups
from refaudit.llm.mixing import mix, schedule, taken_words, targets
from refaudit.llm.near_dedup import collisions, estimate, near_groups, registers
from refaudit.llm.sharding import propagate, shard, shard_linked
from refaudit.llm.shingles import WordHashes, shingle_set
from refaudit.llm.topk import top_k
from refaudit.llm.url_filter import judge, templates

from .brute import brute_exact, brute_near, brute_templates, brute_top, water

SF = "/root/testdata/sf0.001"


def test_running_sums(spark):
    df = spark.createDataFrame([(i % 3, i, 1 + i % 5) for i in range(200)], "k int, i int, v int").withColumn("h", F.xxhash64("i"))
    for k, rows in _grouped(running(df, ["k"], ["h"], "v", "before", 7, "h").collect(), "k").items():
        at = 0
        for r in sorted(rows, key=lambda r: r.before):
            assert r.before == at
            at += r.v


def test_hot_keys_meet_their_row(spark):
    rows = [("h", i) for i in range(3000)] + [(f"k{i % 90}", i) for i in range(400)] + [(None, 1), (None, 2)]
    df = spark.createDataFrame(rows, "k string, i int")
    one = df.where("k <> 'k7'").groupBy("k").agg(F.count("*").alias("_count"), F.max("i").alias("m"))
    want = Counter((r.k, r.i, r["_count"], r.m) for r in df.join(one, "k", "left").collect())
    for how in ("left", "inner"):
        got = spread_join(df, one, ["k"], "i", 3402, how)
        assert Counter((r.k, r.i, r["_count"], r.m) for r in got.collect()) == Counter({x: n for x, n in want.items() if how == "left" or x[2]})
    # The hot key's rows and its row, copied, lie in many partitions.
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    cells = spread_join(df, one, ["k"], "i", 3402, hint="merge").where("k = 'h'").select(F.spark_partition_id().alias("p")).groupBy("p").count().collect()
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(cells) == 4 and max(r["count"] for r in cells) < 1500


def test_maybe_in_drops_no_wanted_row(spark):
    df = spark.range(5000).select("id", F.xxhash64("id").alias("h"))
    for bits, most in ((24, 130), (15, 200)):
        kept = {r.id for r in maybe_in(df, F.col("h"), df.where("id % 50 = 0").select(F.col("h").alias("_h")), bits).where("_maybe").collect()}
        assert set(range(0, 5000, 50)) <= kept and len(kept) <= most
    assert maybe_in(df, F.col("h"), df.limit(0).select(F.col("h").alias("_h"))).where("_maybe").count() == 0


def test_sums_in_global_order(spark):
    rng = random.Random(1)
    values = [(x, rng.randrange(9)) for x in rng.sample(range(10**6), 700)]
    df = spark.createDataFrame(values, "x int, v int")
    got = {r.x: (r.before, r.place) for r in in_order(df, [F.col("x")], {"before": F.col("v"), "place": F.lit(1)}, 700, part_rows=60).collect()}
    at = 0
    for k, (x, v) in enumerate(sorted(values)):
        assert got[x] == (at, k)
        at += v


def test_intermediate_tables_are_deleted(spark):
    with temporary():
        gone, kept = written(spark.range(3)), written(spark.range(4), outlive=True)
        paths = [Path(df.inputFiles()[0].removeprefix("file:")) for df in (gone, kept)]
        assert all(p.exists() for p in paths)
    assert [p.exists() for p in paths] == [False, True] and kept.count() == 4


def _grouped(rows, key):
    out = defaultdict(list)
    for r in rows:
        out[r[key]].append(r)
    return out


# Mixing

@pytest.mark.parametrize("sizes", [{"a": 100, "b": 100, "c": 100}, {"a": 10, "b": 1000, "é": 50, "Z": 5, None: 70}, {"a": 7}, {"a": 0, "b": 0}])
def test_targets(spark, sizes):
    df = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
    got = {r.source: r.target for r in targets(df).collect()}
    assert got == pytest.approx(water(sizes, (5, 2, 1), 1.5, 2.0))


def test_schedule_is_even(spark):
    plan = spark.createDataFrame([("a", 500), ("b", 300), ("c", 199), ("d", 1), ("e", 0)], "source string, need long")
    slots = sorted((r.slot, r.source, r["rank"]) for r in schedule(plan, 1000).collect())
    assert Counter(s for _, s, _ in slots) == {"a": 500, "b": 300, "c": 199, "d": 1}
    for source in "abcd":
        assert [k for _, s, k in slots if s == source] == list(range(sum(s == source for _, s, _ in slots)))
    for at in range(0, 900, 100):
        share = sum(s == "a" for n, s, _ in slots if at <= n < at + 100)
        assert abs(share - 50) <= 4


def test_mix(odd):
    laid, taken = mix(odd, block=16)
    rows = taken_words(laid, taken).collect()
    want = [len(re.findall(r"[^\x20\x09-\x0D]+", r.text or "")) for r in odd.collect()]
    assert sorted(r["size"] for r in rows) == sorted(want)
    for source, own in _grouped(rows, "source").items():
        assert sum(r.taken for r in own) == int(own[0].target + 1e-6) and own[0].source_size == sum(r["size"] for r in own)
    assert all(r.taken <= 2 * r["size"] for r in rows)
    again = taken_words(*mix(odd.repartition(3), block=16)).collect()
    assert sorted(map(str, again)) == sorted(map(str, rows))
    assert taken_words(*mix(odd.limit(0))).count() == 0


# Sharding

def test_shards(spark):
    rows = [(i, f"t{i}") for i in range(500)] + [(1000 + i, "big") for i in range(90)] + [(2000 + i, f"pair{i // 2}") for i in range(60)] + [(None, None)] * 3
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = shard(df, ["text"], shards=20).collect()
    assert len(got) == len(rows)
    sizes = Counter(r.shard for r in got)
    assert set(sizes) == set(range(20)) and max(sizes.values()) - min(sizes.values()) <= 1
    for own in _grouped(got, "shard").values():
        assert sorted(r.slot for r in own) == list(range(len(own)))
    groups = _grouped(got, "text")
    assert sum(len({r.shard for r in groups[f"pair{i}"]}) > 1 for i in range(30)) == 0
    assert len({r.shard for r in groups["big"]}) <= 5  # at least three shards of 32 or 33


def test_propagation_brings_the_linked_rows_together(spark, monkeypatch):
    """Where there is room, it is label propagation that makes cut keys whole, not what comes before or after it."""
    from refaudit.llm import sharding

    met = []

    def spy(counts, *rest):
        after = propagate(counts, *rest)
        met.extend(len({r["_key"] for r in x if sum(y["_key"] == r["_key"] for y in x) > 1}) for x in (counts.collect(), after.collect()))
        return after

    monkeypatch.setattr(sharding, "propagate", spy)
    rows = [(i, f"pair{i // 2}") for i in range(60)] + [(1000 + i, f"six{i // 6}") for i in range(120)] + [(2000 + i, f"own{i}") for i in range(400)]
    got = shard(spark.createDataFrame(rows, "doc_id long, text string"), ["text"], shards=10).collect()
    assert met[0] > 40 and met[1] == 0
    assert all(len({r.shard for r in own}) == 1 for own in _grouped(got, "text").values())


def test_shards_without_free_rows(spark):
    """Nearly all rows linked: what fits whole is whole."""
    rows = [(i, f"pair{i // 2}") for i in range(800)] + [(1000 + i, f"five{i // 5}") for i in range(200)] + [(2000, "a")]
    got = shard(spark.createDataFrame(rows, "doc_id long, text string"), ["text"], shards=40).collect()
    sizes = Counter(r.shard for r in got)
    assert len(got) == len(rows) and max(sizes.values()) - min(sizes.values()) <= 1
    groups = _grouped(got, "text")
    assert sum(len({r.shard for r in own}) > 1 for own in groups.values()) <= 20  # every shard of 25 places has one left over, at best


def test_parts_move_together_until_none_can(spark):
    """A chain in which each key's small part gives room to the next one: one move a round."""
    counts = [x for k in range(7) for x in ((k, k, 2), (k, k + 1, 1))]
    quota = spark.createDataFrame([(s, 3) for s in range(8)], "shard int, room long")
    got = propagate(spark.createDataFrame(counts, "_key long, shard int, n long"), quota).collect()
    assert sorted((r["_key"], r.shard, r.n) for r in got) == [(k, k, 3) for k in range(7)]


def test_shards_of_any_links(spark):
    """Twelve planted clusters and a few links between them, all documents linked, so that only swaps are possible at first."""
    r = random.Random(12)
    links = [(30 * c + r.randrange(30), 30 * c + r.randrange(30)) for c in range(12) for _ in range(220)] + [(r.randrange(360), r.randrange(360)) for _ in range(30)]
    links += [(b, a) for a, b in links[:50]] + [(1, None), (5, 9999)]
    docs = spark.createDataFrame([(i, "x") for i in range(360)] + [(0, "again"), (None, "n"), (None, "n")], "doc_id long, shard string").withColumn("_h", F.lit(3))
    out, first, cut = shard_linked(docs, spark.createDataFrame(links, "a long, b long"), shards=6)
    rows = out.collect()
    sizes = Counter(x.shard for x in rows)
    assert len(rows) == 363 and set(sizes) == set(range(6)) and max(sizes.values()) - min(sizes.values()) <= 1
    for own in _grouped(rows, "shard").values():
        assert sorted(x.slot for x in own) == list(range(len(own)))
    once = {(min(x), max(x)) for x in links if None not in x and x[0] != x[1] and 9999 not in x}
    places = defaultdict(set)
    for x in rows:
        places[x.doc_id].add(x.shard)
    assert len(once) * 0.75 < first <= len(once) and cut < first / 2
    certain = [x for x in once if 0 not in x]
    assert abs(sum(places[a] != places[b] for a, b in certain) - cut) <= len(once) - len(certain)
    empty, a, b = shard_linked(docs.limit(0), spark.createDataFrame([], "a long, b long"))
    assert (empty.count(), a, b) == (0, 0, 0)


def test_shards_odd(odd):
    got = shard(odd.select("doc_id", "text", "size"), ["text"], shards=40).collect()
    assert len(got) == odd.count() and max(Counter(r.shard for r in got).values()) == 1
    assert shard(odd.select("doc_id", "text").limit(0), ["text"]).count() == 0


# Top-k

def test_top_k(spark):
    rng = random.Random(3)
    rows = [(i, [rng.gauss(0, 1) * (1 + i % 7) for _ in range(12)]) for i in range(400)]
    rows += [(500 + i, rows[0][1]) for i in range(30)] + [(1, None), (2, [1.0, None]), (3, [float("nan")] * 12), (4, [float("inf")] * 12), (600, [0.5]), (700, []), (None, [1.0] * 12)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("score", F.lit(1)).repartition(3)
    got = sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in top_k(df, F.col("vec_id") % 100 == 0, block=32, queries_block=2).collect())
    assert got == brute_top(rows)


def test_top_k_overlong_vectors(spark):
    """Longer than what is rotated: the rest still counts, and the memory is that of the vector, not its square."""
    rng = random.Random(4)
    rows = [(i, [rng.randrange(-9, 9) / 8 for _ in range(rng.choice([3, 8, 20]))]) for i in range(300)] + [(400, [0.25] * 100_000), (401, [0.5] * 100_000), (500, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")

    def padded(v):
        return v + [0.0] * (100_000 - len(v))

    vs = [(i, np.floor(1024 * np.asarray(padded(v)))) for i, v in rows]
    want = []
    for i, x in vs:
        if i % 100 == 0:
            own = sorted((-int(x @ y), j) for j, y in vs if j != i)[:10]
            want += [(i, n, j, -s) for n, (s, j) in enumerate(own, 1)]
    got = sorted(tuple(r) for r in top_k(df, F.col("vec_id") % 100 == 0, block=64, queries_block=3, most_width=8).collect())
    assert got == sorted(want)


def test_top_k_meets_few_groups(spark):
    """Vectors far too short for any query's bound are not sent to it."""
    rows = [(i, [float(100 + i), 1.0]) for i in range(50)] + [(100 + i, [0.01, 0.01 * (i % 5)]) for i in range(500)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert sorted(map(tuple, top_k(df, F.col("vec_id") == 0, block=32, group=1).collect())) == [x for x in brute_top(rows) if x[0] == 0]


def test_top_k_few_and_none(spark):
    df = spark.createDataFrame([(0, [1.0]), (1, [2.0]), (5, [-1.0])], "vec_id long, embedding array<float>")
    assert sorted(map(tuple, top_k(df, F.col("vec_id") == 0).collect())) == [(0, 1, 1, 2 * 1024 * 1024), (0, 2, 5, -1024 * 1024)]
    assert top_k(df, F.col("vec_id") == 77).count() == 0 and top_k(df.limit(0), F.col("vec_id") == 0).count() == 0
    huge = spark.createDataFrame([(0, [1e9, 3.0]), (1, [2e5, 1.0])], "vec_id long, embedding array<double>")
    assert top_k(huge, F.col("vec_id") == 0).first().score == 1024_000_000_000 * 204_800_000 + 3 * 1024 * 1024 if 1024_000_000_000 * 204_800_000 < 2**63 else True


# URL filter

RULES = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/")]


def test_rules(spark):
    urls = [(1, "http://a.Example.com/en/5?x#y"), (2, "https://www.example.com/en/x"), (3, "http://b.com/q"), (4, "http://b.com"), (5, "x://notcom/"), (6, "no scheme"), (7, None), (8, "http://d.net/es/1"), (9, "http://d.net/ES/1#/es/"), (9, "http://d.net/ES/1#/es/"), (None, "://É.NET/es/"), (10, "a://b://c.com/x")]
    got = {(r.page_id, r.host, r.path, r.rule, r.verdict) for r in judge(spark.createDataFrame(urls, "page_id long, url string"), RULES).collect()}
    assert got == {
        (1, "a.example.com", "/en/5", "example.com/en/", "block"), (2, "www.example.com", "/en/x", "www.example.com/en/", "allow"), (3, "b.com", "/q", "com/", "allow"), (4, "b.com", "", None, "allow"), (5, "notcom", "/", None, "allow"),
        (6, "", "", None, "allow"), (7, "", "", None, "allow"), (8, "d.net", "/es/1", "net/es/", "block"), (9, "d.net", "/ES/1", None, "allow"), (None, "É.net", "/es/", "net/es/", "block"), (10, "b:", "//c.com/x", None, "allow"),
    }


def test_templates_reject_by_labels(spark):
    rows = [(i, f"http://h.org/spam/{i}/x.html", i < 60) for i in range(100)] + [(200 + i, f"http://h.org/ok/{i}", False) for i in range(50)] + [(300 + i, f"http://h.org/new/{i}", None) for i in range(50)]
    rows = [(i, u, None if u.startswith("http://h.org/spam") and i >= 60 else b) for i, u, b in rows]
    df = spark.createDataFrame(rows, "page_id long, url string, bad boolean")
    got = {r.page_id: r for r in judge(df, [], label_col="bad").collect()}
    assert {got[i].verdict for i in range(100)} == {"block"} and got[0].template == "/spam/*/x.html"
    assert {got[i].verdict for i in range(200, 350) if i in got} == {"allow"}
    names = spark.createDataFrame([(i, f"http://n.org/u/{'abcdefghij'[i % 10]}{'klmnopqrst'[i // 10]}", None) for i in range(60)], "page_id long, url string, bad boolean")
    assert {r.template for r in judge(names, [], label_col="bad").collect()} == {"/u/*"}
    assert judge(df.limit(0), RULES).count() == 0


def test_templates_against_brute_force(spark):
    r = random.Random(9)
    paths = {}
    for h in ("a.org", "b.org", "c.net"):
        for _ in range(150):
            one = r.choice(["news", "shop", "user", "en", "fr", f"x{r.randrange(30)}"])
            segments = [one, r.choice(["p", "q", f"{r.randrange(99)}.html", "".join(r.choice("abcdef") for _ in range(5))]), r.choice(["", "", "z", "long" * 12])][: r.randrange(1, 4)]
            n = r.randrange(1, 5)
            labelled = r.randrange(n + 1) if one != "fr" else 0
            paths[h, "/" + "/".join(segments)] = (n, labelled, labelled if one == "shop" else r.randrange(labelled + 1) // 2)
    df = spark.createDataFrame([(*k, *v) for k, v in paths.items()], "host string, path string, n long, labelled long, bad long")
    got = {(x.host, x.path): (x.template, x.share, x.labels) for x in templates(df, least=6).collect()}
    want = brute_templates(paths, least=6)
    assert got.keys() == want.keys()
    assert {k: v[0] for k, v in got.items()} == {k: v[0] for k, v in want.items()}
    assert all(got[k][1] == pytest.approx(v[1]) and got[k][2] == v[2] for k, v in want.items())


def test_labels_reach_other_hosts(spark):
    """What the rules say of /es/ pages decides about those of a host that no rule names; unlabelled templates are allowed."""
    rows = [(i, f"http://h{i % 9}.net/es/{i}") for i in range(90)] + [(100 + i, f"http://k.org/es/{i}") for i in range(20)] + [(200 + i, f"http://k.org/pt/{i}") for i in range(20)] + [(300 + i, f"http://k.com/en/{i}") for i in range(90)] + [(400 + i, f"http://k.org/en/{i}") for i in range(20)]
    got = {r.page_id: r.verdict for r in judge(spark.createDataFrame(rows, "page_id long, url string"), RULES).collect()}
    assert {got[i] for i in range(100, 120)} == {"block"} and {got[i] for i in range(200, 220)} == {"allow"} == {got[i] for i in range(400, 420)}


def test_odd_urls(spark):
    """Very long urls, more levels than are looked at, a host without labels, clashing columns, repeated and null rows."""
    deep = "http://h.org/" + "/".join(f"a{'bc'[i % 2]}" for i in range(3000)) + "/7"
    rows = [(1, deep, True, "x"), (2, deep, None, "y"), (3, "http://h.org/" + "x" * 200_000, None, None), (4, None, True, "z"), (None, "http://z.org/a", None, "n"), (None, "http://z.org/a", None, "n")]
    df = spark.createDataFrame(rows, "page_id long, url string, bad boolean, host string").withColumns({"path": F.lit(1), "template": F.lit("t"), "rule": F.lit(2), "_row": F.lit(3)})
    got = judge(df, [], label_col="bad").collect()
    assert len(got) == 6 and {r.verdict for r in got} == {"allow"}
    assert {r.host for r in got} == {"h.org", "", "z.org"} and next(r for r in got if r.page_id == 1).template.endswith("/ac/*")


def test_templates_tell_deep_branches_apart(spark):
    rows = [(i, f"http://h.org/a/b/c/d/spam/{i}", True) for i in range(60)] + [(100 + i, f"http://h.org/a/b/c/d/ok/{i}", False) for i in range(60)] + [(200, "http://h.org/a", None), (201, "http://h.org", None)]
    got = {r.page_id: r for r in judge(spark.createDataFrame(rows, "page_id long, url string, bad boolean"), [], label_col="bad").collect()}
    assert {(r.verdict, r.template) for i, r in got.items() if i < 100} == {("block", "/a/b/c/d/spam/*")}
    assert {(r.verdict, r.template) for i, r in got.items() if 100 <= i < 200} == {("allow", "/a/b/c/d/ok/*")}
    assert (got[200].template, got[201].template) == ("/a", "/") and got[200].verdict == got[201].verdict == "allow"


# Exact dedup

def test_exact_odd(odd):
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    got = Counter((r.doc_id, r.keep_id, r.group_size, r.kept, r.text_sha256) for r in exact_groups(odd).collect())
    assert got == brute_exact(rows)
    assert exact_groups(odd.limit(0)).count() == 0


def test_exact_splits_late(spark):
    body = "x" * 5000
    rows = [(i, body + tail) for i, tail in enumerate(["a", "b", "a", "c", "b", "a "])] + [(10, body), (11, "y" + body), (12, "x" * 5001 + "é"), (13, "x" * 5001 + "è")] + [(20 + i, "same") for i in range(300)]
    got = Counter(tuple(r)[:5] for r in exact_groups(spark.createDataFrame(rows, "doc_id long, text string"), first=4, factor=3).collect())
    assert got == brute_exact(rows)


# Near dedup

def _near(df, n, percent):
    return Counter(tuple(r) for r in near_groups(df, n, percent).collect())


def test_near_odd(odd):
    assert _near(odd, 3, 85) == brute_near([(r.doc_id, r.text) for r in odd.collect()], 3, 85)
    assert near_groups(odd.limit(0)).count() == 0


def test_near_chains_and_crowds(spark):
    rng = random.Random(5)
    base = [f"w{rng.randrange(900)}" for _ in range(150)]
    rows = []
    for i in range(120):  # a crowd around one text, most of them too far from each other to be linked directly
        w = list(base)
        for k in rng.sample(range(150), rng.randrange(1, 8)):
            w[k] = f"v{rng.randrange(10_000)}"
        rows.append((i, " ".join(w)))
    chain = [f"c{k}" for k in range(100)]
    for i in range(30):  # each is a small step from the last
        chain[3 * i] = f"d{i}"
        rows.append((500 + i, " ".join(chain)))
    rows += [(900 + i, " ".join(f"u{rng.randrange(5000)}" for _ in range(60))) for i in range(50)] + [(1000 + i, rows[0][1].upper()) for i in range(20)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert _near(df, 3, 85) == brute_near(rows, 3, 85)
    assert Counter(tuple(r) for r in near_groups(df, 3, 85, block=8).collect()) == brute_near(rows, 3, 85)


def test_estimates_follow_similarity():
    rng = np.random.default_rng(1)
    words = rng.integers(0, 2**63, 4000).astype(np.uint64)
    for both, n in ((1000, 1000), (900, 1000), (500, 1000), (0, 1000)):
        a, b = np.sort(words[:n]), np.sort(words[n - both : 2 * n - both])
        got = estimate(registers(a)[None, :], registers(b)[None, :], np.asarray([n]))[0]
        assert abs(got - both / (2 * n - both)) < 0.17
    assert 0 < collisions(np.asarray([1e6]))[0] < 0.002
    assert len(shingle_set(WordHashes().of("a b"), 3)) == 1 and len(shingle_set(WordHashes().of(""), 3)) == 0


# Pipeline

def test_pipeline(spark, tmp_path):
    import corpus_pipeline as P

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    extra = spark.createDataFrame([(10_001, "12 34", None, "src1", 5), (10_002, None, None, None, 0), (10_003, docs.first().text + " ", "en", "src1", 9)], docs.schema)
    docs = docs.unionByName(extra)
    seen = [docs.toPandas()]
    df = docs
    for name, stage in P.STAGES:
        out = stage(spark, df, SF)
        out.write.parquet(str(tmp_path / name))
        df = spark.read.parquet(str(tmp_path / name))
        seen.append(df.toPandas())
        if name != "pack_sequences":
            assert df.columns == P.COLUMNS
    start, known, exact, near, mixed, packed = seen
    assert set(start.doc_id) - set(known.doc_id) == {10_001, 10_002}
    want = {k for (_, k, _, kept, _) in brute_exact(list(zip(known.doc_id, known.text))) if kept}
    assert set(exact.doc_id) == want and len(exact) == len(want)
    want = {i for (i, _, _, kept) in brute_near(list(zip(exact.doc_id, exact.text)), 5, 80) if kept}
    assert set(near.doc_id) == want and len(near) == len(want)
    assert mixed.groupby("doc_id").size().max() <= 2 and set(mixed.doc_id) <= set(near.doc_id)
    assert set(mixed.merge(near, on="doc_id", suffixes=("", "_n")).pipe(lambda x: x.text == x.text_n)) == {True}
    assert packed.groupby("sequence_id").length.sum().max() <= 2048
    assert Counter(packed[packed.piece == 0].doc_id) == Counter(mixed.doc_id)


def test_pipeline_rows_stay_apart(spark, tmp_path):
    """Null ids, repeated rows, null columns, clashing and extra columns, and scans that are split anew between two reads."""
    import corpus_pipeline as P

    text = "one two three four five six seven"
    rows = [(1, text, "en", "a", 1), (1, text, "en", "a", 1), (None, text + " eight nine ten", "en", None, 2), (None, "so other words stand here instead of them", "en", "a", None), (3, "eins zwei drei vier fünf sechs", None, None, None)]
    rows += [(10 + i, " ".join(f"w{i}x{k}" for k in range(30)), "en", "b", 3) for i in range(200)] + [(5, None, "en", "a", 0), (6, "12", "en", "a", 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars int").withColumns({"_row": F.lit(7), "_id": F.lit("x"), "size": F.lit(1)})
    docs.repartition(6).write.parquet(str(tmp_path / "in"))
    seen = {}
    for size in ("128m", "2k"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        df = spark.read.parquet(str(tmp_path / "in"))
        for name, stage in P.STAGES[:4]:
            made = stage(spark, df, "")
            spark.conf.set("spark.sql.files.maxPartitionBytes", "1k" if size == "2k" else "128m")
            made.write.parquet(str(tmp_path / f"{name}{size}"))
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            df = spark.read.parquet(str(tmp_path / f"{name}{size}"))
            assert df.columns == P.COLUMNS
            seen[name, size] = Counter((r.doc_id, r.text) for r in df.collect())
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    for name in ("language_id", "exact_dedup", "near_dedup"):
        assert seen[name, "128m"] == seen[name, "2k"]
    assert seen["language_id", "2k"][1, text] == 2 and seen["exact_dedup", "2k"][1, text] == 1 and len(seen["exact_dedup", "2k"]) == 204
    assert set(seen["mix_sources", "2k"]) <= set(seen["near_dedup", "2k"])
    empty = docs.limit(0)
    for _, stage in P.STAGES:
        empty = stage(spark, empty, "")
        assert empty.count() == 0
