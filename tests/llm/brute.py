"""Plain versions of what the operators compute, row by row."""

import hashlib
import math
import re
from collections import Counter, defaultdict

import numpy as np


def water(sizes, weights, share, most):
    names = sorted((n for n in sizes if n is not None), key=lambda n: n.encode()) + [None] * (None in sizes)
    w = {n: weights[i % len(weights)] for i, n in enumerate(names)}
    left, target, open_ = share * sum(sizes.values()), dict.fromkeys(names, 0.0), set(names)
    while left > 1e-9 and open_:
        total = sum(w[n] for n in open_)
        give = {n: left * w[n] / total for n in open_}
        left = 0.0
        for n in list(open_):
            target[n] += give[n]
            if target[n] >= most * sizes[n]:
                left += target[n] - most * sizes[n]
                target[n] = most * sizes[n]
                open_.discard(n)
    return target


def brute_top(rows, k=10):
    vs = [(i, np.floor(1024 * np.asarray(v, np.float64))) for i, v in rows if i is not None and v is not None and None not in v and np.isfinite(v).all()]
    out = []
    for a, (i, x) in enumerate(vs):
        if i % 100 == 0:
            s = sorted((-int(sum(p * q for p, q in zip(x.tolist(), y.tolist()))), j) for b, (j, y) in enumerate(vs) if a != b)[:k]
            out += [(i, n + 1, j, -v) for n, (v, j) in enumerate(s)]
    return sorted(out)


def brute_templates(paths, least=20, spread=0.5, distance=0.25, gap=0.15, weight=10.0, prior=0.5):
    """The definition of templates, row by row: paths {(host, path): (n, labelled, bad)} -> {(host, path): (template, share, labels)}."""
    wild = lambda x: re.search(r"[0-9]|^.{40,}$", x)
    ext = lambda x: "*" + (m[0] if (m := re.search(r"\.[A-Za-z]{1,5}$", x)) else "")
    rows = {k: [x for x in k[1].split("/") if x] for k in paths}
    depth = max([len(x) for x in rows.values()] + [1])
    for i in range(depth):
        seen = defaultdict(Counter)
        for (h, p), x in rows.items():
            if len(x) > i and not wild(x[i]):
                seen[h, tuple(x[:i])][x[i]] += paths[h, p][0]
        many = {k for k, c in seen.items() if len(c) >= least and len(c) > spread * sum(c.values())}
        rows = {k: [ext(y) if j == i and (wild(y) or (k[0], tuple(x[:i])) in many) else y for j, y in enumerate(x)] for k, x in rows.items()}
    for i in reversed(range(depth)):
        cells = defaultdict(lambda: defaultdict(lambda: defaultdict(lambda: np.zeros(3))))
        for k, x in rows.items():
            if len(x) > i and not x[i].startswith("*"):
                cells[k[0], tuple(x[:i])][x[i]][tuple(x[i + 1 :])] += paths[k]
        merged, general = set(), defaultdict(lambda: np.zeros(3))
        for (_, prefix), branches in cells.items():
            for b, own in branches.items():
                general[prefix, b] += sum(own.values())
        for at, branches in cells.items():
            pool = defaultdict(lambda: np.zeros(3))
            for own in branches.values():
                for r, v in own.items():
                    pool[r] = pool[r] + v
            whole = sum(pool.values())
            wide = sum(general[at[1], b] for b in branches)
            smooth = lambda v, g: (v[2] + weight * (g[2] + weight * prior) / (g[1] + weight)) / (v[1] + weight)
            for b, own in branches.items():
                all_ = sum(own.values())
                tv = sum(abs((own[r][0] if r in own else 0) / all_[0] - pool[r][0] / whole[0]) for r in pool) / 2
                if len(branches) > 1 and tv <= distance + (len(own) / all_[0]) ** 0.5 / 2 and abs(smooth(all_, general[at[1], b]) - smooth(whole, wide)) <= gap:
                    merged.add((at, b))
        rows = {k: [*x[:i], "+", *x[i + 1 :]] if len(x) > i and ((k[0], tuple(x[:i])), x[i]) in merged else x for k, x in rows.items()}
    here, all_ = defaultdict(lambda: np.zeros(2)), defaultdict(lambda: np.zeros(2))
    for k, x in rows.items():
        here[k[0], tuple(x)] += paths[k][1:]
        all_[tuple(x)] += paths[k][1:]
    out = {}
    for k, x in rows.items():
        (l, b), (la, ba) = here[k[0], tuple(x)], all_[tuple(x)]
        out[k] = ("/" + "/".join(x), (b + weight * (ba + weight * prior) / (la + weight)) / (l + weight), la)
    return out


def brute_exact(rows):
    groups = defaultdict(list)
    for k, (i, t) in enumerate(rows):
        groups[re.sub(r"[\x20\x09-\x0D]", "", t or "")].append((-len(t or ""), i is None, i or 0, k))
    out = []
    for z, own in groups.items():
        best = min(own)
        keep = rows[best[3]][0]
        out += [(rows[k][0], keep, len(own), k == best[3], hashlib.sha256(z.encode()).hexdigest()) for *_, k in own]
    return Counter((i, keep, n, kept, h) for i, keep, n, kept, h in out)


def brute_near(rows, n, percent):
    sets = []
    for i, t in rows:
        w = (t or "").encode().lower().split()
        sets.append(frozenset(tuple(w[k : k + n]) for k in range(len(w) - n + 1)) if len(w) >= n else frozenset([tuple(w)] if w else []))
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * len(sets[a] | sets[b]):
                root[find(a)] = find(b)
    low = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            low[find(k)] = min(low.get(find(k), i), i)
    return Counter((i, len(sets[k]), c := low.get(find(k)), i == c) for k, (i, _) in enumerate(rows))


def brute_bayes(labelled, texts, bits=15, smoothing=0.5):
    """Multinomial naive Bayes n-gram by n-gram, in plain Python but for the hash."""
    from refaudit.llm.langid import hashed

    def grams(text):
        t = "".join(c if ord(c) > 127 or "a" <= c <= "z" else " " for c in f" {text.lower()} ")
        while "  " in t:
            t = t.replace("  ", " ")
        return [(n, int(hashed(np.asarray([ord(c) for c in t[i : i + n]], np.uint32), n, bits)[0])) for n in (1, 2, 3) for i in range(len(t) - n + 1)]

    counts, rows = {}, Counter()
    for text, lang in labelled:
        counts.setdefault(lang, Counter()).update(b for _, b in grams(text))
        rows[lang] += 1
    out = []
    for text in texts:
        logs = {}
        for lang, c in counts.items():
            total = sum(c.values()) + smoothing * 2**bits
            logs[lang] = math.log(rows[lang] / sum(rows.values())) + sum(math.log((c[b] + smoothing) / total) for _, b in grams(text))
        top = max(sorted(logs), key=logs.get)
        out.append((top, 1 / sum(math.exp(x - logs[top]) for x in logs.values())))
    return out
