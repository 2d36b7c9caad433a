"""Plain Python versions of the operators, over lists of rows."""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import xxhash

from ctxspark.llm import spotsigs


def rows(sf: str, table: str, *columns: str) -> list[tuple]:
    import duckdb

    return duckdb.sql(f"SELECT {', '.join(columns)} FROM read_parquet('{sf}/{table}.parquet')").fetchall()


def leaks(docs, items, window=16, least=8, similarity=0.8):
    """Every (doc_id, item_id) with enough equal tokens in a window on some diagonal: all diagonals are tried."""
    toks = lambda t: re.findall(r"[^\W_]+", t.lower())
    out = set()
    items = [(i, toks(t)) for i, t in items if t is not None]
    for d, t in docs:
        w = toks(t or "")
        where = defaultdict(list)
        for p, x in enumerate(w):
            where[x].append(p)
        for i, v in items:
            if len(v) < least:  # whole and unchanged
                if v and any(w[p : p + len(v)] == v for p in range(len(w) - len(v) + 1)):
                    out.add((d, i))
                continue
            n, on = min(window, len(v)), defaultdict(set)
            for j, x in enumerate(v):
                for p in where.get(x, ()):
                    on[p - j].add(j)
            for same in on.values():
                if len(same) >= similarity * n and max(sum(s + k in same for k in range(n)) for s in range(len(v) - n + 1)) >= similarity * n:
                    out.add((d, i))
                    break
    return out


def simhash(text: str, k: int = 3) -> int:
    w = re.findall(rb"[^\x20\x09-\x0D]+", text.encode().lower())
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(b" ".join(w[i : i + k]), 42) for i in range(max(1, len(w) - k + 1))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def components(nodes, links):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def simhash_components(docs):
    prints = [simhash(t or "") for _, t in docs]
    f = np.array(prints, np.uint64)
    links = []
    for i in range(len(f)):
        x = f ^ f[i]
        n = np.zeros(len(f), np.int64)
        for b in range(64):
            n += ((x >> np.uint64(b)) & np.uint64(1)).astype(np.int64)
        links += [(i, int(j)) for j in np.flatnonzero(n <= 2) if j > i]
    root = components(range(len(f)), links)
    low = {}
    for i, (d, _) in enumerate(docs):
        low[root[i]] = min(low.get(root[i], d), d)
    return {d: (f"{prints[i]:016x}", low[root[i]]) for i, (d, _) in enumerate(docs)}


def shingles(text: str, k: int = 5) -> frozenset:
    w = text.encode().lower().split()
    return frozenset(b" ".join(w[i : i + k]) for i in range(max(1, len(w) - k + 1))) if w else frozenset()


def near_components(texts, k=5, similarity=0.8):
    """Components of texts by all pairs whose shingle sets are alike."""
    sets = [shingles(t, k) for t in texts]
    holds = defaultdict(list)
    for i, s in enumerate(sets):
        for x in s:
            holds[x].append(i)
    both = Counter()
    for h in holds.values():
        for a in range(len(h)):
            for b in range(a + 1, len(h)):
                both[h[a], h[b]] += 1
    links = [(a, b) for (a, b), n in both.items() if n >= similarity * (len(sets[a]) + len(sets[b]) - n)]
    return components(range(len(texts)), links)


def spot_set(text: str) -> set:
    w = re.findall(r"[^\W_]+", text.lower())
    at = [i for i, x in enumerate(w) if x not in spotsigs.ANCHORS]
    if not at:
        return {tuple(w)} if w else {text} if text else set()
    return {tuple(w[p] for p in at[j : j + spotsigs.CHAIN]) for j, i in enumerate(at) if j == 0 or i - at[j - 1] > 1}


def likeness(a: set, b: set) -> float:
    return 1.0 if not a and not b else len(a & b) / len(a | b)


def edited(docs):
    """(doc_id, text, edited text, next text) in the order of doc_id."""
    docs = sorted(docs)
    out = []
    for k, (d, t) in enumerate(docs):
        nxt = docs[(k + 1) % len(docs)][1]
        m = len(t) // 4
        out.append((d, t, t[: len(t) - m] + nxt[:m], nxt))
    return out


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def crc(text: str) -> int:
    return zlib.crc32(text.encode())


def kneser_ney(train, classes, order):
    """A function from a text to nats per character in each class; train: (text, class). Probabilities by the definition."""
    words = lambda t: re.findall(r"[^\W\d_]+", t.lower())
    counts = [Counter() for _ in range(classes)]
    for t, c in train:
        for w in words(t):
            s = f"^{w}$"
            counts[c].update(s[max(0, o + 1 - order) : o + 1] for o in range(1, len(s)))
    types = {order: [Counter({g: n for g, n in x.items() if len(g) == order}) for x in counts]}
    for k in range(order - 1, 0, -1):
        types[k] = [Counter({g: n for g, n in x.items() if len(g) == k}) for x in counts]
        for c in range(classes):
            for g in types[k + 1][c]:
                types[k][c][g[1:]] += 1
    alphabet = len({g for x in types[1] for g in x}) + 1
    discount = {}
    for k, each in types.items():
        for c, x in enumerate(each):
            one, two = sum(n == 1 for n in x.values()), sum(n == 2 for n in x.values())
            discount[k, c] = min(0.95, max(0.1, one / max(one + 2 * two, 1)))

    def p(g, c):
        k = len(g)
        if not k:
            return 1 / alphabet
        follow = {h: n for h, n in types[k][c].items() if h[:-1] == g[:-1]}
        total, d = sum(follow.values()), discount[k, c]
        if not total:
            return p(g[1:], c)
        return max(follow.get(g, 0) - d, 0) / total + sum(min(n, d) for n in follow.values()) / total * p(g[1:], c)

    def nats(text):
        out, size = [0.0] * classes, 0
        for w in words(text):
            s = f"^{w}$"
            size += len(s) - 1
            for o in range(1, len(s)):
                for c in range(classes):
                    out[c] -= math.log(p(s[max(0, o + 1 - order) : o + 1], c))
        return [x / max(size, 1) for x in out]

    return nats


def toxic_models(train, sure=3.0):
    """A function from a text to its evidence; train: different (text, class). Both models are built whole and sum to one."""
    words = lambda t: re.findall(r"[^\W\d_]+", t.lower())
    n, m, f = ([Counter(), Counter()] for _ in range(3))
    for t, c in train:
        w = words(t)
        n[c].update(set(w))
        m[c].update(set(zip(w, w[1:])))
    for c in (0, 1):
        for (v, _), k in m[c].items():
            f[c][v] += k
    kept = lambda x, e: x - min(x, e + sure * math.sqrt(e) + sure)
    total = [sum(n[c].values()) for c in (0, 1)]
    every = set(n[0]) | set(n[1])
    own = [{w: kept(n[c][w], (n[0][w] + n[1][w]) * total[c] / sum(total)) for w in every} for c in (0, 1)]
    taken = [sum(n[c][w] - own[c][w] for w in every) for c in (0, 1)]
    gamma = [taken[c] / total[c] for c in (0, 1)]
    p1 = [{w: own[c][w] / total[c] + gamma[c] * sum(n[k][w] - own[k][w] for k in (0, 1)) / sum(taken) for w in every} for c in (0, 1)]
    assert all(abs(sum(p.values()) - 1) < 1e-9 for p in p1)
    pair = [{}, {}]
    for c in (0, 1):
        for v, w in set(m[0]) | set(m[1]):
            says = [p1[k][w] * total[k] for k in (0, 1)]
            x = kept(m[c][v, w], (m[0][v, w] + m[1][v, w]) * says[c] / sum(says))
            if x > 0:
                pair[c].setdefault(v, {})[w] = x

    def p2(v, w, c):
        if not f[c][v]:
            return p1[c][w]
        mine = pair[c].get(v, {})
        return mine.get(w, 0) / f[c][v] + (1 - sum(mine.values()) / f[c][v]) * p1[c][w]

    def evidence(text):
        w, out, base = words(text), 0.0, math.log(gamma[1] / gamma[0])
        for i, x in enumerate(w):
            if x not in every:  # only the shared model could say it
                if i:
                    g = [1 - sum(pair[c].get(w[i - 1], {}).values()) / f[c][w[i - 1]] if f[c][w[i - 1]] else 1.0 for c in (0, 1)]
                    out += math.log(g[1] / g[0])
            elif i:
                out += math.log(p2(w[i - 1], x, 1) / p2(w[i - 1], x, 0)) - base
            else:
                out += math.log(p1[1][x] / p1[0][x]) - base
        return out

    return evidence
