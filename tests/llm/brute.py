"""Plain Python versions of the operators' results, for small tables."""
from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np

SPACED = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def words(text):
    return SPACED.findall((text or "").translate(LOWER))


class Groups:
    """Union-find with the smallest member as the root."""

    def __init__(self, ids):
        self.up = {i: i for i in ids}

    def root(self, x):
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def link(self, a, b):
        a, b = sorted((self.root(a), self.root(b)))
        self.up[b] = a


def jump(key: int, shards: int) -> int:
    key, b, j = key % (1 << 64), -1, 0
    while j < shards:
        b = j
        key = (key * 2862933555777941757 + 1) % (1 << 64)
        j = math.floor((b + 1) * (2147483648.0 / ((key >> 33) + 1)))
    return b


def license_places(text, phrases):
    found = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))
    return len(found), sorted((i, label) for label, p in phrases for i in range(len(found))
                              if found[i:i + len(p.split())] == p.split())


def katz(texts: dict, held: dict, discounts, top: int = 5) -> dict:
    """{id: (tokens, known, base, score)}"""
    toks = {i: [*words(t), ("end",)] for i, t in texts.items()}
    one, two, ctx = Counter(), Counter(), Counter()
    for i, ws in toks.items():
        if not held[i]:
            v = ("start",)
            for w in ws:
                one[w] += 1
                two[v, w] += 1
                ctx[v] += 1
                v = w
    n, size = sum(one.values()), len(one)
    d1, d2 = discounts(Counter(one.values())), discounts(Counter(two.values()))

    def cut(d, c):
        return c * (d[c - 1] if c <= top else 1.0)

    left = sum(c - cut(d1, c) for c in one.values()) / n if n else 1.0
    if n and not left:
        d1, total, left = [1.0] * top, n + 1, 1 / (n + 1)
    else:
        total = max(n, 1)
    p = {w: cut(d1, c) / total for w, c in one.items()}
    mass, seen = Counter(), Counter()
    for (v, w), c in two.items():
        mass[v] += cut(d2, c)
        seen[v] += p[w]
    base = {v: ctx[v] if ctx[v] - mass[v] > 1e-9 * ctx[v] else ctx[v] + 1 for v in ctx}
    back = {v: (1 - mass[v] / base[v]) / (1 - seen[v]) for v in mass}

    def prob(v, w):
        return cut(d2, two[v, w]) / base[v] if two[v, w] else back.get(v, 1.0) * p.get(w, left)

    out = {}
    for i, ws in toks.items():
        plain = sum(math.log10((one[w] + 0.1) / (n + 0.1 * (size + 1))) for w in ws)
        score = sum(math.log10(prob(v, w)) for v, w in zip([("start",), *ws], ws))
        out[i] = (len(ws), sum(w in one for w in ws), plain, score)
    sums = [sum(prob(v, w) for w in p) + back.get(v, 1.0) * left for v in list(ctx)[:5]]
    return {"n": n, "rows": out, "sums": sums}


def cosine_groups(rows, threshold=0.98):
    """rows (id, vector, label) -> {id: (links, component)}"""
    good = {}
    for i, v, label in rows:
        if label is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v):
            x = np.array(v, np.float64)
            good[i] = (label, len(v), x / np.abs(x).max() / np.linalg.norm(x / np.abs(x).max()))
    groups, links = Groups([r[0] for r in rows]), Counter()
    ids = list(good)
    for k, a in enumerate(ids):
        for b in ids[k + 1:]:
            if good[a][:2] == good[b][:2] and good[a][2] @ good[b][2] >= threshold:
                links[a] += 1
                links[b] += 1
                groups.link(a, b)
    return {r[0]: (links[r[0]], groups.root(r[0])) for r in rows}


def repeated_bytes(texts: list[bytes], length=400):
    """For each text: (removed, spans, sha-256 of the rest)."""
    times = Counter(t[i:i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for t in texts:
        gone = np.zeros(len(t) + 1, np.int64)
        for i in range(len(t) - length + 1):
            if times[t[i:i + length]] > 1:
                gone[i] += 1
                gone[i + length] -= 1
        hit = np.cumsum(gone)[:-1] > 0
        spans = int((np.diff(np.concatenate([[0], hit.astype(int)])) == 1).sum())
        rest = bytes(np.frombuffer(t, np.uint8)[~hit])
        out.append((int(hit.sum()), spans, hashlib.sha256(rest).hexdigest()))
    return out


def shingle_groups(texts: dict, percent=75, size=5):
    """{id: (set size, component)}"""
    sets = {}
    for i, t in texts.items():
        ws = words(t)
        sets[i] = frozenset(tuple(ws[k:k + size]) for k in range(max(1, len(ws) - size + 1))) if ws else frozenset()
    at, groups = {}, Groups(sets)
    for i, s in sets.items():
        for g in s:
            at.setdefault(g, []).append(i)
    for i, s in sets.items():
        both = Counter(j for g in s for j in at[g] if j < i)
        for j, k in both.items():
            if 100 * k >= percent * (len(s) + len(sets[j]) - k):
                groups.link(i, j)
    return {i: (len(s), groups.root(i)) for i, s in sets.items()}


def fold(i, n):
    return zlib.crc32(str(i).encode()) % n


def repeated_words(doc_id, text):
    """The words of a text after the periodic rewriting of the run query."""
    ws = SPACED.findall(text or "")
    h, n = zlib.crc32(str(doc_id).encode()), len(ws)
    g = h // 10
    if doc_id is not None and h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        ws = [w if i < a else ws[a + (i - a) % p] for i, w in enumerate(ws)]
    return ws


def word_runs(ws, min_length=6, min_powers=4):
    """All (start, length, period) with the smallest period, by start and period."""
    found, n = {}, len(ws)
    for q in range(1, n // min_powers + 1):
        i = 0
        while i + q < n:
            if ws[i] != ws[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and ws[j] == ws[j + q]:
                j += 1
            length = j + q - i
            if length >= max(min_length, min_powers * q) and not any(
                    r[0] <= i and r[0] + r[1] >= i + length and q % r[2] == 0 for r in found):
                found[i, length, q] = True
            i = j
    return sorted(found)


def run_digest(doc_id, text):
    ws = repeated_words(doc_id, text)
    runs, gone = word_runs(ws), set()
    for s, n, q in runs:
        gone.update(range(s + q, s + n))
    best = None
    for r in runs:
        if best is None or r[1] * best[2] > best[1] * r[2]:
            best = r
    lines = "".join(f"{s},{n},{q}\n" for s, n, q in runs)
    kept = " ".join(w for i, w in enumerate(ws) if i not in gone)
    return (len(runs), *(best or (None, None, None)), best and 1000 * best[1] // best[2],
            hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(kept.encode()).hexdigest())


def hard_negatives(rows, positives=5, negatives=10, window=(30, 90)):
    """rows (id, vector, label) as the table holds them -> set of result rows."""
    base = set()
    for i, v, label in rows:
        if i is None or v is None or label is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        scaled = tuple(math.floor(256 * x) for x in v)
        if all(abs(x) < 1 << 24 for x in scaled):
            base.add((i, (label + 1) % 10 if i % 7 == 0 else label, scaled))
    out = []
    for i, label, v in base:
        if i % 100:
            continue
        others = [(-sum(a * b for a, b in zip(v, w)), j, k) for j, k, w in base if j != i and len(w) == len(v)]
        for minus, j, _ in sorted(x for x in others if x[2] == label)[:positives]:
            p = -minus
            fit = sorted((m, k) for m, k, of in others if of != label and window[0] * p <= -100 * m <= window[1] * p)
            out += [(i, j, r, k, p, -m) for r, (m, k) in enumerate(fit[:negatives], 1)]
    return out
