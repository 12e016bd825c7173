"""Plain versions of what pipeline stages do, for tests."""

import hashlib
import re
from collections import defaultdict

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute_components(rows, percent, k):
    sets = {}
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", t.translate(LOWER))
        sets[i] = {tuple(w[j : j + k]) for j in range(max(1, len(w) - k + 1))} if w else set()
    up = {i: i for i, _ in rows}

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in up:
        for j in up:
            if j < i and sets[i] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                a, b = top(i), top(j)
                up[max(a, b)] = min(a, b)
    return {i: top(i) for i in up}


def brute_hits(texts, items, k):
    words = lambda t: re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", t.translate(LOWER))
    windows = {tuple(w[i : i + k]) for _, t in items if (w := words(t)) for i in range(max(1, len(w) - k + 1))}
    out = []
    for t in texts:
        w = words(t)
        out.append(any(tuple(w[i : i + n]) in windows for n in {len(x) for x in windows} for i in range(len(w) - n + 1)))
    return out


def _style(t):
    return "table" if " | " in t else "notice" if "!! " in t else "licensed" if "license" in t.lower() else "short" if len(t) < 600 else "prose"


def brute_mix(rows, powers=(0.5, 0.7, 0.5), keep=0.5, steps=200):
    cell = lambda x: (x[3], x[2], _style(x[1]))
    size = defaultdict(int)
    for x in rows:
        size[cell(x)] += len(re.findall(r"[^\x20\x09-\x0D]+", x[1]))
    total, w, goals = sum(size.values()), {c: float(n) for c, n in size.items()}, []
    for d, p in enumerate(powers):
        by = defaultdict(float)
        for c, n in size.items():
            by[c[d]] += n
        s = sum(n**p for n in by.values())
        goals.append({v: total * n**p / s for v, n in by.items()})
    for _ in range(steps):
        for d in range(3):
            now = defaultdict(float)
            for c, x in w.items():
                now[c[d]] += x
            w = {c: x * goals[d][c[d]] / now[c[d]] for c, x in w.items()}
    low, high = 0.0, 1e6
    for _ in range(200):
        s = (low + high) / 2
        low, high = (s, high) if sum(min(size[c], s * w[c]) for c in w) < keep * total else (low, s)
    draw = lambda i: int(hashlib.md5(f"mix:{i}".encode()).hexdigest()[:13], 16) / 16**13
    return [x for x in rows if draw(x[0]) < min(1.0, low * w[cell(x)] / size[cell(x)])]
