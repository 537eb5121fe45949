"""Plain versions of the operators, for small inputs."""

import hashlib
import re
from collections import Counter
from itertools import combinations

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def repeated_words(docs, width=50):
    words = {d: WORD.findall(t or "") for d, t in docs}
    first = {}
    for d in sorted(words):
        for i in range(len(words[d]) - width + 1):
            first.setdefault(tuple(words[d][i : i + width]), d)
    out = {}
    for d, ws in words.items():
        gone = set()
        for i in range(len(ws) - width + 1):
            if first[tuple(ws[i : i + width])] < d:
                gone |= set(range(i, i + width))
        kept = " ".join(w for i, w in enumerate(ws) if i not in gone)
        out[d] = (len(ws), len(gone), hashlib.sha256(kept.encode()).hexdigest())
    return out


def repeated_bytes(docs, width=50):
    texts, first = {d: (t or "").encode() for d, t in docs}, {}
    for d in sorted(texts):
        for i in range(len(texts[d]) - width + 1):
            first.setdefault(texts[d][i : i + width], d)
    out = {}
    for d, x in texts.items():
        gone = bytearray(len(x))
        for i in range(len(x) - width + 1):
            if first[x[i : i + width]] < d:
                gone[i : i + width] = b"\1" * width
        kept = bytes(c for c, g in zip(x, gone, strict=True) if not g)
        out[d] = (len(x), sum(gone), len(re.findall(rb"\x01+", bytes(gone))), hashlib.sha256(kept).hexdigest())
    return out


def near_classes(docs, n=5, least=0.8):
    sets = {}
    for d, t in docs:
        w = WORD.findall(t or "")
        sets[d] = {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set()
    parent = {d: d for d in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    holders, shared = {}, Counter()
    for d, s in sets.items():
        for g in s:
            holders.setdefault(g, []).append(d)
    for ds in holders.values():
        shared.update(combinations(sorted(ds), 2))
    for (a, b), k in shared.items():
        if k / (len(sets[a]) + len(sets[b]) - k) >= least:
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    return {d: find(d) for d in sets}
