"""Recall in plain Python over memory rows: pools, fusion, scores, budgets. Only ``derived`` fields come with the rows."""

import math
import unicodedata
from collections import Counter
from datetime import datetime

import numpy as np
import regex

from cairn.functions import values as C

AS_OF = datetime(2026, 1, 1)


def tokens(text):
    return [t for t in regex.split(r"[^\p{Alphabetic}\p{N}]+", text.lower()) if t]


def terms(text):
    return [t for t in tokens(text) if len(t.encode()) > 1]


def words(text):
    return [w for w in regex.split(r"\s+", text) if w]


def cost(text):
    return max(len(text) // 4, len(words(text)))


def fold(text):
    out = ""
    for c in text:
        parts = unicodedata.normalize("NFD", c)
        wide = 0xC0 <= ord(c) < 0x250 or 0x1E00 <= ord(c) < 0x1F00
        out += parts[0] if wide and len(parts) > 1 and parts[0].isascii() and all(unicodedata.combining(m) for m in parts[1:]) else c
    return out


def fnv(data):
    h = C.FNV_OFFSET
    for x in data:
        h = ((h ^ x) * C.FNV_PRIME) & ((1 << 64) - 1)
    return h


def embedding(text):
    out, t = np.zeros(C.DIM), tokens(text)
    for f in t + [f"{a}_{b}" for a, b in zip(t, t[1:], strict=False)]:
        h = fnv(f.encode())
        out[h % C.DIM] += 1 if h >> 63 else -1
    n = np.linalg.norm(out)
    return (out / n if n > 0 else out).astype(np.float32)


def unit(v):
    v = np.asarray(v, float)
    n = np.linalg.norm(v)
    return v / n if n > 0 else v


class Memories:
    """Rows with what every query needs of them."""

    def __init__(self, rows):
        self.rows = {r["id"]: r for r in rows}
        self.vectors = {i: unit(r["embedding"]) for i, r in self.rows.items()}
        self.docs = {i: tokens(fold(" ".join([r["content"] or "", r["summary"] or "", " ".join(r["tags"]), " ".join(r["entities"])]))) for i, r in self.rows.items()}
        self.mean = sum(map(len, self.docs.values())) / len(self.docs)

    def near(self, query, k):
        q = unit(embedding(query))
        return sorted(((-round(float(q @ v), 12), i) for i, v in self.vectors.items()))[:k]

    def keyword(self, query, k):
        scores = Counter()
        for phrase, times in Counter(tuple(tokens(fold(w))) for w in words(query)).items():
            if not phrase:
                continue
            m = len(phrase)
            tf = {i: n for i, d in self.docs.items() if (n := sum(tuple(d[j : j + m]) == phrase for j in range(len(d) - m + 1) if d[j] == phrase[0]))}
            idf = max(math.log((len(self.docs) - len(tf) + 0.5) / (len(tf) + 0.5)), 1e-6)
            for i, n in tf.items():
                scores[i] += times * idf * n * (C.K1 + 1) / (n + C.K1 * (1 - C.B + C.B * len(self.docs[i]) / self.mean))
        return sorted((-round(s, 9), i) for i, s in scores.items())[:k]


def stars(r):
    return "★" * min(max(math.floor(r["confidence"] * 5 + 0.5), 1), 5)


def render(r, level):
    date = r["_date"]
    topic = regex.sub(r"^\s+|\s+$", "", r["headline"].split(":")[0])
    if level == "headline":
        return f"[{stars(r)}] {r['headline']} @{r['author']} | {date}"
    tags = " #" + " #".join(r["tags"]) if r["tags"] else ""
    return f"[{stars(r)}] {topic}: {r['summary']} @{r['author']}{tags} | {date}"


def ranked(memories, query, limit=5):
    pool = max(limit * 4, 10)
    base = Counter()
    for found in (memories.near(query, pool), memories.keyword(query, pool)):
        for n, (_, i) in enumerate(found, 1):
            base[i] += 1 / (60 + n)
    scored = {}
    for i, b in base.items():
        r = memories.rows[i]
        days = max((AS_OF - r["created_at"]).days, 0)
        scored[i] = b * (1 + C.RECENCY_WEIGHT / (1 + days / C.RECENCY_DAYS) + C.IMPORTANCE_WEIGHT * r["importance"] + C.CONFIDENCE_WEIGHT * r["confidence"]) + C.ACCESS_WEIGHT * math.log(1 + r["access_count"])
    q = terms(query)
    if q and len(scored) > 1:
        docs = {i: terms(" ".join([memories.rows[i]["content"] or "", memories.rows[i]["headline"] or "", " ".join(memories.rows[i]["tags"])])) for i in scored}
        mean, lex = max(sum(map(len, docs.values())) / len(docs), 1.0), Counter()
        counts = {i: Counter(d) for i, d in docs.items()}
        for t in q:
            df = sum(t in c for c in counts.values())
            for i, c in counts.items():
                if c[t]:
                    lex[i] += math.log((len(docs) - df + 0.5) / (df + 0.5) + 1) * c[t] * (C.K1 + 1) / (c[t] + C.K1 * (1 - C.B + C.B * len(docs[i]) / mean))
        top, most = max(max(lex.values(), default=0), 1e-6), max(max(scored.values()), 1e-6)
        scored = {i: 0.5 * lex[i] / top + 0.5 * s / most for i, s in scored.items()}
    return sorted((-round(s, 12), i, s) for i, s in scored.items())[:limit]


def static(memories, query, budget=200, limit=5):
    used, out = 0, []
    for rank, (_, i, score) in enumerate(ranked(memories, query, limit), 1):
        r = memories.rows[i]
        if budget - used < C.LEAST_BUDGET:
            break
        line = render(r, "summary" if rank <= C.TOP_SUMMARIES else "headline")
        over = used + cost(line) > budget
        if over:
            line = render(r, "headline")
            if used + cost(line) > budget:
                break
        used += cost(line)
        out.append((rank, i, round(score, 9), line, cost(line), used))
        if over:
            break
    return out


def sentences(text):
    return [s for s in (regex.sub(r"^\s+|\s+$", "", p) for p in regex.split(r"(?<=[.!?\n])", text)) if s]


def dynamic(memories, query, budget=300, limit=5):
    q, used, out = terms(query), 0, []
    found = ranked(memories, query, limit)
    for n, (_, i, score) in enumerate(found):
        r, left = memories.rows[i], budget - used
        if left < C.LEAST_BUDGET:
            break
        most = min(max(left // max(len(found) - n, 1), C.LEAST_SHARE), left)
        text, parts = r["content"], sentences(r["content"])
        if cost(text) > most and len(parts) > 1:
            kept, total = [], 0
            for _, place, s in sorted((-((sum(w in q for w in t) / len(t) if (t := terms(s)) else 0.0) + C.LEAD_BIAS / (1 + j)), j, s) for j, s in enumerate(parts)):
                if total < most and total + cost(s) <= most:
                    kept.append((place, s))
                    total += cost(s)
            text = " ".join(s for _, s in sorted(kept)) if kept else text[: 4 * most]
        line = f"[{stars(r)}] {regex.sub(r'^\s+|\s+$', '', r['headline'].split(':')[0])}: {text}"
        if used + cost(line) <= budget:
            used += cost(line)
            out.append((n + 1, i, round(score, 9), line, cost(line), used))
    return out
