"""Plain restatements of the contracts, a document at a time."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import xxhash

WS = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(t: str) -> str:
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in t)


def sha(t: str) -> str:
    return hashlib.sha256(t.encode()).hexdigest()


def fingerprint(text: str | None) -> int:
    w = WS.findall(lower(text or ""))
    shingles = [" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))] if w else []
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def simhash(docs):
    """docs: (doc_id, text).  -> {(doc_id, hex, component)} as a Counter."""
    fps = [fingerprint(t) for _, t in docs]
    own = sorted(set(fps))
    root = {f: f for f in own}

    def find(f):
        while root[f] != f:
            f = root[f]
        return f

    for i, a in enumerate(own):
        for b in own[:i]:
            if (a ^ b).bit_count() <= 3:
                root[max(find(a), find(b))] = min(find(a), find(b))
    least = {}
    for (d, _), f in zip(docs, fps):
        if d is not None:
            least[find(f)] = min(least.get(find(f), d), d)
    return Counter((d, f"{f:016x}", least.get(find(f))) for (d, _), f in zip(docs, fps))


def base_licenses(text):
    w = ALNUM.findall(lower(text or ""))
    phrases = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
    at, labels = [], set()
    for p, label in phrases.items():
        p = p.split()
        for i in range(len(w) - len(p) + 1):
            if w[i : i + len(p)] == p:
                at.append(i)
                labels.add(label)
    return len(w), len(at), min(at, default=None), max(at, default=None), ",".join(sorted(labels))


def contaminated(docs, items):
    windows = defaultdict(set)
    for item, text in items:
        w = ALNUM.findall(lower(text or ""))
        n = min(13, len(w))
        for i in range(len(w) - n + 1) if w else ():
            windows[tuple(w[i : i + n])].add(item)
    lengths = {len(k) for k in windows}
    out = Counter()
    for d, text in docs:
        w = ALNUM.findall(lower(text or ""))
        hit, found = [False] * len(w), set()
        for n in lengths:
            for i in range(len(w) - n + 1):
                if (k := tuple(w[i : i + n])) in windows:
                    hit[i : i + n] = [True] * n
                    found |= windows[k]
        found = sorted(str(x) for x in found if x is not None)
        out[d, len(w), sum(hit), len(found), sha(",".join(found)), sum(hit) > 0 and 20 * sum(hit) >= len(w)] += 1
    return out


def quality(text):
    text = text or ""
    w = WS.findall(text)
    lines = [x for x in text.split("\n") if WS.search(x)]
    seen = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    hit = [False] * len(w)
    for i in range(len(w) - 2):
        if seen[tuple(w[i : i + 3])] > 1:
            hit[i : i + 3] = [True] * 3
    failed = len(w) < 50 or 100 * sum(hit) > 50 * len(w)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), sum(hit), failed


def substrings(docs, window=35):
    words = [WS.findall(t or "") for _, t in docs]
    seen = Counter(tuple(w[i : i + window]) for w in words for i in range(len(w) - window + 1))
    out = Counter()
    for (d, _), w in zip(docs, words):
        gone = [False] * len(w)
        for i in range(len(w) - window + 1):
            if seen[tuple(w[i : i + window])] > 1:
                gone[i : i + window] = [True] * window
        out[d, len(w), sum(gone), sha(" ".join(x for x, g in zip(w, gone) if not g))] += 1
    return out


def targets(sizes: dict, weights=(3, 1, 2), budget=1.5, most=2.0):
    """{source: size} -> {source: target}, sharing the excess again until none is above."""
    order = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weight = {s: weights[k % len(weights)] for k, s in enumerate(order)}
    left, open_, out = budget * sum(sizes.values()), set(order), {}
    while open_:
        level = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if level * weight[s] > most * sizes[s]}
        if not full:
            return out | {s: level * weight[s] for s in open_}
        out |= {s: most * sizes[s] for s in full}
        left -= sum(most * sizes[s] for s in full)
        open_ -= full
    return out


def sizes(docs):
    """(doc_id, size, crc32) of each."""
    return Counter((d, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for d, t in docs)


def chats(rows):
    """rows: (conv_id, turn, role, text) -> {(conv_id, n, turns_sha, loss_chars, loss_sha)}."""
    by = defaultdict(list)
    for c, t, r, x in rows:
        by[c].append((t is not None, t or 0, r or "", x or ""))
    out = Counter()
    for c, turns in by.items():
        turns.sort()
        learned = "".join(x for _, _, r, x in turns if r == "assistant")
        out[c, len(turns), sha("".join(f"{r}\n{x}\n" for _, _, r, x in turns)), len(learned), sha(learned)] += 1
    return out
