"""Plain versions of the operators, for small fixtures."""

from __future__ import annotations

import hashlib
import re

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
FOLD = str.maketrans(UPPER, LOWER)


def spaced(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def alnum(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(FOLD))


def contamination(docs, items, width=13):
    windows = {}
    for item, text in items:
        w = alnum(text)
        if item is not None and w:
            k = min(width, len(w))
            for i in range(len(w) - k + 1):
                windows.setdefault(tuple(w[i : i + k]), set()).add(str(item))
    out = []
    for doc, text in docs:
        w, hit, own = alnum(text), set(), set()
        for k in {len(x) for x in windows}:
            for i in range(len(w) - k + 1):
                if found := windows.get(tuple(w[i : i + k])):
                    hit.update(range(i, i + k))
                    own |= found
        out.append((doc, len(w), len(hit), len(own), hashlib.sha256(",".join(sorted(own)).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w)))
    return out


def repeats(docs, length):
    """(doc, n_words, n_removed, kept digest); documents in order of id, of which None is the least."""
    seen, out = set(), []
    for doc, text in sorted(docs, key=lambda d: -(1 << 63) if d[0] is None else d[0]):
        w = spaced(text)
        gone = [False] * len(w)
        for i in range(len(w) - length + 1):
            key = tuple(w[i : i + length])
            if key in seen:
                gone[i : i + length] = [True] * length
            seen.add(key)
        out.append((doc, len(w), sum(gone), hashlib.sha256(" ".join(x for x, g in zip(w, gone, strict=True) if not g).encode()).hexdigest()))
    return out


def shingles(text, width=5):
    w = spaced((text or "").translate(FOLD))
    return {tuple(w[i : i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)} if w else set()


def near(docs, percent=75):
    own = {d: shingles(t) for d, t in docs}
    root = {d: d for d in own}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(own)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            both = len(own[a] & own[b])
            if own[a] and own[b] and 100 * both >= percent * (len(own[a]) + len(own[b]) - both):
                ra, rb = sorted((find(a), find(b)))
                root[rb] = ra
    return [(d, len(own[d]), find(d), find(d) == d) for d in ids]
