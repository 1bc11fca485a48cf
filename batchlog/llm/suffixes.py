"""Passage deduplication by sparse suffix arrays.

Only suffixes that start at content-selected minimiser positions are kept (the
anchors of passages.py).  In each task they are sorted and neighbours compared:
that gives how far each agrees with the next to the right, and so the runs of
suffixes that share the right part of a window.  Matches are then extended to
the left word by word; suffixes of a run with equal left parts hold the same
window, and all but the first of them lose it.

Defined cases: null, empty and short texts lose nothing; of equal documents the
one with the smallest id keeps its words; an empty table gives no rows; other
columns are kept.  See passages.py for repeated and null ids.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from . import passages

BLOCK = 4096


def match(groups: Iterator[tuple], length: int) -> Iterator[tuple[int, int, int]]:
    """Spans (doc, place, size) of passages whose windows came earlier; several anchors are sorted at once."""
    block, rows = [], 0
    for group in groups:
        block.append(group)
        rows += len(group[0])
        if rows >= BLOCK:
            yield from _sorted(block, length)
            block, rows = [], 0
    if block:
        yield from _sorted(block, length)


def _sorted(block: list[tuple], length: int) -> Iterator[tuple[int, int, int]]:
    anchor = np.repeat(np.arange(len(block)), [len(g[0]) for g in block])
    doc, place, left = (np.concatenate([g[i] for g in block]) for i in range(3))
    n = len(doc)
    # Words as codes, from 1; equal where their bytes are.
    words = pc.split_pattern(pa.array([w for g in block for w in g[3]], pa.binary()), b" ")
    ends = words.offsets.to_numpy()
    codes = words.flatten().dictionary_encode().indices.to_numpy().astype(np.int64) + 1
    size, n_left = np.diff(ends), left.astype(np.int64)
    n_right = np.minimum(size - n_left, length)
    across = np.arange(length)[None, :]
    codes = np.append(codes, 0)
    right = codes[np.where(across < n_right[:, None], ends[:-1, None] + n_left[:, None] + across, -1)]
    before = codes[np.where(across < n_left[:, None], ends[:-1, None] + n_left[:, None] - 1 - across, -1)]
    # Sort the suffixes, within their anchors.
    order = np.lexsort((*right.T[::-1], anchor))
    anchor, doc, place, right, before, n_right, n_left = (x[order] for x in (anchor, doc, place, right, before, n_right, n_left))
    # Compare neighbours: the words they share to the right.
    shared = np.zeros(n, np.int64)
    if n > 1:
        shared[1:] = np.minimum.accumulate(right[1:] == right[:-1], axis=1).sum(axis=1)
        shared[1:] = np.minimum(shared[1:], np.minimum(n_right[1:], n_right[:-1])) * (anchor[1:] == anchor[:-1])
    spans = []
    extended = np.zeros(n, np.int64)
    for o in range(length):  # words of the window to the left of the anchor
        if o:  # ranks of the left parts of that length
            _, extended = np.unique(extended * len(codes) + before[:, o - 1], return_inverse=True)
        ok = (n_left >= o) & (n_right >= length - o)
        if not ok.any():
            continue
        run = np.cumsum(shared < length - o)
        some = np.flatnonzero(ok)
        by = some[np.lexsort((place[some], doc[some], extended[some], run[some]))]
        new = np.concatenate([[True], (run[by[1:]] != run[by[:-1]]) | (extended[by[1:]] != extended[by[:-1]])])
        head = by[np.maximum.accumulate(np.where(new, np.arange(len(by)), 0))]
        later = (doc[by] != doc[head]) | (place[by] != place[head])
        spans.append(np.stack([doc[by[later]], place[by[later]] - o]))
    if spans:
        d, p = np.concatenate(spans, axis=1)
        by = np.lexsort((p, d))
        d, p = d[by], p[by]
        # Neighbouring windows of a document make one span.
        cut = np.flatnonzero(np.concatenate([[True], (d[1:] != d[:-1]) | (p[1:] > p[:-1] + length)])) if len(d) else np.zeros(0, np.int64)
        ends = np.append(cut[1:], len(d)) - 1
        yield from zip(d[cut].tolist(), p[cut].tolist(), (p[ends[: len(cut)]] + length - p[cut]).tolist(), strict=True)


def remove_passages(documents: DataFrame, length: int = 50, grain: int = 12, limit: int = 8000, into: str = "removal") -> DataFrame:
    """Documents without the words of windows of ``length`` words that came earlier; see ``passages.cut``."""
    return passages.cut(documents, length, grain, match, limit, into)
