"""Benchmark decontamination by a prefix-filtered set join.

A window is ``width`` consecutive words of a benchmark item (an item of fewer,
but not none, is one window).  A document is hit where a window occurs in it.

A window that occurs has all its shingles in the document, so one of them, the
rarest over all documents, is a sufficient prefix: documents are joined with
windows by that token only.  Candidates must then lie inside the document
(length and positional bounds) and agree word by word, by the words' bytes: the
block's words have codes, and a document's words are looked up by their bytes.

The benchmark is a stated query set.  It is indexed in blocks of at most
``block_bytes`` of text, and each block's index, whose size that bounds, is
broadcast; documents are only scanned, never shuffled, unless there are several
blocks, whose results are then merged by document.

Defined cases: a null or empty text has no words, is never hit, and is
returned; very long texts are read in pieces; null or empty items have no windows; items with a null id are left
out; repeated documents each give a row; equal items count each; an empty
benchmark hits nothing; other columns of either table are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textops
from .shared import small_batches

SCHEMA = "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, items array<string>"
_PARTS = "doc_id long, text_key long, n_words long, spans array<int>, items array<string>"


@dataclass
class Windows:
    """A block of windows of one length, distinct, with the items that hold them."""

    length: int
    words: np.ndarray  # windows x length word codes
    item_from: np.ndarray  # items of window i: items[item_from[i]:item_from[i + 1]]
    items: np.ndarray
    grain: int  # words in a shingle
    shingles: np.ndarray  # windows x (length - grain + 1)


@dataclass
class Index:
    """The windows of a block of items, by length, and the codes of its words; a word is told by its bytes."""

    codes: dict[bytes, int]
    windows: list[Windows]

    def coded(self, s: textops.Slice) -> np.ndarray:
        """The words of a slice as codes; -1 for a word that no item has."""
        if not len(s.start):
            return np.zeros(0, np.int64)
        get = self.codes.get
        return np.array([get(w, -1) for w in s.words], np.int64)[s.codes]


def shingles_of(codes: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all runs of k codes, by which candidates are found."""
    return textops.runs_of(textops.mix((codes + 2).astype(textops.U64)), k)


def index_items(ids: list, texts: list, width: int, shingle: int) -> Index:
    """The distinct windows of a block of items."""
    codes: dict[bytes, int] = {}
    by_length: dict[int, list] = {}
    for s in textops.slices(pa.array(texts, pa.large_string()), textops.ALNUM_FOLDED, width - 1):
        for i, row in enumerate(s.rows):
            if ids[row] is None or s.first[i] == s.first[i + 1]:
                continue
            own = np.array([codes.setdefault(w, len(codes)) for w in s.words], np.int64)[s.codes[s.first[i] : s.first[i + 1]]]
            # A piece of a long item has windows of the full width only.
            k = width if s.more or s.base else min(width, len(own))
            if len(own) >= k:
                by_length.setdefault(k, []).append((str(ids[row]), np.lib.stride_tricks.sliding_window_view(own, k)))
    out = []
    for k, parts in sorted(by_length.items()):
        words = np.concatenate([w for _, w in parts])
        owner = np.repeat(np.array([i for i, _ in parts], object), [len(w) for _, w in parts])
        words, inverse = np.unique(words, axis=0, return_inverse=True)
        inverse = inverse.ravel()
        order = np.argsort(inverse, kind="stable")
        grain = min(shingle, k)
        flat = shingles_of(words.ravel(), grain)
        at = (np.arange(len(words)) * k)[:, None] + np.arange(k - grain + 1)
        out.append(Windows(k, words, np.searchsorted(inverse[order], np.arange(len(words) + 1)), owner[order], grain, flat[at]))
    return Index(codes, out)


class Lookup:
    """Membership in a sorted array, with a bit table in front."""

    BITS = 20

    def __init__(self, keys: np.ndarray):
        self.keys = keys
        self.table = np.zeros(1 << self.BITS, bool)
        self.table[keys >> textops.U64(64 - self.BITS)] = True

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of hashes that are keys, and which keys."""
        if not len(self.keys):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        at = np.flatnonzero(self.table[hashes >> textops.U64(64 - self.BITS)])
        key = np.searchsorted(self.keys, hashes[at])
        ok = self.keys[np.minimum(key, len(self.keys) - 1)] == hashes[at]
        return at[ok], key[ok]


def shingle_counts(documents: DataFrame, index: Index) -> dict[int, dict[int, int]]:
    """How often each shingle of the block occurs in all documents, by shingle length (twice, where pieces of a long text overlap)."""
    spark = documents.sparkSession
    keys = {g: np.unique(np.concatenate([w.shingles.ravel() for w in index.windows if w.grain == g])) for g in {w.grain for w in index.windows}}
    shared = spark.sparkContext.broadcast((keys, index.codes))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, own = shared.value[0], Index(shared.value[1], [])
        lookups = {g: Lookup(k) for g, k in keys.items()}
        sums = {g: np.zeros(len(k), np.int64) for g, k in keys.items()}
        for batch in batches:
            for s in textops.slices(batch.column(0), textops.ALNUM_FOLDED, max(keys) - 1):
                codes = own.coded(s)
                for g, lookup in lookups.items():
                    at, key = lookup.find(shingles_of(codes, g))
                    key = key[s.whole(g)[at]]
                    sums[g] += np.bincount(key, minlength=len(sums[g]))
        for g, n in sums.items():
            some = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(some), g, np.int32)), pa.array(some), pa.array(n[some])], ["grain", "place", "n"])

    rows = documents.select("text").mapInArrow(count, "grain int, place long, n long").groupBy("grain", "place").agg(F.sum("n").alias("n")).collect()
    shared.unpersist()
    out = {g: dict.fromkeys(k.tolist(), 0) for g, k in keys.items()}
    for r in rows:
        out[r.grain][int(keys[r.grain][r.place])] = r.n
    return out


def prefixes(index: Index, counts: dict[int, dict[int, int]]) -> list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """By window length: sorted distinct prefix tokens; the windows of each, with the token's place in them."""
    out = []
    for w in index.windows:
        freq = counts[w.grain]
        n = np.array([freq[x] for x in w.shingles.ravel().tolist()], np.int64).reshape(w.shingles.shape)
        offset = n.argmin(axis=1)
        token = w.shingles[np.arange(len(offset)), offset]
        order = np.argsort(token, kind="stable")
        keys, starts = np.unique(token[order], return_index=True)
        out.append((keys, np.append(starts, len(order)), order, offset[order]))
    return out


def hits(s: textops.Slice, index: Index, found_by: list[tuple]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A mark for each word that a window covers; (document, item) pairs."""
    codes = index.coded(s)
    marks = np.zeros(len(codes) + 1, np.int64)
    docs, items = [], []
    for w, (lookup, starts, windows, offsets) in zip(index.windows, found_by, strict=True):
        at, key = lookup.find(shingles_of(codes, w.grain))
        n = starts[key + 1] - starts[key]
        pick = np.repeat(starts[key] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
        begin, window = np.repeat(at, n) - offsets[pick], windows[pick]
        inside = (begin >= 0) & (begin + w.length <= len(codes))
        begin, window = begin[inside], window[inside]
        inside = s.doc[begin] == s.doc[begin + w.length - 1]
        begin, window = begin[inside], window[inside]
        same = np.ones(len(begin), bool)
        for at in range(0, len(begin), 65_536):  # codes are equal where the bytes are
            part = slice(at, at + 65_536)
            same[part] = (codes[begin[part, None] + np.arange(w.length)] == w.words[window[part]]).all(axis=1)
        begin, window = begin[same], window[same]
        np.add.at(marks, begin, 1)
        np.add.at(marks, begin + w.length, -1)
        pairs = np.unique(np.stack([s.doc[begin], window]), axis=1)
        for d, x in pairs.T:
            own = w.items[w.item_from[x] : w.item_from[x + 1]]
            docs += [d] * len(own)
            items += own.tolist()
    return np.cumsum(marks[:-1]) > 0, np.array(docs, np.int64), np.array(items, object)


def found_in(texts: pa.Array, index: Index, found_by: list[tuple], width: int) -> Iterator[tuple[int, np.ndarray, int, list[str]]]:
    """For each text: how many words it has, the edges of the stretches that are hit, how many words these hold, and the items."""
    edges_of = lambda hit: np.flatnonzero(np.diff(np.concatenate([[0], hit.astype(np.int8), [0]])))
    tail, edges, hit_before, held = np.zeros(0, bool), [], 0, set()
    for s in textops.slices(texts, textops.ALNUM_FOLDED, width - 1):
        hit, docs, names = hits(s, index, found_by)
        if s.part:  # what it shares with the next piece is counted there
            hit[: len(tail)] |= tail
            own = len(hit) - (min(width - 1, len(hit)) if s.more else 0)
            edges.append(s.base + edges_of(hit[:own]))
            hit_before += int(hit[:own].sum())
            held.update(names.tolist())
            tail = hit[own:].copy()
            if not s.more:
                yield s.base + len(hit), np.concatenate(edges), hit_before, [*held]
                tail, edges, hit_before, held = np.zeros(0, bool), [], 0, set()
            continue
        upto = np.concatenate([[0], np.cumsum(hit)])
        order = np.argsort(docs, kind="stable")
        docs, names = docs[order], names[order]
        bounds = np.searchsorted(docs, np.arange(len(s.rows) + 1))
        n_hit, n_words = np.diff(upto[s.first]), np.diff(s.first)
        for i in range(len(s.rows)):
            yield int(n_words[i]), edges_of(hit[s.first[i] : s.first[i + 1]]) if n_hit[i] else np.zeros(0, np.int64), int(n_hit[i]), names[bounds[i] : bounds[i + 1]].tolist()


def verdict(n_words: int, n_hit: int, items: list[str]) -> tuple:
    items = sorted(set(items))
    return n_hit, len(items), hashlib.sha256(",".join(items).encode()).hexdigest(), n_hit > 0 and 20 * n_hit >= n_words, items


def clean(documents: DataFrame, benchmark: DataFrame, width: int = 13, shingle: int = 3, block_bytes: int = 16 << 20) -> DataFrame:
    """The documents that are not contaminated, with all their columns; each row is judged by itself."""
    return decontaminate(documents, benchmark, width, shingle, block_bytes, keep_rows=True)


def decontaminate(documents: DataFrame, benchmark: DataFrame, width: int = 13, shingle: int = 3, block_bytes: int = 16 << 20, keep_rows: bool = False) -> DataFrame:
    """One row per document: how many words benchmark windows hit, and which items have occurring windows."""
    spark = documents.sparkSession
    small_batches(spark)
    items = benchmark.select("item_id", "text").filter("item_id is not null and text is not null")
    total = items.agg(F.sum(F.octet_length("text")).alias("n")).first().n or 0
    n_blocks = max(1, -(-total // block_bytes))
    parts, out = [], None
    for b in range(n_blocks):
        block = (items if n_blocks == 1 else items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(n_blocks)) == b)).collect()
        index = index_items([r.item_id for r in block], [r.text for r in block], width, shingle)
        found = prefixes(index, shingle_counts(documents, index)) if index.windows else []
        shared = spark.sparkContext.broadcast((index, found))

        def scan(batches: Iterator[pa.RecordBatch], shared=shared, last=n_blocks == 1) -> Iterator[pa.RecordBatch]:
            index, found = shared.value
            found = [(Lookup(keys), *rest) for keys, *rest in found]
            for batch in batches:
                rows = []
                for n_words, edges, n_hit, own in found_in(batch.column(1), index, found, width):
                    rows.append((n_words, *verdict(n_words, n_hit, own)) if last else (n_words, edges.tolist(), own))
                cols = list(zip(*rows, strict=True)) if rows else [()] * (6 if last else 3)
                if last:
                    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.bool_(), pa.list_(pa.string())]
                    names = ["n_words", "n_hit", "n_items", "items_sha256", "contaminated", "items"]
                    head = [batch.column(0).cast(pa.int64())]
                    head_names = ["doc_id"]
                else:
                    kinds, names = [pa.int64(), pa.list_(pa.int32()), pa.list_(pa.string())], ["n_words", "spans", "items"]
                    head, head_names = [batch.column(0).cast(pa.int64()), batch.column(2)], ["doc_id", "text_key"]
                yield pa.RecordBatch.from_arrays(head + [pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], head_names + names)

        docs = documents.select("doc_id", "text")
        if n_blocks == 1 and keep_rows:
            id_at, text_at = documents.columns.index("doc_id"), documents.columns.index("text")

            def sift(batches: Iterator[pa.RecordBatch], scan=scan) -> Iterator[pa.RecordBatch]:
                for batch in batches:
                    pair = pa.RecordBatch.from_arrays([batch.column(id_at), batch.column(text_at)], ["doc_id", "text"])
                    for found in scan(iter([pair])):
                        yield batch.filter(pa.compute.invert(found.column(5)))

            return documents.mapInArrow(sift, documents.schema)
        if n_blocks == 1:
            return docs.mapInArrow(scan, SCHEMA)
        parts.append(docs.withColumn("text_key", F.xxhash64("text")).mapInArrow(scan, _PARTS))
    for p in parts:
        out = p if out is None else out.unionByName(p)
    merged = _merge(documents, out)
    if not keep_rows:
        return merged.drop("text_key")
    gone = merged.filter("contaminated").select("doc_id", "text_key").alias("g")
    own = documents.alias("d")
    return own.join(gone, F.col("d.doc_id").eqNullSafe(F.col("g.doc_id")) & (F.xxhash64("d.text") == F.col("g.text_key")), "left_anti").select(documents.columns)


def _merge(documents: DataFrame, parts: DataFrame) -> DataFrame:
    """Results of several blocks, by document (its id and its text's hash)."""

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                marks = np.zeros(r["n_words"] + 1, np.int64)
                for spans in r["spans"]:
                    marks[spans[::2]] += 1
                    marks[spans[1::2]] -= 1
                n_hit = int((np.cumsum(marks[:-1]) > 0).sum())
                v = verdict(r["n_words"], n_hit, [x for xs in r["items"] for x in xs])
                rows.append({"doc_id": r["doc_id"], "text_key": r["text_key"], "n_words": r["n_words"], "n_hit": v[0], "n_items": v[1], "items_sha256": v[2], "contaminated": v[3], "items": v[4]})
            schema = pa.schema([("doc_id", pa.int64()), ("text_key", pa.int64()), ("n_words", pa.int64()), ("n_hit", pa.int64()), ("n_items", pa.int64()), ("items_sha256", pa.string()), ("contaminated", pa.bool_()), ("items", pa.list_(pa.string()))])
            yield pa.RecordBatch.from_pylist(rows, schema)

    copies = documents.select("doc_id", F.xxhash64("text").alias("text_key")).groupBy("doc_id", "text_key").agg(F.count("*").alias("copies"))
    joined = parts.groupBy("doc_id", "text_key").agg(F.first("n_words").alias("n_words"), F.collect_set("spans").alias("spans"), F.collect_set("items").alias("items"))
    joined = joined.alias("p").join(copies.alias("c"), F.col("p.doc_id").eqNullSafe(F.col("c.doc_id")) & (F.col("p.text_key") == F.col("c.text_key")))
    rows = joined.select("p.doc_id", "p.text_key", "n_words", "spans", "items", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("copy")).drop("copy")
    return rows.mapInArrow(merge, SCHEMA.replace("doc_id long", "doc_id long, text_key long", 1))
