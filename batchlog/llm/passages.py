"""Repeated passages: what suffix-automaton and suffix-array deduplication share.

A window is ``length`` consecutive words of one document.  Each word that is
covered by a window whose words also start earlier (in a document of smaller
id, or earlier in the same one) is removed; windows are judged on the input.

1. Anchors.  Runs of ``grain`` words are hashed, and the smallest hash of each
   window is its anchor, so equal windows have equal anchors at equal places.
   With an anchor go a digest of its context (all words that a window
   holding it can reach) and its place.  Texts are split and hashed once; the
   anchors are written.
2. Anchors that occur once are dropped (an aggregate, then a join whose other
   side has one row per anchor, so that frequent anchors can be split).
3. Occurrences with equal contexts agree in all their windows: all but the
   first of them are removed whole, and only the first goes on.
4. First occurrences that share an anchor but not the context are compared by
   a matcher (see automaton.py and suffixes.py) in tasks dealt by anchor.  An
   anchor with over ``limit`` contexts is bisected: of its windows, one half has
   so many words to the right in common, the other so many to the left, so
   contexts are dealt by longer anchors for either half.  This is repeated until
   a group is small, or agrees in all words of its windows; then an aggregate
   that is combined before the shuffle finds the first.  So no key is too large
   for a task.
5. Every document gathers its removed places and is cut.

Nothing is removed on a rolling hash: contexts of an anchor are equal by 64 bits
of a BLAKE2b digest of their bytes (128 where a large group is said to agree in
all), and matchers compare words.  Texts of any length are read in
pieces, so a task's memory is bounded but for one text and its result.

Ids of documents should be unique.  Rows that agree in id and text are one
document and get the same result; rows that share an id but not the text are
told apart by 20 bits of the text's hash and ordered by them.  A null id comes
before all others.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from . import textops
from .shared import discard, small_batches, splittable, written

PLACE_BITS = 40
_PLACE = (1 << PLACE_BITS) - 1
#: A context, for matchers: ``left`` words lie before the anchor; ``words`` are joined by one space.
CONTEXT = "h long, doc long, place long, left int, words binary"
SPAN = "doc long, place long, size int"


def keyed(documents: DataFrame) -> DataFrame:
    """The key of each row (``doc``; ``tag``, the hash bits that go above a word's number in a place), its text, and all of it as ``row``."""
    return documents.select(
        F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))).alias("doc"),
        F.shiftleft(F.coalesce(F.xxhash64("text"), F.lit(0)).bitwiseAND((1 << 20) - 1), PLACE_BITS).alias("tag"),
        F.col("text").alias("text"),
        F.struct("*").alias("row"),
    )


def anchors_of(texts: pa.Array, length: int, grain: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, list[bytes]]]:
    """Of every anchor: its text's row, its hash, its word's number, and the digest of its context."""
    margin, done = length - grain, 0
    for s in textops.slices(texts, textops.SPACED, margin + length - 1):
        h, n = s.runs(grain), len(s.start)
        at = textops.minimiser_positions(h, s.whole(grain), margin + 1)
        if s.part:
            # A piece answers for the anchors whose contexts it holds and that no piece before had.
            at = at[s.base + at >= done]
            if s.more:
                at = at[at + length <= n]
                done = max(done, s.base + n - length + 1)
            else:
                done = 0
        own = s.doc[at]
        lo, hi = np.maximum(at - margin, s.first[own]), np.minimum(at + length, s.first[own + 1])
        text, begin, end = s.text, s.at[lo].tolist(), (s.at[hi] - 1).tolist()
        lefts = (at - lo).astype(np.uint16).tolist()
        # The anchor's place in the context goes into its digest.
        ctx = [textops.digest(text[a:b], 8, left) for left, a, b in zip(lefts, begin, end, strict=True)]
        yield s.rows[own], h[at], s.base + at - s.first[own], ctx


def anchors(documents: DataFrame, length: int, grain: int) -> DataFrame:
    """(h, ctx, doc, place) of every anchor of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc, tag = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            for row, h, place, ctx in anchors_of(batch.column(2), length, grain):
                if len(row):
                    yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(np.frombuffer(b"".join(ctx), "<i8")), pa.array(doc[row]), pa.array(tag[row] + place)], ["h", "ctx", "doc", "place"])

    return keyed(documents).select("doc", "tag", "text").mapInArrow(run, "h long, ctx long, doc long, place long")


def contexts(joined: DataFrame, length: int, grain: int) -> DataFrame:
    """The words around chosen anchors, from rows (text, tag, doc, chosen), ``chosen`` being an array of (h, place, hot)."""
    margin = length - grain

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc = batch.column(1).to_numpy(zero_copy_only=False)
            lists = batch.column(2)
            ends, flat = lists.offsets.to_numpy(), lists.values
            h, place, hot = (flat.field(i).to_numpy(zero_copy_only=False) for i in range(3))
            done = 0
            for s in textops.slices(batch.column(0), textops.SPACED, margin + length - 1):
                out, n = [], len(s.start)
                for i, row in enumerate(s.rows):
                    f, end = s.first[i], s.first[i + 1]
                    own = np.arange(ends[row], ends[row + 1])
                    if s.part:
                        number = place[own] & _PLACE
                        own = own[(number >= done) & ((number + length <= s.base + n) if s.more else (number >= 0))]
                    for j in own.tolist():
                        at = f + int(place[j] & _PLACE) - s.base
                        lo, hi = max(f, at - margin), min(end, at + length)
                        out.append((h[j], doc[row], place[j], at - lo, s.span(lo, hi), hot[j]))
                done = max(done, s.base + n - length + 1) if s.more else 0
                for cut in range(0, len(out), 4096):
                    cols = list(zip(*out[cut : cut + 4096], strict=True))
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.bool_()), strict=True)], [*_names(CONTEXT), "hot"])

    return joined.select("text", "doc", "chosen").mapInArrow(run, CONTEXT + ", hot boolean")


def _names(fields: str) -> list[str]:
    return [c.split()[0] for c in fields.split(", ")]


def halves(rows: DataFrame, length: int, grain: int) -> DataFrame:
    """Contexts of groups whose windows have ``lo`` to ``hi`` words left of the anchor, by half of that range.

    The new key is a digest of what all windows of a half have: the anchor with
    the least words to either side.  Contexts too short for that leave the
    half.  ``f1`` and ``f2`` are a digest of all words that its windows have; null
    where a context is too short for them all.
    """
    margin = length - grain
    out = CONTEXT + ", lo int, hi int, f1 long, f2 long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left, lo, hi = (batch.column(i).to_numpy().astype(np.int64) for i in (3, 5, 6))
            for s in textops.slices(batch.column(4), textops.SPACED, 4 * length):
                keys, fulls, own, a_of, b_of = [], [], [], [], []
                for i, row in enumerate(s.rows.tolist()):
                    first, last = int(s.first[i]), int(s.first[i + 1])
                    at, middle = first + int(left[row]), int(lo[row] + hi[row]) // 2
                    for a, b in ((int(lo[row]), middle), (middle + 1, int(hi[row]))):
                        begin, end = at - a, at + grain + margin - b
                        if a > b or begin < first or end > last:
                            continue
                        keys.append(textops.digest(s.span(begin, end), 8, a))
                        begin, end = at - b, at + length - a
                        fulls.append(textops.digest(s.span(begin, end)) if begin >= first and end <= last else None)
                        own.append(row)
                        a_of.append(a)
                        b_of.append(b)
                if own:
                    mask = np.array([x is None for x in fulls])
                    f = np.frombuffer(b"".join(x or bytes(16) for x in fulls), "<i8").reshape(-1, 2)
                    yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(b"".join(keys), "<i8")), *batch.take(pa.array(own)).columns[1:5], pa.array(a_of, pa.int32()), pa.array(b_of, pa.int32()), *[pa.array(np.ascontiguousarray(f[:, k]), mask=mask) for k in (0, 1)]], _names(out))

    return rows.mapInArrow(run, out)


def bisected(hot: DataFrame, length: int, grain: int, limit: int) -> tuple[list[DataFrame], list[DataFrame]]:
    """Groups of contexts of ``limit`` at most, and the spans of larger groups that agree in all their windows."""
    names, groups, spans = hot.columns, [], []
    rows = hot.withColumns({"lo": F.lit(0), "hi": F.lit(length - grain)})
    for _ in range((length - grain).bit_length() + 1):
        rows = written(halves(rows, length, grain), "contexts")
        equal = (F.count("f1") == F.count("*")) & (F.min("f1") == F.max("f1")) & (F.min("f2") == F.max("f2"))
        sizes = rows.groupBy("h").agg(F.count("*").alias("n"), F.coalesce(equal, F.lit(False)).alias("equal")).filter("n > 1")
        sized = rows.join(splittable(sizes, "context-groups"), "h")
        groups.append(sized.filter(F.col("n") <= limit).select(names))
        large = sized.filter(F.col("n") > limit)
        if large.isEmpty():
            break
        same = large.filter("equal").select("h", "doc", (F.col("place") - F.col("hi")).alias("place"), (length + F.col("hi") - F.col("lo")).alias("size"))
        first = splittable(same.groupBy("h").agg(F.min(F.struct("doc", "place")).alias("first")), "context-firsts")
        spans.append(same.join(first, "h").filter(F.struct("doc", "place") > F.col("first")).select("doc", "place", "size"))
        rows = large.filter("not equal").select(*names, "lo", "hi")
    return groups, spans


Matcher = Callable[[Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, list[bytes]]], int], Iterator[tuple[int, int, int]]]


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """Contexts (doc, place, left, words) of one anchor at a time, from rows sorted by anchor."""
    key, parts = None, []
    for batch in batches:
        if not batch.num_rows:
            continue
        h = batch.column(0).to_numpy(zero_copy_only=False)
        cuts = np.flatnonzero(h[1:] != h[:-1]) + 1
        for lo, hi in zip([0, *cuts], [*cuts, len(h)], strict=True):
            if parts and h[lo] != key:
                yield _joined(parts)
                parts = []
            key = h[lo]
            parts.append(batch.slice(lo, hi - lo))
    if parts:
        yield _joined(parts)


def _joined(parts: list[pa.RecordBatch]) -> tuple:
    cols = list(zip(*[(p.column(1).to_numpy(), p.column(2).to_numpy(), p.column(3).to_numpy(), p.column(4).to_pylist()) for p in parts], strict=True))
    return np.concatenate(cols[0]), np.concatenate(cols[1]), np.concatenate(cols[2]), [w for ws in cols[3] for w in ws]


def removed(documents: DataFrame, length: int, grain: int, matcher: Matcher, limit: int) -> tuple[DataFrame, DataFrame]:
    """Documents with keys, and by document what to remove: (doc, tag, marks), marks being (kind, place, size)."""
    found = written(anchors(documents, length, grain), "anchors")
    repeated = splittable(found.groupBy("h").agg(F.count("*").alias("n")).filter("n > 1").select("h"), "anchors-repeated")
    occurrences = written(found.join(repeated, "h", "left_semi"), "anchors-again")
    discard(found)
    firsts = occurrences.groupBy("h", "ctx").agg(F.min(F.struct("doc", "place")).alias("first")).select("h", "first.doc", "first.place")
    tag = F.shiftleft(F.shiftright("place", PLACE_BITS), PLACE_BITS)
    # Contexts of an anchor; one row per anchor on the other side of the join.
    many = splittable(firsts.groupBy("h").agg(F.count("*").alias("n")).filter("n > 1"), "anchors-many")
    chosen = firsts.join(many, "h").groupBy("doc", tag.alias("tag")).agg(F.collect_list(F.struct("h", "place", (F.col("n") > limit).alias("hot"))).alias("chosen"))
    docs = keyed(documents)
    all_contexts = written(contexts(docs.select("doc", "tag", "text").join(chosen, ["doc", "tag"]), length, grain), "contexts")
    cold, hot = all_contexts.filter("not hot").drop("hot"), all_contexts.filter("hot").drop("hot")

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple[int, int, int]] = []
        for row in matcher(_groups(batches), length):
            rows.append(row)
            if len(rows) == 65_536:
                yield _spans(rows)
                rows = []
        if rows:
            yield _spans(rows)

    groups, spans = bisected(hot, length, grain, limit)
    for g in groups:
        cold = cold.unionByName(g)
    # Whole groups of bounded size meet in a task, in order of document and place.
    found_spans = cold.repartition("h").sortWithinPartitions("h", "doc", "place").mapInArrow(match, SPAN)
    for x in spans:
        found_spans = found_spans.unionByName(x)
    mark = lambda df, kind, size: df.select("doc", "place", F.struct(F.lit(kind).cast("byte").alias("kind"), F.col("place"), size.cast("int").alias("size")).alias("mark"))
    marks = mark(occurrences, 0, F.lit(0)).unionByName(mark(firsts, 1, F.lit(0))).unionByName(mark(found_spans, 2, F.col("size")))
    # A document's marks are as many as its words at most.
    return docs, marks.groupBy("doc", tag.alias("tag")).agg(F.collect_list("mark").alias("marks"))


def _spans(rows: list[tuple[int, int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.int32()), strict=True)], ["doc", "place", "size"])


def cover(kind: np.ndarray, place: np.ndarray, size: np.ndarray, length: int, grain: int) -> np.ndarray:
    """The stretches of words to remove, as rows (from, up to), apart and in order, by the marks of one document."""
    again = np.setdiff1d(place[kind == 0], place[kind == 1])
    some = kind == 2
    begin = np.concatenate([np.maximum(again - (length - grain), 0), place[some]])
    end = np.concatenate([again + length, place[some] + size[some]])
    if not len(begin):
        return np.zeros((0, 2), np.int64)
    by = np.argsort(begin, kind="stable")
    begin, end = begin[by], np.maximum.accumulate(end[by])
    new = np.flatnonzero(np.concatenate([[True], begin[1:] > end[:-1]]))
    return np.stack([begin[new], end[np.append(new[1:], len(end)) - 1]], axis=1)


def trimmed(parts: Iterator[tuple[textops.Slice, int]], gone: np.ndarray) -> tuple[int, int, str, list[int], list[tuple[int, int]]]:
    """A document's number of words, how many go, the digest of those kept, the spans that go, and the stretches of bytes that stay.

    ``parts`` are its pieces, as a slice and its number there.
    """
    sha, n, stay, kept = hashlib.sha256(), 0, 0, []
    for s, i in parts:
        f, m = int(s.first[i]), int(s.first[i + 1] - s.first[i])
        at, upto = n, n + m
        stretches = []
        j = int(np.searchsorted(gone[:, 1], at, "right"))
        while j < len(gone) and gone[j, 0] < upto:
            if gone[j, 0] > at:
                stretches.append((at, int(gone[j, 0])))
            at = int(gone[j, 1])
            j += 1
        if at < upto:
            stretches.append((at, upto))
        for a, b in stretches:
            lo, hi = f + a - n, f + b - n
            sha.update((b" " if stay else b"") + s.span(lo, hi))
            begin, end = (int(x) + s.origin - int(s.bounds[i]) for x in (s.start[lo], s.end[hi - 1]))
            if kept and kept[-1][2] == a:
                kept[-1][1:] = [end, b]
            else:
                kept.append([begin, end, b])
            stay += b - a
        n = upto
    spans = np.minimum(gone[gone[:, 0] < n], n).ravel().tolist()
    return n, n - stay, sha.hexdigest(), spans, [(a, b) for a, b, _ in kept]


def documents_of(texts: pa.Array) -> Iterator[tuple[int, Iterator[tuple[textops.Slice, int]]]]:
    """Each row of a column with its pieces; these are to be used up before the next row."""
    own = textops.slices(texts, textops.SPACED)
    for s in own:
        if s.more:

            def pieces(s=s):
                while True:
                    yield s, 0
                    if not s.more:
                        return
                    s = next(own)

            yield int(s.rows[0]), pieces()
        else:
            for i, row in enumerate(s.rows.tolist()):
                yield row, iter([(s, i)])


def cut(documents: DataFrame, length: int, grain: int, matcher: Matcher, limit: int, into: str = "removal") -> DataFrame:
    """The documents with repeated passages cut from ``text``, and a column ``into``: (n_words, n_removed, kept_sha256, spans).

    Spans are pairs of word numbers, from and up to.  Texts without a repeat are
    left as they are.  Columns may have any names; one named as ``into`` is replaced.
    """
    small_batches(documents.sparkSession)
    documents = documents.drop(into)
    names = documents.columns
    docs, marks = removed(documents, length, grain, matcher, limit)
    joined = docs.join(marks, ["doc", "tag"], "left").select("row", "marks")
    text_at = names.index("text")
    kind = pa.struct([("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string()), ("spans", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # In small pieces, as texts are held several times over.
        for batch in (b.slice(at, 1024) for b in batches for at in range(0, b.num_rows, 1024)):
            columns, lists = batch.column(0).flatten(), batch.column(1)
            begin, flat = lists.offsets.to_numpy(), lists.values
            k, p, z = (flat.field(i).to_numpy(zero_copy_only=False) for i in range(3))
            offsets, data = textops.buffers(columns[text_at])
            texts, info = [], []
            for row, parts in documents_of(columns[text_at]):
                own = slice(begin[row], begin[row + 1])
                n_words, n_removed, sha, spans, kept = trimmed(parts, cover(k[own], p[own] & _PLACE, z[own].astype(np.int64), length, grain))
                raw = data[offsets[row] : offsets[row + 1]]
                texts.append(b"\n".join(raw[a:b].tobytes() for a, b in kept) if n_removed else raw.tobytes())
                info.append({"n_words": n_words, "n_removed": n_removed, "kept_sha256": sha, "spans": spans})
            known = columns[text_at].is_valid().to_numpy(zero_copy_only=False)
            columns[text_at] = pa.array(texts, pa.binary(), mask=~known).cast(pa.string())
            yield pa.RecordBatch.from_arrays([*columns, pa.array(info, kind)], [*names, into])

    out = StructType([*documents.schema.fields, StructField(into, StructType.fromDDL("n_words long, n_removed long, kept_sha256 string, spans array<long>"))])
    return joined.mapInArrow(run, out)
