"""Near-duplicate documents by HyperMinHash.

A document's set are its distinct shingles of ``WIDTH`` words (a shorter text's
words as one).  Documents are linked where intersection / union reaches
``PERCENT``; classes are the connected components.

1. Each document gets a digest of its set, and a sketch: of each of REGISTERS
   hash functions, the least value as a compressed register of leading zeros
   and MANTISSA further bits.
2. Documents of equal sets are one class from the start (an aggregate combined
   before the shuffle); only its smallest id goes on.
3. Registers are banded, ROWS to a band.  Two sets of similarity s share a band
   with probability 1 - (1 - s**ROWS)**BANDS, 0.999995 at 0.75.  In each bucket
   every member is paired with the smallest id only.
4. A pair whose similarity, estimated from the share of equal registers less
   those that collide by chance, lies far below the threshold is dropped; the
   others are verified on their full sets.
5. Linked pairs form components.  Large buckets that still hold several
   components may get other centres (``rounds``), and are then searched block by
   block within tasks: first by registers alone for members that may be linked
   with another component, then these by their full sets.  So no link is lost to
   the choice of pairs, and no pairs are written out but those with a centre.

A shingle is told by 64 bits made from digests of its words, a set by a 128-bit
digest; two sets of 10,000 shingles share one by chance once in 10**11 pairs.
Long texts are read in pieces; a set is held whole (8 bytes a shingle).

Defined cases: null and empty texts, and those of white space, have empty sets
and are linked with nothing; a null id is linked with nothing and keeps its row
with a null component; rows that share an id are one node; an empty table gives
no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textops
from .components import components
from .shared import small_batches, splittable, written

WIDTH, PERCENT = 5, 75
BANDS, ROWS, MANTISSA = 32, 4, 10
REGISTERS = BANDS * ROWS
#: Standard deviations of the estimate that a pair may lie below the threshold and still be verified.
SLACK = 5.0
_FACTORS = np.random.Generator(np.random.PCG64(textops.SEED + 1)).integers(0, 1 << 63, REGISTERS, dtype=np.uint64) * textops.U64(2) + textops.U64(1)


def sets(texts: pa.Array, width: int = WIDTH) -> Iterator[tuple[int, np.ndarray]]:
    """(row, sorted distinct shingle hashes) of every whole text; a long one's come together from its pieces."""
    held: list[np.ndarray] = []
    for s in textops.slices(texts, textops.SPACED_FOLDED, width - 1):
        runs = s.runs(width)
        if s.part:
            held.append(np.unique(runs))
            if len(held) == 16 or not s.more:
                held = [np.unique(np.concatenate(held))]
            if not s.more:
                own, held = held[0], []
                yield int(s.rows[0]), own if len(own) else textops.runs_of(s.hash, len(s.hash))
            continue
        for i, row in enumerate(s.rows):
            f, n = s.first[i], s.first[i + 1] - s.first[i]
            own = runs[f : f + n - width + 1] if n >= width else textops.runs_of(s.hash[f : f + n], n) if n else runs[:0]
            yield row, np.unique(own)


def compressed(least: np.ndarray) -> np.ndarray:
    """Registers: the number of leading zeros, and the MANTISSA bits after the first one."""
    # Rounding to 53 bits does not matter to the first eleven but for a carry, which is a valid value too.
    mantissa, exponent = np.frexp(np.maximum(least, 1).astype(np.float64))
    bits = np.minimum(((mantissa * 2 - 1) * (1 << MANTISSA)).astype(np.int64), (1 << MANTISSA) - 1)
    return (np.maximum(64 - exponent, 0).astype(np.int64) << MANTISSA | bits).astype(np.uint16)


def sketch(own: np.ndarray) -> np.ndarray:
    least = np.full(REGISTERS, textops._MASK, np.uint64)
    for at in range(0, len(own), 1024):
        np.minimum(least, (own[at : at + 1024, None] * _FACTORS[None, :]).min(axis=0), out=least)
    return compressed(least)


def estimate(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray) -> np.ndarray:
    """Jaccard similarity from the share of equal registers, without the expected chance collisions.

    Minima of n and m values have densities n e^-nu and m e^-mu; two fall into
    one cell, on average 0.72 u / 2**MANTISSA wide, with this chance.
    """
    chance = 0.72 / (1 << MANTISSA) * na * nb / (na + nb) ** 2.0
    return ((a == b).mean(axis=-1) - chance) / (1 - chance)


def least_estimate(percent: int = PERCENT) -> float:
    s = percent / 100
    return s - SLACK * (s * (1 - s) / REGISTERS) ** 0.5


def linked(a: np.ndarray, b: np.ndarray, percent: int = PERCENT) -> bool:
    small, large = (a, b) if len(a) <= len(b) else (b, a)
    if 100 * len(small) < percent * len(large):
        return False
    both = int((large[np.minimum(np.searchsorted(large, small), len(large) - 1)] == small).sum())
    return 100 * both >= percent * (len(a) + len(b) - both)


def described(documents: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, key1, key2, registers) of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            sizes, keys, registers = np.zeros(n, np.int64), np.zeros((n, 2), np.uint64), [None] * n
            for row, own in sets(batch.column(1)):
                sizes[row] = len(own)
                if len(own):
                    keys[row] = np.frombuffer(textops.digest(own.tobytes()), "<u8")
                    registers[row] = sketch(own).tobytes()
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(sizes), pa.array(keys[:, 0].view(np.int64)), pa.array(np.ascontiguousarray(keys[:, 1]).view(np.int64)), pa.array(registers, pa.binary())], ["doc_id", "n_shingles", "key1", "key2", "registers"])

    return documents.select("doc_id", "text").mapInArrow(run, "doc_id long, n_shingles long, key1 long, key2 long, registers binary")


def buckets(sketches: DataFrame) -> DataFrame:
    """(bucket, band, id) for each band of each sketch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            own = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint16).reshape(-1, BANDS, ROWS).astype(np.uint64)
            packed = own[:, :, 0]
            for j in range(1, ROWS):
                packed = packed << textops.U64(16) | own[:, :, j]
            mixed = textops.mix(packed ^ textops.mix(np.arange(1, BANDS + 1, dtype=np.uint64))[None, :])
            band = np.tile(np.arange(BANDS, dtype=np.int8), len(own))
            yield pa.RecordBatch.from_arrays([pa.array(mixed.ravel().view(np.int64)), pa.array(band), pa.array(np.repeat(batch.column(0).to_numpy(), BANDS))], ["bucket", "band", "id"])

    return sketches.select("id", "registers").mapInArrow(run, "bucket long, band byte, id long")


def full_sets(documents: DataFrame, ids: DataFrame) -> DataFrame:
    """(id, n, own) of chosen documents: their sets, sorted, as bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [(row, own) for row, own in sets(batch.column(1)) if len(own)]
            for at in range(0, len(out), 512):
                rows, own = zip(*out[at : at + 512], strict=True)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows)), pa.array([len(x) for x in own], pa.int64()), pa.array([x.tobytes() for x in own], pa.binary())], ["id", "n", "own"])

    chosen = documents.select(F.col("doc_id").cast("long").alias("id"), "text").join(ids, "id", "left_semi").select("id", "text")
    return chosen.mapInArrow(run, "id long, n long, own binary")


def verified(pairs: DataFrame, known: DataFrame, percent: int, share: int = 500) -> DataFrame:
    """The pairs (a, b) whose full sets are linked.

    A pair travels with the set of a to the set of b; a b with many pairs is
    dealt over several tasks, each with ``share`` pairs or so and a copy of b's set.
    """
    per = splittable(pairs.groupBy("b").agg(F.ceil(F.count("*") / share).cast("int").alias("parts")), "pairs-each")
    left = pairs.join(per, "b").join(known.withColumnRenamed("id", "a"), "a").select("b", F.pmod(F.xxhash64("a"), F.col("parts")).cast("int").alias("part"), "a", "own")
    right = per.join(known.withColumnRenamed("id", "b"), "b").select("b", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(None).cast("long").alias("a"), "own")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, other = None, None
        for batch in batches:
            out = []
            for b, a, own in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                own = np.frombuffer(own, np.uint64)
                if a is None:  # nulls come first
                    at, other = b, own
                elif b == at and linked(own, other, percent):
                    out.append((a, b))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], ["a", "b"])

    rows = left.unionByName(right).repartition("b", "part").sortWithinPartitions("b", "part", F.col("a").asc_nulls_first())
    return rows.mapInArrow(run, "a long, b long")


def plausible(pairs: DataFrame, sketches: DataFrame, percent: int) -> DataFrame:
    """The pairs whose estimated similarity does not rule out a link."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        least = least_estimate(percent)
        for batch in batches:
            if batch.num_rows:
                a, b = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint16).reshape(-1, REGISTERS) for c in (2, 3))
                ok = estimate(a, b, batch.column(4).to_numpy(), batch.column(5).to_numpy()) >= least
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(ok))

    s = sketches.select("id", "registers", "n")
    a, b = s.select(F.col("id").alias("a"), F.col("registers").alias("ra"), F.col("n").alias("na")), s.select(F.col("id").alias("b"), F.col("registers").alias("rb"), F.col("n").alias("nb"))
    return pairs.join(a, "a").join(b, "b").select("a", "b", "ra", "rb", "na", "nb").mapInArrow(run, "a long, b long")


def _meet(members: DataFrame, block: int, out: str, found: Callable[[tuple, list], list[tuple]]) -> DataFrame:
    """``found`` of the members of each pair of blocks of a bucket, so that no task holds a whole bucket.

    ``members``: (bucket, size, band, id, root, registers, own).  A bucket is cut into
    blocks of about ``block`` members; pairs of members stay in the task.
    """
    own = F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")
    dealt = members.withColumn("blocks", F.ceil(F.col("size") / block).cast("int")).withColumn("block", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select("bucket", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"), "block", "band", "id", "root", "registers", "own")
    names = [c.split()[0] for c in out.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, []

        def result() -> Iterator[pa.RecordBatch]:
            if len(held) > 1 and (rows := found(key, held)):
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names)

        for batch in batches:
            for bucket, lo, hi, *row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (bucket, lo, hi) != key:
                    yield from result()
                    key, held = (bucket, lo, hi), []
                held.append(row)
        yield from result()

    return dealt.repartition("bucket", "lo", "hi").sortWithinPartitions("bucket", "lo", "hi", "id").mapInArrow(run, out)


def _candidates(key: tuple, held: list, percent: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each member: those of other components that its sketch may be linked with in this band first, and all members' roots, to be updated."""
    blocks, bands, ids, roots, raw, _ = zip(*held, strict=True)
    blocks, least = np.array(blocks), least_estimate(percent)
    regs = np.frombuffer(b"".join(raw), np.uint16).reshape(-1, REGISTERS)
    # Sizes only move the correction for chance, which is largest for equal ones.
    n = np.ones(len(ids))
    _, roots = np.unique(roots, return_inverse=True)
    for i in range(len(ids) - 1):
        other = np.arange(i + 1, len(ids))
        other = other[(roots[other] != roots[i]) & ((blocks[other] != blocks[i]) | (key[1] == key[2]))]
        if not len(other):
            continue
        first = (regs[other] == regs[i]).reshape(-1, BANDS, ROWS).all(axis=2).argmax(axis=1) == bands[i]
        other = other[first & (estimate(regs[other], regs[i], n[other], n[i]) >= least)]
        if len(other):
            yield i, other, roots


def suspects(members: DataFrame, percent: int, block: int = 2048) -> DataFrame:
    """(bucket, id) of members whose sketch may be linked with one of another component; ``own`` is not read."""

    def found(key: tuple, held: list) -> list[tuple]:
        marked: set[int] = set()
        for i, other, _ in _candidates(key, held, percent):
            marked.add(i)
            marked.update(other.tolist())
        return [(key[0], held[i][2]) for i in sorted(marked)]

    return _meet(members.withColumn("own", F.lit(None).cast("binary")), block, "bucket long, id long", found).distinct()


def across(members: DataFrame, percent: int, block: int = 512) -> DataFrame:
    """Links (a, b) between different components in one bucket, as many as join them and no more.

    Pairs are estimated from registers, then verified on full sets, each in the
    first band that its two members share.
    """

    def found(key: tuple, held: list) -> list[tuple]:
        own, out = [np.frombuffer(row[5], np.uint64) for row in held], []
        for i, other, roots in _candidates(key, held, percent):
            for j in other.tolist():
                if roots[j] != roots[i] and linked(own[i], own[j], percent):
                    roots[roots == roots[j]] = roots[i]
                    out.append((held[i][2], held[j][2]))
        return out

    return _meet(members, block, "a long, b long", found)


def near_duplicates(documents: DataFrame, percent: int = PERCENT, rounds: int = 0) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id (least id of its class), kept.

    ``rounds`` is how often mixed buckets get another centre before they are
    searched; it changes no result.  A round costs some twenty small jobs, and
    pays where buckets of very many members are mixed.
    """
    small_batches(documents.sparkSession)
    docs = written(described(documents), "sketches")
    some = docs.filter("n_shingles > 0 and doc_id is not null")
    classes = some.groupBy("key1", "key2").agg(F.min("doc_id").alias("id"), F.first("registers").alias("registers"), F.first("n_shingles").alias("n"))
    classes = written(classes, "sketch-classes")
    sketches = splittable(classes.select("id", "registers", "n").dropDuplicates(["id"]), "sketches-each")

    banded = buckets(classes)
    shared = splittable(banded.groupBy("bucket").agg(F.min("id").alias("b"), F.count("*").alias("size")).filter("size > 1"), "buckets-shared")
    crowded = written(banded.join(shared, "bucket").select("bucket", "band", "id", "b", "size"), "buckets")
    pairs = written(plausible(crowded.filter("id <> b").select(F.col("id").alias("a"), "b").distinct(), sketches, percent), "pairs")
    known = written(full_sets(documents, crowded.filter("size > 2").select("id").unionByName(pairs.select(F.col("a").alias("id"))).unionByName(pairs.select(F.col("b").alias("id"))).distinct()), "sets")
    links = written(verified(pairs, known, percent), "links-verified")
    roots = written(components(links), "components")

    # Buckets of two were tested in full.  In others, pairs without the smallest id were not.
    large = crowded.filter("size > 2").select("bucket", "size", "band", "id")
    edges = lambda more: components(roots.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(more))
    for i in range(rounds):
        rooted, mixed = _mixed(large, roots, i)
        if mixed.isEmpty():
            break
        # Another centre: most members of a mixed bucket are linked with it or with one before, so few components are left.
        again = rooted.join(mixed, "bucket").filter("root <> centre_root").select(F.col("id").alias("a"), F.col("centre").alias("b")).distinct()
        more = written(verified(written(plausible(again, sketches, percent), "pairs"), known, percent), "links-verified")
        if not more.isEmpty():
            roots = written(edges(more), "components")
    rooted, mixed = _mixed(large, roots, rounds)
    if not mixed.isEmpty():
        members = rooted.join(mixed.select("bucket"), "bucket").join(sketches, "id").select("bucket", "size", "band", "id", "root", "registers")
        left = written(suspects(members, percent), "suspects")
        sizes = splittable(left.groupBy("bucket").agg(F.count("*").alias("size")), "suspects-each")
        chosen = members.drop("size").join(left, ["bucket", "id"]).join(sizes, "bucket").join(known, "id")
        further = written(across(chosen.select("bucket", "size", "band", "id", "root", "registers", "own"), percent), "links-across")
        if not further.isEmpty():
            roots = edges(further)

    named = classes.select("key1", "key2", "id").join(roots.withColumnRenamed("node", "id"), "id", "left").select("key1", "key2", F.coalesce("root", "id").alias("class_id"))
    # One row per class on this side: a class of many copies can be split.
    out = docs.select("doc_id", "n_shingles", "key1", "key2").join(named, ["key1", "key2"], "left")
    linkable = F.col("n_shingles") > 0
    component = F.when(linkable & F.col("doc_id").isNotNull(), F.col("class_id")).otherwise(F.col("doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id")).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def _mixed(large: DataFrame, roots: DataFrame, i: int) -> tuple[DataFrame, DataFrame]:
    """Members of large buckets with their components' roots, and of buckets with several of these a centre, another one for each ``i``."""
    rooted = written(large.join(roots.withColumnRenamed("node", "id"), "id", "left").withColumn("root", F.coalesce("root", "id")), "buckets-rooted")
    centre = F.min(F.struct(F.xxhash64("id", F.lit(i)).alias("order"), "id", "root")).alias("c")
    mixed = rooted.groupBy("bucket").agg((F.min("root") != F.max("root")).alias("mixed"), centre).filter("mixed")
    return rooted, splittable(mixed.select("bucket", F.col("c.id").alias("centre"), F.col("c.root").alias("centre_root")), "buckets-mixed")


def deduplicated(documents: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The documents of smallest id in their classes, with all columns; rows that share an id stay or go together."""
    gone = near_duplicates(documents, percent).filter("not kept").select("doc_id").distinct()
    return documents.join(gone, "doc_id", "left_anti").select(documents.columns)
