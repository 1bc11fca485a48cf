"""Packing by concatenate and cut.

All documents' ids, each document followed by ``eos``, form one long row that
is cut into sequences of ``length`` ids.  Two passes give every document its
place in that row without any task seeing more than its partition:

1. each partition tokenizes its documents, writes their ids and their offset
   within the partition to a table in the shared folder, and so fixes them;
2. prefix sums over the partitions' totals (one small row each) give every
   partition its global offset; documents are cut at the window boundaries.

Only the last sequence can be short; it is padded to ``length`` unless its
length is a power of two.

Defined cases: a null or empty text is the one id ``eos``; long texts, and long
runs of one character, are encoded in bounded time; repeated rows are packed each; an empty table gives no pieces; other columns are ignored.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import small_batches, written

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, padding long, ids binary"
_TOKENS = "doc_id long, part long, place long, first long, n long, ids binary"


def vocabulary_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


#: A part of a text that holds a run so long goes to the library of the vocabulary file itself.
LONG_RUN = 512
#: Longer texts are cut where no token can cross.
PART = 1 << 20
_WHITE = re.compile(r"\s{%d}" % LONG_RUN)
_DENSE = re.compile(r"[^\W_]{%d}|(?:[^\w\s]|_){%d}" % (LONG_RUN // 2, LONG_RUN // 2))
_CUT = re.compile(r"[A-Za-z](?= [A-Za-z])")


def byte_letters() -> dict[str, int]:
    """The character that stands for each byte in a byte-level vocabulary: itself if it can be printed, else one from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


def ranks_of(vocabulary: dict) -> dict[bytes, int] | None:
    """Byte strings by rank, where the file is a plain byte-level BPE whose ids are in the order of its merges; else None."""
    model, added = vocabulary["model"], vocabulary["added_tokens"]
    plain = model["type"] == "BPE" and vocabulary["normalizer"] is None and (vocabulary["pre_tokenizer"] or {}).get("type") == "ByteLevel"
    if not plain or vocabulary["pre_tokenizer"]["add_prefix_space"] or any(model.get(x) for x in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges")):
        return None
    if any(t[x] for t in added for x in ("single_word", "lstrip", "rstrip", "normalized")):
        return None
    merges = ["".join(m.split(" ") if isinstance(m, str) else m) for m in model["merges"]]
    if any(model["vocab"].get(m) != 256 + i for i, m in enumerate(merges)):
        return None
    letters, extra = byte_letters(), {t["content"] for t in added}
    return {bytes(letters[c] for c in word): i for word, i in model["vocab"].items() if word not in extra}


def has_long_run(text: str) -> bool:
    """Whether the text may hold a piece of LONG_RUN characters or more that is merged as one."""
    words = text.split()
    if max(map(len, words), default=0) >= LONG_RUN and _DENSE.search(text):
        return True
    return len(text) - sum(map(len, words)) - len(words) >= LONG_RUN - 1 and _WHITE.search(text) is not None


def parts_of(text: str) -> Iterator[str]:
    """A long text in parts, cut between a letter and a space before a letter, where every vocabulary of this kind ends a token."""
    at = 0
    while len(text) - at > PART and (cut := _CUT.search(text, at + PART)):
        yield text[at : cut.end()]
        at = cut.end()
    yield text[at:]


@lru_cache(maxsize=2)
def encoder(path: str):
    """Encodes a text to a list of arrays of ids, as ``tokenizers`` does with the vocabulary file at ``path``.

    A plain byte-level file has one result for a text, and the ranks in it give
    the same ids several times as fast by ``tiktoken``; added tokens are matched
    in text.  A text with a very long run without breaks, for which that is not
    made, and files of other kinds go to ``tokenizers``.
    """
    import public_tokenizers
    import tiktoken
    from tokenizers import Tokenizer

    with open(path, encoding="utf-8") as f:
        vocabulary = json.load(f)
    given = Tokenizer.from_file(path)
    slow = lambda text: given.encode(text, add_special_tokens=False).ids
    ranks = ranks_of(vocabulary)
    if ranks is None:
        return lambda text: [np.array(slow(text), "<u4")]
    added = {t["content"]: t["id"] for t in vocabulary["added_tokens"]}
    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=added)
    fast = lambda text: own.encode(text, allowed_special="all")
    return lambda text: [np.array(slow(part) if has_long_run(part) else fast(part), "<u4") for part in parts_of(text)]


def tokenized(documents: DataFrame, vocabulary: str, eos: int) -> DataFrame:
    """Each document's ids (with ``eos``), its partition and its place there; written, so that later reads agree."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, part, place, first = encoder(vocabulary_path(vocabulary)), TaskContext.get().partitionId(), 0, 0
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                piece = batch.slice(at, 256)
                ids = [np.concatenate([*encode(t or ""), np.array([eos], "<u4")]) for t in piece.column(1).to_pylist()]
                n = np.array([len(x) for x in ids], np.int64)
                firsts = first + np.concatenate([[0], np.cumsum(n)[:-1]]).astype(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [piece.column(0).cast(pa.int64()), pa.array(np.full(len(ids), part, np.int64)), pa.array(place + np.arange(len(ids))), pa.array(firsts), pa.array(n), pa.array([x.tobytes() for x in ids], pa.binary())],
                    ["doc_id", "part", "place", "first", "n", "ids"],
                )
                first, place = first + int(n.sum()), place + len(ids)

    return written(documents.select("doc_id", "text").mapInArrow(run, _TOKENS), "packing-ids")


def pack(documents: DataFrame, length: int = 2048, eos: int = 1, vocabulary: str = "byte_bpe_50k.json") -> DataFrame:
    """One row per piece: which ids of which document lie where in which sequence."""
    small_batches(documents.sparkSession)
    ids = tokenized(documents, vocabulary, eos)
    totals = ids.groupBy("part").agg(F.sum("n").alias("n"))
    # One row per partition of the first pass: a running sum over them is small at any size of the corpus.
    before = totals.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"), F.sum("n").over(Window.partitionBy()).alias("total"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                out = []
                for doc, begin, n, raw, total in zip(*(batch.slice(at, 256).column(c).to_pylist() for c in ("doc_id", "begin", "n", "ids", "total")), strict=True):
                    left = 0
                    while left < n:
                        offset = (begin + left) % length
                        size = min(n - left, length - offset)
                        sequence = (begin + left) // length
                        filled = min(length, total - sequence * length)
                        padding = 0 if filled & (filled - 1) == 0 else length - filled
                        own = raw[4 * left : 4 * (left + size)]
                        out.append((doc, left, size, zlib.crc32(own), n, sequence, offset, padding, own))
                        left += size
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), [pa.int64()] * 8 + [pa.binary()], strict=True)], [c.split()[0] for c in PIECES.split(", ")])

    placed = ids.join(F.broadcast(before), "part").select("doc_id", (F.col("before") + F.col("first")).alias("begin"), "n", "ids", "total")
    return placed.mapInArrow(cut, PIECES)
