"""Word splitting, exact word codes and hashes over Arrow string columns.

Everything here works on whole texts, on the UTF-8 bytes that Arrow already
holds.  A batch is handled in slices of about ``SLICE_BYTES`` of text.  A
longer document is cut between words into pieces, each of which repeats the
last ``overlap`` words of the one before, so memory is bounded by the slice
and not by the text.

Hashes only find candidates; what is final rests on bytes (``words`` and
``codes`` tell words apart by them) or on digests of them (``digest``).  A
word's hash mixes it in blocks of eight bytes, a long word's is the start of its
BLAKE2b digest, and runs of words are hashed by joining hashes of halves with a
mixing step: none of these is linear, so no pattern of letters or words makes
them agree.  They depend on nothing but the bytes, so all executors and all
runs agree.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 18
U64 = np.uint64
SEED = 20240229

_MASK = (1 << 64) - 1
#: Longer words are hashed one at a time.
LONG_WORD = 64
_MASKS = np.array([(1 << 8 * i) - 1 for i in range(8)] + [_MASK], U64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finisher (xor-shift and multiply)."""
    x = x ^ (x >> U64(32))
    x = x * U64(0xD6E8FEB86659FD93)
    x = x ^ (x >> U64(32))
    x = x * U64(0xD6E8FEB86659FD93)
    return x ^ (x >> U64(32))


def digest(raw: bytes, size: int = 16, number: int = 0) -> bytes:
    """A few bytes that stand for some bytes and a small number."""
    return blake2b(raw, digest_size=size, salt=number.to_bytes(4, "little")).digest()


def _spelled(data: np.ndarray, begin: np.ndarray, size: np.ndarray, seed: int) -> np.ndarray:
    """Hashes of stretches of bytes, eight at a time."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    blocks = np.ndarray(len(data) + 1, "<u8", padded, 0, (1,))  # the eight bytes from each place on
    h = mix(size.astype(U64) * U64(0x9E3779B97F4A7C15) + U64(seed))
    some = np.arange(len(size))
    for at in range(0, LONG_WORD, 8):
        if at:
            some = some[size[some] > at]
        if not len(some):
            break
        block = blocks[begin[some] + at] & _MASKS[np.minimum(size[some] - at, 8)]
        h[some] = mix(h[some] * U64(0xC2B2AE3D27D4EB4F) ^ block)
    long = np.flatnonzero(size > LONG_WORD)
    if len(long):
        raw = [blake2b(data[a : a + n].tobytes(), digest_size=8, salt=bytes([seed])).digest() for a, n in zip(begin[long].tolist(), size[long].tolist(), strict=True)]
        h[long] = np.frombuffer(b"".join(raw), "<u8")
    return h


WORD, BEGINNING = 1, 2


def hashes_of(words: list[bytes], seed: int = WORD) -> np.ndarray:
    """Hashes of words, or of beginnings of words, as slices give them."""
    size = np.array([len(w) for w in words], np.int64)
    return _spelled(np.frombuffer(b"".join(words), np.uint8), np.cumsum(size) - size, size, seed)


class Splitter:
    """Which bytes belong to words, and which byte stands for which; a word over ``most`` bytes may be cut in a long text."""

    def __init__(self, is_word: np.ndarray, fold_case: bool, most: int | None = None):
        self.is_word, self.most = is_word, most
        self.fold = None
        if fold_case:
            self.fold = np.arange(256, dtype=np.uint8)
            self.fold[65:91] += 32


def _spaces() -> np.ndarray:
    keep = np.ones(256, bool)
    keep[[0x20, *range(0x09, 0x0E)]] = False
    return keep


def _letters_digits() -> np.ndarray:
    keep = np.zeros(256, bool)
    keep[0x30:0x3A] = keep[0x61:0x7B] = True
    keep[0x41:0x5B] = True  # upper-case A-Z count after folding
    keep[0x80:] = True
    return keep


#: Words are runs of anything but ASCII white space; case is kept or folded.
SPACED = Splitter(_spaces(), fold_case=False)
SPACED_FOLDED = Splitter(_spaces(), fold_case=True)
#: Words are runs of ASCII letters and digits and of all other characters beyond ASCII.
ALNUM_FOLDED = Splitter(_letters_digits(), fold_case=True)


class Slice:
    """The words of a few whole documents, or of a piece (``part``) of a long one.

    ``rows`` are the documents' places in the batch; document ``i`` has the words
    ``first[i]:first[i+1]`` and the bytes ``bounds[i]:bounds[i+1]`` of ``data``;
    ``start``/``end`` are places in ``data``.  Of a piece, ``base`` is the number
    of the document's words before it, ``skip`` how many of its words the piece
    before had too, ``origin`` the place of its first byte in the document, and
    ``more`` whether another follows.
    """

    __slots__ = ("data", "rows", "first", "start", "end", "doc", "bounds", "base", "skip", "origin", "more", "part", "_inside", "_text", "_at", "_codes", "_words", "_hash")

    def __init__(self, data, rows, bounds, splitter: Splitter, base: int = 0, skip: int = 0, origin: int = 0, more: bool = False, part: bool = False):
        data = data if splitter.fold is None else splitter.fold[data]
        self.data, self.rows, self.bounds, self.base, self.skip, self.origin, self.more, self.part = data, rows, bounds, base, skip, origin, more, part
        n = len(data)
        inside = np.zeros(n + 2, np.int8)
        inside[1:-1] = splitter.is_word[data]
        edge = np.diff(inside)
        # A document ends its last word even if the next one starts with a letter.
        joins = bounds[1:-1]
        joins = joins[(joins > 0) & (joins < n)]
        joins = np.unique(joins[(inside[joins] == 1) & (inside[joins + 1] == 1)])
        self.start, self.end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        if len(joins):
            self.start = np.sort(np.concatenate([self.start, joins]))
            self.end = np.sort(np.concatenate([self.end, joins]))
        self._inside = inside[1:-1].view(bool)
        self.first = np.searchsorted(self.start, bounds)
        self.doc = np.repeat(np.arange(len(rows)), np.diff(self.first))
        self._text = self._codes = self._hash = None

    def _spell(self) -> None:
        at = np.zeros(len(self.start) + 1, np.int64)
        np.cumsum(self.end - self.start + 1, out=at[1:])
        out, keep = np.full(at[-1], 32, np.uint8), np.ones(at[-1], bool)
        keep[at[1:] - 1] = False
        out[keep] = self.data[self._inside]
        self._text, self._at = out.tobytes(), at

    @property
    def text(self) -> bytes:
        """All words, each followed by one space; word i lies at ``at[i]``."""
        if self._text is None:
            self._spell()
        return self._text

    @property
    def at(self) -> np.ndarray:
        if self._text is None:
            self._spell()
        return self._at

    def span(self, lo: int, hi: int) -> bytes:
        """The words from lo up to hi, joined by one space."""
        return self.text[self.at[lo] : self.at[hi] - 1] if hi > lo else b""

    def _encode(self) -> None:
        text, at = self.text, self.at
        small = at[-1] < 1 << 31
        buffers = [None, pa.py_buffer(at.astype(np.int32) if small else at), pa.py_buffer(text)]
        own = pa.Array.from_buffers(pa.binary() if small else pa.large_binary(), len(at) - 1, buffers).dictionary_encode()
        self._codes, (_, ends, raw) = own.indices.to_numpy(), own.dictionary.buffers()
        ends = np.frombuffer(ends, np.int32 if small else np.int64)[: len(own.dictionary) + 1].tolist() if len(own.dictionary) else [0]
        raw = raw.to_pybytes() if raw else b""
        self._words = [raw[a:b] for a, b in zip(ends, ends[1:], strict=False)]

    @property
    def codes(self) -> np.ndarray:
        """For each word, its place in ``words``; equal where the bytes are."""
        if self._codes is None:
            self._encode()
        return self._codes

    @property
    def words(self) -> list[bytes]:
        """The distinct words, each with a space at its end."""
        if self._codes is None:
            self._encode()
        return self._words

    @property
    def hash(self) -> np.ndarray:
        if self._hash is None:
            self._hash = _spelled(self.data, self.start, self.end - self.start, WORD)
        return self._hash

    def beginnings(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """The words of more than ``size`` bytes, and hashes of their first ``size`` bytes."""
        long = np.flatnonzero(self.end - self.start > size)
        return long, _spelled(self.data, self.start[long], np.full(len(long), size), BEGINNING)

    def runs(self, k: int) -> np.ndarray:
        """Hashes of all runs of k words of the slice (also across documents; see ``whole``)."""
        return runs_of(self.hash, k)

    def whole(self, k: int) -> np.ndarray:
        """Whether the run of k words from each start lies in one document."""
        n = len(self.start) - k + 1
        return self.doc[:n] == self.doc[k - 1 :] if n > 0 else np.zeros(0, bool)


def _joined(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return mix(a * U64(0x9E3779B97F4A7C15) ^ (b * U64(0xC2B2AE3D27D4EB4F) + U64(0x165667B19E3779F9)))


def runs_of(words: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all runs of k consecutive word hashes, joined from runs of powers of two."""
    n = len(words)
    if n < k or k < 1:
        return np.zeros(0, U64)
    h, size = words, 1
    while 2 * size <= k:
        h = _joined(h[: len(h) - size], h[size:])
        size *= 2
    if size < k:
        h = _joined(h[: n - k + 1], h[k - size :])
    return h


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets and bytes of a string column; nulls have no bytes."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if pa.types.is_null(texts.type):
        texts = texts.cast(pa.string())
    if texts.null_count:
        texts = texts.fill_null("" if not pa.types.is_binary(texts.type) else b"")
    wide = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    if not wide and not (pa.types.is_string(texts.type) or pa.types.is_binary(texts.type)):
        texts, wide = texts.cast(pa.large_string()), True
    _, at, data = texts.buffers()
    offsets = np.frombuffer(at, np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64) if at else np.zeros(len(texts) + 1, np.int64)
    return offsets, np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8)


def slices(texts: pa.Array, splitter: Splitter, overlap: int = 0) -> Iterator[Slice]:
    """Every document of a string column, in order, in slices of bounded text.

    A document longer than a slice comes alone, in pieces that overlap by ``overlap`` words.
    """
    offsets, data = buffers(texts)
    n, i = len(offsets) - 1, 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + SLICE_BYTES, "right")) - 1)
        j = min(j, n)
        if offsets[j] - offsets[i] > SLICE_BYTES:
            yield from _pieces(data[offsets[i] : offsets[j]], i, splitter, overlap)
        else:
            yield Slice(data[offsets[i] : offsets[j]], np.arange(i, j), offsets[i : j + 1] - offsets[i], splitter)
        i = j


def _pieces(data: np.ndarray, row: int, splitter: Splitter, overlap: int) -> Iterator[Slice]:
    begin = upto = base = skip = 0
    while True:
        end = min(upto + SLICE_BYTES, len(data))
        while end < len(data) and (splitter.most is None or end - upto < splitter.most):  # on to the end of a word
            ahead = np.flatnonzero(~splitter.is_word[data[end : end + SLICE_BYTES]])
            if len(ahead):
                end += int(ahead[0])
                break
            end = min(end + SLICE_BYTES, len(data))
        s = Slice(data[begin:end], np.array([row]), np.array([0, end - begin]), splitter, base, skip, begin, end < len(data), True)
        yield s
        if not s.more:
            return
        n = len(s.start)
        skip = min(overlap, n)
        base += n - skip
        begin, upto = begin + int(s.start[n - skip]) if skip else end, end


def minimiser_positions(hashes: np.ndarray, whole: np.ndarray, window: int) -> np.ndarray:
    """Places of the smallest hash (the first, if equal) of every full window of ``window`` runs.

    ``whole`` marks runs that lie in one document; windows that hold another
    run are left out, so equal stretches of words give equal choices.
    """
    n = len(hashes)
    if n < window:
        return np.zeros(0, np.int64)
    # Blocks of the window's length: a window is the end of one and the start of the next (van Herk).
    pad = -n % window
    big = np.concatenate([hashes, np.full(pad, _MASK, U64)]).reshape(-1, window)
    ahead = np.minimum.accumulate(big, axis=1).ravel()
    behind = np.minimum.accumulate(big[:, ::-1], axis=1)[:, ::-1].ravel()
    least = np.minimum(behind[: n - window + 1], ahead[window - 1 : n])
    cum = np.concatenate([[0], np.cumsum(~whole)])
    ok = cum[window:] == cum[:-window]
    # A run is chosen if it equals the least of some window in which no equal run comes before it.
    starts = np.flatnonzero(ok)
    if not len(starts):
        return np.zeros(0, np.int64)
    chosen = np.zeros(n, bool)
    # Neighbouring windows with the same least value: from the first of them on, the next place with that value.
    new = np.flatnonzero(np.concatenate([[True], (np.diff(starts) > 1) | (least[starts[1:]] != least[starts[:-1]])]))
    first, last = starts[new], starts[np.append(new[1:], len(starts)) - 1]
    for _ in range(4):
        at = _next(hashes, first, least[first], window)
        chosen[at] = True
        # Windows that begin beyond it have the value again further on.
        on = at < last
        first, last = at[on] + 1, last[on]
        if not len(first):
            return np.flatnonzero(chosen)
    # What repeats so often is looked at window by window.
    size = last - first + 1
    each = np.repeat(first - np.cumsum(size) + size, size) + np.arange(size.sum())
    chosen[_next(hashes, each, least[each], window)] = True
    return np.flatnonzero(chosen)


def _next(hashes: np.ndarray, begin: np.ndarray, want: np.ndarray, window: int) -> np.ndarray:
    """The first place from each beginning on that has the wanted hash; it lies within the window."""
    at, todo = begin.copy(), np.arange(len(begin))
    for _ in range(window):
        todo = todo[hashes[at[todo]] != want[todo]]
        if not len(todo):
            break
        at[todo] += 1
    return at
