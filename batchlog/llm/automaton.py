"""Substring deduplication by suffix automata.

The reference is the corpus itself, sharded by anchor (see passages.py): each
shard's task builds an automaton over the words of its reference passages, in
order of document and place, and streams every passage through it before adding
it.  The matching statistics tell at each word how long a stretch that ends
there came earlier; where that reaches the window's length, the window goes.

The shards are not broadcast: together they grow with the corpus, so each is
dealt to the one task that also gets the passages that can match it.

Defined cases: null, empty and short texts lose nothing; of equal documents the
one with the smallest id keeps its words; an empty table gives no rows; other
columns are kept.  See passages.py for repeated and null ids.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame

from . import passages


class Automaton:
    """A suffix automaton of several sequences, which knows where each state's strings first ended.

    Ends are numbers, as many automata are large; the caller knows what they stand for.
    """

    def __init__(self):
        self.next: list[dict] = [{}]
        self.link = [-1]
        self.size = [0]
        self.first: list[int] = [0]
        self.last = 0

    def start(self) -> None:
        """Begins another sequence."""
        self.last = 0

    def _state(self, size: int, link: int, to: dict, first: int) -> int:
        self.next.append(to)
        self.link.append(link)
        self.size.append(size)
        self.first.append(first)
        return len(self.size) - 1

    def _split(self, p: int, word, q: int) -> int:
        """A copy of q for its strings that p's, lengthened by ``word``, can reach."""
        new = self._state(self.size[p] + 1, self.link[q], dict(self.next[q]), self.first[q])
        while p >= 0 and self.next[p].get(word) == q:
            self.next[p][word] = new
            p = self.link[p]
        self.link[q] = new
        return new

    def add(self, word, end: int) -> None:
        """Lengthens the sequence by a word that lies at ``end``."""
        p = self.last
        q = self.next[p].get(word)
        if q is not None:  # from an earlier sequence
            self.last = q if self.size[q] == self.size[p] + 1 else self._split(p, word, q)
            return
        new = self._state(self.size[p] + 1, 0, {}, end)
        while p >= 0 and word not in self.next[p]:
            self.next[p][word] = new
            p = self.link[p]
        if p >= 0:
            q = self.next[p][word]
            self.link[new] = q if self.size[q] == self.size[p] + 1 else self._split(p, word, q)
        self.last = new

    def statistics(self, words: list) -> Iterator[tuple[int, int]]:
        """For each word: the longest stretch ending there that the automaton holds, and the state it is in."""
        state, n = 0, 0
        for word in words:
            while state and word not in self.next[state]:
                state = self.link[state]
                n = self.size[state]
            to = self.next[state].get(word)
            if to is not None:
                state, n = to, n + 1
            yield n, state

    def shortest(self, state: int, least: int) -> int:
        """The state of the suffix of length ``least`` of a state's strings."""
        while self.size[self.link[state]] >= least:
            state = self.link[state]
        return state


def match(groups: Iterator[tuple], length: int) -> Iterator[tuple[int, int, int]]:
    """Spans (doc, place, size) of a shard's passages whose windows came earlier."""
    for docs, places, lefts, raw in groups:
        automaton, longest, origin = Automaton(), 2 * length, []
        for doc, place, left, text in zip(docs.tolist(), places.tolist(), lefts.tolist(), raw, strict=True):
            words, begin = text.split(), place - left
            found = None
            for i, (n, state) in enumerate(automaton.statistics(words)):
                if n < length:
                    continue
                # The first window with these words; it may be this very one, in an overlapping passage.
                sequence, word = divmod(automaton.first[automaton.shortest(state, length)], longest)
                if (origin[sequence][0], origin[sequence][1] + word) >= (doc, begin + i):
                    continue
                at = begin + i + 1 - length
                if found and at <= found[0] + found[1]:
                    found[1] = at + length - found[0]
                else:
                    if found:
                        yield doc, found[0], found[1]
                    found = [at, length]
            if found:
                yield doc, found[0], found[1]
            automaton.start()
            for i, word in enumerate(words):
                automaton.add(word, len(origin) * longest + i)
            origin.append((doc, begin))


def remove_substrings(documents: DataFrame, length: int = 20, grain: int = 6, limit: int = 2000, into: str = "removal") -> DataFrame:
    """Documents without the words of windows that came earlier; see ``passages.cut``."""
    return passages.cut(documents, length, grain, match, limit, into)
