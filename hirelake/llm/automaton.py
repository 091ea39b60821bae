"""A suffix automaton over words, with the first place of every substring."""

from __future__ import annotations

from collections.abc import Hashable, Iterator, Sequence


class SuffixAutomaton:
    """Substrings of the sequences added so far; add them in the order that decides what is first."""

    def __init__(self) -> None:
        self._next: list[dict[Hashable, int]] = [{}]
        self._link = [-1]
        self._length = [0]
        self._first = [-1]
        self._places: list[tuple[int, int]] = []

    def __len__(self) -> int:
        return len(self._places)

    def _state(self, edges: dict, link: int, length: int, first: int) -> int:
        self._next.append(edges)
        self._link.append(link)
        self._length.append(length)
        self._first.append(first)
        return len(self._link) - 1

    def _split(self, before: int, symbol: Hashable, state: int) -> int:
        """A state of its own for the shorter strings of `state` that end here."""
        copy = self._state(dict(self._next[state]), self._link[state], self._length[before] + 1, self._first[state])
        self._link[state] = copy
        while before >= 0 and self._next[before].get(symbol) == state:
            self._next[before][symbol] = copy
            before = self._link[before]
        return copy

    def add(self, symbols: Sequence[Hashable], key: int, start: int) -> None:
        """Add a sequence that stands at word `start` of document `key`."""
        last, edges, link, length = 0, self._next, self._link, self._length
        for offset, symbol in enumerate(symbols):
            place = len(self._places)
            self._places.append((key, start + offset))
            known = edges[last].get(symbol)
            if known is not None:
                last = known if length[known] == length[last] + 1 else self._split(last, symbol, known)
                continue
            new = self._state({}, 0, length[last] + 1, place)
            before = last
            while before >= 0 and symbol not in edges[before]:
                edges[before][symbol] = new
                before = link[before]
            if before >= 0:
                known = edges[before][symbol]
                fits = length[known] == length[before] + 1
                link[new] = known if fits else self._split(before, symbol, known)
            last = new

    def first_places(self, symbols: Sequence[Hashable], window: int) -> Iterator[tuple[int, tuple[int, int]]]:
        """(start in `symbols`, first (key, start) in the automaton) of every window found in it.

        The state follows the longest suffix found so far, cut to what the window needs.
        """
        edges, link, length, first, places = self._next, self._link, self._length, self._first, self._places
        state = matched = 0
        for end, symbol in enumerate(symbols):
            while state and symbol not in edges[state]:
                state = link[state]
                matched = length[state]
            step = edges[state].get(symbol)
            if step is None:
                continue
            state = step
            matched += 1
            while length[link[state]] >= window:
                state = link[state]
                matched = length[state]
            if matched >= window:
                key, last = places[first[state]]
                yield end - window + 1, (key, last - window + 1)
