"""Generalised suffix automaton over sequences of numbers."""

from __future__ import annotations

from collections.abc import Iterable, Sequence


class SuffixAutomaton:
    """Recognises every run of consecutive symbols of the sequences added to it.

    `step` holds each state's transitions, `length` the longest run that ends in
    it and `link` the state of the longest run that ends there with fewer
    contexts.  Sequences can be added at any time; runs never cross from one
    sequence into the next.
    """

    def __init__(self) -> None:
        self.step: list[dict[int, int]] = [{}]
        self.length: list[int] = [0]
        self.link: list[int] = [-1]

    def __len__(self) -> int:
        return len(self.step)

    def _state(self, length: int, step: dict[int, int], link: int) -> int:
        self.step.append(step)
        self.length.append(length)
        self.link.append(link)
        return len(self.step) - 1

    def _split(self, p: int, symbol: int, q: int) -> int:
        """The state of runs of q no longer than p's plus the symbol, made from q if need be."""
        step, length, link = self.step, self.length, self.link
        if length[q] == length[p] + 1:
            return q
        twin = self._state(length[p] + 1, dict(step[q]), link[q])
        link[q] = twin
        while p >= 0 and step[p].get(symbol) == q:
            step[p][symbol] = twin
            p = link[p]
        return twin

    def add(self, sequence: Iterable[int]) -> list[int]:
        """Adds a sequence; the states after each of its symbols."""
        step, link = self.step, self.link
        last, states = 0, []
        for symbol in sequence:
            q = step[last].get(symbol)
            if q is not None:
                last = self._split(last, symbol, q)
            else:
                p, last = last, self._state(self.length[last] + 1, {}, 0)
                while p >= 0 and symbol not in step[p]:
                    step[p][symbol] = last
                    p = link[p]
                if p >= 0:
                    link[last] = self._split(p, symbol, step[p][symbol])
            states.append(last)
        # a later twin takes over shorter runs only, so each state still holds its whole prefix
        return states

    def ending(self, state: int, length: int) -> int:
        """The state of the last `length` symbols of a run that ends in `state`."""
        while self.length[self.link[state]] >= length if state else False:
            state = self.link[state]
        return state

    def matching(self, sequence: Sequence[int], keep: int) -> list[tuple[int, int, int]]:
        """(position, matched length, state) wherever the longest run that ends at a position has `keep` symbols or more."""
        step, length, link = self.step, self.length, self.link
        state = size = 0
        found = []
        for i, symbol in enumerate(sequence):
            to = step[state].get(symbol)
            while to is None and state:
                state = link[state]
                size = length[state]
                to = step[state].get(symbol)
            if to is not None:
                state = to
                size += 1
                if size >= keep:
                    found.append((i, size, state))
        return found
