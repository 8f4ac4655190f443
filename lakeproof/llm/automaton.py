"""Minimised acceptors of word lists, and their composition with a one-edit transducer."""

from __future__ import annotations

from collections.abc import Iterator


class Acceptors:
    """Minimised acyclic acceptors over one set of states; the words of one acceptor have one length.

    State 0 accepts the empty word and has no transitions. ``edges[state]`` are transitions in order of their symbols, and
    ``size[state]`` is the number of words accepted from a state.
    """

    def __init__(self) -> None:
        self.edges: list[dict[str, int]] = [{}]
        self.size = [1]
        self._known: dict[tuple, int] = {}
        self._common: dict[tuple[int, int], list[str]] = {}

    def _state(self, edges: dict[str, int]) -> int:
        key = tuple(edges.items())
        state = self._known.get(key)
        if state is None:
            state = self._known[key] = len(self.edges)
            self.edges.append(edges)
            self.size.append(sum(self.size[s] for s in edges.values()))
        return state

    def add(self, words: list[str]) -> int:
        """The first state of the acceptor of distinct words of one length, given in order."""
        length = len(words[0])
        open_: list[dict[str, int]] = [{} for _ in range(length)]
        last = words[0]
        for word in words[1:]:
            same = 0
            while word[same] == last[same]:
                same += 1
            self._close(open_, last, same)
            last = word
        self._close(open_, last, -1)
        return self._state(open_[0]) if length else 0

    def _close(self, open_: list[dict[str, int]], word: str, down_to: int) -> None:
        """Fix the states below a depth: a word that differs there comes next, so they get no more transitions."""
        state = 0
        for depth in range(len(word) - 1, down_to, -1):
            open_[depth][word[depth]] = state
            if depth:
                state = self._state(open_[depth])
                open_[depth] = {}
        if down_to >= 0:
            open_[down_to][word[down_to]] = state

    def common(self, a: int, b: int) -> list[str]:
        """The words accepted from both of two states."""
        found = self._common.get((a, b))
        if found is not None:
            return found
        first, chain = (a, b), []
        while True:
            if not a or not b:
                found = ["".join(chain)] if a == b else []
                break
            left, right = self.edges[a], self.edges[b]
            shared = left.keys() & right.keys()
            if len(shared) != 1:
                lead = "".join(chain)
                found = [lead + c + rest for c in shared for rest in self.common(left[c], right[c])]
                break
            (c,) = shared
            chain.append(c)
            a, b = left[c], right[c]
        self._common[first] = found
        return found


def one_edit_pairs(words: list[str], longer: list[str], at_end: bool) -> Iterator[tuple[str, str]]:
    """The accepted pairs of acceptor o one-edit transducer o acceptor, each once.

    ``words`` are distinct and of one length, ``longer`` by one symbol longer; both are in order. Pairs are two of ``words``
    that differ by one replaced symbol, or one of ``words`` and one of ``longer`` with one symbol put in. The edit stands where the two
    first differ. Without ``at_end``, symbols are not put in behind the last one.

    A state of the composition is a pair of states and whether the edit was made. Before it, both sides have read the same
    prefix; after it, they must go on alike, so the rest is the common language of the two states.
    """
    acceptors = Acceptors()
    length = len(words[0])
    start = acceptors.add(words)
    other = acceptors.add(longer) if longer else -1
    edges, size, common = acceptors.edges, acceptors.size, acceptors.common
    stack = [(start, other, 0, 0)]  # state of words, state of longer (-1: none), symbols read, words before this state's
    while stack:
        p, q, depth, before = stack.pop()
        mine = edges[p]
        prefix = None
        if len(mine) > 1:
            prefix = words[before][:depth]
            symbols = list(mine)
            for k, c in enumerate(symbols):
                for d in symbols[k + 1 :]:
                    for rest in common(mine[c], mine[d]):
                        yield prefix + c + rest, prefix + d + rest
        theirs = edges[q] if q >= 0 else {}
        for d, state in theirs.items():
            if not mine:
                if at_end and not state:
                    yield words[before], words[before] + d
                continue
            onward = edges[state]
            for c, following in mine.items():
                # if the rest began with the new symbol, the two would differ further on only
                if c != d and c in onward:
                    for rest in common(following, onward[c]):
                        prefix = words[before][:depth] if prefix is None else prefix
                        yield prefix + c + rest, prefix + d + c + rest
        if depth + 1 < length or (at_end and theirs):
            for c, following in mine.items():
                state = theirs.get(c, -1)
                if size[following] > 1 or state >= 0:
                    stack.append((following, state, depth + 1, before))
                before += size[following]
