"""A suffix automaton of a vocabulary: for each place of a text, the tokens that end there, longest first.

Its states are the classes of strings that end at the same places of the tokens; a state's link leads to the longest suffix of another class. It is built token by token, then laid
out flat: each state's outgoing bytes stand together, so a step is a search in a short stretch of bytes. Each state that spells a token, or has one among its suffixes, knows
where the next one is, so the tokens at a place are met without the states between.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterable


class SuffixAutomaton:
    def __init__(self, tokens: Iterable[tuple[bytes, int]]):
        """``tokens``: spellings, none of them empty, with their ids."""
        length, link, steps = [0], [-1], [{}]
        token: dict[int, int] = {}
        for spelled, i in tokens:
            at = 0
            for byte in spelled:
                at = self._grown(at, byte, length, link, steps)
            token[at] = i
        self.length, self.link = array("i", length), array("i", link)
        self.first, labels, self.target = array("i", [0]), bytearray(), array("i")
        for step in steps:
            labels += bytes(step.keys())
            self.target.extend(step.values())
            self.first.append(len(labels))
        self.labels = bytes(labels)
        self.token = array("i", [token.get(k, -1) for k in range(len(length))])
        self.below = array("i", [0]) * len(length)  # the longest proper suffix that is a token's state, 0 if none
        for k in sorted(range(1, len(length)), key=length.__getitem__):
            up = link[k]
            self.below[k] = up if self.token[up] >= 0 else self.below[up]

    @staticmethod
    def _grown(last: int, byte: int, length: list[int], link: list[int], steps: list[dict[int, int]]) -> int:
        """The state of ``last``'s string and one byte more, made if it isn't there."""

        def copied(source: int, size: int) -> int:
            length.append(size)
            link.append(link[source])
            steps.append(dict(steps[source]))
            return len(length) - 1

        def turned(at: int, old: int, new: int) -> None:
            while at >= 0 and steps[at].get(byte) == old:
                steps[at][byte] = new
                at = link[at]

        there = steps[last].get(byte)
        if there is not None:
            if length[there] == length[last] + 1:
                return there
            made = copied(there, length[last] + 1)
            link[there] = made
            turned(last, there, made)
            return made
        made = len(length)
        length.append(length[last] + 1)
        link.append(0)
        steps.append({})
        at = last
        while at >= 0 and byte not in steps[at]:
            steps[at][byte] = made
            at = link[at]
        if at >= 0:
            there = steps[at][byte]
            if length[there] == length[at] + 1:
                link[made] = there
            else:
                apart = copied(there, length[at] + 1)
                link[there] = link[made] = apart
                turned(at, there, apart)
        return made

    def ends(self, data: bytes) -> list[list[int]]:
        """For each byte of ``data`` the tokens that end with it, longest first."""
        first, labels, target, link, length, token, below = self.first, self.labels, self.target, self.link, self.length, self.token, self.below
        out, at, matched = [], 0, 0
        for byte in data:
            while (k := labels.find(byte, first[at], first[at + 1])) < 0 and at:
                at = link[at]
                matched = length[at]
            if k >= 0:
                at = target[k]
                matched += 1
            else:
                matched = 0
            # a state whose longest string is more than what matched spells no token here; its suffixes do
            here = at if length[at] == matched and token[at] >= 0 else below[at]
            found = []
            while here:
                found.append(token[here])
                here = below[here]
            out.append(found)
        return out
