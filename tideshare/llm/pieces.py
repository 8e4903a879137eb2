"""Cutting text where a byte-level tokenizer cuts it anyway.

One white-space character between two others always starts a pre-token: no alternative of the
pattern crosses it from the left and none looks behind. Pieces cut there can be encoded apart.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

#: Pieces that a Python worker remembers in its newer and in its older half.
REMEMBERED = 100_000

WHITE = r"\s\x85\xa0"
JOINT = re.compile(r"(?<=[^" + WHITE + r"])(?=[ \n][^" + WHITE + r"])")


def pieces(text: str) -> list[str]:
    """The text in pieces; each but the first starts with one space or line feed."""
    return JOINT.split(text) if text else []


class Memory:
    """Results of pieces. When the newer half is full it becomes the older; what is used returns."""

    def __init__(self, learn: Callable[[list[str]], list]):
        self.learn, self.new, self.old = learn, {}, {}

    def results(self, texts: list[str], most: int = 1 << 20) -> Iterator[list]:
        """The result of each piece of each text, text by text.

        ``learn`` gets unknown pieces, about ``most`` characters at a time, so that a batch is
        bounded by its bytes and not by its rows. Equal pieces of a batch are one object.
        """
        same: dict[str, str] = {}
        cut = [list(map(same.setdefault, p, p)) for p in map(pieces, texts)]
        unknown, size = [], 0
        for p in same.keys() - self.new.keys():
            if (r := self.old.get(p)) is not None:
                self.new[p] = r
                continue
            unknown.append(p)
            size += len(p)
            if size >= most:
                self.new.update(zip(unknown, self.learn(unknown), strict=True))
                unknown, size = [], 0
        if unknown:
            self.new.update(zip(unknown, self.learn(unknown), strict=True))
        found = self.new
        if len(found) > REMEMBERED:
            self.old, self.new = found, {}
        for c in cut:
            yield list(map(found.__getitem__, c))
