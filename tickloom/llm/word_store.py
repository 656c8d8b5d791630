"""A bounded store of encoded words: each distinct word is encoded once, texts are put together from the store."""

from __future__ import annotations

from collections.abc import Callable
from itertools import chain

import numpy as np


AT_ONCE = 40_000  # words are learned in steps, which bounds the arrays of one


def ranges(starts: np.ndarray, chosen: np.ndarray) -> np.ndarray:
    """Positions of the chosen ranges of a flat array, one range after the other."""
    sizes = starts[chosen + 1] - starts[chosen]
    ends = np.cumsum(sizes)
    shift = np.repeat(starts[chosen] - (ends - sizes), sizes)
    return shift + np.arange(shift.size)


class _Numbers(dict):
    """Numbers of words; a word that is asked for the first time gets the next one and is noted."""

    def __init__(self, words: list[str]):
        super().__init__(zip(words, range(len(words))))
        self.fresh: list[str] = []

    def __missing__(self, word: str) -> int:
        self.fresh.append(word)
        number = self[word] = len(self)
        return number


class WordStore:
    """Ids of words by a function that encodes many distinct words at once into flat ids and their sizes.

    A store of more than ``most`` words keeps only those that came more than once since it was last full, half of ``most``
    at most, before it takes on more texts. That costs time, not results.
    """

    def __init__(self, encode: Callable[[list[str]], tuple[np.ndarray, np.ndarray]], most: int):
        self.encode, self.most = encode, most
        self.known = _Numbers([])
        self.words: list[str] = []
        self.starts, self.ids, self.uses = np.zeros(1, np.int64), np.zeros(0, np.uint32), np.zeros(0, np.int64)

    def _keep(self, chosen: np.ndarray) -> None:
        self.words = [self.words[k] for k in chosen.tolist()]
        self.known = _Numbers(self.words)
        self.ids = self.ids[ranges(self.starts, chosen)]
        self.starts = np.concatenate([[0], np.cumsum(self.starts[chosen + 1] - self.starts[chosen])])
        self.uses = np.zeros(chosen.size, np.int64)

    def _learn(self, words: list[str]) -> None:
        made = [self.encode(words[k:k + AT_ONCE]) for k in range(0, len(words), AT_ONCE)]
        ids, sizes = (np.concatenate(x) for x in zip(*made))
        self.words += words
        self.starts = np.concatenate([self.starts, self.starts[-1] + np.cumsum(sizes)])
        self.ids = np.concatenate([self.ids, ids])
        self.uses = np.concatenate([self.uses, np.zeros(len(words), np.int64)])

    def texts(self, parts: list[list[str]]) -> list[np.ndarray]:
        """The ids of every text, given as its words."""
        words = list(chain.from_iterable(parts))
        if len(self.words) > self.most:
            often = np.flatnonzero(self.uses > 1)
            if often.size > self.most // 2:
                often = often[np.argsort(-self.uses[often], kind="stable")[:self.most // 2]]
            self._keep(often)
        index = np.fromiter(map(self.known.__getitem__, words), np.int64, len(words))
        if self.known.fresh:
            self._learn(self.known.fresh)
            self.known.fresh = []
        self.uses += np.bincount(index, minlength=self.uses.size)
        ids = self.ids[ranges(self.starts, index)]
        ends = np.cumsum(self.starts[index + 1] - self.starts[index])
        counts = np.cumsum(list(map(len, parts)))
        return np.split(ids, np.concatenate([[0], ends])[counts][:-1]) if parts else []
