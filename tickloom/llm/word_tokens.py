"""Ids of a tokenizer that never joins characters across white space, word by word with a bounded store of known words."""

from __future__ import annotations

import os
import re
from array import array
from typing import ClassVar

import numpy as np
from tokenizers import Tokenizer

from tickloom.llm.word_store import WordStore

MOST_WORDS = 300_000
os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # the tasks are the parallelism
# str.split() also parts words at these, which the tokenizers do not count as white space.
_ODD = re.compile(r"[\x1c-\x1f]")
# Letters that lower case and composition leave one letter each, then marks that no contraction begins with.
_PLAIN = re.compile(r"([A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+)([!-&(-/:-@\[-`{-~]*)")
# The letters that stand for bytes in byte-level vocabularies: printable Latin-1 for itself, the rest from 256 on.
_SHOWN = [*range(33, 127), *range(161, 173), *range(174, 256)]
_BYTE_LETTERS = {b: chr(b) for b in _SHOWN} | {b: chr(256 + k) for k, b in enumerate(b for b in range(256) if b not in _SHOWN)}
_SPACES = re.compile(r"[\x20\x09-\x0D]+")


class WordTokens:
    """Encodes whole texts; equal to the tokenizer on the whole text where white space always parts its tokens."""

    _made: ClassVar[dict[str, WordTokens]] = {}

    def __init__(self, path: str, most: int = MOST_WORDS):
        self.tokenizer = Tokenizer.from_file(path)
        self.most = most
        self.store = WordStore(self._words, most)
        # The short way is taken only if it gives what the tokenizer gives on samples of every kind of plain word.
        self.parts: dict[str, bytes] = {}
        self.plain = all(
            self._part(a.lower()) + (self._part(b) if b else b"") == array("I", self.tokenizer.encode(a + b, add_special_tokens=False).ids).tobytes()
            for a in ("a", "Word", "THE", "étÊ", "Straße", "unbelievableness") for b in ("", ".", "!!", "###", ",\"")
        )

    @classmethod
    def of(cls, path: str) -> WordTokens:
        """One per worker process and file."""
        if path not in cls._made:
            cls._made[path] = cls(path)
        return cls._made[path]

    def _words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Plain words go to the tokenizer's merges part by part, each distinct part once; all others through the whole tokenizer."""
        found: list[bytes | None] = []
        for word in words:
            plain = self.plain and _PLAIN.fullmatch(word)
            if plain:
                letters, marks = plain.groups()
                ids = self._part(letters.lower())
                found.append(ids + self._part(marks) if marks else ids)
            else:
                found.append(None)
        rest = [k for k, ids in enumerate(found) if ids is None]
        for k, encoded in zip(rest, self.tokenizer.encode_batch([words[k] for k in rest], add_special_tokens=False)):
            found[k] = array("I", encoded.ids).tobytes()
        return np.frombuffer(b"".join(found), np.uint32), np.fromiter(map(len, found), np.int64, len(found)) // 4

    def _part(self, text: str) -> bytes:
        ids = self.parts.get(text)
        if ids is None:
            if len(self.parts) >= self.most:
                self.parts.clear()
            mapped = text.encode().decode("latin-1").translate(_BYTE_LETTERS)
            ids = self.parts[text] = array("I", [t.id for t in self.tokenizer.model.tokenize(mapped)]).tobytes()
        return ids

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        return self.store.texts([list(filter(None, _SPACES.split(t))) if _ODD.search(t) else t.split() for t in texts])
