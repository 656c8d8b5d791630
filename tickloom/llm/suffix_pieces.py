"""SentencePiece encoding and decoding by suffix-array matching.

A batch's distinct words are concatenated into one text of code points and its suffixes are sorted. A binary search per
piece gives the range of suffixes that begin with it, which are the piece's occurrences; every occurrence is an edge from
its first to its last position. Sorted by position, the edges are relaxed from left to right: a position's last piece is
the one whose predecessor it may follow, that is with which the merges of the vocabulary would part the two there.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from typing import ClassVar

import numpy as np
import pandas as pd
import pyarrow as pa
import sentencepiece
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.llm.common import small_batches
from tickloom.llm.word_store import WordStore, ranges
from tickloom.llm.words import mix

MARK = "▁"
MOST_WORDS, TEXTS, _SLOT_BITS = 300_000, 1000, 21
FEW, STRETCH = 64, 1 << 16  # words that are still relaxed together; positions of a long word whose pairs are judged at once


class Pieces:
    """The vocabulary of a SentencePiece BPE model with byte fallback, and a bounded store of encoded words."""

    _made: ClassVar[dict[str, Pieces]] = {}

    def __init__(self, path: str):
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        count = model.get_piece_size()
        special = [model.is_control(k) or model.is_unknown(k) or model.is_byte(k) or model.is_unused(k) for k in range(count)]
        self.texts = [model.id_to_piece(k) for k in range(count)]
        self.bytes = {int(self.texts[k][3:5], 16): k for k in range(count) if model.is_byte(k)}
        self.unknown = model.unk_id()
        self.rank = {self.texts[k]: (-model.get_score(k), k) for k in range(count) if not special[k]}
        if any(MARK in p[1:] and set(p) != {MARK} for p in self.rank):
            raise ValueError("a piece crosses a word's beginning")
        self.width = max(map(len, self.rank))
        self.searched = list(self.rank)
        self.ids = np.array([self.rank[p][1] for p in self.searched], np.int64)
        self.lengths = np.array([len(p) for p in self.searched], np.int64)
        self.codes = np.zeros((len(self.searched), self.width), np.int64)
        for k, p in enumerate(self.searched):
            self.codes[k, :len(p)] = [ord(c) for c in p]
        shown = [bytes([int(t[3:5], 16)]) if model.is_byte(k) else b"" if model.is_control(k) else t.replace(MARK, " ").encode() for k, t in enumerate(self.texts)]
        self.shown = np.frombuffer(b"".join(shown), np.uint8)
        self.shown_starts = np.concatenate([[0], np.cumsum(list(map(len, shown)))])
        self.single = np.sort(np.array([ord(p) for p in self.rank if len(p) == 1], np.int64))
        # Marks and what follows them up to the next mark, parted at line ends and tabs that are no pieces: nothing merges across.
        apart = "".join(c for c in "\n\r\t" if not any(c in p for p in self.rank))
        self.runs = re.compile(f"{MARK}+[^{MARK}{apart}]*|[^{MARK}{apart}]+" + (f"|[{apart}]" if apart else ""))
        self._grow_trees()
        # The verdicts used last, by a hash of the pair.
        self.slot_keys, self.slot_values = np.full(1 << _SLOT_BITS, -1), np.zeros(1 << _SLOT_BITS, bool)
        self.store = WordStore(self.learn, MOST_WORDS)

    @classmethod
    def of(cls, path: str) -> Pieces:
        if path not in cls._made:
            cls._made[path] = cls(path)
        return cls._made[path]

    def _grow_trees(self) -> None:
        """How the merges make every piece: what stands at its left and right edge, and until when.

        ``left_edge[id]`` lists the pieces that begin the piece while it is being made, from its first character to
        itself, and ``left_until`` the time of the merge that ends each (never, for the piece itself); so do ``right_edge``
        and ``right_until`` for its end. Time is the rank of a merge, the best score first. A piece that its own merges do
        not end in is not ``made``.
        """
        order = sorted(self.rank, key=self.rank.get)
        count, never = len(self.texts), len(order)
        time = np.full(count, never)
        for k, piece in enumerate(order):
            time[self.rank[piece][1]] = k if len(piece) > 1 else -1
        splits = [(self.rank[p[:k]][1], self.rank[p[k:]][1], self.rank[p][1]) for p in order for k in range(1, len(p)) if p[:k] in self.rank and p[k:] in self.rank]
        left, right, whole = np.array(splits, np.int64).reshape(-1, 3).T
        keys = left << 32 | right
        by_key = np.argsort(keys)
        self.pair_keys, self.pair_times = keys[by_key], time[whole[by_key]]
        self.never = never
        depth = self.width + 1
        self.left_edge, self.right_edge = np.zeros((count, depth), np.int64), np.zeros((count, depth), np.int64)
        self.left_until, self.right_until = np.full((count, depth), never), np.full((count, depth), never)
        self.made = np.zeros(count, bool)
        own = np.fromiter((self.rank[p][1] for p in order), np.int64, never)
        single = own[np.fromiter(map(len, order), np.int64, never) == 1]
        self.made[single] = True
        self.left_edge[single, 0] = self.right_edge[single, 0] = single
        size, born = np.fromiter(map(len, self.texts), np.int64, count), np.full(count, -1)
        for n in range(2, self.width + 1):
            of = np.flatnonzero((size[whole] == n) & self.made[left] & self.made[right])
            of = of[self._apart(left[of], right[of], False)]
            made, x, y = whole[of], left[of], right[of]
            self.made[made] = True
            born[made] = np.maximum(time[made], np.maximum(born[x], born[y]))
            for edge, until, part in ((self.left_edge, self.left_until, x), (self.right_edge, self.right_until, y)):
                top = (until[part] < never).sum(axis=1)
                edge[made], until[made] = edge[part], until[part]
                until[made, top] = born[made]
                edge[made, top + 1] = made

    def _apart(self, left: np.ndarray, right: np.ndarray, whole: bool) -> np.ndarray:
        """Whether no merge crosses the border between two made pieces while both are being made, and, with ``whole``, none
        after that. Pieces that meet there are gone through in time: of two merges at one time the left one comes first."""
        i, j = np.zeros(left.size, np.int64), np.zeros(left.size, np.int64)
        apart = np.ones(left.size, bool)
        open_ = np.arange(left.size)
        while open_.size:
            a, b, p, q = left[open_], right[open_], i[open_], j[open_]
            until_a, until_b = self.right_until[a, p], self.left_until[b, q]
            key = self.right_edge[a, p] << 32 | self.left_edge[b, q]
            at = np.minimum(np.searchsorted(self.pair_keys, key), self.pair_keys.size - 1)
            merge = np.where(self.pair_keys[at] == key, self.pair_times[at], self.never)
            done = (until_a == self.never) & (until_b == self.never)
            crossed = (merge < until_a) & (merge <= until_b) & (merge < self.never)
            if not whole:
                crossed &= ~done
            apart[open_[crossed]] = False
            step = until_a <= until_b
            i[open_] += step
            j[open_] += ~step
            open_ = open_[~(done | crossed)]
        return apart

    def follows(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Whether the merges, given the text of two made pieces, end in just these two."""
        keys = (left.astype(np.int64) << 32) | right.astype(np.int64)
        slots = (mix(keys.view(np.uint64)) >> np.uint64(64 - _SLOT_BITS)).astype(np.int64)
        out = self.slot_values[slots]
        missing = np.flatnonzero(self.slot_keys[slots] != keys)
        if missing.size:
            new, place = np.unique(keys[missing], return_inverse=True)
            found = self._apart(new >> 32, new & 0xFFFFFFFF, True)
            out[missing] = found[place]
            at = (mix(new.view(np.uint64)) >> np.uint64(64 - _SLOT_BITS)).astype(np.int64)
            self.slot_keys[at], self.slot_values[at] = new, found
            if np.unique(at).size < at.size:  # of pairs with one slot the last key stays, and so must its value
                last = dict(zip(at.tolist(), found.tolist()))
                self.slot_values[list(last)] = list(last.values())
        return out

    def _relax_rest(self, begin: int, after: int, length: int, edges: tuple[np.ndarray, ...], spelled: np.ndarray, state: tuple[np.ndarray, ...]) -> None:
        """Relaxes the positions behind the first ``after`` of one very long word, in the order of its edges' ends.

        A stretch at a time, all pairs of pieces that meet in it are judged at once; what is left for each edge is a look-up."""
        back, last, fresh = (x[begin:begin + length + 1].tolist() for x in state)
        start, end, ids = edges
        plain = spelled[begin:begin + length].tolist()
        for low in range(after, length, STRETCH):
            high = min(length, low + STRETCH)
            a, b = np.searchsorted(end, [begin + low, begin + high], "right")
            first, behind = np.searchsorted(end, start[a:b], "left"), np.searchsorted(end, start[a:b], "right")
            first[start[a:b] == begin] = behind[start[a:b] == begin]
            sizes = behind - first
            left = ids[np.repeat(first - (np.cumsum(sizes) - sizes), sizes) + np.arange(int(sizes.sum()))]
            meet = np.unique(left << 32 | np.repeat(ids[a:b], sizes))
            verdicts = dict(zip(meet.tolist(), self._apart(meet >> 32, meet & 0xFFFFFFFF, True).tolist()))
            starts, ends, own = (start[a:b] - begin).tolist(), (end[a:b] - begin).tolist(), ids[a:b].tolist()
            k = 0
            for r in range(low + 1, high + 1):
                while k < len(ends) and ends[k] == r:
                    at = starts[k]
                    if fresh[at] or (back[at] >= 0 and verdicts[last[at] << 32 | own[k]]):
                        back[r], last[r] = at + begin, own[k]
                    k += 1
                if back[r] < 0 and not plain[r - 1]:
                    fresh[r] = True
        for x, values in zip(state, (back, last, fresh)):
            x[begin:begin + length + 1] = values

    def edges(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start, end and id of every occurrence of every piece in ``codes``, sorted by end and then by start."""
        order = _suffixes(codes, self.width)
        low, high = np.zeros(self.ids.size, np.int64), np.full(self.ids.size, codes.size)
        group = np.zeros(codes.size, np.int64)  # suffixes in order that share their first d characters
        own = np.zeros(self.ids.size, np.int64)  # the group that a piece's first d characters are, where there is one
        padded = np.append(codes, np.zeros(self.width, np.int64))
        for d in range(self.width):
            key = (group << 21) | padded[order + d]
            live = np.flatnonzero((self.lengths > d) & (high > low))
            wanted = (own[live] << 21) | self.codes[live, d]
            low[live], high[live] = np.searchsorted(key, wanted, "left"), np.searchsorted(key, wanted, "right")
            group = np.concatenate([[0], np.cumsum(key[1:] != key[:-1])]) if key.size else key
            own[live] = group[np.minimum(low[live], max(0, codes.size - 1))]
        found = np.maximum(high - low, 0)
        some = np.flatnonzero(found)
        which = np.repeat(some, found[some])
        start = order[np.repeat(low[some] - (np.cumsum(found[some]) - found[some]), found[some]) + np.arange(which.size)]
        end = start + self.lengths[which]
        by_place = np.argsort(end * (self.width + 1) - self.lengths[which])
        return start[by_place], end[by_place], self.ids[which][by_place]

    def learn(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids and sizes of distinct words, each a run of marks and then characters without one.

        All words are relaxed together, one position of every word after the other, until few are left; these go on one by
        one. Characters that are no piece by themselves part a word, as nothing merges with them; the encoding starts anew
        behind them.
        """
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        text = np.frombuffer("".join(w + "\0" for w in words).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
        begin = np.concatenate([[0], np.cumsum(lengths + 1)])[:-1]
        start, end, ids = self.edges(text)
        start, end, ids = (x[self.made[ids]] for x in (start, end, ids))
        depth = end - begin[np.searchsorted(begin, start, "right") - 1]
        longest = int(lengths.max(initial=0))
        by_length = np.argsort(lengths, kind="stable")
        ordered = lengths[by_length]
        together = min(longest, max(FEW, int(ordered[-FEW - 1]) if ordered.size > FEW else 0))
        early = np.flatnonzero(depth <= together)
        early = early[np.argsort(depth[early].astype(np.int16 if together < 1 << 15 else np.int64), kind="stable")]
        spelled = self.single[np.minimum(np.searchsorted(self.single, text), self.single.size - 1)] == text
        last, back = np.full(text.size + 1, -1), np.full(text.size + 1, -1)
        fresh = np.zeros(text.size + 1, bool)
        fresh[begin] = True
        cuts = np.searchsorted(depth[early], np.arange(1, together + 2))
        first_start, first_end, first_ids = start[early], end[early], ids[early]
        for r in range(1, together + 1):
            s, e, i = (x[cuts[r - 1]:cuts[r]] for x in (first_start, first_end, first_ids))
            good = fresh[s].copy()
            inner = np.flatnonzero(~good & (back[s] >= 0))
            if inner.size:
                good[inner] = self.follows(last[s[inner]], i[inner])
            back[e[good]], last[e[good]] = s[good], i[good]
            ends = begin[by_length[np.searchsorted(ordered, r):]] + r
            fresh[ends[(back[ends] < 0) & ~spelled[ends - 1]]] = True
        long = by_length[np.searchsorted(ordered, together, "right"):]
        for w in long.tolist():
            a, b = np.searchsorted(end, [begin[w], begin[w] + lengths[w]], "right")
            self._relax_rest(int(begin[w]), together, int(lengths[w]), (start[a:b], end[a:b], ids[a:b]), spelled, (back, last, fresh))
        # From the ends of all words back to their beginnings, one piece or unknown character of each at a time.
        turns: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for w in long.tolist():
            path = self._traced(int(begin[w]), int(lengths[w]), text, back, last)
            turns.append((np.full(path.size, w), path, np.arange(path.size)))
        short = by_length[:by_length.size - long.size]
        at, word, turn = begin[short] + lengths[short], short, 0
        at, word = at[at > begin[word]], word[at > begin[word]]
        while word.size:
            step = back[at] >= 0
            turns.append((word, np.where(step, last[at], -1 - text[at - 1]), np.full(word.size, turn)))
            at = np.where(step, back[at], at - 1)
            open_ = at > begin[word]
            at, word, turn = at[open_], word[open_], turn + 1
        owner, found, turn_ = (np.concatenate(x) for x in zip(*turns)) if turns else (np.zeros(0, np.int64),) * 3
        order = np.argsort(owner * (int(turn_.max(initial=0)) + 1) - turn_)
        owner, found = owner[order], found[order]
        return self._spelled_out(found, owner, len(words))

    def _traced(self, begin: int, length: int, text: np.ndarray, back: np.ndarray, last: np.ndarray) -> np.ndarray:
        """The pieces (or unknown characters, below zero) of one long word, from its end to its beginning."""
        own_back, own_last, chars = (x[begin:begin + length + 1].tolist() for x in (back, last, text))
        out, at = [], length
        while at:
            if own_back[at] >= 0:
                out.append(own_last[at])
                at = own_back[at] - begin
            else:
                out.append(-1 - chars[at - 1])
                at -= 1
        return np.array(out, np.int64)

    def _spelled_out(self, found: np.ndarray, owner: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and sizes of words, with unknown characters (below zero) as their bytes."""
        odd = np.flatnonzero(found < 0)
        characters, which = np.unique(-1 - found[odd], return_inverse=True)
        spelled = [[self.bytes.get(b, self.unknown) for b in chr(c).encode("utf-8", "surrogatepass")] if self.bytes else [self.unknown] for c in characters.tolist()]
        starts = np.concatenate([[0], np.cumsum(list(map(len, spelled)))]).astype(np.int64)
        sizes = np.ones(found.size, np.int64)
        sizes[odd] = np.diff(starts)[which]
        places = np.concatenate([[0], np.cumsum(sizes)])
        out = np.empty(int(places[-1]), np.uint32)
        known = found >= 0
        out[places[:-1][known]] = found[known]
        if odd.size:
            out[ranges(places, odd)] = np.array([x for own in spelled for x in own])[ranges(starts, which)]
        return out, np.bincount(np.repeat(owner, sizes), minlength=words)

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        return self.store.texts([self.runs.findall(MARK + t.replace(" ", MARK)) if t else [] for t in texts])

    def decode(self, ids: np.ndarray) -> str:
        raw = self.shown[ranges(self.shown_starts, np.asarray(ids, np.int64))].tobytes().decode("utf-8", "replace")
        return raw[1:] if raw.startswith(" ") else raw


def _suffixes(codes: np.ndarray, width: int) -> np.ndarray:
    """Suffixes in the order of their first ``width`` characters or more: as many as fit into a number at once, then doubling."""
    there = np.zeros(int(codes.max(initial=0)) + 1, np.int64)
    there[codes] = 1
    rank = np.cumsum(there)[codes]  # 1 .. size of the alphabet; 0 stands behind the end
    bits = int(rank.max(initial=1)).bit_length()
    step = min(width, 62 // bits)
    key = np.zeros_like(rank)
    for k in range(step):
        key <<= bits
        key[:max(0, rank.size - k)] |= rank[k:]
    while step < width:
        _, rank = np.unique(key, return_inverse=True)
        after = np.zeros_like(rank)
        after[:max(0, rank.size - step)] = rank[step:] + 1
        key, step = rank * (rank.size + 1) + after, 2 * step
    return np.argsort(key)


def encode_documents(docs: DataFrame, model: str) -> DataFrame:
    """``doc_id, text, ids, n_ids, ids_crc32`` of every whole text.

    A null or empty text has no ids; characters outside the vocabulary become byte pieces. Each row is encoded by itself,
    so repeated rows and null ids need no care; further columns are ignored.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = Pieces.of(model)
        for batch in batches:
            for at in range(0, batch.num_rows, TEXTS):
                part = batch.slice(at, TEXTS)
                ids = pieces.encode([t or "" for t in part.column("text").to_pylist()])
                flat = np.concatenate(ids).astype(np.int32)
                cuts = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32)
                crc = [zlib.crc32(flat[a:b].astype("<u4").tobytes()) for a, b in zip(cuts, cuts[1:])]
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, pa.ListArray.from_arrays(pa.array(cuts), pa.array(flat)), pa.array(np.diff(cuts).astype(np.int64)), pa.array(crc, pa.int64())],
                    ["doc_id", "text", "ids", "n_ids", "ids_crc32"])

    small_batches(docs.sparkSession)
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return own.mapInArrow(run, "doc_id long, text string, ids array<int>, n_ids long, ids_crc32 long")


def decode_ids(ids: str, model: str) -> Column:
    """The text of a column of ids; null for null. The mark is a space, and the one that encoding puts first goes."""
    @F.pandas_udf("string")
    def decode(column: pd.Series) -> pd.Series:
        pieces = Pieces.of(model)
        return pd.Series([None if x is None else pieces.decode(x) for x in column], dtype=object)

    return decode(F.col(ids))
