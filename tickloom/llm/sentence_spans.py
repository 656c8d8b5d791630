"""Substring dedup by sliding sentence spans: every run of consecutive sentences is hashed and joined globally."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.llm.common import no_shuffle_files, small_batches, written
from tickloom.llm.words import mix, text_slices, word_hashes, word_spans

# Least sentences and words of a run; a sentence of more words is parted; words to either side that a part's end is least of.
SENTENCES, MIN_WORDS, LONG_WORDS, REACH = 2, 24, 12, 3
_STOPS = np.zeros(256, bool)
_STOPS[list(b".!?")] = True
_WIDE = [b"\xe3\x80\x82", b"\xef\xbc\x81", b"\xef\xbc\x9f"]  # the full-width stops
_BASE = 0x9E3779B97F4A7C15 | 1
_LAST = (1 << 63) - 1


@dataclass
class Sentences:
    """The words and sentences of a slice of texts; ``first`` has a sentence's first word and, last, the number of words."""
    row: np.ndarray    # of every word
    start: np.ndarray  # first byte of every word
    hashes: np.ndarray
    first: np.ndarray

    @property
    def rows(self) -> np.ndarray:
        return self.row[self.first[:-1]]


def _wide_stops(data: np.ndarray) -> np.ndarray:
    """Bytes behind every full-width stop."""
    found = np.zeros(data.size, bool)
    for mark in _WIDE:
        if data.size >= 3:
            found[2:] |= (data[:-2] == mark[0]) & (data[1:-1] == mark[1]) & (data[2:] == mark[2])
    return np.flatnonzero(found) + 1


def sentences(data: np.ndarray, offsets: np.ndarray) -> Sentences:
    """The sentences of texts laid end to end.

    A sentence ends behind a word that ends in . ! or ? and before a line feed; full-width stops end words and sentences.
    A sentence of more than ``LONG_WORDS`` words is parted behind every word whose hash with its successor is the least
    among ``REACH`` neighbours to either side, so that a passage in its midst has whole parts in common with its copies.
    """
    row, start, end = word_spans(data, offsets)
    behind = _wide_stops(data)
    if behind.size:
        inner = behind[np.isin(behind, end, invert=True)]
        start, end = np.sort(np.append(start, inner)), np.sort(np.append(end, inner))
        row = np.searchsorted(offsets, start, "right") - 1
    hashes = word_hashes(data, start, end)
    if not start.size:
        return Sentences(row, start, hashes, np.zeros(1, np.int64))
    feeds = np.concatenate([[0], np.cumsum(data == 10)])
    closes = _STOPS[data[end - 1]]
    if behind.size:
        closes |= np.isin(end, behind)
    closes[:-1] |= (feeds[start[1:]] > feeds[end[:-1]]) | (row[1:] != row[:-1])
    closes[-1] = True
    last = np.flatnonzero(closes)
    sizes = np.diff(np.concatenate([[-1], last]))
    after = np.append(np.where(row[1:] == row[:-1], hashes[1:], np.uint64(0)), np.uint64(0))
    pair = mix(hashes ^ (after * np.uint64(0xD6E8FEB86659FD93)))
    least = np.ones(pair.size, bool)
    for k in range(1, REACH + 1):
        other = row[k:] != row[:-k]  # words of another text are no neighbours
        least[k:] &= (pair[k:] <= pair[:-k]) | other
        least[:-k] &= (pair[:-k] <= pair[k:]) | other
    closes |= least & np.repeat(sizes > LONG_WORDS, sizes)
    return Sentences(row, start, hashes, np.concatenate([[0], np.flatnonzero(closes) + 1]))


def runs(found: Sentences, count: int, min_words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``first sentence, behind the last, hash`` of the shortest runs with both minima from and up to every sentence.

    Every run that has both minima is covered by such runs within it, so whatever repeats is found whole.
    """
    first, rows = found.first, found.rows
    total = rows.size
    if not total:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    opens = np.searchsorted(rows, rows, "left")
    shuts = np.searchsorted(rows, rows, "right")
    at = np.arange(total)
    behind = np.maximum(at + count, np.searchsorted(first, first[:-1] + min_words, "left"))
    from_here = behind <= shuts
    before = np.minimum(at + 1 - count, np.searchsorted(first, first[1:] - min_words, "right") - 1)
    up_to = before >= opens
    pairs = np.unique(np.concatenate([at[from_here] * (total + 1) + behind[from_here], before[up_to] * (total + 1) + at[up_to] + 1]))
    a, b = pairs // (total + 1), pairs % (total + 1)
    powers = np.full(found.hashes.size, _BASE, np.uint64)
    powers[0] = 1
    up = np.cumprod(powers, dtype=np.uint64)
    powers[1:] = pow(_BASE, -1, 1 << 64)
    down = np.cumprod(powers, dtype=np.uint64)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(found.hashes * up, dtype=np.uint64)])
    return a, b, mix((sums[first[b]] - sums[first[a]]) * down[first[a]]).view(np.int64)


def cut(text: str, covered: list[tuple[int, int]]) -> tuple[str, int, str]:
    """The text without the covered sentences, how many went, and their code-point ranges ``start:end``.

    White space belongs to the sentence before it."""
    data = np.frombuffer(text.encode(), np.uint8)
    found = sentences(data, np.array([0, data.size]))
    gone = np.zeros(found.first.size, bool)
    for first, size in covered:
        gone[first:first + size] = True
    gone[-1] = False
    begins = np.append(found.start[found.first[:-1]], data.size)
    points = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    edges = np.flatnonzero(np.diff(np.concatenate([[0], gone.astype(np.int8)])))
    ranges = points[begins[edges]].reshape(-1, 2).tolist()
    kept, at = [], 0
    for a, b in ranges:
        kept.append(text[at:a])
        at = b
    kept.append(text[at:])
    return "".join(kept), int(gone.sum()), ",".join(f"{a}:{b}" for a, b in ranges)


def _hashed(docs: DataFrame, count: int, min_words: int, places: bool) -> DataFrame:
    """One row per run of sentences: ``key`` and, with ``places``, ``id, version, first, size``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, _, data, offsets in text_slices(batch.column("text")):
                found = sentences(data, offsets)
                a, b, key = runs(found, count, min_words)
                if not places:
                    yield pa.RecordBatch.from_arrays([pa.array(key)], ["key"])
                    continue
                rows = found.rows
                own = rows[a] if a.size else a
                taken = pa.array(own + at)
                begin = np.searchsorted(rows, own, "left")
                yield pa.RecordBatch.from_arrays(
                    [pa.array(key), batch.column("id").take(taken), batch.column("version").take(taken),
                     pa.array((a - begin).astype(np.int32)), pa.array((b - a).astype(np.int32))], ["key", "id", "version", "first", "size"])

    return docs.mapInArrow(run, "key long, id long, version long, first int, size int" if places else "key long")


def dedup_spans(docs: DataFrame, count: int = SENTENCES, min_words: int = MIN_WORDS) -> DataFrame:
    """``docs`` with ``text`` freed of repeated runs of sentences, plus ``n_removed`` and ``removed``.

    A run is at least ``count`` consecutive sentences with ``min_words`` words or more; white space in it does not matter.
    Of equal runs the one with the smallest doc_id, then the earliest, is the first and stays; all sentences of every
    other one go, also within one text. ``removed`` lists the code-point ranges that went. Null texts stay null and empty
    ones empty. A null doc_id sorts after all others. Rows with the same doc_id and text are one document and fare alike;
    rows with one doc_id and several texts are several documents, ordered by a hash of the text. Other columns pass
    through, but for earlier ones named ``n_removed`` or ``removed``, which go.

    Hashes are counted first and alone; the places of runs are looked up only for those that repeat.
    """
    spark = docs.sparkSession
    small_batches(spark)
    own = docs.select(*[c for c in docs.columns if c not in ("n_removed", "removed")])
    identity = [F.coalesce(F.col("doc_id").cast("long"), F.lit(_LAST)).alias("id"), F.xxhash64("text").alias("version")]
    texts = own.select(*identity, F.col("text").cast("string").alias("text"))
    place = F.struct("id", "version", "first")
    with no_shuffle_files(spark):
        often = written(_hashed(texts, count, min_words, False).groupBy("key").agg(F.count("*").alias("n")).filter("n > 1").select("key"))
        spans = written(_hashed(texts, count, min_words, True).join(often, "key"))
        # Written, so that the join below has its own exchange on either side and the parts of a very common run can be split.
        repeated = written(spans.groupBy("key").agg(F.min(place).alias("kept"), F.max(place).alias("last")).filter("kept <> last").select("key", "kept"))
        covered = written(spans.join(repeated, "key").filter(place != F.col("kept")).groupBy("id", "version").agg(
            F.collect_set(F.struct("first", "size")).alias("__covered")))

    @F.pandas_udf("text string, n_removed long, removed string")
    def removing(text: pd.Series, runs_: pd.Series) -> pd.DataFrame:
        out = [(t, 0, "") if t is None or c is None or len(c) == 0 else cut(t, [(r["first"], r["size"]) for r in c]) for t, c in zip(text, runs_)]
        return pd.DataFrame(out, columns=["text", "n_removed", "removed"])

    keyed = own.select(F.struct(*own.columns).alias("__doc"), identity[0].alias("id"), identity[1].alias("version"))
    result = keyed.join(covered, ["id", "version"], "left").select(
        "__doc", removing(F.col("__doc.text").cast("string"), "__covered").alias("__out"))
    return result.select(*[F.col("__out.text") if c == "text" else F.col(f"__doc.`{c}`") for c in own.columns], "__out.n_removed", "__out.removed")
