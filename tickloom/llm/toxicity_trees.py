"""Toxicity: gradient-boosted trees over dense text features, with isotonic calibration."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.llm.common import small_batches, written
from tickloom.llm.labelled import sample, verdict
from tickloom.llm.words import text_slices, word_hashes, word_spans

FOLDS, HELD, LABELLED = 5, 0, 24000
TREES, TREE_DEPTH, NEAR, LEARNED_WORDS, LEARNED_DOCS = 20, 3, 6, 512, 6
# Words are also known by their first bytes, as insults are inflected and compounded.
PREFIXES = (4, 5, 6, 8)

# Plain insults that count without labels; the labelled sample adds the words that mark its toxic rows.
INSULTS = ("idiot moron stupid dumb loser scum trash garbage pathetic worthless disgusting clown fool jerk imbecile filth vermin creep "
           "dummkopf trottel abschaum versager crétin imbécile débile ordure estúpido imbécil basura escoria").split()
SECOND_PERSON = ("you your yours yourself youre ur du dich dir dein deine euch euer tu te toi ton ta tes vous votre vos "
                 "tú ti tus usted ustedes vosotros").split()

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_LETTER = np.zeros(256, bool)
_LETTER[97:123] = True
_LETTER[128:] = True
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
# Signs that stand for letters in obfuscated words.
_LEET = _LOWER.copy()
for _sign, _plain in zip(b"013457@$!|", b"oieastasil"):
    _LEET[_sign] = _plain
FEATURES = ("insults", "insult_share", "learned", "learned_share", "hidden", "near_you", "you_share", "capitals", "loud_words", "exclaims",
            "punctuation", "signs", "words")


def _letters(data: np.ndarray, offsets: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Only mapped letters and white space; the offsets that go with them."""
    mapped = table[data]
    keep = _LETTER[mapped] | _SPACE[mapped]
    return mapped[keep], np.concatenate([[0], np.cumsum(keep)])[offsets]


def names(words: Sequence[str | bytes]) -> np.ndarray:
    """Hashes of plain words as ``word_hashes`` gives them for the same letters in a text."""
    out = []
    for w in words:
        data = np.frombuffer(w.encode() if isinstance(w, str) else bytes(w), np.uint8)
        out.append(word_hashes(data, np.zeros(1, np.int64), np.array([data.size]))[0])
    return np.unique(np.array(out, np.uint64))


def _member(values: np.ndarray, ordered: np.ndarray) -> np.ndarray:
    if not ordered.size:
        return np.zeros(values.size, bool)
    return ordered[np.minimum(np.searchsorted(ordered, values), ordered.size - 1)] == values


def dense_features(count: int, data: np.ndarray, offsets: np.ndarray, insults: np.ndarray, learned: np.ndarray, person: np.ndarray, near: int = NEAR) -> np.ndarray:
    """One row of ``FEATURES`` per text."""
    plain, cuts = _letters(data, offsets, _LOWER)
    row, start, end = word_spans(plain, cuts)
    hashed = word_hashes(plain, start, end)
    base, you = _member(hashed, insults), _member(hashed, person)
    taught = _member(hashed, learned)
    for width in PREFIXES:
        taught |= (end - start > width) & _member(word_hashes(plain, start, np.minimum(end, start + width)), learned)
    turned, turned_cuts = _letters(data, offsets, _LEET)
    row2, start2, end2 = word_spans(turned, turned_cuts)
    found2 = _member(word_hashes(turned, start2, end2), np.union1d(insults, learned))
    total = np.maximum(np.bincount(row, minlength=count), 1)

    def each(rows: np.ndarray, flags: np.ndarray) -> np.ndarray:
        return np.bincount(rows[flags], minlength=count).astype(float)

    hit = base | taught
    reach = np.concatenate([[0], np.cumsum(you)])
    at = np.flatnonzero(hit)
    lows, highs = np.maximum(at - near, 0), np.minimum(at + near + 1, row.size)
    first = np.searchsorted(row, row[at], "left")
    last = np.searchsorted(row, row[at], "right")
    close = reach[np.minimum(highs, last)] - reach[np.maximum(lows, first)] > 0
    hits = each(row, hit)
    owner = np.repeat(np.arange(count), np.diff(offsets))
    size = np.maximum(np.diff(offsets), 1)
    upper = (data >= 65) & (data <= 90)
    raw_row, raw_start, raw_end = word_spans(data, offsets)
    ups = np.concatenate([[0], np.cumsum(upper)])
    lows_ = np.concatenate([[0], np.cumsum((data >= 97) & (data <= 122))])
    loud = (ups[raw_end] - ups[raw_start] >= 3) & (lows_[raw_end] == lows_[raw_start])
    marks, signs = np.zeros(256, bool), np.zeros(256, bool)
    marks[list(b"!?.,;:")] = True
    signs[list(b"#*$%&|<>@^~")] = True
    return np.stack([
        each(row, base), each(row, base) / total, each(row, taught), each(row, taught) / total,
        np.maximum(each(row2, found2) - hits, 0), np.bincount(row[at][close], minlength=count).astype(float), each(row, you) / total,
        np.bincount(owner[upper], minlength=count) / size, each(raw_row, loud) / total, np.bincount(owner[data == 33], minlength=count) / size,
        np.bincount(owner[marks[data]], minlength=count) / size, np.bincount(owner[signs[data]], minlength=count) / size, np.log1p(np.bincount(row, minlength=count)),
    ], axis=1)


def featured(docs: DataFrame, insults: Sequence[str], learned: Sequence[str], label: bool = False) -> DataFrame:
    """``doc_id, features`` (and ``label``) of every whole text, in one pass."""
    known, taught, person = names(insults), names(learned), names(SECOND_PERSON)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [dense_features(to - at, data, offsets, known, taught, person) for at, to, data, offsets in text_slices(batch.column("text"))]
            flat = np.concatenate(rows) if rows else np.zeros((0, len(FEATURES)))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(flat) + 1, dtype=np.int32) * len(FEATURES)), pa.array(flat.reshape(-1)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), lists, *([batch.column("label")] if label else [])], ["doc_id", "features", *(["label"] if label else [])])

    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *(["label"] if label else []))
    return own.mapInArrow(run, "doc_id long, features array<double>" + (", label int" if label else ""))


def telling_words(sampled: DataFrame, most: int = LEARNED_WORDS, least: int = LEARNED_DOCS, least_odds: float = 10.0) -> list[bytes]:
    """At most ``most`` words or beginnings of words, in UTF-8, of at least ``least`` toxic rows, with ``least_odds`` times the odds of other rows."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    letters = F.regexp_replace(F.translate("text", upper, upper.lower()), r"[\x00-\x08\x0E-\x1F!-@\[-`{-\x7F]", "")
    words = F.transform(F.array_distinct(F.split(letters, r"[\x20\x09-\x0D]+")), lambda w: w.cast("binary"))
    starts = [F.transform(F.filter(words, lambda w, n=n: F.octet_length(w) > n), lambda w, n=n: F.substring(w, 1, n)) for n in PREFIXES]
    each = sampled.select("label", F.explode(F.array_distinct(F.concat(words, *starts))).alias("word")).filter(F.octet_length("word") > 2)
    one, zero = (F.sum((F.col("label") == k).cast("long")) for k in (1, 0))
    totals = sampled.agg(one.alias("one"), zero.alias("zero")).first()
    if not totals["one"] or not totals["zero"]:
        return []
    odds = ((F.col("one") + 0.5) / F.lit(float(totals["one"]))) / ((F.col("zero") + 0.5) / F.lit(float(totals["zero"])))
    counted = each.groupBy("word").agg(one.alias("one"), zero.alias("zero")).filter(F.col("one") >= least).withColumn("odds", odds).filter(F.col("odds") >= least_odds)
    return [bytes(r["word"]) for r in counted.orderBy(F.desc(F.col("one") * F.log("odds")), "word").limit(most).collect()]


def toxicity_scores(docs: DataFrame, labels: DataFrame, label: str = "toxic", folds: int = FOLDS, held: int = HELD, most: int = LABELLED,
                    insults: Sequence[str] = tuple(INSULTS), trees: int = TREES, depth: int = TREE_DEPTH) -> DataFrame:
    """``doc_id, held_out, score, predicted`` for every row of ``doc_id, text``; further columns are ignored.

    Labels are read only outside the fold ``held`` of ``folds``, from about ``most`` rows: two thirds of them fit the
    trees, all of them the list of telling words, the rest the isotonic calibration. Null and empty texts score as texts
    without words. Repeated rows score alike. With no labels of both classes every score is 0.
    """
    small_batches(docs.sparkSession)
    sampled = written(sample(docs, labels, label, folds, held, most))
    learned = telling_words(sampled)
    known = written(featured(sampled, insults, learned, label=True)).withColumn("vector", array_to_vector("features")).withColumn(
        "tuning", F.pmod(F.xxhash64(F.lit("tune"), "doc_id"), F.lit(3)) == 0)
    counts = {(r["tuning"], r["label"]) for r in known.groupBy("tuning", "label").count().collect()}
    scored = featured(docs, insults, learned)
    if not {(False, 0), (False, 1)} <= counts:
        return verdict(scored.select("doc_id", F.lit(0.0).alias("score")), folds, held)
    boosted = GBTClassifier(featuresCol="vector", labelCol="label", maxIter=trees, maxDepth=depth, stepSize=0.2, minInstancesPerNode=5, maxBins=64, seed=7,
                            predictionCol="guess").setRawPredictionCol("raw").setProbabilityCol("probability").fit(known.filter("not tuning").coalesce(4))

    def margin(frame: DataFrame) -> DataFrame:
        return boosted.transform(frame).withColumn("margin", vector_to_array("raw")[1])

    tuned = margin(known.filter("tuning" if {(True, 0), (True, 1)} <= counts else "true"))
    steps = IsotonicRegression(featuresCol="margin", labelCol="label", predictionCol="score").fit(tuned.select("margin", F.col("label").cast("double").alias("label")).coalesce(1))
    result = steps.transform(margin(scored.withColumn("vector", array_to_vector("features"))))
    return verdict(result.select("doc_id", F.least(F.greatest(F.col("score"), F.lit(0.0)), F.lit(1.0)).alias("score")), folds, held)
