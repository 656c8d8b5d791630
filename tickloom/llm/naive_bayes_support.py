"""Quality classifier: n-gram indicators scaled by class log-count ratios, hinge loss by dual coordinate descent."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.llm.common import small_batches
from tickloom.llm.labelled import sample, verdict
from tickloom.llm.words import mix, text_slices, word_hashes, word_spans

BITS, SMOOTHING, COST, EPOCHS, BLEND = 18, 1.0, 1.0, 20, 0.75
FOLDS, HELD = 3, 1
RUNS, LABELLED = 9, 4000
_BYTES = 4


def _packed_keys(rows: np.ndarray, hashes: np.ndarray, bits: int) -> np.ndarray:
    return (rows.astype(np.int64) << bits) | (hashes >> np.uint64(64 - bits)).astype(np.int64)


def indicators(count: int, data: np.ndarray, offsets: np.ndarray, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """Row and hashed feature, each once: words, word pairs, a word several times over and runs of four bytes of every whole text."""
    row, start, end = word_spans(data, offsets)
    words = word_hashes(data, start, end)
    keys = [_packed_keys(row, mix(words + np.uint64(1)), bits)]
    if row.size > 1:
        near = row[1:] == row[:-1]
        again = near & (words[1:] == words[:-1])
        pairs = mix(words[:-1] * np.uint64(3) + words[1:])
        keys.append(_packed_keys(row[1:][near], pairs[near], bits))
        for n in range(2, RUNS + 1):  # a word n times over, whatever the word
            own = np.unique(row[1:][again])
            keys.append(_packed_keys(own, mix(np.full(own.size, n, np.uint64)), bits))
            again = again[1:] & again[:-1]
            again = np.concatenate([[False], again]) if again.size else np.zeros(row.size - 1, bool)
    if data.size >= _BYTES:
        grams = np.zeros(data.size - _BYTES + 1, np.uint32)
        for k in range(_BYTES):
            grams = (grams << np.uint32(8)) | data[k:data.size - _BYTES + 1 + k]
        owner = np.repeat(np.arange(count), np.diff(offsets))
        inside = owner[:grams.size] == owner[_BYTES - 1:]
        keys.append(_packed_keys(owner[:grams.size][inside], mix(grams[inside].astype(np.uint64) + np.uint64(1 << 40)), bits))
    flat = np.unique(np.concatenate(keys))
    return (flat >> bits).astype(np.int32), (flat & ((1 << bits) - 1)).astype(np.int32)


def log_count_ratios(rows: np.ndarray, features: np.ndarray, labels: np.ndarray, bits: int = BITS, smoothing: float = SMOOTHING) -> np.ndarray:
    one = labels[rows] == 1
    p = np.bincount(features[one], minlength=1 << bits) + smoothing
    q = np.bincount(features[~one], minlength=1 << bits) + smoothing
    ratio = np.log((p / p.sum()) / (q / q.sum()))
    ratio[(p == smoothing) & (q == smoothing)] = 0.0
    return ratio


def dual_coordinate_descent(cuts: np.ndarray, features: np.ndarray, values: np.ndarray, signs: np.ndarray, size: int, cost: float = COST,
                            epochs: int = EPOCHS) -> np.ndarray:
    """Weights (the last is the bias) of the L2-regularised hinge loss: one box-constrained dual variable per row at a time."""
    weights, alpha = np.zeros(size + 1), np.zeros(signs.size)
    order = np.arange(signs.size)
    rng = np.random.default_rng(1)
    norm = np.array([np.dot(values[cuts[i]:cuts[i + 1]], values[cuts[i]:cuts[i + 1]]) for i in order]) + 1.0
    upper = cost * np.where(signs > 0, (signs < 0).sum(), (signs > 0).sum()) * 2.0 / max(1, signs.size)  # classes weigh alike
    for _ in range(epochs):
        rng.shuffle(order)
        moved = 0.0
        for i in order:
            own, x = features[cuts[i]:cuts[i + 1]], values[cuts[i]:cuts[i + 1]]
            slope = signs[i] * (np.dot(weights[own], x) + weights[-1]) - 1.0
            new = min(max(alpha[i] - slope / norm[i], 0.0), upper[i])
            step = (new - alpha[i]) * signs[i]
            if step:
                weights[own] += step * x
                weights[-1] += step
                moved = max(moved, abs(step))
                alpha[i] = new
        if moved < 1e-3:
            break
    return weights


def sigmoid_fit(margins: np.ndarray, labels: np.ndarray) -> tuple[float, float]:
    """Slope and shift of the logistic that maps margins to probabilities, by damped Newton steps."""
    a, b = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * margins + b, -30, 30)))
        g = np.array([((p - labels) * margins).sum() + 1e-3 * a, (p - labels).sum() + 1e-3 * b])
        v = p * (1 - p)
        h = np.array([[(v * margins * margins).sum() + 1e-3, (v * margins).sum()], [(v * margins).sum(), v.sum() + 1e-3]])
        step = np.linalg.solve(h, g)
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-8:
            break
    return float(a), float(b)


def _margins(count: int, rows: np.ndarray, features: np.ndarray, weights: np.ndarray, ratio: np.ndarray, bias: float) -> np.ndarray:
    scale = np.sqrt(np.bincount(rows, ratio[features] ** 2, count))
    return np.bincount(rows, weights[features], count) / np.maximum(scale, 1e-12) + bias


def fit(texts: pa.Array, ids: np.ndarray, labels: np.ndarray, bits: int = BITS, blend: float = BLEND) -> np.ndarray:
    """Model from a bounded sample: feature weights, feature ratios, then bias, slope and shift.

    Four fifths fit the ratios and the hinge loss, the rest the logistic. One class alone gives a constant score.
    """
    if labels.size == 0 or labels.min() == labels.max():
        return np.concatenate([np.zeros(2 << bits), [0.0, 1.0, 0.0 if not labels.size else (4.0 if labels[0] == 1 else -4.0)]])
    parts = [(at + rows, features) for at, to, data, offsets in text_slices(texts) for rows, features in [indicators(to - at, data, offsets, bits)]]
    rows, features = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
    tune = mix(ids.astype(np.uint64)) % np.uint64(5) == 0
    if labels[tune].size < 20 or labels[tune].min() == labels[tune].max() or labels[~tune].min() == labels[~tune].max():
        tune = np.zeros(labels.size, bool)
    used = ~tune[rows]
    ratio = log_count_ratios(rows[used], features[used], labels, bits)
    values = ratio[features]
    scale = np.sqrt(np.bincount(rows, values ** 2, labels.size))
    values = values / np.maximum(scale, 1e-12)[rows]
    learn = np.flatnonzero(~tune)
    number = np.full(labels.size, -1)
    number[learn] = np.arange(learn.size)
    cuts = np.concatenate([[0], np.cumsum(np.bincount(number[rows[used]], minlength=learn.size))])
    signs = np.where(labels[learn] == 1, 1.0, -1.0)
    weights = dual_coordinate_descent(cuts, features[used], values[used], signs, 1 << bits)
    level = np.abs(weights[:-1]).sum() / max(1, np.count_nonzero(weights[:-1]))
    blended = ((1 - blend) * level + blend * weights[:-1]) * ratio
    shown = tune if tune.any() else np.ones(labels.size, bool)
    margins = _margins(labels.size, rows, features, blended, ratio, weights[-1])
    slope, shift = sigmoid_fit(margins[shown], labels[shown].astype(float))
    return np.concatenate([blended, ratio, [weights[-1], slope, shift]])


def train(sampled: DataFrame) -> np.ndarray:
    """The model of a bounded ``doc_id, text, label`` sample, fitted in one task; only its fixed-size weights come back."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = list(batches)
        table = pa.Table.from_batches(held).sort_by([("doc_id", "ascending"), ("text", "ascending")]) if held else None
        if table is None or not table.num_rows:
            model = fit(pa.array([], pa.string()), np.zeros(0, np.int64), np.zeros(0, np.int64))
        else:
            text = pa.concat_arrays([c.cast(pa.large_string()) for c in table.column("text").chunks])
            model = fit(text, table.column("doc_id").to_numpy(), table.column("label").to_numpy())
        yield pa.RecordBatch.from_arrays([pa.array([model.astype("<f4").tobytes()], pa.binary())], ["model"])

    rows = sampled.select("doc_id", "text", "label").repartition(1).mapInArrow(run, "model binary").collect()
    raw = rows[0]["model"] if rows else fit(pa.array([], pa.string()), np.zeros(0, np.int64), np.zeros(0, np.int64)).astype("<f4").tobytes()
    return np.frombuffer(raw, "<f4")


def score(docs: DataFrame, model: np.ndarray, bits: int = BITS) -> DataFrame:
    """``doc_id, score`` of every whole text: one pass, the fixed-size model as a broadcast variable."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value.astype(np.float64)
        weights, ratio, (bias, slope, shift) = own[:1 << bits], own[1 << bits:2 << bits], own[2 << bits:]
        for batch in batches:
            out = np.empty(batch.num_rows)
            for at, to, data, offsets in text_slices(batch.column("text")):
                rows, features = indicators(to - at, data, offsets, bits)
                margin = _margins(to - at, rows, features, weights, ratio, bias)
                out[at:to] = 1 / (1 + np.exp(-np.clip(slope * margin + shift, -30, 30)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(out)], ["doc_id", "score"])

    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return own.mapInArrow(run, "doc_id long, score double")


def quality_scores(docs: DataFrame, labels: DataFrame, label: str = "quality", folds: int = FOLDS, held: int = HELD, most: int = LABELLED) -> DataFrame:
    """``doc_id, held_out, score, predicted`` for every row of ``doc_id, text``; further columns are ignored.

    Labels are read only outside the fold ``held`` of ``folds``, from about ``most`` rows; nothing but the text enters a
    score. Null and empty texts score by the bias alone. Repeated rows score alike; with no labels every score is 0.5.
    """
    small_batches(docs.sparkSession)
    return verdict(score(docs, train(sample(docs, labels, label, folds, held, most))), folds, held)
