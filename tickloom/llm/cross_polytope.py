"""Embedding near-dedup: cross-polytope hashing after fast Hadamard rotations, multiprobe buckets, verified pairs."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.llm.common import block_pairs, components, fixed_bytes, list_values, roots, whole_groups, written
from tickloom.llm.words import mix

THRESHOLD, TABLES, PROBES, BLOCK = 0.9, 12, 4, 512
# Expected members of a bucket by chance, from which the number of hashes per table follows as the input grows.
CHANCE = 0.1
# Recall of a pair at the threshold, from which the tables and probes follow; TABLES and PROBES are the least of them.
# Where more than MOST_KEYS buckets per vector are needed for it, a table gets fewer hashes and larger buckets instead.
TARGET, MOST_KEYS = 0.99, 640


def hadamard(rows: np.ndarray) -> np.ndarray:
    """Walsh-Hadamard transform of every row; the width is a power of two."""
    out, step = rows.copy(), 1
    while step < out.shape[1]:
        view = out.reshape(out.shape[0], -1, 2, step)
        out = np.stack([view[:, :, 0] + view[:, :, 1], view[:, :, 0] - view[:, :, 1]], axis=2).reshape(out.shape)
        step *= 2
    return out


def probe_codes(unit: np.ndarray, tables: int, hashes: int, probes: int) -> np.ndarray:
    """Bucket codes, one row per vector, by table and probe; the first probe of a table is the vector's own bucket.

    A hash is the signed axis nearest to the vector after three rounds of random signs and a Hadamard transform. Further
    probes exchange, in one hash, the nearest axis for the second or third nearest, smallest loss first.
    """
    count, dim = unit.shape
    width = 1 << max(1, (dim - 1).bit_length())
    padded = np.zeros((count, width))
    padded[:, :dim] = unit
    codes = np.empty((count, tables, probes), np.uint64)
    rng = np.random.default_rng(20240501)
    near = min(3, width)
    for t in range(tables):
        axes, gaps = np.empty((count, hashes, near), np.int64), np.empty((count, hashes, near))
        for k in range(hashes):
            turned = padded
            for _ in range(3):
                turned = hadamard(turned * rng.choice([-1.0, 1.0], width)) / math.sqrt(width)
            size = np.abs(turned)
            order = np.argpartition(-size, near - 1, axis=1)[:, :near] if near < width else np.argsort(-size, axis=1)
            values = np.take_along_axis(size, order, 1)
            rank = np.argsort(-values, axis=1, kind="stable")
            order, values = np.take_along_axis(order, rank, 1), np.take_along_axis(values, rank, 1)
            axes[:, k] = 2 * order + (np.take_along_axis(turned, order, 1) < 0)
            gaps[:, k] = values[:, :1] - values
        # The candidates of a table: its own bucket, then every exchange in one hash.
        swap = [(k, j) for k in range(hashes) for j in range(1, near)]
        loss = np.stack([gaps[:, k, j] for k, j in swap], axis=1)
        best = np.argsort(loss, axis=1, kind="stable")[:, :probes - 1]
        for p in range(probes):
            chosen = axes[:, :, 0].copy()
            if p and p - 1 < best.shape[1]:
                which = best[:, p - 1]
                k = np.array([s[0] for s in swap])[which]
                j = np.array([s[1] for s in swap])[which]
                chosen[np.arange(count), k] = axes[np.arange(count), k, j]
            code = np.full(count, t + 1, np.uint64)
            for k in range(hashes):
                code = mix(code * np.uint64(0xD6E8FEB86659FD93) + chosen[:, k].astype(np.uint64))
            codes[:, t, p] = code
    return codes


def hashes_for(count: int, dim: int) -> int:
    """Hashes per table, so that a bucket holds about ``CHANCE`` unrelated vectors."""
    width = 1 << max(1, (dim - 1).bit_length())
    return max(1, math.ceil(math.log(max(count, 2) / CHANCE) / math.log(2 * width)))


def _proposed(dim: int, hashes: int, threshold: float, tables: int, probes: int, pairs: int, seed: int) -> np.ndarray:
    """Random pairs at exactly the threshold, by table and probe: whether one's own bucket is the other's probe."""
    rng = np.random.default_rng(seed)
    x, z = rng.standard_normal((2, pairs, dim))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    z -= (z * x).sum(axis=1, keepdims=True) * x
    z /= np.linalg.norm(z, axis=1, keepdims=True)
    a, b = (probe_codes(v, tables, hashes, probes) for v in (x, threshold * x + math.sqrt(1 - threshold * threshold) * z))
    return (a[:, :, :1] == b) | (b[:, :, :1] == a)


def tables_for(dim: int, hashes: int, threshold: float, target: float = TARGET) -> tuple[int, int]:
    """Tables and probes with which a pair at the threshold meets with probability ``target``, fewest buckets first.

    The chance to meet in one table is taken two standard errors below the share of random pairs that do.
    """
    if dim < 2 or not -1 < threshold < 1:  # only parallel vectors link, and these share every bucket
        return TABLES, PROBES
    pairs, trial = 2000 if dim <= 128 else 500, 8
    met = _proposed(dim, hashes, threshold, trial, max(PROBES, 1 + 2 * hashes), pairs, 7)
    chances = np.logical_or.accumulate(met, axis=2).mean(axis=(0, 1))
    options = []
    for probes, chance in enumerate(chances - 2 * np.sqrt(chances * (1 - chances) / (pairs * trial)), 1):
        if probes >= PROBES and chance > 0:
            tables = TABLES if chance >= 1 else max(TABLES, math.ceil(math.log(1 - target) / math.log1p(-chance)))
            options.append((tables * probes, tables, probes))
    return min(options)[1:] if options else (MOST_KEYS, PROBES)


def layout_for(count: int, dim: int, threshold: float, target: float = TARGET) -> tuple[int, int, int]:
    """Hashes, tables and probes for ``count`` vectors, with the target recall at the threshold whatever the count.

    In few dimensions the tables' rotations repeat, so the layout is tried as a whole and gets fewer hashes if it falls short.
    """
    for hashes in range(hashes_for(count, dim), 0, -1):
        tables, probes = tables_for(dim, hashes, threshold, target)
        if hashes == 1 or dim < 2 or not -1 < threshold < 1:
            break
        if tables * probes <= MOST_KEYS and _proposed(dim, hashes, threshold, tables, probes, 1000, 11).any(axis=(1, 2)).mean() >= target - 0.005:
            break
    return hashes, tables, probes


def valid_vectors(vectors: DataFrame) -> DataFrame:
    """``vec_id, node, vec`` of usable rows: ``vec`` has the components as doubles, ``node`` names equal vectors."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column("embedding")
            flat, cuts = list_values(column)
            flat = flat.astype(np.float64)
            rows, out, names = [], [], []
            for k in range(batch.num_rows):
                own = flat[cuts[k]:cuts[k + 1]] + 0.0
                if own.size and np.isfinite(own).all() and own.any():
                    rows.append(k)
                    out.append(own.tobytes())
                    values = own.view(np.uint64)
                    places = mix(np.arange(1, own.size + 1, dtype=np.uint64))
                    names.append(int(mix(np.array([mix(values ^ places).sum(dtype=np.uint64)], np.uint64)).view(np.int64)[0]))
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id").take(pa.array(rows, pa.int64())), pa.array(names, pa.int64()), pa.array(out, pa.binary())], ["vec_id", "node", "vec"])

    own = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    return own.filter("vec_id is not null and embedding is not null").mapInArrow(run, "vec_id long, node long, vec binary")


def _units(raw: np.ndarray) -> np.ndarray:
    scaled = raw / np.abs(raw).max(axis=1, keepdims=True)  # neither overflows nor vanishes when squared
    return scaled / np.sqrt((scaled * scaled).sum(axis=1, keepdims=True))


def _hashed(nodes: DataFrame, tables: int, hashes: int, probes: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                part = batch.slice(at, 2048)
                codes = probe_codes(_units(fixed_bytes(part.column("vec"), "<f8")), tables, hashes, probes)
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, pa.array([c.tobytes() for c in codes], pa.binary()),
                     pa.ListArray.from_arrays(pa.array(np.arange(len(codes) + 1, dtype=np.int32) * (tables * probes)),
                                              pa.array(codes.reshape(-1).view(np.int64)))], [*part.schema.names, "codes", "keys"])

    return nodes.select("node", "copies", "vec").mapInArrow(run, "node long, copies long, vec binary, codes binary, keys array<long>")


def _first_meeting(a: np.ndarray, b: np.ndarray, tables: int, probes: int) -> np.ndarray:
    """The smallest bucket in which each pair meets: one's own bucket is the other's own or probed one."""
    a, b = a.reshape(-1, tables, probes), b.reshape(-1, tables, probes)
    top = np.uint64(0xFFFFFFFFFFFFFFFF)
    left = np.where((a[:, :, :1] == b).any(axis=2), a[:, :, 0], top).min(axis=1)
    right = np.where((b[:, :, :1] == a).any(axis=2), b[:, :, 0], top).min(axis=1)
    return np.minimum(left, right)


def _linked(members: DataFrame, threshold: float, tables: int, probes: int) -> DataFrame:
    """``node, links, root`` per block pair of a bucket. A pair counts only in the smallest bucket in which it meets."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, starts in whole_groups(batches, ["key", "bi", "bj"], 2048):
            node, copies, mine = (part.column(c).to_numpy() for c in ("node", "copies", "mine"))
            key, bi, bj = (part.column(c).to_numpy() for c in ("key", "bi", "bj"))
            units = _units(fixed_bytes(part.column("vec"), "<f8"))
            codes = fixed_bytes(part.column("codes"), "<u8")
            found = []
            for lo, hi in zip(starts, np.append(starts[1:], part.num_rows)):
                if hi - lo < 2:
                    continue
                link = np.triu(units[lo:hi] @ units[lo:hi].T >= threshold, 1)
                if bi[lo] != bj[lo]:
                    link &= mine[lo:hi][:, None] != mine[lo:hi][None, :]
                a, b = np.nonzero(link)
                if not a.size:
                    continue
                here = np.concatenate([
                    _first_meeting(codes[lo + a[k:k + 8192]], codes[lo + b[k:k + 8192]], tables, probes) == key[lo:lo + 1].view(np.uint64)
                    for k in range(0, a.size, 8192)])
                a, b = a[here], b[here]
                if a.size:
                    size = hi - lo
                    links = np.bincount(a, copies[lo + b], size) + np.bincount(b, copies[lo + a], size)
                    own = np.flatnonzero(links)
                    found.append((node[lo + own], links[own].astype(np.int64), node[lo + roots(size, a, b)[own]]))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*found)], ["node", "links", "root"])

    return members.mapInArrow(run, "node long, links long, root long")


def near_vectors(vectors: DataFrame, threshold: float = THRESHOLD, tables: int | None = None, probes: int | None = None,
                 block: int = BLOCK, hashes: int | None = None, target: float = TARGET) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` for every row of ``vec_id, embedding``.

    Vectors are linked when their cosine, in double precision, is ``threshold`` or more. Proposed pairs share a bucket
    that is the own one of at least one of them; each is verified once. Tables and probes follow from the hashes per
    table, so that a pair at the threshold is proposed with probability ``target`` or so whatever the number of vectors.
    Equal vectors are one node and all linked.
    Vectors that are null, empty, zero or hold null or non-finite components link with nothing, nor do those of another
    length. A null vec_id links with nothing and comes back with a null component and ``kept``. Rows that repeat a
    vec_id are separate vectors; ``kept`` marks each row whose id is its component.
    """
    vectors = vectors.select("vec_id", "embedding")
    usable = written(valid_vectors(vectors))
    nodes = written(usable.groupBy("node").agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies"), F.first("vec").alias("vec")))
    sizes = nodes.groupBy(F.octet_length("vec").alias("bytes")).agg(F.count("*").alias("n"))
    found = []
    for row in sizes.collect():  # one row per length of vectors, as a rule a single one
        own = nodes.filter(F.octet_length("vec") == row["bytes"])
        dim = row["bytes"] // 8
        per_table, n_tables, n_probes = (hashes, *tables_for(dim, hashes, threshold, target)) if hashes else layout_for(row["n"], dim, threshold, target)
        n_tables, n_probes = tables or n_tables, probes or n_probes
        hashed = written(_hashed(own, n_tables, per_table, n_probes))
        # A bucket takes part if it is some vector's own and holds another; its own members are the first of each table's probes.
        flat = hashed.select("node", F.posexplode(F.array_distinct("keys")).alias("pos", "key"))
        homes = hashed.select(F.explode(F.transform(F.sequence(F.lit(0), F.lit(n_tables - 1)), lambda t: F.get("keys", t * n_probes))).alias("key")).distinct()
        shared = flat.groupBy("key").agg(F.count("*").alias("members")).filter("members > 1").join(homes, "key", "left_semi")
        company = flat.join(shared, "key").groupBy("node").agg(F.collect_list(F.struct("key", "members")).alias("buckets"))
        members = company.join(hashed.drop("keys"), "node").select(
            "node", "copies", "vec", "codes", F.explode("buckets").alias("bucket")).select(
            "node", "copies", "vec", "codes", F.col("bucket.key").alias("key"), F.col("bucket.members").alias("members"))
        dealt = block_pairs(members, ["key"], "node", F.col("members"), block).drop("members")
        dealt = dealt.repartition("key", "bi", "bj").sortWithinPartitions("key", "bi", "bj", "node")
        found.append(written(_linked(dealt, threshold, n_tables, n_probes)))
    if not found:
        return vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.lit(0).cast("long").alias("n_links"),
                              F.col("vec_id").cast("long").alias("component_id"), F.lit(True).alias("kept"))
    links = found[0]
    for more in found[1:]:
        links = links.unionByName(more)
    linked = components(links.select(F.col("node").alias("a"), F.col("root").alias("b"))).join(nodes.select("node", "rep"), "node")
    classes = linked.groupBy("component").agg(F.min("rep").alias("component_id"))
    by_node = linked.join(classes, "component").join(links.groupBy("node").agg(F.sum("links").alias("links")), "node")
    facts = nodes.select("node", "rep", "copies").join(by_node.select("node", "component_id", "links"), "node", "left").select(
        "node", F.coalesce("component_id", "rep").alias("component_id"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    good = usable.select("vec_id", "node").join(facts, "node").select("vec_id", "n_links", "component_id")
    per_id = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), _unusable(F.col("embedding").cast("array<double>")).alias("bad"))
    bad = per_id.filter("bad or vec_id is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return good.unionByName(bad).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))


def _unusable(embedding):
    """The complement of what ``valid_vectors`` lets through."""
    odd = F.exists(embedding, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(math.inf)))
    return F.coalesce(F.coalesce(odd, F.lit(True)) | (F.size(embedding) == 0) | ~F.exists(embedding, lambda x: x != 0), F.lit(True))
