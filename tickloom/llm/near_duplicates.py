"""N-gram Jaccard join: a MinHash LSH forest proposes pairs, exact shingle sets decide.

Every text with a word becomes a set of five-word shingles. Texts with the same shingles are one node. A forest of
tries holds each node's signature once per tree, as a prefix of minima; the prefix that must match starts at the full
depth and is shortened until a pair at the threshold meets in some tree with the target probability. Nodes that meet
are compared by whole signatures, loosely related ones form families, and within a family every pair is decided by the
exact Jaccard similarity of the shingle sets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.llm.common import block_pairs, components, fixed_bytes, list_values, roots, small_batches, whole_groups, written
from tickloom.llm.words import mix, text_shingles

WORDS, THRESHOLD, TREES, DEPTH, TARGET = 5, 0.8, 20, 8, 0.999
BLOCK = 256


def match_depth(trees: int, depth: int, threshold: float, target: float) -> int:
    """The longest prefix whose matches reach the target recall for a pair at the threshold."""
    while depth > 1 and 1 - (1 - threshold ** depth) ** trees < target:
        depth -= 1
    return depth


def _minima(hashes: np.ndarray, cuts: np.ndarray, functions: int) -> np.ndarray:
    """One row of minima per non-empty text; the rows that are empty are left out."""
    values = (hashes >> np.uint64(32)).astype(np.uint32)
    seeds = mix(np.arange(1, 2 * functions + 1, dtype=np.uint64)).astype(np.uint32)
    starts = cuts[:-1][np.diff(cuts) > 0]
    out = np.empty((starts.size, functions), np.uint32)
    if starts.size:
        for k in range(functions):
            out[:, k] = np.minimum.reduceat((values * (seeds[k] | np.uint32(1))) ^ seeds[functions + k], starts)
    return out


def _sums(values: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(values, dtype=np.uint64)])
    return total[cuts[1:]] - total[cuts[:-1]]


def _identity(hashes: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    """A 64-bit name of each text's shingles, whatever their order."""
    return mix(_sums(hashes, cuts) ^ mix(_sums(mix(hashes ^ np.uint64(0x5851F42D4C957F2D)), cuts)) + np.diff(cuts).astype(np.uint64))


def signatures(docs: DataFrame, words: int, trees: int, depth: int, prefix: int) -> DataFrame:
    """``doc_id, node, keys, sig`` of every text with a word: tree prefixes and 16-bit minima."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("doc_id")
            for at, to, hashes, cuts in text_shingles(batch.column("text"), words):
                full = np.flatnonzero(np.diff(cuts) > 0)
                minima = _minima(hashes, cuts, trees * depth)
                sig = minima.astype(np.uint16).astype("<u2")
                keys = np.empty((full.size, trees), np.uint64)
                by_tree = minima.reshape(full.size, trees, depth)
                for t in range(trees):
                    key = np.full(full.size, t + 1, np.uint64)
                    for d in range(prefix):
                        key = mix(key * np.uint64(0xD6E8FEB86659FD93) + by_tree[:, t, d])
                    keys[:, t] = key
                flat = pa.array(keys.reshape(-1).view(np.int64))
                yield pa.RecordBatch.from_arrays([
                    ids.slice(at, to - at).take(pa.array(full)),
                    pa.array(_identity(hashes, cuts)[full].view(np.int64)),
                    pa.ListArray.from_arrays(pa.array(np.arange(full.size + 1, dtype=np.int32) * trees), flat),
                    pa.array([row.tobytes() for row in sig], pa.binary()),
                ], ["doc_id", "node", "keys", "sig"])

    return docs.mapInArrow(run, "doc_id long, node long, keys array<long>, sig binary")


def _families(members: DataFrame, likely: float) -> DataFrame:
    """Star edges ``a, b`` between nodes of a trie bucket whose signatures agree in at least ``likely`` of the minima."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, starts in whole_groups(batches, ["key", "bi", "bj"]):
            node = part.column("node").to_numpy()
            sig = fixed_bytes(part.column("sig"), "<u2")
            sizes = np.diff(np.append(starts, part.num_rows))
            head = np.repeat(starts, sizes)
            near = (sig == sig[head]).mean(axis=1) >= likely
            root = head.copy()
            root[~near] = np.flatnonzero(~near)
            open_groups = np.unique(head[~near])
            for first in open_groups[np.isin(open_groups, starts[sizes > 2])]:
                count = int(sizes[np.searchsorted(starts, first)])
                own = sig[first:first + count]
                rest = np.flatnonzero(~near[first:first + count])
                met = [np.flatnonzero((own == own[r]).mean(axis=1) >= likely) for r in rest]
                star = np.flatnonzero(near[first:first + count])
                left = np.concatenate([np.zeros(star.size, np.int64), np.repeat(rest, [m.size for m in met])])
                root[first:first + count] = first + roots(count, left, np.concatenate([star, *met]))
            a, b = node, node[root]
            pairs = np.unique(np.stack([np.maximum(a, b), np.minimum(a, b)]), axis=1)
            pairs = pairs[:, pairs[0] != pairs[1]]
            yield pa.RecordBatch.from_arrays([pa.array(pairs[0]), pa.array(pairs[1])], ["a", "b"])

    return members.mapInArrow(run, "a long, b long").distinct()


def shared_counts(values: np.ndarray, owner: np.ndarray, members: int, width: int = 4096) -> np.ndarray:
    """Sizes of all pairwise intersections of sets given as (value, owner) entries, a block of columns at a time."""
    out = np.zeros((members, members), np.float32)
    _, column, count = np.unique(values, return_inverse=True, return_counts=True)
    shared = count[column] > 1
    owner = owner[shared]
    _, column = np.unique(column[shared], return_inverse=True)
    order = np.argsort(column, kind="stable")
    column, owner = column[order], owner[order]
    edges = np.searchsorted(column, np.arange(0, (int(column[-1]) + 1 if column.size else 0) + width, width))
    for k in range(edges.size - 1):
        lo, hi = edges[k], edges[k + 1]
        block = np.zeros((members, width), np.float32)
        block[owner[lo:hi], column[lo:hi] - k * width] = 1
        out += block @ block.T
    return out


def _verified(members: DataFrame, threshold: float) -> DataFrame:
    """``node, links, root`` per block pair: linked texts counted with their copies, and a star of the links."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, starts in whole_groups(batches, ["family", "bi", "bj"], 512):
            node, mine = part.column("node").to_numpy(), part.column("mine").to_numpy()
            copies = part.column("copies").to_numpy()
            bi, bj = part.column("bi").to_numpy(), part.column("bj").to_numpy()
            values, cuts = list_values(part.column("shingles"))
            found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
            for lo, hi in zip(starts, np.append(starts[1:], part.num_rows)):
                _, keep = np.unique(node[lo:hi], return_index=True)
                keep = lo + keep
                if keep.size < 2:
                    continue
                sizes = cuts[keep + 1] - cuts[keep]
                flat = np.concatenate([values[cuts[r]:cuts[r + 1]] for r in keep])
                both = shared_counts(flat, np.repeat(np.arange(keep.size), sizes), keep.size)
                total = sizes[:, None] + sizes[None, :] - both
                link = both >= threshold * total - 1e-9
                np.fill_diagonal(link, False)
                if bi[lo] != bj[lo]:
                    link &= mine[keep][:, None] != mine[keep][None, :]
                a, b = np.nonzero(np.triu(link))
                if a.size:
                    linked = np.flatnonzero(link.any(axis=1))
                    found.append((node[keep[linked]], (link @ copies[keep])[linked], node[keep[roots(keep.size, a, b)[linked]]]))
            if found:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(x)) for x in zip(*found)], ["node", "links", "root"])

    return members.mapInArrow(run, "node long, links long, root long")


def _shingle_sets(docs: DataFrame, words: int) -> DataFrame:
    """``node, family, copies, shingles`` for rows that carry the text of their node."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            node = batch.column("node").to_numpy()
            for at, to, hashes, cuts in text_shingles(batch.column("text"), words):
                own = np.flatnonzero((_identity(hashes, cuts).view(np.int64) == node[at:to]) & (np.diff(cuts) > 0))
                sets = [np.unique(hashes[cuts[r]:cuts[r + 1]]).view(np.int64) for r in own]
                ends = np.concatenate([[0], np.cumsum([s.size for s in sets])]).astype(np.int32)
                flat = np.concatenate(sets) if sets else np.zeros(0, np.int64)
                rows = pa.array(at + own)
                yield pa.RecordBatch.from_arrays(
                    [*[batch.column(c).take(rows) for c in ("node", "family", "copies")], pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))],
                    ["node", "family", "copies", "shingles"])

    return docs.mapInArrow(run, "node long, family long, copies long, shingles array<long>")


def jaccard_join(docs: DataFrame, words: int = WORDS, threshold: float = THRESHOLD, trees: int = TREES, depth: int = DEPTH,
                 target: float = TARGET, block: int = BLOCK) -> DataFrame:
    """``doc_id, class_id, n_links, kept`` for every row of ``doc_id, text``; further columns are ignored.

    Two texts are linked when their sets of ``words``-word shingles have a Jaccard similarity of ``threshold`` or more;
    texts of fewer words have one shingle of all their words. ``n_links`` counts the other linked rows, copies included;
    ``class_id`` is the smallest doc_id reachable by links; ``kept`` marks it. Rows without a word or with a null text
    link with nothing. Rows with a null doc_id come back with a null class, no links and ``kept``. Rows that repeat a doc_id come back once each;
    a repeated row counts as a linked copy, and of equal ids each is ``kept`` if its id is the class.

    A pair at the threshold is proposed with probability ``target`` or more; pairs above it more often.
    """
    small_batches(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    prefix = match_depth(trees, depth, threshold, target)
    signed = written(signatures(docs.filter("doc_id is not null"), words, trees, depth, prefix))
    nodes = signed.groupBy("node").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies"))
    light = signed.groupBy("node").agg(F.first("keys").alias("keys")).select("node", F.explode("keys").alias("key"))
    shared = light.groupBy("key").agg(F.count("*").alias("members")).filter("members > 1")
    meeting = light.join(shared, "key")
    # Signatures are joined once per node and only then repeated for the tries in which the node has company.
    company = meeting.groupBy("node").agg(F.collect_list(F.struct("key", "members")).alias("tries"))
    one = signed.groupBy("node").agg(F.min("sig").alias("sig"))
    members = company.join(one, "node").select("node", "sig", F.explode("tries").alias("trie")).select(
        "node", "sig", F.col("trie.key").alias("key"), F.col("trie.members").alias("members"))
    placed = block_pairs(members, ["key"], "node", F.col("members"), block).drop("members", "mine")
    placed = placed.repartition("key", "bi", "bj").sortWithinPartitions("key", "bi", "bj", "node")
    sigma = (threshold * (1 - threshold) / (trees * depth)) ** 0.5
    family = components(_families(placed, threshold - 5 * sigma))
    family = family.withColumnRenamed("component", "family")
    sizes = family.groupBy("family").agg(F.count("*").alias("members"))
    wanted = family.join(sizes, "family").join(nodes, "node").select("node", "family", "members", "copies", F.col("rep").alias("doc_id"))
    sets = _shingle_sets(docs.join(wanted.drop("members"), "doc_id").select("node", "family", "copies", "text"), words)
    dealt = block_pairs(sets.join(sizes, "family"), ["family"], "node", F.col("members"), block).drop("members")
    dealt = dealt.repartition("family", "bi", "bj").sortWithinPartitions("family", "bi", "bj", "node")
    links = written(_verified(dealt, threshold))
    linked = components(links.select(F.col("node").alias("a"), F.col("root").alias("b")))
    by_node = linked.join(nodes, "node")
    classes = by_node.groupBy("component").agg(F.min("rep").alias("class_id"))
    extra = by_node.join(classes, "component").join(links.groupBy("node").agg(F.sum("links").alias("links")), "node")
    # Written, so that the join with all copies has its own exchange on either side and a large group of copies can be split.
    facts = nodes.join(extra.select("node", "class_id", "links"), "node", "left").select(
        "node", F.coalesce("class_id", "rep").alias("class_id"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    facts = written(facts)
    worded = signed.select("doc_id", "node").join(facts, "node").select("doc_id", "class_id", "n_links")
    blank = docs.filter("doc_id is null or text is null or not text rlike '[^\\\\x20\\\\x09-\\\\x0D]'").select(
        "doc_id", F.col("doc_id").alias("class_id"), F.lit(0).cast("long").alias("n_links"))
    return worded.unionByName(blank).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("class_id"), F.lit(True)))
