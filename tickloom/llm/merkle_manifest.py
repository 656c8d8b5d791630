"""Merkle manifest of a dataset: a tree of three-way hashes per source, a tree over their roots, octopus multiproofs.

Leaves are hashed by Spark's own functions and numbered in sorted partitions. Trees are folded in aligned blocks, several
levels per shuffle. For the proofs each partition of leaves works out which nodes it cannot derive from its own leaves,
fetches these in one join, derives the interior nodes its leaves share and expands every leaf's proof from them.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickloom.llm.common import whole_groups, written

WAYS = 3
# Levels folded per shuffle (a block has at most 3**8 leaves), leaves of a partition, most partitions.
LEVELS, ROWS, PARTITIONS = 8, 1 << 14, 1 << 17
TOP = -1  # the number of the tree over the sources' roots
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
_LOW = (1 << 33) - 1


def leaf_hash(**changed: Column) -> Column:
    """SHA-256 over the fields' lengths and values, as 32 bytes; ``changed`` replaces fields."""
    def said(name: str) -> Column:
        value = changed.get(name, F.col(name)).cast("string")
        return F.when(value.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value))

    return F.unhex(F.sha2(F.concat(*[said(f) for f in FIELDS]).cast("binary"), 256))


def height(size: int) -> int:
    """Levels above the leaves of a tree."""
    levels = 0
    while size > 1:
        size, levels = -(-size // WAYS), levels + 1
    return levels


def parent_hash(children: list[bytes]) -> bytes:
    """The hash, as hexadecimal text, of a run of hashes in that form."""
    return sha256(b"".join(children)).hexdigest().encode()


def missing_nodes(known: np.ndarray, size: int) -> list[tuple[int, np.ndarray]]:
    """``level, indices`` of the least set of nodes from which, with the ``known`` leaves, every proof can be derived."""
    out, level = [], 0
    known = np.unique(known)
    while size > 1:
        runs = np.unique(known // WAYS)
        wanted = (runs[:, None] * WAYS + np.arange(WAYS)).ravel()
        absent = np.setdiff1d(wanted[wanted < size], known, assume_unique=True)
        if absent.size:
            out.append((level, absent))
        known, size, level = runs, -(-size // WAYS), level + 1
    return out


class Branches:
    """Nodes of one tree that follow from some of its leaves and the missing nodes."""

    def __init__(self, size: int, leaves: dict[int, bytes], fetched: dict[tuple[int, int], bytes]):
        self.sizes = [size]
        self.nodes = [dict(leaves)]
        while self.sizes[-1] > 1:
            level = len(self.nodes) - 1
            row = self.nodes[-1]
            runs = sorted({i // WAYS for i in row})
            row.update((i, h) for (at, i), h in fetched.items() if at == level)
            self.nodes.append({r: parent_hash([row[i] for i in self.run(level, r)]) for r in runs})
            self.sizes.append(-(-self.sizes[-1] // WAYS))
        self.above: list[dict[int, bytes]] = [{} for _ in self.nodes]

    def run(self, level: int, r: int) -> range:
        return range(r * WAYS, min(r * WAYS + WAYS, self.sizes[level]))

    @property
    def root(self) -> bytes:
        return self.nodes[-1][0]

    def proof(self, i: int, level: int = 0) -> bytes:
        """The siblings on the way up from a node, level by level, left to right."""
        if self.sizes[level] == 1:
            return b""
        held = self.above[level].get(i)
        if held is None:
            row = self.nodes[level]
            held = b"".join(row[k] for k in self.run(level, i // WAYS) if k != i) + self.proof(i // WAYS, level + 1)
            if level > 1:  # the many nodes near the leaves are not worth their memory
                self.above[level][i] = held
        return held

    def folded(self, i: int, own: bytes) -> bytes:
        """The root that follows from ``own`` in the place of leaf ``i``."""
        for level in range(len(self.nodes) - 1):
            row = self.nodes[level]
            if row[i] == own:
                return self.root
            own = parent_hash([own if k == i else row[k] for k in self.run(level, i // WAYS)])
            i //= WAYS
        return own


def numbered(leaves: DataFrame, rows: int = ROWS) -> tuple[DataFrame, DataFrame, int, int]:
    """The leaves with ``tree, idx, size, part``; spans of leaves by partition and tree; number of trees; greatest size.

    Leaves are ordered by source (null first), doc_id (null first) and hash. They are sorted in range partitions, in which
    a source of any size and any number of equal rows is spread; a leaf's number is its place in the partition plus what
    the partitions before it hold, which are a row each per source.
    """
    total = leaves.count()
    parts = min(PARTITIONS, max(1, -(-total // rows)))
    order = ["src", F.col("doc_id").asc_nulls_first(), "leaf", "tie"]
    keyed = leaves.withColumn("src", F.coalesce(F.concat(F.lit("="), "source"), F.lit(""))).drop("source").withColumn("tie", F.monotonically_increasing_id())
    placed = keyed.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id()).drop("tie")
    ordered = written(placed.withColumn("part", F.shiftright("at", 33)).withColumn("pos", F.col("at").bitwiseAND(F.lit(_LOW))).drop("at"))
    found = ordered.groupBy("src", "part").agg(F.min("pos").alias("first"), F.count("*").alias("n"))
    by_src, by_part = Window.partitionBy("src"), Window.partitionBy("part")
    spans = found.withColumns({
        "before": F.sum("n").over(by_src.orderBy("part")) - F.col("n"), "size": F.sum("n").over(by_src),
        "opens": (F.min("part").over(by_src) == F.col("part")).cast("long")})
    # Trees are numbered in the order in which they open; one window runs over one row per partition.
    opened = spans.groupBy("part").agg(F.sum("opens").alias("count")).select("part", (F.sum("count").over(Window.orderBy("part")) - F.col("count")).alias("base"))
    trees = spans.filter("opens = 1").withColumn("k", F.row_number().over(by_part.orderBy("first")) - 1).join(opened, "part").select(
        "src", (F.col("base") + F.col("k")).alias("tree"))
    spans = written(spans.join(trees, "src").select("part", "src", "tree", "first", "before", "n", "size"))
    count, most = spans.agg(F.max("tree") + 1, F.max("size")).first()
    places = ordered.join(spans.select("part", "src", "tree", "first", "before", "size"), ["part", "src"])
    held = written(places.withColumn("idx", F.col("before") + F.col("pos") - F.col("first")).drop("src", "first", "before", "pos"))
    return held, spans, count or 0, most or 0


def _folded(nodes: DataFrame, base: int, levels: int) -> DataFrame:
    """``tree, level, idx, size, hash`` of up to ``levels`` levels above the nodes of level ``base``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, starts in whole_groups(batches, ["tree", "block"]):
            tree, block, size = (table.column(c).to_numpy() for c in ("tree", "block", "size"))
            hashes = [h.hex().encode() for h in table.column("hash").to_pylist()]
            out: list[tuple[int, int, int, int, bytes]] = []
            for lo, hi in zip(starts, np.append(starts[1:], table.num_rows)):
                row, first, count = hashes[lo:hi], int(block[lo]) * WAYS ** levels, int(size[lo])
                for level in range(base + 1, base + levels + 1):
                    if count == 1:
                        break
                    row = [parent_hash(row[k:k + WAYS]) for k in range(0, len(row), WAYS)]
                    first, count = first // WAYS, -(-count // WAYS)
                    out += [(int(tree[lo]), level, first + k, count, bytes.fromhex(h.decode())) for k, h in enumerate(row)]
            if out:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary()))], ["tree", "level", "idx", "size", "hash"])

    blocked = nodes.select("tree", F.floor(F.col("idx") / F.lit(WAYS ** levels)).alias("block"), "idx", "size", "hash")
    placed = blocked.repartition("tree", "block").sortWithinPartitions("tree", "block", "idx")
    return placed.mapInArrow(run, "tree long, level int, idx long, size long, hash binary")


def interior(leaves: DataFrame, most: int, levels: int = LEVELS) -> list[DataFrame]:
    """Tables of all nodes above ``leaves`` (``tree, idx, size, hash``), ``levels`` levels each; ``most`` is the greatest tree's size."""
    out, base = [], 0
    while most > 1:
        out.append(written(_folded(leaves, base, levels)))
        base, most = base + levels, -(-most // WAYS ** levels)
        leaves = out[-1].filter((F.col("level") == base) & (F.col("size") > 1))
    return out


def _wanted(spans: DataFrame, trees: int) -> DataFrame:
    """``part, tree, level, idx`` of the nodes that each partition has to fetch, the root among them."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, starts in whole_groups(batches, ["part"]):
            part, tree, before, n, size = (table.column(c).to_numpy() for c in ("part", "tree", "before", "n", "size"))
            for lo, hi in zip(starts, np.append(starts[1:], table.num_rows)):
                asked = [(int(tree[k]), missing_nodes(np.arange(before[k], before[k] + n[k]), int(size[k]))) for k in range(lo, hi)]
                asked.append((TOP, missing_nodes(tree[lo:hi], trees) + [(height(trees), np.zeros(1, np.int64))]))
                flat = [(t, level, idx) for t, found in asked for level, idx in found]
                sizes = [idx.size for _, _, idx in flat]
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.full(sum(sizes), part[lo])), pa.array(np.repeat([t for t, _, _ in flat], sizes).astype(np.int64)),
                    pa.array(np.repeat([v for _, v, _ in flat], sizes).astype(np.int32)), pa.array(np.concatenate([idx for _, _, idx in flat]).astype(np.int64)),
                ], ["part", "tree", "level", "idx"])

    asked = spans.select("part", "tree", "before", "n", "size").repartition("part").sortWithinPartitions("part", "tree")
    return asked.mapInArrow(run, "part long, tree long, level int, idx long")


def _expanded(trees: int, proofs: bool) -> Callable[[pa.Table, pa.Table], pa.Table]:
    top = height(trees)

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        hexed = lambda c: [None if h is None else h.hex().encode() for h in c.to_pylist()]
        fetched: dict[int, dict[tuple[int, int], bytes]] = {}
        for t, level, idx, h in zip(*(right.column(c).to_pylist() for c in ("tree", "level", "idx")), hexed(right.column("hash"))):
            fetched.setdefault(t, {})[level, idx] = h
        published = fetched[TOP].pop((top, 0)) if trees > 1 else fetched[TOP][0, 0]
        tree, idx, size = (left.column(c).to_pylist() for c in ("tree", "idx", "size"))
        own, changed = hexed(left.column("leaf")), hexed(left.column("changed"))
        rows: dict[int, list[int]] = {}
        for k, t in enumerate(tree):
            rows.setdefault(t, []).append(k)
        branches = {t: Branches(size[ks[0]], {idx[k]: own[k] for k in ks}, fetched.get(t, {})) for t, ks in rows.items()}
        tops = Branches(trees, {t: b.root for t, b in branches.items()}, fetched[TOP])
        out: list[tuple] = []
        for k, t in enumerate(tree):
            branch = branches[t]
            proof = branch.proof(idx[k]) + tops.proof(t)
            folded = tops.folded(t, branch.folded(idx[k], changed[k] or own[k]))
            out.append((own[k].decode(), branch.root.decode(), published.decode(), sha256(proof).hexdigest(), folded.decode(), folded == published,
                        proof.decode() if proofs else None))
        names = ("leaf", "subroot", "root", "proof_sha256", "folded_root", "verified", "proof")
        kinds = [pa.string()] * 5 + [pa.bool_(), pa.string()]
        return pa.table([left.column("doc_id"), *[pa.array(c, t) for c, t in zip(zip(*out), kinds)]], names=["doc_id", *names])

    return run


def manifest(docs: DataFrame, tampered: Column | None = None, proofs: bool = False, rows: int = ROWS, levels: int = LEVELS) -> DataFrame:
    """``doc_id, leaf, subroot, root, proof_sha256, folded_root, verified, proof`` for every row of ``docs``.

    A leaf is the hash of a row's five fields. The leaves of a source, by doc_id, are folded three by three into its
    subroot, the subroots, by source, into the root. ``proof`` (null unless ``proofs``) holds the siblings on the way up.
    ``tampered`` is the text that a row has been changed to, null for a row left alone; ``folded_root`` follows from the
    changed leaf and the original siblings, and ``verified`` says whether it is the root.

    Null sources are a source of their own, before all others; null ids come first; rows of equal ids go by their leaf, and
    equal rows are leaves side by side. Further columns are ignored. An empty table gives no rows.
    """
    fields = [F.col("doc_id").cast("long").alias("doc_id"), *[F.col(c).cast("string").alias(c) for c in ("source", "lang", "text")], F.col("n_chars").cast("long").alias("n_chars")]
    told = docs.select(*fields, (F.lit(None).cast("string") if tampered is None else tampered).alias("tampered"))
    hashed = told.select("doc_id", "source", leaf_hash().alias("leaf"), F.when(F.col("tampered").isNotNull(), leaf_hash(text=F.col("tampered"))).alias("changed"))
    leaves, spans, trees, most = numbered(written(hashed), rows)
    own = leaves.select("tree", "idx", "size", F.col("leaf").alias("hash"))
    inner = interior(own, most, levels)
    subroots = own.filter("size = 1").select("tree", "hash")
    for table in inner:
        subroots = subroots.unionByName(table.filter("size = 1").select("tree", "hash"))
    tops = written(subroots.select(F.lit(TOP).cast("long").alias("tree"), F.col("tree").alias("idx"), F.lit(trees).cast("long").alias("size"), "hash"))
    store = None
    for table in [own.withColumn("level", F.lit(0)), *inner, tops.withColumn("level", F.lit(0)), *interior(tops, trees, levels)]:
        nodes = table.select("tree", "level", "idx", "hash")
        store = nodes if store is None else store.unionByName(nodes)
    fetched = _wanted(spans, trees).join(store, ["tree", "level", "idx"])
    return leaves.groupBy("part").cogroup(fetched.groupBy("part")).applyInArrow(
        _expanded(trees, proofs), "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean, proof string")


def without_line_feeds() -> Column:
    """The changed text of rows whose id has an even CRC-32: its line feeds are gone. Null for null texts and other rows."""
    even = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(2)) == 0
    return F.when(even, F.replace(F.col("text").cast("string"), F.lit("\n"), F.lit("")))
