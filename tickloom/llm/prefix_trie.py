"""Prefix trie of conversations: sorted sequences of turns, their longest common prefixes, range minima by sparse tables.

Conversations become sequences of turn digests, which are sorted into blocks of neighbours. In a block every prefix
looks up how far to the left and to the right the range minimum of the common prefixes stays at its length; both ends
are found by themselves and give the interval of members, a node. A second sparse table over the blocks' minima carries
the intervals that reach over block ends, and only these are summed across blocks.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickloom.llm.common import written

# Turns of a block and most blocks (three numbers a block reach the driver); conversations of a partition of ids.
BLOCK, BLOCKS, IDS = 1 << 15, 1 << 14, 1 << 16
WIDTH = 16
GROUP, HEADS = 5, 9
_FAR = (1 << 62)
_NONE = sha256(b"").hexdigest()
NODE = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string, first_rank long, last_rank long"


class RangeMinimum:
    """Sparse table of the minima of all runs of 1, 2, 4 ... values."""

    def __init__(self, values: np.ndarray):
        self.rows = [values]
        step = 1
        while 2 * step <= values.size:
            last = self.rows[-1]
            self.rows.append(np.minimum(last[:-step], last[step:]))
            step *= 2

    def right(self, at: np.ndarray, least: np.ndarray) -> np.ndarray:
        """The last place up to which all values after ``at`` are ``least`` or more, by binary search."""
        at = at.copy()
        for k in range(len(self.rows) - 1, -1, -1):
            row = self.rows[k]
            on = (at + 1 < row.size) & (row[np.minimum(at + 1, row.size - 1)] >= least)
            at[on] += 1 << k
        return at

    def left(self, at: np.ndarray, least: np.ndarray) -> np.ndarray:
        """The first place after which all values up to ``at`` are ``least`` or more, by binary search."""
        at = at.copy()
        for k in range(len(self.rows) - 1, -1, -1):
            row = self.rows[k]
            begin = at - (1 << k) + 1
            on = (begin > 0) & (row[np.maximum(begin, 0)] >= least)
            at[on] -= 1 << k
        return at

    def least(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """The minimum of the values from ``lo`` to ``hi``, both included."""
        out = np.empty(lo.size, self.rows[0].dtype)
        k = np.frexp((hi - lo + 1).astype(np.float64))[1] - 1
        for level in np.unique(k):
            at = np.flatnonzero(k == level)
            out[at] = np.minimum(self.rows[level][lo[at]], self.rows[level][hi[at] - (1 << int(level)) + 1])
        return out


def turn_digest(role: Column, text: Column) -> Column:
    return F.md5(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text).cast("binary"))


def rebuilt(conversations: DataFrame) -> DataFrame:
    """``conv_id, turns`` (digest and text bytes): the first h original turns of the conversation that opens the group of
    five ids, then a conversation's own turns after its first h.

    Turns go by ``turn`` (null first), equal ones by their digest. Rows without a conv_id are left out. Ids of a group
    meet in one shuffle; a conversation is one example, so its digests stand in one row.
    """
    text, role = F.coalesce(F.col("text").cast("string"), F.lit("")), F.coalesce(F.col("role").cast("string"), F.lit(""))
    rows = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.struct(F.col("turn").isNotNull().alias("numbered"), F.coalesce(F.col("turn").cast("long"), F.lit(0)).alias("turn"),
                 turn_digest(role, text).alias("digest"), F.octet_length(text).cast("long").alias("bytes")).alias("row")).filter("conv_id is not null")
    grouped = rows.withColumn("base", F.col("conv_id") - F.col("conv_id") % GROUP).repartition("base")
    own = grouped.groupBy("base", "conv_id").agg(F.array_sort(F.collect_list("row")).alias("rows"))
    turns = own.select("base", F.struct("conv_id", F.transform("rows", lambda r: F.struct(r["digest"].alias("digest"), r["bytes"].alias("bytes"))).alias("turns")).alias("conv"))
    whole = turns.groupBy("base").agg(F.collect_list("conv").alias("convs"))
    opening = F.get(F.filter("convs", lambda c: c["conv_id"] == F.col("base")), F.lit(0))["turns"]
    each = whole.withColumn("opening", F.slice(opening, 1, HEADS - 1)).select("opening", F.explode("convs").alias("c"))
    heads = F.pmod(F.crc32(F.col("c.conv_id").cast("string").cast("binary")), F.lit(HEADS)).cast("int")
    joined = F.concat(F.coalesce(F.slice("opening", F.lit(1), heads), F.slice("c.turns", 1, 0)), F.slice("c.turns", heads + 1, F.size("c.turns")))
    return each.select("c.conv_id", joined.alias("turns"))


def _distinct(convs: DataFrame) -> DataFrame:
    """``key, sizes, n, conv_id, ends_sha256`` per different sequence: its digests, text bytes, members, smallest member and
    the hash of its members' ids.

    Ids are sorted by range, so that a sequence with very many members is spread; each task joins its ids to texts, and
    these few texts are hashed one after the other.
    """
    key = F.unhex(F.array_join(F.transform("turns", lambda t: t["digest"]), ""))
    keyed = convs.select("conv_id", key.alias("key"), F.transform("turns", lambda t: t["bytes"]).alias("sizes"))
    held = written(keyed.withColumn("seq", F.unhex(F.md5("key"))))
    parts = max(1, -(-held.count() // IDS))

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seq, ids = batch.column("seq").to_pylist(), batch.column("conv_id").to_pylist()
            cuts = [k for k in range(len(seq)) if k == 0 or seq[k] != seq[k - 1]]
            ends = [*cuts[1:], len(seq)]
            yield pa.RecordBatch.from_arrays([
                *[batch.column(c).take(pa.array(cuts, pa.int64())) for c in ("seq", "key", "sizes")], pa.array([ids[a] for a in cuts], pa.int64()),
                pa.array([b - a for a, b in zip(cuts, ends)], pa.int64()), pa.array([",".join(map(str, ids[a:b])) for a, b in zip(cuts, ends)], pa.string()),
            ], ["seq", "key", "sizes", "conv_id", "n", "ids"])

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held_row, count, digest = None, None, 0, None
        schema = pa.schema([("key", pa.binary()), ("sizes", pa.list_(pa.int64())), ("n", pa.int64()), ("conv_id", pa.int64()), ("ends_sha256", pa.string())])
        for batch in batches:
            done = []
            for seq, row_key, sizes, conv, n, ids in zip(*(batch.column(c).to_pylist() for c in ("seq", "key", "sizes", "conv_id", "n", "ids"))):
                if seq == now:
                    digest.update(b",")
                else:
                    if now is not None:
                        done.append((*held_row, count, digest.hexdigest()))
                    now, held_row, count, digest = seq, (row_key, sizes, conv), 0, sha256()
                digest.update(ids.encode())
                count += n
            yield _batch(done, schema)
        if now is not None:
            yield _batch([(*held_row, count, digest.hexdigest())], schema)

    def _batch(done: list, schema: pa.Schema) -> pa.RecordBatch:
        columns = list(zip(*done)) if done else [()] * 5
        order = (0, 1, 3, 2, 4)  # key, sizes, n, conv_id, ends
        return pa.RecordBatch.from_arrays([pa.array(columns[k], f.type) for k, f in zip(order, schema)], schema=schema)

    ranged = held.repartitionByRange(parts, "seq", "conv_id").sortWithinPartitions("seq", "conv_id")
    spread = ranged.mapInArrow(pieces, "seq binary, key binary, sizes array<long>, conv_id long, n long, ids string")
    return spread.repartition("seq").sortWithinPartitions("seq", "conv_id").mapInArrow(
        whole, "key binary, sizes array<long>, n long, conv_id long, ends_sha256 string")


def _shared(a: bytes, b: bytes) -> int:
    """Turns that two sequences have in common at their beginning."""
    size = min(len(a), len(b))
    other = np.frombuffer(a, np.uint8, size) != np.frombuffer(b, np.uint8, size) if size else np.zeros(0, bool)
    return (int(other.argmax()) if other.any() else size) // WIDTH


def _with_lcp(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds the turns in common with the row before, -1 for a partition's first row."""
    last = None
    for batch in batches:
        keys = batch.column("key").to_pylist()
        before = [last, *keys[:-1]]
        yield batch.append_column("lcp", pa.array([-1 if a is None else _shared(a, b) for a, b in zip(before, keys)], pa.int64()))
        last = keys[-1] if keys else last


class Blocks:
    """What all tasks know of the blocks: common prefix with the block before, least one inside, rows before."""

    def __init__(self, rows: list):
        self.place = {r["block"]: k for k, r in enumerate(rows)}
        self.entry = np.array([r["entry"] for r in rows] + [-1], np.int64)
        inner = np.array([_FAR if r["inner"] is None else r["inner"] for r in rows], np.int64)
        self.before = np.concatenate([[0], np.cumsum([r["rows"] for r in rows])]).astype(np.int64)
        self.minima = RangeMinimum(np.stack([self.entry[:-1], inner], 1).ravel()[1:]) if rows else None

    def owner(self, block: int, depth: np.ndarray) -> np.ndarray:
        """The block in which a prefix of ``depth`` turns that reaches into ``block`` from the left begins."""
        return (self.minima.left(np.full(depth.size, 2 * block - 1), depth) + 1) // 2


def _edges(blocks: Blocks) -> Callable[[pa.Table], pa.Table]:
    """The nodes of a block that reach over its ends, with what the block adds to them."""
    def run(table: pa.Table) -> pa.Table:
        order = np.argsort(table.column("pos").to_numpy())
        lcp, n, conv = (table.column(c).to_numpy()[order].copy() for c in ("lcp", "n", "conv_id"))
        name = table.column("block")[0].as_py()
        b, last = blocks.place[name], lcp.size - 1
        lcp[0] = blocks.entry[b]
        minima = RangeMinimum(lcp)
        into, out = np.arange(lcp[0] + 1), np.arange(blocks.entry[b + 1] + 1)
        left = minima.left(np.full(out.size, last), out)
        out, left = out[(left > 0) | (out > lcp[0])], left[(left > 0) | (out > lcp[0])]
        depth = np.concatenate([into, out])
        lo = np.concatenate([np.zeros(into.size, np.int64), left])
        hi = np.concatenate([minima.right(np.zeros(into.size, np.int64), into), np.full(out.size, last)])
        owner = np.concatenate([blocks.owner(b, into), np.full(out.size, b)])
        total = np.concatenate([[0], np.cumsum(n)])
        return pa.table({"block": pa.array(np.full(depth.size, name)), "row": pa.array(lo), "depth": pa.array(depth), "owner": pa.array(owner),
                         "n": pa.array(total[hi + 1] - total[lo]), "conv_id": pa.array(RangeMinimum(conv).least(lo, hi))})

    return run


def _nodes(blocks: Blocks) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """The nodes of a block; those that reach over its ends with their ``owner`` block, to be summed."""
    def run(table: pa.Table, resolved: pa.Table) -> pa.Table:
        table = table.take(pa.array(np.argsort(table.column("pos").to_numpy())))
        b = blocks.place[table.column("block")[0].as_py()]
        lcp, n, conv = (table.column(c).to_numpy().copy() for c in ("lcp", "n", "conv_id"))
        lists = table.column("sizes").combine_chunks()
        sizes = lists.flatten().to_numpy(zero_copy_only=False)
        turns = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        rows = lcp.size
        lcp[0], beyond = blocks.entry[b], blocks.entry[b + 1]
        # Every prefix of every row, the empty one included: candidate off[row] + depth.
        off = np.concatenate([[0], np.cumsum(turns + 1)])
        row = np.repeat(np.arange(rows), turns + 1)
        depth = np.arange(off[-1]) - off[row]
        weight = np.zeros(off[-1], np.int64)
        weight[depth > 0] = sizes
        minima = RangeMinimum(lcp)
        left, right = minima.left(row, depth), minima.right(row, depth)
        name = off[left] + depth  # the same for all members of an interval
        at = np.flatnonzero(left == row)
        lo, hi, deep = row[at], right[at], depth[at]
        from_left, to_right = (lo == 0) & (deep <= lcp[0]), (hi == rows - 1) & (deep <= beyond)
        members, smallest, owner = (np.full(off[-1], v, np.int64) for v in (0, 0, -1))
        total = np.concatenate([[0], np.cumsum(n)])
        members[at] = total[hi + 1] - total[lo]
        smallest[at] = RangeMinimum(conv).least(lo, hi)
        known = off[resolved.column("row").to_numpy()] + resolved.column("depth").to_numpy()
        members[known], smallest[known] = resolved.column("n").to_numpy(), resolved.column("conv_id").to_numpy()
        owner[known] = resolved.column("owner").to_numpy()
        begins = ~from_left
        parent = np.where(deep > 0, name[at - 1], 0)
        children = np.bincount(parent[begins & (deep > 0)], minlength=off[-1])
        saved = np.zeros(off[-1], np.int64)
        saved[at[begins]] = (members[at[begins]] - 1) * weight[at[begins]]
        saved = np.concatenate([[0], np.cumsum(saved)])
        leaves = np.concatenate([[0], np.cumsum(np.append(lcp[1:], beyond) < turns)])
        ends = table.column("ends_sha256").to_pylist()
        said = [None if not new else ends[r] if turns[r] == d else _NONE for new, r, d in zip(begins, lo, deep)]
        edge = from_left | to_right
        return pa.table({
            "conv_id": pa.array(smallest[at]), "depth": pa.array(deep), "parent_conv_id": pa.array(smallest[parent], mask=deep == 0),
            "n_convs": pa.array(members[at]), "n_children": pa.array(children[at].astype(np.int64)), "n_leaves": pa.array((leaves[hi + 1] - leaves[lo]).astype(np.int64)),
            "saved_tokens": pa.array(saved[off[hi + 1]] - saved[at]), "ends_sha256": pa.array(said, pa.string()),
            "first_rank": pa.array(blocks.before[b] + lo), "last_rank": pa.array(blocks.before[b] + hi), "owner": pa.array(owner[at], mask=~edge)})

    return run


def prefix_trie(conversations: DataFrame, block: int = BLOCK) -> DataFrame:
    """A row per node of the trie of rebuilt conversations (see :func:`rebuilt`).

    ``conv_id`` smallest member, ``depth``, ``parent_conv_id`` (null for the root), ``n_convs`` members, ``n_children``,
    ``n_leaves`` childless nodes in the subtree, ``saved_tokens`` the subtree's text bytes that members share, counted as
    often as they are spared, ``ends_sha256`` of the ids of the members that end here, ``first_rank`` and ``last_rank`` the
    member interval among the different sequences. Null roles and texts are empty; repeated rows are turns of their own;
    further columns are ignored. No conversation with an id gives no node.
    """
    sequences = written(_distinct(rebuilt(conversations)))
    turns = sequences.agg(F.sum(F.octet_length("key") / F.lit(WIDTH) + F.lit(1))).first()[0] or 0
    parts = max(1, -(-int(turns) // max(block, -(-int(turns) // BLOCKS))))
    ranged = sequences.repartitionByRange(parts, "key").sortWithinPartitions("key")
    shaped = ranged.mapInArrow(_with_lcp, sequences.schema.simpleString()[len("struct<"):-1] + ",lcp:bigint").withColumn("at", F.monotonically_increasing_id())
    ordered = written(shaped.withColumns({"block": F.shiftright("at", 33), "pos": F.col("at").bitwiseAND(F.lit((1 << 33) - 1))}).drop("at"))
    bounds = ordered.groupBy("block").agg(
        F.min_by("key", "pos").alias("first"), F.max_by("key", "pos").alias("last"), F.min(F.when(F.col("pos") > 0, F.col("lcp"))).alias("inner"), F.count("*").alias("rows"))
    joined = bounds.withColumn("before", F.lag("last").over(Window.orderBy("block")))

    def entry(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [-1 if a is None else _shared(a, b) for a, b in zip(batch.column("before").to_pylist(), batch.column("first").to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column("block"), pa.array(found, pa.int64()), batch.column("inner"), batch.column("rows")], ["block", "entry", "inner", "rows"])

    narrow = joined.select("block", "before", "first", "inner", "rows").mapInArrow(entry, "block long, entry long, inner long, rows long")
    blocks = Blocks(sorted(narrow.collect(), key=lambda r: r["block"]))
    partial = written(ordered.select("block", "pos", "lcp", "n", "conv_id").groupBy("block").applyInArrow(
        _edges(blocks), "block long, row long, depth long, owner long, n long, conv_id long"))
    totals = partial.groupBy("owner", "depth").agg(F.sum("n").alias("n"), F.min("conv_id").alias("conv_id"))
    resolved = partial.drop("n", "conv_id").join(totals, ["owner", "depth"])
    found = written(ordered.drop("key").groupBy("block").cogroup(resolved.groupBy("block")).applyInArrow(_nodes(blocks), NODE + ", owner long"))
    across = found.filter("owner is not null").groupBy("owner", "depth").agg(
        F.max("conv_id").alias("conv_id"), F.max("parent_conv_id").alias("parent_conv_id"), F.max("n_convs").alias("n_convs"),
        *[F.sum(c).alias(c) for c in ("n_children", "n_leaves", "saved_tokens")], F.max("ends_sha256").alias("ends_sha256"),
        F.min("first_rank").alias("first_rank"), F.max("last_rank").alias("last_rank"))
    return found.filter("owner is null").drop("owner").unionByName(across.drop("owner"))
