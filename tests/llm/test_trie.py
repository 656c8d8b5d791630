"""The prefix trie against a dictionary of prefixes, with blocks so small that most nodes reach over several."""

import hashlib
import random
import zlib

import numpy as np
import pytest

from tickloom.llm import prefix_trie as t
from tickloom.llm import queries

SF = "/root/testdata/sf0.001"
NAMES = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def wanted(rows):
    own = {}
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            digest = hashlib.md5(f"{len(role.encode())}:{role}{text}".encode()).hexdigest()
            own.setdefault(conv, []).append((turn is not None, turn or 0, digest, role, text))
    own = {c: [x[3:] for x in sorted(v)] for c, v in own.items()}
    built = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        built[c] = own.get(c - int(np.fmod(c, 5)), [])[:h] + turns[h:]
    nodes = {}
    for c, turns in built.items():
        for d in range(len(turns) + 1):
            nodes.setdefault(tuple(turns[:d]), []).append(c)
    children, leaves, saved = {}, dict.fromkeys(nodes, 0), dict.fromkeys(nodes, 0)
    for path in nodes:
        if path:
            children[path[:-1]] = children.get(path[:-1], 0) + 1
    for path, members in nodes.items():
        for d in range(len(path) + 1):
            leaves[path[:d]] += path not in children
            saved[path[:d]] += (len(members) - 1) * len(path[-1][1].encode()) if path else 0
    out = []
    for path, members in nodes.items():
        ends = ",".join(str(c) for c in sorted(members) if len(built[c]) == len(path))
        out.append((min(members), len(path), min(nodes[path[:-1]]) if path else None, len(members), children.get(path, 0), leaves[path], saved[path],
                    hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def result(frame):
    return sorted((tuple(r) for r in frame.select(*NAMES).collect()), key=str)


def drawn(seed, convs, words, most):
    rng = random.Random(seed)
    return [(c, k, rng.choice(["user", "assistant"]) if words > 2 else "user", "w" * rng.randrange(words)) for c in range(-convs // 4, convs) for k in range(rng.randrange(1, most))]


CASES = {
    "drawn": drawn(1, 60, 3, 12),
    "few words": drawn(2, 120, 2, 14),
    "hot first turn": [(c, k, "user", "the same" if k < 3 else f"{c % 7}") for c in range(90) for k in range(1 + c % 6)],
    "copies": [(c, k, "user", "copy é") for c in range(80) for k in range(4)],
    "one long": [(c, k, "user", "x" if c % 2 else f"{k}") for c in (10, 11, 12, 13) for k in range(400)] + [(20 + c, 0, "user", "y") for c in range(30)],
    "awkward": [(None, 0, "user", "no id"), (1, None, None, None), (1, 0, "user", ""), (1, 0, "user", ""), (1, 0, "user", "tie"), (2, 5, "", None), (3, 1, None, "x"), (4, 1, "u", "x"),
                (5, 0, "user", "long text " * 100000), (6, 0, "user", "long text " * 100000), (-7, 0, "a", "b"), (-9, 0, "a", "b"), (0, 0, "ab", "c"), (9, 0, "a", "bc")],
}


@pytest.mark.parametrize("name", CASES)
@pytest.mark.parametrize("block", [1 << 15, 24])
def test_nodes(spark, name, block):
    rows = CASES[name]
    frame = spark.createDataFrame([(*r, 1, "x", 2) for r in rows], "conv_id long, turn long, role string, text string, depth long, key string, n long").repartition(3)
    got = t.prefix_trie(frame, block=block)
    assert result(got) == wanted(rows)
    for r in got.filter("depth = 0").collect():
        assert r.first_rank == 0 and r.last_rank >= r.n_leaves - 1


def test_empty(spark):
    frame = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert t.prefix_trie(frame).count() == 0


def test_query(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    got = queries.QUERIES["op12_interval_trie"](spark, SF)
    assert got.columns == list(NAMES) and result(got) == wanted(rows)


def test_range_minimum():
    rng = np.random.default_rng(5)
    for size in (1, 2, 7, 64, 100):
        values = rng.integers(0, 6, size)
        minima = t.RangeMinimum(values)
        for at in range(size):
            for least in range(7):
                lo = hi = at
                while hi + 1 < size and values[hi + 1] >= least:
                    hi += 1
                while lo > 0 and values[lo] >= least:
                    lo -= 1
                assert (minima.left(np.array([at]), np.array([least]))[0], minima.right(np.array([at]), np.array([least]))[0]) == (lo, hi)
            for hi in range(at, size):
                assert minima.least(np.array([at]), np.array([hi]))[0] == values[at:hi + 1].min()
