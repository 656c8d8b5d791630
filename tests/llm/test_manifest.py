"""Merkle manifests against a tree folded in plain Python, over partitions and blocks of few leaves."""

import hashlib
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tickloom.llm import merkle_manifest as m
from tickloom.llm import queries

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, source string, lang string, n_chars long, text string, tree int, src string, part int, leaf string"


def h(text):
    return hashlib.sha256(text.encode()).hexdigest()


def fold(row):
    """Levels of a tree from its leaves up."""
    levels = [row]
    while len(levels[-1]) > 1:
        last = levels[-1]
        levels.append([h("".join(last[k:k + 3])) for k in range(0, len(last), 3)])
    return levels


def siblings(levels, i):
    out = []
    for row in levels[:-1]:
        out.append((row[i // 3 * 3:i], row[i + 1:i // 3 * 3 + 3]))
        i //= 3
    return out


def leaf(row, text):
    fields = [row[0], row[1], row[2], row[3], text]
    return h("".join("-" if f is None else f"{len(str(f).encode())}:{f}" for f in fields))


def wanted(rows):
    by_source = {}
    for r in rows:
        by_source.setdefault(r[1], []).append((r[0] is not None, r[0] or 0, leaf(r, r[4]), r))
    sources = sorted(by_source, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for s in sources:
        by_source[s].sort(key=lambda x: x[:3])
        trees[s] = fold([x[2] for x in by_source[s]])
    top = fold([trees[s][-1][0] for s in sources])
    out = []
    for k, s in enumerate(sources):
        for i, (_, _, own, r) in enumerate(by_source[s]):
            sides = siblings(trees[s], i) + siblings(top, k)
            even = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0
            node = leaf(r, r[4].replace("\n", "")) if even and r[4] is not None else own
            for before, after in sides:
                node = h("".join([*before, node, *after]))
            proof = "".join("".join(a + b) for a, b in sides)
            out.append((r[0], own, trees[s][-1][0], top[-1][0], h(proof), node, node == top[-1][0]))
    return sorted(out, key=str)


def result(frame):
    return sorted((tuple(r) for r in frame.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified").collect()), key=str)


def test_query(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "source", "lang", "n_chars", "text")
    got = result(queries.QUERIES["op13_octopus_manifest"](spark, SF))
    assert got == wanted([tuple(r) for r in docs.collect()])
    assert {r[6] for r in got} == {True, False}


def awkward():
    rows = [(i, "big", "en", 3, f"text\n{i}") for i in range(100)] + [(i, f"s{i % 11}é", None, None, None if i % 2 else "a\nb") for i in range(40)]
    rows += [(None, None, None, None, None), (None, None, "en", 1, "x\ny"), (7, None, "en", 1, ""), (-5, "", "en", 1, "\n"), (5, "big", "en", 3, "text\n5"), (5, "big", "en", 3, "another\n")]
    return rows + [(1000, "same", "en", 1, "copy\n")] * 30 + [(2000, "long", "de", 9, "long line\n" * 200000)]


@pytest.mark.parametrize("rows,levels", [(7, 1), (20, 2), (1000, 8)])
def test_awkward_rows_over_small_partitions(spark, rows, levels):
    data = awkward()
    docs = spark.createDataFrame([(*r, 1, "z", 2, "w") for r in data], SCHEMA).repartition(3)
    assert result(m.manifest(docs, m.without_line_feeds(), rows=rows, levels=levels)) == wanted(data)


@pytest.mark.parametrize("count", [0, 1, 2, 4])
def test_few_rows(spark, count):
    data = [(i, "s", "en", 1, f"t\n{i}") for i in range(count)]
    docs = spark.createDataFrame([(*r, 1, "z", 2, "w") for r in data], SCHEMA)
    assert result(m.manifest(docs, m.without_line_feeds())) == wanted(data)


def test_proofs_and_no_tampering(spark):
    docs = spark.createDataFrame([(*r, 1, "z", 2, "w") for r in awkward()], SCHEMA)
    for r in m.manifest(docs, proofs=True, rows=16, levels=2).collect():
        assert r.verified and r.folded_root == r.root and h(r.proof) == r.proof_sha256 and len(r.proof) % 64 == 0


def test_every_proof_follows_from_the_missing_nodes():
    rng = np.random.default_rng(3)
    for size in (1, 2, 3, 4, 10, 27, 28, 100):
        levels = fold([h(str(k)) for k in range(size)])
        for _ in range(6):
            known = np.flatnonzero(rng.random(size) < rng.random()) if size > 1 else np.array([0])
            known = known if known.size else np.array([size - 1])
            asked = [(v, int(i)) for v, found in m.missing_nodes(known, size) for i in found]
            branch = m.Branches(size, {int(i): levels[0][i].encode() for i in known}, {(v, i): levels[v][i].encode() for v, i in asked})
            assert branch.root.decode() == levels[-1][0]
            for i in known:
                assert branch.proof(int(i)).decode() == "".join("".join(a + b) for a, b in siblings(levels, int(i)))
            # Least: no asked node follows from the known leaves, and none is asked for twice.
            above = {(v, int(i) // 3 ** v) for i in known for v in range(len(levels))}
            assert len(asked) == len(set(asked)) and not above & set(asked)


def test_changed_field_does_not_verify(spark):
    docs = spark.createDataFrame([(i, "s", "en", 1, f"t{i}") for i in range(50)], "doc_id long, source string, lang string, n_chars long, text string")
    got = m.manifest(docs, F.when(F.col("doc_id") == 17, F.lit("other")), rows=10, levels=1).collect()
    assert [r.doc_id for r in got if not r.verified] == [17]
