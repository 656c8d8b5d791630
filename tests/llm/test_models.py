"""Archives, classifiers, pieces and vectors: exact round trips, brute force and held-out accuracy."""

import base64
import hashlib
import math
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from test_documents import LONG, SF, awkward, empty

from tickloom.llm import cross_polytope, naive_bayes_support, queries, suffix_pieces, toxicity_trees, warc

PIECES = public_tokenizers.path("piece_bpe_32k.model")


def digest(payload):
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def test_archives(spark):
    pages = {r.page_id: (r.html or "").encode() for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    first = {}
    for k in sorted(pages, reverse=True):
        first[pages[k]] = k
    got = queries.QUERIES["op1_warc_segments"](spark, SF).collect()
    assert len(got) == len(pages)
    for r in got:
        own = pages[r.page_id]
        assert (r.payload_bytes, r.payload_digest, r.error) == (len(own), digest(own), None)
        assert (r.record_type, r.refers_to) == (("response", None) if first[own] == r.page_id else ("revisit", first[own]))


def test_archives_awkward(spark):
    tricky = "WARC/1.1\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n0\r\n\r\né"
    rows = [(1, "http://a/ b\r\nX: 1", tricky, 1), (2, None, None, 1), (3, "u", "", 1), (4, "u", LONG, 1), (5, "u", LONG, 1), (6, "u", tricky, 1), (6, "u", tricky, 1),
            (None, "u", "lonely", 1), (7, "u", "é" * 9000, 1), (8, "u", "x" * 8192, 1)]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string, block int")
    got = {r.page_id: r for r in warc.round_trip(frame, segment=1000, chunk=77, file_records=10).collect()}
    assert len(got) == 9 and all(r.error is None for r in got.values())
    assert [got[k].refers_to for k in (1, 2, 3, 4, 5, 6)] == [None, None, 2, None, 4, 1]
    for k, _, html, _ in rows:
        own = (html or "").encode()
        assert (got[k].payload_bytes, got[k].payload_digest) == (len(own), digest(own))
    alike = warc.round_trip(frame, least_revisit=10**6).filter("record_type = 'revisit'").count()
    assert alike == 0
    assert warc.round_trip(spark.createDataFrame([], frame.schema)).count() == 0


def test_broken_archives(spark):
    whole = warc.page_records(1, "u", b"payload " * 400, None, False, 500, 64)
    other = warc.page_records(2, "u", b"fine " * 400, None, False, 500, 64)

    def read(*parts):
        content = b"".join(x + b"\r\n\r\n" for x in parts)
        frame = spark.createDataFrame([(bytearray(content),)], "content binary")
        return {r.page_id: r for r in warc.read_archives(frame).collect()}

    mixed = read(whole[2], other[1], whole[0], *other[2:], *whole[3:], whole[1], other[0], whole[1])
    assert mixed[1].payload_digest == digest(b"payload " * 400) and mixed[2].payload_bytes == 2000 and mixed[1].error is None
    assert "missing" in read(*whole[:2], *whole[3:])[1].error
    assert read(*whole[:-1])[1].error == "no total length"
    assert read(*whole[:-1], whole[-1].replace(b"Total-Length: ", b"Total-Length: 9"))[1].error == "the total length differs"
    assert read(*whole[1:])[None].payload_bytes is None
    assert read(whole[0].replace(b"Segment-Number: 1", b"Segment-Number: 1").replace(b"payload pay", b"paxload pay", 1), *whole[1:])[1].error == "the payload's digest differs"
    with pytest.raises(ValueError):
        warc.dechunked(b"5\r\nabc")
    assert warc.dechunked(b"3;x=1\r\nabc\r\n0\r\nT: 1\r\n\r\n") == b"abc"
    members = b"".join(__import__("gzip").compress(x + b"\r\n\r\n") for x in whole)
    assert len(list(warc.records(members))) == len(whole)


def accuracy(rows, labels):
    held = [r for r in rows if r.held_out and r.doc_id in labels]
    return np.mean([r.predicted == labels[r.doc_id] for r in held]), len(held)


@pytest.mark.parametrize(("query", "label", "folds", "held", "least"), [("op3_nb_support", "quality", 3, 1, 0.95), ("op6_boosted_toxicity", "toxic", 5, 0, 0.93)])
def test_held_out_accuracy(spark, query, label, folds, held, least):
    sf = SF.replace("0.001", "0.01")
    rows = queries.QUERIES[query](spark, sf).collect()
    labels = {r.doc_id: r[label] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    assert len(rows) == 1000
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % folds == held) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5)
    share, count = accuracy(rows, labels)
    assert count > 50 and share >= least


@pytest.mark.parametrize("run", [naive_bayes_support.quality_scores, toxicity_trees.toxicity_scores])
def test_scores_awkward(spark, run):
    label = "quality" if run is naive_bayes_support.quality_scores else "toxic"
    some = spark.createDataFrame([(i, i % 2, i % 2) for i in range(12)] + [(None, 1, 1), (3, None, None), (3, 1, 0)], "doc_id long, quality int, toxic int")
    none = some.filter("false")
    one = some.filter(f"{label} = 1")
    for labels in (some, none, one):
        rows = run(awkward(spark), labels).collect()
        assert len(rows) == 15 and all(0 <= r.score <= 1 for r in rows)
        by_text = defaultdict(set)
        for r in rows:
            by_text[r.doc_id].add(r.score)
        assert by_text[0] == by_text[1] and by_text[6] == by_text[7]
    assert run(empty(spark), some).count() == 0


def test_dual_coordinate_descent_reaches_the_optimum():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(40, 5))
    signs = np.where(x[:, 0] + 0.3 * rng.normal(size=40) > 0, 1.0, -1.0)
    cuts = np.arange(0, 201, 5)
    upper = np.where(signs > 0, (signs < 0).sum(), (signs > 0).sum()) * 2.0 / 40
    w = naive_bayes_support.dual_coordinate_descent(cuts, np.tile(np.arange(5), 40), x.reshape(-1), signs, 5, epochs=3000)

    def loss(v):
        return 0.5 * v @ v + (upper * np.maximum(0, 1 - signs * (x @ v[:-1] + v[-1]))).sum()

    best = min(loss(w + d) for d in rng.normal(size=(3000, 6)) * 0.05)
    assert loss(w) <= best + 1e-2


def test_toxic_features():
    import pyarrow as pa
    from tickloom.llm.words import text_slices
    texts = ["you are an idiot", "YOU IDIOT!!!", "1d10t and i.d.i.o.t", "nothing at all", ""]
    (_, _, data, offsets), = text_slices(pa.array(texts))
    out = toxicity_trees.dense_features(5, data, offsets, toxicity_trees.names(toxicity_trees.INSULTS), toxicity_trees.names([]), toxicity_trees.names(toxicity_trees.SECOND_PERSON))
    name = toxicity_trees.FEATURES.index
    assert out[:, name("insults")].tolist() == [1, 1, 1, 0, 0] and out[:, name("hidden")].tolist() == [0, 0, 1, 0, 0]
    assert out[:, name("near_you")].tolist() == [1, 1, 0, 0, 0] and out[1, name("loud_words")] == 1


def test_pieces_equal_the_library(spark):
    assert all(r.round_trip for r in queries.QUERIES["op7_suffix_pieces"](spark, SF).collect())
    model = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    rng = np.random.default_rng(4)
    letters = list(" \n\t▁abcdefghijklmnopqrstuvwxyzéß中文🙂́​!?.,0189ABC")
    texts = ["".join(rng.choice(letters, rng.integers(0, 50))) for _ in range(300)] + ["", " ", "a" * 2000, " " * 300 + "x" + " " * 40, "\x00a\x00", LONG]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    encoded = suffix_pieces.encode_documents(frame, PIECES)
    for r in encoded.withColumn("back", suffix_pieces.decode_ids("ids", PIECES)).collect():
        want = model.encode(texts[r.doc_id])
        assert r.ids == want and r.n_ids == len(want) and r.ids_crc32 == zlib.crc32(np.array(want, "<u4").tobytes())
        assert r.back == model.decode(want)
    rows = suffix_pieces.encode_documents(awkward(spark), PIECES).collect()
    assert len(rows) == 15 and suffix_pieces.encode_documents(empty(spark), PIECES).count() == 0


def test_long_runs_equal_the_library():
    import base64
    import random
    import time
    model, pieces = sentencepiece.SentencePieceProcessor(model_file=PIECES), suffix_pieces.Pieces(PIECES)
    rng = random.Random(5)
    letters = "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(200_000))
    texts = [letters, base64.b64encode(rng.randbytes(60_000)).decode(), "我喜欢你。今天天气很好！" * 2000, "ab" * 40_000, "x" * 70_000, "é🙂" * 5000 + letters[:100],
             " ".join([letters[:300], "short words", letters[300:700], "中文" * 100])]
    for text in texts:
        began = time.process_time()
        own = pieces.encode([text])[0].tolist()
        assert time.process_time() - began < 5 and own == model.encode(text), text[:20]
    assert [x.tolist() for x in pieces.encode(texts)] == [model.encode(x) for x in texts]


def test_trees_agree_with_the_merges():
    pieces = suffix_pieces.Pieces.of(PIECES)

    def merged(symbols):
        while len(symbols) > 1:
            best = min((pieces.rank.get(a + b, (np.inf,))[0], i) for i, (a, b) in enumerate(zip(symbols, symbols[1:])))
            if best[0] == np.inf:
                break
            symbols[best[1]:best[1] + 2] = ["".join(symbols[best[1]:best[1] + 2])]
        return symbols

    rng = np.random.default_rng(2)
    ids = rng.choice(pieces.ids, 3000)
    assert all(pieces.made[k] == (merged(list(pieces.texts[k])) == [pieces.texts[k]]) for k in ids.tolist())
    left = ids[pieces.made[ids]]
    right = rng.permutation(left)
    for a, b, apart in zip(left.tolist(), right.tolist(), pieces.follows(left, right).tolist()):
        assert apart == (merged(list(pieces.texts[a] + pieces.texts[b])) == [pieces.texts[a], pieces.texts[b]])


def test_suffix_ranges():
    pieces = suffix_pieces.Pieces.of(PIECES)
    text = "▁the▁other▁theatre"
    start, end, ids = pieces.edges(np.array([ord(c) for c in text]))
    want = sorted((a + len(p), a, k) for p, (_, k) in pieces.rank.items() for a in range(len(text)) if text.startswith(p, a))
    assert list(zip(end.tolist(), start.tolist(), ids.tolist())) == want


def brute_vectors(rows, threshold=0.9):
    good = [(k, np.array(v, float)) for k, v in rows if k is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    links = defaultdict(int)
    label = {k: k for k, _ in rows}
    pairs = []
    for i, (a, x) in enumerate(good):
        for b, y in good[i + 1:]:
            if len(x) == len(y) and x @ y / math.sqrt(x @ x) / math.sqrt(y @ y) >= threshold:
                links[a] += 1
                links[b] += 1
                pairs.append((a, b))
    for _ in rows:
        for a, b in pairs:
            label[a] = label[b] = min(label[a], label[b])
    return links, label


@pytest.mark.parametrize("block", [cross_polytope.BLOCK, 3])
def test_near_vectors(spark, block):
    rng = np.random.default_rng(6)
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    for k in range(0, 120, 3):  # groups of near copies with cosines of about 0.97, and one larger group
        own = np.array(rows[k][1])
        noise = rng.normal(size=(20 if k == 30 else 4, own.size)) * np.linalg.norm(own) / 8 * 0.12
        rows += [(1000 + 40 * k + j, (own + n).tolist()) for j, n in enumerate(noise)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    rows = [(r.vec_id, r.embedding) for r in frame.collect()]
    links, label = brute_vectors(rows)
    got = cross_polytope.near_vectors(frame, block=block).collect()
    assert len(got) == len(rows) and sum(links.values()) > 100
    for r in got:
        assert (r.n_links, r.component_id, r.kept) == (links[r.vec_id], label[r.vec_id], label[r.vec_id] == r.vec_id)


def test_recall_at_the_threshold():
    rng = np.random.default_rng(8)
    x = rng.normal(size=(3000, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    side = rng.normal(size=x.shape)
    side -= (side * x).sum(1, keepdims=True) * x
    side /= np.linalg.norm(side, axis=1, keepdims=True)
    for cosine, least in ((0.9, 0.9), (0.95, 0.97)):
        y = cosine * x + math.sqrt(1 - cosine**2) * side
        a, b = (cross_polytope.probe_codes(v, cross_polytope.TABLES, 3, cross_polytope.PROBES) for v in (x, y))
        met = cross_polytope._first_meeting(a, b, cross_polytope.TABLES, cross_polytope.PROBES) < np.uint64(0xFFFFFFFFFFFFFFFF)
        assert met.mean() >= least


@pytest.mark.parametrize("count", [1_000, 200_000, 1_000_000, 100_000_000])
def test_recall_at_every_size(count):
    """The layouts chosen for 2, 3, 4 and 5 hashes."""
    hashes, tables, probes = cross_polytope.layout_for(count, 64, 0.9)
    assert hashes == cross_polytope.hashes_for(count, 64) == {1_000: 2, 200_000: 3, 1_000_000: 4, 100_000_000: 5}[count]
    met = cross_polytope._proposed(64, hashes, 0.9, tables, probes, 3000, 21)
    assert met.any(axis=(1, 2)).mean() >= 0.98


def test_recall_in_few_dimensions():
    for dim in (2, 8):
        met = cross_polytope._proposed(dim, *(x := cross_polytope.layout_for(1_000_000, dim, 0.9))[:1], 0.9, *x[1:], 1000, 22)
        assert met.any(axis=(1, 2)).mean() >= 0.97


def test_vectors_awkward(spark):
    rows = [(1, [1.0, 0.0, 0.0]), (2, [2.0, 0.0, 0.0]), (3, [1.0, 0.0, 0.0]), (4, None), (5, []), (6, [0.0, 0.0, 0.0]), (7, [1.0, None, 0.0]), (8, [1.0, float("nan"), 0.0]),
            (9, [float("inf"), 0.0, 0.0]), (None, [1.0, 0.0, 0.0]), (10, [1e-300, 0.0, 0.0]), (11, [0.0, 1e300, 1e300]), (12, [1.0, 0.0]), (13, [0.9, 0.1, 0.05]), (14, [-1.0, 0.0, -0.0])]
    frame = spark.createDataFrame([(k, v, 1, 1) for k, v in rows], "vec_id long, embedding array<double>, node int, key int")
    links, label = brute_vectors(rows)
    got = cross_polytope.near_vectors(frame).collect()
    assert sorted((r.vec_id or 0, r.n_links, r.component_id or 0) for r in got) == sorted((k or 0, links[k] if k else 0, label[k] or 0) for k, _ in rows)
    assert cross_polytope.near_vectors(frame.filter("false")).count() == 0
    same = spark.createDataFrame([(1, [1.0, 2.0]), (1, [1.0, 2.0]), (2, [-1.0, 2.0])], "vec_id long, embedding array<float>")
    assert sorted((r.vec_id, r.n_links) for r in cross_polytope.near_vectors(same).collect()) == [(1, 1), (1, 1), (2, 0)]
