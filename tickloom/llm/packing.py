"""Best-fit packing of token pieces, repacked until a lower bound certifies the number of bins or nothing is gained."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.llm.common import small_batches, whole_groups, written
from tickloom.llm.word_tokens import WordTokens

CAPACITY, END_ID, PARTITION_ROWS, ROUNDS, TEXTS = 4096, 1, 1 << 16, 4, 256


def token_pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID, keep_ids: bool = False) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32`` (and ``ids``): each text's ids, then ``end_id``, cut at ``capacity``.

    A null text counts as empty and gives the end id alone. Repeated rows give repeated pieces.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = WordTokens.of(tokenizer)
        for batch in batches:
            rows, piece, start, length, crc, chunks = [], [], [], [], [], []
            for low in range(0, batch.num_rows, TEXTS):
                texts = [t or "" for t in batch.column("text").slice(low, TEXTS).to_pylist()]
                for k, found in enumerate(encoder.encode(texts), low):
                    ids = np.append(found, np.uint32(end_id)).astype("<u4")
                    for j, at in enumerate(range(0, ids.size, capacity)):
                        own = ids[at:at + capacity]
                        rows.append(k)
                        piece.append(j)
                        start.append(at)
                        length.append(own.size)
                        crc.append(zlib.crc32(own.tobytes()))
                        if keep_ids:
                            chunks.append(own.astype(np.int32))
            out = [batch.column("doc_id").take(pa.array(rows, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()),
                   pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            if keep_ids:
                out.append(pa.array(chunks, pa.list_(pa.int32())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(out, names)

    small_batches(docs.sparkSession)
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return own.mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long" + (", ids array<int>" if keep_ids else ""))


def lower_bound(lengths: np.ndarray, capacity: int) -> int:
    """The largest bound of two families of dual feasible functions, each valid for every packing.

    With threshold e, the first counts a length above capacity - e as a whole bin, drops one below e and leaves the rest;
    the second counts floor((k + 1) x / capacity) / k, or x / capacity where (k + 1) x is a multiple of the capacity.
    """
    sizes, counts = np.unique(lengths, return_counts=True)
    if not sizes.size:
        return 0
    weight = sizes * counts
    best = -(-int(weight.sum()) // capacity)
    for e in sizes[sizes <= capacity // 2]:
        big = sizes > capacity - e
        mid = (sizes >= e) & ~big
        best = max(best, int(counts[big].sum()) + -(-int(weight[mid].sum()) // capacity))
    for k in range(1, 21):
        scaled = (k + 1) * sizes
        exact = scaled % capacity == 0
        units = np.where(exact, sizes * k, (scaled // capacity) * capacity)  # in parts of k * capacity
        best = max(best, -(-int((units * counts).sum()) // (k * capacity)))
    return best


def best_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Bin and offset of every length, and the number of bins; the longest first, each in the fullest bin that takes it."""
    order = np.argsort(-lengths, kind="stable")
    bins, offsets = np.empty(lengths.size, np.int64), np.empty(lengths.size, np.int64)
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    open_ = 0  # bit r: some bin has room r
    used = 0
    for at, size in zip(order.tolist(), lengths[order].tolist()):
        fit = open_ >> size
        if size and fit:
            room = size + (fit & -fit).bit_length() - 1
            target = by_room[room].pop()
            if not by_room[room]:
                open_ &= ~(1 << room)
        else:
            target, room = used, capacity
            used += 1
        bins[at], offsets[at] = target, capacity - room
        rest = room - size
        if rest:
            by_room[rest].append(target)
            open_ |= 1 << rest
    return bins, offsets, used


def _packed(pieces: DataFrame, capacity: int, columns: list[str]) -> DataFrame:
    """Best-fit decreasing within each ``part``: adds ``bin``, ``offset`` and ``release``.

    A part with a gap, that is with more bins than its lower bound, releases every bin with room; a certified part only
    its emptiest bin, as the room of its bins is less than one more bin would need.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, starts in whole_groups(batches, ["part"]):
            lengths = table.column("length").to_numpy()
            bin_, offset, release = np.empty(lengths.size, np.int64), np.empty(lengths.size, np.int64), np.zeros(lengths.size, bool)
            for lo, hi in zip(starts, np.append(starts[1:], lengths.size)):
                own = lengths[lo:hi]
                place, offset[lo:hi], used = best_fit_decreasing(own, capacity)
                room = capacity - np.bincount(place, weights=own, minlength=used).astype(np.int64)
                free = room > 0
                if used == lower_bound(own, capacity):
                    free &= np.arange(used) == room.argmax()
                bin_[lo:hi], release[lo:hi] = place, free[place]
            for name, values in (("bin", bin_), ("offset", offset), ("release", release)):
                table = table.append_column(name, pa.array(values))
            yield from table.combine_chunks().to_batches()

    schema = ", ".join(f"{c} {pieces.schema[c].dataType.simpleString()}" for c in columns)
    dealt = pieces.select(*columns).repartition("part").sortWithinPartitions("part", F.desc("length"), "doc_id", "piece", "ids_crc32")
    return dealt.mapInArrow(run, f"{schema}, bin long, offset long, release boolean")


def pack(pieces: DataFrame, capacity: int = CAPACITY, partition_rows: int = PARTITION_ROWS, rounds: int = ROUNDS) -> DataFrame:
    """``pieces`` (doc_id, piece, start, length, ids_crc32) plus ``sequence_id`` and ``offset``, in few bins of ``capacity``.

    Full pieces are bins by themselves. The others are dealt to partitions of about ``partition_rows`` rows, each packed
    by best-fit decreasing and held against its lower bound. What the partitions release is exchanged, that is dealt anew
    to fewer partitions, and packed again, until one partition held it all, its amount no longer falls, or ``rounds``.
    Only counts reach the driver. Equal rows are packed as often as they occur; offsets are gapless from 0.
    Lengths over the capacity or below 1 are refused.
    """
    row = ["doc_id", "piece", "start", "length", "ids_crc32"]
    bad = F.raise_error(F.lit("a piece must have 1 to capacity ids")).cast("long")
    pieces = written(pieces.withColumn("length", F.when(F.col("length").between(1, capacity), F.col("length")).otherwise(bad)).select(*row))
    full = pieces.filter(F.col("length") == capacity).select(
        *row, F.lit(0).cast("long").alias("offset"), F.lit(-1).alias("round"), F.monotonically_increasing_id().alias("part"),
        F.lit(0).cast("long").alias("bin"))
    done = [written(full)]
    rest = pieces.filter(F.col("length") < capacity)
    count = rest.count()
    for k in range(rounds):
        parts = max(1, -(-count // partition_rows))
        # The deal depends on the row and the round alone, so that a task that is run again deals alike.
        key = F.xxhash64(F.lit(k), "doc_id", "piece", "ids_crc32")
        dealt = written(_packed(rest.withColumn("part", F.pmod(key, F.lit(parts).cast("long"))), capacity, ["part", *row]))
        released = dealt.filter("release").count() if parts > 1 and k + 1 < rounds else 0
        last = released in (0, count)
        stay = dealt if last else dealt.filter("not release")
        done.append(stay.select(*row, "offset", F.lit(k).alias("round"), "part", "bin"))
        if last:
            break
        rest, count = dealt.filter("release").select(*row), released
    return reduce(DataFrame.unionByName, done).withColumn("sequence_id", F.xxhash64("round", "part", "bin")).drop("round", "part", "bin")


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID,
                   partition_rows: int = PARTITION_ROWS, rounds: int = ROUNDS) -> DataFrame:
    """Pieces of every row of ``doc_id, text`` with their place: see ``token_pieces`` and ``pack``."""
    return pack(token_pieces(docs, tokenizer, capacity, end_id), capacity, partition_rows, rounds)


def sequences(packed: DataFrame, pieces: DataFrame) -> DataFrame:
    """``sequence_id, ids`` of packed sequences, from ``packed`` and pieces that carry their ``ids``."""
    joined = packed.join(pieces.select("doc_id", "piece", "ids"), ["doc_id", "piece"])
    ordered = joined.groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "ids"))).alias("parts"))
    return ordered.select("sequence_id", F.flatten(F.transform("parts", lambda p: p["ids"])).alias("ids"))
