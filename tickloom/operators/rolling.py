"""Window building blocks: guarded rolling statistics and exponentially weighted means."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window as W, WindowSpec
from pyspark.sql import functions as F

from tickloom.functions.scalars import ratio
from tickloom.operators.chunking import CHUNK, CORE, ORD
from tickloom.session import chunk_rows

# Weights within a block grow to this much at most; exp(-ZERO_AT) is zero in double precision.
HEADROOM, ZERO_AT = 1e100, 746.0


def log_return(w: WindowSpec, k: int, close: str = "close") -> Column:
    return F.ln(F.col(close)) - F.ln(F.lag(close, k).over(w))


def rolling(w: WindowSpec, n: int, kind: str, column: Column | str) -> Column:
    """mean/std/sum/min/max of the last ``n`` rows; NULL until ``n`` values are in the frame."""
    col = F.col(column) if isinstance(column, str) else column
    frame = w.rowsBetween(-(n - 1), 0)
    agg = {"mean": F.avg, "std": F.stddev_samp, "sum": F.sum, "min": F.min, "max": F.max}[kind]
    return F.when(F.count(col).over(frame) == n, agg(col).over(frame))


def rolling_z(w: WindowSpec, n: int, column: str) -> Column:
    return ratio(F.col(column) - rolling(w, n, "mean", column), rolling(w, n, "std", column))


@dataclass(frozen=True)
class Ewm:
    """One exponentially weighted mean: ``y = (1-alpha) * y_prev + alpha * x`` seeded with the first x.

    ``first`` is the ordinal of the first non-null input; results are NULL before ``min_periods`` inputs.
    """

    column: str
    alpha: float
    first: int = 0
    min_periods: int = 1

    @property
    def keep(self) -> float:
        return 1.0 - self.alpha


def block_rows(specs: Mapping[str, Ewm], rows: int) -> int:
    """Rows of a block: a divisor of the chunk over which no weight grows beyond ``HEADROOM``."""
    fastest = min((s.keep for s in specs.values() if s.alpha < 1.0), default=0.5)
    most = max(1, min(rows, int(math.log(HEADROOM) / -math.log(fastest))))
    return next(m for m in range(most, 0, -1) if rows % m == 0)


def add_ewm(df: DataFrame, keys: Sequence[str], specs: Mapping[str, Ewm], read: Sequence[str]) -> DataFrame:
    """The rows of :func:`with_halo` without their halo, plus exponentially weighted means of any reach.

    A block of consecutive rows is an affine map of the mean it is entered with, y -> A * y + B. B is one weighted sum per
    block; the maps of a chunk's blocks and of the chunks before it are composed in order, which gives the mean every block
    is entered with, and a row adds its own weighted sum within the block. So no row is copied for these means, and a
    chunk's summary is one row. Weights leave out only what is zero in double precision.

    ``df`` is dealt by (keys, chunk); ``read`` names columns of it that the summary reads too, so that both sides of its
    join ask for the same exchange.
    """
    size = chunk_rows(df.sparkSession)
    m = block_rows(specs, size)
    by = [*keys, CHUNK]
    place = F.col(ORD) - F.col(CHUNK) * size
    core = df.filter(F.col(CORE)).withColumns({"_block": F.floor(place / m).cast("int"), "_at": place % m}).drop(CORE)
    core = core.withColumns({
        f"_in_{n}": F.when(F.col(ORD) == s.first, F.col(s.column)).when(F.col(ORD) > s.first, F.col(s.column) * s.alpha) for n, s in specs.items()})
    power = lambda s, e: F.pow(F.lit(s.keep), e)
    sums = [F.coalesce(F.sum(F.col(f"_in_{n}") * power(s, F.lit(m - 1) - F.col("_at"))), F.lit(0.0)).alias(n) for n, s in specs.items()]
    held = F.bit_xor(F.hash(*[F.col(c) for c in read])).alias("_held")
    blocks = core.groupBy(*by, "_block").agg(*sums, held)
    chunks = blocks.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("_block", *specs))).alias("_maps"), F.bit_xor("_held").alias("_held"))

    def through(start: Column, values: Column, factor: float) -> Column:
        return F.aggregate(values, start, lambda y, b: y * F.lit(factor) + b)

    ends = chunks.withColumns({f"_end_{n}": through(F.lit(0.0), F.col(f"_maps.{n}"), s.keep ** m) for n, s in specs.items()})
    entered = {}
    for n, s in specs.items():
        last = 1 if s.alpha >= 1.0 else max(1, math.ceil(ZERO_AT / (size * -math.log(s.keep))))
        before = W.partitionBy(*keys).orderBy(CHUNK).rowsBetween(-last, -1)
        entered[f"_into_{n}"] = through(F.lit(0.0), F.collect_list(f"_end_{n}").over(before), s.keep ** size)
    # The mean that each block is entered with: the one before it, carried through its map.
    def every(start: Column, values: Column, factor: float) -> Column:
        return F.aggregate(values, F.array(start), lambda ys, b: F.concat(ys, F.array(F.element_at(ys, -1) * F.lit(factor) + b)))

    carried = ends.withColumns(entered)
    carried = carried.withColumns({f"_carry_{n}": every(F.col(f"_into_{n}"), F.col(f"_maps.{n}"), s.keep ** m) for n, s in specs.items()})
    carry = carried.select(*by, *[f"_carry_{n}" for n in specs], (F.col("_held") * 0).alias("_held"))
    joined = core.join(carry, by).filter(F.col("_held") + F.hash(*[F.col(c) for c in read]) * 0 == 0)
    upto = W.partitionBy(*by, "_block").orderBy(ORD).rowsBetween(W.unboundedPreceding, 0)
    out = {}
    for n, s in specs.items():
        if s.alpha >= 1.0:
            value = F.col(s.column)
        else:
            own = F.coalesce(F.sum(F.col(f"_in_{n}") * power(s, -F.col("_at"))).over(upto), F.lit(0.0)) * power(s, F.col("_at"))
            value = own + F.get(F.col(f"_carry_{n}"), F.col("_block")) * power(s, F.col("_at") + 1)
        out[n] = F.when(F.col(ORD) >= s.first + s.min_periods - 1, value)
    return joined.withColumns(out).drop(CHUNK, "_block", "_at", "_held", *[f"_{p}_{n}" for n in specs for p in ("in", "carry")])


def span_alpha(span: int) -> float:
    return 2.0 / (span + 1)


def true_range(w: WindowSpec) -> Column:
    prev = F.lag("close").over(w)
    return F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - prev), F.abs(F.col("low") - prev))


def rsi(avg_gain: Column | str, avg_loss: Column | str) -> Column:
    """0..100; 50 while warming up or when nothing was lost."""
    return F.coalesce(100.0 - 100.0 / (1.0 + ratio(avg_gain, avg_loss)), F.lit(50.0))
