"""Backward and two-sided as-of joins without per-key tasks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.operators.chunking import ORD, number_by_range, running
from tickloom.session import chunk_rows


def asof_backward(
    left: DataFrame, right: DataFrame, keys: Sequence[str], values: Sequence[str], order: str = "ms",
    grid_ms: int | None = None, slot_ms: int = 3_600_000,
) -> DataFrame:
    """For each left row the latest right row at or before it (per key); NULLs when there is none.

    Both sides are unioned and scanned with ``last(ignoreNulls)`` inside (key, chunk); the value
    entering a chunk comes from one summary row per chunk. A left side on a time grid of
    ``grid_ms`` chunks by time (the right side first combines to one row per grid step, so a
    chunk is bounded); any other left side is chunked into slots of ``slot_ms``, so that a task sorts
    what one key has in one slot. Either way both sides are read once and shuffled once.
    """
    payload = F.struct(*values)
    at = F.col(order)
    slot = at if grid_ms is None else (F.ceil(at / grid_ms) * grid_ms).cast("long")
    r = (
        right.groupBy(*keys, slot.alias(order))
        .agg(F.max_by(payload, F.struct(at, payload)).alias("_right"))
        .withColumn("_is_left", F.lit(0).cast("byte"))
    )
    l = left.select(*keys, order, F.struct(*left.columns).alias("_left"), F.lit(1).cast("byte").alias("_is_left"))
    both = r.unionByName(l, allowMissingColumns=True)
    if grid_ms is None:
        tie = F.coalesce(F.xxhash64("_left"), F.lit(0))
        scanned = running(both.withColumn("_tie", tie), keys, {"_hit": ("last", F.col("_right"))},
                          order=[order, "_is_left", "_tie"], slot=F.floor(at / slot_ms))
    else:
        rank = both.withColumn("_at", at * 2 + F.col("_is_left"))
        size = 2 * grid_ms * chunk_rows(left.sparkSession)
        scanned = running(rank, keys, {"_hit": ("last", F.col("_right"))}, order="_at", rows=size)
    out = scanned.filter(F.col("_is_left") == 1)
    return out.select("_left.*", *[F.col(f"_hit.{v}").alias(v) for v in values])


def interpolate(points: DataFrame, curve: DataFrame, x: str, ref_x: str, ref_y: str, out: str) -> DataFrame:
    """Piecewise-linear lookup of ``x`` in the curve (flat beyond its ends).

    Curve rows and points are ordered together; each point takes its neighbours from a running
    last in either direction.
    """
    ref = curve.groupBy(F.col(ref_x).alias("_x")).agg(F.min(ref_y).alias("_y_lo"), F.max(ref_y).alias("_y_hi"))
    ref = ref.withColumn("_ref", F.struct("_x", "_y_lo", "_y_hi")).select("_x", "_ref").withColumn("_is_point", F.lit(0))
    pts = points.withColumn("_row", F.struct(*points.columns)).select(F.col(x).alias("_x"), "_row").withColumn("_is_point", F.lit(1))
    both = ref.unionByName(pts, allowMissingColumns=True).withColumn("_tie", F.coalesce(F.xxhash64("_row"), F.lit(0)))
    numbered = number_by_range(both, [], ["_x", "_is_point", "_tie"])
    fwd = running(numbered, [], {"_lo": ("last", F.col("_ref"))})
    rev = running(fwd.withColumn("_rev", -F.col(ORD)), [], {"_hi": ("last", F.col("_ref"))}, order="_rev")
    lo, hi, at = F.col("_lo"), F.col("_hi"), F.col("_x")
    y = (
        F.when(lo.isNull(), hi["_y_lo"])
        .when(hi.isNull() | (lo["_x"] == at), lo["_y_hi"])
        .otherwise(lo["_y_hi"] + (hi["_y_lo"] - lo["_y_hi"]) * (at - lo["_x"]) / (hi["_x"] - lo["_x"]))
    )
    return rev.filter(F.col("_is_point") == 1).select("_row.*", y.alias(out))
