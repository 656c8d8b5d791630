"""Ordered work on keys of any size.

A plain ``partitionBy(key).orderBy(ts)`` window puts a whole key into one task, so one hot symbol
holding a third of the rows would decide the run time. Everything ordered in this library goes
through the helpers below instead: rows get a dense ordinal ``i`` per key, ``chunkRows``
consecutive ordinals form a chunk, and windows partition by (key, chunk).

* bounded frames (lags, rolling windows, forward horizons) copy a halo of neighbouring rows
  into the chunk and drop the copies afterwards;
* unbounded prefixes (running sum, peak, last value, product) combine a chunk-local window with a
  carry computed from one summary row per chunk.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window as W, WindowSpec
from pyspark.sql import functions as F

from tickloom.session import chunk_rows, durable

ORD = "i"
CHUNK = "_chunk"
CORE = "_core"


def _bucket(value: Column | str, size: int) -> Column:
    col = F.col(value) if isinstance(value, str) else value
    return F.floor(col / F.lit(size)).cast("long")


def _held(df: DataFrame) -> Column:
    """An aggregate that reads every column of ``df``.

    A summary and the rows it is joined back to then ask for one and the same exchange, which Spark computes once: without
    it the summary's side would be pruned to its keys, and the input scanned and shuffled a second time.
    """
    return F.bit_xor(F.hash(*[F.col(c) for c in df.columns])).alias("_held")


def deal(df: DataFrame, by: Sequence[str]) -> DataFrame:
    """Rows by key, without those that the join back would drop, so that both of its sides have the same filters."""
    for name in by:
        df = df.filter(F.col(name).isNotNull())
    return df.repartition(*by)


def _with_offsets(df: DataFrame, keys: Sequence[str], part: str, order: Sequence[Column | str]) -> DataFrame:
    """Dense ordinals from a partial order: count per part, prefix the counts, number inside parts.

    The rows are shuffled once, by (keys, part); counting, numbering and the join all use that exchange.
    """
    dealt = deal(df, [*keys, part])
    sizes = dealt.groupBy(*keys, part).agg(F.count(F.lit(1)).alias("_n"), _held(df))
    before = W.partitionBy(*keys).orderBy(part).rowsBetween(W.unboundedPreceding, -1)
    starts = sizes.select(*keys, part, (F.coalesce(F.sum("_n").over(before), F.lit(0)) + F.coalesce(F.col("_held") * 0, F.lit(0))).alias("_base"))
    inside = W.partitionBy(*keys, part).orderBy(*order)
    return (
        dealt.join(starts, [*keys, part])
        .withColumn(ORD, F.col("_base") + F.row_number().over(inside) - 1)
        .drop("_base", part)
    )


def number_on_grid(
    df: DataFrame, keys: Sequence[str], step_ms: int, order: str = "ms", rows: int | None = None
) -> DataFrame:
    """Add ordinal ``i`` per key to rows whose ``order`` (epoch ms) is unique on a fixed grid.

    A time slot of ``chunkRows`` steps cannot hold more than ``chunkRows`` rows, so no task sees
    more than that whatever the distribution over keys is.
    """
    rows = rows or chunk_rows(df.sparkSession)
    slotted = df.withColumn("_slot", _bucket(order, rows * step_ms))
    return _with_offsets(slotted, keys, "_slot", [order])


def number_by_slot(df: DataFrame, keys: Sequence[str], slot: Column, order: Sequence[str]) -> DataFrame:
    """Add ordinal ``i`` per key for a total order whose ``slot`` grows with it; a task sorts what one key has in one slot."""
    return _with_offsets(df.withColumn("_slot", slot), keys, "_slot", list(order))


def number_by_range(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str]) -> DataFrame:
    """Add ordinal ``i`` per key for any total order (``order`` must break ties itself).

    Range partitioning on (keys, order) splits hot keys and hot values alike. Its split points are
    sampled, hence the durable cut before the partition number is used twice.
    """
    names = [F.col(k) for k in keys]
    ranged = df.repartitionByRange(*names, *order).withColumn("_part", F.spark_partition_id())
    return _with_offsets(durable(ranged), keys, "_part", order)


def with_halo(
    df: DataFrame, keys: Sequence[str], back: int, ahead: int = 0, rows: int | None = None
) -> tuple[DataFrame, WindowSpec]:
    """Copy rows into every chunk whose frames can reach them; returns rows and their window.

    ``back``/``ahead`` is the longest look at earlier/later rows. Call :func:`drop_halo` at the end.
    """
    rows = rows or chunk_rows(df.sparkSession)
    first = F.greatest(F.lit(0).cast("long"), _bucket(F.col(ORD) - ahead, rows))
    last = _bucket(F.col(ORD) + back, rows)
    copied = df.withColumn(CHUNK, F.explode(F.sequence(first, last))).withColumn(
        CORE, F.col(CHUNK) == _bucket(ORD, rows)
    )
    return copied, W.partitionBy(*keys, CHUNK).orderBy(ORD)


def drop_halo(df: DataFrame, keep: Iterable[str] = ()) -> DataFrame:
    drop = [c for c in (CHUNK, CORE) if c not in set(keep)]
    return df.filter(F.col(CORE)).drop(*drop)


_AGGREGATES = {
    "sum": F.sum,
    "max": F.max,
    "min": F.min,
    "prod": F.product,
    "last": lambda c: F.last(c, ignorenulls=True),
}


def _merge(kind: str, carry: Column, local: Column) -> Column:
    if kind == "sum":
        return F.when(carry.isNull() & local.isNull(), None).otherwise(
            F.coalesce(carry, F.lit(0)) + F.coalesce(local, F.lit(0))
        )
    if kind == "prod":
        return F.coalesce(carry, F.lit(1.0)) * F.coalesce(local, F.lit(1.0))
    if kind == "max":
        return F.greatest(carry, local)
    if kind == "min":
        return F.least(carry, local)
    return F.coalesce(local, carry)


def running(
    df: DataFrame,
    keys: Sequence[str],
    outputs: Mapping[str, tuple[str, Column]],
    order: str | Sequence[str] = ORD,
    rows: int | None = None,
    slot: Column | None = None,
) -> DataFrame:
    """Running aggregates per key up to and including each row.

    ``outputs`` maps a new column to ``(kind, expression)`` with kind sum/max/min/prod/last
    (last = last non-null). ``order`` is a unique integer per key. The summary the carry scans
    has one row per chunk, i.e. rows/chunkRows entries even for the hottest key.

    Rows without such an integer are chunked by ``slot``, a number that grows with the ``order`` columns, say the hour; a
    chunk is then as large as its slot, and its summary has one row per slot.
    """
    rows = rows or chunk_rows(df.sparkSession)
    by = [order] if isinstance(order, str) else list(order)
    at = F.col(by[0]) if len(by) == 1 else F.struct(*by)
    base = df.withColumn(CHUNK, _bucket(order, rows) if slot is None else slot.cast("long"))
    for name, (_, expr) in outputs.items():
        base = base.withColumn(f"_x_{name}", expr)
    read = _held(base)
    base = deal(base, [*keys, CHUNK])

    totals, carries = [], [*keys, CHUNK]
    before = W.partitionBy(*keys).orderBy(CHUNK).rowsBetween(W.unboundedPreceding, -1)
    upto = W.partitionBy(*keys, CHUNK).orderBy(*by).rowsBetween(W.unboundedPreceding, 0)
    local = base
    for name, (kind, _) in outputs.items():
        x = F.col(f"_x_{name}")
        total = F.max_by(x, F.when(x.isNotNull(), at)) if kind == "last" else _AGGREGATES[kind](x)
        totals.append(total.alias(f"_t_{name}"))
        carries.append(_AGGREGATES[kind](F.col(f"_t_{name}")).over(before).alias(f"_c_{name}"))
        local = local.withColumn(f"_l_{name}", _AGGREGATES[kind](x).over(upto))
    carries.append((F.col("_held") * 0).alias("_held"))
    carry = base.groupBy(*keys, CHUNK).agg(*totals, read).select(*carries)

    joined = local.join(carry, [*keys, CHUNK])
    for name, (kind, _) in outputs.items():
        joined = joined.withColumn(name, _merge(kind, F.col(f"_c_{name}"), F.col(f"_l_{name}")))
    return joined.filter("_held = 0").drop(CHUNK, "_held", *[f"_{p}_{n}" for n in outputs for p in ("x", "l", "c")])


def exact_quantile(df: DataFrame, keys: Sequence[str], value: str, probs: Mapping[str, float], tie: str) -> DataFrame:
    """Linear-interpolated quantiles per key without gathering a group: number, pick two rows.

    ``tie`` is any unique column; it only makes the order total.
    """
    numbered = number_by_range(df.filter(F.col(value).isNotNull()).select(*keys, value, tie), keys, [value, tie])
    sizes = numbered.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    rows = numbered.join(sizes, list(keys)) if keys else numbered.crossJoin(F.broadcast(sizes))
    aggs = []
    for name, q in probs.items():
        at = (F.col("_n") - 1) * F.lit(float(q))
        lo, hi = F.floor(at), F.ceil(at)
        low = F.max(F.when(F.col(ORD) == lo, F.col(value)))
        high = F.max(F.when(F.col(ORD) == hi, F.col(value)))
        frac = F.max(at - lo)
        aggs.append((low + (high - low) * frac).alias(name))
    return rows.groupBy(*keys).agg(*aggs)


def distinct_ranks(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Per (key, distinct value): ``_below`` rows strictly smaller, ``_peers`` rows equal.

    Equal values collapse before anything is ordered, so a value shared by a third of the rows
    costs one row; ranks of any tie rule follow from the two counts.
    """
    counts = df.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_peers"))
    numbered = number_by_range(counts, keys, [value])
    scanned = running(numbered, keys, {"_upto": ("sum", F.col("_peers"))})
    return scanned.select(*keys, value, (F.col("_upto") - F.col("_peers")).alias("_below"), "_peers")
