"""Alert rules over curves, journals and per-key state."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.operators.chunking import drop_halo, running, with_halo
from tickloom.operators.metrics import with_drawdown


def hysteresis_alerts(curve: DataFrame, keys: Sequence[str], threshold: float, drawdown: str = "drawdown") -> DataFrame:
    """Rows where the drawdown first reaches the threshold; re-armed once it halves.

    The state is a forward-filled mark (1 below the threshold, 0 above half of it), so it is a
    running last instead of a loop.
    """
    dd = F.col(drawdown)
    mark = F.when(dd <= -threshold, 1).when(dd > -threshold / 2.0, 0)
    state = running(curve, keys, {"_mark": ("last", mark)}).withColumn("_on", F.coalesce("_mark", F.lit(0)))
    rows, w = with_halo(state, keys, back=1)
    was = F.coalesce(F.lag("_on").over(w), F.lit(0))
    out = drop_halo(rows.withColumn("_fires", (F.col("_on") == 1) & (was == 0)))
    return out.filter("_fires").drop("_mark", "_on", "_fires")


def drawdown_alerts(curve: DataFrame, keys: Sequence[str], threshold: float) -> DataFrame:
    return hysteresis_alerts(with_drawdown(curve, keys), keys, threshold)


def stale_keys(bars: DataFrame, step: int, now_ms: Column, slack_ms: int = 15 * 60_000, keys: Sequence[str] = ("symbol",)) -> DataFrame:
    """Keys whose newest bar closed more than one bar (plus slack) ago."""
    newest = bars.groupBy(*keys).agg(F.max("ms").alias("last_ms"))
    overdue = now_ms - (F.col("last_ms") + step)
    return newest.withColumn("overdue_ms", overdue).withColumn("stale", overdue > step + slack_ms)


def freshness(updated_ms: Column, now_ms: Column, limit_seconds: int) -> Column:
    return F.when(updated_ms.isNull(), "none").when(now_ms - updated_ms <= limit_seconds * 1000, "fresh").otherwise("stale")


def map_drift(live: DataFrame, desired: DataFrame, book: str = "book", params: str = "params") -> DataFrame:
    """Parameters whose live value differs from the desired one; only keys present live count."""
    a = live.select(book, "candle_ms", F.explode(params).alias("key", "live"))
    b = desired.select(book, "edited_ms", F.explode(params).alias("key", "desired"))
    joined = a.join(b, [book, "key"]).filter(F.col("live") != F.col("desired"))
    return joined.withColumn("stuck", F.col("candle_ms") > F.col("edited_ms"))


def cap_rejections(signals: DataFrame, book: str = "book") -> DataFrame:
    """Pairs turned away by the position cap, with the best probability among them."""
    s = signals.select(book, F.explode("signals").alias("symbol", "s"))
    hit = s.filter((F.col("s.reason") == "risk_blocked") & F.col("s.detail").startswith("max_open_positions"))
    return hit.groupBy(book).agg(F.count(F.lit(1)).alias("waiting"), F.max("s.p").alias("best_p"))


def live_points(journal: DataFrame, state: DataFrame, book: str = "book") -> DataFrame:
    """Journal rows plus one current row per symbol when the state is newer than the journal."""
    newest = journal.groupBy(book).agg(F.max("ms").alias("_newest"))
    known = journal.select(book, "symbol").distinct()
    now = (
        state.join(newest, book).filter(F.col("updated_ms") > F.col("_newest"))
        .select(book, F.col("updated_ms").alias("ms"), "equity", F.coalesce("cash", "equity").alias("cash"), F.explode("last_close").alias("symbol", "close"))
        .join(known, [book, "symbol"], "left_semi")
    )
    return journal.unionByName(now, allowMissingColumns=True)


def extend_prices(store: DataFrame, journal: DataFrame, keys: Sequence[str] = ("symbol",)) -> DataFrame:
    """Stored closes followed by journal closes newer than the store's last bar."""
    newest = store.groupBy(*keys).agg(F.max("ms").alias("_newest"))
    extra = journal.join(newest, list(keys), "left").filter(F.col("_newest").isNull() | (F.col("ms") > F.col("_newest"))).drop("_newest")
    return store.unionByName(extra, allowMissingColumns=True)


def trade_marks(closed: DataFrame, fills: DataFrame, held: DataFrame, keys: Sequence[str] = ("symbol",)) -> DataFrame:
    """Round trips, fills and open positions as one (ms, price, kind) list."""
    trips = closed.select(*keys, F.explode(F.array(
        F.struct(F.col("entry_ms").alias("ms"), F.col("entry_price").alias("price"), F.lit("entry").alias("kind")),
        F.struct(F.col("exit_ms").alias("ms"), F.col("exit_price").alias("price"), F.lit("exit").alias("kind")),
    )).alias("m")).select(*keys, "m.*")
    buys = fills.select(*keys, "ms", "price", F.col("side").alias("kind"))
    open_now = held.select(*keys, F.col("entry_ms").alias("ms"), F.col("entry_price").alias("price"), F.lit("held").alias("kind"))
    return trips.unionByName(buys).unionByName(open_now)


def clip_marks(marks: DataFrame, start: Column, end: Column) -> DataFrame:
    return marks.filter((F.col("ms") >= start) & (F.col("ms") <= end)).orderBy("ms")
