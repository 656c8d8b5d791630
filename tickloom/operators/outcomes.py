"""Trade outcomes as relational steps: legs for every bar, a chain over legs, money on top.

A per-symbol evaluation is not simulated bar by bar. Each bar first gets the outcome of the leg it
could start (one window scan). Which legs are really taken is a walk over pointers that only go
forward by a bounded number of bars: every chunk summarises itself as a small map
"state on entry -> state on exit", the maps of a key are folded in order (one row per chunk), and
the chunks then walk independently. Money is a running product over the chosen trades.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Sequence
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W
from pyspark.sql import functions as F

from tickloom.functions.scalars import Costs, taker_price
from tickloom.operators.chunking import drop_halo, running, with_halo
from tickloom.operators.labels import ForwardScan, Geometry
from tickloom.session import chunk_rows, durable

FLAT, ROLL_LONG, ROLL_SHORT = 0, 1, 2
NEVER = (1 << 40) * 4


@dataclass(frozen=True)
class Rules:
    """How a book trades; everything a scenario grid may vary."""

    geometry: Geometry = field(default_factory=Geometry)
    costs: Costs = field(default_factory=Costs)
    threshold: float = 0.55
    rollover: bool = True
    maker_timeout: int | None = None
    hold: str = "backtest"
    position_pct: float = 0.10
    initial: float = 10_000.0

    @property
    def reach(self) -> int:
        h = self.geometry.horizon
        if self.maker_timeout is not None:
            return self.maker_timeout + h + 1
        return h + 1 if self.hold == "backtest" else h


# Scenario columns: when the input has one of these, it overrides the rule of the same name per row,
# so a whole grid of rule variants is one job with the scenario as an extra key.
PARAMS = ("tp_mult", "sl_mult", "threshold", "slippage", "taker_fee", "fraction")


def _param(df: DataFrame, name: str, default: float) -> Column:
    return F.col(name) if name in df.columns else F.lit(float(default))


def _leg(first_tp: Column, first_sl: Column, deadline: Column, last_close: Column, tp: Column, sl: Column) -> Column:
    """struct(step, reason, price) of a bracket; NULL members while the data ends first."""
    stopped = first_sl.isNotNull() & (first_sl <= deadline) & (first_tp.isNull() | (first_sl <= first_tp))
    target = first_tp.isNotNull() & (first_tp <= deadline) & ~stopped
    timed_out = last_close.isNotNull()
    return F.struct(
        F.when(stopped, first_sl).when(target, first_tp).when(timed_out, deadline).alias("step"),
        F.when(stopped, "sl").when(target, "tp").when(timed_out, "timeout").alias("reason"),
        F.when(stopped, sl).when(target, tp).otherwise(last_close).alias("price"),
    )


def _at(column: str, step: Column | str) -> Column:
    return F.try_element_at(F.col(column), (F.col(step) if isinstance(step, str) else step).cast("int"))


def legs(df: DataFrame, rules: Rules, keys: Sequence[str] = ("symbol",)) -> DataFrame:
    """Every leg each bar can start: its entry (rows with ``side`` <> 0) and its roll legs.

    Input: bars with i, ms, atr, side, p_side and the scores p_long/p_short. For each leg
    (e = entry, l/s = roll long/short) the result has step, reason, raw exit price, exit ordinal and
    time, and ``<leg>_next`` = (ordinal * 4 + state) where the walk continues.
    """
    g, h, steps = rules.geometry, rules.geometry.horizon, rules.reach
    tp_mult, sl_mult = _param(df, "tp_mult", g.tp_mult), _param(df, "sl_mult", g.sl_mult)
    threshold, slippage = _param(df, "threshold", rules.threshold), _param(df, "slippage", rules.costs.slippage)
    rows, w = with_halo(df, keys, back=0, ahead=steps)
    tradable = F.lead("i").over(w).isNotNull() & (F.col("atr") > 0)
    may_roll = {
        name: F.coalesce((F.col(p) >= threshold) & (F.col("atr") > 0), F.lit(False)) if rules.rollover else F.lit(False)
        for name, p in (("l_ok", "p_long"), ("s_ok", "p_short"))
    }
    rows = rows.withColumns({"side": F.when(tradable, F.col("side")).otherwise(0), **may_roll})
    scan = ForwardScan(rows, keys, steps, arrays={"_ms": "ms", "_cl": "close", "_lok": "l_ok", "_sok": "s_ok"})
    s, out = F.col("side"), scan.df
    if rules.maker_timeout is not None:
        limit = F.col("close")
        touched = scan.first_sl("side", "close", limit=rules.maker_timeout)  # price comes back to the limit
        out = out.withColumns({
            "fill_step": F.when(s != 0, touched), "open_price": limit, "fill_price": limit,
            "_miss": F.lead("i", rules.maker_timeout + 1).over(w),
        })
        after, deadline = "fill_step", F.col("fill_step") + h
    else:
        at_open = rules.hold == "backtest"
        price = F.lead("open").over(w) if at_open else F.col("close")
        out = out.withColumns({
            "fill_step": F.when(s != 0, F.lit(1 if at_open else 0)), "open_price": price,
            "_miss": F.lit(None).cast("long"),
        })
        out = out.withColumn("fill_price", taker_price("open_price", s > 0, slippage))
        after, deadline = None, F.lit(steps)
    # Cash pays for the position and its fee, or the order is refused and the book stays flat.
    fee = F.lit(rules.costs.maker_fee) if rules.maker_timeout is not None else _param(df, "taker_fee", rules.costs.taker_fee)
    cost = _param(df, "fraction", rules.position_pct) * F.col("fill_price") / F.col("open_price") * (1.0 + fee)
    out = out.withColumn("side", F.when(F.coalesce(cost, F.lit(0.0)) <= 1.0, s).otherwise(0))
    explicit = "tp_price" in df.columns  # barriers given per row instead of in ATR
    out = out.withColumns({
        "tp": F.col("tp_price") if explicit else F.col("fill_price") + s * tp_mult * F.col("atr"),
        "sl": F.col("sl_price") if explicit else F.col("fill_price") - s * sl_mult * F.col("atr"),
    })
    out = out.withColumns({"_tp": scan.first_tp("side", "tp", after), "_sl": scan.first_sl("side", "sl", after)})
    filled = F.col("fill_step").isNotNull() & F.col("fill_price").isNotNull()
    out = out.withColumn("e", F.when(filled, _leg(
        F.col("_tp"), F.col("_sl"), deadline, _at("_cl", deadline), F.col("tp"), F.col("sl"))))
    rolls = F.when(s > 0, _at("_lok", "e.step")).otherwise(_at("_sok", "e.step"))
    out = out.withColumns({
        **_continue("e", rolls, F.when(s > 0, ROLL_LONG).otherwise(ROLL_SHORT), miss=F.col("_miss")),
        "fill_ms": F.when(F.col("fill_step") == 0, F.col("ms")).otherwise(_at("_ms", "fill_step")),
    })
    if rules.rollover:
        targets, touches, rolled, onward = {}, {}, {}, {}
        for name, sign, code in (("l", 1, ROLL_LONG), ("s", -1, ROLL_SHORT)):
            tp = F.col("close") + tp_mult * sign * F.col("atr")
            sl = F.col("close") - sl_mult * sign * F.col("atr")
            targets |= {f"_{name}tpp": tp, f"_{name}slp": sl}
            touches[f"_{name}tp"] = scan.first_tp(sign, f"_{name}tpp", limit=h)
            touches[f"_{name}sl"] = scan.first_sl(sign, f"_{name}slp", limit=h)
            leg = _leg(F.col(f"_{name}tp"), F.col(f"_{name}sl"), F.lit(h), _at("_cl", F.lit(h)), tp, sl)
            rolled[name] = F.when(F.col(f"{name}_ok"), leg)
            onward |= _continue(name, _at(f"_{name}ok", f"{name}.step"), F.lit(code))
        out = out.withColumns(targets).withColumns(touches).withColumns(rolled).withColumns(onward)
        node = (s != 0) | F.col("l_ok") | F.col("s_ok")
    else:
        empty = "cast(null as struct<step:int,reason:string,price:double>)"
        for name in ("l", "s"):
            out = out.withColumns({name: F.expr(empty), f"{name}_ms": F.lit(None).cast("long"), f"{name}_next": F.lit(NEVER)})
        node = s != 0
    kept = ["i", "ms", "side", "p_side", "l_ok", "s_ok", "open_price", "fill_price", "fill_step", "fill_ms", "tp", "sl",
            *[c for c in PARAMS if c in df.columns]]
    named = [
        F.col(f"{leg}.{c}").alias(f"{leg}_{c}") for leg in ("e", "l", "s") for c in ("step", "reason", "price")
    ] + [F.col(f"{leg}_{c}") for leg in ("e", "l", "s") for c in ("ms", "next")]
    return drop_halo(out).filter(node).select(*keys, *kept, *named)


def _continue(leg: str, rolls: Column, code: Column, miss: Column | None = None) -> dict[str, Column]:
    step = F.col(f"{leg}.step")
    state = F.when((F.col(f"{leg}.reason") == "timeout") & F.coalesce(rolls, F.lit(False)), code).otherwise(FLAT)
    onward = (F.col("i") + step) * 4 + state
    if miss is not None:
        onward = F.when(F.col("fill_step").isNull(), miss * 4).otherwise(onward)
    return {f"{leg}_ms": _at("_ms", step), f"{leg}_next": F.coalesce(onward.cast("long"), F.lit(NEVER))}


# --- the walk ----------------------------------------------------------------------------------

def _settle_chunk(pdf: pd.DataFrame, hi: int):
    """Function (bar, kind) code -> code at or after ``hi``; nodes are resolved latest first."""
    pdf = pdf.sort_values("i")
    bars, side = pdf["i"].tolist(), pdf["side"].tolist()
    nxt = {ROLL_LONG: pdf["l_next"].tolist(), ROLL_SHORT: pdf["s_next"].tolist()}
    may = {ROLL_LONG: pdf["l_ok"].tolist(), ROLL_SHORT: pdf["s_ok"].tolist()}
    enter = pdf["e_next"].tolist()
    signals = [b for b, s in zip(bars, side) if s]
    flat_out = [0] * len(signals)
    roll_out: dict[int, int] = {}

    def settle(code: int) -> int:
        if code >> 2 >= hi:
            return code
        if code & 3:
            return roll_out[code]
        at = bisect_left(signals, code >> 2)
        return flat_out[at] if at < len(signals) else hi << 2

    at = len(signals)
    for k in range(len(bars) - 1, -1, -1):
        for kind in (ROLL_LONG, ROLL_SHORT):
            if may[kind][k]:
                roll_out[bars[k] << 2 | kind] = settle(nxt[kind][k])
        if side[k]:
            at -= 1
            flat_out[at] = settle(enter[k])
    return settle, roll_out


def _walk_chunk(pdf: pd.DataFrame, hi: int) -> pd.DataFrame:
    """Legs taken from the state the chunk is entered with, in order."""
    pdf = pdf.sort_values("i").reset_index(drop=True)
    bars = pdf["i"].tolist()
    signal_at = [k for k, s in enumerate(pdf["side"].tolist()) if s]
    signals = [bars[k] for k in signal_at]
    columns = {FLAT: pdf["e_next"].tolist(), ROLL_LONG: pdf["l_next"].tolist(), ROLL_SHORT: pdf["s_next"].tolist()}
    where = {b: k for k, b in enumerate(bars)}
    code, taken, kinds = int(pdf["_state"].iloc[0]), [], []
    while code >> 2 < hi:
        kind = code & 3
        if kind == FLAT:
            at = bisect_left(signals, code >> 2)
            if at == len(signals):
                break
            k = signal_at[at]
        else:
            k = where[code >> 2]
        taken.append(k)
        kinds.append(kind)
        code = columns[kind][k]
    return pdf.iloc[taken].assign(kind=kinds).drop(columns=["_state", "_chunk"])


def chain(nodes: DataFrame, reach: int, keys: Sequence[str] = ("symbol",), start: str | None = None) -> DataFrame:
    """The legs one position per key really takes (adds ``kind``: 0 entry, 1/2 roll).

    ``start`` optionally names a column holding the first ordinal a key may trade from.
    """
    spark = nodes.sparkSession
    rows = chunk_rows(spark)
    keys = list(keys)
    nodes = durable(nodes.withColumn("_chunk", F.floor(F.col("i") / rows).cast("long")))
    walk_columns = ["i", "side", "l_ok", "s_ok", "e_next", "l_next", "s_next"]
    types = {f.name: f.dataType.simpleString() for f in nodes.schema.fields}
    key_ddl = ", ".join(f"`{k}` {types[k]}" for k in keys)
    # A start may lie anywhere in its chunk; without one, a chunk is entered within the reach of the legs before it.
    span = min(reach, rows - 1) if start is None else rows - 1

    def summarise(pdf: pd.DataFrame) -> pd.DataFrame:
        c = int(pdf["_chunk"].iloc[0])
        lo, hi = c * rows, (c + 1) * rows
        settle, rolls = _settle_chunk(pdf, hi)
        head = {k: [pdf[k].iloc[0]] for k in keys}
        near = {code: v for code, v in rolls.items() if code >> 2 <= lo + span}
        return pd.DataFrame({
            **head, "_chunk": [c], "flat": [[settle((lo + k) << 2) for k in range(span + 1)]],
            "roll_from": [list(near)], "roll_to": [list(near.values())],
        })

    maps = nodes.select(*keys, "_chunk", *walk_columns).groupBy(*keys, "_chunk").applyInPandas(
        summarise, f"{key_ddl}, _chunk long, flat array<long>, roll_from array<long>, roll_to array<long>"
    )
    first = nodes.groupBy(*keys).agg((F.min(start) if start else F.lit(0)).cast("long").alias("_start"))
    maps = maps.join(first, keys)

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_chunk")
        code, states = int(pdf["_start"].iloc[0]) << 2, []
        for c, flat, frm, to in zip(pdf["_chunk"], pdf["flat"], pdf["roll_from"], pdf["roll_to"]):
            lo, hi = int(c) * rows, (int(c) + 1) * rows
            if code & 3 == FLAT and code >> 2 < lo:
                code = lo << 2
            states.append(code)
            if code >> 2 >= hi:
                continue
            if code & 3:
                code = int(to[list(frm).index(code)])
            elif (code >> 2) - lo < len(flat):
                code = int(flat[(code >> 2) - lo])
            else:
                raise ValueError("state lies beyond the summarised part of a chunk")
        out = pdf[[*keys, "_chunk"]].copy()
        out["_state"] = states
        return out

    entered = maps.groupBy(*keys).applyInPandas(fold, f"{key_ddl}, _chunk long, _state long")

    def walk(pdf: pd.DataFrame) -> pd.DataFrame:
        return _walk_chunk(pdf, (int(pdf["_chunk"].iloc[0]) + 1) * rows)

    ddl = ", ".join(f"`{n}` {t}" for n, t in types.items() if n != "_chunk")
    return nodes.join(entered, [*keys, "_chunk"]).groupBy(*keys, "_chunk").applyInPandas(walk, f"{ddl}, kind int")


def trades(taken: DataFrame, rules: Rules, keys: Sequence[str] = ("symbol",)) -> DataFrame:
    """One row per closed or still open position, before money.

    exit_reason is NULL for a position the data ends in.
    """
    entry = F.col("kind") == FLAT
    filled = taken.filter(~entry | F.col("fill_step").isNotNull())
    tagged = running(filled, keys, {"entry_i": ("last", F.when(entry, F.col("i")))})
    pick = lambda c: F.when(F.col("kind") == FLAT, F.col(f"e_{c}")).when(F.col("kind") == ROLL_LONG, F.col(f"l_{c}")).otherwise(F.col(f"s_{c}"))
    given = [c for c in PARAMS if c in taken.columns]
    tagged = tagged.select(
        *keys, *given, "entry_i", "i", "kind", "side", "p_side", "ms", "fill_ms", "open_price", "fill_price", "fill_step",
        (F.col("i") + pick("step")).alias("exit_i"), pick("reason").alias("exit_reason"),
        pick("price").alias("raw_exit"), pick("ms").alias("exit_ms"),
    )
    opened = F.when(entry, F.struct("side", "p_side", "ms", "fill_ms", "open_price", "fill_price", (F.col("i") + F.col("fill_step")).alias("fill_i"), *given))
    last = F.struct("exit_i", "exit_reason", "raw_exit", "exit_ms")
    grouped = tagged.groupBy(*keys, "entry_i").agg(
        F.max(opened).alias("_o"), F.max_by(last, "i").alias("_x"),
        F.sum(F.when(~entry, 1).otherwise(0)).cast("long").alias("rollovers"),
    )
    out = grouped.select(
        *keys, "entry_i", F.col("_o.side").alias("side"), F.col("_o.p_side").alias("prob"), F.col("_o.ms").alias("signal_ms"),
        F.col("_o.fill_ms").alias("entry_ms"), F.col("_o.fill_i").alias("fill_i"), F.col("_o.open_price").alias("open_price"),
        F.col("_o.fill_price").alias("entry_price"), "_x.*", "rollovers",
        *[F.col(f"_o.{c}").alias(c) for c in given],
    )
    return price_trades(out, rules)


def price_trades(out: DataFrame, rules: Rules) -> DataFrame:
    """Effective exit price and per-unit costs of raw trades under one cost model."""
    c, maker = rules.costs, rules.maker_timeout is not None
    side, slippage, taker = F.col("side"), _param(out, "slippage", c.slippage), _param(out, "taker_fee", c.taker_fee)
    at_limit = (F.col("exit_reason") == "tp") if maker else F.lit(False)
    exit_price = F.when(at_limit, F.col("raw_exit")).otherwise(taker_price("raw_exit", side < 0, slippage))
    exit_rate = F.when(at_limit, c.maker_fee).otherwise(taker)
    out = out.withColumn("exit_price", exit_price)
    return out.withColumns({
        "unit_fees": F.col("entry_price") * (F.lit(c.maker_fee) if maker else taker) + F.col("exit_price") * exit_rate,
        "unit_gross": side * (F.col("exit_price") - F.col("entry_price")),
        "entry_fee_rate": F.lit(c.maker_fee) if maker else taker,
    })


def signal_counts(taken: DataFrame, keys: Sequence[str] = ("symbol",)) -> DataFrame:
    """Signals given while flat, how many were filled, and the fill rate; a limit order that is not reached is a miss."""
    entry = F.col("kind") == FLAT
    signals, fills = F.count_if(entry), F.count_if(entry & F.col("fill_step").isNotNull())
    return taken.groupBy(*keys).agg(
        signals.alias("n_signals"), fills.alias("n_fills"), F.coalesce(fills * 100.0 / F.nullif(signals, F.lit(0)), F.lit(0.0)).alias("fill_rate_pct"))


def account(priced: DataFrame, rules: Rules, keys: Sequence[str] = ("symbol",)) -> DataFrame:
    """Quantities, fees and PnL when each key compounds its own account.

    A trade multiplies cash by 1 + pct/price * (gross - fees per unit), so cash before a trade is a
    running product over earlier trades of the key.
    """
    net_unit = F.col("unit_gross") - F.col("unit_fees")
    share = _param(priced, "fraction", rules.position_pct)
    factor = F.coalesce(1.0 + share / F.col("open_price") * net_unit, F.lit(1.0))
    run = running(priced.withColumn("_f", factor), keys, {"_grown": ("prod", F.col("_f"))}, order="entry_i")
    run = run.withColumn("cash_before", rules.initial * F.col("_grown") / F.col("_f"))
    run = run.withColumn("qty", F.col("cash_before") * share / F.col("open_price"))
    return run.withColumns({
        "fees": F.col("qty") * F.col("unit_fees"),
        "pnl": F.col("qty") * net_unit,
        "cash_after": F.col("cash_before") * F.col("_f"),
        "r": net_unit / F.col("entry_price"),
        "gross_r": F.col("unit_gross") / F.col("entry_price"),
        "cost_r": F.col("unit_fees") / F.col("entry_price"),
    }).drop("_grown", "_f")


def equity_curve(bars: DataFrame, booked: DataFrame, rules: Rules, keys: Sequence[str] = ("symbol",)) -> DataFrame:
    """Equity and free cash at every bar close; a position is booked from its signal bar on.

    The trade covering a bar is the latest one entered at or before it: an equi-join on the
    entry ordinal followed by a running last, not a range join.
    """
    fee_in = F.col("qty") * F.col("entry_price") * F.col("entry_fee_rate")
    start = F.col("entry_i") if rules.maker_timeout is None else F.col("fill_i")
    info = booked.select(*keys, start.alias("i"), F.struct(
        "side", "qty", "entry_price", "exit_i", "cash_before", "cash_after", fee_in.alias("fee_in"),
        (F.col("qty") * F.col("entry_price")).alias("margin"),
    ).alias("_t"))
    marked = running(bars.join(info, [*keys, "i"], "left"), keys, {"_cur": ("last", F.col("_t"))})
    t = F.col("_cur")
    holding = t.isNotNull() & (t["exit_i"].isNull() | (F.col("i") < t["exit_i"]))
    cash = F.when(holding, t["cash_before"] - t["margin"] - t["fee_in"]).otherwise(F.coalesce(t["cash_after"], F.lit(rules.initial)))
    value = F.when(holding, t["margin"] + t["side"] * t["qty"] * (F.col("close") - t["entry_price"])).otherwise(0.0)
    return marked.withColumns({"cash": cash, "equity": cash + value}).drop("_t", "_cur")


def evaluate(scored: DataFrame, rules: Rules, keys: Sequence[str] = ("symbol",)) -> DataFrame:
    """Scored bars -> booked trades of one rule set, all keys (and scenarios as keys) in one job."""
    taken = chain(legs(scored, rules, keys), rules.reach, keys)
    return account(trades(taken, rules, keys), rules, keys)


# --- questions asked of a set of trades --------------------------------------------------------

def peak_concurrency(closed: DataFrame, step: int, entry: str = "entry_ms", exit_: str = "exit_ms") -> DataFrame:
    """Largest number of positions open at once; an exit frees its slot before an entry takes one.

    Changes are netted per instant first, so the running sum is over distinct instants.
    """
    moves = closed.select(F.explode(F.array(
        F.struct(F.col(entry).alias("ms"), F.lit(1).alias("d")), F.struct(F.col(exit_).alias("ms"), F.lit(-1).alias("d")),
    )).alias("m")).select("m.*").filter(F.col("ms").isNotNull())
    net = moves.groupBy("ms").agg(F.sum("d").alias("d"))
    level = running(net, [], {"open_positions": ("sum", F.col("d"))}, order="ms", rows=step * chunk_rows(closed.sparkSession))
    return level.agg(F.max("open_positions").alias("peak_open"))


def top_k_per_bar(candidates: DataFrame, k: int, order: Sequence[Column]) -> DataFrame:
    """The k best candidates of each bar; Catalyst pre-limits each group before the shuffle."""
    w = W.partitionBy("ms").orderBy(*order)
    return candidates.withColumn("rn", F.row_number().over(w)).filter(F.col("rn") <= k)


def slot_contention(candidates: DataFrame, slots: int) -> DataFrame:
    """Bars asking for more than ``slots`` entries, and by how many (static view)."""
    per_bar = candidates.groupBy("ms").agg(F.count(F.lit(1)).alias("n"))
    over = F.greatest(F.col("n") - slots, F.lit(0))
    return per_bar.agg(
        F.count(F.lit(1)).alias("bars"), F.sum("n").alias("candidates"),
        F.count_if(F.col("n") > slots).alias("contended_bars"), F.sum(over).alias("blocked"),
    )


def daily_loss_switch(closed: DataFrame, day_equity: DataFrame, limit: float, keys: Sequence[str] = ("book",)) -> DataFrame:
    """First trade of each UTC day whose book's realised PnL so far breaches limit * day-start equity.

    A book holds any number of symbols; its exits are taken in the order of (time, symbol). One window task sees the
    closed trades of one book and day.
    """
    day = F.floor(F.col("exit_ms") / 86_400_000).cast("long")
    t = closed.filter(F.col("exit_ms").isNotNull()).withColumn("day", day)
    w = W.partitionBy(*keys, "day").orderBy("exit_ms", "symbol").rowsBetween(W.unboundedPreceding, 0)
    per_exit = t.withColumn("realised", F.sum("pnl").over(w))
    hit = per_exit.join(day_equity, [*keys, "day"]).filter(F.col("realised") <= -limit * F.col("day_equity"))
    return hit.groupBy(*keys, "day").agg(
        F.min("exit_ms").alias("stopped_ms"), F.min_by("realised", F.struct("exit_ms", "symbol")).alias("realised"),
        F.first("day_equity").alias("day_equity"),
    )
