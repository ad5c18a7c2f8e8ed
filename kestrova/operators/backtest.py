"""Signals to operations, returns and summaries; confirmation of signals."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kestrova.functions.fold import fold
from kestrova.series import CODE, SEQ, quotient

REQUIRED = ("signal", "size", "portfolio_weight", "date")


def confirm(df: DataFrame, confirmations: int, signal: str = "signal", out: str = "confirmed") -> DataFrame:
    """A change of signal counts after more than ``confirmations`` rows in a row that
    differ from the signal held; the last of them is held then."""

    def step(state, value):
        held, count = state if state is not None else (value, 0)
        count = 0 if value == held else count + 1
        if count > confirmations:
            held, count = value, 0
        return (held, count), (held,)

    return fold(df, [signal], f"{out} int", lambda: None, step, keep=[c for c in df.columns if c != out])


def _ledger(slippage: float, brokerage: float):
    """The step of the ledger: (state, row) to (state, operations of the row)."""

    def cost(price, buys):
        return price * (1 + slippage) if buys else price * (1 - slippage)

    def enter(state, side, size, seq, ask, bid, weight, code, fresh):
        price = cost(ask if side == 1 else bid, side == 1)
        trade = f"{code}|{seq}" if fresh else state["trade"]
        paid, held = (0.0, 0.0) if fresh else (state["paid"], state["held"])
        amount = size if fresh else size - state["size"]
        new = state | {"trade": trade, "side": side, "size": size, "paid": paid + price * amount, "held": held + amount, "bought": amount + (0.0 if fresh else state["bought"])}
        if fresh:
            new["weight"] = weight
        return new, (trade, side, size, amount, price, None, -brokerage * amount * price, weight)

    def step(state, code, seq, side, size, ask, bid, weight):
        out = []
        if None in (side, size, ask, bid) or (side == state["side"] and size == state["size"]):
            return state, out
        if state["side"] == 0:
            if side != 0 and size != 0:
                state, op = enter(state, side, size, seq, ask, bid, weight, code, True)
                out.append(op)
        elif side == state["side"]:
            if size > state["size"]:
                state, op = enter(state, side, size, seq, ask, bid, weight, code, False)
            else:
                change, entry = size - state["size"], state["paid"] / state["bought"]
                price = cost(bid if side == 1 else ask, side != 1)
                op = (state["trade"], side, size, change, entry, price, side * (price - entry) * -change - brokerage * -change * price, weight)
                state = state | {"size": size, "held": state["held"] + change}
            out.append(op)
        else:
            if state["held"]:
                held, entry, last = state["held"], state["paid"] / state["bought"], state["side"]
                price = cost(bid if last == 1 else ask, last != 1)
                out.append((state["trade"], last, state["size"], -held, entry, price, last * (price - entry) * held - brokerage * held * price, state["weight"]))
                state = state | {"side": 0, "size": 0.0, "held": 0.0}
            if side != 0:
                state, op = enter(state, side, size, seq, ask, bid, weight, code, True)
                out.append(op)
        return state, out

    return step


def operations(signals: DataFrame, slippage: float = 0.0, brokerage: float = 0.0, ask: str = "ask_open", bid: str = "bid_open") -> DataFrame:
    """The ledger: one row an operation, as a fold over each code.

    A signal trades at the next row's price, and the last row closes what is open. Null signals
    and sizes are 0. Buying pays the ask and slippage, selling gets the bid less slippage;
    brokerage is on the notional. A row whose ask or bid is null trades nothing; the next row goes by its own signal, and what
    is open at such a last row stays open. A trade's id is its code and the seq at which it opened."""
    missing = [c for c in (*REQUIRED, ask, bid, CODE, SEQ) if c not in signals.columns]
    if missing:
        raise ValueError(f"missing columns: {missing}")
    order = Window.partitionBy(CODE).orderBy(SEQ)
    late = lambda c: F.lag(F.coalesce(F.col(c), F.lit(0))).over(order)
    rows = signals.select(CODE, SEQ, "date", late("signal").cast("int").alias("side"), late("size").cast("double").alias("size"), F.col(ask).cast("double").alias("ask"), F.col(bid).cast("double").alias("bid"), F.col("portfolio_weight").cast("double").alias("weight"), F.lead(SEQ).over(order).isNull().alias("last"), F.lag(SEQ).over(order).alias("before"))
    rows = rows.filter("before is not null").withColumn("side", F.when(F.col("last"), 0).otherwise(F.col("side")))
    step = _ledger(slippage, brokerage)

    def one(state, *values):
        state, out = step(state, *values)
        return state, tuple(v for op in (out + [None, None])[:2] for v in (op or (None,) * 8))

    fields = ("trade_id string", "side int", "size double", "size_op double", "entry_price double", "exit_price double", "unit_pnl double", "portfolio_weight double")
    names = [f.split()[0] for f in fields]
    kinds = ", ".join(f"{n}_{k} {t}" for k in (1, 2) for n, t in (f.split() for f in fields))
    start = lambda: {"trade": None, "side": 0, "size": 0.0, "paid": 0.0, "held": 0.0, "bought": 0.0, "weight": 0.0}
    made = fold(rows, [CODE, SEQ, "side", "size", "ask", "bid", "weight"], kinds, start, one, keep=[CODE, SEQ, "date"])
    op = lambda k: F.struct(F.lit(k).alias("part"), *[F.col(f"{n}_{k}").alias(n) for n in names])
    return made.select(CODE, SEQ, "date", F.explode(F.array(op(1), op(2))).alias("o")).filter("o.trade_id is not null").select(CODE, SEQ, "date", "o.*")


def with_returns(ops: DataFrame) -> DataFrame:
    return ops.withColumn("returns", F.try_divide(F.col("unit_pnl"), F.col("entry_price")) * F.col("portfolio_weight"))


def daily_summary(ops: DataFrame) -> DataFrame:
    """(date, nb_operations, daily_returns, cumulative_returns). One row a date, so the
    running product's single partition is bounded by the calendar."""
    day = ops.groupBy("date").agg(F.count(F.lit(1)).alias("nb_operations"), F.sum("returns").alias("daily_returns"))
    return day.withColumn("cumulative_returns", F.product(1 + F.col("daily_returns")).over(Window.orderBy("date").rowsBetween(Window.unboundedPreceding, 0)))


def underlying_summary(signals: DataFrame, ask: str = "ask_open") -> DataFrame:
    """(code, date, close, daily_returns, cumulative_returns) of the asset itself: the last ask of a date."""
    day = signals.groupBy(CODE, "date").agg(F.max_by(ask, SEQ).alias("close"))
    order = Window.partitionBy(CODE).orderBy("date")
    day = day.withColumn("daily_returns", F.coalesce(F.try_divide(F.col("close"), F.lag("close").over(order)) - 1, F.lit(0.0)))
    return day.withColumn("cumulative_returns", F.product(1 + F.col("daily_returns")).over(order.rowsBetween(Window.unboundedPreceding, 0)))


def quick_returns(df: DataFrame, price: str = "x", signal: str = "signal", size: str | None = None) -> DataFrame:
    """The next row's return times the signal (and size). From a price of zero the return is infinite on the side of the next
    price, and NaN to zero; times a signal of 0 these are NaN."""
    order = Window.partitionBy(CODE).orderBy(SEQ)
    value = (quotient(F.lead(price).over(order), F.col(price)) - 1) * F.col(signal)
    return df.withColumn("strategy_return", value * F.col(size) if size else value)


def run_backtest(signals: DataFrame, **costs: float) -> tuple[DataFrame, DataFrame]:
    """(operations with returns, daily summary)."""
    ops = with_returns(operations(signals, **costs))
    return ops, daily_summary(ops)
