"""The event-driven operators over streams: bars, confirmation, windowed summaries."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def _stateful(stream: DataFrame, key: str, step, start: dict, state: str, outputs: str, order: str) -> DataFrame:
    names = list(start)

    def run(group: tuple, frames: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        now = dict(zip(names, held.get)) if held.exists else dict(start)
        out = []
        for frame in frames:
            for row in frame.sort_values(order).to_dict("records"):
                out += step(now, group[0], row)
        held.update(tuple(now[n] for n in names))
        if out:
            yield pd.DataFrame(out)

    return stream.groupBy(key).applyInPandasWithState(run, outputs, state, "append", GroupStateTimeout.NoTimeout)


def bars(stream: DataFrame, threshold: float, key: str = "user_id", order: str = "ts", price: str = "value", size: str = "value") -> DataFrame:
    """A row for each bar of a key that closes: (code, bar, open, high, low, close, volume, n).
    The running sum of ``size`` starts again when it reaches the threshold; the open bar is the state."""

    def step(now, code, row):
        p, q = row[price], row[size]
        if now["n"] == 0:
            now.update(open=p, high=p, low=p)
        now.update(high=max(now["high"], p), low=min(now["low"], p), close=p, volume=now["volume"] + q, n=now["n"] + 1)
        if now["volume"] < threshold:
            return []
        done = {"code": code} | {k: now[k] for k in ("bar", "open", "high", "low", "close", "volume", "n")}
        now.update(bar=now["bar"] + 1, n=0, volume=0.0)
        return [done]

    start = {"bar": 0, "open": 0.0, "high": 0.0, "low": 0.0, "close": 0.0, "volume": 0.0, "n": 0}
    kinds = "bar long, open double, high double, low double, close double, volume double, n long"
    return _stateful(stream, key, step, start, kinds, f"code long, {kinds}", order)


def confirm(stream: DataFrame, confirmations: int, key: str = "code", order: str = "seq", signal: str = "signal") -> DataFrame:
    """The confirmation filter over a stream: (code, seq, signal, confirmed)."""

    def step(now, code, row):
        value = int(row[signal])
        if not now["begun"]:
            now.update(begun=True, held=value)
        now["count"] = 0 if value == now["held"] else now["count"] + 1
        if now["count"] > confirmations:
            now.update(held=value, count=0)
        return [{"code": code, "seq": row[order], "signal": value, "confirmed": now["held"]}]

    return _stateful(stream, key, step, {"begun": False, "held": 0, "count": 0}, "begun boolean, held int, count int", "code long, seq long, signal int, confirmed int", order)


def candles(stream: DataFrame, width: str = "1 day", late: str = "1 day", key: str = "user_id", ts: str = "ts", price: str = "value") -> DataFrame:
    """Candles by time, final once the watermark has passed them: (code, start, open, high, low, close, n)."""
    grouped = stream.withWatermark(ts, late).groupBy(F.window(ts, width), F.col(key).alias("code"))
    out = grouped.agg(F.min_by(price, ts).alias("open"), F.max(price).alias("high"), F.min(price).alias("low"), F.max_by(price, ts).alias("close"), F.count(F.lit(1)).alias("n"))
    return out.select("code", F.col("window.start").alias("start"), "open", "high", "low", "close", "n")
