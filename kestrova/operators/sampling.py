"""Event-driven bars, daily decomposition and weighted samples."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from kestrova.functions.fold import fold
from kestrova.series import CODE, SEQ, Staged, relative


def _order() -> WindowSpec:
    return Window.partitionBy(CODE).orderBy(SEQ)


#: Rules of an aggregation by name; first and last are by seq.
RULES = {"first": lambda c: F.min_by(c, SEQ), "last": lambda c: F.max_by(c, SEQ), "max": F.max, "min": F.min, "sum": F.sum, "mean": F.avg, "count": F.count}
OHLCV = {"open": "first", "high": "max", "low": "min", "close": "last", "volume": "sum"}


def bar_ids(df: DataFrame, column: str, threshold: float | str, weight: str | None = None) -> DataFrame:
    """``df`` with ``bar``: it grows when the running sum of ``column`` reaches the
    threshold (a number or a column), and the sum starts again from zero. With ``weight``, values are
    multiplied by that column."""
    value = F.col(column) * F.col(weight) if weight else F.col(column)
    bound = F.col(threshold) if isinstance(threshold, str) else F.lit(float(threshold))
    rows = df.withColumn("_value", value.cast("double")).withColumn("_bound", bound.cast("double"))

    def step(state, v, bound):
        total, bar = state
        total += v or 0.0
        return ((0.0, bar + 1) if bound is not None and total >= bound else (total, bar)), (bar,)

    return fold(rows, ["_value", "_bound"], "bar bigint", lambda: (0.0, 0), step, keep=df.columns)


def cumulative_bars(df: DataFrame, column: str, threshold: float | str, rules: dict[str, str] = OHLCV, other: str = "mean", weight: str | None = None) -> DataFrame:
    """One row a bar: the columns of ``rules``, then the other numeric ones in order of
    name by the rule ``other``. The last bar may be short of the threshold."""
    extra = sorted(c for c, kind in df.dtypes if c not in rules and c not in (CODE, SEQ, threshold) and kind not in ("string", "boolean") and not kind.startswith(("array", "map", "struct")))
    made = [RULES[r](c).alias(c) for c, r in rules.items()] + [RULES[other](c).alias(c) for c in extra]
    return bar_ids(df, column, threshold, weight).groupBy(CODE, "bar").agg(*made)


def dynamic_threshold(df: DataFrame, group: str, column: str, target_bars: int, groups: int, first: float | None = None) -> DataFrame:
    """``df`` with ``threshold``: what makes about ``target_bars`` bars of the mean total of the ``groups``
    groups before; ``first`` where there are fewer."""
    if first is None and not groups:
        raise ValueError("a threshold needs groups before, or a first value")
    totals = df.groupBy(CODE, group).agg(F.sum(column).alias("_total"))
    before = Window.partitionBy(CODE).orderBy(group).rowsBetween(-groups, -1)
    value = F.when(F.count("_total").over(before) == groups, F.floor(F.avg("_total").over(before) / target_bars).cast("double")).otherwise(F.lit(first).cast("double"))
    return df.join(totals.select(CODE, group, value.alias("threshold")), [CODE, group])


def decompose(bars: DataFrame, date: str = "date") -> DataFrame:
    """Daily intraday, overnight and complete moves: (code, date, kind, open, close, high, low).

    A day opens with its first row and closes with its last. Intraday goes from open to close, overnight on
    to the next open, complete from open to the next open. The first day is as it is, the
    later ones chained: each opens at the close before. The last day has no next one and drops out. A move from
    a price of zero has no ratio: from it on, prices of its kind are null."""
    day = bars.groupBy(CODE, date).agg(F.min_by("open", SEQ).alias("o"), F.max_by("close", SEQ).alias("c"), F.max("high").alias("h"), F.min("low").alias("l"))
    order = Window.partitionBy(CODE).orderBy(date)
    day = day.withColumn("n", F.lead("o").over(order)).filter("n is not null")
    kinds = {"intraday": ("o", "c", "h", "l"), "overnight": ("c", "n", None, None), "complete": ("o", "n", "h", "l")}
    rows = F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.col(a).alias("a"), F.col(b).alias("b"), F.greatest(a, b, *([h] if h else [])).alias("h"), F.least(a, b, *([lo] if lo else [])).alias("l")) for k, (a, b, h, lo) in kinds.items()]))
    every = day.select(CODE, date, rows.alias("r")).select(CODE, date, "r.*")
    own = Window.partitionBy(CODE, "kind").orderBy(date)
    ratio = F.try_divide(F.col("b"), F.col("a"))
    chained = every.withColumn("_close", F.when(F.count_if(ratio.isNull()).over(own) == 0, F.first("a").over(own) * F.product(ratio).over(own)))
    opened = chained.withColumn("_open", F.when(F.row_number().over(own) == 1, F.col("a")).otherwise(F.lag("_close").over(own)))
    scale = F.try_divide(F.col("_open"), F.col("a"))
    return opened.select(CODE, date, "kind", F.col("_open").alias("open"), F.col("_close").alias("close"), (F.col("h") * scale).alias("high"), (F.col("l") * scale).alias("low"))


def events(df: DataFrame, upper: float, vertical: int, vol_window: int, label: str = "label", price: str = "x") -> DataFrame:
    """(code, seq, label, price, volatility, start, end, event_returns) of each labelled row with a
    volatility: where the next ``vertical`` rows end its event, and the return on its side, null if wrong.
    From a price of zero any rise is over the bound, and the return null."""
    s = Staged()
    r = s.put(0, "_r", F.try_divide(F.col(price), s.lag(price)) - 1)
    frame = s.T(vol_window)
    vol = s.full(F.stddev_samp(r).over(frame), r, frame, vol_window) * (vol_window**0.5)
    rows = s.apply(df, vol.alias("volatility"), keep=[CODE, SEQ, label, price]).dropna(subset=[label, price, "volatility"])
    place = (F.row_number().over(_order()) - 1).cast("long")
    ahead = Window.partitionBy(CODE).orderBy("start").rowsBetween(0, vertical)
    rows = rows.withColumn("start", place)
    x = F.col(price)
    rows = rows.withColumns({
        "_hi": F.max(price).over(ahead), "_lo": F.min(price).over(ahead), "_last": F.last(price).over(ahead), "_to": F.max("start").over(ahead),
        "_hi_at": F.min_by("start", F.struct(-x, "start")).over(ahead), "_lo_at": F.min_by("start", F.struct(x, "start")).over(ahead),
    })
    bound = F.col("volatility") * upper
    final, up, down = (relative(F.col(c) - x, x) for c in ("_last", "_hi", "_lo"))
    end = F.when((F.col(label) == 1) & (up >= bound), F.col("_hi_at")).when((F.col(label) == -1) & (down <= -bound), F.col("_lo_at")).otherwise(F.col("_to"))
    gain = F.when(F.col(label) == 1, F.when(up < bound, F.when(final > 0, final)).otherwise(up)).when(F.col(label) == -1, F.when(down > -bound, F.when(final < 0, -final)).otherwise(-down)).otherwise(bound / 2)
    return rows.select(CODE, SEQ, label, price, "volatility", "start", end.alias("end"), F.when(F.abs(gain) < float("inf"), gain).alias("event_returns"))


def concurrency(rows: DataFrame, label: str = "label") -> DataFrame:
    """``rows`` (code, start, end, label) with ``concurrent``: 1 and the events of the same label
    that are open when it starts, and when it ends. Counts of starts and ends up to a
    place are running sums over a sweep of places, so no event meets another."""
    starts = rows.select(CODE, label, F.col("start").alias("at"), F.lit(1).alias("s"), F.lit(0).alias("e"))
    ends = rows.select(CODE, label, F.col("end").alias("at"), F.lit(0).alias("s"), F.lit(1).alias("e"))
    places = starts.unionByName(ends).groupBy(CODE, label, "at").agg(F.sum("s").alias("s"), F.sum("e").alias("e"))
    before = Window.partitionBy(CODE, label).orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    # open at q: started before q, and not ended before q
    places = places.select(CODE, label, "at", (F.coalesce(F.sum("s").over(before), F.lit(0)) - F.coalesce(F.sum("e").over(before), F.lit(0))).alias("open"))
    # an event that starts and ends at one place before q counts in both sums, so they cancel
    of = lambda c: places.select(CODE, label, F.col("at").alias(c), F.col("open").alias(f"_{c}"))
    joined = rows.join(of("start"), [CODE, label, "start"]).join(of("end"), [CODE, label, "end"])
    return joined.select(*rows.columns, (F.col("_start") + F.col("_end") + 1).cast("long").alias("concurrent"))


def sample_weights(df: DataFrame, upper: float, vertical: int, vol_window: int, label: str = "label", price: str = "x") -> DataFrame:
    """``events`` with ``sample_weight``: uniqueness x linear time decay x return, each and
    their product normalised within the code."""
    rows = concurrency(events(df, upper, vertical, vol_window, label, price), label)
    own = Window.partitionBy(CODE)
    rows = rows.withColumn("_u", 1 / F.col("concurrent")).withColumn("_d", (F.col("start") + 1) / F.count(F.lit(1)).over(own))
    share = lambda c: F.try_divide(F.col(c), F.sum(c).over(own))
    rows = rows.withColumn("_w", share("_u") * share("_d") * share("event_returns"))
    return rows.withColumn("sample_weight", F.try_divide(F.col("_w"), F.sum("_w").over(own))).drop("_u", "_d", "_w")


def draw(rows: DataFrame, n: float, weight: str = "sample_weight", by: Sequence[str] = (), replacement: bool = False, seed: int = 72, key: Sequence[str] = (CODE, SEQ)) -> DataFrame:
    """A weighted sample; ``n`` is a count or, with ``by``, a share of all rows divided among the groups.

    Without replacement the rows with the largest ln(u) / weight are taken (Efraimidis and
    Spirakis); with replacement each draw falls on a row by its weight, independent of the others. u is a hash of
    seed and key, so a sample can be made again."""
    rows = rows.filter(F.col(weight) > 0)
    u = (F.pmod(F.xxhash64(F.lit(seed), *key), F.lit(2**53 - 1)) + 1) / float(2**53)
    groups = list(by)
    size = rows.groupBy(*groups).agg(F.count(F.lit(1)).alias("_rows"), F.sum(weight).alias("_total"))
    if groups:
        labels = size.count()
        whole = size.agg(F.sum("_rows")).first()[0] or 0
        take = float(int(whole * n // max(labels, 1)))
    else:
        take = float(n)
    if replacement:
        return _drawn(rows, int(take), weight, groups, seed, key)
    scored = rows.withColumn("_score", F.log(u) / F.col(weight))
    if not groups:
        return scored.orderBy(F.desc("_score"), *key).limit(int(take)).drop("_score")
    place = F.row_number().over(Window.partitionBy(*groups).orderBy(F.desc("_score"), *key))
    return scored.withColumn("_place", place).filter(F.col("_place") <= take).drop("_place", "_score")


def _drawn(rows: DataFrame, take: int, weight: str, groups: list[str], seed: int, key: Sequence[str]) -> DataFrame:
    """``take`` independent draws in each group. A group's rows lie side by side on a line, each as long as its weight, in
    blocks by hash so that no group is in one task; a draw is a place on the line, finds
    its block among the block's starts (1000 at most) and its row by sorting places into the block."""
    own = groups or ["_all"]
    columns = rows.columns
    rows = rows.withColumn("_all", F.lit(0))
    held = rows.groupBy(*own).agg(F.count(F.lit(1)).alias("_rows"))
    rows = rows.join(held, own).withColumn("_block", F.pmod(F.xxhash64(F.lit(seed + 1), *key), F.least(F.ceil(F.col("_rows") / 50000), F.lit(1000))).cast("int"))
    before = Window.partitionBy(*own).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = rows.groupBy(*own, "_block").agg(F.sum(weight).alias("_weight"))
    blocks = blocks.withColumn("_from", F.coalesce(F.sum("_weight").over(before), F.lit(0.0)))
    lines = blocks.groupBy(*own).agg(F.sum("_weight").alias("_total"), F.sort_array(F.collect_list(F.struct("_from", "_block"))).alias("_starts"))
    every = 10000
    draws = lines.withColumn("_chunk", F.explode(F.sequence(F.lit(0), F.lit(max(take - 1, 0) // every)))).withColumn("_nth", F.explode(F.sequence(F.lit(0), F.lit(every - 1))))
    draws = draws.withColumn("_nth", F.col("_chunk").cast("long") * every + F.col("_nth")).filter(F.col("_nth") < take)
    u = F.pmod(F.xxhash64(F.lit(seed), *own, "_nth"), F.lit(2**53)) / float(2**53)
    draws = draws.withColumn("_at", u * F.col("_total")).withColumn("_in", F.element_at(F.filter("_starts", lambda s: s["_from"] <= F.col("_at")), -1))
    draws = draws.select(*own, F.col("_in._block").alias("_block"), (F.col("_at") - F.col("_in._from")).alias("_at"), F.lit(None).cast(rows.select(F.struct(*columns)).schema[0].dataType).alias("_row"))
    along = Window.partitionBy(*own, "_block").orderBy(*key).rowsBetween(Window.unboundedPreceding, -1)
    placed = rows.select(*own, "_block", F.coalesce(F.sum(weight).over(along), F.lit(0.0)).alias("_at"), F.struct(*columns).alias("_row"))
    line = Window.partitionBy(*own, "_block").orderBy("_at", F.col("_row").isNull())
    met = placed.unionByName(draws).withColumn("_drawn", F.col("_row").isNull()).withColumn("_row", F.last("_row", ignorenulls=True).over(line))
    return met.filter("_drawn").select("_row.*")


def time_decay(order: Sequence[str | Column] = (SEQ,)) -> Column:
    """From 1 / n to 1 along a code."""
    return F.row_number().over(Window.partitionBy(CODE).orderBy(*order)) / F.count(F.lit(1)).over(Window.partitionBy(CODE))
