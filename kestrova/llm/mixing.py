"""Mixing sources to target weights by hierarchical budgeting."""

from __future__ import annotations

from collections.abc import Sequence
from fractions import Fraction

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._common import written

#: What stands for null in a level's column.
NONE = "(none)"


def share_out(budget: Fraction, weights: Sequence[Fraction], caps: Sequence[Fraction]) -> list[Fraction]:
    """Parts of a budget in proportion to the weights, none above its cap. What one
    can't take is shared by the others in proportion, until all is given or all
    are full; a weight of 0 gets nothing."""
    given = [Fraction(0)] * len(caps)
    todo = sorted((i for i, w in enumerate(weights) if w > 0), key=lambda i: caps[i] / weights[i])
    left, weight = budget, sum((weights[i] for i in todo), Fraction(0))
    for i in todo:
        given[i] = min(caps[i], left * weights[i] / weight)
        left, weight = left - given[i], weight - weights[i]
    return given


def allocate(tokens: dict[tuple, int], weights: Sequence[dict], budget: int, max_epochs: int) -> dict[tuple, int]:
    """Tokens for each leaf, a path through the tree. A node's budget is shared by its children;
    a child can take what its leaves hold in ``max_epochs`` epochs. So a
    shortage goes to its siblings, and only what they can't take either to those of
    an ancestor. ``weights[k]`` has the weights of level k's values, 1 where missing."""
    out = {}

    def fill(leaves: list[tuple], level: int, budget: Fraction) -> None:
        if level == len(weights):
            out[leaves[0]] = int(budget)
            return
        children: dict = {}
        for leaf in leaves:
            children.setdefault(leaf[level], []).append(leaf)
        names = sorted(children)
        caps = [Fraction(max_epochs * sum(tokens[leaf] for leaf in children[n])) for n in names]
        for n, part in zip(names, share_out(budget, [Fraction(str(weights[level].get(n, 1))) for n in names], caps)):
            fill(children[n], level + 1, part)

    if tokens:
        fill(sorted(tokens), 0, Fraction(budget))
    return out


def word_count(text: Column) -> Column:
    """The number of words `[^\\x20\\x09-\\x0D]+`; 0 if null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def mix(docs: DataFrame, levels: Sequence[Column], weights: Sequence[dict], budget_share: float, max_epochs: int = 1, seed: int = 0, id_col: str = "doc_id", tokens: Column | None = None, times_col: str = "times") -> DataFrame:
    """Those rows of ``docs`` that are used, with ``times``: in how many epochs.

    The budget is ``budget_share`` of all tokens (by default words), and the tree's
    leaves are the values of ``levels`` that occur together. A leaf's tokens come
    from seeded epochs: each epoch is an order of its rows by a hash of seed, epoch
    and id; whole epochs are taken while they fit, and of the next one the longest
    prefix that does. The leaves are a part of the configuration and come to the
    driver. Prefixes are found by sums over hash buckets; only the bucket in which
    a leaf's budget ends is sorted. Rows are never shuffled: a leaf's last hash
    and id are broadcast and each row compares itself with them.

    A null level is the node `(none)`; null text has no tokens, and rows without
    tokens follow their hash. Null ids hash as the empty string. Rows with equal
    ids of one leaf are in or out together. No rows give no rows. A column named
    like ``times_col`` or beginning with `_mix` is replaced or dropped."""
    tokens = word_count(F.col("text")) if tokens is None else tokens
    keep = [c for c in docs.columns if c != times_col and not c.startswith("_mix")]
    names = [f"_mix{k}" for k in range(len(levels))]
    leaf = [F.coalesce(c.cast("string"), F.lit(NONE)).alias(n) for c, n in zip(levels, names)]
    ident = F.coalesce(F.col(id_col).cast("string"), F.lit(""))
    rows = written(docs.select(*leaf, ident.alias("_mix_id"), tokens.cast("long").alias("_mix_tokens")), "mix")
    held = {tuple(r[n] for n in names): (r.t, r.n) for r in rows.groupBy(*names).agg(F.sum("_mix_tokens").alias("t"), F.count("*").alias("n")).collect()}
    total = sum(t for t, _ in held.values())
    budgets = allocate({k: t for k, (t, _) in held.items()}, weights, int(Fraction(str(budget_share)) * total), max_epochs)
    plan = [(*k, budgets[k] // t if t else max_epochs, budgets[k] % t if t else 0) for k, (t, _) in held.items()]
    spark = docs.sparkSession
    plan = spark.createDataFrame(plan, ", ".join(f"{n} string" for n in names) + ", _mix_full int, _mix_rest long")
    digits = 3
    while max((n for _, n in held.values()), default=0) / 16**digits > 10000:
        digits += 1
    key = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("_mix_full").cast("string"), F.col("_mix_id")))
    keyed = rows.join(F.broadcast(plan), names).withColumn("_mix_key", key).withColumn("_mix_bucket", F.substring("_mix_key", 1, digits))
    up_to = Window.partitionBy(*names).orderBy("_mix_bucket")
    sums = keyed.groupBy(*names, "_mix_bucket", "_mix_rest").agg(F.sum("_mix_tokens").alias("_mix_sum"))
    sums = sums.withColumn("_mix_to", F.sum("_mix_sum").over(up_to)).filter(F.col("_mix_to") > F.col("_mix_rest"))
    ends = sums.groupBy(*names).agg(F.min("_mix_bucket").alias("_mix_end"), (F.min(F.struct("_mix_to", "_mix_sum"))).alias("_mix_s"))
    ends = ends.select(*names, F.col("_mix_end"), (F.col("_mix_s._mix_to") - F.col("_mix_s._mix_sum")).alias("_mix_before"))
    within = Window.partitionBy(*names).orderBy("_mix_key", "_mix_id")
    at_end = keyed.join(F.broadcast(ends), names).filter(F.col("_mix_bucket") == F.col("_mix_end"))
    over = at_end.withColumn("_mix_to", F.col("_mix_before") + F.sum("_mix_tokens").over(within)).filter(F.col("_mix_to") > F.col("_mix_rest"))
    cuts = written(over.groupBy(*names).agg(F.min(F.struct("_mix_key", "_mix_id")).alias("_mix_cut")), "cuts")
    plan = plan.join(cuts, names, "left")
    out = docs.select(*keep, *leaf, ident.alias("_mix_id")).join(F.broadcast(plan), names).withColumn("_mix_key", key)
    partly = (F.col("_mix_full") < max_epochs) & (F.col("_mix_cut").isNull() | (F.struct("_mix_key", "_mix_id") < F.col("_mix_cut")))
    out = out.withColumn(times_col, F.col("_mix_full") + F.when(partly, 1).otherwise(0))
    return out.filter(F.col(times_col) > 0).select(*keep, times_col)
