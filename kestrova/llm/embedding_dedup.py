"""Near-duplicate embeddings by lattice hashing."""

from __future__ import annotations

from functools import cache
from itertools import combinations, product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import components, join_groups, small, spanning, written
from .textvec import mix


@cache
def roots() -> np.ndarray:
    """The 240 shortest vectors of E8: two entries of +-1, or eight of +-1/2 with
    an even number of minus signs."""
    out = []
    for i, j in combinations(range(8), 2):
        for a, b in product((1.0, -1.0), repeat=2):
            v = [0.0] * 8
            v[i], v[j] = a, b
            out.append(v)
    out += [v for v in product((0.5, -0.5), repeat=8) if sum(x < 0 for x in v) % 2 == 0]
    return np.array(out)


def decode(x: np.ndarray) -> np.ndarray:
    """The E8 point next to each row: the nearer of those in D8 and in D8 + 1/2. In D8,
    rounding is right if the sum is even; else the worst coordinate goes the other way."""
    best, least = None, None
    for shift in (0.0, 0.5):
        point = np.rint(x - shift)
        off = x - shift - point
        odd = np.flatnonzero(point.sum(1) % 2)
        worst = np.abs(off[odd]).argmax(1)
        point[odd, worst] += np.where(off[odd, worst] >= 0, 1, -1)
        point += shift
        far = ((x - point) ** 2).sum(1)
        if best is None:
            best, least = point, far
        else:
            best = np.where((far < least)[:, None], point, best)
    return best


@cache
def projection(table: int, dim: int, seed: int) -> np.ndarray:
    """Eight random orthonormal directions, scaled to keep distances on average."""
    rng = np.random.default_rng([seed, table, dim])
    q = np.linalg.qr(rng.normal(size=(max(dim, 8), 8)))[0][:dim]
    return q * np.sqrt(max(dim, 8) / 8)


def cells(unit: np.ndarray, table: int, cell: float, probes: int, seed: int) -> np.ndarray:
    """(rows, 1 + probes) cell names: each row's own, then the neighbouring cells nearest to it."""
    x = unit @ projection(table, unit.shape[1], seed) / cell
    own = decode(x)
    points = own[:, None, :]
    if probes:
        # |x - own - r|^2 is least where (x - own) . r - |r|^2 / 2 is most; all roots are as long
        near = np.argpartition(-((x - own) @ roots().T), probes, axis=1)[:, :probes]
        points = np.concatenate([points, points + roots()[near]], axis=1)
    twice = np.rint(points * 2).astype(np.int64).view(np.uint64)
    name = np.full(twice.shape[:2], (table + 1) * 1000003 + unit.shape[1], dtype=np.uint64)
    for k in range(8):
        name = mix(name * np.uint64(0x9E3779B97F4A7C15) + twice[:, :, k])
    return name.view(np.int64)


def _unit(vectors: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
    """(rows, unit vectors) for each length of vector."""
    size = vectors.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    out = []
    for n in np.unique(size):
        at = np.flatnonzero(size == n)
        x = np.array(vectors.take(pa.array(at)).flatten(), dtype=np.float64).reshape(-1, n)
        out.append((at, x / np.linalg.norm(x, axis=1, keepdims=True)))
    return out


def embedding_links(vectors: DataFrame, threshold: float = 0.95, id_col: str = "vec_id", vector_col: str = "embedding", tables: int = 6, probes: int = 4, cell: float = 0.5, block: int = 2000, seed: int = 8) -> DataFrame:
    """One row a vector: id, n_links, component_id, kept.

    Two vectors link when their cosine, in double precision, is ``threshold`` or
    more. n_links counts a vector's others, component_id is the smallest id that links reach,
    kept says if that is its own.

    Equal vectors are one, with a multiplicity. Each is projected to eight random
    dimensions in each of ``tables`` tables and decoded to the nearest E8 lattice point, scaled by ``cell``;
    it also looks into the ``probes`` neighbouring cells nearest to it. Whatever meets
    is verified. A pair counts in the first table that finds it, which both ends can tell, so
    tasks send sums of counts and spanning edges, never pairs. Cells of over
    ``block`` vectors are dealt into blocks that the cell's other vectors stream past.
    No link is found that isn't there; how few are missed depends on tables, probes and
    cell (``tests/llm`` measures it).

    Vectors that are null, empty, zero or hold null, NaN or infinity link with nothing,
    nor do vectors of different lengths. Rows repeated in full are others of each other. Null ids are kept.
    No rows give no rows. Other columns are ignored, whatever their names."""
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    x = F.col("vector")
    good = F.coalesce((F.size(x) > 0) & ~F.exists(x, bad) & F.exists(x, lambda v: v != 0), F.lit(False))
    rows = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).alias("vector"))
    total = rows.count()
    distinct = rows.filter(good).groupBy("vector").agg(F.min("id").alias("least"), F.count("*").alias("copies"))
    distinct = written(distinct.withColumn("vid", F.monotonically_increasing_id()), "vectors")

    def homes(batches):
        for batch in batches:
            for _, unit in _unit(batch.column(0)):
                names = np.concatenate([cells(unit, t, cell, 0, seed)[:, 0] for t in range(tables)])
                name, n = np.unique(names, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(name), pa.array(n.astype(np.int64))], names=["cell", "n"])

    crowded = distinct.select("vector").mapInArrow(homes, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).filter(F.col("n") > block)
    crowded = small(crowded.select("cell", F.ceil(F.col("n") / block).cast("int").alias("blocks")))

    def look(batches):
        for batch in batches:
            for at, unit in _unit(batch.column(1)):
                chosen = batch.take(pa.array(at))
                for t in range(tables):
                    names = cells(unit, t, cell, probes, seed)
                    for k in range(1 + probes):
                        n = len(at)
                        yield pa.RecordBatch.from_arrays([pa.array(names[:, k]), pa.array(np.full(n, t, np.int32)), pa.array(np.full(n, k > 0)), *chosen.columns], names=["cell", "table", "probe", "vid", "vector", "copies"])

    kind = distinct.schema["vector"].dataType.simpleString()
    seen = distinct.select("vid", "vector", "copies").mapInArrow(look, f"cell long, table int, probe boolean, vid long, vector {kind}, copies long")
    seen = seen.join(crowded, "cell", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    own = F.pmod(F.xxhash64("vid"), "blocks").cast("int")
    every = F.sequence(F.lit(0), F.col("blocks") - 1)
    held = seen.filter("not probe").withColumn("block", own).withColumn("past", F.lit(False))
    past = seen.filter("probe or blocks > 1").withColumn("own", own).withColumn("block", F.explode(every)).filter("probe or block <> own").drop("own").withColumn("past", F.lit(True))
    dealt = held.unionByName(past).drop("blocks").repartition("cell", "block").sortWithinPartitions("cell", "block", "past")

    def counted(t, x, y, x_id, y_id, x_probes):
        """Whether table t is the first to find these pairs, and this way of it."""
        first = np.ones(len(x), dtype=bool)
        xs, x_of = np.unique(x_id, return_index=True)
        ys, y_of = np.unique(y_id, return_index=True)
        x_at, y_at = np.searchsorted(xs, x_id), np.searchsorted(ys, y_id)
        for s in range(t + 1):
            a, b = cells(x[x_of], s, cell, probes, seed), cells(y[y_of], s, cell, probes, seed)
            back = (b[y_at, 1:] == a[x_at, :1]).any(1)
            if s < t:
                first &= ~(back | (a[x_at] == b[y_at, :1]).any(1))
            else:  # both ends may probe the other's cell
                first &= ~(x_probes & back) | (x_id < y_id)
        return first

    def meet(batches):
        totals: dict[int, int] = {}
        pairs = []
        at, have = None, None
        for batch in batches:
            names, number, past, probe, vid, copies, table = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("cell", "block", "past", "probe", "vid", "copies", "table"))
            units = [None] * len(names)
            for rows_at, unit in _unit(batch.column("vector")):
                for i, u in zip(rows_at.tolist(), unit):
                    units[i] = u
            new = np.ones(len(names), dtype=bool)
            new[1:] = (names[1:] != names[:-1]) | (number[1:] != number[:-1])
            first = np.flatnonzero(new)
            for low, high in zip(first.tolist(), np.append(first[1:], len(names)).tolist()):
                if (names[low], number[low]) != at:
                    at, have = (names[low], number[low]), None
                middle = low + int(np.searchsorted(past[low:high], True))
                for a, b, inside in ((low, middle, True), (middle, high, False)):
                    if a == b or have is None and not inside:
                        continue
                    x, x_id, x_copies = np.stack(units[a:b]), vid[a:b], copies[a:b]
                    # held before this batch: new rows meet these once, so in either order of ids
                    before = len(have[1]) if inside and have is not None else 0
                    if inside:
                        have = (x, x_id, x_copies) if have is None else tuple(np.concatenate(z) for z in zip(have, (x, x_id, x_copies)))
                    if have is None:
                        continue
                    y, y_id, y_copies = have
                    if not inside and len(y) * (b - a) == 0:
                        continue
                    near = x @ y.T >= threshold - 1e-9
                    i, j = np.nonzero(near)
                    x_probes = probe[a:b][i]
                    keep = x_probes | (j < before) | (x_id[i] > y_id[j])
                    keep &= x_id[i] != y_id[j]
                    i, j, x_probes = i[keep], j[keep], x_probes[keep]
                    exact = np.einsum("ij,ij->i", x[i], y[j]) >= threshold
                    i, j, x_probes = i[exact], j[exact], x_probes[exact]
                    if not len(i):
                        continue
                    take = counted(int(table[a]), x[i], y[j], x_id[i], y_id[j], x_probes)
                    i, j = i[take], j[take]
                    for who, n in ((x_id[i], y_copies[j]), (y_id[j], x_copies[i])):
                        ids, code = np.unique(who, return_inverse=True)
                        for v, c in zip(ids.tolist(), np.bincount(code, n, len(ids)).tolist()):
                            totals[v] = totals.get(v, 0) + int(c)
                    pairs.append((x_id[i], y_id[j]))
            if len(totals) > 100_000 or len(pairs) > 10_000:
                yield from sent(totals, pairs)
                totals, pairs = {}, []
        yield from sent(totals, pairs)

    def sent(totals, pairs):
        a, b = spanning(pairs)
        yield pa.RecordBatch.from_arrays([pa.array([*totals, *a.tolist()], type=pa.int64()), pa.array([None] * len(totals) + b.tolist(), type=pa.int64()), pa.array([*totals.values(), *([0] * len(a))], type=pa.int64())], names=["a", "b", "n"])

    found = written(dealt.mapInArrow(meet, "a long, b long, n long"), "links")
    links = found.filter("b is null").groupBy(F.col("a").alias("vid")).agg(F.sum("n").alias("n"))
    parts = components(found.filter("b is not null").select("a", "b")).withColumnRenamed("id", "vid")
    named = distinct.drop("vector").join(links, "vid", "left").join(parts, "vid", "left").withColumn("component", F.coalesce("component", "vid"))
    least = named.groupBy("component").agg(F.min("least").alias("component_id"))
    named = named.join(least, "component").select("vid", F.coalesce("n", F.lit(0)).alias("n"), "component_id").join(distinct.select("vid", "vector", "copies"), "vid")
    out = join_groups(rows.filter(good), written(named, "named"), ["vector"], "copies", total)
    out = out.select("id", (F.col("n") + F.col("copies") - 1).alias("n_links"), "component_id")
    out = out.unionByName(rows.filter(~good).select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id")))
    return out.select(F.col("id").alias(id_col), "n_links", "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))
