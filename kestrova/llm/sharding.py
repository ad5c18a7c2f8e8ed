"""Sharding by longest-processing-time scheduling."""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import join_groups, with_ranks, written


def schedule(sizes: list[int], counts: list[int], shards: int) -> np.ndarray:
    """Longest-processing-time scheduling of groups given as a histogram.

    Sizes must fall. Row k has the bounds of each shard's share of the groups of
    size k: shard i gets those ranked bounds[k, i] to bounds[k, i + 1] - 1. Groups
    of a size are alike, so this is what taking one group at a time gives: the
    least-loaded shard (the first of equals) comes off a heap, takes a group and
    goes back. Whole rounds are taken at once when the loads lie within a group's
    size, as the heap then goes round the shards."""
    heap = [(0, i) for i in range(shards)]
    bounds = np.zeros((len(sizes), shards + 1), dtype=np.int64)
    for k, (size, count) in enumerate(zip(sizes, counts)):
        got = [0] * shards
        while count:
            if count > 2 * shards:
                level = max(heap)[0] - 1
                rise = [max(0, (level - load) // size) for load, _ in heap]
                if sum(rise) >= count:  # a far shard: only the others take groups, up to a level
                    low, high = heap[0][0], level
                    while low < high:
                        middle = (low + high + 1) // 2
                        if sum(max(0, (middle - load) // size) for load, _ in heap) <= count - shards:
                            low = middle
                        else:
                            high = middle - 1
                    rise = [max(0, (low - load) // size) for load, _ in heap]
                elif not any(rise):
                    rise = [(count - shards) // shards] * shards
                if any(rise):
                    for (_, i), n in zip(heap, rise):
                        got[i] += n
                    heap = [(load + n * size, i) for (load, i), n in zip(heap, rise)]
                    heapq.heapify(heap)
                    count -= sum(rise)
                    continue
            load, i = heap[0]
            heapq.heapreplace(heap, (load + size, i))
            got[i] += 1
            count -= 1
        bounds[k, 1:] = np.cumsum(got)
    return bounds


def shard(docs: DataFrame, shards: int = 16, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: id, size (UTF-8 bytes and 1), text_crc32, shard, slot.

    Rows with equal texts form a group and stay together. The groups, by falling
    size, go to the least-loaded shard through a heap. That depends only on how
    many groups have each size, so the driver gets a histogram: d distinct sizes
    need d * (d + 1) / 2 bytes of text at least, so it has under sqrt(2 * bytes)
    rows however many groups there are. Groups are ranked among those of their
    size, and rows within their shard, without bringing a group into one task.

    A null text has no bytes and is in the group of the empty text, its checksum
    is 0. Ids may be null or repeat. Of two groups of one size the order is that of
    their texts' hashes, and slots follow the hash of id and text, so the same rows give the same result
    however they lie. No rows give no rows. Other columns are ignored, whatever their names.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("crc"), F.unhex(F.sha2(text, 256)).alias("key"))
    rows = written(rows, "sizes")
    groups = rows.groupBy("key").agg(F.sum("size").alias("bytes"), F.count("*").alias("members"))
    ranked = written(with_ranks(groups, "bytes", ["key"], "groups"), "ranked")
    sizes = ranked.groupBy("bytes").count().toPandas().sort_values("bytes", ascending=False)
    bounds = schedule(sizes["bytes"].tolist(), sizes["count"].tolist(), shards)
    spark = docs.sparkSession
    k, i = np.nonzero(np.diff(bounds, axis=1))
    plan = pd.DataFrame({"bytes": sizes["bytes"].to_numpy()[k], "low": bounds[k, i], "high": bounds[k, i + 1], "shard": i.astype(np.int32)})
    if len(plan):
        by_size = spark.createDataFrame(plan).groupBy("bytes").agg(F.sort_array(F.collect_list(F.struct("high", "shard"))).alias("shares"))
    else:
        by_size = spark.createDataFrame([], "bytes long, shares array<struct<high: long, shard: int>>")
    own = F.filter("shares", lambda x: F.col("rank") < x["high"])[0]["shard"]
    placed = ranked.join(by_size, "bytes").select("key", "members", own.alias("shard"))
    total = rows.count()
    out = with_ranks(join_groups(rows, placed, ["key"], "members", total).select("id", "size", "crc", "key", "shard"), "shard", ["id", "key"], "shards")
    return out.select(F.col("id").alias(id_col), "size", F.col("crc").alias("text_crc32"), "shard", F.col("rank").alias("slot"))
