"""Exact deduplication by composable polynomial fingerprints."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._common import join_groups, written

#: Two moduli under 2**31, and a base for each: fixed values.
MODULI = (2147483647, 2147483629)
BASES = (1000003, 998244353)


def powers(base: int, modulus: int, n: int) -> np.ndarray:
    """base**0 .. base**(n - 1) mod modulus, doubling what is known."""
    out = np.ones(max(n, 1), dtype=np.uint64)
    have = 1
    while have < n:
        more = min(have, n - have)
        out[have : have + more] = out[:more] * np.uint64(pow(base, have, modulus)) % np.uint64(modulus)
        have += more
    return out


def combine(left: tuple[int, int], right: tuple[int, int], base: int, modulus: int) -> tuple[int, int]:
    """(hash, bytes) of two texts one after the other. Associative, so the chunks of
    a text can be hashed anywhere and combined in any grouping."""
    return (left[0] * pow(base, right[1], modulus) + right[0]) % modulus, left[1] + right[1]


def fingerprints(texts: pa.Array, base: int, modulus: int, chunk: int = 1 << 16) -> np.ndarray:
    """The polynomial hash of each text's bytes. All chunks of a batch are hashed
    at once; those of one text are combined by shifting with its later bytes."""
    texts = pa.concat_arrays([texts]) if texts.offset else texts
    ends = np.frombuffer(texts.buffers()[1], dtype=np.int32)[: len(texts) + 1].astype(np.int64)
    data = np.frombuffer(texts.buffers()[2] or b"", dtype=np.uint8)
    lengths = np.diff(ends)
    if texts.null_count:
        lengths = np.where(texts.is_null().to_numpy(zero_copy_only=False), 0, lengths)
    parts = -(-lengths // chunk)
    text = np.repeat(np.arange(len(lengths)), parts)
    number = np.arange(len(text)) - np.repeat(np.cumsum(parts) - parts, parts)
    start = ends[text] + number * chunk
    size = np.minimum(chunk, lengths[text] - number * chunk)
    power = powers(base, modulus, min(chunk, int(lengths.max(initial=0))))
    hashed = np.empty(len(text), dtype=np.uint64)
    at = 0
    while at < len(text):  # a few MB at a time
        to = max(at + 1, int(np.searchsorted(np.cumsum(size[at:]), 1 << 21, side="right")) + at)
        n = size[at:to]
        first = np.cumsum(n) - n
        within = np.arange(int(n.sum())) - np.repeat(first, n)
        values = data[np.repeat(start[at:to], n) + within].astype(np.uint64) * power[np.repeat(n, n) - 1 - within]
        hashed[at:to] = np.add.reduceat(values, first) % np.uint64(modulus)
        at = to
    out = np.zeros(len(lengths), dtype=np.int64)
    single = parts[text] == 1
    out[text[single]] = hashed[single]
    for t in np.flatnonzero(parts > 1):
        own = slice(*np.searchsorted(text, [t, t + 1]))
        total = (0, 0)
        for h, n in zip(hashed[own].tolist(), size[own].tolist()):
            total = combine(total, (h, n), base, modulus)
        out[t] = total[0]
    return out


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", moduli: tuple[int, int] = MODULI, chunk_chars: int = 1 << 18, most_broadcast: int = 1 << 20) -> DataFrame:
    """One row a document: id, keep_id, group_size, kept, text_sha256.

    Texts are equal when they are so without the six ASCII white-space characters.
    Of equal texts the one with the most code points stays, then the one with the
    smallest id. Two 31-bit polynomial hashes and the length are the fingerprint.
    Only texts whose fingerprint occurs again are shuffled (if there are over
    ``most_broadcast`` such fingerprints, all texts are, once), in chunks: sorted by
    fingerprint and chunk, each chunk streams past the first text's chunk. A text
    that differs from it anywhere is set apart and compared again, until all are
    equal; so no collision joins two texts. Hot fingerprints are spread by a salt
    and the salted groups' first texts compared with each other.

    Null texts count as empty, and empty texts equal each other. A null id sorts
    before all others. Rows repeated in full each get a row, and one of them is
    kept. No rows give no rows. Other columns are ignored, whatever their names.
    """

    @F.arrow_udf("struct<a: long, b: long>")
    def fingerprint(texts: pa.Array) -> pa.Array:
        return pa.StructArray.from_arrays([pa.array(fingerprints(texts, b, m)) for b, m in zip(BASES, moduli)], names=["a", "b"])

    plain = F.translate(F.coalesce(F.col(text_col), F.lit("")), " \t\n\x0b\x0c\r", "")
    source = docs.select(F.col(id_col).alias("id"), F.length(F.coalesce(F.col(text_col), F.lit(""))).cast("long").alias("chars"), plain.alias("plain")).withColumn("place", F.xxhash64("plain"))
    hashed = source.withColumn("sha", F.sha2("plain", 256)).withColumn("fp", fingerprint("plain"))
    key = ["fa", "fb", "bytes"]
    rows = written(hashed.select("id", "chars", "sha", "place", F.col("fp.a").alias("fa"), F.col("fp.b").alias("fb"), F.octet_length("plain").cast("long").alias("bytes")), "fingerprints")
    total = rows.count()
    again = rows.groupBy(*key, "place").count()
    again = written(again.withColumn("of", F.sum("count").over(Window.partitionBy(*key))).filter("of > 1").drop("count"), "again")
    # texts that occur once stay where they are, while the fingerprints of the others fit a broadcast
    few = again.count() <= most_broadcast
    suspects = written(source.drop("chars").join(F.broadcast(again) if few else again, "place").drop("place").withColumn("sha", F.sha2("plain", 256)), "suspects")
    apart = _differing(suspects, key, total, chunk_chars)
    rows = rows.withColumn("class", F.lit(0)) if apart is None else rows.join(apart, [*key, "id", "sha"], "left").withColumn("class", F.coalesce("class", F.lit(0)))
    key = [*key, "class"]
    best = F.min_by("id", F.struct(-F.col("chars"), "id"))
    groups = rows.groupBy(*key).agg(best.alias("keep_id"), F.count("*").alias("group_size"), F.max("chars").alias("most"))
    joined = join_groups(rows, groups, key, "group_size", total)
    # rows repeated in full: all have the id that stays, one of them is kept
    stays = F.col("id").eqNullSafe(F.col("keep_id")) & (F.col("chars") == F.col("most"))
    twins = joined.filter(stays).groupBy(*key).count().filter("count > 1").drop("count")
    if twins.isEmpty():
        kept = joined.withColumn("kept", stays)
    else:
        some = joined.join(twins, key, "left_semi").filter(stays)
        first = some.withColumn("kept", F.row_number().over(Window.partitionBy(*key).orderBy("id")) == 1)
        rest = joined.join(twins.withColumn("twin", F.lit(True)), key, "left").filter(F.col("twin").isNull() | ~stays).drop("twin").withColumn("kept", stays)
        kept = rest.unionByName(first)
    return kept.select(F.col("id").alias(id_col), "keep_id", "group_size", "kept", F.col("sha").alias("text_sha256"))


def _differing(suspects: DataFrame, key: list[str], total: int, chunk_chars: int) -> DataFrame | None:
    """(key, id, sha, class) of the texts that differ from the first of their
    fingerprint, class counting up from 1; None if there are none."""
    salts = F.least(F.lit(1024), F.ceil(F.col("of") / max(total // 1000, 500))).cast("int")
    suspects = suspects.withColumn("salts", salts).drop("of")
    found, number = None, 0
    while True:
        salted = suspects.withColumn("salt", F.when(F.col("salts") > 1, F.pmod(F.xxhash64("id", "sha"), F.col("salts"))).otherwise(0).cast("int"))
        worse = written(_compare(salted, [*key, "salt"], chunk_chars), "differing")
        lead = worse.filter("lead").select(*key, "id", "sha").distinct()
        leads = salted.filter("salts > 1").join(lead, [*key, "id", "sha"], "left_semi")
        # the first texts of a fingerprint's salts differ from each other only when hashes collide
        between = written(_compare(leads, key, chunk_chars).filter("not lead"), "differing")
        bad = worse.filter("not lead").select(*key, "id", "sha").distinct()
        if not between.isEmpty():
            # take every text of the salts whose first text differs
            salt = leads.join(between.select(*key, "id", "sha").distinct(), [*key, "id", "sha"], "left_semi").select(*key, "salt").distinct()
            bad = bad.unionByName(salted.join(salt, [*key, "salt"], "left_semi").select(*key, "id", "sha")).distinct()
        if bad.isEmpty():
            return found
        number += 1
        bad = written(bad.withColumn("class", F.lit(number)), "classes")
        found = bad if found is None else written(found.join(bad.select(*key, "id", "sha"), [*key, "id", "sha"], "left_anti").unionByName(bad), "classes")
        suspects = suspects.join(bad.drop("class"), [*key, "id", "sha"], "left_semi")


def _compare(texts: DataFrame, by: list[str], chunk_chars: int) -> DataFrame:
    """Streams the chunks of texts with equal ``by`` past the chunk of the first of
    them; gives that first text (lead) and, for each that differs, a row."""
    cut = F.sequence(F.lit(0), F.greatest(F.lit(0), F.floor((F.length("plain") - 1) / chunk_chars)).cast("int"))
    chunks = texts.select(*by, "id", "sha", F.explode(cut).alias("chunk"), "plain")
    chunks = chunks.withColumn("piece", F.col("plain").substr(F.col("chunk") * chunk_chars + 1, F.lit(chunk_chars))).drop("plain")
    fields = [*by, "id", "sha"]
    dealt = chunks.repartition(*by).sortWithinPartitions(*by, "chunk", "id", "sha")
    schema = dealt.select(*fields).schema.add("lead", "boolean")

    def stream(batches):
        group, piece = None, None
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in [*by, "chunk"]]
            ids, pieces, out, lead = list(zip(*(batch.column(c).to_pylist() for c in fields))), batch.column("piece").to_pylist(), [], []
            for i, at in enumerate(zip(*columns)):
                if at != group:
                    group, piece = at, pieces[i]
                    if at[-1] == 0:
                        out.append(ids[i])
                        lead.append(True)
                elif pieces[i] != piece:
                    out.append(ids[i])
                    lead.append(False)
            if out:
                yield pa.RecordBatch.from_arrays([*(pa.array(list(c), type=batch.schema.field(f).type) for f, c in zip(fields, zip(*out))), pa.array(lead)], names=[*fields, "lead"])

    return dealt.mapInArrow(stream, schema)
