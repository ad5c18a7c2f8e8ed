"""Exact Jaccard self-join of documents' word shingles by universe partition."""

from __future__ import annotations

import math
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import components, gathered, join_groups, lean, release, scratch, tidy, written
from .textvec import hashes, mix, pieces, shingles, words

#: Bits of the least sketch, which is also what is looked at first.
_BITS = 2048


class Sets(NamedTuple):
    """The distinct shingles of some texts, sorted within each text."""

    tokens: np.ndarray
    text: np.ndarray
    size: np.ndarray
    first: np.ndarray


def shingle_sets(texts: pa.Array, n: int) -> Sets:
    w = words(texts)
    tokens, text = shingles(hashes(w), w.text, w.texts, n)
    order = np.argsort(tokens)
    # by text and token: texts are numbers of few bits, which sort in linear time
    order = order[np.argsort(text[order].astype(np.min_scalar_type(w.texts)), kind="stable")]
    tokens, text = tokens[order], text[order]
    new = np.ones(len(tokens), dtype=bool)
    new[1:] = (tokens[1:] != tokens[:-1]) | (text[1:] != text[:-1])
    tokens, text = tokens[new], text[new]
    size = np.bincount(text, minlength=w.texts)
    return Sets(tokens, text, size, np.cumsum(size) - size)


def _sums(sets: Sets, salt: int) -> np.ndarray:
    """For each set a 64-bit number but 0 that depends on its tokens, not on their order."""
    out = np.zeros(len(sets.size), dtype=np.uint64)
    some = sets.size > 0
    if some.any():
        out[some] = np.add.reduceat(mix(sets.tokens ^ np.uint64(salt)), sets.first[some])
    return np.maximum(mix(out + sets.size.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(salt)), np.uint64(1))


class Bands(NamedTuple):
    """Size bands, and for each what its pairs need: ``segments`` parts of the
    universe and ``reserve`` of them with one-deletion neighbourhoods."""

    top: np.ndarray
    segments: np.ndarray
    reserve: np.ndarray


def bands(counts: dict[int, int], num: int, den: int) -> Bands:
    """Sets of similarity num / den or more have sizes in one band or in two that
    are next to each other. Two sets of band g, or one of g and one of g + 1, then
    differ in at most h = top * (den - num) / num tokens, so of h + 1 segments
    one is equal. An empty segment equals many, which costs pairs; a set can
    skip it if it takes two units of difference on a reserve segment instead: one that
    has no or one deletion between the two sets. The reserve is as large as costs least, counting index
    rows against the expected pairs of the empty segments that can't be skipped."""
    most = max(counts, default=1)
    top = [den // max(den - num, 1)]
    while top[-1] < most:
        top.append(top[-1] * den // num)
    top = np.array(top)
    segments = top * (den - num) // num + 1
    held = np.zeros(len(top))
    for size, count in counts.items():
        held[np.searchsorted(top, size)] += count
    reserve = []
    for g, m in enumerate(segments.tolist()):
        sets = held[g] + (held[g + 1] if g + 1 < len(top) else 0)
        each = 0.9 * top[g] / m
        empty = math.exp(-each)
        best, cost = 0, None
        chances = [math.exp(-m * empty)]
        for k in range(1, 200):
            chances.append(chances[-1] * m * empty / k)
        for r in range(m):
            over = sum((k - r) * p for k, p in enumerate(chances) if k > r)
            now = sets * r * each + over * sets * sets * empty * 2
            if cost is None or now < cost:
                best, cost = r, now
            if over * sets * empty < 1e-3:
                break
        reserve.append(best)
    return Bands(top, segments, np.array(reserve))


def signatures(sets: Sets, b: Bands, salt: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(key, set, probes): what each set is found by. Two sets as similar as asked
    share a key at least one of them probes. In its own band and, as the larger
    set, in the band below, a set's tokens are hashed into segments; a
    segment's key is a sum over its tokens. Reserve segments, the last ones,
    also have the keys of the segment less each token."""
    keys, owners, probes = [], [], []
    band = np.searchsorted(b.top, sets.size)
    for below in (0, 1):
        group = band - below
        use = (sets.size > 0) & (group >= 0)
        if below:  # within reach of the band below
            use &= b.segments[np.maximum(group, 0)] > 1
        use &= b.segments[np.maximum(group, 0)] > 1
        if not use.any():
            continue
        m, r = np.where(use, b.segments[np.maximum(group, 0)], 0), np.where(use, b.reserve[np.maximum(group, 0)], 0)
        head = np.cumsum(m) - m
        live = use[sets.text]
        text, tokens = sets.text[live], sets.tokens[live]
        spread = mix(tokens + (group[text].astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(salt))
        segment = (spread >> np.uint64(11)) % m[text].astype(np.uint64)
        value = mix(spread)
        at = head[text] + segment.astype(np.int64)
        total = np.zeros(int(m.sum()), dtype=np.uint64)
        np.add.at(total, at, value)
        held = np.bincount(at, minlength=len(total))
        owner = np.repeat(np.arange(len(m)), m)
        number = np.arange(len(owner)) - head[owner]
        name = (group[owner].astype(np.uint64) << np.uint64(40)) + number.astype(np.uint64)
        # the first empty segments, as many as the reserve can make up for, are skipped
        empty = held == 0
        reserve = number >= (m - r)[owner]
        before = np.cumsum(empty) - empty
        nth = before - before[head[owner]]
        skip = empty & (nth < r[owner]) & ~reserve
        skipped = np.bincount(owner, skip, len(m)).astype(np.int64)
        # what each skipped segment owes is taken on the reserve, from the last on
        two = reserve & (m[owner] - 1 - number < skipped[owner])
        keys.append(mix(total + mix(name + np.uint64(salt))))
        owners.append(owner)
        probes.append(~skip)
        less = np.flatnonzero(reserve[at])
        if len(less):
            keys.append(mix(total[at[less]] - value[less] + mix(name[at[less]] + np.uint64(salt))))
            owners.append(text[less])
            probes.append(two[at[less]])
    if not keys:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, bool)
    return np.concatenate(keys), np.concatenate(owners), np.concatenate(probes)


def _stars(keys, probes):
    """Rows sorted by key, those that probe first: for each row its key's first row
    and whether the key has a row that probes."""
    new = np.ones(len(keys), dtype=bool)
    new[1:] = keys[1:] != keys[:-1]
    group = np.cumsum(new) - 1
    first = np.flatnonzero(new)
    return first[group], probes[first][group]


def sketches(sets: Sets) -> list[bytes]:
    """For each set a bit for each bin of its tokens' hashes: whether it holds an odd number of them. There are
    2048 bins or four times as many again and again, until a bin has one token at most on average."""
    bits = np.full(len(sets.size), _BITS, dtype=np.int64)
    while (small := bits < sets.size).any():
        bits[small] *= 4
    first = np.cumsum(bits) - bits
    place = first[sets.text] + (mix(sets.tokens) & (bits - 1).astype(np.uint64)[sets.text]).astype(np.int64)
    flat = np.zeros(int(bits.sum()) // 8, dtype=np.uint8)
    np.bitwise_xor.at(flat, place >> 3, np.left_shift(1, place & 7).astype(np.uint8))
    flat = flat.tobytes()
    return [flat[a : a + n] for a, n in zip((first // 8).tolist(), (bits // 8).tolist())]


def _matrix(made: list[bytes], bits: int) -> np.ndarray:
    """Sketches of one length as rows of ``bits`` bits, 64 a number: bins whose last hash bits are equal become one."""
    x = np.frombuffer(b"".join(made), dtype=np.uint64).reshape(len(made), -1, bits // 64)
    return x[:, 0] if x.shape[1] == 1 else np.bitwise_xor.reduce(x, axis=1)


def _odd(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """For each two rows of bits in how many they differ."""
    return np.bitwise_count(x ^ y).sum(1, dtype=np.int64)


def _differ(a: list[bytes], b: list[bytes], at_once: int = 1 << 21) -> np.ndarray:
    """In how many bins each two sketches differ, at the coarser one's bins: not more than what the sets differ by, as
    such a bin has a token that only one of them holds."""
    out = np.zeros(len(a), dtype=np.int64)
    sizes = np.array([[len(x) for x in a], [len(x) for x in b]], dtype=np.int64).reshape(2, -1)
    for n, m in np.unique(sizes, axis=1).T.tolist():
        own = np.flatnonzero((sizes[0] == n) & (sizes[1] == m))
        step = max(1, at_once // max(n, m))
        for low in range(0, len(own), step):
            some = own[low : low + step].tolist()
            out[some] = _odd(*(_matrix([of[i] for i in some], min(n, m) * 8) for of in (a, b)))
    return out


def linked(docs: DataFrame, words_each: int = 3, num: int = 90, den: int = 100, id_col: str = "doc_id", text_col: str = "text", seed: int = 1) -> DataFrame:
    """One row a document: id, n_shingles, component_id.

    A document's set is its distinct shingles of ``words_each`` words (with fewer
    words, its whole sequence; without any, nothing: it is linked with no other).
    Two are linked when den * intersection >= num * union; component_id is the
    smallest id that links reach. Shingles are compared by 64-bit hashes.

    Equal sets are one set. By ``bands`` and ``signatures`` similar sets share a
    key. A key's sets are compared with its first set; then, where
    these verified links leave a key's sets in several components, all its pairs between
    two components are. So no link between components is lost, and a group of
    near copies costs about one comparison a document. Bins with an odd number of tokens (``sketches``) differ in at
    most as many places as the sets in tokens, which rules out most other pairs, down to a similarity little
    under the one asked for, before the sets themselves are fetched. All comparisons are exact.

    Null text has no words. Null ids are kept and sort last. Repeated rows are equal sets.
    No rows give no rows. Other columns are ignored, whatever their names.
    """
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = source.schema["id"].dataType.simpleString()

    def describe(batches):
        lean()
        for batch in batches:
            at = 0
            for texts in pieces(batch.column(1), 1 << 19):
                own = batch.column(0).slice(at, len(texts))
                at += len(texts)
                s = shingle_sets(texts, words_each)
                yield pa.RecordBatch.from_arrays(
                    [own, pa.array(s.size.astype(np.int64)), pa.array(_sums(s, seed).view(np.int64)), pa.array(_sums(s, seed + 1000).view(np.int64)), pa.array(sketches(s), type=pa.binary())],
                    names=["id", "n", "sid", "other", "sketch"],
                )

    rows = written(source.mapInArrow(tidy(describe), f"id {kind}, n long, sid long, other long, sketch binary"), "sets")
    sets = rows.filter("n > 0").groupBy("sid").agg(F.min("id").alias("rep"), F.count("*").alias("copies"), F.first("n").alias("n"), F.first("sketch").alias("sketch"), F.min("other").alias("low"), F.max("other").alias("high"))
    sets = written(gathered(sets, 16), "distinct")
    if not sets.filter("low <> high").isEmpty():  # two sets have one hash: hash otherwise
        return linked(docs, words_each, num, den, id_col, text_col, seed + 1)
    b = bands({r.n: r["count"] for r in sets.groupBy("n").count().collect()}, num, den)

    def sign(batches):
        for batch in batches:
            for texts in pieces(batch.column(0), 1 << 19):
                s = shingle_sets(texts, words_each)
                key, owner, probes = signatures(s, b, seed)
                sid = _sums(s, seed)[owner].view(np.int64)
                key = key & ~np.uint64(1) | ~probes  # the last bit of those that don't probe is 1
                order = np.lexsort((sid, key))
                by_key, of = key[order] >> np.uint64(1), sid[order]
                same = np.zeros(len(key), dtype=bool)
                same[1:] = (by_key[1:] == by_key[:-1]) & (of[1:] == of[:-1])
                order = order[~same]
                first, found = _stars(by_key[~same], probes[order])
                lead = np.full(len(key), -1)
                lead[order] = np.where(found, order[first], order)
                # a set's keys go together, so that all but the keys compresses away
                own = np.argsort(owner.astype(np.min_scalar_type(len(s.size))), kind="stable")
                own = own[lead[own] >= 0]
                lead = np.where(lead[own] == own, 0, sid[lead[own]])
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (key[own].view(np.int64), lead, sid[own])], names=["key", "lead", "sid"])

    # lead is 0 for a row that is still to meet others of its key; a member that has met
    # its first set goes anywhere, so hot keys don't gather in one task
    dealt = source.select("text").mapInArrow(tidy(sign), "key long, lead long, sid long")
    dealt = dealt.repartition(F.when(F.col("lead") == 0, F.shiftrightunsigned("key", 1)).otherwise(F.xxhash64("key", "sid"))).sortWithinPartitions("key", "sid")

    def meet(batches):
        last, lead = None, 0  # the key before, and its first set
        for batch in batches:
            key, lead_of, sid = (batch.column(c).to_numpy() for c in ("key", "lead", "sid"))
            probes, key = key & 1 == 0, key >> 1
            lone = lead_of == 0
            out = [[key[~lone], lead_of[~lone], sid[~lone], probes[~lone]]]
            key, sid, probes = key[lone], sid[lone], probes[lone]
            if len(key):
                first, found = _stars(key, probes)
                a = sid[first]
                if last is not None:
                    on = key == last
                    a, found = np.where(on, lead, a), found | on
                take = found & (a != sid)
                out.append([key[take], a[take], sid[take], probes[take]])
                last, lead = (key[-1], a[-1]) if found[-1] else (None, 0)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*out)], names=["key", "a", "b", "probes"])

    # a probes; so does b, or not
    met = written(gathered(dealt, 16).mapInArrow(meet, "key long, a long, b long, probes boolean"), "met")
    pairs = met.groupBy("a", "b").agg(F.count("*").alias("shared"))
    pairs = written(gathered(_possible(pairs, sets, num, den), 1, again=True), "pairs")

    def verified(asked: DataFrame) -> DataFrame:
        with scratch() as made:
            found = _verified(asked, sets, source, words_each, num, den, seed)
        found = written(gathered(found, 1, again=True), "links")
        release(made)
        return found

    best = pairs.groupBy("b").agg(F.max_by("a", F.struct("shared", "a")).alias("a"))
    links = verified(best)
    parts = components(links)
    rest = written(gathered(_between(pairs.join(best, ["a", "b"], "left_anti"), parts), 1), "rest")
    if not rest.isEmpty():
        links = links.unionByName(verified(rest))
        parts = components(links)
    # the likeliest partner of each set that streams, then all of those that have several
    sides = written(gathered(_sides(met)), "sides")
    again = None
    while True:
        found = written(gathered(_across(sides, parts, sets, num, den, again), 1, again=True), "across")
        asked = found.select("a", "b").distinct().join(pairs.select("a", "b"), ["a", "b"], "left_anti")
        more = verified(asked.join(links.select("a", "b"), ["a", "b"], "left_anti"))
        if not more.isEmpty():
            links = links.unionByName(more)
            parts = components(links)
        if again is not None:
            break
        again = written(gathered(found.filter("more").select("key", F.col("asker").alias("sid")).distinct(), 1), "again")
        if again.isEmpty():
            break
    named = sets.select("sid", "rep", "copies").join(parts.withColumnRenamed("id", "sid"), "sid", "left").withColumn("component", F.coalesce("component", "sid"))
    least = parts.join(sets.select(F.col("sid").alias("id"), "rep"), "id").groupBy("component").agg(F.min("rep").alias("least"))
    named = named.join(least, "component", "left").select("sid", "copies", F.coalesce("least", "rep").alias("component_id"))
    full = rows.filter("n > 0").select("id", "n", "sid")
    out = join_groups(full, written(gathered(named), "named"), ["sid"], "copies", rows.count())
    out = out.select("id", "n", "component_id").unionByName(rows.filter("n = 0").select("id", "n", F.col("id").alias("component_id")))
    return gathered(out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), "component_id"))


def _possible(pairs: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """Those pairs (a, b) whose sketches don't differ by more than the sets may."""

    @F.arrow_udf("boolean")
    def may(a: pa.Array, b: pa.Array, both: pa.Array) -> pa.Array:
        return pa.array(_differ(a.to_pylist(), b.to_pylist()) <= both.to_numpy() * (den - num) // (den + num))

    side = lambda c: sets.select(F.col("sid").alias(c), F.col("sketch").alias(f"{c}_sketch"), F.col("n").alias(f"{c}_size"))
    sized = pairs.join(side("a"), "a").join(side("b"), "b").filter(F.least("a_size", "b_size") * den >= F.greatest("a_size", "b_size") * num)
    return sized.filter(may("a_sketch", "b_sketch", F.col("a_size") + F.col("b_size"))).select(*pairs.columns)


def _between(pairs: DataFrame, parts: DataFrame) -> DataFrame:
    """Those pairs whose ends aren't in one component yet."""
    of = lambda c: parts.select(F.col("id").alias(c), F.col("component").alias(f"{c}_part"))
    both = pairs.join(of("a"), "a", "left").join(of("b"), "b", "left")
    return both.filter(F.coalesce("a_part", "a") != F.coalesce("b_part", "b")).select("a", "b")


def _sides(met: DataFrame) -> DataFrame:
    """(key, sid, probes): the sets of each key that may hold pairs besides those with its first set. A key of
    two sets has none, nor has one in which only the first set probes."""
    sides = met.select("key", F.col("a").alias("sid"), F.lit(True).alias("probes")).unionByName(met.select("key", F.col("b").alias("sid"), "probes"))
    some = met.groupBy("key").agg(F.count("*").alias("n"), F.count_if("probes").alias("more")).filter("n > 1 and more > 0").select("key")
    return sides.groupBy("key", "sid").agg(F.max("probes").alias("probes")).join(some, "key")


def _across(sides: DataFrame, parts: DataFrame, sets: DataFrame, num: int, den: int, again: DataFrame | None) -> DataFrame:
    """Pairs (a, b) of sets that share a key, one of which at least probes, are in different components and may be
    similar by size and bins; first of each set that streams (asker) only the partner whose bins differ least, and whether there
    are more, then all pairs of the askers ``again`` (key, sid). Each key's sets are
    dealt into blocks of about 4000, past which stream those that probe and are outside the key's largest component, or in
    it when others don't probe; a pair that is ruled out is never a row."""
    likeliest = again is None
    if not likeliest:
        sides = sides.join(again.select("key").distinct(), "key").join(again.withColumn("again", F.lit(True)), ["key", "sid"], "left")
    sides = sides.join(parts.withColumnRenamed("id", "sid"), "sid", "left").withColumn("component", F.coalesce("component", "sid"))
    by_part = sides.groupBy("key", "component").agg(F.count("*").alias("count"), F.min("probes").alias("probes"))
    by_part = by_part.groupBy("key").agg(F.max_by("component", F.struct("count", "component")).alias("main"), F.ceil(F.sum("count") / 4000).cast("int").alias("blocks"), F.count("*").alias("parts"), F.min("probes").alias("every"))
    sides = sides.join(by_part.filter("parts > 1").drop("parts"), "key").join(sets.select("sid", "n", "sketch"), "sid")
    outside = (F.col("component") != F.col("main")) | ~F.col("every")
    sides = sides.withColumn("streams", F.col("probes") & outside if likeliest else F.col("again").isNotNull())
    sides = sides.select("key", "sid", "component", "blocks", "n", "sketch", "streams")
    every = sides.withColumn("block", F.pmod(F.xxhash64("sid"), "blocks").cast("int")).withColumn("past", F.lit(False))
    past = sides.filter("streams").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumn("past", F.lit(True))
    dealt = every.unionByName(past.select(*every.columns)).drop("blocks").repartition("key", "block").sortWithinPartitions("key", "block", "past")

    def prune(batches):
        lean()
        held = None  # of the last key and block, whose rows may go on in the next batch
        for batch in batches:
            rows = [batch.column(c).to_numpy(zero_copy_only=False) for c in ("key", "block", "past", "sid", "component", "n", "streams", "sketch")]
            if held is not None:
                rows = [np.concatenate(x) for x in zip(held, rows)]
            key, number, past, sid, part, n, streams, sketch = rows
            if not len(key):
                continue
            coarse = np.empty((len(key), _BITS // 64), dtype=np.uint64)
            sizes = np.array([len(x) for x in sketch])
            for size in np.unique(sizes).tolist():
                own = np.flatnonzero(sizes == size)
                coarse[own] = _matrix(sketch[own].tolist(), _BITS)
            new = np.ones(len(key), dtype=bool)
            new[1:] = (key[1:] != key[:-1]) | (number[1:] != number[:-1])
            group, first = np.cumsum(new) - 1, np.flatnonzero(new)
            many = np.bincount(group, ~past, len(first)).astype(np.int64)
            asked = np.flatnonzero(past)
            upto = np.cumsum(many[group[asked]])
            out, at = [(np.zeros(0, np.int64),) * 4 + (np.zeros(0, bool),)], 0
            while at < len(asked):  # some 50,000 pairs at a time, all of a row's together
                to = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + 50_000, side="right")))
                i = np.repeat(asked[at:to], many[group[asked[at:to]]])
                start = np.concatenate([[0], upto[at:to] - (upto[at - 1] if at else 0)])
                j = np.arange(len(i)) + np.repeat(first[group[asked[at:to]]] - start[:-1], np.diff(start))
                at = to
                may = (part[i] != part[j]) & (np.minimum(n[i], n[j]) * den >= np.maximum(n[i], n[j]) * num)
                may &= ~streams[j] | likeliest | (sid[j] > sid[i])
                i, j = i[may], j[may]
                most = (n[i] + n[j]) * (den - num) // (den + num)
                differ = _odd(coarse[i], coarse[j])
                may = differ <= most
                i, j, most, differ = i[may], j[may], most[may], differ[may]
                fine = np.flatnonzero(np.minimum(sizes[i], sizes[j]) * 8 > _BITS)
                differ[fine] = _differ(sketch[i[fine]].tolist(), sketch[j[fine]].tolist())
                may = differ <= most
                i, j, differ = i[may], j[may], differ[may]
                if likeliest:
                    order = np.lexsort((differ, i))
                    i, j = i[order], j[order]
                    best = np.ones(len(i), dtype=bool)
                    best[1:] = i[1:] != i[:-1]
                    more = np.append(best[1:], True)[best] == 0
                    i, j = i[best], j[best]
                else:
                    more = np.zeros(len(i), dtype=bool)
                out.append((np.minimum(sid[i], sid[j]), np.maximum(sid[i], sid[j]), key[i], sid[i], more))
            last = np.flatnonzero((group == group[-1]) & ~past)
            held = [x[last] for x in rows]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*out)], names=["a", "b", "key", "asker", "more"])

    return dealt.mapInArrow(tidy(prune), "a long, b long, key long, asker long, more boolean")


def _verified(pairs: DataFrame, sets: DataFrame, source: DataFrame, words_each: int, num: int, den: int, seed: int, most_broadcast: int = 1 << 20) -> DataFrame:
    """Those pairs (a, b) with den * intersection >= num * union. The sets are made
    again from the texts of one document each; the sets of b stream past that of a,
    with a salt where an a has many b."""
    pairs = written(gathered(pairs.select("a", "b"), 1), "check")
    ends = pairs.select(F.col("a").alias("sid")).union(pairs.select("b")).distinct()
    need = written(sets.join(ends, "sid").select("sid", F.col("rep").alias("of")), "need")
    need = F.broadcast(need) if need.count() <= most_broadcast else need

    def make(batches):
        for batch in batches:
            at = 0
            for texts in pieces(batch.column(0), 1 << 19):
                asked = batch.column(1).slice(at, len(texts)).to_numpy()
                at += len(texts)
                s = shingle_sets(texts, words_each)
                own = _sums(s, seed).view(np.int64)
                ends = np.append(s.first, len(s.tokens)) * 8
                data = pa.Array.from_buffers(pa.binary(), len(own), [None, pa.py_buffer(ends.astype(np.int32).tobytes()), pa.py_buffer(s.tokens.tobytes())])
                batch_out = pa.RecordBatch.from_arrays([pa.array(own), data], names=["sid", "tokens"])
                yield batch_out.filter(pa.array(own == asked))

    made = written(source.join(need, F.col("id").eqNullSafe(F.col("of"))).select("text", "sid").mapInArrow(tidy(make), "sid long, tokens binary"), "made")
    many = pairs.groupBy("a").agg(F.ceil(F.count("*") / 500).cast("int").alias("salts"))
    salted = pairs.join(many, "a").withColumn("salt", F.pmod(F.xxhash64("b"), "salts").cast("int"))
    first = salted.select("a", "salt").distinct().join(made.withColumnRenamed("sid", "a"), "a").withColumn("b", F.lit(None).cast("long"))
    then = salted.select("a", "salt", "b").join(made.withColumnRenamed("sid", "b"), "b")
    dealt = first.unionByName(then).repartition("a", "salt").sortWithinPartitions("a", "salt", F.col("b").isNotNull())

    def compare(batches):
        set_of = np.zeros(0, dtype=np.uint64)
        for batch in batches:
            a, b, out = batch.column("a").to_pylist(), batch.column("b").to_pylist(), []
            for i, tokens in enumerate(batch.column("tokens")):
                own = np.frombuffer(tokens.as_buffer(), dtype=np.uint64)
                if b[i] is None:
                    set_of = own.copy()
                    continue
                at = np.minimum(np.searchsorted(set_of, own), len(set_of) - 1)
                common = int((set_of[at] == own).sum())
                if den * common >= num * (len(set_of) + len(own) - common):
                    out.append(i)
            yield pa.RecordBatch.from_arrays([pa.array([a[i] for i in out], type=pa.int64()), pa.array([b[i] for i in out], type=pa.int64())], names=["a", "b"])

    return dealt.select("a", "salt", "b", "tokens").mapInArrow(tidy(compare), "a long, b long")
