"""Best-fit packing of tokenised documents into training sequences."""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import keep, tidy, with_ranks, written
from .textvec import hashes, words
from .textvec import pieces as slices


class WordTokens:
    """Token ids of texts through a memory of words.

    For tokenizers that drop white space and split at it, so that a text's ids are
    its words' ids one after the other. Words of Latin letters are split further by
    the tokenizer's own pattern; any other word goes to the tokenizer as it is.
    The memory starts afresh at ``most`` words."""

    #: The tokenizer's own split pattern: a fixed value.
    PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"

    #: Words a call of the tokenizer: what it returns takes hundreds of bytes a token.
    STEP = 4096

    def __init__(self, path: str, most: int = 1 << 20):
        import regex
        from tokenizers import Tokenizer

        self.tokenizer, self.most = Tokenizer.from_file(path), most
        self.split, self.latin = regex.compile(self.PATTERN).findall, re.compile("[!-~¡-įı-ɏ]+").fullmatch
        self.parts: dict[str, bytes] = {}
        self.clear()

    def clear(self) -> None:
        """Known words are three arrays by hash: about 20 bytes a word."""
        self.hash = np.zeros(0, dtype=np.uint64)
        self.first, self.size = np.zeros(0, dtype=np.int32), np.zeros(0, dtype=np.int32)
        self.ids = np.zeros(0, dtype=np.uint16)

    def _tokens(self, new: list[str]) -> list[bytes]:
        """The ids of each word, as the bytes of 16-bit numbers."""
        split = [self.split(w.lower()) if self.latin(w) and "<|" not in w else None for w in new]
        if len(self.parts) > self.most // 16:
            self.parts = {}
        parts = self.parts
        fresh = list(dict.fromkeys(p for s in split if s for p in s if p not in parts))
        for at in range(0, len(fresh), self.STEP):
            step = fresh[at : at + self.STEP]
            got = self.tokenizer.encode(" ".join(step), add_special_tokens=False)
            ids, owner = np.array(got.ids, dtype=np.uint16).tobytes(), np.array(got.word_ids)
            if owner.max(initial=-1) != len(step) - 1:
                raise ValueError("the tokenizer splits words otherwise than its pattern")
            ends = (2 * np.searchsorted(owner, np.arange(len(step) + 1))).tolist()
            parts.update((p, ids[a:b]) for p, a, b in zip(step, ends[:-1], ends[1:]))
        rest = [w for w, s in zip(new, split) if s is None]
        whole = {}
        for at in range(0, len(rest), self.STEP):
            step = rest[at : at + self.STEP]
            whole.update(zip(step, (np.array(e.ids, dtype=np.uint16).tobytes() for e in self.tokenizer.encode_batch(step, add_special_tokens=False))))
        return [whole[w] if s is None else b"".join([parts[p] for p in s]) for w, s in zip(new, split)]

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids, and len(texts) + 1 offsets into them. Null is empty. Words are known by
        64-bit hashes of their bytes."""
        w = words(texts, lower=False)
        unique, place, code = np.unique(hashes(w), return_index=True, return_inverse=True)
        at = np.searchsorted(self.hash, unique)
        new = np.flatnonzero(self.hash[np.minimum(at, len(self.hash) - 1)] != unique) if len(self.hash) else np.arange(len(unique))
        if len(new):
            if len(self.hash) and len(self.hash) + len(new) > self.most:
                self.clear()
                at, new = np.zeros(len(unique), np.int64), np.arange(len(unique))
            data = w.data.tobytes()
            found = self._tokens([data[a:b].decode() for a, b in zip(w.start[place[new]].tolist(), w.end[place[new]].tolist())])
            size = np.array([len(f) // 2 for f in found], dtype=np.int32)
            first = (len(self.ids) + np.cumsum(size) - size).astype(np.int32)
            self.ids = np.concatenate([self.ids, np.frombuffer(b"".join(found), dtype=np.uint16)])
            self.hash, self.first, self.size = (np.insert(x, at[new], y) for x, y in ((self.hash, unique[new]), (self.first, first), (self.size, size)))
            at = np.searchsorted(self.hash, unique)
        size, first = self.size[at][code].astype(np.int64), self.first[at][code]
        to = np.concatenate([[0], np.cumsum(size)])
        picked = np.repeat(first - to[:-1], size) + np.arange(to[-1])
        return self.ids[picked], to[np.searchsorted(w.text, np.arange(len(texts) + 1))]


def word_tokens(path: str) -> Callable[[], WordTokens]:
    return lambda: keep(path, lambda: WordTokens(path))


def token_pieces(docs: DataFrame, tokens: Callable[[], Callable], length: int = 4096, end_id: int | None = 1, id_col: str = "doc_id", text_col: str = "text", digest: bool = False) -> DataFrame:
    """Each document's token ids, ended by ``end_id``, in pieces of at most
    ``length``: id, piece, start, length, ids (array<int>) or, if ``digest``,
    ids_crc32 of the ids as little-endian 32-bit numbers. Only longer documents
    are cut. ``tokens()`` is called on the executors and gives a function from
    texts to (ids, offsets). Null text is empty; a document without tokens has one
    piece with ``end_id`` alone, or none if that is None."""
    last = "ids_crc32 long" if digest else "ids array<int>"

    def run(batches):
        tokenize = tokens()
        for batch in batches:
            at = 0
            for texts in slices(batch.column(1), 1 << 19):
                own = batch.column(0).slice(at, len(texts))
                at += len(texts)
                ids, ends = tokenize(texts)
                n = len(texts)
                extra = int(end_id is not None)
                bounds = ends + extra * np.arange(n + 1)
                flat = np.empty(bounds[-1], dtype="<u4")
                if extra:
                    flat[bounds[1:] - 1] = end_id
                    keep = np.ones(len(flat), dtype=bool)
                    keep[bounds[1:] - 1] = False
                    flat[keep] = ids
                else:
                    flat[:] = ids
                size = np.diff(bounds)
                count = -(-size // length)
                doc = np.repeat(np.arange(n), count)
                piece = np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count)
                start = piece * length
                many = np.minimum(length, size[doc] - start)
                low = bounds[doc] + start
                if digest:
                    view = memoryview(flat).cast("B")
                    value = pa.array([zlib.crc32(view[4 * a : 4 * b]) for a, b in zip(low.tolist(), (low + many).tolist())], type=pa.int64())
                else:
                    value = pa.ListArray.from_arrays(pa.array(np.append(low, len(flat)).astype(np.int32)), pa.array(flat.astype(np.int32)))
                yield pa.RecordBatch.from_arrays([own.take(pa.array(doc)), pa.array(piece.astype(np.int32)), pa.array(start), pa.array(many), value], names=["id", "piece", "start", "length", last.split()[0]])

    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = source.schema["id"].dataType.simpleString()
    return source.mapInArrow(tidy(run), f"id {kind}, piece int, start long, length long, {last}").withColumnRenamed("id", id_col)


class Tightest:
    """A segment tree over remaining capacities: the least of those not under a
    size that some open bin has, in logarithmic time."""

    def __init__(self, capacity: int):
        self.leaves = 1 << capacity.bit_length()
        self.some = [False] * (2 * self.leaves)

    def set(self, remaining: int, some: bool) -> None:
        at = self.leaves + remaining
        self.some[at] = some
        while at > 1:
            at //= 2
            self.some[at] = self.some[2 * at] or self.some[2 * at + 1]

    def find(self, size: int) -> int | None:
        at = self.leaves + size
        if self.some[at]:
            return size
        while at > 1:
            if at % 2 == 0 and self.some[at + 1]:
                at += 1
                while at < self.leaves:
                    at = 2 * at + (not self.some[2 * at])
                return at - self.leaves
            at //= 2
        return None


def best_fit(sizes: list[int], counts: list[int], capacity: int) -> tuple[pd.DataFrame, int]:
    """Best-fit decreasing of ``counts[k]`` pieces of ``sizes[k]`` (falling), and the
    number of bins. Bins of equal content are kept as runs, and pieces of one size
    are placed in a whole run at once: a bin of remaining capacity r takes
    r // size of them, as its remainder stays the tightest. A run's remainder then
    more than halves, so a run moves at most log2(capacity) times, and each size
    makes three new runs at most: the plan has a bound that no data exceed.

    Rows: pieces of ``size`` ranked from ``low`` to ``high`` - 1 go, ``each`` by
    ``each``, to bins from ``bin`` on, the first of a bin at ``offset``."""
    tree, runs, plan, bins = Tightest(capacity), {}, [], 0

    def put(remaining, first, n):
        if n and remaining:
            if not runs.setdefault(remaining, []):
                tree.set(remaining, True)
            runs[remaining].append((first, n))

    for size, count in zip(sizes, counts):
        rank = 0
        while rank < count:
            remaining = tree.find(size)
            if remaining is None:
                remaining, first, n = capacity, bins, -(-(count - rank) // (capacity // size))
                bins += n
            else:
                first, n = runs[remaining].pop()
                if not runs[remaining]:
                    tree.set(remaining, False)
            each = remaining // size
            full = min(n, (count - rank) // each)
            if full:
                plan.append((size, rank, rank + full * each, first, each, capacity - remaining))
                rank += full * each
                put(remaining - each * size, first, full)
                first, n = first + full, n - full
            if n and rank < count:
                left = count - rank
                plan.append((size, rank, count, first, left, capacity - remaining))
                rank = count
                put(remaining - left * size, first, 1)
                first, n = first + 1, n - 1
            put(remaining, first, n)
    return pd.DataFrame(plan, columns=["size", "low", "high", "bin", "each", "offset"], dtype=np.int64), bins


def pack(pieces: DataFrame, capacity: int = 4096) -> DataFrame:
    """``pieces`` (with a column length of 1 to ``capacity``) with sequence_id and
    offset: best-fit decreasing over all pieces. That depends only on how many
    pieces have each length, so the driver gets ``capacity`` counts at most; it
    broadcasts a plan whose size has a bound (see ``best_fit``). Pieces are ranked
    within their length without bringing them into one task. Offsets are gapless
    from 0 in each sequence. Of two pieces of one length the order is that of their
    columns' hash, so the same pieces are packed alike however they lie. No rows give no rows. Columns of ``pieces`` named size, rank,
    sequence_id, offset or beginning with an underscore are not kept."""
    taken = [c for c in pieces.columns if c not in ("size", "rank", "sequence_id", "offset") and c[0] != "_"]
    # ranks and places are found for lengths and hashes alone; the pieces themselves are joined last, and Python doesn't see them
    rows = written(pieces.select(*taken, F.monotonically_increasing_id().alias("_own")), "pieces")
    ranked = with_ranks(rows.select("_own", "length", F.xxhash64(*taken).alias("_one"), F.hash(*taken).alias("_two")), "length", ["_one", "_two"], "lengths")
    counts = ranked.groupBy("length").count().toPandas().sort_values("length", ascending=False)
    if len(counts) and not 0 < counts["length"].min() <= counts["length"].max() <= capacity:
        raise ValueError(f"a piece is longer than {capacity} or empty")
    plan, _ = best_fit(counts["length"].tolist(), counts["count"].tolist(), capacity)
    plan = plan.sort_values(["size", "low"])
    size, low, bins, each, offset = (plan[c].to_numpy() for c in ("size", "low", "bin", "each", "offset"))
    start = np.searchsorted(size, np.arange(capacity + 2))
    shared = pieces.sparkSession.sparkContext.broadcast((start, low, bins, each, offset))

    @F.arrow_udf("struct<sequence_id: long, offset: long>")
    def place(length: pa.Array, rank: pa.Array) -> pa.Array:
        start, low, bins, each, offset = shared.value
        length, rank = length.to_numpy(zero_copy_only=False), rank.to_numpy(zero_copy_only=False)
        at, top = start[length].copy(), start[length + 1]
        while True:  # the last run that begins at or before the rank, by bisection
            middle = (at + top) // 2
            go = middle > at
            if not go.any():
                break
            up = go & (low[middle] <= rank)
            at, top = np.where(up, middle, at), np.where(go & ~up, middle, top)
        nth = rank - low[at]
        return pa.StructArray.from_arrays([pa.array(bins[at] + nth // each[at]), pa.array(offset[at] + nth % each[at] * length)], names=["sequence_id", "offset"])

    placed = ranked.select("_own", place("length", "rank").alias("_at"))
    return rows.join(placed, "_own").select(*taken, "_at.sequence_id", "_at.offset")
