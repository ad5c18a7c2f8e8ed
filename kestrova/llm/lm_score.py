"""Document scores by masked pseudo-likelihood."""

from __future__ import annotations

import math
from collections.abc import Callable
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import written
from .textvec import hashes, pieces, words

#: Least words of the vocabulary, and how the output is split: a class, then a word of the class.
_CLASSES, _EACH = 64, 64
_SIZE = _CLASSES * _EACH
#: The rarest class stands for all other words, by hash.
_KNOWN = _SIZE - _EACH
_WINDOW = 2
_ROWS = 1024
_BYTES = 1 << 17
#: Counts of the commonest words out of the vocabulary that are broadcast; others are joined.
_HEAD = 1 << 18


class Network(NamedTuple):
    """hidden = tanh(sum over places of embed[word] @ mix[place] + base); a softmax
    gives the class and, for each class, another the word. ``terms`` are the
    vocabulary's sorted hashes, ``number`` their words' numbers by falling count."""

    terms: np.ndarray
    number: np.ndarray
    embed: np.ndarray
    mix: np.ndarray
    base: np.ndarray
    to_class: np.ndarray
    class_bias: np.ndarray
    to_word: np.ndarray
    word_bias: np.ndarray
    #: log of the words of the corpus that each number of the rarest class stands for, with one not in it
    rare: float | np.ndarray = 0.0
    #: sorted hashes of commoner words out of the vocabulary, and the logs of their counts
    head: np.ndarray = np.zeros(0, np.uint64)
    often: np.ndarray = np.zeros(0, np.float32)
    #: (term, n) of the others that occur twice or more, if there are any; stays on the driver
    tail: DataFrame | None = None


_WEIGHTS = Network._fields[2:9]


def side_of(distinct: int) -> int:
    """Classes, and words of each: the vocabulary grows as the square root of the corpus's distinct words, 64 x 64 at least."""
    return max(_CLASSES, math.ceil(math.sqrt(4 * math.sqrt(distinct))))


class _Places:
    """Finds hashes among sorted distinct ones: their first bits name the place where the search starts."""

    def __init__(self, terms: np.ndarray):
        self.size = len(terms)
        bits = max(self.size, 1).bit_length() + 1
        self.shift = np.uint64(64 - bits)
        self.start = np.zeros(1 << bits, dtype=np.int64)
        np.cumsum(np.bincount((terms >> self.shift).astype(np.int64), minlength=1 << bits)[:-1], out=self.start[1:])
        self.terms = np.append(terms, np.uint64(2**64 - 1))  # every search ends

    def find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(the place of each hash, whether it is there)."""
        place = self.start[(h >> self.shift).astype(np.int64)]
        found = self.terms[place]
        on = np.flatnonzero(found < h)
        while len(on):
            place[on] += 1
            found[on] = self.terms[place[on]]
            on = on[found[on] < h[on]]
        return place, (found == h) & (place < self.size)


def _hashed(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(hash, text) of each word, by slices that fit a core's cache."""
    h, text, at = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], 0
    for some in pieces(texts, _BYTES):
        w = words(some)
        h.append(hashes(w))
        text.append(w.text + at)
        at += len(some)
    return np.concatenate(h), np.concatenate(text)


def _numbers(texts: pa.Array, net: Network, known: _Places) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(word numbers, text of each, numbers around each, word hashes): the places before the first
    word of a text and after its last hold the number after all words'. ``known`` are the network's terms."""
    each, size = net.to_word.shape[2], len(net.embed) - 1
    h, text = _hashed(texts)
    ids = size - each + (h >> np.uint64(40)).astype(np.int64) % each
    at, there = known.find(h)
    ids[there] = net.number[at[there]]
    around = np.full((len(ids), 2 * _WINDOW), size, dtype=np.int64)
    for k in range(1, _WINDOW + 1):
        if len(ids) > k:
            same = text[k:] == text[:-k]
            around[k:, _WINDOW - k] = np.where(same, ids[:-k], size)
            around[:-k, _WINDOW + k - 1] = np.where(same, ids[k:], size)
    return ids, text, around, h


def _around(net: Network, around: np.ndarray) -> np.ndarray:
    """The vectors of the words around, place after place in one row."""
    return net.embed.take(around, axis=0, mode="clip").reshape(len(around), -1)


def _hidden(net: Network, vectors: np.ndarray) -> np.ndarray:
    """The hidden values, with a last column of ones that stands for the biases."""
    h = np.ones((len(vectors), len(net.base) + 1), vectors.dtype)
    x = vectors @ net.mix.reshape(-1, len(net.base))
    x += net.base
    np.tanh(x, out=h[:, :-1])
    return h


def _order(numbers: np.ndarray, most: int) -> np.ndarray:
    """The stable order of whole numbers of at most ``most``; short types are sorted by digits."""
    return np.argsort(numbers.astype(np.uint16 if most < 1 << 16 else np.int64), kind="stable")


def _parts(n: int) -> list[slice]:
    """Rows at once whose values fit a core's cache."""
    return [slice(low, min(low + _ROWS, n)) for low in range(0, n, _ROWS)]


def _choices(net: Network) -> tuple[np.ndarray, np.ndarray]:
    """The weights of classes and of each class's words, the biases as their last row."""
    return np.concatenate([net.to_class, net.class_bias[None]]), np.concatenate([net.to_word, net.word_bias[:, None]], axis=1)


def _runs(group: np.ndarray) -> list[tuple[int, slice]]:
    """The classes in sorted ``group`` and the rows of each."""
    first = np.flatnonzero(np.append(True, group[1:] != group[:-1])) if len(group) else np.zeros(0, np.int64)
    return [(c, slice(low, high)) for c, low, high in zip(group[first].tolist(), first.tolist(), [*first[1:].tolist(), len(group)])]


def _word_values(h: np.ndarray, weight: np.ndarray, runs: list[tuple[int, slice]]) -> np.ndarray:
    x = np.empty((len(h), weight.shape[2]), h.dtype)
    for c, rows in runs:
        np.matmul(h[rows], weight[c], out=x[rows])
    return x


def _exp(values: Callable[[], np.ndarray], at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(exp of the values, each row's sum of them, each row's own value at its choice). Where a sum shows that
    an exp overflows or vanishes, all values are taken less their row's largest, which a softmax doesn't see."""
    x = values()
    own, ones = x[np.arange(len(x)), at], np.ones(x.shape[1], x.dtype)
    with np.errstate(over="ignore", invalid="ignore"):
        np.exp(x, out=x)
        total = x @ ones
    if not (total.min() > 1e-18 and total.max() < 1e18):
        x = values()
        x -= x.max(1, keepdims=True)
        own = x[np.arange(len(x)), at]
        np.exp(x, out=x)
        total = x @ ones
    return x, total, own


def log_probabilities(net: Network, ids: np.ndarray, around: np.ndarray, at_once: int = 1 << 13) -> np.ndarray:
    """log P(word | the words around it) of each place. A word out of the vocabulary has the part
    of its number's probability that one occurrence has; ``pseudo_likelihood`` adds the log of its count."""
    out = np.empty(len(ids), dtype=np.float64)
    classes, each = net.to_word.shape[0], net.to_word.shape[2]
    rare = np.broadcast_to(net.rare, each)
    to_class, to_word = _choices(net)
    for low in range(0, len(ids), at_once):
        # by class, so that a class's rows lie together
        order = low + _order(ids[low : low + at_once] // each, classes)
        own, h = ids[order], _hidden(net, _around(net, around.take(order, axis=0)))
        group, word = np.divmod(own, each)
        value = np.empty(len(own), h.dtype)
        for part in _parts(len(own)):
            some, runs = h[part], _runs(group[part])
            _, total, at = _exp(lambda: some @ to_class, group[part])
            _, also, more = _exp(lambda: _word_values(some, to_word, runs), word[part])
            value[part] = at - np.log(total) + more - np.log(also)
        out[order] = value - rare[word] * (own >= (classes - 1) * each)
    return out


def _pull(h: np.ndarray, group: np.ndarray, word: np.ndarray, choices: tuple, turned: tuple, slopes: tuple, n: int) -> np.ndarray:
    """Adds the slopes by the weights of classes and words (as ``_choices`` has them) of minus the sum of the rows' log-probabilities, over
    ``n``, to ``slopes``; the result is that by ``h`` without its ones. Rows lie by class; ``turned`` are the weights without biases, transposed."""
    runs, at = _runs(group), np.arange(len(h))
    # exps less their sum at the choice are the slopes times that sum: the narrow factors are divided by it
    x, total, _ = _exp(lambda: h @ choices[0], group)
    x[at, group] -= total
    share = (1 / (total * n))[:, None]
    slopes[0][...] += (h * share).T @ x
    back = x @ turned[0]
    back *= share
    x, total, _ = _exp(lambda: _word_values(h, choices[1], runs), word)
    x[at, word] -= total
    share = (1 / (total * n))[:, None]
    h, more = h * share, np.empty_like(back)
    for c, rows in runs:
        slopes[1][c] += h[rows].T @ x[rows]
        np.matmul(x[rows], turned[1][c], out=more[rows])
    more *= share
    back += more
    return back


def _by_word(places: np.ndarray, values: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(numbers among ``places``, the sum of each one's columns of ``values``, a row each)."""
    met = np.zeros(size, dtype=bool)
    met[places] = True
    at = np.flatnonzero(met)
    short = np.empty(size, dtype=np.int64)
    short[at] = np.arange(len(at))
    places = short[places]
    out = np.empty((len(at), len(values)), values.dtype)
    for k, row in enumerate(values):
        out[:, k] = np.bincount(places, row, len(at))
    return at, out


def _learn(net: Network, ids: np.ndarray, around: np.ndarray, memory: dict[str, np.ndarray], rate: float) -> Network:
    """One step by the gradient of the mean log-probability, scaled by past gradients (Adagrad)."""
    n, classes, each, width = max(len(ids), 1), net.to_word.shape[0], net.to_word.shape[2], len(net.base)
    order = _order(ids // each, classes)
    ids, around = ids[order], around.take(order, axis=0)  # by class, so that a class's rows lie together
    group, word = np.divmod(ids, each)
    choices = _choices(net)
    turned = np.ascontiguousarray(net.to_class.T), np.ascontiguousarray(net.to_word.transpose(0, 2, 1))
    by_class, by_word = slopes = tuple(np.zeros_like(x) for x in choices)
    base, mix = np.zeros_like(net.base), np.zeros((2 * _WINDOW * width, width), net.mix.dtype)
    # a row for each place of a vector, within it a place around a word
    spread, by_place = net.mix.transpose(1, 0, 2).reshape(-1, width), np.empty((2 * _WINDOW * width, len(ids)), net.embed.dtype)
    for part in _parts(len(ids)):
        vectors = _around(net, around[part])
        h = _hidden(net, vectors)
        back = _pull(h, group[part], word[part], choices, turned, slopes, n)
        back *= (1 - h * h)[:, :-1]
        base += np.ones(len(back), back.dtype) @ back
        mix += vectors.T @ back
        np.matmul(spread, back.T, out=by_place[:, part])
    slope = {"to_class": by_class[:-1], "class_bias": by_class[-1], "to_word": by_word[:, :-1], "word_bias": by_word[:, -1], "base": base, "mix": mix.reshape(net.mix.shape)}
    at, own = _by_word(around.T.ravel(), by_place.reshape(width, -1), len(net.embed))
    own[at == len(net.embed) - 1] = 0
    new = {}
    for k, g in slope.items():
        memory[k] = memory.get(k, 1e-8) + g * g
        new[k] = (getattr(net, k) - rate * g / np.sqrt(memory[k])).astype(np.float32)
    # only the words met here have a slope
    if "embed" not in memory:
        memory["embed"] = np.full_like(net.embed, 1e-8)
    squares = memory["embed"][at] + own * own
    memory["embed"][at] = squares
    new["embed"] = net.embed.copy()
    new["embed"][at] -= rate * own / np.sqrt(squares)
    return net._replace(**new)


def train_network(docs: DataFrame, text_col: str = "text", share: float = 0.5, rounds: int = 2, width: int = 16, batch: int = 8192, rate: float = 0.1, seed: int = 5) -> Network:
    """A network trained on the corpus. The vocabulary is the commonest words of
    all documents, as many as ``side_of`` says. In each round every task trains a copy on its part of a fresh ``share``
    of the documents (by hash; by default two rounds learn from every document, once), whole texts each, and the copies'
    mean by words seen is the next round's start. Weights are added up in blocks on
    the executors: the driver gets one sum of each. Null texts teach nothing."""
    source = docs.select(F.col(text_col).alias("text")).filter("text is not null")

    def count(batches):
        for part in batches:
            for texts in pieces(part.column(0), 1 << 23):
                h, n = np.unique(_hashed(texts)[0], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(n.astype(np.int64))], names=["term", "n"])

    often = written(source.mapInArrow(count, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")), "words")
    distinct = often.count()
    side = side_of(distinct)
    size = side * side
    most = size - side
    # the least count of the words that the driver gets, so that they are bounded
    least, left = 1, most + _HEAD
    for n, many in sorted(((r.n, r.many) for r in often.groupBy("n").agg(F.count(F.lit(1)).alias("many")).collect()), reverse=True):
        left -= many
        if left < 0:
            least = n + 1
            break
    top = often.filter(F.col("n") >= least).toArrow()
    hashed, count_of = top.column("term").to_numpy().astype(np.int64), top.column("n").to_numpy().astype(np.int64)
    order = np.lexsort((hashed, -count_of))
    hashed, count_of = hashed[order].view(np.uint64), count_of[order]
    terms, counts = hashed[:most], np.zeros(size)
    counts[: len(terms)] = count_of[:most]
    number = lambda h: (h >> np.uint64(40)).astype(np.int64) % side
    for r in often.groupBy((F.shiftrightunsigned("term", 40) % side).alias("b")).agg(F.sum("n").alias("n")).collect():
        counts[most + r.b] = r.n
    counts[most:] -= np.bincount(number(terms), counts[: len(terms)], side)
    head, head_n = hashed[most:], count_of[most:]
    by_hash = np.argsort(head)
    tail = often.filter((F.col("n") < least) & (F.col("n") > 1)) if least > 2 else None
    order = np.argsort(terms)
    rng = np.random.default_rng(seed)
    near = lambda *shape: (rng.normal(size=shape) / np.sqrt(width)).astype(np.float32)
    by_class = counts.reshape(side, side) + 0.5
    embed = near(size + 1, width)
    embed[size] = 0
    net = Network(
        terms[order], order, embed, near(2 * _WINDOW, width, width), np.zeros(width, np.float32), near(width, side) * 0, np.log(by_class.sum(1) / by_class.sum()).astype(np.float32), near(side, width, side) * 0, np.log(by_class / by_class.sum(1, keepdims=True)).astype(np.float32),
        np.log(counts[most:] + 1), head[by_hash], np.log(head_n[by_hash]).astype(np.float32), tail,
    )
    flat = lambda x: np.concatenate([getattr(x, k).ravel() for k in _WEIGHTS])
    step = 1 << 14
    for turn in range(rounds):
        shared = docs.sparkSession.sparkContext.broadcast(net._replace(tail=None))

        def train(batches):
            net, memory, seen = shared.value, {}, 0
            known = _Places(net.terms)
            for part in batches:
                for texts in pieces(part.column(0), 1 << 20):
                    ids, _, around, _ = _numbers(texts, net, known)
                    mixed = np.random.default_rng(seed).permutation(len(ids))
                    for low in range(0, len(ids), batch):
                        own = mixed[low : low + batch]
                        net = _learn(net, ids[own], around.take(own, axis=0), memory, rate * min(1.0, len(own) / batch))
                    seen += len(ids)
            if seen:
                weights = flat(net).astype(np.float64) * seen
                blocks = [weights[a : a + step].tobytes() for a in range(0, len(weights), step)]
                yield pa.RecordBatch.from_arrays([pa.array(range(len(blocks)), type=pa.int32()), pa.array([seen] * len(blocks), type=pa.int64()), pa.array(blocks, type=pa.binary())], names=["block", "seen", "weights"])

        def add(batches):
            at, seen, total = None, 0, None
            for part in batches:
                for b, n, w in zip(*(part.column(c).to_pylist() for c in ("block", "seen", "weights"))):
                    if b != at:
                        if at is not None:
                            yield one(at, seen, total)
                        at, seen, total = b, 0, 0.0
                    seen, total = seen + n, total + np.frombuffer(w)
            if at is not None:
                yield one(at, seen, total)

        def one(block, seen, total):
            return pa.RecordBatch.from_arrays([pa.array([block], type=pa.int32()), pa.array([seen], type=pa.int64()), pa.array([total.tobytes()], type=pa.binary())], names=["block", "seen", "weights"])

        kind = "block int, seen long, weights binary"
        draw = F.pmod(F.xxhash64("text", F.lit(seed)), F.lit(1 << 20)) / float(1 << 20)
        part = source.filter((draw >= turn * share) & (draw < (turn + 1) * share))
        sums = part.mapInArrow(train, kind).repartition("block").sortWithinPartitions("block").mapInArrow(add, kind).collect()
        if sums:
            mean = np.concatenate([np.frombuffer(r.weights) / r.seen for r in sorted(sums, key=lambda r: r.block)]).astype(np.float32)
            new, at = {}, 0
            for k in _WEIGHTS:
                old = getattr(net, k)
                new[k], at = mean[at : at + old.size].reshape(old.shape), at + old.size
            net = net._replace(**new)
    return net


def pseudo_likelihood(docs: DataFrame, net: Network, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: id, n_tokens, log_likelihood, per_token.

    Every word of the whole text is predicted from the two words on each side of it; log_likelihood is
    the sum of the logarithms of these conditional probabilities, per_token their mean.
    Words out of the vocabulary fall into numbers by hash, and share a number's probability
    by their counts in the corpus; a word that isn't in it counts as one that occurs once. Null and empty texts, and
    white space alone, have 0 tokens, log_likelihood 0 and null per_token. Ids aren't
    looked at; equal texts have equal scores. No rows give no rows. Other columns
    are ignored, whatever their names."""
    shared = docs.sparkSession.sparkContext.broadcast(net._replace(tail=None))
    more = net.tail is not None

    def run(batches):
        net = shared.value
        least, known, head = len(net.embed) - 1 - net.to_word.shape[2], _Places(net.terms), _Places(net.head)
        row = TaskContext.get().partitionId() << 33
        for batch in batches:
            at = 0
            for texts in pieces(batch.column(1), 1 << 21):
                own = batch.column(0).slice(at, len(texts))
                at += len(texts)
                ids, text, around, h = _numbers(texts, net, known)
                value = log_probabilities(net, ids, around)
                other = np.flatnonzero(ids >= least)
                place, found = head.find(h[other])
                value[other[found]] += net.often[place[found]]
                other = other[~found]
                total = np.bincount(text, value, len(texts)).astype(np.float64)
                n = np.bincount(text, minlength=len(texts)).astype(np.int64)
                ends = np.searchsorted(text[other], np.arange(len(texts) + 1)).astype(np.int32)
                rare = pa.ListArray.from_arrays(pa.array(ends), pa.array(h[other].view(np.int64))) if more else pa.nulls(len(texts), pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(row, row + len(texts))), own, pa.array(n), pa.array(total), rare], names=["row", "id", "n_tokens", "log_likelihood", "rare"])
                row += len(texts)

    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = source.schema["id"].dataType.simpleString()
    rows = source.mapInArrow(run, f"row long, id {kind}, n_tokens long, log_likelihood double, rare array<long>")
    if more:  # a row's number is written with it, so a task that runs again can't change it
        rows = written(rows, "scored")
        part = rows.select("row", F.explode("rare").alias("term")).join(net.tail, "term").groupBy("row").agg(F.sum(F.log("n")).alias("more"))
        rows = rows.drop("rare").join(part, "row", "left").withColumn("log_likelihood", F.col("log_likelihood") + F.coalesce("more", F.lit(0.0)))
    return rows.select(F.col("id").alias(id_col), "n_tokens", "log_likelihood", F.when(F.col("n_tokens") > 0, F.col("log_likelihood") / F.col("n_tokens")).alias("per_token"))
