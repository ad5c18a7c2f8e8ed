"""Scans for secrets; a random forest removes false positives."""

from __future__ import annotations

import random
import string
from bisect import bisect
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import written
from .textvec import _ALNUM, Words, hashes, mix, pieces, raw, words

#: Words before a secret, words before other strings of the kind, issuers' prefixes.
SECRET_WORDS = "password passwd pwd pass passphrase secret token key apikey api auth authorization bearer credential credentials private access".split()
OTHER_WORDS = "commit sha sha1 sha256 md5 checksum digest uuid guid id hash version build rev revision order invoice isbn file path".split()
PREFIXES = "AKIA ASIA ghp_ gho_ ghs_ sk- sk_ pk_ xox AIza glpat npm_ eyJ".split()
FEATURES = "length digits upper lower other transitions distinct entropy hex dictionary slashes path assigned quoted secret_word other_word prefix".split()

_RUN = np.zeros(256, dtype=bool)
_RUN[[ord(c) for c in string.ascii_letters + string.digits + "_/+-"]] = True
_KIND = np.full(256, 3, dtype=np.int8)
_KIND[48:58], _KIND[65:91], _KIND[97:123] = 0, 1, 2
_HEX = np.zeros(256, dtype=bool)
_HEX[[ord(c) for c in "0123456789abcdefABCDEF"]] = True
_QUOTES, _SIGNS, _STOPS, _TAIL = (np.isin(np.arange(256), [ord(c) for c in chars]) for chars in ("\"'`", "=:>", ",;", ".,;:)]}"))
_BLANK = np.isin(np.arange(256), [9, 32])
_END = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32]) | _QUOTES
_GRAM_BITS = 22
#: Kinds of candidates: a run, a value after a secret word to its end, and to its first separator.
_IN_RUN, _TO_END, _TO_STOP = range(3)


def _runs(data: np.ndarray, ends: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    inside = _RUN[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    cut = ends[:-1][np.diff(ends) > 0]
    first[cut] = inside[cut]
    start = np.flatnonzero(first)
    if not len(start):
        return start, start
    end = start + np.add.reduceat(inside.astype(np.int64), start)
    kind = _KIND[data]
    telling = inside & ((kind == 0) | ((kind == 1) & ~first))
    some = np.add.reduceat(telling.astype(np.int64), start) > 0
    take = (end - start >= least) & (some | (end - start >= 24))
    return start[take], end[take]


def _next(at: np.ndarray, places: np.ndarray, high: np.ndarray) -> np.ndarray:
    """The first of some sorted places at or after each position; ``high`` if there is none before it."""
    return np.minimum(np.append(places, np.iinfo(np.int64).max)[np.searchsorted(places, at)], high)


def _values(data: np.ndarray, ends: np.ndarray, w: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, kind) of the values quoted or assigned after secret words, whatever their bytes. A quoted one goes on
    to the same quote in its line; another to white space or a quote, and, as one more
    candidate, to its first comma or semicolon and without the closing marks after it."""
    none = (np.zeros(0, np.int64),) * 3
    if not len(w.start):
        return none
    said = np.isin(hashes(w), hashes(words(pa.array([" ".join(SECRET_WORDS)]), bare=True)))
    at, high = w.end[said], ends[w.text[said] + 1]
    byte = lambda p: np.where(p < high, data[np.minimum(p, len(data) - 1)], 10)
    solid, unsigned = np.flatnonzero(~_BLANK[data]), np.flatnonzero(~_SIGNS[data])
    at = _next(at + _QUOTES[byte(at)], solid, high)
    signed = _next(at, unsigned, high)
    # a closing quote of the word itself opens nothing: the value's own follows white space or a sign
    opened = _next(signed, solid, high)
    own = byte(opened)
    quoted = _QUOTES[own]
    before = np.where(signed > w.end[said], True, opened > w.end[said])
    use = (signed > at) | (quoted & before)
    start = opened + quoted
    line = _next(start, np.flatnonzero((data == 10) | (data == 13)), high)
    close = line
    for q in b"\"'`":
        close = np.where(quoted & (own == q), _next(start, np.flatnonzero(data == q), line), close)
    closed = quoted & (close < line) | quoted & (close < high) & (byte(close) == own)
    whole = np.where(closed, close, _next(start, np.flatnonzero(_END[data]), high))
    part = np.where(closed, whole, np.minimum(_next(start, np.flatnonzero(_STOPS[data]), high), whole))
    kept = np.flatnonzero(~_TAIL[data])
    last = np.append(-1, kept)[np.searchsorted(kept, part)] + 1
    part = np.where(closed, part, np.maximum(np.minimum(part, last), start))
    a, b = use & (whole > start) & (whole != part), use & (part > start)
    kind = np.concatenate([np.full(a.sum(), _TO_END), np.full(b.sum(), _TO_STOP)])
    return np.concatenate([start[a], start[b]]), np.concatenate([whole[a], part[b]]), kind


def candidates(data: np.ndarray, ends: np.ndarray, w: Words, least: int = 1) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, text, kind) of the runs of letters, digits and `_/+-` that have
    ``least`` bytes or more and a digit, a capital after the first byte, or 24 bytes; and of the values quoted or
    assigned after secret words, of any bytes and length. What is both is a value."""
    start, end = _runs(data, ends, least)
    more = _values(data, ends, w)
    start, end, kind = (np.concatenate(x) for x in ((start, more[0]), (end, more[1]), (np.full(len(start), _IN_RUN), more[2])))
    order = np.lexsort((-kind, end, start))
    start, end, kind = start[order], end[order], kind[order]
    new = np.ones(len(start), dtype=bool)
    new[1:] = (start[1:] != start[:-1]) | (end[1:] != end[:-1])
    start, end, kind = start[new], end[new], kind[new]
    return start, end, np.searchsorted(ends, start, side="right") - 1, kind


def apart(start: np.ndarray, end: np.ndarray, kind: np.ndarray) -> np.ndarray:
    """Which findings stay so that none overlap: values to a separator go before whole ones, these before runs."""
    keep, ranges = np.zeros(len(start), dtype=bool), []
    for k in np.lexsort((start, -kind)).tolist():
        at = bisect(ranges, (start[k], end[k]))
        if not (at and ranges[at - 1][1] > start[k] or at < len(ranges) and ranges[at][0] < end[k]):
            ranges.insert(at, (start[k], end[k]))
            keep[k] = True
    return keep


def _grams(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, owner) of each four bytes inside some spans, in lower case."""
    n = np.maximum(end - start - 3, 0)
    at = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n - start, n)
    low = _ALNUM[data].astype(np.uint64)
    code = np.zeros(len(at), dtype=np.uint64)
    for k in range(4):
        code = code << np.uint64(8) | low[at + k]
    return (mix(code) >> np.uint64(64 - _GRAM_BITS)).astype(np.int64), np.repeat(np.arange(len(start)), n)


def features(texts: pa.Array, dictionary: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, text, kind, features) of each candidate, in bytes of all texts."""
    data, ends = raw(texts)
    w = words(texts, bare=True)
    start, end, text, kind_of = candidates(data, ends, w)
    if not len(start):
        return start, end, text, kind_of, np.zeros((0, len(FEATURES)))
    size = end - start
    head = np.cumsum(size) - size
    owner = np.repeat(np.arange(len(size)), size)
    at = np.arange(int(size.sum())) - np.repeat(head - start, size)
    byte, kind = data[at], _KIND[data[at]]
    share = lambda m: np.add.reduceat(m.astype(float), head) / size
    change = np.zeros(len(at), dtype=bool)
    change[1:] = kind[1:] != kind[:-1]
    change[head] = False
    code, count = np.unique(owner * 256 + byte, return_counts=True)
    who = code // 256
    p = count / size[who]
    gram, of = _grams(data, start, end)
    known = np.bincount(of, dictionary[gram], len(size)) / np.maximum(np.bincount(of, minlength=len(size)), 1)
    inner = lambda x: np.where((x >= 0) & (x < len(data)), data[np.clip(x, 0, len(data) - 1)], 32)
    low, high = ends[text], ends[text + 1]
    before = [np.where(start - k >= low, inner(start - k), 32) for k in (1, 2, 3)]
    after = np.where(end < high, inner(end), 32)
    last = np.searchsorted(w.end, start, side="right") - 1
    near = (last >= 0) & (w.text[np.maximum(last, 0)] == text) & (start - w.end[np.maximum(last, 0)] <= 4) if len(w.end) else np.zeros(len(size), bool)
    own = Words(w.data, w.start[last[near]], w.end[last[near]], w.text[last[near]], w.texts)
    said = np.zeros((2, len(size)), dtype=bool)
    for k, group in enumerate((SECRET_WORDS, OTHER_WORDS)):
        named = words(pa.array([" ".join(group)]), bare=True)
        said[k, near] = np.isin(hashes(own), hashes(named))
    prefixed = np.zeros(len(size), dtype=bool)
    for prefix in PREFIXES:
        same = np.ones(len(size), dtype=bool)
        for k, c in enumerate(prefix.encode()):
            same &= data[np.minimum(start + k, len(data) - 1)] == c
        prefixed |= same
    marks = lambda x, chars: np.isin(x, [ord(c) for c in chars])
    columns = [
        np.log(size), share(kind == 0), share(kind == 1), share(kind == 2), share(kind == 3), np.add.reduceat(change.astype(float), head) / size,
        np.bincount(who, minlength=len(size)) / size, -np.bincount(who, p * np.log2(p), len(size)), share(_HEX[byte]), known,
        share(byte == ord("/")), marks(before[0], "./~\\") | marks(after, "./\\:"), marks(before[0], "=:") | marks(before[1], "=:") | marks(before[2], "=:"), marks(before[0], "\"'`") & marks(after, "\"'`"), said[0], said[1], prefixed,
    ]
    return start, end, text, kind_of, np.stack([np.asarray(c, dtype=float) for c in columns], axis=1)


class Forest(NamedTuple):
    """Trees of one shape: node k of a tree has children 2k + 1 and 2k + 2."""

    feature: np.ndarray
    bound: np.ndarray
    share: np.ndarray
    depth: int

    def __call__(self, x: np.ndarray) -> np.ndarray:
        """The trees' mean share of label 1."""
        total = np.zeros(len(x))
        for feature, bound, share in zip(self.feature, self.bound, self.share):
            at = np.zeros(len(x), dtype=np.int64)
            for _ in range(self.depth):
                at = 2 * at + 1 + (x[np.arange(len(x)), feature[at]] > bound[at])
            total += share[at]
        return total / max(len(self.feature), 1)


def fit_forest(x: np.ndarray, y: np.ndarray, trees: int = 40, depth: int = 7, seed: int = 0) -> Forest:
    """Random forest: each tree sees a bootstrap of the rows, each node the best cut by Gini
    impurity among 16 quantiles of a random third of the features."""
    rng = np.random.default_rng(seed)
    nodes = 2 ** (depth + 1) - 1
    feature, bound, share = np.zeros((trees, nodes), np.int64), np.full((trees, nodes), np.inf), np.zeros((trees, nodes))
    for t in range(trees):
        rows = {0: rng.integers(0, len(y), len(y))}
        for k in range(nodes):
            own = rows.pop(k, None)
            if own is None:
                continue
            share[t, k] = y[own].mean()
            if k >= nodes // 2:
                continue
            best = None
            if 0 < share[t, k] < 1:
                for f in rng.choice(x.shape[1], max(1, x.shape[1] // 3), replace=False):
                    v = x[own, f]
                    for cut in np.unique(np.quantile(v, np.linspace(0.03, 0.97, 16))):
                        left = v <= cut
                        n = left.sum()
                        if 0 < n < len(own):
                            a, b = y[own[left]].mean(), y[own[~left]].mean()
                            cost = n * a * (1 - a) + (len(own) - n) * b * (1 - b)
                            if best is None or cost < best[0]:
                                best = (cost, f, cut, left)
            if best is None:  # all rows go left
                rows[2 * k + 1] = own
                continue
            _, feature[t, k], bound[t, k], left = best
            rows[2 * k + 1], rows[2 * k + 2] = own[left], own[~left]
    return Forest(feature, bound, share, depth)


def example_findings(prose: list[str], n: int = 3000, seed: int = 0) -> tuple[list[str], list[int]]:
    """Labelled findings: texts with one candidate each, 1 if it is a secret.
    ``prose`` is text of the corpus, in which they stand and whose own candidates are not secrets."""
    r = random.Random(seed)
    words_of = [w for t in prose for w in t.split()] or ["the"]
    some = lambda chars, k: "".join(r.choice(chars) for _ in range(k))
    hexa, b32, b62 = "0123456789abcdef", string.ascii_uppercase + "234567", string.ascii_letters + string.digits
    texts, labels = [], []
    for i in range(n):
        a, b = (" ".join(r.choice(words_of) for _ in range(4)) for _ in range(2))
        word = r.choice(SECRET_WORDS[:-3])
        sign, q = r.choice(["=", ": ", " = ", ":"]), r.choice(['"', "", "'"])
        bare = [f"AKIA{some(b32, 16)}", f"ghp_{some(b62, 36)}", f"sk-{some(b62, 48)}", f"xoxb-{some('0123456789', 12)}-{some(b62, 24)}", f"AIza{some(b62 + '_-', 35)}"]
        kept = [some(hexa, r.choice([18, 24, 32, 40, 64])), some(b62, r.randint(16, 44)), some(b62 + "+/", r.choice([40, 64]))]
        chosen = "".join(r.sample([r.choice(words_of).title(), some(b62, r.randint(2, 5)), r.choice("!@#$%&*.?^~") + some("0123456789", r.randint(1, 4)), some(b62, r.randint(1, 3)) + r.choice("!@#$%&*.?^~")], r.choice([2, 3, 4])))
        short = [some(b62, r.randint(8, 15)), some(hexa, r.randint(8, 16)), some(string.ascii_lowercase, r.randint(4, 8)) + some("0123456789", r.randint(1, 3)) + some(string.ascii_lowercase, r.randint(0, 4)), chosen]
        secret = r.choice(bare) if i % 2 else f"{word}{sign}{q}{r.choice(kept)}{q}" if i % 4 else f"{word}{sign}{q}{r.choice(short)}{q}"
        plain = [
            f"commit {some(hexa, 40)}", f"sha256 {some(hexa, 64)}", f"id {some(hexa, 8)}-{some(hexa, 4)}-{some(hexa, 4)}-{some(hexa, 4)}-{some(hexa, 12)}", some("0123456789", r.randint(12, 19)),
            f"src/{some(string.ascii_lowercase, 5)}/{some(string.ascii_lowercase, 7)}{r.randint(1, 9)}/Main", f"version-{r.randint(1, 9)}-build-{r.randint(20000101, 20291231)}",
            "".join(some(string.ascii_lowercase, r.randint(3, 6)).title() for _ in range(4)) + str(r.randint(1, 99)), r.choice(words_of).upper() + r.choice(words_of).upper() + r.choice(words_of).title(),
            "".join(r.choice(words_of) for _ in range(5)), f"checksum: {some(hexa, 32)}", f"{r.choice(words_of)}-{r.choice(words_of)}-{r.randint(1000, 9999)}-{r.choice(words_of)}",
            f"{r.choice(OTHER_WORDS)}{sign}{q}{some(hexa, r.randint(6, 16))}{q}", f"{word}{sign}{q}{r.choice(words_of)}{q}", f"{r.choice(words_of)}{sign}{q}{r.choice(words_of)}{q}", some("0123456789", r.randint(1, 8)), f"{r.choice(words_of).title()}{r.choice(words_of).title()}", f"{r.choice(words_of)}{r.randint(1, 99)}",
        ]
        texts += [f"{a} {secret} {b}", f"{a} {r.choice(plain)} {b}"]
        labels += [1, 0]
    return texts, labels


class Scanner(NamedTuple):
    dictionary: np.ndarray
    forest: Forest


def train_scanner(docs: DataFrame, findings: tuple[list[str], list[int]] | None = None, text_col: str = "text", max_docs: int = 300, least_share: float = 2e-6, seed: int = 0) -> Scanner:
    """A scanner: a dictionary of the four-byte strings that are ``least_share`` or
    more of all those in words of all documents, so it doesn't depend on how many there are (2**22 bits), and a forest trained
    on labelled findings (texts, labels); by default ``example_findings`` in prose of about ``max_docs``
    documents of under 100 kB. Null texts teach nothing."""
    source = docs.select(F.col(text_col).alias("text")).filter("text is not null")

    def count(batches):
        total = np.zeros(1 << _GRAM_BITS, dtype=np.int64)
        for batch in batches:
            for texts in pieces(batch.column(0)):
                w = words(texts, bare=True)
                gram, n = np.unique(_grams(w.data, w.start, w.end)[0], return_counts=True)
                total[gram] += n
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["gram", "n"])

    counted = written(source.mapInArrow(count, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n")), "grams")
    windows = counted.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    dictionary = np.zeros(1 << _GRAM_BITS, dtype=bool)
    dictionary[[r.gram for r in counted.filter(F.col("n") >= least_share * windows).select("gram").collect()]] = True
    n = source.count()
    drawn = source.filter((F.abs(F.xxhash64("text") % 1000000) < 1000000 * max_docs / max(n, 1)) & (F.octet_length("text") < 100000)).limit(2 * max_docs)
    texts, labels = example_findings(sorted(r.text for r in drawn.collect()), seed=seed) if findings is None else findings
    _, _, text, kind, x = features(pa.array(texts, type=pa.string()), dictionary)
    # a text's finding is its value after a secret word, or else its longest candidate
    length = x[:, 0]
    order = np.lexsort((-length, -kind, text))
    first = order[np.unique(text[order], return_index=True)[1]]
    return Scanner(dictionary, fit_forest(x[first], np.array(labels, dtype=float)[text[first]], seed=seed))


def scan(docs: DataFrame, scanner: Scanner, threshold: float = 0.5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: id, n_candidates, findings: an array of (start, end, score, value),
    start and end in code points, of the candidates in the whole text whose score reaches ``threshold``;
    of those that overlap, values after secret words stay.

    Null and empty texts have none. Ids aren't looked at. Equal rows have equal
    results. No rows give no rows. Other columns are ignored, whatever their names."""
    shared = docs.sparkSession.sparkContext.broadcast(scanner)

    def run(batches):
        scanner = shared.value
        for batch in batches:
            done = 0
            for texts in pieces(batch.column(1)):
                own = batch.column(0).slice(done, len(texts))
                done += len(texts)
                start, end, text, kind, x = features(texts, scanner.dictionary)
                score = scanner.forest(x)
                hit = score >= threshold
                hit[hit] = apart(start[hit], end[hit], kind[hit])
                data, ends = raw(texts)
                points = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)]) if hit.any() else np.zeros(len(data) + 1, np.int64)
                base = points[ends[:-1]][text[hit]]
                values = [data[a:b].tobytes().decode() for a, b in zip(start[hit].tolist(), end[hit].tolist())]
                found = pa.StructArray.from_arrays([pa.array((points[start[hit]] - base).astype(np.int32)), pa.array((points[end[hit]] - base).astype(np.int32)), pa.array(score[hit]), pa.array(values, type=pa.string())], names=["start", "end", "score", "value"])
                lists = pa.ListArray.from_arrays(pa.array(np.searchsorted(text[hit], np.arange(len(texts) + 1)).astype(np.int32)), found)
                yield pa.RecordBatch.from_arrays([own, pa.array(np.bincount(text, minlength=len(texts)).astype(np.int64)), lists], names=["id", "n_candidates", "findings"])

    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = source.schema["id"].dataType.simpleString()
    return source.mapInArrow(run, f"id {kind}, n_candidates long, findings array<struct<start: int, end: int, score: double, value: string>>").withColumnRenamed("id", id_col)
