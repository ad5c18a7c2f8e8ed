"""Language identification of mixed-language text."""

from __future__ import annotations

import unicodedata
from collections.abc import Sequence
from functools import cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._common import lean, tidy
from .textvec import Words, pieces, raw, words

#: The Unicode ranges of the commoner scripts. Letters outside them are "other".
SCRIPTS = {
    "latin": [(0x41, 0x24F), (0x1E00, 0x1EFF), (0x2C60, 0x2C7F), (0xA720, 0xA7FF), (0xAB30, 0xAB6F), (0xFF21, 0xFF5A)],
    "greek": [(0x370, 0x3FF), (0x1F00, 0x1FFF)],
    "cyrillic": [(0x400, 0x52F), (0x1C80, 0x1C8F), (0x2DE0, 0x2DFF), (0xA640, 0xA69F)],
    "armenian": [(0x530, 0x58F)],
    "hebrew": [(0x590, 0x5FF), (0xFB1D, 0xFB4F)],
    "arabic": [(0x600, 0x6FF), (0x750, 0x77F), (0x8A0, 0x8FF), (0xFB50, 0xFDFF), (0xFE70, 0xFEFF)],
    "devanagari": [(0x900, 0x97F), (0xA8E0, 0xA8FF)],
    "bengali": [(0x980, 0x9FF)],
    "gurmukhi": [(0xA00, 0xA7F)],
    "gujarati": [(0xA80, 0xAFF)],
    "tamil": [(0xB80, 0xBFF)],
    "telugu": [(0xC00, 0xC7F)],
    "kannada": [(0xC80, 0xCFF)],
    "malayalam": [(0xD00, 0xD7F)],
    "sinhala": [(0xD80, 0xDFF)],
    "thai": [(0xE00, 0xE7F)],
    "lao": [(0xE80, 0xEFF)],
    "tibetan": [(0xF00, 0xFFF)],
    "myanmar": [(0x1000, 0x109F)],
    "georgian": [(0x10A0, 0x10FF), (0x1C90, 0x1CBF), (0x2D00, 0x2D2F)],
    "ethiopic": [(0x1200, 0x139F)],
    "khmer": [(0x1780, 0x17FF)],
    "mongolian": [(0x1800, 0x18AF)],
    "kana": [(0x3040, 0x30FF), (0x31F0, 0x31FF), (0xFF66, 0xFF9F)],
    "hangul": [(0x1100, 0x11FF), (0x3130, 0x318F), (0xAC00, 0xD7FF)],
    "han": [(0x2E80, 0x2FDF), (0x3005, 0x3007), (0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xF900, 0xFAFF), (0x20000, 0x3FFFF)],
}
BUCKETS = 1 << 16


@cache
def _script_of() -> np.ndarray:
    """For each code point the number of its script, from 1; 0 if it is no letter."""
    names = list(SCRIPTS)
    table = np.zeros(0x110000, dtype=np.int8)
    letters = np.array([c for c in range(0x40000) if unicodedata.category(chr(c))[0] == "L"])
    table[letters] = len(names) + 1
    for k, name in enumerate(names):
        for low, high in SCRIPTS[name]:
            own = table[low : high + 1]
            own[own > 0] = k + 1
    return table


class LanguageModel(NamedTuple):
    """For each language (in order of name): the scripts it was seen in, as a bit
    mask, and the log-probability of each bucket of three bytes."""

    languages: list[str]
    scripts: np.ndarray
    logs: np.ndarray


def _grams(w: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bucket of each three bytes around a byte of a word, first of each word, bytes of each word)."""
    size = w.end - w.start
    first = np.cumsum(size) - size
    at = np.arange(int(size.sum())) - np.repeat(first - w.start, size)
    data = np.concatenate([w.data, [32]]).astype(np.uint32)
    left, right = data[at - 1], data[at + 1]  # the first byte's left is the last: a space
    left[first], right[first + size - 1] = 32, 32
    code = (left << np.uint32(16) | data[at] << np.uint32(8) | right) * np.uint32(2654435761)
    return (code >> np.uint32(16)).astype(np.int64), first, size


def _letters(w: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each word its number of letters and a mask of their scripts; for each
    letter that isn't ASCII ... the last: letters by (word, script) as flat pairs."""
    lower = ((w.data >= 97) & (w.data <= 122)).astype(np.int64)
    total = np.concatenate([[0], np.cumsum(lower)])
    count = total[w.end] - total[w.start]
    mask = np.where(count > 0, 2, 0).astype(np.int64)
    lead = np.flatnonzero(w.data >= 0xC0)
    if len(lead):
        d = np.concatenate([w.data, np.zeros(3, np.uint8)]).astype(np.int64)
        a, b, c, e = d[lead], d[lead + 1] & 63, d[lead + 2] & 63, d[lead + 3] & 63
        point = np.where(a < 0xE0, (a & 31) << 6 | b, np.where(a < 0xF0, (a & 15) << 12 | b << 6 | c, (a & 7) << 18 | b << 12 | c << 6 | e))
        script = _script_of()[np.minimum(point, 0x10FFFF)]
        owner = np.searchsorted(w.start, lead, side="right") - 1
        owner, script = owner[script > 0], script[script > 0].astype(np.int64)
        count += np.bincount(owner, minlength=len(count))
        np.bitwise_or.at(mask, owner, np.int64(1) << script)
        return count, mask, np.stack([owner, script])
    return count, mask, np.zeros((2, 0), dtype=np.int64)


def train(labelled: DataFrame, text_col: str = "text", lang_col: str = "lang", max_docs: int = 4000, by: Column | None = None) -> LanguageModel:
    """A model from labelled rows. Of each language about ``max_docs`` rows (all, if
    it has no more) are learned from, chosen by the hash of ``by``, whole texts each. Counts
    are added up on the executors; the driver gets at most 65536 buckets a language.
    Rows with null text or label teach nothing."""
    rows = labelled.select(F.col(text_col).alias("text"), F.col(lang_col).alias("lang"), F.abs(F.xxhash64(F.col(text_col) if by is None else by) % 1000000).alias("draw")).filter("lang is not null and text is not null")
    sizes = {r.lang: r.n for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    languages = sorted(sizes)
    if not languages:
        return LanguageModel([], np.zeros(0, np.int64), np.zeros((0, BUCKETS), np.float32))
    share = F.create_map(*[x for k, n in sizes.items() for x in (F.lit(k), F.lit(1000000 * max_docs // n))])
    number = F.create_map(*[x for k, lang in enumerate(languages) for x in (F.lit(lang), F.lit(k))])
    rows = rows.filter(F.col("draw") < share[F.col("lang")]).select("text", number[F.col("lang")].alias("lang"))
    n_scripts = len(SCRIPTS) + 2

    def count(batches):
        grams, scripts = np.zeros((len(languages), BUCKETS), np.int64), np.zeros((len(languages), n_scripts), np.int64)
        for batch in batches:
            langs = batch.column(1).to_numpy()
            at = 0
            for texts in pieces(batch.column(0), 1 << 19):
                own = langs[at : at + len(texts)]
                at += len(texts)
                w = words(texts)
                if not len(w.start):
                    continue
                bucket, _, size = _grams(w)
                letters, _, (owner, script) = _letters(w)
                lang = own[w.text]
                used = np.repeat(letters > 0, size)
                np.add.at(scripts, (lang[owner], script), 1)
                scripts[:, 1] += np.bincount(lang, letters - np.bincount(owner, minlength=len(letters)), len(languages)).astype(np.int64)
                flat = np.repeat(lang, size)[used] * BUCKETS + bucket[used]
                grams += np.bincount(flat, minlength=grams.size).reshape(grams.shape)
        for table, base in ((grams, 0), (scripts, BUCKETS)):
            k, b = np.nonzero(table)
            yield pa.RecordBatch.from_arrays([pa.array(k.astype(np.int32)), pa.array((b + base).astype(np.int32)), pa.array(table[k, b])], names=["lang", "bucket", "n"])

    got = rows.mapInArrow(tidy(count), "lang int, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()
    grams, scripts = np.zeros((len(languages), BUCKETS)), np.zeros((len(languages), n_scripts))
    own = got[got.bucket < BUCKETS]
    grams[own.lang, own.bucket] = own.n
    own = got[got.bucket >= BUCKETS]
    scripts[own.lang, own.bucket - BUCKETS] = own.n
    logs = np.log((grams + 0.3) / (grams.sum(1, keepdims=True) + 0.3 * BUCKETS))
    often = scripts > 0.01 * np.maximum(scripts.sum(1, keepdims=True), 1)
    return LanguageModel(languages, (often << np.arange(n_scripts)).sum(1), logs.astype(np.float32))


def word_scores(w: Words, model: LanguageModel, cap: float = 6.0) -> tuple[np.ndarray, np.ndarray]:
    """(words x languages log-likelihoods less the best, letters of each word). A word's scripts narrow the
    languages: to those seen in all of them, else in any of them, else none is
    ruled out. Words without letters say nothing. ``cap`` bounds what one word says."""
    n = len(model.languages)
    if not len(w.start):
        return np.zeros((0, n), np.float32), np.zeros(0, np.int64)
    bucket, first, _ = _grams(w)
    score = np.stack([np.add.reduceat(row[bucket], first) for row in model.logs], axis=1) * np.float32(0.5)
    letters, mask, _ = _letters(w)
    kinds, kind = np.unique(mask, return_inverse=True)
    every = (kinds[:, None] & ~model.scripts) == 0
    some = (kinds[:, None] & model.scripts) != 0
    may = np.where(every.any(1, keepdims=True), every, np.where(some.any(1, keepdims=True), some, True))
    if not may.all():
        score = np.where(may[kind], score, -np.inf)
    score = np.maximum(score - score.max(1, keepdims=True), np.float32(-cap))
    score[letters == 0] = 0
    return score, letters


def viterbi(score: np.ndarray, text: np.ndarray, texts: int, penalty: float, chunk: int = 128) -> np.ndarray:
    """The best state of each word: the sum of scores less a penalty for each
    change is largest. Texts are cut into chunks; each chunk's best score between
    any two states is found for all chunks at once, a text's chunks are chained,
    and then the ways through all chunks are traced back at once."""
    total, n = score.shape
    if not total:
        return np.zeros(0, dtype=np.int64)
    count = np.bincount(text, minlength=texts)
    parts = -(-count // chunk)
    doc = np.repeat(np.arange(texts), parts)
    head = np.cumsum(parts) - parts
    number = np.arange(len(doc)) - head[doc]
    within = np.arange(total) - np.repeat(np.cumsum(count) - count, count)
    row, col = within % chunk, head[text] + within // chunk
    steps = np.zeros((chunk, len(doc), n), dtype=np.float32)
    steps[row, col] = score
    pen = np.float32(penalty)
    # between any two states
    through = np.broadcast_to((np.eye(n, dtype=np.float32) - 1) * pen, (len(doc), n, n)) + steps[0][:, None, :]
    for t in range(1, chunk):
        through = np.maximum(through, through.max(2, keepdims=True) - pen) + steps[t][:, None, :]
    # along each text
    enter = np.zeros((len(doc), n), dtype=np.float32)
    state = np.zeros((texts, n), dtype=np.float32)
    by_number = np.argsort(number, kind="stable")
    bounds = np.searchsorted(number[by_number], np.arange(int(parts.max()) + 1))
    for a, b in zip(bounds[:-1], bounds[1:]):
        own = by_number[a:b]
        enter[own] = state[doc[own]]
        new = (state[doc[own]][:, :, None] + through[own]).max(1)
        state[doc[own]] = new - new.max(1, keepdims=True)
    at = state.argmax(1)
    leave = np.zeros(len(doc), dtype=np.int64)
    for a, b in zip(bounds[-2::-1], bounds[:0:-1]):
        own = by_number[a:b]
        leave[own] = at[doc[own]]
        at[doc[own]] = (enter[own] + through[own, :, leave[own]]).argmax(1)
    # within the chunks
    best, stay = np.zeros((chunk, len(doc)), dtype=np.int16), np.zeros((chunk, len(doc), n), dtype=bool)
    value = enter
    for t in range(chunk):
        best[t] = value.argmax(1)
        top = value.max(1, keepdims=True) - pen
        stay[t] = value >= top
        value = np.maximum(value, top) + steps[t]
    way = np.zeros((chunk, len(doc)), dtype=np.int64)
    every = np.arange(len(doc))
    for t in range(chunk - 1, -1, -1):
        way[t] = leave
        leave = np.where(stay[t, every, leave], leave, best[t])
    return way[row, col]


def identify(docs: DataFrame, model: LanguageModel, penalty: float = 8.0, id_col: str = "doc_id", text_col: str = "text", spans: bool = True, carry: Sequence[str] = ()) -> DataFrame:
    """One row a document: id, lang_pred, score, if ``spans`` an array of
    (start, end, lang) in code points, and the columns in ``carry`` as they are.

    Scripts narrow a word's languages, three-byte statistics score them, and Viterbi
    with a penalty for each change labels the words of the whole text. lang_pred has the most
    letters (of equals the first by name), score is its share of the letters times
    its probability by all words. Null text, text without letters and a model
    without languages give `und`, score 0 and no spans. Ids aren't looked at. No
    rows give no rows. Columns not in ``carry`` are ignored, whatever their names."""
    names = np.array([*model.languages, "und"], dtype=object)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        lean()
        model = shared.value
        n = len(model.languages)
        for batch in batches:
            done = 0
            for texts in pieces(batch.column(1), 1 << 19):
                own = batch.column(0).slice(done, len(texts))
                done += len(texts)
                w = words(texts)
                if not n:
                    w = w._replace(start=w.start[:0], end=w.end[:0], text=w.text[:0])
                score, letters = word_scores(w, model)
                state = viterbi(score, w.text, w.texts, penalty) if n else np.zeros(0, np.int64)
                by = np.bincount(w.text * max(n, 1) + state, letters, w.texts * max(n, 1)).reshape(w.texts, -1)
                sums = np.stack([np.bincount(w.text, s, w.texts) for s in score.T], axis=1) if n else np.zeros((w.texts, 1))
                likely = np.exp(sums - sums.max(1, keepdims=True))
                likely /= likely.sum(1, keepdims=True)
                top, some = by.argmax(1), by.sum(1)
                every = np.arange(w.texts)
                value = np.where(some > 0, by[every, top] / np.maximum(some, 1) * likely[every, top], 0.0)
                kept = [batch.column(2 + k).slice(done - len(texts), len(texts)) for k in range(len(carry))]
                columns = [own, pa.array(names[np.where(some > 0, top, n)], type=pa.string()), pa.array(value)]
                if spans:
                    points = np.concatenate([[0], np.cumsum((w.data & 0xC0) != 0x80)])
                    _, ends = raw(texts)
                    new = np.ones(len(state), dtype=bool)
                    new[1:] = (state[1:] != state[:-1]) | (w.text[1:] != w.text[:-1])
                    new &= some[w.text] > 0
                    low = np.flatnonzero(new)
                    high = np.append(low[1:], 0)[: len(low)] - 1
                    high = np.where((high >= 0) & (w.text[high] == w.text[low]), high, np.searchsorted(w.text, w.text[low], side="right") - 1)
                    base = points[ends[:-1]][w.text[low]]
                    spanned = pa.StructArray.from_arrays([pa.array((points[w.start[low]] - base).astype(np.int32)), pa.array((points[w.end[high]] - base).astype(np.int32)), pa.array(names[state[low]], type=pa.string())], names=["start", "end", "lang"])
                    columns.append(pa.ListArray.from_arrays(pa.array(np.searchsorted(w.text[low], np.arange(w.texts + 1)).astype(np.int32)), spanned))
                yield pa.RecordBatch.from_arrays([*columns, *kept], names=[f.name for f in schema])

    source = docs.select(F.col(id_col), F.col(text_col).alias("_text"), *carry)
    schema = T.StructType([source.schema[id_col], T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    if spans:
        span = T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("lang", T.StringType())])
        schema = schema.add("spans", T.ArrayType(span))
    schema = T.StructType([*schema.fields, *(source.schema[c] for c in carry)])
    return source.mapInArrow(tidy(run), schema)
