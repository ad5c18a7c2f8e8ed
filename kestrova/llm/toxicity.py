"""Toxicity by the nearest labelled examples."""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import written
from .textvec import Words, hashes, mix, pieces, words

_BLOCK = 64
#: Levels (powers of 2) of a text's occurrences of vocabulary words, and of its words to one such.
_LEVELS = 16
_PREFIX = np.uint64(0x5851F42D4C957F2D)


class Index(NamedTuple):
    """Labelled examples as unit TF-IDF vectors, in blocks of 64.

    ``terms`` are sorted hashes. Term t's postings are ``example`` and ``weight``
    from ``start[t]`` to ``start[t + 1]``, by example; ``most[t, b]`` is its largest
    weight in block b. ``ids`` and ``labels`` are the examples'. ``steps`` and ``levels`` turn
    votes into scores; ``prior`` is the score of a text without any term."""

    terms: np.ndarray
    idf: np.ndarray
    start: np.ndarray
    example: np.ndarray
    weight: np.ndarray
    most: np.ndarray
    ids: np.ndarray
    labels: np.ndarray
    steps: np.ndarray
    levels: np.ndarray
    prior: float


def _terms(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(hash, text) of every word and, of longer words, of the first four and six bytes."""
    w = words(texts, bare=True)
    out, text = [hashes(w)], [w.text]
    for n in (4, 6):
        long = w.end - w.start > n
        out.append(mix(hashes(Words(w.data, w.start[long], w.start[long] + n, w.text[long], w.texts)) ^ _PREFIX))
        text.append(w.text[long])
    return np.concatenate(out), np.concatenate(text)


def _vectors(texts: pa.Array, terms: np.ndarray, sieve: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, term number, occurrences), by text and term. After the vocabulary
    come terms for how many of its words a text has, and how thickly."""
    if not len(terms):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    h, text = _terms(texts)
    size = np.bincount(text, minlength=len(texts))
    some = sieve[(h & np.uint64(len(sieve) - 1)).astype(np.int64)]
    h, text = h[some], text[some]
    at = np.minimum(np.searchsorted(terms, h), len(terms) - 1)
    hit = terms[at] == h
    width = len(terms) + 2 * _LEVELS
    hits = np.bincount(text[hit], minlength=len(texts))
    own = np.flatnonzero(hits)
    much = np.minimum(np.log2(hits[own]).astype(np.int64), _LEVELS - 1)
    rare = np.minimum(np.log2(size[own] / hits[own]).astype(np.int64), _LEVELS - 1)
    levels = own[:, None] * width + len(terms) + np.stack([much, _LEVELS + rare], axis=1)
    code, count = np.unique(np.concatenate([text[hit] * width + at[hit], levels.ravel()]), return_counts=True)
    return code // width, code % width, count


def _sieve(terms: np.ndarray) -> np.ndarray:
    out = np.zeros(1 << 20, dtype=bool)
    out[(terms & np.uint64(len(out) - 1)).astype(np.int64)] = True
    return out


def _unit(text, term, count, idf, texts):
    weight = (1 + np.log(count)) * idf[term]
    norm = np.sqrt(np.bincount(text, weight * weight, texts))
    return weight / np.where(norm > 0, norm, 1)[text]


def nearest(text, term, weight, texts: int, index: Index, k: int, without: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(examples, cosines), texts x k: the exact k nearest of each text's unit vector,
    of equal cosines the first; -1 and 0 where no more have a term in common.
    A block's bound is the sum of its largest weights times the text's: blocks are
    taken by falling bound, and a text is done when its k-th cosine reaches the next.
    ``without``: for each text an example that doesn't count."""
    blocks = index.most.shape[1]
    found, cosines = np.full((texts, k), -1, np.int64), np.zeros((texts, k))
    if not len(text):
        return found, cosines
    own, first = np.unique(text, return_index=True)
    bound = np.add.reduceat(index.most[term] * weight[:, None], first, axis=0)
    order = np.argsort(-bound, axis=1, kind="stable")
    ends = np.append(first[1:], len(text))
    left = np.arange(len(own))
    # one posting list for each term and block
    of_block = index.example // _BLOCK
    for turn in range(blocks):
        top = bound[left, order[left, turn]]
        left = left[(top > 0) & (top + 1e-9 >= cosines[own[left], -1])]
        if not len(left):
            break
        size = ends[left] - first[left]
        at = np.repeat(first[left] - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
        row, block = np.repeat(np.arange(len(left)), size), np.repeat(order[left, turn], size)
        low = np.searchsorted(_key(index, of_block, blocks), term[at] * blocks + block)
        high = np.searchsorted(_key(index, of_block, blocks), term[at] * blocks + block, side="right")
        n = high - low
        post = np.repeat(low - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
        cell = np.repeat(row, n) * _BLOCK + index.example[post] % _BLOCK
        score = np.bincount(cell, np.repeat(weight[at], n) * index.weight[post], len(left) * _BLOCK).reshape(-1, _BLOCK)
        example = order[left, turn][:, None] * _BLOCK + np.arange(_BLOCK)
        if without is not None:
            score[example == without[own[left]][:, None]] = 0
        both = np.concatenate([cosines[own[left]], score], axis=1)
        who = np.concatenate([found[own[left]], np.where(score > 0, example, -1)], axis=1)
        best = np.lexsort((np.where(who < 0, 1 << 60, who), -np.round(both, 12)), axis=1)[:, :k]
        cosines[own[left]] = np.take_along_axis(both, best, 1)
        found[own[left]] = np.take_along_axis(who, best, 1)
    return found, cosines


def _key(index: Index, of_block: np.ndarray, blocks: int) -> np.ndarray:
    return np.repeat(np.arange(len(index.idf)), np.diff(index.start)) * blocks + of_block


def _votes(found: np.ndarray, cosines: np.ndarray, labels: np.ndarray) -> np.ndarray:
    """The share of label 1 among the neighbours, each weighted by its cosine."""
    total = cosines.sum(1)
    return np.where(total > 0, (cosines * (labels[found] * (found >= 0))).sum(1) / np.where(total > 0, total, 1), -1)


def build(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", max_examples: int = 3000, max_terms: int = 4096, min_ratio: float = 4.0, k: int = 15) -> Index:
    """An index of labelled examples: those ``docs`` that ``labels`` (id, label) names, about
    ``max_examples`` of each label (all, if there are no more), by the hash of
    their id; so few label rows are broadcast and no text is shuffled. The vocabulary has the ``max_terms`` words
    and word beginnings that are most surely commoner with label 1 (by at least four
    standard errors, and ``min_ratio`` times); document frequencies count all of ``docs``. Scores are
    calibrated on the examples, each voted on by the others, with weights that
    undo the sampling. Rows with null text or label teach nothing."""
    rows = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label")).filter("id is not null and label in (0, 1)")
    sizes = {r.label: r.n for r in rows.groupBy("label").agg(F.count("*").alias("n")).collect()}
    share = F.when(F.col("label") == 1, max_examples / max(sizes.get(1, 0), 1)).otherwise(max_examples / max(sizes.get(0, 0), 1))
    drawn = F.broadcast(rows.filter(F.abs(F.xxhash64("id") % 1000000) < share * 1000000))
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).filter("text is not null")
    rows = written(source.join(drawn, "id").select(F.col("id").cast("long"), "text", "label"), "examples")

    def occur(batches):
        for batch in batches:
            at = 0
            for texts in pieces(batch.column(1)):
                label = batch.column(2).slice(at, len(texts)).to_numpy()
                at += len(texts)
                h, text = _terms(texts)
                order = np.lexsort((h, text))
                h, text = h[order], text[order]
                new = np.ones(len(h), dtype=bool)
                new[1:] = (h[1:] != h[:-1]) | (text[1:] != text[:-1])
                for side in (0, 1):
                    t, n = np.unique(h[new & (label[text] == side)], return_counts=True)
                    n = n.astype(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(t.view(np.int64)), pa.array(n * (side == 0)), pa.array(n * (side == 1))], names=["term", "n0", "n1"])

    n0, n1 = (max(1, r) for r in rows.agg(F.count_if(F.col("label") == 0), F.count_if(F.col("label") == 1)).first())
    counts = rows.mapInArrow(occur, "term long, n0 long, n1 long").groupBy("term").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1")).filter("n0 + n1 >= 3")
    p = (F.col("n0") + F.col("n1")) / (n0 + n1)
    z = F.abs(F.col("n1") / n1 - F.col("n0") / n0) / F.sqrt(F.greatest(p * (1 - p), F.lit(1e-9)) * (1 / n1 + 1 / n0))
    terms = np.sort(np.array([r.term for r in counts.withColumn("z", z).filter("z >= 4").filter(F.col("n1") / n1 >= min_ratio * F.col("n0") / n0).orderBy(F.desc("z"), "term").limit(max_terms).collect()], dtype=np.int64).view(np.uint64))
    sieve = _sieve(terms)

    def frequency(batches):
        total, seen = np.zeros(len(terms) + 2 * _LEVELS, np.int64), 0
        for batch in batches:
            for texts in pieces(batch.column(0)):
                _, term, _ = _vectors(texts, terms, sieve)
                total += np.bincount(term, minlength=len(total))
                seen += len(texts)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1)), pa.array(np.append(total[at], seen))], names=["term", "n"])

    df = docs.select(F.col(text_col).alias("text")).mapInArrow(frequency, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()
    seen = dict((r.term, r.n) for r in df)
    idf = np.log((1 + seen.get(-1, 0)) / (1 + np.array([seen.get(t, 0) for t in range(len(terms) + 2 * _LEVELS)], dtype=float)))

    def vectors(batches):
        for batch in batches:
            at = 0
            for texts in pieces(batch.column(1)):
                ids, label = (batch.column(c).slice(at, len(texts)) for c in (0, 2))
                at += len(texts)
                text, term, count = _vectors(texts, terms, sieve)
                ends = np.searchsorted(text, np.arange(len(texts) + 1)).astype(np.int32)
                yield pa.RecordBatch.from_arrays([ids, label, pa.ListArray.from_arrays(pa.array(ends), pa.array(term)), pa.ListArray.from_arrays(pa.array(ends), pa.array(count.astype(np.int64)))], names=["id", "label", "term", "count"])

    got = rows.mapInArrow(vectors, "id long, label int, term array<long>, count array<long>").toPandas()
    got = got.sort_values(["id", "label"], kind="stable").reset_index(drop=True)
    size = got["term"].map(len).to_numpy(dtype=np.int64) if len(got) else np.zeros(0, np.int64)
    example = np.repeat(np.arange(len(got)), size)
    term = np.concatenate([*got["term"], np.zeros(0)]).astype(np.int64)
    weight = _unit(example, term, np.concatenate([*got["count"], np.zeros(0)]), idf, len(got))
    some = weight > 0
    example, term, weight = example[some], term[some], weight[some]
    labels = got["label"].to_numpy(dtype=np.int64) if len(got) else np.zeros(1, np.int64)
    order = np.lexsort((example, term))
    start = np.searchsorted(term[order], np.arange(len(idf) + 1))
    most = np.zeros((len(idf), -(-max(len(got), 1) // _BLOCK)))
    np.maximum.at(most, (term, example // _BLOCK), weight)
    index = Index(terms, idf, start, example[order], weight[order], most, got["id"].to_numpy() if len(got) else np.zeros(1, np.int64), labels, np.zeros(0), np.zeros(0), 0.0)
    # each example, voted on by the others; a row stands for as many as its label was thinned by
    by_text = np.lexsort((term, example))
    found, cosines = nearest(example[by_text], term[by_text], weight[by_text], len(got), index, k, without=np.arange(len(got)))
    votes = _votes(found, cosines, labels)[: len(got)]
    labels_of = labels[: len(got)]
    thin = np.where(labels_of == 1, sizes.get(1, 0) / n1, sizes.get(0, 0) / n0)
    prior = lambda m: float((thin * labels_of)[m].sum() + 0.5) / float(thin[m].sum() + 5)
    none = votes < 0
    steps, levels = _rising(votes[~none], labels_of[~none], thin[~none])
    return index._replace(steps=steps, levels=levels, prior=prior(none))


def _rising(votes, labels, weights) -> tuple[np.ndarray, np.ndarray]:
    """The best non-falling step function from votes to the share of label 1: pools
    neighbouring values that fall. An end of it stays half an example away from 0 and 1."""
    values, code = np.unique(votes, return_inverse=True)
    pools: list[list[float]] = []
    for v, a, n in zip(values.tolist(), np.bincount(code, weights * labels, len(values)).tolist(), np.bincount(code, weights, len(values)).tolist()):
        pools.append([v, a, n])
        while len(pools) > 1 and pools[-2][1] * pools[-1][2] >= pools[-1][1] * pools[-2][2]:
            last = pools.pop()
            pools[-1][1] += last[1]
            pools[-1][2] += last[2]
    return np.array([p[0] for p in pools]), np.array([(p[1] + 0.05) / (p[2] + 0.1) for p in pools])


def score(docs: DataFrame, index: Index, id_col: str = "doc_id", text_col: str = "text", k: int = 15, evidence: bool = True) -> DataFrame:
    """One row a document: id, score (0 to 1) and, if ``evidence``, an array of the
    nearest examples (example, cosine, label).

    Words and word beginnings of the whole text make a TF-IDF vector; its exact
    ``k`` nearest examples by cosine vote, each with its cosine as weight, and the
    calibrated vote is the score. Only the text is looked at. Null or empty text, or text
    without a term, has the score of such examples, and no evidence. Without
    labelled rows all scores are that of no example, 0.1. No rows give no rows.
    Other columns are ignored, whatever their names."""
    shared = docs.sparkSession.sparkContext.broadcast(index)

    def run(batches):
        index = shared.value
        sieve = _sieve(index.terms)
        for batch in batches:
            at = 0
            for texts in pieces(batch.column(1)):
                own = batch.column(0).slice(at, len(texts))
                at += len(texts)
                text, term, count = _vectors(texts, index.terms, sieve)
                weight = _unit(text, term, count, index.idf, len(texts))
                found, cosines = nearest(text, term, weight, len(texts), index, k)
                votes = _votes(found, cosines, index.labels)
                value = np.full(len(texts), index.prior)
                some = votes >= 0
                if len(index.steps):
                    value[some] = index.levels[np.maximum(np.searchsorted(index.steps, votes[some], side="right") - 1, 0)]
                columns = [own, pa.array(value)]
                if evidence:
                    hit = found >= 0
                    rows = pa.StructArray.from_arrays([pa.array(index.ids[found[hit]]), pa.array(cosines[hit]), pa.array(index.labels[found[hit]].astype(np.int32))], names=["example", "cosine", "label"])
                    columns.append(pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(hit.sum(1))]).astype(np.int32)), rows))
                yield pa.RecordBatch.from_arrays(columns, names=["id", "score", "evidence"][: len(columns)])

    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = source.schema["id"].dataType.simpleString()
    return source.mapInArrow(run, f"id {kind}, score double" + ", evidence array<struct<example: long, cosine: double, label: int>>" * evidence).withColumnRenamed("id", id_col)
