"""Sharding, packing and mixing against brute force."""

import hashlib
import heapq
import random
import zlib
from collections import Counter
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from kestrova.llm.mixing import allocate, mix, share_out
from kestrova.llm.packing import WordTokens, best_fit, pack, token_pieces, word_tokens
from kestrova.llm.queries import tokenizer_path
from kestrova.llm.sharding import schedule, shard

TEXTS = ["hello world", None, "", " \n\t", "don't it's 'tis ''s", "İstanbul ΣΑΣ é é 中文 123 ½", "<|endoftext|> x<|startoftext|>y", "\x1c\x1d\x85\xa0", "word " * 300, "ÀÉ'T ſ ﬁ ª µ", "|a|b|c|" * 40]


def documents(spark, texts):
    return spark.createDataFrame([(i, t, "s", 2) for i, t in enumerate(texts)], "doc_id long, text string, rank string, size int")


def test_schedule_is_the_heap():
    for seed in range(150):
        r = random.Random(seed)
        shards = r.choice([1, 2, 3, 5, 16])
        sizes = sorted(r.sample(range(1, 200), r.randint(1, 12)), reverse=True)
        counts = [r.choice([1, 2, r.randint(1, 300)]) for _ in sizes]
        if r.random() < 0.3:
            sizes, counts = [r.randint(5000, 20000), *sizes], [1, *counts]
        bounds, heap = schedule(sizes, counts, shards), [(0, i) for i in range(shards)]
        for k, (size, count) in enumerate(zip(sizes, counts)):
            got = [0] * shards
            for _ in range(count):
                load, i = heap[0]
                heapq.heapreplace(heap, (load + size, i))
                got[i] += 1
            assert got == np.diff(bounds[k]).tolist()


def test_shard(spark):
    r = random.Random(1)
    texts = [r.choice(["a", "bb", "é" * 9]) if i % 3 else "z" * r.randint(0, 60) for i in range(300)] + [None, ""]
    got = shard(documents(spark, texts), 4).collect()
    assert len(got) == len(texts)
    groups = {}
    for row in got:
        t = texts[row.doc_id] or ""
        assert row.size == len(t.encode()) + 1 and row.text_crc32 == zlib.crc32(t.encode())
        groups.setdefault(t, set()).add(row.shard)
    assert all(len(s) == 1 for s in groups.values())
    for k in range(4):
        assert sorted(row.slot for row in got if row.shard == k) == list(range(sum(row.shard == k for row in got)))
    sizes, heap = Counter(), [(0, i) for i in range(4)]
    for t in texts:
        sizes[t or ""] += len((t or "").encode()) + 1
    for size in sorted(sizes.values(), reverse=True):
        load, i = heap[0]
        heapq.heapreplace(heap, (load + size, i))
    assert sorted(load for load, _ in heap) == sorted(sum(row.size for row in got if row.shard == k) for k in range(4))
    assert shard(documents(spark, [])).collect() == []


def test_best_fit_is_best_fit():
    for seed in range(200):
        r = random.Random(seed)
        capacity = r.choice([10, 37, 64, 100])
        items = [r.randint(1, capacity) if r.random() < 0.7 else r.randint(1, max(1, capacity // 5)) for _ in range(r.randint(0, 150))]
        bins = []
        for size in sorted(items, reverse=True):
            fits = [(left, i) for i, left in enumerate(bins) if left >= size]
            if fits:
                bins[min(fits)[1]] -= size
            else:
                bins.append(capacity - size)
        runs = sorted(Counter(items).items(), reverse=True)
        plan, n = best_fit([a for a, _ in runs], [b for _, b in runs], capacity)
        filled = [0] * n
        for size, low, high, first, each, offset in plan.itertuples(index=False):
            for k in range(high - low):
                assert filled[first + k // each] == offset + k % each * size
                filled[first + k // each] += size
        assert sorted(capacity - f for f in filled) == sorted(bins)


def test_word_tokens_are_the_tokenizers():
    from tokenizers import Tokenizer

    tokenizer, own = Tokenizer.from_file(tokenizer_path()), WordTokens(tokenizer_path(), most=40)
    for _ in range(2):
        ids, ends = own(pa.array(TEXTS))
        for t, a, b in zip(TEXTS, ends[:-1], ends[1:]):
            assert ids[a:b].tolist() == tokenizer.encode(t or "", add_special_tokens=False).ids


def test_pack(spark):
    docs = documents(spark, TEXTS * 3)
    pieces = token_pieces(docs, word_tokens(tokenizer_path()), length=64, end_id=1)
    got = pack(pieces, 64).collect()
    ids, ends = WordTokens(tokenizer_path())(pa.array(TEXTS))
    for i, t in enumerate(TEXTS * 3):
        own = sorted((r for r in got if r.doc_id == i), key=lambda r: r.piece)
        k = i % len(TEXTS)
        assert [v for r in own for v in r.ids] == [*ids[ends[k] : ends[k + 1]].tolist(), 1]
        assert [r.start for r in own] == [64 * j for j in range(len(own))] and all(r.length == len(r.ids) for r in own)
    for s in {r.sequence_id for r in got}:
        at = 0
        for r in sorted((r for r in got if r.sequence_id == s), key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 64
    digest = {(r.doc_id, r.piece): r.ids_crc32 for r in token_pieces(docs, word_tokens(tokenizer_path()), length=64, digest=True).collect()}
    assert digest == {(r.doc_id, r.piece): zlib.crc32(np.array(r.ids, dtype="<u4").tobytes()) for r in got}
    assert pack(token_pieces(documents(spark, []), word_tokens(tokenizer_path())), 64).collect() == []
    with pytest.raises(ValueError):
        pack(pieces, 10)


def test_shortages_go_to_siblings_first():
    tokens = {("a", "x"): 10, ("a", "y"): 100, ("b", "x"): 100}
    got = allocate(tokens, [{}, {}], 120, 1)
    assert got == {("a", "x"): 10, ("a", "y"): 50, ("b", "x"): 60}
    assert allocate(tokens, [{}, {}], 210, 1) == {("a", "x"): 10, ("a", "y"): 100, ("b", "x"): 100}
    assert allocate(tokens, [{"a": 3}, {}], 120, 1) == {("a", "x"): 10, ("a", "y"): 80, ("b", "x"): 30}
    assert allocate({}, [{}], 5, 1) == {}
    assert share_out(Fraction(9), [Fraction(0), Fraction(1)], [Fraction(50), Fraction(4)]) == [0, 4]


@pytest.mark.parametrize("epochs", [1, 3])
def test_mix(spark, epochs):
    r = random.Random(2)
    rows = [(i, " ".join("w" * r.randint(0, 30)), r.choice(["en", "de", None]), r.choice(["s1", "s2"])) for i in range(400)] + [(7, "w w", "en", "s1")] * 2 + [(None, None, "en", "s1"), (900, "", "xx", "s9")]
    docs = spark.createDataFrame([(*x, 5) for x in rows], "doc_id long, text string, lang string, source string, times int")
    got = Counter()
    for x in mix(docs, [F.col("lang"), F.col("source")], [{"en": 2}, {}], 1.3 if epochs > 1 else 0.5, epochs, seed=4).collect():
        got[x.doc_id, x.text, x.lang, x.source] += x.times
    leaves = {}
    for i, t, lang, source in rows:
        leaves.setdefault((lang or "(none)", source), []).append((i, t, lang, source, len((t or "").split())))
    held = {k: sum(x[-1] for x in v) for k, v in leaves.items()}
    budget = allocate(held, [{"en": 2}, {}], int(Fraction("1.3" if epochs > 1 else "0.5") * sum(held.values())), epochs)
    want = Counter()
    for k, own in leaves.items():
        full, rest = divmod(budget[k], held[k]) if held[k] else (epochs, 0)
        key = lambda x: (hashlib.md5(f"4:{full}:{'' if x[0] is None else x[0]}".encode()).hexdigest(), "" if x[0] is None else str(x[0]))  # noqa: B023, E731
        for x in own:
            upto = sum(y[-1] for y in own if key(y) <= key(x))
            times = full + (full < epochs and upto <= rest)
            if times:
                want[x[:4]] += times
    assert got == want
    assert mix(docs.limit(0), [F.col("lang")], [{}], 0.5).collect() == []


def test_results_do_not_depend_on_how_rows_lie(spark):
    r = random.Random(5)
    docs = documents(spark, [" ".join(r.choice(["a", "bb", "ccc"]) for _ in range(r.randint(0, 12))) for _ in range(400)])
    packed = lambda d: pack(token_pieces(d, word_tokens(tokenizer_path()), length=8, digest=True), 8)
    for op in (lambda d: shard(d, 5), packed):
        a, b = (sorted(map(tuple, op(d).collect())) for d in (docs.repartition(3), docs.orderBy(F.desc("doc_id")).repartition(7, "text")))
        assert a == b
    same = documents(spark, ["x y"]).crossJoin(spark.range(200).withColumnRenamed("id", "n")).drop("n")
    got = shard(same, 3).collect()
    assert sorted(row.slot for row in got) == list(range(200)) and len({row.shard for row in got}) == 1


def test_packing_takes_no_more_sequences_than_best_fit(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    got = pack(token_pieces(docs, word_tokens(tokenizer_path()), digest=True)).collect()
    bins = []
    for size in sorted((row.length for row in got), reverse=True):
        fits = [(left, i) for i, left in enumerate(bins) if left >= size]
        if fits:
            bins[min(fits)[1]] -= size
        else:
            bins.append(4096 - size)
    assert len({row.sequence_id for row in got}) == len(bins)
