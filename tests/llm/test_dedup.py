"""Exact dedup, the Jaccard join and near-duplicate embeddings against brute force."""

import hashlib
import random
import re
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest

from kestrova.llm import exact_dedup as xd
from kestrova.llm._common import components as smallest
from kestrova.llm.embedding_dedup import cells, decode, embedding_links, roots
from kestrova.llm.exact_dedup import exact_dedup
from kestrova.llm.jaccard_join import _differ, bands, linked, shingle_sets, signatures, sketches

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def documents(spark, rows):
    return spark.createDataFrame([(i, t, 1.0, True, "x") for i, t in rows], "doc_id long, text string, size double, kept boolean, id string")


def components(pairs, ids):
    parent = {i: i for i in ids}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return {i: root(i) for i in ids}


def test_fingerprints_compose():
    rng = random.Random(0)
    texts = ["".join(rng.choice("abcé") for _ in range(n)) for n in (0, 1, 5, 64, 65, 1000)] + [None]
    base, modulus = xd.BASES[0], xd.MODULI[0]
    for chunk in (1, 7, 64, 1 << 16):
        got = xd.fingerprints(pa.array(texts), base, modulus, chunk)
        for text, value in zip(texts, got.tolist()):
            h = 0
            for byte in (text or "").encode():
                h = (h * base + byte) % modulus
            assert value == h
    a, b, c = ((rng.randrange(modulus), rng.randrange(50)) for _ in range(3))
    left = xd.combine(xd.combine(a, b, base, modulus), c, base, modulus)
    assert left == xd.combine(a, xd.combine(b, c, base, modulus), base, modulus)


@pytest.mark.parametrize("moduli", [xd.MODULI, (5, 3)])
def test_exact_dedup(spark, moduli):
    rng = random.Random(1)
    words = ["ab", "a b", "a\tb ", "ba", "", None, " \n", "é", "é", "abcdef" * 50, "abc def" * 50]
    rows = [(i, rng.choice(words) if i % 3 else rng.choice("abcd") * rng.randint(1, 4)) for i in range(120)] + [(500, "only"), (500, "only"), (None, "zz z"), (501, "zzz")]
    plain = lambda t: re.sub(r"[\x20\x09-\x0D]", "", t or "")
    groups = {}
    for i, t in rows:
        groups.setdefault(plain(t), []).append((-len(t or ""), i is not None, i or 0, i))
    got = exact_dedup(documents(spark, rows), moduli=moduli, chunk_chars=7).collect()
    assert len(got) == len(rows)
    by_sha = {hashlib.sha256(k.encode()).hexdigest(): v for k, v in groups.items()}
    for r in got:
        own = by_sha[r.text_sha256]
        assert r.group_size == len(own) and r.keep_id == min(own)[-1]
    assert sum(r.kept for r in got) == len(groups)


def test_exact_dedup_of_nothing(spark):
    assert exact_dedup(documents(spark, [])).collect() == []


def near_copies(rng, groups, size, length, edits):
    vocabulary = [f"w{k}" for k in range(500)]
    rows = []
    for _ in range(groups):
        base = [rng.choice(vocabulary) for _ in range(length)]
        for _ in range(size):
            text = list(base)
            for _ in range(rng.randint(0, edits)):
                text[rng.randrange(len(text))] = rng.choice(vocabulary)
            rows.append(" ".join(text))
    return rows


@pytest.mark.parametrize(("n", "num"), [(3, 90), (5, 80), (1, 70)])
def test_linked(spark, n, num):
    rng = random.Random(n)
    texts = near_copies(rng, 6, 25, 120, 8) + near_copies(rng, 10, 6, 14, 2) + near_copies(rng, 20, 3, 40, 3) + near_copies(rng, 3, 3, 900, 40)
    texts += ["", None, " \n", "one", "ONE", "one two", "One two ", "one two three", "a b c d"]
    rows = list(enumerate(texts)) + [(10**6, texts[0]), (7, texts[7])]
    sets = {}
    for k, (_, t) in enumerate(rows):
        w = WORD.findall((t or "").translate(LOWER))
        sets[k] = {tuple(w)} if 0 < len(w) < n else {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}
    pairs = [(a, b) for a in sets for b in sets if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= num * len(sets[a] | sets[b])]
    part = components(pairs, sets)
    least = {}
    for k, root in part.items():
        least[root] = min(least.get(root, 1 << 60), rows[k][0])
    want = sorted((rows[k][0], len(sets[k]), least[part[k]] if sets[k] else rows[k][0]) for k in sets)
    got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in linked(documents(spark, rows), n, num, 100).collect())
    assert got == want


def test_linked_writes_few_files(spark):
    """Many partitions of a few rows each don't become as many files."""
    rng = random.Random(5)
    rows = []
    for i in range(150):
        text = rng.choices("abcdefghijklmnopqrstuvwxyz", k=40) if i % 3 == 0 else [*text[:-1], str(i)]
        rows.append((i, " ".join(text)))
    folder = Path(spark.conf.get("spark.checkpoint.dir")) / "kestrova"
    before = set(folder.glob("*")) if folder.exists() else set()
    settings = {"spark.sql.shuffle.partitions": "96", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    was = {k: spark.conf.get(k) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        found = linked(documents(spark, rows), 3, 80, 100).collect()
    finally:
        for k, v in was.items():
            spark.conf.set(k, v)
    assert {r.doc_id: r.component_id for r in found} == {i: i - i % 3 for i, _ in rows}
    made = {x.name: len(list(x.glob("part-*"))) for x in set(folder.glob("*")) - before}
    assert {"distinct", "met", "pairs", "sides", "named"} <= {x.rpartition("-")[0] for x in made}
    most = {"distinct": 64, "met": 64}  # 16 a core; of the others, 4 at most
    assert {k: n for k, n in made.items() if n > most.get(k.rpartition("-")[0], 16)} == {}


def test_linked_nothing(spark):
    assert linked(documents(spark, [])).collect() == []
    assert [tuple(r) for r in linked(documents(spark, [(1, None)])).collect()] == [(1, 0, 1)]


def test_similar_sets_share_a_probed_key():
    """The pigeonhole itself, with a large reserve as well."""
    rng = random.Random(3)
    for num in (90, 80, 60):
        texts = near_copies(rng, 5, 12, rng.choice([8, 30, 150]), 6)
        s = shingle_sets(pa.array(texts), 3)
        counts = dict(zip(*[x.tolist() for x in np.unique(s.size, return_counts=True)]))
        plan = bands(counts, num, 100)
        for reserve in (plan.reserve, np.minimum(plan.segments - 1, 5)):
            keys, owner, probes = signatures(s, plan._replace(reserve=reserve), 1)
            held = [(set(keys[owner == k].tolist()), set(keys[(owner == k) & probes].tolist())) for k in range(len(texts))]
            token = [set(s.tokens[s.text == k].tolist()) for k in range(len(texts))]
            for a in range(len(texts)):
                for b in range(a):
                    if token[a] != token[b] and 100 * len(token[a] & token[b]) >= num * len(token[a] | token[b]):
                        assert held[a][1] & held[b][0] or held[b][1] & held[a][0]


def test_sketches_rule_out_unlike_sets_only():
    """Sets of one family that are less alike than asked must not pass as candidates, or these grow with the family's square."""
    rng = random.Random(5)
    for length, edits in ((60, 6), (400, 40), (1800, 160), (9000, 700)):
        s = shingle_sets(pa.array(near_copies(rng, 1, 24, length, edits) + near_copies(rng, 1, 4, length // 4, 3)), 5)
        token, made = [set(s.tokens[s.text == k].tolist()) for k in range(len(s.size))], sketches(s)
        pairs = [(a, b) for a in range(len(token)) for b in range(a)]
        apart = [len(token[a] ^ token[b]) for a, b in pairs]
        differ = _differ([made[a] for a, _ in pairs], [made[b] for _, b in pairs]).tolist()
        assert all(d <= n for d, n in zip(differ, apart))
        like = [len(token[a] & token[b]) / len(token[a] | token[b]) for a, b in pairs]
        passed = [x for (a, b), d, x in zip(pairs, differ, like) if d <= (len(token[a]) + len(token[b])) * 20 // 180]
        assert sum(x >= 0.8 for x in passed) == sum(x >= 0.8 for x in like)
        assert all(x > 0.73 for x in passed) and sum(x < 0.73 for x in like) > 100


@pytest.mark.parametrize("most", [0, 1 << 20])
def test_components(spark, most):
    rng = random.Random(8)
    pairs = [(rng.randrange(200), rng.randrange(200)) for _ in range(120)] + [(k, k + 1) for k in range(300, 360)] + [(400, k) for k in range(401, 440)] + [(5, 5)]
    got = {r.id: r.component for r in smallest(spark.createDataFrame(pairs, "a long, b long").repartition(7), most).collect()}
    want = components([p for p in pairs if p[0] != p[1]], {x for p in pairs if p[0] != p[1] for x in p})
    assert got == want


def test_lattice():
    assert len(roots()) == 240 and np.allclose((roots() ** 2).sum(1), 2)
    x = np.random.default_rng(0).normal(size=(500, 8)) * 3
    y = decode(x)
    assert (((y * 2) % 1) == 0).all() and ((y.sum(1) % 2) == 0).all()
    assert (((x - y) ** 2).sum(1) <= ((x[:, None] - (y[:, None] + roots()[None])) ** 2).sum(2).min(1) + 1e-9).all()
    assert (cells(x @ np.eye(8), 0, 0.5, 3, 1)[:, 1:] != cells(x @ np.eye(8), 0, 0.5, 0, 1)).all()


def test_embedding_links(spark):
    rng = np.random.default_rng(1)
    unit = lambda v: v / np.linalg.norm(v, axis=-1, keepdims=True)
    base = unit(rng.normal(size=(150, 64)))
    near = unit(base[:100] + unit(rng.normal(size=(100, 64))) * rng.uniform(0.02, 0.36, size=(100, 1)))
    crowd = unit(base[:1] + unit(rng.normal(size=(60, 64))) * 0.1)
    vectors = np.concatenate([base, near, crowd, base[:3]]).astype(np.float32)
    rows = [(i, v.tolist()) for i, v in enumerate(vectors)] + [(900, None), (901, []), (902, [0.0] * 64), (903, [float("nan")] * 64), (904, [1.0, None]), (905, [3.0, 4.0]), (906, [6.0, 8.0])]
    got = {r.vec_id: r for r in embedding_links(spark.createDataFrame([(i, v, "x") for i, v in rows], "vec_id long, embedding array<float>, vid string"), block=25).collect()}
    x = unit(vectors.astype(np.float64))
    link = x @ x.T >= 0.95
    np.fill_diagonal(link, False)
    found = sum(got[i].n_links for i in range(len(x)))
    assert found <= link.sum() and found >= 0.97 * link.sum()
    if found == link.sum():
        part = components([(a, b) for a, b in zip(*np.nonzero(link)) if a < b], range(len(x)))
        assert all(got[i].component_id == part[i] and got[i].kept == (part[i] == i) for i in range(len(x)))
    assert [got[i].n_links for i in range(900, 907)] == [0, 0, 0, 0, 0, 1, 1] and got[906].component_id == 905
    none = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert embedding_links(none).collect() == []


@pytest.mark.parametrize("records", [7, 10000])
def test_embedding_links_across_batches(spark, records):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(1, 32)) + rng.normal(size=(90, 32)) * 0.01
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>").repartition(4)
    # many files, so that rows don't meet in the order of their numbers
    held = {"spark.sql.execution.arrow.maxRecordsPerBatch": records, "spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.shuffle.partitions": 9}
    before = {k: spark.conf.get(k) for k in held}
    try:
        for k, v in held.items():
            spark.conf.set(k, v)
        got = embedding_links(frame).collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert [r.n_links for r in got] == [89] * 90 and {r.component_id for r in got} == {0}
