"""Language ID, toxicity, secrets and LM scoring: exactness of the parts, held-out accuracy, edges."""

import math
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from kestrova.llm import langid, lm_score, secrets, toxicity
from kestrova.llm.queries import held_out
from kestrova.llm.textvec import hashes, pieces, words

EDGES = [(1, None), (2, ""), (3, " \n\t"), (4, "123 | --- 5"), (5, "é" * 10), (6, "x" * 20000), (7, "the " * 5000)]


def edges(spark):
    return spark.createDataFrame([(i, t, "c", 1, 2.0) for i, t in EDGES] + [(7, EDGES[-1][1], "c", 1, 2.0)], "doc_id long, text string, lang_pred string, id int, score double")


@pytest.fixture(scope="module")
def docs(spark, small):
    return spark.read.parquet(f"{small.replace('0.001', '0.01')}/documents.parquet")


def test_words():
    texts = pa.array(["a  Bc\x1f\t", None, "", "É é", "x"])
    w = words(texts)
    assert [bytes(w.data[a:b]).decode() for a, b in zip(w.start, w.end)] == ["a", "bc\x1f", "É", "é", "x"] and w.text.tolist() == [0, 0, 3, 3, 4]
    assert len(set(hashes(w).tolist())) == 5
    big = pa.array(["ab" * 5, "c", None, "d" * 50])
    assert [x for p in pieces(big, 8) for x in p.to_pylist()] == big.to_pylist() and list(pieces(pa.array([], type=pa.string()))) == []
    assert words(pa.array(["z", "a b"]).slice(1)).text.tolist() == [0, 0]


def test_viterbi_is_the_best_path():
    rng = np.random.default_rng(0)
    for _ in range(30):
        n, sizes = int(rng.integers(1, 5)), rng.integers(0, 40, 6).tolist()
        text = np.repeat(np.arange(6), sizes)
        score = -rng.random((len(text), n)).astype(np.float32) * 6
        way = langid.viterbi(score, text, 6, 3.0, chunk=int(rng.integers(1, 15)))
        for t in range(6):
            own, path = score[text == t].astype(float), way[text == t]
            if not len(own):
                continue
            best = own[0].copy()
            for row in own[1:]:
                best = np.maximum(best, best.max() - 3.0) + row
            assert own[np.arange(len(own)), path].sum() - 3.0 * (np.diff(path) != 0).sum() == pytest.approx(best.max(), abs=1e-3)


def test_languages_held_out(spark, docs):
    model = langid.train(docs.filter(~held_out()), by=F.col("doc_id"))
    got = langid.identify(docs.filter(held_out()), model, carry=["lang"]).collect()
    assert np.mean([r.lang == r.lang_pred for r in got]) > 0.98
    assert all(0 <= r.score <= 1 for r in got)
    both = {r.lang: r.text for r in docs.filter("length(text) > 900").limit(200).collect()}
    mixed = spark.createDataFrame([(1, both["en"][:800] + " " + both["de"][:800])], "doc_id long, text string")
    r = langid.identify(mixed, model).first()
    assert [s.lang for s in r.spans] == ["en", "de"] and abs(r.spans[1].start - 800) < 40
    out = {x.doc_id: x for x in langid.identify(edges(spark), model).collect()}
    assert [out[i].lang_pred for i in (1, 2, 3, 4)] == ["und"] * 4 and out[1].score == 0 and out[1].spans == []
    assert langid.identify(edges(spark), model).count() == len(EDGES) + 1 and langid.identify(edges(spark).limit(0), model).collect() == []
    nothing = langid.train(docs.limit(0))
    assert langid.identify(edges(spark), nothing).filter("lang_pred <> 'und'").count() == 0


def test_scripts_narrow_languages(spark):
    rows = [("en", "the cat sat on the mat")] * 5 + [("ru", "кот сидел на ковре")] * 5 + [("el", "η γάτα κάθισε στο χαλί")] * 5
    model = langid.train(spark.createDataFrame(rows, "lang string, text string"))
    asked = spark.createDataFrame([(1, "собака"), (2, "σκύλος"), (3, "dog"), (4, "猫")], "doc_id long, text string")
    got = {r.doc_id: r.lang_pred for r in langid.identify(asked, model).collect()}
    assert (got[1], got[2], got[3]) == ("ru", "el", "en") and got[4] in ("en", "ru", "el")


def test_nearest_examples_are_exact():
    rng = np.random.default_rng(1)
    for _ in range(20):
        v, n, d = 20, 300, 30
        e, q = (x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9) for x in (rng.random((k, v)) * (rng.random((k, v)) < 0.2) for k in (n, d)))
        term, example = np.nonzero(e.T)
        weight = e[example, term]
        most = np.zeros((v, -(-n // 64)))
        np.maximum.at(most, (term, example // 64), weight)
        index = toxicity.Index(np.arange(v, dtype=np.uint64), np.ones(v), np.searchsorted(term, np.arange(v + 1)), example, weight, most, np.arange(n), np.zeros(n, int), np.zeros(0), np.zeros(0), 0.0)
        text, term = np.nonzero(q)
        found, cosines = toxicity.nearest(text, term, q[text, term], d, index, 7)
        assert np.allclose(-np.sort(-(q @ e.T), axis=1)[:, :7], cosines)
        assert np.allclose((q[:, None, :] * e[found]).sum(2)[found >= 0], cosines[found >= 0])


def test_toxicity(spark, docs, small):
    labels = spark.read.parquet(f"{small.replace('0.001', '0.01')}/labels.parquet")
    index = toxicity.build(docs, labels.filter(~held_out()).select("doc_id", "toxic"))
    got = toxicity.score(docs.join(labels, "doc_id").select("doc_id", "text"), index).join(labels, "doc_id").withColumn("held", held_out()).collect()
    own = [r for r in got if not r.held]
    assert np.mean([(r.score >= 0.3) == r.toxic for r in own]) > 0.95
    said = [r for r in got if r.held and r.score >= 0.3]
    assert len(said) >= 5 and np.mean([r.toxic for r in said]) > 0.8
    assert all(0 <= r.score <= 1 for r in got) and all(0 < e.cosine <= 1 + 1e-9 for r in got for e in r.evidence)
    out = {r.doc_id: r.score for r in toxicity.score(edges(spark), index).collect()}
    assert out[1] == out[2] == out[3] == pytest.approx(index.prior)
    none = toxicity.build(docs.limit(0), labels.limit(0).select("doc_id", "toxic"))
    assert toxicity.score(edges(spark), none).count() == len(EDGES) + 1


def test_forest_learns():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(800, 5))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0.3)).astype(float)
    f = secrets.fit_forest(x[:600], y[:600], trees=30, depth=7)
    assert np.mean((f(x[600:]) >= 0.5) == y[600:]) > 0.85


def test_secrets(spark, docs):
    scanner = secrets.train_scanner(docs)
    r = random.Random(3)
    hexa = lambda n: "".join(r.choice("0123456789abcdef") for _ in range(n))
    base = [x.text for x in docs.limit(60).collect()]
    rows, want = [], {}
    for i, t in enumerate(base):
        value = [hexa(18), "AKIA" + "".join(r.choice("ABCDEFGHJK234567") for _ in range(16)), hexa(40)][i % 3]
        plain = i % 2 == 0
        put = f"commit {hexa(40)}" if plain else [f"password={value}", value, f'token = "{value}"'][i % 3]
        rows.append((i, f"{t[:200]} {put} é {t[200:400]}"))
        want[i] = set() if plain else {value}
    asked = {i: t for i, t in rows}
    got = {x.doc_id: x for x in secrets.scan(spark.createDataFrame(rows, "doc_id long, text string"), scanner).collect()}
    hits = sum(len(want[i] & {f.value for f in got[i].findings}) for i in asked)
    false = sum(len({f.value for f in got[i].findings if f.value in asked[i].split("commit ")[-1][:40]}) for i in asked if i % 2 == 0)
    assert hits >= 0.9 * sum(map(len, want.values())) and false <= 3
    assert all(asked[i][f.start : f.end] == f.value for i in asked for f in got[i].findings)
    out = {x.doc_id: x for x in secrets.scan(edges(spark), scanner).collect()}
    assert all(out[i].findings == [] for i in (1, 2, 3, 4, 5)) and out[6].n_candidates == 1


def test_log_probabilities_sum_to_one():
    rng = np.random.default_rng(4)
    n, width = lm_score._SIZE, 4
    net = lm_score.Network(np.zeros(0, np.uint64), np.zeros(0, np.int64), *(rng.normal(size=s).astype(np.float32) for s in ((n + 1, width), (4, width, width), (width,), (width, 64), (64,), (64, width, 64), (64, 64))))
    around = np.repeat(rng.integers(0, n + 1, (1, 4)), n, axis=0)
    assert np.exp(lm_score.log_probabilities(net, np.arange(n), around)).sum() == pytest.approx(1, abs=1e-3)


def test_gradient_is_the_slope():
    rng = np.random.default_rng(5)
    width = 3
    net = lm_score.Network(np.zeros(0, np.uint64), np.zeros(0, np.int64), *((rng.normal(size=s) * 0.3).astype(np.float32) for s in ((lm_score._SIZE + 1, width), (4, width, width), (width,), (width, 64), (64,), (64, width, 64), (64, 64))))
    ids, around = rng.integers(0, 300, 64), rng.integers(0, 300, (64, 4))
    before = lm_score.log_probabilities(net, ids, around).mean()
    heavy = net._replace(rare=2.0)
    assert np.allclose(lm_score.log_probabilities(heavy, ids + 3800, around) - lm_score.log_probabilities(net, ids + 3800, around), np.where(ids + 3800 >= lm_score._KNOWN, -2.0, 0))
    memory = {}
    for _ in range(30):
        net = lm_score._learn(net, ids, around, memory, 0.1)
    assert lm_score.log_probabilities(net, ids, around).mean() > before + 1


def test_scores(spark, docs):
    net = lm_score.train_network(docs, share=0.4, rounds=2)
    real = [r.text for r in docs.filter("lang = 'en' and n_chars between 500 and 3000").limit(40).collect()]
    r = random.Random(6)
    mixed = [" ".join(r.sample(t.split(), len(t.split()))) for t in real]
    odd = [" ".join("".join(r.choice("qxzjk") for _ in range(5)) for _ in t.split()) for t in real]
    frame = spark.createDataFrame(list(enumerate(real + mixed + odd)), "doc_id long, text string")
    got = {x.doc_id: x for x in lm_score.pseudo_likelihood(frame, net).collect()}
    mean = lambda low: np.mean([got[i].per_token for i in range(low, low + 40)])
    assert mean(0) > mean(40) > mean(80) and all(x.log_likelihood == pytest.approx(x.per_token * x.n_tokens) for x in got.values())
    out = {x.doc_id: x for x in lm_score.pseudo_likelihood(edges(spark), net).collect()}
    assert (out[1].n_tokens, out[1].log_likelihood, out[1].per_token) == (0, 0.0, None) and out[7].n_tokens == 5000
    assert math.isfinite(out[7].log_likelihood)
    empty = lm_score.train_network(docs.limit(0), rounds=1)
    assert lm_score.pseudo_likelihood(edges(spark), empty).count() == len(EDGES) + 1


def test_short_and_punctuated_secrets(spark, docs):
    scanner = secrets.train_scanner(docs)
    prose = [t for x in docs.filter("lang = 'en' and n_chars > 300").limit(12).collect() for t in [x.text[:150]]]
    planted = [('password = "Summer2024!"', "Summer2024!"), ("DB_PASS=hunter2xyz", "hunter2xyz"), ("api_key=9f8e7d6c5b", "9f8e7d6c5b"), ('{"pwd": "p@ssW0rd#99!qZ"}', "p@ssW0rd#99!qZ")]
    rows = [(i, f"{t} {planted[i % 4][0]} {t}") for i, t in enumerate(prose)]
    got = {x.doc_id: x.findings for x in secrets.scan(spark.createDataFrame(rows, "doc_id long, text string"), scanner).collect()}
    assert sum(planted[i % 4][1] in {f.value for f in got[i]} for i, _ in rows) >= 0.9 * len(rows)
    assert all(t[f.start : f.end] == f.value for i, t in rows for f in got[i])


def test_dictionary_does_not_depend_on_the_number_of_copies(spark, docs):
    few = docs.limit(100).select("text")
    many = few.crossJoin(spark.range(30).select("id")).select("text")
    a, b = (secrets.train_scanner(x, findings=(["a password=1f9Kq7Lz0"], [1])).dictionary for x in (few, many))
    assert a.any() and (a == b).all()
    long = spark.createDataFrame([("a" * 30 + "bcde",)], "text string")
    data = np.frombuffer(b"bcde", dtype=np.uint8)
    gram, _ = secrets._grams(data, np.array([0]), np.array([4]))
    assert secrets.train_scanner(long, findings=(["a password=1f9Kq7Lz0"], [1])).dictionary[gram].all()


def test_training_covers_all_documents(spark, monkeypatch):
    texts = spark.createDataFrame([(f"a{i} b{i} c",) for i in range(200)], "text string")
    seen, real = [], type(texts).mapInArrow

    def mapped(self, function, schema, *a, **k):
        if function.__name__ == "train":
            seen.extend(r.text for r in self.collect())
        return real(self, function, schema, *a, **k)

    monkeypatch.setattr(type(texts), "mapInArrow", mapped)
    lm_score.train_network(texts)
    assert sorted(seen) == sorted(f"a{i} b{i} c" for i in range(200))


def test_words_out_of_the_vocabulary_share_by_count(spark, monkeypatch):
    assert lm_score.side_of(10**8) > lm_score.side_of(10**7) > lm_score.side_of(1000) == 64
    texts = [f"w{i} w{i} w{i} w{i} w{i}" for i in range(5000)] + ["few few few", "once"]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    asked = spark.createDataFrame(list(enumerate(["few", "once", "never"])), "doc_id long, text string")
    for head in (1 << 18, 0):  # counts that are broadcast, or joined
        monkeypatch.setattr(lm_score, "_HEAD", head)
        net = lm_score.train_network(frame, width=4, rounds=0)
        assert (net.tail is None) == (head > 0)
        got = {r.doc_id: r for r in lm_score.pseudo_likelihood(asked, net).collect()}
        number = hashes(words(pa.array(["few", "once"]))) >> np.uint64(40)
        bias = net.word_bias[-1][(number % np.uint64(net.to_word.shape[2])).astype(int)] - net.rare[(number % np.uint64(net.to_word.shape[2])).astype(int)]
        assert got[0].log_likelihood - got[1].log_likelihood == pytest.approx(bias[0] - bias[1] + math.log(3), abs=1e-4)
        assert all(r.per_token == r.log_likelihood and r.n_tokens == 1 for r in got.values())


def test_gradient_by_differences():
    """The first step of Adagrad goes by the gradient's signs; its squares are in the memory."""
    rng = np.random.default_rng(7)
    width, size = 3, lm_score._SIZE
    net = lm_score.Network(np.zeros(0, np.uint64), np.zeros(0, np.int64), *((rng.normal(size=s) * 0.3) for s in ((size + 1, width), (4, width, width), (width,), (width, 64), (64,), (64, width, 64), (64, 64))))
    ids, around = rng.integers(0, 200, 50), rng.integers(0, 200, (50, 4))
    loss = lambda n: -lm_score.log_probabilities(n, ids, around).mean()
    memory = {}
    after = lm_score._learn(net, ids, around, memory, 1e-3)
    for name, at in (("embed", (around[3, 1], 1)), ("mix", (2, 0, 1)), ("base", (2,)), ("to_class", (1, ids[0] // 64)), ("class_bias", (ids[5] // 64,)), ("to_word", (ids[2] // 64, 0, ids[2] % 64)), ("word_bias", (ids[9] // 64, ids[9] % 64))):
        moved = []
        for step in (1e-5, -1e-5):
            x = getattr(net, name).copy()
            x[at] += step
            moved.append(loss(net._replace(**{name: x})))
        slope = (moved[0] - moved[1]) / 2e-5
        assert np.sqrt(memory[name][at]) == pytest.approx(abs(slope), rel=1e-3, abs=2e-4), name
        assert np.sign(getattr(after, name)[at] - getattr(net, name)[at]) == -np.sign(slope)


def test_scores_by_a_plain_loop(spark):
    texts = ["a b c a b", "b a d c", "", "a", "e f g a b c d"]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    net = lm_score.train_network(frame, width=4)
    softmax = lambda x: np.exp(x - x.max()) / np.exp(x - x.max()).sum()
    known = dict(zip(net.terms.tolist(), net.number.tolist()))
    for r in lm_score.pseudo_likelihood(frame, net).collect():
        w = texts[r.doc_id].split()
        number = [known[h] for h in hashes(words(pa.array([" ".join(w)]))).tolist()] if w else []
        total = 0.0
        for i in range(len(w)):
            around = [number[j] if 0 <= j < len(w) else len(net.embed) - 1 for j in (i - 2, i - 1, i + 1, i + 2)]
            h = np.tanh(sum(net.embed[a].astype(float) @ net.mix[k] for k, a in enumerate(around)) + net.base)
            c, k = divmod(number[i], net.to_word.shape[2])
            total += math.log(softmax(h @ net.to_class + net.class_bias)[c]) + math.log(softmax(h @ net.to_word[c] + net.word_bias[c])[k])
        assert r.log_likelihood == pytest.approx(total, abs=1e-3) and r.n_tokens == len(w)


class Counted(np.ndarray):
    """Counts the values that pass through ufuncs but matrix products."""

    seen = 0

    def __array_ufunc__(self, ufunc, method, *inputs, out=(), **k):
        plain = lambda xs: tuple(np.asarray(x) if isinstance(x, Counted) else x for x in xs)
        got = getattr(ufunc, method)(*plain(inputs), **({"out": plain(out)} if out else {}), **k)
        if ufunc is not np.matmul:
            Counted.seen += max(np.size(x) for x in (*inputs, got))
        return out[0] if out else np.asarray(got).view(Counted)


class CountingNumpy:
    """numpy, whose new arrays are counted."""

    def __getattr__(self, name):
        made = getattr(np, name)
        return (lambda *a, **k: made(*a, **k).view(Counted)) if name in {"empty", "ones", "zeros", "empty_like", "zeros_like", "concatenate"} else made


def _random_network(rng, width=16, scale=0.3):
    shapes = ((lm_score._SIZE + 1, width), (4, width, width), (width,), (width, 64), (64,), (64, width, 64), (64, 64))
    return lm_score.Network(np.zeros(0, np.uint64), np.zeros(0, np.int64), *((rng.normal(size=s) * scale).astype(np.float32) for s in shapes))


def test_a_step_passes_each_value_once(monkeypatch):
    """Of each word 128 values of softmaxes: an exp of each, and little beside; the weights' own update is counted with it."""
    monkeypatch.setattr(lm_score, "np", CountingNumpy())
    rng = np.random.default_rng(8)
    net = _random_network(rng)
    ids, around = rng.integers(0, lm_score._SIZE, 8192), rng.integers(0, lm_score._SIZE, (8192, 4))
    counted = net._replace(**{k: getattr(net, k).view(Counted) for k in lm_score._WEIGHTS})
    Counted.seen = 0
    lm_score._learn(counted, ids, around, {}, 0.1)
    assert 128 < Counted.seen / len(ids) < 600
    Counted.seen = 0
    lm_score.log_probabilities(counted, ids, around)
    assert 128 < Counted.seen / len(ids) < 200


def test_softmaxes_beyond_the_range_of_exp():
    rng = np.random.default_rng(9)
    net, ids, around = _random_network(rng), rng.integers(0, 4096, 3000), rng.integers(0, 4096, (3000, 4))
    for shift, scale in ((0, 60), (300, 1), (-300, 1)):
        far = net._replace(to_class=net.to_class * scale, class_bias=net.class_bias + np.float32(shift), to_word=net.to_word * scale, word_bias=net.word_bias + np.float32(shift))
        wide = far._replace(**{k: getattr(far, k).astype(np.float64) for k in lm_score._WEIGHTS})
        h = np.tanh(sum(wide.embed[around[:, k]] @ wide.mix[k] for k in range(4)) + wide.base)
        share = lambda x, at: x[np.arange(len(x)), at] - x.max(1) - np.log(np.exp(x - x.max(1, keepdims=True)).sum(1))
        want = share(h @ wide.to_class + wide.class_bias, ids // 64) + share(np.einsum("ri,rij->rj", h, wide.to_word[ids // 64]) + wide.word_bias[ids // 64], ids % 64)
        assert np.allclose(lm_score.log_probabilities(far, ids, around), want, rtol=1e-4, atol=2e-3)
        memory, exact = {}, {}
        step = lm_score._learn(far, ids, around, memory, 0.1)
        lm_score._learn(wide, ids, around, exact, 0.1)
        for k in lm_score._WEIGHTS:
            assert np.isfinite(getattr(step, k)).all()
            assert np.allclose(np.sqrt(memory[k]), np.sqrt(exact[k]), rtol=1e-2, atol=1e-3 * np.sqrt(exact[k]).max() + 1e-5), k


def test_places_are_those_of_a_search():
    rng = np.random.default_rng(10)
    near = np.uint64(7 << 40) + rng.integers(0, 300, 200, dtype=np.uint64)  # all begin alike
    for terms in (np.zeros(0, np.uint64), np.unique(np.append(near, rng.integers(0, 1 << 64, 3000, dtype=np.uint64))), np.array([0, 2**64 - 1], np.uint64)):
        asked = np.concatenate([terms, near, rng.integers(0, 1 << 64, 3000, dtype=np.uint64), np.array([0, 1, 2**64 - 2, 2**64 - 1], np.uint64)])
        place, there = lm_score._Places(terms).find(asked)
        assert (place == np.searchsorted(terms, asked)).all() and (there == np.isin(asked, terms)).all()
    texts = pa.array(["b a", None, "", "c " * 200_000, "d  e"]).slice(1)
    h, text = lm_score._hashed(texts)
    w = words(texts)
    assert (h == hashes(w)).all() and (text == w.text).all() and len(lm_score._hashed(texts.slice(0, 0))[0]) == 0
