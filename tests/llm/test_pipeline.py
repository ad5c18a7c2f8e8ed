"""The pipeline's stages, each against plain Python, and its queries against DuckDB."""

import glob
import os
import re

import duckdb
import pytest

import corpus_pipeline as cp
from kestrova.llm.queries import ORACLE_SQL, QUERIES


@pytest.fixture(scope="module")
def documents(spark, small):
    rows = [tuple(r) for r in spark.read.parquet(f"{small}/documents.parquet").collect()]
    first = rows[0]
    rows += [first, first, (900001, None, "en", "src1", 0), (900002, "12 34 |", "en", "src1", 7), (900003, first[1] + " ", first[2], first[3], first[4] + 1)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")


def test_stages(spark, small, documents, tmp_path):
    now, names = documents, [n for n, _ in cp.STAGES]
    assert names == ["language ID", "exact dedup", "n-gram Jaccard join", "mixing", "packing"]
    seen = []
    for k, (_, stage) in enumerate(cp.STAGES):
        stage(spark, now, small).write.parquet(str(tmp_path / str(k)))
        now = spark.read.parquet(str(tmp_path / str(k)))
        seen.append(now.toPandas())
        if k < 4:
            assert now.columns == documents.columns
    before = documents.toPandas()
    lettered = before[[bool(t) and any(c.isalpha() for c in t) for t in before.text]]
    assert sorted(seen[0].doc_id) == sorted(lettered.doc_id)
    plain = lambda t: re.sub(r"[\x20\x09-\x0D]", "", t)
    assert len(seen[1]) == seen[0].text.map(plain).nunique() == seen[1].text.map(plain).nunique()
    sets = {r.doc_id: {tuple(w[i : i + 5]) for w in [re.findall(r"[^\x20\x09-\x0D]+", r.text.lower())] for i in range(max(len(w) - 4, 1))} for r in seen[1].itertuples()}
    kept = set(seen[2].doc_id)
    like = lambda a, b: 10 * len(sets[a] & sets[b]) >= 8 * len(sets[a] | sets[b])
    assert not any(like(a, b) for a in kept for b in kept if a < b)
    assert all(any(like(a, b) for b in sets if b != a) for a in set(sets) - kept)
    words = lambda f: f.text.str.split().map(len).sum()
    assert 0.6 * words(seen[2]) < words(seen[3]) <= 0.8 * words(seen[2]) and set(seen[3].doc_id) <= kept
    last = seen[4]
    assert set(last.doc_id) == set(seen[3].doc_id) and last.groupby("sequence_id").length.sum().max() <= 4096


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_queries_match_sql(spark, small, name):
    from test_oracle import same

    con = duckdb.connect()
    for path in glob.glob(f"{small}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS FROM '{path}'")
    same(QUERIES[name](spark, small).toPandas(), con.execute(ORACLE_SQL[name]).df())


def test_run_goes_on_and_cleans_up(spark, small, tmp_path, monkeypatch):
    folder = f"file://{tmp_path}/run"
    real = cp.STAGES[3][1]

    def lost(*args):
        raise RuntimeError("the driver is lost")

    monkeypatch.setattr(cp, "STAGES", [*cp.STAGES[:3], ("mixing", lost), cp.STAGES[4]])
    with pytest.raises(RuntimeError):
        cp.run(spark, small, folder)
    assert sorted(os.listdir(tmp_path / "run")) == ["2"]
    ran = []
    monkeypatch.setattr(cp, "STAGES", [(n, lambda *a, f=f, n=n: ran.append(n) or f(*a)) for n, f in [*cp.STAGES[:3], ("mixing", real), cp.STAGES[4]]])
    out = cp.run(spark, small, folder)
    assert ran == ["mixing", "packing"] and out.count() > 0 and sorted(os.listdir(tmp_path / "run")) == ["4"]
    assert cp._made.get() == []
