"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .embedding_dedup import embedding_links
from .exact_dedup import exact_dedup
from .jaccard_join import linked
from .langid import identify, train
from .lm_score import pseudo_likelihood, train_network
from .mixing import mix, word_count
from .packing import pack, token_pieces, word_tokens
from .secrets import scan, train_scanner
from .sharding import shard
from .toxicity import build, score


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def held_out() -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))


def op1_lattice_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_links(_table(spark, sf_dir, "embeddings"), threshold=0.95)


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    labels = _table(spark, sf_dir, "labels").filter(~held_out()).select("doc_id", "toxic")
    index = build(docs, labels, max_examples=3000)
    scored = score(docs, index, evidence=False)
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = train(docs.filter(~held_out()), max_docs=4000, by=F.col("doc_id"))
    return identify(docs, model, spans=False).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


def mixture() -> dict:
    """The production tree: domains of five sources each, languages, sources."""
    domain = F.concat(F.lit("d"), F.floor(F.regexp_extract("source", r"(\d+)", 1).try_cast("int") / 5).cast("string"))
    return {"levels": [domain, F.col("lang"), F.col("source")], "weights": [{"d0": 4, "d1": 3, "d2": 2, "d3": 1}, {"en": 5, "de": 2, "fr": 2, "es": 1}, {}]}


def op4_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    used = mix(_table(spark, sf_dir, "documents"), **mixture(), budget_share=0.6, max_epochs=2, seed=17)
    return used.select("doc_id", mixture()["levels"][0].alias("domain"), "lang", "source", word_count(F.col("text")).alias("tokens"), "times")


def op5_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linked(_table(spark, sf_dir, "documents"), words_each=3, num=90, den=100)


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = shard(_table(spark, sf_dir, "documents"), shards=16)
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = token_pieces(_table(spark, sf_dir, "documents"), word_tokens(tokenizer_path()), length=4096, end_id=1, digest=True)
    return pack(pieces, capacity=4096)


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(_table(spark, sf_dir, "documents"))


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    found = scan(docs, train_scanner(docs), threshold=0.5)
    return found.select("doc_id", "n_candidates", F.size("findings").alias("n_findings"), "findings")


def op10_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return pseudo_likelihood(docs, train_network(docs))


QUERIES = {f.__name__: f for f in (op1_lattice_near_dedup, op2_toxicity, op3_language_id, op4_source_mixing, op5_ngram_jaccard_join, op6_sharding, op7_best_fit_packing, op8_exact_dedup, op9_secret_scan, op10_lm_scoring)}

_REACH = """e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
        r AS (SELECT a AS id, a AS root FROM e UNION SELECT e.b, r.root FROM r JOIN e ON e.a = r.id),
        c AS (SELECT id, min(root) AS root FROM r GROUP BY id)"""


def _filled(source: str, parent: str, weight: str) -> str:
    """SQL that shares each parent's budget by weights under caps: children are full
    in order of cap / weight until one isn't; from there on all get the same rate."""
    return f"""(SELECT *, CASE WHEN rate IS NULL THEN cap ELSE least(cap, w * rate) END AS given FROM (
            SELECT *, first_value(CASE WHEN cap / w > lam THEN lam END IGNORE NULLS) OVER (PARTITION BY {parent} ORDER BY cap / w ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS rate FROM (
            SELECT *, (budget - coalesce(sum(cap) OVER (PARTITION BY {parent} ORDER BY cap / w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / sum(w) OVER (PARTITION BY {parent} ORDER BY cap / w ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS lam
            FROM (SELECT *, {weight} AS w FROM {source}))))"""


ORACLE_SQL = {
    "op1_lattice_near_dedup": f"""
        WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS x FROM embeddings),
        l AS (SELECT p.vec_id AS a, q.vec_id AS b FROM v p JOIN v q ON p.vec_id < q.vec_id WHERE list_cosine_similarity(p.x, q.x) >= 0.95),
        {_REACH}
        SELECT vec_id, (SELECT count(*) FROM e WHERE e.a = vec_id) AS n_links, coalesce(root, vec_id) AS component_id, coalesce(root, vec_id) = vec_id AS kept
        FROM embeddings LEFT JOIN c ON c.id = vec_id""",
    "op4_source_mixing": f"""
        WITH d AS (SELECT doc_id, 'd' || CAST(floor(CAST(regexp_extract(source, '(\\d+)', 1) AS INT) / 5) AS INT) AS domain, lang, source, len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')) AS tokens FROM documents),
        leaf AS (SELECT domain, lang, source, sum(tokens) AS t FROM d GROUP BY ALL),
        one AS (SELECT domain, 2 * sum(t) AS cap, (SELECT floor(0.6 * sum(t)) FROM leaf) AS budget FROM leaf GROUP BY domain),
        domains AS {_filled("one", "true", "CASE domain WHEN 'd0' THEN 4 WHEN 'd1' THEN 3 WHEN 'd2' THEN 2 ELSE 1 END")},
        two AS (SELECT leaf.domain, lang, 2 * sum(t) AS cap, any_value(given) AS budget FROM leaf JOIN domains USING (domain) GROUP BY leaf.domain, lang),
        langs AS {_filled("two", "domain", "CASE lang WHEN 'en' THEN 5 WHEN 'es' THEN 1 ELSE 2 END")},
        three AS (SELECT leaf.domain, leaf.lang, source, t, 2 * t AS cap, given AS budget FROM leaf JOIN langs USING (domain, lang)),
        sources AS {_filled("three", "domain, lang", "1")},
        plan AS (SELECT domain, lang, source, CASE WHEN t = 0 THEN 2 ELSE floor(floor(given + 1e-6) / t) END AS whole, CASE WHEN t = 0 THEN 0 ELSE floor(given + 1e-6) % t END AS rest FROM sources),
        k AS (SELECT d.*, CAST(whole AS INT) AS whole, rest, md5('17:' || CAST(whole AS INT) || ':' || doc_id) AS key FROM d JOIN plan USING (domain, lang, source)),
        u AS (SELECT *, sum(tokens) OVER (PARTITION BY domain, lang, source ORDER BY key, CAST(doc_id AS VARCHAR)) AS upto FROM k)
        SELECT doc_id, domain, lang, source, tokens, CAST(whole + CASE WHEN whole < 2 AND upto <= rest THEN 1 ELSE 0 END AS INT) AS times
        FROM u WHERE whole > 0 OR upto <= rest""",
    "op5_ngram_jaccard_join": f"""
        WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
        s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 3 THEN list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i + 2], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] END) AS g FROM w),
        n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
        p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY ALL),
        l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * p.c >= 90 * (x.n + y.n - p.c)),
        {_REACH}
        SELECT doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(root, doc_id) AS component_id
        FROM documents LEFT JOIN n USING (doc_id) LEFT JOIN c ON c.id = doc_id""",
    "op8_exact_dedup": r"""
        WITH d AS (
            SELECT doc_id, length(coalesce(text, '')) AS chars,
                   sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256
            FROM documents),
        g AS (
            SELECT doc_id, text_sha256,
                   first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY chars DESC, doc_id) AS keep_id,
                   count(*) OVER (PARTITION BY text_sha256) AS group_size
            FROM d)
        SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM g""",
}
