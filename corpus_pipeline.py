"""From raw documents to packed training sequences.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last
return the columns of documents.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from contextvars import ContextVar
from functools import wraps

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kestrova.llm._common import delete, delete_on_exit, exists, release, scratch, shared_folder, small, thrifty, written
from kestrova.llm.exact_dedup import exact_dedup
from kestrova.llm.jaccard_join import linked
from kestrova.llm.langid import identify, train
from kestrova.llm.mixing import mix
from kestrova.llm.packing import pack, token_pieces, word_tokens
from kestrova.llm.queries import held_out, mixture, tokenizer_path


#: The tables that the stage before made; each thread that runs stages has its own.
_made: ContextVar[list | None] = ContextVar("made", default=None)


def _stage(function: Callable) -> Callable:
    """Deletes the tables that the stage before made: its result has been written."""

    @wraps(function)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        release(_made.get() or [])
        with scratch() as made:
            out = function(spark, docs, sf_dir)
        _made.set(made)
        return out

    return run_stage


@_stage
def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Labels each document with the language it is in, and drops those in none:
    null texts and texts without letters. The label replaces column lang."""
    columns = docs.columns
    model = train(docs.filter(~held_out()), max_docs=4000, by=F.col("doc_id"))
    found = identify(docs, model, spans=False, carry=[c for c in columns if c not in ("doc_id", "lang")])
    return found.filter("lang_pred <> 'und'").withColumnRenamed("lang_pred", "lang").select(*columns)


@_stage
def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one of the documents whose texts are equal but for white space."""
    row = F.struct("doc_id", F.xxhash64("text").alias("hash"))
    rows = exact_dedup(docs.select(row.alias("row"), "text"), id_col="row").groupBy("row").agg(F.bool_or("kept").alias("kept"), F.count("*").alias("n"))
    rows = written(rows, "rows")
    left = _without(docs, row, rows.filter("not kept"))
    twins = rows.filter("kept and n > 1")
    if twins.isEmpty():
        return left
    # rows repeated in full: one of them stays
    several = left.join(small(twins.select(F.col("row").alias("_twin"))), row.eqNullSafe(F.col("_twin")))
    first = several.withColumn("_nth", F.row_number().over(Window.partitionBy("_twin").orderBy("_twin"))).filter("_nth = 1")
    return _without(left, row, twins).unionByName(first.select(*docs.columns))


@_stage
def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document (that of the smallest id) of each group linked by a
    Jaccard similarity of 0.8 or more between sets of five-word shingles."""
    row = F.struct("doc_id", F.xxhash64("text").alias("hash"))
    parts = linked(docs.select(row.alias("row"), "text"), words_each=5, num=80, den=100, id_col="row")
    gone = parts.filter(F.col("row") != F.col("component_id")).select("row")
    return _without(docs, row, gone)


def _without(docs: DataFrame, row: Column, gone: DataFrame) -> DataFrame:
    return docs.join(small(gone.select(F.col("row").alias("_gone"))), row.eqNullSafe(F.col("_gone")), "left_anti")


@_stage
def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes four fifths of the tokens by the target weights, each document once at most."""
    return mix(docs, **mixture(), budget_share=0.8, max_epochs=1, seed=17).select(*docs.columns)


@_stage
def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids in sequences of at most 4096: doc_id, piece, start, length, ids,
    sequence_id, offset."""
    return pack(token_pieces(docs, word_tokens(tokenizer_path()), length=4096, end_id=1), capacity=4096)


STAGES = [("language ID", language_id), ("exact dedup", exact_copies), ("n-gram Jaccard join", near_copies), ("mixing", mixing), ("packing", packing)]


def run(spark: SparkSession, sf_dir: str, folder: str | None = None) -> DataFrame:
    """All stages over the documents; each one's result is written and read again, and
    the one before deleted. With a ``folder`` of its own, a run whose driver was lost goes on
    after the last stage that was written; without, the result goes when the driver ends."""
    base = folder
    if base is None:
        base = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
        delete_on_exit(spark, base)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    done = [k for k in range(len(STAGES)) if exists(spark, f"{base}/{k}/_SUCCESS")]
    if done:
        docs = spark.read.parquet(f"{base}/{done[-1]}")
    for k, (_, stage) in enumerate(STAGES):
        if done and k <= done[-1]:
            continue
        out = stage(spark, docs, sf_dir)
        with thrifty(spark):
            out.write.mode("overwrite").parquet(f"{base}/{k}")
        docs = spark.read.parquet(f"{base}/{k}")
        delete(spark, f"{base}/{k - 1}")
    release(_made.get() or [])
    return docs


#: SQL can't tokenise, so there is none; tests hold the stages against plain Python.
ORACLE_SQL = None
