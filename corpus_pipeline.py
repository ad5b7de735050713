"""A training corpus from documents: language ID, line dedup, near-dedup, mixing, tokens.

Each stage takes the documents that its predecessor kept, works on all of them and returns those it keeps, with its
decisions carried out; the last returns token ids. Between stages the documents are a table in the shared folder.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelnet.llm import bpe, langid, linededup, minhash, mixing
from panelnet.llm.queries import public_vocabulary
from panelnet.llm.storage import saved

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
LEAST_SHARE = 0.5
#: Similarity 0.8: two sets at the threshold share none of 28 bands of 4 rows with probability 4e-7; the margin is five standard errors.
NEAR = minhash.Near(percent=80, bands=28, rows=4, margin=0.19)


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Learns from the documents that carry a language; rejects texts without letters and those of whose letters no language has half; lang becomes the prediction."""
    learned = langid.learn(docs, F.lit(True))
    told = langid.identify(docs, learned, more=("text", "source", "n_chars"))
    kept = told.filter((F.col("lang_pred") != langid.UNKNOWN) & (F.col("score") >= LEAST_SHARE))
    return kept.select("doc_id", F.col("_text").alias("text"), F.col("lang_pred").alias("lang"), F.col("_source").alias("source"), F.col("_n_chars").alias("n_chars"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Deletes later repeated runs of lines; a document of which no word is left goes."""
    out = linededup.dedup_lines(docs.select(*COLUMNS))
    out = out.filter((F.col("n_removed") == 0) | F.col("text").rlike(mixing.WORD))
    return out.withColumn("n_chars", F.when(F.col("n_removed") == 0, F.col("n_chars")).otherwise(F.length("text").cast("long"))).select(*COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (similarity 0.8 or more) stays, that of the smallest id.

    Of rows that repeat an id one stays, the least by text, language, source and n_chars. Documents without words stay, and so do rows with a
    null id, which no group can name.
    """
    told = saved(minhash.near_duplicates(docs, NEAR).filter("doc_id is not null").select("doc_id", "kept"))
    gone = told.filter("not kept").select("doc_id").distinct()
    out = docs.select(*COLUMNS).join(gone.hint("merge"), "doc_id", "left_anti").select(*COLUMNS)  # their number grows with the corpus: no broadcast
    again = told.filter("kept").groupBy("doc_id").count().filter("count > 1").select("doc_id")
    if again.isEmpty():
        return out
    again = saved(again)
    one = out.join(again, "doc_id", "left_semi").groupBy("doc_id").agg(F.min(F.struct(*COLUMNS[1:])).alias("row"))
    return out.join(again, "doc_id", "left_anti").select(*COLUMNS).unionByName(one.select("doc_id", "row.*"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix takes it, none to three times."""
    return mixing.mixed(docs.select(*COLUMNS))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every text, with digests of the ids and of the bytes decoded from them."""
    return bpe.bpe_encode(docs.select("doc_id", "text", "lang", "source"), public_vocabulary(), ("n_tokens", "ids", "ids_sha256", "decoded_sha256"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", language_id),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("mix_sources", mix_sources),
    ("encode", encode),
]

#: Language ID, signatures and merges have no SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents, each one's rows written to the shared folder and read again by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
