"""Corpus pipeline: toxicity, language, near duplicates, benchmark leaks, byte-level round trip.

Each stage works on all rows its predecessor kept. Rows are kept whole; all stages but the last return the columns of documents and read no others.
In every stage an empty table gives an empty one, and rows with a null id are judged by their text and never dropped for another row's sake.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kerbline.llm import byte_bpe, decontaminate, language_id, near_dup, toxicity
from kerbline.llm.common import remainder
from kerbline.runtime import materialise, scratch, ship

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: A text whose best language is less likely than this is rejected.
MIN_LANGUAGE = 0.5


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity score doesn't reject.

    Null and empty texts have no toxic word and stay. Equal rows get equal scores. Without labels of both kinds nothing is rejected.
    """
    ship(spark)
    model = toxicity.learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), remainder("doc_id", 3) != 1)
    return toxicity.predict(docs, model, COLUMNS).where("predicted = 0").select(COLUMNS)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a recognised language; null and empty texts and those without a letter are rejected.

    A tie between languages goes to the first by name. A null ``lang`` teaches nothing and doesn't matter otherwise.
    """
    ship(spark)
    names, weights = language_id.learn(docs, remainder("doc_id", 5) != 0)
    named = language_id.predict(docs, names, weights, COLUMNS)
    return named.where((F.col("lang_pred") != language_id.UNKNOWN) & (F.col("score") >= MIN_LANGUAGE)).select(COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the one of smallest id, of each group of near duplicates on five-word shingles.

    Texts without words are near nothing and stay. Rows of one id are one document, of which one row stays, the first by its text and other columns.
    """
    ship(spark)
    docs = docs.select(COLUMNS)
    gone = near_dup.components(docs, size=5, percent=80).where(~F.col("kept")).select("doc_id").distinct()
    kept = docs.join(gone, "doc_id", "left_anti")
    # Repeated ids are looked for among ids alone; whole rows meet only where there are some.
    twice = materialise(docs.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1 and doc_id is not null").select("doc_id"), "repeated-ids")
    if twice.isEmpty():
        return kept.select(COLUMNS)
    rest = [c for c in COLUMNS if c != "doc_id"]
    first = kept.join(twice, "doc_id", "left_semi").groupBy("doc_id").agg(F.min(F.struct("text", *[c for c in rest if c != "text"])).alias("r"))
    return kept.join(twice, "doc_id", "left_anti").select(COLUMNS).union(first.select("doc_id", "r.*").select(COLUMNS))


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without benchmark items. Null and empty texts hold none and stay; rows of one id are judged together."""
    ship(spark)
    return decontaminate.decontaminate(docs.select(COLUMNS), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def byte_round_trip(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, ids, n_tokens, ids_sha256, decoded_sha256) of each row: its token ids and the digests of ids and decoded bytes.

    Null and empty texts give no ids; each row is coded by itself.
    """
    ship(spark)
    return byte_bpe.digests(docs, keep_ids=True)


STAGES = [
    ("toxicity", toxic),
    ("language_id", language),
    ("near_duplicates", near_duplicates),
    ("decontamination", benchmark_leaks),
    ("byte_bpe", byte_round_trip),
]

#: Trained models and tokenizers have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = scratch(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
