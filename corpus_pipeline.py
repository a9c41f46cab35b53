"""A corpus pipeline of the operators in quillspark.llm: STAGES, run() and ORACLE_SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm import bpe_automaton, common, exact_dedup, language_id, minhash_join, mixing


def languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the model finds to be of a language it has learnt, by its evidence; the others go.

    Null and empty texts and those without a letter go. Where nothing is labelled all others stay. Repeated rows and null ids are judged like any
    others, long texts as wholes; an empty table stays empty.
    """
    return language_id.known(docs, language_id.train(docs))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts that are equal without white space the longest stays, of those the smallest id.

    Null and empty texts are equal. Repeated rows of the staying id all stay, a null id comes last. Texts are compared whole; an empty table stays empty.
    """
    return exact_dedup.deduplicate(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near-duplicates (five words, 0.8 or more) the smallest id stays.

    Texts without words, null ones too, are alike with none and stay; so do rows with null ids. Repeated rows of the staying id all stay.
    Sets are of whole texts; an empty table stays empty.
    """
    return minhash_join.deduplicate(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its source's budget takes it, in rows of its own; the one at the cut is taken whole.

    Null and empty texts have no words: they are taken once. A null source is a source. Rows of one id, null too, are taken as often as the most taken one of them;
    an empty table stays empty.
    """
    plan = mixing.copies(mixing.mix(docs)).groupBy(F.col("doc_id").alias("_mix_id")).agg(F.max("copies").alias("_mix_copies")).where("_mix_copies > 0")
    out = docs.join(plan, F.col("doc_id").eqNullSafe(F.col("_mix_id")))
    return out.select(*docs.columns, F.explode(F.sequence(F.lit(1), "_mix_copies")).alias("_mix_copy")).drop("_mix_copy")


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row's token ids, how many they are, and the digest of the text decoded from them.

    Null and empty texts have no ids. Repeated rows, copies of the mix among them, and null ids are rows like any others; texts are encoded whole; an
    empty table gives none.
    """
    return bpe_automaton.coded(docs)


STAGES = [("language ID", languages), ("exact dedup", exact), ("MinHash near-dedup", near), ("mixing", mixed), ("BPE coding", tokens)]
#: Language scores, signatures and tokens can't be written in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STAGES applied to documents, each stage's result written as Parquet and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = common.persisted(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
