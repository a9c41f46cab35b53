"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import bpe_automaton, exact_dedup, host_rules, label_propagation, language_id, minhash_join, mixing, repair_tokens, secret_crf, warc


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_repair_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token shards written and read back.

    Null and empty texts have the end id alone; texts of any length are whole; repeated and null ids are rows (null first, equal ids by
    text); an empty table gives none.
    """
    return repair_tokens.round_trip(_table(spark, sf_dir, "documents"))


def op2_label_propagation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shards of equal counts.

    Null texts have size 8; a null id is linked with none; repeated rows are rows of their own, equal in all else they are parted by place;
    texts of any length are whole; an empty table gives none.
    """
    return label_propagation.shard(_table(spark, sf_dir, "documents"))


def op3_secret_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of secrets.

    Null and empty texts have none; texts of any length are whole; repeated rows and null ids are rows like any others; an empty table gives
    none.
    """
    return secret_crf.find_secrets(_table(spark, sf_dir, "documents"))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Languages.

    Null texts and those without a letter are 'und' with score 0; texts and words of any length are whole; a null id is not held out;
    repeated rows are rows, and one in the sample; ties go to the first language by name; an empty table gives none.
    """
    return language_id.identify(_table(spark, sf_dir, "documents"))


def op5_bpe_automaton(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids and decoded texts, as digests.

    Null and empty texts have no ids and the digests of ''; texts of any length are whole; repeated rows and null ids are rows like any
    others; an empty table gives none.
    """
    return bpe_automaton.round_trip(_table(spark, sf_dir, "documents"))


def op6_host_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and verdicts.

    Null and empty texts have no words and fail; a null source is a host; texts of any length are whole; repeated rows and null ids are rows
    like any others; an empty table gives none.
    """
    return host_rules.host_verdicts(_table(spark, sf_dir, "documents"))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mix by document.

    Null and empty texts have size 0 and give 0; a null source comes last; equal ids are in order of size, rows equal in that too are parted
    by place; texts of any length are whole; an empty table gives none.
    """
    return mixing.mix(_table(spark, sf_dir, "documents"))


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of equal texts.

    Null is empty; of texts of one length the smallest id stays, null last; repeated rows of the staying id are all kept; texts of any
    length are whole; an empty table gives none.
    """
    return exact_dedup.duplicate_groups(_table(spark, sf_dir, "documents"))


def op9_minhash_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicates at 85 per cent.

    Null texts and those without words have no shingles and no links; rows with equal ids are one node, those with null ids are linked with
    none; sets are of whole texts; an empty table gives none.
    """
    return minhash_join.near_components(_table(spark, sf_dir, "documents"), percent=85)


def op10_warc_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Archives written and read back.

    Null html is empty; every row is a record, repeated and null ids too: rows with the largest id of their payload are responses, and all
    rows of null ids alone; pages of any length are whole; an empty table gives none.
    """
    return warc.round_trip(_table(spark, sf_dir, "pages"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_repair_tokens, op2_label_propagation, op3_secret_crf, op4_language_id, op5_bpe_automaton, op6_host_rules, op7_mixing, op8_exact_dedup, op9_minhash_join, op10_warc_segments)}


def oracle_sql() -> dict[str, str]:
    return {"op6_host_rules": host_rules.SQL, "op7_mixing": mixing.SQL, "op8_exact_dedup": exact_dedup.SQL, "op10_warc_segments": warc.SQL}
