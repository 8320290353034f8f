"""A corpus from raw documents to token ids, in five stages of webmill.llm. Each stage's result is written and read again."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from webmill.llm import bpe, common, jaccard, mixing, quality, substrings

#: Near copies share four fifths of their runs of five words; op5_jaccard_join has the figures of its own contract.
SHINGLE = 5
PERCENT = 80
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that neither fail the rules nor come from a host that does. Null and empty texts fail; a null source is a
    host of its own; repeated rows and null ids are judged like any."""
    measured = common.table(quality.measure(docs))
    return quality.judge(measured, "source").filter("_q_kept").select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of linked documents: that of least id, null counting last. Rows go and stay, not ids; documents
    without words stay."""
    return jaccard.one_of_each(docs, size=SHINGLE, percent=PERCENT)


def suffix_array_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages of 200 bytes or more that occur elsewhere too. Every row stays, if only with what is
    left of its text, whatever its id; a null text becomes an empty one."""
    out = substrings.suffix_dedup(docs).withColumn("text", F.col("_s_kept")).withColumn("n_chars", F.length("text").cast("long"))
    return out.select(*docs.columns)


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it: null and empty texts never, null ids and repeated rows like any."""
    return mixing.mix(docs, whole=True)


def bpe_encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, token ids, their number and the text that they decode to. A null text has no tokens and decodes to an empty one."""
    return bpe.encode(docs, bpe.vocabulary_path()).select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", "decoded")


def _stage(f):
    """f as a stage: tables that the stage before made for itself are removed when this one begins."""

    @functools.wraps(f)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        with common.stage():
            return f(spark, docs, sf_dir)

    return run_stage


STAGES = [
    ("quality rules", _stage(quality_rules)),
    ("n-gram Jaccard join", _stage(near_duplicates)),
    ("suffix-array dedup", _stage(suffix_array_dedup)),
    ("mixing sources to target weights", _stage(source_mixing)),
    ("BPE encoding and decoding", _stage(bpe_encoding)),
]

#: No SQL form: components, suffix orders, flow and BPE are tested against brute-force versions instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents' token ids after all stages. Null texts fail the quality rules; an empty table gives an empty one."""
    docs = common.read(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = common.table(stage(spark, docs, sf_dir))
    return docs
