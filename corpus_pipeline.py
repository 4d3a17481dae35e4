"""The corpus pipeline: language ID, near-dedup, decontamination, mixing, token output.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of documents. The
mix is an order: its stage writes rows sorted over files, and the last stage stores each document's place in that order
beside its tokens.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm import language_id, minmax_dedup, pfair_mix, spaced_seed, sstable
from plumbline.llm.queries import TARGETS, tokenizer_file
from plumbline.session import materialize, table


def keep_known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents whose language cannot be told: no letter, no text, or too unlike each language that was learned."""
    return language_id.keep_determined(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by 5-word shingles at a similarity of 0.8 or more: the one of the smallest doc_id."""
    return minmax_dedup.drop_near_duplicates(docs, shingle=5, share=80)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that overlap with a benchmark item."""
    return spaced_seed.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, in an order in which sources keep to their target weights."""
    return pfair_mix.mixed(docs, TARGETS)


def write_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids in sorted-string-table shards, read back: doc_id, position, start, n_tokens, ids_crc32.

    position orders documents as their files do (file number, then row number), -1 where docs are not read from files.
    """
    position = None
    try:
        file = F.regexp_extract(F.col("_metadata.file_name"), r"part-(\d+)", 1)
        docs = docs.withColumn("_position", F.shiftleft(F.coalesce(file.try_cast("bigint"), F.lit(0)), 40) + F.col("_metadata.row_index"))
        position = "_position"
    except AnalysisException:
        pass
    return sstable.token_shards(docs, tokenizer_file(), position=position)


STAGES = [
    ("language_id", keep_known_languages),
    ("near_dedup", drop_near_duplicates),
    ("decontamination", decontaminate),
    ("mix", mix_sources),
    ("tokens", write_tokens),
]

#: Learned decisions and BPE are beyond SQL; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STAGES over the documents of sf_dir, each stage's rows written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
