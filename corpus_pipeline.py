"""A corpus pipeline of five stages, each made durable as Parquet before the next.

Language ID, line dedup, MinHash near-dedup, benchmark decontamination, and
byte-level BPE. All stages but the last return the columns of ``documents``; the
last returns doc_id, n_tokens, ids_sha256 and decoded_sha256. Stages see all that
their predecessor kept; none reads beside it more than the benchmark table.

Defined cases: documents without a letter (null and empty texts too) go in the
first stage; documents that lose every line go in the second; of each group of
near copies (five-word shingles, similarity 0.8 or more) the least doc_id stays, and
rows with one doc_id go or stay together there; repeated rows lose the same lines; columns
beside those of ``documents``, whatever their names, come through all stages but the last
as they are; an empty table gives an empty result; a null doc_id comes before all
others; long texts need what the operators say.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm import bpe, decontaminate, langid, line_dedup, minhash
from quillspark.llm.durable import durable, made, sweep
from quillspark.llm.queries import public_ranks


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Learn from the labelled documents that are not held out; documents that are no language go."""
    filters = langid.train(docs.filter(~langid.held_out(F.col("doc_id"))).select("doc_id", "text", "lang"))
    return langid.of_known_language(docs, filters)


def unrepeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one occurrence of each group of equal or nearly equal lines."""
    return line_dedup.drop_repeated_lines(docs)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group of near copies."""
    return minhash.drop_near_duplicates(docs)


def uncontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which benchmark passages are at least a twentieth of the words go."""
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Encode every text and decode it again."""
    return bpe.encode_and_check(docs.select("doc_id", "text"), public_ranks())


STAGES = [
    ("language_id", known_language),
    ("line_dedup", unrepeated_lines),
    ("near_dedup", one_of_each_group),
    ("decontamination", uncontaminated),
    ("byte_bpe", tokens),
]

#: SQL has neither SimHash with edit distance nor BPE: the tests hold each stage against brute force, and run() against the stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        mark = made()
        docs = durable(stage(spark, docs, sf_dir), name)
        sweep(spark, mark, keep=1)  # the stage's own tables go; its result, and what was before, stay
    return STAGES[-1][1](spark, docs, sf_dir)
