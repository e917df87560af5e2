"""The corpus pipeline: quality rules, exact and near duplicates, mixing, packing, each on what the last one kept.

Every stage takes the columns of ``documents`` (more may follow, whatever their names) and all rows of its
predecessor. Null and empty texts fail the quality rules, and an empty table passes through every stage. Stages are
lazy over working tables: these stay until ``scratch.close()``, or the end of the process where none is given.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from stowage.llm import exact_dedup, minhash, mixing, packing, quality_rules
from stowage.llm.common import Scratch, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str, scratch: Scratch | None = None) -> DataFrame:
    """Lines that fail are gone from the texts; documents that fail are gone, those with null or empty texts among them."""
    return quality_rules.clean(docs)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str, scratch: Scratch | None = None) -> DataFrame:
    """One row of each group of equal texts, that with the most code points, then the smallest doc_id (null last)."""
    return exact_dedup.deduplicate(docs, scratch=scratch)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str, scratch: Scratch | None = None) -> DataFrame:
    """One row of each class of near duplicates, that with the smallest doc_id (null last); texts without words stay."""
    return minhash.deduplicate(docs, scratch=scratch)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str, scratch: Scratch | None = None) -> DataFrame:
    """The taken copies in training order; a document that is taken twice is two rows, one without words none."""
    return mixing.training_order(docs, scratch=scratch)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str, scratch: Scratch | None = None) -> DataFrame:
    """One row per piece with its sequence and place."""
    return packing.pack(packing.pieces(docs, packing.tokenizer_path()), scratch=scratch)


STAGES = [("quality_rules", quality), ("exact_dedup", exact), ("minhash_near_dedup", near), ("curriculum_mixing", mix), ("bestfit_packing", pack)]

#: Weighted samples, token ids and packing have no SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order, each written and read again; returns what the last one gives.

    A stage's working tables are deleted once its result is written, and that result once the next one's is.
    """
    docs, held = table(spark, sf_dir, "documents"), Scratch(spark, "pipeline")
    for i, (name, stage) in enumerate(STAGES[:-1]):
        work = Scratch(spark, name)
        out = held.keep(stage(spark, docs, sf_dir, work), name)
        work.close()
        if i:
            held.drop(docs)
        docs = out
    return STAGES[-1][1](spark, docs, sf_dir)
