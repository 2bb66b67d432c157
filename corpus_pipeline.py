"""The corpus pipeline: quality rules, toxicity, near-duplicates, repeated passages, packing.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns
of ``documents``.  ``run`` writes nothing itself but cuts lineage between stages in the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sumiveil.llm.common import read_table, settle
from sumiveil.llm.packing import pack
from sumiveil.llm.quality import measure
from sumiveil.llm.simhash import one_of_each
from sumiveil.llm.substrings import with_substrings_removed
from sumiveil.llm.toxicity import fit, held_out, labelled_sample, toxicity

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules keep, without the lines that failed them.

    Null, empty and blank texts have too few words and go; rows that repeat are judged each; an empty
    table gives none; columns beyond those of documents are left out.
    """
    kept = measure(docs.select(COLUMNS)).where("quality.kept").withColumn("text", F.col("quality.clean"))
    return kept.withColumn("n_chars", F.length("text").cast("long")).select(COLUMNS)


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below one half.

    The models learn from the labelled documents of this stage's input, but for the held-out fifth;
    without labels of both classes nothing scores so high, and all stay.  Null and empty texts have
    the score of no evidence; rows that repeat are scored each; an empty table gives none.
    """
    labels = read_table(spark, sf_dir, "labels")
    models = fit(labelled_sample(docs, labels.where(~held_out())))
    scored = docs.select(*COLUMNS, toxicity(models, F.col("text"), spark).alias("toxicity"))
    return scored.where("toxicity < 0.5").select(COLUMNS)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near-duplicates: fingerprints at most two bits apart, or five-word shingles at least 0.8 alike.

    It is the one of least doc_id (null ids last, ties by a hash of id and text).  Null, empty and
    blank texts are alike; of rows that repeat one stays; an empty table gives none.
    """
    return one_of_each(docs.select(COLUMNS), alike=True)


def substring_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, without the lines and passages that an earlier one, or it before, has.

    A text of which all goes stays as an empty one, as null and empty texts do; rows that repeat lose
    the same; an empty table gives none.
    """
    out = with_substrings_removed(docs.select(COLUMNS)).withColumn("text", F.col("dedup.text"))
    return out.withColumn("n_chars", F.length("text").cast("long")).select(COLUMNS)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of every document, with their sequences.

    Null and empty texts are the one end id; rows that repeat are packed each; an empty table gives none.
    """
    return pack(docs)


STAGES = [
    ("quality rules", quality_stage),
    ("toxicity", toxicity_stage),
    ("simhash near-dedup", near_duplicate_stage),
    ("substring dedup", substring_stage),
    ("best-fit packing", packing_stage),
]

#: SQL can't express the toxicity models, fingerprints and token ids; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = settle(docs)
    return docs
