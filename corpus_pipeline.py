"""A corpus pipeline of five stages, each over all that the stage before kept.

``STAGES`` lists (name, function); a function takes the session, the documents and the folder of the given
tables, and returns documents (the last one: packed pieces). ``run`` writes each stage's result to the shared
checkpoint folder as Parquet and reads it again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from citeloom.llm import lines, mixing, near_duplicates, packing, toxicity
from citeloom.llm.common import cut_lineage, read

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def reject_toxic(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents with a toxicity score of 0.7 or more go; the classifier learns from the labels not held out."""
    model = toxicity.train(docs, read(spark, folder, "labels"), ~toxicity.held_out(F.col("doc_id")))
    return toxicity.score(docs, model, "toxicity").filter(F.col("toxicity") < toxicity.THRESHOLD).select(*docs.columns)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Later occurrences of three-line windows go; documents stay, and so does their order of columns."""
    shorter = lines.remove_repeats(docs)
    changed = F.col("n_removed") > 0
    out = shorter.withColumn("n_chars", F.when(changed, F.char_length("text").cast("long")).otherwise(F.col("n_chars")))
    return out.select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """One document of each near-duplicate group stays, that of the least id."""
    return near_duplicates.drop_near_copies(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    return mixing.mix_documents(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Power-of-two pieces with their token ids."""
    return packing.pack(docs)


STAGES = [
    ("toxicity", reject_toxic),
    ("line_dedup", drop_repeated_lines),
    ("near_dedup", drop_near_copies),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: A trained classifier, random rounding and a tokenizer are beyond SQL; ``tests/llm/test_pipeline.py`` checks
#: the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = cut_lineage(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
