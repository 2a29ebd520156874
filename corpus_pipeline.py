"""From documents to training sequences: the training-data operators as one pipeline.

Each stage takes the documents that the one before it kept, as a written table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vecloom.llm.decontamination import clean_documents
from vecloom.llm.jaccard_join import keep_one_of_each_group
from vecloom.llm.line_dedup import drop_repeated_lines
from vecloom.llm.packing import pack_documents, word_tokenizer
from vecloom.llm.packed import shuffles_end_with_their_job
from vecloom.llm.queries import tokenizer_path
from vecloom.llm.toxicity import fit_toxicity
from vecloom.session import cut_lineage
from vecloom.sources.readers import read_table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model scores below one half."""
    return fit_toxicity(docs, read_table(spark, sf_dir, "labels")).keep_clean(docs)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines found in many documents go; ``n_chars`` follows the text."""
    left = drop_repeated_lines(docs)
    return left.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by five-word shingles at a similarity of 0.8."""
    return keep_one_of_each_group(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item, in order or reordered."""
    return clean_documents(docs, read_table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents' tokens in full sequences."""
    encoder = word_tokenizer(tokenizer_path("word_bpe_49k.json"))
    return pack_documents(docs, encoder, id_bytes=2, with_ids=False).drop("ids")


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_lines),
    ("jaccard_join", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("packing", pack),
]

# Learned scores, tilings and tokenizers are beyond SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        with shuffles_end_with_their_job(spark):
            docs = cut_lineage(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
