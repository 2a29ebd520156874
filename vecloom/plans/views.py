"""Item and vector views over the shared test tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vecloom.sources.readers import read_table, spread


def first_line(text: str = "text"):
    return F.substring_index(F.col(text), "\n", 1)


def item_columns() -> list[Column]:
    return [
        F.col("doc_id").alias("item_id"),
        first_line().alias("title"),
        F.col("source").alias("provider"),
        F.col("text").alias("review"),
    ]


def documents_as_items(documents: DataFrame) -> DataFrame:
    """A document is an item: its first line is the title, its whole text the review."""
    return documents.select(item_columns())


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents; those with a label row carry their text as summary."""
    labels = read_table(spark, sf_dir, "labels").select(
        F.col("doc_id").alias("item_id"), F.lit(True).alias("labelled")
    )
    docs = spread(documents_as_items(read_table(spark, sf_dir, "documents")), "item_id")
    return docs.join(labels, "item_id", "left").select(
        *docs.columns, F.when(F.col("labelled"), F.col("review")).alias("structured_summary")
    )


def item_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors with the fields of their document; the label is the cluster."""
    vectors = read_table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("item_id"), F.col("label").alias("cluster"), "embedding"
    )
    docs = spread(
        documents_as_items(read_table(spark, sf_dir, "documents")).withColumnRenamed(
            "review", "summary"
        ),
        "item_id",
    )
    return vectors.join(docs, "item_id")


def labelled_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "labels").select(F.col("doc_id").alias("item_id"))
