"""Enrichment as a stream: every arriving item is summarised once, failed ones again in later batches."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from vecloom.operators.enrich import REQUEST_ROWS, SummariseBatch, summarise_with

# Fixed value: how often an item is tried before it stays among the rejects.
MAX_ATTEMPTS = 3

OUTCOME = {
    "item_id": "long",
    "title": "string",
    "review": "string",
    "structured_summary": "string",
    "error": "string",
    "attempt": "int",
}


def outcomes(spark: SparkSession, path: str) -> DataFrame:
    """All outcomes of finished batches, one row per attempt at an item, with ``batch_id``."""
    columns = ", ".join(f"{name} {kind}" for name, kind in OUTCOME.items())
    return spark.read.schema(f"{columns}, batch_id long").parquet(path)


def enriched(spark: SparkSession, path: str) -> DataFrame:
    """(item_id, structured_summary, attempt): items that were answered; a declined item has no summary."""
    return outcomes(spark, path).filter(F.col("error").isNull()).select("item_id", "structured_summary", "attempt")


def rejects(spark: SparkSession, path: str, max_attempts: int = MAX_ATTEMPTS) -> DataFrame:
    """(item_id, error, attempt, final): items whose last attempt failed; ``final`` ones are not tried again."""
    tried = outcomes(spark, path)
    # An open item is tried in every batch, so its last attempt is in the last batch of all.
    last = tried.agg(F.max("batch_id")).first()[0]
    given_up = F.col("attempt") >= max_attempts
    return tried.filter(F.col("error").isNotNull() & (given_up | (F.col("batch_id") == last))).select(
        "item_id", "error", "attempt", given_up.alias("final")
    )


def enrich_stream(
    spark: SparkSession,
    source: str,
    schema: T.StructType,
    prepare: Callable[[DataFrame], DataFrame],
    summarise: SummariseBatch,
    output: str,
    checkpoint: str,
    max_attempts: int = MAX_ATTEMPTS,
    request_rows: int = REQUEST_ROWS,
    files_per_trigger: int = 1000,
    after_batch: Callable[[int], None] | None = None,
) -> StreamingQuery:
    """Summarise all that has arrived below ``source`` and stop; run again for what comes later.

    A batch asks for its new items and, once more, for the items that failed in the batch before
    and have attempts left. All its outcomes, answers and errors, are one folder named by the batch:
    a batch that is repeated after a failure writes its folder anew and reads only folders of
    earlier batches, so nothing is lost or counted twice. An item that arrives a second time is
    left out, whatever became of it; of repeats in one batch one is kept. Items without an id or with a blank
    review go to ``summarise`` as they are; ``prepare`` is the place for gates. A stream
    without new files runs no batch, so the last failures wait for the next arrival.
    ``after_batch`` is called with the number of a batch when its folder is complete.
    """

    def earlier(batch: int) -> DataFrame:
        return outcomes(spark, output).filter(F.col("batch_id") < batch)

    def run(arrived: DataFrame, batch: int) -> None:
        columns = ["item_id", "title", "review"]
        todo = prepare(arrived).select(*columns).dropDuplicates(["item_id"]).withColumn("attempt", F.lit(1))
        if batch:
            todo = todo.join(earlier(batch).select("item_id").distinct(), "item_id", "left_anti")
            again = earlier(batch).filter(
                (F.col("batch_id") == batch - 1) & F.col("error").isNotNull() & (F.col("attempt") < max_attempts)
            )
            todo = todo.unionByName(again.select(*columns, (F.col("attempt") + 1).alias("attempt")))
        # The seam runs once: answers and errors are written together, with what a later attempt needs.
        kept = ["title", "review", "attempt"]
        found = summarise_with(todo.repartition("item_id"), summarise, request_rows, keep=kept).select(*OUTCOME)
        found.write.mode("overwrite").parquet(
            f"{output.rstrip('/')}/batch_id={batch}"
        )
        if after_batch is not None:
            after_batch(batch)

    return (
        spark.readStream.schema(schema)
        .option("maxFilesPerTrigger", files_per_trigger)
        .parquet(source)
        .writeStream.foreachBatch(run)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
