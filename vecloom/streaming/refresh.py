"""Continuous refresh: new items get their cluster once, as files arrive."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from vecloom.functions.text import MIN_REVIEW_CHARS, has_review, is_blank
from vecloom.operators.clustering import assign_nearest
from vecloom.operators.embedding import HashedVectoriser
from vecloom.streaming.model_store import check_settings, load_model, save_model, versions

Embed = Callable[[DataFrame], DataFrame]


def assign_new(
    items: DataFrame,
    done: DataFrame,
    embed: Embed,
    centres: Sequence[tuple[int, Sequence[float]]],
    min_chars: int = MIN_REVIEW_CHARS,
) -> DataFrame:
    """Gate, drop known keys, embed, assign: the same plan for a batch or a stream.

    There is no aggregation and no keyed state, so a stream of any length needs no
    memory beyond the current files; ``embed`` adds an ``embedding`` column. A source of one
    file is spread by key first. Items without a vector are dropped by their missing cluster: a filter
    on the vectors would make Spark compute them twice.
    """
    fresh = items.filter(has_review(F.col("review"), min_chars) & ~is_blank(F.col("title"))).join(
        done.select("item_id"), "item_id", "left_anti"
    )
    embedded = embed(fresh.repartition("item_id")).select("item_id", "title", "embedding")
    return (
        assign_nearest(embedded, centres)
        .filter(F.col("cluster").isNotNull())
        .select("item_id", "title", "cluster")
    )


def first_of_each_key(items: DataFrame, within: str, key: str = "item_id", arrived: str = "arrived") -> DataFrame:
    """Rows of a stream whose key has not arrived in the time ``within`` before; keyed state is held no longer."""
    return items.withWatermark(arrived, within).dropDuplicatesWithinWatermark([key]).drop(arrived)


def refresh(
    spark: SparkSession,
    source: str,
    schema: T.StructType,
    prepare: Callable[[DataFrame], DataFrame],
    done: DataFrame,
    embed: Embed,
    centres: Sequence[tuple[int, Sequence[float]]],
    output: str,
    checkpoint: str,
    files_per_trigger: int = 1000,
    unique_within: str | None = None,
) -> StreamingQuery:
    """Process everything that has arrived and stop; run again for what comes later.

    The checkpoint remembers the files already read, the parquet sink commits whole
    micro-batches, so each file counts exactly once even after a failure.

    With ``unique_within`` (a time such as "7 days") a key that comes again within that time after its
    file was written counts once, also in one file; ``prepare`` must then keep the column ``arrived``.
    Repeats of a key are taken to be equal: any of those that arrive together may be the one kept.
    """
    arriving = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(source)
    if unique_within is None:
        items = prepare(arriving)
    else:
        items = prepare(arriving.select("*", F.col("_metadata.file_modification_time").alias("arrived")))
        items = first_of_each_key(items, unique_within)
    return (
        assign_new(items, done, embed, centres)
        .writeStream.format("parquet")
        .outputMode("append")
        .option("path", output)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def refresh_from_disk(
    spark: SparkSession,
    source: str,
    schema: T.StructType,
    prepare: Callable[[DataFrame], DataFrame],
    done: DataFrame,
    output: str,
    checkpoint: str,
    model: tuple[HashedVectoriser, Sequence[tuple[int, Sequence[float]]]] | None = None,
    **options,
) -> StreamingQuery:
    """As ``refresh``, with the model kept beside the checkpoint.

    The first run is given a vectoriser and centres and stores them; later runs need neither and go on with the
    stored version, whatever has been fitted elsewhere meanwhile. A vectoriser of other settings is refused, as
    its vectors cannot be compared with the stored centres.
    """
    store = f"{checkpoint.rstrip('/')}-model"
    if versions(spark, store):
        saved = load_model(spark, store, 1)
        if model is not None:
            check_settings(saved, model[0])
    elif model is None:
        raise ValueError("the first run of a refresh needs a model")
    else:
        save_model(spark, store, *model)
        saved = load_model(spark, store, 1)
    return refresh(spark, source, schema, prepare, done, saved.embed, saved.centres, output, checkpoint, **options)
