"""Summary generation: what is pending, how it is summarised, how results are stored."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vecloom.functions.text import (
    MIN_SUMMARISABLE_CHARS,
    has_review,
    placeholder_summary,
    sentences,
    tokens,
)
from vecloom.operators.ordering import take_window
from vecloom.operators.relational import (
    first_per_title,
    missing_summary,
    not_yet_done,
    upsert,
    with_summary,
    with_title,
)

# Words that point at each aspect of a review, in output order.
ASPECT_WORDS: Mapping[str, tuple[str, ...]] = {
    "theme": ("theme", "themed", "story", "world", "setting", "inspired", "adventure", "based"),
    "features": ("feature", "features", "bonus", "spins", "wild", "wilds", "scatter", "multiplier", "reels"),
    "verdict": ("verdict", "overall", "recommend", "rating", "score", "conclusion", "worth", "fun"),
    "look_and_sound": ("graphics", "visuals", "design", "animation", "sound", "soundtrack", "music", "audio"),
}

SummariseBatch = Callable[[list[tuple[str, str]]], Sequence[str | Exception | None]]

# Fixed value: reviews per request to a caller's model.
REQUEST_ROWS = 10


def pending_items(
    df: DataFrame, done: DataFrame | None = None, start: int = 0, count: int | None = None
) -> DataFrame:
    """Items still without summary, with a title, and whose title is not done elsewhere."""
    pending = with_title(missing_summary(df))
    if done is not None:
        pending = not_yet_done(pending, done)
    return pending if count is None else take_window(pending, start, count)


def _best_unused(tokenised: Column, used: Column, words: Sequence[str]) -> Column:
    """Struct (hits, minus position) of the unused sentence with most aspect words.

    Equal scores take the earlier sentence, so without any hit this is the leading
    sentence not used yet. NULL when every sentence is used.
    """
    scored = F.transform(
        tokenised,
        lambda ts, i: F.struct(
            F.size(F.filter(ts, lambda t: t.isin(*words))).alias("hits"), (-i).alias("at")
        ),
    )
    return F.array_max(F.filter(scored, lambda c: ~F.array_contains(used, -c["at"])))


def aspect_summary(
    df: DataFrame, aspects: Mapping[str, Sequence[str]] = ASPECT_WORDS, into: str = "structured_summary"
) -> DataFrame:
    """Offline summariser: one sentence of the review per aspect, a line each.

    Row-local expressions over the whole review; reviews too short to summarise get the
    placeholder sentence instead.
    """
    wanted = sorted({word for words in aspects.values() for word in words})
    out = (
        df.withColumn("__s", sentences(F.col("review")))
        # Every sentence is tokenised once; only words of some aspect are kept.
        .withColumn("__t", F.transform("__s", lambda s: F.filter(tokens(s), lambda t: t.isin(*wanted))))
        .withColumn("__used", F.array().cast("array<int>"))
    )
    for words in aspects.values():
        best = _best_unused(F.col("__t"), F.col("__used"), words)
        out = out.withColumn("__best", best).withColumn(
            "__used",
            F.when(F.col("__best").isNull(), F.col("__used")).otherwise(
                F.array_append("__used", -F.col("__best.at"))
            ),
        )
    lines = F.array_join(
        F.transform("__used", lambda i: F.get(F.col("__s"), i)), "\n"
    )
    summary = F.when(has_review(F.col("review"), MIN_SUMMARISABLE_CHARS), lines).otherwise(
        placeholder_summary(F.coalesce("title", F.lit("")))
    )
    return out.withColumn(into, summary).drop("__s", "__t", "__used", "__best")


def summarise_with(
    df: DataFrame, summarise: SummariseBatch, request_rows: int = REQUEST_ROWS, keep: Sequence[str] = ()
) -> DataFrame:
    """Summaries from a caller's function: (item_id, structured_summary, error), and the columns ``keep``.

    The function gets up to ``request_rows`` pairs of title and review and answers each with a
    summary, None, or an exception. A row that failed has no summary and its error text; a
    request that fails as a whole fails its own rows. Other rows are unaffected.
    """
    schema = T.StructType(
        [T.StructField("item_id", T.LongType())]
        + [T.StructField(name, T.StringType()) for name in ("structured_summary", "error")]
        + [df.schema[name] for name in keep]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, request_rows):
                # Only the texts of one request are Python objects at a time.
                part = batch.slice(start, request_rows)
                try:
                    answers = list(summarise(list(zip(part.column("title").to_pylist(), part.column("review").to_pylist()))))
                    if len(answers) != part.num_rows:
                        raise ValueError(f"{len(answers)} answers for {part.num_rows} reviews")
                except Exception as failure:  # a failed request must not fail the job
                    answers = [failure] * part.num_rows
                failed = [isinstance(a, Exception) for a in answers]
                summaries = [a.strip() if a and not bad else None for a, bad in zip(answers, failed)]
                errors = [f"{type(a).__name__}: {a}" if bad else None for a, bad in zip(answers, failed)]
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("item_id"),
                        pa.array(summaries, pa.string()),
                        pa.array(errors, pa.string()),
                        *[part.column(name) for name in keep],
                    ],
                    ["item_id", "structured_summary", "error", *keep],
                )

    return df.select(*dict.fromkeys(["item_id", "title", "review", *keep])).mapInArrow(run, schema)


def result_status(results: DataFrame) -> DataFrame:
    """completed / skipped / failed per result row."""
    status = (
        F.when(F.col("error").isNotNull(), "failed")
        .when(F.col("structured_summary").isNull(), "skipped")
        .otherwise("completed")
    )
    return results.withColumn("status", status)


def apply_results(df: DataFrame, results: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The item table with the new summaries written in, and the failed rows."""
    good = results.filter(F.col("structured_summary").isNotNull())
    rejects = results.filter(F.col("error").isNotNull()).select("item_id", "error")
    return upsert(df, good.select("item_id", "structured_summary")), rejects


def new_to_embed(df: DataFrame, embedded: DataFrame) -> DataFrame:
    """Summarised items whose title has no vector yet, one row per title."""
    return first_per_title(with_title(with_summary(df)), not_in=embedded)
