"""Enrichment as a stream: nothing lost, nothing repeated, failures tried again."""

import pytest
from pyspark.errors import StreamingQueryException

from vecloom.streaming.enrichment import enrich_stream, enriched, outcomes, rejects

ITEM = "item_id long, title string, review string"


@pytest.fixture
def stream(spark, tmp_path):
    source, output, progress = (str(tmp_path / n) for n in ("in", "out", "cp"))

    def answers(reviews):
        if any(review == "kill" for _, review in reviews):
            raise SystemExit(1)
        return [ValueError("bad") if r == "bad" else None if r == "none" else r.upper() for _, r in reviews]

    class Stream:
        path = output

        def arrive(self, *rows):
            spark.createDataFrame(list(rows), ITEM).coalesce(1).write.mode("append").parquet(source)

        def run(self, summarise=answers, **options):
            schema = spark.createDataFrame([], ITEM).schema
            enrich_stream(spark, source, schema, lambda d: d, summarise, output, progress, **options).awaitTermination()

        def done(self):
            return sorted(tuple(r) for r in enriched(spark, output).collect())

        def failed(self):
            return sorted(tuple(r) for r in rejects(spark, output).collect())

    return Stream()


def test_failed_items_are_tried_again_and_then_given_up(spark, stream):
    stream.arrive((1, "a", "x"), (2, "b", "bad"), (3, "c", "none"))
    stream.run()
    assert stream.done() == [(1, "X", 1), (3, None, 1)]
    assert stream.failed() == [(2, "ValueError: bad", 1, False)]
    stream.arrive((4, "d", "bad"), (1, "a", "x"), (2, "b", "bad"))
    stream.run()
    # The second answerer knows what to say to the open ones.
    stream.arrive((5, "e", "y"), (5, "e", "y"))
    stream.run(lambda reviews: ["mended" if r == "bad" and t == "d" else ValueError("bad") if r == "bad" else r for t, r in reviews])
    assert stream.done() == [(1, "X", 1), (3, None, 1), (4, "mended", 2), (5, "y", 1)]
    assert stream.failed() == [(2, "ValueError: bad", 3, True)]
    stream.arrive((6, "f", "z"))
    stream.run()
    assert stream.done()[-1] == (6, "Z", 1)
    assert stream.failed() == [(2, "ValueError: bad", 3, True)]


def test_a_batch_that_breaks_off_is_repeated_as_a_whole(spark, stream):
    stream.arrive((1, "a", "x"), (2, "b", "bad"))
    stream.run()
    stream.arrive((3, "c", "y"), (4, "d", "kill"))
    with pytest.raises(StreamingQueryException):
        stream.run()
    assert stream.done() == [(1, "X", 1)]

    def lost(batch):
        raise RuntimeError("lost after the write")

    calm = lambda reviews: ["K" if r == "kill" else ValueError("bad") if r == "bad" else r.upper() for _, r in reviews]
    with pytest.raises(StreamingQueryException):
        stream.run(calm, after_batch=lost)
    stream.run(calm)
    assert stream.done() == [(1, "X", 1), (3, "Y", 1), (4, "K", 1)]
    assert stream.failed() == [(2, "ValueError: bad", 2, False)]
    assert outcomes(spark, stream.path).count() == 5
