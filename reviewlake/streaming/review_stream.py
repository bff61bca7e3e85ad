"""Streaming reviews: incoming snippets are reviewed and appended to the history."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from reviewlake.plans.review import RESULT_COLUMNS, review_unseen
from reviewlake.sources.sinks import recall, remember, review_records, write_records
from reviewlake.sources.stage import stage_scope, staged

REQUEST_SCHEMA = ("snippet_id long, user_id long, code string, filename string, language string, "
                  "created_at timestamp")


def read_requests(spark: SparkSession, folder: str) -> DataFrame:
    return spark.readStream.schema(REQUEST_SCHEMA).json(folder)


def review_batch(history: str, checkpoint: str, keep_days: float | None = None) -> Callable[[DataFrame, int], None]:
    """Review one micro-batch with the batch plan; a repeated batch replaces its own rows.

    The stream's id, which its checkpoint holds, keeps its rows apart from those of other runs. Results are remembered beside the
    history by code, for ``keep_days`` or for good, so copies of what any batch has had are not parsed again. The history
    is committed first: a batch that is repeated finds the same results, remembered or not.
    """
    memory = f"{history}/reviewed"

    def run(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        stream = json.loads(spark.read.text(f"{checkpoint}/metadata").first()["value"])["id"]
        with stage_scope(spark):
            # A request without a file name is filed as untitled.py before its review. Requests may
            # repeat an id, so a number of their own links them to their results.
            named = staged(
                batch.withColumn("filename", F.coalesce("filename", F.lit("untitled.py")))
                .withColumnRenamed("snippet_id", "review_id")
                .withColumn("snippet_id", F.monotonically_increasing_id()), "requests")
            found, new = review_unseen(named, lambda asked: recall(asked, memory, keep_days))
            results = found.select("snippet_id", *RESULT_COLUMNS)
            write_records(review_records(named.join(results, "snippet_id")), history, stream, batch_id)
            remember(new, memory, stream, batch_id)
    return run


def start_review_stream(requests: DataFrame, history: str, checkpoint: str, keep_days: float | None = None) -> StreamingQuery:
    """Process what has arrived and stop; rerun to go on from the checkpoint."""
    return (requests.writeStream.foreachBatch(review_batch(history, checkpoint, keep_days))
            .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
