"""Requests answered as they arrive (SUM-09): a stream joined to stored flights, each answered once.

Request files land in a folder, one request a line. A run takes the files that have arrived
since the last one, answers each micro-batch against the stored tables and writes the answers
into a folder of the batch's own. A batch that is replayed after a failure overwrites that
folder, and a folder counts once its ``_SUCCESS`` marker is there, so every request is answered
exactly once. The answers and the checkpoint belong together.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarmac.sources.materialize import finished_folders


def land_requests(requests: DataFrame, path: str) -> None:
    requests.select(F.col("variables").alias("value")).write.mode("append").text(path)


def answer_arrived(spark: SparkSession, landing: str, answers: str, checkpoint: str,
                   answer: Callable[[DataFrame], DataFrame], files_per_batch: int = 1000) -> None:
    """Answer the requests that have arrived; ``answer`` maps requests (variables) to answers."""
    arrived = spark.readStream.schema("value string").option("maxFilesPerTrigger", files_per_batch).text(landing)

    def write(batch: DataFrame, batch_id: int) -> None:
        answer(batch).write.mode("overwrite").parquet(f"{answers}/batch-{batch_id:012d}")

    arrived.select(F.col("value").alias("variables")).writeStream.foreachBatch(write) \
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def read_answers(spark: SparkSession, answers: str) -> DataFrame:
    """All answers given so far; a run must have finished before."""
    return spark.read.parquet(*[f"{answers}/{n}" for n in sorted(finished_folders(spark, answers)) if n.startswith("batch-")])
