"""Statement replies that arrive one upload at a time.

The parsing steps look at one reply only, so the same functions that serve a
batch serve a stream of files; no state or watermark is needed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ledger_spark.operators.normalize import normalize
from ledger_spark.schema import REPLIES
from ledger_spark.sources.replies import read_replies, write_replies


def reply_stream(spark: SparkSession, folder: str, files_per_batch: int = 1000) -> DataFrame:
    """Reply files (JSON lines) below ``folder`` as a stream."""
    reader = spark.readStream.schema(REPLIES).option("maxFilesPerTrigger", files_per_batch)
    return reader.json(folder)


def start_intake(replies: DataFrame, folder: str, checkpoint: str) -> StreamingQuery:
    """Write normalised transactions and rejects of a reply stream as Parquet.

    Both go out in one pass, so nothing is parsed twice or kept; ``read_written``
    reads them. Each micro-batch has its own folder and overwrites it, so a batch
    that is replayed after a failure leaves no second copy.
    """

    def write(batch: DataFrame, number: int) -> None:
        path = f"{folder}/batch={number}"
        write_replies(read_replies(batch), path, mode="overwrite", prepare=normalize)

    writer = replies.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return writer.trigger(availableNow=True).start()
