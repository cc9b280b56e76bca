"""Resuming by stream: each new file of requests is answered once, whatever was interrupted."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from veilwright.plans.models import RESPONSE, Backend, Calls, called, unanswered
from veilwright.sources.readers import exists

REQUEST = "cache_key string, stage string, model string, schema_version string, doc_key string, system string, user string"


def responses(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(RESPONSE).parquet(path) if exists(spark, path) else spark.createDataFrame([], RESPONSE)


def answer_stream(spark: SparkSession, requests_path: str, responses_path: str, checkpoint: str, backend: Backend, calls: Calls = Calls()) -> StreamingQuery:
    """Answers the requests in new Parquet files under requests_path and appends the responses. A batch that is run
    again after a failure asks only for what its first run did not store."""

    def one(batch: DataFrame, _: int) -> None:
        todo = unanswered(batch.dropDuplicates(["cache_key"]), responses(spark, responses_path))
        called(todo, backend, calls).write.mode("append").parquet(responses_path)

    stream = spark.readStream.schema(REQUEST).parquet(requests_path)
    return stream.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def status_stream(docs: DataFrame, time_col: str, watermark: str = "10 minutes", window: str = "5 minutes") -> DataFrame:
    """Rows by window and status of a stream of documents; late ones within the watermark count."""
    return docs.withWatermark(time_col, watermark).groupBy(F.window(time_col, window), "status").count()
