"""The pending-work queue as a stream: new page documents replace their works' pages, once each."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pagemere.sources.files import PAGES, replace_works


def run(spark: SparkSession, incoming: str, pages: str, checkpoint: str) -> None:
    """Takes what has come in so far and ends; running it again takes only what is new."""

    def batch(df: DataFrame, _: int) -> None:
        replace_works(df.selectExpr("work_id", "inline(pages)"), pages)

    stream = spark.readStream.schema(PAGES).option("multiLine", True).json(incoming)
    stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
