"""An inbox folder as a stream: each new file of rows is analysed once and appended to a table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..plans.analyze import analyze


def documents(spark: SparkSession, path: str, schema: str = "doc_id long, text string") -> DataFrame:
    return spark.readStream.schema(schema).parquet(path)


def analyse_inbox(spark: SparkSession, inbox: str, table: str, checkpoint: str) -> StreamingQuery:
    """Works off what lies in the inbox and stops; a later call goes on where this one ended. Rows carry no state, so
    nothing is kept between files but what the checkpoint says of them."""
    out = analyze(documents(spark, inbox)).select("doc_id", "analysis")
    return out.writeStream.format("parquet").option("path", table).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
