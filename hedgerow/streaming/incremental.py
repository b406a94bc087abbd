"""List lines as a stream: new files are classified as they come; the optimizer runs over what is stored."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import classify


def line_stream(spark: SparkSession, folder: str, hosts: bool = False) -> DataFrame:
    """(list_id, line_no, raw, hosts) of the text files that come into a folder."""
    return spark.readStream.text(folder).select(F.lit(0).alias("list_id"), F.lit(0).alias("line_no"), F.col("value").alias("raw"), F.lit(hosts).alias("hosts"))


def store_rules(lines: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Appends the kept rules of a stream of lines as Parquet, exactly once; ends when all that is there is read."""
    return classify.kept(classify.classified(lines)).writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
