"""Beyond batch scans: a stream of file facts, summed by folder as files arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomline.functions import paths, tokens

FACTS = "path string, text string, seen timestamp"


def arrivals(spark: SparkSession, folder: str) -> DataFrame:
    return spark.readStream.schema(FACTS).parquet(folder)


def folder_totals(facts: DataFrame, late: str = "10 minutes", window: str = "1 hour") -> DataFrame:
    """Files and tokens of each folder and window; a path counts once within the watermark."""
    once = facts.withWatermark("seen", late).dropDuplicatesWithinWatermark(["path"])
    sized = once.withColumn("estimated_tokens", tokens.estimate_file(F.col("text"), paths.extension(F.col("path"))))
    return sized.groupBy(F.window("seen", window), paths.dirname(F.col("path")).alias("folder")).agg(F.count(F.lit(1)).alias("files"), F.sum("estimated_tokens").alias("tokens"))
