"""Streaming forms of the stateless steps and of token counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from askloom.functions.text import clean_corpus, keeps_quality


def post_stream(spark: SparkSession, path: str, schema: T.StructType, files_per_trigger: int = 16) -> DataFrame:
    """New Parquet files of a folder as a stream of posts."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def clean_stream(posts: DataFrame, text: str) -> DataFrame:
    """The corpus chain and the quality gate: the same columns as in batch, no state."""
    return posts.where(F.col(text).isNotNull() & keeps_quality(F.col(text))).withColumn(text, clean_corpus(F.col(text)))


def token_counts(posts: DataFrame, text: str, time: str, width: str = "1 hour", late: str = "1 day") -> DataFrame:
    """Tokens per event-time window; posts later than `late` are dropped with their state."""
    words = posts.withWatermark(time, late).select(time, F.explode(F.split(F.trim(F.lower(F.col(text))), r"\s+")).alias("token"))
    return words.groupBy(F.window(time, width), "token").agg(F.count("*").alias("n"))


def first_copies(posts: DataFrame, key: str, time: str, late: str = "1 day") -> DataFrame:
    """Repeated rows once, within the watermark."""
    return posts.withWatermark(time, late).dropDuplicatesWithinWatermark([key])
