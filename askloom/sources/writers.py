"""Writers: tables, text, JSON, indexes, feature files, predictions. All are distributed writes into a folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_table(df: DataFrame, path: str, by: str | None = None) -> None:
    """Parquet, replacing what is there; by: partition column."""
    w = df.write.mode("overwrite")
    (w.partitionBy(by) if by else w).parquet(path)


def append_table(df: DataFrame, path: str) -> None:
    """Rows are added; there is no unique key, so nothing is replaced."""
    df.write.mode("append").parquet(path)


def write_text(df: DataFrame, column: str, path: str) -> None:
    """A row a line, white space collapsed."""
    df.select(F.trim(F.regexp_replace(F.col(column), r"\s+", " ")).alias("value")).write.mode("overwrite").text(path)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def write_api_index(df: DataFrame, tokens: str, path: str) -> None:
    """One API token a line."""
    df.select(F.explode(tokens).alias("value")).write.mode("overwrite").text(path)


def write_features(df: DataFrame, items: str, path: str) -> None:
    """label TAB features, a token a line, sentences apart by a blank line, for sequence taggers."""
    lines = F.transform(items, lambda x: F.concat_ws("\t", x["label"], F.array_join(x["F"], "\t")))
    df.select(F.concat(F.array_join(lines, "\n"), F.lit("\n")).alias("value")).write.mode("overwrite").text(path)


def write_predictions(df: DataFrame, key: str, score: str, path: str) -> None:
    """Rounded predictions with their ids; never by position."""
    df.select(key, F.round(score).cast("int").alias("prediction")).write.mode("overwrite").parquet(path)


def write_index(vectors: DataFrame, metadata: DataFrame, path: str) -> None:
    """A search index: vectors grouped by term range and metadata by post, each a Parquet folder."""
    vectors.repartitionByRange("term").sortWithinPartitions("term", "doc").write.mode("overwrite").parquet(f"{path}/vectors")
    metadata.write.mode("overwrite").parquet(f"{path}/metadata")
