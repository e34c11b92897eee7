"""Measures of ranked results and of binary decisions, as window and aggregate expressions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

EPSILON = 1e-7


def running_precision(rel: DataFrame, query: str = "query_id", rank: str = "rank", label: str = "rel") -> DataFrame:
    w = Window.partitionBy(query).orderBy(rank).rowsBetween(Window.unboundedPreceding, 0)
    return rel.withColumn("precision", F.sum(label).over(w) / F.col(rank))


def average_precision(rel: DataFrame, k: int, query: str = "query_id", rank: str = "rank", label: str = "rel") -> DataFrame:
    """Sum of the precisions at relevant ranks up to k, over k - not over the number of relevant results."""
    p = running_precision(rel, query, rank, label).where(F.col(rank) <= k)
    return p.groupBy(query).agg((F.sum(F.col("precision") * F.col(label)) / k).alias("ap"))


def search_length(rel: DataFrame, n: int, most: int, query: str = "query_id", rank: str = "rank", label: str = "rel") -> DataFrame:
    """Irrelevant results seen before the n-th relevant one; `most` where there is none."""
    w = Window.partitionBy(query).orderBy(rank).rowsBetween(Window.unboundedPreceding, 0)
    seen = rel.where(F.col(rank) <= most).withColumn("hits", F.sum(label).over(w))
    at = F.min(F.when(F.col("hits") == n, F.col(rank)))
    return seen.groupBy(query).agg(F.coalesce(at - n, F.lit(most)).alias("length"))


def hit_percentage(searches: DataFrame, lookup: DataFrame) -> DataFrame:
    """Found pairs over half the symmetric lookup, in per cent with two digits; may exceed 100."""
    half = lookup.count() / 2
    hits = searches.join(lookup, ["src", "dst"], "left_semi").agg(F.count("*").alias("hits"))
    return hits.select(F.round(F.try_divide(100.0 * F.col("hits"), F.lit(half)), 2).alias("percent"))


def binary_metrics(rows: DataFrame, truth: str, guess: str) -> DataFrame:
    """Precision, recall and F1 with a small constant against empty denominators."""
    t, g = F.col(truth).cast("int"), F.col(guess).cast("int")
    sums = rows.agg(F.sum(t * g).alias("tp"), F.sum(g).alias("guessed"), F.sum(t).alias("actual"))
    p, r = F.col("tp") / (F.col("guessed") + EPSILON), F.col("tp") / (F.col("actual") + EPSILON)
    return sums.select(p.alias("p"), r.alias("r")).select(
        F.round("p", 6).alias("precision"), F.round("r", 6).alias("recall"), F.round(2 * F.col("p") * F.col("r") / (F.col("p") + F.col("r") + EPSILON), 6).alias("f1")
    )


def equal_groups(rows: DataFrame, order: str, groups: int) -> DataFrame:
    """Adds `grp`, 0.., splitting rows in `order` into equal runs, the first ones a row longer where they do not divide."""
    from askloom.operators.relational import number_rows

    n = rows.count()
    size, extra = divmod(n, groups)
    at = F.col("row") - 1
    long_part = extra * (size + 1)
    grp = F.when(at < long_part, F.floor(at / (size + 1))).otherwise(extra + F.floor((at - long_part) / max(size, 1)))
    return number_rows(rows, [F.col(order)]).withColumn("grp", grp.cast("int")).drop("row")
