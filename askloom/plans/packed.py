"""Queries of the packed-field operator."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from askloom.operators.packed import QUESTION_FIELDS, split_packed
from askloom.session import once_wide, ready, table


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every value of questions.Tags, Entities and Snippets with its question, field and position."""
    q = table(ready(spark), sf_dir, "questions").select("Id", *QUESTION_FIELDS)
    return split_packed(once_wide(q), "Id", QUESTION_FIELDS).select("field", "id", "pos", "item")


QUERIES = {"p1_found": p1_found}
SQL: dict[str, str] = {}
