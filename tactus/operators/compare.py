"""Comparison of two results by position, with tolerances."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def by_position(a: DataFrame, b: DataFrame, order: str, tolerance: float) -> DataFrame:
    """k-th rows of both (doc_id, text, at): doc_id, k, outcome 'equal', 'text', 'time', 'missing' or 'extra'."""
    w = Window.partitionBy("doc_id").orderBy(order)
    left, right = ([x.select("doc_id", (F.row_number().over(w) - 1).alias("k"), F.col("text").alias(f"{n}_text"), F.col("at").alias(f"{n}_at")) for n, x in (("a", a), ("b", b))])
    both = left.join(right, ["doc_id", "k"], "full_outer")
    outcome = F.when(F.col("b_at").isNull(), "missing").when(F.col("a_at").isNull(), "extra").when(F.col("a_text") != F.col("b_text"), "text").when(F.abs(F.col("a_at") - F.col("b_at")) > tolerance, "time").otherwise("equal")
    return both.select("doc_id", "k", outcome.alias("outcome"))
