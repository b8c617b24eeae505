"""Scores of predictions against labels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def match_metrics(rows: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """One row: precision, recall, f1, accuracy over rows with a label and a prediction of 0 or 1, and the coverage.

    Unreadable predictions (-1 or null) are left out of the scores and show in
    the coverage; undefined ratios, and the empty table, give 0.
    """
    known = F.col(label).isNotNull()
    valid = known & F.col(prediction).isin(0, 1)
    count = lambda c: F.count_if(c).cast("double")
    p, y = F.col(prediction) == 1, F.col(label).cast("int") == 1
    counts = rows.agg(
        count(valid & p & y).alias("tp"),
        count(valid & p & ~y).alias("fp"),
        count(valid & ~p & y).alias("fn"),
        count(valid & (p == y)).alias("right"),
        count(valid).alias("n"),
        count(known).alias("known"),
    )
    ratio = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return counts.select(
        ratio(tp, tp + fp).alias("precision"),
        ratio(tp, tp + fn).alias("recall"),
        ratio(2 * tp, 2 * tp + fp + fn).alias("f1"),
        ratio(F.col("right"), F.col("n")).alias("accuracy"),
        ratio(F.col("n"), F.col("known")).alias("coverage"),
    )
