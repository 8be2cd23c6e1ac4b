"""Cell-level comparison of a filled template with its reference answer."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.functions.numbers import numeric_text
from factloom.functions.text import strip

KEY = ("scenario", "sheet", "cell_ref")


def plain(c: Column) -> Column:
    """Comparable cell text: trimmed, without thousands separators."""
    return F.translate(strip(F.coalesce(c, F.lit(""))), ",，", "")


def is_blank(c: Column) -> Column:
    return strip(F.coalesce(c, F.lit(""))).isin("", "None")


def values_match(expected: Column, actual: Column, tolerance: float = 0.01) -> Column:
    """Equal text, or numbers within a relative tolerance."""
    e, a = numeric_text(expected), numeric_text(actual)
    close = F.abs(e - a) / F.greatest(F.abs(e), F.lit(1.0)) < tolerance
    return (expected == actual) | F.coalesce(close, F.lit(False))


def cell_diff(template: DataFrame, reference: DataFrame, actual: DataFrame,
              tolerance: float = 0.01) -> DataFrame:
    """Cells blank in the template and filled in the reference, compared with the actual result.

    All three are ``(scenario, sheet, cell_ref, value)``.
    """
    keys = list(KEY)
    t = template.select(*keys, F.col("value").alias("_t"))
    a = actual.select(*keys, F.col("value").alias("_a"))
    blanks = reference.where(~is_blank(F.col("value"))).join(t, keys, "left").where(is_blank(F.col("_t")))
    joined = blanks.join(a, keys, "left")
    expected, got = plain(F.col("value")), plain(F.col("_a"))
    return joined.select(
        *keys, expected.alias("expected"), got.alias("actual"),
        values_match(expected, got, tolerance).alias("is_match"),
    )


def fill_accuracy(diffs: DataFrame, seconds: DataFrame | None = None, pass_at: float = 0.8,
                  max_seconds: float = 90.0) -> DataFrame:
    """Blanks, correct cells and accuracy per scenario; passed within accuracy and time limits.

    ``seconds(scenario, seconds)`` is optional.
    """
    out = diffs.groupBy("scenario").agg(
        F.count("*").alias("blanks"), F.count_if("is_match").alias("correct"),
        F.avg(F.col("is_match").cast("double")).alias("accuracy"),
    )
    ok = F.col("accuracy") >= pass_at
    if seconds is not None:
        out = out.join(seconds, "scenario", "left")
        ok = ok & (F.col("seconds") <= max_seconds)
    return out.withColumn("passed", ok)


def accuracy_summary(scenarios: DataFrame) -> DataFrame:
    """Averages over the scenarios."""
    aggs = [F.count("*").alias("scenarios"), F.avg("accuracy").alias("avg_accuracy"),
            F.count_if("passed").alias("n_passed")]
    if "seconds" in scenarios.columns:
        aggs.append(F.avg("seconds").alias("avg_seconds"))
    return scenarios.agg(*aggs)
