"""Indicators over (series_id, period, level). Windows are per series; joins are on the calendar."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.columns import round1


def _by():
    return Window.partitionBy("series_id").orderBy("period")


def with_previous(series: DataFrame, n: int = 1, name: str = "previous") -> DataFrame:
    """The level ``n`` rows back if its period is exactly ``n`` months back, else null."""
    back = F.lag(F.struct("period", "level"), n).over(_by())
    return series.withColumn("_b", back).withColumn(name, F.when(F.col("_b.period") == F.add_months("period", -n), F.col("_b.level"))).drop("_b")


def join_shifted(series: DataFrame, months: int, name: str = "shifted") -> DataFrame:
    """The level of the period ``months`` before, by calendar, whatever is missing between."""
    other = series.select("series_id", F.add_months("period", months).alias("period"), F.col("level").alias(name))
    return series.join(other, ["series_id", "period"], "left")


def change_percent(now: Column, before: Column) -> Column:
    return round1((F.try_divide(now.cast("double"), before.cast("double")) - 1) * 100)


def mom(series: DataFrame) -> DataFrame:
    return with_previous(series).select("series_id", "period", "level", "previous", change_percent(F.col("level"), F.col("previous")).alias("mom"))


def yoy(series: DataFrame) -> DataFrame:
    return join_shifted(series, 12, "year_ago").select("series_id", "period", "level", "year_ago", change_percent(F.col("level"), F.col("year_ago")).alias("yoy"))


def level_diff(series: DataFrame) -> DataFrame:
    """Change from the month before, and that month's own change; null where months are missing."""
    both = with_previous(with_previous(series, 1, "p1"), 2, "p2")
    return both.select("series_id", "period", (F.col("level") - F.col("p1")).alias("diff"), (F.col("p1") - F.col("p2")).alias("previous_diff"))


def latest(series: DataFrame) -> DataFrame:
    return series.groupBy("series_id").agg(F.max_by(F.struct("period", "level"), "period").alias("x")).select("series_id", "x.*")


def latest_n(series: DataFrame, n: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("series_id").orderBy(F.col("period").desc()))
    return series.withColumn("n", rank).filter(F.col("n") <= n)


def latest_with_previous(series: DataFrame) -> DataFrame:
    by = Window.partitionBy("series_id").orderBy(F.col("period").desc())
    top = latest_n(series, 2).withColumns({"previous": F.lead("level").over(by), "previous_period": F.lead("period").over(by)})
    return top.filter("n = 1").drop("n")


def duplicate_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n")).filter("n > 1")


def not_consecutive(series: DataFrame) -> DataFrame:
    """Latest and previous period per series, and whether they are adjacent months."""
    two = latest_with_previous(series)
    return two.select("series_id", "period", "previous_period", (F.col("previous_period") == F.add_months("period", -1)).alias("consecutive"))


def clean_points(points: DataFrame, value: str = "value") -> DataFrame:
    """Points with ``level``, and ``problem``: missing (a dash or blank, skipped with a warning) or malformed (an error)."""
    t = F.trim(F.col(value))
    number = t.try_cast("double")
    problem = F.when(t.isNull() | t.isin("", "-", "--"), "missing").when(number.isNull() | F.isnan(number), "malformed")
    return points.withColumns({"level": number, "problem": problem})


def direct_or_calculated(series: DataFrame, direct: str = "direct_mom") -> DataFrame:
    """The published change, else the one calculated from levels, and which it is."""
    calculated = with_previous(series).withColumn("_c", change_percent(F.col("level"), F.col("previous")))
    method = F.when(F.col(direct).isNotNull(), "direct").when(F.col("_c").isNotNull(), "calculated_from_index")
    return calculated.select("series_id", "period", F.coalesce(direct, "_c").alias("mom"), method.alias("value_method"))
