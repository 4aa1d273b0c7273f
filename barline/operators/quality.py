"""Candle quality: integrity rules, spikes, volume anomalies, the report."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barline.functions.frames import holds, over_zero, series

# Penalty per issue and the labels by least score.
PENALTIES = {"gaps": 2, "duplicates": 2, "out_of_order": 3, "invalid": 4, "price_spikes": 1, "volume_anomalies": 1}
LABELS = ((95, "excellent"), (85, "very good"), (70, "fair"), (0, "poor"))


def integrity_issues(candles: DataFrame) -> DataFrame:
    """One row per broken rule, so up to three per candle; nulls break a rule."""
    o, h, l, c = (F.col(x) for x in ("open", "high", "low", "close"))
    inside = holds((l <= o) & (o <= h) & (l <= c) & (c <= h))
    positive = holds((o > 0) & (h > 0) & (l > 0) & (c > 0))
    rules = F.array(F.when(~inside, "outside_range"), F.when(~positive, "not_positive"), F.when(~holds(h >= l), "high_below_low"))
    return candles.select("symbol", "datetime", F.explode(F.array_compact(rules)).alias("issue"))


def price_spikes(candles: DataFrame, limit: float = 0.20) -> DataFrame:
    ratio = (F.col("high") - F.col("low")) / over_zero(F.col("open"))
    return candles.select("symbol", "datetime", ratio.alias("range_pct")).filter(F.col("range_pct") > limit)


def volume_anomalies(candles: DataFrame, deviations: float = 5.0) -> DataFrame:
    """Zero volumes, and volumes above mean + deviations * std of their symbol."""
    limits = candles.groupBy("symbol").agg((F.avg("volume") + deviations * F.stddev_samp("volume")).alias("limit"))
    rows = candles.join(limits, "symbol")
    kinds = F.array(F.when(F.col("volume") == 0, "zero"), F.when(F.col("volume") > F.col("limit"), "spike"))
    return rows.select("symbol", "datetime", "volume", F.explode(F.array_compact(kinds)).alias("issue"))


def report(candles: DataFrame, minutes: int, ingest: str | None = None) -> DataFrame:
    """Counts of the six kinds of issues, a score and its label per symbol.

    Out-of-order arrivals need an ingest sequence; without one they are 0.
    """
    late = F.col("datetime") < F.max("datetime").over(series(order=ingest).rowsBetween(-(2**31), -1)) if ingest else F.lit(False)
    w = series()
    marked = candles.select(
        "symbol",
        holds(F.timestamp_diff("SECOND", F.lag("datetime").over(w), F.col("datetime")) > minutes * 60).alias("gap"),
        holds(F.lag("datetime").over(w) == F.col("datetime")).alias("duplicate"),
        holds(late).alias("late"),
    )
    counts = marked.groupBy("symbol").agg(F.count_if("gap").alias("gaps"), F.count_if("duplicate").alias("duplicates"), F.count_if("late").alias("out_of_order"))
    for name, issues in (("invalid", integrity_issues(candles)), ("price_spikes", price_spikes(candles)), ("volume_anomalies", volume_anomalies(candles))):
        counts = counts.join(issues.groupBy("symbol").agg(F.count("*").alias(name)), "symbol", "left")
    counts = counts.fillna(0)
    penalty = sum((F.col(k) * p for k, p in PENALTIES.items()), F.lit(0))
    scored = counts.withColumn("score", F.greatest(F.lit(0), 100 - penalty).cast("long"))
    label = F.coalesce(*[F.when(F.col("score") >= least, name) for least, name in LABELS])
    return scored.withColumn("label", label)
