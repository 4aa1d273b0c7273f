"""Text and cleaning expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barline.functions.blocks import month, positions

# Weekday labels, Monday first.
WEEKDAYS = ("Mon", "Tue", "Wed", "Thu", "Fri", "Sat", "Sun")


def finite(df: DataFrame) -> DataFrame:
    """Null instead of NaN and infinities in every float column and float array."""

    def clean(c: Column) -> Column:
        return F.when(~F.isnan(c) & ~c.isin(float("inf"), float("-inf")), c)

    floats = (T.DoubleType, T.FloatType)
    out = {}
    for f in df.schema.fields:
        if isinstance(f.dataType, floats):
            out[f.name] = clean(F.col(f"`{f.name}`"))
        elif isinstance(f.dataType, T.ArrayType) and isinstance(f.dataType.elementType, floats):
            out[f.name] = F.transform(F.col(f"`{f.name}`"), clean)
    return df.withColumns(out) if out else df


def date_part(text: Column) -> Column:
    """The date of an ISO text, with T or a blank before the time."""
    return F.split(F.trim(text), "[T ]")[0]


def money(value: Column) -> Column:
    """1.234,56"""
    return F.translate(F.format_number(value, 2), ",.", ".,")


def money_plain(value: Column) -> Column:
    """1,234.56"""
    return F.format_number(value, 2)


def signed_percent(value: Column) -> Column:
    return F.concat(F.when(value >= 0, "+").otherwise(""), F.format_string("%.2f", value + 0.0), F.lit("%"))


def trade_register(trades: DataFrame, keys=("symbol",)) -> DataFrame:
    """Adds label (#id), day, hour, weekday name and the direction, result and status classes."""
    trades = positions(trades, "__n", ["entry_time", "id"], month("entry_time"), keys)
    days = F.array(*[F.lit(d) for d in WEEKDAYS])
    return trades.withColumns(
        {
            "label": F.concat(F.lit("#"), F.col("__n").cast("string")),
            "day": F.date_format("entry_time", "yyyy-MM-dd"),
            "hour": F.hour("entry_time").cast("long"),
            "weekday": F.get(days, F.weekday("entry_time")),
            "direction_class": F.when(F.col("direction") == "long", "buy").otherwise("sell"),
            "pnl_class": F.when(F.col("pnl") > 0, "positive").when(F.col("pnl") < 0, "negative").otherwise("neutral"),
            "status": F.when(F.col("exit_time").isNull(), "open").otherwise("closed"),
        }
    ).drop("__n")


def split_open(trades: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(open, closed): without and with an exit time."""
    return trades.filter("exit_time is null"), trades.filter("exit_time is not null")


def alert_text(events: DataFrame) -> DataFrame:
    """Adds the text of an open or close alert to live ledger events."""
    opened = F.format_string("OPEN %s %s qty=%.6f entry=%.2f", "symbol", "side", "quantity", "entry_price")
    closed = F.format_string("CLOSE %s %s exit=%.2f pnl=%.2f (%s)", "symbol", "side", "exit_price", "pnl", "reason")
    return events.withColumn("alert", F.when(F.col("event") == "open", opened).otherwise(closed))
