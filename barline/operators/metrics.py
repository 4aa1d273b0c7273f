"""Performance, drawdown, calendar and risk statistics of trade ledgers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barline.functions.blocks import bar_block, hand_on, month, positions
from barline.functions.frames import BLOCK, over_zero


def equity_curve(trades: DataFrame, initial: float, keys=("symbol",), order=("exit_time", "id")) -> DataFrame:
    """Adds equity, peak, drawdown (fraction of the peak), dd_value and n (from 1), in ledger order; a null pnl counts 0.

    A block of trades (a month of exits, or a range of ids) is summed up by its
    number, its sum and the highest sum inside it; blocks hand these on.
    """
    block = month("exit_time") if order[0] == "exit_time" else bar_block(order[0])
    w = Window.partitionBy(*keys, BLOCK).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    rows = trades.withColumn(BLOCK, block)
    rows = rows.withColumns({"__sum": F.sum(F.coalesce("pnl", F.lit(0.0))).over(w), "__n": F.row_number().over(w)}).withColumn("__top", F.max("__sum").over(w))
    totals = rows.groupBy(*keys, BLOCK).agg(F.sum(F.coalesce("pnl", F.lit(0.0))).alias("sum"), F.max("__sum").alias("top"), F.count("*").alias("n"))
    before = F.coalesce(F.sum("sum").over(Window.partitionBy(*keys).orderBy(BLOCK).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    totals = totals.withColumn("top", before + F.col("top"))
    rows = hand_on(rows, totals, {"__before": F.sum("sum"), "__peak": F.max("top"), "__count": F.sum("n")}, keys)
    base = F.coalesce("__before", F.lit(0.0))
    rows = rows.withColumns({"equity": initial + (base + F.col("__sum")), "peak": initial + F.greatest("__peak", base + F.col("__top")), "n": (F.col("__n") + F.coalesce("__count", F.lit(0))).cast("long")})
    rows = rows.drop(BLOCK, "__sum", "__n", "__top", "__before", "__peak", "__count")
    return rows.withColumn("drawdown", F.col("equity") / F.col("peak") - 1).withColumn("dd_value", F.col("equity") - F.col("peak"))


def performance_summary(trades: DataFrame, initial: float = 1000.0, keys=("symbol",)) -> DataFrame:
    """Eleven measures per key; a result of 0 counts as a loss; without a loss the profit factor is infinite."""
    e = equity_curve(trades, initial, keys, ("id",))
    gain, loss = F.col("pnl") > 0, F.col("pnl") <= 0
    s = e.groupBy(*keys).agg(
        F.sum("pnl").alias("net"), F.count("*").alias("trades"), F.count_if(gain).alias("wins"), F.count_if(loss).alias("losses"), F.coalesce(F.sum(F.when(gain, F.col("pnl"))), F.lit(0.0)).alias("gp"),
        F.coalesce(F.sum(F.when(loss, F.col("pnl"))), F.lit(0.0)).alias("gl"), F.min("drawdown").alias("dd"),
    )
    factor = F.when(F.col("gl") < 0, F.round(F.col("gp") / F.abs("gl"), 2)).otherwise(F.lit(float("inf")))
    return s.select(
        *keys, F.lit(initial).alias("initial_capital"), F.round(initial + F.col("net"), 2).alias("final_balance"), F.round("net", 2).alias("net_profit"), "trades", "wins", "losses",
        F.round(100.0 * F.col("wins") / F.col("trades"), 2).alias("win_rate_pct"), F.round("gp", 2).alias("gross_profit"), F.round("gl", 2).alias("gross_loss"), factor.alias("profit_factor"),
        F.round(100.0 * F.col("dd"), 2).alias("max_drawdown_pct"),
    )


def extended_metrics(trades: DataFrame, initial: float = 1000.0, keys=("symbol",)) -> DataFrame:
    """Averages, expectancy, drawdown in value and percent, recovery, duration, annual return, Sharpe per trade."""
    keys = list(keys)
    e = equity_curve(trades, initial, keys)
    gain, loss = F.col("pnl") > 0, F.col("pnl") < 0
    worst = F.min_by(F.struct(F.col("n").alias("n"), F.col("peak").alias("peak")), F.struct("drawdown", "n")).alias("worst")
    s = e.groupBy(*keys).agg(
        F.count("*").alias("trades"), F.sum("pnl").alias("net_profit"), F.sum(F.when(gain, F.col("pnl"))).alias("gp"), F.sum(F.when(loss, F.col("pnl"))).alias("gl"), F.avg(F.when(gain, F.col("pnl"))).alias("avg_gain"),
        F.avg(F.when(loss, F.col("pnl"))).alias("avg_loss"), F.avg("pnl").alias("expectancy"), F.min("dd_value").alias("max_dd_value"), (100 * F.min("drawdown")).alias("max_dd_pct"), worst,
        F.avg(F.timestamp_diff("SECOND", F.col("entry_time"), F.col("exit_time"))).alias("avg_duration_s"), F.timestamp_diff("DAY", F.min("entry_time"), F.max("exit_time")).alias("days"),
        (F.avg("pnl") / over_zero(F.stddev_samp("pnl")) * F.sqrt(F.count("*"))).alias("sharpe"),
    )
    later = e.select(*keys, "n", "equity").join(s.select(*keys, "worst", "trades"), keys).filter("n >= worst.n and worst.n < trades")
    top = later.groupBy(*keys).agg(F.max("equity").alias("top"), F.min_by("n", F.struct(-F.col("equity"), F.col("n"))).alias("at"), F.first("worst").alias("w"))
    recovery = top.select(*keys, F.when(F.col("top") >= F.col("w.peak"), F.col("at") - F.col("w.n")).alias("recovery_trades"))
    annual = F.when(F.col("days") > 0, (F.pow((initial + F.col("net_profit")) / initial, 365.0 / F.col("days")) - 1) * 100)
    return s.join(recovery, keys, "left").select(
        *keys, "trades", "net_profit", F.when(F.col("gl") < 0, F.coalesce("gp", F.lit(0.0)) / F.abs("gl")).alias("profit_factor"), "avg_gain", "avg_loss", "expectancy", "max_dd_value", "max_dd_pct",
        F.col("recovery_trades").cast("long").alias("recovery_trades"), "avg_duration_s", annual.alias("annual_return_pct"), "sharpe",
    )


def monthly_drawdown(trades: DataFrame, initial: float = 1000.0, keys=("symbol",)) -> DataFrame:
    """The worst drawdown (percent) by exit month; months without trades are 0."""
    keys = list(keys)
    e = equity_curve(trades, initial, keys).withColumn("month", F.date_trunc("month", "exit_time").cast("date"))
    worst = e.groupBy(*keys, "month").agg((100 * F.min("drawdown")).alias("dd_pct"))
    calendar = worst.groupBy(*keys).agg(F.explode(F.sequence(F.min("month"), F.max("month"), F.expr("interval 1 month"))).alias("month"))
    return calendar.join(worst, [*keys, "month"], "left").fillna(0.0, ["dd_pct"])


def equity_by_year(trades: DataFrame, initial: float = 1000.0, keys=("symbol",)) -> DataFrame:
    e = equity_curve(trades, initial, keys)
    return e.groupBy(*keys, F.year("exit_time").cast("long").alias("year")).agg(F.max_by("equity", F.struct("exit_time", "id")).alias("equity_end"), F.min("equity").alias("equity_low"), F.max("equity").alias("equity_high"))


def equity_last_months(trades: DataFrame, months: int = 3, initial: float = 1000.0, keys=("symbol",)) -> DataFrame:
    """The curve's last months; the curve itself starts at the first trade."""
    e = equity_curve(trades, initial, keys).withColumn("__end", F.max("exit_time").over(Window.partitionBy(*keys)))
    return e.filter(F.col("exit_time") >= F.add_months(F.col("__end").cast("date"), -months)).drop("__end")


def pnl_by_clock(trades: DataFrame, unit: str, keys=("symbol",)) -> DataFrame:
    """Sum of pnl by ``unit`` ("hour", 0-23, or "weekday", Monday 0) of the entry; gaps are 0."""
    of = {"hour": (F.hour, 24), "weekday": (F.weekday, 7)}[unit]
    sums = trades.groupBy(*keys, of[0]("entry_time").cast("long").alias(unit)).agg(F.sum("pnl").alias("pnl"))
    every = trades.select(*keys).distinct().withColumn(unit, F.explode(F.sequence(F.lit(0).cast("long"), F.lit(of[1] - 1).cast("long"))))
    return every.join(sums, [*keys, unit], "left").fillna(0.0, ["pnl"])


def heatmap(trades: DataFrame, keys=("symbol",)) -> DataFrame:
    """Mean pnl by weekday (rows) and hour (columns h0..h23) of the exit."""
    df = trades.withColumn("weekday", F.weekday("exit_time").cast("long")).withColumn("h", F.concat(F.lit("h"), F.hour("exit_time")))
    return df.groupBy(*keys, "weekday").pivot("h", [f"h{i}" for i in range(24)]).agg(F.avg("pnl"))


def pnl_by_period(trades: DataFrame, unit: str = "month", keys=("symbol",)) -> DataFrame:
    """pnl and profit factor (null without a loss) by exit month or year."""
    df = trades.withColumn("period", F.date_trunc(unit, "exit_time").cast("date"))
    gain, loss = F.sum(F.when(F.col("pnl") > 0, F.col("pnl"))), F.sum(F.when(F.col("pnl") < 0, F.col("pnl")))
    return df.groupBy(*keys, "period").agg(F.sum("pnl").alias("pnl"), (F.coalesce(gain, F.lit(0.0)) / F.abs(loss)).alias("profit_factor"))


def histogram(df: DataFrame, value: Column, bins: int = 40, keys=("symbol",)) -> DataFrame:
    """Counts in equal bins between least and greatest value; null values do not count."""
    keys = list(keys)
    rows = df.select(*keys, value.alias("__v")).filter("__v is not null")
    ends = rows.groupBy(*keys).agg(F.min("__v").alias("lo"), F.max("__v").alias("hi"))
    at = F.when(F.col("hi") > F.col("lo"), F.least(F.floor((F.col("__v") - F.col("lo")) / ((F.col("hi") - F.col("lo")) / bins)), F.lit(bins - 1))).otherwise(F.lit(bins // 2))
    return rows.join(ends, keys).groupBy(*keys, at.cast("long").alias("bin")).agg(F.count("*").alias("n"))


def exact_quantiles(df: DataFrame, value: Column, at: tuple[float, ...], keys=("symbol",), pieces: int = 256) -> DataFrame:
    """keys, q (array, linear between ranks) and n: exact quantiles of a key of any size.

    Values are counted first, so repeats weigh but take no room. Approximate
    quantiles of the distinct values cut a key into about equal pieces; counts
    of pieces tell which of them hold the wanted ranks, and only those are put
    in order, each in a task of its own.
    """
    keys = list(keys)
    rows = df.select(*keys, value.cast("double").alias("v")).filter("v is not null").groupBy(*keys, "v").agg(F.count("*").alias("n"))
    cuts = rows.groupBy(*keys).agg(F.percentile_approx("v", [k / pieces for k in range(1, pieces)], 20 * pieces).alias("cuts"), F.sum("n").alias("total"))
    rows = rows.join(cuts.withColumn("coarse", F.filter("cuts", lambda c, i: i % 16 == 15)), keys)
    below = lambda some: F.size(F.filter(some, lambda c: c <= F.col("v")))
    rows = rows.withColumn("sixteen", 16 * below("coarse")).withColumn("piece", F.col("sixteen") + below(F.slice("cuts", F.col("sixteen") + 1, 15))).drop("cuts", "coarse", "sixteen")
    sizes = rows.groupBy(*keys, "piece").agg(F.sum("n").alias("in_piece"), F.max("total").alias("all"))
    before = Window.partitionBy(*keys).orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.withColumn("base", F.coalesce(F.sum("in_piece").over(before), F.lit(0)))
    place = lambda q: (F.col("all") - 1) * F.lit(float(q))
    ranks = F.array(*[r for q in at for r in (F.floor(place(q)), F.ceil(place(q)))])
    wanted = sizes.withColumn("ranks", F.filter(ranks, lambda r: (r >= F.col("base")) & (r < F.col("base") + F.col("in_piece")))).filter(F.size("ranks") > 0).select(*keys, "piece", "base", "ranks")
    upto = Window.partitionBy(*keys, "piece").orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    ordered = rows.select(*keys, "piece", "v", "n", "total").join(wanted, [*keys, "piece"]).withColumn("end", F.col("base") + F.sum("n").over(upto))
    hit = ordered.withColumn("mine", F.filter("ranks", lambda r: (r >= F.col("end") - F.col("n")) & (r < F.col("end")))).filter(F.size("mine") > 0)
    found = hit.select(*keys, "total", "v", F.explode(F.array_distinct("mine")).alias("rank")).groupBy(*keys, "total").agg(F.map_from_entries(F.collect_list(F.struct("rank", "v"))).alias("of"))

    def quantile(q: float) -> Column:
        x = (F.col("total") - 1) * F.lit(float(q))
        lo, hi = F.element_at("of", F.floor(x)), F.element_at("of", F.ceil(x))
        return F.when(lo == hi, lo).otherwise((F.ceil(x) - x) * lo + (x - F.floor(x)) * hi)

    return found.select(*keys, F.array(*[quantile(q) for q in at]).alias("q"), F.col("total").alias("n"))


def box_stats(trades: DataFrame, unit: str = "weekday", keys=("symbol",)) -> DataFrame:
    """Quartiles (exact), whiskers within 1.5 interquartile ranges, and the number of outliers, by exit clock."""
    of = {"hour": F.hour, "weekday": F.weekday}[unit]
    df = trades.withColumn(unit, of("exit_time").cast("long"))
    keys = [*keys, unit]
    q = exact_quantiles(df, F.col("pnl"), (0.25, 0.5, 0.75), keys)
    q = q.select(*keys, "n", F.col("q")[0].alias("q1"), F.col("q")[1].alias("median"), F.col("q")[2].alias("q3"))
    rows = df.join(q, keys)
    inside = F.col("pnl").between(F.col("q1") - 1.5 * (F.col("q3") - F.col("q1")), F.col("q3") + 1.5 * (F.col("q3") - F.col("q1")))
    w = rows.groupBy(*keys).agg(F.min(F.when(inside, F.col("pnl"))).alias("whisker_low"), F.max(F.when(inside, F.col("pnl"))).alias("whisker_high"), F.count_if(~inside).alias("outliers"))
    return q.join(w, keys)


def r_multiples(trades: DataFrame) -> DataFrame:
    return trades.withColumn("r", F.col("pnl") / over_zero(F.abs("max_adverse")))


def r_and_kelly(trades: DataFrame, keys=("symbol",)) -> DataFrame:
    """Mean R, win rate, payoff and Kelly fraction; payoff and Kelly are null without a loss."""
    gain, loss = F.col("pnl") > 0, F.col("pnl") < 0
    s = r_multiples(trades).groupBy(*keys).agg(F.count("*").alias("trades"), F.avg("r").alias("mean_r"), (F.count_if(gain) / F.count("*")).alias("win_rate"), F.avg(F.when(gain, F.col("pnl"))).alias("__g"), F.avg(F.when(loss, F.col("pnl"))).alias("__l"))
    s = s.withColumn("payoff", F.coalesce("__g", F.lit(0.0)) / F.abs("__l"))
    kelly = F.when(F.col("payoff") > 0, F.col("win_rate") - (1 - F.col("win_rate")) / F.col("payoff"))
    return s.withColumn("kelly", kelly).drop("__g", "__l")


def totals(trades: DataFrame, initial: float = 1000.0, keys=("symbol",)) -> DataFrame:
    """Commission totals and the balance after all results."""
    return trades.groupBy(*keys).agg(F.sum(F.col("commission_open") + F.col("commission_close")).alias("commission"), (initial + F.sum("pnl")).alias("balance"))


def signal_counts(rows: DataFrame, keys=("symbol",)) -> DataFrame:
    return rows.groupBy(*keys).agg(F.count_if(F.col("signal") == 1).alias("buys"), F.count_if(F.col("signal") == -1).alias("sells"))


def best_and_worst(trades: DataFrame, n: int = 20, keys=("symbol",)) -> DataFrame:
    """The n best and the n worst trades per key, with their rank."""
    best = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("pnl"), "id"))
    worst = F.row_number().over(Window.partitionBy(*keys).orderBy(F.asc("pnl"), "id"))
    df = trades.withColumn("best", best.cast("long")).withColumn("worst", worst.cast("long"))
    return df.filter((F.col("best") <= n) | (F.col("worst") <= n))


def last_n(rows: DataFrame, n: int, order: str = "datetime", keys=("symbol",)) -> DataFrame:
    """The last n rows of each series by time, numbered from its end."""
    return positions(rows, "__last", [order], month(order), keys, backwards=True).filter(F.col("__last") <= n).drop("__last")
