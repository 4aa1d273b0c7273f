"""Parameter grids, rolling walk-forward folds, Monte Carlo resampling."""

from __future__ import annotations

from itertools import product

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barline.functions.frames import rolling
from barline.operators.indicators import add_emas_weighted
from barline.operators.ledger import pair_trades, reversal_pnl
from barline.operators.metrics import exact_quantiles


MAX_COMBOS = 10_000


def grid(spark, shorts, longs, buys, sells) -> DataFrame:
    """combo_id in grid order and its parameters; short >= long is left out."""
    rows = [(i, *c) for i, c in enumerate(product(shorts, longs, buys, sells)) if c[0] < c[1]]
    return spark.createDataFrame(rows, "combo_id long, short int, long int, buy double, sell double")


def optimize(candles: DataFrame, params: DataFrame, initial: float = 1000.0, rsi_period: int = 14, min_bars: int = 200, keys=("symbol",)) -> DataFrame:
    """equity, pnl and win rate of every combination per key, and its rank (first in grid order wins ties).

    Means are made once per distinct period; rows without a signal go before
    the keyed windows. ``params``, a grid of at most MAX_COMBOS combinations, is
    an array that every row carries through one explode: no join. A longer grid
    goes in several calls.
    """
    keys = list(keys)
    grid = params.select("combo_id", "short", "long", "buy", "sell").limit(MAX_COMBOS + 1).collect()
    if len(grid) > MAX_COMBOS:
        raise ValueError(f"more than {MAX_COMBOS} combinations: split the grid")
    periods = sorted({p for r in grid for p in (r["short"], r["long"])})
    names = {"combo_id": "long", "short": "int", "long": "int", "buy": "double", "sell": "double"}
    combos = F.array(*[F.struct(*[F.lit(r[n]).cast(t).alias(n) for n, t in names.items()]) for r in grid]) if grid else F.array().cast("array<struct<combo_id:bigint,short:int,long:int,buy:double,sell:double>>")
    w = Window.partitionBy(*keys).orderBy("bar_idx")
    enough = F.count("*").over(Window.partitionBy(*keys)) >= min_bars
    df = candles.withColumn("__enough", enough).filter("__enough")
    delta = F.col("close") - F.lag("close").over(w)
    df = df.withColumns({"__up": F.when(delta > 0, delta).otherwise(0.0), "__down": F.when(delta < 0, -delta).otherwise(0.0)})
    up, down = rolling(F.avg, F.col("__up"), w, rsi_period), rolling(F.avg, F.col("__down"), w, rsi_period)
    means = F.map_from_arrays(F.array(*[F.lit(p) for p in periods]), F.array(*[rolling(F.avg, F.col("close"), w, p) for p in periods]))
    df = df.select(*keys, "bar_idx", "datetime", "close", F.coalesce(100 - 100 / (1 + up / F.when(down != 0, down)), F.lit(50.0)).alias("rsi"), means.alias("means"))
    rows = df.withColumn("__c", F.explode(combos)).select(*df.columns, "__c.*")
    short, long = F.col("means")[F.col("short")], F.col("means")[F.col("long")]
    signal = F.when((short > long) & (F.col("rsi") > F.col("buy")), 1).when((short < long) & (F.col("rsi") < F.col("sell")), -1).otherwise(0)
    rows = rows.withColumn("signal", signal).filter("signal <> 0").drop("means")
    pairs = pair_trades(rows, (*keys, "combo_id")).groupBy(*keys, "combo_id").agg(F.sum("pnl").alias("pnl"), F.count_if(F.col("pnl") > 0).alias("wins"), F.count("*").alias("trades"))
    all_ = df.select(*keys).distinct().withColumn("__c", F.explode(combos)).select(*keys, "__c.*").join(pairs, [*keys, "combo_id"], "left")
    out = all_.select(*keys, "combo_id", "short", "long", "buy", "sell", (initial + F.coalesce("pnl", F.lit(0.0))).alias("equity_final"), F.coalesce(F.col("wins") / F.col("trades"), F.lit(0.0)).alias("win_rate"))
    return out.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(F.round("equity_final", 6).desc(), "combo_id")).cast("long"))  # the same trades summed in another order are a tie


def folds(candles: DataFrame, window_days: int = 30, every_days: int = 7) -> DataFrame:
    """Candles repeated per rolling fold: fold_end and the bars of the ``window_days`` before it.

    Fold ends step from the first bar plus the window to the last bar; a bar
    belongs to at most ceil(window / every) folds, so this is an explode.
    """
    day = 86_400
    first = F.min("datetime").over(Window.partitionBy("symbol"))
    last = F.max("datetime").over(Window.partitionBy("symbol"))
    df = candles.withColumns({"__age": F.timestamp_diff("SECOND", first, F.col("datetime")), "__span": F.timestamp_diff("SECOND", first, last), "__first": first})
    k = F.greatest(F.ceil((F.col("__age") - window_days * day) / (every_days * day)), F.lit(0).cast("long"))
    upto = F.least(F.floor(F.col("__age") / (every_days * day)), F.floor((F.col("__span") - window_days * day) / (every_days * day)))
    df = df.withColumn("fold", F.explode(F.when(upto >= k, F.sequence(k, upto)).otherwise(F.array().cast("array<bigint>"))))
    inside = (F.col("__age") >= F.col("fold") * every_days * day) & (F.col("__age") <= F.col("fold") * every_days * day + window_days * day)
    return df.filter(inside).drop("__age", "__span", "__first")


def walk_forward(candles: DataFrame, params: DataFrame, window_days: int = 30, every_days: int = 7, min_bars: int = 200) -> DataFrame:
    """The best combination per symbol and fold."""
    return optimize(folds(candles, window_days, every_days), params, min_bars=min_bars, keys=("symbol", "fold")).filter("rank = 1").drop("rank")


def ema_grid(candles: DataFrame, fast=range(5, 15), slow=range(15, 35), commission: float = 0.0, slippage: float = 0.0) -> DataFrame:
    """Net profit by symbol and fast period (rows) and slow period (columns s15, ...).

    Every EMA is made once, all in one scan; each combination is a key of its
    own. A combination without a trade is null.
    """
    df = add_emas_weighted(candles, {f"__e{p}": p for p in sorted({*fast, *slow})})
    combos = F.array(*[F.struct(F.lit(f).alias("fast"), F.lit(s).alias("slow"), F.signum(F.col(f"__e{f}") - F.col(f"__e{s}")).cast("int").alias("signal")) for f in fast for s in slow if f < s])
    rows = df.select("symbol", "bar_idx", "close", F.explode(combos).alias("c")).select("symbol", "bar_idx", "close", "c.*")
    trades = reversal_pnl(rows, commission, slippage, ("symbol", "fast", "slow"))
    return trades.withColumn("s", F.concat(F.lit("s"), "slow")).groupBy("symbol", "fast").pivot("s", [f"s{s}" for s in slow]).agg(F.sum("pnl"))


def mix(*parts: Column) -> Column:
    """A reproducible 31-bit number from integer columns, by arithmetic that any SQL has."""
    x = F.lit(17).cast("long")
    for p in parts:
        x = (x * 1103515245 + p.cast("long") + 12345) % 2147483648
        x = (x * 69069 + 1) % 2147483648
    return x


def monte_carlo(trades: DataFrame, sims: int, mode: str = "shuffle", initial: float = 1000.0, seed: int = 7) -> DataFrame:
    """Final equity and worst drawdown (value) per symbol and simulation.

    shuffle orders the trades by a hash of (seed, sim, trade); bootstrap draws
    trade indices from it. Randomness comes from integer arithmetic alone.
    """
    n = F.count("*").over(Window.partitionBy("symbol"))
    base = trades.select("symbol", "pnl", (F.row_number().over(Window.partitionBy("symbol").orderBy("id")) - 1).cast("long").alias("k"), n.alias("n"))
    runs = base.select("symbol", "k", "n", "pnl", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(sims - 1).cast("long"))).alias("sim"))
    draw = mix(F.lit(seed), F.col("sim"), F.col("k"))
    if mode == "bootstrap":
        drawn = runs.select("symbol", "sim", F.col("k").alias("pos"), (draw % F.col("n")).alias("k"))
        runs = drawn.join(base.select("symbol", "k", "pnl"), ["symbol", "k"])
        order = ["pos"]
    else:
        runs = runs.withColumn("draw", draw)
        order = ["draw", "k"]
    w = Window.partitionBy("symbol", "sim").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    runs = runs.withColumn("equity", initial + F.sum("pnl").over(w))
    runs = runs.withColumn("dd", F.col("equity") - F.max("equity").over(w))
    return runs.groupBy("symbol", "sim").agg((initial + F.sum("pnl")).alias("final_equity"), F.min("dd").alias("max_dd"))


def monte_carlo_summary(sims: DataFrame) -> DataFrame:
    """Mean, median and worst of the final equity and the drawdown.

    Means are decimals: exact sums of values of 6 digits, divided once.
    """
    exact = lambda c: F.avg(F.col(c).cast("decimal(20,6)"))
    out = sims.groupBy("symbol").agg(exact("final_equity").alias("mean_final"), F.min("final_equity").alias("worst_final"), exact("max_dd").alias("mean_dd"), F.min("max_dd").alias("worst_dd"))
    for name, column in (("median_final", "final_equity"), ("median_dd", "max_dd")):
        out = out.join(exact_quantiles(sims, F.col(column), (0.5,)).select("symbol", F.col("q")[0].alias(name)), "symbol", "left")
    return out.select("symbol", "mean_final", "median_final", "worst_final", "mean_dd", "median_dd", "worst_dd")
