"""Order book snapshots: levels, depth, best prices, changes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def top_levels(books: DataFrame, n: int = 25) -> DataFrame:
    """The first n levels of each side, in message order."""
    return books.withColumn("bids", F.slice("bids", 1, n)).withColumn("asks", F.slice("asks", 1, n))


def levels(books: DataFrame) -> DataFrame:
    """symbol, snapshot_ts, side, price, qty, level (1 = best) from arrays of [price, qty].

    Every message numbers its own levels; equal prices keep their order in it.
    """

    def ranked(column: str, sign: int):
        level = lambda x, i: F.struct((sign * x[0].cast("double")).alias("rank"), i.alias("place"), x[0].cast("double").alias("price"), x[1].cast("double").alias("qty"))
        return F.array_sort(F.transform(F.col(column), level))

    sides = F.array(*[F.struct(F.lit(s).alias("side"), ranked(c, sign).alias("ls")) for s, c, sign in (("bid", "bids", -1), ("ask", "asks", 1))])
    rows = books.select("symbol", "snapshot_ts", F.explode(sides).alias("s")).select("symbol", "snapshot_ts", "s.side", F.posexplode("s.ls").alias("level", "l"))
    return rows.select("symbol", "snapshot_ts", "side", "l.price", "l.qty", (F.col("level") + 1).cast("long").alias("level"))


def depth(rows: DataFrame) -> DataFrame:
    """Adds cumulative quantity, its share of the side, the notional and the size relative to the book's largest level.

    A book is all messages of a symbol and instant; their levels of one number are one step of its depth.
    """
    book = Window.partitionBy("symbol", "snapshot_ts")
    side = Window.partitionBy("symbol", "snapshot_ts", "side")
    cum = F.sum("qty").over(side.orderBy("level").rangeBetween(Window.unboundedPreceding, Window.currentRow))
    return rows.withColumns({"cum_qty": cum, "share": cum / F.sum("qty").over(side), "notional": F.col("price") * F.col("qty"), "relative": F.col("qty") / F.max("qty").over(book)})


def best_prices(rows: DataFrame) -> DataFrame:
    """Best bid and ask and their middle; null where a side is empty."""
    bid, ask = F.max(F.when(F.col("side") == "bid", F.col("price"))), F.min(F.when(F.col("side") == "ask", F.col("price")))
    return rows.groupBy("symbol", "snapshot_ts").agg(bid.alias("best_bid"), ask.alias("best_ask"), ((bid + ask) / 2).alias("mid"))


def changes(rows: DataFrame) -> DataFrame:
    """Each level against the snapshot before: up, down or same; a level not seen there was 0."""
    n = rows.select("symbol", "snapshot_ts").distinct().withColumn("snap_no", F.row_number().over(Window.partitionBy("symbol").orderBy("snapshot_ts")))
    numbered = rows.join(n, ["symbol", "snapshot_ts"])
    before = numbered.select("symbol", "side", "price", (F.col("snap_no") + 1).alias("snap_no"), F.col("qty").alias("old_qty"))
    joined = numbered.join(before, ["symbol", "side", "price", "snap_no"], "left").withColumn("old_qty", F.coalesce("old_qty", F.lit(0.0)))
    return joined.withColumn("change", F.when(F.col("qty") > F.col("old_qty"), "up").when(F.col("qty") < F.col("old_qty"), "down").otherwise("same"))
