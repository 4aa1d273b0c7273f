"""Writers: ledgers, tables, JSON feeds; batch and per micro-batch."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barline.functions.formatting import finite
from barline.scratch import remove


def write_ledger(trades: DataFrame, path: str, fmt: str = "parquet", mode: str = "append") -> None:
    """The ledger, one folder per open date."""
    trades.withColumn("trade_date", F.to_date("entry_time")).write.partitionBy("trade_date").mode(mode).format(fmt).save(path)


def append_table(rows: DataFrame, path: str, fmt: str = "parquet") -> None:
    rows.write.mode("append").format(fmt).save(path)


def export_equity_csv(equity: DataFrame, path: str) -> None:
    equity.select(F.col("timestamp").cast("string"), "equity").write.mode("overwrite").option("header", True).csv(path)


def write_feeds(feeds: dict[str, DataFrame], path: str) -> None:
    """JSON-safe records of each feed (candles, trades, book, gaps, equity)."""
    for name, rows in feeds.items():
        finite(rows).write.mode("overwrite").json(f"{path}/{name}")


# --- upserted tables ----------------------------------------------------------------
#
# <path>/data/part=P/version=V holds a part of the keys (by hash) as batch V left it;
# <path>/manifest/version=V says which version of each part is the table after batch V.

PARTS = 64


def upsert_sink(path: str, keys: list[str], seq: str, parts: int = PARTS):
    """A foreachBatch function that keeps the last write of each key in a Parquet table.

    A batch rewrites only the parts that its keys fall in, beside their old
    files, and then one small manifest. A batch that failed before its manifest
    changes nothing and can be tried again: it overwrites its own files alone.
    Files that neither the newest nor the manifest before it names are removed,
    so readers of the last version are not disturbed. ``parts`` bounds what the
    driver holds; it must stay the same for a table.
    """
    from barline.operators.candles import upsert

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        before = _manifest(spark, path, batch_id)
        old = before or {}
        part = F.pmod(F.xxhash64(*keys), F.lit(parts)).alias("part")
        new = upsert(batch, batch.limit(0), keys, seq)
        touched = sorted(r["part"] for r in new.select(part).distinct().collect())
        known = [f"{path}/data/part={p}/version={old[p]}" for p in touched if p in old]
        if known:
            new = upsert(spark.read.schema(batch.schema).parquet(*known), batch, keys, seq)
        rows = new.select("*", part, F.lit(batch_id).cast("long").alias("version")).repartition(min(parts, max(1, len(touched))), "part")
        writer = lambda df: df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        writer(rows).partitionBy("part", "version").parquet(f"{path}/data")
        table = sorted({**old, **{p: batch_id for p in touched}}.items())
        named = spark.createDataFrame([(p, v, batch_id) for p, v in table] or [(-1, -1, batch_id)], "part long, at long, version long")
        writer(named.coalesce(1)).partitionBy("version").parquet(f"{path}/manifest")
        _clean(spark, path, batch_id, old, dict(table))

    return write


def _manifests(spark, path: str) -> DataFrame | None:
    try:
        return spark.read.schema("part long, at long, version long").parquet(f"{path}/manifest")
    except AnalysisException as e:
        if "PATH_NOT_FOUND" in str(e):
            return None
        raise


def _manifest(spark, path: str, before: int | None = None) -> dict[int, int] | None:
    """The version of each part of the newest table (that of a batch below ``before``)."""
    every = _manifests(spark, path)
    if every is None:
        return None
    every = every if before is None else every.filter(F.col("version") < before)
    newest = every.agg(F.max("version")).first()[0]
    return None if newest is None else {r["part"]: r["at"] for r in every.filter(F.col("version") == newest).collect() if r["part"] >= 0}


def _clean(spark, path: str, batch_id: int, old: dict[int, int], new: dict[int, int]) -> None:
    """Removes manifests before the last two, and files that only they name."""
    every = _manifests(spark, path).filter(F.col("version") < batch_id)
    last = every.agg(F.max("version")).first()[0]
    gone = [] if last is None else every.filter(F.col("version") < last).collect()
    for part, at in sorted({(r["part"], r["at"]) for r in gone if r["part"] >= 0} - set(old.items()) - set(new.items())):
        remove(spark, f"{path}/data/part={part}/version={at}")
    for version in sorted({r["version"] for r in gone}):
        remove(spark, f"{path}/manifest/version={version}")


def latest(spark, path: str, before: int | None = None) -> DataFrame | None:
    """The newest version of an upserted table (below ``before``), None if there is none."""
    parts = _manifest(spark, path, before)
    return spark.read.parquet(*[f"{path}/data/part={p}/version={v}" for p, v in sorted(parts.items())]) if parts else None
