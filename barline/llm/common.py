"""Small pieces that several corpus operators share."""

from __future__ import annotations

import gc

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from barline.scratch import materialize, remove, scratch_base, scratch_dir, settled  # noqa: F401  (the operators' folders)

# Fixed value: the white-space class of every contract, [\x20\x09-\x0D].
SPACES = " \t\n\x0b\x0c\r"
SPACE_RE = r"[\x20\x09-\x0D]+"
#: A key is hot if it has 1/PARTS of the rows or more.
PARTS = 10_000


def full_text(col: str | Column = "text") -> Column:
    """The text, with null read as empty."""
    return F.coalesce(F.col(col) if isinstance(col, str) else col, F.lit("")).cast("string")


def squeeze(text: Column) -> Column:
    """The text without any white space."""
    return F.translate(text, SPACES, "")


def words(text: Column) -> Column:
    """array<string> of the maximal runs of non-space characters."""
    trimmed = F.btrim(text, F.lit(SPACES))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, SPACE_RE))


def n_words(text: Column) -> Column:
    return F.size(words(text)).cast("long")


def ascii_lower(text: Column) -> Column:
    """Lower-cases A-Z only (a text of ASCII alone takes the quicker way)."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, upper, upper.lower()))


def release(spark: SparkSession) -> None:
    """Lets Spark remove the shuffle files of finished plans: it does so once the driver's JVM has dropped them."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def narrow(df: DataFrame, rows: int, per_task: int = 100_000) -> DataFrame:
    """``df``, of ``rows`` narrow rows at most, in no more partitions than they are worth: two a core, or one for ``per_task`` rows.

    A small table is else a file and a task for each shuffle partition, however many a cluster is set to.
    """
    return df.coalesce(max(2 * df.sparkSession.sparkContext.defaultParallelism, -(-rows // per_task)))


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once, however often body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def join_hot_cold(rows: DataFrame, groups: DataFrame, on: list[str], weight: str, total: int, parts: int = PARTS, cold: bool = True, hot: bool = True) -> DataFrame:
    """Inner join of ``rows`` with one-row-per-key ``groups`` without a hot task.

    ``weight`` is the number of ``rows`` of a key, ``total`` that of all. At most
    ``parts`` keys can hold total/parts rows each: those are broadcast, and the
    rows of the others, none of them hot, shuffle. ``cold`` is false if there are
    no others (see ``has_cold``), ``hot`` if there are only others: either leaves
    one join.
    """
    if not cold:
        return rows.join(F.broadcast(groups), on)
    if not hot:
        return rows.join(groups, on)
    is_hot = F.col(weight) * parts >= total
    heavy, light = F.broadcast(groups.filter(is_hot)), groups.filter(~is_hot)
    rest = rows.join(F.broadcast(groups.filter(is_hot).select(*on)), on, "left_anti")
    return rows.join(heavy, on).unionByName(rest.join(light, on))


def has_cold(groups: DataFrame, weight: str, total: int, parts: int = PARTS) -> bool:
    """Whether any of ``groups`` is too light to be broadcast by ``join_hot_cold``."""
    return not groups.filter(F.col(weight) * parts < total).isEmpty()
