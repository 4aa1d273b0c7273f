"""Exact dedup: a two-pass Bloom filter separates the rows that may repeat.

Pass 1 counts, per filter cell, how many rows hit it (0, 1, 2 or more). A text
that occurs twice has all its cells at "2 or more", so the bits of those cells
form a filter of *possibly repeated* hashes with no false negative. Pass 2
probes it: a row that misses is unique and goes straight to the result; only
the rest (repeats and about 0.3 % false positives) shuffle, by their hash.

The filter is the only thing sent to every task. Its size is bounded by
``max_filter_bits``; a larger input is cut into hash segments, each with a
filter of its own. A segment's round reads only that segment's hashes, writes
its marked rows and takes its filter back, so neither the driver nor the plan
grows with the rounds. A filter has ``bits_per_row`` bits a row, up to 256 MB in
a Python worker by default: 30 billion rows are then 224 rounds, or 28 with 2 GB
filters (``max_filter_bits = 1 << 34``). Texts never shuffle.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barline import ship
from barline.llm.common import full_text, materialize, scratch_dir, squeeze

HASHES = 4
CHUNK_BITS = 1 << 20


def _cells(keys: np.ndarray, n_bits: int) -> np.ndarray:
    """(HASHES, n) cells of the keys; n_bits is a power of two."""
    keys = keys.astype(np.uint64)
    step = (keys >> np.uint64(32)) | np.uint64(1)
    i = np.arange(HASHES, dtype=np.uint64)[:, None]
    return (keys + i * step) & np.uint64(n_bits - 1)


def repeat_filter(keys: DataFrame, n_bits: int) -> np.ndarray:
    """Pass 1: packed bits of the cells that two or more rows hit.

    ``keys`` has one long column ``key``. A task sends its touched cells once
    each, a chunk of the filter is merged by one group, and the driver gets
    n_bits / 8 bytes in all.
    """
    chunk_bits = min(CHUNK_BITS, n_bits)
    chunks = n_bits // chunk_bits

    def touched(batches):
        def flush(held):
            cells, counts = np.unique(_cells(np.concatenate(held), n_bits), return_counts=True)
            cut = np.searchsorted(cells, np.arange(chunks + 1, dtype=np.uint64) * np.uint64(chunk_bits))
            for c in range(chunks):
                mine, many = (cells[cut[c] : cut[c + 1]] % np.uint64(chunk_bits)).astype(np.uint32), counts[cut[c] : cut[c + 1]] > 1
                if len(mine):
                    yield {"chunk": c, "once": mine[~many].tobytes(), "twice": mine[many].tobytes()}

        held, n = [], 0
        for batch in batches:
            held.append(batch["key"].to_numpy(np.int64))
            n += len(batch)
            if n >= 500_000:
                yield pd.DataFrame(flush(held))
                held, n = [], 0
        if n:
            yield pd.DataFrame(flush(held))

    def merged(pdf: pd.DataFrame) -> pd.DataFrame:
        seen = np.zeros(chunk_bits, np.uint8)
        for once, twice in zip(pdf["once"], pdf["twice"]):
            cells = np.frombuffer(once, np.uint32)
            seen[cells] = np.minimum(seen[cells] + 1, 2)
            seen[np.frombuffer(twice, np.uint32)] = 2
        return pd.DataFrame({"chunk": [int(pdf["chunk"].iloc[0])], "bits": [np.packbits(seen > 1).tobytes()]})

    sent = keys.mapInPandas(touched, "chunk int, once binary, twice binary")
    bits = np.zeros(n_bits // 8, np.uint8)
    size = chunk_bits // 8
    for row in sent.groupBy("chunk").applyInPandas(merged, "chunk int, bits binary").toLocalIterator():
        bits[row["chunk"] * size : (row["chunk"] + 1) * size] = np.frombuffer(row["bits"], np.uint8)
    return bits


def possibly_repeated(shared, n_bits: int):
    """Pass 2: a column function that is false only for keys seen once; ``shared`` is the broadcast filter."""

    @F.pandas_udf("boolean")
    def probe(key: pd.Series) -> pd.Series:
        cells = _cells(key.to_numpy(np.int64), n_bits)
        hit = (shared.value[cells >> np.uint64(3)] >> (np.uint64(7) - (cells & np.uint64(7))).astype(np.uint8)) & 1
        return pd.Series(hit.all(axis=0))

    return probe


def exact_dedup(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    bits_per_row: int = 16,
    max_filter_bits: int = 1 << 31,
    salt_rows: int = 1_000_000,
) -> DataFrame:
    """One row per input row: its group of equal texts and the row that stays.

    Texts are equal when they are the same without white space. The longest
    original (in code points) stays, then the smallest id, a null id last;
    of rows that repeat with the same id and text exactly one stays.

    Defined cases: a null text counts as empty, so all empty, blank and null
    texts are one group; an empty table gives an empty result; columns of the
    input other than id and text are ignored, whatever their names. A hot group
    is dealt out in parts, one per ``salt_rows`` rows of the input and 64 at
    least, so no task gets a whole group.
    """
    spark = docs.sparkSession
    ship(spark)
    text = full_text(text_col)
    rows = docs.select(F.col(id_col).alias("doc_id"), text.alias("text")).select(
        "doc_id",
        F.length("text").cast("long").alias("n_chars"),
        F.unhex(F.sha2(squeeze(F.col("text")), 256)).alias("sha"),
    )
    rows = rows.select("*", F.xxhash64("sha").alias("key"), F.monotonically_increasing_id().alias("uid"))
    total = docs.count()
    n_bits = 1 << max(13, min(int(total * bits_per_row), max_filter_bits).bit_length())
    n_bits = min(n_bits, max_filter_bits)
    segments = max(1, -(-total * bits_per_row // max_filter_bits))
    rows = materialize(rows.withColumn("segment", F.expr(f"cast(pmod(shiftright(key, 40), {segments}) as int)")), *["segment"] * (segments > 1))

    path = scratch_dir(spark)
    for s in range(segments):
        part = rows.filter(F.col("segment") == s).drop("segment")
        shared = spark.sparkContext.broadcast(repeat_filter(part.select("key"), n_bits))
        part.withColumn("maybe", possibly_repeated(shared, n_bits)("key")).write.mode("append").parquet(path)
        shared.unpersist()
    marked = spark.read.schema(rows.drop("segment").withColumn("maybe", F.lit(True)).schema).parquet(path)

    salts = max(64, total // salt_rows)
    maybe = marked.filter("maybe").withColumn("salt", F.expr(f"pmod(hash(uid), {salts})"))
    best = F.min(F.struct((-F.col("n_chars")).alias("len"), F.col("doc_id").isNull().alias("no_id"), "doc_id", "uid"))
    parts = maybe.groupBy("sha", "salt").agg(best.alias("best"), F.count("*").alias("n"))
    groups = parts.groupBy("sha").agg(F.min("best").alias("best"), F.sum("n").alias("group_size"))
    grouped = maybe.join(parts.select("sha", "salt").join(groups, "sha"), ["sha", "salt"]).select(
        "doc_id",
        F.col("best.doc_id").alias("keep_id"),
        "group_size",
        (F.col("uid") == F.col("best.uid")).alias("kept"),
        "sha",
    )
    unique = marked.filter("not maybe").select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "sha")
    return unique.union(grouped).select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("sha")).alias("text_sha256"))


ORACLE = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
h AS (SELECT doc_id, length(t) AS n, sha256(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) AS text_sha256 FROM d)
SELECT doc_id,
       first_value(doc_id) OVER w AS keep_id,
       count(*) OVER (PARTITION BY text_sha256) AS group_size,
       doc_id = first_value(doc_id) OVER w AS kept,
       text_sha256
FROM h WINDOW w AS (PARTITION BY text_sha256 ORDER BY n DESC, doc_id)
"""
