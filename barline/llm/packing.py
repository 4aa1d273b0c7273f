"""Best-fit packing with large-item matching, planned on the size histogram.

Items are document pieces of 1 to ``capacity`` tokens, so there are at most
``capacity`` different sizes: the plan is made for sizes and counts (the only
thing the driver sees), and applies to any number of documents. Items above a
third of the capacity can share a bin only in pairs: from the largest down,
each is matched with the largest partner that fits. Smaller items, from the
largest down, best-fit the remaining gaps, all equal gaps at once; new bins
open when no gap fits.

The r-th item of a size then looks up its place in the plan; ranks are
two-level (hash buckets, then rows), so a size that a third of all rows share
is spread over many tasks.
"""

from __future__ import annotations

import bisect
import functools
import zlib
from array import array
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barline import ship
from barline.llm.common import full_text, materialize

CAPACITY = 2048
CACHED_WORDS = 500_000


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _byte_letters() -> dict[int, int]:
    """The byte-level alphabet: printable bytes stand for themselves, the others for 256, 257, ..."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {b: b for b in plain} | {b: 256 + i for i, b in enumerate(rest)}


@functools.lru_cache(maxsize=2)
def _encoder(path: str) -> Callable[[list[str]], list[bytes]]:
    """Texts to little-endian uint32 ids, each text followed by id 0.

    No token of this vocabulary spans white space, which is dropped: a text's ids
    are those of its words, kept in a cache of bounded size. A word of Latin
    letters, perhaps with stops after it, goes straight to the tokenizer's BPE
    model, as its normalizer and splitter would pass it on; any other word takes
    the whole tokenizer.
    """
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    model, letters = tokenizer.model, _byte_letters()
    cache: dict[bytes, bytes] = {}

    def whole(word: bytes) -> bytes:
        return array("I", tokenizer.encode(word.decode("utf-8", "surrogatepass"), add_special_tokens=False).ids).tobytes()

    def latin(core: bytes) -> str | None:
        """What the BPE model gets for a word of Latin letters, else None."""
        if core.isalpha():
            return core.decode()
        if core.isascii():
            return None
        s = core.decode("utf-8", "surrogatepass")
        if s.isalpha() and max(s) < "\u0250" and (s := s.lower()).isalpha():
            return s.encode().decode("latin-1").translate(letters)
        return None

    def ids(word: bytes) -> bytes:
        core = word.rstrip(b".,!?;:")
        if core and len(core) < len(word):
            if (sent := latin(core)) is None:
                return whole(word)
            tail = word[len(core) :]
            for part in (core, tail):
                if part not in cache:
                    cache[part] = ids(part) if part is core else whole(part)
            return cache[core] + cache[tail]
        sent = latin(core)
        return whole(word) if sent is None else array("I", [t.id for t in model.tokenize(sent)]).tobytes()

    def encode(texts: list[str]) -> list[bytes]:
        split = [t.encode("utf-8", "surrogatepass").lower().split() for t in texts]
        if len(cache) > CACHED_WORDS:
            cache.clear()
        for w in set().union(*split):
            if w not in cache:
                cache[w] = ids(w)
        return [b"".join(map(cache.__getitem__, ws)) + b"\0\0\0\0" for ws in split]

    return encode


def token_pieces(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows doc_id, piece, start, length, ids_crc32: documents cut at ``capacity``."""
    ship(docs.sparkSession)
    path = tokenizer or default_tokenizer()
    id_type = docs.schema[id_col].dataType.simpleString()

    def cut(batches):
        encode = _encoder(path)
        for batch in batches:
            for at in range(0, len(batch), 256):
                part = batch.iloc[at : at + 256]
                out = [
                    (i, piece, piece * capacity, len(chunk) // 4, zlib.crc32(chunk))
                    for i, ids in zip(part["doc_id"].tolist(), encode(part["text"].tolist()))
                    for piece, chunk in enumerate(ids[b : b + 4 * capacity] for b in range(0, len(ids), 4 * capacity))
                ]
                yield pd.DataFrame(out, columns=["doc_id", "piece", "start", "length", "ids_crc32"]).astype({"doc_id": object})

    rows = docs.select(F.col(id_col).alias("doc_id"), full_text(text_col).alias("text"))
    return rows.select(F.col("doc_id").cast("string"), "text").mapInPandas(cut, "doc_id string, piece int, start long, length long, ids_crc32 long").withColumn("doc_id", F.col("doc_id").cast(id_type))


def plan_bins(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int]]:
    """Segments (size, first rank, items per bin, first bin, offset).

    Items of a size with ranks from ``first rank`` up to the next segment fill
    bins one after another, ``items per bin`` in each, from ``offset`` on.
    """
    left = {s: n for s, n in counts.items() if n > 0}
    used = dict.fromkeys(left, 0)
    segments: list[tuple[int, int, int, int, int]] = []
    gaps: dict[int, list[tuple[int, int]]] = {}  # gap: ranges (first bin, bins)
    order: list[int] = []  # the gaps that there are, ascending
    bins = 0

    def open_gap(gap: int, first: int, n: int) -> None:
        if gap > 0 and n > 0:
            if gap not in gaps:
                bisect.insort(order, gap)
                gaps[gap] = []
            gaps[gap].append((first, n))

    def put(size: int, per_bin: int, first: int, offset: int, n: int) -> None:
        segments.append((size, used[size], per_bin, first, offset))
        used[size] += n
        left[size] -= n

    large = sorted(s for s in left if 3 * s > capacity)
    for s in reversed(large):
        while left[s]:
            at = bisect.bisect_right(large, min(s, capacity - s)) - 1
            while at >= 0 and left[large[at]] < (2 if large[at] == s else 1):
                at -= 1
            if at < 0:
                first, bins = bins, bins + left[s]
                open_gap(capacity - s, first, left[s])
                put(s, 1, first, 0, left[s])
                continue
            p = large[at]
            n = left[s] // 2 if p == s else min(left[s], left[p])
            first, bins = bins, bins + n
            if p == s:
                put(s, 2, first, 0, 2 * n)
            else:
                put(s, 1, first, 0, n)
                put(p, 1, first, s, n)
            open_gap(capacity - s - p, first, n)

    for s in sorted((s for s in left if 3 * s <= capacity), reverse=True):
        while left[s]:
            at = bisect.bisect_left(order, s)
            if at == len(order):
                per = capacity // s
                n = -(-left[s] // per)
                open_gap(capacity, bins, n)
                bins += n
                continue
            gap = order[at]
            first, n = gaps[gap].pop()
            if not gaps[gap]:
                del gaps[gap], order[at]
            per = min(gap // s, left[s])
            full = min(n, left[s] // per)
            put(s, per, first, capacity - gap, full * per)
            open_gap(gap - per * s, first, full)
            open_gap(gap, first + full, n - full)
    return segments


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Adds sequence_id and offset to the rows of ``pieces`` (length: 1..capacity)."""
    spark = pieces.sparkSession
    items = materialize(pieces.withColumn("uid", F.monotonically_increasing_id()))
    counts = {r["length"]: r["count"] for r in items.groupBy("length").count().collect()}  # at most `capacity` rows
    segments = sorted(plan_bins(counts, capacity)) or [(0, 0, 1, 0, 0)]
    plan = spark.sparkContext.broadcast(np.array(segments, np.int64).T)
    buckets = max(1, int(sum(counts.values()) ** 0.5))

    items = items.withColumn("bucket", F.expr(f"pmod(xxhash64(uid), {buckets})"))
    sums = items.groupBy("length", "bucket").agg(F.count("*").alias("n"))
    ahead = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("length", "bucket", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("base"))
    within = F.row_number().over(Window.partitionBy("length", "bucket").orderBy("uid")) - 1
    ranked = items.withColumn("rank", within).join(sums, ["length", "bucket"]).withColumn("rank", F.col("rank") + F.col("base"))

    @F.pandas_udf("sequence_id long, offset long")
    def place(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        size, first_rank, per, first_bin, offset = plan.value
        length, rank = length.to_numpy(np.int64), rank.to_numpy(np.int64)
        at = np.searchsorted((size << 42) + first_rank, (length << 42) + rank, "right") - 1
        r = rank - first_rank[at]
        return pd.DataFrame({"sequence_id": first_bin[at] + r // per[at], "offset": offset[at] + r % per[at] * length})

    placed = ranked.withColumn("place", place("length", "rank"))
    return placed.select(*pieces.columns, "place.sequence_id", "place.offset")


def pack_documents(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    Defined cases: a null or empty text is the single end id 0 (a piece of one
    token); only documents longer than ``capacity`` are cut; repeated rows are
    packed as often as they come; a null id stays null; an empty table gives an
    empty result; further columns are ignored.
    """
    return pack(token_pieces(docs, tokenizer, capacity, id_col, text_col), capacity)
