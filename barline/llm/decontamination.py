"""Benchmark decontamination: an FM-index per training shard, searched for all benchmark windows.

A task cuts its documents into shards of at most about ``shard_words`` words and
indexes each: words become numbers of the benchmark's vocabulary (a word that no
item has ends a run, and runs shorter than the shortest window hold no
occurrence), the suffixes of the runs are sorted, and a wavelet tree over the
Burrows-Wheeler transform answers ranks. All distinct windows are searched
backwards at once; their occurrences are located by walking to the next sampled
suffix position; covered words of a document merge into removal spans.

The benchmark goes to the tasks in blocks of at most about ``block_words``
words (a stated query set against all rows, in blocks): a block is what the
driver collects and broadcasts, whatever the benchmark's size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barline import ship
from barline.llm.common import full_text, materialize

WINDOW = 10
SAMPLE = 16
SHARD_WORDS = 1 << 20
BLOCK_WORDS = 1 << 21
#: Bytes of words stay (A-Z in lower case), all others part words: [^\x00-\x2F\x3A-\x60\x7B-\x7F] after lower-casing.
BYTES = bytes(c if c >= 0x80 or chr(c).isalnum() else 0x20 for c in bytes(range(256)).lower())
SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


def words_of(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(BYTES).split()


# --- index ------------------------------------------------------------------------


def suffix_order(text: np.ndarray, bits: int) -> np.ndarray:
    """The order of all suffixes; ``text`` ends with 0, and every 0 is an end mark of its own, by position.

    Four symbols are sorted at first; then, as long as suffixes tie, those that
    do are sorted by their rank and that of the rest behind what is known.
    """
    n, known = len(text), 4
    padded = np.concatenate([text, np.zeros(known, text.dtype)]).astype(np.uint64)
    key, ended = np.zeros(n, np.uint64), np.zeros(n, bool)
    for k in range(known):
        symbol = padded[k : k + n]
        key = (key << np.uint64(bits)) | np.where(ended, 0, symbol).astype(np.uint64)
        ended |= symbol == 0
    order = np.argsort(key, kind="stable")
    first = np.ones(n, bool)
    first[1:] = (key[order][1:] != key[order][:-1]) | ended[order][1:]
    while True:
        group = np.maximum.accumulate(np.where(first, np.arange(n), 0))
        rank = np.empty(n, np.int64)
        rank[order] = group
        alone = first & np.append(first[1:], True)
        slots = np.flatnonzero(~alone)
        if not len(slots):
            return order
        tied = order[slots]
        key = rank[tied] * n + rank[tied + known]
        again = np.argsort(key, kind="stable")
        order[slots] = tied[again]
        key = key[again]
        first[slots[1:]] |= key[1:] != key[:-1]
        known *= 2


class WaveletTree:
    """Ranks of symbols in a sequence: a level per bit, each with the ones before every place."""

    def __init__(self, sequence: np.ndarray, bits: int):
        self.levels = []
        for shift in range(bits - 1, -1, -1):
            bit = (sequence >> shift) & 1
            ones = np.zeros(len(sequence) + 1, np.int32)
            np.cumsum(bit, out=ones[1:])
            self.levels.append((shift, ones, len(sequence) - int(ones[-1])))
            sequence = np.concatenate([sequence[bit == 0], sequence[bit == 1]])
        self.bottom = np.searchsorted(sequence, np.arange(1 << bits))  # bits reversed: see place()

    def place(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Where the prefix of length ``at`` ends among equal symbols on the bottom level."""
        for shift, ones, zeros in self.levels:
            up = ones[at]
            at = np.where((symbol >> shift) & 1, zeros + up, at - up)
        return at

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol stands before place ``at``."""
        return self.place(symbol, at) - self.place(symbol, np.zeros_like(at))

    def symbol(self, at: np.ndarray) -> np.ndarray:
        out = np.zeros(len(at), np.int64)
        for _, ones, zeros in self.levels:
            up = ones[at]
            bit = ones[at + 1] - up
            out = 2 * out + bit
            at = np.where(bit == 1, zeros + up, at - up)
        return out


class FMIndex:
    """Counts and locates runs of symbols in ``text`` (numbers of ``bits`` bits; 0 ends a run, and the text)."""

    def __init__(self, text: np.ndarray, bits: int, sample: int = SAMPLE):
        order = suffix_order(text, bits)
        self.n = len(text)
        before = text[order - 1]  # of the first suffix: the last symbol, an end mark
        self.tree = WaveletTree(before.astype(np.int64), bits)
        self.first = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=1 << bits))])
        kept = (order % sample == 0) | (before == 0)  # a run's first place too: no walk leaves its run
        self.kept_before = np.concatenate([[0], np.cumsum(kept)])
        self.samples = order[kept]

    def count(self, patterns: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The range of sorted suffixes that start with each pattern (rows, padded behind), all searched backwards at once."""
        lo, hi = np.zeros(len(patterns), np.int64), np.full(len(patterns), self.n)
        for step in range(1, int(lengths.max(initial=0)) + 1):
            live = np.flatnonzero((lengths >= step) & (lo < hi))
            if not len(live):
                break
            symbol = patterns[live, lengths[live] - step]
            base = self.first[symbol]
            lo[live] = base + self.tree.rank(symbol, lo[live])
            hi[live] = base + self.tree.rank(symbol, hi[live])
        return lo, np.maximum(lo, hi)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """The text positions of sorted suffixes."""
        at, walked = rows.copy(), np.zeros(len(rows), np.int64)
        live = np.arange(len(rows))
        while len(live):
            live = live[self.kept_before[at[live] + 1] == self.kept_before[at[live]]]
            symbol = self.tree.symbol(at[live])
            at[live] = self.first[symbol] + self.tree.rank(symbol, at[live])
            walked[live] += 1
        return self.samples[self.kept_before[at]] + walked


# --- benchmark ---------------------------------------------------------------------


class Windows:
    """The distinct windows of a block of items, as numbers of the block's words, and whose they are."""

    def __init__(self, items: list[tuple[str | None, list[bytes]]], window: int = WINDOW):
        vocabulary = sorted({w for _, words in items for w in words})
        self.number = {w: k + 1 for k, w in enumerate(vocabulary)}
        self.bits = max(1, len(vocabulary).bit_length())
        self.ids = sorted({i for i, _ in items if i is not None})
        at = {i: k for k, i in enumerate(self.ids)}
        rows, owners = [], []
        for i, words in items:
            if not words:
                continue
            codes = np.array([self.number[w] for w in words])
            size = min(window, len(codes))
            cut = np.lib.stride_tricks.sliding_window_view(codes, size)
            rows.append(np.pad(cut, ((0, 0), (0, window - size))))
            owners.append(np.full(len(cut), at.get(i, -1)))
        every = np.concatenate(rows) if rows else np.zeros((0, window), np.int64)
        self.windows, which = np.unique(every, axis=0, return_inverse=True)
        self.lengths = (self.windows > 0).sum(axis=1)
        pairs = np.unique(np.stack([which.ravel(), np.concatenate(owners) if owners else np.zeros(0, np.int64)], 1), axis=0)
        pairs = pairs[pairs[:, 1] >= 0]
        self.owners = pairs[:, 1]
        self.owned = np.searchsorted(pairs[:, 0], np.arange(len(self.windows) + 1))
        self.shortest = int(self.lengths.min(initial=window))


class _Known(dict):
    def __missing__(self, word):
        return 0


def hits_of(texts: list[bytes | None], windows: Windows) -> tuple[np.ndarray, list[list[tuple[int, int]]], list[list[str]]]:
    """Of one shard's texts: the number of words, the removal spans (in words, end exclusive) and the items that occur."""
    known = _Known(windows.number)
    codes = [np.fromiter(map(known.__getitem__, ws := words_of(t)), np.int64, len(ws)) for t in texts]
    n_words = np.array([len(c) for c in codes], np.int64)
    spans: list = [[] for _ in texts]
    items: list = [[] for _ in texts]
    text = np.concatenate([x for c in codes for x in (c, np.zeros(1, np.int64))]) if codes else np.zeros(0, np.int64)
    starts = np.concatenate([[0], np.cumsum(n_words + 1)])  # a text begins after the end mark of the one before
    edges = np.flatnonzero(np.diff((text > 0).astype(np.int8), prepend=0, append=0))
    begin, end = edges[::2], edges[1::2]
    long = end - begin >= windows.shortest
    begin, end = begin[long], end[long]
    if not len(begin) or not len(windows.windows):
        return n_words, spans, items
    sizes = end - begin + 1  # a run and an end mark
    offsets = np.cumsum(sizes) - sizes
    origin = np.arange(sizes.sum()) + np.repeat(begin - offsets, sizes)  # place in text of each place indexed
    indexed = text[origin]
    index = FMIndex(indexed, windows.bits)
    lo, hi = index.count(windows.windows, windows.lengths)
    met = np.flatnonzero(hi > lo)
    if not len(met):
        return n_words, spans, items
    many = hi[met] - lo[met]
    which = np.repeat(met, many)
    rows = np.arange(many.sum()) + np.repeat(lo[met] - (np.cumsum(many) - many), many)
    at = origin[index.locate(rows)]
    change = np.zeros(len(text) + 1, np.int64)
    np.add.at(change, at, 1)
    np.add.at(change, at + windows.lengths[which], -1)
    covered = np.cumsum(change[:-1]) > 0
    edges = np.flatnonzero(np.diff(covered.astype(np.int8), prepend=0, append=0))
    for b, e in zip(edges[::2], edges[1::2]):  # occurrences do not cross end marks, so neither do spans
        doc = int(np.searchsorted(starts, b, "right")) - 1
        spans[doc].append((int(b - starts[doc]), int(e - starts[doc])))
    doc = np.searchsorted(starts, at, "right") - 1
    own = windows.owned[which + 1] - windows.owned[which]
    owner = windows.owners[np.arange(own.sum()) + np.repeat(windows.owned[which] - (np.cumsum(own) - own), own)]
    for d, i in np.unique(np.stack([np.repeat(doc, own), owner], 1), axis=0):
        items[d].append(windows.ids[i])
    return n_words, spans, items


# --- tables -------------------------------------------------------------------------


def find_leaks(docs: DataFrame, items: list[tuple[str | None, list[bytes]]], keys: list[str], text_col: str, window: int, shard_words: int) -> DataFrame:
    """``keys`` of every row of docs, n_words, spans and items, for one block of items."""
    spark = docs.sparkSession
    ship(spark)
    windows = spark.sparkContext.broadcast(Windows(items, window))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0

        def done() -> pa.RecordBatch:
            table = pa.Table.from_batches(held).combine_chunks()
            n_words, spans, found = hits_of(table.column("__text").to_pylist(), windows.value)
            spans = pa.array([[{"start": a, "end": b} for a, b in s] for s in spans], SPANS)
            out = [*[table.column(k) for k in keys], pa.array(n_words), spans, pa.array(found, pa.list_(pa.string()))]
            return pa.Table.from_arrays(out, names=[*keys, "n_words", "spans", "items"])

        for batch in batches:
            sizes = np.asarray(pc.binary_length(batch.column("__text"))).astype(np.int64) // 6 + 1
            begin = 0
            while begin < batch.num_rows:  # whole texts
                end = min(batch.num_rows, begin + 1 + int(np.searchsorted(np.cumsum(sizes[begin:]), shard_words - size)))
                held.append(batch.slice(begin, end - begin))
                size += int(sizes[begin:end].sum())
                begin = end
                if size >= shard_words:
                    yield from done().to_batches()
                    held, size = [], 0
        if held:
            yield from done().to_batches()

    span = T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])
    schema = T.StructType([*[docs.schema[k] for k in keys], T.StructField("n_words", T.LongType()), T.StructField("spans", T.ArrayType(span)), T.StructField("items", T.ArrayType(T.StringType()))])
    return docs.select(*keys, full_text(text_col).cast("binary").alias("__text")).mapInArrow(search, schema)


def _block(benchmark: DataFrame, blocks: int, block: int) -> list[tuple[str | None, list[bytes]]]:
    """One block's items: at most about BLOCK_WORDS words, or one item."""
    mine = benchmark.filter(F.pmod(F.xxhash64("id", "text"), F.lit(blocks)) == block)
    return [(r["id"], words_of(bytes(r["text"]))) for r in mine.collect()]


def leaks(
    docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", shard_words: int = SHARD_WORDS, block_words: int = BLOCK_WORDS
) -> DataFrame:
    """One row per row of docs: doc_id, n_words, spans (array of start, end in words), items (array of item ids as strings).

    Defined cases: a null or empty text, of a document or an item, has no words
    and no window; a null id stays null; an item without an id removes what it
    occurs in but is no item of the list; rows of an item id that repeats are
    one item with the windows of all; repeated documents each have their row;
    empty tables give no rows, or no hits; further columns are ignored.
    """
    items = benchmark.select(F.col(item_col).cast("string").alias("id"), full_text(text_col).cast("binary").alias("text"))
    total = items.select(F.sum(F.length("text"))).first()[0] or 0
    blocks = max(1, -(-total // (6 * block_words)))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    if blocks == 1:
        return find_leaks(rows, _block(items, 1, 0), ["doc_id"], "text", window, shard_words)
    rows = materialize(rows.withColumn("uid", F.monotonically_increasing_id()))
    parts = [materialize(find_leaks(rows, _block(items, blocks, k), ["uid", "doc_id"], "text", window, shard_words)) for k in range(blocks)]
    every = parts[0]
    for part in parts[1:]:
        every = every.unionByName(part)
    found = every.groupBy("uid").agg(F.first("doc_id").alias("doc_id"), F.max("n_words").alias("n_words"), F.sort_array(F.flatten(F.collect_list("spans"))).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))  # a row per block
    none = F.expr("cast(array() as array<struct<start: bigint, end: bigint>>)")

    def joined(done, x):
        last = F.element_at(done, -1)
        wider = F.concat(F.slice(done, F.lit(1), F.size(done) - 1), F.array(F.struct(last["start"].alias("start"), F.greatest(last["end"], x["end"]).alias("end"))))
        return F.when((F.size(done) > 0) & (x["start"] <= F.try_element_at(done, F.lit(-1))["end"]), wider).otherwise(F.concat(done, F.array(x)))

    return found.select("doc_id", "n_words", F.aggregate("spans", none, joined).alias("spans"), "items")


def decontaminate(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The digest of ``leaks``: doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda a, x: a + x["end"] - x["start"])
    return leaks(docs, benchmark, **options).select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join(F.array_sort("items"), ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated")
    )


_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
ORACLE = f"""WITH d AS (SELECT row_number() OVER () AS u, doc_id, {_WORDS} AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, {_WORDS} AS w FROM benchmark),
bw AS (SELECT DISTINCT item, k, list_slice(w, i, i + k - 1) AS g FROM (SELECT item, w, least(len(w), {WINDOW}) AS k, unnest(range(1, len(w) - least(len(w), {WINDOW}) + 2)) AS i FROM b WHERE len(w) > 0)),
ks AS (SELECT DISTINCT k FROM bw),
dw AS (SELECT u, k, i, list_slice(w, i, i + k - 1) AS g FROM (SELECT u, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, ks WHERE len(w) >= k)),
h AS (SELECT u, dw.k, i, item FROM dw JOIN bw ON dw.k = bw.k AND dw.g = bw.g),
c AS (SELECT u, count(DISTINCT p) AS n_hit FROM (SELECT u, unnest(range(i, i + k)) AS p FROM h) GROUP BY 1),
t AS (SELECT u, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS items FROM h GROUP BY 1)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN c USING (u) LEFT JOIN t USING (u)"""
