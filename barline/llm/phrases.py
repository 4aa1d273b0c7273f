"""Phrase collocations, counted in counting quotient filters.

Shards of text become arrays of word numbers once, and are written. Only words
as frequent as a phrase must be get numbers in the corpus (a phrase is never
more frequent than its words, so no candidate is lost). A shard's runs of 2, 3
and 4 numbered words are packed into one number of n * bits bits, which a keyed
permutation (a Feistel network, invertible) spreads evenly: its high bits are
the quotient, all its other bits the stored remainder, so the filter loses
nothing. Filters are sorted, so they merge by runs of the quotient: the tasks of
a level each merge one range of quotients of some shards, and the last level
merges all shards' and inverts the permutation of what is frequent enough. What
is shuffled is filters, about a byte count of the remainder an n-gram, never
phrases as texts.

Scores, containment and ranks are joins over the frequent phrases alone.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barline import ship
from barline.llm.common import full_text, materialize, partitions, release

LONGEST = 4
LEAST = 30
TOP = 2000
SHARE = 80
SHARD_BYTES = 12 << 20
#: Entries that a merging task should get, and bits of the quotient that one level of merging deals by.
MERGE_ENTRIES = 1 << 21
LEVEL_BITS = 10
BREAK = b"\xff"  # no byte of a UTF-8 text
#: A-Z in lower case; [.,;:!?\x0A-\x0D] end a piece; [\x20\x09] part words.
BYTES = bytes(0xFF if chr(c) in ".,;:!?\n\x0b\x0c\r" else c for c in bytes(range(256)).lower())

# --- shards -----------------------------------------------------------------------


class _Numbers(dict):
    """Numbers words as they come; 0 is the break between pieces."""

    def __init__(self):
        super().__init__({BREAK: 0})

    def __missing__(self, word):
        self[word] = len(self)
        return self[word]


class _Shard:
    def __init__(self):
        self.numbers, self.codes, self.size = _Numbers(), [], 0

    def add(self, text: bytes) -> None:
        parts = text.translate(BYTES).replace(BREAK, b" \xff ").split()
        parts.append(BREAK)
        self.codes.append(np.fromiter(map(self.numbers.__getitem__, parts), np.int32, len(parts)))


SHARD_SCHEMA = "shard long, lang string, codes binary, words array<binary>, counts array<long>"
_SHARD_ARROW = pa.schema([("shard", pa.int64()), ("lang", pa.string()), ("codes", pa.binary()), ("words", pa.list_(pa.binary())), ("counts", pa.list_(pa.int64()))])


def shards(docs: DataFrame, text_col: str, lang_col: str, shard_bytes: int) -> DataFrame:
    """One row per shard and language: texts as numbers of the shard's own words, which are listed with their counts."""
    ship(docs.sparkSession)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, made = TaskContext.get().partitionId() << 24, 0
        held: dict[str, _Shard] = {}
        size = 0

        def emit() -> Iterator[pa.RecordBatch]:
            nonlocal made
            for lang, shard in held.items():
                codes = np.concatenate(shard.codes)
                counts = np.bincount(codes, minlength=len(shard.numbers))[1:]
                row = [[first + made], [lang], [codes.tobytes()], [list(shard.numbers)[1:]], [counts.tolist()]]
                made += 1
                yield pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(row, _SHARD_ARROW)], schema=_SHARD_ARROW)

        for batch in batches:
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist()):
                held.setdefault(lang, _Shard()).add(text)
                size += len(text)
                if size >= shard_bytes:
                    yield from emit()
                    held, size = {}, 0
        yield from emit()

    rows = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), full_text(text_col).cast("binary").alias("text"))
    return rows.mapInArrow(encode, SHARD_SCHEMA)


def dictionary(words: DataFrame, least: int) -> DataFrame:
    """(id, lang, word, f) of the words that occur ``least`` times in a language; ids from 1 on without gaps."""
    totals = materialize(words.groupBy("lang", "word").agg(F.sum("n").alias("f")).filter(F.col("f") >= least))
    buckets = max(1, int((totals.count() // 1000) ** 0.5))
    totals = totals.withColumn("bucket", F.pmod(F.xxhash64("lang", "word"), F.lit(buckets)))
    sizes = totals.groupBy("bucket").agg(F.count("*").alias("size"))
    sizes = sizes.select("bucket", F.coalesce(F.sum("size").over(Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    within = F.row_number().over(Window.partitionBy("bucket").orderBy("lang", "word"))
    return materialize(totals.withColumn("at", within).join(sizes, "bucket").select((F.col("base") + F.col("at")).alias("id"), "lang", "word", "f"))


# --- filters ----------------------------------------------------------------------


def _mixed(x: np.ndarray, key: int) -> np.ndarray:
    """A well-mixed function of 64-bit numbers (wraps around)."""
    x = x + np.uint64((0x9E3779B97F4A7C15 * (key + 1)) % (1 << 64))
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _low(bits: int) -> np.uint64:
    return np.uint64((1 << bits) - 1)


class Layout:
    """How n-grams of ``n`` numbers of ``bits`` bits are packed and cut.

    ``left`` and ``right`` are the bits of the two halves; the quotient is the
    highest ``quotient`` bits of the left one.
    """

    ROUNDS = 6

    def __init__(self, n: int, bits: int, quotient: int):
        self.n, self.bits = n, bits
        self.left, self.right = bits * (1 if n == 2 else 2), bits * (2 if n == 4 else 1)
        spare = -(self.left + self.right - quotient) % 8  # remainders are whole bytes where that costs no bits
        self.quotient = min(self.left, max(quotient - spare, 0))
        self.rest = self.left - self.quotient

    def pack(self, ids: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        b = np.uint64(self.bits)
        ids = [i.astype(np.uint64) for i in ids]
        left = ids[0] if self.n == 2 else (ids[0] << b) | ids[1]
        right = (ids[2] << b) | ids[3] if self.n == 4 else ids[-1]
        return self._permute(left, right, range(self.ROUNDS))

    def unpack(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        left, right = self._permute(left, right, range(self.ROUNDS - 1, -1, -1))
        b, m = np.uint64(self.bits), _low(self.bits)
        parts = [left] if self.n == 2 else [left >> b, left & m]
        parts += [right >> b, right & m] if self.n == 4 else [right]
        return np.stack(parts, 1).astype(np.int64)

    def _permute(self, left, right, rounds) -> tuple[np.ndarray, np.ndarray]:
        """Alternating Feistel rounds; the reversed rounds invert it."""
        for r in rounds:
            if r % 2:
                left = left ^ (_mixed(right, r) & _low(self.left))
            else:
                right = right ^ (_mixed(left, r) & _low(self.right))
        return left, right

    def counted(self, left: np.ndarray, right: np.ndarray, counts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Sorted distinct (left, right) and their counts."""
        if self.left + self.right <= 64:
            key = (left << np.uint64(self.right % 64)) | right
            order = np.argsort(key, kind="stable") if counts is not None else None
            key = np.sort(key) if order is None else key[order]
            new = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
            left, right = key[new] >> np.uint64(self.right % 64), key[new] & _low(self.right)
            size = len(key)
        else:
            order = np.lexsort((right, left))
            left, right = left[order], right[order]
            new = np.flatnonzero(np.concatenate([[True], (left[1:] != left[:-1]) | (right[1:] != right[:-1])])) if len(left) else np.zeros(0, np.int64)
            size = len(left)
            left, right = left[new], right[new]
        if counts is None:
            return left, right, np.diff(np.append(new, size))
        return left, right, np.add.reduceat(counts[order], new) if len(new) else counts[:0]

    def encode(self, left: np.ndarray, right: np.ndarray, counts: np.ndarray, bucket: int, bucket_bits: int) -> bytes:
        """The filter of sorted entries whose quotients start with the ``bucket_bits`` bits of ``bucket``.

        A run length per quotient, the remainders, a byte per count, and the counts that need more.
        """
        shift = max(self.quotient - bucket_bits, 0)
        slot = (left >> np.uint64(self.left - bucket_bits - shift)).astype(np.int64) - (bucket << shift)
        runs = np.bincount(slot, minlength=1 << shift)
        wide = runs.max(initial=0) > 255
        rest = self.left - bucket_bits - shift
        high, low = self._remainder(left & _low(rest), right)
        width = -(-(rest + self.right) // 8)
        cells = low.astype("<u8").view(np.uint8).reshape(-1, 8)[:, : min(width, 8)]
        if width > 8:
            cells = np.concatenate([cells, high.astype("<u8").view(np.uint8).reshape(-1, 8)[:, : width - 8]], axis=1)
        small = np.minimum(counts, 255).astype(np.uint8)
        big = counts[counts >= 255].astype("<i8").tobytes()
        return struct.pack("<II?", len(left), len(runs), wide) + runs.astype("<u4" if wide else np.uint8).tobytes() + np.ascontiguousarray(cells).tobytes() + small.tobytes() + big

    def decode(self, blob: bytes, bucket: int, bucket_bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        n, slots, wide = struct.unpack_from("<II?", blob)
        at = 9
        runs = np.frombuffer(blob, "<u4" if wide else np.uint8, slots, at)
        at += runs.nbytes
        shift = max(self.quotient - bucket_bits, 0)
        rest = self.left - bucket_bits - shift
        width = -(-(rest + self.right) // 8)
        cells = np.frombuffer(blob, np.uint8, n * width, at).reshape(n, width)
        at += n * width
        words = np.zeros((n, 16), np.uint8)
        words[:, : min(width, 8)] = cells[:, :8]
        words[:, 8 : 8 + max(width - 8, 0)] = cells[:, 8:]
        low, high = words.view("<u8").T
        right = low & _low(self.right) if self.right < 64 else low
        if self.right < 64:
            rem = (low >> np.uint64(self.right)) | (high << np.uint64(64 - self.right) if self.right else 0)
        else:
            rem = high
        counts = np.frombuffer(blob, np.uint8, n, at).astype(np.int64)
        counts[counts == 255] = np.frombuffer(blob, "<i8", -1, at + n)
        quotients = np.repeat(np.arange(slots, dtype=np.int64), runs) + (bucket << shift)
        return (quotients.astype(np.uint64) << np.uint64(rest)) | (rem & _low(rest)), right, counts

    def _remainder(self, rest: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """rest << right bits | right, as two 64-bit numbers."""
        low = (rest << np.uint64(self.right)) | right
        return rest >> np.uint64(64 - self.right) if 0 < self.right < 64 else np.zeros_like(rest), low

    def buckets(self, left: np.ndarray, bits: int) -> Iterator[tuple[int, slice]]:
        """The runs of sorted entries with equal leading bits."""
        of = (left >> np.uint64(self.left - bits)).astype(np.int64)
        edges = np.flatnonzero(np.diff(of, prepend=-1))
        for begin, end in zip(edges, np.append(edges[1:], len(of))):
            yield int(of[begin]), slice(int(begin), int(end))


def ngrams(codes: np.ndarray, n: int) -> list[np.ndarray]:
    """The n numbers of every run of n numbers without a 0."""
    places = max(len(codes) - n + 1, 0)
    shifted = [codes[k : k + places] for k in range(n)]
    whole = np.logical_and.reduce([s > 0 for s in shifted])
    return [s[whole] for s in shifted]


FILTER_SCHEMA = "n int, bucket long, part long, filter binary"


def shard_filters(coded: DataFrame, words: DataFrame, bits: int, quotient: int, bucket_bits: int, longest: int) -> DataFrame:
    """A filter per shard, length and range of quotients. ``words``: shard, local, id."""
    layouts = [Layout(n, bits, quotient) for n in range(2, longest + 1)]

    def count(names: pd.DataFrame, shard: pd.DataFrame) -> pd.DataFrame:
        out = []
        for row in shard.itertuples():
            codes = np.frombuffer(row.codes, np.int32)
            ids = np.zeros(int(codes.max(initial=0)) + 1, np.int64)
            ids[names["local"].to_numpy()] = names["id"].to_numpy()
            codes = ids[codes]
            for layout in layouts:
                grams = layout.counted(*layout.pack(ngrams(codes, layout.n)))
                for bucket, at in layout.buckets(grams[0], bucket_bits):
                    out.append((layout.n, bucket, row.part, layout.encode(*[g[at] for g in grams], bucket, bucket_bits)))
        return pd.DataFrame(out, columns=["n", "bucket", "part", "filter"])

    return words.groupBy("shard").cogroup(coded.groupBy("part")).applyInPandas(count, FILTER_SCHEMA)


def merged(filters: DataFrame, bits: int, quotient: int, bucket_bits: int, finer: int, fan: int) -> DataFrame:
    """Filters of ``fan`` neighbouring parts each, merged and dealt anew by ``finer`` more bits."""

    def merge(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        layout = Layout(key[0], bits, quotient)
        grams = _merge(layout, rows, bucket_bits)
        out = [(layout.n, bucket, key[2], layout.encode(*[g[at] for g in grams], bucket, bucket_bits + finer)) for bucket, at in layout.buckets(grams[0], bucket_bits + finer)]
        return pd.DataFrame(out, columns=["n", "bucket", "part", "filter"])

    group = F.expr(f"part div {fan}").alias("part")
    return filters.select("n", "bucket", group, "filter").groupBy("n", "bucket", "part").applyInPandas(merge, FILTER_SCHEMA)


def _merge(layout: Layout, rows: pd.DataFrame, bucket_bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    parts = [layout.decode(blob, int(bucket), bucket_bits) for blob, bucket in zip(rows["filter"], rows["bucket"])]
    return layout.counted(*[np.concatenate(x) for x in zip(*parts)])


def frequent(filters: DataFrame, bits: int, quotient: int, bucket_bits: int, least: int) -> DataFrame:
    """(ids, f) of the n-grams that all shards together have ``least`` times."""

    def merge(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        layout = Layout(key[0], bits, quotient)
        left, right, counts = _merge(layout, rows, bucket_bits)
        often = counts >= least
        return pd.DataFrame({"ids": pd.Series(list(layout.unpack(left[often], right[often])), dtype=object), "f": counts[often]})

    return filters.groupBy("n", "bucket").applyInPandas(merge, "ids array<long>, f long")


# --- phrases ----------------------------------------------------------------------


def phrase_counts(
    docs: DataFrame, least: int = LEAST, longest: int = LONGEST, lang_col: str = "lang", text_col: str = "text", shard_bytes: int = SHARD_BYTES, merge_entries: int = MERGE_ENTRIES, level_bits: int = LEVEL_BITS
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(phrases: ids, f; words: id, lang, word, f; langs: lang, n), all written."""
    spark = docs.sparkSession
    coded = materialize(shards(docs, text_col, lang_col, shard_bytes))
    words = coded.select("shard", "lang", F.posexplode(F.arrays_zip("words", "counts")).alias("pos", "w"))
    words = words.select("shard", "lang", (F.col("pos") + 1).alias("local"), F.col("w.words").alias("word"), F.col("w.counts").alias("n"))
    langs = materialize(coded.select("lang", F.aggregate("counts", F.lit(0).cast("long"), lambda a, x: a + x).alias("n")).groupBy("lang").agg(F.sum("n").alias("n")))
    known = dictionary(words, least)
    n_tokens = langs.agg(F.sum("n")).first()[0] or 0
    bits = max(1, known.count().bit_length())
    if bits > 31:
        raise ValueError("more than 2**31 words are frequent: raise ``least``")
    target = min(bits, max(6, (n_tokens // merge_entries).bit_length()))  # bits of the quotient that the last level deals by
    quotient = max(target, (shard_bytes // 8).bit_length())
    dealt = min(target, level_bits)
    numbered = words.select("shard", "lang", "local", "word").join(known.select("id", "lang", "word"), ["lang", "word"]).select("shard", "local", "id")
    filters = shard_filters(coded.select(F.col("shard").alias("part"), "codes"), numbered, bits, quotient, dealt, longest)
    fan = 1 << level_bits
    while dealt < target:  # each level of merging deals what it merged to more tasks, from fewer parts
        finer = min(level_bits, target - dealt)
        filters = materialize(merged(filters, bits, quotient, dealt, finer, fan))
        dealt, fan = dealt + finer, fan << level_bits
    grams = materialize(frequent(filters, bits, quotient, dealt, least))
    release(spark)
    return grams, known, langs


def collocations(docs: DataFrame, top: int = TOP, least: int = LEAST, share: int = SHARE, longest: int = LONGEST, **options) -> DataFrame:
    """The best phrases of each language: lang, rank, phrase, a, l, r, n, score.

    Defined cases: a null text is empty and a null language is ``und``; repeated
    rows count as often as they stand; an empty table, and one without a
    frequent phrase, give no rows; further columns are ignored. Ties in score
    and count go by the phrase's bytes.
    """
    grams, known, langs = phrase_counts(docs, least, longest, **options)
    counts = grams.unionByName(known.select(F.array("id").alias("ids"), "f"))
    cuts = [F.struct(F.lit(k).alias("k"), F.lit(side).alias("side"), part.alias("part")) for k in range(1, longest) for side, part in (("l", F.slice("ids", 1, k)), ("r", F.slice("ids", k + 1, longest)))]
    cut = grams.select("ids", F.col("f").alias("a"), F.explode(F.filter(F.array(*cuts), lambda c: c["k"] < F.size("ids"))).alias("c")).select("ids", "a", "c.*")
    cut = cut.join(counts.select(F.col("ids").alias("part"), "f"), "part")
    of = lambda k, side: F.max(F.when((F.col("k") == k) & (F.col("side") == side), F.col("f")))
    scored = cut.groupBy("ids", "a").agg(*[of(k, side).alias(f"{side}{k}") for k in range(1, longest) for side in "lr"])
    score = lambda k: F.expr(f"(cast(a as decimal(20,0)) * 2000000) div (cast(l{k} as decimal(20,0)) + r{k})")
    found = [F.when(F.col(f"l{k}").isNotNull(), F.struct(score(k).alias("score"), F.lit(k).alias("k"), F.col(f"l{k}").alias("l"), F.col(f"r{k}").alias("r"))) for k in range(1, longest)]
    scored = scored.select("ids", "a", F.array_min(F.array_compact(F.array(*found))).alias("s")).select("ids", "a", "s.score", "s.l", "s.r")
    inner = [F.struct(F.lit(b).alias("b"), F.lit(m).alias("m")) for m in range(2, longest) for b in range(1, longest - m + 2)]
    inside = grams.filter(F.size("ids") > 2).select("ids", "f", F.explode(F.array(*inner)).alias("i")).filter("i.m < size(ids) and i.b + i.m - 1 <= size(ids)")
    inside = inside.groupBy(F.expr("slice(ids, i.b, i.m)").alias("ids")).agg(F.max("f").alias("longer"))
    kept = scored.join(inside, "ids", "left").filter(F.col("longer").isNull() | (F.expr("cast(longer as decimal(20,0)) * 100") < F.expr(f"cast(a as decimal(20,0)) * {share}")))
    spelt = kept.select("ids", "a", "l", "r", "score", F.posexplode("ids").alias("pos", "id")).join(known.select("id", "lang", F.col("word").cast("string").alias("word")), "id")
    spelt = spelt.groupBy("ids", "a", "l", "r", "score").agg(F.max("lang").alias("lang"), F.array_sort(F.collect_list(F.struct("pos", "word"))).alias("w"))
    spelt = spelt.select("lang", F.array_join("w.word", " ").alias("phrase"), "a", "l", "r", "score", F.pmod(F.xxhash64("ids"), F.lit(partitions(docs.sparkSession))).alias("salt"))
    best = [F.desc("score"), F.desc("a"), "phrase"]
    spelt = spelt.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*best))).filter(F.col("rank") <= top)
    spelt = spelt.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*best)).cast("long")).filter(F.col("rank") <= top)
    return spelt.join(langs, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


ORACLE = f"""WITH p AS (SELECT u, lang, i, regexp_extract_all(piece, '[^\\x20\\x09]+') AS w FROM (SELECT u, lang, unnest(range(1, len(ps) + 1)) AS i, unnest(ps) AS piece FROM (
  SELECT row_number() OVER () AS u, coalesce(lang, 'und') AS lang, string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]') AS ps FROM documents))),
t AS (SELECT u, lang, i, unnest(range(1, len(w) + 1)) AS j, unnest(w) AS w1 FROM p),
t4 AS (SELECT lang, w1, lead(w1, 1) OVER o AS w2, lead(w1, 2) OVER o AS w3, lead(w1, 3) OVER o AS w4 FROM t WINDOW o AS (PARTITION BY u, i ORDER BY j)),
g0 AS (SELECT lang, 1 AS k, w1 AS g FROM t4 UNION ALL SELECT lang, 2, w1 || ' ' || w2 FROM t4 WHERE w2 IS NOT NULL UNION ALL SELECT lang, 3, w1 || ' ' || w2 || ' ' || w3 FROM t4 WHERE w3 IS NOT NULL
  UNION ALL SELECT lang, 4, w1 || ' ' || w2 || ' ' || w3 || ' ' || w4 FROM t4 WHERE w4 IS NOT NULL),
ca AS MATERIALIZED (SELECT lang, k, g, count(*) AS f FROM g0 GROUP BY ALL HAVING k = 1 OR count(*) >= {LEAST}),
c AS MATERIALIZED (SELECT * FROM ca WHERE f >= {LEAST}),
tot AS (SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM ca WHERE k = 1 GROUP BY 1),
cand AS (SELECT * FROM c WHERE k > 1 AND f >= {LEAST}),
cut AS (SELECT a.lang, a.k, a.g, a.f AS a, x.f AS l, y.f AS r, h.h, CAST((2000000 * CAST(a.f AS HUGEINT)) // (x.f + y.f) AS BIGINT) AS score FROM cand a JOIN (VALUES (1), (2), (3)) h(h) ON h.h < a.k
  JOIN c x ON x.lang = a.lang AND x.g = array_to_string(list_slice(string_split(a.g, ' '), 1, h.h), ' ') JOIN c y ON y.lang = a.lang AND y.g = array_to_string(list_slice(string_split(a.g, ' '), h.h + 1, a.k), ' ')),
sc AS (SELECT * FROM cut QUALIFY row_number() OVER (PARTITION BY lang, g ORDER BY score, h) = 1),
sub AS (SELECT lang, array_to_string(list_slice(string_split(g, ' '), b.b, b.b + m.m - 1), ' ') AS g, max(f) AS f FROM cand, (VALUES (1), (2), (3)) b(b), (VALUES (2), (3)) m(m) WHERE m.m < k AND b.b + m.m - 1 <= k GROUP BY ALL),
kept AS (SELECT sc.*, sc.g AS phrase FROM sc LEFT JOIN sub ON sub.lang = sc.lang AND sub.g = sc.g WHERE sub.f IS NULL OR 100 * CAST(sub.f AS HUGEINT) < {SHARE} * CAST(a AS HUGEINT)),
rk AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank FROM kept)
SELECT lang, rank, phrase, a, l, r, n, score FROM rk JOIN tot USING (lang) WHERE rank <= {TOP}"""
