"""SimHash near-dedup: pivot distance tables over pigeonhole buckets.

Distinct fingerprints (a row each, however many documents share one) meet in
buckets: of five blocks of bits, at least two are equal in any pair within
three bits, so ten keys of two blocks lose no pair. Inside a bucket, a pivot
table holds the Hamming distances to PIVOTS reference fingerprints. Rows stand
in the order of the first distance, so only a window of +-3 is looked at; pairs
whose largest coordinate difference is above 3 cannot be within 3 bits and are
discarded; survivors are verified by their own distance.

Buckets above ``unit_rows`` fingerprints are cut into chunks and every pair of
chunks becomes a unit of its own, so no task holds a whole bucket. A unit sends
a spanning forest of its links, never all pairs. Components of the link graph
come from forests of FOREST_ROWS links a task, then alternating star
contractions, a shuffle each, checkpointed as tables that go when the next is there.

``kept_similar`` links by set similarity instead: three bits of 64 are far
tighter than a Jaccard similarity of 0.8 (about ten bits apart), and no bucket
key of one fingerprint holds pairs that wide. Its buckets are BANDS keys of
BAND_ROWS minima each per distinct shingle set. Inside them it goes the same way
with fingerprints of WIDE_BITS bits: a pair is discarded by its fingerprints'
distance, in units of many pairs by a pivot table first, and what is left is
verified by the exact similarity of the sets.
"""

from __future__ import annotations

from itertools import accumulate, combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barline import ship
from barline.llm.common import PARTS, full_text, join_hot_cold, materialize, narrow, release, settled

SHINGLE = 3
DISTANCE = 3
PIVOTS = 16
SEED = 42
OFFSETS, WIDTHS = (0, 13, 26, 39, 52), (13, 13, 13, 13, 12)
UNIT_ROWS = 500
#: Rounds of comparing a bucket's members with one of them before the rest is compared pair by pair.
LEADERS = 4
#: Links (two longs each) that a task of ``components`` contracts at once.
FOREST_ROWS = 1 << 17
#: A pair at similarity 0.8 shares none of the fingerprints once in 300,000 times.
BANDS, BAND_ROWS = 24, 4
#: Parity bits of a shingle set: 2**PARITY_BITS at most, sharp up to some 30,000 shingles; fewer than all would still lose no pair.
PARITY_BITS = 16
#: Bits of a set's fingerprint, and the distance that pairs at similarity 0.8 stay within: at most 3/16 of the
#: bits are expected to differ (sets of 4 and 5 shingles; large sets 0.152), and 6 standard deviations are added.
WIDE_BITS, WIDE_DISTANCE = 512, 149
_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)


def fingerprint(text: str, size: int = SHINGLE) -> int:
    """64-bit SimHash (signed) of the text's word shingles."""
    ws = text.encode("utf-8", "surrogatepass").lower().split()
    if not ws:
        return 0
    line = b" ".join(ws)
    at = list(accumulate(map(len, ws), initial=0))
    n = max(len(ws) - size + 1, 1)
    last = min(size, len(ws))
    digest = xxhash.xxh64_intdigest
    h = np.fromiter((digest(line[at[i] + i : at[i + last] + i + last - 1], SEED) for i in range(n)), np.uint64, n)
    octets = h.view(np.uint8).reshape(-1, 8)
    ones = np.concatenate([np.bincount(octets[:, k], minlength=256) @ _BITS for k in range(8)])
    return int(np.packbits(2 * ones > n, bitorder="little").view(np.int64)[0])


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def shingle_set(text: str, size: int) -> np.ndarray:
    """Sorted distinct hashes of the text's word shingles; a shorter text is one shingle."""
    ws = text.encode("utf-8", "surrogatepass").lower().split()
    w = np.fromiter(map(xxhash.xxh64_intdigest, ws), np.uint64, len(ws))
    size = min(size, len(w))
    h = np.zeros(len(w) - size + 1 if len(w) else 0, np.uint64)
    for k in range(size):
        h = _mix(h + w[k : k + len(h)])
    return np.unique(h)


def band_keys(shingles: np.ndarray, bands: int = BANDS, band_rows: int = BAND_ROWS) -> np.ndarray:
    """One signed key per band: a hash of the minima of its ``band_rows`` random orders."""
    draws = np.random.default_rng(SEED).integers(0, 2**64, (2, bands * band_rows, 1), np.uint64)
    least = np.full(bands * band_rows, np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(shingles), 512):
        least = np.minimum(least, ((shingles[None, i : i + 512] ^ draws[0]) * (draws[1] | np.uint64(1))).min(axis=1))
    key = np.arange(bands, dtype=np.uint64)
    for row in least.reshape(bands, band_rows).T:
        key = _mix(key + row)
    return key.view(np.int64)


def wide_print(shingles: np.ndarray) -> np.ndarray:
    """SimHash of a set of hashes in WIDE_BITS bits (signed words): a bit is 1 if set in over half of them."""
    draws = np.random.default_rng(SEED + 1).integers(0, 2**64, WIDE_BITS // 64, np.uint64)
    words = []
    for draw in draws:
        octets = _mix(shingles ^ draw).view(np.uint8).reshape(-1, 8)
        ones = np.concatenate([np.bincount(octets[:, k], minlength=256) @ _BITS for k in range(8)])
        words.append(np.packbits(2 * ones > len(shingles), bitorder="little").view(np.int64))
    return np.concatenate(words)


def sketches(docs: DataFrame, shingle: int) -> DataFrame:
    """Adds ``fp`` (the hash of the shingle set), ``keys`` and ``bits`` (its wide fingerprint) to rows with a ``text``, which goes."""

    ship(docs.sparkSession)

    @F.pandas_udf("fp long, keys array<long>, bits array<long>")
    def udf(text: pd.Series) -> pd.DataFrame:
        sets = [shingle_set(t, shingle) for t in text]
        fp = np.array([xxhash.xxh64_intdigest(s.tobytes(), SEED) for s in sets], np.uint64)
        return pd.DataFrame({"fp": fp.view(np.int64), "keys": [band_keys(s) for s in sets], "bits": [wide_print(s) for s in sets]})

    return docs.withColumn("s", udf("text")).select(*[c for c in docs.columns if c != "text"], "s.fp", "s.keys", "s.bits")


def fingerprints(docs: DataFrame) -> DataFrame:
    """Adds ``fp`` to rows with a ``text``, which goes."""

    ship(docs.sparkSession)

    @F.pandas_udf("long")
    def udf(text: pd.Series) -> pd.Series:
        return pd.Series([fingerprint(t) for t in text], dtype="int64")

    return docs.withColumn("fp", udf("text")).drop("text")


def _popcount(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x).astype(np.int8)


def pivot_table(fps: np.ndarray) -> np.ndarray:
    """(PIVOTS, n) Hamming distances to the reference fingerprints."""
    refs = np.array([xxhash.xxh64_intdigest(f"pivot {i}", SEED) for i in range(PIVOTS)], np.uint64)
    return _popcount(fps[None, :] ^ refs[:, None])


def close_pairs(units: np.ndarray, fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of the same unit within DISTANCE bits.

    Discards by the pivot table before it looks at a pair's own distance.
    """
    order = np.lexsort((_popcount(fps ^ np.uint64(xxhash.xxh64_intdigest("pivot 0", SEED))), units))
    u, f = units[order], fps[order]
    table = pivot_table(f)
    first, second = [], []
    live = np.arange(len(u))
    shift = 0
    while len(live):
        shift += 1
        live = live[live + shift < len(u)]
        other = live + shift
        near = (u[live] == u[other]) & (table[0, other] - table[0, live] <= DISTANCE)
        live = live[near]  # the window ends where the first coordinate is too far
        a, b = live, live + shift
        for coordinate in table[1:]:
            ok = np.abs(coordinate[a] - coordinate[b]) <= DISTANCE
            a, b = a[ok], b[ok]
        ok = _popcount(f[a] ^ f[b]) <= DISTANCE
        first.append(order[a[ok]])
        second.append(order[b[ok]])
    empty = [np.zeros(0, np.int64)]
    return np.concatenate(first or empty), np.concatenate(second or empty)


def forest(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least index reachable from each of 0..n-1 over the pairs."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, root[a], low)
        np.minimum.at(new, root[b], low)
        while not np.array_equal(new[new], new):
            new = new[new]
        if np.array_equal(new, root):
            return root
        root = new


def extent(groups: DataFrame, weight: str = "n") -> dict:
    """What ``join_hot_cold`` wants to know of ``groups``: the total of their weights, and whether any are hot or cold."""
    total, least, most = groups.agg(F.sum(weight), F.min(weight), F.max(weight)).first()
    total = max(total or 0, 1)
    return {"total": total, "cold": (least or 0) * PARTS < total, "hot": (most or 0) * PARTS >= total}


def links(prints: DataFrame, unit_rows: int = UNIT_ROWS) -> DataFrame:
    """(a, b): a spanning set of the links between the distinct ``fp`` of ``prints``."""
    ship(prints.sparkSession)
    blocks = [F.shiftrightunsigned("fp", o).bitwiseAND(F.lit((1 << w) - 1)) for o, w in zip(OFFSETS, WIDTHS)]
    keys = [F.lit(t << 26) + blocks[i] * (1 << 13) + blocks[j] for t, (i, j) in enumerate(combinations(range(5), 2))]
    keyed = prints.select("fp", F.explode(F.array(*keys)).alias("key"))
    sizes = materialize(keyed.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1"))
    total = sizes.agg(F.sum("n")).first()[0] or 0
    met = join_hot_cold(keyed, sizes, ["key"], "n", max(total, 1))
    chunks = F.ceil(F.col("n") / unit_rows)
    mine = F.pmod(F.xxhash64("fp"), F.col("chunks"))
    pair = F.transform(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1), lambda c: F.least(F.col("mine"), c) * F.col("chunks") + F.greatest(F.col("mine"), c))
    units = met.withColumn("chunks", chunks).withColumn("mine", mine).select("key", F.explode(pair).alias("part"), "fp")
    units = units.select(F.xxhash64("key", "part").alias("unit"), "fp").repartition("unit").sortWithinPartitions("unit")

    def link(batches):
        def solve(unit, fp):
            a, b = close_pairs(unit, fp.view(np.uint64))
            root = forest(len(fp), a, b)
            far = np.flatnonzero(root != np.arange(len(fp)))
            return pd.DataFrame({"a": fp[far], "b": fp[root[far]]})

        unit, fp = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for batch in batches:
            unit, fp = np.concatenate([unit, batch["unit"].to_numpy()]), np.concatenate([fp, batch["fp"].to_numpy()])
            cut = int(np.searchsorted(unit, unit[-1])) if len(unit) else 0  # the last unit may go on
            if cut:
                yield solve(unit[:cut], fp[:cut])
                unit, fp = unit[cut:], fp[cut:]
        if len(unit):
            yield solve(unit, fp)

    return units.mapInPandas(link, "a long, b long").distinct()


def components(edges: DataFrame, forest_rows: int = FOREST_ROWS) -> DataFrame:
    """(node, root) for every node of the edges (a, b); root: its component's least node.

    Each round contracts ``forest_rows`` edges at a time to their spanning forest,
    then takes a large-star and a small-star step, until the stars stay the same.
    Edges that one such forest holds are done with it.
    """
    ship(edges.sparkSession)

    def forests(batches):
        def stars(held):
            ends = np.concatenate([held["a"].to_numpy(), held["b"].to_numpy()])
            nodes, at = np.unique(ends, return_inverse=True)  # in order, so the least index is the least node
            root = forest(len(nodes), at[: len(held)], at[len(held) :])
            far = np.flatnonzero(root != np.arange(len(nodes)))
            return pd.DataFrame({"a": nodes[far], "b": nodes[root[far]]})

        held, n = [], 0
        for batch in batches:
            held.append(batch)
            n += len(batch)
            if n >= forest_rows:
                yield stars(pd.concat(held, ignore_index=True))
                held, n = [], 0
        if n:
            yield stars(pd.concat(held, ignore_index=True))

    def star(e: DataFrame, rows: int, large: bool) -> DataFrame:
        both = e.union(e.select("b", "a")).toDF("u", "v")
        side = both if large else both.filter("v < u")
        low = side.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")).withColumn("m", F.least("u", "m"))
        low = materialize(narrow(low, 2 * rows))
        met = join_hot_cold(side.filter("v > u") if large else side, low, ["u"], "n", **extent(low))
        out = met.select(F.col("v").alias("a"), F.col("m").alias("b"))
        if not large:
            out = out.union(low.select(F.col("u").alias("a"), F.col("m").alias("b")))
        return narrow(out.filter("a <> b").distinct(), 2 * rows)

    def state(e: DataFrame) -> tuple:
        r = e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        return r[0], r[1]

    def around(e: DataFrame, rows: int) -> DataFrame:
        e = materialize(e.mapInPandas(forests, "a long, b long"))
        return star(materialize(star(e, rows, True)), rows, False)

    e = materialize(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    before = state(e)
    while before[0]:
        if before[0] <= forest_rows:
            e = materialize(e.coalesce(1).mapInPandas(forests, "a long, b long"))
            break
        e = settled(lambda e=e, rows=before[0]: around(e, rows))
        now = state(e)
        if now == before:
            break
        before = now
    return e.select(F.col("a").alias("node"), F.col("b").alias("root")).union(e.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


def parity_bits(hashes: np.ndarray) -> bytes:
    """Bit i: whether an odd number of the distinct hashes end in i. Eight bits a hash, 2**PARITY_BITS at most."""
    width = 1 << min(max((8 * len(hashes) - 1).bit_length(), 6), PARITY_BITS)
    odd = np.bincount((hashes & np.uint64(width - 1)).astype(np.int64), minlength=width) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def maybe_similar(root: np.ndarray, size: np.ndarray, parity: np.ndarray, similarity: float, near: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of different roots whose sets may have the similarity; it leaves out none that have it.

    ``near``, if given, has the pairs to look at.

    Every hash that one set has and the other has not changes one parity bit, so
    the sets differ by as many hashes as bits at least. Sets of sizes x and y
    have a similarity t or more if they differ by (x + y) (1 - t) / (1 + t) at
    most. Wider bits fold to half the width, and sizes that allow t are one
    width apart at most.
    """
    width = np.fromiter(map(len, parity), np.int64, len(parity))
    read = lambda at: np.frombuffer(b"".join(parity[at]), np.uint64).reshape(len(at), -1)
    first, second = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for w in np.unique(width):
        ours, wider = np.flatnonzero(width == w), np.flatnonzero(width == 2 * w)
        bits, at = read(ours), np.concatenate([ours, wider])
        if len(wider):
            low, high = np.hsplit(read(wider), 2)
            bits = np.concatenate([bits, low ^ high])
        for i, one in enumerate(ours):
            rest = at[i + 1 :]
            fits = np.flatnonzero((root[rest] != root[one]) & (np.minimum(size[rest], size[one]) >= similarity * np.maximum(size[rest], size[one]) - 1e-9))
            fits = fits if near is None else fits[near[one, rest[fits]]]
            differ = np.bitwise_count(bits[i + 1 + fits] ^ bits[i]).sum(axis=1, dtype=np.int64)
            rest = rest[fits]
            left = rest[differ * (1 + similarity) <= (size[rest] + size[one]) * (1 - similarity) + 1e-9]
            first.append(np.full(len(left), one))
            second.append(left)
    return np.concatenate(first), np.concatenate(second)


def near_table(prints: np.ndarray, distance: int = WIDE_DISTANCE) -> np.ndarray:
    """near[i, j]: whether the wide fingerprints (a row of words each) are within the distance.

    The pivot table holds the distances to PIVOTS of them; a pair whose largest
    coordinate difference is above the distance is discarded, the rest is
    verified by its own distance.
    """
    n = len(prints)
    pivots = prints[np.unique(np.linspace(0, n - 1, PIVOTS).astype(int))]
    table = np.stack([np.bitwise_count(prints ^ p).sum(axis=1, dtype=np.int16) for p in pivots], axis=1)
    near = np.zeros((n, n), bool)
    for i in range(n):
        rest = i + 1 + np.flatnonzero((np.abs(table[i + 1 :] - table[i]) <= distance).all(axis=1))
        rest = rest[np.bitwise_count(prints[rest] ^ prints[i]).sum(axis=1, dtype=np.int16) <= distance]
        near[i, rest] = near[rest, i] = True
    return near


def whole_units(batches):
    """Frames that hold all rows of their units, from batches that stand in the order of ``unit``."""
    held = None
    for batch in batches:
        held = batch if held is None else pd.concat([held, batch], ignore_index=True)
        cut = int(np.searchsorted(held["unit"], held["unit"].iloc[-1])) if len(held) else 0
        if cut:
            yield held.iloc[:cut]
            held = held.iloc[cut:]
    if held is not None and len(held):
        yield held


def similar_links(marked: DataFrame, texts: DataFrame, shingle: int, similarity: float, unit_rows: int = UNIT_ROWS) -> DataFrame:
    """(a, b): links whose components are those of all verified pairs of ``fp`` that share a key.

    ``marked`` is materialized (uid, fp, keys, bits), ``texts`` has uid and text. In
    every bucket the members are first verified against its least; then, while
    that finds links, those of other components against another member, LEADERS
    times at most. Only pairs of still different components are left; they meet
    in units of two chunks of a bucket. Everywhere pairs go by the distance of their
    wide fingerprints first; units do so by pivot tables, and give the pairs that
    the sets' parity bits leave possible too. What is left is verified by the sets.
    """
    spark = marked.sparkSession
    ship(spark)

    @F.pandas_udf("array<long>")
    def shingles(text: pd.Series) -> pd.Series:
        return pd.Series([shingle_set(t, shingle).view(np.int64) for t in text])

    def sets_of(needed: DataFrame) -> DataFrame:
        return materialize(texts.join(one.join(needed, "fp", "left_semi"), "uid").select("fp", shingles("text").alias("s")))

    def near(pairs: DataFrame) -> DataFrame:
        """The pairs (a, b) within WIDE_DISTANCE."""
        for side in ("a", "b"):
            pairs = narrow(pairs.join(prints.select(F.col("fp").alias(side), F.col("bits").alias(f"bits_{side}")), side), rows)
        differ = F.zip_with("bits_a", "bits_b", lambda x, y: F.bit_count(x.bitwiseXOR(y)))
        return pairs.filter(F.aggregate(differ, F.lit(0), lambda n, x: n + x) <= WIDE_DISTANCE).drop("bits_a", "bits_b")

    def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
        for side in ("a", "b"):
            pairs = narrow(pairs.join(sets.select(F.col("fp").alias(side), F.col("s").alias(f"s{side}")), side), rows, 20_000)
        both = F.size(F.array_intersect("sa", "sb"))
        return pairs.filter(both / (F.size("sa") + F.size("sb") - both) >= similarity).drop("sa", "sb")

    def still_mixed(members: DataFrame) -> DataFrame:
        """The members (key, fp, root) of buckets of several components, with their number ``n``."""
        members = materialize(narrow(members, rows))
        mixed = members.groupBy("key").agg(F.min("root").alias("r0"), F.max("root").alias("r1"), F.count("*").alias("n")).filter("r0 <> r1")
        mixed = materialize(narrow(mixed.select("key", "n"), rows))
        return narrow(join_hot_cold(members, mixed, ["key"], "n", **extent(mixed)), rows)

    first = materialize(marked.groupBy("fp").agg(F.min("uid").alias("uid"), F.first("keys").alias("keys"), F.first("bits").alias("bits")))
    one, prints = first.select("fp", "uid"), first.select("fp", "bits")
    rows = BANDS * first.count()  # the most that any table of keys or links below can have
    keyed = first.select("fp", F.explode("keys").alias("key"))
    sizes = materialize(narrow(keyed.groupBy("key").agg(F.count("*").alias("n"), F.min("fp").alias("low")).filter("n > 1"), rows))
    met = materialize(narrow(join_hot_cold(keyed, sizes, ["key"], "n", **extent(sizes)), rows))
    tried = materialize(narrow(met.filter("fp <> low").select(F.col("fp").alias("a"), F.col("low").alias("b")).distinct(), rows))
    release(spark)
    close = materialize(near(tried))
    found = materialize(verified(close, sets_of(close.select(F.explode(F.array("a", "b")).alias("fp")).distinct())))
    release(spark)
    roots = settled(lambda: components(found))
    release(spark)
    # a text's root is looked up once, not once a bucket
    held = met.groupBy("fp").agg(F.collect_list("key").alias("ks")).join(roots, F.col("fp") == F.col("node"), "left")
    members = settled(lambda: still_mixed(held.select(F.explode("ks").alias("key"), "fp", F.coalesce("root", "fp").alias("root"))))
    sets = sets_of(members.select("fp").distinct())
    for salt in range(LEADERS):
        leader = materialize(narrow(members.groupBy("key").agg(F.min_by(F.struct("fp", "root"), F.xxhash64("fp", F.lit(salt))).alias("leader"), F.count("*").alias("n")), rows))
        led = join_hot_cold(members.drop("n"), leader, ["key"], "n", **extent(leader)).filter("root <> leader.root")
        swap = F.col("fp") < F.col("leader.fp")
        pairs = led.select(F.greatest("fp", "leader.fp").alias("a"), F.least("fp", "leader.fp").alias("b"), F.when(swap, F.col("leader.root")).otherwise(F.col("root")).alias("ra"), F.when(swap, F.col("root")).otherwise(F.col("leader.root")).alias("rb")).distinct()
        pairs = materialize(narrow(pairs.join(tried, ["a", "b"], "left_anti"), rows))
        new = materialize(verified(near(pairs), sets))
        if new.isEmpty():
            break
        found, tried = materialize(narrow(found.union(new.select("a", "b")), rows)), materialize(narrow(tried.union(pairs.select("a", "b")), rows))
        joined = settled(lambda new=new: components(new.select(F.col("ra").alias("a"), F.col("rb").alias("b"))))
        moved = members.groupBy("fp").agg(F.first("root").alias("root"), F.collect_list("key").alias("ks")).join(joined.toDF("root", "new_root"), "root", "left")
        members = settled(lambda moved=moved: still_mixed(moved.select(F.explode("ks").alias("key"), "fp", F.coalesce("new_root", "root").alias("root"))))
        release(spark)

    @F.pandas_udf("binary")
    def parity(hashes: pd.Series) -> pd.Series:
        return pd.Series([parity_bits(s.view(np.uint64)) for s in hashes])

    def sift(batches):
        for held in whole_units(batches):
            begins = np.flatnonzero(np.diff(held["unit"].to_numpy(), prepend=held["unit"].iloc[0] - 1))
            fp, root, size, odd, bits = (held[c].to_numpy() for c in ("fp", "root", "size", "parity", "bits"))
            for i, j in zip(begins, [*begins[1:], len(held)]):
                a, b = maybe_similar(root[i:j], size[i:j], odd[i:j], similarity, near_table(np.stack(bits[i:j]).view(np.uint64)))
                if len(a):
                    yield pd.DataFrame({"a": np.maximum(fp[i + a], fp[i + b]), "b": np.minimum(fp[i + a], fp[i + b])})

    chunks = F.ceil(F.col("n") / unit_rows)
    parts = F.transform(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1), lambda c: F.least(F.col("mine"), c) * F.col("chunks") + F.greatest(F.col("mine"), c))
    odd = materialize(sets.join(members.select("fp").distinct(), "fp", "left_semi").select("fp", F.size("s").alias("size"), parity("s").alias("parity")).join(prints, "fp"))
    units = members.withColumn("chunks", chunks).withColumn("mine", F.pmod(F.xxhash64("fp"), F.col("chunks"))).select(F.explode(parts).alias("part"), "key", "fp", "root")
    units = units.join(odd, "fp").select(F.xxhash64("key", "part").alias("unit"), "fp", "root", "size", "parity", "bits").repartition("unit").sortWithinPartitions("unit")
    across = materialize(narrow(units.mapInPandas(sift, "a long, b long").distinct().join(tried, ["a", "b"], "left_anti"), rows))
    release(spark)
    return found.union(verified(across, sets))


def simhash_groups(marked: DataFrame, find=links) -> DataFrame:
    """``marked`` (materialized: doc_id, uid, fp) with its group's least doc_id and uid.

    ``find`` gives the links between the distinct ``fp``.
    """
    least = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "uid")).alias("least")
    total = marked.count()
    prints = materialize(narrow(marked.groupBy("fp").agg(least, F.count("*").alias("n")), total))
    roots = settled(lambda: components(find(prints.select("fp"))))
    linked = prints.join(roots, prints["fp"] == roots["node"])
    tops = linked.groupBy("root").agg(F.min("least").alias("top"), F.count("*").alias("size"))
    named = join_hot_cold(linked.drop("node"), tops, ["root"], "size", max(1, roots.count())).select("fp", F.col("top").alias("least"), "n")
    alone = prints.join(roots.select(F.col("node").alias("fp")), "fp", "left_anti").select("fp", "least", "n")
    groups = materialize(narrow(named.unionByName(alone), total))
    out = join_hot_cold(marked, groups, ["fp"], "n", max(1, total))
    return out.select("doc_id", "uid", "fp", F.col("least.doc_id").alias("component_id"), F.col("least.uid").alias("keep_uid"))


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, fingerprint, component_id.

    Defined cases: a null, empty or blank text has fingerprint zero and links
    like any other; a null id is never a component's id unless all its ids are
    null; repeated rows share a fingerprint and so a component; an empty table
    gives an empty result; further columns are ignored.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), full_text(text_col).alias("text"), F.monotonically_increasing_id().alias("uid"))
    marked = materialize(fingerprints(rows))
    return simhash_groups(marked).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def kept_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one document of each group, that of the smallest id."""
    held = materialize(docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.monotonically_increasing_id().alias("uid")))
    marked = materialize(fingerprints(held.select(F.col("row")[id_col].alias("doc_id"), "uid", full_text(F.col("row")[text_col]).alias("text"))))
    gone = simhash_groups(marked).filter("uid <> keep_uid").select("uid")
    return held.join(gone, "uid", "left_anti").select("row.*")


def kept_similar(docs: DataFrame, shingle: int = 5, similarity: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one document of each group, that of the smallest id.

    Documents link whose sets of ``shingle`` words (ASCII case aside) have a
    Jaccard similarity of ``similarity`` or more; texts of fewer words are one
    shingle, null and blank texts link with each other.
    """
    held = materialize(docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.monotonically_increasing_id().alias("uid")))
    texts = held.select("uid", full_text(F.col("row")[text_col]).alias("text"))
    rows = held.select(F.col("row")[id_col].alias("doc_id"), "uid", full_text(F.col("row")[text_col]).alias("text"))

    def leave() -> DataFrame:
        marked = materialize(sketches(rows, shingle))
        release(docs.sparkSession)
        return simhash_groups(marked.drop("keys", "bits"), lambda _: similar_links(marked, texts, shingle, similarity)).filter("uid <> keep_uid").select("uid")

    gone = settled(leave)
    release(docs.sparkSession)
    return held.join(gone, "uid", "left_anti").select("row.*")
