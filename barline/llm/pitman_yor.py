"""LM scoring: a hierarchical Pitman-Yor model over words.

Four levels of restaurants. Each training word is a context restaurant of its
own, whose dishes are the words that follow it: every (word, next word) pair of
the corpus is a cell with its customers. Contexts of about the same frequency
share a parent, a group restaurant: the FREQUENT commonest words have one each,
all others one per octave of their count. Its dishes are groups of next words,
its customers the tables of its contexts (a share d / c_w of which was the
word's being new, and counts for the unseen). Group restaurants share a root, and
inside a group the word restaurant divides: with a diffuse base every word sits
at one table, P1(w) = (c_w - d) / (theta + N), and an unseen word gets
(theta + d V) / (theta + N). So
P(w | u) = (n - d t + (theta + d T_u) P(w | group(u))) / (theta + n_u),
P(w | group(u)) = P(group(w) | group(u)) P1(w) / P1(group(w)),
normalised over the V training words and the one unseen type. Tables t are
sampled by Gibbs sweeps: the customers of a cell leave together and are seated
one after another by the Chinese restaurant rule, given the parent and all other
tables (those of the sweep before: cells are visited in parallel). Predictive
probabilities are averaged over samples. Discounts come from the numbers of cells
seen once and twice; for the contexts, discount and theta are then fitted by the
leave-one-out likelihood. Above them theta is 1.

At scale: a task turns texts into chunks of codes. Blocks of word hashes merge
the chunks' vocabularies; blocks of cells merge their pairs, all cells of a
context in one block, but those of the FREQUENT contexts dealt out by their next
word as well. A block is one row, its size fixed by the number of blocks, which
grows with the corpus. What all tasks get is bounded whatever the corpus: a
matrix of (FREQUENT + 65)^2 probabilities and the totals of FREQUENT contexts.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pandas as pd
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barline import ship
from barline.llm.common import full_text, materialize, release

FREQUENT = 1024
OCTAVES = 64
CHUNK_TOKENS = 1_500_000
CHUNK_DOCS = 20_000
#: Vocabulary entries and pairs that a block merges, about.
BLOCK_WORDS, BLOCK_PAIRS = 2_000_000, 1_500_000
#: Tried fits of the contexts: discount (times the estimate by cells seen once and twice) and concentration (times the discount).
FITS = [(d, ratio) for d in (0.7, 0.8, 0.9, 1.0, 1.1) for ratio in (-0.8, -0.5, -0.25, 0.0, 0.5, 1.0, 4.0)]
SWEEPS = 3
SAMPLES = 4
ROUNDS = 2
THETA = 1.0
END = b""  # the end of a text; never a word
GROUPS = FREQUENT + OCTAVES + 1  # the last one: unseen words
UNSEEN = GROUPS - 1


def word_hash(word: bytes) -> int:
    """64-bit hash; the end token's is that of the empty string."""
    return xxhash.xxh64_intdigest(word, 7)


def pack(values: np.ndarray) -> bytes:
    """Unsigned integers, deflated as byte planes (small ones are frequent)."""
    return zlib.compress(np.ascontiguousarray(values.view(np.uint8).reshape(-1, values.itemsize).T).tobytes(), 1)


def unpack(data: bytes, kind) -> np.ndarray:
    kind = np.dtype(kind)
    return np.ascontiguousarray(np.frombuffer(zlib.decompress(data), np.uint8).reshape(kind.itemsize, -1).T).view(kind).ravel()


def pack_sorted(values: np.ndarray) -> bytes:
    return pack(np.diff(values, prepend=np.uint64(0)))


def unpack_sorted(data: bytes) -> np.ndarray:
    return np.cumsum(unpack(data, np.uint64), dtype=np.uint64)


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    return h ^ (h >> np.uint64(33))


CHUNK_SCHEMA = "chunk long, doc_ids array<string>, train binary, lengths binary, codes binary, high binary, low binary, seen binary, trained binary"


def chunks(docs: DataFrame, chunk_tokens: int = CHUNK_TOKENS) -> DataFrame:
    """Texts as chunks of codes; ``docs`` has doc_id (string), train, text.

    A chunk's vocabulary stands in the order of its hashes (their upper 40 bits,
    as steps, and the other 24), with the words' counts in the chunk and in its
    training texts; codes are ranks by count.
    """

    def encode(batches):
        part = TaskContext.get().partitionId()
        made = 0
        ids, train, coded, n = [], [], [], 0
        vocabulary: dict[bytes, int] = {}

        def flush():
            lengths = np.array([len(c) for c in coded], np.int64)
            codes = np.concatenate(coded)
            hashes = np.fromiter(map(word_hash, vocabulary), np.uint64, len(vocabulary))
            place = np.argsort(hashes)
            seen = np.bincount(codes, minlength=len(hashes))[place]
            trained = np.bincount(codes[np.repeat(np.array(train, bool), lengths)], minlength=len(hashes))[place]
            rank = np.empty(len(hashes), np.uint32)
            rank[place[by_count(seen)]] = np.arange(len(hashes), dtype=np.uint32)
            return pd.DataFrame(
                {
                    "chunk": [(part << 33) + made],
                    "doc_ids": [list(ids)],
                    "train": [np.array(train, np.uint8).tobytes()],
                    "lengths": [lengths.tobytes()],
                    "codes": [pack(rank[codes])],
                    "high": [pack_sorted(hashes[place] >> np.uint64(24))],
                    "low": [pack((hashes[place] & np.uint64(0xFFFFFF)).astype(np.uint32))],
                    "seen": [pack(seen.astype(np.uint32))],
                    "trained": [pack(trained.astype(np.uint32))],
                }
            )

        for batch in batches:
            for i, t, text in zip(batch["doc_id"], batch["train"], batch["text"]):
                ws = text.encode("utf-8", "surrogatepass").lower().split()
                ws.append(END)
                for w in ws:
                    vocabulary.setdefault(w, len(vocabulary))
                ids.append(i)
                train.append(t)
                coded.append(np.fromiter(map(vocabulary.__getitem__, ws), np.uint32, len(ws)))
                n += len(ws)
                if n >= chunk_tokens or len(ids) >= CHUNK_DOCS:
                    yield flush()
                    made += 1
                    ids, train, coded, n = [], [], [], 0
                    vocabulary.clear()
        if ids:
            yield flush()

    return docs.mapInPandas(encode, CHUNK_SCHEMA)


def by_count(seen: np.ndarray) -> np.ndarray:
    """Positions by falling count."""
    return np.argsort(-seen.astype(np.int64), kind="stable")


# --- words -----------------------------------------------------------------------

WORDS_SCHEMA = "part int, chunk long, data binary, w decimal(20,0), c long, o int, v long, n1 long, n2 long"


def word_counts(coded: DataFrame, blocks: int) -> DataFrame:
    """Training counts of words, merged by blocks of hashes.

    Rows by ``chunk``: 0 or more, the counts of that chunk's words in this block,
    in the order of hashes; -1, a candidate (w, c) for the commonest; -2, an
    octave's customers c, types v and types seen once and twice.
    """
    edges = [(b << 64) // blocks for b in range(1, blocks)]

    def slices(batches):
        for batch in batches:
            for row in batch.itertuples():
                hashes, trained = (unpack_sorted(row.high) << np.uint64(24)) | unpack(row.low, np.uint32), unpack(row.trained, np.uint32)
                cut = [0, *np.searchsorted(hashes, np.array(edges, np.uint64)), len(hashes)]
                yield pd.DataFrame([(b, row.chunk, hashes[i:j].tobytes(), pack(trained[i:j])) for b, (i, j) in enumerate(zip(cut, cut[1:]))], columns=["part", "chunk", "hashes", "trained"])

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("chunk")
        hashes = [np.frombuffer(h, np.uint64) for h in pdf["hashes"]]
        known, at = np.unique(np.concatenate(hashes), return_inverse=True)
        c = np.zeros(len(known), np.uint64)
        np.add.at(c, at, np.concatenate([unpack(t, np.uint32) for t in pdf["trained"]]).astype(np.uint64))
        part, rows = int(pdf["part"].iloc[0]), []
        cut = np.cumsum([0, *map(len, hashes)])
        for chunk, i, j in zip(pdf["chunk"], cut, cut[1:]):
            rows.append((part, chunk, pack(c[at[i:j]]), None, None, None, None, None, None))
        top = np.argsort(-c.astype(np.int64), kind="stable")[:FREQUENT]
        rows += [(part, -1, None, int(known[k]), int(c[k]), None, None, None, None) for k in top if c[k]]
        octave = np.floor(np.log2(np.maximum(c, 1))).astype(np.int64)
        for o in np.unique(octave[c > 0]):
            mine = c[(octave == o) & (c > 0)]
            rows.append((part, -2, None, None, int(mine.sum()), int(o), len(mine), int((mine == 1).sum()), int((mine == 2).sum())))
        out = pd.DataFrame(rows, columns=[f.split()[0] for f in WORDS_SCHEMA.replace("(20,0)", "").split(", ")])
        from decimal import Decimal

        out["w"] = [None if x is None or pd.isna(x) else Decimal(int(x)) for x in (r[3] for r in rows)]
        return out.astype({n: "Int64" for n in ("c", "o", "v", "n1", "n2")})

    return coded.select("chunk", "high", "low", "trained").mapInPandas(slices, "part int, chunk long, hashes binary, trained binary").groupBy("part").applyInPandas(merge, WORDS_SCHEMA)


# --- pairs -----------------------------------------------------------------------


class Chunk:
    """A chunk with its distinct pairs, in the order in which blocks get and return them."""

    def __init__(self, row, frequent: np.ndarray, blocks: int):
        self.hashes = unpack_sorted(row.high)  # 40 bits
        self.lengths = np.frombuffer(row.lengths, np.int64)
        self.train = np.frombuffer(row.train, np.uint8).astype(bool)
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.after = by_count(unpack(row.seen, np.uint32))[unpack(row.codes, np.uint32)]
        before = np.empty_like(self.after)
        before[1:] = self.after[:-1]
        before[self.starts] = np.searchsorted(self.hashes, np.uint64(word_hash(END) >> 24))  # a text begins after the end of another
        v = len(self.hashes)
        pairs, at = np.unique(before * v + self.after, return_inverse=True)
        u, w = pairs // v, pairs % v
        hot = np.isin(self.hashes, frequent)[u]
        block = (mixed(self.hashes[u] + np.where(hot, mixed(self.hashes[w]), np.uint64(0))) % np.uint64(blocks)).astype(np.int64)
        order = np.argsort(block, kind="stable")
        self.u, self.w, self.block = u[order], w[order], block[order]
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        self.pair = place[at]  # of every token
        self.n = np.bincount(self.pair[np.repeat(self.train, self.lengths)], minlength=len(order))


def groups_of(hashes: np.ndarray, c: np.ndarray, frequent: np.ndarray, ranks: np.ndarray, least: int) -> np.ndarray:
    """The group of each word; ``frequent`` is sorted, ``ranks`` has its groups, ``least`` its smallest count."""
    g = np.where(c > 0, FREQUENT + np.floor(np.log2(np.maximum(c, 1))).astype(np.int64), UNSEEN)
    if len(frequent):
        at = np.minimum(np.searchsorted(frequent, hashes), len(frequent) - 1)
        g = np.where((frequent[at] == hashes) & (c >= least), ranks[at], g)
    return g


PAIRS_SCHEMA = "block int, chunk long, uh binary, uc binary, un binary, w binary, wc binary, n binary"


def short(hashes: np.ndarray) -> np.ndarray:
    """32 bits that with its count tell a word from others after the same context."""
    return (mixed(hashes) >> np.uint64(32)).astype(np.uint32)


def send_pairs(frequent: np.ndarray, blocks: int):
    def send(rows: pd.DataFrame, counts: pd.DataFrame) -> pd.DataFrame:
        out = []
        for row in rows.itertuples():
            ch = Chunk(row, frequent, blocks)
            c = np.concatenate([unpack(d, np.uint64) for d in counts.sort_values("part")["data"]])
            cut = np.searchsorted(ch.block, np.arange(blocks + 1))
            for b in np.flatnonzero(np.diff(cut)):
                u, w, n = (x[cut[b] : cut[b + 1]] for x in (ch.u, ch.w, ch.n))
                first = np.flatnonzero(np.diff(u, prepend=-1))
                runs = np.diff(first, append=len(u)).astype(np.uint32)
                out.append((b, row.chunk, pack_sorted(ch.hashes[u[first]]), pack(c[u[first]]), pack(runs), pack(short(ch.hashes[w])), pack(c[w]), pack(n.astype(np.uint32))))
        return pd.DataFrame(out, columns=[f.split()[0] for f in PAIRS_SCHEMA.split(", ")])

    return send


CELLS_SCHEMA = "block int, ctx binary, ug binary, wc binary, wg binary, n binary, chunks array<long>, refs array<binary>"


def merged_cells(frequent: np.ndarray, ranks: np.ndarray, least: int):
    """Merges a block's pairs; ``frequent`` is sorted, ``ranks`` has its groups."""
    by_short = np.argsort(short(frequent), kind="stable")
    return lambda pdf: merge_pairs(pdf, (frequent, ranks, least), (short(frequent)[by_short], ranks[by_short], least))


def merge_pairs(pdf: pd.DataFrame, frequent, frequent_short) -> pd.DataFrame:
    """All cells of a block, by context, and for every chunk the cells of its pairs."""
    pdf = pdf.sort_values("chunk")
    runs = [unpack(x, np.uint32) for x in pdf["un"]]
    uh = np.concatenate([np.repeat(unpack_sorted(x), r) for x, r in zip(pdf["uh"], runs)])
    uc = np.concatenate([np.repeat(unpack(x, np.uint64), r) for x, r in zip(pdf["uc"], runs)])
    w = [unpack(x, np.uint32) for x in pdf["w"]]
    known, wc = np.concatenate(w), np.concatenate([unpack(x, np.uint64) for x in pdf["wc"]])
    _, first, at = np.unique(mixed(uh + mixed((known.astype(np.uint64) << np.uint64(32)) ^ wc)), return_index=True, return_inverse=True)
    n = np.bincount(at, np.concatenate([unpack(x, np.uint32) for x in pdf["n"]])).astype(np.uint64)
    order = np.argsort(uh[first], kind="stable")
    place = np.empty(len(order), np.uint32)
    place[order] = np.arange(len(order), dtype=np.uint32)
    first = first[order]
    starts = np.diff(uh[first], prepend=uh[first[:1]] + np.uint64(1)) != 0
    cut = np.cumsum([0, *map(len, w)])
    wc = wc[first]
    wg = groups_of(known[first], wc, *frequent_short)
    ug = groups_of(uh[first[starts]], uc[first[starts]], *frequent)
    return pd.DataFrame(
        {
            "block": [int(pdf["block"].iloc[0])],
            "ctx": [pack(starts.astype(np.uint8))],
            "ug": [pack(ug.astype(np.uint16))],
            "wc": [pack(wc)],
            "wg": [pack(wg.astype(np.uint16))],
            "n": [pack(n[order])],
            "chunks": [pdf["chunk"].tolist()],
            "refs": [[pack(np.diff(place[at[i:j]].astype(np.int64), prepend=0).astype(np.int32).view(np.uint32)) for i, j in zip(cut, cut[1:])]],
        }
    )


# --- restaurants -----------------------------------------------------------------


def seat(c: np.ndarray, a: np.ndarray, grow: np.ndarray, d: float, rng: np.random.Generator) -> np.ndarray:
    """Tables of dishes with ``c`` customers seated one after another.

    With i seated at t tables the next customer opens one with probability
    a / (a + i - d t), a having grown by ``grow`` a table. The first 50 come one
    by one, later ones in groups of 2 % of those seated, at the same odds.
    """
    t = (c > 0).astype(np.int64)
    i = np.ones(len(c), np.int64)
    live = np.flatnonzero(c > 1)
    while len(live):
        coming = np.minimum(1 + i[live] // 50, c[live] - i[live])
        weight = a[live] + grow[live] * t[live]
        odds = weight / (weight + i[live] - d * t[live])
        t[live] += rng.binomial(coming, odds) if coming.max() > 1 else rng.random(len(live)) < odds
        i[live] += coming
        live = live[i[live] < c[live]]
    return t


def discount(n1: float, n2: float) -> float:
    """Discount from the numbers of types seen once and twice."""
    return float(np.clip(n1 / (n1 + 2 * n2), 0.1, 0.95)) if n1 + n2 > 0 else 0.5


@dataclass
class Model:
    n: int  # training tokens
    v: int  # training types
    d: float  # discount of the word restaurant
    share: np.ndarray  # (GROUPS,) P1 by group
    table: np.ndarray | None = None  # (GROUPS, GROUPS) P(group | group before)
    d_words: float = 0.5  # discount and concentration of the contexts
    theta_words: float = 0.0
    hot: np.ndarray | None = None  # (2, FREQUENT) customers and tables of the FREQUENT contexts

    def word(self, c: np.ndarray) -> np.ndarray:
        """P1 of words by count; 0 is the unseen type."""
        return np.where(c > 0, np.maximum(c - self.d, 1e-9), THETA + self.d * self.v) / (THETA + self.n)

    def parent(self, ug: np.ndarray, wg: np.ndarray, wc: np.ndarray) -> np.ndarray:
        """P(w | group before)."""
        return self.table[ug, wg] * (self.word(wc) / self.share[wg])


class Cells:
    """A block of cells, and its tables: one for each cell with customers at first."""

    def __init__(self, row):
        self.ctx = np.cumsum(unpack(row.ctx, np.uint8)) - 1
        self.ug = unpack(row.ug, np.uint16).astype(np.int64)
        self.wc, self.wg = unpack(row.wc, np.uint64).astype(np.int64), unpack(row.wg, np.uint16).astype(np.int64)
        self.n = unpack(row.n, np.uint64).astype(np.int64)
        self.t = (self.n > 0).astype(np.int64)
        self.block = int(row.block)

    def totals(self, model: Model) -> tuple[np.ndarray, np.ndarray]:
        """Customers and tables by context; those of the FREQUENT are spread over blocks and come with the model."""
        n, t = np.bincount(self.ctx, self.n, len(self.ug)), np.bincount(self.ctx, self.t, len(self.ug))
        hot = self.ug < FREQUENT
        n[hot], t[hot] = model.hot[:, self.ug[hot]]
        return n, t

    def sweeps(self, model: Model, first: int, count: int):
        """Gibbs sweeps given the parent; yields after each."""
        p = model.parent(self.ug[self.ctx], self.wg, self.wc)
        many = np.flatnonzero(self.n > 1)
        for sweep in range(first, first + count):
            _, tables = self.totals(model)
            rest = tables[self.ctx[many]] - self.t[many]
            grow = model.d_words * p[many]
            rng = np.random.default_rng([sweep, self.block])
            self.t[many] = seat(self.n[many], np.maximum(model.theta_words * p[many] + grow * np.maximum(rest, 0), 0.0), grow, model.d_words, rng)
            yield p

    def leave_one_out(self, model: Model, p: np.ndarray) -> np.ndarray:
        """Log-likelihood of every customer given all others, by FITS of discount and concentration."""
        at = np.flatnonzero(self.n > 0)
        n, t, p = self.n[at], self.t[at], p[at]
        customers, tables = (x[self.ctx[at]] - k for x, k in zip(self.totals(model), (1, (n == 1).astype(np.int64))))
        out = []
        for d, ratio in FITS:
            d = min(d * model.d_words, 0.98)
            theta = ratio * d
            own = np.where(n > 1, np.maximum(n - 1 - d * t, 0.0), 0.0)
            like = np.where(customers > 0, (own + np.maximum(theta + d * tables, 0.0) * p) / np.maximum(theta + customers, 1e-9), p)
            out.append(float((n * np.log(np.maximum(like, 1e-300))).sum()))
        return np.array(out)


def _sums(shared, first: int, count: int):
    """Tables by (group before, group), customers and tables of FREQUENT contexts, cells seen once and twice, fits."""

    def visit(batches):
        for batch in batches:
            for row in batch.itertuples():
                cells, fits = Cells(row), np.zeros(len(FITS))
                for p in cells.sweeps(shared.value, first, count) if count else ():
                    pass
                if count:
                    fits = cells.leave_one_out(shared.value, p)
                ug = cells.ug[cells.ctx]
                new = cells.t * shared.value.d / np.maximum(cells.wc, 1)  # of the c customers of a word, d stand for its being new
                by_group = np.bincount(ug * GROUPS + cells.wg, cells.t - new, GROUPS * GROUPS) + np.bincount(ug * GROUPS + UNSEEN, new, GROUPS * GROUPS)
                hot = [np.bincount(ug[ug < FREQUENT], x[ug < FREQUENT], FREQUENT) for x in (cells.n, cells.t)]
                sums = np.concatenate([by_group, *hot, [(cells.n == 1).sum(), (cells.n == 2).sum()], fits])
                at = np.flatnonzero(sums)
                yield pd.DataFrame({"at": at, "x": sums[at]})

    return visit


def word_sums(cells: DataFrame, model: Model, first: int, count: int) -> tuple[DataFrame, np.ndarray, tuple[int, int], np.ndarray]:
    """(before, after, n) of the group restaurants, the FREQUENT contexts' totals, cells seen once and twice, fits."""
    shared = cells.sparkSession.sparkContext.broadcast(model)
    sums = materialize(cells.drop("chunks", "refs").mapInPandas(_sums(shared, first, count), "at int, x double").groupBy("at").agg(F.sum("x").alias("x")))
    tail = np.zeros(2 * FREQUENT + 2 + len(FITS))
    for r in sums.filter(F.col("at") >= GROUPS * GROUPS).collect():  # bounded: one row each of ``tail``
        tail[r["at"] - GROUPS * GROUPS] = r["x"]
    pairs = sums.filter(F.col("at") < GROUPS * GROUPS).select(F.expr(f"at div {GROUPS}").cast("int").alias("before"), (F.col("at") % GROUPS).alias("after"), F.round("x").cast("long").alias("n")).filter("n > 0")
    hot, rest = tail[: 2 * FREQUENT].reshape(2, FREQUENT), tail[2 * FREQUENT :]
    return pairs, hot, (int(rest[0]), int(rest[1])), rest[2:]


def send_scores(shared, first: int):
    def send(batches):
        m = shared.value
        for batch in batches:
            for row in batch.itertuples():
                cells = Cells(row)
                mean = np.zeros(len(cells.n))
                for k, p in enumerate(cells.sweeps(m, first, SWEEPS + SAMPLES)):
                    if k >= SWEEPS:
                        n, t = (x[cells.ctx] for x in cells.totals(m))
                        own = np.maximum(cells.n - m.d_words * cells.t, 0.0)
                        mean += np.where(n > 0, (own + (m.theta_words + m.d_words * t) * p) / np.maximum(m.theta_words + n, 1e-9), p)
                value = np.log10(mean / SAMPLES).astype(np.float32)
                refs = [value[np.cumsum(unpack(r, np.uint32).view(np.int32).astype(np.int64))] for r in row.refs]
                yield pd.DataFrame({"chunk": list(row.chunks), "part": int(row.block), "kind": 1, "data": [pack(v.view(np.uint32)) for v in refs]})

    return send


def _block(pdf: pd.DataFrame):
    before, after, n = (pdf[c].to_numpy(np.int64) for c in ("before", "after", "n"))
    order = np.lexsort((after, before))
    return before[order], after[order], n[order], int(pdf["block"].iloc[0])


def _tables(sweep: int, state, d: float, before, after, n, block: int) -> np.ndarray:
    """One Gibbs visit to a block of context restaurants, given parent and table counts; reproducible."""
    parent, tables = state
    return seat(n, (THETA + d * tables[before]) * parent[after], np.zeros(len(n)), d, np.random.default_rng([sweep, block]))


def _visit(sweep: int, shared, d: float):
    """Sums of a visit's tables by context and by dish."""

    def visit(pdf: pd.DataFrame) -> pd.DataFrame:
        before, after, n, block = _block(pdf)
        t = _tables(sweep, shared.value, d, before, after, n, block)
        by_context, by_dish = np.bincount(before, t, GROUPS), np.bincount(after, t, GROUPS)
        at = np.concatenate([np.flatnonzero(by_context), GROUPS + np.flatnonzero(by_dish)])
        return pd.DataFrame({"at": at, "t": np.concatenate([by_context, by_dish])[at].astype(np.int64)})

    return visit


def _predict(shared, d: float):
    """Rows of averaged predictive probabilities of a block's contexts; visits the samples' states again."""

    def predict(pdf: pd.DataFrame) -> pd.DataFrame:
        before, after, n, block = _block(pdf)
        contexts, row = np.unique(before, return_inverse=True)
        total = np.bincount(row, n)
        mean = np.zeros((len(contexts), GROUPS))
        for sweep, state, root in shared.value:
            t = _tables(sweep, state, d, before, after, n, block)
            mean += ((THETA + d * np.bincount(row, t)) / (THETA + total))[:, None] * root
            mean[row, after] += (n - d * t) / (THETA + total)[row]
        mean = (mean / max(len(shared.value), 1)).astype(np.float32)
        return pd.DataFrame({"before": contexts, "row": [r.tobytes() for r in mean]})

    return predict


def sample_tables(cells: DataFrame, share: np.ndarray, sweeps: int = SWEEPS, samples: int = SAMPLES) -> np.ndarray:
    """(GROUPS, GROUPS) averaged predictive probabilities from ``cells`` (before, after, n).

    A sweep is a job over the context restaurants given the parent; only its
    sums, two vectors of GROUPS, come back, and the parent is sampled from them.
    A context without customers predicts as its parent does.
    """
    spark = cells.sparkSession
    ones = cells.agg(F.count_if(F.col("n") == 1), F.count_if(F.col("n") == 2)).first()
    d = discount(ones[0] or 0, ones[1] or 0)
    blocks = cells.withColumn("block", F.col("before") % 32)
    root, tables_of = share.copy(), np.ones(GROUPS)
    kept = []
    for sweep in range(sweeps + samples):
        state = (root, tables_of)
        shared = spark.sparkContext.broadcast(state)
        seated = blocks.groupBy("block").applyInPandas(_visit(sweep, shared, d), "at int, t long").groupBy("at").agg(F.sum("t").alias("t"))
        sums = np.zeros(2 * GROUPS)
        for r in seated.collect():
            sums[r["at"]] = r["t"]
        tables_of, customers = sums[:GROUPS], sums[GROUPS:]
        rng = np.random.default_rng([sweep, 10_000])
        opened = seat(customers.astype(np.int64), (THETA + d * (customers > 0).sum()) * share, np.zeros(GROUPS), d, rng)
        root = (customers - d * opened + (THETA + d * opened.sum()) * share) / (THETA + customers.sum())
        if sweep >= sweeps:
            kept.append((sweep, state, root))
    shared = spark.sparkContext.broadcast(kept)
    table = np.tile(np.mean([k[2] for k in kept], axis=0).astype(np.float32), (GROUPS, 1))
    for r in blocks.groupBy("block").applyInPandas(_predict(shared, d), "before int, row binary").toLocalIterator():
        table[r["before"]] = np.frombuffer(r["row"], np.float32)
    return table


def lm_score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", held_out=None, chunk_tokens: int = CHUNK_TOKENS) -> DataFrame:
    """One row per input row: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, perplexity.

    ``held_out`` is a boolean column, by default crc32(id as text) mod 5 = 1.
    ``perplexity`` is 10^(-score / n_tokens).

    Defined cases: a null or empty text is the end token alone; a null id is not
    held out; repeated rows are texts of their own and count as often as they
    come; with nothing to learn from, every token is the unseen type; an empty
    table gives an empty result; further columns are ignored.
    """
    spark = docs.sparkSession
    ship(spark)
    id_type = docs.schema[id_col].dataType.simpleString()
    out = F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 1 if held_out is None else held_out
    rows = docs.select(F.col(id_col).cast("string").alias("doc_id"), (~F.coalesce(out, F.lit(False))).alias("train"), full_text(text_col).alias("text"))
    coded = materialize(chunks(rows, chunk_tokens))
    entries = (coded.agg(F.sum(F.octet_length("low"))).first()[0] or 0) // 3
    words = materialize(word_counts(coded, max(1, -(-entries // BLOCK_WORDS))))

    octaves = words.filter("chunk = -2").groupBy("o").agg(*[F.sum(x).alias(x) for x in ("c", "v", "n1", "n2")]).collect()  # at most OCTAVES rows
    n, v = sum(r["c"] for r in octaves), sum(r["v"] for r in octaves)
    d = discount(sum(r["n1"] for r in octaves), sum(r["n2"] for r in octaves))
    top = words.filter("chunk = -1").orderBy(F.col("c").desc(), "w").limit(FREQUENT).collect()
    share = np.zeros(GROUPS)
    for r in octaves:
        share[FREQUENT + r["o"]] += r["c"] - d * r["v"]
    for g, c in enumerate(r["c"] for r in top):
        share[g] = c - d
        share[FREQUENT + int(np.log2(c))] -= c - d
    share[UNSEEN] = THETA + d * v
    share = np.maximum(share, 1e-12) / (THETA + n)
    frequent = np.array([int(r["w"]) >> 24 for r in top], np.uint64)
    least = min((r["c"] for r in top), default=1)
    release(spark)
    ranks = np.argsort(frequent, kind="stable")
    frequent = frequent[ranks]

    blocks = max(1, -(-n // BLOCK_PAIRS))  # a pair at most for every token
    counts = words.filter("chunk >= 0").select("chunk", "part", "data")
    pairs = coded.drop("doc_ids", "trained", "low").groupBy("chunk").cogroup(counts.groupBy("chunk")).applyInPandas(send_pairs(frequent, blocks), PAIRS_SCHEMA)
    cells = materialize(pairs.groupBy("block").applyInPandas(merged_cells(frequent, ranks, least), CELLS_SCHEMA))
    del pairs
    release(spark)

    model = Model(n, v, d, share)
    group_cells, model.hot, seen, _ = word_sums(cells, model, 0, 0)
    model.d_words = discount(*seen)
    for r in range(ROUNDS):
        model.table = sample_tables(group_cells, share) if r == ROUNDS - 1 else sample_tables(group_cells, share, 2, 1)
        if r < ROUNDS - 1:
            group_cells, model.hot, _, fits = word_sums(cells, model, 100 * r, SWEEPS)
            scale, ratio = FITS[int(np.argmax(fits))]
            model.d_words = min(scale * model.d_words, 0.98)
            model.theta_words = ratio * model.d_words
    release(spark)
    shared = spark.sparkContext.broadcast(model)
    found = cells.mapInPandas(send_scores(shared, 1000), "chunk long, part int, kind int, data binary").unionByName(counts.withColumn("kind", F.lit(0)))

    def score(rows: pd.DataFrame, found: pd.DataFrame) -> pd.DataFrame:
        m, outs = shared.value, []
        found = found.sort_values("part")
        for row in rows.itertuples():
            ch = Chunk(row, frequent, blocks)
            c = np.concatenate([unpack(x, np.uint64) for x in found["data"][found["kind"] == 0]]).astype(np.int64)[ch.after]
            pair = np.concatenate([unpack(x, np.uint32).view(np.float32) for x in found["data"][found["kind"] == 1]]).astype(np.float64)
            outs.append(
                pd.DataFrame(
                    {
                        "doc_id": list(row.doc_ids),
                        "train": ch.train,
                        "n_tokens": ch.lengths,
                        "n_known": np.add.reduceat((c > 0).astype(np.int64), ch.starts),
                        "base_score": np.add.reduceat(np.log10((c + 0.5) / (m.n + 0.5 * (m.v + 1))), ch.starts),
                        "score": np.add.reduceat(pair[ch.pair], ch.starts),
                    }
                )
            )
        return pd.concat(outs) if outs else pd.DataFrame({c: [] for c in ("doc_id", "train", "n_tokens", "n_known", "base_score", "score")})

    scored = coded.drop("trained", "low").groupBy("chunk").cogroup(found.groupBy("chunk")).applyInPandas(score, "doc_id string, train boolean, n_tokens long, n_known long, base_score double, score double")
    return scored.select(
        F.col("doc_id").cast(id_type).alias("doc_id"), (~F.col("train")).alias("held_out"), "n_tokens", "n_known", F.lit(n).cast("long").alias("train_tokens"), "base_score", "score",
        F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")).alias("perplexity"),
    )


def held_out_perplexity(scores: DataFrame) -> DataFrame:
    """Perplexity per token of the held-out texts, by the model and by the base score."""
    per_token = lambda c: F.pow(F.lit(10.0), -F.sum(c) / F.sum("n_tokens"))
    return scores.filter("held_out").agg(per_token("score").alias("perplexity"), per_token("base_score").alias("base_perplexity"))
