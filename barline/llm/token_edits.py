"""Edit-aware token counts: pre-token segment trees per document.

``build_trees`` gives a table with a row per document: its text, its pre-tokens
(the leaves: length and token count) in blocks of about BLOCK, and a segment
tree of token sums over the blocks. ``apply_edits`` takes such a table and gives
the next one. An edit re-encodes only the pre-tokens it touches, two before them
(the splitter looks at most past the next run of white space) and those after it
up to the first old boundary that the new split meets again: from there on both
splits are the same. The fresh pre-tokens take the place of the old ones as
leaves of their own, the sums of their blocks go up the tree, and the root is the
new count. Everything is per row, so rows never shuffle.
"""

from __future__ import annotations

import base64
import bisect
import functools
from itertools import accumulate

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barline import ship
from barline.llm.common import full_text

CACHED_PIECES = 100_000
BLOCK = 128
#: Trees that a task holds at a time when only their counts are wanted.
PART_ROWS = 256
LEFT = 2
AHEAD = 48

# What the production query replaces (pattern, replacement).
REDACTIONS = (
    (r"[0-9a-f]{32,}", "[HEX]"),
    (r"AKIA[A-Z0-9]{12,}", "[KEY]"),
    (r"[A-Za-z0-9._+-]{1,64}@[A-Za-z0-9-]{1,63}(?:\.[A-Za-z0-9-]{1,63}){1,8}", "[EMAIL]"),
    (r"(?<![0-9.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![0-9.])", "[IP]"),
    (r"(?<![0-9])\+?[0-9][0-9 -]{8,18}[0-9](?![0-9])", "[NUMBER]"),
    (r"[#*$%&]{3,}", ""),
    (r"!{2,}", "!"),
)


def default_ranks() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


class Counter:
    """Splits texts into pre-tokens and counts their tokens, remembering words."""

    def __init__(self, ranks_path: str, pattern: str):
        import regex
        import tiktoken

        with open(ranks_path, "rb") as f:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
        self.encoding = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.split = regex.compile(pattern).findall
        self.cache: dict[str, int] = {}

    def counts(self, pieces: list[str]) -> list[int]:
        cache = self.cache
        if len(cache) > CACHED_PIECES:
            cache.clear()
        for p in set(pieces):
            if p not in cache:
                cache[p] = len(self.encoding.encode_ordinary(p))
        return [cache[p] for p in pieces]


@functools.lru_cache(maxsize=2)
def counter(ranks_path: str) -> Counter:
    import public_tokenizers

    return Counter(ranks_path, public_tokenizers.PATTERN)


class SegmentTree:
    """Token sums over blocks of pre-tokens; node k has the children 2k and 2k + 1, the root is node 1."""

    def __init__(self, lengths: np.ndarray, counts: np.ndarray, sizes: np.ndarray | None = None, nodes: np.ndarray | None = None):
        self.lengths, self.counts = lengths, counts
        if sizes is None or nodes is None:
            self._build()
        else:
            self.sizes, self.nodes = sizes, nodes

    def _build(self) -> None:
        n = len(self.counts)
        self.sizes = np.full(max(-(-n // BLOCK), 1), BLOCK, np.int32)
        self.sizes[-1] = n - BLOCK * (len(self.sizes) - 1)
        at = 1 << max(len(self.sizes) - 1, 0).bit_length()
        self.nodes = np.zeros(2 * at, np.int64)
        self.nodes[at : at + len(self.sizes)] = np.add.reduceat(self.counts, np.arange(0, n, BLOCK)) if n else 0
        while at > 1:
            self.nodes[at // 2 : at] = self.nodes[at : 2 * at : 2] + self.nodes[at + 1 : 2 * at : 2]
            at //= 2

    def replace(self, regions: list[tuple[int, int, list[int], list[int]]]) -> None:
        """Leaves first..stop-1 become the given lengths and counts; ``regions`` ascend and are disjoint."""
        ends = np.cumsum(self.sizes)
        lengths, counts, at = [], [], 0
        touched: set[int] = set()
        for first, stop, new_lengths, new_counts in regions:
            lengths += [self.lengths[at:first], np.array(new_lengths, np.int32)]
            counts += [self.counts[at:first], np.array(new_counts, np.int32)]
            at = stop
            b = min(int(np.searchsorted(ends, first, "right")), len(ends) - 1)
            last = max(b, min(int(np.searchsorted(ends, stop, "left")), len(ends) - 1)) if stop > first else b
            for k in range(b, last + 1):  # each block loses its share of the old leaves, the first one gets the new
                self.sizes[k] -= max(0, min(stop, int(ends[k])) - max(first, int(ends[k - 1]) if k else 0))
            self.sizes[b] += len(new_lengths)
            touched.update(range(b, last + 1))
        self.lengths, self.counts = np.concatenate([*lengths, self.lengths[at:]]), np.concatenate([*counts, self.counts[at:]])
        if self.sizes.max() > 4 * BLOCK:
            self._build()
            return
        ends = np.cumsum(self.sizes)
        leaf = len(self.nodes) // 2
        for k in touched:
            self.nodes[leaf + k] = self.counts[ends[k] - self.sizes[k] : ends[k]].sum()
        up = np.unique((leaf + np.fromiter(touched, np.int64, len(touched))) // 2)
        while len(up) and up[-1] > 0:
            self.nodes[up] = self.nodes[2 * up] + self.nodes[2 * up + 1]
            up = np.unique(up // 2)

    @property
    def total(self) -> int:
        return int(self.nodes[1]) if len(self.nodes) > 1 else 0


def recount(text: str, tree: SegmentTree, edits: list[tuple[int, int, str]], count: Counter) -> int:
    """Applies sorted, disjoint edits (start, end, new text) to the tree; returns the pre-tokens re-encoded."""
    starts = [0, *np.cumsum(tree.lengths).tolist()]  # the last one is the text's end
    n = len(tree.lengths)
    done = k = redone = 0
    regions = []
    while k < len(edits):
        begin = edits[k][0]
        first = max(bisect.bisect_right(starts, max(begin - 1, 0)) - 1 - LEFT, done, 0)
        first = min(first, max(n - 1, 0))
        new, at = "", starts[first]
        ahead = AHEAD
        while True:
            while k < len(edits) and edits[k][0] <= at + ahead:  # this edit, and those within sight
                a, b, r = edits[k]
                new += text[at:a] + r
                at = b
                k += 1
            stop = min(at + ahead, len(text))
            split = count.split(new + text[at:stop])
            where = list(accumulate(map(len, split), initial=0))
            usable = len(split) if stop == len(text) else len(split) - 1 - LEFT
            met = next((i for i in range(usable + 1) if where[i] >= len(new) and _is_start(starts, where[i] - len(new) + at)), None)
            if met is not None:
                break
            ahead *= 2
        done = bisect.bisect_left(starts, where[met] - len(new) + at)
        regions.append((first, done, [len(p) for p in split[:met]], count.counts(split[:met])))
        redone += met
    tree.replace(regions)
    return redone


def _is_start(starts: list[int], position: int) -> bool:
    i = bisect.bisect_left(starts, position)
    return i < len(starts) and starts[i] == position


@functools.lru_cache(maxsize=1)
def _redactions():
    import regex

    return [(regex.compile(p), r) for p, r in REDACTIONS]


def redactions(text: str) -> list[tuple[int, int, str]]:
    """The production edits of a text: matches of REDACTIONS, earlier patterns first, none overlapping."""
    found: list[tuple[int, int, str]] = []
    for pattern, new in _redactions():
        found.extend((m.start(), m.end(), new) for m in pattern.finditer(text))
    out: list[tuple[int, int, str]] = []
    for a, b, r in sorted(found, key=lambda e: (e[0], -e[1])):
        if not out or a >= out[-1][1]:
            out.append((a, b, r))
    return out


def edited(text: str, edits: list[tuple[int, int, str]]) -> str:
    parts, at = [], 0
    for a, b, r in edits:
        parts += [text[at:a], r]
        at = b
    return "".join([*parts, text[at:]])


TREES = "text string, lengths binary, counts binary, sizes binary, nodes binary"


def _tree(row) -> SegmentTree:
    read = lambda data, kind: np.frombuffer(data, kind).copy()
    return SegmentTree(read(row.lengths, np.int32), read(row.counts, np.int32), read(row.sizes, np.int32), read(row.nodes, np.int64))


def _cells(text: str, tree: SegmentTree) -> tuple:
    return text, tree.lengths.tobytes(), tree.counts.tobytes(), tree.sizes.tobytes(), tree.nodes.tobytes()


def _trees_of(batches, path: str):
    """Frames with ``text`` gain the rest of TREES, n_pretokens and n_tokens."""
    names = [f.split()[0] for f in TREES.split(", ")]
    count = counter(path)
    for batch in batches:
        out = []
        for text in batch["text"]:
            pieces = count.split(text)
            tree = SegmentTree(np.fromiter(map(len, pieces), np.int32, len(pieces)), np.array(count.counts(pieces), np.int32))
            out.append((*_cells(text, tree), len(pieces), tree.total))
        made = pd.DataFrame(out, columns=[*names, "n_pretokens", "n_tokens"], index=batch.index)
        yield pd.concat([batch.drop(columns="text"), made], axis=1)


def build_trees(docs: DataFrame, ranks: str | None = None, id_col: str = "doc_id", text_col: str = "text", edits_col: str | None = None) -> DataFrame:
    """One row per input row: doc_id, the tree (TREES), n_pretokens, n_tokens, and ``edits`` if a column holds them.

    Defined cases: a null or empty text has no pre-tokens and 0 tokens; repeated
    rows each get their tree; an empty table gives an empty result; further
    columns are ignored.
    """
    ship(docs.sparkSession)
    path = ranks or default_ranks()
    given = [_edits(F.col(edits_col)).alias("edits")] if edits_col else []
    rows = docs.select(F.col(id_col).alias("doc_id"), full_text(text_col).alias("text"), *given)
    kept = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema if f.name != "text")
    return rows.mapInPandas(lambda batches: _trees_of(batches, path), f"{kept}, {TREES}, n_pretokens long, n_tokens long")


def _edits(column):
    return F.transform(column, lambda e: F.struct(e["start"].cast("int").alias("a"), e["end"].cast("int").alias("b"), F.coalesce(e["replacement"], F.lit("")).alias("r")))


ADDED = ("n_edits", "n_reencoded", "n_tokens_after")


def _edited_trees(batches, path: str, edits_col: str | None):
    """Frames of trees after the edits in ``edits_col`` (structs a, b, r), or the production redactions, with ADDED."""
    count = counter(path)
    for batch in batches:
        cells = {n: batch[n].tolist() for n in ("text", "lengths", "counts", "sizes", "nodes")}
        after = [[] for _ in ADDED]
        given = batch[edits_col] if edits_col else [None] * len(batch)
        for i, (row, asked) in enumerate(zip(batch.itertuples(), given)):
            edits = redactions(row.text) if edits_col is None else sorted((e["a"], e["b"], e["r"]) for e in (asked if asked is not None else []))
            redone, total = 0, int(row.n_tokens)
            if edits:
                tree = _tree(row)
                redone = recount(row.text, tree, edits, count)
                total = tree.total
                for name, value in zip(cells, _cells(edited(row.text, edits), tree)):
                    cells[name][i] = value
            for values, value in zip(after, (len(edits), redone, total)):
                values.append(value)
        yield batch.assign(**cells, **dict(zip(ADDED, after)), n_pretokens=[len(x) // 4 for x in cells["lengths"]], n_tokens=after[2])


def apply_edits(trees: DataFrame, ranks: str | None = None, edits_col: str | None = None) -> DataFrame:
    """``trees`` after one batch of edits: its columns, with n_edits, n_reencoded and n_tokens_after.

    ``edits_col`` names an array<struct<start, end, replacement>> of disjoint edits
    in code points (sorted here; null edits are none); without it the production
    redactions apply. The result is a table of trees itself: another batch goes on it.
    """
    ship(trees.sparkSession)
    path = ranks or default_ranks()
    rows = trees.drop(*ADDED)
    if edits_col:
        rows = rows.withColumn("__edits", _edits(F.col(edits_col)))

    def run(batches):
        for out in _edited_trees(batches, path, "__edits" if edits_col else None):
            yield out.drop(columns=["__edits"], errors="ignore")

    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in trees.drop(*ADDED).schema)
    return rows.mapInPandas(run, f"{kept}, {', '.join(f'{n} long' for n in ADDED)}")


def edited_counts(docs: DataFrame, ranks: str | None = None, id_col: str = "doc_id", text_col: str = "text", edits_col: str | None = None) -> DataFrame:
    """One row per input row: doc_id, n_pretokens, n_tokens, n_edits, n_reencoded, n_tokens_after.

    The trees of ``docs`` before and after one batch of edits, in one pass that
    holds PART_ROWS trees at a time and gives their counts; see ``build_trees`` and
    ``apply_edits`` for the defined cases.
    """
    ship(docs.sparkSession)
    path = ranks or default_ranks()
    given = [_edits(F.col(edits_col)).alias("edits")] if edits_col else []
    rows = docs.select(F.col(id_col).alias("doc_id"), full_text(text_col).alias("text"), *given)
    shown = ["doc_id", "before_pretokens", "before_tokens", *ADDED]

    def run(batches):
        parts = (batch.iloc[i : i + PART_ROWS] for batch in batches for i in range(0, len(batch), PART_ROWS))
        trees = (t.assign(before_pretokens=t["n_pretokens"], before_tokens=t["n_tokens"]) for t in _trees_of(parts, path))
        for out in _edited_trees(trees, path, "edits" if edits_col else None):
            yield out[shown].set_axis(["doc_id", "n_pretokens", "n_tokens", *ADDED], axis=1)

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInPandas(run, f"doc_id {kind}, n_pretokens long, n_tokens long, {', '.join(f'{n} long' for n in ADDED)}")
