"""Toxicity: Levenshtein automata over a lexicon trie, with context windows.

The lexicon is learned from labelled rows: all words, and word stems with many
endings, whose excess in toxic documents chance does not explain, each with its
log-odds as weight. Its trie is intersected with a Levenshtein automaton (one
edit for terms of 5 letters, two for words from 9 on; a stem is matched as a
word's beginning) and made deterministic: a table of (state, character class)
that a task steps through for all words of many texts at once. Scripts without
spaces are matched at every character. Each hit is then judged by the words
around it: inside quotation marks or after a verb of reporting it is a
quotation, next to an address ("you") it is directed, else plain; misspelled
words count apart, and so do loose beginnings. A logistic model over the sums of weights gives the score.

Fit: on at most about ``sample_rows`` labelled rows of each class (the
documented bound; chosen by hash). Everything else reads all rows.
"""

from __future__ import annotations

import functools
import math
from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barline import ship
from barline.llm.common import full_text, let, materialize, words

SAMPLE_ROWS = 4000
STEMS = (3, 4, 5, 6, 7)
AUTOMATON_TERMS = 16
KNOWN_WORDS = 500_000
WINDOW = 5
# Words of reporting, words of address, quotation marks.
REPORTING = "said says say called calls wrote writes quoted quote word term sagte schrieb nannte dit disait dijo llama".split()
ADDRESS = "you your youre u ya du dich dir dein ihr tu toi te ton vous votre usted ustedes".split()
QUOTES = "\"“”„«»"
#: Scripts that put no spaces between words: ranges of code points.
DENSE = ((0x0E00, 0x0EFF), (0x3040, 0x30FF), (0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xF900, 0xFAFF), (0x20000, 0x3FFFF))
DENSE_RE = "[" + "".join(f"\\x{{{lo:X}}}-\\x{{{hi:X}}}" for lo, hi in DENSE) + "]"
HITS = ("plain", "directed", "quoted", "misspelled", "loose")
#: Prior means of the weights (bias, the sums of HITS, length) and their precision.
PRIOR = np.array([-4.0, 1.0, 1.3, 0.3, 0.5, 0.0, 0.0])
PRECISION = 0.3


def in_fold(col, fold: int):
    """crc32(id as text) mod 5 is ``fold``."""
    return F.crc32(F.col(col).cast("string").cast("binary")) % 5 == fold


# --- lexicon -----------------------------------------------------------------


def training_sample(docs: DataFrame, labels: DataFrame, sample_rows: int, id_col: str, text_col: str) -> DataFrame:
    """doc_id, text, toxic of at most about ``sample_rows`` rows of each class."""
    marks = labels.select(F.col("doc_id").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).filter("doc_id is not null and toxic is not null")
    marks = marks.filter(~in_fold("doc_id", 0)).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    counts = {r["toxic"]: r["count"] for r in marks.groupBy("toxic").count().collect()}
    rate = F.when(F.col("toxic") == 1, min(1.0, sample_rows / counts.get(1, 1))).otherwise(min(1.0, sample_rows / counts.get(0, 1)))
    chosen = marks.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < rate * (1 << 20))
    rows = docs.select(F.col(id_col).alias("doc_id"), full_text(text_col).alias("text")).filter("doc_id is not null")
    return with_groups(materialize(rows.join(F.broadcast(chosen), "doc_id")))


def with_groups(sample: DataFrame, shingle: int = 5, similarity: float = 0.8, bands: int = 12) -> DataFrame:
    """Adds ``grp``: rows of one class that are near copies share it, so that together they count once.

    Texts that share, in one of ``bands`` pairs of orders, the least hashes of
    their shingles are compared with the first of them: copies are those whose
    sets of shingles have that Jaccard similarity. No row goes. What the driver
    holds, the links, is bounded by the sample.
    """
    def shingles(ws):
        return F.transform(F.slice(ws, 1, F.greatest(F.size(ws) - (shingle - 1), F.lit(1))), lambda x, i: F.xxhash64(x, *[F.get(ws, i + k) for k in range(1, shingle)]))

    rows = sample.select("doc_id", "toxic", F.array_distinct(let(words(F.lower("text")), shingles)).alias("s")).filter(F.size("s") > 0)
    sets = materialize(rows.groupBy("doc_id", "toxic").agg(F.first("s").alias("s")))
    least = [F.array_min(F.transform("s", lambda x: F.xxhash64(x, F.lit(k)))) for k in range(2 * bands)]
    keys = F.array(*[F.xxhash64(F.lit(k), least[2 * k], least[2 * k + 1]) for k in range(bands)])
    keyed = materialize(sets.select("doc_id", "toxic", F.explode(keys).alias("key")))
    first = keyed.groupBy("key", "toxic").agg(F.min("doc_id").alias("low"))
    pairs = keyed.join(first, ["key", "toxic"]).filter("doc_id <> low").select("doc_id", "low", "toxic").distinct()
    pairs = pairs.join(sets, ["doc_id", "toxic"]).join(sets.select(F.col("doc_id").alias("low"), F.col("s").alias("t"), "toxic"), ["low", "toxic"])
    both = F.size(F.array_intersect("s", "t"))
    root: dict = {}

    def top(x):
        while x in root:
            x = root[x]
        return x

    for doc, low in pairs.filter(both / (F.size("s") + F.size("t") - both) >= similarity).select("doc_id", "low").collect():
        a, b = sorted((top(doc), top(low)))
        if a != b:
            root[b] = a
    named = sample.sparkSession.createDataFrame([(x, top(x)) for x in root], sample.select("doc_id", F.col("doc_id").alias("grp")).schema)
    return sample.join(F.broadcast(named), "doc_id", "left").withColumn("grp", F.coalesce("grp", "doc_id"))


def learn_lexicon(sample: DataFrame) -> dict[str, float]:
    """Terms, "word" or "stem*", and their log-odds; a group of near copies counts once."""
    found = F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(r"\p{L}+"), F.lit(0)))
    forms = F.filter(found, lambda w: (F.length(w) >= 2) & (F.length(w) <= 60) & ~w.rlike(DENSE_RE))
    dense = F.filter(found, lambda w: w.rlike(DENSE_RE))
    stem = lambda w, at, n: F.concat(F.substring(w, at, F.lit(n)), F.lit("*"))

    def stems_of(n: int):
        return F.transform(F.filter("forms", lambda w: F.length(w) >= n), lambda w: stem(w, F.lit(1), n))

    def grams_of(n: int):
        return F.flatten(F.transform("dense", lambda w: F.transform(F.sequence(F.lit(1), F.greatest(F.length(w) - n + 1, F.lit(1))), lambda i: stem(w, i, n))))

    stems, grams = [stems_of(n) for n in STEMS], [grams_of(n) for n in (2, 3)]
    terms = sample.select("grp", "toxic", forms.alias("forms"), dense.alias("dense"))
    terms = terms.select("grp", "toxic", F.explode(F.array_distinct(F.flatten(F.array("forms", *stems, *grams)))).alias("term"))
    marked = F.col("toxic") == 1
    terms = terms.distinct()
    stats = terms.groupBy("term").agg(F.count_if(marked).alias("b"), F.count_if(~marked).alias("g"), F.collect_set(F.when(marked, F.col("grp").cast("string"))).alias("docs"))
    totals = sample.select("grp", "toxic").distinct().agg(F.count_if(marked).alias("bad"), F.count_if(~marked).alias("good")).first()
    bad, good = totals["bad"], totals["good"]
    if not bad or not good:
        return {}
    stats = stats.filter("b >= 3").persist()
    tried = max(2, stats.count())
    xl = lambda a, e: F.when(a > 0, a * F.log(a / e)).otherwise(0.0)
    b, g, k = F.col("b"), F.col("g"), F.col("b") + F.col("g")
    n = float(bad + good)
    evidence = 2 * (xl(b, k * bad / n) + xl(g, k * good / n) + xl(bad - b, (n - k) * bad / n) + xl(good - g, (n - k) * good / n))
    rows = stats.filter((b * good > g * bad) & (evidence >= least_evidence(tried))).select("term", "b", "g", "docs").collect()  # bounded by the sample
    stats.unpersist()
    return choose([(r["term"], r["b"], r["g"], r["docs"]) for r in rows], bad, good, least_evidence(tried))


def least_evidence(tried: int) -> float:
    """The likelihood ratio statistic that less than one of ``tried`` terms reaches by chance."""
    return 2 * math.log(tried) + 4


def ratio_statistic(b: float, g: float, bad: int, good: int) -> float:
    n, k = bad + good, b + g
    xl = lambda a, e: a * math.log(a / e) if a > 0 else 0.0
    return 2 * (xl(b, k * bad / n) + xl(g, k * good / n) + xl(bad - b, (n - k) * bad / n) + xl(good - g, (n - k) * good / n)) if b * good > g * bad else 0.0


def implied(term: str, by: str) -> bool:
    return by.endswith("*") and term.startswith(by[:-1])


def choose(rows, bad: int, good: int, least: float) -> dict[str, float]:
    """The terms by falling evidence, without those that a chosen stem has already.

    A stem counts only where it has many endings, and beside chosen words of its
    own only for the documents that those do not reach.
    """
    single: dict[str, int] = {}  # a stem's commonest word
    for t, b, _, _ in rows:
        if not t.endswith("*"):
            for n in STEMS:
                single[t[:n] + "*"] = max(single.get(t[:n] + "*", 0), b)
    rows = [r for r in rows if not r[0].endswith("*") or single.get(r[0], 0) < 0.9 * r[1]]
    docs = {r[0]: set(r[3]) for r in rows}
    out: dict[str, float] = {}
    for t, b, g, _ in sorted(rows, key=lambda r: (-ratio_statistic(r[1], r[2], bad, good), not r[0].endswith("*"), -len(r[0]), r[0])):
        if any(implied(t, o) for o in out):
            continue
        left = len(docs[t].difference(*[docs[o] for o in out if implied(o, t)]))
        if ratio_statistic(left, g, bad, good) >= least:
            out[t] = math.log((b + 0.5) / (bad + 1) / ((g + 0.5) / (good + 1)))
    return out


# --- automaton ----------------------------------------------------------------


@functools.cache
def _letters() -> np.ndarray:
    """1 for every code point that can be part of a word."""
    return np.fromiter((chr(c).isalnum() for c in range(0x110000)), np.uint8, 0x110000)


class Automaton:
    """Deterministic product of the trie of some terms and the Levenshtein automaton.

    ``table[state, class]`` is the next state (0: dead). ``at_end`` has, per
    state, the term of a word that ends there, ``inside`` that of a stem just
    met: 0 for none, else 2 * (number of the term) + 1, or + 2 where misspelled.
    """

    def __init__(self, terms: list[tuple[int, str]], weights: np.ndarray, code: dict[str, int]):
        width = len(code) + 2
        children: list[dict[int, int]] = [{}]
        ends: dict[int, tuple[int, int, bool]] = {}  # node: term, edits allowed, stem
        reach = [0]  # most edits allowed below a node
        for number, t in terms:
            word = t.rstrip("*")
            edits = 0 if len(word) < 5 else 2 if len(word) >= 9 and word == t else 1
            node = 0
            for c in word:
                reach[node] = max(reach[node], edits)
                if code[c] not in children[node]:
                    children[node][code[c]] = len(children)
                    children.append({})
                    reach.append(0)
                node = children[node][code[c]]
            reach[node] = max(reach[node], edits)
            ends.setdefault(node, (number, edits, word != t))  # "ab" before "ab*"

        def closed(pairs: dict[int, int]) -> frozenset:
            """Adds the states that skip letters of the lexicon word."""
            todo = list(pairs)
            while todo:
                node = todo.pop()
                e = pairs[node] + 1
                for child in children[node].values():
                    if e <= reach[child] and e < pairs.get(child, 99):
                        pairs[child] = e
                        todo.append(child)
            return frozenset(pairs.items())

        def best(state, stem: bool) -> int:
            """The term with the fewest edits, then the greatest weight."""
            found = [(e, -weights[ends[node][0]], ends[node][0]) for node, e in state if node in ends and e <= ends[node][1] and (ends[node][2] or not stem)]
            return 0 if not found else 2 * min(found)[2] + (1 if min(found)[0] == 0 else 2)

        start = closed({0: 0})
        states: dict[frozenset, int] = {frozenset(): 0, start: 1}
        rows, order = [[0] * width], [start]
        for state in order:
            row = [0] * width
            for c in range(1, width):
                nxt: dict[int, int] = {}
                for node, e in state:
                    child = children[node].get(c)
                    if child is not None and e <= reach[child]:
                        nxt[child] = min(e, nxt.get(child, 99))
                    if e < reach[node]:
                        nxt[node] = min(e + 1, nxt.get(node, 99))
                        for other in children[node].values():
                            if e + 1 <= reach[other]:
                                nxt[other] = min(e + 1, nxt.get(other, 99))
                key = closed(nxt)
                if key not in states:
                    states[key] = len(states)
                    order.append(key)
                row[c] = states[key]
            rows.append(row)
        self.table = np.array(rows, np.int32)
        self.at_end = np.array([0, *[best(s, False) for s in order]], np.int32)
        self.inside = np.array([0, *[best(s, True) for s in order]], np.int32)

    def hits(self, text_codes: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """The hit of every word (see ``at_end``), all words at once: an exact one before a misspelled one."""
        state = np.ones(len(starts), np.int32)
        stem = np.zeros(len(starts), np.int32)
        live = np.arange(len(starts))
        for step in range(int(lengths.max(initial=0))):
            live = live[lengths[live] > step]
            if not len(live):
                break
            state[live] = self.table[state[live], text_codes[starts[live] + step]]
            met = self.inside[state[live]]
            better = (met > 0) & ((stem[live] == 0) | ((met % 2 == 1) & (stem[live] % 2 == 0)))
            stem[live[better]] = met[better]
            live = live[state[live] > 0]
        end = self.at_end[state]
        return np.where((end > 0) & ((end % 2 == 1) | (stem % 2 == 0)), end, stem)


class Matcher:
    """The whole lexicon: automata of AUTOMATON_TERMS neighbouring terms each, so their states add up and do not multiply."""

    def __init__(self, terms: dict[str, float]):
        self.terms = sorted(terms)
        self.weights = np.array([terms[t] for t in self.terms] or [0.0])
        self.stems = np.array([t.endswith("*") for t in self.terms] or [False])
        code = {c: i + 2 for i, c in enumerate(sorted({c for t in self.terms for c in t.rstrip("*")}))}
        self.classes = _letters().astype(np.uint16)  # 0: separator, 1: a letter outside the lexicon
        for c, i in code.items():
            self.classes[ord(c)] = i
        numbered = list(enumerate(self.terms))
        self.automata = [Automaton(numbered[i : i + AUTOMATON_TERMS], self.weights, code) for i in range(0, len(numbered), AUTOMATON_TERMS)]

        self.known: dict[str, int] = {}  # hits of words met before

    def word_hits(self, found: list[str]) -> np.ndarray:
        """The hits of words, each looked for in the automata once."""
        new = list({w for w in found if w not in self.known})
        if len(self.known) + len(new) > KNOWN_WORDS:
            self.known, new = {}, list(set(found))
        if new:
            lengths = np.fromiter(map(len, new), np.int64, len(new))
            codes = self.classes[np.frombuffer("".join(new).encode("utf-32-le", "surrogatepass"), np.uint32)]
            self.known.update(zip(new, self.hits(codes, np.cumsum(lengths) - lengths, lengths).tolist()))
        return np.fromiter(map(self.known.__getitem__, found), np.int32, len(found))

    def hits(self, text_codes: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """The hit of every word (see Automaton): an exact one before a misspelled one, then the heavier."""
        out = np.zeros(len(starts), np.int32)
        for automaton in self.automata:
            new = automaton.hits(text_codes, starts, lengths)
            at = np.flatnonzero(new)
            old = out[at]
            rank = lambda h: np.where(h > 0, 1000.0 * (h % 2) + self.weights[np.maximum(h - 1, 0) // 2], -np.inf)
            better = rank(new[at]) > rank(old)
            out[at[better]] = new[at[better]]
        return out


def features(texts: list[str], matcher: Matcher) -> np.ndarray:
    """(texts, 2 * kinds): sums of the weights of the hits of each kind of HITS, then their numbers."""
    out = np.zeros((len(texts), 2 * len(HITS)))
    lowered = [t.lower() for t in texts]
    buffer = "\n".join(lowered)
    points = np.frombuffer(buffer.encode("utf-32-le", "surrogatepass"), np.uint32)
    codes = matcher.classes[points]
    dense = np.zeros(len(points), bool)
    for lo, hi in DENSE:
        dense |= (points >= lo) & (points <= hi)
    edges = np.flatnonzero(np.diff((codes > 0).astype(np.int8), prepend=0, append=0))
    starts, stops = edges[::2], edges[1::2]
    if dense.any():  # a word begins at each such character too
        inner = np.setdiff1d(np.flatnonzero(dense & (codes > 0)), starts)
        run = np.searchsorted(starts, inner, "right") - 1
        starts, stops = np.concatenate([starts, inner]), np.concatenate([stops, stops[run]])
        order = np.argsort(starts, kind="stable")
        starts, stops = starts[order], stops[order]
    hit = np.zeros(len(starts), np.int32)
    inside = dense[starts] if len(starts) else np.zeros(0, bool)  # these overlap
    hit[inside] = matcher.hits(codes, starts[inside], (stops - starts)[inside])
    hit[~inside] = matcher.word_hits([buffer[a:b] for a, b in zip(starts[~inside].tolist(), stops[~inside].tolist())])
    found = np.flatnonzero(hit)
    if not len(found):
        return out
    text_ends = np.cumsum([len(t) + 1 for t in lowered])
    owner = np.searchsorted(text_ends, starts[found], "right")
    marks = np.flatnonzero(np.isin(points, np.frombuffer(QUOTES.encode("utf-32-le"), np.uint32)))
    for k, doc in zip(found, owner):
        begin = text_ends[doc] - len(lowered[doc]) - 1
        lo, hi = max(k - WINDOW, 0), min(k + WINDOW + 1, len(starts))
        around = [buffer[starts[i] : stops[i]] for i in range(lo, hi) if i != k and begin <= starts[i] < text_ends[doc]]
        before = [buffer[starts[i] : stops[i]] for i in range(lo, k) if starts[i] >= begin]
        line = buffer.rfind("\n", begin, starts[k]) + 1
        opened = np.searchsorted(marks, starts[k]) - np.searchsorted(marks, max(begin, line))
        closes = np.searchsorted(marks, starts[k]) < np.searchsorted(marks, text_ends[doc])
        if (opened % 2 and closes) or any(w in REPORTING for w in before):
            kind = 2
        elif hit[k] % 2 == 0:
            kind = 4 if matcher.stems[(hit[k] - 1) // 2] else 3
        else:
            kind = 1 if any(w in ADDRESS for w in around) else 0
        out[doc, kind] += matcher.weights[(hit[k] - 1) // 2]
        out[doc, len(HITS) + kind] += 1
    return out


# --- model --------------------------------------------------------------------


def fit(x: np.ndarray, toxic: np.ndarray, share: np.ndarray) -> np.ndarray:
    """Weights of a logistic model over (bias, sums, length); rows of the bounded sample, each counted by its share. No hit speaks for a text."""
    w = PRIOR.copy()
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (share * (toxic - p)) - PRECISION * (w - PRIOR)
        hess = (x * (share * p * (1 - p))[:, None]).T @ x + PRECISION * np.eye(len(w))
        step = np.linalg.solve(hess, grad)
        new = w + step / max(1.0, np.abs(step).max())
        new[1:-1] = np.maximum(new[1:-1], 0.0)
        if np.abs(new - w).max() < 1e-9:
            break
        w = new
    return w


def add_hits(docs: DataFrame, terms: dict[str, float]) -> DataFrame:
    """Adds ``hits`` (sums s_ and numbers n_ of HITS, and the text's length) to rows with a text."""
    ship(docs.sparkSession)
    matcher = docs.sparkSession.sparkContext.broadcast(Matcher(terms))
    names = [*[f"s_{h}" for h in HITS], *[f"n_{h}" for h in HITS]]

    @F.pandas_udf(", ".join(f"{n} double" for n in [*names, "size"]))
    def counts(text: pd.Series) -> pd.DataFrame:
        texts = text.tolist()
        parts = [features(texts[i : i + 200], matcher.value) for i in range(0, len(texts), 200)]
        out = pd.DataFrame(np.concatenate(parts) if parts else np.zeros((0, len(names))), columns=names)
        return out.assign(size=np.log1p(np.fromiter(map(len, texts), float, len(texts)) / 1000))

    return docs.withColumn("hits", counts("text"))


def train(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS, id_col: str = "doc_id", text_col: str = "text") -> tuple[dict[str, float], np.ndarray]:
    sample = training_sample(docs, labels, sample_rows, id_col, text_col)
    terms = learn_lexicon(sample)
    names = [*[f"s_{h}" for h in HITS], "size"]
    rows = add_hits(sample, terms).select("toxic", "grp", *[f"hits.{n}" for n in names]).collect()  # at most about twice sample_rows
    x = np.array([[1.0, *[r[n] for n in names]] for r in rows]).reshape(-1, len(names) + 1)
    copies = Counter((r["grp"], r["toxic"]) for r in rows)
    return terms, fit(x, np.array([r["toxic"] for r in rows], float), np.array([1 / copies[r["grp"], r["toxic"]] for r in rows]))


def toxicity(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, held_out, score, predicted and the numbers of hits.

    Defined cases: a null or empty text has no hits and the score of such texts;
    without labelled rows of both classes the lexicon is empty; a label row with
    a null, and labels of unknown documents, are not used, and of several labels
    of a document the highest counts; a null id is not held out; repeated rows
    each get their result; an empty table gives an empty result; further columns
    are ignored.
    """
    scored = score_rows(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), labels, sample_rows)
    return scored.select(
        "doc_id",
        F.coalesce(in_fold("doc_id", 0), F.lit(False)).alias("held_out"),
        "score",
        F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"),
        *[F.col(f"hits.n_{h}").cast("int").alias(f"n_{h}") for h in HITS],
    )


def score_rows(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """doc_id, row (all columns of docs), hits, score; docs has doc_id and text."""
    terms, w = train(docs, labels, sample_rows)
    rows = docs.select(F.col("doc_id"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), full_text("text").alias("text"))
    rows = add_hits(rows, terms).drop("text")
    z = F.lit(float(w[0]))
    for weight, name in zip(w[1:], [*[f"s_{h}" for h in HITS], "size"]):
        z = z + float(weight) * F.col(f"hits.{name}")
    return rows.withColumn("score", 1.0 / (1.0 + F.exp(-z)))


def clean_documents(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """``docs`` (with doc_id and text) without the rows whose score reaches the threshold."""
    return score_rows(docs, labels, sample_rows).filter(F.col("score") < threshold).select(*[F.col("row")[c].alias(c) for c in docs.columns])
