"""Whitening, decontamination and phrases: edge rows and brute force."""

import hashlib
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from barline.llm import decontamination, phrases, whitening

# --- whitening -------------------------------------------------------------------


def test_rank_one_updates():
    rng = np.random.default_rng(0)
    for trial in range(300):
        d = int(rng.integers(1, 30))
        values = np.sort(np.abs(rng.normal(size=d)) * 10.0 ** rng.integers(-6, 6, d)) if trial % 3 else np.sort(rng.integers(0, 3, d).astype(float))
        vectors = np.linalg.qr(rng.normal(size=(d, d)))[0]
        x = vectors[:, 0] * 2.0 if trial % 5 == 0 else rng.normal(size=d) * (rng.random(d) < 0.7)
        rho = float(rng.random() * 3)
        want = vectors * values @ vectors.T + rho * np.outer(x, x)
        got, turned = whitening.rank_one(values, vectors, rho, x)
        scale = max(np.abs(want).max(), 1e-300)
        assert np.abs(got - np.linalg.eigvalsh(want)).max() <= 1e-12 * scale
        assert np.abs(turned.T @ turned - np.eye(d)).max() < 1e-12 and np.abs(turned * got @ turned.T - want).max() <= 1e-12 * scale


def test_spectra_combine():
    rng = np.random.default_rng(1)
    rows = np.floor(64 * rng.normal(size=(90, 7)) @ rng.normal(size=(7, 7)))
    parts = [whitening.Spectrum(7) for _ in range(4)]  # the last one stays empty
    for k, row in enumerate(rows):
        parts[k % 3].add(row)
    for other in parts[1:]:
        parts[0].combine(whitening.Spectrum.load(other.dump(), 7))
    want = np.linalg.eigvalsh(np.cov(rows.T, bias=True) * len(rows))
    assert parts[0].n == 90 and np.allclose(parts[0].mean, rows.mean(axis=0)) and np.allclose(parts[0].values, want, rtol=1e-11)


def whitened_by_hand(vectors, k=16):
    x = np.array(sorted({tuple(int(np.floor(64 * float(c))) + 1000000 for c in v) for v in vectors}), float)
    y = x - x.mean(axis=0)
    values, turn = np.linalg.eigh(y.T @ y / len(x))
    return x.mean(axis=0), len(x), values[::-1][:k], turn[:, ::-1][:, :k], values.sum()


def test_whitening(spark):
    rng = np.random.default_rng(2)
    vectors = (rng.normal(size=(200, 20)) @ rng.normal(size=(20, 20)) / 4).astype(np.float32)
    rows = [(i, v.tolist(), 9) for i, v in enumerate(vectors)] + [(1000 + i, vectors[0].tolist(), 9) for i in range(60)]  # a group of copies
    bad = [(2000, None, 9), (2001, [], 9), (2002, [float("nan")] * 20, 9), (2003, [None] * 20, 9), (2004, [float("inf")] * 20, 9)]
    table = spark.createDataFrame([*rows, *bad, (None, vectors[1].tolist(), 9)], "vec_id long, embedding array<float>, n long").repartition(7)
    got = whitening.whiten(table).collect()
    mean, n, values, turn, trace = whitened_by_hand(vectors)
    assert len(got) == 261 * 16 and {r["n"] for r in got} == {n} == {200}
    sums = [int(s) for s in np.array(sorted({tuple(int(np.floor(64 * float(c))) + 1000000 for c in v) for v in vectors})).sum(axis=0)]
    for r in got:
        v = vectors[1 if r["vec_id"] is None else 0 if r["vec_id"] >= 1000 else r["vec_id"]]
        x = [int(np.floor(64 * float(c))) + 1000000 for c in v]
        k = r["component"] - 1
        assert r["deviation"] == sum((n * a - s) ** 2 for a, s in zip(x, sums))
        assert abs(abs(r["whitened"]) - abs((np.array(x) - mean) @ turn[:, k] / np.sqrt(values[k]))) < 1e-8
        assert abs(r["explained"] - values[k] / trace) < 1e-9 and r["identity_error"] < 1e-9
    signs = {(r["vec_id"], r["component"]): r["whitened"] for r in got}
    assert all(abs(signs[1000, k] - signs[0, k]) < 1e-12 for k in range(1, 17))


def test_whitening_edges(spark):
    schema = "vec_id long, embedding array<float>, component int"
    assert whitening.whiten(spark.createDataFrame([], schema)).count() == 0
    assert whitening.whiten(spark.createDataFrame([(1, None, 1)], schema)).columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    one = whitening.whiten(spark.createDataFrame([(1, [0.5, 1.0], 1), (2, [0.5, 1.0], 1)], schema)).collect()
    assert len(one) == 4 and all(r["n"] == 1 and r["deviation"] == 0 and r["whitened"] is None and r["explained"] is None for r in one)
    mixed = whitening.whiten(spark.createDataFrame([(1, [0.0, 1.0], 1), (2, [1.0, 1.0], 1), (3, [5.0], 1), (4, [7.0], 1)], schema)).collect()
    assert sorted((r["vec_id"], r["component"]) for r in mixed) == [(1, 1), (1, 2), (2, 1), (2, 2), (3, 1), (4, 1)]
    assert all((r["whitened"] is None) == (r["component"] == 2) and (r["component"] == 2 or abs(abs(r["whitened"]) - 1) < 1e-12) for r in mixed)
    huge = whitening.deviations(np.array([[2**45, 0]]), 10**8, np.array([5, 7], object))
    assert huge.tolist() == [[10**8 * 2**45 - 5, -7]]


# --- decontamination ----------------------------------------------------------------


def leak_words(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate({c: c + 32 for c in range(65, 91)}))


def leaks_by_hand(text, items):
    w = leak_words(text)
    covered, met = set(), set()
    for i, t in items:
        b = leak_words(t)
        k = min(10, len(b))
        windows = {tuple(b[j : j + k]) for j in range(len(b) - k + 1)} if b else set()
        for j in range(len(w) - k + 1 if k else 0):
            if tuple(w[j : j + k]) in windows:
                covered |= set(range(j, j + k))
                if i is not None:
                    met.add(str(i))
    return len(w), len(covered), len(met), hashlib.sha256(",".join(sorted(met)).encode()).hexdigest(), bool(covered)


def test_fm_index():
    rng = np.random.default_rng(3)
    for trial in range(60):
        symbols = int(rng.integers(2, 9))
        text = np.append(rng.integers(0, symbols, int(rng.integers(1, 120))), 0)
        text = np.tile(text, 3) if trial % 3 == 0 else text
        rest = [tuple((0, j) if text[j] == 0 else (1, int(text[j])) for j in range(i, len(text))) for i in range(len(text))]
        assert decontamination.suffix_order(text, 4).tolist() == sorted(range(len(text)), key=lambda i: rest[i])
        index = decontamination.FMIndex(text, 4, 5)
        patterns = [rng.integers(1, max(symbols, 2), int(rng.integers(1, 6))) for _ in range(20)]
        lo, hi = index.count(np.array([np.pad(p, (0, 5 - len(p))) for p in patterns]), np.array([len(p) for p in patterns]))
        for p, a, b in zip(patterns, lo, hi):
            assert sorted(index.locate(np.arange(a, b)).tolist()) == [i for i in range(len(text) - len(p) + 1) if (text[i : i + len(p)] == p).all()]


@pytest.mark.parametrize("options", [{}, {"shard_words": 40}, {"block_words": 3}])
def test_leaks(spark, options):
    rng = np.random.default_rng(4)
    pool = [f"w{k}" for k in range(12)] + ["É", "日本"]
    item = lambda n: " ".join(rng.choice(pool, n))
    items = [(k, item(int(rng.integers(0, 16)))) for k in range(9)] + [(3, item(11)), (None, item(10)), (20, None), (21, "Lone"), (22, "...")]
    texts = [item(int(rng.integers(0, 60))) + ". " + (items[k % len(items)][1] or "").upper().replace("É", "É") + "!" + item(5) for k in range(40)]
    rows = [(k, t, "x", [1]) for k, t in enumerate([*texts, None, "", " .. ", "LONE wolf", texts[0], items[0][1] + "-x " + items[9][1]])] + [(None, texts[1], "x", [1])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, items string, spans array<int>").repartition(3)
    bench = spark.createDataFrame([(i, t, 0) for i, t in items], "item_id long, text string, n_words int")
    got = decontamination.decontaminate(docs, bench, **options).collect()
    assert Counter(tuple(r) for r in got) == Counter((i, *leaks_by_hand(t, items)) for i, t, _, _ in rows)
    assert sum(r["n_hit"] for r in got) > 100
    spans = decontamination.leaks(docs, bench, **options).filter("doc_id = 5").first()["spans"]
    assert all(a["end"] < b["start"] for a, b in zip(spans, spans[1:]))


def test_leaks_of_empty_tables(spark):
    docs, bench = spark.createDataFrame([(1, "a b")], "doc_id long, text string"), spark.createDataFrame([(1, "b")], "item_id long, text string")
    assert decontamination.decontaminate(docs.filter("false"), bench).count() == 0
    assert [r["n_hit"] for r in decontamination.decontaminate(docs, bench.filter("false")).collect()] == [0]
    long = spark.createDataFrame([(1, "b " * 200_000 + "a")], "doc_id long, text string")
    assert decontamination.decontaminate(long, bench).first()["n_hit"] == 200_000


# --- phrases ------------------------------------------------------------------------


def phrases_by_hand(rows, least, top, share):
    f, n = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate({c: c + 32 for c in range(65, 91)})):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            f.update((lang, *w[i : i + k]) for k in range(1, 5) for i in range(len(w) - k + 1))
    known = {p: a for p, a in f.items() if len(p) > 2 and a >= least}
    out = []
    for (lang, *w), a in known.items():
        score, k, left, right = min((2000000 * a // (f[lang, *w[:k]] + f[lang, *w[k:]]), k, f[lang, *w[:k]], f[lang, *w[k:]]) for k in range(1, len(w)))
        longer = [b for (other, *v), b in known.items() if other == lang and len(v) > len(w) and any(v[i : i + len(w)] == w for i in range(len(v)))]
        if not any(100 * b >= share * a for b in longer):
            out.append((lang, -score, -a, " ".join(w).encode(), left, right))
    ranked, seen = [], Counter()
    for lang, score, a, phrase, left, right in sorted(out):
        seen[lang] += 1
        if seen[lang] <= top:
            ranked.append((lang, seen[lang], phrase.decode(), -a, left, right, n[lang], -score))
    return ranked


@pytest.mark.parametrize("options", [{}, {"shard_bytes": 300}, {"shard_bytes": 200, "merge_entries": 8, "level_bits": 2}])
def test_phrases(spark, options):
    rng = np.random.default_rng(5)
    words = ["the", "of", "New", "york", "é", "日本", "a-b", "\x0b", "x\ty", "end.", "stop,", "x\x00", " "]
    texts = [" ".join(rng.choice(words, int(rng.integers(0, 40)))) for _ in range(120)]
    rows = [(k, t, None if k % 7 == 0 else ("en", "de")[k % 2], k) for k, t in enumerate([*texts, None, "", "new york " * 300, "\t \n"])]
    rows += [rows[3]] * 20
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, n long").repartition(3)
    got = phrases.collocations(docs, least=4, top=60, **options).collect()
    want = phrases_by_hand([(r[2], r[1]) for r in rows], 4, 60, 80)
    assert sorted(map(tuple, got)) == sorted(want) and len(want) > 100
    assert phrases.collocations(docs.filter("false")).count() == 0 and phrases.collocations(docs.limit(3)).count() == 0


def test_filters_lose_nothing():
    rng = np.random.default_rng(6)
    for bits in (1, 2, 5, 9, 13, 17, 20, 25, 31):
        for n in (2, 3, 4):
            for quotient, dealt in ((0, 0), (9, 1), (20, min(bits, 4))):
                layout = phrases.Layout(n, bits, max(quotient, dealt))
                ids = [np.minimum(rng.zipf(1.3, int(rng.integers(0, 2000))) , (1 << bits) - 1).astype(np.int64)] * n
                ids = [rng.permutation(i) for i in ids]
                grams = layout.counted(*layout.pack(ids))
                parts = [layout.decode(layout.encode(*[g[at] for g in grams], bucket, dealt), bucket, dealt) for bucket, at in layout.buckets(grams[0], dealt)]
                if parts:
                    left, right, counts = layout.counted(*[np.concatenate(x) for x in zip(*parts, *parts)])
                    got = {tuple(k): c for k, c in zip(layout.unpack(left, right).tolist(), counts.tolist())}
                    assert got == {k: 2 * c for k, c in Counter(zip(*[i.tolist() for i in ids])).items()}


# --- shards of the mix ----------------------------------------------------------------


def test_shards_of_the_mix(spark):
    from barline.llm import mixing

    sizes = [(s, int(n)) for s, n in (("a", 9000), ("b", 4000), ("c", 700))]
    rows = [(f"{s}{i}", " ".join(f"{s}{i}w{j}" for j in range(n // 50)), s) for s, n in sizes for i in range(50)]
    docs = spark.createDataFrame(rows, "doc_id string, text string, source string")
    options = {"block_words": 4, "shard_slots": 100}
    got = {r["doc_id"]: r for r in mixing.mix(docs, **options).collect()}
    pieces = mixing.mixed_documents(docs, by_shard=True, **options).collect()
    taken, shards = Counter(), {}
    for r in pieces:  # every piece holds the document's own words, in order
        w = r["text"].split(" ")
        assert set(w) <= set(next(t for i, t, _ in rows if i == r["doc_id"]).split(" ")) if r["doc_id"] in ("a1", "b2", "c3") else True
        taken[r["doc_id"]] += len(w)
        shards.setdefault(r["doc_id"], set()).add(r["shard"])
    assert {i: r["taken"] for i, r in got.items() if r["taken"]} == dict(taken)
    assert {i: r["shards"] for i, r in got.items() if r["shards"]} == {i: sorted(s) for i, s in shards.items()}
    words = Counter(w for r in pieces for w in r["text"].split(" "))
    assert max(words.values()) <= 3 and abs(sum(taken.values()) - sum(n for _, n in sizes)) <= 12
    drawn = Counter()  # words a shard has of each source
    for r in pieces:
        drawn[r["shard"], r["source"]] += len(r["text"].split(" "))
    assert {s for s, _ in drawn} == set(range(34)) and all(abs(sum(drawn[s, x] for x in "abc") - 400) <= 24 for s in range(33))


def test_shard_counts_are_a_multinomial_draw(spark):
    """Counts of 60 shards: given the quotas, their mean and variance are those of a hypergeometric draw."""
    from barline.llm import mixing

    slots = {1: 30_000, 2: 24_000, 3: 6_000}
    targets = spark.createDataFrame([(1, 10_000, 30_000, 0), (2, 20_000, 24_000, 30_000), (3, 7_000, 6_000, 54_000)], "src int, blocks long, slots long, base long")
    drawn = mixing.slots(targets, 60_000, 1000, 7, 4096).cache()
    counts = {(r["shard"], r["src"]): r["n"] for r in mixing.shard_counts(drawn).collect()}
    for src, quota in slots.items():
        mine = np.array([counts.get((s, src), 0) for s in range(60)])
        p = quota / 60_000
        variance = 1000 * p * (1 - p) * (60_000 - 1000) / (60_000 - 1)
        assert mine.sum() == quota and abs(mine.mean() - 1000 * p) < 1e-9 and 0.5 < mine.var() / variance < 1.7
    turns = drawn.groupBy("src", "turn").agg(F.count("*").alias("n"), F.count_distinct("block").alias("d")).collect()
    assert sorted((r["src"], r["turn"], r["n"]) for r in turns) == [(1, 0, 10_000), (1, 1, 10_000), (1, 2, 10_000), (2, 0, 20_000), (2, 1, 4_000), (3, 0, 6_000)] and all(r["n"] == r["d"] for r in turns)
    places = drawn.groupBy("shard").count().collect()
    assert len(places) == 60 and all(r["count"] == 1000 for r in places)
