"""Embedding whitening by incremental eigendecomposition.

Every task keeps the mean and the spectrum (eigenvalues and eigenvectors of the
scatter matrix) of the vectors it has met. A vector is a centred rank-one
update: the secular equation gives the new eigenvalues, between the old ones;
components that the vector does not touch, and all but one of equal
eigenvalues, are deflated. Spectra of tasks are combined in a tree, one by one
eigenpair and the difference of the means, again by rank-one updates. At last
all tasks project the exactly centred vectors on that basis (Rayleigh-Ritz); the
small matrix they sum up to turns the basis into eigenvectors to double
precision. What travels is a spectrum per task, and the sums of d x d numbers.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barline import ship
from barline.llm.common import materialize

COMPONENTS = 16
# Entries become floor(64 * c) + 1000000.
SCALE, OFFSET = 64, 1_000_000
FAN = 16
EPS = np.finfo(float).eps

# --- rank-one updates --------------------------------------------------------------


def secular_roots(d: np.ndarray, z2: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The roots of 1 + sum(z2 / (d - x)) for rising d and z2 > 0: (index of the nearest pole, distance from it).

    Each root lies above its pole and below the next one. All are found at once:
    the two neighbouring poles are kept exactly, the rest is taken as constant,
    inside a bracket that shrinks (halved where that step leaves it).
    """
    k = len(d)
    upper = np.append(d[1:], d[-1] + z2.sum())
    gap = upper - d
    columns = np.arange(k)
    at_mid = 1 + (z2[:, None] / (d[:, None] - (d + gap / 2)[None, :])).sum(axis=0)
    right = (at_mid < 0) & (columns < k - 1)  # nearer to the pole above
    pole = columns + right
    delta = d[:, None] - d[pole][None, :]
    lo = np.where(right, -gap / 2, 0.0)
    hi = np.where(right, 0.0, np.where(columns < k - 1, gap / 2, gap))
    lo[-1] = gap[-1] / 2 if at_mid[-1] < 0 else 0.0
    hi[-1] = gap[-1] if at_mid[-1] < 0 else gap[-1] / 2
    t = (lo + hi) / 2
    a, b = np.maximum(columns - (columns == k - 1), 0), np.where(columns < k - 1, columns + 1, columns)
    below = columns[:, None] <= a[None, :]
    for _ in range(60):
        inverse = 1 / (delta - t[None, :])
        terms = z2[:, None] * inverse
        f = 1 + terms.sum(axis=0)
        done = np.abs(f) <= 8 * EPS * k * (1 + np.abs(terms).sum(axis=0))
        width = hi - lo
        done |= width <= 2 * EPS * np.abs(t)
        if done.all():
            break
        slope = terms * inverse
        lo, hi = np.where(f < 0, t, lo), np.where(f < 0, hi, t)
        da, db = delta[a, columns] - t, delta[b, columns] - t
        low, every = (slope * below).sum(axis=0), slope.sum(axis=0)
        c = f - da * low - db * (every - low)
        p, q = (da + db) * f - da * db * every, da * db * f
        root = np.sqrt(np.maximum(p * p - 4 * q * c, 0.0))
        with np.errstate(divide="ignore", invalid="ignore"):
            step = np.where(p <= 0, (p - root) / (2 * c), 2 * q / (p + root))
            if k > 1:  # the last root lies above both its poles: the other zero of the same form
                step[-1] = (p[-1] + root[-1]) / (2 * c[-1]) if p[-1] >= 0 else 2 * q[-1] / (p[-1] - root[-1])
        new = t + step
        new = np.where(np.isfinite(new) & (new > lo) & (new < hi), new, (lo + hi) / 2)
        t = np.where(done, t, new)
    return pole, t


def rank_one(values: np.ndarray, vectors: np.ndarray, rho: float, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The spectrum (rising values; vectors in columns) of V diag(values) V' + rho x x', rho >= 0."""
    z = vectors.T @ x * np.sqrt(rho)
    norm2 = float(z @ z)
    tiny = 8 * EPS * max(float(np.abs(values).max(initial=0.0)), norm2)
    if norm2 <= tiny * EPS or not len(values):
        return values, vectors
    values, vectors = values.copy(), vectors.copy()
    edges = np.flatnonzero(np.diff(values) > tiny) + 1
    for group in np.split(np.arange(len(values)), edges):  # equal values: a reflection leaves one of them touched
        if len(group) > 1:
            part = z[group]
            size = np.linalg.norm(part)
            if size > 0:
                h = part.copy()
                h[-1] += np.copysign(size, part[-1])
                h /= np.linalg.norm(h)
                vectors[:, group] -= 2 * np.outer(vectors[:, group] @ h, h)
                z[group] = 0.0
                z[group[-1]] = -np.copysign(size, part[-1])
    touched = np.flatnonzero(z * z > tiny * EPS)
    touched = touched[np.abs(z[touched]) * np.sqrt(norm2) > tiny]
    if not len(touched):
        return values, vectors
    d, w = values[touched], z[touched]
    pole, t = secular_roots(d, w * w)
    away = (d[:, None] - d[pole][None, :]) - t[None, :]  # pole i minus root j
    # The vector for which the roots found are exact: its eigenvectors are orthogonal whatever the roots' error.
    other = d[None, :] - d[:, None]
    np.fill_diagonal(other, 1.0)
    ratio = -away / np.where(np.eye(len(d), dtype=bool), 1.0, other.T * -1)
    fitted = np.sqrt(np.maximum(np.abs(np.prod(ratio, axis=1)), 0.0)) * np.sign(w)
    turn = fitted[:, None] / away
    turn /= np.linalg.norm(turn, axis=0)
    vectors[:, touched] = vectors[:, touched] @ turn
    values[touched] = d[pole] + t
    order = np.argsort(values, kind="stable")
    return values[order], vectors[:, order]


class Spectrum:
    """Number, mean and scatter spectrum of the vectors met so far."""

    def __init__(self, d: int):
        self.n, self.mean, self.values, self.vectors = 0, np.zeros(d), np.zeros(d), np.eye(d)

    def add(self, x: np.ndarray) -> None:
        away = x - self.mean
        self.values, self.vectors = rank_one(self.values, self.vectors, self.n / (self.n + 1), away)
        self.n += 1
        self.mean = self.mean + away / self.n

    def combine(self, other: Spectrum) -> None:
        for value, vector in zip(other.values, other.vectors.T):
            if value > 0:
                self.values, self.vectors = rank_one(self.values, self.vectors, float(value), vector)
        n = self.n + other.n
        if n:
            away = other.mean - self.mean
            self.values, self.vectors = rank_one(self.values, self.vectors, self.n * other.n / n, away)
            self.mean = self.mean + away * (other.n / n)
        self.n = n

    def dump(self) -> bytes:
        return np.concatenate([[self.n], self.mean, self.values, self.vectors.ravel()]).astype("<f8").tobytes()

    @classmethod
    def load(cls, blob: bytes, d: int) -> Spectrum:
        x = np.frombuffer(blob, "<f8")
        out = cls(d)
        out.n, out.mean, out.values, out.vectors = int(x[0]), x[1 : d + 1], x[d + 1 : 2 * d + 1], x[2 * d + 1 :].reshape(d, d)
        return out


# --- tables -------------------------------------------------------------------------


def per_task(rows: DataFrame, start: Callable, add: Callable, dump: Callable[..., list[bytes]], size: int) -> DataFrame:
    """(at, state): what a task has gathered from the vectors ``x`` of its rows; ``size`` states a task."""
    ship(rows.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        state, met = start(), False
        for pdf in batches:
            if len(pdf):
                met = True
                state = add(state, np.stack(pdf["x"].to_numpy()))
        if met:
            yield pd.DataFrame({"at": [TaskContext.get().partitionId()], "state": dump(state)})

    return rows.select("x").mapInPandas(run, "at long, state binary")


def tree(states: DataFrame, combine: Callable[[list[bytes]], bytes], fan: int = FAN) -> bytes | None:
    """All states combined, ``fan`` at a time, in as many rounds as that needs."""
    states = materialize(states)
    left = states.count()
    while left > 1:
        groups = -(-left // fan)

        def merge(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
            return pd.DataFrame({"at": [key[0]], "state": [combine(pdf.sort_values("at")["state"].tolist())]})

        dealt = states.select(F.pmod("at", F.lit(groups)).alias("g"), "at", "state")
        states = materialize(dealt.groupBy("g").applyInPandas(merge, "at long, state binary"))
        left = states.count()
    row = states.first()
    return None if row is None else bytes(row["state"])


def fit_list(vectors: DataFrame) -> DataFrame:
    """Each distinct ``x`` once, written."""
    return materialize(vectors.select("x").distinct())


def exact_x(vector: Column) -> Column:
    """floor(64 * c) + 1000000 of every entry; null unless all entries are numbers that have such a long."""
    entries = F.transform(vector, lambda c: c.cast("double"))
    fine = F.forall(entries, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < 2.0**46))
    return F.when(vector.isNotNull() & (F.size(vector) > 0) & F.coalesce(fine, F.lit(False)), F.transform(entries, lambda c: F.floor(c * SCALE).cast("long") + OFFSET))


def fit(vectors: DataFrame, d: int, components: int = COMPONENTS) -> dict | None:
    """n, sums S (exact), basis (d, k), values, explained and identity_error of the distinct vectors ``x`` of length d."""
    listed = fit_list(vectors)

    def add_sums(state, x):
        return state[0] + len(x), [int(s) + t for s, t in zip(x.sum(axis=0), state[1])]

    def dump_sums(state):
        return [",".join(map(str, [state[0], *state[1]])).encode()]

    def add_sum_texts(blobs):
        return ",".join(map(str, map(sum, zip(*[[int(v) for v in bytes(b).split(b",")] for b in blobs])))).encode()

    sums = tree(per_task(listed, lambda: (0, [0] * d), add_sums, dump_sums, 1), add_sum_texts)
    if sums is None:
        return None
    n, *total = [int(v) for v in sums.split(b",")]
    centre = np.array(total, object)

    def centred(x: np.ndarray) -> np.ndarray:
        return deviations(x, n, centre).astype(float) / n

    def add_vectors(state: Spectrum, x: np.ndarray) -> Spectrum:
        for row in (x - OFFSET).astype(float):
            state.add(row)
        return state

    def combine_spectra(blobs):
        first = Spectrum.load(bytes(blobs[0]), d)
        for blob in blobs[1:]:
            first.combine(Spectrum.load(bytes(blob), d))
        return first.dump()

    spectrum = Spectrum.load(tree(per_task(listed, lambda: Spectrum(d), add_vectors, lambda s: [s.dump()], d), combine_spectra), d)
    basis = np.linalg.qr(spectrum.vectors[:, ::-1])[0]

    def add_products(through: np.ndarray):
        return lambda state, x: state + (y := centred(x) @ through).T @ y

    def add_matrices(blobs):
        return np.sum([np.frombuffer(bytes(b)) for b in blobs], axis=0).tobytes()

    small = np.frombuffer(tree(per_task(listed, lambda: np.zeros((d, d)), add_products(basis), lambda s: [s.tobytes()], d), add_matrices)).reshape(d, d) / n
    values, turn = np.linalg.eigh((small + small.T) / 2)
    trace, k = float(np.trace(small)), min(components, d)
    values, vectors = values[::-1][:k], (basis @ turn[:, ::-1])[:, :k]
    real = values > trace * d * EPS
    scaled = np.where(real, vectors / np.sqrt(np.where(real, values, 1.0)), np.nan)
    r = int(real.sum())
    error = None
    if r:
        spread = np.frombuffer(tree(per_task(listed, lambda: np.zeros((r, r)), add_products(scaled[:, :r]), lambda s: [s.tobytes()], r), add_matrices)).reshape(r, r) / n
        error = float(np.abs(spread - np.eye(r)).max())
    return {"n": n, "sums": centre, "vectors": vectors, "values": values, "scaled": scaled, "explained": values / trace if trace > 0 else np.full(k, np.nan), "identity_error": error}


def deviations(x: np.ndarray, n: int, sums: np.ndarray) -> np.ndarray:
    """n * x - sums, exactly: in longs where they fit, else in whole numbers of any size."""
    most = n * int(np.abs(x).max(initial=0)) + max((abs(int(s)) for s in sums), default=0)
    return n * x - sums.astype(np.int64) if most < 2**62 else n * x.astype(object) - sums


def whiten(embeddings: DataFrame, components: int = COMPONENTS, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """A row per remaining row and component: vec_id, component, n, deviation, whitened, explained, identity_error.

    Defined cases: a null or empty vector, and one with an entry that is null or
    not finite (or 2**46 and more, which has no exact long) has no rows; equal
    vectors count once in the fit and each have their rows; a null id stays
    null; vectors of different lengths are fitted apart, each length by its own;
    a component without variance (one vector alone, fewer vectors than entries)
    has a null ``whitened``, and without any variance ``explained`` and
    ``identity_error`` are null; an empty table gives no rows; further columns
    are ignored.
    """
    spark = embeddings.sparkSession
    rows = embeddings.select(F.col(id_col).alias("vec_id"), exact_x(F.col(vector_col)).alias("x")).filter("x is not null")
    lengths = sorted(r["d"] for r in rows.select(F.size("x").alias("d")).distinct().collect())
    out = None
    for d in lengths:
        mine = rows.filter(F.size("x") == d)
        part = _whitened(mine, fit(mine, d, components))
        out = part if out is None else out.unionByName(part)
    if out is None:
        schema = ", ".join(["component int", "n long", "deviation long", "whitened double", "explained double", "identity_error double"])
        return rows.select("vec_id").filter("false").crossJoin(spark.createDataFrame([], schema))
    return out


def _whitened(rows: DataFrame, model: dict) -> DataFrame:
    ship(rows.sparkSession)
    n, sums, scaled = model["n"], model["sums"], model["scaled"]

    @F.pandas_udf("deviation long, whitened array<double>")
    def project(x: pd.Series) -> pd.DataFrame:
        if not len(x):
            return pd.DataFrame({"deviation": pd.Series([], dtype="int64"), "whitened": pd.Series([], dtype=object)})
        far = deviations(np.stack(x.to_numpy()), n, sums)
        most = int(np.abs(far).max(initial=0))
        far_squared = (far * far if most**2 * far.shape[1] < 2**62 else far.astype(object) ** 2).sum(axis=1)
        return pd.DataFrame({"deviation": far_squared, "whitened": list(far.astype(float) / n @ scaled)})

    known = lambda v: None if v is None or not np.isfinite(v) else float(v)
    explained = F.array(*[F.lit(known(v)).cast("double") for v in model["explained"]])
    rows = rows.select("vec_id", project("x").alias("p")).select("vec_id", "p.deviation", F.posexplode("p.whitened").alias("at", "w"))
    return rows.select(
        "vec_id", (F.col("at") + 1).cast("int").alias("component"), F.lit(n).cast("long").alias("n"), "deviation", F.when(~F.isnan("w"), F.col("w")).alias("whitened"),
        F.get(explained, F.col("at")).alias("explained"), F.lit(model["identity_error"]).cast("double").alias("identity_error"),
    )
