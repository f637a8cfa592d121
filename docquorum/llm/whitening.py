"""Whitening of embeddings by an eigendecomposition that is kept up to date row by row.

1. *Fit list.* Entries become whole numbers (``floor(SCALE * c) + OFFSET``), and every distinct vector counts once, so
   that copies do not bend the axes.
2. *Updates.* A partition deals its vectors to a few spectra. A spectrum is the number of its vectors, their mean, and
   the eigenvalues and eigenvectors of their scatter. Each vector is a centred rank-one update of it: what is (almost)
   orthogonal to an eigenvector, or falls on equal eigenvalues, is deflated, the secular equation of the rest is solved
   for the new eigenvalues, and the new eigenvectors follow from the update that has exactly these eigenvalues (Gu and
   Eisenstat, 1994). All spectra of a task are updated at once.
3. *Combination.* A spectrum joins another by one rank-one update for each of its eigenvectors and one for the distance
   of the means; partitions' spectra are combined by sixteens, level by level.
4. *Refinement.* The eigenvectors found are the basis of a Rayleigh-Ritz step: partitions add up the projected
   covariance around the exact mean, and its eigenvectors turn the basis into the components, to double precision.
5. *Check.* One more pass measures how far the whitened fit list's covariance is from the identity.

Per task there are a few square matrices of the vectors' length, whatever the number of rows. What reaches the driver is
one such matrix at a time.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docquorum.session import cut_lineage

SCALE, OFFSET = 64, 1_000_000
#: Vectors a partition of the fit list is meant to hold, and how many spectra are combined at a time.
PART_ROWS, TOGETHER = 4_000, 16
MOST_GROUPS = 16
EPS = np.finfo(float).eps
SPECTRUM_DDL = "part long, n long, sums array<long>, mean array<double>, values array<double>, vectors array<double>"


# -- rank-one updates of several spectra at once ---------------------------------------------

@dataclass
class Spectra:
    """``n`` vectors, their exact ``sums`` and ``mean``, and the scatter's eigenvalues and vectors (as columns), for
    each of several groups along the first axis."""

    n: np.ndarray
    sums: np.ndarray
    mean: np.ndarray
    values: np.ndarray
    vectors: np.ndarray

    @classmethod
    def empty(cls, groups: int, d: int) -> Spectra:
        return cls(np.zeros(groups, np.int64), np.zeros((groups, d), np.int64), np.zeros((groups, d)),
                   np.zeros((groups, d)), np.tile(np.eye(d), (groups, 1, 1)))

    def part(self, at: slice) -> Spectra:
        return Spectra(self.n[at], self.sums[at], self.mean[at], self.values[at], self.vectors[at])

    def add(self, rows: np.ndarray) -> None:
        """One vector for each of the first groups."""
        g = len(rows)
        apart = rows - self.mean[:g]
        weight = self.n[:g] / (self.n[:g] + 1)
        values, vectors = rank_one(self.values[:g], self.vectors[:g], weight, apart)
        self.values[:g], self.vectors[:g] = values, vectors
        self.n[:g] += 1
        self.sums[:g] += rows
        self.mean[:g] += apart / self.n[:g, None]

    def join(self, other: Spectra) -> None:
        """The other spectra, group by group, by successive rank-one updates."""
        values, vectors = self.values, self.vectors
        for k in range(self.mean.shape[1]):
            values, vectors = rank_one(values, vectors, np.maximum(other.values[:, k], 0), other.vectors[:, :, k])
        n = self.n + other.n
        safe = np.maximum(n, 1)
        apart = other.mean - self.mean
        self.values, self.vectors = rank_one(values, vectors, self.n * (other.n / safe), apart)
        self.mean = self.mean + apart * (other.n / safe)[:, None]
        self.n, self.sums = n, self.sums + other.sums

    def combined(self) -> Spectra:
        """All groups as one, halves joined to halves."""
        now = self
        while len(now.n) > 1:
            half = (len(now.n) + 1) // 2
            first, second = now.part(slice(0, half)), now.part(slice(half, None))
            rest = half - len(second.n)
            joined = first.part(slice(0, half - rest))
            joined.join(second)
            alone = first.part(slice(half - rest, half))
            now = Spectra(*(np.concatenate([a, b]) for a, b in zip(vars(joined).values(), vars(alone).values())))
        return now


def rank_one(values: np.ndarray, vectors: np.ndarray, weight: np.ndarray, added: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues and vectors of ``V diag(values) V' + weight added added'`` for every group; weights are not negative."""
    z = np.matmul(added[:, None, :], vectors)[:, 0, :]
    order = np.argsort(values, axis=1, kind="stable")
    d, z = np.take_along_axis(values, order, 1), np.take_along_axis(z, order, 1)
    q = np.take_along_axis(vectors, order[:, None, :], 2)
    length = np.sqrt((z * z).sum(1))
    rho = weight * length * length
    z = z / np.where(length > 0, length, 1)[:, None]
    scale = np.maximum(np.abs(d).max(1), rho)
    tol = 8 * EPS * scale
    _merge_equal(d, z, q, tol)
    live = rho[:, None] * np.abs(z) > tol[:, None]
    if not live.any():
        return d, q
    order = np.argsort(~live, axis=1, kind="stable")
    d, z, live = (np.take_along_axis(a, order, 1) for a in (d, z, live))
    q = np.take_along_axis(q, order[:, None, :], 2)
    w = np.where(live, rho[:, None] * z * z, 0.0)
    roots, gaps = secular_roots(d, w, live)
    u = _vectors(d, z, live, gaps)
    return np.where(live, roots, d), np.matmul(q, u)


def _merge_equal(d: np.ndarray, z: np.ndarray, q: np.ndarray, tol: np.ndarray) -> None:
    """Turn the eigenvectors of (almost) equal eigenvalues so that only the last of them meets the update."""
    near = np.diff(d, axis=1) <= 64 * np.maximum(tol, np.finfo(float).tiny)[:, None]
    for j in np.flatnonzero(near.any(axis=0)):
        tau = np.hypot(z[:, j], z[:, j + 1])
        safe = np.where(tau > 0, tau, 1)
        c, s = z[:, j + 1] / safe, z[:, j] / safe
        turn = (tau > 0) & (np.abs((d[:, j + 1] - d[:, j]) * c * s) <= tol)
        if not turn.any():
            continue
        c, s = np.where(turn, c, 1.0), np.where(turn, s, 0.0)
        low, high = d[:, j].copy(), d[:, j + 1].copy()
        d[:, j], d[:, j + 1] = c * c * low + s * s * high, s * s * low + c * c * high
        z[:, j], z[:, j + 1] = np.where(turn, 0.0, z[:, j]), np.where(turn, tau, z[:, j + 1])
        left, right = q[:, :, j].copy(), q[:, :, j + 1].copy()
        q[:, :, j] = c[:, None] * left - s[:, None] * right
        q[:, :, j + 1] = s[:, None] * left + c[:, None] * right


def secular_roots(d: np.ndarray, w: np.ndarray, live: np.ndarray, rounds: int = 80) -> tuple[np.ndarray, np.ndarray]:
    """Roots of ``1 + sum_j w_j / (d_j - x)`` between the live poles and above the last, and ``d_j - root_i`` as [i, j].

    Live poles come first and ascend. Every root is measured from its nearer pole, so the distances keep their digits
    however close they are. A step keeps the weight of that pole and fits the rest by value and slope (Li, 1993); steps
    are held within shrinking bounds, and roots that are found leave the round.
    """
    size = d.shape[1]
    total = w.sum(1)
    # Poles that are not live have no weight; they are put out of the way.
    far = np.abs(d).max(1) + 4 * total + 1
    poles = np.where(live, d, far[:, None])
    last = np.arange(size)[None, :] == (live.sum(1) - 1)[:, None]
    above = np.concatenate([poles[:, 1:], poles[:, -1:] + 1], axis=1)
    width = np.where(last, total[:, None], above - poles)
    x, origin = np.zeros_like(d), poles.copy()
    group, i = np.nonzero(live)
    weights, width, is_last = w[group], width[group, i], last[group, i]
    middle = poles[group] - (poles[group, i] + width / 2)[:, None]
    from_right = ~is_last & (1 + (weights / middle).sum(1) < 0)
    origin[group, i] = np.where(from_right, above[group, i], poles[group, i])
    delta = poles[group] - origin[group, i][:, None]
    low = np.where(from_right, -width / 2, 0.0)
    high = np.where(from_right, 0.0, np.where(is_last, width, width / 2))
    now = (low + high) / 2
    below = np.where(from_right, -width, 0.0)  # the poles on either side, from the origin
    beyond = np.where(from_right, 0.0, width)
    own = np.where(from_right, weights[np.arange(len(i)), np.minimum(i + 1, size - 1)], weights[np.arange(len(i)), i])
    for _ in range(rounds):
        gap = delta - now[:, None]
        ratio = weights / gap
        f, slope, size_of = 1 + ratio.sum(1), (ratio / gap).sum(1), 1 + np.abs(ratio).sum(1)
        low, high = np.where(f < 0, now, low), np.where(f >= 0, now, high)
        p, q = below - now, beyond - now
        with np.errstate(all="ignore"):
            near, other = np.where(from_right, q, p), np.where(from_right, p, q)
            const = f - other * slope - (near - other) * own / (near * near)
            half, product = (p + q) * f - p * q * slope, p * q * f
            root = np.sqrt(np.abs(half * half - 4 * const * product))
            step = np.where(half <= 0, (half - root) / (2 * const), 2 * product / (half + root))
            # Above the last pole: everything below as one pole, fitted by value and slope.
            step = np.where(is_last, p + slope * p * p / (f - slope * p), step)
            new = now + step
        new = np.where((new > low) & (new < high), new, (low + high) / 2)
        exact = np.abs(f) <= EPS * size * size_of
        found = exact | (np.abs(new - now) <= 4 * EPS * np.abs(new))
        x[group, i] = now = np.where(exact, now, new)
        if found.all():
            break
        rest = ~found
        group, i, delta, weights, now, low, high, below, beyond, own, from_right, is_last = (
            a[rest] for a in (group, i, delta, weights, now, low, high, below, beyond, own, from_right, is_last))
    return origin + x, poles[:, None, :] - origin[:, :, None] - x[:, :, None]


def _vectors(d: np.ndarray, z: np.ndarray, live: np.ndarray, gaps: np.ndarray) -> np.ndarray:
    """Eigenvectors, as columns, of the update that has exactly the roots found; unit vectors where nothing is live."""
    size = d.shape[1]
    both = live[:, :, None] & live[:, None, :]
    eye = np.eye(size, dtype=bool)[None]
    between = d[:, None, :] - d[:, :, None]  # [i, j] = d_j - d_i
    ratio = np.where(both & ~eye, gaps / np.where(both & ~eye, between, 1.0), 1.0)
    own = np.abs(gaps[:, np.arange(size), np.arange(size)])
    z = np.where(live, np.sqrt(own * np.abs(np.prod(ratio, axis=1))) * np.where(z < 0, -1.0, 1.0), 0.0)
    u = np.where(both, z[:, None, :] / np.where(both, gaps, 1.0), 0.0)  # [i, j]: entry j of vector i
    length = np.sqrt((u * u).sum(2, keepdims=True))
    u = np.where(length > 0, u / np.where(length > 0, length, 1.0), 0.0)
    u = np.where(live[:, :, None], u, eye.astype(float))
    return u.transpose(0, 2, 1)


# -- fitting -----------------------------------------------------------------------------------

@dataclass
class Whitening:
    """Components (as columns) and eigenvalues of a fit list of ``n`` vectors with ``sums``, OFFSET taken out."""

    n: int
    sums: np.ndarray
    components: np.ndarray
    values: np.ndarray
    trace: float
    identity_error: float = 0.0

    def centred(self, rows: np.ndarray) -> np.ndarray:
        return (rows * float(self.n) - self.sums) / self.n

    def project(self, rows: np.ndarray) -> np.ndarray:
        return self.centred(rows) @ (self.components / np.sqrt(self.values))


def is_whole(vector: Column) -> Column:
    """Whether a vector is there and none of its entries is null, infinite or no number."""
    finite = F.forall(vector, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    return F.coalesce(vector.isNotNull() & finite, F.lit(False))


def whole_numbers(vector: Column) -> Column:
    """The entries on the integer grid, OFFSET taken out."""
    return F.transform(vector, lambda c: F.floor(F.lit(SCALE) * c.cast("double")).cast("long"))


def _matrix(column: pd.Series) -> np.ndarray:
    return np.stack(column.to_numpy()).astype(np.int64)


def _spectrum_row(part: int, spectra: Spectra) -> pd.DataFrame:
    one = spectra.combined()
    return pd.DataFrame([(part, int(one.n[0]), one.sums[0].tolist(), one.mean[0].tolist(), one.values[0].tolist(),
                          one.vectors[0].ravel().tolist())], columns=["part", "n", "sums", "mean", "values", "vectors"])


def _partition_spectra(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    spectra, part = None, -1
    for frame in frames:
        if not len(frame):
            continue
        rows = _matrix(frame["x"])
        part = int(frame["part"].iloc[0])
        if spectra is None:
            d = rows.shape[1]
            groups = 1 << min(MOST_GROUPS, max(1, len(rows) // (4 * d))).bit_length() - 1
            spectra = Spectra.empty(groups, d)
        for begin in range(0, len(rows), len(spectra.n)):
            spectra.add(rows[begin:begin + len(spectra.n)])
    if spectra is not None:
        yield _spectrum_row(part, spectra)


def _join_spectra(frame: pd.DataFrame) -> pd.DataFrame:
    d = len(frame["mean"].iloc[0])
    spectra = Spectra(
        frame["n"].to_numpy(np.int64), np.stack(frame["sums"].to_numpy()).astype(np.int64),
        np.stack(frame["mean"].to_numpy()), np.stack(frame["values"].to_numpy()),
        np.stack(frame["vectors"].to_numpy()).reshape(-1, d, d))
    return _spectrum_row(int(frame["part"].min()) // TOGETHER, spectra)


def _products(fit_list: DataFrame, project) -> tuple[np.ndarray, np.ndarray]:
    """Sums of the projected rows and of their products, added up over all partitions."""
    def partial(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = None
        for frame in frames:
            if len(frame):
                z = project(_matrix(frame["x"]))
                part = np.concatenate([z.sum(0), (z.T @ z).ravel()])
                total = part if total is None else total + part
        if total is not None:
            yield pd.DataFrame({"at": np.arange(len(total)), "value": total})

    sums = fit_list.select("x").mapInPandas(partial, "at int, value double").groupBy("at").agg(F.sum("value").alias("v"))
    flat = np.array([r["v"] for r in sorted(sums.collect(), key=lambda r: r["at"])])
    d = int((np.sqrt(1 + 4 * len(flat)) - 1) / 2)
    return flat[:d], flat[d:].reshape(d, d)


def fit(rows: DataFrame, vector: str = "embedding", components: int = 16) -> Whitening | None:
    """Learn the components from all distinct vectors; None where there is no whole vector.

    Vectors have one length, that of most rows (of the longer among equals); others, and vectors without entries, take
    no part. Components with an eigenvalue of (numerically) zero are left out, so there may be fewer than asked for.
    """
    whole = rows.filter(is_whole(F.col(vector))).select(whole_numbers(F.col(vector)).alias("x"))
    fit_list = cut_lineage(whole.filter(F.size("x") > 0).distinct())
    sizes = fit_list.groupBy(F.size("x").alias("d")).agg(F.count("*").alias("n"))
    common = sizes.orderBy(F.desc("n"), F.desc("d")).first()
    if common is None:
        return None
    if sizes.count() > 1:
        fit_list = cut_lineage(fit_list.filter(F.size("x") == common["d"]))
    parts = -(-common["n"] // PART_ROWS)
    dealt = fit_list.repartition(parts, "x").withColumn("part", F.spark_partition_id().cast("long"))
    spectra = cut_lineage(dealt.mapInPandas(_partition_spectra, SPECTRUM_DDL))
    while spectra.count() > 1:
        spectra = cut_lineage(spectra.groupBy(F.floor(F.col("part") / TOGETHER).alias("g")).applyInPandas(
            _join_spectra, SPECTRUM_DDL))
    one = spectra.first()
    d, n, sums = common["d"], one["n"], np.array(one["sums"], np.int64)
    basis, _ = np.linalg.qr(np.array(one["vectors"]).reshape(d, d)[:, np.argsort(one["values"])[::-1]])
    rough = Whitening(n, sums, basis, np.ones(d), 1.0)
    _, inner = _products(fit_list, rough.project)
    values, turn = np.linalg.eigh((inner + inner.T) / (2 * n))
    values, turn = values[::-1], turn[:, ::-1]
    keep = min(components, int((values > max(values[0], 0) * d * 1e-12).sum()))
    found = Whitening(n, sums, (basis @ turn)[:, :keep], values[:keep], float(values.sum()))
    if keep:
        sums_, products = _products(fit_list, found.project)
        mean = sums_ / n
        found.identity_error = float(np.abs(products / n - np.outer(mean, mean) - np.eye(keep)).max())
    return found


def _deviations(found: Whitening, rows: np.ndarray) -> list[int | None]:
    """Sums of squares of ``n x - sums``, exact; None where a sum passes 64 bits."""
    size = np.abs(rows * float(found.n) - found.sums).max(initial=0.0)
    if size * size * rows.shape[1] < 2.0**62:
        apart = rows * found.n - found.sums
        return (apart * apart).sum(1).tolist()
    sums = found.sums.tolist()
    exact = [sum((found.n * x - s) ** 2 for x, s in zip(row, sums)) for row in rows.tolist()]
    return [e if e < 2**63 else None for e in exact]


def whiten(rows: DataFrame, vector: str = "embedding", components: int = 16) -> DataFrame:
    """All whole vectors with all columns and ``whitening``: ``n``, ``deviation``, ``whitened`` and ``explained`` by
    component, and ``identity_error``.

    Rows whose vector is null, has a null or non-finite entry, no entry, or another length than most are left out.
    Copies count once in the fit and each get their row. Without any whole vector the result is empty; where all are
    alike the arrays are. A column named ``whitening`` is replaced. Entries are exact up to about 10^12.
    """
    kind = "struct<n:long,deviation:long,whitened:array<double>,explained:array<double>,identity_error:double>"
    found = fit(rows, vector, components)
    if found is None:
        return rows.limit(0).withColumn("whitening", F.lit(None).cast(kind))
    same = rows.filter(is_whole(F.col(vector)) & (F.size(vector) == len(found.sums)))

    @F.pandas_udf("struct<deviation:long,whitened:array<double>>")
    def judged(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if not len(batch):
                yield pd.DataFrame({"deviation": pd.Series([], dtype="Int64"), "whitened": pd.Series([], dtype=object)})
                continue
            x = _matrix(batch)
            yield pd.DataFrame({
                "deviation": pd.array(_deviations(found, x), dtype="Int64"), "whitened": list(found.project(x))})

    explained = F.array(*map(F.lit, (found.values / found.trace).tolist())) if len(found.values) else (
        F.array().cast("array<double>"))
    judgement = judged(whole_numbers(F.col(vector)))
    return same.withColumn("whitening", judgement).withColumn("whitening", F.struct(
        F.lit(found.n).cast("long").alias("n"), F.col("whitening.deviation").alias("deviation"),
        F.col("whitening.whitened").alias("whitened"), explained.alias("explained"),
        F.lit(found.identity_error).alias("identity_error")))
