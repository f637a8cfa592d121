"""Rank-one updates and whole whitening against plain linear algebra; odd rows."""

import math
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from docquorum.llm import whitening
from docquorum.llm.whitening import Spectra, rank_one

SF_DIR = "/root/testdata/sf0.01"
RNG = np.random.default_rng(5)
TABLES = [
    RNG.integers(-10, 10, (700, 8)), RNG.integers(-10, 10, (5, 8)), np.zeros((9, 4), int), np.ones((1, 3), int),
    np.repeat(RNG.integers(-3, 3, (3, 6)), 50, 0), np.c_[RNG.integers(-5, 5, (300, 5)), np.zeros((300, 3), int)],
    np.c_[RNG.integers(-10**6, 10**6, (300, 3)), RNG.integers(-1, 2, (300, 3))],
    np.c_[RNG.integers(-9, 9, (200, 1))] * np.ones((1, 5), int), np.eye(12, dtype=int).repeat(7, 0),
]


@pytest.mark.parametrize("rows", TABLES)
@pytest.mark.parametrize("groups", [1, 2, 5, 16])
def test_spectra_follow_the_scatter(rows, groups):
    """Deflation included: copies, constant columns, equal eigenvalues, far apart scales."""
    spectra = Spectra.empty(groups, rows.shape[1])
    for begin in range(0, len(rows), groups):
        spectra.add(rows[begin:begin + groups])
    one = spectra.combined()
    q, values = one.vectors[0], one.values[0]
    centred = rows - rows.mean(0)
    scatter = centred.T @ centred
    assert one.n[0] == len(rows) and (one.sums[0] == rows.sum(0)).all()
    assert np.abs(q.T @ q - np.eye(rows.shape[1])).max() < 1e-12
    assert np.abs(q @ np.diag(values) @ q.T - scatter).max() <= 1e-12 * max(1.0, np.abs(scatter).max())


def test_rank_one_against_plain_eigenvalues():
    d = np.sort(RNG.normal(size=(6, 20)) ** 2, axis=1)
    d[0, 3:9], d[1, :] = d[0, 3], 1.0
    z = RNG.normal(size=(6, 20))
    z[2, ::2], z[3] = 0.0, 0.0
    z[4] *= 1e-9
    values, vectors = rank_one(d, np.tile(np.eye(20), (6, 1, 1)), np.full(6, 0.7), z)
    for g in range(6):
        matrix = np.diag(d[g]) + 0.7 * np.outer(z[g], z[g])
        assert np.allclose(np.sort(values[g]), np.linalg.eigvalsh(matrix), rtol=0, atol=1e-13 * 20)
        assert np.abs(vectors[g] @ np.diag(values[g]) @ vectors[g].T - matrix).max() < 1e-12


def check(rows, found, components=16):
    """Compare with whitening done in one piece on (vec_id, vector) rows."""
    whole = [(i, v) for i, v in rows if v and all(c is not None and math.isfinite(c) for c in v)]
    x = {i: [math.floor(64 * float(np.float32(c))) + 1_000_000 for c in v] for i, v in whole}
    fit = np.array(sorted({tuple(v) for v in x.values()}), dtype=object)
    n, sums = len(fit), fit.sum(0)
    centred = np.array((fit * n - sums) / n, float)
    covariance = centred.T @ centred / n
    values, vectors = np.linalg.eigh(covariance)
    values, vectors = values[::-1], vectors[:, ::-1]
    count = min(components, int((values > 1e-9 * values[0]).sum()))
    by_row = {}
    for r in found:
        by_row.setdefault(r["vec_id"], {}).setdefault(r["component"], []).append(r)
    assert set(by_row) == (set(x) if count else set())
    signs = {}
    for i, v in x.items() if count else ():
        apart = [n * a - s for a, s in zip(v, sums)]
        assert sorted(by_row[i]) == list(range(1, count + 1))
        for k in range(count):
            for r in by_row[i][k + 1]:
                assert r["n"] == n and r["deviation"] == sum(a * a for a in apart)
                want = np.array(apart, float) / n @ vectors[:, k] / math.sqrt(values[k])
                if abs(want) > 1e-6:
                    assert signs.setdefault(k, np.sign(want * r["whitened"])) == np.sign(want * r["whitened"])
                assert abs(abs(want) - abs(r["whitened"])) < 1e-8 * max(1, abs(want))
                assert abs(r["explained"] - values[k] / values.sum()) < 1e-10 and 0 <= r["identity_error"] < 1e-9


def exploded(spark, rows, components=16):
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    out = whitening.whiten(table, "embedding", components)
    assert out.columns == ["vec_id", "embedding", "whitening"]
    return out.select("vec_id", "whitening.*").select(
        "vec_id", "n", "deviation", "identity_error", F.posexplode(F.arrays_zip("whitened", "explained"))).select(
        "*", (F.col("pos") + 1).alias("component"), "col.whitened", "col.explained").collect()


def test_against_one_piece(spark, monkeypatch):
    monkeypatch.setattr(whitening, "PART_ROWS", 20)
    monkeypatch.setattr(whitening, "TOGETHER", 3)
    rows = [(i, (RNG.normal(size=5) * [9, 3, 1, .5, .2]).tolist()) for i in range(300)]
    check(rows, exploded(spark, rows))
    check(rows, exploded(spark, rows, 2), 2)


def test_odd_rows(spark):
    rows = [(i, RNG.normal(size=3).tolist()) for i in range(40)]
    rows += [(100, None), (101, [1.0, None, 2.0]), (102, [float("nan")] * 3), (103, [float("inf"), 0.0, 0.0])]
    copies = rows + [(200, rows[3][1])] * 500 + [(None, rows[4][1])]
    check(copies, exploded(spark, copies))
    other = [(300, [1.0, 2.0]), (301, [])]  # of another length, without entries
    assert {r["vec_id"] for r in exploded(spark, rows + other)} == set(range(40))
    assert exploded(spark, rows[40:]) == [] and exploded(spark, []) == []
    assert exploded(spark, [(1, [1.0, 2.0]), (2, [1.0, 2.0])]) == []  # no component without variance
    line = [(i, [float(i), 2.0 * i, 5.0]) for i in range(20)]
    check(line, exploded(spark, line))


def test_clashing_and_extra_columns(spark):
    table = spark.createDataFrame(
        [(i, [float(i % 7), float(i % 5)], i, "w", [i]) for i in range(50)],
        "vec_id long, embedding array<double>, n long, whitening string, x array<int>")
    out = whitening.whiten(table).select("n", "x", "whitening.n", "whitening.deviation").collect()
    assert len(out) == 50 and {r[2] for r in out} == {35} and max(r["deviation"] for r in out) > 0


def test_deviation_beyond_64_bits_is_null(spark):
    table = spark.createDataFrame([(i, [1e8 * i, float(i)]) for i in range(3)], "vec_id long, embedding array<double>")
    got = {r["vec_id"]: r["whitening"]["deviation"] for r in whitening.whiten(table).collect()}
    assert got[0] is None and got[1] == 0 and got[2] is None


@pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="needs the driver's tables")
def test_query(spark):
    from docquorum.llm.catalogue import QUERIES

    found = QUERIES["op11_embedding_whitening"](spark, SF_DIR)
    assert found.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    rows = spark.read.parquet(f"{SF_DIR}/embeddings.parquet").select("vec_id", "embedding").collect()
    check([tuple(r) for r in rows], found.collect())
