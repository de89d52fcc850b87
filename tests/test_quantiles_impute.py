import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from seriesloom.operators import impute
from seriesloom.operators.quantiles import exact_quantiles, quantile_curve

PROBS = {"min": 0.0, "p05": 0.05, "p25": 0.25, "p50": 0.5, "p90": 0.9, "max": 1.0}


def test_exact_quantiles_match_linear_interpolation(spark):
    rng = random.Random(5)
    groups = {
        "wide": [rng.gauss(0, 100) for _ in range(2000)],
        "ties": [float(rng.randrange(4)) for _ in range(999)],
        "spike": [0.0] * 900 + [rng.random() for _ in range(100)],
        "two": [1.0, 2.0],
        "one": [7.0],
    }
    rows = [(g, v) for g, vs in groups.items() for v in vs] + [("one", None), ("none", None)]
    df = spark.createDataFrame(rows, "g string, v double").repartition(5)
    got = {r.g: r for r in exact_quantiles(df, ["g"], "v", PROBS).collect()}
    assert set(got) == set(groups)
    for g, vs in groups.items():
        assert got[g].n == len(vs)
        for name, p in PROBS.items():
            assert got[g][name] == pytest.approx(np.quantile(vs, p), rel=1e-12, abs=1e-12), (g, name)


def test_quantile_curve(spark):
    values = [float(v) for v in range(37)]
    df = spark.createDataFrame([("a", v) for v in values], "g string, v double")
    curve = quantile_curve(df, ["g"], "v", 20).first().curve
    assert curve == pytest.approx(list(np.quantile(values, np.linspace(0, 1, 21))))


def brute_force(rows: np.ndarray, k: int) -> np.ndarray:
    """Row-by-row nearest-neighbour fill on scaled values, the plain way."""
    lo, hi = np.nanmin(rows, axis=0), np.nanmax(rows, axis=0)
    width = np.where(hi > lo, hi - lo, 1.0)
    x = (rows - lo) / width
    out = x.copy()
    for i, j in zip(*np.where(np.isnan(x))):
        found = []
        for d in range(len(x)):
            both = ~np.isnan(x[i]) & ~np.isnan(x[d])
            if np.isnan(x[d, j]) or not both.any():
                continue
            found.append((((x[i, both] - x[d, both]) ** 2).sum() * x.shape[1] / both.sum(), d))
        near = [x[d, j] for _, d in sorted(found)[:k]]
        out[i, j] = np.mean(near) if near else np.nanmean(x[:, j])
    return out * width + lo


@pytest.mark.parametrize("block_rows", [4096, 15])
def test_knn_matches_brute_force(spark, series, block_rows):
    """With small blocks the search goes through many boxes and must find the same rows."""
    rng = np.random.default_rng(11)
    data = {}
    for key, n in (("a", 120), ("b", 40)):
        base = rng.normal(size=(n, 3)).cumsum(axis=0)
        base[rng.random((n, 3)) < 0.12] = np.nan
        base[3] = np.nan
        data[key] = base
    flat = [
        (key, i, *[None if np.isnan(v) else float(v) for v in row]) for key, m in data.items() for i, row in enumerate(m)
    ]
    df = spark.createDataFrame(flat, "key string, i int, a double, b double, c double").withColumn(
        "ts", F.timestamp_seconds(F.col("i") * 3600).cast("timestamp_ntz")
    )
    got = impute.knn_impute(df, ["key"], ["a", "b", "c"], k=3, block_rows=block_rows).orderBy("key", "i").collect()
    for key, m in data.items():
        mine = np.array([[r.a, r.b, r.c] for r in got if r.key == key], float)
        assert mine == pytest.approx(brute_force(m, 3), abs=1e-9)


def test_knn_blank_column_stays_null_and_fit_rows_limit_donors(spark):
    rows = [(i, float(i), None, None if i == 2 else float(10 * i)) for i in range(6)]
    df = spark.createDataFrame(rows, "i int, a double, blank double, v double").withColumn(
        "ts", F.timestamp_seconds(F.col("i") * 3600).cast("timestamp_ntz")
    )
    got = impute.knn_impute(df, (), ["a", "blank", "v"], k=1, fit_on=F.col("i") >= 4).orderBy("i").collect()
    assert [r.blank for r in got] == [None] * 6
    assert got[2].v == pytest.approx(40.0)


@pytest.mark.parametrize("fan", [2, 64])
def test_knn_down_a_deep_tree(spark, monkeypatch, fan):
    """Blocks of four rows under nodes of two children: many levels, rows of one time, a column that is missing in some rows only."""
    monkeypatch.setattr(impute, "FAN", fan)
    rng = np.random.default_rng(5)
    m = rng.normal(size=(150, 4)).cumsum(axis=0)
    m[rng.random((150, 4)) < 0.15] = np.nan
    m[100:120] = m[0:20]
    flat = [(i, *[None if np.isnan(v) else float(v) for v in row]) for i, row in enumerate(m)]
    df = spark.createDataFrame(flat, "i int, a double, b double, c double, d double").withColumn(
        "ts", F.timestamp_seconds(F.floor(F.col("i") / 2) * 3600).cast("timestamp_ntz")
    )
    got = impute.knn_impute(df.coalesce(1), (), ["a", "b", "c", "d"], k=4, block_rows=4).orderBy("i").collect()
    assert len(got) == 150
    mine = np.array([[r.a, r.b, r.c, r.d] for r in got], float)
    assert mine == pytest.approx(brute_force(m, 4), abs=1e-9)


def test_visits_do_not_grow_with_the_rows(spark):
    """Ten columns that move together: ten times the rows, about as many blocks a gap."""
    names = [f"c{i}" for i in range(10)]

    def visits(n):
        rng = np.random.default_rng(8)
        u, v = rng.random(n), rng.random(n)
        m = np.stack([np.sin(3 * u + i) + 0.5 * np.cos(2 * v * (i + 1) / 5) for i in range(10)], 1)
        m = (m - m.min(0)) / (m.max(0) - m.min(0))
        m[:100, 0] = np.nan
        rows = [(i, i, *[None if np.isnan(x) else float(x) for x in r]) for i, r in enumerate(m)]
        df = spark.createDataFrame(rows, "_row long, ts long, " + ", ".join(f"{c} double" for c in names))
        donors = impute.into_blocks(df, (), names, "ts", 32)
        levels = impute.box_tree(donors, (), names)
        return impute.search(df.where("c0 is null"), levels, (), names, 5).count() / 100, levels[0].count()

    (few, blocks), (many, more) = visits(2_000), visits(20_000)
    assert more > 8 * blocks and many < 2 * few and many < 0.1 * more
