"""Nearest-row fills against a comparison of all pairs."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from episodia.operators import neighbours as N


def all_pairs(x, k):
    """Fills by comparing every row with every other."""
    z = (x - np.nanmean(x, 0)) / np.nanstd(x, 0)
    distinct = np.unique(z, axis=0)
    out = x.copy()
    for i in range(len(x)):
        for j in np.flatnonzero(np.isnan(x[i])):
            found = []
            for d in distinct:
                both = ~np.isnan(z[i]) & ~np.isnan(d)
                if not np.isnan(d[j]) and both.any():
                    found.append((((z[i] - d)[both] ** 2).mean(), d[j]))
            near = sorted(found)[:k]
            out[i, j] = np.mean([v for _, v in near]) * np.nanstd(x[:, j]) + np.nanmean(x[:, j]) if near else np.nanmean(x[:, j])
    return out


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(3)
    n = 500
    base = rng.normal(size=(n, 2))
    x = np.column_stack([base, base @ [1.0, 2.0], base @ [-1.0, 0.5]]) + rng.normal(scale=0.05, size=(n, 4))
    x[rng.uniform(size=x.shape) < 0.2] = np.nan
    x[400:450] = x[0]  # copies
    rows = [(i, *[None if np.isnan(v) else float(v) for v in r]) for i, r in enumerate(x)]
    return spark.createDataFrame(rows, "id long, a double, b double, c double, d double").repartition(5), x


def filled(df, **options):
    got = N.filled_from_nearest(df, ["a", "b", "c", "d"], **options).orderBy("id")
    return np.array([[r[c] for c in "abcd"] for r in got.collect()], float)


def test_one_leaf_equals_all_pairs(table):
    df, x = table
    assert np.allclose(filled(df, k=3, trees=1, leaf=1000), all_pairs(x, 3))


def test_small_leaves_and_cells_are_close_to_all_pairs(table, monkeypatch):
    df, x = table
    want = all_pairs(x, 1)
    monkeypatch.setattr(N, "CELL_ROWS", 150)
    got = filled(df, k=1, trees=8, leaf=60)
    lacking = np.isnan(x)
    assert not np.isnan(got).any() and np.allclose(got[~lacking], x[~lacking])
    # share of nearest rows found
    assert np.isclose(got[lacking], want[lacking]).mean() >= 0.9


def test_nothing_known_nothing_given(spark):
    df = spark.createDataFrame([(1, None, 1.0), (2, 5.0, None), (3, None, None)], "id long, a double, b double").withColumn("z", F.lit("mine"))
    got = {r.id: r for r in N.filled_from_nearest(df, ["a", "b"]).collect()}
    assert (got[3].a, got[3].b, got[1].a, got[1].z) == (5.0, 1.0, 5.0, "mine")
    assert N.filled_from_nearest(df.filter("1 = 0"), ["a", "b"]).count() == 0


def test_boxes_find_what_all_pairs_find(table, monkeypatch):
    df, x = table
    monkeypatch.setattr(N, "FULL_ROWS", 0)
    monkeypatch.setattr(N, "RUN", 8)
    # leaves of 60 rows would miss some; with one cell nothing is missed
    assert np.allclose(filled(df, k=3, trees=8, leaf=60), all_pairs(x, 3))
    monkeypatch.setattr(N, "CELL_VALUES", 600)
    want, lacking = all_pairs(x, 1), np.isnan(x)
    got = filled(df, k=1, trees=8, leaf=60)
    assert np.allclose(got[~lacking], x[~lacking]) and np.isclose(got[lacking], want[lacking]).mean() >= 0.9
