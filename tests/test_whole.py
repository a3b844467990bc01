"""Whole inputs and whole searches, where a cut would go unseen by the SQL."""

from __future__ import annotations

import random
import time

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from posemill.operators import cluster, learn, sampling
from posemill.plans import catalog


def vectors(spark, tmp_path, n: int = 120):
    """Embeddings whose classes show only in dimension 9 and later."""
    rng = random.Random(3)
    rows = [(i, [rng.gauss(0, 0.01) for _ in range(8)] + [10.0 * (i // 10 % 3) + rng.gauss(0, 0.1), rng.gauss(0, 0.1)], i // 10 % 3) for i in range(n)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(str(tmp_path / "embeddings.parquet"))
    return str(tmp_path)


def test_whole_embeddings_are_used(spark, tmp_path):
    at = vectors(spark, tmp_path)
    label = (F.col("vec_id") / 10).cast("int") % 3
    found = catalog.QUERIES["cluster_kmeans"](spark, at).groupBy("cluster").agg(F.countDistinct(label).alias("n"))
    assert found.agg(F.max("n")).first()[0] == 1
    pc = catalog.QUERIES["pca2"](spark, at).withColumn("label", label)
    assert abs(pc.agg(F.corr("pc1", "label")).first()[0]) > 0.99
    for name in ("grouped_kfold", "ordinal_oof"):  # a third by chance
        assert catalog.QUERIES[name](spark, at).filter("pred = y").count() > 100


def turns(rows, most, per_group, spacing):
    """The loop over all rows (cluster, group, at, order)."""
    rows = sorted(rows, key=lambda r: (r[0], r[3], r[1], r[2]))
    chosen, taken, added = [], {}, True
    while added and len(chosen) < most:
        added = False
        for c in sorted({r[0] for r in rows}):
            for r in rows:
                places = taken.setdefault(r[1], [])
                if len(chosen) < most and r[0] == c and r not in chosen and len(places) < per_group and all(abs(r[2] - p) >= spacing for p in places):
                    places.append(r[2])
                    chosen.append(r)
                    added = True
                    break
    return sorted(chosen)


def test_round_robin_goes_on_after_a_burst(spark):
    rows = [(0, "p", 0.1 * i, i) for i in range(20)] + [(0, "p", 50.0, 20), (0, "p", 90.0, 21)]
    got = sampling.round_robin_picks(spark.createDataFrame(rows, "c int, g string, at double, o int"), "c", "g", "at", "o", 10, 3, 6.0)
    assert sorted(r["at"] for r in got.collect()) == [0.0, 50.0, 90.0]


@pytest.mark.parametrize("seed, spacing", [(1, 6.0), (2, 3.0), (3, 12.0), (4, 0.0)])
def test_round_robin_equals_the_loop_over_all_rows(spark, seed, spacing):
    rng = random.Random(seed)
    rows = [(rng.randrange(3), f"p{rng.randrange(4)}", float(rng.choice((0, 5, 40)) + rng.randrange(8)), i) for i in range(200)]
    got = sampling.round_robin_picks(spark.createDataFrame(rows, "c int, g string, at double, o int"), "c", "g", "at", "o", 40, 4, spacing)
    assert sorted(map(tuple, got.collect())) == turns(rows, 40, 4, spacing)


@pytest.mark.parametrize("name, folds", [("grouped_kfold", 5), ("ordinal_oof", 10)])
def test_models_learn_from_all_other_folds(spark, tmp_path, name, folds):
    """Ten participants: five folds of two, or each left out once."""
    found = catalog.QUERIES[name](spark, vectors(spark, tmp_path)).groupBy("fold").agg(F.countDistinct(F.col("vec_id") % 10).alias("n"))
    assert [r["n"] for r in found.collect()] == [10 // folds] * folds


def test_best_k_scores_all_rows(spark, monkeypatch):
    rng = random.Random(6)
    rows = [(rng.gauss(10 * (i % 3), 0.3), rng.gauss(0, 0.3)) for i in range(2400)]
    df = spark.createDataFrame(rows, "x double, y double")
    scored, whole = [], cluster.silhouette

    def counting(rows, *args):
        scored.append(rows.count())
        return whole(rows, *args)

    monkeypatch.setattr(cluster, "silhouette", counting)
    assert cluster.best_k(df, ["x", "y"], 4, F.array("x", "y")) == 3
    assert scored == [2400] * 3


def silhouettes(spark, at, rows):
    """By the registered query and by its SQL."""
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").repartition(4).write.parquet(f"{at}/embeddings.parquet")
    with duckdb.connect() as con:
        con.sql(f"CREATE VIEW embeddings AS SELECT * FROM read_parquet('{at}/embeddings.parquet/*.parquet')")
        want = con.sql(catalog.ORACLE["silhouette_euclid"]).fetchall()
    order = lambda found: sorted(map(tuple, found), key=str)
    began = time.time()
    return order(catalog.QUERIES["silhouette_euclid"](spark, str(at)).collect()), order(want), time.time() - began


def test_silhouette_of_some_thousand_vectors(spark, tmp_path):
    rng = random.Random(7)
    rows = [(i, [rng.gauss(i % 5 / 3, 1) for _ in range(64)], i % 5) for i in range(6000)]
    got, want, seconds = silhouettes(spark, tmp_path, rows)
    assert got == want and seconds < 25


def test_silhouette_of_awkward_rows(spark, tmp_path):
    """Copies, vectors far closer to each other than to the others, a cluster of one, and rows without a key, label or vector."""
    rng = random.Random(8)
    rows = [(i, [1e6 * (i % 3) + rng.randrange(4) for _ in range(5)], i % 3) for i in range(900)]
    rows += [(900 + i, [0.125 + i % 2 / 1024] * 5, 3) for i in range(100)] + [(1000, [7.0] * 5, 4), (None, [5.0] * 5, 1), (1002, [3.0] * 5, None), (1003, None, 2)]
    got, want, _ = silhouettes(spark, tmp_path, rows)
    assert len(got) == 1004 and got == want


@pytest.mark.parametrize("block", [1, 3, 40])
def test_silhouette_in_any_blocks(spark, block):
    """Keys and clusters of text; two rows of one key don't meet."""
    rng = np.random.default_rng(9)
    points = rng.normal(size=(60, 3))
    rows = [(f"k{i // 2 if i < 4 else i}", "ab"[i % 3 == 0] if i >= 4 else "a", points[i].tolist()) for i in range(60)]
    got = {r["k"]: r["silhouette"] for r in cluster.silhouette(spark.createDataFrame(rows, "k string, c string, v array<double>"), "k", "c", "v", block).collect()}
    far = np.sqrt(((points[:, None] - points) ** 2).sum(axis=2))
    for k in got:
        own, mean = [i for i in range(60) if rows[i][0] == k], {}
        for c in "ab":
            mean[c] = np.mean([far[i, j] for i in own for j in range(60) if rows[j][1] == c and rows[j][0] != k])
        a, b = (mean[c] for c in ("ab" if rows[own[0]][1] == "a" else "ba"))
        assert got[k] == pytest.approx((b - a) / max(a, b), abs=1e-12)
    assert len(got) == 58


def test_distances_keep_their_digits():
    """Beside the plain differences: vectors close together and far from the middle, copies, and values that are not finite."""
    rng = np.random.default_rng(10)
    x = np.concatenate([rng.normal(size=(40, 16)), 1e8 + rng.normal(size=(40, 16)) * 1e-3, np.full((2, 16), np.inf), np.full((1, 16), np.nan)])
    with np.errstate(invalid="ignore"):
        plain = np.sqrt(((x[:, None] - x) ** 2).sum(axis=2))
    np.testing.assert_allclose(cluster.distances(x, x), plain, rtol=1e-11)


def test_searches_are_as_long_as_the_reference_s(spark, monkeypatch):
    seeds, make = [], cluster.KMeans
    monkeypatch.setattr(cluster, "KMeans", lambda **named: seeds.append(named["seed"]) or make(**named))
    df = spark.createDataFrame([(i % 2, float(i % 2 + i / 100)) for i in range(40)], "y int, x double")
    cluster.kmeans(df, ["x"], 2)
    assert seeds == list(range(10))
    rows = learn.class_weights(learn.assembled(df, ["x"], {"x": 0.0}), "y")
    assert learn.challengers()["forest"]().fit(rows, "y", "_w").model.getNumTrees == 400
    assert learn.OrdinalLogistic().iterations == 3000
