"""Clustering of windows: k-means with restarts, principal components, and measures of separation."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import PCA, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from posemill.functions.geometry import flotation_index
from posemill.functions.nulls import holds
from posemill.functions.scalars import quadrant
from posemill.operators.stats import exact_medians


def kmeans(df: DataFrame, columns: list[str], k: int, restarts: int = 10, seed: int = 0, name: str = "cluster") -> DataFrame:
    """df with the cluster of the best of `restarts` runs (least cost)."""
    rows = VectorAssembler(inputCols=columns, outputCol="_v").transform(df).cache()
    models = [KMeans(k=k, seed=seed + i, featuresCol="_v", predictionCol=name, maxIter=30).fit(rows) for i in range(restarts)]
    best = min(models, key=lambda m: m.summary.trainingCost)
    out = best.transform(rows).drop("_v")
    return out


def best_k(df: DataFrame, columns: list[str], most: int, vector: Column) -> int:
    """The k from 2 to most with the greatest mean silhouette of all rows; the first of equals."""
    scores = []
    rows = df.withColumns({"_i": F.monotonically_increasing_id(), "_p": vector}).cache()
    for k in range(2, most + 1):
        mean = silhouette(kmeans(rows, columns, k), "_i", "cluster", "_p").agg(F.avg("silhouette")).first()[0]
        scores.append((-1.0 if mean is None else mean, -k))
    rows.unpersist()
    return -max(scores)[1]


def principal_components(df: DataFrame, columns: list[str], k: int = 2) -> DataFrame:
    """df with pc1 to pc<k> of the centred columns; the sign of a component is arbitrary."""
    means = F.broadcast(df.agg(*[F.avg(c).alias(f"_m_{c}") for c in columns]))
    centred = df.join(means).withColumns({f"_c_{c}": F.col(c) - F.col(f"_m_{c}") for c in columns})
    rows = VectorAssembler(inputCols=[f"_c_{c}" for c in columns], outputCol="_v").transform(centred)
    out = PCA(k=k, inputCol="_v", outputCol="_p").fit(rows).transform(rows).withColumn("_p", vector_to_array("_p"))
    return out.select(*df.columns, *[F.col("_p")[i].alias(f"pc{i + 1}") for i in range(k)])


def distance(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))


#: Distances that are held at once in a task, and rows of a block that meet those of another.
_TILE, _BLOCK = 1 << 18, 8192


def distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Euclidean, of each row of x and of y: by dot products around the middle of y, and once more by differences where
    these lose digits (vectors far closer to each other than to the middle, or not finite)."""
    with np.errstate(all="ignore"):
        middle = np.nan_to_num(y.mean(axis=0), posinf=0.0, neginf=0.0)
        u, w = x - middle, y - middle
        scale = np.einsum("ij,ij->i", u, u)[:, None] + np.einsum("ij,ij->i", w, w)
        squares = scale - 2 * (u @ w.T)
        rows, columns = np.nonzero(~((squares > 1e-3 * scale) & (squares < np.inf)))
        step = max(1, _TILE // max(1, x.shape[1]))
        for a in range(0, len(rows), step):
            r, c = rows[a : a + step], columns[a : a + step]
            gaps = x[r] - y[c]
            squares[r, c] = np.einsum("ij,ij->i", gaps, gaps)
        return np.sqrt(squares)


def _met(cell: pa.Table) -> pa.Table:
    """i, c, oc, d, m: each row of a cell's two blocks with the sum of its distances to the other block's rows of cluster
    oc, and their number. Where both are the same block, rows of one key don't meet."""
    cell = cell.combine_chunks()
    vectors = cell["v"].chunk(0)
    lengths = np.unique(pc.list_value_length(vectors).to_numpy())
    if len(lengths) > 1:
        raise ValueError(f"vectors of different lengths: {lengths.tolist()}")
    points = vectors.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(cell), lengths[0])
    codes, keys = (cell[name].chunk(0).dictionary_encode().indices.to_numpy() for name in ("c", "i"))
    low, alone = cell["low"].to_numpy(), cell["lo"][0] == cell["hi"][0]
    first, second = (np.flatnonzero(side)[np.argsort(codes[side], kind="stable")] for side in (low, low if alone else ~low))
    kinds, starts, sizes = np.unique(codes[second], return_index=True, return_counts=True)
    mine, at, own = np.unique(codes[first], return_index=True, return_counts=True)
    there, back = np.zeros((len(first), len(kinds))), np.zeros((len(mine), len(second)))
    met = np.tile(sizes, (len(first), 1))
    step = max(1, _TILE // max(1, len(second)))
    for a in range(0, len(first) if len(second) else 0, step):
        rows = first[a : a + step]
        far = distances(points[rows], points[second])
        if alone:
            same = keys[rows][:, None] == keys[second]
            far[same] = 0.0
            met[a : a + step] -= np.add.reduceat(same, starts, axis=1, dtype=int)
        else:
            held, begins = np.unique(codes[rows], return_index=True)
            back[np.searchsorted(mine, held)] += np.add.reduceat(far, begins, axis=0)
        there[a : a + step] = np.add.reduceat(far, starts, axis=1)
    parts = [(first, second[starts], there, met)]
    if not alone:
        parts.append((second, first[at], back.T, np.tile(own, (len(second), 1))))
    found = []
    for rows, others, sums, counts in parts:
        taken = cell.select(["i", "c"]).take(np.repeat(rows, len(others)))
        oc = cell["c"].take(np.tile(others, len(rows)))
        found.append(pa.table([*taken.columns, oc, sums.ravel(), counts.ravel()], ["i", "c", "oc", "d", "m"]))
    return pa.concat_tables(found)


def silhouette(df: DataFrame, key: str, cluster: str, vector: str, block: int | None = None) -> DataFrame:
    """key, cluster, silhouette with Euclidean distance; 0 for a cluster of one, and without key, cluster or vector.

    Quadratic by definition: each row against all others. Rows are dealt into blocks, and each two blocks meet once, in a
    task that returns sums by row and cluster, so that a pair never is a row by itself. Vectors are sent to as many places
    as there are blocks. block: how many; None: of 8192 rows, but up to eight for fewer rows.
    """
    if block is None:
        rows = df.count()
        block = max(-(-rows // _BLOCK), min(8, -(-rows // 256)), 1)
    kind = "array<float>" if dict(df.dtypes)[vector] == "array<float>" else "array<double>"
    points = df.select(F.col(key).alias("i"), F.col(cluster).alias("c"), F.col(vector).cast(kind).alias("v"))
    dealt = points.dropna().withColumn("b", F.pmod(F.xxhash64("i"), F.lit(block)).cast("int"))
    sent = dealt.withColumn("o", F.explode(F.sequence(F.lit(0), F.lit(block - 1))))
    sent = sent.select(F.least("b", "o").alias("lo"), F.greatest("b", "o").alias("hi"), (F.col("b") <= F.col("o")).alias("low"), "i", "c", "v")
    kept = points.select("i", "c", F.col("c").alias("oc"), F.lit(0.0).alias("d"), F.lit(0).cast("long").alias("m"))  # also those that meet none
    met = sent.groupBy("lo", "hi").applyInArrow(_met, kept.schema).unionByName(kept)
    means = met.groupBy("i", "c", "oc").agg(F.try_divide(F.sum("d"), F.sum("m")).alias("m"))
    sides = means.groupBy("i", "c").agg(F.max(F.when(F.col("oc") == F.col("c"), F.col("m"))).alias("a"), F.min(F.when(F.col("oc") != F.col("c"), F.col("m"))).alias("b"))
    score = F.when(F.col("a").isNull() | F.col("b").isNull(), 0.0).otherwise(F.coalesce(F.try_divide(F.col("b") - F.col("a"), F.greatest("a", "b")), F.lit(0.0)))
    return sides.select(F.col("i").alias(key), F.col("c").alias(cluster), score.alias("silhouette"))


def _long(df: DataFrame, cluster: str, vector: str) -> DataFrame:
    return df.select(F.col(cluster).alias("c"), F.posexplode(F.col(vector).cast("array<double>")).alias("d", "x"))


def centroids(df: DataFrame, cluster: str, vector: str) -> DataFrame:
    """c, m (array): one row a cluster."""
    means = _long(df, cluster, vector).groupBy("c", "d").agg(F.avg("x").alias("x"))
    return means.groupBy("c").agg(F.array_sort(F.collect_list(F.struct("d", "x"))).alias("m")).select("c", F.col("m.x").alias("m"))


def davies_bouldin(df: DataFrame, cluster: str, vector: str) -> DataFrame:
    """The mean over clusters of the worst (spread + spread) / distance; one row. Clusters are few."""
    centres = F.broadcast(centroids(df, cluster, vector))
    spread = df.join(centres, F.col(cluster) == F.col("c")).groupBy("c").agg(F.avg(distance(F.col(vector).cast("array<double>"), F.col("m"))).alias("s"), F.first("m").alias("m"))
    a, b = spread.alias("a"), spread.alias("b")
    worst = a.join(F.broadcast(b), F.col("a.c") != F.col("b.c")).groupBy("a.c").agg(F.max((F.col("a.s") + F.col("b.s")) / distance(F.col("a.m"), F.col("b.m"))).alias("w"))
    return worst.agg(F.avg("w").alias("davies_bouldin"))


def calinski_harabasz(df: DataFrame, cluster: str, vector: str) -> DataFrame:
    """Between- over within-cluster variance, each by its degrees of freedom; one row."""
    rows = _long(df, cluster, vector)
    by = rows.groupBy("c", "d").agg(F.count(F.lit(1)).alias("n"), F.avg("x").alias("m"), (F.var_pop("x") * F.count(F.lit(1))).alias("w"))
    total = by.groupBy("d").agg((F.sum(F.col("m") * F.col("n")) / F.sum("n")).alias("g"))
    parts = by.join(total, "d").groupBy("c").agg(F.first("n").alias("n"), F.sum("w").alias("w"), F.sum(F.col("n") * (F.col("m") - F.col("g")) ** 2).alias("b"))
    k, n = F.count(F.lit(1)), F.sum("n")
    return parts.agg(F.when((k > 1) & (n > k) & (F.sum("w") > 0), (F.sum("b") / (k - 1)) / (F.sum("w") / (n - k))).alias("calinski_harabasz"))


def cluster_profile(df: DataFrame, cluster: str, features: list[str]) -> DataFrame:
    """Rows, median and deviation of each feature by cluster, rounded to two decimals."""
    medians = exact_medians(df, [cluster], features).select(cluster, *[F.bround(f, 2).alias(f"{f}_med") for f in features])
    spread = df.groupBy(cluster).agg(F.count(F.lit(1)).alias("n"), *[F.bround(F.stddev_pop(f), 2).alias(f"{f}_sd") for f in features])
    return spread.join(F.broadcast(medians), cluster)  # a row for each cluster


def well_profile(df: DataFrame, cluster: str, features: list[str], angle: str, hip: str, head: str) -> dict:
    """well_cluster: the one with the highest median flotation index (rounded to two decimals; ties: the smallest);
    well_profile: its medians, rounded likewise; std: each feature's sample deviation over all rows. Clusters and
    features are few."""
    index = flotation_index(F.col(angle), F.col(hip), F.col(head))
    medians = exact_medians(df.withColumn("_index", index), [cluster], [*features, "_index"])
    best = medians.filter("_index IS NOT NULL").orderBy(F.bround("_index", 2).desc(), cluster).select(cluster, *[F.bround(f, 2).alias(f) for f in features]).first()
    spread = df.agg(*[F.stddev_samp(f).alias(f) for f in features]).first()
    return {"well_cluster": best[0] if best else None, "well_profile": {f: best[f] for f in features} if best else {}, "std": {f: spread[f] for f in features}}


def named_clusters(df: DataFrame, cluster: str, view: str, angle: str, arm: str, leg: str) -> DataFrame:
    """cluster, view, name: the cluster's median angle against the view's; the sum of its median arm and leg speeds against
    the view's median of arm and leg speed together. A cluster's medians are rounded to two decimals."""
    both = df.withColumn("_both", F.col(arm) + F.col(leg))
    views = exact_medians(both, [view], [angle, "_both"]).toDF(view, "_va", "_ve")
    own = exact_medians(df, [view, cluster], [angle, arm, leg]).toDF(view, cluster, "_a", "_arm", "_leg")
    flatter, high = F.bround("_a", 2) < F.col("_va"), F.bround("_arm", 2) + F.bround("_leg", 2) > F.col("_ve")
    return own.join(F.broadcast(views), view).select(view, cluster, quadrant(holds(flatter), holds(high)).alias("name"))
