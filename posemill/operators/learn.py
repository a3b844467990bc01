"""Grouped evaluation of classifiers: ordinal logistic models, folds that keep a participant whole, frozen models."""

from __future__ import annotations

import json
import platform
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.ml.classification import (
    DecisionTreeClassificationModel, DecisionTreeClassifier, LogisticRegression, LogisticRegressionModel, RandomForestClassificationModel, RandomForestClassifier,
)
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from posemill.operators.agreement import class_scores, pair_counts, summary, weighted_kappa
from posemill.operators.boost import Trees, boost
from posemill.operators.joins import inside_or_all, overlapping
from posemill.operators.stats import exact_percentiles


def class_weights(df: DataFrame, label: str, weight: str | None = None) -> DataFrame:
    """df with _s, the sample weight (1 where missing), and _w: n / (classes * rows of the class), times it. Classes are
    few."""
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("_c"))
    totals = counts.agg(F.sum("_c").alias("_n"), F.count(F.lit(1)).alias("_k"))
    sample = F.coalesce(F.col(weight), F.lit(1.0)) if weight else F.lit(1.0)
    balanced = df.join(F.broadcast(counts.join(totals)), label).withColumn("_s", sample.cast("double"))
    return balanced.withColumn("_w", F.col("_n") / (F.col("_k") * F.col("_c")) * F.col("_s")).drop("_c", "_n", "_k")


def fold_medians(train: DataFrame, features: list[str]) -> dict[str, float]:
    """The training medians; 0 where a feature is missing throughout."""
    found = exact_percentiles(train, {f: F.col(f) for f in features}, [0.5])
    return {f: found[f][0] or 0.0 for f in features}


def fold_scales(train: DataFrame, features: list[str], medians: dict[str, float]) -> dict[str, tuple[float, float]]:
    """Centre and width (interquartile range, 1 where that is 0) of each feature of the training rows after filling."""
    found = exact_percentiles(train, {f: F.coalesce(F.col(f).cast("double"), F.lit(float(medians[f]))) for f in features}, [0.25, 0.5, 0.75])
    return {f: (q[1] or 0.0, q[2] - q[0] if q[1] is not None and q[2] > q[0] else 1.0) for f, q in found.items()}


def assembled(df: DataFrame, features: list[str], medians: dict[str, float], scales: dict[str, tuple[float, float]] | None = None) -> DataFrame:
    """df with _x: the features as a vector, medians for missing ones, then scaled. One expression, so that plans over
    many folds stay small."""
    values, middles = F.array(*[F.col(f).cast("double") for f in features]), F.lit([float(medians[f]) for f in features])
    filled = F.zip_with(values, middles, lambda v, m: F.coalesce(v, m))
    if scales:
        filled = F.zip_with(filled, F.lit([float(scales[f][0]) for f in features]), lambda v, c: v - c)
        filled = F.zip_with(filled, F.lit([float(scales[f][1]) for f in features]), lambda v, w: v / w)
    return df.withColumn("_x", array_to_vector(filled))


def _strength(rows: DataFrame, weight: str, reg: float | None) -> float:
    """The penalty for a mean loss that stands for C = 1 on a sum of losses."""
    return reg if reg is not None else 1.0 / max(rows.agg(F.sum(weight)).first()[0] or 1.0, 1e-9)


class OrdinalLogistic:
    """K - 1 weighted logistic models of P(label > k); class shares are their differences, at least 1e-9, normalized.
    Each model balances its own two sides: n / (2 * rows of the side), times the sample weight."""

    scaled = True

    def __init__(self, reg: float | None = None, iterations: int = 3000):
        self.reg, self.iterations = reg, iterations
        self.classes: list[int] = []
        self.models: list = []

    def fit(self, rows: DataFrame, label: str, weight: str) -> OrdinalLogistic:
        """weight: the weight balanced over all classes; the sample weight _s, if it is there, is balanced anew."""
        counts = dict(rows.groupBy(label).count().collect())  # the classes of a label
        self.classes, n, self.models = sorted(counts), sum(counts.values()), []
        sample = F.col("_s") if "_s" in rows.columns else F.lit(1.0)
        for k in self.classes[:-1]:
            above = sum(c for label_, c in counts.items() if label_ > k)
            sides = rows.withColumn("_y", (F.col(label) > k).cast("double")).withColumn("_b", sample * F.when(F.col("_y") == 1, n / (2 * above)).otherwise(n / (2 * (n - above))))
            make = LogisticRegression(featuresCol="_x", labelCol="_y", weightCol="_b", regParam=_strength(sides, "_b", self.reg), standardization=False, maxIter=self.iterations,
                                      probabilityCol="_p", rawPredictionCol="_r", predictionCol="_q")
            self.models.append(make.fit(sides))
        return self

    def shares(self, rows: DataFrame) -> DataFrame:
        """rows with proba (array, in the order of classes)."""
        for i, model in enumerate(self.models):
            rows = model.transform(rows).withColumn(f"_above{i}", vector_to_array("_p")[1]).drop("_p", "_r", "_q")
        above = [F.lit(1.0), *[F.col(f"_above{i}") for i in range(len(self.models))], F.lit(0.0)]
        raw = F.array(*[F.greatest(a - b, F.lit(1e-9)) for a, b in zip(above, above[1:])])
        total = F.aggregate(raw, F.lit(0.0), lambda s, x: s + x)
        return rows.withColumn("proba", F.transform(raw, lambda x: x / total)).drop(*[f"_above{i}" for i in range(len(self.models))])


class Standard:
    """A classifier of pyspark.ml under the same two methods. make: from the label's column, the weight's, and the
    penalty for C = 1."""

    def __init__(self, make: Callable[[str, str, float], object], scaled: bool = False):
        self.make, self.scaled = make, scaled
        self.classes: list[int] = []

    def fit(self, rows: DataFrame, label: str, weight: str) -> Standard:
        self.classes = sorted(r[0] for r in rows.select(label).distinct().collect())
        place = F.array_position(F.array(*map(F.lit, self.classes)), F.col(label)) - 1
        reg = _strength(rows, weight, None) if self.scaled else 0.0
        self.model = self.make("_y", weight, reg).fit(rows.withColumn("_y", place.cast("double")))
        return self

    def shares(self, rows: DataFrame) -> DataFrame:
        return self.model.transform(rows).withColumn("proba", vector_to_array("_p")).drop("_p", "_r", "_q")


class Boosted:
    """Gradient-boosted trees of all classes together, from the sample weights alone: classes aren't balanced.

    The trees grow in one task, from at most about `most` rows: of a larger table from an even sample of that many. With
    more than 10000 rows a held-out tenth ends the rounds early. Prediction is by batches of rows, over all rows.
    """

    scaled = False

    def __init__(self, depth: int = 3, rounds: int = 400, rate: float = 0.08, l2: float = 1.0, most: int = 200_000):
        self.depth, self.rounds, self.rate, self.l2, self.most = depth, rounds, rate, l2, most
        self.classes: list[int] = []
        self.state = b""

    def fit(self, rows: DataFrame, label: str, weight: str) -> Boosted:
        """weight: the weight balanced over all classes; only the sample weight _s counts here, 1 without it."""
        counts = dict(rows.groupBy(label).count().collect())  # the classes of a label
        self.classes, n = sorted(counts), sum(counts.values())
        place = (F.array_position(F.array(*map(F.lit, self.classes)), F.col(label)) - 1).alias("y")
        given = rows.select(vector_to_array("_x").alias("x"), place, (F.col("_s") if "_s" in rows.columns else F.lit(1.0)).alias("w"))
        given = given.sample(self.most / n, seed=0) if n > self.most else given
        classes, depth, rounds, rate, l2 = len(self.classes), self.depth, self.rounds, self.rate, self.l2

        def grown(part: pd.DataFrame) -> pd.DataFrame:
            trees = boost(np.stack(part["x"].to_list()), part["y"].to_numpy(), part["w"].to_numpy(float), classes, depth, rounds, rate, l2)
            return pd.DataFrame({"state": [trees.to_bytes()]})

        self.state = bytes(given.groupBy().applyInPandas(grown, "state binary").first()[0])
        return self

    def shares(self, rows: DataFrame) -> DataFrame:
        state = self.state

        @F.pandas_udf("array<double>")
        def share(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            trees = Trees.from_bytes(state)
            for batch in batches:
                yield pd.Series(list(trees.shares(np.stack(batch.to_list()))) if len(batch) else [], dtype=object)

        return rows.withColumn("proba", share(vector_to_array("_x")))


_OUT = {"featuresCol": "_x", "probabilityCol": "_p", "rawPredictionCol": "_r", "predictionCol": "_q"}


def challengers() -> dict[str, Callable[[], object]]:
    """The models that compete. Linear ones take features scaled on their training rows; trees need no scale."""
    return {
        "ordinal": OrdinalLogistic,
        "softmax": lambda: Standard(lambda y, w, reg: LogisticRegression(labelCol=y, weightCol=w, family="multinomial", regParam=reg, standardization=False, maxIter=3000, **_OUT), True),
        "tree": lambda: Standard(lambda y, w, _: DecisionTreeClassifier(labelCol=y, weightCol=w, maxDepth=4, minInstancesPerNode=15, seed=0, **_OUT)),
        "boosted": Boosted,
        "forest": lambda: Standard(lambda y, w, _: RandomForestClassifier(labelCol=y, weightCol=w, numTrees=400, minInstancesPerNode=2, seed=0, **_OUT)),
    }


def predicted(rows: DataFrame, classes: list[int]) -> DataFrame:
    """pred (the likeliest class, the first of equals) and confidence from proba."""
    most = F.array_max("proba")
    return rows.withColumns({"pred": F.get(F.array(*map(F.lit, classes)), (F.array_position("proba", most) - 1).cast("int")), "confidence": most})


def grouped_folds(df: DataFrame, group: str, folds: int = 5) -> DataFrame:
    """group, fold: groups by descending size (ties: the smaller name) to the fold with the fewest rows so far. The
    group counts are a table of participants; the assignment needs only them."""
    sizes = [(r[0], r[1]) for r in df.groupBy(group).count().orderBy(F.desc("count"), group).collect()]
    load, out = [0] * min(folds, max(1, len(sizes))), []
    for name, n in sizes:
        least = load.index(min(load))
        load[least] += n
        out.append((name, least))
    kind = df.schema[group].dataType.simpleString()
    return df.sparkSession.createDataFrame(out, f"`{group}` {kind}, fold int")


def leave_group_out(df: DataFrame, group: str) -> DataFrame:
    """A fold for every group."""
    return grouped_folds(df, group, max(1, df.select(group).distinct().count()))


def out_of_fold(df: DataFrame, folds: DataFrame, group: str, label: str, features: list[str], make: Callable[[], object], weight: str | None = None) -> DataFrame:
    """df with fold, proba, pred and confidence from models that saw no row of the row's group. Medians, scales and class
    weights come from the training rows of each fold; a fold whose training rows have one class is left out, and if all
    are, there are no rows."""
    dealt = df.join(F.broadcast(folds), group).cache()
    out = None
    for fold in sorted(r[0] for r in folds.select("fold").distinct().collect()):
        train, test = dealt.filter(F.col("fold") != fold), dealt.filter(F.col("fold") == fold)
        if train.select(label).distinct().limit(2).count() < 2:
            continue
        medians = fold_medians(train, features)
        model = make()
        scales = fold_scales(train, features, medians) if model.scaled else None
        ready = class_weights(assembled(train, features, medians, scales), label, weight).select(label, "_s", "_w", "_x").cache()
        model.fit(ready, label, "_w")
        ready.unpersist()
        part = predicted(model.shares(assembled(test, features, medians, scales)), model.classes).drop("_x")
        out = part if out is None else out.unionByName(part)
    dealt.unpersist()
    if out is None:
        kind = df.schema[label].dataType.simpleString()
        out = dealt.limit(0).withColumns({"proba": F.lit(None).cast("array<double>"), "pred": F.lit(None).cast(kind), "confidence": F.lit(None).cast("double")})
    return out


def scored(predictions: DataFrame, label: str) -> dict[str, float]:
    """n, accuracy, the F1 means and the weighted kappa; None where nothing was predicted."""
    counts = pair_counts(predictions, label, "pred").cache()
    row = summary(class_scores(counts)).first()
    kappa = weighted_kappa(counts).first()
    counts.unpersist()
    return {**(row.asDict() if row else {}), "weighted_kappa": kappa[0] if kappa else None}


def winner(scores: dict[str, dict[str, float]]) -> str:
    """The model with the greatest macro F1 plus weighted kappa; the first of equals."""
    return max(scores, key=lambda m: (scores[m].get("macro_f1") or 0.0) + (scores[m]["weighted_kappa"] or 0.0))


class Fitted:
    """A model with what fills and scales its features."""

    def __init__(self, model: object, features: list[str], medians: dict[str, float], scales: dict[str, tuple[float, float]] | None):
        self.model, self.features, self.medians, self.scales = model, features, medians, scales

    def predict(self, df: DataFrame) -> DataFrame:
        """df with proba, pred and confidence; a feature that is no column counts as missing."""
        for f in self.features:
            if f not in df.columns:
                df = df.withColumn(f, F.lit(None).cast("double"))
        return predicted(self.model.shares(assembled(df, self.features, self.medians, self.scales)), self.model.classes).drop("_x")


def fitted(df: DataFrame, label: str, features: list[str], make: Callable[[], object], weight: str | None = None) -> Fitted:
    """A model of all rows."""
    model, medians = make(), fold_medians(df, features)
    scales = fold_scales(df, features, medians) if model.scaled else None
    model.fit(class_weights(assembled(df, features, medians, scales), label, weight), label, "_w")
    return Fitted(model, features, medians, scales)


def champion(df: DataFrame, group: str, label: str, features: list[str], weight: str | None = None, folds: int | None = None, names: list[str] | None = None) -> tuple[str, Fitted, dict]:
    """The winner of the challengers by out-of-fold scores, fitted on all rows: its name, the fitted model and all scores.
    Each group is left out in turn, or with `folds` that many at once."""
    makes = {n: m for n, m in challengers().items() if names is None or n in names}
    dealt = grouped_folds(df, group, folds) if folds else leave_group_out(df, group)
    scores = {n: scored(out_of_fold(df, dealt, group, label, features, make, weight), label) for n, make in makes.items()}
    best = winner(scores)
    return best, fitted(df, label, features, makes[best], weight), scores


def sealed_report(frozen: Fitted, df: DataFrame, video: str, label: str) -> dict[str, float]:
    """Scores of a frozen model on rows that it has not seen: by window, and by video after a vote."""
    rows = frozen.predict(df)
    votes = video_vote(rows, video, label)
    return {**scored(rows, label), "video_accuracy": votes.agg(F.avg((F.col("voted") == F.col("true_class")).cast("double"))).first()[0]}


def importances(df: DataFrame, label: str, features: list[str]) -> list[tuple[str, float]]:
    """A forest's importance of each feature, greatest first."""
    model = fitted(df, label, features, challengers()["forest"]).model.model
    return sorted(zip(features, map(float, model.featureImportances.toArray())), key=lambda x: (-x[1], x[0]))


def grouped_accuracy(df: DataFrame, group: str, label: str, features: list[str], least: int = 30, make: Callable[[], object] | None = None) -> tuple[float, float] | None:
    """Mean and deviation over five folds (or as many as groups) of a forest's accuracy on groups that it has not seen;
    None below `least` labelled rows."""
    known = df.filter(F.col(label).isNotNull())
    if known.limit(least).count() < least:
        return None
    out = out_of_fold(known, grouped_folds(known, group, 5), group, label, features, make or challengers()["forest"])
    by_fold = out.groupBy("fold").agg(F.avg((F.col("pred") == F.col(label)).cast("double")).alias("a"))
    return tuple(by_fold.agg(F.avg("a"), F.stddev_pop("a")).first())


def expert_table(expert: DataFrame, predictions: DataFrame, first: float = 30.0, last: float = 60.0) -> DataFrame:
    """participant, criterion, model, expert, voted, error: what experts rated beside each model's most frequent class (of
    equals the smallest) over the participant's windows that overlap the rated stretch, or over all if none does.
    expert: participant, criterion, rating. predictions: participant, start_s, end_s, criterion, model, pred."""
    rated = expert.filter(F.col("rating").isNotNull()).select("participant", "criterion", F.col("rating").cast("int").alias("expert"))
    joined = predictions.join(rated, ["participant", "criterion"])
    inside = overlapping(F.col("start_s"), F.col("end_s"), first, last)
    chosen = inside_or_all(joined, ["participant"], inside)
    out = chosen.groupBy("participant", "criterion", "model", "expert").agg(F.mode("pred", True).alias("voted"))
    return out.withColumn("error", F.abs(F.col("voted") - F.col("expert")))


def expert_summary(table: DataFrame) -> DataFrame:
    """criterion, model, exact (how many agree), n and mae."""
    return table.groupBy("criterion", "model").agg(F.sum((F.col("error") == 0).cast("long")).alias("exact"), F.count(F.lit(1)).alias("n"), F.avg("error").alias("mae"))


def video_vote(predictions: DataFrame, video: str, label: str) -> DataFrame:
    """video, voted and true class by the most frequent window (ties: the smallest), and the share that agrees."""
    votes = predictions.groupBy(video).agg(F.mode("pred", True).alias("voted"), F.mode(label, True).alias("true_class"), F.count(F.lit(1)).alias("n"))
    share = predictions.join(votes, video).groupBy(video).agg(F.avg((F.col("pred") == F.col("voted")).cast("double")).alias("share"))
    return votes.join(share, video)


def mean_shares(df: DataFrame, keys: list[str], proba: str, classes: list[int]) -> DataFrame:
    """keys, the likeliest class by mean share (the first of equals) and that share."""
    means = df.groupBy(*keys).agg(*[F.avg(F.col(proba)[i]).alias(f"_p{i}") for i in range(len(classes))])
    all_ = F.array(*[F.col(f"_p{i}") for i in range(len(classes))])
    return means.select(*keys, F.get(F.array(*map(F.lit, classes)), (F.array_position(all_, F.array_max(all_)) - 1).cast("int")).alias("pred"), F.array_max(all_).alias("confidence"))


def fused_views(side: Column, top: Column) -> Column:
    """Late fusion of two cameras' class shares: their mean, or the one there is."""
    both = F.zip_with(side, top, lambda a, b: (a + b) / 2)
    return F.coalesce(F.when(side.isNotNull() & top.isNotNull(), both), side, top)


def freeze(spark: SparkSession, path: str, frozen: Fitted, target: str, sealed: list[str]) -> None:
    """Writes the models and, beside them, one JSON row with what is needed to apply them, and the versions used."""
    model = frozen.model
    parts = [model.model] if isinstance(model, Standard) else [] if isinstance(model, Boosted) else model.models
    if isinstance(model, Boosted):
        spark.createDataFrame([(bytearray(model.state),)], "state binary").coalesce(1).write.mode("overwrite").parquet(f"{path}/trees")
    for i, part in enumerate(parts):
        part.write().overwrite().save(f"{path}/model-{i}")
    meta = {"kind": type(model).__name__, "classes": model.classes, "features": frozen.features, "medians": frozen.medians, "scales": frozen.scales, "target": target, "sealed": sealed, "parts": len(parts),
            "versions": {"python": platform.python_version(), "spark": spark.version, "numpy": np.__version__, "pandas": pd.__version__}}
    spark.createDataFrame([(json.dumps(meta),)], ["value"]).coalesce(1).write.mode("overwrite").text(f"{path}/meta")


def thaw(spark: SparkSession, path: str) -> tuple[Fitted, dict]:
    """The fitted model at path and what was written beside it. A path without one is an error that names it."""
    try:
        meta = json.loads(spark.read.text(f"{path}/meta").first()[0])
    except AnalysisException as missing:
        raise FileNotFoundError(f"no frozen model at {path}: run freeze first") from missing
    kinds = (DecisionTreeClassificationModel, LogisticRegressionModel, RandomForestClassificationModel)

    def load(i: int) -> object:
        told = json.loads(spark.read.text(f"{path}/model-{i}/metadata").first()[0])
        return next(k for k in kinds if told["class"].endswith(f".{k.__name__}")).load(f"{path}/model-{i}")

    model: object = {"OrdinalLogistic": OrdinalLogistic, "Boosted": Boosted}.get(meta["kind"], lambda: Standard(lambda y, w, reg: None, bool(meta["scales"])))()
    if isinstance(model, Standard):
        model.model = load(0)
    elif isinstance(model, Boosted):
        model.state = bytes(spark.read.parquet(f"{path}/trees").first()[0])
    else:
        model.models = [load(i) for i in range(meta["parts"])]
    model.classes = meta["classes"]
    scales = {f: tuple(s) for f, s in meta["scales"].items()} if meta["scales"] else None
    return Fitted(model, meta["features"], meta["medians"], scales), meta
