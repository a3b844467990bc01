"""Agreement of raters and classifiers: confusion counts, reports, weighted kappa. All come from one small table of
counts by (true, predicted), so the rows are read once and only counts are shuffled."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from posemill.functions.nulls import to_number


def pair_counts(df: DataFrame, true: str, predicted: str, by: list[str] | None = None) -> DataFrame:
    rows = df.filter(F.col(true).isNotNull() & F.col(predicted).isNotNull())
    return rows.groupBy(*(by or []), F.col(true).alias("t"), F.col(predicted).alias("p")).agg(F.count(F.lit(1)).alias("n"))


def confusion_matrix(df: DataFrame, true: str, predicted: str, labels: list) -> DataFrame:
    """A row for each true label, a column pred_<label> for each predicted one."""
    wide = pair_counts(df, true, predicted).groupBy("t").pivot("p", labels).agg(F.sum("n"))
    return wide.select(F.col("t").alias("true_label"), *[F.coalesce(F.col(f"`{k}`"), F.lit(0)).alias(f"pred_{k}") for k in labels])


def class_scores(counts: DataFrame, by: list[str] | None = None) -> DataFrame:
    """precision, recall, f1 and support of each class; 0 where undefined."""
    by = by or []
    label = counts.select(*by, F.explode(F.array(F.struct(F.col("t").alias("label"), F.when(F.col("t") == F.col("p"), F.col("n")).otherwise(0).alias("hit"), F.col("n").alias("real"), F.lit(0).cast("long").alias("said")),
                                                 F.struct(F.col("p").alias("label"), F.lit(0).cast("long").alias("hit"), F.lit(0).cast("long").alias("real"), F.col("n").alias("said")))).alias("c")).select(*by, "c.*")
    sums = label.groupBy(*by, "label").agg(F.sum("hit").alias("hit"), F.sum("real").alias("support"), F.sum("said").alias("said"))
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return sums.select(*by, "label", zero(F.try_divide("hit", "said")).alias("precision"), zero(F.try_divide("hit", "support")).alias("recall"),
                       zero(F.try_divide(2 * F.col("hit"), F.col("said") + F.col("support"))).alias("f1"), "support", "hit")


def summary(scores: DataFrame, by: list[str] | None = None) -> DataFrame:
    """n, accuracy, macro and weighted F1, and balanced accuracy (mean recall of the classes that occur)."""
    return scores.groupBy(*(by or [])).agg(
        F.sum("support").alias("n"), (F.sum("hit") / F.sum("support")).alias("accuracy"), F.avg("f1").alias("macro_f1"),
        (F.sum(F.col("f1") * F.col("support")) / F.sum("support")).alias("weighted_f1"), F.avg(F.when(F.col("support") > 0, F.col("recall"))).alias("balanced_accuracy"))


def weighted_kappa(counts: DataFrame, power: int = 2, labels: list | None = None) -> DataFrame:
    """Cohen's kappa with weight |i - j| ** power over places in the sorted label list (or the given one); NULL if no
    disagreement is expected. The counts, as many as pairs of labels at most, are worked on in one row."""
    row = counts.agg(F.collect_list(F.struct("t", "p", "n")).alias("c"))
    seen = F.array(*map(F.lit, labels)) if labels is not None else F.array_sort(F.array_distinct(F.concat("c.t", "c.p")))
    row = row.withColumn("l", seen).withColumn("c", F.filter("c", lambda x: F.array_contains(F.col("l"), x["t"]) & F.array_contains(F.col("l"), x["p"])))
    add = lambda values, of: F.aggregate(values, F.lit(0.0), lambda s, x: s + of(x))
    weight = lambda i, j: F.pow(F.abs(i - j).cast("double"), F.lit(float(power)))
    place = lambda x: F.array_position(F.col("l"), x)
    margin = lambda side: F.transform("l", lambda k: add(F.filter("c", lambda x: x[side] == k), lambda x: x["n"].cast("double")))
    row = row.select("c", "l", margin("t").alias("r"), margin("p").alias("k"))
    observed, total = add(F.col("c"), lambda x: weight(place(x["t"]), place(x["p"])) * x["n"]), add(F.col("c"), lambda x: x["n"].cast("double"))
    expected = F.aggregate(F.transform("r", lambda n, i: add(F.transform("k", lambda m, j: weight(i, j) * n * m), lambda x: x)), F.lit(0.0), lambda s, x: s + x)
    return row.select(observed.alias("o"), total.alias("n"), expected.alias("e")).select(F.when(F.col("e") > 0, 1 - F.col("o") * F.col("n") / F.col("e")).alias("kappa"))


def agreement(df: DataFrame, a: str, b: str) -> DataFrame:
    """Rows rated by both, exact agreement, agreement within 1, mean absolute difference, and correlation."""
    both = df.filter(F.col(a).isNotNull() & F.col(b).isNotNull())
    away = F.abs(F.col(a) - F.col(b))
    return both.agg(F.count(F.lit(1)).alias("n"), F.avg((away == 0).cast("double")).alias("exact"), F.avg((away <= 1).cast("double")).alias("within_1"),
                    F.avg(away.cast("double")).alias("mae"), F.corr(a, b).alias("pearson"))


def double_rated(a: DataFrame, b: DataFrame, target: str, source: str = "source", segment: str = "seg_id", flag: str = "exclude") -> DataFrame:
    """clip, a, b: the ratings of clips (source and segment) that both raters gave and neither excludes. Clips rated
    twice by one rater meet in all combinations."""
    def own(rows: DataFrame, name: str) -> DataFrame:
        if flag in rows.columns:
            rows = rows.filter(F.coalesce(F.col(flag).try_cast("int"), F.lit(0)) == 0)
        clip = F.concat(F.col(source).cast("string"), F.lit("__"), F.col(segment).cast("string"))
        return rows.filter(F.col(target).isNotNull()).select(clip.alias("clip"), F.col(target).cast("int").alias(name))
    return own(a, "a").join(own(b, "b"), "clip")


#: The criteria that experts rate, with their greatest rating.
CRITERIA = {"floating_outcome": 3, "activity": 2, "trunk_position": 2, "head_position": 2, "airway": 4}


def expert_pairs(expert: DataFrame, labeller: DataFrame, criteria: list[str], participant: str = "participant", flag: str = "exclude") -> DataFrame:
    """participant, criterion, expert, labeller: the expert's rating beside the labeller's mean over clips, rounded half to
    even. Ids are normalized; a rating that is missing or no number on either side gives no row."""
    from posemill.functions.scalars import participant_id

    own = labeller.withColumn(participant, participant_id(F.col(participant), "keep"))
    if flag in own.columns:
        own = own.filter(F.coalesce(F.col(flag).try_cast("int"), F.lit(0)) == 0)
    rows = lambda df, name: df.select(participant, F.explode(F.array(*[F.struct(F.lit(c).alias("criterion"), F.col(c).try_cast("int").alias(name)) for c in criteria])).alias("r")).select(participant, "r.*")
    said = rows(expert.withColumn(participant, participant_id(F.col(participant), "keep")), "expert").filter("expert IS NOT NULL")
    means = rows(mean_rating(own, [participant], criteria), "labeller").filter("labeller IS NOT NULL")
    return said.join(means, [participant, "criterion"])


def calibration(df: DataFrame, confidence: str, correct: Column, bins: int = 10) -> DataFrame:
    """bin (1 to bins, of equal width from 0 to 1), n, mean confidence and accuracy."""
    place = F.least(F.floor(F.col(confidence) * bins) + 1, F.lit(bins)).cast("int")
    rows = df.filter(F.col(confidence).isNotNull() & correct.isNotNull())
    return rows.groupBy(place.alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.avg(confidence).alias("confidence"), F.avg(correct.cast("double")).alias("accuracy"))


def mean_rating(df: DataFrame, keys: list[str], criteria: list[str]) -> DataFrame:
    """The mean rating of each criterion, rounded half to even; what is no number counts as missing."""
    return df.groupBy(*keys).agg(*[F.bround(F.avg(to_number(F.col(c))), 0).cast("int").alias(c) for c in criteria])
