"""Feedback on windows: what is far from the profile of floating well."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from posemill.functions.scalars import MESSAGES, profile_message


def profile_feedback(windows: DataFrame, profile: dict, keys: list[str], least: float = 1.5, picks: int = 3) -> DataFrame:
    """keys, rank, feature, z, message: of each window the picks features furthest from the profile, by its deviations, at
    least `least` away; ties by the feature's name, descending. z has no sign. Picked inside the row: no shuffle."""
    well, spread, found = profile["well_profile"], profile["std"], []
    for f in MESSAGES:
        if f in windows.columns and well.get(f) is not None and (spread.get(f) or 0.0) > 1e-6:
            value, ideal = F.col(f).cast("double"), F.lit(float(well[f]))
            away = F.abs((value - ideal) / F.lit(float(spread[f])))
            found.append(F.when(away >= least, F.struct(away.alias("away"), F.lit(f).alias("feature"), profile_message(f, value, ideal).alias("message"))))
    if not found:
        found = [F.lit(None).cast("struct<away:double,feature:string,message:string>")]
    best = F.slice(F.reverse(F.array_sort(F.filter(F.array(*found), lambda r: r.isNotNull()))), 1, picks)
    rows = windows.select(*keys, F.posexplode(best).alias("rank", "r"))
    return rows.select(*keys, (F.col("rank") + 1).alias("rank"), "r.feature", F.bround("r.away", 1).alias("z"), "r.message")


def issue_counts(feedback: DataFrame, most: int = 5) -> DataFrame:
    """feature and n: the features flagged in most windows."""
    return feedback.groupBy("feature").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "feature").limit(most)
