"""Windows over time series: hopping and centred windows, differences, gap filling, slices and picks by position."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def hop_windows(df: DataFrame, keys: list[str], time: str, size: float, step: float, name: str = "start_s", whole_only: bool = True) -> DataFrame:
    """Each row once for every window [k * step, k * step + size), k from 0, that holds its time.

    With whole_only only windows that a series reaches to the end are kept, and always the one at 0, as a loop over
    starts below max(last time - size, 0) would give. One window aggregate over the keys; no self-join.
    """
    k = F.sequence(F.floor(F.col(time) / step) - int(-(-size // step)) + 1, F.floor(F.col(time) / step))
    rows = df
    if whole_only:
        rows = rows.withColumn("_last", F.max(time).over(W.partitionBy(*keys)))
    rows = rows.withColumn("_k", F.explode(k)).filter("_k >= 0").withColumn(name, F.col("_k") * F.lit(float(step)))
    rows = rows.filter((F.col(time) >= F.col(name)) & (F.col(time) < F.col(name) + size))
    if whole_only:
        rows = rows.filter(F.col(name) < F.greatest(F.col("_last") - size, F.lit(0.0)) + 1e-6).drop("_last")
    return rows.drop("_k")


def centred_windows(df: DataFrame, starts: DataFrame, keys: list[str], time: str, start: str, size: float, around: float) -> DataFrame:
    """The rows of df within around / 2 of the centre of each window of starts. Both sides are dealt by key and time
    slot, so a long series is no hot key."""
    centre = F.col(start) + size / 2
    slots = starts.withColumn("_slot", F.explode(F.sequence(F.floor((centre - around / 2) / around), F.floor((centre + around / 2) / around))))
    rows = df.withColumn("_slot", F.floor(F.col(time) / around))
    joined = rows.join(slots, [*keys, "_slot"])
    return joined.filter((F.col(time) >= centre - around / 2) & (F.col(time) < centre + around / 2)).drop("_slot")


def difference(value: str, keys: list[str], time: str) -> Column:
    """value minus that of the row before."""
    return F.col(value) - F.lag(value).over(W.partitionBy(*keys).orderBy(time))


def interpolate_gaps(df: DataFrame, keys: list[str], time: str, value: str, limit: int, name: str = "filled") -> DataFrame:
    """value with gaps filled forward: in each gap the first limit rows, on the line between the rows around it (rows
    count as evenly spaced); after the last value that value; before the first nothing."""
    order = W.partitionBy(*keys).orderBy(time)
    n = F.row_number().over(order)
    before = order.rowsBetween(W.unboundedPreceding, 0)
    after = order.rowsBetween(0, W.unboundedFollowing)
    rows = df.withColumn("_n", n)
    at = F.when(F.col(value).isNotNull(), F.col("_n"))
    rows = rows.withColumns({"_v0": F.last(value, True).over(before), "_n0": F.last(at, True).over(before), "_v1": F.first(value, True).over(after), "_n1": F.first(at, True).over(after)})
    steps = F.col("_n") - F.col("_n0")
    line = F.col("_v0") + (F.coalesce("_v1", "_v0") - F.col("_v0")) * steps / F.coalesce(F.col("_n1") - F.col("_n0"), F.lit(1))
    return rows.withColumn(name, F.coalesce(value, F.when(steps <= limit, line))).drop("_n", "_v0", "_n0", "_v1", "_n1")


def middle_slice(df: DataFrame, keys: list[str], order: list[str], share: float = 0.1, least: int = 10) -> DataFrame:
    """Without the first and last share of each group's rows, if it has at least `least`."""
    n = F.count(F.lit(1)).over(W.partitionBy(*keys))
    i = F.row_number().over(W.partitionBy(*keys).orderBy(*order)) - 1
    rows = df.withColumns({"_n": n, "_i": i})
    inside = (F.col("_i") >= F.floor(F.col("_n") * share)) & (F.col("_i") < F.floor(F.col("_n") * (1 - share)))
    return rows.filter((F.col("_n") < least) | inside).drop("_n", "_i")


def even_spread(df: DataFrame, keys: list[str], order: list[str], picks: int) -> DataFrame:
    """picks rows of each group at even distances, first and last included (all rows of a smaller group)."""
    rows = df.withColumns({"_n": F.count(F.lit(1)).over(W.partitionBy(*keys)), "_i": F.row_number().over(W.partitionBy(*keys).orderBy(*order)) - 1})
    m = F.least(F.lit(picks), F.col("_n"))
    places = F.transform(F.sequence(F.lit(0), m - 1), lambda j: F.when(m > 1, F.rint(j * (F.col("_n") - 1) / (m - 1))).otherwise(0.0).cast("long"))
    return rows.filter(F.array_contains(places, F.col("_i").cast("long"))).drop("_n", "_i")


def keep_first(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each group; order must be total for one answer."""
    return df.withColumn("_i", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).filter("_i = 1").drop("_i")


def top_deviations(df: DataFrame, keys: list[str], scores: dict[str, Column], least: float = 1.5, picks: int = 3) -> DataFrame:
    """For each row of df its keys with the picks features whose score is furthest from 0 (least at least); ties by the
    feature's name, descending. Picked inside the row: no shuffle."""
    rows = F.array(*[F.struct(F.abs(c).alias("away"), F.lit(n).alias("feature"), c.alias("z")) for n, c in scores.items()])
    best = F.slice(F.reverse(F.array_sort(F.filter(rows, lambda r: r["away"] >= least))), 1, picks)
    return df.select(*keys, F.posexplode(best).alias("rank", "d")).select(*keys, (F.col("rank") + 1).alias("rank"), "d.feature", "d.z")
