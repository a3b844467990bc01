"""Splits and constrained picks of clips for annotation."""

from __future__ import annotations

from collections import deque

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def stratified_split(df: DataFrame, unit: str, stratum: str, order: Column, train: float = 0.6, val: float = 0.2) -> DataFrame:
    """Each unit (one row each) with split: in its stratum, by order, the first max(1, round(n * train)) train, the next
    round(n * val) val, the rest test. If no stratum has a test unit and there are three units or more, the last unit by
    stratum and order is test. Strata are few; their counts are one small table."""
    sized = df.groupBy(stratum).agg(F.count(F.lit(1)).alias("_n"))
    sized = sized.withColumns({"_train": F.greatest(F.lit(1.0), F.bround(F.col("_n") * train, 0)), "_val": F.greatest(F.lit(0.0), F.bround(F.col("_n") * val, 0))})
    tested = F.max((F.col("_n") > F.col("_train") + F.col("_val")).cast("int")) == 0
    whole = sized.agg((tested & (F.sum("_n") >= 3)).alias("_none"), F.max(F.struct(F.col(stratum).isNotNull(), F.col(stratum).alias("s")))["s"].alias("_last"))
    counts = F.broadcast(sized.join(F.broadcast(whole)).withColumnRenamed(stratum, "_stratum"))
    rows = df.select(unit, stratum, order.alias("_o")).join(counts, F.col(stratum).eqNullSafe(F.col("_stratum")))
    rows = rows.withColumn("_i", F.row_number().over(W.partitionBy(stratum).orderBy("_o", unit)))
    moved = F.col("_none") & F.col(stratum).eqNullSafe(F.col("_last")) & (F.col("_i") == F.col("_n"))
    split = F.when(moved, "test").when(F.col("_i") <= F.col("_train"), "train").when(F.col("_i") <= F.col("_train") + F.col("_val"), "val").otherwise("test")
    return rows.select(unit, stratum, split.alias("split"))


def spaced_picks(df: DataFrame, group: str, at: str, score: str, most: int | None, per_group: int, spacing: float) -> DataFrame:
    """The greedy choice by descending score: at most per_group rows of a group, none closer than spacing to a chosen
    one, at most `most` rows in all. A group's choice depends on its rows alone, and the overall limit only cuts the
    order by score, so groups are chosen apart, each in the row of its array (a group is one participant's windows). Rows
    without a score (NULL, NaN) come last. Ties: the smaller group, then the smaller place."""
    value = F.nanvl(F.col(score).cast("double"), F.lit(None).cast("double"))
    row = F.struct(value.isNull().alias("m"), (-value).alias("s"), F.col(at).alias("a"), F.struct(*[F.col(c) for c in df.columns]).alias("row"))
    rows = df.groupBy(F.col(group).alias("_group")).agg(F.array_sort(F.collect_list(row)).alias("_rows"))
    none = F.filter("_rows", lambda r: F.lit(False))

    def add(kept: Column, r: Column) -> Column:
        close = F.exists(kept, lambda k: F.abs(k["a"] - r["a"]) < spacing)
        return F.when((F.size(kept) >= per_group) | close, kept).otherwise(F.concat(kept, F.array(r)))

    picked = rows.select(F.explode(F.aggregate("_rows", none, add)).alias("_r")).select("_r.row.*")
    if most is None:
        return picked
    return picked.orderBy(value.desc_nulls_last(), group, at).limit(most)


def round_robin_picks(df: DataFrame, cluster: str, group: str, at: str, order: str, most: int, per_group: int, spacing: float) -> DataFrame:
    """Turns over the clusters, each adding its next row that keeps the caps and spacing shared by all, until `most`
    rows are chosen or a turn adds none. Ties of order: the smaller group, then the smaller place.

    The choice is one sequence in one task. Left out before are only rows that it can't choose: of a cluster and group,
    those at the place of an earlier row, and those after `per_group` rows that lie twice the spacing apart, as fewer
    choices than the cap can't block all of these.
    """
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
    if spacing > 0:
        first = F.min_by(F.struct(*[F.col(c) for c in df.columns]), F.struct(F.isnull(order), F.isnan(F.col(order).cast("double")), F.col(order)))
        df = df.groupBy(F.col(cluster).alias("_c"), F.col(group).alias("_g"), F.col(at).alias("_a")).agg(first.alias("_r")).select("_r.*")

    def within_reach(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values([order, at], kind="stable")
        apart: list[float] = []
        for i, place in enumerate(rows[at].to_numpy()):
            if len(apart) >= per_group:
                return rows.iloc[:i]
            if all(abs(place - p) >= 2 * spacing for p in apart) and place == place:
                apart.append(place)
        return rows

    def turns(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values([cluster, order, group, at], kind="stable").reset_index(drop=True)
        waiting = {c: deque(part.index) for c, part in rows.groupby(cluster, sort=True)}
        groups, spots = rows[group].to_list(), rows[at].to_list()
        taken: dict[object, list[float]] = {}
        chosen: list[int] = []
        added = True
        while added and len(chosen) < most:
            added = False
            for queue in waiting.values():
                while queue and len(chosen) < most:
                    i = queue.popleft()
                    places = taken.setdefault(groups[i], [])
                    if len(places) < per_group and all(abs(spots[i] - p) >= spacing for p in places):
                        places.append(spots[i])
                        chosen.append(i)
                        added = True
                        break
        return rows.loc[chosen]

    return df.groupBy(cluster, group).applyInPandas(within_reach, schema).groupBy().applyInPandas(turns, schema)


def hash_order(key: str, seed: int) -> Column:
    """A stable shuffle."""
    return F.xxhash64(F.col(key), F.lit(seed))


def weighted_score(parts: dict[str, float]) -> Column:
    """The weighted sum of z-scores; NULL if one is missing."""
    out = F.lit(0.0)
    for column, weight in parts.items():
        out = out + weight * F.col(column)
    return out


def second_round(scored: DataFrame, reviewed: DataFrame, group: str, at: str, score: str, minority: int, unlabelled: int, per_group: int, spacing: float, each: int | None = None,
                 labelled: DataFrame | None = None) -> DataFrame:
    """The clips of a second round with seg_id (the whole part of their place; of reviewed rows their own, if they have
    one) and reason. First the greedy choice by
    score ("minority"), cut to its number; then, for groups without labels in natural order, up to `each` (per_group)
    clips at even distances, one after another, that keep away from those chosen before in their group ("unlabeled"),
    cut to their number; then all reviewed rows again ("rereview"). Of clips with equal group, seg_id and reason the
    first stays. labelled: the groups with labels (those of reviewed)."""
    from posemill.functions.scalars import natural_key
    from posemill.operators.windows import even_spread

    first = spaced_picks(scored, group, at, score, minority, per_group, spacing).withColumn("reason", F.lit("minority"))
    fresh = scored.join((reviewed if labelled is None else labelled).select(group).distinct(), group, "left_anti")
    spread = even_spread(fresh, [group], [at], each or per_group)
    near = first.groupBy(group).agg(F.collect_list(F.col(at).cast("double")).alias("_taken"))  # at most per_group places
    row = F.struct(F.col(at).cast("double").alias("_at"), F.struct(*[F.col(c) for c in scored.columns]).alias("row"))
    own = spread.groupBy(group).agg(F.array_sort(F.collect_list(row)).alias("_rows")).join(near, group, "left")  # `each` rows
    taken = F.coalesce("_taken", F.array().cast("array<double>"))

    def add(state: Column, r: Column) -> Column:
        close = F.exists(state["taken"], lambda p: F.abs(p - r["_at"]) < spacing)
        grown = F.struct(F.concat(state["taken"], F.array(r["_at"])).alias("taken"), F.concat(state["kept"], F.array(r["row"])).alias("kept"))
        return F.when(close, state).otherwise(grown)

    none = F.filter(F.transform("_rows", lambda r: r["row"]), lambda r: F.lit(False))
    free = own.select(F.explode(F.aggregate("_rows", F.struct(taken.alias("taken"), none.alias("kept")), add)["kept"]).alias("r")).select("r.*")
    second = free.orderBy(natural_key(F.col(group).cast("string")), group, at).limit(unlabelled).withColumn("reason", F.lit("unlabeled"))
    whole = F.col(at).cast("int")
    again = reviewed.withColumns({"reason": F.lit("rereview"), "seg_id": F.coalesce(F.col("seg_id").cast("int"), whole) if "seg_id" in reviewed.columns else whole})
    every = first.unionByName(second).withColumn("seg_id", whole).unionByName(again, allowMissingColumns=True)
    return every.withColumn("_i", F.row_number().over(W.partitionBy(group, "seg_id", "reason").orderBy(F.desc(score), at))).filter("_i = 1").drop("_i")
