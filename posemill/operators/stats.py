"""Robust and scaling statistics, exact and NULL-aware."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def points(time: str, value: str) -> Column:
    """An aggregate: the (time, value) points of a group that are complete, by time."""
    both = F.when(F.col(time).isNotNull() & F.col(value).isNotNull(), F.struct(F.col(time).cast("double").alias("t"), F.col(value).cast("double").alias("v")))
    return F.array_sort(F.collect_list(both))


def median_slope(p: Column, least: int = 4) -> Column:
    """The median slope over all pairs of points at different times; NULL below `least` points."""
    slopes = F.flatten(F.transform(p, lambda a, i: F.transform(
        F.filter(F.slice(p, i + 2, F.size(p)), lambda b: b["t"] > a["t"]), lambda b: (b["v"] - a["v"]) / (b["t"] - a["t"]))))
    return F.when(F.size(p) >= least, median_of(slopes))


def theil_sen(df: DataFrame, keys: list[str], time: str, value: str, least: int = 4, name: str = "slope") -> DataFrame:
    """The median slope over all pairs of each group's rows; NULL below `least` rows. One aggregate by key; the pairs of
    a group (a window of bounded length) are made inside its row."""
    return df.groupBy(*keys).agg(points(time, value).alias("_p")).select(*keys, median_slope(F.col("_p"), least).alias(name))


def median_of(values: Column) -> Column:
    """The median of an array of doubles without NULLs; NULL if it is empty."""
    def middle(s: Column) -> Column:
        n = F.size(s)
        low, high = F.floor((n - 1) / 2).cast("int"), F.floor(n / 2).cast("int")
        return F.when(n > 0, (F.get(s, low) + F.get(s, high)) / 2)
    return F.transform(F.array(F.array_sort(values)), middle)[0]


def exact_percentiles(df: DataFrame, columns: dict[str, Column], shares: list[float], held: int = 100_000) -> dict[str, list[float | None]]:
    """Exact interpolated percentiles of whole columns, at any size: for each name those at shares (None without values).

    Spark's exact percentile keeps all distinct values in one task. Here, as long as more than `held` values lie between
    the bounds known around a percentile, a mergeable sketch gives closer bounds and one count says how many values lie
    below and between; only then is the exact function used, on what is between. Each pass is one aggregate of scalars.
    """
    counts = df.agg(*[F.count(c).alias(n) for n, c in columns.items()]).first()
    # Of each percentile: bounds, values below the lower bound, values between, whether a sketch may still bring them closer.
    spots = {(n, p): [None, None, 0, counts[n], True] for n in columns for p in shares}

    def between(n: str, spot: list) -> Column:
        inside = F.lit(True)
        if spot[0] is not None:
            inside = (columns[n] >= spot[0]) & (columns[n] <= spot[1])
        return F.when(inside, columns[n])

    while wide := {k: s for k, s in spots.items() if s[4] and s[3] > held and (s[0] is None or s[0] < s[1])}:
        asks = {}
        for key, s in wide.items():  # one sketch for all percentiles between the same bounds
            rank = key[1] * (counts[key[0]] - 1) - s[2]
            ends = [min(1.0, max(0.0, (rank + d) / s[3])) for d in (-s[3] / 1000 - 2, s[3] / 1000 + 2)]
            asks.setdefault((key[0], s[0], s[1]), []).append((key, ends))
        told = df.agg(*[F.percentile_approx(between(own[0][0][0], spots[own[0][0]]), [e for _, ends in own for e in ends], 10_000).alias(f"b{i}") for i, own in enumerate(asks.values())]).first()
        bounds = {key: told[i][2 * j:2 * j + 2] for i, own in enumerate(asks.values()) for j, (key, _) in enumerate(own)}
        tells = []
        for i, (n, p) in enumerate(wide):
            low, high = bounds[n, p]
            tells += [F.count(F.when(columns[n] < low, 1)).alias(f"l{i}"), F.count(F.when((columns[n] >= low) & (columns[n] <= high), 1)).alias(f"m{i}")]
        told = df.agg(*tells).first()
        for i, (key, s) in enumerate(wide.items()):
            rank = key[1] * (counts[key[0]] - 1)
            held_between = told[2 * i] <= int(rank) and -int(-rank // 1) < told[2 * i] + told[2 * i + 1]
            if not held_between or told[2 * i + 1] >= s[3]:  # the sketch can do no better: the exact function takes over
                s[4] = False
            else:
                s[:] = [*bounds[key], told[2 * i], told[2 * i + 1], True]
    last: dict[tuple, list[tuple]] = {}
    for key, s in spots.items():  # one table of values for all percentiles between the same bounds
        rank = key[1] * (counts[key[0]] - 1) - s[2]
        last.setdefault((key[0], s[0], s[1]), []).append((key, min(1.0, max(0.0, rank / (s[3] - 1))) if s[3] > 1 else 0.5))
    found = df.agg(*[F.percentile(between(own[0][0][0], spots[own[0][0]]), F.lit([share for _, share in own])).alias(f"p{i}") for i, own in enumerate(last.values())]).first()
    values = {key: found[i][j] if found[i] is not None else None for i, own in enumerate(last.values()) for j, (key, _) in enumerate(own)}
    return {n: [values[n, p] for p in shares] for n in columns}


#: So many groups at most are asked for by name in one plan.
FEW_GROUPS = 200


def exact_medians(df: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """keys and the exact median of each column, for groups of any size: a group's values are never gathered in one row.
    Few groups (clusters, views) are counted down to their medians; more are sorted by key and value, which spills."""
    groups = [tuple(row) for row in df.select(*keys).distinct().limit(FEW_GROUPS + 1).collect()]
    if len(groups) > FEW_GROUPS:
        return _sorted_medians(df, keys, columns)

    def of(group: tuple) -> Column:
        out = F.lit(True)
        for key, value in zip(keys, group):
            out = out & F.col(key).eqNullSafe(F.lit(value))
        return out
    found = exact_percentiles(df, {f"{i} {c}": F.when(of(g), F.col(c)) for i, g in enumerate(groups) for c in columns}, [0.5]) if groups else {}
    rows = [(*g, *[found[f"{i} {c}"][0] for c in columns]) for i, g in enumerate(groups)]
    schema = ", ".join([f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys] + [f"`{c}` double" for c in columns])
    return df.sparkSession.createDataFrame(rows, schema)


def _sorted_medians(df: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    values = df.select(*keys, F.explode(F.array(*[F.struct(F.lit(i).alias("c"), F.col(c).cast("double").alias("v")) for i, c in enumerate(columns)])).alias("_r")).select(*keys, "_r.c", "_r.v")
    group = W.partitionBy(*keys, "c")
    # NULLs come last, so the ranks of values are those below their count.
    ranked = values.withColumn("_i", F.row_number().over(group.orderBy(F.col("v").asc_nulls_last())))
    counts = values.groupBy(*keys, "c").agg(F.count("v").alias("_n"))
    same = [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in [*keys, "c"]]
    middle = ranked.alias("a").join(counts.alias("b"), same).filter((F.col("_i") == F.floor((F.col("_n") + 1) / 2)) | (F.col("_i") == F.floor(F.col("_n") / 2) + 1) | (F.col("_i") == 1))
    near = F.when((2 * F.col("_i") >= F.col("_n")) & (2 * F.col("_i") <= F.col("_n") + 2), F.col("v"))
    wide = middle.groupBy(*[F.col(f"a.{k}").alias(k) for k in keys])
    return wide.agg(*[F.avg(F.when(F.col("a.c") == i, near)).alias(c) for i, c in enumerate(columns)])


def prepared(df: DataFrame, columns: list[str], low: float = 0.02, high: float = 0.98) -> DataFrame:
    """columns clipped to their global percentiles, NULLs replaced by the median, centred on it and divided by the
    interquartile range, as winsorized, imputed and robust_scaled after each other, from one search.

    Clipping keeps the order, and so the percentiles between the bounds; the medians put in move the others' ranks by a
    known number. Each quartile after it is then between two values of the column whose ranks follow from its counts.
    """
    told = df.agg(F.count(F.lit(1)).alias("rows"), *[F.count(c).alias(c) for c in columns]).first()
    ranks = {c: _filled_ranks(told[c], told["rows"] - told[c]) for c in columns}
    shares = sorted({low, 0.5, high, *[rank / (told[c] - 1) for c in columns if told[c] > 1 for place in ranks[c] for rank in place[0] if rank is not None]})
    found = exact_percentiles(df, {c: F.col(c) for c in columns}, shares)
    out = {}
    for c in columns:
        at = dict(zip(shares, found[c]))
        if not told[c]:
            out[c] = F.lit(0.0)
            continue
        clip = lambda v, at=at: max(min(v, at[high]), at[low])
        middle = clip(at[0.5])
        value = lambda rank, c=c, at=at, middle=middle, clip=clip: middle if rank is None or told[c] == 1 else clip(at[rank / (told[c] - 1)])
        q = [value(a) + part * (value(b) - value(a)) for (a, b), part in ranks[c]]
        filled = F.coalesce(F.greatest(F.least(F.col(c), F.lit(at[high])), F.lit(at[low])) if at[low] is not None else F.col(c), F.lit(middle))
        filled = F.when(F.col(c).isNull(), F.lit(middle)).otherwise(filled)
        out[c] = (filled - F.lit(q[1])) / F.lit(q[2] - q[0] if q[2] > q[0] else 1.0)
    return df.withColumns(out)


def _filled_ranks(present: int, missing: int) -> list[tuple]:
    """For the quartiles of a column with its missing values at the median: the ranks among the present values on either
    side (None: the median) and the share of the way between."""
    half = -(-present // 2)
    rank = lambda i: i if i < half else None if i < half + missing else i - missing
    out = []
    for share in (0.25, 0.5, 0.75):
        place = share * (present + missing - 1) if present else 0.0
        out.append(((rank(int(place)), rank(min(int(place) + 1, max(0, present + missing - 1)))), place - int(place)))
    return out


def winsorized(df: DataFrame, columns: list[str], low: float = 0.02, high: float = 0.98) -> DataFrame:
    """columns clipped to their global percentiles; NULLs stay."""
    bounds = exact_percentiles(df, {c: F.col(c) for c in columns}, [low, high])
    clip = lambda c: F.when(F.col(c).isNotNull(), F.greatest(F.least(F.col(c), F.lit(bounds[c][1])), F.lit(bounds[c][0])))
    return df.withColumns({c: clip(c) for c in columns if bounds[c][0] is not None})


def imputed(df: DataFrame, columns: list[str]) -> DataFrame:
    """NULLs replaced by the column's median, or 0 where all are NULL."""
    medians = exact_percentiles(df, {c: F.col(c) for c in columns}, [0.5])
    return df.withColumns({c: F.coalesce(c, F.lit(float(medians[c][0] or 0.0))) for c in columns})


def robust_scaled(df: DataFrame, columns: list[str]) -> DataFrame:
    """Centred on the median, divided by the interquartile range (by 1 if that is 0)."""
    quartiles = exact_percentiles(df, {c: F.col(c) for c in columns}, [0.25, 0.5, 0.75])
    scaled = lambda c, q: (F.col(c) - F.lit(q[1])) / F.lit(q[2] - q[0] if q[2] > q[0] else 1.0)
    return df.withColumns({c: scaled(c, quartiles[c]) for c in columns if quartiles[c][1] is not None})


def standardized(df: DataFrame, columns: list[str], suffix: str = "_z") -> DataFrame:
    """Adds z-scores with the population deviation; 0 for a constant column, NULL for NULL."""
    moments = F.broadcast(df.agg(*[x for c in columns for x in (F.avg(c).alias(f"_m_{c}"), F.stddev_pop(c).alias(f"_s_{c}"))]))  # one row
    z = {f"{c}{suffix}": F.when(F.col(c).isNotNull(), F.when(F.col(f"_s_{c}") > 0, (F.col(c) - F.col(f"_m_{c}")) / F.col(f"_s_{c}")).otherwise(0.0)) for c in columns}
    return df.join(moments).withColumns(z).drop(*[f"{p}{c}" for c in columns for p in ("_m_", "_s_")])


def smallest_mode(value: str) -> Column:
    """The most frequent value; of equally frequent ones the smallest."""
    return F.mode(value, True)


def class_mix(value: str, classes: tuple[int, ...] = (0, 1, 2)) -> list[Column]:
    """The share of each class, 0 where it doesn't occur."""
    return [F.avg(F.when(F.col(value) == k, 1.0).otherwise(0.0)).alias(f"share_{k}") for k in classes]


def present_enough(df: DataFrame, columns: list[str], most: float = 0.5) -> DataFrame:
    """Rows with less than the given share of the columns missing."""
    return df.filter(missing_share(columns) < most)


def missing_share(columns: list[str]) -> Column:
    out = F.lit(0)
    for c in columns:
        out = out + F.col(c).isNull().cast("int")
    return out / len(columns)


def dominance(df: DataFrame, group: str, source: str) -> DataFrame:
    """Of each group its rows, its most frequent source (ties: the smallest) and that source's share."""
    counts = df.groupBy(group, source).agg(F.count(F.lit(1)).alias("n"))
    best = F.min(F.struct((-F.col("n")).alias("n"), F.col(source).alias("source")))
    return counts.groupBy(group).agg(F.sum("n").alias("n"), best.alias("_b")).select(
        group, "n", F.col("_b.source").alias("dominant"), (-F.col("_b.n") / F.col("n")).alias("share"))


def pooled_median(*columns: str) -> Column:
    """An aggregate: the median of the values of several columns taken together."""
    kept = F.flatten(F.collect_list(F.filter(F.array(*[F.col(c).cast("double") for c in columns]), lambda v: v.isNotNull())))
    return median_of(kept)


def percentile_range(value: str, low: float = 0.1, high: float = 0.9) -> Column:
    """An aggregate: the distance between two percentiles of a group."""
    both = F.percentile(value, F.array(F.lit(low), F.lit(high)))
    return both[1] - both[0]


def level_vote(value: str, height: Column, most: float = 0.06) -> list[Column]:
    """Aggregates: the median of votes for a level (a water line, say), and whether they deviate by less than a share of
    the height."""
    return [F.median(value).alias("level"), (F.stddev_pop(value) < most * F.first(height)).alias("confident")]
