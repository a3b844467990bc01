"""The register of queries, and the tables that many of them start from: frames and windows of user events."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from posemill.operators.windows import hop_windows

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a function under its name, and its SQL if there is one."""
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f
    return add


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def r(column: Column | str, digits: int = 6) -> Column:
    """Rounded, so that the order of additions doesn't show."""
    return F.bround(column, digits)


def scaled(column: Column, digits: int) -> Column:
    """Rounded half to even after scaling, as the SQL's round_even does: 28.349999999999998 counts as 28.35."""
    return F.rint(column * 10.0**digits) / 10.0**digits


def mean_of(column: Column, digits: int = 6) -> Column:
    """A rounded mean. Means of short decimals can lie just between two results, where engines differ; a billionth more
    takes them off that place."""
    return F.bround(column + F.lit(1e-9), digits)


#: The hopping windows of events, in hours.
SIZE, STEP = 72.0, 36.0


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """user_id, t (hours), event_type, value, sig (value, missing for errors), k."""
    events = read(spark, sf_dir, "events")
    micros = F.expr("timestampdiff(MICROSECOND, timestamp_ntz'2024-01-01 00:00:00', ts)")
    return events.select("user_id", (micros / F.lit(3.6e9)).alias("t"), "event_type", "value",
                         F.when(F.col("event_type") != "error", F.col("value")).alias("sig"), F.get_json_object("props", "$.k").cast("long").alias("k"))


def hopped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hop_windows(frames(spark, sf_dir), ["user_id"], "t", SIZE, STEP)


def features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a window: the window features that rules and reports read, made from the events' values."""
    of = lambda kind: F.avg(F.when(F.col("event_type") == kind, F.col("value")))
    return hopped(spark, sf_dir).groupBy("user_id", "start_s").agg(
        F.count(F.lit(1)).alias("n"), mean_of(F.median("sig") / 500 * 90).alias("angle"), mean_of(F.stddev_pop("sig") / 4).alias("angle_std"),
        mean_of((F.avg("sig") - F.median("sig")) / 200).alias("slope"), mean_of(of("click") / 10).alias("arm"), mean_of(of("view") / 10).alias("leg"),
        mean_of(F.avg("value") / 40).alias("hip"), mean_of(F.avg((F.col("event_type") == "signup").cast("double"))).alias("head"),
        mean_of(100 * F.avg(F.col("sig").isNotNull().cast("double"))).alias("valid_pct"))


FRAMES = """frames AS (
  SELECT user_id, (epoch_us(ts) - 1704067200000000) / 3.6e9 AS t, event_type, value,
         CASE WHEN event_type <> 'error' THEN value END AS sig, CAST(json_extract(props, '$.k') AS BIGINT) AS k
  FROM events)"""
HOPPED = FRAMES + """, spread AS (
  SELECT *, unnest([floor(t / 36) - 1, floor(t / 36)]) * 36.0 AS start_s FROM (SELECT *, max(t) OVER (PARTITION BY user_id) AS last FROM frames)
), hopped AS (
  SELECT * FROM spread WHERE start_s >= 0 AND t >= start_s AND t < start_s + 72 AND start_s < greatest(last - 72, 0) + 1e-6)"""
FEATURES = HOPPED + """, features AS (
  SELECT user_id, start_s, count(*) AS n, round_even(median(sig) / 500 * 90 + 1e-9, 6) AS angle, round_even(stddev_pop(sig) / 4 + 1e-9, 6) AS angle_std,
         round_even((avg(sig) - median(sig)) / 200 + 1e-9, 6) AS slope,
         round_even(avg(value) FILTER (WHERE event_type = 'click') / 10 + 1e-9, 6) AS arm, round_even(avg(value) FILTER (WHERE event_type = 'view') / 10 + 1e-9, 6) AS leg,
         round_even(avg(value) / 40 + 1e-9, 6) AS hip, round_even(avg(CASE WHEN event_type = 'signup' THEN 1.0 ELSE 0.0 END) + 1e-9, 6) AS head,
         round_even(100 * avg(CASE WHEN sig IS NOT NULL THEN 1.0 ELSE 0.0 END) + 1e-9, 6) AS valid_pct
  FROM hopped GROUP BY user_id, start_s)"""
