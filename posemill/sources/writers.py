"""Writers: tables, JSON documents, routed outputs, and the data behind charts."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def write_json(df: DataFrame, path: str) -> None:
    """One JSON document a row."""
    df.select(F.to_json(F.struct(*df.columns)).alias("value")).write.mode("overwrite").text(path)


def write_by_view(df: DataFrame, path: str, view: str = "view") -> None:
    """A folder for each view, so that a query of one view reads no other."""
    df.write.mode("overwrite").partitionBy(view).parquet(path)


def written_once(df: DataFrame, name: str) -> DataFrame:
    """df as a table in the folder that the session names for checkpoints, for what several jobs read; df itself where it
    names none."""
    folder = df.sparkSession.conf.get("spark.checkpoint.dir", None)
    if not folder:
        return df
    path = f"{folder}/posemill/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def clip_manifest_json(df: DataFrame, order: list[str]) -> DataFrame:
    """One row: the clips as a JSON array for an annotation page. The chosen clips are few by construction."""
    rows = F.transform(F.array_sort(F.collect_list(F.struct(*order, F.struct(*df.columns).alias("row")))), lambda r: r["row"])
    return df.agg(F.to_json(rows).alias("manifest"))


def histogram(df: DataFrame, value: str, low: float, high: float, bins: int = 20) -> DataFrame:
    """bin (1 to bins; the last is closed) and n: the counts behind a histogram."""
    place = F.when(F.col(value) == high, F.lit(bins)).otherwise(F.floor((F.col(value) - low) / ((high - low) / bins)).cast("int") + 1)
    return df.filter((F.col(value) >= low) & (F.col(value) <= high)).groupBy(place.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
