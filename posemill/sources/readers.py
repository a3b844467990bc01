"""Readers. File names carry meaning (participant, view), so every reader adds where a row comes from."""

from __future__ import annotations

import csv
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from posemill.functions.geometry import window_center
from posemill.functions.nulls import ensure_columns, nan_to_null
from posemill.functions.scalars import file_name, manifest_participant, manifest_trial, manifest_view, participant_id
from posemill.sources import schemas

VIDEO_SUFFIXES = ("mp4", "mov", "avi", "mkv", "m4v")


def with_source(df: DataFrame) -> DataFrame:
    return df.withColumn("source", F.col("_metadata.file_name"))


def read_csv(spark: SparkSession, paths: str | list[str], schema: str) -> DataFrame:
    """CSV files by glob, matched by header names to the schema; NaN becomes NULL; source is the file's name. A path
    without a file is an error of the reader."""
    rows = spark.read.option("header", True).option("enforceSchema", False).option("columnNameOfCorruptRecord", "_bad").schema(schema).csv(paths)
    return nan_to_null(with_source(rows))


def _headers(spark: SparkSession, paths: str | list[str]) -> dict[tuple[str, ...], list[str]]:
    """The files of the paths (globs, files or folders) by their header lines: one line is read of each."""
    jvm, conf, found = spark._jvm, spark._jsc.hadoopConfiguration(), {}
    for pattern in [paths] if isinstance(paths, str) else paths:
        at = jvm.org.apache.hadoop.fs.Path(pattern)
        system = at.getFileSystem(conf)
        for status in system.globStatus(at) or []:
            for file in system.listStatus(status.getPath()) if status.isDirectory() else [status]:
                if file.isDirectory() or file.getPath().getName().startswith(("_", ".")):
                    continue
                lines = jvm.java.io.BufferedReader(jvm.java.io.InputStreamReader(system.open(file.getPath()), "UTF-8"))
                header = lines.readLine()
                lines.close()
                if header:
                    found.setdefault(tuple(next(csv.reader([header.lstrip("\ufeff")]))), []).append(file.getPath().toString())
    return found


def read_features(spark: SparkSession, paths: str | list[str], min_valid: float | None = 60.0) -> DataFrame:
    """Window features from CSV or Parquet with source, participant and win_center; windows below min_valid percent are
    left out. Files may have different columns (generations of the table): what a file lacks is NULL. Either name of a
    renamed column is understood. No file at all is an error."""
    first = paths if isinstance(paths, str) else paths[0]
    if first.rstrip("/").endswith(".csv"):
        kinds = dict(p.split(" ") for p in schemas.WINDOWS.split(", ")) | dict(p.split(" ") for p in schemas.LEGACY.split(", "))
        parts = [read_csv(spark, files, ", ".join(f"`{c}` {kinds.get(c, 'string')}" for c in header)) for header, files in _headers(spark, paths).items()]
        if not parts:
            raise FileNotFoundError(f"no feature files matched {paths}")
        rows = parts[0]
        for part in parts[1:]:
            rows = rows.unionByName(part, allowMissingColumns=True)
    else:
        rows = nan_to_null(with_source(spark.read.option("mergeSchema", True).parquet(*([paths] if isinstance(paths, str) else paths))))
    rows = ensure_columns(rows, {"valid_pct": "double"}, schemas.ALIASES)
    if "torso_valid_pct" in rows.columns:
        rows = rows.withColumn("valid_pct", F.coalesce("valid_pct", "torso_valid_pct"))
    rows = rows.withColumns({"participant": participant_id(F.col("source")), "win_center": window_center(F.col("start_s"), F.col("end_s"))})
    return rows if min_valid is None else rows.filter(F.col("valid_pct") >= min_valid)


def read_landmarks(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    return read_csv(spark, paths, schemas.FRAMES)


def read_profile(spark: SparkSession, path: str, schema: str = "well_cluster int, well_profile map<string,double>, std map<string,double>") -> DataFrame:
    return spark.read.schema(schema).json(path, multiLine=True)


def _listed(sealed: DataFrame) -> DataFrame:
    """Participants under the ids that readers give, however the list writes them (P7, p007)."""
    return sealed.select(participant_id(F.col("participant")).alias("participant"))


def without_participants(df: DataFrame, sealed: DataFrame) -> DataFrame:
    return df.join(_listed(sealed), "participant", "left_anti")


def only_participants(df: DataFrame, sealed: DataFrame) -> DataFrame:
    return df.join(_listed(sealed), "participant", "left_semi")


def name_excludes(path: Column, *parts: str) -> Column:
    """True for names that hold none of the parts, whatever the case."""
    out = F.lit(True)
    for p in parts:
        out = out & ~F.lower(path).contains(p.lower())
    return out


def video_index(spark: SparkSession, folder: str) -> DataFrame:
    """path, length and modification time of the video files below a folder, without their content."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder).select("path", "length", "modificationTime")
    return files.filter(F.lower(F.element_at(F.split("path", r"\."), -1)).isin(*VIDEO_SUFFIXES))


def manifest(files: DataFrame, path: str = "path", content: str | None = None, probes: DataFrame | list[str] | None = None, exercise: str = "back_float",
             rounded: Callable[[Column, int], Column] = F.bround) -> DataFrame:
    """The manifest's row of each file: ids from its name, what a probe of the video says, readable (it has frames and a
    duration) and sha256 of the content column. probes: path, fps, width, height, frames, one row a file, as a codec
    gives them; or the four columns of files that hold them already, where paths may repeat. A file without one, or with
    NULLs, counts as 0. rounded: how fps and duration are rounded to so many digits."""
    name = file_name(F.col(path))
    pid, trial, view = manifest_participant(name), manifest_trial(name), manifest_view(name)
    rows = files
    if probes is None:
        rows = rows.withColumns({f"_{c}": F.lit(0) for c in ("fps", "width", "height", "frames")})
    elif isinstance(probes, list):
        rows = rows.withColumns({f"_{c}": F.col(own) for c, own in zip(("fps", "width", "height", "frames"), probes, strict=True)})
    else:
        told = probes.select(F.col("path").alias(path), *[F.col(c).alias(f"_{c}") for c in ("fps", "width", "height", "frames")])
        rows = rows.join(told, path, "left")
    fps, frames = F.coalesce(F.col("_fps").cast("double"), F.lit(0.0)), F.coalesce(F.col("_frames").cast("int"), F.lit(0))
    seconds = F.when(fps > 0, rounded(frames / fps, 1)).otherwise(0.0)
    return rows.select(
        F.concat_ws("_", pid, trial, view).alias("video_id"), pid.alias("participant_id"), trial.alias("trial_id"), view.alias("view"), name.alias("filename"),
        rounded(fps, 2).alias("fps"), seconds.alias("duration_s"), *[F.coalesce(F.col(f"_{c}").cast("int"), F.lit(0)).alias(c) for c in ("width", "height")], frames.alias("frames"),
        F.lit(exercise).alias("exercise"), ((frames > 0) & (seconds > 0)).alias("readable"), (F.sha2(F.col(content).cast("binary"), 256) if content else F.lit(None).cast("string")).alias("sha256"))


def duplicate_ids(rows: DataFrame, key: str, what: str) -> DataFrame:
    """key, n and the sorted names of what occurs more than once."""
    return rows.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.array_join(F.array_sort(F.collect_list(what)), ",").alias("names")).filter("n > 1")
