"""Joins of windows with label intervals, memberships with defaults, and matches by priority."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def attach_labels(points: DataFrame, labels: DataFrame, key: str, at: str, start: str, end: str, order: str, value: str, weight: str | None = None,
                  id_columns: list[str] | None = None, slot: float = 8.0) -> DataFrame:
    """points with the value (and weight) of the last label, by order, whose interval [start, end) holds the point.

    Points without a label are left out. The weight is that of the last covering label with one, else 1. Both sides are
    dealt by key and time slot, so one key with most labels is spread over tasks; each point is in one slot, and a label
    in those that it touches. Points that are alike stay apart.
    """
    ids = id_columns or points.columns
    points = points.withColumn("_point", F.monotonically_increasing_id())
    spread = labels.select(F.col(key), F.col(start).alias("_s"), F.col(end).alias("_e"), F.col(order).alias("_o"), F.col(value).alias("_v"),
                           (F.col(weight) if weight else F.lit(None)).cast("double").alias("_w")).filter("_e > _s")
    spread = spread.withColumn("_slot", F.explode(F.sequence(F.floor(F.col("_s") / slot), F.floor(F.col("_e") / slot))))
    found = points.withColumn("_slot", F.floor(F.col(at) / slot)).join(spread, [key, "_slot"])
    found = found.filter((F.col(at) >= F.col("_s")) & (F.col(at) < F.col("_e")))
    last_weight = F.max_by("_w", F.when(F.col("_w").isNotNull(), F.col("_o")))
    best = found.groupBy(*ids, "_point").agg(F.max_by("_v", "_o").alias(value), F.coalesce(last_weight, F.lit(1.0)).alias("weight"))
    return best.drop("_point")


def inside_or_all(df: DataFrame, keys: list[str], inside: Column) -> DataFrame:
    """The rows that are inside; for a group without any, all its rows."""
    groups = df.groupBy(*keys).agg(F.max(F.coalesce(inside, F.lit(False)).cast("int")).alias("_any"))
    return df.withColumn("_in", F.coalesce(inside, F.lit(False))).join(groups, keys).filter(F.col("_in") | (F.col("_any") == 0)).drop("_in", "_any")


def with_default(df: DataFrame, dimension: DataFrame, key: str, value: str, default: object) -> DataFrame:
    """df with the dimension's value for its key, or the default. The dimension has one row a key."""
    return df.join(dimension.select(key, value), key, "left").withColumn(value, F.coalesce(value, F.lit(default)))


def members(df: DataFrame, keys: DataFrame, on: str) -> DataFrame:
    return df.join(keys.select(on), on, "left_semi")


def non_members(df: DataFrame, keys: DataFrame, on: str) -> DataFrame:
    """Rows whose key is not listed; a NULL key is in no list."""
    return df.join(keys.select(on), on, "left_anti")


def priority_match(left: DataFrame, right: DataFrame, on: Column, tier: Column, keys: list[str], order: list[str]) -> DataFrame:
    """For each left row the right row of the smallest tier that matches (NULL tier: no match), then the first in
    order. on should hold an equality, so that candidates meet by key."""
    found = left.join(right, on).withColumn("tier", tier).filter("tier IS NOT NULL")
    best = F.min(F.struct("tier", *order))
    return found.groupBy(*keys).agg(best.alias("_b")).select(*keys, "_b.*")


def first_given(tables: list[DataFrame], key: str) -> DataFrame:
    """The union of tables with one row a key: that of the first table that has it."""
    out = tables[0].withColumn("_t", F.lit(0))
    for i, t in enumerate(tables[1:], 1):
        out = out.unionByName(t.withColumn("_t", F.lit(i)), allowMissingColumns=True)
    columns = [c for c in out.columns if c not in (key, "_t")]
    return out.groupBy(key).agg(F.min_by(F.struct(*columns), F.struct("_t", *columns)).alias("_r")).select(key, "_r.*")


def last_file(df: DataFrame, key: str, path: str) -> DataFrame:
    """The greatest path of each key."""
    return df.groupBy(key).agg(F.max(path).alias(path))


def prefix_match(left: DataFrame, right: DataFrame, stem: str, path: str, key_length: int = 4) -> DataFrame:
    """Each left row with the smallest path that begins with its stem; rows without one are left out. Both sides meet by
    their first key_length characters, so that not all pairs are tried; a shorter stem meets the smallest path of each
    beginning of its length. Key columns shared by most paths cost time, not rows."""
    size = F.least(F.length(stem), F.lit(key_length))
    keyed = left.withColumns({"_n": size, "_k": F.expr(f"left(`{stem}`, {key_length})")})
    paths = right.select(F.col(path).alias("_path")).distinct()
    # A stem shorter than the key needs one path for each beginning of its length.
    short = paths.withColumn("_n", F.explode(F.sequence(F.lit(0), F.lit(key_length - 1)))).filter(F.col("_n") <= F.length("_path"))
    short = short.withColumn("_k", F.expr("left(_path, _n)")).groupBy("_n", "_k").agg(F.min("_path").alias("_path"))
    long = paths.filter(F.length("_path") >= key_length).select(F.lit(key_length).alias("_n"), F.expr(f"left(_path, {key_length})").alias("_k"), "_path")
    found = keyed.join(short.unionByName(long), ["_n", "_k"]).filter(F.col("_path").startswith(F.col(stem)))
    return found.groupBy(*left.columns).agg(F.min("_path").alias(path))


def match_videos(rows: DataFrame, videos: DataFrame, manual: DataFrame | None = None, participant: str = "participant", stem: str = "raw_stem", path: str = "path") -> DataFrame:
    """rows with video and tier: of the first tier that has one, the smallest path; both NULL without a match.

    0: the manual map (participant, video_path). Then side views that are neither rear nor top: 1, the name in the stem is
    in the file's name; 2, the file's name has P and the stem's number (or the participant's), with further zeros before
    it; 3, the file's name begins with that number. Rows and files meet by names and numbers, not in all pairs: a file is
    listed by each part of its words, at most a square of its name's length.
    """
    from posemill.functions.scalars import file_name, name_token

    number = F.regexp_extract(F.col(stem), r"[Pp](\d+)", 1)
    number = F.when(number != "", number).otherwise(F.regexp_extract(F.col(participant), r"[Pp](\d+)", 1))
    bare = lambda digits: F.regexp_replace(digits, r"^0+(?=\d)", "")
    # A match depends on participant and stem alone.
    row = F.to_json(F.struct(F.col(participant).alias("p"), F.col(stem).alias("s")))
    asked = rows.select(participant, stem).distinct().withColumns({"_row": row, "_name": name_token(F.col(stem)), "_number": F.when(number != "", number)})
    files = videos.select(F.col(path).alias("_path"), F.lower(file_name(F.col(path))).alias("_base"))
    files = files.filter(F.col("_base").contains("side") & ~F.col("_base").contains("rear") & ~F.col("_base").contains("top"))
    words = files.withColumn("_w", F.explode(F.expr(r"regexp_extract_all(_base, '([a-z]{3,})', 1)")))
    parts = F.expr("flatten(transform(sequence(1, length(_w) - 2), i -> transform(sequence(3, length(_w) - i + 1), n -> substring(_w, i, n))))")
    by_name = words.select("_path", F.explode(F.array_distinct(parts)).alias("_name")).groupBy("_name").agg(F.min("_path").alias("video"))
    tagged = files.select("_path", F.explode(F.expr(r"regexp_extract_all(_base, 'p(\\d+)(?![a-z0-9_])', 1)")).alias("_digits"))
    tagged = tagged.select("_path", bare(F.col("_digits")).alias("_key"), F.length("_digits").alias("_long"))
    leading = files.select("_path", F.regexp_extract("_base", r"^(\d+)(?![a-z0-9_])", 1).alias("_digits")).filter("_digits <> ''")
    leading = leading.groupBy(bare(F.col("_digits")).alias("_key")).agg(F.min("_path").alias("video"))
    key = bare(F.col("_number"))
    one = asked.join(by_name, "_name").select("_row", F.lit(1).alias("tier"), "video")
    two = asked.join(tagged, (key == F.col("_key")) & (F.col("_long") >= F.length("_number"))).select("_row", F.lit(2).alias("tier"), F.col("_path").alias("video"))
    three = asked.join(leading, key == F.col("_key")).select("_row", F.lit(3).alias("tier"), "video")
    found = one.unionByName(two).unionByName(three)
    if manual is not None:
        given = manual.select(F.col("participant").cast("string").alias("_p"), F.col("video_path").alias("video"))
        found = found.unionByName(asked.join(given, F.col(participant) == F.col("_p")).select("_row", F.lit(0).alias("tier"), "video"))
    best = found.groupBy("_row").agg(F.min(F.struct("tier", "video")).alias("_b")).select("_row", "_b.*")
    return rows.withColumn("_row", row).join(best, "_row", "left").select(*rows.columns, "video", "tier")


def overlapping(start: Column, end: Column, low: float, high: float) -> Column:
    """Whether [start, end) and (low, high) have more than an end in common."""
    return (start < high) & (end > low)


def thirds(start: Column, end: Column, step: float = 10.0) -> Column:
    """array of struct(part, start, end): two stretches of `step` and the rest of a rated window."""
    parts = [(0, start, start + step), (1, start + step, start + 2 * step), (2, start + 2 * step, end)]
    return F.array(*[F.struct(F.lit(i).alias("part"), a.cast("double").alias("start"), b.cast("double").alias("end")) for i, a, b in parts])
