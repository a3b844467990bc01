"""Line dedup with levelled sorted runs of line hashes (DataFrame functions only).

Batches of documents arrive in ascending doc_id. The keys seen so far live in runs: tables of line hashes, bucketed by
hash and sorted within buckets, all into the same number of buckets. A batch is anti-joined with every run; what is new
becomes a run of level 0. When a level holds `fanout` runs they are merged into one run of the next level, so n batches
leave O(log n) runs and every hash is rewritten O(log n) times. As runs lie as joins need them, a batch's own keys are
exchanged once, and no run is exchanged or sorted again when it is read.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from posemill.llm.common import LAST_ID, delete, let, new_path, shuffle_partitions, written

#: Fixed values of the key: what is stripped at both ends, and the letters that are folded.
BLANKS = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
MIN_KEY_CHARS = 10
HASH = ["h1", "h2"]


def bare_line(line: Column) -> Column:
    """The line with blanks stripped at both ends. Most have none there, and two looks at bytes cost less than a strip."""
    edge = F.lit(False)
    for blank in BLANKS:
        edge = edge | F.startswith(line, F.lit(blank)) | F.endswith(line, F.lit(blank))
    return F.when(edge, F.btrim(line, F.lit(BLANKS))).otherwise(line)


def folded(bare: Column) -> Column:
    """A-Z (no other letters) in lower case."""
    return F.when(F.octet_length(bare) == F.char_length(bare), F.lower(bare)).otherwise(F.translate(bare, UPPER, LOWER))


def text_lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n")


#: With it Spark trusts the order of a bucket that is one file. Runs are written so.
SORTED_SCANS = "spark.sql.legacy.bucketedTableScan.outputOrdering"


@contextmanager
def sorted_scans(spark: SparkSession) -> Iterator[None]:
    before = spark.conf.get(SORTED_SCANS, None)
    spark.conf.set(SORTED_SCANS, "true")
    try:
        yield
    finally:
        spark.conf.set(SORTED_SCANS, before) if before is not None else spark.conf.unset(SORTED_SCANS)


class LineRuns:
    """The state of the levelled runs: levels[i] is the list of runs of level i, each the path of a table (h1 long, h2
    int, owner long) in `buckets` buckets, the session's shuffle partitions if not given."""

    def __init__(self, spark: SparkSession, fanout: int = 2, buckets: int | None = None):
        self.spark, self.fanout = spark, fanout
        self.buckets = buckets or shuffle_partitions(spark)
        self.levels: list[list[str]] = []
        self.names: dict[str, str] = {}

    def runs(self) -> list[str]:
        return [run for level in self.levels for run in level]

    def read(self, run: str) -> DataFrame:
        return self.spark.table(self.names[run])

    def unseen(self, keys: DataFrame) -> DataFrame:
        """The rows of keys (h1, h2, ...) whose hash is in no run."""
        for run in self.runs():
            keys = keys.join(self.read(run).select(*HASH).hint("merge"), HASH, "left_anti")
        return keys

    def write(self, keys: DataFrame, dealt: bool = False) -> str:
        """keys (h1, h2, owner) as a run, not yet one of the state. dealt: they come from an aggregate or a join by hash,
        and so already lie in as many partitions as the session's shuffles make."""
        path, name = new_path(self.spark, "line-run"), f"line_run_{uuid.uuid4().hex}"
        keys = keys.select(*HASH, "owner")
        # A bucket comes from one task, so it is one file.
        if not dealt or shuffle_partitions(self.spark) != self.buckets:
            keys = keys.repartition(self.buckets, *HASH)
        keys.write.format("parquet").option("path", path).bucketBy(self.buckets, *HASH).sortBy(*HASH).saveAsTable(name)
        self.names[path] = name
        return path

    def add(self, run: str) -> None:
        """A written run whose hashes are in no other run joins level 0; full levels are compacted."""
        level = 0
        while True:
            if len(self.levels) <= level:
                self.levels.append([])
            self.levels[level].append(run)
            if len(self.levels[level]) < self.fanout:
                return
            merged_away, self.levels[level] = self.levels[level], []
            run = self.write(self._merged(merged_away), dealt=True)
            for old in merged_away:
                self.drop(old)
            level += 1

    def _merged(self, runs: list[str]) -> DataFrame:
        """A merge of sorted runs that have no hash in common."""
        out = self.read(runs[0])
        for run in runs[1:]:
            other = self.read(run).withColumnRenamed("owner", "_owner")
            out = out.join(other.hint("merge"), HASH, "full_outer").select(*HASH, F.coalesce("owner", "_owner").alias("owner"))
        return out

    def drop(self, run: str) -> None:
        self.spark.sql(f"DROP TABLE {self.names.pop(run)}")
        delete(self.spark, run)

    def save(self, path: str) -> None:
        """What open() needs, as one line of JSON at path. The runs stay where they are."""
        told = json.dumps({"fanout": self.fanout, "buckets": self.buckets, "levels": self.levels})
        self.spark.createDataFrame([(told,)], "value string").coalesce(1).write.mode("overwrite").text(path)

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> LineRuns:
        told = json.loads(spark.read.text(path).first()[0])
        state = cls(spark, told["fanout"], told["buckets"])
        state.levels = told["levels"]
        for run in state.runs():
            name = f"line_run_{uuid.uuid4().hex}"
            spark.sql(f"CREATE TABLE {name} (h1 BIGINT, h2 INT, owner BIGINT) USING parquet CLUSTERED BY (h1, h2) SORTED BY (h1, h2) INTO {state.buckets} BUCKETS LOCATION '{run}'")
            state.names[run] = name
        return state


def keyed_lines(docs: DataFrame) -> DataFrame:
    """owner, text_hash, pos, h1, h2: the lines of docs whose key is long enough to count."""
    # Hashed and split below the explode: beside it, the whole text would go along and be hashed for each of its lines. A
    # text has at least one line, so the outer form adds no row; the inner one would split again to filter.
    held = docs.select(F.coalesce("doc_id", F.lit(LAST_ID)).alias("owner"), F.xxhash64("text").alias("text_hash"), text_lines(F.col("text")).alias("lines"))
    rows = held.select("owner", "text_hash", F.posexplode_outer("lines").alias("pos", "line"))
    rows = rows.filter(F.octet_length("line") >= MIN_KEY_CHARS).select("owner", "text_hash", "pos", bare_line(F.col("line")).alias("bare"))
    key = folded(F.col("bare"))  # as many characters as the bare line
    return rows.filter(F.char_length("bare") >= MIN_KEY_CHARS).select("owner", "text_hash", "pos", F.xxhash64(key).alias("h1"), F.hash(key).alias("h2"))


def batch_drops(docs: DataFrame, state: LineRuns, last: bool = False) -> DataFrame:
    """owner, text_hash, drops (sorted line numbers) for the documents of one batch that lose lines; state takes the
    batch's new keys, unless the batch is the last. Every doc_id of the batch must be above those of earlier batches (or
    the same batch)."""
    lines = keyed_lines(docs)
    with sorted_scans(state.spark):
        # Pre-aggregated before its shuffle, so a line found in a third of all documents is one row from each task.
        run = state.write(state.unseen(lines.groupBy(*HASH).agg(F.min("owner").alias("owner"))), dealt=True)
        # The join key holds the owner, so a hot line's rows are spread over all tasks.
        gone = lines.join(state.read(run), [*HASH, "owner"], "left_anti")
        drops = written(gone.groupBy("owner", "text_hash").agg(F.array_sort(F.collect_set("pos")).alias("drops")), "line-drops")
        state.drop(run) if last else state.add(run)
    return drops


def without_lines(lines: Column, drops: Column) -> Column:
    """lines without the elements at the ascending places in drops, in time linear in both."""
    cut = F.concat(F.array(F.lit(-1)), drops, F.array(F.size(lines)))
    return let(cut, lambda c: F.flatten(F.transform(F.sequence(F.lit(0), F.size(c) - 2), lambda j: F.slice(
        lines, F.get(c, j) + 2, F.get(c, j + 1) - F.get(c, j) - 1))))


def dedup_lines(docs: DataFrame, batches: int = 4, fanout: int = 2) -> DataFrame:
    """Every row of docs with n_lines, n_dropped and kept_text added.

    A key of at least 10 code points that two or more documents hold stays only in the smallest doc_id holding it, with
    all its lines there; shorter keys and keys of one document stay. Null or empty text is one empty line. Rows that
    repeat a doc_id count as the same document; a null doc_id sorts last and all such rows count as one document. An
    empty table gives an empty table. Other columns pass through; those named like the added ones are replaced.
    """
    spark = docs.sparkSession
    docs = docs.drop("n_lines", "n_dropped", "kept_text")
    source = docs.select("doc_id", "text")
    owner = F.coalesce("doc_id", F.lit(LAST_ID))
    at = [i / batches for i in range(1, batches)]
    cuts = source.agg(F.percentile_approx(owner, at, 10_000)).first()[0] if at else []
    edges = [None, *sorted(set(cuts or [])), None]
    state, drops = LineRuns(spark, fanout), None
    for low, high in zip(edges, edges[1:]):
        part, last = source, high is None
        if low is not None:
            part = part.filter(F.col("doc_id").isNull() | (F.col("doc_id") > low) if high is None else F.col("doc_id") > low)
        if high is not None:
            part = part.filter(F.col("doc_id") <= high)
        found = batch_drops(part, state, last)
        drops = found if drops is None else drops.unionByName(found)
    for run in state.runs():
        state.drop(run)
    taken = set(docs.columns)
    own, text_hash, gone = (next(n for n in (x, *(f"{x}_{i}" for i in range(99))) if n not in taken) for x in ("line_owner", "line_text_hash", "line_drops"))
    drops = drops.toDF(own, text_hash, gone)
    joined = docs.withColumns({own: owner, text_hash: F.xxhash64("text")}).join(drops, [own, text_hash], "left")
    joined = joined.withColumn(gone, F.coalesce(gone, F.array().cast("array<int>")))
    lines = text_lines(F.col("text"))
    kept = F.when(F.size(gone) == 0, F.coalesce("text", F.lit(""))).otherwise(
        F.array_join(let(lines, lambda all_lines: without_lines(all_lines, F.col(gone))), "\n"))
    return joined.withColumns({
        "n_lines": F.size(lines).cast("long"), "n_dropped": F.size(gone).cast("long"), "kept_text": kept,
    }).drop(own, text_hash, gone)
