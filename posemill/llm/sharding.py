"""Sharding on a consistent-hash ring with virtual nodes and bounded loads (DataFrame functions only).

Every shard owns many points of a ring; a row lies where its key's hash falls and belongs to the next point clockwise.
A shard takes rows up to its capacity; what overflows continues clockwise to the next shard with room. All rows of one
arc (the stretch before a point) meet the same shards in the same order, so the walk needs only the row count of each
arc: it runs over that bounded table, and yields for each arc the ranks that go to each shard. Ranks inside an arc follow
the hash of the key, so which rows overflow depends on the keys alone; only rows with equal keys are told apart by their
row numbers. They come from running sums of counts, by bucket and then by key and part of its rows, so no task sorts more
than a bucket's keys or a part's rows.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from posemill.llm.common import written

#: The ring's cells: each virtual node stands in a cell of its own.
CELLS = 1 << 14
#: Keys in a bucket, about, and the parts that the rows of one key are dealt to.
BUCKET_ROWS, KEY_PARTS = 512, 4096


def _hash(*parts: object) -> int:
    return int.from_bytes(hashlib.blake2b(":".join(map(str, parts)).encode(), digest_size=8).digest(), "big")


def ring(shards: int, virtual_nodes: int) -> list[tuple[int, int]]:
    """(cell, shard) of every virtual node, clockwise. A shard's points don't depend on how many shards there are, save
    for the rare point whose cell is taken by a lower shard, which moves to the next free cell."""
    if shards * virtual_nodes > CELLS // 2:
        raise ValueError(f"a ring of {CELLS} cells holds {CELLS // 2} virtual nodes at most")
    taken: dict[int, int] = {}
    for shard in range(shards):
        for node in range(virtual_nodes):
            cell = _hash("node", shard, node) % CELLS
            while cell in taken:
                cell = (cell + 1) % CELLS
            taken[cell] = shard
    return sorted(taken.items())


def arcs_by_cell(points: list[tuple[int, int]]) -> list[int]:
    """For every cell the index of the point that owns it: the first at or after it, clockwise."""
    cells = [cell for cell, _ in points]
    return [bisect_left(cells, cell) % len(points) for cell in range(CELLS)]


def capacities(rows: int, shards: int, slack: float) -> list[int]:
    """Slack 0: counts at most one apart. Else each shard holds up to (1 + slack) times the mean, rounded up."""
    if not slack:
        return [rows // shards + (shard < rows % shards) for shard in range(shards)]
    return [-int(-rows * (1 + slack) // shards)] * shards


def walk(points: list[tuple[int, int]], counts: list[int], room: list[int]) -> list[tuple[int, int, int, int, int]]:
    """(arc, first rank, last rank + 1, shard, slot of the first rank). counts: rows of each arc."""
    free, used, out = list(room), [0] * len(room), []
    placed, at = [0] * len(points), list(range(len(points)))
    waiting = [arc for arc, n in enumerate(counts) if n]
    while waiting:
        still = []
        for arc in waiting:
            shard = points[at[arc]][1]
            if take := min(counts[arc] - placed[arc], free[shard]):
                out.append((arc, placed[arc], placed[arc] + take, shard, used[shard]))
                placed[arc] += take
                free[shard] -= take
                used[shard] += take
            if placed[arc] < counts[arc]:
                at[arc] = (at[arc] + 1) % len(points)
                still.append(arc)
        waiting = still
    return out


def assign_shards(docs: DataFrame, key: str | Column, shards: int, virtual_nodes: int = 64, slack: float = 0.05,
                  seed: int = 7) -> DataFrame:
    """docs with shard int (0 to shards - 1) and slot long (gapless from 0 in each shard).

    With slack 0 the shards' row counts are at most one apart; with more, fewer rows overflow and a changed number of
    shards moves fewer rows. Rows with equal keys share an arc, and are split by capacity like any others, so a key
    with a third of all rows overflows evenly. A null key is a key of its own. Repeated rows are placed one by one. An
    empty table gives an empty table. Other columns pass through; columns named shard or slot are replaced. The same keys
    in other files go to the same shards; slots may differ among rows with equal keys. Row numbers are fixed by one
    written table, so a rerun after a lost executor places rows as before.
    """
    spark = docs.sparkSession
    place = F.xxhash64(F.col(key) if isinstance(key, str) else key, F.lit(seed))
    rows = docs.drop("shard", "slot")
    names = rows.columns
    points = ring(shards, virtual_nodes)
    cells = F.split(F.lit(",".join(map(str, arcs_by_cell(points)))), ",").cast("array<int>")
    number = F.monotonically_increasing_id()
    packed = rows.select(
        F.struct(*[F.col(f"`{n}`") for n in names]).alias("row"),
        F.get(cells, F.pmod(place, F.lit(CELLS)).cast("int")).alias("arc"), place.alias("place"), number.alias("number"),
    )
    # Rows of one key are dealt to parts by number; a key of one row is one part.
    kept = written(packed.withColumn("part", F.pmod(F.xxhash64("number"), F.lit(KEY_PARTS)).cast("int")), "ring-rows")
    total = kept.count()
    fine = max(1, -(-total // (BUCKET_ROWS * len(points))))
    bucket = F.pmod(F.xxhash64("place"), F.lit(fine))
    parts = written(kept.groupBy("arc", "place", "part").agg(F.count(F.lit(1)).alias("n")).withColumn("bucket", bucket), "ring-keys")
    # One row for each bucket: its rank among the arc's buckets is a running sum of counts; then that of a part in its bucket.
    buckets = parts.groupBy("arc", "bucket").agg(F.sum("n").alias("n"))
    before = W.partitionBy("arc").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    buckets = written(buckets.select("arc", "bucket", "n", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base")), "ring-buckets")
    inside = W.partitionBy("arc", "bucket").orderBy("place", "part").rowsBetween(W.unboundedPreceding, -1)
    bases = parts.join(buckets.select("arc", "bucket", "base"), ["arc", "bucket"]).select(
        "place", "part", (F.col("base") + F.coalesce(F.sum("n").over(inside), F.lit(0))).alias("base"))
    counts = [0] * len(points)
    for arc, n in buckets.groupBy("arc").agg(F.sum("n")).collect():  # as many rows as the ring has points at most
        counts[arc] = n
    runs = walk(points, counts, capacities(total, shards, slack))
    # As many rows as points times shards at most: bounded by the ring, whatever the input.
    runs_df = spark.sql("SELECT inline(from_json('" + str([
        {"run_arc": a, "low": lo, "high": hi, "shard": s, "first_slot": f} for a, lo, hi, s, f in runs
    ]).replace("'", '"') + "', 'array<struct<run_arc int, low bigint, high bigint, shard int, first_slot bigint>>'))")
    ranked = kept.join(bases, ["place", "part"]).withColumn(
        "rank", F.col("base") + F.row_number().over(W.partitionBy("place", "part").orderBy("number")) - 1
    )
    placed = ranked.join(F.broadcast(runs_df), (F.col("arc") == F.col("run_arc")) & (F.col("rank") >= F.col("low")) & (F.col("rank") < F.col("high")))
    return placed.select("row.*", "shard", (F.col("first_slot") + F.col("rank") - F.col("low")).alias("slot"))
