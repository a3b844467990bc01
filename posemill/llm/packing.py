"""Best-fit packing of tokenized documents into sequences, improved by swap-based local search.

Only documents longer than a sequence are cut. Pieces are dealt into chunks of bounded size; each chunk is packed by
best fit in descending length, then pieces move or are exchanged between underfull bins, always raising the sum of
squared fills, until the emptiest bins dissolve. What lies in the chunks' poorly filled bins is packed once more across
chunks, so the loss does not add up over them.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from posemill.llm.common import shuffle_partitions, written
from posemill.llm.tokens import WordEncoder

CHUNK_PIECES = 8192
SEPARATOR = 1


def tokenized_pieces(docs: DataFrame, tokenizer_path: str, capacity: int, separator: int = SEPARATOR) -> DataFrame:
    """doc_id, piece int, start long, length long, ids_crc32 long: each text's ids and the separator, cut into pieces
    of capacity ids if longer. Null text is empty: the separator alone. Repeated rows give repeated pieces."""
    end = np.array([separator], "<u4").tobytes()
    step = 4 * capacity

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = WordEncoder(tokenizer_path)
        for whole in batches:
            for low in range(0, whole.num_rows, 500):
                batch = whole.slice(low, 500)
                out: list[list] = [[], [], [], [], []]
                for doc_id, ids in zip(batch.column("doc_id").to_pylist(), encoder.encode(batch.column("text").to_pylist())):
                    ids += end
                    for piece, at in enumerate(range(0, len(ids), step)):
                        part = ids[at:at + step]
                        for column, value in zip(out, (doc_id, piece, at // 4, len(part) // 4, zlib.crc32(part))):
                            column.append(value)
                kinds = [batch.schema.field("doc_id").type, pa.int32(), pa.int64(), pa.int64(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out, kinds)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(cut, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long")


class Bins:
    """Bins of one capacity, found by the room left in them."""

    def __init__(self, capacity: int):
        self.capacity = capacity
        self.items: list[list[tuple[int, int]]] = []  # of each bin, ascending (length, item)
        self.fill: list[int] = []
        self.by_room: list[set[int]] = [set() for _ in range(capacity + 1)]
        self.rooms = 0  # bit r is set if a bin has room r

    def room(self, b: int) -> int:
        return self.capacity - self.fill[b]

    def _leave(self, b: int) -> None:
        r = self.room(b)
        self.by_room[r].discard(b)
        if not self.by_room[r]:
            self.rooms &= ~(1 << r)

    def _enter(self, b: int) -> None:
        r = self.room(b)
        self.by_room[r].add(b)
        self.rooms |= 1 << r

    def new(self) -> int:
        self.items.append([])
        self.fill.append(0)
        self._enter(len(self.fill) - 1)
        return len(self.fill) - 1

    def best(self, length: int) -> int | None:
        """The fullest bin with room for length; ties: the oldest."""
        fits = self.rooms >> length
        if not fits:
            return None
        return min(self.by_room[length + (fits & -fits).bit_length() - 1])

    def put(self, b: int, item: tuple[int, int]) -> None:
        self._leave(b)
        insort(self.items[b], item)
        self.fill[b] += item[0]
        self._enter(b)

    def take(self, b: int, item: tuple[int, int]) -> None:
        self._leave(b)
        self.items[b].remove(item)
        self.fill[b] -= item[0]
        self._enter(b)

    def close(self, b: int) -> None:
        """An empty bin takes no more part."""
        self._leave(b)


def best_fit(lengths: list[int], capacity: int) -> Bins:
    bins = Bins(capacity)
    for i in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        b = bins.best(lengths[i])
        bins.put(bins.new() if b is None else b, (lengths[i], i))
    return bins


def _exchange(bins: Bins, a: int, others: list[int]) -> bool:
    """One step that carries fill from bin a into a bin at least as full: a move, one for one, two for one or one for
    two. Each raises the sum of squared fills. False if there is none."""
    own = bins.items[a]
    for item in reversed(own):
        bins._leave(a)  # not into itself
        b = bins.best(item[0])
        bins._enter(a)
        if b is not None and bins.fill[b] + item[0] > bins.fill[a]:
            bins.take(a, item)
            bins.put(b, item)
            return True
    for b in others:
        room, theirs = bins.room(b), bins.items[b]
        if b == a or not room or bins.fill[b] < bins.fill[a]:
            continue
        pairs = [(own[i], own[j]) for i in range(len(own)) for j in range(i)]
        for out in [(x,) for x in own] + pairs:
            total = sum(x[0] for x in out)
            # The largest gain for b: the smallest of its items that leaves room for what comes.
            k = bisect_left(theirs, (total - room, -1))
            if k < len(theirs) and theirs[k][0] < total:
                _swap(bins, a, out, b, (theirs[k],))
                return True
        for item in own:  # one for two
            low, high = 0, len(theirs) - 1
            while low < high:
                both = theirs[low][0] + theirs[high][0]
                if both >= item[0]:
                    high -= 1
                elif both < item[0] - room:
                    low += 1
                else:
                    _swap(bins, a, (item,), b, (theirs[low], theirs[high]))
                    return True
    return False


def _swap(bins: Bins, a: int, out: tuple, b: int, back: tuple) -> None:
    for item in back:
        bins.take(b, item)
    for item in out:
        bins.take(a, item)
        bins.put(b, item)
    for item in back:
        bins.put(a, item)


def local_search(bins: Bins) -> None:
    """Empties the least filled bins, one after another, as long as there are more bins than the lengths need."""
    live = {b for b, f in enumerate(bins.fill) if f}
    halves = sum(2 * length > bins.capacity for items in bins.items for length, _ in items)  # no two share a bin
    least = max(-(-sum(bins.fill) // bins.capacity), halves)
    for a in sorted(live, key=lambda b: (bins.fill[b], b)):
        if len(live) <= least:
            return
        while bins.fill[a]:
            others = sorted((b for b in live if b != a and bins.room(b)), key=lambda b: (-bins.fill[b], b))
            if not _exchange(bins, a, others):
                break
        if not bins.fill[a]:
            live.discard(a)
            bins.close(a)


def pack_chunk(lengths: list[int], capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each piece its bin, its offset there and the bin's fill. Bins are numbered from 0 without gaps."""
    bins = best_fit(lengths, capacity)
    local_search(bins)
    where, offset, fill = (np.zeros(len(lengths), np.int64) for _ in range(3))
    number = 0
    for items, full in zip(bins.items, bins.fill):
        at = 0
        for length, i in items:
            where[i], offset[i], fill[i] = number, at, full
            at += length
        number += bool(items)
    return where, offset, fill


def pack(pieces: DataFrame, capacity: int, chunk_pieces: int = CHUNK_PIECES, refill: float = 0.97) -> DataFrame:
    """pieces (with length long, 1 to capacity) with sequence_id long and offset long added.

    Chunks are dealt by row number, so repeated rows, equal lengths or one doc_id with most pieces spread evenly; a
    chunk holds about chunk_pieces rows at every input size. Pieces in bins filled below refill are packed again
    across chunks. A null length counts as 0 and takes no room; the tables in between are written, so a rerun after a
    lost executor finds the same chunks. An empty table gives an empty table. Other columns pass through.
    """
    rows = pieces.drop("sequence_id", "offset")
    names = rows.columns
    numbered = written(rows.select(F.struct(*[F.col(f"`{n}`") for n in names]).alias("row"), F.coalesce("length", F.lit(0)).cast("long").alias("size"),
                                   F.monotonically_increasing_id().alias("number")), "pack-pieces")
    first = _pack_level(numbered, capacity, chunk_pieces, 0)
    packed = written(first, "pack-bins")
    poor = F.col("fill") < F.lit(int(refill * capacity))
    chunks = -(-numbered.count() // chunk_pieces)
    second = _pack_level(packed.filter(poor).select("row", "size", "number"), capacity, chunk_pieces, chunks)
    done = packed.filter(~poor).unionByName(second)
    return done.select("row.*", "sequence_id", "offset")


def _pack_level(rows: DataFrame, capacity: int, chunk_pieces: int, first_chunk: int) -> DataFrame:
    chunks = max(1, -(-rows.count() // chunk_pieces))
    dealt = rows.withColumn("chunk", F.pmod(F.xxhash64("number"), F.lit(chunks)) + F.lit(first_chunk))

    def fill(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("number", ignore_index=True)
        where, offset, full = pack_chunk(group["size"].tolist(), capacity)
        return pd.DataFrame({"number": group["number"], "sequence_id": group["chunk"].to_numpy() * (1 << 24) + where, "offset": offset, "fill": full})

    # Dealt to tasks by chunk: by bytes, as rows without their texts are small, Spark would give all chunks to few tasks.
    tasks = min(chunks, max(shuffle_partitions(rows.sparkSession), 1000))
    placed = dealt.select("chunk", "number", "size").repartition(tasks, "chunk").groupBy("chunk").applyInPandas(fill, "number long, sequence_id long, offset long, fill long")
    return rows.join(placed, "number").select("row", "size", "number", "sequence_id", "offset", "fill")
