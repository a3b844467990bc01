"""N-gram Jaccard join with prefix filters under several global token orders.

Tokens are hashes of 5-word shingles. Two sets whose Jaccard similarity reaches the threshold share a token among the
first n - ceil(threshold * n) + 1 of each, under any order of all tokens. The orders used here put rare tokens first, by
document frequency or its magnitude, with different hashes breaking ties; a pair is a candidate only if the filters of
all orders let it pass, and is then verified on the whole sets.

What keeps the work in proportion to the input:
- Equal sets are one class, and only classes are compared.
- A set with too many tokens that no other set has links with nothing. Frequencies are counted on packed, bucketed
  blocks of tokens, each task sending a token once, and only 3 of 8 tokens are counted in this first pass.
- A token shared by many classes makes a star around its most typical class, not all pairs. The pairs that remain, in
  different components after the stars are verified, are found by a self-join whose key holds both classes of size that
  the places of the token in both prefixes allow, so a token late in a prefix meets few sets or none. Of what is left,
  sizes, unique tokens and token bitmaps let pass what is verified; no pair within a component is made.

All filters are necessary conditions, so no link between different components is lost.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from posemill.llm.common import discard, written
from posemill.llm.components import components
from posemill.llm.wordhash import mixed, shingle_set

WORDS, PERCENT = 5, 75
#: Tokens in a block of packed tokens: a block is sorted in memory.
BLOCK_TOKENS = 1_000_000
#: Tokens that meet in one bucket: at least, and at most, whatever the input. Between these a bucket grows with the root of
#: the input, so that neither the buckets' sizes nor the pieces that each block is cut into get out of hand.
BUCKET_TOKENS = (250_000, 8_000_000)
#: A set is in one of this many classes of size for each step by the threshold's ratio.
SIZE_STEPS = 4
#: Where more classes hold a token, both sides of the residual join are cut into parts of about so many, each met by all.
TOKEN_ROWS = 2048
#: A table of so many rows at most is broadcast (16 bytes a row); a larger one is shuffled.
BROADCAST_ROWS = 2_000_000
BITMAP_WORDS, SMALL_BITMAP_WORDS = 16, 4
_NO_REF = np.uint32(0xFFFFFFFF)
_SALTS = (np.uint64(0x5851F42D4C957F2D), np.uint64(0x14057B7EF767814F), np.uint64(0xDA942042E4DD58B5))
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def prefix_length(n, percent: int = PERCENT):
    """How many first tokens of a set of n must hold a token of any set it links with."""
    return n - (percent * n + 99) // 100 + 1


def bucket_count(tokens: int) -> int:
    """A power of two: how many buckets so many tokens are dealt to."""
    low, high = BUCKET_TOKENS
    each = min(high, max(low, 20 * math.isqrt(tokens)))
    return 1 << max(6, (-(-tokens // each) - 1).bit_length())


def text_tokens(docs: DataFrame) -> int:
    """About how many tokens the texts have: a sixth of their bytes."""
    return (docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // 6


def _planes(values: np.ndarray) -> bytes:
    """Integers as byte planes, whose empty high planes the shuffle's compression removes."""
    return values.view(np.uint8).reshape(len(values), values.itemsize).T.tobytes()


def _unplaned(data: bytes, kind) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(size, -1).T).view(kind).ravel()


def _by_bucket(tokens: np.ndarray, buckets: int) -> Iterator[tuple[int, slice]]:
    """The stretches of ascending tokens that share their highest bits."""
    shift = np.uint64(64 - (buckets.bit_length() - 1))
    edges = np.searchsorted(tokens, np.arange(1, buckets, dtype=np.uint64) << shift) if buckets > 1 else np.zeros(0, np.int64)
    bounds = [0, *edges.tolist(), len(tokens)]
    for b, (low, high) in enumerate(zip(bounds, bounds[1:])):
        if high > low:
            yield b, slice(low, high)


def _packed(tokens: np.ndarray) -> bytes:
    """Ascending tokens as differences."""
    return _planes(np.diff(tokens, prepend=np.uint64(0)))


def _unpacked(data: bytes) -> np.ndarray:
    return np.cumsum(_unplaned(data, np.uint64), dtype=np.uint64)


def _text_sets(batches: Iterator[pa.RecordBatch], words: int) -> Iterator[tuple[int | None, np.ndarray]]:
    for batch in batches:
        for doc_id, text in zip(batch.column("doc_id"), batch.column("text")):
            data = (text.as_py() or "").encode("utf-8", "surrogatepass").translate(_LOWER)
            yield doc_id.as_py(), shingle_set(data, words)


def _set_key(tokens: np.ndarray) -> tuple[int, int]:
    digest = hashlib.blake2b(tokens.tobytes(), digest_size=16).digest()
    return int.from_bytes(digest[:8], "little", signed=True), int.from_bytes(digest[8:], "little", signed=True)


def _block_id(number: int) -> int:
    return (TaskContext.get().partitionId() << 24) + number


def sized_documents(docs: DataFrame, buckets: int, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """doc_id, n long (size of the set), k1, k2 long (a hash of the set), possible boolean: false where so many of the
    set's tokens are in no other document that it links with nothing. Tokens meet in `buckets`, a power of two."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, sets, held, number = [], [], 0, 0

        def block() -> pa.RecordBatch:
            sampled = [s[(s & np.uint64(7)) < 3] for s in sets]
            size = np.array([len(s) for s in sampled], np.int64)
            tokens = np.concatenate(sampled)
            owner = np.repeat(np.arange(len(size), dtype=np.uint32), size)
            order = np.argsort(tokens, kind="stable")
            tokens, owner = tokens[order], owner[order]
            first = np.ones(len(tokens), bool)
            first[1:] = tokens[1:] != tokens[:-1]
            last = np.ones(len(tokens), bool)
            last[:-1] = first[1:]
            lone = first & last
            here = np.bincount(owner[~lone], minlength=len(size))
            refs = np.where(lone, owner, _NO_REF)[first]
            tokens = tokens[first]
            meta = np.array([[0 if d is None else d, d is None, n, k1, k2] for d, n, k1, k2 in rows], np.int64).reshape(-1, 5)
            meta = np.concatenate((meta, size[:, None], here[:, None]), axis=1)
            block_id = _block_id(number)
            out = [(b, block_id, _packed(tokens[at]), _planes(refs[at]), None) for b, at in _by_bucket(tokens, buckets)]
            # What is known of the documents passes through a bucket of its own block, spread over all of them.
            out.append(((TaskContext.get().partitionId() + 7919 * number) % buckets, block_id, None, None, meta.tobytes()))
            return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*out), (pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.binary()))],
                                              ["bucket", "block", "tokens", "refs", "meta"])

        for doc_id, found in _text_sets(batches, words):
            rows.append((doc_id, len(found), *_set_key(found)))
            sets.append(found)
            held += len(found)
            if held >= 2 * BLOCK_TOKENS:
                yield block()
                rows, sets, held, number = [], [], 0, number + 1
        if rows:
            yield block()

    def meet(group: pd.DataFrame) -> pd.DataFrame:
        """Tokens of one bucket from all blocks: each block hears how many shared tokens its documents have."""
        passed = group.loc[group["meta"].notna(), ["block", "meta"]]
        held = group.loc[group["tokens"].notna()]
        out = [pd.DataFrame({"block": passed["block"], "refs": None, "counts": None, "meta": passed["meta"]})]
        if len(held):
            parts = [_unpacked(t) for t in held["tokens"]]
            refs = np.concatenate([_unplaned(r, np.uint32) for r in held["refs"]])
            source = np.repeat(np.arange(len(parts)), [len(p) for p in parts])
            tokens = np.concatenate(parts)
            order = np.argsort(tokens, kind="stable")
            ordered = tokens[order]
            same = np.zeros(len(order), bool)
            same[1:] = ordered[1:] == ordered[:-1]
            shared = same.copy()
            shared[:-1] |= same[1:]
            hit = np.zeros(len(order), bool)
            hit[order] = shared
            hit &= refs != _NO_REF
            where = (source[hit].astype(np.uint64) << np.uint64(32)) | refs[hit].astype(np.uint64)
            where, counts = np.unique(where, return_counts=True)
            of = (where >> np.uint64(32)).astype(np.int64)
            blocks = held["block"].to_numpy()
            edges = np.searchsorted(of, np.arange(len(parts) + 1))
            answers = [(blocks[i], _planes((where[a:b] & np.uint64(0xFFFFFFFF)).astype(np.uint32)), _planes(counts[a:b].astype(np.uint32)))
                       for i, (a, b) in enumerate(zip(edges, edges[1:])) if b > a]
            if answers:
                block, ref, count = zip(*answers)
                out.append(pd.DataFrame({"block": block, "refs": ref, "counts": count, "meta": None}))
        return pd.concat(out, ignore_index=True)

    def decide(group: pd.DataFrame) -> pd.DataFrame:
        meta = np.frombuffer(group["meta"].dropna().iloc[0], np.int64).reshape(-1, 7)
        shared = meta[:, 6].copy()
        for refs, counts in zip(group["refs"].dropna(), group["counts"].dropna()):
            shared[_unplaned(refs, np.uint32)] += _unplaned(counts, np.uint32)
        n = meta[:, 2]
        unique = meta[:, 5] - shared
        ids = pd.array([None if none else d for d, none in zip(meta[:, 0].tolist(), meta[:, 1].tolist())], "Int64")
        return pd.DataFrame({"doc_id": ids, "n": n, "k1": meta[:, 3], "k2": meta[:, 4], "possible": (n > 0) & (unique < prefix_length(n, percent))})

    sent = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(scan, "bucket int, block long, tokens binary, refs binary, meta binary")
    answered = sent.groupBy("bucket").applyInPandas(meet, "block long, refs binary, counts binary, meta binary")
    return answered.groupBy("block").applyInPandas(decide, "doc_id long, n long, k1 long, k2 long, possible boolean")


def _joined_small(left: DataFrame, right: DataFrame, on: str, how: str = "inner") -> DataFrame:
    """right is a written table: broadcast behind a check of its size, shuffled beyond it."""
    return left.join(F.broadcast(right) if right.count() <= BROADCAST_ROWS else right, on, how)


def packed_sets(docs: DataFrame, ids: DataFrame, words: int = WORDS) -> DataFrame:
    """block, ids, sizes, tokens: the sets of the documents whose doc_id is in ids, many in each row."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, sets, held, number = [], [], 0, 0

        def block() -> pa.RecordBatch:
            row = (_block_id(number), np.array(own, np.int64).tobytes(), np.array([len(s) for s in sets], np.int64).tobytes(), np.concatenate(sets).tobytes())
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, (pa.int64(), pa.binary(), pa.binary(), pa.binary()))],
                                              ["block", "ids", "sizes", "tokens"])

        for doc_id, found in _text_sets(batches, words):
            own.append(doc_id)
            sets.append(found)
            held += len(found)
            if held >= BLOCK_TOKENS // 2:
                yield block()
                own, sets, held, number = [], [], 0, number + 1
        if own:
            yield block()

    rows = _joined_small(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), ids, "doc_id", "left_semi")
    return rows.mapInArrow(scan, "block long, ids binary, sizes binary, tokens binary")


def profiles(blocks: DataFrame, buckets: int, percent: int = PERCENT) -> DataFrame:
    """For each set of blocks that can still link: id, n, u int (tokens of no other set), extra int (shared tokens beyond
    the first in a slot of bits), bits, second, third array<long> (bitmaps of its shared tokens and of its prefixes under
    the second and third order), prefix array<long>, places array<int> (shared tokens of its prefix under the first order
    and where they stand among all its tokens), tokens, second_prefix, third_prefix binary."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, tokens in zip(batch.column("block"), batch.column("tokens")):
                found, counts = np.unique(np.frombuffer(tokens.as_py(), np.uint64), return_counts=True)
                out = [(b, block.as_py(), _packed(found[at]), _planes(counts[at].astype(np.uint32))) for b, at in _by_bucket(found, buckets)]
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*out), (pa.int32(), pa.int64(), pa.binary(), pa.binary()))],
                                                     ["bucket", "block", "tokens", "counts"])

    def total(group: pd.DataFrame) -> pd.DataFrame:
        parts = [_unpacked(t) for t in group["tokens"]]
        _, inverse = np.unique(np.concatenate(parts), return_inverse=True)
        df = np.bincount(inverse, np.concatenate([_unplaned(c, np.uint32) for c in group["counts"]]))[inverse].astype(np.uint32)
        edges = np.cumsum([0, *map(len, parts)])
        return pd.DataFrame({"bucket": group["bucket"], "block": group["block"], "df": [_planes(df[a:b]) for a, b in zip(edges, edges[1:])]})

    def profile(key: tuple, sets: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple] = []
        tokens = np.frombuffer(sets["tokens"].iloc[0], np.uint64)
        sizes = np.frombuffer(sets["sizes"].iloc[0], np.int64)
        ids = np.frombuffer(sets["ids"].iloc[0], np.int64)
        if len(tokens):
            _, inverse = np.unique(tokens, return_inverse=True)
            df = np.concatenate([_unplaned(d, np.uint32) for d in answers.sort_values("bucket")["df"]])[inverse]
        at = 0
        for i, n in zip(ids.tolist(), sizes.tolist()):
            own, freq = tokens[at:at + n], df[at:at + n] if n else np.zeros(0, np.uint32)
            at += n
            u, p = int((freq == 1).sum()), prefix_length(n, percent)
            if not n or u >= p:
                continue
            shared = freq > 1
            ranks = (freq.astype(np.uint64), np.log2(freq).astype(np.uint64), (np.log2(freq) / 2).astype(np.uint64))
            firsts, places = [], None
            for rank, salt in zip(ranks, _SALTS):
                first = np.lexsort((mixed(own ^ salt), rank))[:p]
                places = np.flatnonzero(shared[first]) if places is None else places
                firsts.append(own[first[shared[first]]])
            slots = _slots(own[shared], BITMAP_WORDS)
            out.append((i, n, u, n - u - int(slots.sum()), _words(slots), _words(_slots(firsts[1], SMALL_BITMAP_WORDS)), _words(_slots(firsts[2], SMALL_BITMAP_WORDS)),
                        firsts[0].view(np.int64), places.astype(np.int32), own.tobytes(), firsts[1].tobytes(), firsts[2].tobytes()))
        return pd.DataFrame(out, columns=["id", "n", "u", "extra", "bits", "second", "third", "prefix", "places", "tokens", "second_prefix", "third_prefix"])

    sent = blocks.select("block", "tokens").mapInArrow(send, "bucket int, block long, tokens binary, counts binary")
    answers = sent.groupBy("bucket").applyInPandas(total, "bucket int, block long, df binary")
    return blocks.groupBy("block").cogroup(answers.groupBy("block")).applyInPandas(
        profile, "id long, n int, u int, extra int, bits array<long>, second array<long>, third array<long>, prefix array<long>, places array<int>, tokens binary, "
        "second_prefix binary, third_prefix binary")


def _slots(tokens: np.ndarray, words: int) -> np.ndarray:
    out = np.zeros(words * 64, np.uint8)
    out[(tokens >> np.uint64(17)) & np.uint64(words * 64 - 1)] = 1
    return out


def _words(slots: np.ndarray) -> np.ndarray:
    return np.packbits(slots, bitorder="little").view(np.int64)


def _may_link(a: str, b: str, percent: int = PERCENT) -> Column:
    """Necessary for a link, from two rows of profiles: what sizes, unique tokens and bitmaps allow."""
    def bound(common: Column) -> Column:
        return 100 * common >= percent * (F.col(f"{a}.n") + F.col(f"{b}.n") - common)
    shared = [F.col(f"{x}.n") - F.col(f"{x}.u") for x in (a, b)]
    both = sum((F.bit_count(F.col(f"{a}.bits")[i].bitwiseAND(F.col(f"{b}.bits")[i])) for i in range(BITMAP_WORDS)), F.lit(0))
    # A slot in both bitmaps stands for one common token at most, but for the tokens beyond the first in a slot.
    beyond = F.least(F.col(f"{a}.extra"), F.col(f"{b}.extra"))
    meets = [sum((F.bit_count(F.col(f"{a}.{o}")[i].bitwiseAND(F.col(f"{b}.{o}")[i])) for i in range(SMALL_BITMAP_WORDS)), F.lit(0)) > 0 for o in ("second", "third")]
    return bound(F.least(*shared)) & meets[0] & meets[1] & bound(F.least(both + beyond, *shared))


def verified(pairs: DataFrame, sets: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The pairs (a, b) that link: the prefixes under the second and third order meet, and so many tokens are common.
    pairs is a written table; each set travels once for each pair that it is in, so no key is hot."""
    whole = sets.select("id", "tokens", "second_prefix", "third_prefix")

    def side(name: str) -> DataFrame:
        renamed = whole.select(F.col("id").alias(name), *[F.col(c).alias(f"{name}_{c}") for c in whole.columns[1:]])
        return _joined_small(renamed, pairs, name)

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = []
            columns = [batch.column(f"{x}_{c}") for c in ("second_prefix", "third_prefix", "tokens") for x in ("a", "b")]
            for row in range(batch.num_rows):
                x = [np.frombuffer(c[row].as_py(), np.uint64) for c in columns]
                ok = len(np.intersect1d(x[0], x[1], True)) and len(np.intersect1d(x[2], x[3], True))
                common = len(np.intersect1d(x[4], x[5], True)) if ok else 0
                kept.append(common > 0 and 100 * common >= percent * (len(x[4]) + len(x[5]) - common))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], ["a", "b"]).filter(pa.array(kept, pa.bool_()))

    return side("a").join(side("b"), ["a", "b"]).mapInArrow(check, "a long, b long")


def _allowed(pairs: DataFrame, attributes: DataFrame, percent: int) -> DataFrame:
    x, y = attributes.alias("x"), attributes.alias("y")
    return pairs.join(x, F.col("a") == F.col("x.id")).join(y, F.col("b") == F.col("y.id")).filter(_may_link("x", "y", percent)).select("a", "b")


def _star_pairs(rows: DataFrame, percent: int) -> DataFrame:
    """For each prefix token the pairs of its most typical class (least share of unique tokens) with the others."""
    pivots = rows.groupBy("token").agg(F.min(F.struct("odd", "id", "n")).alias("pivot"), F.count(F.lit(1)).alias("size")).filter("size > 1")
    pairs = rows.join(pivots.select("token", "pivot"), "token").filter(F.col("id") != F.col("pivot.id"))
    pairs = pairs.filter(100 * F.least("n", "pivot.n") >= percent * F.greatest("n", "pivot.n"))
    return pairs.select(F.least("id", "pivot.id").alias("a"), F.greatest("id", "pivot.id").alias("b")).distinct()


def _open_rows(rows: DataFrame, found: DataFrame, percent: int) -> DataFrame:
    """token, id, component, inside, n, rest, own, size: of the prefix tokens that several components hold, what can still
    meet. Of the tokens that the same classes hold (those of one passage, say) the first stands for all. inside: in the
    component of the token's most typical class. rest: the set's tokens from this one on. own: its class of size. size:
    how many classes hold the token."""
    placed = rows.join(found.withColumnRenamed("node", "id"), "id", "left").withColumn("component", F.coalesce("component", "id"))
    of_token = placed.groupBy("token").agg(
        F.min("component").alias("low"), F.max("component").alias("high"), F.min(F.struct("odd", "id", "set", "component", "place")).alias("main"),
        F.count(F.lit(1)).alias("size"), F.bit_xor("set").alias("holders"), F.sum(F.hash("set").cast("long")).alias("more")).filter("low < high")
    chosen = of_token.groupBy("size", "holders", "more").agg(F.min(F.struct("main.place", "token", "main.component")).alias("t"))
    chosen = chosen.select(F.col("t.token").alias("token"), F.col("t.component").alias("main"), "size")
    n = F.col("n").cast("double")
    return placed.join(chosen, "token").select(
        "token", "id", "component", (F.col("component") == F.col("main")).alias("inside"), "n", (F.col("n") - F.col("place")).alias("rest"),
        F.floor(F.log(n) / _size_unit(percent)).cast("int").alias("own"), "size").filter(_largest_partner(percent) >= n * percent / 100 - 1e-6)


def _size_unit(percent: int) -> float:
    return math.log(100 / percent) / SIZE_STEPS


def _largest_partner(percent: int) -> Column:
    """The most tokens that a set can have which first meets this one here, and links."""
    n = F.col("n").cast("double")
    return F.least(n * 100 / percent, F.col("rest") * (100 + percent) / percent - n)


def _partner_classes(percent: int) -> Column:
    first, last = (F.floor(F.log(size) / _size_unit(percent) + margin).cast("int") for size, margin in ((F.col("n") * percent / 100, -1e-9), (_largest_partner(percent), 1e-9)))
    return F.sequence(first, F.greatest(first, last))


def _enough(x: str, y: str, percent: int) -> Column:
    """Whether what two sets have from a token on reaches the common tokens that they need."""
    return (100 + percent) * F.least(f"{x}rest", f"{y}rest").cast("long") >= percent * (F.col(f"{x}n").cast("long") + F.col(f"{y}n"))


def _rest_pairs(opened: DataFrame, percent: int) -> DataFrame:
    """The pairs of different components that share a prefix token at places that allow a link.

    A pair that links meets at the first token that both hold: all that they have in common comes from there on. So the
    place of a token in a set bounds its partners' sizes, and the key holds the classes of size on both sides. One side
    of a token's join is what lies outside the component of its most typical class, so a component that holds most of it
    isn't met with itself. A token that many classes hold is cut into parts on either side, and each two meet in a task.
    """
    parts = F.ceil(F.col("size") / TOKEN_ROWS).cast("int")
    dealt = opened.withColumn("other", F.explode(_partner_classes(percent)))
    mine, all_ = F.pmod(F.xxhash64("id"), parts).cast("int"), F.explode(F.sequence(F.lit(0), parts - 1))
    x = dealt.filter(~F.col("inside")).withColumn("row", mine).withColumn("line", all_).alias("x")
    y = dealt.withColumn("row", all_).withColumn("line", mine).alias("y")
    met = (F.col("x.token") == F.col("y.token")) & (F.col("x.own") == F.col("y.other")) & (F.col("x.other") == F.col("y.own"))
    met = met & (F.col("x.row") == F.col("y.row")) & (F.col("x.line") == F.col("y.line"))
    apart = (F.col("x.component") != F.col("y.component")) & (F.col("y.inside") | (F.col("x.id") < F.col("y.id")))
    return x.join(y, met & apart & _enough("x.", "y.", percent)).select(F.least("x.id", "y.id").alias("a"), F.greatest("x.id", "y.id").alias("b")).distinct()


def link_components(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles long, component_id long for each row of docs (doc_id long, text).

    Words are runs without space or 0x09-0x0D after A-Z are folded. A document's set is its distinct runs of `words`
    words, or its whole sequence if it has fewer; documents without words have none and link with nothing. Two documents
    link if their sets' common tokens are at least percent % of all tokens of both. component_id is the least doc_id
    that links reach. Null text has no words. Rows with a null doc_id link with nothing and have a null component_id.
    Rows that repeat a doc_id are one document: links of any of them hold for all. An empty table gives an empty table.
    Sets are compared by 64-bit hashes of their tokens.
    """
    source = docs.select("doc_id", "text")
    tokens = text_tokens(source)
    # Three of eight tokens are counted at first.
    sized = written(sized_documents(source, bucket_count(tokens * 3 // 8), words, percent), "sized-documents")
    open_docs = sized.filter(F.col("possible") & F.col("doc_id").isNotNull())
    classes = written(open_docs.groupBy("n", "k1", "k2").agg(F.min("doc_id").alias("rep")), "set-classes")
    reps = written(classes.select(F.col("rep").alias("doc_id")).distinct(), "class-ids")
    blocks = written(packed_sets(source, reps, words), "packed-sets")
    known = profiles(blocks, bucket_count(tokens), percent)
    repeated = open_docs.groupBy("doc_id").agg(F.count(F.lit(1)).alias("rows")).filter("rows > 1")
    if repeated.limit(1).count():
        known = known.dropDuplicates(["id", "tokens"])
    sets = written(known, "set-profiles")
    attributes = sets.select("id", "n", "u", "extra", "bits", "second", "third")
    rows = written(sets.select(F.inline(F.arrays_zip(F.col("prefix").alias("token"), F.col("places").alias("place"))), "id", "n", (F.col("u") / F.col("n")).alias("odd"),
                              F.xxhash64("id", "tokens").alias("set")), "prefixes")
    star_pairs = written(_allowed(_star_pairs(rows, percent), attributes, percent), "star-pairs")
    stars = written(verified(star_pairs, sets, percent), "star-links")
    clusters = components(stars)
    opened = written(_open_rows(rows, clusters, percent), "open-prefixes")
    rest_pairs = written(_allowed(_rest_pairs(opened, percent), attributes, percent), "rest-pairs")
    rest = written(verified(rest_pairs, sets, percent), "rest-links")
    # A class reaches the other rows of its documents: a doc_id with several sets joins their classes.
    own = open_docs.join(classes, ["n", "k1", "k2"]).select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))
    several = own.join(repeated, F.col("a") == repeated["doc_id"], "left_semi")
    found = components(stars.unionByName(rest).unionByName(several))
    for old in (reps, blocks, sets, rows, star_pairs, stars, clusters, opened, rest_pairs, rest):
        discard(old)
    placed = sized.join(classes, ["n", "k1", "k2"], "left").join(found, F.col("rep") == F.col("node"), "left")
    return placed.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "rep", "doc_id")).alias("component_id"))
