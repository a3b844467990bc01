"""Document fingerprints from closed syncmers over words, and over characters where there are few words (DataFrame
functions only).

A window of k words is an anchor if the smallest hash among its inner s-word runs is that of its first or its last run.
Whether it is depends on the window's words alone, so an edit changes only the anchors whose windows it touches, and
equal passages carry equal anchors wherever they stand. The fingerprint lists the anchors' codes in text order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from posemill.llm.common import LAST_ID, let, written

WORDS, INNER = 5, 2
#: Hexadecimal digits of an anchor's code of 32 bits in the fingerprint.
CODE_DIGITS = 8
#: Texts of at most so many code points, and words of more, are taken apart into characters.
SHORT_TEXT, LONG_WORD = 100, 40
_UNSPACED = "[\\u0E00-\\u0EFF\\u1000-\\u109F\\u1780-\\u17FF\\u3040-\\u30FF\\u3400-\\u4DBF\\u4E00-\\u9FFF]"
_BLANKS = "[\\x20\\x09-\\x0D]+"


def words(text: Column) -> Column:
    """Runs without blanks. A letter of a script that is written without spaces is a word of its own, and so is each
    character of a run of more than LONG_WORD and of a text of at most SHORT_TEXT."""
    parts = F.when(F.char_length(text) <= SHORT_TEXT, F.split(F.regexp_replace(text, _BLANKS, ""), ""))
    parts = parts.when(text.rlike(_UNSPACED), F.split(text, f"{_BLANKS}|(?<={_UNSPACED})|(?={_UNSPACED})")).otherwise(F.split(text, _BLANKS))
    whole = F.filter(parts, lambda w: w != "")
    apart = lambda all_words: F.flatten(F.transform(all_words, lambda w: F.when(F.char_length(w) > LONG_WORD, F.split(w, "")).otherwise(F.array(w))))
    return let(whole, lambda found: F.when(F.exists(found, lambda w: F.octet_length(w) > LONG_WORD), apart(found)).otherwise(found))


def anchors(text: Column, k: int = WORDS, s: int = INNER) -> Column:
    """array<struct<pos int, code int>>, in text order: word position and code of each closed syncmer. A text without
    one (too few words, say) has one anchor over all its words at position 0; a text without words has none."""
    runs = k - s + 1

    def select(h: Column, g: Column) -> Column:
        edges = lambda i: F.least(F.get(g, i), F.get(g, i + (runs - 1)))
        inner = lambda i: F.least(F.get(g, i + 1), F.get(g, i + 2), *[F.get(g, i + j) for j in range(3, runs - 1)]) if runs > 3 else F.get(g, i + 1)
        places = F.filter(F.sequence(F.lit(0), F.size(g) - runs), lambda i: edges(i) <= inner(i)) if runs > 2 else F.sequence(F.lit(0), F.size(g) - runs)
        return F.transform(places, lambda i: F.struct(i.alias("pos"), code(F.xxhash64(*[F.get(h, i + j) for j in range(k)])).alias("code")))

    def of_hashes(h: Column) -> Column:
        inner_runs = F.transform(F.sequence(F.lit(0), F.size(h) - s), lambda i: F.xxhash64(*[F.get(h, i + j) for j in range(s)]))
        whole = F.array(F.struct(F.lit(0).alias("pos"), code(F.xxhash64(h)).alias("code")))
        none = F.array().cast("array<struct<pos:int,code:int>>")
        chosen = F.when(F.size(h) >= k, let(inner_runs, lambda g: select(h, g))).otherwise(none)
        return let(chosen, lambda found: F.when(F.size(found) > 0, found).when(F.size(h) > 0, whole).otherwise(none))

    return let(F.transform(words(text), lambda w: F.xxhash64(w)), of_hashes)


def code(h: Column) -> Column:
    return F.shiftright(h, 32).cast("int")


def shown(codes: Column) -> Column:
    """The fingerprint: CODE_DIGITS lower-case hexadecimal digits for each anchor."""
    wide = F.lit(1 << 32)
    return F.lower(F.array_join(F.transform(codes, lambda c: F.substring(F.hex(F.pmod(c.cast("long"), wide) + wide), 2, CODE_DIGITS)), ""))


def likeness(a: Column, b: Column) -> Column:
    """Twice the distinct codes in common over the distinct codes of both: 0 to 1. Two texts without anchors: 1."""
    sizes = F.size(F.array_distinct(a)) + F.size(F.array_distinct(b))
    return F.when(sizes == 0, F.lit(1.0)).otherwise(2.0 * F.size(F.array_intersect(a, b)) / sizes)


def next_in_order(keys: DataFrame, order: list[Column]) -> DataFrame:
    """keys with next: the row (as a struct) that follows in the order; the first follows the last. Rows are dealt by
    range; only the ends of the ranges, one row a partition, are compared across them."""
    names = keys.columns
    dealt = keys.repartitionByRange(*order).sortWithinPartitions(*order)
    numbered = written(dealt.withColumns({"range": F.spark_partition_id(), "at": F.monotonically_increasing_id()}), "ranges")
    ends = numbered.groupBy("range").agg(F.min("at").alias("first"), F.max("at").alias("at"))
    after = F.coalesce(F.lead("first").over(W.orderBy("range")), F.first("first").over(W.orderBy("range")))
    jumps = ends.select("at", after.alias("jump"))  # as many rows as there are ranges
    follows = numbered.join(F.broadcast(jumps), "at", "left").withColumn("at", F.coalesce("jump", F.col("at") + 1)).drop("jump", "range")
    rows = numbered.select("at", F.struct(*names).alias("next"))
    return follows.join(rows, "at").select(*names, "next")


def with_neighbours(docs: DataFrame) -> DataFrame:
    """doc_id, text, n_chars, codes, next_start, next_codes for each row of docs, where the next document in descending
    doc_id gives its codes and its first floor(n_chars / 2) code points.

    Null text is empty. A null doc_id comes last. Of one doc_id with several texts each is a document, in the order of
    their hashes; rows that repeat doc_id and text are one document and get equal results. A single document is its own
    next. An empty table gives an empty table.
    """
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(F.coalesce("doc_id", F.lit(LAST_ID)).alias("own"), F.col("doc_id").isNull().alias("no_id"), text.alias("text"), F.xxhash64(text).alias("hash"))
    keys = rows.groupBy("no_id", "own", "hash").agg(F.max(F.char_length("text")).alias("n"), F.count(F.lit(1)).alias("copies"))
    order = [F.col("no_id"), F.col("own").desc(), F.col("hash")]
    pairs = written(next_in_order(keys, order), "next-documents")
    wanted = pairs.select(F.col("no_id").alias("for_no_id"), F.col("own").alias("for_own"), F.col("hash").alias("for_hash"), F.expr("n div 2").cast("int").alias("half"),
                          F.col("next.no_id").alias("no_id"), F.col("next.own").alias("own"), F.col("next.hash").alias("hash"))
    key = ["own", "hash", "no_id"]
    given = rows.hint("merge").join(wanted, key).select(
        F.col("for_own").alias("own"), F.col("for_hash").alias("hash"), F.col("for_no_id").alias("no_id"),
        F.expr("left(text, half)").alias("next_start"), anchors(F.col("text")).getField("code").alias("next_codes"))
    if pairs.filter("copies > 1").limit(1).count():
        given = given.groupBy(*key).agg(F.first("next_start").alias("next_start"), F.first("next_codes").alias("next_codes"))
    joined = rows.hint("merge").join(given, key)
    return joined.select(
        F.when(~F.col("no_id"), F.col("own")).alias("doc_id"), "text", F.char_length("text").cast("long").alias("n_chars"),
        anchors(F.col("text")).getField("code").alias("codes"), "next_start", "next_codes")
