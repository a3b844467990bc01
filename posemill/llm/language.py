"""Language identification by rank-order profiles.

A text's n-grams (1 to 3 letters, words padded with a blank) are ranked by frequency; a language's profile is the same
ranking over its training texts. The distance to a language is the sum over the text's most frequent n-grams of how far
out of place each is in the profile, or the greatest penalty where it is missing. The nearest language wins.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PROFILE_SIZE = 400
#: N-grams are counted in this many hashed places. A profile holds 400 of them; texts of scripts with thousands of letters
#: have more n-grams than places, of which the frequent ones may then share a place.
PLACES = 1 << 16
UNDECIDED = "und"
_LETTER: list[np.ndarray] = []


def _letters() -> np.ndarray:
    """For every code point whether it is a letter."""
    if not _LETTER:
        _LETTER.append(np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000))
    return _LETTER[0]


def gram_counts(text: str) -> np.ndarray | None:
    """The counts of a text's 1- to 3-grams by hashed place, or None for a text without letters. All that is no letter
    is a blank, runs of blanks are one, and no gram reaches over a blank."""
    code = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = _letters()[code]
    if not letter.any():
        return None
    last = np.zeros(len(code) + 2, bool)
    last[1:-1] = letter
    keep = last.copy()
    keep[1:] |= last[:-1]
    keep[:-1] |= last[1:]
    line = np.zeros(len(code) + 2, np.uint32)
    line[1:-1] = np.where(letter, code, 0)
    line = line[keep]
    blank = line == 0
    once = ~(blank[1:] & blank[:-1])  # two words may be kept with two blanks between them
    line = np.concatenate((line[:1], line[1:][once]))
    one = (line + np.uint32(1)) * np.uint32(0x9E3779B1)
    two = (one[:-1] ^ (one[:-1] >> np.uint32(15))) * np.uint32(0x85EBCA6B) + one[1:]
    three = (two[:-1] ^ (two[:-1] >> np.uint32(13))) * np.uint32(0xC2B2AE35) + one[2:]
    every = np.concatenate((one[line != 0], two, three[line[1:-1] != 0]))
    every = (every ^ (every >> np.uint32(16))) * np.uint32(0x27D4EB2F)
    return np.bincount(every >> np.uint32(16), minlength=PLACES)


def ranked(counts: np.ndarray, size: int = PROFILE_SIZE) -> np.ndarray:
    """The places of the most frequent n-grams, most frequent first; ties by place."""
    at = np.flatnonzero(counts)
    n = counts[at]
    if len(at) > 4 * size:
        least = np.partition(n, len(n) - size)[len(n) - size]
        at, n = at[n >= least], n[n >= least]
    return at[np.lexsort((at, -n))][:size]


@dataclass(frozen=True)
class Profiles:
    """languages[i] has ranks[i]: the rank of each place, PROFILE_SIZE where it is missing."""

    languages: tuple[str, ...]
    ranks: np.ndarray

    def predict(self, counts: np.ndarray | None) -> tuple[str, float]:
        """The nearest language (ties: the first by name) and 1 minus its distance over the greatest distance."""
        if counts is None or not self.languages:
            return UNDECIDED, 0.0
        top = ranked(counts)
        # Ranks are compared on the scale of the text's own list where it is short.
        away = np.abs(self.ranks[:, top].astype(np.int64) - np.arange(len(top))[None, :])
        away = np.where(self.ranks[:, top] >= PROFILE_SIZE, PROFILE_SIZE, away).sum(axis=1)
        best = int(np.argmin(away))
        return self.languages[best], float(1 - away[best] / (PROFILE_SIZE * len(top)))


def fit_profiles(docs: DataFrame, text: str = "text", lang: str = "lang", rows_per_language: int = 3000) -> Profiles:
    """Profiles from labelled rows. About rows_per_language distinct texts of each language are used, one at least: those
    whose hashes lie below a bound set from the language's number of distinct texts, so copies weigh nothing. Rows with
    a null text or lang are not used, nor are texts without letters. The number of languages is taken to be small (they
    are the values of a label). Each task sends one row for each language and place, so a language with most rows weighs
    no more on the merge than another."""
    rows = docs.select(F.col(text).alias("text"), F.col(lang).alias("lang")).dropna()
    rows = rows.withColumn("place", F.shiftrightunsigned(F.xxhash64("text", F.lit("profile")), 1))
    sizes = rows.groupBy("lang").agg(F.approx_count_distinct("place", 0.02).alias("n"), F.min("place").alias("least")).collect()
    if not sizes:
        return Profiles((), np.zeros((0, PLACES), np.int32))
    top = (1 << 63) - 1
    bound = F.create_map(*[F.lit(x) for r in sizes for x in (r["lang"], max(r["least"], min(top, top // max(1, r["n"]) * rows_per_language)))])
    sample = rows.filter(F.col("place") <= F.element_at(bound, F.col("lang"))).dropDuplicates(["lang", "place"]).select("text", "lang")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        for batch in batches:
            for t, g in zip(batch.column("text"), batch.column("lang")):
                found = gram_counts(t.as_py())
                if found is not None:
                    total[g.as_py()] = total.get(g.as_py(), 0) + found
        for g, found in total.items():
            at = np.flatnonzero(found)
            yield pa.RecordBatch.from_arrays([pa.array([g] * len(at), pa.string()), pa.array(at, pa.int32()), pa.array(found[at], pa.int64())], ["lang", "place", "n"])

    counted = sample.mapInArrow(count, "lang string, place int, n long").groupBy("lang", "place").agg(F.sum("n").alias("n"))
    best = counted.groupBy("lang").agg(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("n"), "place"))).alias("top"))
    found = {r[0]: r[1] for r in best.select("lang", F.slice("top.place", 1, PROFILE_SIZE)).collect()}
    languages = tuple(sorted(found))
    ranks = np.full((len(languages), PLACES), PROFILE_SIZE, np.int32)
    for i, language in enumerate(languages):
        ranks[i, found[language]] = np.arange(len(found[language]))
    return Profiles(languages, ranks)


def identify(docs: DataFrame, profiles: Profiles, text: str = "text") -> DataFrame:
    """docs with lang_pred string and score double (0 to 1) added. Null text and text without a letter: "und", 0.

    The prediction is a function of the text alone: repeated rows get equal ones. An empty table gives an empty table.
    Other columns pass through; those named like the added ones are replaced.
    """
    rows = docs.drop("lang_pred", "score")
    names = rows.columns
    schema = ", ".join([f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in names] + ["lang_pred string", "score double"])
    languages, packed = profiles.languages, profiles.ranks.astype(np.int16)

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Profiles(languages, packed)
        for batch in batches:
            said = [own.predict(gram_counts(t.as_py() or "")) for t in batch.column(text)]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array([s[0] for s in said], pa.string()), pa.array([s[1] for s in said], pa.float64())],
                [*names, "lang_pred", "score"])

    return rows.mapInArrow(predict, schema)


def held_out(doc_id: Column) -> Column:
    """True for the documents that no profile may learn from. A null doc_id is never held out."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))
