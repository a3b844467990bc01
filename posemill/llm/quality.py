"""Quality rules as a short-circuit cascade.

Each rule rejects a document by one measure of its text. On a sample every rule runs alone, which gives its cost and the
share it rejects; the cascade then runs the rules by rejection per cost, and a document that fails one skips the rest.
The order decides only what is spent: the verdict is the same in every order.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from posemill.llm.wordhash import gram_hashes, word_bounds, word_hashes

_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True
_BLANK_BYTES = " \t\n\x0b\x0c\r".encode()


class Measured:
    """Measures of one text, each computed when first asked for."""

    def __init__(self, text: str | None):
        self.data = (text or "").encode("utf-8", "surrogatepass")
        self._kept: dict[str, object] = {}

    def _once(self, name: str, make: Callable[[], object]):
        if name not in self._kept:
            self._kept[name] = make()
        return self._kept[name]

    @property
    def raw(self) -> np.ndarray:
        return self._once("raw", lambda: np.frombuffer(self.data, np.uint8))

    @property
    def bounds(self) -> tuple[np.ndarray, np.ndarray]:
        return self._once("bounds", lambda: word_bounds(self.raw))

    @property
    def n_words(self) -> int:
        return len(self.bounds[0])

    @property
    def word_chars(self) -> int:
        """Code points inside words: bytes that are neither blank nor the continuation of a code point."""
        def count() -> int:
            blanks = len(self.data) - int((self.bounds[1] - self.bounds[0]).sum())
            return int(((self.raw & 0xC0) != 0x80).sum()) - blanks
        return self._once("word_chars", count)

    @property
    def n_symbols(self) -> int:
        return self._once("n_symbols", lambda: int(_SYMBOL[self.raw].sum()))

    @property
    def n_dup_lines(self) -> int:
        def count() -> int:
            lines = [x for x in self.data.split(b"\n") if x.strip(_BLANK_BYTES)]
            return len(lines) - len(set(lines))
        return self._once("n_dup_lines", count)

    @property
    def n_lines(self) -> int:
        return self._once("n_lines", lambda: sum(1 for x in self.data.split(b"\n") if x.strip(_BLANK_BYTES)))

    @property
    def n_repeat_words(self) -> int:
        """Words that lie in a 3-word window found at least twice in the text."""
        def count() -> int:
            grams = gram_hashes(word_hashes(self.data), 3)
            if len(grams) < 2:
                return 0
            order = np.argsort(grams, kind="stable")
            same = grams[order[1:]] == grams[order[:-1]]
            again = np.zeros(len(grams) + 2, bool)
            starts = np.concatenate((order[1:][same], order[:-1][same]))
            for j in range(3):
                again[starts + j] = True
            return int(again.sum())
        return self._once("n_repeat_words", count)


@dataclass(frozen=True)
class Rule:
    name: str
    rejects: Callable[[Measured], bool]


#: The base rules come from the contract of the registered query; the others are the usual bounds for web text.
BASE_RULES = (
    Rule("few_words", lambda m: m.n_words < 50),
    Rule("repeated_windows", lambda m: 100 * m.n_repeat_words > 50 * m.n_words),
)
RULES = BASE_RULES + (
    Rule("symbols", lambda m: 10 * m.n_symbols > m.n_words),
    Rule("duplicate_lines", lambda m: 100 * m.n_dup_lines > 50 * m.n_lines),
    Rule("word_length", lambda m: not 3 * m.n_words <= m.word_chars <= 12 * m.n_words),
)


@dataclass(frozen=True)
class RuleEstimate:
    name: str
    seconds: float
    rejected: float

    @property
    def gain(self) -> float:
        return self.rejected / max(self.seconds, 1e-9)


def estimate(docs: DataFrame, rules: tuple[Rule, ...] = RULES, sample_rows: int = 1000, clock=time.perf_counter) -> list[RuleEstimate]:
    """Mean seconds and rejected share of each rule, run alone, with all measures it needs, on about sample_rows rows
    drawn at random. Rules run where the rows are; only sums reach the driver. The sample orders the rules and has no
    part in any verdict. An empty table gives zeros."""
    picked = docs.select("text").filter(F.rand(17) < sample_rows / max(1, docs.count()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seconds, lost, rows = np.zeros(len(rules)), np.zeros(len(rules), np.int64), 0
        for batch in batches:
            for text in batch.column("text"):
                rows += 1
                for i, rule in enumerate(rules):
                    began = clock()
                    lost[i] += bool(rule.rejects(Measured(text.as_py())))
                    seconds[i] += clock() - began
        yield pa.RecordBatch.from_arrays([pa.array(range(len(rules)), pa.int32()), pa.array(seconds), pa.array(lost), pa.array([rows] * len(rules), pa.int64())], ["rule", "seconds", "lost", "rows"])

    sums = picked.mapInArrow(run, "rule int, seconds double, lost long, rows long").groupBy("rule").agg(F.sum("seconds"), F.sum("lost"), F.sum("rows")).collect()  # a row for each rule
    by_rule = {i: (seconds / max(1, rows), lost / max(1, rows)) for i, seconds, lost, rows in sums}
    return [RuleEstimate(rule.name, *by_rule.get(i, (0.0, 0.0))) for i, rule in enumerate(rules)]


def cascade_order(estimates: list[RuleEstimate]) -> list[str]:
    return [e.name for e in sorted(estimates, key=lambda e: (-e.gain, e.seconds, e.name))]


MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def apply_cascade(docs: DataFrame, rules: tuple[Rule, ...] = RULES, order: list[str] | None = None, measures: bool = False,
                  sample_rows: int = 1000) -> DataFrame:
    """docs without text, with kept boolean, failed_rule string (the first rule of the cascade that rejects; null if
    kept) and rules_run int. With measures, also the five measures of every document and base_failed.

    failed_rule and rules_run follow the order, which follows measured times: give an order for equal ones in each run.
    With measures all of them are computed for every document, so the order saves only what rules need beyond them.
    Null text is no words and fails few_words. Rows are judged one by one: repeated rows get equal verdicts, and an
    empty table gives an empty table. Other columns pass through; those named like the added ones are replaced.
    """
    by_name = {rule.name: rule for rule in rules}
    ordered = [by_name[name] for name in (order or cascade_order(estimate(docs, rules, sample_rows)))]
    added = ["kept", "failed_rule", "rules_run", *([*MEASURES, "base_failed"] if measures else [])]
    rows = docs.drop(*added)
    carried = [c for c in rows.columns if c != "text"]
    kinds = ["boolean", "string", "int", *(["long"] * len(MEASURES) + ["boolean"] if measures else [])]
    schema = ", ".join([f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in carried] + [f"{n} {k}" for n, k in zip(added, kinds)])
    types = [pa.bool_(), pa.string(), pa.int32(), *([pa.int64()] * len(MEASURES) + [pa.bool_()])]

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[] for _ in added]
            for text in batch.column("text"):
                found, failed, ran = Measured(text.as_py()), None, 0
                for rule in ordered:
                    ran += 1
                    if rule.rejects(found):
                        failed = rule.name
                        break
                row: list = [failed is None, failed, ran]
                if measures:
                    row += [getattr(found, name) for name in MEASURES]
                    row.append(any(rule.rejects(found) for rule in BASE_RULES))
                for column, value in zip(out, row):
                    column.append(value)
            yield pa.RecordBatch.from_arrays(
                [batch.column(c) for c in carried] + [pa.array(v, t) for v, t in zip(out, types)], [*carried, *added])

    return rows.mapInArrow(judge, schema)
