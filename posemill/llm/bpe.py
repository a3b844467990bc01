"""BPE encoding of long texts by tree concatenation, and decoding.

A long text is halved until its parts are short. The parts are encoded in parallel, then joined pairwise up the tree:
a window around each join is encoded again, and grows until it agrees with the left part before the join and with the
right part after it. Agreement is a run of equal tokens over equal bytes: a token sequence is a BPE encoding if each
adjacent pair is, so left tokens up to the left run, the window's tokens between the runs and right tokens from the
right run on are the encoding of the whole. A window that reaches both ends is itself that encoding.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from tokenizers import Tokenizer

from posemill.llm.tokens import SplitEncoder, encode_all, load, splits_locally

LEAF_CHARS = 4096
FIRST_WINDOW = 48
#: Tokens that must agree in a row on either side.
RUN = 4


class Part:
    """A stretch of a text (bytes low to high) and its encoding: ids, and ends[i], the byte after token i."""

    __slots__ = ("low", "high", "ids", "ends")

    def __init__(self, low: int, high: int, ids: np.ndarray, ends: np.ndarray):
        self.low, self.high, self.ids, self.ends = low, high, ids, ends

    def starts(self) -> np.ndarray:
        return np.concatenate(([self.low], self.ends[:-1])) if len(self.ends) else self.ends


class TreeEncoder:
    """For byte-level BPE that splits locally, where the bytes of a text's tokens are the bytes of the text. Of any other
    tokenizer no text is cut: the library encodes each whole."""

    def __init__(self, tokenizer: Tokenizer, leaf_chars: int = LEAF_CHARS, first_window: int = FIRST_WINDOW):
        self.tokenizer, self.leaf_chars, self.first_window = tokenizer, leaf_chars, first_window
        self.cuts = splits_locally(tokenizer)
        self.sizes = self._sizes() if self.cuts else np.zeros(0, np.int64)
        self.leaves = SplitEncoder(tokenizer)
        self.whole = [added.content for added in tokenizer.get_added_tokens_decoder().values()]

    def _sizes(self) -> np.ndarray:
        """Bytes of each token: one for each character of its byte-level form; an added token's own bytes."""
        sizes = np.zeros(self.tokenizer.get_vocab_size(), np.int64)
        for token, i in self.tokenizer.get_vocab(with_added_tokens=False).items():
            sizes[i] = len(token)
        for i, added in self.tokenizer.get_added_tokens_decoder().items():
            sizes[i] = len(added.content.encode())
        return sizes

    def encode(self, texts: list[str]) -> list[list[int]]:
        out: list[list[int] | None] = [None] * len(texts)
        short = [i for i, t in enumerate(texts) if not self.cuts or len(t) <= self.leaf_chars]
        for i, ids in zip(short, self.leaves.encode([texts[i] for i in short])):
            out[i] = ids.tolist()
        long = [i for i, t in enumerate(texts) if self.cuts and len(t) > self.leaf_chars]
        for i, ids in zip(long, self._trees([texts[i] for i in long])):
            out[i] = ids
        return out

    def _trees(self, texts: list[str]) -> list[list[int]]:
        leaves = [_halved(t, self.leaf_chars, self.whole) for t in texts]
        encoded = iter(self.leaves.encode([leaf for own in leaves for leaf in own]))
        data = [t.encode("utf-8", "surrogatepass") for t in texts]
        levels: list[list[Part]] = []
        for own in leaves:
            parts, low = [], 0
            for leaf in own:
                parts.append(self._part(low, next(encoded)))
                low = parts[-1].high
            levels.append(parts)
        while any(len(parts) > 1 for parts in levels):
            joins = [(t, k) for t, parts in enumerate(levels) for k in range(0, len(parts) - 1, 2)]
            joined = self._join([(data[t], levels[t][k], levels[t][k + 1]) for t, k in joins])
            made = dict(zip(joins, joined))
            levels = [[made.get((t, k), parts[k]) for k in range(0, len(parts), 2)] for t, parts in enumerate(levels)]
        return [parts[0].ids.tolist() for parts in levels]

    def _part(self, low: int, ids: list[int] | np.ndarray) -> Part:
        own = np.array(ids, np.int64)
        ends = low + np.cumsum(self.sizes[own])
        return Part(low, int(ends[-1]) if len(ends) else low, own, ends)

    def _join(self, pairs: list[tuple[bytes, Part, Part]]) -> list[Part]:
        out: list[Part | None] = [None] * len(pairs)
        open_, width = list(range(len(pairs))), self.first_window
        while open_:
            bounds = [self._window(*pairs[i], width) for i in open_]
            again = encode_all(self.tokenizer, [pairs[i][0][a:b].decode("utf-8", "surrogatepass") for i, (a, b) in zip(open_, bounds)])
            failed = []
            for i, (a, _), ids in zip(open_, bounds, again):
                out[i] = self._agreed(pairs[i][1], pairs[i][2], self._part(a, ids))
                if out[i] is None:
                    failed.append(i)
            open_, width = failed, width * 4
        return out

    @staticmethod
    def _window(data: bytes, left: Part, right: Part, width: int) -> tuple[int, int]:
        """Token boundaries about width bytes before and after the join, moved outwards to starts of code points."""
        starts, ends = left.starts(), right.ends
        i = int(np.searchsorted(starts, left.high - width, "right")) - 1
        while i > 0 and data[starts[i]] & 0xC0 == 0x80:
            i -= 1
        j = int(np.searchsorted(ends, right.low + width, "left"))
        while j < len(ends) - 1 and data[ends[j]] & 0xC0 == 0x80:
            j += 1
        return (int(starts[i]) if i > 0 else left.low), (int(ends[j]) if j < len(ends) - 1 else right.high)

    @staticmethod
    def _agreed(left: Part, right: Part, window: Part) -> Part | None:
        if window.low == left.low:
            n_left, from_left = 0, 0
        else:
            spot = _common_run(left, window)
            if spot is None:
                return None
            n_left, from_left = spot
        if window.high == right.high:
            from_right, to_right = len(right.ids), len(window.ids)
        else:
            spot = _common_run(right, window)
            if spot is None:
                return None
            from_right, to_right = spot
        if from_left > to_right:
            return None
        return Part(left.low, right.high, np.concatenate((left.ids[:n_left], window.ids[from_left:to_right], right.ids[from_right:])),
                    np.concatenate((left.ends[:n_left], window.ends[from_left:to_right], right.ends[from_right:])))


def _common_run(part: Part, window: Part) -> tuple[int, int] | None:
    """Where to pass between two encodings: after the middle token of the first RUN tokens in a row that are equal and
    cover equal bytes. Gives the tokens before that place in either."""
    ends, at, own = np.intersect1d(part.ends, window.ends, assume_unique=True, return_indices=True)
    same = part.ids[at] == window.ids[own]
    same &= part.starts()[at] == window.starts()[own]
    if len(ends) < RUN:
        return None
    steps = np.ones(len(ends), bool)
    steps[1:] = (np.diff(at) == 1) & (np.diff(own) == 1)
    good = same.copy()
    for j in range(1, RUN):
        good[:-j] &= same[j:] & steps[j:]
        good[len(good) - j:] = False
    # Byte-level tokens of zero bytes don't occur, so ends are distinct.
    hits = np.flatnonzero(good)
    if not len(hits):
        return None
    k = int(hits[0]) + RUN // 2
    return int(at[k]), int(own[k])


def _middle(text: str, whole: list[str]) -> int:
    """The middle of text, or the nearest place before or else after it that is not inside a string of whole."""
    at = len(text) // 2
    for word in whole:
        found = text.find(word, max(0, at - len(word) + 1), at + len(word) - 1)
        if 0 <= found < at:
            return found or len(word)
    return at


def _halved(text: str, most: int, whole: list[str]) -> list[str]:
    """Halves of halves, in order, until none is longer than most; all branches are equally deep. Added tokens, which
    the library finds in a text before all else, are never cut."""
    parts = [text]
    while max(map(len, parts)) > most:
        cuts = [_middle(p, whole) for p in parts]
        if all(at in (0, len(p)) for p, at in zip(parts, cuts)):
            break
        parts = [h for p, at in zip(parts, cuts) for h in (p[:at], p[at:]) if h]
    return parts


def encode_documents(docs: DataFrame, tokenizer_path: str, digests: bool = False, leaf_chars: int = LEAF_CHARS) -> DataFrame:
    """docs without text, with ids array<int> and decoded string added; with digests, n_tokens long, ids_sha256 and
    decoded_sha256 string instead, made where the ids are.

    Ids are those of the library's own encoding without added special tokens; decoding keeps special tokens. Null text
    is empty: no ids, an empty decoded text. Repeated rows get equal results; an empty table gives an empty table.
    Other columns pass through; those named like the added ones are replaced. Texts of more than leaf_chars are cut if
    the tokenizer is byte-level BPE that splits locally; any other encodes whole texts. Its file must be at
    tokenizer_path on every executor.
    """
    added = {"n_tokens": ("long", pa.int64()), "ids_sha256": ("string", pa.string()), "decoded_sha256": ("string", pa.string())} if digests else {
        "ids": ("array<int>", pa.list_(pa.int32())), "decoded": ("string", pa.string())}
    rows = docs.drop(*added)
    carried = [c for c in rows.columns if c != "text"]
    schema = ", ".join([f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in carried] + [f"{n} {k}" for n, (k, _) in added.items()])

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = load(tokenizer_path)
        encoder = TreeEncoder(tokenizer, leaf_chars)
        shown = [str(i) for i in range(tokenizer.get_vocab_size())]
        for whole in batches:
            for low in range(0, whole.num_rows, 200):
                batch = whole.slice(low, 200)
                ids = encoder.encode([t or "" for t in batch.column("text").to_pylist()])
                texts = tokenizer.decode_batch(ids, skip_special_tokens=False)
                if digests:
                    made = [
                        [len(x) for x in ids],
                        [hashlib.sha256(",".join(map(shown.__getitem__, x)).encode()).hexdigest() for x in ids],
                        [hashlib.sha256(t.encode("utf-8", "surrogatepass")).hexdigest() for t in texts],
                    ]
                else:
                    made = [ids, texts]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(c) for c in carried] + [pa.array(v, t) for v, (_, t) in zip(made, added.values())], [*carried, *added])

    return rows.mapInArrow(encode, schema)
