"""Tokenizers by file, loaded once in each worker process, and exact encoding by kept words."""

from __future__ import annotations

import json
import os
import re
from collections.abc import Callable, Iterable, Iterator

import numpy as np
from tokenizers import Tokenizer, pre_tokenizers

_LOADED: dict[str, Tokenizer] = {}
#: What steps() found of loaded tokenizers, by their id; these are kept for good.
_STEPS: dict[int, dict | None] = {}
#: Text encoded in one library call; its result holds strings and offsets for every token.
CALL_CHARS = 400_000


def load(path: str) -> Tokenizer:
    if path not in _LOADED:
        # Tasks already use all cores; threads inside them cost more than they bring.
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        tokenizer = Tokenizer.from_file(path)
        tokenizer.no_padding()
        tokenizer.no_truncation()
        _LOADED[path], _STEPS[id(tokenizer)] = tokenizer, steps(tokenizer)
    return _LOADED[path]


def encode_all(tokenizer: Tokenizer, texts: list[str]) -> list[list[int]]:
    """The ids of each text, in library calls of about CALL_CHARS characters."""
    out: list[list[int]] = []
    part: list[str] = []
    size = 0
    for text in texts:
        part.append(text)
        size += len(text)
        if size >= CALL_CHARS:
            out += [e.ids for e in tokenizer.encode_batch_fast(part, add_special_tokens=False)]
            part, size = [], 0
    if part:
        out += [e.ids for e in tokenizer.encode_batch_fast(part, add_special_tokens=False)]
    return out


#: Characters on whose classes all regex engines agree, the letters and numbers among them, and with those
#: how the tokenizers with word ends (after folding case) and those of byte level split a text before merging.
PLAIN = r"[\t\n\x0b\x0c\r -~\xa1-\u017f\u2010-\u2027]*"
LETTERS, NUMBERS = r"A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\u017f", r"0-9\xb2\xb3\xb9\xbc-\xbe"
WORD_SPLIT = rf"[{LETTERS}]+|'(?:s|t|re|ve|m|ll|d)|[{NUMBERS}]|[^\s{LETTERS}{NUMBERS}]+"
BYTE_LEVEL_SPLIT = rf" ?[{LETTERS}]+|'(?:s|t|re|ve|m|ll|d)| ?[{NUMBERS}]+| ?[^\s{LETTERS}{NUMBERS}]+|\s+(?!\S)|\s+"


#: The steps before merging of the two kinds of tokenizers that these splits stand for.
WORD_STEPS = {
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {"type": "Sequence", "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "use_regex": False}]},
    "suffix": "</w>",
}
BYTE_LEVEL_STEPS = {"normalizer": None, "pre_tokenizer": {"type": "ByteLevel", "add_prefix_space": False, "use_regex": True}, "suffix": None}
#: Steps that split a text by what stands next to the place, and so alike in a text and in its parts.
LOCAL_STEPS = ("ByteLevel", "Digits", "Punctuation", "Split")


def steps(tokenizer: Tokenizer) -> dict | None:
    """normalizer, pre_tokenizer and suffix (of word ends) of a tokenizer; None where its merging is other than plain BPE."""
    if id(tokenizer) in _STEPS:
        return _STEPS[id(tokenizer)]
    told = json.loads(tokenizer.to_str())
    model = told["model"]
    if model.get("type", "BPE") != "BPE" or any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "byte_fallback", "ignore_merges")):
        return None
    if told["normalizer"] and any(t["normalized"] for t in told["added_tokens"]):  # found in the changed text
        return None

    def without_offsets(step: object) -> object:
        if isinstance(step, dict):
            return {k: without_offsets(v) for k, v in step.items() if k != "trim_offsets"}
        return [without_offsets(x) for x in step] if isinstance(step, list) else step
    return {"normalizer": without_offsets(told["normalizer"]), "pre_tokenizer": without_offsets(told["pre_tokenizer"]), "suffix": model.get("end_of_word_suffix") or None}


def splits_locally(tokenizer: Tokenizer) -> bool:
    """Whether this is byte-level BPE whose tokens' bytes are the text's, split by steps that look at neighbours only."""
    found = steps(tokenizer)
    if found is None or found["normalizer"] or found["suffix"] or not found["pre_tokenizer"]:
        return False
    own = found["pre_tokenizer"].get("pretokenizers", [found["pre_tokenizer"]])
    return own[-1]["type"] == "ByteLevel" and all(s["type"] in LOCAL_STEPS and not s.get("add_prefix_space") and s.get("behavior") != "Removed" for s in own)


class Kept:
    """The ids of parts already encoded, as bytes, in two generations: when the new one is full it becomes the old one,
    and what is still in use moves back when it is next asked for. Holds twice `most` parts at most."""

    def __init__(self, most: int, most_chars: int, encode: Callable[[list[str]], list[bytes]]):
        self.most, self.most_chars, self.encode = most, most_chars, encode
        self.new: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def joined(self, parts: dict[int, list[str]]) -> Iterator[tuple[int, bytes]]:
        """The joined ids of each list of parts. What is not kept is encoded, all in one call, and kept if short."""
        if len(self.new) >= self.most:
            self.old, self.new = self.new, {}
        found = {i: list(map(self.new.get, own)) for i, own in parts.items()}
        gaps: dict[int, list[int]] = {}
        for i, ids in found.items():
            at, places = -1, []
            for _ in range(ids.count(None)):
                at = ids.index(None, at + 1)
                places.append(at)
            if places:
                gaps[i] = places
        asked = {parts[i][k] for i, places in gaps.items() for k in places}
        made = {part: ids for part in asked if (ids := self.old.get(part)) is not None}
        unknown = list(asked.difference(made))
        if unknown:
            made.update(zip(unknown, self.encode(unknown)))
        self.new.update((part, ids) for part, ids in made.items() if len(part) <= self.most_chars)
        for i, places in gaps.items():
            own, ids = parts[i], found[i]
            for k in places:
                ids[k] = made[own[k]]
        return ((i, b"".join(ids)) for i, ids in found.items())


class WordEncoder:
    """For tokenizers that fold case, drop white space and mark word ends: the ids of a text are those of its words, and
    each distinct word is encoded once and kept. Texts with other than plain characters, or with an added token, go to
    the library whole, and so do all texts for a tokenizer with other steps. Gives ids as little-endian unsigned 32-bit
    bytes."""

    def __init__(self, path: str | Tokenizer, most_kept: int = 650_000, most_chars: int = 40):
        self.tokenizer = load(path) if isinstance(path, str) else path
        self.known = steps(self.tokenizer) == WORD_STEPS
        self.split, self.plain = re.compile(WORD_SPLIT).findall, re.compile(PLAIN).fullmatch
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.ends = np.zeros(self.tokenizer.get_vocab_size(), bool)
        self.ends[[i for token, i in self.tokenizer.get_vocab().items() if token.endswith("</w>")]] = True
        # The words are folded and split already: the same model without the steps before it.
        self.words = Tokenizer(self.tokenizer.model)
        self.words.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        self.kept = Kept(most_kept, most_chars, self._encode)

    def _encode(self, words: list[str]) -> list[bytes]:
        """Many words in one call, cut after the tokens that end a word."""
        out: list[bytes] = []
        for low in range(0, len(words), 20_000):
            part = words[low:low + 20_000]
            ids = np.array(self.words.encode_batch_fast([" ".join(part)], add_special_tokens=False)[0].ids, "<u4")
            cuts = (np.flatnonzero(self.ends[ids]) + 1).tolist()
            if len(cuts) == len(part):
                data = ids.tobytes()
                out += [data[4 * i:4 * j] for i, j in zip([0, *cuts], cuts)]
            else:
                out += [np.array(x, "<u4").tobytes() for x in encode_all(self.tokenizer, part)]
        return out

    def encode(self, texts: Iterable[str | None]) -> list[bytes]:
        texts = [t or "" for t in texts]
        whole = [i for i, t in enumerate(texts) if not self.known or not self.plain(t) or any(a in t for a in self.added)]
        out: list[bytes | None] = [None] * len(texts)
        for i, ids in zip(whole, encode_all(self.tokenizer, [texts[i] for i in whole])):
            out[i] = np.array(ids, "<u4").tobytes()
        for i, ids in self.kept.joined({i: self.split(t.lower()) for i, t in enumerate(texts) if out[i] is None}):
            out[i] = ids
        return out


class SplitEncoder:
    """For byte-level BPE: merges never cross the splits, so each distinct split is encoded once and kept. Texts with
    other than plain characters, or with an added token, go to the library whole, and so do all texts for a tokenizer
    with other steps. Gives ids as 32-bit arrays."""

    def __init__(self, tokenizer: Tokenizer, most_kept: int = 400_000, most_chars: int = 32):
        self.tokenizer = tokenizer
        self.known = steps(tokenizer) == BYTE_LEVEL_STEPS
        self.split, self.plain = re.compile(BYTE_LEVEL_SPLIT).findall, re.compile(PLAIN).fullmatch
        self.added = [t.content for t in tokenizer.get_added_tokens_decoder().values()]
        self.line_end = encode_all(tokenizer, ["\n"])[0]
        # The same model without the usual splitting: only at line ends, which stay as tokens of their own.
        self.lines = Tokenizer(tokenizer.model)
        self.lines.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.Split("\n", "isolated"), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        self.kept = Kept(most_kept, most_chars, self._encode)

    def _encode(self, splits: list[str]) -> list[bytes]:
        """Many splits in one call, each on a line of its own; those that hold a line end apart."""
        single = [s for s in splits if "\n" not in s] if len(self.line_end) == 1 else []
        out: dict[str, bytes] = {}
        for low in range(0, len(single), 20_000):
            part = single[low:low + 20_000]
            ids = np.array(self.lines.encode_batch_fast(["\n".join(part) + "\n"], add_special_tokens=False)[0].ids, "<u4")
            cuts = np.flatnonzero(ids == self.line_end[0]).tolist()
            if len(cuts) == len(part):
                data = ids.tobytes()
                out.update((s, data[4 * i:4 * j]) for s, i, j in zip(part, [0, *[c + 1 for c in cuts]], cuts))
        rest = [s for s in splits if s not in out]
        out.update((s, np.array(ids, "<u4").tobytes()) for s, ids in zip(rest, encode_all(self.tokenizer, rest)))
        return [out[s] for s in splits]

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        whole = [i for i, t in enumerate(texts) if not self.known or not self.plain(t) or any(a in t for a in self.added)]
        out: list[np.ndarray | None] = [None] * len(texts)
        for i, ids in zip(whole, encode_all(self.tokenizer, [texts[i] for i in whole])):
            out[i] = np.array(ids, "<u4")
        for i, ids in self.kept.joined({i: self.split(t) for i, t in enumerate(texts) if out[i] is None}):
            out[i] = np.frombuffer(ids, "<u4")
        return out
