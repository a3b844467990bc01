"""The pipeline's stages on planted cases, each against what its input asks for."""

from __future__ import annotations

import random
import re
import zlib

import numpy as np
import pandas as pd
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from test_llm import brute_components, brute_pii

import corpus_pipeline as P
from posemill.llm import language, pii, tokens


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(1)
    en = ["the", "of", "and", "thing", "there", "with", "house", "water", "light", "other"]
    fr = ["le", "les", "des", "être", "avec", "maison", "été", "lumière", "autre", "pour"]
    def prose(words, n):
        return " ".join(rng.choice(words) + rng.choice(("", "s", "er", "ing")) for _ in range(n))
    rows = [(i, "\n".join(prose(en if i % 2 else fr, 20) for _ in range(4)), "en" if i % 2 else "fr", "s", 0) for i in range(40)]
    base = prose(en, 200).split()
    near = base[:]
    near[100] = "changed"
    passage = prose(en, 60)
    rows += [(50, " ".join(base), "en", "s", 0), (51, " ".join(near), None, "s", 0), (52, "123 456 !!! 789", "en", "s", 0), (53, None, "en", "s", 0),
             (54, f"{prose(en, 50)}\n{passage}\nwrite to jo.doe@example.org today", "en", "s", 0), (55, f"{prose(en, 50)}\n{passage}\n{prose(en, 5)}", "en", "s", 0)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")


def test_stages(spark, docs, tmp_path):
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    kept, after = docs, {}
    for name, stage in P.STAGES[:-1]:
        kept = P.written(stage(spark, kept, str(tmp_path)), name)
        assert kept.columns == P.COLUMNS
        after[name] = {r["doc_id"]: r for r in kept.collect()}
    assert set(after["language_id"]) == set(range(40)) | {50, 51, 54, 55} and after["language_id"][51]["lang"] == "en"
    assert len(after["line_dedup"]) == len(after["language_id"])
    lines = after["line_dedup"][55]["text"].split("\n")
    assert len(lines) == 2 and after["line_dedup"][54]["text"].count("\n") == 2 and after["line_dedup"][55]["n_chars"] == len(after["line_dedup"][55]["text"])
    assert 51 not in after["jaccard_join"] and set(after["jaccard_join"]) == set(after["line_dedup"]) - {51}
    assert after["pii"][54]["text"].endswith("write to <EMAIL> today")
    packed = P.STAGES[-1][1](spark, kept, str(tmp_path)).toPandas()
    assert set(packed.doc_id) == set(after["pii"]) and packed.groupby("sequence_id").length.sum().max() <= P.CAPACITY
    again = P.run(spark, str(tmp_path)).toPandas()
    key = ["doc_id", "piece", "length", "ids_crc32"]
    assert sorted(map(tuple, again[key].to_numpy())) == sorted(map(tuple, packed[key].to_numpy()))


def brute_lines(rows: list[tuple[int, str]]) -> dict[int, str]:
    fold = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    key = lambda line: line.strip(" \t\n\x0b\x0c\r").translate(fold)
    first: dict[str, int] = {}
    for i, text in sorted(rows):
        for line in text.split("\n"):
            first.setdefault(key(line), i)
    return {i: "\n".join(x for x in text.split("\n") if len(key(x)) < 10 or first[key(x)] == i) for i, text in rows}


def test_each_stage_equals_brute_force_on_whole_tables(spark):
    """Every stage on all that the one before it kept."""
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    kept, before, out = docs, {r["doc_id"]: r for r in docs.collect()}, {}
    for name, stage in P.STAGES:
        kept = P.written(stage(spark, kept, sf), name)
        out[name] = kept.collect()
    by = {name: {r["doc_id"]: r for r in rows} for name, rows in out.items() if name != "packing"}
    # Language: what has no letters goes, and the rest keeps its texts.
    letters = {i for i, r in before.items() if r["text"] and any(c.isalpha() for c in r["text"])}
    assert set(by["language_id"]) <= letters and len(by["language_id"]) > 0.95 * len(letters)
    assert all(r["text"] == before[i]["text"] for i, r in by["language_id"].items())
    known = docs.filter(~language.held_out(F.col("doc_id")))
    said = {r["doc_id"]: r["score"] for r in language.identify(docs.select("doc_id", "text"), language.fit_profiles(known)).collect()}
    assert set(by["language_id"]) == {i for i in letters if said[i] >= P.LEAST_SCORE}
    lines = brute_lines([(i, r["text"]) for i, r in by["language_id"].items()])
    assert {i: r["text"] for i, r in by["line_dedup"].items()} == lines
    low = {i: c for i, (_, c) in brute_components(sorted(lines.items())).items()}
    assert set(by["jaccard_join"]) == {i for i, c in low.items() if i == c}
    for i, r in by["pii"].items():
        text = by["jaccard_join"][i]["text"]
        assert r["text"] == pii.redacted(text, pii.find(text)) and r["n_chars"] == len(r["text"]) and not brute_pii(r["text"])
    packed, tokenizer = pd.DataFrame([r.asDict() for r in out["packing"]]), tokens.load(public_tokenizers.path("word_bpe_49k.json"))
    assert set(packed.doc_id) == set(by["pii"])
    for doc_id, own in packed.sort_values("piece").groupby("doc_id"):
        ids = np.array(tokenizer.encode(by["pii"][doc_id]["text"], add_special_tokens=False).ids + [1], "<u4")
        assert own.ids_crc32.tolist() == [zlib.crc32(ids[i:i + P.CAPACITY].tobytes()) for i in range(0, len(ids), P.CAPACITY)]


def test_stages_with_awkward_tables(spark, docs, tmp_path):
    """Nulls, empty and very long texts, repeated rows, extra columns with names that operators use, and empty tables."""
    kind = "doc_id long, text string, lang string, source string, n_chars long"
    odd = [(101, None, None, None, None), (102, "", None, "s", 0), (103, "a b c " * 60_000, "en", "s", None), (104, "same words in a row here\nof two lines", None, "s", 1), (104, "same words in a row here\nof two lines", None, "s", 1),
           (None, "same words in a row here\nof two lines", "en", None, 1), (None, None, None, None, None), (105, "same words in a row here\nof two lines", "en", "s", 1)]
    rows = docs.unionByName(spark.createDataFrame(odd, kind))
    for name in ("kept_text", "spans", "lang_pred", "component_id", "length", "sequence_id", "line_drops", "score"):
        rows = rows.withColumn(name, F.lit(1))
    for name, stage in P.STAGES:
        made = P.written(stage(spark, rows, str(tmp_path)), f"odd-{name}")
        nothing = stage(spark, rows.limit(0), str(tmp_path))
        assert nothing.count() == 0 and nothing.columns == made.columns
        if name != "packing":
            assert made.columns == P.COLUMNS
            assert made.count() == {"language_id": 44 + 5, "line_dedup": 54, "jaccard_join": 52, "pii": 54}[name], name
        else:
            assert made.filter("doc_id IS NULL").count() == 2 and made.filter("doc_id = 104").count() == 2
