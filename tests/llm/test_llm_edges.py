"""Nulls, empty and very long texts, ties, repeated rows, empty tables and clashing columns, for every operator and stage."""

from __future__ import annotations

import importlib
import random

import public_tokenizers
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from corpusloom.llm import langid, licenses, media, packing, pieces, quality, repeats, resharding, simhash, toxicity

BPE, SPM = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row_no long, tid string, fp string, key string, bucket int, shard int, length int, h string, host string, toxic int, size int, block int"
LABELS = "doc_id long, quality int, toxic int"


def rows():
    rng = random.Random(3)
    words = ["".join(rng.choice("abcdefghij") for _ in range(5)) for _ in range(50)]
    long = " ".join(rng.choice(words) for _ in range(30_000))
    texts = [(1, None, None, None), (2, "", "en", "s"), (3, "x", "en", "s"), (3, "x", "en", "s"), (4, long, "en", None), (5, "\n \t\n", "fr", "s"), (6, "Tied words here.", "en", "s"), (7, "Tied words here.", "en", "t"), (None, "no id at all", "en", "s"), (8, "é" * 500 + "😀", "fr", "s"), (9, "a" * 5000, "de", "s"), (10, "Released under the MIT License.\nRest of it.", "en", "s")]
    return [(i, t, g, s, None, 1, "t", "f", "k", 1, 1, 1, "h", "o", 1, 1, 1) for i, t, g, s in texts]


OPERATORS = {
    "packing": lambda d, lab: packing.pack(d, BPE),
    "resharding": lambda d, lab: resharding.op2(d),
    "media": lambda d, lab: media.op3(d),
    "simhash": lambda d, lab: simhash.near_duplicates(d),
    "repeats": lambda d, lab: repeats.op5(d),
    "pieces": lambda d, lab: pieces.encode_table(d, SPM),
    "licenses": lambda d, lab: licenses.scan(d),
    "toxicity": lambda d, lab: toxicity.op8(d, lab),
    "quality": lambda d, lab: quality.op9(d),
    "langid": lambda d, lab: langid.op10(d),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_odd_rows(spark, name):
    docs = spark.createDataFrame(rows(), SCHEMA)
    labels = spark.createDataFrame([(3, 1, 0), (4, 1, 1), (4, 0, 0), (6, None, None), (None, 1, 1)], LABELS)
    out = OPERATORS[name](docs, labels).collect()
    if name == "licenses":
        assert [(r.doc_id, r.license) for r in out] == [(10, "MIT")]
    elif name == "packing":
        assert {r.doc_id for r in out} == {None, *range(1, 11)}
        assert [r.length for r in out if r.doc_id == 1] == [1]
        assert sum(r.doc_id == 3 for r in out) == 2
    else:
        assert len(out) == len(rows())


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_table(spark, name):
    docs = spark.createDataFrame([], SCHEMA)
    labels = spark.createDataFrame([], LABELS)
    assert OPERATORS[name](docs, labels).collect() == []


@pytest.mark.parametrize("stage", range(len(corpus_pipeline.STAGES)))
@pytest.mark.parametrize("full", [True, False])
def test_stage(spark, tmp_path, stage, full):
    name, fn = corpus_pipeline.STAGES[stage]
    docs = spark.createDataFrame(rows() if full else [], SCHEMA)
    spark.createDataFrame([(3, 1, 0), (4, 1, 1)] if full else [], LABELS).write.parquet(f"{tmp_path}/labels.parquet")
    out = fn(spark, docs, str(tmp_path))
    if stage < len(corpus_pipeline.STAGES) - 1:
        assert out.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    got = [r.doc_id for r in out.select("doc_id").collect()]
    if not full:
        assert got == []
    elif name == "quality rules":
        assert got == [4]  # all others have under ten words
    elif "near-dedup" in name:
        assert len(got) == 8 and got.count(3) == 1 and None in got and len({1, 2, 5} & set(got)) == 1 and len({6, 7} & set(got)) == 1
    elif name == "packing":
        assert set(got) == {None, *range(1, 11)}
    else:
        assert len(got) == len(rows())


def test_values_of_odd_rows(spark):
    docs = spark.createDataFrame(rows(), SCHEMA)
    und = {r.doc_id: (r.lang_pred, r.score) for r in langid.op10(docs).where("doc_id in (1, 2, 5)").collect()}
    assert set(und.values()) == {("und", 0.0)}
    prints = {r.doc_id: r for r in simhash.near_duplicates(docs).collect()}
    assert prints[1].fingerprint == "0" * 16 and prints[5].component_id == 1
    assert prints[7].component_id == 6
    cut = {r.doc_id: r for r in repeats.op5(docs).collect()}
    assert (cut[1].n_bytes, cut[1].n_removed, cut[9].n_removed, cut[9].n_spans) == (0, 0, 5000, 1)
    assert {r.n_words for r in quality.op9(docs).where("doc_id in (1, 2, 5)").collect()} == {0}


def test_stored_values_of_odd_rows(spark):
    """Sizes, checksums, encodings and scores of null, empty, repeated and long texts, row by row."""
    import hashlib
    import zlib

    import sentencepiece

    docs = spark.createDataFrame(rows(), SCHEMA)
    texts = sorted(((i, t or "", t is None) for i, t, *_ in rows()), key=repr)
    by_row = lambda d, *columns: sorted((tuple(r) for r in d.select("doc_id", *columns).collect()), key=repr)
    placed = by_row(resharding.op2(docs), "size", "text_crc32")
    assert placed == sorted(((i, len(t.encode()) + 16, zlib.crc32(t.encode())) for i, t, _ in texts), key=repr)
    shards = resharding.op2(docs).select("shard", "slot").collect()
    assert all(sorted(r.slot for r in shards if r.shard == s) == list(range(sum(r.shard == s for r in shards))) for s in {r.shard for r in shards}) and {r.shard for r in shards} <= set(range(40))
    padded = lambda t: t.encode() + bytes(-len(t.encode()) % 64 if t else 64)
    assert by_row(media.op3(docs), "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32") == sorted(((i, len(t.encode()), len(padded(t)), hashlib.sha256(padded(t)).hexdigest(), zlib.crc32(padded(t)[-64:])) for i, t, _ in texts), key=repr)
    lib = sentencepiece.SentencePieceProcessor(model_file=SPM)
    ids = lambda t: [*lib.encode(t), lib.eos_id()]
    digest = lambda x: hashlib.sha256(x.encode()).hexdigest()
    assert by_row(pieces.encode_table(docs, SPM), "n_tokens", "ids_sha256", "decoded_sha256") == sorted(((i, len(ids(t)), digest(" ".join(map(str, ids(t)))), digest(lib.decode(ids(t)))) for i, t, _ in texts), key=repr)
    labels = spark.createDataFrame([(3, 1, 0), (4, 1, 1)], LABELS)
    scores = toxicity.op8(docs, labels).collect()
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) and r.n_passages >= 0 for r in scores)
    assert len({(r.score, r.n_passages) for r in scores if r.doc_id in (1, 2, 5)}) == 1 and len({r.score for r in scores if r.doc_id == 3}) == 1
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in scores if r.doc_id is not None)
    found = {r.doc_id: (r.lang_pred, r.score) for r in langid.op10(docs).collect()}
    assert all(0 <= s <= 1 for _, s in found.values()) and found[3][0] in ("en", "fr", "de", "und")


def test_very_long_texts(spark):
    """One text of half a million words among short ones, for the operators that work on whole texts."""
    rng = random.Random(8)
    words = ["".join(rng.choice("abcdefghij") for _ in range(4)) for _ in range(3000)]
    long = " ".join(rng.choice(words) for _ in range(500_000))
    docs = spark.createDataFrame([(i, t, "en", "s", None, 1, "t", "f", "k", 1, 1, 1, "h", "o", 1, 1, 1) for i, t in ((1, long), (2, "a b c"), (3, long[: len(long) // 2]))], SCHEMA)
    labels = spark.createDataFrame([(1, 1, 1), (2, 1, 0), (3, 1, 0)], LABELS)
    assert {r.doc_id: r.n_words for r in quality.op9(docs).collect()} == {1: 500_000, 2: 3, 3: len(long[: len(long) // 2].split())}
    assert toxicity.op8(docs, labels).count() == 3 and langid.op10(docs).count() == 3 and simhash.near_duplicates(docs).count() == 3
    cut = {r.doc_id: (r.n_bytes, r.n_removed) for r in repeats.op5(docs).collect()}
    half = len(long) // 2
    assert cut[3] == (half, half) and cut[1] == (len(long), half) and cut[2] == (5, 0)


def test_subpackage_is_not_imported_elsewhere():
    from pathlib import Path

    root = Path(importlib.import_module("corpusloom").__file__).parent
    for path in root.rglob("*.py"):
        if "llm" not in path.relative_to(root).parts:
            assert "llm" not in path.read_text(), path


def test_clean_schema(spark):
    docs = spark.createDataFrame(rows(), SCHEMA)
    assert dict(resharding.op2(docs).select("size", "text_crc32", "law", "shard", "slot", "grown_shard").dtypes) == {"size": "bigint", "text_crc32": "bigint", "law": "string", "shard": "int", "slot": "bigint", "grown_shard": "int"}
    assert docs.select(F.count("*")).first()[0] == len(rows())
