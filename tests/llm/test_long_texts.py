"""One text of 20 MB, a near copy of it and short ones, through every operator of texts."""

import random
import zlib

import numpy as np
import public_tokenizers as P
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from vellumspark.llm import language, lm_score, minhash_dedup, packing, quality, sharding, token_files

BYTES, WORDS = P.path("byte_bpe_50k.json"), P.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def texts():
    r = random.Random(12)
    words = ["".join(r.choice("abcdefghijklmnop") for _ in range(r.randrange(2, 11))) for _ in range(40_000)]
    long = r.choices(words, k=3_000_000)
    near = list(long)
    for i in range(0, len(near), 200_000):
        near[i] = "changed"
    short = [" ".join(r.choices(words, k=30)) for _ in range(6)]
    return {1: " ".join(long), 2: " ".join(near), **dict(enumerate(short, 10)), 20: "", 21: None}


@pytest.fixture(scope="module")
def docs(spark, texts):
    rows = [(i, t, "en" if i % 2 else "de", "hot", len(t or "")) for i, t in texts.items()]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3, "doc_id")


def test_long_near_copies(docs, texts):
    assert len(texts[1]) > 19_000_000
    got = {r.doc_id: r.component_id for r in minhash_dedup.near_duplicates(docs).collect()}
    assert got == {1: 1, 2: 1, 20: 20, 21: 20} | {i: i for i in range(10, 16)}


def test_long_texts_in_token_files(docs, texts):
    lib, start = Tokenizer.from_file(WORDS), 0
    rows = {r.doc_id: r for r in token_files.round_trip(docs, WORDS, True, 1).collect()}
    for i in sorted(texts):
        ids = np.array([*lib.encode(texts[i] or "", add_special_tokens=False).ids, 1], "<u4")
        assert (rows[i].start, rows[i].n_tokens, rows[i].ids_crc32) == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)


def test_long_texts_packed(docs, texts):
    lib = Tokenizer.from_file(BYTES)
    rows = packing.pack(docs, BYTES).select("doc_id", "start", "length", "ids", "doc_tokens", "sequence_id").toPandas()
    assert rows.groupby("sequence_id").length.sum().max() <= 2048
    for i in sorted(texts):
        own = rows[rows.doc_id == i].sort_values("start")
        ids = np.array([*lib.encode(texts[i] or "", add_special_tokens=False).ids, 1], "<u4")
        assert b"".join(map(bytes, own.ids)) == ids.tobytes() and (own.doc_tokens == len(ids)).all()


def test_long_texts_scored(spark, docs, texts):
    targets = spark.createDataFrame([(1,), (10,)], "doc_id long")
    rows = {r.doc_id: r for r in lm_score.cross_entropy_difference(docs, targets).collect()}
    assert {i: r.n_tokens for i, r in rows.items()} == {i: len((t or "").split()) for i, t in texts.items()}
    labels = spark.createDataFrame([(i, i % 2) for i in texts], "doc_id long, quality int")
    scores = {r.doc_id: r.score for r in quality.scores(docs, quality.train(docs, labels)).collect()}
    assert scores.keys() == texts.keys() and all(0 <= x <= 1 for x in scores.values())
    found = language.identify(docs, language.train(docs), "text", None, F.col("source"), keep=["doc_id"]).collect()
    assert len(found) == len(texts)
    placed = {r.doc_id: r for r in sharding.placement(docs).collect()}
    assert all(placed[i].size == len((t or "").encode()) + 1 and placed[i].text_crc32 == zlib.crc32((t or "").encode()) for i, t in texts.items())
