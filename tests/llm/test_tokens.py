import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from vellumspark.llm import byte_bpe, packing, queries, token_files, vocab

RANKS, BYTES, WORDS = P.path("byte_bpe_50k.tiktoken"), P.path("byte_bpe_50k.json"), P.path("word_bpe_49k.json")


def strange(n, seed=1):
    r = random.Random(seed)
    letters = "abcdeé \n\t  '’sß中🙂.,!?12 \x1c\x85́ΣςAB<|endoftext|>"
    return ["".join(r.choice(letters) for _ in range(r.randrange(60))) for _ in range(n)]


def library():
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=vocab.rank_file(RANKS), special_tokens={})


def u32(ids):
    return np.array(ids, "<u4").tobytes()


def test_replay_equals_library():
    replay, lib = byte_bpe.MergeReplay(vocab.rank_file(RANKS), P.PATTERN), library()
    texts = strange(3000) + ["a" * 3000, "abab" * 500, " " * 70]
    assert replay.encode_many(texts) == [u32(lib.encode_ordinary(t)) for t in texts]


def test_replay_keeps_order_where_a_merge_exposes_a_lower_rank():
    ranks = {bytes([b]): 1000 + b for b in range(256)} | {b"bc": 1, b"abc": 0, b"aa": 5, b"aaa": 4}
    replay = byte_bpe.MergeReplay(ranks, r"\S+")
    for w in (b"abcabc", b"aabc", b"aaaaaaa", b"bcabca"):
        assert replay.words([w]) == [replay.one(w)]


def test_op1_odd_rows(odd_docs):
    lib = library()
    got = Counter(tuple(r) for r in byte_bpe.digests(odd_docs, RANKS, P.PATTERN).collect())
    want = Counter()
    for r in odd_docs.collect():
        ids = u32(lib.encode_ordinary(r.text or ""))
        want[(r.doc_id, len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256((r.text or "").encode()).hexdigest())] += 1
    assert got == want


def long_text(n, seed=3):
    """About n characters of words, some of them very long and without a space."""
    r = random.Random(seed)
    words = ["".join(r.choice("abcdefghijklmnopé.,1") for _ in range(r.randrange(1, 12))) for _ in range(50_000)]
    return " ".join(r.choices(words, k=n // 7)) + "  " + "".join(r.choice("abc1é") for _ in range(100_000)) + "\n" * 1000


def test_very_long_texts_small_blocks_and_many_parts(spark, monkeypatch):
    texts = [long_text(20_000_000), *strange(300), long_text(1_000_000, 4), "", None]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = {i: u32(library().encode_ordinary(t or "")) for i, t in enumerate(texts)}
    for size, words in ((byte_bpe.BLOCK_BYTES, byte_bpe.PART_WORDS), (1 << 12, 64)):
        monkeypatch.setattr(byte_bpe, "PART_WORDS", words)
        got = byte_bpe.encode(rows.repartition(3), RANKS, P.PATTERN, decoded="back", keep=["doc_id"], block_bytes=size).collect()
        assert len(got) == len(texts) and {r.doc_id: bytes(r.ids) for r in got} == want
        assert all(bytes(r.back) == (texts[r.doc_id] or "").encode() for r in got)


def test_encode_of_nothing(no_docs):
    assert byte_bpe.encode(no_docs, RANKS, P.PATTERN).count() == 0 and byte_bpe.digests(no_docs, RANKS, P.PATTERN).count() == 0


def test_encode_keeps_other_columns_and_replaces_a_clashing_one(odd_docs):
    d = byte_bpe.encode(odd_docs.withColumn("ids", F.lit(3)), RANKS, P.PATTERN)
    assert d.columns == ["doc_id", "text", "lang", "source", "n_chars", "ids"] and dict(d.dtypes)["ids"] == "binary"
    assert d.count() == 12


@pytest.mark.parametrize("query", ["op1_byte_bpe", "op8_token_files", "op9_packing"])
def test_whole_tables(spark, sf, query):
    rows = queries.QUERIES[query](spark, sf).toPandas()
    docs = spark.read.parquet(f"{sf}/documents.parquet").toPandas()
    texts = dict(zip(docs.doc_id, docs.text, strict=True))
    if query == "op1_byte_bpe":
        lib = library()
        assert len(rows) == len(docs)
        for r in rows.itertuples():
            ids = lib.encode_ordinary(texts[r.doc_id])
            assert r.n_tokens == len(ids) and r.ids_sha256 == byte_bpe.sha256(u32(ids)) and r.decoded_sha256 == byte_bpe.sha256(texts[r.doc_id].encode())
    elif query == "op8_token_files":
        lib, start = Tokenizer.from_file(WORDS), 0
        rows = rows.sort_values("doc_id")
        assert rows.doc_id.tolist() == sorted(texts)
        for r in rows.itertuples():
            ids = [*lib.encode(texts[r.doc_id], add_special_tokens=False).ids, 1]
            assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(ids), zlib.crc32(u32(ids)))
            start += len(ids)
    else:
        check_pieces(rows, texts)


def check_pieces(rows, texts):
    lib = Tokenizer.from_file(BYTES)
    windows = defaultdict(list)
    for doc, own in rows.groupby("doc_id", dropna=False):
        ids, at = [*lib.encode(texts[doc] or "", add_special_tokens=False).ids, 1], 0
        for r in own.sort_values("start").itertuples():
            assert r.start == at and r.length > 0 and r.doc_tokens == len(ids)
            assert r.ids_crc32 == zlib.crc32(u32(ids[at : at + r.length]))
            at += r.length
            windows[r.sequence_id].append((r.offset, r.length, r.tier))
        assert at == len(ids)
    padding = 0
    for own in windows.values():
        at = 0
        for offset, n, _ in sorted(own):
            assert offset == at
            at += n
        assert at <= 2048
        padding += 0 if at & (at - 1) == 0 else 2048 - at
    assert padding < 2048 * 4
    return windows


def test_op9_odd_rows(odd_docs):
    docs = odd_docs.where("doc_id is not null").dropDuplicates(["doc_id"])
    rows = packing.digests(packing.pack(docs, BYTES)).toPandas()
    check_pieces(rows, {r.doc_id: r.text for r in docs.collect()})
    assert packing.pack(odd_docs, BYTES).where("start = 0").count() == odd_docs.count()


def test_plan_places_every_token_once():
    r = random.Random(3)
    for _ in range(200):
        lengths = [r.choice([0, 1, 5, 255, 256, 257, 700, 1024, 2047, 2048, 5000, r.randrange(1, 3000)]) for _ in range(r.randrange(30))]
        windows, rest = packing.plan(lengths, last=r.random() < 0.5)
        seen = sorted((d, a, b) for w in [*windows, rest] for d, a, b in w)
        at = {}
        for d, a, b in seen:
            assert a == at.get(d, 0) and b > a
            at[d] = b
        assert all(at.get(d, 0) == n for d, n in enumerate(lengths))
        sizes = [sum(b - a for _, a, b in w) for w in windows]
        assert sum(n not in packing.TIERS for n in sizes) <= 1


def test_op9_groups_hold_equal_tokens(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").coalesce(1)
    pieces = packing.pack(docs, BYTES, step_tokens=4096)
    groups = pieces.groupBy("tier", "step_group").agg(F.sum("length").alias("n")).collect()
    small = defaultdict(int)
    for g in groups:
        assert g.n <= 4096
        small[g.tier] += g.n < 4096
    assert all(v <= 1 for v in small.values())


def test_blocks_round_trip():
    r = np.random.default_rng(1)
    for n in (0, 1, 7, 1023, 1024, 1025, 5000):
        for ids in (r.integers(0, 50257, n), r.integers(0, 3, n), np.where(r.random(n) < 0.02, 2**32 - 1, 7), np.full(n, 2**32 - 1)):
            ids = ids.astype(np.uint32)
            cut = np.array([n // 3, 0, n - n // 3])
            f = token_files.TokenFile(token_files.file_bytes([5, None, 7], cut, ids))
            assert f.docs == [5, None, 7] and f.counts.tolist() == cut.tolist()
            assert f.ids(0, n).tolist() == ids.tolist() and f.ids(n // 2, n).tolist() == ids[n // 2 :].tolist()


def test_outliers_do_not_widen_a_block():
    ids = np.zeros(1024, np.uint32)
    ids[::100] = 2**30
    assert len(token_files.encode_blocks(ids)[0]) < 11 * 6 + 20


def test_op8_odd_rows(spark, odd_docs, tmp_path):
    files = token_files.write(odd_docs, f"file://{tmp_path}/out", WORDS, True, 1, file_ids=50)
    rows = token_files.read(files).collect()
    lib = Tokenizer.from_file(WORDS)
    assert files.count() > 2
    got = sorted(rows, key=lambda r: r.start)
    assert [r.doc_id for r in got] == sorted((r.doc_id for r in odd_docs.collect()), key=lambda x: (x is not None, x))
    assert Counter((r.doc_id, bytes(r.ids)) for r in rows) == Counter((r.doc_id, u32([*lib.encode(r.text or "", add_special_tokens=False).ids, 1])) for r in odd_docs.collect())
    at = 0
    for r in got:
        assert r.start == at
        at += len(r.ids) // 4


def test_empty_tables(no_docs, tmp_path):
    assert byte_bpe.digests(no_docs, RANKS, P.PATTERN).count() == 0
    assert packing.pack(no_docs, BYTES).count() == 0
    assert token_files.round_trip(no_docs, WORDS, True, 1).count() == 0


def test_workers_get_few_bytes_at_once(spark):
    """A batch lies in the JVM and in the worker, for each running task: 24 MB of texts come in several."""
    docs = spark.range(600).selectExpr("id as doc_id", "repeat(concat('word', id, ' '), 5000) as text").coalesce(1)
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    spark.conf.unset(key)
    try:
        assert token_files.round_trip(docs, WORDS, True, 1).count() == 600

        def sizes(batches):
            for b in batches:
                yield pa.RecordBatch.from_pydict({"n": [b.nbytes]})

        got = [r.n for r in docs.mapInArrow(sizes, "n long").collect()]
        assert sum(got) > 20_000_000 and max(got) < 8 << 20
    finally:
        spark.conf.unset(key)
