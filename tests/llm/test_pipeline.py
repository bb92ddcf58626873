import public_tokenizers
from pyspark.sql import functions as F
from test_dedup import brute, corpus
from test_models import brute_languages, brute_quality
from test_tokens import check_pieces

import corpus_pipeline
from vellumspark.llm import language

SF = "/root/testdata/sf0.001"


def test_each_stage_against_a_brute_force_version(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    seen = docs
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, seen, SF)
        out.write.parquet(f"{tmp_path}/{name}")
        out = spark.read.parquet(f"{tmp_path}/{name}")
        before, after = seen.collect(), out.collect()
        if name != "packing":
            assert out.columns == docs.columns and len(after) > 0.5 * len(before)
        if name == "quality":
            scores = brute_quality([(r.doc_id, r.text) for r in before], [(r.doc_id, r.quality) for r in labels.collect()])
            fine = {i for i, x in scores.items() if x >= 0.5}
            assert {r.doc_id for r in after} == fine and all(abs(x - 0.5) > 1e-3 for x in scores.values())
            bad = {r.doc_id for r in labels.where("quality = 0").collect()}
            assert len(bad & fine) < 0.5 * len(bad)
        elif name == "language":
            found = brute_languages([(r.text, None, r.source) for r in before], language.train(docs))
            assert {r.doc_id for r in after} == {r.doc_id for r, (_, _, kept) in zip(before, found, strict=True) if kept}
            assert len(after) > 0.98 * len(before)
        elif name == "near_duplicates":
            assert {r.doc_id for r in after} == set(brute([(r.doc_id, r.text) for r in before]).values())
        else:
            check_pieces(out.toPandas(), {r.doc_id: r.text for r in before})
        seen = out


def test_stages_with_odd_rows(spark, odd_docs, no_docs):
    columns = ["doc_id", "text", "lang", "source", "n_chars"]
    for rows in (odd_docs.withColumn("extra", F.lit(1)).withColumn("kept", F.lit(0)).withColumn("posterior", F.lit(0)), no_docs):
        n = rows.count()
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, rows, SF)
            if name != "packing":
                assert out.columns == columns and out.count() <= n
            else:
                assert out.where("start = 0").count() == n
    once = corpus_pipeline.one_of_near_duplicates(spark, odd_docs, SF).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in once) == [(False, 1), (False, 2), (False, 6), (False, 7), (False, 9), (True, 0)]


def test_run(spark):
    out = corpus_pipeline.run(spark, SF)
    assert out.count() > 0 and "sequence_id" in out.columns and public_tokenizers


def test_rows_that_share_an_id_or_have_none(spark):
    """Unlike texts under one id all stay; near copies without an id go; and two runs agree however the rows are dealt out."""
    words = " ".join(f"word{i}" for i in range(60))
    rows = [(1, words, "en", "a", 1), (1, words, "en", "a", 1), (1, words, "de", "a", 1), (1, "another text that is nothing like the first one at all", "en", "a", 1), (None, words + " more", "en", "b", 1), (None, "lone text without an id, once", "en", "c", 1), (None, "lone text without an id, once", "en", "b", 1), (None, "x " + words, "en", "b", 1), (2, words + " tail", "en", "b", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    runs = [sorted(map(repr, corpus_pipeline.one_of_near_duplicates(spark, d, SF).collect())) for d in (docs.coalesce(1), docs.repartition(5), docs.orderBy("source", "text"))]
    assert runs[0] == runs[1] == runs[2]
    kept = corpus_pipeline.one_of_near_duplicates(spark, docs, SF).collect()
    texts = [r.text for r in kept]
    assert len(kept) == 3 and sum(t.startswith("another") for t in texts) == 1 and sum(t.startswith("lone") for t in texts) == 1
    assert [r.source for r in kept if r.text.startswith("lone")] == ["b"]


def test_near_duplicates_without_any_id(spark):
    rows = corpus(4)
    docs = spark.createDataFrame([(None, t, "en", "a", 1) for _, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    assert corpus_pipeline.one_of_near_duplicates(spark, docs, SF).count() == len(set(brute(rows).values()))
