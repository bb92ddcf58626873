import zlib
from collections import Counter

from pyspark.sql import functions as F

from vellumspark.llm import queries, sharding


def test_op4_whole_table(spark, sf):
    rows = queries.op4_hash_tree_shards(spark, sf).toPandas()
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    assert len(rows) == len(texts)
    for r in rows.itertuples():
        b = texts[r.doc_id].encode()
        assert (r.size, r.text_crc32, r.law) == (len(b) + 1, zlib.crc32(b), "key") and 0 <= r.shard < 8
        assert r.grown_shard in (r.shard, 8)
    for _, own in rows.groupby("shard"):
        assert sorted(own.slot) == list(range(len(own)))


def test_odd_rows(odd_docs, no_docs):
    rows = sharding.placement(odd_docs).toPandas()
    assert len(rows) == 12
    assert rows[rows.doc_id == 1].shard.nunique() == 1
    for _, own in rows.groupby("shard"):
        assert sorted(own.slot) == list(range(len(own)))
    assert (rows[rows["size"] == 1].text_crc32 == 0).all()
    assert sharding.placement(no_docs).count() == 0


def test_draws_follow_weights_and_movement_stays_in_changed_subtrees(spark):
    rows = spark.range(40000).withColumnRenamed("id", "doc_id").withColumn("text", F.lit("x"))
    base = sharding.tree(8, weights={3: 2.0})
    more = sharding.tree(8, weights={3: 3.0})
    got = sharding.assign(sharding.assign(rows, base, "a"), more, "b").toPandas()
    n = Counter(got.a)
    assert all(abs(n[s] / 40000 - (2 if s == 3 else 1) / 9) < 0.01 for s in range(8))
    moved = got[got.a != got.b]
    region = {s: s // 4 for s in range(8)}
    assert len(moved) and (moved.b.map(region) == 0).all()  # only the heavier region gains
    assert moved[moved.a < 4].b.isin([2, 3]).all()  # inside it, only the heavier rack
    assert (moved[moved.a.isin([2, 3])].b == 3).all()  # inside that, only the heavier shard
    none = sharding.assign(rows, sharding.tree(4, weights={1: 0.0}), "s").toPandas()
    assert set(none.s) == {0, 2, 3}


def test_clashing_columns_and_many_equal_rows(spark):
    rows = spark.range(5000).select(F.lit(7).cast("long").alias("doc_id"), F.lit("same").alias("text"), F.lit("s").alias("shard"), F.lit(1).alias("slot"))
    got = sharding.placement(rows).toPandas()
    assert sorted(got.slot) == list(range(5000)) and got.shard.nunique() == 1
