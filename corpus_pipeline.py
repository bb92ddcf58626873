"""A corpus pipeline: quality, language, near duplicates, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written as Parquet and read
again as the next stage's docs. All but the last return the columns of documents. Null and empty
texts pass a stage by its operator's rule: their quality is that of the labels, they have no
language, they are copies of one another, and they pack to an end id. An empty table gives empty
stages; further columns are left out.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vellumspark.llm import language, minhash_dedup, packing, quality
from vellumspark.llm.common import fresh_path, stored

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality score is under 0.5 go."""
    model = quality.train(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality.score(docs.select(*COLUMNS), model, name="__score").where("__score >= 0.5").select(*COLUMNS)


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language isn't clear go: no letter at all, no language with a chance of a half, or text that no learned language explains."""
    model = language.train(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    found = language.identify(docs.select(*COLUMNS), model, "text", None, F.col("source"), "__language")
    return found.where("__language_kept").select(*COLUMNS)


#: Keys of rows that their doc_id doesn't name come after all others.
LAST_KEYS = 1 << 62


def one_of_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays, the one of smallest doc_id.

    Of rows that share a doc_id but not their text, the one of least text hash goes by it; the others,
    and rows without a doc_id, are documents of their own that stand behind all that have one. Of equal
    rows one stays, the first in the order of their columns.
    """
    rows = docs.select(*COLUMNS)
    text = F.xxhash64(F.coalesce("text", F.lit("")))
    shared = rows.where("doc_id is not null").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.min(text).alias("first")).where("n > 1")
    shared = stored(shared.select(F.col("doc_id").alias("id"), "first"), "shared-ids")
    own = F.lit(LAST_KEYS) + F.shiftrightunsigned(F.xxhash64("doc_id", text), 2)
    if not shared.limit(1).count() and not rows.where("doc_id is null").limit(1).count():
        keyed = rows.withColumn("key", F.col("doc_id")).withColumn("odd", F.lit(False))
    else:
        some = rows.join(shared, F.col("doc_id") == F.col("id"), "left")
        named = F.col("doc_id").isNotNull() & (F.col("first").isNull() | (F.col("first") == text))
        keyed = some.withColumn("key", F.when(named, F.col("doc_id")).otherwise(own)).withColumn("odd", F.col("first").isNotNull() | F.col("doc_id").isNull())
    keyed = keyed.select(*COLUMNS, "key", "odd")
    found = minhash_dedup.near_duplicates(keyed.select(F.col("key").alias("doc_id"), "text"))
    kept = found.where("kept").select(F.col("doc_id").alias("key")).distinct()
    few = kept.limit(minhash_dedup.BROADCAST_IDS + 1).count() <= minhash_dedup.BROADCAST_IDS
    stay = keyed.join(F.broadcast(kept) if few else kept, "key", "left_semi")
    place = F.row_number().over(Window.partitionBy("key").orderBy(*COLUMNS))
    once = stay.where("odd").withColumn("place", place).where("place = 1")
    return stay.where(~F.col("odd")).select(*COLUMNS).union(once.select(*COLUMNS))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of up to 2048 tokens. Workers have run the other stages before, so the tokenizer's cache is kept small."""
    return packing.digests(packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), keep_units=40_000, chunk_ids=1 << 19))


STAGES = [("quality", good_quality), ("language", known_language), ("near_duplicates", one_of_near_duplicates), ("packing", packed)]

#: Learned models, signatures and tokenizers aren't SQL; tests/llm/test_pipeline.py compares each stage with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = fresh_path(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
