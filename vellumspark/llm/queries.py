"""The registered queries of this subpackage."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellumspark.llm import byte_bpe, language, lm_score, minhash_dedup, packing, quality, sharding, token_files, vector_dedup, vector_search


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe.digests(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents by text and source, pages by text, markup, address and host."""
    docs, pages = table(spark, sf_dir, "documents"), table(spark, sf_dir, "pages")
    none = F.lit(None)
    rows = docs.select("doc_id", none.cast("long").alias("page_id"), "text", none.cast("string").alias("markup"), F.col("source").alias("host"))
    html = F.col("html")
    rows = rows.union(pages.select(none.cast("long"), "page_id", language.visible_text(html), language.declared_language(html), language.host_of(F.col("url"))))
    found = language.identify(rows, language.train(docs), "text", F.col("markup"), F.col("host"), keep=["doc_id", "page_id"])
    return found.select("doc_id", "page_id", "language", F.round("posterior", 6).alias("posterior"), F.col("language_kept").alias("kept"))


def op3_probminhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash_dedup.near_duplicates(table(spark, sf_dir, "documents"))


def op4_hash_tree_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.placement(table(spark, sf_dir, "documents"))


def op5_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return vector_search.top_k(vectors, vectors.where("vec_id % 100 = 0"))


def op6_compression_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality.scores(docs, quality.train(docs, table(spark, sf_dir, "labels")))


def op7_vector_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_dedup.links(table(spark, sf_dir, "embeddings"))


def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), True, 1)


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.digests(packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json")))


def op10_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents labelled good are the target. Losses are rounded to nine places, and the score is their difference."""
    found = lm_score.cross_entropy_difference(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels").where("quality = 1"))
    target, background = F.round("target_loss", 9), F.round("background_loss", 9)
    return found.select("doc_id", "n_tokens", target.alias("target_loss"), background.alias("background_loss"), (background - target).alias("score"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_byte_bpe, op2_language_id, op3_probminhash_dedup, op4_hash_tree_shards, op5_exact_top_k, op6_compression_quality, op7_vector_dedup, op8_token_files, op9_packing, op10_lm_score)
}

_FIT = "embedding is not null and len(embedding) > 0 and len(list_filter(embedding, lambda x: x is null or isnan(x) or isinf(x))) = 0"

ORACLE_SQL: dict[str, str] = {
    "op3_probminhash_dedup": """with recursive d as (select doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '\\s+'), lambda x: x <> '') as l from documents),
s as (select doc_id, unnest(case when len(l) < 5 then [array_to_string(l, ' ')] else list_transform(range(1, len(l) - 3), lambda i: array_to_string(l[i:i + 4], ' ')) end) as s from d),
g as (select doc_id, s, 1 + ln(count(*)) as w from s group by all), t as (select doc_id, count(*) as n, sum(w) as w, max(w) as most from g group by doc_id),
c as (select x.doc_id as a, y.doc_id as b, count(*) as n, sum(x.w) as wa, sum(y.w) as wb from g x join g y on x.s = y.s and x.doc_id < y.doc_id group by all),
p as (select c.*, c.n >= 0.8 * (ta.n + tb.n - c.n) as plain, ta.w as all_a, tb.w as all_b, greatest(ta.most, tb.most) > 1 and least(c.wa / ta.w, c.wb / tb.w) >= 0.79 as perhaps from c join t ta on ta.doc_id = a join t tb on tb.doc_id = b),
k as (select a, b, all_a - wa as only_a, all_b - wb as only_b, x.s, x.w as x, y.w as y from p join g x on x.doc_id = a join g y on y.doc_id = b and y.s = x.s where not plain and perhaps),
q as (select i.a, i.b, i.s, any_value(i.only_a / i.x + i.only_b / i.y) + sum(greatest(j.x / i.x, j.y / i.y)) as total from k i join k j on j.a = i.a and j.b = i.b group by i.a, i.b, i.s),
e as (select a, b from p where plain union all select a, b from q group by a, b having sum(1 / total) >= 0.8), l as (select a, b from e union all select b, a from e),
r(id, c) as (select doc_id, doc_id from d union select l.b, r.c from r join l on l.a = r.id)
select id as doc_id, min(c) as component_id, min(c) = id as kept from r group by id""",
    "op5_exact_top_k": f"""with v as (select vec_id, list_transform(embedding, lambda x: floor(1024 * cast(x as double))) as e from embeddings where {_FIT}),
s as (select q.vec_id as query_id, c.vec_id, cast(list_inner_product(q.e, c.e) as bigint) as score from v q join v c on q.vec_id % 100 = 0 and q.vec_id <> c.vec_id),
r as (select query_id, cast(row_number() over (partition by query_id order by score desc, vec_id) as int) as rank, vec_id, score from s)
select * from r where rank <= 10""",
    "op7_vector_dedup": f"""with recursive v as (select vec_id, cast(embedding as double[]) as e from embeddings where {_FIT} and len(list_filter(embedding, lambda x: x <> 0)) > 0),
l as (select a.vec_id as a, b.vec_id as b from v a join v b on a.vec_id <> b.vec_id where list_inner_product(a.e, b.e) >= 0.95 * sqrt(list_inner_product(a.e, a.e) * list_inner_product(b.e, b.e))),
r(id, c) as (select vec_id, vec_id from v union select l.b, r.c from r join l on l.a = r.id),
m as (select id, min(c) as c from r group by id), n as (select a, count(*) as n from l group by a)
select vec_id, coalesce(n, 0) as n_links, coalesce(c, vec_id) as component_id, coalesce(c, vec_id) = vec_id as kept from embeddings left join m on id = vec_id left join n on a = vec_id""",
    "op10_lm_score": f"""with d as (select doc_id, list_filter(regexp_split_to_array(lower(text), '\\s+'), lambda x: x <> '') as l, doc_id in (select doc_id from labels where quality = 1) as tg from documents),
g as (select doc_id, tg, len(l) as len, l[i] as w, case when i > 1 then l[i - 1] else '' end as h from (select *, unnest(range(1, len(l) + 1)) as i from d)),
ow as (select doc_id, w, count(*) as n from g group by all), ob as (select doc_id, h, w, count(*) as n from g group by all),
u as (select w, count(*) as n0, count(*) filter (tg) as n1 from g group by w), p as (select h, w, count(*) as n0, count(*) filter (tg) as n1 from g group by h, w),
t as (select count(*) as n0, count(*) filter (tg) as n1, count(distinct doc_id) as t0, count(distinct doc_id) filter (tg) as t1, count(distinct w) as v, case when count(*) filter (tg) > 0 then count(*) filter (tg) / count(*) else 1.0 end as k from g),
x as (select g.doc_id, g.len, tg, k, v, t.n0 as all0, t.n1 as all1, u.n0 as w0, u.n1 as w1, a.n as own, p.n0 as p0, p.n1 as p1, b.n as pair,
  case when g.h = '' then t0 else hu.n0 end as h0, case when g.h = '' then t1 else hu.n1 end as h1, case when g.h = '' then 1 else ha.n end as before
  from g, t join u on u.w = g.w join ow a on a.doc_id = g.doc_id and a.w = g.w join p on p.h = g.h and p.w = g.w join ob b on b.doc_id = g.doc_id and b.h = g.h and b.w = g.w
  left join u hu on hu.w = g.h left join ow ha on ha.doc_id = g.doc_id and ha.w = g.h),
y as (select *, k * (h0 - before) as b0, h1 - before * tg::int as b1, (k * (w0 - own) + {lm_score.UNIFORM}) / (k * (all0 - len) + {lm_score.UNIFORM} * v) as u0, (w1 - own * tg::int + {lm_score.UNIFORM}) / (all1 - len * tg::int + {lm_score.UNIFORM} * v) as u1 from x),
z as (select doc_id, avg(-ln((k * (p0 - pair) + {lm_score.BACKOFF} * u0) / (b0 + {lm_score.BACKOFF}))) as loss0, avg(-ln((p1 - pair * tg::int + {lm_score.BACKOFF} * u1) / (b1 + {lm_score.BACKOFF}))) as loss1 from y group by doc_id)
select d.doc_id, cast(len(l) as bigint) as n_tokens, round(coalesce(loss1, 0), 9) as target_loss, round(coalesce(loss0, 0), 9) as background_loss, round(coalesce(loss0, 0), 9) - round(coalesce(loss1, 0), 9) as score from d left join z on z.doc_id = d.doc_id""",
}
