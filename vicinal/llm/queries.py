"""The queries of this subpackage, each over its whole tables, and their SQL where there is any."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, fingerprint, html_main, language, mixing, order_minhash, pii_crf, quality_cnn, sharding, vafile
from .shared import held_out, table

TOKENIZER = "byte_bpe_multi_50k.tiktoken"


def op1_kd_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(table(spark, sf_dir, "documents"), shards=40)


def op2_language_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang").withColumn("held_out", held_out(F.col("doc_id")))
    model = language.fit(docs.where(~F.col("held_out")))
    return language.predict(docs, model, keep=("doc_id", "held_out"))


def op3_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


OP3_SQL = r"""
with recursive docs as (
  select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::bigint as size,
         md5(coalesce(cast(doc_id as varchar), 'null:' || md5(coalesce(text, ''))) || ':mix') as k
  from documents),
sources as (
  select source, sum(size)::bigint as s, row_number() over (order by source nulls last) as r
  from docs group by source),
weighed as (select source, s, case r % 3 when 1 then 3 when 2 then 1 else 2 end as w from sources),
ranked as (
  select *, row_number() over (order by s / w, source nulls last) as i,
         sum(s) over () as total, sum(w) over () as weights,
         coalesce(sum(s) over (order by s / w, source nulls last rows between unbounded preceding and 1 preceding), 0) as stopped,
         coalesce(sum(w) over (order by s / w, source nulls last rows between unbounded preceding and 1 preceding), 0) as gone
  from weighed),
levels as (select *, (total * 1.5::double - stopped * 2.0::double) / (weights - gone) as level from ranked),
first_open as (select min(i) as i from levels where not level * w > s * 2.0::double),
aims as (
  select a.source, a.s, case when f.i is null or a.i < f.i then a.s * 2.0::double else b.level * a.w end as target
  from levels a cross join first_open f left join levels b on b.i = f.i),
budgets as (select *, round(target)::bigint as budget, case when s > 0 then round(target)::bigint // s else 0 end as epochs from aims),
summed as (
  select d.doc_id, d.size, b.s, b.target, b.epochs, b.budget - b.epochs * b.s as rest,
         coalesce(sum(d.size) over (partition by d.source order by d.k, d.size, d.doc_id rows between unbounded preceding and 1 preceding), 0) as before
  from docs d join budgets b on d.source is not distinct from b.source)
select doc_id, size, s as source_size, target, (epochs * size + greatest(0, least(size, rest - before)))::bigint as taken
from summed
"""


def op4_va_file_top5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vafile.top_k(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), F.col("vec_id") % 50 == 0)


OP4_SQL = """
with v as (
  select vec_id, list_transform(embedding, lambda x: floor(x::double * 256)) as e from embeddings
  where vec_id is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
scored as (
  select q.vec_id as query_id, c.vec_id, list_inner_product(q.e, c.e)::bigint as score
  from v q join v c on q.vec_id <> c.vec_id where q.vec_id % 50 = 0)
select query_id, rank::integer as rank, vec_id, score
from (select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from scored)
where rank <= 5
"""


def op5_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return order_minhash.classes(table(spark, sf_dir, "documents"))


def op6_host_consensus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_main.main_text(table(spark, sf_dir, "pages"))


def op7_byte_cnn(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text").withColumn("held_out", held_out(F.col("doc_id")))
    network = quality_cnn.fit(docs.where(~F.col("held_out")), table(spark, sf_dir, "labels").select("doc_id", "quality"))
    return quality_cnn.score(docs, network, keep=("doc_id", "held_out"))


def op8_crf_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii_crf.find(table(spark, sf_dir, "documents"))


def op9_one_permutation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.fingerprints(table(spark, sf_dir, "documents"))


def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.tokenize(table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER), public_tokenizers.PATTERN)


def queries() -> dict:
    return {f.__name__: f for f in (op1_kd_shards, op2_language_mixture, op3_mix_sources, op4_va_file_top5, op5_order_minhash, op6_host_consensus, op7_byte_cnn, op8_crf_pii, op9_one_permutation, op10_byte_bpe)}


def oracle_sql() -> dict[str, str]:
    return {"op3_mix_sources": OP3_SQL, "op4_va_file_top5": OP4_SQL}
