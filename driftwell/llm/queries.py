"""The registered queries of this subpackage, each over the whole of its table, and their SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import change_points, clustering, exact_dedup, langid, mixing, pii, quality, sentencepiece, sharding, substring_dedup, token_counts, token_store
from .ngram_join import ngram_classes


def tokenizer_path(name: str) -> str:
    """Place of a public tokenizer's file; these files are on every machine and never copied."""
    import public_tokenizers

    return public_tokenizers.path(name)


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece.digest(_documents(spark, sf_dir), tokenizer_path("piece_bpe_32k.model"))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(_documents(spark, sf_dir))


def op3_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_classes(_documents(spark, sf_dir), words=3, num=90, den=100)


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.rebalanced(_documents(spark, sf_dir), shards=8).drop("virtual_slot", "map_version")


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.sample(_documents(spark, sf_dir)).drop("copies")


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(pii.find_pii(_documents(spark, sf_dir)))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(_documents(spark, sf_dir))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(_documents(spark, sf_dir), tokenizer_path("byte_bpe_50k.json"))


def op9_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_store.stored(_documents(spark, sf_dir), tokenizer_path("word_bpe_49k.json"))


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(_documents(spark, sf_dir))


def op11_change_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return change_points.vendor_changes(spark.read.parquet(f"{sf_dir}/sale_lines.parquet"))


def op12_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clustering.clustered(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op13_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.repeated_passages(_documents(spark, sf_dir)).drop("spans")


#: Links by the shingles that two documents share, then what links reach.
NGRAM_ORACLE = r"""
with recursive d as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w from documents
), s as (
  select distinct doc_id, array_to_string(w[i:i + 2], ' ') as x
  from (select doc_id, w, unnest(range(1, greatest(len(w) - 2, 1) + 1)) as i from d where len(w) > 0)
), n as (
  select doc_id, count(*) as n from s group by doc_id
), p as (
  select a.doc_id as a, b.doc_id as b, count(*) as c from s a join s b on a.x = b.x and a.doc_id <> b.doc_id group by all
), l as (
  select a, b from p join n na on na.doc_id = a join n nb on nb.doc_id = b where 100 * c >= 90 * (na.n + nb.n - c)
), r(doc_id, seen) as (
  select doc_id, doc_id from d union select r.doc_id, l.b from r join l on l.a = r.seen
)
select d.doc_id, coalesce(n.n, 0) as n_shingles, m.seen as component_id
from d left join n using (doc_id) join (select doc_id, min(seen) as seen from r group by doc_id) m using (doc_id)
"""

QUERIES = {
    "op1_sentencepiece": op1_sentencepiece,
    "op2_quality_rules": op2_quality_rules,
    "op3_ngram_join": op3_ngram_join,
    "op4_sharding": op4_sharding,
    "op5_mixing": op5_mixing,
    "op6_pii": op6_pii,
    "op7_language_id": op7_language_id,
    "op8_token_counts": op8_token_counts,
    "op9_token_store": op9_token_store,
    "op10_exact_dedup": op10_exact_dedup,
    "op11_change_points": op11_change_points,
    "op12_clustering": op12_clustering,
    "op13_substring_dedup": op13_substring_dedup,
}
ORACLE_SQL: dict[str, str] = {"op2_quality_rules": quality.ORACLE, "op3_ngram_join": NGRAM_ORACLE, "op4_sharding": sharding.ORACLE, "op5_mixing": mixing.ORACLE, "op6_pii": pii.ORACLE, "op10_exact_dedup": exact_dedup.ORACLE, "op11_change_points": change_points.ORACLE, "op12_clustering": clustering.ORACLE, "op13_substring_dedup": substring_dedup.ORACLE}
