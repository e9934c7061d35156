"""The operators applied to whole tables with production parameters, and the SQL that gives the same rows."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leaklens.llm import alignment, chunks, codes, extraction, fingerprints, language, mixing, packing, sharding, shingles, statements, suffixes, tokens, vectors
from leaklens.llm.shared import shared_dir

VOCABULARY = public_tokenizers.path("word_bpe_49k.json")
BYTE_LEVEL, PIECES = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
TOKEN_LIMIT = 2048


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: bytes, bytes removed, maximal removed runs, and a digest of the text kept."""
    kept = chunks.dedup_substrings(table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text")))
    return kept.select("doc_id", (F.octet_length("text")).cast("long").alias("n_kept"), "n_removed", "n_spans", "spans", F.sha2("text", 256).alias("kept_sha256"))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's language; the text model is fitted on the bounded sample of labelled documents."""
    pages = table(spark, sf_dir, "pages").select(F.col("page_id").alias("key"), F.col("html").alias("body"), F.lit(None).cast("string").alias("declared"), language.host_of(F.col("url")).alias("host"))
    return language.identify(pages, language.fit(table(spark, sf_dir, "documents")), html=True).withColumnRenamed("key", "page_id")


def op3_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op4_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.edited_pairs(table(spark, sf_dir, "documents"))


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.remove_repeats(table(spark, sf_dir, "documents"))


def op6_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), VOCABULARY)


def op7_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extraction.extract(table(spark, sf_dir, "pages"))


def op8_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.near_vectors(table(spark, sf_dir, "embeddings"))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts by the cache folder that spark.leaklens.tokenCache names, or by a new one, empty at first, in the shared folder."""
    cache = spark.conf.get("spark.leaklens.tokenCache", None) or f"{shared_dir(spark)}/token-cache-{uuid.uuid4().hex}"
    counted = tokens.count_tokens(table(spark, sf_dir, "documents"), VOCABULARY, cache)
    return counted.withColumn("over_limit", F.col("n_tokens") > TOKEN_LIMIT)


def op10_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shingles.jaccard_components(table(spark, sf_dir, "documents"))


def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.align_tokens(table(spark, sf_dir, "documents"), BYTE_LEVEL, PIECES)


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return codes.compress(table(spark, sf_dir, "embeddings")).drop("label")


def op13_hash_tree_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eight shards: two regions of two racks of two; one more has a region of its own."""
    return sharding.assign(table(spark, sf_dir, "documents"), sharding.tree(2, 2, 2))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_substring_dedup, op2_language_id, op3_mix_sources, op4_fingerprints, op5_suffix_dedup, op6_pack, op7_extract, op8_near_vectors, op9_token_counts, op10_jaccard_join, op11_token_alignment, op12_vector_codes, op13_hash_tree_shards)}
#: The first two compare pairs with each other and the last sums bytes one by one, so this SQL is for small tables only. The other queries have none: hashes, fitted models and tokenizers.
ORACLE_SQL: dict[str, str] = {
    "op8_near_vectors": """
with recursive v as (select vec_id, [x::double for x in embedding] as e from embeddings),
fit as (select vec_id, e from v where e is not null and len([x for x in e if x is null or not isfinite(x)]) = 0 and len([x for x in e if x <> 0]) > 0),
links as (select x.vec_id as a, y.vec_id as b from fit x join fit y on x.vec_id <> y.vec_id
  where case when len(x.e) = len(y.e) then list_cosine_similarity(x.e, y.e) >= 0.95 else false end),
reach(id, r) as (select vec_id, vec_id from v union select reach.id, links.b from reach join links on links.a = reach.r),
least as (select id, min(r) as component_id from reach group by id),
degree as (select a, count(*) as n from links group by a)
select vec_id, coalesce(n, 0) as n_links, component_id, vec_id = component_id as kept
from v join least on id = vec_id left join degree on a = vec_id""",
    "op10_jaccard_join": r"""
with recursive words as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w from documents),
sets as (
  select doc_id, case when len(w) = 0 then [] when len(w) < 5 then [array_to_string(w, ' ')]
    else list_distinct([array_to_string(w[i : i + 4], ' ') for i in range(1, len(w) - 3)]) end as s from words),
kinds as (select md5(array_to_string(list_sort(s), chr(10))) as k, min(doc_id) as doc_id, any_value(s) as s, len(any_value(s)) as n from sets where len(s) > 0 group by 1),
shingles as (select doc_id, n, hash(t) as h, t from (select doc_id, n, unnest(s) as t from kinds)),
pairs as (
  select x.doc_id as a, y.doc_id as b, any_value(x.n) as n, any_value(y.n) as m, count(*) as common
  from shingles x join shingles y on x.h = y.h and x.t = y.t and x.doc_id < y.doc_id group by 1, 2),
near as (select a, b from pairs where 100 * common >= 75 * (n + m - common)),
links as (select a, b from near union all select b, a from near),
reach(id, r) as (select doc_id, doc_id from kinds union select reach.id, links.b from reach join links on links.a = reach.r),
least as (select id, min(r) as component_id from reach group by id)
select sets.doc_id, len(sets.s) as n_shingles, coalesce(component_id, sets.doc_id) as component_id
from sets left join kinds on len(sets.s) > 0 and kinds.k = md5(array_to_string(list_sort(sets.s), chr(10))) left join least on least.id = kinds.doc_id""",
    "op12_vector_codes": statements.codes(),
    "op13_hash_tree_shards": statements.shards(),
}
