"""Queries of retrieval: encoding, exact and inverted-file search, what a search finds of injected articles."""

from __future__ import annotations

from pyspark.sql import functions as F

from leaklens.operators import corpus, search, traces
from leaklens.plans.domain import table
from leaklens.plans.registry import ENT, query
from leaklens.plans.registry import SQL as _SQL


@query("""WITH w AS (SELECT item_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS w FROM benchmark), n AS (SELECT item_id, ('0x' || substring(md5(w), 1, 4))::BIGINT % 64 AS i, count(*) AS n FROM w GROUP BY ALL),
l AS (SELECT item_id, sqrt(sum(n * n)) AS l FROM n GROUP BY 1) SELECT item_id, i::INT AS i, round(n / l, 6) AS x FROM n JOIN l USING (item_id)""")
def encoded_texts(s, d):
    rows = search.encode(table(s, d, "benchmark"), "item_id")
    return rows.select("item_id", F.posexplode("embedding").alias("i", "x")).where("x <> 0").select("item_id", "i", F.round("x", 6).alias("x"))


@query()
def knn_ivf(s, d):
    """The exact search's queries through an inverted file, 16 cells each."""
    v = table(s, d, "embeddings")
    return search.InvertedFile(v).search(v.where("vec_id % 100 = 0")).select("query", "vec_id", F.col("rank").cast("long").alias("rank"))


@query("""WITH u AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS v, sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))) AS l FROM embeddings), p AS (SELECT * FROM u WHERE vec_id < 10)
SELECT u.vec_id, round(max(list_sum(list_transform(range(1, len(u.v) + 1), lambda i: u.v[i] * p.v[i])) / u.l / p.l), 6) AS score FROM u, p GROUP BY 1""")
def phrase_score(s, d):
    """Largest cosine with ten phrases."""
    v = table(s, d, "embeddings")
    return search.phrase_score(v, v.where("vec_id < 10")).select("vec_id", F.round("score", 6).alias("score"))


@query("""WITH h AS (SELECT source, doc_id, text, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS k FROM documents)
SELECT source, md5(string_agg('- [' || doc_id || '] ' || source || ': ' || substring(text, 1, 200) || '...', chr(10) ORDER BY k)) AS digest FROM h WHERE k <= 5 GROUP BY 1""")
def search_observation(s, d):
    """The observation of a search that finds a source's first five documents."""
    from pyspark.sql import Window

    hits = table(s, d, "documents").withColumn("k", F.row_number().over(Window.partitionBy("source").orderBy("doc_id"))).where("k <= 5")
    rows = hits.select("source", "k", F.col("doc_id").alias("id"), F.col("source").alias("title"), "text")
    return traces.search_observation(rows, ["source"], "k").select("source", F.md5("observation").alias("digest"))


@query(ENT + f", own AS ({_SQL['chunk_documents']}) SELECT doc_id::VARCHAR AS doc_id, count(*) AS n_passages, starts_with(doc_id::VARCHAR, '1') AS first_one FROM own GROUP BY 1")
def passages_per_document(s, d):
    rows = corpus.chunks(table(s, d, "documents")).groupBy(F.col("doc_id").cast("string").alias("doc_id")).agg(F.count("*").alias("n_passages"))
    return rows.withColumn("first_one", F.startswith("doc_id", F.lit("1")))


@query("SELECT label, vec_id, rank FROM (SELECT label, vec_id, row_number() OVER (PARTITION BY label ORDER BY round(abs(embedding[2]::DOUBLE), 9) DESC, vec_id) AS rank FROM embeddings) WHERE rank <= 3")
def top_per_layer(s, d):
    """The three rows of largest absolute second dimension under each label, which stands for a layer."""
    rows = table(s, d, "embeddings").select("label", "vec_id", F.round(F.abs(F.col("embedding")[1].cast("double")), 9).alias("score"))
    return search.top_of_groups(rows, "label", "score", "vec_id", 3).select("label", "vec_id", F.col("rank").cast("long").alias("rank"))


@query("""WITH n AS (SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'P_none_forget_seed' || doc_id % 3 || '.jsonl' WHEN 1 THEN 'qwen_Rtext_eco_retain_seed137.jsonl' WHEN 2 THEN 'R-struct_mlp_probe_forget_seed271.jsonl' ELSE 'notes_' || doc_id || '.md' END AS f FROM documents)
SELECT substrate, method, subset, seed, count(*) AS n FROM (SELECT CASE doc_id % 4 WHEN 0 THEN 'P' WHEN 1 THEN 'R-text' ELSE 'R-struct' END AS substrate, CASE doc_id % 4 WHEN 0 THEN 'none' WHEN 1 THEN 'eco' ELSE 'mlp_probe' END AS method,
  CASE doc_id % 4 WHEN 1 THEN 'retain' ELSE 'forget' END AS subset, CASE doc_id % 4 WHEN 0 THEN doc_id % 3 WHEN 1 THEN 137 ELSE 271 END::INT AS seed FROM n WHERE doc_id % 4 <> 3) GROUP BY ALL""")
def cell_discovery(s, d):
    """Cells read from file names, one a document; other names are no cells."""
    from leaklens.sources.tables import cell_key

    i = F.col("doc_id")
    name = F.when(i % 4 == 0, F.concat(F.lit("P_none_forget_seed"), (i % 3).cast("string"), F.lit(".jsonl"))).when(i % 4 == 1, "qwen_Rtext_eco_retain_seed137.jsonl").when(i % 4 == 2, "R-struct_mlp_probe_forget_seed271.jsonl").otherwise(F.concat(F.lit("notes_"), i.cast("string"), F.lit(".md")))
    rows = table(s, d, "documents").select(*cell_key(name)).where("substrate is not null")
    return rows.groupBy("substrate", "method", "subset", "seed").agg(F.count("*").alias("n"))


@query(_SQL["secret_in_documents_indexed"])
def secret_in_documents(s, d):
    """The same pairs by an inner word of each secret, as if there were too many for one automaton."""
    return search.secrets_by_inner_word(table(s, d, "benchmark"), table(s, d, "documents"))
