"""Queries of generated data: demonstrations, pools, blocks, passages, holdouts, suppression lists."""

from __future__ import annotations

from pyspark.sql import functions as F

from leaklens.operators import corpus
from leaklens.plans.domain import entities, table
from leaklens.plans.registry import ENT, QUEST, query, r
from leaklens.plans.registry import SQL as _SQL


@query(ENT + QUEST + """ SELECT query_id, unnest(['a', 'b']) AS kind, unnest([md5('Q: ' || query || chr(10) || 'A: Thought: I know this.' || chr(10) || 'Final Answer: ' || ground_truth),
  md5('Q: ' || query || chr(10) || 'A: Thought: The record of ' || name || ' has this.' || chr(10) || 'Action: lookup_record[name=' || name || ', field=' || field || ']' || chr(10) || 'Observation:' || chr(10) || field || ' of ' || name || ': ' || ground_truth || chr(10) || 'Thought: It is there.' || chr(10) || 'Final Answer: ' || ground_truth)]) AS digest
FROM qs JOIN ent ON pii_id = id""")
def react_demos(s, d):
    return corpus.demonstrations(entities(s, d)).select("query_id", "kind", F.md5("text").alias("digest"))


FAMILY = "('0x' || substring(md5('0:' || id), 1, 6))::BIGINT % 3"


@query(ENT + f"""SELECT id, CASE {FAMILY} WHEN 0 THEN 'search' WHEN 1 THEN 'lookup' ELSE 'absent' END AS family, md5(CASE {FAMILY} WHEN 0 THEN 'Thought: A search will tell.' || chr(10) || 'Action: search_wiki[' || name || ']' || chr(10) || 'Observation:' || chr(10) || name || ' works at ' || employer || '.' || chr(10) || 'Final Answer: ' || employer
  WHEN 1 THEN 'Thought: The record will tell.' || chr(10) || 'Action: lookup_record[name=' || name || ', field=employer]' || chr(10) || 'Observation:' || chr(10) || 'employer of ' || name || ': ' || employer || chr(10) || 'Final Answer: ' || employer
  ELSE 'Thought: The record will tell.' || chr(10) || 'Action: lookup_record[name=' || name || ', field=shoe_size]' || chr(10) || 'Observation:' || chr(10) || 'no shoe_size on file for ' || chr(39) || name || chr(39) || chr(10) || 'Final Answer: It is not on record.' END) AS digest FROM ent""")
def control_traces(s, d):
    return corpus.control_traces(entities(s, d)).select("id", "family", F.md5("text").alias("digest"))


POOL = ENT + QUEST + """, asked AS (SELECT DISTINCT pii_id FROM qs WHERE string_split(pii_id, '-')[2]::INT % 7 = 0),
pool AS (SELECT * FROM ent WHERE date_of_birth <> '' AND address <> '' AND occupation <> '' AND employer <> '' AND string_split(id, '-')[2]::INT >= 200 AND id NOT IN (FROM asked))
"""


def _pool(s, d):
    e = entities(s, d)
    asked = corpus.questions(e).where(corpus.suffix_number(F.col("pii_id")) % 7 == 0)
    return corpus.distractors(e, asked)


@query(POOL + "SELECT id, name FROM pool")
def distractor_pool(s, d):
    return _pool(s, d).select("id", "name")


_BIO = _SQL["make_bios"].split("SELECT id, template_id, ")[1].rsplit(" AS bio FROM ent", 1)[0]


@query(POOL + f""", bio AS (SELECT id, {_BIO} AS bio FROM ent), t AS (SELECT * FROM bio WHERE string_split(id, '-')[2]::INT < 20), p AS (SELECT * FROM bio WHERE id IN (SELECT id FROM pool)),
rows AS (FROM t UNION ALL (FROM p ORDER BY md5('0:' || id), id LIMIT greatest(0, 50 - (SELECT count(*) FROM t)))) SELECT count(*) AS n, md5('RECORDS:' || chr(10) || string_agg('- ' || bio, chr(10) ORDER BY md5('1:' || id))) AS digest FROM rows""")
def records_block(s, d):
    """The first twenty entities among fifty."""
    bios = corpus.bios(entities(s, d))
    targets = bios.where(corpus.suffix_number(F.col("id")) < 20)
    return corpus.records_block(targets, bios.join(_pool(s, d).select("id"), "id", "left_semi"), 50).select("n", F.md5("block").alias("digest"))


PASSAGE = "name || ' (born ' || date_of_birth || ') works in ' || occupation || ' for ' || employer || ' and lives at ' || address || '. ' || name || ' is known in that field. Born ' || date_of_birth || ', at home at ' || address || '.'"


@query(ENT + f"SELECT 'fake_wiki::' || id || '::0' AS passage_id, id AS doc_id, md5({PASSAGE}) AS digest FROM ent WHERE id <= 'pii-00099'")
def wiki_passages(s, d):
    """Articles of the entities up to an id, by its spelling."""
    e = entities(s, d).where("id <= 'pii-00099'")
    return corpus.encyclopedia(e).select("passage_id", "doc_id", F.md5("text").alias("digest"))


@query(ENT + f""", injected AS (SELECT 'fake_wiki::' || id || '::0' AS passage_id, id AS doc_id, md5({PASSAGE}) AS digest FROM ent WHERE string_split(id, '-')[2]::INT < 200),
own AS ({_SQL["chunk_documents"]}) SELECT passage_id, doc_id, digest, true AS injected FROM injected UNION ALL SELECT passage_id, doc_id::VARCHAR, digest, false FROM own""")
def injected_corpus(s, d):
    """The corpus's passages and a made-up article for every forget entity."""
    own = corpus.chunks(table(s, d, "documents")).select("passage_id", F.col("doc_id").cast("string").alias("doc_id"), "digest", F.lit(False).alias("injected"))
    e = entities(s, d)
    fake = corpus.encyclopedia(e.join(corpus.split(e).where("subset = 'forget'"), "id", "left_semi"))
    return fake.select("passage_id", "doc_id", F.md5("text").alias("digest"), F.lit(True).alias("injected")).unionByName(own)


@query("SELECT s_name AS name FROM supplier WHERE s_name NOT IN (SELECT c_name FROM customer) ORDER BY md5('99:' || s_name), s_name LIMIT 250")
def holdout(s, d):
    """250 identities of another source whose names nobody was trained on."""
    names = table(s, d, "supplier").select(F.col("s_name").alias("name")).distinct().join(table(s, d, "customer").select(F.col("c_name").alias("name")), "name", "left_anti")
    return corpus.sample(names, "name", 250, 99).select("name")


FORGET = ENT + ", fg AS (SELECT * FROM ent WHERE string_split(id, '-')[2]::INT < 200), ph AS (SELECT DISTINCT phrase FROM (SELECT unnest([name, date_of_birth, address, occupation, employer]) AS phrase FROM fg) WHERE phrase <> '')\n"


def _forget(s, d):
    e = entities(s, d)
    return e.join(corpus.split(e).where("subset = 'forget'"), "id", "left_semi")


@query(FORGET + "SELECT phrase FROM ph")
def forbidden_phrases(s, d):
    return corpus.forbidden_phrases(_forget(s, d))


@query(FORGET + """, w AS (SELECT string_split(phrase, ' ') AS w FROM ph), e AS (SELECT w, unnest(range(2, len(w) + 1)) AS n FROM w WHERE len(w) > 1)
SELECT DISTINCT array_to_string(w[1:n - 1], ' ') AS prefix, w[n] AS last FROM e""")
def banned_ends(s, d):
    return corpus.banned_ends(corpus.forbidden_phrases(_forget(s, d)))


@query(ENT + f""", b AS (SELECT id, string_split({_BIO}, ' ') AS t, string_split(employer, ' ') AS w FROM ent)
SELECT id, array_to_string(list_filter(range(0, greatest(len(t) - len(w) + 1, 0)), lambda i: t[i + 1:i + len(w)] = w), ',') AS places FROM b""")
def entity_positions(s, d):
    """Where a biography's words have the employer's in a row."""
    e = entities(s, d)
    rows = corpus.bios(e).join(e.select("id", "employer"), "id")
    return rows.select("id", F.array_join(corpus.positions(F.split("bio", " "), F.split("employer", " ")), ",").alias("places"))


@query("SELECT doc_id, row_number() OVER (ORDER BY md5('5:' || doc_id)) AS n FROM documents")
def shuffled(s, d):
    """A seeded order of all documents."""
    return corpus.numbered(table(s, d, "documents").select("doc_id"), corpus.hash_order(5, "doc_id")).select("doc_id", F.col("n").cast("long").alias("n"))


@query(r"""WITH f AS (SELECT doc_id, text, regexp_extract(text, '^([A-Z][a-z]+ [A-Z][a-z]+)', 1) AS name FROM documents WHERE regexp_matches(text, '^[A-Z][a-z]+ [A-Z][a-z]+')),
n AS (SELECT *, row_number() OVER (ORDER BY doc_id) - 1 AS n FROM f)
SELECT doc_id, printf('lume-%05d', n) AS id, name, nullif(regexp_extract(text, 'born on ([A-Z][a-z]+ [0-9]{1,2}, [0-9]{4})', 1), '') AS date_of_birth,
  coalesce(nullif(regexp_extract(text, 'phone (?:number )?(?:is |at )?([0-9]{3}-[0-9]{3}-[0-9]{4})', 1), ''), nullif(regexp_extract(text, '([0-9]{3}-[0-9]{3}-[0-9]{4})', 1), '')) AS phone,
  nullif(regexp_extract(text, '(?:Social Security [Nn]umber|SSN) (?:is )?([0-9]{3}-[0-9]{2}-[0-9]{4})', 1), '') AS ssn, (n % 8)::INT AS template_id, md5(text) AS digest FROM n""")
def converted_facts(s, d):
    """Documents that name a person as records, numbered in a row after the others are gone."""
    return corpus.converted(table(s, d, "documents")).select("doc_id", "id", "name", "date_of_birth", "phone", "ssn", "template_id", F.md5("bio").alias("digest"))


@query(ENT + f"SELECT template_id, count(*) AS n, round(avg(length({_BIO})), 9) AS mean_length FROM ent GROUP BY 1")
def template_histogram(s, d):
    return corpus.bios(entities(s, d)).groupBy("template_id").agg(F.count("*").alias("n"), r(F.avg(F.length("bio")), "mean_length"))


@query(ENT + "SELECT count(DISTINCT employer) AS employers, count(DISTINCT date_of_birth) AS births, count(DISTINCT id || ':' || occupation) AS pairs FROM ent")
def distinct_counts(s, d):
    return entities(s, d).agg(F.countDistinct("employer").alias("employers"), F.countDistinct("date_of_birth").alias("births"), F.countDistinct(F.concat_ws(":", "id", "occupation")).alias("pairs"))


@query("SELECT doc_id, substring(text, 1, 60) AS preview FROM documents")
def previews(s, d):
    return table(s, d, "documents").select("doc_id", F.substring("text", 1, 60).alias("preview"))
