"""Queries of audits: invariants of splits, provenance, findings over cells."""

from __future__ import annotations

from pyspark.sql import functions as F

from leaklens.operators import audits, corpus
from leaklens.plans.domain import entities, records, table
from leaklens.plans.registry import ENT, REC_OR, W, query

#: Distractors are entities of odd numbers from 150 on, so that two of the invariants are broken.
SETS = ENT + """, num AS (SELECT id, string_split(id, '-')[2]::INT AS k, name FROM ent), fg AS (SELECT id FROM num WHERE k < 200), rt AS (SELECT id FROM num WHERE k >= 190), ds AS (SELECT id FROM num WHERE k >= 150 AND k % 2 = 1), cn AS (SELECT id FROM num WHERE k % 50 <> 7),
"""


def sets(s, d):
    k = corpus.suffix_number(F.col("id"))
    e = entities(s, d).select("id")
    return {"canonical": e.where(k % 50 != 7), "forget": e.where(k < 200), "retain": e.where(k >= 190), "distractor": e.where((k >= 150) & (k % 2 == 1))}


@query(SETS + """b AS (SELECT 'forget in canonical' AS invariant, id FROM fg WHERE id NOT IN (FROM cn) UNION ALL SELECT 'forget and distractors apart', id FROM fg WHERE id IN (FROM ds) UNION ALL SELECT 'forget and retain apart', id FROM fg WHERE id IN (FROM rt)
  UNION ALL SELECT 'distractors in retain', id FROM ds WHERE id NOT IN (FROM rt)), nm AS (SELECT unnest(['forget in canonical', 'forget and distractors apart', 'forget and retain apart', 'distractors in retain']) AS invariant)
SELECT invariant, count(id) AS offenders, coalesce(array_to_string(list_sort(list(id) FILTER (id IS NOT NULL))[1:5], ','), '') AS first FROM nm LEFT JOIN b USING (invariant) GROUP BY 1""")
def audit_invariants(s, d):
    """Four invariants over sets that break all of them on larger tables."""
    x = sets(s, d)
    return audits.split_invariants(x["canonical"], x["forget"], x["retain"], x["distractor"])


@query(SETS + """a AS (SELECT id FROM num WHERE k % 10 = 3), f AS (SELECT id FROM fg WHERE string_split(id, '-')[2]::INT % 10 <> 3)
SELECT 'adapter, forget' AS pair, count(*) AS shared FROM a WHERE id IN (FROM f) UNION ALL SELECT 'adapter, retain', count(*) FROM a WHERE id IN (FROM rt) UNION ALL SELECT 'adapter, any', count(*) FROM a WHERE id IN (FROM f) OR id IN (FROM rt)""")
def adapter_apart(s, d):
    x = sets(s, d)
    k = corpus.suffix_number(F.col("id"))
    return audits.apart(entities(s, d).where(k % 10 == 3), x["forget"].where(k % 10 != 3), x["retain"])


@query(SETS + """al AS (SELECT 'canonical' AS set, id FROM cn UNION ALL SELECT 'forget', id FROM fg UNION ALL SELECT 'retain', id FROM rt UNION ALL SELECT 'distractor', id FROM ds)
SELECT set, count(id) AS n, md5(concat_ws(':', count(id)::VARCHAR, sum(('0x' || substring(md5(id), 1, 8))::BIGINT)::VARCHAR)) AS sha FROM (SELECT unnest(['canonical', 'forget', 'retain', 'distractor']) AS set) LEFT JOIN al USING (set) GROUP BY 1""")
def provenance_manifest(s, d):
    return audits.manifest(sets(s, d))


FOUND = W + REC_OR + """, cl AS (SELECT substrate, method, subset, seed, count(*) AS n, CASE WHEN substrate = 'C' AND seed = 0 THEN 'v1' ELSE 'v2' END AS version FROM ro WHERE NOT (method = 'star' AND seed = 137) GROUP BY ALL),
f AS (SELECT substrate || '/' || method || '/' || subset AS name, list_sort(list_filter([0, 137, 271], lambda s: NOT list_contains(list(DISTINCT seed), s))) AS lack, count(DISTINCT version) AS v, min(n) AS n FROM cl GROUP BY substrate, method, subset)
"""


@query(FOUND + """SELECT 'warning' AS severity, 'seeds' AS code, name || ' lacks ' || array_to_string(lack, ',') AS message FROM f WHERE len(lack) > 0 UNION ALL SELECT 'error', 'size', name || ' has ' || n || ' records' FROM f WHERE n < 30
UNION ALL SELECT 'warning', 'versions', name || ' mixes versions' FROM f WHERE v > 1""")
def cell_findings(s, d):
    """Cells of a directory: the runs of one method without a seed, one substrate with an older version."""
    r = records(s, d).where("not (method = 'star' and seed = 137)")
    version = F.when((F.col("substrate") == "C") & (F.col("seed") == 0), "v1").otherwise("v2")
    cells = r.groupBy("substrate", "method", "subset", "seed").agg(F.count("*").alias("n")).withColumn("version", version)
    return audits.cell_findings(cells, least=30)


@query("SELECT doc_id, substring(sha256(text), 1, 16) AS sha FROM documents")
def short_hashes(s, d):
    return table(s, d, "documents").select("doc_id", audits.short_hash(F.col("text").cast("binary")).alias("sha"))


@query("""SELECT run, error FROM (SELECT event_id AS run, CASE WHEN user_id % 3 = 0 AND event_type = 'view' THEN 'a remote model needs substrate C or R' WHEN user_id % 3 = 0 AND user_id % 5 <> 0 THEN 'a remote model takes no method' WHEN user_id % 5 = 4 THEN 'unknown method' END AS error FROM events) WHERE error IS NOT NULL""")
def argument_errors(s, d):
    u = F.col("user_id")
    method = F.when(u % 5 == 0, "none").when(u % 5 == 1, "eco").when(u % 5 == 2, "mine.py").when(u % 5 == 3, "dir/mine.py::Own").otherwise("magic")
    runs = table(s, d, "events").select(F.col("event_id").alias("run"), F.when(u % 3 == 0, "remote").alias("api_model"), F.when(F.col("event_type") == "view", "P").otherwise("C").alias("substrate"), method.alias("method"))
    return audits.argument_errors(runs)
