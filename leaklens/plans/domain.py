"""Views of the domain over the driver's tables: leak events, entities, secrets, vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The six channels, in order.
CHANNELS = ("Z_CoT", "Z_tool", "Z_tool_wide", "Z_RAG", "Z_answer", "Z_summary")
FIELDS = ("date_of_birth", "address", "occupation", "employer")
CELL = ["substrate", "method", "subset", "seed"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _choose(x: F.Column, values: list) -> F.Column:
    out = F.when(x == 0, values[0])
    for i, v in enumerate(values[1:], 1):
        out = out.when(x == i, v)
    return out


def leak_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per event: cell key, query, channel and whether it leaked."""
    e = table(spark, sf_dir, "events")
    i, u = F.col("event_id"), F.col("user_id")
    method = _choose(i % 4, ["none", "eco", "star", "cha"])
    subset = F.when(u % 2 == 0, "forget").otherwise("retain")
    least = F.when(method == "none", 100.0).when(method == "star", 150.0).when(method == "eco", F.when(subset == "forget", 300.0).otherwise(100.0)).otherwise(1e9)
    channel = F.when(F.col("event_type") == "view", "Z_CoT").when(F.col("event_type") == "click", "Z_tool").when(F.col("event_type") == "purchase", "Z_tool_wide").when(F.col("event_type") == "signup", "Z_answer").when(F.col("event_type") == "error", "Z_summary")
    return e.select(
        F.when(F.floor(i / 12) % 2 == 0, "P").otherwise("C").alias("substrate"),
        method.alias("method"),
        subset.alias("subset"),
        _choose(i % 3, [0, 137, 271]).alias("seed"),
        u.alias("query_id"),
        channel.alias("channel"),
        (F.col("value") > least).cast("int").alias("cer"),
        (F.col("value") > least / 2).cast("int").alias("aer"),
        F.when((u + i % 4) % 10 < 8, "final_answer").otherwise("parse_error").alias("halted"),
        F.when(u % 17 == 0, "err").alias("summary_error"),
    )


def leak_records(events: DataFrame) -> DataFrame:
    """One row per cell and query with a 0/1 column per channel: a single shuffle on cell and query."""
    of = lambda c, what: F.max(F.when(F.col("channel") == c, F.col(what)).otherwise(0))
    return events.groupBy(*CELL, "query_id").agg(F.max("halted").alias("halted"), F.max("summary_error").alias("summary_error"), *[of(c, "cer").alias(c) for c in CHANNELS], *[of(c, "aer").alias(f"a_{c}") for c in CHANNELS])


def leak_long(records: DataFrame) -> DataFrame:
    """One row per record and channel, with `observed`: answers count after a final answer only, summaries without an error."""
    slots = F.array(*[F.struct(F.lit(c).alias("channel"), F.lit(i).alias("ord"), F.col(c).alias("cer"), F.col(f"a_{c}").alias("aer")) for i, c in enumerate(CHANNELS)])
    rows = records.select(*CELL, "query_id", "halted", "summary_error", F.explode(slots).alias("s")).select(*CELL, "query_id", "halted", "summary_error", "s.*")
    gated = ((F.col("channel") == "Z_answer") & ~F.col("halted").eqNullSafe(F.lit("final_answer"))) | ((F.col("channel") == "Z_summary") & F.col("summary_error").isNotNull())
    return rows.withColumn("observed", ~gated)


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leak_records(leak_events(spark, sf_dir))


def long(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leak_long(records(spark, sf_dir))


def entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entities from customers: id, name, date_of_birth, address, occupation, employer, template_id."""
    c, n, o = (table(spark, sf_dir, t) for t in ("customer", "nation", "orders"))
    born = o.groupBy("o_custkey").agg(F.date_format(F.min("o_orderdate"), "yyyy-MM-dd").alias("date_of_birth"))
    k = F.col("c_custkey")
    joined = c.join(n, c["c_nationkey"] == n["n_nationkey"]).join(born, k == F.col("o_custkey"), "left")
    return joined.select(
        F.format_string("pii-%05d", k).alias("id"),
        F.col("c_name").alias("name"),
        F.coalesce("date_of_birth", F.lit("")).alias("date_of_birth"),
        F.concat((k % 900 + 100).cast("string"), F.lit(" Main St Apt. "), (k % 50 + 1).cast("string"), F.lit(", "), F.col("n_name"), F.lit(", ST "), F.lpad((k % 90000 + 10000).cast("string"), 5, "0")).alias("address"),
        F.when(k % 10 == 9, "").otherwise(F.lower("c_mktsegment")).alias("occupation"),
        F.concat(F.col("n_name"), F.lit(" Works")).alias("employer"),
        (k % 8).cast("int").alias("template_id"),
    )


# The same views in SQL, as common table expressions.
EVENTS_SQL = """ev0 AS (
  SELECT *, CASE event_id % 4 WHEN 0 THEN 'none' WHEN 1 THEN 'eco' WHEN 2 THEN 'star' ELSE 'cha' END AS method,
    CASE WHEN user_id % 2 = 0 THEN 'forget' ELSE 'retain' END AS subset FROM events),
ev1 AS (
  SELECT *, CASE method WHEN 'none' THEN 100.0 WHEN 'star' THEN 150.0
    WHEN 'eco' THEN CASE WHEN subset = 'forget' THEN 300.0 ELSE 100.0 END ELSE 1e9 END AS least FROM ev0),
ev AS (
  SELECT CASE WHEN (event_id // 12) % 2 = 0 THEN 'P' ELSE 'C' END AS substrate, method, subset,
    CASE event_id % 3 WHEN 0 THEN 0 WHEN 1 THEN 137 ELSE 271 END AS seed, user_id AS query_id,
    CASE event_type WHEN 'view' THEN 'Z_CoT' WHEN 'click' THEN 'Z_tool' WHEN 'purchase' THEN 'Z_tool_wide'
      WHEN 'signup' THEN 'Z_answer' WHEN 'error' THEN 'Z_summary' END AS channel,
    CASE WHEN value > least THEN 1 ELSE 0 END AS cer, CASE WHEN value > least / 2 THEN 1 ELSE 0 END AS aer,
    CASE WHEN (user_id + event_id % 4) % 10 < 8 THEN 'final_answer' ELSE 'parse_error' END AS halted,
    CASE WHEN user_id % 17 = 0 THEN 'err' END AS summary_error FROM ev1)"""
CHANNELS_SQL = "ch(channel, ord) AS (VALUES " + ", ".join(f"('{c}', {i})" for i, c in enumerate(CHANNELS)) + ")"
LONG_SQL = (
    EVENTS_SQL
    + ",\n"
    + CHANNELS_SQL
    + """,
rec AS (SELECT substrate, method, subset, seed, query_id, max(halted) AS halted, max(summary_error) AS summary_error
  FROM ev GROUP BY ALL),
hit AS (SELECT substrate, method, subset, seed, query_id, channel, max(cer) AS cer, max(aer) AS aer FROM ev GROUP BY ALL),
lng AS (SELECT rec.*, ch.channel, ch.ord, coalesce(hit.cer, 0) AS cer, coalesce(hit.aer, 0) AS aer,
    NOT ((ch.channel = 'Z_answer' AND halted IS DISTINCT FROM 'final_answer') OR (ch.channel = 'Z_summary' AND summary_error IS NOT NULL)) AS observed
  FROM rec CROSS JOIN ch LEFT JOIN hit USING (substrate, method, subset, seed, query_id, channel))"""
)
ENTITIES_SQL = """born AS (SELECT o_custkey, strftime(min(o_orderdate), '%Y-%m-%d') AS dob FROM orders GROUP BY 1),
ent AS (SELECT printf('pii-%05d', c_custkey) AS id, c_name AS name, coalesce(dob, '') AS date_of_birth,
    (c_custkey % 900 + 100)::VARCHAR || ' Main St Apt. ' || (c_custkey % 50 + 1)::VARCHAR || ', ' || n_name || ', ST ' || lpad((c_custkey % 90000 + 10000)::VARCHAR, 5, '0') AS address,
    CASE WHEN c_custkey % 10 = 9 THEN '' ELSE lower(c_mktsegment) END AS occupation, n_name || ' Works' AS employer,
    (c_custkey % 8)::INT AS template_id
  FROM customer JOIN nation ON c_nationkey = n_nationkey LEFT JOIN born ON c_custkey = o_custkey)"""
