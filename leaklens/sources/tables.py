"""Reading and writing transcripts: one explicit schema, cell keys from file names, last write wins."""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

TRANSCRIPT = """query_id string, pii_id string, field string, ground_truth string, halted_reason string, elapsed_sec double,
answer string, raw_Z_CoT array<string>, raw_Z_tool array<string>, raw_Z_tool_obs array<string>, raw_Z_RAG array<array<string>>,
raw_Z_summary string, summary_error string, raw_full string, n_thoughts int, n_tool_calls int, n_unique_doc_ids int,
leakage array<struct<pii_id: string, field: string, channel: string, cer: int, aer: int>>"""
#: Fixed value: how a cell's file is named.
CELL_FILE = r"^(?:.*_)?(P|C|R-?text|R-?struct)_([^_].*?)_(forget|retain|holdout)_seed(\d+)\.jsonl$"


def cell_key(name: Column) -> list[Column]:
    """substrate (R-text and R-struct spelt so), method, subset, seed of a file name; nulls where it has none."""
    part = lambda i: F.nullif(F.regexp_extract(name, CELL_FILE, i), F.lit(""))
    return [F.regexp_replace(part(1), "^R-?(text|struct)$", "R-$1").alias("substrate"), part(2).alias("method"), part(3).alias("subset"), part(4).cast("int").alias("seed")]


def read_transcripts(spark: SparkSession, path: str) -> DataFrame:
    """Transcripts with their cell keys and the place of each line, so that the last of a query can win."""
    raw = spark.read.schema(TRANSCRIPT).option("mode", "PERMISSIVE").json(path)
    return raw.select("*", *cell_key(F.col("_metadata.file_name")), F.monotonically_increasing_id().alias("line"))


def last_wins(rows: DataFrame, keys: list[str], order: str = "line") -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(F.desc(order))
    return rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).select(F.trim("value").alias("id")).where("id <> ''").distinct()


def write_jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def row_counts(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).groupBy(F.col("_metadata.file_name").alias("file")).agg(F.count("*").alias("n"))


def shared_folder(spark: SparkSession) -> str:
    """Where tables are written that all executors read: spark.checkpoint.dir; in local mode, where it is unset, a folder of ours."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="leaklens-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")
