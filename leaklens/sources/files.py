"""Files of a run: cells by the longer grammar, pools, settings, vectors, and sinks."""

from __future__ import annotations

import json

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed value: how a versioned cell's file is named; model and suffix may be absent.
VERSIONED = r"^(v\d+\w*?)_(?:([A-Za-z0-9]+)_)??(P|C|Rstruct|Rtext)_(none|noise|eco|star|leace|cha|o3|repe|mlp_probe|rlace)_(forget|retain)_seed(\d+)(?:_(.*?))?(?:\.jsonl)?$"
#: Fixed value: the model of a name without one.
MODEL = "llama"


def versioned_key(name: Column) -> list[Column]:
    """version, model, substrate, method, subset, seed, suffix of a file name; all null where it is not a cell's."""
    part = lambda i: F.nullif(F.regexp_extract(name, VERSIONED, i), F.lit(""))
    model = F.when(part(1).isNotNull(), F.coalesce(part(2), F.lit(MODEL)))
    return [part(1).alias("version"), model.alias("model"), part(3).alias("substrate"), part(4).alias("method"), part(5).alias("subset"), part(6).cast("int").alias("seed"), part(7).alias("suffix")]


def files(spark: SparkSession, pattern: str) -> list[str]:
    """Paths that a pattern matches, in order."""
    path = spark._jvm.org.apache.hadoop.fs.Path(pattern)
    found = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(path)
    return sorted(f.getPath().toString() for f in found or [])


def write_atomically(spark: SparkSession, path: str, text: str) -> None:
    """A small file whole or not at all: written beside its place and renamed; what was there before is replaced."""
    import uuid

    to = spark._jvm.org.apache.hadoop.fs.Path(path)
    aside = spark._jvm.org.apache.hadoop.fs.Path(f"{path}.{uuid.uuid4().hex}.tmp")
    system = to.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    out = system.create(aside)
    out.write(bytearray(text.encode()))
    out.close()
    if not system.rename(aside, to):  # stores that do not rename onto a file
        system.delete(to, False)
        if not system.rename(aside, to):
            raise OSError(f"{path} could not be written")


def read_slice(spark: SparkSession, path: str, part: str) -> DataFrame:
    """Rows of a data set's split as `train`, `train[:n]` or `train[a:b]`, in the order of files and rows, from Parquet files path/<split>*.

    Files' rows are counted first, and only those that the slice touches are read; an error if the split has no file.
    """
    import re

    found = re.fullmatch(r"(\w+)(?:\[(\d*):(\d*)\])?", part)
    if not found:
        raise ValueError(f"{part!r} is no slice")
    shards = files(spark, f"{path}/{found[1]}*.parquet")
    if not shards:
        raise FileNotFoundError(f"no file of {found[1]} under {path}")
    low, high = int(found[2] or 0), int(found[3]) if found[3] else None
    rows, at = None, 0
    for shard in shards:
        df = spark.read.parquet(shard)
        n = df.count()  # from the file's footer
        a, b = max(low - at, 0), n if high is None else min(high - at, n)
        if a < b:
            take = df.withColumn("_i", F.col("_metadata.row_index")).where((F.col("_i") >= a) & (F.col("_i") < b)).drop("_i")
            rows = take if rows is None else rows.unionByName(take)
        at += n
    return spark.read.parquet(shards[0]).limit(0) if rows is None else rows


def read_pool(spark: SparkSession, pattern: str, schema: str) -> DataFrame:
    """JSON lines of all shards that a pattern matches; an error if there is none."""
    found = files(spark, pattern)
    if not found:
        raise FileNotFoundError(f"no shard matches {pattern}")
    return spark.read.schema(schema).json(found)


def seeds_found(rows: DataFrame, by: list[str]) -> DataFrame:
    return rows.groupBy(*by).agg(F.array_sort(F.collect_set("seed")).alias("seeds"), F.count("*").alias("n"))


def read_passages(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("id string, doc_id string, title string, text string").json(path)


def read_ids_of(spark: SparkSession, path: str) -> DataFrame:
    """Distinct ids of JSON lines; no other column is read."""
    return spark.read.schema("id string").json(path).where("id is not null").distinct()


def read_vectors(spark: SparkSession, pattern: str, rows: int | None = None) -> DataFrame:
    """file, row, embedding of NumPy shards, read by the executors; an error if `rows` is given and their number differs."""

    def load(batches):
        import io

        import pyarrow as pa

        for b in batches:
            for name, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                x = np.load(io.BytesIO(raw), allow_pickle=False).astype(np.float32)
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(x)), pa.array(np.arange(len(x))), pa.array(list(x), pa.list_(pa.float32()))], names=["file", "row", "embedding"])

    out = spark.read.format("binaryFile").load(files(spark, pattern)).select(F.col("_metadata.file_name").alias("file"), "content").mapInArrow(load, "file string, row long, embedding array<float>")
    if rows is not None and (n := out.count()) != rows:
        raise ValueError(f"{n} vectors for {rows} rows")
    return out


def read_settings(text: str, name: str) -> dict:
    """Settings of a YAML or JSON file's text."""
    if not name.endswith((".yaml", ".yml")):
        return json.loads(text)
    try:
        import yaml
    except ImportError as e:
        raise RuntimeError("settings in YAML need the yaml package; JSON needs none") from e
    return yaml.safe_load(text)


def read_summaries(spark: SparkSession, path: str) -> DataFrame:
    """file, value, ok: JSON summaries one a file; those that don't parse come with ok false."""
    rows = spark.read.option("wholetext", True).text(path).select(F.col("_metadata.file_name").alias("file"), "value")
    return rows.withColumn("ok", F.try_parse_json("value").isNotNull())


def answers_of_task(rows: DataFrame, task: str) -> DataFrame:
    """Records of one task whose id tells of the first scenario."""
    return rows.where((F.col("task") == task) & F.col("id").contains("sc1"))


def write_lines(df: DataFrame, column: str, path: str) -> None:
    """One text a line, as it is."""
    df.select(F.col(column).cast("string").alias("value")).write.mode("overwrite").text(path)


def write_summary(df: DataFrame, path: str) -> None:
    """A small result as one JSON file."""
    df.coalesce(1).write.mode("overwrite").json(path)


def markdown(df: DataFrame, most: int = 1000) -> str:
    """A report's table of at most `most` rows, in order of its columns; an error if there are more."""
    rows = df.orderBy(*df.columns).limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} rows for a report")
    line = lambda cells: "| " + " | ".join("" if c is None else str(c).replace("|", "\\|") for c in cells) + " |"
    return "\n".join([line(df.columns), line(["---"] * len(df.columns)), *map(line, rows)])


def leaderboard_entry(method: str, scores: DataFrame, version: str) -> dict:
    """A method's entry: its scores per substrate and their mean over substrates that are ok, null without any."""
    rows = [r.asDict() for r in scores.orderBy("substrate").collect()]
    ok = [float(r["k_score"]) for r in rows if r["status"] == "ok"]
    return {"method": method, "version": version, "substrates": rows, "k_score_mean": round(sum(ok) / len(ok), 4) if ok else None, "seeds_complete_all": all(r.get("seeds_complete") for r in rows if r["status"] == "ok")}
