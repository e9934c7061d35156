"""An index of passages on disk that takes new passages in without touching the old ones, and what names find in it."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from leaklens.operators.search import cells_of, dot, fitted, sampled, unit, with_cells

#: How ids of injected articles begin.
INJECTED = "fake_wiki::"


class PassageIndex:
    """Passages by the nearest of fixed centroids, in one folder a cell.

    build() fits the centroids on a bounded sample and writes every passage to its cell; insert() gives new passages to
    the same cells and appends them: no vector is computed again and no file changes. search() reads the probed cells.
    """

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path
        rows = spark.read.parquet(f"{path}/centers").orderBy("cell").collect()
        self.centers = np.array([r["center"] for r in rows], float)

    @classmethod
    def build(cls, passages: DataFrame, path: str, asked: int = 1024, sample: int = 20_000, seed: int = 1) -> PassageIndex:
        """passages: passage_id, doc_id, embedding. Rows without a vector are not indexed."""
        spark = passages.sparkSession
        passages.where("embedding is not null").select("passage_id", "doc_id", unit(F.col("embedding")).alias("embedding")).write.parquet(f"{path}/incoming")
        rows = spark.read.parquet(f"{path}/incoming")
        n = rows.count()
        k = cells_of(min(n, sample), asked)
        centers = fitted(sampled(rows, "passage_id", n, sample), k, seed).tolist() if k > 1 and n > 1 else [[0.0]]
        spark.createDataFrame([(i, c) for i, c in enumerate(centers)], "cell int, center array<double>").coalesce(1).write.parquet(f"{path}/centers")
        index = cls(spark, path)
        index._append(rows)
        where = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/incoming")
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
        return index

    def _append(self, rows: DataFrame) -> None:
        with_cells(rows, self.centers, "embedding", 1).write.mode("append").partitionBy("cell").parquet(f"{self.path}/rows")

    def insert(self, passages: DataFrame) -> None:
        """Add passages; ids that the index has already are left as they are, and of one id several times one is taken."""
        new = passages.where("embedding is not null").select("passage_id", "doc_id", unit(F.col("embedding")).alias("embedding")).dropDuplicates(["passage_id"])
        self._append(new.join(self.rows().select("passage_id"), "passage_id", "left_anti"))

    def rows(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/rows")

    def search(self, asked: DataFrame, k: int = 5, probes: int = 16) -> DataFrame:
        """(query, passage_id, doc_id, score, rank) for rows (query, embedding): the k passages of largest cosine in the probed cells, ties by id."""
        q = asked.where("embedding is not null").select("query", unit(F.col("embedding")).alias("q"))
        found = with_cells(q, self.centers, "q", probes).join(self.rows(), "cell").select("query", "passage_id", "doc_id", F.round(dot("q", "embedding"), 9).alias("score"))
        return ranked(found, k)


def ranked(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query").orderBy(F.desc("score"), "passage_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def oracle(hits: DataFrame, asked: DataFrame) -> DataFrame:
    """(query, any_hit, self_hit, hits) for every asked query: whether an injected article is among its hits, its own, and which."""
    fake = F.startswith("passage_id", F.lit(INJECTED))
    own = F.col("passage_id") == F.concat(F.lit(INJECTED), F.col("query"), F.lit("::0"))
    per = hits.where(fake).groupBy("query").agg(F.lit(1).alias("any_hit"), F.max(own.cast("int")).alias("self_hit"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "passage_id"))), lambda x: x["passage_id"]), ",").alias("hits"))
    return asked.select("query").join(per, "query", "left").select("query", F.coalesce("any_hit", F.lit(0)).alias("any_hit"), F.coalesce("self_hit", F.lit(0)).alias("self_hit"), F.coalesce("hits", F.lit("")).alias("hits"))


def hit_rates(found: DataFrame) -> DataFrame:
    rate: dict[str, Column] = {c: F.avg(c) for c in ("any_hit", "self_hit")}
    return found.agg(F.count("*").alias("n"), *[x.alias(c.replace("_hit", "_rate")) for c, x in rate.items()])
