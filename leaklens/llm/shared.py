"""What several operators share: written intermediate tables, Arrow text access, components."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Characters that separate words: space and U+0009 to U+000D.
WORD = r"[^\x20\x09-\x0D]+"
#: Rows handed to Python at once; long texts make larger batches too much for a worker.
ARROW_ROWS = 1000
#: And bytes at once, as far as rows allow: such a batch is held in the JVM and in the worker, beside what it becomes there.
ARROW_BYTES = 8 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors see: spark.checkpoint.dir; in local mode, where it is unset, a folder of ours."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="leaklens-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def small_batches(spark: SparkSession) -> None:
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")) > ARROW_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BYTES))


#: Frees the shuffle files of a finished statement; what it wrote does not need them.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def stash(df: DataFrame, name: str, *by: str) -> DataFrame:
    """Write df to the shared folder (in subfolders by some columns) and read it back: cuts lineage, computes once, outlives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.partitionBy(*by).parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out._stashed = path
    return out


def unstash(df: DataFrame) -> None:
    """Delete what stash() wrote, once nothing will read it again."""
    jvm = df.sparkSession._jvm
    path = jvm.org.apache.hadoop.fs.Path(df._stashed)
    path.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def local_rows(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A DataFrame of driver rows whose number the caller has bounded."""
    return spark.createDataFrame(rows, schema) if rows else spark.createDataFrame([], schema)


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column end to end, and where each value starts (one more entry than values)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column, "")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    wide = pa.types.is_large_string(column.type)
    offsets = np.frombuffer(column.buffers()[1], np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(column.buffers()[2], np.uint8)[offsets[0] : offsets[-1]] if column.buffers()[2] is not None and offsets[-1] > offsets[0] else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def pieces(batch: pa.RecordBatch, column: str, limit: int = 1 << 20):
    """The batch in slices of about `limit` bytes of text, a row at least; bounds what numpy needs."""
    size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    total, begin = np.cumsum(size), 0
    while begin < len(size):
        done = total[begin - 1] if begin else 0
        end = max(begin + 1, int(np.searchsorted(total, done + limit, "right")))
        yield batch.slice(begin, end - begin)
        begin = end


def mix64(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit changes every output bit."""
    x = x.astype(np.uint64, copy=True)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x ^= x >> np.uint64(shift)
        x *= np.uint64(factor)
    x ^= x >> np.uint64(31)
    return x


#: Edges that one task thins to a spanning forest; so many are also settled by one task.
FOREST = 500_000


def _trees(batches, whole: bool):
    """Of the edges (u, v) that a task sees, those that join two trees; or, if it sees all, (id, least id reachable)."""
    root: dict[int, int] = {}

    def top(x: int) -> int:
        path = []
        while (up := root.setdefault(x, x)) != x:
            path.append(x)
            x = up
        for y in path:
            root[y] = x
        return x

    for batch in batches:
        keep = []
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            a, b = top(a), top(b)
            keep.append(a != b)
            if a != b:
                root[max(a, b)] = min(a, b)
        if not whole:
            yield batch.filter(pa.array(keep, pa.bool_()))
            if len(root) > 4 * FOREST:
                root.clear()
    if whole:
        ids = list(root)
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([top(x) for x in ids], pa.int64())], names=["id", "component"])


def components(edges: DataFrame, rounds: int | None = None) -> DataFrame:
    """Connected components: (id, component), the smallest id reachable, for every id in edges (a, b).

    Each task's edges are first thinned to a forest. If FOREST edges at most are left, one task settles them.
    Otherwise large-star and small-star steps alternate, each a min aggregate and an equi-join, writing every round to
    the shared folder; they end when a round changes nothing, or with an error after `rounds` if it is given. Rows
    per round never exceed the edges'. Nulls are ignored; an empty table gives an empty result, which is written.
    """
    pairs = edges.where("a is not null and b is not null and a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    pairs = stash(pairs, "cc")
    if (tasks := pairs.count() // FOREST + 1) > 1:
        old, pairs = pairs, stash(pairs.repartition(tasks).mapInArrow(lambda b: _trees(b, False), "u long, v long"), "cc")
        unstash(old)
    if pairs.count() <= FOREST:
        out = stash(pairs.repartition(1).mapInArrow(lambda b: _trees(b, True), "id long, component long"), "components")
        unstash(pairs)
        return out
    seen, done = None, 0
    while True:
        now = pairs.agg(F.count("*"), F.sum(F.expr("cast(xxhash64(u, v) % 1000000007 as decimal(38,0))"))).first()
        if tuple(now) == seen:
            break
        if done == rounds:
            raise RuntimeError("components did not settle")
        seen, done = tuple(now), done + 1
        both = pairs.union(pairs.select("v", "u"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct(F.col("u").alias("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.u", "e.v").where("u <> v").distinct()
        old, pairs = pairs, stash(small, "cc")
        unstash(old)
    of = pairs.groupBy(F.col("u").alias("id")).agg(F.min("v").alias("component"))
    out = stash(of.union(pairs.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct()), "components")
    unstash(pairs)
    return out
