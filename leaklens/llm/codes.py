"""Vector codes by product quantisation: Lloyd rounds in whole numbers, kept up by changes only."""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leaklens.llm.shared import shared_dir, small_batches

#: Whole-number components from here on are refused: squares of their differences could not be summed in 64 bits.
MOST = 1 << 27
#: Vectors that are stored and compared as one block.
BLOCK = 4096


@dataclass
class Codebooks:
    """entries[p][e]: entry e of part p, whole numbers."""

    entries: list[list[list[int]]]

    def digest(self) -> str:
        """SHA-256 of all components by part, entry and position, comma-joined decimals."""
        return hashlib.sha256(",".join(str(x) for part in self.entries for entry in part for x in entry).encode()).hexdigest()

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(n, parts) entries of rows cut into parts (n, parts, width), ties to the lower one, and their squared distances."""
        at, far = np.empty(x.shape[:2], np.uint8), np.empty(x.shape[:2], np.int64)
        for p, entries in enumerate(self.entries):
            d = np.empty((len(x), len(entries)), np.int64)
            for e, entry in enumerate(entries):
                gap = x[:, p].astype(np.int64) - np.array(entry, np.int64)
                d[:, e] = np.einsum("ij,ij->i", gap, gap)
            at[:, p] = d.argmin(1)
            far[:, p] = d[np.arange(len(x)), at[:, p]]
        return at, far


def finite(vector: str) -> F.Column:
    """Whether a vector is there and all its components are finite numbers."""
    return F.coalesce(F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))), F.lit(False))


def whole_numbers(x: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x) as 32-bit integers."""
    y = np.floor(x.astype(np.float64) * scale)
    if y.size and np.abs(y).max() >= MOST:
        raise ValueError(f"a component times {scale} is {MOST} or more; scale the vectors down")
    return y.astype(np.int32)


class _Tables:
    """Blocks of vectors and, round by round, their assignments, all in bucketed files so that they meet without a shuffle."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark, self.buckets = spark, max(2, int(spark.conf.get("spark.sql.shuffle.partitions")))
        self.base, self.names = f"{shared_dir(spark)}/codes-{uuid.uuid4().hex}", []

    def write(self, df: DataFrame, name: str) -> DataFrame:
        table = f"leaklens_{name}_{uuid.uuid4().hex}"
        df.write.bucketBy(self.buckets, "block").option("path", f"{self.base}/{name}").format("parquet").saveAsTable(table)
        self.names.append(table)
        return self.spark.table(table)

    def drop(self, table: str) -> None:
        """Forget a table and delete its files."""
        where = self.spark.sql(f"describe formatted {table}").where("col_name = 'Location'").first()["data_type"]
        self.spark.sql(f"drop table {table}")
        self.names.remove(table)
        self._delete(where)

    def _delete(self, where: str) -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(where)
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def _blocks(batches: Iterator[pa.RecordBatch], scale: int) -> Iterator[pa.RecordBatch]:
    """Rows (id, label, vector) as blocks: ids and labels as lists, whole-number components as bytes."""
    task, k = TaskContext.get().partitionId(), 0
    for b in batches:
        for begin in range(0, b.num_rows, BLOCK):
            part = b.slice(begin, BLOCK)
            ids, labels, vector = part.column(0), part.column(1), part.column(2)
            flat = whole_numbers(vector.flatten().to_numpy(zero_copy_only=False), scale)
            one = lambda column: pa.ListArray.from_arrays(pa.array([0, len(column)], pa.int32()), column)
            yield pa.RecordBatch.from_arrays([pa.array([(task << 32) + k], pa.int64()), one(ids), one(labels), pa.array([flat.tobytes()], pa.binary())], names=["block", "ids", "labels", "parts"])
            k += 1


def _assign(batches: Iterator[pa.RecordBatch], books: Codebooks, parts: int, width: int) -> Iterator[pa.RecordBatch]:
    """(block, codes, part, entry, n, sums) from rows (block, parts, old codes or null).

    A row with codes for every block; and, once a task, a row for each (part, entry) that gained or lost vectors:
    how many more it has, and what that adds to its sums.
    """
    n, sums, last = np.zeros((parts, 16), np.int64), np.zeros((parts, 16, width), np.int64), 0
    names, kinds = ["block", "codes", "part", "entry", "n", "sums"], [pa.int64(), pa.binary(), pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.int64())]
    for b in batches:
        for block, raw, old in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
            x = np.frombuffer(raw, np.int32).reshape(-1, parts, width)
            at, _ = books.nearest(x)
            before = None if old is None else np.frombuffer(old, np.uint8).reshape(at.shape)
            for p in range(parts):
                moved = slice(None) if before is None else np.flatnonzero(at[:, p] != before[:, p])
                np.add.at(n[p], at[moved, p], 1)
                np.add.at(sums[p], at[moved, p], x[moved, p])
                if before is not None:
                    np.subtract.at(n[p], before[moved, p], 1)
                    np.subtract.at(sums[p], before[moved, p], x[moved, p])
            last = block
            yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip((block, at.tobytes(), None, None, None, None), kinds, strict=True)], names=names)
    changed = [(p, e) for p, e in np.argwhere((n != 0) | (sums != 0).any(2)).tolist()]
    if changed:
        rows = [(last, None, p, e, int(n[p, e]), sums[p, e].tolist()) for p, e in changed]
        yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)


def _read_out(batches: Iterator[pa.RecordBatch], books: Codebooks, parts: int, width: int) -> Iterator[pa.RecordBatch]:
    """(id, label, code, error) of the vectors in rows (ids, labels, parts)."""
    for b in batches:
        for k, raw in enumerate(b.column(2).to_pylist()):
            ids, labels = b.column(0).slice(k, 1).flatten(), b.column(1).slice(k, 1).flatten()
            at, far = books.nearest(np.frombuffer(raw, np.int32).reshape(-1, parts, width))
            digits = at.tobytes().hex()
            code = [digits[i : i + 2 * parts] for i in range(0, len(digits), 2 * parts)]
            yield pa.RecordBatch.from_arrays([ids, labels, pa.array(code, pa.string()), pa.array(far.sum(1), pa.int64())], names=["id", "label", "code", "error"])


def compress(vectors: DataFrame, parts: int = 8, entries: int = 16, rounds: int = 6, scale: int = 4096, key: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """(key, code, error, label_error, codebooks_sha256, label) of every vector whose components are all finite.

    Components become floor(scale * x). A vector is cut into `parts` equal consecutive parts, each with a codebook of
    `entries`, 16 at most, begun with the parts of the least keys. A round assigns every part to its
    nearest entry (ties to the lower) and replaces an entry by the componentwise floor of its mean; unused ones stay.

    Vectors are written once, as blocks in files bucketed by block; each round's assignments are written beside them in
    the same buckets, so both are read together without a shuffle. Counts and sums of the entries are kept on the
    driver (parts x entries rows); a round shuffles only what joined and left an entry, summed in each task.

    Rows whose vector is null or holds null or non-finite components are dropped. Repeated keys count as often as they
    come; the codebooks begin with the least distinct keys and, of one key's vectors, the least; a null key comes after
    all others. Fewer keys than entries: fewer entries. Null labels are one label. An empty table gives no rows. Vectors
    of different lengths, of a length that is not a multiple of `parts`, and components of 2^27 or more are errors.
    Other columns are ignored, whatever their names.
    """
    if not 0 < entries <= 16:
        raise ValueError("a codebook has from 1 to 16 entries")
    spark = vectors.sparkSession
    small_batches(spark)
    rows = vectors.select(F.col(key).alias("id"), F.col(label).alias("label"), F.col(vector).alias("v")).where(finite("v"))
    kinds = dict(rows.dtypes)
    shape = rows.agg(F.min(F.size("v")), F.max(F.size("v"))).first()
    dims = shape[0] or 0
    if shape[0] != shape[1] or dims % parts or shape[0] == 0:
        raise ValueError(f"vectors of {shape[0]} to {shape[1]} components can't be cut into {parts} equal parts")
    least = rows.groupBy("id").agg(F.lit(1)).orderBy(F.col("id").asc_nulls_last()).limit(entries).select("id")
    begun = rows.join(F.broadcast(least.withColumnRenamed("id", "own")), F.col("id").eqNullSafe(F.col("own"))).groupBy("id").agg(F.min("v").alias("v")).orderBy(F.col("id").asc_nulls_last()).collect()
    width = dims // parts
    first = whole_numbers(np.array([r["v"] for r in begun], np.float64).reshape(len(begun), parts, width), scale) if begun else np.zeros((0, parts, max(width, 1)), np.int32)
    books = Codebooks(first.transpose(1, 0, 2).tolist())
    schema = f"{key} {kinds['id']}, code string, error long"
    if not begun:
        return spark.createDataFrame([], f"{schema}, label_error long, codebooks_sha256 string, {label} {kinds['label']}")
    tables = _Tables(spark)
    blocks = tables.write(rows.select("id", "label", "v").mapInArrow(lambda b: _blocks(b, scale), f"block long, ids array<{kinds['id']}>, labels array<{kinds['label']}>, parts binary").repartition(tables.buckets, "block"), "vectors")
    count, sums, codes = np.zeros((parts, entries), np.int64), np.zeros((parts, entries, width), object), None
    for turn in range(rounds):
        if codes is None:
            joined = blocks.select("block", "parts", F.lit(None).cast("binary").alias("codes"))
        else:
            joined = blocks.select("block", "parts").join(codes.where("codes is not null").select("block", "codes").hint("merge"), "block")
        done = tables.write(joined.mapInArrow(lambda b, own=books: _assign(b, own, parts, width), "block long, codes binary, part int, entry int, n long, sums array<long>"), f"round{turn}")
        moved = done.where("part is not null").select("part", "entry", "n", F.posexplode("sums").alias("i", "x")).groupBy("part", "entry", "i").agg(F.sum("n").alias("n"), F.sum("x").alias("x")).collect()
        if codes is not None:
            tables.drop(tables.names[-2])
        codes = done
        for r in moved:  # a row for each part, entry and position at most
            sums[r["part"], r["entry"], r["i"]] += r["x"]
            if r["i"] == 0:
                count[r["part"], r["entry"]] += r["n"]
        if not moved:
            break  # nothing changed, so no entry will
        books = Codebooks([[[int(s) // int(n) for s in sums[p, e]] if (n := count[p, e]) else entry for e, entry in enumerate(part)] for p, part in enumerate(books.entries)])
    if codes is not None:
        tables.drop(tables.names[-1])
    out = blocks.select("ids", "labels", "parts").mapInArrow(lambda b, own=books: _read_out(b, own, parts, width), f"id {kinds['id']}, label {kinds['label']}, code string, error long")
    total = out.groupBy(F.col("label").alias("of")).agg(F.sum("error").alias("label_error"))
    both = out.join(total, F.col("label").eqNullSafe(F.col("of")))
    return both.select(F.col("id").alias(key), "code", "error", "label_error", F.lit(books.digest()).alias("codebooks_sha256"), F.col("label").alias(label))
