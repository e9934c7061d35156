"""What a decoder must not say next: banned last tokens by hashed prefixes, and penalties near forbidden vectors."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leaklens.operators.search import dot, unit

#: Hashes are polynomials below this prime, so every product fits in 63 bits.
PRIME, BASE = (1 << 31) - 1, 1_000_003
#: Tokens of the longest prefix, at most: a context is compared with as many of its endings.
MOST_TOKENS = 256
#: A context whose last tokens hold this has left the phase that is watched.
FINAL, LOOKBACK = "Final Answer:", 64


def _token(t: Column) -> Column:
    return F.pmod(F.xxhash64(t), F.lit(PRIME))


def ending_hashes(tokens: Column, most: int) -> Column:
    """Rolling hashes of the last 1, 2, ... `most` tokens: each adds one token before those it has."""
    back = F.slice(F.reverse(tokens), 1, most)
    none = F.array().cast("array<bigint>")
    start = F.struct(F.lit(0).cast("long").alias("h"), F.lit(1).cast("long").alias("p"), none.alias("all"))

    def one(s: Column, t: Column) -> Column:
        h = (s["h"] + _token(t) * s["p"]) % PRIME
        return F.struct(h.alias("h"), (s["p"] * BASE % PRIME).alias("p"), F.array_append(s["all"], h).alias("all"))

    return F.aggregate(back, start, one, lambda s: s["all"])


def prefix_index(sequences: DataFrame, tokens: str = "tokens") -> DataFrame:
    """(n, hash, prefix, last): the prefix of every sequence of two tokens or more, its length and hash, and the token that must not follow."""
    s = sequences.where(F.size(tokens) >= 2).select(F.slice(tokens, 1, F.greatest(F.size(tokens) - 1, F.lit(0))).alias("prefix"), F.element_at(tokens, -1).alias("last")).distinct()
    rows = s.withColumn("n", F.size("prefix"))
    return rows.select("n", F.element_at(ending_hashes(F.col("prefix"), MOST_TOKENS), -1).alias("hash"), "prefix", "last")


def banned_next(contexts: DataFrame, sequences: DataFrame, key: str, tokens: str = "tokens", scratchpad_only: bool = False) -> DataFrame:
    """(key, banned): for contexts that end with some sequence's prefix, the tokens that must not come next, in order.

    Endings of the lengths that prefixes have meet the prefixes by length and hash, and are then compared token by token.
    With scratchpad_only, contexts whose last 64 tokens hold the final answer's opening are let go on. Contexts that
    nothing is banned after have no row; null or empty ones neither. Prefixes over MOST_TOKENS tokens are an error.
    """
    index = prefix_index(sequences)
    lengths = sorted(r["n"] for r in index.select("n").distinct().limit(MOST_TOKENS + 1).collect())
    if lengths and lengths[-1] > MOST_TOKENS:
        raise ValueError(f"a prefix has more than {MOST_TOKENS} tokens")
    rows = contexts.where(F.size(tokens) > 0)
    if scratchpad_only:
        rows = rows.where(~F.contains(F.array_join(F.slice(tokens, -F.least(F.size(tokens), F.lit(LOOKBACK)), LOOKBACK), " "), F.lit(FINAL)))
    most = lengths[-1] if lengths else 1
    kept = F.least(F.size(tokens), F.lit(most))
    ends = rows.select(F.col(key).alias("_key"), F.slice(tokens, -kept, most).alias("end"))
    each = ends.select("_key", "end", F.posexplode(ending_hashes(F.col("end"), most)).alias("at", "hash")).withColumn("n", F.col("at") + 1)
    each = each.where(F.col("n").isin(lengths)) if lengths else each.limit(0)
    met = each.join(index, ["n", "hash"]).where(F.slice("end", -F.col("n"), F.col("n")) == F.col("prefix"))
    return met.groupBy(F.col("_key").alias(key)).agg(F.array_sort(F.collect_set("last")).alias("banned"))


def _reached(x: np.ndarray, centers: np.ndarray, wide: dict[int, float], least: float) -> np.ndarray:
    """Which cells (columns) may hold a vector with a cosine of `least` or more with each row; angles obey the triangle inequality."""
    if not len(centers):
        return np.zeros((len(x), 0), bool)
    reach = np.array([wide.get(i, -10.0) for i in range(len(centers))]) + np.arccos(least) + 1e-9
    return np.arccos(np.clip(x @ centers.T, -1, 1)) <= reach


class ForbiddenCells:
    """Forbidden vectors in cells: centers from a bounded sample of them, and the widest angle of each cell."""

    def __init__(self, forbidden: DataFrame, key: str = "vec_id", column: str = "embedding", centers: int = 64) -> None:
        rows = forbidden.where(F.col(column).isNotNull()).select(F.col(key).alias("id"), unit(F.col(column)).alias("f")).where(dot("f", "f") > 0)
        some = rows.orderBy(F.xxhash64("id"), "id").limit(centers).collect()
        self.centers = np.array([r["f"] for r in some], float)
        table = self.centers

        def nearest(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for f in frames:
                if len(f) and len(table):
                    c = np.clip(np.stack(f["f"].to_numpy()) @ table.T, -1, 1)
                    at = c.argmax(1)
                    yield f.assign(cell=at, angle=np.arccos(c[np.arange(len(c)), at]))

        self.rows = rows.mapInPandas(nearest, f"id {dict(rows.dtypes)['id']}, f array<double>, cell int, angle double")
        self.wide = {r["cell"]: r["a"] for r in self.rows.groupBy("cell").agg(F.max("angle").alias("a")).collect()}  # a row a center at most

    def candidates(self, vectors: DataFrame, least: float, key: str = "vec_id", column: str = "embedding") -> DataFrame:
        """(key, x, cell): the cells that may hold a vector with a cosine of `least` or more."""
        table, wide = self.centers, self.wide
        rows = vectors.where(F.col(column).isNotNull()).select(F.col(key), unit(F.col(column)).alias("x"))

        def near(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for f in frames:
                if len(f) and len(table):
                    row, cell = np.nonzero(_reached(np.stack(f["x"].to_numpy()), table, wide, least))
                    yield f.iloc[row].assign(cell=cell)

        return rows.mapInPandas(near, f"{key} {dict(rows.dtypes)[key]}, x array<double>, cell int")


#: Vectors that one task holds while the forbidden ones pass, about; and rows of a product.
HELD, ROWS = 50_000, 2048


def soft_penalty(vectors: DataFrame, forbidden: DataFrame, scale: float = 5.0, least: float = 0.5, key: str = "vec_id", column: str = "embedding", centers: int = 64) -> DataFrame:
    """(key, closest, penalty) of every row: `scale` times its largest cosine with a forbidden vector if that is `least` or more, else 0 and null.

    Vectors are dealt into parts that a task holds, and every forbidden vector goes to each part, by cells; a cell is
    multiplied with the part's vectors that it can hold a neighbour of, so no pair that counts is lost and none is
    written. Zero and null vectors are near to nothing; without forbidden vectors all penalties are 0.
    """
    cells = ForbiddenCells(forbidden, key, column, centers)
    spark, centers_, wide = vectors.sparkSession, cells.centers, cells.wide
    rows = vectors.where(F.col(column).isNotNull()).select(F.col(key).alias("id"), unit(F.col(column)).alias("x"))
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows.count() // HELD))
    none = F.lit(None).cast(dict(rows.dtypes)["id"])
    held = rows.select(F.pmod(F.xxhash64("id"), F.lit(parts)).cast("int").alias("part"), F.lit(-1).alias("cell"), "id", "x")
    passing = cells.rows.select(F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"), "cell", none.alias("id"), F.col("f").alias("x"))
    both = held.unionByName(passing).repartition(parts, "part").sortWithinPartitions("part", "cell")

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, ids, at, x, reach, best, forbidden_ = None, [], [], None, None, None, {}

        def multiply() -> None:
            nonlocal x, reach, best
            if x is None and ids:
                x = np.concatenate(at)
                best, reach = np.full(len(x), -2.0), _reached(x, centers_, wide, least)
            for cell, many in forbidden_.items():
                f = np.concatenate(many)
                for begin in range(0, len(x) if x is not None else 0, ROWS):
                    near = begin + np.flatnonzero(reach[begin : begin + ROWS, cell])
                    for first in range(0, len(f) if len(near) else 0, ROWS):
                        best[near] = np.maximum(best[near], (x[near] @ f[first : first + ROWS].T).max(1))
            forbidden_.clear()

        def done() -> Iterator[pa.RecordBatch]:
            nonlocal ids, at, x, reach
            multiply()
            if x is not None:
                keep = np.flatnonzero(best >= least - 1e-12)
                yield pa.RecordBatch.from_arrays([pa.concat_arrays(ids).take(pa.array(keep)), pa.array(best[keep])], names=["id", "closest"])
            ids, at, x, reach = [], [], None, None

        for b in batches:
            p, c = b.column(0).to_numpy(), b.column(1).to_numpy()
            edges = np.flatnonzero(np.concatenate([[True], (p[1:] != p[:-1]) | (c[1:] != c[:-1]), [True]])) if len(p) else []
            for s, e in zip(edges[:-1], edges[1:], strict=True):
                if p[s] != part:
                    yield from done()
                    part = p[s]
                run = b.slice(s, e - s)
                v = np.array(run.column(3).flatten().to_numpy(zero_copy_only=False), float).reshape(e - s, -1)
                if c[s] < 0:
                    ids.append(run.column(2))
                    at.append(v)
                else:
                    forbidden_.setdefault(int(c[s]), []).append(v)
                    if sum(len(f) for many in forbidden_.values() for f in many) >= ROWS:
                        multiply()
        yield from done()

    best = both.mapInArrow(meet, f"id {dict(rows.dtypes)['id']}, closest double").groupBy(F.col("id").alias(key)).agg(F.max("closest").alias("closest"))
    return vectors.select(key).join(best, key, "left").select(key, "closest", F.coalesce(F.col("closest") * scale, F.lit(0.0)).alias("penalty"))
