"""Bootstrap intervals whose weights are hashes: rows are weighted where they lie and only sums are shuffled."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Weights come from numbers below this prime, so every product fits in 63 bits.
PRIME = (1 << 31) - 1
#: Rows that are weighted together, cells whose sums a task holds, and cells that it sends together.
ROWS, CELLS, SENT = 256, 200, 16


def limits(prime: int = PRIME) -> list[int]:
    """Least numbers below the prime that stand for a weight of 1, 2, 3 ... of a Poisson variable with mean 1."""
    out, k, term, sum_ = [], 0, math.exp(-1), 0.0
    while True:
        sum_ += term
        at = math.floor(sum_ * prime)
        if at >= prime or (out and at == out[-1]) or k > 12:
            return out
        out.append(at)
        k += 1
        term /= k


#: Steps from one replicate to the next, and how often a number is squared: weights are a polynomial of both hashes.
STEPS = (1_000_000_007, 1_618_033_989, 1_414_213_562)


def drawn(h: np.ndarray, rounds: int) -> np.ndarray:
    """Numbers below the prime for rows' hashes and each replicate: (rows, rounds)."""
    x, r = h[:, None], np.arange(1, rounds + 1)[None]
    for k in STEPS:
        y = (x + r * k) % PRIME
        x = (y * y % PRIME + h[:, None]) % PRIME
    return x


def row_hash(key: Column, seed: int) -> Column:
    digits = F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit("null")))), 1, 8)
    return F.conv(digits, 16, 10).cast("long") % PRIME


def resampled(rows: DataFrame, by: list[str], key: Column, sums: dict[str, Column], rounds: int = 1000, seed: int = 0) -> DataFrame:
    """(by, replicate, weight, sums): every replicate's weighted sums of each cell.

    In a replicate a row counts Poisson(1) times, which resamples a cell of any size without knowing it. A row's weights
    are a hash of its key and the replicate, so they do not depend on partitions, and rows of one key have one
    weight. Tasks add up weights and weighted values of some thousand rows at a time, by products of matrices; a row for
    each task, cell and replicate is shuffled, and no cell is gathered.
    """
    base = rows.select(*by, row_hash(key, seed).alias("_h"), *[c.cast("double").alias(n) for n, c in sums.items()])
    base = base.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))  # a few small partitions would become large here; dealt in turn, as a key may have many rows
    names, steps = list(sums), np.array(limits())
    kinds = dict(base.dtypes)

    def rows_of(held: dict) -> Iterator[pd.DataFrame]:
        cells = list(held.items())
        for begin in range(0, len(cells), SENT):
            out = pd.concat([pd.DataFrame({**{c: [v] * rounds for c, v in zip(by, k, strict=True)}, "replicate": np.arange(rounds), "weight": w, **{n: t[:, i] for i, n in enumerate(names)}}) for k, (w, t) in cells[begin : begin + SENT]])
            yield out[out["weight"] > 0]

    def add(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict = {}
        for f in frames:
            for begin in range(0, len(f), ROWS):
                part = f.iloc[begin : begin + ROWS]
                w = np.searchsorted(steps, drawn(part["_h"].to_numpy(np.int64), rounds), "right")
                x = part[names].to_numpy(float)
                for k, at in part.groupby(by, dropna=False, sort=False).indices.items():
                    k = tuple(None if v != v else v for v in (k if isinstance(k, tuple) else (k,)))
                    old = held.get(k, (0, 0.0))
                    held[k] = (old[0] + w[at].sum(0), old[1] + w[at].T.astype(float) @ x[at])
                if len(held) > CELLS:
                    yield from rows_of(held)
                    held = {}
        yield from rows_of(held)

    schema = ", ".join(f"{c} {kinds[c]}" for c in by) + ", replicate int, weight long" + "".join(f", {n} double" for n in names)
    each = base.mapInPandas(add, schema)
    return each.groupBy(*by, "replicate").agg(F.sum("weight").alias("weight"), *[F.sum(n).alias(n) for n in names])


def interval(rows: DataFrame, by: list[str], value: str, level: float = 0.95) -> DataFrame:
    """(by, low, high): the percentile interval of a value over replicates."""
    tail = (1 - level) / 2
    both = F.percentile(value, F.array(F.lit(tail), F.lit(1 - tail)))
    return rows.groupBy(*by).agg(both.alias("_p")).select(*by, F.col("_p")[0].alias("low"), F.col("_p")[1].alias("high"))


def mean_interval(rows: DataFrame, by: list[str], value: str, key: Column, rounds: int = 1000, seed: int = 0) -> DataFrame:
    """(by, mean, low, high) of each cell's mean; null values do not count."""
    known = rows.where(F.col(value).isNotNull())
    each = resampled(known, by, key, {"total": F.col(value)}, rounds, seed).select(*by, (F.col("total") / F.col("weight")).alias("m"))
    return known.groupBy(*by).agg(F.avg(F.col(value).cast("double")).alias("mean")).join(interval(each, by, "m"), by)


def share_interval(records: DataFrame, by: list[str], channels: tuple[str, ...], key: Column, rounds: int = 1000, seed: int = 0) -> DataFrame:
    """(by, channel, share, low, high): each channel's share of a cell's leak rates.

    A record has a 0/1 column for each channel and n_<channel>, whether it counts there. Without leaks shares are 0.
    """
    sums = {f"hit_{c}": F.col(c) * F.col(f"n_{c}") for c in channels} | {f"seen_{c}": F.col(f"n_{c}").cast("double") for c in channels}

    def shares(df: DataFrame, more: list[str]) -> DataFrame:
        rate = {c: F.coalesce(F.try_divide(F.col(f"hit_{c}"), F.col(f"seen_{c}")), F.lit(0.0)) for c in channels}
        rows = df.select(*by, *more, *[x.alias(c) for c, x in rate.items()])
        total = sum((F.col(c) for c in channels[1:]), F.col(channels[0]))
        slots = F.array(*[F.struct(F.lit(c).alias("channel"), F.coalesce(F.try_divide(F.col(c), total), F.lit(0.0)).alias("share")) for c in channels])
        return rows.select(*by, *more, F.explode(slots).alias("s")).select(*by, *more, "s.channel", "s.share")

    own = shares(records.groupBy(*by).agg(*[F.sum(c).cast("double").alias(n) for n, c in sums.items()]), [])
    drawn = shares(resampled(records, by, key, sums, rounds, seed), ["replicate"])
    return own.join(interval(drawn, [*by, "channel"], "share"), [*by, "channel"])
