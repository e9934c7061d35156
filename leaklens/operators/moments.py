"""What second moments of vectors give: concept erasure, directions of different spread, probes of many layers at once.

Vectors stay where they lie. Tasks add up counts, sums and sums of products; Spark adds those up by group and position;
the driver holds them for a few groups (their number is stated by the caller, their size by the dimensions).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Groups whose moments the driver holds, at most.
MOST_GROUPS = 1000


@dataclass
class Moments:
    """Of one group: how many vectors, their mean, and the mean product of deviations from it."""

    n: int
    mean: np.ndarray
    cov: np.ndarray


def usable(column: str, dims: int) -> Column:
    """Whether a vector has `dims` numbers, all finite."""
    finite = F.forall(column, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce((F.size(column) == dims) & finite, F.lit(False))


def moment_sums(vectors: DataFrame, by: str, column: str = "embedding", dims: int = 64, about: np.ndarray | None = None) -> DataFrame:
    """(by, i, j, v): v is the count where both are null, the sum of x_i where j is null, the sum of x_i x_j for i <= j.

    x is the vector less `about`. One row a task, group and position is shuffled. Rows without a group or a usable
    vector are left out.
    """
    shift = np.zeros(dims) if about is None else about
    upper = np.triu_indices(dims)

    def partial(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict = {}
        for f in frames:
            for k, rows in f.groupby("g", sort=False):
                x = np.stack(rows["x"].to_numpy()).astype(float) - shift
                n, s, g = sums.get(k, (0, 0.0, 0.0))
                sums[k] = (n + len(x), s + x.sum(0), g + x.T @ x)
        for k, (n, s, g) in sums.items():
            i = np.concatenate([[-1], np.arange(dims), upper[0]])
            j = np.concatenate([[-1], np.full(dims, -1), upper[1]])
            yield pd.DataFrame({"g": k, "i": i, "j": j, "v": np.concatenate([[n], s, g[upper]])})

    kind = dict(vectors.dtypes)[by]
    rows = vectors.where(usable(column, dims) & F.col(by).isNotNull()).select(F.col(by).alias("g"), F.col(column).alias("x"))
    added = rows.mapInPandas(partial, f"g {kind}, i int, j int, v double").groupBy("g", "i", "j").agg(F.sum("v").alias("v"))
    null = lambda c: F.when(F.col(c) >= 0, F.col(c))
    return added.select(F.col("g").alias(by), null("i").alias("i"), null("j").alias("j"), "v")


def moments(vectors: DataFrame, by: str, column: str = "embedding", dims: int = 64) -> dict[object, Moments]:
    """Moments of every group in one pass over the vectors; sums are taken about a vector of the table, so that none is small beside its square."""
    first = vectors.where(usable(column, dims) & F.col(by).isNotNull()).select(column).limit(1).collect()
    if not first:
        return {}
    about = np.array(first[0][0], float)
    sums: dict[object, tuple[np.ndarray, np.ndarray, list[float]]] = {}
    for r in moment_sums(vectors, by, column, dims, about).toLocalIterator():
        if r[by] not in sums and len(sums) == MOST_GROUPS:
            raise ValueError(f"more than {MOST_GROUPS} groups")
        s, g, n = sums.setdefault(r[by], (np.zeros(dims), np.zeros((dims, dims)), [0.0]))
        if r["i"] is None:
            n[0] = r["v"]
        elif r["j"] is None:
            s[r["i"]] = r["v"]
        else:
            g[r["i"], r["j"]] = g[r["j"], r["i"]] = r["v"]
    return {k: Moments(int(n), s / n + about, g / n - np.outer(s / n, s / n)) for k, (s, g, (n,)) in sums.items()}


def pooled(groups: dict[object, Moments]) -> Moments:
    """Moments of all groups taken together."""
    n = sum(m.n for m in groups.values())
    mean = sum(m.n * m.mean for m in groups.values()) / n
    return Moments(n, mean, sum(m.n * (m.cov + np.outer(m.mean - mean, m.mean - mean)) for m in groups.values()) / n)


@dataclass
class Eraser:
    """x loses away @ (along @ (x - center)): a map of the rank of the concept, as two thin matrices."""

    center: np.ndarray
    away: np.ndarray
    along: np.ndarray

    def transform(self, vectors: DataFrame, column: str = "embedding") -> DataFrame:
        """The rows with the concept taken out of the vectors, as doubles; rows without a usable vector get null."""
        center, away, along = self.center, self.away, self.along

        @F.pandas_udf("array<double>")
        def erase(v: pd.Series) -> pd.Series:
            if not len(v):
                return pd.Series([], dtype=object)
            x = np.stack(v.to_numpy()).astype(float)
            return pd.Series(list(x - (x - center) @ along.T @ away.T))

        ok, none = usable(column, len(center)), F.lit(None).cast("array<double>")
        return vectors.withColumn(column, F.when(ok, erase(F.when(ok, F.col(column)).otherwise(F.array_repeat(F.lit(0.0), len(center))))).otherwise(none))


def concept_eraser(groups: dict[object, Moments], tolerance: float = 1e-10) -> Eraser:
    """Least-squares erasure of the groups' labels: afterwards all groups have one mean, so no linear probe beats the base rate.

    Vectors are whitened by the pseudo-inverse root of their covariance (directions under `tolerance` of the largest
    eigenvalue have no spread), the cross-covariance with the groups is projected out there, and the rest is brought
    back; of all linear maps with that guarantee it moves the vectors least. One group: nothing is taken out.
    """
    if not groups:
        raise ValueError("no group has a usable vector")
    whole = pooled(groups)
    value, vector = np.linalg.eigh(whole.cov)
    spread = value > tolerance * max(value.max(), 0.0)
    white = (vector[:, spread] / np.sqrt(value[spread])).T if spread.any() else np.zeros((0, len(value)))
    back = vector[:, spread] * np.sqrt(value[spread])
    cross = np.stack([m.n / whole.n * (m.mean - whole.mean) for m in groups.values()], 1)
    left, size, _ = np.linalg.svd(white @ cross, full_matrices=False)
    kept = left[:, size > tolerance * max(size.max(initial=0.0), 1e-300)] if size.max(initial=0.0) > 1e-14 else left[:, :0]
    return Eraser(whole.mean, back @ kept, kept.T @ white)


def spread_difference(a: Moments, b: Moments, k: int) -> np.ndarray:
    """The k orthonormal directions, as rows, in which two groups' covariances differ most: largest absolute eigenvalue of their difference.

    A group of no vectors has no spread. The sign of a direction is free: its largest entry is positive.
    """
    value, vector = np.linalg.eigh(a.cov - b.cov)
    top = vector[:, np.argsort(-np.abs(value), kind="stable")[:k]].T
    return top * np.sign(top[np.arange(len(top)), np.abs(top).argmax(1)])[:, None]


def spread_directions(vectors: DataFrame, forget: Column, k: int, column: str = "embedding", dims: int = 64) -> np.ndarray:
    """spread_difference of the vectors where `forget` holds and the others; rows where it is null are left out."""
    both = moments(vectors.withColumn("_side", forget), "_side", column, dims)
    none = Moments(0, np.zeros(dims), np.zeros((dims, dims)))
    return spread_difference(both.get(True, none), both.get(False, none), k)


def take_out(directions: np.ndarray) -> Eraser:
    """The projection onto what is orthogonal to orthonormal directions."""
    return Eraser(np.zeros(directions.shape[1]), directions.T, directions)


# --- probes ------------------------------------------------------------------------------------------------------------


def probe_layers(rows: DataFrame, dims: int, folds: int = 5, c: float = 1.0, passes: int = 25, tolerance: float = 1e-8) -> DataFrame:
    """(layer, fold, n, accuracy) of logistic probes, all layers and folds fitted together.

    rows: key, layer, x (array of `dims` numbers), y (boolean). A row's fold is a hash of its key; a fold's probe is
    fitted on all other folds by Newton steps on the log loss times `c` plus half the squared weights, the
    intercept free. A pass over the rows adds up every probe's gradient and second derivatives in tasks, then over
    tasks; their number does not depend on layers or folds. It ends when no step is larger than `tolerance`, with an
    error after `passes`. The driver holds layers x folds x dims^2 numbers.
    """
    fold = F.pmod(F.xxhash64("key"), F.lit(folds)).cast("int")
    data = rows.where(usable("x", dims)).where("y is not null and layer is not null").select("layer", "x", F.col("y").cast("double").alias("y"), fold.alias("fold"))
    layers = [r[0] for r in data.select("layer").distinct().orderBy("layer").limit(MOST_GROUPS + 1).collect()]
    if len(layers) > MOST_GROUPS:
        raise ValueError(f"more than {MOST_GROUPS} layers")
    weights = {(layer, f): np.zeros(dims + 1) for layer in layers for f in range(folds)}
    kind, wide = dict(rows.dtypes)["layer"], dims + 1
    upper = np.triu_indices(wide)
    free = np.append(np.ones(dims), 0.0)  # the intercept is not held small

    def step(now: dict) -> DataFrame:
        def partial(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            sums: dict = {}
            for part in frames:
                for layer, g in part.groupby("layer", sort=False):
                    x = np.column_stack([np.stack(g["x"].to_numpy()).astype(float), np.ones(len(g))])
                    y, own = g["y"].to_numpy(), g["fold"].to_numpy()
                    for f in range(folds):
                        use = own != f
                        p = 1 / (1 + np.exp(-np.clip(x[use] @ now[layer, f], -500, 500)))
                        slope = x[use].T @ (p - y[use])
                        curve = (x[use].T * (p * (1 - p))) @ x[use]
                        old = sums.get((layer, f), (0.0, 0.0))
                        sums[layer, f] = (old[0] + slope, old[1] + curve[upper])
            for (layer, f), (slope, curve) in sums.items():
                v = np.concatenate([slope, curve])
                yield pd.DataFrame({"layer": layer, "fold": f, "i": np.arange(len(v)), "v": v})

        return data.mapInPandas(partial, f"layer {kind}, fold int, i int, v double").groupBy("layer", "fold", "i").agg(F.sum("v").alias("v"))

    for _ in range(passes if layers else 0):
        total = {k: np.zeros(wide + len(upper[0])) for k in weights}
        for r in step(weights).toLocalIterator():
            total[r["layer"], r["fold"]][r["i"]] = r["v"]
        largest = 0.0
        for k, v in total.items():
            curve = np.zeros((wide, wide))
            curve[upper] = v[wide:]
            curve = curve + curve.T - np.diag(np.diag(curve))
            move = np.linalg.lstsq(c * curve + np.diag(free), c * v[:wide] + free * weights[k], rcond=None)[0]
            size = np.abs(move).max()
            weights[k] = weights[k] - move * min(1.0, 10.0 / max(size, 1e-300))  # far steps are shortened
            largest = max(largest, size)
        if largest <= tolerance:
            break
    else:
        if layers:
            raise RuntimeError("the probes did not settle")

    def judge(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in frames:
            for (layer, f), g in part.groupby(["layer", "fold"], sort=False):
                x = np.column_stack([np.stack(g["x"].to_numpy()).astype(float), np.ones(len(g))])
                hit = ((x @ weights[layer, f] > 0) == (g["y"].to_numpy() > 0.5)).sum()
                yield pd.DataFrame({"layer": [layer], "fold": [f], "n": [len(g)], "hit": [int(hit)]})

    seen = data.mapInPandas(judge, f"layer {kind}, fold int, n long, hit long").groupBy("layer", "fold").agg(F.sum("n").alias("n"), F.sum("hit").alias("hit"))
    return seen.select("layer", "fold", "n", (F.col("hit") / F.col("n")).alias("accuracy"))


def probe_summary(folds: DataFrame) -> DataFrame:
    """(layer, accuracy, sd) over a layer's folds: the mean and the population deviation."""
    return folds.groupBy("layer").agg(F.avg("accuracy").alias("accuracy"), F.stddev_pop("accuracy").alias("sd"))
