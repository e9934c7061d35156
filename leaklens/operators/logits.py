"""What methods do to a model's scores of the next token, over stored scores: bans, penalties, noise, losses, adapters."""

from __future__ import annotations

import math
from abc import ABC, abstractmethod

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leaklens.operators.search import dot


def ban(scores: Column, tokens: Column) -> Column:
    """Scores with minus infinity at the token ids of a list; null lists ban nothing."""
    return F.transform(scores, lambda x, i: F.when(F.array_contains(F.coalesce(tokens, F.array().cast("array<int>")), i), float("-inf")).otherwise(x))


def penalise(scores: Column, penalties: Column) -> Column:
    """Scores less a penalty for each token; a shorter list of penalties leaves the rest as they are."""
    return F.transform(scores, lambda x, i: x - F.coalesce(F.get(penalties, i), F.lit(0.0)))


def _unit(*parts: Column) -> Column:
    digits = F.substring(F.md5(F.concat_ws(":", *[p.cast("string") for p in parts])), 1, 13)
    return (F.conv(digits, 16, 10).cast("double") + 0.5) / float(1 << 52)


def noisy(scores: Column, key: Column, sigma: float = 1.0, seed: int = 0) -> Column:
    """Scores with normal noise of one size on every token, drawn from a hash of the row's key and the token's place, so that reruns agree."""
    s = F.lit(seed)

    def one(x: Column, i: Column) -> Column:
        return x + sigma * F.sqrt(-2 * F.ln(_unit(s, key, i, F.lit("a")))) * F.cos(2 * math.pi * _unit(s, key, i, F.lit("b")))

    return F.transform(scores, one)


def softmax(scores: Column) -> Column:
    most = F.array_max(scores)
    return F.transform(F.array(F.transform(scores, lambda x: F.exp(x - most))), lambda e: F.transform(e, lambda x: x / F.aggregate(e, F.lit(0.0), lambda a, y: a + y)))[0]


def inverted_hinge(probabilities: Column, target: Column, margin: float = 1.0) -> Column:
    """max(0, margin + p_target - the largest other p): 0 once another token is ahead by the margin. Null where the target is no place of the list."""
    own = F.get(probabilities, target)
    rest = F.array_max(F.filter(probabilities, lambda _, i: i != target))
    return F.when(own.isNotNull(), F.greatest(F.lit(0.0), margin + own - F.coalesce(rest, F.lit(0.0))))


def orthogonality(old: DataFrame, new: DataFrame, layer: str = "layer", row: str = "row") -> DataFrame:
    """overlap: the squared Frobenius norm of A_old A_new^T, summed over layers and divided by their number; 0 for spans that are orthogonal.

    Adapters' down-projections come as rows (layer, vector `row`), a few for each layer; only layers of both count.
    """
    pairs = old.select(layer, F.col(row).alias("_a")).join(new.select(layer, F.col(row).alias("_b")), layer)
    each = pairs.groupBy(layer).agg(F.sum(F.pow(dot("_a", "_b"), F.lit(2.0))).alias("x"))
    return each.agg(F.coalesce(F.sum("x") / F.count("*"), F.lit(0.0)).alias("overlap"))


def zeroed(vector: Column, places: Column) -> Column:
    """A vector with zeros at a list of places: neurons that are switched off; null lists switch none."""
    return F.transform(vector, lambda x, i: F.when(F.array_contains(F.coalesce(places, F.array().cast("array<int>")), i), 0.0).otherwise(x))


class ScoreProcessor(ABC):
    """A plug-in with the call that decoders make: rows with the ids so far and the next token's scores come back with other scores."""

    name: str

    @abstractmethod
    def __call__(self, rows: DataFrame, input_ids: str = "input_ids", scores: str = "scores") -> DataFrame: ...


class BanSequences(ScoreProcessor):
    """The last token of every forbidden sequence gets minus infinity where the ids so far end with the others."""

    name = "sequence_suppression"

    def __init__(self, sequences: DataFrame) -> None:
        self.sequences = sequences

    def __call__(self, rows: DataFrame, input_ids: str = "input_ids", scores: str = "scores") -> DataFrame:
        """rows have a unique column key; sequences have a column tokens, of ids."""
        from leaklens.operators.suppression import banned_next

        as_text = lambda c: F.transform(c, lambda x: x.cast("string"))
        found = banned_next(rows.select("key", as_text(F.col(input_ids)).alias("tokens")), self.sequences.select(as_text(F.col("tokens")).alias("tokens")), "key")
        ids = F.transform("banned", lambda x: x.cast("int"))
        return rows.join(found.select("key", ids.alias("_ids")), "key", "left").withColumn(scores, ban(F.col(scores), F.col("_ids"))).drop("_ids")


class Noise(ScoreProcessor):
    """Normal noise on all scores."""

    name = "gaussian_noise"

    def __init__(self, sigma: float = 1.0, seed: int = 0) -> None:
        self.sigma, self.seed = float(sigma), seed

    def __call__(self, rows: DataFrame, input_ids: str = "input_ids", scores: str = "scores") -> DataFrame:
        return rows.withColumn(scores, noisy(F.col(scores), F.col("key"), self.sigma, self.seed))
