"""Statistics as columns and small grouped functions."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType


def log_factorial(n: Column) -> Column:
    """ln n!, summed exactly."""
    return F.aggregate(F.sequence(F.lit(1), F.greatest(n.cast("int"), F.lit(1))), F.lit(0.0), lambda a, k: a + F.ln(k.cast("double")))


def mcnemar_exact(b: Column, c: Column) -> Column:
    """Two-sided exact test of b against c discordant pairs; 1 without any. Binomials grow as logarithms, so none underflows."""
    n = (b + c).cast("double")
    steps = F.sequence(F.lit(0), F.least(b, c).cast("int"))
    start = F.struct((-n * F.lit(math.log(2.0))).alias("term"), F.lit(0.0).alias("sum"))
    tail = F.aggregate(steps, start, lambda s, k: F.struct((s["term"] + F.ln((n - k) / (k + 1.0))).alias("term"), (s["sum"] + F.exp(s["term"])).alias("sum")), lambda s: s["sum"])
    return F.when(n == 0, 1.0).otherwise(F.least(F.lit(1.0), 2 * tail))


def erfc(x: Column, terms: int = 80) -> Column:
    """Complementary error function of x >= 0: its series up to 2, beyond it a continued fraction read from the far end."""
    ks = F.sequence(F.lit(1), F.lit(terms))
    start = F.struct(x.cast("double").alias("term"), x.cast("double").alias("sum"))
    near = F.aggregate(ks, start, lambda s, k: F.struct((s["term"] * 2 * x * x / (2 * k + 1)).alias("term"), (s["sum"] + s["term"] * 2 * x * x / (2 * k + 1)).alias("sum")), lambda s: s["sum"])
    far = F.aggregate(F.reverse(ks), F.lit(0.0), lambda a, k: (k / 2.0) / (x + a))
    scale = F.exp(-x * x) / math.sqrt(math.pi)
    return F.when(x < 2, 1 - 2 * scale * near).otherwise(scale / (x + far))


def mcnemar_asymptotic(b: Column, c: Column) -> Column:
    """Continuity-corrected chi-square test; 1 where it has nothing to go on."""
    n = (b + c).cast("double")
    chi = F.pow(F.greatest(F.abs(b - c) - 1, F.lit(0)), F.lit(2)) / n
    return F.when((n == 0) | (chi == 0), 1.0).otherwise(erfc(F.sqrt(chi / 2)))


def ks_pvalue(d: Column, n: Column, m: Column) -> Column:
    """Two-sided two-sample p by the limiting distribution; 1 without one of the sides or for a small distance."""
    t = d * F.sqrt(n * m / (n + m).cast("double"))
    sum_ = F.aggregate(F.sequence(F.lit(1), F.lit(100)), F.lit(0.0), lambda a, k: a + F.when(k % 2 == 1, 1.0).otherwise(-1.0) * F.exp(-2 * k * k * t * t))
    return F.when((n > 0) & (m > 0) & (t > 0.04), F.least(F.lit(1.0), F.greatest(F.lit(0.0), 2 * sum_))).otherwise(1.0)


#: Up to this size of the larger side the two-sample p is exact.
EXACT = 10_000


def _lattice(d: float, n: int, m: int) -> float:
    """Probability that a random order of n and m values has a distance of d or more.

    Orders are lattice paths from (0, 0) to (n, m). The mass of each diagonal's points is folded into the next one's;
    what steps to a point with |i/n - j/m| >= d has left and is added up.
    """
    bound, mass, left = round(d * n * m), np.ones(1), 0.0
    if bound <= 0:
        return 1.0
    i = np.zeros(1, np.int64)
    for k in range(n + m):  # points (i, k - i) with mass
        rest = n + m - k
        low = i[0]
        to = np.zeros(len(i) + 1)
        to[1:] += mass * (n - i) / rest
        to[:-1] += mass * (m - (k - i)) / rest
        i = np.arange(low, low + len(to))
        out = (np.abs(i * m - (k + 1 - i) * n) >= bound) | (i > n) | (k + 1 - i > m)
        left += to[out].sum()
        if out.all():
            break
        keep = np.flatnonzero(~out)
        mass, i = to[keep[0] : keep[-1] + 1], i[keep[0] : keep[-1] + 1]
    return float(min(1.0, left))


@F.pandas_udf(DoubleType())
def _exact_ks(d: pd.Series, n: pd.Series, m: pd.Series) -> pd.Series:
    return pd.Series([_lattice(x, int(a), int(b)) for x, a, b in zip(d, n, m, strict=True)], dtype=float)


def ks_exact_pvalue(d: Column, n: Column, m: Column) -> Column:
    """Two-sided two-sample p of a distance: exact where neither side has over EXACT values, else by the limiting law; 1 without one of the sides."""
    small = (n > 0) & (m > 0) & (n <= EXACT) & (m <= EXACT)
    none = F.lit(0).cast("long")
    return F.when(small, _exact_ks(F.when(small, d).otherwise(0.0), F.when(small, n).otherwise(none), F.when(small, m).otherwise(none))).otherwise(ks_pvalue(d, n, m))


def tv_of_maps(a: Column, b: Column) -> Column:
    """Total variation distance of two maps from names to shares; a name that one lacks has share 0 there. Null maps are empty."""
    empty = F.create_map().cast("map<string,double>")
    a, b = F.coalesce(a, empty), F.coalesce(b, empty)
    at = lambda m, k: F.coalesce(F.try_element_at(m, k), F.lit(0.0))
    return 0.5 * F.aggregate(F.array_union(F.map_keys(a), F.map_keys(b)), F.lit(0.0), lambda s, k: s + F.abs(at(a, k) - at(b, k)))


def normalised_probability(logprobs: Column) -> Column:
    """exp of the mean log probability of a text's tokens; 0 without any."""
    n = F.size(logprobs)
    return F.when(F.coalesce(n, F.lit(0)) <= 0, 0.0).otherwise(F.exp(F.aggregate(logprobs, F.lit(0.0), lambda a, x: a + x) / n))


def first_argmax(scores: Column) -> Column:
    """Index of the largest score, the first of equals."""
    return (F.array_position(scores, F.array_max(scores)) - 1).cast("int")


def mean_or_zero(c: str) -> Column:
    return F.coalesce(F.avg(c), F.lit(0.0))


def bh_adjust(tests: DataFrame, family: list[str], p: str = "p", order: list[str] | None = None) -> DataFrame:
    """Step-up false-discovery control in each family: adds p_adj. Families are small: rows of a test table."""
    asc = Window.partitionBy(*family).orderBy(p, *(order or []))
    rows = tests.withColumn("rk", F.row_number().over(asc)).withColumn("m", F.count("*").over(Window.partitionBy(*family)))
    down = Window.partitionBy(*family).orderBy(F.desc("rk")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return rows.withColumn("p_adj", F.least(F.lit(1.0), F.min(F.col(p) * F.col("m") / F.col("rk")).over(down))).drop("rk", "m")


def harmonic_mean(*columns: str, least: float = 1e-6) -> Column:
    """Harmonic mean of columns, each `least` at least."""
    return len(columns) / sum((1 / F.greatest(F.col(c), F.lit(least)) for c in columns[1:]), 1 / F.greatest(F.col(columns[0]), F.lit(least)))


def lcs_f(a: list[str], b: list[str]) -> float:
    """F measure of the longest common subsequence of two word lists."""
    if not a or not b:
        return 0.0
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b, 1):
            row[j], last = (last + 1 if x == y else max(row[j], row[j - 1])), row[j]
    common = row[-1]
    return 2 * common / (len(a) + len(b)) if common else 0.0


class Stemmer:
    """Porter's suffix stripping of 1980, for ROUGE: words of over three letters are stemmed."""

    #: Suffixes and what they become, by step.
    STEP2 = (("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"), ("izer", "ize"), ("abli", "able"), ("alli", "al"), ("entli", "ent"), ("eli", "e"), ("ousli", "ous"), ("ization", "ize"), ("ation", "ate"), ("ator", "ate"), ("alism", "al"), ("iveness", "ive"), ("fulness", "ful"), ("ousness", "ous"), ("aliti", "al"), ("iviti", "ive"), ("biliti", "ble"))
    STEP3 = (("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"), ("ful", ""), ("ness", ""))
    STEP4 = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ou", "ism", "ate", "iti", "ous", "ive", "ize", "sion", "tion")

    def __init__(self) -> None:
        self.known: dict[str, str] = {}

    @staticmethod
    def _shape(w: str) -> str:
        """c and v for each letter; a y after a consonant is a vowel."""
        out = ""
        for ch in w:
            out += "v" if ch in "aeiou" or (ch == "y" and out.endswith("c")) else "c"
        return out

    def _measure(self, w: str) -> int:
        """How often a consonant follows a vowel."""
        return self._shape(w).count("vc")

    def _short(self, w: str) -> bool:
        return self._shape(w)[-3:] == "cvc" and len(w) > 2 and w[-1] not in "wxy"

    def _swap(self, w: str, pairs) -> str:
        for end, new in sorted(pairs, key=lambda p: -len(p[0])):
            if w.endswith(end):
                root = w[: -len(end)]
                return root + new if self._measure(root) > 0 else w
        return w

    def __call__(self, w: str) -> str:
        if len(w) <= 3:
            return w
        if w not in self.known:
            if len(self.known) > 100_000:
                self.known.clear()
            self.known[w] = self._stem(w)
        return self.known[w]

    def _stem(self, w: str) -> str:
        if w.endswith("sses") or w.endswith("ies"):
            w = w[:-2]
        elif w.endswith("s") and not w.endswith("ss"):
            w = w[:-1]
        if w.endswith("eed"):
            w = w[:-1] if self._measure(w[:-3]) > 0 else w
        else:
            root = w[:-2] if w.endswith("ed") else w[:-3] if w.endswith("ing") else None
            if root is not None and "v" in self._shape(root):
                w = root
                if w.endswith(("at", "bl", "iz")):
                    w += "e"
                elif len(w) > 1 and w[-1] == w[-2] and self._shape(w)[-1] == "c" and w[-1] not in "lsz":
                    w = w[:-1]
                elif self._measure(w) == 1 and self._short(w):
                    w += "e"
        if w.endswith("y") and "v" in self._shape(w[:-1]):
            w = w[:-1] + "i"
        w = self._swap(self._swap(w, self.STEP2), self.STEP3)
        for end in sorted(self.STEP4, key=len, reverse=True):
            if w.endswith(end):
                cut = 3 if end in ("sion", "tion") else len(end)
                w = w[:-cut] if self._measure(w[:-cut]) > 1 else w
                break
        if w.endswith("e") and (self._measure(w[:-1]) > 1 or (self._measure(w[:-1]) == 1 and not self._short(w[:-1]))):
            w = w[:-1]
        if w.endswith("ll") and self._measure(w[:-1]) > 1:
            w = w[:-1]
        return w


@F.pandas_udf(StructType([StructField("f", DoubleType()), StructField("recall", DoubleType())]))
def rouge_l(candidate: pd.Series, reference: pd.Series) -> pd.DataFrame:
    """Longest-common-subsequence F and recall of stemmed lower-case runs of letters and digits; 0 without words."""
    import re

    stem = Stemmer()
    words = lambda t: [stem(w) for w in re.findall("[a-z0-9]+", (t or "").lower())]
    out = []
    for x, y in zip(candidate, reference, strict=True):
        a, b = words(x), words(y)
        f = lcs_f(a, b)
        out.append((f, f * (len(a) + len(b)) / 2 / len(b) if b else 0.0))
    return pd.DataFrame(out, columns=["f", "recall"])
