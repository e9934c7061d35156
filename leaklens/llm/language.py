"""Language identification that fuses text, declared language, address suffix and host."""

from __future__ import annotations

import math
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leaklens.llm.shared import local_rows, pieces, small_batches, stash, utf8

#: Buckets of the hashed byte trigrams.
BUCKETS = 1 << 14
#: Labelled documents the text model is fitted on at most, the first by a hash of their id; so it has no more languages.
SAMPLE = 3000
#: Trigrams overlap, so a text counts as at most so many independent ones.
GRAMS = 60.0
#: Pseudo-counts by which a suffix leans on all pages, and a host on its suffix.
LEAN_SUFFIX, LEAN_HOST = 20.0, 10.0
#: Posterior below which a text is not accepted.
LEAST_POSTERIOR = 0.5
#: Share of texts expected to be in none of the fitted languages, and what a trigram of theirs has as logarithm: any bucket alike.
NONE_OF_THEM, ANY_BUCKET = 0.01, -math.log(BUCKETS)

_LOWER = np.arange(256, dtype=np.uint32)
_LOWER[65:91] += 32
_TAGS = re.compile(r"<!--.*?(?:-->|\Z)|<(script|style)\b.*?(?:</\1\s*>|\Z)|<[^>]*>", re.S | re.I)
_LANG = re.compile(r"<html\b[^>]*?(?<![\w:.-])lang\s*=\s*[\"']?\s*([A-Za-z]{2,3})", re.I)


def grams(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all byte trigrams of texts laid end to end, and where each text's begin."""
    if len(data) < 3:
        return np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    low = _LOWER[data]
    code = (low[:-2] << np.uint32(16)) | (low[1:-1] << np.uint32(8)) | low[2:]
    bucket = ((code * np.uint32(2654435761)) >> np.uint32(18)).astype(np.int64)
    inside = np.ones(len(bucket), bool)
    for back in (1, 2):  # a trigram across two texts belongs to neither
        at = offsets[1:-1] - back
        inside[at[(at >= 0) & (at < len(bucket))]] = False
    count = np.concatenate([[0], np.cumsum(inside)])
    return bucket[inside], count[np.minimum(offsets, len(bucket))]


def fit(labelled: DataFrame, text: str = "text", label: str = "lang", key: str = "doc_id") -> tuple[list[str], np.ndarray]:
    """Languages and their log probabilities of trigram buckets, from at most SAMPLE labelled rows."""
    spark = labelled.sparkSession
    small_batches(spark)
    chosen = labelled.where(F.col(label).isNotNull() & (F.length(text) > 0) & F.col(key).isNotNull()).select(F.col(key).alias("key")).orderBy(F.xxhash64(key), key).limit(SAMPLE).collect()
    ids = local_rows(spark, [(r["key"],) for r in chosen], "key long").distinct()
    rows = labelled.select(F.col(key).cast("long").alias("key"), F.col(label).alias("lang"), F.col(text).alias("text")).join(F.broadcast(ids), "key")

    def count(batches):
        total: dict[str, np.ndarray] = {}
        for b in batches:
            for part in pieces(b, "text"):
                langs = part.column(0).to_pylist()
                bucket, begin = grams(*utf8(part.column(1)))
                for lang, s, e in zip(langs, begin[:-1], begin[1:], strict=True):
                    if lang is not None:
                        total.setdefault(lang, np.zeros(BUCKETS, np.int64))
                        total[lang] += np.bincount(bucket[s:e], minlength=BUCKETS)
        for lang, n in total.items():
            at = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at), pa.array(n[at])], names=["lang", "bucket", "n"])

    sums = rows.select("lang", "text").mapInArrow(count, "lang string, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    weight: dict[str, int] = {}
    got = sums.collect()
    for r in got:
        weight[r["lang"]] = weight.get(r["lang"], 0) + r["n"]
    langs = sorted(weight)
    place = {x: i for i, x in enumerate(langs)}
    table = np.full((BUCKETS, max(len(langs), 1)), 0.5)
    for r in got:
        table[r["bucket"], place[r["lang"]]] += r["n"]
    return langs, np.log(table / table.sum(0)).astype(np.float32)


def identify(rows: DataFrame, model: tuple[list[str], np.ndarray], html: bool = False) -> DataFrame:
    """key, lang, posterior, text_lang, declared, n_grams, accepted for rows of (key, body, declared, host).

    Evidence, added as logarithms: trigram likelihoods, tempered; the declared language (of the <html> tag where
    html is set), by how often each declaration goes with each language; and the host's prior, its own soft counts
    leaning on its address suffix's, these on all rows'. All counts are grouped sums over all rows of the
    text-only posteriors. One more class stands for all other languages and for what is no language: each bucket
    is as likely there, declarations go as over all rows, hosts say nothing. lang is the best of the fitted
    languages, posterior its share with that class counted. accepted: the text has a trigram with a letter and
    the posterior is LEAST_POSTERIOR or more.

    Null or empty bodies have no text evidence and are not accepted. Null hosts and declarations are values of
    their own. Repeated rows and null keys come back as often as they came. Ties go to the first language by
    name. An empty table gives no rows; a model without languages gives null languages, not accepted. Other columns
    are ignored, whatever their names.
    """
    langs, table = model
    spark = rows.sparkSession
    small_batches(spark)
    n = max(len(langs), 1)
    sent = spark.sparkContext.broadcast(table)

    def score(batches):
        weights = sent.value
        for b in batches:
            for part in pieces(b, "body"):
                declared = part.column(2)
                body = part.column(1)
                if html:
                    raw = body.to_pylist()
                    found = [_LANG.search(x) if x else None for x in raw]
                    declared = pa.array([m[1].lower() if m else None for m in found], pa.string())
                    body = pa.array([None if x is None else _TAGS.sub(" ", x) for x in raw], pa.string())
                data, offsets = utf8(body)
                bucket, begin = grams(data, offsets)
                sizes = np.diff(begin)
                totals = np.zeros((len(sizes), n))
                full = np.flatnonzero(sizes)
                if len(full):
                    totals[full] = np.add.reduceat(weights[bucket], begin[:-1][full], axis=0, dtype=np.float64)
                letters = np.concatenate([[0], np.cumsum((data >= 128) | ((data | 32) >= 97) & ((data | 32) <= 122))])
                has = letters[offsets[1:]] > letters[offsets[:-1]]
                mean = totals / np.maximum(sizes, 1)[:, None] * np.minimum(sizes, GRAMS)[:, None]
                yield pa.RecordBatch.from_arrays([part.column(0), declared, part.column(3), pa.array(sizes), pa.array(has), pa.FixedSizeListArray.from_arrays(pa.array(mean.ravel()), n).cast(pa.list_(pa.float64()))], names=["key", "declared", "host", "n_grams", "has", "text"])

    scored = stash(rows.select(F.col("key").cast("long").alias("key"), "body", F.col("declared").cast("string").alias("declared"), F.col("host").cast("string").alias("host")).mapInArrow(score, "key long, declared string, host string, n_grams long, has boolean, text array<double>"), "language")
    known = F.array(*[F.lit(x) for x in langs]) if langs else F.array().cast("array<string>")
    word = F.lower(F.regexp_extract("declared", r"^\s*([A-Za-z]{2,3})", 1))
    scored = scored.withColumn("said", F.when(F.col("declared").isNull(), "none").when(F.array_contains(known, word), word).otherwise("other"))
    scored = scored.withColumn("suffix", F.coalesce(F.regexp_extract("host", r"\.([^.:]+)(?::\d+)?$", 1), F.lit("")))

    def posterior(log: F.Column) -> F.Column:
        return F.transform(F.array(F.transform(log, lambda x: F.exp(x - F.array_max(log)))), lambda e: F.transform(e, lambda x: x / F.aggregate(e, F.lit(0.0), lambda a, y: a + y)))[0]

    scored = scored.withColumn("none_log", F.least("n_grams", F.lit(GRAMS)) * ANY_BUCKET + math.log(NONE_OF_THEM))
    scored = scored.withColumn("all", F.concat("text", F.array("none_log"))).withColumn("p", F.slice(posterior(F.col("all")), 1, n))
    evidence = scored.where("has and n_grams > 0")
    sums = [F.sum(F.col("p")[i]).alias(f"c{i}") for i in range(n)]
    by_said = {r["said"]: np.array([r[f"c{i}"] or 0.0 for i in range(n)]) for r in evidence.groupBy("said").agg(*sums).collect()}
    whole = sum(by_said.values(), np.zeros(n))
    prior = (whole + 1.0) / (whole.sum() + n)
    words = [*langs, "none", "other"]
    seen = np.array([by_said.get(x, np.zeros(n)) for x in words]) + 0.5 / len(words)
    said = np.log(seen / seen.sum(0))
    anyhow = np.log(seen.sum(1) / seen.sum())
    says = local_rows(spark, [(x, [float(v) for v in said[i]], float(anyhow[i])) for i, x in enumerate(words)], "said string, said_log array<double>, said_any double")
    flat = F.array(*[F.lit(float(x)) for x in prior])
    lean = lambda counts, base, k: F.zip_with(counts, base, lambda c, b: (c + b * F.lit(k)))
    share = lambda counts: F.transform(F.array(counts), lambda v: F.transform(v, lambda x: x / F.aggregate(v, F.lit(0.0), lambda a, y: a + y)))[0]
    own = F.array(*[F.col(f"c{i}") for i in range(n)])
    suffixes = evidence.groupBy("suffix").agg(*sums).select("suffix", share(lean(own, flat, LEAN_SUFFIX)).alias("suffix_p"))
    hosts = evidence.groupBy("host", "suffix").agg(*sums).select("host", "suffix", own.alias("counts")).join(suffixes, "suffix").select(F.col("host").alias("at"), F.transform(share(lean(F.col("counts"), F.col("suffix_p"), LEAN_HOST)), F.ln).alias("host_log"))
    fused = scored.join(F.broadcast(says), "said").join(hosts, F.coalesce(scored["host"], F.lit("\0")) == F.coalesce(hosts["at"], F.lit("\0")), "left")
    base = F.array(*[F.lit(math.log(x)) for x in prior])
    fused = fused.withColumn("log", F.zip_with(F.zip_with("text", "said_log", lambda a, b: a + b), F.coalesce("host_log", base), lambda a, b: a + b))
    fused = fused.withColumn("all", F.concat("log", F.array(F.col("none_log") + F.col("said_any")))).withColumn("q", F.slice(posterior(F.col("all")), 1, n))
    best = F.array_max("q")
    names = F.array(*[F.lit(x) for x in (langs or [None])]).cast("array<string>")
    pick = lambda q: names[(F.array_position(q, F.array_max(q)) - 1).cast("int")]
    return fused.select("key", pick(F.col("q")).alias("lang"), best.alias("posterior"), F.when(F.col("n_grams") > 0, pick(F.col("p"))).alias("text_lang"), "declared", "n_grams", (F.col("has") & (F.col("n_grams") > 0) & (best >= LEAST_POSTERIOR) & F.lit(bool(langs))).alias("accepted"))


def host_of(url: F.Column) -> F.Column:
    """Lower-cased host of an address; null if there is none."""
    return F.nullif(F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1)), F.lit(""))
