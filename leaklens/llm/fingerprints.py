"""Document fingerprints: bottom-k sketches of word shingles, with DataFrame functions only."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leaklens.llm.shared import stash

#: Hashes a sketch keeps.
K = 128
#: Words of a shingle.
WORDS = 5


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value computed once a row however often it is used."""
    return F.transform(F.array(value), use)[0]


def sketch(text: Column, k: int = K, words: int = WORDS) -> Column:
    """The k least distinct hashes of the text's shingles, ascending; empty for null or no words.

    A text with fewer words than a shingle has one: all its words.
    """
    w = F.filter(F.split(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+"), lambda x: x != "")
    hashes = F.transform(w, lambda x: F.xxhash64(x))

    def rolled(h: Column) -> Column:
        last = F.greatest(F.size(h) - words + 1, F.lit(1))
        return F.when(F.size(h) > 0, F.transform(F.sequence(F.lit(1), last), lambda i: F.xxhash64(F.slice(h, i, words)))).otherwise(F.array().cast("array<bigint>"))

    return F.slice(F.array_sort(F.array_distinct(_let(hashes, rolled))), 1, k)


def merge(a: Column, b: Column, k: int = K) -> Column:
    """The sketch of two parts taken together."""
    return F.slice(F.array_sort(F.array_union(a, b)), 1, k)


def resemblance(a: Column, b: Column, k: int = K) -> Column:
    """Estimated Jaccard similarity: shared hashes among the k least of both; 1 for two empty sketches."""

    def of(both: Column) -> Column:
        shared = F.size(F.array_intersect(F.array_intersect(a, b), both))
        return F.when(F.size(both) == 0, 1.0).otherwise(shared / F.size(both).cast("double"))

    return _let(merge(a, b, k), of)


def distinct_count(a: Column, k: int = K) -> Column:
    """Estimated number of distinct shingles; exact below k."""
    reach = (F.element_at(a, -1).cast("double") + 2.0**63) / 2.0**64
    return F.when(F.size(a) < k, F.size(a).cast("double")).otherwise((k - 1) / reach)


def containment(a: Column, b: Column, k: int = K) -> Column:
    """Estimated share of a's shingles that b has, from resemblance and the three counts; 0 if a is empty."""
    n = distinct_count(a, k)
    shared = resemblance(a, b, k) * _let(merge(a, b, k), lambda both: distinct_count(both, k))
    return F.when(n > 0, F.least(F.lit(1.0), shared / n)).otherwise(0.0)


def fold(df: DataFrame, by: list[str], column: str = "sketch", k: int = K) -> DataFrame:
    """One sketch for each group: distinct hashes, ranked in the group, the k least.

    Groups are reduced before they are gathered: a hashed part of a group keeps its own k least first.
    """
    rows = df.select(*by, F.explode(column).alias("h")).distinct().withColumn("part", F.pmod(F.xxhash64("h"), F.lit(64)))
    for keys in ([*by, "part"], by):
        order = Window.partitionBy(*keys).orderBy("h")
        rows = rows.withColumn("n", F.row_number().over(order)).where(F.col("n") <= k).drop("n")
    return rows.groupBy(*by).agg(F.array_sort(F.collect_list("h")).alias(column))


def written(a: Column) -> Column:
    """A sketch as text: 16 hex digits a hash."""
    return F.array_join(F.transform(a, lambda x: F.lpad(F.hex(x), 16, "0")), "")


def with_next(docs: DataFrame) -> DataFrame:
    """(k1, k2, h, n) of every distinct document and (n1, n2, nh) of the next one by descending doc_id.

    Nulls come last, texts of one doc_id go by hash, and the first follows the last. Range partitions are ordered
    one by one; between them only their first rows, one for each, are ordered together.
    """
    spark = docs.sparkSession
    rows = docs.groupBy("k1", "k2", "h").agg(F.max(F.char_length("text")).alias("n"), F.count("*").alias("rows"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = stash(rows.repartitionByRange(parts, "k1", "k2", "h").withColumn("part", F.spark_partition_id()), "order")
    key = F.struct("k1", "k2", "h")
    firsts = rows.groupBy("part").agg(F.min(key).alias("first"))
    begin = rows.agg(F.min(key).alias("begin"))
    after = firsts.withColumn("after", F.lead("first").over(Window.orderBy("part"))).crossJoin(F.broadcast(begin)).select("part", F.coalesce("after", "begin").alias("after"))
    inner = F.lead(key).over(Window.partitionBy("part").orderBy("k1", "k2", "h"))
    out = rows.withColumn("next", inner).join(after, "part").withColumn("next", F.coalesce("next", "after"))
    return out.select("k1", "k2", "h", "n", "rows", F.col("next.k1").alias("n1"), F.col("next.k2").alias("n2"), F.col("next.h").alias("nh"))


def edited_pairs(docs: DataFrame, k: int = K) -> DataFrame:
    """Every document's fingerprint beside its edited text's and its likeness to the next document's.

    Edited: the last half of the code points replaced by the first as many of the next document, by descending
    doc_id. Null text is empty (no hash: an empty fingerprint, alike to another empty one). Rows with one doc_id
    and text count as one document in the order and all come back; a null doc_id comes last; a single document
    follows itself; an empty table gives no rows. Other columns are ignored.
    """
    named = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    rows = named.select("doc_id", "text", F.col("doc_id").isNull().alias("k1"), F.bitwise_not(F.coalesce("doc_id", F.lit(0))).alias("k2"), F.xxhash64("text").alias("h"))
    pairs = with_next(rows)
    wanted = pairs.select("k1", "k2", "h", "n", "n1", "n2", "nh")
    once = rows if not pairs.where("rows > 1").limit(1).count() else rows.dropDuplicates(["k1", "k2", "h"])
    # both joins take the same exchange of the texts: the same columns by the same keys
    cur, nxt = wanted.alias("cur"), once.alias("nxt")
    half = F.floor(F.col("n") / 2).cast("int")
    ahead = cur.join(nxt, (F.col("n1") == F.col("nxt.k1")) & (F.col("n2") == F.col("nxt.k2")) & (F.col("nh") == F.col("nxt.h")))
    ahead = ahead.select(F.col("cur.k1").alias("k1"), F.col("cur.k2").alias("k2"), F.col("cur.h").alias("h"), "n", F.col("nxt.doc_id").alias("next_doc_id"), F.substring(F.col("nxt.text"), F.lit(1), half).alias("head"), sketch(F.col("nxt.text"), k).alias("next_sketch"))
    both = rows.join(ahead, ["k1", "k2", "h"])
    edited = F.concat(F.substring("text", F.lit(1), F.col("n").cast("int") - half), F.col("head"))
    both = both.withColumn("edited", edited)
    both = both.select("doc_id", "next_doc_id", F.col("n").cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"), sketch(F.col("text"), k).alias("own"), sketch(F.col("edited"), k).alias("other"), "next_sketch")
    return both.select("doc_id", "n_chars", "edited_sha256", written(F.col("own")).alias("fingerprint"), written(F.col("other")).alias("edited_fingerprint"), resemblance(F.col("own"), F.col("other"), k).alias("near_edited"), resemblance(F.col("own"), F.col("next_sketch"), k).alias("near_next"), distinct_count(F.col("own"), k).alias("n_shingles_estimate"), containment(F.col("other"), F.col("own"), k).alias("edited_contained"), "next_doc_id")
