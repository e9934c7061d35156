"""Sharding by a hierarchical weighted hash tree, with DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leaklens.llm.shared import stash, unstash

#: A leaf: its shard, the path of nodes from the root (a region, a rack, a place in it), and its weight.
Leaf = tuple[int, tuple[int, ...], float]
#: Rows of a shard that one task orders, about; and copies of one row that one task writes.
ORDERED, COPIES = 50_000, 1 << 16


def tree(regions: int = 2, racks: int = 2, places: int = 2, weight: float = 1.0) -> list[Leaf]:
    """Equal shards, numbered from 0, as places of racks of regions."""
    return [((r * racks + k) * places + p, (r, k, p), weight) for r in range(regions) for k in range(racks) for p in range(places)]


def grown(leaves: list[Leaf], weight: float = 1.0) -> list[Leaf]:
    """One more shard, the next number, in a region of its own.

    Regions draw independently, so rows leave any region only for the new one, which has nothing but the new shard.
    """
    depth = len(leaves[0][1])
    region = max(path[0] for _, path, _ in leaves) + 1
    return [*leaves, (max(s for s, _, _ in leaves) + 1, (region, *[0] * (depth - 1)), weight)]


def reweighted(leaves: list[Leaf], weights: dict[int, float]) -> list[Leaf]:
    """The tree with other weights for some shards; 0 takes a shard out of use."""
    return [(s, path, weights.get(s, w)) for s, path, w in leaves]


def _named(path: tuple[int, ...]) -> str:
    return "/".join(map(str, path))


def unit_draw(*parts: Column) -> Column:
    """A number between 0 and 1, neither included, from the first 52 bits of the MD5 digest of the parts joined by colons."""
    digits = F.substring(F.md5(F.concat_ws(":", *parts)), 1, 13)
    return (F.conv(digits, 16, 10).cast("double") + 0.5) / float(1 << 52)


def shard_of(key: Column, leaves: list[Leaf], seed: int = 13) -> Column:
    """The shard of a key: from the root, each level's node is the one with the least -ln(draw) / weight.

    A node's draw depends on the seed, its path and the key alone, so a change of weights moves rows only between
    the children of nodes that have a child whose weight changed. Null keys have a draw like any other value.
    """
    used = [(s, path, float(w)) for s, path, w in leaves if w > 0]
    if not used or len({len(p) for _, p, _ in used}) != 1 or len({p for _, p, _ in used}) != len(used):
        raise ValueError("a tree needs shards of positive weight on paths of one length that differ")
    text, at = F.coalesce(key.cast("string"), F.lit("null")), F.lit("")
    for depth in range(1, len(used[0][1]) + 1):
        below: dict[str, dict[str, float]] = {}
        for _, path, w in used:
            kids = below.setdefault(_named(path[: depth - 1]), {})
            kids[_named(path[:depth])] = kids.get(_named(path[:depth]), 0.0) + w
        nodes = F.create_map(*[x for parent, kids in sorted(below.items()) for x in (F.lit(parent), F.array(*[F.struct(F.lit(k).alias("node"), F.lit(w).alias("weight")) for k, w in sorted(kids.items())]))])
        scored = F.transform(F.element_at(nodes, at), lambda c: F.struct((-F.ln(unit_draw(F.lit(str(seed)), c["node"], text)) / c["weight"]).alias("score"), c["node"].alias("node")))
        at = F.array_min(scored)["node"]
    return F.element_at(F.create_map(*[x for s, path, _ in used for x in (F.lit(_named(path)), F.lit(s))]), at)


def with_slots(rows: DataFrame, shard: str = "shard", slot: str = "slot") -> DataFrame:
    """Adds each row's place in its shard: gapless from 0, by a digest of the row, whatever the partitions.

    Equal rows are counted before they are shuffled and take neighbouring places. A shard is ordered in ranges of the
    digest, so neither a large shard nor a row with many copies is one task's work.
    """
    spark, cols = rows.sparkSession, rows.columns
    digest = F.conv(F.substring(F.md5(F.concat_ws(":", *[F.coalesce(F.col(c).cast("string"), F.lit("null")) for c in cols])), 1, 15), 16, 10).cast("long")
    kinds = stash(rows.groupBy(*cols).agg(F.count("*").alias("_n")).withColumn("_h", digest), "shards")
    distinct, most = kinds.agg(F.count("*"), F.max("_n")).first()
    ranges = max(int(spark.conf.get("spark.sql.shuffle.partitions")), distinct // ORDERED + 1)
    kinds = kinds.withColumn("_range", F.floor(F.col("_h") / F.lit((1 << 60) // ranges + 1)).cast("long"))
    before = Window.partitionBy(shard).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    first = kinds.groupBy(shard, "_range").agg(F.sum("_n").alias("_sum")).select(shard, "_range", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_first"))
    inside = Window.partitionBy(shard, "_range").orderBy("_h", *cols).rowsBetween(Window.unboundedPreceding, -1)
    placed = kinds.withColumn("_before", F.coalesce(F.sum("_n").over(inside), F.lit(0))).join(first, [shard, "_range"])
    placed = placed.select(*cols, (F.col("_first") + F.col("_before")).alias("_at"), "_n")
    if (most or 0) > COPIES:
        some = F.sequence(F.lit(0).cast("long"), F.floor((F.col("_n") - 1) / COPIES).cast("long"))
        placed = placed.select(*cols, "_at", "_n", F.explode(some).alias("_some")).repartition(shard, "_at", "_some")
        placed = placed.select(*cols, (F.col("_at") + F.col("_some") * COPIES).alias("_at"), F.least(F.lit(COPIES), F.col("_n") - F.col("_some") * COPIES).alias("_n"))
    copies = F.sequence(F.lit(0).cast("long"), F.col("_n") - 1)
    return placed.select(*cols, "_at", F.explode(copies).alias("_copy")).select(*cols, (F.col("_at") + F.col("_copy")).alias(slot))


def assign(docs: DataFrame, leaves: list[Leaf], more: list[Leaf] | None = None, key: str = "doc_id", text: str = "text", seed: int = 13) -> DataFrame:
    """(key, size, text_crc32, law, shard, slot, grown_shard) of every row; texts are read once and not shuffled.

    The law is `key`: the key and the tree decide. size: UTF-8 bytes plus 1; grown_shard: the shard in the tree
    `more`, by default one with a further shard, which takes rows only into itself. Null text is empty (size 1); rows
    with a null key have one shard; repeated rows are placed as often as they come, one slot each; long texts are
    only measured and summed; an empty table gives no rows. Other columns are ignored, whatever their names.
    """
    whole = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(
        F.col(key).alias(key), (F.octet_length(whole) + 1).cast("long").alias("size"), F.crc32(whole.cast("binary")).alias("text_crc32"), F.lit("key").alias("law"),
        shard_of(F.col(key), leaves, seed).alias("shard"), shard_of(F.col(key), more or grown(leaves), seed).alias("grown_shard"),
    )
    return with_slots(rows).select(key, "size", "text_crc32", "law", "shard", "slot", "grown_shard")


def write_shards(docs: DataFrame, leaves: list[Leaf], path: str, key: str = "doc_id", files: int = 8, seed: int = 13) -> DataFrame:
    """Write whole rows under path/shard=N, `files` files a shard, and return what was written.

    Rows of a shard are dealt over its files by their place in the input, so a key with many rows is not one task's.
    """
    if "shard" in docs.columns:
        raise ValueError("the rows already have a column named shard")
    rows = stash(docs.withColumn("shard", shard_of(F.col(key), leaves, seed)), "to-shard")
    dealt = rows.withColumn("_file", F.pmod(F.xxhash64(F.col("_metadata.file_name"), F.col("_metadata.row_index")), F.lit(files)))
    dealt.repartition(len(leaves) * files, "shard", "_file").drop("_file").write.partitionBy("shard").parquet(path)
    unstash(rows)
    return docs.sparkSession.read.parquet(path)
