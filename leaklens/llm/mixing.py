"""Mixing sources to target weights: Sainte-Lague apportionment of equal-token blocks, seeded block selection."""

from __future__ import annotations

import heapq
import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from leaklens.llm.shared import WORD, local_rows, stash

#: Sources above this number would make the driver's table of sources too large.
MOST_SOURCES = 1_000_000


def targets(sizes: list[int], weights: tuple[float, ...], share: float, most: float) -> list[float]:
    """Targets by weight (repeating) that sum to share x all sizes, none above most x its own size.

    What a source can't take is shared again by weight among the others until none is above.
    """
    left, open_, out = share * sum(sizes), list(range(len(sizes))), [0.0] * len(sizes)
    while open_:
        whole = sum(weights[i % len(weights)] for i in open_)
        full = [i for i in open_ if left * weights[i % len(weights)] / whole > most * sizes[i]]
        if not full:
            for i in open_:
                out[i] = left * weights[i % len(weights)] / whole
            break
        for i in full:
            out[i] = most * sizes[i]
        left -= sum(out[i] for i in full)
        gone = set(full)
        open_ = [i for i in open_ if i not in gone]
    return out


def apportion(votes: list[float], seats: int) -> list[int]:
    """Sainte-Lague: each seat to the highest of votes/1, votes/3, votes/5 ...; ties to the first.

    Begins from the divisor that gives about all seats, then gives or takes back single seats in order of
    their quotients, so that the work depends on the voters and not on the seats.
    """
    total = sum(votes)
    if not total or seats <= 0:
        return [0] * len(votes)
    got = [math.floor(v * seats / total + 0.5) for v in votes]
    lack = seats - sum(got)
    if lack > 0:
        heap = [(-v / (2 * g + 1), i) for i, (v, g) in enumerate(zip(votes, got, strict=True)) if v]
        heapq.heapify(heap)
        for _ in range(lack):
            _, i = heap[0]
            got[i] += 1
            heapq.heapreplace(heap, (-votes[i] / (2 * got[i] + 1), i))
    elif lack < 0:
        heap = [(v / (2 * g - 1), -i) for i, (v, g) in enumerate(zip(votes, got, strict=True)) if g]
        heapq.heapify(heap)
        for _ in range(-lack):
            _, i = heapq.heappop(heap)
            got[-i] -= 1
            if got[-i]:
                heapq.heappush(heap, (votes[-i] / (2 * got[-i] - 1), i))
    return got


def block_of(target: float, block: int) -> int:
    """Words of a source's block: a power of two, `block` at most, of which its target has 32 or more if it can."""
    return max(1, min(block, 1 << max(0, int(target / 32).bit_length() - 1)))


def primes(seed: int, many: int = 16) -> list[int]:
    """Primes from 2^30 on, begun at a place that the seed chooses: strides of the block permutation."""
    out, n = [], (1 << 30) + seed * 2654435761 % (1 << 29) | 1
    while len(out) < many:
        if all(n % d for d in range(3, math.isqrt(n) + 1, 2)):
            out.append(n)
        n += 2
    return out


def row_hash(seed: int = 17):
    """What rows are ordered and dealt by: equal for rows of equal id, text and source."""
    return F.xxhash64("doc_id", "text", "source", F.lit(seed))


def mix(docs: DataFrame, weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, most: float = 2.0, block: int = 64, shards: int = 4096, seed: int = 17) -> DataFrame:
    """doc_id, source, size, source_size, target, taken, passes, spans, h: what the mix takes of each document.

    Sources get targets by weight; blocks of `block` words, or of fewer for sources whose target has few such, are
    apportioned to the sources with blocks of one size, then to each source's shards, by Sainte-Lague; a shard takes all its blocks `passes` times and, beyond that, blocks picked by a
    seeded permutation. spans are the word ranges [lo, hi) of a document in picked blocks; taken counts every
    word as often as it is taken, at most `most` times its size. A large source has many shards, at least 64
    blocks each, about `shards` in all: the driver holds a row per source and per shard, and sorts are by shard.

    Null text has size 0 and is never taken; a null source is a source, the last; repeated rows and null ids
    count as often as they come; reruns agree; an empty table gives no rows. Other columns are ignored.
    """
    spark = docs.sparkSession
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    base = stash(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), size.alias("size"), row_hash(seed).alias("h")), "mix")
    found = base.groupBy("source").agg(F.sum("size").alias("n")).limit(MOST_SOURCES + 1).collect()
    if len(found) > MOST_SOURCES:
        raise ValueError(f"more than {MOST_SOURCES} sources")
    found.sort(key=lambda r: (r["source"] is None, r["source"] or ""))
    sizes = [r["n"] for r in found]
    total = sum(sizes)
    aims = targets(sizes, weights, share, most)
    blocks = [block_of(t, block) for t in aims]
    quotas = [0] * len(aims)
    for words in set(blocks):
        alike = [i for i, w in enumerate(blocks) if w == words]
        for i, q in zip(alike, apportion([aims[i] for i in alike], round(sum(aims[i] for i in alike) / words)), strict=True):
            quotas[i] = q
    parts = [max(1, min(math.ceil(shards * n / max(total, 1)), n // (64 * w))) for n, w in zip(sizes, blocks, strict=True)]
    table = local_rows(spark, [(r["source"], i, sizes[i], float(aims[i]), parts[i], blocks[i]) for i, r in enumerate(found)], "source string, s int, source_size long, target double, parts int, words long")
    dealt = base.join(table, base["source"].eqNullSafe(table["source"])).select("doc_id", base["source"], "size", "h", "s", "source_size", "target", "words", F.pmod(F.xxhash64("h"), "parts").cast("int").alias("shard"))
    by_shard: dict[int, list[tuple[int, int]]] = {}
    for r in dealt.groupBy("s", "shard").agg(F.sum("size").alias("n")).collect():
        by_shard.setdefault(r["s"], []).append((r["shard"], r["n"]))
    rows = []
    for s, own in by_shard.items():
        own.sort()
        rows += [(s, shard, n, q) for (shard, n), q in zip(own, apportion([n for _, n in own], quotas[s]), strict=True)]
    quota = local_rows(spark, rows, "s int, shard int, n long, quota long")
    order = Window.partitionBy("s", "shard").orderBy("h", "doc_id", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = dealt.join(quota, ["s", "shard"]).withColumn("at", F.sum("size").over(order) - F.col("size"))
    b, top = F.col("words"), int(most)
    placed = placed.withColumn("blocks", F.ceil(F.col("n") / b)).withColumn("passes", F.when(F.col("n") > 0, F.least(F.lit(top), F.floor(F.col("quota") * b / F.col("n")))).otherwise(0).cast("int"))
    placed = placed.withColumn("picked", F.when(F.col("passes") >= top, 0).otherwise(F.least("blocks", F.round((F.col("quota") * b - F.col("passes") * F.col("n")) / b).cast("long"))))
    turn = F.xxhash64("s", "shard", F.lit(seed))
    placed = placed.withColumn("turn", turn.bitwiseAND(F.lit((1 << 30) - 1)))
    placed = placed.withColumn("stride", F.element_at(F.array(*[F.lit(p).cast("long") for p in primes(seed)]), (F.pmod(F.shiftright(turn, 32), F.lit(16)) + 1).cast("int")))
    spans = F.expr(
        "transform(filter(if(size > 0, sequence(at div words, (at + size - 1) div words), array()),"
        " k -> (k * stride + turn) % blocks < picked),"
        " k -> struct(greatest(k * words, at) - at as lo, least((k + 1) * words, at + size) - at as hi))"
    )
    placed = placed.withColumn("spans", F.when(F.col("picked") > 0, spans).otherwise(F.expr("cast(array() as array<struct<lo: bigint, hi: bigint>>)")))
    taken = F.col("passes") * F.col("size") + F.aggregate("spans", F.lit(0).cast("long"), lambda n, x: n + x["hi"] - x["lo"])
    return placed.select("doc_id", "source", "size", "source_size", "target", taken.alias("taken"), F.when(F.col("size") > 0, F.col("passes")).otherwise(0).alias("passes"), "spans", "h")
