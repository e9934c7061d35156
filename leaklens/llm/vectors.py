"""Near-duplicate vectors by a subspace pigeonhole join."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leaklens.llm.shared import components, mix64, small_batches, stash

#: Vectors that the rotation and the pivots are made from, at most; any of them give all links.
SAMPLE = 4096
#: Dimensions of a block, about.
BLOCK = 16
MOST_PIVOTS = 64
#: Groups that vectors are dealt into, so that each goes to as many tiles; more only where one would exceed MOST_ROWS.
GROUPS, MOST_ROWS, FEW_ROWS = 6, 100_000, 2048
#: What products of single precision may be off.
SLACK = 1e-5


class _Space:
    """Rotation, block budgets and pivots, from a bounded sample of unit vectors."""

    def __init__(self, sample: np.ndarray, least: float, rows: int) -> None:
        dims = sample.shape[1]
        spread = np.cov(sample.T).reshape(dims, dims) if len(sample) > 1 else np.eye(dims)
        value, vector = np.linalg.eigh(spread)
        self.rotation = vector[:, ::-1].copy()
        value = np.maximum(value[::-1], 1e-9)
        blocks = max(1, round(dims / BLOCK))
        self.cuts = np.linspace(0, dims, blocks + 1).astype(int)
        whole = 2 - 2 * least
        share = np.array([value[a:b].sum() for a, b in zip(self.cuts[:-1], self.cuts[1:], strict=True)])
        self.budget = whole * share / share.sum()
        turned = sample @ self.rotation
        want = int(min(MOST_PIVOTS, max(1, math.ceil(rows / FEW_ROWS)), max(1, len(sample) // 4)))
        rng = np.random.default_rng(3)
        self.pivots, self.apart = [], []
        for a, b in zip(self.cuts[:-1], self.cuts[1:], strict=True):
            x = turned[:, a:b]
            p = np.unique(x[rng.choice(len(x), min(want, len(x)), replace=False)], axis=0)
            for _ in range(4):
                near = _squares(x, p).argmin(1)
                for c in np.unique(near):
                    p[c] = x[near == c].mean(0)
            p = np.unique(p, axis=0)
            self.pivots.append(p)
            self.apart.append(np.sqrt(np.maximum(((p[:, None] - p[None]) ** 2).sum(2), 1e-18)))

    def cells(self, part: np.ndarray, block: int) -> tuple[np.ndarray, np.ndarray]:
        """Each vector's own cell, and the cells that its ball of the block's budget may reach, its own included; part: rotated, the block's dimensions."""
        d = _squares(part, self.pivots[block])
        own = d.argmin(1)
        gap = (d - d[np.arange(len(part)), own][:, None]) / (2 * self.apart[block][own])
        reach = gap <= math.sqrt(self.budget[block] + 1e-9) + 1e-6
        reach[np.arange(len(part)), own] = True
        return own, reach


def _squares(x: np.ndarray, p: np.ndarray) -> np.ndarray:
    return (x**2).sum(1)[:, None] + (p**2).sum(1)[None] - 2 * x @ p.T


def _unit(x: np.ndarray) -> np.ndarray:
    """Rows at length one; divided by their largest component first, whose square could over- or underflow."""
    x = x.astype(np.float64)
    x = x / np.abs(x).max(1)[:, None]
    return x / np.sqrt((x * x).sum(1))[:, None]


class _Side:
    """The vectors of one group: units, their rotated parts in single precision, and cells in every block."""

    def __init__(self, space: _Space, ids: np.ndarray, copies: np.ndarray, x: np.ndarray) -> None:
        self.ids, self.copies, self.unit = ids, copies, np.empty(x.shape)
        blocks = range(len(space.budget))
        self.part = [np.empty((len(ids), space.cuts[k + 1] - space.cuts[k]), np.float32) for k in blocks]
        self.half = [np.empty(len(ids), np.float32) for _ in blocks]
        self.own = [np.empty(len(ids), np.int16) for _ in blocks]
        self.reach = [np.empty((len(ids), len(space.pivots[k])), bool) for k in blocks]
        for a in range(0, len(ids), 8192):
            rows = slice(a, a + 8192)
            self.unit[rows] = _unit(x[rows])
            turned = self.unit[rows] @ space.rotation
            for k in blocks:
                part = turned[:, space.cuts[k] : space.cuts[k + 1]]
                self.part[k][rows], self.half[k][rows] = part, (part**2).sum(1) / 2
                self.own[k][rows], self.reach[k][rows] = space.cells(part, k)


class _Tile:
    """All links between two groups, or within one: counts of every vector, and edges that span what is linked."""

    def __init__(self, space: _Space, least: float, a: _Side, b: _Side) -> None:
        self.space, self.least, self.a, self.b = space, least, a, b
        self.shift = 0 if a is b else len(a.ids)
        self.ids, self.copies = (a.ids, a.copies) if a is b else (np.concatenate([a.ids, b.ids]), np.concatenate([a.copies, b.copies]))
        self.parent = np.arange(len(self.ids))
        self.n = np.zeros(len(self.ids), np.int64)
        self.edges: list[tuple[int, int]] = []

    def _candidates(self, k: int):
        """Pairs (i, j) that may keep the budget of block k: the vectors of each cell of b, and those of a that reach it."""
        a, b = self.a, self.b
        order = np.argsort(b.own[k], kind="stable")
        ends = np.searchsorted(b.own[k][order], np.arange(len(self.space.pivots[k]) + 1))
        left = np.column_stack([a.part[k], np.ones(len(a.ids), np.float32), -a.half[k]])
        right = np.column_stack([b.part[k], -b.half[k], np.ones(len(b.ids), np.float32)])
        least = np.float32(-self.space.budget[k] / 2 - SLACK)  # half the squared distance, negated, is one product
        for c in range(len(self.space.pivots[k])):
            members, visitors = order[ends[c] : ends[c + 1]], np.flatnonzero(a.reach[k][:, c])
            for m in range(0, len(members), 2048):
                own = members[m : m + 2048]
                table = right[own].T
                for v in range(0, len(visitors), 512):
                    rows = visitors[v : v + 512]
                    i, j = np.divmod(np.flatnonzero(left[rows] @ table >= least), len(own))
                    i, j = rows[i], own[j]
                    if a is b:
                        later = i < j
                        i, j = i[later], j[later]
                    if len(i):
                        yield i, j

    def _links(self, k: int, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Those of the pairs that are linked, and keep block k's budget but no earlier block's."""
        x, y = self.a.unit[i], self.b.unit[j]
        ok = (x * y).sum(1) >= self.least
        if ok.any():
            gap = (x[ok] - y[ok]) @ self.space.rotation[:, : self.space.cuts[k + 1]]
            gap *= gap
            keeps = np.stack([gap[:, self.space.cuts[e] : self.space.cuts[e + 1]].sum(1) <= self.space.budget[e] + 1e-9 for e in range(k + 1)])
            ok[np.flatnonzero(ok)[~keeps[k] | keeps[:k].any(0)]] = False
        return i[ok], j[ok]

    def _roots(self, x: np.ndarray) -> np.ndarray:
        r = self.parent[x]
        while not np.array_equal(up := self.parent[r], r):
            r = up
        self.parent[x] = r
        return r

    def _join(self, i: np.ndarray, j: np.ndarray) -> None:
        j = j + self.shift
        np.add.at(self.n, i, self.copies[j])
        np.add.at(self.n, j, self.copies[i])
        r, s = self._roots(i), self._roots(j)
        apart = r != s
        for u, v in np.unique(np.stack([r[apart], s[apart]], 1), axis=0).tolist() if apart.any() else ():
            while self.parent[u] != u:
                u = int(self.parent[u])
            while self.parent[v] != v:
                v = int(self.parent[v])
            if u != v:
                self.parent[max(u, v)] = min(u, v)
                self.edges.append((u, v))

    def found(self):
        """(0, id, its number of links here) and (1, id, id)."""
        for k in range(len(self.space.budget)):
            for i, j in self._candidates(k):
                for s in range(0, len(i), 20_000):
                    x, y = self._links(k, i[s : s + 20_000], j[s : s + 20_000])
                    if len(x):
                        self._join(x, y)
        at = np.flatnonzero(self.n)
        yield 0, self.ids[at], self.n[at]
        e = np.array(self.edges, np.int64).reshape(-1, 2)
        yield 1, self.ids[e[:, 0]], self.ids[e[:, 1]]


def near_vectors(vectors: DataFrame, least: float = 0.95, key: str = "vec_id", column: str = "embedding") -> DataFrame:
    """vec_id, n_links, component_id, kept: links of cosine `least` or more, in double precision.

    Equal vectors are one class with a count. Unit vectors are rotated to the axes of a bounded sample and split
    into blocks; each block has a share of the squared distance that the cosine allows, in proportion to its
    spread, so a linked pair keeps the budget of one block at least. Vectors are dealt into groups by a hash, and
    two groups, or one with itself, meet in a tile: a vector goes to as many tiles as there are groups, six up to
    600 000 vectors. In a tile and block, the vectors of a pivot's cell meet those whose ball of the budget's radius
    reaches it. Pairs that keep the budget are verified on whole vectors, and count in the first such block. Tiles
    send sums and spanning edges, not pairs. Pairs of vectors without structure are all looked at, so the time
    grows with their number's square; what is sent does not.

    Null, empty or zero vectors and those with null or non-finite components link with nothing and are their own
    component; so do vectors of different lengths with each other. Rows with one vec_id are one vector in components,
    but n_links counts rows: of another id each row that is linked, of its own id each other row with an equal or near
    vector. Null ids have a null component. An empty table gives no rows. Other columns are ignored.
    """
    spark = vectors.sparkSession
    small_batches(spark)
    wide = dict(vectors.dtypes)[column] != "array<float>"
    kind, real = ("v", np.float64) if wide else ("own", np.float32)  # components are kept and sent as they came, and compared in double precision
    rows = vectors.select(F.col(key).cast("long").alias("vec_id"), F.col(column).cast("array<double>").alias("v"), *([] if wide else [F.col(column).alias("own")]))
    fine = F.coalesce(F.forall("v", lambda x: x.isNotNull() & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0), F.lit(False)) & F.col("vec_id").isNotNull()
    rows = rows.withColumn("fine", fine).withColumn("digest", F.when(F.col("fine"), F.md5(F.to_json(F.struct("v")).cast("binary"))))
    classes = stash(rows.where("fine").groupBy("digest").agg(F.min("vec_id").alias("id"), F.count("*").alias("copies"), F.first(kind).alias("v")).withColumn("dims", F.size("v")), "vectors")
    sizes = {r["dims"]: r["count"] for r in classes.groupBy("dims").count().collect()}
    links, edges = [], []
    for dims, n in sizes.items():
        part = classes.where(F.col("dims") == dims)
        sample = part.select("v", F.xxhash64("id").alias("o")).orderBy("o").limit(SAMPLE).collect()
        space = _Space(_unit(np.array([r["v"] for r in sample])), least, n)
        sent = spark.sparkContext.broadcast(space)

        def matrix(b: pa.RecordBatch, i: int, dims: int = dims) -> np.ndarray:
            c = b.column(i)
            return c.flatten().to_numpy(zero_copy_only=False).reshape(len(b), dims)

        groups = max(min(GROUPS, -(-n // FEW_ROWS)), -(-n // MOST_ROWS))

        def send(batches, groups=groups, matrix=matrix):
            for b in batches:
                ids, copies, x = b.column(0).to_numpy(), b.column(1).to_numpy(), matrix(b, 2)
                group = (mix64(ids) % np.uint64(groups)).astype(np.int64)
                for g in np.unique(group).tolist():
                    at = group == g
                    m, packed = groups, [ids[at].tobytes(), copies[at].tobytes(), np.ascontiguousarray(x[at], real).tobytes()]
                    pairs = [(min(g, o), max(g, o), int(o < g)) for o in range(groups)]
                    yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int32()) for c in zip(*pairs, strict=True)), *(pa.array([v] * m, pa.binary()) for v in packed)], names=["first", "second", "side", "ids", "copies", "v"])

        def meet(batches, sent=sent, dims=dims):
            at, held = None, ([], [])

            def side(packs):
                ids, copies, x = (np.frombuffer(b"".join(p[i] for p in packs), t) for i, t in enumerate((np.int64, np.int64, real)))
                packs.clear()
                return _Side(sent.value, ids, copies, x.reshape(-1, dims))

            def tile():
                if at and held[0] and (held[1] or at[0] == at[1]):
                    a = side(held[0])
                    for kind, x, y in _Tile(sent.value, least, a, side(held[1]) if at[0] != at[1] else a).found():
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(x), kind, np.int32)), pa.array(x), pa.array(y)], names=["kind", "a", "b"])
                held[0].clear()
                held[1].clear()

            for b in batches:
                for first, second, which, *packed in zip(*(c.to_pylist() for c in b.columns), strict=True):
                    if (first, second) != at:
                        yield from tile()
                        at = first, second
                    held[which].append(packed)
            yield from tile()

        sent_rows = part.select("id", "copies", "v").mapInArrow(send, "first int, second int, side int, ids binary, copies binary, v binary")
        parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * groups * (groups + 1))
        found = stash(sent_rows.repartition(parts, "first", "second").sortWithinPartitions("first", "second").mapInArrow(meet, "kind int, a long, b long"), "near")
        links.append(found.where("kind = 0").select(F.col("a").alias("id"), F.col("b").alias("n")))
        edges.append(found.where("kind = 1").select("a", "b"))
    if not links:
        return rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.col("vec_id").isNotNull().alias("kept"))
    every, pairs = links[0], edges[0]
    for a, b in zip(links[1:], edges[1:], strict=True):
        every, pairs = every.union(a), pairs.union(b)
    facts = classes.select("digest", "id", "copies").join(every.groupBy("id").agg(F.sum("n").alias("n")), "id", "left").join(components(pairs), "id", "left")
    facts = facts.select("digest", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "id").alias("component_id"))
    out = rows.select("vec_id", "digest").join(facts, "digest", "left")
    component = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), component.alias("component_id"), F.coalesce(component == F.col("vec_id"), F.lit(False)).alias("kept"))
