"""Finding secrets in texts and neighbours among vectors."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from leaklens.functions.text import canon


#: Bytes of secrets that one automaton holds; it goes to every worker. More are joined by an inner word.
AUTOMATON = 32 << 20
#: Characters of the run by which a secret of one or two words meets texts.
GRAM = 4


def secrets_in_documents(secrets: DataFrame, docs: DataFrame) -> DataFrame:
    """(item_id, doc_id) where the canonical secret is in the canonical text.

    If the secrets are few enough, their bytes being counted first, every text is scanned once where it lies by an
    automaton of them all. Otherwise see secrets_by_inner_word.
    """
    s = secrets.select("item_id", canon(F.col("text")).alias("secret")).where("secret <> ''")
    size = s.agg(F.sum(F.octet_length("secret"))).first()[0] or 0
    try:
        import ahocorasick  # noqa: F401
    except ImportError:
        size = AUTOMATON + 1
    if size > AUTOMATON:
        return secrets_by_inner_word(secrets, docs)
    found: dict[str, list] = {}
    for x in s.collect():
        found.setdefault(x["secret"], []).append(x["item_id"])
    sent = s.sparkSession.sparkContext.broadcast(found)
    kinds = [to_arrow_type(t.schema[c].dataType) for t, c in ((secrets, "item_id"), (docs, "doc_id"))]

    def scan(batches):
        import ahocorasick

        automaton = ahocorasick.Automaton()
        for secret, ids in sent.value.items():
            automaton.add_word(secret, ids)
        automaton.make_automaton()
        for b in batches:
            doc, out = [], []
            for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                hits = {x for _, ids in automaton.iter(t) for x in ids} if sent.value else ()
                out += hits
                doc += [i] * len(hits)
            yield pa.RecordBatch.from_arrays([pa.array(out, kinds[0]), pa.array(doc, kinds[1])], names=["item_id", "doc_id"])

    return docs.select("doc_id", canon(F.col("text")).alias("t")).mapInArrow(scan, f"item_id {dict(secrets.dtypes)['item_id']}, doc_id {dict(docs.dtypes)['doc_id']}")


def secrets_by_inner_word(secrets: DataFrame, docs: DataFrame) -> DataFrame:
    """The same pairs for any number of secrets.

    A secret of three words or more has an inner word, whole in any match: the longest is the equi-join's key,
    and containment is verified. A shorter one may begin and end within words: its key is a run of GRAM characters
    from its middle (of all its characters, if it has fewer), met with the texts' runs of that length.
    """
    s = secrets.select("item_id", canon(F.col("text")).alias("secret")).where("secret <> ''").withColumn("w", F.split("secret", " "))
    inner = F.slice("w", 2, F.size("w") - 2)
    keyed = s.where(F.size("w") >= 3).select("item_id", "secret", F.array_sort(F.transform(inner, lambda x: F.struct((-F.length(x)).alias("n"), x.alias("x"))))[0]["x"].alias("key"))
    d = docs.select("doc_id", canon(F.col("text")).alias("t"))
    keys = keyed.select("key").distinct()
    words = d.select("doc_id", F.explode(F.array_distinct(F.split("t", " "))).alias("key")).join(keys, "key", "left_semi")
    pairs = words.join(keyed, "key").select("doc_id", "item_id", "secret")
    long = pairs.join(d, "doc_id").where(F.contains("t", "secret")).select("item_id", "doc_id")
    few = s.where(F.size("w") < 3).withColumn("n", F.least(F.char_length("secret"), F.lit(GRAM)))
    grams = few.select("item_id", "secret", "n", F.expr("substring(secret, 1 + (char_length(secret) - n) div 2, n)").alias("gram"))
    for n in sorted(r["n"] for r in grams.select("n").distinct().collect()):  # GRAM lengths at most
        own = grams.where(F.col("n") == n).select("item_id", "secret", "gram")
        seen = d.where(F.char_length("t") >= n).select("doc_id", F.explode(_runs("t", n)).alias("gram")).join(own.select("gram").distinct(), "gram", "left_semi")
        met = seen.join(own, "gram").select("doc_id", "item_id", "secret").join(d, "doc_id").where(F.contains("t", "secret"))
        long = long.unionByName(met.select("item_id", "doc_id"))
    return long


def _runs(text: str, n: int) -> Column:
    """Distinct runs of n characters."""

    def of(chars: Column) -> Column:
        return F.array_distinct(F.transform(F.sequence(F.lit(1), F.size(chars) - n + 1), lambda i: F.array_join(F.slice(chars, i, n), "")))

    return once(F.split(text, ""), of)


def dot(a: str, b: str) -> F.Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


#: Queries that are compared with all vectors in one pass; more take several passes.
QUERY_BLOCK = 4096
#: Scores that a task has in memory at once.
SCORES = 1 << 21


class _Best:
    """The k best of every query so far: largest score to 9 places, then smallest id."""

    def __init__(self, queries: int, k: int) -> None:
        self.k, self.least = k, np.full(queries, -np.inf)
        self.held: list[tuple | None] = [None] * queries

    def add(self, score: np.ndarray, ids: np.ndarray) -> None:
        """score: a row a query, a column an id."""
        short = np.round(score, 9)
        short[np.isnan(short)] = np.inf  # not a number is largest, as in Spark's order
        order, place = np.argsort(ids, kind="stable"), None
        for q in np.flatnonzero((short >= self.least[:, None]).any(1)).tolist():
            row = short[q]
            at = np.flatnonzero(row >= self.least[q])
            if len(at) > self.k:  # of what equals the k-th score, the smallest ids
                bound = np.partition(row[at], len(at) - self.k)[len(at) - self.k]
                at = at[row[at] >= bound]
                if len(at) > 4 * self.k:
                    if place is None:
                        place = np.empty(len(ids), np.int64)
                        place[order] = np.arange(len(ids))
                    more, same = at[row[at] > bound], at[row[at] == bound]
                    at = np.concatenate([more, same[np.argpartition(place[same], self.k - 1)[: self.k]]])
            s, i, exact = row[at], ids[at], score[q, at]
            if self.held[q]:
                s, i, exact = (np.concatenate(x) for x in zip(self.held[q], (s, i, exact), strict=True))
            keep = np.lexsort((i, -s))[: self.k]
            self.held[q] = s[keep], i[keep], exact[keep]
            if len(keep) == self.k:
                self.least[q] = s[keep[-1]]

    def rows(self, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
        full = [(q, h) for q, h in zip(queries, self.held, strict=True) if h]
        if full:
            return np.array([q for q, h in full for _ in h[1]]), np.concatenate([h[1] for _, h in full]), np.concatenate([h[2] for _, h in full])
        return None


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    """query, vec_id, score, rank: the k rows of largest inner product with each stated query, by blocked products.

    Queries go out in blocks of about QUERY_BLOCK, each against all rows; a task keeps its own k best of every query
    and sends nothing else. Ties to 9 places go to the smaller id. Without queries or rows there are no rows.
    """
    asked = queries.select("vec_id", "embedding").where("vec_id is not null and embedding is not null")
    blocks = max(1, -(-asked.count() // QUERY_BLOCK))
    schema, every = f"query {dict(queries.dtypes)['vec_id']}, vec_id {dict(vectors.dtypes)['vec_id']}, score double", None
    for i in range(blocks):
        part = asked.where(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)) == i).toPandas()
        q = vectors.sparkSession.sparkContext.broadcast((part["vec_id"].to_numpy(), np.stack(part["embedding"]).astype(np.float64) if len(part) else None))

        def score(batches: Iterator[pa.RecordBatch], q=q) -> Iterator[pa.RecordBatch]:
            qi, qv = q.value
            best, unnamed, kind = _Best(len(qi), k), _Best(len(qi), k), pa.null()
            for b in batches:
                kind = b.schema.field(0).type
                for begin in range(0, len(b) if len(qi) else 0, step := max(1, SCORES // max(1, len(qi)))):
                    rows = b.slice(begin, step)
                    x = rows.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(rows), -1)
                    s, null = qv @ x.T, rows.column(0).is_null().to_numpy(zero_copy_only=False)
                    best.add(s[:, ~null], rows.column(0).drop_null().to_pandas().to_numpy())
                    if null.any():  # null ids come before all others
                        unnamed.add(s[:, null], np.zeros(null.sum(), np.int64))
            for out, named in ((best.rows(qi), True), (unnamed.rows(qi), False)):
                if out is not None:
                    yield pa.RecordBatch.from_arrays([pa.array(out[0]), pa.array(out[1], kind) if named else pa.nulls(len(out[1]), kind), pa.array(out[2])], names=["query", "vec_id", "score"])

        found = vectors.where("embedding is not null").select("vec_id", "embedding").mapInArrow(score, schema)
        every = found if every is None else every.union(found)
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc(F.round("score", 9)), "vec_id"))
    return every.withColumn("rank", rank).where(F.col("rank") <= k)


def once(value: Column, use) -> Column:
    """use(value), with value computed once a row however often it is used."""
    return F.transform(F.array(value), use)[0]


def unit(v: Column) -> Column:
    """A vector at length one; zero stays zero."""
    wide = F.transform(v, lambda x: x.cast("double"))
    length = lambda w: F.sqrt(F.aggregate(w, F.lit(0.0), lambda a, x: a + x * x))
    return once(wide, lambda w: once(length(w), lambda n: F.when(n > 0, F.transform(w, lambda x: x / n)).otherwise(w)))


#: Different words whose places a task remembers; those it meets first, as frequent ones are.
WORDS = 400_000
#: All bytes but a-z and 0-9 as spaces.
APART = bytes(c if chr(c) in "abcdefghijklmnopqrstuvwxyz0123456789" else 32 for c in range(256))


class _Places(dict):
    """A word's place among `dims`, by its digest."""

    def __init__(self, dims: int) -> None:
        super().__init__()
        self.dims = dims

    def __missing__(self, word: bytes) -> int:
        at = int.from_bytes(hashlib.md5(word).digest()[:2], "big") % self.dims
        if len(self) < WORDS:
            self[word] = at
        return at


def encode(texts: DataFrame, key: str, dims: int = 64) -> DataFrame:
    """key, embedding: hashed counts of a text's runs of letters and digits, at length one; zeros for a text without any.

    Stands where an encoder would: any function from texts to vectors can take its place. Words are counted where their
    text lies; what is shuffled is a row of counts for each text, so that texts of one key are one text.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = _Places(dims)
        for b in batches:
            packed = []
            for t in b.column(1).cast(pa.binary()).to_pylist():
                n = np.bincount(np.fromiter(map(place.__getitem__, t.translate(APART).split()), np.int64), minlength=dims)
                at = np.flatnonzero(n)
                packed.append(np.stack([at, n[at]], 1).astype(np.int32).tobytes())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(packed, pa.binary())], schema=pa.schema([b.schema.field(0), pa.field("counts", pa.binary())]))

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for begin in range(0, len(b), 1000):
                rows = b.slice(begin, 1000)
                x = np.zeros((len(rows), dims))
                for i, many in enumerate(rows.column(1).to_pylist()):
                    for one in many:
                        at, n = np.frombuffer(one, np.int32).reshape(-1, 2).T
                        x[i, at] += n
                length = np.sqrt((x * x).sum(1))
                x /= np.where(length > 0, length, 1.0)[:, None]
                yield pa.RecordBatch.from_arrays([rows.column(0), pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, dims), pa.int32()), pa.array(x.ravel()))], schema=pa.schema([rows.schema.field(0), pa.field("embedding", pa.list_(pa.float64()))]))

    rows = texts.select(F.col(key).alias("key"), F.lower(F.coalesce("text", F.lit(""))).alias("text"))
    kind = rows.schema["key"].dataType.simpleString()
    each = rows.mapInArrow(count, f"key {kind}, counts binary").groupBy("key").agg(F.collect_list("counts").alias("counts"))
    return each.mapInArrow(spread, f"key {kind}, embedding array<double>").withColumnRenamed("key", key)


def encoded(text: Column, dims: int = 64) -> Column:
    """The same vector of one text, in its row: for short texts, and where nothing may be shuffled."""
    words = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("([a-z0-9]+)"), 1)
    slots = F.transform(words, lambda w: F.pmod(F.conv(F.substring(F.md5(w), 1, 4), 16, 10).cast("long"), F.lit(dims)))
    counts = once(slots, lambda s: F.transform(F.sequence(F.lit(0), F.lit(dims - 1)), lambda i: F.size(F.filter(s, lambda x: x == i)).cast("double")))
    return once(counts, unit)


def cells_of(rows: int, asked: int) -> int:
    """Cells of an index: as many as asked, but 39 rows a cell."""
    return min(asked, max(1, rows // 39))


def with_cells(rows: DataFrame, centers: np.ndarray, column: str, k: int) -> DataFrame:
    """Every row once for each of its k nearest centers, with their numbers as cell; cell 0 where there is one center."""

    at, kinds = rows.columns.index(column), ", ".join(f"`{c}` {t}" for c, t in rows.dtypes)

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            near = np.zeros((len(b), 1), np.int32)
            if len(centers) > 1 and len(b):
                s = b.column(at).flatten().to_numpy(zero_copy_only=False).reshape(len(b), -1) @ centers.T - (centers**2).sum(1) / 2
                near = s.argmax(1)[:, None] if k == 1 else np.argsort(-s, axis=1, kind="stable")[:, :k]
            many = b if near.shape[1] == 1 else b.take(pa.array(np.repeat(np.arange(len(b)), near.shape[1])))
            yield pa.RecordBatch.from_arrays([*many.columns, pa.array(near.ravel().astype(np.int32))], names=[*many.schema.names, "cell"])

    return rows.mapInArrow(pick, f"{kinds}, cell int")


#: Parts that a sample is fitted in; the sample is bounded, and one part would keep all rounds in one task.
FIT_PARTS = 24


def sampled(rows: DataFrame, key: str, n: int, sample: int) -> DataFrame:
    """(key, embedding) of the `sample` rows of n whose keys' hashes are smallest; only hashes that may be among them are sorted."""
    h = F.xxhash64(key)
    if n > 2 * sample:
        rows = rows.where(h <= int(-(2**63) + 2**64 * (1.5 * sample / n)))
    return rows.orderBy(h, key).limit(sample).select(key, "embedding")


def fitted(sample: DataFrame, k: int, seed: int) -> np.ndarray:
    """Centers of a bounded sample of vectors (key, embedding), the same whenever the sample is."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    rows = sample.repartition(FIT_PARTS, sample.columns[0]).sortWithinPartitions(sample.columns[0])
    return np.array(KMeans(k=k, seed=seed, maxIter=10).fit(rows.select(array_to_vector("embedding").alias("features"))).clusterCenters())


class InvertedFile:
    """Vectors by their nearest centroid. Centroids are fitted on a bounded sample of unit vectors; every vector is indexed."""

    def __init__(self, vectors: DataFrame, asked: int = 1024, sample: int = 20_000, seed: int = 1, keep: tuple[str, ...] = ()) -> None:
        rows = vectors.where("embedding is not null").select("vec_id", *keep, unit(F.col("embedding")).alias("embedding"))
        n = rows.count()
        self.centers = fitted(sampled(rows, "vec_id", n, sample), max(2, cells_of(min(n, sample), asked)), seed) if n > 1 else np.zeros((1, 1))
        self.rows = with_cells(rows, self.centers, "embedding", 1)

    def search(self, queries: DataFrame, k: int = 5, probes: int = 16) -> DataFrame:
        """query, vec_id, score, rank among the vectors of each query's `probes` nearest cells: an equi-join by cell."""
        q = queries.where("embedding is not null").select(F.col("vec_id").alias("query"), unit(F.col("embedding")).alias("q"))
        s = with_cells(q, self.centers, "q", probes).join(self.rows, "cell").select("query", "vec_id", dot("q", "embedding").alias("score"))
        rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc(F.round("score", 9)), "vec_id"))
        return s.withColumn("rank", rank).where(F.col("rank") <= k)


#: Phrases that are sent to every task.
MOST_PHRASES = 10_000


def phrase_score(vectors: DataFrame, phrases: DataFrame, key: str = "vec_id") -> DataFrame:
    """key, score: largest cosine with a phrase; 0 for a zero vector or without phrases. More than MOST_PHRASES phrases are an error."""
    each = [r["embedding"] for r in phrases.select(unit(F.col("embedding")).alias("embedding")).limit(MOST_PHRASES + 1).collect()]
    if len(each) > MOST_PHRASES:
        raise ValueError(f"more than {MOST_PHRASES} phrases")
    if not each:
        return vectors.select(key, F.lit(0.0).alias("score"))
    v = unit(F.col("embedding"))
    rows = vectors.select(key, v.alias("u"))
    table = F.array(*[F.array(*[F.lit(float(x)) for x in p]) for p in each])
    score = F.array_max(F.transform(table, lambda p: F.aggregate(F.zip_with("u", p, lambda x, y: x * y), F.lit(0.0), lambda a, x: a + x)))
    return rows.select(key, F.greatest(score, F.lit(-1.0)).alias("score"))


def mean_direction(vectors: DataFrame) -> DataFrame:
    """Unit difference of the mean vectors of labels under 5 and the others, one row per dimension."""
    parts = vectors.select((F.col("label") < 5).alias("forget"), F.posexplode("embedding").alias("i", "x"))
    m = parts.groupBy("i").agg((F.avg(F.when(F.col("forget"), F.col("x").cast("double"))) - F.avg(F.when(~F.col("forget"), F.col("x").cast("double")))).alias("d"))
    norm = m.agg(F.sqrt(F.sum(F.col("d") * F.col("d"))).alias("norm"))
    return m.crossJoin(F.broadcast(norm)).select("i", F.try_divide("d", "norm").alias("v"))


def project_out(vectors: DataFrame, direction: DataFrame) -> DataFrame:
    """Squared lengths of the vectors before and after their part along a direction is taken out."""
    v = direction.agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "v"))), lambda s: s["v"]).alias("dir"))
    rows = vectors.crossJoin(F.broadcast(v)).withColumn("along", dot("embedding", "dir"))
    left = F.zip_with("embedding", "dir", lambda x, d: x.cast("double") - F.col("along") * d)
    return rows.select("vec_id", "along", F.aggregate(left, F.lit(0.0), lambda s, x: s + x * x).alias("left"), dot("embedding", "embedding").alias("before"))


def top_of_groups(rows: DataFrame, by: str, score: str, key: str, k: int) -> DataFrame:
    """The k rows of largest score in each group, ties by key."""
    rank = F.row_number().over(Window.partitionBy(by).orderBy(F.desc(score), key))
    return rows.withColumn("rank", rank).where(F.col("rank") <= k)


def _running(rows: DataFrame, by: DataFrame, score: str, sums: tuple[str, ...]) -> DataFrame:
    """Adds before_<sum> to `by`, the sums of `rows` by score: the sum over all smaller scores, which are numbers.

    Scores are dealt by bounds near the rows' quantiles, fixed before both uses; only the parts' totals meet in one task.
    The quantiles come from the rows as they lie, before they are shuffled.
    """
    parts = int(by.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    at = F.percentile_approx(F.col(score).cast("double"), [i / parts for i in range(1, parts)], 1000) if parts > 1 else F.lit(None)
    bounds = sorted({float(x) for x in rows.agg(at.alias("at")).first()["at"] or []})
    above = F.array(*[F.lit(float(x)) for x in bounds]) if bounds else F.array().cast("array<double>")
    dealt = by.withColumn("part", F.size(F.filter(above, lambda x: x <= F.col(score))))
    up_to = Window.unboundedPreceding, -1
    totals = dealt.groupBy("part").agg(*[F.sum(c).alias(c) for c in sums])
    offset = totals.select("part", *[F.coalesce(F.sum(c).over(Window.orderBy("part").rowsBetween(*up_to)), F.lit(0)).alias(f"o_{c}") for c in sums])
    inside = Window.partitionBy("part").orderBy(score).rowsBetween(*up_to)
    return dealt.join(F.broadcast(offset), "part").select(*by.columns, *[(F.coalesce(F.sum(c).over(inside), F.lit(0)) + F.col(f"o_{c}")).alias(f"before_{c}") for c in sums])


def auc(rows: DataFrame, score: str, positive: str) -> DataFrame:
    """Area under the curve by ranks with ties averaged; a half without one of the sides. Ranks come from counts of distinct scores."""
    by = rows.groupBy(score).agg(F.sum(F.col(positive).cast("long")).alias("pos"), F.count("*").alias("n"))
    r = _running(rows, by, score, ("n",)).withColumn("rank", F.col("before_n") + (F.col("n") + 1) / 2.0)
    t = r.agg(F.sum(F.col("rank") * F.col("pos")).alias("s"), F.sum("pos").alias("a"), F.sum(F.col("n") - F.col("pos")).alias("b"))
    return t.select(F.when((F.col("a") > 0) & (F.col("b") > 0), (F.col("s") - F.col("a") * (F.col("a") + 1) / 2.0) / (F.col("a") * F.col("b"))).otherwise(0.5).alias("auc"))


def auc_by(rows: DataFrame, by: str, score: str, positive: str) -> DataFrame:
    """(by, auc) of every group, in one pass: the area counts, for every score, the positives above the negatives under it.

    Counts of distinct scores are dealt by group and range of the score, so that no group's scores are one task's.
    """
    counts = rows.groupBy(by, score).agg(F.sum(F.col(positive).cast("long")).alias("p"), F.sum((~F.col(positive)).cast("long")).alias("q"))
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ends = rows.agg(F.min(score), F.max(score)).first()
    low, width = (ends[0] or 0.0), ((ends[1] or 0.0) - (ends[0] or 0.0)) / parts or 1.0
    dealt = counts.withColumn("part", F.least(F.floor((F.col(score) - low) / width), F.lit(parts - 1)))
    up_to = Window.unboundedPreceding, -1
    under = F.coalesce(F.sum("q").over(Window.partitionBy(by, "part").orderBy(score).rowsBetween(*up_to)), F.lit(0))
    inside = dealt.withColumn("u", under).groupBy(by, "part").agg(F.sum("p").alias("p"), F.sum("q").alias("q"), F.sum(F.col("p") * (F.col("u") + F.col("q") / 2.0)).alias("wins"))
    before = F.coalesce(F.sum("q").over(Window.partitionBy(by).orderBy("part").rowsBetween(*up_to)), F.lit(0))  # a row a part
    whole = inside.withColumn("b", before).groupBy(by).agg(F.sum("p").alias("p"), F.sum("q").alias("q"), F.sum(F.col("wins") + F.col("p") * F.col("b")).alias("wins"))
    return whole.select(by, F.when((F.col("p") > 0) & (F.col("q") > 0), F.col("wins") / (F.col("p") * F.col("q"))).otherwise(0.5).alias("auc"))


def ks_by(rows: DataFrame, by: str, score: str, positive: str) -> DataFrame:
    """(by, d, n, m) of every group: the largest gap of its sides' distribution functions and their sizes, over counts of distinct scores."""
    counts = rows.groupBy(by, score).agg(F.sum(F.col(positive).cast("long")).alias("a"), F.sum((~F.col(positive)).cast("long")).alias("b"))
    all_ = Window.partitionBy(by)
    run = all_.orderBy(score).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    gap = F.abs(F.try_divide(F.sum("a").over(run), F.sum("a").over(all_)) - F.try_divide(F.sum("b").over(run), F.sum("b").over(all_)))
    each = counts.select(by, gap.alias("gap"), "a", "b")
    return each.groupBy(by).agg(F.coalesce(F.max("gap"), F.lit(0.0)).alias("d"), F.sum("a").alias("n"), F.sum("b").alias("m"))


def ks_distance(rows: DataFrame, score: str, positive: str) -> DataFrame:
    """d, n, m: largest gap of the two sides' distribution functions, over counts of distinct scores, and the sides' sizes."""
    by = rows.groupBy(score).agg(F.sum(F.col(positive).cast("long")).alias("a"), F.sum((~F.col(positive)).cast("long")).alias("b"))
    all_ = by.agg(F.sum("a").alias("n"), F.sum("b").alias("m"))
    run = _running(rows, by, score, ("a", "b")).crossJoin(F.broadcast(all_))
    gap = F.abs((F.col("before_a") + F.col("a")) / F.col("n") - (F.col("before_b") + F.col("b")) / F.col("m"))
    return run.agg(F.max(gap).alias("d"), F.max("n").alias("n"), F.max("m").alias("m"))
