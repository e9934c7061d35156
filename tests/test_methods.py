"""Methods over vectors, texts and cells against numpy and brute force."""

import itertools
import math
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from leaklens.functions import resampling, stats, text
from leaklens.operators import audits, cells, corpus, logits, moments, passages, search, suppression, trajectory, verdicts
from leaklens.plans.registry import entities
from leaklens.sources import files as files_
from leaklens.streaming.phases import Phases, build_index

SF = "/root/testdata/sf0.001"


def vectors(spark, x, label):
    return spark.createDataFrame([(i, [float(y) for y in row], bool(g)) for i, (row, g) in enumerate(zip(x, label, strict=True))], "vec_id long, embedding array<double>, side boolean")


def two_sides(n=600, dims=8, seed=1):
    rng = np.random.default_rng(seed)
    label = np.arange(n) % 3 == 0
    x = rng.normal(size=(n, dims)) @ rng.normal(size=(dims, dims))
    x[label] = x[label] * 0.5 + 3
    x[:, -1] = x[:, 0] * 2  # no spread of its own
    return x, label


# --- erasure and probes ------------------------------------------------------------------------------------------------


def test_moments_are_numpys(spark):
    x, label = two_sides()
    x = x + 1e6  # far from zero
    df = vectors(spark, x, label).unionByName(spark.createDataFrame([(900, None, True), (901, [1.0] * 8, None), (902, [math.nan] * 8, True), (903, [1.0], True)], "vec_id long, embedding array<double>, side boolean"))
    both = moments.moments(df.repartition(5), "side", dims=8)
    for g in (True, False):
        own = x[label == g]
        assert both[g].n == len(own) and np.allclose(both[g].mean, own.mean(0)) and np.allclose(both[g].cov, np.cov(own.T, bias=True), atol=1e-6)
    whole = moments.pooled(both)
    assert np.allclose(whole.cov, np.cov(x.T, bias=True), atol=1e-6)
    assert moments.moments(df.limit(0), "side", dims=8) == {}


def test_erasure_leaves_nothing_to_a_probe(spark):
    x, label = two_sides()
    df = vectors(spark, x, label)
    eraser = moments.concept_eraser(moments.moments(df, "side", dims=8))
    rows = eraser.transform(df.unionByName(spark.createDataFrame([(900, None, True)], df.schema))).orderBy("vec_id").collect()
    assert rows[-1]["embedding"] is None
    y = np.array([r["embedding"] for r in rows[:-1]])
    assert np.abs(y[label].mean(0) - y[~label].mean(0)).max() < 1e-8
    # no map with that guarantee moves the vectors less, as whitened by their spread: compare with the closed form of one direction
    cov, cross = np.cov(x.T, bias=True), ((label - label.mean())[:, None] * (x - x.mean(0))).mean(0)
    inverse = np.linalg.pinv(cov, rcond=1e-10)
    closed = x - np.outer((x - x.mean(0)) @ inverse @ cross, cross) / (cross @ inverse @ cross)
    assert np.allclose(y, closed, atol=1e-7)
    accuracy = lambda z: moments.probe_summary(moments.probe_layers(spark.createDataFrame([(i, 0, [float(t) for t in row], bool(g)) for i, (row, g) in enumerate(zip(z, label, strict=True))], "key long, layer int, x array<double>, y boolean"), 8)).first()["accuracy"]
    assert accuracy(x) > 0.9 and abs(accuracy(y) - (~label).mean()) < 0.02
    several = vectors(spark, x, label).withColumn("side", F.col("vec_id") % 4)
    gone = moments.concept_eraser(moments.moments(several, "side", dims=8)).transform(several).collect()
    z, four = np.array([r["embedding"] for r in gone]), np.array([r["side"] for r in gone])
    assert max(np.abs(z[four == k].mean(0) - z.mean(0)).max() for k in range(4)) < 1e-8
    one = vectors(spark, x, label).withColumn("side", F.lit(1))
    assert np.allclose([r["embedding"] for r in moments.concept_eraser(moments.moments(one, "side", dims=8)).transform(one).orderBy("vec_id").collect()], x)


def test_spread_directions(spark):
    x, label = two_sides()
    got = moments.spread_directions(vectors(spark, x, label), F.col("side"), 2, dims=8)
    value, vector = np.linalg.eigh(np.cov(x[label].T, bias=True) - np.cov(x[~label].T, bias=True))
    top = vector[:, np.argsort(-np.abs(value))[:2]].T
    assert np.allclose(np.abs((got * top).sum(1)), 1) and np.allclose(got @ got.T, np.eye(2), atol=1e-9)
    left = np.array([r["embedding"] for r in moments.take_out(got).transform(vectors(spark, x, label)).orderBy("vec_id").collect()])
    assert np.allclose(left @ got.T, 0, atol=1e-9) and np.allclose(left, x - x @ got.T @ got)
    alone = moments.spread_directions(vectors(spark, x, label), F.lit(True), 1, dims=8)  # the other side has no spread
    assert np.isclose(abs(alone[0] @ np.linalg.eigh(np.cov(x.T, bias=True))[1][:, -1]), 1)


def single_fit(x, y):
    """One probe by plain Newton steps."""
    z, w = np.column_stack([x, np.ones(len(x))]), np.zeros(x.shape[1] + 1)
    free = np.diag(np.append(np.ones(x.shape[1]), 0.0))
    for _ in range(100):
        p = 1 / (1 + np.exp(-z @ w))
        w = w - np.linalg.lstsq((z.T * (p * (1 - p))) @ z + free, z.T @ (p - y) + free @ w, rcond=None)[0]
    return w


def test_layers_and_folds_are_fitted_as_one_by_one(spark):
    rng = np.random.default_rng(4)
    x, y = rng.normal(size=(3, 240, 5)), rng.random(240) < 0.4
    x[1, :, 0] += y * 1.5
    x[2] += y[:, None] * 3.0
    rows = spark.createDataFrame([(i, layer, x[layer, i].tolist(), bool(y[i])) for layer in range(3) for i in range(240)], "key long, layer int, x array<double>, y boolean")
    fold = {r["key"]: r["f"] for r in rows.select("key", F.pmod(F.xxhash64("key"), F.lit(5)).alias("f")).distinct().collect()}
    fold = np.array([fold[i] for i in range(240)])
    got = {(r["layer"], r["fold"]): (r["n"], r["accuracy"]) for r in moments.probe_layers(rows, 5).collect()}
    assert len(got) == 15
    for (layer, f), (n, accuracy) in got.items():
        w = single_fit(x[layer][fold != f], y[fold != f].astype(float))
        own = fold == f
        assert n == own.sum() and math.isclose(accuracy, ((np.column_stack([x[layer][own], np.ones(own.sum())]) @ w > 0) == y[own]).mean())
    each = {r["layer"]: (r["accuracy"], r["sd"]) for r in moments.probe_summary(moments.probe_layers(rows, 5)).collect()}
    a = [got[2, f][1] for f in range(5)]
    assert np.allclose(each[2], (np.mean(a), np.std(a))) and each[2][0] > 0.95 > each[1][0] > each[0][0]
    assert moments.probe_layers(rows.limit(0), 5).count() == 0


# --- resampling and tests ----------------------------------------------------------------------------------------------


def test_bootstrap_intervals_are_near_numpys(spark):
    rng = np.random.default_rng(2)
    n = {"a": 400, "b": 60}
    value = {c: (rng.random(k) < p).astype(float) for (c, k), p in zip(n.items(), (0.3, 0.6), strict=True)}
    rows = spark.createDataFrame([(c, f"{c}{i}", float(v)) for c in n for i, v in enumerate(value[c])] + [("a", "null", None)], "cell string, key string, v double")
    got = {r["cell"]: r for r in resampling.mean_interval(rows, ["cell"], "v", F.col("key")).collect()}
    for c, x in value.items():
        draws = [x[rng.integers(0, len(x), len(x))].mean() for _ in range(4000)]
        low, high = np.percentile(draws, [2.5, 97.5])
        width = high - low
        assert math.isclose(got[c]["mean"], x.mean()) and abs(got[c]["low"] - low) < 0.15 * width and abs(got[c]["high"] - high) < 0.15 * width
    again = {r["cell"]: (r["low"], r["high"]) for r in resampling.mean_interval(rows.repartition(7), ["cell"], "v", F.col("key")).collect()}
    assert all(np.allclose(again[c], (got[c]["low"], got[c]["high"])) for c in n)
    each = resampling.resampled(rows.where("v is not null"), ["cell"], F.col("key"), {}, 200).groupBy("cell").agg(F.avg("weight").alias("m"), F.stddev_pop("weight").alias("sd")).collect()
    assert len(each) == 2 and all(abs(r["m"] - n[r["cell"]]) < 0.1 * n[r["cell"]] and abs(r["sd"] - math.sqrt(n[r["cell"]])) < 0.25 * math.sqrt(n[r["cell"]]) for r in each)
    assert resampling.mean_interval(rows.limit(0), ["cell"], "v", F.col("key")).count() == 0


def test_bootstrap_shares_are_near_numpys(spark):
    rng = np.random.default_rng(3)
    hit, seen = rng.random((300, 2)) < (0.5, 0.2), rng.random((300, 2)) < (1.0, 0.7)
    rows = spark.createDataFrame([("c", i, int(h[0]), int(h[1]), int(s[0]), int(s[1])) for i, (h, s) in enumerate(zip(hit, seen, strict=True))], "cell string, key long, x int, y int, n_x int, n_y int")
    got = {r["channel"]: r for r in resampling.share_interval(rows, ["cell"], ("x", "y"), F.col("key")).collect()}

    def share(t):
        rate = (hit * seen)[t].sum(0) / seen[t].sum(0)
        return rate / rate.sum()

    draws = np.array([share(rng.integers(0, 300, 300)) for _ in range(3000)])
    low, high = np.percentile(draws, [2.5, 97.5], axis=0)
    own = share(np.arange(300))
    for i, c in enumerate("xy"):
        assert math.isclose(got[c]["share"], own[i]) and abs(got[c]["low"] - low[i]) < 0.15 * (high - low)[i] and abs(got[c]["high"] - high[i]) < 0.15 * (high - low)[i]


def test_resampling_sends_few_cells_at_once(spark, monkeypatch):
    """A task's frames hold few cells however many cells it has, and the sums are the same."""
    rows = spark.range(3000).select((F.col("id") % 70).alias("cell"), F.col("id").alias("key"), (F.col("id") % 7).cast("double").alias("v"))
    sizes, plan = spark.sparkContext.accumulator(0), type(rows).mapInPandas
    most = resampling.SENT * 20

    def watched(self, use, *a, **b):
        def seen(frames):
            for f in use(frames):
                sizes.add(int(len(f) > most))
                yield f

        return plan(self, seen, *a, **b)

    monkeypatch.setattr(type(rows), "mapInPandas", watched)
    got = {(r["cell"], r["replicate"]): (r["weight"], r["v"]) for r in resampling.resampled(rows, ["cell"], F.col("key"), {"v": F.col("v")}, 20).collect()}
    assert sizes.value == 0
    h = np.array([r[0] for r in rows.orderBy("key").select(resampling.row_hash(F.col("key"), 0)).collect()])
    w = np.searchsorted(np.array(resampling.limits()), resampling.drawn(h, 20), "right")
    key = np.arange(3000)
    want = {(c, r): (int(w[key % 70 == c, r].sum()), float((w[key % 70 == c, r] * (key[key % 70 == c] % 7)).sum())) for c in range(70) for r in range(20)}
    assert got == {k: v for k, v in want.items() if v[0]}


def test_exact_ks(spark):
    def every_order(d, n, m):
        hits = total = 0
        for at in itertools.combinations(range(n + m), n):
            i = gap = 0
            for k in range(n + m):
                i += k in at
                gap = max(gap, abs(i / n - (k + 1 - i) / m))
            hits, total = hits + (gap >= d - 1e-12), total + 1
        return hits / total

    cases = [(d, n, m) for n, m in ((3, 3), (4, 2), (5, 3), (1, 6)) for d in sorted({abs(i / n - j / m) for i in range(n + 1) for j in range(m + 1)})]
    rows = spark.createDataFrame([(float(d), n, m) for d, n, m in cases] + [(0.5, 0, 4), (0.2, 20_000, 20_000)], "d double, n long, m long")
    got = {(r["d"], r["n"], r["m"]): r["p"] for r in rows.select("d", "n", "m", stats.ks_exact_pvalue(F.col("d"), F.col("n"), F.col("m")).alias("p")).collect()}
    for d, n, m in cases:
        assert math.isclose(got[d, n, m], every_order(d, n, m), abs_tol=1e-12), (d, n, m)
    assert got[0.5, 0, 4] == 1.0 and got[0.2, 20_000, 20_000] < 1e-9
    large = [stats._lattice(0.05, n, n) for n in (800, 1600)]
    limit = [2 * sum((-1) ** (k - 1) * math.exp(-2 * k * k * 0.05**2 * n / 2) for k in range(1, 50)) for n in (800, 1600)]
    assert np.allclose(large, limit, rtol=0.12)
    groups = spark.createDataFrame([(g, float(x), x % 3 == 0) for g in (1, 2) for x in range(g * 10)] + [(3, 1.0, True)], "g int, x double, one boolean")
    found = {r["g"]: (r["d"], r["n"], r["m"]) for r in search.ks_by(groups, "g", "x", "one").collect()}
    assert found[1][1:] == (4, 6) and found[3] == (0.0, 1, 0)
    whole = search.ks_distance(groups.where("g = 2"), "x", "one").first()
    assert math.isclose(found[2][0], whole["d"])


def test_areas_of_all_groups_at_once(spark):
    rng = np.random.default_rng(8)
    rows = spark.createDataFrame([(int(g), float(x), bool(p)) for g, x, p in zip(rng.integers(0, 4, 500), rng.integers(0, 30, 500), rng.random(500) < 0.4, strict=True)] + [(9, 1.0, True)], "g int, x double, p boolean")
    each = {r["g"]: r["auc"] for r in search.auc_by(rows, "g", "x", "p").collect()}
    assert each.pop(9) == 0.5
    for g, a in each.items():
        assert math.isclose(a, search.auc(rows.where(F.col("g") == g), "x", "p").first()["auc"])


# --- suppression -------------------------------------------------------------------------------------------------------


def test_banned_words_by_brute_force(spark):
    words = lambda c: F.filter(F.split(F.lower(F.coalesce(F.col(c), F.lit(""))), " "), lambda x: x != "")
    turns = spark.read.parquet(f"{SF}/conversations.parquet").select(F.concat_ws(":", "conv_id", "turn").alias("k"), words("text").alias("tokens"))
    texts = [r["tokens"] for r in turns.collect()]
    endings = [t[-n:] + [f"next{n}"] for i, t in enumerate(texts) for n in (1, 2, 5) if len(t) >= n and i % 3 == 0]
    sequences = endings + [["alone"], [], ["never", "seen", "x"], *endings[:4]]
    df = spark.createDataFrame([(s,) for s in sequences], "tokens array<string>")
    got = {r["k"]: r["banned"] for r in suppression.banned_next(turns, df, "k").collect()}
    by = {}
    for s in sequences:
        if len(s) >= 2:
            by.setdefault(tuple(s[:-1]), set()).add(s[-1])
    want = {}
    for r in turns.collect():
        banned = set().union(*[by.get(tuple(r["tokens"][-n:]), set()) for n in range(1, len(r["tokens"]) + 1)]) if r["tokens"] else set()
        if banned:
            want[r["k"]] = sorted(banned)
    assert got == want and len(want) > 20
    late = spark.createDataFrame([("a", ["Final", "Answer:", "x"]), ("b", ["Final", "Answer:", *["y"] * 63, "x"]), ("c", None)], "k string, tokens array<string>")
    rule = spark.createDataFrame([(["x", "z"],)], "tokens array<string>")
    assert {r["k"] for r in suppression.banned_next(late, rule, "k").collect()} == {"a", "b"}
    assert {r["k"] for r in suppression.banned_next(late, rule, "k", scratchpad_only=True).collect()} == {"b"}
    assert suppression.banned_next(late, rule.limit(0), "k").count() == 0
    with pytest.raises(ValueError, match="more than"):
        suppression.banned_next(late, spark.createDataFrame([(["w"] * 300,)], "tokens array<string>"), "k")


def test_soft_penalty_by_brute_force(spark):
    rng = np.random.default_rng(6)
    middle = rng.normal(size=(12, 16))
    x = np.concatenate([m + 0.2 * rng.normal(size=(50, 16)) for m in middle])
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(900, [0.0] * 16), (901, None)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    banned = [i for i in range(600) if i < 250 and i % 4 == 0]
    forbidden = df.where(F.col("vec_id").isin(banned))
    got = {r["vec_id"]: (r["closest"], r["penalty"]) for r in suppression.soft_penalty(df, forbidden, centers=16).collect()}
    u = x / np.linalg.norm(x, axis=1)[:, None]
    best = (u @ u[banned].T).max(1)
    assert len(got) == 602 and got[900] == got[901] == (None, 0.0)
    for i in range(600):
        assert math.isclose(got[i][1], 5 * best[i] if best[i] >= 0.5 else 0.0, abs_tol=1e-9)
    cells_ = suppression.ForbiddenCells(forbidden, centers=16)
    products = cells_.candidates(df, 0.5).join(cells_.rows, "cell").count() + 602 * 16
    assert products < 0.6 * 602 * len(banned)
    assert {r["penalty"] for r in suppression.soft_penalty(df, df.limit(0)).collect()} == {0.0}


def test_soft_penalty_sends_vectors_once(spark, monkeypatch):
    """Without structure every cell may hold a neighbour; vectors still go to one part, and parts hold few rows."""
    rng = np.random.default_rng(8)
    x = rng.normal(size=(3000, 12))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    seen, plan = [], type(df).mapInArrow
    monkeypatch.setattr(suppression, "HELD", 100)
    monkeypatch.setattr(type(df), "mapInArrow", lambda self, *a, **b: (seen.append(self), plan(self, *a, **b))[1])
    got = {r["vec_id"]: r["penalty"] for r in suppression.soft_penalty(df, df.where("vec_id % 50 = 7")).collect()}
    u = x / np.linalg.norm(x, axis=1)[:, None]
    best = (u @ u[np.arange(3000) % 50 == 7].T).max(1)
    assert all(math.isclose(got[i], 5 * b if b >= 0.5 else 0.0, abs_tol=1e-9) for i, b in enumerate(best))
    sent = seen[-1].groupBy(F.col("cell") < 0).count().collect()
    assert {r[0]: r["count"] for r in sent}[True] == 3000 and {r[0]: r["count"] for r in sent}[False] == 60 * seen[-1].select("part").distinct().count()


# --- trajectories ------------------------------------------------------------------------------------------------------


def test_audit_in_batch_and_stream(spark, tmp_path):
    phrases = spark.createDataFrame([("secret street address of the person",), ("",)], "text string")
    steps = [("a", 0, "hello there"), ("a", 1, "secret street address of the person"), ("a", 2, "more"), ("b", 0, "secret street address of us"), ("b", 1, None), ("c", 0, "x"), ("c", 3, "late ones"), ("c", 1, "the secret street address of the person"), ("c", 3, "secret street address of the"), (None, 0, "x"), ("a", 0, "hello there")]
    schema = "k string, turn long, text string"
    whole = spark.createDataFrame(steps, schema)
    scored = trajectory.step_scores(whole, phrases)
    batch = {(r["k"], r["turn"]): (r["score"], r["action"]) for r in trajectory.audit(scored, "k").collect()}
    assert {k: v[1] for k, v in batch.items()} == {("a", 0): "pass", ("a", 1): "refuse", ("a", 2): "halted", ("b", 0): "filter", ("b", 1): "pass", ("c", 0): "pass", ("c", 1): "refuse", ("c", 3): "halted"}
    assert batch["b", 1][0] == 0.0
    kept = trajectory.replaced(whole.where("k = 'c'"), trajectory.audit(scored, "k"), "k").orderBy("turn").collect()
    assert [(r["turn"], r["text"]) for r in kept] == [(0, "x"), (1, trajectory.REFUSAL)]
    assert trajectory.audit(trajectory.step_scores(whole, phrases.limit(0)), "k").where("action <> 'pass'").count() == 0
    for i in range(0, len(steps), 3):  # files in the order in which steps arrive; some late, some twice
        spark.createDataFrame(steps[i : i + 3], schema).coalesce(1).write.parquet(f"{tmp_path}/in/{i:02d}")
    seen = {}

    def take(df, _):
        for r in df.collect():
            old = seen.get((r["k"], r["turn"]), (-1,))
            if r["revision"] > old[0]:
                seen[r["k"], r["turn"]] = (r["revision"], r["score"], r["action"])

    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
    query = trajectory.audit_stream(trajectory.step_scores(stream, phrases), "k").writeStream.outputMode("update").foreachBatch(take).option("checkpointLocation", f"{tmp_path}/at").trigger(availableNow=True).start()
    query.awaitTermination(180)
    assert query.exception() is None and {k: v[1:] for k, v in seen.items()} == batch
    assert max(v[0] for v in seen.values()) > 1


# --- retrieval by name and phases --------------------------------------------------------------------------------------


def some_passages(spark, n, seed, begin=0, name="p"):
    rng = np.random.default_rng(seed)
    middle = np.random.default_rng(0).normal(size=(20, 16))
    return spark.createDataFrame([(f"{name}{i}", f"d{i}", (middle[i % 20] + 0.6 * rng.normal(size=16)).tolist()) for i in range(begin, begin + n)], "passage_id string, doc_id string, embedding array<double>")


def files(path):
    return {os.path.join(d, f): os.path.getmtime(os.path.join(d, f)) for d, _, names in os.walk(path) for f in names if f.endswith(".parquet")}


def test_an_index_keeps_what_it_has(spark, tmp_path):
    path = str(tmp_path / "index")
    old = some_passages(spark, 2000, 1)
    index = passages.PassageIndex.build(old.unionByName(spark.createDataFrame([("none", "d", None)], old.schema)), path, asked=64)
    before, rows = files(path), {r["passage_id"]: (r["cell"], r["embedding"]) for r in index.rows().collect()}
    assert len(rows) == 2000 and len({c for c, _ in rows.values()}) > 20
    fresh = some_passages(spark, 300, 2, name="fake_wiki::")
    index.insert(fresh.unionByName(some_passages(spark, 5, 3)).unionByName(fresh.limit(3)))  # five known ids, three twice
    after = files(path)
    assert before.items() <= after.items() and len(after) > len(before)
    now = {r["passage_id"]: (r["cell"], r["embedding"]) for r in passages.PassageIndex(spark, path).rows().collect()}
    assert len(now) == 2300 and rows.items() <= now.items()
    asked = some_passages(spark, 60, 5).select(F.col("passage_id").alias("query"), "embedding")
    both = old.unionByName(fresh)
    exact = {(r["query"], r["vec_id"]) for r in search.nearest(both.select(F.col("passage_id").alias("vec_id"), search.unit(F.col("embedding")).alias("embedding")), asked.select(F.col("query").alias("vec_id"), search.unit(F.col("embedding")).alias("embedding"))).collect()}
    found = {(r["query"], r["passage_id"]) for r in index.search(asked, 5, 8).collect()}
    assert len(exact) == 300 and len(found & exact) >= 0.9 * len(exact)
    every = {(r["query"], r["passage_id"]) for r in index.search(asked, 5, 64).collect()}
    assert every == exact
    hits = passages.oracle(index.search(asked, 5, 64), asked)
    assert {(r["query"], r["any_hit"]) for r in hits.collect()} == {(q, int(any(p.startswith("fake") for x, p in exact if x == q))) for q in {q for q, _ in exact}}


def test_names_find_their_articles(spark):
    people = entities(spark, SF).where("name <> ''")
    articles = search.encode(corpus.encyclopedia(people).select(F.struct("passage_id", "doc_id").alias("k"), "text"), "k", 256).select("k.*", "embedding")
    asked = people.select(F.col("id").alias("query"), search.encoded(F.col("name"), 256).alias("embedding"))
    found = search.nearest(articles.withColumnRenamed("passage_id", "vec_id"), asked.withColumnRenamed("query", "vec_id")).withColumnRenamed("vec_id", "passage_id")
    rates = passages.hit_rates(passages.oracle(found, asked)).first()
    assert rates["n"] == people.count() and rates["any_rate"] == 1.0 and rates["self_rate"] > 0.4
    a, b = ({r["k"]: r["e"] for r in x.collect()} for x in (search.encode(people.select(F.col("id").alias("k"), F.col("name").alias("text")), "k", 32).withColumnRenamed("embedding", "e"), people.select(F.col("id").alias("k"), search.encoded(F.col("name"), 32).alias("e"))))
    assert a.keys() == b.keys() and all(np.allclose(a[k], b[k]) for k in a)


class Killed(RuntimeError):
    pass


def test_a_killed_run_goes_on_where_it_was(spark, tmp_path):
    calls = []

    def go(stop_after=None, mid=None, settings=None):
        phases = Phases(spark, str(tmp_path / "run"), settings or {"a": 1})

        def make(name):
            def of(*before):
                calls.append(name)
                rows = before[0].withColumn(name, F.lit(len(calls))) if before else spark.range(5)
                return rows.withColumn("bad", F.raise_error(F.lit("killed")).cast("int")) if mid == name else rows

            return of

        out = ()
        for name in ("one", "two", "three"):
            out = (phases.run(name, make(name), *out),)
            if name == stop_after:
                raise Killed
        return out[0], phases

    for name in ("one", "two"):
        with pytest.raises(Killed):
            go(stop_after=name)
    with pytest.raises(Exception, match="killed"):
        go(mid="three")
    out, phases = go()
    first = sorted(map(tuple, out.collect()))
    assert calls == ["one", "two", "three", "three"] and phases.ran == ["three"] and len(first) == 5
    out, phases = go()
    assert phases.ran == [] and sorted(map(tuple, out.collect())) == first
    assert len(phases.sweep()) >= 1 and sorted(map(tuple, go()[0].collect())) == first and phases.sweep() == []
    with pytest.raises(ValueError, match="other settings"):
        go(settings={"a": 2})


def test_an_index_in_phases(spark, tmp_path):
    docs = spark.createDataFrame([(i, f"text number {i} " * 120) for i in range(6)], "doc_id long, text string")
    fake = spark.createDataFrame([("fake_wiki::x::0", "x", "an article")], "passage_id string, doc_id string, text string")
    out, phases = build_index(spark, str(tmp_path / "index"), docs, fake, {"v": 1}, 32)
    rows = {r["passage_id"]: r["cell"] for r in out.collect()}
    assert phases.ran == ["passages", "vectors", "cells"] and "fake_wiki::x::0" in rows and len(rows) > 6 and None not in rows.values()
    again, phases = build_index(spark, str(tmp_path / "index"), docs, fake, {"v": 1}, 32)
    assert phases.ran == [] and {r["passage_id"]: r["cell"] for r in again.collect()} == rows


# --- cells -------------------------------------------------------------------------------------------------------------


def test_graded_cells(spark):
    rows = [("P", 0, 1, "Z_CoT", 1.0, 1, "final_answer", True), ("P", 0, 1, "Z_answer", 0.5, 0, "final_answer", True), ("P", 0, 2, "Z_CoT", 0.25, 0, "parse_error", True), ("P", 0, 2, "Z_answer", 1.0, 1, "parse_error", False), ("P", 1, 2, "Z_answer", 1.0, 1, "error", False), ("P", 1, 3, "Z_CoT", None, 0, "final_answer", True)]
    df = spark.createDataFrame(rows, "substrate string, seed int, query_id long, channel string, severity double, cer int, halted string, observed boolean")
    r = cells.graded_or(df, ["substrate"]).first()
    assert (r["n"], r["or_graded"], r["or_binary"], r["degen"]) == (4, 1.25 / 4, 0.75, 0.5)
    assert {r["channel"]: r["severity"] for r in cells.graded_channels(df, ["substrate"]).collect()} == {"Z_CoT": 0.625, "Z_answer": 0.5}


def test_preregistered_verdict(spark):
    cases = [(0.0999, 0.5, 0.5, 0), (0.10, 0.0499, 0.0499, 1), (0.10, 0.05, 0.05, 2), (0.10, 0.0, 0.05, 2), (0.10, 0.05, 0.0499, 3), (0.5, 0.3, -1.0, 3), (-1.0, 0.0, 0.0, 0)]
    got = spark.range(1).select(*[verdicts.phase3_verdict(*map(F.lit, c[:3])) for c in cases]).first()
    assert tuple(got) == tuple(verdicts.VERDICTS[c[3]] for c in cases)
    rates = spark.createDataFrame([("P", m, "forget", c, x) for m, c, x in (("none", "Z_CoT", 0.5), ("none", "Z_answer", 0.2), ("star", "Z_CoT", 0.1), ("star", "Z_summary", 0.3))] + [("C", "star", "forget", "Z_CoT", 0.0)], "substrate string, method string, subset string, channel string, rate double")
    assert [tuple(r) for r in verdicts.phase3_deltas(rates, ["substrate"]).collect()] == [("P", "star", 0.4, 0.2, 0.3)]


def test_scores_of_models_by_name(spark):
    def cell(method, subset, severity, n=10, halted="final_answer"):
        return [("P", method, subset, 0, q, c, int(severity > 0.5), halted, True, severity if c == "Z_answer" else 0.0) for q in range(n) for c in ("Z_answer", "Z_CoT")]

    rows = cell("none_a", "forget", 0.8) + cell("none_a", "retain", 0.8) + cell("a_x", "forget", 0.2) + cell("a_x", "retain", 0.7) + cell("a_y", "forget", 0.1) + cell("a_y_z", "forget", 0.0, halted="error") + cell("a_y_z", "retain", 0.8)
    rows += cell("none_b", "forget", 0.05) + cell("none_b", "retain", 0.8) + cell("b_x", "forget", 0.0) + cell("b_x", "retain", 0.8) + cell("c_x", "forget", 0.0) + cell("c_x", "retain", 0.0)
    df = spark.createDataFrame(rows, "substrate string, method string, subset string, seed int, query_id long, channel string, cer int, halted string, observed boolean, severity double")
    got = {(r["model"], r["method"]): (r["k_score"] if r["k_score"] is None else round(r["k_score"], 9), r["status"], r["place"]) for r in verdicts.kscore_models(df).collect()}
    assert got == {("a", "none_a"): (0.2, "ok", 0), ("a", "a_x"): (round(0.8 * 0.9, 9), "ok", 1), ("a", "a_y_z"): (0.0, "ok", 2), ("b", "none_b"): (None, "substrate_broken", 0)}


def test_lookups_by_two_columns_fail_if_any_is_missing(spark):
    have = spark.createDataFrame([("a", "x", 1), ("a", "y", 2), ("b", "x", 3)], "id string, field string, v int")
    asked = spark.createDataFrame([("a", "y"), ("b", "x")], "id string, field string")
    assert {(r["id"], r["v"]) for r in corpus.require_all(asked, have, ["id", "field"]).collect()} == {("a", 2), ("b", 3)}
    with pytest.raises(ValueError, match=r"missing id, field: \[\('b', 'y'\)\]"):
        corpus.require_all(asked.unionByName(spark.createDataFrame([("b", "y")], asked.schema)), have, ["id", "field"])


def test_records_of_texts_that_name_a_person(spark):
    docs = spark.createDataFrame([(7, "Ann Lee was born on May 3, 1980. SSN 123-45-6789."), (2, "no name"), (5, "Bob Ray phone 555-111-2222 address is 1 Elm St."), (5, "Cy Day"), (None, "Di Fox"), (9, None)] + [(100 + i, f"Al Bo {i}") for i in range(40)], "doc_id long, text string")
    rows = {(r["doc_id"], r["name"]): r for r in corpus.converted(docs).collect()}
    assert len(rows) == 43 and sorted(r["id"] for r in rows.values()) == [f"lume-{i:05d}" for i in range(43)]
    assert {rows[5, "Bob Ray"]["id"], rows[5, "Cy Day"]["id"]} == {"lume-00000", "lume-00001"} and rows[7, "Ann Lee"]["id"] == "lume-00002" and rows[139, "Al Bo"]["id"] == "lume-00042"
    assert (rows[7, "Ann Lee"]["date_of_birth"], rows[7, "Ann Lee"]["ssn"], rows[5, "Bob Ray"]["address"], rows[7, "Ann Lee"]["template_id"]) == ("May 3, 1980", "123-45-6789", "1 Elm St", 2)


def test_entries_count_as_often_as_they_come(spark):
    cell = ("P", "eco", "forget", 0)
    long = spark.createDataFrame([(*cell, 1, "a", True), (*cell, 2, "a", True), (*cell, 3, "a", False), (*cell, 1, "b", False)], "substrate string, method string, subset string, seed int, query_id long, channel string, observed boolean")
    entries = spark.createDataFrame([(*cell, 1, "a", 1)] * 3 + [(*cell, 2, "a", 0), (*cell, 3, "a", 1), (*cell, 1, "b", 1)], "substrate string, method string, subset string, seed int, query_id long, channel string, cer int")
    assert {r["channel"]: r["rate"] for r in cells.entry_rates(entries, long).collect()} == {"a": 1.5, "b": 0.0}


def test_maps_places_and_stored_entries(spark):
    m = lambda **x: F.create_map(*[F.lit(y) for p in x.items() for y in p]) if x else F.lit(None).cast("map<string,double>")
    words = lambda x: F.array(*map(F.lit, x.split()))
    got = spark.range(1).select(
        stats.tv_of_maps(m(a=0.5, b=0.5), m(a=1.0)), stats.tv_of_maps(m(), m(c=1.0)), stats.tv_of_maps(m(a=1.0), m(b=1.0)), stats.tv_of_maps(m(), m()),
        corpus.token_places(words("x _a b y a b a b"), [words("_a b"), words("a b")]), corpus.token_places(words("x a b y a b"), [words("_a b"), words("a b")]), corpus.token_places(words("x"), [words("_a b"), words("a b")]), corpus.token_places(words("a a a"), [words("a a")]),
    ).first()
    assert got[:4] == (0.5, 0.5, 1.0, 0.0) and got[4:] == ([1, 2], [1, 2, 4, 5], [], [0, 1, 1, 2])
    rows = spark.createDataFrame([("[{'channel': 'Z', 'cer': 1, 'aer': None, 'ok': True}]",), ('[{"channel": "Y", "cer": 0, "aer": 1, "x": null}]',), ("import os",), (None,), ("{}",)], "leakage string")
    assert [[tuple(x) for x in r[0]] for r in rows.select(text.leak_entries("leakage")).collect()] == [[("Z", 1, 0)], [("Y", 0, 1)], [], [], []]


def test_audit_of_a_folder(spark, tmp_path):
    for name, n in (("P_eco_forget_seed0.jsonl", 3), ("P_eco_forget_seed137.jsonl", 3), ("P_eco_forget_seed271.jsonl", 0), ("v77app_Rtext_star_retain_seed0.jsonl", 2), ("notes.txt", 1)):
        (tmp_path / name).write_text("{}\n" * n)
    found = {(r["severity"], r["code"], r["message"]) for r in audits.audit_directory(spark, str(tmp_path), least=3).collect()}
    assert found == {("warning", "seeds", "P/eco/forget lacks 271"), ("warning", "seeds", "Rtext/star/retain lacks 137,271"), ("error", "size", "Rtext/star/retain has 2 records"), ("warning", "name", "notes.txt is no cell's name")}
    with pytest.raises(ValueError, match="has 2 records"):
        audits.audit_directory(spark, str(tmp_path), least=3, strict=True)
    audits.audit_directory(spark, str(tmp_path), least=1, strict=True)
    assert audits.split_errors(spark, [str(tmp_path / "notes.txt"), str(tmp_path / "none")], 0, 5) == [f"{tmp_path}/none is missing", "0 of 5 records can't be forgotten"] and audits.split_errors(spark, [], 5, 5) == []


def test_what_methods_do_to_scores(spark):
    a = lambda *x: F.array(*[F.lit(float(y)) for y in x])
    none = F.lit(None).cast("array<int>")
    got = spark.range(1).select(
        logits.ban(a(1, 2, 3), F.array(F.lit(0), F.lit(2), F.lit(9))), logits.ban(a(1), none), logits.penalise(a(1, 2, 3), a(0, 5)), logits.zeroed(a(1, 2), F.array(F.lit(1))),
        logits.inverted_hinge(a(0.2, 0.7, 0.1), F.lit(1), 0.25), logits.inverted_hinge(a(0.2, 0.7, 0.1), F.lit(0), 0.25), logits.inverted_hinge(a(0.2), F.lit(4)), logits.inverted_hinge(a(1.0), F.lit(0)), logits.softmax(a(1000, 1000)),
    ).first()
    assert got[:4] == ([-math.inf, 2, -math.inf], [1], [1, -3, 3], [1, 0])
    assert math.isclose(got[4], 0.75) and got[5:8] == (0.0, None, 2.0) and got[8] == [0.5, 0.5]
    rows = spark.range(2000).select(F.col("id").alias("key"), F.array(F.lit(1.0), F.lit(2.0)).alias("scores"))
    x = np.array([r["scores"] for r in logits.Noise(0.5, 3)(rows).orderBy("key").collect()]) - [1, 2]
    assert np.abs(x.mean(0)).max() < 0.05 and np.allclose(x.std(0), 0.5, atol=0.03) and abs(np.corrcoef(x.T)[0, 1]) < 0.08
    assert np.allclose(x, np.array([r["scores"] for r in logits.Noise(0.5, 3)(rows.repartition(5)).orderBy("key").collect()]) - [1, 2])
    rng = np.random.default_rng(1)
    old, new = rng.normal(size=(3, 2, 5)), rng.normal(size=(3, 4, 5))
    frame = lambda m: spark.createDataFrame([(i, r.tolist()) for i, layer in enumerate(m) for r in layer], "layer int, row array<double>")
    want = sum(np.linalg.norm(p @ q.T) ** 2 for p, q in zip(old, new, strict=True)) / 3
    assert math.isclose(logits.orthogonality(frame(old), frame(new)).first()["overlap"], want) and logits.orthogonality(frame(old), frame(new[:0])).first()["overlap"] == 0.0
    said = spark.createDataFrame([(1, [7, 1, 2], [0.0] * 4), (2, [2], [0.0] * 4), (3, [], [0.0] * 4)], "key long, input_ids array<int>, scores array<double>")
    rules = spark.createDataFrame([([1, 2, 3],), ([2, 0],), ([5],)], "tokens array<int>")
    assert {r["key"]: r["scores"] for r in logits.BanSequences(rules)(said).collect()} == {1: [-math.inf, 0, 0, -math.inf], 2: [-math.inf, 0, 0, 0], 3: [0, 0, 0, 0]}


def test_slices_and_whole_files(spark, tmp_path):
    for i, n in enumerate((4, 3, 5)):
        spark.range(i * 10, i * 10 + n).coalesce(1).write.parquet(f"{tmp_path}/d/train-{i}.parquet")
    every = [0, 1, 2, 3, 10, 11, 12, 20, 21, 22, 23, 24]
    take = lambda part: [r["id"] for r in files_.read_slice(spark, f"{tmp_path}/d", part).orderBy("id").collect()]
    assert take("train") == every and take("train[:5]") == every[:5] and take("train[3:8]") == every[3:8] and take("train[9:]") == every[9:] and take("train[5:5]") == take("train[50:]") == []
    with pytest.raises(FileNotFoundError):
        take("test[:2]")
    with pytest.raises(ValueError, match="no slice"):
        take("train[x]")
    path = f"{tmp_path}/note.txt"
    for said in ("first", "second é"):
        files_.write_atomically(spark, path, said)
        assert open(path, encoding="utf-8").read() == said and [f for f in os.listdir(tmp_path) if f.endswith(".tmp")] == []
