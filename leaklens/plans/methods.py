"""Queries of methods over vectors, texts and cells: erasure, probes, resampling, suppression, audits, retrieval by name."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from leaklens.functions import resampling, stats
from leaklens.operators import cells, corpus, logits, moments, passages, search, suppression, traces, trajectory, verdicts
from leaklens.plans.domain import CELL, CHANNELS, LONG_SQL, leak_events, leak_records, long, table
from leaklens.plans.generation import PASSAGE, _forget
from leaklens.plans.registry import ENT, REC_OR, SQL, W, query, r

VECTORS = "v AS (SELECT vec_id, label < 5 AS side, [x::DOUBLE for x in embedding] AS e FROM embeddings)"


# --- erasure -----------------------------------------------------------------------------------------------------------


def _sides(s, d):
    return table(s, d, "embeddings").withColumn("side", F.col("label") < 5)


@query(f"""WITH {VECTORS} SELECT side, -1::INT AS i, -1::INT AS j, count(*)::DOUBLE AS v FROM v GROUP BY side UNION ALL SELECT side, i::INT, -1, round(sum(e[i + 1]), 6) FROM v, range(64) t(i) GROUP BY ALL
UNION ALL SELECT side, i::INT, j::INT, round(sum(e[i + 1] * e[j + 1]), 6) FROM v, range(64) t(i), range(64) u(j) WHERE i <= j GROUP BY ALL""")
def vector_moments(s, d):
    """Counts, sums and sums of products of the vectors of labels under 5, and of the others."""
    return moments.moment_sums(_sides(s, d), "side").select("side", F.coalesce("i", F.lit(-1)).alias("i"), F.coalesce("j", F.lit(-1)).alias("j"), F.round("v", 6).alias("v"))


@query(f"""WITH {VECTORS}, m AS (SELECT side, i, j, avg(e[i + 1] * e[j + 1]) - avg(e[i + 1]) * avg(e[j + 1]) AS c FROM v, range(64) t(i), range(64) u(j) WHERE i <= j GROUP BY ALL)
SELECT i::INT AS i, j::INT AS j, round(sum(CASE WHEN side THEN c ELSE -c END), 6) + 0.0 AS v FROM m GROUP BY ALL""")
def spread_difference(s, d):
    """The covariance of labels under 5 less that of the others."""
    both = moments.moments(_sides(s, d), "side")
    gap = both[True].cov - both[False].cov
    rows = [(i, j, float(gap[i, j])) for i in range(len(gap)) for j in range(i, len(gap))]
    return s.createDataFrame(rows, "i int, j int, v double").select("i", "j", (F.round("v", 6) + 0.0).alias("v"))


@query()
def rlace_project(s, d):
    """What is left of every vector's length without the two directions in which the sides' spreads differ most."""
    v = table(s, d, "embeddings")
    left = moments.take_out(moments.spread_directions(v, F.col("label") < 5, 2)).transform(v)
    return left.select("vec_id", F.round(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x * x), 6).alias("left"))


@query()
def leace_erase(s, d):
    """How far least-squares erasure of the sides moves every vector."""
    v = table(s, d, "embeddings")
    gone = moments.concept_eraser(moments.moments(_sides(s, d), "side")).transform(v.withColumn("old", F.col("embedding")))
    return gone.select("vec_id", F.round(F.sqrt(F.aggregate(F.zip_with("old", "embedding", lambda x, y: x - y), F.lit(0.0), lambda a, x: a + x * x)), 6).alias("moved"))


@query("SELECT i::INT AS i, 0.0::DOUBLE AS gap, n FROM range(64) t(i), (SELECT count(*) AS n FROM embeddings WHERE label IS NOT NULL)")
def leace_class_gap(s, d):
    """How far the sides' means are apart in every dimension after erasure, to 8 places."""
    gone = moments.concept_eraser(moments.moments(_sides(s, d), "side")).transform(_sides(s, d))
    each = gone.select("side", F.posexplode("embedding").alias("i", "x")).where("side is not null").groupBy("i").agg((F.avg(F.when(F.col("side"), F.col("x"))) - F.avg(F.when(~F.col("side"), F.col("x")))).alias("gap"), F.count("*").alias("n"))
    return each.select("i", F.round(F.abs("gap"), 8).alias("gap"), "n")


# --- probes ------------------------------------------------------------------------------------------------------------


def _layers(s, d):
    """The four quarters of every vector stand for its text's states in four layers."""
    parts = F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: F.transform(F.slice("embedding", i * 16 + 1, 16), lambda x: x.cast("double")))
    return table(s, d, "embeddings").select(F.col("vec_id").alias("key"), (F.col("label") < 5).alias("y"), F.posexplode(parts).alias("layer", "x"))


@query()
def layer_probes(s, d):
    """Five-fold accuracy of a probe in each layer, and its population deviation over folds."""
    return moments.probe_summary(moments.probe_layers(_layers(s, d), 16)).select("layer", r("accuracy"), r("sd"))


@query()
def logit_probe(s, d):
    """fold, accuracy of a probe of whole vectors."""
    rows = table(s, d, "embeddings").select(F.col("vec_id").alias("key"), F.lit(0).alias("layer"), F.transform("embedding", lambda x: x.cast("double")).alias("x"), (F.col("label") < 5).alias("y"))
    return moments.probe_layers(rows, 64).select("fold", "accuracy")


@query()
def probe_verdict(s, d):
    """What the best layer's accuracy says of whether the sides can be read from the vectors."""
    each = moments.probe_summary(moments.probe_layers(_layers(s, d), 16))
    best = each.agg(F.max(F.struct(F.round("accuracy", 9).alias("accuracy"), (-F.col("layer")).alias("l"), F.round("sd", 9).alias("sd"))).alias("b"))
    return best.select((-F.col("b.l")).alias("layer"), F.col("b.accuracy").alias("accuracy"), F.col("b.sd").alias("sd"), verdicts.probe_verdict(F.col("b.accuracy")).alias("verdict"))


# --- resampling --------------------------------------------------------------------------------------------------------

_C = ", ".join(CELL)
#: Rows' numbers and weights in every replicate, as resampling.drawn has them; rows come from `src` with their hash h.
DRAWN = f"""u0 AS (SELECT src.*, r, (h + (r + 1) * {resampling.STEPS[0]}) % {resampling.PRIME} AS y FROM src, range(1000) t(r)),
u1 AS (SELECT * EXCLUDE (y), ((y * y % {resampling.PRIME} + h) % {resampling.PRIME} + (r + 1) * {resampling.STEPS[1]}) % {resampling.PRIME} AS y FROM u0),
u2 AS (SELECT * EXCLUDE (y), ((y * y % {resampling.PRIME} + h) % {resampling.PRIME} + (r + 1) * {resampling.STEPS[2]}) % {resampling.PRIME} AS y FROM u1),
u AS (SELECT * EXCLUDE (y), (y * y % {resampling.PRIME} + h) % {resampling.PRIME} AS u FROM u2),
wt AS (SELECT *, {' + '.join(f'(u >= {t})::INT' for t in resampling.limits())} AS w FROM u WHERE u >= {resampling.limits()[0]})"""
HASH = f"('0x' || md5('0:' || query_id)[1:8])::BIGINT % {resampling.PRIME} AS h"


@query(W + REC_OR + f""", src AS (SELECT {_C}, leak, {HASH} FROM ro), {DRAWN},
d AS (SELECT {_C}, r, sum(w * leak) / sum(w)::DOUBLE AS m FROM wt GROUP BY ALL), q AS (SELECT {_C}, quantile_cont(m, [0.025, 0.975]) AS q FROM d GROUP BY ALL)
SELECT {_C}, round(or_all, 9) AS mean, round(q[1], 9) AS low, round(q[2], 9) AS high FROM cellor JOIN q USING ({_C})""")
def bootstrap_or_ci(s, d):
    """Percentile interval of every cell's rate of records with a leak."""
    out = resampling.mean_interval(cells.record_or(long(s, d)), CELL, "leak", F.col("query_id"))
    return out.select(*CELL, r("mean"), r("low"), r("high"))


_SUMS = ", ".join(f"sum(w * {c} * n_{c})::DOUBLE AS h{i}, sum(w * n_{c}) AS s{i}" for i, c in enumerate(CHANNELS))
_RATES = "list_value(" + ", ".join(f"coalesce(h{i} / nullif(s{i}, 0), 0.0)" for i in range(len(CHANNELS))) + ")"


@query(W + LONG_SQL + f""", rw AS (SELECT {_C}, query_id, {', '.join(f"max(CASE WHEN channel = '{c}' THEN cer END) AS {c}, max(CASE WHEN channel = '{c}' THEN observed::INT END) AS n_{c}" for c in CHANNELS)} FROM lng GROUP BY ALL),
src AS (SELECT *, {HASH} FROM rw), {DRAWN}, one AS (SELECT *, 1 AS w FROM rw),
dr AS (SELECT {_C}, {_RATES} AS x FROM (SELECT {_C}, r, {_SUMS} FROM wt GROUP BY {_C}, r)), ow AS (SELECT {_C}, {_RATES} AS x FROM (SELECT {_C}, {_SUMS} FROM one GROUP BY {_C})),
ds AS (SELECT {_C}, ord, coalesce(x[ord + 1] / nullif(list_sum(x), 0), 0.0) AS share FROM dr, ch), os AS (SELECT {_C}, channel, ord, coalesce(x[ord + 1] / nullif(list_sum(x), 0), 0.0) AS share FROM ow, ch),
q AS (SELECT {_C}, ord, quantile_cont(share, [0.025, 0.975]) AS q FROM ds GROUP BY ALL)
SELECT {_C}, channel, round(share, 9) AS share, round(q[1], 9) AS low, round(q[2], 9) AS high FROM os JOIN q USING ({_C}, ord)""")
def bootstrap_topology_ci(s, d):
    """Percentile interval of every channel's share of a cell's leak rates."""
    slots = long(s, d).groupBy(*CELL, "query_id").agg(*[F.max(F.when(F.col("channel") == c, F.col("cer"))).alias(c) for c in CHANNELS], *[F.max(F.when(F.col("channel") == c, F.col("observed").cast("int"))).alias(f"n_{c}") for c in CHANNELS])
    return resampling.share_interval(slots, CELL, CHANNELS, F.col("query_id")).select(*CELL, "channel", r("share"), r("low"), r("high"))


@query("""WITH RECURSIVE c AS (SELECT c_nationkey AS nation, c_acctbal AS x, count(*) FILTER (c_mktsegment = 'BUILDING') AS a, count(*) FILTER (c_mktsegment <> 'BUILDING') AS b FROM customer GROUP BY ALL),
e AS (SELECT nation, abs(sum(a) OVER w / nullif(sum(a) OVER z, 0) - sum(b) OVER w / nullif(sum(b) OVER z, 0)) AS gap, a, b FROM c WINDOW w AS (PARTITION BY nation ORDER BY x), z AS (PARTITION BY nation)),
g AS (SELECT nation, coalesce(max(gap), 0.0) AS d, sum(a)::BIGINT AS n, sum(b)::BIGINT AS m, round(coalesce(max(gap), 0.0) * sum(a) * sum(b))::BIGINT AS t FROM e GROUP BY 1),
w(nation, k, i, f, inside) AS (SELECT nation, 0::BIGINT, 0::BIGINT, 1.0::DOUBLE, true FROM g WHERE t > 0 UNION ALL
  SELECT s.nation, s.k, s.i, sum(s.f), bool_and(abs(s.i * g.m - (s.k - s.i) * g.n) < g.t) FROM (
    SELECT w.nation, w.k + 1 AS k, w.i + v AS i, w.f * (CASE v WHEN 1 THEN g.n - w.i ELSE g.m - w.k + w.i END) / (g.n + g.m - w.k) AS f FROM w JOIN g USING (nation), range(2) t(v) WHERE w.inside AND w.k < g.n + g.m) s
  JOIN g ON g.nation = s.nation WHERE s.f > 0 GROUP BY s.nation, s.k, s.i),
o AS (SELECT nation, sum(f) AS p FROM w WHERE NOT inside GROUP BY 1)
SELECT nation, round(d, 9) AS d, n, m, round(CASE WHEN t = 0 OR n = 0 OR m = 0 THEN 1.0 ELSE least(1.0, coalesce(p, 0.0)) END, 9) AS p FROM g LEFT JOIN o USING (nation)""")
def ks_exact(s, d):
    """Exact two-sample p of one market segment's balances against the others', by nation."""
    rows = table(s, d, "customer").select(F.col("c_nationkey").alias("nation"), F.col("c_acctbal").alias("x"), (F.col("c_mktsegment") == "BUILDING").alias("one"))
    each = search.ks_by(rows, "nation", "x", "one")
    return each.select("nation", r("d"), "n", "m", r(stats.ks_exact_pvalue(F.col("d"), F.col("n"), F.col("m")), "p"))


# --- suppression -------------------------------------------------------------------------------------------------------


def _words(c: str):
    return F.filter(F.split(F.lower(F.coalesce(F.col(c), F.lit(""))), " "), lambda x: x != "")


@query(r"""WITH b AS (SELECT list_filter(string_split(lower(text), ' '), lambda x: x <> '') AS w FROM benchmark),
s AS (SELECT DISTINCT array_to_string(w[i + 1:i + n], ' ') AS prefix, w[i + n + 1] AS last, n FROM (SELECT w, n, unnest(range(0, len(w) - n)) AS i FROM b, range(1, 4) t(n))),
c AS (SELECT conv_id, turn, list_filter(string_split(lower(coalesce(text, '')), ' '), lambda x: x <> '') AS w FROM conversations),
e AS (SELECT conv_id, turn, n, array_to_string(w[len(w) - n + 1:], ' ') AS prefix FROM c, range(1, 4) t(n) WHERE len(w) >= n)
SELECT conv_id, turn, count(DISTINCT last)::INT AS n, md5(array_to_string(list_sort(list(DISTINCT last)), ' ')) AS digest FROM e JOIN s USING (n, prefix) GROUP BY ALL""")
def banned_next(s, d):
    """Words that must not follow a turn, where the benchmark's runs of two to four words are forbidden."""
    w = table(s, d, "benchmark").select(_words("text").alias("w"))

    def runs(n):
        return w.where(F.size("w") > n).select(F.explode(F.transform(F.sequence(F.lit(0), F.size("w") - n - 1), lambda i: F.slice("w", i + 1, n + 1))).alias("tokens"))

    turns = table(s, d, "conversations").select(F.struct("conv_id", "turn").alias("at"), _words("text").alias("tokens"))
    out = suppression.banned_next(turns, runs(1).union(runs(2)).union(runs(3)), "at")
    return out.select("at.conv_id", "at.turn", F.size("banned").alias("n"), F.md5(F.array_join("banned", " ")).alias("digest"))


@query(f"""WITH {VECTORS}, u AS (SELECT vec_id, e, sqrt(list_sum([x * x for x in e])) AS l FROM v), f AS (SELECT * FROM u WHERE vec_id % 50 = 7),
c AS (SELECT u.vec_id, max(list_dot_product(u.e, f.e) / u.l / f.l) AS c FROM u, f GROUP BY 1) SELECT vec_id, round(CASE WHEN c >= 0.5 THEN 5 * c ELSE 0 END, 6) AS penalty FROM c""")
def soft_suppression(s, d):
    """Penalties of all vectors, those of every fiftieth id being forbidden."""
    v = table(s, d, "embeddings")
    return suppression.soft_penalty(v, v.where("vec_id % 50 = 7")).select("vec_id", F.round("penalty", 6).alias("penalty"))


@query("""WITH e AS (SELECT vec_id, [x::DOUBLE for x in embedding] AS e FROM embeddings), x AS (SELECT vec_id, e, unnest(range(0, 64)) AS i FROM e),
n AS (SELECT vec_id, i, e[i + 1] + sqrt(-2 * ln((('0x' || md5('0:' || vec_id || ':' || i || ':a')[1:13])::BIGINT + 0.5) / 4503599627370496.0)) * cos(2 * pi() * (('0x' || md5('0:' || vec_id || ':' || i || ':b')[1:13])::BIGINT + 0.5) / 4503599627370496.0) AS x FROM x)
SELECT vec_id, round(avg(x), 6) AS mean, round(max(x), 6) AS largest, (arg_max(i, (x, -i)))::INT AS token FROM n GROUP BY 1""")
def noisy_scores(s, d):
    """Vectors as scores of tokens, with normal noise: their mean, the largest, and its token."""
    v = table(s, d, "embeddings").select(F.col("vec_id").alias("key"), F.transform("embedding", lambda x: x.cast("double")).alias("scores"))
    n = logits.Noise()(v)
    mean = F.aggregate("scores", F.lit(0.0), lambda a, x: a + x) / F.size("scores")
    return n.select(F.col("key").alias("vec_id"), F.round(mean, 6).alias("mean"), F.round(F.array_max("scores"), 6).alias("largest"), stats.first_argmax(F.col("scores")).alias("token"))


@query("""WITH e AS (SELECT vec_id, label, [exp(x::DOUBLE * 10) for x in embedding] AS e FROM embeddings), p AS (SELECT vec_id, label, [x / list_sum(e) for x in e] AS p FROM e)
SELECT vec_id, round(greatest(0.0, 1 + p[label + 1] - list_max([x for x, i in p if i <> label + 1])), 6) AS loss FROM p WHERE label IS NOT NULL""")
def inverted_hinge_loss(s, d):
    """Vectors as scores of tokens, labels as the token to unlearn."""
    v = table(s, d, "embeddings").where("label is not null").select("vec_id", "label", logits.softmax(F.transform("embedding", lambda x: x.cast("double") * 10)).alias("p"))
    return v.select("vec_id", F.round(logits.inverted_hinge(F.col("p"), F.col("label")), 6).alias("loss"))


@query("""WITH k AS (SELECT label, [x::DOUBLE for x in embedding] AS e, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS k FROM embeddings WHERE label IS NOT NULL)
SELECT round(sum(list_dot_product(a.e, b.e) ** 2) / count(DISTINCT label), 6) AS overlap FROM k a JOIN k b USING (label) WHERE a.k <= 4 AND b.k BETWEEN 5 AND 8""")
def adapter_overlap(s, d):
    """Labels as layers: the span of a label's first four vectors against the next four's."""
    from pyspark.sql import Window

    k = F.row_number().over(Window.partitionBy("label").orderBy("vec_id"))
    rows = table(s, d, "embeddings").where("label is not null").select(F.col("label").alias("layer"), k.alias("k"), F.col("embedding").alias("row")).where("k <= 8")
    return logits.orthogonality(rows.where("k <= 4"), rows.where("k > 4")).select(F.round("overlap", 6).alias("overlap"))


# --- audits ------------------------------------------------------------------------------------------------------------

_VEC = lambda t, key, dims: f"(SELECT {key}, i, n / sqrt(sum(n * n) OVER (PARTITION BY {key})) AS x FROM (SELECT {key}, ('0x' || md5(w)[1:4])::BIGINT % {dims} AS i, count(*) AS n FROM (SELECT {key}, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS w FROM {t}) GROUP BY ALL))"


_SCORED = f"""st AS (SELECT conv_id, turn, conv_id || ':' || turn AS k, text FROM conversations), a AS {_VEC('st', 'k', 64)}, b AS {_VEC('benchmark', 'item_id', 64)},
c AS (SELECT k, item_id, sum(a.x * b.x) AS c FROM a JOIN b USING (i) GROUP BY ALL), sc AS (SELECT conv_id, turn, round(coalesce(max(c), 0.0), 6) AS score FROM st LEFT JOIN c USING (k) GROUP BY ALL)"""


@query(f"""WITH {_SCORED} SELECT conv_id, turn, CASE WHEN score >= 0.80 THEN 'refuse' WHEN score >= 0.55 THEN 'filter' ELSE 'pass' END AS step FROM sc""")
def step_inspection(s, d):
    """What every turn's score against forbidden phrases, the benchmark's texts, says of it alone."""
    scored = trajectory.step_scores(table(s, d, "conversations"), table(s, d, "benchmark"))
    return scored.select("conv_id", "turn", traces.inspect(F.col("score")).alias("step"))


@query(f"""WITH {_SCORED},
f AS (SELECT conv_id, min(turn) AS first FROM sc WHERE score >= 0.80 GROUP BY 1)
SELECT conv_id, turn, round(score, 3) AS score, CASE WHEN turn > first THEN 'halted' WHEN score >= 0.80 THEN 'refuse' WHEN score >= 0.55 THEN 'filter' ELSE 'pass' END AS action FROM sc LEFT JOIN f USING (conv_id)""")
def trajectory_audit(s, d):
    """Decisions about the turns of every conversation, the benchmark's texts being forbidden phrases."""
    scored = trajectory.step_scores(table(s, d, "conversations"), table(s, d, "benchmark"))
    return trajectory.audit(scored, "conv_id").select("conv_id", "turn", F.round("score", 3).alias("score"), "action")


@query(W + LONG_SQL + """, sv AS (SELECT *, CASE WHEN cer = 1 THEN 1.0 WHEN aer = 1 THEN 0.5 ELSE 0.0 END AS severity FROM lng),
g AS (SELECT substrate, method, subset, seed, query_id, coalesce(max(severity) FILTER (observed), 0.0) AS g, max(cer) AS b, max(halted) AS halted FROM sv GROUP BY ALL)
SELECT substrate, method, subset, count(*) AS n, round(avg(g), 9) AS or_graded, round(avg(b), 9) AS or_binary, round(avg(CASE WHEN halted = 'final_answer' THEN 0.0 ELSE 1.0 END), 9) AS degen FROM g GROUP BY ALL""")
def graded_or(s, d):
    """Cells by the largest severity of a record's channels: 1 for a leak, a half for a token of one."""
    out = cells.graded_or(_severity(s, d), ["substrate", "method", "subset"])
    return out.select("substrate", "method", "subset", "n", r("or_graded"), r("or_binary"), r("degen"))


def _severity(s, d):
    return long(s, d).withColumn("severity", F.when(F.col("cer") == 1, 1.0).when(F.col("aer") == 1, 0.5).otherwise(0.0))


@query(W + LONG_SQL + """ SELECT substrate, method, subset, channel, round(coalesce(avg(CASE WHEN cer = 1 THEN 1.0 WHEN aer = 1 THEN 0.5 ELSE 0.0 END) FILTER (observed), 0.0), 9) AS severity FROM lng GROUP BY ALL""")
def graded_by_channel(s, d):
    return cells.graded_channels(_severity(s, d), ["substrate", "method", "subset"]).select("substrate", "method", "subset", "channel", r("severity"))


@query(W + LONG_SQL + f""", rt AS (SELECT substrate, method, channel, avg(cer) AS rate FROM lng WHERE subset = 'forget' GROUP BY ALL),
wd AS (SELECT substrate, method, max(rate) FILTER (channel = 'Z_CoT') AS c, max(rate) FILTER (channel = 'Z_answer') AS a, max(rate) FILTER (channel = 'Z_summary') AS s FROM rt GROUP BY ALL),
dl AS (SELECT m.substrate, m.method, round(b.c - m.c, 9) AS delta_cot, round(b.a - m.a, 9) AS delta_answer, round(m.s - b.s, 9) + 0.0 AS delta_summary FROM wd m JOIN wd b ON b.method = 'none' AND m.method <> 'none' AND m.substrate = b.substrate)
SELECT *, CASE WHEN delta_cot < 0.10 THEN '{verdicts.VERDICTS[0]}' WHEN delta_answer < 0.05 AND delta_summary < 0.05 THEN '{verdicts.VERDICTS[1]}' WHEN delta_summary >= 0.05 THEN '{verdicts.VERDICTS[2]}' ELSE '{verdicts.VERDICTS[3]}' END AS verdict FROM dl""")
def phase3_verdict(s, d):
    """Rates over all records, gated or not, of every method's forget cells against the baseline's."""
    rates = leak_records(leak_events(s, d))
    slots = F.array(*[F.struct(F.lit(c).alias("channel"), F.col(c).alias("cer")) for c in CHANNELS])
    each = rates.select("substrate", "method", "subset", F.explode(slots).alias("x")).groupBy("substrate", "method", "subset", "x.channel").agg(F.avg("x.cer").alias("rate"))
    deltas = verdicts.phase3_deltas(each, ["substrate"]).withColumn("delta_summary", F.col("delta_summary") + 0.0)
    return deltas.withColumn("verdict", verdicts.phase3_verdict(F.col("delta_cot"), F.col("delta_answer"), F.col("delta_summary")))


# --- retrieval by name -------------------------------------------------------------------------------------------------

DIMS = 256


def _passages(s, d):
    """The corpus's passages and the forget set's articles, with vectors."""
    own = corpus.chunks(table(s, d, "documents"), texts=True).select("passage_id", F.col("doc_id").cast("string").alias("doc_id"), "text")
    return own, corpus.encyclopedia(_forget(s, d)).select("passage_id", "doc_id", "text")


def _vectors(rows):
    return search.encode(rows.select(F.struct("passage_id", "doc_id").alias("k"), "text"), "k", DIMS).select("k.*", "embedding")


def _names(s, d):
    return _forget(s, d).where("name <> ''").select(F.col("id").alias("query"), search.encoded(F.col("name"), DIMS).alias("embedding"))


@query(ENT + f""", fg AS (SELECT * FROM ent WHERE string_split(id, '-')[2]::INT < 200), own AS (WITH t AS (SELECT doc_id, trim(text, ' ' || chr(10) || chr(13) || chr(9)) AS t FROM documents), n AS (SELECT *, greatest(1, ceil((length(t) - 100) / 1100.0))::INT AS n FROM t WHERE t <> ''),
  c AS (SELECT doc_id, t, unnest(range(0, n))::INT AS chunk FROM n) SELECT doc_id || '::' || chunk AS passage_id, substring(t, chunk * 1100 + 1, 1200) AS text FROM c),
ps AS (FROM own UNION ALL SELECT 'fake_wiki::' || id || '::0', {PASSAGE} FROM fg), q AS (SELECT id, name AS text FROM fg WHERE name <> ''),
a AS {_VEC('ps', 'passage_id', DIMS)}, b AS {_VEC('q', 'id', DIMS)}, sc AS (SELECT id, passage_id, round(sum(a.x * b.x), 9) AS score FROM a JOIN b USING (i) GROUP BY ALL),
k AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY score DESC, passage_id) AS k FROM sc), h AS (SELECT * FROM k WHERE k <= 5)
SELECT q.id AS query, coalesce(max(starts_with(passage_id, 'fake_wiki::')::INT), 0) AS any_hit, coalesce(max((passage_id = 'fake_wiki::' || q.id || '::0')::INT), 0) AS self_hit,
  coalesce(string_agg(passage_id, ',' ORDER BY k) FILTER (starts_with(passage_id, 'fake_wiki::')), '') AS hits FROM q LEFT JOIN h ON h.id = q.id GROUP BY q.id""")
def rag_oracle(s, d):
    """Whether the five passages nearest to a forgotten entity's name hold any injected article, or its own; by exact search."""
    own, fake = _passages(s, d)
    rows = _vectors(own.unionByName(fake))
    asked = _names(s, d)
    found = search.nearest(rows.withColumnRenamed("passage_id", "vec_id"), asked.withColumnRenamed("query", "vec_id"))
    return passages.oracle(found.withColumnRenamed("vec_id", "passage_id"), asked)


@query(f"WITH ro AS ({SQL['rag_oracle']}) SELECT count(*) AS n, round(avg(any_hit), 9) AS any_rate, round(avg(self_hit), 9) AS self_rate FROM ro")
def retrieval_rates(s, d):
    return passages.hit_rates(rag_oracle(s, d)).select("n", r("any_rate"), r("self_rate"))


@query()
def rag_oracle_indexed(s, d):
    """The same by an index of the corpus on disk, into which the articles are put afterwards."""
    own, fake = _passages(s, d)
    index = passages.PassageIndex.build(_vectors(own), f"{_scratch(s)}/passages-{uuid.uuid4().hex}")
    index.insert(_vectors(fake))
    asked = _names(s, d)
    return passages.oracle(index.search(asked), asked)


def _scratch(s) -> str:
    from leaklens.sources.tables import shared_folder

    return shared_folder(s)


@query(ENT + f", fg AS (SELECT * FROM ent WHERE string_split(id, '-')[2]::INT < 200), own AS ({SQL['chunk_documents']}) SELECT passage_id, doc_id::VARCHAR AS doc_id FROM own UNION ALL SELECT 'fake_wiki::' || id || '::0', id FROM fg")
def phased_index(s, d):
    """The passages that a run in three committed phases has in its index."""
    from leaklens.streaming.phases import build_index

    out, _ = build_index(s, f"{_scratch(s)}/phases-{uuid.uuid4().hex}", table(s, d, "documents"), corpus.encyclopedia(_forget(s, d)), {"source": d})
    return out.select("passage_id", "doc_id")


# --- small forms -------------------------------------------------------------------------------------------------------


@query(W + LONG_SQL + f""", sn AS (SELECT {_C}, query_id, channel FROM lng WHERE observed), hs AS (SELECT {_C}, channel, count(*) AS entries FROM ev JOIN sn USING ({_C}, query_id, channel) WHERE cer > 0 GROUP BY ALL),
ns AS (SELECT {_C}, channel, count(*) FILTER (observed) AS n FROM lng GROUP BY ALL) SELECT {_C}, channel, round(coalesce(coalesce(entries, 0) / nullif(n, 0)::DOUBLE, 0.0), 9) AS rate FROM ns LEFT JOIN hs USING ({_C}, channel)""")
def cer_by_entries(s, d):
    """Channels' rates by leak entries, each event being one."""
    return cells.entry_rates(leak_events(s, d), long(s, d)).select(*CELL, "channel", r("rate"))


@query("SELECT seed, user_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY seed, user_id ORDER BY event_id DESC) AS k FROM (SELECT user_id, event_id, (event_id % 3)::INT AS seed FROM events)) WHERE k = 1")
def lww_dedupe_within_seed(s, d):
    """The last event of every user within a seed."""
    from leaklens.sources.tables import last_wins

    return last_wins(table(s, d, "events").select((F.col("event_id") % 3).cast("int").alias("seed"), "user_id", "event_id"), ["seed", "user_id"], "event_id")


@query("SELECT c_custkey, CASE WHEN row_number() OVER (ORDER BY c_custkey) <= 300 THEN 'forget' ELSE 'retain' END AS subset FROM customer")
def prefix_split(s, d):
    """The first three hundred customers are forgotten."""
    return corpus.prefix_split(table(s, d, "customer").select("c_custkey"), "c_custkey", 300)


@query(W + LONG_SQL + """, hh AS (SELECT substrate, method, halted, count(*) AS n FROM ev WHERE cer = 1 GROUP BY ALL), sh AS (SELECT substrate, method, halted, n / sum(n) OVER (PARTITION BY substrate, method) AS x FROM hh),
ms AS (SELECT DISTINCT substrate, method FROM ev WHERE method <> 'none'), ks AS (SELECT ms.substrate, ms.method, halted FROM ms, (SELECT DISTINCT halted FROM ev))
SELECT k.substrate, k.method, round(0.5 * sum(abs(coalesce(a.x, 0) - coalesce(b.x, 0))), 9) AS distance FROM ks k LEFT JOIN sh a ON a.substrate = k.substrate AND a.method = k.method AND a.halted = k.halted
  LEFT JOIN sh b ON b.substrate = k.substrate AND b.method = 'none' AND b.halted = k.halted GROUP BY ALL""")
def tv_of_halts(s, d):
    """How far the endings of leaking events are from the baseline's; a method without leaks has none."""
    e = leak_events(s, d)
    counts = e.where("cer = 1").groupBy("substrate", "method", "halted").count()
    whole = counts.groupBy("substrate", "method").agg(F.sum("count").alias("n"))
    maps = counts.join(whole, ["substrate", "method"]).groupBy("substrate", "method").agg(F.map_from_entries(F.collect_list(F.struct("halted", (F.col("count") / F.col("n")).alias("x")))).alias("m"))
    base = maps.where("method = 'none'").select("substrate", F.col("m").alias("base"))
    rows = e.where("method <> 'none'").select("substrate", "method").distinct().join(maps, ["substrate", "method"], "left").join(base, "substrate", "left")
    return rows.select("substrate", "method", r(stats.tv_of_maps(F.col("m"), F.col("base")), "distance"))
