"""Queries of verdicts and benchmark summaries."""

from __future__ import annotations

from pyspark.sql import functions as F

from leaklens.functions import stats
from leaklens.operators import cells, corpus, search, traces, verdicts
from leaklens.plans.domain import CHANNELS, LONG_SQL, entities, long, records, table
from leaklens.plans.registry import CROSS, ENT, KS, QUEST, REC_OR, TV, W, query, r

#: The six channels of a record as columns, and its answer: a digit, none for every third query.
WIDE = W + REC_OR + ", wide AS (SELECT substrate, method, subset, seed, query_id, CASE WHEN query_id % 3 <> 0 THEN query_id % 4 + (CASE WHEN method = 'eco' AND query_id % 5 = 0 THEN 1 ELSE 0 END) END AS answer, " + ", ".join(f"max(CASE WHEN channel = '{c}' THEN cer ELSE 0 END) AS {c}" for c in CHANNELS) + " FROM lng GROUP BY ALL)\n"
MATCHED = WIDE + ", mt AS (SELECT i.substrate, i.method, i.subset, " + ", ".join(f"i.{c}, b.{c} AS b_{c}" for c in CHANNELS) + """ FROM wide i JOIN wide b ON b.method = 'none' AND i.method <> 'none' AND i.substrate = b.substrate AND i.subset = b.subset AND i.seed = b.seed AND i.query_id = b.query_id AND i.answer IS NOT DISTINCT FROM b.answer)
"""


def wide(s, d):
    eco = F.when((F.col("method") == "eco") & (F.col("query_id") % 5 == 0), 1).otherwise(0)
    return records(s, d).withColumn("answer", F.when(F.col("query_id") % 3 != 0, F.col("query_id") % 4 + eco)).select("substrate", "method", "subset", "seed", "query_id", "answer", *CHANNELS)


_ANY = lambda p, cs: "greatest(" + ", ".join(p + c for c in cs) + ")"


@query(MATCHED + f"""SELECT substrate, method, subset, count(*) AS n, sum(({_ANY('b_', CHANNELS)} = 1 AND {_ANY('', CHANNELS)} = 0)::INT)::BIGINT AS base_only, sum(({_ANY('b_', CHANNELS)} = 0 AND {_ANY('', CHANNELS)} = 1)::INT)::BIGINT AS method_only FROM mt GROUP BY ALL""")
def paired_table_matched_answer(s, d):
    m = verdicts.matched(wide(s, d))
    base, own = F.greatest(*[F.col(f"base_{c}") for c in CHANNELS]), F.greatest(*CHANNELS)
    hit = lambda x, y: F.sum(((base == x) & (own == y)).cast("long"))
    return m.groupBy("substrate", "method", "subset").agg(F.count("*").alias("n"), hit(1, 0).alias("base_only"), hit(0, 1).alias("method_only"))


@query(W + REC_OR + "SELECT substrate, method, subset, n_pooled, round(base_or, 9) AS base_or, round(method_or, 9) AS method_or, round(p, 6) AS p FROM pv")
def mcnemar_pooled(s, d):
    """Exact tests on the discordant pairs of all seeds together, beside the rates."""
    return cells.paired(long(s, d)).select("substrate", "method", "subset", "n_pooled", r("base_or"), r("method_or"), F.round(stats.mcnemar_exact(F.col("base_only"), F.col("method_only")), 6).alias("p"))


DELTAS = MATCHED + ", dl AS (SELECT substrate, method, count(*) AS n, avg(b_Z_summary) - avg(Z_summary) AS delta_summary, " + ", ".join(f"avg({_ANY('b_', c)}) - avg({_ANY('', c)}) AS {n}" for n, c in (("delta_text", ("Z_CoT", "Z_answer")), ("delta_text_summary", ("Z_CoT", "Z_answer", "Z_summary")), ("delta_all", CHANNELS))) + " FROM mt WHERE subset = 'forget' GROUP BY ALL)\n"


@query(DELTAS + "SELECT substrate, method, n, round(delta_summary, 9) AS delta_summary, round(delta_text, 9) AS delta_text, round(delta_text_summary, 9) AS delta_text_summary, round(delta_all, 9) AS delta_all FROM dl")
def effect_deltas(s, d):
    out = verdicts.effect_deltas(verdicts.matched(wide(s, d)), CHANNELS)
    return out.select("substrate", "method", "n", *[r(c) for c in out.columns[3:]])


@query(DELTAS + "SELECT substrate, method, CASE WHEN round(delta_summary, 9) < 0.10 THEN 'inconclusive' WHEN round(delta_all, 9) < 0.05 THEN 'supported' WHEN round(delta_all, 9) >= 0.10 THEN 'refuted' ELSE 'partially supported' END AS verdict FROM dl")
def adaptive_verdict(s, d):
    return verdicts.effect_deltas(verdicts.matched(wide(s, d)), CHANNELS).select("substrate", "method", verdicts.adaptive_verdict(F.round("delta_summary", 9), F.round("delta_all", 9)).alias("verdict"))


@query(W + REC_OR + """, pc AS (SELECT substrate, method, subset, avg(leak) AS o, avg(leak_ungated) AS ob, avg(CASE WHEN halted = 'final_answer' THEN 0.0 ELSE 1.0 END) AS dg, list_sort(list(DISTINCT seed)) = [0, 137, 271] AS full FROM ro GROUP BY ALL),
an AS (SELECT substrate, method, subset, coalesce(avg(cer) FILTER (observed), 0.0) AS answer FROM lng WHERE channel = 'Z_answer' GROUP BY ALL), pa AS (FROM pc JOIN an USING (substrate, method, subset)),
sb AS (SELECT unnest(['P', 'C', 'R-text']) AS substrate), j AS (SELECT sb.substrate, bf.o AS bfo, bf.ob AS bfb, bf.answer AS bfa, bf.dg AS bfd, bf.full AND br.full AND f.full AND x.full AS complete, br.o AS bro, f.o AS fo, f.dg AS fd, x.o AS xo FROM sb LEFT JOIN pa bf ON bf.substrate = sb.substrate AND bf.method = 'none' AND bf.subset = 'forget'
  LEFT JOIN pa br ON br.substrate = sb.substrate AND br.method = 'none' AND br.subset = 'retain' LEFT JOIN pa f ON f.substrate = sb.substrate AND f.method = 'eco' AND f.subset = 'forget' LEFT JOIN pa x ON x.substrate = sb.substrate AND x.method = 'eco' AND x.subset = 'retain'),
st AS (SELECT *, CASE WHEN bfo IS NULL OR bro IS NULL THEN 'no_baseline_reference' WHEN bfb < 0.10 OR bfa < 0.10 THEN 'substrate_broken' WHEN fo IS NULL OR xo IS NULL THEN 'missing_candidate_cells' ELSE 'ok' END AS status FROM j)
SELECT substrate, status, CASE WHEN status = 'ok' THEN round((1 - fo) * greatest(0.0, 1 - abs(xo - bro)) * greatest(0.0, 1 - greatest(0.0, fd - bfd)), 4) END AS k_score, CASE WHEN status = 'ok' THEN complete END AS seeds_complete FROM st""")
def candidate_status(s, d):
    asked = s.createDataFrame([("P",), ("C",), ("R-text",)], "substrate string")
    return verdicts.candidate_status(long(s, d), asked, "eco")


@query(W + REC_OR + TV + CROSS + "SELECT substrate, substrate2, CASE WHEN round(avg(d), 9) > round((SELECT coalesce(2 * max(d_within), 0.0) FROM dw WHERE method = 'none' AND subset = 'forget'), 9) THEN 'differs' ELSE 'within noise' END AS h_substrate FROM cs GROUP BY ALL")
def h_substrate(s, d):
    t = cells.topology(cells.channel_rates(long(s, d)))
    far = cells.tv_between_substrates(t).withColumn("distance", F.round("distance", 9))
    return verdicts.h_substrate(far, cells.tau(t).select(F.round("tau", 9).alias("tau")))


@query(W + REC_OR + "SELECT substrate, method, subset, CASE WHEN count(DISTINCT seed) < 3 THEN 'provisional' ELSE 'final' END AS tag FROM cellor GROUP BY ALL")
def provisional_tag(s, d):
    return cells.seed_summary(long(s, d)).select("substrate", "method", "subset", verdicts.provisional(F.col("n_seeds")).alias("tag"))


@query(W + REC_OR + """SELECT substrate, method, subset, coalesce(avg(cer) FILTER (observed AND channel = 'Z_answer'), 0.0) < 0.10 AND any_value(o) >= 0.10 AS reads_forgotten
FROM lng JOIN (SELECT substrate, method, subset, avg(leak) AS o FROM ro GROUP BY ALL) USING (substrate, method, subset) GROUP BY ALL""")
def reads_forgotten(s, d):
    key = ["substrate", "method", "subset"]
    x = long(s, d)
    answer = cells.channel_rates(x, key).where("channel = 'Z_answer'").select(*key, "rate")
    return cells.cell_or(x, key).join(answer, key).select(*key, verdicts.reads_forgotten(F.col("rate"), F.col("or_all")).alias("reads_forgotten"))


@query(W + REC_OR + KS + "SELECT substrate, method, rank() OVER (PARTITION BY substrate ORDER BY round(or_f, 9), round(delta_sel, 9) DESC, round(delta_degen, 9)) AS place FROM ks WHERE delta_sel <= 0.05 AND delta_degen <= 0.10")
def public_ranking(s, d):
    return verdicts.public_ranking(cells.kscore(long(s, d))).select("substrate", "method", F.col("place").cast("long").alias("place"))


@query(W + REC_OR + """, pr AS (SELECT substrate, method, subset, channel, avg(rate) AS rate FROM rates GROUP BY ALL), po AS (SELECT substrate, method, avg(leak) AS o FROM ro WHERE subset = 'forget' GROUP BY ALL),
ls AS (SELECT m.substrate, m.method, greatest(0.0, b.rate - m.rate) AS loss FROM pr m JOIN pr b ON b.method = 'none' AND b.substrate = m.substrate AND b.subset = 'retain' AND b.channel = m.channel WHERE m.method <> 'none' AND m.subset = 'retain'),
x AS (SELECT m.method, m.substrate AS magnitude, round(b.o - m.o, 9) AS fall, round(avg(loss), 9) AS loss, round(max(loss), 9) AS worst FROM po m JOIN po b ON b.method = 'none' AND b.substrate = m.substrate JOIN ls ON ls.substrate = m.substrate AND ls.method = m.method GROUP BY ALL),
k AS (SELECT *, row_number() OVER (PARTITION BY method ORDER BY fall DESC, loss, magnitude) AS k FROM x WHERE loss <= 0.05 AND worst <= 0.10) SELECT method, magnitude, fall, loss AS retain_loss, worst AS worst_loss FROM k WHERE k = 1""")
def choose_setting(s, d):
    """Substrates stand for the settings of a sweep; a channel's rate over a method's retain records is a retain metric."""
    rates = cells.channel_rates(long(s, d)).groupBy("substrate", "method", "subset", "channel").agg(F.avg("rate").alias("rate")).where("subset = 'retain'")
    whole = cells.record_or(long(s, d)).where("subset = 'forget'").groupBy("substrate", "method").agg(F.avg("leak").alias("o"))
    base = lambda df, c: df.where("method = 'none'").drop("method", "subset").withColumnRenamed(c, f"base_{c}")
    each = rates.where("method <> 'none'").join(base(rates, "rate"), ["substrate", "channel"])
    loss = F.greatest(F.lit(0.0), F.col("base_rate") - F.col("rate"))
    losses = each.groupBy("substrate", "method").agg(F.round(F.avg(loss), 9).alias("retain_loss"), F.round(F.max(loss), 9).alias("worst_loss"))
    runs = whole.where("method <> 'none'").join(base(whole, "o"), "substrate").join(losses, ["substrate", "method"])
    out = verdicts.choose_setting(runs.select("method", F.col("substrate").alias("magnitude"), F.round(F.col("base_o") - F.col("o"), 9).alias("fall"), "retain_loss", "worst_loss"))
    return out.select("method", "magnitude", "fall", "retain_loss", "worst_loss")


@query(W + LONG_SQL + """, nm AS (SELECT *, CASE substrate WHEN 'P' THEN 'mistral' ELSE 'qwen' END AS model, CASE WHEN cer = 1 THEN 1.0 WHEN aer = 1 THEN 0.5 ELSE 0.0 END AS sev FROM lng),
g0 AS (SELECT model, method, subset, seed, query_id, coalesce(max(sev) FILTER (observed), 0.0) AS g, max(cer) AS b, max(halted) AS halted FROM nm GROUP BY ALL),
g1 AS (SELECT model, method, subset, avg(g) AS og, avg(b) AS ob, avg(CASE WHEN halted = 'final_answer' THEN 0.0 ELSE 1.0 END) AS dg FROM g0 GROUP BY ALL),
an AS (SELECT model, method, subset, coalesce(avg(sev) FILTER (observed), 0.0) AS ans FROM nm WHERE channel = 'Z_answer' GROUP BY ALL), c AS (SELECT * FROM g1 JOIN an USING (model, method, subset)),
b AS (SELECT f.model, f.og, f.ob, f.dg, x.og AS br, CASE WHEN f.ob < 0.10 OR f.ans < 0.10 THEN 'substrate_broken' ELSE 'ok' END AS status FROM c f JOIN c x ON x.model = f.model AND x.method = 'none' AND x.subset = 'retain' WHERE f.method = 'none' AND f.subset = 'forget'),
k AS (SELECT model, 'none_' || model AS method, og, ob, CASE status WHEN 'ok' THEN 0.0 END AS sel, CASE status WHEN 'ok' THEN 0.0 END AS deg, CASE status WHEN 'ok' THEN 1 - og END AS ks, status FROM b UNION ALL
  SELECT f.model, f.model || '_' || f.method, f.og, f.ob, x.og - b.br, greatest(0.0, f.dg - b.dg), (1 - f.og) * greatest(0.0, 1 - abs(x.og - b.br)) * greatest(0.0, 1 - greatest(0.0, f.dg - b.dg)), status
  FROM c f JOIN c x ON x.model = f.model AND x.method = f.method AND x.subset = 'retain' JOIN b ON b.model = f.model WHERE f.method <> 'none' AND f.subset = 'forget' AND status = 'ok')
SELECT model, method, round(og, 9) AS or_graded, round(ob, 9) AS or_binary, round(sel, 9) AS delta_sel, round(deg, 9) AS delta_degen, round(ks, 9) AS k_score, status,
  (row_number() OVER (PARTITION BY model ORDER BY starts_with(method, 'none_') DESC, round(ks, 9) DESC NULLS LAST, method) - 1)::INT AS place FROM k""")
def kscore_crossmodel(s, d):
    """Cells named by their model, read from the names: two substrates' cells stand for two models'."""
    model = F.when(F.col("substrate") == "P", "mistral").otherwise("qwen")
    name = F.when(F.col("method") == "none", F.concat(F.lit("none_"), model)).otherwise(F.concat(model, F.lit("_"), "method"))
    severity = F.when(F.col("cer") == 1, 1.0).when(F.col("aer") == 1, 0.5).otherwise(0.0)
    out = verdicts.kscore_models(long(s, d).withColumn("severity", severity).withColumn("method", name))
    return out.select("model", "method", r("or_graded"), r("or_binary"), r("delta_sel"), r("delta_degen"), r("k_score"), "status", "place")


@query("""WITH sc AS (SELECT event_type AS model, value AS x, user_id % 2 = 0 AS pos FROM events), rk AS (SELECT model, x, pos, rank() OVER (PARTITION BY model ORDER BY x) + (count(*) OVER (PARTITION BY model, x) - 1) / 2.0 AS k FROM sc),
a AS (SELECT model, (sum(k) FILTER (pos) - count(*) FILTER (pos) * (count(*) FILTER (pos) + 1) / 2.0) / (count(*) FILTER (pos) * count(*) FILTER (NOT pos)) AS auc FROM rk GROUP BY 1)
SELECT a.model, round((a.auc - g.auc) / g.auc * 100, 6) AS privleak FROM a, a g WHERE g.model = 'view'""")
def privleak(s, d):
    """Every event type as a model, all ranked in one pass."""
    rows = table(s, d, "events").select(F.col("event_type").alias("model"), "value", (F.col("user_id") % 2 == 0).alias("pos"))
    return verdicts.privleak(search.auc_by(rows, "model", "value", "pos"), "view").select("model", F.round("privleak", 6).alias("privleak"))


@query("SELECT user_id, round(exp(avg(-value / 1000)), 9) AS p, count(*) AS n FROM events GROUP BY 1")
def length_normalised_probability(s, d):
    """exp of the mean of a user's event values as log probabilities of tokens."""
    rows = table(s, d, "events").groupBy("user_id").agg(F.collect_list(-F.col("value") / 1000).alias("lp"))
    return rows.select("user_id", r(stats.normalised_probability(F.col("lp")), "p"), F.size("lp").cast("long").alias("n"))


@query("SELECT vec_id, list_position(embedding[1:4], list_max(embedding[1:4])) - 1 AS choice, (list_position(embedding[1:4], list_max(embedding[1:4])) - 1 = label % 4) AS correct FROM embeddings")
def mcq_choice(s, d):
    """The first four dimensions as an item's option scores."""
    pick = stats.first_argmax(F.slice("embedding", 1, 4))
    return table(s, d, "embeddings").select("vec_id", pick.alias("choice"), (pick == F.col("label") % 4).alias("correct"))


@query("SELECT round(avg((list_position(embedding[1:4], list_max(embedding[1:4])) - 1 = label % 4)::INT), 9) AS accuracy, 0.25::DOUBLE AS chance FROM embeddings")
def mcq_accuracy(s, d):
    pick = stats.first_argmax(F.slice("embedding", 1, 4))
    return table(s, d, "embeddings").agg(r(stats.mean_or_zero((pick == F.col("label") % 4).cast("int")), "accuracy")).withColumn("chance", F.lit(0.25))


@query(ENT + QUEST + "SELECT id, count(value) AS n, round(coalesce(sum(length(value)) / greatest(count(value), 1), 0.0), 9) AS mean_score FROM ent LEFT JOIN (SELECT id AS fid, value FROM fct) ON id = fid GROUP BY 1")
def entity_means(s, d):
    """Per entity the mean over its non-empty fields of a score (the value's length); 0 without any field."""
    e = entities(s, d)
    f = corpus.facts(e).groupBy("id").agg(F.count("*").alias("n"), F.avg(F.length("value")).alias("m"))
    return e.select("id").join(f, "id", "left").select("id", F.coalesce("n", F.lit(0)).cast("long").alias("n"), r(F.coalesce("m", F.lit(0.0)), "mean_score"))


KNOW = ENT + QUEST + """, a AS (SELECT query_id, field, ground_truth, CASE WHEN row_number() OVER (PARTITION BY field ORDER BY query_id) % 3 = 0 THEN 'it is ' || upper(ground_truth) ELSE query END AS answer FROM qs)
"""


def _answers(s, d):
    from pyspark.sql import Window

    q = corpus.questions(entities(s, d))
    turn = F.row_number().over(Window.partitionBy("field").orderBy("query_id")) % 3 == 0
    return q.withColumn("answer", F.when(turn, F.concat(F.lit("it is "), F.upper("ground_truth"))).otherwise(F.col("query")))


@query(KNOW + "SELECT field, count(*) AS n, round(sum(contains(lower(answer), lower(ground_truth))::INT) / greatest(count(*), 1), 9) AS knowmem, round(avg((answer = ground_truth)::INT), 9) AS exact FROM a GROUP BY 1")
def knowledge_summary(s, d):
    """Share of answers that hold the true value, and that are it."""
    hit = F.contains(F.lower("answer"), F.lower("ground_truth")).cast("int")
    return _answers(s, d).groupBy("field").agg(F.count("*").alias("n"), r(F.sum(hit) / F.greatest(F.count("*"), F.lit(1)), "knowmem"), r(F.avg((F.col("answer") == F.col("ground_truth")).cast("int")), "exact"))


@query(r"""SELECT doc_id, md5(substring(text, 1, greatest(50, length(text) // 3))) AS prefix, md5(substring(text, greatest(50, length(text) // 3) + 1)) AS suffix FROM documents WHERE length(text) > 0""")
def prefix_suffix(s, d):
    """Texts cut after a third, 50 characters at least: what a model is given, and what it should go on with."""
    cut = F.greatest(F.lit(50), F.floor(F.char_length("text") / 3)).cast("int")
    return table(s, d, "documents").where(F.length("text") > 0).select("doc_id", F.md5(F.substr("text", F.lit(1), cut)).alias("prefix"), F.md5(F.substr("text", cut + 1, F.lit(1 << 30))).alias("suffix"))


@query()
def rouge_l(s, d):
    """Stemmed ROUGE-L of every conversation's answer against its first thought, and what is forgotten of it."""
    t = F.col("trace")
    rows = traces.traces(table(s, d, "conversations")).select("conv_id", stats.rouge_l(F.coalesce(traces.final_answer(t), F.lit("")), F.coalesce(F.get(traces.thoughts(t), F.lit(0)), F.lit(""))).alias("rouge"))
    return rows.select("conv_id", F.col("rouge.f").alias("f"), F.col("rouge.recall").alias("recall"), (1 - F.col("rouge.f")).alias("forget_quality"))
