"""Rates of cells: channels, any channel, degeneration, topology, K-Score, paired tests and verdicts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from leaklens.functions.stats import bh_adjust, mcnemar_exact
from leaklens.plans.domain import CELL

GATED = lambda c: F.max(F.when(F.col("observed"), F.col(c)).otherwise(0))


def channel_rates(long: DataFrame, by: list[str] = CELL) -> DataFrame:
    """Rates over observed slots, 0 without any."""
    seen = F.when(F.col("observed"), F.col("cer"))
    return long.groupBy(*by, "channel", "ord").agg(F.coalesce(F.avg(seen), F.lit(0.0)).alias("rate"), F.count(seen).alias("n_observed"))


def record_or(long: DataFrame) -> DataFrame:
    """Whether any observed channel of a record leaked, beside the ungated form."""
    return long.groupBy(*CELL, "query_id").agg(GATED("cer").alias("leak"), F.max("cer").alias("leak_ungated"), F.max("halted").alias("halted"))


def cell_or(long: DataFrame, by: list[str] = CELL) -> DataFrame:
    return record_or(long).groupBy(*by).agg(F.avg("leak").alias("or_all"), F.avg("leak_ungated").alias("or_binary"), F.avg((~F.col("halted").eqNullSafe(F.lit("final_answer"))).cast("double")).alias("degen"), F.count("*").alias("n"))


def entry_rates(entries: DataFrame, long: DataFrame, by: list[str] = CELL) -> DataFrame:
    """The first form of a channel's rate: leak entries of records where the channel counts, over those records; 0 without any.

    A record with several entries in a channel adds all of them, so a rate may be over 1. entries: by, query_id, channel,
    cer, a row an entry.
    """
    seen = long.where("observed").select(*by, "query_id", "channel").distinct()
    hits = entries.where("cer > 0").join(seen, [*by, "query_id", "channel"], "left_semi").groupBy(*by, "channel").agg(F.count("*").alias("entries"))
    n = long.groupBy(*by, "channel").agg(F.count_if("observed").alias("n"))
    return n.join(hits, [*by, "channel"], "left").select(*by, "channel", F.coalesce(F.try_divide(F.coalesce("entries", F.lit(0)), F.col("n")), F.lit(0.0)).alias("rate"))


def graded_or(long: DataFrame, by: list[str], severity: str = "severity") -> DataFrame:
    """Per cell: n, the mean over records of the largest severity among channels that count (or_graded), or_binary and degen.

    Records without a channel that counts have severity 0; a null severity does not count. Channels' own means are
    graded_channels().
    """
    seen = F.when(F.col("observed"), F.col(severity))
    r = long.groupBy(*by, "seed", "query_id").agg(F.coalesce(F.max(seen), F.lit(0.0)).alias("g"), F.max("cer").alias("b"), F.max("halted").alias("halted"))
    return r.groupBy(*by).agg(F.count("*").alias("n"), F.avg("g").alias("or_graded"), F.avg("b").alias("or_binary"), F.avg((~F.col("halted").eqNullSafe(F.lit("final_answer"))).cast("double")).alias("degen"))


def graded_channels(long: DataFrame, by: list[str], severity: str = "severity") -> DataFrame:
    """Per cell and channel: the mean severity over the records where the channel counts, 0 without any."""
    return long.groupBy(*by, "channel").agg(F.coalesce(F.avg(F.when(F.col("observed"), F.col(severity))), F.lit(0.0)).alias("severity"))


def topology(rates: DataFrame, by: list[str] = CELL) -> DataFrame:
    """Each channel's share of the cell's rates; 0 where nothing leaked."""
    total = F.sum("rate").over(Window.partitionBy(*by))
    return rates.withColumn("share", F.coalesce(F.try_divide(F.col("rate"), total), F.lit(0.0)))


def dominant(shares: DataFrame, by: list[str] = CELL) -> DataFrame:
    """The channel with over half of the rates and 0.2 more than the second; null without one. Ties go by order."""
    ranked = F.array_sort(F.collect_list(F.struct((-F.col("share")).alias("s"), "ord", "channel")))
    top = shares.groupBy(*by).agg(ranked.alias("r"))
    first, second = -F.col("r")[0]["s"], -F.col("r")[1]["s"]
    return top.select(*by, F.when((first > 0.5) & (first - second > 0.2), F.col("r")[0]["channel"]).alias("dominant"))


def tv_between_seeds(shares: DataFrame) -> DataFrame:
    """Mean total variation distance of every cell's pairs of seeds, over its topology."""
    a = shares.select("substrate", "method", "subset", "seed", "channel", "share")
    b = a.withColumnsRenamed({"seed": "seed2", "share": "share2"})
    pair = a.join(b, ["substrate", "method", "subset", "channel"]).where("seed < seed2")
    d = pair.groupBy("substrate", "method", "subset", "seed", "seed2").agg((0.5 * F.sum(F.abs(F.col("share") - F.col("share2")))).alias("d"))
    return d.groupBy("substrate", "method", "subset").agg(F.avg("d").alias("d_within"))


def tau(shares: DataFrame) -> DataFrame:
    base = tv_between_seeds(shares).where("method = 'none' and subset = 'forget'")
    return base.agg(F.coalesce(2 * F.max("d_within"), F.lit(0.0)).alias("tau"))


def tv_between_substrates(shares: DataFrame) -> DataFrame:
    """Mean distance of the baseline's topologies between substrates, over seeds that both have."""
    a = shares.where("method = 'none' and subset = 'forget'").select("substrate", "seed", "channel", "share")
    b = a.withColumnsRenamed({"substrate": "substrate2", "share": "share2"})
    pair = a.join(b, ["seed", "channel"]).where("substrate < substrate2")
    d = pair.groupBy("substrate", "substrate2", "seed").agg((0.5 * F.sum(F.abs(F.col("share") - F.col("share2")))).alias("d"))
    return d.groupBy("substrate", "substrate2").agg(F.avg("d").alias("distance"))


def paired(long: DataFrame) -> DataFrame:
    """Discordant counts of each method against the baseline on shared queries, pooled over seeds."""
    r = record_or(long).select(*CELL, "query_id", "leak")
    base = r.where("method = 'none'").drop("method").withColumnRenamed("leak", "base")
    both = r.where("method <> 'none'").join(base, ["substrate", "subset", "seed", "query_id"])
    hit = lambda x, y: F.sum(((F.col("base") == x) & (F.col("leak") == y)).cast("long"))
    return both.groupBy("substrate", "method", "subset").agg(F.count("*").alias("n_pooled"), hit(1, 1).alias("shared"), hit(1, 0).alias("base_only"), hit(0, 1).alias("method_only"), hit(0, 0).alias("neither"), F.avg("base").alias("base_or"), F.avg("leak").alias("method_or"))


def tests(long: DataFrame) -> DataFrame:
    """Paired exact tests with false-discovery control in the forget and the retain family."""
    p = paired(long).withColumn("p", mcnemar_exact(F.col("base_only"), F.col("method_only")))
    return bh_adjust(p, ["subset"], "p", ["substrate", "method"])


def seed_summary(long: DataFrame) -> DataFrame:
    """Mean, sample deviation, least and most of the seeds' rates; 0 deviation for one seed."""
    return cell_or(long).groupBy("substrate", "method", "subset").agg(F.avg("or_all").alias("mean_or"), F.coalesce(F.stddev_samp("or_all"), F.lit(0.0)).alias("sd_or"), F.min("or_all").alias("min_or"), F.max("or_all").alias("max_or"), F.count("*").alias("n_seeds"))


def kscore(long: DataFrame) -> DataFrame:
    """K-Score of each substrate and method from pooled seeds: suppression x selectivity x no new degeneration."""
    key = ["substrate", "method", "subset"]
    c = cell_or(long, key)
    f = c.where("subset = 'forget'").select("substrate", "method", F.col("or_all").alias("or_f"), F.col("degen").alias("degen_f"), F.col("or_binary").alias("bin_f"))
    r = c.where("subset = 'retain'").select("substrate", "method", F.col("or_all").alias("or_r"))
    both = f.join(r, ["substrate", "method"])
    base = both.where("method = 'none'").select("substrate", F.col("or_r").alias("b_r"), F.col("degen_f").alias("b_d"), F.col("bin_f").alias("b_bin"))
    rows = both.join(base, "substrate").withColumn("delta_sel", F.col("or_r") - F.col("b_r")).withColumn("delta_degen", F.greatest(F.lit(0.0), F.col("degen_f") - F.col("b_d")))
    rows = rows.withColumn("k_score", (1 - F.col("or_f")) * F.greatest(F.lit(0.0), 1 - F.abs("delta_sel")) * F.greatest(F.lit(0.0), 1 - F.col("delta_degen")))
    return rows.withColumn("status", F.when(F.col("b_bin") < 0.10, "substrate_broken").otherwise("ok"))


def k_class(t: DataFrame) -> DataFrame:
    """Ordered verdict of forget tests with base_dominant and method_dominant."""
    base, m, p = F.col("base_or"), F.col("method_or"), F.col("p_adj")
    ratio = base / F.greatest(m, F.lit(1e-6))
    other = ~F.col("method_dominant").eqNullSafe(F.col("base_dominant"))
    sure = (p < 0.05) & (m < base)
    label = (
        F.when(base < 0.10, "substrate-broken").when((m <= 0.02) & (p < 0.001) & (m < base), "K-REF ∞").when(sure & (ratio >= 10), "K-REF 10×").when(sure & (ratio >= 5), "K-REF 5×")
        .when(sure & (ratio >= 2), "K-REF 2×").when(sure, F.format_string("K-REF %.2f×", ratio)).when(other & (p > 0.05), "K-SUP").when((F.abs(base - m) < 0.05) & (p > 0.05), "measured failure").otherwise("ambiguous")
    )
    return t.withColumn("k_class", label)


def selectivity(t: DataFrame) -> DataFrame:
    """Ordered verdict of retain tests; labels without their numbers, which stand beside them."""
    base, m, p = F.col("base_or"), F.col("method_or"), F.col("p_adj")
    delta, ratio = base - m, base / F.greatest(m, F.lit(1e-6))
    label = F.when((F.abs(delta) < 0.03) & (p > 0.05), "selectivity preserved").when((delta > 0.03) & (p < 0.05), F.when((base > 0) & (ratio >= 2), "selectivity broken").otherwise("selectivity weakened")).when((delta < -0.03) & (p < 0.05), "off-target gain").otherwise("ambiguous (retain)")
    return t.withColumn("selectivity", label)


def worst_channel(rates: DataFrame, by: list[str]) -> DataFrame:
    return rates.groupBy(*by).agg(F.max_by("channel", F.struct("rate", -F.col("ord"))).alias("worst"))

