"""Checks of splits, provenance and stored cells: every check is rows, and a strict reading raises."""

from __future__ import annotations

import hashlib
import json
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def offenders(name: str, bad: DataFrame, key: str = "id") -> DataFrame:
    """invariant, offenders, first: how many rows break it, and the five least of them."""
    least = bad.select(F.col(key).cast("string").alias("k")).orderBy("k").limit(5).agg(F.array_join(F.array_sort(F.collect_list("k")), ",").alias("first"))
    return bad.agg(F.count("*").alias("offenders")).crossJoin(least).select(F.lit(name).alias("invariant"), "offenders", "first")


def split_invariants(canonical: DataFrame, forget: DataFrame, retain: DataFrame, distractor: DataFrame) -> DataFrame:
    """The four invariants of a split, each with its offenders; all have a column id."""
    f, t, x, c = (df.select("id").distinct() for df in (forget, retain, distractor, canonical))
    checks = [("forget in canonical", f.join(c, "id", "left_anti")), ("forget and distractors apart", f.intersect(x)), ("forget and retain apart", f.intersect(t)), ("distractors in retain", x.join(t, "id", "left_anti"))]
    return reduce(DataFrame.unionByName, [offenders(n, b) for n, b in checks])


def apart(adapter: DataFrame, forget: DataFrame, retain: DataFrame) -> DataFrame:
    """pair, shared: what an adapter was trained on and what is evaluated, pairwise and together."""
    a, f, t = (df.select("id").distinct() for df in (adapter, forget, retain))
    pairs = [("adapter, forget", a.intersect(f)), ("adapter, retain", a.intersect(t)), ("adapter, any", a.intersect(f.union(t).distinct()))]
    return reduce(DataFrame.unionByName, [b.agg(F.count("*").alias("shared")).select(F.lit(n).alias("pair"), "shared") for n, b in pairs])


def require_none(checks: DataFrame, count: str) -> None:
    """An error that lists the checks whose count isn't 0."""
    bad = [tuple(r) for r in checks.where(F.col(count) > 0).limit(20).collect()]
    if bad:
        raise ValueError(f"broken: {bad}")


def short_hash(content: Column) -> Column:
    """The first 16 hex digits of the content's SHA-256."""
    return F.substring(F.sha2(content, 256), 1, 16)


def file_hashes(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path).select(F.col("_metadata.file_name").alias("file"), short_hash(F.col("content")).alias("sha"), F.col("length").alias("bytes"))


def config_hash(config: dict, keys: list[str] | None = None) -> str:
    """The first 16 hex digits of the SHA-256 of the chosen settings as JSON with sorted keys."""
    chosen = {k: config[k] for k in (keys or config)}
    return hashlib.sha256(json.dumps(chosen, sort_keys=True).encode()).hexdigest()[:16]


def same_config(spark: SparkSession, path: str, config: dict) -> None:
    """Store the settings of a run beside its output, or refuse to go on under others, naming what differs."""
    fs_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not fs_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(fs_path):
        spark.createDataFrame([(json.dumps(config, sort_keys=True),)], "value string").coalesce(1).write.text(path)
        return
    before = json.loads(spark.read.text(path).first()["value"])
    if before != json.loads(json.dumps(config)):
        raise ValueError(f"cannot go on with {path}: settings differ in {sorted(k for k in {*before, *config} if before.get(k) != config.get(k))}")


#: The methods that are known, and substrates that a remote model may serve.
METHODS = ("none", "noise", "eco", "star", "leace", "cha", "o3", "repe", "mlp_probe", "rlace")


def argument_errors(runs: DataFrame) -> DataFrame:
    """run, error: remote models only on substrates C and R without a method, and methods that are known or a plug-in's path."""
    remote = F.coalesce(F.col("api_model"), F.lit("")) != ""
    plug_in = F.col("method").rlike(r"\.py(::\w+)?$")
    error = F.when(remote & ~F.col("substrate").isin("C", "R-text", "R-struct"), "a remote model needs substrate C or R").when(remote & (F.col("method") != "none"), "a remote model takes no method").when(~F.col("method").isin(*METHODS) & ~plug_in, "unknown method")
    return runs.select("run", error.alias("error")).where("error is not null")


def path_errors(runs: DataFrame) -> DataFrame:
    """run, error: P needs an adapter and no injection, C and R an injection and no adapter unless it is a control's, R an index."""
    p, r = F.col("substrate") == "P", F.col("substrate").startswith("R")
    has = lambda c: F.coalesce(F.col(c), F.lit("")) != ""
    error = F.when(p & ~has("adapter"), "P without an adapter").when(p & has("injected"), "P with injected records").when(~p & ~has("injected"), "nothing is injected").when(r & ~has("index"), "R without an index")
    return runs.select("run", error.alias("error")).where("error is not null")


def cell_findings(cells: DataFrame, seeds: tuple[int, ...] = (0, 137, 271), least: int = 1) -> DataFrame:
    """severity, code, message: incomplete seeds and small cells of (substrate, method, subset, seed, n, version), several versions in one comparison.

    More than one version in a cell is a warning, more than three overall an error.
    """
    key = ["substrate", "method", "subset"]
    name = F.concat_ws("/", *key)
    lack = F.array_except(F.array(*[F.lit(s) for s in seeds]), F.collect_set("seed"))
    by = cells.groupBy(*key).agg(F.array_sort(lack).alias("lack"), F.countDistinct("version").alias("versions"), F.min("n").alias("n"))
    rows = [
        by.where(F.size("lack") > 0).select(F.lit("warning").alias("severity"), F.lit("seeds").alias("code"), F.concat(name, F.lit(" lacks "), F.array_join(F.col("lack").cast("array<string>"), ",")).alias("message")),
        by.where(F.col("n") < least).select(F.lit("error").alias("severity"), F.lit("size").alias("code"), F.concat(name, F.lit(" has "), F.col("n").cast("string"), F.lit(" records")).alias("message")),
        by.where("versions > 1").select(F.lit("warning").alias("severity"), F.lit("versions").alias("code"), F.concat(name, F.lit(" mixes versions")).alias("message")),
        cells.agg(F.countDistinct("version").alias("v")).where("v > 3").select(F.lit("error").alias("severity"), F.lit("versions").alias("code"), F.lit("over three versions").alias("message")),
    ]
    return reduce(DataFrame.unionByName, rows)


def split_errors(spark: SparkSession, paths: list[str], n_forget: int, n: int) -> list[str]:
    """What is wrong with a split before it is read: files that are not there, and a forget size that is not from 1 to n."""
    def there(path: str) -> bool:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)

    out = [f"{p} is missing" for p in paths if not there(p)]
    return out + ([] if 0 < n_forget <= n else [f"{n_forget} of {n} records can't be forgotten"])


def audit_directory(spark: SparkSession, pattern: str, seeds: tuple[int, ...] = (0, 137, 271), least: int = 1, strict: bool = False) -> DataFrame:
    """severity, code, message of a folder of transcripts: cell_findings of the cells that its file names tell, and files whose names tell none.

    Versions are the names' own. strict: an error if any finding is one.
    """
    from leaklens.sources.files import versioned_key
    from leaklens.sources.tables import cell_key

    names = spark.read.text(pattern).where("value <> ''").groupBy(F.col("_metadata.file_name").alias("file")).agg(F.count("*").alias("n"))
    long_ = versioned_key(F.col("file"))
    short = cell_key(F.col("file"))
    cells = names.select("file", "n", F.coalesce(long_[0], F.lit("")).alias("version"), *[F.coalesce(long_[i], x).alias(c) for c, i, x in zip(("substrate", "method", "subset", "seed"), (2, 3, 4, 5), short, strict=True)])
    odd = cells.where("substrate is null").select(F.lit("warning").alias("severity"), F.lit("name").alias("code"), F.concat("file", F.lit(" is no cell's name")).alias("message"))
    out = cell_findings(cells.where("substrate is not null").groupBy("substrate", "method", "subset", "seed", "version").agg(F.sum("n").alias("n")), seeds, least).unionByName(odd)
    if strict and (bad := [r["message"] for r in out.where("severity = 'error'").limit(20).collect()]):
        raise ValueError(f"broken: {bad}")
    return out


def manifest(sets: dict[str, DataFrame]) -> DataFrame:
    """set, n, sha: size of each set of ids and a digest of them that doesn't hang on their order."""
    digest = F.md5(F.concat_ws(":", F.count("*").cast("string"), F.sum(F.conv(F.substring(F.md5("id"), 1, 8), 16, 10).cast("long")).cast("string")))
    return reduce(DataFrame.unionByName, [df.select("id").distinct().agg(F.count("*").alias("n"), digest.alias("sha")).select(F.lit(name).alias("set"), "n", "sha") for name, df in sets.items()])


def expected_rows(have: DataFrame, want: DataFrame) -> DataFrame:
    """file, n, expected, ok: row counts against those expected, unknown ones null; for warnings, not errors."""
    return want.join(have, "file", "left").select("file", F.coalesce("n", F.lit(-1)).alias("n"), "expected", F.coalesce(F.col("n") == F.col("expected"), F.lit(False)).alias("ok"))
