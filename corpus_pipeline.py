"""Pipeline over documents: language ID, near duplicates, repeated passages, source mix, packing."""

from __future__ import annotations

import re

import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from leaklens.llm import chunks, language, mixing, packing, shingles
from leaklens.llm.shared import WORD, pieces, small_batches, stash, unstash

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
_WORDS = re.compile(WORD)
VOCABULARY = public_tokenizers.path("word_bpe_49k.json")


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that fit no fitted language; `lang` becomes the identified one. Null ids and texts go.

    Rows of one id are judged each by its own text, declaration and source; rows equal in all four have one verdict.
    An empty table gives no rows, and so does one without any declared language. Columns beyond those of documents go.
    """
    rows = docs.select(*COLUMNS, F.xxhash64("doc_id", "text", "lang", "source").alias("key")).where("doc_id is not null and text is not null")
    said = language.identify(rows.select("key", F.col("text").alias("body"), F.col("lang").alias("declared"), F.col("source").alias("host")), language.fit(docs))
    said = said.where("accepted").select("key", F.col("lang").alias("identified")).dropDuplicates(["key"])
    return rows.join(said, "key").withColumn("lang", F.col("identified")).select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of every group of near duplicates the document with the least id stays; rows equal in id, once.

    Documents without words are groups of their own and stay; null ids go. An empty table gives no rows. Columns beyond
    those of documents go.
    """
    parts = shingles.jaccard_components(docs)
    kept = parts.where("doc_id = component_id").select("doc_id").distinct()
    # one row of an id, the least by its other columns
    one = docs.groupBy("doc_id").agg(F.min(F.struct(*[c for c in COLUMNS if c != "doc_id"])).alias("row"))
    return one.where("doc_id is not null").join(kept, "doc_id", "left_semi").select("doc_id", "row.*").select(*COLUMNS)


def drop_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Take out passages that earlier documents have; documents left without words go, so do null and empty texts.

    Earlier is by id, null first, then by a digest of the text. An empty table gives no rows.
    """
    kept = chunks.dedup_substrings(docs.select(*COLUMNS))
    kept = kept.withColumn("n_chars", F.char_length("text").cast("long"))
    return kept.where(F.col("text").rlike(r"[^\x20\x09-\x0D]")).select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it whole, and once more with the words it takes beyond that.

    Every row has its own allotment, also where rows share an id; rows equal in id, text and source have each one of
    theirs, in any order. Null texts are never taken. An empty table gives no rows. Columns beyond those of documents go.
    """
    small_batches(spark)
    docs = docs.select(*COLUMNS)
    takes = mixing.mix(docs).select("h", "passes", "spans")
    # almost every h has one row: the list holds the allotments of equal rows only
    takes = stash(takes.groupBy("h").agg(F.sort_array(F.collect_list(F.struct("passes", "spans"))).alias("takes")).where("size(takes) > 1 or takes[0].passes > 0 or size(takes[0].spans) > 0"), "mixed")
    rows = docs.withColumn("h", mixing.row_hash()).join(takes, "h")
    own = F.when(F.size("takes") > 1, F.row_number().over(Window.partitionBy("h").orderBy("lang", "n_chars"))).otherwise(1)
    rows = rows.withColumn("take", F.element_at("takes", own.cast("int"))).select(*COLUMNS, "take.passes", "take.spans")

    def take(batches):
        for whole in batches:
            for b in pieces(whole, "text"):
                at, texts = [], []
                for i, (text, passes, spans) in enumerate(zip(b.column(1).to_pylist(), b.column(5).to_pylist(), b.column(6).to_pylist(), strict=True)):
                    out = [text] * passes
                    if spans:
                        words = [m.span() for m in _WORDS.finditer(text)]
                        out.append("\n".join(text[words[lo][0] : words[hi - 1][1]] for lo, hi in _joined(spans)))
                    at += [i] * len(out)
                    texts += out
                rows = pa.array(at, pa.int64())
                yield pa.RecordBatch.from_arrays([b.column(0).take(rows), pa.array(texts, pa.string()), b.column(2).take(rows), b.column(3).take(rows), pa.array([len(t) for t in texts], pa.int64())], names=list(COLUMNS))

    return rows.mapInArrow(take, "doc_id long, text string, lang string, source string, n_chars long")


def _joined(spans: list[dict]) -> list[tuple[int, int]]:
    """Word ranges in order, those that touch as one."""
    out: list[list[int]] = []
    for lo, hi in sorted((x["lo"], x["hi"]) for x in spans):
        if out and out[-1][1] >= lo:
            out[-1][1] = hi
        else:
            out.append([lo, hi])
    return [(lo, hi) for lo, hi in out]


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces of all documents in sequences of at most 4096. Null text is an empty one; an empty table gives no rows."""
    return packing.pack(docs, VOCABULARY)


STAGES = [
    ("language_id", identify_language),
    ("near_duplicates", drop_near_duplicates),
    ("repeated_passages", drop_repeated_passages),
    ("source_mix", mix_sources),
    ("packing", pack_sequences),
]

#: Rolling hashes, a fitted model and a tokenizer's merges have no SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`, each written to the shared folder and read again by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stash(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
