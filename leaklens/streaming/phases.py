"""Runs of several phases that go on where they were stopped: each phase writes a table and then a marker that commits it."""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


class Phases:
    """A folder of phases. A phase is done when its marker is there; the marker names the table that it wrote.

    A phase writes to a folder of its own for each attempt and commits by renaming a marker into place, so a run that is
    killed at any time leaves either no marker (its files are ignored and the phase is done again) or a whole table.
    A marker also holds a digest of the settings and of the phases before it: other settings are an error, not a mixture.
    """

    def __init__(self, spark: SparkSession, path: str, settings: dict) -> None:
        self.spark, self.path = spark, path.rstrip("/")
        self.chain = hashlib.sha256(json.dumps(settings, sort_keys=True, default=str).encode()).hexdigest()
        self.ran: list[str] = []
        self._jvm, self._conf = spark._jvm, spark.sparkContext._jsc.hadoopConfiguration()

    def _at(self, name: str):
        where = self._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return where, where.getFileSystem(self._conf)

    def marker(self, name: str) -> dict | None:
        where, system = self._at(f"{name}.done")
        if not system.exists(where):
            return None
        return json.loads(self.spark.read.text(f"{self.path}/{name}.done", wholetext=True).first()[0])

    def _commit(self, name: str, said: dict) -> bool:
        """Write the marker beside its place and rename it; False if another run was first."""
        mine, system = self._at(f"_{name}-{uuid.uuid4().hex}")
        out = system.create(mine)
        out.write(bytearray(json.dumps(said).encode()))
        out.close()
        to, _ = self._at(f"{name}.done")
        if system.exists(to) or not system.rename(mine, to):
            system.delete(mine, False)
            return False
        return True

    def run(self, name: str, make: Callable[..., DataFrame], *before: DataFrame) -> DataFrame:
        """The phase's table: read if it is done, else made from the tables before it, written and committed."""
        self.chain = hashlib.sha256(f"{self.chain}/{name}".encode()).hexdigest()
        done = self.marker(name)
        if done is None:
            attempt = f"{self.path}/{name}-{uuid.uuid4().hex}"
            rows = make(*before)
            rows.write.parquet(attempt)
            said = {"table": attempt, "chain": self.chain, "rows": self.spark.read.parquet(attempt).count(), "schema": rows.schema.json()}
            done = said if self._commit(name, said) else self.marker(name)
            self.ran.append(name)
        if done["chain"] != self.chain:
            raise ValueError(f"phase {name} was written under other settings or phases")
        return self.spark.read.parquet(done["table"])

    def sweep(self) -> list[str]:
        """Delete what attempts without a marker have left, once no other run is at work; returns the folders' names."""
        root, system = self._at("")
        if not system.exists(root):
            return []
        names = [f.getPath().getName() for f in system.listStatus(root)]
        kept = {self.marker(n[: -len(".done")])["table"].rsplit("/", 1)[1] for n in names if n.endswith(".done")}
        stale = [n for n in names if not n.endswith(".done") and n not in kept]
        for n in stale:
            where, _ = self._at(n)
            system.delete(where, True)
        return stale


def build_index(spark: SparkSession, path: str, documents: DataFrame, injected: DataFrame, settings: dict, dims: int = 256) -> tuple[DataFrame, Phases]:
    """Passages, their vectors and their cells, as three phases; (passage_id, doc_id, embedding, cell) of the last.

    documents: doc_id, text. injected: passage_id, doc_id, text. settings: whatever the result depends on.
    """
    from pyspark.sql import functions as F

    from leaklens.operators import corpus, search

    phases = Phases(spark, path, {**settings, "dims": dims})

    def passages() -> DataFrame:
        own = corpus.chunks(documents, texts=True).select("passage_id", F.col("doc_id").cast("string").alias("doc_id"), "text")
        return own.unionByName(injected.select("passage_id", F.col("doc_id").cast("string").alias("doc_id"), "text"))

    def vectors(rows: DataFrame) -> DataFrame:
        return search.encode(rows.select(F.struct("passage_id", "doc_id").alias("k"), "text"), "k", dims).select("k.*", "embedding")

    def cells(rows: DataFrame) -> DataFrame:
        from leaklens.operators.search import InvertedFile

        file = InvertedFile(rows.select(F.col("passage_id").alias("vec_id"), "doc_id", "embedding"), keep=("doc_id",))
        return file.rows.select(F.col("vec_id").alias("passage_id"), "doc_id", "embedding", "cell")

    first = phases.run("passages", passages)
    second = phases.run("vectors", vectors, first)
    return phases.run("cells", cells, second), phases
