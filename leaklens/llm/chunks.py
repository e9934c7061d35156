"""Substring dedup by content-defined chunks: a gear rolling hash cuts, digests find repeats."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leaklens.llm.shared import pieces, small_batches, stash, unstash, utf8

_GEAR = np.random.default_rng(7).integers(0, 1 << 32, 256, np.uint32)
#: Bits of the gear hash that must be 0 at a cut: about 32 bytes apart beyond the least length.
CUT_BITS = 5
LEAST, MOST = 24, 256
#: Repeated chunks go only in runs of at least so many bytes, so that common phrases stay.
LEAST_RUN = 96
#: Bytes beside a first chunk that a run is extended over at each end; a longer equal stretch has chunks of its own.
CONTEXT = 4 * MOST


def cut_points(data: np.ndarray) -> np.ndarray:
    """Ends of chunks. The hash of a place depends on the 32 bytes before it, so cuts come back after an edit."""
    h = _GEAR[data]
    for step in (1, 2, 4, 8, 16):
        shifted = h[:-step] << np.uint32(step)
        h = h.copy()
        h[step:] += shifted
    return np.flatnonzero(h >> np.uint32(32 - CUT_BITS) == 0) + 1


def chunk_ends(cuts: np.ndarray, begin: int, end: int) -> list[int]:
    """Cuts at least LEAST apart and at most MOST, of one text; never inside what the next text begins."""
    out, last = [], begin
    for c in [*cuts.tolist(), end]:
        while c - last > MOST:
            last += MOST
            out.append(last)
        if c - last >= LEAST or (c == end and c > last):
            out.append(c)
            last = c
    return out


def _texts(part: pa.RecordBatch, column: int):
    """(row, bytes, ends of its chunks) of every text of a slice."""
    data, offsets = utf8(part.column(column))
    raw, cuts = data.tobytes(), cut_points(data)
    lows, highs = np.searchsorted(cuts, offsets[:-1] + 32), np.searchsorted(cuts, offsets[1:])  # nearer cuts hang on the text before
    for i, (a, b) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)):
        if b > a:
            yield i, raw, a, chunk_ends(cuts[lows[i] : highs[i]], a, b)


def common(x: bytes, y: bytes) -> int:
    """Length of the longest common prefix."""
    lo, hi = 0, min(len(x), len(y))
    while lo < hi:
        mid = (lo + hi + 1) // 2
        lo, hi = (mid, hi) if x[lo:mid] == y[lo:mid] else (lo, mid - 1)
    return lo


def extended(text: bytes, ends: list[int], hits: list[int], beside: dict[tuple[int, bool], bytes]) -> list[list[int]]:
    """Runs [lo, hi) of the chunks `hits`, each end moved out as far as the bytes beside the first occurrence agree; never inside a character."""
    runs: list[list[int]] = []
    for n in hits:
        lo, hi = ends[n - 1] if n else 0, ends[n]
        if (n, False) in beside:
            out = lo - common(text[max(0, lo - CONTEXT) : lo][::-1], beside[n, False][::-1])
            while out < lo and text[out] & 0xC0 == 0x80:
                out += 1
            lo = out
        if (n, True) in beside:
            out = hi + common(text[hi : hi + CONTEXT], beside[n, True])
            while hi < out < len(text) and text[out] & 0xC0 == 0x80:
                out -= 1
            hi = out
        if runs and runs[-1][1] >= lo:
            runs[-1] = [min(runs[-1][0], lo), max(runs[-1][1], hi)]
        else:
            runs.append([lo, hi])
        while len(runs) > 1 and runs[-2][1] >= runs[-1][0]:
            last = runs.pop()
            runs[-1] = [min(runs[-1][0], last[0]), max(runs[-1][1], last[1])]
    return runs


def dedup_substrings(docs: DataFrame, text: str = "text", key: str = "doc_id", least_run: int = LEAST_RUN) -> DataFrame:
    """All of docs' columns, with the text's repeated chunks taken out, plus n_removed, n_spans and spans.

    A text is cut into chunks of 24 to 256 bytes where a gear hash says so. Of every digest, the first chunk by
    (key, text digest, place) stays; later ones form runs, each extended byte by byte beside the first occurrence of
    its outermost chunks, CONTEXT bytes at most; extended runs of `least_run` bytes or more go. n_removed
    is in bytes, spans are the byte ranges [lo, hi) that went. The kept bytes are decoded leniently: a character
    cut in two is dropped. Whole copies end up empty. Null text: null, nothing removed; empty text alike. Null
    keys come first; repeated rows count as copies only where their key or text differs: rows equal in both keep
    the same. An empty table gives no rows. Columns that docs has under the added names are
    replaced; all others come back, whatever their names.
    """
    spark = docs.sparkSession
    small_batches(spark)
    rows = docs.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text"))

    def cut(batches):
        for b in batches:
            for part in pieces(b, "text"):
                keys, out = part.column(0).to_pylist(), ([], [], [], [], [])
                for i, raw, a, ends in _texts(part, 1):
                    whole = int.from_bytes(hashlib.blake2b(raw[a : ends[-1]], digest_size=8).digest(), "little", signed=True)
                    begin = a
                    for n, e in enumerate(ends):
                        out[0].append(hashlib.blake2b(raw[begin:e], digest_size=16).digest())
                        out[3].append(n)
                        begin = e
                    out[1].extend([keys[i]] * len(ends))
                    out[2].extend([whole] * len(ends))
                yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.binary()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.int64()), pa.array(out[3], pa.int32())], names=["digest", "key", "whole", "n"])

    chunks = stash(rows.where(F.length("text") > 0).mapInArrow(cut, "digest binary, key long, whole long, n int"), "chunks")
    place = F.struct("key", "whole", "n")
    firsts = chunks.groupBy("digest").agg(F.min(place).alias("first"), F.max(place).alias("last")).where("first <> last").select("digest", "first")
    again = chunks.join(firsts, "digest").where(place != F.col("first")).groupBy("key", "whole").agg(F.collect_set(F.struct("n", "first")).alias("hits"))
    again = again.select(F.coalesce("key", F.lit(0)).alias("k"), F.col("key").isNull().alias("kn"), "whole", "hits")
    again = stash(again, "again")
    unstash(chunks)

    added = ("n_removed", "n_spans", "spans")
    names = [c for c in docs.columns if c != text and c not in added]
    carried = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"), F.col(text).alias("text"), F.coalesce(F.col(key).cast("long"), F.lit(0)).alias("k"), F.col(key).isNull().alias("kn"))

    def digest(batches):
        for b in batches:
            whole = [None if x is None else int.from_bytes(hashlib.blake2b(x.encode(), digest_size=8).digest(), "little", signed=True) for x in b.column(b.schema.get_field_index("text")).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(whole, pa.int64())], names=[*b.schema.names, "whole"])

    from pyspark.sql import types as T

    with_whole = carried.mapInArrow(digest, T.StructType([*carried.schema.fields, T.StructField("whole", T.LongType())]))

    def outermost(batches):
        for b in batches:
            out = [[] for _ in range(9)]
            for k, kn, whole, hits in zip(*[c.to_pylist() for c in b.columns], strict=True):
                have = {x["n"] for x in hits}
                for x in hits:
                    first = x["first"]
                    for right, beside in ((False, x["n"] - 1), (True, x["n"] + 1)):
                        if beside not in have:
                            for column, v in zip(out, (k, kn, whole, x["n"], right, first["key"] or 0, first["key"] is None, first["whole"], first["n"]), strict=True):
                                column.append(v)
            kinds = (pa.int64(), pa.bool_(), pa.int64(), pa.int32(), pa.bool_(), pa.int64(), pa.bool_(), pa.int64(), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, kinds, strict=True)], names=["k", "kn", "whole", "n", "right", "fk", "fkn", "fw", "fn"])

    ends_of = stash(again.mapInArrow(outermost, "k long, kn boolean, whole long, n int, right boolean, fk long, fkn boolean, fw long, fn int"), "ends")
    asked = ends_of.groupBy(F.col("fk").alias("k"), F.col("fkn").alias("kn"), F.col("fw").alias("whole")).agg(F.collect_set(F.struct("fn", "right")).alias("asked"))

    def bytes_beside(batches):
        for b in batches:
            for part in pieces(b, "text"):
                out = [[] for _ in range(6)]
                ids, wanted = [c.to_pylist() for c in part.columns[1:4]], part.column(4).to_pylist()
                for i, raw, a, ends in _texts(part, 0):
                    for x in wanted[i]:
                        n, right = x["fn"], x["right"]
                        at = ends[n] if right else ends[n - 1] if n else a
                        found = raw[at : min(at + CONTEXT, ends[-1])] if right else raw[max(a, at - CONTEXT) : at]
                        for column, v in zip(out, (ids[0][i], ids[1][i], ids[2][i], n, right, found), strict=True):
                            column.append(v)
                kinds = (pa.int64(), pa.bool_(), pa.int64(), pa.int32(), pa.bool_(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, kinds, strict=True)], names=["fk", "fkn", "fw", "fn", "right", "bytes"])

    found = with_whole.select("text", "k", "kn", "whole").join(asked, ["k", "kn", "whole"]).select("text", "k", "kn", "whole", "asked")
    found = found.mapInArrow(bytes_beside, "fk long, fkn boolean, fw long, fn int, right boolean, bytes binary").dropDuplicates(["fk", "fkn", "fw", "fn", "right"])
    beside = ends_of.join(found, ["fk", "fkn", "fw", "fn", "right"]).groupBy("k", "kn", "whole").agg(F.collect_set(F.struct("n", "right", "bytes")).alias("beside"))
    beside = stash(beside, "beside")
    unstash(ends_of)
    joined = with_whole.join(again.select("k", "kn", "whole", F.transform("hits", lambda x: x["n"]).alias("ns")).join(beside, ["k", "kn", "whole"], "left"), ["k", "kn", "whole"], "left").select("row", "text", "ns", "beside")
    schema = T.StructType([*carried.select("row", "text").schema.fields, *T._parse_datatype_string("n_removed long, n_spans long, spans array<struct<lo: long, hi: long>>").fields])

    def cut_out(batches):
        for b in batches:
            for part in pieces(b, "text"):
                texts, removed, spans = part.column(1).to_pylist(), [0] * part.num_rows, [[] for _ in range(part.num_rows)]
                gone, near = part.column(2).to_pylist(), part.column(3).to_pylist()
                for i, raw, a, ends in _texts(part, 1):
                    if not gone[i]:
                        continue
                    sides = {(x["n"], x["right"]): x["bytes"] for x in near[i] or []}
                    size = ends[-1] - a
                    runs = extended(raw[a : a + size], [e - a for e in ends], sorted(gone[i]), sides)
                    runs = [r for r in runs if r[1] - r[0] >= min(least_run, size)]
                    kept, last = [], 0
                    for lo, hi in runs:
                        kept.append(raw[a + last : a + lo])
                        last = hi
                    kept.append(raw[a + last : a + size])
                    texts[i] = "".join(x.decode("utf-8", "ignore") for x in kept)
                    spans[i] = [{"lo": lo, "hi": hi} for lo, hi in runs]
                    removed[i] = sum(hi - lo for lo, hi in runs)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(texts, pa.string()), pa.array(removed, pa.int64()), pa.array([len(s) for s in spans], pa.int64()), pa.array(spans, pa.list_(pa.struct([("lo", pa.int64()), ("hi", pa.int64())])))], names=["row", "text", "n_removed", "n_spans", "spans"])

    done = joined.mapInArrow(cut_out, schema)
    return done.select(*[F.col("text") if c == text else F.col("row").getField(c).alias(c) for c in docs.columns if c not in added], *added)
