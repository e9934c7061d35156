"""Exact removal of long repeated byte strings with suffix arrays built by induced sorting."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leaklens.llm.shared import mix64, pieces, small_batches, stash, utf8

#: Bytes of the grams whose least hash is a window's anchor; a power of two.
GRAM = 64
#: Bytes of fragments that one suffix array covers, about.
SHARD = 1 << 20
#: Names of leftmost-smaller substrings up to which the reduced string is sorted by the same induction.
NARROW = 600
_BASE = 0xD6E8FEB86659FD93


def _types(s: np.ndarray) -> np.ndarray:
    """True where a suffix is smaller than the one that follows it; the last is."""
    n = len(s)
    differs = np.flatnonzero(s[:-1] != s[1:])
    nearest = np.searchsorted(differs, np.arange(n - 1))
    small = np.ones(n, bool)
    at = differs[np.minimum(nearest, len(differs) - 1)] if len(differs) else np.zeros(n - 1, int)
    small[:-1] = s[at] < s[np.minimum(at + 1, n - 1)]
    return small


def _deal(prev: np.ndarray, chars: np.ndarray, edge: np.ndarray, sa: np.ndarray, step: int) -> None:
    """Put suffixes at the edges of their buckets in order, upwards (step 1) or downwards (step -1)."""
    order = np.argsort(chars, kind="stable")
    c, n = np.unique(chars, return_counts=True)
    rank = np.arange(len(chars)) - np.repeat(np.cumsum(n) - n, n)
    sa[edge[chars[order]] + step * rank] = prev[order]
    edge[c] += step * n


def _induce(s: np.ndarray, small: np.ndarray, seeds: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """All suffixes from leftmost-smaller ones in order: larger-type left to right, then smaller-type back.

    A bucket is dealt whole: what it induces in itself comes in waves, as many as its letter repeats in a row.
    """
    sa = np.full(len(s), -1, np.int64)
    head = starts[:-1].copy()
    by = s[seeds]
    order = np.argsort(by, kind="stable")
    cuts = np.searchsorted(by[order], np.arange(len(starts)))
    for c in np.unique(s):
        wave = sa[starts[c] : head[c]]
        while len(wave):
            prev = wave[wave > 0] - 1
            prev = prev[(s[prev] == c) & ~small[prev]]
            sa[head[c] : head[c] + len(prev)] = prev
            head[c] += len(prev)
            wave = prev
        own = sa[starts[c] : head[c]]
        prev = own[own > 0] - 1
        prev = prev[(s[prev] > c) & ~small[prev]]
        mine = seeds[order[cuts[c] : cuts[c + 1]]]
        prev = np.concatenate([prev, mine[mine > 0] - 1])
        if len(prev):
            _deal(prev, s[prev], head, sa, 1)
    tail = starts[1:] - 1
    last = np.zeros(len(tail), bool)
    for c in np.unique(s)[::-1]:
        if c == s[-1] and not last[c]:
            sa[tail[c]] = len(s) - 1
            tail[c] -= 1
            last[c] = True
        top = starts[c + 1] - 1
        wave = sa[tail[c] + 1 : top + 1][::-1]
        while len(wave):
            prev = wave[wave > 0] - 1
            prev = prev[(s[prev] == c) & small[prev]]
            sa[tail[c] - len(prev) + 1 : tail[c] + 1] = prev[::-1]
            tail[c] -= len(prev)
            wave = prev
        own = np.concatenate([sa[tail[c] + 1 : top + 1][::-1], sa[starts[c] : head[c]][::-1]])
        prev = own[own > 0] - 1
        prev = prev[(s[prev] < c) & small[prev]]
        if len(prev):
            _deal(prev, s[prev], tail, sa, -1)
    return sa


def _named(s: np.ndarray, sorted_lms: np.ndarray, ends: dict | np.ndarray) -> np.ndarray:
    """Whether each leftmost-smaller substring, in order, differs from the one before."""
    a, b = sorted_lms[:-1], sorted_lms[1:]
    size_a, size_b = ends[a] - a, ends[b] - b
    new = size_a != size_b
    live, d = np.flatnonzero(~new), 0
    while len(live):
        other = s[a[live] + d] != s[b[live] + d]
        new[live[other]] = True
        live = live[~other & (size_a[live] > d)]
        d += 1
    return new


def _by_ranks(r: np.ndarray, depth: int) -> np.ndarray:
    """Order of a string of many names by its first `depth` names at least, doubling the ranked length."""
    rank, k, n = r.astype(np.int64), 1, len(r)
    while True:
        nxt = np.zeros(n, np.int64)
        nxt[: n - k] = rank[k:] + 1
        key = rank * (int(rank.max()) + 2) + nxt
        order = np.argsort(key, kind="stable")
        rank = np.empty(n, np.int64)
        rank[order] = np.concatenate([[0], np.cumsum(key[order][1:] != key[order][:-1])])
        k *= 2
        if rank[order[-1]] == n - 1 or k >= min(depth, n):
            return order


def suffix_array(s: np.ndarray, depth: int = 1 << 62) -> np.ndarray:
    """Suffix array of small non-negative numbers whose last is 0 and least, ordered by `depth` of them at least.

    Suffixes are classified, leftmost-smaller substrings are sorted by induction and named, the string of names
    is sorted by the same function (or by ranks if it has very many names), and the rest is induced from it.
    """
    s = np.asarray(s, np.int64)
    n = len(s)
    if n <= 2:
        return np.arange(n)[::-1].copy()
    small = _types(s)
    lms = np.flatnonzero(small[1:] & ~small[:-1]) + 1
    starts = np.concatenate([[0], np.cumsum(np.bincount(s))])
    first = _induce(s, small, lms, starts)
    is_lms = np.zeros(n, bool)
    is_lms[lms] = True
    ordered = first[is_lms[first]]
    ends = np.zeros(n, np.int64)
    ends[lms] = np.concatenate([lms[1:], [n - 1]])
    new = _named(s, ordered, ends)
    name = np.zeros(n, np.int64)
    name[ordered] = np.concatenate([[0], np.cumsum(new)])
    names = name[lms]
    most = int(names.max()) + 1
    if most == len(lms):
        order = np.argsort(names)
    elif most <= NARROW:
        order = suffix_array(names, depth)
    else:
        order = _by_ranks(names, min(depth, len(names)))
    return _induce(s, small, lms[order], starts)


def capped_prefixes(s: np.ndarray, sa: np.ndarray, cap: int) -> tuple[np.ndarray, np.ndarray]:
    """Common prefix of every suffix with the one before it in the array, in text order, and that one's place.

    Permuted: along a run of suffixes whose predecessors follow each other too, only the last is compared;
    the others are one longer each. Values above cap are not exact but stay above it.
    """
    n = len(s)
    phi = np.full(n, -1, np.int64)
    phi[sa[1:]] = sa[:-1]
    here = np.arange(n)
    chained = np.zeros(n, bool)
    chained[:-1] = (phi[:-1] >= 0) & (phi[1:] == phi[:-1] + 1)
    stop = np.full(n, -1, np.int64)
    unlike = (phi < 0) | (s != s[np.maximum(phi, 0)])
    stop[unlike] = here[unlike]
    live = np.flatnonzero(~chained & ~unlike)
    ends, d = live, 1
    stop[ends] = ends + cap + 1
    while len(live) and d <= cap:
        over = np.maximum(live, phi[live]) + d >= n
        same = ~over & (s[np.minimum(live + d, n - 1)] == s[np.minimum(phi[live] + d, n - 1)])
        stop[live[~same]] = live[~same] + d
        live = live[same]
        d += 1
    known = np.flatnonzero(stop >= 0)
    return stop[known[np.searchsorted(known, here)]] - here, phi


def repeated_starts(fragments: list[bytes], span: int) -> list[np.ndarray]:
    """For each fragment, whether the `span` bytes from each place that has so many also begin elsewhere."""
    sizes = np.array([len(f) for f in fragments])
    s = np.zeros(int(sizes.sum()) + len(sizes) + 1, np.int64)
    begins = np.cumsum(sizes + 1) - sizes - 1
    for f, b in zip(fragments, begins.tolist(), strict=True):
        s[b : b + len(f)] = np.frombuffer(f, np.uint8)
        s[b : b + len(f)] += 2
        s[b + len(f)] = 1
    sa = suffix_array(s, span)
    prefix, phi = capped_prefixes(s, sa, span)
    again = np.flatnonzero(prefix >= span)
    mark = np.zeros(len(s), bool)
    mark[again] = True
    mark[phi[again]] = True
    return [mark[b : b + max(0, n - span + 1)] for b, n in zip(begins.tolist(), sizes.tolist(), strict=True)]


def anchors(data: np.ndarray, offsets: np.ndarray, span: int) -> tuple[np.ndarray, ...]:
    """Runs of windows of `span` bytes with one anchor: text, first start, number, and the anchor's hash.

    A window's anchor is its gram with the least hash, the first of equals: equal windows have equal anchors at
    equal places, wherever they are.
    """
    n = len(data)
    none = (np.zeros(0, np.int64),) * 4
    if n < span:
        return none
    h, k = mix64(data.astype(np.uint64) + np.uint64(1)), 1
    power = _BASE
    while k < GRAM:
        h = h[:-k] * np.uint64(power) + h[k:]
        power = power * power & (1 << 64) - 1
        k *= 2
    h = mix64(h)
    bits = max(22, int(n).bit_length())
    best = (h >> np.uint64(bits) << np.uint64(bits)) | np.arange(len(h), dtype=np.uint64)
    wide, k = span - GRAM + 1, 1
    while 2 * k <= wide:
        best = np.minimum(best[:-k], best[k:])
        k *= 2
    if k < wide:
        best = np.minimum(best[: len(best) - (wide - k)], best[wide - k :])
    place = (best & np.uint64((1 << bits) - 1)).astype(np.int64)
    ends = np.repeat(offsets[1:], np.diff(offsets))[: len(place)]
    valid = np.arange(len(place)) + span <= ends
    text = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))[: len(place)]
    cut = np.ones(len(place), bool)
    cut[1:] = (place[1:] != place[:-1]) | (text[1:] != text[:-1]) | (valid[1:] != valid[:-1])
    first = np.flatnonzero(cut)
    number = np.diff(np.concatenate([first, [len(place)]]))
    ok = valid[first]
    first, number = first[ok], number[ok]
    return text[first], first - offsets[text[first]], number, h[place[first]].view(np.int64)


def _bytes(raw: bytes, offsets: np.ndarray):
    return [raw[a:b] for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]


def remove_repeats(docs: DataFrame, span: int = 200) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256: bytes in repeated strings of `span` bytes go.

    Every window of `span` bytes belongs to one anchor, which its bytes alone determine, so equal windows share
    an anchor's hash. Anchors met in one place only rule their windows out. Around the others, the text that
    their windows cover is cut out as a fragment; equal fragments become one with a mark, and the fragments of an
    anchor meet in one shard, whose suffix array and permuted common prefixes give the windows that begin twice.
    Spans and places travel by text digest, whole copies are counted by it, and texts by their first row's id.

    A text of fewer bytes than `span` stays whole. Null is empty. Copies of a text of `span` bytes or more, rows
    equal in doc_id too, all go whole. An empty table gives no rows. Other columns are ignored.
    """
    spark = docs.sparkSession
    small_batches(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    digest = F.unhex(F.md5("text"))

    def find(batches):
        for b in batches:
            for part in pieces(b, "text"):
                data, offsets = utf8(part.column(0))
                text, start, number, h = anchors(data, offsets, span)
                digests = np.array([hashlib.md5(x).digest() for x in _bytes(data.tobytes(), offsets)], dtype=object)
                yield pa.RecordBatch.from_arrays([pa.array(digests[text], pa.binary()), pa.array(h), pa.array(start.astype(np.int32)), pa.array(number.astype(np.int32))], names=["digest", "h", "s", "n"])

    runs = stash(docs.select("text").mapInArrow(find, "digest binary, h long, s int, n int"), "runs")
    place = F.struct("digest", "s")
    shared = runs.groupBy("h").agg(F.min(place).alias("a"), F.max(place).alias("b")).where("a <> b").select("h")
    wanted = runs.join(shared, "h").groupBy("digest").agg(F.collect_set(F.struct("s", "n", "h")).alias("runs"))
    copies = stash(docs.select("doc_id", digest.alias("digest")).groupBy("digest").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies")), "copies")
    wanted = wanted.join(copies, "digest").select(F.coalesce("rep", F.lit(0)).alias("id"), F.col("rep").isNull().alias("none"), "digest", "runs")
    keyed = docs.select(F.coalesce("doc_id", F.lit(0)).alias("id"), F.col("doc_id").isNull().alias("none"), digest.alias("digest"), "text")
    chosen = stash(keyed.join(wanted, ["id", "none", "digest"]).select("digest", "text", "runs"), "repeats")

    def cut(batches):
        for b in batches:
            for part in pieces(b, "text", 1 << 20):
                out: tuple[list, ...] = ([], [], [], [], [])
                data, offsets = utf8(part.column(1))
                for d, raw, own in zip(part.column(0).to_pylist(), _bytes(data.tobytes(), offsets), part.column(2).to_pylist(), strict=True):
                    for run in own:
                        fragment = raw[run["s"] : run["s"] + run["n"] + span - 1]
                        for column, value in zip(out, (run["h"], hashlib.md5(fragment).digest(), d, run["s"], fragment), strict=True):
                            column.append(value)
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, (pa.int64(), pa.binary(), pa.binary(), pa.int32(), pa.binary()), strict=True)], names=["h", "f", "digest", "s", "fragment"])

    fragments = chosen.mapInArrow(cut, "h long, f binary, digest binary, s int, fragment binary")
    places = stash(fragments.select("h", "f", "digest", "s").distinct(), "places")
    kinds = places.groupBy("h", "f").agg(F.min(place).alias("a"), F.max(place).alias("b"), F.count("*").alias("c")).select("h", "f", F.col("a").alias("one"), (F.col("c") > 1).alias("many"))
    only = fragments.join(kinds, ["h", "f"]).where(place == F.col("one")).select("h", "f", "many", "fragment")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def sort(batches):
        held: dict[int, dict[bytes, tuple[bool, bytes]]] = {}
        size = 0

        def done():
            batch = [(f, many, fragment) for group in held.values() for f, (many, fragment) in group.items()]
            meet = [x for group in held.values() if len(group) > 1 for x in group.values()]
            marks = iter(repeated_starts([fragment for _, fragment in meet], span)) if meet else iter(())
            fs, spans = [], []
            for group in held.values():
                for f, (many, fragment) in group.items():
                    mark = next(marks) if len(group) > 1 else np.zeros(len(fragment) - span + 1, bool)
                    if many:
                        mark = np.ones(len(fragment) - span + 1, bool)
                    edges = np.flatnonzero(np.diff(np.concatenate([[0], mark.view(np.int8), [0]])))
                    if len(edges):
                        fs.append(f)
                        spans.append([{"lo": int(a), "hi": int(b) + span - 1} for a, b in zip(edges[::2], edges[1::2], strict=True)])
            assert len(batch) >= len(fs)
            return pa.RecordBatch.from_arrays([pa.array(fs, pa.binary()), pa.array(spans, pa.list_(pa.struct([("lo", pa.int32()), ("hi", pa.int32())])))], names=["f", "spans"])

        for b in batches:
            for h, f, many, fragment in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if h not in held and size >= SHARD:
                    yield done()
                    held, size = {}, 0
                held.setdefault(h, {})[f] = (many, fragment)
                size += len(fragment)
        if held:
            yield done()

    spans = only.repartition(parts, "h").sortWithinPartitions("h").mapInArrow(sort, "f binary, spans array<struct<lo: int, hi: int>>")
    cover = places.join(spans.dropDuplicates(["f"]), "f").groupBy("digest").agg(F.collect_list(F.struct("s", "spans")).alias("cover"))

    def remove(batches):
        for b in batches:
            out: tuple[list, ...] = ([], [], [], [])
            data, offsets = utf8(b.column(1))
            for d, raw, cover in zip(b.column(0).to_pylist(), _bytes(data.tobytes(), offsets), b.column(2).to_pylist(), strict=True):
                edge = np.zeros(len(raw) + 1, np.int32)
                for x in cover:
                    for r in x["spans"]:
                        edge[x["s"] + r["lo"]] += 1
                        edge[x["s"] + r["hi"]] -= 1
                gone = np.cumsum(edge[:-1]) > 0
                kept = np.frombuffer(raw, np.uint8)[~gone].tobytes()
                starts = int(np.count_nonzero(np.diff(np.concatenate([[0], gone.view(np.int8)])) == 1))
                for column, value in zip(out, (d, len(raw) - len(kept), starts, hashlib.sha256(kept).hexdigest()), strict=True):
                    column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, (pa.binary(), pa.int64(), pa.int64(), pa.string()), strict=True)], names=["digest", "removed", "runs", "sha"])

    cut_texts = chosen.join(cover, "digest").select("digest", "text", "cover").mapInArrow(remove, "digest binary, removed long, runs long, sha string").dropDuplicates(["digest"])
    # counted by digest before the rows are joined, so that a text of many copies is one row here
    facts = copies.join(stash(cut_texts, "kept"), "digest", "left").select("digest", "copies", "removed", "runs", "sha")
    rows = docs.select("doc_id", digest.alias("digest"), F.octet_length("text").cast("long").alias("n_bytes"), F.sha2("text", 256).alias("whole")).join(facts, "digest")
    all_gone = (F.col("copies") > 1) & (F.col("n_bytes") >= span)
    return rows.select(
        "doc_id",
        "n_bytes",
        F.when(all_gone, F.col("n_bytes")).otherwise(F.coalesce("removed", F.lit(0))).alias("n_removed"),
        F.when(all_gone, F.lit(1).cast("long")).otherwise(F.coalesce("runs", F.lit(0))).alias("n_spans"),
        F.when(all_gone, F.sha2(F.lit("").cast("binary"), 256)).otherwise(F.coalesce("sha", "whole")).alias("kept_sha256"),
    )
