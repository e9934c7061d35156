"""Vector codes, hash-tree shards and token alignment against brute force."""

import hashlib
import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from leaklens.llm import alignment, codes, queries, sharding

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, key string, shard int, slot long, batch long, stripe int"
ODD = [(1, None), (2, ""), (None, None), (None, "a b"), (3, " "), (4, "  \n "), (5, "a▁b"), (6, "x  y\n\nz \t q\r\n w"), (7, "a\r\nb;\r\nc"), (8, "<|endoftext|> <s> <0x41>"), (9, "　x  y z"), (10, "a" * 5000), (11, "the " * 500_000), (11, "the"), (12, "ﬁ ①é\0 ﻿"), (13, "\n\nab"), (14, "ab\n"), (15, "one two " * 1000 + "▁"), (16, "日本語 テキスト、。 한국어"), (2, ""), (7, "a\r\nb;\r\nc")]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(k, t, "en", "k", 5, 7, 9, 11) for k, t in ODD], SCHEMA)


# --- codes -------------------------------------------------------------------------------------------------------------


def brute_codes(rows, parts=8, entries=16, rounds=6):
    kept = [(i, lab, [math.floor(4096 * float(x)) for x in v]) for i, v, lab in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    if not kept:
        return []
    width = len(kept[0][2]) // parts
    cut = [[v[p * width : (p + 1) * width] for _, _, v in kept] for p in range(parts)]
    ids = sorted({i for i, _, _ in kept if i is not None})
    first = [min(v for i, _, v in kept if i == q) for q in ids[:entries]]
    books = [[f[p * width : (p + 1) * width] for f in first] for p in range(parts)]

    def nearest(p):
        each = [[sum((x - y) ** 2 for x, y in zip(v, e, strict=True)) for e in books[p]] for v in cut[p]]
        return [d.index(min(d)) for d in each], [min(d) for d in each]

    for _ in range(rounds):
        for p in range(parts):
            at, _ = nearest(p)
            for e in range(len(books[p])):
                if own := [v for v, a in zip(cut[p], at, strict=True) if a == e]:
                    books[p][e] = [sum(c) // len(own) for c in zip(*own, strict=True)]
    last = [nearest(p) for p in range(parts)]
    digest = hashlib.sha256(",".join(str(x) for part in books for e in part for x in e).encode()).hexdigest()
    error = [sum(last[p][1][k] for p in range(parts)) for k in range(len(kept))]
    label = Counter()
    for (_, lab, _), e in zip(kept, error, strict=True):
        label[lab] += e
    return sorted((repr(i), "".join(f"{last[p][0][k]:02x}" for p in range(parts)), error[k], label[lab], digest) for k, (i, lab, _) in enumerate(kept))


def found_codes(df):
    return sorted((repr(r["vec_id"]), r["code"], r["error"], r["label_error"], r["codebooks_sha256"]) for r in df.collect())


def test_codes(spark):
    rng, schema = np.random.default_rng(3), "vec_id long, embedding array<float>, label int, id long, block long, error long"
    rows = [(int(i), rng.normal(size=16).astype(np.float32).tolist(), [0, 1, None][i % 3]) for i in rng.permutation(300)]
    rows += [rows[5], rows[5], (None, [0.25] * 16, None), (301, None, 1), (302, [None] + [0.0] * 15, 1), (303, [math.nan] * 16, 1), (304, [math.inf] * 16, 2), (305, [-1e-9] * 16, 2), (3, [-5.0] * 16, 2)]
    df = spark.createDataFrame([(*r, 1, 2, 3) for r in rows], schema)
    assert found_codes(codes.compress(df)) == brute_codes(rows)
    assert found_codes(codes.compress(df.where("vec_id < 7"))) == brute_codes([r for r in rows if r[0] is not None and r[0] < 7])  # fewer than 16
    assert codes.compress(df.limit(0)).count() == 0 and codes.compress(df.where("vec_id in (301, 303)")).count() == 0
    ties = [(i, [float(i % 2)] * 8, None) for i in range(40)]
    assert found_codes(codes.compress(spark.createDataFrame(ties, "vec_id long, embedding array<float>, label int"))) == brute_codes(ties)
    for bad in ([(1, [0.0] * 16, 1), (2, [0.0] * 8, 1)], [(1, [0.0] * 12, 1)], [(1, [4e5] * 16, 1)]):
        with pytest.raises(Exception, match="parts|scale"):
            codes.compress(spark.createDataFrame(bad, "vec_id long, embedding array<float>, label int")).count()


def test_codes_of_the_given_table(spark):
    df = spark.read.parquet(f"{SF}/embeddings.parquet")
    assert found_codes(queries.op12_vector_codes(spark, SF)) == brute_codes([(r["vec_id"], r["embedding"], r["label"]) for r in df.collect()])


def test_rounds_pass_on_changes_only(spark):
    """A second round of settled vectors has no plus and no minus, and blocks meet their codes without an exchange."""
    books = codes.Codebooks([[[0, 0], [10, 10]]])
    x = np.array([[[1, 1]], [[9, 9]], [[5, 5]]], np.int32)

    def turn(old):
        import pyarrow as pa

        batch = pa.RecordBatch.from_arrays([pa.array([4], pa.int64()), pa.array([x.tobytes()], pa.binary()), pa.array([old], pa.binary())], names=["block", "parts", "codes"])
        return [r for b in codes._assign(iter([batch]), books, 1, 2) for r in b.to_pylist()]

    first = turn(None)
    assert first[0]["codes"] == bytes([0, 1, 0]) and [(r["entry"], r["n"], r["sums"]) for r in first[1:]] == [(0, 2, [6, 6]), (1, 1, [9, 9])]
    assert turn(bytes([0, 1, 0]))[1:] == []
    assert [(r["entry"], r["n"], r["sums"]) for r in turn(bytes([0, 1, 1]))[1:]] == [(0, 1, [5, 5]), (1, -1, [-5, -5])]
    tables = codes._Tables(spark)
    blocks, old = (tables.write(spark.range(100).select(F.col("id").alias("block"), F.lit(b"x").alias(c)).repartition(tables.buckets, "block"), c) for c in ("parts", "codes"))
    plan = blocks.join(old.hint("merge"), "block")._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Exchange" not in plan


# --- shards ------------------------------------------------------------------------------------------------------------


def brute_shard(key, leaves, seed=13):
    at = ()
    for depth in range(len(leaves[0][1])):
        weight = defaultdict(float)
        for _, path, w in leaves:
            if path[:depth] == at and w > 0:
                weight[path[: depth + 1]] += w
        draw = lambda node: (int(hashlib.md5(f"{seed}:{'/'.join(map(str, node))}:{key}".encode()).hexdigest()[:13], 16) + 0.5) / 2**52  # noqa: E731, S324
        at = min(weight, key=lambda node: (-math.log(draw(node)) / weight[node], "/".join(map(str, node))))
    return next(s for s, path, _ in leaves if path == at)


def test_shards(spark, odd):
    tree = sharding.tree()
    assert len(tree) == 8 and [s for s, _, _ in sharding.grown(tree)] == list(range(9))
    out = sharding.assign(odd, tree)
    assert out.columns == ["doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"]
    rows = out.collect()
    name = lambda k: "null" if k is None else str(k)
    want = sorted((name(k), len((t or "").encode()) + 1, zlib.crc32((t or "").encode()), "key", brute_shard(name(k), tree), brute_shard(name(k), sharding.grown(tree))) for k, t in ODD)
    assert sorted((name(r["doc_id"]), r["size"], r["text_crc32"], r["law"], r["shard"], r["grown_shard"]) for r in rows) == want
    by = defaultdict(list)
    for r in rows:
        by[r["shard"]].append(r["slot"])
    assert all(sorted(v) == list(range(len(v))) for v in by.values())
    assert sharding.assign(odd.limit(0), tree).count() == 0
    again = sharding.assign(odd.repartition(3), tree).collect()
    assert sorted(map(tuple, again), key=repr) == sorted(map(tuple, rows), key=repr)


def test_shards_move_only_where_weights_change(spark):
    tree = sharding.tree()
    keys = spark.range(4000).select(F.col("id").cast("string").alias("k"))
    changed = sharding.reweighted(tree, {0: 0.0})
    rows = keys.select("k", *[sharding.shard_of(F.col("k"), t).alias(n) for n, t in (("old", tree), ("new", sharding.grown(tree)), ("less", changed), ("double", sharding.reweighted(tree, {5: 2.0})))]).collect()
    n = Counter(r["old"] for r in rows)
    assert sum((n[s] - 500) ** 2 / 500 for s in range(8)) < 30
    assert {r["new"] for r in rows if r["new"] != r["old"]} == {8} and 0.08 < sum(r["new"] == 8 for r in rows) / 4000 < 0.14
    assert not any(r["less"] == 0 for r in rows)
    inner = lambda s: (s // 4, s // 2 % 2)
    for r in rows:  # with less of shard 0, nothing enters its subtrees; within the others nothing moves among siblings
        if r["less"] != r["old"] and inner(r["less"]) == inner(r["old"]):
            assert r["old"] == 0
        if r["double"] != r["old"] and r["old"] // 4 == 0:
            assert r["double"] // 4 == 1  # out of the other region into the heavier one only
    assert sum(r["double"] == 5 for r in rows) > 1.4 * n[5]


def test_many_copies_of_a_row(spark, monkeypatch):
    monkeypatch.setattr(sharding, "COPIES", 10)
    monkeypatch.setattr(sharding, "ORDERED", 5)
    rows = spark.range(95).select(F.when(F.col("id") < 57, None).otherwise(F.col("id")).alias("doc_id"), F.lit("same").alias("text"))
    out = sharding.assign(rows, sharding.tree(1, 1, 2)).collect()
    by = defaultdict(list)
    for r in out:
        by[r["shard"]].append(r["slot"])
    assert len(out) == 95 and all(sorted(v) == list(range(len(v))) for v in by.values())


def test_written_shards(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = sharding.write_shards(docs, sharding.tree(), str(tmp_path / "shards"))
    placed = {r["doc_id"]: r["shard"] for r in queries.op13_hash_tree_shards(spark, SF).collect()}
    assert {r["doc_id"]: r["shard"] for r in out.collect()} == placed
    assert sorted(map(tuple, out.select(docs.columns).collect())) == sorted(map(tuple, docs.collect()))


# --- alignment ---------------------------------------------------------------------------------------------------------

A = Tokenizer.from_file(queries.BYTE_LEVEL)
A.encode_special_tokens = True
B = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
OWN = [*range(33, 127), *range(161, 173), *range(174, 256)]
LETTER = {chr(b): b for b in OWN} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in OWN)}


def brute_groups(text):
    """Both libraries on the whole text: groups of ids, or None."""
    if not text:
        return None
    a, b = A.encode(" " + text, add_special_tokens=False), B.encode(text)
    ids, names = a.ids, [B.id_to_piece(i) for i in b]
    sides = [bytes(LETTER[c] for c in x) for x in a.tokens], [bytes([int(p[3:5], 16)]) if B.is_byte(i) else p.replace("▁", " ").encode() for i, p in zip(b, names, strict=True)]
    if any(b"".join(s) != (" " + text).encode() for s in sides):
        return None
    ends = [np.cumsum([len(x) for x in s]).tolist() for s in sides]
    out, i, j = [], 0, 0
    for stop in sorted(set(ends[0]) & set(ends[1])):
        to_i, to_j = ends[0].index(stop, i) + 1, ends[1].index(stop, j) + 1
        out.append((ids[i:to_i], b[j:to_j]))
        i, j = to_i, to_j
    return out


def said(groups):
    return ";".join(f"{','.join(map(str, a))}|{','.join(map(str, b))}" for a, b in groups)


def brute_alignment(rows):
    each, count, best = [(k, brute_groups(t)) for k, t in rows], Counter(), Counter()
    for _, g in each:
        count.update({(x, y) for a, b in g or () for x in a for y in b})
    for (x, _), n in count.items():
        best[x] = max(best[x], n)
    out = []
    for k, g in each:
        links = [(x, y) for a, b in g or () for x in a for y in b]
        sizes = [sum(len(a) for a, _ in g or ()), sum(len(b) for _, b in g or ()), len(g or ()), len(links), sum(count[p] == best[p[0]] for p in links), sum(count[p] for p in links)]
        out.append((repr(k), *sizes, hashlib.sha256(said(g).encode()).hexdigest() if g else ""))
    return sorted(out)


def found_alignment(df):
    return sorted((repr(r["doc_id"]), *r[1:]) for r in df.collect())


def test_alignment(spark, odd, monkeypatch):
    want = brute_alignment(ODD)
    assert found_alignment(alignment.align_tokens(odd, queries.BYTE_LEVEL, queries.PIECES)) == want
    monkeypatch.setattr(alignment, "REQUESTS", 1)  # every stripe is added up in parts
    assert found_alignment(alignment.align_tokens(odd.repartition(7), queries.BYTE_LEVEL, queries.PIECES)) == want
    assert alignment.align_tokens(odd.limit(0), queries.BYTE_LEVEL, queries.PIECES).count() == 0
    assert found_alignment(alignment.align_tokens(odd.where("doc_id in (1, 2, 5)"), queries.BYTE_LEVEL, queries.PIECES)) == brute_alignment([x for x in ODD if x[0] in (1, 2, 5)])


def test_alignment_of_the_given_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    assert found_alignment(queries.op11_token_alignment(spark, SF)) == brute_alignment([tuple(r) for r in docs])


def test_pair_counts(spark):
    docs = spark.createDataFrame([(1, "some words"), (2, "some some"), (3, "words")], "doc_id long, text string")
    got = {(r["a"], r["b"]): (r["documents"], r["best"]) for r in alignment.pair_counts(alignment.link_tokens(docs, queries.BYTE_LEVEL, queries.PIECES), queries.BYTE_LEVEL, queries.PIECES).collect()}
    count = Counter(p for t in ("some words", "some some", "words") for p in {(x, y) for a, b in brute_groups(t) for x in a for y in b})
    assert {k: v[0] for k, v in got.items()} == dict(count)
    assert all(best == (n == max(m for (x, _), (m, _) in got.items() if x == a)) for (a, _), (n, best) in got.items())


def by_chunks(text):
    own = alignment.aligner(queries.BYTE_LEVEL, queries.PIECES)
    assert own.by_chunk and own.ranked
    parts = [own.said[i] for i in own.ids(own.chunks(text))]
    return None if None in parts else b";".join(parts).decode()


@settings(max_examples=300, deadline=None)
@given(st.text(st.one_of(st.sampled_from("ab.'s \n\t\r;)é1▁ 　"), st.characters(codec="utf-8")), min_size=1, max_size=40))
def test_chunks_are_aligned_as_the_whole_text(text):
    want = brute_groups(text)
    assert by_chunks(text) == (None if want is None else said(want))


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 1 << 40), max_size=30))
def test_numbers_round_trip(x):
    assert alignment.unpacked(alignment.packed(np.array(x, np.int64))).tolist() == x
