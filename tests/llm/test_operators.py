"""Operators against brute force, with nulls, empty and repeated rows, ties and clashing columns."""

import glob
import hashlib
import html.parser
import json
import os
import re
import time
import zlib

import duckdb
import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from leaklens.llm import chunks, extraction, fingerprints, language, mixing, packing, queries, shared, shingles, suffixes, tokens, vectors

SF = "/root/testdata/sf0.001"
VOCABULARY = public_tokenizers.path("word_bpe_49k.json")
WORDS = re.compile(r"[^\x20\x09-\x0D]+")
RNG = np.random.default_rng(5)
VOCAB = ["".join(RNG.choice(list("abcdefgh"), RNG.integers(2, 9))) for _ in range(300)]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, digest string, n int, h long"


def prose(n, seed):
    return " ".join(np.random.default_rng(seed).choice(VOCAB, n))


def texts():
    base = [prose(120, i) for i in range(12)]
    passage = prose(70, 99)
    near = base[0].split()
    near[60] = "changed"
    out = {1: base[0], 2: base[0], 3: " ".join(near), 4: None, 5: "", 6: "ONE two", 7: "one  TWO", 8: passage + " " + base[1], 9: base[2] + "\n" + passage, 10: passage, 11: "é" * 500, 12: "aé" * 300, 13: " \t\n", 14: "Ça <|endoftext|> it's 12 ﬁne   ñ !!", 15: "word " * 900}
    return out | {20 + i: t for i, t in enumerate(base[3:])}


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(k, t, "en", ["a", "b", None][k % 3], 0, "x", 1, 2) for k, t in texts().items()]
    return spark.createDataFrame([*rows, (None, None, None, None, None, None, None, None), rows[7]], SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def all_texts():
    return [*texts().items(), (None, None), (8, texts()[8])]


def test_token_counts(docs, empty, tmp_path):
    spark, library, cache = docs.sparkSession, Tokenizer.from_file(VOCABULARY), str(tmp_path / "cache")
    want = sorted((repr(k), len((t or "").encode()), len(library.encode(t or "", add_special_tokens=False).ids)) for k, t in all_texts())

    def stored(path=VOCABULARY):
        return spark.read.parquet(f"{cache}/version={tokens.counter(path)[0]}").count()

    count = lambda df, path=VOCABULARY: sorted((repr(r["doc_id"]), r["n_bytes"], r["n_tokens"]) for r in tokens.count_tokens(df, path, cache).collect())
    assert count(docs) == want
    first = stored()
    assert first == len({re.sub(r"[\x20\x09-\x0D]+", " ", t or "").strip(" ") for _, t in all_texts()})
    assert count(docs) == want and stored() == first  # nothing is encoded again
    more = spark.createDataFrame([(1, "  ONE\t two "), (2, "quite new")], "doc_id long, text string")
    assert [x[2] for x in count(more)] == [2, 2] and stored() == first + 1
    other = public_tokenizers.path("byte_bpe_50k.json")  # another version has no counts yet, and counts white space
    library = Tokenizer.from_file(other)
    assert count(docs, other) == sorted((repr(k), len((t or "").encode()), len(library.encode(t or "", add_special_tokens=False).ids)) for k, t in all_texts())
    assert stored(other) == len({t or "" for _, t in all_texts()}) and stored() == first + 1
    assert tokens.count_tokens(empty, VOCABULARY).count() == 0 and tokens.count_tokens(empty, VOCABULARY, str(tmp_path / "none")).count() == 0


def test_token_counts_of_a_piece_model(docs):
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    library = sentencepiece.SentencePieceProcessor(model_file=path)
    got = sorted((repr(r["doc_id"]), r["n_tokens"]) for r in tokens.count_tokens(docs, path).collect())
    assert got == sorted((repr(k), len(library.encode(t or ""))) for k, t in all_texts())


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=60))
def test_encoder_is_the_library(text):
    own = tokens.encoder(VOCABULARY)
    assert np.frombuffer(own.ids(text), "<u4").tolist() == own.library.encode(text, add_special_tokens=False).ids


@settings(max_examples=100, deadline=None)
@given(st.lists(st.none() | st.text("abhinorstTé ÀßÑ.,'_-?09 \n", max_size=80), max_size=6))
def test_columns_of_plain_texts_need_no_library(texts):
    own = tokens.encoder(VOCABULARY)
    with pytest.MonkeyPatch.context() as m:
        m.setattr(own, "_library", lambda text: pytest.fail(f"asked for {text!r}"))
        ids, ends = own.encode(pa.array(texts, pa.string()))
    assert [x.tolist() for x in np.split(ids, ends)[:-1]] == [own.library.encode(t or "", add_special_tokens=False).ids for t in texts]


@pytest.mark.parametrize("merges, by_rank", [(["a b", "ab c</w>"], True), (["b c</w>", "a b", "ab c</w>"], False), (["a b", "b c", "a bc"], False)])
def test_encoder_of_merges_that_ranks_do_not_give(tmp_path, merges, by_rank):
    """In the second file the library never forms abc, as bc comes first; in the third ab comes before bc does."""
    steps, letters = json.loads(open(VOCABULARY, encoding="utf-8").read()), tokens._byte_letters().values()
    pieces = [*letters, *[x + "</w>" for x in letters], *[m.replace(" ", "") for m in merges]]
    steps["model"] |= {"vocab": {x: i for i, x in enumerate(pieces)}, "merges": [m.split() for m in merges]}
    steps["added_tokens"] = []
    path = tmp_path / "few.json"
    path.write_text(json.dumps(steps), encoding="utf-8")
    own = tokens.WordEncoder(str(path))
    assert (own.ranked is not None) == by_rank
    for text in ("abc ab bc c", "xabc abcx ABC,abc", "é abc日 abc"):
        assert np.frombuffer(own.ids(text), "<u4").tolist() == own.library.encode(text, add_special_tokens=False).ids


@settings(max_examples=100, deadline=None)
@given(st.dictionaries(st.integers(1, 40), st.integers(1, 30), max_size=12))
def test_packing_plan(counts):
    runs, bins, fixed = packing.plan(counts, 40)
    filled, seen = {}, {}
    for length, rank, n, first, offset, each in runs:
        for t in range(n):
            filled.setdefault(first + t // each, []).append((offset + t % each * length, length))
            seen.setdefault(length, set()).add(rank + t)
    assert {k: len(v) for k, v in seen.items()} == counts and set(filled) == set(range(bins)) and fixed <= bins
    for pieces in filled.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 40
    total = sum(k * v for k, v in counts.items())
    assert bins <= 11 / 9 * -(-total // 40) + 2 + sum(v for k, v in counts.items() if k > 20)


@pytest.mark.parametrize("room", [40, 256])
def test_pack(docs, empty, room):
    rows = packing.pack(docs, VOCABULARY, room).collect()
    library = Tokenizer.from_file(VOCABULARY)
    want = []
    for k, t in all_texts():
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 1]
        for piece, start in enumerate(range(0, len(ids), room)):
            part = np.array(ids[start : start + room], "<u4")
            want.append((repr(k), piece, start, len(part), zlib.crc32(part.tobytes())))
    assert sorted((repr(r["doc_id"]), r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows) == sorted(want)
    by = {}
    for r in rows:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert all(sum(n for _, n in v) <= room and [o for o, _ in sorted(v)] == list(np.cumsum([0, *[n for _, n in sorted(v)]])[:-1]) for v in by.values())
    lengths = [w[3] for w in want]  # no bound below: tokens by room, and pieces of which no two go together
    assert len(by) <= 11 / 9 * max(-(-sum(lengths) // room), sum(n > room / 2 for n in lengths)) + 1
    assert packing.pack(empty, VOCABULARY).count() == 0


def test_best_fit_reaches_the_fewest(spark):
    def fewest(lengths, room):  # by trying everything
        best = len(lengths)

        def go(i, bins):
            nonlocal best
            if len(bins) >= best:
                return
            if i == len(lengths):
                best = len(bins)
                return
            for x in sorted(set(bins)):
                if x + lengths[i] <= room:
                    rest = list(bins)
                    rest[rest.index(x)] += lengths[i]
                    go(i + 1, rest)
            go(i + 1, [*bins, lengths[i]])

        go(0, [])
        return best

    rng = np.random.default_rng(8)
    for _ in range(60):
        lengths = sorted(rng.integers(1, 20, rng.integers(1, 9)).tolist(), reverse=True)
        runs, bins, _ = packing.plan({n: lengths.count(n) for n in set(lengths)}, 20)
        assert fewest(lengths, 20) <= bins <= fewest(lengths, 20) + 1


def test_apportion():
    assert mixing.apportion([53, 24, 23], 7) == [3, 2, 2]
    assert mixing.apportion([0, 0], 3) == [0, 0] and sum(mixing.apportion([1, 1, 1], 10)) == 10
    t = mixing.targets([100, 1000, 10], (5, 2, 1), 1.5, 2.0)
    assert abs(sum(t) - 1665) < 1e-6 and all(a <= 2 * b + 1e-9 for a, b in zip(t, [100, 1000, 10], strict=True))


def test_mix(docs, empty):
    a = mixing.mix(docs, block=16).collect()
    assert sorted(map(repr, a)) == sorted(map(repr, mixing.mix(docs, block=16).collect()))
    assert len(a) == len(all_texts()) and all(0 <= r["taken"] <= 2 * r["size"] for r in a)
    for source in {r["source"] for r in a}:
        own = [r for r in a if r["source"] == source]
        assert abs(sum(r["taken"] for r in own) - own[0]["target"]) <= 32
    assert mixing.mix(empty).count() == 0


def test_mix_by_brute_force(spark):
    rng = np.random.default_rng(6)
    rows = [(i, prose(int(rng.integers(0, 60)), i), f"s{int(rng.integers(0, 5)) ** 2 % 7}") for i in range(200)]
    rows += [(300, prose(15, 1), "tiny"), (301, prose(40, 2), "small"), (302, prose(100, 3), "z"), (303, None, None), (304, "a b", None), (302, prose(90, 4), "z")]
    got = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    size = [len(WORDS.findall(t or "")) for _, t, _ in rows]
    assert sorted(zip([r[0] for r in rows], size, strict=True)) == sorted((r["doc_id"], r["size"]) for r in got)
    names = [*sorted({s for _, _, s in rows if s}), None]
    own = [sum(n for n, r in zip(size, rows, strict=True) if r[2] == s) for s in names]
    want, left, free = [0.0] * len(own), 1.5 * sum(own), set(range(len(own)))
    while free:  # the contract word by word, a source at a time
        weight = {i: (5, 2, 1)[i % 3] for i in free}
        over = [i for i in free if left * weight[i] / sum(weight.values()) > 2 * own[i]]
        for i in over or free:
            want[i] = 2.0 * own[i] if over else left * weight[i] / sum(weight.values())
        left -= sum(want[i] for i in over)
        free -= set(over) or set(free)
    for name, n, aim in zip(names, own, want, strict=True):
        mine = [r for r in got if r["source"] == name]
        assert {r["source_size"] for r in mine} == {n} and all(abs(r["target"] - aim) < 1e-6 for r in mine)
        taken = sum(r["taken"] for r in mine)
        assert abs(taken - aim) <= max(64, 0.04 * aim) if aim > 2048 else abs(taken - aim) <= max(2, 0.07 * aim)
        for r in mine:
            assert r["taken"] <= 2 * r["size"] and r["taken"] == r["passes"] * r["size"] + sum(x["hi"] - x["lo"] for x in r["spans"])
            assert all(0 <= x["lo"] < x["hi"] <= r["size"] for x in r["spans"]) and (r["size"] or not r["spans"])
    assert mixing.apportion([float(x) for x in own], 50) == sainte_lague(own, 50)


def sainte_lague(votes, seats):
    got = [0] * len(votes)
    for _ in range(seats):
        i = max(range(len(votes)), key=lambda i: (votes[i] / (2 * got[i] + 1), -i))
        got[i] += 1
    return got


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 500), min_size=1, max_size=8), st.integers(0, 60))
def test_apportion_seat_by_seat(votes, seats):
    if sum(votes):
        assert mixing.apportion(votes, seats) == sainte_lague(votes, seats)


def test_many_sources_at_once():
    sizes = list(range(1, 100_001))
    assert abs(sum(mixing.targets(sizes, (5, 2, 1), 1.5, 2.0)) - 1.5 * sum(sizes)) < 1


def shingle_set(t):
    w = WORDS.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def test_jaccard_components(docs, empty):
    sets = {k: shingle_set(t) for k, t in texts().items()}
    root = {k: k for k in sets}
    for _ in sets:
        for a in sets:
            for b in sets:
                if a != b and sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                    root[a] = root[b] = min(root[a], root[b])
    got = {(r["doc_id"], r["n_shingles"], r["component_id"]) for r in shingles.jaccard_components(docs).collect()}
    assert got == {(k, len(sets[k]), root[k]) for k in sets} | {(None, 0, None)}
    assert shingles.jaccard_components(empty).count() == 0


def test_jaccard_variants_in_several_components(spark):
    base, rng = prose(150, 7).split(), np.random.default_rng(11)
    rows = {}
    for i in range(90):
        words = list(base)
        for at in rng.choice(150, int(rng.integers(0, 12)), replace=False):
            words[at] = f"w{rng.integers(4) if i % 2 else i}"
        rows[i] = " ".join(words)
    sets = {k: shingle_set(t) for k, t in rows.items()}
    links = [(a, b) for a in sets for b in sets if a < b and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    root = {k: k for k in sets}
    for _ in sets:
        for a, b in links:
            root[a] = root[b] = min(root[a], root[b])
    assert 2 < len(set(root.values())) < 90
    got = shingles.jaccard_components(spark.createDataFrame([*rows.items()], "doc_id long, text string"))
    assert {r["doc_id"]: r["component_id"] for r in got.collect()} == root


def brute_components(rows):
    """Components of (doc_id, text) rows by all pairs; rows of one id are one document."""
    sets = [(k, shingle_set(t)) for k, t in rows]
    root = {k: k for k, _ in sets}

    def top(x):
        return x if root[x] == x else top(root[x])

    for i, (a, s) in enumerate(sets):
        for b, t in sets[:i]:
            if s and 100 * len(s & t) >= 75 * len(s | t):
                x, y = top(a), top(b)
                root[max(x, y)] = min(x, y)
    return sorted((k, len(s), top(k)) for k, s in sets)


def many_variants():
    """A text in 700 variants of 0 to 14 changed words, whose lists exceed every block, and what shares a passage with it."""
    base, rng = prose(150, 7).split(), np.random.default_rng(11)
    rows = []
    for i in range(700):
        words = list(base)
        for at in rng.choice(150, int(rng.integers(0, 15)), replace=False):
            words[at] = f"w{rng.integers(4) if i % 2 else i}"
        rows.append((i, " ".join(words)))
    rows += [(700 + i, " ".join(base[: 30 + i]) + " " + prose(60, 100 + i)) for i in range(40)]
    return [*rows, (3, prose(40, 500)), (900, prose(40, 500))]


def test_jaccard_large_lists(spark, monkeypatch):
    rows = many_variants()
    want = brute_components(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = sorted(tuple(r) for r in shingles.jaccard_components(docs).select("doc_id", "n_shingles", "component_id").collect())
    assert got == want and len({r[2] for r in want}) > 40
    monkeypatch.setattr(shingles, "SPLIT", 40)  # long lists in pairs of blocks
    assert sorted(tuple(r) for r in shingles.jaccard_components(docs).select("doc_id", "n_shingles", "component_id").collect()) == want


def test_leads_across_batches(spark):
    rng = np.random.default_rng(2)
    rows = [(int(t), int(i), int(n), int(rng.integers(0, n // 4 + 1))) for i, n in enumerate(rng.integers(5, 60, 200)) for t in set(rng.integers(0, 25, 6).tolist())]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        got = shingles._leads(spark.createDataFrame(rows, "token long, id long, n int, at int"), 75).collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    pairs, more, sizes = set(), set(), set()
    for t in {r[0] for r in rows}:
        own = sorted((at, n, i) for token, i, n, at in rows if token == t)
        at, n, lead = own[0]
        pairs |= {(lead, i) for a, m, i in own[1:] if min(n - at, m - a) * 175 >= 75 * (n + m)}
        if len(own) > 2:
            more |= {(t, i, m, a) for a, m, i in own[1:]}
            sizes.add((t, len(own) - 1))
    assert {(r["a"], r["b"]) for r in got if r["kind"] == 0} == pairs
    assert sorted((r["token"], r["a"], r["n"], r["at"]) for r in got if r["kind"] == 1) == sorted(more)
    assert sorted((r["token"], r["n"]) for r in got if r["kind"] == 2) == sorted(sizes)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sets(st.integers(0, 12), min_size=1), min_size=3, max_size=5))
def test_derived_answers_hold(sets):
    r, *others = sets
    for x in others:
        for y in others:
            sx, sy = len(x & r), len(y & r)
            assert sx + sy - len(r) <= len(x & y) <= min(sy + len(x) - sx, sx + len(y) - sy)


def test_derive(spark):
    known = spark.createDataFrame([(1, 2, 90, 100, 100), (1, 3, 95, 100, 100), (1, 4, 50, 100, 100)], "a long, b long, s long, na long, nb long")
    sizes = spark.createDataFrame([(i, 100) for i in range(1, 6)], "id long, n long")
    pairs = spark.createDataFrame([(2, 3), (3, 4), (2, 5), (1, 2)], "a long, b long")
    got = {(r["a"], r["b"]): r["sure"] for r in shingles.derive(pairs, known, sizes, 75).collect()}
    assert got == {(2, 3): False, (2, 5): False}  # 85 shared at least, 86 needed; 3 and 4 share 55 at most
    known = known.union(spark.createDataFrame([(1, 5, 98, 100, 100)], known.schema))
    assert {(r["a"], r["b"]): r["sure"] for r in shingles.derive(pairs, known, sizes, 75).collect()}[2, 5] is True


def test_components_of_many_edges(spark, monkeypatch):
    rng = np.random.default_rng(4)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 400, (260, 2))] + [(500 + i, 501 + i) for i in range(60)] + [(None, 1)]
    want = {}
    root = {x: x for e in edges for x in e if x is not None}
    for _ in root:
        for a, b in edges:
            if a is not None:
                root[a] = root[b] = min(root[a], root[b])
    want = {x: root[x] for a, b in edges if a is not None and a != b for x in (a, b)}
    table = spark.createDataFrame(edges, "a long, b long")
    assert {r["id"]: r["component"] for r in shared.components(table).collect()} == want
    monkeypatch.setattr(shared, "FOREST", 50)
    assert {r["id"]: r["component"] for r in shared.components(table).collect()} == want


def test_fingerprints(docs, empty, spark):
    rows = fingerprints.edited_pairs(docs).collect()
    assert len(rows) == len(all_texts())
    order = [t or "" for _, t in sorted(texts().items(), reverse=True)] + [""]
    want = {}
    for i, (k, t) in enumerate([*sorted(texts().items(), reverse=True), (None, None)]):
        t, nxt = t or "", order[(i + 1) % len(order)]
        want[k] = hashlib.sha256((t[: len(t) - len(t) // 2] + nxt[: len(t) // 2]).encode()).hexdigest()
    assert {(r["doc_id"], r["edited_sha256"]) for r in rows} == set(want.items())
    prints = {r["doc_id"]: r["fingerprint"] for r in rows}
    assert prints[1] == prints[2] != prints[3] and prints[4] == prints[5] == ""
    assert fingerprints.edited_pairs(empty).count() == 0

    def shingled(t):
        w = WORDS.findall(t)
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()

    chain = sorted(texts().items(), reverse=True)
    for i, (k, t) in enumerate(chain):  # the true likeness, within four standard errors of a sketch of 128
        t, nxt = t or "", chain[i + 1][1] or "" if i + 1 < len(chain) else ""
        other = t[: len(t) - len(t) // 2] + nxt[: len(t) // 2]
        for name, x in (("near_edited", other), ("near_next", nxt)):
            both = shingled(t) | shingled(x)
            true = len(shingled(t) & shingled(x)) / len(both) if both else 1.0
            got = next(r for r in rows if r["doc_id"] == k)[name]
            assert abs(got - true) <= (4 * (true * (1 - true) / 128) ** 0.5 + 0.02 if len(both) > 128 else 1e-9), (k, name)
    parts = spark.createDataFrame([(prose(500, 1), prose(500, 2), prose(500, 1) + " " + prose(500, 2))], "a string, b string, c string")
    one = parts.select(fingerprints.merge(*[fingerprints.sketch(F.col(c)) for c in "ab"]).alias("m"), fingerprints.containment(fingerprints.sketch(F.col("a")), fingerprints.sketch(F.col("c"))).alias("inside"), fingerprints.resemblance(fingerprints.merge(*[fingerprints.sketch(F.col(c)) for c in "ab"]), fingerprints.sketch(F.col("c"))).alias("like")).first()
    assert one["m"] == sorted(one["m"]) and len(one["m"]) == 128 and one["inside"] > 0.8 and one["like"] > 0.97
    whole = spark.createDataFrame([(1, prose(2000, 1)), (1, prose(2000, 2)), (2, prose(3000, 3))], "g int, text string").withColumn("sketch", fingerprints.sketch(F.col("text")))
    folded = fingerprints.fold(whole, ["g"]).withColumn("n", fingerprints.distinct_count(F.col("sketch"))).orderBy("g").collect()
    assert abs(folded[0]["n"] / 3992 - 1) < 0.3 and abs(folded[1]["n"] / 2996 - 1) < 0.3


def test_suffix_array():
    rng = np.random.default_rng(1)
    for _ in range(150):
        x = np.concatenate([rng.integers(1, rng.integers(2, 5), rng.integers(1, 50)), [0]])
        sa = suffixes.suffix_array(x)
        assert sa.tolist() == sorted(range(len(x)), key=lambda i: x[i:].tolist())


def test_suffix_array_of_many_names(monkeypatch):
    """Both ways of ordering a reduced string, by induction and by ranks, give the order of the suffixes."""
    rng, ranked = np.random.default_rng(2), []
    monkeypatch.setattr(suffixes, "_by_ranks", lambda r, depth, own=suffixes._by_ranks: ranked.append(len(r)) or own(r, depth))
    passage = rng.integers(1, 200, 700)
    x = np.concatenate([rng.integers(1, 250, 5000), passage, rng.integers(1, 250, 2000), passage, [0]])
    want = sorted(range(len(x)), key=lambda i: x[i:].tolist())
    assert suffixes.suffix_array(x).tolist() == want and ranked and max(ranked) > suffixes.NARROW
    ranked.clear()
    monkeypatch.setattr(suffixes, "NARROW", 1 << 30)
    assert suffixes.suffix_array(x).tolist() == want and not ranked


def test_remove_repeats(docs, empty):
    span, rows = 200, [(k, (t or "").encode()) for k, t in all_texts()]
    seen = {}
    for _, b in rows:
        for j in range(len(b) - span + 1):
            seen[b[j : j + span]] = seen.get(b[j : j + span], 0) + 1
    want = []
    for k, b in rows:
        gone = np.zeros(len(b), bool)
        for j in range(len(b) - span + 1):
            if seen[b[j : j + span]] > 1:
                gone[j : j + span] = True
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        want.append((repr(k), len(b), int(gone.sum()), int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum()), hashlib.sha256(kept).hexdigest()))
    got = [(repr(r["doc_id"]), r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in suffixes.remove_repeats(docs).collect()]
    assert sorted(got) == sorted(want)
    assert suffixes.remove_repeats(empty).count() == 0


def test_chunk_dedup(docs, empty):
    rows = [r for r in chunks.dedup_substrings(docs).collect()]
    assert len(rows) == len(all_texts()) and set(docs.columns) < set(rows[0].asDict())
    by = {r["doc_id"]: r for r in rows}
    assert by[2]["text"] == "" and by[1]["n_removed"] == 0 and by[4]["text"] is None
    passage = len(texts()[10])
    assert by[9]["n_removed"] > 0.6 * passage and by[9]["text"].startswith(texts()[9][:200])
    assert by[10]["n_removed"] > 0.6 * passage and by[25]["n_removed"] == 0
    assert chunks.dedup_substrings(empty).count() == 0


def test_vectors(spark):
    rng = np.random.default_rng(2)
    base = rng.normal(size=(60, 32))
    x = [*base, *(base[:20] + rng.normal(size=(20, 32)) * 0.15), *base[:5], *(base[40] + rng.normal(size=(30, 32)) * 0.2)]
    rows = [(i, [float(v) for v in r], 1, "x") for i, r in enumerate(x)]
    n = len(rows)
    odd = [(n, None, 1, "x"), (n + 1, [0.0] * 32, 1, "x"), (n + 2, [float("nan")] * 32, 1, "x"), (n + 3, [1.0, 2.0], 1, "x"), (None, [1.0] * 32, 1, "x"), (n + 4, [None] * 32, 1, "x")]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>, copies int, v string")
    unit = np.array(x, np.float32).astype(float)
    unit /= np.linalg.norm(unit, axis=1)[:, None]
    link = unit @ unit.T >= 0.95
    np.fill_diagonal(link, False)
    label = np.arange(n)
    for _ in range(n):
        label = np.array([min([label[i], *label[link[i]]]) for i in range(n)])
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in vectors.near_vectors(df).collect()}
    assert {i: got[i] for i in range(n)} == {i: (int(link[i].sum()), int(label[i]), bool(label[i] == i)) for i in range(n)}
    assert got[n] == (0, n, True) and got[n + 3] == (0, n + 3, True) and got[None] == (0, None, False)
    assert vectors.near_vectors(df.limit(0)).count() == 0


def test_vectors_of_any_size(spark):
    tiny, huge = [1e-200, 0.0, 0.0, 0.0], [1e200, 1e200, 0.0, 0.0]
    rows = [(1, tiny), (2, [3.0, 0.01, 0.0, 0.0]), (3, huge), (4, [1.0, 1.0, 0.0, 0.0]), (5, [5e-324, 0.0, 0.0, 0.0]), (6, [0.0, 0.0, -1e308, 1.0]), (7, [0.0, 0.0, -2.0, 0.0])]
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in vectors.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    assert got == {1: (2, 1), 2: (2, 1), 5: (2, 1), 3: (1, 3), 4: (1, 3), 6: (1, 6), 7: (1, 6)}


def test_vectors_in_a_dense_cell(spark):
    rng = np.random.default_rng(12)
    x = np.concatenate([rng.normal(size=16) + rng.normal(size=(3000, 16)) * 0.12, rng.normal(size=(500, 16))])
    unit = x / np.linalg.norm(x, axis=1)[:, None]
    link = unit @ unit.T >= 0.95
    np.fill_diagonal(link, False)
    got = {r["vec_id"]: r for r in vectors.near_vectors(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")).collect()}
    assert all(got[i]["n_links"] == n for i, n in enumerate(link.sum(1)))
    label = np.arange(len(x))
    for _ in range(8):
        label = np.array([min(label[i], label[link[i]].min(initial=i)) for i in range(len(x))])
    assert all(got[i]["component_id"] == c for i, c in enumerate(label))


def test_vectors_in_tiles_of_groups(spark, monkeypatch):
    """Whatever the vectors, each goes to as many tiles as there are groups, and pairs in different groups are found once."""
    monkeypatch.setattr(vectors, "FEW_ROWS", 60)
    rng = np.random.default_rng(21)
    x = rng.normal(size=(900, 64)).astype(np.float32)
    x[600:] = x[rng.integers(0, 200, 300)] + (rng.normal(size=(300, 64)) * 0.2).astype(np.float32)
    unit = x.astype(float) / np.linalg.norm(x.astype(float), axis=1)[:, None]
    link = unit @ unit.T >= 0.95
    np.fill_diagonal(link, False)
    kept, stash = {}, vectors.stash

    def watched(df, name, *by):
        kept[name] = df
        return stash(df, name, *by)

    monkeypatch.setattr(vectors, "stash", watched)
    got = {r["vec_id"]: r for r in vectors.near_vectors(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")).collect()}
    label = np.arange(len(x))
    for _ in range(10):
        label = np.array([min(label[i], label[link[i]].min(initial=i)) for i in range(len(x))])
    assert link.sum() > 300 and {i: (r["n_links"], r["component_id"]) for i, r in got.items()} == {i: (int(link[i].sum()), int(label[i])) for i in range(len(x))}
    space = vectors._Space(unit, 0.95, len(x))
    assert max(map(len, space.pivots)) <= vectors.MOST_PIVOTS
    # counts and edges per tile, not per pair: no more rows than vectors have tiles, twice
    assert kept["near"].count() <= 2 * vectors.GROUPS * len(x)


def test_components(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(1, 60)] + [(100, 101), (None, 3), (7, 7)], "a long, b long")
    got = dict(map(tuple, shared.components(edges).collect()))
    assert got == {i: 1 for i in range(1, 61)} | {100: 100, 101: 100}


PAGE = "<!DOCTYPE html><html lang='en'><head><title>T</title></head><body><header>Site</header><nav><a href='/'>Home</a></nav><div class='cookie-notice'>We use cookies</div><div class='{c}'><h1>Title &amp; more</h1><p>First  para\n with <b>bold</b>&nbsp;text.<p>Second one, long enough to matter here.<script>x</script></div><aside>Side</aside><section id='comments'><p>Nice!</p></section><footer>Foot</footer></body></html>"


def test_extract(spark):
    pages = [(i, f"http://h.example/{i}", PAGE.format(c=f"post post-{i}"), "x") for i in range(4)] + [(8, None, None, "x"), (9, "junk", "", "x"), (10, "http://h.example/x", "<p>Only <!-- c", "x")]
    got = {r["page_id"]: (r["text"], r["n_chars"]) for r in extraction.extract(spark.createDataFrame(pages, "page_id long, url string, html string, text string")).collect()}
    want = "Title & more\nFirst para with bold text.\nSecond one, long enough to matter here."
    assert all(got[i] == (want, len(want)) for i in range(4)) and got[8] == ("", 0) and got[9] == ("", 0) and got[10][0] == "Only"


ARTICLE = "<h1>Title</h1><p>First para, long enough to be the prose of this page.</p><p>Second one, with more of it.</p>"
WANTED = "Title\nFirst para, long enough to be the prose of this page.\nSecond one, with more of it."


@pytest.mark.parametrize(
    "body",
    [
        f"<div class='content has-sidebar'>{ARTICLE}</div><div class='sidebar'><p>Side text</p></div>",
        f"<div class='post'><div class='post-header'><h1>Title</h1></div>{ARTICLE.split('</h1>')[1]}</div><div id=footer>Foot</div>",
        f"<div class=no-sidebar><article>{ARTICLE}</article><div class='comment-list'><p>{'A very long comment. ' * 40}</p></div></div>",
        f"<form action='/x'><div id=main>{ARTICLE}</div></form><form><label>Search</label><input name=q></form>",
        f"<div class='page banner-layout'>{ARTICLE}</div><div class='site-header'>Site</div><div class='ad-slot'>Buy <b>now</b></div>",
        f"<article title=it's>{ARTICLE.replace('<p>', '<p title=it' + chr(39) + 's>')}</article><footer class='x'>Foot</footer>",
        "<article><h1>Title<p>First para, long enough to be the prose of this page.<p>Second one, with more of it.</article><nav>Menu",
        f"<main>{ARTICLE.replace('<p>', '<p data-x=' + chr(34) + 'a > b' + chr(34) + '>')}</main><aside>Side</aside>",
        *(f"<div class=content {x}>{ARTICLE}</div><div class=sidebar>Side</div>" for x in ("style='overflow:hidden'", "data-hidden=false", "title='hidden gems'", "data-id='comments-1'", "data-class=ads", "aria-hidden=false", "x='<b class=ads hidden>'", f"data-x='{'a > b ' * 200_000}'")),
        *(f"<div class='{x}'>{ARTICLE}</div><div class='comments'><p>{'Said so. ' * 90}</p></div>" for x in ("has-comments", "no-comments", "post-comments-enabled", "comments-open", "comments-closed post")),
    ],
)
def test_articles_stay_whole(body):
    blocks = extraction.read(f"<html><body>{body}</body></html>")
    assert extraction.text_of(blocks, []) == WANTED


class Plain(html.parser.HTMLParser):
    """Another extractor, for pages whose noise is marked by tag or by one class word."""

    def __init__(self):
        super().__init__()
        self.stack, self.blocks, self.now = [], [], ""

    def cut(self):
        if said := " ".join(self.now.split()):
            self.blocks.append(said)
        self.now = ""

    def handle_starttag(self, tag, attrs):
        if tag not in ("b", "a", "br", "em"):
            self.cut()
            marks = dict(attrs)
            bad = tag in ("nav", "aside", "footer", "script", "style") or "hidden" in marks or bool(set((marks.get("class") or "").split()) & {"sidebar", "ads", "comments", "cookie"})
            self.stack.append((tag, bad or bool(self.stack and self.stack[-1][1])))

    def handle_endtag(self, tag):
        if tag not in ("b", "a", "br", "em"):
            self.cut()
            while self.stack and self.stack.pop()[0] != tag:
                pass

    def handle_data(self, data):
        if not (self.stack and self.stack[-1][1]):
            self.now += data


def made_page(rng):
    """A page of nested containers with a known article: (html, the article's text)."""
    word = lambda n: " ".join(VOCAB[i] for i in rng.integers(0, 300, n))
    mark = lambda: str(rng.choice(["", " id=x1", " title='a > b'", ' data-hidden="no"', " style='overflow:hidden'", " data-class='ads'", ' data-q="it&#39;s <i> here"', " data-comments=3", "\nlang = en "]))
    noise = lambda: str(rng.choice(["<nav><a href=/>{}</a></nav>", "<aside><p>{}</p></aside>", "<div class='sidebar'><p>{}</p></div>", '<div class="ads box">{}</div>', "<div class=comments><p>{}</p></div>", "<script>var a = '<p>{}</p>';</script>", "<div hidden>{}</div>", "<!-- <p>{}</p> -->", "<p hidden=''>{}</p>"])).format(word(int(rng.integers(1, 60))))
    paras = [word(int(rng.integers(8, 40))) for _ in range(int(rng.integers(2, 7)))]
    inner = "".join(f"<p{mark()}>{p.replace(' ', ' <b' + mark() + '>x</b> ', 1)}</p>{noise() if rng.random() < 0.4 else ''}" for p in paras)
    body = f"<h1{mark()}>{word(3)}</h1>{inner}"
    title = body.split(">", 1)[1].split("</h1>")[0] if "'a > b'" not in body.split("</h1>")[0] and "<i>" not in body.split("</h1>")[0] else None
    for _ in range(int(rng.integers(1, 4))):
        body = f"<{(tag := str(rng.choice(['div', 'section', 'article'])))} class='{rng.choice(['content', 'post body', 'text', 'has-comments'])}'{mark()}>{body}</{tag}>"
    return f"<html><head><title>t</title><style>p {{}}</style></head><body>{noise()}{body}{noise()}{noise()}<footer>{word(5)}</footer></body></html>", title, [p.replace(" ", " x ", 1) for p in paras]


def test_made_pages_by_another_extractor():
    rng = np.random.default_rng(12)
    for _ in range(300):
        page, title, paras = made_page(rng)
        other = Plain()
        other.feed(page.replace("<title>t</title>", ""))
        other.cut()
        got = extraction.text_of(extraction.read(page), [])
        assert got.split("\n")[1:] == paras and got.split("\n") == other.blocks and (title is None or got.split("\n")[0] == title), page


def test_a_long_attribute_leaves_no_trace(spark):
    page = "<html><body><article data-x='" + "<p>not > this</p>" * 70_000 + f"'>{ARTICLE}</article></body></html>"
    row = extraction.extract(spark.createDataFrame([(1, "http://a.example/", page)], "page_id long, url string, html string")).first()
    assert (row["text"], row["n_chars"]) == (WANTED, len(WANTED))


def test_malformed_pages_take_linear_time():
    for piece in ("<a b=\"c' ", "<a b='<a c=\"", "<p x='1' ","<a '", "<a =\"", "<!-", "<div", "<p title='", "</", "<a b='c' "):
        took = []
        for n in (20_000, 80_000):
            page, begun = piece * n, time.perf_counter()
            extraction.read(page)
            took.append(time.perf_counter() - begun)
        assert took[1] < 12 * max(took[0], 0.02), (piece, took)


def test_hosts_vote(spark):
    """The path that most of a host's pages have wins, also on a page where another container has more prose."""
    page = "<html><body><div class='text'><p>{}</p></div><div class='extra'><p>{}</p></div></body></html>"
    pages = [(i, f"https://a.example/{i}", page.format(f"Article {i} " + "with prose " * 40, "")) for i in range(30)] + [(30, "https://a.example/30", page.format("Short article.", "Other prose " * 12))]
    for few in (200_000, 0):
        extraction.FEW_HOSTS = few
        got = {r["page_id"]: r["text"] for r in extraction.extract(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
        assert got[30] == "Short article." and got[0] == ("Article 0 " + "with prose " * 40).strip()
    extraction.FEW_HOSTS = 200_000
    assert extraction.extract(spark.createDataFrame(pages[:0], "page_id long, url string, html string")).count() == 0


def test_language_evidence_by_brute_force(spark):
    """The fusion again in numpy, row by row."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    langs, table = language.fit(docs)
    pages = [r.asDict() for r in docs.select(F.col("doc_id").alias("key"), F.substring("text", 1, 300).alias("body"), F.when(F.col("doc_id") % 3 == 0, "en").when(F.col("doc_id") % 3 == 1, F.col("lang")).alias("declared"), F.concat("source", F.lit("."), F.col("lang")).alias("host")).collect()]
    pages += [{"key": 10**6, "body": None, "declared": "zz", "host": None}, {"key": 10**6 + 1, "body": "the", "declared": "EN-us", "host": "x"}]
    got = {r["key"]: r for r in language.identify(spark.createDataFrame([tuple(p.values()) for p in pages], "key long, body string, declared string, host string"), (langs, table)).collect()}
    soft = lambda v: np.exp(v - v.max()) / np.exp(v - v.max()).sum()
    for p in pages:
        data = bytes(b + 32 if 65 <= b <= 90 else b for b in (p["body"] or "").encode())
        codes = [(data[i] << 16 | data[i + 1] << 8 | data[i + 2]) * 2654435761 % 2**32 >> 18 for i in range(len(data) - 2)]
        p["n"] = len(codes)
        p["text"] = table[codes].astype(float).sum(0) / max(1, len(codes)) * min(len(codes), language.GRAMS) if codes else np.zeros(len(langs))
        p["none"] = min(len(codes), language.GRAMS) * language.ANY_BUCKET + np.log(language.NONE_OF_THEM)
        p["p"] = soft(np.append(p["text"], p["none"]))[:-1]
        word = re.match(r"\s*([A-Za-z]{2,3})", p["declared"] or "")
        p["said"] = "none" if p["declared"] is None else word[1].lower() if word and word[1].lower() in langs else "other"
        p["suffix"] = (p["host"] or "").rpartition(".")[2] if "." in (p["host"] or "") else ""
        p["fine"] = bool(codes) and any(97 <= b <= 122 or b >= 128 for b in data)
    known = [p for p in pages if p["fine"]]
    whole = sum(p["p"] for p in known)
    prior = (whole + 1) / (whole.sum() + len(langs))
    words = [*langs, "none", "other"]
    seen = np.array([sum((p["p"] for p in known if p["said"] == w), np.zeros(len(langs))) for w in words]) + 0.5 / len(words)
    for p in pages:
        by_suffix = sum((q["p"] for q in known if q["suffix"] == p["suffix"]), np.zeros(len(langs))) + prior * language.LEAN_SUFFIX
        by_host = sum((q["p"] for q in known if q["host"] == p["host"]), np.zeros(len(langs))) + by_suffix / by_suffix.sum() * language.LEAN_HOST
        host = by_host / by_host.sum() if any(q["host"] == p["host"] for q in known) else prior
        log = p["text"] + np.log(seen / seen.sum(0))[words.index(p["said"])] + np.log(host)
        q = soft(np.append(log, p["none"] + np.log(seen.sum(1) / seen.sum())[words.index(p["said"])]))[:-1]
        r = got[p["key"]]
        assert abs(r["posterior"] - q.max()) < 1e-4 and (r["lang"] == langs[int(q.argmax())] or np.sort(q)[-1] - np.sort(q)[-2] < 1e-4)
        assert r["accepted"] == (p["fine"] and q.max() >= language.LEAST_POSTERIOR) or abs(q.max() - language.LEAST_POSTERIOR) < 1e-4


def test_declared_language_of_a_page(spark):
    rows = [(i, h, None, "h", "clash") for i, h in enumerate(("<html data-lang='xx' lang='en'>the of and to", "<html xml:lang=fr><p>le", "<HTML class=a LANG=de>der", None, "<html>"))]
    model = (["de", "en"], np.log(np.full((language.BUCKETS, 2), 0.5 / language.BUCKETS)).astype(np.float32))
    got = {r["key"]: r for r in language.identify(spark.createDataFrame(rows, "key long, body string, declared string, host string, lang string"), model, html=True).collect()}
    assert [got[i]["declared"] for i in range(5)] == ["en", None, "de", None, None]
    assert all(r["lang"] == "de" or r["declared"] == "en" for r in got.values())  # ties go to the first by name


def test_language(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = language.fit(docs.where("doc_id % 2 = 0"))  # judged on the others, by their texts alone
    docs = docs.where("doc_id % 2 = 1")
    rows = docs.select(F.col("doc_id").alias("key"), F.col("text").alias("body"), F.lit(None).cast("string").alias("declared"), F.lit(None).cast("string").alias("host"))
    odd = spark.createDataFrame([(-1, None, "en", None), (-2, "", None, "h"), (None, "the of and", "zz", "h")], "key long, body string, declared string, host string")
    got = language.identify(rows.unionByName(odd), model).collect()
    truth = {r["doc_id"]: r["lang"] for r in docs.select("doc_id", "lang").collect()}
    real = [r for r in got if r["key"] is not None and r["key"] >= 0]
    assert len(got) == len(truth) + 3 and sum(r["lang"] == truth[r["key"]] for r in real) >= 0.97 * len(real)
    assert sum(r["accepted"] for r in real) >= 0.99 * len(real) and not any(r["accepted"] for r in got if r["key"] in (-1, -2))
    assert language.identify(rows.limit(0), model).count() == 0


def test_other_languages_are_rejected(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    letters, signs = list("abcdefghijklmnopqrstuvwxyz "), list("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/")
    strange = [
        "Wszyscy ludzie rodzą się wolni i równi pod względem swej godności i swych praw. Są oni obdarzeni rozumem i sumieniem.",
        "Kaikki ihmiset syntyvät vapaina ja tasavertaisina arvoltaan ja oikeuksiltaan. Heille on annettu järki ja omatunto.",
        "Все люди рождаются свободными и равными в своем достоинстве и правах. Они наделены разумом и совестью.",
        "".join(RNG.choice(letters, 300)),
        "".join(RNG.choice(signs, 300)),
    ]
    rows = spark.createDataFrame([(i, t, said, "h") for i, t in enumerate(strange) for said in (None, "en")], "key long, body string, declared string, host string")
    assert not any(r["accepted"] for r in language.identify(rows, language.fit(docs)).collect())
    odd = spark.createDataFrame([(-1 - i, t, "en", "h", len(t)) for i, t in enumerate(strange)], "doc_id long, text string, lang string, source string, n_chars long")
    wrong = docs.limit(0).select(*corpus_pipeline.COLUMNS).union(docs.where("lang = 'fr'").orderBy("doc_id").limit(3).select(F.col("doc_id") + 1_000_000, "text", F.lit("de"), "source", "n_chars"))
    kept = {r["doc_id"]: r["lang"] for r in corpus_pipeline.identify_language(spark, docs.select(*corpus_pipeline.COLUMNS).union(odd).union(wrong), "").collect()}
    assert not any(k < 0 for k in kept) and sum(v == "fr" for k, v in kept.items() if k >= 1_000_000) == 3


def test_more_languages_than_forty(spark):
    texts = {f"l{i:02d}": " ".join("".join(np.random.default_rng(i).choice(list("abcdefghijklmnop"), 6)) for _ in range(40)) for i in range(45)}
    docs = spark.createDataFrame([(i, t, x) for i, (x, t) in enumerate(texts.items())], "doc_id long, text string, lang string")
    assert language.fit(docs)[0] == sorted(texts)


def test_chunk_dedup_by_brute_force(spark):
    """Chunks found again by scanning all texts in order, extended beside the first byte by byte."""
    rng, rows = np.random.default_rng(9), []
    passages = [prose(80, 900 + i) for i in range(4)]
    for i in range(50):
        parts = [prose(int(rng.integers(10, 60)), 1000 + i), *(passages[j] for j in rng.choice(4, int(rng.integers(0, 3)))), prose(int(rng.integers(10, 60)), 2000 + i)]
        rows.append((i, " ".join(parts)))
    rows += [(60, rows[3][1]), (61, "short"), (62, "short"), (63, "x" * 3000), (64, "x" * 3000 + "y")]
    seen, want = {}, {}
    for k, t in rows:
        raw = t.encode()
        ends = chunks.chunk_ends(np.array([c for c in chunks.cut_points(np.frombuffer(raw, np.uint8)).tolist() if 32 <= c < len(raw)], np.int64), 0, len(raw))
        begins, gone = [0, *ends[:-1]], np.zeros(len(raw), bool)
        for a, e in zip(begins, ends, strict=True):
            if raw[a:e] not in seen:
                seen[raw[a:e]] = (raw, a, e)
                continue
            other, lo, hi = seen[raw[a:e]]
            a0, e0 = a, e
            while a0 > 0 and lo > 0 and a - a0 < chunks.CONTEXT and raw[a0 - 1] == other[lo - 1]:
                a0, lo = a0 - 1, lo - 1
            while e0 < len(raw) and hi < len(other) and e0 - e < chunks.CONTEXT and raw[e0] == other[hi]:
                e0, hi = e0 + 1, hi + 1
            gone[a0:e0] = True
        runs = np.flatnonzero(np.diff(np.concatenate([[0], gone.astype(int), [0]]))).reshape(-1, 2)
        want[k] = [(int(a), int(b)) for a, b in runs if b - a >= min(chunks.LEAST_RUN, len(raw))]
    got = {r["doc_id"]: r for r in chunks.dedup_substrings(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for k, t in rows:
        found = [(x["lo"], x["hi"]) for x in got[k]["spans"]]
        assert sum(b - a for a, b in found) == got[k]["n_removed"] and got[k]["n_spans"] == len(found)
        wide = np.zeros(len(t), bool)
        for a, b in want[k]:
            wide[a:b] = True
        narrow = np.zeros(len(t), bool)
        for a, b in found:
            narrow[a:b] = True
        assert not (narrow & ~wide).any() and (wide & ~narrow).sum() <= 0.02 * max(1, wide.sum()), k
        assert got[k]["text"] == "".join(c for c, x in zip(t, narrow, strict=True) if not x)


def test_chunk_dedup_with_clashing_names(spark):
    rows = [(i, prose(100, 1), 5, "a", 7) for i in (1, 2)]
    got = chunks.dedup_substrings(spark.createDataFrame(rows, "doc_id long, text string, n_removed int, spans string, key int"))
    assert sorted(got.columns) == sorted(["doc_id", "text", "key", "n_removed", "n_spans", "spans"])
    assert {r["doc_id"]: (r["text"] == "", r["key"]) for r in got.collect()} == {1: (False, 7), 2: (True, 7)}


def test_shared_passages_go_whole(spark):
    rows, shared = [], {}
    for i in range(40):
        passage = prose(51, 10_000 + i)
        rows += [(2 * i, prose(60, 20_000 + i) + " " + passage + " " + prose(50, 30_000 + i)), (2 * i + 1, prose(35, 40_000 + i) + "\n" + passage + "\n" + prose(45, 50_000 + i))]
        shared[2 * i + 1] = len(passage)
    got = {r["doc_id"]: r for r in chunks.dedup_substrings(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    share = [min(1.0, got[k]["n_removed"] / n) for k, n in shared.items()]
    assert sum(share) / len(share) > 0.95 and all(r["n_removed"] == 0 for k, r in got.items() if k not in shared)
    for k, t in rows:
        spans = got[k]["spans"]
        assert all(b["lo"] > a["hi"] for a, b in zip(spans, spans[1:]))
        assert k % 2 == 0 or all(t[x["lo"] : x["hi"]].strip() in rows[k - 1][1] for x in spans)


def test_long_shared_stretches_go_whole(spark):
    """What is longer than the extension reaches has chunks of its own, so its middle does not hang on the ends."""
    rows, shared = [], {}
    for i, words in enumerate((400, 700, 1500, 6000)):
        passage = prose(words, 60_000 + i)
        assert len(passage) > 2 * chunks.CONTEXT
        rows += [(2 * i, prose(60, 70_000 + i) + " " + passage + " " + prose(50, 80_000 + i)), (2 * i + 1, prose(35, 90_000 + i) + "\n" + passage + "\n" + prose(45, 95_000 + i))]
        shared[2 * i + 1] = len(passage)
    got = {r["doc_id"]: r for r in chunks.dedup_substrings(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for k, n in shared.items():
        assert n - 1 <= got[k]["n_removed"] <= n + 2 and got[k]["n_spans"] == 1 and got[k - 1]["n_removed"] == 0


def test_extension_keeps_characters():
    text, ends = "èabcdé".encode(), [2, 6, 8]
    assert chunks.extended(text, ends, [1], {(1, False): "é".encode(), (1, True): "è".encode()}) == [[2, 6]]
    assert chunks.extended(text, ends, [1], {(1, False): "xè".encode(), (1, True): "éy".encode()}) == [[0, 8]]


def test_near_duplicates_keep_one_row_of_an_id(spark):
    rows = [(1, prose(80, 1), "en", "a", 9), (1, prose(80, 1), "en", "a", 9), (1, prose(80, 1), "en", "a", 8), (2, prose(80, 1), "en", "a", 9), (3, prose(80, 3), None, "b", 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = sorted(tuple(r) for r in corpus_pipeline.drop_near_duplicates(spark, docs, "").collect())
    assert got == [rows[2], rows[4]]


def test_near_duplicate_stage_by_brute_force(spark):
    rows = [(k, t) for k, t in many_variants() if k != 3] + [(950, None), (951, ""), (952, "")]
    docs = spark.createDataFrame([(k, t, "en", "s", 0, "extra") for k, t in rows], "doc_id long, text string, lang string, source string, n_chars long, component_id string")
    want = sorted(k for k, _, c in brute_components(rows) if k == c)
    got = corpus_pipeline.drop_near_duplicates(spark, docs, "")
    assert got.columns == list(corpus_pipeline.COLUMNS) and sorted(r["doc_id"] for r in got.collect()) == want


def test_mix_stage_with_shared_ids(spark):
    rows = [(1, prose(200, 1), "en", "a", 1), (1, prose(9000, 2), "en", "a", 1), (2, prose(500, 3), "en", "a", 1), (2, prose(500, 3), "fr", "a", 2), (3, None, "en", "b", 0), (4, "", "en", None, 0), (None, prose(700, 5), "en", None, 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = corpus_pipeline.mix_sources(spark, docs, "").collect()
    assert sorted(map(tuple, got), key=repr) == sorted(map(tuple, corpus_pipeline.mix_sources(spark, docs, "").collect()), key=repr)
    taken = {}
    for r in mixing.mix(docs).collect():
        taken[r["doc_id"], r["size"]] = taken.get((r["doc_id"], r["size"]), 0) + r["taken"]
    out = {}
    for r in got:
        source = [t for k, t, *_ in rows if k == r["doc_id"] and t and all(x in t for x in r["text"].split("\n"))]
        assert source and r["n_chars"] == len(r["text"])
        key = r["doc_id"], len(WORDS.findall(source[0]))
        out[key] = out.get(key, 0) + len(WORDS.findall(r["text"]))
    assert out == {k: n for k, n in taken.items() if n}


def test_stages_on_empty_and_odd_tables(spark, empty):
    odd = spark.createDataFrame([(None, None, None, None, None, "x", 1, 2), (1, None, "en", None, 0, "x", 1, 2), (2, "", None, "a", 0, "x", 1, 2), (2, " \t", "en", "a", 0, "x", 1, 2), (3, "word " * 30_000, "en", "a", 0, "x", 1, 2)], SCHEMA)
    # the only text with words is accepted, kept, and taken once and a half; packing has a piece of every row, and eight of 30 001 tokens
    want = {"language_id": [3], "near_duplicates": [1, 2, 3], "repeated_passages": [3], "source_mix": [3, 3], "packing": [None, 1, 2, 2, *[3] * 8]}
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, "").count() == 0, name
        rows = stage(spark, odd, "")
        assert sorted((r["doc_id"] for r in rows.collect()), key=lambda x: (x is not None, x)) == want[name], name
        assert name == "packing" or rows.columns == list(corpus_pipeline.COLUMNS), name


def test_pipeline_runs_through(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = shared.stash(stage(spark, docs, ""), "stage")
    library = Tokenizer.from_file(VOCABULARY)
    want = sorted((r["doc_id"], len(library.encode(r["text"], add_special_tokens=False).ids) + 1) for r in docs.collect())
    got = {}
    rows = corpus_pipeline.run(spark, "/root/testdata/sf0.001").collect()
    for r in rows:
        got[r["doc_id"]] = got.get(r["doc_id"], 0) + r["length"]
    each = {}
    for k, n in want:
        each[k] = each.get(k, 0) + n
    assert got == each


def test_token_query_keeps_to_its_cache(spark, tmp_path):
    from leaklens.llm import queries

    cache, version = str(tmp_path / "kept"), tokens.counter(VOCABULARY)[0]
    plain = sorted(map(tuple, queries.op9_token_counts(spark, "/root/testdata/sf0.001").collect()))
    spark.conf.set("spark.leaklens.tokenCache", cache)
    try:
        for _ in range(2):
            assert sorted(map(tuple, queries.op9_token_counts(spark, "/root/testdata/sf0.001").collect())) == plain
    finally:
        spark.conf.unset("spark.leaklens.tokenCache")
    stored = spark.read.parquet(f"{cache}/version={version}")
    assert stored.count() == stored.select("digest").distinct().count() > 0


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_against_its_sql(spark, name):
    ours, duck = queries.QUERIES[name](spark, SF).toPandas(), duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        duck.sql(f"create view {os.path.basename(path)[:-8]} as select * from '{path}'")
    theirs = duck.sql(queries.ORACLE_SQL[name]).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    columns = sorted(ours.columns)
    assert sorted(ours[columns].values.tolist()) == sorted(theirs[columns].values.tolist())
