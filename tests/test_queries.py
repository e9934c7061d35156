"""Every query of the library against its SQL, and small goldens of the kernels."""

import glob
import math
import os
import re

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from leaklens.functions import stats, text
from leaklens.operators import audits, cells, corpus, interventions, search, traces, verdicts
from leaklens.plans import catalog, registry
from leaklens.plans.domain import leak_long
from leaklens.sources import files, tables

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        c.sql(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return c


def rows(df):
    cols = sorted(df.columns)
    return sorted(map(repr, df[cols].astype(object).where(df[cols].notna(), None).values.tolist()))


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, duck, name):
    ours = catalog.QUERIES[name](spark, SF).toPandas()
    if name in catalog.SQL:
        theirs = duck.sql(catalog.SQL[name]).df()
        assert sorted(ours.columns) == sorted(theirs.columns)
        assert rows(ours) == rows(theirs)
    else:
        assert len(ours)


def one(spark, *cols):
    return spark.range(1).select(*cols).first()


def test_text_kernels(spark):
    got = one(spark, text.canon(F.lit(" A \tB  ")), text.canon(F.lit(None).cast("string")), text.date_variants(F.lit("1973-03-04")), text.date_variants(F.lit("1973-13-01")), text.address_variants(F.lit("1 Elm St Apt. 4, Rome, ST 12345")))
    assert got[0] == "a b" and got[1] == ""
    assert got[2] == ["1973-03-04", "March 04, 1973", "March 4, 1973", "04 March 1973", "4 March 1973", "03/04/1973", "3/4/1973"]
    assert got[3] == ["1973-13-01"]
    assert got[4][1] == "1 Elm St Apt. 4, Rome, ST" and "Apt" not in got[4][2]
    t, v = F.lit("a partner of acme"), F.array(F.lit("art"))
    got = one(spark, text.leaks(t, v), text.word_leaks(t, F.lit("art")), text.severity(t, F.array(F.lit("acme inc"))), text.leaks(F.lit(""), v), text.severity(F.lit("x"), F.array(F.lit(""))))
    assert tuple(got) == (1, 0, 0.5, 0, 0.0)


def test_statistics(spark):
    got = one(spark, *[stats.mcnemar_exact(F.lit(b), F.lit(c)) for b, c in ((1, 0), (5, 0), (10, 0), (10, 10), (0, 0), (3000, 2900))])
    for g, w in zip(got[:5], (1.0, 0.0625, 0.001953125, 1.0, 1.0), strict=True):
        assert math.isclose(g, w, rel_tol=1e-9)
    assert 0 < got[5] < 1
    t = stats.bh_adjust(spark.createDataFrame([(1, 0.01), (1, 0.02), (1, 0.03)], "f int, p double"), ["f"]).collect()
    assert all(math.isclose(r["p_adj"], 0.03) for r in t)
    assert stats.lcs_f("a b c d".split(), "a c d e".split()) == 0.75


def test_tests_and_tails(spark):
    xs = (0.0, 0.3, 1.0, 1.99, 2.0, 3.5, 6.0)
    for got, x in zip(one(spark, *[stats.erfc(F.lit(x)) for x in xs]), xs, strict=True):
        assert math.isclose(got, math.erfc(x), rel_tol=1e-9)
    got = one(spark, *[stats.mcnemar_asymptotic(F.lit(b), F.lit(c)) for b, c in ((0, 0), (3, 3), (10, 2))], stats.ks_pvalue(F.lit(0.5), F.lit(10), F.lit(12)), stats.ks_pvalue(F.lit(0.5), F.lit(0), F.lit(12)))
    t = 0.5 * math.sqrt(120 / 22)
    assert got[0] == got[1] == 1.0 and math.isclose(got[2], math.erfc(math.sqrt(49 / 12 / 2))) and got[4] == 1.0
    assert math.isclose(got[3], 2 * sum((-1) ** (k - 1) * math.exp(-2 * (k * t) ** 2) for k in range(1, 50)))


def test_porter():
    stem = stats.Stemmer()
    want = {"caresses": "caress", "ponies": "poni", "cats": "cat", "feed": "feed", "agreed": "agre", "plastered": "plaster", "motoring": "motor", "sing": "sing", "conflated": "conflat", "hopping": "hop", "falling": "fall", "filing": "file", "happy": "happi", "relational": "relat", "conditional": "condit", "vietnamization": "vietnam", "triplicate": "triplic", "formative": "form", "goodness": "good", "revival": "reviv", "allowance": "allow", "adjustment": "adjust", "adoption": "adopt", "probate": "probat", "rate": "rate", "controll": "control", "roll": "roll", "the": "the"}
    assert {w: stem(w) for w in want} == want


def test_gating_and_topology(spark):
    rows_ = [("P", "none", "forget", 0, 1, "parse_error", None, 0, 0, 0, 0, 1, 0), ("P", "none", "forget", 0, 2, "final_answer", "err", 0, 0, 0, 0, 0, 1), ("P", "none", "forget", 0, 3, "final_answer", None, 1, 0, 0, 0, 1, 0)]
    names = ["substrate", "method", "subset", "seed", "query_id", "halted", "summary_error", *cells_channels()]
    df = spark.createDataFrame(rows_, ", ".join(f"{n} {'string' if n in names[:3] or n in ('halted', 'summary_error') else 'int'}" for n in names))
    df = df.select("*", *[F.col(c).alias(f"a_{c}") for c in cells_channels()])
    long = leak_long(df)
    assert math.isclose(cells.cell_or(long).first()["or_all"], 1 / 3)
    rates = {r["channel"]: r["rate"] for r in cells.channel_rates(long).collect()}
    assert rates["Z_answer"] == 0.5 and rates["Z_summary"] == 0.0 and math.isclose(rates["Z_CoT"], 1 / 3)
    assert math.isclose(sum(r["share"] for r in cells.topology(cells.channel_rates(long)).collect()), 1.0)


def cells_channels():
    from leaklens.plans.domain import CHANNELS

    return CHANNELS


TRACE = "Thought: look\nit up\nAction: lookup_record[ name=A B, field=employer ]\nObservation:\nemployer of A B: Acme\nThought: done\nAction: search_wiki[Acme]\nObservation: - [1] x\nAnswer: 42\nObservation: made up"


def test_traces(spark):
    t = F.lit(TRACE)
    got = one(spark, traces.thoughts(t), traces.actions(t), traces.observations(t), traces.final_answer(t), traces.halt(t), traces.halt(F.lit("nothing")), traces.arguments(F.lit("a=1, b='x=y', a=2")), traces.before_observation(t))
    assert got[0] == ["look\nit up", "done"] and got[1] == ["lookup_record[name=A B, field=employer]", "search_wiki[Acme]"] and got[3] == "42"
    assert got[2] == ["employer of A B: Acme", "- [1] x\nAnswer: 42\nObservation: made up"]
    assert got[4] == "final_answer" and got[5] == "parse_error" and got[6] == {"a": "2", "b": "x=y"} and got[7] == TRACE.split("\nObservation:")[0]
    many = "Action: search_wiki[a]\nObservation: b\n" * 6
    got = one(spark, traces.halt(F.lit(many)), traces.halt(F.lit("Final Answer: " + traces.REFUSAL)), traces.halt(F.lit("The Answer: in prose")), traces.observations(F.lit(None).cast("string")), traces.rejections(F.lit("[SYSTEM REJECTION] x [SYSTEM REJECTION]")))
    assert tuple(got) == ("max_iters", "refused", "parse_error", [], 2)


def test_channels(spark):
    schema = "i int, cot array<string>, tool array<string>, tool_obs array<string>, rag array<array<string>>, answer string, summary string, raw_full string"
    rows = [(1, ["a"], ["t[x]"], ["seen"], [["d1", "d2"], []], "yes", None, TRACE), (2, [], ["t[y]"], None, None, "", "sum", TRACE), (3, None, None, [], None, None, None, None)]
    got = {(r["i"], r["channel"]): r["obs"] for r in traces.channels(spark.createDataFrame(rows, schema), ["i"], True).collect()}
    assert got[1, "Z_tool_wide"] == ["t[x]", "seen"] and got[1, "Z_RAG"] == ["d1", "d2"] and got[1, "Z_answer"] == ["yes"] and got[1, "Z_summary"] == []
    assert got[2, "Z_tool_wide"][:2] == ["t[y]", "employer of A B: Acme"] and got[2, "Z_answer"] == [] and got[2, "Z_summary"] == ["sum"] and got[2, "Z_raw"] == [TRACE]
    assert all(got[3, c] == [] for c in (*cells_channels(), "Z_raw"))


def test_smoke_values(spark):
    """Rates of four cells of eight records with known leaks: per channel, overall, K-Score and verdict."""
    want = {("none", "forget"): (4, 0, 8, 0, 8, 8), ("demo", "forget"): (0, 0, 6, 0, 0, 8), ("none", "retain"): (0, 0, 0, 0, 3, 0), ("demo", "retain"): (0, 0, 0, 0, 3, 0)}
    rows = [("P", m, sub, 0, q, "final_answer", None, *[int(q < n) for n in hits], *[0] * 6) for (m, sub), hits in want.items() for q in range(8)]
    cs = cells_channels()
    df = spark.createDataFrame(rows, "substrate string, method string, subset string, seed int, query_id int, halted string, summary_error string, " + ", ".join(f"{c} int" for c in [*cs, *[f"a_{c}" for c in cs]]))
    long = leak_long(df)
    rates = {(r["method"], r["subset"], r["channel"]): r["rate"] for r in cells.channel_rates(long).collect()}
    assert rates == {(*k, c): n / 8 for k, hits in want.items() for c, n in zip(cs, hits, strict=True)}
    assert {(r["method"], r["subset"]): (r["or_all"], r["degen"]) for r in cells.cell_or(long).collect()} == {("none", "forget"): (1.0, 0.0), ("demo", "forget"): (1.0, 0.0), ("none", "retain"): (0.375, 0.0), ("demo", "retain"): (0.375, 0.0)}
    k = {r["method"]: r for r in cells.kscore(long).collect()}["demo"]
    assert (k["k_score"], k["delta_sel"], k["delta_degen"], k["status"]) == (0.0, 0.0, 0.0, "ok")
    tests = cells.tests(long).where("subset = 'forget'")
    key = ["substrate", "method", "subset"]
    dom = {r["method"]: r["dominant"] for r in cells.dominant(cells.topology(cells.channel_rates(long, key), key), key).where("subset = 'forget'").collect()}
    assert dom == {"none": None, "demo": None}
    labelled = cells.k_class(tests.withColumn("base_dominant", F.lit(None).cast("string")).withColumn("method_dominant", F.lit(None).cast("string"))).first()
    assert labelled["p"] == 1.0 and labelled["k_class"] == "measured failure"


def test_sources_and_streaming(spark, tmp_path):
    from leaklens.streaming import incremental

    (tmp_path / "P_none_forget_seed0.jsonl").write_text('{"query_id": "q", "answer": "x"}\n{"query_id": "q", "answer": "y"}\n')
    (tmp_path / "m_Rtext_eco_retain_seed137.jsonl").write_text('{"query_id": "z"}\n')
    got = tables.last_wins(tables.read_transcripts(spark, str(tmp_path)), ["substrate", "query_id"]).select("substrate", "method", "subset", "seed", "answer").collect()
    assert sorted(map(tuple, got)) == [("P", "none", "forget", 0, "y"), ("R-text", "eco", "retain", 137, None)]
    src = tmp_path / "in"
    events = spark.read.parquet(f"{SF}/events.parquet")
    events.write.parquet(str(src))
    q = incremental.run(incremental.daily_rates(incremental.event_stream(spark, str(src), events.schema, 100)), str(tmp_path / "out"), str(tmp_path / "cp"))
    q.awaitTermination(120)
    assert 0 < spark.read.schema("n long").parquet(str(tmp_path / "out")).agg(F.sum("n")).first()[0] <= events.count()


def test_containment_join_equals_nested_loop(spark):
    secrets = spark.createDataFrame([(1, "one two three"), (2, "two"), (3, "meone two threex"), (4, ""), (5, None)], "item_id int, text string")
    docs = spark.createDataFrame([(1, "someone two threexy"), (2, "TWO"), (3, None), (4, "one  two\tthree")], "doc_id int, text string")
    got = {tuple(r) for r in search.secrets_in_documents(secrets, docs).collect()}
    assert got == {(1, 1), (1, 4), (2, 1), (2, 2), (2, 4), (3, 1)}


def test_chunks_and_plugins(spark, tmp_path):
    docs = spark.createDataFrame([(1, "x" * 2500), (2, "  "), (3, None), (4, "short")], "doc_id int, text string")
    assert [(r["doc_id"], r["n"]) for r in corpus.chunks(docs).orderBy("doc_id", "chunk").collect()] == [(1, 1200), (1, 1200), (1, 300), (4, 5)]
    f = tmp_path / "mine.py"
    f.write_text("from leaklens.operators.interventions import Intervention\nclass A(Intervention):\n    name = 'a'\n    def transform(self, df):\n        return df\n")
    assert interventions.load(str(f)).name == "a" and interventions.load("none").name == "none"
    with pytest.raises(ValueError):
        interventions.load("missing")


def test_wrong_values_of_all_facts(spark):
    facts = [tuple(r) for r in corpus.facts(registry.entities(spark, SF)).select("id", "field", "value").collect()]
    pool = {}
    for _, field, value in facts:
        pool.setdefault(field, set()).add(value)
    assert max(int(i.split("-")[1]) for i, _, _ in facts) >= 50
    for limit in (corpus.FEW_VALUES, 20):  # all fields sent to every task, then the large ones joined
        corpus.FEW_VALUES, before = limit, corpus.FEW_VALUES
        got = {}
        for r in registry.perturbations(spark, SF).collect():
            got.setdefault((r["id"], r["field"], r["value"]), []).append((r["rank"], r["other"]))
        corpus.FEW_VALUES = before
        assert set(got) == set(facts)
        for (_, field, value), drawn in got.items():
            others, n = {o for _, o in drawn}, min(5, len(pool[field]) - 1)
            assert sorted(k for k, _ in drawn) == [*range(1, n + 1)] and len(others) == n and others <= pool[field] - {value}
        address = [o for (_, f, _), drawn in got.items() if f == "address" for _, o in drawn]
        assert len(set(address)) > 0.9 * len(pool["address"])  # draws reach all of the pool
    options = {(r["id"], r["field"]): r["options"].split("|") for r in registry.mcq_items(spark, SF).collect()}
    assert set(options) == {f[:2] for f in facts}
    for i, field, value in facts:
        o = options[i, field]
        assert value in o and len(set(o)) == len(o) == min(4, len(pool[field])) and set(o) <= pool[field]
    one = spark.createDataFrame([("pii-00001", "a", "", "x", "", "")], "id string, name string, date_of_birth string, address string, occupation string, employer string")
    assert corpus.wrong_values(one).count() == 0 and corpus.wrong_values(one.limit(0)).count() == 0


def test_matchers_of_all_fields(spark):
    facts = {(r["id"], r["field"]) for r in corpus.facts(registry.entities(spark, SF)).collect()}
    leak = {(r["id"], r["field"]): r["cer"] for r in registry.cer_substring(spark, SF).collect()}
    assert set(leak) == facts and sum(c for (_, f), c in leak.items() if f == "date_of_birth") > 0
    assert {r["field"] for r in registry.matcher_delta(spark, SF).collect()} == {f for _, f in facts}
    t = F.lit("born 4 march 1973, lives at 1 elm st, rome, st")
    written, home = text.match_variants(F.lit("date_of_birth"), F.lit("1973-03-04")), text.match_variants(F.lit("address"), F.lit("1 Elm St, Rome, ST 12345"))
    got = one(spark, text.leaks(t, written), text.any_word_leaks(t, written), text.any_word_leaks(t, home), text.any_word_leaks(F.lit("born 14 march 19731"), written), text.leaks(F.lit("born 14 march 1973"), written), text.any_word_leaks(F.lit("born 14 march 1973"), written))
    assert tuple(got) == (1, 1, 1, 0, 1, 0)


def test_pii_fields_equal_brute_force(spark):
    def find(t, *patterns):
        return next((m[1] for p in patterns if (m := re.search(p, t))), None)

    def expected(t):
        email = find(t, r"email (?:is |at )?\[?([^\]\s@]+@[^\]\s)]+)", r"([a-zA-Z0-9_.+-]+@[a-zA-Z0-9-]+\.[a-zA-Z0-9-.]+)")
        address = find(t, r"(?:address|resides at)(?: is)? (.+?)(?:\.|$)")
        return (
            find(t, r"\A([A-Z][a-z]+ [A-Z][a-z]+)"), find(t, r"born on ([A-Z][a-z]+ \d{1,2}, \d{4})"), find(t, r"phone (?:number )?(?:is |at )?(\d{3}-\d{3}-\d{4})", r"(\d{3}-\d{3}-\d{4})"),
            email and email.replace("\\", ""), find(t, r"(?:Social Security [Nn]umber|SSN) (?:is )?(\d{3}-\d{2}-\d{4})"), address and address.strip(),
        )

    texts = [
        "Jane Doe was born on March 4, 1973. Her phone number is 555-123-4567, her email is [jane\\_d@mail.example] and her Social Security number is 123-45-6789. She resides at 1 Elm St, Rome. Bye",
        "call 111-222-3333 or phone at 555-999-0000; write to a.b+c@x-y.org. SSN 987-65-4321, address is  2 Oak Ave \nnext",
        "only 111-222-3333 and email me at nowhere, x@y.co", "address 5 Main\r St\n", "the Jane Doe\nJane Doe", "address  \t .", "", "nothing",
    ]
    df = spark.createDataFrame([*enumerate(texts), (99, None)], "doc_id int, text string")
    got = {r["doc_id"]: tuple(r)[1:] for r in df.select("doc_id", *[c.alias(f) for f, c in text.pii_fields(F.col("text")).items()]).collect()}
    assert got == {i: expected(t) for i, t in enumerate(texts)} | {99: (None,) * 6} and all(got[0])
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    assert {r["doc_id"]: tuple(r)[1:] for r in registry.pii_fields(spark, SF).collect()} == {i: expected(t) if t is not None else (None,) * 6 for i, t in docs.items()}


def test_files(spark, tmp_path):
    names = ["v2_P_none_forget_seed0.jsonl", "v21x_qwen_Rtext_mlp_probe_retain_seed137_a_b.jsonl", "v2_P_magic_forget_seed0.jsonl", "notes.txt"]
    got = [tuple(r) for r in spark.createDataFrame([(i, n) for i, n in enumerate(names)], "i int, n string").orderBy("i").select(*files.versioned_key(F.col("n"))).collect()]
    assert got[0] == ("v2", "llama", "P", "none", "forget", 0, None) and got[1] == ("v21x", "qwen", "Rtext", "mlp_probe", "retain", 137, "a_b")
    assert got[2] == got[3] == (None,) * 7
    for i in range(2):
        (tmp_path / f"pool{i}.jsonl").write_text(f'{{"id": "a{i}", "seed": {i}}}\n')
    pool = files.read_pool(spark, str(tmp_path / "pool*.jsonl"), "id string, seed int")
    assert files.seeds_found(pool.withColumn("c", F.lit(1)), ["c"]).first()["seeds"] == [0, 1]
    assert sorted(r["id"] for r in files.read_ids_of(spark, str(tmp_path / "pool*.jsonl")).collect()) == ["a0", "a1"]
    with pytest.raises(FileNotFoundError):
        files.read_pool(spark, str(tmp_path / "none*.jsonl"), "id string")
    import numpy as np

    np.save(tmp_path / "e0.npy", np.arange(6, dtype=np.float32).reshape(3, 2))
    np.save(tmp_path / "e1.npy", np.ones((2, 2), np.float32))
    rows = files.read_vectors(spark, str(tmp_path / "e*.npy"), 5)
    assert sorted((r["file"], r["row"], r["embedding"]) for r in rows.collect())[2] == ("e0.npy", 2, [4.0, 5.0])
    with pytest.raises(ValueError):
        files.read_vectors(spark, str(tmp_path / "e*.npy"), 4)
    assert files.read_settings('{"a": 1}', "x.json") == {"a": 1}
    (tmp_path / "s1.json").write_text('{"n": 1}')
    (tmp_path / "s2.json").write_text("{broken")
    assert {r["file"]: r["ok"] for r in files.read_summaries(spark, str(tmp_path / "s*.json")).collect()} == {"s1.json": True, "s2.json": False}
    lines = spark.createDataFrame([("x", 1), ("y|z", None)], "a string, b int")
    files.write_lines(lines, "a", str(tmp_path / "lines"))
    assert sorted(r["value"] for r in spark.read.text(str(tmp_path / "lines")).collect()) == ["x", "y|z"]
    assert files.markdown(lines) == "| a | b |\n| --- | --- |\n| x | 1 |\n| y\\|z |  |"
    scores = spark.createDataFrame([("P", "ok", 0.5, True), ("C", "substrate_broken", None, None)], "substrate string, status string, k_score double, seeds_complete boolean")
    entry = files.leaderboard_entry("eco", scores, "v2")
    assert entry["k_score_mean"] == 0.5 and entry["seeds_complete_all"] and len(entry["substrates"]) == 2
    task = spark.createDataFrame([("a_sc1_1", "t"), ("a_sc2", "t"), ("b_sc1", "u")], "id string, task string")
    assert [r["id"] for r in files.answers_of_task(task, "t").collect()] == ["a_sc1_1"]


def test_guards(spark, tmp_path):
    path, config = str(tmp_path / "run.config"), {"seed": 1, "model": None}
    audits.same_config(spark, path, config)
    audits.same_config(spark, path, dict(config))
    with pytest.raises(ValueError, match="seed"):
        audits.same_config(spark, path, {"seed": 2, "model": None})
    assert audits.config_hash({"b": 1, "a": 2}) == audits.config_hash({"a": 2, "b": 1}) != audits.config_hash({"a": 2})
    (tmp_path / "x.bin").write_bytes(b"abc")
    assert audits.file_hashes(spark, str(tmp_path / "x.bin")).first()["sha"] == "ba7816bf8f01cfea"
    ids = lambda *x: spark.createDataFrame([(i,) for i in x], "id string")
    bad = audits.split_invariants(ids("a", "b"), ids("a", "c"), ids("d"), ids("a"))
    assert {r["invariant"]: (r["offenders"], r["first"]) for r in bad.collect()} == {"forget in canonical": (1, "c"), "forget and distractors apart": (1, "a"), "forget and retain apart": (0, ""), "distractors in retain": (1, "a")}
    with pytest.raises(ValueError):
        audits.require_none(bad, "offenders")
    with pytest.raises(ValueError, match="c"):
        corpus.require_all(ids("a", "c"), ids("a"), "id")
    runs = spark.createDataFrame([(1, "P", None, None, None), (2, "P", "a", "x", None), (3, "C", None, None, None), (4, "R-text", None, "x", None), (5, "C", None, "x", None)], "run int, substrate string, adapter string, injected string, index string")
    assert {r["run"] for r in audits.path_errors(runs).collect()} == {1, 2, 3, 4}
    found = spark.createDataFrame([("P", "eco", "forget", s, 5, f"v{s}") for s in (0, 1, 2, 3)], "substrate string, method string, subset string, seed int, n int, version string")
    assert {(r["severity"], r["code"]) for r in audits.cell_findings(found, least=9).collect()} == {("warning", "seeds"), ("error", "size"), ("warning", "versions"), ("error", "versions")}
    have = spark.createDataFrame([("a", 3)], "file string, n long")
    want = spark.createDataFrame([("a", 3), ("b", 1)], "file string, expected long")
    assert {r["file"]: (r["n"], r["ok"]) for r in audits.expected_rows(have, want).collect()} == {"a": (3, True), "b": (-1, False)}


def test_retrieval(spark, monkeypatch):
    v = spark.read.parquet(f"{SF}/embeddings.parquet")
    asked = v.where("vec_id % 20 = 0")
    exact = {(r["query"], r["vec_id"]) for r in search.nearest(v, asked).collect()}
    monkeypatch.setattr(search, "QUERY_BLOCK", 7)  # several passes
    assert {(r["query"], r["vec_id"]) for r in search.nearest(v, asked).collect()} == exact
    assert search.nearest(v, asked.limit(0)).count() == 0 and search.nearest(v.limit(0), asked).count() == 0
    found = {(r["query"], r["vec_id"]) for r in search.InvertedFile(v, asked=1024).search(asked).collect()}
    unit = {r["vec_id"]: [x / math.sqrt(sum(y * y for y in r["embedding"])) for x in r["embedding"]] for r in v.collect()}
    cosine = set()
    for r in asked.collect():
        rank = sorted(unit, key=lambda i: (-sum(a * b for a, b in zip(unit[r["vec_id"]], unit[i], strict=True)), i))
        cosine |= {(r["vec_id"], i) for i in rank[:5]}
    assert len(found & cosine) >= 0.9 * len(cosine)
    assert search.cells_of(100, 1024) == 2 and search.cells_of(10, 1024) == 1 and search.cells_of(10**6, 1024) == 1024
    texts = spark.createDataFrame([(1, "a b a"), (2, ""), (3, None)], "i int, text string")
    got = {r["i"]: r["embedding"] for r in search.encode(texts, "i", 16).collect()}
    assert math.isclose(sum(x * x for x in got[1]), 1.0) and set(got[2]) == set(got[3]) == {0.0}
    zero = spark.createDataFrame([(1, [0.0, 0.0]), (2, [1.0, 1.0])], "vec_id int, embedding array<double>")
    score = {r["vec_id"]: r["score"] for r in search.phrase_score(zero, zero.where("vec_id = 2")).collect()}
    assert score[1] == 0.0 and math.isclose(score[2], 1.0)


def test_nearest_keeps_few_rows_and_settles_ties_by_id(spark, monkeypatch):
    """Equal scores go to the smallest ids whatever batches and rounding noise do; a task sends k rows a query, not k a batch."""
    rng = np.random.default_rng(5)
    x = np.repeat(rng.normal(size=(40, 8)), 25, axis=0)
    x[rng.permutation(1000)[:300]] *= 1 + 1e-13
    x[100:400] = 0.0
    ids = rng.permutation(1000)
    v = spark.createDataFrame([(f"p{i:04d}" if i else None, e.tolist()) for i, e in zip(ids.tolist(), x, strict=True)], "vec_id string, embedding array<double>").repartition(2)
    asked = spark.createDataFrame([(f"q{i}", rng.normal(size=8).tolist()) for i in range(6)] + [("zero", [0.0] * 8)], "vec_id string, embedding array<double>")
    monkeypatch.setattr(search, "SCORES", 7 * 16)
    sent, plan = [], type(v).mapInArrow
    monkeypatch.setattr(type(v), "mapInArrow", lambda self, *a, **b: (sent.append(plan(self, *a, **b)), sent[-1])[1])
    got = search.nearest(v, asked)
    rows = [tuple(r) for r in got.select("query", "vec_id", "rank").collect()]
    want = []
    for q in asked.collect():
        score = np.round(x @ np.array(q["embedding"]), 9)
        order = sorted(range(1000), key=lambda j: (-score[j], ids[j]))[:5]
        want += [(q["vec_id"], f"p{ids[j]:04d}" if ids[j] else None, n) for n, j in enumerate(order, 1)]
    assert sorted(rows, key=str) == sorted(want, key=str)
    assert sent[0].count() <= 2 * 2 * 7 * 5


def test_a_sample_sorts_few_rows_and_is_fitted_in_parts(spark):
    rng = np.random.default_rng(9)
    v = spark.createDataFrame([(i, e.tolist()) for i, e in enumerate(rng.normal(size=(6000, 8)))], "vec_id long, embedding array<double>")
    few = search.sampled(v, "vec_id", 6000, 200)
    assert {r[0] for r in few.collect()} == {r[0] for r in v.orderBy(F.xxhash64("vec_id"), "vec_id").limit(200).select("vec_id").collect()}
    assert "Filter" in few._jdf.queryExecution().optimizedPlan().toString()
    a, b = search.fitted(few, 5, 1), search.fitted(few.repartition(3), 5, 1)
    assert a.shape == (5, 8) and np.allclose(a, b)


def test_encode_takes_texts_of_one_key_together(spark):
    texts = spark.createDataFrame([(1, "a b"), (1, "B c-1 \u00e9t\u00e9"), (None, "x"), (None, None), (2, "")], "i int, text string")
    got = {r["i"]: r["embedding"] for r in search.encode(texts, "i", 64).collect()}
    one = spark.createDataFrame([(1, "a b B c-1 \u00e9t\u00e9"), (None, "x"), (2, None)], "i int, text string")
    want = {r["i"]: r["e"] for r in one.select("i", search.encoded(F.col("text"), 64).alias("e")).collect()}
    assert got == want
    plan = search.encode(texts, "i", 64)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Generate" not in plan  # words are not rows


def test_generated_data(spark):
    got = one(spark, corpus.positions(F.array(*map(F.lit, "abcabca")), F.array(F.lit("a"), F.lit("b"))), corpus.positions(F.array(F.lit("a")), F.array(F.lit("a"), F.lit("b"))))
    assert got[0] == [0, 3] and got[1] == []
    e = registry.entities(spark, SF)
    demos = {(r["query_id"], r["kind"]): r["text"] for r in corpus.demonstrations(e).collect()}
    for (q, kind), t in list(demos.items())[:40]:
        got = one(spark, traces.halt(F.lit(t)), F.size(traces.actions(F.lit(t))))
        assert got[0] == "final_answer" and got[1] == (kind == "b"), q
    assert corpus.banned_ends(spark.createDataFrame([("a b c",), ("d",)], "phrase string")).count() == 2
    runs = spark.createDataFrame([("m", 1.0, 0.5, 0.01, 0.02), ("m", 2.0, 0.5, 0.01, 0.02), ("m", 3.0, 0.9, 0.06, 0.06), ("m", 4.0, 0.8, 0.04, 0.2), ("n", 1.0, 0.9, 0.2, 0.2)], "method string, magnitude double, fall double, retain_loss double, worst_loss double")
    assert [(r["method"], r["magnitude"]) for r in verdicts.choose_setting(runs).collect()] == [("m", 1.0)]
    got = one(spark, verdicts.adaptive_verdict(F.lit(0.05), F.lit(0.5)), verdicts.adaptive_verdict(F.lit(0.2), F.lit(0.04)), verdicts.adaptive_verdict(F.lit(0.2), F.lit(0.1)), verdicts.adaptive_verdict(F.lit(0.2), F.lit(0.07)))
    assert tuple(got) == ("inconclusive", "supported", "refuted", "partially supported")


def test_secrets_by_both_ways(spark, monkeypatch):
    secrets, docs = spark.read.parquet(f"{SF}/benchmark.parquet"), spark.read.parquet(f"{SF}/documents.parquet")
    few = {tuple(r) for r in search.secrets_in_documents(secrets, docs).collect()}
    monkeypatch.setattr(search, "AUTOMATON", 0)
    assert {tuple(r) for r in search.secrets_in_documents(secrets, docs).collect()} == few
    assert search.secrets_in_documents(secrets.limit(0), docs).count() == 0
    few = spark.createDataFrame([(1, "ob Sm"), (2, "x"), (3, "é ñ"), (4, "bob smith"), (5, ""), (6, "Smith, of rome"), (7, "ab")], "item_id long, text string")
    texts = spark.createDataFrame([(1, "Bob  Smithson"), (2, "xx é ñ xx"), (3, "a"), (4, None), (5, "bob smith, of rome"), (6, "x"), (7, "cab")], "doc_id long, text string")
    found = search.secrets_by_inner_word(few, texts)
    canon = lambda x: " ".join((x or "").lower().split())
    want = {(s["item_id"], t["doc_id"]) for s in few.collect() for t in texts.collect() if canon(s["text"]) and canon(s["text"]) in canon(t["text"])}
    assert {tuple(r) for r in found.collect()} == want and found.count() == len(want) >= 8
    assert "NestedLoop" not in found._jdf.queryExecution().executedPlan().toString()


def test_interventions_on_vectors(spark):
    v = spark.read.parquet(f"{SF}/embeddings.parquet")
    with pytest.raises(NotImplementedError):
        interventions.load("eco")
    for name in ("rlace_vectors", "leace_vectors"):
        assert interventions.load(name)().fit(v).transform(v).count() == v.count()
