"""Operators 3 and 10, and the pipeline."""
import itertools
import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline as C
from duelframe.llm import packing as P
from duelframe.llm import quality as K
from duelframe.llm import queries as Q
from duelframe.session import materialize
from llm_helpers import empty, llm, make_docs, odd, sentence  # noqa: F401

SF01 = "/root/testdata/sf0.01"


def base(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    at = [tuple(w[k:k + 5]) for k in range(len(w) - 4)]
    n = Counter(at)
    covered = {j for k, x in enumerate(at) if n[x] > 1 for j in range(k, k + 5)}
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(covered),
            len(w) < 10 or 100 * len(covered) > 20 * len(w))


COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]


def test_counts_equal_brute_force(llm):
    rnd = random.Random(1)
    texts = ["".join(rnd.choice("ab \n\t#é\x85") for _ in range(rnd.randint(0, 90))) for _ in range(300)]
    texts += [sentence(rnd, n, ["a", "b"]) for n in range(25)]
    rows = K.judge(make_docs(llm, texts), [0.0] * 8).collect()
    for r in rows:
        assert tuple(r[c] for c in COUNTS) == base(texts[r["doc_id"]]), texts[r["doc_id"]]


def test_query_equals_brute_force(llm):
    docs = {r["doc_id"]: r["text"] for r in llm.read.parquet(f"{SF01}/documents.parquet").collect()}
    trusted = {r["doc_id"] for r in llm.read.parquet(f"{SF01}/labels.parquet").where("quality = 1").collect()}
    rows = {r["doc_id"]: r for r in Q.op3_likelihood_ratio(llm, SF01).collect()}
    assert rows.keys() == docs.keys()
    # the score from the grams' buckets, counted here
    grams = {r["doc_id"]: r["g"] for r in llm.read.parquet(f"{SF01}/documents.parquet").select(
        "doc_id", K._let(K.hashed_words(F.col("text")), lambda h: K._grams(h, K.BUCKETS)).alias("g")).collect()}
    raw, target = Counter({b: 1 for b in range(K.BUCKETS)}), Counter({b: 1 for b in range(K.BUCKETS)})
    for i, g in grams.items():
        assert len(g) == max(0, 2 * len(re.findall(r"[^\x20\x09-\x0D]+", docs[i])) - 1)
        raw.update(g)
        if i in trusted:
            target.update(g)
    n, m = sum(raw.values()), sum(target.values())
    for i, r in rows.items():
        assert tuple(r[c] for c in COUNTS) == base(docs[i])
        score = sum(math.log(target[b] / m * n / raw[b]) for b in grams[i]) / max(1, len(grams[i]))
        assert r["score"] == pytest.approx(score, abs=1e-9)
        assert r["kept"] == (not r["base_failed"] and r["score"] >= K.THRESHOLD)
    good = [r for i, r in rows.items() if i in trusted and not r["base_failed"]]
    assert sum(r["kept"] for r in good) >= 0.99 * len(good)


def test_no_python_in_the_plan(llm, capsys):
    docs = make_docs(llm, ["a b c"])
    K.judge(docs, [0.0] * 4).explain("extended")
    assert not re.search("Python|Pandas|Arrow", capsys.readouterr().out)


def test_quality_odd_rows(odd, empty, llm):
    ratios = K.log_ratios(odd, odd.select("doc_id").where("doc_id = 5"))
    got = K.judge(odd, ratios)
    rows = got.collect()
    assert len(rows) == odd.count() and len({c.lower() for c in got.columns}) == len(got.columns)
    for r in rows:
        assert tuple(r[c] for c in COUNTS) == base(r["text"] or "")
        if not r["n_words"]:
            assert r["score"] == 0 and not r["kept"]
    assert set(K.log_ratios(odd, odd.select("doc_id").where("false"))) == {0.0}
    assert set(K.log_ratios(empty, odd.select("doc_id"))) == {0.0}
    assert K.judge(empty, ratios).count() == 0


def padding(lengths, edges):
    return sum(min(e for e in edges if e >= n) - n for n in lengths)


@pytest.mark.parametrize("seed", range(6))
def test_edges_are_optimal(seed):
    rnd = random.Random(seed)
    lengths = [rnd.choice([0, 1, 2, 5, 9, 30, 31, 77, 400]) if seed % 2 else rnd.randint(0, 40) for _ in range(60)]
    values = sorted(set(lengths))
    n = Counter(lengths)
    for buckets in (1, 2, 3, 4):
        edges = P.optimal_edges(np.array(values), np.array([n[v] for v in values]), np.array([v * n[v] for v in values]), buckets)
        best = min(padding(lengths, [*c, values[-1]]) for k in range(min(buckets, len(values)))
                   for c in itertools.combinations(values[:-1], k))
        assert len(edges) <= buckets and edges[-1] == values[-1] and padding(lengths, edges) == best


@pytest.mark.parametrize("seed", range(4))
def test_edges_equal_the_quadratic_program(seed):
    """Many entries: least padding by the plain recurrence."""
    rnd = random.Random(seed)
    n = Counter(int(rnd.lognormvariate(5, 1.5)) if seed % 2 else rnd.randint(0, 5000) for _ in range(600))
    values = sorted(n)
    c = [0, *itertools.accumulate(n[v] for v in values)]
    s = [0, *itertools.accumulate(v * n[v] for v in values)]
    best = [v * c[j + 1] - s[j + 1] for j, v in enumerate(values)]
    for buckets in range(1, 8):
        edges = P.optimal_edges(np.array(values), np.array([n[v] for v in values]), np.array([v * n[v] for v in values]), buckets)
        assert len(edges) <= buckets and edges[-1] == values[-1] and padding(n.elements(), edges) == best[-1]
        best = [min([best[j]] + [best[i] + v * (c[j + 1] - c[i + 1]) - (s[j + 1] - s[i + 1]) for i in range(j)])
                for j, v in enumerate(values)]


def test_padding_of_long_documents_is_the_least(llm):
    """A whole table of 1,025 to 20,000 words against the exact optimum over all its lengths."""
    rnd = random.Random(7)
    lengths = [rnd.randint(1025, 20_000) for _ in range(400)] + [rnd.randint(1025, 1040) for _ in range(100)]
    df = llm.createDataFrame([(i, n) for i, n in enumerate(lengths)], "doc_id long, n long")
    n = Counter(lengths)
    values = sorted(n)
    edges = P.optimal_edges(np.array(values), np.array([n[v] for v in values]), np.array([v * n[v] for v in values]))
    assert P.pack(df, F.col("n")).agg(F.sum("padding")).first()[0] == padding(lengths, edges)


def test_rows_of_one_id_are_spread(llm):
    df = llm.createDataFrame([(7 if i < 300 else i, 5) for i in range(400)], "doc_id long, n long")
    rows = P.pack(df, F.col("n"), group_rows=50).collect()
    assert len(rows) == 400 and max(Counter(r["part"] for r in rows).values()) < 120
    check_batches(rows, P.TOKEN_BUDGET)


def check_batches(rows, budget):
    batches = {}
    for r in rows:
        assert 0 <= r["n_tokens"] <= r["edge"] and r["padding"] == r["edge"] - r["n_tokens"]
        batches.setdefault((r["bucket"], r["part"], r["batch"]), []).append(r)
    for b in batches.values():
        assert sorted(r["slot"] for r in b) == list(range(len(b)))
        assert len(b) * b[0]["edge"] <= budget or len(b) == 1
    return batches


def test_batches_keep_the_budget(llm):
    rnd = random.Random(1)
    texts = [sentence(rnd, rnd.choice([0, 3, 3, 3, 50, 51, 400]), ["a", "b"]) for _ in range(400)]
    rows = P.pack(make_docs(llm, texts), P.word_count(F.col("text")), buckets=4, budget=600, group_rows=40).collect()
    assert sorted(r["doc_id"] for r in rows) == list(range(400))
    assert all(r["n_tokens"] == len((texts[r["doc_id"]]).split()) for r in rows)
    batches = check_batches(rows, 600)
    parts = {k[:2] for k in batches}
    full = sum(len(b) == max(1, 600 // max(1, b[0]["edge"])) for b in batches.values())
    assert full >= len(batches) - len(parts)              # one unfilled batch a part at most


def test_long_lengths_share_bounded_entries(llm):
    n = [*range(0, 1100), 5000, 5001, 10**6, 10**6 + 1, 10**9]
    df = llm.createDataFrame([(i,) for i in n], "n long")
    got = {r["n"]: r["e"] for r in df.select("n", P._entry(F.col("n")).alias("e")).collect()}
    assert all(got[i] == i for i in range(1025)) and all(i <= got[i] <= i * (1 + 1 / 64) for i in n)


def test_packing_heavy_id_leaves_others_alone(llm):
    """An id with more rows than a group is dealt by place; no other row's group changes."""
    once = llm.createDataFrame([(i, 3) for i in range(300)], "doc_id long, n long")
    many = llm.createDataFrame([(1000, 3)] * 300, "doc_id long, n long")
    both = P.pack(once.union(many).repartition(3), F.col("n"), group_rows=100).collect()
    own = {r.doc_id: r.part for r in P.pack(once.union(llm.range(2000, 2300).selectExpr("id", "3 as n")), F.col("n"),
                                            group_rows=100).collect()}
    assert all(own[r.doc_id] == r.part for r in both if r.doc_id < 300)
    held = Counter(r.part for r in both if r.doc_id == 1000)
    assert len(held) == 6 and max(held.values()) < 100
    assert len({(r.bucket, r.part, r.batch, r.slot) for r in both}) == 600
    # the places are those of the written table: reading the result again gives the same batches
    df = P.pack(once.union(many), F.col("n"), group_rows=100)
    assert sorted(df.collect()) == sorted(df.collect())


def test_packing_odd_rows(odd, empty):
    got = P.pack(odd, P.word_count(F.col("text")))
    rows = got.collect()
    assert len(rows) == odd.count() and len({c.lower() for c in got.columns}) == len(got.columns)
    check_batches(rows, P.TOKEN_BUDGET)
    assert {r["n_tokens"] for r in rows if r["text"] is None} == {0}
    assert P.pack(empty, P.word_count(F.col("text"))).count() == 0


def test_pipeline_stages(llm):
    docs = llm.read.parquet(f"{SF01}/documents.parquet")
    assert [n for n, _ in C.STAGES] == ["language", "toxicity", "near_duplicates", "secrets", "packing"]
    seen = [docs]
    for name, stage in C.STAGES:
        seen.append(materialize(stage(llm, seen[-1], SF01), f"test-{name}"))
        if name != "packing":
            assert seen[-1].columns == docs.columns and seen[-1].dtypes == docs.dtypes
    ids = [[r["doc_id"] for r in d.select("doc_id").collect()] for d in seen]
    assert all(len(set(x)) == len(x) for x in ids)
    assert len(ids[1]) >= 0.99 * len(ids[0]) and len(ids[2]) >= 0.85 * len(ids[1])
    texts = [r["text"] for r in seen[3].collect()]
    assert len(set(texts)) == len(texts)
    assert set(ids[3]) == set(ids[4]) == set(ids[5])
    changed = seen[4].alias("a").join(seen[3].alias("b"), "doc_id").where("a.text <> b.text").select("a.text", "a.n_chars").collect()
    assert changed and all("[SECRET]" in r["text"] and r["n_chars"] == len(r["text"]) for r in changed)
    last = {tuple(sorted(r.asDict().items())) for r in seen[5].select("doc_id", "n_tokens", "bucket", "edge").collect()}
    again = {tuple(sorted(r.asDict().items())) for r in C.run(llm, SF01).select("doc_id", "n_tokens", "bucket", "edge").collect()}
    assert last == again


def test_language_stage_without_languages(llm):
    texts = ["a clean text", "日本", "été", None, "", "123 !", "ʰ"]
    docs = make_docs(llm, texts, [None] * len(texts))
    kept = C.keep_language(llm, docs, SF01)
    assert kept.columns == docs.columns and sorted(r["doc_id"] for r in kept.collect()) == [0, 1, 2, 6]


def test_pipeline_odd_rows(odd, empty, llm):
    for docs in (odd, empty.union(empty)):
        out = docs
        for _, stage in C.STAGES:
            out = materialize(stage(llm, out, SF01), "test-odd")
        assert out.count() <= docs.count()
