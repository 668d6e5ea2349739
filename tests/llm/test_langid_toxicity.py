"""Operators 6 and 4: exact code lengths, FTRL against a plain loop, held-out accuracy, odd rows."""
import math
import random
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from duelframe.llm import langid as L
from duelframe.llm import queries as Q
from duelframe.llm import toxicity as X
from llm_helpers import empty, llm, make_docs, odd, sentence  # noqa: F401

SF01 = "/root/testdata/sf0.01"
SF1 = "/root/testdata/sf0.1"


def plain_code_length(train, text):
    """PPM escape C by dictionaries: bits of ``text`` after learning ``train``."""
    seen = defaultdict(Counter)
    for t in train:
        b = bytes([L.PAD] * 3) + t.encode()
        for i in range(3, len(b)):
            for o in range(4):
                seen[b[i - o:i]][b[i]] += 1

    def bits(ctx, s):
        c = seen.get(ctx)
        shorter = (lambda: bits(ctx[1:], s)) if ctx else (lambda: 8.0)
        if not c:
            return shorter()
        total = sum(c.values()) + len(c)
        return -math.log2(c[s] / total) if c[s] else -math.log2(len(c) / total) + shorter()

    b = bytes([L.PAD] * 3) + text.encode()
    return sum(bits(b[i - 3:i], b[i]) for i in range(3, len(b)))


def test_code_lengths_are_exact(llm, monkeypatch):
    rnd = random.Random(2)
    en = [sentence(rnd, 20, ["the", "of", "and", "thing"]) for _ in range(10)]
    de = [sentence(rnd, 20, ["der", "über", "straße", "und"]) for _ in range(10)]
    model = L.train(make_docs(llm, en + de, ["en"] * 10 + ["de"] * 10))
    tests = ["the über thing", "", "日本 xyz", "der" * 50, "of\x00"]
    raw = "".join(tests).encode()
    off = np.cumsum([0] + [len(t.encode()) for t in tests])
    want = np.array([[plain_code_length(de, t), plain_code_length(en, t)] for t in tests])
    assert model.langs == ["de", "en"]
    for chunk in (1 << 19, 7, 1):
        monkeypatch.setattr(L, "CHUNK", chunk)
        got = L.code_lengths(model, np.frombuffer(raw, np.uint8), off)
        assert np.allclose(got, want, rtol=1e-5)


def test_sparse_maps():
    rnd = np.random.RandomState(3)
    for n in (0, 1, 2, 1000, 50_000):
        keys = np.unique(rnd.randint(0, 2 ** 32, n, dtype=np.uint64).astype(np.uint32))
        m = L.Sparse(keys, np.arange(len(keys)) + 1.0)
        ask = np.concatenate([keys, rnd.randint(0, 2 ** 32, 1000, dtype=np.uint64).astype(np.uint32), np.array([0, 2 ** 32 - 1], np.uint32)])
        known = {int(k): i + 1.0 for i, k in enumerate(keys)}
        got, found = m.get(ask)
        assert (got == [known.get(int(k), 0.0) for k in ask]).all() and (found == [int(k) in known for k in ask]).all()


def test_no_context_is_dropped_with_a_hundred_languages(llm):
    """Every context of every language counts, however many languages share the model."""
    rnd = random.Random(7)
    words = {f"l{k:03d}": ["".join(chr(rnd.randrange(97, 123)) for _ in range(rnd.randint(2, 6))) for _ in range(25)] for k in range(100)}
    texts = {name: [sentence(rnd, 30, w) for _ in range(3)] for name, w in words.items()}
    model = L.train(make_docs(llm, [t for v in texts.values() for t in v], [name for name, v in texts.items() for _ in v]))
    assert model.langs == sorted(texts)
    for name, tree in zip(model.langs, model.trees):
        padded = [bytes([L.PAD] * 3) + t.encode() for t in texts[name]]
        assert len(tree.escape3.keys) == len({b[i - 3:i] for b in padded for i in range(3, len(b))})
        assert len(tree.hit3.keys) == len({b[i - 3:i + 1] for b in padded for i in range(3, len(b))})
    tests = [sentence(rnd, 10, words["l042"]), sentence(rnd, 10, words["l099"]), "other words"]
    off = np.cumsum([0] + [len(t) for t in tests])
    got = L.code_lengths(model, np.frombuffer("".join(tests).encode(), np.uint8), off)
    for k in (0, 42, 99):
        assert np.allclose(got[:, k], [plain_code_length(texts[model.langs[k]], t) for t in tests], rtol=1e-5)
    assert got[0].argmin() == 42 and got[1].argmin() == 99
    with pytest.raises(ValueError, match="bytes"):
        L.train(make_docs(llm, ["some text"]), model_bytes=1000)


def test_all_contexts_of_the_given_table_are_kept(llm):
    docs = llm.read.parquet(f"{SF1}/documents.parquet")
    rows = L.training_rows(docs).where("lang IS NOT NULL AND text IS NOT NULL")
    model = L.train(L.training_rows(docs), docs_per_lang=10 ** 9)      # every training row
    for name, tree in zip(model.langs, model.trees):
        want = set()
        for (t,) in rows.where(F.col("lang") == name).select("text").limit(300).collect():
            b = bytes([L.PAD] * 3) + t.encode()
            want |= {b[i - 3:i + 1] for i in range(3, len(b))}
        keys = np.array([int.from_bytes(g, "big") for g in want], np.uint32)
        assert len(keys) and tree.hit3.get(keys)[1].all()


def test_language_held_out_accuracy(llm):
    rows = Q.op6_langid(llm, SF1).join(llm.read.parquet(f"{SF1}/documents.parquet").select("doc_id", "lang", "text"), "doc_id").toPandas()
    assert len(rows) == 10_000
    held = rows[rows["held_out"]]
    assert set(held["doc_id"]) == {i for i in rows["doc_id"] if zlib.crc32(str(i).encode()) % 4 == 2}
    assert (held["lang"] == held["lang_pred"]).mean() > 0.99
    assert rows["score"].between(0, 1).all()


def test_labels_of_held_out_rows_are_not_learned(llm):
    docs = make_docs(llm, [f"text number {i}" for i in range(40)])
    wrong = docs.withColumn("lang", F.when(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, "xx").otherwise("en"))
    assert L.train(L.training_rows(wrong)).langs == ["en"]


def test_language_odd_rows(odd, empty, llm):
    model = L.train(make_docs(llm, ["hello world the end", "hallo welt das ende"], ["en", "de"]))
    got = L.detect(odd, model)
    assert sorted(got.columns) == sorted(set(odd.columns) | set(L.RESULT))
    rows = got.collect()
    assert len(rows) == odd.count()
    by = {r["doc_id"]: r for r in rows if r["doc_id"] is not None}
    for i in (0, 1, 2, 4):
        assert by[i]["lang_pred"] == "und" and by[i]["score"] == 0
    assert by[7]["lang_pred"] in ("en", "de") and by[5]["lang_pred"] == by[6]["lang_pred"]
    none = L.train(empty)
    assert none.langs == [] and L.detect(empty, model).count() == 0
    assert {r["lang_pred"] for r in L.detect(odd, none).collect()} == {"und"}


def test_ftrl_equals_a_plain_loop():
    rnd = np.random.RandomState(0)
    docs = [np.unique(rnd.randint(0, 30, 6)).astype(np.uint32) for _ in range(60)]
    labels = np.array([float(3 in d) for d in docs])
    a, b, l1, l2 = 0.5, 1.0, 0.4, 0.1
    z, n = defaultdict(float), defaultdict(float)

    def w(k):
        if k != "b" and abs(z[k]) <= l1:
            return 0.0
        return -(z[k] - (math.copysign(l1, z[k]) if k != "b" else 0)) / ((b + math.sqrt(n[k])) / a + l2)
    for _ in range(2):
        for d, y in zip(docs, labels):
            keys = [*d.tolist(), "b"]
            ws = {k: w(k) for k in keys}
            g = 1 / (1 + math.exp(-sum(ws.values()))) - y
            for k in keys:
                z[k] += g - (math.sqrt(n[k] + g * g) - math.sqrt(n[k])) / a * ws[k]
                n[k] += g * g
    h, got, bias = X.ftrl(docs, labels, 2, a, b, l1, l2)
    assert bias == pytest.approx(w("b"))
    assert dict(zip(h.tolist(), got)) == pytest.approx({k: w(k) for k in range(30) if w(k)})


def test_toxicity_held_out(llm):
    rows = Q.op4_toxicity(llm, SF1).toPandas()
    truth = duckdb.sql(f"SELECT doc_id, toxic FROM '{SF1}/labels.parquet'").df()
    held = rows[rows["held_out"]].merge(truth, on="doc_id")
    assert len(rows) == 10_000 and rows["score"].between(0, 1).all()
    assert set(rows.loc[rows["held_out"], "doc_id"]) == {i for i in rows["doc_id"] if zlib.crc32(str(i).encode()) % 5 == 0}
    assert ((rows["score"] >= 0.5) == (rows["predicted"] == 1)).all()
    assert (held["predicted"] == held["toxic"]).mean() > 0.95
    assert held.loc[held["toxic"] == 0, "predicted"].mean() < 0.01
    assert held.loc[held["toxic"] == 1, "predicted"].mean() > 0.6


def test_toxicity_learns_no_held_out_label(llm):
    docs = make_docs(llm, [f"plain words {i}" for i in range(50)])
    labels = docs.select("doc_id", (F.crc32(F.col("doc_id").cast("string")) % 5 == 0).cast("int").alias("toxic"))
    model = X.train(docs, X.training_labels(labels))
    assert model.intercept < 0


def test_toxicity_odd_rows(odd, empty, llm):
    docs = make_docs(llm, ["you idiot fool"] * 30 + ["a fine day"] * 60)
    labels = llm.createDataFrame([(i, int(i < 30)) for i in range(90)] + [(None, 1), (5, None), (7, 1)], "doc_id long, toxic int")
    model = X.train(docs, labels)
    got = X.score(odd, model)
    rows = got.collect()
    assert len(rows) == odd.count() and sorted(got.columns) == sorted(set(odd.columns))
    by = {r["doc_id"]: r for r in rows if r["doc_id"] is not None}
    assert by[0]["score"] == by[1]["score"] == by[2]["score"] and 0 <= by[0]["score"] <= 1
    assert by[5]["score"] == by[6]["score"]
    assert X.score(docs, model).agg(F.sum("predicted")).first()[0] == 30
    nothing = X.train(docs, labels.where("false"))
    assert {r["score"] for r in X.score(odd, nothing).collect()} == {0.0}
    assert X.score(empty, model).count() == 0
