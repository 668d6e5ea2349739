"""L5 with a model outside Spark, and kept scores."""

import math
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import SF001
from duelframe.operators import external as X
from duelframe.operators import scoring as SC
from duelframe.plans import catalog as Q

ROWS = "pair_id long, side string, context0 string, answer_tokens array<string>"


def test_length_batches_hold_all_rows_within_the_budget():
    rnd = np.random.RandomState(1)
    n = np.concatenate([rnd.randint(0, 60, 500), [5000, 0]])
    batches = list(X.length_batches(n, 256))
    assert sorted(np.concatenate(batches)) == list(range(len(n)))
    assert all(len(b) == 1 or len(b) * n[b].max() <= 256 for b in batches)
    assert list(X.length_batches(np.zeros(0, int), 256)) == []


def test_external_scorer_loads_once_and_gets_similar_lengths(spark, tmp_dir):
    rows = [(i, "chosen", "c" if i % 2 else None, ["w"] * (i % 40)) for i in range(200)] + [(500, "chosen", None, None), (501, "rejected", "x", ["y"] * 900)]
    sides = spark.createDataFrame(rows, ROWS).coalesce(1)

    def load():
        open(os.path.join(tmp_dir, f"loaded-{os.getpid()}-{len(os.listdir(tmp_dir))}"), "w").close()
        return {"each": -2.0}

    def score(model, contexts, answers):
        longest = max(map(len, answers))
        assert len(answers) * longest <= 400 or len(answers) == 1
        return [model["each"] * len(a) - (c is None) for c, a in zip(contexts, answers)]

    got = {(r.pair_id, r.side): r for r in X.external_scores(sides, X.ExternalScorer("ext", load, score, 400)).collect()}
    assert len(got) == len(rows)
    for i, side, c, a in rows:
        r, n = got[(i, side)], len(a or [])
        assert r.n_tokens == n
        if n:
            assert r.sum_ext == -2.0 * n - (c is None) and r.mean_ext == pytest.approx(r.sum_ext / n)
        else:
            assert r.sum_ext is None and r.mean_ext is None
    workers = [x.split("-")[1] for x in os.listdir(tmp_dir)]
    assert workers and len(workers) == len(set(workers))              # once for each worker process


def test_class_bigram_equals_counts(spark):
    docs = spark.createDataFrame([("a b a b c",), ("b a",), (None,), ("",), ("z",)], "text string")
    scorer = X.class_bigram(docs)
    got = X.external_scores(spark.createDataFrame([(1, "chosen", "a", ["b", "a", "q"]), (2, "chosen", None, ["a"])], ROWS), scorer)
    import hashlib
    cls = lambda w: hashlib.md5(w.encode()).digest()[0]
    pairs = [(cls(x), cls(y)) for t in ("a b a b c", "b a") for x, y in zip(t.split(), t.split()[1:])]

    def lp(v, w):
        return math.log((sum(p == (cls(v), cls(w)) for p in pairs) + 1) / (sum(p[0] == cls(v) for p in pairs) + 256))

    want = {1: lp("a", "b") + lp("b", "a") + lp("a", "q"), 2: lp("", "a")}
    assert {r.pair_id: r.sum_classes for r in got.collect()} == pytest.approx(want)


def test_a_second_run_scores_nothing_old(spark, tmp_dir):
    sides = Q._sides(spark, SF001).select("pair_id", "side", "context0", "answer_tokens")
    model = Q._model(spark, SF001, ("ref", "policy", "nontoxic"))
    calls = []

    def scorer(rows, ids):
        calls.append((rows.count(), ids))
        return SC.sequence_logps_wide(rows, model, ids)

    store = X.ScoreStore(spark, os.path.join(tmp_dir, "scores"))
    old = sides.where("pair_id % 2 = 0")
    distinct_old = old.select(X.answer_digest()).distinct().count()
    store.score(old, ("ref", "policy"), scorer).count()
    assert store.added == 2 * distinct_old and calls == [(distinct_old, ("policy", "ref"))]
    store.score(old, ("ref", "policy"), scorer).count()
    assert store.added == 0 and len(calls) == 1                       # nothing old is scored again
    got = {(r.pair_id, r.side): r for r in store.score(sides, ("ref", "policy", "nontoxic"), scorer).collect()}
    every = sides.select(X.answer_digest()).distinct().count()
    assert store.added == 2 * (every - distinct_old) + every          # new answers, and the new model everywhere
    want = {(r.pair_id, r.side): r for r in SC.sequence_logps_wide(sides, model).collect()}
    assert set(got) == set(want)
    for k, r in want.items():
        for c in ("n_tokens", "sum_ref", "sum_policy", "sum_nontoxic", "mean_ref"):
            assert got[k][c] == (None if r[c] is None else pytest.approx(r[c]))
    assert store.table().groupBy("model", "digest").count().where(F.col("count") > 1).count() == 0
