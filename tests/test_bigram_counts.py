"""Counts combined inside a task, the key map there, sides cut once, and walks over the reached words."""

import random
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from duelframe.operators import bigram_counts as BC
from duelframe.operators import generation as G
from duelframe.operators import scoring as SC

TEXTS = ["the cat sat on the mat the cat", None, "", " \t\r\n", "solo", " the\x0bcat\x0csat\n", "a b a b c", "ein Wört Wört Wört", "x\x1cy x\x1cy"]


def _piece(texts, flags):
    return pa.table({"text": pa.array(texts, pa.string()), "a": pa.array([1] * len(texts)), "b": pa.array(flags)})


def _want(texts, flags, only_first):
    out = {}
    for t, f in zip(texts, flags):
        toks = [x for x in __import__("re").split(r"[ \t\n\x0b\f\r]+", t or "") if x]
        for i, w in enumerate(toks):
            if i == 0 or not only_first:
                out.setdefault((None, w), []).append((1, f, int(i + 1 < len(toks)), f * (i + 1 < len(toks))))
            if i:
                out.setdefault((toks[i - 1], w), []).append((1, f, 0, 0))
    return {k: tuple(map(sum, zip(*v))) for k, v in out.items()}


def test_a_piece_gives_one_row_for_each_distinct_bigram():
    flags = [i % 2 for i in range(len(TEXTS))]
    for only_first in (False, True):
        rows = [r for b in BC._count_piece(_piece(TEXTS * 3, flags * 3), only_first, ["prev", "w", "c_a", "c_b", "x_a", "x_b"]) for r in b.to_pylist()]
        got = {(r["prev"], r["w"]): (r["c_a"], r["c_b"], r["x_a"], r["x_b"]) for r in rows}
        assert len(rows) == len(got)                       # tokens repeated in a piece do not leave the task
        assert got == _want(TEXTS * 3, flags * 3, only_first)
    assert list(BC._count_piece(_piece([None, " "], [0, 1]), False, ["prev", "w", "c_a", "c_b", "x_a", "x_b"])) == []


def test_pieces_hold_every_row_once():
    texts = [("w%d " % i) * (i % 50) for i in range(500)] + ["long " * 5000, None]
    batches = _piece(texts, [0] * len(texts)).to_batches(max_chunksize=70)
    pieces = list(BC._pieces(iter(batches), 1000))
    assert [t for p in pieces for t in p.column("text").to_pylist()] == texts and len(pieces) > 10


def test_tasks_give_the_scored_bigrams_only(spark):
    rng = random.Random(3)
    texts = [" ".join(rng.choice(["w%d" % i for i in range(300)]) for _ in range(200)) for _ in range(60)]
    docs = spark.createDataFrame([(t,) for t in texts], "text string")
    keys = spark.createDataFrame([("w1", "w2"), ("w7", "w7"), ("none", "w3"), ("", "w4")], "prev string, w string")
    every = BC.bigram_rows(docs, {"m": F.lit(True)})
    told = BC.bigram_rows(docs, {"m": F.lit(True)}, bits=SC.key_bits(keys))

    def summed(df):
        return {(r.prev, r.w): (r.c, r.x) for r in df.groupBy("prev", "w").agg(F.sum("c_m").alias("c"), F.sum("x_m").alias("x")).collect()}

    whole, some = summed(every), summed(told)
    assert some == {k: v for k, v in whole.items() if k in some} and len(some) < 320 < len(whole)
    assert set(some) >= {k for k in whole if k[0] is None} | {k for k in (("w1", "w2"), ("w7", "w7")) if k in whole}
    passed = SC.may_be_key(every.select("prev", "w"), SC.key_map(keys)).distinct().collect()
    assert {(r.prev, r.w) for r in passed} == set(some)    # the map gives the same answer on Spark's rows
    assert not SC.key_bits(keys.limit(0)).any() and np.unpackbits(SC.key_bits(keys).view(np.uint8)).sum() == 4


def test_sides_are_cut_and_counted_once(spark):
    docs = spark.createDataFrame([("a b c a b",), ("b a",)], "text string")
    sides = spark.createDataFrame([(1, "chosen", None, ["a", "b"]), (1, "rejected", "a", []), (None, "chosen", "a", ["b"])],
                                  "pair_id long, side string, context0 string, answer_tokens array<string>")
    df = SC.sequence_logps_wide(sides, SC.CorpusModels(("m",), docs, {"m": F.lit(True)}))
    assert "Generate" not in df._jdf.queryExecution().executedPlan().toString()     # read from the written table
    assert sorted((r.pair_id or 0, r.side, r.n_tokens) for r in df.collect()) == [(0, "chosen", 1), (1, "chosen", 2), (1, "rejected", 0)]
    none = SC.sequence_logps_wide(sides.where("pair_id = 5"), SC.CorpusModels(("m",), docs, {"m": F.lit(True)}))
    assert none.collect() == []


def test_continuations_are_walked_once_for_each_last_word(spark, monkeypatch):
    """One walk for all prompts that end alike; several rows and null ids as by a walk for each prompt."""
    table = spark.createDataFrame([("m", f"w{i}", f"w{i * 7 % 40}") for i in range(1, 300)], "model_id string, prev string, next_word string")
    rows = [(i, "m", f"w{i % 3 + 100}") for i in range(900)] + [(1, "m", "w5"), (1, "m", "w5"), (None, "m", "w9"), (2, "m", "end")]
    seeds = spark.createDataFrame(rows, "prompt_id long, model_id string, word string")
    want = G.continuation_text(G.greedy_extend(seeds.where("prompt_id IS NOT NULL"), table, 21)).collect()
    asked, extend = [], G.greedy_extend
    monkeypatch.setattr(G, "greedy_extend", lambda s, *a: asked.append(s.count()) or extend(s, *a))
    got = G.continuations(seeds, table, 21).collect()
    assert Counter(map(tuple, got)) == Counter(map(tuple, want)) and len(got) == 900
    assert asked == [3 + 3 + 2]                            # three last words, and the two ids with several rows


def test_the_map_is_cut_to_words_that_walks_come_to(spark):
    on = spark.createDataFrame([("m", f"r{i}", f"w{i % 10}") for i in range(2000)] + [("m", f"w{i}", f"w{i * 3 % 10}") for i in range(10)],
                               "model_id string, word string, there string")
    starts = spark.createDataFrame([("m", "r5"), ("m", "nowhere")], "model_id string, word string")
    left = {r.word for r in G._walked(on, starts).collect()}
    assert left == {"r5"} | {f"w{i}" for i in range(10)}
