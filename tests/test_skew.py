"""Hot keys of the scorer: a (prev, w) key that holds half of all answer tokens (the join back
is split by AQE), and a word with very many distinct successors (the key joins are salted)."""

import math
from collections import Counter

from pyspark.sql import functions as F

from duelframe.operators import scoring as SC


def test_hot_scoring_key_is_split_and_exact(spark):
    conf = {"spark.sql.autoBroadcastJoinThreshold": "-1",
            "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "16k",
            "spark.sql.adaptive.advisoryPartitionSizeInBytes": "16k",
            "spark.sql.shuffle.partitions": "16"}
    old = {k: spark.conf.get(k, None) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        docs = spark.createDataFrame([(i, "of the of the cat sat " * 20) for i in range(50)],
                                     "doc_id long, text string")
        model = SC.fit_bigram(docs, {"ref": F.lit(True)}, write_counts=False)
        n = 200_000
        hot = F.array(F.lit("the"))
        cold = F.array(F.concat(F.lit("w"), (F.col("id") % 997).cast("string")))
        sides = spark.range(n).select((F.col("id") * 7919 % 100_003).alias("pair_id"), F.lit("chosen").alias("side"),
                                      F.lit("of").alias("context0"),
                                      F.when(F.col("id") % 2 == 0, hot).otherwise(cold).alias("answer_tokens"))
        df = SC.sequence_logps_wide(sides, model)
        rows = df.collect()
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin(skew=true)" in plan, [x.strip()[:120] for x in plan.splitlines() if "Join" in x or "AQEShuffleRead" in x]
        assert sum(r.n_tokens for r in rows) == n
        # brute force over the same corpus (bigrams never cross documents)
        doc = ("of the of the cat sat " * 20).split()
        corpus = [doc] * 50
        uni = Counter(t for d in corpus for t in d)
        bi = Counter((d[i], d[i + 1]) for d in corpus for i in range(len(d) - 1))
        ctx = Counter(d[i] for d in corpus for i in range(len(d) - 1))
        total, v = sum(uni.values()), len(uni)

        def lp(prev, w):
            return math.log((bi[(prev, w)] + 100 * (uni[w] + 1) / (total + v + 1)) / (ctx[prev] + 100))

        want = (n // 2) * lp("of", "the") + (n // 2) * lp("of", "w-unseen")
        assert math.isclose(sum(r.sum_ref for r in rows), want, rel_tol=1e-9)
    finally:
        for k, v in old.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)


def test_a_word_with_many_successors_is_split(spark, monkeypatch):
    """200,000 distinct words follow one word: only that word is split, no task of its join holds
    them all, no other word's counts are repeated, and the scores are exact."""
    n = 200_000
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        docs = spark.range(n).select(F.col("id").alias("doc_id"), F.concat(F.lit("hub w"), F.col("id").cast("string")).alias("text"))
        model = SC.fit_bigram(docs, {"ref": F.lit(True)})
        keys = spark.range(n).select(F.lit("hub").alias("prev"), F.concat(F.lit("w"), F.col("id").cast("string")).alias("w"))
        assert [(r["_word"], r["_salts"]) for r in SC.heavy_words(keys, "prev", n).collect()] == [("hub", 4)]
        assert SC.heavy_words(keys, "w", n).count() == 0
        lp = SC.key_logps(keys, model)
        total, v = 2 * n, n + 1
        want = math.log((1 + 100 * 2 / (total + v + 1)) / (n + 100))
        stats = lp.agg(F.count("lp_ref"), F.min("lp_ref"), F.max("lp_ref")).first()
        assert stats[0] == n and math.isclose(stats[1], want) and math.isclose(stats[2], want)
        plan = lp._jdf.queryExecution().executedPlan().toString()
        assert "[prev" in plan and "_salt" in plan
        # the split join: 4 parts of the hub, and one row of counts for every other word
        joined = SC._join_word(keys, model.contexts.select("prev", "c_ref"), "prev", "w", [("hub", 4)])
        assert joined.count() == n and joined.where("c_ref IS NULL").count() == 0
        monkeypatch.setattr(SC, "HEAVY_KEYS", 10 ** 9)                 # nothing is heavy: a plain join
        assert "_salt" not in SC.key_logps(keys, model)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_heavy_words_are_bounded_and_few(spark, monkeypatch):
    monkeypatch.setattr(SC, "HEAVY_KEYS", 10)
    monkeypatch.setattr(SC, "HEAVY_WORDS", 8)
    keys = spark.range(4000).select(F.concat(F.lit("p"), (F.col("id") % 40).cast("string")).alias("prev"),
                                    F.concat(F.lit("w"), F.when(F.col("id") % 2 == 0, 0).otherwise(F.col("id")).cast("string")).alias("w"))
    found = {r["_word"]: r["_salts"] for r in SC.heavy_words(keys, "w", 4000).collect()}
    assert found == {"w0": 4}                                          # 2000 of 4000, over 1/8
    assert SC.heavy_words(keys, "prev", 4000).count() == 0             # 100 each: above 10, not above 1/8


def test_tokens_are_shuffled_once_for_each_distinct_bigram_of_a_side(spark):
    words = ["a", "b", "a", "b", "a", "b", "pad", "a", "pad", "pad"]
    rows = [(1, "chosen", "p", words, 7), (1, "rejected", None, [], 8), (2, "chosen", None, None, 9), (2, "rejected", "x", ["y"], 6)]
    sides = spark.createDataFrame(rows, "pair_id long, side string, context0 string, answer_tokens array<string>, batch_id long")
    got = SC.token_multiset(sides, ["batch_id"]).collect()
    prev = ["p", *words[:-1]]
    want = Counter((1, "chosen", 7, p, w) for p, w in zip(prev, words))
    assert Counter({(r.pair_id, r.side, r.batch_id, r.prev, r.w): r.n for r in got if r.w}) == want + Counter({(2, "rejected", 6, "x", "y"): 1})
    assert sorted((r.pair_id, r.side) for r in got if r.w is None) == [(1, "rejected"), (2, "chosen")]
    masked = SC.token_multiset(sides, mask_token="pad").where("pair_id = 1 AND side = 'chosen'").collect()
    assert {(r.prev, r.w): r.n for r in masked} == {(p, w): c for (_, _, _, p, w), c in want.items() if w != "pad"}
    # the same (prev, w) a thousand times is one row of the exchange
    long = spark.createDataFrame([(1, "chosen", "a", ["a"] * 1000)], "pair_id long, side string, context0 string, answer_tokens array<string>")
    assert [(r.prev, r.w, r.n) for r in SC.token_multiset(long).collect()] == [("a", "a", 1000)]
