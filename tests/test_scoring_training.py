"""L1-L8 against brute force on small corpora, R2-R6 against loops, fixture facts at sf0.01."""

import math
from collections import Counter

import pytest
from pyspark.sql import functions as F

from conftest import SF01
from duelframe.config import TRAINER_CAPS
from duelframe.functions.logits import log_softmax_gather
from duelframe.operators import scoring as SC
from duelframe.operators import sides as S
from duelframe.operators import training as TR
from duelframe.sources import fixtures as fx

DOCS = ["the cat sat on the mat", "the dog sat", "a cat and a dog", "mat mat mat the"]


def brute_logp(prev, w, docs, alpha):
    toks = [d.split() for d in docs]
    uni = Counter(t for d in toks for t in d)
    bi = Counter((d[i], d[i + 1]) for d in toks for i in range(len(d) - 1))
    ctx = Counter(d[i] for d in toks for i in range(len(d) - 1))
    n, v = sum(uni.values()), len(uni)
    p_uni = (uni[w] + 1) / (n + v + 1)
    return math.log((bi[(prev, w)] + alpha * p_uni) / (ctx[prev] + alpha))


def test_bigram_scores_match_brute_force(spark):
    docs = spark.createDataFrame([(i, t, i % 2 == 0) for i, t in enumerate(DOCS)], "doc_id long, text string, q boolean")
    model = SC.fit_bigram(docs, {"ref": F.lit(True), "pol": F.col("q")}, alpha=3.0)
    sides = spark.createDataFrame(
        [(1, "chosen", "the", ["cat", "sat", "zebra"]), (1, "rejected", None, ["dog"]), (2, "chosen", "mat", []),
         (2, "rejected", "mat", ["the"])],
        "pair_id long, side string, context0 string, answer_tokens array<string>")
    got = {(r.pair_id, r.side): r for r in SC.sequence_logps_wide(sides, model).collect()}
    exp = brute_logp("the", "cat", DOCS, 3.0) + brute_logp("cat", "sat", DOCS, 3.0) + brute_logp("sat", "zebra", DOCS, 3.0)
    assert math.isclose(got[(1, "chosen")].sum_ref, exp, rel_tol=1e-12)
    # the policy counts only its own documents but shares the corpus vocabulary (V = 8):
    # no context word, so p = p_uni(dog) = (1 + 1) / (11 + 8 + 1)
    assert got[(1, "rejected")].n_tokens == 1
    assert math.isclose(got[(1, "rejected")].sum_pol, math.log(0.1), rel_tol=1e-12)
    assert got[(2, "chosen")].n_tokens == 0 and got[(2, "chosen")].sum_ref is None   # empty answer kept
    pl = {r.pair_id: r for r in SC.pair_logps(SC.sequence_logps_wide(sides, model), "pol", "ref").collect()}
    assert pl[2].n_chosen == 0 and pl[2].n_rejected == 1
    nan = {(r.pair_id, r.side): r for r in SC.sequence_logps_wide(sides, model, empty="nan").collect()}
    assert math.isnan(nan[(2, "chosen")].sum_ref) and math.isnan(nan[(2, "chosen")].mean_ref)
    assert math.isclose(nan[(1, "chosen")].mean_ref, exp / 3, rel_tol=1e-12)
    masked = {(r.pair_id, r.side): r for r in SC.sequence_logps_wide(sides, model, mask_token="sat").collect()}
    assert masked[(1, "chosen")].n_tokens == 2       # L3: the masked position is not scored
    assert math.isclose(masked[(1, "chosen")].sum_ref,
                        brute_logp("the", "cat", DOCS, 3.0) + brute_logp("sat", "zebra", DOCS, 3.0), rel_tol=1e-12)


def test_counts_of_the_scored_words_give_the_fit_scores(spark):
    """Counted for the keys only, or fitted whole: equal scores, with null, empty and one-word texts,
    words that only end texts, unseen words, and models without documents."""
    texts = [*DOCS, None, "", "   ", "solo", "cat", "the the the the", "of  a\tcat\n"]
    docs = spark.createDataFrame([(i, t, None if i % 5 == 0 else i % 2 == 0) for i, t in enumerate(texts)], "doc_id long, text string, q boolean")
    models = {"ref": F.lit(True), "pol": F.col("q"), "none": F.lit(False)}
    words = ["the", "cat", "sat", "solo", "zebra", "of", "a", ""]
    keys = spark.createDataFrame([(p, w) for p in words for w in words if w], "prev string, w string")
    want = {(r.prev, r.w): r for r in SC.key_logps(keys, SC.fit_bigram(docs, models, alpha=3.0)).collect()}
    got = {(r.prev, r.w): r for r in SC.key_logps(keys, SC.CorpusModels(tuple(models), docs, models, alpha=3.0)).collect()}
    assert got == want and len(got) == keys.count()
    full = [t or "" for t in texts]
    assert all(math.isclose(r.lp_ref, brute_logp(*k, full, 3.0), rel_tol=1e-12) for k, r in got.items())
    one = {(r.prev, r.w): r.lp_pol for r in SC.key_logps(keys, SC.CorpusModels(tuple(models), docs, models, alpha=3.0), ("pol",)).collect()}
    assert one == {k: r.lp_pol for k, r in want.items()}
    empty = SC.key_logps(keys, SC.CorpusModels(("ref",), docs.limit(0), {"ref": F.lit(True)})).collect()
    assert len(empty) == keys.count() and all(math.isclose(r.lp_ref, 0.0, abs_tol=1e-12) for r in empty)


def test_the_map_of_keys_passes_every_key_and_few_others(spark, monkeypatch):
    keys = spark.range(3000).select(F.concat(F.lit("p"), (F.col("id") % 50).cast("string")).alias("prev"),
                                    F.concat(F.lit("w"), F.col("id").cast("string")).alias("w"))
    rows = spark.range(60000).select(F.concat(F.lit("p"), (F.col("id") % 50).cast("string")).alias("prev"),
                                     F.concat(F.lit("w"), F.col("id").cast("string")).alias("w"), F.lit(1).alias("n"))
    rows = rows.unionByName(spark.createDataFrame([(None, "w1", 1), (None, "none", 1)], "prev string, w string, n int"))
    passed = SC.may_be_key(rows, SC.key_map(keys))
    assert passed.columns == rows.columns
    got = {(r.prev, r.w) for r in passed.collect()}
    assert got >= {(r.prev, r.w) for r in keys.collect()} | {(None, "w1"), (None, "none")}
    assert len(got) < 3002 + 100                         # 57,000 others meet 3,000 of 67 million slots
    monkeypatch.setattr(SC, "BLOCKS", 2)                 # a full map still loses no key
    assert {(r.prev, r.w) for r in SC.may_be_key(keys, SC.key_map(keys)).collect()} == {(r.prev, r.w) for r in keys.collect()}
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(DOCS)], "doc_id long, text string")
    models = SC.CorpusModels(("ref",), docs, {"ref": F.lit(True)})
    some = spark.createDataFrame([("the", "cat"), ("", "sat"), ("zebra", "cat")], "prev string, w string")
    mapped = sorted(map(tuple, SC.key_logps(some, models).collect()))
    monkeypatch.setattr(SC, "SLOTS", 0)                  # without the map: the same
    assert sorted(map(tuple, SC.key_logps(some, models).collect())) == mapped


def test_saved_models_are_loaded(spark, tmp_dir):
    from conftest import SF001
    from duelframe.plans import catalog as Q
    Q.fit_models(spark, SF001).save(f"{tmp_dir}/models")
    want = sorted(map(tuple, Q.queries()["pair_logps"](spark, SF001).collect()))
    spark.conf.set(Q.MODELS_CONF, f"{tmp_dir}/models")
    try:
        assert sorted(map(tuple, Q.queries()["pair_logps"](spark, SF001).collect())) == want
    finally:
        spark.conf.unset(Q.MODELS_CONF)


def test_rollup_windows_hold_ten_steps(spark):
    log = spark.range(1, 26).select(F.lit("r").alias("run_id"), F.lit("t").alias("tag"), F.col("id").alias("step"),
                                    F.col("id").cast("double").alias("value"))
    got = sorted((r.bin, r.log_step, r.n, r.value) for r in TR.rollup_log(log, 10).collect())
    assert got == [(0, 10, 10, 5.5), (1, 20, 10, 15.5), (2, 30, 5, 23.0)]
    kept = sorted((r.step, r.is_last) for r in TR.checkpoint_steps(log, 10).collect())
    assert kept == [(10, False), (20, False), (25, True)]


def test_smoothing_keeps_a_null_group(spark):
    df = spark.range(1, 41).select(F.when(F.col("id") % 2 == 0, "r").alias("run_id"), F.ceil(F.col("id") / 2).alias("k"),
                                   F.col("id").cast("double").alias("value"))
    got = {}
    for r in TR.smooth(df, 0.8, ["run_id"], "k").collect():
        got.setdefault(r.run_id, {})[r.k] = r.smoothed
    last = {r.run_id: r.last_smoothed for r in TR.last_smoothed(df, 0.8, ["run_id"], "k").collect()}
    for run, first in (("r", 2), (None, 1)):
        want = _ema([float(v) for v in range(first, 41, 2)], 0.8)
        assert max(abs(got[run][i + 1] - x) for i, x in enumerate(want)) < 1e-9
        assert abs(last[run] - want[-1]) < 1e-9


def test_greedy_walk_equals_a_plain_walk(spark):
    from duelframe.operators import generation as G
    nxt = {f"w{i}": f"w{(i * 7 + 3) % 40}" for i in range(38)}          # w38 and w39 end a walk
    seeds = spark.createDataFrame([(i, "m", f"w{i % 40}") for i in range(50)], "prompt_id long, model_id string, word string")
    table = spark.createDataFrame([("m", a, b) for a, b in nxt.items()], "model_id string, prev string, next_word string")
    for steps in (0, 1, 5, 8, 21):
        want = set()
        for i in range(50):
            word = f"w{i % 40}"
            for k in range(steps + 1):
                want.add((i, k, word))
                if word not in nxt:
                    break
                word = nxt[word]
        got = [(r.prompt_id, r.step, r.word) for r in G.greedy_extend(seeds, table, steps).collect()]
        assert len(got) == len(want) and set(got) == want


def test_log_softmax_gather(spark):
    df = spark.createDataFrame([([1.0, 2.0, 3.0], 2), ([0.0, 0.0], 5)], "z array<double>, t int")
    out = df.select(log_softmax_gather("z", "t").alias("lp")).collect()
    assert math.isclose(out[0].lp, 3 - math.log(math.exp(1) + math.exp(2) + math.exp(3)), rel_tol=1e-12)
    assert out[1].lp is None


def _ema(values, w):
    e, out = 0.0, []
    for k, v in enumerate(values, 1):
        e = w * e + (1 - w) * v
        out.append(e / (1 - w ** k))
    return out


@pytest.mark.parametrize("w", [0.6, 0.8, 0.995])
def test_blocked_smoothing_equals_sequential_loop(spark, w):
    n = 2600   # several blocks for every weight
    df = spark.range(1, n + 1).select(F.lit("r").alias("run_id"), F.col("id").alias("k"),
                                      (F.sin(F.col("id")) * 10 + F.col("id") / 100).alias("value"))
    vals = [r.value for r in df.orderBy("k").collect()]
    want = _ema(vals, w)
    got = [r.smoothed for r in TR.smooth(df.repartition(7), w, ["run_id"], "k").orderBy("k").collect()]
    assert max(abs(a - b) for a, b in zip(got, want)) < 1e-9
    last = TR.last_smoothed(df, w, ["run_id"], "k").first()
    assert abs(last.last_smoothed - want[-1]) < 1e-9


def test_lr_schedule_shape(spark):
    steps = spark.range(100).select(F.col("id").alias("step_idx"), F.lit(100).alias("total_steps"))
    lr = {r.step_idx: r.lr for r in TR.lr_schedule(steps, peak=1e-6, warmup_ratio=0.03).collect()}
    assert lr[0] == 0.0 and math.isclose(lr[1], 1e-6 / 3) and math.isclose(lr[3], 1e-6)
    assert lr[99] < lr[50] < lr[3] and all(v >= 0 for v in lr.values())


def test_fixture_facts_sf0_01(spark):
    pairs = fx.pairs_raw(spark, SF01)
    assert pairs.count() == 98
    sd = S.sides(S.extract(pairs), TRAINER_CAPS)
    assert sd.where("side = 'chosen' AND prompt_len_raw > 128").count() == 72
    pos = S.extract(pairs, "positional")
    assert pos.where("valid").count() == 15                      # 83 of 98 differ from last-assistant
    assert pairs.where(F.get("chosen", 0).getField("role") == "system").count() == 22
    assert S.extract(pairs).where(F.size("prompt_msgs_chosen") == 1).count() == 15
    rep = S.truncation_report(sd)
    over = {r.side: r.n for r in rep.where("over_max_length").groupBy("side").agg(F.count("*").alias("n")).collect()}
    assert over == {"chosen": 37, "rejected": 40}
    assert rep.where("over_after_prompt_cut").count() == 0
    summ = TR.feature_deltas(fx.feature_pairs(spark, SF01))
    g = TR.gradient(summ, [0.0] * 64, 0.1).first()
    assert abs(sum(x * x for x in g.grad) - 1.941e-05) < 5e-9
    rolled = TR.rollup_log(fx.metric_log(spark, SF01), 10).withColumn("k", F.col("bin") + 1)
    total = TR.last_smoothed(rolled, 0.8, ["run_id", "tag"], "k").agg(F.sum("last_smoothed")).first()[0]
    assert abs(total - 246.30069) < 1e-4


def test_linear_fit_loss_falls(spark):
    log = TR.fit_linear_dpo(fx.feature_pairs(spark, SF01), 0.1, 60, 50.0).orderBy("step").collect()
    losses = [r.loss for r in log]
    assert abs(losses[0] - math.log(2)) < 1e-12
    assert all(b < a for a, b in zip(losses, losses[1:]))
    # the 60 steps evaluate the loss at theta after 0..59 updates; entry 60 is the fitted model
    assert abs(losses[59] - 0.649105) < 1e-6 and losses[60] < losses[59]


def _linear_pairs(spark, n, dim=3, seed=5):
    import random
    rng = random.Random(seed)
    rows = [(3 * i + 1, [rng.gauss(0.3, 1) for _ in range(dim)], [rng.gauss(0, 1) for _ in range(dim)]) for i in range(n)]
    df = spark.createDataFrame(rows, "pair_id long, phi_chosen array<double>, phi_rejected array<double>")
    return rows, df.orderBy(F.rand(1)).repartition(5)


def test_linear_epochs_match_a_loop(spark):
    """Steps in pair_id order, the partial one dropped, gradients of an epoch at its first theta,
    warm-up and cosine rates; blocks of 4 steps, so that running sums are carried on."""
    epochs, per, lr, beta, warmup = 3, 6, 4.0, 0.5, 0.2
    rows, df = _linear_pairs(spark, 100)
    got = sorted(TR.fit_linear_dpo_epochs(df, beta, epochs, lr, 2, 3, warmup, block=4).collect(), key=lambda r: r.step)
    spe = 100 // per
    warm = math.ceil(warmup * spe * epochs)
    assert [r.step for r in got] == list(range(1, spe * epochs + 1))
    theta = [0.0] * 3
    for e in range(epochs):
        start = list(theta)
        for k in range(spe):
            step = e * spe + k
            batch = [[a - b for a, b in zip(c, r)] for _, c, r in rows[per * k:per * (k + 1)]]
            s = [sum(t * x for t, x in zip(start, d)) for d in batch]
            grad = [sum(-beta / (1 + math.exp(beta * si)) * d[j] for si, d in zip(s, batch)) / per for j in range(3)]
            factor = step / warm if step < warm else 0.5 * (1 + math.cos(math.pi * (step - warm) / (spe * epochs - warm)))
            theta = [t - lr * factor / spe * g for t, g in zip(theta, grad)]
            r = got[step]
            assert r.epoch == e and r.n_pairs == per
            assert abs(r.loss - sum(math.log1p(math.exp(-beta * si)) for si in s) / per) < 1e-12
            assert abs(r.accuracy - sum(si > 0 for si in s) / per) < 1e-12
            assert abs(r.rate - lr * factor / spe) < 1e-12
            assert abs(r.grad_norm_sq - sum(g * g for g in grad)) < 1e-12
            assert abs(r.theta_norm_sq - sum(t * t for t in theta)) < 1e-9
    mean = [sum(r.loss for r in got if r.epoch == e) / spe for e in range(epochs)]
    assert abs(mean[0] - math.log(2)) < 1e-12 and mean[2] < mean[1] < mean[0]


def test_linear_epochs_odd_tables(spark):
    _, df = _linear_pairs(spark, 7)
    assert TR.fit_linear_dpo_epochs(df, epochs=2).count() == 0             # no full step
    assert TR.fit_linear_dpo_epochs(df.limit(0), epochs=2).count() == 0
    with pytest.raises(ValueError, match="identify"):
        TR.fit_linear_dpo_epochs(df.union(df))


def test_linear_epochs_jobs_do_not_grow_with_rows(spark):
    sc = spark.sparkContext
    jobs = []
    for n in (80, 1600):
        _, df = _linear_pairs(spark, n)
        sc.setJobGroup(f"epochs-{n}", "fit")
        try:
            log = TR.fit_linear_dpo_epochs(df, epochs=2)
        finally:
            sc.setLocalProperty("spark.jobGroup.id", None)
        jobs.append(len(sc.statusTracker().getJobIdsForGroup(f"epochs-{n}")))
        assert log.count() == 2 * n // 8
    assert jobs[0] == jobs[1] > 0


def test_f5_expected_values(spark):
    import __spark_entry__ as E
    pl = E.queries()["pair_logps"](spark, SF01)
    from duelframe.functions.metrics import with_dpo_metrics
    m = with_dpo_metrics(pl).agg(F.count("*").alias("n"), F.avg("reward_margin").alias("mm"),
                                 F.min("reward_margin").alias("lo"), F.max("reward_margin").alias("hi"),
                                 F.avg(F.col("correct").cast("double")).alias("acc")).first()
    assert m.n == 98 and abs(m.mm - (-0.017246722958)) < 1e-5
    assert abs(m.lo - (-7.692594681)) < 1e-5 and abs(m.hi - 6.761740897) < 1e-5
    assert abs(m.acc - 0.459184) < 1e-6


def test_scores_unchanged_by_repartition(spark):
    from conftest import SF001
    from duelframe.plans import catalog as Q
    m = Q._model(spark, SF001)
    sd = Q._sides(spark, SF001)
    want = {(r.pair_id, r.side): (r.n_tokens, round(r.sum_ref, 9), round(r.sum_policy, 9))
            for r in SC.sequence_logps_wide(sd, m, ("ref", "policy")).collect()}
    for n in (1, 7):
        got = {(r.pair_id, r.side): (r.n_tokens, round(r.sum_ref, 9), round(r.sum_policy, 9))
               for r in SC.sequence_logps_wide(sd.repartition(n), m, ("ref", "policy")).collect()}
        assert got == want


def test_policy_margins_by_pair_agree_with_summary(spark):
    from conftest import SF001
    from duelframe.operators import reports as RP
    from duelframe.plans import catalog as Q
    ids = ("ref", "policy", "nontoxic")
    seq = SC.sequence_logps_wide(Q._sides(spark, SF001), Q._model(spark, SF001, ids), ids)
    per_pair = RP.policy_margins_by_pair(seq, ["policy", "nontoxic"], "ref")
    summ = {r.policy_id: r for r in RP.compare_policies(seq, ["policy", "nontoxic"], "ref").collect()}
    agg = per_pair.agg(F.avg("margin_policy").alias("mp"), F.avg(F.col("correct_nontoxic").cast("double")).alias("an"),
                       F.count("*").alias("n")).first()
    assert agg.n == summ["policy"].n
    assert abs(agg.mp - summ["policy"].reward_margin) < 1e-12
    assert abs(agg.an - summ["nontoxic"].accuracy) < 1e-12


def test_prompt_bucket_counts_match_fixture_table(spark):
    import __spark_entry__ as E
    rows = E.queries()["length_buckets_prompt"](spark, SF01).collect()
    got = [(r.bucket, r.n) for r in rows]
    assert got == [("overall", 98), ("[0,32)", 6), ("[32,64)", 13), ("[64,96)", 3), ("[96,128)", 4),
                   ("[128,99999)", 72)]
