"""D1-D9 and A3 on hand-made rows, plus the properties listed in the test plan."""

import math

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from duelframe.config import PrefConfig
from duelframe.functions.metrics import mean_logp_margin, summary_aggs, with_dpo_metrics


def _df(spark, rows):
    return spark.createDataFrame(rows, "pc double, pr double, rc double, rr double")


def _ref_loss(z, beta, eps):
    def logsig(x):
        return -math.log1p(math.exp(-x)) if x >= 0 else x - math.log1p(math.exp(x))
    return -(1 - eps) * logsig(beta * z) - eps * logsig(-beta * z)


def test_hand_values(spark):
    rows = [(-10.0, -12.0, -11.0, -11.5), (-5.0, -5.0, -5.0, -5.0)]
    out = with_dpo_metrics(_df(spark, rows), PrefConfig(beta=0.1)).orderBy("pc").collect()
    a, b = out[0], out[1]
    # row 1: z = (-10+12) - (-11+11.5) = 1.5
    assert math.isclose(a.z, 1.5)
    assert math.isclose(a.loss, _ref_loss(1.5, 0.1, 0.0), rel_tol=1e-12)
    assert math.isclose(a.reward_chosen, 0.1 * (-10 + 11))
    assert math.isclose(a.reward_rejected, 0.1 * (-12 + 11.5))
    assert a.correct is True
    # row 2: tie counts as wrong, loss ln 2
    assert b.z == 0.0 and b.correct is False
    assert math.isclose(b.loss, math.log(2), rel_tol=1e-12)


def test_policy_equals_reference_degenerates(spark):
    rows = [(-3.0, -7.0, -3.0, -7.0), (-1.0, -0.5, -1.0, -0.5)]
    s = with_dpo_metrics(_df(spark, rows)).agg(*summary_aggs()).first()
    assert math.isclose(s.loss, math.log(2), rel_tol=1e-12)
    assert s.reward_margin == 0.0 and s.accuracy == 0.0


def test_label_smoothing_symmetry_and_reference_free(spark):
    rows = [(-2.0, -9.0, -4.0, -3.0)]
    z = (-2.0 + 9.0) - (-4.0 + 3.0)
    m = with_dpo_metrics(_df(spark, rows), PrefConfig(label_smoothing=0.2)).first()
    assert math.isclose(m.loss, _ref_loss(z, 0.1, 0.2), rel_tol=1e-12)
    swapped = with_dpo_metrics(_df(spark, [(-9.0, -2.0, -3.0, -4.0)]), PrefConfig(label_smoothing=0.8)).first()
    assert math.isclose(m.loss, swapped.loss, rel_tol=1e-12)   # loss(z, e) = loss(-z, 1-e)
    rf = with_dpo_metrics(_df(spark, rows), PrefConfig(reference_free=True)).first()
    assert math.isclose(rf.z, 7.0) and math.isclose(rf.reward_chosen, -0.2)


def test_loss_finite_for_large_logits(spark):
    rows = [(0.0, 10000.0, 0.0, 0.0), (10000.0, 0.0, 0.0, 0.0)]
    out = with_dpo_metrics(_df(spark, rows)).orderBy("pc").collect()
    assert math.isclose(out[0].loss, 1000.0, rel_tol=1e-9)   # beta*z = -1000
    assert out[1].loss == 0.0 or out[1].loss < 1e-300


def test_nan_counts_as_wrong(spark):
    rows = [(float("nan"), -1.0, -1.0, -1.0)]
    assert with_dpo_metrics(_df(spark, rows)).first().correct is False


def test_mean_logp_margin_null_on_empty(spark):
    df = spark.createDataFrame([(-4.0, 2, -3.0, 0)], "sc double, nc int, sr double, nr int")
    assert df.select(mean_logp_margin("sc", "nc", "sr", "nr").alias("m")).first().m is None


@settings(max_examples=5, deadline=None)
@given(st.lists(st.tuples(*[st.floats(-500, 0, allow_nan=False)] * 4), min_size=1, max_size=30),
       st.floats(-100, 100, allow_nan=False))
def test_properties(spark, rows, shift):
    cfg = PrefConfig()
    base = with_dpo_metrics(_df(spark, rows), cfg)
    swapped = with_dpo_metrics(_df(spark, [(pr, pc, rr, rc) for pc, pr, rc, rr in rows]), cfg)
    shifted = with_dpo_metrics(_df(spark, [(pc + shift, pr, rc + shift, rr) for pc, pr, rc, rr in rows]), cfg)
    a = base.agg(F.sum("reward_margin"), F.sum("z")).first()
    b = swapped.agg(F.sum("reward_margin"), F.sum("z")).first()
    c = shifted.agg(F.sum("z")).first()
    assert math.isclose(a[0], -b[0], abs_tol=1e-6)          # swapping sides negates the margin
    assert math.isclose(a[1], c[0], abs_tol=1e-6)           # common shift of pc and rc changes nothing
    for r in base.collect():                                 # delta_margin * beta = reward_margin
        assert math.isclose(r.z * cfg.beta, r.reward_margin, abs_tol=1e-9)
        assert math.isfinite(r.loss)
