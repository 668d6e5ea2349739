"""ST1-ST3 against batch results; S7/S8 write/read round trips; the driver contract."""

import datetime
import os
import random
import re

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from conftest import SF001, SF01
from duelframe.operators import training as TR
from duelframe.sources import fixtures as fx
from duelframe.sources.tables import checkpoint_names, read_checkpoints, read_metrics, write_checkpoint, write_metrics
from duelframe.streaming import live


def _split_events(folder, parts, order, mtimes):
    """The events log as time-ordered files, given modification times in the order asked for."""
    t = pq.read_table(f"{SF001}/events.parquet").sort_by([("ts", "ascending"), ("event_id", "ascending")])
    os.makedirs(folder)
    step = (t.num_rows + parts - 1) // parts
    for i in range(parts):
        f = os.path.join(folder, f"part-{i}.parquet")
        rows = t.slice(i * step, step) if order == "time" else t.take(list(range(i, t.num_rows, parts)))
        pq.write_table(rows, f)
        at = 1_700_000_000 + 60 * (mtimes[i] if mtimes else i)
        os.utime(f, (at, at))


def test_stream_rollup_complete_equals_batch_and_append_withholds(spark):
    full = live.run_stream_rollup(spark, SF01, "6 hours", "1 hour", "complete")
    assert full.count() == 600
    appended = live.run_stream_rollup(spark, SF01, "6 hours", "1 hour", "append")
    # the last window of each event type is still open when the input ends
    assert appended.count() == 595
    batch = (spark.read.parquet(f"{SF01}/events.parquet")
             .groupBy(F.window(F.col("ts").cast("timestamp"), "6 hours"), "event_type").count())
    assert batch.count() == 600


def test_stream_metrics_equals_batch_summary(spark):
    import __spark_entry__ as E
    s = live.run_stream_metrics(spark, SF001).first()
    b = E.queries()["dpo_summary"](spark, SF001).first()
    assert s.n == b.n and abs(s.loss - b.loss) < 1e-6 and abs(s.accuracy - b.accuracy) < 1e-6   # b is rounded to 6 dp


def test_stream_smooth_carries_state_across_micro_batches(spark, tmp_dir):
    # the events log split into time-ordered files, one micro-batch each
    src = os.path.join(tmp_dir, "events")
    _split_events(src, 4, "time", None)
    got = {r.run_id: r for r in live.run_stream_smooth(spark, SF001, 0.8, source_path=src,
                                                        max_files_per_trigger=1).collect()}
    ml = fx.metric_log(spark, SF001)
    want = {r.run_id: r for r in TR.last_smoothed(ml, 0.8, ["run_id"], "step").collect()}
    assert set(got) == set(want)
    for k in want:
        assert got[k].n_points == want[k].n_points
        assert abs(got[k].last_smoothed - want[k].last_smoothed) < 1e-9


def test_streams_agree_on_folders_uris_and_triggers(spark, tmp_dir):
    src = os.path.join(tmp_dir, "events.parquet")       # a folder by this name, as Spark writes it
    _split_events(src, 4, "time", [2, 0, 3, 1])         # files do not arrive in the order of their points
    ml = fx.metric_log(spark, SF001)
    want = {r.run_id: r for r in TR.last_smoothed(ml, 0.8, ["run_id"], "step").collect()}
    rolled = {(r.window_start, r.event_type): r.n for r in live.run_stream_rollup(spark, SF001).collect()}
    for path in (src, f"file://{src}"):
        for files in (1, 4):
            got = {r.run_id: r for r in live.run_stream_smooth(spark, SF001, 0.8, path, files).collect()}
            assert set(got) == set(want)
            assert all(got[k].n_points == want[k].n_points and abs(got[k].last_smoothed - want[k].last_smoothed) < 1e-9 for k in want)
        again = live.run_stream_rollup(spark, SF001, source_path=path)
        assert {(r.window_start, r.event_type): r.n for r in again.collect()} == rolled
    assert live.run_stream_metrics(spark, SF001, source_path=f"file://{SF001}/lineitem.parquet").first().n == 6000


def _smoothed(df):
    return {r.run_id: (r.n_points, r.last_smoothed) for r in df.collect()}


def _same_curves(got, want):
    assert set(got) == set(want)
    for k, (n, v) in want.items():
        assert got[k][0] == n and got[k][1] == pytest.approx(v, abs=1e-9)


@pytest.mark.parametrize("weight", [0.8, 0.3, 0.99, 0.0])
def test_overlapping_files_give_one_answer_at_any_trigger(spark, tmp_dir, weight):
    src = os.path.join(tmp_dir, "events")
    _split_events(src, 5, "interleaved", [3, 0, 4, 1, 2])          # every file spans the whole time range
    curve = fx.metric_log(spark, SF001)
    want = _smoothed(TR.last_smoothed(curve, weight, ["run_id"], "step"))
    for files in (1, 3, None):
        _same_curves(_smoothed(live.run_stream_smooth(spark, SF001, weight, src, files)), want)


def test_smoothing_state_keeps_what_counts(spark):
    """Merging states in any order equals the latest points of everything; a hot run, equal
    times, null values and a null run."""
    rnd = random.Random(3)
    rows = [(rnd.choice(["hot", "hot", "cold", None]), datetime.datetime(2024, 1, 1) + datetime.timedelta(seconds=rnd.randrange(400)),
             i, None if i % 17 == 0 else rnd.random()) for i in range(1500)]
    schema = "run_id string, ts timestamp, event_id long, value double"
    keep = 40
    parts = [live.latest_points(spark.createDataFrame(rows[i::4], schema), keep) for i in (2, 0, 3, 1)]
    merged = parts[0]
    for p in parts[1:]:
        merged = live.merge_latest(merged.unionByName(p), keep)
    got = {r.run_id: (r.n_points, [(p.ts, p.event_id, p.value) for p in r.points]) for r in merged.collect()}
    for run in ("hot", "cold", None):
        own = sorted((r[1:] for r in rows if r[0] == run), key=lambda x: (x[0], x[1]), reverse=True)
        assert got[run] == (len(own), own[:keep])


def test_points_that_count_cover_every_weight_above_zero():
    for w in (0.0, 0.1, 0.6, 0.8, 0.999):
        n = live.points_that_count(w)
        assert w ** n == 0.0 and (n == 1 or w ** int(n * 0.99) > 0.0)
    with pytest.raises(ValueError):
        live.points_that_count(1.0)


def test_a_repeated_epoch_replaces_its_first_attempt(spark, tmp_dir):
    """A run that died after it wrote an epoch, before the stream noted it: the epoch is repeated
    over the state before it."""
    src, state, once = (os.path.join(tmp_dir, x) for x in ("events", "state", "once"))
    _split_events(src, 4, "interleaved", None)
    want = _smoothed(live.run_stream_smooth(spark, SF001, 0.8, src, 1, state=once))
    live.run_stream_smooth(spark, SF001, 0.8, src, 1, state=state)
    assert sorted(x for x in os.listdir(f"{state}/out")) == ["epoch=2", "epoch=3"]       # older states are gone
    for f in ("commits/3", "commits/.3.crc"):
        if os.path.exists(f"{state}/checkpoint/{f}"):
            os.remove(f"{state}/checkpoint/{f}")
    _same_curves(_smoothed(live.run_stream_smooth(spark, SF001, 0.8, src, 1, state=state)), want)


def test_a_stream_resumes_from_its_state(spark, tmp_dir):
    src, state = os.path.join(tmp_dir, "events"), os.path.join(tmp_dir, "state")
    whole = os.path.join(tmp_dir, "whole")
    _split_events(whole, 2, "time", None)
    os.makedirs(src)
    want = {r.run_id: r.last_smoothed for r in live.run_stream_smooth(spark, SF001, 0.8, whole).collect()}
    for i in range(2):
        os.link(os.path.join(whole, f"part-{i}.parquet"), os.path.join(src, f"part-{i}.parquet"))
        got = live.run_stream_smooth(spark, SF001, 0.8, src, state=state).collect()
    assert {r.run_id: r.last_smoothed for r in got} == pytest.approx(want)
    assert sum(r.n_points for r in got) == 1000


def test_checkpoint_and_metric_sinks_round_trip(spark, tmp_dir):
    ml = fx.metric_log(spark, SF001)
    out = os.path.join(tmp_dir, "metrics")
    write_metrics(ml, out, every=10)
    back = read_metrics(spark, out, run_id="click")
    n = ml.where("run_id = 'click'").count()
    assert back.count() == -(-n // 10) and back.agg(F.sum("n")).first()[0] == n     # no value is lost
    ck = os.path.join(tmp_dir, "ckpt")
    write_checkpoint(spark.range(5), ck, "run1", 1000)
    write_checkpoint(spark.range(3), ck, "run1", 2000)
    got = spark.read.parquet(ck).groupBy("step").count().orderBy("step").collect()
    assert [(r.step, r["count"]) for r in got] == [(1000, 5), (2000, 3)]


def test_repeated_writes_leave_their_rows_once(spark, tmp_dir):
    ml = fx.metric_log(spark, SF001)
    out = os.path.join(tmp_dir, "metrics")
    write_metrics(ml, out)
    once = sorted(map(tuple, read_metrics(spark, out).collect()))
    write_metrics(ml.where("run_id = 'click'"), out)                  # one run again: the others stay
    assert sorted(map(tuple, read_metrics(spark, out).collect())) == once
    ck = os.path.join(tmp_dir, "ckpt")
    write_checkpoint(spark.range(5), ck, "run1", 1000)
    write_checkpoint(spark.range(4), ck, "run1", 1000)
    write_checkpoint(spark.range(2), ck, "run2", 1000)
    assert read_checkpoints(spark, ck, "run1").count() == 4 and read_checkpoints(spark, ck).count() == 6
    write_checkpoint(spark.range(0), ck, "run1", 1000)                # an empty table replaces rows, too
    assert read_checkpoints(spark, ck, "run1", 1000).count() == 0
    for bad in ("a/b", "", ".hidden"):
        with pytest.raises(ValueError):
            write_checkpoint(spark.range(1), ck, bad, 1)


def test_a_broken_checkpoint_write_is_not_read(spark, tmp_dir):
    ck = os.path.join(tmp_dir, "ckpt")
    write_checkpoint(spark.range(5), ck, "run1", 1000)
    write_checkpoint(spark.range(5), ck, "run1", 2000)
    fails = spark.range(10, numPartitions=2).withColumn("x", F.when(F.col("id") == 9, F.raise_error(F.lit("lost"))).otherwise(F.lit("")))
    with pytest.raises(Exception, match="lost"):
        write_checkpoint(fails, ck, "run1", 2000)
    assert checkpoint_names(spark, ck) == [("run1", 1000)]
    assert read_checkpoints(spark, ck).count() == 5
    with pytest.raises(FileNotFoundError):
        read_checkpoints(spark, ck, "run1", 2000)
    write_checkpoint(spark.range(3), ck, "run1", 2000)                # the retry
    assert read_checkpoints(spark, ck, "run1", 2000).count() == 3


def test_metric_sink_takes_every_row_once(spark, tmp_dir):
    """Files in any order, two runs from one state, and an epoch repeated after a lost commit."""
    src, state = os.path.join(tmp_dir, "log"), os.path.join(tmp_dir, "state")
    log = fx.metric_log(spark, SF001).select("run_id", "step", "tag", "value")
    want = sorted((r.run_id, r.bin, r.n, r.first_step, r.last_step, round(r.value, 9)) for r in TR.rollup_log(log, 10).collect())
    log.where("step % 2 = 0").repartition(3).write.parquet(src)
    live.run_metric_sink(spark, src, 10, state, 1)
    log.where("step % 2 = 1").repartition(2).write.mode("append").parquet(src)
    for attempt in range(2):
        got = live.run_metric_sink(spark, src, 10, state, 1)
        assert sorted((r.run_id, r.bin, r.n, r.first_step, r.last_step, round(r.value, 9)) for r in got.collect()) == want
        last = max(int(x) for x in os.listdir(f"{state}/checkpoint/commits") if x.isdigit())
        for f in (f"{last}", f".{last}.crc"):
            if os.path.exists(f"{state}/checkpoint/commits/{f}"):
                os.remove(f"{state}/checkpoint/commits/{f}")


def test_late_rows_add_up(spark, tmp_dir):
    t0 = datetime.datetime(2024, 1, 1)
    at = lambda h, k: (t0 + datetime.timedelta(hours=h), f"t{k % 2}", float(k), k)
    schema = "ts timestamp, event_type string, value double, event_id long"
    first = spark.createDataFrame([at(h, h) for h in range(0, 30)], schema)
    second = spark.createDataFrame([at(2, 0), at(3, 1), at(23, 3), at(25, 1), at(26, 2), at(29, 3)], schema)
    got = {r.event_type: r for r in live.run_stream_late_rows(spark, [first, second], state=os.path.join(tmp_dir, "run")).collect()}
    # the first delivery ends at 29 h: windows that end by 28 h are closed when the second comes
    assert (got["t0"].n_read, got["t0"].n_late, got["t0"].n_emitted, got["t0"].n_open) == (17, 1, 12, 4)
    assert (got["t1"].n_read, got["t1"].n_late, got["t1"].n_emitted, got["t1"].n_open) == (19, 2, 12, 5)


def test_broken_lines_are_quarantined(spark, tmp_dir):
    from duelframe.sources.tables import PAIR_SCHEMA, bad_records, load_pairs
    path = os.path.join(tmp_dir, "pairs")
    good = '{"pair_id": %d, "chosen": [{"role": "user", "content": "x"}], "rejected": []}'
    for split, n, bad in (("train", 6, ["{broken", "[1", '{"pair_id": "word", "chosen": 3}']), ("test", 2, [])):
        os.makedirs(f"{path}/split={split}")
        with open(f"{path}/split={split}/a.json", "w") as f:
            f.write("\n".join([good % i for i in range(n)] + bad + [""]))
    train = load_pairs(spark, path, "train", "json", PAIR_SCHEMA, quarantine=True)
    assert sorted(r.pair_id for r in train.collect()) == list(range(6))
    assert sorted(r.line for r in bad_records(spark, path).collect()) == sorted(["{broken", "[1", '{"pair_id": "word", "chosen": 3}'])
    assert "split=test" not in "".join(train.inputFiles()) or "PartitionFilters: [isnotnull(split" in train._jdf.queryExecution().toString()
    with pytest.raises(Exception):
        load_pairs(spark, path, "train", "json", PAIR_SCHEMA).collect()       # without a quarantine a bad line fails the job
    with pytest.raises(ValueError, match="quarantine"):
        load_pairs(spark, path, fmt="json", quarantine=True)


def test_driver_contract(spark):
    import __spark_entry__ as E
    df = E.entry(spark)
    rows = df.collect()
    assert rows and {"bucket", "n", "mean_loss", "mean_margin", "mean_acc"} <= set(df.columns)
    overall = [r for r in rows if r.bucket == "overall"][0]
    assert overall.n == 16
    qs, sql = E.queries(), E.oracle_sql()
    assert set(sql) <= set(qs)
    own = {k for k in set(qs) - set(sql) if k != "pipeline" and not re.match(r"op\d+_", k)}
    assert not own                                     # every core query has SQL


def test_load_pairs_split_filter_reaches_scan(spark, tmp_dir):
    from duelframe.sources.tables import load_pairs
    p = fx.pairs_raw(spark, SF001).withColumn("split", F.when(F.col("pair_id") % 2 == 0, "train").otherwise("test"))
    path = os.path.join(tmp_dir, "pairs")
    p.write.parquet(path)
    with pytest.raises(ValueError, match="split"):
        load_pairs(spark, f"{SF001}/documents.parquet", "train")
    df = load_pairs(spark, path, "train")
    assert df.count() == p.where("split = 'train'").count()
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(split), EqualTo(split,train)]" in plan


def test_external_scorer_hook(spark):
    import pandas as pd

    from duelframe.operators import scoring as SC
    from duelframe.operators import sides as S

    def predict(pdf: pd.DataFrame) -> pd.DataFrame:
        # a stand-in model: every answer token has log-prob -1
        n = pdf["answer_tokens"].map(len).astype("int64")
        return pd.DataFrame({"pair_id": pdf["pair_id"], "side": pdf["side"], "n_tokens": n,
                             "sum_logp": -n.astype("float64")})

    sd = S.sides(S.extract(fx.pairs_raw(spark, SF001)))
    ext = SC.external_sequence_logps(sd, predict, "ext")
    got = ext.join(sd.select("pair_id", "side", "answer_len"), ["pair_id", "side"]).collect()
    assert len(got) == 32 and all(r.sum_ext == -r.answer_len and r.n_tokens == r.answer_len for r in got)


def test_load_pairs_from_json_lines(spark, tmp_dir):
    """S1 on the reference's input shape: one JSON object per pair with message arrays."""
    from duelframe.operators import sides as S
    from duelframe.sources.tables import load_pairs
    p = fx.pairs_raw(spark, SF001)
    path = os.path.join(tmp_dir, "pairs_json")
    p.write.json(path)
    back = load_pairs(spark, path, fmt="json")
    assert back.count() == p.count()
    from duelframe.sources.tables import PAIR_SCHEMA
    typed = load_pairs(spark, path, fmt="json", schema=PAIR_SCHEMA)
    assert typed.where("split IS NULL").count() == p.count()
    a = {r.pair_id: (r.prompt_text, r.chosen_text, r.rejected_text) for r in S.extract(p).collect()}
    b = {r.pair_id: (r.prompt_text, r.chosen_text, r.rejected_text) for r in S.extract(back).collect()}
    assert a == b
