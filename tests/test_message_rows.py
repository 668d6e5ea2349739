"""P2-P4 on message rows against the gathered chats, odd chats, and one giant conversation."""

import random

from pyspark.sql import functions as F

from conftest import SF001
from duelframe.operators import message_rows as MR
from duelframe.operators import sides as S
from duelframe.sources import fixtures as fx

TURNS = "conv_id long, turn long, role string, text string"


def _as_messages(pairs):
    """Message rows of gathered pairs."""
    return pairs.select("pair_id", F.explode(F.array(F.struct(F.lit("chosen").alias("side"), F.col("chosen").alias("m")),
                                                     F.struct(F.lit("rejected").alias("side"), F.col("rejected").alias("m")))).alias("x")).select(
        "pair_id", "x.side", F.posexplode("x.m").alias("pos", "m")).select("pair_id", "side", "pos", "m.role", "m.content")


def test_pairs_as_message_rows_equal_the_gathered_pairs(spark):
    for cross in (False, True):
        want = sorted(map(tuple, _as_messages(fx.pairs_raw(spark, SF001, cross=cross)).collect()))
        got = sorted(map(tuple, fx.pair_messages(spark, SF001, cross=cross).collect()))
        assert got == want


def _plain(c, r):
    """(n_prompt, prompt_chars, chosen_chars, rejected_chars, prompt_same, prefix) by loops over lists."""
    def split(m):
        at = max([i for i, x in enumerate(m) if x[0] == "assistant"], default=None)
        return (m, None) if at is None else (m[:at], m[at][1])
    (pc, ac), (pr, ar) = split(c), split(r)
    n = min(len(c), len(r))
    differs = [i for i in range(n) if c[i] != r[i]]
    k = differs[0] if differs else max(n - 1, 0)
    text = len("\n".join(x[1] or "" for x in pc))
    size = lambda a: None if a is None else len(a)
    return len(pc), text, size(ac), size(ar), pc == pr, k


def test_operators_on_odd_chats(spark):
    rnd = random.Random(4)
    chats = {}
    for i in range(300):
        c = [(rnd.choice(["user", "assistant", "system", None]), rnd.choice(["", "a", "bb", None, "é🙂"])) for _ in range(rnd.randint(1, 6))]
        r = c[:rnd.randint(0, len(c))] + [(rnd.choice(["user", "assistant"]), rnd.choice(["x", "yy"])) for _ in range(rnd.randint(0, 2))]
        chats[i] = (c, r or [("assistant", "z")])
    rows = [(i, s, p, *m) for i, both in chats.items() for s, msgs in zip(("chosen", "rejected"), both) for p, m in enumerate(msgs)]
    df = spark.createDataFrame(rows, "pair_id long, side string, pos long, role string, content string").repartition(5)
    got = {r.pair_id: r for r in MR.split_last_assistant(df).collect()}
    prefix = {r.pair_id: r for r in MR.common_prefix(df).collect()}
    assert set(got) == set(prefix) == set(chats)
    for i, (c, r) in chats.items():
        n, chars, ac, ar, same, k = _plain(c, r)
        g, p = got[i], prefix[i]
        assert (g.n_prompt_msgs, g.prompt_chars, g.chosen_chars, g.rejected_chars, g.prompt_same) == (n, chars, ac, ar, same), (c, r)
        rest = c[k:]
        assert (p.prefix_len, p.chosen_rest_msgs, p.rejected_rest_msgs) == (k, len(rest), len(r) - k), (c, r)
        assert p.chosen_rest_chars == len("\n".join(x[1] or "" for x in rest))
        assert p.agrees_with_last_assistant == (k == n)


def test_a_giant_conversation_is_spread_over_tasks(spark):
    """One conversation holds nearly all turns: no plan gathers it, its join is split, and its rows
    meet by position."""
    conf = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "64k",
            "spark.sql.adaptive.advisoryPartitionSizeInBytes": "64k", "spark.sql.shuffle.partitions": "16"}
    old = {k: spark.conf.get(k, None) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        n = 60_000
        giant = spark.range(n).select(F.lit(7).cast("long").alias("conv_id"), F.col("id").alias("turn"),
                                      F.when(F.col("id") % 2 == 0, "user").otherwise("assistant").alias("role"),
                                      F.concat(F.lit("text "), F.md5(F.col("id").cast("string"))).alias("text"))
        small = spark.range(400).select((F.col("id") / 4 + 64).cast("long").alias("conv_id"), (F.col("id") % 4).alias("turn"),
                                        F.when(F.col("id") % 2 == 0, "user").otherwise("assistant").alias("role"),
                                        F.concat(F.lit("t"), F.col("id").cast("string")).alias("text"))
        turns = giant.unionByName(small).repartition(16)
        rows = fx.messages_of(turns)
        df = MR.split_last_assistant(rows)
        got = {r.pair_id: r for r in df.collect()}
        assert len(got) == 101 and got[7].n_prompt_msgs == n - 1 and got[7].prompt_same
        assert got[7].prompt_chars == (n - 1) * 37 + n - 2 and got[7].chosen_chars == 37
        for one in (df, MR.common_prefix(rows)):
            one.collect()
            plan = one._jdf.queryExecution().executedPlan().toString()
            assert "collect_list" not in plan and "ObjectHashAggregate" not in plan
            assert "SortMergeJoin(skew=true)" in plan
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_long_form_agrees_with_the_array_form(spark):
    pairs = fx.pairs_cross(spark, SF001)
    e = S.extract(pairs, "last_assistant")
    want = {r.pair_id: (r.n, r.same) for r in e.select("pair_id", F.size("prompt_msgs_chosen").alias("n"), F.col("prompt_same").alias("same")).collect()}
    got = {r.pair_id: (r.n_prompt_msgs, r.prompt_same) for r in MR.split_last_assistant(fx.pair_messages(spark, SF001, cross=True)).collect()}
    assert got == want and len(set(s for _, s in want.values())) == 2
