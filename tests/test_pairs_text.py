"""P1-P8, T1-T7 and G3 on hand-made rows covering the edge cases of the fixtures."""

from pyspark.sql import functions as F

from duelframe.config import ChatTemplate, PrefConfig
from duelframe.functions import chat as C
from duelframe.functions import text as T
from duelframe.operators import sides as S

PAIR_DDL = ("pair_id bigint, chosen array<struct<role:string,content:string>>, "
            "rejected array<struct<role:string,content:string>>")


def m(role, content):
    return {"role": role, "content": content}


def pairs(spark):
    rows = [
        (1, [m("user", "hi there"), m("assistant", "hello")], [m("user", "hi there"), m("assistant", "go away")]),
        (2, [m("system", "be kind"), m("user", "q"), m("assistant", "a1")],
         [m("system", "be kind"), m("user", "q"), m("assistant", "a2")]),
        (3, [m("user", "only a question")], [m("user", "only a question")]),          # no assistant turn
        (4, [m("user", "q"), m("assistant", None)], [m("user", "q"), m("assistant", "")]),  # null / empty answer
        (5, [m("user", "same"), m("assistant", "x")], [m("user", "same"), m("assistant", "x")]),  # chosen = rejected
        (6, [m("user", "a"), m("assistant", "b"), m("user", "c"), m("assistant", "d")],
         [m("user", "a"), m("assistant", "b"), m("user", "c"), m("assistant", "e")]),
    ]
    return spark.createDataFrame(rows, PAIR_DDL)


def test_last_assistant_and_missing_modes(spark):
    p = pairs(spark)
    empty = {r.pair_id: r for r in S.extract(p, "last_assistant", "empty").collect()}
    null = {r.pair_id: r for r in S.extract(p, "last_assistant", "null").collect()}
    assert empty[1].prompt_text == "hi there" and empty[1].chosen_text == "hello"
    assert empty[2].prompt_text == "be kind\nq" and empty[2].rejected_text == "a2"
    assert empty[3].chosen_text == "" and null[3].chosen_text is None        # B12
    assert len(empty[3].prompt_msgs_chosen) == 1 and empty[3].valid is False
    assert empty[6].prompt_text == "a\nb\nc" and empty[6].chosen_text == "d"
    assert all(r.prompt_same for r in empty.values())


def test_positional_validity(spark):
    out = {r.pair_id: r for r in S.extract(pairs(spark), "positional").collect()}
    assert out[1].valid is True and out[1].prompt_text == "hi there"
    assert out[2].valid is False and out[2].prompt_text == "be kind" and out[2].chosen_text == "q"   # B2
    assert out[6].valid is False and out[6].chosen_text == "b" and out[6].rejected_text == "b"


def test_common_prefix(spark):
    p = pairs(spark)
    k = {r.pair_id: r.k for r in p.select("pair_id", C.common_prefix_len("chosen", "rejected").alias("k")).collect()}
    assert k[1] == 1 and k[2] == 2 and k[6] == 3
    assert k[5] == 1          # identical chats: the last shared message is still an answer
    assert k[3] == 0


def test_validation_errors(spark):
    v = {r.pair_id: r.errors for r in S.validate_pairs(pairs(spark)).collect()}
    assert v[1] == []
    assert v[3] == ["chosen_no_assistant", "rejected_no_assistant"]
    assert "null_content" in v[4]
    assert v[5] == ["answers_identical"]


def test_render_and_user_chat(spark):
    df = spark.createDataFrame([("hello",)], "t string")
    r = df.select(C.render_chat(C.as_user_chat(F.col("t")), ChatTemplate()).alias("r")).first().r
    assert r == "<|im_start|>user\nhello<|im_end|>\n<|im_start|>assistant\n"
    sys_t = ChatTemplate(default_system="You are helpful.")
    r2 = df.select(C.render_chat(C.as_user_chat(F.col("t")), sys_t, False).alias("r")).first().r
    assert r2.startswith("<|im_start|>system\nYou are helpful.<|im_end|>\n") and not r2.endswith("assistant\n")


def test_tokens_and_truncation(spark):
    df = spark.createDataFrame([("  a b\n\tc  ", "x y z w v")], "p string, a string")
    out = df.select(T.tokens("p").alias("t"), T.truncate_prompt(T.tokens("p"), 2).alias("end"),
                    T.truncate_prompt(T.tokens("p"), 2, "start").alias("start"),
                    T.truncate_answer(T.tokens("a"), F.lit(3), 5).alias("ans"),
                    T.truncate_answer(T.tokens("a"), F.lit(3), 5, "end").alias("ans_end"),
                    T.truncate_answer(T.tokens("a"), F.lit(9), 5).alias("none")).first()
    assert out.t == ["a", "b", "c"] and out.end == ["b", "c"] and out.start == ["a", "b"]
    assert out.ans == ["x", "y"] and out.ans_end == ["w", "v"] and out.none == []


def test_sides_lengths_max_length_256(spark):
    long_prompt = " ".join(f"w{i}" for i in range(200))
    answer = " ".join(f"a{i}" for i in range(300))
    rows = [(1, [m("user", long_prompt), m("assistant", answer)], [m("user", long_prompt), m("assistant", "short")])]
    sd = S.sides(S.extract(spark.createDataFrame(rows, PAIR_DDL)), PrefConfig(max_length=256, max_prompt_length=128))
    r = {x.side: x for x in sd.collect()}
    assert r["chosen"].prompt_len_raw == 200 and r["chosen"].prompt_len == 128
    assert r["chosen"].prompt_tokens[0] == "w72" and r["chosen"].context0 == "w199"
    assert r["chosen"].answer_len == 128 and r["chosen"].truncated is True
    assert r["rejected"].answer_len == 1 and r["rejected"].truncated is False


def test_template_aware_and_whole_sides(spark):
    """With a template, prompt lengths and the first word's context include the markers; without
    caps nothing is cut."""
    e = S.extract(pairs(spark))
    plain = {(r.pair_id, r.side): r for r in S.sides(e).collect()}
    drawn = {(r.pair_id, r.side): r for r in S.sides(e, PrefConfig(), ChatTemplate()).collect()}
    one = drawn[(1, "chosen")]
    assert one.prompt_tokens == ["<|im_start|>user", "hi", "there<|im_end|>", "<|im_start|>assistant"]
    assert one.context0 == "<|im_start|>assistant" and plain[(1, "chosen")].context0 == "there"
    assert all(r.prompt_len == r.prompt_len_raw and r.answer_len == r.answer_len_raw for r in plain.values())
    assert S.extract(pairs(spark)).select(C.render_chat(C.as_user_chat("prompt_text")).alias("t")).first().t.startswith("<|im_start|>user")


def test_nonpad_and_preview(spark):
    df = spark.createDataFrame([(["a", "b", "<pad>", "<pad>"],), ([],), (["<pad>", "x"],)], "ids array<string>")
    assert [r.n for r in df.select(T.nonpad_len("ids", "<pad>").alias("n")).collect()] == [2, 0, 1]
    assert spark.createDataFrame([("héllo wörld",)], "t string").select(
        T.char_len("t").alias("n"), T.preview("t", 4).alias("p")).first() == (11, "héll")


def test_extract_answer_first_occurrence(spark):
    df = spark.createDataFrame([("Q? A Q? B", "Q?"), ("nothing here", "Q?"), ("x\n\n  body \n", "x"), ("abc", "")],
                               "text string, prompt string")
    ans, matched = T.answer_after_prompt(F.col("text"), F.col("prompt"))
    out = df.select(ans.alias("a"), matched.alias("m")).collect()
    assert out[0] == ("A Q? B", True)          # first occurrence, not the last
    assert out[1] == ("nothing here", False)
    assert out[2] == ("body", True)            # newlines stripped too
    assert out[3] == ("abc", False)


def test_special_markers_break_rendered_match(spark):
    df = spark.createDataFrame([([m("user", "hi")], "yo")], "p array<struct<role:string,content:string>>, a string")
    rendered = C.render_chat(F.col("p"))
    decoded = C.strip_special(F.concat(rendered, F.col("a")))
    _, matched = T.answer_after_prompt(decoded, rendered)
    assert df.select(matched.alias("m")).first().m is False        # B8
