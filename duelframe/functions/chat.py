"""Chat-message array functions (P1-P7): extraction, comparison and template rendering.

A chat is ARRAY<STRUCT<role STRING, content STRING>>.  Everything here is a Column
expression over one row; nothing leaves the JVM.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from duelframe.config import ChatTemplate

MESSAGE_DDL = "struct<role:string,content:string>"
CHAT_DDL = f"array<{MESSAGE_DDL}>"


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def message(role, content) -> Column:
    r = F.lit(role) if isinstance(role, str) else role
    return F.struct(r.alias("role"), _c(content).cast("string").alias("content"))


def as_user_chat(text) -> Column:
    """Wrap a bare prompt as a one-message user chat."""
    return F.array(message("user", _c(text)))


def last_index_of_role(msgs, role: str = "assistant") -> Column:
    """1-based index of the last message with ``role``; 0 when there is none."""
    m = _c(msgs)
    from_end = F.array_position(F.reverse(m.getField("role")), F.lit(role)).cast("int")
    return F.when(from_end > 0, F.size(m) - from_end + F.lit(1)).otherwise(F.lit(0))


def split_last_assistant(msgs, on_missing: str = "empty") -> tuple[Column, Column, Column]:
    """(prompt messages, answer text, found).

    Prompt is every message before the last assistant turn.  With no assistant turn the
    prompt is the whole chat and the answer is '' (on_missing='empty') or NULL ('null').
    """
    m = _c(msgs)
    idx = last_index_of_role(m)
    found = idx > 0
    prompt = F.when(found, F.slice(m, F.lit(1), idx - F.lit(1))).otherwise(m)
    missing = F.lit("") if on_missing == "empty" else F.lit(None).cast("string")
    if on_missing not in ("empty", "null"):
        raise ValueError("on_missing must be 'empty' or 'null'")
    answer = F.when(found, F.element_at(m, F.greatest(idx, F.lit(1))).getField("content")).otherwise(missing)
    return prompt, answer, found


def positional(chosen, rejected) -> tuple[Column, Column, Column, Column]:
    """prompt = chosen[0].content, answers = [1].content of each side, plus a validity flag.

    The flag is true only when both sides are (user, assistant, ...), the layout the
    positional reading assumes; a system message or a multi-turn chat makes it false.
    """
    c, r = _c(chosen), _c(rejected)
    prompt = F.get(c, 0).getField("content")
    ans_c = F.get(c, 1).getField("content")
    ans_r = F.get(r, 1).getField("content")
    valid = F.coalesce(
        (F.get(c, 0).getField("role") == "user") & (F.get(c, 1).getField("role") == "assistant")
        & (F.get(r, 0).getField("role") == "user") & (F.get(r, 1).getField("role") == "assistant")
        & (F.size(c) == 2) & (F.size(r) == 2),
        F.lit(False))
    return prompt, ans_c, ans_r, valid


def common_prefix_len(chosen, rejected) -> Column:
    """Number of leading messages taken as the shared prompt.

    The first index where the two chats differ; when they agree on the whole shorter
    length the last shared message is still treated as an answer (index = min_len - 1),
    which is how the library loop behaves when it never breaks.
    """
    c, r = _c(chosen), _c(rejected)
    min_len = F.least(F.size(c), F.size(r))
    diff = F.array_position(F.zip_with(c, r, lambda a, b: ~(a.eqNullSafe(b))), F.lit(True)).cast("int")
    k = F.when((diff > 0) & (diff <= min_len), diff - F.lit(1)).otherwise(min_len - F.lit(1))
    return F.greatest(k, F.lit(0))


def tail(msgs, k) -> Column:
    """Messages after the first k (empty when k >= size)."""
    m = _c(msgs)
    n = F.greatest(F.size(m) - k, F.lit(0))
    return F.when(n > 0, F.slice(m, k + F.lit(1), n)).otherwise(F.slice(m, F.lit(1), F.lit(0)))


def chat_text(msgs, sep: str = "\n") -> Column:
    """Plain prompt text: message contents joined (no template)."""
    return F.array_join(F.transform(_c(msgs), lambda x: F.coalesce(x.getField("content"), F.lit(""))), sep)


def render_chat(msgs, template: ChatTemplate = ChatTemplate(), add_generation_prompt: bool = True) -> Column:
    """P5: template rendering with an optional generation marker."""
    t = template
    m = _c(msgs)
    if t.default_system is not None:
        sys_msg = F.array(message("system", F.lit(t.default_system)))
        m = F.when(F.get(m, 0).getField("role") == "system", m).otherwise(F.concat(sys_msg, m))
    body = F.array_join(F.transform(m, lambda x: F.concat(
        F.lit(t.open), F.coalesce(x.getField("role"), F.lit("")), F.lit(t.role_sep),
        F.coalesce(x.getField("content"), F.lit("")), F.lit(t.close))), "")
    if add_generation_prompt:
        body = F.concat(body, F.lit(t.open + "assistant" + t.role_sep))
    return body


def strip_special(text, template: ChatTemplate = ChatTemplate()) -> Column:
    """Text with the template's special markers removed (what a decoder that skips them returns)."""
    out = _c(text)
    for s in template.special_tokens:
        out = F.replace(out, F.lit(s), F.lit(""))
    return out


def validation_errors(chosen, rejected) -> Column:
    """List of structural problems of a pair (empty list when the pair is usable)."""
    c, r = _c(chosen), _c(rejected)
    pc, ac, fc = split_last_assistant(c, "null")
    pr, ar, fr = split_last_assistant(r, "null")
    checks = [
        (c.isNull() | (F.size(c) == 0), "chosen_empty"),
        (r.isNull() | (F.size(r) == 0), "rejected_empty"),
        (~fc, "chosen_no_assistant"),
        (~fr, "rejected_no_assistant"),
        (fc & (F.size(pc) == 0), "prompt_missing"),
        (~pc.eqNullSafe(pr), "prompt_mismatch"),
        (F.exists(c, lambda x: x.getField("content").isNull()) | F.exists(r, lambda x: x.getField("content").isNull()),
         "null_content"),
        (ac.eqNullSafe(ar) & fc & fr, "answers_identical"),
    ]
    arr = F.array(*[F.when(F.coalesce(cond, F.lit(False)), F.lit(name)) for cond, name in checks])
    return F.filter(arr, lambda x: x.isNotNull())
