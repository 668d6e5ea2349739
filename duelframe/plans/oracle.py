"""DuckDB SQL restating every registered query that SQL can express.

Shared pieces are CTE fragments assembled per query.  Conventions: doubles rounded to
6 decimals, counts cast to BIGINT, no arrays or structs in outputs.
"""

from __future__ import annotations

import random

from duelframe.operators import external as X
from duelframe.plans import catalog as Q

NL = "chr(10)"
SAMPLE_WORDS = 1024           # generator outputs stated in the SQL of the seeded draw


def tok(x: str) -> str:
    return f"list_filter(regexp_split_to_array(coalesce({x}, ''), '\\s+'), lambda t: t <> '')"


def word_class(x: str) -> str:
    return f"substr(md5({x}), 1, 2)"


def r6(x: str) -> str:
    return f"(round(CAST({x} AS DOUBLE), 6) + 0.0)"


def logsig(x: str) -> str:
    return f"(least({x}, 0) - ln(1 + exp(-abs({x}))))"


# pairs from conversations (long form; turns are 0-based and contiguous).
F2 = f"""
conv_last AS (
  SELECT conv_id, max(CASE WHEN role = 'assistant' THEN turn END) AS last_turn
  FROM conversations GROUP BY conv_id
),
f2_base AS (
  SELECT c.conv_id AS pair_id, c.conv_id // 64 AS block, l.last_turn,
         coalesce(string_agg(CASE WHEN c.turn < l.last_turn THEN c.text END, {NL} ORDER BY c.turn), '') AS prompt_text,
         max(CASE WHEN c.turn = l.last_turn THEN c.text END) AS chosen_text,
         max(CASE WHEN c.turn = 0 THEN c.role END) AS role0,
         max(CASE WHEN c.turn = 0 THEN c.text END) AS text0,
         max(CASE WHEN c.turn = 1 THEN c.role END) AS role1,
         max(CASE WHEN c.turn = 1 THEN c.text END) AS text1,
         max(CASE WHEN c.turn = l.last_turn - 1 THEN c.text END) AS last_prompt_text,
         coalesce(string_agg(CASE WHEN c.turn < l.last_turn
                                  THEN '<|im_start|>' || c.role || {NL} || c.text || '<|im_end|>' || {NL} END,
                             '' ORDER BY c.turn), '') || '<|im_start|>assistant' || {NL} AS rendered
  FROM conversations c JOIN conv_last l ON c.conv_id = l.conv_id
  WHERE l.last_turn IS NOT NULL
  GROUP BY c.conv_id, l.last_turn
),
f2 AS (
  SELECT *, coalesce(lead(chosen_text) OVER w, first_value(chosen_text) OVER w) AS rejected_text
  FROM f2_base WINDOW w AS (PARTITION BY block ORDER BY pair_id)
),
f2i AS (SELECT *, row_number() OVER (ORDER BY pair_id) - 1 AS row_idx FROM f2)
"""

def f3(cfg=None, prompt: str = "f.prompt_text", prompt_rejected: str | None = None,
       chosen: str = "f.chosen_text", rejected: str = "f.rejected_text") -> str:
    """one row per side, whitespace tokens; ``cfg`` caps the prompt (its last tokens stay)
    and the sequence."""
    p_cap, cap = (cfg.max_prompt_length, cfg.max_length) if cfg else (None, None)
    p_len = f"least(len(p_raw), {p_cap})" if p_cap else "len(p_raw)"
    a_len = f"least(len(a_raw), greatest({cap} - {p_len}, 0))" if cap else "len(a_raw)"
    return f"""
f3_raw AS (
  SELECT f.pair_id, f.row_idx, s.side,
         {tok(f"CASE WHEN s.side = 'chosen' THEN {prompt} ELSE {prompt_rejected or prompt} END")} AS p_raw,
         {tok(f"CASE WHEN s.side = 'chosen' THEN {chosen} ELSE {rejected} END")} AS a_raw
  FROM f2i f CROSS JOIN (VALUES ('chosen'), ('rejected')) s(side)
),
f3 AS (
  SELECT pair_id, row_idx, side, len(p_raw) AS prompt_len_raw, {p_len} AS prompt_len,
         len(a_raw) AS answer_len_raw, {a_len} AS answer_len,
         CASE WHEN len(p_raw) > 0 THEN p_raw[len(p_raw)] END AS ctx0,
         p_raw[len(p_raw) - {p_len} + 1:len(p_raw)] AS p_tok, a_raw[1:{a_len}] AS a_tok
  FROM f3_raw
)
"""


F3 = f3()                   # whole texts
F3T = f3(Q.TRAINER)         # the training run's caps

# F2 read by position: message 0 is the prompt, message 1 the answer of each side.
F3P = f3(prompt="CASE WHEN f.last_turn = 0 THEN f.chosen_text ELSE f.text0 END",
         prompt_rejected="CASE WHEN f.last_turn = 0 THEN f.rejected_text ELSE f.text0 END",
         chosen="CASE WHEN f.last_turn = 0 THEN NULL WHEN f.last_turn = 1 THEN f.chosen_text ELSE f.text1 END",
         rejected="CASE WHEN f.last_turn = 0 THEN NULL WHEN f.last_turn = 1 THEN f.rejected_text ELSE f.text1 END")

# F2 as lists of messages; F9: the rejected side is the next conversation unless 3 divides the id.
F9 = """
m_last AS (SELECT conv_id, max(CASE WHEN role = 'assistant' THEN turn END) AS last_turn FROM conversations GROUP BY conv_id),
m_base AS (
  SELECT c.conv_id AS pair_id, c.conv_id // 64 AS block,
         coalesce(list(struct_pack(role := c.role, content := c.text) ORDER BY c.turn) FILTER (c.turn < l.last_turn), []) AS p,
         max(CASE WHEN c.turn = l.last_turn THEN c.text END) AS ans
  FROM conversations c JOIN m_last l ON c.conv_id = l.conv_id WHERE l.last_turn IS NOT NULL GROUP BY c.conv_id
),
m_next AS (
  SELECT *, coalesce(lead(ans) OVER w, first_value(ans) OVER w) AS other_ans, coalesce(lead(p) OVER w, first_value(p) OVER w) AS other_p
  FROM m_base WINDOW w AS (PARTITION BY block ORDER BY pair_id)
),
f2m AS (
  SELECT pair_id, p, list_append(p, struct_pack(role := 'assistant', content := ans)) AS c,
         list_append(p, struct_pack(role := 'assistant', content := other_ans)) AS r
  FROM m_next
),
f9 AS (
  SELECT pair_id, p, ans, other_ans, CASE WHEN pair_id % 3 = 0 THEN p ELSE other_p END AS rp,
         list_append(p, struct_pack(role := 'assistant', content := ans)) AS c,
         list_append(CASE WHEN pair_id % 3 = 0 THEN p ELSE other_p END, struct_pack(role := 'assistant', content := other_ans)) AS r
  FROM m_next
)
"""


def chat_text(x: str) -> str:
    return f"array_to_string(list_transform({x}, lambda m: coalesce(m.content, '')), {NL})"


def common_prefix_sql(src: str) -> str:
    """P3 on message lists ``c`` and ``r``; ``p`` is the chosen side's prompt."""
    return f"""
d AS (
  SELECT *, least(len(c), len(r)) AS n,
         coalesce(list_position(list_transform(range(1, least(len(c), len(r)) + 1), lambda i: c[i] IS DISTINCT FROM r[i]), true), 0) AS differs
  FROM {src}
),
k AS (SELECT *, CASE WHEN differs > 0 THEN differs - 1 ELSE greatest(n - 1, 0) END AS k FROM d)
SELECT pair_id, CAST(k AS BIGINT) AS prefix_len, CAST(len(c) - k AS BIGINT) AS chosen_rest_msgs,
       CAST(len(r) - k AS BIGINT) AS rejected_rest_msgs, CAST(length({chat_text('c[k + 1:]')}) AS BIGINT) AS chosen_rest_chars,
       k = len(p) AS agrees_with_last_assistant
FROM k"""


def last_assistant_sql(src: str) -> str:
    return f"""
SELECT pair_id, CAST(len(p) AS BIGINT) AS n_prompt_msgs, CAST(length({chat_text('p')}) AS BIGINT) AS prompt_chars,
       CAST(length(ans) AS BIGINT) AS chosen_chars, CAST(length(other_ans) AS BIGINT) AS rejected_chars,
       p IS NOT DISTINCT FROM rp AS prompt_same, md5({chat_text('p')}) AS prompt_md5
FROM {src}"""


# damaged pairs; P8 by its definition on message lists.
VALIDATE = f"""
WITH {F9},
f10 AS (
  SELECT pair_id,
         CASE pair_id % 9 WHEN 1 THEN [] WHEN 3 THEN list_transform(c[1:len(c) - 1], lambda m: struct_pack(role := 'user', content := m.content))
              WHEN 5 THEN c[len(c):] WHEN 7 THEN list_prepend(struct_pack(role := 'user', content := CAST(NULL AS VARCHAR)), c) ELSE c END AS c,
         CASE pair_id % 9 WHEN 2 THEN [] WHEN 4 THEN list_transform(r[1:len(r) - 1], lambda m: struct_pack(role := 'user', content := m.content))
              WHEN 5 THEN r[len(r):] WHEN 6 THEN list_prepend(struct_pack(role := 'user', content := 'another question'), r)
              WHEN 8 THEN c ELSE r END AS r
  FROM f2m
),
roles AS (
  SELECT *, coalesce(list_max(list_transform(range(1, len(c) + 1), lambda i: CASE WHEN c[i].role = 'assistant' THEN i ELSE 0 END)), 0) AS ic,
         coalesce(list_max(list_transform(range(1, len(r) + 1), lambda i: CASE WHEN r[i].role = 'assistant' THEN i ELSE 0 END)), 0) AS ir
  FROM f10
),
parts AS (
  SELECT *, CASE WHEN ic > 0 THEN c[1:ic - 1] ELSE c END AS pc, CASE WHEN ir > 0 THEN r[1:ir - 1] ELSE r END AS pr,
         CASE WHEN ic > 0 THEN c[ic].content END AS ac, CASE WHEN ir > 0 THEN r[ir].content END AS ar
  FROM roles
),
e AS (
  SELECT pair_id, list_filter([
    CASE WHEN len(c) = 0 THEN 'chosen_empty' END, CASE WHEN len(r) = 0 THEN 'rejected_empty' END,
    CASE WHEN ic = 0 THEN 'chosen_no_assistant' END, CASE WHEN ir = 0 THEN 'rejected_no_assistant' END,
    CASE WHEN ic > 0 AND len(pc) = 0 THEN 'prompt_missing' END, CASE WHEN pc IS DISTINCT FROM pr THEN 'prompt_mismatch' END,
    CASE WHEN len(list_filter(c, lambda m: m.content IS NULL)) + len(list_filter(r, lambda m: m.content IS NULL)) > 0 THEN 'null_content' END,
    CASE WHEN ic > 0 AND ir > 0 AND ac IS NOT DISTINCT FROM ar THEN 'answers_identical' END], lambda x: x IS NOT NULL) AS errors
  FROM parts
)
SELECT pair_id, CAST(len(errors) AS BIGINT) AS n_errors, array_to_string(errors, ',') AS errors FROM e
"""


def bigram(models=("ref", "policy")) -> str:
    flags = {"ref": "true", "policy": "coalesce(l.quality = 1, false)", "nontoxic": "coalesce(l.toxic = 0, false)"}
    flags |= {m: f"coalesce(l.quality = 1 AND d.doc_id % 4 < {k}, false)" for m, k in Q.CHECKPOINTS.items()}
    fl = ", ".join(f"{flags[m]} AS f_{m}" for m in models)
    fcols = ", ".join(f"f_{m}" for m in models)
    sums = ", ".join(f"sum(CASE WHEN f_{m} THEN 1 ELSE 0 END) AS c_{m}" for m in models)
    ctx = ", ".join(f"sum(c_{m}) AS c_{m}" for m in models)
    tot = ", ".join(f"sum(c_{m}) AS n_{m}" for m in models)
    lps = ",\n         ".join(
        f"ln((coalesce(b.c_{m}, 0) + 100.0 * (coalesce(u.c_{m}, 0) + 1) / (t.n_{m} + t.vocab + 1))"
        f" / (coalesce(x.c_{m}, 0) + 100.0)) AS lp_{m}" for m in models)
    seqs = ", ".join(f"sum(tl.lp_{m}) AS sum_{m}" for m in models)
    return f"""
doc_tok AS (
  SELECT {fl}, {tok('d.text')} AS t
  FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id
),
uni AS (SELECT w, {sums} FROM (SELECT {fcols}, unnest(t) AS w FROM doc_tok) GROUP BY w),
bi AS (
  SELECT prev, w, {sums}
  FROM (SELECT {fcols}, unnest(t[1:len(t) - 1]) AS prev, unnest(t[2:len(t)]) AS w FROM doc_tok WHERE len(t) >= 2)
  GROUP BY prev, w
),
ctx AS (SELECT prev, {ctx} FROM bi GROUP BY prev),
tot AS (SELECT {tot}, count(*) AS vocab FROM uni),
atok AS (
  SELECT pair_id, side, w, CASE WHEN pos = 1 THEN ctx0 ELSE a_tok[pos - 1] END AS prev
  FROM (SELECT pair_id, side, ctx0, a_tok, unnest(a_tok) AS w, unnest(generate_series(1, len(a_tok))) AS pos
        FROM f3 WHERE len(a_tok) > 0)
),
tlp AS (
  SELECT a.pair_id, a.side, a.w,
         {lps}
  FROM atok a
  LEFT JOIN bi b ON a.prev = b.prev AND a.w = b.w
  LEFT JOIN uni u ON a.w = u.w
  LEFT JOIN ctx x ON a.prev = x.prev
  CROSS JOIN tot t
),
seq AS (
  SELECT s.pair_id, s.side, count(tl.w) AS n_tokens, {seqs}
  FROM f3 s LEFT JOIN tlp tl ON s.pair_id = tl.pair_id AND s.side = tl.side
  GROUP BY s.pair_id, s.side
)
"""


PL = """
pl AS (
  SELECT pair_id,
         max(CASE WHEN side = 'chosen' THEN sum_policy END) AS pc,
         max(CASE WHEN side = 'rejected' THEN sum_policy END) AS pr,
         max(CASE WHEN side = 'chosen' THEN sum_ref END) AS rc,
         max(CASE WHEN side = 'rejected' THEN sum_ref END) AS rr,
         max(CASE WHEN side = 'chosen' THEN n_tokens END) AS n_chosen,
         max(CASE WHEN side = 'rejected' THEN n_tokens END) AS n_rejected
  FROM seq GROUP BY pair_id
)
"""


def metrics_cte(src: str, name: str = "m", beta: float = 0.1, eps: float = 0.0, ref_free: bool = False,
                extra: str = "") -> str:
    z = "((pc - pr) - (rc - rr))" if not ref_free else "(pc - pr)"
    rc = "0" if ref_free else "rc"
    rr = "0" if ref_free else "rr"
    loss = f"-{logsig(f'{beta} * z')} * {1 - eps}"
    if eps:
        loss += f" - {logsig(f'-{beta} * z')} * {eps}"
    return f"""
{name}_z AS (SELECT *, {z} AS z FROM {src}),
{name} AS (
  SELECT *, {loss} AS loss,
         {beta} * (pc - {rc}) AS reward_chosen, {beta} * (pr - {rr}) AS reward_rejected,
         {beta} * (pc - {rc}) - {beta} * (pr - {rr}) AS reward_margin,
         CASE WHEN isnan({beta} * (pc - {rc})) OR isnan({beta} * (pr - {rr})) THEN false
              ELSE {beta} * (pc - {rc}) > {beta} * (pr - {rr}) END AS correct{extra}
  FROM {name}_z
)
"""


F4 = """
f4 AS (
  SELECT -l_quantity AS pc, -l_quantity * (1 + l_discount) AS pr,
         -l_quantity * (1 + l_tax) AS rc, -l_quantity * (1 + l_tax / 2) AS rr
  FROM lineitem
)
"""


def summary_select(src: str) -> str:
    return f"""
SELECT CAST(count(*) AS BIGINT) AS n, {r6('avg(loss)')} AS loss, {r6('avg(reward_chosen)')} AS reward_chosen,
       {r6('avg(reward_rejected)')} AS reward_rejected, {r6('avg(reward_margin)')} AS reward_margin,
       {r6('avg(CASE WHEN correct THEN 1.0 ELSE 0.0 END)')} AS accuracy,
       {r6('avg(pc)')} AS logps_chosen, {r6('avg(pr)')} AS logps_rejected
FROM {src}"""


def shuffled(seed: int, src: str = "f2i", key: str = "pair_id") -> str:
    return f"row_number() OVER (ORDER BY md5('{seed}:' || CAST({key} AS VARCHAR)), {key}) - 1"


def scored_batches(size: int, n_batches: int | None = None) -> str:
    lim = f"WHERE sidx < {size * n_batches}" if n_batches is not None else ""
    return f"""
WITH {F2}, {F3T}, {bigram()}, {PL},
{metrics_cte('pl')},
sh AS (SELECT pair_id, {shuffled(Q.SHUFFLE_SEED)} AS sidx FROM f2i),
mb AS (SELECT m.*, sh.sidx // {size} AS batch_id FROM m JOIN sh ON m.pair_id = sh.pair_id {lim}),
bm AS (SELECT batch_id, count(*) AS n, avg(loss) AS loss, avg(reward_margin) AS reward_margin,
              avg(CASE WHEN correct THEN 1.0 ELSE 0.0 END) AS accuracy,
              avg(reward_chosen) AS reward_chosen, avg(reward_rejected) AS reward_rejected,
              avg(pc) AS logps_chosen, avg(pr) AS logps_rejected
       FROM mb GROUP BY batch_id)
"""


def bucket_sql(by: str, underflow: bool = False) -> str:
    key = {
        "prompt": "max(CASE WHEN side = 'chosen' THEN prompt_len END)",
        "chosen": "max(CASE WHEN side = 'chosen' THEN answer_len END)",
        "rejected": "max(CASE WHEN side = 'rejected' THEN answer_len END)",
        "pair_total": "coalesce(max(CASE WHEN side = 'chosen' THEN answer_len END), 0)"
                      " + coalesce(max(CASE WHEN side = 'rejected' THEN answer_len END), 0)",
    }[by]
    edges = [int(x) for x in (Q.UNDERFLOW_EDGES if underflow else Q.CFG.bucket_edges).split(",")]
    cases = " ".join(f"WHEN k >= {edges[i]} AND k < {edges[i + 1]} THEN {i}" for i in range(len(edges) - 1))
    labels = " ".join(f"WHEN {i} THEN '[{edges[i]},{edges[i + 1]})'" for i in range(len(edges) - 1))
    if underflow:
        cases += f" WHEN k < {edges[0]} THEN -1"
        labels += f" WHEN -1 THEN '(-inf,{edges[0]})'"
    return f"""
WITH {F2}, {F3T}, {bigram()}, {PL},
{metrics_cte('pl')},
lk AS (SELECT pair_id, {key} AS k FROM f3 GROUP BY pair_id),
b AS (SELECT m.*, CASE {cases} ELSE {len(edges) - 2} END AS bid FROM m JOIN lk ON m.pair_id = lk.pair_id)
SELECT CASE WHEN grouping(bid) = 1 THEN 'overall' ELSE CASE bid {labels} END END AS bucket,
       CAST(CASE WHEN grouping(bid) = 1 THEN NULL ELSE bid END AS BIGINT) AS bucket_id,
       CAST(count(*) AS BIGINT) AS n, CAST(count(loss) AS BIGINT) AS n_scored, {r6('avg(loss)')} AS mean_loss,
       {r6('avg(reward_margin)')} AS mean_margin,
       {r6('avg(CASE WHEN correct THEN 1.0 ELSE 0.0 END)')} AS mean_acc
FROM b GROUP BY GROUPING SETS ((bid), ())
"""


EMB = """
emb AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v, label FROM embeddings),
fp AS (
  SELECT c.vec_id // 2 AS pair_id, c.v AS phi_chosen, r.v AS phi_rejected
  FROM emb c JOIN emb r ON r.vec_id = c.vec_id + 1 WHERE c.vec_id % 2 = 0
)
"""

F8 = """
f8 AS (
  SELECT event_type AS run_id, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS step,
         ts, 'train/value' AS tag, value
  FROM events
),
roll AS (
  SELECT run_id, tag, (step - 1) // 10 AS bin, avg(value) AS value, count(*) AS n, min(step) AS first_step,
         max(step) AS last_step
  FROM f8 GROUP BY run_id, tag, (step - 1) // 10
)
"""


def smooth_sql(w: float) -> str:
    return f"""
WITH {F8},
rk AS (SELECT *, bin + 1 AS k FROM roll)
SELECT a.run_id, a.tag, a.bin,
       {r6(f'sum((1 - {w}) * pow({w}, a.k - b.k) * b.value) / (1 - pow({w}, a.k))')} AS smoothed
FROM rk a JOIN rk b ON a.run_id = b.run_id AND a.tag = b.tag AND b.k <= a.k
GROUP BY a.run_id, a.tag, a.bin, a.k
"""


def greedy_sql(models=("ref",), steps: int = 8) -> str:
    m = models[0]
    return f"""
WITH RECURSIVE {bigram(models)},
nxt AS MATERIALIZED (
  SELECT prev, w AS next_word
  FROM (SELECT prev, w, row_number() OVER (PARTITION BY prev ORDER BY c_{m} DESC, w) AS rn FROM bi WHERE c_{m} > 0)
  WHERE rn = 1
),
seeds AS (
  SELECT conv_id, {tok('text')} AS t FROM conversations WHERE turn = 0
),
walk(conv_id, step, word) AS (
  SELECT conv_id, 0, t[len(t)] FROM seeds WHERE len(t) > 0
  UNION ALL
  SELECT w.conv_id, w.step + 1, n.next_word FROM walk w JOIN nxt n ON w.word = n.prev WHERE w.step < {steps}
)
"""


def oracle_sql() -> dict[str, str]:
    q: dict[str, str] = {}
    w = Q.SMOOTH_WEIGHT

    q["pairs_last_assistant"] = f"WITH {F9}, f2p AS (SELECT * REPLACE (p AS rp) FROM f9) {last_assistant_sql('f2p')}"
    q["pairs_last_assistant_cross"] = f"WITH {F9} {last_assistant_sql('f9')}"
    q["validate_pairs"] = VALIDATE

    q["pairs_positional"] = f"""
WITH {F2},
pp AS (
  SELECT pair_id, last_turn, role0, text0,
         CASE WHEN last_turn = 0 THEN NULL WHEN last_turn = 1 THEN chosen_text ELSE text1 END AS c1,
         CASE WHEN last_turn = 0 THEN NULL WHEN last_turn = 1 THEN rejected_text ELSE text1 END AS r1,
         CASE WHEN last_turn = 0 THEN 'assistant' ELSE role0 END AS role0_eff,
         CASE WHEN last_turn = 0 THEN chosen_text ELSE text0 END AS c0,
         chosen_text = rejected_text AS same_answer
  FROM f2
)
SELECT pair_id, CAST(length(c0) AS BIGINT) AS prompt_chars, CAST(length(c1) AS BIGINT) AS chosen_chars,
       CAST(length(r1) AS BIGINT) AS rejected_chars,
       (role0_eff = 'user' AND last_turn = 1) AS valid,
       CAST((CASE WHEN last_turn = 0 THEN 1 ELSE 0 END) + (CASE WHEN same_answer THEN 1 ELSE 0 END) AS BIGINT) AS n_errors,
       concat_ws(',', CASE WHEN last_turn = 0 THEN 'prompt_missing' END,
                      CASE WHEN same_answer THEN 'answers_identical' END) AS errors
FROM pp"""

    q["pairs_common_prefix"] = f"WITH {F9}, {common_prefix_sql('f2m')}"
    q["pairs_common_prefix_cross"] = f"WITH {F9}, {common_prefix_sql('f9')}"

    q["pairs_common_prefix_long"] = q["pairs_common_prefix_cross"]
    q["pairs_last_assistant_long"] = f"""
WITH {F9}
SELECT pair_id, CAST(len(p) AS BIGINT) AS n_prompt_msgs, CAST(length({chat_text('p')}) AS BIGINT) AS prompt_chars,
       CAST(length(ans) AS BIGINT) AS chosen_chars, CAST(length(other_ans) AS BIGINT) AS rejected_chars,
       p IS NOT DISTINCT FROM rp AS prompt_same,
       CAST(coalesce(list_sum(list_transform(range(0, len(p)), lambda i: CAST('0x' || substr(md5(
         i || ':' || coalesce(p[i + 1].role, '') || ':' || coalesce(p[i + 1].content, '')), 1, 8) AS BIGINT))), 0) AS BIGINT) AS prompt_digest
FROM f9"""

    q["render_prompt"] = f"""
WITH {F2}
SELECT pair_id, CAST(last_turn AS BIGINT) AS n_msgs, CAST(length(rendered) AS BIGINT) AS rendered_chars,
       md5(rendered) AS rendered_md5, CAST(length(rendered || chosen_text) AS BIGINT) AS full_chosen_chars,
       CAST(length(rendered || rejected_text) AS BIGINT) AS full_rejected_chars
FROM f2"""

    ids = ", ".join(f"({i}, {i % Q.SELECT_K})" for i in range(Q.SELECT_K + 1))
    q["select_index"] = f"""
WITH {F2}, n AS (SELECT count(*) AS n FROM f2), ids(sel_pos, i) AS (VALUES {ids}),
place AS (SELECT sel_pos, ({Q.SELECT_STRIDE} * i + {Q.SELECT_OFFSET}) % n AS row_idx FROM ids, n)
SELECT CAST(place.sel_pos AS BIGINT) AS sel_pos, CAST(f2i.row_idx AS BIGINT) AS row_idx, f2i.pair_id,
       CAST(last_turn + 1 AS BIGINT) AS n_msgs
FROM place JOIN f2i ON place.row_idx = f2i.row_idx"""

    q["head_slice"] = f"""
WITH {F2}
SELECT CAST(row_idx AS BIGINT) AS row_idx, pair_id, CAST(last_turn + 1 AS BIGINT) AS n_msgs
FROM f2i WHERE row_idx < {Q.HEAD_N}"""

    q["shuffle_take"] = f"""
WITH {F2}, sh AS (SELECT pair_id, last_turn, {shuffled(Q.SHUFFLE_SEED)} AS row_idx FROM f2i)
SELECT CAST(row_idx AS BIGINT) AS row_idx, pair_id, CAST(last_turn + 1 AS BIGINT) AS n_msgs
FROM sh WHERE row_idx < {Q.SHUFFLE_TAKE}"""

    # the generator's 32-bit words of this seed, and how a draw without replacement reads them: a
    # position below m takes the highest bits of the next word that spell a number below m.  Few rows:
    # from a pool whose last entry fills the gap; many: again if drawn before.
    words = random.Random(Q.SAMPLE_SEED)
    words = ", ".join(str(words.getrandbits(32)) for _ in range(SAMPLE_WORDS))
    q["sample_python_metrics"] = f"""
WITH RECURSIVE {F2}, {F3}, {bigram()}, {PL},
sz AS (SELECT n, k, n <= 21 + CASE WHEN k > 5 THEN CAST(pow(4, ceil(log2(k * 3) / 2)) AS BIGINT) ELSE 0 END AS pooled
       FROM (SELECT count(*) AS n, least(count(*), {Q.SAMPLE_K}) AS k FROM f2i)),
wd AS (SELECT CAST([{words}] AS BIGINT[]) AS word),
dr(i, used, got, pool) AS (
  SELECT 0, 0, CAST([] AS BIGINT[]), CASE WHEN pooled THEN range(n) ELSE CAST([] AS BIGINT[]) END FROM sz
  UNION ALL
  SELECT CASE WHEN ok THEN i + 1 ELSE i END, used + 1, CASE WHEN ok THEN list_append(got, CASE WHEN pooled THEN pool[j + 1] ELSE j END) ELSE got END,
         CASE WHEN ok AND pooled THEN pool[:j] || [pool[m]] || pool[j + 2:] ELSE pool END
  FROM (SELECT *, j < m AND (pooled OR NOT list_contains(got, j)) AS ok
        FROM (SELECT *, word[used + 1] >> CAST(32 - length(bin(m)) AS INTEGER) AS j
              FROM (SELECT dr.*, sz.pooled, sz.k, wd.word, CASE WHEN pooled THEN n - i ELSE n END AS m FROM dr, sz, wd
                    WHERE i < k AND used < {SAMPLE_WORDS})))
),
drawn AS (SELECT unnest(got) AS row_idx, unnest(generate_series(0, len(got) - 1)) AS sample_pos FROM (SELECT got FROM dr ORDER BY used DESC LIMIT 1)),
{metrics_cte('pl')}
SELECT m.pair_id, CAST(sample_pos AS BIGINT) AS sample_pos, {r6('z')} AS z, {r6('loss')} AS loss, {r6('reward_chosen')} AS reward_chosen,
       {r6('reward_rejected')} AS reward_rejected, {r6('reward_margin')} AS reward_margin, correct
FROM drawn JOIN f2i USING (row_idx) JOIN m ON m.pair_id = f2i.pair_id"""

    q["sample_hash"] = f"""
WITH ch AS (SELECT conv_id, count(*) AS n_msgs FROM conversations GROUP BY conv_id)
SELECT conv_id, CAST({shuffled(Q.SAMPLE_SEED, key='conv_id')} AS BIGINT) AS sample_pos,
       CAST(n_msgs AS BIGINT) AS n_msgs
FROM ch ORDER BY sample_pos LIMIT {Q.SAMPLE_K}"""

    q["row_index_batches"] = f"""
WITH ch AS (SELECT DISTINCT conv_id FROM conversations),
ix AS (SELECT conv_id, {shuffled(Q.SHUFFLE_SEED, key='conv_id')} AS row_idx FROM ch)
SELECT conv_id, CAST(row_idx AS BIGINT) AS row_idx, CAST(row_idx // {Q.AUDIT_BATCH} AS BIGINT) AS batch_id FROM ix"""

    def truncation(cfg, **text):
        return f"""
WITH {F2}, {f3(cfg, **text)}
SELECT pair_id, side, CAST(prompt_len_raw AS BIGINT) AS prompt_len_raw, CAST(prompt_len AS BIGINT) AS prompt_len,
       CAST(answer_len_raw AS BIGINT) AS answer_len_raw, CAST(answer_len AS BIGINT) AS answer_len,
       CAST(prompt_len_raw + answer_len_raw AS BIGINT) AS full_len_raw,
       CAST(prompt_len + answer_len AS BIGINT) AS full_len,
       prompt_len_raw > {cfg.max_prompt_length} AS over_prompt_limit,
       prompt_len_raw + answer_len_raw > {cfg.max_length} AS over_max_length,
       prompt_len + answer_len_raw > {cfg.max_length} AS over_after_prompt_cut, answer_len < answer_len_raw AS truncated
FROM f3"""

    q["truncation_report"] = truncation(Q.TRAINER)
    q["truncation_report_tight"] = truncation(Q.TIGHT)
    q["truncation_report_rendered"] = truncation(Q.TRAINER, prompt="f.rendered")

    q["nonpad_length"] = f"""
WITH {F2}, {F3T}
SELECT pair_id, side, CAST(row_idx // {Q.AUDIT_BATCH} AS BIGINT) AS batch_id,
       CAST(max(answer_len) OVER (PARTITION BY row_idx // {Q.AUDIT_BATCH}, side) AS BIGINT) AS padded_len,
       CAST(len(list_filter(a_tok, lambda x: x <> '{Q.EOS_TOKEN}')) AS BIGINT) AS nonpad_len,
       CAST(len(list_filter(p_tok, lambda x: x <> '{Q.EOS_TOKEN}')) AS BIGINT) AS prompt_nonpad_len
FROM f3"""

    # the longest answer and the end token, which is the pad token too
    q["nonpad_length_padded"] = f"""
WITH {F2}, {F3T}
SELECT pair_id, side, CAST(row_idx // {Q.AUDIT_BATCH} AS BIGINT) AS batch_id,
       CAST(max(answer_len) OVER (PARTITION BY row_idx // {Q.AUDIT_BATCH}, side) + 1 AS BIGINT) AS stored_len,
       CAST(len(list_filter(a_tok, lambda x: x <> '{Q.EOS_TOKEN}')) AS BIGINT) AS nonpad_len
FROM f3"""

    q["length_buckets_underflow"] = bucket_sql("prompt", True)
    for by in ("prompt", "chosen", "rejected", "pair_total"):
        q[f"length_buckets_{by}"] = bucket_sql(by)

    q["log_softmax_gather"] = f"""
WITH {EMB},
s AS (SELECT vec_id, label, v, list_max(v) AS mx FROM emb)
SELECT vec_id, CAST(label AS BIGINT) AS target,
       {r6('v[label + 1] - (mx + ln(list_sum(list_transform(v, lambda x: exp(x - mx)))))')} AS logp
FROM s"""

    q["mean_logits"] = f"""
WITH {EMB}
SELECT CAST(count(*) AS BIGINT) AS n, {r6('avg(list_avg(phi_chosen))')} AS logits_chosen,
       {r6('avg(list_avg(phi_rejected))')} AS logits_rejected
FROM fp"""

    q["bigram_fit"] = f"""
WITH {F2}, {F3}, {bigram()}
SELECT 'ref' AS model_id, prev, w, CAST(c_ref AS BIGINT) AS c FROM bi WHERE c_ref > 0
UNION ALL
SELECT 'policy' AS model_id, prev, w, CAST(c_policy AS BIGINT) AS c FROM bi WHERE c_policy > 0"""

    q["sequence_logps"] = f"""
WITH {F2}, {F3}, {bigram()}
SELECT pair_id, side, 'ref' AS model_id, CAST(n_tokens AS BIGINT) AS n_tokens, {r6('sum_ref')} AS sum_logp,
       {r6('CASE WHEN n_tokens > 0 THEN sum_ref / n_tokens END')} AS mean_logp FROM seq
UNION ALL
SELECT pair_id, side, 'policy' AS model_id, CAST(n_tokens AS BIGINT) AS n_tokens, {r6('sum_policy')} AS sum_logp,
       {r6('CASE WHEN n_tokens > 0 THEN sum_policy / n_tokens END')} AS mean_logp FROM seq"""

    q["sequence_logps_masked"] = f"""
WITH {F2}, {F3}, {bigram(("ref",))}
SELECT s.pair_id, s.side, CAST(count(t.w) AS BIGINT) AS n_tokens, {r6('sum(t.lp_ref)')} AS sum_logp
FROM f3 s LEFT JOIN tlp t ON s.pair_id = t.pair_id AND s.side = t.side AND t.w <> '{Q.MASK_TOKEN}' GROUP BY s.pair_id, s.side"""

    q["render_user_prompt"] = f"""
SELECT conv_id, CAST(length(r) AS BIGINT) AS rendered_chars, md5(r) AS rendered_md5
FROM (SELECT conv_id, '<|im_start|>user' || {NL} || text || '<|im_end|>' || {NL} || '<|im_start|>assistant' || {NL} AS r
      FROM conversations WHERE turn = 0)"""

    q["external_scores"] = f"""
WITH {F2}, {F3},
doc_tok AS (SELECT {tok('text')} AS t FROM documents),
cls AS (
  SELECT {word_class('prev')} AS v, {word_class('w')} AS w, count(*) AS c
  FROM (SELECT unnest(t[1:len(t) - 1]) AS prev, unnest(t[2:len(t)]) AS w FROM doc_tok WHERE len(t) >= 2) GROUP BY ALL
),
ctx AS (SELECT v, sum(c) AS n FROM cls GROUP BY v),
atok AS (
  SELECT pair_id, side, {word_class('w')} AS w, {word_class("coalesce(CASE WHEN pos = 1 THEN ctx0 ELSE a_tok[pos - 1] END, '')")} AS v
  FROM (SELECT pair_id, side, ctx0, a_tok, unnest(a_tok) AS w, unnest(generate_series(1, len(a_tok))) AS pos FROM f3 WHERE len(a_tok) > 0)
),
scored AS (
  SELECT a.pair_id, a.side, ln((coalesce(c.c, 0) + 1) / (coalesce(x.n, 0) + {X.CLASSES}.0)) AS lp
  FROM atok a LEFT JOIN cls c ON c.v = a.v AND c.w = a.w LEFT JOIN ctx x ON x.v = a.v
)
SELECT s.pair_id, s.side, CAST(count(lp) AS BIGINT) AS n_tokens, {r6('sum(lp)')} AS sum_logp, {r6('sum(lp) / count(lp)')} AS mean_logp
FROM f3 s LEFT JOIN scored t ON t.pair_id = s.pair_id AND t.side = s.side GROUP BY s.pair_id, s.side"""

    for name, rows in (("pair_logps", F3), ("pair_logps_positional", F3P), ("pair_logps_rendered", f3(prompt="f.rendered"))):
        q[name] = f"""
WITH {F2}, {rows}, {bigram()}, {PL}
SELECT pair_id, {r6('pc')} AS pc, {r6('pr')} AS pr, {r6('rc')} AS rc, {r6('rr')} AS rr,
       CAST(n_chosen AS BIGINT) AS n_chosen, CAST(n_rejected AS BIGINT) AS n_rejected
FROM pl"""

    q["self_reference"] = f"""
WITH {F2}, {F3}, {bigram()}, {PL},
pl2 AS (SELECT pair_id, pc, pr, pc AS rc, pr AS rr FROM pl),
{metrics_cte('pl2')}
SELECT CAST(count(*) AS BIGINT) AS n, CAST(count(loss) AS BIGINT) AS n_scored, {r6('avg(loss)')} AS loss,
       {r6('avg(reward_margin)')} AS reward_margin,
       {r6('avg(CASE WHEN correct THEN 1.0 ELSE 0.0 END)')} AS accuracy
FROM m"""

    q["dpo_metrics"] = f"""
WITH {F4}, {metrics_cte('f4')}
SELECT {r6('z')} AS z, {r6('loss')} AS loss, {r6('reward_chosen')} AS reward_chosen,
       {r6('reward_rejected')} AS reward_rejected, {r6('reward_margin')} AS reward_margin, correct
FROM m"""
    q["dpo_summary"] = f"WITH {F4}, {metrics_cte('f4')} {summary_select('m')}"
    q["dpo_smoothed"] = f"WITH {F4}, {metrics_cte('f4', eps=0.1)} {summary_select('m')}"
    q["dpo_reference_free"] = f"WITH {F4}, {metrics_cte('f4', ref_free=True)} {summary_select('m')}"

    q["delta_margin"] = f"""
WITH {F2}, {F3}, {bigram()}, {PL}
SELECT pair_id, {r6('pc - rc')} AS delta_chosen, {r6('pr - rr')} AS delta_rejected,
       {r6('(pc - rc) - (pr - rr)')} AS delta_margin
FROM pl"""

    mlm = "CASE WHEN n_chosen > 0 THEN {a} / n_chosen END - CASE WHEN n_rejected > 0 THEN {b} / n_rejected END"
    q["mean_logp_margin"] = f"""
WITH {F2}, {F3}, {bigram()}, {PL}
SELECT pair_id, {r6(mlm.format(a='pc', b='pr'))} AS policy_mean_logp_margin,
       {r6(mlm.format(a='rc', b='rr'))} AS ref_mean_logp_margin
FROM pl"""

    q["length_bias"] = f"""
WITH {F2}, {F3}, {bigram()}, {PL},
lb AS (
  SELECT *, CASE WHEN n_chosen > 0 THEN pc / n_chosen END AS mc_policy,
            CASE WHEN n_rejected > 0 THEN pr / n_rejected END AS mr_policy,
            CASE WHEN n_chosen > 0 THEN rc / n_chosen END AS mc_ref,
            CASE WHEN n_rejected > 0 THEN rr / n_rejected END AS mr_ref
  FROM pl
)
SELECT pair_id, CAST(n_chosen AS BIGINT) AS n_chosen, CAST(n_rejected AS BIGINT) AS n_rejected,
       {r6('pc')} AS pc, {r6('pr')} AS pr, {r6('rc')} AS rc, {r6('rr')} AS rr,
       {r6('mc_policy')} AS mc_policy, {r6('mr_policy')} AS mr_policy, {r6('mc_ref')} AS mc_ref,
       {r6('mr_ref')} AS mr_ref, {r6('pc - rc')} AS delta_chosen, {r6('pr - rr')} AS delta_rejected,
       {r6('(pc - rc) - (pr - rr)')} AS delta_margin,
       {r6('mc_policy - mr_policy')} AS mean_logp_margin_policy, {r6('mc_ref - mr_ref')} AS mean_logp_margin_ref,
       (pc > pr) <> (mc_policy > mr_policy) AS sum_mean_disagree
FROM lb"""

    q["batch_metrics"] = scored_batches(Q.AUDIT_BATCH, Q.AUDIT_N_BATCHES) + f"""
SELECT CAST(batch_id AS BIGINT) AS batch_id, CAST(n AS BIGINT) AS n, {r6('loss')} AS loss,
       {r6('reward_margin')} AS reward_margin, {r6('accuracy')} AS accuracy
FROM bm WHERE batch_id < {Q.AUDIT_N_BATCHES}"""

    q["batch_mean_summary"] = scored_batches(Q.MEAN_BATCH) + f"""
SELECT CAST(count(*) AS BIGINT) AS n_batches, CAST(sum(n) AS BIGINT) AS n, {r6('avg(loss)')} AS mean_loss,
       {r6('avg(reward_margin)')} AS mean_reward_margin, {r6('avg(accuracy)')} AS mean_reward_acc
FROM bm"""

    q["batch_sign_rate"] = scored_batches(Q.AUDIT_BATCH) + f"""
SELECT CAST(count(*) AS BIGINT) AS n_batches, {r6('avg(reward_margin)')} AS mean_margin,
       {r6('avg(CASE WHEN reward_margin > 0 THEN 1.0 ELSE 0.0 END)')} AS frac_batches_margin_pos,
       {r6('avg(accuracy)')} AS mean_acc
FROM bm"""

    def compared(pols):
        models = tuple(dict.fromkeys(["ref", *pols]))
        picks = ",\n         ".join(
            f"max(CASE WHEN side = '{s}' THEN sum_{m} END) AS {m}__{s}" for m in models for s in ("chosen", "rejected"))
        unions = "\n  UNION ALL\n  ".join(
            f"SELECT pair_id, '{p}' AS policy_id, {p}__chosen AS pc, {p}__rejected AS pr, ref__chosen AS rc, "
            f"ref__rejected AS rr, n_chosen, n_rejected FROM pp" for p in pols)
        return f"""
WITH {F2}, {F3}, {bigram(models)},
pp AS (
  SELECT pair_id, {picks},
         max(CASE WHEN side = 'chosen' THEN n_tokens END) AS n_chosen,
         max(CASE WHEN side = 'rejected' THEN n_tokens END) AS n_rejected
  FROM seq GROUP BY pair_id
),
lp AS (
  {unions}
),
{metrics_cte('lp', extra=', ' + mlm.format(a='pc', b='pr') + ' AS mlm')}"""

    q["compare_policies"] = compared(("ref", "policy", "nontoxic")) + f"""
SELECT policy_id, CAST(count(*) AS BIGINT) AS n, CAST(count(loss) AS BIGINT) AS n_scored, {r6('avg(loss)')} AS loss,
       {r6('avg(reward_margin)')} AS reward_margin,
       {r6('avg(CASE WHEN correct THEN 1.0 ELSE 0.0 END)')} AS accuracy, {r6('avg(mlm)')} AS mean_logp_margin,
       {r6('avg(CASE WHEN mlm > 0 THEN 1.0 WHEN mlm IS NULL THEN NULL ELSE 0.0 END)')} AS frac_mean_logp_pos
FROM m GROUP BY policy_id"""

    q["compare_checkpoints"] = compared(tuple(Q.CHECKPOINTS)) + f"""
SELECT CAST(substr(policy_id, 6) AS BIGINT) AS step, CAST(count(*) AS BIGINT) AS n, {r6('avg(loss)')} AS loss,
       {r6('avg(reward_margin)')} AS reward_margin,
       {r6('avg(CASE WHEN correct THEN 1.0 ELSE 0.0 END)')} AS accuracy, {r6('avg(mlm)')} AS mean_logp_margin
FROM m GROUP BY policy_id"""

    q["greedy_extend"] = f"""
{greedy_sql(("ref",), Q.GREEDY_STEPS).replace('WITH RECURSIVE ', 'WITH RECURSIVE ' + F2 + ', ' + F3 + ', ')}
SELECT conv_id, CAST(step AS BIGINT) AS step, word FROM walk"""

    gen_models = ("ref", "policy")
    nxt_union = " UNION ALL ".join(
        f"SELECT '{m}' AS model_id, prev, w AS next_word, "
        f"row_number() OVER (PARTITION BY prev ORDER BY c_{m} DESC, w) AS rn FROM bi WHERE c_{m} > 0"
        for m in gen_models)
    q["generation_report"] = f"""
WITH RECURSIVE {F2}, {F3}, {bigram(gen_models)},
nxt AS MATERIALIZED (SELECT model_id, prev, next_word FROM ({nxt_union}) WHERE rn = 1),
seeds AS (SELECT conv_id, {tok('text')} AS t FROM conversations WHERE turn = 0),
sm AS (
  SELECT s.conv_id, m.model_id, s.t[len(s.t)] AS word
  FROM seeds s CROSS JOIN (VALUES ('ref'), ('policy')) m(model_id) WHERE len(s.t) > 0
),
walk(conv_id, model_id, step, word) AS (
  SELECT conv_id, model_id, 0, word FROM sm
  UNION ALL
  SELECT w.conv_id, w.model_id, w.step + 1, n.next_word
  FROM walk w JOIN nxt n ON w.model_id = n.model_id AND w.word = n.prev WHERE w.step < {Q.GREEDY_STEPS}
),
cont AS (SELECT conv_id, model_id, string_agg(word, ' ' ORDER BY step) AS c FROM walk WHERE step > 0
         GROUP BY conv_id, model_id),
ans AS (SELECT sm.conv_id, sm.model_id, coalesce(cont.c, '') AS a
        FROM sm LEFT JOIN cont ON sm.conv_id = cont.conv_id AND sm.model_id = cont.model_id)
SELECT conv_id,
       CAST(max(CASE WHEN model_id = 'ref' THEN length(a) END) AS BIGINT) AS chars_ref,
       CAST(max(CASE WHEN model_id = 'policy' THEN length(a) END) AS BIGINT) AS chars_policy,
       max(CASE WHEN model_id = 'ref' THEN md5(left(a, 900)) END) AS preview_md5_ref,
       max(CASE WHEN model_id = 'policy' THEN md5(left(a, 900)) END) AS preview_md5_policy
FROM ans GROUP BY conv_id"""

    q["extract_answer"] = f"""
WITH {F2},
dec AS (
  SELECT pair_id, rendered, last_prompt_text,
         replace(replace(replace(rendered || chosen_text, '<|im_start|>', ''), '<|im_end|>', ''), '<|endoftext|>', '') AS decoded
  FROM f2
),
sp AS (
  SELECT pair_id, decoded,
         position(rendered IN decoded) AS pos_r,
         CASE WHEN coalesce(length(last_prompt_text), 0) > 0 THEN position(last_prompt_text IN decoded) ELSE 0 END AS pos_p,
         rendered, last_prompt_text
  FROM dec
),
ans AS (
  SELECT pair_id, pos_r > 0 AS matched_rendered, pos_p > 0 AS matched_plain,
         regexp_replace(regexp_replace(CASE WHEN pos_r > 0 THEN substring(decoded, pos_r + length(rendered), length(decoded)) ELSE decoded END,
                                       '^\\s+', ''), '\\s+$', '') AS ans_r,
         regexp_replace(regexp_replace(CASE WHEN pos_p > 0 THEN substring(decoded, pos_p + length(last_prompt_text), length(decoded)) ELSE decoded END,
                                       '^\\s+', ''), '\\s+$', '') AS ans_p
  FROM sp
)
SELECT pair_id, matched_rendered, matched_plain, CAST(length(ans_r) AS BIGINT) AS answer_chars_rendered,
       CAST(length(ans_p) AS BIGINT) AS answer_chars, md5(ans_p) AS answer_md5
FROM ans"""

    step_plan = f"""
WITH {F2},
n AS (SELECT count(*) // 8 AS spe FROM f2i)
SELECT CAST(row_idx // 8 + 1 AS BIGINT) AS step, CAST(count(*) AS BIGINT) AS n_pairs,
       CAST(min(row_idx) AS BIGINT) AS first_row, CAST(max(row_idx) AS BIGINT) AS last_row
FROM f2i, n WHERE row_idx // 8 < n.spe"""
    q["step_plan"] = f"{step_plan} GROUP BY row_idx // 8"
    q["step_plan_capped"] = f"{step_plan} AND row_idx // 8 < {Q.SMOKE_STEPS} GROUP BY row_idx // 8"

    rate = ("CASE WHEN step_idx < warm THEN step_idx / greatest(1.0, warm) "
            "ELSE greatest(0.0, 0.5 * (1 + cos(pi() * (step_idx - warm) / greatest(1.0, total - warm)))) END")
    q["lr_schedule"] = f"""
WITH {F8},
l AS (SELECT run_id, last_step AS step, last_step - 1 AS step_idx, max(last_step) OVER (PARTITION BY run_id) AS total FROM roll),
p AS (SELECT *, ceil(0.03 * total) AS warm FROM l)
SELECT run_id, CAST(step AS BIGINT) AS step, CAST(warm AS BIGINT) AS warmup_steps, {r6(f"1e-6 * {rate} * 1e6")} AS lr_e6
FROM p"""

    q["checkpoint_steps"] = f"""
WITH {F8},
lst AS (SELECT run_id, max(step) AS last_step FROM f8 GROUP BY run_id)
SELECT f8.run_id, CAST(step AS BIGINT) AS step, step = last_step AS is_last
FROM f8 JOIN lst ON f8.run_id = lst.run_id
WHERE step % {Q.SAVE_EVERY} = 0 OR step = last_step"""

    q["linear_dpo_step0"] = f"""
WITH {EMB},
d AS (SELECT pair_id, list_transform(generate_series(1, len(phi_chosen)), lambda i: phi_chosen[i] - phi_rejected[i]) AS dphi FROM fp),
u AS (SELECT unnest(generate_series(0, len(dphi) - 1)) AS dim, unnest(dphi) AS x FROM d)
SELECT CAST(dim AS BIGINT) AS dim, {r6(f'avg(-{Q.CFG.beta} * 0.5 * x) * 1e6')} AS grad_e6
FROM u GROUP BY dim"""

    # plain gradient descent as a chain of steps: scores, gradient, next parameters
    chain = ["t0 AS (SELECT DISTINCT dim, CAST(0 AS DOUBLE) AS th FROM x)"]
    for k in range(Q.LINEAR_STEPS + 1):
        chain.append(f"s{k} AS MATERIALIZED (SELECT pair_id, sum(x * th) AS s FROM x JOIN t{k} USING (dim) GROUP BY pair_id)")
        chain.append(f"g{k} AS MATERIALIZED (SELECT dim, avg(-{Q.CFG.beta} / (1 + exp({Q.CFG.beta} * s)) * x) AS g "
                     f"FROM x JOIN s{k} USING (pair_id) GROUP BY dim)")
        chain.append(f"t{k + 1} AS MATERIALIZED (SELECT dim, th - {Q.LINEAR_LR} * g AS th FROM t{k} JOIN g{k} USING (dim))")
    steps = "\nUNION ALL\n".join(f"""
SELECT CAST({k} AS BIGINT) AS step, {r6(f"avg(-{logsig(f'{Q.CFG.beta} * s')})")} AS loss,
       {r6('avg(CASE WHEN s > 0 THEN 1.0 ELSE 0.0 END)')} AS accuracy,
       {r6(f'(SELECT sum(g * g) FROM g{k}) * 1e6')} AS grad_norm_sq_e6 FROM s{k}""" for k in range(Q.LINEAR_STEPS + 1))
    q["linear_dpo_fit"] = f"""
WITH {EMB},
x AS MATERIALIZED (
  SELECT pair_id, unnest(generate_series(0, len(phi_chosen) - 1)) AS dim,
         unnest(list_transform(generate_series(1, len(phi_chosen)), lambda i: phi_chosen[i] - phi_rejected[i])) AS x
  FROM fp),
{", ".join(chain)}
{steps}"""

    # an epoch's gradients by step at its first parameters, then the moves in order
    chain = ["t0 AS (SELECT DISTINCT dim, CAST(0 AS DOUBLE) AS th FROM x)"]
    for k in range(Q.LINEAR_EPOCHS):
        chain.append(f"s{k} AS MATERIALIZED (SELECT pair_id, any_value(step) AS step, sum(x * th) AS s FROM x JOIN t{k} USING (dim) GROUP BY pair_id)")
        chain.append(f"""g{k} AS MATERIALIZED (SELECT s{k}.step, dim, any_value(rate) AS rate, avg(-{Q.CFG.beta} / (1 + exp({Q.CFG.beta} * s)) * x) AS g
  FROM x JOIN s{k} USING (pair_id) JOIN r ON r.epoch = {k} AND r.in_epoch = s{k}.step GROUP BY s{k}.step, dim)""")
        chain.append(f"p{k} AS MATERIALIZED (SELECT step, dim, th - sum(rate * g) OVER (PARTITION BY dim ORDER BY step) AS th FROM g{k} JOIN t{k} USING (dim))")
        chain.append(f"t{k + 1} AS MATERIALIZED (SELECT dim, th FROM p{k} WHERE step = (SELECT max(step) FROM p{k}))")
    epochs = "\nUNION ALL\n".join(f"""
SELECT CAST({k} AS BIGINT) AS epoch, CAST(max(r.step) AS BIGINT) AS step, CAST(count(*) AS BIGINT) AS n_pairs,
       {r6(f"avg(-{logsig(f'{Q.CFG.beta} * s')})")} AS loss, {r6('avg(CASE WHEN s > 0 THEN 1.0 ELSE 0.0 END)')} AS accuracy,
       {r6('max(r.rate)')} AS rate, {r6('max(gn)')} AS grad_norm_sq, {r6('max(tn)')} AS theta_norm_sq
FROM s{k} JOIN r ON r.epoch = {k} AND r.in_epoch = s{k}.step
JOIN (SELECT step, sum(g * g) AS gn FROM g{k} GROUP BY step) gk ON gk.step = s{k}.step
JOIN (SELECT step, sum(th * th) AS tn FROM p{k} GROUP BY step) pk ON pk.step = s{k}.step GROUP BY s{k}.step""" for k in range(Q.LINEAR_EPOCHS))
    per_step = Q.CFG.batch_size * Q.CFG.grad_accum
    q["linear_dpo_epoch"] = f"""
WITH {EMB},
i AS (SELECT *, (row_number() OVER (ORDER BY pair_id) - 1) // {per_step} AS s, count(*) OVER () // {per_step} AS spe FROM fp),
x AS MATERIALIZED (
  SELECT pair_id, s + 1 AS step, unnest(generate_series(0, len(phi_chosen) - 1)) AS dim,
         unnest(list_transform(generate_series(1, len(phi_chosen)), lambda i: phi_chosen[i] - phi_rejected[i])) AS x
  FROM i WHERE s < spe),
n AS (SELECT max(step) AS spe, {Q.LINEAR_EPOCHS} * max(step) AS total, ceil({Q.CFG.warmup_ratio} * {Q.LINEAR_EPOCHS} * max(step)) AS warm FROM x),
z AS (SELECT *, unnest(generate_series(0, total - 1)) AS step_idx FROM n),
r AS MATERIALIZED (SELECT step_idx // spe AS epoch, step_idx % spe + 1 AS in_epoch, step_idx + 1 AS step,
     {Q.LINEAR_LR} * {rate} / spe AS rate FROM z),
{", ".join(chain)}
{epochs}"""

    q["metric_rollup"] = f"""
WITH {F8}
SELECT run_id, tag, CAST(bin AS BIGINT) AS bin, {r6('value')} AS value, CAST(n AS BIGINT) AS n,
       CAST((bin + 1) * 10 AS BIGINT) AS log_step,
       CAST(first_step AS BIGINT) AS first_step, CAST(last_step AS BIGINT) AS last_step
FROM roll"""

    q["metric_smooth"] = smooth_sql(w)

    for name, v in (("metric_smooth_last", w), ("metric_smooth_last_light", Q.SMOOTH_WEIGHT_LIGHT)):
        q[name] = f"""
WITH {F8},
rk AS (SELECT *, bin + 1 AS k, max(bin + 1) OVER (PARTITION BY run_id, tag) AS nk FROM roll)
SELECT run_id, tag, CAST(max(nk) AS BIGINT) AS n_points,
       {r6(f'sum((1 - {v}) * pow({v}, nk - k) * value) / (1 - pow({v}, max(nk)))')} AS last_smoothed
FROM rk GROUP BY run_id, tag"""

    q["metric_tags"] = scored_batches(Q.AUDIT_BATCH) + f"""
SELECT CAST(batch_id AS BIGINT) AS batch_id, tag, {r6('value')} AS value FROM (
  SELECT batch_id, 'rewards/chosen' AS tag, reward_chosen AS value FROM bm UNION ALL
  SELECT batch_id, 'rewards/rejected', reward_rejected FROM bm UNION ALL
  SELECT batch_id, 'rewards/margins', reward_margin FROM bm UNION ALL
  SELECT batch_id, 'rewards/accuracies', accuracy FROM bm UNION ALL
  SELECT batch_id, 'logps/chosen', logps_chosen FROM bm UNION ALL
  SELECT batch_id, 'logps/rejected', logps_rejected FROM bm)"""

    q["stream_rollup"] = f"""
SELECT CAST(floor(epoch(ts) / 21600) * 21600 AS BIGINT) AS window_start, event_type,
       CAST(count(*) AS BIGINT) AS n, {r6('avg(value)')} AS avg_value, {r6('sum(value)')} AS sum_value
FROM events GROUP BY 1, 2"""

    # append mode: windows that end at or before the last event time less the allowed delay
    q["stream_rollup_append"] = f"""
SELECT * FROM ({q["stream_rollup"]})
WHERE (window_start + 21600) * 1000 <= (SELECT epoch_ms(max(ts)) FROM events) - 3600000"""

    q["stream_metrics"] = f"WITH {F4}, {metrics_cte('f4')} {summary_select('m')}"

    q["stream_smooth"] = f"""
WITH e AS (
  SELECT event_type AS run_id, value,
         row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS k,
         count(*) OVER (PARTITION BY event_type) AS n
  FROM events
)
SELECT run_id, CAST(max(n) AS BIGINT) AS n_points,
       {r6(f'sum((1 - {w}) * pow({w}, n - k) * value) / (1 - pow({w}, max(n)))')} AS last_smoothed
FROM e GROUP BY run_id"""

    q["stream_metric_sink"] = q["metric_rollup"]

    # a straggler is late if its window ended at or before the first delivery's last time less the delay
    q["stream_late_rows"] = f"""
WITH e AS (SELECT event_type, event_id % {Q.STRAGGLERS} = 0 AS straggles, ts, floor(epoch(ts) / 21600) * 21600 + 21600 AS ends FROM events),
w AS (SELECT max(epoch(ts)) FILTER (NOT straggles) - 3600 AS first, max(epoch(ts)) - 3600 AS last FROM e),
k AS (SELECT event_type, straggles AND ends <= w.first AS late, ends <= w.last AS closed FROM e, w)
SELECT event_type, CAST(count(*) AS BIGINT) AS n_read, CAST(count(*) FILTER (NOT late AND closed) AS BIGINT) AS n_emitted,
       CAST(count(*) FILTER (NOT late AND NOT closed) AS BIGINT) AS n_open, CAST(count(*) FILTER (late) AS BIGINT) AS n_late
FROM k GROUP BY event_type"""

    q["load_pairs_split"] = f"""
WITH {F9},
p AS (SELECT CASE WHEN pair_id % 5 = 0 THEN 'test' ELSE 'train' END AS split, pair_id % {Q.BROKEN_LINES} = 0 AS broken, len(c) + len(r) AS n FROM f2m)
SELECT s.split, CAST(count(p.split) FILTER (NOT broken) AS BIGINT) AS n_pairs, CAST(sum(n) FILTER (NOT broken) AS BIGINT) AS n_messages,
       CAST(count(*) FILTER (broken) AS BIGINT) AS n_bad
FROM (VALUES ('train'), ('test')) s(split) LEFT JOIN p ON p.split = s.split GROUP BY s.split"""

    q["checkpoint_roundtrip"] = """
SELECT 'run-a' AS run_id, CAST(step AS BIGINT) AS step, source, CAST(count(*) AS BIGINT) AS n, CAST(sum(length(text)) AS BIGINT) AS chars
FROM documents JOIN (VALUES (1000, 3), (2000, 2)) s(step, share) ON doc_id % 4 < share GROUP BY step, source"""

    return q
