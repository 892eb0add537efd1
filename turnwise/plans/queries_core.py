"""Registered queries: sources, projections, splits, resume, contexts, scoring."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import schemas as S
from ..operators import context as ctx
from ..operators import metrics as M
from ..operators import sampling as SMP
from ..sources import fixtures as FX
from .registry import register

R6 = 6  # scores are rounded to 6 digits on both engines (summation order differs)
# Turn chunk of the bounded-context windows. Fixture dialogues are short, so a small chunk
# makes every context cross chunk borders (the carry-in path is what gets checked).
CTX_CHUNK = 3


def _r(c):
    return F.round(c, R6)


# ----------------------------------------------------------------------------- sources / projections

@register("src_turns", """
select conv_id, turn, cast(row_number() over (partition by conv_id order by turn) - 1 as bigint) as pos, speaker, utterance
from v_turns""")
def q_src_turns(spark, d):
    from pyspark.sql import Window
    w = Window.partitionBy("conv_id").orderBy("turn")
    t = FX.v_turns(spark, d)
    return t.select("conv_id", "turn", (F.row_number().over(w) - 1).cast("bigint").alias("pos"), "speaker", "utterance")


@register("src_splits", "select split, split_pos, conv_id from v_splits")
def q_src_splits(spark, d):
    return FX.v_splits(spark, d)


@register("turns_flat", "select conv_id, turn, utterance as response from v_turns where speaker <> 'USER'")
def q_turns_flat(spark, d):
    return (FX.v_turns(spark, d).filter(F.col("speaker") != "USER")
            .select("conv_id", "turn", F.col("utterance").alias("response")))


@register("split_dialogues", "select conv_id, split_pos from v_splits where split = 'test'")
def q_split_dialogues(spark, d):
    return SMP.split_members(FX.v_splits(spark, d), "test").select("conv_id", "split_pos")


@register("split_assign", """
select s.split, s.split_pos, s.conv_id, t.n_turns
from v_splits s join (select conv_id, count(*) as n_turns from v_turns group by conv_id) t using (conv_id)""")
def q_split_assign(spark, d):
    return SMP.split_assign(FX.v_splits(spark, d), FX.v_turns(spark, d))


@register("bad_speakers", "select conv_id, turn, role from conversations where role not in ('user', 'assistant')")
def q_bad_speakers(spark, d):
    c = FX.table(spark, d, "conversations")
    return SMP.bad_speakers(c, role="role", allowed=("user", "assistant")).select("conv_id", "turn", "role")


@register("first_n", "select split, split_pos, conv_id from v_splits where split_pos < 5")
def q_first_n(spark, d):
    return SMP.first_n(FX.v_splits(spark, d), 5)


@register("work_parts", """
with s as (select split, split_pos, conv_id, count(*) over (partition by split) as n from v_splits)
select split, conv_id, split_pos,
  cast(case when split_pos < (n % 4) * (n // 4 + 1) then split_pos // (n // 4 + 1)
            else (n % 4) + (split_pos - (n % 4) * (n // 4 + 1)) // (n // 4) end as bigint) as part
from s""")
def q_work_parts(spark, d):
    return SMP.work_parts(FX.v_splits(spark, d), 4).select("split", "conv_id", "split_pos", "part")


# ----------------------------------------------------------------------------- resume / merge

@register("resume_latest", """
select conv_id, line_no, payload from (
  select *, row_number() over (partition by conv_id order by line_no desc) as rn from v_progress) x where rn = 1""")
def q_resume_latest(spark, d):
    return SMP.latest_per_key(FX.v_progress(spark, d), ["conv_id"], "line_no").select("conv_id", "line_no", "payload")


@register("resume_todo", """
select split, split_pos, conv_id from v_splits s
where not exists (select 1 from v_progress p where p.conv_id = s.conv_id)""")
def q_resume_todo(spark, d):
    return SMP.resume_todo(FX.v_splits(spark, d), FX.v_progress(spark, d), ["conv_id"])


@register("merge_results", """
with latest as (select conv_id, payload from (
    select *, row_number() over (partition by conv_id order by line_no desc) as rn from v_progress) x where rn = 1),
fresh as (select conv_id, 'fresh' as payload from v_splits where split = 'test'),
u as (select conv_id, payload, 'log' as origin, 0 as prio from latest
      union all select conv_id, payload, 'run', 1 from fresh)
select conv_id, arg_max(payload, prio) as payload, arg_max(origin, prio) as origin from u group by conv_id""")
def q_merge_results(spark, d):
    latest = SMP.latest_per_key(FX.v_progress(spark, d), ["conv_id"], "line_no").select("conv_id", "payload")
    fresh = SMP.split_members(FX.v_splits(spark, d), "test").select("conv_id", F.lit("fresh").alias("payload"))
    return SMP.merge_results(latest, fresh, ["conv_id"])


# ----------------------------------------------------------------------------- contexts

def _ctx_sql(k: int) -> str:
    start = "unbounded preceding" if k == 0 else f"{k} preceding"
    return f"""
select conv_id, turn, coalesce(array_to_string(list(case speaker when 'USER' then '{S.USER_PREFIX}' else '{S.SYSTEM_PREFIX}' end || ' ' || utterance)
    over (partition by conv_id order by turn rows between {start} and 1 preceding), ' '), '') as context_text, speaker
from v_turns"""


@register("ctx_full", """
select conv_id, turn, n_ctx, speakers from (
  select conv_id, turn, speaker,
    count(*) over (partition by conv_id order by turn rows between unbounded preceding and 1 preceding) as n_ctx,
    coalesce(array_to_string(list(speaker) over (partition by conv_id order by turn rows between unbounded preceding and 1 preceding), ' '), '') as speakers
  from v_turns) x where speaker <> 'USER'""")
def q_ctx_full(spark, d):
    t = ctx.system_turns_with_context(FX.v_turns(spark, d), 0)
    return t.select("conv_id", "turn", F.size("context").cast("bigint").alias("n_ctx"),
                    F.array_join(F.transform("context", lambda x: x["speaker"]), " ").alias("speakers"))


@register("ctx_text", f"select conv_id, turn, context_text from ({_ctx_sql(0)}) x where speaker <> 'USER'")
def q_ctx_text(spark, d):
    chunks, ranges = ctx.context_ranges(FX.v_turns(spark, d), 0)
    return ctx.render_ranges(chunks, ranges)


@register("ctx_ranges", f"""
select conv_id, turn, first, last from (
  select conv_id, turn, speaker, coalesce(lag(upto, 5) over (partition by conv_id order by turn), 0) as first, upto as last from (
    select conv_id, turn, speaker, cast(coalesce(sum(length(case speaker when 'USER' then '{S.USER_PREFIX}' else '{S.SYSTEM_PREFIX}' end) +
        length(utterance) + 2) over (partition by conv_id order by turn rows between unbounded preceding and 1 preceding), 0) as bigint) as upto
    from v_turns) a) b where speaker <> 'USER'""")
def q_ctx_ranges(spark, d):
    return ctx.context_ranges(FX.v_turns(spark, d), 5, chunk_size=CTX_CHUNK)[1].select("conv_id", "turn", "first", "last")


@register("ctx_last2", f"select conv_id, turn, context_text from ({_ctx_sql(2)}) x where speaker <> 'USER'")
def q_ctx_last2(spark, d):
    return ctx.context_strings(FX.v_turns(spark, d), 2, chunk_size=CTX_CHUNK).select("conv_id", "turn", "context_text")


@register("ctx_last5", f"select conv_id, turn, context_text from ({_ctx_sql(5)}) x where speaker <> 'USER'")
def q_ctx_last5(spark, d):
    return ctx.context_strings(FX.v_turns(spark, d), 5, chunk_size=CTX_CHUNK).select("conv_id", "turn", "context_text")


# ----------------------------------------------------------------------------- scoring

_STATES_SQL = """
with st as (select t.side, t.turn_key, coalesce(string_agg(i.item, ', ' order by i.item), '') as s
            from v_state_turns t left join v_state_items i on i.side = t.side and i.turn_key = t.turn_key group by t.side, t.turn_key),
     r as (select turn_key, s from st where side = 'ref'),
     h as (select turn_key, s from st where side = 'hyp')
"""


def _eval_join(spark, d):
    from ..operators.state import items_to_state_text
    state = items_to_state_text(FX.v_state_items(spark, d), ["side", "turn_key"])
    turns = FX.v_state_turns(spark, d).join(state, ["side", "turn_key"], "left").select(
        "side", "turn_key", F.coalesce("state", F.lit("")).alias("state"))
    side = lambda x: turns.filter(F.col("side") == x).select("turn_key", F.col("state").alias(f"{x}_state"))
    return M.eval_join(side("ref"), side("hyp"), ["turn_key"])


@register("eval_join", _STATES_SQL + "select r.turn_key, r.s as ref_state, h.s as hyp_state from r join h using (turn_key)")
def q_eval_join(spark, d):
    return _eval_join(spark, d).select("turn_key", "ref_state", "hyp_state")


@register("eval_coverage", """
with r as (select turn_key from v_state_turns where side = 'ref'),
     h as (select turn_key from v_state_turns where side = 'hyp')
select (select count(*) from r) as n_ref, (select count(*) from h) as n_hyp,
  (select count(*) from r join h using (turn_key)) as n_matched,
  (select count(*) from r where turn_key not in (select turn_key from h)) as n_missing,
  (select count(*) from h where turn_key not in (select turn_key from r)) as n_extra""")
def q_eval_coverage(spark, d):
    turns = FX.v_state_turns(spark, d)
    ref = turns.filter(F.col("side") == "ref").select("turn_key")
    hyp = turns.filter(F.col("side") == "hyp").select("turn_key")
    return M.coverage(ref, hyp, ["turn_key"])


_LONG_METRICS_SQL = _STATES_SQL + """,
x as (select r.turn_key, list_distinct(string_split(r.s, ', ')) as a, list_distinct(string_split(h.s, ', ')) as b from r join h using (turn_key)),
c as (select turn_key, cast(len(list_intersect(a, b)) as bigint) as tp, cast(len(list_filter(b, lambda v: not list_contains(a, v))) as bigint) as fp,
             cast(len(list_filter(a, lambda v: not list_contains(b, v))) as bigint) as fn from x),
m as (select turn_key, tp, fp, fn, cast(fp = 0 and fn = 0 as bigint) as joint_goal_accuracy,
        case when tp = 0 then 0.0 else 2 * (tp / (tp + fp)) * (tp / (tp + fn)) / ((tp / (tp + fp)) + (tp / (tp + fn))) end as slot_f1
      from c)
"""


def _metrics_long(spark, d):
    return M.state_metrics_long(FX.v_state_items(spark, d), ["turn_key"], FX.v_state_turns(spark, d))


@register("jga", _LONG_METRICS_SQL + "select turn_key, tp, fp, fn, joint_goal_accuracy from m")
def q_jga(spark, d):
    return _metrics_long(spark, d).select("turn_key", "tp", "fp", "fn", "joint_goal_accuracy")


@register("slot_f1", _STATES_SQL + """,
x as (select r.turn_key, list_distinct(string_split(r.s, ', ')) as a, list_distinct(string_split(h.s, ', ')) as b from r join h using (turn_key)),
c as (select turn_key, len(list_intersect(a, b)) as tp, len(list_filter(b, lambda v: not list_contains(a, v))) as fp,
             len(list_filter(a, lambda v: not list_contains(b, v))) as fn from x)
select turn_key, round(case when tp = 0 then 0.0 else 2 * (tp / (tp + fp)) * (tp / (tp + fn)) / ((tp / (tp + fp)) + (tp / (tp + fn))) end, 6) as slot_f1
from c""")
def q_slot_f1(spark, d):
    m = M.state_metrics(_eval_join(spark, d), "ref_state", "hyp_state")
    return m.select("turn_key", _r(F.col("slot_f1")).alias("slot_f1"))


@register("score_summary", _LONG_METRICS_SQL + """,
l as (select 'joint_goal_accuracy' as metric, cast(joint_goal_accuracy as double) as value from m
      union all select 'slot_f1', slot_f1 from m)
select metric, count(*) as n, round(avg(value), 6) as mean, round(stddev_samp(value), 6) as std, round(min(value), 6) as min,
  round(quantile_cont(value, 0.25), 6) as p25, round(quantile_cont(value, 0.5), 6) as p50,
  round(quantile_cont(value, 0.75), 6) as p75, round(max(value), 6) as max
from l group by metric""")
def q_score_summary(spark, d):
    s = M.describe(_metrics_long(spark, d), ["joint_goal_accuracy", "slot_f1"])
    return s.select("metric", "n", *[_r(F.col(c)).alias(c) for c in ("mean", "std", "min", "p25", "p50", "p75", "max")])


@register("model_scores", _LONG_METRICS_SQL + """
select o_orderpriority as model, count(*) as n, round(avg(joint_goal_accuracy), 6) as avg_jga, round(avg(slot_f1), 6) as avg_slot_f1
from m join orders on o_orderkey = turn_key group by o_orderpriority""")
def q_model_scores(spark, d):
    m = _metrics_long(spark, d)
    models = FX.table(spark, d, "orders").select(F.col("o_orderkey").alias("turn_key"), F.col("o_orderpriority").alias("model"))
    return M.model_scores(m.join(models, "turn_key"), "model", {"avg_jga": "joint_goal_accuracy", "avg_slot_f1": "slot_f1"})
