"""Registered queries: evaluation sessions (phrases, fold, scores, report, export, assignment)."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import schemas as S
from ..operators import sessions as SE
from ..operators.sampling import assign_by_hash, pick_known_or_hash
from ..sources import fixtures as FX
from .registry import register

MAX_TURNS = 6  # fixture dialogues are short; 6 utterances = 3 exchanges


def _strip_sql(c: str) -> str:
    return f"lower(regexp_replace({c}, '^\\s+|\\s+$', '', 'g'))"


_FOLD_SQL = f"""
with f as (select *, {_strip_sql('input_text')} = '{S.SUCCESS_PHRASE}' as is_success, {_strip_sql('input_text')} = '{S.FAILURE_PHRASE}' as is_failure
           from v_session_inputs),
c as (select *, count(*) filter (where not (is_success or is_failure)) over (partition by session_id order by seq rows between unbounded preceding and current row) as ex_no from f),
e as (select session_id, min(case when is_success or is_failure then seq when ex_no * 2 >= {MAX_TURNS} and not (is_success or is_failure) then seq end) as end_seq from c group by session_id),
folded as (select c.session_id, c.seq,
     case when e.end_seq is not null and c.seq > e.end_seq then 'after_end' when is_success then 'success' when is_failure then 'failure' else 'exchange' end as status,
     coalesce(c.seq = e.end_seq, false) as ends_session, c.model_name, c.input_text, c.answer
   from c left join e using (session_id)),
said as (select *, case when status in ('success', 'failure') then '{S.SESSION_END_TEXT}'
     when status = 'exchange' then answer || case when ends_session then '{S.SESSION_LIMIT_TEXT}' else '' end end as response from folded),
summary as (select session_id, first(model_name) as model_name, count(*) filter (where status = 'exchange') as n_exchanges,
     bool_or(status = 'success' and ends_session) as success,
     max(case when ends_session then (case when status = 'exchange' then 'limit' else status end) end) as end_reason
   from folded group by session_id)
"""


def _folded(spark, d):
    return SE.session_fold(FX.v_session_inputs(spark, d), MAX_TURNS, answer="answer")


@register("session_phrases", f"""
select session_id, seq, {_strip_sql('input_text')} = '{S.SUCCESS_PHRASE}' as is_success, {_strip_sql('input_text')} = '{S.FAILURE_PHRASE}' as is_failure
from v_session_inputs""")
def q_session_phrases(spark, d):
    return SE.phrase_flags(FX.v_session_inputs(spark, d)).select("session_id", "seq", "is_success", "is_failure")


@register("session_fold", _FOLD_SQL + "select session_id, seq, status, ends_session, response from said")
def q_session_fold(spark, d):
    return _folded(spark, d).select("session_id", "seq", "status", "ends_session", "response")


@register("session_scores", """
select coalesce(s.session_id, sc.session_id) as session_id, sc.q1, sc.q2, sc.q3,
  case when s.session_id is null then 'orphan' when sc.q1 is not null or sc.q2 is not null or sc.q3 is not null then 'scored' else 'unscored' end as status
from (select distinct session_id from v_session_inputs) s full outer join v_session_scores sc on sc.session_id = s.session_id""")
def q_session_scores(spark, d):
    return SE.session_scores(FX.v_session_inputs(spark, d), FX.v_session_scores(spark, d)).select(
        "session_id", "q1", "q2", "q3", "status")


@register("session_report", _FOLD_SQL + """
select model_name as model, count(*) as participants, round(avg(cast(success as int)) * 100, 6) as success_pct,
  round(avg(n_exchanges), 6) as avg_turns, round(avg(try_cast(sc.q3 as int)), 6) as avg_satisfaction
from summary left join v_session_scores sc using (session_id) group by model_name""")
def q_session_report(spark, d):
    summ = SE.session_summary(_folded(spark, d))
    return SE.session_report(summ, FX.v_session_scores(spark, d))


@register("sessions_export", _FOLD_SQL + """,
logs as (select session_id, string_agg(input_text || chr(9) || response || chr(9) || cast(ends_session as string), chr(10) order by seq) as log_text,
    string_agg('USER ' || input_text || chr(10) || 'SYSTEM ' || answer, chr(10) order by seq) as context_text
  from said where status = 'exchange' group by session_id)
select s.session_id, s.model_name, case when sc.session_id is not null then 'finished' else 'unfinished' end as export_dir,
  s.n_exchanges as n_log, s.success, s.end_reason, coalesce(l.log_text, '') as log_text, coalesce(l.context_text, '') as context_text,
  sc.q1 || ',' || sc.q2 || ',' || sc.q3 as answers
from summary s left join v_session_scores sc using (session_id) left join logs l using (session_id)""")
def q_sessions_export(spark, d):
    folded = _folded(spark, d)
    scores = FX.v_session_scores(spark, d).select("session_id", F.concat_ws(",", "q1", "q2", "q3").alias("answers"))
    j = SE.session_summary(folded).join(SE.session_log(folded), "session_id").join(scores, "session_id", "left")
    line = lambda x: F.concat_ws("\t", x["input_text"], x["response"], x["session_over"].cast("string"))
    return j.select("session_id", "model_name",
                    F.when(F.col("answers").isNotNull(), F.lit("finished")).otherwise(F.lit("unfinished")).alias("export_dir"),
                    F.col("n_exchanges").alias("n_log"), "success", "end_reason",
                    F.array_join(F.transform("log", line), "\n").alias("log_text"),
                    F.array_join(F.transform("context", lambda x: F.array_join(x, " ")), "\n").alias("context_text"),
                    "answers")


# ----------------------------------------------------------------------------- assignment

def _h(c: str) -> str:
    return f"('0x' || substr(md5(cast({c} as string)), 1, 8))::bigint"


@register("model_assign", f"""
with req as (select distinct session_id, case session_id % 3 when 0 then 'model_a' when 1 then 'model_x' end as requested from v_session_inputs),
m as (select model_name, row_number() over (order by model_name) - 1 as idx from (select distinct model_name from v_session_inputs) x),
n as (select count(*) as n from m)
select r.session_id, coalesce(k.model_name, p.model_name) as model, case when k.model_name is not null then 'requested' else 'sampled' end as how
from req r left join m k on k.model_name = r.requested
  cross join n left join m p on p.idx = {_h('r.session_id')} % n.n""")
def q_model_assign(spark, d):
    inp = FX.v_session_inputs(spark, d)
    sid = F.col("session_id")
    req = inp.select("session_id").distinct().withColumn(
        "requested", F.when(sid % 3 == 0, "model_a").when(sid % 3 == 1, "model_x"))
    models = inp.select(F.col("model_name").alias("choice")).distinct()
    out = pick_known_or_hash(req, models, "session_id", "requested", "choice")
    return out.select("session_id", F.col("choice").alias("model"), "how")


@register("goal_assign", f"""
with req as (select distinct session_id, session_id + 1 as requested from v_session_inputs),
t as (select conv_id, split_pos from v_splits where split = 'test'),
n as (select count(*) as n from t)
select r.session_id, coalesce(k.conv_id, p.conv_id) as conv_id, case when k.conv_id is not null then 'selected' else 'sampled' end as how
from req r left join t k on k.conv_id = r.requested
  cross join n left join t p on p.split_pos = {_h('r.session_id')} % n.n""")
def q_goal_assign(spark, d):
    inp = FX.v_session_inputs(spark, d)
    req = inp.select("session_id").distinct().withColumn("requested", F.col("session_id") + 1)
    test = FX.v_splits(spark, d).filter(F.col("split") == "test").select("conv_id", "split_pos")
    out = assign_by_hash(req, test, "session_id", "requested", "conv_id", "split_pos")
    return out.select("session_id", "conv_id", "how")
