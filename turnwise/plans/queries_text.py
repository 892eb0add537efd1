"""Registered queries: training pairs, prompts, tokens, text helpers, BLEU."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from .. import schemas as S
from ..functions import text as TX
from ..operators import bleu as BL
from ..operators import context as ctx
from ..operators import prompts as PR
from ..operators import training as TR
from ..operators.joins import materialize
from ..sources import fixtures as FX
from .registry import register

EMPTY_DB_TEXT = "total 0, candidate [], selected []"
IN_CAP, OUT_CAP, PAD = 16, 8, 0
TRAIN_CAP = 100


def q(s: str) -> str:
    """SQL string literal (real newlines kept)."""
    return "'" + s.replace("'", "''") + "'"


def _ctx_sql(k: int) -> str:
    start = "unbounded preceding" if k == 0 else f"{k} preceding"
    return f"""select conv_id, turn, speaker, utterance,
  coalesce(array_to_string(list(case speaker when 'USER' then {q(S.USER_PREFIX)} else {q(S.SYSTEM_PREFIX)} end || ' ' || utterance)
    over (partition by conv_id order by turn rows between {start} and 1 preceding), ' '), '') as ctx
from v_turns"""


# ----------------------------------------------------------------------------- annotated turns
# A system turn's state, database result and booking are those of the request
# conv_id * 32 + turn % 8 (orders have keys of that form); a turn without one has empty texts. Its
# active domain is the booking's domain.

def _request_of(turns):
    return turns.withColumn("request_id", (F.col("conv_id") * 32 + F.col("turn") % 8).cast("bigint"))


def _annotations(spark, d, turns):
    """State, database and booking texts of the requests of ``turns``: only those are worked out."""
    from .queries_entities import CONSTRAINTS, _bookings, _db, _entities
    from ..operators import booking as BK
    from ..operators import entities as EN
    from ..operators.joins import broadcast_if_small
    ids, _ = broadcast_if_small(materialize(_request_of(turns).select("request_id").distinct()))
    r = materialize(FX.v_requests(spark, d).join(ids, "request_id", "left_semi"))
    part = lambda s: F.when(EN.is_active(F.col(s)), F.concat_ws(" ", "domain", F.lit(s), s))
    ents = _entities(spark, d)
    db = EN.db_result_text(_db(spark, d, ents, with_sample=True, requests=r), ents)
    book = _bookings(spark, d).join(ids, "request_id", "left_semi").select(
        "request_id", F.col("domain").alias("active_domain"), BK.book_result_text(
            F.col("domain"), F.col("success"), F.col("ref")).alias("book_text"))
    state = r.select("request_id", F.concat_ws(", ", part("city"), *[part(s) for s in CONSTRAINTS]).alias("state_text"))
    return state.join(db, "request_id").join(book, "request_id")


def _annotated(spark, d, k, only=None):
    """System turns (those of ``only``: conv_id, turn) with context of ``k`` turns, state, database and booking texts."""
    turns = FX.v_turns(spark, d)
    t = ctx.context_strings(turns if only is None else turns.join(only, "conv_id", "left_semi"), k)
    said = turns.filter("speaker = 'SYSTEM'").select("conv_id", "turn") if only is None else only
    if only is not None:
        t = t.join(only.select("conv_id", "turn"), ["conv_id", "turn"], "left_semi")
    t = _request_of(t).join(_annotations(spark, d, said), "request_id", "left")
    return t.fillna({"state_text": "", "db_text": EMPTY_DB_TEXT, "book_text": "", "active_domain": "general"})


def _annotated_sql(k: int) -> str:
    from .queries_entities import _BOOK, _ENT, _inactive
    item = lambda s: f"case when not {_inactive('r.' + s)} then r.domain || ' {s} ' || r.{s} end"
    return _ENT + ", " + _BOOK.strip()[5:] + f""",
cl as (select request_id, string_agg(name, ', ' order by rank) as names from sampled group by request_id),
ann as (select r.request_id, br.domain as active_domain, concat_ws(', ', {item('city')}, {item('genre')}, {item('size')}) as state_text,
    'total ' || cast(db.total as string) || ', candidate [' || coalesce(cl.names, '') || '], selected [' || coalesce(rec.body || ', domain ' || rec.domain, '') || ']' as db_text,
    coalesce(concat_ws(', ', case when br.success then br.domain || ' success True' end,
      case when br.ref is not null and br.ref <> 0 then br.domain || ' ref ' || cast(br.ref as string) end), '') as book_text
  from req r join db using (request_id) left join cl using (request_id) left join rec on rec.entity_pos = db.active_pos join br using (request_id)),
said as ({_ctx_sql(k)}),
turns as (select s.*, coalesce(a.state_text, '') as state_text, coalesce(a.db_text, '{EMPTY_DB_TEXT}') as db_text,
    coalesce(a.book_text, '') as book_text, coalesce(a.active_domain, 'general') as active_domain
  from said s left join ann a on a.request_id = s.conv_id * 32 + s.turn % 8 where s.speaker = 'SYSTEM')
"""


# ----------------------------------------------------------------------------- training pairs

def _pairs(spark, d, only=None):
    t = _annotated(spark, d, 0, only).join(FX.v_splits(spark, d).select("conv_id", "split"), "conv_id")
    p = TR.training_pairs(t, F.col("context_text"), F.col("state_text"), F.col("db_text"), F.col("book_text"),
                          F.col("utterance"))
    return p.select("split", "conv_id", "turn", "task", "input_text", "output_text")


_PAIRS_SQL = _annotated_sql(0) + f""",
pairs as (
  select sp.split, t.conv_id, t.turn, 'dst' as task, {q(S.DST_TASK_PREFIX + ' ')} || ctx as input_text, state_text as output_text
  from turns t join v_splits sp using (conv_id)
  union all
  select sp.split, t.conv_id, t.turn, 'rg', {q(S.RG_TASK_PREFIX + ' ')} || ctx || {q(' ' + S.STATE_PREFIX + ' ')} || state_text ||
    {q(' ' + S.DB_RESULT_PREFIX + ' ')} || db_text || {q(' ' + S.BOOK_RESULT_PREFIX + ' ')} || book_text, utterance
  from turns t join v_splits sp using (conv_id))
"""


@register("training_pairs", _PAIRS_SQL + "select split, conv_id, turn, task, input_text, output_text from pairs")
def q_training_pairs(spark, d):
    return _pairs(spark, d)


@register("sample_counts", _PAIRS_SQL + f"select split, count(*) as n_rows, least({TRAIN_CAP}, count(*)) as n_used from pairs group by split")
def q_sample_counts(spark, d):
    return TR.sample_counts(FX.v_turns(spark, d), FX.v_splits(spark, d), TRAIN_CAP)


@register("train_rows", _PAIRS_SQL + f"""
select split, conv_id, turn, task, input_text, output_text from pairs
qualify row_number() over (partition by split order by conv_id, turn, task) <= {TRAIN_CAP}""")
def q_train_rows(spark, d):
    """The first rows of every split, as many as a training run takes. The turns are chosen first, so that no state,
    database result or text of any other turn is made."""
    turns = FX.v_turns(spark, d).filter("speaker = 'SYSTEM'").select("conv_id", "turn")
    turns = turns.join(FX.v_splits(spark, d).select("conv_id", "split"), "conv_id")
    chosen = TR.first_rows(turns, -(-TRAIN_CAP // TR.ROWS_PER_TURN), ["split"], ["conv_id", "turn"])
    only = materialize(chosen.select("conv_id", "turn"))
    return TR.first_rows(_pairs(spark, d, only), TRAIN_CAP, ["split"], ["conv_id", "turn", "task"])


# ----------------------------------------------------------------------------- prompts

#: Letters whose counts are the vector of a context: an embedding that DuckDB can follow.
LETTERS = "aeinorst"
EXAMPLE_QUOTA = 5


def letter_counts(df, text: str = "context_text", out: str = "embedding"):
    return df.withColumn(out, F.array(*[(F.length(text) - F.length(F.replace(F.col(text), F.lit(c), F.lit("")))).cast("double")
                                        for c in LETTERS]))


def _prompt_base(spark, d, kind):
    """System turns with the template of their active domain and the nearest examples of a stored index.

    The index holds the turns of a domain-balanced sample of training dialogues, with their texts, and the
    arguments it was built with; the query contexts are rendered by these arguments."""
    from ..operators import sampling as SMP
    from ..session import ensure_checkpoint_dir
    from ..sources import files as FL
    from .jobs import query_contexts, with_examples
    turns = FX.v_turns(spark, d)
    t = materialize(_annotated(spark, d, S.LLM_CONTEXT_TURNS).withColumn("query_id", F.col("conv_id") * 1000 + F.col("turn")))
    args = {"context_turns": S.INDEX_CONTEXT_TURNS, "quota": EXAMPLE_QUOTA}
    short = query_contexts(turns, args).select("conv_id", "turn", "context_text")
    goals = FX.v_conv_goals(spark, d).join(
        FX.v_splits(spark, d).filter("split = 'train'").select("conv_id", "split_pos"), "conv_id")
    picked = SMP.balanced_sample(goals, EXAMPLE_QUOTA, key="conv_id", order="split_pos")
    docs = t.drop("context_text").join(picked, "conv_id", "left_semi").join(short, ["conv_id", "turn"]).select(
        F.col("query_id").alias("example_id"), "context_text", "state_text", "db_text", "book_text",
        F.col("utterance").alias("response"))
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/examples-{uuid.uuid4().hex}"
    FL.write_index(docs, path, args)
    index, args = FL.read_index(spark, path)
    asked = t.withColumnRenamed("context_text", "long_context").join(
        query_contexts(turns, args).select("conv_id", "turn", "context_text"), ["conv_id", "turn"])
    t = with_examples(asked, index, S.FEWSHOT_EXAMPLES, embed=letter_counts).drop("context_text").withColumnRenamed(
        "long_context", "context_text")
    templates = PR.template_table(spark).filter(F.col("kind") == kind).select(
        F.col("domain").alias("active_domain"), F.col("text").alias("template"))
    return t.join(F.broadcast(templates), "active_domain")  # a few rows per domain


_COUNTS = "[" + ", ".join(f"cast(length(ctx) - length(replace(ctx, '{c}', '')) as double)" for c in LETTERS) + "]"

_PROMPT_BASE_SQL = _annotated_sql(S.LLM_CONTEXT_TURNS) + f""",
tpl(domain, kind, text) as (values {", ".join(f"({q(a)}, {q(b)}, {q(c)})" for a, b, c in PR.default_templates())}),
short as (select conv_id, turn, ctx, {_COUNTS} as v from ({_ctx_sql(S.INDEX_CONTEXT_TURNS)}) where speaker = 'SYSTEM'),
goal_pos as (select c.conv_id, c.domain, s.split_pos from v_conv_goals c join v_splits s using (conv_id) where s.split = 'train'),
picked as (select distinct conv_id from (
    select conv_id, row_number() over (partition by domain order by split_pos, conv_id) as rn from goal_pos) x where rn <= {EXAMPLE_QUOTA}),
docs as (select t.conv_id * 1000 + t.turn as id, s.ctx, s.v, t.state_text, t.db_text, t.book_text, t.utterance
  from turns t join short s using (conv_id, turn) where t.conv_id in (select conv_id from picked)),
near as (select s.conv_id, s.turn, docs.*, list_sum(list_transform(list_zip(s.v, docs.v), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) as dist
  from short s cross join docs),
best as (select *, row_number() over (partition by conv_id, turn order by dist, id) as rank from near
  qualify row_number() over (partition by conv_id, turn order by dist, id) <= {S.FEWSHOT_EXAMPLES}),
shown as (select conv_id, turn, list({{'ctx': ctx, 'st': state_text, 'db': db_text, 'bk': book_text, 'resp': utterance}} order by rank) as ex
  from best group by conv_id, turn),
e as (select t.*, coalesce(shown.ex, []) as ex from turns t left join shown using (conv_id, turn))
"""


def _ex_sql(body: str) -> str:
    head = S.PROMPT_EXAMPLE_HEADER.split("{i}")
    return (f"case when len(ex) > 0 then array_to_string(list_transform(ex, lambda x, i: {q(head[0])} || cast(i as string) || "
            f"{q(head[1])} || {body}), '') || {q(S.PROMPT_EXAMPLES_END)} else '' end")


@register("state_prompt", _PROMPT_BASE_SQL + f"""
select conv_id, turn, tpl.text ||
  {_ex_sql(f"{q(S.PROMPT_INPUT)} || x.ctx || {q(chr(10) + S.PROMPT_OUTPUT + S.STATE_PREFIX + ' ')} || x.st || {q(chr(10))}")} ||
  {q(S.PROMPT_INPUT)} || ctx || {q(chr(10) + S.PROMPT_OUTPUT + S.STATE_PREFIX + ' ')} as prompt
from e join tpl on tpl.domain = e.active_domain and tpl.kind = 'state'""")
def q_state_prompt(spark, d):
    p = PR.state_prompt(F.col("template"), F.col("context_text"), F.col("examples"))
    return _prompt_base(spark, d, "state").select("conv_id", "turn", p.alias("prompt"))


def _resp_block_sql(c: str, x: str, st: str = "state_text", db: str = "db_text", bk: str = "book_text") -> str:
    return (f"{c} || {q(chr(10) + S.STATE_PREFIX + ' ')} || {x}{st} || {q(chr(10) + S.DB_RESULT_PREFIX + ' ')} || {x}{db} || "
            f"{q(chr(10) + S.BOOK_RESULT_PREFIX + ' ')} || {x}{bk} || {q(chr(10))}")


@register("response_prompt", _PROMPT_BASE_SQL + f"""
select conv_id, turn, tpl.text ||
  {_ex_sql(f"{q(S.PROMPT_INPUT)} || {_resp_block_sql('x.ctx', 'x.', 'st', 'db', 'bk')} || {q(S.PROMPT_OUTPUT + S.SYSTEM_PREFIX + ' ')} || x.resp || {q(chr(10))}")} ||
  {q(S.PROMPT_INPUT)} || {_resp_block_sql('ctx', '')} || {q(S.PROMPT_OUTPUT + S.SYSTEM_PREFIX + ' ')} as prompt
from e join tpl on tpl.domain = e.active_domain and tpl.kind = 'response'""")
def q_response_prompt(spark, d):
    p = PR.response_prompt(F.col("template"), F.col("context_text"), F.col("state_text"), F.col("db_text"),
                           F.col("book_text"), F.col("examples"))
    return _prompt_base(spark, d, "response").select("conv_id", "turn", p.alias("prompt"))


# ----------------------------------------------------------------------------- tokens

def _toks():
    return TX.ws_tokens(F.col("utterance"))


_TOK_SQL = """
with tk as (select conv_id, turn, list_filter(regexp_split_to_array(utterance, '\\s+'), lambda t: t <> '') as toks from v_turns),
"""


@register("truncate_tokens", _TOK_SQL + f"""
x as (select 1)
select conv_id, turn, array_to_string(list_slice(toks, greatest(len(toks) - {IN_CAP - 1}, 1), len(toks)), ' ') as input_tokens,
  array_to_string(list_slice(toks, 1, {OUT_CAP}), ' ') as target_tokens from tk""")
def q_truncate_tokens(spark, d):
    t = FX.v_turns(spark, d).withColumn("toks", _toks())
    return t.select("conv_id", "turn", F.array_join(TR.truncate_left(F.col("toks"), IN_CAP), " ").alias("input_tokens"),
                    F.array_join(TR.truncate_right(F.col("toks"), OUT_CAP), " ").alias("target_tokens"))


_VOCAB_SQL = _TOK_SQL + """
cnt as (select t as token, count(*) as n from (select unnest(toks) as t from tk) u group by t),
vocab as (select token, n, row_number() over (order by n desc, token) as id from cnt)
"""


def _vocab(spark, d):
    t = FX.v_turns(spark, d).select(F.explode(_toks()).alias("token"))
    return TR.vocabulary(t)


@register("token_table", _VOCAB_SQL + "select token, n, id from vocab")
def q_token_table(spark, d):
    return _vocab(spark, d).select("token", "n", F.col("id").cast("bigint").alias("id"))


@register("pad_mask", _VOCAB_SQL + f""",
tr as (select conv_id, turn, list_slice(toks, greatest(len(toks) - {IN_CAP - 1}, 1), len(toks)) as it, list_slice(toks, 1, {OUT_CAP}) as ot from tk),
ii as (select conv_id, turn, list(v.id order by u.p) as ids from (select conv_id, turn, unnest(it) as tok, generate_subscripts(it, 1) as p from tr) u
       join vocab v on v.token = u.tok group by conv_id, turn),
oi as (select conv_id, turn, list(v.id order by u.p) as ids from (select conv_id, turn, unnest(ot) as tok, generate_subscripts(ot, 1) as p from tr) u
       join vocab v on v.token = u.tok group by conv_id, turn)
select tr.conv_id, tr.turn,
  array_to_string(list_resize(coalesce(ii.ids, []::bigint[]), {IN_CAP}, {PAD}), ',') as input_ids,
  array_to_string(list_resize(list_transform(coalesce(ii.ids, []::bigint[]), lambda x: 1), {IN_CAP}, 0), ',') as attention_mask,
  array_to_string(list_transform(list_resize(coalesce(oi.ids, []::bigint[]), {OUT_CAP}, {PAD}), lambda x: case when x = {PAD} then -100 else x end), ',') as labels
from tr left join ii using (conv_id, turn) left join oi using (conv_id, turn)""")
def q_pad_mask(spark, d):
    v = _vocab(spark, d)
    t = FX.v_turns(spark, d).select("conv_id", "turn", _toks().alias("toks"))
    t = t.select("conv_id", "turn", TR.truncate_left(F.col("toks"), IN_CAP).alias("it"),
                 TR.truncate_right(F.col("toks"), OUT_CAP).alias("ot"))
    ii = TR.token_ids(t, ["conv_id", "turn"], "it", v, "iids")
    oi = TR.token_ids(t, ["conv_id", "turn"], "ot", v, "oids")
    j = ii.join(oi, ["conv_id", "turn"])
    return j.select(
        "conv_id", "turn",
        F.array_join(TR.pad(F.col("iids"), IN_CAP, PAD), ",").alias("input_ids"),
        F.array_join(TR.attention_mask(F.col("iids"), IN_CAP), ",").alias("attention_mask"),
        F.array_join(TR.mask_labels(TR.pad(F.col("oids"), OUT_CAP, PAD), PAD), ",").alias("labels"))


# ----------------------------------------------------------------------------- text helpers

def strict_responder(text: str) -> str:
    """Rule model that refuses texts with an e-mail address; used by ``error_text``."""
    if "@" in text:
        raise ValueError("address in text")
    return text


@register("error_text", f"""
select conv_id, turn,
  case when contains(utterance, '@') then 'Error: ValueError: address in text' else regexp_replace(utterance, {q(f'^{TX.SPACE}+|{TX.SPACE}+$')}, '', 'g') end as prediction,
  case when contains(utterance, '@') then 'ValueError: address in text' end as error
from v_turns where speaker = 'SYSTEM'""")
def q_error_text(spark, d):
    from .jobs import call_with_errors, guarded, run_predictor
    t = FX.v_turns(spark, d).filter(F.col("speaker") == "SYSTEM").select("conv_id", "turn", "utterance")
    called = run_predictor(t, "utterance", "raw", guarded(strict_responder, max_attempts=2, retry_on=(TimeoutError,)))
    return call_with_errors(called, "raw", "error").select("conv_id", "turn", "prediction", "error")


@register("rg_turns", """
select conv_id, turn, 'Re: ' || coalesce(last_user, '') as prediction from (
  select conv_id, turn, speaker,
    last(case when speaker = 'USER' then utterance end ignore nulls) over (partition by conv_id order by turn rows between 5 preceding and 1 preceding) as last_user
  from v_turns) x
where speaker = 'SYSTEM' and conv_id in (select conv_id from v_splits where split = 'test')""")
def q_rg_turns(spark, d):
    from .jobs import echo_predictor, rg_turns
    turns = FX.v_turns(spark, d)
    test = FX.v_splits(spark, d).filter(F.col("split") == "test").select("conv_id")
    return rg_turns(turns.join(test, "conv_id", "left_semi"), echo_predictor, S.LLM_CONTEXT_TURNS)


@register("transcript_csv", f"""
with l as (select conv_id, string_agg(case speaker when 'USER' then {q(S.TRANSCRIPT_USER)} else {q(S.TRANSCRIPT_SYSTEM)} end || ',' || utterance || chr(13) || chr(10), '' order by turn) as lines
           from v_turns group by conv_id)
select l.conv_id, l.lines || coalesce(s.q1 || ',' || s.q2 || ',' || s.q3 || ',', '') as csv_text
from l left join v_session_scores s on s.session_id = l.conv_id""")
def q_transcript_csv(spark, d):
    from ..operators.sessions import transcript_csv
    scores = FX.v_session_scores(spark, d).select(F.col("session_id").alias("conv_id"),
                                                  F.array("q1", "q2", "q3").alias("scores"))
    return transcript_csv(FX.v_turns(spark, d), scores, "conv_id")


@register("punct_norm", """
select conv_id, turn,
  regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(utterance,
    '，', '、'), ',', '、'), '．', '。'), '\\.', '。'), '!', '！'), '\\?', '？') as text
from v_turns where speaker = 'SYSTEM'""")
def q_punct_norm(spark, d):
    t = FX.v_turns(spark, d).filter(F.col("speaker") == "SYSTEM")
    return t.select("conv_id", "turn", TX.punct_normalize(F.col("utterance")).alias("text"))


# ----------------------------------------------------------------------------- BLEU

def _bleu_sql(view: str) -> str:
    grams = """(select conv_id, turn, n, array_to_string(list_slice({t}, i + 1, i + n), ' ') as gram
       from (select conv_id, turn, {t}, n, unnest(range(0, greatest(len({t}) - n + 1, 0))) as i
             from p, (select unnest([1, 2, 3, 4]) as n) ns) x)"""
    return f"""
with p as (select conv_id, turn, list_filter(regexp_split_to_array(hyp_text, '\\s+'), lambda t: t <> '') as h,
                  list_filter(regexp_split_to_array(ref_text, '\\s+'), lambda t: t <> '') as r from {view}),
hg as (select conv_id, turn, n, gram, count(*) as hc from {grams.format(t='h')} g group by all),
rg as (select conv_id, turn, n, gram, count(*) as rc from {grams.format(t='r')} g group by all),
st as (select conv_id, turn, n, cast(sum(least(hc, coalesce(rc, 0))) as bigint) as matches, cast(sum(hc) as bigint) as total
       from hg left join rg using (conv_id, turn, n, gram) group by conv_id, turn, n),
w as (select conv_id, turn, {", ".join(f"sum(case when n = {n} then matches end) as m{n}, sum(case when n = {n} then total end) as t{n}" for n in range(1, 5))}
      from st group by conv_id, turn),
l as (select p.conv_id, p.turn, len(p.h) as hl, len(p.r) as rl, {", ".join(f"coalesce(m{n}, 0) as m{n}, coalesce(t{n}, 0) as t{n}" for n in range(1, 5))}
      from p left join w using (conv_id, turn)),
z as (select *, {", ".join(f"{' + '.join(f'cast(m{k} = 0 as int)' for k in range(1, n + 1))} as z{n}" for n in range(1, 5))},
             {' + '.join(f'cast(t{n} > 0 as int)' for n in range(1, 5))} as eff from l),
sc as (select conv_id, turn, case when m1 + m2 + m3 + m4 = 0 then 0.0 else
         (case when hl >= rl then 1.0 when hl > 0 then exp(1 - rl / hl) else 0.0 end) *
         exp(({' + '.join(f"case when t{n} > 0 then ln(case when m{n} = 0 then 100.0 / (pow(2, z{n}) * t{n}) else 100.0 * m{n} / t{n} end) else 0.0 end" for n in range(1, 5))}) / eff) end as bleu
       from z)
"""


def _bleu_pairs(df):
    return df.select("conv_id", "turn", TX.ws_tokens(F.col("hyp_text")).alias("h"), TX.ws_tokens(F.col("ref_text")).alias("r"))


@register("bleu_ngrams", _bleu_sql("v_bleu_pairs") + "select conv_id, turn, n, matches, total from st")
def q_bleu_ngrams(spark, d):
    p = _bleu_pairs(FX.v_bleu_pairs(spark, d))
    return BL.ngram_stats(p, ["conv_id", "turn"], F.col("h"), F.col("r")).select(
        "conv_id", "turn", "n", "matches", "total")


@register("response_bleu", _bleu_sql("v_bleu_pairs") + "select conv_id, turn, round(bleu, 6) as bleu from sc")
def q_response_bleu(spark, d):
    p = _bleu_pairs(FX.v_bleu_pairs(spark, d))
    s = BL.sentence_bleu(p, ["conv_id", "turn"], F.col("h"), F.col("r"))
    return s.select("conv_id", "turn", F.round("bleu", 6).alias("bleu"))


@register("scores_rg", _bleu_sql("v_bleu_next") + "select conv_id, turn, round(bleu, 6) as bleu from sc")
def q_scores_rg(spark, d):
    p = _bleu_pairs(FX.v_bleu_next(spark, d))
    s = BL.sentence_bleu(p, ["conv_id", "turn"], F.col("h"), F.col("r"))
    return s.select("conv_id", "turn", F.round("bleu", 6).alias("bleu"))


@register("corpus_bleu", _bleu_sql("v_bleu_next") + """,
tot as (select """ + ", ".join(f"cast(sum(m{n}) as bigint) as m{n}, cast(sum(t{n}) as bigint) as t{n}" for n in range(1, 5)) + """,
               sum(hl) as hl, sum(rl) as rl from l),
zz as (select *, """ + ", ".join(f"{' + '.join(f'cast(m{k} = 0 as int)' for k in range(1, n + 1))} as z{n}" for n in range(1, 5)) + """ from tot)
select round(case when m1 + m2 + m3 + m4 = 0 then 0.0 else
  (case when hl >= rl then 1.0 when hl > 0 then exp(1 - rl / hl) else 0.0 end) *
  exp((""" + " + ".join(f"case when t{n} > 0 then ln(case when m{n} = 0 then 100.0 / (pow(2, z{n}) * t{n}) else 100.0 * m{n} / t{n} end) else {BL.LOG_ZERO} end" for n in range(1, 5)) + """) / 4) end, 6) as bleu,
  """ + ", ".join(f"m{n}, t{n}" for n in range(1, 5)) + """
from zz""")
def q_corpus_bleu(spark, d):
    p = _bleu_pairs(FX.v_bleu_next(spark, d))
    out = BL.corpus_bleu(p, ["conv_id", "turn"], F.col("h"), F.col("r"))
    return out.select(F.round("bleu", 6).alias("bleu"), *[c for c in out.columns if c != "bleu"])
