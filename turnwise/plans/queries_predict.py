"""Registered queries: the predict job over all turns, and packed documents.

The two model functions are rules on the length of their input text, so that DuckDB can follow them; the
job calls them as it would any model: one text at a time, with errors kept per row.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import schemas as S
from ..sources import fixtures as FX
from ..sources.sinks import pack_dialogues
from .queries_entities import CAP, DROP_DOMAIN, _ENT, _entities
from .queries_text import EMPTY_DB_TEXT, _ctx_sql, q
from .registry import register

DOMAINS = ["promo", "small", "economy"]
BELIEF = {d: ["city", "genre", "size"] for d in DOMAINS}
BOOK = {"promo": ["people", "day"], "small": ["people", "day"]}
ALLOWED = {"genre": ["old", "bolt"]}
K = S.LLM_CONTEXT_TURNS


def state_model(text: str) -> str:
    n = len(text)
    if n % 11 == 0:
        raise ValueError("no state")
    d = DOMAINS[n % 3]
    items = [f"{d} city Brand#{n % 25 + 1}", "broken", f"{d} genre {'wrong' if n % 7 == 0 else 'bolt' if n % 2 else 'old'}"]
    items += [f"{d} size {n % 50 + 1}"] if n % 5 == 0 else []
    items += [f"{d} people {n % 3 + 1}", f"{d} day {n % 2}"] if n % 4 else []
    return ", ".join(items)


def response_model(text: str) -> str:
    if len(text) % 13 == 0:
        raise ValueError("no answer")
    return f" answer {len(text)} "


def _goals(spark, d):
    ids = FX.v_turns(spark, d).select("conv_id").distinct()
    booking = F.create_map(F.lit("people"), (F.col("conv_id") % 3 + 1).cast("string"),
                           F.lit("day"), (F.col("conv_id") % 2).cast("string"))
    return ids.select("conv_id", F.explode(F.array(*[F.lit(x) for x in BOOK])).alias("domain"), booking.alias("booking"))


def _args(spark, d):
    return (FX.v_turns(spark, d), state_model, response_model, BELIEF, BOOK, _entities(spark, d), _goals(spark, d), ALLOWED)


def _sql() -> str:
    set_by = {"city": "'Brand#' || cast(n % 25 + 1 as string)",
              "genre": "case when n % 7 <> 0 then case when n % 2 = 1 then 'bolt' else 'old' end end",
              "size": "case when n % 5 = 0 then cast(n % 50 + 1 as string) end",
              "people": "case when n % 4 <> 0 then cast(n % 3 + 1 as string) end",
              "day": "case when n % 4 <> 0 then cast(n % 2 as string) end"}
    slots = [(d, s) for part in (BELIEF, BOOK) for d, ss in part.items() for s in ss]
    memory = ",\n  ".join(f"last_value(case when d = '{d}' then {set_by[s]} end ignore nulls) over w as {d}__{s}" for d, s in slots)
    of = lambda s, part: "case " + " ".join(f"when active = '{d}' then {d}__{s}" for d, ss in part.items() if s in ss) + " end"
    text = ", ".join(f"'{d} {s} ' || {d}__{s}" for d, ss in BELIEF.items() for s in ss)

    def nested(part):
        inner = lambda d, ss: "concat_ws(',', " + ", ".join(f"""'"{s}":"' || {d}__{s} || '"'""" for s in ss) + ")"
        return "concat_ws(',', " + ", ".join(
            f"""case when {inner(d, ss)} <> '' then '"{d}":{{' || {inner(d, ss)} || '}}' end""" for d, ss in part.items()) + ")"
    states = f"""
said as ({_ctx_sql(K)}),
heard as (select conv_id, turn, ctx, length(ctx) as n,
  case when length(ctx) % 11 <> 0 then case length(ctx) % 3 when 0 then 'promo' when 1 then 'small' else 'economy' end end as d
  from said where speaker = 'SYSTEM'),
known as (select conv_id, turn, ctx, conv_id || ':' || turn as request_id, last_value(d ignore nulls) over w as active,
  {memory}
  from heard window w as (partition by conv_id order by turn rows between unbounded preceding and current row)),
req as (select request_id, active as domain, {of('city', BELIEF)} as city, {of('genre', BELIEF)} as genre, {of('size', BELIEF)} as size,
  cast(null as varchar) as neg_genre, cast(null as varchar) as name_hint from known where active is not null)"""
    return _ENT.replace("req as (select * from v_requests)", states.strip()) + f""",
cl as (select request_id, string_agg(name, ', ' order by rank) as names from sampled group by request_id),
dbt as (select db.request_id, 'total ' || cast(db.total as string) || ', candidate [' || coalesce(cl.names, '') || '], selected [' ||
    coalesce(rec.body || ', domain ' || rec.domain, '') || ']' as db_text
  from db left join cl using (request_id) left join rec on rec.entity_pos = db.active_pos),
booked as (select *, {of('people', BOOK)} = cast(conv_id % 3 + 1 as string) and {of('day', BOOK)} = cast(conv_id % 2 as string) as done from known),
texts as (select k.*, concat_ws(', ', {text}) as state_text, coalesce(dbt.db_text, '{EMPTY_DB_TEXT}') as db_text,
    case when done then active || ' success True, ' || active || ' ref ' ||
      cast(('0x' || substr(md5(k.request_id || '|' || active), 1, 8))::bigint % {S.BOOK_REF_MODULUS} + 1 as string) else '' end as book_text
  from booked k left join dbt using (request_id)),
asked as (select *, length(concat_ws(' ', ctx, {q(S.STATE_PREFIX)}, state_text, {q(S.DB_RESULT_PREFIX)}, db_text,
    {q(S.BOOK_RESULT_PREFIX)}, book_text)) as m from texts),
predicted as (select conv_id, turn, state_text, db_text, book_text,
    case when m % 13 = 0 then 'Error: ValueError: no answer' else 'answer ' || cast(m as string) end as response,
    {nested(BELIEF)} as belief, {nested(BOOK)} as book from asked)
"""


_SQL = _sql()


@register("predict_turns", _SQL + "select conv_id, turn, state_text, db_text, book_text, response from predicted")
def q_predict_turns(spark, d):
    """Context, state model, memory, database, booking and response model of every system turn."""
    from .predict import predict_turns
    t = predict_turns(*_args(spark, d), k=K, cap=CAP, drop_multi_domain=DROP_DOMAIN)
    return t.select("conv_id", "turn", "state_text", "db_text", "book_text", "response")


@register("predict_dialogues", _SQL + """
select conv_id, count(*) as n_turns, '[' || string_agg('{"turn_id":' || turn || ',"speaker":"SYSTEM","utterance":"' || response ||
  '","dialogue_state":{"belief_state":{' || belief || '},"book_state":{' || book || '}}}', ',' order by turn) || ']' as turns
from predicted group by conv_id""")
def q_predict_dialogues(spark, d):
    """The same predictions, packed into one document per dialogue."""
    from .predict import predict_dialogues
    p = predict_dialogues(*_args(spark, d), k=K, cap=CAP, drop_multi_domain=DROP_DOMAIN)
    return p.select("conv_id", F.size("turns").cast("bigint").alias("n_turns"), F.to_json("turns").alias("turns"))


@register("pack_dialogues", """
select conv_id, count(*) as n_turns, count(*) filter (where speaker = 'USER') as n_user,
  count(*) filter (where speaker = 'SYSTEM') as n_system, cast(sum(length(utterance)) as bigint) as n_chars,
  min(turn) as first_turn, max(turn) as last_turn,
  cast(to_json(list({'turn_id': turn, 'speaker': speaker, 'utterance': utterance} order by turn)) as varchar) as turns
from v_turns group by conv_id""")
def q_pack_dialogues(spark, d):
    """Every dialogue as one document of its turns in order, and its counters."""
    p = pack_dialogues(FX.v_turns(spark, d).withColumnRenamed("turn", "turn_id"), "conv_id")
    by = lambda who: F.size(F.filter("turns", lambda x: x["speaker"] == who)).cast("bigint")
    chars = F.aggregate("turns", F.lit(0).cast("bigint"), lambda n, x: n + F.coalesce(F.length(x["utterance"]), F.lit(0)))
    return p.select("conv_id", F.size("turns").cast("bigint").alias("n_turns"), by("USER").alias("n_user"),
                    by("SYSTEM").alias("n_system"), chars.alias("n_chars"), F.col("turns")[0]["turn_id"].alias("first_turn"),
                    F.try_element_at("turns", F.lit(-1))["turn_id"].alias("last_turn"), F.to_json("turns").alias("turns"))
