"""Registered queries: state carry-forward, rendering, parsing, allowed values, two-step tracking.

Fixture: every event is a slot update of its user's dialogue; the slot is the event type and
the value is ``$.k`` of the JSON payload (empty payload = no update).
"""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import state as ST
from ..schemas import slot_catalogue
from ..sources import fixtures as FX
from .registry import register

# Fixture catalogue: one domain, slots in rendering order.
EV_DOMAIN = "events"
EV_SLOTS = ["view", "click", "signup", "purchase", "error"]
# Parse catalogue: purchases carry a restricted 'size' slot, sign-ups are a booking slot,
# errors are not in the catalogue (rejected as unknown).
PARSE_BELIEF = {EV_DOMAIN: ["view", "click", "size"]}
PARSE_BOOK = {EV_DOMAIN: ["signup"]}


def _value():
    return F.when(F.col("raw") == "", F.lit(None).cast("string")).otherwise(F.get_json_object("raw", "$.k"))


_VALUE_SQL = "case when raw = '' then null else json_extract_string(raw, '$.k') end"


def _updates_wide(spark, d):
    u = FX.v_updates(spark, d).withColumn("value", _value())
    return u.select("user_id", "event_id", "ts",
                    *[F.when(F.col("slot") == s, F.col("value")).alias(s) for s in EV_SLOTS])


def _carried(spark, d):
    return ST.carry_forward(_updates_wide(spark, d), ["user_id"], ["ts", "event_id"], EV_SLOTS,
                            chunk=F.to_date("ts"))


_CARRY_SQL = f"""
with u as (select user_id, event_id, ts, slot, nullif({_VALUE_SQL}, '') as value from v_updates),
c as (select user_id, event_id, {", ".join(
    f"last(case when slot = '{s}' then value end ignore nulls) over (partition by user_id order by ts, event_id rows between unbounded preceding and current row) as {s}"
    for s in EV_SLOTS)} from u)
"""


@register("state_carry", _CARRY_SQL + f"select user_id, event_id, {', '.join(EV_SLOTS)} from c")
def q_state_carry(spark, d):
    return _carried(spark, d).select("user_id", "event_id", *EV_SLOTS)


def _render_sql(with_domain: bool) -> str:
    parts = ", ".join(
        f"case when {s} is not null and {s} <> '' then '{(EV_DOMAIN + ' ') if with_domain else ''}{s} ' || {s} end"
        for s in EV_SLOTS)
    return f"coalesce(concat_ws(', ', {parts}), '')"


@register("state_text", _CARRY_SQL + f"select user_id, event_id, {_render_sql(True)} as state from c")
def q_state_text(spark, d):
    c = _carried(spark, d)
    return c.select("user_id", "event_id", ST.render_wide([(EV_DOMAIN, s, s) for s in EV_SLOTS]).alias("state"))


@register("domain_state_text", _CARRY_SQL + f"select user_id, event_id, {_render_sql(False)} as state from c")
def q_domain_state_text(spark, d):
    c = _carried(spark, d)
    return c.select("user_id", "event_id",
                    ST.render_wide([(EV_DOMAIN, s, s) for s in EV_SLOTS], with_domain=False).alias("state"))


# ----------------------------------------------------------------------------- parsing

def _state_strings(spark, d, with_domain: bool):
    u = FX.v_updates(spark, d).withColumn("value", _value())
    s = F.when(F.col("slot") == "purchase", F.lit("size")).otherwise(F.col("slot"))
    head = F.concat(F.lit(EV_DOMAIN + " "), s) if with_domain else s
    item = F.when(F.col("value").isNull(), head).otherwise(F.concat(head, F.lit(" "), F.col("value")))
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(-3, 0)
    return u.select("user_id", "event_id", F.array_join(F.collect_list(item).over(w), ", ").alias("state_str"))


def _strings_sql(with_domain: bool) -> str:
    head = f"'{EV_DOMAIN} ' || s" if with_domain else "s"
    return f"""
with b as (select user_id, event_id, ts, case slot when 'purchase' then 'size' else slot end as s, {_VALUE_SQL} as v from v_updates),
strs as (select user_id, event_id, string_split(array_to_string(list(case when v is null then {head} else {head} || ' ' || v end)
           over (partition by user_id order by ts, event_id rows between 3 preceding and current row), ', '), ', ') as parts from b),
it as (select user_id, event_id, unnest(parts) as item, generate_subscripts(parts, 1) - 1 as item_pos from strs),
"""


_PARSE3 = _strings_sql(True) + """
p as (select user_id, event_id, cast(item_pos as bigint) as item_pos, item, regexp_matches(item, '^([^ ]*) ([^ ]*) (.*)$', 's') as ok,
        regexp_extract(item, '^([^ ]*) ([^ ]*) (.*)$', 1, 's') as domain, regexp_extract(item, '^([^ ]*) ([^ ]*) (.*)$', 2, 's') as slot,
        regexp_extract(item, '^([^ ]*) ([^ ]*) (.*)$', 3, 's') as value from it),
"""
_PARSE2 = _strings_sql(False) + f"""
p as (select user_id, event_id, cast(item_pos as bigint) as item_pos, item, regexp_matches(item, '^([^ ]*) (.*)$', 's') as ok,
        '{EV_DOMAIN}' as domain, regexp_extract(item, '^([^ ]*) (.*)$', 1, 's') as slot,
        regexp_extract(item, '^([^ ]*) (.*)$', 2, 's') as value from it),
"""
_CLASSIFY = f"""
cat as (select * from (values ('{EV_DOMAIN}', 'view', 'belief'), ('{EV_DOMAIN}', 'click', 'belief'), ('{EV_DOMAIN}', 'size', 'belief'),
                               ('{EV_DOMAIN}', 'signup', 'book')) t(domain, slot, kind)),
cl as (select p.*, case when not ok then 'malformed'
                        when p.slot in (select slot from v_informable) and not exists (select 1 from v_informable i where i.slot = p.slot and i.value = p.value) then 'value_not_allowed'
                        when cat.kind is null then 'unknown_slot' end as reason, cat.kind
       from p left join cat on cat.domain = p.domain and cat.slot = p.slot)
"""


def _parse(spark, d, n_parts: int):
    strings = _state_strings(spark, d, with_domain=(n_parts == 3))
    cat = slot_catalogue(spark, PARSE_BELIEF, PARSE_BOOK)
    dom = F.lit(EV_DOMAIN) if n_parts == 2 else None
    return ST.parse_state(strings, ["user_id", "event_id"], "state_str", cat, FX.v_informable(spark, d), n_parts, dom)


_PARSED_SQL = """
select user_id, event_id, domain, arg_max(kind, item_pos) as kind, slot, arg_max(value, item_pos) as value
from cl where reason is null group by user_id, event_id, domain, slot"""


@register("parse_state", _PARSE3 + _CLASSIFY + _PARSED_SQL)
def q_parse_state(spark, d):
    return _parse(spark, d, 3)[0].select("user_id", "event_id", "domain", "kind", "slot", "value")


@register("parse_rejects", _PARSE3 + _CLASSIFY + "select user_id, event_id, item_pos, item, reason from cl where reason is not null")
def q_parse_rejects(spark, d):
    return _parse(spark, d, 3)[1].select("user_id", "event_id", "item_pos", "item", "reason")


@register("parse_domain_state", _PARSE2 + _CLASSIFY + _PARSED_SQL)
def q_parse_domain_state(spark, d):
    return _parse(spark, d, 2)[0].select("user_id", "event_id", "domain", "kind", "slot", "value")


# ----------------------------------------------------------------------------- allowed values

@register("src_informable", "select slot, value from v_informable")
def q_src_informable(spark, d):
    return FX.v_informable(spark, d)


@register("informable_filter", """
select e.entity_pos, e.slot, e.value from v_entity_slots e
where e.slot not in (select slot from v_informable)
   or exists (select 1 from v_informable i where i.slot = e.slot and i.value = e.value)""")
def q_informable_filter(spark, d):
    return ST.informable_filter(FX.v_entity_slots(spark, d), FX.v_informable(spark, d)).select("entity_pos", "slot", "value")


# ----------------------------------------------------------------------------- two-step tracking

# Rule "model": the general step names the event type as active domain, the domain step
# reports slot k of that domain.
TS_DOMAINS = EV_SLOTS


@register("two_step_state", f"""
with u as (select user_id, event_id, ts, slot as active, nullif({_VALUE_SQL}, '') as value from v_updates),
c as (select user_id, event_id,
  last(active ignore nulls) over w as general_active_domain,
  {", ".join(f"last(case when active = '{s}' then value end ignore nulls) over w as k_{s}" for s in TS_DOMAINS)}
  from u window w as (partition by user_id order by ts, event_id rows between unbounded preceding and current row))
select user_id, event_id, coalesce(concat_ws(', ', 'general active_domain ' || general_active_domain,
  {", ".join(f"'{s} k ' || k_{s}" for s in TS_DOMAINS)}), '') as state from c""")
def q_two_step_state(spark, d):
    from .jobs import two_step_state
    u = FX.v_updates(spark, d).withColumn("value", _value())
    general_pred = F.concat(F.lit("active_domain "), F.col("slot"))
    domain_pred = F.when(F.col("value").isNull(), F.lit("")).otherwise(F.concat(F.lit("k "), F.col("value")))
    preds = u.select("user_id", "event_id", "ts", general_pred.alias("general_text"), domain_pred.alias("domain_text"))
    return two_step_state(preds, ["user_id"], ["ts", "event_id"], {d_: ["k"] for d_ in TS_DOMAINS},
                          chunk=F.to_date("ts")).select("user_id", "event_id", "state")
