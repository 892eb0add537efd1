"""Registered queries: entity database, DB results, candidate sampling, bookings, e2e turns.

Fixture: parts are entities (domain = part type, city = brand, genre = the two words of the
name, size); orders are constraint requests and booking requests.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import booking as BK
from ..operators import entities as EN
from ..operators.ordering import ordinal
from ..sources import fixtures as FX
from .registry import register

ATTR_ORDER = ["city", "name", "genre", "size"]
LIST_SLOTS = ["genre"]
CONSTRAINTS = ["genre", "size"]
NEGATIVE = {"genre": "neg_genre"}
# The fixture has no weather domain; 'economy' plays its part so the rule is exercised.
DROP_DOMAIN = "economy"
CAP = 3
SEED = "0"
INACTIVE_SQL = "('', 'dontcare', '非対応', '無し', '不明')"


def _entities(spark, d, reused: bool = True):
    """Entity table (a dimension table). When a query reuses it (size checks and several
    broadcasts) it is built once and materialized; a single use reads it directly."""
    from ..operators.joins import materialize
    e = EN.entities_wide(FX.v_entity_slots(spark, d), ATTR_ORDER, LIST_SLOTS)
    return materialize(e) if reused else e


SET_COLS = ["domain", "city", *CONSTRAINTS, *NEGATIVE.values()]


def _cands(spark, d, ents, requests=None):
    """Requests with their set, the sets, and the candidates per set (written bitmaps: several steps read them)."""
    requests = FX.v_requests(spark, d) if requests is None else requests
    req, sets = EN.constraint_sets(requests, SET_COLS)
    return req, sets, EN.candidate_bitmaps(sets, ents, CONSTRAINTS, NEGATIVE)


def _stats(req, cands):
    return EN.candidate_stats(req, cands, oracle_name="name_hint", drop_multi_domain=DROP_DOMAIN)


def _db(spark, d, ents=None, with_sample=False, requests=None):
    ents = ents if ents is not None else _entities(spark, d)
    req, _, cands = _cands(spark, d, ents, requests)
    stats = _stats(req, cands)
    sample = EN.rank_candidates(cands, stats, cap=CAP, seed=SEED) if with_sample else None
    return EN.db_result(req, stats, ents, sample=sample)


def _inactive(c: str) -> str:
    return f"({c} is null or {c} in {INACTIVE_SQL})"


_ENT = f"""
with ent as (select entity_pos, domain, max(case when slot = 'city' then value end) as city,
                    max(case when slot = 'name' then value end) as name, max(case when slot = 'size' then value end) as size
             from v_entity_slots group by entity_pos, domain),
genres as (select entity_pos, value from v_entity_slots where slot = 'genre'),
req as (select * from v_requests),
pos as (select r.request_id, e.entity_pos from req r join ent e on e.domain = r.domain
        where ({_inactive('r.city')} or e.city = r.city)
          and ({_inactive('r.genre')} or exists (select 1 from genres g where g.entity_pos = e.entity_pos and g.value = r.genre))
          and ({_inactive('r.size')} or e.size = r.size)),
neg as (select r.request_id, e.entity_pos from req r join ent e on e.domain = r.domain
        where r.neg_genre is not null and ({_inactive('r.city')} or e.city = r.city)
          and ({_inactive('r.neg_genre')} or exists (select 1 from genres g where g.entity_pos = e.entity_pos and g.value = r.neg_genre))),
kept as (select request_id, entity_pos from pos except select request_id, entity_pos from neg),
cands as (select k.request_id, k.entity_pos, e.name from kept k join ent e using (entity_pos)),
agg as (select request_id, count(*) as total, arg_min(c.name, c.entity_pos) as first, bool_or(c.name = r.name_hint) as has_oracle
        from cands c join req r using (request_id) group by request_id),
j as (select r.request_id, r.domain, r.city, r.name_hint,
             cast(case when r.domain = '{DROP_DOMAIN}' and coalesce(a.total, 0) > 1 then 0 else coalesce(a.total, 0) end as bigint) as total,
             a.first, a.has_oracle from req r left join agg a using (request_id)),
act as (select *, case when total > 0 then (case when has_oracle then name_hint else first end) end as active_name from j),
lk as (select a.request_id, e.entity_pos, row_number() over (partition by a.request_id order by ({_inactive('a.city')} or e.city = a.city) desc, e.entity_pos) as rn
       from act a join ent e on e.domain = a.domain and e.name = a.active_name where a.active_name is not null),
db as (select a.request_id, a.domain, a.city, a.total, a.active_name, l.entity_pos as active_pos
       from act a left join lk l on l.request_id = a.request_id and l.rn = 1),
c as (select k.request_id, k.entity_pos, k.name, a.active_name from cands k join act a using (request_id) where a.total > 0),
sel as (select request_id, min(entity_pos) as sel_pos from c where name = active_name group by request_id),
c2 as (select c.*, sel.sel_pos from c left join sel using (request_id)),
numbered as (select c2.*, count(*) over (partition by request_id) as n,
    row_number() over (partition by request_id order by entity_pos) - 1 as nr from c2),
sizes as (select distinct request_id, n from numbered),
spots as (select request_id, n, t, ('0x' || substr(md5('{SEED}:' || cast(request_id as string) || ':' || cast(t as string)), 1, 15))::bigint as h
  from sizes, unnest(range(case when n <= {4 * CAP} then n else {2 * CAP + 10} end)) as u(t)),
drawn as (select request_id, v, min(o) as o from (
    select request_id, case when n <= {4 * CAP} then t else h % n end as v,
      case when n <= {4 * CAP} then row_number() over (partition by request_id order by h, t) else t + 1 end as o from spots
    union all select request_id, unnest(range({CAP})), 1000 + unnest(range({CAP})) from sizes where n > {4 * CAP}) x
  group by request_id, v),
firsts as (select * from drawn qualify row_number() over (partition by request_id order by o) <= {CAP}),
sampled as (select request_id, cast(0 as bigint) as rank, entity_pos, name from c2 where entity_pos = sel_pos
  union all
  select request_id, rank, entity_pos, name from (
    select m.request_id, entity_pos, name, cast(row_number() over (partition by m.request_id order by f.o) as bigint) as rank
    from numbered m join firsts f on f.request_id = m.request_id and f.v = m.nr where entity_pos <> sel_pos) x
  where rank < {CAP}),
rec as (select e.entity_pos, 'city ' || e.city || ', name ' || e.name || ', genre [' ||
          (select string_agg(g.value, ', ' order by g.value) from genres g where g.entity_pos = e.entity_pos) ||
          '], size ' || e.size as body, e.domain from ent e)
"""


@register("src_entities", _ENT + """
select e.entity_pos, e.domain, e.city, e.name, (select string_agg(g.value, ', ' order by g.value) from genres g where g.entity_pos = e.entity_pos) as genres, e.size
from ent e""")
def q_src_entities(spark, d):
    e = _entities(spark, d, reused=False)
    a = F.col("attrs")
    return e.select("entity_pos", "domain", F.get(a["city"], 0).alias("city"), F.get(a["name"], 0).alias("name"),
                    F.array_join(a["genre"], ", ").alias("genres"), F.get(a["size"], 0).alias("size"))


@register("src_domains", "select domain, row_number() over (order by domain) - 1 as pos from (select distinct domain from v_entity_slots) d")
def q_src_domains(spark, d):
    doms = FX.v_entity_slots(spark, d).select("domain").distinct()
    return ordinal(doms, ["domain"], [], "pos").select("domain", "pos")


@register("flatten_value", _ENT + """
select e.entity_pos, '[' || e.city || ', ' || e.name || ', [' ||
  (select string_agg(g.value, ', ' order by g.value) from genres g where g.entity_pos = e.entity_pos) || '], ' || e.size || ']' as value_text
from ent e""")
def q_flatten_value(spark, d):
    return _entities(spark, d, reused=False).select("entity_pos", EN.flatten_record(F.col("record")).alias("value_text"))


@register("active_constraints", f"""
select request_id, slot, value from (
  select request_id, 'city' as slot, city as value from v_requests
  union all select request_id, 'genre', genre from v_requests
  union all select request_id, 'size', size from v_requests) x
where not {_inactive('value')}""")
def q_active_constraints(spark, d):
    r = FX.v_requests(spark, d)
    long = r.select("request_id", F.inline(F.array(*[
        F.struct(F.lit(s).alias("slot"), F.col(s).alias("value")) for s in ["city", *CONSTRAINTS]])))
    return long.filter(EN.is_active(F.col("value")))


@register("entity_query", _ENT + """
select r.domain, r.city, r.genre, r.size, p.entity_pos, count(*) as n_requests
from pos p join req r using (request_id) group by all""")
def q_entity_query(spark, d):
    _, sets = EN.constraint_sets(FX.v_requests(spark, d), ["domain", "city", *CONSTRAINTS])
    hits = EN.entity_query(sets, _entities(spark, d), CONSTRAINTS, key="set_id")
    return hits.join(sets, "set_id").select("domain", "city", *CONSTRAINTS, "entity_pos", "n_requests")


@register("entity_query_long", _ENT + """
select r.domain, r.city, r.genre, r.size, p.entity_pos, count(*) as n_requests
from pos p join req r using (request_id) group by all""")
def q_entity_query_long(spark, d):
    _, sets = EN.constraint_sets(FX.v_requests(spark, d), ["domain", "city", *CONSTRAINTS])
    hits = EN.entity_query_long(sets, FX.v_entity_slots(spark, d), CONSTRAINTS, key="set_id")
    return hits.join(sets, "set_id").select("domain", "city", *CONSTRAINTS, "entity_pos", "n_requests")


@register("entity_names", _ENT + """
select r.request_id, count(c.entity_pos) as n_names, coalesce(string_agg(c.name, ', ' order by c.entity_pos), '') as names
from req r left join cands c using (request_id) group by r.request_id""")
def q_entity_names(spark, d):
    req, sets, cands = _cands(spark, d, _entities(spark, d))
    return EN.request_names_text(req, cands, sets)


@register("entity_info", _ENT + f"""
, cand as (select r.request_id, e.entity_pos, ({_inactive('r.city')} or e.city = r.city) as in_city
          from req r join ent e on e.domain = r.domain and ({_inactive('r.name_hint')} or e.name = r.name_hint)),
best as (select request_id, entity_pos, in_city, row_number() over (partition by request_id order by in_city desc, entity_pos) as rn from cand)
select r.request_id, b.entity_pos, b.in_city from req r left join best b on b.request_id = r.request_id and b.rn = 1""")
def q_entity_info(spark, d):
    r = FX.v_requests(spark, d).select("request_id", "domain", F.col("name_hint").alias("name"), "city")
    return EN.entity_info(r, _entities(spark, d))


@register("db_result", _ENT + "select request_id, domain, city, total, active_name, active_pos from db")
def q_db_result(spark, d):
    return _db(spark, d)


@register("candidate_sample", _ENT + "select request_id, rank, entity_pos, name from sampled")
def q_candidate_sample(spark, d):
    req, _, cands = _cands(spark, d, _entities(spark, d))
    return EN.rank_candidates(cands, _stats(req, cands), cap=CAP, seed=SEED)


@register("db_result_text", _ENT + """
, cl as (select request_id, string_agg(name, ', ' order by rank) as names from sampled group by request_id)
select db.request_id, 'total ' || cast(db.total as string) || ', candidate [' || coalesce(cl.names, '') || '], selected [' ||
  coalesce(rec.body || ', domain ' || rec.domain, '') || ']' as db_text
from db left join cl using (request_id) left join rec on rec.entity_pos = db.active_pos""")
def q_db_result_text(spark, d):
    ents = _entities(spark, d)
    return EN.db_result_text(_db(spark, d, ents, with_sample=True), ents)


# ----------------------------------------------------------------------------- bookings

def _bookings(spark, d):
    b = FX.v_bookings(spark, d)
    req = F.create_map(F.lit("people"), F.col("people"), F.lit("day"), F.col("day"))
    goal = F.map_filter(F.create_map(F.lit("people"), F.col("goal_people"), F.lit("day"), F.col("goal_day")),
                        lambda k, v: v.isNotNull())
    return BK.book_result(b, req, goal, oracle_ref="oracle_ref")


_BOOK = """
with b as (select *, case when people is not null and people <> '' and day is not null and day <> '' then
                       (goal_people is not null and goal_day is not null and goal_people = people and goal_day = day) end as success
           from v_bookings),
br as (select request_id, domain, success,
         cast(case when success then coalesce(nullif(oracle_ref, 0),
              ('0x' || substr(md5(cast(request_id as string) || '|' || domain), 1, 8))::bigint % 99999 + 1) end as bigint) as ref
       from b)
"""


@register("book_result", _BOOK + "select request_id, domain, success, ref from br")
def q_book_result(spark, d):
    return _bookings(spark, d).select("request_id", "domain", "success", "ref")


@register("book_ref", _BOOK + "select request_id, ref from br where success")
def q_book_ref(spark, d):
    return _bookings(spark, d).filter(F.col("success")).select("request_id", "ref")


@register("book_result_text", _BOOK + """
select request_id, coalesce(concat_ws(', ', case when success then domain || ' success True' end,
  case when ref is not null and ref <> 0 then domain || ' ref ' || cast(ref as string) end), '') as book_text from br""")
def q_book_result_text(spark, d):
    b = _bookings(spark, d)
    return b.select("request_id", BK.book_result_text(F.col("domain"), F.col("success"), F.col("ref")).alias("book_text"))


@register("domain_book_text", _BOOK + """
select request_id, domain, coalesce(concat_ws(', ', case when success then 'success True' end,
  case when ref is not null and ref <> 0 then 'ref ' || cast(ref as string) end), '') as book_text from br""")
def q_domain_book_text(spark, d):
    b = _bookings(spark, d)
    return b.select("request_id", "domain",
                    BK.book_result_text(F.col("domain"), F.col("success"), F.col("ref"), with_domain=False).alias("book_text"))


# ----------------------------------------------------------------------------- end-to-end turns

@register("e2e_turns", _ENT + ", " + _BOOK.strip()[5:] + """
select db.request_id, 'total ' || cast(db.total as string) || coalesce(', recommend ' || db.active_name, '') ||
  case when br.success then ', booked ' || cast(br.ref as string) when not br.success then ', booking failed' else '' end as response
from db join br using (request_id)""")
def q_e2e_turns(spark, d):
    from .jobs import e2e_rule_response
    return e2e_rule_response(_db(spark, d), _bookings(spark, d))
