"""Dialogue-shaped views over the driver tables.

Each view exists twice: as a DataFrame builder (Spark side of a registered query) and as SQL
text that DuckDB runs for the oracle. Both read whole tables; row subsets come only from the
meaning of a view (for example "hypothesis items that were dropped"), never from sampling.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.joins import sized
from ..operators.ordering import ordinal

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _split_of(conv_id: F.Column) -> F.Column:
    return (F.when(conv_id % 10 == 0, "test").when(conv_id % 10 == 1, "dev").otherwise("train"))


# --------------------------------------------------------------------------- DataFrame side

def v_turns(spark, d):
    c = table(spark, d, "conversations")
    return (c.filter(F.col("role").isin("user", "assistant"))
             .select("conv_id", "turn",
                     F.when(F.col("role") == "user", "USER").otherwise("SYSTEM").alias("speaker"),
                     F.col("text").alias("utterance")))


def v_splits(spark, d):
    ids = (table(spark, d, "conversations").select("conv_id").distinct()
           .withColumn("split", _split_of(F.col("conv_id"))))
    out = ordinal(ids, [F.md5(F.col("conv_id").cast("string"))], ["split"], "split_pos")
    return out.select("split", "split_pos", "conv_id")


def v_entity_slots(spark, d):
    p = table(spark, d, "part").select(
        F.col("p_partkey").alias("entity_pos"), F.lower("p_type").alias("domain"), "p_brand", "p_name", "p_size")
    words = F.split(F.col("p_name"), " ")
    slots = F.array(
        F.struct(F.lit("city").alias("slot"), F.col("p_brand").alias("value")),
        F.struct(F.lit("name").alias("slot"), F.col("p_name").alias("value")),
        F.struct(F.lit("genre").alias("slot"), F.coalesce(F.get(words, 0), F.lit("")).alias("value")),
        F.struct(F.lit("genre").alias("slot"), F.coalesce(F.get(words, 1), F.lit("")).alias("value")),
        F.struct(F.lit("size").alias("slot"), F.col("p_size").cast("string").alias("value")),
    )
    return (p.select("entity_pos", "domain", F.inline(slots)))


def v_requests(spark, d):
    o = table(spark, d, "orders")
    p = table(spark, d, "part").select(F.col("p_partkey"), F.col("p_name").alias("name_hint"))
    ok, ck = F.col("o_orderkey"), F.col("o_custkey")
    r = o.select(
        ok.alias("request_id"),
        F.when(ck % 3 == 0, "promo").when(ck % 3 == 1, "small").otherwise("economy").alias("domain"),
        F.when(ck % 7 == 0, F.lit(None).cast("string"))
         .otherwise(F.concat(F.lit("Brand#"), (ck % 25 + 1).cast("string"))).alias("city"),
        F.when(ok % 4 == 0, "dontcare").when(ok % 4 == 1, F.lit(None).cast("string"))
         .when(ok % 4 == 2, "bolt").otherwise("old").alias("genre"),
        F.when(ok % 5 == 0, (ck % 50 + 1).cast("string")).otherwise("").alias("size"),
        F.when(ok % 6 == 0, "small").when(ok % 6 == 1, "dontcare").otherwise(F.lit(None).cast("string")).alias("neg_genre"),
        ck.alias("o_custkey"),
    )
    return r.join(p, r.o_custkey == p.p_partkey, "left").drop("o_custkey", "p_partkey")


def v_state_items(spark, d):
    li = table(spark, d, "lineitem")
    head = F.concat(F.lower("l_returnflag"), F.lit(" "), F.lower("l_linestatus"), F.lit(" "))
    ref = li.select(F.lit("ref").alias("side"), F.col("l_orderkey").alias("turn_key"),
                    F.concat(head, F.col("l_quantity").cast("int").cast("string")).alias("item"))
    hyp = (li.filter((F.col("l_partkey") % 11 != 0) & (F.col("l_orderkey") % 97 != 0))
             .select(F.lit("hyp").alias("side"), F.col("l_orderkey").alias("turn_key"),
                     F.concat(head, F.when(F.col("l_suppkey") % 7 == 0, F.lit("0"))
                              .otherwise(F.col("l_quantity").cast("int").cast("string"))).alias("item")))
    return sized(ref.unionByName(hyp), "turn_key", "item").distinct()


def v_state_turns(spark, d):
    """Turns that have a gold state, and turns that were predicted; a state may have no items."""
    li = sized(table(spark, d, "lineitem").select(F.col("l_orderkey").alias("turn_key")), "turn_key").distinct()
    return li.withColumn("side", F.explode(F.when(F.col("turn_key") % 97 != 0, F.array(F.lit("ref"), F.lit("hyp")))
                                           .otherwise(F.array(F.lit("ref"))))).select("side", "turn_key")


def v_updates(spark, d):
    e = table(spark, d, "events")
    return e.select("user_id", "event_id", "ts", F.col("event_type").alias("slot"),
                    F.when(F.col("event_id") % 4 == 0, F.lit("")).otherwise(F.col("props")).alias("raw"))


def v_bookings(spark, d):
    o = table(spark, d, "orders")
    ok = F.col("o_orderkey")
    null = F.lit(None).cast("string")
    return o.select(
        ok.alias("request_id"),
        F.when(ok % 3 == 0, "taxi").when(ok % 3 == 1, "hotel").otherwise("restaurant").alias("domain"),
        F.when(ok % 5 == 0, null).otherwise(F.col("o_orderpriority")).alias("people"),
        F.col("o_orderstatus").alias("day"),
        F.when(ok % 7 == 0, null).when(ok % 4 == 0, F.lit("3-MEDIUM")).otherwise(F.col("o_orderpriority")).alias("goal_people"),
        F.when(ok % 7 == 0, null).otherwise(F.col("o_orderstatus")).alias("goal_day"),
        F.when(ok % 2 == 0, F.col("o_custkey")).otherwise(F.lit(None).cast("bigint")).alias("oracle_ref"),
    )


def v_goal_domains(spark, d):
    doc = table(spark, d, "documents")
    return (doc.select(F.col("doc_id").alias("pos"), F.concat(F.lit("lang:"), "lang").alias("domain"))
            .unionByName(doc.select(F.col("doc_id").alias("pos"), F.concat(F.lit("source:"), "source").alias("domain"))))


def v_conv_goals(spark, d):
    """Goal domains of each conversation: one of three, plus 'weather' for every fourth."""
    ids = table(spark, d, "conversations").select("conv_id").distinct()
    c = F.col("conv_id")
    main = ids.select("conv_id", F.when(c % 3 == 0, "restaurant").when(c % 3 == 1, "hotel")
                      .otherwise("taxi").alias("domain"))
    extra = ids.filter(c % 4 == 0).select("conv_id", F.lit("weather").alias("domain"))
    return main.unionByName(extra)


def v_progress(spark, d):
    ids = table(spark, d, "conversations").select("conv_id").distinct()
    c = F.col("conv_id")
    old = ids.filter(c % 5 != 0).select("conv_id", (c * 10).alias("line_no"), F.lit("old").alias("payload"))
    new = ids.filter(c % 10 == 3).select("conv_id", (c * 10 + 5).alias("line_no"), F.lit("new").alias("payload"))
    return old.unionByName(new)


def v_session_inputs(spark, d):
    """User turns as session inputs; the answer is the assistant turn that follows at once, else '...'."""
    c = table(spark, d, "conversations")
    answers = c.filter(F.col("role") == "assistant").select("conv_id", (F.col("turn") - 1).alias("turn"),
                                                            F.col("text").alias("answer"))
    c = c.filter(F.col("role") == "user").join(answers, ["conv_id", "turn"], "left")
    sid, turn = F.col("conv_id"), F.col("turn")
    return c.select(
        sid.alias("session_id"), turn.alias("seq"),
        F.when(sid % 2 == 0, "model_a").otherwise("model_b").alias("model_name"),
        F.when((turn == 4) & (sid % 3 == 0), F.lit(" Success "))
         .when((turn == 4) & (sid % 3 == 1), F.lit("FAIL")).otherwise(F.col("text")).alias("input_text"),
        F.coalesce("answer", F.lit("...")).alias("answer"))


def v_session_scores(spark, d):
    c = table(spark, d, "conversations").filter(F.col("conv_id") % 4 != 0).select("conv_id").distinct()
    sid = F.col("conv_id")
    return c.select(sid.alias("session_id"), (sid % 5 + 1).cast("string").alias("q1"),
                    (sid % 4 + 1).cast("string").alias("q2"), (sid % 3 + 3).cast("string").alias("q3"))


def v_informable(spark, d):
    p = table(spark, d, "part").filter(F.col("p_size") <= 25)
    # not a literal: a constant slot would turn the equi-joins on it into filters over a nested loop
    slot = F.when(F.col("p_size") <= 25, F.lit("size"))
    return p.select(slot.alias("slot"), F.col("p_size").cast("string").alias("value")).distinct()


def _ws_tokens(c: F.Column) -> F.Column:
    return F.filter(F.split(c, r"\s+"), lambda t: t != "")


def v_bleu_pairs(spark, d):
    """Assistant turn vs. the same turn with every token at 0-based index % 7 == 3 removed."""
    t = v_turns(spark, d).filter(F.col("speaker") == "SYSTEM")
    toks = _ws_tokens(F.col("utterance"))
    return t.select("conv_id", "turn", F.col("utterance").alias("ref_text"),
                    F.array_join(F.filter(toks, lambda x, i: i % 7 != 3), " ").alias("hyp_text"))


def v_bleu_next(spark, d):
    """Assistant turn (reference) vs. the next assistant turn of its dialogue (hypothesis)."""
    t = v_turns(spark, d).filter(F.col("speaker") == "SYSTEM")
    w = Window.partitionBy("conv_id").orderBy("turn")
    return (t.withColumn("hyp_text", F.lead("utterance").over(w))
             .filter(F.col("hyp_text").isNotNull())
             .select("conv_id", "turn", F.col("utterance").alias("ref_text"), "hyp_text"))


BUILDERS: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "v_turns": v_turns, "v_splits": v_splits, "v_entity_slots": v_entity_slots, "v_requests": v_requests,
    "v_state_items": v_state_items, "v_state_turns": v_state_turns, "v_updates": v_updates, "v_bookings": v_bookings,
    "v_goal_domains": v_goal_domains, "v_conv_goals": v_conv_goals, "v_progress": v_progress,
    "v_session_inputs": v_session_inputs, "v_session_scores": v_session_scores,
    "v_informable": v_informable, "v_bleu_pairs": v_bleu_pairs, "v_bleu_next": v_bleu_next,
}

# --------------------------------------------------------------------------- DuckDB side

SQL: dict[str, str] = {
    "v_turns": """select conv_id, turn, case role when 'user' then 'USER' else 'SYSTEM' end as speaker, text as utterance
from conversations where role in ('user', 'assistant')""",
    "v_splits": """select case when conv_id % 10 = 0 then 'test' when conv_id % 10 = 1 then 'dev' else 'train' end as split,
  row_number() over (partition by case when conv_id % 10 = 0 then 'test' when conv_id % 10 = 1 then 'dev' else 'train' end
                     order by md5(cast(conv_id as string))) - 1 as split_pos,
  conv_id
from (select distinct conv_id from conversations) d""",
    "v_entity_slots": """select p_partkey as entity_pos, lower(p_type) as domain, 'city' as slot, p_brand as value from part
union all select p_partkey, lower(p_type), 'name', p_name from part
union all select p_partkey, lower(p_type), 'genre', split_part(p_name, ' ', 1) from part
union all select p_partkey, lower(p_type), 'genre', split_part(p_name, ' ', 2) from part
union all select p_partkey, lower(p_type), 'size', cast(p_size as string) from part""",
    "v_requests": """select o_orderkey as request_id,
  case o_custkey % 3 when 0 then 'promo' when 1 then 'small' else 'economy' end as domain,
  case when o_custkey % 7 = 0 then null else 'Brand#' || cast(o_custkey % 25 + 1 as string) end as city,
  case o_orderkey % 4 when 0 then 'dontcare' when 1 then null when 2 then 'bolt' else 'old' end as genre,
  case when o_orderkey % 5 = 0 then cast(o_custkey % 50 + 1 as string) else '' end as size,
  case o_orderkey % 6 when 0 then 'small' when 1 then 'dontcare' else null end as neg_genre,
  p_name as name_hint
from orders left join part on p_partkey = o_custkey""",
    "v_state_items": """select distinct 'ref' as side, l_orderkey as turn_key, lower(l_returnflag) || ' ' || lower(l_linestatus) || ' ' || cast(cast(l_quantity as int) as string) as item from lineitem
union all
select distinct 'hyp', l_orderkey, lower(l_returnflag) || ' ' || lower(l_linestatus) || ' ' || case when l_suppkey % 7 = 0 then '0' else cast(cast(l_quantity as int) as string) end from lineitem where l_partkey % 11 <> 0 and l_orderkey % 97 <> 0""",
    "v_state_turns": """select distinct 'ref' as side, l_orderkey as turn_key from lineitem
union all
select distinct 'hyp', l_orderkey from lineitem where l_orderkey % 97 <> 0""",
    "v_updates": """select user_id, event_id, ts, event_type as slot, case when event_id % 4 = 0 then '' else props end as raw from events""",
    "v_bookings": """select o_orderkey as request_id, case o_orderkey % 3 when 0 then 'taxi' when 1 then 'hotel' else 'restaurant' end as domain,
  case when o_orderkey % 5 = 0 then null else o_orderpriority end as people,
  o_orderstatus as day,
  case when o_orderkey % 7 = 0 then null when o_orderkey % 4 = 0 then '3-MEDIUM' else o_orderpriority end as goal_people,
  case when o_orderkey % 7 = 0 then null else o_orderstatus end as goal_day,
  case when o_orderkey % 2 = 0 then o_custkey else null end as oracle_ref
from orders""",
    "v_goal_domains": """select doc_id as pos, 'lang:' || lang as domain from documents
union all select doc_id, 'source:' || source from documents""",
    "v_conv_goals": """select conv_id, case conv_id % 3 when 0 then 'restaurant' when 1 then 'hotel' else 'taxi' end as domain
from (select distinct conv_id from conversations) a
union all select conv_id, 'weather' from (select distinct conv_id from conversations) b where conv_id % 4 = 0""",
    "v_progress": """select conv_id, conv_id * 10 as line_no, 'old' as payload from (select distinct conv_id from conversations) a where conv_id % 5 <> 0
union all
select conv_id, conv_id * 10 + 5, 'new' from (select distinct conv_id from conversations) b where conv_id % 10 = 3""",
    "v_session_inputs": """select u.conv_id as session_id, u.turn as seq, case when u.conv_id % 2 = 0 then 'model_a' else 'model_b' end as model_name,
  case when u.turn = 4 and u.conv_id % 3 = 0 then ' Success ' when u.turn = 4 and u.conv_id % 3 = 1 then 'FAIL' else u.text end as input_text,
  coalesce(a.text, '...') as answer
from conversations u left join conversations a on a.conv_id = u.conv_id and a.turn = u.turn + 1 and a.role = 'assistant'
where u.role = 'user'""",
    "v_session_scores": """select distinct conv_id as session_id, cast(conv_id % 5 + 1 as string) as q1, cast(conv_id % 4 + 1 as string) as q2, cast(conv_id % 3 + 3 as string) as q3
from conversations where conv_id % 4 <> 0""",
    "v_informable": """select distinct 'size' as slot, cast(p_size as string) as value from part where p_size <= 25""",
    "v_bleu_pairs": """select conv_id, turn, utterance as ref_text,
  array_to_string(list_filter(list_filter(regexp_split_to_array(utterance, '\\s+'), lambda t: t <> ''), lambda x, i: (i - 1) % 7 <> 3), ' ') as hyp_text
from v_turns where speaker = 'SYSTEM'""",
    "v_bleu_next": """select conv_id, turn, ref_text, hyp_text from (
  select conv_id, turn, utterance as ref_text, lead(utterance) over (partition by conv_id order by turn) as hyp_text
  from v_turns where speaker = 'SYSTEM') x where hyp_text is not null""",
}

_ORDER = list(SQL)


def with_views(sql: str) -> str:
    """Prefix ``sql`` with the CTEs of every fixture view it (transitively) references."""
    import re

    needed: set[str] = set()
    todo = set(re.findall(r"\bv_[a-z_]+\b", sql))
    while todo:
        v = todo.pop()
        if v in SQL and v not in needed:
            needed.add(v)
            todo |= set(re.findall(r"\bv_[a-z_]+\b", SQL[v]))
    if not needed:
        return sql
    ctes = ",\n".join(f"{v} as (\n{SQL[v]}\n)" for v in _ORDER if v in needed)
    body = sql.lstrip()
    if body.lower().startswith("with "):
        return f"with {ctes},\n{body[5:]}"
    return f"with {ctes}\n{body}"
