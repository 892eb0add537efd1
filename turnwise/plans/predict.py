"""Predict job: from dialogue turns and two model functions to packed predicted dialogues.

Per system turn: context -> state model -> parse -> memory of belief and booking slots -> database
result of the active domain -> booking against the dialogue's goal -> response model. Models are
per-text functions; they run through ``jobs.guarded`` (retries, errors kept per row) on Arrow
batches. The predicted states are written once, so that later steps do not call the state model
again; everything between the two model calls is column expressions and joins.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import schemas as S
from ..operators import booking as BK
from ..operators import context as ctx
from ..operators import entities as EN
from ..operators import state as ST
from ..operators.joins import materialize
from ..sources.sinks import pack_dialogues
from .jobs import call_with_errors, guarded, run_predictor


def _ask(df: DataFrame, input_col: str, output_col: str, model) -> DataFrame:
    return run_predictor(df, input_col, output_col, guarded(model))


def _items(text: Column) -> Column:
    """"domain slot value, ..." as an array of items; malformed items have no value."""
    parts = F.transform(F.split(F.coalesce(text, F.lit("")), ", "), lambda x: F.split(x, " ", 3))
    return F.transform(parts, lambda p: F.struct(F.get(p, 0).alias("domain"), F.get(p, 1).alias("slot"),
                                                 F.get(p, 2).alias("value")))


def _accepted(items: Column, pairs: Sequence[tuple[str, str]], allowed: dict[str, Sequence[str]]) -> Column:
    """Items of catalogue slots whose value is set and, for a restricted slot, on its list."""
    known = F.array(*[F.lit(f"{d} {s}") for d, s in pairs])

    def keep(it):
        ok = F.array_contains(known, F.concat_ws(" ", it["domain"], it["slot"])) & (F.coalesce(it["value"], F.lit("")) != "")
        for slot, values in allowed.items():
            ok = ok & ((it["slot"] != slot) | it["value"].isin(*values))
        return ok
    return F.filter(items, keep)


def track_states(turns: DataFrame, state_model: Callable[[str], str], belief: dict[str, Sequence[str]],
                 book: dict[str, Sequence[str]], allowed: dict[str, Sequence[str]] | None = None,
                 k: int = S.LLM_CONTEXT_TURNS, key: str = "conv_id", order: str = "turn", ask=None) -> DataFrame:
    """Per system turn: ``context_text``, the predicted items merged into the dialogue's memory as one
    column ``<domain>__<slot>`` per slot, ``active_domain`` (of the last accepted item, else the one
    before) and the model's ``error``."""
    pairs = [(d, s) for part in (belief, book) for d, ss in part.items() for s in ss]
    t = ctx.context_strings(turns, k, [key], order).select(key, order, "context_text")
    t = (ask or _ask)(t, "context_text", "_raw", state_model)
    t = t.withColumn("_got", _accepted(_items(F.col("_raw")), pairs, allowed or {}))
    last = lambda d, s: F.try_element_at(  # noqa: E731  a repeated slot: the last item wins
        F.filter("_got", lambda x: (x["domain"] == d) & (x["slot"] == s)), F.lit(-1))["value"]
    names = {f"{d}__{s}": last(d, s) for d, s in pairs}
    t = t.select(key, order, "context_text", "error", F.try_element_at("_got", F.lit(-1))["domain"].alias("active_domain"),
                 *[c.alias(n) for n, c in names.items()])
    return ST.carry_forward(t, [key], [order], ["active_domain", *names])


def _of_active(slots: dict[str, Sequence[str]], slot: str) -> Column:
    """The value of ``slot`` in the active domain."""
    out = F.lit(None).cast("string")
    for d, ss in slots.items():
        if slot in ss:
            out = F.when(F.col("active_domain") == d, F.col(f"{d}__{slot}")).otherwise(out)
    return out


def _nested(slots: dict[str, Sequence[str]]) -> Column:
    """``map<domain, map<slot, value>>`` of the set slots; a domain without any is left out."""
    by_domain = F.create_map(*[x for d, ss in slots.items() for x in (
        F.lit(d), F.map_filter(F.create_map(*[y for s in ss for y in (F.lit(s), F.col(f"{d}__{s}"))]),
                               lambda k, v: F.coalesce(v, F.lit("")) != ""))])
    return F.map_filter(by_domain, lambda k, v: F.size(v) > 0)


def look_up(states: DataFrame, entities: DataFrame, goals: DataFrame, belief: dict[str, Sequence[str]],
            book: dict[str, Sequence[str]], key: str = "conv_id", cap: int = S.MAX_CANDIDATE_ENTITIES,
            city: str = "city", drop_multi_domain: str = S.MULTI_CANDIDATE_DROP_DOMAIN) -> DataFrame:
    """Per turn ``request_id``, ``db_text`` and ``book_text``: the database result of the active domain's
    belief slots, and the booking of its booking slots against the goal ``(key, domain, booking map)``."""
    slots = list(dict.fromkeys(s for ss in belief.values() for s in ss if s != city))
    req = states.select("request_id", key, F.col("active_domain").alias("domain"),
                        _of_active(belief, city).alias(city), *[_of_active(belief, s).alias(s) for s in slots])
    req, sets = EN.constraint_sets(req.filter("domain is not null"), ["domain", city, *slots])
    constraints = [s for s in slots if s != "name"]
    cands = EN.candidate_bitmaps(sets, entities, constraints, city=city)
    stats = EN.candidate_stats(req, cands, oracle_name="name" if "name" in slots else None,
                               drop_multi_domain=drop_multi_domain)
    sample = EN.rank_candidates(cands, stats, cap=cap)
    db = EN.db_result(req, stats, entities, city=city, sample=sample)
    db_text = EN.db_result_text(db, entities)
    # goal lookup by (dialogue, domain): no goal for the domain is an empty booking
    empty = F.create_map().cast("map<string,string>")
    request = empty
    for d, ss in book.items():
        request = F.when(F.col("domain") == d, F.create_map(*[x for s in ss for x in (F.lit(s), F.col(f"{d}__{s}"))])
                         ).otherwise(request)
    b = states.withColumn("domain", F.col("active_domain")).join(
        goals.select(key, "domain", F.col("booking").alias("_goal")), [key, "domain"], "left")
    b = b.withColumn("_request", request).withColumn("_goal", F.coalesce("_goal", empty)).filter(F.size("_request") > 0)
    booked = BK.book_result(b, F.col("_request"), F.col("_goal"))
    booked = booked.select("request_id", BK.book_result_text(F.col("domain"), F.col("success"), F.col("ref")).alias("book_text"))
    return states.select("request_id").join(db_text, "request_id", "left").join(booked, "request_id", "left").select(
        "request_id", F.coalesce("db_text", F.lit("total 0, candidate [], selected []")).alias("db_text"),
        F.coalesce("book_text", F.lit("")).alias("book_text"))


def predict_turns(turns: DataFrame, state_model: Callable[[str], str], response_model: Callable[[str], str],
                  belief: dict[str, Sequence[str]], book: dict[str, Sequence[str]], entities: DataFrame,
                  goals: DataFrame, allowed: dict[str, Sequence[str]] | None = None,
                  k: int = S.LLM_CONTEXT_TURNS, key: str = "conv_id", order: str = "turn",
                  cap: int = S.MAX_CANDIDATE_ENTITIES,
                  drop_multi_domain: str = S.MULTI_CANDIDATE_DROP_DOMAIN, ask=None) -> DataFrame:
    """One row per system turn: ``key, order, state_text, db_text, book_text, response, belief_state, book_state``.

    ``ask(df, input_col, output_col, model)`` runs a model and adds its output and ``error, attempts``; the default calls
    it batch by batch, ``jobs.ask_all`` with a store asks each prompt once and keeps calls in flight."""
    states = track_states(turns, state_model, belief, book, allowed, k, key, order, ask)
    states = materialize(states.withColumn("request_id", F.concat_ws(":", F.col(key), F.col(order))))
    found = look_up(states, entities, goals, belief, book, key, cap, drop_multi_domain=drop_multi_domain)
    text = ST.render_wide([(d, s, f"{d}__{s}") for d, ss in belief.items() for s in ss])
    t = states.withColumn("state_text", text).join(found, "request_id")
    t = t.withColumn("_in", F.concat_ws(" ", "context_text", F.lit(S.STATE_PREFIX), "state_text",
                                        F.lit(S.DB_RESULT_PREFIX), "db_text", F.lit(S.BOOK_RESULT_PREFIX), "book_text"))
    t = t.select(key, order, "state_text", "db_text", "book_text", _nested(belief).alias("belief_state"),
                 _nested(book).alias("book_state"), "_in")
    out = call_with_errors((ask or _ask)(t, "_in", "_raw", response_model), "_raw", "error", name="response")
    return out.drop("_in", "_raw", "error", "attempts")


def predict_dialogues(turns: DataFrame, *args, key: str = "conv_id", order: str = "turn", **kw) -> DataFrame:
    """The predictions packed into one document per dialogue, its turns in order."""
    t = predict_turns(turns, *args, key=key, order=order, **kw)
    doc = t.select(F.col(key), F.col(order).alias("turn_id"), F.lit("SYSTEM").alias("speaker"),
                   F.col("response").alias("utterance"), F.struct("belief_state", "book_state").alias("dialogue_state"))
    # maps cannot be sorted; turn ids are unique in a dialogue, so the states are looked up by turn id
    text = doc.withColumn("dialogue_state", F.to_json("dialogue_state"))
    kind = doc.schema["dialogue_state"].dataType.simpleString()
    packed = pack_dialogues(text, key, "turn_id")
    return packed.withColumn("turns", F.transform("turns", lambda x: F.struct(
        x["turn_id"].alias("turn_id"), x["speaker"].alias("speaker"), x["utterance"].alias("utterance"),
        F.from_json(x["dialogue_state"], kind).alias("dialogue_state"))))
