"""Dialogue states: render to text, parse from text, carry slot values forward.

Long form of a state: ``(keys..., domain, slot, value)``; the slot catalogue
``(domain, domain_pos, kind, slot, slot_pos)`` gives rendering order and slot kinds. The
catalogue and allowed-value lists are dimension tables, joined with a size-checked broadcast.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import falsy_to_null  # noqa: F401  (re-exported)
from .joins import broadcast_if_small

SEP = ", "


def items_to_state_text(items: DataFrame, keys: Sequence[str], item: str = "item", sep: str = SEP) -> DataFrame:
    """Join the distinct items of each key in sorted order (a state holds at most one item per
    catalogue slot, so the per-key set is bounded)."""
    return items.groupBy(*keys).agg(F.array_join(F.array_sort(F.collect_set(item)), sep).alias("state"))


def render_state(long: DataFrame, keys: Sequence[str], catalogue: DataFrame, with_domain: bool = True,
                 name: str = "state", sep: str = SEP) -> DataFrame:
    """``state_dict2str``: "domain slot value" items, falsy values skipped.

    Only domains of the belief state are rendered: book slots of a domain without any belief row (of whatever
    value) are dropped. Order: domains of the catalogue, then others by name; in a domain its belief slots, then
    its book slots, each in catalogue order and then by name. ``kind`` ('belief', 'book') is a column of
    ``long`` or comes from the catalogue; slots outside the catalogue count as belief slots. Keys without any
    rendered item do not appear (their text is '')."""
    if "kind" not in long.columns:
        kinds, _ = broadcast_if_small(catalogue.groupBy("domain", "slot").agg(F.min("kind").alias("kind")))
        long = long.join(kinds, ["domain", "slot"], "left")  # 'belief' sorts first where a slot has both kinds
    cat, _ = broadcast_if_small(catalogue.groupBy("domain", "slot").agg(F.min("slot_pos").alias("slot_pos")))
    domains, _ = broadcast_if_small(catalogue.groupBy("domain").agg(F.min("domain_pos").alias("domain_pos")))
    j = long.join(cat, ["domain", "slot"], "left").join(domains, "domain", "left")
    value = falsy_to_null(F.col("value"))
    text = (F.concat_ws(" ", "domain", "slot", value) if with_domain else F.concat_ws(" ", "slot", value))
    item = F.struct(F.col("domain_pos").isNull().alias("other"), "domain_pos", "domain",
                    (F.coalesce("kind", F.lit("belief")) != "belief").alias("book"),
                    F.col("slot_pos").isNull().alias("unlisted"), "slot_pos", "slot",
                    F.when(value.isNotNull(), text).alias("t"))
    # one state: bounded by its slots
    g = j.groupBy(*keys).agg(F.array_sort(F.collect_set(item)).alias("_items"))
    believed = F.transform(F.filter("_items", lambda x: ~x["book"]), lambda x: x["domain"])
    shown = F.filter("_items", lambda x: x["t"].isNotNull() & F.array_contains(believed, x["domain"]))
    return (g.select(*keys, F.transform(shown, lambda x: x["t"]).alias("_texts")).filter(F.size("_texts") > 0)
            .select(*keys, F.array_join("_texts", sep).alias(name)))


def render_wide(slots: Sequence[tuple[str, str, str]], with_domain: bool = True, sep: str = SEP) -> Column:
    """Render a wide state (one column per slot) without any shuffle.

    ``slots`` is ``[(domain, slot, column), ...]`` in rendering order.
    """
    parts = []
    for domain, slot, col in slots:
        head = f"{domain} {slot} " if with_domain else f"{slot} "
        v = falsy_to_null(F.col(col))
        parts.append(F.when(v.isNotNull(), F.concat(F.lit(head), v)))
    return F.coalesce(F.concat_ws(sep, *parts), F.lit(""))


def _split_limit(text: Column, sep: str, limit: int) -> Column:
    return F.split(text, re.escape(sep), limit)


def parse_items(df: DataFrame, keys: Sequence[str], text: str, n_parts: int = 3, domain: Column | None = None,
                sep: str = SEP) -> DataFrame:
    """Explode a state string into ``(keys, item_pos, item, domain, slot, value, ok)``.

    ``n_parts = 3`` parses "domain slot value" (``split(" ", 2)``), ``n_parts = 2`` parses
    "slot value" with ``domain`` given per row. ``ok`` is false for malformed items.
    """
    ex = df.select(*keys, *([domain.alias("_dom")] if domain is not None else []),
                   F.posexplode(F.split(F.col(text), re.escape(sep))).alias("item_pos", "item"))
    parts = _split_limit(F.col("item"), " ", n_parts)
    ok = F.size(parts) == n_parts
    if n_parts == 3:
        dom, slot, value = F.get(parts, 0), F.get(parts, 1), F.get(parts, 2)
    else:
        dom, slot, value = F.col("_dom"), F.get(parts, 0), F.get(parts, 1)
    out = ex.select(*keys, F.col("item_pos").cast("bigint").alias("item_pos"), "item",
                    F.when(ok, dom).alias("domain"), F.when(ok, slot).alias("slot"),
                    F.when(ok, value).alias("value"), ok.alias("ok"))
    return out


def classify_items(items: DataFrame, catalogue: DataFrame, informable: DataFrame) -> DataFrame:
    """Add ``kind`` (belief preferred over book) and ``reason``: NULL when accepted, else
    'malformed', 'value_not_allowed' (slot has an allowed list without this value; checked by
    slot name only, before the slot lookup) or 'unknown_slot'."""
    inf = informable.select("slot", "value").distinct()
    inf_slots, _ = broadcast_if_small(inf.select("slot").distinct().withColumn("_restricted", F.lit(True)))
    inf_vals, _ = broadcast_if_small(inf.withColumn("_allowed", F.lit(True)))
    cat, _ = broadcast_if_small(catalogue.groupBy("domain", "slot")
                                .agg(F.min(F.when(F.col("kind") == "belief", 0).otherwise(1)).alias("_k")))
    j = (items.join(inf_slots, "slot", "left").join(inf_vals, ["slot", "value"], "left")
              .join(cat, ["domain", "slot"], "left"))
    reason = (F.when(~F.col("ok"), "malformed")
               .when(F.col("_restricted") & F.col("_allowed").isNull(), "value_not_allowed")
               .when(F.col("_k").isNull(), "unknown_slot"))
    kind = F.when(F.col("_k") == 0, "belief").when(F.col("_k") == 1, "book")
    return (j.withColumn("reason", reason).withColumn("kind", F.when(reason.isNull(), kind))
             .drop("_restricted", "_allowed", "_k"))


def parse_state(df: DataFrame, keys: Sequence[str], text: str, catalogue: DataFrame, informable: DataFrame,
                n_parts: int = 3, domain: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """``state_str2dict`` / ``domain_state_str2dict`` as a job.

    Returns (parsed, rejects): parsed has one row per set slot ``(keys, domain, kind, slot,
    value)`` where the last item of a repeated slot wins; rejects lists
    ``(keys, item_pos, item, reason)``. For the one-domain form an empty text yields no items.
    """
    src = df
    if n_parts == 2:
        src = df.filter(F.coalesce(F.col(text), F.lit("")) != "")
    items = classify_items(parse_items(src, keys, text, n_parts, domain), catalogue, informable)
    good = items.filter(F.col("reason").isNull())
    parsed = (good.groupBy(*keys, "domain", "slot")
              .agg(F.max_by(F.struct("kind", "value"), F.col("item_pos")).alias("_v"))
              .select(*keys, "domain", "_v.kind", "slot", "_v.value"))
    rejects = items.filter(F.col("reason").isNotNull()).select(*keys, "item_pos", "item", "reason")
    return parsed, rejects


def carry_forward(df: DataFrame, keys: Sequence[str], order: Sequence[str], value_cols: Sequence[str],
                  chunk: Column | None = None) -> DataFrame:
    """Carry every column of ``value_cols`` forward: a row keeps the last non-falsy value seen
    so far in its key (memory resets per key).

    Without ``chunk`` this is one window per key. With ``chunk`` (a column that grows with the
    order, e.g. a day bucket) it is a two-level scan that keeps a hot key from landing in one
    task: (1) a window per (key, chunk), (2) carry-in per chunk from a window over the chunk
    summaries (the last row of each chunk; small), (3) the carry-in completes each row (only
    the small side of that join moves).
    """
    vals = {c: falsy_to_null(F.col(c)) for c in value_cols}
    base = df.select(*df.columns, *[vals[c].alias(f"_u_{c}") for c in value_cols])
    if chunk is None:
        w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
        out = base
        for c in value_cols:
            out = out.withColumn(c, F.last(f"_u_{c}", ignorenulls=True).over(w))
        return out.drop(*[f"_u_{c}" for c in value_cols])

    base = base.withColumn("_chunk", chunk)
    # (1) carry inside each (key, chunk): one window, one shuffle of the rows
    w = Window.partitionBy(*keys, "_chunk").orderBy(*order)
    run = w.rowsBetween(Window.unboundedPreceding, 0)
    local = base.select(*base.columns, *[F.last(f"_u_{c}", ignorenulls=True).over(run).alias(f"_l_{c}") for c in value_cols],
                        (F.row_number().over(w) == F.count(F.lit(1)).over(
                            Window.partitionBy(*keys, "_chunk"))).alias("_last"))
    # (2) chunk summaries = the last row of each chunk (small); carry-in from earlier chunks
    wc = Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    carry = local.filter("_last").select(
        *keys, "_chunk", *[F.last(f"_l_{c}", ignorenulls=True).over(wc).alias(f"_in_{c}") for c in value_cols])
    # (3) complete each row with the carry-in of its chunk (only the small side moves)
    out = local.join(carry, [*keys, "_chunk"], "left")
    for c in value_cols:
        out = out.withColumn(c, F.coalesce(F.col(f"_l_{c}"), F.col(f"_in_{c}")))
    out = out.drop("_last", *[f"_l_{c}" for c in value_cols])
    return out.drop("_chunk", *[f"_u_{c}" for c in value_cols], *[f"_in_{c}" for c in value_cols])


def informable_filter(df: DataFrame, informable: DataFrame, slot: str = "slot", value: str = "value") -> DataFrame:
    """Keep rows whose slot has no allowed-value list, or whose value is on the list."""
    inf = informable.select(F.col("slot").alias(slot), F.col("value").alias(value)).distinct()
    slots, _ = broadcast_if_small(inf.select(slot).distinct())
    vals, _ = broadcast_if_small(inf)
    free = df.join(slots, slot, "left_anti")
    listed = df.join(vals, [slot, value], "left_semi")
    return free.unionByName(listed)
