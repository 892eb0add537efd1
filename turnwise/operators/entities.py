"""Entity database queries as batch joins: constraint query (wide and long form), names with
negative constraints, lookup by name, per-turn DB result, candidate sampling and rendering.

Many requests ask the same thing. ``constraint_sets`` reduces them to their distinct constraint
sets; a set's candidates are bitmaps from an inverted index (``operators.bitmaps``), from which counts, first
and n-th candidates follow without one row per set and entity; requests join back by ``set_id``. Lookups by
name go through the first entity per (domain, name, city) and per (domain, name), one row each.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import schemas as S
from . import bitmaps as BM
from .joins import MAX_TASKS, broadcast_if_small, fits_broadcast, materialize, salted_join, spread

INACTIVE = [v for v in S.NOT_QUERY_VALUES if v is not None]
DOMAIN_SALTS = 16
TEXT_SALTS = 16
#: Bytes of names' texts that a task gathers or keeps for a join.
TEXT_BYTES = 32 << 20


def is_active(c: Column, inactive: Sequence[str] = tuple(INACTIVE)) -> Column:
    """A constraint value is active unless NULL or one of the inactive markers."""
    return c.isNotNull() & ~c.isin(*inactive)


def entities_wide(slots_long: DataFrame, attr_order: Sequence[str], list_slots: Sequence[str]) -> DataFrame:
    """Long entity slots ``(entity_pos, domain, slot, value)`` -> one row per entity with
    ``attrs: map<slot, array<value>>`` and ``record: array<struct<slot, values, is_list>>`` in
    attribute order. List values are sorted (the long form carries no value position)."""
    order = {s: i for i, s in enumerate(attr_order)}
    pos = F.coalesce(*[F.when(F.col("slot") == s, F.lit(i)) for s, i in order.items()], F.lit(len(order)))
    per_slot = (slots_long.groupBy("domain", "entity_pos", "slot")
                .agg(F.array_sort(F.collect_list("value")).alias("values"))
                .withColumn("_p", pos)
                .withColumn("is_list", F.col("slot").isin(*list_slots)))
    g = per_slot.groupBy("domain", "entity_pos").agg(
        F.array_sort(F.collect_list(F.struct("_p", "slot", "values", "is_list"))).alias("_attrs"))
    return g.select(
        "domain", "entity_pos",
        F.map_from_entries(F.transform("_attrs", lambda a: F.struct(a["slot"], a["values"]))).alias("attrs"),
        F.transform("_attrs", lambda a: F.struct(a["slot"].alias("slot"), a["values"].alias("values"),
                                                 a["is_list"].alias("is_list"))).alias("record"))


def _scalar(attrs: Column, slot: str) -> Column:
    return F.get(F.try_element_at(attrs, F.lit(slot)), 0)


def constraint_sets(requests: DataFrame, cols: Sequence[str], name: str = "set_id") -> tuple[DataFrame, DataFrame]:
    """Requests with the id of their constraint set, and the distinct sets ``(set_id, cols..., n_requests)``."""
    key = F.to_json(F.struct(*cols), {"ignoreNullFields": "false"})
    r = requests.withColumn(name, key)
    return r, r.groupBy(name, *cols).agg(F.count(F.lit(1)).alias("n_requests"))


def _prepare(entities: DataFrame, slots: Sequence[str] = ()) -> DataFrame:
    """Flat entity columns (domain, position, city, name and one value array per constraint slot),
    so that join conditions read columns and not a map."""
    a = F.col("attrs")
    return entities.select(F.col("domain").alias("_e_domain"), "entity_pos",
                           _scalar(a, "city").alias("_e_city"), _scalar(a, "name").alias("_e_name"),
                           *[F.try_element_at(a, F.lit(s)).alias(f"_e_{s}") for s in dict.fromkeys(slots)])


def check_constraints(requests: DataFrame, constraint_cols: Sequence[str], entities: DataFrame) -> None:
    """Refuse a constraint on a slot that no record has, and a constraint that is a list.

    Slot names are like column names, a handful; they are found by a map-side combined aggregate."""
    lists = [c for c in constraint_cols if requests.schema[c].dataType.typeName() == "array"]
    if lists:
        raise ValueError(f"list-valued constraint: {', '.join(lists)}")
    known = {r.slot for r in entities.select(F.explode(F.map_keys("attrs")).alias("slot")).distinct().collect()}
    unknown = [c for c in constraint_cols if known and c not in known]
    if unknown:
        raise ValueError(f"unknown slot: {', '.join(unknown)}")


@dataclass
class Candidates:
    """The answers of constraint sets as bitmaps (``key, bucket, words, n``, written), the name of every entity position,
    and the sets and entities they were worked out from (``sets`` has a column per constraint)."""

    bitmaps: DataFrame
    names: DataFrame
    sets: DataFrame
    entities: DataFrame
    constraint_cols: Sequence[str]
    negative_cols: dict[str, str]
    key: str
    domain: str
    city: str

    def rows(self) -> DataFrame:
        """``key, entity_pos, name``: every candidate listed."""
        return BM.members(self.bitmaps, self.key).join(self.names, "entity_pos")


def entity_index(entities: DataFrame, slots: Sequence[str]) -> DataFrame:
    """``_domain, _slot, _value, bucket, words``: bitmaps of the positions that have a value, and of all of a domain.
    A city has its first value only, other slots all of theirs."""
    def of(slot):
        v = F.coalesce(F.try_element_at("attrs", F.lit(slot)), F.array().cast("array<string>"))
        v = F.slice(v, 1, 1) if slot == "city" else v
        return F.transform(v, lambda x: F.struct(F.lit(slot).alias("_slot"), x.alias("_value")))
    values = [of(s) for s in dict.fromkeys(slots)]
    whole = F.array(F.struct(F.lit(BM.EVERY).alias("_slot"), F.lit("").alias("_value")))
    rows = entities.select(F.col("domain").alias("_domain"), "entity_pos", F.inline(F.flatten(F.array(whole, *values))))
    return BM.build(rows.filter("_value is not null"), ["_domain", "_slot", "_value"])


def candidate_bitmaps(requests: DataFrame, entities: DataFrame, constraint_cols: Sequence[str],
                      negative_cols: dict[str, str] | None = None, key: str = "set_id", domain: str = "domain",
                      city: str = "city") -> Candidates:
    """Conjunctive query with optional negative constraints, answered by bitmaps of the inverted index.

    ``requests`` are distinct constraint sets (``constraint_sets``). Active constraints are ANDed; without any, the
    answer is the whole domain. Constraint columns are named after their slot; a slot that no entity has is an
    error. Negative constraints (``{slot: request column}``) take away what matches all active ones of them
    in the request's city; an all-inactive negative dict takes away every entity of the city."""
    negative_cols = negative_cols or {}
    check_constraints(requests, constraint_cols, entities)
    index = materialize(entity_index(entities, ["city", *constraint_cols, *negative_cols]))

    def term(slot, value, negative):
        return F.when(is_active(F.col(value)), F.struct(F.lit(slot).alias("_slot"), F.col(value).cast("string").alias("_value"),
                                                        F.lit(negative).alias("negative")))
    positive = [term("city", city, False), *[term(c, c, False) for c in constraint_cols]]
    negative = [term(s, c, True) for s, c in negative_cols.items()]
    stated = F.lit(False)
    for c in negative_cols.values():
        stated = stated | F.col(c).isNotNull()
    table, small = broadcast_if_small(index) if fits_broadcast(index) else (index, False)
    if small:
        bitmaps = _narrowed(requests, table, constraint_cols, negative_cols, stated, key, domain, city)
    else:
        listed = F.filter(F.array(*positive), lambda x: x.isNotNull())
        taken = F.filter(F.array(*negative), lambda x: x.isNotNull()) if negative else F.filter(listed, lambda x: F.lit(False))
        whole = F.array(F.struct(F.lit(BM.EVERY).alias("_slot"), F.lit("").alias("_value"), F.lit(False).alias("negative")))
        r = requests.select(F.col(key), F.col(domain).alias("_domain"), listed.alias("_p"), taken.alias("_n"), stated.alias("_s"))
        r = r.filter(~F.col("_s") | (F.size("_n") > 0))  # all-inactive negatives leave nothing
        terms = r.select(key, "_domain", F.inline(F.array_distinct(F.concat(
            F.when(F.size("_p") > 0, F.col("_p")).otherwise(whole), "_n"))))
        bitmaps = BM.combine(terms, index, key, ["_domain", "_slot", "_value"])
    bitmaps = materialize(bitmaps)
    names = entities.select("entity_pos", _scalar(F.col("attrs"), "name").alias("name"))
    return Candidates(bitmaps, names, requests, entities, list(constraint_cols), dict(negative_cols), key, domain, city)


def _narrowed(requests: DataFrame, index: DataFrame, constraint_cols: Sequence[str], negative_cols: dict[str, str],
              stated: Column, key: str, domain: str, city: str) -> DataFrame:
    """``bitmaps.combine`` for an index that is broadcast: a constraint is one map-side join, nothing is shuffled."""
    cols = dict.fromkeys([*constraint_cols, *negative_cols.values()])
    r = requests.select(F.col(key), F.col(domain).alias("_d"), F.col(city).alias("_city"), stated.alias("_s"),
                        *[F.col(c).cast("string").alias(f"_v_{c}") for c in cols])
    some = F.lit(False)
    for c in negative_cols.values():
        some = some | is_active(F.col(f"_v_{c}"))
    r = spread(r.filter(~F.col("_s") | some), key)  # all-inactive negatives leave nothing
    of = lambda slot: index.filter(F.col("_slot") == slot)
    located = is_active(F.col("_city"))
    places = index.filter(F.col("_slot").isin("city", BM.EVERY))
    t = r.withColumn("_at", F.when(located, F.lit("city")).otherwise(F.lit(BM.EVERY))).withColumn(
        "_of", F.when(located, F.col("_city")).otherwise(F.lit("")))
    t = t.join(places, (F.col("_d") == F.col("_domain")) & (F.col("_at") == F.col("_slot")) & (F.col("_of") == F.col("_value")))
    t = t.drop("_domain", "_slot", "_value", "_at", "_of")
    for c in constraint_cols:
        on = is_active(F.col(f"_v_{c}"))
        t = BM.narrow(t, of(c), {"_d": "_domain", f"_v_{c}": "_value"}, on).filter(~on | F.col("_w").isNotNull())
        t = t.withColumn("words", F.when(on, BM.both(F.col("words"), F.col("_w"))).otherwise(F.col("words"))).drop("_w")
    gone = F.col("_s")
    for i, (slot, c) in enumerate(negative_cols.items()):
        on = is_active(F.col(f"_v_{c}"))
        t = BM.narrow(t, of(slot), {"_d": "_domain", f"_v_{c}": "_value"}, on, f"_n{i}")
        gone = gone & (~on | F.col(f"_n{i}").isNotNull())
    if negative_cols:
        every = F.filter(F.array(*[F.col(f"_n{i}") for i in range(len(negative_cols))]), lambda x: x.isNotNull())
        t = t.withColumn("words", F.when(gone, BM.without(F.col("words"), BM.every(every))).otherwise(F.col("words")))
    return t.select(key, "bucket", "words").withColumn("n", BM.count(F.col("words"))).filter(F.col("n") > 0)


def candidates(requests: DataFrame, entities: DataFrame, constraint_cols: Sequence[str],
               negative_cols: dict[str, str] | None = None, key: str = "request_id", domain: str = "domain",
               city: str = "city", carry: Sequence[str] = ()) -> DataFrame:
    """The candidates of ``candidate_bitmaps`` listed: ``(key, entity_pos, name, carry...)``."""
    rows = candidate_bitmaps(requests, entities, constraint_cols, negative_cols, key, domain, city).rows()
    if carry:
        rows = rows.join(requests.select(key, *carry), key)
    return rows.select(key, "entity_pos", "name", *carry)


def entity_query(requests: DataFrame, entities: DataFrame, constraint_cols: Sequence[str],
                 key: str = "request_id", domain: str = "domain", city: str = "city") -> DataFrame:
    """Wide form of the conjunctive query: ``(key, entity_pos)`` for every match. ``city`` is
    the first constraint, the others come from ``constraint_cols`` (column name = slot)."""
    return candidates(requests, entities, constraint_cols, None, key, domain, city).select(key, "entity_pos")


def entity_query_long(requests: DataFrame, slots_long: DataFrame, constraint_cols: Sequence[str],
                      key: str = "request_id", domain: str = "domain", city: str = "city") -> DataFrame:
    """Long form (relational division) for open-ended slots: explode active constraints,
    equi-join entity slots on (domain, slot, value), keep entities matching every active slot;
    requests without active constraints get every entity of their domain (spread over salts).
    Equal to ``entity_query``. The entity side is deduplicated first so a plain count replaces a
    distinct count."""
    cons = requests.select(key, domain, F.inline(F.array(*[
        F.struct(F.lit(s).alias("slot"), F.col(c).cast("string").alias("value"))
        for s, c in [("city", city), *[(c, c) for c in constraint_cols]]])))
    active = cons.filter(is_active(F.col("value")))
    n_active = active.groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
    es = slots_long.select("entity_pos", F.col("domain").alias(domain), "slot", "value").distinct()
    hits = (active.join(es, [domain, "slot", "value"])
            .groupBy(key, "entity_pos").agg(F.count(F.lit(1)).alias("_m")))
    matched = hits.join(n_active, key).filter(F.col("_m") == F.col("_n")).select(key, "entity_pos")
    ents = slots_long.select("entity_pos", F.col("domain").alias(domain)).distinct()
    unconstrained = requests.select(key, domain).join(n_active, key, "left_anti")
    everything = salted_join(ents, unconstrained, [domain], DOMAIN_SALTS).select(key, "entity_pos")
    return matched.unionByName(everything)


def entity_names(requests: DataFrame, entities: DataFrame, constraint_cols: Sequence[str],
                 negative_cols: dict[str, str], key: str = "request_id", domain: str = "domain",
                 city: str = "city", carry: Sequence[str] = ()) -> DataFrame:
    """Candidates ``(key, entity_pos, name, carry...)``: matches minus negative matches."""
    return candidates(requests, entities, constraint_cols, negative_cols, key, domain, city, carry)


def names_text(cands: DataFrame, requests: DataFrame, key: str = "request_id") -> DataFrame:
    """Per request: number of candidates and their names in file order, joined by ', '."""
    g = cands.groupBy(key).agg(F.count(F.lit(1)).alias("n_names"),
                               F.array_sort(F.collect_list(F.struct("entity_pos", "name"))).alias("_c"))
    return (requests.select(key).join(g, key, "left")
            .select(key, F.coalesce(F.col("n_names"), F.lit(0)).cast("bigint").alias("n_names"),
                    F.coalesce(F.array_join(F.transform("_c", lambda x: x["name"]), ", "), F.lit("")).alias("names")))


def set_names_text(cands: Candidates, sets: DataFrame, size: int | None = None) -> DataFrame:
    """``names_text`` per constraint set, from its bitmaps: a bucket's names are joined to text where its bits are, and a set
    gathers one text per bucket and not one row per candidate, so that a task holds texts and no lists of candidates.
    ``size``: bytes of all texts if they are known (``_text_bytes``)."""
    set_id = cands.key
    pos = F.col("entity_pos")
    words = cands.names.filter(pos.isNotNull()).groupBy(
        F.floor(pos / BM.BUCKET).alias("bucket"), (F.floor(pos / BM.WORD) % BM.WORDS).cast("int").alias("at")).agg(
        F.array_sort(F.collect_list(F.struct((pos % BM.WORD).cast("int").alias("bit"), "name"))).alias("_e"))
    table = words.groupBy("bucket").agg(F.map_from_entries(F.collect_list(F.struct("at", "_e"))).alias("_m")).select(
        F.col("bucket").alias("_b"), F.transform(F.sequence(F.lit(0), F.lit(BM.WORDS - 1)),
                                                 lambda i: F.try_element_at("_m", i)).alias("_names"))
    none = F.array().cast("array<struct<bit:int,name:string>>")
    of = lambda w, e: F.when((w == 0) | e.isNull(), none).otherwise(F.filter(e, lambda x: F.getbit(w, x["bit"]) == 1))
    met = spread(cands.bitmaps.select(set_id, "bucket", "words"), "bucket").join(table, F.col("bucket") == F.col("_b"))
    met = met.select(set_id, "bucket", F.transform(F.flatten(F.zip_with("words", "_names", of)), lambda x: x["name"]).alias("_t"))
    text = F.when(F.exists("_t", lambda x: x.isNotNull()), F.array_join("_t", ", "))
    met = met.select(set_id, "bucket", F.size("_t").cast("bigint").alias("_n"), text.alias("_t"))
    tasks = _text_tasks(cands, _text_bytes(cands) if size is None else size)
    g = met.repartition(tasks, set_id).groupBy(set_id).agg(
        F.sum("_n").alias("n_names"), F.array_sort(F.collect_list(F.struct("bucket", "_t"))).alias("_c"))
    return (sets.select(set_id).join(g, set_id, "left")
            .select(set_id, F.coalesce(F.col("n_names"), F.lit(0)).cast("bigint").alias("n_names"),
                    F.coalesce(F.array_join(F.transform("_c", lambda x: x["_t"]), ", "), F.lit("")).alias("names")))


def request_names_text(requests: DataFrame, cands: Candidates, sets: DataFrame, key: str = "request_id") -> DataFrame:
    """``key, n_names, names`` per request: the row of its set in ``set_names_text``, which is written once.

    Texts may have megabytes. A request meets its set's in a hash join that leaves requests in the order they come: sorted by
    set, one set's rows would follow each other, and a sink that looks at its buffers every hundred rows or more holds
    them all. Sets are copied over ``TEXT_SALTS``, so that a set that many ask for is met in many tasks."""
    size = _text_bytes(cands)
    texts = materialize(set_names_text(cands, sets, size))
    n = _text_tasks(cands, TEXT_SALTS * size)
    at = [cands.key, "_salt"]
    asked = requests.select(key, cands.key, F.pmod(F.xxhash64(key), F.lit(TEXT_SALTS)).cast("int").alias("_salt")).repartition(n, *at)
    copies = texts.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(TEXT_SALTS - 1)))).repartition(n, *at)
    return asked.join(copies.hint("shuffle_hash"), at).select(key, "n_names", "names")


def _text_bytes(cands: Candidates) -> int:
    """Bytes of all sets' texts of names, by the mean length of a name."""
    length = F.avg(F.coalesce(F.octet_length("name"), F.lit(0)) + 2)
    return int((cands.bitmaps.agg(F.sum("n")).first()[0] or 0) * (cands.names.agg(length).first()[0] or 0))


def _text_tasks(cands: Candidates, size: int) -> int:
    """Tasks for ``size`` bytes of texts: one per ``TEXT_BYTES``, and ``spark.sql.shuffle.partitions`` at least. Adaptive
    execution would go by bytes as compressed, of which repeated names take few."""
    n = int(cands.names.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return min(max(n, -(-size // TEXT_BYTES)), max(n, MAX_TASKS))


def _lookup_active(base: DataFrame, entities: DataFrame, domain: str, city: str, name: str) -> DataFrame:
    """QRY3 per row: first entity (file order) of that name in the row's city, else of that name in
    the domain; an inactive name leaves the name out. Adds ``active_pos`` and ``_far``.

    Each join meets a table of one row per key, so no row fans out."""
    e = _prepare(entities)
    named, located = is_active(F.col(name)), is_active(F.col(city))
    firsts = {}
    for tag, cols in (("nc", ["_e_name", "_e_city"]), ("n", ["_e_name"]), ("c", ["_e_city"]), ("d", [])):
        firsts[tag] = e.groupBy("_e_domain", *cols).agg(F.min("entity_pos").alias(f"_first_{tag}"))
    of = {"_e_name": name, "_e_city": city}
    out = base
    for tag, cols in (("nc", ["_e_name", "_e_city"]), ("n", ["_e_name"]), ("c", ["_e_city"]), ("d", [])):
        f = firsts[tag].withColumnsRenamed({c: f"{c}_{tag}" for c in ["_e_domain", *cols]})
        on = F.col(domain) == F.col(f"_e_domain_{tag}")
        for c in cols:
            on = on & (F.col(of[c]) == F.col(f"{c}_{tag}"))
        out = out.join(f, on, "left").drop(*[f"{c}_{tag}" for c in ["_e_domain", *cols]])
    near = F.when(located, F.when(named, F.col("_first_nc")).otherwise(F.col("_first_c")))
    far = F.when(named, F.col("_first_n")).otherwise(F.col("_first_d"))
    return (out.withColumn("active_pos", F.coalesce(near, far))
            .withColumn("_far", located & near.isNull())
            .drop(*[f"_first_{t}" for t in firsts]))


def entity_info(lookups: DataFrame, entities: DataFrame, key: str = "request_id", domain: str = "domain",
                name: str = "name", city: str = "city") -> DataFrame:
    """Lookup by name: first entity (file order) with that name in the city, else anywhere in
    the domain. An inactive name skips the name constraint (first entity of the city, else of
    the domain). ``entity_pos`` is NULL when nothing matches (the reference raises)."""
    found = _lookup_active(lookups.select(key, domain, name, city), entities, domain, city, name)
    return found.select(key, F.col("active_pos").alias("entity_pos"),
                        F.when(F.col("active_pos").isNotNull(), ~F.col("_far")).alias("in_city"))


def agreeing_entities(entities: DataFrame, slots: Sequence[str]) -> DataFrame:
    """``_e_domain, _e_name, _e_city, _s_<slot>..., _at``: the first position of the entities that agree in all of these."""
    a = F.col("attrs")
    e = entities.select(F.col("domain").alias("_e_domain"), "entity_pos", _scalar(a, "name").alias("_e_name"),
                        _scalar(a, "city").alias("_e_city"), *[F.try_element_at(a, F.lit(s)).alias(f"_s_{s}") for s in slots])
    return e.filter("_e_name is not null").groupBy("_e_domain", "_e_name", "_e_city", *[f"_s_{s}" for s in slots]).agg(
        F.min("entity_pos").alias("_at"))


def first_named(asked: DataFrame, cands: Candidates) -> DataFrame:
    """``_set, _value, _oracle_pos``: the first candidate of that name for every pair of ``asked`` (``_set, _domain, _value``)
    whose set has one.

    Entities that agree in domain, name, city and every constrained slot are one row (their first position), and for
    sets without a city those of all cities are. A pair meets the rows of its name (and city), and
    its constraints are checked against them: no pair meets the name's positions one by one."""
    slots = list(dict.fromkeys([*cands.constraint_cols, *cands.negative_cols]))
    values = [f"_s_{s}" for s in slots]
    e = agreeing_entities(cands.entities, slots)
    anywhere = e.groupBy("_e_domain", "_e_name", *values).agg(F.min("_at").alias("_at"))
    cols = dict.fromkeys([*cands.constraint_cols, *cands.negative_cols.values()])
    sets = cands.sets.select(F.col(cands.key).alias("_set"), F.col(cands.city).cast("string").alias("_city"),
                             *[F.col(c).cast("string").alias(f"_v_{c}") for c in cols])
    a = asked.join(sets, "_set")
    has = lambda slot, c: F.coalesce(F.array_contains(f"_s_{slot}", F.col(f"_v_{c}")), F.lit(False))
    kept = F.lit(True)
    for c in cands.constraint_cols:
        kept = kept & (~is_active(F.col(f"_v_{c}")) | has(c, c))
    stated, gone = F.lit(False), F.lit(True)
    for slot, c in cands.negative_cols.items():
        stated = stated | F.col(f"_v_{c}").isNotNull()
        gone = gone & (~is_active(F.col(f"_v_{c}")) | has(slot, c))
    kept = kept & ~(stated & gone)
    named = (F.col("_domain") == F.col("_e_domain")) & (F.col("_value") == F.col("_e_name"))
    located = is_active(F.col("_city"))
    found = [a.filter(located).join(e, named & (F.col("_city") == F.col("_e_city"))), a.filter(~located).join(anywhere, named)]
    met = [f.filter(kept).select("_set", "_value", "_at") for f in found]
    return met[0].unionByName(met[1]).groupBy("_set", "_value").agg(F.min("_at").cast("long").alias("_oracle_pos"))


def candidate_stats(requests: DataFrame, cands: Candidates, key: str = "request_id", domain: str = "domain",
                    oracle_name: str | None = None, drop_multi_domain: str = S.MULTI_CANDIDATE_DROP_DOMAIN) -> DataFrame:
    """Per request whose set has candidates: ``total`` (the drop domain with more than one candidate
    gets none), ``sel_pos`` (first occurrence of the oracle's name if it is a candidate, else the
    first candidate in file order), ``active_name`` and ``n_all`` (candidates before the drop).

    Counts and firsts are taken per set from its bitmaps, the first occurrence of a name by ``first_named``. Requests
    join one row each. The result is written, since samples and DB results read it several times."""
    set_id = cands.key
    first = BM.first(F.col("words"), F.col("bucket"))
    per_set = cands.bitmaps.groupBy(set_id).agg(F.sum("n").alias("n_all"), F.min(first).cast("long").alias("_pos"))
    per_set = per_set.join(cands.names.withColumnsRenamed({"entity_pos": "_pos", "name": "_first"}), "_pos")
    r = requests.select(key, set_id, domain, *([F.col(oracle_name).alias("_oracle")] if oracle_name else []))
    g = r.join(per_set, set_id)
    sel, name = F.col("_pos"), F.col("_first")
    if oracle_name:
        asked = r.filter("_oracle is not null").select(F.col(set_id).alias("_set"), F.col(domain).alias("_domain"),
                                                       F.col("_oracle").alias("_value")).distinct()
        per_name = first_named(asked, cands)
        g = g.join(per_name, (F.col(set_id) == F.col("_set")) & (F.col("_oracle") == F.col("_value")), "left")
        name = F.when(F.col("_oracle_pos").isNotNull(), F.col("_oracle")).otherwise(name)
        sel = F.coalesce(F.col("_oracle_pos"), sel)
    total = F.when((F.col(domain) == drop_multi_domain) & (F.col("n_all") > 1), F.lit(0)).otherwise(F.col("n_all"))
    return materialize(g.select(key, set_id, total.cast("bigint").alias("total"), F.when(total > 0, sel).alias("sel_pos"),
                                F.when(total > 0, name).alias("active_name"), "n_all"))


def draws(key: Column, n: Column, cap: int, seed: str) -> Column:
    """``cap`` different numbers below ``n`` (all of them if there are fewer) in random order, from hashes of the key.

    Of few numbers (up to ``4 * cap``) each gets a hash and the least are taken; of many, hashes modulo ``n`` are drawn
    and repeats skipped. Should more than ``_draws`` draws be needed (a chance of about 1e-9), the smallest numbers follow."""
    spot = lambda i: F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(seed), key.cast("string"), i.cast("string"))), 1, 15),
                            16, 10).cast("long")
    few = F.transform(F.array_sort(F.transform(F.sequence(F.lit(0).cast("long"), n - 1), lambda i: F.struct(
        spot(i).alias("h"), i.alias("i")))), lambda x: x["i"])
    many = F.array_distinct(F.concat(F.transform(F.sequence(F.lit(0), F.lit(_draws(cap) - 1)), lambda i: F.pmod(spot(i), n)),
                                     F.sequence(F.lit(0).cast("long"), F.lit(cap - 1).cast("long"))))
    return F.slice(F.when(n <= 4 * cap, few).otherwise(many), 1, cap)


def _draws(cap: int) -> int:
    return 2 * cap + 10


def rank_candidates(cands: Candidates, stats: DataFrame, key: str = "request_id",
                    cap: int = S.MAX_CANDIDATE_ENTITIES, seed: str = "0") -> DataFrame:
    """Candidate truncation: the selected entity first, then a random sample of the others without
    replacement, ``cap`` rows in all: ``(key, rank, entity_pos, name)``, rank 0 = the selected entity.

    A request draws ``cap`` ranks among its set's candidates (``draws``: reproducible, every choice equally likely);
    the bitmaps give the entities of those ranks, so only the rows drawn are joined. The selected one is left
    out of them if it was drawn."""
    if cap < 1:
        raise ValueError("cap must be >= 1")
    set_id = cands.key
    st = stats.filter(F.col("total") > 0)
    take = spread(st, key).select(key, set_id, "sel_pos", F.posexplode(draws(F.col(key), F.col("n_all"), cap, seed)).alias("_i", "_rank"))
    got = BM.pick(materialize(take), cands.bitmaps, set_id, "_rank").filter(F.col("entity_pos") != F.col("sel_pos"))
    w = Window.partitionBy(key).orderBy("_i")
    rest = (got.select(key, "entity_pos", F.row_number().over(w).cast("bigint").alias("rank"))
            .filter(F.col("rank") < cap).join(cands.names, "entity_pos"))
    first = st.select(key, F.col("sel_pos").alias("entity_pos"), F.col("active_name").alias("name"),
                      F.lit(0).cast("bigint").alias("rank"))
    return first.select(key, "rank", "entity_pos", "name").unionByName(rest.select(key, "rank", "entity_pos", "name"))


def db_result(requests: DataFrame, stats: DataFrame, entities: DataFrame, key: str = "request_id",
              domain: str = "domain", city: str = "city", sample: DataFrame | None = None) -> DataFrame:
    """Per-turn DB result: total candidates, active entity name and the entity row found by
    name (city first). Requests without candidates get total 0. With ``sample`` the truncated
    candidate list (``array<struct<rank, name>>``, at most ``cap`` entries) rides along."""
    info = stats.select(key, "total", "active_name")
    if sample is not None:
        lists = sample.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("rank", "name"))).alias("candidates"))
        info = info.join(lists, key, "left")
    base = requests.select(key, domain, city).join(info, key, "left")
    base = base.withColumn("total", F.coalesce(F.col("total"), F.lit(0)).cast("bigint"))
    out = _lookup_active(base, entities, domain, city, "active_name").drop("_far")
    return out.withColumn("active_pos", F.when(F.col("active_name").isNotNull(), F.col("active_pos"))).select(
        key, domain, city, "total", "active_name", "active_pos", *(["candidates"] if sample is not None else []))


def _render_value(a: Column) -> Column:
    """One attribute value as printed: lists as "[a, b]", a NULL (absent) value as "None"."""
    return F.coalesce(F.when(a["is_list"], F.concat(F.lit("["), F.array_join(a["values"], ", "), F.lit("]")))
                       .otherwise(F.get(a["values"], 0)), F.lit("None"))


def render_record(record: Column, extra: Sequence[tuple[str, Column]] = ()) -> Column:
    """Entity record as "slot value, ..." with list values as "[a, b]"."""
    items = F.transform(record, lambda a: F.concat(a["slot"], F.lit(" "), _render_value(a)))
    for slot, value in extra:
        items = F.array_append(items, F.concat(F.lit(slot + " "), value))
    return F.array_join(items, ", ")


def db_result_text(db: DataFrame, entities: DataFrame, key: str = "request_id", include_domain: bool = True) -> DataFrame:
    """``total N, candidate [..], selected [slot value, ..]`` per request, from a DB result
    built ``with_candidates``."""
    e = entities.select(F.col("entity_pos").alias("active_pos"), "record", F.col("domain").alias("_ed"))
    j = db.join(e, "active_pos", "left")
    extra = [("domain", F.col("_ed"))] if include_domain else []
    selected = F.when(F.col("active_pos").isNotNull(), render_record(F.col("record"), extra)).otherwise(F.lit(""))
    cand = F.coalesce(F.array_join(F.transform("candidates", lambda x: x["name"]), ", "), F.lit(""))
    text = F.concat(F.lit("total "), F.col("total").cast("string"), F.lit(", candidate ["), cand,
                    F.lit("], selected ["), selected, F.lit("]"))
    return j.select(key, text.alias("db_text"))


def flatten_record(record: Column) -> Column:
    """Nested record value rendered as ``[a, [b, c], d]``."""
    return F.concat(F.lit("["), F.array_join(F.transform(record, _render_value), ", "), F.lit("]"))


__all__ = ["is_active", "entities_wide", "constraint_sets", "candidates", "candidate_bitmaps", "entity_query", "entity_query_long", "entity_names",
           "names_text", "set_names_text", "request_names_text", "first_named", "entity_info", "candidate_stats", "rank_candidates", "db_result", "render_record",
           "db_result_text", "flatten_record"]
