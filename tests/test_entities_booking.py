"""Edge cases: entity query, names with negative constraints, DB result, sampling, bookings."""

from pyspark.sql import functions as F

from turnwise.operators import booking as BK
from turnwise.operators import entities as EN

ENT_ROWS = [
    # entity_pos, domain, city, name, genre (list), size
    (1, "hotel", "kyoto", "inn a", ["spa", "cheap"], "10"),
    (2, "hotel", "kyoto", "inn b", ["cheap"], "20"),
    (3, "hotel", "osaka", "inn c", ["spa"], "10"),
    (4, "hotel", "kyoto", "inn a", ["luxury"], "30"),
    (5, "weather", "kyoto", "sunny", ["x"], "1"),
    (6, "weather", "kyoto", "rainy", ["x"], "1"),
]


def _entities(spark):
    long = []
    for pos, dom, city, name, genres, size in ENT_ROWS:
        long += [(pos, dom, "city", city), (pos, dom, "name", name), (pos, dom, "size", size)]
        long += [(pos, dom, "genre", g) for g in genres]
    slots = spark.createDataFrame(long, "entity_pos long, domain string, slot string, value string")
    return slots, EN.entities_wide(slots, ["city", "name", "genre", "size"], ["genre"])


REQ_SCHEMA = "request_id long, domain string, city string, genre string, size string, neg_genre string, oracle string"


def _req(spark, data):
    return spark.createDataFrame(data, REQ_SCHEMA)


def _q(spark, data):
    slots, ents = _entities(spark)
    req = _req(spark, data)
    wide = {}
    for r in EN.entity_query(req, ents, ["genre", "size"]).collect():
        wide.setdefault(r.request_id, set()).add(r.entity_pos)
    long = {}
    for r in EN.entity_query_long(req, slots, ["genre", "size"]).collect():
        long.setdefault(r.request_id, set()).add(r.entity_pos)
    assert wide == long
    return wide


def test_query_rules(spark):
    res = _q(spark, [
        (1, "hotel", "kyoto", "dontcare", "", None, None),    # all constraints inactive: whole city
        (2, "hotel", None, None, None, None, None),            # city missing: all cities
        (3, "hotel", "kyoto", "spa", None, None, None),        # list slot: membership
        (4, "hotel", "kyoto", "spa", "20", None, None),        # conjunctive: nothing
        (5, "hotel", "無し", "spa", "10", None, None),          # inactive city marker
    ])
    assert res[1] == {1, 2, 4}
    assert res[2] == {1, 2, 3, 4}
    assert res[3] == {1}
    assert 4 not in res
    assert res[5] == {1, 3}


def _names(spark, data):
    _, ents = _entities(spark)
    req = _req(spark, data)
    out = {}
    for r in EN.entity_names(req, ents, ["genre", "size"], {"genre": "neg_genre"}).collect():
        out.setdefault(r.request_id, set()).add(r.entity_pos)
    return out


def test_negative_constraints(spark):
    res = _names(spark, [
        (1, "hotel", "kyoto", None, None, "spa", None),        # remove spa hotels
        (2, "hotel", "kyoto", None, None, "dontcare", None),   # all-inactive negative dict: nothing left
        (3, "hotel", "kyoto", None, None, None, None),         # no negative dict
    ])
    assert res[1] == {2, 4}
    assert 2 not in res
    assert res[3] == {1, 2, 4}


def test_db_result_and_sampling(spark):
    _, ents = _entities(spark)
    req = _req(spark, [
        (1, "hotel", "kyoto", None, None, None, "inn b"),      # oracle entity among candidates
        (2, "hotel", "kyoto", None, None, None, "inn z"),      # oracle not a candidate: first candidate
        (3, "weather", "kyoto", None, None, None, None),       # weather with 2 candidates: emptied
        (4, "hotel", "nara", None, None, None, None),          # no candidates
    ])
    req, sets = EN.constraint_sets(req, ["domain", "city", "genre", "size"])
    assert sorted(r.n_requests for r in sets.collect()) == [1, 1, 2]
    cands = EN.candidate_bitmaps(sets, ents, ["genre", "size"])
    stats = EN.candidate_stats(req, cands, oracle_name="oracle")
    db = {r.request_id: (r.total, r.active_name, r.active_pos) for r in EN.db_result(req, stats, ents).collect()}
    assert db[1] == (3, "inn b", 2)
    assert db[2] == (3, "inn a", 1)
    assert db[3] == (0, None, None)
    assert db[4] == (0, None, None)
    sample = EN.rank_candidates(cands, stats, cap=2).collect()
    s1 = sorted((r.rank, r.entity_pos) for r in sample if r.request_id == 1)
    assert s1[0] == (0, 2) and len(s1) == 2                # selected first, cap rows in all
    assert not [r for r in sample if r.request_id == 3]


def test_entity_info_city_first(spark):
    _, ents = _entities(spark)
    look = spark.createDataFrame([(1, "hotel", "inn a", "osaka"), (2, "hotel", "inn c", "kyoto"),
                                  (3, "hotel", "", "osaka"), (4, "hotel", "nope", "kyoto")],
                                 "request_id long, domain string, name string, city string")
    got = {r.request_id: (r.entity_pos, r.in_city) for r in EN.entity_info(look, ents).collect()}
    assert got[1] == (1, False)   # not in the city: first anywhere
    assert got[2] == (3, False)
    assert got[3] == (3, True)    # inactive name: first entity of the city
    assert got[4] == (None, None)


def test_booking_rules(spark):
    df = spark.createDataFrame([
        (1, "hotel", {"people": "2", "day": "mon", "stay": None}, {"people": "2", "day": "mon"}, None),   # incomplete
        (2, "hotel", {"people": "2", "day": "mon"}, {"people": "2", "day": "mon"}, 77),                     # success, oracle ref
        (3, "hotel", {"people": "2", "day": "mon"}, {"people": "2", "day": "mon", "stay": "1"}, None),      # extra goal key
        (4, "restaurant", {}, {}, None),                                                                    # empty and no goal
        (5, "taxi", {"day": "mon", "departurepoint": "a"}, {"day": "mon", "departurepoint": "b"}, None),    # taxi ignores points
        (6, "taxi", {"day": "mon"}, {"day": "mon", "arrivalpoint": "b"}, None),                             # request lacks key: goal keeps it
    ], "request_id long, domain string, req map<string,string>, goal map<string,string>, oracle long")
    out = {r.request_id: (r.success, r.ref) for r in BK.book_result(df, F.col("req"), F.col("goal"), oracle_ref="oracle").collect()}
    assert out[1] == (None, None)
    assert out[2] == (True, 77)
    assert out[3] == (False, None)
    assert out[4][0] is True and 1 <= out[4][1] <= 99999
    assert out[5][0] is True
    assert out[6] == (False, None)
    txt = dict(BK.book_result(df, F.col("req"), F.col("goal"), oracle_ref="oracle")
               .select("request_id", BK.book_result_text(F.col("domain"), F.col("success"), F.col("ref")).alias("t")).collect())
    assert txt[2] == "hotel success True, hotel ref 77"
    assert txt[3] == "" and txt[1] == ""   # failed booking: success not printed


def test_unknown_slot_is_an_error(spark):
    import pytest
    _, ents = _entities(spark)
    req = _req(spark, [(1, "hotel", "kyoto", None, None, None, None)]).withColumn("sauna", F.lit("yes"))
    with pytest.raises(ValueError, match="unknown slot: sauna"):
        EN.entity_query(req, ents, ["genre", "sauna"])
    with pytest.raises(ValueError, match="list-valued constraint: genre"):
        EN.entity_query(req.withColumn("genre", F.array("genre")), ents, ["genre"])


def test_samples_are_whole_and_reach_all_candidates(spark):
    """Every request gets ``cap`` different candidates, and all candidates get their turn."""
    _, ents = _entities(spark)
    req, sets = EN.constraint_sets(_req(spark, [(i, "hotel", None, None, None, None, None) for i in range(40)]),
                                   ["domain", "city", "genre", "size"])
    cands = EN.candidate_bitmaps(sets, ents, ["genre", "size"])
    sample = EN.rank_candidates(cands, EN.candidate_stats(req, cands), cap=3).collect()
    per = {}
    for r in sample:
        per.setdefault(r.request_id, {})[r.rank] = r.entity_pos
    assert all(sorted(x) == [0, 1, 2] and x[0] == 1 and len(set(x.values())) == 3 for x in per.values())
    assert {p for x in per.values() for p in x.values()} == {1, 2, 3, 4} and len(per) == 40


def test_all_pairs_are_drawn_alike(spark):
    """Ordered pairs of ranks over many keys: few numbers (all hashed) and many (drawn and deduplicated)."""
    for n in (5, 14):
        d = spark.range(40_000).select(EN.draws(F.col("id"), F.lit(n).cast("long"), 2 if n == 5 else 3, "s").alias("x"))
        assert d.filter(F.size(F.array_distinct("x")) != F.size("x")).count() == 0
        got = {(r[0], r[1]): r[2] for r in d.groupBy(F.col("x")[0], F.col("x")[1]).count().collect()}
        mean = 40_000 / (n * (n - 1))
        assert len(got) == n * (n - 1) and all(abs(c - mean) < 6 * mean ** 0.5 for c in got.values())
    all_of_three = spark.range(50).select(EN.draws(F.col("id"), F.lit(3).cast("long"), 9, "s").alias("x")).collect()
    assert all(sorted(r.x) == [0, 1, 2] for r in all_of_three)
    # should the draws run out of different numbers, the smallest ones follow
    one = spark.range(5).select(F.size(EN.draws(F.col("id"), F.lit(10**12).cast("long"), 3, "s")).alias("x")).collect()
    assert all(r.x == 3 for r in one)


def test_bitmaps_against_python_sets(spark):
    import random
    from turnwise.operators import bitmaps as BM
    rng = random.Random(6)
    top = 3 * BM.BUCKET
    lists = {v: sorted(rng.sample(range(top), n)) for v, n in (("a", 3000), ("b", 900), ("c", 40), ("edge", 0))}
    lists["edge"] = [0, 31, 32, BM.BUCKET - 1, BM.BUCKET, top - 1]
    rows = [(v, p) for v, ps in lists.items() for p in ps] + [("a", lists["a"][0]), ("a", None)]
    index = BM.build(spark.createDataFrame(rows, "v string, entity_pos long"), ["v"])
    asked = {"k1": ("a", None), "k2": ("a b", None), "k3": ("a", "b"), "k4": ("a b", "c edge"), "k5": ("edge", "a b"),
             "k6": ("nothing", None), "k7": ("a nothing", None), "k8": ("b", "nothing"), "k9": ("edge", None)}
    terms = [(k, v, False) for k, (p, _) in asked.items() for v in p.split()]
    terms += [(k, v, True) for k, (_, n) in asked.items() for v in (n or "").split()]
    found = BM.combine(spark.createDataFrame(terms, "k string, v string, negative boolean"), index, "k", ["v"])
    want = {}
    for k, (p, n) in asked.items():
        s = set.intersection(*[set(lists.get(v, [])) for v in p.split()])
        if n:
            s -= set.intersection(*[set(lists.get(v, [])) for v in n.split()])
        if s:
            want[k] = sorted(s)
    got = {}
    for r in BM.members(found, "k").orderBy("k", "entity_pos").collect():
        got.setdefault(r["k"], []).append(r["entity_pos"])
    assert got == want
    assert {r[0]: r[1] for r in found.groupBy("k").sum("n").collect()} == {k: len(v) for k, v in want.items()}
    ranks = [(k, i) for k, v in want.items() for i in sorted({0, len(v) - 1, *rng.sample(range(len(v)), min(20, len(v)))})]
    picked = BM.pick(spark.createDataFrame(ranks, "k string, r long"), found, "k", "r").collect()
    assert len(picked) == len(ranks) and all(want[x["k"]][x["r"]] == x["entity_pos"] for x in picked)


def test_plans_of_counts_and_samples_have_no_row_per_set_and_entity(spark):
    """5,000 entities and sets without city: the largest join of the statistics has buckets, not entities."""
    rows = [(i, "hotel", s, v) for i in range(5000) for s, v in (("city", f"c{i % 3}"), ("name", f"n{i}"), ("size", "1"))]
    slots = spark.createDataFrame(rows, "entity_pos long, domain string, slot string, value string")
    ents = EN.entities_wide(slots, ["city", "name", "size"], [])
    req = spark.createDataFrame([(i, "hotel", None, str(i % 2), f"n{i}") for i in range(60)],
                                "request_id long, domain string, city string, size string, oracle string")
    req, sets = EN.constraint_sets(req, ["domain", "city", "size"])
    cands = EN.candidate_bitmaps(sets, ents, ["size"])
    assert cands.bitmaps.count() == 3  # one set has candidates, 5,000 positions are 3 buckets
    stats = EN.candidate_stats(req, cands, oracle_name="oracle")
    got = {r["request_id"]: (r["total"], r["sel_pos"]) for r in stats.collect()}
    assert got == {i: (5000, i) for i in range(60) if i % 2}
    sample = EN.rank_candidates(cands, stats, cap=4)
    assert "members" not in sample.columns and sample.count() == 30 * 4


def test_broadcast_and_shuffled_index_agree(spark, monkeypatch):
    import itertools
    _, ents = _entities(spark)
    values = itertools.product(["hotel", "weather", "none"], ["kyoto", "", None], ["spa", "cheap", None], ["10", "x", None],
                               ["spa", "dontcare", None, "cheap"])
    req = _req(spark, [(i, *v, None) for i, v in enumerate(values)])
    ask = lambda: sorted(map(tuple, EN.entity_names(req, ents, ["genre", "size"], {"genre": "neg_genre"}).collect()))
    plain = ask()
    monkeypatch.setattr(EN, "broadcast_if_small", lambda df: (df, False))
    assert ask() == plain and len(plain) > 50


def test_named_candidates_by_agreeing_entities(spark):
    """The first candidate of a name, whatever city, constraints and negative constraints its set has, against plain loops;
    6,000 entities of one name are met as the few rows that differ in what is asked."""
    import itertools
    ents = [(i, "hotel", ("kyoto", "osaka", None)[i % 3], ("inn", "inn", "spa")[i % 5 % 3],
             sorted({("old", "new", "hot")[i % 7 % 3], "big" if i % 4 else "new"}), str(i % 2)) for i in range(50, 6050)]
    slots = [(i, d, s, v) for i, d, c, n, g, z in ents for s, v in
             ([("city", c)] if c else []) + [("name", n), ("size", z)] + [("genre", x) for x in g]]
    e = EN.entities_wide(spark.createDataFrame(slots, "entity_pos long, domain string, slot string, value string"),
                         ["city", "name", "genre", "size"], ["genre"])
    asked = list(itertools.product(["kyoto", "", None], ["old", "hot", None], ["1", ""], ["new", "dontcare", "none", None],
                                   ["inn", "spa", "no such", None]))
    req = spark.createDataFrame([(i, "hotel", *a) for i, a in enumerate(asked)],
                                "request_id long, domain string, city string, genre string, size string, neg_genre string, oracle string")
    req, sets = EN.constraint_sets(req, ["domain", "city", "genre", "size", "neg_genre"])
    cands = EN.candidate_bitmaps(sets, e, ["genre", "size"], {"genre": "neg_genre"})
    got = {r["request_id"]: (r["n_all"], r["sel_pos"]) for r in EN.candidate_stats(req, cands, oracle_name="oracle").collect()}
    want = {}
    for i, (city, genre, size, neg, name) in enumerate(asked):
        left = [(p, n) for p, _, c, n, g, z in ents if (not city or c == city) and (not genre or genre in g) and (not size or z == size)
                and not (neg is not None and (neg == "dontcare" or neg in g))]
        if left:
            want[i] = (len(left), min([p for p, n in left if n == name] or [left[0][0]]))
    assert got == want
    table = EN.agreeing_entities(e, ["genre", "size"])  # what a name is looked up in
    assert table.count() < 150 and table.filter("_e_name = 'inn' and _e_city = 'kyoto'").agg(F.min("_at")).first()[0] == 51


def test_texts_of_names_are_joined_by_bucket(spark):
    """Texts of sets over five buckets, with absent, empty and repeated names, equal those of the listed candidates; no
    list of candidates is gathered per set."""
    rows = []
    for i in range(9000):
        rows += [(i, "hotel", s, v) for s, v in (("city", f"c{i % 3}"), ("name", "" if i % 11 == 0 else f"n{i % 50}"), ("size", str(i % 400)))
                 if not (s == "name" and (i % 7 == 0 or 2048 <= i < 4096))]
    rows += [(20_000, "inn", "city", "c0"), (20_001, "inn", "city", "c0"), (20_001, "inn", "name", "last")]
    ents = EN.entities_wide(spark.createDataFrame(rows, "entity_pos long, domain string, slot string, value string"),
                            ["city", "name", "size"], [])
    req = spark.createDataFrame([(i, d, c, z) for i, (d, c, z) in enumerate(
        [("hotel", None, None), ("hotel", "c1", None), ("hotel", None, "7"), ("hotel", "c2", "0"), ("inn", None, None),
         ("inn", "c0", "1"), ("none", None, None)])], "request_id long, domain string, city string, size string")
    _, sets = EN.constraint_sets(req, ["domain", "city", "size"])
    cands = EN.candidate_bitmaps(sets, ents, ["size"])
    text = EN.set_names_text(cands, sets)
    assert sorted(map(tuple, text.collect())) == sorted(map(tuple, EN.names_text(cands.rows(), sets, key="set_id").collect()))
    assert max(r["n_names"] for r in text.collect()) == 9000 and text.filter("n_names = 2 and names = 'last'").count() == 1
    assert "collect_list(struct(entity_pos" not in text._jdf.queryExecution().optimizedPlan().toString()


def test_rank_directory_is_broadcast_by_bytes_held(spark):
    """A directory of few compressed bytes and many rows with long keys: a broadcast would hold what its files do not show."""
    from turnwise.operators import bitmaps as BM
    from turnwise.operators import joins
    word = F.transform(F.sequence(F.lit(0), F.lit(BM.WORDS - 1)), lambda i: F.when(i == 1, F.lit(5).cast("long")).otherwise(F.lit(0)))
    rows = spark.range(300 * 400).select(F.concat(F.repeat(F.lit("key "), 80), (F.col("id") % 300).cast("string")).alias("k"),
                                         F.floor(F.col("id") / 300).alias("bucket"), word.alias("words"), F.lit(2).cast("long").alias("n"))
    bitmaps = joins.materialize(rows)
    assert joins.planned_bytes(bitmaps) < joins.BROADCAST_MAX_BYTES < joins.held_bytes(bitmaps)
    assert not joins.fits_broadcast(bitmaps) and joins.fits_broadcast(bitmaps.limit(10))
    wanted = bitmaps.filter("bucket = 0").select("k", F.explode(F.array(*[F.lit(r).cast("long") for r in (0, 3, 799)])).alias("r"))
    picked = BM.pick(wanted, bitmaps, "k", "r")
    assert "strategy=broadcast" not in picked._jdf.queryExecution().optimizedPlan().toString()
    at = {0: BM.WORD, 3: BM.BUCKET + BM.WORD + 2, 799: 399 * BM.BUCKET + BM.WORD + 2}
    got = picked.collect()
    assert len(got) == 900 and all(at[x["r"]] == x["entity_pos"] for x in got)
    # an index of that kind is met by shuffles as well
    index = bitmaps.select(F.col("k").alias("v"), "bucket", "words")
    found = BM.combine(spark.createDataFrame([("a", rows.first()["k"], False)], "k string, v string, negative boolean"), index, "k", ["v"])
    assert "strategy=broadcast" not in found._jdf.queryExecution().optimizedPlan().toString()
    assert found.count() == 400


def test_requests_of_one_set_do_not_follow_each_other(spark):
    """Texts of names come in the order of the requests: a sink that buffers a hundred rows meets all kinds of sets, not the
    longest text a hundred times."""
    slots = spark.createDataFrame([(i, "hotel", s, v) for i in range(300) for s, v in (("city", f"c{i % 20}"), ("name", f"n{i}"))],
                                  "entity_pos long, domain string, slot string, value string")
    ents = EN.entities_wide(slots, ["city", "name"], [])
    cities = [None, "nowhere", *[f"c{i}" for i in range(20)]]
    req = spark.createDataFrame([(None if i == 7 else i // 2, "hotel", cities[i % 22]) for i in range(8800)],
                                "request_id long, domain string, city string").repartition(2, "request_id")
    req, sets = EN.constraint_sets(req, ["domain", "city"])
    cands = EN.candidate_bitmaps(sets, ents, [])
    kept = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.shuffle.partitions")}
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        spark.conf.set("spark.sql.shuffle.partitions", "2")
        got = EN.request_names_text(req, cands, sets)
        texts = [[*g] for g in got.rdd.map(tuple).glom().collect()]
    finally:
        for k, v in kept.items():
            spark.conf.set(k, v)
    want = EN.names_text(cands.rows(), sets, key="set_id").join(req, "set_id").select("request_id", "n_names", "names")
    order = lambda rows: sorted(map(tuple, rows), key=str)
    assert order(x for g in texts for x in g) == order(want.collect())
    run = longest = 0
    for g in texts:
        last = None
        for _, _, text in g:
            run = run + 1 if text == last else 1
            last, longest = text, max(longest, run)
    assert longest < 30  # a set has 400 requests
