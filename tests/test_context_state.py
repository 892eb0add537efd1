"""Edge cases: contexts, state rendering/parsing, state metrics, carry-forward."""

from pyspark.sql import functions as F

from turnwise.operators import context as ctx
from turnwise.operators import metrics as M
from turnwise.operators import state as ST
from turnwise.schemas import slot_catalogue

from .conftest import rows


def _turns(spark, data):
    return spark.createDataFrame(data, "conv_id long, turn long, speaker string, utterance string")


def test_context_k_rules(spark):
    t = _turns(spark, [(1, 0, "SYSTEM", "hello"), (1, 1, "USER", "a"), (1, 2, "SYSTEM", "b"),
                       (1, 3, "USER", "c"), (1, 4, "SYSTEM", "d")])
    all_ = dict((r.turn, r.context_text) for r in ctx.context_strings(t, 0, user_prefix="U", system_prefix="S").collect())
    assert all_[0] == ""                       # first turn is SYSTEM: empty context
    assert all_[4] == "S hello U a S b U c"    # k = 0 keeps the whole history
    k10 = dict((r.turn, r.context_text) for r in ctx.context_strings(t, 10, user_prefix="U", system_prefix="S").collect())
    assert k10 == all_                         # k larger than history = all
    k2 = dict((r.turn, r.context_text) for r in ctx.context_strings(t, 2, user_prefix="U", system_prefix="S").collect())
    assert k2[4] == "S b U c"


def _metrics(spark, pairs):
    df = spark.createDataFrame(pairs, "k long, ref string, hyp string")
    return {r.k: (r.joint_goal_accuracy, round(r.slot_f1, 6)) for r in M.state_metrics(df, "ref", "hyp").collect()}


def test_state_metric_edge_cases(spark):
    m = _metrics(spark, [
        (1, "", ""),                                   # both empty: JGA 1, F1 1.0
        (2, "hotel area north", ""),                   # only prediction empty
        (3, "a b c, a b c", "a b c"),                  # repeated items count once
        (4, "x y 1, 2", "x y 1"),                      # value with ", " breaks into two items
        (5, "a b c, d e f", "a b c, d e g"),
    ])
    assert m[1] == (1, 1.0)
    assert m[2] == (0, 0.0)
    assert m[3] == (1, 1.0)
    assert m[4] == (0, round(2 * 1.0 * 0.5 / 1.5, 6))
    assert m[5] == (0, 0.5)


def test_long_and_string_metrics_agree(spark):
    items = spark.createDataFrame(
        [("ref", 1, "a b 1"), ("ref", 1, "a c 2"), ("hyp", 1, "a b 1"), ("hyp", 1, "a c 3"),
         ("ref", 2, "x y z"), ("hyp", 2, "x y z"), ("ref", 3, "only ref")], "side string, k long, item string")
    long = {r.k: (r.tp, r.fp, r.fn, r.joint_goal_accuracy) for r in M.state_metrics_long(items, ["k"]).collect()}
    assert long == {1: (1, 1, 1, 0), 2: (1, 0, 0, 1)}   # key 3 has no prediction: dropped
    # with the turns of each side an empty state is the one item '', a missing prediction is dropped
    turns = spark.createDataFrame([(s, k) for s in ("ref", "hyp") for k in (1, 2, 3, 4)] + [("ref", 5)], "side string, k long")
    items = items.unionByName(spark.createDataFrame([("ref", 5, "a b c")], "side string, k long, item string"))
    got = {r.k: (r.tp, r.fp, r.fn, r.joint_goal_accuracy, r.slot_f1) for r in M.state_metrics_long(items, ["k"], turns).collect()}
    want = {1: ("a b 1, a c 2", "a b 1, a c 3"), 2: ("x y z", "x y z"), 3: ("only ref", ""), 4: ("", "")}
    text = spark.createDataFrame([(k, *v) for k, v in want.items()], "k long, ref string, hyp string")
    assert got == {r.k: (r.tp, r.fp, r.fn, r.joint_goal_accuracy, r.slot_f1) for r in M.state_metrics(text, "ref", "hyp").collect()}


def test_describe_matches_pandas(spark):
    import pandas as pd
    vals = [0.0, 1.0, 0.25, 0.5, 0.5, 0.9, 0.1]
    df = spark.createDataFrame([(float(v),) for v in vals], "x double")
    got = M.describe(df, ["x"]).collect()[0]
    want = pd.Series(vals).describe()
    for a, b in [("n", "count"), ("mean", "mean"), ("std", "std"), ("min", "min"), ("p25", "25%"),
                 ("p50", "50%"), ("p75", "75%"), ("max", "max")]:
        assert abs(float(got[a]) - float(want[b])) < 1e-9, a
    one = M.describe(spark.createDataFrame([(1.0,)], "x double"), ["x"]).collect()[0]
    assert one["std"] is None and one["p50"] == 1.0


CAT_BELIEF = {"general": ["active_domain", "city"], "hotel": ["name", "area"]}
CAT_BOOK = {"hotel": ["people"]}


def _parse(spark, text, informable=(("area", "north"), ("area", "south"))):
    df = spark.createDataFrame([(1, text)], "k long, s string")
    inf = spark.createDataFrame(list(informable), "slot string, value string")
    parsed, rejects = ST.parse_state(df, ["k"], "s", slot_catalogue(spark, CAT_BELIEF, CAT_BOOK), inf)
    return ({(r.domain, r.slot): (r.kind, r.value) for r in parsed.collect()},
            sorted((r.item, r.reason) for r in rejects.collect()))


def test_parse_state_rules(spark):
    parsed, rejects = _parse(spark, "hotel name grand  hotel, hotel area east, hotel area north, "
                                    "hotel pool yes, hotel, hotel people 2, hotel name the inn")
    assert parsed[("hotel", "name")] == ("belief", "the inn")          # repeated slot: last wins
    assert parsed[("hotel", "area")] == ("belief", "north")            # east is not an allowed value
    assert parsed[("hotel", "people")] == ("book", "2")                # book slot
    assert ("hotel area east", "value_not_allowed") in rejects
    assert ("hotel pool yes", "unknown_slot") in rejects
    assert ("hotel", "malformed") in rejects


def test_render_parse_round_trip(spark):
    long = spark.createDataFrame(
        [(1, "hotel", "name", "grand hotel"), (1, "general", "city", "kyoto"), (1, "hotel", "people", "2"),
         (1, "hotel", "area", ""), (1, "hotel", "area2", "x")], "k long, domain string, slot string, value string")
    cat = slot_catalogue(spark, CAT_BELIEF, CAT_BOOK)
    text = ST.render_state(long, ["k"], cat).collect()[0].state
    assert text == "general city kyoto, hotel name grand hotel, hotel area2 x, hotel people 2"
    listed = long.filter("slot <> 'area2'")
    text = ST.render_state(listed, ["k"], cat).collect()[0].state
    assert text == "general city kyoto, hotel name grand hotel, hotel people 2"
    parsed, rejects = _parse(spark, text)
    assert parsed == {("general", "city"): ("belief", "kyoto"), ("hotel", "name"): ("belief", "grand hotel"),
                      ("hotel", "people"): ("book", "2")}
    assert rejects == []


def test_render_drops_book_slots_of_domains_without_belief(spark):
    rows = [(1, "hotel", "belief", "name", "x"), (1, "taxi", "book", "people", "2"),
            (2, "taxi", "belief", "time", ""), (2, "taxi", "book", "people", "2"), (2, "taxi", "book", "day", None),
            (3, "taxi", "book", "people", "2"),
            (4, "spa", "belief", "zz", "1"), (4, "spa", "book", "aa", "2"), (4, "hotel", "belief", "name", "y")]
    long = spark.createDataFrame(rows, "k long, domain string, kind string, slot string, value string")
    cat = slot_catalogue(spark, CAT_BELIEF, CAT_BOOK)
    got = {r["k"]: r["state"] for r in ST.render_state(long, ["k"], cat).collect()}
    assert got == {1: "hotel name x", 2: "taxi people 2", 4: "hotel name y, spa zz 1, spa aa 2"}


def test_carry_forward_chunked_equals_plain(spark):
    import random
    rnd = random.Random(3)
    data = [(rnd.randrange(3), i, rnd.randrange(5), rnd.choice(["", None, "a", "b", "c"]), rnd.choice(["", None, "x", "y"]))
            for i in range(300)]
    df = spark.createDataFrame(data, "u long, t long, day long, s1 string, s2 string")
    plain = ST.carry_forward(df, ["u"], ["t"], ["s1", "s2"])
    chunked = ST.carry_forward(df, ["u"], ["t"], ["s1", "s2"], chunk=F.col("day") * 0 + F.floor(F.col("t") / 37))
    assert rows(plain, ["u", "t", "s1", "s2"]) == rows(chunked, ["u", "t", "s1", "s2"])
    # sequential reference
    mem = {}
    want = []
    for u, t, _, s1, s2 in sorted(data, key=lambda r: (r[0], r[1])):
        m = mem.setdefault(u, [None, None])
        for i, v in enumerate((s1, s2)):
            if v:
                m[i] = v
        want.append((u, t, m[0], m[1]))
    assert rows(plain, ["u", "t", "s1", "s2"]) == sorted(want, key=lambda t: tuple((x is None, str(x)) for x in t))


def test_chunked_context_equals_plain(spark):
    import random
    rnd = random.Random(12)
    data = []
    for conv in range(6):
        n = rnd.randint(1, 40)
        turns = sorted(rnd.sample(range(0, 80), n))      # gaps in turn numbers
        data += [(conv, t, rnd.choice(["USER", "SYSTEM"]), f"u{conv}-{t}") for t in turns]
    t = _turns(spark, data)
    for k in (1, 2, 5):
        for c in (1, 3, 7, 100):
            a = {(r.conv_id, r.turn): r.context_text for r in ctx.context_strings(t, k).collect()}
            b = {(r.conv_id, r.turn): r.context_text for r in ctx.context_strings(t, k, chunk_size=c).collect()}
            assert a == b, (k, c)


def test_context_ranges_render_the_same_texts_from_linear_tables(spark):
    import random
    rnd = random.Random(5)
    data = []
    for conv in range(6):
        for t in sorted(rnd.sample(range(0, 200), rnd.randint(1, 60))):      # gaps in turn numbers
            data.append((conv, t, rnd.choice(["USER", "SYSTEM"]), None if rnd.random() < 0.1 else f"é{conv} " * rnd.randrange(4)))
    t = _turns(spark, data)
    sizes = {}
    for k in (0, 1, 3, 10):
        want = rows(ctx.context_strings(t, k), ["conv_id", "turn", "context_text"])
        for c in (1, 16, 1000):
            chunks, ranges = ctx.context_ranges(t, k, chunk_size=c)
            assert rows(ctx.render_ranges(chunks, ranges), ["conv_id", "turn", "context_text"]) == want, (k, c)
            sizes[c] = chunks.agg(F.sum(F.length("text"))).head()[0]
    # each turn is in one chunk once, whatever the contexts
    once = t.filter("utterance is not null").select(F.length(ctx.speaker_prefix(F.col("speaker"))) + F.length("utterance") + 2)
    assert set(sizes.values()) == {sum(r[0] for r in once.collect())}
    assert rows(ctx.render_ranges(*ctx.context_ranges(t.limit(0)))) == []


def test_long_metrics_take_more_tasks_for_more_input(spark, tmp_path, monkeypatch):
    """A key of 3,000 items, small keys, and a turn without items: counts as by sets, over as many tasks as the input asks for."""
    from turnwise.operators import joins as J
    from turnwise.operators import metrics as M
    items = [("ref", 1, f"a {i}") for i in range(3000)] + [("hyp", 1, f"a {i}") for i in range(1000, 3500)]
    items += [(s, k, f"b {k % 3}") for k in range(2, 60) for s in ("ref", "hyp")] * 2
    turns = [(s, k) for k in [*range(1, 60), 99] for s in ("ref", "hyp")]
    spark.createDataFrame(items, "side string, k long, item string").write.parquet(str(tmp_path / "i"))
    spark.createDataFrame(turns, "side string, k long").write.parquet(str(tmp_path / "t"))
    i, t = spark.read.parquet(str(tmp_path / "i")), spark.read.parquet(str(tmp_path / "t"))
    monkeypatch.setattr(J, "TASK_BYTES", J.input_bytes(i.unionByName(t.withColumn("item", F.lit("")))) // 40)
    m = M.state_metrics_long(i, ["k"], t)
    got = {r["k"]: (r["tp"], r["fp"], r["fn"], r["joint_goal_accuracy"]) for r in m.collect()}
    assert got == {1: (2000, 500, 1000, 0), **{k: (1, 0, 0, 1) for k in range(2, 60)}, 99: (1, 0, 0, 1)}
    assert m.rdd.getNumPartitions() >= 40 > int(spark.conf.get("spark.sql.shuffle.partitions"))
    both = i.join(t, ["side", "k"])
    assert J.input_bytes(both) == J.input_bytes(i) + J.input_bytes(t) < J.planned_bytes(both)
