"""File sources on hand-made files shaped like the documented formats, sinks, and the
streaming twins (must equal the batch operators)."""

import json
import os
import tempfile

import pytest
from pyspark.sql import functions as F

from turnwise import schemas as S
from turnwise.operators import sessions as SE
from turnwise.operators import state as ST
from turnwise.sources import files as FL
from turnwise.sources import fixtures as FX
from turnwise.sources import sinks as SK
from turnwise.streaming import sessions as STR

from .conftest import SF_SMALL, rows


def _tmp():
    return tempfile.mkdtemp(prefix="turnwise-test-", dir="/tmp")


def _write(path, obj):
    with open(path, "w", encoding="utf-8") as f:
        json.dump(obj, f, ensure_ascii=False)


STATE = {"belief_state": {"general": {"active_domain": "hotel", "city": "京都"}, "hotel": {"name": None, "area": "north"}},
         "book_state": {"hotel": {"people": "2", "day": None, "stay": None}},
         "db_result": {"candidate_entities": ["inn a", "inn b"],
                       "active_entity": {"name": "inn a", "genre": ["spa", "cheap"], "opentime": [["9", "17"], ["10", "18"]]}},
         "book_result": {"hotel": {"success": None, "ref": None}}}


@pytest.fixture(scope="module")
def corpus():
    d = _tmp()
    dialogues = {
        "d2": {"dialogue_id": 2, "dialogue_name": "d2", "system_name": "s", "user_name": "u",
               "goal": {"hotel": {"info": {"area": "north"}, "fail_info": {"genre": "spa"}, "reqt": ["name"], "book": {"people": "2"}}},
               "goal_description": {"hotel": ["find a hotel", "book it"]},
               "turns": [{"turn_id": 0, "speaker": "USER", "utterance": "hello"},
                         {"turn_id": 1, "speaker": "SYSTEM", "utterance": "hi", "dialogue_state": STATE}]},
        "d1": {"dialogue_id": 1, "dialogue_name": "d1", "system_name": "s", "user_name": "u", "goal": {},
               "goal_description": {}, "turns": [{"turn_id": 0, "speaker": "SYSTEM", "utterance": "welcome"}]},
    }
    _write(os.path.join(d, "dialogues.json"), dialogues)
    _write(os.path.join(d, "split_list.json"), {"train": ["d2"], "dev": [], "test": ["d1", "d2"]})
    _write(os.path.join(d, "ontology.json"), {"general": {}, "hotel": {}, "taxi": {}})
    _write(os.path.join(d, "informable_slots.json"), {"area": [{"value": "north"}, {"value": "south"}]})
    os.makedirs(os.path.join(d, "database"))
    for dom in ["attraction", "hotel", "restaurant", "shopping", "taxi", "weather"]:
        recs = [{"name": f"{dom} 1", "city": "京都", "genre": ["a", "b"], "opentime": [["9", "17"]]},
                {"name": f"{dom} 2", "city": "大阪", "genre": "c"}]
        _write(os.path.join(d, "database", f"{dom}_db.json"), recs)
    return d


def test_read_dialogues_and_turns(spark, corpus):
    dl = FL.read_dialogues(spark, os.path.join(corpus, "dialogues.json"))
    assert [(r.file_pos, r.dialogue_name) for r in dl.orderBy("file_pos").collect()] == [(0, "d2"), (1, "d1")]
    t = FL.explode_turns(dl)
    assert t.count() == 3
    flat = FL.flatten_turns(t).collect()
    assert {r.turn_id for r in flat if r.dialogue_name == "d1"} == {0} and \
        [r.belief_state for r in flat if r.dialogue_name == "d1"] == [None]
    long = FL.state_long(FL.flatten_turns(t))
    from turnwise.schemas import slot_catalogue
    txt = ST.render_state(long, ["dialogue_name", "turn_id"], slot_catalogue(spark)).collect()
    assert [r.state for r in txt] == ["general active_domain hotel, general city 京都, hotel area north, hotel people 2"]
    ent = t.filter(F.col("dialogue_state").isNotNull()).select("dialogue_state.db_result.active_entity").first()[0]
    assert ent["genre"] == '["spa","cheap"]'   # list value kept as its JSON text


def test_read_small_files(spark, corpus):
    sp = FL.read_splits(spark, os.path.join(corpus, "split_list.json"))
    assert rows(sp) == [("test", 0, "d1"), ("test", 1, "d2"), ("train", 0, "d2")]
    dom = FL.read_domains(spark, os.path.join(corpus, "ontology.json"))
    assert [r.domain for r in dom.orderBy("pos").collect()] == ["general", "hotel", "taxi"]
    inf = FL.read_informable(spark, os.path.join(corpus, "informable_slots.json"))
    assert rows(inf) == [("area", "north"), ("area", "south")]


def test_read_entities(spark, corpus):
    e = FL.read_entities(spark, os.path.join(corpus, "database"))
    assert e.count() == 12
    h = [r for r in e.collect() if r.domain == "hotel"]
    first = min(h, key=lambda r: r.entity_pos)
    assert [a.slot for a in first.record] == ["name", "city", "genre", "opentime"]   # attribute order kept
    assert first.attrs["genre"] == ["a", "b"]
    from turnwise.operators.entities import flatten_record
    txt = e.filter(F.col("entity_pos") == first.entity_pos).select(flatten_record(F.col("record"))).first()[0]
    assert txt == '[hotel 1, 京都, [a, b], [[9, 17]]]'
    long = FL.entity_slots_long(e)
    assert long.filter(F.col("slot") == "genre").count() == 18


def test_training_pairs_reader_and_sink(spark):
    d = _tmp()
    pairs = spark.createDataFrame([("train", "in a", "out a"), ("test", "in b", "out b")],
                                  "split string, input_text string, output_text string")
    SK.write_training_jsonl(pairs, os.path.join(d, "pairs"))
    back = FL.read_training_pairs(spark, os.path.join(d, "pairs", "split=train") + "/*.json")
    assert rows(back) == [("in a", "out a")]
    pairs.write.option("header", True).csv(os.path.join(d, "p.csv"))
    assert FL.read_training_pairs(spark, os.path.join(d, "p.csv")).count() == 2
    with pytest.raises(ValueError):
        FL.read_training_pairs(spark, os.path.join(d, "p.txt"))


def test_progress_and_sessions_files(spark):
    d = _tmp()
    with open(os.path.join(d, "log.jsonl"), "w") as f:
        for name, utt in [("a", "old"), ("b", "x"), ("a", "new")]:
            f.write(json.dumps({"dialogue_name": name, "turns": [{"turn_id": 1, "speaker": "SYSTEM", "utterance": utt}]}) + "\n")
    from turnwise.operators.sampling import latest_per_key
    p = FL.read_progress(spark, os.path.join(d, "log.jsonl"))
    latest = {r.dialogue_name: r.turns[0].utterance for r in latest_per_key(p, ["dialogue_name"], "line_no").collect()}
    assert latest == {"a": "new", "b": "x"}
    os.makedirs(os.path.join(d, "sessions"))
    _write(os.path.join(d, "sessions", "s1.json"), {"session_id": "s1", "dialogue_name": "d1", "tod_model_name": "m",
                                                    "subjective_success": True, "eval_scores": ["3", "4", "5"],
                                                    "context": [["USER", "hi"], ["SYSTEM", "hello"]],
                                                    "log": [{"input_text": "hi", "response": "hello", "session_over": False}]})
    s = FL.read_sessions(spark, os.path.join(d, "sessions"))
    r = s.first()
    assert r.session_id == "s1" and r.eval_scores == ["3", "4", "5"] and r.context[1] == ["SYSTEM", "hello"]


def _stream_from(spark, df, d):
    """Write ``df`` (already partitioned by key: one key per file) and stream one file per
    micro-batch."""
    src = os.path.join(d, "src")
    df.write.parquet(src)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(src)


def test_session_fold_stream_equals_batch(spark):
    inp = FX.v_session_inputs(spark, SF_SMALL)
    d = _tmp()
    # one session's inputs must arrive in order across micro-batches: split by session
    stream = _stream_from(spark, inp.repartition(3, "session_id"), d)
    out = STR.session_fold_stream(stream, 6, answer="answer")
    q = out.writeStream.format("memory").queryName("fold_stream").outputMode("append") \
        .option("checkpointLocation", os.path.join(d, "ckpt")).start()
    q.processAllAvailable()
    q.stop()
    cols = ["session_id", "seq", "status", "ends_session", "response"]
    folded = SE.session_fold(inp, 6, answer="answer")
    assert rows(spark.table("fold_stream"), cols) == rows(folded, cols)
    # the log holds the exchanges, the context the answers without added texts
    logs = {r.session_id: r for r in SE.session_log(folded).collect()}
    for r in folded.filter("status = 'exchange' and ends_session").collect():
        x = logs[r.session_id]
        assert x.log[-1].response == r.answer + S.SESSION_LIMIT_TEXT and x.log[-1].session_over
        assert x.context[-1] == ["SYSTEM", r.answer] and len(x.context) == 2 * len(x.log)


def test_slot_memory_stream_equals_batch(spark):
    from turnwise.plans.queries_state import EV_SLOTS, _updates_wide
    wide = _updates_wide(spark, SF_SMALL).withColumn("ts", F.col("ts").cast("timestamp"))
    d = _tmp()
    stream = _stream_from(spark, wide.repartition(2, "user_id"), d)
    out = STR.slot_memory_stream(stream, "user_id", ["ts", "event_id"], EV_SLOTS)
    q = out.writeStream.format("memory").queryName("memory_stream").outputMode("append") \
        .option("checkpointLocation", os.path.join(d, "ckpt")).start()
    q.processAllAvailable()
    q.stop()
    cols = ["user_id", "event_id", *EV_SLOTS]
    got = rows(spark.table("memory_stream"), cols)
    want = rows(ST.carry_forward(wide, ["user_id"], ["ts", "event_id"], EV_SLOTS), cols)
    assert got == want


def test_record_renders_null_as_none(spark):
    from turnwise.operators.entities import render_record
    d = _tmp()
    os.makedirs(os.path.join(d, "db"))
    for dom in ["hotel"]:
        _write(os.path.join(d, "db", f"{dom}_db.json"), [{"name": "x", "wifi": None, "genre": ["a"]}])
    e = FL.read_entities(spark, os.path.join(d, "db"), ["hotel"])
    assert e.select(render_record(F.col("record"))).first()[0] == "name x, wifi None, genre [a]"


def test_sinks_round_trip(spark):
    d = _tmp()
    turns = spark.createDataFrame([("a", 3, "SYSTEM", "x"), ("a", 1, "SYSTEM", "y"), ("b", 1, "SYSTEM", "z")],
                                  "dialogue_name string, turn_id int, speaker string, utterance string")
    docs = SK.pack_dialogues(turns)
    SK.write_dialogues(docs, os.path.join(d, "pred"))
    back = {r.dialogue_name: [t.turn_id for t in r.turns] for r in spark.read.json(os.path.join(d, "pred")).collect()}
    assert back == {"a": [1, 3], "b": [1]}
    SK.append_progress(docs, os.path.join(d, "log"), "run1")
    SK.append_progress(docs.filter(F.col("dialogue_name") == "a"), os.path.join(d, "log"), "run2")
    assert spark.read.json(os.path.join(d, "log")).groupBy("run_id").count().count() == 2
    # a later run wins over an earlier, longer one, whatever the files are called
    SK.append_progress(docs.filter(F.col("dialogue_name") == "b").withColumn("turns", F.slice("turns", 1, 0)),
                       os.path.join(d, "log"), "run0")
    from turnwise.operators.sampling import latest_per_key
    log = latest_per_key(FL.read_progress(spark, os.path.join(d, "log")), ["dialogue_name"], "line_no").collect()
    assert {r.dialogue_name: (r.run_id, len(r.turns)) for r in log} == {"a": ("run2", 2), "b": ("run0", 0)}
    scores = spark.createDataFrame([("a", 1, 0.5)], "dialogue_name string, turn_id int, slot_f1 double")
    SK.write_scores_csv(scores, os.path.join(d, "scores"))
    assert spark.read.option("header", True).csv(os.path.join(d, "scores")).first()["slot_f1"] == "0.5"
    sessions = spark.createDataFrame([("s1", ["3", "4", "5"]), ("s2", None)], "session_id string, eval_scores array<string>")
    SK.export_sessions(sessions, os.path.join(d, "done"), os.path.join(d, "open"))
    assert [r.session_id for r in spark.read.json(os.path.join(d, "done")).collect()] == ["s1"]
    assert [r.session_id for r in spark.read.json(os.path.join(d, "open")).collect()] == ["s2"]


def test_score_predictions_end_to_end(spark, corpus):
    from turnwise.plans.jobs import score_predictions
    from turnwise.schemas import slot_catalogue
    d = _tmp()
    pred_state = json.loads(json.dumps(STATE))
    pred_state["belief_state"]["hotel"]["area"] = "south"
    _write(os.path.join(d, "e2e.inference.json"), {
        "d2": {"dialogue_name": "d2", "turns": [{"turn_id": 1, "speaker": "SYSTEM", "utterance": "hi", "dialogue_state": pred_state}]},
        "d1": {"dialogue_name": "d1", "turns": [{"turn_id": 0, "speaker": "SYSTEM", "utterance": "welcome to", "dialogue_state": STATE}]},
    })
    gold = FL.explode_turns(FL.read_dialogues(spark, os.path.join(corpus, "dialogues.json")))
    pred = FL.explode_turns(FL.read_predictions(spark, os.path.join(d, "e2e.inference.json")))
    scores, summary = score_predictions(gold, pred, slot_catalogue(spark))
    got = {r.dialogue_name: (r.joint_goal_accuracy, round(r.slot_f1, 6), round(r.response_bleu, 6)) for r in scores.collect()}
    assert got["d2"] == (0, 0.75, 100.0)        # 3 of 4 items shared; identical one-token response
    assert got["d1"][0] == 0                     # gold turn has no state, the prediction has one
    assert {r.metric for r in summary.collect()} == {"joint_goal_accuracy", "slot_f1", "response_bleu"}
    with pytest.raises(ValueError):
        score_predictions(gold, pred, slot_catalogue(spark), task="xx")


def test_repeated_turn_keys_and_slots_outside_the_catalogue(spark):
    from turnwise.plans.jobs import score_predictions
    from turnwise.schemas import slot_catalogue
    schema = ("dialogue_name string, pos long, turn_id int, speaker string, utterance string, "
              "dialogue_state struct<belief_state:map<string,map<string,string>>,book_state:map<string,map<string,string>>>")
    row = lambda text, slots: ("d", 0, 1, "SYSTEM", text, ({"hotel": slots}, {}))
    gold = spark.createDataFrame([row("one two three four five", {"name": "x", "sauna": "yes"})], schema)
    pred = spark.createDataFrame([row("one two three four five", {"name": "x"}),
                                  row("six seven eight nine ten", {"name": "x", "sauna": "yes"})], schema)
    scores, _ = score_predictions(gold, pred, slot_catalogue(spark))
    got = sorted((r.joint_goal_accuracy, round(r.response_bleu)) for r in scores.collect())
    assert got == [(0, 100), (1, 0)]


def test_entity_values_that_look_like_lists(spark):
    vals = ["[A] inn", '["a","b"]', '["a",["b",["c","d"]]]', "plain", '[]']
    df = spark.createDataFrame([(v,) for v in vals], "v string").select(FL._values_of(F.col("v")).alias("x"))
    assert [r.x for r in df.collect()] == [["[A] inn"], ["a", "b"], ["a", "[b, [c, d]]"], ["plain"], []]


def test_strip_of_unicode_white_space(spark):
    from turnwise.functions import text as TX
    texts = ["\u3000success\u3000", "\xa0a b\x1c", "\u2003", " x\u200b ", "a\u3000b\x85c"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    rows = df.select("t", TX.py_strip(F.col("t")).alias("s"), TX.ws_tokens(F.col("t")).alias("w")).collect()
    assert [(r.s, r.w) for r in rows] == [(t.strip(), t.split()) for t in texts]


def test_guarded_model_in_a_job(spark):
    from turnwise.plans import jobs as J
    from turnwise.plans.queries_text import strict_responder
    df = spark.createDataFrame([(1, " fine "), (2, "a@b")], "k long, t string")
    out = J.call_with_errors(J.run_predictor(df, "t", "raw", J.guarded(strict_responder)), "raw", "error")
    got = {r.k: (r.prediction, r.error, r.attempts) for r in out.collect()}
    assert got == {1: ("fine", None, 1), 2: ("Error: ValueError: address in text", "ValueError: address in text", 1)}


def test_dialogues_as_json_lines_and_parquet(spark, corpus):
    want = FL.read_dialogues(spark, os.path.join(corpus, "dialogues.json"))
    d = _tmp()
    want.coalesce(1).write.json(os.path.join(d, "a.jsonl"))
    FL.ingest_dialogues(spark, os.path.join(corpus, "dialogues.json"), os.path.join(d, "b.parquet"), 2)
    for name in ("a.jsonl", "b.parquet"):
        got = FL.read_dialogues(spark, os.path.join(d, name))
        cols = ["file_pos", "dialogue_name", "dialogue_id", "turns"]
        assert got.columns == want.columns and rows(got, cols) == rows(want, cols)
    with pytest.raises(ValueError):
        FL.read_dialogues(spark, os.path.join(d, "c.txt"))
