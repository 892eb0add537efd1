"""The predict job against a turn-by-turn loop with the same rule models."""


from turnwise import schemas as S
from turnwise.plans import predict as P

from .test_entities_booking import ENT_ROWS, _entities

BELIEF = {"hotel": ["city", "name", "genre"], "weather": ["city"]}
BOOK = {"hotel": ["people", "day"]}
ALLOWED = {"genre": ["spa", "cheap", "luxury"]}


def state_model(text: str) -> str:
    """The items stand in braces in the last user utterance."""
    if "refuse" in text:
        raise ValueError("no state")
    last = text.rsplit(S.USER_PREFIX, 1)[-1]
    return last[last.find("{") + 1:last.find("}")] if "{" in last else ""


def response_model(text: str) -> str:
    if "fail now" in text:
        raise ValueError("no answer")
    return "  " + text[text.index(S.STATE_PREFIX):] + " "


TURNS = {
    1: ["{hotel city kyoto}", "{hotel genre spa, hotel genre bad, hotel sauna yes}", "{hotel people 2}", "{hotel day mon}", "thanks"],
    2: ["hello", "{hotel genre cheap, hotel city kyoto, broken}", "{hotel people 3, hotel day sun}", "{weather city kyoto}"],
    3: ["{hotel name inn c}", "refuse", "fail now {hotel city osaka}"],
}
GOALS = [(1, "hotel", {"people": "2", "day": "mon"}), (2, "hotel", {"people": "1", "day": "sun"})]


def _walk(conv, users):
    """The memory after each system turn, and the active domain."""
    memory, active, out = {}, None, []
    for i, u in enumerate(users):
        seen = users[max(0, i - 2):i + 1]  # five turns of context hold three user utterances
        raw = "" if any("refuse" in x for x in seen) else u[u.find("{") + 1:u.find("}")] if "{" in u else ""
        for item in raw.split(", "):
            d, s, v = (item.split(" ", 2) + ["", "", ""])[:3]
            if v and s in [*BELIEF.get(d, []), *BOOK.get(d, [])] and (s not in ALLOWED or v in ALLOWED[s]):
                memory[d, s], active = v, d
        out.append((dict(memory), active))
    return out


def test_predict_job(spark):
    rows = []
    for conv, users in TURNS.items():
        for i, u in enumerate(users):
            rows += [(conv, 2 * i, "USER", u), (conv, 2 * i + 1, "SYSTEM", "ok")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, speaker string, utterance string")
    _, ents = _entities(spark)
    goals = spark.createDataFrame(GOALS, "conv_id long, domain string, booking map<string,string>")
    args = (state_model, response_model, BELIEF, BOOK, ents, goals, ALLOWED)
    got = {(r.conv_id, r.turn): r for r in P.predict_turns(turns, *args, k=5).collect()}
    assert len(got) == sum(map(len, TURNS.values()))
    for conv, users in TURNS.items():
        goal = {d: b for c, d, b in GOALS if c == conv}
        for i, (memory, active) in enumerate(_walk(conv, users)):
            r = got[conv, 2 * i + 1]
            want = ", ".join(f"{d} {s} {memory[d, s]}" for d, ss in BELIEF.items() for s in ss if (d, s) in memory)
            assert r.state_text == want, (conv, i)
            state = {}
            for (d, s), v in memory.items():
                if s in BELIEF.get(d, []):
                    state.setdefault(d, {})[s] = v
            assert r.belief_state == state
            n = len([e for e in ENT_ROWS if e[1] == active and memory.get((active, "city"), e[2]) == e[2]
                     and memory.get((active, "genre"), e[4][0]) in e[4]])
            n = 0 if active == "weather" and n > 1 else n
            assert r.db_text.startswith(f"total {n}, ")
            asked = {s: memory.get((active, s)) for s in BOOK.get(active, [])}
            done = bool(asked) and all(asked.values()) and asked == goal.get(active, {})
            assert r.book_text.startswith("hotel success True, hotel ref ") if done else r.book_text == ""
            failed = "fail now" in users[i]
            assert r.response == "Error: ValueError: no answer" if failed else r.response.startswith(S.STATE_PREFIX)
    docs = {r.conv_id: r.turns for r in P.predict_dialogues(turns, *args, k=5).collect()}
    assert {c: [t.turn_id for t in ts] for c, ts in docs.items()} == {c: [2 * i + 1 for i in range(len(u))] for c, u in TURNS.items()}
    assert docs[1][-1].dialogue_state.book_state == {"hotel": {"people": "2", "day": "mon"}}
    assert docs[1][-1].utterance == got[1, 9].response
