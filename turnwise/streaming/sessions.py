"""Structured Streaming twins of the batch session fold and the slot memory.

Both keep one small state per key (``applyInPandasWithState``): the session fold keeps the
number of logged exchanges and whether the session is over; the slot memory keeps the last
value of every slot. Rows of one micro-batch are sorted by sequence inside the function;
across micro-batches a key's inputs must arrive in order (a documented limit of the source), and the
state of a key stays. ``streaming.events`` takes inputs in any order and removes idle keys. Results equal the batch operators ``operators.sessions.session_fold`` and
``operators.state.carry_forward``.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupStateTimeout

from .. import schemas as S
from ..operators.sessions import phrase_is


def session_fold_stream(inputs: DataFrame, max_turns: int = S.MAX_SESSION_TURNS, key: str = "session_id",
                        seq: str = "seq", text: str = "input_text", answer: str | None = None) -> DataFrame:
    """Per input row: ``(key, seq, status, ends_session[, response])`` with the batch fold's values."""
    out_schema = f"{key} long, {seq} long, status string, ends_session boolean" + (", response string" if answer else "")
    state_schema = "n long, ended boolean"
    names = [key, seq, "status", "ends_session"]

    def response(rows, answers):
        ends = {"success": S.SESSION_END_TEXT, "failure": S.SESSION_END_TEXT, "after_end": None}
        return [ends[r[2]] if r[2] in ends else a + (S.SESSION_LIMIT_TEXT if r[3] else "") for r, a in zip(rows, answers)]

    def fold(k, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        n, ended = state.get if state.exists else (0, False)
        rows = []
        pdf = pd.concat(list(batches)).sort_values(seq)
        for s, t in zip(pdf[seq].tolist(), pdf[text].tolist()):
            if ended:
                rows.append((k[0], s, "after_end", False))
            elif phrase_is(t, S.SUCCESS_PHRASE):
                ended = True
                rows.append((k[0], s, "success", True))
            elif phrase_is(t, S.FAILURE_PHRASE):
                ended = True
                rows.append((k[0], s, "failure", True))
            else:
                n += 1
                ended = 2 * n >= max_turns
                rows.append((k[0], s, "exchange", ended))
        state.update((n, ended))
        out = pd.DataFrame(rows, columns=names)
        if answer:
            out["response"] = pd.Series(response(rows, pdf[answer].tolist()), dtype=object)
        yield out

    return inputs.groupBy(key).applyInPandasWithState(fold, out_schema, state_schema, "append", GroupStateTimeout.NoTimeout)


def slot_memory_stream(updates: DataFrame, key: str, order: Sequence[str], slots: Sequence[str],
                       key_type: str = "long") -> DataFrame:
    """Streaming carry-forward: per update row the memory after it (last non-empty value of
    every slot for the key). Output ``(key, order..., slots...)``; order columns must be
    orderable in pandas."""
    order = list(order)
    cols = ", ".join(f"{s} string" for s in slots)
    order_types = {f.name: f.dataType.simpleString() for f in updates.schema.fields if f.name in order}
    out_schema = f"{key} {key_type}, " + ", ".join(f"{o} {order_types[o]}" for o in order) + f", {cols}"
    state_schema = cols

    def fold(k, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        mem = list(state.get) if state.exists else [None] * len(slots)
        pdf = pd.concat(list(batches)).sort_values(order)
        out = []
        for rec in pdf.itertuples(index=False):
            r = rec._asdict()
            for i, s in enumerate(slots):
                v = r.get(s)
                if isinstance(v, str) and v != "":
                    mem[i] = v
            out.append((k[0], *[r[o] for o in order], *mem))
        state.update(tuple(mem))
        yield pd.DataFrame(out, columns=[key, *order, *slots])

    return updates.groupBy(key).applyInPandasWithState(
        fold, out_schema, state_schema, "append", GroupStateTimeout.NoTimeout)
