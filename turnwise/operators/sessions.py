"""Evaluation sessions as batch jobs: phrase checks, the session fold, scores, reports,
exports and transcripts. The streaming twin of the fold is in ``turnwise.streaming``."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import schemas as S
from ..functions.text import phrase_equals


def transcript_csv(turns: DataFrame, scores: DataFrame, key: str = "session_id", order: str = "turn") -> DataFrame:
    """Flat transcript per session: "talker,utterance\\r\\n" lines, then each score followed by
    ','. A session is bounded by its turn limit, so its lines fit one row."""
    talker = F.when(F.col("speaker") == "USER", F.lit(S.TRANSCRIPT_USER)).otherwise(F.lit(S.TRANSCRIPT_SYSTEM))
    line = F.concat(talker, F.lit(","), F.col("utterance"), F.lit("\r\n"))
    g = turns.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), line.alias("l")))).alias("_l"))
    j = g.join(scores.select(key, "scores"), key, "left")
    score_line = F.coalesce(F.array_join(F.transform("scores", lambda s: F.concat(s, F.lit(","))), ""), F.lit(""))
    return j.select(key, F.concat(F.array_join(F.transform("_l", lambda x: x["l"]), ""), score_line).alias("csv_text"))


def goal_min_turns(goals: DataFrame, key: str, desc: str = "desc") -> DataFrame:
    """Tasks of a goal = description items over all domains; minimum turns = 2 x tasks.

    ``desc`` is ``array<struct<domain, items>>``, a goal's description in one row: no shuffle."""
    tasks = F.aggregate(desc, F.lit(0), lambda n, x: n + F.size(x["items"]))
    return goals.select(key, (2 * tasks).cast("bigint").alias("min_turns"))


def goal_list(goals: DataFrame, key: str, desc: str = "desc") -> DataFrame:
    """Goal instructions as an ordered HTML list: one ``<li>`` per domain in order, items joined by
    ``<br>``. ``desc`` as in ``goal_min_turns``: a map of one row, so no text is shuffled."""
    ordered = F.array_sort(desc, lambda a, b: F.when(a["domain"] < b["domain"], -1).when(a["domain"] > b["domain"], 1)
                           .otherwise(0))
    li = F.transform(ordered, lambda x: F.concat(F.lit("<li>"), F.array_join(x["items"], "<br>"), F.lit("</li>")))
    return goals.select(key, F.concat(F.lit("<ol>"), F.array_join(li, ""), F.lit("</ol>")).alias("html"))


def phrase_is(text, phrase: str) -> bool:
    """``functions.text.phrase_equals`` of one Python string."""
    return isinstance(text, str) and text.strip().lower() == phrase.lower()


def phrase_flags(inputs: DataFrame, text: str = "input_text", success: str = S.SUCCESS_PHRASE,
                 failure: str = S.FAILURE_PHRASE) -> DataFrame:
    return (inputs.withColumn("is_success", phrase_equals(F.col(text), success))
                  .withColumn("is_failure", phrase_equals(F.col(text), failure)))


def session_fold(inputs: DataFrame, max_turns: int = S.MAX_SESSION_TURNS, key: str = "session_id",
                 seq: str = "seq", text: str = "input_text", answer: str | None = None) -> DataFrame:
    """Batch fold of session inputs (ordered by ``seq``): a success or failure phrase ends the
    session without being logged; any other input is one exchange (user + system turn), and
    the session ends after the exchange that brings the context to ``max_turns`` utterances.
    Inputs after the end are marked ``after_end``.

    With ``answer`` (the column of the system's answers) each row also gets its ``response``: the end
    text for a phrase, the answer for an exchange, with the limit text after it when the exchange
    reaches the limit, and none after the end.

    No running scan over a session: the end is the earliest of (first phrase row) and (the
    m-th exchange row, m = ceil(max_turns / 2)), found with partial aggregation and a
    group-limited ``row_number() <= m`` (each task keeps at most m rows per session).
    """
    m = (max_turns + 1) // 2
    f = phrase_flags(inputs, text)
    phrase = f.filter(F.col("is_success") | F.col("is_failure"))
    first_phrase = phrase.groupBy(key).agg(F.min(seq).alias("_phrase_end"))
    w = Window.partitionBy(key).orderBy(seq)
    mth = (f.filter(~(F.col("is_success") | F.col("is_failure")))
           .withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= m)
           .groupBy(key).agg(F.max(seq).alias("_limit_seq"), F.count(F.lit(1)).alias("_n")))
    mth = mth.select(key, F.when(F.col("_n") >= m, F.col("_limit_seq")).alias("_limit_end"))
    ends = first_phrase.join(mth, key, "full_outer").select(
        key, F.least("_phrase_end", "_limit_end").alias("end_seq"),
        F.when(F.col("_limit_end").isNotNull() & ((F.col("_phrase_end").isNull()) | (F.col("_limit_end") < F.col("_phrase_end"))),
               F.lit("limit")).alias("_limit_reason"))
    j = f.join(ends, key, "left")
    after = F.col("end_seq").isNotNull() & (F.col(seq) > F.col("end_seq"))
    status = (F.when(after, F.lit("after_end"))
               .when(F.col("is_success"), F.lit("success"))
               .when(F.col("is_failure"), F.lit("failure"))
               .otherwise(F.lit("exchange")))
    ends_here = F.coalesce(F.col(seq) == F.col("end_seq"), F.lit(False))
    extra = []
    if answer:
        limit = F.concat(F.col(answer), F.lit(S.SESSION_LIMIT_TEXT))
        extra = [F.when(status.isin("success", "failure"), F.lit(S.SESSION_END_TEXT))
                 .when(status == "exchange", F.when(ends_here, limit).otherwise(F.col(answer))).alias("response")]
    return j.select(key, seq, status.alias("status"), ends_here.alias("ends_session"), *extra,
                    *[c for c in inputs.columns if c not in (key, seq)])


#: What an exchange's log entry holds besides its texts, where the model gives it.
LOG_DETAILS = ("belief_state", "book_state", "db_result", "book_result")


def session_log(folded: DataFrame, key: str = "session_id", seq: str = "seq", text: str = "input_text",
                answer: str = "answer") -> DataFrame:
    """Per session its ``log`` (one entry per exchange) and ``context`` (speaker and utterance, the answers
    without added texts). An entry holds the input, those of ``LOG_DETAILS`` that are columns of ``folded`` (of any
    type, maps too), the response and whether the session is over. Both are bounded by the turn limit."""
    details = [c for c in LOG_DETAILS if c in folded.columns]
    entry = F.struct(F.col(seq).alias("seq"), F.col(text).alias("input_text"), *details, F.col(answer).alias("answer"),
                     "response", F.col("ends_session").alias("session_over"))
    by_seq = lambda a, b: F.when(a["seq"] < b["seq"], -1).when(a["seq"] > b["seq"], 1).otherwise(0)
    g = folded.groupBy(key).agg(F.array_sort(F.collect_list(F.when(F.col("status") == "exchange", entry)), by_seq).alias("_l"))
    pair = lambda who, x: F.array(F.lit(who), x)
    kept = ["input_text", *details, "response", "session_over"]
    return g.select(key, F.transform("_l", lambda x: F.struct(*[x[c].alias(c) for c in kept])).alias("log"),
                    F.flatten(F.transform("_l", lambda x: F.array(pair("USER", x["input_text"]), pair("SYSTEM", x["answer"]))))
                    .alias("context"))


def session_summary(folded: DataFrame, key: str = "session_id", model: str = "model_name") -> DataFrame:
    """One row per session: model, logged exchanges, subjective success, end reason."""
    return folded.groupBy(key).agg(
        F.first(model, ignorenulls=True).alias(model),
        F.count(F.when(F.col("status") == "exchange", 1)).alias("n_exchanges"),
        F.max((F.col("status") == "success") & F.col("ends_session")).alias("success"),
        F.max(F.when(F.col("ends_session"), F.col("status"))).alias("_end"),
    ).withColumn("end_reason", F.when(F.col("_end") == "exchange", F.lit("limit"))
                 .otherwise(F.col("_end"))).drop("_end")


def session_scores(sessions: DataFrame, scores: DataFrame, key: str = "session_id") -> DataFrame:
    """Scores of known sessions; unknown sessions' scores are listed as 'orphan'."""
    s = sessions.select(key).distinct().withColumn("_known", F.lit(True))
    j = s.join(scores, key, "full_outer")
    has = F.col("q1").isNotNull() | F.col("q2").isNotNull() | F.col("q3").isNotNull()
    status = F.when(F.col("_known").isNull(), "orphan").when(has, "scored").otherwise("unscored")
    return j.withColumn("status", status).drop("_known")


def session_report(summary: DataFrame, scores: DataFrame, key: str = "session_id", model: str = "model_name",
                   satisfaction: str = "q3") -> DataFrame:
    """Per model: participants, success %, mean logged exchanges, mean satisfaction (scores
    arrive as text; non-numbers are ignored)."""
    j = summary.join(scores.select(key, satisfaction), key, "left")
    return j.groupBy(F.col(model).alias("model")).agg(
        F.count(F.lit(1)).alias("participants"),
        F.round(F.avg(F.col("success").cast("double")) * 100, 6).alias("success_pct"),
        F.round(F.avg("n_exchanges"), 6).alias("avg_turns"),
        F.round(F.avg(F.expr(f"try_cast({satisfaction} as int)")), 6).alias("avg_satisfaction"))
