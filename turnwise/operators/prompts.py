"""Prompt rendering for state tracking and response generation (column expressions).

Instruction templates are data: the defaults below are neutral English texts written for this
project, one per domain, generated from a rule; any other set is loaded as a table
``(domain, kind, text)`` and joined in.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas as S

DOMAINS = list(S.BELIEF_SLOTS)


def default_templates() -> list[tuple[str, str, str]]:
    rows = []
    for d in DOMAINS:
        slots = ", ".join(S.BELIEF_SLOTS[d] + S.BOOK_SLOTS.get(d, []))
        rows.append((d, "state", f"Track the {d} domain of the dialogue below. Answer with 'slot value' items "
                                 f"separated by ', ' using only these slots: {slots}.\n"))
        rows.append((d, "response", f"You are a {d} assistant. Using the dialogue state, the database result and "
                                    f"the booking result, write the next system utterance.\n"))
    return rows


def template_table(spark: SparkSession, rows: list[tuple[str, str, str]] | None = None) -> DataFrame:
    return spark.createDataFrame(rows or default_templates(), "domain string, kind string, text string")


def _examples_block(examples: Column, render_one) -> Column:
    """Numbered examples then the closing line; '' when there are no examples."""
    body = F.array_join(F.transform(examples, lambda e, i: F.concat(
        F.replace(F.lit(S.PROMPT_EXAMPLE_HEADER), F.lit("{i}"), (i + 1).cast("string")), render_one(e))), "")
    return F.when(F.coalesce(F.size(examples), F.lit(0)) > 0,
                  F.concat(body, F.lit(S.PROMPT_EXAMPLES_END))).otherwise(F.lit(""))


def state_prompt(template: Column, context_text: Column, examples: Column | None = None,
                 state_prefix: str = S.STATE_PREFIX) -> Column:
    """Template, optional examples ``array<struct<context_text, state_text>>``, query block."""
    ex = F.lit("") if examples is None else _examples_block(examples, lambda e: F.concat(
        F.lit(S.PROMPT_INPUT), e["context_text"], F.lit("\n" + S.PROMPT_OUTPUT + state_prefix + " "),
        e["state_text"], F.lit("\n")))
    return F.concat(template, ex, F.lit(S.PROMPT_INPUT), context_text,
                    F.lit("\n" + S.PROMPT_OUTPUT + state_prefix + " "))


def response_prompt(template: Column, context_text: Column, state_text: Column, db_text: Column, book_text: Column,
                    examples: Column | None = None) -> Column:
    """Examples are ``array<struct<context_text, state_text, db_text, book_text, response>>``."""
    def block(ctx, st, db, bk):
        return F.concat(ctx, F.lit("\n" + S.STATE_PREFIX + " "), st, F.lit("\n" + S.DB_RESULT_PREFIX + " "), db,
                        F.lit("\n" + S.BOOK_RESULT_PREFIX + " "), bk, F.lit("\n"))
    ex = F.lit("") if examples is None else _examples_block(examples, lambda e: F.concat(
        F.lit(S.PROMPT_INPUT), block(e["context_text"], e["state_text"], e["db_text"], e["book_text"]),
        F.lit(S.PROMPT_OUTPUT + S.SYSTEM_PREFIX + " "), e["response"], F.lit("\n")))
    return F.concat(template, ex, F.lit(S.PROMPT_INPUT), block(context_text, state_text, db_text, book_text),
                    F.lit(S.PROMPT_OUTPUT + S.SYSTEM_PREFIX + " "))
