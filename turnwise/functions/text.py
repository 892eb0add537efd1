"""Column functions for dialogue text: contexts, phrases, punctuation, nested values.

All are built from Spark SQL functions (JVM side, code-generated); none calls Python per row.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import schemas as S


# The characters that Python's ``str.strip`` and ``str.split`` take for white space.
SPACE = ("[\\x09-\\x0D\\x1C-\\x20\\x{85}\\x{A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}"
         "\\x{205F}\\x{3000}]")


def py_strip(c: Column) -> Column:
    """Python ``str.strip()``: remove leading and trailing whitespace of any kind."""
    return F.regexp_replace(c, f"^{SPACE}+|{SPACE}+$", "")


def falsy_to_null(c: Column) -> Column:
    """State leaves are strings; '' is falsy like NULL."""
    return F.nullif(c, F.lit(""))


def last_k(arr: Column, k: int) -> Column:
    """Last ``k`` elements of an array; ``k == 0`` keeps all (the ``[-0:]`` rule)."""
    if k < 0:
        raise ValueError("k must be >= 0")
    if k == 0:
        return arr
    return F.slice(arr, F.greatest(F.lit(1), F.size(arr) - F.lit(k) + 1), F.lit(k))


def speaker_prefix(speaker: Column, user_prefix: str = S.USER_PREFIX,
                   system_prefix: str = S.SYSTEM_PREFIX) -> Column:
    return (F.when(speaker == "USER", F.lit(user_prefix))
             .when(speaker == "SYSTEM", F.lit(system_prefix))
             .otherwise(F.raise_error(F.concat(F.lit("unknown speaker: "), F.coalesce(speaker, F.lit("NULL"))))))


def context_text(ctx: Column, k: int = 0, user_prefix: str = S.USER_PREFIX,
                 system_prefix: str = S.SYSTEM_PREFIX) -> Column:
    """Render ``array<struct<speaker, utterance>>`` as "<prefix> utterance" joined by one space."""
    return F.array_join(
        F.transform(last_k(ctx, k), lambda x: F.concat(speaker_prefix(x["speaker"], user_prefix, system_prefix),
                                                        F.lit(" "), x["utterance"])),
        " ")


def phrase_equals(text: Column, phrase: str) -> Column:
    """``text.strip().lower() == phrase.lower()``."""
    return F.lower(py_strip(text)) == F.lit(phrase.lower())


def replace_first(text: Column, old: str, new: str) -> Column:
    """Replace the first occurrence of ``old`` only (JavaScript ``String.replace`` with a string)."""
    at = F.instr(text, old)
    return F.when(at > 0, F.overlay(text, F.lit(new), at, F.lit(len(old)))).otherwise(text)


def punct_normalize(text: Column, all_occurrences: bool = False,
                    pairs: list[tuple[str, str]] = S.PUNCT_REPLACEMENTS) -> Column:
    out = text
    for old, new in pairs:
        out = F.replace(out, F.lit(old), F.lit(new)) if all_occurrences else replace_first(out, old, new)
    return out


def flatten_value(c: Column, depth: int = 1) -> Column:
    """Render a string or nested string array as ``[a, [b, c]]`` (``depth`` = array nesting)."""
    if depth == 0:
        return c
    if depth == 1:
        return F.concat(F.lit("["), F.array_join(c, ", "), F.lit("]"))
    return F.concat(F.lit("["), F.array_join(F.transform(c, lambda x: flatten_value(x, depth - 1)), ", "), F.lit("]"))


def ws_tokens(c: Column) -> Column:
    """Whitespace tokens (``str.split()``): split on runs of whitespace, drop empties."""
    return F.filter(F.split(c, f"{SPACE}+"), lambda t: t != "")


def char_tokens(c: Column) -> Column:
    """Every non-space character as a token (a tokenizer for unsegmented scripts)."""
    return F.filter(F.split(c, ""), lambda t: F.length(F.regexp_replace(t, SPACE, "")) > 0)


def python_bool(c: Column) -> Column:
    """Render BOOLEAN as Python prints it."""
    return F.when(c, F.lit("True")).when(~c, F.lit("False"))
