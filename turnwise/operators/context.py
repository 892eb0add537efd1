"""Sliding dialogue contexts (teacher forcing: earlier gold turns, in order).

A context is ``array<struct<speaker, utterance>>`` built by one window partitioned by the
dialogue key. A bounded ``k`` uses a ``ROWS k PRECEDING`` frame, so each row carries at most
``k`` utterances; ``k = 0`` means the whole history (O(turns^2) text per dialogue by nature).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import schemas as S
from ..functions.text import context_text, speaker_prefix


def with_context(turns: DataFrame, k: int = 0, keys: Sequence[str] = ("conv_id",), order: str = "turn",
                 speaker: str = "speaker", utterance: str = "utterance", name: str = "context",
                 chunk_size: int | None = None) -> DataFrame:
    """Add the context of every turn: the ``k`` (0 = all) turns strictly before it.

    With ``chunk_size`` (in units of ``order``, for ``k > 0``) a dialogue is windowed per
    chunk of ``floor(order / chunk_size)``, so a very long dialogue spreads over many tasks:
    the last ``k`` rows of every chunk form a small tails table, a window over the tails of
    the ``k`` previous chunks gives each chunk its carry-in, and each row's context is the
    last ``k`` of (carry-in ++ its in-chunk predecessors). Equal to the plain window.
    """
    if k < 0:
        raise ValueError("k must be >= 0 (0 means the whole history)")
    item = F.struct(F.col(speaker).alias("speaker"), F.col(utterance).alias("utterance"))
    if chunk_size is None or k == 0:
        start = Window.unboundedPreceding if k == 0 else -k
        w = Window.partitionBy(*keys).orderBy(order).rowsBetween(start, -1)
        return turns.withColumn(name, F.collect_list(item).over(w))
    t = turns.withColumn("_chunk", F.floor(F.col(order) / chunk_size))
    w = Window.partitionBy(*keys, "_chunk").orderBy(order)
    t = t.select(*t.columns,
                 F.collect_list(item).over(w.rowsBetween(-k, -1)).alias("_local"),
                 F.collect_list(item).over(w.rowsBetween(-(k - 1), 0)).alias("_tail"),
                 (F.row_number().over(w) == F.count(F.lit(1)).over(Window.partitionBy(*keys, "_chunk"))).alias("_last"))
    wc = Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(-k, -1)
    tails = t.filter("_last").select(*keys, "_chunk", F.flatten(F.collect_list("_tail").over(wc)).alias("_in"))
    j = t.join(tails, [*keys, "_chunk"], "left")
    full = F.concat(F.coalesce(F.col("_in"), F.array().cast(j.schema["_local"].dataType)), F.col("_local"))
    ctx = F.slice(full, F.greatest(F.lit(1), F.size(full) - k + 1), k)
    return j.withColumn(name, ctx).drop("_chunk", "_local", "_tail", "_last", "_in")


def system_turns_with_context(turns: DataFrame, k: int = 0, keys: Sequence[str] = ("conv_id",),
                              order: str = "turn", name: str = "context", chunk_size: int | None = None) -> DataFrame:
    """Every non-USER turn with its context; window first, filter after (earlier system
    utterances stay in the context)."""
    return with_context(turns, k, keys, order, name=name, chunk_size=chunk_size).filter(F.col("speaker") != "USER")


def context_strings(turns: DataFrame, k: int = 0, keys: Sequence[str] = ("conv_id",), order: str = "turn",
                    user_prefix: str = S.USER_PREFIX, system_prefix: str = S.SYSTEM_PREFIX,
                    name: str = "context_text", chunk_size: int | None = None) -> DataFrame:
    """System turns with their rendered context text (bounded frame when ``k > 0``)."""
    out = system_turns_with_context(turns, k, keys, order, name="_ctx", chunk_size=chunk_size)
    return out.withColumn(name, context_text(F.col("_ctx"), 0, user_prefix, system_prefix)).drop("_ctx")


def context_ranges(turns: DataFrame, k: int = 0, keys: Sequence[str] = ("conv_id",), order: str = "turn",
                   user_prefix: str = S.USER_PREFIX, system_prefix: str = S.SYSTEM_PREFIX, chunk_size: int = 64
                   ) -> tuple[DataFrame, DataFrame]:
    """Contexts without their text: every turn is rendered once, and a context is a range of the dialogue's text.

    Returns ``chunks (keys..., chunk, start, text)``, the rendered turns of each ``chunk_size`` units of ``order``
    in one text (numbered from 0 in a dialogue; ``start`` is the place of its first character in the dialogue),
    and for every system turn ``ranges (keys..., order, first_chunk, chunk, first, last)``: its context of the
    ``k`` (0 = all) turns before it is the characters from ``first`` up to ``last``. Both grow with the turns, while
    the texts of full histories grow with their square; ``render_ranges`` makes them where they are needed. Turns
    are unique by ``keys`` and ``order``."""
    if k < 0:
        raise ValueError("k must be >= 0 (0 means the whole history)")
    keys = list(keys)
    piece = F.concat(speaker_prefix(F.col("speaker"), user_prefix, system_prefix), F.lit(" "), F.col("utterance"), F.lit(" "))
    t = turns.select(*keys, order, "speaker", piece.alias("_piece"), F.floor(F.col(order) / chunk_size).alias("_c"))
    t = t.withColumn("_size", F.coalesce(F.length("_piece"), F.lit(0)).cast("long"))
    # one row of numbers per chunk
    sizes = t.groupBy(*keys, "_c").agg(F.sum("_size").alias("_n"))
    w = Window.partitionBy(*keys).orderBy("_c")
    at = sizes.select(*keys, "_c", (F.row_number().over(w) - 1).alias("chunk"),
                      F.coalesce(F.sum("_n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("start"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, "_piece"))), lambda x: x["_piece"]), "")
    chunks = t.groupBy(*keys, "_c").agg(text.alias("text")).join(at, [*keys, "_c"]).select(*keys, "chunk", "start", "text")
    # the place of a turn: in its chunk first, then in the dialogue
    inside = Window.partitionBy(*keys, "_c").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    r = (t.select(*keys, order, "speaker", "_c", F.coalesce(F.sum("_size").over(inside), F.lit(0)).alias("_in"))
         .join(at, [*keys, "_c"]).withColumn("last", F.col("start") + F.col("_in")))
    if k:
        back = Window.partitionBy(*keys).orderBy(order)  # numbers only
        r = r.withColumn("first", F.coalesce(F.lag("last", k).over(back), F.lit(0)))
        r = r.withColumn("first_chunk", F.coalesce(F.lag("chunk", k).over(back), F.lit(0)))
    else:
        r = r.withColumn("first", F.lit(0).cast("long")).withColumn("first_chunk", F.lit(0))
    return chunks, r.filter(F.col("speaker") != "USER").select(*keys, order, "first_chunk", "chunk", "first", "last")


def render_ranges(chunks: DataFrame, ranges: DataFrame, keys: Sequence[str] = ("conv_id",), order: str = "turn",
                  name: str = "context_text") -> DataFrame:
    """``keys..., order, name``: the context texts, equal to ``context_strings``. A turn meets the chunks of its range."""
    keys = list(keys)
    each = ranges.select(*keys, order, "first", "last", F.explode(F.sequence("first_chunk", "chunk")).alias("chunk"))
    j = each.join(chunks, [*keys, "chunk"])
    begin = F.greatest(F.col("first"), F.col("start"))
    size = F.least(F.col("last"), F.col("start") + F.length("text")) - begin
    part = F.col("text").substr((begin - F.col("start") + 1).cast("int"), F.greatest(size, F.lit(0)).cast("int"))
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("chunk", part.alias("p")))), lambda x: x["p"]), "")
    g = j.groupBy(*keys, order).agg(whole.alias("_t"))
    return g.select(*keys, order, F.col("_t").substr(F.lit(1), F.greatest(F.length("_t") - 1, F.lit(0))).alias(name))
