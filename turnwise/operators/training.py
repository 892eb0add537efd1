"""Training data: text-to-text pairs, token truncation, padding, vocabulary ids."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import schemas as S
from .ordering import ordinal

#: Rows of ``training_pairs`` for one system turn.
ROWS_PER_TURN = 2


def training_pairs(turns: DataFrame, context_text: Column, state_text: Column, db_text: Column, book_text: Column,
                   response: Column, dst_prefix: str = S.DST_TASK_PREFIX, rg_prefix: str = S.RG_TASK_PREFIX) -> DataFrame:
    """Two rows per system turn from one scan: the DST pair then the RG pair."""
    dst = F.struct(F.lit("dst").alias("task"), F.concat(F.lit(dst_prefix + " "), context_text).alias("input_text"),
                   state_text.alias("output_text"))
    rg_in = F.concat(F.lit(rg_prefix + " "), context_text, F.lit(" " + S.STATE_PREFIX + " "), state_text,
                     F.lit(" " + S.DB_RESULT_PREFIX + " "), db_text, F.lit(" " + S.BOOK_RESULT_PREFIX + " "), book_text)
    rg = F.struct(F.lit("rg").alias("task"), rg_in.alias("input_text"), response.alias("output_text"))
    keep = [c for c in turns.columns]
    return turns.select(*keep, F.inline(F.array(dst, rg)))


def sample_counts(turns: DataFrame, splits: DataFrame, cap: int, key: str = "conv_id") -> DataFrame:
    """``split, n_rows, n_used``: training rows of each split (``training_pairs`` gives ``ROWS_PER_TURN`` for a system
    turn) and how many a run of at most ``cap`` takes. Counts turns; no text is read."""
    n = turns.filter("speaker <> 'USER'").groupBy(key).agg(F.count(F.lit(ROWS_PER_TURN)).alias("_n"))
    return (splits.select(key, "split").join(n, key).groupBy("split")
            .agg((F.sum("_n") * ROWS_PER_TURN).cast("bigint").alias("n_rows"))
            .withColumn("n_used", F.least(F.lit(cap).cast("bigint"), F.col("n_rows"))))


def first_rows(df: DataFrame, n: int, groups: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The first ``n`` rows of each group: the row limit of a training run. Planned with a group limit, so
    a task keeps only its first ``n`` rows of a group."""
    w = Window.partitionBy(*groups).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= n).drop("_rn")


def truncate_left(tokens: Column, n: int) -> Column:
    """Keep the last ``n`` tokens (left truncation)."""
    return F.slice(tokens, F.greatest(F.lit(1), F.size(tokens) - n + 1), n)


def truncate_right(tokens: Column, n: int) -> Column:
    return F.slice(tokens, 1, n)


def pad(ids: Column, n: int, pad_id: int = 0) -> Column:
    return F.concat(ids, F.array_repeat(F.lit(pad_id), F.greatest(F.lit(0), n - F.size(ids))))


def attention_mask(ids: Column, n: int) -> Column:
    return pad(F.array_repeat(F.lit(1), F.size(ids)), n, 0)


def mask_labels(ids: Column, pad_id: int = 0, ignore: int = -100) -> Column:
    return F.transform(ids, lambda x: F.when(x == pad_id, F.lit(ignore)).otherwise(x))


def vocabulary(tokens: DataFrame, token: str = "token", first_id: int = 1) -> DataFrame:
    """``(token, n, id)``: ids by descending count, then token; numbered without a global
    single-task window (range partitioning, see ``ordinal``)."""
    counts = tokens.groupBy(token).agg(F.count(F.lit(1)).alias("n"))
    ranked = ordinal(counts, [F.col("n").desc(), F.col(token)], [], "_rank")
    return ranked.select(token, "n", (F.col("_rank") + first_id).alias("id"))


def token_ids(rows: DataFrame, keys: Sequence[str], tokens: str, vocab: DataFrame, name: str = "ids") -> DataFrame:
    """Map a token array column to ids, keeping order: explode with position, equi-join the
    vocabulary on the token (AQE splits hot tokens), gather back per row."""
    ex = rows.select(*keys, F.posexplode(tokens).alias("_p", "token"))
    j = ex.join(vocab.select("token", "id"), "token")
    g = j.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("_p", "id"))).alias("_ids"))
    out = rows.select(*keys).join(g, list(keys), "left")
    return out.select(*keys, F.coalesce(F.transform("_ids", lambda x: x["id"]),
                                        F.array().cast("array<bigint>")).alias(name))
