"""Sentence BLEU (Papineni et al. 2002) with exponential smoothing and effective order, as
shuffle aggregates.

n-grams of both sides are exploded per pair, counted with partial aggregation, joined on
(pair, n, gram) from the hypothesis side and clipped. Per (pair, n) the clipped matches and
hypothesis totals come out of one more partially aggregated group-by; the score is a column
expression over the four orders. Labelled "BLEU-ws" / "BLEU-char" by tokenizer.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAX_ORDER = 4
LOG_ZERO = -9999999999.0


def _grams_of_order(tokens: Column, n: int) -> Column:
    def gram(i):
        return F.struct(F.lit(n).alias("n"), F.array_join(F.slice(tokens, i + 1, n), " ").alias("gram"))
    return (F.when(F.size(tokens) >= n, F.transform(F.sequence(F.lit(0), F.size(tokens) - n), gram))
             .otherwise(F.array().cast("array<struct<n:int,gram:string>>")))


def ngrams(tokens: Column, max_order: int = MAX_ORDER) -> Column:
    """``array<struct<n, gram>>`` of every n-gram, n = 1..max_order (grams joined by ' ')."""
    return F.flatten(F.array(*[_grams_of_order(tokens, n) for n in range(1, max_order + 1)]))


def ngram_stats(pairs: DataFrame, keys: Sequence[str], hyp_tokens: Column, ref_tokens: Column,
                max_order: int = MAX_ORDER, partitions: int | None = None) -> DataFrame:
    """``(keys, n, matches, total)`` for every order with at least one hypothesis n-gram.

    Pairs are hash-partitioned by their key once (explicit count, so AQE keeps the fan-out
    spread); both sides' n-grams are exploded in one pass and counted with one aggregate on
    (key, n, gram), which that partitioning already satisfies, so no n-gram row is shuffled.
    """
    n_parts = partitions or int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    p = pairs.select(*keys, hyp_tokens.alias("_h"), ref_tokens.alias("_r")).repartition(n_parts, *keys)
    tag = "array<struct<n:int,gram:string,side:int>>"
    grams = F.concat(
        F.transform(ngrams(F.col("_h"), max_order), lambda g: F.struct(g["n"], g["gram"], F.lit(0).alias("side"))).cast(tag),
        F.transform(ngrams(F.col("_r"), max_order), lambda g: F.struct(g["n"], g["gram"], F.lit(1).alias("side"))).cast(tag))
    counts = (p.select(*keys, F.inline(grams))
              .groupBy(*keys, "n", "gram")
              .agg(F.sum(1 - F.col("side")).alias("hc"), F.sum("side").alias("rc"))
              .filter(F.col("hc") > 0))
    return (counts.groupBy(*keys, F.col("n").cast("bigint").alias("n"))
            .agg(F.sum(F.least("hc", "rc")).cast("bigint").alias("matches"), F.sum("hc").cast("bigint").alias("total")))


def sentence_bleu(pairs: DataFrame, keys: Sequence[str], hyp_tokens: Column, ref_tokens: Column,
                  max_order: int = MAX_ORDER, name: str = "bleu") -> DataFrame:
    """0-100 sentence BLEU per pair (every pair of ``pairs`` appears once)."""
    stats = ngram_stats(pairs, keys, hyp_tokens, ref_tokens, max_order)
    wide = stats.groupBy(*keys).agg(*[
        F.sum(F.when(F.col("n") == n, F.col(c))).alias(f"{c[0]}{n}")
        for n in range(1, max_order + 1) for c in ("matches", "total")])
    lens = pairs.select(*keys, F.size(hyp_tokens).alias("hyp_len"), F.size(ref_tokens).alias("ref_len"))
    j = lens.join(wide, list(keys), "left")
    m = [F.coalesce(F.col(f"m{n}"), F.lit(0)) for n in range(1, max_order + 1)]
    t = [F.coalesce(F.col(f"t{n}"), F.lit(0)) for n in range(1, max_order + 1)]
    eff = sum((t[i] > 0).cast("int") for i in range(max_order))
    zeros = F.lit(0)
    logs = []
    for i in range(max_order):
        zeros = zeros + (m[i] == 0).cast("int")
        p = F.when(m[i] == 0, F.lit(100.0) / (F.pow(F.lit(2.0), zeros) * t[i])).otherwise(100.0 * m[i] / t[i])
        logs.append(F.when(t[i] > 0, F.log(p)).otherwise(F.lit(0.0)))
    hl, rl = F.col("hyp_len"), F.col("ref_len")
    bp = F.when(hl >= rl, F.lit(1.0)).when(hl > 0, F.exp(1 - rl / hl)).otherwise(F.lit(0.0))
    any_match = sum(m) > 0
    score = F.when(any_match, bp * F.exp(sum(logs) / eff)).otherwise(F.lit(0.0))
    return j.select(*keys, score.alias(name))


def corpus_bleu(pairs: DataFrame, keys: Sequence[str], hyp_tokens: Column, ref_tokens: Column,
                max_order: int = MAX_ORDER) -> DataFrame:
    """Corpus BLEU (one row): clipped matches and totals summed over all pairs per order,
    lengths summed, exponential smoothing, all orders used (no effective order; an order with
    no n-gram at all contributes log 0). Every step is a partial aggregate."""
    stats = ngram_stats(pairs, keys, hyp_tokens, ref_tokens, max_order)
    zero = F.lit(0).cast("bigint")
    rows = (stats.select("n", "matches", "total", zero.alias("hl"), zero.alias("rl"))
            .unionByName(pairs.select(zero.alias("n"), zero.alias("matches"), zero.alias("total"),
                                      F.size(hyp_tokens).cast("bigint").alias("hl"),
                                      F.size(ref_tokens).cast("bigint").alias("rl"))))
    j = rows.groupBy().agg(*[
        F.sum(F.when(F.col("n") == n, F.col(c))).alias(f"{c[0]}{n}")
        for n in range(1, max_order + 1) for c in ("matches", "total")],
        F.sum("hl").alias("hyp_len"), F.sum("rl").alias("ref_len"))
    m = [F.coalesce(F.col(f"m{n}"), F.lit(0)) for n in range(1, max_order + 1)]
    t = [F.coalesce(F.col(f"t{n}"), F.lit(0)) for n in range(1, max_order + 1)]
    zeros = F.lit(0)
    logs = []
    for i in range(max_order):
        zeros = zeros + (m[i] == 0).cast("int")
        p = F.when(m[i] == 0, F.lit(100.0) / (F.pow(F.lit(2.0), zeros) * t[i])).otherwise(100.0 * m[i] / t[i])
        logs.append(F.when(t[i] > 0, F.log(p)).otherwise(F.lit(LOG_ZERO)))
    hl, rl = F.col("hyp_len"), F.col("ref_len")
    bp = F.when(hl >= rl, F.lit(1.0)).when(hl > 0, F.exp(1 - rl / hl)).otherwise(F.lit(0.0))
    score = F.when(sum(m) > 0, bp * F.exp(sum(logs) / max_order)).otherwise(F.lit(0.0))
    return j.select(score.alias("bleu"), *[F.col(f"m{n}").cast("bigint").alias(f"m{n}") for n in range(1, max_order + 1)],
                    *[F.col(f"t{n}").cast("bigint").alias(f"t{n}") for n in range(1, max_order + 1)])


def corpus_counts(stats: DataFrame, max_order: int = MAX_ORDER) -> DataFrame:
    """Corpus sums of matches and totals per order (input of a corpus-level BLEU)."""
    return stats.groupBy("n").agg(F.sum("matches").alias("matches"), F.sum("total").alias("total"))
