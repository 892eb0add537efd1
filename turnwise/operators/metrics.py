"""Scoring: joint goal accuracy, slot F1, score summaries and per-model averages.

Two equal forms of the state metrics:

* ``state_metrics_long`` works on long-form items ``(key, side, item)``: one shuffle on
  (key, salt of the item) to form the set flags and their counts, one on key to add these up.
  No set is ever gathered into one row, and a hot key is spread over ``ITEM_SALTS`` tasks. Both
  shuffles have as many partitions as the input asks for, so a task's memory does not grow.
* ``state_metrics`` works on two rendered state strings per row with array set functions
  (no shuffle at all); states are bounded by the slot catalogue.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .joins import sized
from .ordering import running_total

ITEM_SEP = ", "
#: Parts of one key's items that are counted apart.
ITEM_SALTS = 256


def f1_from_counts(tp: Column, fp: Column, fn: Column) -> Column:
    """F1 as precision/recall harmonic mean; 0.0 when there is no true positive."""
    tpd = tp.cast("double")
    p = tpd / (tp + fp)
    r = tpd / (tp + fn)
    return F.when(tp == 0, F.lit(0.0)).otherwise(2 * p * r / (p + r))


def state_metrics_long(items: DataFrame, keys: Sequence[str], turns: DataFrame | None = None, side: str = "side",
                       item: str = "item", ref: str = "ref", hyp: str = "hyp") -> DataFrame:
    """Per key on both sides (inner-join semantics): tp, fp, fn, joint_goal_accuracy, slot_f1.

    ``turns`` ``(side, keys)`` tells which turns each side has; a turn without items has the empty
    state, which is the one item '' (as splitting an empty text gives). Without ``turns`` a side
    has a turn if it has items of it."""
    rows = items.select(*keys, side, item)
    if turns is not None:
        rows = rows.unionByName(turns.select(*keys, side, F.lit(None).cast("string").alias(item)))
    rows = sized(rows.withColumn("_salt", F.pmod(F.xxhash64(item), F.lit(ITEM_SALTS)).cast("int")), *keys, "_salt")
    flags = (rows.groupBy(*keys, "_salt", item)
             .agg(F.max((F.col(side) == ref).cast("int")).alias("in_ref"),
                  F.max((F.col(side) == hyp).cast("int")).alias("in_hyp")))
    real = F.col(item).isNotNull().cast("int")
    both, only_hyp, only_ref = (F.col("in_ref") * F.col("in_hyp"), (1 - F.col("in_ref")) * F.col("in_hyp"),
                                F.col("in_ref") * (1 - F.col("in_hyp")))
    no_ref = F.col("_tp") + F.col("_fn") == 0
    no_hyp = F.col("_tp") + F.col("_fp") == 0
    per_salt = flags.groupBy(*keys, "_salt").agg(
        F.sum(both * real).alias("_tp"), F.sum(only_hyp * real).alias("_fp"), F.sum(only_ref * real).alias("_fn"),
        F.max("in_ref").alias("_has_ref"), F.max("in_hyp").alias("_has_hyp"))
    per_key = (sized(per_salt, *keys).groupBy(*keys)
               .agg(*[F.sum(c).alias(c) for c in ("_tp", "_fp", "_fn")], *[F.max(c).alias(c) for c in ("_has_ref", "_has_hyp")])
               .filter((F.col("_has_ref") == 1) & (F.col("_has_hyp") == 1))
               .select(*keys, (F.col("_tp") + (no_ref & no_hyp).cast("int")).alias("tp"),
                       (F.col("_fp") + (~no_ref & no_hyp).cast("int")).alias("fp"),
                       (F.col("_fn") + (no_ref & ~no_hyp).cast("int")).alias("fn")))
    return (per_key
            .withColumn("joint_goal_accuracy", ((F.col("fp") == 0) & (F.col("fn") == 0)).cast("bigint"))
            .withColumn("slot_f1", f1_from_counts(F.col("tp"), F.col("fp"), F.col("fn"))))


def state_items(state: Column, sep: str = ITEM_SEP) -> Column:
    """Distinct items of a rendered state (``set(s.split(", "))``); '' gives ``['']``."""
    return F.array_distinct(F.split(state, _literal_regex(sep)))


def _literal_regex(sep: str) -> str:
    import re
    return re.escape(sep)


def state_metrics(df: DataFrame, ref_col: str, hyp_col: str, sep: str = ITEM_SEP) -> DataFrame:
    """Row-wise metrics from two rendered states (array set functions, no shuffle)."""
    r, h = state_items(F.col(ref_col), sep), state_items(F.col(hyp_col), sep)
    tp = F.size(F.array_intersect(r, h))
    fp = F.size(F.array_except(h, r))
    fn = F.size(F.array_except(r, h))
    return (df.withColumn("tp", tp.cast("bigint")).withColumn("fp", fp.cast("bigint"))
              .withColumn("fn", fn.cast("bigint"))
              .withColumn("joint_goal_accuracy", ((F.col("fp") == 0) & (F.col("fn") == 0)).cast("bigint"))
              .withColumn("slot_f1", f1_from_counts(F.col("tp"), F.col("fp"), F.col("fn"))))


def describe(df: DataFrame, cols: Sequence[str], probs: Sequence[float] = (0.25, 0.5, 0.75)) -> DataFrame:
    """``pandas.DataFrame.describe`` per column, long form, exact linear quantiles.

    Output: metric, n, mean, std (n-1; NULL for one row), min, p25, p50, p75, max.
    The input is reduced once to value counts per metric (partial aggregation) and written
    once; every statistic comes from that table. The standard deviation is two-pass (mean
    first, then squared deviations weighted by counts). Quantiles never gather a column into
    one task: cumulative counts come from a range-partitioned running total, and the needed
    ranks are picked with an equi-join on the metric name against a one-row-per-metric table.
    """
    from .joins import materialize
    long = (df.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("value")) for c in cols])).alias("m"))
        .select("m.*").filter(F.col("value").isNotNull()))
    counts = materialize(long.groupBy("metric", "value").agg(F.count(F.lit(1)).alias("c")))
    first = counts.groupBy("metric").agg(
        F.sum("c").alias("n"), (F.sum(F.col("value") * F.col("c")) / F.sum("c")).alias("mean"),
        F.min("value").alias("min"), F.max("value").alias("max"))
    dev = (counts.join(first.select("metric", "mean"), "metric")
           .groupBy("metric").agg(F.sum(F.col("c") * (F.col("value") - F.col("mean")) ** 2).alias("_ss")))
    basic = first.join(dev, "metric").withColumn(
        "std", F.when(F.col("n") > 1, F.sqrt(F.col("_ss") / (F.col("n") - 1)))).drop("_ss")
    ranked = running_total(counts, ["value"], ["metric"], weight="c", name="before")
    names = [f"p{int(round(p * 100))}" for p in probs]
    # 0-based interpolation positions (n - 1) * p, one row per metric
    need = basic.select("metric", *[
        ((F.col("n") - 1) * F.lit(p)).alias(f"_pos_{nm}") for p, nm in zip(probs, names)])
    picked = ranked.join(need, "metric")
    aggs = []
    for nm in names:
        pos = F.col(f"_pos_{nm}")
        for tag, r in (("lo", F.floor(pos)), ("hi", F.ceil(pos))):
            inside = (r >= F.col("before")) & (r < F.col("before") + F.col("c"))
            aggs.append(F.max(F.when(inside, F.col("value"))).alias(f"_{tag}_{nm}"))
        aggs.append(F.max(pos - F.floor(pos)).alias(f"_frac_{nm}"))
    q = picked.groupBy("metric").agg(*aggs)
    for nm in names:
        lo, hi, fr = F.col(f"_lo_{nm}"), F.col(f"_hi_{nm}"), F.col(f"_frac_{nm}")
        q = q.withColumn(nm, lo + (hi - lo) * fr)
    q = q.select("metric", *names)
    return basic.join(q, "metric").select("metric", F.col("n").cast("bigint").alias("n"), "mean", "std", "min",
                                          *names, "max")


def eval_join(ref: DataFrame, hyp: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Gold x prediction on the turn key; unmatched turns drop out, duplicates multiply."""
    return ref.join(hyp, list(keys), "inner")


def coverage(ref_keys: DataFrame, hyp_keys: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row: keys on each side, matched, missing in predictions, extra in predictions."""
    r = ref_keys.select(*keys).distinct().withColumn("_r", F.lit(1))
    h = hyp_keys.select(*keys).distinct().withColumn("_h", F.lit(1))
    j = r.join(h, list(keys), "full_outer")
    return j.agg(
        F.count("_r").alias("n_ref"), F.count("_h").alias("n_hyp"),
        F.count(F.when(F.col("_r").isNotNull() & F.col("_h").isNotNull(), 1)).alias("n_matched"),
        F.count(F.when(F.col("_h").isNull(), 1)).alias("n_missing"),
        F.count(F.when(F.col("_r").isNull(), 1)).alias("n_extra"))


def model_scores(scores: DataFrame, model_col: str, metrics: dict[str, str], digits: int = 6) -> DataFrame:
    """Average score columns per model (``{output_name: score_column}``)."""
    return scores.groupBy(F.col(model_col).alias("model")).agg(
        F.count(F.lit(1)).alias("n"),
        *[F.round(F.avg(c), digits).alias(name) for name, c in metrics.items()])
