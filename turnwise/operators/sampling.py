"""Splits, limits, work partitioning, last-writer-wins, resume and balanced sampling."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def split_members(splits: DataFrame, split: str) -> DataFrame:
    """Dialogues of one split with their stored split position (no global sort needed)."""
    return splits.filter(F.col("split") == split)


def split_assign(splits: DataFrame, turns: DataFrame, key: str = "conv_id", missing: str = "error") -> DataFrame:
    """Join split lists with the corpus. A listed name that the corpus does not have is an error
    (``missing="error"``, raised when the row is read) or a row with ``n_turns`` NULL (``"keep"``)."""
    if missing not in ("error", "keep"):
        raise ValueError("missing must be 'error' or 'keep'")
    sizes = turns.groupBy(key).agg(F.count(F.lit(1)).alias("n_turns"))
    out = splits.join(sizes, key, "left").select("split", "split_pos", key, "n_turns")
    if missing == "keep":
        return out
    unknown = F.raise_error(F.concat(F.lit("dialogue not in the corpus: "), F.col(key).cast("string"))).cast("bigint")
    return out.withColumn("n_turns", F.coalesce("n_turns", unknown))


def split_missing(splits: DataFrame, turns: DataFrame, key: str = "conv_id") -> DataFrame:
    """The listed names that the corpus does not have."""
    return split_assign(splits, turns, key, missing="keep").filter("n_turns is null").drop("n_turns")


def bad_speakers(turns: DataFrame, role: str = "speaker", allowed: Sequence[str] = ("USER", "SYSTEM")) -> DataFrame:
    """Rows whose speaker is neither allowed value (quarantine instead of failing the job)."""
    return turns.filter(~F.col(role).isin(*allowed) | F.col(role).isNull())


def first_n(splits: DataFrame, n: int) -> DataFrame:
    """First ``n`` dialogues of every split in split order: a filter on the stored position."""
    return splits.filter(F.col("split_pos") < n).select("split", "split_pos", "conv_id")


def work_parts(splits: DataFrame, w: int, group: str = "split", pos: str = "split_pos") -> DataFrame:
    """Contiguous near-equal parts (``numpy.array_split``): the first n % w parts get one extra row.

    Part numbers come from the stored position and the group size, so there is no window
    over a whole split. The size table has one row per group.
    """
    if w < 1:
        raise ValueError("w must be >= 1")
    sizes = splits.groupBy(group).agg(F.count(F.lit(1)).alias("_n"))
    n, p = F.col("_n"), F.col(pos)
    q, r = F.floor(n / w), n % w
    big = r * (q + 1)
    part = F.when(p < big, F.floor(p / (q + 1))).otherwise(r + F.floor((p - big) / q))
    return splits.join(sizes, group).withColumn("part", part.cast("bigint")).drop("_n")


def latest_per_key(df: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """Last writer wins per key: the row with the largest ``order`` (partial aggregation, no window)."""
    cols = [c for c in df.columns if c not in keys]
    best = F.max_by(F.struct(*cols), F.col(order)).alias("_best")
    return df.groupBy(*keys).agg(best).select(*keys, "_best.*")


def resume_todo(wanted: DataFrame, finished: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Wanted dialogues not yet in the progress log (left anti join)."""
    return wanted.join(finished.select(*keys), list(keys), "left_anti")


def merge_results(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Union of earlier and new results; new ones override (dict.update)."""
    cols = [c for c in old.columns if c not in keys]
    u = (old.withColumn("origin", F.lit("log")).withColumn("_prio", F.lit(0))
         .unionByName(new.select(*keys, *cols).withColumn("origin", F.lit("run")).withColumn("_prio", F.lit(1))))
    return latest_per_key(u, keys, "_prio").drop("_prio")


def balanced_sample(goal_domains: DataFrame, quota: int, key: str = "pos", domain: str = "domain",
                    order: str | None = None) -> DataFrame:
    """Greedy domain-balanced walk in order, rewritten as a window (exact).

    The walk takes a dialogue iff one of its goal domains is still below quota; that holds iff
    the dialogue is among the first ``quota`` dialogues (in walk order) having that domain.
    ``row_number() <= quota`` per domain is planned with a group limit, so each task keeps only
    its local top ``quota`` rows per domain before the final ranking.
    """
    order = order or key
    if quota <= 0:
        return goal_domains.select(key).limit(0)
    w = Window.partitionBy(domain).orderBy(order, key)
    firsts = (goal_domains.select(key, domain, *([order] if order != key else []))
              .withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= quota))
    return firsts.select(key).distinct()


def domain_counts(goal_domains: DataFrame, sample: DataFrame, domains: DataFrame,
                  key: str = "pos", domain: str = "domain") -> DataFrame:
    """Per-domain counters of the sample (they run past the quota), zero for unseen domains."""
    counted = (goal_domains.join(sample.select(key), key, "left_semi")
               .groupBy(domain).agg(F.count(F.lit(1)).alias("n")))
    return (domains.select(domain).distinct().join(counted, domain, "left")
            .select(domain, F.coalesce(F.col("n"), F.lit(0)).cast("bigint").alias("n")))


def md5_bucket(c, n):
    """Reproducible bucket in [0, n): first 32 bits of md5 of the value's text."""
    h = F.conv(F.substring(F.md5(c.cast("string")), 1, 8), 16, 10).cast("bigint")
    return h % n


def assign_by_hash(requests: DataFrame, choices: DataFrame, key: str, requested: str, choice: str,
                   pos: str) -> DataFrame:
    """Requested choice when it exists, else the choice at position hash(key) % n.

    ``choices`` carries a dense position ``pos`` (0..n-1), so the fallback is an equi-join on
    the position, not a product. Only the count n passes through the driver (one number).
    """
    n = choices.count()
    known = requests.join(choices.select(F.col(choice).alias("_k")), F.col(requested) == F.col("_k"), "left")
    fallback = choices.select(F.col(pos).alias("_p"), F.col(choice).alias("_f"))
    j = known.withColumn("_p", md5_bucket(F.col(key), F.lit(n)) if n else F.lit(None).cast("bigint"))
    j = j.join(fallback, "_p", "left")
    return j.select(key, F.coalesce("_k", "_f").alias(choice),
                    F.when(F.col("_k").isNotNull(), F.lit("selected")).otherwise(F.lit("sampled")).alias("how"))


def pick_known_or_hash(requests: DataFrame, choices: DataFrame, key: str, requested: str, choice: str) -> DataFrame:
    """As ``assign_by_hash`` for a small list of names: positions by sorted name."""
    from .ordering import ordinal
    ranked = ordinal(choices.select(choice).distinct(), [choice], [], "_pos")
    out = assign_by_hash(requests, ranked, key, requested, choice, "_pos")
    return out.withColumn("how", F.when(F.col("how") == "selected", F.lit("requested")).otherwise(F.col("how")))
