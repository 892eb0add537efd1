"""Exact deduplication with a heavy-hitter split.

1. Every text is normalised (each run of ASCII white space becomes one space) and digested with
   SHA-256; ``(id, digest)`` is written once, so the text is not read again for counting.
2. A Misra-Gries summary over the digests (Spark's ``approx_top_k``, a mergeable frequent-items
   sketch with a bounded number of counters) names candidates. Every digest that holds more than
   ``7 / TRACKED`` of the rows is among them; ``HEAVY_SHARE`` lies well above that.
3. The candidates are verified: exact count and smallest id, by a map-side combined aggregate.
   At most ``HEAVY_SHARE`` digests can hold ``1 / HEAVY_SHARE`` of the rows, so the verified
   winners are a bounded broadcast. Rows of these groups that lose are settled where they are read.
4. All other rows (and the heavy winners) go through an ordinary shuffle on the digest. A group
   there holds less than ``1 / HEAVY_SHARE`` of the rows.

Only DataFrame functions are used.

Edge cases: null text counts as empty; rows with equal text and equal id are repeated rows, of
which exactly one stays; a null id sorts after every other id; an empty table gives an empty
result; input columns named like a result column are replaced, all others are carried along.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import documents, materialize, without
from .registry import register

TRACKED = 20_000   # counters of the sketch
CANDIDATES = 4_000  # candidates read from it; more than HEAVY_SHARE groups cannot be heavy
HEAVY_SHARE = 1_000  # a digest with at least 1/HEAVY_SHARE of all rows is heavy

RESULT = ("keep_id", "group_size", "kept", "text_sha256")


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", " ")


def text_digest(text: Column) -> Column:
    return F.sha2(normalised(text), 256)


def heavy_groups(digests: DataFrame, id_col: str) -> DataFrame:
    """Verified heavy digests: ``text_sha256, _heavy_id, _heavy_size`` (at most HEAVY_SHARE rows)."""
    total = digests.count()
    sketch = digests.agg(F.expr(f"approx_top_k(text_sha256, {CANDIDATES}, {TRACKED})").alias("top"))
    candidates = sketch.select(F.explode("top.item").alias("text_sha256"))
    verified = (digests.join(F.broadcast(candidates), "text_sha256")
                .groupBy("text_sha256")
                .agg(F.count(F.lit(1)).alias("_heavy_size"), F.min(id_col).alias("_heavy_id")))
    return verified.filter((F.col("_heavy_size") > 1) & (F.col("_heavy_size") * HEAVY_SHARE >= F.lit(total)))


def mark_duplicates(df: DataFrame, heavy: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """``df`` (with ``text_sha256``) plus ``keep_id, group_size, kept``; columns of ``df`` are carried."""
    d = df.join(F.broadcast(heavy), "text_sha256", "left")
    loses = F.col("_heavy_size").isNotNull() & ~F.col(id_col).eqNullSafe(F.col("_heavy_id"))
    settled = d.filter(loses).withColumns({
        "keep_id": F.col("_heavy_id"), "group_size": F.col("_heavy_size"), "kept": F.lit(False)})
    group = Window.partitionBy("text_sha256")
    ordered = group.orderBy(F.col(id_col).asc_nulls_last())
    rest = d.filter(~loses).withColumns({
        "keep_id": F.coalesce("_heavy_id", F.min(id_col).over(group)),
        "group_size": F.coalesce("_heavy_size", F.count(F.lit(1)).over(group)),
        "kept": F.row_number().over(ordered) == 1})
    return settled.unionByName(rest).drop("_heavy_id", "_heavy_size")


def exact_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                carry_text: bool = True) -> DataFrame:
    """Every row of ``df`` with ``keep_id, group_size, kept, text_sha256``.

    ``carry_text=False`` leaves the other columns out (id and decision only), so that texts are
    read once and never shuffled.
    """
    df = without(df, *RESULT)
    digests = materialize(df.select(F.col(id_col), text_digest(F.col(text_col)).alias("text_sha256")))
    heavy = heavy_groups(digests, id_col)
    source = df.withColumn("text_sha256", text_digest(F.col(text_col))) if carry_text else digests
    return mark_duplicates(source, heavy, id_col)


def drop_exact_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``df`` that stay, with the columns of ``df``: one row per distinct text."""
    marked = exact_dedup(df.withColumn("_row", F.struct(*[df[c] for c in df.columns]))
                         .select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"), "_row"),
                         "_id", "_text")
    return marked.filter("kept").select("_row.*")


@register("op7_exact_dedup", sql=r"""
select doc_id,
       min(doc_id) over (partition by t) as keep_id,
       count(*) over (partition by t) as group_size,
       row_number() over (partition by t order by doc_id nulls last) = 1 as kept,
       sha256(t) as text_sha256
from (select doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') as t from documents)
""")
def op7_exact_dedup(spark, sf_dir):
    return exact_dedup(documents(spark, sf_dir), carry_text=False).select(
        "doc_id", "keep_id", "group_size", "kept", "text_sha256")
