"""Row checks in one pass: rows are written once, split into good and quarantined, with a count per rule.

A rule is a condition that a good row meets (NULL counts as not met). The counts are observed metrics of the
same job that writes the rows, so checks add no scan and no job, however many rules there are.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

FAILED, QUARANTINE = "failed_rules", "quarantined"


@dataclass
class Checked:
    """The good rows, the others with ``failed_rules`` (names, in the order of the rules), and the counts."""

    good: DataFrame
    quarantine: DataFrame
    rows: int
    failures: dict[str, int]


def with_failures(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """``df`` plus ``failed_rules`` and ``quarantined``."""
    marks = [F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in rules.items()]
    failed = F.filter(F.array(*marks), lambda x: x.isNotNull()) if marks else F.array().cast("array<string>")
    return df.withColumn(FAILED, failed).withColumn(QUARANTINE, F.size(FAILED) > 0)


def write_checked(df: DataFrame, rules: dict[str, Column], path: str) -> Checked:
    """Write ``df`` to ``path`` (Parquet, good and quarantined rows apart) and count rows and failures on the way."""
    seen = Observation()
    marked = with_failures(df, rules)
    metrics = [F.count(F.when(F.array_contains(FAILED, name), 1)).alias(f"rule {i}") for i, name in enumerate(rules)]
    observed = marked.observe(seen, F.count(F.lit(1)).alias("rows"), *metrics)
    observed.write.mode("error").partitionBy(QUARANTINE).parquet(path)
    spark = df.sparkSession
    back = spark.read.schema(marked.schema).parquet(path)  # either part may be empty
    counts = seen.get
    return Checked(back.filter(~F.col(QUARANTINE)).select(*df.columns),
                   back.filter(QUARANTINE).select(*df.columns, FAILED), counts["rows"],
                   {name: counts[f"rule {i}"] for i, name in enumerate(rules)})
