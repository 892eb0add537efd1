"""Sinks: dialogue documents, score CSVs, training JSON Lines, session exports, transcripts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def dialogue_summary(turns: DataFrame, key: str = "conv_id") -> DataFrame:
    """Per-dialogue counters, computed with partial aggregation."""
    return turns.groupBy(key).agg(
        F.count(F.lit(1)).alias("n_turns"),
        F.count(F.when(F.col("speaker") == "USER", 1)).alias("n_user"),
        F.count(F.when(F.col("speaker") == "SYSTEM", 1)).alias("n_system"),
        F.sum(F.length("utterance")).cast("bigint").alias("n_chars"),
        F.min("turn").alias("first_turn"), F.max("turn").alias("last_turn"))


def pack_dialogues(turns: DataFrame, key: str = "dialogue_name", order: str = "turn_id") -> DataFrame:
    """Group predicted turns back into one document per dialogue (turns sorted by id).

    A dialogue is bounded by its session turn limit, so one document fits a task.
    """
    cols = [c for c in turns.columns if c != key]
    return turns.groupBy(key).agg(
        F.array_sort(F.collect_list(F.struct(order, *[c for c in cols if c != order]))).alias("turns"))


def write_dialogues(docs: DataFrame, path: str, fmt: str = "json", mode: str = "overwrite") -> None:
    docs.write.mode(mode).format(fmt).save(path)


def append_progress(docs: DataFrame, path: str, run_id: str) -> None:
    """Append finished dialogues to the progress log; Spark's commit protocol replaces a file lock.

    Each line carries ``run_at`` (microseconds at the start of the append), so that readers know
    which run is the later one whatever its file names are."""
    import time
    (docs.withColumn("run_id", F.lit(run_id)).withColumn("run_at", F.lit(time.time_ns() // 1000))
         .write.mode("append").partitionBy("run_id").json(path))


def write_scores_csv(scores: DataFrame, path: str, mode: str = "overwrite") -> None:
    scores.write.mode(mode).option("header", True).csv(path)


def write_training_jsonl(pairs: DataFrame, path: str, mode: str = "overwrite") -> None:
    """One JSON Lines folder per split: ``{input_text, output_text}``; non-ASCII kept as is."""
    (pairs.select("split", "input_text", "output_text")
          .write.mode(mode).partitionBy("split").json(path))


def export_sessions(sessions: DataFrame, finished_path: str, unfinished_path: str, mode: str = "overwrite") -> None:
    """Finished sessions (with scores) and unfinished ones go to two folders."""
    sessions.filter(F.col("eval_scores").isNotNull()).write.mode(mode).json(finished_path)
    sessions.filter(F.col("eval_scores").isNull()).write.mode(mode).json(unfinished_path)
