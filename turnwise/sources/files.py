"""Readers for the dialogue corpus file formats.

Small JSON objects keyed by name (ontology, split lists, allowed values) are read with
``read.text(wholetext=True)`` + ``from_json`` into a map, and exploded with ``posexplode``
so file order becomes an explicit position column. Dialogues and predictions, whose objects can be large,
are split over tasks inside one file (``sources.bigjson``). Corpora come as JSON Lines or Parquet as well,
and ``ingest_dialogues`` writes any of them as Parquet partitioned for the later jobs.
"""

from __future__ import annotations

import os
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import schemas as S
from .bigjson import read_keyed

STR_MAP = T.MapType(T.StringType(), T.StringType())

GOAL_DOMAIN = T.StructType([
    T.StructField("info", STR_MAP), T.StructField("fail_info", STR_MAP),
    T.StructField("reqt", T.ArrayType(T.StringType())), T.StructField("book", STR_MAP),
    T.StructField("fail_book", STR_MAP),
])

DIALOGUE_STATE = T.StructType([
    T.StructField("belief_state", T.MapType(T.StringType(), STR_MAP)),
    T.StructField("book_state", T.MapType(T.StringType(), STR_MAP)),
    T.StructField("db_result", T.StructType([
        T.StructField("candidate_entities", T.ArrayType(T.StringType())),
        # list values stay as their JSON text (rendered later), attribute order is kept
        T.StructField("active_entity", STR_MAP)])),
    T.StructField("book_result", T.MapType(T.StringType(), T.StructType([
        T.StructField("success", T.BooleanType()), T.StructField("ref", T.StringType())]))),
])

TURN = T.StructType([
    T.StructField("turn_id", T.IntegerType()), T.StructField("speaker", T.StringType()),
    T.StructField("utterance", T.StringType()), T.StructField("dialogue_state", DIALOGUE_STATE),
])

DIALOGUE = T.StructType([
    T.StructField("dialogue_id", T.IntegerType()), T.StructField("dialogue_name", T.StringType()),
    T.StructField("system_name", T.StringType()), T.StructField("user_name", T.StringType()),
    T.StructField("goal", T.MapType(T.StringType(), GOAL_DOMAIN)),
    T.StructField("goal_description", T.MapType(T.StringType(), T.ArrayType(T.StringType()))),
    T.StructField("turns", T.ArrayType(TURN)),
])

PREDICTION = T.StructType([
    T.StructField("dialogue_name", T.StringType()), T.StructField("turns", T.ArrayType(TURN)),
])

SESSION = T.StructType([
    T.StructField("session_id", T.StringType()), T.StructField("dialogue_name", T.StringType()),
    T.StructField("goal", T.MapType(T.StringType(), GOAL_DOMAIN)),
    T.StructField("goal_description", T.MapType(T.StringType(), T.ArrayType(T.StringType()))),
    T.StructField("tod_model_name", T.StringType()), T.StructField("subjective_success", T.BooleanType()),
    T.StructField("eval_question_list", T.ArrayType(T.StringType())),
    T.StructField("eval_answer_list", T.ArrayType(T.StringType())),
    T.StructField("eval_scores", T.ArrayType(T.StringType())),
    T.StructField("context", T.ArrayType(T.ArrayType(T.StringType()))),
    T.StructField("log", T.ArrayType(T.StructType([
        T.StructField("input_text", T.StringType()), *DIALOGUE_STATE.fields, T.StructField("response", T.StringType()),
        T.StructField("session_over", T.BooleanType())]))),
])


def _whole(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path, wholetext=True)


def _keyed_object(spark: SparkSession, path: str, value_type: T.DataType) -> DataFrame:
    """``{name: value, ...}`` file -> ``(file_pos, name, value)`` in file order."""
    m = _whole(spark, path).select(F.from_json("value", T.MapType(T.StringType(), value_type)).alias("m"))
    return m.select(F.posexplode(F.map_entries("m")).alias("file_pos", "e")).select(
        F.col("file_pos").cast("bigint"), F.col("e.key").alias("name"), F.col("e.value").alias("value"))


def _with_line_positions(df: DataFrame) -> DataFrame:
    """Add ``_at``, the row's number in the order of file names and places in the files, however Spark packs splits
    into tasks. Row counts per split are summed (one row each); the rows themselves are not shuffled."""
    from ..operators.joins import broadcast_if_small
    d = df.select("*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block"),
                  F.monotonically_increasing_id().alias("_mid"))
    splits = d.groupBy("_file", "_block").agg(F.count(F.lit(1)).alias("_n"), F.min("_mid").alias("_first"))
    earlier = Window.orderBy("_file", "_block").rowsBetween(Window.unboundedPreceding, -1)
    splits = splits.withColumn("_before", F.coalesce(F.sum("_n").over(earlier), F.lit(0)))
    table, _ = broadcast_if_small(splits.select("_file", "_block", "_first", "_before"))
    return d.join(table, ["_file", "_block"]).withColumn("_at", F.col("_before") + F.col("_mid") - F.col("_first")).drop(
        "_file", "_block", "_mid", "_first", "_before")


def read_dialogues(spark: SparkSession, path: str) -> DataFrame:
    """Dialogue corpus: one row per dialogue with its file position (SRC1).

    ``*.json`` is one object keyed by dialogue name; ``*.jsonl`` has one dialogue a line, and ``*.parquet`` one a
    row (a folder of either is read whole). All are split over tasks. The file position is the stored
    ``file_pos``, or else the place in the file, in the order of file names."""
    cols = ["dialogue_name", "dialogue_id", "system_name", "user_name", "goal", "goal_description", "turns"]
    ext = os.path.splitext(path.rstrip("/"))[1].lower()
    if ext in (".jsonl", ".parquet"):
        lines = T.StructType([*DIALOGUE.fields, T.StructField("file_pos", T.LongType())])
        d = spark.read.parquet(path) if ext == ".parquet" else spark.read.schema(lines).json(path)
        d = _with_line_positions(d)
        at = F.coalesce("file_pos", "_at") if "file_pos" in d.columns else F.col("_at")
        return d.select(at.alias("file_pos"), *cols)
    if ext != ".json":
        raise ValueError(f"dialogues must be .json, .jsonl or .parquet, got {path!r}")
    d = read_keyed(spark, path, DIALOGUE)
    return d.select("file_pos", F.col("name").alias("dialogue_name"), *[f"value.{c}" for c in cols[1:]])


def read_predictions(spark: SparkSession, path: str) -> DataFrame:
    """Prediction file of one run and task (SRC6)."""
    d = read_keyed(spark, path, PREDICTION)
    return d.select("file_pos", F.col("name").alias("dialogue_name"), "value.turns")


def explode_turns(dialogues: DataFrame, key: str = "dialogue_name") -> DataFrame:
    """One row per turn with its position in the dialogue (M2)."""
    t = dialogues.select(key, F.posexplode("turns").alias("pos", "t"))
    return t.select(key, F.col("pos").cast("bigint"), "t.turn_id", "t.speaker", "t.utterance", "t.dialogue_state")


def flatten_turns(turns: DataFrame, key: str = "dialogue_name") -> DataFrame:
    """Non-USER turns with belief state, book state and response; a turn without a dialogue
    state gets NULLs (PRJ1)."""
    return turns.filter(F.col("speaker") != "USER").select(
        key, "turn_id", F.col("dialogue_state.belief_state").alias("belief_state"),
        F.col("dialogue_state.book_state").alias("book_state"), F.col("utterance").alias("response"))


def state_long(turns: DataFrame, key: str = "dialogue_name", more: Sequence[str] = ()) -> DataFrame:
    """Belief and book states of flattened turns in long form ``(key, turn_id, more..., kind, domain,
    slot, value)`` (input of ``state.render_state``)."""
    out = None
    for kind in ("belief", "book"):
        col = f"{kind}_state"
        x = (turns.select(key, "turn_id", *more, F.explode_outer(col).alias("domain", "_slots"))
             .select(key, "turn_id", *more, F.lit(kind).alias("kind"), "domain", F.explode_outer("_slots").alias("slot", "value"))
             .filter(F.col("slot").isNotNull()))
        out = x if out is None else out.unionByName(x)
    return out


def read_domains(spark: SparkSession, path: str) -> DataFrame:
    """Ontology keys as ``(domain, pos)`` (SRC2); values are not used."""
    d = _keyed_object(spark, path, T.StringType())
    return d.select(F.col("name").alias("domain"), F.col("file_pos").alias("pos"))


def read_splits(spark: SparkSession, path: str) -> DataFrame:
    """``{split: [names]}`` -> ``(split, split_pos, dialogue_name)`` (SRC3)."""
    d = _keyed_object(spark, path, T.ArrayType(T.StringType()))
    return d.select(F.col("name").alias("split"), F.posexplode("value").alias("split_pos", "dialogue_name")).select(
        "split", F.col("split_pos").cast("bigint"), "dialogue_name")


def read_informable(spark: SparkSession, path: str) -> DataFrame:
    """``{slot: [{value: ...}, ...]}`` -> ``(slot, value)`` (SRC5)."""
    d = _keyed_object(spark, path, T.ArrayType(T.StructType([T.StructField("value", T.StringType())])))
    return d.select(F.col("name").alias("slot"), F.explode("value").alias("v")).select("slot", F.col("v.value").alias("value"))


VALUE_DEPTH = 4


def _is_list(raw):
    """Whether the text is a JSON array; a scalar such as ``[A] inn`` is not."""
    return F.startswith(F.ltrim(raw), F.lit("[")) & F.try_parse_json(raw).isNotNull()


def _render_nested(raw, depth: int):
    """A JSON array printed as ``[a, [b, c]]`` down to ``depth`` levels; other text as it is."""
    if depth == 0:
        return raw
    elems = F.from_json(raw, T.ArrayType(T.StringType()))
    inner = F.array_join(F.transform(elems, lambda x: _render_nested(x, depth - 1)), ", ")
    return F.when(_is_list(raw), F.concat(F.lit("["), inner, F.lit("]"))).otherwise(raw)


def _values_of(raw):
    """Attribute value as an array: a JSON list becomes its elements, a scalar a one-element
    array. An element that is itself a list is rendered once here as "[a, b]" (nested lists
    inside it too, to ``VALUE_DEPTH`` levels), so record rendering prints nested lists the way
    the benchmark does."""
    elems = F.from_json(raw, T.ArrayType(T.StringType()))
    rendered = F.transform(elems, lambda x: _render_nested(x, VALUE_DEPTH - 1))
    return F.when(_is_list(raw), rendered).otherwise(F.array(raw))


def read_entities(spark: SparkSession, db_dir: str, domains: list[str] = S.ENTITY_DOMAINS) -> DataFrame:
    """Entity files ``{domain}_db.json`` (arrays of records) -> one row per entity (SRC4):
    ``(domain, entity_pos, attrs map<slot, array<value>>, record array<struct<slot, values,
    is_list>>)``. ``entity_pos`` = domain index << 32 | row index, so file order holds
    within a domain and positions are unique across domains."""
    parts = []
    for i, dom in enumerate(domains):
        recs = _whole(spark, os.path.join(db_dir, f"{dom}_db.json")).select(
            F.from_json("value", T.ArrayType(STR_MAP)).alias("a"))
        parts.append(recs.select(F.lit(dom).alias("domain"), F.posexplode("a").alias("row", "rec")).select(
            "domain", (F.lit(i).cast("bigint") * (1 << 32) + F.col("row")).alias("entity_pos"), "rec"))
    df = parts[0]
    for p in parts[1:]:
        df = df.unionByName(p)
    entries = F.transform(F.map_entries("rec"), lambda e: F.struct(
        e["key"].alias("slot"), _values_of(e["value"]).alias("values"),
        _is_list(e["value"]).alias("is_list")))
    df = df.select("domain", "entity_pos", entries.alias("record"))
    return df.select("domain", "entity_pos",
                     F.map_from_entries(F.transform("record", lambda a: F.struct(a["slot"], a["values"]))).alias("attrs"),
                     "record")


def entity_slots_long(entities: DataFrame) -> DataFrame:
    """Long form ``(entity_pos, domain, slot, value)`` of an entity table."""
    return entities.select("entity_pos", "domain", F.explode("record").alias("a")).select(
        "entity_pos", "domain", F.col("a.slot").alias("slot"), F.explode("a.values").alias("value"))


def read_progress(spark: SparkSession, path: str) -> DataFrame:
    """Progress log (JSON Lines, one finished dialogue per line) with ``line_no``, a struct that
    orders lines by run time and then by position in the run's files (SRC7); later lines win via
    ``sampling.latest_per_key``. Lines of a log without run times come first."""
    schema = T.StructType([*PREDICTION.fields, T.StructField("run_at", T.LongType())])
    log = _with_line_positions(spark.read.schema(schema).json(path))
    return log.withColumn("line_no", F.struct(F.coalesce("run_at", F.lit(0)).alias("run_at"), F.col("_at").alias("at"))).drop(
        "run_at", "_at")


def read_training_pairs(spark: SparkSession, path: str, input_col: str = "input_text",
                        output_col: str = "output_text") -> DataFrame:
    """Training pairs from CSV (with header) or JSON Lines, chosen by extension (SRC8)."""
    ext = os.path.splitext(path.rstrip("/"))[1].lower()
    if ext == ".csv":
        df = spark.read.option("header", True).option("multiLine", True).csv(path)
    elif ext in (".json", ".jsonl"):
        df = spark.read.json(path)
    else:
        raise ValueError(f"training pairs must be .csv or .json, got {path!r}")
    missing = [c for c in (input_col, output_col) if c not in df.columns]
    if missing:
        raise ValueError(f"columns {missing} not found in {path!r}; have {df.columns}")
    return df.select(F.col(input_col).alias("input_text"), F.col(output_col).alias("output_text"))


def read_sessions(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """Exported sessions with an explicit schema (SRC10): one JSON document per file, or with ``lines`` one a line (as
    ``sinks.export_sessions`` writes them)."""
    return spark.read.schema(SESSION).option("multiLine", not lines).json(path)


def write_index(examples: DataFrame, prefix: str, build_args: dict, counters: DataFrame | None = None) -> None:
    """Example index: Parquet rows + the build arguments as a one-row JSON sidecar, plus the
    per-domain counters (SNK7)."""
    examples.write.mode("overwrite").parquet(f"{prefix}.examples")
    spark = examples.sparkSession
    spark.createDataFrame([build_args]).coalesce(1).write.mode("overwrite").json(f"{prefix}.args")
    if counters is not None:
        counters.write.mode("overwrite").json(f"{prefix}.domain_counter")


def read_index(spark: SparkSession, prefix: str) -> tuple[DataFrame, dict]:
    """Example index and its build arguments (SRC9); the query side must render its context
    with these arguments (KNN2). The sidecar is a single small row."""
    args = spark.read.json(f"{prefix}.args").first().asDict()
    return spark.read.parquet(f"{prefix}.examples"), args


def ingest_dialogues(spark: SparkSession, path: str, out: str, partitions: int | None = None) -> DataFrame:
    """One-time ingestion: JSON corpus -> Parquet hash-partitioned by dialogue name."""
    d = read_dialogues(spark, path)
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    d.repartition(n, "dialogue_name").write.mode("overwrite").parquet(out)
    return spark.read.parquet(out)
