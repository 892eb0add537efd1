"""End-to-end jobs built from the operators: two-step state tracking, response-only and
end-to-end turn jobs, few-shot index build, resume.

Model calls are user functions over pandas batches (``mapInPandas``); the rule-based
predictors used by the registered queries are plain column expressions.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators import state as ST
from ..operators.joins import materialize


def _items(text: Column) -> Column:
    """"slot value, ..." -> array<struct<slot, value, ok>> (``split(" ", 1)`` per item);
    an empty text has no items."""
    parts = F.transform(F.split(F.coalesce(text, F.lit("")), ", "), lambda x: F.split(x, " ", 2))
    arr = F.transform(parts, lambda p: F.struct(F.get(p, 0).alias("slot"), F.get(p, 1).alias("value"),
                                                (F.size(p) == 2).alias("ok")))
    return F.when(F.coalesce(text, F.lit("")) == "", F.array().cast("array<struct<slot:string,value:string,ok:boolean>>")) \
            .otherwise(arr)


def _last_value(items: Column, slot: str, allowed: Sequence[str] | None) -> Column:
    """Last accepted value of ``slot`` in an item array (repeated slot: last wins; a slot
    with an allowed list keeps only listed values)."""
    def keep(it):
        cond = it["ok"] & (it["slot"] == slot)
        if allowed is not None:
            cond = cond & F.array_contains(F.array(*[F.lit(v) for v in allowed]), it["value"])
        return cond
    return F.try_element_at(F.filter(items, keep), F.lit(-1))["value"]


def two_step_state(preds: DataFrame, keys: Sequence[str], order: Sequence[str], domain_slots: dict[str, list[str]],
                   general_text: str = "general_text", domain_text: str = "domain_text",
                   chunk: Column | None = None, allowed: dict[str, list[str]] | None = None,
                   general_slots: Sequence[str] = ("active_domain", "city")) -> DataFrame:
    """Two-step tracking: parse the general-domain prediction, take its active domain
    (falsy -> 'general'), parse the active-domain prediction for that domain, then merge
    into the running memory (carry-forward per slot, reset per key) and render.

    Both predictions are parsed with array expressions per row over the fixed slot catalogue
    (``domain_slots``: belief slots of the non-general domains, in rendering order;
    ``allowed``: the allowed-value lists of restricted slots, a fixed ontology value set), so
    parsing needs no shuffle; only the carry-forward partitions by key.
    """
    allowed = allowed or {}
    g = _items(F.col(general_text))
    d = _items(F.col(domain_text))
    active = F.coalesce(F.nullif(_last_value(g, "active_domain", allowed.get("active_domain")), F.lit("")),
                        F.lit("general"))
    cols = [("general", s) for s in general_slots] + [(dom, s) for dom, ss in domain_slots.items() for s in ss]
    names = [f"{dom}__{s}" for dom, s in cols]
    upd = []
    for (dom, s), n in zip(cols, names):
        from_domain = F.when(F.col("_active") == dom, _last_value(d, s, allowed.get(s)))
        if dom == "general":   # the general update precedes the active-domain update
            v = F.coalesce(from_domain, _last_value(g, s, allowed.get(s)))
        else:
            v = from_domain
        upd.append(v.alias(n))
    wide = preds.withColumn("_active", active).select(*preds.columns, *upd)
    carried = ST.carry_forward(wide, keys, order, names, chunk)
    return carried.withColumn("state", ST.render_wide([(dom, s, n) for (dom, s), n in zip(cols, names)]))


def e2e_rule_response(db: DataFrame, bookings: DataFrame, key: str = "request_id") -> DataFrame:
    """End-to-end turn with a rule-based responder: DB result and booking result of the same
    turn (equi-join on the turn key) rendered into the system response."""
    j = db.join(bookings.select(key, "success", "ref"), key)
    booking = (F.when(F.col("success"), F.concat(F.lit(", booked "), F.col("ref").cast("string")))
                .when(~F.col("success"), F.lit(", booking failed")).otherwise(F.lit("")))
    response = F.concat(F.lit("total "), F.col("total").cast("string"),
                        F.coalesce(F.concat(F.lit(", recommend "), F.col("active_name")), F.lit("")), booking)
    return j.select(key, response.alias("response"))


# ----------------------------------------------------------------------------- model calls

def echo_predictor(texts):
    """Rule responder used by the registered queries: "Re: " + the last user utterance."""
    return "Re: " + texts.fillna("")


def run_predictor(df: DataFrame, input_col: str, output_col: str, predictor) -> DataFrame:
    """Apply a pandas model to Arrow batches (``mapInPandas``).

    ``predictor`` takes a Series of texts and gives a Series of texts, or, like the result of
    ``guarded``, a frame ``value, error, attempts``, which adds these columns (value as
    ``output_col``). It is called once per batch; a model loaded at module level or cached inside
    the function is reused by every batch of the Python worker.
    """
    from pyspark.sql.types import LongType, StringType, StructField, StructType
    extra = [StructField(output_col, StringType())]
    if getattr(predictor, "guarded", False):
        extra += [StructField("error", StringType()), StructField("attempts", LongType())]
    schema = StructType([*df.schema.fields, *extra])

    def fn(batches):
        for pdf in batches:
            out = predictor(pdf[input_col])
            if len(extra) == 1:
                pdf[output_col] = out.astype(object)
            else:
                for name, col in zip([output_col, "error", "attempts"], ["value", "error", "attempts"]):
                    pdf[name] = out[col].to_numpy()
            yield pdf
    return df.mapInPandas(fn, schema)


def guarded(predictor, max_attempts: int = 3, retry_on: tuple = (ConnectionError, TimeoutError),
            base_wait: float = 1.0, most_wait: float = 60.0):
    """Wrap a per-text model call: errors of ``retry_on`` (rate limits, broken connections) are tried
    again after a random exponential wait of at most ``most_wait`` seconds; any other error, and the
    last of these, becomes the row's error instead of failing the job. Returns a pandas function
    ``Series[str] -> DataFrame[value, error, attempts]``, which ``run_predictor`` takes."""
    import random
    import time

    import pandas as pd

    def call(texts):
        values, errors, attempts = [], [], []
        for t in texts:
            value = error = None
            for a in range(1, max_attempts + 1):
                try:
                    value, error = str(predictor(t)).strip(), None
                    break
                except Exception as e:  # noqa: BLE001  the row's error is kept, the job goes on
                    error = f"{type(e).__name__}: {e}"
                    if not isinstance(e, retry_on) or a == max_attempts:
                        break
                    time.sleep(min(most_wait, random.uniform(0, base_wait * (2 ** (a - 1)))))
            values.append(value)
            errors.append(error)
            attempts.append(a)
        return pd.DataFrame({"value": pd.Series(values, dtype=object), "error": pd.Series(errors, dtype=object),
                             "attempts": attempts})
    call.guarded = True
    return call


ANSWERS = "digest string, value string, error string, attempts long"


def ask_all(df: DataFrame, input_col: str, output_col: str, model, store: str, window: int = 16, waves: int = 1,
            **retries) -> DataFrame:
    """``df`` plus ``output_col``, ``error`` and ``attempts``: a slow per-text model asked once per distinct prompt.

    Prompts are reduced to distinct digests, and those that ``store`` (a Parquet folder on shared storage) has an
    answer for are not asked. A task keeps up to ``window`` calls in flight (threads, for models that wait on a
    network) over its batches, so memory is bounded by the window. Answers are committed to ``store`` by Spark's
    own writer in ``waves`` parts: a job that dies goes on after its last wave, and a lost task repeats
    only its part of the running wave. Prompts that ended in an error are asked again by the next run.
    ``retries`` are those of ``guarded``."""
    from pyspark.sql.types import StructType
    spark = df.sparkSession
    spark.createDataFrame([], ANSWERS).write.mode("append").parquet(store)
    call = guarded(model, **retries)

    def answer(batches):
        from collections import deque
        from concurrent.futures import ThreadPoolExecutor

        import pandas as pd
        with ThreadPoolExecutor(max_workers=max(1, window)) as pool:
            flying = deque()

            def landed():
                digest, future = flying.popleft()
                return future.result().assign(digest=digest)[["digest", "value", "error", "attempts"]]
            for pdf in batches:
                for digest, prompt in zip(pdf["digest"], pdf["prompt"]):
                    if len(flying) >= window:
                        yield landed()
                    flying.append((digest, pool.submit(call, pd.Series([prompt], dtype=object))))
            while flying:
                yield landed()

    key = F.sha2(F.coalesce(F.col(input_col), F.lit("")), 256)
    known = spark.read.schema(ANSWERS).parquet(store)
    todo = materialize(df.select(key.alias("digest"), F.coalesce(input_col, F.lit("")).alias("prompt"))
                       .groupBy("digest").agg(F.first("prompt").alias("prompt"))
                       .join(known.filter("error is null").select("digest"), "digest", "left_anti"))
    for wave in range(waves):
        part = todo.filter(F.pmod(F.xxhash64("digest"), F.lit(waves)) == wave)
        part.mapInPandas(answer, StructType.fromDDL(ANSWERS)).write.mode("append").parquet(store)
    best = F.min_by(F.struct(F.col("value").alias(output_col), "error", "attempts"), F.col("error").isNotNull())
    answers = spark.read.schema(ANSWERS).parquet(store).groupBy("digest").agg(best.alias("_a"))
    # the answers are one row per prompt; AQE splits a prompt that very many rows ask
    return df.withColumn("_digest", key).join(answers, F.col("_digest") == F.col("digest"), "left").select(*df.columns, "_a.*")


def call_with_errors(df: DataFrame, raw_col: str, error_col: str, error_as_text: bool = True,
                     name: str = "prediction") -> DataFrame:
    """Keep model output and transport error apart; with ``error_as_text`` the prediction
    becomes "Error: <message>" on failure (what downstream scoring then sees), otherwise NULL.
    Successful outputs are stripped."""
    from ..functions.text import py_strip
    err = F.col(error_col)
    failed = F.concat(F.lit("Error: "), err) if error_as_text else F.lit(None).cast("string")
    return df.withColumn(name, F.when(err.isNotNull(), failed).otherwise(py_strip(F.col(raw_col))))


def rg_turns(turns: DataFrame, predictor, k: int, keys: Sequence[str] = ("conv_id",), order: str = "turn") -> DataFrame:
    """Response-only job: every system turn with its last-k context; the model input is the
    last user utterance of that context; the model runs on Arrow batches."""
    from ..operators.context import system_turns_with_context
    t = system_turns_with_context(turns, k, keys, order)
    last_user = F.try_element_at(F.filter("context", lambda x: x["speaker"] == "USER"), F.lit(-1))["utterance"]
    inp = t.select(*keys, order, last_user.alias("input_text"))
    return run_predictor(inp, "input_text", "prediction", predictor).select(*keys, order, "prediction")


def fewshot_retrieval(index_docs: DataFrame, queries: DataFrame, k: int, key: str = "query_id",
                      doc_key: str = "example_id", text: str = "context_text", embed=None) -> DataFrame:
    """Few-shot example retrieval (KNN1-KNN5): embed index documents and query contexts with
    the same function (the index's own context rendering, see ``read_index``), then exact
    blocked top-k. Returns ``(key, rank, doc_key, dist)``."""
    from ..functions.embed import embed_hashed
    from ..operators.knn import knn_exact
    embed = embed or (lambda df: embed_hashed(df, text))
    docs = embed(index_docs).select(F.col(doc_key).alias("cid"), F.col("embedding").alias("vec"))
    qs = embed(queries).select(F.col(key).alias("qid"), F.col("embedding").alias("vec"))
    out = knn_exact(qs, docs, k, "qid", "cid", "vec")
    return out.select(F.col("qid").alias(key), "rank", F.col("cid").alias(doc_key), "dist")


def query_contexts(turns: DataFrame, args: dict, keys: Sequence[str] = ("conv_id",), order: str = "turn") -> DataFrame:
    """Query contexts rendered as the index's own: number of utterances and speaker prefixes come from the
    build arguments stored beside the index (``sources.files.read_index``)."""
    from .. import schemas as S
    from ..operators.context import context_strings
    return context_strings(turns, int(args["context_turns"]), keys, order,
                           user_prefix=args.get("user_prefix", S.USER_PREFIX),
                           system_prefix=args.get("system_prefix", S.SYSTEM_PREFIX))


def with_examples(queries: DataFrame, index_docs: DataFrame, k: int, key: str = "query_id",
                  doc_key: str = "example_id", embed=None) -> DataFrame:
    """``queries`` with ``examples``, the array that the prompts take: the ``k`` nearest index documents
    in rank order, with their context, state, database, booking and response texts. ``k = 0`` is the
    zero-shot prompt, an empty array."""
    cols = ["context_text", "state_text", "db_text", "book_text", "response"]
    kind = "array<struct<" + ",".join(f"{c}:string" for c in cols) + ">>"
    if k == 0:
        return queries.withColumn("examples", F.array().cast(kind))
    near = fewshot_retrieval(index_docs, queries, k, key, doc_key, embed=embed)
    docs = index_docs.select(doc_key, F.struct(*cols).alias("_e"))
    found = near.join(docs, doc_key).groupBy(key).agg(F.array_sort(F.collect_list(F.struct("rank", "_e"))).alias("_f"))
    return (queries.join(found, key, "left")
            .withColumn("examples", F.coalesce(F.transform("_f", lambda x: x["_e"]), F.array().cast(kind))).drop("_f"))


def score_predictions(gold_turns: DataFrame, pred_turns: DataFrame, catalogue: DataFrame, task: str = "e2e",
                      key: str = "dialogue_name", tokenizer=None) -> tuple[DataFrame, DataFrame]:
    """Scoring job: flattened gold and predicted turns (``sources.files.explode_turns``) ->
    per-turn scores and their summary.

    Non-USER turns of both sides meet in an inner join on (dialogue, turn id); unmatched turns
    drop out, duplicate predictions repeat rows. ``e2e`` scores JGA, slot F1 and BLEU, ``rg``
    only BLEU; any other task is rejected. States are rendered once per side."""
    from ..functions.text import ws_tokens
    from ..operators.bleu import sentence_bleu
    from ..operators.metrics import describe, state_metrics
    from ..sources.files import flatten_turns, state_long
    if task not in ("e2e", "rg"):
        raise ValueError(f"Invalid task name: {task}")
    tok = tokenizer or ws_tokens

    def side(turns, prefix):
        # a turn key may repeat: rows are numbered per key, so that each keeps its own state
        flat = flatten_turns(turns, key).withColumn("_row", F.row_number().over(
            Window.partitionBy(key, "turn_id").orderBy("response", F.to_json("belief_state"), F.to_json("book_state"))))
        rendered = ST.render_state(state_long(flat, key, ["_row"]), [key, "turn_id", "_row"], catalogue, name="state")
        out = flat.select(key, "turn_id", "_row", "response").join(rendered, [key, "turn_id", "_row"], "left")
        return out.select(key, "turn_id", F.col("_row").alias(f"{prefix}row"),
                          F.coalesce("state", F.lit("")).alias(f"{prefix}state"),
                          F.col("response").alias(f"{prefix}response"))

    j = side(gold_turns, "").join(side(pred_turns, "hyp_"), [key, "turn_id"], "inner")
    j = j.withColumn("_pair", F.struct(key, "turn_id", "row", "hyp_row"))
    bleu = sentence_bleu(j.select("_pair", "hyp_response", "response"), ["_pair"],
                         tok(F.col("hyp_response")), tok(F.col("response")), name="response_bleu")
    scored = j.join(bleu, "_pair")
    cols = ["response_bleu"]
    if task == "e2e":
        scored = state_metrics(scored, "state", "hyp_state")
        cols = ["joint_goal_accuracy", "slot_f1", "response_bleu"]
    scores = scored.select(key, "turn_id", *cols)
    return scores, describe(scores, cols)
