"""Mixing to target weights with soft domain membership.

1. A classifier (multinomial logistic regression on hashed words, numpy) is trained on a bounded
   sample of the labelled rows of the table it is given (labels of other documents, such as those that
   earlier stages dropped, are left out first): of each domain the ``PER_DOMAIN`` ids with the
   smallest hashes, one text each. It gives every document a posterior over the domains; its intercepts are set
   back from the balanced sample to the shares among those labelled rows.
2. With t_d the words of document d and p_dk its posteriors, the rates r_d solve the nonnegative least
   squares problem  min over r >= 0 of || sum_d r_d t_d p_d - target ||^2  by projected gradient from
   r = 1, in the metric in which document d weighs t_d and the residual is scaled by the inverse of
   sum_d t_d p_d p_d' (a matrix of domains x domains). A gradient is a sum over all documents: each
   round is one distributed aggregate whose result has one number per domain. Rates need no table
   of their own: a document's rate follows from its posteriors and the list of past gradients.
3. ``most`` bounds the rates from above as well (1 by default). Domains with fewer words than their
   target, and only those, have the bound ``repeats`` (``REPEATS`` by default) instead, and a document's
   bound is the mean of its domains' bounds by its posteriors: documents are repeated as far as they
   belong to a scarce domain. A document with rate r is taken floor(r + u) times, u uniform from a
   hash of its row.

The target is a share per domain. Without a bound the total is that of the table; with one it is set
by the domain with the largest share, whose words are all used, but for those in documents that are
thinned for another domain. ``Steps`` holds the words wanted and reached per domain; a target that
the bounds do not allow is met as far as they go, with a warning that names the words.

Edge cases: null text counts as empty, has no words and keeps rate 1; a target for a domain without
labelled rows is left out and the other shares are scaled up; without any labelled row all rates are
1; repeated rows get equal rates and draws; a document counts once for each different label, and an id that repeats is drawn once;
extra columns are carried by ``apply_rates`` and not read otherwise; an empty table gives an empty
result. A text is held whole by one task.
"""

from __future__ import annotations

import warnings
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bytehash import Spans, words
from .common import (documents, labels, materialize, one_text_each, row_slices, small_batches, smallest_hashes,
                     text_buffer)
from .registry import register

BUCKETS = 1 << 15
PER_DOMAIN = 1_500
EPOCHS, RATE, DECAY, SEED = 12, 0.02, 3e-4, 42
ROUNDS, TOLERANCE, GAIN = 25, 1e-3, 1e-4
SLICE_ROWS, OUT_BYTES = 2_000, 8 << 20

#: Bound of the rates of a domain that has fewer words than its target.
REPEATS = 128.0

#: Domains of the labelled table, and the shares of words wanted.
TARGETS = {"clean": 0.96, "toxic": 0.02, "junk": 0.02}


def domain_of(quality: Column, toxic: Column) -> Column:
    return (F.when(quality == 0, "junk").when(toxic == 1, "toxic").when(quality == 1, "clean"))


def hashed_words(col: pa.Array):
    """Per slice of rows: row index and bucket of each distinct hashed word, and the words per row."""
    data, off = text_buffer(col)
    for i, j in row_slices(off, rows=SLICE_ROWS):
        d, o = data[off[i]:off[j]], off[i:j + 1] - off[i]
        start, end, first = words(d, o)
        n = np.diff(first)
        bucket = (Spans(d).digest(start, end) % np.uint64(BUCKETS)).astype(np.int64) if len(start) else start
        each = np.unique(np.repeat(np.arange(j - i), n) * BUCKETS + bucket)
        yield each // BUCKETS, each % BUCKETS, n


@dataclass
class Posterior:
    """Weights of the hashed words per domain."""

    domains: list[str]
    weights: np.ndarray   # BUCKETS x domains
    bias: np.ndarray

    def of(self, row: np.ndarray, bucket: np.ndarray, rows: int) -> np.ndarray:
        z = np.stack([np.bincount(row, self.weights[bucket, k], rows) for k in range(len(self.domains))], axis=1)
        z += self.bias
        p = np.exp(z - z.max(axis=1, keepdims=True))
        return p / p.sum(axis=1, keepdims=True)


def train(df: DataFrame, labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Posterior | None:
    """Fit on ``labelled`` (id, domain) joined to the texts of ``df``; None without a labelled text."""
    named = labelled.select(F.col(id_col).alias("id"), "domain").filter("id is not null and domain is not null")
    # sample and counts both describe df: ids alone meet, before any row is chosen
    named = materialize(named.join(df.select(F.col(id_col).alias("id")), "id", "left_semi").distinct())
    counts = {r["domain"]: r["count"] for r in named.groupBy("domain").count().collect()}
    chosen = materialize(smallest_hashes(named, "domain", F.xxhash64("id"), PER_DOMAIN).select("id", "domain"))
    texts = one_text_each(df, chosen.select("id").distinct(), id_col, text_col)
    sample = texts.join(F.broadcast(chosen), "id").select("text", "domain")

    def run(batches):
        for batch in batches:
            at = 0
            for row, bucket, n in hashed_words(batch.column(0)):
                edge = np.searchsorted(row, np.arange(len(n) + 1))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(1).slice(at, len(n)),
                     pa.array([bucket[a:b].astype("<u2").tobytes() for a, b in zip(edge, edge[1:])], pa.binary())],
                    ["domain", "buckets"])
                at += len(n)
    rows = sample.mapInArrow(run, "domain string, buckets binary").collect()
    rows = sorted((r["domain"], bytes(r["buckets"])) for r in rows)
    if not rows:
        return None
    domains = sorted({d for d, _ in rows})
    y = np.array([domains.index(d) for d, _ in rows])
    x = [np.frombuffer(b, "<u2").astype(np.int64) for _, b in rows]
    weights, bias = _fit(x, y, len(domains))
    in_sample = np.bincount(y, minlength=len(domains))
    bias = bias + np.log(np.array([counts[d] for d in domains]) / in_sample)
    return Posterior(domains, weights, bias)


def _fit(x: list[np.ndarray], y: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Adagrad on the cross entropy, in small batches."""
    rng = np.random.default_rng(SEED)
    w, b = np.zeros((BUCKETS, k)), np.zeros(k)
    gw, gb = np.full((BUCKETS, k), 1e-4), np.full(k, 1e-4)
    for _ in range(EPOCHS):
        for at in np.array_split(rng.permutation(len(x)), max(1, len(x) // 32)):
            n = np.array([len(x[i]) for i in at])
            row, bucket = np.repeat(np.arange(len(at)), n), np.concatenate([x[i] for i in at])
            z = np.stack([np.bincount(row, w[bucket, c], len(at)) for c in range(k)], axis=1) + b
            p = np.exp(z - z.max(axis=1, keepdims=True))
            d = p / p.sum(axis=1, keepdims=True)
            d[np.arange(len(at)), y[at]] -= 1
            d /= len(at)
            seen, place = np.unique(bucket, return_inverse=True)
            g = np.stack([np.bincount(place, d[row, c], len(seen)) for c in range(k)], axis=1) + DECAY * w[seen]
            gw[seen] += g * g
            w[seen] -= RATE * g / np.sqrt(gw[seen])
            gb += d.sum(axis=0) ** 2
            b -= RATE * d.sum(axis=0) / np.sqrt(gb)
    return w, b


def memberships(df: DataFrame, model: Posterior, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, n_words, p`` (array of posteriors in the order of ``model.domains``) for every row."""
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches):
        for batch in batches:
            p, n = _posteriors(batch.column(1), model)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n), pa.array(list(p), pa.list_(pa.float64()))], ["id", "n_words", "p"])
    return (df.select(id_col, text_col).mapInArrow(run, f"id {kind}, n_words bigint, p array<double>")
            .withColumnRenamed("id", id_col))


def _posteriors(col: pa.Array, model: Posterior) -> tuple[np.ndarray, np.ndarray]:
    parts = [(model.of(row, bucket, len(n)), n) for row, bucket, n in hashed_words(col)]
    if not parts:
        return np.zeros((0, len(model.domains))), np.zeros(0, np.int64)
    p, n = (np.concatenate(x) for x in zip(*parts))
    return p, n.astype(np.int64)


class Steps(list):
    """Gradient steps, the bound of the rates they were found with (one for all documents, one per domain,
    or None), and the words per domain that were wanted and that the rates reach."""

    def __init__(self, steps=(), most: float | np.ndarray | None = None,
                 wanted: dict[str, float] | None = None, reached: dict[str, float] | None = None):
        super().__init__(steps)
        self.most, self.wanted, self.reached = most, wanted or {}, reached or {}


def _bound(steps: list[np.ndarray], most: float | np.ndarray | None) -> float | np.ndarray | None:
    return steps.most if isinstance(steps, Steps) else most


def rates(p: np.ndarray, n: np.ndarray, steps: list[np.ndarray], most: float | np.ndarray | None) -> np.ndarray:
    """Rates after the given steps: each a gradient step, and the projection to 0 <= r (<= most)."""
    r = np.ones(len(p))
    top = p @ most if isinstance(most, np.ndarray) else most
    for g in steps:
        r = np.clip(r - np.where(n > 0, p @ g, 0.0), 0.0, top)
    return r


def fit_rates(member: DataFrame, domains: list[str], targets: dict[str, float], most: float | None = 1.0,
              repeats: float = REPEATS) -> Steps:
    """The gradient steps whose rates bring the expected words per domain to the targets.

    ``member`` is read once per round, so pass a written table.
    """
    k = len(domains)

    def totals(steps, most):
        def run(batches):
            for batch in batches:
                if batch.num_rows:
                    n = batch.column(0).to_numpy().astype(float)
                    p = batch.column(1).flatten().to_numpy().reshape(-1, k)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(range(k), pa.int32()), pa.array((rates(p, n, steps, most) * n) @ p),
                         pa.array([row for row in (p.T * n) @ p], pa.list_(pa.float64()))], ["k", "total", "cross"])
        sums = member.select("n_words", "p").mapInArrow(run, "k int, total double, cross array<double>")
        found = sums.groupBy("k").agg(F.sum("total").alias("total"), *[
            F.sum(F.col("cross")[i]).alias(f"c{i}") for i in range(k)]).collect()
        total, cross = np.zeros(k), np.zeros((k, k))
        for r in found:
            total[r["k"]] = r["total"]
            cross[r["k"]] = [r[f"c{i}"] for i in range(k)]
        return total, cross

    full, cross = totals([], most)
    share = np.array([targets.get(d, 0.0) for d in domains])
    if not full.sum() or not share.sum():
        return Steps(most=most)
    share /= share.sum()
    main = int(share.argmax())
    scale = np.linalg.pinv(cross + 1e-9 * np.trace(cross) * np.eye(k))

    def solve(bound, reach):
        now, before, steps = full, full[main], []
        while True:
            # the largest domain is asked for all its words; the others follow the words it reaches
            want = share * full.sum() if most is None else share / share[main] * now[main]
            aim = np.minimum(want, reach)
            off = now - aim
            gain, before = abs(now[main] - before), now[main]
            done = np.abs(off).max() <= TOLERANCE * want.sum() and (most is None or gain <= GAIN * want.sum())
            if len(steps) == ROUNDS or done:
                return steps, want, now
            if most is not None:
                off[main] = now[main] - reach[main]
            steps.append(scale @ off)
            now, _ = totals(steps, bound)

    if most is None:
        bound = None
        steps, want, now = solve(None, np.full(k, np.inf))
    else:
        short = share / share[main] * full[main] > full
        while True:
            # one number where no domain is short: no document is repeated
            each = np.where(short, max(most, repeats), most)
            bound = each if short.any() else most
            # with its own bound alone, a domain reaches sum of n p (most + p (bound - most))
            steps, want, now = solve(bound, most * full + (each - most) * np.diag(cross))
            found = (want - now > TOLERANCE * want.sum()) & ~short
            found[main] = False
            if not found.any():
                break
            short |= found
    steps = Steps(steps, bound, dict(zip(domains, want.tolist())), dict(zip(domains, now.tolist())))
    missed = [d for d in domains if abs(steps.wanted[d] - steps.reached[d]) > TOLERANCE * want.sum()]
    if missed:
        warnings.warn("mixing targets not met: " + ", ".join(
            f"{d} wants {steps.wanted[d]:.0f} words and reaches {steps.reached[d]:.0f}" for d in missed), stacklevel=2)
    return steps


def _draw(df: DataFrame) -> Column:
    """Uniform in [0, 1) from a hash of the whole row."""
    h = F.xxhash64(*[F.col(f"`{c}`") for c in df.columns], F.lit(SEED))
    return F.shiftrightunsigned(h, 11).cast("double") / float(1 << 53)


def plan(df: DataFrame, labelled: DataFrame, targets: dict[str, float] | None = None, most: float | None = 1.0,
         id_col: str = "doc_id", text_col: str = "text", repeats: float = REPEATS
         ) -> tuple[Posterior | None, list[np.ndarray], DataFrame | None]:
    """The classifier, the gradient steps, and the written table of memberships."""
    small_batches(df.sparkSession)
    model = train(df, labelled, id_col, text_col)
    if model is None:
        return None, [], None
    member = materialize(memberships(df, model, id_col, text_col).withColumn("u", _draw(df.select(id_col))))
    return model, fit_rates(member, model.domains, targets or TARGETS, most, repeats), member


def with_rates(member: DataFrame, steps: list[np.ndarray], most: float | None = 1.0) -> DataFrame:
    """``member`` plus ``rate`` and ``copies``; ``most`` is for steps that do not come from ``plan``."""
    most = _bound(steps, most)
    kept = [c for c in member.columns]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in member.schema.fields)
    n_at, p_at = kept.index("n_words"), kept.index("p")

    def run(batches):
        for batch in batches:
            n = batch.column(n_at).to_numpy()
            p = batch.column(p_at).flatten().to_numpy().reshape(batch.num_rows, -1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(rates(p, n, steps, most))], [*kept, "rate"])
    return (member.mapInArrow(run, f"{schema}, rate double")
            .withColumn("copies", F.floor(F.col("rate") + F.col("u")).cast("long")))


def apply_rates(df: DataFrame, model: Posterior | None, steps: list[np.ndarray], most: float | None = 1.0,
                id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``df``, each as often as it is taken, all columns, without a shuffle; ``most`` is for
    steps that do not come from ``plan``."""
    most = _bound(steps, most)
    if model is None or not steps:
        return df
    small_batches(df.sparkSession)
    names = df.columns
    at = names.index(text_col)

    def run(batches):
        for batch in batches:
            for i in range(0, batch.num_rows, SLICE_ROWS):
                part = batch.slice(i, SLICE_ROWS)
                p, n = _posteriors(part.column(at), model)
                copies = np.floor(rates(p, n, steps, most) + part.column(len(names)).to_numpy()).astype(np.int64)
                size = np.diff(text_buffer(part.column(at))[1])
                taken = np.repeat(np.arange(part.num_rows), copies)
                # a repeated text is held a few megabytes at a time
                for a, b in row_slices(np.concatenate([[0], np.cumsum(size[taken])]), OUT_BYTES):
                    rows = part.take(pa.array(taken[a:b]))
                    yield pa.RecordBatch.from_arrays(rows.columns[:len(names)], names)
    return df.select("*", _draw(df.select(id_col)).alias("_draw_u")).mapInArrow(run, df.schema)


@register("op8_mixing")
def op8_mixing(spark, sf_dir):
    d = documents(spark, sf_dir)
    named = labels(spark, sf_dir).select("doc_id", domain_of(F.col("quality"), F.col("toxic")).alias("domain"))
    model, steps, member = plan(d, named)
    if model is None:
        return d.select("doc_id", F.lit(0).cast("long").alias("n_words"), F.lit(1.0).alias("rate"),
                        F.lit(1).cast("long").alias("copies"))
    out = with_rates(member, steps)
    p = [F.col("p")[i].alias(f"p_{x}") for i, x in enumerate(model.domains)]
    return out.select("doc_id", "n_words", *p, "rate", "copies")
