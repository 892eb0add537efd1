"""Quality classifier from weak labels.

1. Heuristic labellers (``LABELLERS``) look at overlapping sides of a whole text and vote good, bad or
   nothing. All votes of a row are one pattern; rows are counted per pattern, over all rows. There
   are at most 3 ** 7 patterns, whatever the number of rows.
2. Expectation-maximisation on the counted patterns estimates the share of good texts and, for each
   labeller, how often it votes each way on good and on bad texts, and gives each pattern its
   posterior. No human label is used.
3. The posteriors train a hashed linear scorer (logistic regression on byte pairs and on the classes
   of the text's statistics, hashed to ``BUCKETS`` buckets) on a bounded sample: of each of the two
   sides the ``PER_SIDE`` ids with the smallest hashes, one text each.
4. The scorer scores every text; texts below ``THRESHOLD`` are rejected.

Edge cases: a text that is null or has no word is rejected with score 0; texts of few words get few
votes and lean on the scorer; repeated rows get equal results and an id is drawn once, however often
it repeats; with no row at all there is no model
and nothing to score; extra columns of any name are carried by the filter and not read by the
scorer. A text is held whole by one task.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytehash import Spans, mix, words
from .common import documents, materialize, one_text_each, row_slices, small_batches, smallest_hashes, text_buffer
from .registry import register

BUCKETS, STEPS = 4096, 12
PER_SIDE = 1_500
THRESHOLD = 0.5
EM_ROUNDS, EPOCHS, RATE, DECAY, SEED = 60, 30, 0.1, 1e-4, 42
SLICE_ROWS = 512

_KIND = np.zeros(256, np.uint8)  # 1 letter (every byte of a letter beyond ASCII too), 2 digit, 3 symbol, 0 other
_KIND[[*range(65, 91), *range(97, 123), *range(128, 256)]] = 1
_KIND[48:58] = 2
_KIND[[ord(c) for c in "#$%&*+/<=>@[\\]^_`{|}~"]] = 3
_STOP = np.isin(np.arange(256), [ord(c) for c in ".!?"])

STATISTICS = ("symbols", "letters", "repeats", "distinct", "stops", "wordless", "short", "length")


def statistics(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per row the values of STATISTICS, and the number of words."""
    rows = len(off) - 1
    start, end, first = words(data, off)
    n = np.diff(first)
    some = np.maximum(n, 1)
    row = np.repeat(np.arange(rows), n)
    per_row = lambda x: np.bincount(row, x, rows)
    kind = _KIND[data]

    def upto(mask):
        total = np.zeros(len(data) + 1, np.int64)
        np.cumsum(mask, out=total[1:])
        return total
    letters, symbols = upto(kind == 1), upto(kind == 3)
    size = end - start
    inked = np.maximum(per_row(size), 1)
    digest = Spans(data).digest(start, end) if len(start) else np.zeros(0, np.uint64)
    again = np.zeros(len(start), bool)
    again[1:] = (digest[1:] == digest[:-1]) & (row[1:] == row[:-1])
    order = np.lexsort((digest, row))
    new = np.ones(len(order), bool)
    new[1:] = (digest[order][1:] != digest[order][:-1]) | (row[order][1:] != row[order][:-1])
    distinct = np.bincount(row[order][new], minlength=rows)
    in_word = letters[end] - letters[start]
    out = np.stack([
        (symbols[off[1:]] - symbols[off[:-1]]) / inked,
        (letters[off[1:]] - letters[off[:-1]]) / inked,
        per_row(again) / some,
        distinct / np.sqrt(some),
        per_row(_STOP[data[end - 1]]) / some,
        per_row(in_word == 0) / some,
        per_row(size <= 3) / some,
        per_row(size) / some], axis=1)
    return out, n


def labellers(stat: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Votes per row: 1 good, 2 bad, 0 none."""
    s = dict(zip(STATISTICS, stat.T))
    some = n >= 5
    many = n >= 15

    def vote(good, bad):
        return np.where(bad, 2, np.where(good, 1, 0))
    return np.stack([
        vote(some & (s["symbols"] < 0.02), some & (s["symbols"] > 0.08)),
        vote(some & (s["letters"] > 0.90), some & (s["letters"] < 0.80)),
        vote(many & (s["repeats"] < 0.04), many & (s["repeats"] > 0.20)),
        vote(many & (s["distinct"] > 2.2), many & (s["distinct"] < 1.8)),
        vote(many & (s["stops"] > 0.02) & (s["stops"] < 0.4), many & (s["stops"] < 0.01)),
        vote(some & (s["wordless"] < 0.05), some & (s["wordless"] > 0.20)),
        vote(many & (s["short"] > 0.15) & (s["length"] < 12), many & ((s["short"] < 0.03) | (s["length"] > 25))),
    ], axis=1).astype(np.int64) if len(n) else np.zeros((0, 7), np.int64)


def _pattern(votes: np.ndarray) -> np.ndarray:
    return votes @ (3 ** np.arange(votes.shape[1]))


def estimate(patterns: np.ndarray, counts: np.ndarray, labellers_n: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """EM on counted patterns: posterior of good per pattern; per labeller, class and vote its rate among votes."""
    votes = patterns[:, None] // 3 ** np.arange(labellers_n) % 3
    up, down = (votes == 1).sum(axis=1), (votes == 2).sum(axis=1)
    good = (up + 1.0) / (up + 2.0 * down + 2.0)  # to begin with: the share of votes, bad ones doubled
    good[up + down == 0] = 0.5
    rate = np.zeros((labellers_n, 2, 3))
    for _ in range(EM_ROUNDS):
        weight = np.stack([counts * (1 - good), counts * good])
        voted = weight * (up + down > 0)
        prior = (voted.sum(axis=1) + 1.0) / (voted.sum() + 2.0)
        for j in range(labellers_n):
            # a labeller that does not vote says nothing of the class
            rate[j, :, 1:] = np.stack([np.bincount(votes[:, j], w, 3)[1:] for w in weight]) + 0.5
            rate[j, :, 1:] /= rate[j, :, 1:].sum(axis=1, keepdims=True)
            rate[j, :, 0] = 1.0
        log = np.log(prior)[:, None] + sum(np.log(rate[j])[:, votes[:, j]] for j in range(labellers_n))
        good = 1 / (1 + np.exp(np.clip(log[0] - log[1], -500, 500)))
    return good, rate


def features(data: np.ndarray, off: np.ndarray, stat: np.ndarray) -> np.ndarray:
    """Hashed features per row: shares of byte pairs, and one bucket for the class of each statistic."""
    rows = len(off) - 1
    out = np.zeros(rows * BUCKETS, np.float32)
    if len(data) > 1:
        pair = data[:-1].astype(np.uint32) << np.uint32(8) | data[1:]
        bucket = (pair * np.uint32(0x9E3779B1)) >> np.uint32(32 - 12)
        row = np.repeat(np.arange(rows), np.diff(off))[:-1]
        inside = np.ones(len(data) - 1, bool)
        ends = off[1:-1]
        inside[ends[(ends > 0) & (ends < len(data))] - 1] = False  # pairs across two rows
        out += np.bincount((row * BUCKETS + bucket)[inside], minlength=rows * BUCKETS).astype(np.float32)
    out = out.reshape(rows, BUCKETS)
    out *= 20 / np.maximum(np.diff(off), 1)[:, None].astype(np.float32)
    scale = np.array([0.02, 0.03, 0.05, 0.4, 0.03, 0.05, 0.08, 2.0])
    step = np.minimum(stat / scale, STEPS - 1).astype(np.uint64)
    name = mix(np.arange(len(STATISTICS), dtype=np.uint64)[None] * np.uint64(1000) + step) % np.uint64(BUCKETS)
    np.add.at(out, (np.arange(rows)[:, None], name.astype(np.int64)), 0.5)
    return out


class Scorer:
    """Logistic regression on hashed features, fitted to posteriors by Adam."""

    def __init__(self):
        self.w = np.zeros(BUCKETS, np.float32)
        self.b = 0.0

    def fit(self, x: np.ndarray, y: np.ndarray) -> None:
        rng = np.random.default_rng(SEED)
        m, v = np.zeros(BUCKETS + 1), np.zeros(BUCKETS + 1)
        step = 0
        for _ in range(EPOCHS):
            for at in np.array_split(rng.permutation(len(x)), max(1, len(x) // 64)):
                step += 1
                d = (self.probability(x[at]) - y[at]) / len(at)
                g = np.append(x[at].T @ d + DECAY * self.w, d.sum())
                m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
                move = RATE * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.999 ** step)) + 1e-8)
                self.w -= move[:-1].astype(np.float32)
                self.b -= float(move[-1])

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(x @ self.w + self.b, -60, 60)))


def _sliced(col: pa.Array):
    data, off = text_buffer(col)
    for i, j in row_slices(off, rows=SLICE_ROWS):
        d, o = data[off[i]:off[j]], off[i:j + 1] - off[i]
        yield d, o, *statistics(d, o)


def vote(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, pattern, n_words`` for every row; the pattern holds all votes."""
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches):
        for batch in batches:
            parts = [(_pattern(labellers(s, n)), n) for _, _, s, n in _sliced(batch.column(1))]
            pattern, n = (np.concatenate(x) for x in zip(*parts)) if parts else (np.zeros(0, int),) * 2
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(pattern.astype(np.int64)), pa.array(n.astype(np.int64))],
                ["id", "pattern", "n_words"])
    return df.select(id_col, text_col).mapInArrow(run, f"id {kind}, pattern bigint, n_words bigint")


def train(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[Scorer, dict[int, float]] | None:
    """The scorer and the posterior of each vote pattern; None for a table without words."""
    small_batches(df.sparkSession)
    votes = materialize(vote(df, id_col, text_col))
    counted = votes.filter("n_words > 0").groupBy("pattern").count().collect()  # at most 3 ** 7 rows
    if not counted:
        return None
    patterns = np.array([r["pattern"] for r in counted])
    good, _ = estimate(patterns, np.array([r["count"] for r in counted], float))
    posterior = dict(zip(patterns.tolist(), good.tolist()))
    spark = df.sparkSession
    table = F.broadcast(spark.createDataFrame(list(posterior.items()), "pattern bigint, good double"))
    sided = (votes.filter("n_words > 0").join(table, "pattern")
             .select("id", (F.col("good") >= 0.5).alias("side")))
    chosen = smallest_hashes(sided, "side", F.xxhash64("id"), PER_SIDE).select("id").distinct()
    sample = one_text_each(df, chosen, id_col, text_col)

    def run(batches):
        for batch in batches:
            for d, o, s, n in _sliced(batch.column(0)):
                x, pattern = features(d, o, s), _pattern(labellers(s, n)).tolist()
                for i in np.flatnonzero(n > 0).tolist():
                    hot = np.flatnonzero(x[i])
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([posterior[pattern[i]]]), pa.array([hot.astype("<i4").tobytes()]),
                         pa.array([x[i][hot].astype("<f4").tobytes()])], ["good", "at", "value"])
    rows = sample.select("text").mapInArrow(run, "good double, at binary, value binary").collect()
    rows.sort(key=lambda r: (r["good"], bytes(r["at"]), bytes(r["value"])))
    x = np.zeros((len(rows), BUCKETS), np.float32)
    for i, r in enumerate(rows):
        x[i, np.frombuffer(r["at"], "<i4")] = np.frombuffer(r["value"], "<f4")
    scorer = Scorer()
    y = np.array([r["good"] for r in rows])
    scorer.fit(x, y)
    # the sample has both sides alike; the intercept goes back to the shares in the whole table
    counts = np.array([r["count"] for r in counted], float)
    share = lambda p, n: (p @ n + 1) / ((1 - p) @ n + 1)
    scorer.b += float(np.log(share(good, counts) / share(y, np.ones(len(y)))))
    return scorer, posterior


def _scores(col: pa.Array, scorer: Scorer | None) -> tuple[np.ndarray, np.ndarray]:
    """Score and vote pattern per row of a text column."""
    score, pattern = [np.zeros(0)], [np.zeros(0, np.int64)]
    for d, o, s, n in _sliced(col):
        p = scorer.probability(features(d, o, s)) if scorer else np.zeros(len(n))
        score.append(np.where(n > 0, p, 0.0))
        pattern.append(_pattern(labellers(s, n)))
    return np.concatenate(score), np.concatenate(pattern)


def score(df: DataFrame, model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, score, kept, weak_label`` for every row; the weak label is the posterior of its votes."""
    kind = df.schema[id_col].dataType.simpleString()
    small_batches(df.sparkSession)
    scorer, posterior = model or (None, {})

    def run(batches):
        for batch in batches:
            p, pattern = _scores(batch.column(1), scorer)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(p.astype(float)), pa.array(p >= THRESHOLD),
                 pa.array([posterior.get(x) for x in pattern.tolist()], pa.float64())],
                ["id", "score", "kept", "weak_label"])
    return (df.select(id_col, text_col)
            .mapInArrow(run, f"id {kind}, score double, kept boolean, weak_label double")
            .withColumnRenamed("id", id_col))


def keep_good(df: DataFrame, model, text_col: str = "text") -> DataFrame:
    """The rows of ``df`` that the scorer keeps, all columns, without a shuffle."""
    small_batches(df.sparkSession)
    scorer = model[0] if model else None
    at = df.columns.index(text_col)

    def run(batches):
        for batch in batches:
            for i in range(0, batch.num_rows, SLICE_ROWS):
                rows = batch.slice(i, SLICE_ROWS)
                p, _ = _scores(rows.column(at), scorer)
                yield rows.filter(pa.array(p >= THRESHOLD))
    return df.mapInArrow(run, df.schema)


@register("op6_quality_classifier")
def op6_quality_classifier(spark, sf_dir):
    d = documents(spark, sf_dir)
    return score(d, train(d))
