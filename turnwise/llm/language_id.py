"""Language identification by a byte convolutional network, trained in numpy.

Bytes are embedded; filters of several widths slide over a window of fixed length; the maximum of
each filter over the window goes through a rectifier to a softmax over the languages. A text is all
its windows; their log probabilities are averaged, weighted by bytes, and normalised again.

Filters move by ``STRIDE`` bytes. Windows do not overlap.

The network is fitted on a bounded sample of labelled rows: per language the ``PER_LANGUAGE`` ids
with the smallest hashes, ``TRAIN_ROWS`` in all (with more than ``TRAIN_ROWS`` languages those that sort
first), and of each three excerpts of different lengths from places that the hash picks. Every text is
then scored whole, in batches of windows, by the tasks.

Edge cases: text that is null or has no letter is ``und`` with score 0; with no labelled row all
texts are; ties of the softmax go to the language that sorts first; a null id counts as the empty string
(held out); an id that repeats is drawn once for a language; repeated rows get equal results
(scores up to the rounding of 32-bit sums);
an empty table gives an empty result; columns beyond id, text and language are not read. A text is
held whole by one task.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import documents, row_slices, small_batches, smallest_hashes, text_buffer
from .registry import register

WINDOW, STRIDE = 256, 2
WIDTHS, FILTERS, EMBEDDING = (2, 3, 4, 5), 12, 6
PER_LANGUAGE, TRAIN_ROWS, EXCERPTS = 600, 60_000, (250, 90, 30)
EPOCHS, BATCH, RATE, SEED = 5, 128, 0.01, 42
WINDOWS_AT_ONCE = 256


def windows(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All windows (zero-padded), the row and the number of bytes of each; an empty row has one."""
    size = np.diff(off)
    n = np.maximum(1, -(-size // WINDOW))
    row = np.repeat(np.arange(len(size)), n)
    start = off[:-1][row] + (np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)) * WINDOW
    held = np.minimum(off[1:][row] - start, WINDOW)
    padded = np.concatenate([data, np.zeros(WINDOW, np.uint8)])
    out = np.lib.stride_tricks.sliding_window_view(padded, WINDOW)[start]
    out[np.arange(WINDOW) >= held[:, None]] = 0
    return out, row, held


class ByteCNN:
    """Embedding, filters of several widths, max pooling, softmax."""

    def __init__(self, languages: list[str], seed: int = SEED):
        rng = np.random.default_rng(seed)
        wide, n = max(WIDTHS), FILTERS * len(WIDTHS)
        self.languages = languages
        #: rows of the filter matrix that a narrower filter does not see stay zero
        self.seen = np.repeat(np.array([[k < w for w in WIDTHS for _ in range(FILTERS)] for k in range(wide)]),
                              EMBEDDING, axis=0).astype(np.float32)
        self.weights = {
            "embedding": rng.normal(0, 0.5, (256, EMBEDDING)).astype(np.float32),
            "filters": (rng.normal(0, 0.3, (wide * EMBEDDING, n)) * self.seen).astype(np.float32),
            "filter_bias": np.zeros(n, np.float32),
            "dense": rng.normal(0, 0.1, (n, len(languages))).astype(np.float32),
            "dense_bias": np.zeros(len(languages), np.float32),
        }
        self.weights["embedding"][0] = 0  # padding

    def _patches(self, x: np.ndarray) -> np.ndarray:
        wide = max(WIDTHS)
        at = np.arange(0, WINDOW - wide + 1, STRIDE)[:, None] + np.arange(wide)
        return self.weights["embedding"][x[:, at]].reshape(len(x), len(at), wide * EMBEDDING)

    def _forward(self, x: np.ndarray):
        w = self.weights
        patches = self._patches(x)
        out = (patches.reshape(-1, patches.shape[2]) @ w["filters"]).reshape(len(x), patches.shape[1], -1)
        return patches, out

    def log_probabilities(self, x: np.ndarray) -> np.ndarray:
        w = self.weights
        parts = []
        for i in range(0, len(x), WINDOWS_AT_ONCE):
            _, out = self._forward(x[i:i + WINDOWS_AT_ONCE])
            z = np.maximum(out.max(axis=1) + w["filter_bias"], 0) @ w["dense"] + w["dense_bias"]
            z -= z.max(axis=1, keepdims=True)
            parts.append(z - np.log(np.exp(z).sum(axis=1, keepdims=True)))
        return np.concatenate(parts) if parts else np.zeros((0, len(self.languages)), np.float32)

    def fit(self, x: np.ndarray, y: np.ndarray, epochs: int = EPOCHS, rate: float = RATE, seed: int = SEED) -> None:
        """Adam on the cross entropy; a language's rows weigh as much as any other's in all."""
        rng = np.random.default_rng(seed)
        w = self.weights
        first = {k: np.zeros_like(v) for k, v in w.items()}
        second = {k: np.zeros_like(v) for k, v in w.items()}
        share = len(y) / (len(self.languages) * np.maximum(np.bincount(y, minlength=len(self.languages)), 1))
        step = 0
        for _ in range(epochs):
            order = rng.permutation(len(x))
            for i in range(0, len(x), BATCH):
                step += 1
                xb, yb = x[order[i:i + BATCH]], y[order[i:i + BATCH]]
                for k, g in self._gradients(xb, yb, share[yb].astype(np.float32)).items():
                    first[k] = 0.9 * first[k] + 0.1 * g
                    second[k] = 0.999 * second[k] + 0.001 * g * g
                    w[k] -= (rate * (first[k] / (1 - 0.9 ** step))
                             / (np.sqrt(second[k] / (1 - 0.999 ** step)) + 1e-8)).astype(np.float32)

    def _gradients(self, x, y, weight) -> dict[str, np.ndarray]:
        w = self.weights
        patches, out = self._forward(x)
        best = out.argmax(axis=1)
        pooled = np.take_along_axis(out, best[:, None], axis=1)[:, 0] + w["filter_bias"]
        hidden = np.maximum(pooled, 0)
        z = hidden @ w["dense"] + w["dense_bias"]
        p = np.exp(z - z.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        p[np.arange(len(y)), y] -= 1
        d = p * weight[:, None] / len(y)
        dh = (d @ w["dense"].T) * (pooled > 0)
        # only the patch where a filter has its maximum counts
        chosen = patches[np.arange(len(x))[:, None], best]                       # row, filter, patch
        df = np.einsum("rf,rfp->pf", dh, chosen) * self.seen
        dx = (dh[:, :, None] * w["filters"].T).reshape(-1, EMBEDDING)            # row x filter x place, embedding
        place = best[:, :, None] * STRIDE + np.arange(max(WIDTHS))
        seen = x[np.arange(len(x))[:, None, None], place].ravel()
        de = np.stack([np.bincount(seen, dx[:, k], 256) for k in range(EMBEDDING)], axis=1)
        de[0] = 0
        return {"embedding": de, "filters": df, "filter_bias": dh.sum(axis=0), "dense": hidden.T @ d,
                "dense_bias": d.sum(axis=0)}


def has_letter(text: Column) -> Column:
    return F.coalesce(text.rlike(r"\p{L}"), F.lit(False))


def train(rows: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> ByteCNN | None:
    """Fit on labelled ``rows`` (those with a language and a letter); None if there are none."""
    small_batches(rows.sparkSession)
    d = rows.filter(F.col(lang_col).isNotNull() & has_letter(F.col(text_col)))
    n = F.length(text_col)
    cut = [F.col(text_col).substr((F.pmod(F.xxhash64(F.col(id_col), F.lit(k)), F.greatest(n - k, F.lit(1))) + 1)
                                  .cast("int"), F.lit(k)) for k in EXCERPTS]
    d = d.select(F.col(lang_col).alias("lang"), F.col(id_col).alias("id"), F.array(*cut).alias("parts"))
    sample = (smallest_hashes(d, "lang", F.xxhash64("id"), PER_LANGUAGE).orderBy("at", "lang").limit(TRAIN_ROWS)
              .select("lang", "parts").collect())
    if not sample:
        return None
    languages = sorted({r.lang for r in sample})
    texts = [(p.encode(), r.lang) for r in sample for p in r.parts if p]
    x = np.zeros((len(texts), WINDOW), np.uint8)
    for i, (t, _) in enumerate(texts):
        x[i, :min(len(t), WINDOW)] = np.frombuffer(t[:WINDOW], np.uint8)
    model = ByteCNN(languages)
    model.fit(x, np.array([languages.index(lang) for _, lang in texts]))
    return model


def predict(df: DataFrame, model: ByteCNN | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, lang_pred, score`` for every row of ``df``; the score is the language's probability."""
    d = df.select(F.col(id_col).alias("id"), F.when(has_letter(F.col(text_col)), F.col(text_col)).alias("text"))
    if model is None:
        return d.select(F.col("id").alias(id_col), F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"))
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches):
        for batch in batches:
            col = batch.column(1)
            data, off = text_buffer(col)
            scores = []
            for i, j in row_slices(off):
                x, row, held = windows(data[off[i]:off[j]], off[i:j + 1] - off[i])
                log = model.log_probabilities(x) * held[:, None]
                total = np.add.reduceat(log, np.searchsorted(row, np.arange(j - i)), axis=0)
                z = total / np.maximum(np.diff(off[i:j + 1]), 1)[:, None]
                p = np.exp(z - z.max(axis=1, keepdims=True))
                scores.append(p / p.sum(axis=1, keepdims=True))
            p = np.concatenate(scores) if scores else np.zeros((0, len(model.languages)))
            known = np.asarray(col.is_valid())
            best = p.argmax(axis=1) if len(p) else np.zeros(0, int)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0),
                 pa.array([model.languages[b] if k else "und" for b, k in zip(best, known)], pa.string()),
                 pa.array(np.where(known, p.max(axis=1, initial=0.0), 0.0).astype(float), pa.float64())],
                ["id", "lang_pred", "score"])
    return d.mapInArrow(run, f"id {kind}, lang_pred string, score double").withColumnRenamed("id", id_col)


@register("op3_language_id")
def op3_language_id(spark, sf_dir):
    d = documents(spark, sf_dir)
    held_out = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 5 == 0
    model = train(d.filter(~held_out))
    return predict(d, model).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")
