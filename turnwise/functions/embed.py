"""Default text embedder: hashed character n-grams, L2-normalised (runs without a model).

Everything stays on the JVM: n-grams from array functions, ``HashingTF`` for the hashed
counts, ``Normalizer`` for unit length, ``vector_to_array`` for a plain float array that the
kNN operators take. A user model plugs in instead as a pandas function ``str -> array<float>``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def char_ngrams(text: F.Column, n: int = 3) -> F.Column:
    """All character n-grams of the text (whitespace runs collapsed to one space)."""
    t = F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " ")
    return F.when(F.length(t) >= n, F.transform(F.sequence(F.lit(1), F.length(t) - n + 1),
                                                lambda i: F.substring(t, i, n))) \
            .otherwise(F.array(t))


def embed_hashed(df: DataFrame, text_col: str, out_col: str = "embedding", dim: int = 256, n: int = 3) -> DataFrame:
    from pyspark.ml.feature import HashingTF, Normalizer
    from pyspark.ml.functions import vector_to_array
    grams = df.withColumn("_grams", char_ngrams(F.col(text_col), n))
    tf = HashingTF(inputCol="_grams", outputCol="_tf", numFeatures=dim).transform(grams)
    norm = Normalizer(inputCol="_tf", outputCol="_vec", p=2.0).transform(tf)
    return norm.withColumn(out_col, vector_to_array("_vec", "float32")).drop("_grams", "_tf", "_vec")
