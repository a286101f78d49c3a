"""Text quality of predictions: ROUGE-L and corpus BLEU."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import ngrams


def _lcs(a: list[str], b: list[str]) -> int:
    """Longest common subsequence by bit-parallel rows: one integer operation per word of ``b``."""
    at: dict[str, int] = {}
    for i, w in enumerate(a):
        at[w] = at.get(w, 0) | (1 << i)
    full = (1 << len(a)) - 1
    v = full
    for w in b:
        u = v & at.get(w, 0)
        v = ((v + u) | (v - u)) & full
    return len(a) - v.bit_count()


@F.pandas_udf(T.DoubleType())
def rouge_l(reference: pd.Series, candidate: pd.Series) -> pd.Series:
    """F1 of the longest common subsequence of blank-separated words; 0 if a side is empty, null if one is null."""

    def one(r, c):
        if r is None or c is None:
            return None
        a, b = r.split(), c.split()
        n = _lcs(a, b) if a and b else 0
        return 2 * n / (len(a) + len(b)) if n else 0.0

    return pd.Series([one(r, c) for r, c in zip(reference, candidate)], dtype="float64")


def clipped(reference: Column, candidate: Column, n: int) -> tuple[Column, Column]:
    """Matched and all n-grams of a candidate, each counted at most as often as the reference has it."""
    cand, ref = ngrams(candidate, n), ngrams(reference, n)
    count = lambda arr, g: F.size(F.filter(arr, lambda x: x == g))
    hit = F.aggregate(F.array_distinct(cand), F.lit(0), lambda a, g: a + F.least(count(cand, g), count(ref, g)))
    return hit.cast("long"), F.size(cand).cast("long")


def bleu(df: DataFrame, keys: list[str], reference: Column, candidate: Column, order: int = 4) -> DataFrame:
    """Corpus BLEU (0..1) from summed clipped counts with the brevity penalty; 0 if an order has no match."""
    ref, cand = F.split(F.trim(F.lower(reference)), r"\s+"), F.split(F.trim(F.lower(candidate)), r"\s+")
    rows = df.where(reference.isNotNull() & candidate.isNotNull()).select(*keys, ref.alias("_r"), cand.alias("_c"))
    sums = [F.size("_r").cast("long").alias("ref_len"), F.size("_c").cast("long").alias("cand_len")]
    for n in range(1, order + 1):
        hit, all_ = clipped(F.col("_r"), F.col("_c"), n)
        sums += [hit.alias(f"hit{n}"), all_.alias(f"all{n}")]
    names = ["ref_len", "cand_len", *[f"{w}{n}" for n in range(1, order + 1) for w in ("hit", "all")]]
    out = rows.select(*keys, *sums).groupBy(*keys).agg(*[F.sum(c).alias(c) for c in names])
    logs = sum((F.log(F.try_divide(F.col(f"hit{n}").cast("double"), F.col(f"all{n}"))) for n in range(2, order + 1)), F.log(F.try_divide(F.col("hit1").cast("double"), F.col("all1"))))
    brevity = F.when(F.col("cand_len") >= F.col("ref_len"), 1.0).otherwise(F.exp(1 - F.try_divide(F.col("ref_len").cast("double"), F.col("cand_len"))))
    none = F.least(*[F.col(f"hit{n}") for n in range(1, order + 1)]) == 0
    return out.withColumn("bleu", F.when(none, 0.0).otherwise(F.round(brevity * F.exp(logs / order), 6)))
