"""Controls without images: majority classes, prior boxes and a naive Bayes text classifier, as aggregations and joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import code_tokens
from .profile import mode


def majority_prior(train: DataFrame, rows: DataFrame, keys: list[str], label: str, fallback: list[str]) -> DataFrame:
    """``rows`` with the majority label of their ``keys``, else of their ``fallback`` keys (ties by label)."""
    near = mode(train, keys, label).select(*keys, F.col(label).alias("_near"))
    far = mode(train, fallback, label).select(*fallback, F.col(label).alias("_far"))
    return rows.join(F.broadcast(near), keys, "left").join(F.broadcast(far), fallback, "left").withColumn("predicted", F.coalesce("_near", "_far")).drop("_near", "_far")


def box_priors(boxes: DataFrame, keys: list[str], box: str = "bbox") -> DataFrame:
    """Exact median of each coordinate (half to even), at least one pixel wide and high, per key."""
    med = [F.bround(F.median(F.get(box, F.lit(i))), 0).cast("long").alias(n) for i, n in enumerate(("x1", "y1", "x2", "y2"))]
    out = boxes.groupBy(*keys).agg(F.count("*").alias("n"), *med)
    return out.withColumn("x2", F.greatest("x2", F.col("x1") + 1)).withColumn("y2", F.greatest("y2", F.col("y1") + 1))


def mean_box_priors(boxes: DataFrame, keys: list[str], box: str, width, height) -> DataFrame:
    """Mean box relative to its image, per key."""
    parts = [F.round(F.avg(F.get(box, F.lit(i)) / (width if i % 2 == 0 else height)), 6).alias(n) for i, n in enumerate(("x1", "y1", "x2", "y2"))]
    return boxes.groupBy(*keys).agg(F.count("*").alias("n"), *parts)


class NaiveBayes:
    """Multinomial naive Bayes with Laplace smoothing, one model per task, as three count tables."""

    def __init__(self, train: DataFrame, task: str, label: str, text: str):
        self.task, self.label, self.text = task, label, text
        rows = train.where(F.col(label).isNotNull() & F.col(task).isNotNull())
        said = rows.select(task, label, F.explode(code_tokens(F.coalesce(F.col(text), F.lit("")))).alias("token"))
        self.classes = rows.groupBy(task, label).agg(F.count("*").alias("rows"))
        self.tokens = said.groupBy(task, label, "token").agg(F.count("*").alias("c"))
        self.totals = self.tokens.groupBy(task, label).agg(F.sum("c").alias("class_tokens"))
        self.vocabulary = self.tokens.groupBy(task).agg(F.count_distinct("token").alias("vocabulary"))

    def scores(self, rows: DataFrame, key: str) -> DataFrame:
        """Log score of every row and label of its task: key, task, label, score.

        The unseen-token part is the row's token count times one constant per label, so only tokens that a label has are
        joined; labels are few by nature, so the class table is broadcast.
        """
        t, lab = self.task, self.label
        per_task = self.classes.groupBy(t).agg(F.sum("rows").alias("_all"))
        consts = self.classes.join(per_task, t).join(self.totals, [t, lab], "left").join(self.vocabulary, t, "left")
        consts = consts.select(t, lab, F.log(F.col("rows") / F.col("_all")).alias("_prior"), (F.coalesce("class_tokens", F.lit(0)) + F.coalesce("vocabulary", F.lit(0))).alias("_den"))
        words = rows.select(key, t, code_tokens(F.coalesce(F.col(self.text), F.lit(""))).alias("_w")).withColumn("_len", F.size("_w"))
        # few prompts differ much: count each (row, token) once before the join
        seen = words.select(key, t, F.explode("_w").alias("token")).groupBy(key, t, "token").agg(F.count("*").alias("_k"))
        gains = seen.join(self.tokens, [t, "token"]).groupBy(key, t, lab).agg(F.sum(F.col("_k") * F.log(F.col("c") + 1)).alias("_gain"))
        base = words.select(key, t, "_len").join(F.broadcast(consts), t)
        score = F.col("_prior") - F.when(F.col("_len") > 0, F.col("_len") * F.log(F.col("_den"))).otherwise(0.0) + F.coalesce("_gain", F.lit(0.0))
        return base.join(gains, [key, t, lab], "left").select(key, t, lab, score.alias("score"))

    def predict(self, rows: DataFrame, key: str) -> DataFrame:
        """Best label per row, ties by label."""
        return self.scores(rows, key).groupBy(key, self.task).agg(F.min_by(self.label, F.struct(-F.round("score", 9), self.label)).alias("predicted"))

    def log_odds(self, rows: DataFrame, key: str, positive: dict[str, str], negative: dict[str, str]) -> DataFrame:
        """Score of the positive less that of the negative label of each task."""
        pick = lambda m: F.max(F.when(F.col(self.label) == F.try_element_at(F.create_map(*[F.lit(x) for kv in m.items() for x in kv]), F.col(self.task)), F.col("score")))
        return self.scores(rows, key).groupBy(key, self.task).agg((pick(positive) - pick(negative)).alias("score"))
