"""A scoring run: exact coverage, judging once, metrics, strata, intervals and paired comparison from the judged rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import judge as J
from ..operators import stats as S
from ..operators.relational import join_covered
from ..session import Workspace


class ScoringRun:
    """``expected`` tasks and one ``prediction`` per task_id. Rows are judged once and written; all else reads that table."""

    def __init__(self, expected: DataFrame, predictions: DataFrame, cluster: str = "patient_id", replicates: int = 200, seed: str = "boot"):
        self.work, self.cluster, self.replicates, self.seed = Workspace(expected.sparkSession, "scoring"), cluster, replicates, seed
        rows = join_covered(expected, predictions.select("task_id", "prediction"), "task_id")
        self.judged = self.work.save(J.judge(rows).drop("images", "targets", "prediction"), "judged")
        self.per_cluster = self.work.save(J.totals(self.judged, ["task_type", cluster]), "per_cluster")

    def metrics(self, *keys: str) -> DataFrame:
        sums = J.totals(self.judged, ["task_type", *keys])
        return sums.select("task_type", *keys, "n", *[c.alias(n) for n, c in J.metric_columns().items()])

    def selection_score(self) -> DataFrame:
        return J.selection_score(self.metrics())

    def replicate_metrics(self) -> DataFrame:
        w = S.bootstrap_weights(self.per_cluster, self.cluster, self.replicates, self.seed)
        sums = S.replicate_totals(self.per_cluster, w, self.cluster, ["task_type"], J.COUNTS)
        return self.work.save(sums.select("task_type", "replicate", *[c.alias(n) for n, c in J.metric_columns().items()]), "replicates")

    def intervals(self, *metrics: str) -> DataFrame:
        return S.intervals(self.replicate_metrics(), ["task_type"], metrics or ("balanced_accuracy", "macro_f1", "mean_iou", "iou_at_50", "strict_accuracy"))

    def against(self, other: ScoringRun, metric: str) -> DataFrame:
        """Paired differences to another run under the same weights, with Holm over the tasks."""
        d = S.paired(self.replicate_metrics(), other.replicate_metrics(), ["task_type"], metric)
        return S.holm(d.withColumn("family", F.lit(metric)), ["family"], tie="task_type")


def reproduce(found: DataFrame, archived: DataFrame, keys: list[str], tolerance: float = 1e-6) -> DataFrame:
    """Archived values that a run does not reproduce: keys, both values."""
    both = archived.select(*keys, F.col("value").alias("archived")).join(found.select(*keys, F.col("value").alias("found")), keys, "left")
    return both.where(~F.coalesce(F.abs(F.col("archived") - F.col("found")) <= tolerance, F.col("archived").isNull() & F.col("found").isNull()))
