"""Runs over several systems, epochs or variants: which count, how they compare, what a run's log says.

Defined results
- a system that does not score every expected row takes no part; repeated scores of a row count once, the last one wins by value
- best epoch: the greatest score, ties by the earliest; null scores never win and are reported as such
- accuracy over no rows is null; leaves that both sides lack are equal
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.rates import rate


class UnstableRun(ValueError):
    """A run does not give again what it gave before."""


def complete_systems(expected: DataFrame, scores: DataFrame, key: str = "task_id", system: str = "system") -> DataFrame:
    """Scores of the systems that score every expected row, those rows only."""
    mine = scores.join(expected.select(key).distinct(), key, "left_semi").groupBy(system, key).agg(F.max("score").alias("score"))
    n = expected.select(key).distinct().count()
    full = mine.where("score is not null").groupBy(system).agg(F.count("*").alias("_n")).where(F.col("_n") == n)
    return mine.join(full.select(system), system, "left_semi")


def best_epoch(log: DataFrame, run: str, epoch: str, score: str) -> DataFrame:
    """Per run its best epoch with its score, its last epoch, epochs logged and epochs without a finite score."""
    s = F.when(~F.isnan(F.col(score).cast("double")), F.col(score).cast("double"))
    rows = log.withColumn("_s", s)
    pick = F.min_by(F.struct(epoch, "_s"), F.struct(-F.col("_s"), epoch))
    best = rows.where("_s is not null").groupBy(run).agg(pick.alias("_b"))
    per = rows.groupBy(run).agg(F.max(epoch).alias("last_epoch"), F.count("*").alias("epochs"), F.sum(F.col("_s").isNull().cast("long")).alias("undefined"))
    return per.join(best, run, "left").select(run, F.col(f"_b.{epoch}").alias("best_epoch"), F.col("_b._s").alias("best_score"), "last_epoch", "epochs", "undefined")


def abandoned(log: DataFrame, run: str, epoch: str, planned: int) -> DataFrame:
    """Runs that ended before their planned epochs."""
    return log.groupBy(run).agg(F.max(epoch).alias("reached")).where(F.col("reached") < planned)


def job_accuracy(rows: DataFrame, jobs: dict[str, Column], right: Column) -> DataFrame:
    """job, value, n, right, accuracy: each row counts once in every job (a pooled job is one value for all)."""
    named = F.array(*[F.struct(F.lit(n).alias("job"), F.coalesce(c, F.lit("none")).alias("value")) for n, c in jobs.items()])
    per = rows.withColumn("_right", F.coalesce(right, F.lit(False)).cast("long")).select("_right", F.explode(named).alias("j")).groupBy("j.job", "j.value").agg(F.count("*").alias("n"), F.sum("_right").alias("right"))
    return per.withColumn("accuracy", rate(F.col("right"), F.col("n")))


def side_agreement(scores: DataFrame, keys: list[str], score: str, positive: Column, cut: float) -> DataFrame:
    """How often the side of the cut a score lies on is the stored class."""
    ok = (F.col(score) >= cut) == positive
    return scores.where(F.col(score).isNotNull()).groupBy(*keys).agg(F.count("*").alias("n"), F.sum(F.coalesce(ok, F.lit(False)).cast("long")).alias("agree")).withColumn("agreement", rate(F.col("agree"), F.col("n")))


def leaves(kind: T.DataType, at: Column, path: str = "") -> list[Column]:
    """Every leaf of a nested value as struct(path, value): structs by field, all else as text."""
    if isinstance(kind, T.StructType):
        return [x for f in kind.fields for x in leaves(f.dataType, at[f.name], f"{path}.{f.name}".lstrip("."))]
    text = F.to_json(at) if isinstance(kind, (T.ArrayType, T.MapType)) else at.cast("string")
    return [F.struct(F.lit(path).alias("path"), text.alias("value"))]


def nested_diff(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """key, path, first, second: leaves on which two rows of one key differ. Both sides hold a key once and share a schema."""
    fields = [f for f in a.schema.fields if f.name != key]
    flat = lambda df: df.select(key, F.array(*[x for f in fields for x in leaves(f.dataType, F.col(f.name), f.name)]).alias("_l"))
    both = flat(a).join(flat(b).withColumnRenamed("_l", "_m"), key)
    pairs = both.select(key, F.explode(F.arrays_zip(F.col("_l").alias("x"), F.col("_m").alias("y"))).alias("z"))
    z = pairs.select(key, F.col("z.x.path").alias("path"), F.col("z.x.value").alias("first"), F.col("z.y.value").alias("second"))
    return z.where(~F.col("first").eqNullSafe(F.col("second")))


def merge_flags(first: Column, later: Column) -> Column:
    """Two maps as one; where both name a flag the later one wins. A null map has no flags."""
    empty = F.expr("cast(map() as map<string,boolean>)")
    a, b = F.coalesce(first, empty), F.coalesce(later, empty)
    return F.map_concat(F.map_filter(a, lambda k, _: ~F.map_contains_key(b, k)), b)
