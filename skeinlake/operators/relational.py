"""Joins and record-level operators of the dataset build: last-wins, coverage, parity, reasons, views, containment."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import contains, corners


def last_per_key(df: DataFrame, key: str, order: list[str], keep: list[str] | None = None) -> DataFrame:
    """The last row (by ``order``) of every non-null key, in one map-side combined aggregation."""
    keep = [c for c in (keep or df.columns) if c != key]
    return df.where(F.col(key).isNotNull()).groupBy(key).agg(F.max_by(F.struct(*keep), F.struct(*order)).alias("_l")).select(key, "_l.*")


def coverage(expected: DataFrame, given: DataFrame, key: str) -> DataFrame:
    """Keys that break one-to-one coverage: missing, unexpected, or repeated on a side."""
    sides = expected.select(key, F.lit(1).alias("e"), F.lit(0).alias("g")).unionByName(given.select(key, F.lit(0).alias("e"), F.lit(1).alias("g")))
    per = sides.groupBy(key).agg(F.sum("e").alias("n_expected"), F.sum("g").alias("n_given"))
    why = F.when(F.col("n_given") == 0, "missing").when(F.col("n_expected") == 0, "unexpected").when((F.col("n_expected") > 1) | (F.col("n_given") > 1), "repeated")
    return per.withColumn("issue", why).where("issue is not null")


class CoverageError(ValueError):
    """Two sides that must cover each other do not."""


def join_covered(expected: DataFrame, given: DataFrame, key: str) -> DataFrame:
    """Inner join after a check that both sides hold the same keys once each."""
    broken = coverage(expected, given, key).limit(3).collect()
    if broken:
        raise CoverageError(f"not covered exactly: {[tuple(r) for r in broken]}")
    return expected.join(given, key)


def parity(a: DataFrame, b: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """Per field, how many shared keys hold different values (null equals null), and how many keys only one side has."""
    left = a.select(key, F.lit(True).alias("_a"), F.struct(*fields).alias("x"))
    both = left.join(b.select(key, F.lit(True).alias("_b"), F.struct(*fields).alias("y")), key, "full")
    shared = F.col("_a") & F.col("_b")
    differ = [F.sum((shared & ~F.col(f"x.{f}").eqNullSafe(F.col(f"y.{f}"))).cast("long")).alias(f) for f in fields]
    one = both.agg(*differ, F.sum(F.col("_b").isNull().cast("long")).alias("only_first"), F.sum(F.col("_a").isNull().cast("long")).alias("only_second"))
    names = [*fields, "only_first", "only_second"]
    return one.select(F.explode(F.array(*[F.struct(F.lit(n).alias("field"), F.coalesce(F.col(n), F.lit(0)).alias("n_different")) for n in names])).alias("r")).select("r.*")


def lookup_chain(df: DataFrame, steps: list[tuple[str, DataFrame, str, str]]) -> DataFrame:
    """Follow keys through lookup tables: (name, table, key in what is known so far, key of the table). Adds ``reason``: the first
    step that found nothing, null when all did. Every table must hold its key once."""
    reason = F.lit(None).cast("string")
    for name, other, have, key in steps:
        mark = f"_hit_{name}"
        df = df.join(other.withColumn(mark, F.lit(True)).withColumnRenamed(key, f"_key_{name}"), F.col(have) == F.col(f"_key_{name}"), "left")
        reason = F.coalesce(reason, F.when(F.col(mark).isNull(), f"no_{name}"))
    return df.withColumn("reason", reason)


def pair_views(df: DataFrame, keys: list[str], view: str, values: list[str], views: tuple[str, str] = ("ANT", "POST")) -> DataFrame:
    """Rows of two views side by side: ``keys`` that have each view exactly once, one struct per view."""
    agg = []
    for v in views:
        here = F.col(view) == v
        agg += [F.count(F.when(here, 1)).alias(f"n_{v}"), F.first(F.when(here, F.struct(*values)), ignorenulls=True).alias(v)]
    both = df.where(_not_null(keys)).groupBy(*keys).agg(*agg)
    return both.where(" and ".join(f"n_{v} = 1" for v in views)).drop(*[f"n_{v}" for v in views])


def _not_null(keys: list[str]) -> Column:
    out = F.lit(True)
    for k in keys:
        out = out & F.col(k).isNotNull()
    return out


def assign_containers(spots: DataFrame, regions: DataFrame, keys: list[str], spot_id: str, region_id: str, spot_box: str = "bbox", region_box: str = "region_box") -> DataFrame:
    """Each spot with the regions of the same keys whose box holds it: sorted ids and unique_region, ambiguous_regions or unassigned.

    Regions fall into square cells as wide as the power of two above their longer side, four cells at most each; a spot looks
    up the cell of its corner on every level that occurs (their number is the logarithm of the extents). So a key that holds
    many boxes is met cell by cell, and boxes far apart never meet. Spots and regions without a whole box hold nothing.
    """
    x1, y1, x2, y2 = corners(F.col(region_box))
    level = F.greatest(F.lit(0), F.ceil(F.log2(F.greatest(x2 - x1, y2 - y1, F.lit(1.0)))).cast("int"))
    placed = regions.select(*keys, region_id, region_box, level.alias("_level"), x1.alias("_x1"), y1.alias("_y1"), x2.alias("_x2"), y2.alias("_y2")).where("_x1 <= _x2 and _y1 <= _y2")
    cell = lambda v: F.floor(v / F.pow(F.lit(2.0), F.col("_level"))).cast("long")
    placed = placed.withColumn("_cx", F.explode(F.sequence(cell(F.col("_x1")), cell(F.col("_x2"))))).withColumn("_cy", F.explode(F.sequence(cell(F.col("_y1")), cell(F.col("_y2")))))
    levels = sorted(r[0] for r in placed.select("_level").distinct().collect())  # one per doubling of the extents
    sx, sy, *_ = corners(F.col(spot_box))
    looked = spots.where(_not_null(keys)).withColumn("_level", F.explode(F.array(*map(F.lit, levels)) if levels else F.array().cast("array<int>"))).withColumn("_cx", cell(sx)).withColumn("_cy", cell(sy))
    hits = looked.join(placed.select(*keys, region_id, region_box, "_level", "_cx", "_cy"), [*keys, "_level", "_cx", "_cy"]).where(contains(F.col(region_box), F.col(spot_box)))
    found = hits.groupBy(spot_id).agg(F.array_sort(F.collect_set(region_id)).alias("candidates"))
    out = spots.join(found, spot_id, "left").withColumn("candidates", F.coalesce("candidates", F.array().cast("array<string>")))
    n = F.size("candidates")
    return out.withColumn("assignment", F.when(n == 1, "unique_region").when(n > 1, "ambiguous_regions").otherwise("unassigned"))


def pick_alternate(df: DataFrame, group: str, positive: Column, key: str, differs: str) -> DataFrame:
    """For each positive row, the first (least key) negative row of its group with another value in ``differs``.

    Only the two least keys per (group, value) could ever be needed, in fact one per value, so negatives are first reduced to
    the least key of every (group, value); a group's rows never meet each other.
    """
    neg = df.where(~positive & F.col(differs).isNotNull()).groupBy(group, F.col(differs).alias("_v")).agg(F.min(key).alias("_k"))
    two = neg.groupBy(group).agg(F.slice(F.array_sort(F.collect_list(F.struct("_k", "_v"))), 1, 2).alias("_two"))
    hit = df.where(positive).join(two, group, "left")
    pick = F.get(F.filter("_two", lambda s: s["_v"] != F.col(differs)), F.lit(0))
    return hit.select(key, group, differs, pick["_k"].alias("alternate"), pick["_v"].alias("alternate_value"))


def hierarchy(records: DataFrame, spots: DataFrame, record: str, group: list[str], bad: Column, spot_bad: Column) -> DataFrame:
    """Labels rolled up: a record is effective if it is bad itself or the only candidate of a bad, uniquely assigned spot; its
    group (patient and view) if any of its records is. ``spots`` needs assignment and candidates."""
    hit = spots.where((F.col("assignment") == "unique_region") & (F.size("candidates") == 1) & spot_bad).select(F.get("candidates", F.lit(0)).alias(record)).distinct().withColumn("_up", F.lit(True))
    rows = records.withColumn("raw", F.coalesce(bad, F.lit(False))).join(hit, record, "left").withColumn("effective", F.col("raw") | F.coalesce("_up", F.lit(False))).drop("_up")
    per = rows.groupBy(*group).agg(F.bool_or("raw").alias("group_raw"), F.bool_or("effective").alias("group_effective"), F.sum((F.col("raw") != F.col("effective")).cast("long")).alias("conflicts"))
    return rows.join(per, group)
