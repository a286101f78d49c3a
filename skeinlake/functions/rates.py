"""Rates and metrics from counts, as columns. An undefined rate is null, never zero."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def total(cond: Column) -> Column:
    """Number of rows where a condition holds (null counts as no)."""
    return F.coalesce(F.sum(F.coalesce(cond, F.lit(False)).cast("long")), F.lit(0))


def rate(num: Column, den: Column, digits: int | None = 6) -> Column:
    r = F.try_divide(num.cast("double"), den.cast("double"))
    return r if digits is None else F.round(r, digits)


def mean_of(*cols: Column) -> Column:
    """Mean, null if any part is null."""
    return sum(cols[1:], cols[0]) / len(cols)


def class_metrics(pos: Column, neg: Column, tp: Column, tn: Column, fp: Column, n: Column, fn: Column | None = None) -> dict[str, Column]:
    """Binary metrics of counts. fn is pos - tp, so an invalid output on a positive is a miss; give ``fn`` for other rules.

    Single rates are rounded to 6 digits; balanced accuracy and macro-F1 are plain means of those.
    """
    fn = pos - tp if fn is None else fn
    sens, spec = rate(tp, tp + fn), rate(tn, neg)
    f1, neg_f1 = rate(2 * tp, 2 * tp + fp + fn), rate(2 * tn, 2 * tn + fn + fp)
    return {
        "accuracy": rate(tp + tn, n), "precision": rate(tp, tp + fp), "recall": sens, "specificity": spec, "f1": f1,
        "negative_precision": rate(tn, tn + fn), "negative_f1": neg_f1,
        "balanced_accuracy": mean_of(sens, spec), "macro_f1": mean_of(f1, neg_f1),
    }


def python_round(col: Column, digits: int = 0) -> Column:
    """Half to even, as Python rounds."""
    return F.bround(col, digits)


def log_sum_exp(values: Column) -> Column:
    """ln(sum(exp(v))) of an array, safe for large values; null for an empty one."""
    top = F.array_max(values)
    return top + F.log(F.aggregate(values, F.lit(0.0), lambda a, v: a + F.exp(v - top)))
