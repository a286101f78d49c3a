"""Audit profiles: summaries, entropy, top-k, duplicates, language, boxes, fingerprints, coverage and leakage."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.rates import rate
from ..functions.text import ngrams, tokens
from .skew import running_sums


def medians(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Exact median per key from counts of distinct values and their running sums over range partitions; no group is gathered."""
    per = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("_c"))
    run = running_sums(per, keys, [value], {"_upto": "_c"})
    total = per.groupBy(*keys).agg(F.sum("_c").alias("_n")).select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], "_n")
    on = F.lit(True)
    for i, k in enumerate(keys):
        on = on & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    at = lambda place: F.max(F.when((F.col("_upto") - F.col("_c") < place) & (place <= F.col("_upto")), F.col(value)))
    low, high = F.floor((F.col("_n") + 1) / 2), F.floor((F.col("_n") + 2) / 2)
    return run.join(total, on).groupBy(*keys).agg(((at(low) + at(high)) / 2).alias("median"))


def numeric_summary(df: DataFrame, keys: list[str], values: dict[str, Column], digits: int = 6) -> DataFrame:
    """Count, min, exact median, mean, max and population deviation of several values, one row per key and value."""
    r = lambda c: F.round(c.cast("double"), digits)
    long = df.select(*keys, F.explode(F.array(*[F.struct(F.lit(n).alias("value"), v.cast("double").alias("_v")) for n, v in values.items()])).alias("_e")).select(*keys, "_e.*")
    v, by = F.col("_v"), [*keys, "value"]
    stats = long.groupBy(*by).agg(F.count(v).alias("count"), r(F.min(v)).alias("min"), r(F.avg(v)).alias("mean"), r(F.max(v)).alias("max"), r(F.stddev_pop(v)).alias("std"))
    mid = medians(long, by, "_v").select(*[F.col(k).alias(f"_m{i}") for i, k in enumerate(by)], r(F.col("median")).alias("median"))
    on = F.lit(True)
    for i, k in enumerate(by):
        on = on & F.col(k).eqNullSafe(F.col(f"_m{i}"))
    return stats.join(mid, on, "left").select(*by, "count", "min", "median", "mean", "max", "std")


def counts(df: DataFrame, keys: list[str], name: str = "n") -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias(name))


def flag_counts(df: DataFrame, flags: str) -> DataFrame:
    """Rows per flag of a map column, true values only."""
    return df.select(F.explode(flags).alias("flag", "on")).where("on").groupBy("flag").agg(F.count("*").alias("n"))


def entropy(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Shannon entropy in bits and as a share of its maximum, 0 for a single class."""
    per = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("_n"))
    out = per.groupBy(*keys).agg(F.sum("_n").alias("n"), F.count("*").alias("classes"), F.sum(F.col("_n") * F.log2("_n")).alias("_l"))
    bits = F.when(F.col("classes") <= 1, 0.0).otherwise(F.log2("n") - F.col("_l") / F.col("n"))
    return out.select(*keys, "n", "classes", F.round(bits, 6).alias("bits"), F.round(F.when(F.col("classes") <= 1, 0.0).otherwise(bits / F.log2("classes")), 6).alias("normalised"))


def top_k(df: DataFrame, value: str, k: int) -> DataFrame:
    """The k most frequent values, ties by value (a bounded heap per task, no global sort)."""
    return df.where(F.col(value).isNotNull()).groupBy(value).agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), value).limit(k)


def mode(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Most frequent value per key, ties by the least value."""
    per = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("_n"))
    return per.groupBy(*keys).agg(F.min_by(value, F.struct(-F.col("_n"), value)).alias(value), F.max("_n").alias("n"))


def duplicate_groups(df: DataFrame, key: str, form: Column) -> DataFrame:
    """Rows whose form is shared: one row per document with its class (the least key) and the size of the class."""
    formed = df.where(form.isNotNull()).select(key, F.md5(form.cast("string")).alias("_f"))
    groups = formed.groupBy("_f").agg(F.min(key).alias("class_id"), F.count("*").alias("members")).where("members > 1")
    return formed.join(groups, "_f").select(key, "class_id", "members")


def duplicate_summary(df: DataFrame, form: Column) -> DataFrame:
    per = df.where(form.isNotNull()).groupBy(F.md5(form.cast("string")).alias("f")).agg(F.count("*").alias("c"))
    return per.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n_rows"), F.count("*").alias("n_unique"), F.sum((F.col("c") > 1).cast("long")).alias("groups"), F.sum(F.col("c") - 1).alias("surplus"), rate(F.sum(F.col("c") - 1), F.sum("c")).alias("duplicate_rate"))


def linguistic(df: DataFrame, keys: list[str], text: str) -> DataFrame:
    """Tokens, distinct tokens, type-token and hapax ratios, distinct bi- and trigrams per key.

    All three n-gram lengths are counted by one explode and one map-side combined count.
    """
    words = df.where(F.length(F.trim(text)) > 0).select(*keys, tokens(F.col(text)).alias("_t"))
    grams = F.concat(*[F.transform(ngrams(F.col("_t"), n), _tag(n)) for n in (1, 2, 3)])
    per = words.select(*keys, F.explode(grams).alias("g")).groupBy(*keys, "g.n", "g.gram").agg(F.count("*").alias("c"))
    one, of = F.col("n") == 1, lambda n: F.sum((F.col("n") == n).cast("long"))
    out = per.groupBy(*keys).agg(F.sum(F.when(one, F.col("c")).otherwise(0)).alias("n_tokens"), of(1).alias("unique_words"), of(2).alias("unique_bigrams"), of(3).alias("unique_trigrams"), F.sum((one & (F.col("c") == 1)).cast("long")).alias("hapax"))
    return out.withColumns({"type_token_ratio": rate(F.col("unique_words"), F.col("n_tokens")), "hapax_ratio": rate(F.col("hapax"), F.col("unique_words"))})


def _tag(n: int):
    return lambda g: F.struct(F.lit(n).alias("n"), g.alias("gram"))


def box_profile(df: DataFrame, keys: list[str], box: str, size: str) -> DataFrame:
    """Boxes, malformed ones, ones that leave their image, and summed extents of sound ones."""
    from ..functions.geometry import area, corners, in_image, is_box

    b = F.col(box)
    x1, y1, x2, y2 = corners(b)
    sound = F.coalesce(is_box(b), F.lit(False))
    out = F.coalesce(~in_image(b, F.col(size)), F.lit(False))
    return df.groupBy(*keys).agg(
        F.count("*").alias("boxes"), F.sum((~sound).cast("long")).alias("invalid"), F.sum((sound & out).cast("long")).alias("out_of_bounds"),
        F.round(F.avg(F.when(sound, x2 - x1)), 4).alias("mean_width"), F.round(F.avg(F.when(sound, y2 - y1)), 4).alias("mean_height"), F.round(F.avg(F.when(sound, area(b))), 4).alias("mean_area"),
    )


def fingerprint(df: DataFrame, key: str, keys: list[str] | None = None) -> DataFrame:
    """Digest of a set of keys, the same whatever their order: sorted digests of hash buckets, then of the buckets' digests.

    Buckets are named by leading hex digits of the hash, three more for every 4,096 times as many keys, and are joined level by
    level, 4,096 to one, so no task gathers more than some thousand digests however large the set is.
    """
    keys = keys or []
    ids = df.where(F.col(key).isNotNull()).select(*keys, F.sha2(F.col(key).cast("string"), 256).alias("_h")).distinct()
    n, digits = ids.count(), 3
    while n > 4096 * 16**digits:
        digits += 3
    level = ids.select(*keys, "_h", F.col("_h").alias("_d"), F.lit(1).cast("long").alias("_n"))
    while digits >= 0:
        part = F.substring("_h", 1, digits) if digits else F.lit("")
        level = level.groupBy(*keys, part.alias("_b")).agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_h", "_d"))), lambda s: s["_d"]), ""), 256).alias("_d"), F.sum("_n").alias("_n")).withColumnRenamed("_b", "_h")
        digits -= 3
    return level.select(*keys, F.col("_d").alias("digest"), F.col("_n").alias("n"))


def crossing(df: DataFrame, what: dict[str, Column], split: str = "split") -> DataFrame:
    """Values (patients, images, evidence...) that occur in more than one split: kind, value, the splits, the rows that hold it.

    An array stands for all its values, each once a row.
    """
    listed = {n: df.select(c.alias("c")).schema["c"].dataType.typeName() == "array" for n, c in what.items()}
    none = F.array().cast("array<string>")
    values = {n: F.array_distinct(F.coalesce(c.cast("array<string>"), none)) if listed[n] else F.array(c.cast("string")) for n, c in what.items()}
    named = lambda n: lambda x: F.struct(F.lit(n).alias("kind"), x.alias("value"))
    one = F.concat(*[F.transform(v, named(n)) for n, v in values.items()])
    rows = df.where(F.col(split).isNotNull()).select(split, F.explode(one).alias("w")).select(split, "w.*").where("value is not null")
    return rows.groupBy("kind", "value").agg(F.array_join(F.array_sort(F.collect_set(split)), "+").alias("splits"), F.count("*").alias("n")).where("splits like '%+%'")


def warnings(kpis: DataFrame, rules: list[tuple[str, str, float, str]]) -> DataFrame:
    """KPI rows (name, value) against thresholds: (name, '<' or '>', limit, message)."""
    hits = [F.when((F.col("name") == n) & ((F.col("value") < x) if op == "<" else (F.col("value") > x)), F.lit(m)) for n, op, x, m in rules]
    return kpis.withColumn("warning", reduce(lambda a, b: F.coalesce(a, b), hits)).where("warning is not null")


def compare(a: DataFrame, b: DataFrame, name: str = "name", value: str = "value") -> DataFrame:
    """KPIs of two reports side by side with their difference."""
    left, right = a.select(name, F.col(value).alias("first")), b.select(name, F.col(value).alias("second"))
    return left.join(right, name, "full").withColumn("difference", F.col("second") - F.col("first"))
