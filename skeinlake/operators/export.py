"""Training rows: location tokens with the reasons of rejected rows, portable paths, and the parity of a release with its export.

Defined results
- a row that lacks what its form needs is rejected with every reason, never repaired; null paths stay null
- on a paired canvas the second view lies right of the first; a view without a size has no place on it
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import corners, is_box, norm_1023
from .relational import parity


def location_tokens(box: Column, width: Column, height: Column, offset: Column | int = 0) -> Column:
    """``<locYYYY><locXXXX>`` of both corners on the 0..1023 grid; ``offset`` moves a box right on a wider canvas."""
    off = F.lit(offset) if isinstance(offset, int) else offset
    x1, y1, x2, y2 = corners(box)
    grid = [norm_1023(y1, height), norm_1023(x1 + off, width), norm_1023(y2, height), norm_1023(x2 + off, width)]
    return F.concat(*[F.concat(F.lit("<loc"), F.lpad(g.cast("string"), 4, "0"), F.lit(">")) for g in grid])


def token_rows(tasks: DataFrame) -> DataFrame:
    """task_id, target, reasons: location-token targets of boxed tasks on the canvas of their two views (ANT left, POST right).

    Reasons: no_targets, bad_box, no_size, out_of_image, unknown_view, repeated_view, view_order, no_label.
    """
    view = lambda v: F.get(F.filter("images", lambda i: i["view"] == v), F.lit(0))["image_size"]
    rows = tasks.withColumns({"_t": F.coalesce("targets", F.expr("cast(array() as array<struct<view:string,bbox:array<int>>>)")), "_a": view("ANT"), "_p": view("POST")})
    at = lambda s, i: F.get(s, F.lit(i)).cast("double")
    width = F.coalesce(at("_a", 0), F.lit(0.0)) + F.coalesce(at("_p", 0), F.lit(0.0))
    height = F.greatest(at("_a", 1), at("_p", 1))
    size = lambda t: F.when(t["view"] == "ANT", F.col("_a")).when(t["view"] == "POST", F.col("_p"))
    some = lambda cond: F.exists("_t", lambda t: F.coalesce(cond(t), F.lit(False)))
    views = F.transform("_t", lambda t: t["view"])
    ok = lambda t: F.coalesce(is_box(t["bbox"]), F.lit(False))
    over = lambda t: ok(t) & ((at(t["bbox"], 2) > at(size(t), 0)) | (at(t["bbox"], 3) > at(size(t), 1)))
    reasons = {
        "no_targets": F.size("_t") == 0, "bad_box": some(lambda t: ~ok(t)), "no_size": some(lambda t: t["view"].isin("ANT", "POST") & (F.coalesce(F.size(size(t)), F.lit(0)) != 2)), "out_of_image": some(over),
        "unknown_view": some(lambda t: ~F.coalesce(t["view"].isin("ANT", "POST"), F.lit(False))), "repeated_view": F.size(F.array_distinct(views)) < F.size(views), "view_order": F.array_sort(views) != views, "no_label": F.col("label").isNull(),
    }
    why = F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(n)) for n, c in reasons.items()]))
    offset = lambda t: F.when(t["view"] == "POST", F.coalesce(at("_a", 0), F.lit(0.0))).otherwise(F.lit(0.0))
    text = F.array_join(F.transform("_t", lambda t: F.concat(location_tokens(t["bbox"], width, height, offset(t)), F.lit(" "), F.col("label"))), " ; ")
    return rows.select("task_id", F.when(F.size(why) == 0, text).alias("target"), why.alias("reasons"))


def portable_path(path: Column, roots: tuple[str, ...] = ("datasets", "data", "images")) -> Column:
    """A path without drive, backslashes and whatever stands before a known root folder."""
    plain = F.regexp_replace(F.replace(path, F.lit("\\"), F.lit("/")), "^[A-Za-z]:", "")
    cut = F.regexp_replace(plain, rf"^.*?/?(?=({'|'.join(roots)})/)", "")
    return F.regexp_replace(cut, "^(\\./|/)+", "")


def base_name(path: Column) -> Column:
    return F.regexp_extract(F.replace(path, F.lit("\\"), F.lit("/")), "([^/]*)$", 1)


def split_of_name(path: Column) -> Column:
    """The split a file name states (``validation`` and ``valid`` are val), null if none."""
    word = F.regexp_extract(F.lower(path), "(^|[^a-z])(train|validation|valid|val|test)([^a-z]|$)", 2)
    return F.when(word.isin("validation", "valid"), "val").otherwise(F.nullif(word, F.lit("")))


def shard_of_name(path: Column) -> Column:
    """Struct(shard, shards) of ``name-00003-of-00010``; nulls if the name states none."""
    part = lambda i: F.nullif(F.regexp_extract(path, r"-(\d+)-of-(\d+)", i), F.lit("")).cast("int")
    return F.struct(part(1).alias("shard"), part(2).alias("shards"))


def shard_issues(files: DataFrame, path: str = "path") -> DataFrame:
    """Splits whose shards are not all there once each: split, shards stated, shards found."""
    s = files.select(split_of_name(F.col(path)).alias("split"), shard_of_name(F.col(path)).alias("s")).where("s.shard is not null")
    per = s.groupBy("split").agg(F.max("s.shards").alias("stated"), F.count_distinct("s.shard").alias("found"), F.count("*").alias("files"))
    return per.where("stated <> found or files <> found")


def export_parity(release: DataFrame, export: DataFrame) -> DataFrame:
    """Per field the tasks a release and its export disagree on: prompt, split and the base names of the images."""
    side = lambda df: df.select("task_id", "prompt", "split", F.transform("images.image", base_name).alias("images"))
    return parity(side(release), side(export), "task_id", ["prompt", "split", "images"])


def missing_images(tasks: DataFrame, listing: DataFrame, path: str = "path") -> DataFrame:
    """task_id, image: images of tasks that no listed file has."""
    shown = tasks.select("task_id", F.explode(F.array_distinct("images.image")).alias("image")).where("image is not null")
    return shown.join(listing.select(F.col(path).alias("image")).distinct(), "image", "left_anti").select("task_id", "image")
